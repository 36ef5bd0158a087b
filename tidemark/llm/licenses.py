"""License notices by MinHash bands over overlapping windows, verified by shingle containment.

Everything here is DataFrame expressions; no Python runs on the executors. Shingles that no
template has say nothing about a template, so they are left out before the windows are hashed:
what is left of a window that holds a notice is close to the notice itself.
"""

from __future__ import annotations

import math
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

SPACE = r"[\x20\x09-\x0D]+"
MARKS = ".,;:!?\"'()[]{}"
SHINGLE = 3
#: A window whose kept shingles are similar to a template by s is found with probability
#: 1 - (1 - s)^bands at one row a band; there are as many bands as leave MISS of the windows that
#: hold the template's smallest accepted part among as many other known shingles as fit.
MISS = 1e-4
#: Window steps in words; from the last on they double until the longest template fits. A template
#: belongs to the smallest step that its shingles fit; windows are two steps long, so that one of
#: them holds it whole.
STEPS = [16, 64, 256]
#: Common notices of public licenses.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MIT-permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("BSD-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC-permission", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
]


def _shingles(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """`keep`, position and hash of every shingle of lower-case words without punctuation."""
    clean = F.translate(F.lower(F.coalesce(F.col(text), F.lit(""))), MARKS, "")
    words = df.select(*keep, F.filter(F.split(clean, SPACE, -1), lambda w: w != "").alias("_w"))
    last = F.size("_w") - SHINGLE
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    hashes = words.select(*keep, F.transform(at, lambda i: F.xxhash64(F.concat_ws(" ", F.slice("_w", i + 1, SHINGLE)))).alias("_h"))
    # The outer form: an inferred filter on the array would be pushed below and split the text once per word.
    return hashes.select(*keep, F.posexplode_outer("_h").alias("pos", "shingle")).where("shingle is not null")


def _bands(hits: DataFrame, bands: int, *keys: str) -> DataFrame:
    """One row per band: its number and the least hash of the group's shingles."""
    least = [F.min(F.xxhash64("shingle", F.lit(b))).alias(f"_b{b}") for b in range(bands)]
    signed = hits.groupBy(*keys).agg(*least)
    return signed.select(*keys, F.posexplode(F.array(*[f"_b{b}" for b in range(bands)])).alias("band", "value"))


def templates(spark: SparkSession, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(notices or NOTICES, "license string, notice string")


def full_texts() -> list[tuple[str, str]]:
    """The whole licenses in `license_texts/`, each named after its file; for `templates`."""
    return [(p.stem, p.read_text()) for p in sorted(Path(__file__).with_name("license_texts").glob("*.txt"))]


def scan(docs: DataFrame, notices: DataFrame | None = None, containment: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, n_shared, n_shingles: per document and license, the most distinct shingles of
    the notice in one window, where they are at least `containment` of the notice's.

    Notices that differ in one word of many, such as a version, contain each other by more than
    0.8; to tell them apart ask for a `containment` of 1. Rows of one id are taken together if their texts are equal. A null text has no shingles; a null
    id is kept; notices of fewer words than a shingle match nothing; an empty table, or no
    notices, gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "licenses")
    notices = templates(spark) if notices is None else notices
    every = _shingles(notices, "notice", "license")
    sized = every.groupBy("license").agg(F.countDistinct("shingle").alias("n_shingles"), F.max("pos").alias("last"))
    doubled = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("last") + 1))).cast("long")
    step = reduce(lambda a, s: F.when(F.col("last") < s, s).otherwise(a), reversed(STEPS), doubled)
    sized = sized.select("license", "n_shingles", step.alias("step"))
    known = scratch.stage(every.select("license", "shingle").distinct().join(sized, "license"), "known")
    part = F.ceil(F.lit(float(containment)) * F.col("n_shingles"))
    least = known.agg(F.min(part / (2 * F.col("step") + F.col("n_shingles") - part))).first()[0]
    bands = max(1, math.ceil(math.log(MISS) / math.log(1 - least))) if least and least < 1 else 1
    mine = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("_text"), F.col(f"`{text_col}`").alias("_t"))
    # Few shingles of a corpus are in a notice: from here on the data is small beside the texts.
    met = _shingles(mine, "_t", "doc_id", "_text").join(known.select("shingle", "step").distinct(), "shingle")
    at = F.floor(F.col("pos") / F.col("step"))
    window = met.select("doc_id", "_text", "step", "shingle", F.explode(F.array(at - 1, at)).alias("window"))
    window = scratch.stage(window.distinct(), "windows")
    keys = ["doc_id", "_text", "step", "window"]
    wanted = _bands(known.select("license", "step", "shingle"), bands, "license", "step")
    found = _bands(window, bands, *keys).join(wanted, ["step", "band", "value"]).select(*keys, "license").distinct()
    named = found.select(*[F.col(k).alias(f"_{k}") for k in keys], "license")
    same = [F.col(f"_{k}").eqNullSafe(F.col(k)) for k in keys]
    shared = named.join(window, reduce(lambda a, b: a & b, same)).select(*keys, "license", "shingle")
    counted = shared.join(known.select("license", "shingle", "n_shingles"), ["license", "shingle"]).groupBy(*keys, "license").agg(
        F.count(F.lit(1)).alias("n"), F.first("n_shingles").alias("n_shingles")
    )
    kept = counted.where(F.col("n") >= containment * F.col("n_shingles"))
    return kept.groupBy("doc_id", "license").agg(F.max("n").alias("n_shared"), F.first("n_shingles").alias("n_shingles"))
