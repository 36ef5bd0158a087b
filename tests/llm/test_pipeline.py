"""The pipeline on planted documents, each stage against what a plain reading of its rule keeps."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm.common import shared_folder

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def planted(folder, spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8)))
    say = lambda n: [word() for _ in range(n)]
    item, passage, base = say(30), say(70), say(150)
    near = base[:60] + ["other"] + base[61:]
    texts = {
        0: say(120), 1: say(90), 2: base, 3: base, 4: near,  # 3 and 4 are copies of 2
        5: ["few", "words"], 6: ["spam"] * 200, 7: [w + "###" for w in say(60)],  # junk
        8: say(40) + passage + say(30), 9: say(25) + passage + say(45),  # 9 loses the passage
        10: say(50) + item + say(50), 11: say(20) + item[20:] + item[10:20] + item[:10] + say(20),  # leaks, one moved in parts too short for the window cut
        12: say(3000), 13: say(11),
    }
    rows = [(k, " ".join(t), "en" if k % 2 else None, f"s{k % 3}", len(" ".join(t))) for k, t in texts.items()]
    rows += [(14, None, None, None, None), (15, "", "en", "s0", 0), rows[0]]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts, passage


def test_stages_one_by_one(spark, tmp_path):
    texts, passage = planted(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.schema.simpleString() == spark.createDataFrame([], COLUMNS).schema.simpleString(), name
            docs.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
            kept.append({r["doc_id"]: r for r in docs.collect()})
    quality, unique, cut, clean = kept
    assert set(quality) == {0, 1, 2, 3, 4, 8, 9, 10, 11, 12, 13}
    assert set(unique) == set(quality) - {3, 4} and set(cut) == set(unique)
    assert {k: r["text"] for k, r in cut.items() if k != 9} == {k: " ".join(texts[k]) for k in cut if k != 9}
    assert cut[9]["text"] == " ".join(w for w in texts[9] if w not in set(passage)) and cut[9]["n_chars"] == len(cut[9]["text"]) and cut[9]["source"] == "s0"
    assert set(clean) == set(cut) - {10, 11}
    pieces = docs.collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {k: np.array(t.encode(r["text"], add_special_tokens=False).ids + [0], "<u4") for k, r in clean.items()}
    assert all(zlib.crc32(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for p in pieces)
    total = Counter()
    for p in pieces:
        total[p["doc_id"]] += p["length"]
    assert total == Counter({k: len(v) for k, v in ids.items()})


def test_run_takes_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "sequence_id" in out.columns


def test_near_duplicates_leave_only_the_kept_ids_behind(spark, tmp_path):
    texts, _ = planted(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    out = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    left = [p.name for p in set(folder.iterdir()) - before]
    assert [n.split("-")[0] for n in left if n.startswith(("simhash", "similar", "kept"))] == ["kept"]
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == {*texts, 14, 15} - {3, 4, 15}
