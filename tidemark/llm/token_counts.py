"""Token counts through a cache keyed by content and tokenizer digests."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.common import Scratch, shared_folder, texts

CACHE = "tokenizer string, digest binary, n_tokens long"


def content_digest(text):
    """SHA-256 of a text whose runs of ASCII white space are one space, without outer ones.

    The tokenizers counted here drop white space, so texts that differ only in it share a count.
    """
    return F.unhex(F.sha2(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")), 256))


def cached_counts(
    docs: DataFrame, tokenizer: str = "word_bpe_49k.json", cache: str | None = None, limit: int = 2048,
    id_col: str = "doc_id", text_col: str = "text", count: Callable[[str, list[str]], list[int]] = tokens.count_tokens,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit per row of `docs`.

    Rows are joined to the stored counts of this tokenizer version; each distinct content that
    has none is encoded once and appended to `cache`, a folder of Parquet files (a new, empty one
    in the shared folder if None). Appends are whole files, so a failed run leaves the cache as
    it was, and contents that two runs append at once are read once. A null text is empty and
    has no tokens; null ids and repeated rows are kept; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-counts")
    cache = cache or f"{shared_folder(spark)}/token-cache-{uuid.uuid4().hex}"
    version = tokens.version(tokenizer)
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_bytes"), content_digest(text).alias("digest"))
    keys = scratch.stage(rows, "keys")

    def stored() -> DataFrame:
        try:
            found = spark.read.schema(CACHE).parquet(cache)
        except Exception as e:  # the first run finds no cache folder
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], CACHE).select("digest", "n_tokens")
        return found.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    schema = pa.schema([("tokenizer", pa.string()), ("digest", pa.binary()), ("n_tokens", pa.int64())])

    def encode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for s in range(0, f.num_rows, 256):
                part = f.slice(s, 256)
                n = count(tokenizer, [t.decode("utf-8", "replace") for t in texts(part)])
                yield pa.RecordBatch.from_arrays([pa.array([version] * len(n)), part.column("digest"), pa.array(n, pa.int64())], schema=schema)

    # One text per content; the copies within a task are merged before the shuffle.
    distinct = docs.select(content_digest(text).alias("digest"), text.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(stored().select("digest"), "digest", "left_anti")
    misses.mapInArrow(encode, CACHE).write.mode("append").parquet(cache)
    counts = keys.join(stored(), "digest", "left")
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
