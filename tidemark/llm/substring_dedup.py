"""Substring de-duplication: fixed-length word windows seen in an earlier document are removed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tally
from tidemark.llm.common import Scratch, batches, chunk_docs, outer_id, unpack, unpack_attrs

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
WIDTH = 7


def roll(words: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """Rabin-Karp hash, modulo 2^64, of every `length` consecutive word hashes."""
    n = len(words) - length + 1
    out = np.zeros(max(0, n), np.uint64)
    for j in range(length):
        out *= base
        out += words[j : j + max(0, n)]
    # The low bits of a product depend on low bits only: spread the high ones.
    return out ^ (out >> np.uint64(32))


class Windows:
    """Words and windows of a chunk; windows never cross documents."""

    def __init__(self, row: dict, length: int, bits: int):
        self.ids, start, stop, data = unpack(row["ids"], row["ends"], row["text"])
        self.texts = [data[s:e] for s, e in zip(start.tolist(), stop.tolist())]
        self.words = [t.split() for t in self.texts]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        total = int(self.sizes.sum())
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for d in self.words for w in d), np.uint64, total)
        doc = np.repeat(np.arange(len(self.ids)), self.sizes)
        inside = np.zeros(0, bool) if total < length else doc[: total - length + 1] == doc[length - 1 :]
        self.at = np.flatnonzero(inside)
        self.doc = doc[self.at]
        low, high = (roll(hashes, length, b)[self.at] for b in _BASES)
        self.keys = tally.Keys(low, high, bits, WIDTH)
        self.owner = self.ids[self.doc[self.keys.first]]  # ids ascend, so this is the smallest of the chunk


def remove_repeated_windows(
    docs: DataFrame, length: int = 13, id_col: str = "doc_id", text_col: str = "text",
    carry: list[str] | None = None, chunk_bytes: int = 4 << 20,
) -> DataFrame:
    """Remove every word covered by a window of `length` words that also starts in a document
    with a smaller id. Windows are judged on the input.

    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space),
    text (the kept words; unchanged where nothing goes), and `carry`: the carried columns as one
    JSON string. Nulls: a null text has no words; a null id counts as larger than any other, and
    equal ids never remove each other's words. Repeated rows give repeated results. Texts
    shorter than a window stay whole. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "windows")
    attrs = F.to_json(F.struct(*[F.col(f"`{c}`") for c in carry])) if carry else F.lit(None).cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), attrs.alias("attrs"))
    chunks = scratch.stage(chunk_docs(rows, chunk_bytes), "chunks", "none")
    size = chunks.select(F.sum(F.length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    bits = tally.bucket_bits((size["b"] or 0) // 2)  # about one word to two compressed bytes at most
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (1 << bits) // 8)

    def make(row: dict) -> Iterator[tuple]:
        w = Windows(row, length, bits)
        yield from w.keys.requests(row["chunk"], w.owner)

    replies = scratch.stage(tally.reply(tally.request(chunks, make), parts, True), "replies")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string()), ("carry", pa.string())])

    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            for f in frames:
                for row in f.to_pylist():
                    yield from apply(row)

        yield from batches(schema, results(), 512)

    def apply(row: dict) -> Iterator[tuple]:
        w = Windows(row, length, bits)
        earlier = w.keys.answer(tally.as_dict(row["replies"]))
        # Gone: an earlier document elsewhere, or an earlier one in this chunk.
        gone = earlier[w.keys.which] | (w.ids[w.doc] > w.owner[w.keys.which])
        edge = np.zeros(int(w.sizes.sum()) + length + 1, np.int64)
        np.add.at(edge, w.at[gone], 1)
        np.add.at(edge, w.at[gone] + length, -1)
        covered = np.cumsum(edge)[: int(w.sizes.sum())] > 0
        carried = unpack_attrs(row["attrs"], len(w.ids))
        at = 0
        for k, (i, words) in enumerate(zip(outer_id(w.ids), w.words)):
            mine = covered[at : at + len(words)]
            at += len(words)
            n = int(mine.sum())
            kept = b" ".join(words if not n else [x for x, c in zip(words, mine.tolist()) if not c])
            text = kept if n else w.texts[k]
            yield i, len(words), n, hashlib.sha256(kept).hexdigest(), text.decode("utf-8", "replace"), carried[k]

    return tally.with_replies(chunks, replies).mapInArrow(
        cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, text string, carry string"
    )


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", **how) -> DataFrame:
    """The rows of `docs` without passages of an earlier document, in their own columns; documents
    that lose every word go.

    A changed text is its kept words joined by one space, and `length_col`, where there is one,
    counts its code points as a long.
    """
    rest = [c for c in docs.columns if c not in (id_col, text_col, length_col)]
    carried = docs.select(*[F.col(f"`{c}`") for c in rest]).schema
    out = remove_repeated_windows(docs, id_col=id_col, text_col=text_col, carry=rest, **how)
    back = F.from_json("carry", carried) if rest else F.struct(F.lit(None).alias("none"))
    kept = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))).select("doc_id", "text", back.alias("row"))
    columns = {id_col: F.col("doc_id"), text_col: F.col("text"), length_col: F.length("text").cast("long")}
    return kept.select(*[(columns[c] if c in columns else F.col("row").getField(c)).alias(c) for c in docs.columns])
