"""Repeated byte strings by difference-cover ranks and blockwise suffix buckets.

Two suffixes that agree on `length` bytes have a common distance below the cover's period at
which both are cover samples. So:

1. Cover samples (|D| of every `period` positions) are ranked by their first
   length - period + 1 bytes, one bucket of samples at a time. Only samples that share their rank
   with another matter: every long tie passes through two of them.
2. Suffixes that have such a sample within a period can tie; all others are done. The candidates
   are dealt to suffix buckets, and each bucket is sorted on its own by the full prefix.

Ranks and prefixes are compared by Rabin fingerprints, as only ties are asked for and not the
order of unequal suffixes. A task holds one bucket, whose size does not depend on the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tally
from tidemark.llm.common import Scratch, batches, chunk_docs, outer_id, unpack

#: Perfect difference sets (fixed values): every residue modulo the period is a difference.
COVERS = {
    7: [0, 1, 3],
    13: [0, 1, 3, 9],
    31: [0, 1, 3, 8, 12, 18],
    57: [0, 1, 3, 13, 32, 36, 43, 52],
    133: [0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109],
}
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_TABLE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_BLOCK = 1 << 17
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
RANK_WIDTH, PREFIX_WIDTH = 4, 7


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[base] = np.cumprod(up), np.cumprod(down)
    return _POWERS[base]


def prefix_hashes(data: np.ndarray, at: np.ndarray, length: int, base: int) -> np.ndarray:
    """Rabin fingerprint, modulo 2^64, of the `length` bytes from each of the ascending positions `at`."""
    up, down = _powers(base, _BLOCK + length)
    out = np.empty(len(at), np.uint64)
    cuts = np.searchsorted(at, np.arange(0, len(data) + _BLOCK, _BLOCK))
    for k in range(len(cuts) - 1):
        lo, hi = int(cuts[k]), int(cuts[k + 1])
        if lo == hi:
            continue
        start = k * _BLOCK
        piece = data[start : start + _BLOCK + length]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_TABLE[piece] * up[: len(piece)], out=sums[1:])
        p = at[lo:hi] - start
        out[lo:hi] = (sums[p + length] - sums[p]) * down[p]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def _keys(data: np.ndarray, at: np.ndarray, length: int, bits: int, width: int) -> tally.Keys:
    low, high = (prefix_hashes(data, at, length, b) for b in _BASES)
    return tally.Keys(low, high, bits, width)


def _samples(start: np.ndarray, stop: np.ndarray, period: int, depth: int) -> np.ndarray:
    """Cover positions of every document from its own start that have `depth` bytes left."""
    n = int(stop[-1]) if len(stop) else 0
    size = stop - start
    offset = np.arange(n) - np.repeat(start, size)
    covered = np.zeros(period, bool)
    covered[COVERS[period]] = True
    return np.flatnonzero(covered[offset % period] & (offset + depth <= np.repeat(size, size)))


def _runs(mask: np.ndarray) -> np.ndarray:
    """Start and end of every run of True."""
    edge = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    return edge.reshape(-1, 2)


def _starts(intervals: np.ndarray) -> np.ndarray:
    """All positions of ascending, disjoint intervals."""
    size = intervals[:, 1] - intervals[:, 0]
    if not len(size):
        return np.zeros(0, np.int64)
    return np.arange(int(size.sum())) + np.repeat(intervals[:, 0] - np.cumsum(size) + size, size)


_DONE = pa.struct([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept_sha256", pa.string())])
_REST = pa.schema([
    ("chunk", pa.int64()), ("ids", pa.binary()), ("ends", pa.binary()), ("text", pa.binary()), ("where", pa.binary()), ("full", pa.binary()), ("done", pa.list_(_DONE)),
])
_RESULT = "doc_id long, n_bytes long, spans array<array<long>>, kept_sha256 string"


def _digests(chunks: DataFrame, length: int) -> DataFrame:
    """(chunk, copies): which documents of a chunk have an equal text elsewhere; `first` marks the one that stands for all."""
    schema = pa.schema([("chunk", pa.int64()), ("k", pa.int64()), ("digest", pa.binary())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for f in frames:
                for row in f.to_pylist():
                    _, start, stop, data = unpack(row["ids"], row["ends"], row["text"])
                    for k, (s, e) in enumerate(zip(start.tolist(), stop.tolist())):
                        if e - s >= length:
                            yield row["chunk"], k, hashlib.sha256(data[s:e]).digest()

        yield from batches(schema, rows())

    each = chunks.mapInArrow(run, "chunk long, k long, digest binary")
    groups = each.groupBy("digest").agg(F.min(F.struct("chunk", "k")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    marked = each.join(groups, "digest").select("chunk", F.struct("k", (F.struct("chunk", "k") == F.col("least")).alias("first")).alias("c"))
    return marked.groupBy("chunk").agg(F.collect_list("c").alias("copies"))


def remove_repeated_bytes(
    docs: DataFrame, length: int = 200, period: int = 133, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 2 << 20,
) -> DataFrame:
    """Every byte covered by a string of `length` bytes that also starts anywhere else goes.

    Returns doc_id, n_bytes, spans (maximal removed runs as [start, end) byte offsets) and
    kept_sha256 (of the remaining bytes). Matches never cross documents, overlaps count, and the
    input decides. A null text is empty; null ids stay null; equal rows remove each other, if
    long enough; texts under `length` bytes stay whole; an empty table gives an empty result.
    """
    depth = length - period + 1
    if depth < 1:
        raise ValueError("the period must not exceed the length")
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.lit(None).cast("string").alias("attrs"))
    chunks = scratch.stage(chunk_docs(rows, chunk_bytes), "chunks", "none")
    size = (chunks.select(F.sum(F.length("text"))).first()[0] or 0) * 3  # of the plain texts, about
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rank_bits, prefix_bits = tally.bucket_bits(size * len(COVERS[period]) // period), tally.bucket_bits(size // 4)

    def ranks(row: dict) -> Iterator[tuple]:
        _, start, stop, data = unpack(row["ids"], row["ends"], row["text"])
        at = _samples(start, stop, period, depth)
        yield from _keys(np.frombuffer(data, np.uint8), at, depth, rank_bits, RANK_WIDTH).requests(row["chunk"], None)

    shared = tally.reply(tally.request(chunks, ranks), max(least, (1 << rank_bits) // 8), False)
    shared = scratch.stage(shared, "ranks")
    copies = scratch.stage(_digests(chunks, length), "copies")

    def narrow(row: dict) -> tuple:
        ids, start, stop, data = unpack(row["ids"], row["ends"], row["text"])
        raw = np.frombuffer(data, np.uint8)
        at = _samples(start, stop, period, depth)
        keys = _keys(raw, at, depth, rank_bits, RANK_WIDTH)
        tied = at[(keys.answer(tally.as_dict(row["replies"])) | keys.repeated)[keys.which]]
        doc = np.searchsorted(stop, tied, side="right")
        first, last = np.maximum(tied - period + 1, start[doc]), np.minimum(tied, stop[doc] - length)
        some = last >= first
        edge = np.zeros(len(raw) + 1, np.int64)
        np.add.at(edge, first[some], 1)
        np.add.at(edge, last[some] + 1, -1)
        able = np.cumsum(edge)[:-1] > 0
        alike = {c["k"]: c["first"] for c in row["copies"] or []}
        outer, sizes = outer_id(ids), (stop - start).tolist()
        done, rest, parts, where, at_now = [], [], [], [], 0
        for k, (s, e) in enumerate(zip(start.tolist(), stop.tolist())):
            if k in alike and not alike[k]:  # an equal text stands for it
                done.append({"doc_id": outer[k], "n_bytes": sizes[k], "spans": [[0, sizes[k]]], "kept_sha256": hashlib.sha256(b"").hexdigest()})
                continue
            runs = _runs(able[s:e])
            if not len(runs):
                done.append({"doc_id": outer[k], "n_bytes": sizes[k], "spans": [], "kept_sha256": hashlib.sha256(data[s:e]).hexdigest()})
                continue
            rest.append(k)
            parts.append(data[s:e])
            where.append(runs + at_now)
            at_now += e - s
        ends = np.cumsum([len(p) for p in parts]).astype(np.int64)
        intervals = np.concatenate(where).astype(np.int64) if where else np.zeros((0, 2), np.int64)
        full = np.array([k in alike for k in rest], bool)
        pack = zstandard.ZstdCompressor(level=3).compress
        return row["chunk"], ids[rest].tobytes(), ends.tobytes(), pack(b"".join(parts)), intervals.tobytes(), full.tobytes(), done

    def narrowed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for row in f.to_pylist():
                yield from batches(_REST, iter([narrow(row)]))

    joined = tally.with_replies(chunks, shared).join(copies.hint("shuffle_hash"), "chunk", "left")
    rest = joined.mapInArrow(narrowed, f"chunk long, ids binary, ends binary, text binary, where binary, full binary, done array<struct<{_RESULT.replace(' ', ':').replace(',:', ',')}>>")
    rest = scratch.stage(rest, "rest", "none")
    scratch.drop("chunks", "ranks", "copies")

    def suffixes(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes, np.ndarray, tally.Keys]:
        ids, start, stop, data = unpack(row["ids"], row["ends"], row["text"])
        at = _starts(np.frombuffer(row["where"], np.int64).reshape(-1, 2))
        return ids, start, stop, data, at, _keys(np.frombuffer(data, np.uint8), at, length, prefix_bits, PREFIX_WIDTH)

    def prefixes(row: dict) -> Iterator[tuple]:
        if row["where"]:
            yield from suffixes(row)[-1].requests(row["chunk"], None)

    open_rows = rest.select("chunk", "ids", "ends", "text", "where", "full")
    again = scratch.stage(tally.reply(tally.request(open_rows, prefixes), max(least, (1 << prefix_bits) // 8), False), "prefixes")
    schema = pa.schema([(f.name, f.type) for f in _DONE])

    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            for f in frames:
                for row in f.to_pylist():
                    if row["where"]:
                        yield from apply(row)

        yield from batches(schema, results(), 1024)

    def apply(row: dict) -> Iterator[tuple]:
        ids, start, stop, data, at, keys = suffixes(row)
        gone = at[(keys.answer(tally.as_dict(row["replies"])) | keys.repeated)[keys.which]]
        edge = np.zeros(len(data) + 1, np.int64)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + length, -1)
        covered = np.cumsum(edge)[:-1] > 0
        full = np.frombuffer(row["full"], bool)
        for i, s, e, whole in zip(outer_id(ids), start.tolist(), stop.tolist(), full.tolist()):
            spans = np.array([[0, e - s]]) if whole else _runs(covered[s:e])
            kept, last = hashlib.sha256(), s
            for a, b in spans.tolist():
                kept.update(data[last : s + a])
                last = s + b
            kept.update(data[last:e])
            yield i, e - s, spans.tolist(), kept.hexdigest()

    settled = rest.select(F.explode("done").alias("d")).select("d.*")
    return settled.unionByName(tally.with_replies(open_rows, again).mapInArrow(cut, _RESULT))
