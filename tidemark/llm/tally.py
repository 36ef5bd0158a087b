"""Which keys of a chunk occur elsewhere: keys go to hash buckets, one bit per key comes back.

A chunk sends each distinct key once, whatever its number of occurrences, so a passage that a
third of all documents share adds one entry per chunk to its bucket, not one per document.
Keys are dealt to buckets by one hash and told apart inside a bucket by another; the number
of buckets grows with the corpus, so the load of a bucket and the effective key length do not
depend on its size. The answer is in the order of the keys sent: the chunk computes its keys
again and applies the bits, so no positions are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batches

REQUEST = "bucket long, chunk long, n long, keys binary, owners binary"
_REQUEST = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("owners", pa.binary())])
REPLY = "chunk long, bucket long, bits binary"
_REPLY = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())])
#: A bucket is processed when its task has gathered all of it; about this many entries each.
PER_BUCKET = 1_000_000


def bucket_bits(entries: int) -> int:
    """log2 of the number of buckets; 8 at least."""
    return max(8, int(np.ceil(np.log2(max(1, entries) / PER_BUCKET + 1e-9))))


class Keys:
    """Distinct keys of a chunk, in bucket order.

    `first` is the position of each key's first occurrence, `which` the key of each position.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, bits: int, width: int):
        self.width = width
        bucket = (high >> np.uint64(64 - bits)).astype(np.int64)
        key = low & np.uint64((1 << (8 * width)) - 1)
        order = np.lexsort((key, bucket)) if len(key) else np.zeros(0, np.int64)
        k, b = key[order], bucket[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1])
        group = np.cumsum(new) - 1
        self.key, self.bucket = k[new], b[new]
        self.first = order[new]
        self.which = np.empty(len(k), np.int64)
        self.which[order] = group

    @property
    def repeated(self) -> np.ndarray:
        return np.bincount(self.which, minlength=len(self.key)) > 1

    def spans(self) -> Iterator[tuple[int, int, int]]:
        if len(self.bucket):
            cuts = np.flatnonzero(np.diff(self.bucket)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(self.bucket)]):
                yield int(self.bucket[s]), s, e

    def requests(self, chunk: int, owner: np.ndarray | None) -> Iterator[tuple]:
        raw = self.key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : self.width]
        pack = zstandard.ZstdCompressor(level=1).compress
        for b, s, e in self.spans():
            owners = None if owner is None else pack(np.diff(owner[s:e], prepend=np.int64(0)).tobytes())
            yield b, chunk, e - s, raw[s:e].tobytes(), owners

    def answer(self, replies: dict[int, bytes]) -> np.ndarray:
        """Per key, the bit its bucket sent back."""
        out = np.zeros(len(self.key), bool)
        for b, s, e in self.spans():
            if b in replies:
                out[s:e] = np.unpackbits(np.frombuffer(replies[b], np.uint8), count=e - s).astype(bool)
        return out


def request(chunks: DataFrame, make: Callable[[dict], Iterator[tuple]]) -> DataFrame:
    """`make` gets a chunk row as a dict and yields request tuples."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(_REQUEST, (r for f in frames for row in f.to_pylist() for r in make(row)), 256)

    return chunks.mapInArrow(run, REQUEST)


def _bits(rows: list[dict], smaller_owner: bool) -> Iterator[tuple]:
    width = len(rows[0]["keys"]) // rows[0]["n"]
    n = np.array([r["n"] for r in rows])
    raw = np.zeros((int(n.sum()), 8), np.uint8)
    raw[:, :width] = np.frombuffer(b"".join(r["keys"] for r in rows), np.uint8).reshape(-1, width)
    key = raw.view("<u8").ravel()
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    starts = np.flatnonzero(new)
    size = np.diff(np.append(starts, len(key)))
    if smaller_owner:
        owner = np.concatenate([np.cumsum(np.frombuffer(zstandard.decompress(r["owners"]), np.int64)) for r in rows])[order]
        hit = owner > np.repeat(np.minimum.reduceat(owner, starts), size)
    else:
        hit = np.repeat(size > 1, size)
    flag = np.zeros(len(key), bool)
    flag[order] = hit
    at = 0
    for r in rows:
        mine = flag[at : at + r["n"]]
        at += r["n"]
        if mine.any():
            yield r["chunk"], r["bucket"], np.packbits(mine).tobytes()


def reply(requests: DataFrame, parts: int, smaller_owner: bool) -> DataFrame:
    """One row per chunk: the replies of its buckets that have any bit set.

    A bit is set where the key also occurs in another chunk or, with `smaller_owner`, where
    some entry of the key has a smaller owner.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[list[dict]]:
            held: list[dict] = []
            for f in frames:
                for row in f.to_pylist():
                    if held and held[0]["bucket"] != row["bucket"]:
                        yield held
                        held = []
                    held.append(row)
            if held:
                yield held

        yield from batches(_REPLY, (r for g in groups() for r in _bits(g, smaller_owner)), 1024)

    return (
        requests.repartition(parts, "bucket").sortWithinPartitions("bucket")
        .mapInArrow(run, REPLY)
        .groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("replies"))
    )


def with_replies(chunks: DataFrame, replies: DataFrame) -> DataFrame:
    """Chunk rows beside their replies; the replies are the built side, the texts are not sorted."""
    return chunks.join(replies.hint("shuffle_hash"), "chunk", "left")


def as_dict(replies: list[dict] | None) -> dict[int, bytes]:
    return {r["bucket"]: r["bits"] for r in replies or []}
