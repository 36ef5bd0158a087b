"""Benchmark decontamination by greedy string tiling.

The benchmark is taken in blocks of bounded size, each a set of queries against all documents.
Word n-grams of a block's items are the seeds; where the seeds found in a document could cover
enough of an item, the two are tiled: running Karp-Rabin finds the longest matches of unmarked
words first, so passages whose parts were moved are still covered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batches, texts

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MARKS = b".,;:!?\"'()[]{}"


def words(text: bytes) -> list[bytes]:
    """Lower-case words without punctuation."""
    return text.lower().translate(None, _MARKS).split()


def hashes(items: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, items), np.uint64, len(items))


def karp_rabin(h: np.ndarray, length: int) -> np.ndarray:
    """Hash, modulo 2^64, of every `length` consecutive word hashes."""
    n = max(0, len(h) - length + 1)
    out = np.zeros(n, np.uint64)
    for j in range(length):
        out = out * _BASE + h[j : j + n]
    return out


def tile(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: (item position, document position, length).

    The search length runs from the longest possible match down to `least`, halving. Matches of
    at least that length are grown to their maximum, and the longest that does not overlap a
    marked word is marked first.
    """
    free_i, free_d, tiles = np.ones(len(item), bool), np.ones(len(doc), bool), []
    size = min(len(item), len(doc))
    while size >= least:
        grown = True
        while grown:
            grown = False
            found = []
            runs_i = np.convolve(free_i, np.ones(size, int), "valid") == size
            runs_d = np.convolve(free_d, np.ones(size, int), "valid") == size
            at_i, at_d = np.flatnonzero(runs_i), np.flatnonzero(runs_d)
            if not len(at_i) or not len(at_d):
                break
            key_i, key_d = karp_rabin(item, size)[at_i], karp_rabin(doc, size)[at_d]
            where: dict[int, list[int]] = {}
            for k, p in zip(key_i.tolist(), at_i.tolist()):
                where.setdefault(k, []).append(p)
            for k in np.flatnonzero(np.isin(key_d, key_i)).tolist():
                q = int(at_d[k])
                for p in where[int(key_d[k])]:
                    n = size
                    while p + n < len(item) and q + n < len(doc) and free_i[p + n] and free_d[q + n] and item[p + n] == doc[q + n]:
                        n += 1
                    found.append((-n, p, q))
            for n, p, q in sorted(found):
                if free_i[p : p - n].all() and free_d[q : q - n].all() and (item[p : p - n] == doc[q : q - n]).all():
                    free_i[p : p - n] = free_d[q : q - n] = False
                    tiles.append((p, q, -n))
                    grown = True
        size = least if least < size < 2 * least else size // 2
    return tiles


class Block:
    """Items of the benchmark with an index of their seeds."""

    def __init__(self, rows: list[tuple[int | None, str | None]], least: int):
        self.ids = [i for i, _ in rows]
        self.words = [hashes(words((t or "").encode())) for _, t in rows]
        self.least = least
        grams = [karp_rabin(w, least) for w in self.words]
        key = np.concatenate([*grams, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(rows)), [len(g) for g in grams])
        at = np.concatenate([*[np.arange(len(g)) for g in grams], np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.owner, self.at = key[order], owner[order], at[order]

    def matches(self, doc: np.ndarray, coverage: float) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """(item number, tiles) of the items whose words are covered at least by `coverage`."""
        grams = karp_rabin(doc, self.least)
        lo, hi = np.searchsorted(self.key, grams, "left"), np.searchsorted(self.key, grams, "right")
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            return
        n = (hi - lo)[hit]
        entry = np.arange(int(n.sum())) + np.repeat(lo[hit] - np.cumsum(n) + n, n)
        owner, at, place = self.owner[entry], self.at[entry], np.repeat(hit, n)
        for k in np.unique(owner).tolist():
            item, mine = self.words[k], owner == k
            edge = np.zeros(len(item) + 1, np.int64)
            spots = np.unique(at[mine])
            np.add.at(edge, spots, 1)
            np.add.at(edge, spots + self.least, -1)
            if (np.cumsum(edge)[:-1] > 0).sum() < coverage * len(item):
                continue  # tiles are made of seeds, so they cannot cover more
            near = np.zeros(len(doc) + 1, np.int64)
            spots = np.unique(place[mine])
            np.add.at(near, np.maximum(spots - len(item), 0), 1)
            np.add.at(near, np.minimum(spots + len(item), len(doc)), -1)
            region = np.flatnonzero(np.cumsum(near)[:-1] > 0)
            # Parts of the document that are not neighbours are kept apart by a word no item has.
            breaks = np.flatnonzero(np.diff(region) > 1) + 1
            place_of = np.insert(region, breaks, -1)
            part = np.where(place_of < 0, np.uint64(0), doc[place_of])
            tiles = [(p, int(place_of[q]), m) for p, q, m in tile(item, part, self.least)]
            if sum(m for *_, m in tiles) >= coverage * len(item):
                yield k, tiles


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The benchmark's rows in lists of about `block_bytes` of text, through an iterator."""
    held, size = [], 0
    for r in benchmark.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")).toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1] or "") + 16
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, least: int = 3, coverage: float = 0.6, block_bytes: int = 8 << 20,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """doc_id, item_id, matched_words, item_words, n_tiles per document that holds enough of an item.

    Tiles have at least `least` words; an item counts as leaked where tiles cover at least
    `coverage` of its words. Items of fewer words than `least`, null and empty texts match
    nothing; null ids are kept; repeated rows give repeated results; an empty table, or an empty
    benchmark, gives an empty result.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "matched_words", "item_words", "n_tiles")])
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = None
    for block in blocks(benchmark, item_col, item_text_col, block_bytes):
        part = rows.mapInArrow(_leaks(block, least, coverage, schema), "doc_id long, item_id long, matched_words long, item_words long, n_tiles long")
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, matched_words long, item_words long, n_tiles long") if out is None else out


def _leaks(rows: list[tuple], least: int, coverage: float, schema: pa.Schema) -> Callable:
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(rows, least)

        def found() -> Iterator[tuple]:
            for f in frames:
                for i, t in zip(f.column("doc_id").to_pylist(), texts(f)):
                    for k, tiles in block.matches(hashes(words(t)), coverage):
                        yield i, block.ids[k], sum(m for *_, m in tiles), len(block.words[k]), len(tiles)

        yield from batches(schema, found())

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: int = 3, coverage: float = 0.6, block_bytes: int = 8 << 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of `docs` that hold no leaked item; rows pass through their own task, none is shuffled."""
    out = docs
    for block in blocks(benchmark, item_col, item_text_col, block_bytes):
        out = out.mapInArrow(_clean(block, least, coverage, text_col), docs.schema)
    return out


def _clean(rows: list[tuple], least: int, coverage: float, text_col: str) -> Callable:
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(rows, least)
        for f in frames:
            keep = [next(block.matches(hashes(words(t)), coverage), None) is None for t in texts(f, text_col)]
            yield f.filter(pa.array(keep, pa.bool_()))

    return run
