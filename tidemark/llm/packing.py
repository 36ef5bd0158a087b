"""Sequence packing as cutting stock: a linear program over length patterns, columns by knapsack.

A document's full sequences stand alone; its remainder is an item. Only the histogram of
remainder lengths, in classes of `grain` ids, reaches the driver: at most capacity / grain rows.
The program finds how often to use each pattern of classes; rounded down, patterns take
documents by rank within a class.
What rounding leaves, and patterns that would pad more than `slack`, go end to end into a
stream that is cut at every `capacity` ids, so only the last sequence of all is short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.common import Scratch, batches, texts

#: First sequence numbers of patterns and of the stream; full sequences are numbered below, by task.
PATTERN_BASE, STREAM_BASE = 1 << 61, 1 << 62
#: Rows of one class are ranked in so many parts, as one class may hold a third of all rows; more
#: where a part would average over PER_PART rows.
RANK_PARTS, PER_PART = 256, 500_000


def knapsack(profit: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best total profit within each capacity, every item any number of times, and the item taken
    last there (-1: the same as with one less). Lengths ascend."""
    best = np.zeros(capacity + 1)
    take = np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        n = upto[c]
        if n:
            got = profit[:n] + best[c - lengths[:n]]
            k = got.argmax()
            if got[k] > best[c] + 1e-12:
                best[c], take[c] = got[k], k
    return best, take


def _fill(take: np.ndarray, lengths: np.ndarray, c: int, first: int) -> np.ndarray:
    """Numbers per length of the pattern that holds item `first` and the best filling of the rest."""
    used = np.zeros(len(lengths))
    used[first] = 1
    c -= int(lengths[first])
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            used[take[c]] += 1
            c -= int(lengths[take[c]])
    return used


def times(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """a x. The driver's linear algebra keeps to plain loops of numpy: threads of a numeric library
    beside the gateway's threads were seen to wait for each other for ever."""
    return np.einsum("ij,j->i", a, x)


def inverse_of(a: np.ndarray) -> np.ndarray:
    """Inverse by Gauss-Jordan elimination with partial pivoting."""
    n = len(a)
    work = np.concatenate([a.astype(float), np.eye(n)], axis=1)
    for c in range(n):
        r = c + int(np.abs(work[c:, c]).argmax())
        if r != c:
            work[[c, r]] = work[[r, c]]
        work[c] /= work[c, c]
        factor = work[:, c].copy()
        factor[c] = 0
        work -= factor[:, None] * work[c]
    return work[:, n:]


def cutting_stock(lengths: np.ndarray, counts: np.ndarray, capacity: int, gap: float = 2e-3, columns: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one row each, numbers per length) and how often to use each, by column generation.

    Minimises the sequences that hold exactly `counts` items, as a linear program. One run of the
    dynamic program prices the best pattern around every length; the best `columns` join a pool,
    and simplex steps over the pool follow until no pool column improves. It ends when the value
    is within `gap`, or one sequence, of the bound that the last pricing proves.
    """
    m = len(lengths)
    basis = np.diag((capacity // lengths).astype(float))  # columns are patterns
    inverse = np.diag(1 / np.diag(basis))
    # Slightly different right sides keep simplex steps from standing still on ties.
    wanted = counts * (1 + 1e-4 * np.random.default_rng(m).random(m))
    x = times(inverse, wanted)
    pool = np.zeros((0, m))
    for _ in range(2 * m):
        dual = inverse.sum(axis=0)
        best, take = knapsack(np.maximum(dual, 0), lengths, capacity)
        total = x.sum()
        if best[-1] <= 1 + 1e-9 or total - total / best[-1] < max(1.0, gap * total):
            break
        around = dual + best[capacity - lengths]
        chosen = np.argsort(-around)[:columns]
        new = [_fill(take, lengths, capacity, int(k)) for k in chosen if around[k] > 1 + 1e-9]
        pool = np.unique(np.concatenate([pool, new]), axis=0)
        for _ in range(2 * m):
            price = times(pool, inverse.sum(axis=0))
            k = int(price.argmax())
            if price[k] <= 1 + 1e-6:
                break
            d = times(inverse, pool[k])
            up = d > 1e-6
            r = int(np.where(up, x / np.where(up, d, 1), np.inf).argmin())
            basis[:, r] = pool[k]
            row = inverse[r] / d[r]
            inverse -= d[:, None] * row
            inverse[r] = row
            x = np.maximum(times(inverse, wanted), 0)
        inverse = inverse_of(basis)
        pool = pool[times(pool, inverse.sum(axis=0)) > 0.8]
    return basis.T, np.maximum(times(inverse, counts.astype(float)), 0)


def slots(classes: np.ndarray, counts: np.ndarray, capacity: int, slack: float) -> list[tuple]:
    """(class, first rank, end rank, per sequence, first sequence, place): which ranks of a class go
    where. Classes and capacity are in grains; patterns that fill less than 1 - slack are left out."""
    if not len(classes):
        return []
    patterns, x = cutting_stock(classes, counts, capacity)
    total = times(patterns, classes.astype(float))
    out, rank, sequence = [], np.zeros(len(classes), np.int64), 0
    for p in np.argsort(-total, kind="stable").tolist():
        if round(total[p]) < capacity * (1 - slack):
            break
        per = np.rint(patterns[p]).astype(np.int64)
        some = np.flatnonzero(per)
        n = min(int(np.floor(x[p] + 1e-7)), *((counts - rank)[some] // per[some]).tolist())
        if n <= 0:
            continue
        place = 0
        for k in some[::-1].tolist():
            a = int(per[k])
            out.append((int(classes[k]), int(rank[k]), int(rank[k]) + n * a, a, sequence, place))
            rank[k] += n * a
            place += a
        sequence += n
    return out


SLOT = "kind long, low long, high long, per long, first long, place long"
_TOKENS = pa.schema([
    ("uid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("rest", pa.int64()), ("crc", pa.int64()), ("full", pa.list_(pa.int64())), ("base", pa.int64()), ("ids", pa.binary()),
])
PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _tokenised(docs: DataFrame, tokenizer: str, capacity: int, end: bytes) -> DataFrame:
    """Per document: numbers of ids, checksums of its full sequences and of its remainder, the remainder's ids."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = base = TaskContext.get().partitionId() << 36
        pack = zstandard.ZstdCompressor(level=1).compress
        step = 4 * capacity
        for f in frames:
            for s in range(0, f.num_rows, 256):
                part, rows = f.slice(s, 256), []
                for i, ids in zip(part.column("doc_id").to_pylist(), tokens.byte_level_ids(tokenizer, [t.decode("utf-8", "replace") for t in texts(part)])):
                    ids += end
                    n = len(ids) // 4
                    cut = len(ids) - len(ids) % step
                    full = [zlib.crc32(ids[a : a + step]) for a in range(0, cut, step)]
                    rest = ids[cut:]
                    rows.append((uid, i, n, len(rest) // 4, zlib.crc32(rest), full, base, pack(rest)))
                    uid, base = uid + 1, base + len(full)
                yield from batches(_TOKENS, iter(rows))

    return docs.mapInArrow(run, "uid long, doc_id long, n long, rest long, crc long, full array<long>, base long, ids binary")


def _running(rows: DataFrame, keys: list[str], value, name: str, parts: int) -> DataFrame:
    """`rows` with the sum of `value` over the rows before, per `keys`: windows run per part, and
    the totals of earlier parts (`parts` rows a key) are added."""
    part = F.pmod(F.xxhash64("uid"), F.lit(parts))
    rows = rows.withColumn("_part", part)
    inside = Window.partitionBy(*keys, "_part").orderBy("doc_id", "uid").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_part").agg(F.sum(value).alias("_total"))
    totals = totals.select(*keys, "_part", F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_before"))
    own = rows.select("*", F.coalesce(F.sum(value).over(inside), F.lit(0)).alias("_own"))
    return own.join(totals, [*keys, "_part"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before", "_part")


def pack_documents(
    docs: DataFrame, capacity: int = 1024, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, grain: int = 4, slack: float = 0.01,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pieces of documents in sequences of at most `capacity` ids.

    Returns doc_id, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit
    integers), doc_tokens, sequence_id and offset. Every id of every document, its end id
    included, lies in exactly one piece; offsets of a sequence run gapless from zero. A null or
    empty text is its end id alone; null ids are kept; repeated rows are documents of their own;
    ties in class are ranked by id; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    end = np.array([end_id], "<u4").tobytes()
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    made = scratch.stage(_tokenised(rows, tokenizer, capacity, end), "tokens")
    rest = made.where("rest > 0").select("uid", "doc_id", "n", "rest", "crc", F.ceil(F.col("rest") / grain).alias("class"))
    histogram = sorted(rest.groupBy("class").count().collect())  # at most capacity / grain rows
    classes, counts = (np.array([r[k] for r in histogram], np.int64) for k in (0, 1))
    parts = max(RANK_PARTS, int(counts.sum()) // PER_PART)
    plan = slots(classes, counts, capacity // grain, slack)
    # Bounded: at most one pattern per class, of classes that sum to capacity / grain at most.
    table = F.broadcast(spark.createDataFrame(plan, SLOT))
    ranked = _running(rest, ["class"], F.lit(1).cast("long"), "rank", parts)
    hit = (F.col("class") == F.col("kind")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    placed = scratch.stage(ranked.join(table, hit, "left"), "placed", rows=int(counts.sum()))
    step = F.col("rank") - F.col("low")
    numbered = placed.where("kind is not null").select(
        "doc_id", (F.col("n") - F.col("rest")).alias("start"), F.col("rest").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"),
        (F.lit(PATTERN_BASE) + F.col("first") + F.floor(step / F.col("per"))).cast("long").alias("sequence_id"), (F.col("place") + step % F.col("per")).alias("_place"),
    )
    before = Window.partitionBy("sequence_id").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)  # one sequence
    in_patterns = numbered.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("_place")
    whole = made.select("doc_id", "n", "base", F.posexplode("full").alias("k", "crc")).select(
        "doc_id", (F.col("k") * F.lit(capacity)).cast("long").alias("start"), F.lit(capacity).cast("long").alias("length"), F.col("crc").alias("ids_crc32"),
        F.col("n").alias("doc_tokens"), (F.col("base") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    loose = _running(placed.where("kind is null").select("uid", "doc_id", "n", "rest"), [], F.col("rest"), "place", parts)
    with_ids = loose.join(made.select("uid", "ids"), "uid").select("doc_id", "n", "rest", "place", "ids")
    return whole.unionByName(in_patterns).unionByName(_cut_stream(with_ids, capacity))


def _cut_stream(rows: DataFrame, capacity: int) -> DataFrame:
    """Pieces of the remainders that lie end to end at `place`."""
    schema = pa.schema([(c, pa.int64()) for c in PIECE])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple]:
            for f in frames:
                for r in f.to_pylist():
                    ids, at = zstandard.decompress(r["ids"]), 0
                    while at < r["rest"]:
                        sequence, offset = divmod(r["place"] + at, capacity)
                        n = min(r["rest"] - at, capacity - offset)
                        yield r["doc_id"], r["n"] - r["rest"] + at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), r["n"], STREAM_BASE + sequence, offset
                        at += n

        yield from batches(schema, pieces())

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in PIECE))
