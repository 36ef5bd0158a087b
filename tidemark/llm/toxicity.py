"""Toxic language by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text. A text is cut into
short windows of whole words. Each window is compressed twice: with the ordinary dictionary, and
with the toxic dictionary set before the ordinary one. Ordinary language comes out equally long;
what only the toxic dictionary knows comes out shorter. The bytes saved, held against a threshold
calibrated on rows that trained neither dictionary, give the score of the document.

Plain dictionaries of whole toxic documents do not separate, as nearly all of their text is
ordinary. The toxic dictionary is therefore trained on the parts of toxic documents that stand
out: beginnings of words, and words, whose share of toxic documents is far above that of ordinary
ones. Their counts are one aggregation in Spark.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, slices, texts

#: Bytes after which a window ends at the next word, and bytes of the two dictionaries.
WINDOW, ORDINARY_BYTES, TOXIC_BYTES = 80, 65_536, 2_048
#: Lengths of word beginnings that are counted beside whole words, in bytes.
BEGINNINGS = (4, 5, 6)
#: A piece stands out from this share of toxic documents and this smoothed log odds on; the best
#: MOST_PIECES are taken.
LEAST_SHARE, LEAST_DOCS, LEAST_ODDS, MOST_PIECES = 0.02, 3, 3.0, 2_000
#: Sampled for the dictionaries from a document: windows of ordinary text, pieces of toxic text.
SAMPLE_WINDOWS, SAMPLE_PIECES = 8, 64
_MARKS = bytes.maketrans(b".,;:!?\"'()[]{}#*$%&|<>~^=+_/@", b" " * 29)


def _words(text: bytes) -> list[bytes]:
    return text.lower().translate(_MARKS).split()


def windows(text: bytes) -> Iterator[bytes]:
    """Whole lower-case words without marks, in windows of at least WINDOW bytes (the last may be
    shorter); a very long text is worked off in slices."""
    held, size = [], 0
    for part in slices(text):
        for w in _words(part):
            held.append(w)
            size += len(w) + 1
            if size >= WINDOW:
                yield b" %s " % b" ".join(held)
                held, size = [], 0
    if held:
        yield b" %s " % b" ".join(held)


def pieces(word: bytes) -> set[bytes]:
    return {word[:k] for k in BEGINNINGS if len(word) >= k} | {word}


def _marked(word: bytes, known: set[bytes]) -> bytes | None:
    """The longest standing-out piece of a word."""
    return max((p for p in pieces(word) if p in known), key=len, default=None)


def train(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """A dictionary of at most `size` bytes; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, sorted(samples), k=k, d=d).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(sorted(samples)))[-size:]


class Distance:
    """Bytes that the toxic dictionary saves on a window."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        # Equal parameters for both, and the toxic part first, keep the cost of ordinary matches equal.
        # The chain covers both dictionaries, as a shorter one would not reach back to the first.
        parameters = zstandard.ZstdCompressionParameters(
            window_log=17, hash_log=17, chain_log=18, search_log=6, min_match=4, target_length=64, strategy=zstandard.STRATEGY_LAZY2,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )

        def compressor(content: bytes):
            if len(content) < 8:
                return zstandard.ZstdCompressor(compression_params=parameters).compress
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(compression_params=parameters)
            return zstandard.ZstdCompressor(dict_data=shared, compression_params=parameters).compress

        self.ordinary, self.both = compressor(ordinary), compressor(toxic + ordinary)

    def saved(self, text: bytes) -> np.ndarray:
        ordinary, both = self.ordinary, self.both
        return np.fromiter((len(ordinary(w)) - len(both(w)) for w in windows(text)), np.int64)


def measures(saved: np.ndarray, threshold: float) -> tuple[float, float, float]:
    """Largest saving, mean saving a window, and saving above the threshold by the root of the windows."""
    if not len(saved):
        return 0.0, 0.0, 0.0
    return float(saved.max()), float(saved.mean()), float(np.maximum(saved - threshold, 0).sum() / np.sqrt(len(saved)))


def calibrate_threshold(largest: np.ndarray, toxic: np.ndarray) -> float:
    """The saving of a document's best window that parts toxic from ordinary documents with the
    fewest errors weighted by class; the smallest on ties."""
    if not (toxic == 1).any() or not (toxic == 0).any():
        return 1.0
    tries = np.unique(largest)
    missed = np.array([(largest[toxic == 1] < t).mean() + (largest[toxic == 0] >= t).mean() for t in tries])
    return float(tries[missed.argmin()])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (intercept last) by Newton steps on standardised columns; a small ridge keeps separable
    data finite. Rows of the rarer class weigh more, by the root of the classes' ratio. Without
    both classes, the smoothed share of the class alone."""
    n, k = x.shape
    if not 0 < y.sum() < n:
        share = (y.sum() + 0.5) / (n + 1) if n else 0.01
        return np.array([*np.zeros(k), np.log(share / (1 - share))])
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([(x - mean) / spread, np.ones(n)])
    w = np.zeros(k + 1)
    weight = np.where(y == 1, np.sqrt(max(1.0, (n - y.sum()) / y.sum())), np.sqrt(max(1.0, y.sum() / (n - y.sum()))))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.einsum("ij,j->i", z, w), -30, 30)))
        g = np.einsum("ij,i->j", z, weight * (p - y)) + ridge * w
        h = np.einsum("ij,i,ik->jk", z, weight * p * (1 - p), z) + ridge * np.eye(k + 1)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return np.array([*(w[:k] / spread), w[k] - (w[:k] * mean / spread).sum()])


def held_out(id_column: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, and the measures behind the score, per row of `docs`.

    Learns from at most `fit_rows` labelled rows that are not held out, in the order of a hash of
    the id: six tenths train the dictionaries, the rest calibrate the threshold and the logistic
    score. Several labels of an id count by the largest; a null label is none. A null or empty
    text has no windows and is scored from that; a null id is scored, not held out and has no label;
    repeated rows score alike; without labels of both classes every score is the smoothed
    share of the one class. An empty table gives an empty result. Texts are scored whole.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    given = given.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    given = given.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Ids of labels without a document must not use up the bound.
    there = given.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    sample = there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).withColumn("fold", (F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(10)) >= 6).cast("int"))
    # At most `fit_rows` rows of 16 bytes are broadcast.
    fit = scratch.stage(rows.join(F.broadcast(scratch.stage(sample, "sample")), "doc_id"), "fit")
    first = fit.where("fold = 0").select("toxic", "text")

    # 1. Which pieces stand out: documents that hold each, by class.
    sizes = {r["toxic"]: r["count"] for r in first.groupBy("toxic").count().collect()}
    n_toxic, n_other = sizes.get(1, 0), sum(n for t, n in sizes.items() if t != 1)
    counted = pa.schema([("piece", pa.binary()), ("toxic", pa.int64()), ("other", pa.int64())])

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            seen = {True: Counter(), False: Counter()}
            for label, t in zip(f.column("toxic").to_pylist(), texts(f)):
                own: set[bytes] = set()
                for part in slices(t):
                    for w in _words(part):
                        own |= pieces(w)
                seen[label == 1].update(p for p in own if len(p) >= BEGINNINGS[0])
            keys = sorted(seen[True].keys() | seen[False].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *[pa.array([seen[c][p] for p in keys], pa.int64()) for c in (True, False)]], schema=counted)

    odds = F.log((F.col("t") + 0.5) / F.lit(n_toxic + 1.0)) - F.log((F.col("o") + 0.5) / F.lit(n_other + 1.0))
    table = first.mapInArrow(count, "piece binary, toxic long, other long").groupBy("piece").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o"))
    table = table.where(F.col("t") >= F.lit(max(LEAST_DOCS, LEAST_SHARE * n_toxic))).withColumn("odds", odds).where(F.col("odds") > LEAST_ODDS)
    known = {bytes(r["piece"]) for r in table.orderBy(F.desc("odds"), F.desc("t"), "piece").limit(MOST_PIECES).select("piece").collect()}

    # 2. The dictionaries. From a document come at most 8 windows or 64 pieces, spread by hash.
    sampled = pa.schema([("toxic", pa.bool_()), ("sample", pa.binary())])

    def draw(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            out = []
            for label, t in zip(f.column("toxic").to_pylist(), texts(f)):
                if label == 1:
                    found = {m for part in slices(t) for w in _words(part) if (m := _marked(w, known))}
                    some = sorted(found, key=xxhash.xxh3_64_intdigest)[:SAMPLE_PIECES]
                    out += [(True, b" %s " % b" ".join(some))] if some else []
                else:
                    best: list[tuple[int, bytes]] = []
                    for w in windows(t):
                        best.append((xxhash.xxh3_64_intdigest(w), w))
                        if len(best) >= 1024:
                            best = sorted(best)[:SAMPLE_WINDOWS]
                    out += [(False, w) for _, w in sorted(best)[:SAMPLE_WINDOWS]]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.bool_()), pa.array([x for _, x in out], pa.binary())], schema=sampled)

    drawn = first.mapInArrow(draw, "toxic boolean, sample binary").collect()
    ordinary = train([bytes(r["sample"]) for r in drawn if not r["toxic"]], ORDINARY_BYTES, 200, 8)
    trained = train([bytes(r["sample"]) for r in drawn if r["toxic"]], TOXIC_BYTES, 32, 6)
    toxic = trained + b" %s " % b" ".join(sorted(known)) if known else b""
    sent = spark.sparkContext.broadcast((ordinary, toxic))  # two dictionaries and at most MOST_PIECES pieces

    # 3. Threshold and score from the other rows: three numbers a row.
    def savings(threshold: float | None):
        schema = pa.schema([("key", pa.int64()), *[(c, pa.float64()) for c in ("largest", "mean", "over")]])

        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            distance = Distance(*sent.value)
            for f in frames:
                got = [measures(distance.saved(t), threshold) for t in texts(f)]
                yield pa.RecordBatch.from_arrays([f.column(0).cast(pa.int64()), *[pa.array([g[k] for g in got], pa.float64()) for k in range(3)]], schema=schema)

        return run, "key long, largest double, mean double, over double"

    second = fit.where("fold = 1").select("toxic", "text")
    run, schema = savings(0.0)
    largest = second.mapInArrow(run, schema).select("key", "largest").collect()
    threshold = calibrate_threshold(np.array([r["largest"] for r in largest]), np.array([int(r["key"] == 1) for r in largest]))
    run, schema = savings(threshold)
    seen = second.mapInArrow(run, schema).collect()
    weights = fit_logistic(np.array([[r["largest"], r["mean"], r["over"]] for r in seen]).reshape(-1, 3), np.array([float(r["key"] == 1) for r in seen]))

    # 4. All documents.
    z = F.lit(float(weights[3])) + sum(F.col(c) * F.lit(float(w)) for c, w in zip(("largest", "mean", "over"), weights))
    out = rows.mapInArrow(run, schema).withColumn("score", F.round(1 / (1 + F.exp(-F.least(F.lit(30.0), F.greatest(F.lit(-30.0), z)))), 6))
    return out.select(
        F.col("key").alias("doc_id"), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.col("largest").alias("largest_saving"), F.col("mean").alias("mean_saving"), F.col("over").alias("saving_over_threshold"),
    )
