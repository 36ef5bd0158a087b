"""Quality and toxicity from weak labels.

Heuristic labellers vote on every document, or abstain. Expectation-maximisation over the counts
of all vote patterns estimates how each labeller behaves on good and on bad documents; the
posterior of a document's pattern is its label. Those labels train a linear scorer on hashed
words, which scores every document. Two such models are built: poor quality and toxic language.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, texts

BITS = 18
ABSTAIN, GOOD, BAD = 0, 1, 2
#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    b"the of and to in is that it for on with as was are be this from at or an by a der die das und in den von zu mit sich des auf ein eine ist im dem nicht als "
    b"le la les de des et en un une du que est pour dans par sur au avec il el los las y del se por con para su al lo como".split()
)
INSULTS = frozenset(b"idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown clowns filth vermin jerk fool fools imbecile".split())
_MARKS = bytes.maketrans(b".,;:!?\"'()[]{}#*$%&|<>~^=+_/@", b" " * 29)
#: Beginnings of words, in bytes, that are features beside the words: stems of words not seen in the fit.
PREFIXES = (5,)
QUALITY = ["symbols", "variety", "capitals", "length", "function_words", "dup_lines", "echo", "given"]
TOXIC = ["insults", "learned", "given"]


def describe(text: bytes) -> tuple[np.ndarray, list[int], bool]:
    """Hashed features (distinct, ascending; words and shape in the lower half, stems in the upper), votes of the text's own quality labellers, and whether an insult occurs."""
    raw = text.split()
    n = len(raw)
    plain = text.lower().translate(_MARKS).split()
    distinct = set(plain)
    letters = sum(map(len, raw))
    symbols = sum(text.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")) / max(1, n)
    capitals = (letters - len(b"".join(raw).translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / max(1, letters)
    variety = len(distinct) / max(1, len(plain))
    common = sum(map(FUNCTION_WORDS.__contains__, plain)) / max(1, len(plain))
    echo = sum(map(eq, raw, raw[1:])) / max(1, n)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 1 - len(set(lines)) / max(1, len(lines))

    def vote(bad: bool, good: bool) -> int:
        return BAD if bad else GOOD if good else ABSTAIN

    votes = [
        vote(symbols > 0.1, symbols < 0.01), vote(n >= 20 and variety < 0.3 / (1 + n / 2000), variety > 0.5), vote(capitals > 0.5, capitals < 0.2),
        vote(n < 10, n >= 50), vote(n >= 10 and common < 0.02, common > 0.08), vote(len(lines) > 3 and repeated > 0.3, repeated < 0.05),
        vote(echo > 0.2, echo < 0.05),
    ]
    shape = [b"\0%s%d" % (name, int(min(20, v * 20))) for name, v in ((b"s", symbols), (b"c", capitals), (b"v", variety), (b"f", common), (b"r", repeated))]
    insult = not INSULTS.isdisjoint(distinct)
    shape += [b"\0n%d" % n.bit_length(), b"\0i%d" % insult, *[b"\0v%d%d" % v for v in enumerate(votes)]]
    stems = {w[:k] for k in PREFIXES for w in distinct if len(w) > k}
    half = (1 << (BITS - 1)) - 1
    found = [xxhash.xxh3_64_intdigest(w) & half for w in [*distinct, *shape]] + [(xxhash.xxh3_64_intdigest(w) & half) + half + 1 for w in stems]
    return np.unique(np.array(found, np.int64)), votes, insult


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, prior: float, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of the bad class per vote pattern, and each labeller's vote probabilities by class.

    `votes` has a row per distinct pattern (labellers in columns), `counts` how many documents
    show it. Starts from labellers that rarely accuse a good document and each know some kinds of
    bad ones, which fixes the classes' names.
    """
    k = votes.shape[1]
    table = np.full((2, k, 3), 1 / 3)  # class, labeller, vote
    table[0] = [0.39, 0.6, 0.01]  # abstain, good, bad
    table[1] = [0.25, 0.45, 0.3]
    posterior = np.full(len(votes), prior)
    for _ in range(rounds):
        log = np.array([np.log(table[c, np.arange(k), votes]).sum(axis=1) for c in (0, 1)]).reshape(2, -1)
        odds = log[1] - log[0] + np.log(prior / (1 - prior))
        after = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        done = np.abs(after - posterior).max(initial=0) < 1e-6
        posterior = after
        weight = np.array([counts * (1 - posterior), counts * posterior])
        prior = float(np.clip(weight[1].sum() / max(1, counts.sum()), 1e-4, 0.5))
        for c in (0, 1):
            for v in (ABSTAIN, GOOD, BAD):
                table[c, :, v] = (weight[c] @ (votes == v) + 0.5) / (weight[c].sum() + 1.5)
        if done:
            break
    return posterior, table


def fit_linear(
    features: list[np.ndarray], target: np.ndarray, epochs: int = 60, rate: float = 0.5, decay: float = 3e-4, rows: int = 5,
) -> tuple[np.ndarray, float]:
    """Logistic regression on presence features by AdaGrad over mini-batches, in a fixed order.

    Features that fewer than `rows` rows show stay at zero.
    """
    shown = np.bincount(np.concatenate([*features, np.zeros(0, np.int64)]).astype(np.int64), minlength=1 << BITS) >= rows
    features = [f[shown[f]] for f in features]
    weight, seen, bias, bias_seen = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6), 0.0, 1e-6
    order = np.random.default_rng(7).permutation(len(features))
    size = 256
    for _ in range(epochs):
        for s in range(0, len(order), size):
            part = order[s : s + size]
            flat = np.concatenate([features[i] for i in part])
            of = np.repeat(np.arange(len(part)), [len(features[i]) for i in part])
            z = np.bincount(of, weight[flat], minlength=len(part)) + bias
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[part]) / len(part)
            used, where = np.unique(flat, return_inverse=True)
            gradient = np.bincount(where, error[of]) + decay * weight[used]
            seen[used] += gradient**2
            weight[used] -= rate * gradient / np.sqrt(seen[used])
            bias_seen += error.sum() ** 2
            bias -= rate * error.sum() / np.sqrt(bias_seen)
    return weight.astype(np.float32), float(bias)


def _learned(features: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Features whose smoothed log odds among labelled rows speak for toxic language."""
    if not (toxic == 1).any():
        return np.zeros(0, np.int64)
    n = [int((toxic == c).sum()) for c in (0, 1)]
    count = [np.bincount(np.concatenate([f for f, t in zip(features, toxic) if t == c] or [np.zeros(0, np.int64)]), minlength=1 << BITS) for c in (0, 1)]
    odds = np.log((count[1] + 0.5) / (n[1] + 1)) - np.log((count[0] + 0.5) / (n[0] + 1))
    return np.flatnonzero((odds > 3) & (count[1] >= 5))


def score(
    docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, bad_score, toxic_score and kept (both below one half) per row of `docs`.

    `labels` (doc_id, quality, toxic) is one more labeller, which abstains where it has no row or
    a null; several rows of an id count by their smallest quality and largest toxicity. The
    pattern counts cover all documents. The linear scorers are fitted on at most `fit_rows` rows,
    those with a label first, in the order of a hash of the id; only these reach the driver. A
    null or empty text counts as a short one; null ids have no label; repeated rows get equal
    scores; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "weak-labels")
    given = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).where("doc_id is not null")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    # 1. A bounded sample for the fits.
    marked = rows.select("doc_id").join(given, "doc_id", "left")
    sample = marked.orderBy(F.col("quality").isNull() & F.col("toxic").isNull(), F.xxhash64("doc_id"), "doc_id").limit(fit_rows).dropDuplicates(["doc_id"])
    sample = scratch.stage(sample, "sample")
    schema = pa.schema([("quality", pa.int64()), ("toxic", pa.int64()), ("features", pa.binary()), ("votes", pa.binary()), ("insult", pa.bool_())])

    def gather(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            got = [describe(t) for t in texts(f)]
            yield pa.RecordBatch.from_arrays([
                f.column("quality").cast(pa.int64()), f.column("toxic").cast(pa.int64()), pa.array([x.astype("<i4").tobytes() for x, _, _ in got], pa.binary()),
                pa.array([bytes(v) for _, v, _ in got], pa.binary()), pa.array([i for *_, i in got], pa.bool_()),
            ], schema=schema)

    # At most `fit_rows` ids of 20 bytes each are broadcast.
    taken = rows.join(F.broadcast(sample), F.col("text").isNotNull() & rows["doc_id"].eqNullSafe(sample["doc_id"])).select("quality", "toxic", "text")
    fit = taken.mapInArrow(gather, "quality long, toxic long, features binary, votes binary, insult boolean").limit(2 * fit_rows).collect()
    features = [np.frombuffer(r["features"], "<i4").astype(np.int64) for r in fit]
    given_bad = np.array([ABSTAIN if r["quality"] is None else BAD if r["quality"] == 0 else GOOD for r in fit])
    given_toxic = np.array([ABSTAIN if r["toxic"] is None else BAD if r["toxic"] == 1 else GOOD for r in fit])
    learned = _learned([f for f, t in zip(features, given_toxic) if t], given_toxic[given_toxic > 0] - 1) if len(fit) else np.zeros(0, np.int64)

    # 2. Votes of all documents, counted by pattern.
    voted = pa.schema([("doc_id", pa.int64()), ("pattern", pa.binary())])

    def ballot(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            out = []
            for t in texts(f):
                x, v, insult = describe(t)
                out.append(bytes([*v, BAD if insult else GOOD, BAD if np.isin(x, learned, assume_unique=True).any() else GOOD]))
            yield pa.RecordBatch.from_arrays([f.column("doc_id"), pa.array(out, pa.binary())], schema=voted)

    every = rows.mapInArrow(ballot, "doc_id long, pattern binary").join(given, "doc_id", "left")
    patterns = every.groupBy("pattern", "quality", "toxic").count().collect()  # at most 3 to the number of labellers
    own = len(QUALITY) - 1
    counts = np.array([r["count"] for r in patterns], float)
    quality = np.array([[*r["pattern"][:own], ABSTAIN if r["quality"] is None else BAD if r["quality"] == 0 else GOOD] for r in patterns], np.int64).reshape(-1, len(QUALITY))
    toxic = np.array([[*r["pattern"][own:], ABSTAIN if r["toxic"] is None else BAD if r["toxic"] == 1 else GOOD] for r in patterns], np.int64).reshape(-1, len(TOXIC))
    models = []
    fit_quality = np.array([[*r["votes"], g] for r, g in zip(fit, given_bad)], np.int64).reshape(-1, len(QUALITY))
    fit_toxic = np.array([[BAD if r["insult"] else GOOD, BAD if np.isin(f, learned).any() else GOOD, g] for r, f, g in zip(fit, features, given_toxic)], np.int64).reshape(-1, len(TOXIC))
    for votes, mine in ((quality, fit_quality), (toxic, fit_toxic)):
        posterior, _ = expectation_maximisation(votes, counts, 0.15)
        by_pattern = {tuple(v): p for v, p in zip(votes.tolist(), posterior.tolist())}
        target = np.array([by_pattern.get(tuple(v), 0.5) for v in mine.tolist()])
        # Poor quality shows in shape and words; toxic words also in stems.
        models.append(fit_linear(features if votes is toxic else [f[f < 1 << (BITS - 1)] for f in features], target))

    # 3. The scorers on all documents. Two weight vectors of 2^18 floats are sent to the executors.
    sent = spark.sparkContext.broadcast(models)
    result = pa.schema([("doc_id", pa.int64()), ("bad_score", pa.float64()), ("toxic_score", pa.float64()), ("kept", pa.bool_())])

    def judge(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            z = np.array([[w[x].sum() + b for w, b in sent.value] for x in (describe(t)[0] for t in texts(f))], float).reshape(-1, 2)
            p = np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6)
            yield pa.RecordBatch.from_arrays([f.column("doc_id"), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array((p < 0.5).all(axis=1))], schema=result)

    return rows.mapInArrow(judge, "doc_id long, bad_score double, toxic_score double, kept boolean")
