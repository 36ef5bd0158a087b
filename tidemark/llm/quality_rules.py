"""Quality rules: failures of document rules are pooled by host, and bad hosts fail as a whole.

Everything here is DataFrame expressions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

#: Between words: ASCII white space only.
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A host fails where the shrunken rate of any rule exceeds this.
HOST_LIMIT = 0.5
#: Prior weight, in documents, where hosts do not differ measurably, and its least value.
PRIOR_MOST, PRIOR_LEAST = 1e6, 1.0
#: Up to this many failing hosts (about 100 bytes each) are broadcast; more are joined by a salted key.
BROADCAST_HOSTS = 100_000
SALTS = 64
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]
#: Document rules. The first two are the base rules.
RULES = {
    "few_words": lambda: F.col("n_words") < 10,
    "repeats": lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
    "symbols": lambda: 10 * F.col("n_symbols") > F.col("n_words"),
    "dup_lines": lambda: 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
    "capitals": lambda: 2 * F.col("n_upper") > F.col("word_chars"),
}
BASE = ["few_words", "repeats"]


def _repeated_starts(ranked: Column) -> Column:
    """Positions of (hash, position) pairs, sorted by hash, whose hash a neighbour shares."""
    same = lambda r, k: F.coalesce(F.get(ranked, k)["h"] == r["h"], F.lit(False))
    marked = F.transform(ranked, lambda r, k: F.when(((k > 0) & same(r, k - 1)) | same(r, k + 1), r["i"]))
    return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))


def document_metrics(docs: DataFrame, text_col: str, length: int = 5) -> DataFrame:
    """`docs` with the counts of the document rules. One projection per step: Catalyst keeps a
    column that a later step reads more than once, so each array is built once per row."""
    no_text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keep = [F.col(f"`{c}`") for c in docs.columns]
    df = docs.select(*keep, no_text.alias("_t"))
    df = df.select(
        *keep, "_t", F.filter(F.split("_t", SPACE, -1), lambda w: w != "").alias("_words"),
        F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    counts = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.translate("_t", BLANKS, "")),
        "n_symbols": F.length("_t") - F.length(F.translate("_t", SYMBOLS, "")),
        "n_upper": F.length("_t") - F.length(F.translate("_t", CAPITALS, "")),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
    }
    last = F.size("_words") - length
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.concat_ws(" ", F.slice("_words", i + 1, length))))
    named = [F.col(c) for c in counts]
    df = df.select(*keep, *[c.cast("long").alias(n) for n, c in counts.items()], hashes.alias("_hashes"))
    some = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    pairs = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.select(*keep, *named, F.when(some, pairs).alias("_ranked"))
    df = df.select(*keep, *named, _repeated_starts(F.col("_ranked")).alias("_at"))
    steps = F.transform("_at", lambda i, k: F.least(F.lit(length), F.coalesce(F.get("_at", k + 1) - i, F.lit(length))).cast("long"))
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select(*keep, *named, F.coalesce(total, F.lit(0).cast("long")).alias("n_repeat_words"))


def _prior(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """Mean and weight of each rule's beta prior by the moments of the hosts' rates: one row."""
    n = F.col("n")
    total, count = F.sum(n).alias("total"), F.count(F.lit(1)).alias("hosts")
    means = hosts.agg(total, count, *[(F.sum(f"f_{r}") / F.sum(n)).alias(r) for r in RULES]).first()
    if not means["total"]:
        return {r: (0.0, PRIOR_MOST) for r in RULES}
    spread = hosts.agg(*[(F.sum(n * F.pow(F.col(f"f_{r}") / n - F.lit(means[r]), 2)) / F.sum(n)).alias(r) for r in RULES]).first()
    out = {}
    for r in RULES:
        m = float(means[r])
        between = float(spread[r]) - m * (1 - m) * means["hosts"] / means["total"]
        weight = m * (1 - m) / between - 1 if between > 0 else PRIOR_MOST
        out[r] = (m, min(PRIOR_MOST, max(PRIOR_LEAST, weight)))
    return out


def host_table(metrics: DataFrame, scratch: Scratch) -> DataFrame:
    """Per host: documents, failures and shrunken rate of each rule, and the verdict.

    The rate is (failures + m w) / (documents + w), with the rule's mean m and prior weight w
    over all hosts. A null host is a host of its own.
    """
    failures = [F.sum(F.when(rule(), 1).otherwise(0)).alias(f"f_{r}") for r, rule in RULES.items()]
    hosts = scratch.stage(metrics.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *failures), "hosts")
    prior = _prior(hosts)
    rates = {r: (F.col(f"f_{r}") + F.lit(m * w)) / (F.col("n") + F.lit(w)) for r, (m, w) in prior.items()}
    return hosts.select("*", *[c.alias(f"rate_{r}") for r, c in rates.items()], (F.greatest(*rates.values()) > HOST_LIMIT).alias("host_failed"))


def mark_failed_hosts(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """`rows` with host_failed. Few failing hosts are broadcast, as their number is checked; else
    both sides are joined by host and salt, so that a host with a third of all rows is spread."""
    bad = hosts.where("host_failed").select(F.col("host").alias("_bad"))
    key = F.col("host").eqNullSafe(F.col("_bad"))
    if bad.count() <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(bad.select("_bad", F.lit(True).alias("_hit"))), key, "left")
    else:
        salted = bad.select("_bad", F.lit(True).alias("_hit"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
        own = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        joined = own.join(salted, key & (F.col("_salt") == F.col("_s")), "left").drop("_salt", "_s")
    return joined.withColumn("host_failed", F.coalesce("_hit", F.lit(False))).drop("_hit", "_bad")


def _verdicts(df: DataFrame) -> DataFrame:
    failed = {r: F.coalesce(rule(), F.lit(False)) for r, rule in RULES.items()}
    base, every = F.lit(False), F.lit(False)
    for r, c in failed.items():
        every = every | c
        base = base | c if r in BASE else base
    return df.withColumn("base_failed", base).withColumn("kept", ~every & ~F.col("host_failed"))


def host_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Verdicts per document, and the host table.

    Document rules: fewer than 10 words; over 20 % of words in repeated 5-word windows; over one
    symbol in ten words; over 30 % repeated lines; over half of the characters capitals. Failures
    are counted per host and rule; the rates are shrunk by an empirical beta prior; a host whose
    shrunken rate of any rule exceeds HOST_LIMIT fails. A document is kept if neither it nor its
    host fails. A null text has no words and fails; a null host is one host; repeated rows count
    each; an empty table gives empty results.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{host_col}`").cast("string").alias("host"), F.col(f"`{text_col}`").alias("_text"))
    metrics = scratch.stage(document_metrics(rows, "_text").drop("_text"), "metrics")
    hosts = host_table(metrics, scratch)
    return _verdicts(mark_failed_hosts(metrics, hosts)), hosts


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of `docs` that `host_quality` keeps, with their own columns.

    Rows and counts are written once, side by side, so that neither is computed twice and no text is
    shuffled; failing hosts come to the rows.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(
        own.alias("_row"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{host_col}`").cast("string").alias("host"), F.col(f"`{text_col}`").alias("_text")
    )
    metrics = scratch.stage(document_metrics(rows, "_text").drop("_text"), "metrics")
    hosts = host_table(metrics.drop("_row"), scratch)
    return _verdicts(mark_failed_hosts(metrics, hosts)).where("kept").select("_row.*")
