"""Merges and guarded writes. Nothing here overwrites good data with less."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import SHRINK_FLOOR
from tidemark.functions.hashing import record_hash
from tidemark.functions.scoring import positive, safe_div

TICKER = r"^[A-Z0-9.^=-]{1,20}$"


def new_snapshots(history: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Rows of dates the history does not hold yet."""
    return snapshot.join(history.select("as_of").distinct(), "as_of", "left_anti")


def append_history(history: DataFrame, snapshot: DataFrame, path: str) -> None:
    new_snapshots(history, snapshot).write.mode("append").partitionBy("as_of").parquet(path)


def artifact_id(result: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One content hash per date: row hashes added up, so no group is gathered or sorted."""
    row = F.xxhash64(record_hash(*[F.col(c) for c in [*keys, *columns]])).cast("decimal(38,0)")
    return result.groupBy("as_of").agg(F.sha2(F.concat_ws("|", F.sum(row).cast("string"), F.count(F.lit(1)).cast("string")), 256).alias("artifact"))


def may_replace(previous: DataFrame, candidate: DataFrame, value: str) -> DataFrame:
    """One row: may the latest view move on. Never back in date, never to lower coverage."""
    head = lambda df, p: df.agg(F.max("as_of").alias(p + "as_of"), F.count(F.col(value)).alias(p + "n"))
    both = head(previous, "a_").join(head(candidate, "b_"))  # two single rows
    older = F.coalesce(F.col("b_as_of") < F.col("a_as_of"), F.lit(False))
    worse = (F.col("a_n") > 0) & ((F.col("b_n") == 0) | ((F.col("a_as_of") == F.col("b_as_of")) & (F.col("b_n") < F.col("a_n"))))
    return both.select((~older & ~worse).alias("replace"), F.col("a_n").alias("previous_n"), F.col("b_n").alias("candidate_n"))


def save_observation(previous: DataFrame | None, candidate: DataFrame, value: str, root: str) -> bool:
    """Write the immutable artifact of each date, then the latest view if it may move on."""
    columns = [c for c in candidate.columns if c != "as_of"]
    tagged = candidate.join(artifact_id(candidate, ["as_of"], columns), "as_of")
    tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("as_of", "artifact").parquet(f"{root}/observations")
    if previous is not None and not may_replace(previous, candidate, value).first()["replace"]:
        return False
    candidate.write.mode("overwrite").parquet(f"{root}/latest")
    return True


def merge_quotes(universe: DataFrame, previous: DataFrame, fresh: DataFrame, failures: DataFrame) -> DataFrame:
    """Per ticker the fresh quote if not older, else the old one marked stale, else missing."""
    cols = ("as_of", "price", "quality")
    side = lambda df, p: df.select("ticker", *[F.col(c).alias(p + c) for c in cols])
    rows = universe.select("ticker").join(side(previous, "o_"), "ticker", "left").join(side(fresh, "n_"), "ticker", "left").join(
        failures.select("ticker", "reason"), "ticker", "left"
    )
    has_old, has_new = F.col("o_quality").isNotNull(), F.col("n_as_of").isNotNull()
    use_new = has_new & (~has_old | F.coalesce(F.col("n_as_of") >= F.col("o_as_of"), F.lit(True)))
    pick = lambda c: F.when(use_new, F.col("n_" + c)).when(has_old, F.col("o_" + c))
    return rows.select(
        "ticker", pick("as_of").alias("as_of"), pick("price").alias("price"),
        F.when(use_new, F.col("n_quality")).when(has_old, "stale").otherwise("missing").alias("quality"),
        F.when(~use_new & has_old, F.coalesce("reason", F.lit("not_refreshed"))).when(~use_new, F.coalesce("reason", F.lit("not_available"))).alias("failure"),
    )


def quote_coverage(quotes: DataFrame) -> DataFrame:
    return quotes.agg(F.count(F.when(F.col("quality") == "ok", 1)).alias("ok"), F.count(F.lit(1)).alias("total"))


def merge_price_archive(archive: DataFrame, snapshots: DataFrame, today: Column, limit: int | None = None) -> DataFrame:
    """Upsert reported closes by (ticker, date); the highest `version` wins; the archive's currency is kept.

    archive: ticker, date, close, currency. snapshots: version, ticker, as_of, price, currency,
    quality. All dates are kept, or the newest `limit` of each ticker if that is given.
    """
    good = snapshots.where(
        F.col("ticker").rlike(TICKER) & (F.col("quality") == "ok") & (F.col("as_of") < today) & positive(F.col("price")) & F.col("currency").isin("USD", "JPY")
    ).select("ticker", F.col("as_of").alias("date"), F.col("price").alias("close"), "currency", F.col("version").cast("long").alias("version"))
    both = archive.select("ticker", "date", "close", "currency", F.lit(-1).cast("long").alias("version")).unionByName(good)
    home = both.groupBy("ticker").agg(F.min_by("currency", F.struct("version", "date", "currency")).alias("_home"))
    kept = both.join(home, "ticker").where(F.col("currency") == F.col("_home"))
    rows = kept.groupBy("ticker", "date").agg(F.max_by(F.struct("close", "currency"), F.struct("version", "close")).alias("r")).select("ticker", "date", "r.*")
    if limit is None:
        return rows
    # One row per ticker and day is left: a ticker's window is bounded by its days.
    w = Window.partitionBy("ticker").orderBy(F.desc("date"))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def replay_snapshots(snapshots: DataFrame, today: Column, limit: int | None = None) -> DataFrame:
    """Rebuild the archive from the ordered series of past snapshots in one pass: last writer wins."""
    empty = snapshots.select("ticker", F.col("as_of").alias("date"), F.col("price").alias("close"), "currency").limit(0)
    return merge_price_archive(empty, snapshots, today, limit)


def shrink_guard(old: DataFrame, new: DataFrame, floor: float = SHRINK_FLOOR) -> DataFrame:
    """One row: is the new reference table large enough to replace the old one."""
    sizes = old.agg(F.count(F.lit(1)).alias("old_n")).join(new.agg(F.count(F.lit(1)).alias("new_n")))  # two single rows
    return sizes.withColumn("accepted", F.coalesce(safe_div(F.col("new_n"), F.col("old_n")) >= floor, F.lit(True)))
