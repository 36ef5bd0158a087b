"""Table of newest quotes, kept in buckets of which a batch rewrites only those it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "ticker string, as_of date, price double, quote_id long, bucket int, slot int"
MANIFEST = "bucket int, slot int, generation long, side int"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at `path`; empty where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def manifest(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """Slot in force for each bucket, from the newest generation (older than `before` if given).

    A manifest has one row a bucket, so its size is bounded by the table's bucket count.
    """
    rows = _read(spark, f"{path}/manifest", MANIFEST)
    if before is not None:
        rows = rows.where(F.col("generation") < before)
    found = rows.collect()
    top = max((r.generation for r in found), default=None)
    return {r.bucket: r.slot for r in found if r.generation == top and r.bucket >= 0}


def _in_force(spark: SparkSession, path: str, slots: dict[int, int]) -> DataFrame:
    """Rows of the given buckets' slots in force; only their folders are read."""
    want = F.lit(False)
    for slot in (0, 1):
        want = want | ((F.col("slot") == slot) & F.col("bucket").isin([b for b, s in slots.items() if s == slot]))
    return _read(spark, f"{path}/rows", ROWS).where(want)


def latest_quotes_writer(path: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """foreachBatch upsert that never goes back in date.

    Tickers are dealt to `buckets` by hash. A bucket has two slots: a batch merges its rows with the
    slot in force and writes the other one, then a one-file manifest names the slots in force. The
    manifest has two sides as well, written in turn, so a batch that is lost or repeated finds the
    generation before it in place, and two generations are kept without any deleting. Each slot
    is rewritten whole as one file, which leaves nothing to compact. Bytes written follow the
    touched buckets: choose `buckets` well above the number of tickers in a usual batch.
    `buckets` is fixed for a table's life. Rows without ticker or date are left out.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.where("ticker is not null and as_of is not null").select(
            "ticker", "as_of", F.col("price").cast("double").alias("price"), F.col("quote_id").cast("long").alias("quote_id"),
            F.pmod(F.xxhash64("ticker"), F.lit(buckets)).cast("int").alias("bucket"),
        )
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]
        slots = manifest(spark, path, batch_id)
        if touched:
            old = _in_force(spark, path, {b: slots[b] for b in touched if b in slots}).drop("slot")
            newest = rows.unionByName(old).groupBy("bucket", "ticker").agg(F.max(F.struct("as_of", "quote_id", "price")).alias("r"))
            turned = {b: 1 - slots.get(b, 1) for b in touched}
            slot = F.when(F.col("bucket").isin([b for b, s in turned.items() if s == 1]), 1).otherwise(0)
            out = newest.select("ticker", "r.as_of", "r.price", "r.quote_id", "bucket", slot.alias("slot"))
            out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "slot").parquet(f"{path}/rows")
            slots |= turned
        named = [(b, s, batch_id, batch_id % 2) for b, s in slots.items()] or [(-1, 0, batch_id, batch_id % 2)]
        spark.createDataFrame(named, MANIFEST).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("side").parquet(f"{path}/manifest")

    return write


def latest_quotes(spark: SparkSession, path: str) -> DataFrame:
    """ticker, as_of, price, quote_id in force."""
    return _in_force(spark, path, manifest(spark, path)).select("ticker", "as_of", "price", "quote_id")
