"""Keyed helpers that stay safe when one key holds a large share of all rows.

A window over a bare key puts the whole key in one task. The helpers here window over
(key, bucket) and carry a one-row-per-bucket summary across buckets, so the largest task
is one bucket of one key; the carried table has one row per key and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise to the checkpoint directory named by the cluster."""
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def keep_latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the greatest by `order`; map-side combined, no window."""
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    row = F.struct(*[F.col(c) for c in df.columns])
    return (
        df.groupBy(*keys)
        .agg(F.max_by(row, rank).alias("_row"))
        .select("_row.*")
    )


def split_lag(
    df: DataFrame, keys: list[str], bucket: str, order: list[str], values: dict[str, str]
) -> DataFrame:
    """lag(1) of `values` (output name -> column) per key, windowed per (key, bucket).

    `bucket` must be a non-decreasing function of the first order column. Also adds
    `_first`, true on the first row of a key.
    """
    payload = F.struct(*[F.col(src).alias(out) for out, src in values.items()])
    rows = df.withColumn("_payload", payload)
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(bucket)
    tails = (
        rows.groupBy(*keys, bucket)
        .agg(F.max_by("_payload", F.struct(*order)).alias("_tail"))
        .withColumn("_carry", F.lag("_tail").over(across))
        .drop("_tail")
    )
    out = rows.withColumn("_prev", F.lag("_payload").over(inside)).join(tails, [*keys, bucket])
    out = out.withColumn("_prev", F.coalesce("_prev", "_carry"))
    for name in values:
        out = out.withColumn(name, F.col("_prev")[name])
    return out.withColumn("_first", F.col("_prev").isNull()).drop("_payload", "_prev", "_carry")


_FOLDS = {"sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)), "min": (F.min, F.least), "max": (F.max, F.greatest)}


def running(df: DataFrame, keys: list[str], bucket: str, order: list[str], folds: dict[str, tuple[str, str]]) -> DataFrame:
    """Running sum / min / max per key up to and including each row.

    `folds` maps output name -> (fold, input column). Windows run per (key, bucket); totals of
    earlier buckets are carried from a table with one row per key and bucket.
    """
    upto = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, bucket).agg(*[_FOLDS[f][0](c).alias(f"_b_{n}") for n, (f, c) in folds.items()])
    carried = totals.select(
        *keys, bucket, *[_FOLDS[f][0](f"_b_{n}").over(before).alias(f"_c_{n}") for n, (f, _) in folds.items()]
    )
    rows = df.select("*", *[_FOLDS[f][0](c).over(upto).alias(f"_i_{n}") for n, (f, c) in folds.items()])
    keep = [c for c in df.columns if c not in folds]
    return rows.join(carried, [*keys, bucket]).select(
        *keep, *[_FOLDS[f][1](F.col(f"_i_{n}"), F.col(f"_c_{n}")).alias(n) for n, (f, _) in folds.items()]
    )


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: dict[str, float], bins: int = 1024) -> DataFrame:
    """Element int((n - 1) * q) of the sorted values of each key, without interpolation.

    Values are counted per equal-width bin; only the bin that holds the wanted rank is ordered,
    and equal values are merged first, so no key is ever sorted or collected as a whole.
    """
    span = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"))
    wanted = span.select(
        *keys, "_lo", "_hi",
        F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.floor((F.col("_n") - 1) * q).alias("rank")) for k, q in ranks.items()])).alias("_w"),
    ).select(*keys, F.col("_w.name").alias("_name"), F.col("_w.rank").alias("_rank"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    number = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)
    counts = (
        df.where(F.col(value).isNotNull()).join(span.drop("_n"), keys)
        .withColumn("_bin", number).groupBy(*keys, "_bin", value).agg(F.count(F.lit(1)).alias("_c"))
    )
    per_bin = counts.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_bc"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    per_bin = per_bin.withColumn("_start", F.coalesce(F.sum("_bc").over(before), F.lit(0)))
    hit = per_bin.join(wanted, keys).where((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_start") + F.col("_bc")))
    inner = Window.partitionBy(*keys, "_bin", "_name").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    found = (
        counts.join(hit, [*keys, "_bin"])
        .withColumn("_upto", F.col("_start") + F.sum("_c").over(inner))
        .where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c")))
    )
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == k, F.col(value))).alias(k) for k in ranks])


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_ts: str,
    right_ts: str,
    values: list[str],
    strict: bool = True,
    bucket_unit: str = "month",
) -> DataFrame:
    """Latest right row with right_ts < left_ts (or <= when not strict), per key.

    Both sides are tagged and united, windowed per (key, time bucket); what earlier buckets
    end with is carried forward. Left columns are kept; unmatched left rows get NULLs.
    Right rows with equal time are ordered by their values, so the result is fixed.
    """
    lcols = left.columns
    bucket = lambda c: F.date_trunc(bucket_unit, F.col(c).cast("timestamp"))
    payload = F.struct(*[F.col(v) for v in values])
    lhs = left.select(
        *keys, F.col(left_ts).cast("timestamp").alias("_ts"), bucket(left_ts).alias("_bucket"),
        F.lit(0 if strict else 1).alias("_side"), F.struct(*lcols).alias("_left"),
    )
    rhs = right.select(
        *keys, F.col(right_ts).cast("timestamp").alias("_ts"), bucket(right_ts).alias("_bucket"),
        F.lit(1 if strict else 0).alias("_side"), payload.alias("_right"),
    )
    tails = (
        rhs.groupBy(*keys, "_bucket").agg(F.max(F.struct("_ts", "_right")).alias("_tail"))
    )
    both = lhs.unionByName(rhs, allowMissingColumns=True)
    inside = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy("_ts", "_side", "_right")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    found = both.withColumn("_hit", F.last("_right", ignorenulls=True).over(inside)).where(
        F.col("_left").isNotNull()
    )
    # What the buckets before hold: the same carry over the (key, bucket) summary rows.
    marks = lhs.select(*keys, "_bucket").distinct()
    carry_w = (
        Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        marks.join(tails, [*keys, "_bucket"], "full_outer")
        .withColumn("_carry", F.last(F.col("_tail")["_right"], ignorenulls=True).over(carry_w))
        .drop("_tail")
    )
    out = found.join(carried, [*keys, "_bucket"], "left").withColumn(
        "_hit", F.coalesce("_hit", "_carry")
    )
    return out.select("_left.*", *[F.col("_hit")[v].alias(v) for v in values])


def violations(df: DataFrame, rule: str, bad: Column, key: Column, detail: Column) -> DataFrame:
    """Rows breaking one rule, in the common (rule, key, detail) shape."""
    return df.where(F.coalesce(bad, F.lit(False))).select(
        F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail")
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
