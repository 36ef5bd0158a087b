"""Flow-adjusted results between valuations, per account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scoring import safe_div
from tidemark.functions.validity import end_of_japan_day, japan_date, start_of_japan_day
from tidemark.operators.keyed import asof_join, split_lag

VALID_STATUS = ("recorded", "closed")
COMPONENTS = ("price", "fx", "realized", "other")


def boundary(date: Column, ts: Column) -> Column:
    """Moment a valuation holds at: its time, or the end of its Japan accounting day."""
    return F.coalesce(ts, end_of_japan_day(date))


def event_position(date: Column, ts: Column, left: Column, right: Column) -> Column:
    """inside, outside or ambiguous for an event against the interval (left, right]."""
    lo, hi = F.coalesce(ts, start_of_japan_day(date)), F.coalesce(ts, end_of_japan_day(date))
    return (
        F.when((hi <= left) | (lo > right), "outside").when((lo > left) & (hi <= right), "inside").otherwise("ambiguous")
    )


def valuation_intervals(snapshots: DataFrame) -> DataFrame:
    """Each valid valuation with the valid one before it (NULL on an account's first)."""
    rows = snapshots.where(F.col("status").isin(*VALID_STATUS)).withColumn("right", boundary(F.col("date"), F.col("ts")))
    rows = rows.withColumn("_bucket", F.trunc(F.to_date("right"), "year"))
    prev = {"left": "right", "prev_date": "date", "prev_assets": "assets_jpy"}
    return split_lag(rows, ["account_id"], "_bucket", ["right"], prev).drop("_bucket", "_first")


def interval_flows(
    intervals: DataFrame, flows: DataFrame, quality: DataFrame | None = None, keys: tuple[str, ...] = ("account_id",)
) -> DataFrame:
    """Net and count of events per (keys, left, right); NULL when unsure.

    Intervals of one key must not overlap. An event lies in the interval that began last
    before it (one as-of join); a date-only event is also ambiguous for every interval that
    begins inside its own Japan day (one equality join on that day). Work is linear in events.
    """
    k = list(keys)
    spans = intervals.where(F.col("left").isNotNull()).select(*k, "left", "right")
    ev = flows.select(
        *k, "date", "amount_jpy", F.col("ts").isNull().alias("_date_only"),
        F.coalesce("ts", start_of_japan_day(F.col("date"))).alias("lo"),
        F.coalesce("ts", end_of_japan_day(F.col("date"))).alias("hi"),
    )
    hit = asof_join(ev, spans, k, "lo", "left", ["left", "right"], strict=True, bucket_unit="month")
    hit = hit.where(F.col("lo") <= F.col("right")).select(
        *k, "left", "amount_jpy", (F.col("hi") <= F.col("right")).alias("_inside")
    )
    starts = spans.select(*k, japan_date(F.col("left")).alias("date"), "left")
    inner = ev.where("_date_only").join(starts, [*k, "date"]).where(
        (F.col("left") >= F.col("lo")) & (F.col("left") < F.col("hi"))
    ).select(*k, "left", "amount_jpy", F.lit(False).alias("_inside"))
    per = hit.unionByName(inner).groupBy(*k, "left").agg(
        F.sum(F.when(F.col("_inside"), F.col("amount_jpy"))).alias("_net"),
        F.count(F.when(F.col("_inside"), 1)).alias("_n"), F.max(~F.col("_inside")).alias("_ambiguous"),
    )
    out = spans.join(per, [*k, "left"], "left")
    if quality is None:
        sure = F.lit(True)
    else:
        out = out.join(quality.select("account_id", "flow_status"), "account_id", "left")
        sure = F.coalesce(F.col("flow_status") == "complete", F.lit(False))
    known = sure & ~F.coalesce("_ambiguous", F.lit(False))
    zero = F.lit(0)
    return out.select(
        *k, "left", "right", F.when(known, F.coalesce("_net", zero.cast("double"))).alias("net_flow"),
        F.when(sure, F.coalesce("_n", zero)).otherwise(zero).alias("flow_count"), F.coalesce("_ambiguous", F.lit(False)).alias("ambiguous"),
    )


def dividends_paid(dividends: DataFrame, intervals: DataFrame) -> DataFrame:
    """Net amounts in JPY paid inside each interval; unpaid ones never count."""
    paid = dividends.where(F.col("status") == "paid").select(
        "account_id", F.col("payment_date").alias("date"), "ts", (F.col("net_amount") * F.col("fx")).alias("amount_jpy")
    )
    out = interval_flows(intervals, paid)
    return out.select("account_id", "left", "right", F.col("net_flow").alias("dividends_jpy"))


def day_result(snapshots: DataFrame, flows: DataFrame, quality: DataFrame, dividends: DataFrame) -> DataFrame:
    """Profit between consecutive valid valuations, net of external flows."""
    iv = valuation_intervals(snapshots)
    keys = ["account_id", "left", "right"]
    out = iv.join(interval_flows(iv, flows, quality).drop("ambiguous"), keys, "left").join(
        dividends_paid(dividends, iv), keys, "left"
    )
    pnl = F.col("assets_jpy") - F.col("prev_assets") - F.col("net_flow")
    known = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in COMPONENTS), F.lit(0.0))
    every = F.lit(True)
    for c in COMPONENTS:
        every = every & F.col(c).isNotNull()
    rate = F.when((F.col("flow_count") == 0) & (F.col("prev_assets") > 0), safe_div(pnl, F.col("prev_assets")) * 100)
    return out.select(
        "account_id", "date", "prev_date", "left", "right", "assets_jpy", "net_flow", "flow_count", "dividends_jpy",
        pnl.alias("pnl"), F.when(F.col("net_flow").isNotNull(), rate).alias("rate"),
        (pnl - known - F.col("dividends_jpy")).alias("residual"), (every & F.col("dividends_jpy").isNotNull()).alias("complete"),
    )


def year_result(snapshots: DataFrame, flows: DataFrame, quality: DataFrame, baselines: DataFrame) -> DataFrame:
    """From the year's baseline valuation to its last valid one.

    `baselines` (account_id, year, baseline_date) overrides the default 31 December; a baseline
    lies in the year before or the year itself, so each event is looked up under two years.
    """
    valid = snapshots.where(F.col("status").isin(*VALID_STATUS)).withColumn("at", boundary(F.col("date"), F.col("ts")))
    ends = valid.groupBy("account_id", F.year("date").alias("year")).agg(
        F.max(F.struct("at", "date", "assets_jpy")).alias("e")
    ).select("account_id", "year", F.col("e.at").alias("right"), F.col("e.date").alias("end_date"), F.col("e.assets_jpy").alias("end_assets"))
    ends = ends.join(baselines, ["account_id", "year"], "left").withColumn(
        "start_date", F.coalesce("baseline_date", F.make_date(F.col("year") - 1, F.lit(12), F.lit(31)))
    ).drop("baseline_date")
    starts = valid.groupBy("account_id", F.col("date").alias("start_date")).agg(
        F.max(F.struct("at", "assets_jpy")).alias("s")
    ).select("account_id", "start_date", F.col("s.at").alias("left"), F.col("s.assets_jpy").alias("start_assets"))
    iv = ends.join(starts, ["account_id", "start_date"], "left")
    iv = iv.withColumn("left", F.when(F.col("left") < F.col("right"), F.col("left")))
    y = F.year("date")
    dated = flows.withColumn("year", F.explode(F.array(y, y + 1)))
    fl = interval_flows(iv, dated, quality, keys=("account_id", "year"))
    out = iv.join(fl.drop("ambiguous", "flow_count"), ["account_id", "year", "left", "right"], "left")
    change = F.when(F.col("left").isNotNull(), F.col("end_assets") - F.col("start_assets"))
    return out.select(
        "account_id", "year", "start_date", "end_date", change.alias("asset_change"), "net_flow",
        (change - F.col("net_flow")).alias("pnl"), F.col("net_flow").isNotNull().alias("complete"),
    )


def month_result(days: DataFrame) -> DataFrame:
    """Month totals, only when the month starts from the day before it and every day is known."""
    month = F.trunc("date", "month")
    rows = days.withColumn("month", month)
    out = rows.groupBy("account_id", "month").agg(
        F.min_by("prev_date", "date").alias("_from"), F.count(F.lit(1)).alias("days"), F.count("pnl").alias("_pnl_n"),
        F.count("rate").alias("_rate_n"), F.sum("pnl").alias("_pnl"),
        F.sum(F.log1p(F.when(F.col("rate") > -100, F.col("rate")) / 100)).alias("_log"),
        F.count(F.when(F.col("rate") <= -100, 1)).alias("_wiped"),
    )
    full = F.coalesce((F.col("_from") == F.date_sub("month", 1)) & (F.col("_pnl_n") == F.col("days")), F.lit(False))
    rate = F.when(F.col("_wiped") > 0, -100.0).otherwise(F.expm1("_log") * 100)
    return out.select(
        "account_id", "month", "days", full.alias("complete"), F.when(full, F.col("_pnl")).alias("pnl"),
        F.when(full & (F.col("_rate_n") == F.col("days")), rate).alias("rate"),
    )
