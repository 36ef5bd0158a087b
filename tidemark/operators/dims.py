"""Effective dating, members and universes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.validity import clean
from tidemark.operators.keyed import keep_latest

ROLE_ORDER = {"core": 0, "related": 1, "watch": 2}
TICKER_PATTERN = r"^[A-Z][A-Z0-9]{0,4}$"
# Venues and name patterns of listed exchange-traded products.
FUND_VENUES = ("XNAS", "XNYS", "ARCX", "XASE", "BATS", "XCBO")
FUND_NAME = r"(?i)\bETF\b|\bETNs?\b|\bShares\b"
LEVERAGE_NAME = r"(?i)\b[123](?:x|×)\b|\bbull\b|\bbear\b|\bultra|\binverse\b|\bweeklypay\b"


def role_rank(role: Column) -> Column:
    out = F.lit(9)
    for name, n in ROLE_ORDER.items():
        out = F.when(role == name, n).otherwise(out)
    return out


def in_force(as_of: Column, start: Column, end: Column) -> Column:
    """Both ends inclusive, NULL meaning open."""
    return (start.isNull() | (as_of >= start)) & (end.isNull() | (as_of <= end))


def effective_at(
    dim: DataFrame, as_of: DataFrame | dt.date, start: str = "effective_from", end: str = "effective_to"
) -> DataFrame:
    """Rows of a dated dimension in force on each date; adds `as_of`.

    With a table of dates every row is spread over the dates it covers through one
    month-bucketed equality join, so no nested-loop join is planned.
    """
    if isinstance(as_of, dt.date):
        day = F.lit(as_of)
        return dim.where(in_force(day, F.col(start), F.col(end))).withColumn("as_of", day)
    dates = as_of.select("as_of").distinct()
    bounds = dates.agg(F.min("as_of").alias("_lo"), F.max("as_of").alias("_hi"))
    month = lambda c: F.trunc(c, "month")
    spread = (
        dim.join(F.broadcast(bounds))  # one row
        .withColumn("_from", F.greatest(F.col(start), F.col("_lo")))
        .withColumn("_to", F.least(F.col(end), F.col("_hi")))
        .where(F.col("_from") <= F.col("_to"))
        .withColumn(
            "_month",
            F.explode(F.sequence(month(F.col("_from")), month(F.col("_to")), F.expr("INTERVAL 1 MONTH"))),
        )
    )
    return (
        spread.join(dates.withColumn("_month", month(F.col("as_of"))), "_month")
        .where((F.col("as_of") >= F.col("_from")) & (F.col("as_of") <= F.col("_to")))
        .drop("_lo", "_hi", "_from", "_to", "_month")
    )


def effective_at_exclusive(defs: DataFrame, requests: DataFrame, key: str = "theme_id") -> DataFrame:
    """Definitions with valid_from <= day < valid_to that were known when the request was issued.

    An interval index: each version is laid out over the months it covers, within the months of the
    requests, and a request meets the versions of its own key and month only. A key with many
    versions and many requests is thus spread over its months, and AQE can split a month further.
    """
    day, month = F.to_date("issued_at"), lambda c: F.trunc(c, "month")
    asked = requests.withColumn("_month", month(day))
    bounds = asked.agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    start = F.greatest(F.col("valid_from"), F.to_date("known_at"), F.col("_lo"))
    end = F.least(F.date_sub("valid_to", 1), F.col("_hi"))
    # The bounds are one row.
    inside = defs.where(F.col("valid_from").isNotNull() & F.col("known_at").isNotNull()).join(F.broadcast(bounds)).where(start <= end)
    laid = inside.withColumn("_month", F.explode(F.sequence(month(start), month(end), F.expr("INTERVAL 1 MONTH")))).drop("_lo", "_hi")
    return asked.join(laid, [key, "_month"]).where(
        (F.col("valid_from") <= day)
        & (F.col("valid_to").isNull() | (day < F.col("valid_to")))
        & (F.col("known_at") <= F.col("issued_at"))
    ).drop("_month")


def active_themes(themes: DataFrame, as_of: DataFrame) -> DataFrame:
    """Per date the active or watched themes in force; where none is, the next start date."""
    live = effective_at(themes.where(F.col("status").isin("active", "watch")), as_of)
    per_day = live.groupBy("as_of").agg(
        F.sort_array(F.collect_set("theme_id")).alias("theme_ids")
    )
    starts = themes.where(F.col("effective_from").isNotNull()).agg(
        F.sort_array(F.collect_set("effective_from")).alias("_starts")
    )
    return (
        as_of.select("as_of").distinct().join(per_day, "as_of", "left")
        .join(F.broadcast(starts))  # one row, one entry per distinct start date
        .withColumn(
            "next_effective",
            F.when(
                F.col("theme_ids").isNull(),
                F.array_min(F.filter("_starts", lambda d: d > F.col("as_of"))),
            ),
        )
        .drop("_starts")
    )


def theme_members(memberships: DataFrame, as_of: DataFrame | dt.date) -> DataFrame:
    """core / related / watch ticker lists in input order, and overlay tickers."""
    live = effective_at(memberships, as_of).where(clean(F.col("ticker")).isNotNull())
    entry = F.struct(F.col("pos"), F.upper(clean(F.col("ticker"))).alias("ticker"))

    def tickers(cond: Column, name: str) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(cond, entry))), lambda e: e["ticker"]).alias(name)

    role = F.col("role")
    overlay = (role == "watch") & F.lower(F.coalesce(F.col("notes"), F.lit(""))).contains("overlay")
    return live.groupBy("theme_id", "as_of").agg(
        tickers(role == "core", "core"),
        tickers(role == "related", "related"),
        tickers(role == "watch", "watch"),
        tickers(overlay, "overlay"),
    )


def price_universe(themes: DataFrame, memberships: DataFrame, as_of: DataFrame | dt.date) -> DataFrame:
    """Distinct tickers needed on each date: core, overlay and benchmarks."""
    live = effective_at(themes.where(F.col("status").isin("active", "watch")), as_of)
    members = effective_at(memberships, as_of).join(
        live.select("theme_id", "as_of"), ["theme_id", "as_of"], "left_semi"
    )
    overlay = (F.col("role") == "watch") & F.lower(F.coalesce("notes", F.lit(""))).contains("overlay")
    wanted = members.where((F.col("role") == "core") | overlay).select(
        "as_of", F.upper(clean(F.col("ticker"))).alias("ticker")
    )
    bench = live.where(F.col("score_mode") != "none").select(
        "as_of", F.upper(clean(F.col("primary_benchmark"))).alias("ticker")
    )
    return wanted.union(bench).where(F.col("ticker").isNotNull()).distinct()


def discover_universe(
    explicit: list[str],
    listings: DataFrame,
    previous: DataFrame,
    underlying_names: list[str] = (),
    topics: list[str] = (),
) -> DataFrame:
    """Explicit tickers plus listed funds whose name names a topic, or leverage on an underlying.

    Earlier discoveries stay even when the listing disappears.
    """
    words = [w for w in explicit if len(w) > 1] + list(underlying_names)
    alt = lambda ws: "|".join(rf"\Q{w}\E" for w in ws)
    name = F.coalesce(F.col("name"), F.lit(""))
    matches = F.lit(False)
    if topics:
        matches = matches | name.rlike(rf"(?i)\b(?:{alt(topics)})\b")
    if words:
        matches = matches | (
            name.rlike(LEVERAGE_NAME) & name.rlike(rf"(?i)(?<![A-Z0-9])(?:{alt(words)})(?![A-Z0-9])")
        )
    found = listings.where(
        (F.col("country") == "United States")
        & (F.col("currency") == "USD")
        & (F.col("type") == "ETF")
        & F.col("symbol").rlike(TICKER_PATTERN)
        & F.col("mic_code").isin(*FUND_VENUES)
        & name.rlike(FUND_NAME)
        & matches
    ).select(F.col("symbol").alias("ticker"))
    automatic = (
        found.union(previous.select("ticker")).distinct()
        .where(F.col("ticker").rlike(TICKER_PATTERN) & ~F.col("ticker").isin(*explicit))
    )
    spark = listings.sparkSession
    fixed = spark.createDataFrame([(t, i) for i, t in enumerate(dict.fromkeys(explicit))], "ticker string, pos int")
    return fixed.withColumn("automatic", F.lit(False)).unionByName(
        automatic.withColumn("automatic", F.lit(True)).withColumn("pos", F.lit(None).cast("int"))
    )


def work_queue(universe: DataFrame, fresh: DataFrame, attempts: DataFrame, budget: int) -> DataFrame:
    """What to refresh next: explicit first, then the least recently tried, then by ticker."""
    return (
        universe.join(fresh.select("ticker"), "ticker", "left_anti")
        .join(attempts.select("ticker", "last_attempt_at"), "ticker", "left")
        .orderBy(
            F.col("pos").isNull(), F.col("pos"), F.col("last_attempt_at").asc_nulls_first(), F.col("ticker")
        )
        .limit(budget)
    )


def membership_of(memberships: DataFrame, as_of: DataFrame | dt.date) -> DataFrame:
    """Themes of each ticker with its strongest role there."""
    live = effective_at(memberships, as_of)
    return live.groupBy("ticker", "theme_id", "as_of").agg(F.min_by("role", role_rank(F.col("role"))).alias("role"))


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return keep_latest(df, keys, [F.col(c) for c in order])
