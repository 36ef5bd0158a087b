"""Calendar-strict returns, relative volume, ranks and their history.

Nothing is filled: a window is valid only when every session in it has a bar, which is
checked by counting rows in a frame over the session number. No dense ticker x session grid
is built, so absent sessions cost nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.scoring import finite, positive, safe_div
from tidemark.operators.dims import effective_at


def on_calendar(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Bars on exchange sessions with their session number."""
    return bars.join(calendar.select("session", "seq"), "session")


def _frame(lo: int, hi: int) -> Window:
    return Window.partitionBy("ticker").orderBy("seq").rangeBetween(lo, hi)


def _by_seq() -> Window:
    return Window.partitionBy("ticker").orderBy("seq")


def complete(n: int) -> Column:
    """All of the last n sessions and this one have a positive close."""
    return F.sum(positive(F.col("close")).cast("int")).over(_frame(-n, 0)) == n + 1


def session_returns(grid: DataFrame, steps: tuple[int, ...] = C.RETURN_SESSIONS) -> DataFrame:
    """Close against the close exactly n sessions back; a gap anywhere in between is NULL."""
    cols = [
        F.when(complete(n), safe_div(F.col("close"), F.lag("close", n).over(_by_seq())) - 1).alias(f"return_{n}d")
        for n in steps
    ]
    return grid.select(*grid.columns, *cols)


def relative_volume(grid: DataFrame, n: int = C.RVOL_SESSIONS) -> DataFrame:
    """Volume over the mean of the previous n sessions, today excluded."""
    v = finite(F.col("volume"))
    v = F.when(v >= 0, v)
    usable = F.count(v).over(_frame(-n, 0)) == n + 1
    before = F.sum(v).over(_frame(-n, -1))
    return grid.withColumn("rvol", F.when(usable & (before > 0), v / (F.when(before > 0, before) / n)))


def metric_status(value: Column, eligible: Column, total: Column) -> Column:
    return F.when(value.isNull(), "missing").when(eligible == total, "ok").otherwise("partial")


METRICS = tuple(f"return_{n}d" for n in C.RETURN_SESSIONS) + ("rvol",)


def theme_display(
    metrics: DataFrame, members: DataFrame, as_of: DataFrame, elevated: float = C.RVOL_ELEVATED
) -> DataFrame:
    """Long table of theme metrics per (theme, as_of, metric).

    `metrics` has ticker, session, the metric columns and `basis` (one text of the price
    basis). Returns are averaged, relative volume takes the median; members on different
    bases give no value and the status mixed_basis.
    """
    core = members.where(F.col("role") == "core").select("theme_id", "ticker", "effective_from", "effective_to").distinct()
    live = effective_at(core, as_of).withColumnRenamed("as_of", "session")
    rows = live.join(metrics.select("ticker", "session", "basis", *METRICS), ["ticker", "session"], "left")
    aggs = [F.count(F.lit(1)).alias("total_n"), F.count(F.when(F.col("rvol") > elevated, 1)).alias("rvol_elevated_n")]
    for m in METRICS:
        known = F.col(m).isNotNull()
        aggs += [
            F.count(F.when(known, 1)).alias(f"n_{m}"),
            (F.median(m) if m == "rvol" else F.avg(m)).alias(f"v_{m}"),
            (F.min(F.when(known, F.col("basis"))).eqNullSafe(F.max(F.when(known, F.col("basis"))))).alias(f"b_{m}"),
        ]
    wide = rows.groupBy("theme_id", "session").agg(*aggs)
    entries = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.when(F.col(f"b_{m}"), F.col(f"v_{m}")).alias("value"),
                F.when(F.col(f"b_{m}"), F.col(f"n_{m}")).otherwise(0).alias("eligible_n"),
                F.col(f"b_{m}").alias("one_basis"),
            )
            for m in METRICS
        ]
    )
    long = wide.select("theme_id", F.col("session").alias("as_of"), "total_n", "rvol_elevated_n", F.explode(entries).alias("e"))
    value, n, total = F.col("e.value"), F.col("e.eligible_n"), F.col("total_n")
    status = F.when(~F.col("e.one_basis"), "mixed_basis").otherwise(metric_status(value, n, total))
    return long.select(
        "theme_id", "as_of", F.col("e.metric").alias("metric"), value.alias("value"), n.alias("eligible_n"), "total_n",
        safe_div(n, total).alias("coverage"), status.alias("status"), "rvol_elevated_n",
    )


def theme_ranks(snapshot: DataFrame, *versions: str) -> DataFrame:
    """Ordinal rank of ranked, ok, scored themes per as_of (and version); ties keep input order."""
    w = Window.partitionBy("as_of", *versions).orderBy(F.desc("score"), F.asc("pos"))
    return (
        snapshot.where(
            (F.col("score_mode") == "ranked") & (F.col("status") == "ok") & (finite(F.col("score")) >= 0)
        )
        .withColumn("rank", F.row_number().over(w))
    )


def known_history(history: DataFrame, known_at: Column) -> DataFrame:
    """Per as_of the newest version calculated by `known_at`."""
    usable = history.where(F.col("calculated_at") <= known_at)
    newest = usable.groupBy("as_of").agg(F.max("calculated_at").alias("calculated_at"))
    return usable.join(newest, ["as_of", "calculated_at"])


def rank_history(
    history: DataFrame, calendar: DataFrame, as_of: DataFrame, known_at: Column,
    offsets: tuple[int, ...] = C.RANK_OFFSETS,
) -> DataFrame:
    """Rank on exactly the n-th session before each as_of; unknown stays NULL."""
    ranks = theme_ranks(known_history(history, known_at)).select("theme_id", "as_of", "rank")
    numbered = ranks.join(calendar.withColumnRenamed("session", "as_of"), "as_of").select("theme_id", "seq", "rank")
    days = as_of.join(calendar.withColumnRenamed("session", "as_of"), "as_of").select("as_of", "seq")
    # A rank on session s is wanted by every date s + offset: equality join on the session number.
    wanted = numbered.select("theme_id", "rank", F.explode(F.array(*[F.lit(n) for n in offsets])).alias("back"), "seq")
    wanted = wanted.withColumn("seq", F.col("seq") + F.col("back"))
    cols = [F.max(F.when(F.col("back") == n, F.col("rank"))).alias(f"rank_{n}") for n in offsets]
    return wanted.groupBy("theme_id", "seq").agg(*cols).join(days, "seq").drop("seq")


def rank_change(ranks: DataFrame) -> DataFrame:
    return ranks.withColumn("rank_change_5d", F.col("rank_5") - F.col("rank_0"))


def sort_members(rows: DataFrame, metric: str, keys: list[str], order: str = "pos") -> DataFrame:
    """Position within each group by metric descending, unknown last, stable."""
    w = Window.partitionBy(*keys).orderBy(F.col(metric).desc_nulls_last(), F.col(order))
    return rows.withColumn("position", F.row_number().over(w))


def breadth_view(df: DataFrame) -> DataFrame:
    """Fractions from counts; impossible counts read as insufficient."""
    n, now, past = F.col("eligible_n"), F.col("now_above"), F.col("past_above")
    ok = F.coalesce((n > 0) & now.between(0, n) & past.between(0, n), F.lit(False))
    return df.select(
        *df.columns,
        F.when(ok, "ok").otherwise("insufficient").alias("breadth_status"),
        F.when(ok, safe_div(now, n)).alias("now_fraction"),
        F.when(ok, safe_div(past, n)).alias("past_fraction"),
        F.when(ok, safe_div(now - past, n)).alias("fraction_change"),
    )
