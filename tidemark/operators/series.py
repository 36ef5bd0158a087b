"""Ticker and theme series: returns, aligned frames, rolling measures.

A ticker or theme has at most one row per exchange session once bars are unique, so the
windows below are bounded by the length of the calendar, whatever the raw tick volume.

Evaluating many dates at once: a theme's frame on a date depends only on the set of
tickers eligible on that date. That set changes rarely, so each distinct set ("epoch")
gets one frame, and every date reads its row from the frame of its own set. No date-times-
lookback blow-up, and each date still sees exactly the frame its own members define.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import LOOKBACK_BARS
from tidemark.functions.scoring import finite, safe_div
from tidemark.operators.dims import in_force


def unique_bars(bars: DataFrame, order: str) -> DataFrame:
    """Keep-last per ticker and session, by map-side aggregation."""
    rest = [c for c in bars.columns if c not in ("ticker", "session")]
    row = F.struct(*rest)
    return (
        bars.where(F.col("session").isNotNull() & finite(F.col("close")).isNotNull())
        .groupBy("ticker", "session")
        .agg(F.max_by(row, order).alias("_r"))
        .select("ticker", "session", "_r.*")
    )


def simple_returns(bars: DataFrame) -> DataFrame:
    """Change to the ticker's previous available bar."""
    w = Window.partitionBy("ticker").orderBy("session")
    return bars.withColumn("ret", safe_div(F.col("close"), F.lag("close").over(w)) - 1)


def period_returns(bars: DataFrame, days: int) -> DataFrame:
    """Change over `days` of the ticker's own bars."""
    w = Window.partitionBy("ticker").orderBy("session")
    value = safe_div(F.col("close"), F.lag("close", days).over(w)) - 1
    return bars.select("ticker", "session", value.alias(f"ret{days}"))


def overlay_returns(bars: DataFrame, tickers: DataFrame, days: tuple[int, ...] = (1, 10, 21)) -> DataFrame:
    """Display-only returns of tickers kept out of the official basket."""
    w = Window.partitionBy("ticker").orderBy("session")
    picked = bars.join(tickers.select("ticker").distinct(), "ticker", "left_semi")
    cols = [(safe_div(F.col("close"), F.lag("close", n).over(w)) - 1).alias(f"return_{n}d") for n in days]
    return picked.select("ticker", "session", *cols)


def session_numbers(sessions: DataFrame) -> DataFrame:
    """Dense numbering of a calendar. One row per session: bounded by the calendar's length."""
    return sessions.select("session", F.row_number().over(Window.orderBy("session")).alias("seq"))


def carried_rows(df: DataFrame, keys: list[str], seq: str, last_seq: Column) -> DataFrame:
    """Spread each sparse row over the sessions until the next row of its key (`t`)."""
    w = Window.partitionBy(*keys).orderBy(seq)
    upto = F.coalesce(F.lead(seq).over(w) - 1, F.greatest(last_seq, F.col(seq)))
    return df.withColumn("_upto", upto).withColumn("t", F.explode(F.sequence(F.col(seq), F.col("_upto")))).drop("_upto")


def member_days(bars: DataFrame, members: DataFrame, lookback: int = LOOKBACK_BARS) -> DataFrame:
    """Every (theme, ticker, benchmark session) with both returns and the running aligned count."""
    rets = simple_returns(bars).select("ticker", "session", "ret")
    bench_keys = members.select(F.col("benchmark").alias("ticker")).distinct()
    numbered = Window.partitionBy("ticker").orderBy("session")
    bench = (
        rets.join(bench_keys, "ticker", "left_semi")
        .select(
            F.col("ticker").alias("benchmark"), "session", F.col("ret").alias("bench_ret"),
            F.row_number().over(numbered).alias("seq"),
        )
    )
    who = members.select("theme_id", "ticker", "pos", "benchmark", "effective_from", "effective_to")
    w = Window.partitionBy("theme_id", "ticker").orderBy("seq").rangeBetween(-(lookback - 2), 0)
    return (
        who.join(bench, "benchmark")
        .join(rets, ["ticker", "session"], "left")
        .withColumn("valid", F.col("ret").isNotNull() & F.col("bench_ret").isNotNull())
        .withColumn("aligned_n", F.sum(F.col("valid").cast("int")).over(w))
        .withColumn("in_force", in_force(F.col("session"), F.col("effective_from"), F.col("effective_to")))
    )


def eligible_sets(days: DataFrame, as_of: DataFrame, floors: dict[str, int]) -> DataFrame:
    """Per (theme, as_of): the in-force tickers, and for each named floor the eligible ones."""
    entry = F.struct("pos", "ticker")

    def listed(cond: Column) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(cond, entry))), lambda e: e["ticker"])

    live = days.join(as_of.select(F.col("as_of").alias("session")), "session", "left_semi").where("in_force")
    aggs = [listed(F.lit(True)).alias("members")]
    aggs += [listed(F.col("aligned_n") >= n).alias(f"elig_{name}") for name, n in floors.items()]
    return live.groupBy("theme_id", "session", "seq").agg(*aggs).withColumnRenamed("session", "as_of")


def signature(tickers: Column) -> Column:
    """Short stable name of a ticker set."""
    return F.md5(F.array_join(F.sort_array(tickers), ","))


def epochs_of(sets: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct eligible sets of each theme with the span of dates that use them."""
    use = sets.select(
        "theme_id", "seq", F.explode(F.array_distinct(F.array(*columns))).alias("tickers")
    ).where(F.size("tickers") > 0)
    return (
        use.withColumn("sig", signature(F.col("tickers")))
        .groupBy("theme_id", "sig")
        .agg(
            F.first("tickers").alias("tickers"), F.min("seq").alias("lo"), F.max("seq").alias("hi"),
        )
    )


def aligned_frames(days: DataFrame, epochs: DataFrame, lookback: int = LOOKBACK_BARS) -> DataFrame:
    """Frame rows of each epoch: sessions where all its tickers and the benchmark have a return."""
    span = epochs.select(
        "theme_id", "sig", "lo", "hi", F.size("tickers").alias("n"), F.explode("tickers").alias("ticker")
    )
    return (
        days.where("valid").select("theme_id", "ticker", "session", "seq", "ret", "bench_ret")
        .join(span, ["theme_id", "ticker"])
        .where((F.col("seq") <= F.col("hi")) & (F.col("seq") > F.col("lo") - (lookback - 1)))
        .groupBy("theme_id", "sig", "seq", "session")
        .agg(
            F.avg("ret").alias("theme_ret"), F.max("bench_ret").alias("bench_ret"),
            F.count(F.lit(1)).alias("present"), F.max("n").alias("n"), F.max("hi").alias("hi"),
        )
        .where(F.col("present") == F.col("n"))
        .drop("present")
    )


def frame_window() -> Window:
    return Window.partitionBy("theme_id", "sig").orderBy("seq")


def risk_adjusted_excess(n: int, theme: str = "theme_ret", bench: str = "bench_ret") -> Column:
    """sum(excess) / (sample deviation * sqrt(rows)) over the last n frame rows."""
    w = frame_window().rowsBetween(-(n - 1), 0)
    e = F.col(theme) - F.col(bench)
    rows, total, sd = F.count(e).over(w), F.sum(e).over(w), F.stddev_samp(e).over(w)
    flat = F.when(F.abs(total) <= 1e-12, 0.0).when(total > 0, 3.0).otherwise(-3.0)
    return F.when(rows >= 2, F.when(sd <= 1e-12, flat).otherwise(total / (F.when(sd > 1e-12, sd) * F.sqrt(rows))))


def cumulative_return(ret: str, n: int) -> Column:
    """Compounded return of the last n frame rows; NULL until n rows exist."""
    w = frame_window().rowsBetween(-(n - 1), 0)
    logs = F.log1p(F.greatest(F.col(ret), F.lit(-0.999999)))
    return F.when(F.count(F.col(ret)).over(w) == n, F.expm1(F.sum(logs).over(w)))


def relative_wealth() -> Column:
    """Running product of (1 + theme) / (1 + benchmark); only its ratios are used."""
    w = frame_window().rowsBetween(Window.unboundedPreceding, 0)
    step = F.log1p(F.greatest(F.col("theme_ret"), F.lit(-0.999999))) - F.log1p(
        F.greatest(F.col("bench_ret"), F.lit(-0.999999))
    )
    return F.exp(F.sum(step).over(w))


def theme_wealth() -> Column:
    w = frame_window().rowsBetween(Window.unboundedPreceding, 0)
    return F.exp(F.sum(F.log1p(F.greatest(F.col("theme_ret"), F.lit(-0.999999)))).over(w))


def dated_frames(frames: DataFrame, lookback: int = LOOKBACK_BARS) -> DataFrame:
    """Carry frame rows to every session `t` of their epoch; `frame_n` rows lie in t's lookback."""
    spread = carried_rows(frames, ["theme_id", "sig"], "seq", F.col("hi"))
    w = Window.partitionBy("theme_id", "sig").orderBy("t").rangeBetween(-(lookback - 2), 0)
    return spread.withColumn("frame_n", F.sum((F.col("seq") == F.col("t")).cast("int")).over(w))


def sorted_median(values: Column, n: int, is_sorted: bool = False) -> Column:
    """Median of an array of known length n; the sorted array is evaluated once."""
    s = values if is_sorted else F.sort_array(values)
    if n % 2:
        return F.get(s, F.lit(n // 2))
    return F.aggregate(F.slice(s, n // 2, 2), F.lit(0.0), lambda a, x: a + x) / 2


def trailing_robust_z(df: DataFrame, values: str, history: int, signal: int, out: str) -> DataFrame:
    """Median of the last `signal` entries of an array against median and MAD of the `history` before.

    Done in steps, each array sorted once; the centre is handed to zip_with as an array because
    a value captured by its lambda would be evaluated again for every element.
    """
    keep = df.columns
    rows = df.select(
        "*", sorted_median(F.slice(values, history + 1, signal), signal).alias("_cur"), F.sort_array(F.slice(values, 1, history)).alias("_hist")
    )
    rows = rows.select(*keep, "_cur", "_hist", sorted_median(F.col("_hist"), history, is_sorted=True).alias("_mid"))
    devs = F.zip_with("_hist", F.array_repeat("_mid", history), lambda x, m: F.abs(x - m))
    rows = rows.select(*keep, "_cur", "_mid", (sorted_median(devs, history) * 1.4826).alias("_scale"))
    scale = F.col("_scale")
    z = F.when(scale <= 1e-12, 0.0).otherwise((F.col("_cur") - F.col("_mid")) / F.when(scale > 1e-12, scale))
    return rows.select(*keep, (z if history >= 20 else F.lit(None).cast("double")).alias(out))


def breadth_marks(bars: DataFrame, ma: int, change: int) -> DataFrame:
    """Per bar: is the close above its own average now, and was it `change` bars ago."""
    w = Window.partitionBy("ticker").orderBy("session")
    avg = F.avg("close").over(w.rowsBetween(-(ma - 1), 0))
    n = F.row_number().over(w)
    marked = bars.select(
        "ticker", "session", "close", avg.alias("_avg"), n.alias("bars_n")
    ).withColumn("above", (F.col("close") > F.col("_avg")).cast("int"))
    return marked.select(
        "ticker", "session",
        F.when(F.col("bars_n") >= ma + change + 2, F.col("above")).alias("above_now"),
        F.when(F.col("bars_n") >= ma + change + 2, F.lag("above", change).over(w)).alias("above_past"),
    )


def activity_marks(bars: DataFrame, history: int, signal: int) -> DataFrame:
    """Per bar with volume: robust z of log dollar volume and the 5-bar median dollar volume."""
    rows = bars.where(finite(F.col("close")).isNotNull() & finite(F.col("volume")).isNotNull())
    w = Window.partitionBy("ticker").orderBy("session")
    rows = rows.withColumn("_dv", F.col("close") * F.col("volume")).withColumn("_pos", (F.col("_dv") > 0).cast("int"))
    rows = rows.withColumn("_k", F.sum("_pos").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_n", F.row_number().over(w))
    last = Window.partitionBy("ticker").orderBy("_k").rangeBetween(-(history + signal - 1), 0)
    entry = F.struct(F.col("_k"), F.col("_dv"), F.log(F.when(F.col("_pos") == 1, F.col("_dv"))).alias("_log"))
    ready = (F.col("_n") >= history + signal + 5) & (F.col("_k") >= history + signal)
    lists = rows.select(
        "ticker", "session", "_k", "_n", F.collect_list(F.when(F.col("_pos") == 1, entry)).over(last).alias("_raw")
    ).select("ticker", "session", F.when(ready, F.sort_array("_raw")).alias("_e"))
    lists = lists.select("ticker", "session", F.col("_e._log").alias("_logs"), sorted_median(F.slice(F.col("_e._dv"), -5, 5), 5).alias("recent_dv"))
    return trailing_robust_z(lists, "_logs", history, signal, "stock_z").drop("_logs")


def marks_at(marks: DataFrame, calendar: DataFrame) -> DataFrame:
    """Latest mark of each ticker on every later calendar session (`t`)."""
    last = calendar.agg(F.max("seq").alias("_last"))
    placed = marks.join(calendar, "session").join(F.broadcast(last))  # one row
    return carried_rows(placed, ["ticker"], "seq", F.col("_last")).drop("_last", "seq", "session")
