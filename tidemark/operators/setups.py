"""Descriptive price checks per ticker and the readings derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scoring import finite, positive, safe_div
from tidemark.operators.keyed import split_lag

WINDOW = 64
# Fields a setup must carry before its code is derived.
REQUIRED = ("price", "ma20", "ma50", "prior_high20", "prior_low20", "rsi14", "distance_ma20_pct")


def _w() -> Window:
    return Window.partitionBy("ticker").orderBy("seq")


def stock_setups(grid: DataFrame) -> DataFrame:
    """Setup of every ticker on every session it closed on.

    The window is the last 64 sessions since the ticker's first bar and must have no gap;
    a ticker-session with a gap gives no row.
    """
    frame = lambda lo, hi: _w().rangeBetween(lo, hi)
    close = F.when(positive(F.col("close")), F.col("close"))
    volume = F.when(finite(F.col("volume")) >= 0, F.col("volume"))
    since = F.col("seq") - F.min("seq").over(Window.partitionBy("ticker")) + 1
    base = grid.select(
        "ticker", "session", "seq", close.alias("c"), volume.alias("v"), F.least(since, F.lit(WINDOW)).alias("n"),
    )
    step = F.col("c") - F.lag("c").over(_w())
    base = base.select("*", F.greatest(step, F.lit(0.0)).alias("up"), F.greatest(-step, F.lit(0.0)).alias("down"))
    n, c = F.col("n"), F.col("c")
    have = F.count("c").over(frame(-(WINDOW - 1), 0))
    before = F.sum("v").over(frame(-20, -1))
    volumes = (F.count("v").over(frame(-20, 0)) == 21) & (n >= 21)
    lag = lambda k: F.when(n > k, F.lag("c", k).over(_w()))
    rows = base.select(
        "ticker", "session", "seq", c.alias("price"), F.col("n").cast("int").alias("history_sessions"),
        have.alias("_have"),
        F.when(n >= 20, F.avg("c").over(frame(-19, 0))).alias("ma20"),
        F.when(n >= 50, F.avg("c").over(frame(-49, 0))).alias("ma50"),
        F.when(n >= 21, F.max("c").over(frame(-20, -1))).alias("prior_high20"),
        F.when(n >= 21, F.min("c").over(frame(-20, -1))).alias("prior_low20"),
        F.when(n >= 15, F.sum("up").over(frame(-13, 0)) / 14).alias("_gain"),
        F.when(n >= 15, F.sum("down").over(frame(-13, 0)) / 14).alias("_loss"),
        F.when(volumes & (before > 0), F.col("v") / (F.when(before > 0, before) / 20)).alias("rvol"),
        lag(1).alias("previous_close"),
        *[((safe_div(c, lag(k)) - 1) * 100).alias(f"return_{k}_pct") for k in (1, 5, 21, 63)],
    ).where(F.col("_have") == F.col("history_sessions"))
    gain, loss = F.col("_gain"), F.col("_loss")
    rsi = (
        F.when(gain.isNull(), None)
        .when(loss > 0, 100 - 100 / (1 + gain / F.when(loss > 0, loss)))
        .when(gain > 0, 100.0)
        .otherwise(50.0)
    )
    p, ma20, ma50 = F.col("price"), F.col("ma20"), F.col("ma50")
    rows = rows.withColumn("rsi14", rsi).withColumn("distance_ma20_pct", (p / ma20 - 1) * 100)
    return rows.select(
        "*",
        (F.col("history_sessions") >= 50).alias("analysis_ready"),
        ((p > ma50) & (ma20 > ma50)).alias("trend_up"),
        (p > F.col("prior_high20")).alias("breakout"),
        (p < F.col("prior_low20")).alias("breakdown"),
        ((F.col("rsi14") >= 70) | (p / ma20 >= 1.10)).alias("overheated"),
    ).drop("_have", "_gain", "_loss")


def session_state(df: DataFrame, date: str, expected: str, today: Column) -> Column:
    """missing, invalid, unknown, current or stale, against the last completed session."""
    d, e = F.col(date), F.col(expected)
    return (
        F.when(d.isNull(), "missing")
        .when(d > today, "invalid")
        .when(e.isNull(), "unknown")
        .when(d > e, "invalid")
        .when(d == e, "current")
        .otherwise("stale")
    )


def expected_session(sessions: DataFrame, now: Column) -> DataFrame:
    """One row: last session whose close lies at least 30 minutes before `now`, if `now` is covered."""
    covered = F.to_date(now).between(F.min("session"), F.max("session"))
    done = F.col("close_ts") + F.expr("INTERVAL 30 MINUTES") <= now
    return sessions.agg(F.when(covered, F.max(F.when(done, F.col("session")))).alias("expected"))


def with_state(df: DataFrame, date: str, sessions: DataFrame, now: Column, out: str = "state") -> DataFrame:
    """Adds the freshness state; the expected session is a single row."""
    exp = expected_session(sessions, now)
    return (
        df.join(F.broadcast(exp))
        .withColumn(out, session_state(df, date, "expected", F.to_date(now)))
    )


def quote_for(basic: DataFrame, setups: DataFrame, sessions: DataFrame, now: Column) -> DataFrame:
    """Per ticker the quote to show: the setup's unless the basic one is newer and complete."""
    b = basic.select("ticker", F.col("date").alias("b_date"), F.col("price").alias("b_price"))
    s = setups.select("ticker", F.col("as_of").alias("s_date"), F.col("price").alias("s_price"), "quality")
    both = b.join(s, "ticker", "full_outer").join(F.broadcast(expected_session(sessions, now)))  # one row
    today = F.to_date(now)
    both = both.withColumn("b_state", session_state(both, "b_date", "expected", today)).withColumn(
        "s_state", session_state(both, "s_date", "expected", today)
    )
    done = lambda c: F.col(c).isin("current", "stale")
    pick = positive(F.col("s_price")) & (
        F.col("b_date").isNull() | F.coalesce(F.col("s_date") >= F.col("b_date"), F.lit(False)) | (done("s_state") & ~done("b_state"))
    )
    out = lambda s_col, b_col: F.when(pick, F.col(s_col)).otherwise(F.col(b_col))
    return both.select(
        "ticker", F.when(pick, "setup").otherwise("basic").alias("origin"), out("s_date", "b_date").alias("date"),
        out("s_price", "b_price").alias("price"), out("s_state", "b_state").alias("state"),
        out("s_state", "b_state").isin("current", "stale").alias("closed"),
        F.col("s_state").alias("setup_state"), F.when(pick, F.col("quality")).alias("quality"),
    ).where(F.col("date").isNotNull() | F.col("price").isNotNull())


def setup_code(df: DataFrame, fresh: Column) -> DataFrame:
    """Ordered reading of a setup; not fresh or incomplete input reads as waiting."""
    valid = F.lit(True)
    for name in REQUIRED:
        valid = valid & finite(F.col(name)).isNotNull()
    p, ma20, ma50 = F.col("price"), F.col("ma20"), F.col("ma50")
    yes = lambda c: F.coalesce(c, F.lit(False))
    code = (
        F.when(~yes(valid & fresh), "waiting")
        .when(yes(F.col("breakdown")) | yes((p < ma50) & (ma20 < ma50)), "weak")
        .when(yes(F.col("overheated")), "hot")
        .when(yes(F.col("breakout")), "breakout")
        .when(yes(F.col("trend_up") & (F.abs("distance_ma20_pct") <= 3)), "pullback")
        .when(yes(F.col("trend_up")), "trend")
        .otherwise("range")
    )
    return df.withColumn("code", code).withColumn("ready", F.col("code") != "waiting")


def quote_status(quotes: DataFrame, tracked: DataFrame) -> DataFrame:
    """current, stale, pending (with reason) or unsupported, per ticker.

    `quotes` is quote_for's output, `tracked` the refreshed universe (ticker, failure).
    """
    known = {
        "rate_limited": "rate_limited", "secret_missing": "provider_setup", "unavailable": "not_returned",
        "http_404": "not_returned", "unclosed_bar": "awaiting_close",
        "identity_or_currency_mismatch": "identity_mismatch", "incomplete_history": "gap_in_history",
    }
    reason = F.lit("retry_next_run")
    for k, v in known.items():
        reason = F.when(F.col("failure") == k, v).otherwise(reason)
    usable = F.coalesce(F.col("closed") & positive(F.col("price")), F.lit(False))
    stale = (F.col("state") != "current") | F.coalesce(F.col("quality") == "stale", F.lit(False))
    return (
        quotes.join(tracked.select("ticker", "failure", F.lit(True).alias("_tracked")), "ticker", "full_outer")
        .select(
            "ticker",
            F.when(usable & stale, "stale").when(usable, "current").when(F.col("_tracked").isNull(), "unsupported")
            .otherwise("pending").alias("status"),
            usable.alias("usable"),
            F.when(~usable & F.col("_tracked").isNotNull(), reason).alias("reason"),
        )
    )


def peer_readings(df: DataFrame) -> DataFrame:
    """Trend, overheating, damage and next action per stock of a peer group."""
    p, ma20, ma50, dist = F.col("price"), F.col("ma20"), F.col("ma50"), F.col("distance_ma20_pct")
    ready = F.col("ready")
    yes = lambda c: F.coalesce(ready & c, F.lit(False))
    out = df.select(
        *df.columns,
        F.when(~ready, "waiting").when((p > ma50) & (ma20 > ma50), "up").when((p < ma50) & (ma20 < ma50), "down")
        .otherwise("mixed").alias("trend"),
        yes((F.col("rsi14") >= 70) | (dist >= 10)).alias("hot"),
        yes((p < F.col("prior_low20")) | (p < ma50)).alias("broken"),
        yes(F.col("trend_up") & (F.abs(dist) <= 3)).alias("near"),
    )
    action = (
        F.when(~ready, "check_latest_bar").when(F.col("broken"), "review_thesis").when(F.col("hot"), "check_overheating")
        .when(F.coalesce("breakout", F.lit(False)), "check_breakout_holds").when(F.col("near"), "check_support")
        .when(F.col("trend") == "up", "check_trend_holds").otherwise("check_direction")
    )
    return out.withColumn("action", action)


def peer_summary(readings: DataFrame, keys: list[str]) -> DataFrame:
    c = lambda cond, name: F.count(F.when(cond, 1)).alias(name)
    return readings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("members"), c(F.col("ready"), "ready_n"), c(F.col("trend") == "up", "up_n"),
        c(F.col("hot"), "hot_n"), c(F.col("broken"), "broken_n"),
    )


def theme_insight(df: DataFrame) -> DataFrame:
    """Title code and attention flag of a theme snapshot row.

    Needs score_mode, quality, core_total, strength_n, heat_n, strength_score, heat_score,
    velocity_state, confirmed, hot, hot_eligible, single_stock_driven, turning_active,
    turning_eligible, fresh (boolean).
    """
    f = F.coalesce
    mode = F.col("score_mode")
    observation, heat_only = mode == "none", mode == "heat_only"
    s_n, h_n, total = f("strength_n", F.lit(0)), f("heat_n", F.lit(0)), f("core_total", F.lit(0))
    in_range = lambda c: F.when(F.col(c).between(0, 100), F.col(c))
    score, heat = in_range("strength_score"), in_range("heat_score")
    minimum = F.when(mode == "ranked", 4).otherwise(2)
    lacking = F.when(heat_only, (h_n < 2) | heat.isNull()).otherwise((s_n < minimum) | score.isNull())
    insufficient = ~observation & ((F.col("quality") == "insufficient") | lacking)
    partial = ~insufficient & ~observation & F.when(heat_only, h_n < total).otherwise(s_n < total)
    named = F.col("velocity_state").isNotNull()
    changing = named & ~f("confirmed", F.lit(False))
    hot = f("hot", F.lit(False)) & f("hot_eligible", F.lit(False)) & (h_n >= 3) & heat.isNotNull()
    concentrated = f("single_stock_driven", F.lit(False)) & heat.isNotNull()
    turning = f("turning_active", F.lit(False)) & f("turning_eligible", F.lit(False))
    v = f("velocity_state", F.lit(""))
    title = (
        F.when(observation, "observe_only").when(insufficient, "insufficient_data").when(concentrated, "concentrated")
        .when(hot & changing, "hot_changing").when(hot, "hot").when(changing, "changing")
        .when(v == "Weakening", "weakening").when(v == "Lagging", "lagging").when(turning, "turning")
        .when(v == "Improving", "improving").when((v == "Leading") & f(score >= 60, F.lit(False)) & ~heat_only, "leading")
        .when(heat_only, "short_term").otherwise("mixed")
    )
    stale = ~f("fresh", F.lit(False))
    return df.select(
        *df.columns,
        title.alias("snapshot_title"),
        F.when(stale & ~observation, "refresh_first").otherwise(title).alias("title"),
        (~observation & (insufficient | partial | stale | hot | concentrated | v.isin("Weakening", "Lagging"))).alias("attention"),
        F.when(observation, "observe_only").when(insufficient, "insufficient").when(partial, "partial")
        .when(mode == "thin", "thin").otherwise("full").alias("coverage_label"),
    )


def capture_changes(captures: DataFrame, bucket: str) -> DataFrame:
    """Captures that differ from the ticker's previous one, each with that previous capture."""
    kept = split_lag(
        captures, ["ticker"], bucket, ["observed_at"],
        {"p_date": "date", "p_price": "price", "p_currency": "currency", "p_code": "code"},
    )
    same = (
        F.col("date").eqNullSafe(F.col("p_date")) & F.col("price").eqNullSafe(F.col("p_price"))
        & F.col("currency").eqNullSafe(F.col("p_currency")) & F.col("code").eqNullSafe(F.col("p_code"))
    )
    return kept.where(F.col("_first") | (~same & (F.col("date") >= F.col("p_date")))).drop("_first")


def important_changes(changes: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Price move of at least `threshold` percent, or a change of reading code."""
    comparable = F.col("p_price").isNotNull() & F.col("currency").eqNullSafe(F.col("p_currency"))
    move = F.when(comparable, (safe_div(F.col("price"), F.col("p_price")) - 1) * 100)
    transition = comparable & F.col("p_code").isNotNull() & F.col("code").isNotNull() & (F.col("code") != F.col("p_code"))
    out = changes.withColumn("change_pct", move).withColumn("transition", F.coalesce(transition, F.lit(False)))
    return out.withColumn(
        "important", F.col("transition") | F.coalesce(F.abs("change_pct") >= threshold, F.lit(False))
    )
