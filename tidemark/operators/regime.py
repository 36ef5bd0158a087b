"""Market regime: trend, semiconductors, instability, hysteresis, stress, confidence.

Every state rule here is a latch (set by a condition held for some sessions, reset by
another), so states are window expressions; no row-by-row fold is needed. `market_id`
separates markets; a market has one row per session.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.scoring import band_label, piecewise_score, safe_div, weighted_score

RUNGS = ["Strong Bull", "Bull", "Neutral", "Bear", "Strong Bear"]


def _wt() -> Window:
    return Window.partitionBy("ticker").orderBy("session")


def price_factors(bars: DataFrame) -> DataFrame:
    """Per ticker: distances to averages, returns, volatility and drawdown, NULL until complete."""
    def over(fn, n):
        w = _wt().rowsBetween(-(n - 1), 0)
        return F.when(F.count("close").over(w) == n, fn.over(w))

    change = lambda n: safe_div(F.col("close"), F.lag("close", n).over(_wt())) - 1
    rows = bars.select("ticker", "session", "close", change(1).alias("r1"))
    ma200, ma50, high20 = over(F.avg("close"), 200), over(F.avg("close"), 50), over(F.max("close"), 20)
    w20 = _wt().rowsBetween(-19, 0)
    vol = F.when(F.count("r1").over(w20) == 20, F.stddev_samp("r1").over(w20) * math.sqrt(252))
    return rows.select(
        "ticker", "session", (F.col("close") / ma200 - 1).alias("vs200"), (ma50 / ma200 - 1).alias("ma50_200"),
        *[change(n).alias(f"ret{n}") for n in (5, 21, 63)],
        vol.alias("volatility"), (1 - F.col("close") / high20).alias("drawdown"),
    )


def relative_strength(a: Column, b: Column) -> Column:
    """Ratio return of a against b: (1 + a) / (1 + b) - 1."""
    return safe_div(1 + a, 1 + b) - 1


def relative_strength_of(bars: DataFrame, a: str, b: str, n: int) -> DataFrame:
    """n-bar ratio return of ticker a over ticker b, per session."""
    ret = safe_div(F.col("close"), F.lag("close", n).over(_wt())) - 1
    rows = bars.where(F.col("ticker").isin(a, b)).select("ticker", "session", ret.alias("r"))
    pick = lambda t: F.max(F.when(F.col("ticker") == t, F.col("r")))
    return rows.groupBy("session").agg(relative_strength(pick(a), pick(b)).alias("rs"))


def factor_row(factors: DataFrame, roles: dict[str, str]) -> DataFrame:
    """One row per session with role-prefixed factors; `roles` maps role -> ticker."""
    names = [c for c in factors.columns if c not in ("ticker", "session")]
    cols = [
        F.max(F.when(F.col("ticker") == t, F.col(n))).alias(f"{role}_{n}") for role, t in roles.items() for n in names
    ]
    return factors.where(F.col("ticker").isin(*roles.values())).groupBy("session").agg(*cols)


def trend_score(row: DataFrame, cfg=C.TREND) -> DataFrame:
    """Adds trend factor scores and their weighted sum."""
    row = row.select(
        "*",
        relative_strength(F.col("equal_ret63"), F.col("broad_ret63")).alias("breadth_rs"),
        relative_strength(F.col("highyield_ret63"), F.col("grade_ret63")).alias("credit_rs"),
    )
    s = {
        "vs200": piecewise_score(F.col("growth_vs200"), cfg["vs200"]),
        "ret63": piecewise_score(F.col("growth_ret63"), cfg["ret63"]),
        "ma50_200": piecewise_score(F.col("growth_ma50_200"), cfg["ma50_200"]),
        "breadth": piecewise_score(F.col("breadth_rs"), cfg["relative"]),
        "credit": piecewise_score(F.col("credit_rs"), cfg["relative"]),
    }
    row = row.select("*", *[c.alias(f"trend_{k}") for k, c in s.items()])
    return row.withColumn("trend", weighted_score({k: F.col(f"trend_{k}") for k in s}, cfg["weights"]))


def semis_score(row: DataFrame, cfg=C.SEMIS) -> DataFrame:
    rs = relative_strength(F.col("semis_ret63"), F.col("growth_ret63"))
    s = {
        "vs200": piecewise_score(F.col("semis_vs200"), cfg["vs200"]),
        "ret63": piecewise_score(F.col("semis_ret63"), cfg["ret63"]),
        "relative": piecewise_score(rs, cfg["relative"]),
        "ret21": piecewise_score(F.col("semis_ret21"), cfg["ret21"]),
    }
    return row.select("*", rs.alias("semis_rs"), weighted_score(s, cfg["weights"]).alias("semis"))


def instability_score(row: DataFrame, cfg=C.INSTABILITY) -> DataFrame:
    s = {
        "vix": piecewise_score(F.col("vix"), cfg["vix"]),
        "volatility": piecewise_score(F.col("growth_volatility"), cfg["volatility"]),
        "drawdown": piecewise_score(F.col("growth_drawdown"), cfg["drawdown"]),
    }
    return row.withColumn("instability", weighted_score(s, cfg["weights"])).withColumn(
        "instability_label", band_label(F.col("instability"), C.INSTABILITY_LABELS)
    )


def _latch(on: Column, off: Column, w: Window) -> Column:
    """Last of set / reset so far; starts reset."""
    return F.coalesce(F.last(F.when(on, True).when(off, False), ignorenulls=True).over(w), F.lit(False))


def regime_state(scores: DataFrame, score: str = "trend", keys: tuple[str, ...] = ("market_id",)) -> DataFrame:
    """Five-rung state with hysteresis and its duration in sessions.

    Each rung is a latch: set when the score holds its entry level two sessions running, reset
    when it crosses its exit level. Leaving a strong rung therefore lands on the milder rung if
    that one still holds, else on Neutral.
    """
    by = Window.partitionBy(*keys).orderBy("session")
    sofar = by.rowsBetween(Window.unboundedPreceding, 0)
    t, prev = F.col(score), F.lag(score).over(by)
    lvl = C.REGIME_RUNGS
    rows = scores.withColumn("_prev", prev)
    up = lambda k: (t >= lvl[k][0]) & (F.col("_prev") >= lvl[k][0])
    down = lambda k: (t <= lvl[k][0]) & (F.col("_prev") <= lvl[k][0])
    rows = rows.select(
        *scores.columns,
        _latch(up("strong_bull"), t < lvl["strong_bull"][1], sofar).alias("_sb"),
        _latch(up("bull"), t < lvl["bull"][1], sofar).alias("_b"),
        _latch(down("bear"), t > lvl["bear"][1], sofar).alias("_e"),
        _latch(down("strong_bear"), t > lvl["strong_bear"][1], sofar).alias("_se"),
    )
    state = (
        F.when(F.col("_sb"), RUNGS[0]).when(F.col("_b"), RUNGS[1]).when(F.col("_se"), RUNGS[4])
        .when(F.col("_e"), RUNGS[3]).otherwise(RUNGS[2])
    )
    rows = rows.select(*scores.columns, state.alias("state"))
    change = (~F.col("state").eqNullSafe(F.lag("state").over(by))).cast("int")
    rows = rows.withColumn("_change", change).withColumn("_run", F.sum("_change").over(sofar))
    run = Window.partitionBy(*keys, "_run").orderBy("session")
    return rows.withColumn("state_days", F.row_number().over(run)).drop("_change", "_run")


def stress(rows: DataFrame, cfg=C.STRESS, keys: tuple[str, ...] = ("market_id",)) -> DataFrame:
    """Emergency flag: on at once when any condition holds, off after three quiet sessions."""
    hit = (
        F.coalesce(F.col("instability") >= cfg["instability"], F.lit(False))
        | F.coalesce((F.col("vix") >= cfg["vix"]) & (F.col("growth_ret5") <= cfg["ret5"]), F.lit(False))
        | F.coalesce(F.col("growth_drawdown") >= cfg["drawdown"], F.lit(False))
    )
    w = Window.partitionBy(*keys).orderBy("session").rowsBetween(-(cfg["clear_days"] - 1), 0)
    return rows.withColumn("stress_hit", hit).withColumn("stress_active", F.max("stress_hit").over(w))


def worse(state: Column) -> Column:
    """One rung worse, at most Strong Bear."""
    out = state
    for a, b in zip(RUNGS, RUNGS[1:]):
        out = F.when(state == a, b).otherwise(out)
    return out


def confidence(rows: DataFrame, label: str = "state") -> DataFrame:
    """Pillars (price, breadth, credit) agreeing with the label's direction: High, Medium, Low."""
    pillars = [(F.col("trend_vs200") + F.col("trend_ret63")) / 2, F.col("trend_breadth"), F.col("trend_credit")]
    count = lambda cond: sum((F.coalesce(cond(p), F.lit(False)).cast("int") for p in pillars), F.lit(0))
    bull, bear = F.col(label).isin(*RUNGS[:2]), F.col(label).isin(*RUNGS[3:])
    agree = F.when(bull, count(lambda p: p > 60)).when(bear, count(lambda p: p < 40)).otherwise(F.lit(0))
    rows = rows.withColumn("pillars_agree", agree)
    a = F.col("pillars_agree")
    shaky = bull & F.coalesce(F.col("instability") >= 70, F.lit(False))
    level = a - F.when(shaky & (a >= 2), 1).otherwise(0)
    return rows.withColumn("confidence", F.when(level >= 3, "High").when(level == 2, "Medium").otherwise("Low"))


def regime_daily(factors: DataFrame, vix: DataFrame, roles: dict[str, str], market_id: str = "US") -> DataFrame:
    """One row per session with raw factors, scores, labels and flags."""
    row = factor_row(factors, roles).join(vix.select("session", F.col("close").alias("vix")), "session", "left")
    row = instability_score(semis_score(trend_score(row.withColumn("market_id", F.lit(market_id)))))
    rows = stress(regime_state(row))
    rows = rows.withColumn("final_label", F.when(F.col("stress_active"), worse(F.col("state"))).otherwise(F.col("state")))
    rows = confidence(rows).withColumn("semis_label", band_label(F.col("semis"), C.REGIME_LABELS))
    return rows.withColumn("missing", F.col("trend").isNull() | F.col("instability").isNull() | F.col("semis").isNull())
