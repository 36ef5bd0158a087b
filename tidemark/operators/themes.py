"""Theme signals for many (theme, as_of) pairs in one plan."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.scoring import band_label, piecewise_score, safe_div, weighted_score
from tidemark.operators import series as S
from tidemark.operators.keyed import cut_lineage

CORE_COLUMNS = ["theme_id", "ticker", "pos", "benchmark", "effective_from", "effective_to"]


def core_members(themes: DataFrame, memberships: DataFrame, benchmark: str | None = None) -> DataFrame:
    """Core rows with the theme's benchmark (or one given benchmark for all)."""
    bench = F.lit(benchmark) if benchmark else F.col("primary_benchmark")
    return (
        memberships.where(F.col("role") == "core")
        .join(themes.select("theme_id", bench.alias("benchmark")), "theme_id")
        .select(*CORE_COLUMNS)
    )


def _evaluate(
    days: DataFrame, sets: DataFrame, floors: dict[str, int], measures: list[dict[str, Column]], lookback: int
) -> dict[str, DataFrame]:
    """One set of frames shared by all floors; per floor the measures read at each date.

    `measures` comes in layers, later ones may read earlier ones.
    """
    epochs = S.epochs_of(sets, [f"elig_{f}" for f in floors])
    frames = S.aligned_frames(days, epochs, lookback)
    for layer in measures:
        frames = frames.select("*", *[col.alias(name) for name, col in layer.items()])
    names = [name for layer in measures for name in layer]
    dated = S.dated_frames(frames, lookback).select("theme_id", "sig", "t", "frame_n", *names)
    out = {}
    for name, floor in floors.items():
        keyed = sets.select("*", S.signature(F.col(f"elig_{name}")).alias("sig"), F.col("seq").alias("t"))
        full = F.coalesce(F.col("frame_n"), F.lit(0)) >= floor
        out[name] = keyed.join(dated, ["theme_id", "sig", "t"], "left").select(
            *sets.columns, full.alias("has_frame"), *[F.when(full, F.col(m)).alias(m) for m in names]
        )
    return out


def strength_from(ev: DataFrame, score_mode: Column, cfg=C.STRENGTH) -> DataFrame:
    floor = F.when(score_mode == "ranked", cfg["min_ranked"]).otherwise(cfg["min_thin"])
    n = F.size("elig_strength")
    usable = F.col("has_frame") & (n >= floor)
    ra, cons = F.when(usable, F.col("rae_strength")), F.when(usable, F.col("consistency"))
    ra_s, cons_s = piecewise_score(ra, cfg["risk_adjusted"]), piecewise_score(cons, cfg["consistency"])
    out = ev.select(
        "theme_id", "as_of", n.alias("strength_n"), F.col("elig_strength").alias("strength_members"),
        ra.alias("risk_adjusted"), cons.alias("consistency"),
        ra_s.alias("risk_adjusted_score"), cons_s.alias("consistency_score"),
    )
    score = weighted_score(
        {"risk_adjusted": F.col("risk_adjusted_score"), "consistency": F.col("consistency_score")}, cfg["weights"]
    )
    return out.withColumn("strength_score", score).withColumn(
        "strength_label", band_label(F.col("strength_score"), cfg["labels"])
    )


def strength_measures(cfg=C.STRENGTH) -> list[dict[str, Column]]:
    n = cfg["window"]
    ahead = (F.col("theme_ret") > F.col("bench_ret")).cast("double")
    return [
        {
            "rae_strength": S.risk_adjusted_excess(n),
            "consistency": F.avg(ahead).over(S.frame_window().rowsBetween(-(n - 1), 0)),
        }
    ]


def strength(
    bars: DataFrame, members: DataFrame, as_of: DataFrame, modes: DataFrame | None = None,
    cfg=C.STRENGTH, lookback: int = C.LOOKBACK_BARS,
) -> DataFrame:
    """63-row risk-adjusted excess and consistency, scored, weighted and labelled.

    `modes` maps theme_id to score_mode; without it every theme is held to the ranked floor.
    """
    floors = {"strength": cfg["window"]}
    days = S.member_days(bars, members, lookback)
    sets = S.eligible_sets(days, as_of, floors)
    ev = _evaluate(days, sets, floors, strength_measures(cfg), lookback)["strength"]
    if modes is None:
        return strength_from(ev, F.lit("ranked"), cfg)
    return strength_from(ev.join(modes.select("theme_id", "score_mode"), "theme_id"), F.col("score_mode"), cfg)


def velocity_floor(cfg=C.VELOCITY) -> int:
    return cfg["level_ma"] + cfg["momentum"] + cfg["slack"]


def velocity_measures(cfg=C.VELOCITY) -> list[dict[str, Column]]:
    w = S.frame_window()
    level = F.avg("rel").over(w.rowsBetween(-(cfg["level_ma"] - 1), 0))
    full = F.count("rel").over(w.rowsBetween(-(cfg["level_ma"] - 1), 0)) == cfg["level_ma"]
    return [
        {"rel": S.relative_wealth()},
        {
            "rs_level": F.when(full, F.col("rel") / level - 1),
            "rs_momentum": F.col("rel") / F.lag("rel", cfg["momentum"]).over(w) - 1,
        },
    ]


def velocity_from(ev: DataFrame, cfg=C.VELOCITY) -> DataFrame:
    usable = F.col("has_frame") & (F.size("elig_velocity") >= cfg["min_members"])
    level, mom = F.when(usable, F.col("rs_level")), F.when(usable, F.col("rs_momentum"))
    state = (
        F.when(level.isNull() | mom.isNull(), None)
        .when((level >= 0) & (mom >= 0), "Leading")
        .when(level >= 0, "Weakening")
        .when(mom < 0, "Lagging")
        .otherwise("Improving")
    )
    return ev.select(
        "theme_id", "as_of", F.size("elig_velocity").alias("velocity_n"),
        level.alias("rs_level"), mom.alias("rs_momentum"), state.alias("raw_state"),
    )


def velocity_raw(
    bars: DataFrame, members: DataFrame, as_of: DataFrame, cfg=C.VELOCITY, lookback: int = C.LOOKBACK_BARS
) -> DataFrame:
    """Relative level and momentum quadrant of each theme."""
    floors = {"velocity": velocity_floor(cfg)}
    days = S.member_days(bars, members, lookback)
    sets = S.eligible_sets(days, as_of, floors)
    return velocity_from(_evaluate(days, sets, floors, velocity_measures(cfg), lookback)["velocity"], cfg)


def velocity_confirmed(raw: DataFrame, confirm: int = C.VELOCITY["confirm"], prior: DataFrame | None = None) -> DataFrame:
    """State that changes only after `confirm` days with the same raw candidate.

    Only the day inside a run of equal raw states matters, so this is two window passes:
    runs by change flags, then the last raw state that was either the first after an
    unknown day or `confirm` days into its run. `prior` optionally gives the state a theme
    held before its first row (theme_id, state, candidate, candidate_days).
    """
    by_theme = Window.partitionBy("theme_id").orderBy("as_of")
    so_far = by_theme.rowsBetween(Window.unboundedPreceding, 0)
    if prior is None:
        rows = raw.withColumn("_p", F.lit(None).cast("struct<state:string,candidate:string,candidate_days:int>"))
    else:
        held = prior.select("theme_id", F.struct("state", "candidate", F.col("candidate_days").cast("int").alias("candidate_days")).alias("_p"))
        rows = raw.join(held, "theme_id", "left")
    first_row = F.row_number().over(by_theme) == 1
    prev = F.when(first_row, F.col("_p")["candidate"]).otherwise(F.lag("raw_state").over(by_theme))
    known_before = F.when(first_row, F.col("_p")["state"].isNotNull()).otherwise(F.lag("raw_state").over(by_theme).isNotNull())
    rows = (
        rows.withColumn("_opens", F.col("raw_state").isNotNull() & ~F.coalesce(known_before, F.lit(False)))
        .withColumn("_change", (F.col("_opens") | ~F.col("raw_state").eqNullSafe(prev)).cast("int"))
        .withColumn("_head", F.when(first_row & (F.col("_change") == 0), F.coalesce(F.col("_p")["candidate_days"], F.lit(0))).otherwise(0))
        .withColumn("_run", F.sum("_change").over(so_far))
        .withColumn("_segment", F.sum(F.col("_opens").cast("int")).over(so_far))
    )
    in_run = Window.partitionBy("theme_id", "_run").orderBy("as_of").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_day", F.count(F.lit(1)).over(in_run) + F.max("_head").over(in_run))
    sets_state = F.when(
        F.col("raw_state").isNotNull() & (F.col("_opens") | (F.col("_day") >= confirm)), F.col("raw_state")
    )
    in_segment = Window.partitionBy("theme_id", "_segment").orderBy("as_of").rowsBetween(Window.unboundedPreceding, 0)
    start_state = F.when(F.col("_segment") == 0, F.col("_p")["state"])
    state = F.when(
        F.col("raw_state").isNotNull(),
        F.coalesce(F.last(sets_state, ignorenulls=True).over(in_segment), start_state),
    )
    rows = rows.withColumn("state", state)
    same = F.col("raw_state") == F.col("state")
    return rows.select(
        *raw.columns,
        "state",
        F.col("raw_state").alias("candidate"),
        F.when(F.col("raw_state").isNull(), 0)
        .when(F.col("_opens"), 1)
        .when(same, 0)
        .otherwise(F.col("_day"))
        .cast("int")
        .alias("candidate_days"),
        (F.coalesce(same, F.lit(False)) & ~F.col("_opens")).alias("confirmed"),
    )


def ticker_marks(bars: DataFrame, calendar: DataFrame, cfg=C.HEAT) -> DataFrame:
    """Breadth, activity and period-return marks of every ticker on every session."""
    breadth = S.breadth_marks(bars, cfg["breadth_ma"], cfg["breadth_change"])
    moves = S.period_returns(bars, cfg["return_days"]).withColumnRenamed(f"ret{cfg['return_days']}", "period_ret")
    price = S.marks_at(breadth.join(moves, ["ticker", "session"]), calendar)
    volume = S.marks_at(S.activity_marks(bars, cfg["history_days"], cfg["signal_days"]), calendar)
    return price.join(volume, ["ticker", "t"], "left")


def _mark_rows(sets: DataFrame, column: str, marks: DataFrame, keys: list[str]) -> DataFrame:
    return (
        sets.select(*keys, F.col("seq").alias("t"), F.posexplode(column).alias("rank", "ticker"))
        .join(marks, ["ticker", "t"], "left")
    )


def _breadth_aggs() -> list[Column]:
    has = F.col("above_past").isNotNull()
    return [
        F.count(F.when(has, 1)).alias("breadth_n"),
        F.coalesce(F.sum(F.when(has, F.col("above_now"))), F.lit(0)).alias("now_above"),
        F.coalesce(F.sum(F.when(has, F.col("above_past"))), F.lit(0)).alias("past_above"),
    ]


def _activity_aggs() -> list[Column]:
    return [
        F.count("stock_z").alias("activity_n"),
        F.median("stock_z").alias("median_z"),
        F.count(F.when(F.col("stock_z") > 0, 1)).alias("positive_z_n"),
        safe_div(
            F.max("recent_dv"), F.sum(F.when(F.col("recent_dv") > 0, F.col("recent_dv")))
        ).alias("max_share"),
    ]


def breadth(bars: DataFrame, members: DataFrame, as_of: DataFrame, calendar: DataFrame, cfg=C.HEAT) -> DataFrame:
    """Share of members above their own average, now and some bars ago."""
    marks = S.marks_at(S.breadth_marks(bars, cfg["breadth_ma"], cfg["breadth_change"]), calendar)
    sets = live_sets(members, as_of, calendar)
    out = _mark_rows(sets, "members", marks, ["theme_id", "as_of"]).groupBy("theme_id", "as_of").agg(*_breadth_aggs())
    n = F.col("breadth_n")
    return (
        out.withColumn("now_fraction", safe_div(F.col("now_above"), n))
        .withColumn("past_fraction", safe_div(F.col("past_above"), n))
        .withColumn("breadth_change", safe_div(F.col("now_above") - F.col("past_above"), n))
    )


def activity(bars: DataFrame, members: DataFrame, as_of: DataFrame, calendar: DataFrame, cfg=C.HEAT) -> DataFrame:
    """Median robust z of log dollar volume and its concentration."""
    marks = S.marks_at(S.activity_marks(bars, cfg["history_days"], cfg["signal_days"]), calendar)
    sets = live_sets(members, as_of, calendar)
    return _mark_rows(sets, "members", marks, ["theme_id", "as_of"]).groupBy("theme_id", "as_of").agg(*_activity_aggs())


def live_sets(members: DataFrame, as_of: DataFrame, calendar: DataFrame) -> DataFrame:
    """Members in force per (theme, as_of), in input order."""
    from tidemark.operators.dims import effective_at

    dates = as_of.select(F.col("as_of")).join(calendar.withColumnRenamed("session", "as_of"), "as_of")
    live = effective_at(members, dates).join(dates, "as_of")
    return live.groupBy("theme_id", "as_of", "seq").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "ticker"))), lambda e: e["ticker"]).alias("members")
    )


def _heat_scores(df: DataFrame, cfg) -> DataFrame:
    usable = F.col("has_frame") & (F.size("elig_heat") >= cfg["min_members"])
    change = safe_div(F.col("now_above") - F.col("past_above"), F.col("breadth_n"))
    w = F.lit(cfg["weight"])
    return (
        df.select("*", F.when(usable, F.col("rae_heat")).alias("risk_adjusted"), change.alias("breadth_change"))
        .select(
            "*",
            piecewise_score(F.col("risk_adjusted"), cfg["risk_adjusted"]).alias("return_score"),
            piecewise_score(F.col("breadth_change"), cfg["breadth"]).alias("breadth_score"),
            piecewise_score(F.col("median_z"), cfg["activity"]).alias("activity_score"),
        )
        .withColumn("heat_score", F.col("return_score") * w + F.col("breadth_score") * w + F.col("activity_score") * w)
    )


def heat_from(days: DataFrame, sets: DataFrame, marks: DataFrame, cfg=C.HEAT, lookback: int = C.LOOKBACK_BARS) -> DataFrame:
    """Heat with leave-one-out.

    The leave-one-out run is a second set of rows with the top mover removed; both variants
    share frames through their eligible sets, so nothing is evaluated recursively.
    """
    keys = ["theme_id", "as_of"]
    base = _mark_rows(sets, "members", marks, keys)
    top = base.where(F.col("period_ret").isNotNull()).groupBy(*keys).agg(
        F.max_by("ticker", F.struct("period_ret", (-F.col("rank")).alias("r"))).alias("top_mover"),
        F.count(F.lit(1)).alias("moves_n"),
        F.count(F.when(F.col("period_ret") > 0, 1)).alias("moves_up"),
    )
    kept = sets.join(top, keys, "left")
    without = lambda c: F.filter(c, lambda x: ~x.eqNullSafe(F.col("top_mover")))
    all_rows = kept.withColumn("variant", F.lit("all"))
    loo_rows = (
        kept.where(F.col("moves_n") >= 2)
        .withColumn("members", without("members"))
        .withColumn("elig_heat", without("elig_heat"))
        .where(F.size("members") > 0)
        .withColumn("variant", F.lit("loo"))
    )
    variants = all_rows.unionByName(loo_rows)
    ev = _evaluate(
        days, variants, {"heat": cfg["return_days"]}, [{"rae_heat": S.risk_adjusted_excess(cfg["return_days"])}], lookback
    )["heat"]
    vkeys = ["theme_id", "as_of", "variant"]
    flags = (
        _mark_rows(variants.select(*vkeys, "seq", "members", "elig_heat"), "members", marks, vkeys)
        .join(
            variants.select(*vkeys, F.explode("elig_heat").alias("ticker")).withColumn("_in", F.lit(1)),
            [*vkeys, "ticker"], "left",
        )
        .groupBy(*vkeys)
        .agg(
            *_breadth_aggs(), *_activity_aggs(),
            F.count(
                F.when(F.col("_in").isNotNull() & F.col("above_past").isNotNull() & F.col("stock_z").isNotNull(), 1)
            ).alias("heat_n"),
        )
    )
    scored = _heat_scores(ev.join(flags, vkeys), cfg)
    loo = scored.where(F.col("variant") == "loo").select(*keys, F.col("heat_score").alias("_loo"))
    out = scored.where(F.col("variant") == "all").join(loo, keys, "left")
    moves_n, moves_up = F.coalesce("moves_n", F.lit(0)), F.coalesce("moves_up", F.lit(0))
    has_loo = F.col("heat_score").isNotNull() & (moves_n >= 2)
    loo_score = F.when(has_loo, F.col("_loo"))
    loo_ok = F.coalesce(loo_score >= cfg["loo_min"], F.lit(False))
    spread_ok = F.coalesce(F.col("max_share") <= cfg["max_share"], F.lit(False))
    hot_score = F.coalesce(F.col("heat_score") >= cfg["hot"], F.lit(False))
    enough = F.col("heat_n") >= cfg["hot_members"]
    majority = (moves_n >= cfg["min_members"]) & (moves_up > moves_n / 2)
    return out.select(
        *keys, "heat_score", F.col("heat_n"), "risk_adjusted", "breadth_change", "median_z",
        "return_score", "breadth_score", "activity_score", "now_above", "past_above", "breadth_n",
        "positive_z_n", "activity_n", "max_share", moves_up.alias("moves_up"), moves_n.alias("moves_n"),
        F.when(has_loo, F.col("top_mover")).alias("removed"), loo_score.alias("loo_score"),
        enough.alias("hot_eligible"),
        (enough & hot_score & majority & loo_ok & spread_ok).alias("hot"),
        (enough & hot_score & (~loo_ok | ~spread_ok)).alias("single_stock_driven"),
    )


def heat(
    bars: DataFrame, members: DataFrame, as_of: DataFrame, calendar: DataFrame, cfg=C.HEAT,
    lookback: int = C.LOOKBACK_BARS,
) -> DataFrame:
    # Both variants and every factor read these: written once instead of recomputed.
    days = cut_lineage(S.member_days(bars, members, lookback))
    sets = cut_lineage(S.eligible_sets(days, as_of, {"heat": cfg["return_days"]}))
    return heat_from(days, sets, cut_lineage(ticker_marks(bars, calendar, cfg)), cfg, lookback)


def turning_floor(cfg=C.TURNING) -> int:
    return cfg["history"] + cfg["window"]


def turning_measures(cfg=C.TURNING) -> list[dict[str, Column]]:
    w = S.frame_window()
    hist, win = cfg["history"], cfg["window"]
    trail = F.col("_trail")
    at_or_below = F.size(F.filter(trail, lambda x: x <= F.element_at(trail, -1)))
    low_row = F.min(F.struct(F.col("_rel"), F.col("_row"))).over(w.rowsBetween(-(win - 1), 0))["_row"]
    return [
        {
            "_excess": S.cumulative_return("theme_ret", win) - S.cumulative_return("bench_ret", win),
            "_wealth": S.theme_wealth(),
            "_rel": S.relative_wealth(),
            "_row": F.row_number().over(w),
        },
        {
            "_trail": F.collect_list("_excess").over(w.rowsBetween(-(hist - 1), 0)),
            "drawdown": F.col("_wealth") / F.max("_wealth").over(w.rowsBetween(-(hist - 1), 0)) - 1,
            "days_since_low": F.col("_row") - low_row,
        },
        {"rs_percentile": F.when(F.size(trail) == hist, at_or_below / F.size(trail))},
    ]


def turning_from(ev: DataFrame, velocity: DataFrame, heat_rows: DataFrame, stress: DataFrame, cfg=C.TURNING) -> DataFrame:
    """Rule-based turning watch from frame measures, velocity, heat and the stress flag."""
    keys = ["theme_id", "as_of"]
    by_theme = Window.partitionBy("theme_id").orderBy("as_of")
    vel = velocity.select(*keys, "raw_state", F.lag("state").over(by_theme).alias("_prior_state"))
    hot = heat_rows.select(*keys, F.col("breadth_change").alias("_breadth"), "single_stock_driven")
    eligible = F.col("has_frame") & (F.size("elig_turning") >= cfg["min_members"]) & F.col("rs_percentile").isNotNull()
    pct, dd = F.when(eligible, F.col("rs_percentile")), F.when(eligible, F.col("drawdown"))
    low_ok = F.when(eligible, F.col("days_since_low") >= cfg["no_new_low"])
    is_low = F.coalesce(pct <= cfg["percentile"], F.lit(False))
    is_deep = F.coalesce(dd <= cfg["drawdown"], F.lit(False))
    moved = F.coalesce((F.col("raw_state") == "Improving") & (F.col("_prior_state") == "Lagging"), F.lit(False))
    wider = F.coalesce(F.col("_breadth") > cfg["breadth_min"], F.lit(False))
    held = F.coalesce(low_ok, F.lit(False))
    alone = F.coalesce("single_stock_driven", F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when(is_low, "RS oversold"), F.when(is_deep, "deep drawdown"),
            F.when(moved, "Lagging→Improving"), F.when(wider, "breadth recovering"),
            F.when(held, "no new relative low"),
        )
    )
    return (
        ev.join(vel, keys, "left").join(hot, keys, "left").join(stress.select("as_of", "stress_active"), "as_of", "left")
        .select(
            *keys, eligible.alias("turning_eligible"), pct.alias("rs_percentile"), dd.alias("drawdown"),
            held.alias("no_new_low"),
            F.when(eligible, reasons).otherwise(F.array().cast("array<string>")).alias("reasons"),
            (eligible & (is_low | is_deep) & moved & wider & held & ~alone).alias("turning_active"),
            F.coalesce("stress_active", F.lit(False)).alias("stress_caution"),
        )
    )


def turning(
    bars: DataFrame, members: DataFrame, velocity: DataFrame, heat_rows: DataFrame, stress: DataFrame,
    as_of: DataFrame, cfg=C.TURNING, lookback: int = C.LOOKBACK_BARS,
) -> DataFrame:
    floors = {"turning": turning_floor(cfg)}
    days = S.member_days(bars, members, lookback)
    sets = S.eligible_sets(days, as_of, floors)
    ev = _evaluate(days, sets, floors, turning_measures(cfg), lookback)["turning"]
    return turning_from(ev, velocity, heat_rows, stress, cfg)


def median_correlation(window: int):
    """Grouped Arrow aggregate: median pairwise correlation of the themes' last returns.

    One group is one date: (themes x window) rows, bounded by the theme configuration. The
    correlation matrix lives inside the task, so no pair rows are ever shuffled.
    """
    import numpy as np

    @F.pandas_udf("double")
    def run(theme: pd.Series, seq: pd.Series, ret: pd.Series) -> float:
        wide = pd.DataFrame({"k": theme, "s": seq, "r": ret}).pivot(index="s", columns="k", values="r").dropna()
        if wide.shape[1] < 3 or len(wide) < window:
            return None
        x = wide.to_numpy()
        x = x - x.mean(axis=0)
        norm = np.sqrt((x * x).sum(axis=0))
        x = x[:, norm > 0] / norm[norm > 0]
        corr = (x.T @ x)[np.triu_indices(x.shape[1], k=1)]
        return float(np.median(corr)) if len(corr) else None

    return run


def selection(
    bars: DataFrame, members: DataFrame, as_of: DataFrame, cfg=C.SELECTION, lookback: int = C.LOOKBACK_BARS
) -> DataFrame:
    """Cross-theme dispersion, median correlation and share ahead of the market.

    `members` holds ranked themes only, all against the market benchmark.
    """
    floors = {"selection": cfg["min_returns"]}
    win, corr_n = cfg["returns"], cfg["correlation"]
    days = S.member_days(bars, members, lookback)
    sets = S.eligible_sets(days, as_of, floors)
    tail = F.collect_list(F.struct(F.col("seq").alias("s"), F.col("theme_ret").alias("r"))).over(
        S.frame_window().rowsBetween(-(corr_n - 1), 0)
    )
    measures = [
        {
            "theme_cum": S.cumulative_return("theme_ret", win),
            "bench_cum": S.cumulative_return("bench_ret", win),
            "tail": tail,
        }
    ]
    ev = _evaluate(days, sets, floors, measures, lookback)["selection"]
    rows = ev.where(F.col("has_frame") & (F.size("elig_selection") >= cfg["min_members"]) & F.col("theme_cum").isNotNull())
    per_day = rows.groupBy("as_of").agg(
        F.count(F.lit(1)).alias("themes_n"),
        F.stddev_pop("theme_cum").alias("dispersion"),
        F.avg((F.col("theme_cum") > F.col("bench_cum")).cast("double")).alias("outperform_fraction"),
    )
    corr = (
        rows.select("as_of", "theme_id", F.explode("tail").alias("e"))
        .groupBy("as_of")
        .agg(median_correlation(corr_n)("theme_id", "e.s", "e.r").alias("median_correlation"))
    )
    enough = F.coalesce(F.col("themes_n") >= cfg["min_themes"], F.lit(False))
    out = as_of.select("as_of").join(per_day, "as_of", "left").join(corr, "as_of", "left")
    d, c = F.col("dispersion"), F.col("median_correlation")
    label = (
        F.when(~enough, "UNAVAILABLE")
        .when(c.isNotNull() & (d >= cfg["high_dispersion"]) & (c <= cfg["high_max_correlation"]), "HIGH")
        .when(c.isNotNull() & ((d <= cfg["low_dispersion"]) | (c >= cfg["low_min_correlation"])), "LOW")
        .otherwise("NORMAL")
    )
    return out.select(
        "as_of", label.alias("label"), F.when(enough, d).alias("dispersion"),
        F.when(enough, c).alias("median_correlation"),
        F.when(enough, F.col("outperform_fraction")).alias("outperform_fraction"),
        F.coalesce("themes_n", F.lit(0)).alias("themes_n"),
    )


def data_quality(sets: DataFrame, bars: DataFrame, heat_rows: DataFrame, modes: DataFrame) -> DataFrame:
    """ok / thin / insufficient / watch_only with missing core tickers.

    `sets` needs `members` and `elig_strength`; `modes` maps theme_id to score_mode.
    """
    keys = ["theme_id", "as_of"]
    first_bar = bars.groupBy("ticker").agg(F.min("session").alias("_first"))
    missing = (
        sets.select(*keys, F.posexplode("members").alias("rank", "ticker"))
        .join(first_bar, "ticker", "left")
        .where(F.col("_first").isNull() | (F.col("_first") > F.col("as_of")))
        .groupBy(*keys)
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "ticker"))), lambda e: e["ticker"]).alias("missing_core"))
    )
    s_n, h_n, mode = F.size("elig_strength"), F.coalesce("heat_n", F.lit(0)), F.col("score_mode")
    scored = mode.isin("ranked", "thin")
    status = (
        F.when(mode == "none", "watch_only")
        .when((mode == "ranked") & (s_n >= C.STRENGTH["min_ranked"]), "ok")
        .when((mode == "thin") & (s_n >= C.STRENGTH["min_thin"]), "thin")
        .when(~scored & (h_n >= C.HEAT["min_members"]), "ok")
        .otherwise("insufficient")
    )
    return (
        sets.join(modes.select("theme_id", "score_mode"), "theme_id")
        .join(heat_rows.select(*keys, "heat_n"), keys, "left")
        .join(missing, keys, "left")
        .select(
            *keys, "score_mode", status.alias("quality"), F.size("members").alias("core_total"),
            F.when(scored, s_n).otherwise(0).alias("strength_eligible_n"), h_n.alias("heat_eligible_n"),
            F.coalesce("missing_core", F.array().cast("array<string>")).alias("missing_core"),
        )
    )


def theme_momentum(scores: DataFrame, cfg=C.MOMENTUM) -> DataFrame:
    """Score against the score 15 rows earlier, in five bands."""
    w = Window.partitionBy("theme_id").orderBy("as_of")
    delta = F.col("score") - F.lag("score", cfg["lag"]).over(w)
    rows = scores.withColumn("delta", delta)
    d = F.col("delta")
    label = (
        F.when(d.isNull(), None)
        .when(d >= cfg["large"], "Rapidly Improving")
        .when(d >= cfg["small"], "Improving")
        .when(d > -cfg["small"], "Stable")
        .when(d > -cfg["large"], "Deteriorating")
        .otherwise("Rapidly Deteriorating")
    )
    return rows.withColumn("momentum_label", label)


def theme_snapshot(
    themes: DataFrame, memberships: DataFrame, bars: DataFrame, stress: DataFrame, as_of: DataFrame,
    calendar: DataFrame, prior: DataFrame | None = None, lookback: int = C.LOOKBACK_BARS,
) -> DataFrame:
    """All signals of all themes on all dates as one nested row per (theme, as_of).

    Member days, eligible sets and frames are computed once for every signal. Score modes and
    classes gate the parts: `none` themes carry no signals, strength needs ranked or thin,
    turning needs a structural or tactical class.
    """
    keys = ["theme_id", "as_of"]
    members = core_members(themes, memberships)
    # Read by every signal below: written once instead of recomputed per signal.
    days = cut_lineage(S.member_days(bars, members, lookback))
    floors = {
        "strength": C.STRENGTH["window"], "velocity": velocity_floor(), "turning": turning_floor(),
        "heat": C.HEAT["return_days"],
    }
    sets = cut_lineage(S.eligible_sets(days, as_of, floors))
    shared = {k: floors[k] for k in ("strength", "velocity", "turning")}
    v, t = velocity_measures(), turning_measures()
    measures = [{**strength_measures()[0], **v[0], **t[0]}, {**v[1], **t[1]}, t[2]]
    ev = _evaluate(days, sets, shared, measures, lookback)
    modes = themes.select("theme_id", "score_mode", "theme_class")
    st = strength_from(ev["strength"].join(modes, "theme_id"), F.col("score_mode"))
    vel = velocity_confirmed(velocity_from(ev["velocity"]), prior=prior)
    marks = cut_lineage(ticker_marks(bars, calendar))
    hot = cut_lineage(heat_from(days, sets.drop("elig_strength", "elig_velocity", "elig_turning"), marks, lookback=lookback))
    turn = turning_from(ev["turning"], vel, hot, stress)
    quality = data_quality(sets, bars, hot, modes)
    on, scored, turns = F.col("score_mode") != "none", F.col("score_mode").isin("ranked", "thin"), F.col("theme_class").isin("structural", "tactical")

    def part(df: DataFrame, name: str) -> DataFrame:
        cols = [c for c in df.columns if c not in keys]
        return df.select(*keys, F.struct(*cols).alias(name))

    out = quality.join(themes.select("theme_id", "theme_class", "name", "family"), "theme_id")
    for df, name in ((st, "strength"), (vel, "velocity"), (hot, "heat"), (turn, "turning")):
        out = out.join(part(df, name), keys, "left")
    gate = {"strength": scored, "velocity": on, "heat": on, "turning": on & turns}
    for name, cond in gate.items():
        out = out.withColumn(name, F.when(cond, F.col(name)))
    return out.join(sets.select(*keys, F.col("members").alias("core_members")), keys)
