"""Point-in-time samples, walk-forward fits, bands and price outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import BASIS, HORIZONS
from tidemark.functions.scoring import is_finite, positive, safe_div
from tidemark.operators.keyed import asof_join, order_statistics, running, violations


def session_days(sessions: DataFrame) -> DataFrame:
    """Calendar day -> number of the first session on or after it (covered days only)."""
    from pyspark.sql import Window

    w = Window.orderBy("seq")  # one row per session
    s = sessions.select("session", "seq", F.date_add(F.lag("session").over(w), 1).alias("_after"))
    return s.select(F.explode(F.sequence(F.coalesce("_after", "session"), "session")).alias("day"), F.col("seq").alias("next_seq"))


def session_window(events: DataFrame, sessions: DataFrame, horizon: Column) -> DataFrame:
    """First `horizon` sessions that open strictly after issued_at; `window_error` where not covered.

    Looked up by calendar day and session number: equality joins only.
    """
    s = sessions.select("seq", "session", "open_ts", "close_ts")
    ev = events.withColumn("_day", F.to_date("issued_at")).withColumn("_h", horizon)
    ev = ev.join(session_days(sessions).withColumnRenamed("day", "_day"), "_day", "left")
    first = s.select(F.col("seq").alias("next_seq"), F.col("open_ts").alias("_open"))
    ev = ev.join(first, "next_seq", "left")
    entry = F.when(F.col("_open") > F.col("issued_at"), F.col("next_seq")).otherwise(F.col("next_seq") + 1)
    ev = ev.withColumn("entry_seq", entry).withColumn("exit_seq", F.col("entry_seq") + F.col("_h") - 1)
    a = s.select(F.col("seq").alias("entry_seq"), F.col("session").alias("entry_session"), F.col("open_ts").alias("entry_at"))
    b = s.select(F.col("seq").alias("exit_seq"), F.col("session").alias("exit_session"), F.col("close_ts").alias("exit_at"))
    out = ev.join(a, "entry_seq", "left").join(b, "exit_seq", "left")
    error = (
        F.when(~F.col("_h").isin(*HORIZONS), "unsupported horizon").when(F.col("next_seq").isNull(), "issue outside calendar coverage")
        .when(F.col("exit_at").isNull(), "calendar does not cover maturity")
    )
    return out.withColumn("window_error", error).drop("_day", "_h", "next_seq", "_open")


def pit_asof_join(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, values: list[str], strict: bool = True) -> DataFrame:
    """Latest right row known before each left row."""
    return asof_join(left, right, on, left_ts, right_ts, values, strict=strict)


def build_samples(
    observations: DataFrame, evaluations: DataFrame, manifests: DataFrame, outcomes: DataFrame, sessions: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Training samples and, for every other outcome, the first rule it broke.

    Features are the latest observation of the manifest's session known before the label
    window opened; the sample is anchored at the later of the two availabilities.
    """
    seen = outcomes.groupBy("evaluation_id").agg(F.min("outcome_id").alias("_first_id"))
    rows = (
        outcomes.join(seen, "evaluation_id").join(evaluations, "evaluation_id", "left").join(manifests, "manifest_id", "left")
    )
    rows = session_window(rows.withColumn("issued_at", F.col("anchor_at")), sessions, F.col("horizon"))
    rows = rows.select(
        "outcome_id", "evaluation_id", "_first_id", "outcome_version", "scored_at", "excess_return", "outcome_basis", "theme_id", "horizon",
        "manifest_id", "anchor_at", "members", "benchmark", "session", "captured_at", "window_error",
        F.col("entry_at").alias("_open0"), F.col("entry_seq").alias("_seq0"),
    )
    obs = observations.select(
        "theme_id", F.col("data_as_of").alias("session"), "known_at", "observation_id", "source_hash", "content_hash", "metric_known_at",
        "membership_hash", F.col("core").alias("o_core"), "metric_as_of", "feature", "coverage", "status", "basis",
    )
    values = [c for c in obs.columns if c not in ("theme_id", "session")]
    rows = pit_asof_join(rows, obs, ["theme_id", "session"], "_open0", "known_at", values)
    rows = rows.withColumn("issued_at", F.greatest("anchor_at", "known_at"))
    rows = session_window(rows, sessions, F.col("horizon"))
    reason = F.coalesce(
        F.when(F.col("outcome_version") != 1, "explicit_correction_selection_required"),
        F.when(F.col("theme_id").isNull(), "unknown_evaluation"),
        F.when(F.col("outcome_id") != F.col("_first_id"), "duplicate_outcome"),
        F.when(F.col("captured_at").isNull(), "unknown_manifest"),
        F.when(F.col("captured_at") != F.col("anchor_at"), "anchor_mismatch"),
        F.col("window_error"),
        F.when(F.col("observation_id").isNull(), "no_point_in_time_features"),
        F.when(F.col("source_hash") != F.col("content_hash"), "source_hash_mismatch"),
        F.when(F.col("metric_known_at") > F.col("known_at"), "future_metric_source"),
        F.when(~F.sort_array("o_core").eqNullSafe(F.sort_array("members")), "core_changed"),
        F.when(~F.col("metric_as_of").eqNullSafe(F.col("session")), "as_of_mismatch"),
        F.when(F.col("entry_seq") != F.col("_seq0"), "calendar_mismatch"),
        F.when((F.coalesce("coverage", F.lit(0.0)) != 1) | ~F.col("status").eqNullSafe("ok"), "incomplete_input"),
        F.when(~is_finite(F.col("feature")), "missing_feature"),
        F.when(~is_finite(F.col("excess_return")), "missing_outcome"),
        F.when(~F.col("outcome_basis").eqNullSafe(F.col("basis")), "label_basis_mismatch"),
        F.when(F.col("exit_at") > F.col("scored_at"), "invalid_label_time"),
    )
    rows = rows.withColumn("reason", reason)
    samples = rows.where(F.col("reason").isNull()).select(
        "theme_id", "horizon", F.col("observation_id").alias("input_manifest"), "issued_at", "known_at", "session", "entry_session", "entry_at",
        "exit_at", F.col("scored_at").alias("outcome_known_at"), "feature", "excess_return", "membership_hash", "benchmark", "basis",
    )
    unresolved = rows.where(F.col("reason").isNotNull()).select(F.col("outcome_id").alias("reference"), "reason")
    return samples, unresolved


def validate_samples(samples: DataFrame) -> DataFrame:
    """Violations of time order, horizon, identity and a single price basis."""
    ident = F.concat_ws("|", "theme_id", "input_manifest", F.col("horizon").cast("string"))
    order = (
        (F.col("issued_at") < F.col("entry_at")) & (F.col("entry_at") < F.col("exit_at")) & (F.col("exit_at") <= F.col("outcome_known_at"))
    )
    none = F.lit(None)
    out = violations(samples, "invalid_label_time", ~order, ident, none)
    out = out.unionByName(violations(samples, "future_input", F.col("known_at") > F.col("issued_at"), ident, none))
    out = out.unionByName(violations(samples, "invalid_horizon", ~F.col("horizon").isin(*HORIZONS), ident, F.col("horizon")))
    out = out.unionByName(violations(samples, "missing_feature", ~is_finite(F.col("feature")), ident, none))
    dup = samples.groupBy(ident.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    out = out.unionByName(violations(dup, "duplicate_sample", F.col("n") > 1, F.col("k"), F.col("n")))
    basis = samples.groupBy("horizon").agg(F.min("basis").alias("a"), F.max("basis").alias("b"))
    return out.unionByName(violations(basis, "mixed_price_basis", F.col("a") != F.col("b"), F.col("horizon"), F.col("b")))


def _line(n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column, lo: Column, hi: Column) -> tuple[Column, Column, Column]:
    """Slope, intercept and mean from sums; a constant x gives slope 0 and the mean."""
    varied = lo < hi
    slope = F.when(varied, (n * sxy - sx * sy) / F.when(varied, n * sxx - sx * sx)).otherwise(0.0)
    return slope, (sy - slope * sx) / n, sy / n


def fit_ols(samples: DataFrame, keys: list[str], x: str = "feature", y: str = "excess_return") -> DataFrame:
    """Least squares per key; a constant x falls back to the mean."""
    out = samples.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("_s"), F.avg(y).alias("baseline"), F.avg(x).alias("_mx"), F.count(F.lit(1)).alias("n"),
        F.min(x).alias("x_min"), F.max(x).alias("x_max"),
    )
    slope = F.when(F.col("x_min") < F.col("x_max"), F.col("_s")).otherwise(0.0)
    return out.select(*keys, slope.alias("slope"), (F.col("baseline") - slope * F.col("_mx")).alias("intercept"), "baseline", "n", "x_min", "x_max")


def walk_forward(samples: DataFrame, keys: list[str], min_train_sessions: int) -> DataFrame:
    """Out-of-sample prediction of every sample from what was known strictly before its issue time.

    Training sets only grow, so each one is a running sum over outcomes in order of
    availability (n, sums, extremes, first-seen entry sessions); a sample reads the sums as of
    its issue time. Linear in samples, no time-inequality join.
    """
    known = F.greatest("exit_at", "outcome_known_at")
    x, y = F.col("feature"), F.col("excess_return")
    rows = samples.select(
        *keys, known.alias("at"), "entry_session", F.lit(1).alias("n"), x.alias("sx"), y.alias("sy"), (x * x).alias("sxx"), (x * y).alias("sxy"),
        x.alias("lo"), x.alias("hi"),
    )
    stats = rows.groupBy(*keys, "at").agg(
        *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")], F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    first = rows.groupBy(*keys, "entry_session").agg(F.min("at").alias("at")).groupBy(*keys, "at").agg(F.count(F.lit(1)).alias("sessions"))
    stats = stats.join(first, [*keys, "at"], "left").withColumn("sessions", F.coalesce("sessions", F.lit(0)))
    stats = stats.withColumn("_bucket", F.date_trunc("month", "at"))
    folds = {c: ("sum", c) for c in ("n", "sx", "sy", "sxx", "sxy", "sessions")} | {"lo": ("min", "lo"), "hi": ("max", "hi")}
    state = running(stats, keys, "_bucket", ["at"], folds)
    times = samples.select(*keys, "issued_at").distinct()
    seen = asof_join(times, state, keys, "issued_at", "at", list(folds), strict=True)
    slope, intercept, mean = _line(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "sxy", "lo", "hi")])
    models = seen.where(F.col("sessions") >= min_train_sessions).select(
        *keys, "issued_at", slope.alias("slope"), intercept.alias("intercept"), mean.alias("baseline"),
        F.col("n").alias("train_n"), F.col("sessions").alias("train_sessions"),
    )
    out = samples.join(models, [*keys, "issued_at"])
    prediction = F.col("intercept") + F.col("slope") * x
    return out.select(
        *samples.columns, "baseline", "train_n", "train_sessions", prediction.alias("prediction"), (y - prediction).alias("residual")
    )


def fit_model(
    samples: DataFrame, keys: list[str], trained_at: Column, min_train_sessions: int = 120, min_oos_sessions: int = 60
) -> tuple[DataFrame, DataFrame]:
    """One model row per key and its out-of-sample rows."""
    train = samples.where(F.col("outcome_known_at") < trained_at)
    oos = walk_forward(train, keys, min_train_sessions)
    size = train.groupBy(*keys).agg(F.countDistinct("entry_session").alias("train_sessions"))
    perf = oos.groupBy(*keys).agg(
        F.countDistinct("entry_session").alias("oos_sessions"), F.avg(F.abs("residual")).alias("mae"),
        F.avg(F.abs(F.col("excess_return") - F.col("baseline"))).alias("baseline_mae"),
    )
    # Residual order statistics for the empirical band.
    band = order_statistics(oos, keys, "residual", {"band_low": 0.1, "band_high": 0.9})
    m = fit_ols(train, keys).join(size, keys).join(perf, keys, "left").join(band, keys, "left")
    enough = F.col("train_sessions") >= min_train_sessions
    ready = enough & (F.coalesce("oos_sessions", F.lit(0)) >= min_oos_sessions)
    m = m.withColumn("status", F.when(ready, "research_ready").otherwise("insufficient")).withColumn(
        "reason",
        F.when(~enough, "insufficient_matured_history").when(~ready, "insufficient_oos_history").otherwise("human_review_required"),
    )
    m = m.withColumn("improves_mean_baseline", F.coalesce(F.col("mae") < F.col("baseline_mae"), F.lit(False)))
    basis = train.groupBy(*keys).agg(F.min("basis").alias("model_basis"))
    return m.join(basis, keys).withColumn("trained_at", trained_at), oos


def predict(models: DataFrame, snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """Prediction with an empirical residual band, or an abstention with its reason."""
    rows = snapshots.join(models, keys)
    reason = F.coalesce(
        F.when(F.col("trained_at") > F.col("issued_at"), "future_model"),
        F.when(F.col("status") != "research_ready", F.col("reason")),
        F.when(~F.col("model_basis").eqNullSafe(F.col("basis")), "price_basis_changed"),
        F.when(~F.coalesce(F.col("feature").between(F.col("x_min"), F.col("x_max")), F.lit(False)), "outside_training_range"),
    )
    value = F.when(reason.isNull(), F.col("intercept") + F.col("slope") * F.col("feature"))
    return rows.select(
        *snapshots.columns, F.when(reason.isNull(), "research_prediction").otherwise("forecast_abstention").alias("kind"),
        reason.alias("abstain_reason"), value.alias("expected"), (value + F.col("band_low")).alias("lower"), (value + F.col("band_high")).alias("upper"),
    )


def decide(predictions: DataFrame, holding: Column, cost: Column) -> DataFrame:
    """Paper decision from the band against a round-trip cost."""
    usable = F.col("kind") == "research_prediction"
    priced = F.coalesce(cost >= 0, F.lit(False))
    code = (
        F.when(~(usable & priced), "insufficient")
        .when(F.col("lower") > cost, F.when(holding, "hold_candidate").otherwise("buy_candidate"))
        .when(F.col("upper") < -cost, F.when(holding, "reduce_candidate").otherwise("avoid_candidate"))
        .otherwise("wait")
    )
    why = F.when(~usable, "forecast_unavailable").when(~priced, "cost_assumption_required").otherwise("band_relative_to_cost")
    return predictions.withColumn("decision", code).withColumn("decision_reason", why)


def basket_paths(predictions: DataFrame, bars: DataFrame) -> DataFrame:
    """Buy-and-hold paths of every basket and its benchmark from the first open.

    `predictions`: prediction_id, entry_seq, exit_seq, members (array of ticker, weight),
    benchmark. `bars`: ticker, seq, open, close. Adds an `incomplete` reason instead of
    reweighting: one missing member or session voids the outcome.
    """
    legs = F.concat(
        F.transform("members", lambda m: F.struct(m["ticker"].alias("ticker"), m["weight"].alias("w"), F.lit(False).alias("bench"))),
        F.array(F.struct(F.col("benchmark").alias("ticker"), F.lit(1.0).alias("w"), F.lit(True).alias("bench"))),
    )
    rows = (
        predictions.select("prediction_id", "entry_seq", "exit_seq", F.explode(legs).alias("l"))
        .select("prediction_id", "entry_seq", "exit_seq", "l.*")
        .withColumn("seq", F.explode(F.sequence("entry_seq", "exit_seq")))
    )
    rows = rows.join(bars.select("ticker", "seq", "open", "close"), ["ticker", "seq"], "left")
    good = F.coalesce(F.col("close") >= 0, F.lit(False)) & is_finite(F.col("close"))
    path = F.sort_array(F.collect_list(F.when(good, F.struct("seq", "close"))))
    per_leg = rows.groupBy("prediction_id", "ticker", "bench", "w").agg(
        F.max(F.when((F.col("seq") == F.col("entry_seq")) & positive(F.col("open")), F.col("open"))).alias("entry_open"),
        path.alias("path"), F.count(F.lit(1)).alias("want"),
    )
    bad = F.coalesce(
        F.when(F.size("path") < F.col("want"), F.concat(F.lit("missing session: "), F.col("ticker"))),
        F.when(F.col("entry_open").isNull(), F.concat(F.lit("invalid entry: "), F.col("ticker"))),
    )
    steps = per_leg.withColumn("_bad", bad).select(
        "prediction_id", "bench", "w", "entry_open", "_bad", F.explode_outer("path").alias("p")
    )
    r = safe_div(F.col("p.close"), F.col("entry_open")) - 1
    daily = steps.groupBy("prediction_id", F.col("p.seq").alias("seq")).agg(
        F.sum(F.when(~F.col("bench"), r * F.col("w"))).alias("theme"), F.max(F.when(F.col("bench"), r)).alias("bench"),
        F.min("_bad").alias("_bad"),
    )
    return daily.groupBy("prediction_id").agg(
        F.min("_bad").alias("incomplete"), F.max_by("theme", "seq").alias("theme_return"), F.max_by("bench", "seq").alias("benchmark_return"),
        F.greatest(F.lit(0.0), F.max("theme")).alias("max_favorable"), F.least(F.lit(0.0), F.min("theme")).alias("max_adverse"),
    )


def score_prediction(predictions: DataFrame, bars: DataFrame) -> DataFrame:
    """Price outcome of each prediction: excess, excursions, error and direction."""
    out = predictions.join(basket_paths(predictions, bars), "prediction_id")
    ok = F.col("incomplete").isNull()
    excess = F.when(ok, F.col("theme_return") - F.col("benchmark_return"))
    return out.select(
        *predictions.columns, F.when(ok, "scored").otherwise("unresolved").alias("outcome_status"), F.col("incomplete").alias("outcome_reason"),
        *[F.when(ok, F.col(c)).alias(c) for c in ("theme_return", "benchmark_return", "max_favorable", "max_adverse")],
        excess.alias("excess_return"), (excess - F.col("expected")).alias("prediction_error"),
        F.when(F.col("expected") != 0, excess * F.col("expected") > 0).alias("direction_correct"),
    )


def basis_text(df: DataFrame) -> Column:
    """The five price-basis columns as one comparable text."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in BASIS])
