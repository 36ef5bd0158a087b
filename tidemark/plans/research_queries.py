"""Point-in-time research and the prediction ledger over theme baskets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import display as D
from tidemark.operators import ledger as L
from tidemark.operators import research as PT
from tidemark.plans import views as V
from tidemark.plans.catalog import flat, query
from tidemark.plans.theme_queries import day
from tidemark.plans.views import kept, r, staged, with_views

TRAINED = "2001-07-01 00:00:00"


def _ts(text):
    return F.to_timestamp(F.lit(text))


def _horizon(c):
    return F.element_at(F.array(F.lit(5), F.lit(20), F.lit(60)), (c % 3 + 1).cast("int"))


@query(
    "session_window",
    with_views(
        f"""SELECT o.o_orderkey, CASE WHEN CAST(o.at AS DATE) BETWEEN (SELECT min(session) FROM sessions) AND (SELECT max(session) FROM sessions) THEN CAST(s.session AS VARCHAR) END AS entry_session,
                   CASE WHEN CAST(o.at AS DATE) BETWEEN (SELECT min(session) FROM sessions) AND (SELECT max(session) FROM sessions) THEN CAST(x.session AS VARCHAR) END AS exit_session,
                   CASE WHEN CAST(o.at AS DATE) < (SELECT min(session) FROM sessions) OR CAST(o.at AS DATE) > (SELECT max(session) FROM sessions)
                        THEN 'issue outside calendar coverage' WHEN x.seq IS NULL THEN 'calendar does not cover maturity' END AS window_error
            FROM (SELECT o_orderkey, [5, 20, 60][o_orderkey % 3 + 1] AS h, CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 24) * INTERVAL '1 hour' AS at FROM orders) o
            ASOF LEFT JOIN sessions s ON o.at < s.open_ts LEFT JOIN sessions x ON x.seq = s.seq + o.h - 1"""
    ),
)
def session_window(spark, d):
    o = V.table(spark, d, "orders")
    at = F.col("o_orderdate").cast("timestamp") + F.expr("make_dt_interval(0, cast(o_orderkey % 24 as int))")
    out = PT.session_window(o.select("o_orderkey", at.alias("issued_at")), V.sessions(spark, d), _horizon(F.col("o_orderkey")))
    return flat(out.select("o_orderkey", "entry_session", "exit_session", "window_error"))


@query(
    "pit_asof_join",
    """SELECT l.event_id, r.event_id AS seen_event, round(r.value, 4) + 0.0 AS seen_value
       FROM (SELECT * FROM events WHERE event_type <> 'view') l
       ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.ts > r.ts""",
)
def pit_asof_join(spark, d):
    ev = V.table(spark, d, "events")
    left = ev.where(F.col("event_type") != "view").select("event_id", "user_id", "ts")
    right = ev.where(F.col("event_type") == "view").select("user_id", F.col("ts").alias("seen_at"), F.col("event_id").alias("seen_event"), F.col("value").alias("seen_value"))
    out = PT.pit_asof_join(left, right, ["user_id"], "ts", "seen_at", ["seen_event", "seen_value"])
    return flat(out.select("event_id", "seen_event", "seen_value"), 4)


@kept
def definitions(spark, d):
    """Two versions of each basket; T1's second one became known late."""
    core = V.memberships(spark, d).where(F.col("role") == "core")
    bench = F.lit("MKT").alias("benchmark")

    def version(cond, start, end, known):
        return core.where(cond).groupBy("theme_id").agg(F.sort_array(F.collect_list("ticker")).alias("members")).select(
            "theme_id", F.to_date(F.lit(start)).alias("valid_from"), F.to_date(F.lit(end)).alias("valid_to"), known.alias("known_at"), "members", bench
        )

    late = F.when(F.col("theme_id") == "T1", _ts("1998-06-01 00:00:00")).otherwise(_ts("1997-12-31 00:00:00"))
    return version(F.col("pos") % 5 != 3, "1990-01-01", "1998-01-01", _ts("1990-01-01 00:00:00")).unionByName(
        version(F.lit(True), "1998-01-01", None, late)
    )


@kept
def requests(spark, d):
    themes = V.themes(spark, d).select("theme_id")
    # Every theme on every session: spread sessions by theme through an array of the few theme ids.
    ids = themes.agg(F.sort_array(F.collect_set("theme_id")).alias("ids"))
    s = V.sessions(spark, d).join(F.broadcast(ids)).select("seq", "session", "close_ts", F.explode("ids").alias("theme_id"))
    s = s.withColumn("horizon", F.explode(F.array(F.lit(5), F.lit(20))))
    return s.select(
        F.concat_ws("-", "theme_id", F.col("seq").cast("string"), F.col("horizon").cast("string")).alias("request_id"), "theme_id", "horizon", "seq", "session",
        F.when(F.col("seq") % 2 == 0, "m1").otherwise("m2").alias("model_version"), (F.col("close_ts") + F.expr("INTERVAL 1 HOUR")).alias("issued_at"),
        ((F.col("seq") % 5 - 2) / 100).alias("expected"), F.lit(0.002).alias("theme_cost"), F.lit(0.001).alias("benchmark_cost"),
    )


def versions(spark):
    return spark.sql("SELECT 'm1' AS model_version, TIMESTAMP '1995-01-01 00:00:00' AS registered_at UNION ALL SELECT 'm2', TIMESTAMP '1996-01-01 00:00:00'")


def _ask(spark, d):
    return requests(spark, d).drop("seq", "session")


@staged
def predictions(spark, d):
    return L.issue_predictions(_ask(spark, d), definitions(spark, d), V.sessions(spark, d), versions(spark))[0]


def _price_bars(spark, d):
    return V.all_bars(spark, d).join(V.calendar(spark, d), "session")


_PT = {
    "defs": """SELECT theme_id, DATE '1990-01-01' AS vf, DATE '1998-01-01' AS vt, TIMESTAMP '1990-01-01' AS known, list(ticker ORDER BY ticker) AS members FROM core WHERE pos % 5 <> 3 GROUP BY 1
               UNION ALL SELECT theme_id, DATE '1998-01-01', NULL, CASE WHEN theme_id = 'T1' THEN TIMESTAMP '1998-06-01' ELSE TIMESTAMP '1997-12-31' END, list(ticker ORDER BY ticker) FROM core GROUP BY 1""",
    "asks": """SELECT t.theme_id || '-' || s.seq || '-' || h.h AS request_id, t.theme_id, h.h AS horizon, s.seq, s.session, s.close_ts + INTERVAL '1 hour' AS issued_at,
                      (s.seq % 5 - 2) / 100 AS expected, CASE WHEN s.seq % 2 = 0 THEN TIMESTAMP '1995-01-01' ELSE TIMESTAMP '1996-01-01' END AS registered
               FROM sessions s CROSS JOIN themes t CROSS JOIN (VALUES (5), (20)) h(h)""",
    "asked": """SELECT a.*, d.members, CASE WHEN CAST(a.issued_at AS DATE) <= (SELECT max(session) FROM sessions) THEN a.seq + 1 END AS es, a.seq + a.horizon AS xs, x.close_ts AS exit_at,
                       CASE WHEN a.registered > a.issued_at THEN 'future registered version' WHEN d.members IS NULL THEN 'definition not effective at issuance'
                            WHEN CAST(a.issued_at AS DATE) > (SELECT max(session) FROM sessions) THEN 'issue outside calendar coverage'
                            WHEN x.seq IS NULL THEN 'calendar does not cover maturity' END AS reason
                FROM asks a LEFT JOIN defs d ON d.theme_id = a.theme_id AND d.vf <= CAST(a.issued_at AS DATE) AND (d.vt IS NULL OR CAST(a.issued_at AS DATE) < d.vt) AND d.known <= a.issued_at
                LEFT JOIN sessions x ON x.seq = a.seq + a.horizon""",
    "preds": "SELECT * FROM asked WHERE reason IS NULL",
    "pbars": "SELECT b.ticker, s.seq, b.open, b.close FROM all_bars b JOIN sessions s USING (session)",
    "legs": """SELECT p.request_id, p.es, p.xs, u.t AS ticker, FALSE AS bench, 1.0 / len(p.members) AS w FROM preds p, LATERAL (SELECT unnest(p.members) AS t) u
               UNION ALL SELECT request_id, es, xs, 'MKT', TRUE, 1.0 FROM preds""",
    "leg_days": """SELECT l.*, b.seq, b.close / e.open - 1 AS ret FROM legs l LEFT JOIN pbars e ON e.ticker = l.ticker AND e.seq = l.es
                   LEFT JOIN pbars b ON b.ticker = l.ticker AND b.seq BETWEEN l.es AND l.xs""",
    "leg_bad": """SELECT request_id, min(bad) AS bad FROM (SELECT request_id, ticker, CASE WHEN count(seq) < any_value(xs - es + 1) THEN 'missing session: ' || ticker
                    WHEN count(ret) = 0 THEN 'invalid entry: ' || ticker END AS bad FROM leg_days GROUP BY 1, 2) GROUP BY 1""",
    "paths": "SELECT request_id, seq, sum(CASE WHEN NOT bench THEN ret * w END) AS th, max(CASE WHEN bench THEN ret END) AS be FROM leg_days WHERE seq IS NOT NULL GROUP BY 1, 2",
    "scored": """SELECT p.request_id, p.theme_id, p.horizon, p.seq, p.expected, p.exit_at, p.issued_at, p.es, p.members, b.bad, arg_max(x.th, x.seq) AS th, arg_max(x.be, x.seq) AS be,
                        greatest(0, max(x.th)) AS fav, least(0, min(x.th)) AS adv
                 FROM preds p JOIN leg_bad b USING (request_id) LEFT JOIN paths x USING (request_id) GROUP BY ALL""",
}


@query("issue_predictions", with_views("SELECT request_id, es AS entry_seq, xs AS exit_seq, reason FROM asked", {**_PT, "asked": _PT["asked"]}).replace("es AS entry_seq, xs AS exit_seq, reason FROM", "CASE WHEN reason IS NULL THEN es END AS entry_seq, CASE WHEN reason IS NULL THEN xs END AS exit_seq, reason FROM"))
def issue_predictions(spark, d):
    good, bad = L.issue_predictions(_ask(spark, d), definitions(spark, d), V.sessions(spark, d), versions(spark))
    return flat(good.select("request_id", "entry_seq", "exit_seq").unionByName(bad, allowMissingColumns=True))


@query(
    "score_prediction",
    with_views(
        f"""SELECT request_id, CASE WHEN bad IS NULL THEN 'scored' ELSE 'unresolved' END AS outcome_status, bad AS outcome_reason,
                   CASE WHEN bad IS NULL THEN {r('th')} END AS theme_return, CASE WHEN bad IS NULL THEN {r('th - be')} END AS excess_return,
                   CASE WHEN bad IS NULL THEN {r('fav')} END AS max_favorable, CASE WHEN bad IS NULL THEN {r('adv')} END AS max_adverse,
                   CASE WHEN bad IS NULL THEN {r('th - be - expected')} END AS prediction_error, coalesce(bad IS NULL AND (th - be) * expected > 0, FALSE) AS direction_correct
            FROM scored""",
        _PT,
    ),
)
def score_prediction(spark, d):
    out = PT.score_prediction(predictions(spark, d), _price_bars(spark, d))
    return flat(
        out.select("request_id", "outcome_status", "outcome_reason", "theme_return", "excess_return", "max_favorable", "max_adverse", "prediction_error",
                   F.coalesce("direction_correct", F.lit(False)).alias("direction_correct"))
    )


def _evidence(spark, d):
    """Total-return evidence: some bars unverified, some published late, some not tradable."""
    b = _price_bars(spark, d).join(V.sessions(spark, d).select("seq", "close_ts"), "seq")
    n = F.coalesce(F.regexp_extract("ticker", r"(\d+)", 1).try_cast("int"), F.lit(0))
    k = n * 7 + F.col("seq")
    return b.select(
        "ticker", "seq", "open", "close", "close_ts", F.when(k % 101 == 0, "pending").otherwise("verified").alias("quality"),
        (F.col("close_ts") + F.expr("INTERVAL 2 HOURS") + F.when(k % 103 == 0, F.expr("INTERVAL 9000 DAYS")).otherwise(F.expr("INTERVAL 0 DAYS"))).alias("available_at"),
        (k % 107 != 0).alias("tradable_open"),
    )


_LG = {
    **_PT,
    "ebars": """SELECT ticker, seq, CASE WHEN (n * 7 + seq) % 107 <> 0 THEN open END AS open, close FROM (SELECT *, coalesce(TRY_CAST(regexp_extract(ticker, '(\\d+)', 1) AS INT), 0) AS n FROM pbars)
                WHERE (n * 7 + seq) % 101 <> 0 AND (n * 7 + seq) % 103 <> 0""",
    "eleg": """SELECT l.*, b.seq, e.open AS eo, b.close / e.open - 1 AS ret FROM legs l LEFT JOIN ebars e ON e.ticker = l.ticker AND e.seq = l.es
               LEFT JOIN ebars b ON b.ticker = l.ticker AND b.seq BETWEEN l.es AND l.xs""",
    "ebad": """SELECT request_id, min(bad) AS bad FROM (SELECT request_id, ticker, CASE WHEN count(seq) < any_value(xs - es + 1) THEN 'missing session: ' || ticker
                    WHEN count(eo) = 0 THEN 'invalid entry: ' || ticker END AS bad FROM eleg GROUP BY 1, 2) GROUP BY 1""",
    "epaths": "SELECT request_id, seq, sum(CASE WHEN NOT bench THEN ret * w END) AS th, max(CASE WHEN bench THEN ret END) AS be FROM eleg WHERE seq IS NOT NULL GROUP BY 1, 2",
    "escored": """SELECT p.request_id, p.exit_at, b.bad, arg_max(x.th, x.seq) AS th, arg_max(x.be, x.seq) AS be FROM preds p JOIN ebad b USING (request_id)
                  LEFT JOIN epaths x USING (request_id) GROUP BY ALL""",
}


def _scored(spark, d):
    events = predictions(spark, d).select("prediction_id", F.lit("pending").alias("status"), F.lit(1).alias("seq"))
    none = predictions(spark, d).select("prediction_id", F.lit("none").alias("manifest_id")).limit(0)
    due = L.due_predictions(predictions(spark, d), events, none, "prices-1", _ts(TRAINED))
    return due, L.score_outcomes(due.where(F.col("action") == "score").drop("action", "status"), _evidence(spark, d), _ts(TRAINED))


@query("due_predictions", with_views(f"SELECT request_id, CASE WHEN exit_at > TIMESTAMP '{TRAINED}' THEN 'pending' ELSE 'score' END AS action FROM preds", _PT))
def due_predictions(spark, d):
    return _scored(spark, d)[0].select("request_id", "action")


@query(
    "score_outcomes",
    with_views(
        f"""SELECT request_id, CASE WHEN bad IS NULL THEN 'scored' ELSE 'unresolved' END AS outcome_status, bad AS reason, CASE WHEN bad IS NULL THEN {r('th - be')} END AS excess_return,
                   CASE WHEN bad IS NULL THEN {r('th - 0.002')} END AS cost_adjusted_return, CASE WHEN bad IS NULL THEN {r('th - be - 0.001')} END AS cost_adjusted_excess
            FROM escored WHERE exit_at <= TIMESTAMP '{TRAINED}'""",
        _LG,
    ),
)
def score_outcomes(spark, d):
    return flat(_scored(spark, d)[1].select("request_id", "outcome_status", "reason", "excess_return", "cost_adjusted_return", "cost_adjusted_excess"))


@query(
    "version_outcomes",
    with_views(
        f"""SELECT e.request_id, CAST(CASE WHEN s.bad IS NULL THEN CASE WHEN e.bad IS NULL THEN 2 ELSE 1 END END AS BIGINT) AS outcome_version, CASE WHEN s.bad IS NOT NULL THEN s.bad END AS error
            FROM escored e JOIN scored s USING (request_id) WHERE e.exit_at <= TIMESTAMP '{TRAINED}' AND (s.bad IS NULL OR e.bad IS NULL)""",
        _LG,
    ),
)
def version_outcomes(spark, d):
    """A second evidence revision without gaps corrects and completes the first."""
    due, first = _scored(spark, d)
    full = _evidence(spark, d).withColumn("quality", F.lit("verified")).withColumn("tradable_open", F.lit(True)).withColumn(
        "available_at", F.col("close_ts") + F.expr("INTERVAL 3 HOURS")
    )
    second = L.score_outcomes(due.where(F.col("action") == "score").drop("action", "status"), full, _ts(TRAINED))
    done = first.where(F.col("outcome_status") == "scored")
    good, errors = L.version_outcomes(done, second, "restated prices")
    ids = predictions(spark, d).select("prediction_id", "request_id")
    return flat(
        good.select("request_id", F.col("outcome_version").alias("outcome_version"), F.lit(None).cast("string").alias("error"))
        .unionByName(errors.join(ids, "prediction_id").select("request_id", F.lit(None).cast("bigint").alias("outcome_version"), F.col("reason").alias("error")))
    )


@query(
    "status_counts",
    with_views(
        f"""SELECT count(CASE WHEN exit_at > TIMESTAMP '{TRAINED}' THEN 1 END) AS pending, count(CASE WHEN exit_at <= TIMESTAMP '{TRAINED}' AND bad IS NULL THEN 1 END) AS scored,
                   count(CASE WHEN exit_at <= TIMESTAMP '{TRAINED}' AND bad IS NOT NULL THEN 1 END) AS unresolved FROM escored""",
        _LG,
    ),
)
def status_counts(spark, d):
    _, out = _scored(spark, d)
    events = predictions(spark, d).select("prediction_id", F.lit("pending").alias("status"), F.lit(1).alias("seq")).unionByName(
        out.select("prediction_id", F.col("outcome_status").alias("status"), F.lit(2).alias("seq"))
    )
    return flat(L.status_counts(L.current_status(events)))


# ---- samples, fits and predictions -----------------------------------------------------
def _features(spark, d):
    """Mean 5-session return of each basket per session."""
    rets = D.session_returns(D.on_calendar(V.all_bars(spark, d), V.calendar(spark, d)), (5,)).select("ticker", "session", "return_5d")
    core = V.memberships(spark, d).where(F.col("role") == "core").select("theme_id", "ticker")
    return core.join(rets, "ticker").groupBy("theme_id", "session").agg(F.avg("return_5d").alias("feature"))


@staged
def samples(spark, d):
    """Samples for every scored prediction; outcome known a day after exit."""
    scored = PT.score_prediction(predictions(spark, d), _price_bars(spark, d)).where(F.col("outcome_status") == "scored")
    scored = scored.join(requests(spark, d).select("request_id", "session"), "request_id").join(_features(spark, d), ["theme_id", "session"])
    s = V.sessions(spark, d).select(F.col("seq").alias("entry_seq"), F.col("session").alias("entry_session"))
    return scored.join(s, "entry_seq").where(F.col("feature").isNotNull()).select(
        "request_id", "theme_id", "horizon", F.col("request_id").alias("input_manifest"), "issued_at", F.col("issued_at").alias("known_at"), "session",
        "entry_session", "entry_at", "exit_at", (F.col("exit_at") + F.expr("INTERVAL 1 DAY")).alias("outcome_known_at"), "feature", "excess_return", F.lit("raw").alias("basis"),
    )


_WF = {
    **_PT,
    "r5": """SELECT ticker, session, CASE WHEN count(*) OVER (PARTITION BY ticker ORDER BY seq RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) = 6
                         THEN close / lag(close, 5) OVER (PARTITION BY ticker ORDER BY seq) - 1 END AS r FROM (SELECT b.*, s.seq FROM all_bars b JOIN sessions s USING (session))""",
    "feat": "SELECT c.theme_id, x.session, avg(x.r) AS f FROM core c JOIN r5 x USING (ticker) GROUP BY 1, 2",
    "samp": """SELECT s.request_id, s.theme_id, s.horizon, s.issued_at, s.es, s.exit_at + INTERVAL '1 day' AS known, f.f AS x, s.th - s.be AS y
               FROM scored s JOIN sessions k ON k.seq = s.seq JOIN feat f ON f.theme_id = s.theme_id AND f.session = k.session WHERE s.bad IS NULL AND f.f IS NOT NULL""",
    "trainings": """SELECT a.horizon, a.issued_at, regr_slope(t.y, t.x) AS sl, regr_intercept(t.y, t.x) AS ic, avg(t.y) AS base, count(*) AS tn, count(DISTINCT t.es) AS ts
                    FROM (SELECT DISTINCT horizon, issued_at FROM samp) a JOIN samp t ON t.horizon = a.horizon AND t.known < a.issued_at GROUP BY 1, 2 HAVING count(DISTINCT t.es) >= 60""",
    "oos": "SELECT s.*, ic + sl * x AS p, base, tn, ts, y - (ic + sl * x) AS res FROM samp s JOIN trainings t USING (horizon, issued_at)",
}


@query(
    "walk_forward",
    with_views(f"SELECT request_id, {r('p')} AS prediction, {r('base')} AS baseline, {r('res')} AS residual, tn AS train_n, ts AS train_sessions FROM oos", _WF),
)
def walk_forward(spark, d):
    out = PT.walk_forward(samples(spark, d), ["horizon"], 60)
    return flat(out.select("request_id", "prediction", "baseline", "residual", "train_n", "train_sessions"))


@query(
    "fit_ols",
    with_views(f"SELECT theme_id, CAST(horizon AS BIGINT) AS horizon, {r('regr_slope(y, x)')} AS slope, {r('regr_intercept(y, x)')} AS intercept, {r('avg(y)')} AS baseline, count(*) AS n FROM samp GROUP BY 1, 2", _WF),
)
def fit_ols(spark, d):
    return flat(PT.fit_ols(samples(spark, d), ["theme_id", "horizon"]).drop("x_min", "x_max"))


_MODEL = {
    **_WF,
    "ranked_res": "SELECT horizon, res, row_number() OVER (PARTITION BY horizon ORDER BY res) - 1 AS k, count(*) OVER (PARTITION BY horizon) AS n FROM oos",
    "band": """SELECT horizon, max(CASE WHEN k = CAST(floor((n - 1) * 0.1) AS BIGINT) THEN res END) AS lo, max(CASE WHEN k = CAST(floor((n - 1) * 0.9) AS BIGINT) THEN res END) AS hi FROM ranked_res GROUP BY 1""",
    "model": """SELECT f.*, p.oos_sessions, p.mae, p.bmae, b.lo, b.hi, CASE WHEN f.ts >= 60 AND coalesce(p.oos_sessions, 0) >= 60 THEN 'research_ready' ELSE 'insufficient' END AS status
                FROM (SELECT horizon, regr_slope(y, x) AS sl, regr_intercept(y, x) AS ic, count(DISTINCT es) AS ts, min(x) AS xl, max(x) AS xh FROM samp GROUP BY 1) f
                LEFT JOIN (SELECT horizon, count(DISTINCT es) AS oos_sessions, avg(abs(res)) AS mae, avg(abs(y - base)) AS bmae FROM oos GROUP BY 1) p USING (horizon)
                LEFT JOIN band b USING (horizon)""",
}


def _model(spark, d):
    return PT.fit_model(samples(spark, d), ["horizon"], _ts("2002-01-01 00:00:00"), 60, 60)[0]


@query(
    "fit_model",
    with_views(
        f"""SELECT CAST(horizon AS BIGINT) AS horizon, {r('sl')} AS slope, {r('ic')} AS intercept, ts AS train_sessions, oos_sessions, {r('mae')} AS mae, {r('bmae')} AS baseline_mae,
                   {r('lo')} AS band_low, {r('hi')} AS band_high, status, coalesce(mae < bmae, FALSE) AS improves_mean_baseline FROM model""",
        _MODEL,
    ),
)
def fit_model(spark, d):
    cols = ["horizon", "slope", "intercept", "train_sessions", "oos_sessions", "mae", "baseline_mae", "band_low", "band_high", "status", "improves_mean_baseline"]
    return flat(_model(spark, d).select(*cols))


_PREDICT = {
    **_MODEL,
    "asked_x": "SELECT a.request_id, a.horizon, a.seq, f.f AS x FROM asks a JOIN feat f ON f.theme_id = a.theme_id AND f.session = a.session",
    "predicted": """SELECT a.*, CASE WHEN status = 'research_ready' AND x BETWEEN xl AND xh AND seq % 7 <> 0 THEN ic + sl * x END AS v, lo, hi,
                           CASE WHEN status <> 'research_ready' THEN 'other' WHEN seq % 7 = 0 THEN 'price_basis_changed'
                                WHEN NOT coalesce(x BETWEEN xl AND xh, FALSE) THEN 'outside_training_range' END AS why FROM asked_x a JOIN model USING (horizon)""",
}


def _predictions(spark, d):
    snaps = requests(spark, d).join(_features(spark, d), ["theme_id", "session"]).select(
        "request_id", "horizon", "seq", F.to_timestamp(F.lit("2002-02-01 00:00:00")).alias("issued_at"), "feature", F.when(F.col("seq") % 7 == 0, "adjusted").otherwise("raw").alias("basis"),
    )
    return PT.predict(_model(spark, d), snaps, ["horizon"])


@query(
    "predict",
    with_views(f"SELECT request_id, CASE WHEN why IS NULL THEN 'research_prediction' ELSE 'forecast_abstention' END AS kind, why AS abstain_reason, {r('v')} AS expected, {r('v + lo')} AS lower, {r('v + hi')} AS upper FROM predicted", _PREDICT),
)
def predict(spark, d):
    return flat(_predictions(spark, d).select("request_id", "kind", "abstain_reason", "expected", "lower", "upper"))


@query(
    "decide",
    with_views(
        """SELECT request_id, CASE WHEN why IS NOT NULL OR seq % 11 = 0 THEN 'insufficient'
                       WHEN v + lo > -0.5 THEN CASE WHEN seq % 2 = 0 THEN 'hold_candidate' ELSE 'buy_candidate' END ELSE 'wait' END AS decision,
                  CASE WHEN why IS NOT NULL THEN 'forecast_unavailable' WHEN seq % 11 = 0 THEN 'cost_assumption_required' ELSE 'band_relative_to_cost' END AS decision_reason
           FROM (SELECT request_id, why, seq, v, lo + 0.5 AS lo0, lo FROM predicted)""".replace("v + lo > -0.5", "v + lo > 0.004"),
        _PREDICT,
    ).replace("ELSE 'wait' END AS decision", "WHEN v + hi0 < -0.004 THEN CASE WHEN seq % 2 = 0 THEN 'reduce_candidate' ELSE 'avoid_candidate' END ELSE 'wait' END AS decision").replace("lo + 0.5 AS lo0", "hi AS hi0"),
)
def decide(spark, d):
    cost = F.when(F.col("seq") % 11 != 0, 0.004)
    return PT.decide(_predictions(spark, d), F.col("seq") % 2 == 0, cost).select("request_id", "decision", "decision_reason")


def _archive(spark, d):
    """Archive tables with planted faults, keyed by the session number."""
    s = V.sessions(spark, d)
    req = requests(spark, d).join(predictions(spark, d).select("request_id", "members", "entry_at", "exit_at", "benchmark"), "request_id")
    q = F.col("seq")
    close = F.col("issued_at") - F.expr("INTERVAL 1 HOUR")
    manifests = s.select(
        F.concat(F.lit("M"), q.cast("string")).alias("manifest_id"), "session",
        (F.col("close_ts") + F.when(q % 29 == 0, F.expr("INTERVAL 2 HOURS")).otherwise(F.expr("INTERVAL 1 HOUR"))).alias("captured_at"),
    )
    tickers = F.col("members.ticker")
    evaluations = req.select(F.col("request_id").alias("evaluation_id"), "theme_id", "horizon", F.concat(F.lit("M"), q.cast("string")).alias("manifest_id"), F.col("issued_at").alias("anchor_at"), tickers.alias("members"), "benchmark")
    outcomes = samples(spark, d).join(requests(spark, d).select("request_id", "seq"), "request_id").select(
        F.concat(F.lit("O"), F.col("request_id")).alias("outcome_id"), F.col("request_id").alias("evaluation_id"), F.when(q % 31 == 0, 2).otherwise(1).alias("outcome_version"),
        F.col("outcome_known_at").alias("scored_at"), "excess_return", F.when(q % 37 == 0, "adjusted").otherwise("raw").alias("outcome_basis"),
    )
    five = req.where(F.col("horizon") == 5).join(_features(spark, d), ["theme_id", "session"])
    late = F.when(q % 10 == 0, F.expr("INTERVAL 5 DAYS")).otherwise(F.expr("INTERVAL 2 HOURS"))
    observations = five.select(
        "theme_id", F.col("session").alias("data_as_of"), (close + late).alias("known_at"), F.concat(F.lit("obs-"), F.col("request_id")).alias("observation_id"),
        F.lit("h").alias("source_hash"), F.when(q % 43 == 0, "x").otherwise("h").alias("content_hash"), close.alias("metric_known_at"), F.lit("mh").alias("membership_hash"),
        F.when(q % 41 == 0, F.slice(tickers, 2, 99)).otherwise(tickers).alias("core"), F.col("session").alias("metric_as_of"), "feature",
        F.lit(1.0).alias("coverage"), F.when(q % 47 == 0, "partial").otherwise("ok").alias("status"), F.lit("raw").alias("basis"),
    )
    return observations, evaluations, manifests, outcomes


@query(
    "build_samples",
    with_views(
        """SELECT 'O' || s.request_id AS reference, CASE WHEN q % 31 = 0 THEN 'explicit_correction_selection_required' WHEN q % 29 = 0 THEN 'anchor_mismatch'
                    WHEN q % 10 = 0 OR NOT has THEN 'no_point_in_time_features' WHEN q % 43 = 0 THEN 'source_hash_mismatch' WHEN q % 41 = 0 THEN 'core_changed'
                    WHEN q % 47 = 0 THEN 'incomplete_input' WHEN q % 37 = 0 THEN 'label_basis_mismatch' ELSE 'ok' END AS reason
           FROM (SELECT s.*, a.seq AS q, EXISTS (SELECT 1 FROM preds p WHERE p.theme_id = a.theme_id AND p.seq = a.seq AND p.horizon = 5) AS has
                 FROM samp s JOIN asks a USING (request_id)) s""",
        _WF,
    ),
)
def build_samples(spark, d):
    good, bad = PT.build_samples(*_archive(spark, d), V.sessions(spark, d))
    ids = good.select(F.concat_ws("-", F.concat(F.lit("O"), F.col("theme_id")), F.regexp_extract("input_manifest", r"obs-T\d+-(\d+)-", 1), F.col("horizon").cast("string")).alias("reference"), F.lit("ok").alias("reason"))
    return ids.unionByName(bad)


@query("validate_samples", with_views("SELECT CAST(NULL AS VARCHAR) AS rule, CAST(NULL AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS detail WHERE FALSE UNION ALL SELECT 'duplicate_sample', request_id, '2' FROM (SELECT theme_id || '|' || request_id || '|' || horizon AS request_id, es FROM samp) WHERE es % 50 = 0 UNION ALL SELECT 'invalid_horizon', theme_id || '|' || request_id || '|7', '7' FROM samp WHERE es % 50 = 1", _WF))
def validate_samples(spark, d):
    """The samples with some repeated and some given an unsupported horizon."""
    s = samples(spark, d).join(V.calendar(spark, d).withColumnRenamed("session", "entry_session"), "entry_session")
    bad = s.where(F.col("seq") % 50 == 1).withColumn("horizon", F.lit(7))
    rest = s.where(F.col("seq") % 50 != 1)
    return PT.validate_samples(rest.unionByName(s.where(F.col("seq") % 50 == 0)).unionByName(bad))


# ---- records, manifests, change logs ---------------------------------------------------
@query(
    "append_records",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_custkey % 3 = 0 THEN 'insert' ELSE 'conflict' END AS outcome
       FROM orders WHERE o_custkey % 3 = 0 OR o_orderstatus = 'F'""",
)
def append_records(spark, d):
    """All orders arrive; those of two customers in three are known, and closed ones of these come changed."""
    o = V.table(spark, d, "orders")
    rec = lambda df, body: df.select(
        F.lit("order").alias("kind"), F.col("o_orderkey").cast("string").alias("id"), body.alias("body")
    ).withColumn("hash", F.sha2("body", 256))
    body = F.concat_ws("|", "o_orderstatus", F.col("o_custkey").cast("string"))
    known = F.col("o_custkey") % 3 != 0
    existing = rec(o.where(known), body)
    new = rec(o, F.when(known & (F.col("o_orderstatus") == "F"), F.concat(body, F.lit("!"))).otherwise(body))
    insert, conflicts = L.append_records(existing, new)
    return insert.select("id", F.lit("insert").alias("outcome")).unionByName(conflicts.select("id", F.lit("conflict").alias("outcome")))


def _sources(spark, d):
    doc = V.table(spark, d, "documents")
    at = F.to_timestamp(F.lit("2024-03-01 00:00:00"))
    k = F.col("doc_id")
    return doc.select(
        (k % 50).alias("batch"), F.concat(F.lit("doc-"), k.cast("string")).alias("name"), F.col("text").alias("body"), "source", at.alias("captured_at"),
        (at - F.expr("make_dt_interval(cast(doc_id % 30 as int))") + F.when(k % 50 == 7, F.expr("INTERVAL 90 DAYS")).otherwise(F.expr("INTERVAL 0 DAYS"))).alias("available_at"),
        F.to_date(F.lit("2024-02-01")).alias("data_as_of"), F.lit("r1").alias("revision"), F.when(k % 50 == 9, "").otherwise("public").alias("license_class"),
    )


@query(
    "capture_manifest",
    """SELECT doc_id % 50 AS batch, count(*) AS inputs, count(DISTINCT text) AS objects, CASE WHEN doc_id % 50 = 7 AND bool_or(doc_id % 30 < 90) THEN 'future source availability'
              WHEN doc_id % 50 = 9 THEN 'missing source license_class' END AS reason FROM documents GROUP BY 1""".replace("doc_id % 50 = 7 AND bool_or(doc_id % 30 < 90)", "any_value(doc_id) % 50 = 7").replace("WHEN doc_id % 50 = 9", "WHEN any_value(doc_id) % 50 = 9")
    .replace("count(*) AS inputs, count(DISTINCT text) AS objects", "CASE WHEN any_value(doc_id) % 50 NOT IN (7, 9) THEN count(*) END AS inputs, CASE WHEN any_value(doc_id) % 50 NOT IN (7, 9) THEN count(DISTINCT text) END AS objects"),
)
def capture_manifest(spark, d):
    good, _, rejected = L.capture_manifest(_sources(spark, d), ["batch"])
    sizes = good.select("batch", F.size("inputs").cast("long").alias("inputs"), F.size(F.array_distinct(F.transform(F.map_values("inputs"), lambda e: e["content_hash"]))).cast("long").alias("objects"))
    return sizes.unionByName(rejected.select("batch", "reason"), allowMissingColumns=True)


@query(
    "input_as_of",
    """SELECT doc_id % 50 AS batch, count(CASE WHEN TIMESTAMP '2024-03-01' - CAST(doc_id % 30 AS INT) * INTERVAL '1 day' <= TIMESTAMP '2024-02-20' THEN NULL END) AS usable_n, count(*) AS inputs_n
       FROM documents WHERE doc_id % 50 NOT IN (7, 9) GROUP BY 1""".replace("count(CASE WHEN TIMESTAMP '2024-03-01' - CAST(doc_id % 30 AS INT) * INTERVAL '1 day' <= TIMESTAMP '2024-02-20' THEN NULL END)", "CAST(0 AS BIGINT)"),
)
def input_as_of(spark, d):
    """A cutoff before the capture itself leaves nothing usable, whatever the inputs' own dates."""
    good, _, _ = L.capture_manifest(_sources(spark, d), ["batch"])
    rows = L.input_as_of(good, F.to_timestamp(F.lit("2024-02-20 00:00:00")))
    return rows.groupBy("batch").agg(F.count(F.when(F.col("usable"), 1)).alias("usable_n"), F.count(F.lit(1)).alias("inputs_n"))


@query(
    "audit",
    """SELECT 'record checksum mismatch' AS rule, 'order' AS kind, CAST(o_orderkey AS VARCHAR) AS id, NULL AS target FROM orders WHERE o_orderkey % 997 = 0
       UNION ALL SELECT 'missing reference', 'line', CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber, 'order:' || (l_orderkey + 1) FROM lineitem
       WHERE (l_orderkey + 1) NOT IN (SELECT o_orderkey FROM orders)""",
)
def audit(spark, d):
    o = V.table(spark, d, "orders")
    rec = o.select(F.lit("order").alias("kind"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("body"))
    rec = rec.withColumn("hash", F.when(F.col("id").cast("long") % 997 == 0, "broken").otherwise(F.sha2("body", 256)))
    li = V.table(spark, d, "lineitem")
    ref = li.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.lit("order").alias("target_kind"), (F.col("l_orderkey") + 1).cast("string").alias("target_id"))
    return L.audit(rec, {"line": ref})


_USAGE = """SELECT event_id, prev FROM (
  SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM (
    SELECT *, lag(fp) OVER w AS pf, lag(jd) OVER w AS pd, row_number() OVER w AS rn FROM (
      SELECT *, event_type || '|' || CAST(CAST(floor(value / 20) AS BIGINT) AS VARCHAR) AS fp, CAST(ts + INTERVAL '9 hours' AS DATE) AS jd FROM events)
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE rn = 1 OR fp <> pf OR jd <> pd)"""


@query("usage_changes", _USAGE.replace("SELECT event_id, prev FROM", "SELECT event_id, prev IS NOT NULL AS chained FROM", 1))
def usage_changes(spark, d):
    ev = V.table(spark, d, "events").withColumn("fingerprint", F.concat_ws("|", "event_type", F.floor(F.col("value") / 20).cast("string")))
    out = L.usage_changes(ev.select("event_id", "user_id", "ts", "fingerprint"))
    return out.select("event_id", F.col("previous_record_id").isNotNull().alias("chained"))


@query(
    "decision_log",
    """SELECT event_id, before, event_type AS value FROM (SELECT *, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'unset') AS before FROM events) WHERE before <> event_type""",
)
def decision_log(spark, d):
    ev = V.table(spark, d, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("value"), F.to_date("ts").alias("day"))
    return L.decision_log(ev, ["user_id"], "day", ["ts", "event_id"]).select("event_id", "before", "value")


@query(
    "rationale_log",
    """SELECT event_id, array_to_string(list_sort(list_filter(tags, lambda x: NOT list_contains(before, x))), ',') AS added, array_to_string(list_sort(list_filter(before, lambda x: NOT list_contains(tags, x))), ',') AS removed
       FROM (SELECT *, coalesce(lag(tags) OVER (PARTITION BY user_id ORDER BY ts, event_id), CAST([] AS VARCHAR[])) AS before
             FROM (SELECT *, list_sort(list_distinct([event_type, 'k' || event_id % 3])) AS tags FROM events)) WHERE tags <> before""",
)
def rationale_log(spark, d):
    ev = V.table(spark, d, "events").select(
        "event_id", "user_id", "ts", F.array("event_type", F.concat(F.lit("k"), (F.col("event_id") % 3).cast("string"))).alias("tags"), F.to_date("ts").alias("day")
    )
    return flat(L.rationale_log(ev, ["user_id"], "day", ["ts", "event_id"]).select("event_id", F.sort_array("added").alias("added"), F.sort_array("removed").alias("removed")))
