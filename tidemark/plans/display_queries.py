"""Calendar-strict metrics, setups and readings over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.operators import display as D
from tidemark.operators import regime as R
from tidemark.operators import setups as ST
from tidemark.operators import themes as T
from tidemark.plans import views as V
from tidemark.plans.catalog import flat, query
from tidemark.plans.theme_queries import _S, _STRENGTH_VIEWS, _TURN, _core, day
from tidemark.plans.views import r, sql_label, sql_piecewise, with_views

NOW = "2001-06-06 12:00:00"

_GRID = {
    "grid": "SELECT b.*, s.seq FROM all_bars b JOIN sessions s USING (session)",
    "grid_metrics": "SELECT *, "
    + ", ".join(
        f"""CASE WHEN count(*) OVER (PARTITION BY ticker ORDER BY seq RANGE BETWEEN {n} PRECEDING AND CURRENT ROW) = {n + 1}
             THEN close / lag(close, {n}) OVER (PARTITION BY ticker ORDER BY seq) - 1 END AS return_{n}d"""
        for n in C.RETURN_SESSIONS
    )
    + """, CASE WHEN count(*) OVER (PARTITION BY ticker ORDER BY seq RANGE BETWEEN 20 PRECEDING AND CURRENT ROW) = 21
              THEN volume / (sum(volume) OVER (PARTITION BY ticker ORDER BY seq RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING) / 20) END AS rvol
         FROM grid""",
    # Price basis: brands 13, 14 moved to another adjustment in 1998.
    "grid_basis": """SELECT *, CASE WHEN ticker IN ('Brand#13', 'Brand#14') AND session >= DATE '1998-01-05' THEN 'adjusted' ELSE 'raw' END AS basis
                     FROM grid_metrics""",
}


def _grid(spark, d):
    return D.on_calendar(V.all_bars(spark, d), V.calendar(spark, d))


def _metrics(spark, d):
    moved = F.col("ticker").isin("Brand#13", "Brand#14") & (F.col("session") >= F.to_date(F.lit("1998-01-05")))
    return D.relative_volume(D.session_returns(_grid(spark, d))).withColumn(
        "basis", F.when(moved, "adjusted").otherwise("raw")
    )


@query(
    "session_returns",
    with_views(
        f"SELECT ticker, {day('session')}, " + ", ".join(f"{r(f'return_{n}d', 8)} AS return_{n}d" for n in C.RETURN_SESSIONS) + " FROM grid_metrics",
        _GRID,
    ),
)
def session_returns(spark, d):
    out = D.session_returns(_grid(spark, d))
    return flat(out.select("ticker", "session", *[f"return_{n}d" for n in C.RETURN_SESSIONS]), 8)


@query("relative_volume", with_views(f"SELECT ticker, {day('session')}, {r('rvol')} AS rvol FROM grid_metrics", _GRID))
def relative_volume(spark, d):
    return flat(D.relative_volume(_grid(spark, d)).select("ticker", "session", "rvol"))


@query(
    "metric_status",
    with_views(
        f"""SELECT {day('session')}, count(return_5d) AS eligible_n, count(*) AS total_n,
                   CASE WHEN count(return_5d) = 0 THEN 'missing' WHEN count(return_5d) = count(*) THEN 'ok' ELSE 'partial' END AS status
            FROM grid_metrics GROUP BY session""",
        _GRID,
    ),
)
def metric_status(spark, d):
    per = D.session_returns(_grid(spark, d)).groupBy("session").agg(
        F.count("return_5d").alias("eligible_n"), F.count(F.lit(1)).alias("total_n"), F.avg("return_5d").alias("v")
    )
    return flat(per.withColumn("status", D.metric_status(F.col("v"), F.col("eligible_n"), F.col("total_n"))).drop("v"))


_DISPLAY = {
    **_GRID,
    "long_metrics": " UNION ALL ".join(
        f"SELECT l.theme_id, l.as_of, l.ticker, '{m}' AS metric, g.{m} AS value, g.basis, g.rvol FROM live_core l "
        "LEFT JOIN grid_basis g ON g.ticker = l.ticker AND g.session = l.as_of"
        for m in D.METRICS
    ),
    "display_rows": """SELECT theme_id, as_of, metric, count(*) AS total_n,
              count(CASE WHEN rvol > 1.0 THEN 1 END) AS rvol_elevated_n,
              count(DISTINCT CASE WHEN value IS NOT NULL THEN basis END) AS bases, count(value) AS n,
              CASE WHEN metric = 'rvol' THEN median(value) ELSE avg(value) END AS v
         FROM long_metrics GROUP BY 1, 2, 3""",
}


@query(
    "theme_display",
    with_views(
        f"""SELECT theme_id, {day('as_of')}, metric, CASE WHEN bases <= 1 THEN {r('v')} END AS value,
                   CASE WHEN bases <= 1 THEN n ELSE 0 END AS eligible_n, total_n,
                   {r('CASE WHEN bases <= 1 THEN n ELSE 0 END / total_n')} AS coverage,
                   CASE WHEN bases > 1 THEN 'mixed_basis' WHEN n = 0 THEN 'missing' WHEN n = total_n THEN 'ok' ELSE 'partial' END AS status,
                   rvol_elevated_n
            FROM display_rows""",
        _DISPLAY,
    ),
)
def theme_display(spark, d):
    return flat(D.theme_display(_metrics(spark, d), V.memberships(spark, d), V.as_of(spark, d)))


_RANKS = {
    **_STRENGTH_VIEWS,
    "versions": """SELECT theme_id, as_of, CAST(substr(theme_id, 2) AS INT) AS pos, score_mode,
                          CASE WHEN score IS NULL THEN 'insufficient' ELSE 'ok' END AS status,
                          CAST(as_of AS TIMESTAMP) + k * INTERVAL '30 hours' AS calculated_at,
                          round(CASE WHEN k = 2 THEN 100 - score ELSE score END, 2) AS score
                   FROM strength_rows, (VALUES (1), (2)) v(k)""",
    "newest": """SELECT * FROM versions v WHERE calculated_at <= TIMESTAMP '2001-01-02 00:00:00'
                   AND calculated_at = (SELECT max(calculated_at) FROM versions w
                                        WHERE w.as_of = v.as_of AND w.calculated_at <= TIMESTAMP '2001-01-02 00:00:00')""",
    "ranked": """SELECT n.*, row_number() OVER (PARTITION BY as_of ORDER BY score DESC, pos) AS rank
                 FROM newest n WHERE score_mode = 'ranked' AND status = 'ok' AND score >= 0""",
    "rank_seq": "SELECT k.theme_id, s.seq, k.rank FROM ranked k JOIN sessions s ON s.session = k.as_of",
    "rank_hist": """SELECT t.theme_id, s.session AS as_of, r0.rank AS rank_0, r1.rank AS rank_1, r3.rank AS rank_3, r5.rank AS rank_5
                    FROM sessions s CROSS JOIN (SELECT DISTINCT theme_id FROM ranked) t
                    LEFT JOIN rank_seq r0 ON r0.theme_id = t.theme_id AND r0.seq = s.seq
                    LEFT JOIN rank_seq r1 ON r1.theme_id = t.theme_id AND r1.seq = s.seq - 1
                    LEFT JOIN rank_seq r3 ON r3.theme_id = t.theme_id AND r3.seq = s.seq - 3
                    LEFT JOIN rank_seq r5 ON r5.theme_id = t.theme_id AND r5.seq = s.seq - 5
                    WHERE coalesce(r0.rank, r1.rank, r3.rank, r5.rank) IS NOT NULL""",
}


def _history(spark, d):
    """Two versions of each day's scores: 30 and 60 hours later, the second one reversed."""
    st = T.strength(V.all_bars(spark, d), _core(spark, d), V.as_of(spark, d), V.themes(spark, d))
    st = st.join(V.themes(spark, d).select("theme_id", "score_mode"), "theme_id")
    k = F.explode(F.array(F.lit(1), F.lit(2)))
    rows = st.select("theme_id", "as_of", "score_mode", "strength_score", k.alias("k"))
    return rows.select(
        "theme_id", "as_of", F.substring("theme_id", 2, 9).cast("int").alias("pos"), "score_mode",
        F.when(F.col("strength_score").isNull(), "insufficient").otherwise("ok").alias("status"),
        (F.col("as_of").cast("timestamp") + F.expr("make_dt_interval(0, 30 * k)")).alias("calculated_at"),
        F.round(F.when(F.col("k") == 2, 100 - F.col("strength_score")).otherwise(F.col("strength_score")), 2).alias("score"),
    )


@query("theme_ranks", with_views(f"SELECT theme_id, {day('as_of')}, {r('score', 2)} AS score, rank FROM ranked", _RANKS))
def theme_ranks(spark, d):
    newest = D.known_history(_history(spark, d), F.to_timestamp(F.lit("2001-01-02 00:00:00")))
    return flat(D.theme_ranks(newest).select("theme_id", "as_of", "score", "rank"))


@query(
    "rank_history",
    with_views(
        f"SELECT theme_id, {day('as_of')}, rank_0, rank_1, rank_3, rank_5, rank_5 - rank_0 AS rank_change_5d FROM rank_hist", _RANKS
    ),
)
def rank_history(spark, d):
    out = D.rank_history(
        _history(spark, d), V.calendar(spark, d), V.as_of(spark, d), F.to_timestamp(F.lit("2001-01-02 00:00:00"))
    )
    return flat(D.rank_change(out))


@query(
    "sort_members",
    with_views(
        f"""SELECT l.theme_id, {day('l.as_of', 'as_of')}, l.ticker,
                   row_number() OVER (PARTITION BY l.theme_id, l.as_of ORDER BY g.return_1d DESC NULLS LAST, l.pos) AS position
            FROM live_core l LEFT JOIN grid_metrics g ON g.ticker = l.ticker AND g.session = l.as_of""",
        _GRID,
    ),
)
def sort_members(spark, d):
    from tidemark.operators.dims import effective_at

    live = effective_at(_core(spark, d), V.as_of(spark, d)).withColumnRenamed("as_of", "session")
    rows = live.join(D.session_returns(_grid(spark, d), (1,)).select("ticker", "session", "return_1d"), ["ticker", "session"], "left")
    out = D.sort_members(rows, "return_1d", ["theme_id", "session"])
    return flat(out.select("theme_id", F.col("session").alias("as_of"), "ticker", "position"))


@query(
    "breadth_view",
    with_views(
        f"""SELECT {day('session')}, eligible_n, now_above, past_above, 
                   CASE WHEN ok THEN 'ok' ELSE 'insufficient' END AS breadth_status,
                   CASE WHEN ok THEN {r('now_above / eligible_n')} END AS now_fraction,
                   CASE WHEN ok THEN {r('past_above / eligible_n')} END AS past_fraction,
                   CASE WHEN ok THEN {r('(now_above - past_above) / eligible_n')} END AS fraction_change
            FROM (SELECT *, eligible_n > 0 AND now_above BETWEEN 0 AND eligible_n AND past_above BETWEEN 0 AND eligible_n AS ok
                  FROM (SELECT session, count(return_21d) AS eligible_n, count(CASE WHEN return_21d > 0 THEN 1 END) AS now_above,
                               count(CASE WHEN return_5d > 0 THEN 1 END) AS past_above FROM grid_metrics GROUP BY 1))""",
        _GRID,
    ),
)
def breadth_view(spark, d):
    counts = D.session_returns(_grid(spark, d)).groupBy("session").agg(
        F.count("return_21d").alias("eligible_n"), F.count(F.when(F.col("return_21d") > 0, 1)).alias("now_above"),
        F.count(F.when(F.col("return_5d") > 0, 1)).alias("past_above"),
    )
    return flat(D.breadth_view(counts))


_W = "PARTITION BY ticker ORDER BY seq"
_SETUPS = {
    **_GRID,
    "su0": f"""SELECT ticker, session, seq, close AS c, volume AS v, least(seq - min(seq) OVER (PARTITION BY ticker) + 1, 64) AS n,
                      close - lag(close) OVER ({_W}) AS step FROM grid""",
    "su1": f"""SELECT *, count(c) OVER ({_W} RANGE BETWEEN 63 PRECEDING AND CURRENT ROW) AS have,
                 CASE WHEN n >= 20 THEN avg(c) OVER ({_W} RANGE BETWEEN 19 PRECEDING AND CURRENT ROW) END AS ma20,
                 CASE WHEN n >= 50 THEN avg(c) OVER ({_W} RANGE BETWEEN 49 PRECEDING AND CURRENT ROW) END AS ma50,
                 CASE WHEN n >= 21 THEN max(c) OVER ({_W} RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS prior_high20,
                 CASE WHEN n >= 21 THEN min(c) OVER ({_W} RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS prior_low20,
                 CASE WHEN n >= 15 THEN sum(greatest(step, 0)) OVER ({_W} RANGE BETWEEN 13 PRECEDING AND CURRENT ROW) / 14 END AS gain,
                 CASE WHEN n >= 15 THEN sum(greatest(-step, 0)) OVER ({_W} RANGE BETWEEN 13 PRECEDING AND CURRENT ROW) / 14 END AS loss,
                 CASE WHEN n >= 21 AND count(v) OVER ({_W} RANGE BETWEEN 20 PRECEDING AND CURRENT ROW) = 21
                      THEN v / (sum(v) OVER ({_W} RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING) / 20) END AS rvol,
                 CASE WHEN n > 1 THEN lag(c) OVER ({_W}) END AS previous_close,
                 CASE WHEN n > 5 THEN (c / lag(c, 5) OVER ({_W}) - 1) * 100 END AS return_5_pct,
                 CASE WHEN n > 63 THEN (c / lag(c, 63) OVER ({_W}) - 1) * 100 END AS return_63_pct FROM su0""",
    "su2": """SELECT *, CASE WHEN gain IS NULL THEN NULL WHEN loss > 0 THEN 100 - 100 / (1 + gain / loss) WHEN gain > 0 THEN 100.0 ELSE 50.0 END AS rsi14,
                     (c / ma20 - 1) * 100 AS dist FROM su1 WHERE have = n""",
    "su": """SELECT *, c AS price, n >= 50 AS analysis_ready, c > ma50 AND ma20 > ma50 AS trend_up, c > prior_high20 AS breakout,
                    c < prior_low20 AS breakdown, rsi14 >= 70 OR c / ma20 >= 1.10 AS overheated FROM su2""",
    "codes": """SELECT *, CASE WHEN NOT analysis_ready OR rsi14 IS NULL THEN 'waiting' WHEN breakdown OR (c < ma50 AND ma20 < ma50) THEN 'weak'
                          WHEN overheated THEN 'hot' WHEN breakout THEN 'breakout' WHEN trend_up AND abs(dist) <= 3 THEN 'pullback'
                          WHEN trend_up THEN 'trend' ELSE 'range' END AS code FROM su""",
}


@query(
    "stock_setups",
    with_views(
        f"""SELECT ticker, {day('session')}, CAST(n AS BIGINT) AS history_sessions, {r('price')} AS price, {r('ma20')} AS ma20, {r('ma50')} AS ma50,
                   {r('prior_high20')} AS prior_high20, {r('prior_low20')} AS prior_low20, {r('rsi14')} AS rsi14, {r('rvol')} AS rvol,
                   {r('dist')} AS distance_ma20_pct, {r('return_5_pct')} AS return_5_pct, {r('return_63_pct')} AS return_63_pct, analysis_ready,
                   coalesce(trend_up, FALSE) AS trend_up, coalesce(breakout, FALSE) AS breakout,
                   coalesce(breakdown, FALSE) AS breakdown, coalesce(overheated, FALSE) AS overheated
            FROM su""",
        _SETUPS,
    ),
)
def stock_setups(spark, d):
    out = ST.stock_setups(_grid(spark, d))
    flags = ["trend_up", "breakout", "breakdown", "overheated"]
    plain = ["ticker", "session", "history_sessions", "price", "ma20", "ma50", "prior_high20", "prior_low20", "rsi14", "rvol",
             "distance_ma20_pct", "return_5_pct", "return_63_pct", "analysis_ready"]
    return flat(out.select(*plain, *[F.coalesce(c, F.lit(False)).alias(c) for c in flags]))


def _codes(spark, d):
    return ST.setup_code(ST.stock_setups(_grid(spark, d)), F.col("analysis_ready"))


@query("setup_code", with_views(f"SELECT ticker, {day('session')}, code, code <> 'waiting' AS ready FROM codes", _SETUPS))
def setup_code(spark, d):
    return flat(_codes(spark, d).select("ticker", "session", "code", "ready"))


_PEERS = {
    **_SETUPS,
    "peers": """SELECT *, code <> 'waiting' AS ready,
           CASE WHEN code = 'waiting' THEN 'waiting' WHEN c > ma50 AND ma20 > ma50 THEN 'up' WHEN c < ma50 AND ma20 < ma50 THEN 'down' ELSE 'mixed' END AS trend,
           code <> 'waiting' AND (rsi14 >= 70 OR dist >= 10) AS hot, code <> 'waiting' AND (c < prior_low20 OR c < ma50) AS broken,
           code <> 'waiting' AND trend_up AND abs(dist) <= 3 AS near FROM codes""",
}


@query(
    "peer_readings",
    with_views(
        f"""SELECT ticker, {day('session')}, trend, coalesce(hot, FALSE) AS hot, coalesce(broken, FALSE) AS broken, coalesce(near, FALSE) AS near,
                   CASE WHEN NOT ready THEN 'check_latest_bar' WHEN broken THEN 'review_thesis' WHEN hot THEN 'check_overheating'
                        WHEN breakout THEN 'check_breakout_holds' WHEN near THEN 'check_support' WHEN trend = 'up' THEN 'check_trend_holds'
                        ELSE 'check_direction' END AS action FROM peers""",
        _PEERS,
    ),
)
def peer_readings(spark, d):
    return flat(ST.peer_readings(_codes(spark, d)).select("ticker", "session", "trend", "hot", "broken", "near", "action"))


@query(
    "peer_summary",
    with_views(
        f"""SELECT {day('session')}, count(*) AS members, count(CASE WHEN ready THEN 1 END) AS ready_n, count(CASE WHEN trend = 'up' THEN 1 END) AS up_n,
                   count(CASE WHEN hot THEN 1 END) AS hot_n, count(CASE WHEN broken THEN 1 END) AS broken_n FROM peers GROUP BY session""",
        _PEERS,
    ),
)
def peer_summary(spark, d):
    return flat(ST.peer_summary(ST.peer_readings(_codes(spark, d)), ["session"]))


def _now():
    return F.to_timestamp(F.lit(NOW))


def _basic(spark, d):
    """Quotes of another job: each brand's last bar before its own cut date."""
    n = F.regexp_extract("ticker", r"(\d+)", 1).cast("int")
    cut = F.date_sub(F.to_date(F.lit("2001-06-04")), n * 7)
    rows = V.bars(spark, d).where((F.col("session") <= cut) & (n % 6 != 0))
    return rows.groupBy("ticker").agg(F.max("session").alias("date"), F.max_by("close", "session").alias("price"))


def _setup_quotes(spark, d):
    n = F.regexp_extract("ticker", r"(\d+)", 1).cast("int")
    rows = V.bars(spark, d).where((F.col("session") <= F.to_date(F.lit("2001-05-28"))) & (n % 4 != 0))
    return rows.groupBy("ticker").agg(
        F.max("session").alias("as_of"), F.max_by("close", "session").alias("price")
    ).withColumn("quality", F.when(F.regexp_extract("ticker", r"(\d+)", 1).cast("int") % 5 == 0, "stale").otherwise("ok"))


_QUOTES = {
    "bnum": "SELECT *, CAST(regexp_extract(ticker, '(\\d+)', 1) AS INT) AS bn FROM bars",
    "basic": """SELECT ticker, max(session) AS date, arg_max(close, session) AS price FROM bnum
                WHERE session <= DATE '2001-06-04' - bn * 7 AND bn % 6 <> 0 GROUP BY 1""",
    "setq": """SELECT ticker, max(session) AS as_of, arg_max(close, session) AS price, CASE WHEN any_value(bn) % 5 = 0 THEN 'stale' ELSE 'ok' END AS quality
               FROM bnum WHERE session <= DATE '2001-05-28' AND bn % 4 <> 0 GROUP BY 1""",
    "expected": f"""SELECT max(CASE WHEN close_ts + INTERVAL '30 minutes' <= TIMESTAMP '{NOW}' THEN session END) AS e FROM sessions""",
    "pair": """SELECT coalesce(b.ticker, s.ticker) AS ticker, b.date AS bd, b.price AS bp, s.as_of AS sd, s.price AS sp, s.quality, x.e,
                      CASE WHEN b.date IS NULL THEN 'missing' WHEN b.date > x.e THEN 'invalid' WHEN b.date = x.e THEN 'current' ELSE 'stale' END AS bs,
                      CASE WHEN s.as_of IS NULL THEN 'missing' WHEN s.as_of > x.e THEN 'invalid' WHEN s.as_of = x.e THEN 'current' ELSE 'stale' END AS ss
               FROM basic b FULL JOIN setq s ON b.ticker = s.ticker CROSS JOIN expected x""",
    "picked": """SELECT *, coalesce(sp > 0 AND (bd IS NULL OR sd >= bd OR (ss IN ('current', 'stale') AND bs NOT IN ('current', 'stale'))), FALSE) AS pick FROM pair""",
    "quotes": """SELECT ticker, CASE WHEN pick THEN 'setup' ELSE 'basic' END AS origin, CASE WHEN pick THEN sd ELSE bd END AS date,
                        CASE WHEN pick THEN sp ELSE bp END AS price, CASE WHEN pick THEN ss ELSE bs END AS state,
                        CASE WHEN pick THEN quality END AS quality FROM picked""",
}


@query(
    "quote_for",
    with_views(
        f"""SELECT ticker, origin, {day('date')}, {r('price')} AS price, state, state IN ('current', 'stale') AS closed, quality FROM quotes""", _QUOTES
    ),
)
def quote_for(spark, d):
    out = ST.quote_for(_basic(spark, d), _setup_quotes(spark, d), V.sessions(spark, d), _now())
    return flat(out.drop("setup_state"))


@query(
    "session_state",
    with_views(
        """SELECT ticker, CASE WHEN max(session) > DATE '2001-06-06' THEN 'invalid' WHEN max(session) > e THEN 'invalid'
                              WHEN max(session) = e THEN 'current' ELSE 'stale' END AS state
           FROM sparse_bars CROSS JOIN expected WHERE ticker <> 'S7' OR session < DATE '2001-01-01' GROUP BY ticker, e""",
        _QUOTES,
    ),
)
def session_state(spark, d):
    rows = V.sparse_bars(spark, d).where((F.col("ticker") != "S7") | (F.col("session") < F.to_date(F.lit("2001-01-01"))))
    last = rows.groupBy("ticker").agg(F.max("session").alias("date"))
    return flat(ST.with_state(last, "date", V.sessions(spark, d), _now()).select("ticker", "state"))


@query(
    "quote_status",
    with_views(
        """SELECT coalesce(q.ticker, t.ticker) AS ticker,
                  CASE WHEN ok AND (state <> 'current' OR coalesce(quality = 'stale', FALSE)) THEN 'stale' WHEN ok THEN 'current'
                       WHEN t.ticker IS NULL THEN 'unsupported' ELSE 'pending' END AS status,
                  coalesce(ok, FALSE) AS usable, CASE WHEN NOT coalesce(ok, FALSE) AND t.ticker IS NOT NULL THEN t.reason END AS reason
           FROM (SELECT *, state IN ('current', 'stale') AND price > 0 AS ok FROM quotes) q
           FULL JOIN (SELECT 'Brand#' || i AS ticker, CASE WHEN i % 3 = 0 THEN 'gap_in_history' ELSE 'retry_next_run' END AS reason
                      FROM (SELECT DISTINCT n AS i FROM brands UNION SELECT n + 25 FROM brands)) t ON t.ticker = q.ticker""",
        _QUOTES,
    ),
)
def quote_status(spark, d):
    quotes = ST.quote_for(_basic(spark, d), _setup_quotes(spark, d), V.sessions(spark, d), _now())
    n = F.regexp_extract("ticker", r"(\d+)", 1).cast("int")
    ids = V.memberships(spark, d).select(n.alias("i")).distinct()
    ids = ids.union(ids.select(F.col("i") + 25)).distinct()
    tracked = ids.select(
        F.concat(F.lit("Brand#"), F.col("i").cast("string")).alias("ticker"), F.when(F.col("i") % 3 == 0, "incomplete_history").alias("failure")
    )
    return flat(ST.quote_status(quotes, tracked))


_CAPTURES = {
    **_SETUPS,
    "caps": """SELECT ticker, session AS date, c AS price, CASE WHEN seq % 50 < 2 THEN 'JPY' ELSE 'USD' END AS currency,
                      CASE WHEN code = 'waiting' THEN NULL ELSE code END AS code FROM codes""",
    "capl": """SELECT *, lag(price) OVER (PARTITION BY ticker ORDER BY date) AS pp, lag(currency) OVER (PARTITION BY ticker ORDER BY date) AS pc,
                      lag(code) OVER (PARTITION BY ticker ORDER BY date) AS pk FROM caps""",
}


@query(
    "important_changes",
    with_views(
        f"""SELECT ticker, {day('date')}, code, {r('CASE WHEN currency = pc THEN (price / pp - 1) * 100 END', 4)} AS change_pct,
                   coalesce(currency = pc AND code <> pk, FALSE) AS transition,
                   coalesce(currency = pc AND code <> pk, FALSE) OR coalesce(currency = pc AND abs((price / pp - 1) * 100) >= 3, FALSE) AS important
            FROM capl""",
        _CAPTURES,
    ),
)
def important_changes(spark, d):
    caps = _codes(spark, d).select(
        "ticker", F.col("session").alias("date"), "price",
        F.when(F.col("seq") % 50 < 2, "JPY").otherwise("USD").alias("currency"),
        F.when(F.col("ready"), F.col("code")).alias("code"), F.col("session").cast("timestamp").alias("observed_at"),
        F.trunc("session", "year").alias("bucket"),
    )
    out = ST.important_changes(ST.capture_changes(caps, "bucket"))
    return flat(out.select("ticker", "date", "code", "change_pct", "transition", "important"), 4)


_INSIGHT = {
    **_TURN,
    **_S,
    "insight": """SELECT *, NOT insufficient AND en < total AS partial, state IS NOT NULL AND NOT confirmed AS changing, hot AND hot_eligible AND heat_n >= 3 AND heat_score IS NOT NULL AS is_hot,
                         single_stock_driven AND heat_score IS NOT NULL AS conc
                  FROM (SELECT x.theme_id, x.as_of, x.en, x.score_mode, x.score, f.state, f.confirmed, h.heat_score, h.heat_n, h.hot, h.hot_eligible, h.single_stock_driven,
                               (SELECT count(*) FROM live_core l WHERE l.theme_id = x.theme_id AND l.as_of = x.as_of) AS total,
                               x.en < CASE WHEN x.score_mode = 'ranked' THEN 4 ELSE 2 END OR x.score IS NULL AS insufficient,
                               coalesce(t.eligible AND (t.pct <= 0.15 OR t.dd <= -0.25) AND t.moved AND t.wider AND t.since_low >= 5 AND NOT t.alone, FALSE) AS turning
                        FROM s_strength_rows x JOIN fold f USING (theme_id, as_of) JOIN heat_flags h USING (theme_id, as_of) JOIN turning_rows t USING (theme_id, as_of))""",
}


@query("theme_insight", with_views(
    f"""SELECT theme_id, {day('as_of')},
               CASE WHEN insufficient THEN 'insufficient_data' WHEN conc THEN 'concentrated' WHEN is_hot AND changing THEN 'hot_changing' WHEN is_hot THEN 'hot' WHEN changing THEN 'changing'
                    WHEN state = 'Weakening' THEN 'weakening' WHEN state = 'Lagging' THEN 'lagging' WHEN turning THEN 'turning' WHEN state = 'Improving' THEN 'improving'
                    WHEN state = 'Leading' AND score >= 60 THEN 'leading' ELSE 'mixed' END AS title,
               insufficient OR partial OR is_hot OR conc OR coalesce(state IN ('Weakening', 'Lagging'), FALSE) AS attention,
               CASE WHEN insufficient THEN 'insufficient' WHEN partial THEN 'partial' WHEN score_mode = 'thin' THEN 'thin' ELSE 'full' END AS coverage_label FROM insight""",
    _INSIGHT,
))
def theme_insight(spark, d):
    snap = T.theme_snapshot(
        V.themes(spark, d), V.memberships(spark, d), V.all_bars(spark, d),
        V.as_of(spark, d).withColumn("stress_active", F.lit(False)), V.as_of(spark, d), V.calendar(spark, d),
    )
    rows = snap.select(
        "theme_id", "as_of", "score_mode", "quality", "core_total", F.col("strength.strength_n").alias("strength_n"),
        F.col("heat.heat_n").alias("heat_n"), F.col("strength.strength_score").alias("strength_score"),
        F.col("heat.heat_score").alias("heat_score"), F.col("velocity.state").alias("velocity_state"),
        F.col("velocity.confirmed").alias("confirmed"), F.col("heat.hot").alias("hot"), F.col("heat.hot_eligible").alias("hot_eligible"),
        F.col("heat.single_stock_driven").alias("single_stock_driven"), F.col("turning.turning_active").alias("turning_active"),
        F.col("turning.turning_eligible").alias("turning_eligible"), F.lit(True).alias("fresh"),
    )
    return flat(ST.theme_insight(rows).select("theme_id", "as_of", "title", "attention", "coverage_label"))


# ---- regime -----------------------------------------------------------------------
ROLES = {"growth": "MKT", "equal": "Brand#1", "broad": "Brand#2", "highyield": "Brand#3", "grade": "Brand#4", "semis": "Brand#5"}


def _vix(spark, d):
    """Stand-in index: 10 plus the remainder of one brand's volume."""
    return V.all_bars(spark, d).where(F.col("ticker") == "Brand#6").select("session", (10 + F.col("volume") % 30).alias("close"))


def _full(fn: str, n: int) -> str:
    w = f"(PARTITION BY ticker ORDER BY session ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(close) OVER {w} = {n} THEN {fn} OVER {w} END"


_REGIME = {
    "fx0": "SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY session) - 1 AS r1 FROM all_bars",
    "factors": f"""SELECT ticker, session, close / {_full('avg(close)', 200)} - 1 AS vs200, {_full('avg(close)', 50)} / {_full('avg(close)', 200)} - 1 AS ma50_200,
              {', '.join(f'close / lag(close, {n}) OVER (PARTITION BY ticker ORDER BY session) - 1 AS ret{n}' for n in (5, 21, 63))},
              CASE WHEN count(r1) OVER w20 = 20 THEN stddev_samp(r1) OVER w20 * sqrt(252) END AS volatility, 1 - close / {_full('max(close)', 20)} AS drawdown
          FROM fx0 WINDOW w20 AS (PARTITION BY ticker ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    "wide": f"""SELECT g.session, g.vs200, g.ret63, g.ma50_200, g.ret5, g.volatility, g.drawdown,
              (1 + q.ret63) / (1 + b.ret63) - 1 AS breadth_rs, (1 + h.ret63) / (1 + i.ret63) - 1 AS credit_rs,
              s.vs200 AS s200, s.ret63 AS s63, s.ret21 AS s21, (1 + s.ret63) / (1 + g.ret63) - 1 AS srs, 10 + v.volume % 30 AS vix
         FROM (SELECT DISTINCT session FROM factors WHERE ticker IN ({', '.join(repr(t) for t in ROLES.values())})) d
         LEFT JOIN factors g ON g.session = d.session AND g.ticker = 'MKT'
         LEFT JOIN factors q ON q.ticker = 'Brand#1' AND q.session = d.session LEFT JOIN factors b ON b.ticker = 'Brand#2' AND b.session = d.session
         LEFT JOIN factors h ON h.ticker = 'Brand#3' AND h.session = d.session LEFT JOIN factors i ON i.ticker = 'Brand#4' AND i.session = d.session
         LEFT JOIN factors s ON s.ticker = 'Brand#5' AND s.session = d.session LEFT JOIN all_bars v ON v.ticker = 'Brand#6' AND v.session = d.session""",
    "factor_scores": f"""SELECT *, {sql_piecewise('vs200', C.TREND['vs200'])} AS f1, {sql_piecewise('ret63', C.TREND['ret63'])} AS f2,
              {sql_piecewise('ma50_200', C.TREND['ma50_200'])} AS f3, {sql_piecewise('breadth_rs', C.TREND['relative'])} AS f4,
              {sql_piecewise('credit_rs', C.TREND['relative'])} AS f5,
              0.30 * {sql_piecewise('s200', C.SEMIS['vs200'])} + 0.25 * {sql_piecewise('s63', C.SEMIS['ret63'])}
                + 0.30 * {sql_piecewise('srs', C.SEMIS['relative'])} + 0.15 * {sql_piecewise('s21', C.SEMIS['ret21'])} AS semis,
              0.40 * {sql_piecewise('vix', C.INSTABILITY['vix'])} + 0.35 * {sql_piecewise('volatility', C.INSTABILITY['volatility'])}
                + 0.25 * {sql_piecewise('drawdown', C.INSTABILITY['drawdown'])} AS instability FROM wide""",
    "scores": "SELECT *, 0.35 * f1 + 0.25 * f2 + 0.15 * f3 + 0.15 * f4 + 0.10 * f5 AS trend FROM factor_scores",
    "steps": """SELECT *, lag(trend) OVER (ORDER BY session) AS prev, row_number() OVER (ORDER BY session) AS rn,
                       max(coalesce(instability >= 85, FALSE) OR coalesce(vix >= 32 AND ret5 <= -0.06, FALSE) OR coalesce(drawdown >= 0.12, FALSE))
                         OVER (ORDER BY session ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS stressed FROM scores""",
    "walk": """RECURSIVE(rn, state, days) AS (
        SELECT CAST(0 AS BIGINT), 'Neutral', 0
        UNION ALL
        SELECT rn, nxt, CASE WHEN nxt = state AND rn > 1 THEN days + 1 ELSE 1 END FROM (
          SELECT s.rn, w.state, w.days,
            CASE WHEN s.trend >= 78 AND s.prev >= 78 THEN 'Strong Bull' WHEN s.trend <= 22 AND s.prev <= 22 THEN 'Strong Bear'
                 WHEN s.trend IS NULL THEN w.state
                 WHEN w.state = 'Strong Bull' THEN CASE WHEN s.trend >= 68 THEN 'Strong Bull' WHEN s.trend >= 52 THEN 'Bull' ELSE 'Neutral' END
                 WHEN w.state = 'Bull' AND s.trend >= 52 THEN 'Bull'
                 WHEN w.state = 'Strong Bear' THEN CASE WHEN s.trend <= 32 THEN 'Strong Bear' WHEN s.trend <= 48 THEN 'Bear' ELSE 'Neutral' END
                 WHEN w.state = 'Bear' AND s.trend <= 48 THEN 'Bear'
                 WHEN s.trend >= 62 AND s.prev >= 62 THEN 'Bull' WHEN s.trend <= 38 AND s.prev <= 38 THEN 'Bear' ELSE 'Neutral' END AS nxt
          FROM walk w JOIN steps s ON s.rn = w.rn + 1))""",
    "regime_rows": """SELECT s.*, w.state, w.days, CASE WHEN NOT s.stressed THEN w.state WHEN w.state = 'Strong Bull' THEN 'Bull' WHEN w.state = 'Bull' THEN 'Neutral'
                             WHEN w.state = 'Neutral' THEN 'Bear' ELSE 'Strong Bear' END AS final_label,
                        CASE WHEN w.state IN ('Strong Bull', 'Bull') THEN coalesce(CAST((f1 + f2) / 2 > 60 AS INT), 0) + coalesce(CAST(f4 > 60 AS INT), 0) + coalesce(CAST(f5 > 60 AS INT), 0)
                             WHEN w.state IN ('Bear', 'Strong Bear') THEN coalesce(CAST((f1 + f2) / 2 < 40 AS INT), 0) + coalesce(CAST(f4 < 40 AS INT), 0) + coalesce(CAST(f5 < 40 AS INT), 0)
                             ELSE 0 END AS agree FROM steps s JOIN walk w USING (rn)""",
}


def _factors(spark, d):
    return R.price_factors(V.all_bars(spark, d))


def _row(spark, d):
    row = R.factor_row(_factors(spark, d), ROLES)
    return row.join(_vix(spark, d).select("session", F.col("close").alias("vix")), "session", "left")


@query(
    "trend_score",
    with_views(f"SELECT {day('session')}, {r('breadth_rs')} AS breadth_rs, {r('credit_rs')} AS credit_rs, {r('trend')} AS trend FROM scores", _REGIME),
)
def trend_score(spark, d):
    return flat(R.trend_score(_row(spark, d)).select("session", "breadth_rs", "credit_rs", "trend"))


@query("semis_score", with_views(f"SELECT {day('session')}, {r('srs')} AS semis_rs, {r('semis')} AS semis FROM scores", _REGIME))
def semis_score(spark, d):
    return flat(R.semis_score(_row(spark, d)).select("session", "semis_rs", "semis"))


@query(
    "instability_score",
    with_views(
        f"SELECT {day('session')}, {r('instability')} AS instability, {sql_label('instability', C.INSTABILITY_LABELS)} AS instability_label FROM scores",
        _REGIME,
    ),
)
def instability_score(spark, d):
    return flat(R.instability_score(_row(spark, d)).select("session", "instability", "instability_label"))


@query(
    "relative_strength",
    with_views(
        f"""SELECT {day('a.session', 'session')}, {r('(1 + a.ret21) / (1 + b.ret21) - 1')} AS rs
            FROM (SELECT * FROM factors WHERE ticker IN ('Brand#1', 'MKT')) k
            LEFT JOIN factors a ON a.ticker = 'Brand#1' AND a.session = k.session
            LEFT JOIN factors b ON b.ticker = 'MKT' AND b.session = k.session WHERE k.ticker = 'Brand#1'""",
        _REGIME,
    ),
)
def relative_strength(spark, d):
    out = R.relative_strength_of(V.all_bars(spark, d), "Brand#1", "MKT", 21)
    return flat(out.join(V.bars(spark, d).where(F.col("ticker") == "Brand#1").select("session"), "session", "left_semi"))


@query(
    "regime_daily",
    with_views(
        f"""SELECT {day('session')}, {r('trend')} AS trend, {r('semis')} AS semis, {r('instability')} AS instability, state, CAST(days AS BIGINT) AS state_days,
                   stressed AS stress_active, final_label, CAST(agree AS BIGINT) AS pillars_agree,
                   CASE WHEN agree - CASE WHEN state IN ('Strong Bull', 'Bull') AND coalesce(instability >= 70, FALSE) AND agree >= 2 THEN 1 ELSE 0 END >= 3 THEN 'High'
                        WHEN agree - CASE WHEN state IN ('Strong Bull', 'Bull') AND coalesce(instability >= 70, FALSE) AND agree >= 2 THEN 1 ELSE 0 END = 2 THEN 'Medium'
                        ELSE 'Low' END AS confidence, trend IS NULL OR instability IS NULL OR semis IS NULL AS missing
            FROM regime_rows""",
        _REGIME,
    ),
)
def regime_daily(spark, d):
    out = R.regime_daily(_factors(spark, d), _vix(spark, d), ROLES)
    return flat(
        out.select(
            "session", "trend", "semis", "instability", "state", "state_days", "stress_active", "final_label", "pillars_agree", "confidence", "missing"
        )
    )
