"""Theme signals over the supplied tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.operators import series as S
from tidemark.operators import themes as T
from tidemark.plans import views as V
from tidemark.plans.catalog import flat, query
from tidemark.plans.views import r, sql_label, sql_piecewise, with_views


def _core(spark, d):
    return T.core_members(V.themes(spark, d), V.memberships(spark, d))


def _frame_sql(floor: int) -> dict[str, str]:
    """Brute-force frames: every (theme, as_of) with its own eligible tickers and rows."""
    return {
        "elig": f"SELECT * FROM aligned_counts WHERE n >= {floor}",
        "elig_n": """SELECT l.theme_id, l.as_of, l.seq, any_value(l.score_mode) AS score_mode,
                            count(e.ticker) AS en
                     FROM live_core l LEFT JOIN elig e USING (theme_id, as_of, ticker)
                     GROUP BY 1, 2, 3""",
        "frame0": """SELECT e.theme_id, e.as_of, e.seq AS t, a.seq, avg(a.ret) AS tr,
                            any_value(a.bench_ret) AS br, count(*) AS c
                     FROM elig e JOIN aligned a ON a.ticker = e.ticker AND a.seq <= e.seq AND a.seq > e.seq - 379
                     GROUP BY 1, 2, 3, 4""",
        "frame": f"""SELECT * FROM (
                       SELECT f.*, x.en, x.score_mode,
                              row_number() OVER (PARTITION BY f.theme_id, f.as_of ORDER BY f.seq DESC) AS back,
                              count(*) OVER (PARTITION BY f.theme_id, f.as_of) AS len
                       FROM frame0 f JOIN elig_n x USING (theme_id, as_of) WHERE f.c = x.en)
                     WHERE len >= {floor}""",
    }


_RAE = """CASE WHEN count(*) < 2 THEN NULL
               WHEN stddev_samp(tr - br) <= 1e-12 THEN
                 CASE WHEN abs(sum(tr - br)) <= 1e-12 THEN 0.0 WHEN sum(tr - br) > 0 THEN 3.0 ELSE -3.0 END
               ELSE sum(tr - br) / (stddev_samp(tr - br) * sqrt(count(*))) END"""

_STRENGTH_VIEWS = {
    **_frame_sql(63),
    "raw_strength": f"""SELECT theme_id, as_of, {_RAE} AS ra, avg(CAST(tr > br AS INT)) AS cons
                        FROM frame WHERE back <= 63
                          AND en >= CASE WHEN score_mode = 'ranked' THEN 4 ELSE 2 END
                        GROUP BY 1, 2""",
    "strength_rows": f"""SELECT x.theme_id, x.as_of, x.en, x.score_mode, s.ra, s.cons,
                                0.7 * {sql_piecewise('s.ra', C.STRENGTH['risk_adjusted'])}
                                + 0.3 * {sql_piecewise('s.cons', C.STRENGTH['consistency'])} AS score
                         FROM elig_n x LEFT JOIN raw_strength s USING (theme_id, as_of)""",
}


D = "CAST({} AS VARCHAR) AS {}"


def day(c: str, name: str | None = None) -> str:
    return D.format(c, name or c)


@query(
    "theme_strength",
    with_views(
        f"""SELECT theme_id, {day('as_of')}, en AS strength_n, {r('ra')} AS risk_adjusted, {r('cons')} AS consistency,
                   {r('score')} AS strength_score, {sql_label('score', C.STRENGTH['labels'])} AS strength_label
            FROM strength_rows""",
        _STRENGTH_VIEWS,
    ),
)
def theme_strength(spark, d):
    out = T.strength(V.all_bars(spark, d), _core(spark, d), V.as_of(spark, d), V.themes(spark, d))
    return flat(out.drop("strength_members", "risk_adjusted_score", "consistency_score"))


@query(
    "simple_returns",
    with_views(f"SELECT ticker, {day('session')}, {r('ret', 8)} AS ret FROM rets"),
)
def simple_returns(spark, d):
    return flat(S.simple_returns(V.all_bars(spark, d)).select("ticker", "session", "ret"), 8)


@query(
    "sparse_returns",
    with_views(
        f"""SELECT ticker, {day('session')},
                   {r('close / lag(close) OVER (PARTITION BY ticker ORDER BY session) - 1', 8)} AS ret
            FROM sparse_bars"""
    ),
)
def sparse_returns(spark, d):
    return flat(S.simple_returns(V.sparse_bars(spark, d)).select("ticker", "session", "ret"), 8)


@query(
    "period_returns",
    with_views(
        f"""SELECT ticker, {day('session')},
                   {r('close / lag(close, 10) OVER (PARTITION BY ticker ORDER BY session) - 1', 8)} AS ret10
            FROM all_bars"""
    ),
)
def period_returns(spark, d):
    return flat(S.period_returns(V.all_bars(spark, d), 10), 8)


@query(
    "overlay_returns",
    with_views(
        "SELECT ticker, CAST(session AS VARCHAR) AS session, "
        + ", ".join(
            f"{r(f'close / lag(close, {n}) OVER (PARTITION BY ticker ORDER BY session) - 1', 8)} AS return_{n}d"
            for n in (1, 10, 21)
        )
        + " FROM bars WHERE ticker IN (SELECT ticker FROM memberships WHERE role = 'watch')"
    ),
)
def overlay_returns(spark, d):
    watch = V.memberships(spark, d).where(F.col("role") == "watch")
    return flat(S.overlay_returns(V.bars(spark, d), watch), 8)


def _frames(spark, d, floor):
    days = S.member_days(V.all_bars(spark, d), _core(spark, d))
    sets = S.eligible_sets(days, V.as_of(spark, d), {"x": floor})
    return days, sets, S.aligned_frames(days, S.epochs_of(sets, ["elig_x"]))


@query(
    "aligned_frame",
    with_views(
        f"""SELECT x.theme_id, {day('x.as_of', 'as_of')}, x.en AS eligible_n, count(f.seq) AS frame_rows,
                   {r('avg(f.tr)', 8)} AS mean_theme_ret, {r('avg(f.br)', 8)} AS mean_bench_ret
            FROM elig_n x LEFT JOIN frame f USING (theme_id, as_of) GROUP BY 1, x.as_of, 3""",
        _frame_sql(63),
    ),
)
def aligned_frame(spark, d):
    days, sets, frames = _frames(spark, d, 63)
    w = S.frame_window().rangeBetween(-378, 0)
    dated = S.dated_frames(
        frames.select("*", F.avg("theme_ret").over(w).alias("mean_theme_ret"), F.avg("bench_ret").over(w).alias("mean_bench_ret"))
    )
    keyed = sets.select("theme_id", "as_of", F.col("seq").alias("t"), "elig_x", S.signature(F.col("elig_x")).alias("sig"))
    ok = F.coalesce(F.col("frame_n"), F.lit(0)) >= 63
    return flat(
        keyed.join(dated, ["theme_id", "sig", "t"], "left").select(
            "theme_id", "as_of", F.size("elig_x").alias("eligible_n"), F.when(ok, F.col("frame_n")).otherwise(0).alias("frame_rows"),
            F.when(ok, F.col("mean_theme_ret")).alias("mean_theme_ret"), F.when(ok, F.col("mean_bench_ret")).alias("mean_bench_ret"),
        ),
        8,
    )


@query(
    "basket_returns",
    with_views(
        f"""SELECT theme_id, {day('session')}, {r('avg(ret)', 8)} AS theme_ret, {r('any_value(bench_ret)', 8)} AS bench_ret
            FROM (SELECT l.theme_id, l.as_of AS session, e.ticker
                  FROM (SELECT theme_id, max(as_of) AS last FROM live_core GROUP BY 1) z
                  JOIN aligned_counts e ON e.theme_id = z.theme_id AND e.as_of = z.last AND e.n >= 63
                  JOIN (SELECT DISTINCT theme_id, as_of FROM live_core) l ON l.theme_id = z.theme_id) q
            JOIN aligned a USING (ticker, session)
            GROUP BY 1, q.session
            HAVING count(*) = (SELECT count(*) FROM aligned_counts e
                               WHERE e.theme_id = q.theme_id AND e.n >= 63
                                 AND e.as_of = (SELECT max(as_of) FROM live_core k WHERE k.theme_id = q.theme_id))"""
    ),
)
def basket_returns(spark, d):
    """Basket of the set eligible on the last date, over its whole frame."""
    dates = V.as_of(spark, d)
    last = dates.agg(F.max("as_of").alias("as_of"))
    days = S.member_days(V.all_bars(spark, d), _core(spark, d))
    sets = S.eligible_sets(days, last, {"x": 63})
    frames = S.aligned_frames(days, S.epochs_of(sets, ["elig_x"]))
    return flat(frames.select("theme_id", "session", "theme_ret", "bench_ret"), 8)


_ROLL = {
    **_frame_sql(63),
    "roll": f"""SELECT x.theme_id, x.as_of, f.rae, f.cum, f.rel
                FROM elig_n x LEFT JOIN (
                  SELECT theme_id, as_of, {_RAE.replace('(tr', '(tr').strip()} AS rae,
                         exp(sum(ln(1 + tr))) - 1 AS cum, exp(sum(ln(1 + tr) - ln(1 + br))) AS rel
                  FROM frame WHERE back <= 21 GROUP BY 1, 2) f USING (theme_id, as_of)""",
}


@query(
    "rolling_measures",
    with_views(
        f"SELECT theme_id, {day('as_of')}, {r('rae')} AS rae21, {r('cum')} AS cum21, {r('rel')} AS rel21 FROM roll", _ROLL
    ),
)
def rolling_measures(spark, d):
    """Risk-adjusted excess, compounded return and relative wealth over 21 frame rows."""
    days = S.member_days(V.all_bars(spark, d), _core(spark, d))
    sets = S.eligible_sets(days, V.as_of(spark, d), {"x": 63})
    w = S.frame_window()
    layers = [
        {"rae21": S.risk_adjusted_excess(21), "cum21": S.cumulative_return("theme_ret", 21), "_rel": S.relative_wealth()},
        {"rel21": F.col("_rel") / F.lag("_rel", 21).over(w)},
    ]
    ev = T._evaluate(days, sets, {"x": 63}, layers, C.LOOKBACK_BARS)["x"]
    return flat(ev.select("theme_id", "as_of", "rae21", "cum21", "rel21"))


_VELOCITY = {
    **_frame_sql(89),
    "rel_rows": """SELECT theme_id, as_of, back, en,
                          exp(sum(ln(1 + tr) - ln(1 + br)) OVER (PARTITION BY theme_id, as_of ORDER BY seq)) AS rel
                   FROM frame""",
    "vel": """SELECT x.theme_id, x.as_of, x.seq, x.en, v.lvl, v.mom,
                     CASE WHEN lvl >= 0 AND mom >= 0 THEN 'Leading' WHEN lvl >= 0 AND mom < 0 THEN 'Weakening'
                          WHEN lvl < 0 AND mom < 0 THEN 'Lagging' WHEN lvl < 0 THEN 'Improving' END AS raw_state
              FROM elig_n x LEFT JOIN (
                SELECT theme_id, as_of, max(CASE WHEN back = 1 THEN rel END) / avg(rel) - 1 AS lvl,
                       max(CASE WHEN back = 1 THEN rel END) / max(CASE WHEN back = 22 THEN rel END) - 1 AS mom
                FROM rel_rows WHERE back <= 63 AND en >= 2 GROUP BY 1, 2) v USING (theme_id, as_of)""",
    "vel_rn": "SELECT *, row_number() OVER (PARTITION BY theme_id ORDER BY as_of) AS rn FROM vel",
    "fold": """RECURSIVE(theme_id, rn, as_of, raw_state, state, candidate, days, confirmed) AS (
        SELECT theme_id, rn, as_of, raw_state, raw_state, raw_state,
               CASE WHEN raw_state IS NULL THEN 0 ELSE 1 END, FALSE
        FROM vel_rn WHERE rn = 1
        UNION ALL
        SELECT v.theme_id, v.rn, v.as_of, v.raw_state,
               CASE WHEN v.raw_state IS NULL THEN NULL WHEN f.state IS NULL THEN v.raw_state
                    WHEN v.raw_state = f.state THEN f.state
                    WHEN (CASE WHEN f.candidate = v.raw_state THEN f.days + 1 ELSE 1 END) >= 5 THEN v.raw_state
                    ELSE f.state END,
               v.raw_state,
               CASE WHEN v.raw_state IS NULL THEN 0 WHEN f.state IS NULL THEN 1 WHEN v.raw_state = f.state THEN 0
                    WHEN (CASE WHEN f.candidate = v.raw_state THEN f.days + 1 ELSE 1 END) >= 5 THEN 0
                    WHEN f.candidate = v.raw_state THEN f.days + 1 ELSE 1 END,
               CASE WHEN v.raw_state IS NULL OR f.state IS NULL THEN FALSE WHEN v.raw_state = f.state THEN TRUE
                    ELSE (CASE WHEN f.candidate = v.raw_state THEN f.days + 1 ELSE 1 END) >= 5 END
        FROM fold f JOIN vel_rn v ON v.theme_id = f.theme_id AND v.rn = f.rn + 1)""",
}


@query(
    "velocity_raw",
    with_views(
        f"""SELECT theme_id, {day('as_of')}, en AS velocity_n, {r('lvl')} AS rs_level, {r('mom')} AS rs_momentum, raw_state
            FROM vel""",
        _VELOCITY,
    ),
)
def velocity_raw(spark, d):
    return flat(T.velocity_raw(V.all_bars(spark, d), _core(spark, d), V.as_of(spark, d)))


@query(
    "velocity_confirmed",
    with_views(
        f"""SELECT theme_id, {day('as_of')}, raw_state, state, candidate, CAST(days AS BIGINT) AS candidate_days, confirmed FROM fold""",
        _VELOCITY,
    ),
)
def velocity_confirmed(spark, d):
    raw = T.velocity_raw(V.all_bars(spark, d), _core(spark, d), V.as_of(spark, d)).select("theme_id", "as_of", "raw_state")
    return flat(T.velocity_confirmed(raw))


_MARKS = {
    "price_marks": """SELECT ticker, session,
              lead(session) OVER (PARTITION BY ticker ORDER BY session) AS nxt,
              row_number() OVER (PARTITION BY ticker ORDER BY session) AS n,
              close / lag(close, 10) OVER (PARTITION BY ticker ORDER BY session) - 1 AS move,
              CAST(close > avg(close) OVER (PARTITION BY ticker ORDER BY session ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS INT) AS up
         FROM all_bars""",
    "price_marks2": """SELECT *, CASE WHEN n >= 62 THEN up END AS now_up,
              CASE WHEN n >= 62 THEN lag(up, 10) OVER (PARTITION BY ticker ORDER BY session) END AS past_up
         FROM price_marks""",
    "dv": """SELECT ticker, session, close * volume AS dv, ln(close * volume) AS ldv,
                    row_number() OVER (PARTITION BY ticker ORDER BY session) AS n,
                    lead(session) OVER (PARTITION BY ticker ORDER BY session) AS nxt
             FROM all_bars WHERE volume IS NOT NULL""",
    "dv_lists": """SELECT a.ticker, a.session, a.nxt, a.n,
                          (SELECT median(b.ldv) FROM dv b WHERE b.ticker = a.ticker AND b.n > a.n - 3 AND b.n <= a.n) AS cur,
                          (SELECT median(b.ldv) FROM dv b WHERE b.ticker = a.ticker AND b.n > a.n - 63 AND b.n <= a.n - 3) AS med,
                          (SELECT median(b.dv) FROM dv b WHERE b.ticker = a.ticker AND b.n > a.n - 5 AND b.n <= a.n) AS recent
                   FROM dv a WHERE a.n >= 68""",
    "zs": """SELECT a.ticker, a.session, a.nxt, a.recent,
                    CASE WHEN 1.4826 * mad <= 1e-12 THEN 0.0 ELSE (cur - med) / (1.4826 * mad) END AS z
             FROM (SELECT l.*, (SELECT median(abs(b.ldv - l.med)) FROM dv b
                                WHERE b.ticker = l.ticker AND b.n > l.n - 63 AND b.n <= l.n - 3) AS mad
                   FROM dv_lists l) a""",
    "member_marks": """SELECT l.theme_id, l.as_of, l.seq, l.pos, l.ticker, p.now_up, p.past_up, p.move, z.z, z.recent
         FROM live_core l
         LEFT JOIN price_marks2 p ON p.ticker = l.ticker AND p.session <= l.as_of AND (p.nxt IS NULL OR p.nxt > l.as_of)
         LEFT JOIN zs z ON z.ticker = l.ticker AND z.session <= l.as_of AND (z.nxt IS NULL OR z.nxt > l.as_of)""",
}


@query(
    "breadth",
    with_views(
        f"""SELECT theme_id, {day('as_of')}, count(past_up) AS breadth_n,
                   CAST(coalesce(sum(now_up), 0) AS BIGINT) AS now_above, CAST(coalesce(sum(past_up), 0) AS BIGINT) AS past_above,
                   {r('sum(now_up) / count(past_up)')} AS now_fraction, {r('sum(past_up) / count(past_up)')} AS past_fraction,
                   {r('(sum(now_up) - sum(past_up)) / count(past_up)')} AS breadth_change
            FROM member_marks GROUP BY 1, as_of""",
        _MARKS,
    ),
)
def breadth(spark, d):
    return flat(T.breadth(V.all_bars(spark, d), _core(spark, d), V.as_of(spark, d), V.calendar(spark, d)))


@query(
    "activity",
    with_views(
        f"""SELECT theme_id, {day('as_of')}, count(z) AS activity_n, {r('median(z)')} AS median_z,
                   count(CASE WHEN z > 0 THEN 1 END) AS positive_z_n, {r('max(recent) / sum(recent)')} AS max_share
            FROM member_marks GROUP BY 1, as_of""",
        _MARKS,
    ),
)
def activity(spark, d):
    return flat(T.activity(V.all_bars(spark, d), _core(spark, d), V.as_of(spark, d), V.calendar(spark, d)))


_HEAT = {
    **_MARKS,
    "heat_elig": "SELECT * FROM aligned_counts WHERE n >= 10",
    "tops": """SELECT theme_id, as_of, count(move) AS moves_n, count(CASE WHEN move > 0 THEN 1 END) AS moves_up,
                      (max({'m': move, 'p': -pos, 'k': ticker}) FILTER (WHERE move IS NOT NULL)).k AS top
               FROM member_marks GROUP BY 1, 2""",
    "variants": """SELECT m.theme_id, m.as_of, m.seq, 'all' AS variant, m.ticker, e.ticker IS NOT NULL AS elig,
                          m.now_up, m.past_up, m.z, m.recent
                   FROM member_marks m LEFT JOIN heat_elig e USING (theme_id, as_of, ticker)
                   UNION ALL
                   SELECT m.theme_id, m.as_of, m.seq, 'loo', m.ticker, e.ticker IS NOT NULL, m.now_up, m.past_up, m.z, m.recent
                   FROM member_marks m LEFT JOIN heat_elig e USING (theme_id, as_of, ticker)
                   JOIN tops t ON t.theme_id = m.theme_id AND t.as_of = m.as_of AND t.moves_n >= 2 AND t.top <> m.ticker""",
    "vframe": """SELECT theme_id, as_of, variant, tr, br, back FROM (
                   SELECT f.*, row_number() OVER (PARTITION BY theme_id, as_of, variant ORDER BY s DESC) AS back,
                          count(*) OVER (PARTITION BY theme_id, as_of, variant) AS len
                   FROM (SELECT v.theme_id, v.as_of, v.variant, a.seq AS s, avg(a.ret) AS tr, any_value(a.bench_ret) AS br,
                                count(*) AS c
                         FROM variants v JOIN aligned a ON a.ticker = v.ticker AND a.seq <= v.seq AND a.seq > v.seq - 379
                         WHERE v.elig GROUP BY 1, 2, 3, 4) f
                   JOIN (SELECT theme_id, as_of, variant, count(*) AS en FROM variants WHERE elig GROUP BY 1, 2, 3) g
                     USING (theme_id, as_of, variant)
                   WHERE f.c = g.en) WHERE len >= 10""",
    "vra": f"""SELECT theme_id, as_of, variant, {_RAE} AS ra FROM vframe WHERE back <= 10 GROUP BY 1, 2, 3""",
    "vagg": """SELECT theme_id, as_of, variant, count(CASE WHEN elig THEN 1 END) AS en,
                      (sum(now_up) - sum(past_up)) / count(past_up) AS chg, median(z) AS mz,
                      max(recent) / sum(recent) AS share,
                      count(CASE WHEN elig AND past_up IS NOT NULL AND z IS NOT NULL THEN 1 END) AS heat_n
               FROM variants GROUP BY 1, 2, 3""",
    "vscore": f"""SELECT *, {sql_piecewise('ra', C.HEAT['risk_adjusted'])} * 0.3333333333333333
                        + {sql_piecewise('chg', C.HEAT['breadth'])} * 0.3333333333333333
                        + {sql_piecewise('mz', C.HEAT['activity'])} * 0.3333333333333333 AS score
                  FROM (SELECT g.*, CASE WHEN g.en >= 2 THEN x.ra END AS ra
                        FROM vagg g LEFT JOIN vra x USING (theme_id, as_of, variant))""",
    "heat_rows": """SELECT a.theme_id, a.as_of, a.score AS heat_score, a.heat_n, a.ra, a.chg, a.mz, a.share,
                           t.moves_up, t.moves_n,
                           CASE WHEN a.score IS NOT NULL AND t.moves_n >= 2 THEN t.top END AS removed,
                           CASE WHEN a.score IS NOT NULL AND t.moves_n >= 2 THEN l.score END AS loo
                    FROM vscore a JOIN tops t USING (theme_id, as_of)
                    LEFT JOIN vscore l ON l.theme_id = a.theme_id AND l.as_of = a.as_of AND l.variant = 'loo'
                    WHERE a.variant = 'all'""",
    "heat_flags": """SELECT *, heat_n >= 3 AS hot_eligible,
                            coalesce(heat_n >= 3 AND heat_score >= 75 AND moves_n >= 2 AND moves_up > moves_n / 2
                              AND loo >= 60 AND share <= 0.6, FALSE) AS hot,
                            heat_n >= 3 AND coalesce(heat_score >= 75, FALSE)
                              AND (NOT coalesce(loo >= 60, FALSE) OR NOT coalesce(share <= 0.6, FALSE)) AS single_stock_driven
                     FROM heat_rows""",
}


@query(
    "heat",
    with_views(
        f"""SELECT theme_id, {day('as_of')}, {r('heat_score')} AS heat_score, heat_n, {r('ra')} AS risk_adjusted,
                   {r('chg')} AS breadth_change, {r('mz')} AS median_z, {r('share')} AS max_share, moves_up, moves_n,
                   removed, {r('loo')} AS loo_score, hot_eligible, hot, single_stock_driven
            FROM heat_flags""",
        _HEAT,
    ),
)
def heat(spark, d):
    out = T.heat(V.all_bars(spark, d), _core(spark, d), V.as_of(spark, d), V.calendar(spark, d))
    return flat(
        out.drop("return_score", "breadth_score", "activity_score", "now_above", "past_above", "breadth_n", "positive_z_n", "activity_n")
    )


def _stress(spark, d):
    """Stand-in flag: stressed on sessions whose market close fell 4 % below the previous one."""
    rets = S.simple_returns(V.market_bars(spark, d))
    return rets.select(F.col("session").alias("as_of"), F.coalesce(F.col("ret") <= -0.04, F.lit(False)).alias("stress_active"))


_TURN = {
    **_HEAT,
    **_VELOCITY,
    **{k.replace("frame", "tframe").replace("elig", "telig"): v.replace("frame0", "tframe0").replace("elig", "telig")
       for k, v in _frame_sql(315).items()},
    "turn_rows": """SELECT *, sum(ln(1 + tr)) OVER w63 AS s, sum(ln(1 + br)) OVER w63 AS b, count(*) OVER w63 AS k,
                           exp(sum(ln(1 + tr)) OVER w) AS wealth, exp(sum(ln(1 + tr) - ln(1 + br)) OVER w) AS rel
                    FROM tframe WHERE en >= 2
                    WINDOW w AS (PARTITION BY theme_id, as_of ORDER BY seq),
                           w63 AS (PARTITION BY theme_id, as_of ORDER BY seq ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)""",
    "turn": """SELECT t.theme_id, t.as_of,
                      avg(CASE WHEN exp(t.s) - exp(t.b) <= exp(z.s) - exp(z.b) THEN 1.0 ELSE 0.0 END) AS pct,
                      any_value(z.wealth) / max(t.wealth) - 1 AS dd,
                      (min({'r': t.rel, 'k': -t.back, 'b': t.back}) FILTER (WHERE t.back <= 63)).b - 1 AS since_low
               FROM turn_rows t JOIN (SELECT * FROM turn_rows WHERE back = 1) z USING (theme_id, as_of)
               WHERE t.back <= 252 GROUP BY 1, 2""",
    "turning_rows": """SELECT x.theme_id, x.as_of, q.pct, q.dd, q.since_low, q.pct IS NOT NULL AS eligible,
                              f.raw_state = 'Improving' AND lag(f.state) OVER (PARTITION BY x.theme_id ORDER BY x.as_of) = 'Lagging' AS moved,
                              h.chg > 0 AS wider, h.single_stock_driven AS alone, m.ret <= -0.04 AS stressed
                       FROM telig_n x LEFT JOIN turn q USING (theme_id, as_of)
                       LEFT JOIN fold f USING (theme_id, as_of) LEFT JOIN heat_flags h USING (theme_id, as_of)
                       LEFT JOIN rets m ON m.ticker = 'MKT' AND m.session = x.as_of""",
}

_TURN_SELECT = f"""SELECT theme_id, {day('as_of')}, eligible AS turning_eligible, {r('pct')} AS rs_percentile, {r('dd')} AS drawdown,
           coalesce(since_low >= 5, FALSE) AS no_new_low,
           CASE WHEN eligible THEN concat_ws(',', CASE WHEN pct <= 0.15 THEN 'RS oversold' END, CASE WHEN dd <= -0.25 THEN 'deep drawdown' END,
                     CASE WHEN moved THEN 'Lagging→Improving' END, CASE WHEN wider THEN 'breadth recovering' END,
                     CASE WHEN since_low >= 5 THEN 'no new relative low' END) ELSE '' END AS reasons,
           coalesce(eligible AND (pct <= 0.15 OR dd <= -0.25) AND moved AND wider AND since_low >= 5 AND NOT alone, FALSE) AS turning_active,
           coalesce(stressed, FALSE) AS stress_caution
    FROM turning_rows"""


@query("turning", with_views(_TURN_SELECT, _TURN))
def turning(spark, d):
    bars, core, dates = V.all_bars(spark, d), _core(spark, d), V.as_of(spark, d)
    vel = T.velocity_confirmed(T.velocity_raw(bars, core, dates))
    hot = T.heat(bars, core, dates, V.calendar(spark, d))
    return flat(T.turning(bars, core, vel, hot, _stress(spark, d), dates))


_SELECTION = {
    **_frame_sql(80),
    "sel": """SELECT theme_id, as_of, exp(sum(ln(1 + tr))) - 1 AS cum, exp(sum(ln(1 + br))) - 1 AS bcum
              FROM frame WHERE back <= 21 AND en >= 4 AND score_mode = 'ranked' GROUP BY 1, 2""",
    "tails": "SELECT theme_id, as_of, seq, tr FROM frame WHERE back <= 20 AND en >= 4 AND score_mode = 'ranked'",
    "same": """SELECT t.* FROM tails t
               JOIN (SELECT as_of, seq FROM (SELECT as_of, seq, count(*) AS c FROM tails GROUP BY 1, 2)
                     JOIN (SELECT as_of, count(*) AS n FROM sel GROUP BY 1) USING (as_of) WHERE c = n) k USING (as_of, seq)""",
    "corrs": """SELECT as_of, median(c) AS mc FROM (
                  SELECT a.as_of, corr(a.tr, b.tr) AS c, count(*) AS n
                  FROM same a JOIN same b ON a.as_of = b.as_of AND a.seq = b.seq AND a.theme_id < b.theme_id
                  GROUP BY a.as_of, a.theme_id, b.theme_id) WHERE n >= 20 GROUP BY 1""",
    "sel_day": """SELECT s.session AS as_of, count(x.cum) AS n, stddev_pop(x.cum) AS disp, avg(CAST(x.cum > x.bcum AS INT)) AS outp
                  FROM sessions s LEFT JOIN sel x ON x.as_of = s.session GROUP BY 1""",
}


@query(
    "selection",
    with_views(
        f"""SELECT {day('as_of')},
                   CASE WHEN n < 3 THEN 'UNAVAILABLE' WHEN mc IS NOT NULL AND disp >= 0.04 AND mc <= 0.65 THEN 'HIGH'
                        WHEN mc IS NOT NULL AND (disp <= 0.02 OR mc >= 0.85) THEN 'LOW' ELSE 'NORMAL' END AS label,
                   CASE WHEN n >= 3 THEN {r('disp')} END AS dispersion, CASE WHEN n >= 3 THEN {r('mc')} END AS median_correlation,
                   CASE WHEN n >= 3 THEN {r('outp')} END AS outperform_fraction, n AS themes_n
            FROM sel_day LEFT JOIN corrs USING (as_of)""",
        _SELECTION,
    ),
)
def selection(spark, d):
    ranked = V.themes(spark, d).where(F.col("score_mode") == "ranked")
    members = T.core_members(ranked, V.memberships(spark, d), benchmark="MKT")
    return flat(T.selection(V.all_bars(spark, d), members, V.as_of(spark, d)))


@query(
    "data_quality",
    with_views(
        f"""SELECT x.theme_id, {day('x.as_of', 'as_of')}, x.score_mode,
                   CASE WHEN x.score_mode = 'ranked' AND x.en >= 4 THEN 'ok' WHEN x.score_mode = 'thin' AND x.en >= 2 THEN 'thin'
                        ELSE 'insufficient' END AS quality,
                   m.total AS core_total, x.en AS strength_eligible_n, h.heat_n AS heat_eligible_n, m.missing AS missing_core
            FROM elig_n x JOIN heat_flags h USING (theme_id, as_of)
            JOIN (SELECT l.theme_id, l.as_of, count(*) AS total,
                         coalesce(string_agg(CASE WHEN f.f IS NULL OR f.f > l.as_of THEN l.ticker END, ',' ORDER BY l.pos), '') AS missing
                  FROM live_core l LEFT JOIN (SELECT ticker, min(session) AS f FROM all_bars GROUP BY 1) f USING (ticker)
                  GROUP BY 1, 2) m USING (theme_id, as_of)""",
        {**_HEAT, **_frame_sql(63)},
    ),
)
def data_quality(spark, d):
    bars, core, dates = V.all_bars(spark, d), _core(spark, d), V.as_of(spark, d)
    days = S.member_days(bars, core)
    sets = S.eligible_sets(days, dates, {"strength": C.STRENGTH["window"], "heat": C.HEAT["return_days"]})
    hot = T.heat_from(days, sets.drop("elig_strength"), T.ticker_marks(bars, V.calendar(spark, d)))
    return flat(T.data_quality(sets, bars, hot, V.themes(spark, d)))


@query(
    "theme_momentum",
    with_views(
        f"""SELECT theme_id, {day('as_of')}, {r('score')} AS score, {r('dl')} AS delta,
                   CASE WHEN dl IS NULL THEN NULL WHEN dl >= 8 THEN 'Rapidly Improving' WHEN dl >= 3 THEN 'Improving'
                        WHEN dl > -3 THEN 'Stable' WHEN dl > -8 THEN 'Deteriorating' ELSE 'Rapidly Deteriorating' END AS momentum_label
            FROM (SELECT *, score - lag(score, 15) OVER (PARTITION BY theme_id ORDER BY as_of) AS dl FROM strength_rows)""",
        _STRENGTH_VIEWS,
    ),
)
def theme_momentum(spark, d):
    st = T.strength(V.all_bars(spark, d), _core(spark, d), V.as_of(spark, d), V.themes(spark, d))
    return flat(T.theme_momentum(st.select("theme_id", "as_of", F.col("strength_score").alias("score"))))


_S = {f"s_{k}": v for k, v in _STRENGTH_VIEWS.items()}
for _name in _STRENGTH_VIEWS:
    _S = {k: re.sub(rf"\b((?:FROM|JOIN)\s+){_name}\b", rf"\1s_{_name}", v) for k, v in _S.items()}

_SNAPSHOT = f"""SELECT x.theme_id, {day('x.as_of', 'as_of')},
         CASE WHEN x.score_mode = 'ranked' AND x.en >= 4 THEN 'ok' WHEN x.score_mode = 'thin' AND x.en >= 2 THEN 'thin' ELSE 'insufficient' END AS quality,
         (SELECT count(*) FROM live_core l WHERE l.theme_id = x.theme_id AND l.as_of = x.as_of) AS core_total, {r('x.score')} AS strength_score, {sql_label('x.score', C.STRENGTH['labels'])} AS strength_label,
         f.state AS velocity_state, f.confirmed AS velocity_confirmed, {r('h.heat_score')} AS heat_score, h.hot,
         coalesce(t.eligible AND (t.pct <= 0.15 OR t.dd <= -0.25) AND t.moved AND t.wider AND t.since_low >= 5 AND NOT t.alone, FALSE) AS turning_active, {r('t.pct')} AS rs_percentile
      FROM s_strength_rows x JOIN fold f USING (theme_id, as_of) JOIN heat_flags h USING (theme_id, as_of) JOIN turning_rows t USING (theme_id, as_of)"""


@query("theme_snapshot", with_views(_SNAPSHOT, {**_TURN, **_S}))
def theme_snapshot(spark, d):
    """Nested snapshot of every theme and date, flattened to its main values."""
    snap = T.theme_snapshot(
        V.themes(spark, d), V.memberships(spark, d), V.all_bars(spark, d), _stress(spark, d), V.as_of(spark, d),
        V.calendar(spark, d),
    )
    return flat(
        snap.select(
            "theme_id", "as_of", "quality", "core_total", F.col("strength.strength_score").alias("strength_score"),
            F.col("strength.strength_label").alias("strength_label"), F.col("velocity.state").alias("velocity_state"),
            F.col("velocity.confirmed").alias("velocity_confirmed"), F.col("heat.heat_score").alias("heat_score"),
            F.col("heat.hot").alias("hot"), F.col("turning.turning_active").alias("turning_active"),
            F.col("turning.rs_percentile").alias("rs_percentile"),
        )
    )
