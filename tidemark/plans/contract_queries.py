"""Dimensions, checks, payload parsing and guarded merges over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions import scoring as SC
from tidemark.functions import validity as VA
from tidemark.functions.hashing import record_hash
from tidemark.operators import checks as K
from tidemark.operators import dims as DM
from tidemark.plans import views as V
from tidemark.plans.catalog import flat, query
from tidemark.plans.portfolio_queries import _LEDGER, _PERIODS, _periods, dividends, flows, holdings, snapshots
from tidemark.plans.theme_queries import day
from tidemark.plans.views import m, money, r, sql_label, sql_piecewise, with_views
from tidemark.sources import readers as RD
from tidemark.sources import sinks as SK

# ---- scalar functions ----------------------------------------------------------------
_ANCHOR = C.STRENGTH["risk_adjusted"]


@query("piecewise_score", f"SELECT o_orderkey, {r(sql_piecewise('(o_totalprice / 100000 - 2.5)', _ANCHOR), 9)} AS score FROM orders")
def piecewise_score(spark, d):
    o = V.table(spark, d, "orders")
    return flat(o.select("o_orderkey", SC.piecewise_score(F.col("o_totalprice") / 100000 - 2.5, _ANCHOR).alias("score")), 9)


@query("band_label", f"SELECT o_orderkey, {sql_label('o_totalprice / 5000', C.STRENGTH['labels'])} AS label FROM orders")
def band_label(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", SC.band_label(F.col("o_totalprice") / 5000, C.STRENGTH["labels"]).alias("label"))


@query("weighted_score", f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, {r('0.7 * l_quantity + 0.3 * CASE WHEN l_discount > 0.02 THEN l_discount * 100 END')} AS score FROM lineitem")
def weighted_score(spark, d):
    li = V.table(spark, d, "lineitem")
    score = SC.weighted_score({"a": F.col("l_quantity"), "b": F.when(F.col("l_discount") > 0.02, F.col("l_discount") * 100)}, {"a": 0.7, "b": 0.3})
    return flat(li.select("l_orderkey", "l_linenumber", "l_partkey", score.alias("score")))


@query("validity", """SELECT doc_id, nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE ' ' || lang || ' ' END), '') AS cleaned, doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS finite, doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND n_chars > 500 AS pos FROM documents""")
def validity(spark, d):
    k = F.col("doc_id")
    x = F.when(k % 5 == 0, float("nan")).when(k % 7 == 0, float("inf")).otherwise(F.col("n_chars") - 500.0)
    text = F.when(k % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("lang"), F.lit(" ")))
    return V.table(spark, d, "documents").select("doc_id", VA.clean(text).alias("cleaned"), SC.is_finite(x).alias("finite"), SC.positive(x).alias("pos"))


@query(
    "parse_dates",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day,
              CASE WHEN o_orderkey % 4 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 05:00:00' END AS utc FROM orders""",
)
def parse_dates(spark, d):
    k, dd = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd")
    text = (
        F.when(k == 0, dd).when(k == 1, F.concat(dd, F.lit("T05:00:00Z"))).when(k == 2, F.concat(dd, F.lit("T05:00:00+09:00"))).otherwise(F.concat(F.lit("2024-13-"), F.lit("45")))
    )
    return flat(V.table(spark, d, "orders").select("o_orderkey", VA.parse_date(text).alias("day"), VA.parse_utc(text).alias("utc")))


@query("vix_level", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'unconfirmed' WHEN x < 15 THEN 'low' WHEN x < 20 THEN 'moderate' WHEN x < 30 THEN 'elevated' ELSE 'high' END AS level FROM (SELECT *, 10 + o_totalprice / 20000 AS x FROM orders)")
def vix_level(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", SC.vix_level(10 + F.col("o_totalprice") / 20000, F.col("o_orderkey") % 9 != 0).alias("level"))


@query("record_hash", "SELECT o_orderkey, sha256(length(CAST(o_orderkey AS VARCHAR)) || ':' || o_orderkey || '|' || length(o_orderstatus) || ':' || o_orderstatus || '|~') AS hash FROM orders")
def record_hash_query(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", record_hash(F.col("o_orderkey"), F.col("o_orderstatus"), F.lit(None).cast("string")).alias("hash"))


# ---- dimensions ---------------------------------------------------------------------
@query("effective_at", with_views(f"SELECT theme_id, ticker, {day('as_of')} FROM live_core"))
def effective_at(spark, d):
    core = V.memberships(spark, d).where(F.col("role") == "core")
    return flat(DM.effective_at(core, V.as_of(spark, d)).select("theme_id", "ticker", "as_of"))


@query("theme_members", with_views(
    f"""SELECT theme_id, {day('s.session', 'as_of')}, coalesce(string_agg(CASE WHEN role = 'core' THEN ticker END, ',' ORDER BY pos), '') AS core,
               coalesce(string_agg(CASE WHEN role = 'related' THEN ticker END, ',' ORDER BY pos), '') AS related, coalesce(string_agg(CASE WHEN role = 'watch' THEN ticker END, ',' ORDER BY pos), '') AS watch,
               coalesce(string_agg(CASE WHEN notes LIKE '%overlay%' THEN ticker END, ',' ORDER BY pos), '') AS overlay
        FROM memberships m JOIN sessions s ON s.session >= coalesce(m.effective_from, DATE '0001-01-01') AND s.session <= coalesce(m.effective_to, DATE '9999-12-31') GROUP BY 1, s.session""".replace("ticker END", "upper(ticker) END")))
def theme_members(spark, d):
    return flat(DM.theme_members(V.memberships(spark, d), V.as_of(spark, d)))


#: Themes in force from successive years on; one is retired.
_STARTS = "CASE theme_id WHEN 'T3' THEN DATE '1997-01-06' WHEN 'T2' THEN DATE '1996-01-01' ELSE DATE '1996-01-01' + CAST(substr(theme_id, 2) AS INT) * 300 END"


@query("active_themes", with_views(
    f"""SELECT {day('s.session', 'as_of')}, string_agg(theme_id, ',' ORDER BY theme_id) AS theme_ids,
               CASE WHEN count(theme_id) = 0 THEN (SELECT CAST(min(f) AS VARCHAR) FROM th WHERE f > s.session) END AS next_effective
        FROM sessions s LEFT JOIN th ON th.f <= s.session AND (th.effective_to IS NULL OR s.session <= th.effective_to) AND th.theme_id <> 'T4' GROUP BY s.session""",
    {"th": f"SELECT theme_id, effective_to, {_STARTS} AS f FROM themes"}))
def active_themes(spark, d):
    t = V.themes(spark, d).withColumn("effective_from", F.expr(_STARTS)).withColumn("status", F.when(F.col("theme_id") == "T4", "retired").otherwise("active"))
    return flat(DM.active_themes(t, V.as_of(spark, d)))


@query("price_universe", with_views(
    f"""SELECT DISTINCT {day('s.session', 'as_of')}, t AS ticker FROM sessions s JOIN (
          SELECT m.theme_id, upper(m.ticker) AS t, m.effective_from AS f, m.effective_to AS e, h.effective_from AS hf FROM memberships m JOIN themes h USING (theme_id) WHERE role IN ('core', 'watch')
          UNION ALL SELECT theme_id, 'MKT', NULL, NULL, effective_from FROM themes) x
        ON s.session >= coalesce(x.f, DATE '0001-01-01') AND s.session <= coalesce(x.e, DATE '9999-12-31') AND s.session >= coalesce(x.hf, DATE '0001-01-01')"""))
def price_universe(spark, d):
    return flat(DM.price_universe(V.themes(spark, d), V.memberships(spark, d), V.as_of(spark, d)))


@query("membership_of", with_views(
    f"""SELECT ticker, theme_id, {day('s.session', 'as_of')}, arg_min(role, CASE role WHEN 'core' THEN 0 WHEN 'related' THEN 1 ELSE 2 END) AS role
        FROM memberships m JOIN sessions s ON s.session >= coalesce(m.effective_from, DATE '0001-01-01') AND s.session <= coalesce(m.effective_to, DATE '9999-12-31') GROUP BY 1, 2, s.session"""))
def membership_of(spark, d):
    return flat(DM.membership_of(V.memberships(spark, d), V.as_of(spark, d)))


@query("effective_at_exclusive", with_views(
    """SELECT o_orderkey, ticker FROM (SELECT *, 'T' || o_orderkey % 5 AS theme_id FROM orders) o JOIN memberships m ON m.theme_id = o.theme_id AND m.role = 'core'
       WHERE CAST(o_orderdate AS DATE) >= coalesce(effective_from, DATE '1990-01-01') AND (effective_to IS NULL OR CAST(o_orderdate AS DATE) < effective_to)
         AND CAST(coalesce(effective_from, DATE '1990-01-01') AS TIMESTAMP) + INTERVAL '30 days' <= o_orderdate"""))
def effective_at_exclusive(spark, d):
    start = F.coalesce("effective_from", F.to_date(F.lit("1990-01-01")))
    defs = V.memberships(spark, d).where(F.col("role") == "core").select(
        "theme_id", "ticker", start.alias("valid_from"), F.col("effective_to").alias("valid_to"), (start.cast("timestamp") + F.expr("INTERVAL 30 DAYS")).alias("known_at")
    )
    req = V.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("T"), (F.col("o_orderkey") % 5).cast("string")).alias("theme_id"), F.col("o_orderdate").cast("timestamp").alias("issued_at"))
    return DM.effective_at_exclusive(defs, req).select("o_orderkey", "ticker")


def _listings(spark, d):
    p, k = V.table(spark, d, "part"), F.col("p_partkey")
    word = F.element_at(F.array(*[F.lit(x) for x in ("2x", "Bull", "Gold", "Income")]), (k % 4 + 1).cast("int"))
    return p.select(
        F.concat(F.lit("F"), (k % 700).cast("string")).alias("symbol"), F.concat_ws(" ", F.col("p_name"), word, F.col("p_type"), F.when(k % 5 != 0, "ETF").otherwise("Note")).alias("name"),
        F.when(k % 11 == 0, "Canada").otherwise("United States").alias("country"), F.lit("USD").alias("currency"), F.lit("ETF").alias("type"),
        F.when(k % 13 == 0, "XXXX").otherwise("ARCX").alias("mic_code"), F.lit("ARCA").alias("exchange"), k.alias("pos"),
    )


_LIST = """SELECT 'F' || p_partkey % 700 AS symbol, p_name || ' ' || ['2x', 'Bull', 'Gold', 'Income'][p_partkey % 4 + 1] || ' ' || p_type || CASE WHEN p_partkey % 5 <> 0 THEN ' ETF' ELSE ' Note' END AS name,
              CASE WHEN p_partkey % 11 = 0 THEN 'Canada' ELSE 'United States' END AS country, CASE WHEN p_partkey % 13 = 0 THEN 'XXXX' ELSE 'ARCX' END AS mic, p_partkey AS pos FROM part"""


@query("discover_universe", f"""WITH l AS ({_LIST}) SELECT ticker, min(automatic) AS automatic FROM (
  SELECT 'MU' AS ticker, FALSE AS automatic UNION ALL SELECT 'WIDGET', FALSE UNION ALL SELECT 'OLD1', TRUE
  UNION ALL SELECT DISTINCT symbol, TRUE FROM l WHERE country = 'United States' AND mic = 'ARCX' AND regexp_matches(symbol, '^[A-Z][A-Z0-9]{{0,4}}$') AND regexp_matches(name, '\\bETF\\b')
    AND (regexp_matches(name, '(?i)\\bgold\\b') OR (regexp_matches(name, '(?i)\\b[123]x\\b|\\bbull\\b') AND regexp_matches(name, '(?i)\\bwidget\\b')))) GROUP BY 1""")
def discover_universe(spark, d):
    prev = spark.sql("SELECT 'OLD1' AS ticker UNION ALL SELECT 'not a ticker'")
    return DM.discover_universe(["MU", "WIDGET"], _listings(spark, d), prev, topics=["gold"]).select("ticker", "automatic")


@query("work_queue", """SELECT ticker FROM (SELECT DISTINCT 'F' || p_partkey % 700 AS ticker, p_partkey % 700 AS k FROM part) WHERE k % 3 <> 0
  ORDER BY CASE WHEN k < 10 THEN k END NULLS LAST, CASE WHEN k % 4 <> 0 THEN k % 50 END NULLS FIRST, ticker LIMIT 120""")
def work_queue(spark, d):
    k = F.col("k")
    ids = V.table(spark, d, "part").select((F.col("p_partkey") % 700).alias("k")).distinct().withColumn("ticker", F.concat(F.lit("F"), k.cast("string")))
    universe = ids.select("ticker", F.when(k < 10, k).alias("pos"))
    attempts = ids.where(k % 4 != 0).select("ticker", (F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.expr("make_dt_interval(cast(k % 50 as int))")).alias("last_attempt_at"))
    return DM.work_queue(universe, ids.where(k % 3 == 0), attempts, 120).select("ticker")


# ---- checks ---------------------------------------------------------------------------
@query("check_config", with_views(
    """SELECT 'purity' AS rule, theme_id || '|' || entity_id || '|' || role AS key, 'unknown' AS detail FROM memberships WHERE pos % 10 = 4
       UNION ALL SELECT 'effective_from_required', theme_id || '|' || entity_id || '|' || role, NULL FROM memberships WHERE pos % 25 = 2
       UNION ALL SELECT 'ends_before_start', theme_id || '|' || entity_id || '|' || role, '1995-01-01' FROM memberships WHERE pos % 25 = 11
       UNION ALL SELECT 'overlapping_core', entity_id, 'T9' FROM memberships WHERE role = 'core' AND pos % 6 = 0 AND pos % 25 NOT IN (2, 11)
       UNION ALL SELECT 'unknown_theme', 'T9|' || entity_id || '|core', 'T9' FROM memberships WHERE role = 'core' AND pos % 6 = 0
       UNION ALL SELECT 'unknown_entity', theme_id || '|' || entity_id || '|' || role, entity_id FROM memberships WHERE pos = 25
       UNION ALL SELECT 'ticker_mismatch', theme_id || '|' || entity_id || '|' || role, ticker FROM memberships WHERE pos = 24
       UNION ALL SELECT 'ticker_mismatch', 'T9|' || entity_id || '|core', ticker FROM memberships WHERE pos = 24 AND role = 'core'
       UNION ALL SELECT 'public_without_ticker', 'E13', NULL FROM brands WHERE n = 13
       UNION ALL SELECT 'class_to_mode', theme_id, 'ranked' FROM themes WHERE theme_id = 'T3'
       UNION ALL SELECT 'benchmark_required', theme_id, NULL FROM themes WHERE theme_id = 'T1'"""))
def check_config(spark, d):
    """The fixture configuration with planted faults."""
    m_ = V.memberships(spark, d)
    p = F.col("pos")
    base = m_.withColumn("purity", F.when(p % 10 == 4, "unknown").otherwise("high")).withColumn("effective_from", F.when(p % 25 != 2, F.coalesce("effective_from", F.to_date(F.lit("1996-01-01"))))).withColumn(
        "effective_to", F.when(p % 25 == 11, F.to_date(F.lit("1995-01-01"))).otherwise(F.col("effective_to"))
    )
    extra = base.where((F.col("role") == "core") & (p % 6 == 0)).withColumn("theme_id", F.lit("T9")).withColumn("effective_from", F.to_date(F.lit("1997-01-06"))).withColumn("purity", F.lit("high"))
    rows = base.unionByName(extra)
    ents = m_.select("entity_id", F.when(p == 24, "OTHER").when(p != 13, F.col("ticker")).alias("ticker"), p.alias("pos")).distinct().where(p != 25).withColumn("status", F.lit("public"))
    th = V.themes(spark, d).withColumn("primary_benchmark", F.when(F.col("theme_id") != "T1", F.col("primary_benchmark")))
    return K.check_config(th, ents, rows)


@query("config_warnings", with_views("SELECT 'thin_monitor' AS rule, theme_id AS key, CAST(count(*) AS VARCHAR) AS detail FROM core WHERE score_mode = 'thin' GROUP BY 2"))
def config_warnings(spark, d):
    return K.config_warnings(V.themes(spark, d), V.memberships(spark, d))


@query("validate_candidate", with_views(
    """SELECT CASE theme_id WHEN 'T1' THEN 'newly_insufficient' WHEN 'T2' THEN 'new_missing_data' WHEN 'T3' THEN 'fewer_strength_eligible' ELSE 'lost_strength_score' END AS rule, theme_id AS key,
              CASE theme_id WHEN 'T2' THEN 'Brand#11' WHEN 'T3' THEN '3' END AS detail FROM themes WHERE theme_id <> 'T0'"""))
def validate_candidate(spark, d):
    """Two neighbouring snapshots built from bars, the second with planted faults."""
    bars = V.bars(spark, d)
    n = F.floor((F.regexp_extract("ticker", r"(\d+)", 1).cast("int") - 1) / 5)
    per = bars.groupBy(F.concat(F.lit("T"), n.cast("string")).alias("theme_id")).agg(F.count(F.lit(1)).alias("c"), F.sort_array(F.collect_set("ticker")).alias("core_members"))

    def snap(date, shift):
        return per.select(
            "theme_id", F.to_date(F.lit(date)).alias("as_of"), F.lit("ranked").alias("score_mode"), F.lit("1").alias("definition_version"), "core_members",
            F.array().cast("array<string>").alias("related_members"), F.array().cast("array<string>").alias("watch_members"), F.lit("MKT").alias("benchmark"),
            F.when((F.col("theme_id") == "T1") & F.lit(shift), "insufficient").otherwise("ok").alias("quality"),
            F.when((F.col("theme_id") == "T2") & F.lit(shift), F.array(F.lit("Brand#11"))).otherwise(F.array().cast("array<string>")).alias("missing_core"),
            F.when((F.col("theme_id") == "T3") & F.lit(shift), 3).otherwise(5).alias("strength_n"), F.lit(5).alias("heat_n"),
            F.when((F.col("theme_id") == "T4") & F.lit(shift), None).otherwise(F.col("c") % 100).cast("double").alias("strength_score"), F.lit(50.0).alias("heat_score"),
        )

    a, b = snap("2001-05-21", False), snap("2001-05-28", True)
    hist = lambda s: s.select("as_of", "theme_id", record_hash(F.col("theme_id"), F.col("as_of")).alias("content_hash"))
    return K.validate_candidate(a, b, hist(a), hist(a).unionByName(hist(b)))


@query("check_holdings", with_views(
    """SELECT * FROM (SELECT 'currency' AS rule, account_id || '|' || hid AS key, 'EUR' AS detail FROM (SELECT DISTINCT account_id, ticker || '-' || br || '-' || currency AS hid FROM hold0) WHERE account_id % 97 = 0
       UNION ALL SELECT 'decision_differs', account_id || '|' || ticker, NULL FROM (SELECT account_id, ticker, min(br % 2) AS a, max(br % 2) AS b FROM hold0 GROUP BY 1, 2) WHERE a <> b AND account_id % 89 = 0)""", _PERIODS))
def check_holdings(spark, d):
    h = holdings(spark, d)
    a = F.col("account_id")
    rows = h.withColumn("holding_id", F.concat_ws("-", "ticker", F.substring("broker", 2, 9), "currency")).withColumn("currency", F.when(a % 97 == 0, "EUR").otherwise(F.col("currency"))).withColumn(
        "decision", F.when((a % 89 == 0) & (F.substring("broker", 2, 9).cast("int") % 2 == 1), "review").otherwise("hold")
    ).withColumn("ticker_raw", F.col("ticker")).withColumn("ticker", F.replace(F.upper(F.col("ticker")), F.lit("#"), F.lit(".")))
    out = K.check_holdings(rows)
    return out.withColumn("key", F.when(F.col("rule") == "decision_differs", F.replace(F.col("key"), F.lit("BRAND."), F.lit("Brand#"))).otherwise(F.col("key")))


@query("check_ledgers", with_views(
    """SELECT 'flow_sign' AS rule, account_id || '|' || k AS key, 'deposit' AS detail FROM flow0 WHERE amount < 0
       UNION ALL SELECT 'dividend_status', account_id || '|' || k, 'planned' FROM (SELECT o_custkey AS account_id, o_orderkey AS k FROM orders WHERE o_orderkey % 11 = 0)""", _LEDGER))
def check_ledgers(spark, d):
    o = V.table(spark, d, "orders")
    fl = o.select(F.col("o_custkey").alias("account_id"), F.col("o_orderkey").alias("flow_id"), F.to_date("o_orderdate").alias("date"), F.lit(None).cast("timestamp").alias("ts"),
                  F.when(F.col("o_orderpriority").startswith("1"), -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("amount_jpy"), F.lit("deposit").alias("type"))
    k = V.table(spark, d, "orders")
    dv = k.select(F.col("o_custkey").alias("account_id"), F.col("o_orderkey").alias("dividend_id"), (F.col("o_totalprice") / 1000).alias("net_amount"), F.lit(1.0).alias("fx"),
                  F.when(F.col("o_orderkey") % 11 == 0, "planned").otherwise("paid").alias("status"))
    sn = snapshots(spark, d).withColumn("allocation", F.array((F.col("assets_jpy") * 0.4), (F.col("assets_jpy") * 0.6)))
    return K.check_ledgers(sn, fl, dv)


@query("check_periods", with_views("SELECT 'overlapping_period' AS rule, account_id || '|' || nxt AS key, NULL AS detail FROM (SELECT *, lead(start) OVER (PARTITION BY account_id ORDER BY start) AS nxt FROM periods) WHERE account_id % 50 = 0 AND nxt IS NOT NULL", _PERIODS))
def check_periods(spark, d):
    p = _periods(spark, d).withColumn("end", F.when(F.col("account_id") % 50 != 0, F.col("end")))
    return K.check_periods(p)


@query("check_calendar", with_views(
    """SELECT 'coverage_gap' AS rule, CAST(CAST(g AS DATE) AS VARCHAR) AS key, NULL AS detail FROM (SELECT unnest(generate_series((SELECT min(session) FROM sessions), (SELECT max(session) FROM sessions), INTERVAL '1 day')) AS g) WHERE dayofweek(g) = 3
       AND CAST(g AS DATE) NOT IN (SELECT session FROM sessions)
       UNION ALL SELECT 'session_date', CAST(session AS VARCHAR), NULL FROM sessions"""))
def check_calendar(spark, d):
    """Weekly sessions close on another day; Wednesdays are neither sessions nor closures."""
    s = V.sessions(spark, d)
    lo, hi = s.agg(F.min("session"), F.max("session")).first()
    days = spark.range(1).select(F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("date")).where(F.dayofweek("date") != 4)
    closed = days.join(s.select(F.col("session").alias("date")), "date", "left_anti")
    return K.check_calendar(s, closed, str(lo), str(hi))


@query("check_archive", with_views(
    """SELECT 'ticker' AS rule, ticker || '|' || session AS key, ticker AS detail FROM bars WHERE ticker = 'Brand#3' UNION ALL SELECT 'value', 'BRAND' || substr(ticker, 7) || '|' || session, '-1.0' FROM bars WHERE volume < 100 AND ticker <> 'Brand#3' UNION ALL SELECT 'value', ticker || '|' || session, '-1.0' FROM bars WHERE volume < 100 AND ticker = 'Brand#3'
       UNION ALL SELECT 'too_long', 'BRAND' || substr(ticker, 7), CAST(count(*) AS VARCHAR) FROM bars WHERE ticker <> 'Brand#3' GROUP BY ticker HAVING count(*) > 356
       UNION ALL SELECT 'too_long', ticker, CAST(count(*) AS VARCHAR) FROM bars WHERE ticker = 'Brand#3' GROUP BY ticker HAVING count(*) > 356"""))
def check_archive(spark, d):
    b = V.bars(spark, d)
    t = F.when(F.col("ticker") == "Brand#3", F.col("ticker")).otherwise(F.concat(F.lit("BRAND"), F.substring("ticker", 7, 9)))
    rows = b.select(t.alias("ticker"), F.col("session").alias("date"), F.when(F.col("volume") < 100, -1.0).otherwise(F.col("close")).alias("close"), F.lit("USD").alias("currency"))
    return K.check_archive(rows, limit=356)


# ---- sources ------------------------------------------------------------------------
def _payloads(spark, d):
    """One provider document per brand, with repeated and unreadable rows."""
    n = F.regexp_extract("ticker", r"(\d+)", 1).cast("int")
    b = V.bars(spark, d).withColumn("n", n)
    bad = (F.dayofyear("session") % 50 == 0) & (n % 3 == 0)
    row = F.struct(
        F.col("session").cast("string").alias("datetime"), F.when(bad, "n/a").otherwise(F.col("close").cast("string")).alias("close"), F.when(F.col("volume") % 7 == 0, "none").otherwise(F.col("volume").cast("string")).alias("volume")
    )
    meta = F.struct("ticker", F.lit("1day"), F.when(n % 10 == 7, "EUR").otherwise("USD"), F.lit("X"))
    per = b.groupBy("ticker", "n").agg(F.sort_array(F.collect_list(row)).alias("values"))
    values = F.when(F.col("n") % 5 == 1, F.concat("values", F.slice("values", 1, 1))).otherwise(F.col("values"))
    doc = F.struct(
        F.when(F.col("n") == 8, "error").otherwise("ok").alias("status"), F.lit(None).cast("string").alias("code"),
        F.struct(F.col("ticker").alias("symbol"), F.lit("1day").alias("interval"), F.when(F.col("n") % 10 == 7, "EUR").otherwise("USD").alias("currency"), F.lit("X").alias("exchange")).alias("meta"), values.alias("values"),
    )
    return per.select("ticker", F.to_json(doc).alias("body"))


@query("parse_price_payload", with_views(
    f"""SELECT ticker, {day('session')}, {m('close')} AS close, {m('CASE WHEN CAST(volume AS BIGINT) % 7 <> 0 THEN volume END')} AS volume
        FROM (SELECT *, CAST(regexp_extract(ticker, '(\\d+)', 1) AS INT) AS n FROM bars) WHERE n <> 8 AND NOT (n % 3 = 0 AND dayofyear(session) % 50 = 0)"""))
def parse_price_payload(spark, d):
    out = RD.parse_price_payload(_payloads(spark, d))
    return out.select("ticker", F.col("session").cast("string").alias("session"), money("close"), money("volume"))


_STRICT = """SELECT ticker, CASE WHEN n = 8 THEN 'unavailable' WHEN n % 10 = 7 THEN 'identity_or_currency_mismatch' WHEN last > DATE '2001-06-18' THEN 'unclosed_bar' WHEN bad THEN 'invalid_price'
       WHEN n % 5 = 1 THEN 'duplicate_bar' WHEN NOT has THEN 'stale_prices' ELSE 'ok' END AS reason
     FROM (SELECT ticker, n, max(session) AS last, bool_or(n % 3 = 0 AND dayofyear(session) % 50 = 0) AS bad, bool_or(session = DATE '2001-06-18') AS has FROM (SELECT *, CAST(regexp_extract(ticker, '(\\d+)', 1) AS INT) AS n FROM bars) GROUP BY 1, 2)"""


@query("parse_price_payload_strict", with_views(_STRICT.replace("DATE '2001-06-18'", "(SELECT max(session) FROM sessions)")))
def parse_price_payload_strict(spark, d):
    last = V.calendar(spark, d).agg(F.max("session")).first()[0]
    bars, bad = RD.parse_price_payload_strict(_payloads(spark, d), F.to_date(F.lit(str(last))))
    return bars.select("ticker").distinct().withColumn("reason", F.lit("ok")).unionByName(bad)


def _vix_lines(spark, d):
    """Three brands a market, each a source; one of them in the other layout."""
    n = F.regexp_extract("ticker", r"(\d+)", 1).cast("int")
    return V.bars(spark, d).select(
        F.floor(n / 3).alias("market"), F.element_at(F.array(F.lit("Cboe"), F.lit("FRED"), F.lit("Other")), n % 3 + 1).alias("source"), F.datediff("session", F.lit("1990-01-01")).alias("pos"),
        F.when(n % 3 == 0, F.date_format("session", "MM/dd/yyyy")).otherwise(F.date_format("session", "yyyy-MM-dd")).alias("day"),
        F.when(F.dayofyear("session") % 40 == 0, ".").otherwise((F.col("volume") % 30).cast("string")).alias("value"),
    )


_VIX = {
    "vixn": """SELECT n // 3 AS market, CASE n % 3 WHEN 0 THEN 'Cboe' WHEN 1 THEN 'FRED' ELSE 'Other' END AS source, session AS date, volume % 30 AS close FROM (SELECT *, CAST(regexp_extract(ticker, '(\\d+)', 1) AS INT) AS n FROM bars)
               WHERE dayofyear(session) % 40 <> 0 AND volume % 30 > 0 AND session <= DATE '2001-03-01'""",
    "vixl": "SELECT * FROM vixn QUALIFY count(*) OVER (PARTITION BY market, source) >= 2",
}


@query("parse_vix_csv", with_views(f"SELECT CAST(market AS BIGINT) AS market, source, {day('date')}, {r('close')} AS close FROM vixl", _VIX))
def parse_vix_csv(spark, d):
    return flat(RD.parse_vix_csv(_vix_lines(spark, d), F.to_date(F.lit("2001-03-01")), ("market",)))


@query("choose_latest_source", with_views(
    f"""SELECT CAST(market AS BIGINT) AS market, source, {day('date', 'as_of')}, {r('close')} AS close, {r('pc')} AS previous_close FROM (SELECT *, lag(close) OVER (PARTITION BY market, source ORDER BY date) AS pc FROM vixl)
        QUALIFY row_number() OVER (PARTITION BY market ORDER BY date DESC, CASE source WHEN 'Cboe' THEN 0 WHEN 'FRED' THEN 1 ELSE 2 END) = 1""", _VIX))
def choose_latest_source(spark, d):
    vix = RD.parse_vix_csv(_vix_lines(spark, d), F.to_date(F.lit("2001-03-01")), ("market",))
    return flat(RD.choose_latest_source(vix, ["Cboe", "FRED"], ("market",)).drop("previous_as_of"))


_FX = {
    "fxl": """SELECT ticker, session, n, CASE WHEN n % 10 = 7 THEN 'EUR/JPY' ELSE 'USD/JPY' END AS pair, CASE WHEN n % 10 = 6 AND volume % 50 = 7 THEN NULL ELSE 100 + volume % 50 END AS rate,
              CASE WHEN n % 10 = 5 AND volume % 50 = 3 THEN 2 ELSE 1 END AS copies FROM (SELECT *, CAST(regexp_extract(ticker, '(\\d+)', 1) AS INT) AS n FROM bars)""",
    "fxv": f"""SELECT ticker, pair, CASE WHEN pair <> 'USD/JPY' THEN 'fx_identity_mismatch' WHEN max(copies) > 1 THEN 'duplicate_fx_date' WHEN count(*) > count(rate) THEN 'invalid_fx_rate'
              WHEN coalesce(date_diff('day', max(session) FILTER (WHERE session <= DATE '2001-02-28'), DATE '2001-02-28') > {RD.FX_STALE_DAYS}, true) THEN 'stale_fx' END AS reason FROM fxl GROUP BY 1, 2""",
}


@query("normalize_fx", with_views(
    f"""SELECT ticker, pair, {day('session', 'date')}, {r('rate')} AS rate, NULL AS reason FROM fxl JOIN fxv USING (ticker, pair) WHERE reason IS NULL AND session <= DATE '2001-02-28'
        UNION ALL SELECT ticker, pair, NULL, NULL, reason FROM fxv WHERE reason IS NOT NULL""", _FX))
def normalize_fx(spark, d):
    """Every brand a feed; some are of another pair, some repeat a date or hold an unreadable rate."""
    n, rate = F.regexp_extract("ticker", r"(\d+)", 1).cast("int"), F.col("volume") % 50
    twice = F.when((n % 10 == 5) & (rate == 3), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    raw = V.bars(spark, d).select(
        "ticker", F.when(n % 10 == 7, "EUR/JPY").otherwise("USD/JPY").alias("pair"), F.lit("ok").alias("status"), F.lit("1day").alias("interval"), F.col("session").cast("string").alias("date"),
        F.when((n % 10 == 6) & (rate == 7), "n/a").otherwise((100 + rate).cast("string")).alias("rate"), F.explode(twice).alias("copy"),
    )
    good, bad = RD.normalize_fx(raw, F.to_date(F.lit("2001-03-05")), F.to_timestamp(F.lit("2001-03-01 09:00:00")), ("ticker",))
    return flat(good.select("ticker", "pair", "date", "rate").unionByName(bad, allowMissingColumns=True))


@query("normalize_listings", f"WITH l AS ({_LIST}) SELECT symbol || '|' || mic || '|' || country AS id, arg_max(name, pos) AS name FROM l GROUP BY 1")
def normalize_listings(spark, d):
    return RD.normalize_listings(_listings(spark, d)).select("id", "name")


@query("normalize_etfs", f"WITH l AS ({_LIST}) SELECT symbol || '|' || mic || '|' || country AS id, arg_max(name, pos) AS name FROM l WHERE country = 'United States' GROUP BY 1")
def normalize_etfs(spark, d):
    return RD.normalize_listings(_listings(spark, d), funds=True).select("id", "name")


@query("complete_listing", f"WITH l AS ({_LIST}) SELECT count(DISTINCT symbol || mic || country) >= 500 AND bool_or(symbol = 'F7') AS complete, count(DISTINCT symbol || mic || country) AS rows FROM l")
def complete_listing(spark, d):
    return RD.complete_listing(RD.normalize_listings(_listings(spark, d)), 500, "F7")


#: Ids a rendered feed file spans: no row holds more items, whatever the size of its source.
FEED_ITEMS = 2000


@query("read_feed_xml", r"""SELECT source AS source_id, pos, title, 'https://feed.example.com/n/' || doc_id AS url FROM (
  SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source, doc_id // 2000 ORDER BY doc_id) - 1 AS BIGINT) AS pos, trim(regexp_replace(regexp_replace(text, '[^A-Za-z ]', '', 'g') || ' x', ' +', ' ', 'g')) AS title
  FROM documents WHERE source <> 'src3') WHERE doc_id % 100 <= 90""")
def read_feed_xml(spark, d):
    """Feeds rendered from documents, a source's in files of at most FEED_ITEMS ids; one source carries a document type and is refused."""
    doc, k = V.table(spark, d, "documents"), F.col("doc_id")
    at = F.to_timestamp(F.lit("2024-03-01 12:00:00")) - F.expr("make_dt_interval(cast(doc_id % 100 as int))")
    # Runs of kept characters: a negated class over whole texts slows down by the number of tasks that share a process.
    words = F.array_join(F.regexp_extract_all("text", F.lit(r"[A-Za-z ]+"), F.lit(0)), "")
    item = F.concat(
        F.lit("<item><title><![CDATA["), words, F.lit(" x]]></title><link>https://Feed.example.com/n/"), k.cast("string"), F.lit("?utm_source=rss</link><pubDate>"),
        F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item>"),
    )
    per = doc.groupBy("source", F.floor(k / FEED_ITEMS).alias("part")).agg(F.sort_array(F.collect_list(F.struct(k, item.alias("x"))))["x"].alias("items"))
    xml = per.select(F.col("source").alias("source_id"), F.concat(F.when(F.col("source") == "src3", "<!DOCTYPE rss>").otherwise(""), F.lit("<rss><channel>"), F.array_join("items", ""), F.lit("</channel></rss>")).alias("xml"))
    return RD.read_feed_xml(xml, F.to_timestamp(F.lit("2024-03-01 12:00:00"))).select("source_id", F.col("pos").cast("long").alias("pos"), "title", "url")


# ---- sinks --------------------------------------------------------------------------
@query("append_history", with_views(f"SELECT ticker, {day('session', 'as_of')} FROM bars WHERE session > DATE '2000-06-05'"))
def append_history(spark, d):
    b = V.bars(spark, d).withColumnRenamed("session", "as_of")
    return flat(SK.new_snapshots(b.where(F.col("as_of") <= "2000-06-05"), b).select("ticker", "as_of"))


@query("save_observation", with_views("SELECT p <= c AS replace, p AS previous_n, c AS candidate_n FROM (SELECT count(CASE WHEN seq = mx - 1 THEN 1 END) AS p, count(CASE WHEN seq = mx THEN 1 END) AS c FROM (SELECT b.*, s.seq, max(s.seq) OVER () AS mx FROM all_bars b JOIN sessions s USING (session)))".replace("p <= c AS replace", "NOT (p > 0 AND c = 0) AS replace")))
def save_observation(spark, d):
    """Whether the newest session's view may replace the one before."""
    b = V.all_bars(spark, d).join(V.calendar(spark, d), "session").withColumnRenamed("session", "as_of")
    last = V.calendar(spark, d).agg(F.max("seq")).first()[0]
    return SK.may_replace(b.where(F.col("seq") == last - 1), b.where(F.col("seq") == last), "close")


def _quote_rows(spark, d):
    n = F.regexp_extract("ticker", r"(\d+)", 1).cast("int")
    return V.bars(spark, d).withColumn("n", n)


@query("merge_quotes", with_views(
    f"""SELECT ticker, CAST(CASE WHEN nw THEN nd WHEN ho THEN od END AS VARCHAR) AS as_of, {m('CASE WHEN nw THEN np WHEN ho THEN op END')} AS price, CASE WHEN nw THEN 'ok' WHEN ho THEN 'stale' ELSE 'missing' END AS quality,
               CASE WHEN nw THEN NULL WHEN n % 2 = 0 THEN 'rate_limited' WHEN ho THEN 'not_refreshed' ELSE 'not_available' END AS failure
        FROM (SELECT *, n % 5 <> 0 AS ho, n % 4 <> 0 AND (n % 5 = 0 OR nd >= od) AS nw FROM mq)""",
    {"mq": """SELECT ticker, CAST(regexp_extract(ticker, '(\\d+)', 1) AS INT) AS n, max(session) FILTER (WHERE session <= DATE '2001-05-01') AS od, arg_max(close, session) FILTER (WHERE session <= DATE '2001-05-01') AS op,
                     max(session) FILTER (WHERE session <= DATE '2001-05-01' - 70 + CAST(regexp_extract(ticker, '(\\d+)', 1) AS INT) * 7) AS nd,
                     arg_max(close, session) FILTER (WHERE session <= DATE '2001-05-01' - 70 + CAST(regexp_extract(ticker, '(\\d+)', 1) AS INT) * 7) AS np FROM bars GROUP BY 1"""}))
def merge_quotes(spark, d):
    b, n = _quote_rows(spark, d), F.col("n")
    last = lambda cond: b.where(cond).groupBy("ticker").agg(F.max("session").alias("as_of"), F.max_by("close", "session").alias("price")).withColumn("quality", F.lit("ok"))
    base = F.to_date(F.lit("2001-05-01"))
    old = last((F.col("session") <= base) & (n % 5 != 0))
    new = last((F.col("session") <= F.date_add(F.date_sub(base, 70), n * 7)) & (n % 4 != 0))
    universe = b.select("ticker", "n").distinct()
    out = SK.merge_quotes(universe, old, new, universe.where(n % 2 == 0).select("ticker", F.lit("rate_limited").alias("reason")))
    return out.select("ticker", F.col("as_of").cast("string").alias("as_of"), money("price"), "quality", "failure")


_ARCHIVE_SQL = """SELECT ticker, CAST(date AS VARCHAR) AS date, {close} AS close FROM (
    SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM (
      SELECT ticker, date, arg_max(close, v) AS close FROM ({rows}) GROUP BY 1, 2))"""


def _versions(spark, d):
    """Three publications of every close; later ones restate some dates, one brand changes currency."""
    b = _quote_rows(spark, d).select("ticker", F.col("session").alias("as_of"), "close", "n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("version"))
    keep = (F.col("version") == 1) | ((F.dayofyear("as_of") + F.col("version")) % 4 == 0)
    t = F.concat(F.lit("BR"), F.col("n").cast("string"))
    return b.where(keep).select(
        "version", t.alias("ticker"), "as_of", (F.col("close") * (1 + F.col("version") / 100)).alias("price"), F.when((F.col("n") == 5) & (F.col("version") == 3), "JPY").otherwise("USD").alias("currency"),
        F.when((F.col("n") == 6) & (F.col("version") == 2), "stale").otherwise("ok").alias("quality"),
    )


_VERS = "SELECT 'BR' || n AS ticker, session AS date, close * (1 + v / 100) AS close, v FROM (SELECT *, CAST(regexp_extract(ticker, '(\\d+)', 1) AS INT) AS n FROM bars) b CROSS JOIN (VALUES (1), (2), (3)) x(v) WHERE (v = 1 OR (dayofyear(session) + v) % 4 = 0) AND NOT (n = 5 AND v = 3) AND NOT (n = 6 AND v = 2) AND session < DATE '2001-06-01'"


@query("replay_snapshots", with_views(_ARCHIVE_SQL.format(close=m("close"), rows=_VERS)))
def replay_snapshots(spark, d):
    out = SK.replay_snapshots(_versions(spark, d), F.to_date(F.lit("2001-06-01")))
    return out.select("ticker", F.col("date").cast("string").alias("date"), money("close"))


@query("merge_price_archive", with_views(_ARCHIVE_SQL.format(close=m("close"), rows=_VERS)))
def merge_price_archive(spark, d):
    """The first publication as archive, the later ones merged over it: the same result as a replay."""
    v = _versions(spark, d)
    first = v.where((F.col("version") == 1) & (F.col("as_of") < "2001-06-01")).select("ticker", F.col("as_of").alias("date"), F.col("price").alias("close"), "currency")
    out = SK.merge_price_archive(first, v.where(F.col("version") > 1), F.to_date(F.lit("2001-06-01")))
    return out.select("ticker", F.col("date").cast("string").alias("date"), money("close"))


@query("shrink_guard", "SELECT count(*) AS old_n, count(CASE WHEN p_partkey % 10 < 8 THEN 1 END) AS new_n, count(CASE WHEN p_partkey % 10 < 8 THEN 1 END) / count(*) >= 0.85 AS accepted FROM part")
def shrink_guard(spark, d):
    p = V.table(spark, d, "part")
    return SK.shrink_guard(p, p.where(F.col("p_partkey") % 10 < 8))
