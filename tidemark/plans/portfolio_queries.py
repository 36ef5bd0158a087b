"""Holdings, valuation, ownership history and ledgers built from orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import accounting as A
from tidemark.operators import portfolio as P
from tidemark.operators import setups as ST
from tidemark.plans import views as V
from tidemark.plans.catalog import flat, query
from tidemark.plans.display_queries import _QUOTES, NOW, _basic, _now, _setup_quotes
from tidemark.plans.theme_queries import day
from tidemark.plans.views import kept, m, money, r, with_views

HISTORY_NOW = "2001-03-15 00:00:00"
HISTORY_NOW_SQL = f"TIMESTAMP '{HISTORY_NOW}'"
#: An order has about 22 account-sessions of history here, so a part's sums stay within a task's memory.
ORDERS_PER_PART = 1 << 15


def cents(df):
    """Result columns in engine-neutral types with doubles as comparable money."""
    plain = flat(df, None)  # rounded once, to cents
    return plain.select(*[money(n) if t == "double" else F.col(n) for n, t in plain.dtypes])


def _num(c):
    return F.regexp_extract(c, r"(\d+)", 1).cast("int")


@kept
def lots(spark, d):
    """Order lines with account, brand and the order's day."""
    orders = V.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("account_id"), F.to_date("o_orderdate").alias("day"))
    lines = V.line_items(spark, d).select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("p_brand").alias("ticker"), "l_linenumber",
        F.col("l_quantity").cast("decimal(18,2)").alias("q"), F.col("l_extendedprice").cast("decimal(18,2)").alias("p"),
    )
    return lines.join(orders.hint("shuffle_hash"), "o_orderkey")  # orders are the built side, lines are not sorted


@kept
def holdings(spark, d):
    n = F.col("l_linenumber") % 3
    currency = F.when((F.col("account_id") % 4 == 0) & (n == 0), "JPY").otherwise("USD")
    rows = lots(spark, d).groupBy("account_id", "ticker", F.concat(F.lit("B"), n.cast("string")).alias("broker"), currency.alias("currency")).agg(
        F.sum("q").cast("double").alias("quantity"), F.sum("p").cast("double").alias("_p")
    )
    return rows.withColumn("cost", F.col("_p") / F.col("quantity")).drop("_p")


@kept
def position_changes(spark, d):
    """Each order day replaces the account's portfolio by that day's lines, by brand.

    Lines are dealt by account once, in parts of about ORDERS_PER_PART orders, and stay there: an account's
    days, periods and sessions need no other shuffle.
    """
    parts = max(spark.sparkContext.defaultParallelism, V.table(spark, d, "orders").count() // ORDERS_PER_PART)
    lines = lots(spark, d).select("account_id", "day", "ticker", "q", "p").repartition(parts, "account_id")
    total = lambda c: F.sum((F.col(c) * 100).cast("long")) / 100.0  # noqa: E731 - whole cents, exact
    per = lines.groupBy("account_id", "day", "ticker").agg(total("q").alias("quantity"), total("p").alias("_p"))
    pos = F.struct("ticker", "quantity", (F.col("_p") / F.col("quantity")).alias("cost"), F.lit("USD").alias("currency"))
    return per.groupBy("account_id", "day").agg(F.collect_list(pos).alias("positions")).select(
        "account_id", F.col("day").cast("timestamp").alias("changed_at"),
        F.when((F.col("account_id") + F.dayofyear("day")) % 13 == 0, F.slice("positions", 1, 0)).otherwise(F.col("positions")).alias("positions"),
    )


@kept
def closes(spark, d):
    """As-reported closes; some brands quote in JPY, and one brand-month in seven is missing."""
    n = _num("ticker")
    return V.bars(spark, d).where((n + F.month("session")) % 25 != 0).select(
        "ticker", F.col("session").alias("date"), "close", F.when(n % 4 == 1, "JPY").otherwise("USD").alias("currency")
    )


@kept
def fx(spark, d):
    rows = V.bars(spark, d).where((F.col("ticker") == "Brand#8") & (F.dayofmonth("session") != 15))
    return rows.select(F.lit("USD/JPY").alias("pair"), F.col("session").alias("date"), (100 + F.col("volume") % 50).alias("rate"))


@kept
def cash(spark, d):
    c = V.table(spark, d, "customer").where(F.col("c_custkey") % 7 != 0)
    return c.select(
        F.col("c_custkey").alias("account_id"), F.greatest(F.col("c_acctbal") * 100, F.lit(0.0)).alias("cash_jpy"),
        F.greatest(F.col("c_acctbal") / 10, F.lit(0.0)).alias("cash_usd"),
    )


_PF = {
    "lots": """SELECT o_custkey AS account_id, CAST(o_orderdate AS DATE) AS day, o_orderkey, p_brand AS ticker, l_linenumber,
                      CAST(l_quantity AS DECIMAL(18,2)) AS q, CAST(l_extendedprice AS DECIMAL(18,2)) AS p
               FROM line_items JOIN orders ON l_orderkey = o_orderkey""",
    "hold0": """SELECT account_id, ticker, CASE WHEN account_id % 4 = 0 AND l_linenumber % 3 = 0 THEN 'JPY' ELSE 'USD' END AS currency, l_linenumber % 3 AS br,
                       CAST(sum(q) AS DOUBLE) AS quantity, CAST(sum(p) AS DOUBLE) / CAST(sum(q) AS DOUBLE) AS cost FROM lots GROUP BY 1, 2, 3, 4""",
    "hold1": "SELECT account_id, ticker, currency, sum(quantity) AS q, sum(quantity * cost) AS total FROM hold0 GROUP BY 1, 2, 3",
    "hold2": """SELECT account_id, ticker, sum(q) AS quantity, count(*) AS currencies, CASE WHEN count(*) = 1 THEN max(currency) END AS currency,
                       CASE WHEN count(*) = 1 THEN max(total) / max(q) END AS cost, sum(CASE WHEN currency = 'JPY' THEN total END) AS cj,
                       sum(CASE WHEN currency = 'USD' THEN total END) AS cu FROM hold1 GROUP BY 1, 2""",
    "closes": """SELECT ticker, session AS date, close, CASE WHEN n % 4 = 1 THEN 'JPY' ELSE 'USD' END AS currency
                 FROM (SELECT *, CAST(regexp_extract(ticker, '(\\d+)', 1) AS INT) AS n FROM bars) WHERE (n + month(session)) % 25 <> 0""",
    "fx": "SELECT session AS date, 100 + volume % 50 AS rate FROM bars WHERE ticker = 'Brand#8' AND day(session) <> 15",
    "cash": "SELECT c_custkey AS account_id, greatest(c_acctbal * 100, 0) AS cj, greatest(c_acctbal / 10, 0) AS cu FROM customer WHERE c_custkey % 7 <> 0",
}


@query(
    "aggregate_holdings",
    with_views(
        f"""SELECT account_id, ticker, {m('quantity')} AS quantity, currencies, currency, {m('cost')} AS cost FROM hold2""", _PF
    ),
)
def aggregate_holdings(spark, d):
    out = P.aggregate_holdings(holdings(spark, d))
    return out.select("account_id", "ticker", money("quantity"), "currencies", "currency", money("cost"))


def _quotes(spark, d):
    q = ST.quote_for(_basic(spark, d), _setup_quotes(spark, d), V.sessions(spark, d), _now())
    return q.select("ticker", "date", "price", "state", "closed", "quality", F.when(_num("ticker") % 4 == 1, "JPY").otherwise("USD").alias("quote_currency"))


_VALUE = {
    **_QUOTES,
    **_PF,
    "fxq": f"SELECT max(date) AS fd, arg_max(rate, date) AS rate, DATE '2001-06-06' - max(date) > 4 AS fs FROM fx WHERE date < DATE '2001-06-06'",
    "val0": """SELECT h.*, q.date AS pd, q.state, q.quality, f.rate, f.fs,
                      CASE WHEN q.ticker IS NULL THEN 'USD' WHEN CAST(regexp_extract(q.ticker, '(\\d+)', 1) AS INT) % 4 = 1 THEN 'JPY' ELSE 'USD' END AS qc,
                      CASE WHEN q.state IN ('current', 'stale') AND q.price > 0 THEN q.price * h.quantity END AS value
               FROM hold2 h LEFT JOIN quotes q ON q.ticker = h.ticker CROSS JOIN fxq f""",
    "val": """SELECT *, value * CASE WHEN qc = 'JPY' THEN 1.0 ELSE rate END AS vj, coalesce(cj, 0) + coalesce(cu * rate, 0) AS costj,
                     CASE WHEN currency = qc THEN value - cost * quantity END AS pnl,
                     coalesce(value IS NOT NULL AND (state <> 'current' OR coalesce(quality = 'stale', FALSE)), FALSE) AS st FROM val0""",
}


@query(
    "value_holdings",
    with_views(
        f"""SELECT account_id, ticker, qc AS quote_currency, {day('pd', 'price_date')}, {m('value')} AS value, {m('vj')} AS value_jpy,
                   {m('costj')} AS cost_jpy, {m('pnl')} AS pnl, {m('vj - costj')} AS pnl_jpy,
                   {m('CASE WHEN pnl IS NOT NULL AND cost * quantity > 0 THEN pnl / (cost * quantity) * 100 END')} AS pnl_rate, st AS stale FROM val""",
        _VALUE,
    ),
)
def value_holdings(spark, d):
    out = P.value_holdings(holdings(spark, d), _quotes(spark, d), fx(spark, d), _now())
    amounts = [money(c) for c in ("value", "value_jpy", "cost_jpy", "pnl", "pnl_jpy")]
    return out.select(
        "account_id", "ticker", "quote_currency", F.col("price_date").cast("string").alias("price_date"), *amounts,
        money("pnl_rate"), F.coalesce("stale", F.lit(False)).alias("stale"),
    )


@query(
    "account_value",
    with_views(
        f"""SELECT v.account_id, positions, priced_n, converted_n, complete, {m('sub')} AS subtotal_jpy, {m('nu')} AS native_usd, {m('nj')} AS native_jpy,
                   {m('c.cj + c.cu * rate')} AS cash_total_jpy, {m('CASE WHEN complete THEN sub + c.cj + c.cu * rate END')} AS assets_jpy,
                   {m('CASE WHEN complete THEN p END')} AS pnl_jpy,
                   coalesce(complete AND lo = hi AND NOT stl AND (NOT (us OR coalesce(c.cu > 0, FALSE)) OR NOT fs), FALSE) AS fresh
            FROM (SELECT account_id, count(*) AS positions, count(value) AS priced_n, count(vj) AS converted_n, count(vj) = count(*) AS complete,
                         coalesce(sum(vj), 0) AS sub, coalesce(sum(CASE WHEN qc = 'USD' THEN value END), 0) AS nu,
                         coalesce(sum(CASE WHEN qc = 'JPY' THEN value END), 0) AS nj, sum(vj - costj) AS p, min(pd) AS lo, max(pd) AS hi, bool_or(st) AS stl,
                         bool_or(qc = 'USD') AS us, max(rate) AS rate, bool_or(fs) AS fs FROM val GROUP BY 1) v LEFT JOIN cash c USING (account_id)""",
        _VALUE,
    ),
)
def account_value(spark, d):
    out = P.account_value(P.value_holdings(holdings(spark, d), _quotes(spark, d), fx(spark, d), _now()), cash(spark, d))
    return cents(out)


@query(
    "allocation",
    with_views(
        f"SELECT account_id, ticker, {r('vj / sum(vj) OVER (PARTITION BY account_id)')} AS share FROM val WHERE vj IS NOT NULL", _VALUE
    ),
)
def allocation(spark, d):
    values = P.value_holdings(holdings(spark, d), _quotes(spark, d), fx(spark, d), _now())
    return flat(P.allocation(values).drop("value_jpy"))


@query(
    "fx_as_of",
    with_views(
        f"""SELECT {day('o.day', 'day')}, {day('f.date', 'fx_date')}, {r('f.rate')} AS rate, o.day - f.date > 4 AS stale
            FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) o ASOF LEFT JOIN fx f ON o.day > f.date""",
        _PF,
    ),
)
def fx_as_of(spark, d):
    dates = V.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return flat(P.fx_as_of(fx(spark, d), dates))


_OBS = {
    "obs": """SELECT o_custkey AS account_id, CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 24) * INTERVAL '1 hour' AS seen, o_orderpriority AS basis,
                     CAST(CAST(floor(o_totalprice / 100000) AS BIGINT) AS VARCHAR) || '|' || o_orderkey % 2 AS key, o_totalprice AS assets FROM orders""",
    "obs1": "SELECT *, CAST(seen + INTERVAL '9 hours' AS DATE) AS d, lag(key) OVER (PARTITION BY account_id ORDER BY seen, key, basis, assets) AS pk FROM obs",
    "obs2": "SELECT * FROM obs1 WHERE pk IS NULL OR key <> pk",
}


@query(
    "record_observation",
    with_views(
        f"""SELECT account_id, {day('d', 'date')}, m.key AS source_key, m.basis AS basis, {m('m.assets')} AS assets_jpy, changed AS basis_changed
            FROM (SELECT account_id, d, max({{'at': seen, 'key': key, 'basis': basis, 'assets': assets}}) AS m, min(basis) <> max(basis) AS changed
                  FROM obs2 GROUP BY 1, 2)""",
        _OBS,
    ),
)
def record_observation(spark, d):
    o = V.table(spark, d, "orders")
    key = F.concat(F.floor(F.col("o_totalprice") / 100000).cast("string"), F.lit("|"), (F.col("o_orderkey") % 2).cast("string"))
    values = o.select(
        F.col("o_custkey").alias("account_id"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("make_dt_interval(0, cast(o_orderkey % 24 as int))")).alias("observed_at"),
        key.alias("source_key"), F.col("o_orderpriority").alias("basis"), F.col("o_totalprice").alias("assets_jpy"),
    )
    return cents(P.record_observation(values).drop("observed_at"))


_PERIODS = {
    **_PF,
    "pc0": "SELECT account_id, day, ticker, CAST(sum(q) AS DOUBLE) AS quantity, CAST(sum(p) AS DOUBLE) / CAST(sum(q) AS DOUBLE) AS cost FROM lots GROUP BY 1, 2, 3",
    "pc": "SELECT * FROM pc0 WHERE (account_id + dayofyear(day)) % 13 <> 0",
    "pdays": """SELECT d.account_id, d.day AS start, coalesce(b.basis, '') AS basis, coalesce(b.n, 0) AS n
                FROM (SELECT DISTINCT account_id, day FROM pc0) d
                LEFT JOIN (SELECT account_id, day, count(*) AS n, string_agg(ticker || ':' || quantity || ':' || cost, ';' ORDER BY ticker) AS basis FROM pc GROUP BY 1, 2) b
                  USING (account_id, day)""",
    "pmoved": "SELECT * FROM (SELECT *, lag(basis) OVER (PARTITION BY account_id ORDER BY start) AS pb FROM pdays) WHERE pb IS NULL OR pb <> basis",
    "periods": """SELECT account_id, start, basis, n, lead(start) OVER (PARTITION BY account_id ORDER BY start) - 1 AS fin FROM pmoved""",
    "cal": f"SELECT *, CAST(close_ts + INTERVAL '9 hours' AS DATE) AS jd FROM sessions",
    "held": f"""SELECT p.account_id, p.start, p.basis, c.session, c.seq, c.jd, x.ticker, x.quantity FROM periods p
                JOIN pc x ON x.account_id = p.account_id AND x.day = p.start
                JOIN cal c ON c.jd >= p.start AND (p.fin IS NULL OR c.jd <= p.fin) AND c.close_ts <= {HISTORY_NOW_SQL}""",
    "hist": """SELECT h.account_id, h.session, h.seq, h.basis, h.start = h.jd AS basis_changed,
                      sum(k.close * h.quantity * CASE WHEN k.currency = 'JPY' THEN 1.0 ELSE f.rate END) AS assets,
                      CASE WHEN bool_or(k.currency <> 'JPY') THEN max(f.rate) END AS rate
               FROM held h LEFT JOIN closes k ON k.ticker = h.ticker AND k.date = h.session LEFT JOIN fx f ON f.date = h.session
               GROUP BY h.account_id, h.session, h.seq, h.basis, h.start, h.jd
               HAVING bool_and(k.close IS NOT NULL AND (k.currency = 'JPY' OR f.rate IS NOT NULL))""",
    "chg0": """SELECT *, lag(seq) OVER w AS ps, lag(basis) OVER w AS pb, lag(assets) OVER w AS pa FROM hist WINDOW w AS (PARTITION BY account_id ORDER BY seq)""",
    "chg": """SELECT *, CASE WHEN ps = seq - 1 AND pb = basis AND NOT basis_changed THEN assets - pa END AS change,
                     CASE WHEN ps = seq - 1 AND pb = basis AND NOT basis_changed AND pa > 0 THEN (assets / pa - 1) * 100 END AS change_rate FROM chg0""",
}


def _periods(spark, d):
    return P.holding_periods(position_changes(spark, d))


def _hist_now():
    return F.to_timestamp(F.lit(HISTORY_NOW))


def _history(spark, d):
    return P.daily_history(_periods(spark, d), closes(spark, d), fx(spark, d), V.sessions(spark, d), _hist_now())


@query("holding_periods", with_views(f"""SELECT account_id, {day('start')}, {day('fin', '"end"')}, n AS positions_n FROM periods""", _PERIODS))
def holding_periods(spark, d):
    return flat(_periods(spark, d).select("account_id", "start", "end", F.size("positions").cast("long").alias("positions_n")))


@query(
    "daily_history",
    with_views(f"SELECT account_id, {day('session')}, {m('assets')} AS assets_jpy, {m('rate')} AS fx_rate, basis_changed FROM hist", _PERIODS),
)
def daily_history(spark, d):
    return cents(_history(spark, d).select("account_id", "session", "assets_jpy", "fx_rate", "basis_changed"))


@query(
    "daily_change",
    with_views(f"SELECT account_id, {day('session')}, {m('change')} AS change, {m('change_rate')} AS change_rate FROM chg", _PERIODS),
)
def daily_change(spark, d):
    out = P.daily_change(_history(spark, d))
    return cents(out.select("account_id", "session", "change", "change_rate"))


@query(
    "day_state",
    with_views(
        f"""SELECT a.account_id, {day('g.date', 'date')},
                   CASE WHEN h.assets IS NOT NULL THEN CASE WHEN h.change IS NOT NULL THEN 'priced' ELSE 'baseline' END
                        WHEN g.date > CAST({HISTORY_NOW_SQL} + INTERVAL '9 hours' AS DATE) OR coalesce(c.close_ts > {HISTORY_NOW_SQL}, FALSE) THEN 'future'
                        WHEN x.miss IS NULL THEN 'unregistered' WHEN c.seq IS NULL THEN 'closed'
                        WHEN x.miss = 0 AND x.needs AND f.rate IS NULL THEN 'missing_fx' ELSE 'missing_price' END AS kind
            FROM (SELECT c_custkey AS account_id FROM customer) a
            CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '2001-03-01', DATE '2001-03-31', INTERVAL '1 day')) AS DATE) AS date) g
            LEFT JOIN cal c ON c.session = g.date LEFT JOIN chg h ON h.account_id = a.account_id AND h.session = g.date LEFT JOIN fx f ON f.date = g.date
            LEFT JOIN (SELECT p.account_id, q.date, count(*) - count(k.close) AS miss, bool_or(coalesce(k.currency <> 'JPY', TRUE)) AS needs
                       FROM (SELECT CAST(unnest(generate_series(DATE '2001-03-01', DATE '2001-03-31', INTERVAL '1 day')) AS DATE) AS date) q
                       LEFT JOIN cal cc ON cc.session = q.date
                       JOIN periods p ON p.start <= coalesce(cc.jd, q.date + 1) AND (p.fin IS NULL OR p.fin >= coalesce(cc.jd, q.date + 1))
                       JOIN pc x ON x.account_id = p.account_id AND x.day = p.start
                       LEFT JOIN closes k ON k.ticker = x.ticker AND k.date = q.date GROUP BY 1, 2) x ON x.account_id = a.account_id AND x.date = g.date""",
        _PERIODS,
    ),
)
def day_state(spark, d):
    accounts = V.table(spark, d, "customer").select(F.col("c_custkey").alias("account_id"))
    dates = spark.sql("SELECT explode(sequence(DATE '2001-03-01', DATE '2001-03-31')) AS date")
    periods = _periods(spark, d)
    shown = P.shown_sessions(V.sessions(spark, d), dates)
    changes = P.daily_change(P.daily_history(periods, closes(spark, d), fx(spark, d), shown, _hist_now()))
    return flat(P.day_state(accounts, dates, changes, periods, V.sessions(spark, d), closes(spark, d), fx(spark, d), _hist_now()))


@query(
    "trend_series",
    with_views(
        f"""SELECT account_id, {day('session')}, {m('assets')} AS assets_jpy,
                   CAST(sum(CASE WHEN rn > 1 AND change IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY account_id ORDER BY seq) AS BIGINT) AS segment
            FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY seq) AS rn
                  FROM (SELECT *, max(session) OVER (PARTITION BY account_id) AS last FROM chg) WHERE session >= last - 366)""",
        _PERIODS,
    ),
)
def trend_series(spark, d):
    out = P.trend_series(P.daily_change(_history(spark, d)), 366)
    return cents(out.select("account_id", "session", "assets_jpy", "segment"))


# ---- ledgers ------------------------------------------------------------------------
@kept
def snapshots(spark, d):
    """Valuations on order days: cumulative order value, some timed, some invalid, some unclassified."""
    from pyspark.sql import Window

    o = V.table(spark, d, "orders")
    day_ = F.to_date("o_orderdate")
    per = o.groupBy(F.col("o_custkey").alias("account_id"), day_.alias("date")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"), F.min("o_orderkey").alias("k")
    )
    w = Window.partitionBy("account_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    k = F.col("k")
    part = lambda f, m: F.when(k % m != 0, F.col("total").cast("double") * f)
    return per.select(
        "account_id", "date", F.when(k % 3 == 0, F.col("date").cast("timestamp") + F.expr("INTERVAL 6 HOURS")).alias("ts"),
        F.sum("total").over(w).cast("double").alias("assets_jpy"), F.when(k % 17 == 0, "invalid").otherwise("recorded").alias("status"),
        part(0.5, 5).alias("price"), part(0.1, 9).alias("fx"), F.lit(0.0).alias("realized"), F.lit(0.0).alias("other"),
    )


@kept
def flows(spark, d):
    o = V.table(spark, d, "orders")
    k = F.col("o_orderkey")
    date = F.date_add(F.to_date("o_orderdate"), (k % 3).cast("int"))
    sign = F.when(F.col("o_orderpriority").startswith("1"), -1).otherwise(1)
    return o.select(
        F.col("o_custkey").alias("account_id"), date.alias("date"),
        F.when(k % 8 == 0, date.cast("timestamp") + F.expr("INTERVAL 3 HOURS")).alias("ts"), (F.col("o_totalprice") * sign).alias("amount_jpy"),
    )


@kept
def dividends(spark, d):
    o = V.table(spark, d, "orders")
    k = F.col("o_orderkey")
    date = F.date_add(F.to_date("o_orderdate"), (k % 7).cast("int"))
    return o.select(
        F.col("o_custkey").alias("account_id"), date.alias("payment_date"),
        F.when(k % 2 == 0, date.cast("timestamp") + F.expr("INTERVAL 2 HOURS")).alias("ts"),
        (F.col("o_totalprice") / 1000).alias("net_amount"), F.when(k % 3 == 0, 150.0).otherwise(1.0).alias("fx"),
        F.when(k % 11 == 0, "planned").otherwise("paid").alias("status"),
    )


def _quality(spark, d):
    c = V.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("account_id"), F.when(F.col("c_custkey") % 11 == 0, "partial").otherwise("complete").alias("flow_status"))


_EOD = "INTERVAL '14 hours 59 minutes 59.999 seconds'"
_LEDGER = {
    "snap0": """SELECT o_custkey AS account_id, CAST(o_orderdate AS DATE) AS date, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total, min(o_orderkey) AS k
                FROM orders GROUP BY 1, 2""",
    "snaps": f"""SELECT account_id, date, CASE WHEN k % 3 = 0 THEN CAST(date AS TIMESTAMP) + INTERVAL '6 hours' END AS ts,
                        CAST(sum(total) OVER (PARTITION BY account_id ORDER BY date) AS DOUBLE) AS assets, k % 17 = 0 AS bad,
                        CASE WHEN k % 5 <> 0 THEN CAST(total AS DOUBLE) * 0.5 END AS cp, CASE WHEN k % 9 <> 0 THEN CAST(total AS DOUBLE) * 0.1 END AS cf FROM snap0""",
    "valid": f"SELECT *, coalesce(ts, CAST(date AS TIMESTAMP) + {_EOD}) AS rt FROM snaps WHERE NOT bad",
    "iv": """SELECT *, lag(rt) OVER w AS lt, lag(date) OVER w AS pdate, lag(assets) OVER w AS passets FROM valid WINDOW w AS (PARTITION BY account_id ORDER BY rt)""",
    "flow0": """SELECT o_orderkey AS k, o_custkey AS account_id, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3 AS INT) AS date,
                       o_totalprice * CASE WHEN o_orderpriority LIKE '1%' THEN -1 ELSE 1 END AS amount FROM orders""",
    "flows": f"""SELECT account_id, amount, CASE WHEN k % 8 = 0 THEN CAST(date AS TIMESTAMP) + INTERVAL '3 hours' ELSE CAST(date AS TIMESTAMP) - INTERVAL '9 hours' END AS lo,
                        CASE WHEN k % 8 = 0 THEN CAST(date AS TIMESTAMP) + INTERVAL '3 hours' ELSE CAST(date AS TIMESTAMP) + {_EOD} END AS hi FROM flow0""",
    "div0": """SELECT o_orderkey AS k, o_custkey AS account_id, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 7 AS INT) AS date,
                      o_totalprice / 1000 * CASE WHEN o_orderkey % 3 = 0 THEN 150.0 ELSE 1.0 END AS amount FROM orders WHERE o_orderkey % 11 <> 0""",
    "divs": f"""SELECT account_id, amount, CASE WHEN k % 2 = 0 THEN CAST(date AS TIMESTAMP) + INTERVAL '2 hours' ELSE CAST(date AS TIMESTAMP) - INTERVAL '9 hours' END AS lo,
                       CASE WHEN k % 2 = 0 THEN CAST(date AS TIMESTAMP) + INTERVAL '2 hours' ELSE CAST(date AS TIMESTAMP) + {_EOD} END AS hi FROM div0""",
    "day_flows": """SELECT i.account_id, i.rt, sum(CASE WHEN f.lo > i.lt AND f.hi <= i.rt THEN f.amount END) AS net,
                           count(CASE WHEN f.lo > i.lt AND f.hi <= i.rt THEN 1 END) AS n, coalesce(bool_or(NOT (f.lo > i.lt AND f.hi <= i.rt)), FALSE) AS amb
                    FROM iv i LEFT JOIN flows f ON f.account_id = i.account_id AND f.hi > i.lt AND f.lo <= i.rt WHERE i.lt IS NOT NULL GROUP BY 1, 2""",
    "day_divs": """SELECT i.account_id, i.rt, CASE WHEN coalesce(bool_or(NOT (f.lo > i.lt AND f.hi <= i.rt)), FALSE) THEN NULL
                                                   ELSE coalesce(sum(f.amount), 0) END AS paid
                   FROM iv i LEFT JOIN divs f ON f.account_id = i.account_id AND f.hi > i.lt AND f.lo <= i.rt WHERE i.lt IS NOT NULL GROUP BY 1, 2""",
    "dayr0": """SELECT i.*, CASE WHEN i.lt IS NOT NULL AND i.account_id % 11 <> 0 AND NOT f.amb THEN coalesce(f.net, 0) END AS netf,
                       CASE WHEN i.account_id % 11 = 0 THEN 0 ELSE f.n END AS n, v.paid FROM iv i LEFT JOIN day_flows f USING (account_id, rt) LEFT JOIN day_divs v USING (account_id, rt)""",
    "dayr": "SELECT *, assets - passets - netf AS pnl, CASE WHEN netf IS NOT NULL AND n = 0 AND passets > 0 THEN (assets - passets - netf) / passets * 100 END AS rate FROM dayr0",
}


@query(
    "interval_flows",
    with_views(
        f"""SELECT account_id, {day('date')}, {m('netf')} AS net_flow, coalesce(n, 0) AS flow_count FROM dayr WHERE lt IS NOT NULL""", _LEDGER
    ),
)
def interval_flows(spark, d):
    iv = A.valuation_intervals(snapshots(spark, d))
    out = iv.select("account_id", "date", "left", "right").join(A.interval_flows(iv, flows(spark, d), _quality(spark, d)), ["account_id", "left", "right"])
    return cents(out.select("account_id", "date", "net_flow", "flow_count"))


@query(
    "event_position",
    with_views(
        """SELECT CASE WHEN f.hi <= i.lt OR f.lo > i.rt THEN 'outside' WHEN f.lo > i.lt AND f.hi <= i.rt THEN 'inside' ELSE 'ambiguous' END AS position, count(*) AS events
           FROM (SELECT account_id, min(rt) AS lt, max(rt) AS rt FROM valid GROUP BY 1) i JOIN flows f USING (account_id) GROUP BY 1""",
        _LEDGER,
    ),
)
def event_position(spark, d):
    """Events against each account's first-to-last valuation span."""
    valid = snapshots(spark, d).where(F.col("status") == "recorded").select("account_id", A.boundary(F.col("date"), F.col("ts")).alias("b"))
    span = valid.groupBy("account_id").agg(F.min("b").alias("left"), F.max("b").alias("right"))
    rows = flows(spark, d).join(span, "account_id")
    pos = A.event_position(F.col("date"), F.col("ts"), F.col("left"), F.col("right"))
    return rows.groupBy(pos.alias("position")).agg(F.count(F.lit(1)).alias("events"))


@query("dividends_paid", with_views(f"SELECT account_id, {day('date')}, {m('paid')} AS dividends_jpy FROM dayr WHERE lt IS NOT NULL", _LEDGER))
def dividends_paid(spark, d):
    iv = A.valuation_intervals(snapshots(spark, d))
    out = iv.select("account_id", "date", "left", "right").join(A.dividends_paid(dividends(spark, d), iv), ["account_id", "left", "right"])
    return cents(out.select("account_id", "date", "dividends_jpy"))


def _days(spark, d):
    return A.day_result(snapshots(spark, d), flows(spark, d), _quality(spark, d), dividends(spark, d))


@query(
    "day_result",
    with_views(
        f"""SELECT account_id, {day('date')}, {day('pdate', 'prev_date')}, {m('netf')} AS net_flow, {m('pnl')} AS pnl, {m('rate')} AS rate,
                   {m('pnl - coalesce(cp, 0) - coalesce(cf, 0) - paid')} AS residual, cp IS NOT NULL AND cf IS NOT NULL AND paid IS NOT NULL AS complete FROM dayr""",
        _LEDGER,
    ),
)
def day_result(spark, d):
    out = _days(spark, d).select("account_id", "date", "prev_date", "net_flow", "pnl", "rate", "residual", "complete")
    return cents(out.select(*[money(c) if c in ("net_flow", "pnl", "residual") else F.col(c) for c in out.columns]))


@query(
    "year_result",
    with_views(
        f"""SELECT account_id, yr AS year, {day('end_date')}, {m('chg')} AS asset_change, {m('netf')} AS net_flow, {m('chg - netf')} AS pnl, netf IS NOT NULL AS complete
            FROM (SELECT y.account_id, y.yr, y.end_date, any_value(CASE WHEN y.lt < y.rt THEN y.ea - y.sa END) AS chg,
                         CASE WHEN any_value(y.lt < y.rt) AND y.account_id % 11 <> 0 AND NOT coalesce(bool_or(NOT (f.lo > y.lt AND f.hi <= y.rt)), FALSE) THEN coalesce(sum(f.amount), 0) END AS netf
                  FROM (SELECT e.account_id, e.yr, e.m.date AS end_date, e.m.rt AS rt, e.m.assets AS ea, s.rt AS lt, s.assets AS sa
                        FROM (SELECT account_id, year(date) AS yr, max({{'rt': rt, 'date': date, 'assets': assets}}) AS m FROM valid GROUP BY 1, 2) e
                        LEFT JOIN (SELECT account_id, min(date) AS bd, year(date) + 1 AS yr FROM valid WHERE month(date) >= 7 GROUP BY 1, 3) b USING (account_id, yr)
                        LEFT JOIN valid s ON s.account_id = e.account_id AND s.date = coalesce(b.bd, make_date(e.yr - 1, 12, 31))) y
                  LEFT JOIN flows f ON f.account_id = y.account_id AND f.hi > y.lt AND f.lo <= y.rt AND y.lt < y.rt
                  GROUP BY y.account_id, y.yr, y.end_date)""",
        _LEDGER,
    ),
)
def year_result(spark, d):
    """Baseline: the first valid valuation of the second half of the year before, where there is one."""
    snaps = snapshots(spark, d)
    base = snaps.where((F.col("status") == "recorded") & (F.month("date") >= 7)).groupBy("account_id", (F.year("date") + 1).alias("year")).agg(
        F.min("date").alias("baseline_date")
    )
    out = A.year_result(snaps, flows(spark, d), _quality(spark, d), base)
    return cents(out.drop("start_date"))


@query(
    "month_result",
    with_views(
        f"""SELECT account_id, {day('mon', 'month')}, days, full_ AS complete, CASE WHEN full_ THEN {m('p')} END AS pnl,
                   CASE WHEN full_ AND rn = days THEN {m('g')} END AS rate
            FROM (SELECT account_id, CAST(date_trunc('month', date) AS DATE) AS mon, count(*) AS days,
                         coalesce(arg_min(coalesce(pdate, DATE '1900-01-01'), date) = CAST(date_trunc('month', min(date)) AS DATE) - 1, FALSE) AND count(pnl) = count(*) AS full_,
                         sum(pnl) AS p, count(rate) AS rn, (exp(sum(ln(1 + rate / 100))) - 1) * 100 AS g FROM dayr GROUP BY 1, 2)""",
        _LEDGER,
    ),
)
def month_result(spark, d):
    out = A.month_result(_days(spark, d))
    return cents(out.select("account_id", "month", "days", "complete", money("pnl"), "rate"))
