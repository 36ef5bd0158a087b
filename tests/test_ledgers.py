"""Research, prediction ledger, portfolio and accounting with known numbers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import accounting as A
from tidemark.operators import ledger as L
from tidemark.operators import portfolio as P
from tidemark.operators import research as PT

T0 = dt.datetime(2026, 1, 5, 12)


def sample_rows(n=25, leak_from=None):
    rows = []
    for i in range(n):
        issued = T0 + dt.timedelta(days=7 * i)
        entry = issued + dt.timedelta(days=1)
        x = (i % 5) * 0.01
        y = 999.0 if leak_from is not None and i >= leak_from else (i % 5) * 0.02 + 0.03
        rows.append((f"s{i}", 5, "T", f"m{i}", issued, issued, entry.date(), entry, entry + dt.timedelta(days=4), entry + dt.timedelta(days=5), x, y, "raw"))
    return rows


SCHEMA = ("id string, horizon int, theme_id string, input_manifest string, issued_at timestamp, known_at timestamp, entry_session date, entry_at timestamp, exit_at timestamp, "
          "outcome_known_at timestamp, feature double, excess_return double, basis string")


def test_ols_and_walk_forward(spark):
    df = spark.createDataFrame(sample_rows(), SCHEMA)
    fit = PT.fit_ols(df, ["horizon"]).first()
    assert fit["slope"] == pytest.approx(2) and fit["intercept"] + fit["slope"] * 0.01 == pytest.approx(0.05)
    out = PT.walk_forward(df, ["horizon"], 10).orderBy("issued_at").collect()
    assert len(out) == 15 and all(abs(r["residual"]) < 1e-9 for r in out)
    model, _ = PT.fit_model(df, ["horizon"], F.lit(dt.datetime(2027, 1, 1)).cast("timestamp"), 10, 5)
    m = model.first()
    assert m["status"] == "research_ready" and m["improves_mean_baseline"]


def test_future_labels_do_not_leak(spark):
    base = PT.walk_forward(spark.createDataFrame(sample_rows(), SCHEMA), ["horizon"], 10).orderBy("issued_at").collect()
    changed = PT.walk_forward(spark.createDataFrame(sample_rows(leak_from=10), SCHEMA), ["horizon"], 10).orderBy("issued_at").collect()
    assert base[0]["prediction"] == pytest.approx(changed[0]["prediction"]) and base[0]["train_n"] == changed[0]["train_n"]
    assert abs(base[-1]["prediction"] - changed[-1]["prediction"]) > 1


def test_constant_feature_predicts_the_mean(spark):
    df = spark.createDataFrame([(5, 0.01, 1.0), (5, 0.01, 3.0)], "horizon int, feature double, excess_return double")
    assert tuple(PT.fit_ols(df, ["horizon"]).select("slope", "intercept").first()) == (0.0, 2.0)


def price_frame(spark, drop=None, quality="verified"):
    ends = {"A": 120.0, "B": 90.0, "SPY": 102.0}
    rows = []
    for t, end in ends.items():
        for s in range(5):
            close = 100 + (end - 100) * s / 4
            if (t, s + 1) != drop:
                at = T0 + dt.timedelta(days=s)
                rows.append((t, s + 1, 100.0, close, at + dt.timedelta(hours=9), at + dt.timedelta(hours=8), quality, True))
    return spark.createDataFrame(rows, "ticker string, seq int, open double, close double, available_at timestamp, close_ts timestamp, quality string, tradable_open boolean")


def prediction(spark):
    rows = [("p1", 1, 5, [("A", 0.5), ("B", 0.5)], "SPY", 0.01, 0.002, 0.001)]
    return spark.createDataFrame(rows, "prediction_id string, entry_seq int, exit_seq int, members array<struct<ticker:string,weight:double>>, benchmark string, expected double, theme_cost double, benchmark_cost double")


def test_scored_outcome_numbers(spark):
    at = F.lit(dt.datetime(2026, 3, 1)).cast("timestamp")
    r = L.score_outcomes(prediction(spark), price_frame(spark), at).first()
    assert r["outcome_status"] == "scored"
    for name, want in {"theme_return": 0.05, "benchmark_return": 0.02, "excess_return": 0.03, "cost_adjusted_return": 0.048, "cost_adjusted_excess": 0.029, "max_favorable": 0.05, "max_adverse": 0.0}.items():
        assert r[name] == pytest.approx(want), name


@pytest.mark.parametrize("frame", [{"drop": ("B", 3)}, {"quality": "pending"}])
def test_bad_evidence_is_unresolved(spark, frame):
    at = F.lit(dt.datetime(2026, 3, 1)).cast("timestamp")
    r = L.score_outcomes(prediction(spark), price_frame(spark, **frame), at).first()
    assert r["outcome_status"] == "unresolved" and r["excess_return"] is None and r["reason"].startswith("missing session")
    early = F.lit(T0).cast("timestamp")
    assert L.score_outcomes(prediction(spark), price_frame(spark), early).first()["outcome_status"] == "unresolved"


def test_records_and_versions(spark):
    old = spark.createDataFrame([("k", "1", "b1", "h1")], "kind string, id string, body string, hash string")
    new = spark.createDataFrame([("k", "1", "b1", "h1"), ("k", "2", "b2", "h2"), ("k", "3", "x", "h3"), ("k", "3", "y", "h4")], old.schema)
    insert, conflicts = L.append_records(old, new)
    assert [r["id"] for r in insert.collect()] == ["2"] and [r["id"] for r in conflicts.collect()] == ["3"]
    _, conflicts = L.append_records(old, spark.createDataFrame([("k", "1", "z", "hz")], old.schema))
    assert conflicts.count() == 1


def test_usage_keeps_a_b_a(spark):
    rows = [(1, "u", T0, "A"), (2, "u", T0 + dt.timedelta(minutes=1), "B"), (3, "u", T0 + dt.timedelta(minutes=2), "A"), (4, "u", T0 + dt.timedelta(minutes=3), "A"), (5, "u", T0 + dt.timedelta(days=1), "A")]
    df = spark.createDataFrame(rows, "event_id int, user_id string, ts timestamp, fingerprint string")
    out = L.usage_changes(df).orderBy("event_id").collect()
    assert [r["event_id"] for r in out] == [1, 2, 3, 5]
    assert [r["previous_record_id"] for r in out] == [None] + [r["record_id"] for r in out[:-1]]


SNAP = "account_id int, date date, ts timestamp, assets_jpy double, status string, price double, fx double, realized double, other double"
FLOW = "account_id int, date date, ts timestamp, amount_jpy double"
DIV = "account_id int, payment_date date, ts timestamp, net_amount double, fx double, status string"


def day_results(spark, snaps, flows, status="complete"):
    q = spark.createDataFrame([(1, status)], "account_id int, flow_status string")
    s = spark.createDataFrame([(1, d, ts, a, "recorded", None, None, None, None) for d, ts, a in snaps], SNAP)
    return A.day_result(s, spark.createDataFrame([(1, *f) for f in flows], FLOW), q, spark.createDataFrame([], DIV)).orderBy("date").collect()


FRI, SUN, MON = dt.date(2026, 9, 4), dt.date(2026, 9, 6), dt.date(2026, 9, 7)


def test_flow_adjusted_results(spark):
    r = day_results(spark, [(FRI, None, 10e6), (MON, None, 11e6)], [])[-1]
    assert r["pnl"] == 1e6 and r["rate"] == pytest.approx(10)
    r = day_results(spark, [(FRI, None, 10e6), (MON, None, 11e6)], [(SUN, None, 5e5)])[-1]
    assert r["pnl"] == 5e5 and r["rate"] is None
    r = day_results(spark, [(FRI, None, 10e6), (MON, None, 11e6)], [(SUN, None, 5e5), (SUN, None, -5e5)])[-1]
    assert r["pnl"] == 1e6 and r["rate"] is None and r["flow_count"] == 2
    noon = dt.datetime(2026, 9, 7, 3)
    r = day_results(spark, [(FRI, None, 10e6), (MON, noon, 11e6)], [(MON, None, 5e5)])[-1]
    assert r["pnl"] is None
    r = day_results(spark, [(FRI, None, 10e6), (MON, None, 11e6)], [], status="incomplete")[-1]
    assert r["pnl"] is None


def test_holding_costs(spark):
    rows = [(1, "MU", "a", "USD", 2.0, 10.0), (1, "MU", "b", "USD", 1.0, 40.0), (1, "X", "a", "USD", 1.0, 1.0), (1, "X", "a", "JPY", 1.0, 100.0)]
    out = {r["ticker"]: r for r in P.aggregate_holdings(spark.createDataFrame(rows, "account_id int, ticker string, broker string, currency string, quantity double, cost double")).collect()}
    assert out["MU"]["quantity"] == 3 and out["MU"]["cost"] == 20 and out["X"]["cost"] is None and out["X"]["currencies"] == 2


def test_history_needs_every_price_and_keeps_verified_rows(spark):
    days = [dt.date(2026, 9, d) for d in (1, 2, 3, 4)]
    sessions = spark.createDataFrame([(d, i + 1, dt.datetime(d.year, d.month, d.day, 13), dt.datetime(d.year, d.month, d.day, 20)) for i, d in enumerate(days)], "session date, seq int, open_ts timestamp, close_ts timestamp")
    pos = "array<struct<ticker:string,quantity:double,cost:double,currency:string>>"
    changes = spark.createDataFrame(
        [(1, dt.datetime(2026, 8, 30), [("MU", 2.0, 1.0, "USD")]), (1, dt.datetime(2026, 9, 3, 18), []), (1, dt.datetime(2026, 9, 4, 18), [("MU", 2.0, 1.0, "USD")])],
        f"account_id int, changed_at timestamp, positions {pos}",
    )
    periods = P.holding_periods(changes)
    assert [(r["start"].day, r["end"] and r["end"].day) for r in periods.orderBy("start").collect()] == [(30, 3), (4, 4), (5, None)]
    closes = spark.createDataFrame([("MU", d, 100.0 + i, "USD") for i, d in enumerate(days) if i != 1], "ticker string, date date, close double, currency string")
    fx = spark.createDataFrame([(d, 150.0) for d in days], "date date, rate double")
    now = F.lit(dt.datetime(2026, 9, 10)).cast("timestamp")
    out = P.daily_history(periods, closes, fx, sessions, now)
    # Session 2 lacks a close, session 3 falls on the empty portfolio (recorded on the 4th in Japan).
    assert [(r["seq"], r["assets_jpy"]) for r in out.orderBy("seq").collect()] == [(1, 30000.0), (4, 30900.0)]
    full = P.daily_history(periods, closes.unionByName(spark.createDataFrame([("MU", days[1], 101.0, "USD")], closes.schema)), fx, sessions, now)
    kept = P.daily_history(periods, closes, fx, sessions, now, previous=full)
    assert [r["seq"] for r in kept.orderBy("seq").collect()] == [1, 2, 4]
    change = P.daily_change(full).orderBy("seq").collect()
    assert change[1]["change"] == 300.0 and change[2]["change"] is None


def test_observations_of_one_moment_are_ordered_by_basis_and_assets(spark):
    at = dt.datetime(2026, 3, 2, 1)
    tied = [(basis, assets) for basis in ("c", "a", "b") for assets in (3.0, 1.0, 2.0)]
    rows = [(k, at, "key", *tied[(j + k) % 9]) for k in range(9) for j in range(9)]
    df = spark.createDataFrame(rows, "account_id int, observed_at timestamp, source_key string, basis string, assets_jpy double")
    got = {(r["basis"], r["assets_jpy"], r["basis_changed"]) for r in P.record_observation(df.repartition(3)).collect()}
    assert got == {("a", 1.0, False)}


POSITIONS = "array<struct<ticker:string,quantity:double,cost:double,currency:string>>"


def owned(spark, parts=3):
    """Random portfolios, several changes a day, dealt by account; closes with gaps; sessions of which some are open."""
    rng = random.Random(5)
    books = [[], [("MU", 2.0, 1.0, "USD")], [("MU", 2.0, 1.0, "USD"), ("X", 3.0, 2.0, "USD")]]
    rows = [(a, dt.datetime(2026, 9, rng.randint(1, 20), rng.randint(0, 23), k), rng.choice(books)) for a in range(8) for k in range(9)]
    changes = spark.createDataFrame(rows, f"account_id int, changed_at timestamp, positions {POSITIONS}").repartition(parts, "account_id")
    days = [d for d in (dt.date(2026, 9, 1) + dt.timedelta(k) for k in range(24)) if d.weekday() < 5]
    sessions = spark.createDataFrame([(d, i + 1, dt.datetime(d.year, d.month, d.day, 20)) for i, d in enumerate(days)], "session date, seq int, close_ts timestamp")
    quotes = [(t, d, 100.0 + i, c) for i, d in enumerate(days) for t, c in (("MU", "USD"), ("X", "JPY")) if (i + len(t)) % 7]
    closes = spark.createDataFrame(quotes, "ticker string, date date, close double, currency string")
    fx = spark.createDataFrame([(d, 150.0 + i) for i, d in enumerate(days) if i % 6], "date date, rate double")
    return rows, changes, days, sessions, closes, fx


def plain_periods(rows):
    """Changed states in time order, the last of each Japan day."""
    out = {}
    for a in range(8):
        state, starts = None, {}
        for _, at, book in sorted((r for r in rows if r[0] == a), key=lambda r: r[1]):
            if book != state:
                starts[(at + dt.timedelta(hours=9)).date()] = book
            state = book
        days = sorted(starts)
        for d, after in zip(days, [*days[1:], None]):
            out[a, d] = (after and after - dt.timedelta(1), sorted(p[0] for p in starts[d]))
    return out


def test_periods_of_changes_dealt_by_account_are_not_shuffled(spark):
    rows, changes, *_ = owned(spark)
    out = P.holding_periods(changes)
    got = {(r["account_id"], r["start"]): (r["end"], sorted(p["ticker"] for p in r["positions"])) for r in out.collect()}
    assert got == plain_periods(rows)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange") == 1 and "SortMergeJoin" not in plan


@pytest.mark.parametrize("most", [1000, 0])
def test_history_values_positions_where_their_account_lies(spark, most):
    rows, changes, days, sessions, closes, fx = owned(spark)
    now = dt.datetime(2026, 9, 22)
    out = P.daily_history(P.holding_periods(changes), closes, fx, sessions, F.lit(now).cast("timestamp"), most=most)
    got = {(r["account_id"], r["session"]): (r["assets_jpy"], r["fx_rate"]) for r in out.collect()}
    price = {(r["ticker"], r["date"]): r["close"] for r in closes.collect()}
    rate = {r["date"]: r["rate"] for r in fx.collect()}
    want = {}
    for (a, start), (end, held) in plain_periods(rows).items():
        for d in days:
            on = d + dt.timedelta(1)  # 20:00Z is the next day in Japan
            if held and d < now.date() and start <= on and (end is None or on <= end) and all((t, d) in price for t in held) and ("MU" not in held or d in rate):
                want[a, d] = (sum(price[t, d] * (2 * rate[d] if t == "MU" else 3) for t in held), rate[d] if "MU" in held else None)
    assert got == want and want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert any("SortMergeJoin" in x and "ticker" in x for x in plan.splitlines()) == (most == 0)


@pytest.mark.parametrize("month", [(8, 28, 40), (9, 10, 9), (9, 19, 12), (10, 1, 5)])
def test_month_view_from_the_shown_sessions_equals_the_one_from_all(spark, month):
    rows, changes, days, sessions, closes, fx = owned(spark)
    now = F.lit(dt.datetime(2026, 9, 22)).cast("timestamp")
    dates = spark.createDataFrame([(dt.date(2026, *month[:2]) + dt.timedelta(k),) for k in range(month[2])], "date date")
    accounts = spark.createDataFrame([(a,) for a in range(10)], "account_id int")
    periods = P.holding_periods(changes)

    def view(calendar):
        shown = P.daily_change(P.daily_history(periods, closes, fx, calendar, now))
        out = P.day_state(accounts, dates, shown, periods, sessions, closes, fx, now).collect()
        return {(r["account_id"], r["date"]): r["kind"] for r in out}

    got = view(P.shown_sessions(sessions, dates))
    assert got == view(sessions) and len(got) == 10 * month[2]
    want = plain_periods(rows)
    for (a, d), kind in got.items():
        on = d + dt.timedelta(1)
        owns = any(x == a and s <= on and (e is None or on <= e) and held for (x, s), (e, held) in want.items())
        assert kind == "future" if d > dt.date(2026, 9, 22) else (kind in ("unregistered", "future")) or owns
