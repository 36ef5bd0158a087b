"""Functions, keyed helpers, series and display metrics on hand-made frames."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions import scoring as SC
from tidemark.functions import text as TX
from tidemark.functions import validity as VA
from tidemark.operators import display as D
from tidemark.operators import keyed as KD
from tidemark.operators import regime as R
from tidemark.operators import setups as ST
from tidemark.operators import themes as T


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_scores_and_labels(spark):
    a = C.STRENGTH["risk_adjusted"]
    got = one(
        spark, SC.piecewise_score(F.lit(-9.0), a), SC.piecewise_score(F.lit(0.25), a), SC.piecewise_score(F.lit(9.0), a),
        SC.piecewise_score(F.lit(float("nan")), a), SC.band_label(F.lit(60.0), C.STRENGTH["labels"]), SC.band_label(F.lit(-1.0), C.STRENGTH["labels"]),
        SC.vix_level(F.lit(19.9), F.lit(True)), SC.vix_level(F.lit(19.9), F.lit(False)),
    )
    assert tuple(got) == (0.0, 62.5, 100.0, None, "Bull", "Weak", "moderate", "unconfirmed")


def test_parsing_and_text(spark):
    lit = F.lit
    got = one(
        spark, VA.parse_date(lit("2026-09-08")), VA.parse_date(lit("2026-13-08")), VA.parse_utc(lit("2026-09-08T00:00:00+09:00")),
        TX.canonical_url(lit("HTTPS://A.example.com/x/?utm_source=1&a=&b=2&ref=z#top")), TX.article_key(lit("https://A.example.com/x/?ref=z")),
        TX.canonical_url(lit("http://a.example.com/x")), TX.canonical_url(lit("https://u:p@a.example.com/x")),
        TX.title_key(lit("Ｍｕ Ｑ１!"), normalize=True), TX.search_key(lit("まいくろん ・-x")), TX.exposure(lit("NVDL")), TX.exposure(lit("MU")),
        TX.strip_html(lit("<p>a &amp;  <b>b</b></p>")),
    )
    assert tuple(got) == (
        dt.date(2026, 9, 8), None, None, "https://a.example.com/x?b=2&ref=z", "https://a.example.com/x", None, None, "muq1", "マイクロンX", "NVDA", "MU", "a & b",
    )


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds most rows; ties in time; several buckets."""
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(3)}", dt.datetime(2024, rng.randrange(1, 4), rng.randrange(1, 28), rng.randrange(24)), i, rng.randrange(50)) for i in range(400)]
    return rows, spark.createDataFrame(rows, "k string, ts timestamp, id int, v int").withColumn("b", F.trunc("ts", "month")).repartition(7)


def test_split_lag_equals_plain_lag(hot):
    rows, df = hot
    got = {r["id"]: r["p"] for r in KD.split_lag(df, ["k"], "b", ["ts", "id"], {"p": "v"}).collect()}
    want, last = {}, {}
    for k, ts, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        want[i] = last.get(k)
        last[k] = v
    assert got == want


def test_running_folds(hot):
    rows, df = hot
    folds = {"s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v")}
    got = {r["id"]: (r["s"], r["lo"], r["hi"]) for r in KD.running(df, ["k"], "b", ["ts", "id"], folds).collect()}
    want, acc = {}, {}
    for k, ts, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        acc.setdefault(k, []).append(v)
        want[i] = (sum(acc[k]), min(acc[k]), max(acc[k]))
    assert got == want


@pytest.mark.parametrize("strict", [True, False])
def test_asof_join(hot, strict):
    rows, df = hot
    left, right = df.where("id % 2 = 0").select("k", "ts", "id"), df.where("id % 2 = 1").select("k", F.col("ts").alias("t2"), F.col("v").alias("w"))
    got = {r["id"]: r["w"] for r in KD.asof_join(left, right, ["k"], "ts", "t2", ["w"], strict=strict).collect()}
    for k, ts, i, _ in rows:
        if i % 2 == 0:
            prior = [(t, v) for kk, t, j, v in rows if kk == k and j % 2 == 1 and (t < ts or (not strict and t == ts))]
            assert got[i] == (max(prior)[1] if prior else None)


def test_order_statistics(hot):
    rows, df = hot
    got = {r["k"]: (r["a"], r["z"]) for r in KD.order_statistics(df, ["k"], "v", {"a": 0.1, "z": 0.9}, bins=8).collect()}
    for k in {r[0] for r in rows}:
        s = sorted(r[3] for r in rows if r[0] == k)
        assert got[k] == (s[int((len(s) - 1) * 0.1)], s[int((len(s) - 1) * 0.9)])


def fold_velocity(raws, confirm=5, state=None, candidate=None, days=0):
    out = []
    for raw in raws:
        if raw is None:
            state, candidate, days, sure = None, None, 0, False
        elif state is None:
            state, candidate, days, sure = raw, raw, 1, False
        elif raw == state:
            candidate, days, sure = raw, 0, True
        else:
            days = days + 1 if candidate == raw else 1
            candidate, sure = raw, days >= confirm
            if sure:
                state, days = raw, 0
        out.append((state, candidate, days, sure))
    return out


@pytest.mark.parametrize("prior", [None, ("L", "I", 3), ("L", "L", 0)])
def test_velocity_confirmation_equals_a_fold(spark, prior):
    rng = random.Random(1)
    series = {}
    for t in range(12):
        raws = []
        while len(raws) < 70:
            raws += [rng.choice(["L", "I", "W", None] if t % 3 == 0 else ["L", "I", "W"])] * rng.randrange(1, 8)
        series[f"T{t}"] = raws
    start = dt.date(2024, 1, 1)
    rows = [(t, start + dt.timedelta(days=i), r) for t, rs in series.items() for i, r in enumerate(rs)]
    df = spark.createDataFrame(rows, "theme_id string, as_of date, raw_state string")
    held = None if prior is None else spark.createDataFrame([(t, *prior) for t in series], "theme_id string, state string, candidate string, candidate_days int")
    got = {(r["theme_id"], r["as_of"]): (r["state"], r["candidate"], r["candidate_days"], r["confirmed"]) for r in T.velocity_confirmed(df, prior=held).collect()}
    for t, rs in series.items():
        for i, want in enumerate(fold_velocity(rs, 5, *(prior or ()))):
            assert got[(t, start + dt.timedelta(days=i))] == want, (t, i)


def weekday_bars(spark, closes, volumes=None, skip=()):
    days, day = [], dt.date(2026, 1, 5)
    while len(days) < len(closes):
        if day.weekday() < 5:
            days.append(day)
        day += dt.timedelta(days=1)
    rows = [("A", d, i + 1, float(c), float((volumes or [100] * len(closes))[i])) for i, (d, c) in enumerate(zip(days, closes)) if i not in skip]
    return spark.createDataFrame(rows, "ticker string, session date, seq int, close double, volume double"), days


def test_display_metrics(spark):
    closes = list(range(100, 170))
    grid, days = weekday_bars(spark, closes, [100] * 69 + [200])
    row = D.relative_volume(D.session_returns(grid)).where(F.col("session") == days[-1]).first()
    for n in (1, 5, 21, 63):
        assert row[f"return_{n}d"] == pytest.approx(169 / (169 - n) - 1)
    assert row["rvol"] == 2
    grid, days = weekday_bars(spark, closes, [100] * 69 + [200], skip={67})
    row = D.relative_volume(D.session_returns(grid)).where(F.col("session") == days[-1]).first()
    assert row["return_1d"] is not None and row["return_5d"] is None and row["rvol"] is None


@pytest.mark.parametrize("n", [1, 2, 14, 20, 21, 49, 50, 64])
def test_stock_setups(spark, n):
    grid, days = weekday_bars(spark, range(100, 100 + n))
    row = ST.stock_setups(grid).where(F.col("session") == days[-1]).first()
    assert row["price"] == 99 + n and row["history_sessions"] == n and row["analysis_ready"] == (n >= 50)
    if n == 64:
        assert row["prior_high20"] == 162 and row["breakout"] and row["rvol"] == 1 and row["rsi14"] == 100
    grid, days = weekday_bars(spark, range(100, 100 + n), skip={n // 2} if n > 2 else set())
    if n > 2:
        assert ST.stock_setups(grid).where(F.col("session") == days[-1]).first() is None


def test_regime_states_walk_the_rungs(spark):
    t = [50, 80, 80, 79, 69, 67, 60, 53, 51, 40, 38, 37, 30, 22, 21, 33, 47, 49, None, 62, 63]
    want = ["Neutral", "Neutral", "Strong Bull", "Strong Bull", "Strong Bull", "Bull", "Bull", "Bull", "Neutral", "Neutral", "Neutral", "Bear", "Bear", "Bear",
            "Strong Bear", "Bear", "Bear", "Neutral", "Neutral", "Neutral", "Bull"]
    rows = [("US", dt.date(2026, 1, 1) + dt.timedelta(days=i), None if x is None else float(x)) for i, x in enumerate(t)]
    out = R.regime_state(spark.createDataFrame(rows, "market_id string, session date, trend double")).orderBy("session").collect()
    assert [r["state"] for r in out] == want
    assert [r["state_days"] for r in out][:5] == [1, 2, 1, 2, 3]


def test_relative_strength_is_a_ratio(spark):
    got = one(spark, R.relative_strength(F.lit(-0.267206), F.lit(-0.137666)))[0]
    assert got == pytest.approx(-0.15022, abs=1e-5)


def test_published_regime_day(spark):
    """One published day: factor values in, trend, instability, stress and confidence out."""
    row = spark.createDataFrame(
        [("US", dt.date(2026, 11, 20), -0.107943, -0.137666, 0.042236, 0.035829, 0.0, -0.016601, 0.0, 35.89, 0.398042, 0.161464, -0.07, "Neutral")],
        "market_id string, session date, growth_vs200 double, growth_ret63 double, growth_ma50_200 double, equal_ret63 double, broad_ret63 double, highyield_ret63 double, "
        "grade_ret63 double, vix double, growth_volatility double, growth_drawdown double, growth_ret5 double, state string",
    )
    out = R.confidence(R.stress(R.instability_score(R.trend_score(row)))).withColumn("final", R.worse(F.col("state"))).first()
    assert out["trend"] == pytest.approx(33.04, abs=5e-3) and out["instability"] == pytest.approx(96.43, abs=5e-3)
    assert out["stress_active"] and out["final"] == "Bear" and out["confidence"] == "Low" and out["instability_label"] == "Stress"


def test_versions_in_force_by_interval_index(spark):
    import datetime as dt
    import random

    from tidemark.operators import dims as DM

    r = random.Random(9)
    start = dt.date(2020, 1, 1)
    day = lambda n: start + dt.timedelta(days=n)
    noon = lambda n: dt.datetime.combine(day(n), dt.time(12))
    defs = [(f"t{k % 3}", k, day(a := r.randint(0, 400)), r.choice([None, day(a + r.randint(0, 200))]), noon(a + r.randint(-30, 90))) for k in range(120)]
    defs += [("t0", 900, None, None, noon(0)), ("t0", 901, day(0), None, None), (None, 902, day(0), None, noon(0))]
    asked = [(f"t{k % 4}", k, noon(r.randint(-50, 600))) for k in range(200)] + [("t0", 900, None), (None, 901, noon(5))]
    out = DM.effective_at_exclusive(
        spark.createDataFrame(defs, "theme_id string, v int, valid_from date, valid_to date, known_at timestamp"),
        spark.createDataFrame(asked, "theme_id string, q int, issued_at timestamp"),
    )
    want = sorted(
        (q, v) for t, q, at in asked for u, v, a, b, known in defs
        if None not in (t, at, a, known) and t == u and a <= at.date() and (b is None or at.date() < b) and known <= at
    )
    assert sorted((x["q"], x["v"]) for x in out.collect()) == want and want
    assert out.columns == ["theme_id", "q", "issued_at", "v", "valid_from", "valid_to", "known_at"]


def test_bars_of_lines_are_added_up_without_a_sort_of_lines(spark, tmp_path):
    from tidemark.plans import views as V

    day = dt.datetime(2001, 3, 6)
    lines = [(o, p, n, day + dt.timedelta(days=d), float(1 + (o + n) % 4), 10.0 * o + n + p) for o in (30, 4, 200) for n in (2, 1, 11) for p in (1, 2) for d in (1, 0, 8)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_shipdate timestamp, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "A"), (2, "B")], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    out = V.all_bars.__wrapped__.__wrapped__(spark, str(tmp_path))
    want = {}
    for name in ("A", "B", "MKT"):
        for week in (dt.date(2001, 3, 5), dt.date(2001, 3, 12)):
            own = sorted((t, o, n, q, x) for o, p, n, t, q, x in lines if name in ("AB"[p - 1], "MKT") and week <= t.date() < week + dt.timedelta(days=7))
            first = {x / q for *key, q, x in own if key == list(own[0][:3])}
            want[name, week] = (sum(r[4] for r in own) / sum(r[3] for r in own), sum(r[3] for r in own), first)
    got = {(r["ticker"], r["session"]): r for r in out.collect()}
    assert set(got) == set(want)
    for k, (close, volume, first) in want.items():
        assert (got[k]["close"], got[k]["volume"]) == (close, volume) and got[k]["open"] in first
    # Lines meet hash aggregates only; a struct's minimum would have sorted them all.
    assert out._jdf.queryExecution().executedPlan().toString().count("HashAggregate") >= 2
