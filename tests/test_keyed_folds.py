"""Keyed folds and the bucketed quote table over several micro-batches."""

import datetime as dt
import os
import random
import time
import uuid

import pytest

from tidemark.streaming import folds as FD
from tidemark.streaming import quotes as QT
from tidemark.streaming.late import ROCKSDB

DAY = dt.date(2026, 1, 1)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    yield spark
    spark.conf.set(name, old)


def run(spark, parts, schema, form, tmp, wait=0.0):
    """The form's rows over one batch a part."""
    folder = f"{tmp}/{uuid.uuid4().hex}"

    def land(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def drain():
        out = form(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
        q = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
        q.awaitTermination()
        return out.schema

    for p in parts:
        land(p)
        if wait:
            drain()
            time.sleep(wait)
    return sorted((tuple(r) for r in spark.read.schema(drain()).parquet(f"{folder}/out").collect()), key=repr)


VELOCITY = "theme_id string, as_of date, raw_state string"


def test_velocity_in_four_batches_equals_one(rocks, tmp_path):
    rng = random.Random(9)
    rows = [(t, DAY + dt.timedelta(days=i), rng.choice(["L", "L", "L", "I", None])) for i in range(40) for t in ("T1", "T2")]
    parts = [rows[k : k + 20] for k in range(0, 80, 20)]
    for p in parts:
        rng.shuffle(p)
    one = run(rocks, [rows], VELOCITY, FD.stream_velocity, tmp_path)
    assert run(rocks, parts, VELOCITY, FD.stream_velocity, tmp_path) == one
    assert len(one) == 80 and not any(r[-1] for r in one) and {r[3] for r in one} == {"L", "I", None}


def test_a_row_behind_the_place_reached_is_flagged_and_changes_nothing(rocks, tmp_path):
    day = lambda i, s: ("T", DAY + dt.timedelta(days=i), s)
    parts = [[day(0, "L"), day(3, "L")], [day(1, "I"), day(3, "I")], [day(4, "L"), (None, DAY, "L"), ("T", None, "L")]]
    got = {(r[1], r[2]): r[3:] for r in run(rocks, parts, VELOCITY, FD.stream_velocity, tmp_path)}
    assert got[(DAY + dt.timedelta(days=1), None)] == got[(DAY + dt.timedelta(days=3), None)] == (None, None, None, None, True)
    assert got[(DAY + dt.timedelta(days=4), "L")] == ("L", "L", 0, True, False) and len(got) == 5


def test_state_expires(rocks, tmp_path):
    rocks.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        _expiry(rocks, tmp_path)
    finally:
        rocks.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def _expiry(rocks, tmp_path):
    parts = [[("T", DAY, "L")], [("T", DAY + dt.timedelta(days=1), "L")]]
    kept = run(rocks, parts, VELOCITY, lambda s: FD.stream_velocity(s, ttl_ms=3_600_000), tmp_path, wait=0.1)
    gone = run(rocks, parts, VELOCITY, lambda s: FD.stream_velocity(s, ttl_ms=1), tmp_path, wait=0.1)
    assert [r[-2] for r in kept] == [False, True] and [r[-2] for r in gone] == [False, False]


def test_regime_batches_and_missing_scores(rocks, tmp_path):
    rng = random.Random(3)
    rows = [("M", DAY + dt.timedelta(days=i), [95.0, 70.0, 50.0, None, 20.0, 3.0][i // 4 % 6] if i % 11 else float("nan"), rng.choice([True, False, False, None])) for i in range(60)]
    schema = "market_id string, session date, trend double, stress_hit boolean"
    one = run(rocks, [rows], schema, FD.stream_regime, tmp_path)
    assert run(rocks, [rows[:7], rows[7:30], rows[30:]], schema, FD.stream_regime, tmp_path) == one and len(one) == 60
    assert len({r[2] for r in one}) > 2


def test_usage_changes_against_a_plain_pass(rocks, tmp_path):
    rng = random.Random(4)
    start = dt.datetime(2026, 1, 1, 12)
    rows = [(i, rng.randint(1, 3), start + dt.timedelta(hours=i // 2), rng.choice(["a", "b", None])) for i in range(90)]
    want, last = [], {}
    for i, u, ts, fp in rows:
        now = (fp, (ts + dt.timedelta(hours=9)).date())
        if last.get(u, (None, None)) != now:
            want.append(i)
        last[u] = now
    schema = "event_id long, user_id long, ts timestamp, fingerprint string"
    for size in (90, 30):
        got = run(rocks, [rows[k : k + size] for k in range(0, 90, size)], schema, FD.stream_usage_changes, tmp_path)
        assert sorted(r[0] for r in got) == want and not any(r[-1] for r in got)


QUOTES = "ticker string, as_of date, price double, quote_id long"


def files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_a_batch_rewrites_only_its_buckets_and_never_goes_back(spark, tmp_path):
    path = f"{tmp_path}/quotes"
    write = QT.latest_quotes_writer(path, buckets=16)
    batch = lambda *rows: spark.createDataFrame([(t, DAY + dt.timedelta(days=d), p, q) for t, d, p, q in rows], QUOTES)
    assert QT.latest_quotes(spark, path).count() == 0
    write(batch(*[(f"k{i}", 5, float(i), i) for i in range(100)]), 0)
    before = files(f"{path}/rows")
    assert len(before) == 16
    write(batch(("k7", 4, 70.0, 900), ("k8", 6, 80.0, 901), (None, 6, 1.0, 902)), 1)
    new = files(f"{path}/rows") - before
    assert 1 <= len(new) <= 2 and before <= files(f"{path}/rows")
    rows = {r.ticker: r.price for r in QT.latest_quotes(spark, path).collect()}
    assert len(rows) == 100 and rows["k7"] == 7.0 and rows["k8"] == 80.0

    write(batch(("k8", 7, 81.0, 903)), 2)
    write(batch(("k8", 7, 82.0, 904)), 2)  # the same batch again, with what it brought now
    assert {r.ticker: r.price for r in QT.latest_quotes(spark, path).collect()}["k8"] == 82.0
    for k in range(3, 7):
        write(batch(("k8", 5 + k, float(k), 1000 + k)), k)
    got = {r.ticker: r.price for r in QT.latest_quotes(spark, path).collect()}
    assert got["k8"] == 6.0 and len(got) == 100 and len(files(f"{path}/rows")) <= 32 and len(files(f"{path}/manifest")) == 2
    write(batch(), 7)
    assert QT.latest_quotes(spark, path).count() == 100


def test_a_generation_that_was_not_named_is_not_seen(spark, tmp_path):
    path = f"{tmp_path}/quotes"
    write = QT.latest_quotes_writer(path, buckets=4)
    write(spark.createDataFrame([("a", DAY, 1.0, 1)], QUOTES), 0)
    # rows of the next generation written, its manifest lost
    b = next(iter(QT.manifest(spark, path)))
    spark.createDataFrame([("a", DAY, 9.0, 9)], QUOTES).write.parquet(f"{path}/rows/bucket={b}/slot=1")
    assert QT.latest_quotes(spark, path).first()["price"] == 1.0
    write(spark.createDataFrame([("a", DAY, 2.0, 2)], QUOTES), 1)
    assert QT.latest_quotes(spark, path).first()["price"] == 2.0
