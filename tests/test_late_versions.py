"""Late data against a plain fold, over several micro-batches."""

import random
import uuid

import pytest

from tidemark.streaming import late as L

SCHEMA = "k string, v string, at timestamp, seq long"


def plain(rows, delay):
    """Versions in judging order for each key."""
    out, state = [], {}
    for k, v, at, seq in sorted(rows, key=lambda r: r[3]):
        s = state.setdefault(k, {"newest": None, "value": None, "version": 0, "waiting": []})
        is_late = s["newest"] is not None and at < s["newest"] - delay
        if is_late:
            due = [(at, seq, v)]
        else:
            s["waiting"].append((at, seq, v))
            s["newest"] = at if s["newest"] is None else max(at, s["newest"])
            due = sorted(w for w in s["waiting"] if w[0] <= s["newest"] - delay)
            s["waiting"] = [w for w in s["waiting"] if w not in due]
        for a, q, x in due:
            if not s["version"] or x != s["value"]:
                s["value"], s["version"] = x, s["version"] + 1
                out.append((k, a, q, x, s["version"], is_late))
    return sorted(out)


def run(spark, rows, parts, tmp):
    folder = f"{tmp}/{uuid.uuid4().hex}"
    size = -(-len(rows) // parts)
    for p in range(parts):
        part = sorted(rows, key=lambda r: r[3])[p * size : (p + 1) * size]
        frame = spark.createDataFrame([(k, v, at, seq) for k, v, at, seq in part], "k string, v string, at long, seq long")
        frame.selectExpr("k", "v", "timestamp_seconds(at) AS at", "seq").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = L.late_versions(stream, "k", "v", "at", "seq", "10 seconds")
    q = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p["numInputRows"]]) == parts
    got = spark.read.schema(out.schema).parquet(f"{folder}/out").selectExpr("k", "unix_seconds(at) AS at", "seq", "v", "version", "late").collect()
    return sorted((r["k"], r["at"], r["seq"], r["v"], r["version"], r["late"]) for r in got)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, L.ROCKSDB)
    yield spark
    spark.conf.set(name, old)


def test_a_b_a_gives_three_versions_in_any_batches(rocks, tmp_path):
    rows = [("x", "A", 0, 1), ("x", "B", 20, 2), ("x", "A", 40, 3), ("x", "A", 60, 4), ("x", "C", 5, 5), ("x", "D", 100, 6)]
    want = [("x", 0, 1, "A", 1, False), ("x", 5, 5, "C", 4, True), ("x", 20, 2, "B", 2, False), ("x", 40, 3, "A", 3, False), ("x", 60, 4, "A", 5, False)]
    assert sorted(plain([(k, v, at, s) for k, v, at, s in rows], 10)) == sorted(want)
    for parts in (1, 3):
        assert run(rocks, rows, parts, tmp_path) == sorted(want)


def test_random_arrivals_equal_the_fold(rocks, tmp_path):
    r = random.Random(6)
    rows = [(f"k{r.randint(0, 5)}", r.choice("ABC"), max(0, s + r.randint(-25, 0)), s) for s in range(400)]
    want = plain(rows, 10)
    assert any(x[5] for x in want) and run(rocks, rows, 1, tmp_path) == want == run(rocks, rows, 4, tmp_path)
