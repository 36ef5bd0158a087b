"""Streams run to completion over the supplied tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import regime as R
from tidemark.operators import themes as T
from tidemark.plans import news_queries as NQ
from tidemark.plans import views as V
from tidemark.plans.catalog import flat, query
from tidemark.plans.display_queries import _REGIME, ROLES, _factors, _vix
from tidemark.plans.research_queries import _USAGE
from tidemark.plans.theme_queries import _VELOCITY, _core, day
from tidemark.plans.views import m, money, with_views
from tidemark.streaming import folds as FD
from tidemark.streaming import late as LD
from tidemark.streaming import quotes as QT
from tidemark.streaming import streams as ST


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's checkpoint folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def run_stream(stream: DataFrame, name: str) -> DataFrame:
    """Drive a stream over all available input and read back what it appended."""
    spark = stream.sparkSession
    base = shared_folder(spark, name)
    q = (
        stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_batches(stream: DataFrame, writer, name: str) -> None:
    log = f"{shared_folder(stream.sparkSession, name)}/log"
    stream.writeStream.foreachBatch(writer).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()


def table_stream(spark, d, name: str) -> DataFrame:
    return spark.readStream.schema(V.table(spark, d, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def frame_stream(df: DataFrame, name: str) -> DataFrame:
    """A derived table landed as files and read as a stream."""
    path = f"{shared_folder(df.sparkSession, name)}/in"
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


#: Landings of a stream that comes in several batches, and files of a landing.
LANDINGS, FILES = 4, 4


def landed_stream(df: DataFrame, name: str, key: str, place) -> DataFrame:
    """A table landed in parts by rising `place` (a number), read as a stream of as many batches.

    The rows of a key lie in one file of each landing, so that its files come in order.
    """
    path = f"{shared_folder(df.sparkSession, name)}/in"
    lo, hi = df.agg(F.min(place), F.max(place)).first()
    part = F.floor((place - F.lit(lo or 0)) * LANDINGS / F.lit((hi or 0) - (lo or 0) + 1))
    for k in range(LANDINGS):
        df.where(part == k).repartition(FILES, key).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES).parquet(path)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Keyed states need this store."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, LD.ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, old)


@query("stream_bars", f"""SELECT event_type AS ticker, strftime(s, '%Y-%m-%d %H:%M:%S') AS bar_start, {m('o')} AS open, {m('c')} AS close, {m('v')} AS volume, n AS ticks FROM (
  SELECT event_type, time_bucket(INTERVAL '6 hours', ts) AS s, arg_min(value, (ts, event_id)) AS o, arg_max(value, (ts, event_id)) AS c, sum(user_id) AS v, count(*) AS n FROM events GROUP BY 1, 2)
  WHERE s + INTERVAL '6 hours' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)""".replace("sum(user_id)", "CAST(sum(user_id) AS DOUBLE)"))
def stream_bars(spark, d):
    ticks = table_stream(spark, d, "events").select(
        F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.col("user_id").cast("double").alias("volume"), F.col("event_id").alias("tick_id")
    )
    out = run_stream(ST.stream_bars(ticks, "6 hours", "1 hour"), "bars")
    return out.select("ticker", F.date_format("bar_start", "yyyy-MM-dd HH:mm:ss").alias("bar_start"), money("open"), money("close"), money("volume"), "ticks")


@query("stream_latest_quotes", f"SELECT CAST(user_id AS VARCHAR) AS ticker, {m('arg_max(value, (CAST(ts AS DATE), event_id))')} AS price FROM events GROUP BY 1")
def stream_latest_quotes(spark, d):
    """Every event a quote of its user; days come in order of their number modulo 7, so that later batches bring older ones."""
    q = V.table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("ticker"), F.to_date("ts").alias("as_of"), F.col("value").alias("price"), F.col("event_id").alias("quote_id")
    )
    path = shared_folder(spark, "quotes")
    run_batches(landed_stream(q, "quote-feed", "ticker", F.unix_date("as_of") % 7), QT.latest_quotes_writer(path, buckets=16), "quotes")
    return QT.latest_quotes(spark, path).select("ticker", money("price"))


@query("stream_dedupe_news", with_views("SELECT link, 1 AS n FROM arts GROUP BY 1", NQ._NEWS).replace("1 AS n", "CAST(1 AS BIGINT) AS n"))
def stream_dedupe_news(spark, d):
    arts = frame_stream(NQ.articles(spark, d), "articles")
    return run_stream(ST.stream_dedupe_news(arts, "400 days"), "dedupe").groupBy(F.col("key").alias("link")).agg(F.count(F.lit(1)).alias("n"))


@query("stream_velocity", with_views(f"SELECT theme_id, {day('as_of')}, state, CAST(days AS BIGINT) AS candidate_days, confirmed FROM fold", _VELOCITY))
def stream_velocity(spark, d):
    raw = T.velocity_raw(V.all_bars(spark, d), _core(spark, d), V.as_of(spark, d)).select("theme_id", "as_of", "raw_state")
    with rocksdb(spark):
        out = run_stream(FD.stream_velocity(landed_stream(raw, "raw", "theme_id", F.unix_date("as_of"))), "velocity")
    return flat(out.select("theme_id", "as_of", "state", "candidate_days", "confirmed"))


@query("stream_regime", with_views(f"SELECT {day('session')}, state, CAST(days AS BIGINT) AS state_days, stressed AS stress_active FROM regime_rows", _REGIME))
def stream_regime(spark, d):
    rows = R.regime_daily(_factors(spark, d), _vix(spark, d), ROLES).select("market_id", "session", "trend", "stress_hit")
    with rocksdb(spark):
        out = run_stream(FD.stream_regime(landed_stream(rows, "scores", "market_id", F.unix_date("session"))), "regime")
    return flat(out.select("session", "state", "state_days", "stress_active"))


@query("stream_usage_changes", _USAGE.replace("SELECT event_id, prev FROM", "SELECT event_id FROM", 1))
def stream_usage_changes(spark, d):
    ev = V.table(spark, d, "events").withColumn("fingerprint", F.concat_ws("|", "event_type", F.floor(F.col("value") / 20).cast("string"))).withColumn("ts", F.col("ts").cast("timestamp"))
    ev = ev.select("event_id", "user_id", "ts", "fingerprint")
    with rocksdb(spark):
        out = run_stream(FD.stream_usage_changes(landed_stream(ev, "usage-feed", "user_id", F.unix_micros("ts"))), "usage")
    return out.select("event_id")


#: Events land out of order: by 40 places at most, so that some come behind an hour of delay.
_ARRIVAL = "event_id * 8 + (event_id * 7919 % 41) * 8 + event_id % 8"


@query("late_data", f"""WITH e AS (SELECT user_id, event_type, ts, {_ARRIVAL} AS arrival FROM events),
  r AS (SELECT *, max(ts) OVER (PARTITION BY user_id ORDER BY arrival) AS newest, max(ts) OVER (PARTITION BY user_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
  l AS (SELECT *, coalesce(ts < before - INTERVAL '1 hour', false) AS late FROM r),
  j AS (SELECT user_id, ts, arrival, event_type, late, arrival AS judged FROM l WHERE late UNION ALL
        SELECT l.user_id, l.ts, l.arrival, l.event_type, l.late, min(n.arrival) AS judged
        FROM l JOIN r n ON n.user_id = l.user_id AND n.arrival >= l.arrival AND n.newest - INTERVAL '1 hour' >= l.ts WHERE NOT l.late GROUP BY ALL),
  c AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY judged, ts, arrival) IS DISTINCT FROM event_type AS changed FROM j)
  SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, arrival, event_type, CAST(count(*) OVER (PARTITION BY user_id ORDER BY judged, ts, arrival) AS BIGINT) AS version, late FROM c WHERE changed""")
def late_data(spark, d):
    """Every version of a user's event type, from events that land out of order, over several batches."""
    ev = V.table(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.expr(f"CAST({_ARRIVAL} AS BIGINT)").alias("arrival"))
    with rocksdb(spark):
        out = run_stream(LD.late_versions(landed_stream(ev, "arrivals", "user_id", F.col("arrival")), "user_id", "event_type", "ts", "arrival", "1 hour"), "late")
    return out.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "arrival", "event_type", "version", "late")


@query("sliding_activity", f"""SELECT event_type, strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events, {m('sum(value)')} AS total FROM (
  SELECT *, time_bucket(INTERVAL '3 hours', ts) - k * INTERVAL '3 hours' AS s FROM events, (VALUES (0), (1), (2), (3)) v(k)) WHERE s + INTERVAL '12 hours' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events) GROUP BY 1, s""")
def sliding_activity(spark, d):
    ev = table_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = run_stream(ST.sliding_activity(ev, "12 hours", "3 hours", "1 hour"), "sliding")
    return out.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events", money("total"))


@query("session_activity", """SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events FROM (SELECT user_id, g, count(*) AS n, max(ts) AS last FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2)
  WHERE last + INTERVAL '2 hours' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events) GROUP BY 1""")
def session_activity(spark, d):
    ev = table_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = run_stream(ST.session_activity(ev, "2 hours", "1 hour"), "sessions")
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("events").alias("events"))
