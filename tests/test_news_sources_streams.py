"""News rules, landed files, guarded writes and streams against their batch forms."""

import datetime as dt
import json
import random
import tempfile
import unicodedata

import pytest
from pyspark.sql import functions as F

from tests.test_core import fold_velocity
from tidemark.functions import text as TX
from tidemark.operators import news as N
from tidemark.operators.checks import overlapping
from tidemark.sources import readers as RD
from tidemark.sources import sinks as SK
from tidemark.streaming import folds as FD
from tidemark.streaming import late as LD

NOW = dt.datetime(2026, 9, 10, 12)


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def classify(spark, *titles):
    a = spark.createDataFrame([(i, t, "s") for i, t in enumerate(titles)], "id int, title string, source_id string")
    s = spark.createDataFrame([("s", "compute", ["MU"])], "source_id string, topic string, tickers array<string>")
    return {r["id"]: r for r in N.classify_event(a, s).collect()}


def test_event_rules(spark):
    out = classify(
        spark, "Micron to report fourth quarter results", "Company denies HBM agreement", "HBM4 mass capacity expansion", "Board of directors appoints chair", "New power and cooling alliance",
    )
    assert [out[i]["event"] for i in range(5)] == ["calendar", "other", "capacity", "governance", "partnership"]
    assert out[2]["topic"] == "memory" and out[2]["importance"] == "high" and "MU" not in out[2]["related_tickers"]
    assert out[3]["related_tickers"] == [] and out[4]["related_tickers"] == ["VRT", "NVDA", "NBIS"]
    assert out[2]["subjects"] == ["HBM", "生産能力"]


def greedy(rows):
    """Plain newest-first pass over the same keys."""
    seen, kept = set(), []
    for i, title, url, at, src in sorted(rows, key=lambda r: (-r[3].timestamp(), r[0])):
        norm = "".join(c for c in unicodedata.normalize("NFKC", title).lower() if c.isalnum())
        keys = {("u", url.split("?utm")[0].rstrip("/")), ("t", norm)}
        if not keys & seen:
            kept.append(i)
            seen |= keys
    return sorted(kept)


def test_article_keys_keep_bare_parameters_and_any_scheme(spark):
    links = ["http://x.example/p?1001", "https://X.example/p?1002", "http://x.example/p/?utm_a=1&1001#t", "https://x.example//", "https://x.example?gclid=1", "no link"]
    got = [r["k"] for r in spark.createDataFrame(list(enumerate(links)), "i int, u string").select("i", TX.article_key(F.col("u")).alias("k")).orderBy("i").collect()]
    assert got == ["http://x.example/p?1001", "https://x.example/p?1002", "http://x.example/p?1001", "https://x.example/", "https://x.example/", None]


def test_dedupe_matches_links_and_titles_as_a_reader_sees_them(spark):
    rows = [
        (1, "First story", "http://x.example/p?1001", "a"), (2, "Second story", "http://x.example/p?1002", "a"), (3, "Other words", "http://x.example/p/?1001&utm_x=1", "b"),
        (4, "ＡＩ memory", "https://x.example/q", "a"), (5, "AI memory", "https://x.example/r", "b"),
    ]
    df = spark.createDataFrame([(i, t, u, NOW - dt.timedelta(minutes=i), s) for i, t, u, s in rows], "id int, title string, url string, published_at timestamp, source_id string")
    assert sorted(r["id"] for r in N.dedupe_articles(df).collect()) == [1, 2, 4]


def test_dedupe_is_the_greedy_pass(spark):
    rng = random.Random(3)
    rows = [(i, f"Story {rng.randrange(40)}", f"https://a.example.com/{rng.randrange(40)}/?utm_x={i}", NOW - dt.timedelta(minutes=rng.randrange(300)), "s") for i in range(150)]
    df = spark.createDataFrame(rows, "id int, title string, url string, published_at timestamp, source_id string")
    assert sorted(r["id"] for r in N.dedupe_articles(df).collect()) == greedy(rows)


def test_announcement_variant_keeps_changed_numbers(spark):
    base = "Memory maker begins volume shipments of its 12 layer stack to data center customers"
    rows = [(1, base, "https://a.example.com/1"), (2, f"“A look inside the line” — {base}", "https://a.example.com/2"), (3, base.replace("12", "16"), "https://a.example.com/3")]
    df = spark.createDataFrame([(i, t, u, NOW - dt.timedelta(minutes=i), "s") for i, t, u in rows], "id int, title string, url string, published_at timestamp, source_id string")
    assert sorted(r["id"] for r in N.dedupe_articles(df).collect()) == [1, 3]


def test_overlaps_without_pairs(spark):
    d = dt.date
    rows = [("a", d(2024, 1, 1), None, "t1"), ("a", d(2024, 3, 1), d(2024, 4, 1), "t2"), ("a", d(2025, 1, 1), None, "t3"), ("b", d(2024, 1, 1), d(2024, 1, 31), "t1"), ("b", d(2024, 2, 1), None, "t2")]
    df = spark.createDataFrame(rows, "entity_id string, s date, e date, theme_id string")
    assert sorted((r["key"], r["detail"]) for r in overlapping(df, ["entity_id"], "s", "e", "theme_id").collect()) == [("a", "t2"), ("a", "t3")]


def test_landed_files(spark, folder):
    with open(f"{folder}/m.csv", "w", encoding="utf-8") as f:
        f.write("﻿theme_id,ticker,effective_from,effective_to\n t1 , MU ,2026-09-08,\n")
    row = RD.read_dimension(spark, f"{folder}/m.csv").first()
    assert (row["theme_id"], row["ticker"], row["effective_from"], row["effective_to"]) == ("t1", "MU", dt.date(2026, 9, 8), None)
    with open(f"{folder}/h.jsonl", "w") as f:
        f.write(json.dumps({"as_of": "2026-09-08", "calculated_at": "2026-09-09T00:00:00Z", "themes": [{"theme_id": "t1", "score": 5.0}, {"theme_id": "t2", "score": None}]}) + "\n")
    assert RD.read_history(spark, f"{folder}/h.jsonl", "theme_id:string,score:double").count() == 2
    with open(f"{folder}/flows.csv", "w") as f:
        f.write("id,date,timestamp,amount_jpy,type,note\n1,2026-09-08,,100,deposit,\n")
    assert RD.read_ledger_csv(spark, f"{folder}/flows.csv", "flows").first()["amount_jpy"] == 100
    with open(f"{folder}/bad.csv", "w") as f:
        f.write("id,date,timestamp,amount_jpy,type,note\n1,2026-09-08,,ten,deposit,\n")
    with pytest.raises(Exception, match="unreadable amount"):
        RD.read_ledger_csv(spark, f"{folder}/bad.csv", "flows").collect()


def test_archive_hashes(spark, folder):
    import hashlib
    import os

    os.makedirs(f"{folder}/outcomes/2026")
    good, bad = '{"a":1}', '{"a":2}'
    with open(f"{folder}/outcomes/2026/x.jsonl", "w") as f:
        f.write(json.dumps({"record_id": hashlib.sha256(good.encode()).hexdigest(), "payload": good}) + "\n")
        f.write(json.dumps({"record_id": "nope", "payload": bad}) + "\n")
    rows = RD.read_archive(spark, folder, "outcomes").collect()
    assert sorted((r["reference"], r["valid"]) for r in rows) == [("outcomes/2026/x.jsonl", False), ("outcomes/2026/x.jsonl", True)]


def test_feeds(spark):
    rss = '<rss><channel><item><title>A &amp; B</title><link>https://A.example.com/n/?utm_source=f</link><pubDate>Wed, 09 Sep 2026 10:00:00 GMT</pubDate></item></channel></rss>'
    atom = '<feed><entry><title>C</title><link rel="alternate" href="https://b.example.com/c"/><updated>2026-09-09T10:00:00+09:00</updated></entry><entry><title>old</title><link href="https://b.example.com/o"/><updated>2020-01-01T00:00:00Z</updated></entry></feed>'
    df = spark.createDataFrame([("r", rss), ("a", atom), ("x", "<!DOCTYPE x>" + rss)], "source_id string, xml string")
    out = {r["source_id"]: r for r in RD.read_feed_xml(df, F.lit(NOW).cast("timestamp")).collect()}
    assert set(out) == {"r", "a"} and out["r"]["title"] == "A & B" and out["r"]["url"] == "https://a.example.com/n"
    assert out["a"]["published_at"] == dt.datetime(2026, 9, 9, 1)


def test_links_resolve_as_the_standard_library_does(spark):
    from urllib.parse import urljoin, urlsplit

    bases = ["https://a.example.com/feeds/x/rss.xml?v=1", "https://a.example.com", "https://a.example.com/feeds/"]
    links = ["/n/1", "n/2", "../3", "../../../4", "./5/./6", "?q=7", "//b.example.com/8", "https://c.example.com/9", "http://a.example.com/10", "http://b.example.com/11", "a/../12", "13/..", "n?x=../14", ""]
    pairs = [(b, x) for b in bases for x in links]
    got = [r[0] for r in RD.resolve_links(spark.createDataFrame(pairs, "base_url string, link string").coalesce(1)).select("link").collect()]
    for (b, x), g in zip(pairs, got):
        want = urljoin(b, x)
        if urlsplit(want).scheme == "http" and urlsplit(want).netloc == urlsplit(b).netloc:
            want = "https" + want[4:]
        assert g.rstrip("/") == want.rstrip("/"), (b, x)
    plain = spark.createDataFrame([("n/1", None), (None, "https://a.example.com/")], "link string, base_url string").coalesce(1)
    assert [r[0] for r in RD.resolve_links(plain).select("link").collect()] == ["n/1", None]


def test_mail_dates_as_the_standard_library_reads_them(spark):
    from email.utils import parsedate_to_datetime

    texts = ["Wed, 09 Sep 2026 10:00:00 GMT", "9 Sep 2026 10:00 EST", "Wed, 9 Sep 2026 10:00:00 PDT", "09 Sep 2026 10:00:00 +0900", "Wed, 09 Sep 2026 10:00:00 -0330", "Wed, 09 Sep 2026 10:00:00 UT"]
    df = spark.createDataFrame([(t,) for t in [*texts, "soon", "", None, "09 Sep 2026 10:00:00 XYZ"]], "t string").coalesce(1)
    got = [r[0] for r in df.select(F.unix_seconds(RD.mail_date(F.col("t")))).collect()]
    assert got == [int(parsedate_to_datetime(t).timestamp()) for t in texts] + [None] * 4


def test_feed_items_with_relative_links_and_named_zones(spark):
    item = "<item><title>A</title><link>{}</link><pubDate>Wed, 09 Sep 2026 10:00:00 EDT</pubDate></item>"
    xml = "<rss><channel>" + "".join(item.format(x) for x in ("/n/1", "http://a.example.com/n/2", "http://other.example.com/n/3")) + "</channel></rss>"
    df = spark.createDataFrame([("r", xml, "https://a.example.com/feed.xml")], "source_id string, xml string, base_url string")
    rows = RD.read_feed_xml(df, F.lit(NOW).cast("timestamp")).orderBy("pos").collect()
    assert [r["url"] for r in rows] == ["https://a.example.com/n/1", "https://a.example.com/n/2"] and rows[0]["published_at"] == dt.datetime(2026, 9, 9, 14)


def test_each_feed_field_is_parsed_once(spark):
    feed = "<rss><channel><item><title>A</title><link>https://a.example.com/n/1</link><pubDate>Wed, 09 Sep 2026 10:00:00 GMT</pubDate></item></channel></rss>"
    rows = [("r", feed, "https://a.example.com/f"), ("d", "<!docType x>" + feed, None), ("e", "<!eNtity x>" + feed, None)]
    for columns in ("source_id string, xml string, base_url string", "source_id string, xml string"):
        df = spark.createDataFrame([r[: columns.count(",") + 1] for r in rows], columns)
        out = RD.read_feed_xml(df, F.lit(NOW).cast("timestamp"))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        # One title pattern (its two tags) and one unwrapping each of title and link.
        assert plan.count("?title") == 2 and plan.count("CDATA") == 2
        assert [(r["source_id"], r["pos"], r["title"], r["url"]) for r in out.collect()] == [("r", 0, "A", "https://a.example.com/n/1")]


def test_feed_titles_of_odd_texts(spark, tmp_path):
    import re

    from tidemark.plans import contract_queries as CQ

    texts = ["", "...", "  two   words \n\n and\tmore ", "Größe über 100 %", "<item>&amp;]]></title><link>x</link>", "a\U0001f600b 語 c", "x" * 5000 + "\r\n" + "y. " * 5000]
    spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = CQ.read_feed_xml(spark, str(tmp_path))
    # Runs of letters and blanks are taken; a negated class over whole texts is slow beside other tasks.
    assert "[^A-Za-z" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = [(k, re.sub(" +", " ", re.sub("[^A-Za-z ]", "", t) + " x").strip(" ")) for k, t in enumerate(texts)]
    assert sorted((r["pos"], r["title"]) for r in out.collect()) == want


def test_observation_never_goes_back(spark, folder):
    s = "as_of date, ticker string, value double"
    a = spark.createDataFrame([(dt.date(2026, 9, 8), "A", 1.0), (dt.date(2026, 9, 8), "B", 2.0)], s)
    worse = spark.createDataFrame([(dt.date(2026, 9, 8), "A", 1.0), (dt.date(2026, 9, 8), "B", None)], s)
    older = spark.createDataFrame([(dt.date(2026, 9, 7), "A", 1.0)], s)
    assert SK.save_observation(None, a, "value", folder)
    assert not SK.save_observation(a, worse, "value", folder) and not SK.save_observation(a, older, "value", folder)
    assert spark.read.parquet(f"{folder}/latest").count() == 2 and spark.read.parquet(f"{folder}/observations").count() == 5


def test_velocity_stream_in_small_batches_equals_the_fold(spark, folder):
    rng = random.Random(9)
    series = {t: [rng.choice(["L", "I", None]) if i % 6 == 0 else "L" if (i // 7) % 2 else "I" for i in range(40)] for t in ("T1", "T2")}
    start = dt.date(2026, 1, 1)
    for b in range(4):
        rows = [(t, start + dt.timedelta(days=i), rs[i]) for t, rs in series.items() for i in range(b * 10, b * 10 + 10)]
        spark.createDataFrame(rows, "theme_id string, as_of date, raw_state string").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    src = spark.readStream.schema("theme_id string, as_of date, raw_state string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", LD.ROCKSDB)
    q = FD.stream_velocity(src).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {(r["theme_id"], r["as_of"]): (r["state"], r["candidate"], r["candidate_days"], r["confirmed"]) for r in spark.read.parquet(f"{folder}/out").collect()}
    for t, rs in series.items():
        for i, want in enumerate(fold_velocity(rs)):
            assert got[(t, start + dt.timedelta(days=i))] == want


def test_feed_files_of_a_large_source_are_bounded(spark, tmp_path, monkeypatch):
    from tidemark.plans import contract_queries as CQ

    ids = spark.range(5000)
    ids.select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"), F.when(F.col("id") < 4990, "big").otherwise("src3").alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    seen, read = [], CQ.RD.read_feed_xml
    monkeypatch.setattr(CQ.RD, "read_feed_xml", lambda raw, now: seen.append(raw) or read(raw, now))
    got = sorted((r["source_id"], r["url"]) for r in CQ.read_feed_xml(spark, str(tmp_path)).collect())
    assert got == sorted(("big", f"https://feed.example.com/n/{k}") for k in range(4990) if k % 100 <= 90)
    most = seen[0].select(F.max(F.size(F.split("xml", "<item>")) - 1)).first()[0]
    assert most <= 2000 and seen[0].count() == 4


def held_articles(spark):
    articles = [(1, ["MU"], ["NVDA"]), (2, ["NVDA", "TSM"], []), (3, [], ["MU", "TSM"]), (4, ["XX"], []), (1, ["TSM"], []), (5, None, ["MU"])]
    rows = spark.createDataFrame([(*a, NOW, "t") for a in articles], "id int, direct_tickers array<string>, related_tickers array<string>, published_at timestamp, topic string")
    own = [(k, t) for k in range(40) for t in (["MU"], ["MUU", "TSM"], ["NVDL"], ["ASML", None], ["MU", "MUU"])[k % 5]]
    own = own + own[:3]
    target = {"MUU": "MU", "NVDL": "NVDA"}
    want = {}
    for i, direct, related, *_ in articles:
        for k, t in own:
            for d, names in ((1, direct or []), (0, related or [])):
                if t and target.get(t, t) in names:
                    pair = want.setdefault((i, k), {})
                    pair[t] = max(d, pair.get(t, 0))
    want = {p: tuple([sorted(t for t in v if v[t] == d)] for d in (1, 0)) for p, v in want.items()}
    return rows, spark.createDataFrame(own, "account_id int, ticker string"), want


@pytest.mark.parametrize("most", [1000, 0])
def test_holdings_relate_without_a_shuffle_of_the_result(spark, most):
    rows, own, want = held_articles(spark)
    out = N.relate_to_holdings(rows, own, most)
    got = [((r["id"], r["account_id"]), ([r["direct"]], [r["indirect"]])) for r in out.collect()]
    assert dict(got) == want and len(got) == len(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(_accounts") < min(plan.index(x) for x in ("Join", "Repartition")) and "max(d" not in plan


def test_holdings_are_written_in_a_fraction_of_a_byte_a_row(spark, tmp_path):
    """Every article meets 2,000 of 6,001 accounts or more; ids that are null are ids too."""
    kinds = F.array(*[F.array(F.lit(t)) for t in ("MU", "NVDA", "TSM")])
    rows = spark.range(1500).select(F.when(F.col("id") > 0, F.col("id") * 7919 % 1_000_003).alias("id"), F.get(kinds, F.col("id") % 3).alias("direct_tickers"), F.array(F.lit("ASML")).alias("related_tickers"))
    account = F.when(F.col("id") < 6000, F.col("id") * 104_729 % 10_000_019)
    own = spark.range(6001).select(account.alias("account_id"), F.get(F.array(*[F.lit(t) for t in ("MUU", "NVDL", "TSM")]), F.col("id") % 3).alias("ticker"))
    own = own.unionByName(own.where(F.col("account_id") < 1_000_000).withColumn("ticker", F.lit("ASML")))
    path = str(tmp_path / "out")
    N.relate_to_holdings(rows, own, text=True).write.parquet(path)
    got = spark.read.parquet(path)

    held = own.select("account_id", "ticker", F.expr("CASE ticker WHEN 'MUU' THEN 'MU' WHEN 'NVDL' THEN 'NVDA' ELSE ticker END").alias("target"))
    named = rows.select("id", F.col("direct_tickers")[0].alias("target"), F.lit("direct").alias("kind")).unionByName(rows.select("id", F.lit("ASML").alias("target"), F.lit("indirect").alias("kind")))
    each = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("ticker"))), F.lit("")).alias(k)
    want = named.join(held, "target").groupBy("id", "account_id").agg(each("direct"), each("indirect"))
    sums = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("id", "account_id", "direct", "indirect").cast("decimal(38,0)"))).first()
    assert sums(got) == sums(want) and got.where("id IS NULL AND account_id IS NULL").count() == 1
    size = sum(f.stat().st_size for f in (tmp_path / "out").glob("part-*"))
    assert size < 0.5 * got.count()


def test_own_articles_are_found_without_their_accounts(spark):
    rows, own, want = held_articles(spark)
    out = N.filter_articles(rows, F.lit(NOW), "mine", own)
    assert sorted(r["id"] for r in out.collect()) == [1, 1, 2, 3, 5] and {i for i, _ in want} == {1, 2, 3, 5}
    assert "account_id" not in out._jdf.queryExecution().optimizedPlan().toString().replace("LogicalRDD [account_id", "")


@pytest.mark.parametrize("most", [1000, 0])
def test_symbol_search_shuffles_hits_only(spark, most):
    names = ["Micron", "Mitsui", "AA mi", "Brand mic", "none"]
    listings = spark.createDataFrame([(i, f"B{i % 4}", names[i % 5], "X") for i in range(60)], "id int, symbol string, name string, exchange string")
    queries = spark.createDataFrame([("mic",), ("B1",), ("b",), ("zz",), ("",)], "query string")
    out = N.symbol_search(listings, queries, 5, most)
    got = {}
    for r in sorted(out.collect(), key=lambda r: r["position"]):
        got.setdefault(r["query"], []).append(r["id"])
    want = {}
    for q in ("mic", "B1", "b"):
        key = q.upper()
        hit = [(0 if f"B{i % 4}" == key else 1 if f"B{i % 4}".startswith(key) else 2, f"B{i % 4}", i) for i in range(60) if key in (f"B{i % 4}" + names[i % 5]).upper().replace(" ", "")]
        want[q] = [i for *_, i in sorted(hit)[:5]]
    assert got == want
    assert ("ResolvedHint (strategy=broadcast)" in out._jdf.queryExecution().analyzed().toString()) == (most > 0)
