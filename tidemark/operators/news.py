"""Article classification, merging, de-duplication and reading views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import article_key, event_title, exposure, search_key, strip_html, title_key, title_numbers
from tidemark.operators.keyed import cut_lineage

# Keyword filter and exclusion of feeds.
KEYWORDS = r"(?i)\b(hbm\w*|dram|nand|memory|semiconductor|chip\w*|gpu\w*|ssd|photon\w*|optical|data.?cent\w*)\b"
EXCLUDED = {"nvidia": r"(?i)geforce now"}

# Topic -> tickers, and headline words that override the feed's topic.
TOPIC_TICKERS = {
    "memory": ["MU", "SKHY"],
    "storage": ["SNDK", "WDC", "STX", "MU"],
    "optical": ["COHR", "LITE", "AAOI", "CRDO", "MRVL"],
    "equipment": ["AMAT", "LRCX", "KLAC", "ASML"],
    "foundry": ["TSM", "ASML", "AMAT"],
    "compute": ["NVDA", "AMD", "AVGO", "TSM", "MU", "NBIS"],
}
TOPIC_WORDS = [
    ("memory", r"\b(hbm\w*|dram|lpddr\w*|memory)\b"),
    ("storage", r"\b(nand|ssd|storage)\b"),
    ("optical", r"\b(optical|photon\w*|transceiver\w*|cpo)\b"),
    ("foundry", r"\b(foundry|cowos|tsmc)\b"),
]
# Event of a headline, first match wins; negation comes first.
EVENT_WORDS = [
    ("other", r"\b(not|no plans|denies|rumou?r|reportedly)\b"),
    ("calendar", r"\b(to report|to announce|will report|will announce|schedule\w*|will present|to present|will attend|to attend|participat\w*)\b"),
    ("regulation", r"\b(export|restrict\w*|sanction\w*|ban|bans|banned|banning|regulat\w*)\b"),
    ("results", r"\b(results|earnings)\b"),
    ("governance", r"\b(appoint\w*|retir\w*|board of directors|chief executive|chief financial)\b"),
    ("capital_return", r"\b(dividend\w*|repurchase\w*|buyback\w*)\b"),
    ("demonstration", r"\b(demonstrat\w*|showcas\w*|exhibit\w*)\b"),
    ("qualification", r"\b(qualify|qualification|certif\w*)\b"),
    ("capacity", r"\b(expand\w*|invest|invests|invested|investing|investment|investments|manufacturing|fab|capacity)\b"),
    ("partnership", r"\b(partner\w*|collaborat\w*|agreement|alliance)\b"),
    ("product", r"\b(launch\w*|introduc\w*|unveil\w*|deliver\w*)\b"),
]
HIGH_EVENTS = ("results", "regulation", "capacity", "partnership", "demonstration", "qualification")
OWN_MATTERS = ("calendar", "governance", "capital_return")
# Subjects named in a headline, at most two in this order.
POWER, VENTURES = "電力・冷却", "ベンチャー投資"
POWER_TICKERS = ["VRT", "NVDA", "NBIS"]
SUBJECT_WORDS = [
    (POWER, r"\b(power|cooling|energy)\b"),
    (VENTURES, r"\b(ventures|venture capital)\b"),
    ("HBM", r"\b(hbm\w*)\b"),
    ("DRAM", r"\b(dram|lpddr\w*)\b"),
    ("NAND・SSD", r"\b(nand|ssd)\b"),
    ("VCSEL・チップ間光接続", r"\b(vcsel|d2d)\b"),
    ("レーザー・光モジュール", r"\b(dwdm|elsfp|laser)\b"),
    ("光通信", r"\b(cpo|photon\w*|optical|transceiver\w*)\b"),
    ("性能評価", r"\b(mlperf|benchmark\w*)\b"),
    ("AI計算基盤", r"\b(rubin|blackwell|gpu\w*)\b"),
    ("AIインフラ", r"\b(data.?cent\w*|ai factories|ai infrastructure)\b"),
    ("生産能力", r"\b(manufacturing|factory|fab|capacity)\b"),
    ("決算", r"\b(results|earnings)\b"),
]
BOILERPLATE = r"(?i)forward-looking|safe harbor|copyright|all rights reserved|cookie|privacy policy"
FACT_WORDS = r"(?i)revenue|earnings|gross margin|guidance|billion|million|HBM|DRAM|NAND|SSD|mass production"
BLOCKED_PAGE = r"(?i)access denied|verify you are human|enable javascript and cookies"
MEMORY_TICKERS = ("MU", "SKHY", "SNDK")
PRIORITY_SOURCES = ("micron", "skhynix", "sandisk", "samsung")
LEADER_SOURCES = ("micron", "skhynix", "sandisk")
EMPTY = "array<string>"
#: Search queries that are broadcast; more are joined by a shuffle.
BROADCAST_QUERIES = 100_000
#: Holdings: articles of a block, accounts of a list, lists of a group. A list of 504 keeps Parquet's bit-packed runs in step.
BLOCK, LIST, LISTS = 65_536, 504, 4
#: Articles that go through one step of a task, which holds this times LIST rows; accounts of a book that are gathered at once;
#: pairs of a task.
RUN, BUCKET, PAIRS = 32, 32_768, 1 << 24


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def relevant(title: Column, source_id: Column, require_keywords: Column) -> Column:
    ok = ~require_keywords | title.rlike(KEYWORDS)
    for sid, pattern in EXCLUDED.items():
        ok = ok & ~((source_id == sid) & title.rlike(pattern))
    return F.coalesce(ok, F.lit(False))


def context_labels(title: Column) -> Column:
    """First two subjects named in a headline."""
    found = F.array(*[F.when(title.rlike("(?i)" + p), name) for name, p in SUBJECT_WORDS])
    return F.slice(F.array_compact(found), 1, 2)


def classify_event(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Topic, event, subjects, importance and tickers of each headline.

    articles: title, source_id. sources: source_id, topic, tickers.
    """
    rows = articles.join(sources.select("source_id", F.col("topic").alias("_topic"), F.col("tickers").alias("direct_tickers")), "source_id")
    lower = F.lower("title")
    topic, event = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, p in TOPIC_WORDS:
        topic = F.coalesce(topic, F.when(lower.rlike(p), name))
    for name, p in EVENT_WORDS:
        event = F.coalesce(event, F.when(lower.rlike(p), name))
    rows = rows.select(
        *articles.columns, "direct_tickers", F.coalesce(topic, F.col("_topic")).alias("topic"), F.coalesce(event, F.lit("other")).alias("event"),
        context_labels(F.col("title")).alias("subjects"),
    )
    related = F.lit(None).cast(EMPTY)
    for name, tickers in TOPIC_TICKERS.items():
        related = F.when(F.col("topic") == name, _texts(tickers)).otherwise(related)
    related = F.when(F.array_contains("subjects", POWER), _texts(POWER_TICKERS)).otherwise(related)
    related = F.when(F.col("event").isin(*OWN_MATTERS), F.array().cast(EMPTY)).otherwise(related)
    return rows.select(
        "*", F.array_except(F.coalesce(related, F.array().cast(EMPTY)), "direct_tickers").alias("related_tickers"),
        F.when(F.col("event").isin(*HIGH_EVENTS), "high").otherwise("normal").alias("importance"),
    )


def merge_articles(previous: DataFrame, fresh: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """New over old by id keeping first-seen, 90-day window, newest per title, newest first.

    `limit`, if given, keeps only that many of the newest.

    Both frames: id, title, published_at, source_id, first_seen_at. Groups of copies are reduced
    by aggregation, which combines before the shuffle.
    """
    both = previous.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    cols = [c for c in previous.columns if c not in ("id", "first_seen_at")]
    by_id = both.groupBy("id").agg(
        F.max_by(F.struct(*cols), F.struct("_new", "first_seen_at", "title")).alias("_r"), F.min_by("first_seen_at", F.struct("_new", "first_seen_at")).alias("first_seen_at")
    ).select("id", "first_seen_at", "_r.*")
    window = F.col("published_at").between(now - F.expr("INTERVAL 90 DAYS"), now + F.expr("INTERVAL 5 MINUTES"))
    keyed = by_id.where(window).withColumn("_key", title_key(F.col("title")))
    rest = [c for c in keyed.columns if c != "_key"]
    unique = keyed.groupBy("_key").agg(F.max_by(F.struct(*rest), F.struct("published_at", "id")).alias("_r")).select("_r.*")
    ordered = unique.orderBy(F.desc("published_at"), F.desc("id"))
    return ordered.limit(limit) if limit else ordered


def feed_status(feeds: DataFrame) -> DataFrame:
    ok = F.count(F.when(F.col("status") == "ok", 1))
    n = F.count(F.lit(1))
    return feeds.agg(F.when(ok == n, "ok").when(ok > 0, "partial").otherwise("failed").alias("status"), n.alias("sources"), ok.alias("ok_sources"))


def dedupe_articles(articles: DataFrame) -> DataFrame:
    """Newest-first greedy de-duplication by link, exact title, and announcement variant.

    An article falls only to a *kept* newer one that shares a key. Each round keeps every open
    article that is the newest open one under all its keys and drops what shares a key with
    it, which decides exactly as one pass in time order would; the open set shrinks every
    round. Keys are grouped with min (combined before the shuffle) and dropped by key joins, so a
    group of copies of any size is never collected.

    articles: id, title, url, published_at, source_id.
    """
    link = F.coalesce(article_key(F.col("url")), F.col("id").cast("string"))
    ev = event_title(F.col("title"))
    announce = F.when(
        (F.length(ev) >= 48) & F.col("source_id").isNotNull(),
        F.concat_ws("|", F.col("source_id"), F.to_date("published_at").cast("string"), ev, title_numbers(F.col("title"))),
    )
    key = title_key(F.col("title"), normalize=True)
    rank = F.struct((-F.unix_micros("published_at")).alias("t"), F.col("id"))
    keyed = articles.select(
        "id", rank.alias("rank"),
        F.array_compact(F.array(F.concat(F.lit("u"), link), F.when(key != "", F.concat(F.lit("t"), key)), F.concat(F.lit("a"), announce))).alias("keys"),
    )
    open_rows = cut_lineage(keyed.select("id", "rank", F.explode("keys").alias("key"), F.size("keys").alias("n")))
    kept = None
    while True:  # each round decides at least the newest open article
        newest = open_rows.groupBy("key").agg(F.min("rank").alias("_first"))
        heads = open_rows.join(newest, "key").where(F.col("rank") == F.col("_first")).groupBy("id").agg(
            F.count(F.lit(1)).alias("_wins"), F.max("n").alias("n")
        ).where(F.col("_wins") == F.col("n")).select("id")
        heads = cut_lineage(heads)
        kept = heads if kept is None else kept.unionByName(heads)
        taken = open_rows.join(heads, "id", "left_semi").select("key").distinct()
        hit = open_rows.join(taken, "key", "left_semi").select("id").distinct()
        open_rows = cut_lineage(open_rows.join(hit, "id", "left_anti"))
        if open_rows.isEmpty():
            break
    return articles.join(kept, "id", "left_semi")


def _related(articles: DataFrame, own: DataFrame, article: str, account: str) -> DataFrame:
    """`article`, `account` and the account's tickers that the article is about, directly or by spill-over."""
    direct = articles.select(article, F.explode("direct_tickers").alias("target"), F.lit(1).alias("d"))
    related = articles.select(article, F.explode("related_tickers").alias("target"), F.lit(0).alias("d"))
    held = own.select(account, "ticker", exposure(F.col("ticker")).alias("target")).distinct()
    pairs = direct.unionByName(related).join(held, "target").groupBy(article, account, "ticker").agg(F.max("d").alias("d"))
    pick = lambda v: F.sort_array(F.collect_set(F.when(F.col("d") == v, F.col("ticker"))))
    return pairs.groupBy(article, account).agg(pick(1).alias("direct"), pick(0).alias("indirect"))


def _gathered(column: str) -> Column:
    """All values of a group, nulls included."""
    return F.flatten(F.collect_list(F.array(column)))


def _cut(values: Column, size: int) -> Column:
    """An array in arrays of at most `size`."""
    return F.transform(F.sequence(F.lit(0), F.size(values) - 1, F.lit(size)), lambda i: F.slice(values, i + 1, size))


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")


def relate_to_holdings(articles: DataFrame, own: DataFrame, most: int = BLOCK, text: bool = False) -> DataFrame:
    """Own tickers an article is about, directly or by spill-over, per account.

    own: account_id, ticker. Articles that name the same tickers and accounts that hold the same
    ones are related once. Articles come in blocks of about `most`, accounts in groups of lists, and a task
    pairs whole blocks with whole groups: arrays of either side are shuffled, pairs never. A block's rows repeat
    a list whole for article after article, so that columnar files take a fraction of a byte a row.
    text: tickers joined by commas instead of arrays, made once for all pairs that share them.
    """
    merged = lambda c: F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_list(c)))))
    named = articles.groupBy("id").agg(merged("direct_tickers").alias("direct_tickers"), merged("related_tickers").alias("related_tickers"))
    named = cut_lineage(named.select("id", F.struct("direct_tickers", "related_tickers").alias("_kind")))
    accounts = cut_lineage(own.groupBy("account_id").agg(F.sort_array(F.collect_set("ticker")).alias("_book")))
    kinds = named.select("_kind").distinct().select("_kind", "_kind.*")
    books = accounts.select("_book").distinct().select("_book", F.explode("_book").alias("ticker"))
    related = cut_lineage(_related(kinds, books, "_kind", "_book"))
    if text:
        related = related.withColumns({c: F.array_join(c, ",") for c in ("direct", "indirect")})

    m, n = named.count(), accounts.count()
    parts = int(articles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Small inputs come in more blocks, for enough tasks; large ones take a task for each block and group.
    blocks = max(m // max(most, 1), min(4 * parts, 4 * parts * LIST * LISTS // max(n, 1), m // RUN)) + 1
    tasks = max(parts, min((n // (LIST * LISTS) + 1) * blocks, m * n // PAIRS))

    sizes = accounts.groupBy("_book").agg(F.floor(F.count(F.lit(1)) / BUCKET + 1).alias("_buckets"))
    buckets = accounts.join(sizes, "_book").groupBy("_book", F.pmod(F.xxhash64("account_id"), F.col("_buckets")).alias("_bucket")).agg(_gathered("account_id").alias("_all"))
    groups = buckets.select("_book", F.explode(_cut(_cut(F.col("_all"), LIST), LISTS)).alias("_lists"))
    groups = cut_lineage(groups.withColumn("_group", F.monotonically_increasing_id()))
    dealt = groups.select("_group", "_lists", F.explode(_numbers(blocks)).alias("_block"))

    runs = named.groupBy("_kind", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("_block")).agg(_gathered("id").alias("_all"))
    runs = runs.select("_kind", "_block", F.explode(_cut(F.col("_all"), RUN)).alias("_ids"))
    meets = related.join(groups.select("_book", "_group"), "_book").drop("_book")
    runs = runs.join(meets, "_kind").drop("_kind")

    key = ["_group", "_block"]
    runs = runs.repartition(tasks, *key).withColumn("_list", F.explode(_numbers(LISTS))).sortWithinPartitions(*key, "_list")
    # Articles are dealt out before the join, which would let Spark drop a sort right below it.
    met = runs.select(*key, "_list", F.explode("_ids").alias("id"), "direct", "indirect").join(dealt.repartition(tasks, *key).hint("shuffle_hash"), key)
    met = met.select("id", F.get("_lists", "_list").alias("_accounts"), "direct", "indirect")
    return met.select("id", F.explode("_accounts").alias("account_id"), "direct", "indirect")


def filter_articles(articles: DataFrame, now: Column, mode: str = "all", own: DataFrame | None = None) -> DataFrame:
    """Articles published by now, of one view: all, mine, a ticker, or a topic."""
    rows = articles.where(F.col("published_at") <= now)
    if mode == "mine":
        # An article is of interest if it names any held ticker; its accounts are not formed.
        held = own.select(exposure(F.col("ticker")).alias("target")).distinct()
        none = F.array().cast(EMPTY)
        named = F.concat(F.coalesce("direct_tickers", none), F.coalesce("related_tickers", none))
        mine = rows.select("id", F.explode(named).alias("target")).join(held, "target", "left_semi").select("id").distinct()
        return rows.join(mine, "id", "left_semi")
    if mode in MEMORY_TICKERS:
        return rows.where(F.array_contains("direct_tickers", mode))
    if mode == "memory":
        return rows.where((F.col("topic") == "memory") | F.arrays_overlap("direct_tickers", _texts(list(MEMORY_TICKERS))))
    return rows if mode == "all" else rows.where(F.col("topic") == mode)


def weekly_groups(articles: DataFrame, own: DataFrame, now: Column) -> DataFrame:
    """Last seven days by topic: count, own tickers, subjects."""
    week = articles.where(F.col("published_at").between(now - F.expr("INTERVAL 7 DAYS"), now))
    counts = week.groupBy("topic").agg(F.count(F.lit(1)).alias("articles"))
    subjects = week.select("topic", F.explode("subjects").alias("s")).distinct().groupBy("topic").agg(F.sort_array(F.collect_list("s")).alias("subjects"))
    named = week.select("topic", F.explode(F.concat("direct_tickers", "related_tickers")).alias("ticker")).distinct()
    mine = named.join(own.select("ticker").distinct(), "ticker", "left_semi").groupBy("topic").agg(F.sort_array(F.collect_list("ticker")).alias("own_tickers"))
    none = F.array().cast(EMPTY)
    return counts.join(subjects, "topic", "left").join(mine, "topic", "left").select(
        "topic", "articles", F.coalesce("own_tickers", none).alias("own_tickers"), F.coalesce("subjects", none).alias("subjects")
    )


def novelty(articles: DataFrame, previous: DataFrame | None, checked_at: Column) -> DataFrame:
    """first_check, new, late_old, updated or known against the previous capture (key, version)."""
    key = F.coalesce(article_key(F.col("url")), F.col("id").cast("string"))
    rows = articles.withColumn("key", key)
    if previous is None:
        return rows.withColumn("novelty", F.lit("first_check"))
    rows = rows.join(previous.select("key", F.col("version").alias("_v"), F.lit(True).alias("_known")), "key", "left")
    state = (
        F.when(F.col("_known").isNull() & (F.col("published_at") < checked_at - F.expr("INTERVAL 7 DAYS")), "late_old")
        .when(F.col("_known").isNull(), "new")
        .when(~F.col("version").eqNullSafe(F.col("_v")), "updated")
        .otherwise("known")
    )
    return rows.withColumn("novelty", state).drop("_v", "_known")


def feed_health(feeds: DataFrame, now: Column) -> DataFrame:
    """One row: ok only if every source is ok and the check is at most eight hours old."""
    checked = F.max("checked_at")
    state = (
        F.when(F.count(F.when(F.col("status") == "ok", 1)) == 0, "failed")
        .when(F.count(F.when(F.col("status") != "ok", 1)) > 0, "partial")
        .when(checked.isNull() | (checked < now - F.expr("INTERVAL 8 HOURS")) | (checked > now), "outdated")
        .otherwise("ok")
    )
    return feeds.agg(state.alias("health"))


def summary_queue(articles: DataFrame, now: Column, limit: int = 4) -> DataFrame:
    """Next articles to summarise: one leader per lead source, then by source, importance, date.

    articles: id, source_id, importance, published_at, brief_status, brief_checked_at.
    """
    recent = articles.where(F.col("published_at") >= now - F.expr("INTERVAL 45 DAYS"))
    order = F.struct(F.col("source_id").isin(*PRIORITY_SOURCES).alias("a"), (F.col("importance") == "high").alias("b"), F.col("published_at").alias("c"), F.col("id").alias("d"))
    leaders = recent.where(F.col("source_id").isin(*LEADER_SOURCES)).groupBy("source_id").agg(F.max_by("id", order).alias("id"))
    rows = recent.join(leaders.select("id", F.lit(True).alias("_lead")), "id", "left")
    open_ = F.coalesce(F.col("brief_status") != "ready", F.lit(True)) & F.coalesce(
        F.col("brief_checked_at") <= now - F.expr("INTERVAL 6 HOURS"), F.lit(True)
    )
    lead_rank = F.lit(len(LEADER_SOURCES))
    for i, name in enumerate(LEADER_SOURCES):
        lead_rank = F.when(F.coalesce("_lead", F.lit(False)) & (F.col("source_id") == name), i).otherwise(lead_rank)
    return rows.where(open_).orderBy(lead_rank, F.desc(order["a"]), F.desc(order["b"]), F.desc("published_at"), F.desc("id")).limit(limit).drop("_lead")


def rank_sentences(docs: DataFrame, per_doc: int = 3, budget: int = 170) -> DataFrame:
    """Up to three sentences per document within a word budget: the first usable one, then by score.

    docs: doc_id, title, body. Sentences are ranked per document after the length and
    boilerplate filters; the whole body is read.
    """
    terms = F.array_except(
        F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0))),
        _texts(["announces", "company", "corporation"]),
    )
    rows = docs.select("doc_id", terms.alias("terms"), F.posexplode(F.split("body", r"(?<=[.!?])\s+")).alias("i", "raw"))
    rows = rows.withColumn("sentence", F.trim(F.regexp_replace("raw", r"\s+", " ")))
    rows = rows.withColumn("words", F.size(F.split("sentence", " "))).where(
        F.col("words").between(12, 90) & ~F.col("sentence").rlike(BOILERPLATE)
    )
    low = F.lower("sentence")
    hits = F.size(F.filter("terms", lambda t: F.contains(low, t)))
    score = hits + F.when(F.col("sentence").rlike(FACT_WORDS), 4).otherwise(0) + F.greatest(F.lit(0.0), 4 - F.col("i") / 3)
    rows = rows.select("doc_id", "i", "sentence", "words", score.alias("score"))
    first = rows.groupBy("doc_id").agg(F.min("i").alias("_i0"))
    # Greedy budget over a per-document list of light (score, position, words) entries.
    entry = F.struct((-F.col("score")).alias("s"), F.col("i"), F.col("words").alias("w"))
    lists = rows.join(first, "doc_id").groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("i") != F.col("_i0"), entry))).alias("rest"),
        F.max(F.when(F.col("i") == F.col("_i0"), F.struct("i", "words"))).alias("lead"),
    )
    start = F.struct(F.array(F.col("lead")["i"]).alias("ids"), F.col("lead")["words"].alias("w"))

    def take(acc, e):
        fits = (F.size(acc["ids"]) < per_doc) & (acc["w"] + e["w"] <= budget)
        return F.when(fits, F.struct(F.concat(acc["ids"], F.array(e["i"])).alias("ids"), (acc["w"] + e["w"]).alias("w"))).otherwise(acc)

    chosen = lists.select("doc_id", F.explode(F.aggregate("rest", start, take)["ids"]).alias("i"))
    return rows.join(chosen, ["doc_id", "i"])


def check_brief(briefs: DataFrame) -> DataFrame:
    """First rule a summary breaks, NULL when it is acceptable.

    briefs: headline, summary, evidence, body. Script, repetition, length and evidence that must
    appear in the body.
    """
    japanese = "[ぁ-んァ-ン一-龥]"

    def bad_text(name: str, limit: int) -> Column:
        c = F.coalesce(F.col(name), F.lit(""))
        return F.coalesce(
            F.when(~F.length(c).between(8, limit) | ~c.rlike(japanese), "invalid_japanese"), F.when(c.rlike(r"(.{2,20})\1{3,}"), "repeated_output")
        )

    ev = F.trim(F.regexp_replace(F.coalesce("evidence", F.lit("")), r"\s+", " "))
    unsupported = F.when((F.length(F.coalesce("evidence", F.lit(""))) < 20) | ~F.contains(F.col("body"), ev), "unsupported_evidence")
    return briefs.withColumn("reason", F.coalesce(bad_text("headline", 120), bad_text("summary", 600), unsupported))


def symbol_search(listings: DataFrame, queries: DataFrame, k: int = 12, most: int = BROADCAST_QUERIES) -> DataFrame:
    """Top matches per query: exact symbol, symbol prefix, then anything containing it.

    Queries are few and short (what users typed); they are matched by trigram so that a listing
    meets only queries sharing one, and short queries by symbol prefix. Up to `most` distinct queries
    are broadcast, so that only hits are shuffled and not every gram of every listing.
    """
    q = cut_lineage(queries.select("query", search_key(F.col("query")).alias("_q")).where(F.col("_q") != "").distinct())
    text = search_key(F.concat_ws(" ", "symbol", "name"))
    parts = int(listings.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a listing has about a hundred grams
    rows = listings.select("id", "symbol", "exchange", "name").repartition(parts, "id").select("id", "symbol", "exchange", text.alias("_text"))
    # First trigram of the query against every trigram of the listing; shorter queries against 1- and 2-grams.
    n_of = lambda c: F.least(F.length(c), F.lit(3))

    def grams(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length("_text") - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.substring(F.col("_text"), i, F.lit(n)))

    parts = F.flatten(F.array(grams(1), grams(2), grams(3)))
    left = rows.withColumn("_g", F.explode(F.array_distinct(parts)))
    right = q.withColumn("_g", F.substring(F.col("_q"), F.lit(1), n_of(F.col("_q"))))
    if q.count() <= most:
        right = F.broadcast(right)
    hits = left.join(right, "_g").where(F.contains("_text", F.col("_q")))
    tier = F.when(F.col("symbol") == F.col("_q"), 0).when(F.col("symbol").startswith(F.col("_q")), 1).otherwise(2)
    w = Window.partitionBy("query").orderBy("tier", "symbol", "exchange", "id")
    # Pre-rank per (query, slice) so that a very common query never sorts in one task.
    part = Window.partitionBy("query", "_slice").orderBy("tier", "symbol", "exchange", "id")
    hits = hits.select("query", "id", "symbol", "exchange", tier.alias("tier"), F.pmod(F.xxhash64("id"), F.lit(64)).alias("_slice"))
    hits = hits.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= k)
    return hits.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k).drop("_slice", "_r", "tier")


def page_text(pages: DataFrame, minimum: int = 450) -> DataFrame:
    """Longest body of a page, whole, without scripts, navigation and the like; NULL with a reason otherwise."""
    html = F.regexp_replace("html", r"(?is)<(script|style|nav|footer|header|aside|form)\b.*?</\1\s*>", " ")
    html = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    blocks = F.concat(
        F.regexp_extract_all(html, F.lit(r"(?is)<(article|main)\b[^>]*>(.*?)</\1\s*>"), F.lit(2)), F.regexp_extract_all(html, F.lit(r"(?is)<body\b[^>]*>(.*?)</body\s*>"), F.lit(1))
    )
    rows = pages.withColumn("_blocks", F.transform(blocks, lambda b: strip_html(b)))
    longest = F.aggregate("_blocks", F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))
    rows = rows.withColumn("_text", longest).drop("_blocks")
    bad = (F.length("_text") < minimum) | F.col("_text").rlike(BLOCKED_PAGE)
    return rows.withColumn("reason", F.when(bad, "article_body_unavailable")).withColumn("body", F.when(~bad, F.col("_text"))).drop("_text")
