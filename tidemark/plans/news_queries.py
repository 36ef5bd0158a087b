"""Articles, pages and search over documents, pages and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as TX
from tidemark.operators import news as N
from tidemark.operators.keyed import cut_lineage
from tidemark.plans import views as V
from tidemark.plans.catalog import flat, query
from tidemark.plans.views import kept, with_views

NOW = "2024-03-01 12:00:00"
PREFIXES = [
    "HBM memory results:", "Company to report earnings", "Not a deal:", "Export restrictions on DRAM", "New NAND SSD launch", "Optical transceivers showcase",
    "TSMC foundry capacity expansion", "Board of directors appoints", "Dividend and buyback", "Data center power and cooling", "Ventures partnership for GPU",
    "MLPerf benchmark qualification", '"Inside view of the yearly plan" — Announcement about the coming year and much more', "GeForce NOW chips",
]


def _now():
    return F.to_timestamp(F.lit(NOW))


@kept
def sources(spark, d):
    s = V.table(spark, d, "documents").select("source").distinct()
    n = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    ids = F.when(n == 0, "micron").when(n == 1, "skhynix").when(n == 2, "nvidia").otherwise(F.col("source"))
    topics = F.element_at(F.array(*[F.lit(t) for t in N.TOPIC_TICKERS]), n % 6 + 1)
    tickers = F.when(n % 3 == 0, F.array(F.lit("MU"))).when(n % 3 == 1, F.array(F.lit("NVDA"), F.lit("TSM"))).otherwise(F.array().cast("array<string>"))
    return s.select(ids.alias("source_id"), topics.alias("topic"), tickers.alias("tickers"), (n % 4 == 3).alias("require_keywords"))


@kept
def articles(spark, d):
    doc = V.table(spark, d, "documents")
    k = F.col("doc_id")
    words = F.element_at(F.split("text", r"\n"), 1)
    prefix = F.element_at(F.array(*[F.lit(p) for p in PREFIXES]), (k % len(PREFIXES) + 1).cast("int"))
    n = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    back = F.expr("make_dt_interval(cast(doc_id % 100 as int), cast(doc_id % 24 as int))")
    return doc.select(
        k.alias("id"), F.concat_ws(" ", prefix, F.regexp_replace(words, "[^A-Za-z0-9 ]", "")).alias("title"),
        F.concat(F.lit("https://News.Example.com/a/"), (k % 300).cast("string"), F.lit("/?utm_source=x&id="), (k % 7).cast("string"), F.lit("&ref=r#top")).alias("url"),
        (_now() - back).alias("published_at"), F.when(n == 0, "micron").when(n == 1, "skhynix").when(n == 2, "nvidia").otherwise(F.col("source")).alias("source_id"),
        (_now() - back + F.expr("INTERVAL 2 HOURS")).alias("first_seen_at"),
    )


def _classified(spark, d):
    return N.classify_event(articles(spark, d), sources(spark, d))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(xs) -> str:
    return "CAST([" + ", ".join(_q(x) for x in xs) + "] AS VARCHAR[])"


def _first(rules, x: str, flags: str = "") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {_q(flags + p)}) THEN {_q(n)}" for n, p in rules) + " END"


_SUBJECTS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(title, {_q('(?i)' + p)}) THEN {_q(n)} END" for n, p in N.SUBJECT_WORDS) + "], lambda x: x IS NOT NULL)[1:2]"
_ID = "CASE WHEN n = 0 THEN 'micron' WHEN n = 1 THEN 'skhynix' WHEN n = 2 THEN 'nvidia' ELSE source END"
_NEWS = {
    "feeds": f"""SELECT {_ID} AS source_id, {_list(N.TOPIC_TICKERS)}[n % 6 + 1] AS topic, CASE WHEN n % 3 = 0 THEN ['MU'] WHEN n % 3 = 1 THEN ['NVDA', 'TSM'] ELSE CAST([] AS VARCHAR[]) END AS tickers,
                       n % 4 = 3 AS req FROM (SELECT DISTINCT source, CAST(regexp_extract(source, '(\\d+)', 1) AS INT) AS n FROM documents)""",
    "arts": f"""SELECT doc_id AS id, {_list(PREFIXES)}[doc_id % {len(PREFIXES)} + 1] || ' ' || regexp_replace(string_split(text, chr(10))[1], '[^A-Za-z0-9 ]', '', 'g') AS title,
                      'https://news.example.com/a/' || doc_id % 300 || '?id=' || doc_id % 7 AS link, TIMESTAMP '{NOW}' - CAST(doc_id % 100 AS INT) * INTERVAL '1 day' - CAST(doc_id % 24 AS INT) * INTERVAL '1 hour' AS pub,
                      {_ID} AS source_id FROM (SELECT *, CAST(regexp_extract(source, '(\\d+)', 1) AS INT) AS n FROM documents)""",
    "cls0": f"""SELECT a.*, f.tickers, coalesce({_first(N.TOPIC_WORDS, 'lower(title)')}, f.topic) AS topic, coalesce({_first(N.EVENT_WORDS, 'lower(title)')}, 'other') AS event, {_SUBJECTS} AS subjects
                FROM arts a JOIN feeds f USING (source_id)""",
    "cls": f"""SELECT *, list_filter(CASE WHEN event IN ('calendar', 'governance', 'capital_return') THEN CAST([] AS VARCHAR[]) WHEN list_contains(subjects, '{N.POWER}') THEN {_list(N.POWER_TICKERS)}
                      {' '.join(f"WHEN topic = {_q(t)} THEN {_list(v)}" for t, v in N.TOPIC_TICKERS.items())} END, lambda x: NOT list_contains(tickers, x)) AS related,
                      CASE WHEN event IN {N.HIGH_EVENTS} THEN 'high' ELSE 'normal' END AS importance FROM cls0""",
    "keyed": r"""SELECT *, regexp_replace(lower(title), '[^\p{L}\p{N}]', '', 'g') AS tk,
                     regexp_replace(lower(regexp_replace(title, '^(?:“[^”]{3,180}”|"[^"]{3,180}")\s*[—–:]\s*', '')), '[^\p{L}\p{N}]', '', 'g') AS ek FROM arts""",
    "own": "SELECT DISTINCT account_id, ticker, CASE ticker WHEN 'MUU' THEN 'MU' WHEN 'NVDL' THEN 'NVDA' ELSE ticker END AS target FROM (SELECT c_custkey AS account_id, ['MU', 'MUU', 'NVDL', 'TSM', 'ASML'][c_custkey % 5 + 1] AS ticker FROM customer)",
}


def _own(spark, d):
    c = V.table(spark, d, "customer")
    names = F.array(*[F.lit(t) for t in ("MU", "MUU", "NVDL", "TSM", "ASML")])
    return c.select(F.col("c_custkey").alias("account_id"), F.element_at(names, (F.col("c_custkey") % 5 + 1).cast("int")).alias("ticker"))


@query("relevant", with_views(f"SELECT id FROM arts JOIN feeds USING (source_id) WHERE (NOT req OR regexp_matches(title, {_q(N.KEYWORDS)})) AND NOT (source_id = 'nvidia' AND regexp_matches(title, '(?i)geforce now'))", _NEWS))
def relevant(spark, d):
    rows = articles(spark, d).join(sources(spark, d), "source_id")
    return rows.where(N.relevant(F.col("title"), F.col("source_id"), F.col("require_keywords"))).select("id")


@query("context_labels", with_views("SELECT id, array_to_string(subjects, ',') AS subjects FROM cls0", _NEWS))
def context_labels(spark, d):
    return flat(articles(spark, d).select("id", N.context_labels(F.col("title")).alias("subjects")))


@query("classify_event", with_views("SELECT id, topic, event, importance, array_to_string(tickers, ',') AS direct_tickers, array_to_string(related, ',') AS related_tickers FROM cls", _NEWS))
def classify_event(spark, d):
    return flat(_classified(spark, d).select("id", "topic", "event", "importance", "direct_tickers", "related_tickers"))


_MERGE = """SELECT id, title FROM (SELECT *, row_number() OVER (PARTITION BY tk ORDER BY pub DESC, id DESC) AS k FROM keyed
            WHERE pub BETWEEN TIMESTAMP '2024-03-01 12:00:00' - INTERVAL '90 days' AND TIMESTAMP '2024-03-01 12:05:00') WHERE k = 1"""


@query("merge_articles", with_views(_MERGE + "", _NEWS))
def merge_articles(spark, d):
    a = articles(spark, d).drop("url")
    old = a.where(F.col("id") % 2 == 0).withColumn("title", F.concat(F.lit("old "), F.col("title")))
    return N.merge_articles(old.unionByName(a.limit(0)), a, _now()).select("id", "title")


@query("dedupe_articles", with_views(
    """SELECT k.id FROM walk w JOIN ordered k USING (rn) WHERE w.kept""",
    {
        **_NEWS,
        "ordered": r"""SELECT id, row_number() OVER (ORDER BY pub DESC, id) AS rn, list_filter(['u' || link, CASE WHEN tk <> '' THEN 't' || tk END,
                         CASE WHEN length(ek) >= 48 THEN 'a' || source_id || '|' || CAST(CAST(pub AS DATE) AS VARCHAR) || '|' || ek || '|' || array_to_string(regexp_extract_all(title, '\d+(?:[.,]\d+)*'), '|') END], lambda x: x IS NOT NULL) AS keys
                       FROM keyed""",
        "walk": """RECURSIVE(rn, seen, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), FALSE
                   UNION ALL SELECT o.rn, CASE WHEN list_has_any(w.seen, o.keys) THEN w.seen ELSE list_concat(w.seen, o.keys) END, NOT list_has_any(w.seen, o.keys)
                   FROM walk w JOIN ordered o ON o.rn = w.rn + 1)""",
    },
))
def dedupe_articles(spark, d):
    return N.dedupe_articles(articles(spark, d)).select("id")


_REL = {
    **_NEWS,
    "pairs": """SELECT a.id, o.account_id, o.ticker, max(a.d) AS d FROM (SELECT id, unnest(tickers) AS target, 1 AS d FROM cls UNION ALL SELECT id, unnest(related), 0 FROM cls) a
                JOIN own o USING (target) GROUP BY 1, 2, 3""",
}


@query("relate_to_holdings", with_views("SELECT id, account_id, coalesce(string_agg(CASE WHEN d = 1 THEN ticker END, ',' ORDER BY ticker), '') AS direct, coalesce(string_agg(CASE WHEN d = 0 THEN ticker END, ',' ORDER BY ticker), '') AS indirect FROM pairs GROUP BY 1, 2", _REL))
def relate_to_holdings(spark, d):
    return flat(N.relate_to_holdings(_classified(spark, d), _own(spark, d), text=True))


@query("filter_articles", with_views(
    """SELECT 'all' AS mode, count(*) AS n FROM cls UNION ALL SELECT 'mine', count(DISTINCT id) FROM pairs UNION ALL SELECT 'MU', count(*) FROM cls WHERE list_contains(tickers, 'MU')
       UNION ALL SELECT 'memory', count(*) FROM cls WHERE topic = 'memory' OR list_contains(tickers, 'MU') UNION ALL SELECT 'optical', count(*) FROM cls WHERE topic = 'optical'""", _REL))
def filter_articles(spark, d):
    """Sizes of the views, one of them for the tickers of all accounts."""
    own, out = _own(spark, d), None
    # Five views read the classified articles: they are classified once.
    a = cut_lineage(_classified(spark, d).select("id", "published_at", "topic", "direct_tickers", "related_tickers"))
    for mode in ("all", "mine", "MU", "memory", "optical"):
        one = N.filter_articles(a, _now(), mode, own).agg(F.count(F.lit(1)).alias("n")).select(F.lit(mode).alias("mode"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("weekly_groups", with_views(
    f"""SELECT w.topic, w.articles, coalesce(o.t, '') AS own_tickers, coalesce(s.s, '') AS subjects
        FROM (SELECT topic, count(*) AS articles FROM cls WHERE pub BETWEEN TIMESTAMP '{NOW}' - INTERVAL '7 days' AND TIMESTAMP '{NOW}' GROUP BY 1) w
        LEFT JOIN (SELECT topic, string_agg(DISTINCT s, ',' ORDER BY s) AS s FROM (SELECT topic, unnest(subjects) AS s FROM cls WHERE pub >= TIMESTAMP '{NOW}' - INTERVAL '7 days') GROUP BY 1) s USING (topic)
        LEFT JOIN (SELECT topic, string_agg(DISTINCT t, ',' ORDER BY t) AS t FROM (SELECT topic, unnest(list_concat(tickers, related)) AS t FROM cls WHERE pub >= TIMESTAMP '{NOW}' - INTERVAL '7 days')
                   WHERE t IN (SELECT ticker FROM own) GROUP BY 1) o USING (topic)""", _NEWS))
def weekly_groups(spark, d):
    return flat(N.weekly_groups(_classified(spark, d), _own(spark, d), _now()))


@query("novelty", with_views(
    """SELECT id, CASE WHEN v IS NULL AND pub < TIMESTAMP '2024-02-01' - INTERVAL '7 days' THEN 'late_old' WHEN v IS NULL THEN 'new' WHEN v <> vn THEN 'updated' ELSE 'known' END AS novelty
       FROM (SELECT a.*, title AS vn, p.v FROM arts a LEFT JOIN (SELECT link, max(CASE WHEN id % 4 = 0 THEN title || '!' ELSE title END) AS v FROM arts WHERE id % 3 = 0 GROUP BY 1) p USING (link))""", _NEWS))
def novelty(spark, d):
    a = articles(spark, d).withColumn("version", F.col("title"))
    key = TX.article_key(F.col("url"))
    prev = a.where(F.col("id") % 3 == 0).groupBy(key.alias("key")).agg(F.max(F.when(F.col("id") % 4 == 0, F.concat("version", F.lit("!"))).otherwise(F.col("version"))).alias("version"))
    return N.novelty(a, prev, F.to_timestamp(F.lit("2024-02-01 00:00:00"))).select("id", "novelty")


def _feeds(spark, d):
    doc = V.table(spark, d, "documents")
    return doc.groupBy("source").agg(F.when(F.max("n_chars") > 20000, "failed").otherwise("ok").alias("status")).withColumn("checked_at", _now() - F.expr("INTERVAL 2 HOURS"))


@query("feed_health", """SELECT CASE WHEN count(CASE WHEN m <= 20000 THEN 1 END) = 0 THEN 'failed' WHEN count(CASE WHEN m > 20000 THEN 1 END) > 0 THEN 'partial' ELSE 'ok' END AS health
                         FROM (SELECT source, max(n_chars) AS m FROM documents GROUP BY 1)""")
def feed_health(spark, d):
    return N.feed_health(_feeds(spark, d), _now())


@query("feed_status", """SELECT CASE WHEN ok = n THEN 'ok' WHEN ok > 0 THEN 'partial' ELSE 'failed' END AS status, n AS sources, ok AS ok_sources FROM (SELECT count(*) AS n, count(CASE WHEN m <= 20000 THEN 1 END) AS ok
                         FROM (SELECT source, max(n_chars) AS m FROM documents GROUP BY 1))""")
def feed_status(spark, d):
    return N.feed_status(_feeds(spark, d))


@query("summary_queue", with_views(
    f"""SELECT id FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY source_id ORDER BY importance = 'high' DESC, pub DESC, id DESC) = 1 THEN
                          CASE source_id WHEN 'micron' THEN 0 WHEN 'skhynix' THEN 1 WHEN 'sandisk' THEN 2 ELSE 3 END ELSE 3 END AS lead FROM cls WHERE pub >= TIMESTAMP '{NOW}' - INTERVAL '45 days')
        WHERE id % 5 <> 0 AND (id % 3 <> 0 OR id % 12 >= 6) ORDER BY lead, source_id IN ('micron', 'skhynix', 'sandisk', 'samsung') DESC, importance = 'high' DESC, pub DESC, id DESC LIMIT 20""", _NEWS))
def summary_queue(spark, d):
    k = F.col("id")
    a = _classified(spark, d).withColumn("brief_status", F.when(k % 5 == 0, "ready").otherwise("pending")).withColumn(
        "brief_checked_at", F.when(k % 3 == 0, _now() - F.expr("make_dt_interval(0, cast(id % 12 as int))"))
    )
    return N.summary_queue(a, _now(), 20).select("id")


_SENT = {
    "raws": r"""SELECT doc_id, text, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS raw, generate_subscripts(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) - 1 AS i,
                       regexp_extract_all(lower(string_split(text, chr(10))[1]), '[a-z]{4,}') AS tt FROM documents""",
    "sents": rf"""SELECT doc_id, i, s, len(string_split(s, ' ')) AS w, len(list_filter(list_distinct(tt), lambda t: t NOT IN ('announces', 'company', 'corporation') AND contains(lower(s), t)))
                        + CASE WHEN regexp_matches(s, {_q(N.FACT_WORDS)}) THEN 4 ELSE 0 END + greatest(0.0, 4 - i / 3) AS sc
                 FROM (SELECT *, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS s FROM raws)""",
    "usable": f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM sents WHERE w BETWEEN 12 AND 90 AND NOT regexp_matches(s, {_q(N.BOILERPLATE)})",
    "cand": "SELECT u.*, f.w AS w0, row_number() OVER (PARTITION BY u.doc_id ORDER BY u.sc DESC, u.i) AS o FROM usable u JOIN usable f ON f.doc_id = u.doc_id AND f.pos = 1 WHERE u.pos > 1",
    "second": "SELECT doc_id, min({'o': o, 'i': i, 'w': w}) AS m FROM cand WHERE w0 + w <= 170 GROUP BY 1",
    "third": "SELECT c.doc_id, min({'o': c.o, 'i': c.i, 'w': c.w}) AS m FROM cand c JOIN second s ON s.doc_id = c.doc_id AND c.o > s.m.o AND c.w0 + s.m.w + c.w <= 170 GROUP BY 1",
}


@query("rank_sentences", with_views(
    "SELECT doc_id, i FROM usable WHERE pos = 1 UNION ALL SELECT doc_id, m.i FROM second UNION ALL SELECT doc_id, m.i FROM third", _SENT))
def rank_sentences(spark, d):
    doc = V.table(spark, d, "documents")
    title = F.element_at(F.split("text", r"\n"), 1)
    return flat(N.rank_sentences(doc.select("doc_id", title.alias("title"), F.col("text").alias("body"))).select("doc_id", "i"))


@query("check_brief", r"""SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'invalid_japanese' WHEN doc_id % 4 = 2 THEN 'repeated_output'
      WHEN length(ev) < 20 OR (doc_id % 4 = 3) THEN 'unsupported_evidence' END AS reason FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS ev FROM documents)""")
def check_brief(spark, d):
    doc, k = V.table(spark, d, "documents"), F.col("doc_id")
    body = F.trim(F.regexp_replace("text", r"\s+", " "))
    briefs = doc.select(
        "doc_id", F.when(k % 4 == 1, "plain text only").otherwise("メモリ価格の見通しを公表").alias("headline"),
        F.when(k % 4 == 2, "売上売上売上売上売上売上 見通し").otherwise("売上と見通しを公表しました").alias("summary"),
        F.when(k % 4 == 3, F.concat(body, F.lit(" and something else"))).otherwise(body).alias("evidence"), body.alias("body"),
    )
    return N.check_brief(briefs).select("doc_id", "reason")


_SK = r"regexp_replace(upper({}), '[\s・･ー.\-]', '', 'g')"


@query("symbol_search", f"""WITH l AS (SELECT p_partkey AS id, upper(replace(p_brand, '#', '')) || p_size AS symbol, p_name AS name, p_type AS exchange FROM part),
  q AS (SELECT DISTINCT query FROM (SELECT string_split(p_name, ' ')[1] AS query FROM part UNION ALL SELECT replace(p_brand, '#', '') FROM part UNION ALL SELECT CAST(p_size AS VARCHAR) FROM part))
SELECT query, id, position FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN symbol = k THEN 0 WHEN starts_with(symbol, k) THEN 1 ELSE 2 END, symbol, exchange, id) AS position
  FROM (SELECT l.*, query, {_SK.format('query')} AS k FROM l, q) WHERE contains({_SK.format("symbol || ' ' || name")}, k)) WHERE position <= 12""")
def symbol_search(spark, d):
    p = V.table(spark, d, "part")
    brand = F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))
    listings = p.select(F.col("p_partkey").alias("id"), F.concat(F.upper(brand), F.col("p_size").cast("string")).alias("symbol"), F.col("p_name").alias("name"), F.col("p_type").alias("exchange"))
    asked = p.select(F.explode(F.array(F.element_at(F.split("p_name", " "), 1), brand, F.col("p_size").cast("string"))).alias("query"))
    return flat(N.symbol_search(listings, asked).select("query", "id", "position"))


def _tags_removed(x: str) -> str:
    for t in ("script", "style", "nav", "footer", "header", "aside", "form"):
        x = f"regexp_replace({x}, '(?is)<{t}\\b.*?</{t}\\s*>', ' ', 'g')"
    return f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"


def _stripped(x: str) -> str:
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for n, c in TX.ENTITIES:
        x = f"replace({x}, {_q(n)}, {_q(c)})"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


@query("page_text", f"""SELECT page_id, CASE WHEN bad THEN 'article_body_unavailable' END AS reason, CASE WHEN bad THEN NULL ELSE md5(t) END AS body_hash
  FROM (SELECT *, length(t) < 450 OR regexp_matches(t, {_q(N.BLOCKED_PAGE)}) AS bad FROM (
    SELECT page_id, coalesce((SELECT arg_max(s, (length(s), -k)) FROM (SELECT {_stripped('b')} AS s, k FROM (SELECT unnest(bs) AS b, generate_subscripts(bs, 1) AS k))), '') AS t FROM (
      SELECT page_id, list_concat(list_concat(regexp_extract_all(h, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1), regexp_extract_all(h, '(?is)<main\\b[^>]*>(.*?)</main\\s*>', 1)),
                                  regexp_extract_all(h, '(?is)<body\\b[^>]*>(.*?)</body\\s*>', 1)) AS bs FROM (SELECT page_id, {_tags_removed('html')} AS h FROM pages))))""")
def page_text(spark, d):
    return N.page_text(V.table(spark, d, "pages")).select("page_id", "reason", F.md5("body").alias("body_hash"))


@query("canonical_url", r"""SELECT page_id, CASE WHEN a <> '' AND NOT contains(a, '@') THEN 'https://' || lower(a) || regexp_replace(p, '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS link
  FROM (SELECT page_id, regexp_extract(u, '(?i)^https://([^/?#]*)', 1) AS a, regexp_extract(u, '(?i)^https://[^/?#]*([^?#]*)', 1) AS p,
               list_filter(string_split(regexp_extract(u, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: regexp_matches(x, '=.') AND NOT regexp_matches(x, '(?i)^(utm_.*|fbclid|gclid)(=|$)')) AS q FROM (SELECT page_id, trim(url) AS u FROM pages))""")
def canonical_url(spark, d):
    return V.table(spark, d, "pages").select("page_id", TX.canonical_url(F.col("url")).alias("link"))


@query("title_key", r"SELECT doc_id, md5(regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g')) AS key FROM documents")
def title_key(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.md5(TX.title_key(F.col("text"))).alias("key"))


@query("title_key_nfkc", r"SELECT doc_id, md5(regexp_replace(lower(nfc_normalize(text)), '[^\p{L}\p{N}]', '', 'g')) AS key FROM documents")
def title_key_nfkc(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.md5(TX.title_key(F.col("text"), normalize=True)).alias("key"))


@query("search_key", f"SELECT p_partkey, {_SK.format('p_name')} AS key FROM part")
def search_key(spark, d):
    return V.table(spark, d, "part").select("p_partkey", TX.search_key(F.col("p_name")).alias("key"))


@query("strip_html", f"SELECT page_id, md5({_stripped('html')}) AS text_hash FROM pages")
def strip_html(spark, d):
    return V.table(spark, d, "pages").select("page_id", F.md5(TX.strip_html(F.col("html"))).alias("text_hash"))


@query("exposure", with_views("SELECT account_id, ticker, target FROM own", _NEWS))
def exposure(spark, d):
    return _own(spark, d).select("account_id", "ticker", TX.exposure(F.col("ticker")).alias("target"))
