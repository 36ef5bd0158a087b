"""Landed files and payload tables into typed frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import FX_STALE_DAYS
from tidemark.functions.scoring import finite, positive
from tidemark.functions.text import canonical_url, strip_html
from tidemark.functions.validity import clean, parse_date, parse_utc
from tidemark.operators.keyed import keep_latest

SYMBOL = r"^[A-Z0-9.^=-]{1,20}$"
BAR_FIELDS = "array<struct<datetime:string,close:string,volume:string>>"
PAYLOAD = f"status string, code string, meta struct<symbol:string,interval:string,currency:string,exchange:string>, values {BAR_FIELDS}"


def read_dimension(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every value trimmed, blank as NULL; a byte-order mark is tolerated."""
    raw = spark.read.csv(path, header=True, escape='"')
    cols = [clean(F.col(f"`{c}`")).alias(c.lstrip("﻿").strip()) for c in raw.columns]
    out = raw.select(*cols)
    for c in ("effective_from", "effective_to"):
        if c in out.columns:
            out = out.withColumn(c, parse_date(F.col(c)))
    return out


def read_history(spark: SparkSession, path: str, theme_schema: str) -> DataFrame:
    """JSON lines, one snapshot per line, to one row per (as_of, theme)."""
    raw = spark.read.schema(f"as_of date, calculated_at string, themes array<struct<{theme_schema}>>").json(path)
    return raw.select("as_of", parse_utc(F.col("calculated_at")).alias("calculated_at"), F.posexplode("themes").alias("pos", "t")).select(
        "as_of", "calculated_at", "pos", "t.*"
    )


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def price_rows(raw: DataFrame) -> DataFrame:
    """(ticker, body) payloads to one row per landed bar, in payload order."""
    doc = F.from_json("body", PAYLOAD)
    return raw.select("ticker", doc.alias("d")).select(
        "ticker", F.col("d.status").alias("status"), F.col("d.code").alias("code"), F.col("d.meta").alias("meta"), F.posexplode_outer("d.values").alias("pos", "v")
    ).select(
        "ticker", "status", "code", "meta", "pos", F.col("v.datetime").alias("datetime"),
        finite(F.col("v.close").try_cast("double")).alias("close"), finite(F.col("v.volume").try_cast("double")).alias("volume"), F.col("v.close").alias("_raw"),
    )


def parse_price_payload(raw: DataFrame) -> DataFrame:
    """Lenient: unreadable numbers are NULL, rows without date or close drop, last row per date wins."""
    rows = price_rows(raw).where(F.coalesce(F.col("status") != "error", F.lit(True)))
    rows = rows.withColumn("session", parse_date(F.substring("datetime", 1, 10))).where(F.col("session").isNotNull() & F.col("close").isNotNull())
    return keep_latest(rows.select("ticker", "session", "close", "volume", "pos"), ["ticker", "session"], [F.col("pos")]).drop("pos")


def parse_price_payload_strict(raw: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Bars of documents that pass every check, and (ticker, reason) of the others."""
    rows = price_rows(raw).withColumn("session", parse_date(F.col("datetime")))
    per = rows.groupBy("ticker").agg(
        F.first("status").alias("status"), F.first("code").alias("code"), F.first("meta").alias("m"), F.count("pos").alias("n"),
        F.countDistinct("session").alias("days"), F.max("session").alias("last"), F.max((F.col("pos").isNotNull() & F.col("session").isNull())).alias("bad_date"),
        F.max(F.col("pos").isNotNull() & ~positive(F.col("close"))).alias("bad_price"), F.max((F.col("session") == as_of)).alias("has_as_of"),
    )
    meta_ok = (F.col("m.symbol") == F.col("ticker")) & (F.col("m.interval") == "1day") & (F.col("m.currency") == "USD") & clean(F.col("m.exchange")).isNotNull()
    reason = F.coalesce(
        F.when(F.col("code") == "429", "rate_limited"),
        F.when(~F.col("status").eqNullSafe("ok"), "unavailable"),
        F.when(~F.coalesce(meta_ok, F.lit(False)), "identity_or_currency_mismatch"),
        F.when(F.col("bad_date"), "invalid_date"),
        F.when(F.col("last") > as_of, "unclosed_bar"),
        F.when(F.col("bad_price"), "invalid_price"),
        F.when(F.col("days") < F.col("n"), "duplicate_bar"),
        F.when(~F.coalesce("has_as_of", F.lit(False)), "stale_prices"),
    )
    verdict = per.select("ticker", reason.alias("reason"))
    good = rows.join(verdict.where(F.col("reason").isNull()), "ticker", "left_semi")
    bars = good.select("ticker", "session", "close", F.when(F.col("volume") >= 0, F.col("volume")).alias("volume"))
    return bars, verdict.where(F.col("reason").isNotNull())


def parse_vix_csv(raw: DataFrame, today: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Lines of either published layout to (keys, source, date, close); last line per date wins.

    raw: source, pos, day, value, and `keys` where several markets are read at once. Sources with
    fewer than two valid dates give nothing.
    """
    day = F.coalesce(parse_date(F.col("day")), F.when(F.col("day").rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(F.col("day"), "M/d/yyyy")))
    rows = raw.select(*keys, "source", "pos", day.alias("date"), finite(clean(F.col("value")).try_cast("double")).alias("close"))
    rows = rows.where((F.col("date") <= today) & (F.col("close") > 0))
    last = rows.groupBy(*keys, "source", "date").agg(F.max_by("close", "pos").alias("close"))
    enough = last.groupBy(*keys, "source").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2)
    return last.join(enough, [*keys, "source"], "left_semi")


def choose_latest_source(vix: DataFrame, order: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Newest close among sources with the one before it, one row per `keys`; ties go to the earlier source in `order`, then to the smaller name."""
    rank = F.lit(len(order))
    for i, s in enumerate(order):
        rank = F.when(F.col("source") == s, i).otherwise(rank)
    # Two newest dates per source are enough: max, then max below it.
    top = vix.groupBy(*keys, "source").agg(F.max("date").alias("as_of"))
    rows = vix.join(top, [*keys, "source"])
    per = rows.groupBy(*keys, "source", "as_of").agg(
        F.max_by("close", "date").alias("close"), F.max(F.when(F.col("date") < F.col("as_of"), F.struct("date", "close"))).alias("p")
    )
    found = F.struct("source", "as_of", "close", F.col("p.date").alias("previous_as_of"), F.col("p.close").alias("previous_close"))
    best = per.groupBy(*keys).agg(F.min_by(found, F.struct(F.datediff(F.lit("1970-01-01"), "as_of").alias("d"), rank.alias("r"), "source")).alias("x"))
    return best.where("x is not null").select(*keys, "x.*")


def normalize_fx(raw: DataFrame, as_of: Column, now: Column, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(keys, pair, status, interval, date, rate) rows to completed daily rates, and rejected pairs with a reason.

    `keys` name the feed where several are read at once; each feed's pair is judged on its own.
    """
    cutoff = F.least(as_of, F.date_sub(F.to_date(now), 1))
    rows = raw.withColumn("day", parse_date(F.col("date"))).withColumn("value", finite(F.col("rate").try_cast("double")))
    per = rows.groupBy(*keys, "pair").agg(
        (F.min(F.col("status") == "ok") & F.min(F.col("interval") == "1day") & (F.max("pair") == "USD/JPY")).alias("identity"),
        F.count(F.lit(1)).alias("n"), F.countDistinct("day").alias("days"), F.min(positive(F.col("value"))).alias("valid"),
        F.max(F.when(F.col("day") <= cutoff, F.col("day"))).alias("last"),
    )
    reason = F.coalesce(
        F.when(~F.coalesce("identity", F.lit(False)), "fx_identity_mismatch"), F.when(F.col("days") < F.col("n"), "duplicate_fx_date"),
        F.when(~F.col("valid"), "invalid_fx_rate"), F.when(F.col("last").isNull() | (F.datediff(cutoff, "last") > FX_STALE_DAYS), "stale_fx"),
    )
    verdict = per.select(*keys, "pair", reason.alias("reason"))
    good = rows.join(verdict.where(F.col("reason").isNull()), [*keys, "pair"], "left_semi").where(F.col("day") <= cutoff)
    return good.select(*keys, "pair", F.col("day").alias("date"), F.col("value").alias("rate")), verdict.where(F.col("reason").isNotNull())


def normalize_listings(raw: DataFrame, funds: bool = False) -> DataFrame:
    """Listings keyed symbol|venue|country, last row wins. raw also carries `pos` (input order)."""
    symbol, name, exchange = F.upper(clean(F.col("symbol"))), clean(F.col("name")), clean(F.col("exchange"))
    mic, country = clean(F.col("mic_code")), F.coalesce(F.col("country"), F.lit(""))
    rows = raw.select(
        F.concat_ws("|", symbol, F.coalesce(mic, exchange), country).alias("id"), symbol.alias("symbol"), name.alias("name"), exchange.alias("exchange"),
        mic.alias("mic_code"), country.alias("country"), F.coalesce(F.col("currency"), F.lit("")).alias("currency"), "pos",
    ).where(symbol.rlike(SYMBOL) & F.col("name").isNotNull() & F.col("exchange").isNotNull())
    if funds:
        rows = rows.where((F.col("country") == "United States") & (F.col("currency") == "USD"))
    return keep_latest(rows, ["id"], [F.col("pos")]).drop("pos")


def complete_listing(listings: DataFrame, floor: int, sentinel: str) -> DataFrame:
    """One row: may this listing replace the published one (size floor and a symbol it must hold)."""
    return listings.agg(
        ((F.count(F.lit(1)) >= floor) & F.coalesce(F.max(F.col("symbol") == sentinel), F.lit(False))).alias("complete"), F.count(F.lit(1)).alias("rows"),
    )


_TAG = r"(?is)<(?:[a-z0-9]+:)?{0}\b[^>]*>(.*?)</(?:[a-z0-9]+:)?{0}\s*>"


def _field(item: Column, *names: str) -> Column:
    found = [F.nullif(F.trim(F.regexp_extract(item, _TAG.format(n), 1)), F.lit("")) for n in names]
    return F.coalesce(*found)


def _unwrap(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")


#: Zone names of mail dates and their offsets; fixed values.
MAIL_ZONES = {
    "UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}


def mail_date(text: Column) -> Column:
    """Mail-style date (weekday and seconds optional, zone by offset or name) as a moment; else NULL."""
    bare = F.regexp_replace(text, r"^\s*[A-Za-z]{3},\s*", "")
    name = F.upper(F.regexp_extract(bare, r"\s([A-Za-z]{1,4})\s*$", 1))
    offset = F.create_map(*[F.lit(x) for pair in MAIL_ZONES.items() for x in pair])[name]
    whole = F.when(offset.isNotNull(), F.concat(F.regexp_replace(bare, r"\s[A-Za-z]{1,4}\s*$", " "), offset)).otherwise(F.trim(bare))
    return F.coalesce(*[F.try_to_timestamp(whole, F.lit(f"d MMM yyyy HH:mm{seconds} Z")) for seconds in (":ss", "")])


def resolve_links(rows: DataFrame) -> DataFrame:
    """`link` as seen from the page `base_url`: relative forms are completed, dot segments taken out.

    A plain-http link to the base's own host becomes https. Without a base, relative links stay as
    they are. Done in three projections, so that no step's expression is repeated inside the next.
    """
    link, base = F.col("link"), F.col("base_url")
    absolute, origin = r"^[A-Za-z][A-Za-z0-9+.-]*:", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"
    site, scheme = F.regexp_extract(base, origin, 1), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    page = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(page == site, F.concat(site, F.lit("/"))).otherwise(F.regexp_replace(page, r"[^/]*$", ""))
    joined = (
        F.when(link.rlike(absolute), link).when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(page, link)).when((link == "") | link.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), link)).otherwise(F.concat(folder, link))
    )
    first = rows.withColumn("_whole", F.coalesce(joined, link))
    whole = F.col("_whole")
    head, tail = F.regexp_extract(whole, origin, 1), F.regexp_extract(whole, r"([?#].*)$", 1)
    path = F.regexp_extract(whole, origin + r"([^?#]*)", 2)
    steps = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(x == ".", done).otherwise(F.concat(done, F.array(x))),
    )
    closed = F.when(path.rlike(r"/\.\.?$"), F.concat(F.array_join(steps, "/"), F.lit("/"))).otherwise(F.array_join(steps, "/"))
    clear = F.when((head != "") & path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(head, closed, tail)).otherwise(whole)
    second = first.withColumn("_clear", clear)
    clear = F.col("_clear")
    own = F.lower(F.regexp_extract(clear, r"(?i)^http://([^/?#]*)", 1))
    host = F.lower(F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return second.withColumn("link", F.when((own != "") & (own == host), F.regexp_replace(clear, r"^(?i)http:", "https:")).otherwise(clear)).drop("_whole", "_clear")


def read_feed_xml(raw: DataFrame, now: Column, items: int | None = None) -> DataFrame:
    """RSS, Atom and RDF feeds (source_id, xml, and base_url where known) to articles of the last 90 days.

    All entries are read, or the first `items` if that is given; entity and document-type
    declarations reject the whole feed. Links are resolved against base_url.
    """
    safe = raw.where(~F.col("xml").rlike("(?i)<!(?:DOCTYPE|ENTITY)"))
    found = F.regexp_extract_all("xml", F.lit(r"(?is)<((?:[a-z0-9]+:)?(?:item|entry))\b[^>]*>.*?</\1\s*>"), F.lit(0))
    base = F.col("base_url") if "base_url" in raw.columns else F.lit(None).cast("string")
    rows = safe.select("source_id", base.alias("base_url"), F.posexplode(F.slice(found, 1, items) if items else found).alias("pos", "item"))
    alternate = F.coalesce(
        F.nullif(F.regexp_extract("item", r'(?is)<link\b(?=[^>]*rel="alternate")[^>]*href="([^"]+)"', 1), F.lit("")),
        F.nullif(F.regexp_extract("item", r'(?is)<link\b(?![^>]*rel=)[^>]*href="([^"]+)"', 1), F.lit("")),
    )
    link = strip_html(_unwrap(F.coalesce(alternate, _field(F.col("item"), "link"))))
    stamp = _field(F.col("item"), "pubDate", "published", "updated", "date")
    rfc = mail_date(F.col("stamp"))
    zoned = F.when(F.col("stamp").rlike(r"T.*(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp("stamp"))
    fields = rows.select(
        "source_id", "pos", "base_url", strip_html(_unwrap(_field(F.col("item"), "title"))).alias("title"), link.alias("link"), stamp.alias("stamp")
    )
    known = resolve_links(fields) if "base_url" in raw.columns else fields
    # A filter on projected columns is pushed below them with every pattern copied into it; one on a generator's output is not.
    article = F.struct("source_id", "pos", "title", canonical_url(F.col("link")).alias("url"), F.coalesce(rfc, zoned).alias("published_at"))
    out = known.select(F.inline(F.array(article)))
    window = F.col("published_at").between(now - F.expr("INTERVAL 90 DAYS"), now + F.expr("INTERVAL 5 MINUTES"))
    return out.where((F.col("title") != "") & F.col("url").isNotNull() & window).withColumn("id", F.substring(F.sha2("url", 256), 1, 20))


def read_archive(spark: SparkSession, root: str, category: str) -> DataFrame:
    """JSON-lines tree of one category; `valid` tells whether the record hash matches its payload."""
    raw = spark.read.schema("record_id string, payload string").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").json(f"{root}/{category}")
    path = F.col("_metadata.file_path")
    return raw.select(
        F.regexp_extract(path, rf"({category}/.*)$", 1).alias("reference"), "record_id", "payload", (F.sha2("payload", 256) == F.col("record_id")).alias("valid"),
    )


LEDGER_LAYOUTS = {
    "snapshots": "date string, timestamp string, assets_jpy string, valuation_basis string, status string",
    "flows": "id string, date string, timestamp string, amount_jpy string, type string, note string",
}


def read_ledger_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Strict ledger file: exact header, readable amount, full rows; anything else fails the read."""
    layout = LEDGER_LAYOUTS[kind]
    names = [c.strip().split()[0] for c in layout.split(",")]
    raw = spark.read.csv(path, header=True, schema=layout, enforceSchema=False, mode="FAILFAST", escape='"')
    amount = "assets_jpy" if kind == "snapshots" else "amount_jpy"
    value = finite(clean(F.col(amount)).try_cast("double"))
    checked = F.when(value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit("unreadable amount: "), F.coalesce(F.col(amount), F.lit("")))).cast("double"))
    return raw.select(
        *[checked.alias(c) if c == amount else (parse_date(F.col(c)) if c == "date" else clean(F.col(c))).alias(c) for c in names]
    )
