"""Registered queries of the corpus operators, and comparison SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, filter_audit, html_text, licenses, packing, quality_rules, simhash_dedup, substring_dedup, suffix_dedup, token_counts, toxicity, weak_labels, whitening
from tidemark.llm.common import table

QUERIES, ORACLES = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts, _ = quality_rules.host_quality(table(spark, sf_dir, "documents"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op8_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeated_windows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLES["op8_window_dedup"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, p, array_to_string(list_slice(ws, p, p + 12), ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM d WHERE len(ws) >= 13)),
gone AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS m FROM w) WHERE doc_id > m),
cut AS (SELECT DISTINCT doc_id, p + k AS p FROM gone, (SELECT unnest(range(0, 13)) AS k)),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS w FROM d),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN cut USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

_RULES = {
    "few_words": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "capitals": "2 * n_upper > word_chars",
}


def _op7_sql() -> str:
    each = list(_RULES.items())
    failures = ", ".join(f"count(*) FILTER ({c})::DOUBLE AS f_{r}" for r, c in each)
    means = ", ".join(f"sum(f_{r}) / sum(n) AS m_{r}" for r, _ in each)
    between = ", ".join(f"sum(n * (f_{r} / n - m_{r}) ** 2) / sum(n) - any_value(m_{r} * (1 - m_{r})) * count(*) / sum(n) AS b_{r}" for r, _ in each)
    weights = ", ".join(f"CASE WHEN b_{r} > 0 THEN least(1e6, greatest(1, m_{r} * (1 - m_{r}) / b_{r} - 1)) ELSE 1e6 END AS w_{r}" for r, _ in each)
    rates = ", ".join(f"(f_{r} + m_{r} * w_{r}) / (n + w_{r})" for r, _ in each)
    fails = " OR ".join(f"({c})" for _, c in each)
    return f"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
g AS (SELECT doc_id, p, array_to_string(list_slice(ws, p, p + 4), ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS p FROM t WHERE len(ws) >= 5)),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p + k) AS n_repeat_words FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
m AS (SELECT t.doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
             len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM t LEFT JOIN cov USING (doc_id)),
h AS (SELECT source, count(*)::DOUBLE AS n, {failures} FROM m GROUP BY source),
a AS (SELECT {means} FROM h),
b AS (SELECT any_value(COLUMNS('m_.*')), {between} FROM h, a),
p AS (SELECT *, {weights} FROM b),
v AS (SELECT source, greatest({rates}) > 0.5 AS host_failed FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, NOT ({fails}) AND NOT host_failed AS kept
FROM m JOIN v ON m.source IS NOT DISTINCT FROM v.source"""


ORACLES["op7_host_rules"] = _op7_sql()


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.cached_counts(table(spark, sf_dir, "documents"))


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op4_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


_NOTICE_ROWS = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in licenses.NOTICES)
_PLAIN = """list_filter(regexp_split_to_array(translate(lower(coalesce({c}, '')), '.,;:!?"''()[]{{}}', ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"""

ORACLES["op10_licenses"] = f"""
WITH n(license, notice) AS (VALUES {_NOTICE_ROWS}),
nw AS (SELECT license, {_PLAIN.format(c="notice")} AS ws FROM n),
ns AS (SELECT DISTINCT license, array_to_string(list_slice(ws, p, p + 2), ' ') AS g FROM (SELECT license, ws, unnest(range(1, len(ws) - 1)) AS p FROM nw)),
sz AS (SELECT license, count(*) AS n_shingles, CASE WHEN count(*) <= 16 THEN 16 WHEN count(*) <= 64 THEN 64 ELSE 256 END AS step FROM ns GROUP BY license),
k AS (SELECT license, g, n_shingles, step FROM ns JOIN sz USING (license)),
dw AS (SELECT doc_id, {_PLAIN.format(c="text")} AS ws FROM documents),
ds AS (SELECT doc_id, p - 1 AS pos, array_to_string(list_slice(ws, p, p + 2), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM dw WHERE len(ws) >= 3)),
m AS (SELECT DISTINCT doc_id, license, n_shingles, g, pos // step - s AS win FROM ds JOIN k USING (g), (SELECT unnest([0, 1]) AS s)),
c AS (SELECT doc_id, license, win, n_shingles, count(*) AS n FROM m GROUP BY ALL)
SELECT doc_id, license, max(n)::BIGINT AS n_shared, any_value(n_shingles)::BIGINT AS n_shingles FROM c WHERE n >= 0.8 * n_shingles GROUP BY doc_id, license"""


@query
def op12_compression_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


ORACLES["op13_filter_audit"] = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
f AS (SELECT doc_id, part,
             (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
             + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
             + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS mask FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
fail AS (SELECT filter_order, step, mask, mask & (1 << (ascii(filter_order[step]) - 65)) > 0 AS fails, mask = (1 << (ascii(filter_order[step]) - 65)) AS only_this
         FROM s, (SELECT DISTINCT mask FROM m)),
w AS (SELECT filter_order, mask, coalesce(min(step) FILTER (fails), 9) AS gone FROM fail GROUP BY ALL),
e AS (SELECT *, filter_order[step] AS letter FROM fail JOIN w USING (filter_order, mask)),
sh AS (SELECT part, letter, sum(n) AS shapley FROM m JOIN e USING (mask) WHERE gone = step GROUP BY ALL),
r AS (SELECT part, filter_order, step, letter, sum(n) FILTER (gone > step) AS kept, sum(n) FILTER (gone = step) AS removed, sum(n) FILTER (fails AND gone < step) AS redundant,
             sum(n) FILTER (only_this) AS unique_fails, sum(good) FILTER (gone = step) AS good_lost, sum(toxic) FILTER (gone = step) AS toxic_lost
      FROM m JOIN e USING (mask) GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(shapley, 0)::BIGINT AS shapley
FROM r LEFT JOIN sh USING (part, letter)"""
