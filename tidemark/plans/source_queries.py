"""File readers over files landed from the supplied tables, all rows of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans import views as V
from tidemark.plans.catalog import flat, query
from tidemark.plans.stream_queries import shared_folder
from tidemark.sources import readers as RD


@query("read_dimension", """SELECT CAST(p_partkey AS VARCHAR) AS entity_id, trim(p_name) AS name, CASE WHEN p_partkey % 7 <> 0 THEN trim(p_brand) END AS exchange,
       CASE WHEN p_partkey % 5 <> 0 THEN CAST(DATE '2000-01-01' + CAST(p_partkey % 1000 AS INT) AS VARCHAR) END AS effective_from FROM part""")
def read_dimension(spark, d):
    """Parts as a dimension file with padded, blank and unreadable values."""
    k = F.col("p_partkey")
    day = F.date_add(F.lit("2000-01-01").cast("date"), (k % 1000).cast("int")).cast("string")
    rows = V.table(spark, d, "part").select(
        k.cast("string").alias("entity_id"), F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("name"), F.when(k % 7 == 0, "  ").otherwise(F.col("p_brand")).alias("exchange"),
        F.when(k % 5 == 0, "2000-13-40").otherwise(day).alias("effective_from"),
    )
    path = shared_folder(spark, "dimension")
    rows.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return flat(RD.read_dimension(spark, path))


@query("read_history", """SELECT CAST(DATE '2000-01-01' + CAST(o_custkey % 400 AS INT) AS VARCHAR) AS as_of, '2000-02-03 04:05:06' AS calculated_at,
       CAST(o_orderkey AS VARCHAR) AS theme_id, round(o_totalprice, 2) AS score FROM orders""")
def read_history(spark, d):
    """One snapshot a customer, its orders as the themes."""
    per = V.table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderkey").cast("string").alias("theme_id"), F.col("o_totalprice").alias("score"))).alias("themes"))
    rows = per.select(F.date_add(F.lit("2000-01-01").cast("date"), (F.col("o_custkey") % 400).cast("int")).alias("as_of"), F.lit("2000-02-03T04:05:06Z").alias("calculated_at"), "themes")
    path = shared_folder(spark, "history")
    rows.write.json(path)
    return flat(RD.read_history(spark, path, "theme_id:string,score:double").drop("pos"), 2)


@query("read_ledger_csv", """SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, round(o_totalprice, 2) AS amount_jpy,
       CASE WHEN o_orderkey % 2 = 0 THEN 'deposit' ELSE 'withdrawal' END AS type, CASE WHEN o_orderkey % 3 = 0 THEN 'a, "quoted" note' END AS note FROM orders""")
def read_ledger_csv(spark, d):
    """Orders as a strict flows file."""
    k = F.col("o_orderkey")
    rows = V.table(spark, d, "orders").select(
        k.cast("string").alias("id"), F.to_date("o_orderdate").cast("string").alias("date"), F.lit("").alias("timestamp"), F.col("o_totalprice").cast("string").alias("amount_jpy"),
        F.when(k % 2 == 0, "deposit").otherwise("withdrawal").alias("type"), F.when(k % 3 == 0, 'a, "quoted" note').otherwise("").alias("note"),
    )
    path = shared_folder(spark, "ledger")
    rows.write.csv(path, header=True, escape='"')
    return flat(RD.read_ledger_csv(spark, path, "flows").select("id", "date", "amount_jpy", "type", "note"), 2)
