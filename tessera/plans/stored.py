"""Queries over what Spark stored before: materialised views."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators import fulltext
from tessera.plans.catalog import query
from tessera.sources import snapshots
from tessera.sources.tables import read_csv, read_index, table, write_csv, write_json


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below the cluster's checkpoint folder, or on one machine a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "tessera-checkpoints")
    return f"{root.rstrip('/')}/tessera-core/{name}-{uuid.uuid4().hex}"


@query(
    """
    SELECT c_custkey, c_nationkey, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS total, max(CAST(o_orderdate AS DATE)) AS last_order
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2
    """
)
def customer_view(spark, sf_dir):
    """A view of customers, materialised from their older orders and refreshed for those who ordered since."""
    customers, orders = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    new = F.col("o_orderdate") >= F.lit("2000-01-01")

    def build(who, bought):
        joined = who.join(bought, F.col("o_custkey") == F.col("c_custkey"), "left")
        total = F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2)
        return joined.groupBy("c_custkey", "c_nationkey").agg(F.count("o_orderkey").alias("orders"), total.alias("total"), F.max(F.col("o_orderdate").cast("date")).alias("last_order"))

    root = shared_folder(spark, "customer-view")
    snapshots.publish(build(customers, orders.where(~new)), root, "c_custkey", buckets=16)
    touched = orders.where(new).select(F.col("o_custkey").alias("c_custkey"))
    snapshots.refresh(spark, root, touched, lambda keys: build(customers.join(keys, "c_custkey", "left_semi"), orders.join(keys.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", "left_semi")))
    return snapshots.read(spark, root)


@query("SELECT doc_id, lang, source, text, n_chars FROM documents")
def documents_by_csv(spark, sf_dir):
    """Documents, whose texts run over lines, written as CSV and read again."""
    folder = shared_folder(spark, "documents-csv")
    write_csv(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text", "n_chars"), folder)
    return read_csv(spark, folder, "doc_id long, lang string, source string, text string, n_chars long")


@query("SELECT page_id, url, html, octet_length(encode(html)) AS n_bytes FROM pages")
def pages_by_json(spark, sf_dir):
    """Pages written as JSON lines and read again."""
    folder = shared_folder(spark, "pages-json")
    write_json(table(spark, sf_dir, "pages").select("page_id", "url", "html", F.octet_length("html").cast("long").alias("n_bytes")), folder)
    return spark.read.schema("page_id long, url string, html string, n_bytes long").json(folder)


@query(
    """
    SELECT o_orderpriority AS form_type, 'Customer ' || o_custkey AS company, CAST(o_custkey AS VARCHAR) AS entity_number, CAST(o_orderdate AS DATE) AS filed, 'edgar/data/' || o_custkey || '/' || o_orderkey || '.txt' AS file
    FROM orders
    """
)
def order_index(spark, sf_dir):
    """A daily index in fixed columns, written from the orders after a heading and a dashed line, and read."""
    folder = shared_folder(spark, "order-index")
    o = table(spark, sf_dir, "orders")
    who = F.col("o_custkey").cast("string")
    day = F.when(F.col("o_custkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    file = F.concat(F.lit("edgar/data/"), who, F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".txt"))
    lines = o.select(F.concat(F.rpad("o_orderpriority", 20, " "), F.rpad(F.concat(F.lit("Customer "), who), 40, " "), F.rpad(who, 16, " "), day, F.lit("  "), file).alias("value"))
    head = spark.createDataFrame([("Form Type   Company Name   CIK   Date Filed  File Name",), ("-" * 60,), ("",)], "value string")
    lines.unionByName(head).write.text(folder)
    return read_index(spark, folder)


@query(
    r"""
    WITH d AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, source, text FROM documents),
    w AS (
        SELECT doc_id, 1.0 AS weight, unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}]+')) AS word FROM d
        UNION ALL SELECT doc_id, 0.4, unnest(regexp_extract_all(lower(source), '[\p{L}\p{N}]+')) FROM d
        UNION ALL SELECT doc_id, 0.2, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) FROM d
    )
    SELECT doc_id AS id, round(sum(weight), 6) AS score FROM w WHERE word IN ('the', 'or', 'src3', 'la') GROUP BY 1 ORDER BY score DESC, id LIMIT 25
    """
)
def best_documents(spark, sf_dir):
    """The 25 best documents (a top-k report) for four words, in an index of their first lines, sources and texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"), "source", "text")
    folder = shared_folder(spark, "full-text")
    fulltext.build(docs, folder, "doc_id", {"title": 1.0, "source": 0.4, "text": 0.2})
    return fulltext.search(spark, folder, "the or src3 La", 25)[0]
