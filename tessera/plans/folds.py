"""Queries whose result depends on the order of rows within a key; SQL has no fold, so tests hold them against plain versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import web
from tessera.operators import newsevents, purchases, rounds, writeplan
from tessera.plans.catalog import query
from tessera.sources.tables import dealt, table

#: Stage that each priority of an order stands for, when orders are taken as rounds.
STAGES = {"1-URGENT": "Seed", "2-HIGH": "Series A", "3-MEDIUM": "Series G", "5-LOW": "Growth"}


def order_rounds(orders):
    """Orders as rounds: customers as companies, priorities as stages, weekdays as leads, months as investors; sums of few cents have no amount or no day."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long") % 100
    stage = F.create_map(*[F.lit(x) for pair in STAGES.items() for x in pair])
    return orders.select(
        F.col("o_custkey").alias("company"), F.col("o_orderkey"), F.col("o_orderstatus"), F.try_element_at(stage, F.col("o_orderpriority")).alias("round_type"),
        F.when(cents >= 15, F.col("o_totalprice")).alias("amount"), F.when(cents >= 95, F.col("o_totalprice") * 5).alias("valuation"), F.when((cents < 5) | (cents >= 25), F.col("o_orderdate").cast("date")).alias("announced"),
        F.when(cents >= 40, F.date_format("o_orderdate", "EEEE")).alias("lead"), F.lit(None).cast("string").alias("source_url"), F.array(F.date_format("o_orderdate", "MMMM")).alias("investors"),
    )


@query()
def round_writes(spark, sf_dir):
    """Plan of writes when finished orders are the rounds on file and all others arrive in order of their keys."""
    given = order_rounds(dealt(table(spark, sf_dir, "orders")))
    finished = F.col("o_orderstatus") == "F"
    on_file, found = given.where(finished).withColumnRenamed("o_orderkey", "id"), given.where(~finished).withColumnRenamed("o_orderkey", "seq")
    plan = writeplan.plan_round_writes(on_file, found)
    return plan.withColumn("investors", F.array_join("investors", ", "))


def page_news(pages):
    """Pages as news: hosts' domains as companies, titles as headlines; the number in an address gives the day and, in English ones, a sum."""
    number = F.nullif(F.regexp_extract("url", r"/(\d+)/?(?:[?#]|$)", 1), F.lit("")).cast("int")
    raised = F.when(F.col("url").contains("/en/"), F.concat(F.lit(" raises $"), (number % 40).cast("string"), F.lit("M"))).otherwise("")
    return pages.select(
        web.registrable_domain(F.col("url")).alias("company"), F.col("page_id").alias("seq"), F.concat(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1), F.coalesce(raised, F.lit(""))).alias("title"), "url",
        F.when(number % 10 > 0, F.date_add(F.lit("2024-01-01").cast("date"), F.floor(number % 900 / 3).cast("int"))).alias("published"), F.substr(web.html_text(F.col("html")), F.lit(1), F.lit(300)).alias("lead"),
    )


@query()
def news_events(spark, sf_dir):
    """One page for each event that pages of a domain report; mobile hosts stand as a company's own site, secure addresses as headlines of the event."""
    url = F.col("url")
    return newsevents.dedupe_news(page_news(dealt(table(spark, sf_dir, "pages").select("page_id", "url", "html"))), own_site=url.contains("://m."), preferred=url.startswith("https"))


def order_purchases(orders):
    """Orders as headlines of purchases: customers as companies, days as the orders', buyers in several spellings by priority and sum."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long") % 100
    company = F.concat(F.lit("Works"), F.col("o_custkey").cast("string"))
    buyer = F.element_at(F.array(*map(F.lit, ["Inworld", "Inworld AI", "Research Lab Inworld", "Żabka Group", "Żabka", "Tyro", "Ox", "Ox Bank"])), (cents % 8 + 1).cast("int"))
    title = (
        F.when(cents < 40, F.concat(buyer, F.lit(" acquires "), company, F.lit(" to grow in Europe")))
        .when(cents < 55, F.concat(buyer, F.lit(" Acquires Controlling Stake In "), company))
        .when(cents < 70, F.concat(company, F.lit(" was acquired by "), buyer))
        .when(cents < 90, F.concat(company, F.lit(" and "), buyer, F.lit(" plan what comes next")))
        .otherwise(F.concat(company, F.lit(" opens an office")))
    )
    return orders.select(
        company.alias("company"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("https://news.example/"), F.col("o_orderkey").cast("string")).alias("url"), title.alias("title"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("date")).alias("day"),
        (F.col("o_orderpriority") != "5-LOW").alias("eligible"), (F.col("o_orderpriority") == "1-URGENT").alias("party"), (F.col("o_orderpriority") == "2-HIGH").alias("by_code"), F.lit("Nothing else. ").alias("content"),
    )


@query()
def purchases_reported(spark, sf_dir):
    """Purchases of customers that their orders, taken as headlines, report."""
    return purchases.purchase_events(order_purchases(dealt(table(spark, sf_dir, "orders"))).drop("content"))


@query()
def purchase_claims(spark, sf_dir):
    """The purchase that stands for each customer by the claims of its articles."""
    return purchases.acquisitions(order_purchases(dealt(table(spark, sf_dir, "orders"))))


@query(
    """
    WITH r AS (
        SELECT o_custkey AS company, o_orderkey AS seq, CAST(round(o_totalprice * 100) AS BIGINT) % 100 AS cents, CAST(o_orderdate AS DATE) AS d, o_totalprice,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'Seed' WHEN '2-HIGH' THEN 'Series A' WHEN '3-MEDIUM' THEN 'Series G' WHEN '5-LOW' THEN 'Growth' ELSE 'Unknown' END AS round_type
        FROM orders
    ),
    x AS (SELECT company, seq, round_type, CASE WHEN cents >= 15 THEN o_totalprice END AS amount, CASE WHEN cents < 5 OR cents >= 25 THEN d END AS day, CASE WHEN cents >= 40 OR cents < 3 THEN dayname(d) END AS lead FROM r),
    met AS (
        SELECT a.company, a.seq AS gone, min(b.seq) AS target, first(a.round_type) AS round_type, first(a.lead) AS lead
        FROM x a JOIN x b ON a.company = b.company AND a.amount IS NULL AND b.amount IS NOT NULL AND abs(date_diff('day', a.day, b.day)) <= 31 GROUP BY 1, 2
    ),
    g AS (SELECT company, target, arg_min(round_type, gone) FILTER (round_type NOT IN ('Other', 'Unknown')) AS round_type, arg_min(lead, gone) FILTER (lead <> '') AS lead FROM met GROUP BY 1, 2)
    SELECT x.company, x.seq, CASE WHEN x.round_type IN ('Other', 'Unknown') THEN coalesce(g.round_type, x.round_type) ELSE x.round_type END AS round_type, x.amount, x.day, coalesce(x.lead, g.lead) AS lead
    FROM x LEFT JOIN g ON g.company = x.company AND g.target = x.seq WHERE NOT EXISTS (SELECT 1 FROM met WHERE met.company = x.company AND met.gone = x.seq)
    """
)
def rounds_with_amounts(spark, sf_dir):
    """Orders as rounds, those without an amount put into the one of their month that has it."""
    o = table(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long") % 100
    r = order_rounds(o).select(
        "company", F.col("o_orderkey").alias("seq"), F.coalesce("round_type", F.lit("Unknown")).alias("round_type"), "amount", F.col("announced").alias("day"),
    ).join(o.select(F.col("o_orderkey").alias("seq"), F.when((cents >= 40) | (cents < 3), F.date_format("o_orderdate", "EEEE")).alias("lead")), "seq")
    return rounds.absorb_amountless(r).select("company", "seq", "round_type", "amount", "day", "lead")
