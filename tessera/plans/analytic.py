"""Question patterns of an analyst: latest child, ratios, quartiles, gaps, windows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import relational as ops
from tessera.plans.catalog import query
from tessera.sources.tables import table


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))


@query(
    """
    SELECT c_custkey, round(coalesce((SELECT o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1), 0), 2) AS latest_price FROM customer WHERE c_mktsegment = 'BUILDING'
    """
)
def latest_or_default(spark, sf_dir):
    """A correlated top-1 with a default, as one aggregation."""
    latest = _orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("p"))
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return c.join(latest, "c_custkey", "left").select("c_custkey", F.round(F.coalesce("p", F.lit(0.0)), 2).alias("latest_price"))


@query(
    """
    WITH q AS (SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS v FROM orders GROUP BY 1)
    SELECT o_custkey, round(v, 2) AS v, ntile(4) OVER (ORDER BY v, o_custkey) AS quartile FROM q
    """
)
def latest_quartile(spark, sf_dir):
    """Quartile of each one's latest value; the ranking is over one row per customer."""
    q = _orders(spark, sf_dir).groupBy("o_custkey").agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("v"))
    return q.select("o_custkey", F.round("v", 2).alias("v"), F.ntile(4).over(W.orderBy("v", "o_custkey")).alias("quartile"))


@query(
    """
    SELECT n_name, c_custkey, total, place FROM (
      SELECT n_name, c_custkey, round(sum(o_totalprice), 2) AS total, rank() OVER (PARTITION BY n_name ORDER BY round(sum(o_totalprice), 2) DESC) AS place
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) WHERE place <= 5
    """
)
def top_per_country(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_orders(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
    totals = joined.groupBy("n_name", "c_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return totals.withColumn("place", F.rank().over(W.partitionBy("n_name").orderBy(F.desc("total")))).where("place <= 5")


@query(
    """
    WITH g AS (SELECT o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) - lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS gap FROM orders)
    SELECT o_orderpriority, count(gap) AS n, round(avg(gap), 4) AS mean_gap, max(gap) AS longest FROM g GROUP BY 1
    """
)
def average_interval(spark, sf_dir):
    """Mean days since the one before, by kind."""
    gap = F.datediff("day", F.lag("day").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).cast("long")
    return _orders(spark, sf_dir).select("o_orderpriority", gap.alias("gap")).groupBy("o_orderpriority").agg(F.count("gap").alias("n"), F.round(F.avg("gap"), 4).alias("mean_gap"), F.max("gap").alias("longest"))


@query(
    """
    WITH a AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders WHERE o_orderdate >= DATE '2000-04-01' AND o_orderdate < DATE '2000-06-30' GROUP BY 1),
    b AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders WHERE o_orderdate >= DATE '2000-01-02' AND o_orderdate < DATE '2000-04-01' GROUP BY 1)
    SELECT a.o_custkey, round(a.v, 2) AS this_window, round(b.v, 2) AS last_window, round((a.v - b.v) / nullif(b.v, 0), 4) AS change FROM a JOIN b USING (o_custkey)
    """
)
def two_windows(spark, sf_dir):
    """Two 90-day windows beside each other: one pass with conditional sums."""
    now, before = F.col("day") >= F.lit("2000-04-01").cast("date"), F.col("day") < F.lit("2000-04-01").cast("date")
    within = _orders(spark, sf_dir).where("day >= DATE '2000-01-02' AND day < DATE '2000-06-30'")
    sums = within.groupBy("o_custkey").agg(F.sum(F.when(now, F.col("o_totalprice"))).alias("a"), F.sum(F.when(before, F.col("o_totalprice"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return sums.select("o_custkey", F.round("a", 2).alias("this_window"), F.round("b", 2).alias("last_window"), F.round(F.try_divide(F.col("a") - F.col("b"), F.col("b")), 4).alias("change"))


@query(
    """
    SELECT n_name, count(c_custkey) AS customers, count(DISTINCT o_custkey) AS buyers, round(count(DISTINCT o_custkey) * 1.0 / nullif(count(DISTINCT c_custkey), 0), 4) AS share
    FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 300000) ON o_custkey = c_custkey GROUP BY n_name
    """
)
def safe_ratio(spark, sf_dir):
    buyers = _orders(spark, sf_dir).where("o_totalprice > 300000").select("o_custkey").distinct()
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(buyers, F.col("o_custkey") == F.col("c_custkey"), "left")
    out = joined.groupBy("n_name").agg(F.count("c_custkey").alias("customers"), F.countDistinct("o_custkey").alias("buyers"), F.countDistinct("c_custkey").alias("_all"))
    return out.select("n_name", "customers", "buyers", F.round(F.try_divide("buyers", "_all"), 4).alias("share"))


@query(
    """
    SELECT p_brand, p_type, count(*) AS n, round(avg(p_retailprice), 4) AS mean FROM part GROUP BY 1, 2 HAVING count(*) >= 3 AND avg(p_retailprice) > (SELECT avg(p_retailprice) FROM part)
    """
)
def above_average_groups(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    mean = part.agg(F.avg("p_retailprice").alias("whole"))
    groups = part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("m")).where("n >= 3")
    return groups.crossJoin(F.broadcast(mean)).where("m > whole").select("p_brand", "p_type", "n", F.round("m", 4).alias("mean"))


@query(
    """
    SELECT a.o_custkey, a.o_orderkey AS first_key, b.o_orderkey AS other_key FROM orders a JOIN orders b
      ON a.o_custkey = b.o_custkey AND CAST(a.o_orderdate AS DATE) = CAST(b.o_orderdate AS DATE) AND a.o_orderkey < b.o_orderkey AND a.o_orderstatus IS DISTINCT FROM b.o_orderstatus
    """
)
def reconcile(spark, sf_dir):
    """Rows of one customer and day that disagree on a value."""
    a = _orders(spark, sf_dir).select("o_custkey", "day", F.col("o_orderkey").alias("first_key"), F.col("o_orderstatus").alias("x"))
    b = _orders(spark, sf_dir).select("o_custkey", "day", F.col("o_orderkey").alias("other_key"), F.col("o_orderstatus").alias("y"))
    return a.join(b, ["o_custkey", "day"]).where((F.col("first_key") < F.col("other_key")) & ~F.col("x").eqNullSafe(F.col("y"))).select("o_custkey", "first_key", "other_key")


@query(
    """
    SELECT c_custkey, c_name FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE o_orderkey IS NULL
    """
)
def without_children(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(_orders(spark, sf_dir).where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query(
    """
    WITH t AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS tags FROM orders GROUP BY 1)
    SELECT o_custkey, array_to_string(tags, ',') AS tags, list_contains(tags, '1-URGENT') AS has_urgent, list_has_any(tags, ['4-NOT SPECIFIED', '5-LOW']) AS overlaps, list_has_all(tags, ['1-URGENT', '2-HIGH']) AS holds_both FROM t
    """
)
def array_predicates(spark, sf_dir):
    """Contains, overlaps and holds all, on arrays."""
    t = _orders(spark, sf_dir).groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("t"))
    both = F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))
    return t.select("o_custkey", F.array_join("t", ",").alias("tags"), F.array_contains("t", "1-URGENT").alias("has_urgent"), F.arrays_overlap("t", F.array(F.lit("4-NOT SPECIFIED"), F.lit("5-LOW"))).alias("overlaps"), (F.size(F.array_except(both, "t")) == 0).alias("holds_both"))


@query(
    """
    SELECT r_name, n_name, customers, round(revenue, 2) AS revenue, round(100 * revenue / sum(revenue) OVER (PARTITION BY r_name), 4) AS share_pct FROM (
      SELECT r_name, n_name, count(DISTINCT c_custkey) AS customers, sum(l_extendedprice * (1 - l_discount)) AS revenue
      FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2)
    """
)
def revenue_by_region(spark, sf_dir):
    """Five-way join with an aggregate and its share of a window."""
    j = (
        table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
        .join(_orders(spark, sf_dir).select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
        .join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
        .join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    )
    g = j.groupBy("r_name", "n_name").agg(F.countDistinct("c_custkey").alias("customers"), F.sum("v").alias("revenue"))
    return g.select("r_name", "n_name", "customers", F.round("revenue", 2).alias("revenue"), F.round(100 * F.col("revenue") / F.sum("revenue").over(W.partitionBy("r_name")), 4).alias("share_pct"))


@query(
    """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
           round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2
    """
)
def pricing_summary(spark, sf_dir):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.sum(price), 2).alias("sum_disc"),
        F.round(F.sum(price * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


@query(
    """
    WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(o_orderdate, DATE '1970-01-01') DESC, o_orderkey DESC) AS n FROM orders)
    SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY n) AS last_three FROM r WHERE n <= 3 GROUP BY 1
    """
)
def last_three(spark, sf_dir):
    """The three newest children of each, in order."""
    newest = ops.first_per(_orders(spark, sf_dir), ["o_custkey"], [F.desc(F.coalesce("o_orderdate", F.lit("1970-01-01").cast("timestamp_ntz"))), F.desc("o_orderkey")], 3)
    g = newest.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey")), asc=False).alias("x"))
    return g.select("o_custkey", F.array_join(F.transform("x", lambda v: v["o_orderkey"].cast("string")), ",").alias("last_three"))
