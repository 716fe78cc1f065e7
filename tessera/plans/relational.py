"""Scans, filters, joins, aggregates, windows and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import keyed
from tessera.operators import relational as ops
from tessera.plans.catalog import query
from tessera.sources.tables import dealt, table

TODAY = "DATE '2001-01-01'"


@query(
    """
    WITH latest AS (
        SELECT o_custkey, o_orderkey AS last_order, CAST(o_orderdate AS DATE) AS last_date, o_orderpriority AS last_priority,
               row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS n
        FROM orders),
    totals AS (SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey)
    SELECT c_custkey, c_name, n_name, r_name, last_order, last_date, last_priority, coalesce(n_orders, 0) AS n_orders, total,
           count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS peer_count,
           CAST((c_name IS NOT NULL AND c_name <> '') AS INT) + CAST(c_mktsegment IS NOT NULL AS INT) + CAST(c_acctbal > 0 AS INT)
             + CAST(last_order IS NOT NULL AS INT) + CAST(coalesce(total, 0) > 100000 AS INT) AS completeness
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN latest l ON l.o_custkey = c_custkey AND l.n = 1
    LEFT JOIN totals t ON t.o_custkey = c_custkey
    """
)
def search_view(spark, sf_dir):
    """Entities with their latest child, totals, peers and completeness: the shape of a search view."""
    orders = table(spark, sf_dir, "orders").withColumn("last_date", F.col("o_orderdate").cast("date"))
    latest = ops.latest_values(orders, ["o_custkey"], F.struct("o_orderdate", "o_orderkey"), ["o_orderkey", "last_date", "o_orderpriority"])
    latest = latest.select("o_custkey", F.col("o_orderkey").alias("last_order"), "last_date", F.col("o_orderpriority").alias("last_priority"))
    totals = orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    joined = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(latest, "o_custkey", "left").join(totals, "o_custkey", "left")
    flags = [
        F.col("c_name").isNotNull() & (F.col("c_name") != ""),
        F.col("c_mktsegment").isNotNull(),
        F.col("c_acctbal") > 0,
        F.col("last_order").isNotNull(),
        F.coalesce("total", F.lit(0.0)) > 100000,
    ]
    return joined.select(
        F.col("o_custkey").alias("c_custkey"), "c_name", "n_name", "r_name", "last_order", "last_date", "last_priority",
        F.coalesce("n_orders", F.lit(0)).alias("n_orders"), "total",
        F.count("*").over(W.partitionBy("c_nationkey", "c_mktsegment")).alias("peer_count"),
        sum((f.cast("int") for f in flags), F.lit(0)).alias("completeness"),
    )


@query(
    """
    SELECT o_orderkey, o_custkey, c_name, round(o_totalprice, 2) AS o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_name ILIKE '%customer%' AND o_totalprice BETWEEN 1000 AND 400000
      AND o_orderdate >= DATE '1997-01-01' AND o_orderstatus IS DISTINCT FROM 'P'
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 80
    """
)
def filter_page(spark, sf_dir):
    """A page of filtered rows in a stable order (the limit is the page)."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    kept = ops.filtered(
        joined,
        {
            "segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY"),
            "name": F.col("c_name").ilike("%customer%"),
            "price": F.col("o_totalprice").between(1000, 400000),
            "since": F.col("o_orderdate") >= F.lit("1997-01-01").cast("date"),
            "status": ~F.col("o_orderstatus").eqNullSafe("P"),
            "unset": None,
        },
    )
    return ops.page(kept, [F.desc("o_totalprice"), F.col("o_orderkey")], 2).select("o_orderkey", "o_custkey", "c_name", F.round("o_totalprice", 2).alias("o_totalprice"))


@query(
    """
    SELECT l_shipmode AS flag, n, rank() OVER (ORDER BY n DESC, l_shipmode) AS place FROM (
        SELECT l_returnflag || '/' || l_linestatus AS l_shipmode, count(*) AS n FROM lineitem GROUP BY 1)
    """
)
def distinct_values(spark, sf_dir):
    """Distinct values with their counts and places."""
    flags = table(spark, sf_dir, "lineitem").groupBy(F.concat_ws("/", "l_returnflag", "l_linestatus").alias("flag")).agg(F.count("*").alias("n"))
    return flags.withColumn("place", F.rank().over(W.orderBy(F.desc("n"), "flag")))


@query(
    """
    SELECT s_suppkey, peer, balance FROM (
        SELECT a.s_suppkey, b.s_suppkey AS peer, round(b.s_acctbal, 2) AS balance,
               row_number() OVER (PARTITION BY a.s_suppkey ORDER BY b.s_acctbal DESC, b.s_suppkey) AS n
        FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey)
    WHERE n <= 3
    """
)
def peers_topn(spark, sf_dir):
    """For each supplier its three largest peers of the same nation.

    The peers of anyone in a nation are among its four largest, so only those
    meet the rest: the join is linear in the rows.
    """
    suppliers = table(spark, sf_dir, "supplier")
    order = [F.desc("s_acctbal"), F.col("s_suppkey")]
    top = ops.first_per(suppliers, ["s_nationkey"], order, 4).select("s_nationkey", F.col("s_suppkey").alias("peer"), F.col("s_acctbal").alias("balance"))
    pairs = suppliers.select("s_nationkey", "s_suppkey").join(top, "s_nationkey").where("s_suppkey != peer")
    return ops.first_per(pairs, ["s_suppkey"], [F.desc("balance"), F.col("peer")], 3).select("s_suppkey", "peer", F.round("balance", 2).alias("balance"))


@query(
    """
    SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS returned,
           count(DISTINCT l_partkey) FILTER (WHERE l_discount > 0.05) AS discounted_parts,
           round(avg(l_extendedprice) FILTER (WHERE l_quantity > 25), 4) AS large_price,
           round(coalesce(sum(l_extendedprice) FILTER (WHERE l_linestatus = 'O'), 0), 2) AS open_value
    FROM lineitem GROUP BY l_suppkey
    """
)
def conditional_counts(spark, sf_dir):
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey")
        .agg(
            F.count("*").alias("n"),
            F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("returned"),
            F.countDistinct(F.when(F.col("l_discount") > 0.05, F.col("l_partkey"))).alias("discounted_parts"),
            F.round(F.avg(F.when(F.col("l_quantity") > 25, F.col("l_extendedprice"))), 4).alias("large_price"),
            F.round(F.coalesce(F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice"))), F.lit(0.0)), 2).alias("open_value"),
        )
    )


@query(
    """
    WITH a AS (SELECT c_nationkey AS k, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer WHERE c_acctbal > 9000 GROUP BY 1)
    SELECT coalesce(a.k, s.s_nationkey) AS nation, a.customers, a.balance, s.s_suppkey, s.s_name
    FROM supplier s FULL OUTER JOIN a ON s.s_nationkey = a.k AND s.s_acctbal > 5000
    WHERE a.k IS NOT NULL OR s.s_acctbal > 5000
    """
)
def full_outer_directory(spark, sf_dir):
    """Full outer join whose condition holds for one side only."""
    a = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    s = table(spark, sf_dir, "supplier")
    joined = s.join(a, (F.col("s_nationkey") == F.col("k")) & (F.col("s_acctbal") > 5000), "full")
    return joined.where(F.col("k").isNotNull() | (F.col("s_acctbal") > 5000)).select(F.coalesce("k", "s_nationkey").alias("nation"), "customers", "balance", "s_suppkey", "s_name")


@query(
    """
    SELECT e.event_id, e.user_id, p.value AS last_purchase
    FROM (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'purchase') e
    ASOF LEFT JOIN (SELECT user_id, ts, max(round(value, 4)) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) p
      ON e.user_id = p.user_id AND e.ts >= p.ts
    """
)
def asof_prev(spark, sf_dir):
    """The value of the user's last purchase at the time of every other event."""
    events = table(spark, sf_dir, "events")
    other = events.where("event_type != 'purchase'").select("event_id", "user_id", "ts")
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought_at"), F.round("value", 4).alias("last_purchase"))
    return ops.as_of(other, bought, ["user_id"], "ts", "bought_at", ["last_purchase"]).select("event_id", "user_id", "last_purchase")


@query(
    """
    WITH m AS (SELECT user_id, ts, max(value) AS value FROM events GROUP BY ALL),
    l AS (SELECT user_id, max(ts) AS at, arg_max(value, ts) AS latest, count(*) AS observations FROM m GROUP BY user_id),
    d1 AS (SELECT l.user_id, max(m.ts) AS seen, arg_max(m.value, m.ts) AS v FROM l JOIN m ON m.user_id = l.user_id
             AND m.ts <= l.at - INTERVAL 20 HOUR AND m.ts >= l.at - INTERVAL 48 HOUR GROUP BY 1),
    d7 AS (SELECT l.user_id, max(m.ts) AS seen, arg_max(m.value, m.ts) AS v FROM l JOIN m ON m.user_id = l.user_id
             AND m.ts <= l.at - INTERVAL 6 DAY AND m.ts >= l.at - INTERVAL 10 DAY GROUP BY 1)
    SELECT l.user_id, l.at, round(l.latest, 4) AS latest, l.observations, round(l.latest - d1.v, 4) AS delta_1d, round(l.latest - d7.v, 4) AS delta_7d,
           round((l.latest - d7.v) / (epoch(l.at - d7.seen) / 86400.0), 4) AS per_day_7d, d1.seen AS compared_1d, d7.seen AS compared_7d
    FROM l LEFT JOIN d1 USING (user_id) LEFT JOIN d7 USING (user_id)
    """
)
def velocity_bounded(spark, sf_dir):
    """Change over about a day and a week; null, not zero, where nothing comparable was observed."""
    metrics = table(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    latest = metrics.groupBy("user_id").agg(F.max("ts").alias("at"), F.max_by("value", "ts").alias("latest"), F.count("*").alias("observations"))
    day = ops.in_window(latest, metrics, "user_id", "at", "ts", ["value"], after="48 HOURS", before="20 HOURS", prefix="d1_")
    week = ops.in_window(day, metrics, "user_id", "at", "ts", ["value"], after="10 DAYS", before="6 DAYS", prefix="d7_")
    days = (F.col("at").cast("timestamp").cast("double") - F.col("d7_at").cast("timestamp").cast("double")) / 86400.0
    return week.select(
        "user_id", "at", F.round("latest", 4).alias("latest"), "observations",
        F.round(F.col("latest") - F.col("d1_value"), 4).alias("delta_1d"),
        F.round(F.col("latest") - F.col("d7_value"), 4).alias("delta_7d"),
        F.round((F.col("latest") - F.col("d7_value")) / days, 4).alias("per_day_7d"),
        F.col("d1_at").alias("compared_1d"), F.col("d7_at").alias("compared_7d"),
    )


@query(
    """
    WITH h AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, max(o_totalprice) AS v FROM orders GROUP BY ALL),
    l AS (SELECT o_custkey, max(day) AS day, arg_max(v, day) AS latest FROM h GROUP BY 1),
    e AS (SELECT l.o_custkey, min(h.day) AS first_day, arg_min(h.v, h.day) AS earliest FROM l JOIN h ON h.o_custkey = l.o_custkey
            AND h.day <= l.day - 150 AND h.day >= l.day - 395 GROUP BY 1)
    SELECT l.o_custkey, l.day, round(latest, 2) AS latest, first_day, round(earliest, 2) AS earliest,
           CASE WHEN earliest IS NOT NULL THEN round(greatest(0, least(100, 50 + 100 * (latest - earliest) / earliest)), 4) END AS growth
    FROM l LEFT JOIN e USING (o_custkey)
    """
)
def earliest_in_window(spark, sf_dir):
    """Growth against the oldest value 150 to 395 days before the latest."""
    history = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("day")).agg(F.max("o_totalprice").alias("v"))
    latest = history.groupBy("o_custkey").agg(F.max("day").alias("day"), F.max_by("v", "day").alias("latest"))
    old = ops.in_window(latest, history, "o_custkey", "day", "day", ["v"], after="395 DAYS", before="150 DAYS", newest=False, prefix="first_")
    growth = 50.0 + 100.0 * (F.col("latest") - F.col("first_v")) / F.col("first_v")
    return old.select(
        "o_custkey", "day", F.round("latest", 2).alias("latest"), F.col("first_at").alias("first_day"), F.round("first_v", 2).alias("earliest"),
        F.round(F.when(growth.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), growth))), 4).alias("growth"),
    )


@query(
    """
    WITH n AS (SELECT *, sum(CASE WHEN o_orderpriority LIKE '1-%' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS segment FROM orders)
    SELECT o_custkey, CAST(segment AS BIGINT) AS segment, count(*) AS n, min(CAST(o_orderdate AS DATE)) AS first_date, max(CAST(o_orderdate AS DATE)) AS last_date,
           round(arg_max(o_totalprice, (o_orderdate, o_orderkey)), 2) AS last_price
    FROM n GROUP BY 1, 2
    """
)
def segment_latest(spark, sf_dir):
    """Stretches that an urgent order starts, each with its last price."""
    numbered = ops.segments(table(spark, sf_dir, "orders"), "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], F.col("o_orderpriority").like("1-%"))
    day = F.col("o_orderdate").cast("date")
    return numbered.groupBy("o_custkey", "segment").agg(
        F.count("*").alias("n"), F.min(day).alias("first_date"), F.max(day).alias("last_date"),
        F.round(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")), 2).alias("last_price"),
    )


@query(
    """
    WITH f AS (SELECT o_orderkey AS id, o_custkey AS grp, CAST(o_orderdate AS DATE) AS filed,
                      CASE WHEN o_orderpriority LIKE '1-%' THEN 'D' ELSE 'D/A' END AS form, round(o_totalprice, 2) AS amount FROM orders),
    heads AS (SELECT * FROM f WHERE form = 'D' OR NOT EXISTS (
        SELECT 1 FROM f p WHERE p.grp = f.grp AND p.filed < f.filed AND p.filed >= f.filed - 400))
    SELECT h.id, h.grp, h.filed, h.form, l.filed AS updated, l.amount
    FROM heads h, LATERAL (
        SELECT x.filed, x.form, x.amount FROM f x WHERE x.grp = h.grp AND x.filed >= h.filed AND x.filed < h.filed + 400
          AND NOT EXISTS (SELECT 1 FROM f d WHERE d.grp = h.grp AND d.form = 'D' AND d.filed > h.filed AND d.filed <= x.filed AND d.id <> h.id)
        ORDER BY x.filed DESC, x.form DESC, x.amount DESC LIMIT 1) l
    """
)
def amendment_chain(spark, sf_dir):
    """Originals with the figures of their last amendment in 400 days."""
    filings = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("grp"), F.col("o_orderdate").cast("date").alias("filed"),
        F.when(F.col("o_orderpriority").like("1-%"), "D").otherwise("D/A").alias("form"), F.round("o_totalprice", 2).alias("amount"),
    )
    return ops.amended(filings, group="grp", filed="filed", form="form", original="D", values=["amount"]).select("id", "grp", "filed", "form", "updated", "amount")


@query(
    """
    WITH w AS (SELECT CAST(range AS DATE) AS week FROM range(DATE '1995-01-02', DATE '2001-12-31', INTERVAL 7 DAY)),
    o AS (SELECT CAST(o_orderdate AS DATE) AS opened, CAST(o_orderdate AS DATE) + 30 AS closed FROM orders)
    SELECT week, count(*) FILTER (WHERE opened < week + 7) AS open_now, count(*) FILTER (WHERE opened >= week) AS opened_now, count(*) FILTER (WHERE closed < week + 7) AS closed_now
    FROM w JOIN o ON opened < week + 7 AND closed >= week GROUP BY week
    """
)
def week_timeline(spark, sf_dir):
    """Orders open, opened and closed in each week: every order makes a row for each week it is open."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("opened")).withColumn("closed", F.date_add("opened", 30))
    weeks = orders.select("opened", "closed", F.explode(ops.weekly(F.col("opened"), F.col("closed"))).alias("week")).where("week >= DATE '1995-01-02' AND week < DATE '2001-12-31'")
    after = F.date_add("week", 7)
    return weeks.groupBy("week").agg(
        F.count(F.when(F.col("opened") < after, 1)).alias("open_now"),
        F.count(F.when(F.col("opened") >= F.col("week"), 1)).alias("opened_now"),
        F.count(F.when(F.col("closed") < after, 1)).alias("closed_now"),
    )


@query(
    """
    SELECT week, event_type, round(sum(most), 4) AS total, count(*) AS users FROM (
        SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type, user_id, max(value) AS most FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2
    """
)
def two_level_agg(spark, sf_dir):
    """Greatest value of each user and week, summed by week."""
    most = table(spark, sf_dir, "events").groupBy(F.date_trunc("week", "ts").cast("date").alias("week"), "event_type", "user_id").agg(F.max("value").alias("most"))
    return most.groupBy("week", "event_type").agg(F.round(F.sum("most"), 4).alias("total"), F.count("*").alias("users"))


@query(
    """
    SELECT c_custkey, row_number() OVER w AS place, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS segment_rank,
           dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS segment_dense,
           coalesce(CASE WHEN c_acctbal > 0 THEN ntile(3) OVER (PARTITION BY c_nationkey, c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey) END, 2) AS tier
    FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey)
    """
)
def rank_suite(spark, sf_dir):
    nation = W.partitionBy("c_nationkey")
    tier = F.ntile(3).over(W.partitionBy("c_nationkey", F.col("c_acctbal") > 0).orderBy(F.desc("c_acctbal"), "c_custkey"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.row_number().over(nation.orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey")).alias("place"),
        F.rank().over(nation.orderBy("c_mktsegment")).alias("segment_rank"),
        F.dense_rank().over(nation.orderBy("c_mktsegment")).alias("segment_dense"),
        F.coalesce(F.when(F.col("c_acctbal") > 0, tier), F.lit(2)).alias("tier"),
    )


@query(
    """
    SELECT n_name, round(mean, 4) AS mean, dense_rank() OVER (ORDER BY round(mean, 4) DESC) AS place, ntile(4) OVER (ORDER BY round(mean, 4) DESC, n_name) AS quartile
    FROM (SELECT n_name, avg(c_acctbal) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)
    """
)
def rank_over_aggregate(spark, sf_dir):
    """Ranks over a grouped mean: one row per nation is ordered, not the customers."""
    means = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.avg("c_acctbal"), 4).alias("mean"))
    return means.select("n_name", "mean", F.dense_rank().over(W.orderBy(F.desc("mean"))).alias("place"), F.ntile(4).over(W.orderBy(F.desc("mean"), "n_name")).alias("quartile"))


@query(
    """
    SELECT o_custkey, o_orderkey, round(sum(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice ELSE 0 END)
             OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running
    FROM orders
    """
)
def running_total(spark, sf_dir):
    """Running total to which only some rows add and the others carry."""
    run = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, 0)
    adds = F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).otherwise(0.0)
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round(F.sum(adds).over(run), 2).alias("running"))


@query(
    """
    SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS urgent
    FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)
    """
)
def semi_anti(spark, sf_dir):
    customers, orders = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders")
    rich = orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    urgent = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("_u", F.lit(True))
    return customers.join(rich, "c_custkey", "left_anti").join(urgent, "c_custkey", "left").select("c_custkey", F.coalesce("_u", F.lit(False)).alias("urgent"))


@query(
    """
    SELECT o_custkey, n, round(total, 2) AS total FROM (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1)
    WHERE total > (SELECT avg(t) FROM (SELECT sum(o_totalprice) AS t FROM orders GROUP BY o_custkey)) AND n >= 3
    """
)
def having_vs_avg(spark, sf_dir):
    """Groups above the mean of group sums."""
    sums = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    mean = sums.agg(F.avg("total").alias("mean"))
    return sums.where("n >= 3").crossJoin(F.broadcast(mean)).where("total > mean").select("o_custkey", "n", F.round("total", 2).alias("total"))


@query(
    """
    SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*) AS n, round(sum(l_quantity), 2) AS quantity
    FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
    """
)
def rollup_sub(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return r.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n", "quantity")


@query(
    """
    WITH feed AS (
        SELECT 'order' AS kind, o_orderkey AS id, o_orderpriority AS sector, CAST(o_orderdate AS DATE) AS deal_date, o_totalprice AS amount FROM orders
        UNION ALL SELECT 'line', l_orderkey, NULL, CAST(l_shipdate AS DATE), l_extendedprice FROM lineitem WHERE l_returnflag = 'R'),
    top AS (SELECT kind, sector, count(*) AS n, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, sector) AS r FROM feed GROUP BY 1, 2)
    SELECT f.kind, count(*) AS n, round(sum(amount), 2) AS total, round(max(amount), 2) AS largest, max(deal_date) AS latest,
           count(*) FILTER (WHERE deal_date >= DATE '2000-01-01') AS recent, max(t.sector) AS top_key, max(t.n) AS top_count
    FROM feed f JOIN top t ON t.kind = f.kind AND t.r = 1 GROUP BY f.kind
    """
)
def union_feed(spark, sf_dir):
    """Two feeds in one shape, and the headline figures of each."""
    orders = table(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("sector"), F.col("o_orderdate").cast("date").alias("deal_date"), F.col("o_totalprice").alias("amount"))
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.lit("line").alias("kind"), F.col("l_orderkey").alias("id"), F.col("l_shipdate").cast("date").alias("deal_date"), F.col("l_extendedprice").alias("amount"))
    feed = orders.unionByName(lines, allowMissingColumns=True)
    stats = feed.groupBy("kind").agg(
        F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"), F.round(F.max("amount"), 2).alias("largest"), F.max("deal_date").alias("latest"),
        F.count(F.when(F.col("deal_date") >= F.lit("2000-01-01").cast("date"), 1)).alias("recent"),
    )
    top = ops.first_per(feed.groupBy("kind", "sector").agg(F.count("*").alias("top_count")), ["kind"], [F.desc("top_count"), F.col("sector")], 1)
    return stats.join(top.withColumnRenamed("sector", "top_key"), "kind")


@query(
    """
    SELECT event_type, count(*) AS n, count(json_extract(props, '$.k')) AS with_k, round(avg(CAST(json_extract_string(props, '$.k') AS INT)), 4) AS mean_k,
           max(CAST(json_extract_string(props, '$.k') AS INT)) AS max_k
    FROM events GROUP BY event_type
    """
)
def json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("with_k"), F.round(F.avg(k), 4).alias("mean_k"), F.max(k).alias("max_k"))


_OLD, _NEW = "CAST(o_orderdate AS DATE) < DATE '1998-06-01'", "CAST(o_orderdate AS DATE) >= DATE '1998-01-01'"


@query(
    f"""
    WITH b AS (SELECT o_custkey, max(o_orderpriority) AS p, round(max(o_totalprice), 2) AS v FROM orders WHERE {_OLD} GROUP BY 1),
    a AS (SELECT o_custkey, max(o_orderpriority) AS p, CASE WHEN max(o_totalprice) > 300000 THEN NULL ELSE round(max(o_totalprice), 2) END AS v FROM orders WHERE {_NEW} GROUP BY 1)
    SELECT coalesce(b.o_custkey, a.o_custkey) AS o_custkey, coalesce(b.p, a.p) AS p, coalesce(a.v, b.v) AS v FROM b FULL JOIN a ON a.o_custkey = b.o_custkey
    """
)
def upsert_latest(spark, sf_dir):
    """Keyed upsert: new values win unless null, one column keeps what it had."""
    orders = table(spark, sf_dir, "orders")
    top = F.round(F.max("o_totalprice"), 2)
    before = orders.where(_OLD).groupBy("o_custkey").agg(F.max("o_orderpriority").alias("p"), top.alias("v"))
    after = orders.where(_NEW).groupBy("o_custkey").agg(F.max("o_orderpriority").alias("p"), F.when(F.max("o_totalprice") <= 300000, top).alias("v"))
    return keyed.upsert(before, after, ["o_custkey"], {"p": keyed.KEEP, "v": keyed.NEW})


@query(
    f"""
    WITH b AS (SELECT o_custkey, max(o_orderpriority) AS v FROM orders WHERE {_OLD} GROUP BY 1), a AS (SELECT o_custkey, max(o_orderpriority) AS v FROM orders WHERE {_NEW} GROUP BY 1)
    SELECT coalesce(b.o_custkey, a.o_custkey) AS o_custkey, b.v AS before, a.v AS after,
           CASE WHEN a.o_custkey IS NULL THEN 'lost' WHEN b.o_custkey IS NULL THEN 'added' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'same' ELSE 'changed' END AS status
    FROM b FULL JOIN a ON a.o_custkey = b.o_custkey
    """
)
def snapshot_diff(spark, sf_dir):
    """Lost, added, changed and same between two snapshots: also a regression gate's input."""
    orders = table(spark, sf_dir, "orders")
    before, after = (orders.where(c).groupBy("o_custkey").agg(F.max("o_orderpriority").alias("v")) for c in (_OLD, _NEW))
    return keyed.diff(before, after, ["o_custkey"], "v")


@query(
    """
    WITH held AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1998-01-01'),
    live AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '2000-06-01')
    SELECT 'closed' AS what, count(*) AS n FROM (FROM held EXCEPT FROM live) UNION ALL
    SELECT 'kept', count(*) FROM (FROM held INTERSECT FROM live) UNION ALL
    SELECT 'all', count(*) FROM (FROM held UNION FROM live)
    """
)
def set_operations(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("day"))
    held, live = keys.where("day < DATE '1998-01-01'").select("k"), keys.where("day >= DATE '2000-06-01'").select("k")
    parts = {"closed": held.subtract(live), "kept": held.intersect(live), "all": held.union(live).distinct()}
    counts = [d.agg(F.lit(name).alias("what"), F.count("*").alias("n")) for name, d in parts.items()]
    return counts[0].union(counts[1]).union(counts[2])


@query(
    """
    WITH h AS (SELECT user_id AS job, event_type AS board, min(ts) AS first_seen_at,
                      CASE WHEN max(ts) < TIMESTAMP '2024-01-20' THEN max(ts) END AS closed_at FROM events WHERE ts < TIMESTAMP '2024-01-25' GROUP BY 1, 2),
    live AS (SELECT DISTINCT user_id AS job, event_type AS board FROM events WHERE ts >= TIMESTAMP '2024-01-28' AND event_type <> 'error'),
    ok AS (SELECT DISTINCT event_type AS board FROM events WHERE event_type <> 'view' AND event_type <> 'error')
    SELECT coalesce(h.board, l.board) AS board, coalesce(h.job, l.job) AS job,
           CASE WHEN l.job IS NOT NULL AND h.job IS NULL THEN 'opened' WHEN l.job IS NOT NULL AND h.closed_at IS NOT NULL THEN 'reopened'
                WHEN l.job IS NULL AND h.closed_at IS NULL AND ok.board IS NOT NULL THEN 'closed' ELSE 'unchanged' END AS event,
           (l.job IS NOT NULL OR (h.closed_at IS NULL AND ok.board IS NULL)) AS is_active
    FROM h FULL JOIN live l ON l.job = h.job AND l.board = h.board LEFT JOIN ok ON ok.board = coalesce(h.board, l.board)
    """
)
def board_lifecycle(spark, sf_dir):
    """State of jobs after a crawl in which some boards failed."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_type").alias("board"), "ts")
    held = events.where("ts < TIMESTAMP '2024-01-25'").groupBy("board", "job").agg(F.min("ts").alias("first_seen_at"), F.when(F.max("ts") < F.lit("2024-01-20").cast("timestamp"), F.max("ts")).alias("closed_at"))
    listing = events.where("ts >= TIMESTAMP '2024-01-28' AND board != 'error'")
    fetched = events.where("board NOT IN ('view', 'error')")
    state = keyed.lifecycle(held, listing, fetched, board="board", job="job", at=F.lit("2024-01-31").cast("timestamp"))
    return state.select("board", "job", "event", "is_active")


@query(
    """
    SELECT p_brand, listing, n FROM (
      SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS listing, count(DISTINCT p_type) AS n FROM part GROUP BY 1)
    """
)
def ordered_arrays(spark, sf_dir):
    """Distinct values of each group in order."""
    types = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("types"))
    return types.select("p_brand", F.array_join("types", ",").alias("listing"), F.size("types").cast("long").alias("n"))


@query(
    """
    WITH x AS (SELECT l_orderkey AS round_id, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice) = 1 AS leads, l_extendedprice AS amount, l_orderkey % 500 AS company FROM lineitem)
    SELECT l_suppkey, count(DISTINCT company) AS companies, count(DISTINCT round_id) AS rounds, count(DISTINCT CASE WHEN leads THEN round_id END) AS led, round(sum(amount), 2) AS amount
    FROM x GROUP BY l_suppkey
    """
)
def investor_facts(spark, sf_dir):
    """What each participant took part in and led: lines fold into a row for each round and participant first, so that only companies are counted distinct."""
    lines = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice"), "l_orderkey")
    parts = lines.withColumn("leads", F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")) == 1)
    took = parts.groupBy("l_suppkey", "l_orderkey").agg(F.max("leads").alias("leads"), F.sum("l_extendedprice").alias("amount"))
    return took.groupBy("l_suppkey").agg(
        F.countDistinct(F.col("l_orderkey") % 500).alias("companies"), F.count("l_orderkey").alias("rounds"), F.count(F.when(F.col("leads"), F.col("l_orderkey"))).alias("led"), F.round(F.sum("amount"), 2).alias("amount"),
    )


@query(
    """
    WITH d AS (SELECT event_id, user_id, event_type, ts, user_id || ':' || event_type || ':' || strftime(ts, '%Y-%m-%d') AS dedupe_key FROM events WHERE event_type <> 'error')
    SELECT event_id, user_id, dedupe_key FROM (SELECT *, row_number() OVER (PARTITION BY user_id, dedupe_key ORDER BY ts, event_id) AS n FROM d WHERE ts >= TIMESTAMP '2024-01-08')
    WHERE n = 1 AND dedupe_key NOT IN (SELECT dedupe_key FROM d WHERE ts < TIMESTAMP '2024-01-10')
    """
)
def alerts_dedupe(spark, sf_dir):
    """New alerts of a lookback window, one per key, none that was raised before."""
    key = F.concat_ws(":", F.col("user_id").cast("string"), "event_type", F.date_format("ts", "yyyy-MM-dd"))
    alerts = table(spark, sf_dir, "events").where("event_type != 'error'").select("event_id", "user_id", key.alias("dedupe_key"), "ts")
    raised = alerts.where("ts < TIMESTAMP '2024-01-10'").select("user_id", "dedupe_key")
    return keyed.insert_new(raised, alerts.where("ts >= TIMESTAMP '2024-01-08'"), ["user_id", "dedupe_key"], [F.col("ts"), F.col("event_id")]).select("event_id", "user_id", "dedupe_key")


@query(
    """
    WITH g AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh
               FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
    SELECT user_id, min(ts) AS started, max(ts) AS last_event, count(*) AS n_events FROM s GROUP BY user_id, k
    """
)
def session_activity(spark, sf_dir):
    """Sessions: events of a user less than six hours apart."""
    s = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("s"))
    return s.agg(F.min("ts").alias("started"), F.max("ts").alias("last_event"), F.count("*").alias("n_events")).drop("s")


@query(
    """
    SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles, sum(length(text)) AS chars, arg_min(text, turn) AS first_text FROM conversations GROUP BY conv_id
    """
)
def conversation_turns(spark, sf_dir):
    """Turns of each conversation in order."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"), F.sum(F.length("text")).alias("chars"), F.min_by("text", "turn").alias("first_text")
    )
    return turns.select("conv_id", "turns", F.array_join(F.transform("r", lambda x: x["role"]), ">").alias("roles"), "chars", "first_text")
