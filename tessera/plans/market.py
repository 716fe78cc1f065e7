"""Market lists and their upkeep: predicates, opt-outs, patterns, totals, queues, pools, alerts and reports."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import classify, web
from tessera.operators import keyed, market, quality, relational, resolve, scoring
from tessera.plans.catalog import query
from tessera.sources.tables import dealt, table

def _today():
    return F.lit("2001-08-01").cast("date")


def _places(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    offices = F.filter(F.array(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Nation_"), (F.col("c_custkey") % 7).cast("string")))), lambda x: x.isNotNull())
    founded = F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("NATION_"), (F.col("c_custkey") % 25).cast("string")))
    return c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).select("c_custkey", F.col("n_name").alias("country"), founded.alias("founded_in"), offices.alias("offices"))


@query(
    """
    SELECT c_custkey, n_name AS country FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE n_name = 'NATION_3' OR (c_custkey % 4 <> 0 AND c_custkey % 25 = 3) OR (c_custkey % 3 = 0 AND c_custkey % 7 = 3)
    """
)
def country_filter(spark, sf_dir):
    """Companies with a country as seat, as origin or among their offices, whatever the case."""
    return _places(spark, sf_dir).where(market.in_country(F.lit("nation_3"), F.col("country"), F.col("founded_in"), F.col("offices"))).select("c_custkey", "country")


@query(
    """
    SELECT c_custkey, n_name = 'NATION_1' OR (c_custkey % 4 <> 0 AND c_custkey % 25 = 1) OR c_custkey % 11 = 0 OR (c_custkey % 3 = 0 AND c_custkey % 7 = 1) AS related FROM customer JOIN nation ON c_nationkey = n_nationkey
    """
)
def related_flag(spark, sf_dir):
    """Whether a company is related to a country, by its places or a research centre there."""
    at = market.in_country(F.lit("NATION_1"), F.col("country"), F.col("founded_in"), F.col("offices"))
    return _places(spark, sf_dir).select("c_custkey", (at | F.coalesce(F.col("c_custkey") % 11 == 0, F.lit(False))).alias("related"))


@query(
    """
    WITH l AS (SELECT o_custkey, max(o_orderdate) >= TIMESTAMP '2001-02-01' AS recent, count(*) AS n FROM orders GROUP BY 1),
    c AS (SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS peers, c_mktsegment <> 'FURNITURE' AS valid,
                 coalesce(recent AND CASE WHEN n >= 14 THEN 'rapid growth' WHEN n >= 10 THEN 'moderate growth' ELSE 'flat' END <> 'flat', false) AS momentum
          FROM customer LEFT JOIN l ON o_custkey = c_custkey)
    SELECT c_custkey, momentum, CASE WHEN valid AND peers >= 4 THEN 'crowded' WHEN valid AND peers <= 2 THEN 'blue-ocean' END AS density FROM c
    """
)
def momentum_density(spark, sf_dir):
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.max("o_orderdate") >= F.lit("2001-02-01").cast("timestamp_ntz")).alias("recent"), F.count("*").alias("n"))
    trend = F.when(F.col("n") >= 14, "rapid growth").when(F.col("n") >= 10, "moderate growth").otherwise("flat")
    c = table(spark, sf_dir, "customer").withColumn("peers", F.count("*").over(W.partitionBy("c_nationkey", "c_mktsegment"))).join(per, "c_custkey", "left")
    return c.select("c_custkey", market.has_momentum(F.col("recent"), trend).alias("momentum"), market.density(F.col("peers"), F.col("c_mktsegment") != "FURNITURE").alias("density"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0 OR (c_custkey % 10 >= 7 AND trim(coalesce(CASE WHEN c_acctbal > 0 THEN c_name END, '')) <> '')")
def enriched_view(spark, sf_dir):
    """Rows that were enriched, or are complete enough and described."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.where(market.enriched(F.when(k % 5 == 0, _today()), k % 10, F.when(F.col("c_acctbal") > 0, F.col("c_name")))).select("c_custkey")


@query(
    """
    WITH b AS (SELECT s_suppkey, s_nationkey AS provider, 'http://www.jobs' || (s_suppkey % 9) || '.site' || (s_suppkey % 5) || '.com/x' AS website FROM supplier)
    SELECT s_suppkey, CASE WHEN s_suppkey % 20 = 0 OR (provider = 3 AND s_suppkey % 2 = 1) OR regexp_matches(website, '[./]site2\\.com/') OR regexp_matches(website, '[./]jobs4\\.site1\\.com/') THEN 'opted out'
           WHEN provider % 4 = 0 THEN 'provider off' WHEN s_suppkey % 13 = 0 THEN 'blocked' ELSE 'crawlable' END AS state FROM b
    """
)
def crawlable_boards(spark, sf_dir):
    """Boards that may be read: their provider is on, they aren't blocked, and no opt-out covers them."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    site = F.concat(F.lit("http://www.jobs"), (k % 9).cast("string"), F.lit(".site"), (k % 5).cast("string"), F.lit(".com/x"))
    boards = s.select("s_suppkey", k.alias("company_id"), F.col("s_nationkey").cast("string").alias("provider"), (k % 2).cast("string").alias("token"), site.alias("website"))
    shape = "company_id long, provider string, token string, domain string"
    outs = s.where(k % 20 == 0).select(k.alias("company_id"), *[F.lit(None).cast("string").alias(c) for c in ("provider", "token", "domain")])
    outs = outs.unionByName(spark.createDataFrame([(None, "3", "1", None), (None, None, None, "site2.com"), (None, None, None, "jobs4.site1.com")], shape))
    out = market.opted_out(boards, outs, "s_suppkey").withColumn("out", F.lit(True))
    providers = spark.range(25).select(F.col("id").cast("string").alias("provider"), (F.col("id") % 4 != 0).alias("enabled"))
    joined = boards.join(F.broadcast(providers), "provider").join(out, "s_suppkey", "left")
    return joined.select("s_suppkey", F.when(F.col("out"), "opted out").when(~F.col("enabled"), "provider off").when(k % 13 == 0, "blocked").otherwise("crawlable").alias("state"))


@query(
    """
    WITH p AS (SELECT p_partkey, p_name || ' ' || lower(p_type) || CASE p_partkey % 5 WHEN 0 THEN ' university of tests' WHEN 1 THEN ' universityof tests' ELSE '' END AS words FROM part),
    e(pattern) AS (VALUES ('red widget'), ('ring economy'), ('small'), ('university of'), ('blue'))
    SELECT p_partkey, min(pattern) AS first_pattern, count(*) AS patterns FROM p JOIN e ON regexp_matches(words, '\\b' || pattern || '\\b') GROUP BY 1
    """
)
def excluded_names(spark, sf_dir):
    """Names that hold a denied pattern of whole words, and the patterns."""
    k = F.col("p_partkey") % 5
    words = F.concat("p_name", F.lit(" "), F.lower("p_type"), F.when(k == 0, " university of tests").when(k == 1, " universityof tests").otherwise(""))
    denied = spark.createDataFrame([("red widget",), ("ring economy",), ("small",), ("university of",), ("blue",)], "pattern string")
    hits = market.word_pattern_matches(dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), "p_partkey"), "p_partkey", words, denied)  # counted where they are dealt to
    return hits.groupBy("p_partkey").agg(F.min("pattern").alias("first_pattern"), F.count("*").alias("patterns"))


@query(
    """
    WITH a AS (SELECT DISTINCT lower(trim(x)) AS name FROM (SELECT unnest([o_orderpriority, ' Clerk' || (o_orderkey % 40), NULL]) AS x FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-01') WHERE trim(x) <> '')
    SELECT s_suppkey, 'clerk' || (s_suppkey % 60) AS name FROM supplier WHERE s_acctbal BETWEEN 100 AND 9000 AND 'clerk' || (s_suppkey % 60) IN (SELECT name FROM a)
    """
)
def active_directory(spark, sf_dir):
    """Investors by size, only those named on a deal of late, as lead or participant."""
    recent = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("2001-07-01").cast("timestamp_ntz"))
    named = recent.select("o_orderpriority", F.array(F.concat(F.lit(" Clerk"), (F.col("o_orderkey") % 40).cast("string")), F.lit(None).cast("string")).alias("others"))
    active = relational.names_of(named, [], "o_orderpriority", "others")
    found = table(spark, sf_dir, "supplier").where(F.col("s_acctbal").between(100, 9000)).select("s_suppkey", F.concat(F.lit("clerk"), (F.col("s_suppkey") % 60).cast("string")).alias("name"))
    return found.join(active, "name", "left_semi").select("s_suppkey", "name")


@query(
    """
    SELECT x.name, count(DISTINCT o_custkey) AS companies, count(DISTINCT o_orderkey) AS rounds FROM (
      SELECT o_custkey, o_orderkey, lower(trim(unnest([o_orderpriority, 'Fund ' || (o_orderkey % 9), ' fund ' || (o_custkey % 9)]))) AS name FROM orders) x GROUP BY 1
    """
)
def investor_portfolio(spark, sf_dir):
    """Companies and rounds of each investor, whether it leads or takes part."""
    fund = [F.concat(F.lit(t), (F.col(c) % 9).cast("string")) for t, c in (("Fund ", "o_orderkey"), (" fund ", "o_custkey"))]
    rounds = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", F.array(*fund).alias("others"))
    each = relational.names_of(rounds, ["o_custkey", "o_orderkey"], "o_orderpriority", "others")
    return each.groupBy("name").agg(F.countDistinct("o_custkey").alias("companies"), F.countDistinct("o_orderkey").alias("rounds"))


@query(
    """
    SELECT user_id, count(*) AS watched, count(DISTINCT c_nationkey) AS countries FROM (SELECT user_id, CASE WHEN event_id % 3 = 0 THEN 'startup' ELSE 'investor' END AS entity_type, event_id % 2000 AS entity_id FROM events)
    JOIN customer ON entity_type = 'startup' AND entity_id = c_custkey GROUP BY 1
    """
)
def watched_companies(spark, sf_dir):
    """A list whose ids mean different tables, joined to one of them."""
    k = F.col("event_id")
    items = table(spark, sf_dir, "events").select("user_id", F.when(k % 3 == 0, "startup").otherwise("investor").alias("entity_type"), (k % 2000).alias("c_custkey")).where("entity_type = 'startup'")
    return items.join(table(spark, sf_dir, "customer"), "c_custkey").groupBy("user_id").agg(F.count("*").alias("watched"), F.countDistinct("c_nationkey").alias("countries"))


@query(
    """
    SELECT o_custkey, to_json(list({'id': o_orderkey, 'status': o_orderstatus} ORDER BY o_orderkey)) AS rounds,
           (SELECT string_agg(s || '=' || n, ',' ORDER BY s) FROM (SELECT o_orderstatus AS s, count(*) AS n FROM orders i WHERE i.o_custkey = o.o_custkey GROUP BY 1)) AS by_status
    FROM orders o GROUP BY o_custkey
    """
)
def nested_rounds(spark, sf_dir):
    """A company's rounds as JSON, and a map of their statuses."""
    o = table(spark, sf_dir, "orders")
    entry = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    nested = o.groupBy("o_custkey").agg(F.to_json(F.sort_array(F.collect_list(entry))).alias("rounds"))
    counts = market.counts_map(o, ["o_custkey"], "o_orderstatus")
    listed = F.array_join(F.transform(F.sort_array(F.map_entries("counts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return nested.join(counts, "o_custkey").select("o_custkey", "rounds", listed.alias("by_status"))


@query(
    """
    WITH w AS (SELECT DISTINCT trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) AS name FROM nation),
    f AS (SELECT trim(regexp_replace('nation_' || (o_orderkey % 20), '[^a-z0-9]+', ' ', 'g')) AS name FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01')
    SELECT w.name, count(f.name) AS n FROM w LEFT JOIN f USING (name) GROUP BY 1
    """
)
def publication_counts(spark, sf_dir):
    """Publications of every wanted applicant, 0 where there are none."""
    from tessera.functions import names

    wanted = table(spark, sf_dir, "nation").select(names.applicant_key(F.col("n_name")).alias("name"))
    held = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz"))
    filed = held.select(names.applicant_key(F.concat(F.lit("NATION_"), (F.col("o_orderkey") % 20).cast("string"))).alias("name"))
    return market.zero_filled(wanted, filed, "name")


@query("SELECT stage, coalesce(c, 0) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) s(stage) LEFT JOIN (SELECT o_orderstatus AS stage, count(*) AS c FROM orders GROUP BY 1) USING (stage)")
def stage_counts(spark, sf_dir):
    """Rows of each stage of a list, those without any included."""
    stages = spark.createDataFrame([("F",), ("O",), ("P",), ("X",)], "stage string")
    return market.zero_filled(stages, table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("stage")), "stage")


@query(
    """
    SELECT o_custkey, round(sum(CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN o_totalprice END), 2) AS equity, round(sum(CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN o_totalprice END), 2) AS debt FROM orders GROUP BY 1
    """
)
def equity_and_debt(spark, sf_dir):
    """Equity and debt of each company, null where nothing is disclosed."""
    kind = F.when(F.col("o_orderstatus") == "F", "equity").when(F.col("o_orderstatus") == "O", "debt").otherwise("not_capital")
    rounds = table(spark, sf_dir, "orders").select("o_custkey", kind.alias("kind"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("amount"))
    return market.capital_totals(rounds, "o_custkey", "kind", "amount").select("o_custkey", F.round("equity", 2).alias("equity"), F.round("debt", 2).alias("debt"))


@query(
    """
    WITH r AS (SELECT o_custkey, o_orderkey, lower(trim(o_orderpriority)) AS lead, ['angel ' || (o_orderkey % 4), lower(trim(o_orderpriority)), 'bank'] AS others, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 100 END AS amt FROM orders),
    e AS (SELECT DISTINCT o_custkey, o_orderkey, lead, amt, unnest(list_concat([lead], others)) AS key FROM r),
    a AS (SELECT o_custkey, key, count(*) AS rounds, bool_or(key = lead) AS is_lead, sum(CASE WHEN key = 'bank' THEN amt END) AS total FROM e GROUP BY 1, 2)
    SELECT o_custkey AS company_id, key, rounds, is_lead, CAST(total AS BIGINT) AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY is_lead DESC, total DESC NULLS LAST, key) AS place FROM a
    """
)
def investor_schedules(spark, sf_dir):
    """Investors of each company: rounds, whether they led, what they disclosed, in their order."""
    angel = F.concat(F.lit("Angel "), (F.col("o_orderkey") % 4).cast("string"))
    amounts = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.struct(F.lit("BANK").alias("name"), (F.col("o_orderkey") % 100).alias("amount"))))
    rounds = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("company_id"), F.col("o_orderkey").alias("round_id"), F.col("o_orderpriority").alias("lead"), F.array(angel, F.concat(F.lit(" "), "o_orderpriority"), F.lit("Bank")).alias("others"), amounts.alias("amounts")
    )
    return market.investor_schedule(rounds)


@query(
    """
    SELECT l_suppkey, count(*) AS models, sum(CASE WHEN l_linenumber > 2 THEN l_linenumber END) AS likes, count(CASE WHEN l_linenumber % 2 = 0 THEN 1 END) AS with_delta, sum(CASE WHEN l_linenumber > 90 THEN 1 END) AS nothing FROM lineitem GROUP BY 1
    """
)
def repository_stats(spark, sf_dir):
    """Sums and counts that leave nulls out; a sum of nulls alone is null."""
    n = F.col("l_linenumber").cast("long")
    likes, delta = F.when(n > 2, n), F.when(n % 2 == 0, F.lit(1))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("models"), F.sum(likes).alias("likes"), F.count(delta).alias("with_delta"), F.sum(F.when(n > 90, F.lit(1))).cast("long").alias("nothing"))


@query(
    """
    SELECT c_nationkey, count(*) FILTER (WHERE c_acctbal < 0) AS flagged, count(*) AS total, round(100.0 * count(*) FILTER (WHERE c_acctbal < 0) / nullif(count(*), 0), 2) AS pct FROM customer GROUP BY 1
    """
)
def health_counts(spark, sf_dir):
    bad = F.count(F.when(F.col("c_acctbal") < 0, 1))
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(bad.alias("flagged"), F.count("*").alias("total"), F.round(100.0 * bad / F.nullif(F.count("*"), F.lit(0)), 2).alias("pct"))


@query(
    """
    WITH r AS (SELECT 'user' || (user_id % 40) AS source, ts AS run_at, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'empty' ELSE 'ok' END AS status FROM events WHERE user_id % 40 < 37 AND (user_id % 40 < 20 OR ts < TIMESTAMP '2024-01-26')),
    x AS (SELECT 'user' || g AS source, 48 + (g % 3) * 24 AS max_hours FROM range(40) t(g)),
    p AS (SELECT source, count(*) FILTER (WHERE run_at > TIMESTAMP '2024-01-31' - INTERVAL 7 DAYS) AS runs_7d, count(*) FILTER (WHERE run_at > TIMESTAMP '2024-01-31' - INTERVAL 7 DAYS AND status = 'error') AS errors_7d, max(CASE WHEN status = 'ok' THEN run_at END) AS last_ok FROM r GROUP BY 1)
    SELECT source, coalesce(runs_7d, 0) AS runs_7d, coalesce(errors_7d, 0) AS errors_7d, coalesce((epoch(TIMESTAMP '2024-01-31') - floor(epoch(last_ok))) / 3600.0 <= max_hours, false) AS ok FROM x LEFT JOIN p USING (source)
    """
)
def source_states(spark, sf_dir):
    """State of every expected source, those that never ran included."""
    u = F.col("user_id") % 40
    e = table(spark, sf_dir, "events").where((u < 37) & ((u < 20) | (F.col("ts") < F.lit("2024-01-26").cast("timestamp_ntz"))))
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "empty").otherwise("ok")
    runs = e.select(F.concat(F.lit("user"), u.cast("string")).alias("source"), F.col("ts").cast("timestamp").alias("at"), status.alias("status"))
    expected = spark.range(40).select(F.concat(F.lit("user"), F.col("id").cast("string")).alias("source"), (48 + F.col("id") % 3 * 24).alias("max_hours"))
    return market.source_states(runs, expected, F.lit("2024-01-31").cast("timestamp")).select("source", "runs_7d", "errors_7d", "ok")


@query(
    """
    WITH k AS (SELECT CAST(o_orderdate AS DATE) AS day, CASE min(o_orderkey) % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'waiting' WHEN 2 THEN 'no_index' ELSE 'pending' END AS status FROM orders WHERE o_orderdate >= TIMESTAMP '2001-05-01' AND o_orderkey % 9 = 0 GROUP BY 1),
    r AS (SELECT CAST(DATE '2001-08-01' - CAST(i AS INT) AS DATE) AS day FROM range(1, 61) t(i) WHERE isodow(DATE '2001-08-01' - CAST(i AS INT)) <= 5)
    SELECT day FROM r WHERE day NOT IN (SELECT day FROM k WHERE status IN ('complete', 'no_index')) UNION SELECT day FROM k WHERE status IN ('waiting', 'pending')
    """
)
def days_to_read(spark, sf_dir):
    """Business days of late that aren't done, and older ones that were left open."""
    o = table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= F.lit("2001-05-01").cast("timestamp_ntz")) & (F.col("o_orderkey") % 9 == 0))
    k = F.col("k") % 4
    known = o.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.min("o_orderkey").alias("k")).select("day", F.when(k == 0, "complete").when(k == 1, "waiting").when(k == 2, "no_index").otherwise("pending").alias("status"))
    return market.days_to_do(market.business_days(spark, "2001-08-01", 60), known)


@query(
    """
    SELECT 'kept' AS part, count(*) AS n, min(o_orderkey) AS first_id FROM orders WHERE NOT coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate < TIMESTAMP '1996-01-01' END, false)
    UNION ALL SELECT 'archive', count(*), min(o_orderkey) FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderdate < TIMESTAMP '1996-01-01'
    """
)
def archive_split(spark, sf_dir):
    """Rows past their time go to an archive; what can't be told stays."""
    o = table(spark, sf_dir, "orders")
    old = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))
    kept, gone = market.archived(o, old)
    return kept.agg(F.lit("kept").alias("part"), F.count("*").alias("n"), F.min("o_orderkey").alias("first_id")).unionByName(gone.agg(F.lit("archive").alias("part"), F.count("*").alias("n"), F.min("o_orderkey").alias("first_id")))


@query(
    """
    WITH e AS (SELECT user_id, CASE WHEN event_id % 3 <> 0 THEN 'd' || (event_id % 50) END AS dedupe_key, event_id FROM events),
    held AS (SELECT DISTINCT user_id, dedupe_key FROM e WHERE event_id % 5 = 0 AND dedupe_key IS NOT NULL),
    new AS (SELECT *, row_number() OVER (PARTITION BY user_id, dedupe_key ORDER BY event_id) AS n FROM e WHERE event_id % 5 <> 0)
    SELECT user_id, dedupe_key, event_id FROM new WHERE dedupe_key IS NULL OR (n = 1 AND (user_id, dedupe_key) NOT IN (SELECT (user_id, dedupe_key) FROM held))
    """
)
def partial_unique_insert(spark, sf_dir):
    """Inserts under a key that is unique only where it isn't null."""
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select("user_id", F.when(k % 3 != 0, F.concat(F.lit("d"), (k % 50).cast("string"))).alias("dedupe_key"), "event_id")
    held = e.where((k % 5 == 0) & F.col("dedupe_key").isNotNull()).select("user_id", "dedupe_key").distinct()
    return keyed.insert_new(held, e.where(k % 5 != 0), ["user_id", "dedupe_key"], [k])


@query(
    """
    WITH a AS (SELECT 'customer' AS kind, c_custkey AS id, round(c_acctbal, 2) AS score FROM customer ORDER BY score DESC, id LIMIT 15), b AS (SELECT 'supplier' AS kind, s_suppkey AS id, round(s_acctbal, 2) AS score FROM supplier ORDER BY score DESC, id LIMIT 15)
    SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY score DESC, kind, id LIMIT 15
    """
)
def top_of_kinds(spark, sf_dir):
    """The best of two kinds together (a top-k report)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.round("c_acctbal", 2).alias("score"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.round("s_acctbal", 2).alias("score"))
    return market.top_of_kinds({"customer": (c, "c_custkey"), "supplier": (s, "s_suppkey")}, "score", 15)


@query(
    """
    WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN DATE '2001-01-01' + CAST(c_custkey % 400 AS INT) END AS step FROM customer)
    SELECT c_custkey, step, row_number() OVER (ORDER BY CASE WHEN step IS NULL THEN 2 WHEN step < DATE '2001-08-01' THEN 0 ELSE 1 END, step NULLS FIRST, c_custkey DESC) AS place FROM r ORDER BY place LIMIT 200
    """
)
def overdue_first(spark, sf_dir):
    """Overdue steps first, then those to come, then rows without one (a page of 200)."""
    step = F.when(F.col("c_custkey") % 3 != 0, F.date_add(F.lit("2001-01-01").cast("date"), (F.col("c_custkey") % 400).cast("int")))
    r = table(spark, sf_dir, "customer").select("c_custkey", step.alias("step"))
    late = F.when(F.col("step").isNull(), 2).when(F.col("step") < _today(), 0).otherwise(1)
    first = relational.page(r, [late, F.col("step").asc_nulls_first(), F.desc("c_custkey")], 0, 200)
    return first.withColumn("place", F.row_number().over(W.orderBy(late, F.col("step").asc_nulls_first(), F.desc("c_custkey"))))


@query(
    """
    WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey * 37 % 1000 END AS seen, CASE WHEN c_custkey % 6 = 0 THEN 1 END AS homepage FROM customer)
    SELECT c_custkey, place FROM (SELECT c_custkey, row_number() OVER (ORDER BY homepage IS NULL DESC, seen NULLS FIRST, c_custkey) AS place FROM r) WHERE place <= 100
    """
)
def stale_queue(spark, sf_dir):
    """What was never read comes first, then what was read longest ago; rows without a homepage before the others (a queue of 100)."""
    k = F.col("c_custkey")
    r = table(spark, sf_dir, "customer").select(k, F.when(k % 4 != 0, k * 37 % 1000).alias("seen"), F.when(k % 6 == 0, 1).alias("homepage"))
    order = [F.col("homepage").isNull().desc(), F.col("seen").asc_nulls_first(), k]
    return relational.page(r, order, 0, 100).select("c_custkey", F.row_number().over(W.orderBy(*order)).alias("place"))


@query(
    """
    SELECT c_custkey, array_to_string(list_sort(list_distinct(l)), ',') AS both, array_to_string(list_slice(l, 1, 3), ',') AS capped FROM (
      SELECT c_custkey, list_concat(['a', 'b' || (c_custkey % 3)], list_filter(['b' || (c_custkey % 2), 'c', 'a'], lambda x: x <> 'a' AND x <> 'b' || (c_custkey % 3))) AS l FROM customer)
    """
)
def united_lists(spark, sf_dir):
    """Union of two lists, and new entries appended up to a cap."""
    k = F.col("c_custkey")
    old = F.array(F.lit("a"), F.concat(F.lit("b"), (k % 3).cast("string")))
    new = F.array(F.concat(F.lit("b"), (k % 2).cast("string")), F.lit("c"), F.lit("a"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.array_sort(F.array_union(old, new)), ",").alias("both"), F.array_join(market.append_new(old, new, 3), ",").alias("capped"))


@query(
    """
    WITH i AS (SELECT c_custkey AS entity_id, 'domain' AS kind, 'site' || (c_custkey % 500) || '.com' AS value, 1.0 AS confidence FROM customer UNION ALL SELECT c_custkey, 'number', CAST(c_custkey * 7 AS VARCHAR), 1.0 FROM customer WHERE c_acctbal > 0
      UNION ALL SELECT c_custkey, 'name_norm', lower(c_mktsegment), 0.3 FROM customer UNION ALL SELECT c_custkey, 'name_norm', lower(c_mktsegment), 0.2 FROM customer)
    SELECT entity_id, kind, value, max(confidence) AS confidence FROM i GROUP BY 1, 2, 3
    """
)
def identifiers(spark, sf_dir):
    """Identifiers of every kind, of repeats the most certain."""
    c = table(spark, sf_dir, "customer")
    site = web.registrable_domain(F.concat(F.lit("https://www.site"), (F.col("c_custkey") % 500).cast("string"), F.lit(".com/about")))
    own = {"domain": (c, "c_custkey", site, 1.0), "number": (c.where("c_acctbal > 0"), "c_custkey", F.col("c_custkey") * 7, 1.0), "name_norm": (c.union(c), "c_custkey", F.lower("c_mktsegment"), 0.3)}
    return market.identifiers_of(own)


@query(
    """
    WITH p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'org' || (c_custkey % 40) END AS org, 'site' || (c_custkey % 90) || '.com' AS domain FROM customer),
    o AS (SELECT 'org' || g AS org, 1000 + g AS company FROM range(20) t(g)), d AS (SELECT 'site' || g || '.com' AS domain, min(2000 + g) AS company FROM range(50) t(g) GROUP BY 1)
    SELECT id, coalesce(o.company, d.company) AS company_id, CASE WHEN o.company IS NOT NULL THEN 'org' WHEN d.company IS NOT NULL THEN 'domain' END AS matched_by FROM p LEFT JOIN o USING (org) LEFT JOIN d ON d.domain = p.domain
    """
)
def project_links(spark, sf_dir):
    """Projects linked by their organisation, else by their homepage's domain, never by name."""
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit("org"), (k % 40).cast("string"))).alias("org"), F.concat(F.lit("site"), (k % 90).cast("string"), F.lit(".com")).alias("domain"))
    orgs = spark.range(20).select(F.concat(F.lit("org"), F.col("id").cast("string")).alias("org_key"), (1000 + F.col("id")).alias("company_id"))
    sites = spark.range(50).select(F.concat(F.lit("site"), F.col("id").cast("string"), F.lit(".com")).alias("site_key"), (2000 + F.col("id")).alias("company_id"))
    return resolve.cascade(p, "id", [("org", orgs, "org_key"), ("domain", sites, "site_key")]).select("id", "company_id", "matched_by")


@query(
    """
    WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN 'site' || (c_custkey % 70) || '.com' END AS site, CASE WHEN c_custkey % 12 <> 0 THEN c_mktsegment || (c_custkey % 10) END AS name FROM customer),
    k AS (SELECT *, coalesce('site:' || site, 'name:' || lower(trim(name))) AS key FROM r)
    SELECT c_custkey, key FROM (SELECT c_custkey, key, row_number() OVER (PARTITION BY key ORDER BY c_custkey) AS n FROM k WHERE key IS NOT NULL) WHERE n = 1
    """
)
def seed_list(spark, sf_dir):
    """A seed list without repeats: by site, else by name; the first stays."""
    k = F.col("c_custkey")
    r = table(spark, sf_dir, "customer").select(k, F.when(k % 3 != 0, F.concat(F.lit("site"), (k % 70).cast("string"), F.lit(".com"))).alias("site"), F.when(k % 12 != 0, F.concat("c_mktsegment", (k % 10).cast("string"))).alias("name"))
    key = F.coalesce(F.concat(F.lit("site:"), "site"), F.concat(F.lit("name:"), F.lower(F.trim("name"))))
    return market.first_of_each(r, "site", "name", [k]).select("c_custkey", key.alias("key"))


@query(
    """
    WITH b AS (SELECT s_suppkey AS id, 'd' || (s_suppkey % 30) AS domain, CASE WHEN s_suppkey % 9 <> 0 THEN round(s_acctbal) END AS stars, s_suppkey * 31 % 200 AS gain, s_acctbal > 0 AS ok_desc, CASE WHEN s_suppkey % 8 <> 0 THEN s_suppkey % 5 <> 0 END AS ok_home FROM supplier)
    SELECT id, CASE WHEN ok_desc AND coalesce(ok_home, false) AND gain >= 100 THEN 'queue' WHEN ok_desc AND coalesce(ok_home, false) AND gain >= 50 THEN 'watch' END AS tier,
           row_number() OVER (PARTITION BY domain ORDER BY stars DESC NULLS LAST, id) AS rank_in_domain FROM b
    """
)
def candidate_pool(spark, sf_dir):
    """Projects with their filters as columns, a tier by weekly gain and the rank in their domain."""
    k = F.col("s_suppkey")
    pool = table(spark, sf_dir, "supplier").select(
        k.alias("id"), F.concat(F.lit("d"), (k % 30).cast("string")).alias("domain"), F.when(k % 9 != 0, F.round("s_acctbal")).alias("stars"), (k * 31 % 200).alias("gain"), (F.col("s_acctbal") > 0).alias("ok_desc"), F.when(k % 8 != 0, k % 5 != 0).alias("ok_home")
    )
    return market.candidate_tiers(pool, ["ok_desc", "ok_home"], "gain", queue=100, watch=50).select("id", "tier", "rank_in_domain")


@query(
    """
    WITH c AS (SELECT c_custkey AS id, lower(c_name) AS name FROM customer), b AS (SELECT s_suppkey * 3 AS company_id, CASE WHEN s_suppkey % 2 = 0 THEN 'customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') END AS name FROM supplier)
    SELECT id FROM c WHERE id NOT IN (SELECT company_id FROM b) AND name NOT IN (SELECT name FROM b WHERE name IS NOT NULL)
    """
)
def boards_to_find(spark, sf_dir):
    """Companies that no known board belongs to, by id or by name."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lower("c_name").alias("name"))
    k = F.col("s_suppkey")
    b = table(spark, sf_dir, "supplier").select((k * 3).alias("id"), F.when(k % 2 == 0, F.concat(F.lit("customer#"), F.lpad(k.cast("string"), 9, "0"))).alias("name"))
    return c.join(b.select("id"), "id", "left_anti").join(b.select("name").where("name is not null"), "name", "left_anti").select("id")


@query(
    """
    WITH o AS (SELECT o_custkey AS k, 'p' || (o_orderkey % 6) AS name, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS role, o_orderkey % 5 = 0 AS has_exit, ['x' || (o_orderkey % 3)] AS bg, o_orderkey,
                 row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2, o_orderkey % 6 ORDER BY o_orderkey) AS n, o_orderkey % 2 AS side FROM orders),
    a AS (SELECT * FROM o WHERE side = 0 AND n = 1), b AS (SELECT o_custkey AS k, 'P' || (m * 2 % 6) AS name, role, has_exit, bg FROM (SELECT o_custkey, o_orderkey % 3 AS m, CASE WHEN min(o_orderkey) % 2 = 1 THEN 'r' END AS role, bool_or(o_orderkey % 4 = 0) AS has_exit, ['y'] AS bg FROM orders GROUP BY 1, 2))
    SELECT coalesce(a.k, b.k) AS o_custkey, coalesce(a.name, b.name) AS name, coalesce(a.role, b.role) AS role, coalesce(a.has_exit, false) OR coalesce(b.has_exit, false) AS has_exit, array_to_string(list_sort(list_concat(coalesce(a.bg, []), coalesce(b.bg, []))), ',') AS background
    FROM a FULL JOIN b ON a.k = b.k AND lower(a.name) = lower(b.name)
    """
)
def people_merge(spark, sf_dir):
    """People of two sources by name: gaps filled, flags or-ed, lists united."""
    k, o = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    first = relational.latest_by(o.where(k % 2 == 0).withColumn("who", k % 6), ["o_custkey", "who"], [k])
    old = first.select("o_custkey", F.concat(F.lit("p"), F.col("who").cast("string")).alias("name"), F.when(k % 3 != 0, F.col("o_orderpriority")).alias("role"), (k % 5 == 0).alias("has_exit"), F.array(F.concat(F.lit("x"), (k % 3).cast("string"))).alias("background"))
    per = o.withColumn("m", k % 3).groupBy("o_custkey", "m").agg(F.min("o_orderkey").alias("low"), F.bool_or(k % 4 == 0).alias("has_exit"))
    new = per.select("o_custkey", F.concat(F.lit("P"), (F.col("m") * 2 % 6).cast("string")).alias("name"), F.when(F.col("low") % 2 == 1, "r").alias("role"), "has_exit", F.array(F.lit("y")).alias("background"))
    return market.merged_people(old, new, "o_custkey").withColumn("background", F.array_join("background", ","))


@query(
    """
    WITH p AS (SELECT c_custkey % 300 AS k, 'p' || c_custkey AS name, CASE c_custkey // 300 % 3 WHEN 0 THEN 'CEO' WHEN 1 THEN 'cto and founder' ELSE 'Sales' END AS role FROM customer),
    n AS (SELECT DISTINCT c_nationkey AS k, 'p' || (c_nationkey + 300) AS name FROM customer WHERE c_nationkey % 2 = 0)
    SELECT p.k, p.name, CASE WHEN n.k IS NOT NULL AND role = 'cto and founder' AND p.name <> n.name THEN 'Former ' || role ELSE role END AS role FROM p LEFT JOIN n ON n.k = p.k
    """
)
def replaced_executives(spark, sf_dir):
    """Executives whose office a named newcomer has taken."""
    k = F.col("c_custkey")
    kind = F.floor(k / 300) % 3
    people = table(spark, sf_dir, "customer").select((k % 300).alias("k"), F.concat(F.lit("p"), k.cast("string")).alias("name"), F.when(kind == 0, "CEO").when(kind == 1, "cto and founder").otherwise("Sales").alias("role"))
    n = F.col("c_nationkey")
    named = table(spark, sf_dir, "customer").select(n.cast("long").alias("k"), F.concat(F.lit("P"), (n + 300).cast("string")).alias("name"), F.lit("CTO").alias("role"), (n % 2 == 0).alias("appointed")).distinct()
    return market.retired(people, named, "k")


@query(
    """
    WITH h AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, o_orderkey % 500 AS n, o_orderkey FROM orders WHERE o_orderstatus <> 'P')
    SELECT o_custkey, arg_max(n, (day, o_orderkey)) AS n FROM h WHERE day >= DATE '2001-08-01' - 730 AND day <= DATE '2001-08-01' GROUP BY 1
    """
)
def current_headcount(spark, sf_dir):
    """The newest measured headcount that is no older than 730 days."""
    h = table(spark, sf_dir, "orders").where("o_orderstatus != 'P'").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"), (F.col("o_orderkey") % 500).alias("n"), "o_orderkey")
    fresh = h.where((F.col("day") >= F.date_sub(_today(), 730)) & (F.col("day") <= _today()))
    return relational.latest_values(fresh, ["o_custkey"], F.struct("day", "o_orderkey"), ["n"])


@query(
    """
    WITH m AS (SELECT a.vec_id AS id, b.vec_id AS user_id, greatest(0, least(100, round(100 * round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9)))) AS pct FROM embeddings a, embeddings b WHERE b.vec_id IN (1, 2, 3) AND a.vec_id % 5 = 0 AND a.vec_id % 30 < 14)
    SELECT user_id, id, pct, 'thesis_match:' || id AS dedupe_key FROM m WHERE pct >= 10 AND NOT (id % 7 = user_id)
    """
)
def thesis_alerts(spark, sf_dir):
    """Alerts for young companies that match a user's vector and that the user doesn't hold yet."""
    e, k = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    users = e.where(k.isin(1, 2, 3)).select(k.alias("user_id"), F.col("embedding").alias("wish"))
    fresh = e.select(k.alias("id"), "embedding", (k % 5 == 0).alias("embedded_now"), (k % 30).alias("days")).where("embedded_now and days < 14")
    pairs = relational.every_pair(fresh, users, "id", "user_id")
    held = e.where(k % 7 < 4).select((k % 7).alias("user_id"), k.alias("id"))
    from tessera.functions import vectors

    scored = pairs.select("user_id", "id", vectors.percent(F.round(vectors.cosine(F.col("embedding"), F.col("wish")), 9)).alias("pct")).where("pct >= 10")
    return scored.join(held, ["user_id", "id"], "left_anti").withColumn("dedupe_key", F.concat(F.lit("thesis_match:"), F.col("id").cast("string")))


@query(
    """
    WITH o AS (SELECT user_id, event_id, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE event_type = 'purchase')
    SELECT user_id, event_id, round(value - before, 4) AS gain, 'velocity:' || user_id || ':' || strftime(ts, '%Y%m%d%H%M%S') AS dedupe_key FROM o WHERE ts >= TIMESTAMP '2024-01-20' AND value - before >= 20 AND user_id % 3 = 0
    """
)
def velocity_alerts(spark, sf_dir):
    """Alerts for watched companies that gained enough since the observation before."""
    run = W.partitionBy("user_id").orderBy("ts", "event_id")
    o = table(spark, sf_dir, "events").where("event_type = 'purchase'").withColumn("gain", F.col("value") - F.lag("value").over(run))
    kept = o.where((F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")) & (F.col("gain") >= 20) & (F.col("user_id") % 3 == 0))
    return kept.select("user_id", "event_id", F.round("gain", 4).alias("gain"), F.concat_ws(":", F.lit("velocity"), F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMddHHmmss")).alias("dedupe_key"))


@query(
    """
    WITH f AS (SELECT s_suppkey AS company_id, CASE WHEN s_suppkey % 3 <> 0 THEN DATE '2001-12-01' - CAST(s_suppkey * 37 % 900 AS INT) END AS filed, CASE WHEN s_suppkey % 4 <> 0 THEN DATE '2001-12-01' - CAST(s_suppkey * 53 % 1400 AS INT) END AS patent, s_suppkey % 4 AS classes FROM supplier),
    p AS (SELECT company_id, CASE WHEN DATE '2001-12-01' - filed <= 180 THEN 25 WHEN DATE '2001-12-01' - filed <= 365 THEN 15 WHEN DATE '2001-12-01' - filed <= 730 THEN 5 ELSE 0 END AS pts_inception,
                 CASE WHEN DATE '2001-12-01' - patent <= 365 THEN 10 WHEN DATE '2001-12-01' - patent <= 730 THEN 6 WHEN DATE '2001-12-01' - patent <= 1095 THEN 3 ELSE 0 END + CASE WHEN patent IS NOT NULL AND classes >= 2 THEN 5 ELSE 0 END AS pts_ip FROM f)
    SELECT *, greatest(0, least(100, pts_inception + pts_ip)) AS early_score FROM p
    """
)
def filing_points(spark, sf_dir):
    """Points for registry filings and patents, from the filings themselves."""
    k, at = F.col("s_suppkey"), F.lit("2001-12-01").cast("date")
    s = table(spark, sf_dir, "supplier")
    none = F.array().cast("array<string>")
    registry = s.where(k % 3 != 0).select(k.alias("company_id"), F.lit("sec_form_d").alias("source"), F.date_sub(at, (k * 37 % 900).cast("int")).alias("filing_date"), none.alias("classification_codes"))
    codes = F.transform(F.sequence(F.lit(1), F.greatest(k % 4, F.lit(1)).cast("int")), lambda i: F.concat(F.lit("G06"), i.cast("string"), F.lit("/10")))
    patents = s.where(k % 4 != 0).select(k.alias("company_id"), F.lit("epo_ops").alias("source"), F.date_sub(at, (k * 53 % 1400).cast("int")).alias("filing_date"), codes.alias("classification_codes"))
    facts = scoring.filing_facts(registry.unionByName(patents))
    blank = ("founding_signals", "stealth_signals", "active_jobs", "avg_days_to_fill", "scaled_functions", "founded_year")
    full = s.select(k.alias("company_id")).join(facts, "company_id", "left").select("*", *[F.lit(None).cast("int").alias(c) for c in blank], F.lit(None).cast("date").alias("latest_job_seen"))
    return scoring.early_points(full, as_of=at).select("company_id", "pts_inception", "pts_ip", "early_score")


@query(
    """
    SELECT k % 12 AS batch, count(*) AS marked, count(*) FILTER (WHERE right_) AS correct, round(sum(count(*) FILTER (WHERE right_)) OVER (ORDER BY k % 12) * 1.0 / sum(count(*)) OVER (ORDER BY k % 12), 4) AS share_to_date
    FROM (SELECT doc_id AS k, quality = 1 AS right_ FROM labels) GROUP BY 1
    """
)
def accuracy_to_date(spark, sf_dir):
    """Accuracy of each batch of marks and of all so far."""
    marks = table(spark, sf_dir, "labels").select((F.col("doc_id") % 12).alias("batch"), F.when(F.col("quality") == 1, "correct").otherwise("wrong").alias("mark"))
    return market.accuracy_to_date(marks, "batch")


@query(
    """
    SELECT 'price' AS "check", count(*) AS rows, count(*) FILTER (WHERE NOT coalesce(o_totalprice > 1000, false)) AS failed FROM orders UNION ALL SELECT 'status', count(*), count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) FROM orders
    UNION ALL SELECT 'known', count(*), count(*) FILTER (WHERE o_orderkey % 10 = 0) FROM orders
    """
)
def acceptance_checks(spark, sf_dir):
    """Declared checks over report rows, and how many rows fail each; what is unknown fails."""
    known = F.when(F.col("o_orderkey") % 10 != 0, F.lit(True))
    return market.failed_checks(table(spark, sf_dir, "orders"), {"price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus").isin("F", "O"), "known": known})


@query(
    """
    SELECT CASE WHEN n = 0 THEN 'none' WHEN n <= 5 THEN '1-5' WHEN n <= 12 THEN '6-12' ELSE 'more' END AS bucket, count(*) AS companies FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) GROUP BY 1
    """
)
def coverage_buckets(spark, sf_dir):
    """Companies by how many children are known."""
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "customer").join(n, "c_custkey", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return c.groupBy(F.when(F.col("n") == 0, "none").when(F.col("n") <= 5, "1-5").when(F.col("n") <= 12, "6-12").otherwise("more").alias("bucket")).agg(F.count("*").alias("companies"))


@query(
    """
    SELECT o_orderpriority AS kind, count(*) FILTER (WHERE o_orderstatus = 'P') AS pending, min(CAST(o_orderdate AS DATE)) FILTER (WHERE o_orderstatus = 'P') AS oldest, count(*) FILTER (WHERE o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '2001-06-01') AS overdue FROM orders GROUP BY 1
    """
)
def review_summary(spark, sf_dir):
    """What waits for review, by kind."""
    open_, day = F.col("o_orderstatus") == "P", F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count(F.when(open_, 1)).alias("pending"), F.min(F.when(open_, day)).alias("oldest"), F.count(F.when(open_ & (day < F.lit("2001-06-01").cast("date")), 1)).alias("overdue"))


@query("SELECT c_custkey AS company_id, 'Other' AS round_type, CAST(NULL AS DOUBLE) AS amount FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT o_custkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderkey % 10 = 0")
def integrity_stubs(spark, sf_dir):
    """A stub for every company without rounds, beside (a tenth of) the rounds there are."""
    o = table(spark, sf_dir, "orders")
    bare = table(spark, sf_dir, "customer").join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select(F.col("c_custkey").alias("company_id"), F.lit("Other").alias("round_type"), F.lit(None).cast("double").alias("amount"))
    return bare.unionByName(o.where(F.col("o_orderkey") % 10 == 0).select(F.col("o_custkey").alias("company_id"), F.col("o_orderpriority").alias("round_type"), F.col("o_totalprice").alias("amount")))


@query(
    """
    WITH r AS (SELECT o_orderkey, o_totalprice AS v FROM orders WHERE o_orderkey % 4 <> 1), d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN v + 1 ELSE v END AS v FROM r WHERE o_orderkey % 6 <> 0)
    SELECT r.o_orderkey, CASE WHEN d.o_orderkey IS NULL THEN 'missing' ELSE 'differs' END AS problem FROM r LEFT JOIN d USING (o_orderkey) WHERE d.o_orderkey IS NULL OR d.v <> r.v
    """
)
def unverified_writes(spark, sf_dir):
    """Values that a report says were written and the table doesn't hold."""
    k = F.col("o_orderkey")
    said = table(spark, sf_dir, "orders").where(k % 4 != 1).select("o_orderkey", F.col("o_totalprice").alias("v"))
    held = said.where(k % 6 != 0).withColumn("v", F.when(k % 9 == 0, F.col("v") + 1).otherwise(F.col("v")))
    found = keyed.diff(said, held, ["o_orderkey"], "v").where(F.col("status").isin("lost", "changed"))
    return found.select("o_orderkey", F.when(F.col("status") == "lost", "missing").otherwise("differs").alias("problem"))


@query(
    """
    SELECT a.o_orderkey, b.o_orderkey AS sibling FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.o_orderkey <> b.o_orderkey WHERE a.o_orderkey % 50 = 0 AND b.o_orderstatus = a.o_orderstatus
    """
)
def sibling_scan(spark, sf_dir):
    """Other values with the fault of a wrong one."""
    o = table(spark, sf_dir, "orders")
    wrong = o.where(F.col("o_orderkey") % 50 == 0).select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    return wrong.join(o.select("o_custkey", "o_orderpriority", "o_orderstatus", F.col("o_orderkey").alias("sibling")), ["o_custkey", "o_orderpriority", "o_orderstatus"]).where("o_orderkey != sibling").select("o_orderkey", "sibling")


@query(
    """
    SELECT count(*) AS pool, count(*) FILTER (WHERE c_acctbal > 0) AS with_balance, count(*) FILTER (WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING') AS of_segment, count(*) FILTER (WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING' AND c_nationkey < 10) AS of_country FROM customer
    """
)
def funnel_counts(spark, sf_dir):
    """How many rows each further filter leaves, in one pass."""
    steps = {"with_balance": F.col("c_acctbal") > 0, "of_segment": F.col("c_mktsegment") == "BUILDING", "of_country": F.col("c_nationkey") < 10}
    held, counts = F.lit(True), [F.count("*").alias("pool")]
    for name, step in steps.items():
        held = held & step
        counts.append(F.count(F.when(held, 1)).alias(name))
    return table(spark, sf_dir, "customer").agg(*counts)


@query(
    """
    SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE (SELECT max(o_orderpriority) FROM orders WHERE o_custkey = c_custkey) END AS segment, CASE WHEN c_custkey % 2 <> 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'derived' WHEN c_custkey % 2 = 0 THEN 'own' END AS origin FROM customer
    """
)
def patched_fields(spark, sf_dir):
    """Missing columns filled from what is on file, and where each came from."""
    derived = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("derived"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("own")).join(derived, "c_custkey", "left")
    return c.select("c_custkey", F.coalesce("own", "derived").alias("segment"), F.when(F.col("own").isNotNull(), "own").when(F.col("derived").isNotNull(), "derived").alias("origin"))


@query(
    """
    WITH c AS (SELECT c_custkey AS id, lower('site' || (c_custkey % 300) || '.com') AS site, lower(c_name) AS name FROM customer WHERE c_custkey % 2 = 0),
    s AS (SELECT s_suppkey AS row, CASE WHEN s_suppkey % 3 <> 0 THEN 'site' || s_suppkey || '.com' END AS site, 'customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS name FROM supplier),
    m AS (SELECT s.row, (SELECT min(id) FROM c WHERE c.site = s.site) AS by_site, (SELECT min(id) FROM c WHERE c.name = s.name) AS by_name FROM s)
    SELECT row, coalesce(by_site, by_name) AS company_id, CASE WHEN coalesce(by_site, by_name) IS NULL THEN 'insert' ELSE 'existing' END AS action FROM m
    """
)
def seed_import(spark, sf_dir):
    """What importing a seed list does: rows that are there by site, else by name, are left as they are."""
    k, r = F.col("c_custkey"), F.col("s_suppkey")
    c = table(spark, sf_dir, "customer").where(k % 2 == 0).select(k.alias("company_id"), F.concat(F.lit("site"), (k % 300).cast("string"), F.lit(".com")).alias("site_key"), F.lower("c_name").alias("name_key"))
    s = table(spark, sf_dir, "supplier").select(r.alias("row"), F.when(r % 3 != 0, F.concat(F.lit("site"), r.cast("string"), F.lit(".com"))).alias("site"), F.concat(F.lit("customer#"), F.lpad(r.cast("string"), 9, "0")).alias("name"))
    sites = c.groupBy("site_key").agg(F.min("company_id").alias("company_id"))
    linked = resolve.cascade(s, "row", [("site", sites, "site_key"), ("name", c.select("name_key", "company_id"), "name_key")])
    return linked.select("row", "company_id", F.when(F.col("company_id").isNull(), "insert").otherwise("existing").alias("action"))


@query(
    """
    SELECT c_custkey, strftime(DATE '2000-01-05' + CAST(c_custkey % 500 AS INT), '%b %d, %Y') AS shown, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 3 END AS n_items FROM customer
    """
)
def shown_dates(spark, sf_dir):
    """Dates as they are shown, and the length of a list that may be something else."""
    k = F.col("c_custkey")
    body = F.when(k % 3 == 0, F.lit('{"a": 1}')).when(k % 3 == 1, F.lit("[1]")).otherwise(F.lit("[1, 2]"))
    items = F.try_variant_get(F.parse_json(body), "$", "array<variant>")
    day = F.date_add(F.lit("2000-01-05").cast("date"), (k % 500).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.date_format(day, "MMM dd, yyyy").alias("shown"), F.coalesce(F.size(items), F.lit(0)).cast("long").alias("n_items"))


@query(
    """
    SELECT c_custkey, '{"id":' || c_custkey || CASE WHEN c_acctbal > 0 THEN ',"segment":"' || c_mktsegment || '"' ELSE '' END || '}' AS evidence,
           array_to_string(list_filter(['r' || (c_custkey % 5), CASE WHEN c_custkey % 2 = 0 THEN 'hidden' END, 'market' || (c_custkey % 3)], lambda x: x IS NOT NULL AND x <> 'hidden'), ',') AS visible FROM customer
    """
)
def built_objects(spark, sf_dir):
    """Objects without their nulls, and the visible ones of a list of structs."""
    k = F.col("c_custkey")
    evidence = F.to_json(F.struct(k.alias("id"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("segment")))

    def rival(name, hidden):
        return F.struct(name.alias("name"), hidden.alias("hidden"))

    rivals = F.array(rival(F.concat(F.lit("r"), (k % 5).cast("string")), F.lit(None).cast("boolean")), F.when(k % 2 == 0, rival(F.lit("x"), F.lit(True))), rival(F.concat(F.lit("market"), (k % 3).cast("string")), F.lit(False)))
    seen = F.filter(rivals, lambda r: r.isNotNull() & ~F.coalesce(r["hidden"], F.lit(False)))
    return table(spark, sf_dir, "customer").select("c_custkey", evidence.alias("evidence"), F.array_join(F.transform(seen, lambda r: r["name"]), ",").alias("visible"))


@query(
    """
    SELECT o_custkey, count(*) FILTER (WHERE t IN ('registry', 'plan')) AS official, count(*) FILTER (WHERE t NOT IN ('registry', 'plan')) AS reported, bool_or(t = 'observed') AS live, arg_min(n, (o_orderdate, o_orderkey)) AS first_value
    FROM (SELECT o_custkey, o_orderkey, o_orderdate, o_orderkey % 50 AS n, CASE o_orderkey % 6 WHEN 0 THEN 'registry' WHEN 1 THEN 'plan' WHEN 2 THEN 'observed' WHEN 3 THEN 'press' WHEN 4 THEN 'model_estimate' ELSE 'legacy' END AS t FROM orders)
    WHERE t NOT IN ('model_estimate', 'legacy') AND n > 0 GROUP BY 1
    """
)
def chart_series(spark, sf_dir):
    """Points of a headcount chart: estimates and old records out, official ones apart."""
    k = F.col("o_orderkey")
    kind = F.get(F.array(*map(F.lit, ("registry", "plan", "observed", "press", "model_estimate", "legacy"))), (k % 6).cast("int"))
    p = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", (k % 50).alias("n"), kind.alias("t")).where(~F.col("t").isin("model_estimate", "legacy") & (F.col("n") > 0))
    official = F.col("t").isin("registry", "plan")
    return p.groupBy("o_custkey").agg(F.count(F.when(official, 1)).alias("official"), F.count(F.when(~official, 1)).alias("reported"), F.bool_or(F.col("t") == "observed").alias("live"), F.min_by("n", F.struct("o_orderdate", "o_orderkey")).alias("first_value"))


@query(
    """
    WITH f AS (SELECT s_nationkey AS manager, s_suppkey, round(s_acctbal, 2) AS sold, CAST(s_suppkey % 6 AS INT) AS series FROM supplier)
    SELECT manager, count(*) AS funds, max(series) AS latest_series, round(sum(sold), 2) AS sold, max(CAST(s_suppkey AS VARCHAR)) AS last_id, array_to_string(list_sort(list(DISTINCT 'm' || (s_suppkey % 4))), ',') AS managers FROM f GROUP BY 1
    """
)
def fund_firms(spark, sf_dir):
    """A row for each fund manager: funds, newest series, amounts and people."""
    k = F.col("s_suppkey")
    f = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("manager"), k, F.round("s_acctbal", 2).alias("sold"), (k % 6).cast("int").alias("series"), F.array(F.concat(F.lit("m"), (k % 4).cast("string"))).alias("people"))
    people = f.select("manager", F.explode("people").alias("p")).groupBy("manager").agg(F.array_join(F.array_sort(F.collect_set("p")), ",").alias("managers"))
    per = f.groupBy("manager").agg(F.count("*").alias("funds"), F.max("series").alias("latest_series"), F.round(F.sum("sold"), 2).alias("sold"), F.max(k.cast("string")).alias("last_id"))
    return per.join(people, "manager")


@query(
    """
    WITH m AS (SELECT doc_id % 7 AS field, CASE WHEN doc_id % 11 = 0 AND doc_id % 7 < 3 THEN 'pending' WHEN quality = 1 THEN 'correct' ELSE 'wrong' END AS mark FROM labels),
    c AS (SELECT field, count(*) FILTER (WHERE mark <> 'pending') AS marks, count(*) FILTER (WHERE mark = 'correct') AS correct, count(*) FILTER (WHERE mark = 'pending') AS pending FROM m GROUP BY 1)
    SELECT field, marks, correct, pending, marks >= 5 AND correct >= 0.7 * marks AND pending = 0 AS open FROM c
    """
)
def field_status(spark, sf_dir):
    """Whether fields may be opened: enough marks, enough of them right, none pending."""
    k = F.col("doc_id")
    mark = F.when((k % 11 == 0) & (k % 7 < 3), "pending").when(F.col("quality") == 1, "correct").otherwise("wrong")
    return quality.field_status(table(spark, sf_dir, "labels").select((k % 7).alias("field"), mark.alias("mark")), least=5, share=0.7)


@query(
    """
    SELECT 'segment' AS field, count(*) FILTER (WHERE c_custkey % 3 <> 0) AS with_value, count(*) FILTER (WHERE c_custkey % 3 <> 0 AND c_custkey % 2 = 0) AS with_source, round(100.0 * count(*) FILTER (WHERE c_custkey % 3 <> 0 AND c_custkey % 2 = 0) / count(*) FILTER (WHERE c_custkey % 3 <> 0), 1) AS pct FROM customer
    UNION ALL SELECT 'balance', count(*), count(*) FILTER (WHERE c_custkey % 5 = 0), round(100.0 * count(*) FILTER (WHERE c_custkey % 5 = 0) / count(*), 1) FROM customer
    """
)
def provenance_coverage(spark, sf_dir):
    """Fields with a value, and with a source beside it."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(F.when(k % 3 != 0, F.col("c_mktsegment")).alias("segment"), F.when(k % 2 == 0, k).alias("segment_source"), F.col("c_acctbal").alias("balance"), F.when(k % 5 == 0, k).alias("balance_source"))
    return quality.coverage_by_field(c, ["segment", "balance"], ["segment_source", "balance_source"])


@query(
    """
    WITH s AS (SELECT o_orderkey, md5('m:64:' || o_orderpriority || o_orderstatus) AS h FROM orders), t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN h ELSE 'old' END AS stored FROM s WHERE o_orderkey % 5 <> 0)
    SELECT s.o_orderkey, h AS content_hash, t.stored IS NULL AS is_new FROM s LEFT JOIN t USING (o_orderkey) WHERE t.stored IS NULL OR t.stored <> h
    """
)
def changed_texts(spark, sf_dir):
    """Rows whose text has changed since it was embedded, or never was."""
    k, text = F.col("o_orderkey"), F.concat("o_orderpriority", "o_orderstatus")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    stored = o.where(k % 5 != 0).select("o_orderkey", F.when(k % 3 == 0, F.md5(F.concat_ws(":", F.lit("m"), F.lit("64"), text))).otherwise("old").alias("content_hash"))
    return keyed.unchanged_removed(o, stored, "o_orderkey", model="m", dimensions=64, text=text).select("o_orderkey", "content_hash", "is_new")


@query(
    """
    WITH b AS (SELECT c_custkey AS id, 'base' AS v FROM customer), p AS (SELECT s_suppkey * 2 AS id, 'patch' AS v FROM supplier)
    SELECT id, v FROM b WHERE id NOT IN (SELECT id FROM p) UNION ALL SELECT id, v FROM p
    """
)
def run_overlay(spark, sf_dir):
    """Rows of a second run in place of those of the first."""
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("base").alias("v"))
    return keyed.overlay(base, table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).alias("id"), F.lit("patch").alias("v")), "id")


@query(
    """
    WITH w AS (SELECT o_orderkey % 2000 AS id, o_orderkey AS seq, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderstatus END AS old_value, o_orderpriority AS new_value FROM orders),
    s AS (SELECT id, arg_min(seq, seq) AS a, arg_max(new_value, seq) AS wrote FROM w GROUP BY 1), x AS (SELECT s.id, (SELECT old_value FROM w WHERE w.seq = s.a) AS old_value, wrote FROM s),
    c AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'other' ELSE wrote END AS now FROM x WHERE id % 5 <> 0)
    SELECT x.id, old_value, CASE WHEN c.id IS NULL THEN 'skip: gone' WHEN now <> wrote THEN 'skip: changed since' WHEN old_value IS NULL THEN 'delete' ELSE 'restore' END AS action FROM x LEFT JOIN c USING (id)
    """
)
def undo_plan(spark, sf_dir):
    """What undoing a run does to each value."""
    k = F.col("o_orderkey")
    w = table(spark, sf_dir, "orders").select((k % 2000).alias("id"), k.alias("seq"), F.when(k % 9 != 0, F.col("o_orderstatus")).alias("old_value"), F.col("o_orderpriority").alias("new_value"))
    last = w.groupBy("id").agg(F.max_by("new_value", "seq").alias("wrote"))
    now = last.where("id % 5 != 0").select("id", F.when(F.col("id") % 4 == 0, "other").otherwise(F.col("wrote")).alias("value"))
    return keyed.undo_plan(w, now, ["id"]).select("id", "old_value", "action")


@query(
    """
    WITH g AS (SELECT c_custkey, c_nationkey || '/' || c_mktsegment AS value, CAST(round(c_acctbal) AS BIGINT) AS richness FROM customer WHERE c_custkey % 3 = 0),
    n AS (SELECT value FROM g GROUP BY 1 HAVING count(*) > 1), b AS (SELECT value, arg_min(c_custkey, (-coalesce(richness, 0), c_custkey)) AS survivor FROM g WHERE value IN (SELECT value FROM n) GROUP BY 1)
    SELECT value, c_custkey AS loser, survivor FROM g JOIN b USING (value) WHERE c_custkey <> survivor
    """
)
def tier1_survivors(spark, sf_dir):
    """Who stays of each group that shares an identifier: the richest, the least id where they tie."""
    c = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 3 == 0)
    ids = c.select(F.col("c_custkey").alias("entity_id"), F.lit("site").alias("kind"), F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("value"))
    rich = c.select(F.col("c_custkey").alias("entity_id"), F.round("c_acctbal").cast("long").alias("richness"))
    return resolve.survivors(resolve.identifier_groups(ids, ["site"]), rich).select("value", "loser", "survivor")


@query(
    """
    WITH p AS (SELECT a.c_custkey AS l, b.c_custkey AS r FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey)
    SELECT l AS left_id, r AS right_id FROM p WHERE (l + r) % 4 <> 0
    """
)
def undecided_pairs(spark, sf_dir):
    """Candidate pairs that no reviewer has decided, in either order; all pairs of a key are candidates."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.col("c_nationkey").cast("string"), F.lit("/"), "c_mktsegment").alias("key"))
    pairs = resolve.same_key_pairs(c, "key", "c_custkey")
    decided = pairs.where((F.col("left_id") + F.col("right_id")) % 4 == 0).select(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id"))
    return resolve.undecided_pairs(c, "key", "c_custkey", decided)


@query(
    """
    WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS turn FROM customer), s AS (SELECT c_custkey, c_mktsegment FROM r ORDER BY turn, c_mktsegment LIMIT 33)
    SELECT c_custkey, c_mktsegment FROM s
    """
)
def spread_pick(spark, sf_dir):
    """Rows in turn from each bucket (a sample of 33)."""
    return relational.spread_pick(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", [F.col("c_custkey")], 33)


@query(
    """
    WITH f AS (SELECT o_custkey, o_orderkey, md5('0:' || o_orderkey) AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('0:' || o_orderkey), o_orderkey) AS n, o_totalprice AS h FROM orders), k AS (SELECT * FROM f WHERE n <= 2),
    a AS (SELECT o_orderkey, 'random' AS drawn FROM k ORDER BY d, o_orderkey LIMIT 25)
    SELECT * FROM a UNION ALL SELECT * FROM (SELECT o_orderkey, 'hard' AS drawn FROM k WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a) ORDER BY h DESC, o_orderkey LIMIT 25)
    """
)
def audit_draw(spark, sf_dir):
    """A draw for an audit: some at random, some of the hardest, two of a company at most."""
    return quality.audit_draw(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", F.col("o_totalprice")).select("o_orderkey", "drawn")


@query(
    """
    WITH d AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'lost' WHEN 1 THEN 'changed' WHEN 2 THEN 'added' ELSE 'same' END AS status FROM orders) SELECT status, count(*) AS "count", status NOT IN ('lost', 'changed') AS holds FROM d GROUP BY 1
    """
)
def regression_gate(spark, sf_dir):
    """Counts of a comparison by status, and whether each may pass."""
    kind = F.get(F.array(*map(F.lit, ("lost", "changed", "added", "same", "same"))), (F.col("o_orderkey") % 5).cast("int"))
    d = table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("status"))
    return quality.gate(d, d)


@query(
    """
    WITH c AS (SELECT c_custkey AS id, 'https://' || CASE WHEN c_custkey % 2 = 0 THEN 'www.' ELSE '' END || 'site' || c_custkey || '.com/x' AS website, CASE WHEN c_custkey % 4 = 0 THEN 'p' || c_custkey END AS profile FROM customer), s AS (SELECT s_suppkey, 'site' || (s_suppkey * 3) || '.com' AS domain, 'p' || (s_suppkey * 8) AS profile FROM supplier)
    SELECT s_suppkey, min(id) AS found FROM (SELECT s_suppkey, id FROM s JOIN c ON 'https://site' || (s_suppkey * 3) || '.com/x' = website OR 'https://www.site' || (s_suppkey * 3) || '.com/x' = website UNION SELECT s_suppkey, id FROM s JOIN c USING (profile)) GROUP BY 1
    """
)
def existing_companies(spark, sf_dir):
    """Companies that are there already, by domain or by profile; two equi-joins in place of an OR."""
    k, r = F.col("c_custkey"), F.col("s_suppkey")
    c = table(spark, sf_dir, "customer").select(k.alias("id"), web.registrable_domain(F.concat(F.lit("https://"), F.when(k % 2 == 0, "www.").otherwise(""), F.lit("site"), k.cast("string"), F.lit(".com/x"))).alias("domain"), F.when(k % 4 == 0, F.concat(F.lit("p"), k.cast("string"))).alias("profile"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("site"), (r * 3).cast("string"), F.lit(".com")).alias("domain"), F.concat(F.lit("p"), (r * 8).cast("string")).alias("profile"))
    found = s.join(c.select("id", "domain"), "domain").select("s_suppkey", "id").unionByName(s.join(c.select("id", "profile"), "profile").select("s_suppkey", "id"))
    return found.groupBy("s_suppkey").agg(F.min("id").alias("found"))


@query(
    """
    WITH e AS (SELECT 'n' || (o_orderkey % 700) AS key, o_orderkey, o_orderpriority AS v, o_orderkey % 4 = 0 AS alert FROM orders), old AS (SELECT key, arg_min(v, o_orderkey) AS v, bool_or(alert) AS alert FROM e WHERE o_orderkey % 2 = 0 GROUP BY 1), new AS (SELECT key, arg_min(v, o_orderkey) AS v, bool_or(alert OR o_orderkey % 3 = 0) AS alert FROM e WHERE o_orderkey % 5 = 1 GROUP BY 1)
    SELECT coalesce(old.key, new.key) AS key, coalesce(new.v, old.v) AS v, coalesce(old.alert, false) OR coalesce(new.alert, false) AS alert FROM old FULL JOIN new ON old.key = new.key
    """
)
def candidate_upsert(spark, sf_dir):
    """Candidates by key: values are renewed, an alert only ever upgrades."""
    k = F.col("o_orderkey")
    e = table(spark, sf_dir, "orders").select(F.concat(F.lit("n"), (k % 700).cast("string")).alias("key"), k, F.col("o_orderpriority").alias("v"))
    old = e.where(k % 2 == 0).groupBy("key").agg(F.min_by("v", "o_orderkey").alias("v"), F.bool_or(k % 4 == 0).alias("alert"))
    new = e.where(k % 5 == 1).groupBy("key").agg(F.min_by("v", "o_orderkey").alias("v"), F.bool_or((k % 4 == 0) | (k % 3 == 0)).alias("alert"))
    return keyed.upsert(old, new, ["key"], {"v": keyed.NEW, "alert": keyed.EITHER})
