"""Records of foreign formats, written from the tables and read back by the readers; streams' operators on tables at rest."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import scoring
from tessera.plans.catalog import query
from tessera.sources import tables
from tessera.sources.tables import table
from tessera.streaming import events


@query(
    """
    SELECT p_partkey // 50 AS page, CAST(p_partkey AS VARCHAR) AS external_job_id, p_name AS title, CASE WHEN p_partkey % 7 <> 0 THEN 'https://jobs.example.com/' || p_partkey END AS url, p_type AS location, p_brand AS department,
           CASE WHEN (p_partkey // 50) % 2 = 0 THEN 'greenhouse' ELSE 'lever' END AS provider FROM part
    """
)
def board_jobs(spark, sf_dir):
    """Jobs of two providers' boards, 50 to a response; repeated jobs once, links only to the web."""
    k = F.col("p_partkey")
    link = F.when(k % 7 != 0, F.concat(F.lit("https://jobs.example.com/"), k.cast("string"))).otherwise("javascript:void(0)")
    parts = table(spark, sf_dir, "part").select(F.floor(k / 50).alias("page"), k.alias("id"), "p_name", link.alias("link"), "p_type", "p_brand")
    parts = parts.unionByName(parts.where("id % 10 = 0"))
    one = F.struct(F.col("id"), F.col("p_name").alias("title"), F.col("link").alias("absolute_url"), F.struct(F.col("p_type").alias("name")).alias("location"), F.array(F.struct(F.col("p_brand").alias("name"))).alias("departments"))
    two = F.struct(F.col("id").cast("string").alias("id"), F.col("p_name").alias("text"), F.col("link").alias("hostedUrl"), F.struct(F.col("p_type").alias("location"), F.col("p_brand").alias("team")).alias("categories"))
    even = parts.where("page % 2 = 0").groupBy("page").agg(F.to_json(F.struct(F.collect_list(one).alias("jobs"))).alias("body"))
    odd = parts.where("page % 2 = 1").groupBy("page").agg(F.to_json(F.collect_list(two)).alias("body"))
    read = tables.read_board(even, "greenhouse").unionByName(tables.read_board(odd, "lever"))
    return read.select("page", "external_job_id", "title", "url", "location", "department", "provider")


@query("SELECT s_nationkey AS board, CAST(s_suppkey AS VARCHAR) AS external_job_id, s_name || ' & Co' AS title, 'Office ' || (s_suppkey % 5) AS location, 'D' || (s_suppkey % 3) AS department, 'personio' AS provider FROM supplier")
def xml_board_jobs(spark, sf_dir):
    """Jobs of boards written in XML."""
    k = F.col("s_suppkey").cast("string")
    item = F.concat(F.lit("<position><id>"), k, F.lit("</id><name>"), "s_name", F.lit(" &amp; Co</name><office>Office "), (F.col("s_suppkey") % 5).cast("string"), F.lit("</office><department>D"), (F.col("s_suppkey") % 3).cast("string"), F.lit("</department></position>"))
    bodies = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.concat(F.lit("<workzag-jobs>"), item, F.lit("</workzag-jobs>")).alias("body"))
    return tables.read_personio(bodies).select(F.col("s_nationkey").alias("board"), "external_job_id", "title", "location", "department", "provider")


@query(
    """
    SELECT s_suppkey, s_name AS entity_name, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS entity_number, CASE WHEN s_suppkey % 3 = 0 THEN 'Other Technology' ELSE 'Other' END AS industry_group, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey * 1000.0 END AS total_offering, s_suppkey * 10.5 AS total_sold, 'Jane Roe,Max M' || s_suppkey AS officers FROM supplier
    """
)
def offering_notices(spark, sf_dir):
    """Fields of exempt-offering notices; an amount that isn't a number is null."""
    k = F.col("s_suppkey")
    offered = F.when(k % 4 != 0, (k * 1000).cast("string")).otherwise("Indefinite")
    xml = F.concat(
        F.lit("<edgarSubmission><primaryIssuer><cik>"), F.lpad(k.cast("string"), 10, "0"), F.lit("</cik><entityName>"), "s_name", F.lit("</entityName></primaryIssuer><relatedPersonsList><relatedPersonInfo><relatedPersonName><firstName>Jane</firstName><lastName>Roe</lastName></relatedPersonName></relatedPersonInfo><relatedPersonInfo><relatedPersonName><firstName>Max</firstName><lastName>M"),
        k.cast("string"), F.lit("</lastName></relatedPersonName></relatedPersonInfo></relatedPersonsList><offeringData><industryGroup><industryGroupType>"), F.when(k % 3 == 0, "Other Technology").otherwise("Other"), F.lit("</industryGroupType></industryGroup><offeringSalesAmounts><totalOfferingAmount>"), offered,
        F.lit("</totalOfferingAmount><totalAmountSold>"), (k * 10.5).cast("decimal(18,1)").cast("string"), F.lit("</totalAmountSold></offeringSalesAmounts></offeringData></edgarSubmission>"),
    )
    n = table(spark, sf_dir, "supplier").select("s_suppkey", tables.offering_notice(xml).alias("n"))
    return n.select("s_suppkey", "n.entity_name", "n.entity_number", "n.industry_group", "n.total_offering", "n.total_sold", F.array_join("n.officers", ",").alias("officers"))


@query(
    """
    SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS entity_number, c_name AS entity_name, DATE '2000-01-01' + CAST(c_custkey % 900 AS INT) AS incorporated, '62012,' || (26000 + c_custkey % 9) AS codes, CASE WHEN c_custkey % 2 = 0 THEN 'active' END AS status FROM customer
    """
)
def register_items(spark, sf_dir):
    """A company register's items, under either of the names that a field goes by."""
    k = F.col("c_custkey")
    born = F.date_add(F.lit("2000-01-01").cast("date"), (k % 900).cast("int")).cast("string")
    codes = F.array(F.lit("62012"), (26000 + k % 9).cast("string"))
    one = F.to_json(F.struct(k.cast("string").alias("company_number"), F.col("c_name").alias("company_name"), born.alias("date_of_creation"), codes.alias("sic_codes"), F.lit("active").alias("company_status")))
    two = F.to_json(F.struct(k.cast("string").alias("number"), F.col("c_name").alias("title"), born.alias("incorporated_on"), codes.alias("sic_codes")))
    r = table(spark, sf_dir, "customer").select("c_custkey", tables.company_record(F.when(k % 2 == 0, one).otherwise(two)).alias("r"))
    return r.select("c_custkey", "r.entity_number", "r.entity_name", "r.incorporated", F.array_join("r.codes", ",").alias("codes"), "r.status")


@query(
    """
    SELECT c_custkey, 'Org' || (c_custkey % 20) || '/' || c_custkey AS external_id, 'org' || (c_custkey % 20) AS owner_login, CASE WHEN c_custkey % 3 = 0 THEN 'User' ELSE 'Organization' END AS owner_type, c_custkey * 3 AS stars, CASE WHEN c_custkey % 2 = 0 THEN 'https://site.com' END AS homepage, 100 + c_custkey % 400 AS age_days FROM customer
    """
)
def repository_items(spark, sf_dir):
    """A code host's repositories with their age."""
    k, at = F.col("c_custkey"), F.lit("2001-08-01").cast("date")
    org = F.concat(F.lit("Org"), (k % 20).cast("string"))
    born = F.concat(F.date_sub(at, (100 + k % 400).cast("int")).cast("string"), F.lit("T12:00:00Z"))
    owner = F.struct(org.alias("login"), F.when(k % 3 == 0, "User").otherwise("Organization").alias("type"))
    body = F.to_json(F.struct(F.concat_ws("/", org, k.cast("string")).alias("full_name"), owner.alias("owner"), (k * 3).alias("stargazers_count"), F.lit(1).alias("forks_count"), F.when(k % 2 == 0, "https://site.com").otherwise("").alias("homepage"), born.alias("created_at")))
    r = table(spark, sf_dir, "customer").select("c_custkey", tables.repository_record(body, at).alias("r"))
    return r.select("c_custkey", "r.external_id", "r.owner_login", "r.owner_type", F.col("r.stars").cast("long").alias("stars"), "r.homepage", F.col("r.age_days").cast("long").alias("age_days"))


@query(
    """
    WITH h AS (SELECT o_custkey AS company_id, CAST(o_orderdate AS DATE) AS day, o_orderkey % 300 AS n FROM orders WHERE o_orderstatus <> 'P'),
    l AS (SELECT company_id, max(day) AS day FROM h GROUP BY 1), lv AS (SELECT company_id, day, max(n) AS latest FROM h JOIN l USING (company_id, day) GROUP BY 1, 2),
    e AS (SELECT lv.company_id, min((h.day, h.n)) AS first FROM lv JOIN h ON h.company_id = lv.company_id AND h.day BETWEEN lv.day - 395 AND lv.day - 150 GROUP BY 1)
    SELECT company_id, latest, first[2] AS earliest, round(CASE WHEN first[2] > 0 THEN greatest(0, least(100, 50 + 100.0 * (latest - first[2]) / first[2])) END, 6) AS growth FROM lv LEFT JOIN e USING (company_id)
    """
)
def growth_pillar(spark, sf_dir):
    """Growth points: the newest measured headcount against the oldest of 150 to 395 days before it."""
    kind = F.when(F.col("o_orderstatus") == "P", "legacy").otherwise("press_reported")
    h = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company_id"), F.col("o_orderdate").alias("recorded_date"), (F.col("o_orderkey") % 300).alias("employee_count"), kind.alias("point_type"))
    return scoring.growth_pillar(h).withColumn("growth", F.round("growth", 6))


@query(
    """
    WITH w AS (SELECT date_trunc('week', ts) AS week, event_type, user_id, max(value) AS most FROM events GROUP BY 1, 2, 3) SELECT CAST(week AS TIMESTAMP) AS week, event_type, round(sum(most), 4) AS total FROM w GROUP BY 1, 2
    """
)
def weekly_sums(spark, sf_dir):
    """Per Monday week and type the sum over users of their greatest value: the stream's operator on a table at rest."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.weekly_sums(e, "event_type", "user_id", "value", "ts").select(F.col("week").cast("timestamp_ntz").alias("week"), "event_type", F.round("total", 4).alias("total"))


@query(
    """
    WITH m AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTES AS fresh FROM events), s AS (SELECT *, sum(CASE WHEN coalesce(fresh, true) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM m)
    SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTES AS ended, count(*) AS n_events FROM s GROUP BY user_id, n
    """
)
def session_bursts(spark, sf_dir):
    """Bursts of activity by session windows: the stream's operator on a table at rest."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.sessions(e, "user_id", "ts").select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("started", "ended")], "n_events")


@query(
    """
    WITH m AS (SELECT user_id, event_type, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTES AS fresh FROM events), s AS (SELECT *, sum(CASE WHEN coalesce(fresh, true) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM m)
    SELECT user_id, min(ts) AS started, count(*) AS n_events, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS active_seconds, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM s GROUP BY user_id, n
    """
)
def session_activity(spark, sf_dir):
    """Active seconds and kinds of events of each burst of activity."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = events.session_activity(e, "user_id", "ts", "event_type")
    return found.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), "n_events", F.round("active_seconds", 3).alias("active_seconds"), F.array_join("kinds", ",").alias("kinds"))


@query(
    """
    WITH r AS (SELECT o_custkey AS company_id, o_orderdate AS announcement_date, 'Fund ' || (o_orderkey % 30) AS lead, ['fund ' || (o_custkey % 30)] AS others FROM orders),
    n AS (SELECT DISTINCT company_id, lower(trim(unnest(list_concat(others, [lead])))) AS name FROM r),
    i AS (SELECT 'fund ' || s_suppkey AS name, min(s_suppkey % 4 + 1) AS tier FROM supplier WHERE s_suppkey < 20 GROUP BY 1),
    p AS (SELECT company_id, count(*) AS n_investors, min(tier) AS best_tier FROM n LEFT JOIN i USING (name) GROUP BY 1)
    SELECT company_id, n_investors, best_tier, CASE best_tier WHEN 1 THEN 100.0 WHEN 2 THEN 70.0 WHEN 3 THEN 40.0 ELSE 25.0 END AS investors FROM p
    """
)
def investor_pillar(spark, sf_dir):
    """Investor points: the best tier among all who lead or take part."""
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company_id"), F.concat(F.lit("Fund "), (F.col("o_orderkey") % 30).cast("string")).alias("lead_investor"), F.array(F.concat(F.lit("fund "), (F.col("o_custkey") % 30).cast("string"))).alias("investors"))
    i = table(spark, sf_dir, "supplier").where("s_suppkey < 20").select(F.concat(F.lit("FUND "), F.col("s_suppkey").cast("string")).alias("name"), (F.col("s_suppkey") % 4 + 1).alias("tier"))
    return scoring.investor_pillar(r, i)
