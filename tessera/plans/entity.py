"""Names, domains, groups, merges and duplicate rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import classify, money, names, web
from tessera.operators import keyed, resolve
from tessera.plans.catalog import query
from tessera.sources.tables import table

_FORMS = names.LEGAL_FORMS


def _key_sql(column: str) -> str:
    once = f"regexp_replace(replace(lower(trim(coalesce({column}, ''))), '&', ' and '), '[\\s,.]+({_FORMS})\\.?$', '')"
    twice = f"regexp_replace({once}, '[\\s,.]+({_FORMS})\\.?$', '')"
    return f"nullif(trim(regexp_replace({twice}, '[^a-z0-9]+', ' ', 'g')), '')"


@query(f"SELECT s_suppkey, s_name, {_key_sql("s_name || CASE s_suppkey % 4 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' & Co LLC' WHEN 2 THEN ' Holdings GmbH' ELSE '' END")} AS name_key FROM supplier")
def name_keys(spark, sf_dir):
    """Company names in several legal forms brought to one key."""
    k = F.col("s_suppkey") % 4
    form = F.when(k == 0, ", Inc.").when(k == 1, " & Co LLC").when(k == 2, " Holdings GmbH").otherwise("")
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", names.company_name_key(F.concat("s_name", form)).alias("name_key"))


@query(
    """
    WITH h AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\\.', '') AS host FROM pages)
    SELECT page_id, nullif(host, '') AS host,
           CASE WHEN instr(host, '.') = 0 THEN NULL ELSE array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') END AS domain,
           CASE regexp_extract(host, '\\.([a-z]+)$', 1) WHEN '' THEN 'none' WHEN 'com' THEN 'com' WHEN 'net' THEN 'net' WHEN 'org' THEN 'org' ELSE 'other' END AS top_group,
           regexp_matches(url, '^https?://\\S+$') AS web_link
    FROM h
    """
)
def page_domains(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", web.site_host(url).alias("host"), web.registrable_domain(url).alias("domain"), web.top_level_group(url).alias("top_group"), web.is_web_link(url).alias("web_link"))


@query(
    """
    WITH h AS (SELECT page_id, array_to_string(list_slice(string_split(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '.'), -3, -1), '.') AS value FROM pages)
    SELECT value, count(DISTINCT page_id) AS n, min(page_id) AS survivor FROM h GROUP BY value HAVING count(DISTINCT page_id) > 1
    """
)
def strong_groups(spark, sf_dir):
    """Groups of entities that carry one identifier, and who stays."""
    labels = F.split(F.regexp_extract("url", "^[a-z]+://([^/?#:]*)", 1), r"\.")
    identifiers = table(spark, sf_dir, "pages").select(F.col("page_id").alias("entity_id"), F.lit("site").alias("kind"), F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(3)), F.lit(3)), ".").alias("value"))
    groups = resolve.identifier_groups(identifiers, ["site"])
    return groups.select("value", "n", F.array_min("members").alias("survivor"))


@query(
    """
    SELECT a.c_custkey AS left_id, b.c_custkey AS right_id, CAST(a.c_mktsegment = b.c_mktsegment AS INT) AS agree,
           round(least(0.7 + 0.1 * CAST(a.c_mktsegment = b.c_mktsegment AS INT), 1), 3) AS score
    FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND round(a.c_acctbal / 50) = round(b.c_acctbal / 50) AND a.c_custkey < b.c_custkey
    """
)
def tier2_pairs(spark, sf_dir):
    """Pairs that share a key, scored by what else agrees."""
    keyed_rows = table(spark, sf_dir, "customer").withColumn("key", F.concat_ws("/", F.col("c_nationkey").cast("string"), F.round(F.col("c_acctbal") / 50).cast("long").cast("string")))
    return resolve.same_key_pairs(keyed_rows, "key", "c_custkey", ["c_mktsegment"]).select("left_id", "right_id", "agree", F.round("score", 3).alias("score"))


@query(
    """
    WITH c AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN c_custkey - 1 ELSE c_custkey END AS k, c_custkey AS id FROM customer),
    n AS (SELECT name, min(id) AS id FROM (SELECT 'north star works number ' || CAST(k * 7919 AS VARCHAR) || CASE WHEN id % 3 = 0 THEN ' s' ELSE '' END AS name, id FROM c) GROUP BY 1),
    w AS (SELECT id, unnest(string_split(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' ')) AS word FROM n),
    g AS (SELECT DISTINCT id, substr('  ' || word || ' ', i, 3) AS gram FROM w, range(1, 100) t(i) WHERE i <= length(word) + 1),
    c2 AS (SELECT id, count(*) AS n FROM g GROUP BY id)
    SELECT a.id AS left_id, b.id AS right_id, round(count(*) * 1.0 / (max(ca.n) + max(cb.n) - count(*)), 3) AS likeness
    FROM g a JOIN g b ON a.gram = b.gram AND a.id < b.id JOIN c2 ca ON ca.id = a.id JOIN c2 cb ON cb.id = b.id
    GROUP BY 1, 2 HAVING count(*) * 1.0 / (max(ca.n) + max(cb.n) - count(*)) >= 0.86
    """
)
def trigram_pairs(spark, sf_dir):
    """Different names that are much alike by trigrams; every third customer's is an edited copy of the one before."""
    k = F.col("c_custkey")
    own = F.when(k % 3 == 0, k - 1).otherwise(k) * 7919
    name = F.concat(F.lit("north star works number "), own.cast("string"), F.when(k % 3 == 0, " s").otherwise(""))
    return resolve.similar_names(table(spark, sf_dir, "customer").select("c_custkey", name.alias("name")), "name", "c_custkey")


@query(
    """
    WITH a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE round(c_acctbal, 2) END AS balance,
                      c_custkey % 400 AS grp FROM customer),
    r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY (segment IS NOT NULL)::INT + (balance IS NOT NULL)::INT DESC, id) AS n FROM a)
    SELECT grp, arg_min(id, n) AS id, arg_min(segment, n) FILTER (WHERE segment IS NOT NULL) AS segment, arg_min(balance, n) FILTER (WHERE balance IS NOT NULL) AS balance,
           count(*) AS members,
           concat_ws(',', CASE WHEN max(CASE WHEN n = 1 AND segment IS NULL THEN 1 ELSE 0 END) = 1 AND max(segment) IS NOT NULL THEN 'segment' END,
                          CASE WHEN max(CASE WHEN n = 1 AND balance IS NULL THEN 1 ELSE 0 END) = 1 AND max(balance) IS NOT NULL THEN 'balance' END) AS filled
    FROM r GROUP BY grp
    """
)
def gap_fill_merge(spark, sf_dir):
    """Merge of duplicates: the richest stays, its gaps are filled from the others in order."""
    key = F.col("c_custkey")
    members = table(spark, sf_dir, "customer").select(
        (key % 400).alias("grp"), key.alias("id"), F.when(key % 3 != 0, F.col("c_mktsegment")).alias("segment"), F.when(key % 2 != 0, F.round("c_acctbal", 2)).alias("balance")
    )
    rich = F.col("segment").isNotNull().cast("int") + F.col("balance").isNotNull().cast("int")
    return keyed.gap_fill(members, group="grp", rank=[rich.desc(), F.col("id")]).withColumn("filled", F.array_join("filled", ","))


@query(
    """
    SELECT a.o_custkey, a.o_orderkey AS left_id, b.o_orderkey AS right_id, 'duplicate' AS verdict
    FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(date_diff('day', CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE))) <= 270
      AND a.o_orderpriority = b.o_orderpriority AND a.o_totalprice > 0 AND b.o_totalprice > 0 AND abs(a.o_totalprice - b.o_totalprice) / greatest(a.o_totalprice, b.o_totalprice) <= 0.10
    """
)
def dup_pairs(spark, sf_dir):
    """Rounds of one company that may be the same: near dates, one lead, near amounts."""
    return resolve.round_pairs(table(spark, sf_dir, "orders"), company="o_custkey", unique="o_orderkey", date="o_orderdate", amount="o_totalprice", lead="o_orderpriority")


@query(
    """
    WITH RECURSIVE e AS (SELECT a.o_orderkey AS l, b.o_orderkey AS r FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
        AND abs(date_diff('day', CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE))) <= 270 AND a.o_orderpriority = b.o_orderpriority
        AND abs(a.o_totalprice - b.o_totalprice) / greatest(a.o_totalprice, b.o_totalprice) <= 0.10),
    s AS (SELECT l AS x, r AS y FROM e UNION SELECT r, l FROM e),
    walk AS (SELECT x AS id, x AS seen FROM s UNION SELECT walk.id, s.y FROM walk JOIN s ON s.x = walk.seen)
    SELECT id, min(seen) AS group_id FROM walk GROUP BY id
    """
)
def duplicate_groups(spark, sf_dir):
    """Connected groups of possible duplicates."""
    return resolve.connected(dup_pairs(spark, sf_dir))


@query(
    """
    SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'AI & ML' WHEN 1 THEN 'Fintech' WHEN 2 THEN 'Cybersecurity' WHEN 3 THEN 'DeepTech' WHEN 4 THEN 'Consumer & Media' ELSE 'Uncategorized' END AS sector FROM part
    """
)
def classify_sectors(spark, sf_dir):
    """Sectors of parts' types, which name none, with words that do."""
    k = F.col("p_partkey") % 7
    added = F.when(k == 0, " AI platform").when(k == 1, " neobank").when(k == 2, " Zero Trust").when(k == 3, " robotics").when(k == 4, " games").otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", classify.sector(F.concat("p_type", added)).alias("sector"))


@query(
    """
    SELECT o_orderkey, CASE WHEN v IS NULL OR v <= 0 THEN NULL WHEN v >= 1e9 THEN '$' || regexp_replace(format('{:.1f}', round(v / 1e9, 1)), '\\.0$', '') || 'B'
             WHEN v >= 1e6 THEN '$' || regexp_replace(format('{:.1f}', round(v / 1e6, 1)), '\\.0$', '') || 'M'
             WHEN v >= 1e3 THEN '$' || CAST(CAST(round(v / 1e3) AS BIGINT) AS VARCHAR) || 'K' ELSE '$' || CAST(CAST(round(v) AS BIGINT) AS VARCHAR) END AS short
    FROM (SELECT o_orderkey, round(o_totalprice) * CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 100 ELSE 10000 END AS v FROM orders)
    """
)
def money_forms(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    v = F.round("o_totalprice") * F.when(k == 0, 1).when(k == 1, 100).otherwise(10000)
    return table(spark, sf_dir, "orders").select("o_orderkey", money.short_usd(v).alias("short"))


@query(
    """
    WITH rates(currency, year, usd_per_unit) AS (VALUES ('GBP', 1996, 1.56), ('GBP', 1999, 1.62), ('JPY', 1996, 0.0092), ('JPY', 1999, 0.0088)),
    x AS (SELECT o_orderkey, o_totalprice, CASE o_orderkey % 3 WHEN 0 THEN 'gbp' WHEN 1 THEN 'JPY' ELSE 'XXX' END AS currency, year(o_orderdate) AS y FROM orders)
    SELECT o_orderkey, round(o_totalprice * usd_per_unit, 4) AS amount_usd
    FROM x LEFT JOIN rates r ON r.currency = upper(x.currency) AND r.year = CASE WHEN y < 1999 AND y <> 1999 THEN CASE WHEN y <= 1996 THEN 1996 ELSE y END ELSE 1999 END
    """
)
def fx_conversion(spark, sf_dir):
    """Amounts at the yearly rate; years outside the table take its nearest end, gaps and unknown currencies are null."""
    rates = spark.createDataFrame([("GBP", 1996, 1.56), ("GBP", 1999, 1.62), ("JPY", 1996, 0.0092), ("JPY", 1999, 0.0088)], "currency string, year int, usd_per_unit double")
    k = F.col("o_orderkey") % 3
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.when(k == 0, "gbp").when(k == 1, "JPY").otherwise("XXX").alias("currency"), F.year("o_orderdate").alias("year"))
    return money.to_usd(orders, F.broadcast(rates), amount="o_totalprice", currency="currency", year="year").select("o_orderkey", F.round("amount_usd", 4).alias("amount_usd"))


@query(
    """
    SELECT s_suppkey, CASE WHEN a.c IS NOT NULL THEN a.c ELSE b.c END AS company_id, CASE WHEN a.c IS NOT NULL THEN 'number' WHEN b.c IS NOT NULL THEN 'band' END AS matched_by
    FROM (SELECT s_suppkey, s_suppkey * 7 AS number, CAST(round(s_acctbal / 10) AS BIGINT) AS band FROM supplier) s
    LEFT JOIN (SELECT c_custkey AS k, min(c_custkey) AS c FROM customer WHERE c_acctbal > 3000 GROUP BY 1 HAVING count(*) = 1) a ON a.k = s.number
    LEFT JOIN (SELECT CAST(round(c_acctbal / 10) AS BIGINT) AS k, min(c_custkey) AS c FROM customer GROUP BY 1 HAVING count(DISTINCT c_custkey) = 1) b ON b.k = s.band
    """
)
def link_cascade(spark, sf_dir):
    """Link by the strongest identifier that decides; an ambiguous one links nothing."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 7).alias("number"), F.round(F.col("s_acctbal") / 10).cast("long").alias("band"))
    c = table(spark, sf_dir, "customer")
    by_number = c.where("c_acctbal > 3000").select(F.col("c_custkey").alias("number_key"), F.col("c_custkey").alias("company_id"))
    by_band = c.select(F.round(F.col("c_acctbal") / 10).cast("long").alias("band_key"), F.col("c_custkey").alias("company_id"))
    return resolve.cascade(s, "s_suppkey", [("number", by_number, "number_key"), ("band", by_band, "band_key")]).select("s_suppkey", "company_id", "matched_by")


@query(
    """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'status' END AS a, concat_ws(',', CASE WHEN o_totalprice > 450000 THEN 'price' END, CASE WHEN o_orderdate >= DATE '2001-06-01' THEN 'future' END) AS broken
    FROM orders WHERE o_totalprice > 450000 OR o_orderdate >= DATE '2001-06-01'
    """
)
def rule_violations(spark, sf_dir):
    """Rows that break rules, with the rules they break."""
    orders = table(spark, sf_dir, "orders")
    rules = {"price": (F.col("o_totalprice") > 450000, "review"), "future": (F.col("o_orderdate") >= F.lit("2001-06-01").cast("date"), "drop")}
    broken = keyed.violations(orders, "o_orderkey", rules)
    per = broken.groupBy("o_orderkey").agg(F.reverse(F.array_sort(F.collect_set("rule"))).alias("r"))
    return per.join(orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "status").alias("a")), "o_orderkey").select("o_orderkey", "a", F.array_join("r", ",").alias("broken"))


@query(
    """
    SELECT page_id, CASE WHEN length(s) >= 2 THEN s END AS slug FROM (
      SELECT page_id, trim(regexp_replace(lower(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM pages)
    """
)
def title_slugs(spark, sf_dir):
    title = F.lower(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    slug = F.regexp_replace(F.regexp_replace(title, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return table(spark, sf_dir, "pages").select("page_id", F.when(F.length(slug) >= 2, slug).alias("slug"))


@query()
def merged_rounds(spark, sf_dir):
    """Greedy merging of rounds by company; held against brute force in the tests."""
    from tessera.operators.rounds import merge_rounds

    rounds = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("company_id"), F.col("o_orderkey").alias("round_id"), F.lit("Seed").alias("label"), F.col("o_totalprice").alias("amount"),
        F.lit(None).cast("double").alias("valuation"), F.col("o_orderdate").cast("timestamp").alias("date"), F.col("o_orderpriority").alias("lead"), F.array().cast("array<string>").alias("others"),
    )
    merged = merge_rounds(rounds)
    return merged.select("company_id", "round_id", "label", "amount", F.size("merged").alias("n_merged"))
