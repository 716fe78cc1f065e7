"""Rules on links, pages, headlines and names, run over whole columns of the tables, with the rule said again in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import classify, relevance, text, web
from tessera.plans.catalog import query
from tessera.sources.tables import table

_DAY = "DATE '2026-11-28'"
_WORDS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_FUNCTION_ENDS = ", ".join(f"'{w}'" for w in text.FUNCTION_ENDS)
_AUXILIARIES = ", ".join(f"'{w}'" for w in text.AUXILIARIES)
_EXPLAINER, _LISTICLE = relevance.EXPLAINER.replace("'", "''"), relevance.LISTICLE.replace("'", "''")
_ERRORS = text.ERRORS.replace("'", "''")


@query(
    f"""
    WITH u AS (
        SELECT page_id, url,
               regexp_extract(url, '/((?:19|20)\\d{{2}})[/-](\\d{{2}})[/-](\\d{{2}})(?:[/\\-_?#]|$)', ['y', 'm', 'd']) AS a,
               regexp_extract(url, '/home/((?:19|20)\\d{{2}})(\\d{{2}})(\\d{{2}})\\d{{4,}}', ['y', 'm', 'd']) AS b,
               regexp_extract(url, '/((?:19|20)\\d{{2}})(\\d{{2}})(\\d{{2}})(?:[/\\-_?#]|$)', ['y', 'm', 'd']) AS c
        FROM pages
    ),
    d AS (SELECT page_id, url, TRY_CAST(CASE WHEN a.y <> '' THEN a.y || '-' || a.m || '-' || a.d WHEN b.y <> '' THEN b.y || '-' || b.m || '-' || b.d WHEN c.y <> '' THEN c.y || '-' || c.m || '-' || c.d END AS DATE) AS day FROM u),
    p AS (SELECT *, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#\\s]+)([^?#]*)(\\?[^#]*)?(#.*)?$', ['site', 'path', 'query', 'mark']) AS x FROM d),
    q AS (SELECT *, list_filter(string_split(substr(x.query, 2), '&'), lambda k: NOT regexp_matches(split_part(k, '=', 1), '(?i)^(?:srsltid|utm_[a-z]+|gclid|fbclid|mc_cid|mc_eid|msclkid|igshid|ref_src)$')) AS kept FROM p)
    SELECT page_id, CASE WHEN year(day) >= 1990 AND day <= {_DAY} THEN day END AS day,
           CASE WHEN url IS NULL OR x.site = '' OR regexp_matches(url, '\\s') THEN url
                ELSE lower(x.site) || CASE WHEN x.path = '' THEN '/' ELSE x.path END
                     || CASE WHEN len(kept) < len(string_split(substr(x.query, 2), '&'))
                             THEN CASE WHEN len(list_filter(kept, lambda k: k <> '')) > 0 THEN '?' || array_to_string(list_filter(kept, lambda k: k <> ''), '&') ELSE '' END
                             WHEN x.query = '?' AND x.mark = '' THEN '' ELSE x.query END
                     || x.mark END AS link
    FROM q
    """
)
def page_links(spark, sf_dir):
    """Day in each page's address, and the address without tracking."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", web.url_date(url, F.lit("2026-11-28").cast("date")).alias("day"), web.without_tracking(url).alias("link"))


@query(
    f"""
    SELECT 'page' AS kind, page_id AS id, coalesce(regexp_matches(substr(html, 1, 1500), '{_ERRORS}'), false) AS is_error FROM pages
    UNION ALL SELECT 'document', doc_id, coalesce(regexp_matches(substr(text, 1, 1500), '{_ERRORS}'), false) FROM documents
    """
)
def error_flags(spark, sf_dir):
    """Which pages and documents are an error or a challenge instead of content."""
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), text.error_page(F.col("html")).alias("is_error"))
    return pages.unionByName(table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), text.error_page(F.col("text")).alias("is_error")))


@query(
    f"""
    WITH h AS (SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS title FROM documents),
    w AS (SELECT *, list_transform(list_filter(regexp_split_to_array(trim(regexp_replace(title, '[“”"'']', '', 'g')), '\\s+'), lambda x: x <> ''), lambda x: regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}]+$', '')) AS low FROM h)
    SELECT doc_id, regexp_matches(title, '(?i)(?:[:;,–—-]|\\.\\.\\.|…)\\s*$|\\b(?:and|or|of|to|for|the|with)\\s*$') AS is_cut,
           len(low) < 5 OR coalesce(list_last(low) IN ({_FUNCTION_ENDS}), false)
           OR (coalesce(regexp_matches(list_last(low), '^\\p{{L}}{{3,}}ing$'), false) AND coalesce(low[-2] IN ({_AUXILIARIES}), false)) AS is_incomplete
    FROM w
    """
)
def headline_flags(spark, sf_dir):
    """Whether each document's first line, taken as its headline, is cut or stops in the middle."""
    title = F.split_part(F.coalesce(F.col("text"), F.lit("")), F.lit("\n"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", text.cut_headline(title).alias("is_cut"), text.incomplete_headline(title).alias("is_incomplete"))


@query(
    f"""
    WITH w AS (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}{{4,}}')), lambda x: x NOT IN ({_WORDS})) AS w FROM documents)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, list_min(w) AS first_word FROM w
    """
)
def document_content_words(spark, sf_dir):
    """Number and first of each document's distinct content words."""
    words = text.content_words(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n_words"), F.array_min(words).alias("first_word"))


@query(
    """
    WITH n AS (SELECT c_custkey, trim(lower(coalesce(c_name, ''))) AS t, CAST(floor(c_acctbal) AS INT) AS people FROM customer)
    SELECT c_custkey,
           CASE WHEN t = 'customer#000000001' THEN 0 WHEN starts_with(t, 'customer#000000001') THEN 1 WHEN regexp_matches(t, '(^|[^a-z0-9_])customer#000000001') THEN 2 WHEN contains(t, 'customer#000000001') THEN 3 ELSE 4 END AS by_name,
           CASE WHEN regexp_matches(t, '(^|[^a-z0-9_])0000') THEN 2 WHEN contains(t, '0000') THEN 3 ELSE 4 END AS by_digits,
           CASE WHEN people IS NULL OR people < 1 THEN NULL WHEN people <= 10 THEN '1-10' WHEN people <= 50 THEN '11-50' WHEN people <= 200 THEN '51-200' WHEN people <= 500 THEN '201-500' WHEN people <= 1000 THEN '501-1000' WHEN people <= 5000 THEN '1001-5000' WHEN people <= 10000 THEN '5001-10000' ELSE '10001+' END AS band
    FROM n
    """
)
def customer_ranks(spark, sf_dir):
    """How well each customer's name answers two searches, and the band of its balance taken as a headcount."""
    name = F.col("c_name")
    band = classify.headcount_band(F.floor("c_acctbal").cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", classify.search_rank(name, "Customer#000000001").alias("by_name"), classify.search_rank(name, "0000").alias("by_digits"), band.alias("band"))


@query(
    rf"""
    WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, split_part(regexp_extract(url, '://([^/?#]+)', 1), '.', 1) AS company FROM pages),
    f AS (SELECT *, ' ' || regexp_replace(regexp_replace(regexp_replace(lower(title), '[’'']s\b', '_poss', 'g'), '[^\p{{L}}\p{{N}} _]', ' ', 'g'), '\s+', ' ', 'g') || ' ' AS flat, trim(regexp_replace(regexp_replace(lower(company), '[^\p{{L}}\p{{N}} ]', ' ', 'g'), '\s+', ' ', 'g')) AS core FROM t)
    SELECT page_id, CASE WHEN regexp_matches(title, '{_EXPLAINER}') OR regexp_matches(title, '{_LISTICLE}') THEN 'explainer' WHEN NOT contains(flat, ' ' || core || ' ') THEN 'not_about_the_company' END AS problem
    FROM f
    """
)
def page_news_problems(spark, sf_dir):
    """Why each page's headline isn't news about the name its host begins with."""
    title, company = F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.split_part(F.regexp_extract("url", "://([^/?#]+)", 1), F.lit("."), F.lit(1))
    nothing = F.lit(None).cast("string")
    return table(spark, sf_dir, "pages").select("page_id", relevance.news_problem(title, nothing, company, nothing).alias("problem"))


@query(
    """
    WITH k AS (
        SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'manual' WHEN '2-HIGH' THEN 'company_site' WHEN '3-MEDIUM' THEN 'news' WHEN '5-LOW' THEN 'model_inferred' END AS a,
               CASE o_orderstatus WHEN 'F' THEN 'registry' WHEN 'O' THEN 'news' END AS b, CAST(month(CAST(o_orderdate AS DATE)) AS INT) AS attempt
        FROM orders
    ),
    r AS (
        SELECT *, CASE a WHEN 'manual' THEN 6 WHEN 'company_site' THEN 4 WHEN 'news' THEN 2 WHEN 'model_inferred' THEN 0 END AS x, CASE b WHEN 'registry' THEN 5 WHEN 'news' THEN 2 END AS y FROM k
    )
    SELECT o_orderkey,
           CASE WHEN a IS NULL AND b IS NULL THEN 'unresolved' WHEN a IS NULL THEN 'keep_new' WHEN b IS NULL THEN 'keep_existing' WHEN y > x THEN 'keep_new' WHEN x > y THEN 'keep_existing' ELSE 'unresolved' END AS verdict,
           CAST(least(3600, 60 * pow(4, greatest(0, attempt - 1))) AS BIGINT) AS wait, CASE WHEN a IS NULL THEN 'Undisclosed' ELSE a END AS shown,
           CASE WHEN b = 'news' THEN 'allowed/4/auto_wire' WHEN b = 'registry' THEN 'denied/-/auto_blog_vendor_other' END AS standing
    FROM r
    """
)
def source_conflicts(spark, sf_dir):
    """Which of two kinds of sources stands for each order, how long a retry waits, and what a domain's class means."""
    priority = F.create_map(*[F.lit(x) for pair in {"1-URGENT": "manual", "2-HIGH": "company_site", "3-MEDIUM": "news", "5-LOW": "model_inferred"}.items() for x in pair])
    a = F.try_element_at(priority, F.col("o_orderpriority"))
    b = F.when(F.col("o_orderstatus") == "F", "registry").when(F.col("o_orderstatus") == "O", "news")
    standing = classify.domain_standing(F.when(b == "news", "wire").when(b == "registry", "blog_vendor_other").otherwise("investor"))
    shown = F.concat_ws("/", standing["kind"], F.coalesce(standing["tier"].cast("string"), F.lit("-")), standing["why"])
    return table(spark, sf_dir, "orders").select("o_orderkey", classify.rank_conflict(a, b).alias("verdict"), classify.backoff_seconds(F.month("o_orderdate")).alias("wait"), classify.shown_round_type(a).alias("shown"), F.when(standing.isNotNull(), shown).alias("standing"))
