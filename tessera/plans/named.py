"""Names in texts: mentions of many names at once, rivals that sentences declare."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import people, text
from tessera.operators import mentions, tags
from tessera.plans.catalog import query
from tessera.sources.tables import table


@query(
    r"""
    WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS form FROM documents),
    b AS (SELECT item_id, array_to_string(list_slice(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), 1, 3), ' ') AS name FROM benchmark)
    SELECT doc_id, item_id, CAST((length(form) - length(replace(form, ' ' || name || ' ', ' '))) // (length(name) + 1) AS BIGINT) AS n
    FROM d JOIN b ON contains(form, ' ' || name || ' ') WHERE name <> ''
    """
)
def name_mentions(spark, sf_dir):
    """How often each benchmark item's first three words, taken as a name, stand in each document."""
    words = F.split(mentions.word_form(F.col("text")), " ")
    names = table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.slice(words, 1, 3), " ").alias("name"))
    found = mentions.mentions(table(spark, sf_dir, "documents").select("doc_id", "text"), names, text_id="doc_id", name_id="item_id")
    return found.select(F.col("text_id").alias("doc_id"), F.col("name_id").alias("item_id"), "n")


@query(
    """
    WITH c AS (SELECT c_custkey, c_nationkey, 'Works ' || c_custkey AS company FROM customer),
    s AS (
        SELECT c_custkey, c_nationkey AS k, c_custkey % 5 AS form FROM c
    )
    SELECT c_custkey AS company_id, c_custkey AS source_id, rival FROM (
        SELECT c_custkey, unnest(['Mill ' || k, 'Forge ' || k, 'Yard ' || k]) AS rival FROM s WHERE form = 0
        UNION ALL SELECT c_custkey, 'Mill ' || k FROM s WHERE form = 1
        UNION ALL SELECT c_custkey, unnest(['Mill ' || k, 'Forge ' || k]) FROM s WHERE form = 2
        UNION ALL SELECT c_custkey, 'Forge ' || k FROM s WHERE form = 3
    )
    """
)
def declared_rivals(spark, sf_dir):
    """Rivals that a report on each customer declares; one in five only speaks of competitors."""
    own, k = F.concat(F.lit("Works "), F.col("c_custkey").cast("string")), F.col("c_nationkey").cast("string")
    say = [
        F.concat(F.lit("The market where "), own, F.lit(" competes with the likes of Mill "), k, F.lit(", Forge "), k, F.lit(", and Yard "), k, F.lit(", is crowded. It grows.")),
        F.concat(own, F.lit(" is a European rival to U.S. startup Mill "), k, F.lit(" which has backing. Nobody else is named.")),
        F.concat(F.lit("It is known that "), own, F.lit("'s competitors include Mill "), k, F.lit(" and Forge "), k, F.lit(". Rivals grow.")),
        F.concat(F.lit("Forge "), k, F.lit(", a fast rival of "), own, F.lit(", opened an office. So it is.")),
        F.concat(F.lit("Customers of "), own, F.lit(" say that competitors exist. Rivals of others are Mill 1.")),
    ]
    text = F.element_at(F.array(*say), (F.col("c_custkey") % 5 + 1).cast("int"))
    c = table(spark, sf_dir, "customer")
    claims = mentions.rival_claims(c.select(F.col("c_custkey").alias("source_id"), text.alias("text")), c.select(F.col("c_custkey").alias("company_id"), own.alias("company")))
    return claims.where("company_id = source_id").select("company_id", "source_id", "rival")


@query()
def tags_carried(spark, sf_dir):
    """Tags (the first two content words of each benchmark item, and one alternative) that sentences of a source's documents carry; held against a plain pass in the tests."""
    words = text.content_words(F.col("text"))
    tag = F.concat_ws(" / ", F.array_join(F.slice(words, 1, 2), " "), F.element_at(words, 3))
    asked = table(spark, sf_dir, "benchmark").select(tag.alias("tag")).join(F.broadcast(table(spark, sf_dir, "documents").select(F.col("source").alias("company")).distinct()))  # a tag for each source
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("company"), F.col("doc_id").alias("page"), F.lit(None).cast("string").alias("url"), "text")
    return tags.supported_tags(pages, asked)


@query(
    """
    WITH c AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer),
    s AS (SELECT k, n, k % 5 AS form FROM c)
    SELECT k AS page_id, name, role FROM (
        SELECT k, unnest(['Jason J. Wang', 'Michael Gugel', 'Nir Leibovich']) AS name, 'Founder' AS role FROM s WHERE form = 0
        UNION ALL SELECT k, unnest(['Itai Gafni', 'Roy Weisfeld']), 'Founder' FROM s WHERE form = 1
        UNION ALL SELECT k, unnest(['Zoë Simon', 'Ana Souza']), 'Co-founder' FROM s WHERE form = 2
        UNION ALL SELECT k, 'Drew Houston', 'Founder' FROM s WHERE form = 3
    )
    """
)
def page_founders(spark, sf_dir):
    """Founders that a page on each customer names; one in five names another company's."""
    own = F.concat(F.lit("Works"), F.col("c_custkey").cast("string"))
    say = [
        F.concat(own, F.lit(".io, Inc. was founded in 2015 by Jason J. Wang, Michael Gugel, and Nir Leibovich. It grows.")),
        F.concat(own, F.lit(", founded in 2025 by Itai Gafni and Roy Weisfeld, raised an $8 million seed round led by 10D. The round included Ofer Ben-Noon, co-founder of Talon.")),
        F.concat(F.lit("Last year "), own, F.lit(" was co-founded by Dr. Zoë Simon and Ana Souza in 2019, Boston.")),
        F.concat(own, F.lit(" is a file hosting service. It was founded by Drew Houston.")),
        F.concat(F.lit("Rival Mill, founded by John Doe, competes with "), own, F.lit(". Mill is large. It was founded by Jane Roe.")),
    ]
    text = F.element_at(F.array(*say), (F.col("c_custkey") % 5 + 1).cast("int"))
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), own.alias("company"), F.lit(None).cast("string").alias("url"), F.concat(F.lit("About "), own).alias("title"), text.alias("text"))
    return people.founders(pages).select("page_id", "name", "role")
