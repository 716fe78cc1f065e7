"""Mentions of names and declared rivals against loops over names."""

import random
import re
from collections import Counter

import pytest

from tessera.operators import mentions


def form(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).strip()


@pytest.mark.parametrize("most_bytes", [1 << 20, 1])
def test_mentions_against_a_loop(spark, most_bytes):
    rng = random.Random(3)
    pool = ["new", "relic", "new relic", "A.B", "Émile", "co", "x", "relic new"]
    names = [(i, " ".join(rng.choices(pool, k=rng.randint(1, 3)))) for i in range(40)] + [(100, "New-Relic"), (101, "..."), (102, None)]
    texts = [(i, " ".join(rng.choices([*pool, "and", "newrelic", "New", "--"], k=rng.randint(0, 40)))) for i in range(60)] + [(70, None), (71, "")]
    got = Counter(map(tuple, mentions.mentions(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(names, "name_id long, name string"), most_bytes=most_bytes).collect()))
    want = Counter()
    for t, text in texts:
        words = form(text).split()
        for n, name in names:
            own = form(name).split()
            k = sum(words[i : i + len(own)] == own for i in range(len(words) - len(own) + 1)) if own else 0
            if k:
                want[t, n, k] += 1
    assert got == want


@pytest.mark.parametrize(
    ("company", "text", "want"),
    [
        ("Coralogix", "The observability industry, where Coralogix competes with the likes of Datadog, New Relic, and Splunk, is crowded.", ["Datadog", "New Relic", "Splunk"]),
        ("Zepto", "Zepto competes with SoftBank-backed Blinkit in India, both of which promise 10-minute deliveries.", ["Blinkit"]),
        ("Helsing", "Helsing is a European rival to U.S. startup Anduril which has also received heavy backing.", ["Anduril"]),
        ("HiBob", "Rippling competes with HiBob, Namely, BambooHR.", ["Rippling"]),
        ("Acme", "Northwind grows fast. Contoso, a rival of Acme, closed its doors.", ["Contoso"]),
        ("Acme", "Acme opened an office. Its rivals are many.", []),
        (r"A\E+(b", r"A\E+(b competes with Splunk.", ["Splunk"]),
    ],
)
def test_declared_rivals(spark, company, text, want):
    claims = mentions.rival_claims(spark.createDataFrame([(1, text)], "source_id long, text string"), spark.createDataFrame([(9, company)], "company_id long, company string"))
    assert sorted(r.rival for r in claims.collect()) == want


def test_large_sets_of_companies_stay_off_the_driver(spark, tmp_path):
    spark.range(400).selectExpr("id AS company_id", "concat('Works ', id) AS company", "concat('Works ', id, ' competes with Mill.') AS text").write.parquet(f"{tmp_path}/c")
    c = spark.read.parquet(f"{tmp_path}/c")
    claims = mentions.rival_claims(c.select(c.company_id.alias("source_id"), "text"), c.select("company_id", "company"), most_bytes=1)
    assert claims.count() == 400
    assert "Broadcast" not in claims._jdf.queryExecution().executedPlan().toString()


def test_lists_of_names(spark):
    from pyspark.sql import functions as F

    lists = {"Datadog, New Relic, and Splunk": ["Datadog", "New Relic", "Splunk"], "the likes of Datadog, New Relic and Splunk in India": ["Datadog", "New Relic", "Splunk"], "SoftBank-backed Blinkit in India": ["Blinkit"], "Swiggy, India's most valuable food delivery startup": ["Swiggy"]}
    got = spark.createDataFrame([(x,) for x in lists], "x string").select("x", mentions.names_in_list(F.col("x"))).collect()
    assert {r[0]: r[1] for r in got} == lists
