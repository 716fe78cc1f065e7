"""Best sentences: counted where they are read and joined give the same; heavy work is dealt over tasks."""

import random

import pytest

from tessera.operators import passages
from tessera.plans.catalog import load

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("most_bytes", "cells"), [(1 << 20, 4 << 20), (1 << 20, 30), (1, 30)])
def test_best_shared_against_a_loop(spark, monkeypatch, most_bytes, cells):
    monkeypatch.setattr(passages, "CELLS", cells)
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(30)] + ["Ähre", "zoë"]
    rows = [(rng.randrange(40), f"{rng.choice('aäz')} {i % 50}", rng.sample(pool, rng.randint(0, 6))) for i in range(300)]
    items = [(i * 7, rng.sample([*pool, "none"], rng.randint(0, 8))) for i in range(12)] + [(999, ["nowhere"])]
    got = passages.best_shared(spark.createDataFrame(rows, "doc_id long, sentence string, words array<string>"), spark.createDataFrame(items, "item_id long, words array<string>"), most_bytes=most_bytes)
    want = set()
    for item, own in items:
        if most_bytes == 1:  # rows of one document and sentence are one there
            both = {}
            for doc, sentence, words in rows:
                both[doc, sentence] = both.get((doc, sentence), 0) + len(set(own) & set(words))
            each = [(n, -doc, sentence) for (doc, sentence), n in both.items()]
        else:
            each = [(len(set(own) & set(words)), -doc, sentence) for doc, sentence, words in rows]
        best = max(each)
        if best[0]:
            want.add((item, best[0], -best[1], best[2]))
    assert set(map(tuple, got.collect())) == want


def test_best_sentences_shuffle_only_the_best_of_each_task(spark):
    plan = load()[0]["best_sentences"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and plan.count("Exchange") == 1


def tasks(df, spark):
    from pyspark.sql import functions as F

    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_pages_are_dealt_before_they_are_read(spark):
    from tessera.functions import people

    pages = spark.range(400).coalesce(1).selectExpr("id AS page_id", "'Acme' AS company", "CAST(NULL AS string) AS url", "'Acme' AS title", "'Acme was founded by Jane Roe.' AS text")
    found = people.founders(pages)
    assert found.count() == 400 and tasks(found, spark) > 1


def test_parts_are_dealt_before_they_are_parsed(spark):
    assert tasks(load()[0]["patent_publications"](spark, FOLDER), spark) > 1
    plan = load()[0]["patent_publications"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") + plan.count("try_parse_json") <= 1


def test_participations_are_counted_without_copies_of_rows(spark):
    assert "Expand" not in load()[0]["investor_facts"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()


def test_excluded_names_are_counted_where_they_are_dealt_to(spark):
    plan = load()[0]["excluded_names"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan.split("hashpartitioning(p_partkey")[0]
