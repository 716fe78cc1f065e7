"""Operators on small rows, with nulls, ties and gaps."""

import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from tessera.functions import money, names, text, web
from tessera.operators import keyed, relational, resolve, rounds
from tessera.plans import scoring, textual
from tessera.streaming import events


def test_as_of_takes_the_last_before(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9), (None, 4)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 6, "z"), ("b", 10, "w")], "k string, at int, v string")
    got = {(r.k, r.t): r.v for r in relational.as_of(left, right, ["k"], "t", "at", ["v"]).collect()}
    assert got[("a", 1)] is None and got[("b", 9)] is None
    assert got[("a", 5)] in ("x", "y")


def test_first_per_keeps_k_rows(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 1), (None, 2)], "k string, v int")
    got = sorted((r.k or "", r.v) for r in relational.first_per(df, ["k"], [F.desc("v")], 2).collect())
    assert got == [("", 2), ("a", 3), ("a", 4), ("b", 1)]


def test_every_pair_in_blocks(spark):
    left, right = spark.range(25).withColumnRenamed("id", "a"), spark.createDataFrame([(i,) for i in [*range(11), None]], "b long")
    got = Counter((r.a, r.b) for r in relational.every_pair(left, right, "a", "b", block=4).collect())
    assert got == Counter((a, b) for a in range(25) for b in [*range(11), None])
    assert relational.every_pair(left, right.limit(0), "a", "b").count() == 0
    plan = scoring.preference_match(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "strategy=broadcast" not in plan


def test_upsert_policies(spark):
    schema = "k string, a string, b array<string>, c boolean"
    old = spark.createDataFrame([("x", "1", ["p"], False), ("y", None, None, None), (None, "n", None, None)], schema)
    new = spark.createDataFrame([("x", None, ["q"], True), ("y", "2", ["r"], None), ("z", "3", None, False)], schema)
    got = {r.k: r for r in keyed.upsert(old, new, ["k"], {"a": keyed.NEW, "b": keyed.UNION, "c": keyed.EITHER}).collect()}
    assert set(got) == {"x", "y", "z", None}
    assert got["x"].a == "1" and got["x"].b == ["p", "q"] and got["x"].c is True
    assert got["y"].a == "2" and got["z"].a == "3" and got[None].a == "n"


def test_insert_new_is_idempotent(spark):
    old = spark.createDataFrame([("x", 1)], "k string, v int")
    new = spark.createDataFrame([("x", 9), ("y", 2), ("y", 3), (None, 4), (None, 5)], "k string, v int")
    got = sorted((r.k or "", r.v) for r in keyed.insert_new(old, new, ["k"], [F.col("v")]).collect())
    assert got == [("", 4), ("", 5), ("y", 2)]


def test_connected_follows_chains(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(50, 60)], "left_id long, right_id long")
    got = {tuple(r)[0]: tuple(r)[1] for r in resolve.connected(pairs).collect()}
    assert all(got[i] == 1 for i in range(1, 21)) and got[60] == got[50] == 50


def test_connected_follows_long_chains(spark):
    ids = list(range(1001, 1401))
    random.Random(5).shuffle(ids)
    chains = [[*range(2, 61), 1], list(range(100, 400)), ids]
    pairs = spark.createDataFrame([p for c in chains for p in zip(c, c[1:])], "left_id long, right_id long")
    got = {r.id: r.group_id for r in resolve.connected(pairs).collect()}
    assert got == {i: min(c) for c in chains for i in c}
    assert resolve.connected(pairs.limit(0)).count() == 0


def test_rounds_merge_greedily(spark):
    day = dt.datetime(2020, 1, 1)
    rows = [
        (1, 1, "Unknown", 100.0, None, day, "Acme Capital", ["B"]),
        (1, 2, "Seed", 105.0, 900.0, day + dt.timedelta(days=30), "Acme Capital, L.P.", ["C"]),
        (1, 3, "Series A", 105.0, 900.0, day + dt.timedelta(days=600), "Acme Capital", []),
        (1, 4, None, None, None, None, None, None),
        (2, 5, "Seed", 105.0, None, day, "Acme Capital", []),
    ]
    df = spark.createDataFrame(rows, "company_id long, round_id long, label string, amount double, valuation double, date timestamp, lead string, others array<string>")
    got = {r.round_id: r for r in rounds.merge_rounds(df).collect()}
    assert set(got) == {1, 3, 4, 5}
    assert got[1].merged == [2] and got[1].label == "Seed" and got[1].valuation == 900.0 and got[1].others == ["B", "C"]
    assert rounds.merge_rounds(df.limit(0)).count() == 0


def test_names_and_amounts(spark):
    df = spark.createDataFrame([("Acme, Inc.",), ("ACME inc",), (None,), ("",)], "n string")
    got = [r[0] for r in df.select(names.company_name_key(F.col("n"))).collect()]
    assert got[0] == got[1] and got[0]
    amounts = spark.createDataFrame([("$2.5 million",), ("1,200",), (None,), ("none",)], "t string")
    got = [r[0] for r in amounts.select(money.parse_amount(F.col("t"))).collect()]
    assert float(got[0]) == 2_500_000 and float(got[1]) == 1200 and got[2] is None and got[3] is None


def test_registrable_domains(spark):
    df = spark.createDataFrame([("https://www.shop.example.co.uk/x?y",), ("http://Example.com",), (None,)], "u string")
    assert [r[0] for r in df.select(web.registrable_domain(F.col("u"))).collect()] == ["example.co.uk", "example.com", None]


def test_best_window():
    assert text.best_window("one two three four", "zero one two three four five") == 1.0
    assert text.best_window("one two three four", "nothing of the kind is here") < 0.5


def test_quotes_in_many_documents(spark, tmp_path):
    quote = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(30)]
    near = [*quote[:29], "changed"]
    texts = [" ".join(quote[::-1] * 3)] * 4 + ["before " + " ".join(quote) + " after"] * 6 + ["x " + " ".join(near), "bob" + " ".join(quote) + "s", "a tea cup", "the cup"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(quote)), (2, "Tea cup"), (3, "..."), (4, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = textual.quote_checks(spark, str(tmp_path)).where("matched").collect()
    want = [(i, d) for i, q in ((1, " ".join(quote)), (2, "tea cup")) for d, s in enumerate(texts) if q in s or text.best_window(q, s) >= 0.9]
    assert sorted((r.item_id, r.doc_id) for r in got) == want and len(want) == 9


def test_streams(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    at = dt.datetime(2024, 1, 1)
    rows = [("b", "j", True, at), ("b", "j", False, at + dt.timedelta(days=1)), ("b", "j", True, at + dt.timedelta(days=2)), ("b", "k", False, at)]
    spark.createDataFrame(rows, "board string, job string, listed boolean, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("board string, job string, listed boolean, at timestamp").parquet(f"{tmp_path}/in")
    got = events.run_available(events.job_lifecycle(stream), "lifecycle", checkpoint=f"{tmp_path}/c1")
    assert sorted((r.job, r.event, r.first_seen == at) for r in got.collect()) == [("j", "closed", True), ("j", "opened", True), ("j", "reopened", True)]
    once = events.run_available(events.fresh_alerts(stream, ["board", "job"], "at"), "alerts", checkpoint=f"{tmp_path}/c2")
    assert once.count() == 2
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_pairs_near_in_id_meet_in_cells(spark):
    """Rows of one key meet only where their ids are near: rows joined stay in proportion to rows."""
    from tessera.operators.resolve import same_key_pairs

    ids = [-205, -101, -100, -1, 0, 1, 99, 100, 101, 199, 200, 350]
    got = {(r.left_id, r.right_id) for r in same_key_pairs(spark.createDataFrame([("k", i) for i in ids], "key string, id long"), "key", "id", within=100).collect()}
    assert got == {(a, b) for a in ids for b in ids if a < b < a + 100}
    many = same_key_pairs(spark.range(20_000).selectExpr("'k' AS key", "id"), "key", "id", within=100)
    assert many.count() == sum(min(99, 19_999 - i) for i in range(20_000))
    assert "_cell" in many._jdf.queryExecution().optimizedPlan().toString()


def test_all_pairs_of_a_key_are_candidates(spark, monkeypatch):
    """However far their ids are apart, in parts of a key, with ids that stand twice, without a key or decided in either order."""
    from tessera.operators import resolve
    from tessera.plans.catalog import load

    monkeypatch.setattr(resolve, "PART_ROWS", 7)
    rows = [(f"k{i % 3}", i * 1000 % 7919) for i in range(60)] + [("k0", 5_000_000), ("k0", 5_000_000), ("k1", -4), ("k1", -4), ("k1", -4), (None, 1), (None, 2), ("k2", None), ("alone", 9)]
    df = spark.createDataFrame(rows, "key string, id long")
    every = sorted((a, b) for i, (k, a) in enumerate(rows) for j, (m, b) in enumerate(rows) if k is not None and k == m and a is not None and b is not None and a < b)
    assert sorted((r.left_id, r.right_id) for r in resolve.same_key_pairs(df, "key", "id").collect()) == every
    gone = {p for p in every if sum(p) % 4 == 0}
    decisions = spark.createDataFrame([p if sum(p) % 8 == 0 else p[::-1] for p in gone] + [(1, 2), (8, 8)], "left_id long, right_id long")
    left = resolve.undecided_pairs(df, "key", "id", decisions)
    assert gone and sorted((r.left_id, r.right_id) for r in left.collect()) == [p for p in every if p not in gone]
    assert load()[0]["undecided_pairs"](spark, "/root/testdata/sf0.001").where("right_id - left_id >= 100").count() > 0
