"""The full-text index against all rows, and how much of it a search reads."""

import random
import re
from collections import Counter

from tessera.operators import fulltext


def test_search_against_all_rows(spark, tmp_path):
    rng = random.Random(4)
    pool = [f"w{i}" for i in range(30)] + ["common"] * 20
    rows = [(i, " ".join(rng.choices(pool, k=rng.randint(0, 4))), " ".join(rng.choices(pool, k=rng.randint(0, 30)))) for i in range(600)] + [(900, None, None), (901, "COMMON common", "Common, w1!")]
    weights = {"title": 1.0, "body": 0.2}
    path = f"file://{tmp_path}/index"
    fulltext.build(spark.createDataFrame(rows, "id long, title string, body string").repartition(3), path, "id", weights, block=16)
    scores = {}
    for i, title, body in rows:
        scores[i] = Counter()
        for text, weight in ((title, 1.0), (body, 0.2)):
            for w in re.findall(r"\w+", (text or "").lower()):
                scores[i][w] += weight
    read = []
    for query in ("common", "w1 w2", "w3 common W7 w3", "nothing", "", "common nothing"):
        words = set(query.lower().split())
        want = sorted(((-round(sum(s[w] for w in words), 6), i) for i, s in scores.items() if any(w in s for w in words)))[:10]
        best, blocks = fulltext.search(spark, path, query, 10)
        assert [(-r.score, r.id) for r in best.collect()] == want, query
        read.append(blocks)
    assert read[0] < 30  # a word of some 35 blocks isn't read whole for its ten best


def test_positions(spark):
    rows = spark.createDataFrame([(1, "a b a", "b")], "id long, title string, body string")
    got = {r.word: (r.score, r.places) for r in fulltext.postings(rows, "id", {"title": 1.0, "body": 0.5}).collect()}
    assert got == {"a": (2.0, {"title": [0, 2]}), "b": (1.5, {"title": [1], "body": [0]})}


def test_occurrences_are_not_shuffled(spark):
    rows = spark.createDataFrame([(1, "a b a", "b"), (2, "", None), (1, "b", None), (None, "é_x", "9")], "id long, title string, body string")
    found = fulltext.postings(rows, "id", {"title": 1.0, "body": 0.5})
    assert "collect_list" not in found._jdf.queryExecution().sparkPlan().toString()
    got = {(r.id, r.word): (r.score, r.places) for r in found.collect()}
    assert got == {(1, "a"): (2.0, {"title": [0, 2]}), (1, "b"): (2.5, {"title": [0, 1], "body": [0]}), (None, "é"): (1.0, {"title": [0]}), (None, "x"): (1.0, {"title": [1]}), (None, "9"): (0.5, {"body": [0]})}
