"""Names alike by trigrams against every pair, and no names sent through the driver."""

import random
import re

from tessera.operators import resolve


def grams(name):
    return {w[i : i + 3] for w in (f"  {x} " for x in re.findall("[a-z0-9]+", name.lower())) for i in range(len(w) - 2)}


def test_names_of_all_sizes_against_every_pair(spark):
    rng = random.Random(9)
    names = ["", "-", "a", "A", "ab", None]
    for words in (1, 2, 4, 9, 30, 60):
        for _ in range(12):
            name = " ".join("".join(rng.choices("abcdnorst0123", k=rng.randint(3, 9))) for _ in range(words))
            at = rng.randrange(len(name))
            names += [name, name[:at] + name[at + 1 :], name + " s", name + rng.choice("xyz") + " co", name.upper()]
    rows = list(enumerate(names))
    got = {(r.left_id, r.right_id): r.likeness for r in resolve.similar_names(spark.createDataFrame(rows, "id long, name string"), "name", "id").collect()}
    first = {}
    for i, name in rows:
        if name is not None and grams(name):
            first.setdefault(name, i)
    want = {}
    for a, i in first.items():
        for b, j in first.items():
            if i < j:
                x, y = grams(a), grams(b)
                if len(x & y) / len(x | y) >= 0.86:
                    want[i, j] = round(len(x & y) / len(x | y), 3)
    assert got == want and len(want) > 100


def test_names_of_a_packed_file_meet_in_merged_joins(spark, tmp_path):
    path = f"file://{tmp_path}/names"
    spark.createDataFrame([(1, "north star 1234"), (2, "north star 1234 s")], "id long, name string").write.parquet(path)
    found = resolve.similar_names(spark.read.parquet(path), "name", "id")
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().sparkPlan().toString()
    assert found.count() == 0 or found.first().likeness >= 0.86
