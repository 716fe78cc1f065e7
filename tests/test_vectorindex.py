"""The vector index against all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import vectorindex


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_on_the_table(spark, folder):
    e = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    queries = e.where("vec_id % 100 = 0")
    index = vectorindex.build(e, unique="vec_id")
    probes = vectorindex.calibrate(index, e, 10, unique="vec_id")
    found = vectorindex.search(index, queries, 10, probes=probes, unique="vec_id")
    assert vectorindex.recall(found, vectorindex.exact(e, queries, 10, unique="vec_id")) >= 0.9


def drawn(n, seed=1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(40, 16))
    return [(i, [float(x) for x in middles[i % 40] + 0.6 * rng.normal(size=16)]) for i in range(n)]


def test_all_cells_are_exact(spark, monkeypatch):
    """With every cell probed, in small slices and blocks, the index gives what all pairs give; a third of all rows are one vector."""
    monkeypatch.setattr(vectorindex, "SLICE_ROWS", 32)
    monkeypatch.setattr(vectorindex, "QUERY_ROWS", 16)
    rows = drawn(300) + [(1000 + i, [1.0] * 16) for i in range(150)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [1.0]), (2003, [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").withColumn("cell", F.lit("x"))
    index = vectorindex.build(df)
    assert index.rows.count() == 450 and index.sizes.agg(F.max("slices")).first()[0] >= 5
    got = sorted(map(tuple, vectorindex.search(index, df, 7, probes=10**6).select("id", "peer", "place").collect()))
    assert got == sorted(map(tuple, vectorindex.exact(df, df, 7).select("id", "peer", "place").collect()))


def test_few_probes_where_vectors_cluster(spark):
    df = spark.createDataFrame(drawn(1200), "id long, embedding array<double>")
    index = vectorindex.build(df)
    probes = vectorindex.calibrate(index, df, 10)
    assert probes <= len(index.centres) // 3
    assert vectorindex.recall(vectorindex.search(index, df, 10, probes=probes), vectorindex.exact(df, df, 10)) >= 0.9


def test_saved_index(spark, tmp_path):
    df = spark.createDataFrame(drawn(200), "id long, embedding array<double>")
    index = vectorindex.build(df)
    index.save(f"file://{tmp_path}/index")
    again = vectorindex.VectorIndex.load(spark, f"file://{tmp_path}/index")
    a, b = (sorted(map(tuple, vectorindex.search(x, df, 5).collect())) for x in (index, again))
    assert a == b and len(a) == 1000


def test_empty(spark):
    df = spark.createDataFrame([], "id long, embedding array<double>")
    assert vectorindex.search(vectorindex.build(df), df, 3).count() == 0
