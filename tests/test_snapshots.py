"""Versions of a materialised result."""

import pytest
from pyspark.sql import functions as F

from tessera.sources import snapshots


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_versions(spark, tmp_path):
    root = f"file://{tmp_path}/view"
    base = {k: k % 5 for k in range(200)} | {None: 9}
    frame = lambda d: spark.createDataFrame(list(d.items()), "k long, v long")
    assert snapshots.publish(frame(base), root, "k", buckets=8) == 1
    old = snapshots.read(spark, root)
    touched = spark.createDataFrame([(3,), (3,), (4,), (500,), (None,)], "k long")
    new = {3: 77, 500: 1}  # 4 and the null key are gone
    asked = []

    def rebuild(keys):
        asked.extend(r[0] for r in keys.collect())
        return frame({k: v for k, v in new.items() if k in asked})

    assert snapshots.refresh(spark, root, touched, rebuild) == 2
    want = {k: v for k, v in base.items() if k not in (3, 4, None)} | new
    assert sorted(map(repr, asked)) == sorted(map(repr, [3, 4, 500, None]))
    assert rows(snapshots.read(spark, root)) == sorted(want.items(), key=repr)
    assert rows(old) == rows(snapshots.read(spark, root, 1)) == sorted(base.items(), key=repr)  # who read before still reads all of it
    at = snapshots.current(spark, root)
    hit = frame({k: 0 for k in (3, 4, 500, None)}).select(F.pmod(F.xxhash64("k"), F.lit(8))).distinct().count()
    assert sum(v == 2 for v in at["folders"].values()) <= hit < 8 and 1 in at["folders"].values()
    assert snapshots.refresh(spark, root, touched.limit(0), rebuild) == 2
    with pytest.raises(Exception, match="(?i)exist"):
        snapshots._point(spark, root, 2, {})
    assert snapshots.refresh(spark, root, snapshots.read(spark, root).select("k"), lambda keys: frame({1: 1})) == 3
    assert rows(snapshots.read(spark, root)) == [(1, 1)]
    assert snapshots.prune(spark, root, keep=1) == 2 and rows(snapshots.read(spark, root)) == [(1, 1)]
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, root, 1)


def test_empty(spark, tmp_path):
    root = f"file://{tmp_path}/view"
    snapshots.publish(spark.createDataFrame([], "k long, v string"), root, "k")
    assert snapshots.read(spark, root).count() == 0
    assert snapshots.refresh(spark, root, spark.createDataFrame([(1,)], "k long"), lambda keys: keys.withColumn("v", F.lit("x"))) == 2
    assert rows(snapshots.read(spark, root)) == [(1, "x")]
