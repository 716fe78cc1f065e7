"""Materialised results in versions: readers see whole ones, a refresh writes only the buckets that it touches.

A snapshot is a folder.  Rows lie in buckets by a hash of their key.  Each version has a
pointer, a small file that says in which version's folder every bucket lies.  A pointer is
created after all of its data is written and is never changed, so a reader, who takes
the newest, sees either the version before or all of the new one; a refresh that fails
leaves files that nothing points to.  Two refreshes of one version can't both create
its successor: the second raises.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a new snapshot, unless the caller knows better: about one for each few hundred megabytes.
BUCKETS = 64


def _store(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _pointers(spark: SparkSession, root: str) -> list[int]:
    fs, at = _store(spark, f"{root}/pointers")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(at)) if fs.exists(at) else []


def _point(spark: SparkSession, root: str, version: int, what: dict) -> None:
    fs, at = _store(spark, f"{root}/pointers/{version:012d}")
    out = fs.create(at, False)  # fails where it exists
    try:
        out.write(bytearray(json.dumps(what, sort_keys=True).encode()))
    finally:
        out.close()


def current(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """The pointer of a version, or of the newest: version, key, n_buckets, schema, folders (bucket: version)."""
    known = _pointers(spark, root)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"{root} has no version {version if version is not None else ''}")
    lines = spark.read.text(f"{root}/pointers/{version if version is not None else known[-1]:012d}").collect()
    return json.loads("".join(r[0] for r in lines))


def _bucketed(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def _write(df: DataFrame, root: str, version: int) -> None:
    df.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{root}/data/{version:012d}")


def _written(spark: SparkSession, root: str, version: int) -> set[int]:
    fs, at = _store(spark, f"{root}/data/{version:012d}")
    return {int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(at) if f.getPath().getName().startswith("_bucket=")}


def publish(df: DataFrame, root: str, key: str, *, buckets: int = BUCKETS) -> int:
    """Write all rows as a new version and return its number; null keys are a key of their own."""
    spark = df.sparkSession
    version = (_pointers(spark, root) or [0])[-1] + 1
    _write(_bucketed(df, key, buckets), root, version)
    _point(spark, root, version, {"version": version, "key": key, "n_buckets": buckets, "schema": df.schema.jsonValue(), "folders": {b: version for b in _written(spark, root, version)}})
    return version


def _read(spark: SparkSession, root: str, at: dict, buckets: set[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(at["schema"])
    paths = [f"{root}/data/{v:012d}/_bucket={b}" for b, v in sorted(at["folders"].items()) if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a version, or of the newest; later versions don't change what is read."""
    return _read(spark, root, current(spark, root, version))


def refresh(spark: SparkSession, root: str, touched: DataFrame, rebuild: Callable[[DataFrame], DataFrame]) -> int:
    """A new version in which the rows of all ``touched`` keys are what ``rebuild`` makes of them.

    touched: a column named as the snapshot's key; rebuild: takes the distinct touched keys and
    returns their rows (none for a key that is gone).  Only buckets with a touched
    key are read and written; all others stay where they are.  With nothing
    touched the newest version stays.
    """
    at = current(spark, root)
    key, n, version = at["key"], at["n_buckets"], at["version"] + 1
    keys = _bucketed(touched.select(key).distinct(), key, n)
    hit = {r[0] for r in keys.select("_bucket").distinct().collect()}  # as many as there are buckets
    if not hit:
        return at["version"]
    gone = keys.select(F.col(key).alias("_gone"))
    kept = _read(spark, root, at, hit)
    kept = kept.join(gone, kept[key].eqNullSafe(gone["_gone"]), "left_anti")
    new = rebuild(keys.select(key)).select(*kept.columns)
    _write(_bucketed(kept.unionByName(new), key, n), root, version)
    folders = {b: v for b, v in at["folders"].items() if int(b) not in hit} | {str(b): version for b in _written(spark, root, version)}
    _point(spark, root, version, at | {"version": version, "folders": folders})
    return version


def prune(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Remove all but the newest ``keep`` versions and the data that none of them points to; returns the folders removed."""
    known = _pointers(spark, root)
    used = {int(v) for x in known[-keep:] for v in current(spark, root, x)["folders"].values()}
    for version in known[:-keep]:
        fs, at = _store(spark, f"{root}/pointers/{version:012d}")
        fs.delete(at, False)
    removed = 0
    for version in known:
        fs, at = _store(spark, f"{root}/data/{version:012d}")
        if version not in used and fs.exists(at):
            fs.delete(at, True)
            removed += 1
    return removed
