"""Dense vectors: cosine, likeness in percent, centroids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null where one has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def percent(cos: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(100 * cos)))


def centroids(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Mean vector of each group with its number of vectors; partial sums combine before the shuffle."""
    each = df.where(F.col(vector).isNotNull()).select(*keys, F.posexplode(vector).alias("pos", "x"))
    means = each.groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    parts = means.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("parts"), F.max("n").alias("signal_count"))
    return parts.select(*keys, F.transform("parts", lambda p: p["x"]).alias("centroid"), "signal_count")
