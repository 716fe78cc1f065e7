"""Relational building blocks: latest rows, as-of joins, segments, ranks, pages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each key: the first by ``order`` (which should end in a unique column)."""
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key."""
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= k).drop("_rank")


def latest_values(df: DataFrame, keys: Sequence[str], at: Column, values: Sequence[str]) -> DataFrame:
    """Values of the newest row of each key by aggregation alone: no sort, partial results combine."""
    picked = F.max(F.struct(at.alias("_at"), *values)).alias("_last")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col("_last").getField(v).alias(v) for v in values])


def in_window(base: DataFrame, history: DataFrame, key: str, at: str, observed: str, values: Sequence[str], *, after: str, before: str, newest: bool = True, prefix: str = "") -> DataFrame:
    """Per row of ``base`` the newest (or oldest) observation in [at - after, at - before].

    ``base`` has one row per (key, at).  Both ends belong to the window; a row
    without an observation in it has nulls.  An equi-join on the key with the
    window as a range condition, then one aggregation per (key, at).
    """
    h = history.select(F.col(key).alias("_key"), F.col(observed).alias("_seen"), *[F.col(v).alias(f"_{v}") for v in values])
    within = (F.col("_seen") >= F.col(at) - F.expr(f"INTERVAL {after}")) & (F.col("_seen") <= F.col(at) - F.expr(f"INTERVAL {before}"))
    pick = F.max if newest else F.min
    struct = F.struct("_seen", *[f"_{v}" for v in values])
    found = base.select(key, at).join(h, (F.col(key) == F.col("_key")) & within).groupBy(key, at).agg(pick(struct).alias("_o"))
    named = found.select(key, at, F.col("_o._seen").alias(f"{prefix}at"), *[F.col(f"_o._{v}").alias(f"{prefix}{v}") for v in values])
    return base.join(named, [key, at], "left")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, values: Sequence[str]) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before its time.

    Both sides run as one stream per key and the last seen value is carried
    forward, so the cost is one sort, however many right rows a key has.  Of
    right rows at one time that with the greatest values counts.
    """
    carried = F.struct(*[F.col(v).alias(v) for v in values])
    r = right.where(F.col(right_at).isNotNull()).groupBy(*keys, right_at).agg(F.max(carried).alias("_value"))
    r = r.select(*keys, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), "_value", F.lit(None).cast(left.select(F.struct("*").alias("x")).schema["x"].dataType).alias("_row"))
    l = left.select(*keys, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_value"].dataType).alias("_value"), F.struct(*left.columns).alias("_row"))
    run = W.partitionBy(*keys).orderBy(F.col("_at").asc_nulls_first(), "_side").rowsBetween(W.unboundedPreceding, 0)
    filled = r.unionByName(l).withColumn("_value", F.last("_value", ignorenulls=True).over(run)).where("_side = 1")
    return filled.select("_row.*", *[F.col("_value").getField(v).alias(v) for v in values])


def segments(df: DataFrame, key: str, order: Sequence[Column], starts: Column, name: str = "segment") -> DataFrame:
    """Number the stretches of each key; a row for which ``starts`` holds begins a new one."""
    run = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(run))


def amended(filings: DataFrame, *, group: str, filed: str, form: str, original: str, values: Sequence[str], days: int = 400, unique: str = "id") -> DataFrame:
    """Originals (and amendments without one) with the values of their last amendment.

    A filing belongs to the stretch that the latest original starts; only filings
    under ``days`` after the head count.  Filings before any original stand as
    heads of their own where no filing of the group precedes them by ``days`` or
    less.
    """
    order = [F.col(filed), (F.col(form) == original).desc(), F.col(unique)]
    above = F.lag(F.struct(F.col(filed), F.col(form) == original)).over(W.partitionBy(group).orderBy(*order))
    again = above.eqNullSafe(F.struct(F.col(filed), F.lit(True)))  # originals of one day start one stretch
    marked = filings.withColumn("_starts", (F.col(form) == original) & ~again)
    numbered = segments(marked, group, order, F.col("_starts")).drop("_starts")
    before = F.max(filed).over(W.partitionBy(group).orderBy(F.col(filed).cast("timestamp").cast("long")).rangeBetween(W.unboundedPreceding, -1))
    numbered = numbered.withColumn("_before", before)
    heads = numbered.where((F.col(form) == original) | F.col("_before").isNull() | (F.datediff(F.col(filed), F.col("_before")) > days))
    follow = numbered.select(F.col(group).alias("_g"), F.col("segment").alias("_s"), F.col(filed).alias("_f"), F.struct(F.col(filed), F.col(form), *values).alias("_v"))
    near = (F.col(group) == F.col("_g")) & (F.col("segment") == F.col("_s")) & (F.col("_f") >= F.col(filed)) & (F.datediff(F.col("_f"), F.col(filed)) < days)
    last = heads.select(unique, group, "segment", filed).join(follow, near).groupBy(unique).agg(F.max("_v").alias("_v"))
    kept = [c for c in filings.columns if c not in values]
    joined = heads.select(*kept).join(last, unique)
    return joined.select(*kept, F.col("_v").getField(filed).alias("updated"), *[F.col("_v").getField(v).alias(v) for v in values])


def page(df: DataFrame, order: Sequence[Column], number: int, size: int = 40) -> DataFrame:
    """One page; ``order`` should end in a unique column."""
    return df.orderBy(*order).offset(number * size).limit(size)


def clamp_limit(n: int | None, most: int = 50) -> int:
    return min(max(n or 1, 1), most)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def filtered(df: DataFrame, conditions: dict[str, Column | None]) -> DataFrame:
    """Apply the conditions that are given."""
    return reduce(lambda d, c: d.where(c), [c for c in conditions.values() if c is not None], df)


def names_of(df: DataFrame, key: Sequence[str], lead: str, others: str) -> DataFrame:
    """Distinct (key, name) of leads and participants, so that either way is one equi-join."""
    every = F.array_distinct(F.transform(F.concat(F.coalesce(others, F.array().cast("array<string>")), F.array(lead)), lambda x: F.lower(F.trim(x))))
    return df.select(*key, F.explode(every).alias("name")).where("name is not null and name != ''").distinct()


def weekly(start: Column, end: Column) -> Column:
    """Mondays from the week of ``start`` to that of ``end``."""
    return F.sequence(F.date_trunc("week", start).cast("date"), F.date_trunc("week", end).cast("date"), F.expr("INTERVAL 7 DAYS"))


def spread_pick(df: DataFrame, bucket: str, order: Sequence[Column], n: int) -> DataFrame:
    """``n`` rows taken in turn from the buckets, each in its order."""
    turn = df.withColumn("_turn", F.row_number().over(W.partitionBy(bucket).orderBy(*order)))
    return turn.orderBy("_turn", bucket).limit(n).drop("_turn")


def every_pair(left: DataFrame, right: DataFrame, left_key: str, right_key: str, *, block: int = 2048) -> DataFrame:
    """All pairs of rows of two tables, joined by cells of about ``block`` rows of each, so neither has to fit a task."""
    m, n = (max(1, -(-df.count() // block)) for df in (left, right))
    turns = {"_i": F.sequence(F.lit(0), F.lit(m - 1)), "_j": F.sequence(F.lit(0), F.lit(n - 1))}
    a = left.withColumn("_i", F.pmod(F.xxhash64(left_key), F.lit(m)).cast("int")).withColumn("_j", F.explode(turns["_j"]))
    b = right.withColumn("_j", F.pmod(F.xxhash64(right_key), F.lit(n)).cast("int")).withColumn("_i", F.explode(turns["_i"]))
    return a.join(b, ["_i", "_j"]).drop("_i", "_j")
