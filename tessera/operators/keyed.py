"""Keyed writes without a MERGE: upserts, gap filling, diffs, undo."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: How a column of an existing row meets the incoming one.
KEEP, NEW, UNION, EITHER = "keep_existing", "prefer_new", "union", "either"


def _merged(name: str, policy: str) -> Column:
    old, new = F.col(f"_old.{name}"), F.col(f"_new.{name}")
    if policy == UNION:
        return F.sort_array(F.array_union(F.coalesce(old, new), F.coalesce(new, old)))
    if policy == EITHER:
        return F.coalesce(old | new, old, new)
    return F.coalesce(new, old) if policy == NEW else F.coalesce(old, new)


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], policies: dict[str, str]) -> DataFrame:
    """All rows of both sides, one per key; columns meet by policy and null never overwrites.

    ``incoming`` has one row per key.  Rows with a null in the key match nothing
    and are all kept, as under a partial unique index.
    """
    values = [c for c in existing.columns if c not in keys]
    old = existing.select(*keys, F.struct(*values).alias("_old"))
    new = incoming.select(*keys, F.struct(*values).alias("_new"))
    return old.join(new, list(keys), "full").select(*keys, *[_merged(c, policies.get(c, NEW)).alias(c) for c in values])


def insert_new(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Incoming rows whose key isn't there yet, the first of each key; null keys pass."""
    keyed = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    ranked = incoming.where(keyed).withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return ranked.join(existing.select(*keys), list(keys), "left_anti").unionByName(incoming.where(~keyed))


def diff(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, before, after, status (lost, added, changed, same) of two keyed snapshots."""
    b = before.select(*keys, F.col(value).alias("before"), F.lit(True).alias("_b"))
    a = after.select(*keys, F.col(value).alias("after"), F.lit(True).alias("_a"))
    status = (
        F.when(F.col("_a").isNull(), "lost")
        .when(F.col("_b").isNull(), "added")
        .when(F.col("before").eqNullSafe(F.col("after")), "same")
        .otherwise("changed")
    )
    return b.join(a, list(keys), "full").select(*keys, "before", "after", status.alias("status"))


def lifecycle(held: DataFrame, listing: DataFrame, fetched: DataFrame, *, board: str, job: str, at: Column) -> DataFrame:
    """State of jobs after a crawl: board, job, first_seen_at, closed_at, is_active, event.

    ``held``: board, job, first_seen_at, closed_at.  ``listing``: jobs found now.
    ``fetched``: boards whose fetch succeeded; a failed one closes nothing.  A
    job that comes back is reopened and keeps its first sight.
    """
    live = listing.select(board, job).distinct().withColumn("_live", F.lit(True))
    ok = fetched.select(board).distinct().withColumn("_ok", F.lit(True))
    both = held.withColumn("_held", F.lit(True)).join(live, [board, job], "full").join(ok, board, "left")
    here, was = F.col("_live").isNotNull(), F.col("_held").isNotNull()
    open_ = was & F.col("closed_at").isNull()
    event = (
        F.when(here & ~was, "opened")
        .when(here & ~open_, "reopened")
        .when(~here & open_ & F.col("_ok").isNotNull(), "closed")
        .otherwise("unchanged")
    )
    closed = F.when(here, None).when(event == "closed", at).otherwise(F.col("closed_at"))
    return both.select(board, job, F.coalesce("first_seen_at", at).alias("first_seen_at"), closed.alias("closed_at"), closed.isNull().alias("is_active"), event.alias("event"))


def gap_fill(members: DataFrame, *, group: str, rank: Sequence[Column], arrays: Sequence[str] = ()) -> DataFrame:
    """One row per group: the first-ranked member with its gaps filled from the others in rank order.

    Array columns are unions of distinct values.  ``filled`` lists the columns
    that another member supplied.
    """
    values = [c for c in members.columns if c != group and c not in arrays]
    ranked = members.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(*rank)))
    firsts = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_n"))).alias(c) for c in values]
    own = [F.max(F.when(F.col("_n") == 1, F.col(c).isNull())).alias(f"_gap_{c}") for c in values]
    unions = [F.sort_array(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in arrays]
    merged = ranked.groupBy(group).agg(*firsts, *own, *unions, F.count("*").alias("members"))
    filled = F.filter(F.array(*[F.when(F.col(f"_gap_{c}") & F.col(c).isNotNull(), F.lit(c)) for c in values]), lambda x: x.isNotNull())
    return merged.select(group, *values, *arrays, "members", filled.alias("filled"))


def repoint(refs: DataFrame, merged: DataFrame, column: str, unique: Sequence[str]) -> DataFrame:
    """References moved from losers to survivors (loser, survivor); of those that then collide one stays."""
    moved = refs.join(merged.select(F.col("loser").alias(column), "survivor"), column, "left").withColumn(column, F.coalesce("survivor", column)).drop("survivor")
    return moved.dropDuplicates(list(unique))


def undo_plan(changes: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What undoing a run does to each value: restore where it still is what the run wrote, else skip.

    ``changes``: keys, seq, old_value, new_value in the order written; a value
    goes back to what it was before the first change and must equal the last.
    """
    span = changes.groupBy(*keys).agg(F.min_by("old_value", "seq").alias("old_value"), F.max_by("new_value", "seq").alias("wrote"))
    joined = span.join(current.select(*keys, F.col("value").alias("now"), F.lit(True).alias("_there")), list(keys), "left")
    action = (
        F.when(F.col("_there").isNull(), "skip: gone").when(~F.col("now").eqNullSafe(F.col("wrote")), "skip: changed since").when(F.col("old_value").isNull(), "delete").otherwise("restore")
    )
    return joined.select(*keys, "old_value", "wrote", "now", action.alias("action"))


def overlay(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Rows of ``patch`` in place of all rows of their key in ``base``."""
    return base.join(patch.select(key).distinct(), key, "left_anti").unionByName(patch, allowMissingColumns=True)


def unchanged_removed(rows: DataFrame, stored: DataFrame, key: str, *, model: str, dimensions: int, text: Column) -> DataFrame:
    """Rows whose text, model or size differs from what the stored hash was made of; those without one first."""
    hashed = rows.withColumn("content_hash", F.md5(F.concat_ws(":", F.lit(model), F.lit(str(dimensions)), text)))
    joined = hashed.join(stored.select(key, F.col("content_hash").alias("_stored")), key, "left")
    return joined.where(~F.col("content_hash").eqNullSafe(F.col("_stored"))).withColumn("is_new", F.col("_stored").isNull()).drop("_stored")


def violations(df: DataFrame, key: str, rules: dict[str, tuple[Column, str]]) -> DataFrame:
    """(key, rule, action) of every rule that a row breaks; ``rules``: name -> (broken, action)."""
    each = [F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(action).alias("action"))) for name, (broken, action) in rules.items()]
    return df.select(key, F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("v")).select(key, "v.rule", "v.action")
