"""Mixing sources to target weights by the cube method.

Each source gets a target number of words.  target / size is the number of times
its documents are to be taken; the whole part is taken outright, the fraction is
an inclusion probability.  The flight phase of the cube method turns these
probabilities into 0 or 1: three undecided documents at a time move along the
null-space of the balancing constraints (number of documents, number of words),
so both totals stay what they were while at least one document is decided.  It
runs in groups of a source, so a source that holds a third of all rows is spread
over many tasks.  At most two documents of a group stay undecided; these meet in
ever larger groups until a source has at most two left, the landing problem,
which is settled with the count constraint dropped first.

The draws depend on the seed, the source and the documents, not on the layout of
partitions, so reruns agree.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import hot_keys, numbered_copies, settle

#: Documents of a source that one flight group aims for, and groups that meet at the next level.
GROUP_DOCS, FAN_IN = 1024, 256
#: A source's target stops at this many times its size.
MOST_TIMES = 3
_EPS = 1e-9


def word_count(text):
    """Number of runs of characters other than space and tab to carriage return; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def content_key(docs: DataFrame, columns: list[str] | None = None):
    """16 bytes that stand for a row's values in ``columns`` (doc_id, source and text by default).

    The values' lengths come first, with a mark of its own for null, so that no
    two different rows are written alike.
    """
    parts = []
    for c in columns or ["doc_id", "source", "text"]:
        kind = docs.schema[c].dataType
        parts.append(F.to_json(F.struct(docs[c].alias("v"))) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else docs[c].cast("string"))
    sizes = F.concat_ws(",", *[F.coalesce(F.length(c).cast("string"), F.lit("null")) for c in parts])
    return F.unhex(F.md5(F.concat_ws("\u0000", sizes, *parts).cast("binary")))


def targets(sizes: DataFrame, pattern: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size, target from one (source, source_size) row per source.

    Sources in code point order, null last, weigh ``pattern``, repeating, and
    share the sum of all sizes.  A target stops at MOST_TIMES times its size;
    the excess is shared again by weight until none is above.  Each turn of the
    loop brings two sums to the driver, whatever the number of sources.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weighed = settle(
        sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, pattern)), ((F.row_number().over(order) - 1) % len(pattern)) + 1)),
        "weights",
    )
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    rate = 0.0  # words for each unit of weight; it only grows, so a capped source stays capped
    while True:
        capped = F.col("weight") * F.lit(rate) >= MOST_TIMES * F.col("source_size")
        held, weight = weighed.agg(
            F.sum(F.when(capped, MOST_TIMES * F.col("source_size")).otherwise(0)), F.sum(F.when(capped, 0).otherwise(F.col("weight")))
        ).first()
        new = (total - held) / weight if weight else rate
        if new <= rate:
            break
        rate = new
    return weighed.select(
        "source", "source_size", F.least(F.col("weight") * F.lit(float(rate)), (MOST_TIMES * F.col("source_size")).cast("double")).alias("target")
    )


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """Decide probabilities ``pi`` of documents that have ``size`` words.

    At most two stay between 0 and 1; with ``land`` none does.
    """
    p, s = pi.astype(float).tolist(), size.astype(float).tolist()
    draws = iter(rng.random(2 * len(p) + 8).tolist())
    open_: list[int] = []

    def move(at: list[int], v: list[float]) -> None:
        up = min(((1 - p[i]) / d if d > 0 else p[i] / -d) for i, d in zip(at, v) if d)
        down = min((p[i] / d if d > 0 else (1 - p[i]) / -d) for i, d in zip(at, v) if d)
        step = up if next(draws) * (up + down) < down else -down
        for i, d in zip(at, v):
            x = p[i] + step * d
            p[i] = 0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x

    for i in range(len(p)):
        if _EPS < p[i] < 1 - _EPS:
            open_.append(i)
        else:
            p[i] = float(round(p[i]))
        if len(open_) == 3:
            a, b, c = (s[j] for j in open_)
            v = [c - b, a - c, b - a]
            move(open_, v if any(v) else [1.0, -1.0, 0.0])
            open_ = [j for j in open_ if 0.0 < p[j] < 1.0]
    if land:
        if len(open_) == 2:
            a, b = (s[j] for j in open_)
            move(open_, [b, -a] if a or b else [1.0, -1.0])
            open_ = [j for j in open_ if 0.0 < p[j] < 1.0]
        for j in open_:
            p[j] = 1.0 if next(draws) < p[j] else 0.0
    return np.array(p)


def _decider(seed: int, level: int, last: bool):
    """Function that runs the flight phase on one group of a source."""

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "content", "pi"], kind="stable", na_position="last")
        name = f"{seed}/{level}/{pdf['source'].iloc[0]}/{pdf['slot'].iloc[0]}"
        rng = np.random.default_rng(zlib.crc32(name.encode("utf-8", "surrogatepass")))
        return pdf.assign(pi=flight(pdf["pi"].to_numpy(), pdf["size"].to_numpy(), rng, last))

    return decide


def mix(docs: DataFrame, *, seed: int = 0, pattern: tuple[int, ...] = (1, 2, 3), same: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: how often the mix takes it.

    Returns doc_id, content (a hash that tells rows of one doc_id apart), source,
    size, source_size, target, copies, taken (words, repeats counted).  ``same``
    names the columns that the hash covers (doc_id, source, text).  A null
    text has size 0, a null source is a source of its own.  Rows equal in all of
    these are interchangeable.  A source of size 0 has target 0 and takes none;
    an empty table gives an empty one.
    """
    units = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), content_key(docs, same).alias("content"))
    units = settle(numbered_copies(units, "copy"), "sizes")
    per_source = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    per_source = settle(per_source, "sources")
    aims = targets(per_source.select("source", "source_size"))
    plan = (
        aims.join(per_source.select("source", "n_docs"), aims["source"].eqNullSafe(per_source["source"]))
        .drop(per_source["source"])
        .withColumn("times", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .withColumn("groups", F.ceil(F.col("n_docs") / F.lit(GROUP_DOCS)).cast("int"))
    )
    most_groups = plan.agg(F.max("groups")).first()[0] or 1
    plan = plan.withColumnRenamed("source", "plan_source")
    rows = (
        units.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
        .withColumn("whole", F.floor(F.col("times") + F.lit(_EPS)).cast("long"))
        .withColumn("pi", F.greatest(F.col("times") - F.col("whole"), F.lit(0.0)))
        .withColumn("slot", F.pmod(F.xxhash64("content", "copy", F.lit(seed)), F.col("groups").cast("long")))
        .select("doc_id", "content", "source", "size", "source_size", "target", "whole", "pi", "slot")
    )
    level, done = 0, []
    while True:
        last = most_groups <= 1

        decided = settle(rows.groupBy("source", "slot").applyInPandas(_decider(seed, level, last), rows.schema), f"flight{level}")
        if last:
            done.append(decided)
            break
        is_open = (F.col("pi") > 0) & (F.col("pi") < 1)
        done.append(decided.where(~is_open))
        rows = decided.where(is_open).withColumn("slot", F.floor(F.col("slot") / F.lit(FAN_IN)).cast("long"))
        most_groups = -(-most_groups // FAN_IN)
        level += 1
    every = reduce(DataFrame.unionByName, done)
    copies = (F.col("whole") + F.round("pi").cast("long")).alias("copies")
    return every.select("doc_id", "content", "source", "size", "source_size", "target", copies).withColumn("taken", F.col("copies") * F.col("size"))


#: Copies of one row that a task writes at once.
COPIES_AT_ONCE = 4096


def mixed_documents(docs: DataFrame, *, seed: int = 0) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, columns unchanged.

    Rows that are equal in all columns are interchangeable, so what counts is how
    often the mix takes them together; reruns agree.  Null texts and sources are
    as in ``mix``; a document without words is taken as often as its source's
    factor says.  An empty table gives an empty one.

    A row stands alone for most keys.  Where many rows are equal, one of them is
    kept before the shuffle by the partial aggregation, and its copies are
    written by many tasks, COPIES_AT_ONCE each.
    """
    same = list(docs.columns)
    totals = mix(docs, seed=seed, same=same).groupBy("content").agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
    totals = settle(totals.where(F.col("copies") > 0), "copies")
    hot = hot_keys(totals, "content").select("content")
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), content_key(docs, same).alias("content"))
    any_hot = not hot.isEmpty()
    hot = F.broadcast(hot)  # bounded by the number of hot keys
    others = keyed.join(hot, "content", "left_anti") if any_hot else keyed
    turn = F.row_number().over(W.partitionBy("content").orderBy(F.lit(1)))  # of equal rows, at most as many as a key has that isn't hot
    few = others.join(totals, "content").withColumn("turn", turn).where("turn = 1")
    taken = few.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    if any_hot:
        many = keyed.join(hot, "content", "left_semi").groupBy("content").agg(F.first("row").alias("row")).join(totals, "content")
        many = many.select("content", "row", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES_AT_ONCE))).alias("turn"))
        left = F.least(F.lit(COPIES_AT_ONCE), F.col("copies") - COPIES_AT_ONCE * F.col("turn")).cast("int")
        taken = taken.unionByName(many.repartition("content", "turn").select("row", F.explode(F.array_repeat(F.lit(1), left))))
    return taken.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
