"""How filters interact: what each removes in every order, and its Shapley value.

Filters are tests that a document fails or passes whatever ran before, so after any
order of some of them the documents left are those that fail none in that *set*.  The
sets form a lattice: a state for each subset, an edge from S to S + f for each filter f
that S lacks.  All that an order does is read off the edges that it walks.  Counting
paths forward (orders that reach a state) and backward (orders that lead on from a
state to the full set) gives the number of orders through each edge; the removals on
f's edges, weighted by it, sum to f's Shapley value times the number of orders.

Documents are reduced to a histogram of failure sets within each part before any
state is looked at, so that data moves once whatever the number of orders.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import settle, spread_join, whole_number

#: Orders grow as the factorial of the filters: 7 give 5,040 orders of 7 steps a part.
MOST_FILTERS = 7
WORD = r"[^\x20\x09-\x0D]+"
#: The shares that filters B and C compare with, in hundredths, and the fewest words of filter A.
FEWEST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions that a text decides alone (it must not be null)."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n < FEWEST_WORDS,
        "B": distinct * 100 < n * LEAST_DISTINCT,
        "C": F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * MOST_CAPITALS,
        "D": text.rlike(r"[#$%&*|]"),
    }


def failure_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failed (bits 0 to 4 for A to E), good, toxic (0 or 1): a row per row of ``docs``.

    A null text counts as empty, a null source as the part ''.  E holds for a
    row whose text some row with a smaller doc_id has; rows equal in both don't
    make each other fail, and a null doc_id neither fails nor makes others fail.
    A document is good (toxic) where any of its labels says quality (toxic) 1; a
    null doc_id has no labels.
    Texts are compared by SHA-256.  Other columns of both tables are ignored.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(text_failures(text).values())]
    rows = docs.select(
        whole_number(docs["doc_id"]).alias("doc_id"),
        F.coalesce(docs["source"], F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        sum(bits[1:], bits[0]).alias("failed"),
    )
    rows = settle(rows, "failures")
    firsts = settle(rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "first-ids")
    copies = spread_join(rows, firsts, "digest", "doc_id")
    copies = copies.withColumn("failed", F.col("failed") + F.when(F.col("doc_id") > F.col("first_id"), 16).otherwise(0))
    any_is_one = lambda c: F.max(F.when(labels[c] == 1, 1).otherwise(0)).cast("int")
    known = labels.groupBy(whole_number(labels["doc_id"]).alias("doc_id")).agg(any_is_one("quality").alias("good"), any_is_one("toxic").alias("toxic"))
    return copies.join(known, "doc_id", "left").select("part", "failed", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@dataclass(frozen=True)
class Lattice:
    """Edges (state, filter) of the subset lattice, in a fixed order.

    through: orders through each edge.  removed, kept, redundant, alone: 0 or 1 for
    each failure set (row) and edge (column).  same_filter: 1 where two edges
    have one filter.  orders: names and edges of every order.
    """

    through: np.ndarray
    removed: np.ndarray
    kept: np.ndarray
    redundant: np.ndarray
    alone: np.ndarray
    same_filter: np.ndarray
    orders: list[str]
    steps: np.ndarray


@cache
def lattice(names: str) -> Lattice:
    """The lattice of the filters that ``names`` has a letter for, each."""
    k = len(names)
    if not 0 < k <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters, not {k}")
    full = (1 << k) - 1
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    for s in range(1, full + 1):  # every subset comes after its own subsets
        reach[s] = sum(reach[s ^ (1 << f)] for f in range(k) if s >> f & 1)
    for s in range(full - 1, -1, -1):
        leave[s] = sum(leave[s | 1 << f] for f in range(k) if not s >> f & 1)
    edges = [(s, f) for s in range(full + 1) for f in range(k) if not s >> f & 1]
    number = {e: i for i, e in enumerate(edges)}
    state, step = np.array([s for s, _ in edges]), np.array([f for _, f in edges])
    sets = np.arange(full + 1)[:, None]
    fails, before = (sets >> step) & 1, (sets & state) != 0
    orders, walks = [], []
    for order in permutations(range(k)):
        s, walk = 0, []
        for f in order:
            walk.append(number[s, f])
            s |= 1 << f
        orders.append("".join(names[f] for f in order))
        walks.append(walk)
    return Lattice(
        through=np.array([reach[s] * leave[s | 1 << f] for s, f in edges], np.int64),
        removed=(fails * ~before).astype(np.int64),
        kept=((fails == 0) & ~before).astype(np.int64),
        redundant=(fails * before).astype(np.int64),
        alone=(sets == (1 << step)).astype(np.int64),
        same_filter=(step[:, None] == step[None, :]).astype(np.int64),
        orders=orders,
        steps=np.array(walks),
    )


RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
_ARROW = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32())] + [(c, pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")])


def audit(rows: DataFrame, names: str = "ABCDE") -> DataFrame:
    """A row per part, order of the filters and step, from rows (part, failed, good, toxic).

    Bit i of ``failed`` says that the row fails the i-th filter of ``names``.  Counts
    are of rows of the part: kept after the step, removed by it, redundant (failing
    its filter, gone before), unique_fails (failing its filter alone), good_lost and
    toxic_lost (removed by it), shapley (removed by its filter, over all orders).
    Every part that has a row has all orders, zeros included; no rows give none.
    """
    sets = range(1 << len(names))
    counts = rows.groupBy("part", "failed").agg(F.count("*").alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"))
    pick = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("failed") == s, F.col(c))), F.lit(0).cast("long")) for s in sets]).alias(c)
    by_part = counts.groupBy("part").agg(pick("n"), pick("good"), pick("toxic"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(names)
        k, walk = len(names), lat.steps.ravel()
        order = pa.array(np.repeat(np.array(lat.orders, object), k), pa.string())
        step = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(lat.orders)))
        for batch in batches:
            n, good, toxic = (np.asarray(batch.column(c).values).reshape(batch.num_rows, -1) for c in (1, 2, 3))
            removed = n @ lat.removed
            shapley = (removed * lat.through) @ lat.same_filter
            edges = [n @ lat.kept, removed, n @ lat.redundant, n @ lat.alone, good @ lat.removed, toxic @ lat.removed, shapley]
            for i, part in enumerate(batch.column(0).to_pylist()):
                yield pa.record_batch([pa.array([part] * len(walk), pa.string()), order, step, *[pa.array(e[i][walk]) for e in edges]], schema=_ARROW)

    return by_part.mapInArrow(read, RESULT)


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What the five text filters remove from ``docs`` in all 120 orders, for each source.

    See ``failure_rows`` for nulls, ties and repeated rows and ``audit`` for the
    columns.  Empty tables give an empty result; without labels nothing good or
    toxic is lost.
    """
    return audit(failure_rows(docs, labels))
