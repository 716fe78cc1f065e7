"""Nearest neighbours through a partitioned index: cells around fitted centres, exact similarities within the cells that a query probes.

The centres are fitted by spherical k-means on a bounded sample; every row is
indexed, in the cell of its nearest centre, in slices of bounded size, so a cell that
very many rows fall into (or a vector that very many rows have) is many tasks.  A
query goes to the slices of its nearest cells; each slice gives its best few by exact
cosine, and these are ranked once more.  What is approximate is only which
cells are probed; ``recall`` measures it against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import vectors
from tessera.operators.relational import every_pair

#: Rows that the centres are fitted on, and centres, at most.
SAMPLE_ROWS, MOST_CELLS = 20_000, 4_096
#: Rows of a slice, and queries that meet a slice at once.
SLICE_ROWS, QUERY_ROWS = 4_096, 1_024
#: Queries that the number of probes is calibrated with, at most, and the recall that it aims at.
CALIBRATION_ROWS, AIM = 64, 0.95
#: The centres are sent to all tasks up to this many bytes.
MOST_BYTES = 256 << 20


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1.0)


def centres(sample: np.ndarray, cells: int, *, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Unit vectors around which the rows of ``sample`` lie, by spherical k-means; a cell that empties takes the row that fits worst."""
    rng, rows = np.random.default_rng(seed), _unit(sample.astype(np.float64))
    found = rows[rng.choice(len(rows), min(cells, len(rows)), replace=False)]
    for _ in range(rounds):
        likeness = rows @ found.T
        nearest = likeness.argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, rows)
        empty = np.flatnonzero(np.bincount(nearest, minlength=len(found)) == 0)
        if len(empty):
            sums[empty] = rows[np.argsort(likeness.max(axis=1), kind="stable")[: len(empty)]]
        found = _unit(sums)
    return found


@dataclass
class VectorIndex:
    """rows: cell, slice, id, vector (of length 1); sizes: cell, slices; centres, one for each cell."""

    rows: DataFrame
    sizes: DataFrame
    centres: np.ndarray

    def save(self, path: str) -> None:
        """Write the index below ``path``, rows laid out by cell so that a search reads the cells it probes."""
        spark = self.rows.sparkSession
        self.rows.repartition("cell", "slice").sortWithinPartitions("cell", "slice").write.partitionBy("cell").parquet(f"{path}/rows")
        self.sizes.write.parquet(f"{path}/sizes")
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(self.centres)]
        spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")

    @staticmethod
    def load(spark, path: str) -> VectorIndex:
        found = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # MOST_CELLS at most
        return VectorIndex(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/sizes"), np.array([r["centre"] for r in found]))


def _in_cells(df: DataFrame, found: np.ndarray, probes: int) -> DataFrame:
    """(id, vector of length 1, cell) for the ``probes`` nearest cells of each row."""
    sent = df.sparkSession.sparkContext.broadcast(found)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), QUERY_ROWS):
                part = batch.iloc[start : start + QUERY_ROWS]
                rows = _unit(np.stack(part["vector"].to_numpy()).astype(np.float64))
                order = np.argsort(-(rows @ sent.value.T), axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({"id": np.repeat(part["id"].to_numpy(), order.shape[1]), "vector": [x for x in rows for _ in range(order.shape[1])], "cell": order.ravel().astype(np.int32)})

    return df.mapInPandas(place, "id long, vector array<double>, cell int")


def _comparable(df: DataFrame, unique: str, vector: str, length: int | None) -> DataFrame:
    rows = df.select(F.col(unique).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.where((F.size("vector") == F.lit(length)) & (vectors.norm(F.col("vector")) > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x))) if length else rows


def build(df: DataFrame, *, unique: str = "id", vector: str = "embedding", cells: int | None = None) -> VectorIndex:
    """An index of every row of ``df`` whose vector has a length (others are like nothing).

    Cells are about the square root of the rows, MOST_CELLS at most; beyond that, slices grow
    in number.  All vectors must have as many numbers as the most common length; ids
    are whole numbers.
    """
    counted = df.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
    length = counted["n"] if counted else None
    rows = _comparable(df, unique, vector, length or 1)
    if not counted:
        return VectorIndex(rows.limit(0).select(F.lit(0).alias("cell"), F.lit(0).alias("slice"), "id", "vector"), rows.limit(0).select(F.lit(0).alias("cell"), F.lit(0).alias("slices")), np.zeros((0, 0)))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("vector").toPandas()
    wanted = max(1, min(MOST_CELLS, cells or isqrt(counted["count"])))
    if wanted * length * 8 > MOST_BYTES:
        wanted = max(1, MOST_BYTES // (length * 8))
    found = centres(np.stack(sample["vector"].to_numpy()), wanted)
    placed = _in_cells(rows, found, 1)
    counts = placed.groupBy("cell").agg(F.ceil(F.count("*") / SLICE_ROWS).cast("int").alias("slices"))
    sizes = df.sparkSession.createDataFrame(counts.collect(), "cell int, slices int")  # MOST_CELLS at most
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    return VectorIndex(dealt.select("cell", "slice", "id", "vector"), sizes, found)


def search(index: VectorIndex, queries: DataFrame, k: int, *, probes: int = 8, unique: str = "id", vector: str = "embedding") -> DataFrame:
    """(id, peer, similarity, place) of the k rows nearest to each query, itself left out; equal ones by id.

    Queries are dealt in blocks, so neither a popular cell nor many queries fill a task.
    """
    spark = queries.sparkSession
    if not len(index.centres):
        return spark.createDataFrame([], "id long, peer long, similarity double, place int")
    asked = _in_cells(_comparable(queries, unique, vector, index.centres.shape[1]), index.centres, min(probes, len(index.centres)))
    loads = asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))
    loads = F.broadcast(spark.createDataFrame(loads.collect(), "cell int, blocks int"))  # MOST_CELLS at most
    sizes = F.broadcast(index.sizes)
    q = asked.join(loads, "cell").join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    rows = index.rows.join(loads, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "peer": [], "similarity": []})
        right = right.sort_values("id")
        peers, ids = right["id"].to_numpy(), left["id"].to_numpy()
        likeness = np.round(np.stack(left["vector"].to_numpy()) @ np.stack(right["vector"].to_numpy()).T, 9)
        likeness[ids[:, None] == peers[None, :]] = -np.inf
        order = np.argsort(-likeness, axis=1, kind="stable")[:, :k]  # equal ones stay in the order of ids
        out = pd.DataFrame({"id": np.repeat(ids, order.shape[1]), "peer": peers[order.ravel()], "similarity": np.take_along_axis(likeness, order, 1).ravel()})
        return out[np.isfinite(out["similarity"])]

    keys = ["cell", "slice", "block"]
    met = q.select(*keys, "id", "vector").groupBy(*keys).cogroup(rows.select(*keys, "id", "vector").groupBy(*keys)).applyInPandas(best, "id long, peer long, similarity double")
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "peer"))  # k rows for each slice probed
    return met.withColumn("place", place).where(F.col("place") <= k)


def exact(df: DataFrame, queries: DataFrame, k: int, *, unique: str = "id", vector: str = "embedding") -> DataFrame:
    """As ``search`` has it, over all rows."""
    length = queries.select(F.size(vector).alias("n")).where("n > 0").first()
    a, b = (_comparable(x, unique, vector, length["n"] if length else 1) for x in (queries, df))
    pairs = every_pair(a, b.select(F.col("id").alias("peer"), F.col("vector").alias("_v")), "id", "peer").where("id <> peer")
    scored = pairs.select("id", "peer", F.round(vectors.cosine(F.col("vector"), F.col("_v")), 9).alias("similarity"))
    return scored.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "peer"))).where(F.col("place") <= k)


def calibrate(index: VectorIndex, df: DataFrame, k: int, *, aim: float = AIM, unique: str = "id", vector: str = "embedding") -> int:
    """How many cells to probe for a recall of ``aim``: measured on CALIBRATION_ROWS rows of ``df``, each against all rows.

    How near neighbours' cells are depends on the data: clustered vectors need few
    probes, vectors without any structure most cells.
    """
    if not len(index.centres):
        return 1
    few = _comparable(df, unique, vector, index.centres.shape[1]).orderBy(F.xxhash64("id", F.lit(1)), "id").limit(CALIBRATION_ROWS)
    true = exact(index.rows, few, k, vector="vector").join(index.rows.select(F.col("id").alias("peer"), "cell"), "peer")
    cells = true.groupBy("id").agg(F.collect_list("cell").alias("cells")).join(few, "id").toPandas()  # CALIBRATION_ROWS rows of k numbers
    if not len(cells):
        return 1
    order = np.argsort(-(_unit(np.stack(cells["vector"].to_numpy())) @ index.centres.T), axis=1, kind="stable")
    turns = np.sort([np.flatnonzero(order[i] == c)[0] + 1 for i, held in enumerate(cells["cells"]) for c in held])
    return int(turns[min(len(turns) - 1, int(np.ceil(aim * len(turns))))])


def recall(found: DataFrame, true: DataFrame) -> float:
    """Share of the true neighbours that were found."""
    hits = true.select("id", "peer").join(found.select("id", "peer"), ["id", "peer"]).count()
    return hits / max(1, true.count())
