"""Small helpers that several of the operators share."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and every executor can reach.

    It is ``spark.checkpoint.dir`` where the cluster names one.  Only where that
    is unset and everything runs on one machine (local tests) a folder below the
    system's temporary one is used.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "tessera-checkpoints")
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder; each call gives another one."""
    return f"{shared_root(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, and makes work with several readers happen once.  The
    files outlive executors, so a lost executor costs nothing but its own tasks.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_number(column):
    """The column as a long; a value that isn't one raises whatever the session's ANSI setting, null stays null."""
    number = column.try_cast("long")
    return F.when(column.isNull() | number.isNotNull(), number).otherwise(F.raise_error(F.concat(F.lit("not a whole number: "), column.cast("string"))).cast("long"))


#: A key is hot from this many rows, and from this share of all rows on; the latter bounds the number of hot keys.
HOT_ROWS, MOST_HOT = 200, 100_000


def hot_keys(facts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """(key, parts) of the keys of ``facts`` (key, n) with many rows, at most MOST_HOT of them.

    No part has more than the bound that makes a key hot, as far as its rows
    spread evenly.
    """
    bound = max(HOT_ROWS, (facts.agg(F.sum(n)).first()[0] or 0) // MOST_HOT)
    return facts.where(F.col(n) > bound).select(key, F.ceil(F.col(n) / F.lit(bound)).cast("int").alias("_parts"))


def spread_join(rows: DataFrame, facts: DataFrame, key: str, *spread: str) -> DataFrame:
    """Inner join of ``rows`` with ``facts``, which has one row for each key and ``n``, the key's number of rows.

    The rows of a hot key are dealt to many tasks by the ``spread`` columns and by
    the partition they are in (so equal rows spread too), and its fact goes to
    each of them; all other keys are joined as usual.  ``facts``
    is read several times, so it should be settled.
    """
    hot = F.broadcast(hot_keys(facts, key))  # MOST_HOT rows at most
    part = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread, F.spark_partition_id()), F.col("_parts")).cast("int"))
    dealt = rows.join(hot, key, "left").withColumn("_part", part).drop("_parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    known = facts.drop("n").join(hot, key, "left").withColumn("_part", copies).drop("_parts")
    return dealt.join(known, [key, "_part"]).drop("_part")


#: Copies of one row that one task writes out.
COPIES_IN_TASK = 4096


def numbered_copies(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` with ``name``: 0, 1, 2 and so on among rows that are equal in all columns.

    Equal rows are folded into a count before the shuffle and written out again,
    those of a row that very many equal by many tasks.
    """
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    few = counted.where(F.col("_n") <= COPIES_IN_TASK).select(*df.columns, upto(F.col("_n")).alias(name))
    many = counted.where(F.col("_n") > COPIES_IN_TASK).select("*", upto(F.ceil(F.col("_n") / COPIES_IN_TASK)).alias("_block")).repartition(*df.columns, "_block")
    rest = F.least(F.lit(COPIES_IN_TASK).cast("long"), F.col("_n") - F.col("_block") * COPIES_IN_TASK)
    return few.unionByName(many.select(*df.columns, "_block", upto(rest).alias("_at")).select(*df.columns, (F.col("_block") * COPIES_IN_TASK + F.col("_at")).alias(name)))


def digest_of(column):
    """16 bytes that stand for a text; a null text counts as the empty one."""
    return F.unhex(F.md5(F.coalesce(column, F.lit("")).cast("binary")))


def slices(batch, column: int, most_bytes: int = 2 << 20):
    """The batch in slices of at most ``most_bytes`` of text in a column, or of one row.

    Arrays that a task builds from a slice stay small, however many rows a batch has.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start, done = 0, 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(ends, done + most_bytes, side="right")))
        yield batch.slice(start, end - start)
        start, done = end, int(ends[end - 1])


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, with underscores before it until no column has that name."""
    lowered = {x.lower() for x in taken}
    while wanted.lower() in lowered:
        wanted = "_" + wanted
    return wanted


def open_for_write(uri: str):
    """A binary stream to a new file in a folder that all tasks share."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    return store.open_output_stream(path, compression=None)


def open_for_read(uri: str):
    """A seekable binary file, opened from a task."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)
