"""Weighted full text: an inverted index with positions as Parquet, and its best rows without reading all postings.

A row's score for a word is the sum of its fields' weights over the word's occurrences.
Postings of a word lie in order of score, in blocks of BLOCK.  A search takes the first
blocks of its words, scores the rows in them exactly by lookup, and stops once no row in
the blocks that follow can score as much as the last of the best; else it takes
twice as many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.sources.tables import dealt

#: Postings of a block, and folders that words are dealt to.
BLOCK, BUCKETS = 1_024, 32


def field_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _posted(rows: pa.Table, weights: Mapping[str, float]) -> pa.RecordBatch:
    """Postings of rows (id, words of each field), an id's rows as one."""
    fields = sorted(weights)
    ids = rows.column("id").combine_chunks().dictionary_encode(null_encoding="encode")
    lists = [rows.column(c).combine_chunks() for c in fields]
    codes = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
    counts = [pc.list_value_length(x).to_numpy() for x in lists]
    row = np.concatenate([np.repeat(ids.indices.to_numpy(), n) for n in counts]).astype(np.int64)
    field = np.repeat(np.arange(len(fields)), [n.sum() for n in counts])
    place = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for n in counts]).astype(np.int32)
    word = codes.indices.to_numpy()
    order = np.lexsort((place, field, word, row))
    row, field, place, word = row[order], field[order], place[order], word[order]
    new_post = np.ones(len(row), bool)
    new_post[1:] = (row[1:] != row[:-1]) | (word[1:] != word[:-1])
    new_list = new_post.copy()
    new_list[1:] |= field[1:] != field[:-1]
    posts, starts = np.flatnonzero(new_post), np.flatnonzero(new_list)
    worth = np.array([float(weights[c]) for c in fields])
    score = np.bincount(np.cumsum(new_list[starts] & new_post[starts]) - 1, worth[field[starts]] * np.diff(np.append(starts, len(row))), len(posts))
    at = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)), pa.int32()), pa.array(place))
    firsts = np.append(np.searchsorted(starts, posts), len(starts))
    places = pa.MapArray.from_arrays(pa.array(firsts, pa.int32()), pa.array(fields).take(pa.array(field[starts])), at)
    kinds = [pa.string(), rows.schema.field("id").type, pa.float64(), pa.map_(pa.string(), pa.list_(pa.int32()))]
    arrays = [codes.dictionary.take(pa.array(word[posts])), ids.dictionary.take(pa.array(row[posts])), pc.round(pa.array(score), 6), places]
    return pa.RecordBatch.from_arrays([x.cast(kind) for x, kind in zip(arrays, kinds, strict=True)], names=["word", "id", "score", "places"])


def _all_posted(batches: Iterator[pa.RecordBatch], weights: Mapping[str, float]) -> Iterator[pa.RecordBatch]:
    """Postings of rows sorted by id; rows of a batch's last id wait for the next batch."""
    held = None
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            rows = pa.Table.from_batches([batch.slice(start, 512)])
            rows = rows if held is None else pa.concat_tables([held, rows])
            ids = rows.column("id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            end = int(np.flatnonzero(ids == ids[-1])[0])
            held = rows.slice(end)
            if end:
                yield _posted(rows.slice(0, end), weights)
    if held is not None:
        yield _posted(held, weights)


def postings(df: DataFrame, unique: str, weights: Mapping[str, float]) -> DataFrame:
    """(word, id, score, places): words of the fields with a row's score and where they stand; places are (field, position).

    A row's words are put together where the row lies: rows are dealt by id, and no
    occurrence is shuffled.
    """
    rows = df.select(F.col(unique).alias("id"), *weights)
    kind = rows.schema["id"].dataType.simpleString()
    split = dealt(rows, "id").sortWithinPartitions("id").select("id", *[field_words(F.col(c)).alias(c) for c in weights])
    return split.mapInArrow(partial(_all_posted, weights=dict(weights)), f"word string, id {kind}, score double, places map<string, array<int>>")


def build(df: DataFrame, path: str, unique: str, weights: Mapping[str, float], *, block: int = BLOCK) -> None:
    """Write the index below ``path``: postings by bucket, word and block, and the first score of every block.

    A word that very many rows hold is ranked by ranges: rows are counted by score first (a
    score is one of few sums), so no task sorts all postings of a word.
    """
    found = postings(df, unique, weights).withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int"))
    found.write.partitionBy("bucket").parquet(f"{path}/raw")
    spark = df.sparkSession
    raw = spark.read.schema(found.schema).parquet(f"{path}/raw")
    counts = raw.groupBy("word", "score").agg(F.count("*").alias("n"))
    above = F.coalesce(F.sum("n").over(W.partitionBy("word").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.select("word", "score", "n", above.alias("above"))
    # rows of one score are in no order among each other: they are dealt to the blocks that these scores fill
    placed = raw.join(ranks.hint("merge"), ["word", "score"]).withColumn("block", F.floor((F.col("above") + F.pmod(F.xxhash64("id"), F.col("n"))) / block).cast("int"))
    placed = placed.select("word", "id", "score", "places", "block", "bucket")
    placed.write.partitionBy("bucket").parquet(f"{path}/postings")
    heads = spark.read.schema(placed.schema).parquet(f"{path}/postings").groupBy("word", "block").agg(F.max("score").alias("head"), F.count("*").alias("n"))
    heads.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int")).write.partitionBy("bucket").parquet(f"{path}/heads")


def search(spark: SparkSession, path: str, query: str, k: int) -> tuple[DataFrame, int]:
    """((id, score) of the k best rows for the words of ``query``, equal scores by id; blocks read of each word)."""
    words = sorted(set(spark.range(1).select(field_words(F.lit(query))).first()[0]))
    posted, heads = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/heads")
    buckets = [r[0] for r in spark.createDataFrame([(w,) for w in words] or [("",)], "word string").select(F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int")).collect()]
    mine = posted.where(F.col("bucket").isin(buckets) & F.col("word").isin(words))
    starts: dict[str, list[float]] = {}
    for r in heads.where(F.col("bucket").isin(buckets) & F.col("word").isin(words)).orderBy("word", "block").select("word", "head").collect():
        starts.setdefault(r["word"], []).append(r["head"])
    taken, most = 1, max(map(len, starts.values()), default=0)
    while True:
        seen = mine.where(F.col("block") < taken).select("id").distinct()
        scored = mine.join(seen, "id", "left_semi").groupBy("id").agg(F.round(F.sum("score"), 6).alias("score"))
        best = scored.orderBy(F.desc("score"), "id").limit(k)
        if taken >= most:
            return best, taken
        reachable = sum(max(h[taken:], default=0.0) for h in starts.values())
        last = best.agg(F.min("score"), F.count("*")).first()
        if last[1] == k and last[0] > reachable + 1e-9:
            return best, taken
        taken *= 2
