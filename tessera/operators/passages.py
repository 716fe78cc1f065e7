"""Of all sentences of documents, the one that shares most words with each of some items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of items' words up to which they are sent to every task, and cells of the counts that a task holds at once.
MOST_BYTES, CELLS = 16 << 20, 4 << 20
_BEST = pa.schema([("item", pa.int64()), ("shared", pa.int64()), ("doc_id", pa.int64()), ("sentence", pa.string())])


def _counted(sentences: DataFrame, items: list[tuple[int, list[str]]]) -> DataFrame:
    """Each task's best sentence of each item: words become postings of items, counted for some sentences and all items at once."""
    sent = sentences.sparkSession.sparkContext.broadcast(items)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        if not held:
            return
        words = sorted({w for _, own in held for w in own})
        place = {w: i for i, w in enumerate(words)}
        pairs = np.array(sorted((place[w], k) for k, (_, own) in enumerate(held) for w in own), np.int64).reshape(-1, 2)
        starts, posted = np.searchsorted(pairs[:, 0], np.arange(len(words) + 1)), pairs[:, 1]
        known, rows, best = pa.array(words, pa.string()), max(1, CELLS // len(held)), {}
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                docs, told, lists = batch.slice(start, rows).columns
                at = pc.index_in(lists.flatten(), value_set=known)
                row = pc.list_parent_indices(lists).to_numpy()[at.is_valid().to_numpy(zero_copy_only=False)]
                at = at.drop_null().to_numpy().astype(np.int64)
                n = starts[at + 1] - starts[at]
                ends = np.cumsum(n)
                which = posted[np.arange(n.sum()) + np.repeat(starts[at] - ends + n, n)]
                counts = np.bincount(np.repeat(row, n) * len(held) + which, minlength=len(docs) * len(held)).reshape(len(docs), len(held))
                most, ids = counts.max(0), docs.to_numpy()
                for k in np.flatnonzero(most).tolist():
                    if k in best and best[k][0] > most[k]:
                        continue
                    few = np.flatnonzero(counts[:, k] == most[k])
                    few = few[ids[few] == ids[few].min()]
                    found = (int(most[k]), -int(ids[few[0]]), max(told[i].as_py() for i in few.tolist()))
                    best[k] = max(best.get(k, found), found)
        out = [(held[k][0], shared, -doc, sentence) for k, (shared, doc, sentence) in best.items()]
        yield pa.record_batch([pa.array([x[i] for x in out], t.type) for i, t in enumerate(_BEST)], schema=_BEST)

    found = sentences.select(F.col("doc_id").cast("long").alias("doc_id"), "sentence", "words").mapInArrow(read, "item long, shared long, doc_id long, sentence string")
    return found.withColumnRenamed("item", "item_id")


def _joined(sentences: DataFrame, items: DataFrame) -> DataFrame:
    words = sentences.select("doc_id", "sentence", F.explode("words").alias("w"))
    return words.join(items.select("item_id", F.explode("words").alias("w")), "w").groupBy("item_id", "doc_id", "sentence").agg(F.count("*").alias("shared"))


def best_shared(sentences: DataFrame, items: DataFrame, *, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(item_id, shared, doc_id, sentence): the sentence with most words of each item; of equal ones the least document's, then the last.

    sentences: doc_id, sentence, words; items: item_id (one row each), words; words
    are distinct in a row.  Items without a shared word have no row.  Up to
    ``most_bytes`` of items' words every sentence is counted where it is read, and tasks
    return one row an item; beyond that sentences and items are joined on their words.
    """
    size = items.agg(F.sum(F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.octet_length(w) + 16))).first()[0] or 0
    found = _counted(sentences, [(r[0], r[1]) for r in items.select("item_id", "words").collect()]) if size <= most_bytes else _joined(sentences, items)
    best = F.max_by(F.struct("doc_id", "sentence"), F.struct("shared", -F.col("doc_id"), "sentence")).alias("b")
    return found.groupBy("item_id").agg(F.max("shared").alias("shared"), best).select("item_id", "shared", "b.doc_id", "b.sentence")
