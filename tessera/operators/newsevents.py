"""One item for each event that news items report: greedy, in order, the better standing item in the place of the first.

An item joins the first kept item that reports its event, and takes its place if it
stands better, so the result depends on the order.  Two items can only meet if they
report one event, which is a relation of the items alone: connected components of
(a superset of) it are independent, and tasks stream through them.  Items are linked

- by sums and purchases that both name, through stretches of days over distinct days;
- by company and day where both have enough words to be compared.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.reports import event_keys, headline_words
from tessera.operators.resolve import connected, shared_checkpoints
from tessera.sources.tables import dealt

# Days between two reports of one event, words of a headline that can be compared, share that must agree.
DAYS, LEAST_WORDS, SHARE = 7, 4, 0.6


def standing(item: dict) -> int:
    """Less is better: one that states the event as its headline, then a dated one, then an outlet over the company's own site."""
    return (-1 if item["preferred"] else 0) + (0 if item["day"] is not None else 2) + (1 if item["own_site"] else 0)


def better(item: dict, kept: dict) -> bool:
    """Whether ``item`` takes the place of ``kept``; of equally preferred dated ones the earlier does."""
    a, b = standing(item), standing(kept)
    earlier = item["preferred"] and item["day"] is not None and kept["day"] is not None and item["day"] < kept["day"]
    return a < b or (a == b and bool(earlier))


class _Kept:
    """Kept items in order, found by what they report."""

    def __init__(self):
        self.items: list[dict] = []
        self.places: list[dict] = []
        self.by_key, self.by_word = defaultdict(set), defaultdict(set)

    def _books(self, r: dict) -> list[set]:
        own = [self.by_key[r["company"], k] for k in r["keys"]]
        return own + [self.by_word[r["company"], r["day"], w] for w in r["words"]] if r["day"] is not None else own

    def first(self, r: dict) -> int | None:
        found = {i for k in r["keys"] for i in self.by_key[r["company"], k] if r["day"] is None or self.items[i]["day"] is None or abs((r["day"] - self.items[i]["day"]).days) <= DAYS}
        if r["day"] is not None and len(r["words"]) >= LEAST_WORDS:
            shared = Counter(i for w in r["words"] for i in self.by_word[r["company"], r["day"], w])
            sizes = {i: len(self.items[i]["words"]) for i in shared}
            found |= {i for i, n in shared.items() if sizes[i] >= LEAST_WORDS and n / min(len(r["words"]), sizes[i]) >= SHARE}
        return min(found, default=None)

    def add(self, r: dict) -> None:
        for book in self._books(r):
            book.add(len(self.items))
        self.items.append(r)
        self.places.append({"place": r["seq"], "reports": 1})

    def join(self, i: int, r: dict) -> None:
        self.places[i]["reports"] += 1
        if better(r, self.items[i]):
            for book in self._books(self.items[i]):
                book.discard(i)
            for book in self._books(r):
                book.add(i)
            self.items[i] = r


OUT = "company string, place long, seq long, title string, url string, published date, reports long"
_OUT = pa.schema([("company", pa.string()), ("place", pa.int64()), ("seq", pa.int64()), ("title", pa.string()), ("url", pa.string()), ("published", pa.date32()), ("reports", pa.int64())])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(kept: _Kept) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(kept.items), 2048):
            few = zip(kept.items[start : start + 2048], kept.places[start : start + 2048], strict=True)
            yield pa.RecordBatch.from_pylist([{"company": r["company"], "title": r["title"], "url": r["url"], "published": r["day"], "seq": r["seq"], **p} for r, p in few], schema=_OUT)

    now, kept = None, _Kept()
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            for r in batch.slice(start, 1024).to_pylist():
                if r["component"] != now:
                    yield from rows(kept)
                    now, kept = r["component"], _Kept()
                i = kept.first(r)
                if i is None:
                    kept.add(r)
                else:
                    kept.join(i, r)
    yield from rows(kept)


def _by_events(items: DataFrame) -> DataFrame:
    """(row, node) of every event that an item names: a stretch of days, or all where one is undated."""
    each = items.select("row", "firm", "at", F.explode("keys").alias("key"))
    whole = each.groupBy("firm", "key").agg(F.max(F.col("at").isNull()).alias("whole"))
    few = each.where("at IS NOT NULL").select("firm", "key", "at").distinct()
    ordered = W.partitionBy("firm", "key").orderBy("at")  # over distinct days
    starts = F.when(F.col("at") - F.lag("at").over(ordered) > DAYS, 1).otherwise(0)
    few = few.withColumn("starts", starts).withColumn("part", F.sum("starts").over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("starts")
    placed = each.join(whole.hint("merge"), ["firm", "key"]).join(few.hint("merge"), ["firm", "key", "at"], "left")
    return placed.select("row", F.xxhash64("firm", "key", F.when(F.col("whole"), F.lit(-1)).otherwise(F.col("part"))).alias("node"))


def _components(items: DataFrame) -> DataFrame:
    """Items with ``component``, so that no two items of different components report one event.

    Headlines that can be compared are linked by their company and day, not pair by
    pair, so this grows with the items; a pass over a component looks headlines up by their
    words.  The joins merge: packed files hold more items than their size says, and
    aren't sent through the driver.
    """
    told = items.where(F.col("at").isNotNull() & (F.size("words") >= LEAST_WORDS)).select("row", F.xxhash64("firm", "at", F.lit("day")).alias("node"))
    nodes = _by_events(items).unionByName(told).checkpoint()
    heads = nodes.groupBy("row").agg(F.min("node").alias("head"))
    edges = nodes.join(heads.hint("merge"), "row").select(F.col("head").alias("left"), F.col("node").alias("right")).where("left <> right").distinct()
    joined = connected(edges, "left", "right").select(F.col("id").alias("head"), "group_id")
    placed = heads.join(joined.hint("merge"), "head", "left")
    return items.join(placed.hint("merge"), "row", "left").withColumn("component", F.coalesce("group_id", "head", F.xxhash64("row", F.lit("alone"))))


def dedupe_news(items: DataFrame, *, own_site: Column | None = None, preferred: Column | None = None) -> DataFrame:
    """One row per event: company, place (``seq`` of its first report), the kept item, and the number of reports.

    items: company, seq (the order), title, url, published (a date or null) and lead
    (the opening of the article, or null), whose sums and purchases count as the
    title's do.  ``own_site`` and ``preferred`` say which items are on the company's own
    site and which state the event as their headline.  Items of equal seq come in
    order of url and title.  Null titles report nothing; items without a company
    are one company's; an empty table gives an empty one.
    """
    shared_checkpoints(items.sparkSession.sparkContext)
    text = F.concat_ws(" ", F.col("title"), F.col("lead"))
    no = F.lit(False)
    read = items.select(
        F.col("company").cast("string").alias("company"), F.col("seq").cast("long").alias("seq"), "title", "url", F.col("published").cast("date").alias("day"), F.coalesce(no if own_site is None else own_site, no).alias("own_site"), F.coalesce(no if preferred is None else preferred, no).alias("preferred"),
        event_keys(text).alias("keys"), F.coalesce(headline_words(F.col("title"), F.col("url")), F.array().cast("array<string>")).alias("words"),
    )
    read = dealt(read)  # rows are read once, though checkpoints run their last stage twice
    read = read.withColumn("firm", F.xxhash64("company")).withColumn("at", F.datediff("day", F.lit("1970-01-01").cast("date"))).withColumn("row", F.monotonically_increasing_id()).checkpoint()
    order = ["seq", F.col("url").asc_nulls_first(), F.col("title").asc_nulls_first()]
    placed = _components(read).repartition("component").sortWithinPartitions("component", *order)
    return placed.select("component", "company", "seq", "title", "url", "day", "own_site", "preferred", "keys", "words").mapInArrow(_fold, OUT)
