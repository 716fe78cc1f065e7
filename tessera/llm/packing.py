"""Best-fit packing of token sequences after dominance reduction.

Lengths are whole numbers up to the capacity, so all that packing has to know is
how many pieces there are of each length: at most ``capacity`` numbers, however
large the corpus.  The plan is made from that histogram.  First the reduction of
Martello and Toth fixes bins that provably dominate every other choice for their
largest piece (it fits alone; one other piece fills the rest exactly; only one
more fits, so the largest such does best; or the largest single filler is at
least as long as any pair that fits).  It repeats on the shrunken instance.
Best-fit decreasing packs the remainder.

The plan is a list of patterns with multiplicities.  Pieces find their place by
their rank among those of their length, which is computed in slots that hold an
equal share of all rows, so a length that a third of the pieces have is ranked
by many tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.shared import numbered_copies, settle
from tessera.llm.tokens import encoder, merges_by_rank

#: Ranking slots over all rows; each length has one at least.
SLOTS = 4096
#: Entries of a worker's cache of pieces; it outlives the stage, beside whatever runs next.
CACHE_ENTRIES = 600_000

Pattern = list[tuple[int, int]]  # (length, times) from the start of the bin


class _Histogram:
    """Counts by length, with the lengths that still occur in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.order = sorted(self.n)

    def take(self, length: int, k: int) -> None:
        self.n[length] -= k
        if not self.n[length]:
            del self.n[length]
            del self.order[bisect_left(self.order, length)]

    def largest(self, room: int, without: int | None = None) -> int | None:
        """Largest length that fits; one piece of ``without`` is out of use."""
        i = bisect_right(self.order, room) - 1
        if i >= 0 and self.order[i] == without and self.n[without] < 2:
            i -= 1
        return self.order[i] if i >= 0 else None

    def fits(self, room: int, without: int, most: int) -> int:
        """How many of the smallest pieces fit together, ``most`` at most."""
        k = 0
        for x in self.order:
            for _ in range(min(most, self.n[x] - (x == without))):
                room -= x
                if room < 0 or k == most:
                    return k
                k += 1
            if k == most:
                return k
        return k

    def best_pair(self, room: int, without: int) -> int:
        """Largest sum of two pieces that fit together, else 0."""
        lo, hi, best = 0, bisect_right(self.order, room) - 1, 0
        while lo <= hi:
            a, b = self.order[lo], self.order[hi]
            if a + b > room:
                hi -= 1
                continue
            need = 2 if a == b else 1
            if self.n[a] - (a == without) >= need and self.n[b] - (b == without) >= 1:
                best = max(best, a + b)
            lo += 1
        return best


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Bins that dominance fixes for good, and what is left to pack."""
    h, fixed, changed = _Histogram(counts), [], True
    while changed:
        changed = False
        for s in sorted(h.n, reverse=True):
            while s in h.n:
                room = capacity - s
                k = h.fits(room, s, 3)
                t = h.largest(room, s) if k else None
                if k == 0:
                    fixed.append(([(s, 1)], h.n[s]))
                    h.take(s, h.n[s])
                elif t == room or k == 1 or (k == 2 and t >= h.best_pair(room, s)):
                    m = h.n[s] // 2 if t == s else min(h.n[s], h.n[t])
                    fixed.append(([(s, 2)] if t == s else [(s, 1), (t, 1)], m))
                    h.take(s, 2 * m if t == s else m)
                    if t != s:
                        h.take(t, m)
                else:
                    break
                changed = True
    return fixed, h.n


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on a histogram: equal bins are filled together."""
    open_: dict[int, list[list]] = {}  # room -> [pattern, bins]
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, bins: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append([pattern, bins])

    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            i = bisect_left(rooms, s)
            if i == len(rooms):
                room, pattern, bins = capacity, [], left
            else:
                room = rooms[i]
                pattern, bins = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            most = room // s
            full = min(bins, left // most)
            if full:
                put(room - most * s, [*pattern, (s, most)], full)
                left -= full * most
                bins -= full
            if left and left < most and (bins or not pattern):
                put(room - left * s, [*pattern, (s, left)], 1)
                bins, left = bins - 1, 0
            if pattern and bins > 0:
                put(room, pattern, bins)
    return [(p, n) for groups in open_.values() for p, n in groups]


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    fixed, rest = reduce_instance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def token_pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and the end id, cut at the capacity."""
    step, by_rank = 4 * capacity, merges_by_rank(tokenizer_path)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches):
        enc, end = encoder(tokenizer_path, entries=CACHE_ENTRIES, by_rank=by_rank), end_id.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = enc.ids(text or "") + end
                rows += [(doc_id, at // step, at // 4, (min(at + step, len(ids)) - at) // 4, zlib.crc32(ids[at : at + step])) for at in range(0, len(ids), step)]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(pieces: DataFrame, *, capacity: int = 2048) -> DataFrame:
    """``pieces`` (with a length column) plus sequence_id and offset.

    Lengths are 1 to ``capacity``.  Equal rows are placed apart, like any others.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # ``capacity`` rows at most
    total = sum(counts.values())
    slots = {length: -(-n * SLOTS // total) for length, n in counts.items()}
    keys = [c for c in pieces.columns if c != "length"]
    sized = spark.createDataFrame(list(slots.items()) or [(0, 1)], "length long, slots long")
    dealt = numbered_copies(pieces, "_copy")  # equal rows are dealt over slots like any others
    slotted = dealt.join(F.broadcast(sized), "length").withColumn("slot", F.pmod(F.xxhash64(*keys, "_copy"), F.col("slots"))).drop("slots")
    slotted = settle(slotted, "slotted")
    filled = sorted(tuple(r) for r in slotted.groupBy("length", "slot").count().collect())  # SLOTS + ``capacity`` rows at most

    base, rank0, at = {}, {}, 0  # places of a length follow those of the lengths below it
    for length, slot, n in filled:
        base.setdefault(length, at)
        rank0[length, slot] = at
        at += n
    used, ranges, bins = dict(base), [], 0
    for pattern, n in plan_bins(counts, capacity):
        offset = 0
        for length, times in pattern:
            ranges.append((used[length], bins, times, offset, length))
            used[length] += n * times
            offset += length * times
        bins += n
    plan = spark.sparkContext.broadcast(np.array(sorted(ranges), dtype=np.int64).reshape(-1, 5))

    starts = spark.createDataFrame([(a, b, n) for (a, b), n in rank0.items()] or [(0, 0, 0)], "length long, slot long, rank0 long")
    ranked = slotted.withColumn("rank", F.row_number().over(W.partitionBy("length", "slot").orderBy(*keys, "_copy")) - 1)
    ranked = ranked.join(F.broadcast(starts), ["length", "slot"]).withColumn("rank", (F.col("rank") + F.col("rank0")).cast("long"))
    ranked = ranked.select(*pieces.columns, "rank")

    def assign(frames):
        p = plan.value
        for pdf in frames:
            rank = pdf.pop("rank").to_numpy()
            row = p[np.searchsorted(p[:, 0], rank, side="right") - 1]
            inside = rank - row[:, 0]
            yield pdf.assign(sequence_id=row[:, 1] + inside // row[:, 2], offset=row[:, 3] + inside % row[:, 2] * row[:, 4])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInPandas(assign, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as the empty one, which is the end id alone.  Only
    documents longer than the capacity are cut.  Repeated rows are packed as
    documents of their own, a null doc_id is kept, an empty table gives an empty
    one; other columns of ``docs`` are ignored.
    """
    return place(settle(token_pieces(docs, tokenizer_path, capacity=capacity, end_id=end_id), "pieces"), capacity=capacity)
