"""Plan of what found rounds change on file: inserts, patches and conflicts, by an order-dependent fold.

Found rounds are taken in order of arrival.  One that is a round on file, or one planned
before it, fills that round's empty fields, which may make later ones match; one that
contradicts its match is reported; the rest are inserts.  The order matters, so the
work can't be an aggregate.  It can be split, though: a round only ever meets
rounds that share a *block* with it, directly or through others.  Blocks are stretches
of dates of one stage and stretches of amounts, both found over distinct days and
amount bands (few, whatever the number of rounds).  Connected blocks are one component,
and tasks stream through the sorted components keeping only the open rounds.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from math import floor, inf, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.classify import round_label
from tessera.functions.reports import NAMED_STAGES
from tessera.operators.resolve import shared_checkpoints

# Days that two reports of one round may lie apart, and shares that amounts may differ by.
SOON, FAR, CONTRADICTION = 60, 270, 120
ALIKE, DIFFERENT = 0.10, 0.15
GENERIC = ("Other", "Unknown")
LETTERS = "Series F+"
#: Open rounds that are held against a found one each; more are put on shelves.
FEW = 8
#: Amounts that differ by ALIKE or less are in one band or in neighbouring ones.
BAND = log(1 / (1 - ALIKE)) * 1.000001

FIELDS = ("round_type", "amount", "valuation", "announced", "lead", "source_url", "investors")


def _firm(name) -> str:
    return " ".join(name.lower().replace(".", "").replace(",", "").split()) if isinstance(name, str) else ""


def _one_firm(a, b) -> bool:
    x, y = _firm(a), _firm(b)
    return bool(x and y) and (x in y or y in x)


def _close(a, b, share: float) -> bool:
    return a is not None and b is not None and a > 0 and b > 0 and abs(a - b) / max(a, b) <= share


def _gap(a, b) -> int | None:
    return None if a is None or b is None else abs((a - b).days)


def same(a: dict, b: dict) -> bool:
    """Whether two rounds are one raise."""
    gap, alike, kind = _gap(a["announced"], b["announced"]), _close(a["amount"], b["amount"], ALIKE), a["round_type"] == b["round_type"]
    soon, open_ended = gap is not None and gap <= SOON, gap is None or gap <= FAR
    if kind and a["round_type"] == LETTERS:
        return soon or (alike and open_ended)
    if kind and a["round_type"] in NAMED_STAGES:
        return open_ended or alike
    return soon and (kind or alike)


def contradiction(on_file: dict, found: dict) -> str | None:
    x, y = on_file["amount"], found["amount"]
    if x is not None and y is not None and not _close(x, y, DIFFERENT):
        return f"amount on file {x:.2f}, found {y:.2f}"
    if (_gap(on_file["announced"], found["announced"]) or 0) > CONTRADICTION:
        return f"date on file {on_file['announced']}, found {found['announced']}"
    return None


def fill(target: dict, found: dict) -> dict:
    """What ``found`` adds to ``target``: fields that are empty there, investors that aren't named yet, a stage for a generic type."""
    patch = {f: found[f] for f in ("amount", "valuation", "announced") if target[f] is None and found[f] is not None}
    patch |= {f: found[f] for f in ("lead", "source_url") if not target[f] and found[f]}
    lead, named = patch.get("lead") or target["lead"], list(target["investors"] or [])
    extra = [*(found["investors"] or []), found["lead"]]  # a lead other than the one on file took part as well
    extra = [x for x in extra if not _one_firm(x, lead) and not any(_one_firm(n, x) for n in named)]
    firsts = [x for i, x in enumerate(extra) if next((j for j, y in enumerate(extra) if _one_firm(y, x)), -1) == i]
    if firsts:
        patch["investors"] = named + firsts
    if target["round_type"] in GENERIC and found["round_type"] not in GENERIC:
        patch["round_type"] = found["round_type"]
    return patch


def _band(amount) -> int | None:
    return floor(log(amount) / BAND) if amount is not None and amount > 0 else None


class OpenRounds:
    """Rounds that later ones may match, in order, found by stage and day, or by amount band and day."""

    def __init__(self):
        self.rows: list[dict] = []
        self.dated: dict = defaultdict(list)  # sorted (day, number) under (company, stage), (company, band) and (company, stage, band)
        self.undated: dict = defaultdict(list)  # sorted numbers, and so are all of a shelf
        self.every: dict = defaultdict(list)
        self.shelved = False

    def _shelves(self, r: dict) -> list[tuple]:
        band = _band(r["amount"])
        return [(r["company"], r["round_type"])] + ([(r["company"], band), (r["company"], r["round_type"], band)] if band is not None else [])

    def _put(self, n: int, take: bool) -> None:
        r = self.rows[n]
        for shelf in self._shelves(r):
            for books, item in ((self.undated[shelf], n) if r["announced"] is None else (self.dated[shelf], (r["announced"].toordinal(), n)), (self.every[shelf], n)):
                if take:
                    del books[bisect_left(books, item)]
                else:
                    insort(books, item)

    def add(self, r: dict) -> None:
        self.rows.append(r)
        if self.shelved:
            self._put(len(self.rows) - 1, False)
        elif len(self.rows) > FEW:
            self.shelved = True
            for n in range(len(self.rows)):
                self._put(n, False)

    def change(self, n: int, patch: dict) -> None:
        if self.shelved:
            self._put(n, True)
        self.rows[n].update(patch)
        if self.shelved:
            self._put(n, False)

    def _nearest(self, shelf: tuple, r: dict, reach: float) -> tuple | None:
        """(days, number) of the nearest dated match on a shelf; of equally near ones the first in order."""
        books, day, best = self.dated[shelf], r["announced"].toordinal(), None
        high = bisect_left(books, (day,))
        low = high - 1
        while low >= 0 or high < len(books):
            down, up = day - books[low][0] if low >= 0 else inf, books[high][0] - day if high < len(books) else inf
            days, n = (down, books[low][1]) if down <= up else (up, books[high][1])
            low, high = (low - 1, high) if down <= up else (low, high + 1)
            if days > reach or best and days > best[0]:
                break
            if same(self.rows[n], r) and (best is None or (days, n) < best):
                best = (days, n)
        return best

    def match(self, r: dict) -> int | None:
        if not self.shelved:
            return min(((inf if (gap := _gap(x["announced"], r["announced"])) is None else gap, n) for n, x in enumerate(self.rows) if x["company"] == r["company"] and same(x, r)), default=(inf, None))[1]
        company, stage, band = r["company"], r["round_type"], _band(r["amount"])
        near = [] if band is None else [band - 1, band, band + 1]
        if r["announced"] is not None:
            found = [self._nearest((company, stage), r, FAR)]
            found += [self._nearest((company, b), r, SOON) for b in near]
            found += [self._nearest((company, stage, b), r, inf) for b in near]
            if any(found):
                return min(x for x in found if x)[1]
        shelves = [(company, stage)] if stage in NAMED_STAGES and stage != LETTERS else [(company, stage, b) for b in near]
        held = [(self.every if r["announced"] is None else self.undated)[s] for s in shelves]  # no day to be near to: the first in order
        firsts = [next((n for n in books if same(self.rows[n], r)), None) for books in held]
        return min((n for n in firsts if n is not None), default=None)


OUT = "company long, action string, id long, seq long, round_type string, amount double, valuation double, announced date, lead string, source_url string, investors array<string>, message string"
_OUT = pa.schema([
    ("company", pa.int64()), ("action", pa.string()), ("id", pa.int64()), ("seq", pa.int64()), ("round_type", pa.string()), ("amount", pa.float64()), ("valuation", pa.float64()),
    ("announced", pa.date32()), ("lead", pa.string()), ("source_url", pa.string()), ("investors", pa.list_(pa.string())), ("message", pa.string()),
])


def fold(rows: Iterator[dict]) -> Iterator[dict]:
    """Outcomes of one component: rows on file (``seq`` null) in order, then found ones in order of arrival."""
    on_file, planned, patches = OpenRounds(), OpenRounds(), {}
    for r in rows:
        if r["seq"] is None:
            on_file.add(r)
            continue
        for held in (on_file, planned):
            n = held.match(r)
            if n is None:
                continue
            target = held.rows[n]
            if (why := contradiction(target, r)) is not None:
                yield {"company": r["company"], "action": "conflict", "id": target["id"], "seq": r["seq"], "round_type": r["round_type"], "message": why}
            elif patch := fill(target, r):
                held.change(n, patch)
                if held is on_file:
                    patches.setdefault(n, {}).update(patch)
            break
        else:
            planned.add(r)
    for n, patch in patches.items():
        yield {"company": on_file.rows[n]["company"], "action": "update", "id": on_file.rows[n]["id"], **patch, "round_type": on_file.rows[n]["round_type"]}
    for r in planned.rows:
        yield {"company": r["company"], "action": "insert", "seq": r["seq"], **{f: r[f] for f in FIELDS}}


def _inserts(found: pa.RecordBatch) -> pa.RecordBatch:
    """Found rounds as they are, each an insert."""
    given = {"action": pa.array(["insert"] * found.num_rows, pa.string())} | {f.name: found.column(f.name) for f in _OUT if f.name in ("company", "seq", *FIELDS)}
    return pa.RecordBatch.from_arrays([given[f.name].cast(f.type) if f.name in given else pa.nulls(found.num_rows, f.type) for f in _OUT], schema=_OUT)


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    alone: list[pa.RecordBatch] = []

    def each() -> Iterator[dict]:
        for batch in batches:
            # a component of one row has nothing to meet; those at the edges of a batch may go on in the next
            place = batch.column("component").to_numpy()
            single = np.zeros(len(place), bool)
            single[1:-1] = (place[1:-1] != place[:-2]) & (place[1:-1] != place[2:])
            if single.any():
                alone.append(_inserts(batch.filter(pa.array(single & batch.column("seq").is_valid().to_numpy(zero_copy_only=False)))))
                batch = batch.filter(pa.array(~single))
            for start in range(0, batch.num_rows, 1024):
                yield from batch.slice(start, 1024).to_pylist()

    rows, out = each(), []
    held = next(rows, None)
    while held is not None:
        component, after = held["component"], []

        def one() -> Iterator[dict]:
            r = held
            while r is not None and r["component"] == component:
                yield r
                r = next(rows, None)
            after.append(r)

        for found in fold(one()):
            out.append(found)
            if len(out) == 2048:
                yield pa.RecordBatch.from_pylist(out, schema=_OUT)
                out = []
        while alone:
            yield alone.pop()
        held = after[0]
    yield from alone
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_OUT)


def _stretches(few: DataFrame, keys: list[str], value: str, apart: int, name: str) -> DataFrame:
    """Number of the stretch that each distinct ``value`` of a key is in; a stretch ends where the next is more than ``apart`` away.

    The windows run over distinct values: days of a stage, or bands of amounts.
    """
    ordered = W.partitionBy(*keys).orderBy(value)
    starts = F.when(F.col(value) - F.lag(value).over(ordered) > apart, 1).otherwise(0)
    return few.withColumn("_starts", starts).withColumn(name, F.sum("_starts").over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_starts")


def _joined_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, least block that it is connected to) of pairs of blocks that a row is in, sorted by company.

    A company has no more blocks than stretches of days and of amounts, so its union-find is small.
    """
    names, up, now = ["_block", "_group"], {}, None

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        blocks, groups = [], []
        for firm, a, b in zip(*(c.to_numpy().tolist() for c in batch.columns), strict=True):
            if firm != now:
                blocks += up
                groups += map(top, up)
                up.clear()
                now = firm
            x, y = top(up.setdefault(a, a)), top(up.setdefault(b, b))
            if x < y:
                up[y] = x
            else:
                up[x] = y
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (blocks, groups)], names=names)
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (list(up), list(map(top, up)))], names=names)


def _components(rows: DataFrame) -> DataFrame:
    """Rows with ``component``, so that no two rounds of different components can match, whatever they are filled with.

    A field that is filled comes from a round that matched, so it is enough that
    these are linked: rounds of one stage whose days lie FAR + SOON apart or less (a
    generic round may take the stage of one SOON away), all rounds of a stage
    that has an undated one, and rounds of a company whose amounts are alike.
    """
    named = F.col("round_type").isin(*[s for s in NAMED_STAGES if s != LETTERS])
    band = F.when(F.col("amount") > 0, F.floor(F.log("amount") / F.lit(BAND)))
    day = F.datediff("announced", F.lit("1970-01-01").cast("date"))
    shared_checkpoints(rows.sparkSession.sparkContext)
    rows = rows.withColumn("_firm", F.xxhash64("company")).withColumn("_band", band).withColumn("_day", day)
    # an undated round is a value of its stage, too, so that one join tells all of a row's stage
    days = _stretches(rows.select("_firm", "round_type", "_day").distinct(), ["_firm", "round_type"], "_day", FAR + SOON, "_t")
    days = days.withColumn("_whole", F.max(named & F.col("_day").isNull()).over(W.partitionBy("_firm", "round_type")))
    by_stage = F.when(F.col("_whole"), F.xxhash64("_firm", "round_type", F.lit("whole"))).when(F.col("_day").isNotNull(), F.xxhash64("_firm", "round_type", "_t"))
    days = days.select(F.col("_firm").alias("_f"), F.col("round_type").alias("_r"), F.col("_day").alias("_d"), by_stage.alias("_by_stage"))
    bands = _stretches(rows.where("_band IS NOT NULL").select("_firm", "_band").distinct(), ["_firm"], "_band", 1, "_a").select("_firm", "_band", F.xxhash64("_firm", F.lit("amount"), "_a").alias("_by_amount"))
    met = (F.col("_firm") == F.col("_f")) & F.col("round_type").eqNullSafe(F.col("_r")) & F.col("_day").eqNullSafe(F.col("_d"))
    placed = rows.join(days.hint("merge"), met).drop("_f", "_r", "_d").join(bands.hint("merge"), ["_firm", "_band"], "left")
    placed = placed.checkpoint()
    pairs = placed.where("_by_stage IS NOT NULL AND _by_amount IS NOT NULL").select("_firm", "_by_stage", "_by_amount").distinct()
    joined = pairs.repartition("_firm").sortWithinPartitions("_firm").mapInArrow(_joined_blocks, "_block long, _group long")
    alone = F.xxhash64("_firm", "id", "seq", F.lit("alone"))
    placed = placed.withColumn("_block", F.coalesce("_by_stage", "_by_amount", alone)).join(joined.hint("merge"), "_block", "left")
    return placed.withColumn("component", F.coalesce("_group", "_block"))


def _given(df: DataFrame, place: Column, found: bool) -> DataFrame:
    none = F.lit(None).cast("long")
    return df.select(
        F.col("company").cast("long").alias("company"), (none if found else place).alias("id"), (place if found else none).alias("seq"), round_label(F.col("round_type")).alias("round_type"),
        *[F.col(c).cast("double").alias(c) for c in ("amount", "valuation")], F.col("announced").cast("date").alias("announced"), "lead", "source_url", "investors",
    )


def plan_round_writes(on_file: DataFrame, found: DataFrame) -> DataFrame:
    """What to write: a row per insert (``seq`` of the first round found of it), update (``id``, only the fields to fill) and conflict.

    on_file: company, id; found: company, seq (the order of arrival); both:
    round_type, amount, valuation, announced, lead, source_url, investors.  Rounds on
    file are compared in order of ``id``.  A found IPO is never written.  Nulls are
    empty fields; rounds without a company are one company's.  Repeated rows on
    file each stand for a round.  Empty tables give an empty plan.
    """
    shared_checkpoints(found.sparkSession.sparkContext)
    given = _given(on_file, F.col("id").cast("long"), False).withColumn("_found", F.lit(False)).unionByName(_given(found, F.col("seq").cast("long"), True).withColumn("_found", F.lit(True)))
    rows = given.checkpoint().where("NOT _found OR round_type <> 'IPO'").drop("_found")  # labels are read once
    placed = _components(rows).select("component", "company", "id", "seq", *FIELDS)
    dealt = placed.repartition("component").sortWithinPartitions("component", F.col("seq").asc_nulls_first(), "id")
    return dealt.mapInArrow(_plan, OUT)
