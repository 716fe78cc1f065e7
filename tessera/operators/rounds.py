"""Greedy, order-dependent merging of funding rounds, one company's stretch of dates at a time.

The order within a company is fixed by explicit sort columns, so results don't
depend on partitions.  A company's rounds are cut where more than DAYS lie
between two of them, which no merge can span, so a company with very many rounds
is many small groups; tasks stream through the sorted groups in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.relational import segments

# How specific a round label is, least first.
SPECIFICITY = ("Unknown", "Other", "Growth", "Seed", "Pre-Seed", "Series A", "Series B", "Series C", "Series D", "Series E", "Series F+")
DAYS, SAME_LEAD, SAME_BOTH = 270, 0.10, 0.05


def _key(name) -> str:
    return " ".join(name.lower().replace(".", "").replace(",", "").split()) if isinstance(name, str) else ""


def _agree(a: str, b: str) -> bool:
    return bool(a and b) and (a in b or b in a)


def _known(x) -> bool:
    return x is not None and x == x


def _close(a, b, share: float) -> bool:
    return _known(a) and _known(b) and a > 0 and b > 0 and abs(a - b) / max(a, b) <= share


def verdict(a: dict, b: dict) -> str | None:
    """duplicate, review, or None for two rounds."""
    if a["date"] is None or b["date"] is None or abs((a["date"] - b["date"]).days) > DAYS:
        return None
    x, y = _key(a["lead"]), _key(b["lead"])
    if _agree(x, y) and _close(a["amount"], b["amount"], SAME_LEAD):
        return "duplicate"
    if _close(a["amount"], b["amount"], SAME_BOTH) and _close(a["valuation"], b["valuation"], SAME_BOTH):
        return "review" if x and y and not _agree(x, y) else "duplicate"
    return None


def _joined(a: dict, b: dict) -> dict:
    def known(field):
        return a[field] if _known(a[field]) else b[field]

    lead = a["lead"] or b["lead"]
    others = {n.strip() for n in [*a["others"], *b["others"]] if n and n.strip()}
    others |= {n for n in (a["lead"], b["lead"]) if n and not _agree(_key(n), _key(lead))}

    def rank(label):
        return SPECIFICITY.index(label) if label in SPECIFICITY else 1

    return {
        "round_id": a["round_id"],
        "label": b["label"] if rank(b["label"]) > rank(a["label"]) else a["label"],
        "amount": known("amount"),
        "valuation": known("valuation"),
        "date": min(a["date"], b["date"]),
        "lead": lead,
        "others": sorted(others),
        "merged": a["merged"] + [b["round_id"]],
    }


SCHEMA = "company_id long, round_id long, label string, amount double, valuation double, date timestamp, lead string, others array<string>, merged array<long>"
_FIELDS = [c.split()[0] for c in SCHEMA.split(", ")]


def merge_sorted(rows: list[dict]) -> list[dict]:
    """Rounds of one company in order of date (unknown dates last) after greedy merging."""
    for r in rows:
        r["others"], r["merged"] = list(r["others"] or []), []
    kept, used = [], set()
    for i, row in enumerate(rows):
        if i in used:
            continue
        for j in range(i + 1, len(rows)):
            if row["date"] is None or rows[j]["date"] is None or (rows[j]["date"] - row["date"]).days > DAYS:
                break  # later ones are further away still
            if j not in used and verdict(row, rows[j]) == "duplicate":
                row = _joined(row, rows[j]) | {"company_id": row["company_id"]}
                used.add(j)
        kept.append(row)
    return kept


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.timestamp("us", tz="UTC"), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64())]
    schema = pa.schema(list(zip(_FIELDS, kinds)))

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[f] for r in rows], k) for f, k in zip(_FIELDS, kinds)], schema=schema)

    now, group, out = None, [], []
    for batch in batches:
        for row in batch.to_pylist():
            key = (row["company_id"], row.pop("segment"))
            if key != now:
                out += merge_sorted(group)
                now, group = key, []
            group.append(row)
        if out:
            yield batch_of(out)
            out = []
    out += merge_sorted(group)
    if out:
        yield batch_of(out)


def merge_rounds(rounds: DataFrame) -> DataFrame:
    """Rounds after greedy merging by company.

    rounds: company_id, round_id, label, amount, valuation, date, lead, others.
    A round that was merged into another is listed in its ``merged``.
    """
    base = rounds.select("company_id", "round_id", "label", "amount", "valuation", "date", "lead", "others")
    order = [F.col("date").asc_nulls_last(), F.col("round_id")]
    before = F.lag("date").over(W.partitionBy("company_id").orderBy(*order))
    numbered = segments(base.withColumn("_before", before), "company_id", order, F.datediff("date", "_before") > DAYS)
    dealt = numbered.drop("_before").repartition("company_id", "segment").sortWithinPartitions("company_id", "segment", *order)
    return dealt.mapInArrow(_merge, SCHEMA)


#: Days between a round without an amount and the one with an amount that it is.
ABSORB_DAYS = 31
GENERIC = ("Other", "Unknown")


def absorb_amountless(rounds: DataFrame) -> DataFrame:
    """``rounds`` without those that only repeat another: no amount, and ABSORB_DAYS or fewer from one of the company that has one.

    rounds: company, seq (their order), round_type, amount, day, lead and whatever else.
    The first such round in order takes what it lacks from those it absorbs, the first
    of them that has it: a named type for a generic one, a lead.  Undated rounds and
    rounds of no company stay as they are.  Rounds meet in cells of ABSORB_DAYS days.
    """
    cell = F.floor(F.datediff("day", F.lit("1970-01-01").cast("date")) / ABSORB_DAYS)
    bare = rounds.where("amount IS NULL AND day IS NOT NULL").select("company", F.col("seq").alias("_gone"), F.col("day").alias("_day"), F.col("round_type").alias("_type"), F.col("lead").alias("_lead"), F.explode(F.array(*[cell + i for i in (-1, 0, 1)])).alias("_cell"))
    full = rounds.where("amount IS NOT NULL AND day IS NOT NULL").select("company", F.col("seq").alias("_target"), F.col("day").alias("_their"), cell.alias("_cell"))
    near = bare.join(full, ["company", "_cell"]).where(F.abs(F.datediff("_day", "_their")) <= ABSORB_DAYS)
    met = near.groupBy("company", "_gone").agg(F.min("_target").alias("_target"), F.first("_type").alias("_type"), F.first("_lead").alias("_lead"))
    earliest = lambda c, has: F.min(F.when(has, F.struct("_gone", c)))[c]
    given = met.groupBy("company", "_target").agg(earliest("_type", ~F.col("_type").isin(*GENERIC)).alias("_type"), earliest("_lead", F.col("_lead") != "").alias("_lead"))
    kept = rounds.join(met.select("company", F.col("_gone").alias("seq")), ["company", "seq"], "left_anti")
    filled = kept.join(given.withColumnRenamed("_target", "seq"), ["company", "seq"], "left")
    kind = F.when(F.col("round_type").isin(*GENERIC), F.coalesce("_type", "round_type")).otherwise(F.col("round_type"))
    return filled.withColumns({"round_type": kind, "lead": F.coalesce(F.nullif(F.col("lead"), F.lit("")), F.col("_lead"))}).select(*rounds.columns)
