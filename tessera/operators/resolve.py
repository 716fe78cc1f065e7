"""Entity resolution: identifiers, groups, candidate pairs, decisions, connected groups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as words
from tessera.functions.money import close
from tessera.functions.names import investor_key, investors_match
from tessera.sources.tables import dealt

#: Trigram likeness from which two names are candidates.
NAME_LIKENESS = 0.86


def identifier_groups(identifiers: DataFrame, strong: Sequence[str]) -> DataFrame:
    """(kind, value, members, n) of strong identifiers that more than one entity carries."""
    grouped = identifiers.where(F.col("kind").isin(*strong) & F.col("value").isNotNull()).groupBy("kind", "value")
    return grouped.agg(F.sort_array(F.collect_set("entity_id")).alias("members"), F.countDistinct("entity_id").alias("n")).where("n > 1")


def survivors(groups: DataFrame, richness: DataFrame) -> DataFrame:
    """(kind, value, loser, survivor): the richest member stays, the least id where they tie; one pass."""
    members = groups.select("kind", "value", F.explode("members").alias("entity_id")).join(richness, "entity_id", "left")
    best = members.groupBy("kind", "value").agg(F.min(F.struct((-F.coalesce("richness", F.lit(0))).alias("r"), "entity_id")).alias("best"))
    return members.join(best, ["kind", "value"]).where(F.col("entity_id") != F.col("best.entity_id")).select("kind", "value", F.col("entity_id").alias("loser"), F.col("best.entity_id").alias("survivor"))


#: Rows of a key that one task pairs with all rows of the key.
PART_ROWS = 1024


def _parts(rows: Column) -> Column:
    return F.ceil(rows / F.lit(PART_ROWS)).cast("int")


def _part(unique: Column) -> Column:
    return F.pmod(F.xxhash64(unique), F.col("_parts")).cast("int")


def _each_part() -> Column:
    return F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))


def same_key_pairs(df: DataFrame, key: str, unique: str, agree: Sequence[str] = (), *, within: int | None = None) -> DataFrame:
    """left_id < right_id of rows that share a key, with the number of agreeing columns and a score.

    The score is 0.7 and 0.1 for each agreement, 1 at most.  All pairs of a key are
    made, which is quadratic in its rows: these are dealt over tasks in parts of
    PART_ROWS, and each part meets all rows of its key.  A caller that wants only pairs
    whose ids (numbers) are near passes ``within``: they must then be less than that
    apart, and rows meet only in their own cell of so many ids and the one before.  The
    join merges: packed files hold more rows than their size says, and aren't sent
    through the driver.
    """
    cols = [unique, *agree]
    a = df.select(key, *[F.col(c).alias(f"_a_{c}") for c in cols])
    b = df.select(key, *[F.col(c).alias(f"_b_{c}") for c in cols])
    if within is not None:
        on, cell = [key, "_cell"], lambda c: F.floor(F.col(c) / within)
        b = b.withColumn("_cell", cell(f"_b_{unique}"))
        a = a.withColumn("_cell", F.explode(F.array(cell(f"_a_{unique}"), cell(f"_a_{unique}") + 1)))
    else:
        on, parts = [key, "_part"], df.groupBy(key).agg(_parts(F.count("*")).alias("_parts")).where(F.col(key).isNotNull())
        a = dealt(a.join(parts.hint("merge"), key).withColumn("_part", _part(F.col(f"_a_{unique}"))).drop("_parts"), *on)
        b = dealt(b.join(parts.hint("merge"), key).withColumn("_part", _each_part()).drop("_parts"), *on)
    agreed = sum((F.when(F.col(f"_a_{c}") == F.col(f"_b_{c}"), 1).otherwise(0) for c in agree), F.lit(0))
    pairs = a.join(b.hint("merge"), on).where(F.col(f"_a_{unique}") < F.col(f"_b_{unique}"))
    if within is not None:
        pairs = pairs.where(F.col(f"_b_{unique}") - F.col(f"_a_{unique}") < within)
    return pairs.select(F.col(f"_a_{unique}").alias("left_id"), F.col(f"_b_{unique}").alias("right_id"), key, agreed.alias("agree")).withColumn(
        "score", F.least(F.lit(0.7) + F.lit(0.1) * F.col("agree"), F.lit(1.0))
    )


#: Most trigrams that make a key together, and most keys that a name has for the names of one size.
TOGETHER, MOST_KEYS = 4, 36


def _together(n: int, m: int, least: float) -> tuple[int, int]:
    """(trigrams that sets of n and m must share to be ``least`` alike, how many of them make a key)."""
    shared = ceil((n + m) * least / (1 + least) - 1e-9)
    lack = max(n, m) - shared
    return shared, max([1, *[k for k in range(2, min(TOGETHER, shared) + 1) if comb(lack + k, k) <= MOST_KEYS]])


def _name_keys(batches: Iterator[pa.RecordBatch], sizes: list[int], least: float) -> Iterator[pa.RecordBatch]:
    """(id, key) of every combination of a name's rare trigrams, for each size of names that may be alike; grams are ranks, rarest first."""
    for batch in batches:
        ids, grams, count = batch.column("id"), batch.column("grams"), batch.column("n").to_numpy()
        for n in np.unique(count).tolist():
            at = np.flatnonzero(count == n)
            ranks = grams.take(pa.array(at)).flatten().to_numpy().reshape(-1, n).astype(np.uint64)
            own = ids.take(pa.array(at))
            for m in sizes:
                if min(n, m) < least * max(n, m) - 1e-9:
                    continue
                shared, k = _together(n, m, least)
                taken = np.array(list(combinations(range(n - shared + k), k)))
                key = np.full((len(at), len(taken)), min(n, m) * 1_000_003 + max(n, m), np.uint64)
                for j in range(k):
                    key = (key ^ ranks[:, taken[:, j]]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                each = pa.array(np.repeat(np.arange(len(at)), len(taken)))
                yield pa.RecordBatch.from_arrays([own.take(each), pa.array(key.ravel().view(np.int64))], names=["id", "key"])


def similar_names(df: DataFrame, name: str, unique: str, *, least: float = NAME_LIKENESS) -> DataFrame:
    """left_id < right_id and likeness (3 decimals) of different names at least ``least`` alike by trigrams.

    Two sets of n and m trigrams that alike share at least o = ceil(least / (1 + least) *
    (n + m)), so k of them are among the rarest n - o + k of the one and m - o + k of
    the other: names of each two sizes are joined on combinations of k rare
    trigrams.  The alphabet of trigrams doesn't grow with the names, but several of
    them together stay rare; k is as many as make MOST_KEYS keys at most, and TOGETHER at
    most, and every two sizes that can be alike are joined, so nothing is missed.
    Equal names stand as one.  The joins merge: packed files hold more names than their
    size says, and aren't sent through the driver.
    """
    shared_checkpoints(df.sparkSession.sparkContext)
    names = dealt(df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.min(unique).alias("id"))).withColumn("grams", words.word_trigrams(F.col("name"))).where(F.size("grams") > 0)
    names = names.select("id", "grams").checkpoint()
    each = names.select("id", F.explode("grams").alias("g"))
    counts = each.groupBy("g").agg(F.count("*").alias("df"))
    counts = F.broadcast(counts.withColumn("rank", F.row_number().over(W.orderBy("df", "g"))))  # of letters, digits and a blank: 37 ** 3 at most
    ranked = each.join(counts, "g").groupBy("id").agg(F.array_sort(F.collect_list("rank")).alias("grams")).withColumn("n", F.size("grams")).checkpoint()
    sizes = [r["n"] for r in ranked.select("n").distinct().collect()]  # as many as the longest name has trigrams at most
    kind = ranked.schema["id"].dataType.simpleString()
    keys = ranked.mapInArrow(partial(_name_keys, sizes=sizes, least=least), f"id {kind}, key long")
    a, b = keys.withColumnRenamed("id", "left_id"), keys.withColumnRenamed("id", "right_id")
    pairs = a.join(b.hint("merge"), "key").where(F.col("left_id") < F.col("right_id")).select("left_id", "right_id").distinct()
    left, right = ranked.select(F.col("id").alias("left_id"), F.col("grams").alias("lg")), ranked.select(F.col("id").alias("right_id"), F.col("grams").alias("rg"))
    scored = pairs.join(left.hint("merge"), "left_id").join(right.hint("merge"), "right_id").withColumn("likeness", words.set_similarity(F.col("lg"), F.col("rg")))
    return scored.where(F.col("likeness") >= least).select("left_id", "right_id", F.round("likeness", 3).alias("likeness"))


def undecided_pairs(df: DataFrame, key: str, unique: str, decisions: DataFrame) -> DataFrame:
    """left_id < right_id of rows that share a key, without those that a reviewer has decided, in either order.

    All pairs of a key are made, which is quadratic in its rows, but none of them is
    shuffled: a key's ids are one sorted array, and each row, which carries the ids
    that it is decided with, gives those after it in the array less its own.  A key's
    rows are dealt over tasks in parts of PART_ROWS, which each get the array.  Ids that
    stand several times in a key make as many pairs, and have an array to themselves.
    """
    kind = f"array<{df.schema[unique].dataType.simpleString()}>"
    none, lo, hi = F.array().cast(kind), F.least("left_id", "right_id"), F.greatest("left_id", "right_id")
    decided = decisions.select(lo.alias("_id"), hi.alias("_hi")).groupBy("_id").agg(F.collect_list("_hi").cast(kind).alias("_decided"))
    counted = df.where(F.col(key).isNotNull() & F.col(unique).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(unique).alias("_id")).agg(F.count("*").cast("int").alias("_n"))
    once, again = F.when(F.col("_n") == 1, F.col("_id")), F.when(F.col("_n") > 1, F.array_repeat("_id", F.col("_n")))
    keys = counted.groupBy("_key").agg(F.sort_array(F.collect_list(once)).alias("_once"), F.flatten(F.collect_list(again)).alias("_again"), _parts(F.sum("_n")).alias("_parts"))
    left = keys.select("_key", "_parts", F.explode(F.concat("_once", "_again")).alias("_id")).join(decided.hint("merge"), "_id", "left")
    left = dealt(left.select("_key", _part(F.col("_id")).alias("_part"), "_id", F.coalesce("_decided", none).alias("_decided")), "_key", "_part")
    held = keys.select("_key", "_once", "_again", _each_part().alias("_part"))
    after = F.slice("_once", F.array_position("_once", F.col("_id")).cast("int") + 1, F.size("_once"))
    rest = F.concat(F.array_except(after, F.col("_decided")), F.filter("_again", lambda x: ~F.array_contains("_decided", x)))
    return left.join(held.hint("merge"), ["_key", "_part"]).select(F.col("_id").alias("left_id"), F.explode(rest).alias("right_id")).where("left_id < right_id")


def shared_checkpoints(context) -> None:
    """See to it that checkpoints go to a folder that all share: the cluster's, or on one machine a temporary one."""
    if not context.getConf().get("spark.checkpoint.dir"):
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file:///tmp/tessera-checkpoints")


def connected(pairs: DataFrame, left: str = "left_id", right: str = "right_id") -> DataFrame:
    """(id, group_id): the least id that each is connected to, over all pairs.

    Each round maps every node to whichever of itself and its neighbours is drawn
    first and contracts the edges by that map, until none is left.  Draws are
    hashes that differ by round, so a chain halves each round, whatever the order
    of its ids; rounds are checkpointed to the shared folder.
    """
    shared_checkpoints(pairs.sparkSession.sparkContext)
    edges = pairs.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a != b").distinct().checkpoint()
    found = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct().withColumn("root", F.col("id"))
    turn = 0
    while not edges.isEmpty():
        a, b = (F.struct(F.xxhash64(c, F.lit(turn)).alias("draw"), F.col(c).alias("id")) for c in ("a", "b"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min(b).alias("near")).select(F.col("a").alias("root"), F.least(F.col("near"), a)["id"].alias("up")).checkpoint()
        found = found.join(step.hint("merge"), "root", "left").select("id", F.coalesce("up", "root").alias("root")).checkpoint()
        up_a, up_b = step.select(F.col("root").alias("a"), F.col("up").alias("up_a")), step.select(F.col("root").alias("b"), F.col("up").alias("up_b"))
        moved = edges.join(up_a.hint("merge"), "a").join(up_b.hint("merge"), "b").where("up_a != up_b")
        edges = moved.select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct().checkpoint()
        turn += 1
    return found.join(found.groupBy("root").agg(F.min("id").alias("group_id")).hint("merge"), "root").select("id", "group_id")


def cascade(entities: DataFrame, unique: str, steps: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """Link each entity by the first step that finds a company: (entity column, keyed companies, key).

    Each keyed table has its key and company_id; a key that points to several
    companies links none.  Returns the entity columns, company_id and matched_by.
    """
    out, found = entities, []
    for i, (column, companies, key) in enumerate(steps):
        sure = companies.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_k{i}")).agg(F.min("company_id").alias(f"_c{i}"), F.countDistinct("company_id").alias("_n")).where("_n = 1").drop("_n")
        out = out.join(sure, F.col(column) == F.col(f"_k{i}"), "left")
        found.append((column, F.col(f"_c{i}")))
    company = F.coalesce(*[c for _, c in found])
    by = F.coalesce(*[F.when(c.isNotNull(), name) for name, c in found])
    return out.select(*entities.columns, company.alias("company_id"), by.alias("matched_by"))


def round_pairs(rounds: DataFrame, *, company: str, unique: str, date: str, amount: str, valuation: str | None = None, lead: str | None = None, days: int = 270) -> DataFrame:
    """left_id < right_id and verdict of rounds of one company that may be the same.

    Dates at most ``days`` apart are required.  A shared lead and amounts within
    10 % are a duplicate; amounts within 5 % and valuations within 5 % are one
    too, unless the leads conflict, which is for review.
    """
    none = F.lit(None)
    cols = {"id": F.col(unique), "date": F.col(date), "amount": F.col(amount), "valuation": F.col(valuation) if valuation else none.cast("double"), "lead": F.col(lead) if lead else none.cast("string")}
    a = rounds.select(company, *[c.alias(f"a_{k}") for k, c in cols.items()])
    b = rounds.select(company, *[c.alias(f"b_{k}") for k, c in cols.items()])
    pairs = a.join(b, company).where((F.col("a_id") < F.col("b_id")) & (F.abs(F.datediff("a_date", "b_date")) <= days))
    agree = investors_match(F.col("a_lead"), F.col("b_lead"))
    conflict = (investor_key(F.col("a_lead")) != "") & (investor_key(F.col("b_lead")) != "") & ~agree
    very_close = close(F.col("a_amount"), F.col("b_amount"), 0.05) & close(F.col("a_valuation"), F.col("b_valuation"), 0.05)
    verdict = F.when(agree & close(F.col("a_amount"), F.col("b_amount"), 0.10), "duplicate").when(very_close & conflict, "needs_review").when(very_close, "duplicate")
    return pairs.select(company, F.col("a_id").alias("left_id"), F.col("b_id").alias("right_id"), verdict.alias("verdict")).where("verdict is not null")


def write_decision(old: Column, new: Column, *, verified: Column, old_rank: Column, new_rank: Column, sources: Column) -> Column:
    """fill, keep or overwrite: a verified value stays; without provenance two sources are needed; else the higher rank."""
    return (
        F.when(new.isNull(), "keep")
        .when(old.isNull(), "fill")
        .when(old.eqNullSafe(new) | verified, "keep")
        .when(old_rank.isNull(), F.when(sources >= 2, "overwrite").otherwise("keep"))
        .when(new_rank > old_rank, "overwrite")
        .otherwise("keep")
    )


def headcount_decision(old: Column, new: Column, *, sources: Column, from_site: Column) -> Column:
    """A change of more than half (or from 0) needs two sources or the company's own site, else it is an estimate."""
    large = (old == 0) | (F.abs(new - old) / F.nullif(old, F.lit(0)) > 0.5)
    return F.when(new.isNull(), "keep").when(old.isNull() | ~large | (sources >= 2) | from_site, "write").otherwise("estimate")
