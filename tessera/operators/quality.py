"""Measuring quality: precision and coverage, samples, gates, matching."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def measured(gold: DataFrame, produced: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """field, scored, produced, correct, wrong, coverage, precision of produced values against gold ones."""
    g = gold.select(*keys, F.col(value).alias("_gold"))
    p = produced.select(*keys, F.col(value).alias("_got"))
    joined = g.join(p, list(keys), "left")
    right = F.col("_got").isNotNull() & F.col("_got").eqNullSafe(F.col("_gold"))
    out = joined.groupBy("field").agg(
        F.count("_gold").alias("scored"),
        F.count("_got").alias("produced"),
        F.count(F.when(right, 1)).alias("correct"),
        F.count(F.when(F.col("_got").isNotNull() & ~right, 1)).alias("wrong"),
    )
    return out.withColumn("coverage", F.try_divide("correct", "scored")).withColumn("precision", F.try_divide("correct", "produced"))


def draw_order(*columns: str, seed: int = 0) -> Column:
    """A fixed pseudo-random order of rows."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *columns))


def stratified(df: DataFrame, strata: dict[str, tuple[Column, int]], total: int, unique: str, *, seed: int = 0) -> DataFrame:
    """At least the asked number of each stratum (as far as there are so many), the rest at random, ``total`` rows.

    ``strata``: name -> (condition, least), disjoint or in order of precedence.
    """
    kind = F.coalesce(*[F.when(c, name) for name, (c, _) in strata.items()], F.lit("rest"))
    least = F.coalesce(*[F.when(F.col("stratum") == name, n) for name, (_, n) in strata.items()], F.lit(0))
    ranked = df.withColumn("stratum", kind).withColumn("_draw", draw_order(unique, seed=seed))
    ranked = ranked.withColumn("_n", F.row_number().over(W.partitionBy("stratum").orderBy("_draw", unique)))
    return ranked.orderBy((F.col("_n") <= least).desc(), "_draw", unique).limit(total).drop("_draw", "_n")


def capped(df: DataFrame, key: str, order: Sequence[Column], k: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def audit_draw(df: DataFrame, unique: str, company: str, hardness: Column, n: int = 25, per_company: int = 2) -> DataFrame:
    """``n`` random and the ``n`` hardest other rows, few from each company."""
    few = capped(df, company, [draw_order(unique), F.col(unique)], per_company)
    chance = few.orderBy(draw_order(unique), unique).limit(n).withColumn("drawn", F.lit("random"))
    hard = few.join(chance.select(unique), unique, "left_anti").orderBy(hardness.desc(), unique).limit(n).withColumn("drawn", F.lit("hard"))
    return chance.unionByName(hard)


def field_status(marks: DataFrame, *, least: int = 20, share: float = 0.9) -> DataFrame:
    """Whether a field may be opened: enough marks, enough of them right, none pending."""
    out = marks.groupBy("field").agg(F.count(F.when(F.col("mark") != "pending", 1)).alias("marks"), F.count(F.when(F.col("mark") == "correct", 1)).alias("correct"), F.count(F.when(F.col("mark") == "pending", 1)).alias("pending"))
    ok = (F.col("marks") >= least) & (F.col("correct") >= share * F.col("marks")) & (F.col("pending") == 0)
    return out.withColumn("open", ok)


def coverage_by_field(df: DataFrame, fields: Sequence[str], sourced: Sequence[str]) -> DataFrame:
    """field, with_value, with_source, pct: columns that have a value, and a source column beside it."""
    pairs = ", ".join(f"'{f}', CAST(`{f}` AS STRING), CAST(`{s}` AS STRING)" for f, s in zip(fields, sourced))
    long = df.select(F.expr(f"stack({len(fields)}, {pairs}) AS (field, value, source)"))
    out = long.groupBy("field").agg(F.count("value").alias("with_value"), F.count(F.when(F.col("value").isNotNull(), F.col("source"))).alias("with_source"))
    return out.withColumn("pct", F.round(100 * F.try_divide("with_source", "with_value"), 1))


def gate(before: DataFrame, after: DataFrame, status: str = "status") -> DataFrame:
    """Counts of a diff by status and whether the gate holds: nothing lost or changed."""
    counts = before.groupBy(status).count()
    return counts.withColumn("holds", ~F.col(status).isin("lost", "changed"))


def _match_group(pdf: pd.DataFrame) -> pd.DataFrame:
    gold = pdf[pdf["side"] == "gold"].sort_values(["date", "id"]).to_dict("records")
    got = pdf[pdf["side"] == "got"].sort_values(["date", "id"]).to_dict("records")
    pairs = sorted((abs((g["date"] - o["date"]).days), g["id"], o["id"]) for g in gold for o in got if g["label"] == o["label"])
    used_g, used_o, out = set(), set(), []
    for gap, g, o in pairs:
        if g not in used_g and o not in used_o:
            used_g.add(g)
            used_o.add(o)
            out.append((pdf["company_id"].iloc[0], g, o, gap))
    return pd.DataFrame(out, columns=["company_id", "gold_id", "got_id", "days"])


def match_rounds(gold: DataFrame, got: DataFrame) -> DataFrame:
    """Greedy one-to-one matching of rounds (company_id, id, label, date) by label and nearest date."""
    both = gold.withColumn("side", F.lit("gold")).unionByName(got.withColumn("side", F.lit("got")))
    return both.groupBy("company_id").applyInPandas(_match_group, "company_id long, gold_id long, got_id long, days long")
