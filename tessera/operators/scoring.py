"""Scores whose every part is a column: missing evidence drops out, it isn't zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import dates, vectors
from tessera.operators.relational import clamp_limit, every_pair, first_per, in_window, latest_values, names_of

# Weights of the five pillars.
WEIGHTS = {"investors": 0.25, "team": 0.25, "growth": 0.20, "recency": 0.15, "media": 0.15}


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def weighted(pillars: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted mean of the pillars that have a score; null where none has."""
    total = sum((F.when(c.isNotNull(), weights[k]).otherwise(0.0) for k, c in pillars.items()), F.lit(0.0))
    points = sum((F.coalesce(c, F.lit(0.0)) * F.when(c.isNotNull(), weights[k]).otherwise(0.0) for k, c in pillars.items()), F.lit(0.0))
    return points / F.nullif(total, F.lit(0.0))


def final_score(base: Column, momentum: Column, investors: Column, team: Column) -> Column:
    """Base with the sector's momentum (30 % at most), 1 to 100, one decimal; strong investors and team are 70 at least."""
    moved = clamp(F.round(base * (1.0 + F.coalesce(clamp(momentum, -0.30, 0.30), F.lit(0.0))), 1), 1.0, 100.0)
    floor = F.coalesce((investors >= 85) & (team >= 85) & (moved < 70), F.lit(False))
    return F.when(floor, 70.0).otherwise(moved)


def tier(score: Column) -> Column:
    return F.when(score >= 85, "A").when(score >= 70, "B").otherwise("C")


def confidence(n: Column) -> Column:
    return F.when(n == 5, "high").when(n >= 3, "medium").when(n >= 1, "low").otherwise("none")


def investor_pillar(rounds: DataFrame, investors: DataFrame) -> DataFrame:
    """company_id, n_investors, best_tier, investors (points) from leads and participants by name."""
    names = names_of(rounds, ["company_id"], "lead_investor", "investors")
    tiers = investors.groupBy(F.lower(F.trim("name")).alias("name")).agg(F.min("tier").alias("tier"))
    found = names.join(tiers, "name", "left").groupBy("company_id").agg(F.count("*").alias("n_investors"), F.min("tier").alias("best_tier"))
    points = F.when(F.col("best_tier") == 1, 100.0).when(F.col("best_tier") == 2, 70.0).when(F.col("best_tier") == 3, 40.0).otherwise(25.0)
    return found.withColumn("investors", points)


def team_points(people: Column) -> Column:
    """Points of an array of people with had_prior_exit, elite_background, notable_pedigree; null without people."""

    def any_has(flag: str) -> Column:
        return F.exists(people, lambda p: F.coalesce(p[flag], F.lit(False))).cast("double")

    points = 40.0 * any_has("had_prior_exit") + 35.0 * any_has("elite_background") + 25.0 * any_has("notable_pedigree")
    return F.when(F.coalesce(F.size(people), F.lit(0)) > 0, F.least(F.lit(100.0), points))


def growth_pillar(headcount: DataFrame) -> DataFrame:
    """company_id, latest, earliest, growth (points) of measured headcounts; the comparison is 150 to 395 days older."""
    measured = headcount.where(~F.col("point_type").isin("legacy", "model_estimate")).select("company_id", F.col("recorded_date").cast("date").alias("day"), "employee_count")
    latest = latest_values(measured, ["company_id"], F.col("day"), ["day", "employee_count"]).withColumnRenamed("employee_count", "latest")
    old = in_window(latest, measured, "company_id", "day", "day", ["employee_count"], after="395 DAYS", before="150 DAYS", newest=False, prefix="earliest_")
    change = F.try_divide(F.col("latest") - F.col("earliest_employee_count"), F.when(F.col("earliest_employee_count") > 0, F.col("earliest_employee_count")))
    return old.select("company_id", "latest", F.col("earliest_employee_count").alias("earliest"), clamp(50.0 + 100.0 * change, 0.0, 100.0).alias("growth_any"), change.alias("change")).select(
        "company_id", "latest", "earliest", F.when(F.col("change").isNotNull(), F.col("growth_any")).alias("growth")
    )


def company_score(companies: DataFrame, rounds: DataFrame, investors: DataFrame, headcount: DataFrame, multiples: DataFrame, *, as_of: Column) -> DataFrame:
    """One row per company with every pillar, the base, the adjustment and the score.

    companies: company_id, sector_id, founders, leadership, news (arrays of
    structs).  multiples: sector_id, effective_date, current_multiple,
    historical_multiple; the latest effective date counts.  An amount of missing
    evidence lowers confidence, not the score: a pillar without any has no score
    and its weight goes to the others.
    """
    per = latest_values(multiples, ["sector_id"], F.col("effective_date"), ["current_multiple", "historical_multiple"])
    last_round = rounds.groupBy("company_id").agg(F.max("announcement_date").alias("last_round"))
    joined = (
        companies.join(investor_pillar(rounds, investors), "company_id", "left")
        .join(growth_pillar(headcount), "company_id", "left")
        .join(last_round, "company_id", "left")
        .join(per, "sector_id", "left")
    )
    people = F.concat(F.coalesce("founders", F.array().cast(companies.schema["founders"].dataType)), F.coalesce(F.transform("leadership", lambda p: F.struct(p["name"].alias("name"), F.lit(None).cast("boolean").alias("had_prior_exit"), F.lit(None).cast("boolean").alias("elite_background"), F.lit(None).cast("boolean").alias("notable_pedigree"))), F.array().cast(companies.schema["founders"].dataType)))
    hired = F.array_max(F.transform("leadership", lambda p: p["joined_date"]))
    reported = F.array_max(F.transform("news", lambda n: n["published_date"]))
    latest, signal = dates.latest_of(funding_round=F.col("last_round"), leadership_hire=hired, news=reported)
    recent = F.size(F.filter(F.coalesce("news", F.array().cast(companies.schema["news"].dataType)), lambda n: n["published_date"] >= F.date_sub(as_of, 90)))
    scored = (
        joined.withColumn("team", team_points(people))
        .withColumn("latest_signal", signal)
        .withColumn("recency", dates.recency_points(F.datediff(as_of, latest)))
        .withColumn("media", F.least(F.lit(100.0), 25.0 * recent))
        .withColumn("momentum", F.try_divide("current_multiple", "historical_multiple") - 1.0)
    )
    pillars = {k: F.col(k) for k in WEIGHTS}
    scored = scored.withColumn("base", weighted(pillars)).withColumn("score", final_score(F.col("base"), F.col("momentum"), F.col("investors"), F.col("team")))
    known = sum((F.col(k).isNotNull().cast("int") for k in WEIGHTS), F.lit(0))
    return scored.select(
        "company_id", *WEIGHTS, "n_investors", "best_tier", "latest_signal", F.round("base", 1).alias("base"), F.round(100 * clamp(F.col("momentum"), -0.30, 0.30), 1).alias("momentum_pct"), "score", tier(F.col("score")).alias("tier"), confidence(known).alias("confidence")
    )


def early_points(facts: DataFrame, *, as_of: Column) -> DataFrame:
    """Nine point columns of how early a company is, and their sum from 0 to 100.

    facts: founding_signals, stealth_signals, active_jobs, latest_job_seen,
    avg_days_to_fill, scaled_functions, founded_year, first_filing,
    latest_patent, patent_classes; nulls mean no evidence.
    """

    def steps(x: Column, *bands: tuple[Column, int], default: int = 0) -> Column:
        return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), p) for c, p in bands], F.lit(default))

    jobs, scaled = F.coalesce("active_jobs", F.lit(0)), F.coalesce("scaled_functions", F.lit(0))
    age = F.year(as_of) - F.col("founded_year")
    seen, filed, patent, fill = (F.datediff(as_of, "latest_job_seen"), F.datediff(as_of, "first_filing"), F.datediff(as_of, "latest_patent"), F.col("avg_days_to_fill"))
    parts = {
        "pts_founding": F.least(F.coalesce("founding_signals", F.lit(0)), F.lit(5)) * 10,
        "pts_stealth": F.least(F.coalesce("stealth_signals", F.lit(0)), F.lit(3)) * 10,
        "pts_size": steps(jobs, (jobs == 0, 0), (jobs <= 10, 20), (jobs <= 25, 10), (jobs <= 50, 0), default=-30),
        "pts_recency": steps(seen, (seen <= 30, 10), (seen <= 90, 5)),
        "pts_velocity": steps(fill, (fill <= 21, 10), (fill <= 45, 5)),
        "pts_scaled": steps(scaled, (scaled >= 4, -30), (scaled == 3, -20), (scaled == 2, -10)),
        "pts_age": steps(age, (age.isNull(), 0), (age <= 2, 20), (age <= 4, 10), (age <= 7, 0), default=-10),
        "pts_inception": steps(filed, (filed <= 180, 25), (filed <= 365, 15), (filed <= 730, 5)),
        "pts_ip": steps(patent, (patent <= 365, 10), (patent <= 730, 6), (patent <= 1095, 3)) + F.when(F.coalesce("patent_classes", F.lit(0)) >= 2, 5).otherwise(0),
    }
    scored = facts.select("*", *[c.cast("int").alias(k) for k, c in parts.items()])
    return scored.withColumn("early_score", F.greatest(F.lit(0), F.least(F.lit(100), sum((F.col(k) for k in parts), F.lit(0)))))


def filing_facts(filings: DataFrame) -> DataFrame:
    """company_id with registry and patent facts; patents count once for each of their classes."""
    registry = filings.where(F.col("source").isin("sec_form_d", "uk_companies_house")).groupBy("company_id").agg(F.min("filing_date").alias("first_filing"), F.max("filing_date").alias("latest_filing"), F.count("*").alias("gov_filings"))
    exploded = filings.where(F.col("source").isin("epo_ops", "uspto_patent")).select("company_id", "filing_date", F.explode_outer("classification_codes").alias("code"))
    patents = exploded.groupBy("company_id").agg(F.max("filing_date").alias("latest_patent"), F.min("filing_date").alias("first_patent"), F.count("*").alias("patent_count"), F.countDistinct(F.substring("code", 1, 4)).alias("patent_classes"))
    return registry.join(patents, "company_id", "full")


def match_scores(vectors_of: DataFrame, centroid: DataFrame, *, least_signals: int = 3) -> DataFrame:
    """id, user_id, match_pct of every vector for users with enough signals, joined in blocks."""
    users = centroid.where(F.col("signal_count") >= least_signals).select("user_id", "centroid")
    pairs = every_pair(vectors_of, users, "id", "user_id")
    return pairs.select("id", "user_id", vectors.percent(F.round(vectors.cosine(F.col("embedding"), F.col("centroid")), 9)).alias("match_pct"))


def nearest(candidates: DataFrame, query: Sequence[float], k: int, *, vector: str = "embedding", unique: str = "id") -> DataFrame:
    """The k candidates nearest by cosine, each task keeping its own k first."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = candidates.withColumn("similarity", vectors.cosine(F.col(vector), q)).where(F.col("similarity").isNotNull())
    return scored.orderBy(F.desc("similarity"), unique).limit(clamp_limit(k))


def lookalikes(rows: DataFrame, *, unique: str, vector: str, group: str, k: int) -> DataFrame:
    """For every row its k nearest others of its group: (id, peer, similarity_pct)."""
    a = rows.select(F.col(unique).alias("id"), group, F.col(vector).alias("_a"))
    b = rows.select(F.col(unique).alias("peer"), group, F.col(vector).alias("_b"))
    scored = a.join(b, group).where("id != peer").select("id", "peer", F.round(vectors.cosine(F.col("_a"), F.col("_b")), 6).alias("similarity"))
    return first_per(scored, ["id"], [F.desc("similarity"), F.col("peer")], k).withColumn("similarity_pct", vectors.percent(F.col("similarity")))


def wanted(sectors: Column, stages: Column, sector: Column, stage_steps: Column) -> Column:
    """Whether a mandate wants a candidate: empty lists want all, an unknown stage passes, an unknown sector doesn't."""
    sector_ok = (F.coalesce(F.size(sectors), F.lit(0)) <= 0) | F.coalesce(F.array_contains(sectors, sector), F.lit(False))
    stage_ok = (F.coalesce(F.size(stages), F.lit(0)) <= 0) | stage_steps.isNull() | F.coalesce(F.arrays_overlap(stages, stage_steps), F.lit(False))
    return sector_ok & stage_ok


def update_due(last_enriched: Column, last_round: Column, last_news: Column, as_of: Column) -> Column:
    """Active companies (a round in 548 days or news in 183) are due after 30 days, quiet ones after 90; new ones never."""
    active = F.coalesce(F.datediff(as_of, last_round) <= 548, F.lit(False)) | F.coalesce(F.datediff(as_of, last_news) <= 183, F.lit(False))
    since = F.datediff(as_of, last_enriched)
    return F.coalesce(F.when(active, since >= 30).otherwise(since >= 90), F.lit(False))
