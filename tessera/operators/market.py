"""Market lists: predicates over places and peers, opt-outs, patterns, totals, schedules, queues and pools."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import web


def in_country(wanted: Column, country: Column, founded_in: Column, offices: Column) -> Column:
    """Whether a company has a country as its seat, as where it was founded, or among its offices."""
    v = F.lower(wanted)
    return (F.lower(F.coalesce(country, F.lit(""))) == v) | (F.lower(F.coalesce(founded_in, F.lit(""))) == v) | F.coalesce(F.exists(offices, lambda o: F.lower(o) == v), F.lit(False))


def has_momentum(recent_round: Column, trend: Column) -> Column:
    return F.coalesce(recent_round & trend.isin("rapid growth", "moderate growth"), F.lit(False))


def density(peers: Column, valid: Column) -> Column:
    """crowded from four peers, blue-ocean up to two, else null; null where the number isn't valid."""
    return F.when(valid & (peers >= 4), "crowded").when(valid & (peers <= 2), "blue-ocean")


def enriched(enriched_at: Column, completeness: Column, description: Column) -> Column:
    return enriched_at.isNotNull() | ((completeness >= 7) & (F.trim(F.coalesce(description, F.lit(""))) != ""))


def opted_out(boards: DataFrame, optouts: DataFrame, unique: str) -> DataFrame:
    """Distinct ``unique`` of the boards (company_id, provider, token, website) that an opt-out covers.

    By company, by provider and token, or by a domain that the website is or is
    under; three equi-joins, the last over the suffixes of the host.
    """
    by_company = boards.join(optouts.select("company_id").where("company_id is not null").distinct(), "company_id", "left_semi").select(unique)
    by_board = boards.join(optouts.select("provider", "token").where("provider is not null").distinct(), ["provider", "token"], "left_semi").select(unique)
    labels = F.split(web.site_host(F.col("website")), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda k: F.array_join(F.slice(F.col("labels"), -k, k), "."))
    hosts = boards.select(unique, labels.alias("labels")).where("labels is not null").select(unique, F.explode(suffixes).alias("domain"))
    by_domain = hosts.join(optouts.select("domain").where("domain is not null").distinct(), "domain", "left_semi").select(unique)
    return by_company.unionByName(by_board).unionByName(by_domain).distinct()


def word_pattern_matches(df: DataFrame, unique: str, words: Column, patterns: DataFrame) -> DataFrame:
    """(unique, pattern) where a text of blank-separated words holds a pattern of whole words.

    An equi-join of the text's runs of words with the patterns, for the numbers
    of words that patterns have (few), instead of a regular expression per pair.
    """
    sized = patterns.select("pattern", F.size(F.split("pattern", " ")).alias("k"))
    sizes = sorted(r[0] for r in sized.select("k").distinct().collect())  # one number for each length of pattern
    split = df.select(unique, F.split(words, " ").alias("w"))
    none = F.array().cast("array<string>")

    def runs(k: int) -> Column:
        return F.when(F.size("w") >= k, F.transform(F.sequence(F.lit(1), F.size("w") - (k - 1)), lambda i: F.array_join(F.slice("w", i, k), " "))).otherwise(none)

    every = F.concat(none, *map(runs, sizes))
    return split.select(unique, F.explode(F.array_distinct(every)).alias("pattern")).join(patterns.select("pattern").distinct(), "pattern").select(unique, "pattern")


def zero_filled(wanted: DataFrame, counted: DataFrame, key: str) -> DataFrame:
    """(key, n) of every wanted key: its rows in ``counted``, 0 where there are none."""
    n = counted.groupBy(key).agg(F.count("*").alias("n"))
    return wanted.select(key).distinct().join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def counts_map(df: DataFrame, keys: Sequence[str], status: str) -> DataFrame:
    """keys and a map of status to its number of rows."""
    per = df.groupBy(*keys, status).agg(F.count("*").alias("n"))
    entries = F.sort_array(F.collect_list(F.struct(F.col(status).alias("key"), F.col("n").alias("value"))))
    return per.groupBy(*keys).agg(F.map_from_entries(entries).alias("counts"))


def capital_totals(rounds: DataFrame, key: str, kind: str, amount: str) -> DataFrame:
    """equity and debt raised by ``key``; null where no such amount is known."""
    return rounds.groupBy(key).agg(F.sum(F.when(F.col(kind) == "equity", F.col(amount))).alias("equity"), F.sum(F.when(F.col(kind) == "debt", F.col(amount))).alias("debt"))


def investor_schedule(rounds: DataFrame) -> DataFrame:
    """company_id, key, rounds, is_lead, total, place of the investors of each company.

    rounds: company_id, round_id, lead, others, amounts (array of name, amount).
    A name counts once a round; ``total`` sums the amounts that are disclosed and
    is null without any.  Leads come first, then greater totals, then names.
    """
    clean = F.filter(F.transform(F.concat(F.array("lead"), F.coalesce("others", F.array().cast("array<string>"))), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    each = rounds.select("company_id", "round_id", F.lower(F.trim("lead")).alias("led_by"), "amounts", F.explode(F.array_distinct(clean)).alias("key"))
    own = F.filter("amounts", lambda a: F.lower(F.trim(a["name"])) == F.col("key"))
    amount = F.try_element_at(own, F.lit(-1))["amount"]
    per = each.groupBy("company_id", "key").agg(F.count("*").alias("rounds"), F.bool_or(F.coalesce(F.col("key") == F.col("led_by"), F.lit(False))).alias("is_lead"), F.sum(amount).alias("total"))
    order = W.partitionBy("company_id").orderBy(F.desc("is_lead"), F.desc_nulls_last("total"), "key")
    return per.withColumn("place", F.row_number().over(order))


def source_states(runs: DataFrame, expected: DataFrame, as_of: Column) -> DataFrame:
    """source, runs_7d, errors_7d, last_ok, hours, ok of every expected source (source, max_hours).

    runs: source, at, status.  A source is ok where its last good run is no older than it may be.
    """
    week = F.col("at") > as_of - F.expr("INTERVAL 7 DAYS")
    per = runs.groupBy("source").agg(
        F.count(F.when(week, 1)).alias("runs_7d"), F.count(F.when(week & (F.col("status") == "error"), 1)).alias("errors_7d"), F.max(F.when(F.col("status") == "ok", F.col("at"))).alias("last_ok")
    )
    hours = (F.unix_timestamp(as_of) - F.unix_timestamp("last_ok")) / 3600.0
    joined = expected.join(per, "source", "left").withColumn("hours", F.floor(hours))
    return joined.select("source", F.coalesce("runs_7d", F.lit(0)).alias("runs_7d"), F.coalesce("errors_7d", F.lit(0)).alias("errors_7d"), "last_ok", "hours", F.coalesce(hours <= F.col("max_hours"), F.lit(False)).alias("ok"))


def business_days(spark, as_of: str, n: int) -> DataFrame:
    """day: the Mondays to Fridays of the ``n`` days before a date."""
    days = spark.range(1, n + 1).select(F.date_sub(F.lit(as_of).cast("date"), F.col("id").cast("int")).alias("day"))
    return days.where(F.weekday("day") < 5)


def days_to_do(recent: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct days still to be read: recent ones that aren't done, and older ones left open (day, status)."""
    done = known.where(F.col("status").isin("complete", "no_index")).select("day")
    left = known.where(F.col("status").isin("pending", "waiting", "in_progress")).select("day")
    return recent.select("day").join(done, "day", "left_anti").unionByName(left).distinct()


def archived(df: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, archive): rows for which ``gone`` holds move to the archive; unknown stays."""
    leaves = F.coalesce(gone, F.lit(False))
    return df.where(~leaves), df.where(leaves)


def top_of_kinds(kinds: dict[str, tuple[DataFrame, str]], score: str, k: int) -> DataFrame:
    """kind, id, score: the best ``k`` over all kinds, taken from the best ``k`` of each."""
    parts = [df.select(F.lit(kind).alias("kind"), F.col(unique).cast("long").alias("id"), F.col(score).alias("score")).orderBy(F.desc("score"), "id").limit(k) for kind, (df, unique) in kinds.items()]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.orderBy(F.desc("score"), "kind", "id").limit(k)


def append_new(old: Column, new: Column, most: int) -> Column:
    """An array with what is new of another one at its end, ``most`` entries at most; what is there stays."""
    held = F.coalesce(old, F.array().cast("array<string>"))
    fresh = F.array_except(F.coalesce(new, F.array().cast("array<string>")), held)
    return F.slice(F.concat(held, fresh), 1, F.greatest(F.lit(most), F.size(held)))


def identifiers_of(sources: dict[str, tuple[DataFrame, str, Column, float]]) -> DataFrame:
    """entity_id, kind, value, confidence: values of each kind (rows, id, value, confidence); of repeats the most certain."""
    parts = [df.select(F.col(unique).alias("entity_id"), F.lit(kind).alias("kind"), value.cast("string").alias("value"), F.lit(sure).alias("confidence")) for kind, (df, unique, value, sure) in sources.items()]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.where("value is not null and value != ''").groupBy("entity_id", "kind", "value").agg(F.max("confidence").alias("confidence"))


def first_of_each(rows: DataFrame, site: str, name: str, order: Sequence[Column]) -> DataFrame:
    """One row for each site, or for each name where a row has no site."""
    key = F.coalesce(F.concat(F.lit("site:"), F.col(site)), F.concat(F.lit("name:"), F.lower(F.trim(F.col(name)))))
    ranked = rows.withColumn("_key", key).withColumn("_n", F.row_number().over(W.partitionBy("_key").orderBy(*order)))
    return ranked.where("_n = 1 and _key is not null").drop("_key", "_n")


def candidate_tiers(pool: DataFrame, flags: Sequence[str], gain: str, *, queue: int, watch: int) -> DataFrame:
    """Rows with ``tier``: queue or watch by their gain where all flags hold, else null; and their rank in their domain."""
    good = F.lit(True)
    for f in flags:
        good = good & F.coalesce(F.col(f), F.lit(False))
    more = F.coalesce(F.col(gain), F.lit(0))
    rank = F.row_number().over(W.partitionBy("domain").orderBy(F.desc_nulls_last("stars"), "id"))
    return pool.withColumn("tier", F.when(good & (more >= queue), "queue").when(good & (more >= watch), "watch")).withColumn("rank_in_domain", rank)


def merged_people(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, name, role, has_exit, background of both sides: what is there stays, gaps are filled, flags are or-ed, lists united.

    Names are compared in lower case with blanks collapsed; incoming rows without
    a name are dropped, existing ones kept.
    """
    form = F.nullif(F.lower(F.regexp_replace(F.trim("name"), r"\s+", " ")), F.lit(""))
    a = old.select(key, form.alias("_form"), F.struct("name", "role", "has_exit", "background").alias("_a"))
    b = new.select(key, form.alias("_form"), F.struct("name", "role", "has_exit", "background").alias("_b")).where("_form is not null")
    both = a.join(b, [key, "_form"], "full")
    none = F.array().cast("array<string>")
    return both.select(
        key,
        F.coalesce("_a.name", "_b.name").alias("name"),
        F.coalesce("_a.role", "_b.role").alias("role"),
        (F.coalesce("_a.has_exit", F.lit(False)) | F.coalesce("_b.has_exit", F.lit(False))).alias("has_exit"),
        F.array_sort(F.array_union(F.coalesce("_a.background", none), F.coalesce("_b.background", none))).alias("background"),
    )


def retired(people: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """People (key, name, role) with ``Former`` before the role of whoever a newcomer of that role replaces.

    named: key, name, role, appointed; only a text that says so replaces anyone,
    and never a person of the same name.
    """
    office = F.upper(F.regexp_extract("role", r"(?i)\b(c[a-z]o|chief \w+ officer)\b", 1))
    now = named.where("appointed").select(key, office.alias("_office"), F.lower(F.trim("name")).alias("_new")).where("_office != ''").groupBy(key, "_office").agg(F.min("_new").alias("_new"))
    joined = people.withColumn("_office", office).join(now, [key, "_office"], "left")
    out = F.col("_new").isNotNull() & (F.lower(F.trim("name")) != F.col("_new")) & ~F.startswith("role", F.lit("Former "))
    return joined.select(key, "name", F.when(out, F.concat(F.lit("Former "), "role")).otherwise(F.col("role")).alias("role"))


def accuracy_to_date(rounds: DataFrame, order: str) -> DataFrame:
    """order, marked, correct and the share correct of everything marked so far."""
    run = W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    per = rounds.groupBy(order).agg(F.count("*").alias("marked"), F.count(F.when(F.col("mark") == "correct", 1)).alias("correct"))
    return per.select(order, "marked", "correct", F.round(F.sum("correct").over(run) / F.sum("marked").over(run), 4).alias("share_to_date"))


def failed_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check, rows, failed of each named condition, which fails where it is false or unknown."""
    tall = df.select(F.explode(F.array(*[F.struct(F.lit(name).alias("check"), F.coalesce(c, F.lit(False)).alias("good")) for name, c in checks.items()])).alias("c"))
    return tall.groupBy("c.check").agg(F.count("*").alias("rows"), F.count(F.when(~F.col("c.good"), 1)).alias("failed"))
