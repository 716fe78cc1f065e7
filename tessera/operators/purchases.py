"""Purchases of companies as events: what articles claim, and the reports of one purchase put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.names import ACCENTED, PLAIN
from tessera.functions.reports import acquirer_in, buyer_key, majority_stake
from tessera.operators.resolve import shared_checkpoints

# Letters from which one buyer's name may be found within another, and days between reports.
LEAST_LETTERS, STAKE_DAYS, SAME_STATEMENT, MENTION_DAYS = 4, 120, 14, 10
#: Sentences of an article that are read, and characters that one has.
SENTENCES, SHORTEST, LONGEST = 400, 20, 400


def plain_words(text: Column) -> Column:
    """Lower-case letters and digits without marks, other signs as one blank."""
    bare = F.translate(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[̀-ͯ]", ""), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def article_claims(articles: DataFrame) -> DataFrame:
    """(company, seq, url, day, acquirer, majority, quote): the first statement of each article that its company was bought.

    articles: company, seq, url, title, content, day.  The title comes first, then
    SENTENCES sentences; one of SHORTEST characters or fewer, or LONGEST or more, is none.
    """
    told = F.concat(F.array(F.coalesce("title", F.lit(""))), F.slice(F.split(F.coalesce("content", F.lit("")), r"(?<=[.!?])\s+|\n+"), 1, SENTENCES))
    each = articles.select("company", "seq", "url", "day", F.posexplode(F.transform(told, lambda x: F.trim(x))).alias("at", "quote"))
    fit = each.where((F.length("quote") > SHORTEST) & (F.length("quote") < LONGEST) & F.contains(F.lower("quote"), F.lower(F.regexp_replace(F.trim("company"), r"\s+", " "))))
    # a filter on the buyer would have it read once more
    read = fit.select("*", acquirer_in(F.col("quote"), F.col("company")).alias("acquirer"))
    first = read.groupBy("company", "seq").agg(F.min(F.when(F.col("acquirer").isNotNull(), F.struct("at", "url", "day", "acquirer", "quote"))).alias("h")).where("h IS NOT NULL")
    return first.select("company", "seq", "h.url", "h.day", "h.acquirer", majority_stake(F.col("h.quote")).alias("majority"), "h.quote")


def acquisitions(articles: DataFrame) -> DataFrame:
    """One row per bought company: status, acquirer, quote, url, day of its purchase's first report.

    Of a company's claims the newest full purchase counts, else the newest stake; a
    stake that the same buyer is said to have taken within SAME_STATEMENT days makes it a
    stake.  It is dated by the first report of the same buyer and kind (of any kind within
    STAKE_DAYS).  Ties go by ``seq``.  Companies without a claim have no row.
    """
    shared_checkpoints(articles.sparkSession.sparkContext)
    claims = article_claims(articles).withColumn("buyer", buyer_key(F.col("acquirer"))).checkpoint()
    held = F.struct("seq", "url", "day", "acquirer", "majority", "quote", "buyer")
    newest = F.max(F.struct(~F.col("majority"), F.col("day").isNotNull(), "day", -F.col("seq"), held.alias("c")))
    picks = claims.groupBy("company").agg(newest["c"].alias("pick"))
    met = claims.join(picks.hint("merge"), "company").where(F.col("buyer") == F.col("pick.buyer")).withColumn("gap", F.abs(F.datediff("day", F.col("pick.day"))))
    stake = F.max(~F.col("pick.majority") & F.col("majority") & (F.col("gap") <= SAME_STATEMENT))
    stakes = met.groupBy("company").agg(F.coalesce(stake, F.lit(False)).alias("stake"))
    met = met.join(stakes.hint("merge"), "company")
    status = F.col("stake") | F.col("pick.majority")
    same = F.col("day").isNotNull() & ((F.col("majority") == status) | F.col("pick.day").isNull() | (F.col("gap") <= STAKE_DAYS))
    firsts = met.groupBy("company").agg(F.min(F.when(same, F.struct("day", -F.col("seq"), held.alias("c"))))["c"].alias("first"), F.first("stake").alias("stake"), F.first("pick").alias("pick"))
    shown = F.coalesce("first", "pick")
    return firsts.select("company", F.when(F.col("stake") | shown["majority"], "majority_acquired").otherwise("acquired").alias("status"), *[shown[c].alias(c) for c in ("acquirer", "quote", "url", "day")])


def buyer_groups(keys: DataFrame) -> DataFrame:
    """(company, key, group) of distinct buyer keys (company, key, place): a key joins the shortest that stands within it.

    A group's key has no other within it, so which key leads doesn't depend on the
    order of joining: of the company's keys within one (and itself) the shortest leads,
    which has none within, then the first by ``place``.  Keys recur from company to
    company, so which stand within which is found once over the distinct keys, by
    joining all their substrings of LEAST_LETTERS letters or more by equality.
    """
    n = F.length("key")
    # every start, and every length from there on
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), n - LEAST_LETTERS + 1), lambda i: F.transform(F.sequence(F.lit(LEAST_LETTERS), n - i + 1), lambda m: F.substr("key", i, m))))
    names = keys.where(n >= LEAST_LETTERS).select("key").distinct()
    within = names.select(F.col("key").alias("long"), F.explode(F.array_distinct(cuts)).alias("key")).where("key <> long").join(names.hint("merge"), "key")
    led = keys.select("company", F.col("key").alias("long")).join(within, "long").join(keys.hint("merge"), ["company", "key"])
    own = keys.select("company", F.col("key").alias("long"), "key", "place")
    every = own.unionByName(led.select("company", "long", "key", "place"))
    leads = every.groupBy("company", "long").agg(F.min(F.struct(n.alias("n"), "place", "key")).alias("g"))
    return leads.select("company", F.col("long").alias("key"), F.col("g.key").alias("group"))


def purchase_events(items: DataFrame) -> DataFrame:
    """One row per purchase: company, buyer (its shortest spelling), majority, members, and the report that stands for it (seq, url, day).

    items: company, seq, url, title, day, eligible (may be written), party (of the company,
    the buyer or a wire), by_code (its day was read from a page's code).  Reports are
    titles that name the buyer, and titles that name company and buyer within MENTION_DAYS
    of the first.  Stakes and full purchases are one event within STAKE_DAYS of the first
    report.  A party's report stands first, then one whose day isn't by code, then the
    earliest, one that names the purchase, the least address.  Undated items count
    for nothing; an event without an eligible report has no row.
    """
    shared_checkpoints(items.sparkSession.sparkContext)
    dated = items.where("day IS NOT NULL").withColumn("acquirer", acquirer_in(F.col("title"), F.col("company")))
    keyed = dated.withColumn("key", buyer_key(F.col("acquirer"))).withColumn("majority", majority_stake(F.col("title"))).withColumn("title", F.when(F.col("acquirer").isNull(), F.col("title")))
    keyed = keyed.select("company", "seq", "url", "title", "day", "eligible", "party", "by_code", "acquirer", "key", "majority").checkpoint()  # titles are read once
    hits = keyed.where("acquirer IS NOT NULL")
    order = [F.length("key").alias("n"), F.col("seq")]
    keys = hits.groupBy("company", "key").agg(
        F.min("seq").alias("place"), F.min(F.struct("day", *order, "majority")).alias("first"), F.min(F.struct(F.length("acquirer").alias("size"), *order, "acquirer")).alias("short"),
    ).checkpoint()
    grouped = keys.join(buyer_groups(keys.select("company", "key", "place")).hint("merge"), ["company", "key"])
    facts = grouped.groupBy("company", "group").agg(F.min("first").alias("first"), F.min("short")["acquirer"].alias("buyer"))
    facts = facts.select("company", "group", F.col("first.day").alias("first_day"), F.col("first.majority").alias("first_majority"), "buyer")
    known = grouped.select("company", "key", "group").join(facts.hint("merge"), ["company", "group"])
    members = hits.join(known.hint("merge"), ["company", "key"]).where((F.col("majority") == F.col("first_majority")) | (F.datediff("day", "first_day") <= STAKE_DAYS)).withColumn("hit", F.lit(True))
    # who only mentions both meets the events of its company in cells of MENTION_DAYS days
    cell = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / MENTION_DAYS)
    first_word = lambda text: F.split_part(plain_words(text), F.lit(" "), F.lit(1))
    near = facts.withColumn("word", first_word(F.col("buyer"))).where(F.length("word") >= LEAST_LETTERS).withColumn("cell", F.explode(F.array(*[cell(F.col("first_day")) + i for i in (-1, 0, 1)])))
    others = keyed.where("acquirer IS NULL").withColumn("plain", plain_words(F.col("title"))).where(F.contains("plain", first_word(F.col("company")))).withColumn("cell", cell(F.col("day")))
    others = others.join(near.hint("merge"), ["company", "cell"]).drop("cell")
    others = others.where((F.abs(F.datediff("day", "first_day")) <= MENTION_DAYS) & F.contains("plain", "word")).withColumn("hit", F.lit(False))
    cols = ["company", "group", "buyer", "seq", "url", "day", "eligible", "party", "by_code", "majority", "hit"]
    every = members.select(*cols).unionByName(others.select(*cols))
    best = F.min(F.when(F.col("eligible"), F.struct(~F.col("party"), F.col("by_code"), "day", ~F.col("hit"), "url", "seq"))).alias("rep")
    events = every.groupBy("company", "group", "buyer").agg(F.max(F.col("majority") & F.col("hit")).alias("majority"), F.count("*").alias("members"), best)
    return events.where("rep IS NOT NULL").select("company", "buyer", "majority", "members", "rep.seq", "rep.url", "rep.day")


def standing_purchase(events: DataFrame) -> DataFrame:
    """Of a company's events the newest full purchase, else the newest stake."""
    newest = W.partitionBy("company").orderBy("majority", F.desc("day"), "url")
    return events.withColumn("_turn", F.row_number().over(newest)).where("_turn = 1").drop("_turn")
