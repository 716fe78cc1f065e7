"""URL filters: hashed host-suffix and path-prefix expressions.

Every URL is expanded into the expressions that a rule could be written as (a
suffix of the host at a label boundary, joined to a prefix of the path).  The
expansion is limited to the (label count, path length) pairs that occur among
the rules, which loses no rule and keeps the expansion of a URL small; pairs are
bounded by the labels of a host (127) times the path lengths in use.  The
expressions meet the rules in an equi-join on a short hash prefix; the full
digest then confirms the match, and the longest rule wins.

Only DataFrame functions run here; there is no Python on the executors.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import settle, spread_join

#: Hex digits of the SHA-256 digest that the join compares first.
PREFIX_HEX = 8
#: A rule set of at most this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_RULES = 100_000
#: Verdict of a URL that no rule fits.
DEFAULT_VERDICT = "allow"


def split_url(url):
    """(host, path) columns of a URL column.

    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z
    lower-cased.  Path: from there up to ``?``, ``#`` or the end.  A null URL or
    one without ``://`` has an empty host and path.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def _prepared_rules(rules: DataFrame) -> DataFrame:
    """Distinct rules with digest and shape; a rule given as both is a block."""
    rule = F.concat("host", "path")
    return (
        rules.where(F.col("host").isNotNull() & (F.col("host") != "") & F.col("verdict").isNotNull())
        .select(
            F.translate("host", string.ascii_uppercase, string.ascii_lowercase).alias("host"),
            F.coalesce("path", F.lit("")).alias("path"),
            "verdict",
        )
        .groupBy("host", "path")
        .agg(F.max(F.when(F.col("verdict") == "block", 1).otherwise(0)).alias("blocks"), F.min("verdict").alias("verdict"))
        .select(
            rule.alias("rule"),
            F.when(F.col("blocks") == 1, "block").otherwise(F.col("verdict")).alias("rule_verdict"),
            F.length("host").alias("rule_host_length"),
            F.sha2(rule, 256).alias("rule_digest"),
            F.size(F.split("host", r"\.")).alias("labels"),
            F.length("path").alias("path_length"),
        )
        .withColumn("prefix", F.substring("rule_digest", 1, PREFIX_HEX))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, *, url_column: str = "url") -> DataFrame:
    """All columns of ``pages`` plus url_host, url_path, rule and verdict.

    ``rules`` has host, path and verdict (``allow`` or ``block``).  A rule fits
    its host and all its subdomains where the URL's path starts with the rule's.
    The longest rule (host and path together) wins; of equally long ones that
    with the longer host, then the later by code point.  Where no rule fits, the
    rule is null and the verdict ``allow``.  Repeated rows stay repeated, an
    empty table gives an empty one; rules without host or verdict are ignored.
    Columns of ``pages`` named like the four new ones are replaced.
    """
    known = _prepared_rules(rules)
    shapes = known.select("labels", "path_length").distinct().collect()
    kept = [c for c in pages.columns if c not in ("url_host", "url_path", "rule", "verdict")]
    host, path = split_url(pages[url_column])
    urls = pages.select(F.struct(*[pages[c] for c in kept]).alias("row"), host.alias("url_host"), path.alias("url_path"))  # no column of theirs stands beside ours
    whole = [F.col("row").getField(c).alias(c) for c in kept]
    if not shapes:
        return urls.select(*whole, "url_host", "url_path", F.lit(None).cast("string").alias("rule"), F.lit(DEFAULT_VERDICT).alias("verdict"))

    labels = F.size(F.split("url_host", r"\."))
    pairs = F.array(*[F.struct(F.lit(int(a)).alias("k"), F.lit(int(b)).alias("m")) for a, b in sorted(map(tuple, shapes))])
    expressions = F.transform(
        F.filter(pairs, lambda p: (labels >= p["k"]) & (F.length("url_path") >= p["m"])),
        lambda p: F.concat(
            F.array_join(F.slice(F.split("url_host", r"\."), -p["k"], p["k"]), "."),
            F.substr(F.col("url_path"), F.lit(1), p["m"]),
        ),
    )
    counted = settle(urls.groupBy("url_host", "url_path").agg(F.count("*").alias("n")), "urls")
    keys = (
        counted.where(F.col("url_host") != "")
        .select("url_host", "url_path", F.explode(F.array_distinct(expressions)).alias("expression"))
        .withColumn("digest", F.sha2("expression", 256))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    )
    if known.count() <= BROADCAST_RULES:
        known = F.broadcast(known)
    best = (
        keys.join(known.drop("labels", "path_length"), "prefix")
        .where((F.col("digest") == F.col("rule_digest")) & (F.col("expression") == F.col("rule")))
        .groupBy("url_host", "url_path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), "rule_host_length", "rule", "rule_verdict")).alias("best"))
        .select("url_host", "url_path", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("rule_verdict"))
    )
    site = F.struct("url_host", "url_path")
    facts = counted.join(best, ["url_host", "url_path"], "left").select(site.alias("site"), "n", "rule", "rule_verdict")
    joined = spread_join(urls.withColumn("site", site), settle(facts, "judged-urls"), "site", *[F.col("row").getField(c) for c in kept if c != url_column][:1])
    return joined.select(*whole, "url_host", "url_path", "rule", F.coalesce("rule_verdict", F.lit(DEFAULT_VERDICT)).alias("verdict"))
