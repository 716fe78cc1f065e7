"""Which tags of a company a sentence of its pages supports, through an index of words.

A tag's words may be inflected, so they are looked up by their first letters: the index
holds the first 4 to 6 letters of each sentence's words.  A tag is joined by the one of its
words that fewest sentences of the company have; in these its other words are looked for, and
one supports the tag if all its words stand near one occurrence of the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import STOP_WORDS, error_page, sentences

#: Letters of a tag's word that a word must begin with, at most, and words between the first and any other.
STEM, APART = 6, 5
# Paths and hosts of pages that say nothing of a product, sentences that are none of a product, and words
# of technology that a company protects or watches instead of making.
NOT_DESCRIPTIVE = (
    r"(?i)/(?:privacy|privacy-policy|terms|terms-and-conditions|terms-of-use|terms-of-service|tos|cookies?|cookie-policy|legal|impressum|gdpr|dpa|disclaimer|security-policy|glossary|careers?|jobs?|open-positions|help|help_|support"
    r"|docs?|kb|knowledge-base|tutorials?|wiki|faq|sitemap|login|signin|sign-up|unsubscribe)(?:[/_-]|$|\?)|/user-guide/|/help_/"
)
NOT_OF_PRODUCT = (
    r"(?i)^\W*(?:drive|get|unlock|grow|boost|power|accelerate|transform|discover|start|see|learn|join|talk|book|request|enhance|experience)\b|\bcookies?\b|privacy\s+policy|\bwe use cookies|\bwas previously\b"
    r"|\bpreviously\s+(?:served|worked|led|held|was)\b|\bprior to joining\b|\bjoined\s+\w+\s+(?:as|in)\b|\bhis career\b|\bher career\b"
)
ABOUT_PROTECTION = r"(?i)\b(secur|protect|test|monitor|scan|firewall|govern|audit|guard|red.?team)"
PROTECTS = r"^(secur|protect|test|monitor|scan|govern|audit|guard|red|firewall|safeguard|harden)"
PROTECTED = r"^(secur|scanner|scan|firewall|test|monitor|governance|guardrail|safety|red)"


def says_nothing(url: Column) -> Column:
    """Whether a page's address is a policy, help, glossary or career page's."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    return F.coalesce((host != "") & (path.rlike(NOT_DESCRIPTIVE) | host.rlike(r"(?i)^(?:kb|help|support|docs)\.")), F.lit(False))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def stems(tag: Column) -> Column:
    """First letters of a tag's content words, in order, ``general`` left out."""
    bare = F.lower(F.regexp_replace(tag, r"(?i)\bgeneral\b", ""))
    words = F.regexp_extract_all(bare, F.lit(r"\p{L}{4,}"), F.lit(0))
    return F.transform(F.filter(words, lambda w: ~w.isin(STOP_WORDS)), lambda w: F.substr(w, F.lit(1), F.lit(STEM)))


def _protected(tag: Column, first: Column, words: Column) -> Column:
    """Whether a sentence puts the tag's first word after a verb of protection, or before what protects."""
    short = F.substr(first, F.lit(1), F.lit(5))
    at = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.startswith(F.element_at(words, i), short))
    before = lambda i: F.exists(F.slice(words, F.greatest(F.lit(1), i - 4), F.least(F.lit(4), i - 1)), lambda w: w.rlike(PROTECTS))
    after = lambda i: F.exists(F.slice(words, i + 1, 2), lambda w: w.rlike(PROTECTED))
    return ~tag.rlike(ABOUT_PROTECTION) & F.exists(at, lambda i: before(i) | after(i))


def supported_tags(pages: DataFrame, tags: DataFrame) -> DataFrame:
    """(company, tag, page, quote, kept) of every distinct tag of a company: the first sentence that carries it, if any.

    pages: company, page (the order of a company's pages), url, text; tags: company, tag.
    The sides of a slash are alternatives, the first that is carried counts.  A
    tag that no sentence carries, or only one that isn't of a product, isn't kept.  Pages
    that say nothing, error pages and null texts carry nothing.
    """
    asked = tags.select("company", "tag").distinct().withColumn("tag_id", F.xxhash64("company", "tag"))
    sides = F.filter(F.transform(F.split("tag", "/"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike("(?i)^general$"))
    sides = F.when(F.size(sides) > 1, sides).otherwise(F.array("tag"))
    wanted = asked.select("company", "tag", "tag_id", F.posexplode(sides).alias("side", "words")).withColumn("stems", stems(F.col("words"))).where(F.size("stems") > 0)
    each = wanted.select("company", "tag_id", "side", F.explode(F.array_distinct("stems")).alias("stem"))

    told = pages.where(~says_nothing(F.col("url")) | F.col("url").isNull()).where(~error_page(F.col("text")))
    told = told.select("company", "page", F.posexplode(sentences(F.col("text"))).alias("turn", "quote")).withColumn("w", _words(F.col("quote")))
    begun = F.flatten(F.transform("w", lambda x: F.transform(F.sequence(F.lit(4), F.lit(STEM)), lambda n: F.substr(x, F.lit(1), n))))
    index = told.select("company", "page", "turn", F.explode(F.array_distinct(F.filter(begun, lambda x: F.length(x) >= 4))).alias("stem"))
    counts = index.groupBy("company", "stem").agg(F.count("*").alias("n"))
    rarest = each.join(counts.hint("merge"), ["company", "stem"], "left").groupBy("company", "tag_id", "side").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "stem")).alias("least")).where("least.n > 0")
    held = index.join(rarest.select("company", F.col("least.stem").alias("stem"), "tag_id", "side").hint("merge"), ["company", "stem"]).join(wanted.select("tag_id", "side", "words", "stems"), ["tag_id", "side"])
    met = held.drop("stem").join(told.select("company", "page", "turn", "quote", "w").hint("merge"), ["company", "page", "turn"])
    spots = F.transform("stems", lambda s: F.filter(F.transform("w", lambda x, i: F.when(F.startswith(x, s), i)), F.isnotnull))
    near = F.exists(F.element_at("found", 1), lambda p: F.forall("found", lambda f: F.exists(f, lambda x: F.abs(x - p) <= APART)))
    tight = met.where(F.forall("stems", lambda s: F.exists("w", lambda x: F.startswith(x, s)))).withColumn("found", spots).where(near)
    carried = tight.where(~_protected(F.col("words"), F.element_at("stems", 1), F.col("w")))
    first = carried.groupBy("tag_id").agg(F.min(F.struct("side", "page", "turn", "quote")).alias("hit"))
    out = asked.join(first, "tag_id", "left")
    return out.select("company", "tag", F.col("hit.page").alias("page"), F.col("hit.quote").alias("quote"), F.coalesce(~F.col("hit.quote").rlike(NOT_OF_PRODUCT), F.lit(False)).alias("kept"))
