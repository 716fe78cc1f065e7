"""Sentences, words, quotes and vectors of words as column expressions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that carry no content.
STOP_WORDS = "that this with from their which have been into also more than such about company platform provides helps uses using".split()
# What a page says that is an error or a challenge instead of content.
ERRORS = (
    r"(?i)Target URL returned error \d{3}|^\s*(?:403|404|429|503)\b[^\n]{0,40}(?:forbidden|not found|too many requests|unavailable)|Access Denied|nothing was found at this location|page not found|404 not found|error 404"
    r"|this page (?:could not|cannot|can['’]t) be found|the page you (?:are looking for|requested|were looking for)[^.]{0,40}(?:not|no longer)|Please be advised that this page is unavailable|Just a moment\.\.\.|Attention Required! \| Cloudflare"
)
# Words that a headline doesn't end in, and those after which a word in -ing isn't its end.
DANGLING = "and or of to for the with".split()
ENDING_BLANKS, END_CHARS = " \t\n\x0b\f\r\x85\u2028\u2029", 200
FUNCTION_ENDS = "and or but of to for the an in on at by with from into as is are was were be been has have had will can that which its their this these than about after over under".split()
AUXILIARIES = "is are was were be been being has have had will can could would should may might must now also still just already finally".split()
# Words of a site's or a section's name.
SITE_WORDS = "blog news newsroom press wire times post journal magazine insights updates media".split()


def match_form(text: Column) -> Column:
    """Lower case, quotes dropped, hyphens and other signs to blanks (not ``.``, ``$``, ``%``), blanks collapsed."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "['’\"“”]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(bare, F.lit("-"), F.lit(" ")), r"[^\p{L}\p{N}\s.$%]", " "), r"\s+", " "))


#: Where a sentence ends: a stop, blanks, then a capital, a digit or a quotation mark.
SENTENCE_END = r'(?<=[.!?])\s+(?=[A-Z0-9"“])'


def sentences(text: Column, least: int = 25, most: int = 400) -> Column:
    """Distinct sentences of 25 to 400 characters: of the running text, then line by line; ``#`` before a heading goes."""
    cut = lambda x: F.split(F.regexp_replace(x, r"\s+", " "), SENTENCE_END)
    every = F.concat(cut(text), F.flatten(F.transform(F.split(text, r"\n+"), cut)))
    bare = F.transform(every, lambda x: F.regexp_replace(F.trim(x), r"^#+\s*", ""))
    return F.array_distinct(F.filter(bare, lambda x: F.length(x).between(least, most)))


def content_words(text: Column) -> Column:
    """Distinct words of four letters or more that aren't stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}{4,}"), F.lit(0))
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, STOP_WORDS)))


def contains_quote(quote: Column, source: Column) -> Column:
    """Whether the source holds the quote word for word, forms aside."""
    form = match_form(quote)
    return (form != "") & F.contains(match_form(source), form)


def best_window(quote: str, source: str) -> float:
    """Highest Dice of word pairs between a quote and any stretch of the source as long; counts slide along."""
    q, s = quote.split(), source.split()
    if not q or not s:
        return 0.0
    n = min(len(q), len(s))
    pairs = (lambda words: list(zip(words, words[1:]))) if n > 1 else list
    own, every = set(pairs(q) if len(q) > 1 else q), pairs(s)
    width = max(1, n - 1)
    held: dict = {}
    shared, best = 0, 0.0
    for i, new in enumerate(every):
        held[new] = held.get(new, 0) + 1
        shared += held[new] == 1 and new in own
        if i >= width:
            old = every[i - width]
            held[old] -= 1
            if not held[old]:
                del held[old]
                shared -= old in own
        if i >= width - 1:
            best = max(best, 2 * shared / (len(own) + len(held)))
            if best == 1.0:
                break
    return best


def passage_hashes(n: int, wanted=None):
    """For mapInArrow over (id, hashes of a text's words): (id, hash) of each distinct passage of ``n`` words, or of those in ``wanted``.

    A passage's hash is the sum of its words' hashes times the powers of an odd number, modulo 2 ** 64.
    """
    powers = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(n)], np.uint64)
    schema = pa.schema([("id", pa.int64()), ("hash", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if wanted is None else np.array(wanted.value, np.int64)
        for batch in batches:
            lists = batch.column(1)
            words, ends, ids = np.asarray(lists.values).view(np.uint64), np.asarray(lists.offsets), batch.column(0).to_pylist()
            if len(words) < n:
                continue
            hashes = sum(words[k : len(words) - n + 1 + k] * powers[k] for k in range(n)).view(np.int64)
            inside = np.zeros(len(hashes), bool) if known is not None else np.ones(len(hashes), bool)
            if known is not None and len(known):
                at = np.searchsorted(known, hashes)
                inside = known[np.minimum(at, len(known) - 1)] == hashes
            out_ids, out = [], []
            for i, unique in enumerate(ids):
                low, high = int(ends[i]), int(ends[i + 1]) - n + 1
                found = np.unique(hashes[low:high][inside[low:high]]) if high > low else ()
                out_ids += [unique] * len(found)
                out.append(found)
            yield pa.record_batch([pa.array(out_ids, pa.int64()), pa.array(np.concatenate(out).astype(np.int64) if out else [], pa.int64())], schema=schema)

    return read


#: Pairs of all quotes that are sent to every task, in bytes at most.
PAIR_BYTES = 64 << 20


def _near_pairs(own: DataFrame, sizes: DataFrame, held: DataFrame, unique: str, enough: float) -> DataFrame:
    """(item_id, unique) of texts that share enough pairs with a quote, counted within each text, the quotes' pairs known to every task."""
    quotes = own.collect()
    least = {r["item_id"]: min(math.ceil(r["n"] * (enough / (2 - enough)) - 1e-9), r["n"] - 2) for r in sizes.collect()}
    by_pair: dict[int, list[int]] = {}
    for item, pair in quotes:
        by_pair.setdefault(pair, []).append(item)
    sent = own.sparkSession.sparkContext.broadcast((by_pair, least))
    schema = pa.schema([("item_id", pa.int64()), (unique, pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_pair, least = sent.value
        known = np.array(sorted(by_pair), np.int64)
        always = [item for item, n in least.items() if n <= 0]
        for batch in batches:
            lists, found, texts = batch.column(1), [], []
            ends, values = np.asarray(lists.offsets), np.asarray(lists.values)
            for i, doc in enumerate(batch.column(0).to_pylist()):
                mine = values[ends[i] : ends[i + 1]]
                at = np.minimum(np.searchsorted(known, mine), max(len(known) - 1, 0))
                hits = np.unique(mine[known[at] == mine]) if len(known) and len(mine) else ()
                shared: dict[int, int] = {}
                for pair in map(int, hits):
                    for item in by_pair[pair]:
                        shared[item] = shared.get(item, 0) + 1
                items = {item for item, n in shared.items() if n >= least[item]} | (set(always) & set(shared))
                found += items
                texts += [doc] * len(items)
            yield pa.record_batch([pa.array(found, pa.int64()), pa.array(texts, pa.int64())], schema=schema)

    return held.mapInArrow(read, f"item_id long, {unique} long")


def quote_candidates(quotes: DataFrame, sources: DataFrame, *, quote: str = "quote", source: str = "content", enough: float = 0.9) -> DataFrame:
    """Distinct (item_id, doc_id) of ``quotes`` and ``sources`` that verify_quotes can match; none is missed.

    A window with Dice d of word pairs shares at least d / (2 - d) of the quote's
    pairs, and a source that holds the quote word for word all but the first and
    the last, which may be parts of longer words there.  Quotes of three words or
    fewer have no pair to rely on then; they are looked for in every source.
    """

    def pairs(df: DataFrame, unique: str, text: str) -> DataFrame:
        words = df.select(F.col(unique).cast("long").alias(unique), F.transform(F.split(match_form(F.col(text)), " "), lambda x: F.xxhash64(x)).alias("w")).where(F.size("w") > 1)
        each = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.xxhash64(a, b))
        return words.select(unique, each.alias("pairs"))

    own = pairs(quotes, "item_id", quote).select("item_id", F.explode(F.array_distinct("pairs")).alias("pair"))
    sizes = own.groupBy("item_id").agg(F.count("*").alias("n"))
    held = pairs(sources, "doc_id", source)
    if own.count() * 16 <= PAIR_BYTES:
        near = _near_pairs(own, sizes, held, "doc_id", enough)
    else:
        shared = own.join(held.select("doc_id", F.explode(F.array_distinct("pairs")).alias("pair")), "pair").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))
        least = F.least(F.ceil(F.col("n") * (enough / (2 - enough)) - 1e-9), F.col("n") - 2)
        near = shared.join(sizes, "item_id").where(F.col("shared") >= least).select("item_id", "doc_id")
    short = quotes.select("item_id", match_form(F.col(quote)).alias("_q")).where((F.col("_q") != "") & (F.size(F.split("_q", " ")) <= 3))
    held = sources.select("doc_id", match_form(F.col(source)).alias("_s")).join(short, F.contains("_s", "_q")).select("item_id", "doc_id")
    return near.unionByName(held).distinct()


def verify_quotes(claims: DataFrame, *, quote: str = "quote", source: str = "content", enough: float = 0.9) -> DataFrame:
    """Add similarity (1 where the source holds the quote, else the best window) and matched.

    The exact test is native; only what it leaves goes through the window search,
    in Arrow batches.
    """
    formed = claims.withColumn("_quote", match_form(F.col(quote))).withColumn("_source", match_form(F.col(source)))
    exact = (F.col("_quote") != "") & F.contains("_source", "_quote")

    @F.pandas_udf("double")
    def windows(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, s in pairs:
            yield pd.Series([best_window(a, b) if a and b else 0.0 for a, b in zip(q, s)])

    rest = F.when(~exact, F.col("_source")).otherwise("")
    scored = formed.withColumn("similarity", F.when(exact, 1.0).otherwise(windows("_quote", rest)))
    return scored.drop("_quote", "_source").withColumn("matched", F.col("similarity") >= enough)


def word_trigrams(name: Column) -> Column:
    """Distinct letter trigrams of each word with two blanks before and one after it."""
    words = F.filter(F.split(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard of two arrays of distinct values; null where both are empty."""
    both = F.size(F.array_intersect(a, b))
    return both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0))


def citations(text: Column) -> Column:
    """Numbers cited as [1] or [2, 3], in order."""
    marks = F.regexp_extract_all(text, F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1))
    return F.transform(F.flatten(F.transform(marks, lambda m: F.split(m, r"\s*,\s*"))), lambda x: x.cast("int"))


def cut_headline(title: Column) -> Column:
    """Whether a headline looks cut off: it ends in a sign that something follows, or in a joining word."""
    stem = F.rtrim(title, F.lit(ENDING_BLANKS))
    end = F.concat(F.right(stem, F.lit(END_CHARS)), F.substr(title, F.length(stem) + 1))  # no more of a long text counts
    return end.rlike(rf"(?i)(?:[:;,–—-]|\.\.\.|…)\s*$|\b(?:{'|'.join(DANGLING)})\s*$")


def incomplete_headline(title: Column, short: bool = True) -> Column:
    """Whether a headline stops in the middle: under five words (if ``short``), a function word at its end, or a verb in -ing after an auxiliary."""
    words = F.filter(F.split(F.regexp_replace(F.trim(title), "[“”\"']", ""), r"\s+"), lambda w: w != "")
    low = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]+$", ""))
    last, before = F.get(low, F.size(low) - 1), F.coalesce(F.get(low, F.size(low) - 2), F.lit(""))
    stops = last.isin(FUNCTION_ENDS) | (last.rlike(r"^\p{L}{3,}ing$") & before.isin(AUXILIARIES))
    return F.coalesce(((F.size(words) < 5) if short else F.lit(False)) | stops, F.lit(False))


def clean_headline(title: Column, url: Column) -> Column:
    """A headline without the site's name before or after it.

    A part is the site's if it and the host are within each other (letters and digits
    alone), or if it has a site's word in four words or fewer; after a hyphen only
    the first counts.
    """
    spaced = F.trim(F.regexp_replace(title, r"\s+", " "))
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", ""), "[^a-z0-9]", "")

    def of_site(part: Column, hyphen: Column) -> Column:
        flat = F.regexp_replace(F.lower(part), "[^a-z0-9]", "")
        named = (F.length(flat) >= 3) & (host != "") & (F.contains(host, flat) | F.contains(flat, host))
        return named | (~hyphen & (F.size(F.split(part, r"\s+")) <= 4) & part.rlike(rf"(?i)\b(?:{'|'.join(SITE_WORDS)})\b"))

    lead = r"^([^|–—]{2,40}?)\s+[|–—]\s+(.{15,})$"
    first, rest = F.regexp_extract(spaced, lead, 1), F.regexp_extract(spaced, lead, 2)
    headed = F.when((first != "") & of_site(first, F.lit(False)), rest).otherwise(spaced)
    tail = r"^(.{15,}?)\s+([|–—]|-)\s+([^|–—]{2,40})$"
    body, sign, end = (F.regexp_extract(headed, tail, i) for i in (1, 2, 3))
    return F.trim(F.when((end != "") & of_site(end, sign == "-"), body).otherwise(headed))


def error_page(text: Column) -> Column:
    """Whether a page is an error or a challenge instead of content, by its first 1500 characters."""
    return F.coalesce(F.substr(text, F.lit(1), F.lit(1500)).rlike(ERRORS), F.lit(False))
