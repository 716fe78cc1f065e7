"""Spelling variants of words, found through pivotal grams.

Two words are near if one inserted, deleted or replaced code point makes one the
other.  Such an edit destroys at most two neighbouring bigrams.  Under one global
order of bigrams, rarest first, a word's *prefix* is its three first bigrams, and
its *pivots* are two of these that don't overlap, chosen by dynamic programming so
that they are rarest together.  One edit can't destroy both pivots.  So of two near
words, the one whose prefix ends earlier in the order has a pivot that survives in
the other word, and there it is in the prefix: joining pivots with prefixes, in that
direction, finds every near pair.

The surviving bigram stands before or behind the edit.  Before it, both words agree
from their start to the bigram's end; behind it, from the bigram to their end.  The
join's key is this agreeing part with the other word's length, which says exactly
where the bigram must stand (its position limit).  Candidates are then verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import hot_keys, settle, whole_number

#: The order of bigrams comes from the counts of this many frequent ones; all others come before them.
#: Any order gives the same pairs.  The letters of ``RUN`` form at most 90 * 90 bigrams.
MOST_GRAMS = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"[A-Za-zÀ-ÿ]"


def _damaged(doc_id: Column, run: Column, every: int) -> Column:
    """The run without one code point, in every ``every``-th case by a checksum of document and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def word_counts(docs: DataFrame, *, least_length: int = 6, least_count: int = 5, every: int = 199) -> DataFrame:
    """(word, n): words of the whole texts and their occurrences.

    Words are runs of Latin letters, A-Z in lower case, with a code point deleted
    from some (see ``_damaged``).  A null text has none; a null doc_id is
    written as an empty string in the checksum.
    """
    runs = F.regexp_extract_all("text", F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))  # a deletion only shortens
    rows = docs.select(whole_number(docs["doc_id"]).alias("doc_id"), F.col("text")).select("doc_id", F.explode(runs).alias("run"))
    rows = rows.select("doc_id", F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    words = rows.select(_damaged(F.col("doc_id"), F.col("run"), every).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def gram_counts(words: DataFrame) -> dict[str, int]:
    """The most frequent bigrams, by the number of words that hold them; MOST_GRAMS at most."""
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(2)))
    counted = words.select(F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram").count()
    return {r["gram"]: r["count"] for r in counted.orderBy(F.desc("count"), "gram").limit(MOST_GRAMS).collect()}


def pivots(prefix: list[tuple[int, int]], wanted: int = 2, width: int = 2) -> list[int]:
    """Positions of ``wanted`` bigrams that don't overlap and whose weights sum to least.

    ``prefix`` has (position, weight), ascending.  best[k] is the cheapest choice
    of k bigrams among those seen so far.
    """
    done: list[tuple[int, list]] = []  # (end, best) after each bigram
    for at, weight in prefix:
        free = next((best for end, best in reversed(done) if end <= at), [(0, ())])
        best = list(done[-1][1]) if done else [(0, ())]
        for k, (cost, chosen) in enumerate(free[:wanted]):
            new = (cost + weight, (*chosen, at))
            if k + 1 == len(best):
                best.append(new)
            elif new < best[k + 1]:
                best[k + 1] = new
        done.append((at + width, best))
    return list(done[-1][1][wanted][1])


def _place(gram: str) -> int:
    return (ord(gram[0]) << 21 | ord(gram[1])) - (1 << 43)


def word_keys(word: str, places: dict[str, int], weights: dict[str, int]) -> tuple[int, list[str], list[str]]:
    """Place of the prefix's last bigram in the order; keys of the pivots; keys of the prefix.

    A bigram that is as late as the prefix's third is in the prefix as well, so
    that it doesn't matter which of its occurrences an edit leaves.
    """
    grams = [word[i : i + 2] for i in range(len(word) - 1)]
    order = [places[g] if g in places else _place(g) for g in grams]
    last = sorted(order)[2]
    prefix = [i for i, x in enumerate(order) if x <= last]
    own = len(word)
    found = [f"{side}{own} {word[: i + 2] if side == 'H' else word[i:]}" for i in prefix for side in "HT"]
    chosen = pivots([(i, weights.get(grams[i], 0)) for i in prefix])
    sought = [f"{side}{n} {word[: i + 2] if side == 'H' else word[i:]}" for i in chosen for side in "HT" for n in (own - 1, own, own + 1)]
    return last, sought, found


def _parity(word: str) -> int:
    """A bit for each code point, modulo 63, that occurs an odd number of times; one edit changes two bits at most."""
    bits = 0
    for c in word:
        bits ^= 1 << ord(c) % 63
    return bits


KEYED = "word string, n long, last long, parity long, sought array<string>, found array<string>"
_KEYED = pa.schema([("word", pa.string()), ("n", pa.int64()), ("last", pa.int64()), ("parity", pa.int64()), ("sought", pa.list_(pa.string())), ("found", pa.list_(pa.string()))])


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): near words of a table (word, n) of distinct words of 4 or more code points, each pair once.

    A key that many prefixes have is dealt over tasks in blocks of its words;
    its pivots go to each block.
    """
    weights = gram_counts(words)
    places = {g: i for i, g in enumerate(sorted(weights, key=lambda g: (weights[g], g)))}
    sent = words.sparkSession.sparkContext.broadcast((places, weights))  # MOST_GRAMS entries at most

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, weights = sent.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            last, sought, found = zip(*(word_keys(w, places, weights) for w in texts), strict=True) if texts else ((), (), ())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(last, pa.int64()), pa.array(map(_parity, texts), pa.int64()), pa.array(sought, pa.list_(pa.string())), pa.array(found, pa.list_(pa.string()))], schema=_KEYED)

    keyed = settle(words.select("word", "n").mapInArrow(keys, KEYED), "gram-keys")
    key = lambda c: F.explode(F.transform(c, lambda x: F.xxhash64(x))).alias("key")
    found = keyed.select(key("found"), "word", "n", "last", "parity")
    sought = keyed.select(key("sought"), *[F.col(c).alias(f"own_{c}") for c in ("word", "n", "last", "parity")])
    hot = F.broadcast(hot_keys(found.groupBy("key").agg(F.count("*").alias("n")), "key"))
    found = found.join(hot, "key", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("word"), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    sought = sought.join(hot, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    near = (F.col("own_last") <= F.col("last")) & (F.bit_count(F.col("own_parity").bitwiseXOR(F.col("parity"))) <= 2) & (F.levenshtein("own_word", "word", 1) == 1)
    pairs = sought.join(found, (sought["key"] == found["key"]) & (sought["part"] == found["part"]) & near)
    one, two = F.struct(F.col("word"), F.col("n")), F.struct(F.col("own_word").alias("word"), F.col("own_n").alias("n"))
    ordered = pairs.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b")).distinct()
    return ordered.select("a.word", "a.n", F.col("b.word").alias("other"), F.col("b.n").alias("other_n"))


def _roots(forms: DataFrame, factor: int, most: int) -> DataFrame:
    """(word, root) of a table (word, form): forms followed to the last.

    n grows by ``factor`` with every step, so no word is more than log(most)
    steps from its root; each round doubles the steps.
    """
    steps, longest = 1, 1
    while factor**longest <= most:
        longest += 1
    roots = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while steps < longest:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = settle(roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
        steps *= 2
    return roots


def variants(words: DataFrame, *, factor: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of a table (word, n) of distinct words.

    A word's form is its near word of largest n (of equal ones the least in
    code-point order), if that n is ``factor`` times the word's own or more; the root
    is where forms end.  Words without a form are their own root.
    """
    pairs = settle(near_pairs(words), "near-pairs")
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best"))
    fits = -F.col("best.less") >= F.col("n") * factor
    known = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))
    known = settle(known, "forms")
    most = known.agg(F.max("form_n")).first()[0] or 0
    roots = _roots(known.where("form IS NOT NULL").select("word", "form"), factor, most)
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Variants among the words of ``docs`` (see ``word_counts`` and ``variants``).

    Repeated rows count as often as they occur.  An empty table, or one without
    words, gives an empty result; other columns are ignored.
    """
    return variants(settle(word_counts(docs), "words"))
