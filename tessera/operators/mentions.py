"""Which of many names stand in which texts, and what sentences say about two of them.

Names and texts are compared as sequences of words in lower case, so a name is found
whole or not at all.  Up to MOST_BYTES of names go to every task as one automaton that
reads each text once, whatever the number of names.  A larger set of names is joined
instead: stretches of words of each length that a name has, by hash, then compared.
Joins with names or companies are hinted to merge: a packed file of few megabytes can
hold millions of names, and Spark would take it for small and send it through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.tables import dealt

#: Bytes of names up to which they are sent to every task.
MOST_BYTES = 16 << 20


def word_form(text: Column) -> Column:
    """Words of a text in lower case, one blank between them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def _by_automaton(forms: DataFrame, names: list[tuple[int, str]]) -> DataFrame:
    sent = forms.sparkSession.sparkContext.broadcast(names)
    schema = pa.schema([("text_id", pa.int64()), ("name_id", pa.int64()), ("n", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for name_id, form in sent.value:
            held = machine.get(f" {form} ", None)
            machine.add_word(f" {form} ", [name_id] if held is None else [*held, name_id])  # names that differ in signs alone
        machine.make_automaton()
        for batch in batches:
            out: list[tuple] = []
            for text_id, form in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts: dict[int, int] = {}
                for _, held in machine.iter(f" {form} "):
                    for name_id in held:
                        counts[name_id] = counts.get(name_id, 0) + 1
                out += [(text_id, name_id, n) for name_id, n in counts.items()]
            yield pa.record_batch([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], schema=schema)

    return forms.mapInArrow(read, "text_id long, name_id long, n long")


def _by_words(forms: DataFrame, names: DataFrame) -> DataFrame:
    lengths = sorted(r[0] for r in names.select(F.size(F.split("form", " "))).distinct().collect())  # as many as names have lengths
    words = F.split("form", " ")

    def stretches(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))

    found = []
    for n in lengths:
        held = forms.where(F.size(words) >= n).select("text_id", F.explode(stretches(n)).alias("form"))
        known = names.where(F.size(words) == n).withColumn("key", F.xxhash64("form"))
        found.append(held.withColumn("key", F.xxhash64("form")).join(known.hint("merge"), ["key", "form"]).select("text_id", "name_id"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("text_id", "name_id").agg(F.count("*").alias("n"))


def mentions(texts: DataFrame, names: DataFrame, *, text: str = "text", text_id: str = "text_id", name: str = "name", name_id: str = "name_id", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(text_id, name_id, n): how often each name stands in each text, overlapping ones included; pairs that don't meet have no row.

    Names without a letter or digit are in no text; null texts hold none.  Rows of one
    text_id count together only by what joins them later.
    """
    forms = texts.select(F.col(text_id).cast("long").alias("text_id"), word_form(F.col(text)).alias("form")).where("form <> ''")
    known = names.select(F.col(name_id).cast("long").alias("name_id"), word_form(F.col(name)).alias("form")).where("form <> ''").distinct()
    size = known.agg(F.sum(F.octet_length("form") + 16)).first()[0]
    if not size:
        return forms.limit(0).select("text_id", F.col("text_id").alias("name_id"), F.lit(0).cast("long").alias("n"))
    return _by_automaton(forms, [tuple(r) for r in known.orderBy("form", "name_id").collect()]) if size <= most_bytes else _by_words(forms, known)


# Rivals --------------------------------------------------------------------------------------------------------------
# How press writes a name, what is none, and what stands before names in a list.
NAME = r"[A-Z0-9][\w&.'’-]*(?:\s+(?:of\s+|the\s+)?[A-Z0-9][\w&.'’-]*){0,3}"
NO_NAMES = "the a an and or in on for with also other which who that as at its their both all many most several some big large established legacy".split()
COMMON = "high low new best top other others many some most more less free open fast easy smart simple modern global local general".split()
LED_BY = r"(?i)^(?:the likes of|such as|like|including|platforms such as|companies such as|rivals such as)\s+"
BACKED = r"(?i)^(?:\w+-(?:backed|owned|based|funded|led|founded)\s+)+"
CATEGORY = r"(?i)^(?:conventional|traditional|legacy|standard|manual|generic|other|existing|alternative|competing|typical|classic|basic)\b"
PLACES = r"(?i)^(?:the\s+)?(?:india|china|israel|europe|america|asia|africa|germany|france|uk|us|usa|world|industry|company|market|nation|country|region|city|state|people|customers?|today|its|their|our|his|her)['’]s(?:\s|$)"
FIGURES = r"(?i)^[\d.\s,%$-]+$|^\d|\b\d+(?:\.\d+)?\s*(?:fps|ms|gb|mb|tb|tops|ghz|mhz|x)\b"
_OWN, _ANY = "\u0001", "\u0002"  # stand for the company's name as it is written, and in any case


def company_like(name: Column) -> Column:
    """Whether a name can be a company's: no category, question, possessive of a place, figure or title."""
    n = F.trim(name)
    words = F.size(F.split(n, r"\s+"))
    titled = n.rlike(r"(?i)\s(?:for|with|in|on|at|to|and|or|vs|beats|why|how|what)\s") & (words > 3)
    asks = n.rlike(r"(?i)^(?:why|how|what|when|where|which|is|are|does|do|can)\b") | n.rlike(r"(?i)\b(?:competitors?|alternatives?|others|solutions?)$")
    bad = n.rlike(r"[/,;?!]") | n.rlike(r"(?i)\bpart\s*\d+\b") | n.rlike(PLACES) | n.rlike(FIGURES) | titled | asks | (words > 4) | n.rlike(CATEGORY) | ((words == 1) & F.lower(n).isin(COMMON))
    return F.length(n).between(2, 40) & ~bad & n.rlike(r"\p{L}")


def names_in_list(listed: Column) -> Column:
    """Companies in ``Datadog, New Relic, and Splunk``, each once."""
    parts = F.split(listed, r"(?i)\s*(?:,|;|\band\b|\bor\b|&(?=\s))\s*")
    led = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(F.trim(p), LED_BY, ""), BACKED, ""))
    names = F.transform(led, lambda p: F.trim(F.regexp_replace(F.regexp_extract(p, f"^({NAME})", 1), "[.,;:]+$", "")))
    return F.array_distinct(F.filter(names, lambda n: (n != "") & ~F.lower(n).isin(NO_NAMES) & company_like(n)))


def core_name(name: Column) -> Column:
    """A name without its legal form, as words."""
    return word_form(F.regexp_replace(name, r"(?i),?\s*\b(inc|incorporated|llc|ltd|limited|corp|corporation|gmbh|plc|co)\b\.?$", ""))


def _quoted(name: Column, case: str) -> Column:
    return F.concat(F.lit(rf"{case}\b\Q"), F.replace(F.trim(name), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))


def rivals_in(sentence: Column, company: Column) -> Column:
    """Companies that a sentence calls rivals of ``company``, which must be a side of the comparison."""
    own = F.regexp_replace(sentence, _quoted(company, ""), F.lit(_OWN))
    any_case = F.regexp_replace(sentence, _quoted(company, "(?i)"), F.lit(_ANY))
    rest = r"((?:(?!\.\s|\.$)[^;]){2,160})"
    patterns = [
        (any_case, rf"(?i){_ANY}[^.]{{0,60}}?\b(?:competes?|competing)\s+with\s+(?:the likes of\s+|companies (?:such as|like)\s+|platforms such as\s+|rivals such as\s+)?{rest}"),
        (own, rf"{_OWN}[^.]{{0,40}}?\brivals?\s+(?:to|of)\s+(?:the\s+)?(?:(?:U\.S\.|U\.K\.|[a-z][a-z.-]*)\s+){{0,3}}?(?!U\.[SK]\.\s)({NAME})"),
        (any_case, rf"(?i){_ANY}(?:['’]s)?[^.]{{0,40}}?\bcompetitors\s+(?:include|such as|like)\s+{rest}"),
        (own, rf"^({NAME})\b[^.]{{0,120}}?\b(?:competes?|competing)\s+with\s+(?:[A-Za-z-]+\s+){{0,2}}{_OWN}"),
        (own, rf"({NAME}),?\s+an?\s+(?:[a-z-]+\s+){{0,3}}(?:rival|competitor)\s+(?:to|of)\s+{_OWN}"),
    ]
    found = F.flatten(F.array(*[names_in_list(F.regexp_extract(marked, pattern, 1)) for marked, pattern in patterns]))
    return F.array_distinct(F.filter(found, lambda n: ~n.contains(_OWN) & ~n.contains(_ANY) & (core_name(n) != core_name(company))))


def rival_claims(sources: DataFrame, companies: DataFrame, *, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(company_id, source_id, rival, quote): rivals that a source's sentences declare for any of the companies, each once a source.

    sources: source_id, text; companies: company_id, company.  Only sentences that name
    a company (found for all companies at once) meet the patterns.  A sentence
    of more than 400 characters is none; the quote is the least sentence.
    """
    sentences = dealt(sources.select("source_id", "text")).select("source_id", F.explode(F.split(F.regexp_replace("text", r"\s+", " "), "(?<=[.!?])\\s+(?=[A-Z“\"'])")).alias("sentence"))
    short = sentences.where(F.length("sentence") <= 400).select("source_id", F.trim("sentence").alias("sentence")).withColumn("text_id", F.xxhash64("source_id", "sentence"))
    held = mentions(short.where(F.col("sentence").rlike("(?i)compet|rival")), companies, text="sentence", name="company", name_id="company_id", most_bytes=most_bytes).select("text_id", F.col("name_id").alias("company_id")).distinct()
    known = companies.select(F.col("company_id").cast("long").alias("company_id"), "company")
    met = short.dropDuplicates(["text_id"]).join(held.hint("merge"), "text_id").join(known.hint("merge"), "company_id")
    claims = met.select("company_id", "source_id", F.explode(rivals_in(F.col("sentence"), F.col("company"))).alias("rival"), "sentence")
    return claims.groupBy("company_id", "source_id", core_name(F.col("rival")).alias("core")).agg(F.min("rival").alias("rival"), F.min("sentence").alias("quote")).drop("core")
