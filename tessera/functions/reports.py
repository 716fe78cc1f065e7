"""What news, filings and pages report: purchases, announcements, rounds, patents and dates, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.classify import round_label
from tessera.functions.money import close

# Verbs of a purchase, before the name of what is bought and after it.
BUY = (
    "completes (?:its |the )?acquisition of|completed (?:its |the )?acquisition of|announces (?:its |the )?acquisition of|acquires?|acquired|buys|bought|buyout of|snaps up|picks up|takes over|to acquire|to buy"
    "|przejmuje|przejął|przejęła|kupuje|adquiere|adquirió|adquirida|compra|compró|übernimmt|übernahm|rachète|rachètent|acquiert|רוכשת|רכשה|רוכש"
)
BOUGHT_BY = "acquired by|bought by|sold to|taken over by|to be acquired by|is being acquired by|adquirida por|przejęta przez|übernommen von|racheté par|נרכשה על ידי|נרכשת על ידי"
# Words of a controlling stake.
MAJORITY = (
    r"\b(?:control\w*|majority)\s+(?:stake|share|shares|interest|package|holding)|\bstake\s+in\b|\bprzejmuje\s+(?:większościowy|kontrolny|kontrol)|\bpakiet\s+(?:kontrolny|większościowy)|\bwiększościow"
    r"|\bparticipaci[oó]n\s+mayoritaria|\bmayor[ií]a\b|\bmehrheit|\bparticipation\s+majoritaire|\bprise\s+de\s+contr[oô]le|\bmajorit[eé]\b|\bmaggioranza|\bmaioria|\bcontrole\s+acion[aá]rio|\bמניית\s+שליטה|\bשליטה\s+ב"
)
# Words that make a name another firm's, nouns before a buyer's name, and what is no buyer's name.
OTHER_FIRM = "Group|Holdings?|AB|Nordic|Sweden|International|Global|Europe|Bank|Finance|Capital"
BUYER_NOUNS = "company|firm|startup|start-up|giant|provider|maker|group|bank|platform|vendor|leader|player|unicorn|business|developer|operator|specialist|powerhouse"
NO_BUYER = "US|UK|EU|The|An?|Its|It|Investors?|Group|Company|Firm"
REGIONS = (
    "Egypt|India|Nigeria|Kenya|Ghana|Brazil|Mexico|Argentina|Chile|Colombia|Israel|Germany|France|Spain|Italy|Poland|Japan|China|Korea|UK|US|USA|UAE|Saudi|Canada|Australia|Singapore|Turkey|Sweden|Norway|Denmark|Finland|Ireland|Netherlands|Switzerland|Africa|Europe|Asia|Britain"
    "|American|British|Indian|Egyptian|German|French|Spanish|Italian|Polish|Japanese|Chinese|Korean|Israeli|Nigerian|Brazilian|Mexican|Canadian|Australian|Swedish|Dutch|Swiss|Emirati|Turkish|African|European|Asian"
)
BUYER_FORMS = "group|inc|ltd|llc|limited|corp|corporation|plc|holdings?|ag|gmbh|sa|s a"
# Words of an announcement, and sums in headlines.
ANNOUNCEMENT = (
    r"(?i)\b(?:raises?|raised|secures?|funding|series [a-z]|seed|acquir\w+|acquisition|launch\w*|introduc\w+|unveil\w*|announc\w+|partner\w*|appoint\w*|names?|hires?|expands?|opens?|releases?|surpass\w*|reach\w*"
    r"|crosse?s|doubles?|triples?|wins?|awarded|award|recogni[sz]ed|integrat\w+)\b|[$€£]\s?\d|\b\d+(?:[.,]\d+)?\s?(?:m|bn?|million|billion)\b"
)
STATED_SUM = r"(?i)[$€£]\s?\d[\d.,]*|\b\d[\d.,]*\s?(?:million|billion|mln|bn)\b"
EVENT_SUM = r"(?i)(\d+(?:[.,]\d+)?)\s?(billion|bn|million|mn|m|b|k|thousand)\b"
PURCHASE = r"(?i)\bacqui(?:re|res|red|sition|ring)\b|\bbuys\b|\bbought\b"
# A page's fields for the day it was published.
PUBLISHED = r"article:published_time|og:article:published_time|datePublished|pubdate|date|publishdate|DC\.date\.issued"
# Stages that a company raises once.
NAMED_STAGES = ("Pre-Seed", "Seed", "Series A", "Series B", "Series C", "Series D", "Series E", "Series F+")

_MARK = "\u0001"  # stands for the company's name in a text
_WORD = r"\p{Lu}[\p{L}\d&.'’-]*"
_NAME = rf"(?:{_WORD}\s+){{0,3}}{_WORD}"


def _letters(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "")


def _held(value: Column, then) -> Column:
    """``then`` of a value that is worked out once per row; a column that is named several times would be worked out each time, and such plans outgrow what compiles."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _found(text: Column, pattern: str) -> Column:
    return _held(F.regexp_extract(text, pattern, 1), lambda x: F.when(x != "", x))


def acquirer_in(text: Column, company: Column) -> Column:
    """Who bought the company by a sentence or headline; null where it isn't said to be bought.

    The company's name becomes a mark first, so that every form of the sentence is
    one fixed pattern: bought by a buyer, sold to one, or a buyer's verb before it.
    A name that a word of another firm follows is another firm's.
    """
    return _held(F.struct(text.alias("text"), company.alias("company")), lambda x: _acquirer(x["text"], x["company"]))


def _acquirer(text: Column, company: Column) -> Column:
    spaced = F.regexp_replace(text, r"\s+", " ")
    name = F.concat(F.lit(r"(?iU)\b\Q"), F.replace(F.regexp_replace(F.trim(company), r"\s+", " "), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))

    def own(marked: Column) -> Column:
        other = F.regexp_extract(marked, rf"^[^{_MARK}]*{_MARK}[ ,]+({OTHER_FIRM})\b", 1)
        return _held(other, lambda x: (x == "") | F.contains(F.concat(F.lit(" "), F.lower(company), F.lit(" ")), F.concat(F.lit(" "), F.lower(x), F.lit(" "))))

    def buyer(passive: Column) -> Column:
        described = _found(passive, rf"^(?:[\p{{L}}\d-]+\s+){{0,6}}?(?:{BUYER_NOUNS})\s+({_NAME})")
        return F.coalesce(described, _found(passive, rf"^\W*({_NAME})"))

    def usable(raw: Column) -> Column:
        bare = F.regexp_replace(raw, rf"^(?:(?:{REGIONS})(?:['’]s|s)?|[A-Za-z]{{2,4}}-based)\s+(?=\p{{Lu}})", "")
        bare = F.trim(F.regexp_replace(bare, "[.,;]+$", ""))
        return _held(bare, lambda x: F.when(~x.rlike(rf"(?i)^(?:{NO_BUYER})$") & _held(F.struct(_letters(x).alias("a"), _letters(company).alias("b")), lambda k: ~F.contains(k["a"], k["b"]) & ~F.contains(k["b"], k["a"])), x))

    def named(marked: Column) -> Column:
        passive = F.regexp_extract(marked, rf"(?i)^[^{_MARK}]*{_MARK}[^.:;|]{{0,60}}?\b(?:{BOUGHT_BY})\s+(.*)$", 1)
        sale = rf"(?i:\b(?:sale of|sells?|sold|divest(?:s|ed|iture of)?)\s*){_MARK}.*?|{_MARK}[^.:;|]{{0,60}}?(?i:\b(?:sale|sold|divestiture)\b).*?"
        seller = _found(marked, rf"^[^{_MARK}]*?(?:{sale})\b[Tt]o\s+({_NAME})")
        active = _found(marked, rf"({_NAME})[^\p{{L}}\p{{N}}{_MARK}]*\b(?i:{BUY})\b(?:(?!\b(?i:{BUY})\b)[^.:;|{_MARK}]){{0,90}}{_MARK}")
        return F.when(F.contains(marked, F.lit(_MARK)) & own(marked), F.coalesce(*map(usable, (_held(passive, buyer), seller, active))))

    return _held(F.regexp_replace(spaced, name, F.lit(_MARK)), named)


def majority_stake(text: Column) -> Column:
    """Whether a text speaks of a controlling stake instead of the whole."""
    return F.coalesce(text.rlike(f"(?i){MAJORITY}"), F.lit(False))


def buyer_key(name: Column) -> Column:
    """Letters and digits of a buyer's name without the legal form or ``Group`` at its end."""
    spaced = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}\s]+", " ")
    return _letters(F.regexp_replace(spaced, rf"\s+(?:{BUYER_FORMS})\s*$", ""))


def known_acquirers(headlines: DataFrame, keys: list[str], *, title: str = "title", company: str = "company", agree: int = 2) -> DataFrame:
    """Buyers that at least ``agree`` headlines of a company name: keys, buyer_key, buyer (its shortest spelling), n.

    Counted per company and buyer before the shuffle; a company with very many
    headlines is only as many rows as it has buyers.
    """
    named = headlines.select(*keys, acquirer_in(F.col(title), F.col(company)).alias("buyer")).where("buyer IS NOT NULL")
    shortest = F.min(F.struct(F.length("buyer").alias("size"), F.col("buyer"))).getField("buyer").alias("buyer")
    grouped = named.withColumn("buyer_key", _letters(F.col("buyer"))).groupBy(*keys, "buyer_key").agg(shortest, F.count("*").alias("n"))
    return grouped.where(F.col("n") >= agree)


def is_announcement(title: Column) -> Column:
    """A raise, purchase, launch, partnership, appointment or milestone; a personal post isn't one."""
    personal = title.rlike(r"\b(?:I|my|me)\b") & ~title.rlike(r"(?i)\b(?:announce|launch|raise|acqui)")
    return F.coalesce(~personal & title.rlike(ANNOUNCEMENT), F.lit(False))


def states_amount(text: Column) -> Column:
    """Whether a headline or address states a sum (``$450M``, ``450-million``)."""
    return F.coalesce(F.regexp_replace(text, "[-_/]+", " ").rlike(STATED_SUM), F.lit(False))


def event_keys(title: Column) -> Column:
    """What a headline reports, to tell reports of one event from those of another: sums such as ``60m``, and ``acquisition``."""
    figures, units = (F.regexp_extract_all(title, F.lit(EVENT_SUM), F.lit(i)) for i in (1, 2))
    number = lambda x: F.regexp_replace(F.format_string("%.4f", F.replace(x, F.lit(","), F.lit(".")).cast("double")), r"\.?0+$", "")
    unit = lambda u: F.when(F.lower(u).startswith("b"), "b").when(F.lower(u).rlike("^[kt]"), "k").otherwise("m")
    sums = F.array_distinct(F.zip_with(figures, units, lambda x, u: F.concat(number(x), unit(u))))
    return F.when(title.isNull(), F.array().cast("array<string>")).when(title.rlike(PURCHASE), F.array_append(sums, F.lit("acquisition"))).otherwise(sums)


def headline_words(title: Column, url: Column) -> Column:
    """Distinct words of four letters or digits or more in a headline and in its address's last part."""
    last = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(?:/[^?#]*)?/([^/?#]+)/*(?:[?#].*)?$", 1)
    slug = F.regexp_replace(F.coalesce(F.try_url_decode(last), F.lit("")), r"(?i)\.(html?|php)$", "")
    text = F.lower(F.concat_ws(" ", title, F.regexp_replace(slug, "[-_+]", " ")))
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(text, r"[^\p{L}\p{N} ]", " "), F.lit(r"\S{4,}"), F.lit(0)))


def same_news_event(a: Column, b: Column, days: int = 7, share: float = 0.6) -> Column:
    """Whether two reports (structs of title, url, published) are of one event.

    Either they are of one day and share most words of the headline that has
    fewer, or they share a sum or a purchase within ``days``, or one is undated.
    """
    x, y = (headline_words(r["title"], r["url"]) for r in (a, b))
    fewer = F.least(F.size(x), F.size(y))
    same_story = (a["published"] == b["published"]) & (fewer >= 4) & (F.size(F.array_intersect(x, y)) >= share * fewer)
    near = F.coalesce(F.abs(F.datediff(a["published"], b["published"])) <= days, F.lit(True))
    return F.coalesce(same_story, F.lit(False)) | (near & F.arrays_overlap(event_keys(a["title"]), event_keys(b["title"])))


def same_round(a: Column, b: Column) -> Column:
    """Whether two rounds (structs of label, amount, announced) are one raise."""
    x, y = round_label(a["label"]), round_label(b["label"])
    gap = F.abs(F.datediff(a["announced"], b["announced"]))
    soon, alike, open_ended = F.coalesce(gap <= 60, F.lit(False)), close(a["amount"], b["amount"], 0.10), F.coalesce(gap <= 270, F.lit(True))
    letters = soon | (alike & open_ended)
    named = open_ended | alike
    return F.when((x == y) & (x == "Series F+"), letters).when((x == y) & x.isin(*NAMED_STAGES), named).when(x == y, soon).otherwise(alike & soon)


def round_conflict(on_file: Column, found: Column) -> Column:
    """What two reports of one round disagree on: amount (over 15 percent) or date (over 120 days), else null."""
    both = on_file["amount"].isNotNull() & found["amount"].isNotNull()
    late = F.abs(F.datediff(on_file["announced"], found["announced"])) > 120
    return F.when(both & ~close(on_file["amount"], found["amount"], 0.15), "amount").when(late, "date")


def incomplete_round(label: Column, amount: Column, announced: Column, lead: Column) -> Column:
    """Why a round isn't written: no amount and not all of type, date and lead, or neither type nor date; else null."""
    generic, undated = round_label(label).isin("Other", "Unknown"), announced.isNull()
    unled = lead.isNull() | (lead == "")
    return F.when(amount.isNull() & (generic | undated | unled), "round_without_amount_incomplete").when(generic & undated, "round_other_without_date")


def patent_number_in(url: Column) -> Column:
    """Patent number in an address (``/patent/US11756357B2``), else null."""
    return F.upper(_found(url, r"(?i)/patent/([A-Z]{2}[A-Z0-9]+?)(?:/|$|\?)"))


def patent_digits(number: Column) -> Column:
    """Digits that name a patent in every spelling: after the country, without zeros in front; else all digits."""
    after = _found(F.regexp_replace(F.upper(number), r"[\s,.-]", ""), r"^[A-Z]{2}(\d+)")
    return F.coalesce(F.regexp_replace(after, "^0+", ""), F.regexp_replace(number, r"\D", ""))


def patent_problem(number: Column, url: Column) -> Column:
    """Why a claimed patent can't be told: no number, another one in its address, or too few digits; else null."""
    given, linked = F.nullif(F.trim(number), F.lit("")), patent_number_in(url)
    differs = F.coalesce(patent_digits(given) != patent_digits(linked), F.lit(False))
    known = F.coalesce(given, linked)
    short = F.length(patent_digits(known)) < 5
    return F.when(known.isNull(), "patent_unidentified").when(differs, "patent_number_url_mismatch").when(short, "patent_unidentified")


def html_date(html: Column, today: Column) -> Column:
    """Day a page says it was published, by its meta fields, its JSON-LD, then its time element; later than ``today`` or before 1990 is none."""
    field = rf"(?:property|name|itemprop)=[\"'](?:{PUBLISHED})[\"']"
    patterns = [
        rf"(?i)<meta[^>]+{field}[^>]*content=[\"']([^\"']+)[\"']",
        rf"(?i)<meta[^>]+content=[\"']([^\"']+)[\"'][^>]*{field}",
        r'(?i)"datePublished"\s*:\s*"([^"]+)"',
        r"(?i)<time[^>]+datetime=[\"']([^\"']+)[\"']",
    ]

    def day(pattern: str) -> Column:
        found = F.try_to_date(F.regexp_extract(F.regexp_extract(html, pattern, 1), r"(?:19|20)\d{2}-\d{2}-\d{2}", 0), "yyyy-MM-dd")
        return F.when((found <= today) & (F.year(found) >= 1990), found)

    return F.coalesce(*map(day, patterns))


def useful_tags(tags: Column) -> Column:
    """Tags that say something: no bookkeeping, trimmed, each once."""
    book = r"(?i)^(region:|license:|arxiv:|doi:|dataset:|base_model:|endpoints_compatible$|autotrain_compatible$|has_space$|co2_eq_emissions$)"  # fixed values
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: (t != "") & ~t.rlike(book)))


def first_given(v: Column, *paths: str) -> Column:
    """First of a variant's fields that is a text that isn't blank, or a number."""
    texts = [F.nullif(F.trim(F.try_variant_get(v, f"$.{p}", "string")), F.lit("")) for p in paths]
    return reduce(lambda a, b: F.coalesce(a, b), texts)
