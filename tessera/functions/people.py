"""People in prose: who founded a company, read from whole texts in Arrow batches.

A sentence counts where the company is its subject ("GoCo.io, Inc. was founded in 2015 by
..."): the words before the verb end in its name, or stand for it ("It", "The company") on a
page whose title or address names it, unless the sentence before was about another.
The names after "by" run until the first that isn't a person's.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.tables import dealt

#: Names that a worker keeps the results of: people's names come again on many pages.
CACHED = 20_000
# Words of organisations, sentence words, words between a subject and its verb, titles before and roles around names.
ORGANISATIONS = (
    "inc|llc|ltd|corp|capital|ventures|partners|labs|technologies|university|group|holdings|fund|foundation|team|engineers|google|microsoft|amazon|meta|apple|money|bank|banking|payments?|finance|financial|media|systems|software|digital|global|networks?|solutions|studios?|games|investments?"
    "|management|consulting|insurance|healthcare|health|medical|imaging|pharma|pharmaceuticals?|therapeutics|biotech|electric|electronics|industries|motors|energy|robotics|aerospace|semiconductors?|instruments|devices"
)
SENTENCE_WORDS = frozenset("however the and but this its their while after before since today also together both who which".split())
GAP_WORDS = frozenset("was is were has been originally officially which that first initially a an the".split())
TITLES = r"(?i)^(?:(?:ceo|cto|coo|cfo|cmo|cpo|cro|president|chairman|chairwoman|chair|co-?\s?founder|founder|dr|mr|mrs|ms|prof|sir)\.?,?\s+)+"
ROLE_ELSEWHERE = r"(?i)^(?:(?:former|ex-?)\s+)?(?:\p{Lu}[\p{L}\d.&-]*\s+){1,3}(?:ceo|cto|coo|cfo|cmo|cpo|chief \w+ officer|vp|head of \w+|researcher|engineer|executive|director|partner|founder|co-?founder)\s+(?=\p{Lu})"
GLUED_FRONT = r"(?i)^(?:as|the|by|and|meet|with|from|also|said|says|told|according|our|his|her)\s+(?=\p{Lu}\p{L}+\s+\p{Lu})"
GLUED_END = r"^(\p{Lu}[\p{L}'’.-]*(?:\s+\p{Lu}[\p{L}'’.-]*)+?)\s+(?:Co|CEO|CTO|CFO|COO|Founder|Co-?founder|President|Chairman|Chair)$"
LIST_END = r"\b(?:in|on|back in|during)\s+(?:\d{4}|[A-Z][a-z]+ \d{4})\b|[;:]|\bto\b|\bwho\b|\bwith the\b|\bas\s+(?:an?|the)\b|\bthat\b|\bwhich\b"
OPENINGS = r"^(The|Its|Their|This|Our|Today|Now|Since|In|Last|Earlier|Recently|However|Additionally|Meanwhile|Currently|Previously|Founded|Based|Headquartered)\b"
PLACES = ("new york", "silicon valley", "bay area", "tel aviv", "london", "berlin", "paris", "los angeles", "san francisco")

_SENTENCE_END = regex.compile(r"(?<=[\p{Ll}\d)\"”]{2}[.!?])\s+(?=[A-Z\"“])|\n+")
_FOUNDED = re.compile(r"\b(co-?\s?founded|founded)\b([^.]{0,40}?)\bby\s+(.+)$", re.I | re.S)
_STANDS_FOR = re.compile(r"^(it|the company|the startup|the firm|the business)\s*$", re.I)
_ANTECEDENT = regex.compile(r"^([A-Z][\p{L}\d.&'’-]*(?:\s+[A-Z][\p{L}\d.&'’-]*){0,3})(?:\s+(?:is|was|has|had|offers|provides|became|builds|makes)\b|,)")
_NAME = regex.compile(r"^[A-Z][\p{L}'’.-]*(?:\s+[A-Z][\p{L}'’.-]*){1,3}$")
_NOT_A_PERSON = re.compile(rf"\b(?:{ORGANISATIONS})\b", re.I)
_WORDS, _MARKS = regex.compile(r"[\p{L}\p{N}]+"), regex.compile("[̀-ͯ]")
_SOMEONES, _ELSEWHERE = regex.compile(r"^\p{Lu}[\p{L}\d.&-]*['’]s?\s+\p{Lu}"), regex.compile(ROLE_ELSEWHERE)
_SIGNS, _NO_WORD = regex.compile(r"[^\p{L}\p{N}\s]"), regex.compile(r"[^\p{L}\p{N}]+")
_FORMS = re.compile(r"\b(?:inc|ltd|llc|gmbh|corp|sas|sa)\b\.?", re.I)


def _fold(text: str) -> str:
    if text.isascii():
        return text
    return _MARKS.sub("", unicodedata.normalize("NFD", text))


def _words(text: str) -> list[str]:
    return _WORDS.findall(_fold(text).lower())


def names_company(text: str, company: str) -> bool:
    """Whether a text has the words of a company's name (without its legal form) in a row, or written as one."""
    name, words = _words(_FORMS.sub("", company)), _words(text)
    n = len(name)
    return bool(n) and any(words[i : i + n] == name or (n > 1 and words[i] == "".join(name)) for i in range(len(words)))


@lru_cache(CACHED)
def clean_name(name: str) -> str:
    """A person's name alone: no signs, titles, sentence words or roles around it."""
    n = regex.sub(r"^[^\p{L}]+", "", regex.sub(r"\p{Cf}", "", name)).strip()
    for _ in range(3):
        before = n
        n = regex.sub(r"^(?:\p{Ll}[\p{L}'’-]*\s+)+(?=\p{Lu})", "", re.sub(TITLES, "", n)).strip()
        n = regex.sub(GLUED_END, r"\1", regex.sub(GLUED_FRONT, "", n))
        if n == before:
            break
    return re.sub(r"[\s,;]+$", "", n)


@lru_cache(CACHED)
def person_like(name: str) -> bool:
    """Two to four capitalised words, none an organisation's, a sentence's or the end of one."""
    odd = lambda t: re.sub("[.,]$", "", t.lower()) in SENTENCE_WORDS or (regex.match(r"^\p{L}{3,}\.$", t) and t not in ("Prof.", "Mrs."))
    return bool(_NAME.match(name)) and not _NOT_A_PERSON.search(name) and not any(map(odd, name.split()))


def names_after_by(rest: str) -> list[str]:
    names: list[str] = []
    for raw in re.split(r",\s*(?:and\s+)?|\s+and\s+|\s*&\s*", re.split(LIST_END, re.sub(r"\([^)]*\)", "", rest))[0]):
        part = re.sub("[.,]+$", "", raw.strip())
        if _SOMEONES.match(part):
            continue  # someone of another organisation
        name = clean_name(_ELSEWHERE.sub("", part))
        if name.lower().startswith(PLACES):
            continue
        if not person_like(name):
            break
        names.append(name)
    return names[:5]


@lru_cache(CACHED)
def _person_words(name: str) -> tuple[str, ...]:
    return tuple([w for w in re.split("[^a-z]+", re.sub(r"\b(dr|mr|mrs|ms|prof)\.?\s", " ", _fold(name).lower())) if len(w) > 1])


def _one_edit(a: str, b: str) -> bool:
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else abs(len(a) - len(b)) == 1 and (a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :])


def same_person(a: str, b: str) -> bool:
    """As ``names.same_person`` has it, for two names in a task."""
    x, y = _person_words(a), _person_words(b)
    if len(x) < 2 or len(y) < 2:
        return False
    (fa, la), (fb, lb) = (x[0], x[-1]), (y[0], y[-1])
    begins = min(len(fa), len(fb)) >= 3 and (fa.startswith(fb) or fb.startswith(fa))
    return (la == lb and (fa == fb or begins)) or (fa == fb and min(len(la), len(lb)) >= 5 and (la == lb or _one_edit(la, lb)))


def founders_in(text: str, company: str, url: str | None = None, title: str | None = None) -> list[tuple[str, str, str]]:
    """(name, Founder or Co-founder, sentence) of those that the text's sentences name."""
    own_page = any(names_company(x, company) for x in (url, title) if x)
    parts, out = [s for x in _SENTENCE_END.split(text) if (s := x.strip())], []
    for i, sentence in enumerate(parts):
        m = _FOUNDED.search(sentence)
        if m is None:
            continue
        before = sentence[: m.start()]
        if _STANDS_FOR.match(re.sub(r"(?i)\s+(was|is|were|has been)$", "", before.strip())):
            found = _ANTECEDENT.match(parts[i - 1]) if i else None
            fits = own_page and (found is None or names_company(found[1], company) or bool(re.match(OPENINGS, found[1])))
        else:
            bare = re.sub(r"(?i)\b(inc|llc|ltd|corp)\b\.?", " ", re.sub(r"(?i)\.(io|com|ai|co|org|net)\b", " ", _fold(before)))
            words = _SIGNS.sub(" ", bare).split()
            while words and words[-1].lower() in GAP_WORDS:
                words.pop()
            n = len([w for w in _NO_WORD.split(re.sub(r"(?i)\b(inc|llc|ltd|corp)\b\.?", " ", _fold(company))) if w])
            fits = 0 < n <= len(words) and names_company(" ".join(words[-n:]), company)
        if not fits:
            continue
        role = "Co-founder" if re.match(r"(?i)co-?\s?founded", m[1]) else "Founder"
        for name in names_after_by(m[3]):
            if not any(same_person(o[0], name) for o in out):
                out.append((name, role, sentence))
    return out


_OUT = pa.schema([("page_id", pa.int64()), ("name", pa.string()), ("role", pa.string()), ("sentence", pa.string())])


def founders(pages: DataFrame) -> DataFrame:
    """(page_id, name, role, sentence) of the founders that each page's text names for its company.

    pages: page_id, company, url, title, text.  Whole texts are read; null texts and
    companies name nobody.  One person under two spellings is named once a page.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = [(i, *f) for i, company, url, title, text in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns), strict=True) if text and company for f in founders_in(text, company, url, title)]
                yield pa.record_batch([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(_OUT)], schema=_OUT)

    may = pages.where(F.col("text").rlike("(?i)founded"))
    return dealt(may.select(F.col("page_id").cast("long").alias("page_id"), "company", "url", "title", "text")).mapInArrow(read, "page_id long, name string, role string, sentence string")
