"""Company, applicant, fund and person names as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce
from string import ascii_lowercase

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms that a company name may end in, and those that only the slug form leaves alone.
LEGAL_FORMS = r"inc|incorporated|llc|l\.l\.c|corp|corporation|company|co|ltd|limited|lp|l\.p|llp|plc|pbc|gmbh|ag|s\.a|n\.v|b\.v|pty|oy|ab|as|sas|srl|pte|kk|kg"
SLUG_FORMS = r"inc|incorporated|llc|l\.l\.c|corp|corporation|company|co|ltd|limited|lp|l\.p|llp|plc|pbc|gmbh|s\.a|n\.v|b\.v|pty|ag"
FUND_FORMS = r"l\.?p\.?|llp|llc|l\.?l\.?c\.?|ltd|limited partnership|limited|inc|incorporated|corp|corporation|fund|trust"
# Vintage numerals of fund names.
ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv")
VINTAGE = r"[\s,-]+(" + "|".join(ROMAN) + r"|[0-9]{1,2})$"


def _text(name) -> Column:
    return F.lower(F.trim(F.coalesce(name, F.lit(""))))


def _without_ending(name: Column, forms: str, turns: int) -> Column:
    return reduce(lambda c, _: F.regexp_replace(c, rf"[\s,.]+({forms})\.?$", ""), range(turns), name)


def _blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def company_name_key(name: Column) -> Column:
    """Lower-case words of a name without (at most two) legal forms at its end; blank is null."""
    bare = _without_ending(F.replace(_text(name), F.lit("&"), F.lit(" and ")), LEGAL_FORMS, 2)
    return _blank_to_null(F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " ")))


def company_slug(name: Column) -> Column:
    """Hyphenated form of a name; null under two characters."""
    bare = _without_ending(F.replace(_text(name), F.lit("&"), F.lit(" and ")), SLUG_FORMS, 2)
    slug = F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.length(slug) >= 2, slug)


def applicant_key(name: Column) -> Column:
    """Lower-case words of a patent applicant without its country tag and punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\[[a-z]{2}\]", " "), "[^a-z0-9]+", " "))


def fund_firm_name(name: Column) -> Column:
    """The firm behind a fund vehicle: legal forms and vintage removed, then once more what that uncovers."""
    bare = F.regexp_replace(_without_ending(_text(name), FUND_FORMS, 2), VINTAGE, "")
    return _blank_to_null(F.trim(_without_ending(bare, FUND_FORMS, 1)))


def fund_series_number(name: Column) -> Column:
    """Vintage number at the end of a fund name, null without one."""
    mark = F.regexp_extract(_without_ending(_text(name), FUND_FORMS, 1), VINTAGE, 1)
    roman = F.create_map(*[F.lit(x) for i, r in enumerate(ROMAN) for x in (r, i + 1)])
    return F.when(mark.rlike("^[0-9]+$"), mark.cast("int")).otherwise(F.try_element_at(roman, mark))


def investor_key(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), "[.,]", ""), r"\s+", " ")


def investors_match(a: Column, b: Column) -> Column:
    """Whether two names may be one firm: equal, or one within the other; empty matches nothing."""
    x, y = investor_key(a), investor_key(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


#: Latin letters that decompose into a plain one and marks, and that plain one; by Unicode's own tables.
ACCENTED = "".join(c for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))) if unicodedata.normalize("NFD", c)[0] in ascii_lowercase)
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in ACCENTED)


def person_words(name: Column) -> Column:
    """Words of a name, marks off letters, without titles and single letters."""
    bare = F.translate(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[\u0300-\u036f]", ""), ACCENTED, PLAIN)
    named = F.regexp_replace(bare, r"\b(dr|mr|mrs|ms|prof)\.?\s", " ")  # fixed values
    return F.filter(F.split(named, "[^a-z]+"), lambda w: F.length(w) > 1)


def same_person(a: Column, b: Column) -> Column:
    """Equal first and last name, a first name that begins the other (3 letters or more), or one edit in a surname of 5 or more."""
    x, y = person_words(a), person_words(b)
    enough = (F.size(x) >= 2) & (F.size(y) >= 2)
    fa, fb, la, lb = F.get(x, F.lit(0)), F.get(y, F.lit(0)), F.get(x, F.size(x) - 1), F.get(y, F.size(y) - 1)
    short = F.least(F.length(fa), F.length(fb)) >= 3
    begins = short & (F.startswith(fa, fb) | F.startswith(fb, fa))
    near = (F.least(F.length(la), F.length(lb)) >= 5) & (F.levenshtein(la, lb) <= 1)
    return F.coalesce(enough & (((la == lb) & ((fa == fb) | begins)) | ((fa == fb) & near)), F.lit(False))


def tags(raw: Column, most: int = 30, longest: int = 40) -> Column:
    """Trimmed, collapsed and cut tags; of those equal but for case the first; ``most`` of them."""
    clean = F.filter(F.transform(raw, lambda t: F.substring(F.regexp_replace(F.trim(t), r"\s+", " "), 1, longest)), lambda t: t != "")
    first = F.filter(clean, lambda t, i: F.array_position(F.transform(clean, F.lower), F.lower(t)) == i + 1)
    return F.slice(first, 1, most)
