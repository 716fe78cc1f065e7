"""Dates: precision, business days, weeks, recency."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names.
MONTHS = "january february march april may june july august september october november december".split()
_MONTH = "(" + "|".join(f"{m[:3]}(?:{m[3:]})?" for m in MONTHS) + ")"
FULL_DATE = rf"(?i)\b{_MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b"
DAY_YEAR = r"(?i)\s\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4}\b"  # what every full date holds
MONTH_DATE = rf"(?i)\b{_MONTH},?\s+(\d{{4}})\b"


def _month_number(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.substring(F.lower(name), 1, 3))


def full_date_in(text: Column) -> Column:
    """First full date written in a text (``October 15, 2024``), else null."""

    def read(found: Column) -> Column:
        month, day, year = (F.regexp_extract(found, FULL_DATE, i) for i in (1, 2, 3))
        written = F.format_string("%s-%02d-%s", year, _month_number(month), F.lpad(day, 2, "0"))
        return F.when(year != "", F.try_to_date(written, "yyyy-MM-dd"))

    first = F.when(text.rlike(DAY_YEAR), F.regexp_extract(text, FULL_DATE, 0))  # found once, then taken apart
    return F.get(F.transform(F.array(first), read), F.lit(0))


def date_precision(date: Column, quote: Column) -> Column:
    """How much of a date its quote states: day, month or year; a date that isn't a first is a day."""
    text = F.coalesce(quote, F.lit(""))
    month = F.lower(F.date_format(date, "MMM"))
    year = F.year(date).cast("string")
    first = F.dayofmonth(date) == 1
    named_day = F.coalesce(full_date_in(text) == date, F.lit(False))
    named_month = (F.substring(F.lower(F.regexp_extract(text, MONTH_DATE, 1)), 1, 3) == month) & (F.regexp_extract(text, MONTH_DATE, 2) == year)
    named_year = (F.month(date) == 1) & F.regexp(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit("[^0-9]"), year, F.lit("[^0-9]")))
    return F.when(date.isNull(), None).when(~first | named_day, "day").when(named_month, "month").when(named_year, "year").otherwise("day")


def is_business_day(date: Column) -> Column:
    return F.weekday(date) < 5


def recency_points(days: Column, full: int = 90, none: int = 180) -> Column:
    """100 up to ``full`` days, 0 from ``none``, linear between; null without a date."""
    slope = 100.0 - (days - full) / float(none - full) * 100.0
    return F.when(days.isNull(), None).when(days <= full, 100.0).when(days >= none, 0.0).otherwise(slope)


def latest_of(**dates: Column) -> tuple[Column, Column]:
    """(latest date, name of the first signal that has it)."""
    latest = F.greatest(*dates.values())
    return latest, F.coalesce(*[F.when(d == latest, name) for name, d in dates.items()])


def alert_window_hours(at: Column, hours: Column, tolerant: Column) -> Column:
    """A source's allowed silence; on Sunday and Monday a weekend-tolerant one has 72 hours at least."""
    return F.when(tolerant & F.dayofweek(at).isin(1, 2), F.greatest(hours, F.lit(72))).otherwise(hours)


def missing_index(day: Column, today: Column, days: int = 3) -> Column:
    """State of a day whose index isn't there: still to come, or none for this day after ``days``."""
    return F.when(F.datediff(today, day) > days, "no_index").otherwise("waiting")
