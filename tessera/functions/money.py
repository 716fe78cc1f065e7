"""Amounts, numbers in prose, and currency conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that scale a number.
SCALES = {"k": 1e3, "thousand": 1e3, "m": 1e6, "mn": 1e6, "million": 1e6, "b": 1e9, "bn": 1e9, "billion": 1e9}
# A figure with its scale.
FIGURE = r"(\d[\d,]*\.?\d*)\s*(thousand|million|billion|mn|bn|k|m|b)?\b"
NUMBER = rf"(?i)\$?\s?{FIGURE}"


def _scaled(digits: Column, word: Column) -> Column:
    scale = F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv])
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("double") * F.coalesce(F.try_element_at(scale, F.lower(word)), F.lit(1.0))


def parse_amount(text: Column) -> Column:
    """``1.5m``, ``$250k`` or ``1,000`` as a number; anything else is null."""
    form = r"(?i)^\s*\$?\s*([\d,]*\.?\d+)\s*(thousand|million|billion|mn|bn|k|m|b)?\s*$"
    return F.when(text.rlike(form), _scaled(F.regexp_extract(text, form, 1), F.regexp_extract(text, form, 2)))


def numbers_in(text: Column) -> Column:
    """Every figure in a text, scaled, in order."""
    digits, words = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)), F.regexp_extract_all(text, F.lit(NUMBER), F.lit(2))
    return F.filter(F.zip_with(digits, words, _scaled), lambda x: x.isNotNull())


def count_numbers(text: Column) -> Column:
    """How many figures ``numbers_in`` finds: each has a value, and what may stand before its first digit takes none away."""
    return F.size(F.regexp_extract_all(text, F.lit(f"(?i){FIGURE}"), F.lit(0)))


def states_number(text: Column, value: Column) -> Column:
    """Whether a text states the value: within 0.01, or a thousandth of it."""
    return F.exists(numbers_in(text), lambda x: (F.abs(x - value) < 0.01) | ((value != 0) & (F.abs(x - value) / F.abs(value) < 0.001)))


def short_usd(amount: Column) -> Column:
    """``$1.2B``, ``$3M``, ``$45K``, ``$7``; null at zero and below."""

    def scaled(by: float) -> Column:
        return F.regexp_replace(F.format_string("%.1f", F.round(amount / by, 1)), r"\.0$", "")

    whole = F.round(amount).cast("long").cast("string")
    return (
        F.when(amount.isNull() | (amount <= 0), None)
        .when(amount >= 1e9, F.concat(F.lit("$"), scaled(1e9), F.lit("B")))
        .when(amount >= 1e6, F.concat(F.lit("$"), scaled(1e6), F.lit("M")))
        .when(amount >= 1e3, F.concat(F.lit("$"), F.round(amount / 1e3).cast("long").cast("string"), F.lit("K")))
        .otherwise(F.concat(F.lit("$"), whole))
    )


def close(a: Column, b: Column, share: float) -> Column:
    """Two positive amounts within a share of the larger."""
    return F.coalesce((a > 0) & (b > 0) & (F.abs(a - b) / F.greatest(a, b) <= share), F.lit(False))


def to_usd(df: DataFrame, rates: DataFrame, *, amount: str, currency: str, year: str, out: str = "amount_usd") -> DataFrame:
    """Add ``out``: the amount at the yearly rate (currency, year, usd_per_unit) of its year.

    A year outside the table takes the nearest one of its currency; an unknown
    currency gives null.  ``rates`` is a row per currency and year.
    """
    span = rates.groupBy(F.upper("currency").alias("rate_currency")).agg(F.min("year").alias("from_year"), F.max("year").alias("to_year"))
    spanned = df.join(span, F.upper(F.col(currency)) == span["rate_currency"], "left")
    at = F.least(F.greatest(F.col(year), F.col("from_year")), F.col("to_year"))
    keyed = rates.select(F.upper("currency").alias("rate_of"), F.col("year").alias("rate_year"), "usd_per_unit")
    joined = spanned.withColumn("at_year", at).join(keyed, (F.col("rate_currency") == F.col("rate_of")) & (F.col("at_year") == F.col("rate_year")), "left")
    return joined.select(*df.columns, (F.col(amount) * F.col("usd_per_unit")).alias(out))


# Marks right before and right after a figure, for each currency, in the order they are tried.
_AFTER = r"^\s?(million|billion|mn|bn|m|b|k)?\s*"
MARKS: list[tuple[str, str, str]] = [
    ("EUR", r"(?i)(€|\bEUR|\beuros?)\s?$", r"(euros?\b|EUR\b)"),
    ("GBP", r"(?i)(£|\bGBP)\s?$", r"(pounds?( sterling)?\b|GBP\b)"),
    ("CHF", r"\bCHF\s?$", r"(Swiss francs?\b|CHF\b)"),
    ("INR", r"(₹|\bINR|\bRs\.?)\s?$", r"(rupees?\b|INR\b)"),
    ("ILS", r"(₪|\bNIS|\bILS)\s?$", r"(shekels?\b|NIS\b|ILS\b)"),
    ("JPY", r"(¥|\bJPY)\s?$", r"(yen\b|JPY\b)"),
    ("CAD", r"(C\$|\bCAD)\s?$", r"(Canadian dollars?\b|CAD\b)"),
    ("AUD", r"(A\$|\bAUD)\s?$", r"(Australian dollars?\b|AUD\b)"),
    ("SEK", r"\bSEK\s?$", r"(kronor\b|SEK\b)"),
]


def currency_of(amount: Column, quote: Column) -> Column:
    """Currency in which a quote writes the amount: the mark beside the figure that equals it; USD without a mark, null without the figure.

    The quote is cut at its figures; each keeps what stands before and after it.
    """
    figures = F.regexp_extract_all(quote, F.lit(r"\d[\d,]*\.?\d*"), F.lit(0))
    between = F.split(quote, r"\d[\d,]*\.?\d*")

    def read(figure: Column, i: Column) -> Column:
        before, after = F.get(between, i), F.get(between, i + 1)
        scale = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv]), F.lower(F.regexp_extract(after, r"(?i)^\s*(thousand|million|billion|mn|bn|k|m|b)\b", 1))), F.lit(1.0))
        value = F.replace(figure, F.lit(","), F.lit("")).try_cast("double") * scale
        marked = [F.when(F.right(before, F.lit(6)).rlike(pre) | after.rlike(f"(?i){_AFTER}{post}"), code) for code, pre, post in MARKS]
        dollars = F.right(before, F.lit(6)).rlike(r"(?i)(US\$|\bUSD)\s?$")
        return F.struct((F.abs(value - amount) / amount <= 0.005).alias("same"), F.when(dollars, "USD").otherwise(F.coalesce(*marked, F.lit("USD"))).alias("currency"))

    hits = F.filter(F.transform(figures, read), lambda x: x["same"])
    return F.when(amount > 0, F.get(hits, F.lit(0))["currency"])


def readings(token: Column) -> Column:
    """Array of the values that a written number can mean: ``,``, ``.`` and blanks between thousands, or a decimal mark."""
    bare = F.regexp_replace(token, r"[\s\u00a0](?=\d{3}(\D|$))", "")
    marks = F.regexp_replace(bare, "[^.,]", "")
    last = F.regexp_extract(bare, r"[.,](\d*)$", 1)
    digits = F.regexp_replace(bare, "[.,]", "").try_cast("double")
    whole = F.regexp_replace(F.regexp_extract(bare, r"^(.*)[.,]\d*$", 1), "[.,]", "")
    decimal = F.concat(whole, F.lit("."), last).try_cast("double")
    both = F.contains(marks, F.lit(".")) & F.contains(marks, F.lit(","))
    return (
        F.when(marks == "", F.array(digits))
        .when(both, F.array(decimal))
        .when(F.length(marks) > 1, F.array(digits))
        .when(F.length(last) == 3, F.array(digits, decimal))
        .otherwise(F.array(decimal))
    )


def sold_share(sold: Column, target: Column) -> Column:
    """Percent of an offering that is sold, 100 at most; null where either side is unknown."""
    known = (target > 0) & (sold >= 0)
    return F.when(known, F.least(F.lit(100.0), F.round(sold / target * 100))).cast("int")
