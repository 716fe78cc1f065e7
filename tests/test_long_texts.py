"""Rules over whole texts: what is passed over before a rule is matched takes no match away."""

import random
import re

from pyspark.sql import functions as F

from tessera.functions import classify, dates, money, text

LADDERS = (classify.SENIORITY, classify.TECHNOLOGY, classify.EARLY_WORDS, classify.GROWN_WORDS, classify.NEUTRAL_WORDS)
#: Between words, with what is no letter, a mark that joins the letter before it, letters outside ASCII, and those whose lower case is or holds an ASCII letter.
BETWEEN = ["", " ", "  ", "-", ", ", "\n", "\t", " – ", "—", "→", "_", "'s ", ". ", "é", "\u0301", " \u0301", "\u212a", "\u0130", "ß", "/", "\x85", "\u2028", "🙂", "\u00a0", "0", "$"]


def made_texts(n: int) -> list[str]:
    draw = random.Random(7)
    words = sorted({w for ladder in LADDERS for pattern, _ in ladder for w in re.findall("[a-z0-9]+", re.sub(r"\\[a-z]", " ", pattern))})
    words += ["co", "founder", "cto", "chief", "data", "officer", "c++", "first", "hire", "line", "end", "stack", "k8s", "scientist", "to", "1", "0", "partners", "sr.", "and", "of", "with"]
    case = (str, str, str.upper, str.title)
    return ["".join(draw.choice(case)(draw.choice(words)) + draw.choice(BETWEEN[:4] * 4 + BETWEEN) for _ in range(draw.randint(1, 9))) for _ in range(n)]


def plain_signals(title):
    """Every rule matched against every text."""
    t = F.trim(F.coalesce(title, F.lit("")))
    tag = lambda kind, labels: F.transform(labels, lambda v: F.concat(F.lit(f"{kind}:"), v))
    grown = classify.every_label(t, classify.GROWN_WORDS)
    early = F.when(F.size(grown) > 0, F.array().cast("array<string>")).otherwise(classify.every_label(t, classify.EARLY_WORDS))
    level = F.filter(F.array(classify.first_label(t, classify.SENIORITY)), lambda x: x.isNotNull())
    words = F.concat(early, classify.every_label(t, classify.NEUTRAL_WORDS), grown)
    return F.concat(tag("seniority", level), tag("tech_stack", classify.every_label(t, classify.TECHNOLOGY)), tag("keyword", words))


def test_signals_of_any_text(spark):
    texts = [(t,) for t in [*made_texts(6000), "", None, "Head\nof Sales", "Engineer, North", "Engineer - east coast \n"]]
    df = spark.createDataFrame(texts, "t string").repartition(4)
    got = F.transform(classify.title_signals(F.col("t")), lambda s: F.concat_ws(":", s["signal_type"], s["signal_value"]))
    both = df.select("t", got.alias("got"), plain_signals(F.col("t")).alias("want")).cache()
    assert both.where(F.size("want") > 0).count() > 3000
    assert both.where(~F.col("got").eqNullSafe(F.col("want"))).collect() == []


def test_rules_are_matched_only_where_a_text_has_their_words():
    every = {label: classify.needed_words(pattern) for ladder in LADDERS for pattern, label in ladder}
    assert [label for label, words in every.items() if [] in words] == ["C++"]
    assert every["VP"] == [["president", "vice"], ["vp"]] and ["officer"] in every["C-Level"] and ["cto"] in every["C-Level"]
    for pattern in ("", "x*", r"[a-z]foo\b", r"foo\w|bar", r"\bfoo\w*", r"(\bfoo\b)?", r"(\bfoo\b)*", r"\bfoo\b|c\+", "secondar", r"\b[^a]\b"):
        assert classify.needed_words(pattern) == [[]]


def test_ends_dates_and_figures_of_long_texts(spark):
    draw = random.Random(8)
    ends = ["and", "hand", " to", "of", ",", ":", "...", "…", "–", "the", "rest", "é and", "\u0301and", "5 bn", "1,2.", "$ 7k", "12x"]
    blanks = ["", " ", "\n", "\r\n", "\x85", "\u2028", "\u2029", "\x85\x85", "\n\x85", "\x85\n", " \u00a0", "\x0b\f", "\n\n"]
    days = ["march 5, 2024", "Mar 5th 2024", "MAY 31st, 2023 ", "xmay 1, 2024", "may 1, 20245", "june 31, 2024", "may 12 , 2024", "Oct\n7,\t2021x", "sep 0 2020", "12 2024"]
    texts = [("x" * draw.choice((0, 5, 250)) + "".join(draw.choice(ends + days + blanks) + draw.choice((" ", "", " , ")) for _ in range(draw.randint(0, 6))) + draw.choice(ends) + draw.choice(blanks) + draw.choice(blanks),) for _ in range(4000)]
    df = spark.createDataFrame([*texts, ("",), (None,)], "t string").repartition(4)
    t = F.col("t")
    month, day, year = (F.regexp_extract(t, dates.FULL_DATE, i) for i in (1, 2, 3))
    number = F.array_position(F.array(*[F.lit(m[:3]) for m in dates.MONTHS]), F.substring(F.lower(month), 1, 3))
    date = F.when(year != "", F.try_to_date(F.format_string("%s-%02d-%s", year, number, F.lpad(day, 2, "0")), "yyyy-MM-dd"))
    cut = t.rlike(rf"(?i)(?:[:;,–—-]|\.\.\.|…)\s*$|\b(?:{'|'.join(text.DANGLING)})\s*$")
    want, got = F.struct(date, cut, F.size(money.numbers_in(t))), F.struct(dates.full_date_in(t), text.cut_headline(t), money.count_numbers(t))
    both = df.select("t", want.alias("want"), got.alias("got"))
    assert both.select(F.count_if(date.isNotNull()), F.count_if(cut)).first()[0] > 300
    assert [r for r in both.collect() if tuple(r.want) != tuple(r.got)] == []
