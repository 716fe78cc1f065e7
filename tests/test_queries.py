"""Every registered query against its SQL twin in DuckDB; those without one against plain Python over the same tables."""

import datetime
import decimal
import math
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest
import regex

from tessera.plans.catalog import load

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        x = float(x)
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, int):
        return float(f"{x:.9g}") if abs(x) < 2**31 else x
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return datetime.datetime(x.year, x.month, x.day).isoformat()
    if isinstance(x, dict):
        return tuple(plain(v) for v in x.values())
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return bytes(x) if isinstance(x, (bytes, bytearray)) else x


def multiset(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert multiset(got.columns, got.collect()) == multiset(columns, want.fetchall())


def test_all_others_have_a_plain_version():
    assert set(QUERIES) - set(ORACLES) == {"merged_rounds", "best_sentences", "page_texts", "text_facts", "quote_checks", "round_writes", "news_events", "purchases_reported", "purchase_claims", "indexed_neighbours", "tags_carried"}


def test_texts_of_one_file_are_dealt_over_tasks(spark):
    assert QUERIES["text_facts"](spark, FOLDER).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_merged_rounds(spark, duck):
    """Each company's rounds compared pair by pair, with no cut of its dates."""
    from tessera.operators import rounds

    by, want = {}, Counter()
    for company, key, amount, day, lead in duck.execute("SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate, o_orderpriority FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey").fetchall():
        by.setdefault(company, []).append([key, amount, day, lead])
    for company, rows in by.items():
        gone = set()
        for i, (key, amount, day, lead) in enumerate(rows):
            if i in gone:
                continue
            merged = [j for j in range(i + 1, len(rows)) if j not in gone and (rows[j][2] - day).days <= rounds.DAYS and rows[j][3] == lead and abs(rows[j][1] - amount) / max(rows[j][1], amount) <= 0.10]
            gone.update(merged)
            want[company, key, "Seed", amount, len(merged)] += 1
    assert Counter(map(tuple, QUERIES["merged_rounds"](spark, FOLDER).collect())) == want


def _content(text):
    from tessera.functions.text import STOP_WORDS

    return set(regex.findall(r"\p{L}{4,}", (text or "").lower())) - set(STOP_WORDS)


def test_best_sentences(spark, duck):
    def sentences(text):
        every = [x for part in (text, *re.split(r"\n+", text)) for x in re.split(r'(?<=[.!?])\s+(?=[A-Z0-9"“])', re.sub(r"\s+", " ", part))]
        return {x for x in (re.sub(r"^#+\s*", "", x.strip()) for x in every) if 25 <= len(x) <= 400}

    every = [(doc, s, _content(s)) for doc, text in duck.execute("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall() for s in sentences(text)]
    got = {r.item_id: (r.shared, r.doc_id) for r in QUERIES["best_sentences"](spark, FOLDER).collect()}
    for item, text in duck.execute("SELECT item_id, text FROM benchmark").fetchall():
        own = _content(text)
        best = max(((len(own & words), -doc) for doc, _, words in every if own & words), default=None)
        assert got.get(item) == (best and (best[0], -best[1]))


def test_page_texts(spark, duck):
    import html as entities

    from tessera.functions.text import ERRORS

    want = {}
    for page, url, html in duck.execute("SELECT page_id, url, html FROM pages").fetchall():
        bare = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", html)
        bare = re.sub(r"(?s)<[^>]*>", " ", bare)
        for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
            bare = bare.replace(name, sign)
        day = next((m for p in (r"/((?:19|20)\d\d)[/-](\d\d)[/-](\d\d)(?=[/\-_?#]|$)", r"/home/((?:19|20)\d\d)(\d\d)(\d\d)\d{4,}", r"/((?:19|20)\d\d)(\d\d)(\d\d)(?=[/\-_?#]|$)") if (m := re.search(p, url or ""))), None)
        want[page] = (len(re.sub(r"[ \t\n\x0b\f\r]+", " ", bare).strip(" ")), bool(re.search(ERRORS, html[:1500])), "-".join(day.groups()) if day else None)
    assert entities.unescape("&amp;") == "&"
    assert {r.page_id: (r.n_chars, r.is_error, str(r.url_date) if r.url_date else None) for r in QUERIES["page_texts"](spark, FOLDER).collect()} == want


def test_text_facts(spark, duck):
    number = re.compile(r"(?i)\$?\s?(\d[\d,]*\.?\d*)\s*(thousand|million|billion|mn|bn|k|m|b)?\b", re.ASCII)
    cut = re.compile(r"(?i)(?:[:;,–—-]|\.\.\.|…)\s*$|\b(?:and|or|of|to|for|the|with)\s*$", re.ASCII)
    got = {r.doc_id: r for r in QUERIES["text_facts"](spark, FOLDER).collect()}
    for doc, text in duck.execute("SELECT doc_id, text FROM documents").fetchall():
        assert got[doc].n_numbers == len(number.findall(text)) and got[doc].is_cut == bool(cut.search(text))


def test_quote_checks(spark, duck):
    """Every item against every document; pairs without a row don't match."""
    from tessera.functions.text import best_window

    def form(text):
        bare = re.sub("['’\"“”]", "", (text or "").lower()).replace("-", " ")
        return regex.sub(r"[ \t\n\x0b\f\r]+", " ", regex.sub(r"[^\p{L}\p{N} \t\n\x0b\f\r.$%]", " ", bare)).strip(" ")

    docs = [(d, form(t)) for d, t in duck.execute("SELECT doc_id, text FROM documents").fetchall()]
    pairs = [(d, s, set(zip(s.split(), s.split()[1:]))) for d, s in docs]
    want = set()
    for item, quote in duck.execute("SELECT item_id, text FROM benchmark").fetchall():
        q = form(quote)
        own = set(zip(q.split(), q.split()[1:]))
        for d, s, held in pairs:
            if q and (q in s or len(own & held) * 2 >= len(own) and best_window(q, s) >= 0.9):
                want.add((item, d))
    assert want and {(r.item_id, r.doc_id) for r in QUERIES["quote_checks"](spark, FOLDER).where("matched").collect()} == want


def test_pairs_exist(spark):
    assert QUERIES["trigram_pairs"](spark, FOLDER).count() > 10


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
