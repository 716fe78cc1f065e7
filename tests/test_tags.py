"""Tags against a plain pass over every sentence."""

import re

import pytest
import regex
from pyspark.sql import functions as F

from tessera.functions.text import ERRORS, STOP_WORDS
from tessera.operators import tags
from tessera.plans.catalog import load

FOLDER = "/root/testdata/sf0.001"
PAGES, TAGS = "company string, page long, url string, text string", "company string, tag string"


def plain_sentences(text):
    out = {}
    for part in (text, *re.split(r"\n+", text)):
        for s in re.split(r'(?<=[.!?])\s+(?=[A-Z0-9"“])', re.sub(r"\s+", " ", part)):
            s = re.sub(r"^#+\s*", "", s.strip())
            if 25 <= len(s) <= 400:
                out[s] = True
    return list(out)


def plain_quote(pages, tag):
    sides = [x.strip() for x in tag.split("/") if x.strip() and x.strip().lower() != "general"]
    if len(sides) > 1:
        return next((hit for x in sides if (hit := plain_quote(pages, x))), None)
    want = [w[:6] for w in regex.findall(r"\p{L}{4,}", re.sub(r"(?i)\bgeneral\b", "", tag).lower()) if w not in STOP_WORDS]
    for page, text in pages if want else ():
        if text is None or re.search(ERRORS, text[:1500]):
            continue
        for s in plain_sentences(text):
            toks = regex.findall(r"[\p{L}\p{N}]+", s.lower())
            at = [[i for i, t in enumerate(toks) if t.startswith(w)] for w in want]
            if not any(all(any(abs(p - q) <= 5 for p in a) for a in at) for q in at[0]):
                continue
            if not re.search(tags.ABOUT_PROTECTION, tag) and any(t.startswith(want[0][:5]) and (any(re.match(tags.PROTECTS, x) for x in toks[max(0, i - 4) : i]) or any(re.match(tags.PROTECTED, x) for x in toks[i + 1 : i + 3])) for i, t in enumerate(toks)):
                continue
            return page, s
    return None


def test_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()
    got = {(r.company, r.tag): (r.page, r.quote) if r.quote else None for r in load()[0]["tags_carried"](spark, FOLDER).collect()}
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append((r.doc_id, r.text))
    assert got == {(c, t): plain_quote(by[c], t) for c, t in got} and sum(v is not None for v in got.values()) > 5


@pytest.mark.parametrize(
    ("tag", "url", "content", "kept"),
    [
        ("Developer Tools", None, "BrowserStack provides developer tools and instant access to a cloud platform for testing websites and mobile applications. Our analytics dashboards show usage.", True),
        ("Cybersecurity / General", None, "BrowserStack provides developer tools and instant access to a cloud platform for testing websites.", False),
        ("Analytics / BI", None, "Our analytics dashboards show usage of all kinds.", True),
        ("Cloud Security", None, "The platform is entirely cloud-based and is used by car makers who need to look after vehicle security.", False),
        ("Enterprise Software", None, "The majority of the business is now focused on delivering answers to enterprise customers who subscribe to the data.", False),
        ("Cloud Security", None, "Wiz sells a cloud security platform that finds risks across cloud environments.", True),
        ("Fintech / General", None, "Sedric is an AI-based compliance platform for next-gen fintech companies and banks.", True),
        ("Industrial & Manufacturing", None, "It looks like nothing was found at this location. Manufacturing | Our Meat | Press | Contact us. Industrial and manufacturing partners welcome.", False),
        ("Banking / Neobanking", None, "STC Bank offers digital banking services, including accounts, cards and transfers that customers manage from a mobile app.", True),
        ("Insurance / Insurtech", None, "STC Bank offers digital banking services, including accounts, cards and transfers that customers manage from a mobile app.", False),
        ("Data Security", "https://pentera.io/privacy", "Data Security: this privacy policy governs how Pentera stores personal data and data security.", False),
        ("Data Security", None, "Warning: Target URL returned error 403: Forbidden. Data security is what this page was about.", False),
        ("Data Security", None, None, False),
    ],
)
def test_tags_of_one_page(spark, tag, url, content, kept):
    got = tags.supported_tags(spark.createDataFrame([("c", 1, url, content)], PAGES), spark.createDataFrame([("c", tag)] * 2, TAGS)).collect()
    assert [r.kept for r in got] == [kept]


def test_pages_that_say_nothing(spark):
    urls = {
        "https://pentera.io/privacy": True, "https://safetydocs.safetyculture.com/terms-and-conditions/?srsltid=AY": True, "https://dealhub.io/glossary/committed-arr/": True, "https://freedcamp.com/help_/tutorials/wiki/wiki_public/view/3Tbab": True, "https://www.engflow.com/company/careers": True,
        "https://kb.aampe.com/user-guide/managing-agents-strategically/experiment-overview": True, "https://scylos.com/legal": True, "https://acme.com/product": False, "no address": False,
    }
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", tags.says_nothing(F.col("u"))).collect()
    assert {r[0]: r[1] for r in got} == urls


def test_tags_are_joined_by_their_rarest_word_alone(spark):
    """A word that every sentence has makes no row for a tag that has a rarer one; no texts are broadcast."""
    pages = spark.range(300).selectExpr("'a' AS company", "id AS page", "CAST(NULL AS string) AS url", "concat('The common', if(id = 7, ' zebra', ''), ' platform runs in every place.') AS text")
    asked = spark.createDataFrame([("a", "common zebra"), ("a", "common platform")], "company string, tag string")
    found = tags.supported_tags(pages, asked)
    assert {(r.tag, r.page) for r in found.collect()} == {("common zebra", 7), ("common platform", 0)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan and "collect_set" not in plan
