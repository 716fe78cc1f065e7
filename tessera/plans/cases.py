"""Rules on values that are written out: each query applies one rule to every part's case, with the answers as its SQL twin.

A part's case is its key modulo the number of cases.  The answers in the SQL are
set down by hand from what the rule is to say; nothing here is made from the rule.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import classify, dates, money, names, text, web
from tessera.operators import resolve, scoring
from tessera.plans.catalog import ORACLES, QUERIES
from tessera.sources.tables import table


def _literal(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def rule_query(name: str, what: str, schema: str, cases: list[tuple[Any, ...]], rule: Callable[..., Column]) -> None:
    """Register a query: ``cases`` hold the rule's inputs by ``schema`` and, last, the answer as text."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(spark, sf_dir):
        inputs = spark.createDataFrame([(i, *case[:-1]) for i, case in enumerate(cases)], f"case_no long, {schema}")
        parts = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % len(cases)).alias("case_no"))
        answer = rule(*map(F.col, columns))
        return parts.join(F.broadcast(inputs), "case_no").select("p_partkey", "case_no", answer.cast("string").alias("answer"))

    run.__name__, run.__doc__ = name, what
    answers = ", ".join(f"({i}, {_literal(case[-1])})" for i, case in enumerate(cases))
    QUERIES[name] = run
    ORACLES[name] = f"SELECT p_partkey, CAST(case_no AS BIGINT) AS case_no, answer FROM part JOIN (VALUES {answers}) x(case_no, answer) ON p_partkey % {len(cases)} = case_no"


def _listed(c: Column) -> Column:
    return F.array_join(c, ",")


def _yes(c: Column) -> Column:
    return F.when(c, "yes").otherwise("no")


def _day(c: Column) -> Column:
    return c.cast("date")


rule_query("title_signals", "Signals of job titles.", "t string", [
    ("Founding Senior Engineer", "seniority:Founding"),
    ("Founding Account Executive", "seniority:Founding,keyword:Sales Org"),
    ("First Sales Rep", "seniority:First Hire"),
    ("First Line Manager", ""),
    ("Lead Generation Specialist", ""),
    ("Tech Lead, Go", "seniority:Lead,tech_stack:Go"),
    ("Ruby on Rails Engineer", "tech_stack:Ruby"),
    ("Scala and Elixir Developer", "tech_stack:Scala,tech_stack:Elixir"),
    ("Senior Node.js Engineer", "seniority:Senior,tech_stack:Node.js"),
    ("Terraform Specialist (AWS)", "tech_stack:Terraform,tech_stack:AWS"),
    ("Solidity Engineer", "tech_stack:Solidity"),
    ("MLOps Engineer", "tech_stack:MLOps"),
    ("iOS Engineer", "tech_stack:iOS"),
    ("Android Engineer", "tech_stack:Android"),
    ("Staff SRE, Infrastructure", "seniority:Staff,tech_stack:SRE,tech_stack:Infrastructure"),
    ("C++ Engineer", "tech_stack:C++"),
    ("JavaScript Developer", "tech_stack:JavaScript"),
    ("Enterprise Account Executive - Central", "keyword:Sales Org,keyword:Enterprise GTM,keyword:Territory Org"),
    ("Solutions Engineer, EMEA", "keyword:Enterprise GTM,keyword:Territory Org"),
    ("Account Executive, Greenfield", "keyword:Sales Org"),
    ("Greenfield Product Designer", "keyword:Greenfield"),
    ("KYC Analyst", "keyword:Compliance Org"),
    ("AML Operations", "keyword:Compliance Org"),
    ("Head of Partnerships", "seniority:Head of,keyword:Partnerships Org"),
    ("Engineer, stealth mode startup", "keyword:Stealth"),
    ("Secure Manufacturing & Stealth Partner", ""),
    ("CTO", "seniority:C-Level"),
    ("Full-Stack Python Engineer (Remote)", "tech_stack:Python,tech_stack:Full Stack,keyword:Remote"),
    ("   ", ""),
    (None, ""),
], lambda t: _listed(F.transform(classify.title_signals(t), lambda s: F.concat_ws(":", s["signal_type"], s["signal_value"]))))

rule_query("candidate_sectors", "Sectors that filings reveal.", "source string, n string, grp string, codes array<string>, title string, abstract string", [
    ("sec_form_d", "Helix One Inc", "Biotechnology", None, None, None, "Health & Life Sciences"),
    ("uk_companies_house", "Plain Ltd", None, ["72110"], None, None, "Health & Life Sciences"),
    ("uk_companies_house", "Plain AI Ltd", None, ["62012", "26110"], None, None, "DeepTech"),
    ("sec_form_d", "Deep Learning Works", "Other Technology", None, None, None, "AI & ML"),
    ("sec_form_d", "Superpower Inc", "Other", None, None, None, None),
    ("epo_ops", "Acme", None, None, "A battery cell", None, "Climate & Energy"),
    ("epo_ops", "Acme", None, None, "A cell", "relates to photonics", "DeepTech"),
    ("sec_form_d", "Acme", None, None, "A battery cell", None, None),
    ("sec_form_d", "Swift Payments Co", None, None, None, None, "Fintech"),
    ("sec_form_d", None, None, None, None, None, None),
], lambda source, n, grp, codes, title, abstract: classify.candidate_sector(source, n, F.struct(grp.alias("industry_group"), codes.alias("codes"), title.alias("title"), abstract.alias("abstract"))))

rule_query("candidate_stages", "Stages that filings are consistent with.", "source string, offering string, sold string", [
    ("uk_companies_house", None, None, "pre-seed,seed"),
    ("sec_form_d", "2499999", None, "pre-seed,seed"),
    ("sec_form_d", "2500000", None, "seed,series-a"),
    ("sec_form_d", "0", "12000000.50", "series-a,series-b"),
    ("sec_form_d", "Indefinite", "40000000", "series-b,growth"),
    ("sec_form_d", None, None, None),
    ("epo_ops", "5000000", None, None),
], lambda source, offering, sold: _listed(classify.candidate_stages(source, offering, sold)))

rule_query("archetypes", "Venture-backed or mature, and why.", "founded int, staff int, buyout boolean, early boolean, venture boolean", [
    (2015, 10, True, True, True, "mature_private: buyout_or_acquisition_on_record"),
    (2000, 10, False, False, True, "mature_private: active_15_plus_years,no_recent_early_stage_round"),
    (2000, 10, False, True, True, "venture_backed: venture_profile"),
    (2020, 800, False, False, False, "mature_private: large_headcount,no_recent_vc_round"),
    (2020, 749, False, False, False, "venture_backed: venture_profile"),
    (None, None, False, False, False, "venture_backed: venture_profile"),
    (1700, 5, False, False, False, "venture_backed: venture_profile"),
], lambda founded, staff, buyout, early, venture: (lambda a: F.concat(a["archetype"], F.lit(": "), _listed(a["reasons"])))(classify.archetype(founded, staff, buyout, early, venture, F.lit("2026-01-01").cast("date"))))

rule_query("momentum_sectors", "Sector of an industry for the score's momentum.", "t string", [
    ("Generative video", "ai-ml"), ("NLP tooling", "ai-ml"), ("Payments", "fintech"), ("Identity", "cybersecurity"), ("Low-code", "saas-devtools"), ("Retail tech", "ecommerce-retail"),
    ("Biotech", "health-lifesci"), ("Carbon removal", "climate-energy"), ("CRM", "enterprise-sw"), ("Travel", "consumer-media"), ("Space tech", "deeptech"), ("Farming", None), (None, None),
], classify.momentum_sector)

rule_query("sector_ladder", "Parent sectors of industries.", "t string", [
    ("Machine Learning", "AI & ML"), ("AI compliance", "Fintech"), ("Applied AI", "AI & ML"), ("Zero Trust", "Cybersecurity"), ("Developer tools", "SaaS & Dev Tools"), ("Supply chain", "E-commerce & Retail"),
    ("Mental health", "Health & Life Sciences"), ("Renewable power", "Climate & Energy"), ("HR tech", "Enterprise Software"), ("Games", "Consumer & Media"), ("Quantum sensors", "DeepTech"), ("Plumbing", "Uncategorized"),
    ("Chains", "Uncategorized"), ("  ", "Uncategorized"), (None, "Uncategorized"),
], classify.sector)

rule_query("round_labels", "Canonical round labels.", "t string", [
    ("pre seed", "Pre-Seed"), ("Seed round", "Seed"), ("series seed", "Series F+"), ("SERIES A-1", "Series A"), ("Series B", "Series B"), ("Series H", "Series F+"), ("growth equity", "Growth"), ("Venture debt", "Venture Debt"),
    ("term loan", "Debt"), ("Secondary sale", "Secondary"), ("SAFE", "Convertible Note"), ("LBO", "PE Buyout"), ("grant", "Grant"), ("acquisition", "Acquired"), ("NASDAQ listing", "IPO"), ("Angel", "Other"), ("", "Unknown"), (None, "Unknown"),
], classify.round_label)

rule_query("refined_round_labels", "Round labels that the evidence has to name.", "t string, evidence string", [
    ("Angel", "a strategic investment", "Other"), ("Angel", "an angel round", "Unknown"), ("Angel", None, "Unknown"), ("Seed", None, "Seed"), ("undisclosed", "raised by equity crowdfunding", "Other"), (None, "strategic", "Unknown"),
], classify.refined_round_label)

rule_query("capital_kinds", "Equity, debt or neither.", "t string", [
    ("Series A", "equity"), ("venture debt", "debt"), ("credit facility", "debt"), ("IPO", "not_capital"), ("Grant", "not_capital"), ("buyout", "not_capital"), ("Bootstrapped", "not_capital"), (None, "equity"),
], classify.capital_kind)

rule_query("stage_groups", "Early, growth, late or unknown.", "t string", [
    ("Seed", "early"), ("Bridge", "early"), ("Series B", "growth"), ("Series C", "late"), ("IPO", "late"), ("Grant", "unknown"), ("Other", "unknown"), ("Anything new", "late"), (None, "unknown"),
], classify.stage_group)

rule_query("headcount_bands", "Headcount ranges.", "n int", [
    (1, "1-10"), (10, "1-10"), (11, "11-50"), (200, "51-200"), (201, "201-500"), (1000, "501-1000"), (5000, "1001-5000"), (5001, "5001-10000"), (10000, "5001-10000"), (10001, "10001+"), (0, None), (None, None),
], classify.headcount_band)

rule_query("search_ranks", "Rank of a text for the search ``acme``.", "t string", [
    ("Acme", "0"), ("ACME Labs", "1"), ("The Acme Group", "2"), ("Placmed acmeish", "2"), ("Megacme", "3"), ("Foo-Acme", "2"), ("  Acme ", "0"), ("Other", "4"), (None, "4"),
], lambda t: classify.search_rank(t, " acme "))

rule_query("field_confidences", "Confidence of a field by its sources.", "types array<string>", [
    (["news", "registry"], "90"), (["company_site"], "75"), (["press_release", "news"], "75"), (["news", "news"], "75"), (["news"], "55"), (["aggregator_snippet"], "40"), (["model_inferred"], "0"), ([], "0"),
], classify.field_confidence)

rule_query("data_groups", "How much is known of a company.", "d string, city string, country string, founded int, rounds int, founders int", [
    (None, None, None, None, 0, 0, "empty"), (" ", "", None, 0, 0, 0, "empty"), ("short", None, None, None, 0, 0, "partial"), ("x" * 200, "Oslo", None, 2000, 1, 2, "full"), ("x" * 199, "Oslo", None, 2000, 1, 2, "partial"), ("x" * 200, None, "NO", 2000, 1, 0, "partial"),
], classify.data_group)

rule_query("work_tiers", "Order of work.", "d string, staff int, rounds boolean, rivals int", [
    (None, None, False, 0, "1"), ("", 0, False, 3, "1"), ("d", None, False, 0, "2"), ("d", 5, True, 1, "3"), ("d", 5, True, 0, "2"), (None, None, True, None, "2"),
], classify.work_tier)

rule_query("host_regions", "Region of a host.", "h string", [
    ("a.co.il", "israel"), ("a.co.uk", "uk_ireland"), ("a.ie", "uk_ireland"), ("a.de", "europe"), ("a.ca", "north_america"), ("a.com.au", "asia_pacific"), ("a.com.br", "latin_america"), ("a.ae", "middle_east_africa"), ("a.co", "generic"), ("a.com", "generic"), ("il", "generic"), (None, "generic"),
], classify.region)

rule_query("offering_gates", "Quality gate of offering notices.", "n string, grp string, fund boolean, fresh boolean", [
    ("Acme Inc", "Computers", False, True, "alert"),
    ("Acme Inc", "Computers", False, False, "queue"),
    ("Acme Robotics Inc", "Manufacturing", False, True, "queue"),
    ("Acme Widgets Inc", "Manufacturing", False, True, "reject industry:Manufacturing"),
    ("Acme Inc", None, False, True, "reject industry:none"),
    ("Acme Fund I", "Technology", True, True, "reject investment_fund,vehicle_name:fund"),
    ("Acme Holdings", "Biotechnology", None, None, "reject vehicle_name:holdings"),
    (None, "Restaurants", False, True, "reject industry:Restaurants"),
], lambda n, grp, fund, fresh: (lambda g: F.concat_ws(" ", g["tier"], F.nullif(_listed(g["reasons"]), F.lit(""))))(classify.offering_gate(n, grp, fund, fresh)))

rule_query("applicant_gates", "Quality gate of patent applicants.", "n string, excluded boolean", [
    ("Acme Robotics Inc", False, "queue"),
    ("Park Jonghyun", False, "reject individual_applicant"),
    ("IDEMIA PUBLIC SECURITY FRANCE", False, "queue"),
    ("University of Somewhere", False, "reject institution"),
    ("Ford Global Technologies, LLC", True, "reject excluded_applicant,corporate_ip_vehicle"),
    ("Unassigned publication", False, "reject no_company_applicant"),
    ("Jane Roe (inventor-held)", False, "reject no_company_applicant"),
    ("", True, "reject no_company_applicant"),
    (None, None, "reject no_company_applicant"),
], lambda n, excluded: (lambda g: F.concat_ws(" ", g["tier"], F.nullif(_listed(g["reasons"]), F.lit(""))))(classify.applicant_gate(n, excluded)))

rule_query("filing_classes", "Why a filing isn't eligible.", "n string, fund boolean, grp string", [
    (None, True, "Computers", "no_name"), ("", False, "Computers", "no_name"), ("Acme", True, None, "fund"), ("Acme", False, "Restaurants", "not_tech"), ("Acme AI", False, "Other", None), ("Acme", False, "Other", "not_tech"), ("Acme", None, "Telecommunications", None),
], classify.filing_class)

rule_query("fund_gates", "Reasons against a fund filing.", "n string, kind string", [
    ("Acme Ventures II, L.P.", "Venture Capital Fund", ""), ("Acme SPV 3 LLC", "Venture Capital Fund", "vehicle_name:spv"), ("Acme Fund", "Hedge Fund", "fund_type:Hedge Fund"), ("Acme Feeder", None, "fund_type:none,vehicle_name:feeder"),
], lambda n, kind: _listed(classify.fund_gate(n, kind)))

rule_query("run_classes", "Outcome of a source's run.", "status int, error string, dry boolean, failures int, n int", [
    (200, None, False, 0, 5, "ok"), (200, None, False, 0, 0, "empty"), (200, None, False, 2, 5, "partial"), (200, None, False, 2, 0, "error"), (200, None, True, 0, 0, "dry_run"), (500, None, True, 0, 9, "error"), (200, "broken", None, None, 3, "error"),
], classify.run_class)

rule_query("company_slugs", "Hyphenated company names.", "n string", [
    ("Acme & Sons, Inc.", "acme-and-sons"), ("ACME Holdings Company LLC", "acme-holdings"), ("A", None), ("  Über GmbH ", "ber"), ("Oy Acme AB", "oy-acme-ab"), ("", None), (None, None),
], names.company_slug)

rule_query("applicant_keys", "Keys of patent applicants.", "n string", [
    ("ACME CORP. [US]", "acme corp"), ("Acme-Works, Ltd", "acme works ltd"), ("[JP]", ""), (None, ""),
], names.applicant_key)

rule_query("fund_names", "Firm and number of a fund.", "n string", [
    ("Northstar Ventures IV, L.P.", "northstar ventures/4"), ("Acme Growth Fund 12 LLC", "acme growth/12"), ("Acme Capital", "acme capital/none"), ("Acme XV LP", "acme/15"), (None, "none/none"),
], lambda n: F.concat_ws("/", F.coalesce(names.fund_firm_name(n), F.lit("none")), F.coalesce(names.fund_series_number(n).cast("string"), F.lit("none"))))

rule_query("same_people", "Whether two names are one person's.", "a string, b string", [
    ("Jean-Louis Queguiner", "Jean-Louis Quéguiner", "yes"), ("John A. Smith", "John Smith", "yes"), ("John Smith", "Jane Smith", "no"), ("Mitch Stewart", "Mitchell Stewart", "yes"), ("Albert Sebag", "Albert Sebago", "yes"), ("Dan Cohen", "Dan Cohn", "no"), ("Dr. Jane Roe", "Jane Roe", "yes"), ("Jane Roe J", "Jane Roe", "yes"), ("Šimon Novák", "Simon Novak", "yes"), ("José García", "Jose Garcia", "yes"), ("Dan Smith", "Daniel Smith", "yes"), ("Al Smith", "Alan Smith", "no"), ("Jane Petersen", "Jane Peterson", "yes"), ("Jane Roe", "Jane Doe", "no"), ("Smith", "Smith", "no"), ("Jane Smith", "John Smith", "no"), (None, "Jane Smith", "no"),
], lambda a, b: _yes(names.same_person(a, b)))

rule_query("investor_matches", "Whether two investor names may be one firm's.", "a string, b string", [
    ("Acme Capital, L.P.", "acme capital", "yes"), ("Acme", "Acme Ventures", "yes"), ("Acme", "Apex", "no"), ("", "Acme", "no"), (None, None, "no"),
], lambda a, b: _yes(names.investors_match(a, b)))

rule_query("tag_lists", "Cleaned tags.", "t array<string>", [
    (["  AI ", "fintech", "AI", "ai"], "AI,fintech"), (["a  b", "a b", ""], "a b"), (["x" * 50], "x" * 40), ([], ""),
], lambda t: _listed(names.tags(t)))

rule_query("filing_links", "Addresses of filings.", "entity string, accession string", [
    ("0001234", "0001-22-3", "https://x/1234/0001223/"), ("12a", "0001-22-3", None), ("12", "x", None), (None, "1", None),
], lambda entity, accession: web.filing_url("https://x/", entity, accession))

rule_query("hosted_owners", "Organisations in addresses of a hosting site.", "u string", [
    ("https://github.com/Acme/tool", "acme"), ("http://www.github.com/Acme?x", "acme"), ("https://gitlab.com/acme", None), ("github.com/acme", None), (None, None),
], lambda u: web.hosted_owner(u, r"github\.com"))

rule_query("clean_links", "Addresses without tracking.", "u string", [
    ("https://speechify.com/news/speechify-launches-voice-ai-assistant-ios/?srsltid=AYCX9vK7jeP", "https://speechify.com/news/speechify-launches-voice-ai-assistant-ios/"), ("https://a.com/x?id=3&utm_source=tw&utm_medium=s", "https://a.com/x?id=3"), ("not a url", "not a url"),
    ("https://a.com/x?utm_source=b", "https://a.com/x"), ("https://a.com/x?a=1&utm_medium=b&c=2", "https://a.com/x?a=1&c=2"), ("https://a.com/?ref=z&b=1#top", "https://a.com/?ref=z&b=1#top"), ("https://a.com/x?MSCLKID=1&igshid=2&ref_src=3#y", "https://a.com/x#y"), ("https://A.com?x=1", "https://a.com/?x=1"), (None, None),
], web.without_tracking)

rule_query("own_domains", "Whether a host may be a company's own.", "h string", [
    ("acme.com", "yes"), ("acme.github.io", "no"), ("github.com", "no"), ("notgithub.com", "yes"), ("x.com", "no"), ("box.com", "yes"), ("localhost", "no"), ("", "no"), (None, "no"),
], lambda h: _yes(web.own_domain(h)))

rule_query("profile_links", "Canonical profile addresses.", "u string", [
    ("https://uk.linkedin.com/in/Jane-Roe/?x=1", "https://www.linkedin.com/in/jane-roe"), ("http://linkedin.com/in/a%20b", "https://www.linkedin.com/in/a b"), ("https://linkedin.com/company/acme", None), ("linkedin.com/in/x", None), (None, None),
], web.profile_url)

rule_query("same_sites", "Whether two addresses are one site's.", "a string, b string", [
    ("https://www.acme.com/x", "acme.com", "yes"), ("https://shop.acme.co.uk", "acme.co.uk", "yes"), ("acme.com", "acme.org", "no"), ("a.acme.com", "b.acme.com", "yes"), (None, "acme.com", "no"),
], lambda a, b: _yes(web.same_site(a, b)))

rule_query("link_dates", "Dates in addresses, seen on 2026-11-28.", "u string", [
    ("https://siliconangle.com/2024/11/06/crowdstrike-acquires-cloud-security-provider-adaptive-shield/", "2024-11-06"), ("https://www.businesswire.com/news/home/20240919738626/en/Adaptive-Shield-Honored", "2024-09-19"), ("https://www.globenewswire.com/news-release/2026/10/21/3385717/0/en/x.html", "2026-10-21"), ("https://www.freightwaves.com/news/datatruck-raises-12m", None), ("https://techcrunch.com/2021/09/29/gamitee-becomes-joyned/", "2021-09-29"),
    ("https://a.com/x-2023-12-31", None), ("https://a.com/2023-12-31", "2023-12-31"), ("https://a.com/2024/13/01/", None), ("https://a.com/20240309", "2024-03-09"), ("https://a.com/2027/01/01/", None), ("https://a.com/1989/01/01/", None), (None, None),
], lambda u: web.url_date(u, F.lit("2026-11-28").cast("date")))

rule_query("html_forms", "Entities and markup, there and back.", "t string", [
    ("<p>A &amp; B</p>", "A & B|&lt;p&gt;A &amp;amp; B&lt;/p&gt;"), ("a<script>x<y</script>b", "a b|a&lt;script&gt;x&lt;y&lt;/script&gt;b"), ("\"it's\"", "\"it's\"|&quot;it&#39;s&quot;"),
], lambda t: F.concat_ws("|", web.html_text(t), web.escape_html(t)))

rule_query("script_objects", "Objects that a page's script assigns.", "t string", [
    ("<script>window.data = {\"a\": {\"b\": 1}};</script>", "1"), ("<script>data={\"a\":{\"b\":\"x\"}}</script>", "x"), ("<p>data</p>", None),
], lambda t: F.get_json_object(web.script_json(t, "data"), "$.a.b"))

rule_query("money_parsed", "Typed amounts.", "t string", [
    ("1.5m", "1500000.0"), ("$250k", "250000.0"), ("1,000", "1000.0"), ("2 Billion", "2.0E9"), ("about 5", None), ("", None), (None, None),
], money.parse_amount)

rule_query("numbers_found", "Figures in texts.", "t string", [
    ("raised $2.5 million from 3 funds", "2500000.0,3.0"), ("1,200 staff and 4bn", "1200.0,4.0E9"), ("none", ""), (None, None),
], lambda t: _listed(money.numbers_in(t).cast("array<string>")))

rule_query("numbers_stated", "Whether a text states a value.", "t string, v double", [
    ("raised $2.5 million", 2500000.0, "yes"), ("raised $2.5 million", 2600000.0, "no"), ("1,001 staff", 1000.5, "yes"), ("nothing", 1.0, "no"),
], lambda t, v: _yes(money.states_number(t, v)))

rule_query("number_readings", "What a written number can mean.", "t string", [
    ("2.500", "2500.0,2.5"), ("2,5", "2.5"), ("1.234,56", "1234.56"), ("1,234.56", "1234.56"), ("1.234.567", "1234567.0"), ("2 500", "2500.0"), ("42", "42.0"),
], lambda t: _listed(money.readings(t).cast("array<string>")))

rule_query("amount_currencies", "Currency of an amount in its quote.", "v double, q string", [
    (102500000.0, "raised €102.5 million", "EUR"), (40000000.0, "a £40m round", "GBP"), (20000000.0, "CHF 20 million", "CHF"), (5000000.0, "5 million euros", "EUR"), (5000000.0, "US$5 million", "USD"), (5000000.0, "raised 5 million", "USD"),
    (7000000.0, "raised €102.5 million", None), (300.0, "C$300 of it", "CAD"), (1000000000.0, "1 billion yen", "JPY"), (3000000.0, "€2 million, then £3 million", "GBP"), (0.0, "€0", None), (5.0, None, None),
], money.currency_of)

rule_query("sold_shares", "Percent of an offering sold.", "sold double, target double", [
    (50.0, 200.0, "25"), (300.0, 200.0, "100"), (0.0, 200.0, "0"), (5.0, 0.0, None), (-1.0, 10.0, None), (None, 10.0, None),
], money.sold_share)

rule_query("date_precisions", "How much of a date its quote states.", "d string, q string", [
    ("2024-03-09", None, "day"), ("2024-03-01", "on March 1, 2024", "day"), ("2024-03-01", "in March 2024", "month"), ("2024-01-01", "in 2024", "year"), ("2024-03-01", "in 2024", "day"), (None, "2024", None),
], lambda d, q: dates.date_precision(_day(d), q))

rule_query("business_days", "Whether a day is a business day.", "d string", [
    ("2024-03-08", "yes"), ("2024-03-09", "no"), ("2024-03-10", "no"), ("2024-03-11", "yes"),
], lambda d: _yes(dates.is_business_day(_day(d))))

rule_query("latest_signals", "Latest of several dates and its signal.", "a string, b string, c string", [
    ("2024-01-01", "2024-02-01", "2023-01-01", "2024-02-01 hire"), ("2024-02-01", "2024-02-01", None, "2024-02-01 round"), (None, None, "2020-05-05", "2020-05-05 news"), (None, None, None, ""),
], lambda a, b, c: F.concat_ws(" ", *dates.latest_of(round=_day(a), hire=_day(b), news=_day(c))))

rule_query("alert_windows", "Allowed silence of a source.", "at string, hours int, tolerant boolean", [
    ("2024-03-10", 26, True, "72"), ("2024-03-11", 26, True, "72"), ("2024-03-12", 26, True, "26"), ("2024-03-10", 26, False, "26"), ("2024-03-11", 100, True, "100"),
], lambda at, hours, tolerant: dates.alert_window_hours(_day(at), hours, tolerant))

rule_query("index_states", "State of a missing daily index on 2024-03-12.", "d string", [
    ("2024-03-11", "waiting"), ("2024-03-09", "waiting"), ("2024-03-08", "no_index"), ("2024-01-01", "no_index"),
], lambda d: dates.missing_index(_day(d), F.lit("2024-03-12").cast("date")))

rule_query("sentence_lists", "Sentences of texts.", "t string", [
    ("This is the first long sentence of it. And here is one more of that kind! Short.", "This is the first long sentence of it.|And here is one more of that kind!"), ("Too short.", ""), ("One line of some length here\nand another line of some length", "One line of some length here and another line of some length|One line of some length here|and another line of some length"),
    ("We serve many lenders, e.g. banks and credit unions.", "We serve many lenders, e.g. banks and credit unions."), ("## A heading of more than twenty letters", "A heading of more than twenty letters"), ("It was a long story from us. “Now it is over for good”, they said.", "It was a long story from us.|“Now it is over for good”, they said."),
], lambda t: F.array_join(text.sentences(t), "|"))

rule_query("content_word_lists", "Content words of texts.", "t string", [
    ("The Company raised money, raised it with them", "raised,money,them"), ("such only over", "only,over"), ("Their platform helps other teams", "other,teams"), ("größte Fälle", "größte,fälle"), (None, ""),
], lambda t: _listed(text.content_words(t)))

rule_query("cut_headlines", "Whether a headline is cut.", "t string", [
    ("Driving Profitability and Streamlining Fleet Operations:", "yes"), ("Datatruck raises $12M to build the AI-native operating system for", "yes"), ("Datatruck Raises $12M Led by Avenue Growth Partners", "no"),
    ("Acme raises $5M from…", "yes"), ("Acme raises Series A", "no"), ("Acme raises $5M;", "yes"), ("Acme and", "yes"), ("Brand", "no"), ("Acme -", "yes"), ("Acme is in", "no"),
], lambda t: _yes(text.cut_headline(t)))

rule_query("incomplete_headlines", "Whether a headline stops in the middle; the second answer leaves short ones alone.", "t string", [
    ("Synthflow AI is bringing", "yes,yes"), ("Synthflow AI is bringing human-like voice agents to the", "yes,yes"), ("Appcharge is expanding its platform for", "yes,yes"), ("The startup has been building", "yes,yes"),
    ("Datatruck Raises $12M Led by Avenue Growth Partners to Build the AI-Native Operating System for Long-Haul Trucking", "no,no"), ("Zenarate and HeyGen Deepen Strategic Partnership to Bring Lifelike AI Avatars to Enterprise Simulation and Coaching", "no,no"),
    ("HeyGen Secures $60M in Series A", "no,no"), ("Appcharge Raises $58 Million in Funding", "no,no"), ("Quris-AI Acquires Nortis", "yes,no"),
], lambda t: F.concat_ws(",", _yes(text.incomplete_headline(t)), _yes(text.incomplete_headline(t, short=False))))

rule_query("clean_headlines", "Headlines without the site's name.", "t string, u string", [
    ("Appcharge Blog | Full Circle: Why I Joined Appcharge", "https://www.appcharge.com/blog/x", "Full Circle: Why I Joined Appcharge"), ("Datatruck raises $12M to build the AI-native operating system | TechCrunch", "https://techcrunch.com/2026/01/28/x/", "Datatruck raises $12M to build the AI-native operating system"),
    ("Paris-based Swan raises €37 million Series B - EU-Startups", "https://www.eu-startups.com/2023/09/x/", "Paris-based Swan raises €37 million Series B"), ("Swan - the embedded bank for builders", "https://www.eu-startups.com/x", "Swan - the embedded bank for builders"),
], text.clean_headline)

rule_query("error_pages", "Whether a page is an error.", "t string", [
    ("Warning: Target URL returned error 403: Forbidden", "yes"), ("Armorblox protects email with data security and AI.", "no"), ("Just a moment...", "yes"), ("404 page not found", "yes"), ("<h1>404 Not Found</h1>", "yes"), ("Are you a robot? We ask our readers.", "no"), ("Please enable JavaScript to go on", "no"), ("We found 404 notes", "no"), ("x" * 1500 + "Access Denied", "no"), (None, "no"),
], lambda t: _yes(text.error_page(t)))

rule_query("citations_read", "Numbers cited in answers.", "t string", [
    ("as said [1], and [2, 3].", "1,2,3"), ("none here [x]", ""), ("[10][4]", "10,4"),
], lambda t: _listed(text.citations(t).cast("array<string>")))

rule_query("quotes_held", "Whether a source holds a quote.", "q string, s string", [
    ("Acme raised $5M", "Today “Acme raised $5M” and more", "yes"), ("well-known firm", "a WELL KNOWN\nfirm", "yes"), ("Acme raised", "Acme has raised", "no"), ("", "anything", "no"),
], lambda q, s: _yes(text.contains_quote(q, s)))

rule_query("write_decisions", "Whether a value is written.", "old string, new string, verified boolean, old_rank int, new_rank int, n int", [
    (None, "a", False, None, 1, 1, "fill"), ("a", None, False, 1, 2, 3, "keep"), ("a", "a", False, 1, 9, 3, "keep"), ("a", "b", True, 1, 9, 3, "keep"), ("a", "b", False, None, 1, 1, "keep"), ("a", "b", False, None, 1, 2, "overwrite"), ("a", "b", False, 2, 3, 1, "overwrite"), ("a", "b", False, 3, 3, 5, "keep"),
], lambda old, new, verified, old_rank, new_rank, n: resolve.write_decision(old, new, verified=verified, old_rank=old_rank, new_rank=new_rank, sources=n))

rule_query("headcount_decisions", "Whether a headcount is written.", "old int, new int, n int, site boolean", [
    (None, 5, 1, False, "write"), (100, 140, 1, False, "write"), (100, 151, 1, False, "estimate"), (100, 151, 2, False, "write"), (100, 40, 1, True, "write"), (0, 3, 1, False, "estimate"), (10, None, 2, True, "keep"),
], lambda old, new, n, site: resolve.headcount_decision(old, new, sources=n, from_site=site))

rule_query("mandates_wanted", "Whether a mandate wants a candidate.", "sectors array<string>, stages array<string>, sector string, steps array<string>", [
    ([], [], None, None, "yes"), (["A"], [], "A", None, "yes"), (["A"], [], None, None, "no"), ([], ["seed"], None, None, "yes"), ([], ["seed"], None, ["series-a"], "no"), (["A"], ["seed"], "A", ["seed", "series-a"], "yes"), (None, None, "B", ["x"], "yes"),
], lambda sectors, stages, sector, steps: _yes(scoring.wanted(sectors, stages, sector, steps)))

rule_query("updates_due", "Whether a company is due on 2024-06-30.", "seen string, round string, news string", [
    ("2024-05-31", "2023-06-30", None, "yes"), ("2024-06-01", "2023-06-30", None, "no"), ("2024-04-01", None, None, "yes"), ("2024-04-02", "2020-01-01", "2023-01-01", "no"), ("2024-05-31", None, "2024-01-01", "yes"), (None, "2024-01-01", None, "no"),
], lambda seen, round, news: _yes(scoring.update_due(_day(seen), _day(round), _day(news), F.lit("2024-06-30").cast("date"))))
