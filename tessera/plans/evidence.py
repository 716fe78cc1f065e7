"""Rules on what reports say, on values written out with their answers; consensus of headlines; records of two more sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import relevance, reports
from tessera.plans.cases import rule_query
from tessera.plans.catalog import query
from tessera.sources import tables
from tessera.sources.tables import table


def _yes(c):
    return F.when(c, "yes").otherwise("no")


def _round(label, amount, day):
    return F.struct(label.alias("label"), amount.alias("amount"), day.cast("date").alias("announced"))


def _report(title, url, day):
    return F.struct(title.alias("title"), url.alias("url"), day.cast("date").alias("published"))


rule_query("acquirers", "Who bought a company by a headline.", "t string, c string", [
    ("Northwind acquires Acme to grow in Europe", "Acme", "Northwind"),
    ("Acme acquired by Blue River Capital", "Acme", "Blue River Capital"),
    ("Acme, a payroll tool, is bought by Australian HR software company Employment Hero", "Acme", "Employment Hero"),
    ("Sale of Acme to Contoso completed", "Acme", "Contoso"),
    ("Clar acquires Acme Group", "Acme", None),
    ("Clar acquires Acme Group", "Acme Group", "Clar"),
    ("Acme acquires Northwind", "Acme", None),
    ("Egypt's Raseedi buys Acme", "Acme", "Raseedi"),
    ("Żabka przejmuje większościowy pakiet Acme", "Acme", "Żabka"),
    ("It buys Acme", "Acme", None),
    ("Acme opens an office in Paris", "Acme", None),
    ("Northwind acquires Acme+ (Beta)", "Acme+ (Beta", "Northwind"),
    (None, "Acme", None),
], reports.acquirer_in)

rule_query("majority_stakes", "Whether a controlling stake is meant.", "t string", [
    ("Northwind acquires controlling stake in Acme", "yes"),
    ("Prise de contrôle d'Acme", "yes"),
    ("Northwind acquires Acme", "no"),
    (None, "no"),
], lambda t: _yes(reports.majority_stake(t)))

rule_query("buyer_keys", "Keys of buyers.", "n string", [
    ("Żabka Group", "żabka"),
    ("Northwind, Inc.", "northwind"),
    ("A-B C", "abc"),
    ("Group", "group"),
    (None, None),
], reports.buyer_key)

rule_query("announcements", "Whether a headline announces something.", "t string", [
    ("Full Circle: Why I Joined Appcharge", "no"),
    ("Acme raises $5M", "yes"),
    ("Acme appoints a new CFO", "yes"),
    ("I am launching Acme", "yes"),
    ("What people think about tea", "no"),
    (None, "no"),
], lambda t: _yes(reports.is_announcement(t)))

rule_query("amounts_stated", "Whether a headline or address states a sum.", "t string", [
    ("expanded-450-million-credit-facility", "yes"),
    ("Acme gets $450", "yes"),
    ("Acme has 450 people", "no"),
    (None, "no"),
], lambda t: _yes(reports.states_amount(t)))

rule_query("event_keys", "What headlines report.", "t string", [
    ("HeyGen raises $60M Series A", "60m"),
    ("Acme buys Bolt for 1,5 billion", "1.5b,acquisition"),
    ("Raises 60 million, up from $60m", "60m"),
    ("Grant of 250 thousand", "250k"),
    ("Acme opens an office", ""),
    (None, ""),
], lambda t: F.array_join(reports.event_keys(t), ","))

rule_query("same_news", "Whether two reports are of one event.", "ta string, ua string, da string, tb string, ub string, db string", [
    ("HeyGen raises $60M", None, "2024-06-20", "HeyGen gets $60 million round", None, "2024-06-22", "yes"),
    ("HeyGen raises $60M", None, "2024-06-20", "HeyGen gets $60 million round", None, "2024-08-22", "no"),
    ("Krilltech joins quantum computing pilot program", "https://a.example.com/x", "2024-06-20", "Quantum computing pilot program with Krilltech partners", None, "2024-06-20", "yes"),
    ("Story", "https://a.example.com/2024/krilltech-quantum-computing-pilot.html", "2024-06-20", "Krilltech quantum computing pilot begins", None, "2024-06-20", "yes"),
    ("Acme opens office", None, None, "Bolt hires staff", None, None, "no"),
    ("Acme buys Bolt", None, None, "Bolt acquired by Acme", None, "2024-01-01", "yes"),
    (None, None, None, None, None, None, "no"),
], lambda ta, ua, da, tb, ub, db: _yes(reports.same_news_event(_report(ta, ua, da), _report(tb, ub, db))))

rule_query("same_rounds", "Whether two rounds are one raise.", "la string, aa double, da string, lb string, ab double, db string", [
    ("Seed", 1e6, "2024-01-01", "seed round", 2e6, "2024-06-01", "yes"),
    ("Series A", 5e6, "2022-01-01", "Series A", 5.2e6, "2024-01-01", "yes"),
    ("Series A", 5e6, "2022-01-01", "Series A", 9e6, "2024-01-01", "no"),
    ("Other", 5e6, "2024-01-01", "Seed", 5e6, "2024-02-01", "yes"),
    ("Other", 5e6, "2024-01-01", "Seed", 5e6, "2024-06-01", "no"),
    ("Debt", None, "2024-01-01", "Debt", None, "2024-02-15", "yes"),
    ("Series F", 2e8, "2021-01-01", "Series G", 3.59e8, "2025-01-01", "no"),
    ("Seed", None, None, "Seed", None, None, "yes"),
], lambda la, aa, da, lb, ab, db: _yes(reports.same_round(_round(la, aa, da), _round(lb, ab, db))))

rule_query("round_conflicts", "What two reports of a round disagree on.", "aa double, da string, ab double, db string", [
    (10e6, "2024-01-01", 8e6, "2024-01-01", "amount"),
    (10e6, "2024-01-01", 9e6, "2024-06-01", "date"),
    (10e6, "2024-01-01", 9e6, "2024-03-01", None),
    (None, "2024-01-01", 9e6, "2024-01-02", None),
    (0.0, None, 0.0, None, "amount"),
], lambda aa, da, ab, db: reports.round_conflict(_round(F.lit("Seed"), aa, da), _round(F.lit("Seed"), ab, db)))

rule_query("incomplete_rounds", "Why a round isn't written.", "l string, a double, d string, lead string", [
    ("Series A", None, "2024-01-01", "Blue River", None),
    ("Series A", None, "2024-01-01", None, "round_without_amount_incomplete"),
    ("Series A", None, None, "Blue River", "round_without_amount_incomplete"),
    ("Other", 5e6, None, None, "round_other_without_date"),
    (None, 5e6, "2024-01-01", None, None),
    ("Seed", 5e6, None, None, None),
], lambda l, a, d, lead: reports.incomplete_round(l, a, d.cast("date"), lead))

rule_query("patent_problems", "Why a claimed patent can't be told.", "n string, u string", [
    (None, None, "patent_unidentified"),
    ("US 11,756,357 B2", "https://p.example.com/patent/US11756357B2/en", None),
    ("US1234567B1", "https://p.example.com/patent/US11756357B2/en", "patent_number_url_mismatch"),
    (None, "https://p.example.com/patent/US11756357B2", None),
    ("US 123", "https://p.example.com/", "patent_unidentified"),
    ("  ", None, "patent_unidentified"),
], reports.patent_problem)

rule_query("patent_digits", "Digits of patents.", "n string", [
    ("US 11,756,357 B2", "11756357"),
    ("EP0012345A1", "12345"),
    ("11756357", "11756357"),
    (None, None),
], reports.patent_digits)

rule_query("page_dates", "Days that pages say they were published.", "h string", [
    ('<meta property="article:published_time" content="2024-03-05T10:00:00Z">', "2024-03-05"),
    ("<meta content='2024-03-06' name='date'>", "2024-03-06"),
    ('<script>{"datePublished": "2024-03-07"}</script>', "2024-03-07"),
    ('<time class="x" datetime="2024-03-08">', "2024-03-08"),
    ('<meta name="date" content="2031-01-01"><time datetime="2024-03-09">', "2024-03-09"),
    ('<time datetime="2024-13-08">', None),
    ("", None),
    (None, None),
], lambda h: reports.html_date(h, F.lit("2026-01-01").cast("date")))

rule_query("hub_tags", "Tags that say something.", "t array<string>", [
    (["region:us", "agent", " agent", "", "license:mit", "text-generation"], "agent,text-generation"),
    (["has_space", "has_spaces"], "has_spaces"),
    ([], ""),
], lambda t: F.array_join(reports.useful_tags(t), ","))


@query(
    """
    SELECT o_custkey, lower(buyer) AS buyer_key, buyer, count(*) AS n
    FROM (SELECT o_custkey, CASE o_orderkey % 3 WHEN 0 THEN 'Northwind' WHEN 1 THEN 'Contoso' END AS buyer FROM orders)
    WHERE buyer IS NOT NULL GROUP BY o_custkey, buyer HAVING count(*) >= 2
    """
)
def agreed_buyers(spark, sf_dir):
    """Buyers that two headlines of a company name; the headlines are made from orders."""
    k = F.col("o_orderkey") % 3
    title = F.when(k == 0, "Northwind acquires Acme").when(k == 1, "Acme bought by Contoso").otherwise("Acme opens an office")
    headlines = table(spark, sf_dir, "orders").select("o_custkey", title.alias("title"), F.lit("Acme").alias("company"))
    return reports.known_acquirers(headlines, ["o_custkey"])


@query(
    """
    SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE p_brand || '/' || p_name END AS external_id, CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE p_brand END AS owner, p_name AS name,
           CAST(p_size AS DOUBLE) AS likes, 'agent,' || p_brand AS tags, p_partkey % 7 = 0 AS closed FROM part
    """
)
def hub_models(spark, sf_dir):
    """Items of a model hub, written from parts and read back."""
    k = F.col("p_partkey")
    owned = F.when(k % 4 != 0, F.concat("p_brand", F.lit("/"), "p_name")).otherwise(F.col("p_name"))
    item = F.struct(owned.alias("id"), F.col("p_type").alias("author"), F.col("p_size").alias("likes"), F.array(F.lit("region:us"), F.lit("agent"), F.col("p_brand"), F.lit("agent")).alias("tags"), (k % 7 == 0).alias("gated"))
    read = table(spark, sf_dir, "part").select("p_partkey", tables.model_record(F.to_json(item)).alias("m"))
    return read.select("p_partkey", "m.external_id", "m.owner", "m.name", "m.likes", F.array_join("m.tags", ",").alias("tags"), "m.closed")


@query(
    """
    SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS publication_number, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE DATE '2024-03-05' END AS published, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END AS assignee,
           'Jane Roe,' || p_type AS inventors FROM part
    """
)
def patent_publications(spark, sf_dir):
    """Publications of a patent office in two spellings, written from parts and read back."""
    k, people = F.col("p_partkey"), "array(named_struct('first_name', 'Jane', 'last_name', 'Roe', 'name', NULL), named_struct('first_name', NULL, 'last_name', NULL, 'name', p_type), named_struct('first_name', NULL, 'last_name', NULL, 'name', ' '))"
    day = F.when(k % 3 != 0, "2024-03-05").otherwise("soon")
    one = F.struct(k.alias("publication_number"), F.col("p_name").alias("patent_title"), day.alias("publication_date"), F.col("p_type").alias("assignee_organization"), F.expr(people).alias("inventors"))
    two = F.struct(k.cast("string").alias("pgpub_id"), F.col("p_name").alias("title"), day.alias("pub_date"), F.array(F.struct(F.col("p_brand").alias("organization"))).alias("assignees"), F.expr(people).alias("inventor"))
    body = F.when(k % 2 == 0, F.to_json(one)).otherwise(F.to_json(two))
    parsed = tables.dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")).select("p_partkey", F.try_parse_json(body).alias("v"))  # parsed once, not for each field
    read = parsed.select("p_partkey", tables.publication_record(F.col("v")).alias("p"))
    return read.select("p_partkey", "p.publication_number", "p.title", "p.published", "p.assignee", F.array_join("p.inventors", ",").alias("inventors"))


_ABOUT = "Superblocks is a governed enterprise platform that lets business teams generate AI apps and agents on company data, while IT controls integrations, permissions and code security."
_PAD = "A long article about early-stage startups, hiring, technical debt and how founders raise money in a bull market. " * 8

rule_query("news_problems", "Why an article isn't news about a company.", "t string, body string, c string, about string", [
    ("Banzai Acquires AI Web Development and Hosting Platform Superblocks", None, "Superblocks", _ABOUT, "different_product"),
    ("Acme acquires enterprise app platform Superblocks", None, "Superblocks", _ABOUT, None),
    ("Superblocks raises $23M Series A", "Superblocks, a platform for internal apps and agents, raised $23 million.", "Superblocks", _ABOUT, None),
    ("Superblocks raises $23M Series A", None, "Superblocks", _ABOUT, None),
    ("Nova raises $5M", "Nova, a hosting provider for small websites, raised $5 million.", "Nova", "Nova predicts vulnerabilities in cloud infrastructure using machine learning.", "different_product"),
    ("What to know before investing in Ethereum competitor Solana (SOL)", None, "Solana", "Solana is a high-performance network.", "explainer"),
    ("TechCrunch+ roundup: Slashing technical debt, IPO analysis, your first comms hire", _PAD + " Lightup was mentioned once.", "Lightup", "Lightup is a data quality platform", "explainer"),
    ("Lessons from founders raising their first round in a bull market", _PAD + " Lightup was mentioned once.", "Lightup", "Lightup is a data quality platform", "explainer"),
    ("Why founders raise early", _PAD + " Lightup said so.", "Lightup", "a data quality platform", "not_about_the_company"),
    ("Data quality startup Lightup nabs $9M in fresh funding", _PAD, "Lightup", "x y z", None),
    ("Swan secures €42M to lead Embedded Banking in Europe", _PAD, "Swan", "x y z", None),
    ("Thriveni Expands Partnership with Empxtrack", _PAD, "Empxtrack", "x y z", None),
    ("IT Park Ventures: The First Venture Investments", "", "Datatruck", "trucking software", "not_about_the_company"),
    ("The 8 Best ProtonMail Alternatives", None, "Posteo", "mail", "explainer"),
], lambda t, body, c, about: relevance.news_problem(t, body, c, about))

rule_query("named_up_front", "Whether an article names a company up front.", "t string, body string, c string", [
    ("IT Park Ventures: The First Venture Investments in Uzbekistan's Startups", "", "Datatruck", "no"),
    ("IT Park Ventures: The First Venture Investments in Uzbekistan's Startups", "IT Park Ventures made its first investments. " * 20 + " Datatruck", "Datatruck", "no"),
    ("Owen Selects Assurant to Enable Embedded Protection for Swan's Next-Generation Business Cards", "Owen, an insurtech, has selected Assurant to underwrite cards. " * 10, "Swan", "no"),
    ("Swan secures €42M", "", "Swan", "yes"), ("Speechify's new voice typing", "", "Speechify", "yes"), ("Funding roundup", "Datatruck, a trucking platform, raised $12M.", "Datatruck", "yes"),
    ("Cancer Treatment Company HIL raises money", None, "HIL Applied Medical", "yes"), ("SW-Mototech grows", None, "Mototech", "no"), ("Some other news", None, "", "yes"), (None, None, "Acme", "no"),
], lambda t, body, c: _yes(relevance.names_up_front(t, body, c)))

rule_query("own_site_items", "Whether a page of a company's own site is news.", "u string, t string, c string", [
    ("https://empxtrack.com/news/thriveni-expands-partnership-empxtrack/", "Thriveni Expands Partnership with Empxtrack", "Empxtrack", "yes"),
    ("https://www.appcharge.com/blog/epic-v-google-the-settlement-is-off-the-table", "Epic v. Google: The Settlement Is Off the Table, and That Is Good for Developers", "Appcharge", "no"),
    ("https://www.heygen.com/blog/heygen-surpasses-200m-arr", "HeyGen Surpasses $200M ARR as AI Video Adoption Accelerates", "HeyGen", "yes"),
    ("https://www.swan.io/blog-posts/swan-secures-eu42m", "Swan secures €42M", "Swan", "yes"), ("https://www.upside.com/newsroom/press-releases/x", "Forbes recognizes Upside", "Upside", "yes"), ("not a url", "Swan secures €42M", "Swan", "no"), (None, None, "Swan", "no"),
], lambda u, t, c: _yes(relevance.own_site_news(u, t, c)))
