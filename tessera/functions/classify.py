"""Rule ladders: ordered (pattern, label) lists compiled to column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from re import _constants as sre
from re import _parser as sre_parse

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, str]]

# Substrings of an industry and the sector they mean, first hit wins.
SECTOR_WORDS: dict[str, str] = {
    "AI & ML": "generative ai|large language model|computer vision|natural language|speech recognition|ai agent|agentic|mlops|ai infrastructure|machine learning|artificial intelligence",
    "Fintech": "insurtech|wealthtech|regtech|neobank|digital bank|payment|lending|credit|blockchain|crypto|defi|web3|compliance|financial technology|fintech",
    "Cybersecurity": "zero trust|cloud security|data security|identity|endpoint security|threat intelligence|cybersecurity|information security",
    "SaaS & Dev Tools": "developer tool|devops|api platform|low-code|no-code|data infrastructure|data platform|saas",
    "E-commerce & Retail": "supply chain|logistics|marketplace|retail tech|e-commerce|ecommerce|d2c",
    "Health & Life Sciences": "digital health|healthtech|medtech|medical device|genomics|biotech|life sciences|mental health|healthcare",
    "Climate & Energy": "cleantech|clean energy|energytech|renewable|carbon|sustainability|climate tech",
    "Enterprise Software": "business intelligence|analytics|human resources|hr tech|hrtech|crm|erp|enterprise",
    "Consumer & Media": "social media|gaming|game|edtech|education|travel|hospitality|media|content",
    "DeepTech": "quantum|robotics|space tech|semiconductor|deep tech|deeptech",
}
# Whole words that decide after the substrings.
SECTOR_TOKENS: Rules = [("ai", "AI & ML"), ("ml", "AI & ML"), ("llm", "AI & ML"), ("nlp", "AI & ML"), ("sec", "Cybersecurity"), ("iam", "Cybersecurity")]
SECTOR_RULES: Rules = [(words, label) for label, words in SECTOR_WORDS.items()] + [(rf"\b{w}\b", label) for w, label in SECTOR_TOKENS]

# Round labels in the order they are tried.
ROUND_RULES: Rules = [
    ("pre.?seed", "Pre-Seed"),
    (r"series\s*a\b", "Series A"),
    (r"series\s*b\b", "Series B"),
    (r"series\s*c\b", "Series C"),
    (r"series\s*d\b", "Series D"),
    (r"series\s*e\b", "Series E"),
    (r"series\s*[f-z+]|late.?stage", "Series F+"),
    (r"\bgrowth\b|expansion", "Growth"),
    ("venture.?debt", "Venture Debt"),
    (r"\bdebt\b|credit facilit|term loan|\bloan\b|mezzanine", "Debt"),
    ("secondar", "Secondary"),
    (r"\bbridge\b", "Bridge"),
    (r"convertible|safe\b|\bnote\b", "Convertible Note"),
    (r"buyout|\blbo\b|leveraged buy|take.?private", "PE Buyout"),
    ("bootstrap", "Bootstrapped"),
    (r"\bgrant\b", "Grant"),
    ("acqui|merg", "Acquired"),
    (r"\bipo\b|\bpublic\b|nyse|nasdaq|\blse\b|\btase\b", "IPO"),
]
# What a round of no regular series may be called.
OTHER_ROUND = r"(?i)\b(strategic|crowd ?fund\w*|token (?:sale|offering)|private placement|pipe\b|revenue.based|spac\b|tender offer|corporate (?:round|investment)|equity crowdfunding)\b"
STAGES = {
    "unknown": ("Other", "Bootstrapped", "Grant", "Debt"),
    "early": ("Pre-Seed", "Seed", "Convertible Note", "Bridge"),
    "growth": ("Series A", "Series B"),
}

# Seniority marks of a job title, first hit wins.
SENIORITY: Rules = [
    (r"\b(co[-\s]?founder|cofounder)\b", "Co-Founder"),
    (r"\bfounding\b", "Founding"),
    (r"\bfirst\s+(?!line|level|party|tier|class|shift|aid|response)(\w+\s+){0,2}(hire|engineer|designer|manager|marketer|seller|rep)\b", "First Hire"),
    (r"\b(c[teoifprsm]o|chief\s+\w+\s+officer)\b", "C-Level"),
    (r"\b(vp|vice\s+president)\b", "VP"),
    (r"\bhead\s+of\b", "Head of"),
    (r"\bdirector\b", "Director"),
    (r"\bprincipal\b", "Principal"),
    (r"\bstaff\b", "Staff"),
    (r"\blead\b(?!\s+(generation|gen)\b)", "Lead"),
    (r"\b(senior|sr\.?)\b", "Senior"),
    (r"\b(junior|jr\.?|entry[-\s]level|new\s+grad|graduate)\b", "Junior"),
    (r"\b(intern|internship|co[-\s]?op)\b", "Intern"),
]
# Technologies of a job title, every hit counts.
TECHNOLOGY: Rules = [
    (r"\brust\b", "Rust"),
    (r"\bgolang\b|\bgo\b(?!\s*(to|live|lang\w))", "Go"),
    (r"\bpython\b", "Python"),
    (r"\btype\s?script\b|\bts\b", "TypeScript"),
    (r"\bjava\s?script\b", "JavaScript"),
    (r"\bjava\b(?!\s?script)", "Java"),
    (r"\bkotlin\b", "Kotlin"),
    (r"\bswift\b", "Swift"),
    (r"\bruby\b|\brails\b", "Ruby"),
    (r"\bscala\b", "Scala"),
    (r"\belixir\b", "Elixir"),
    (r"c\+\+", "C++"),
    (r"\breact\b", "React"),
    (r"\bnode(\.js)?\b", "Node.js"),
    (r"\bkubernetes\b|\bk8s\b", "Kubernetes"),
    (r"\bterraform\b", "Terraform"),
    (r"\baws\b", "AWS"),
    (r"\bsolidity\b", "Solidity"),
    (r"\bmachine\s+learning\b|\bml\b(?!\s*ops)", "Machine Learning"),
    (r"\bml\s?ops\b", "MLOps"),
    (r"\bllms?\b|\bgen(erative)?\s?ai\b", "LLM"),
    (r"\bai\b", "AI"),
    (r"\bdata\s+(engineer|scientist|analyst|platform)\b", "Data"),
    (r"\bios\b", "iOS"),
    (r"\bandroid\b", "Android"),
    (r"\bback[-\s]?end\b", "Backend"),
    (r"\bfront[-\s]?end\b", "Frontend"),
    (r"\bfull[-\s]?stack\b", "Full Stack"),
    (r"\bdev\s?ops\b", "DevOps"),
    (r"\bsre\b|\bsite\s+reliability\b", "SRE"),
    (r"\binfra(structure)?\b", "Infrastructure"),
    (r"\bsecurity\b|\bappsec\b|\binfosec\b", "Security"),
]
# Keywords of young companies, and of grown ones, whose presence silences the former.
EARLY_WORDS: Rules = [
    (r"\bstealth\s*[-\s]?mode\b|\bin\s+stealth\b|\bstealth\s+startup\b", "Stealth"),
    (r"\bfounding\s+team\b", "Founding Team"),
    (r"\b0\s*(to|-|→)\s*1\b|\bzero\s+to\s+one\b", "Zero to One"),
    (r"\bgreenfield\b", "Greenfield"),
    (r"\bearly[-\s]stage\b|\bpre[-\s]?seed\b|\bseed[-\s]stage\b", "Early Stage"),
]
GROWN_WORDS: Rules = [
    (r"\baccount\s+executive\b|\bsales\s+development\b|\b(sdr|bdr)\b|\bbusiness\s+development\s+rep", "Sales Org"),
    (r"\bcustomer\s+(success|support|experience)\b|\btechnical\s+support\b|\baccount\s+manager\b", "Customer Org"),
    (r"\baccounts?\s+(receivable|payable)\b|\bcontroller\b|\bpayroll\b|\bfinancial\s+analyst\b|\btreasury\s+analyst\b", "Finance Org"),
    (r"\brecruiter\b|\btalent\s+acquisition\b|\bpeople\s+(partner|consultant|operations)\b|\bhr\s+business\s+partner\b", "People Org"),
    (r"\bcompliance\b|\bsanctions\b|\bfinancial\s+crimes?\b|\bfraud\s+(investigator|analyst)\b|\brisk\s+operations\b|\b(aml|kyc)\b", "Compliance Org"),
    (r"\benterprise\s+(account\s+executive|solutions?\s+(engineer|architect)|sales|architect)\b|\bsolutions?\s+engineer\b|\bsales\s+engineer\b", "Enterprise GTM"),
    (r"\b(emea|apac|anz|latam|dach|benelux|nordics|iberia)\b|\b(east|west)\s+coast\b|[-–—,]\s*(central|east|west|north|south|northeast|southeast|midwest)(\s+coast)?\s*$", "Territory Org"),
    (r"\balliances?\b|\bpartnerships?\b|\bchannel\s+sales\b|\bpartner\s+(manager|development)\b", "Partnerships Org"),
]
NEUTRAL_WORDS: Rules = [(r"\bremote\b", "Remote"), (r"\bcontract(or)?\b|\bfreelance\b", "Contract")]


def first_label(text: Column, rules: Rules, default: str | None = None) -> Column:
    """Label of the first rule whose pattern the text holds, whatever the case."""
    return F.coalesce(*[F.when(text.rlike(f"(?i){pattern}"), label) for pattern, label in rules], F.lit(default))


def every_label(text: Column, rules: Rules) -> Column:
    """Labels of all rules whose pattern the text holds, in order."""
    return F.filter(F.array(*[F.when(text.rlike(f"(?i){pattern}"), label) for pattern, label in rules]), lambda x: x.isNotNull())


#: Most spellings of a pattern that are written out.
MOST_SPELLINGS = 64


def _bare(c: str) -> str:
    return c.lower() if re.fullmatch("[A-Za-z0-9_]", c) else " "


def needed_words(pattern: str) -> list[list[str]]:
    """Lists of words, lower-cased runs of ``[A-Za-z0-9_]``: a text that the pattern fits has all words of one of these, whole; [[]] if it needs none.

    Spellings are written out with one blank for each run of other characters.  What
    can't be written out (any word) parts them, and the part with the longest words counts.
    """

    def spelled(kind, x) -> set[str] | None:
        """Every spelling of a piece, or None where they can't be written out."""
        if kind is sre.LITERAL:
            return {_bare(chr(x))}
        if kind is sre.AT:
            return {" "} if x in (sre.AT_BOUNDARY, sre.AT_END, sre.AT_BEGINNING) else None  # one side of a boundary is no word's
        if kind in (sre.ASSERT, sre.ASSERT_NOT):
            return {""}
        if kind is sre.IN:
            return {" " if (k, c) == (sre.CATEGORY, sre.CATEGORY_SPACE) else _bare(chr(c)) for k, c in x} if all(k is sre.LITERAL or (k, c) == (sre.CATEGORY, sre.CATEGORY_SPACE) for k, c in x) else None
        if kind is sre.BRANCH:
            each = [joined(part) for part in x[1]]
            return None if None in each else set().union(*each)
        if kind is sre.SUBPATTERN:
            return joined(x[-1])
        if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, part = x
            each = joined(part)
            return None if each is None or most > 1 and not each <= {" "} else each if least else each | {""}
        return None

    def joined(parts) -> set[str] | None:
        run = {""}
        for kind, x in parts:
            each = spelled(kind, x)
            run = None if each is None else {re.sub(" +", " ", a + b) for a in run for b in each}
            if run is None or len(run) > MOST_SPELLINGS:
                return None
        return run

    def whole(run: set[str]) -> set[tuple[str, ...]]:
        return {tuple(sorted(set(re.findall(r"(?<= )[a-z0-9_]+(?= )", x)))) for x in run}

    def needed(parts) -> set[tuple[str, ...]]:
        parts, run, found = list(parts), {""}, []
        for i, (kind, x) in enumerate(parts):
            each = spelled(kind, x)
            if each is None and kind is sre.SUBPATTERN:
                return needed([*parts[:i], *x[-1], *parts[i + 1 :]])
            if each is None and kind is sre.BRANCH:
                return set().union(*[needed([*parts[:i], *part, *parts[i + 1 :]]) for part in x[1]])
            longer = None if each is None else {re.sub(" +", " ", a + b) for a in run for b in each}
            if longer is None or len(longer) > MOST_SPELLINGS:
                found, longer = [*found, run], each or {""}
            run = longer
        return max(map(whole, [*found, run]), key=lambda words: min(max(map(len, w), default=0) for w in words))

    words = needed(sre_parse.parse(pattern))
    return sorted(list(w) for w in words if not any(v != w and set(v) <= set(w) for v in words))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def held_words(text: Column, *rules: Rules) -> Column:
    """The distinct words of a text that the rules need."""
    known = sorted({w for ladder in rules for pattern, _ in ladder for words in needed_words(pattern) for w in words})
    return F.array_intersect(F.transform(F.split(text, "[^A-Za-z0-9_]+"), lambda w: F.lower(w)), F.array(*map(F.lit, known)))


def _fits(text: Column, held: Column, pattern: str) -> Column:
    """Whether a text holds the pattern, whatever the case; it is matched only where the text has the words that it needs."""
    fits, each = text.rlike(f"(?i){pattern}"), needed_words(pattern)
    if [] in each:
        return fits
    return reduce(Column.__or__, [reduce(Column.__and__, [F.array_contains(held, F.lit(w)) for w in words]) for words in each]) & fits


def sector(industry: Column) -> Column:
    blank = industry.isNull() | (F.trim(industry) == "")
    return F.when(blank, "Uncategorized").otherwise(first_label(industry, SECTOR_RULES, "Uncategorized"))


def round_label(raw: Column) -> Column:
    """Canonical label of a round; null or empty is Unknown, an unlisted one Other."""
    text = F.lower(F.trim(raw))
    seed = ~text.rlike("pre.?seed") & text.rlike(r"\bseed\b") & ~F.contains(text, F.lit("series"))
    return F.when(raw.isNull() | (raw == ""), "Unknown").when(seed, "Seed").otherwise(first_label(text, ROUND_RULES, "Other"))


def refined_round_label(raw: Column, evidence: Column) -> Column:
    """Other only where the evidence names such a round, else Unknown."""
    label = round_label(raw)
    named = F.coalesce(evidence.rlike(OTHER_ROUND), F.lit(False))
    return F.when((label == "Other") & ~named, "Unknown").otherwise(label)


def capital_kind(raw: Column) -> Column:
    """equity, debt or not_capital, from the canonical label."""
    label = round_label(raw)
    return F.when(label.isin("Debt", "Venture Debt"), "debt").when(label.isin("Secondary", "PE Buyout", "Acquired", "IPO", "Grant", "Bootstrapped"), "not_capital").otherwise("equity")


def stage_group(label: Column) -> Column:
    """unknown, early or growth; everything else is late, labels added since included."""
    return F.coalesce(F.when(label.isNull(), "unknown"), *[F.when(label.isin(*labels), stage) for stage, labels in STAGES.items()], F.lit("late"))


def title_signals(title: Column) -> Column:
    """Array of (signal_type, signal_value): one seniority, all technologies, keywords.

    Where a title names a function of a grown organisation, its keywords of young
    companies are dropped; seniority is never dropped.  Whole texts come here too: a
    rule is matched only where the text has the words that it needs.
    """

    def tagged(kind: str, labels: Column) -> Column:
        return F.transform(labels, lambda v: F.struct(F.lit(kind).alias("signal_type"), v.alias("signal_value")))

    def read(x: Column) -> Column:
        text, held = x["text"], x["held"]

        def labels(rules: Rules) -> Column:
            return F.filter(F.array(*[F.when(_fits(text, held, pattern), label) for pattern, label in rules]), lambda v: v.isNotNull())

        level = F.coalesce(*[F.when(_fits(text, held, pattern), label) for pattern, label in SENIORITY])
        levels = F.filter(F.array(level), lambda v: v.isNotNull())
        early = lambda grown: F.when(F.size(grown) > 0, F.array().cast("array<string>")).otherwise(labels(EARLY_WORDS))
        words = _let(labels(GROWN_WORDS), lambda grown: F.concat(early(grown), labels(NEUTRAL_WORDS), grown))
        return F.concat(tagged("seniority", levels), tagged("tech_stack", labels(TECHNOLOGY)), tagged("keyword", words))

    text = F.trim(F.coalesce(title, F.lit("")))
    return _let(F.struct(text.alias("text"), held_words(text, SENIORITY, TECHNOLOGY, EARLY_WORDS, GROWN_WORDS, NEUTRAL_WORDS).alias("held")), read)


def reasons(*pairs: tuple[Column, str | Column]) -> Column:
    """Array of the reasons whose condition holds; empty means pass."""
    return F.filter(F.array(*[F.when(c, r if isinstance(r, Column) else F.lit(r)) for c, r in pairs]), lambda x: x.isNotNull())


# Words of a vehicle's name.
VEHICLE_WORDS = r"\b(spv|a series of|feeder|parallel|blocker|aiv|co-?invest\w*|sidecar|annex)\b"


def fund_gate(name: Column, fund_type: Column) -> Column:
    """Reasons against listing a fund filing: another type of fund, or a vehicle's name."""
    kind = F.coalesce(F.nullif(fund_type, F.lit("")), F.lit("none"))
    word = F.regexp_extract(F.lower(name), VEHICLE_WORDS, 1)
    return reasons((F.coalesce(fund_type, F.lit("")) != "Venture Capital Fund", F.concat(F.lit("fund_type:"), kind)), (word != "", F.concat(F.lit("vehicle_name:"), word)))


def headcount_band(n: Column) -> Column:
    bands = [(10, "1-10"), (50, "11-50"), (200, "51-200"), (500, "201-500"), (1000, "501-1000"), (5000, "1001-5000"), (10000, "5001-10000")]
    return F.when(n.isNull() | (n < 1), None).otherwise(F.coalesce(*[F.when(n <= top, label) for top, label in bands], F.lit("10001+")))


def search_rank(text: Column, query: str) -> Column:
    """0 exact (or nothing searched for), 1 prefix, 2 at a word's boundary, 3 anywhere, 4 not at all."""
    t, q = F.lower(F.trim(F.coalesce(text, F.lit("")))), query.strip().lower()
    if not q:
        return F.lit(0)
    boundary = "(?<![A-Za-z0-9_])" if re.match("[A-Za-z0-9_]", q) else "(?<=[A-Za-z0-9_])"
    return F.when(t == q, 0).when(F.startswith(t, F.lit(q)), 1).when(t.rlike(boundary + re.sub(r"([^\w\s])", r"\\\1", q)), 2).when(F.contains(t, F.lit(q)), 3).otherwise(4)


# Whole words of a filing's name (or a patent's text) and the sector they mean, first hit wins.
CANDIDATE_WORDS: Rules = [
    ("ai|llms?|machine learning|deep learning|neural|genai", "AI & ML"),
    ("health|healthcare|healthtech|biotech|bioscience|biosciences|biologics|therapeutics|pharma|pharmaceuticals?|genomics|medical|medtech|clinical|diagnostics", "Health & Life Sciences"),
    ("payments?|fintech|lending|neobank|insurtech|crypto|blockchain|wealthtech|regtech", "Fintech"),
    ("cyber|cybersecurity|infosec", "Cybersecurity"),
    ("solar|climate|carbon|battery|batteries|hydrogen|renewables?|cleantech", "Climate & Energy"),
    ("quantum|robotics?|semiconductors?|photonics|aerospace|drones?", "DeepTech"),
    ("gaming|games|edtech", "Consumer & Media"),
    ("saas|devops|devtools", "SaaS & Dev Tools"),
    ("ecommerce|e-commerce|marketplace|logistics", "E-commerce & Retail"),
]


def candidate_sector(source: Column, name: Column, evidence: Column) -> Column:
    """Sector that a filing reveals, else null: its own codes first, then whole words.

    ``evidence`` has industry_group, codes (array), title and abstract; the last
    two count for patents alone.
    """
    patent = source == "epo_ops"
    text = F.concat_ws(" ", name, F.when(patent, evidence["title"]), F.when(patent, F.substring(evidence["abstract"], 1, 600)))
    uk, codes = source == "uk_companies_house", F.coalesce(evidence["codes"], F.array().cast("array<string>"))
    life = ((source == "sec_form_d") & (F.lower(evidence["industry_group"]) == "biotechnology")) | (uk & F.array_contains(codes, "72110"))
    hardware = uk & F.exists(codes, lambda c: F.startswith(c, F.lit("26")))
    words = first_label(text, [(rf"\b({w})\b", label) for w, label in CANDIDATE_WORDS])
    return F.when(life, "Health & Life Sciences").when(hardware, "DeepTech").otherwise(words)


def candidate_stages(source: Column, total_offering: Column, total_sold: Column) -> Column:
    """Stages that a filing is consistent with (an array), or null where it says nothing; amounts are texts."""

    def amount(text: Column) -> Column:
        number = F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?$"), text.try_cast("double"))
        return F.when(number > 0, number)

    def steps(*names: str) -> Column:
        return F.array(*map(F.lit, names))

    asked = F.coalesce(amount(total_offering), amount(total_sold))
    return (
        F.when(source == "uk_companies_house", steps("pre-seed", "seed"))
        .when((source != "sec_form_d") | asked.isNull(), None)
        .when(asked < 2_500_000, steps("pre-seed", "seed"))
        .when(asked < 10_000_000, steps("seed", "series-a"))
        .when(asked < 40_000_000, steps("series-a", "series-b"))
        .otherwise(steps("series-b", "growth"))
    )


# Round labels that make a company venture-like.
EARLY_ROUNDS = ("Pre-Seed", "Seed", "Series A")
VENTURE_ROUNDS = (*EARLY_ROUNDS, "Series B", "Series C", "Series D", "Series E+", "Growth", "Bridge", "Convertible Note")


def archetype(founded_year: Column, employees: Column, has_buyout: Column, recent_early: Column, recent_venture: Column, as_of: Column) -> Column:
    """Struct of archetype and reasons: a buyout, 15 years without an early round, or 750 staff without venture rounds make it mature."""
    age = F.when(founded_year > 1800, F.greatest(F.lit(0), F.year(as_of) - founded_year))

    def found(kind: str, *why: str) -> Column:
        return F.struct(F.lit(kind).alias("archetype"), F.array(*map(F.lit, why)).alias("reasons"))

    return (
        F.when(has_buyout, found("mature_private", "buyout_or_acquisition_on_record"))
        .when((age >= 15) & ~recent_early, found("mature_private", "active_15_plus_years", "no_recent_early_stage_round"))
        .when((F.coalesce(employees, F.lit(0)) >= 750) & ~recent_venture, found("mature_private", "large_headcount", "no_recent_vc_round"))
        .otherwise(found("venture_backed", "venture_profile"))
    )


# Words of an industry and the sector whose momentum counts where a company names none.
MOMENTUM_WORDS: Rules = [
    (r"\b(ai|ml|llm|nlp)\b|machine learn|artificial intel|generative|deep learn", "ai-ml"),
    ("fintech|payment|neobank|crypto|web3|insurtech|wealthtech|lending|defi", "fintech"),
    ("cyber|zero trust|endpoint sec|cloud sec|identity|iam", "cybersecurity"),
    ("saas|dev tool|devops|api platform|no-code|low-code|data infra", "saas-devtools"),
    ("e-commerce|ecommerce|marketplace|logistics|retail tech", "ecommerce-retail"),
    ("health|medical|biotech|genomic|mental health", "health-lifesci"),
    ("clean tech|cleantech|energy|renewable|carbon|climate|sustain", "climate-energy"),
    ("enterprise|crm|erp|hr tech|analytics|business intel", "enterprise-sw"),
    ("gaming|social media|edtech|travel|media|consumer", "consumer-media"),
    ("quantum|robotics|space tech|semiconductor|deeptech|deep tech", "deeptech"),
]


def momentum_sector(industry: Column) -> Column:
    return first_label(industry, MOMENTUM_WORDS)


def field_confidence(types: Column) -> Column:
    """0 to 90 from the kinds of sources that back a field (an array)."""

    def has(*kinds: str) -> Column:
        return F.arrays_overlap(types, F.array(*map(F.lit, kinds)))

    news = F.size(F.filter(types, lambda t: t == "news"))
    return F.when(has("registry"), 90).when(has("company_site", "press_release") | (news >= 2), 75).when(news == 1, 55).when(has("aggregator_snippet"), 40).otherwise(0)


def _given(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) != ""


def data_group(description: Column, city: Column, country: Column, founded_year: Column, rounds: Column, founders: Column) -> Column:
    """empty, partial or full: five kinds of facts, and a description of 200 characters for full."""
    flags = (_given(description), _given(city) | _given(country), F.coalesce(founded_year, F.lit(0)) != 0, F.coalesce(rounds, F.lit(0)) > 0, F.coalesce(founders, F.lit(0)) > 0)
    have = sum((f.cast("int") for f in flags), F.lit(0))
    return F.when(have == 0, "empty").when((have == 5) & (F.length(F.trim(description)) >= 200), "full").otherwise("partial")


def work_tier(description: Column, employees: Column, real_rounds: Column, competitors: Column) -> Column:
    """1 without data, 3 with all of it, 2 between."""
    described, staffed = F.coalesce(description, F.lit("")) != "", F.coalesce(employees, F.lit(0)) != 0
    return F.when(~described & ~staffed & ~real_rounds, 1).when(described & staffed & real_rounds & (F.coalesce(competitors, F.lit(0)) > 0), 3).otherwise(2)


# Country codes at the end of a host and their region.
REGIONS = {
    "israel": "il",
    "uk_ireland": "uk|ie",
    "europe": "de|fr|nl|es|it|se|no|dk|fi|ch|at|be|pt|pl|ee|lt|lv|cz|gr|ro|hu|lu|ua|bg|hr|rs|eu",
    "north_america": "ca|us",
    "asia_pacific": "in|jp|cn|sg|kr|au|nz|hk|tw|my|id|th|vn|ph",
    "latin_america": "br|mx|ar|cl|co|pe|uy",
    "middle_east_africa": "ae|sa|tr|eg|za|ng|ke|ma|qa|jo",
}


def region(host: Column) -> Column:
    """Region of a host's country code; a bare ``.co`` and everything else is generic."""
    own = F.coalesce(host, F.lit(""))
    return F.when(own.rlike(r"\.co$"), "generic").otherwise(F.coalesce(*[F.when(own.rlike(rf"\.({codes})$"), name) for name, codes in REGIONS.items()], F.lit("generic")))


# Industry groups of an offering in scope, and those in scope by name alone.
TECH_GROUPS = ("technology", "computers", "telecommunications", "other technology", "biotechnology")
ADJACENT_GROUPS = ("pharmaceuticals", "other health care", "energy conservation", "environmental services", "other energy", "manufacturing", "business services", "other")
# Whole words of a technology company's name, and of an investment vehicle's.
TECH_NAME = r"(?i)\b(ai|robotics?|robots?|autonomous|quantum|semiconductors?|photonics?|lidar|drones?|satellites?|aerospace|biotech\w*|bio|biosciences?|biologics|therapeutics|genomics?|diagnostics|medtech|neuro\w*|solar|batter(?:y|ies)|hydrogen|fusion|cleantech|climatetech|software|saas|cyber\w*|fintech|blockchain)\b"
VEHICLE_NAME = r"(?i)\b(fund|funds|spv|a series of|series\s+[a-z0-9][\w-]*|l\.?p\.?|co-?invest\w*|opportunit(?:y|ies)|investors?|capital partners|holdings?|equit(?:y|ies))\b"
# What tells a patent's applicant from a startup.
INSTITUTION = r"(?i)\b(universit\w*|college|institut\w*|hospital|klinik\w*|research council|academy|academia|cnrs|inserm|fraunhofer|max[- ]planck|tno|csic|kaist|a\*star|commissariat|government|ministry|secretary of)\b"
IP_VEHICLE = r"(?i)\b(licensing|global technolog(?:y|ies)|technology operations|ip holdings?|ipr management|innovations?,? (?:llc|l\.l\.c|inc)|international sales|bidco|opco|operating company|apollo, llc|enterprise management|limited partnership)\b"
ORG_SUFFIX = r"(?i)\b(inc|incorporated|corp|corporation|co|company|ltd|limited|llc|l\.l\.c|gmbh|ag|s\.?a|s\.?a\.?s|b\.?v|n\.?v|plc|ab|oy|oyj|hf|ehf|k\.?k|pte|pty|s\.?r\.?l|s\.?p\.?a|sarl|se|ltda|lda|a/?s|asa|aps|kft|zrt|sp\.? z o\.?o|ou|oü|bhd|sdn|kg|flexco|kaisha|e\.?v)\.?$"
ORG_WORD = r"(?i)\b(technolog\w*|systems?|labs?|robotics|solutions|software|energy|therapeutics|bio\w*|networks?|devices|industries|group|ai)\b"


def industry_scope(group: Column, name: Column) -> Column:
    """core, adjacent (only where the name says technology) or null."""
    g = F.lower(F.coalesce(group, F.lit("")))
    return F.when(g.isin(*TECH_GROUPS), "core").when(g.isin(*ADJACENT_GROUPS) & F.coalesce(name, F.lit("")).rlike(TECH_NAME), "adjacent")


def _gated(reasons_of: Column, passed: Column) -> Column:
    return F.struct(F.when(F.size(reasons_of) > 0, "reject").otherwise(passed).alias("tier"), reasons_of.alias("reasons"))


def offering_gate(name: Column, group: Column, is_fund: Column, is_new: Column) -> Column:
    """Struct of tier (alert, queue or reject) and reasons of an offering notice."""
    scope = industry_scope(group, name)
    word = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), VEHICLE_NAME, 1))
    why = reasons(
        (F.coalesce(is_fund, F.lit(False)), "investment_fund"),
        (scope.isNull(), F.concat(F.lit("industry:"), F.coalesce(group, F.lit("none")))),
        (word != "", F.concat(F.lit("vehicle_name:"), word)),
    )
    return _gated(why, F.when((scope == "core") & F.coalesce(is_new, F.lit(True)), "alert").otherwise("queue"))


def person_like(name: Column) -> Column:
    """Whether an applicant's name is a person's: two to four plain words without a mark of an organisation."""
    n = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), "[.,]", " "), r"\s+", " "))
    words = F.split(n, " ")
    plain = F.forall(words, lambda w: w.rlike(r"^[\p{L}'-]+$"))
    cased = (F.size(words) == 2) | F.exists(words, lambda w: w != F.upper(w))
    marked = n.rlike(ORG_SUFFIX) | n.rlike(ORG_WORD) | n.rlike(INSTITUTION)
    return (n != "") & ~marked & F.size(words).between(2, 4) & plain & cased


def applicant_gate(name: Column, excluded: Column) -> Column:
    """Struct of tier (queue or reject) and reasons of a patent's applicant."""
    n = F.trim(F.coalesce(name, F.lit("")))
    none = (n == "") | n.rlike(r"(?i)\(inventor-held\)$|^unassigned publication$")
    why = reasons(
        (none, "no_company_applicant"),
        (~none & F.coalesce(excluded, F.lit(False)), "excluded_applicant"),
        (~none & n.rlike(INSTITUTION), "institution"),
        (~none & n.rlike(IP_VEHICLE), "corporate_ip_vehicle"),
        (~none & person_like(n), "individual_applicant"),
    )
    return _gated(why, F.lit("queue"))


def filing_class(name: Column, is_fund: Column, group: Column) -> Column:
    """Why a filing isn't eligible: no_name, fund or not_tech; null where it is."""
    return F.when(F.coalesce(name, F.lit("")) == "", "no_name").when(F.coalesce(is_fund, F.lit(False)), "fund").when(industry_scope(group, name).isNull(), "not_tech")


def run_class(status: Column, error: Column, dry: Column, failures: Column, rows: Column) -> Column:
    """error, dry_run, partial, empty or ok of a run."""
    failed = F.coalesce(failures, F.lit(0)) > 0
    return F.when((status >= 400) | error.isNotNull(), "error").when(F.coalesce(dry, F.lit(False)), "dry_run").when(failed & (rows == 0), "error").when(failed, "partial").when(rows == 0, "empty").otherwise("ok")


# Kinds of sources, most trusted first.
SOURCE_KINDS = ("manual", "registry", "company_site", "press_release", "news", "aggregator_snippet", "model_inferred")


def source_rank(kind: Column) -> Column:
    """6 for the most trusted kind of source, 0 for the least; null for another."""
    last = len(SOURCE_KINDS) - 1
    return F.coalesce(*[F.when(kind == k, last - i) for i, k in enumerate(SOURCE_KINDS)])


def rank_conflict(on_file: Column, found: Column) -> Column:
    """Which of two sources' values stands by their kinds: keep_existing, keep_new, or unresolved where neither is trusted more."""
    a, b = F.nullif(on_file, F.lit("")), F.nullif(found, F.lit(""))
    x, y = source_rank(a), source_rank(b)
    return F.when(a.isNull() & b.isNull(), "unresolved").when(a.isNull(), "keep_new").when(b.isNull(), "keep_existing").when(y > x, "keep_new").when(x > y, "keep_existing").otherwise("unresolved")


def domain_standing(kind: Column) -> Column:
    """Struct of kind (allowed, denied), tier and why that a domain's class means; null for an investor's, which another rule judges."""
    news = kind.isin("news_outlet", "wire")
    tier = F.when(news, 4)
    return F.when(kind.isNotNull() & (kind != "investor"), F.struct(F.when(news, "allowed").otherwise("denied").alias("kind"), tier.alias("tier"), news.alias("low_confidence"), F.concat(F.lit("auto_"), kind).alias("why")))


def backoff_seconds(attempt: Column) -> Column:
    """Seconds to wait after a failed attempt (the first is 1): a minute, four times as long each time, an hour at most."""
    return F.least(F.lit(3600.0), 60 * F.pow(F.lit(4.0), F.greatest(F.lit(0), attempt - 1))).cast("long")


def shown_round_type(kind: Column) -> Column:
    """A round's type in plain words: one that no source states is undisclosed."""
    return F.when(kind.isNull() | kind.isin("", "Unknown"), "Undisclosed").otherwise(kind)
