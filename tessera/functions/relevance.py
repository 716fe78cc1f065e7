"""Whether an article is news about a company, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.reports import is_announcement

# Titles of guides, of lists of many companies, words behind a company's name, words that say nothing of a product,
# lines at the head of a page's text, verbs before what is bought, and paths of news and of posts on a company's own site.
EXPLAINER = (
    r"(?i)\b(roundup|round-up|weekly digest|newsletter|lessons from|lessons learned|tips for|tips to|how to|what (?:to know|is|are|you (?:need|should) (?:to )?know)|how to (?:buy|invest|trade|use)|should you (?:buy|invest)|is [^?]{0,50} a good (?:investment|buy)"
    r"|price prediction|before investing|investing in|explained|explainer|beginner'?s guide|a guide to|everything you need to know|pros and cons|where to buy|(?:rules|ways|steps|reasons|things|tips|questions|mistakes|signs|factors)\s+(?:for|to|when)\s+(?:choosing|picking|selecting|buying|evaluating|investing)"
    r"|how to choose|choosing (?:a|an|the)\b|(?:\d+|one|two|three|four|five|six|seven|eight|nine|ten)\s+(?:rules|ways|steps|reasons|things|tips|questions|mistakes|signs|factors)\b)\b"
)
LISTICLE = (
    r"(?i)\b\d+\s+(?:best|top|leading|greatest)\b|\b(?:best|top)\s+(?:\w+\s+){0,3}(?:alternatives?|competitors|apps|tools|services|providers|platforms|options|companies|startups|vendors)\b|\b\w+\s+alternatives?\b|\balternatives?\s+(?:to|for)\b|\btop\s+\d+\b"
)
DESCRIPTORS = "ai inc ltd llc gmbh corp co labs lab technologies technology tech systems medical applied group holdings solutions software bio health therapeutics robotics networks".split()
GENERIC = (
    "platform software company solution solutions technology technologies provider startup based leading global digital services service business businesses tools product products application applications system systems firm maker developer developers"
    " enterprise cloud online powered driven first next generation new that with from into their which your other"
).split()
HEAD_LINE, LINK_LINE = r"(?i)^(?:Title|URL Source|Published Time|Markdown Content|Date):", r"^(?:!?\[|https?:|\W*[-*]\s*\[)"
TAKES = "acquires?|acquired|buys?|to acquire|merges? with|invests? in|backs?|funds?|takes? over"
BUYING = r"(?i)\b(?:acqui|buys?|bought|sale of|sells?|sold|takeover|merge)"
NEWS_PATHS = r"/(?:news|press|newsroom|press-releases?|pressroom|media|in-the-news|announcements?|company-news)(?:/|$)"
POST_PATHS = r"/(?:blog|blog-posts|insights|resources|articles|posts|stories)(?:/|$)"

_MARK = "\u0001"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def explainer(title: Column) -> Column:
    """Whether a headline is a guide's or a list's instead of a report's."""
    return F.coalesce(title.rlike(EXPLAINER) | title.rlike(LISTICLE), F.lit(False))


def first_paragraph(content: Column) -> Column:
    """The first line of prose (60 characters or more, no header line, no link) of a page's text, or the text; 500 characters of it."""
    lines = F.transform(F.split(F.replace(_text(content), F.lit("\r"), F.lit("")), "\n+"), lambda x: F.trim(x))
    prose = F.filter(lines, lambda x: (F.length(x) >= 60) & ~x.rlike(HEAD_LINE) & ~x.rlike(LINK_LINE))
    return F.substr(F.coalesce(F.get(prose, F.lit(0)), _text(content)), F.lit(1), F.lit(500))


def _name_pattern(company: Column) -> Column:
    """The name as a regular expression with any blanks between its words."""
    quoted = F.replace(F.trim(company), F.lit(r"\E"), F.lit(r"\E\\E\Q"))
    return F.concat(F.lit(r"\Q"), F.regexp_replace(quoted, r"\s+", r"\\E\\s+\\Q"), F.lit(r"\E"))


def only_after_hyphen(text: Column, company: Column) -> Column:
    """Whether a name stands in a text, but only as the end of a hyphenated word (``SW-Mototech`` isn't Mototech)."""
    found = F.regexp_extract_all(text, F.concat(F.lit(r"(?iU)(?<![\p{L}\p{N}])(?:[\p{L}\p{N}]+[-–])?"), _name_pattern(company), F.lit(r"(?![\p{L}\p{N}])")), F.lit(0))
    return (F.size(found) > 0) & F.forall(found, lambda x: x.rlike(r"^[\p{L}\p{N}]+[-–]"))


def names_up_front(title: Column, content: Column, company: Column) -> Column:
    """Whether the headline or the first paragraph names the company.

    A possessive in the headline counts only at its beginning, else the
    paragraph must name the company; a name without its trailing descriptors
    counts in the headline.  A blank name is in every article.
    """
    core = F.trim(F.regexp_replace(F.regexp_replace(F.lower(_text(company)), r"[^\p{L}\p{N} ]", " "), r"\s+", " "))

    def flat(text: Column, possessive: str) -> Column:
        bare = F.regexp_replace(F.regexp_replace(F.lower(text), r"[’']s\b", possessive), r"[^\p{L}\p{N} _]", " ")
        return F.concat(F.lit(" "), F.regexp_replace(bare, r"\s+", " "), F.lit(" "))

    def within(text: Column, name: Column) -> Column:
        return text.contains(F.concat(F.lit(" "), name, F.lit(" ")))

    def has(text: Column) -> Column:
        return within(text, core) | within(text, F.replace(core, F.lit(" "), F.lit("")))

    own, opened = _text(title), flat(first_paragraph(content), " s")
    outright, loose = flat(own, "_poss"), flat(own, " s")
    words = "|".join(DESCRIPTORS)
    short = F.regexp_replace(core, rf"^(\S+(?: \S+)*?)(?: (?:{words}))+$", "$1")
    shortened = (short != core) & (F.length(short) >= 3) & ~short.rlike(rf"^(?:{words})(?: (?:{words}))*$") & within(outright, short)
    possessive = has(loose) & F.startswith(F.trim(loose), core)
    hidden = only_after_hyphen(F.concat(own, F.lit("\n"), first_paragraph(content)), company)
    return (core == "") | (~hidden & (has(outright) | shortened | possessive | has(opened)))


def described_product(title: Column, content: Column, company: Column) -> Column:
    """What an article says the company is, before its name in the headline or after it in the lead; else null."""
    any_case = F.concat(F.lit("(?i)"), _name_pattern(company))
    head = F.regexp_replace(_text(title), F.concat(any_case, F.lit(r"\b")), F.lit(_MARK))
    lead = F.regexp_replace(F.substr(F.regexp_replace(_text(content), r"\s+", " "), F.lit(1), F.lit(600)), any_case, F.lit(_MARK))
    first = F.regexp_extract(head, rf"(?i)(?:{TAKES})\s+(.{{6,90}}?)\s+{_MARK}", 1)
    second = F.regexp_extract(lead, rf"(?i){_MARK},? (?:a|an|the) ([^,.;]{{6,90}}?)(?:[,.;]| (?:that|which|has|is|was|announced)\b)", 1)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")))


def _stems(text: Column) -> Column:
    words = F.filter(F.regexp_extract_all(F.lower(_text(text)), F.lit(r"\p{L}{4,}"), F.lit(0)), lambda w: ~w.isin(GENERIC))
    return F.transform(words, lambda w: F.substr(w, F.lit(1), F.lit(5)))


def news_problem(title: Column, content: Column, company: Column, description: Column, acquirers: Column | None = None) -> Column:
    """Why an article isn't news about a company: explainer, not_about_the_company or different_product; else null.

    ``acquirers`` lists the known buyers of the company: a headline in which one buys is about it.
    """
    low = F.lower(_text(title))
    bought = F.lit(False) if acquirers is None else F.coalesce(F.exists(acquirers, lambda a: (F.length(a) >= 3) & low.contains(F.lower(a))), F.lit(False)) & F.coalesce(title.rlike(BUYING), F.lit(False))
    product = _stems(described_product(title, content, company))
    other = (F.size(product) > 0) & ~F.arrays_overlap(product, F.concat(_stems(description), F.array(F.lit(""))))
    return F.when(explainer(title), "explainer").when(~names_up_front(title, content, company), "not_about_the_company").when(~bought & other, "different_product")


def own_site_news(url: Column, title: Column, company: Column) -> Column:
    """Whether a page of a company's own site is news: under a news path, or a post whose headline names it and announces something."""
    path = F.lower(F.regexp_extract(_text(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1))
    post = path.rlike(POST_PATHS) & names_up_front(title, F.lit(""), company) & F.coalesce(is_announcement(title), F.lit(False))
    return path.rlike(NEWS_PATHS) | post
