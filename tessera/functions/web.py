"""URLs, hosts and registrable domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Second-level labels that registries hand out under a country code.
REGISTRY_LABELS = (
    "co com net org ac gov govt gob edu mil int or ne go re pe lg hs ms sch res nic firm gen ind nom web info biz ltd plc me id in tm"
).split()
# Labels before each country code that make a public suffix.
SUFFIXES = {
    "uk": "co org ac gov net sch ltd plc me",
    "au": "com net org edu gov id asn",
    "nz": "co net org ac govt geek school",
    "za": "co org net ac gov web",
    "ke": "co or ne ac go",
    "kr": "co or ne re pe go ac hs ms es",
    "cn": "com net org gov edu ac mil",
    "tw": "com net org edu gov idv",
    "hk": "com net org edu gov idv",
    "jp": "co or ne ac go lg ad ed gr",
    "sg": "com net org edu gov per",
    "in": "co net org firm gen ind ac edu gov res",
    "id": "co or net web ac go sch my biz",
    "th": "co or in ac go net mi",
    "my": "com net org edu gov mil",
    "vn": "com net org edu gov biz info",
    "ph": "com net org edu gov",
    "pk": "com net org edu gov biz",
    "bd": "com net org edu gov",
    "lk": "com net org edu gov",
    "np": "com net org edu gov",
    "il": "co org net ac gov muni k12",
    "ae": "co org net ac gov sch",
    "sa": "com net org edu gov med",
    "tr": "com net org edu gov bel web gen",
    "qa": "com net org edu gov",
    "kw": "com net org edu gov",
    "jo": "com net org edu gov",
    "lb": "com net org edu gov",
    "eg": "com net org edu gov",
    "br": "com net org gov edu art ind",
    "ar": "com net org gob edu int",
    "mx": "com net org edu gob",
    "co": "com net org edu gov nom",
    "pe": "com net org edu gob nom",
    "cl": "com gob gov",
    "uy": "com net org edu gub",
    "ve": "com net org edu gob",
    "ec": "com net org edu gob fin",
    "bo": "com net org edu gob",
    "gt": "com net org edu gob",
    "ru": "com net org edu ac",
    "ua": "com net org edu gov in kiev",
    "pl": "com net org edu gov biz info waw",
    "es": "com org nom gob edu",
    "gr": "com net org edu gov",
    "pt": "com org edu gov int",
    "cy": "com net org ac gov",
    "mt": "com net org edu gov",
    "hr": "com", "ro": "com", "by": "com", "ge": "com", "mk": "com", "al": "com",
    "rs": "co org edu gov",
    "it": "gov edu",
    "ca": "gc qc on ab bc",
    "ng": "com net org edu gov",
    "gh": "com", "tz": "com co", "ug": "co", "zm": "co", "mz": "co", "bw": "co",
}


def _suffix_pattern() -> str:
    """Regular expression of a host's last two labels that are a public suffix."""
    ways = [f"(?:{'|'.join(labels.split())})[.]{code}" for code, labels in SUFFIXES.items()]
    return f"[.](?:{'|'.join(ways)})$"


def site_host(url: Column) -> Column:
    """Host of a URL or bare address: no scheme, ``www.``, path or port; blank is null."""
    bare = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "(?i)^[a-z]+://", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?i)^www\.", ""), "(?s)[/:?#].*$", "")
    return F.nullif(F.lower(bare), F.lit(""))


def registrable_domain(url: Column) -> Column:
    """The domain that someone registered, or null where it isn't certain.

    A host that ends in a known two-label suffix keeps one label more, any other
    its last two.  Two labels that look like a registry's own suffix give null: a
    lost match is better than all companies of a country under one domain.
    """
    host = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), "^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_extract(host, "^[^/?#]*", 0)
    host = F.when(F.contains(host, F.lit("@")), F.split_part(host, F.lit("@"), F.lit(2))).otherwise(host)
    host = F.regexp_replace(F.regexp_replace(F.split_part(host, F.lit(":"), F.lit(1)), r"^www\.", ""), r"\.+$", "")
    labels = F.split(host, r"\.")
    last_two = F.array_join(F.slice(labels, -2, 2), ".")
    unsure = F.get(labels, F.size(labels) - 2).isin(REGISTRY_LABELS) & (F.length(F.get(labels, F.size(labels) - 1)) == 2)
    return (
        F.when(~F.contains(host, F.lit(".")), None)
        .when(host.rlike(_suffix_pattern()), F.array_join(F.slice(labels, -3, 3), "."))
        .when(unsure, None)
        .otherwise(last_two)
    )


def same_site(a: Column, b: Column) -> Column:
    return F.coalesce((site_host(a) == site_host(b)) | (registrable_domain(a) == registrable_domain(b)), F.lit(False))


def hosted_owner(url: Column, host: str) -> Column:
    """First path segment below a hosting site (an organisation's name there), lower-cased, else null."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), rf"(?i)^https?://(?:www\.)?{host}/([^/?#\s]+)", 1)), F.lit(""))


# Parameters that only track.
TRACKING = r"(?i)^(?:srsltid|utm_[a-z]+|gclid|fbclid|mc_cid|mc_eid|msclkid|igshid|ref_src)$"


def without_tracking(url: Column) -> Column:
    """An address without tracking parameters, host in lower case, and ``/`` where it has no path; what isn't an address stays."""
    site = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+)", 1)
    rest = F.substr(url, F.length(site) + 1)
    path, query, mark = (F.regexp_extract(rest, r"(?s)^([^?#]*)(\?[^#]*)?(#.*)?$", i) for i in (1, 2, 3))
    params = F.split(F.substr(query, F.lit(2)), "&")
    tracks = lambda p: F.split_part(p, F.lit("="), F.lit(1)).rlike(TRACKING)
    kept = F.array_join(F.filter(params, lambda p: ~tracks(p) & (p != "")), "&")
    asked = F.when(F.exists(params, tracks), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")).when((query == "?") & (mark == ""), "").otherwise(query)
    clean = F.concat(F.lower(site), F.when(path == "", "/").otherwise(path), asked, mark)
    return F.when(url.isNull() | (site == "") | url.rlike(r"\s"), url).otherwise(clean)


def is_web_link(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^https?://\S+$"), F.lit(False))


def top_level_group(url: Column) -> Column:
    """com, org, net, a two-letter country code, other, or none."""
    top = F.regexp_extract(F.coalesce(site_host(url), F.lit("")), r"\.([a-z]+)$", 1)
    return F.when(top == "", "none").when(top.isin("com", "org", "net", "io", "ai"), top).when(F.length(top) == 2, F.concat(F.lit("cc:"), top)).otherwise("other")


def filing_url(base: str, entity: Column, accession: Column) -> Column:
    """Address of a filing where both numbers are well formed, else null."""
    good = entity.rlike("^[0-9]+$") & accession.rlike("^[0-9-]+$")
    return F.when(good, F.concat(F.lit(base), F.ltrim(entity, F.lit("0")), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/")))


def url_date(url: Column, today: Column | None = None) -> Column:
    """Day in an address: ``/yyyy/mm/dd/`` (or with dashes), a press wire's ``/home/yyyymmddNNNN``, or ``/yyyymmdd``; else null.

    The first form that is there decides.  A day before 1990, after ``today`` or
    that the calendar hasn't is null.
    """
    address = F.coalesce(url, F.lit(""))
    forms = (r"/((?:19|20)\d{2})[/-](\d{2})[/-](\d{2})(?=[/\-_?#]|$)", r"/home/((?:19|20)\d{2})(\d{2})(\d{2})\d{4,}", r"/((?:19|20)\d{2})(\d{2})(\d{2})(?=[/\-_?#]|$)")
    found = [F.nullif(F.concat(*[F.regexp_extract(address, form, i) for i in (1, 2, 3)]), F.lit("")) for form in forms]
    day = F.try_to_date(F.coalesce(*found), "yyyyMMdd")
    return F.when((F.year(day) >= 1990) & (day <= (F.current_date() if today is None else today)), day)


ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def decode_entities(text: Column) -> Column:
    for name, sign in ENTITIES.items():  # the ampersand last
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def escape_html(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def html_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags out, entities decoded, blanks collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(bare, r"(?s)<[^>]*>", " ")), r"\s+", " "))


def script_json(html: Column, name: str) -> Column:
    """Text of the object that a page's script assigns to ``name``, else null."""
    return F.nullif(F.regexp_extract(html, rf"(?s)\b{name}\s*=\s*(\{{.*?\}})\s*;?\s*</script>", 1), F.lit(""))


# Hosts of code, free pages and social networks, which no company owns.
SHARED_HOSTS = (
    "github.com github.io githubusercontent.com gitlab.com gitlab.io bitbucket.org huggingface.co hf.space hf.co readthedocs.io readthedocs.org vercel.app netlify.app pages.dev "
    "herokuapp.com streamlit.app gradio.live replit.app colab.research.google.com sites.google.com notion.site substack.com medium.com arxiv.org twitter.com x.com linkedin.com "
    "discord.gg discord.com youtube.com pypi.org npmjs.com kaggle.com paperswithcode.com"
).split()


def own_domain(host: Column) -> Column:
    """Whether a host may be a company's own: it has a dot and isn't (below) a shared one."""
    shared = "|".join(x.replace(".", r"\.") for x in SHARED_HOSTS)
    h = F.coalesce(host, F.lit(""))
    return F.contains(h, F.lit(".")) & ~h.rlike(rf"(^|\.)({shared})$")


def under_domain(host: Column, domain: Column) -> Column:
    """Whether a host is a domain or one of its subdomains."""
    return F.coalesce((host == domain) | F.endswith(host, F.concat(F.lit("."), domain)), F.lit(False))


def search_words(raw: str) -> str:
    """A typed search without what would widen a filter, 80 characters at most."""
    kept = "".join(" " if c in ",()*%_\\:\"'" else c for c in raw)
    return " ".join(kept.split())[:80]


def profile_url(url: Column) -> Column:
    """Canonical address of a personal profile, else null."""
    name = F.lower(F.try_url_decode(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^https?://(?:[a-z]{2,3}\.|www\.)?linkedin\.com/in/([^/?#\s]+)", 1)))
    return F.when(name != "", F.concat(F.lit("https://www.linkedin.com/in/"), name))
