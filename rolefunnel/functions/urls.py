"""URL and e-mail extraction, canonical URLs, and choosing the link to apply through."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolefunnel.functions.constants import const_array
from rolefunnel.functions.entities import html_unescape
from rolefunnel.functions.text import SPACE, WORD, blank_to_null, let, strip

# Patterns and word lists results depend on.
URL_PATTERN = rf"https?://[^{SPACE})>\]]+"
EMAIL_PATTERN = rf"[{WORD}.+-]++@[{WORD}-]+\.[{WORD}.-]+"
HREF_PATTERN = r"""(?i)href=["']([^"']+)["']"""
TRAILING_PUNCTUATION = ".,;:"
APPLY_DOMAINS = [
    "greenhouse.io",
    "lever.co",
    "ashbyhq.com",
    "workable.com",
    "bamboohr.com",
    "breezy.hr",
    "smartrecruiters.com",
    "myworkdayjobs.com",
    "recruitee.com",
    "personio.com",
    "jobvite.com",
    "icims.com",
    "taleo.net",
]
APPLY_PATH_PATTERN = r"(?i)/(careers?|jobs?|apply|positions?|join(-us)?)(/|$|\?)"
APPLY_CUE_PATTERN = rf"(?i)apply|careers?|open[{SPACE}]+roles?|open[{SPACE}]+positions?|job[{SPACE}]+board|hiring[{SPACE}]+page"
APPLY_CUE_WINDOW = 60
NON_APPLICATION_DOMAINS = ["linkedin.com", "twitter.com", "x.com", "github.com"]


def url_host(c: Column) -> Column:
    """Lower-cased authority of a URL, empty when it has none."""
    return F.lower(F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))


def normalize_url(c: Column, keep_query_hosts: list[str] | None = None) -> Column:
    """Canonical identity of a URL: https, host without ``www.``, path, nothing else.

    ``keep_query_hosts`` names hosts whose query string is part of the identity.
    """
    raw = strip(F.coalesce(c, F.lit("")))
    scheme, rest = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?", r"(\?[^#]*)?"
    host = F.regexp_replace(F.lower(F.regexp_extract(raw, scheme + r"//([^/?#]*)", 1)), r"^www\.", "")
    # The path without its end slashes; a relative one gets a slash in front.
    path = F.regexp_extract(raw, scheme + r"(?://[^/?#]*)?([^?#]*?)/*(?:[?#]|$)", 1)
    rooted = F.regexp_replace(path, r"^(?=[^/])", "/")
    parts = [F.lit("https://"), host, rooted]
    if keep_query_hosts:
        query = F.regexp_extract(raw, scheme + r"(?://[^/?#]*)?[^?#]*" + rest, 1)
        parts.append(F.when(host.isin(keep_query_hosts), query).otherwise(""))
    return F.when(c.isNotNull() & (c != ""), F.concat(*parts)).otherwise("")


def extract_email(c: Column) -> Column:
    found = blank_to_null(F.regexp_extract(c, EMAIL_PATTERN, 0))
    return F.when(F.contains(c, F.lit("@")), found)


def extract_url(c: Column, trailing: str = TRAILING_PUNCTUATION) -> Column:
    return blank_to_null(F.rtrim(F.regexp_extract(c, URL_PATTERN, 0), F.lit(trailing)))


def extract_hrefs(c: Column) -> Column:
    """Every ``href`` of an HTML fragment in order, decoded and without end punctuation."""
    raw = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(HREF_PATTERN), F.lit(1))
    return F.transform(raw, lambda h: F.rtrim(html_unescape(h), F.lit(TRAILING_PUNCTUATION)))


def recover_prefix(url: Column, hrefs: Column) -> Column:
    """The first href that properly extends ``url`` (a display-truncated link), else ``url``."""
    longer = F.filter(hrefs, lambda h: F.startswith(h, url) & (F.length(h) > F.length(url)))
    return F.coalesce(F.get(longer, F.lit(0)), url)


def best_apply_url(text: Column, hrefs: Column, domains: list[str] = APPLY_DOMAINS) -> Column:
    """The URL in ``text`` most likely to be the application link.

    Known recruiting host 3, careers-like path 2, a cue word in the characters
    just before it 1, otherwise 0; the first of the best wins.
    """
    text = F.coalesce(text, F.lit(""))
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(URL_PATTERN), F.lit(0)).alias("urls"),
        F.split(text, URL_PATTERN, -1).alias("gaps"),
    )

    def total_length(pieces: Column) -> Column:
        return F.aggregate(pieces, F.lit(0), lambda acc, s: acc + F.length(s))

    def choose(p: Column) -> Column:
        def ranked(raw: Column, i: Column) -> Column:
            links = F.when(i > 0, total_length(F.slice(p["urls"], 1, i))).otherwise(0)
            start = total_length(F.slice(p["gaps"], 1, i + 1)) + links
            begin = F.greatest(F.lit(0), start - APPLY_CUE_WINDOW)
            before = F.substr(text, begin + 1, start - begin)
            url = recover_prefix(F.rtrim(raw, F.lit(TRAILING_PUNCTUATION)), hrefs)
            known_host = F.exists(const_array(domains), lambda d: F.contains(F.lower(url), d))
            score = (
                F.when(known_host, 3)
                .when(url.rlike(APPLY_PATH_PATTERN), 2)
                .when(before.rlike(APPLY_CUE_PATTERN), 1)
                .otherwise(0)
            )
            return F.struct((-score).alias("s"), i.alias("i"), url.alias("url"))

        return F.array_min(F.transform(p["urls"], ranked))["url"]

    return F.when(F.contains(text, F.lit("://")), let(parts, choose))


def application_channel(has_url: Column, email: Column, email_first: bool = False) -> Column:
    """How to apply; feeds prefer the link, free-text threads prefer the address."""
    by_url, by_email = F.coalesce(has_url, F.lit(False)), email.isNotNull()
    if email_first:
        return F.when(by_email, "email").when(by_url, "url").otherwise("unknown")
    return F.when(by_url, "url").when(by_email, "email").otherwise("unknown")


def is_application_link(url: Column, domains: list[str] = NON_APPLICATION_DOMAINS) -> Column:
    """False for links on (sub-domains of) the given profile hosts."""
    host = url_host(url)
    social = F.exists(
        const_array(domains), lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d))
    )
    return ~social
