"""Parsing of free-text postings: header line, bulleted roles, role links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolefunnel.functions.text import SPACE, blank_to_null, let, split_lines, strip
from rolefunnel.functions.urls import extract_url, is_application_link, recover_prefix

# Patterns and limits results depend on.
MONEY_PATTERN = rf"(?i)\$[{SPACE}]?\d|\d[\d,]*[{SPACE}]?k\+?|equity|salary|/[{SPACE}]*year|/[{SPACE}]*hr\b|per[{SPACE}]+hour|per[{SPACE}]+year"
EMPLOYMENT_TYPE_PATTERN = rf"(?i)^(full[{SPACE}-]?time|part[{SPACE}-]?time|contract(or)?s?|freelance|intern(ship)?)s?$"
PLACE_PREFIX_PATTERN = r"(?i)^(remote|onsite|on-site|hybrid)\b"
URL_PREFIX_PATTERN = r"(?i)^https?://"
ROLES_HEADING_PATTERN = r"(?i)^[ \t]*(open (?:now|roles?|positions?)|we'?re hiring|current openings?)[ \t]*:?[ \t]*$"
BULLET_PATTERN = r"^[ \t]*[-•–][ \t]+(.+)$"
ROLE_SEPARATOR_PATTERN = rf"[{SPACE}]+[—–][{SPACE}]+|[{SPACE}]+-[{SPACE}]+|:[{SPACE}]+"
SELF_PROFILE_PATTERN = rf"(?i)willing to relocate[{SPACE}]*:|r[ée]sum[ée][{SPACE}]*/?[{SPACE}]*cv[{SPACE}]*:"
ROLE_MARKER_PATTERN = rf"(?i)^[{SPACE}]*seeking[{SPACE}]+freelancers?\b[{SPACE}]*[|\-:,]?[{SPACE}]*"
ROLE_NOT_STATED = "Role not stated in header — see description"
EMPTY_HEADER = "HN Who's Hiring post"
MIN_ROLE_LINKS = 2


@dataclass(frozen=True)
class Limits:
    """How much of a posting's names is kept; None keeps everything.

    ``line_chars``: of a header without parts; ``name_chars``: of company and role in a
    header; ``role_chars``, ``role_words``: a longer bullet is no role name;
    ``shown_roles``, ``title_chars``: of a title made of several roles.
    """

    line_chars: int | None = None
    name_chars: int | None = None
    role_chars: int | None = None
    role_words: int | None = None
    shown_roles: int | None = None
    title_chars: int | None = None


ALL = Limits()
# Limits for display.
SHORT = Limits(line_chars=80, name_chars=120, role_chars=80, role_words=12, shown_roles=5, title_chars=200)


def _at_most(c: Column, chars: int | None) -> Column:
    return c if chars is None else F.left(c, F.lit(chars))


def is_non_role_segment(segment: Column) -> Column:
    """Pay, employment type, place or link: not a role title."""
    return (
        segment.rlike(MONEY_PATTERN)
        | segment.rlike(EMPLOYMENT_TYPE_PATTERN)
        | segment.rlike(PLACE_PREFIX_PATTERN)
        | segment.rlike(URL_PREFIX_PATTERN)
    )


def first_line(text: Column) -> Column:
    return F.get(split_lines(text), F.lit(0))


def strip_role_marker(line: Column, pattern: str = ROLE_MARKER_PATTERN) -> Column:
    """Remove the leading marker once, where it is there."""
    return strip(F.regexp_replace(line, pattern, ""))


def parse_header(line: Column, placeholder: str = ROLE_NOT_STATED, limits: Limits = ALL) -> Column:
    """struct(company, title) of a ``Company | Role | ...`` line."""
    snippet = F.coalesce(blank_to_null(_at_most(strip(line), limits.line_chars)), F.lit(EMPTY_HEADER))

    def name(segments: Column) -> Column:
        rest = F.slice(segments, 2, F.greatest(F.size(segments), F.lit(1)))
        roles = F.filter(rest, lambda s: ~is_non_role_segment(s))
        role = F.coalesce(_at_most(F.get(roles, F.lit(0)), limits.name_chars), F.lit(placeholder))
        company = _at_most(F.get(segments, F.lit(0)), limits.name_chars)
        several = F.size(segments) >= 2
        return F.struct(
            F.when(several, company).otherwise(snippet).alias("company"),
            F.when(several, role).otherwise(snippet).alias("title"),
        )

    return let(F.filter(F.transform(F.split(line, r"\|"), strip), lambda s: s != ""), name)


def _before_separator(text: Column) -> Column:
    head = F.get(F.split(text, ROLE_SEPARATOR_PATTERN, 2), F.lit(0))
    return F.substring_index(head, "(", 1)


def _plausible(name: Column, limits: Limits) -> Column:
    ok = (name != "") & ~F.endswith(name, F.lit("."))
    if limits.role_chars is not None:
        ok = ok & (F.length(name) <= limits.role_chars)
    if limits.role_words is not None:
        ok = ok & (F.size(F.split(strip(name), rf"[{SPACE}]+")) <= limits.role_words)
    return ok


def role_name(text: Column, reject_emphasis: bool = True, limits: Limits = ALL) -> Column:
    """Role name at the start of a bullet, or null when it does not read like one."""
    head = strip(_before_separator(text))
    name = F.trim(head, F.lit(" -:"))
    ok = _plausible(name, limits)
    if reject_emphasis:
        starred = (F.length(head) >= 2) & F.startswith(head, F.lit("*")) & F.endswith(head, F.lit("*"))
        ok = ok & ~starred
    return F.when(ok, name)


def bullet_text(line: Column) -> Column:
    return F.regexp_extract(line, BULLET_PATTERN, 1)


def is_bullet(line: Column) -> Column:
    return line.rlike(BULLET_PATTERN)


def bullet_run(lines: Column, heading: str = ROLES_HEADING_PATTERN) -> Column:
    """Texts of the bullets right below the first heading; blank lines do not end the run."""

    def run_after(after: Column) -> Column:
        ends = F.transform(after, lambda s: ~is_bullet(s) & (strip(s) != ""))
        end = F.array_position(ends, True).cast("int")
        run = F.when(end > 0, F.slice(after, 1, end - 1)).otherwise(after)
        return F.transform(F.filter(run, is_bullet), lambda s: strip(bullet_text(s)))

    def find(ls: Column) -> Column:
        headings = F.transform(ls, lambda s: s.rlike(heading))
        at = F.array_position(headings, True).cast("int")
        none = F.array().cast("array<string>")
        return F.when(
            F.array_contains(headings, True), let(F.slice(ls, at + 1, F.size(ls) + 1), run_after)
        ).otherwise(none)

    return let(lines, find)


def bulleted_title(body: Column, heading: str = ROLES_HEADING_PATTERN, limits: Limits = ALL) -> Column:
    """``Multiple roles: a, b (+n more)`` from at least two bulleted names, else null."""
    names = F.array_compact(
        F.transform(bullet_run(split_lines(body), heading), lambda t: role_name(t, reject_emphasis=False, limits=limits))
    )

    def render(n: Column) -> Column:
        shown, more = n, F.lit("")
        if limits.shown_roles is not None:
            shown, extra = F.slice(n, 1, limits.shown_roles), F.size(n) - limits.shown_roles
            more = F.when(extra > 0, F.concat(F.lit(" (+"), extra.cast("string"), F.lit(" more)"))).otherwise("")
        title = F.concat(F.lit("Multiple roles: "), F.array_join(shown, ", "), more)
        return F.when(F.size(n) >= 2, _at_most(title, limits.title_chars))

    return let(names, render)


def bullet_spans(lines: Column) -> Column:
    """array<struct(text, span)>: each bullet with the lines up to the next one."""

    def spans(p: Column) -> Column:
        ls = p["lines"]

        def span(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(p["starts"], k + 1), F.size(ls) + 1)
            return F.struct(
                bullet_text(F.get(ls, start - 1)).alias("text"),
                F.array_join(F.slice(ls, start, end - start), "\n").alias("span"),
            )

        return F.transform(p["starts"], span)

    def with_starts(ls: Column) -> Column:
        starts = F.array_compact(F.transform(ls, lambda s, i: F.when(is_bullet(s), i + 1)))
        return let(F.struct(ls.alias("lines"), starts.alias("starts")), spans)

    return let(lines, with_starts)


def role_links(body: Column, hrefs: Column, limit: int | None = None, limits: Limits = ALL) -> Column:
    """array<struct(name, url)> of bullets that carry a role name and their own link."""

    def pair(b: Column) -> Column:
        url = recover_prefix(extract_url(b["span"]), hrefs)
        return F.struct(role_name(b["text"], limits=limits).alias("name"), url.alias("url"))

    pairs = F.transform(bullet_spans(split_lines(body)), pair)
    good = F.filter(
        pairs, lambda p: p["name"].isNotNull() & p["url"].isNotNull() & is_application_link(p["url"])
    )
    return good if limit is None else F.slice(good, 1, limit)
