"""Text normalisation, tokenising, trimming and HTML stripping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolefunnel.functions.entities import html_unescape

# Spelled out because Java's \w and \s are ASCII-only by default.
WORD = r"\p{L}\p{N}_"
SPACE = r"\s\p{Z}\x0b\x1c-\x1f\x85"
SPACE_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 "
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "    　"
)
LINE_BREAK = r"\n\r\x0b\x0c\x1c-\x1e\x85  "

# The regex engine tests an enumerated class far faster than a Unicode property,
# so patterns over whole texts first rule out these characters in a look-ahead.
_FREQUENT = "".join(map(chr, [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0xDF, 0xF7)]))
_SPACES = rf"(?=[^{_FREQUENT}])[{SPACE}]+"


def strip(c: Column) -> Column:
    """Trim every Unicode white-space character on both sides."""
    return F.trim(c, F.lit(SPACE_CHARS))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def stripped_or_null(c: Column) -> Column:
    return blank_to_null(strip(c))


def _cleaned(c: Column) -> Column:
    spaced = F.lower(F.coalesce(c, F.lit("")))
    for separator in "-_/":
        spaced = F.replace(spaced, F.lit(separator), F.lit(" "))
    return F.regexp_replace(spaced, rf"(?=[^{_FREQUENT} \n])[^{WORD}{SPACE}]", "")


def normalize_text(c: Column) -> Column:
    """Lower-case, separators to spaces, other punctuation dropped, spaces collapsed."""
    return F.trim(F.regexp_replace(_cleaned(c), _SPACES, " "))


def tokens(c: Column) -> Column:
    """The words of ``normalize_text`` as an array, without building the joined text."""
    return F.array_remove(F.split(_cleaned(c), _SPACES), "")


def split_lines(c: Column) -> Column:
    return F.split(c, rf"\r\n|[{LINE_BREAK}]")


def strip_html(c: Column) -> Column:
    """Plain text of an HTML fragment.

    Entities are decoded first; bare block tags become line breaks, any other
    tag a space; blank lines go and the rest are trimmed.
    """
    text = html_unescape(F.coalesce(c, F.lit("")))
    text = F.regexp_replace(text, r"(?i)</?(?:p|div|br|li|tr|h[1-6])\s*/?>", "\n")
    text = F.regexp_replace(text, r"<[^>]++>", " ")
    text = F.regexp_replace(text, r"[ \t\xa0]+", " ")
    text = F.regexp_replace(text, rf"[{SPACE}]*[{LINE_BREAK}][{SPACE}]*", "\n")
    return strip(text)


def truncate(c: Column, length: int) -> Column:
    """At most ``length`` characters, the last one an ellipsis where text was cut."""
    c = F.coalesce(c, F.lit(""))
    cut = F.concat(F.left(c, F.lit(length - 1)), F.lit("…"))
    return F.when(F.length(c) > length, cut).otherwise(c)


def join_sections(sections: Column, separator: str = "\n\n") -> Column:
    """Join the non-blank members of an array of text sections."""
    return F.array_join(F.filter(sections, lambda s: strip(s) != ""), separator)


def headed_section(heading: Column, body: Column) -> Column:
    """``heading`` on its own line above ``body``; null when the body is empty."""
    heading = strip(F.coalesce(heading, F.lit("")))
    titled = F.when(heading != "", F.concat(heading, F.lit("\n"), body)).otherwise(body)
    return F.when(body != "", titled)


def join_present(parts: list[Column], separator: str = ", ") -> Column:
    """Join the non-empty parts; null when there is none."""
    return blank_to_null(F.concat_ws(separator, *[blank_to_null(p) for p in parts]))


def present(*parts: Column) -> Column:
    """Array of the parts that are neither null nor empty."""
    return F.array_compact(F.array(*[blank_to_null(p) for p in parts]))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside a lambda body."""
    return F.get(F.transform(F.array(value), body), 0)


def clamp(c: Column, low: int = 0, high: int = 100) -> Column:
    return F.when(c < low, low).when(c > high, high).otherwise(c)
