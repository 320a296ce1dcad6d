"""HTML character references decoded with column expressions only."""

from __future__ import annotations

import html
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolefunnel.functions.constants import const_array, const_map

# References that make up nearly all of real markup; looked up before the full table.
_COMMON = ["amp;", "lt;", "gt;", "quot;", "nbsp;", "#39;", "#x27;", "#x2F;", "#x2f;", "apos;"]


def _utf32(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _numeric(ref: Column) -> Column:
    is_hex = F.lower(F.substring(ref, 2, 1)) == "x"
    digits = F.regexp_replace(ref, "^#[xX]?0*|;$", "")
    # Nine digits already exceed the last code point in either base.
    code = F.when(F.length(digits) > 8, F.lit(0x7FFFFFFF)).otherwise(
        F.when(is_hex, F.conv(F.concat(F.lit("0"), digits), 16, 10))
        .otherwise(F.conv(F.concat(F.lit("0"), digits), 10, 10))
        .cast("bigint")
    )
    # HTML maps the C1 block to Windows-1252; the standard library knows how.
    c1 = {str(n): html.unescape(f"&#{n};") for n in range(0x80, 0xA0)}

    def decode(n: Column) -> Column:
        noncharacter = (
            n.between(0x1, 0x8)
            | (n == 0xB)
            | n.between(0xE, 0x1F)
            | (n == 0x7F)
            | n.between(0xFDD0, 0xFDEF)
            | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
        )
        return (
            F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit("�"))
            .when(n.between(0x80, 0x9F), F.element_at(const_map(c1), n.cast("string")))
            .when(noncharacter, F.lit(""))
            .otherwise(_utf32(n))
        )

    return F.get(F.transform(F.array(code), decode), 0)


_BUCKETS = 64


def _in_buckets(entries: dict[str, str], key: Column) -> Column:
    """Value of ``key``.  A map literal is searched entry by entry: one of a few dozen buckets holds the text of a small map."""
    parts: dict[str, list[str]] = {}
    for name, value in entries.items():
        parts.setdefault(str((ord(name[0]) + 7 * len(name)) % _BUCKETS), []).append(f"{name}\x04{value}")
    bucket = ((F.ascii(key) + 7 * F.length(key)) % _BUCKETS).cast("string")
    held = F.element_at(const_map({k: "\x03".join(v) for k, v in parts.items()}), bucket)
    return F.element_at(F.str_to_map(held, F.lit("\x03"), F.lit("\x04")), key)


def _named(ref: Column) -> Column:
    legacy = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
    prefix = F.filter(const_array(legacy), lambda name: F.startswith(ref, name))

    def with_prefix(name: Column) -> Column:
        tail = F.substr(ref, F.length(name) + 1)
        return F.concat(F.element_at(const_map({k: html5[k] for k in legacy}), name), tail)

    return F.coalesce(
        _in_buckets(html5, ref),
        F.get(F.transform(F.slice(prefix, 1, 1), with_prefix), 0),
        F.concat(F.lit("&"), ref),
    )


def _decode_piece(piece: Column) -> Column:
    """Decode the reference that opens ``piece`` (the text after an ampersand)."""
    pattern = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"

    def decode(ref: Column) -> Column:
        rest = F.substr(piece, F.length(ref) + 1)
        common = F.element_at(
            const_map({k: html.unescape(f"&{k}") for k in _COMMON}), ref
        )
        value = (
            F.when(ref == "", F.lit("&"))
            .when(common.isNotNull(), common)
            .when(F.startswith(ref, F.lit("#")), _numeric(ref))
            .otherwise(_named(ref))
        )
        return F.concat(value, rest)

    return F.get(F.transform(F.array(F.regexp_extract(piece, pattern, 1)), decode), 0)


def html_unescape(c: Column) -> Column:
    """All named and numeric character references replaced, in one pass."""
    pieces = F.split(c, "&", -1)
    decoded = F.transform(
        pieces, lambda piece, i: F.when(i == 0, piece).otherwise(_decode_piece(piece))
    )
    return F.when(F.contains(c, F.lit("&")), F.array_join(decoded, "")).otherwise(c)
