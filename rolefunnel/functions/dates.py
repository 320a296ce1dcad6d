"""The date forms found in payloads, all to UTC timestamps; anything unreadable is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolefunnel.functions.constants import const_array, const_map
from rolefunnel.functions.text import strip

_ISO = (
    r"^(\d{4}-\d{2}-\d{2}|\d{8})"
    r"(?:[T ](\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?|\d{4}|\d{6}(?:[.,]\d+)?)(Z|[+-]\d{2}(?::?\d{2})?)?)?$"
)
# Month abbreviations and the zone names of RFC 822.
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_ZONES = {
    "UT": "+00:00", "UTC": "+00:00", "GMT": "+00:00", "Z": "+00:00",
    "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00",
    "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00",
}
_RFC822 = (
    r"^(?:[A-Za-z]+,?\s+)?(\d{1,2})\s+([A-Za-z]{3})[A-Za-z]*\s+(\d{4}|\d{2})"
    r"\s+(\d{1,2}:\d{2}(?::\d{2})?)(?:\s+([+-]\d{4}|[A-Za-z]+))?"
)


def _utc(date: Column, time: Column, offset: Column) -> Column:
    """Assemble and cast; the offset is explicit, so the session zone never matters."""
    full_time = F.when(time == "", "00:00:00").when(F.length(time) == 5, F.concat(time, F.lit(":00"))).otherwise(time)
    return F.concat(date, F.lit("T"), full_time, offset).try_cast("timestamp")


def parse_iso(c: Column) -> Column:
    """ISO-8601 date or date-time, extended or compact; without an offset it is taken as UTC.

    The hour may stand alone, and of a long fraction six digits count.
    """
    c = strip(c)
    date = F.regexp_replace(F.regexp_extract(c, _ISO, 1), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    time = F.regexp_extract(c, _ISO, 2)
    for short, full in (
        (r"^(\d{2})(\d{2})(\d{2})", "$1:$2:$3"), (r"^(\d{2})(\d{2})$", "$1:$2"), (r"^(\d{2})$", "$1:00"), (",", "."), (r"(\.\d{6})\d+$", "$1"),
    ):
        time = F.regexp_replace(time, short, full)
    zone = F.regexp_extract(c, _ISO, 3)
    offset = F.when(zone.isin("", "Z"), "+00:00").otherwise(
        F.regexp_replace(F.regexp_replace(zone, r"^([+-]\d{2})$", "$1:00"), r"^([+-]\d{2})(\d{2})$", "$1:$2")
    )
    return F.when(c.rlike(_ISO), _utc(date, time, offset))


def parse_rfc822(c: Column) -> Column:
    """Mail/RSS date such as ``Sun, 09 Mar 2025 05:06:07 +0000``; no zone means UTC."""
    c = strip(c)
    month = F.array_position(const_array(_MONTHS), F.lower(F.regexp_extract(c, _RFC822, 2)))
    year = F.regexp_extract(c, _RFC822, 3)
    full_year = F.when(F.length(year) == 4, year).otherwise(
        F.concat(F.when(year >= "69", "19").otherwise("20"), year)
    )
    date = F.concat(
        full_year,
        F.lit("-"),
        F.lpad(month.cast("string"), 2, "0"),
        F.lit("-"),
        F.lpad(F.regexp_extract(c, _RFC822, 1), 2, "0"),
    )
    zone = F.regexp_extract(c, _RFC822, 5)
    named = const_map(_ZONES)
    offset = F.when(
        zone.rlike(r"^[+-]\d{4}$"), F.regexp_replace(zone, r"^([+-]\d{2})(\d{2})$", "$1:$2")
    ).otherwise(F.coalesce(F.element_at(named, F.upper(zone)), F.lit("+00:00")))
    time = F.regexp_extract(c, _RFC822, 4)
    padded = F.when(F.substring(time, 2, 1) == ":", F.concat(F.lit("0"), time)).otherwise(time)
    return F.when(c.rlike(_RFC822) & (month > 0), _utc(date, padded, offset))


def parse_epoch(c: Column, milliseconds: bool = False) -> Column:
    """Epoch seconds (or milliseconds), numeric or text; out of calendar range is null."""
    seconds = c.try_cast("double") / (1000.0 if milliseconds else 1.0)
    in_range = seconds.between(-62135596800.0, 253402300799.0)
    return F.when(in_range, F.timestamp_micros(F.bround(seconds * 1e6).cast("bigint")))


def parse_space_utc(c: Column) -> Column:
    """``2025-03-09 05:06:07 UTC`` and the ISO forms."""
    c = strip(c)
    bare = strip(F.regexp_replace(c, r" UTC$", ""))
    marked = F.concat(F.replace(bare, F.lit(" "), F.lit("T")), F.lit("+00:00"))
    return parse_iso(F.when(F.endswith(c, F.lit(" UTC")), marked).otherwise(c))


def age_days(posted: Column, as_of: Column) -> Column:
    """Days from ``posted`` to ``as_of`` with fraction, never negative; null without a date."""
    days = (F.unix_micros(as_of) - F.unix_micros(posted)) / F.lit(86400e6)
    return F.when(days < 0, 0.0).otherwise(days)


def utc_timestamp(literal: str) -> Column:
    """A timestamp constant given in UTC."""
    return parse_iso(F.lit(literal))
