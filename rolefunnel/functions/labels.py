"""Structured labels rendered as text or mapped to closed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolefunnel.functions.constants import const_array
from rolefunnel.functions.text import blank_to_null, normalize_text, strip

# Label words, in the order they are tried.
FREELANCE_LABELS = [
    "contractor",
    "contract",
    "freelance",
    "freelancer",
    "freiberuflich",
    "freiberufler",
    "temporary",
    "fixed term",
    "interim",
    "consultant",
    "1099",
]
EMPLOYMENT_LABELS = [
    "full time",
    "fulltime",
    "part time",
    "parttime",
    "permanent",
    "festanstellung",
    "unbefristet",
    "employee",
    "internship",
    "intern",
    "werkstudent",
]
UNRESTRICTED_LOCATIONS = ["anywhere", "worldwide", "global", "remote", "any location"]
BUCKET_CONFIDENCE = {"eligible": 100, "needs_review": 60, "excluded": 0}


def _mentions(text: Column, words: list[str]) -> Column:
    return F.exists(const_array(words), lambda w: F.contains(text, w))


def contract_from_label(
    label: Column,
    freelance: list[str] = FREELANCE_LABELS,
    employment: list[str] = EMPLOYMENT_LABELS,
) -> Column:
    """Contract type of one employment-type label; freelance words are tried first."""
    norm = normalize_text(label)
    return (
        F.when(_mentions(norm, freelance), "freelance")
        .when(_mentions(norm, employment), "employment")
        .otherwise("unclear")
    )


def contract_from_labels(labels: Column, **word_lists: list[str]) -> Column:
    """The first label of an array that says anything."""
    known = F.filter(
        F.transform(labels, lambda v: contract_from_label(v, **word_lists)), lambda t: t != "unclear"
    )
    return F.coalesce(F.get(known, F.lit(0)), F.lit("unclear"))


def location_allow_list(places: Column) -> Column:
    """Render an array of permitted places; unless unrestricted, say it is a limit."""
    kept = F.filter(F.transform(places, strip), lambda p: p != "")
    rendered = F.array_join(kept, ", ")
    free = F.contains(F.lower(rendered), F.lit("only")) | _mentions(F.lower(rendered), UNRESTRICTED_LOCATIONS)
    return F.when(
        F.size(kept) > 0, F.when(free, rendered).otherwise(F.concat(rendered, F.lit(" only")))
    )


def salary_range(
    minimum: Column,
    maximum: Column,
    currency: Column | None = None,
    period: Column | None = None,
) -> Column:
    """``$1,000 - $2,000 (year)``; whole units, null when both ends are zero or unreadable."""
    readable = ~(
        (minimum.isNotNull() & minimum.try_cast("double").isNull())
        | (maximum.isNotNull() & maximum.try_cast("double").isNull())
    )
    low = F.coalesce(minimum.try_cast("double").cast("bigint"), F.lit(0))
    high = F.coalesce(maximum.try_cast("double").cast("bigint"), F.lit(0))
    code = strip(F.coalesce(currency, F.lit(""))) if currency is not None else F.lit("")
    unit = strip(F.coalesce(period, F.lit(""))) if period is not None else F.lit("")
    prefix = F.when(code == "USD", "$").otherwise("")
    suffix = F.when((code != "") & (code != "USD"), F.concat(F.lit(" "), code)).otherwise("")

    def amount(value: Column) -> Column:
        return F.concat(prefix, F.format_number(value, 0))

    both = (low != 0) & (high != 0) & (low != high)
    figure = F.when(both, F.concat(amount(low), F.lit(" - "), amount(high))).otherwise(
        amount(F.when(low != 0, low).otherwise(high))
    )
    tail = F.when(unit != "", F.concat(F.lit(" ("), unit, F.lit(")"))).otherwise("")
    return F.when(readable & ((low != 0) | (high != 0)), F.concat(figure, suffix, tail))


def commute_location(place: Column, remote: Column) -> Column:
    """A place plus the remote flag spelled in words the rule lists know."""
    marker = F.when(F.coalesce(remote, F.lit(False)), "Remote").otherwise("vor Ort")
    return F.concat_ws(", ", blank_to_null(strip(F.coalesce(place, F.lit("")))), marker)


def split_company_title(raw: Column, placeholder: str = "(company not stated)") -> Column:
    """struct(company, title) split at the first ``": "``; else placeholder and all of it."""
    parts = F.split(raw, ": ", 2)
    left, right = strip(F.get(parts, F.lit(0))), strip(F.get(parts, F.lit(1)))
    stated = (F.size(parts) == 2) & (left != "") & (right != "")
    return F.struct(
        F.when(stated, left).otherwise(placeholder).alias("company"),
        F.when(stated, right).otherwise(raw).alias("title"),
    )


def bucket_confidence(bucket: Column, table: dict[str, int] = BUCKET_CONFIDENCE, default: int = 50) -> Column:
    """Eligibility bucket as a 0-100 confidence."""
    mapping = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.element_at(mapping, bucket), F.lit(default))
