"""Job feeds: landed payloads to posting content, one normaliser per payload shape.

A normaliser takes (page, payload) rows and returns the columns of
``schema.CONTENT_DDL``.  Malformed items are dropped, never a whole payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefunnel.functions.dates import parse_epoch, parse_iso, parse_rfc822
from rolefunnel.functions.entities import html_unescape
from rolefunnel.functions.labels import (
    commute_location,
    contract_from_label,
    contract_from_labels,
    location_allow_list,
    salary_range,
    split_company_title,
)
from rolefunnel.functions.text import blank_to_null, join_present, present, strip, strip_html, stripped_or_null
from rolefunnel.functions.urls import application_channel, extract_email
from rolefunnel.operators.barrier import add_once
from rolefunnel.schema import CONTENT_DDL, arrival_order, conform
from rolefunnel.sources.landing import first_by, json_items, xml_items

# The page users are sent to when an entry has no page of its own,
# and the tag pair no single role can carry.
GENERIC_LISTING_PATTERN = r"(?i)^https?://(www\.)?remoteok\.com/remote-jobs/?$"
CONTRADICTORY_TAGS = ("full time", "part time")

REMOTEOK_ITEM = (
    "id string, slug string, position string, company string, description string, url string, "
    "apply_url string, date string, salary_min string, salary_max string, tags array<string>, location string"
)
REMOTIVE_ITEM = (
    "id string, title string, company_name string, description string, url string, "
    "publication_date string, salary string, tags array<string>, candidate_required_location string"
)
HIMALAYAS_ITEM = (
    "title string, excerpt string, companyName string, employmentType string, minSalary string, "
    "maxSalary string, salaryPeriod string, currency string, seniority array<string>, "
    "locationRestrictions array<string>, categories array<string>, description string, "
    "pubDate string, applicationLink string, guid string"
)
JOBICY_ITEM = (
    "id string, url string, jobTitle string, companyName string, jobIndustry array<string>, "
    "jobType array<string>, jobGeo string, jobLevel string, jobExcerpt string, jobDescription string, "
    "pubDate string, salaryMin string, salaryMax string, salaryCurrency string, salaryPeriod string"
)
RSS_ITEM = (
    "title string, region string, country string, state string, skills string, category string, "
    "type string, description string, pubDate string, guid string, link string"
)
ARBEITNOW_ITEM = (
    "slug string, company_name string, title string, description string, remote boolean, url string, "
    "tags array<string>, job_types array<string>, location string, created_at string"
)


def _text(name: str) -> Column:
    return strip(F.coalesce(F.col(name), F.lit("")))


def _either(first: Column, second: Column) -> Column:
    """``first`` unless empty, else ``second`` unless empty, else empty."""
    return F.coalesce(blank_to_null(first), blank_to_null(second), F.lit(""))


def _known(array: str) -> Column:
    """The non-empty members of an array column; an empty array when it is missing."""
    kept = F.filter(array, lambda v: F.coalesce(v, F.lit("")) != "")
    return F.coalesce(kept, F.array().cast("array<string>"))


def finish(df: DataFrame, source: str, rank: int) -> DataFrame:
    """Stamp source and arrival order and bring to the content schema."""
    return conform(
        df.withColumns({"source": F.lit(source), "ord": arrival_order(rank, F.col("page"), F.col("pos"))}),
        CONTENT_DDL,
    )


def is_junk_entry(slug: Column, url: Column) -> Column:
    """No page of its own: empty slug and the generic listing as address."""
    return (strip(F.coalesce(slug, F.lit(""))) == "") & url.rlike(GENERIC_LISTING_PATTERN)


def has_contradictory_tags(tags: Column, pair: tuple[str, str] = CONTRADICTORY_TAGS) -> Column:
    return F.array_contains(tags, pair[0]) & F.array_contains(tags, pair[1])


def remoteok(landed: DataFrame, rank: int = 0) -> DataFrame:
    """Bare array whose first element is a notice; two junk rules."""
    items = json_items(landed, REMOTEOK_ITEM, None).filter(F.col("pos") > 0)
    link = strip(_either(F.col("url"), F.col("apply_url")))
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    rows = items.withColumns({"link": link, "all_tags": tags}).filter(
        ~is_junk_entry(F.col("slug"), F.col("link"))
        & ~has_contradictory_tags(F.col("all_tags"))
        & F.col("position").isNotNull()
        & F.col("company").isNotNull()
    )
    rows = rows.withColumn("text", strip_html(F.col("description")))
    return finish(
        rows.select(
            "page",
            "pos",
            F.col("position").alias("title"),
            "company",
            F.col("text").alias("description"),
            _either(F.col("url"), F.col("apply_url")).alias("url"),
            parse_iso(F.col("date")).alias("posted_date"),
            salary_range(F.col("salary_min"), F.col("salary_max"), F.lit("USD")).alias("salary_text"),
            F.col("all_tags").alias("tags"),
            stripped_or_null(F.col("location")).alias("location_text"),
            application_channel(F.col("link") != "", extract_email(F.col("text"))).alias("application_channel"),
            F.col("id").alias("source_id"),
            F.lit("unclear").alias("contract_type_guess"),
        ),
        "remoteok",
        rank,
    )


def remotive(landed: DataFrame, rank: int = 1) -> DataFrame:
    """Wrapped array, free-text salary."""
    items = json_items(landed, REMOTIVE_ITEM, "jobs")
    rows = items.filter(
        F.col("title").isNotNull() & F.col("company_name").isNotNull() & F.col("url").isNotNull()
    ).withColumn("text", strip_html(F.col("description")))
    return finish(
        rows.select(
            "page",
            "pos",
            "title",
            F.col("company_name").alias("company"),
            F.col("text").alias("description"),
            "url",
            parse_iso(F.col("publication_date")).alias("posted_date"),
            stripped_or_null(F.col("salary")).alias("salary_text"),
            F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
            stripped_or_null(F.col("candidate_required_location")).alias("location_text"),
            application_channel(F.col("url") != "", extract_email(F.col("text"))).alias("application_channel"),
            F.col("id").alias("source_id"),
            F.lit("unclear").alias("contract_type_guess"),
        ),
        "remotive",
        rank,
    )


def himalayas(landed: DataFrame, rank: int = 4) -> DataFrame:
    """Offset-paged, first arrival per URL across all landed pages."""
    items = json_items(landed, HIMALAYAS_ITEM, "jobs")
    link = strip(_either(F.col("guid"), F.col("applicationLink")))
    rows = items.withColumns({"name": _text("title"), "link": link}).filter(
        (F.col("name") != "") & (F.col("link") != "")
    )
    return finish(
        first_by(rows, "link").select(
            "page",
            "pos",
            F.col("name").alias("title"),
            _either(_text("companyName"), F.lit("Unknown")).alias("company"),
            _either(strip_html(F.col("description")), F.col("excerpt")).alias("description"),
            F.col("link").alias("url"),
            parse_epoch(F.col("pubDate")).alias("posted_date"),
            salary_range(
                F.col("minSalary"), F.col("maxSalary"), F.col("currency"), F.col("salaryPeriod")
            ).alias("salary_text"),
            F.concat(_known("categories"), _known("seniority")).alias("tags"),
            location_allow_list(_known("locationRestrictions")).alias("location_text"),
            F.lit("url").alias("application_channel"),
            F.col("link").alias("source_id"),
            contract_from_label(F.col("employmentType")).alias("contract_type_guess"),
        ),
        "himalayas",
        rank,
    )


def jobicy(landed: DataFrame, rank: int = 5) -> DataFrame:
    """Single page; names arrive HTML-escaped; the link is never rewritten."""
    items = json_items(landed, JOBICY_ITEM, "jobs")
    rows = add_once(items, {"name": html_unescape(_text("jobTitle")), "link": _text("url")}).filter(
        (F.col("name") != "") & (F.col("link") != "")
    )
    industries = F.transform(_known("jobIndustry"), html_unescape)
    return finish(
        rows.select(
            "page",
            "pos",
            F.col("name").alias("title"),
            _either(html_unescape(_text("companyName")), F.lit("Unknown")).alias("company"),
            _either(strip_html(F.col("jobDescription")), F.col("jobExcerpt")).alias("description"),
            F.col("link").alias("url"),
            parse_iso(F.col("pubDate")).alias("posted_date"),
            salary_range(
                F.col("salaryMin"), F.col("salaryMax"), F.col("salaryCurrency"), F.col("salaryPeriod")
            ).alias("salary_text"),
            F.concat(industries, present(_text("jobLevel"))).alias("tags"),
            location_allow_list(F.array("jobGeo")).alias("location_text"),
            F.lit("url").alias("application_channel"),
            F.col("id").alias("source_id"),
            contract_from_labels(F.col("jobType")).alias("contract_type_guess"),
        ),
        "jobicy",
        rank,
    )


def weworkremotely(landed: DataFrame, rank: int = 6) -> DataFrame:
    """Several RSS feeds (``page`` is the feed number), first arrival per guid."""
    items = xml_items(landed, RSS_ITEM, "rss", "channel.item")
    rows = items.withColumns({"raw": _text("title"), "link": _either(_text("guid"), _text("link"))}).filter(
        (F.col("raw") != "") & (F.col("link") != "")
    )
    rows = first_by(rows, "link").withColumn("named", split_company_title(F.col("raw")))
    return finish(
        rows.select(
            "page",
            "pos",
            "named.title",
            "named.company",
            strip_html(F.col("description")).alias("description"),
            F.col("link").alias("url"),
            parse_rfc822(F.col("pubDate")).alias("posted_date"),
            present(_text("category"), _text("skills")).alias("tags"),
            join_present([_text("region"), _text("country"), _text("state")]).alias("location_text"),
            F.lit("url").alias("application_channel"),
            F.col("link").alias("source_id"),
            contract_from_label(F.col("type")).alias("contract_type_guess"),
        ),
        "weworkremotely",
        rank,
    )


def arbeitnow(landed: DataFrame, rank: int = 7) -> DataFrame:
    """Page-numbered from 1, first arrival per slug, remote flag put into words."""
    items = json_items(landed, ARBEITNOW_ITEM, "data")
    rows = items.withColumns({"name": _text("title"), "link": _text("url"), "key": _text("slug")}).filter(
        (F.col("name") != "") & (F.col("link") != "") & (F.col("key") != "")
    )
    return finish(
        first_by(rows, "slug").select(
            "page",
            "pos",
            F.col("name").alias("title"),
            _either(_text("company_name"), F.lit("Unknown")).alias("company"),
            strip_html(F.col("description")).alias("description"),
            F.col("link").alias("url"),
            parse_epoch(F.col("created_at")).alias("posted_date"),
            _known("tags").alias("tags"),
            commute_location(F.col("location"), F.col("remote")).alias("location_text"),
            F.lit("url").alias("application_channel"),
            F.col("key").alias("source_id"),
            contract_from_labels(F.col("job_types")).alias("contract_type_guess"),
        ),
        "arbeitnow",
        rank,
    )
