"""Recruiting-board payloads to roles: one Column function per platform.

A payload column becomes an array of role structs, so a row dispatches to its
platform inside one projection: landed payloads are scanned once, whatever the
number of platforms, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefunnel.functions.dates import parse_epoch, parse_iso, parse_space_utc
from rolefunnel.functions.labels import contract_from_label
from rolefunnel.functions.text import (
    blank_to_null,
    headed_section,
    join_present,
    join_sections,
    let,
    present,
    strip,
    strip_html,
    stripped_or_null,
)
from rolefunnel.operators.boards import page_snippet
from rolefunnel.schema import CONTENT_DDL, child_order, conform


ASHBY_ITEM = (
    "id string, title string, department string, team string, location string, publishedAt string, "
    "jobUrl string, applyUrl string, descriptionPlain string, descriptionHtml string, isListed boolean"
)
GREENHOUSE_ITEM = (
    "id string, title string, absolute_url string, location struct<name: string>, first_published string, "
    "updated_at string, content string, departments array<struct<name: string>>"
)
LEVER_ITEM = (
    "id string, text string, categories struct<commitment: string, department: string, location: string, "
    "team: string>, createdAt string, descriptionPlain string, description string, additionalPlain string, "
    "additional string, lists array<struct<text: string, content: string>>, workplaceType string, "
    "hostedUrl string, applyUrl string"
)
WORKABLE_ITEM = (
    "title string, shortcode string, employment_type string, department string, url string, "
    "published_on string, created_at string, country string, city string, state string"
)
RECRUITEE_ITEM = (
    "id string, title string, description string, requirements string, department string, "
    "tags array<string>, locations array<struct<name: string>>, remote boolean, hybrid boolean, "
    "on_site boolean, employment_type_code string, published_at string, created_at string, "
    "careers_url string, careers_apply_url string"
)
PERSONIO_ITEM = (
    "id string, office string, department string, recruitingCategory string, name string, "
    "employmentType string, occupationCategory string, createdAt string, "
    "jobDescriptions struct<jobDescription: array<struct<name: string, value: string>>>"
)


ROLE_DDL = (
    "title string, company string, description string, url string, posted timestamp, tags array<string>, "
    "location string, role_id string, contract string"
)


def _first(*columns: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in columns])


def _wrapped(payload: Column, member: str, ddl: str) -> Column:
    return F.from_json(payload, f"struct<{member}: array<struct<{ddl}>>>", {"mode": "PERMISSIVE"})[member]


def _role(
    title: Column,
    url: Column,
    description: Column,
    posted: Column,
    tags: Column,
    location: Column,
    role_id: Column,
    company: Column | None = None,
    contract: Column | None = None,
) -> Column:
    """One role in the common shape; a null company means the board's."""
    role = F.struct(
        strip(blank_to_null(title)).alias("title"),
        (F.lit(None).cast("string") if company is None else company).alias("company"),
        description.alias("description"),
        blank_to_null(url).alias("url"),
        posted.alias("posted"),
        tags.alias("tags"),
        location.alias("location"),
        F.coalesce(role_id, F.lit("None")).alias("role_id"),
        (F.lit("unclear") if contract is None else contract).alias("contract"),
    )
    return role.cast(f"struct<{ROLE_DDL}>")


def _roles(items: Column, cap: int | None, shape: Callable[[Column], Column]) -> Column:
    """All items, or the first ``cap``, in the common shape; items without title or address go."""
    first = F.filter(items, lambda i: i.isNotNull())
    if cap is not None:
        first = F.slice(first, 1, cap)
    return F.filter(F.transform(first, shape), lambda r: r["title"].isNotNull() & r["url"].isNotNull())


def _names(members: Column) -> Column:
    return F.filter(
        F.transform(F.coalesce(members, F.array()), lambda m: m["name"]), lambda n: F.coalesce(n, F.lit("")) != ""
    )


def ashby(payload: Column, slug: Column, cap: int | None = None) -> Column:
    listed = F.filter(_wrapped(payload, "jobs", ASHBY_ITEM), lambda j: F.coalesce(j["isListed"], F.lit(True)))
    return _roles(
        listed,
        cap,
        lambda j: _role(
            j["title"],
            _first(j["jobUrl"], j["applyUrl"]),
            F.coalesce(blank_to_null(j["descriptionPlain"]), strip_html(j["descriptionHtml"])),
            parse_iso(j["publishedAt"]),
            present(j["department"], j["team"]),
            j["location"],
            j["id"],
        ),
    )


def greenhouse(payload: Column, slug: Column, cap: int | None = None) -> Column:
    return _roles(
        _wrapped(payload, "jobs", GREENHOUSE_ITEM),
        cap,
        lambda j: _role(
            j["title"],
            j["absolute_url"],
            strip_html(j["content"]),
            F.coalesce(parse_iso(j["first_published"]), parse_iso(j["updated_at"])),
            _names(j["departments"]),
            j["location"]["name"],
            j["id"],
        ),
    )


def lever(payload: Column, slug: Column, cap: int | None = None) -> Column:
    """Bare array, epoch milliseconds, prose in several parts; a wrapped payload has no roles."""
    bare = F.startswith(F.ltrim(payload), F.lit("["))
    items = F.when(bare, F.from_json(payload, f"array<struct<{LEVER_ITEM}>>", {"mode": "PERMISSIVE"}))

    def shape(j: Column) -> Column:
        middle = F.transform(
            F.coalesce(j["lists"], F.array()), lambda s: headed_section(s["text"], strip_html(s["content"]))
        )
        sections = F.concat(
            F.array(F.coalesce(blank_to_null(j["descriptionPlain"]), strip_html(j["description"]))),
            middle,
            F.array(F.coalesce(blank_to_null(j["additionalPlain"]), strip_html(j["additional"]))),
        )
        categories = j["categories"]
        place = [strip(F.coalesce(c, F.lit(""))) for c in (categories["location"], j["workplaceType"])]
        return _role(
            j["text"],
            _first(j["hostedUrl"], j["applyUrl"]),
            join_sections(sections),
            parse_epoch(j["createdAt"], milliseconds=True),
            present(categories["team"], categories["department"]),
            join_present(place),
            j["id"],
            contract=contract_from_label(categories["commitment"]),
        )

    return _roles(items, cap, shape)


def workable(payload: Column, slug: Column, cap: int | None = None) -> Column:
    """The board's own company name is preferred; prose is added by the caller."""
    parsed = F.from_json(
        payload, f"struct<name: string, jobs: array<struct<{WORKABLE_ITEM}>>>", {"mode": "PERMISSIVE"}
    )

    def shape(j: Column, company: Column) -> Column:
        return _role(
            j["title"],
            j["url"],
            F.concat(F.lit("Role: "), j["title"]),
            F.coalesce(parse_iso(j["published_on"]), parse_iso(j["created_at"])),
            present(j["department"]),
            join_present([j["city"], j["state"], j["country"]]),
            j["shortcode"],
            company=company,
            contract=contract_from_label(j["employment_type"]),
        )

    # The name is bound outside the lambda over the jobs, which would parse the payload again for each of them.
    def roles(board: Column) -> Column:
        return let(stripped_or_null(board["name"]), lambda company: _roles(board["jobs"], cap, lambda j: shape(j, company)))

    return let(parsed, roles)


def recruitee(payload: Column, slug: Column, cap: int | None = None) -> Column:
    def shape(j: Column) -> Column:
        mode = (
            F.when(j["remote"], F.array(F.lit("Remote")))
            .when(j["hybrid"], F.array(F.lit("Hybrid")))
            .when(j["on_site"], F.array(F.lit("On-site")))
            .otherwise(F.array().cast("array<string>"))
        )
        tags = F.filter(
            F.concat(F.array(j["department"]), F.coalesce(j["tags"], F.array().cast("array<string>"))),
            lambda t: F.coalesce(t, F.lit("")) != "",
        )
        return _role(
            j["title"],
            _first(j["careers_apply_url"], j["careers_url"]),
            join_sections(F.array(strip_html(j["description"]), strip_html(j["requirements"]))),
            F.coalesce(parse_space_utc(j["published_at"]), parse_space_utc(j["created_at"])),
            tags,
            blank_to_null(F.array_join(F.concat(_names(j["locations"]), mode), ", ")),
            j["id"],
            contract=contract_from_label(j["employment_type_code"]),
        )

    return _roles(_wrapped(payload, "offers", RECRUITEE_ITEM), cap, shape)


def personio(payload: Column, slug: Column, cap: int | None = None) -> Column:
    """XML; the slug carries company and top-level domain, the address is built from the id."""
    schema = f"struct<position: array<struct<{PERSONIO_ITEM}>>>"
    items = F.from_xml(payload, schema, {"rowTag": "workzag-jobs", "mode": "PERMISSIVE"})["position"]
    company, domain = F.substring_index(slug, ".", 1), F.regexp_extract(slug, r"^[^.]+\.(.+)$", 1)
    site = F.concat(F.lit("https://"), company, F.lit(".jobs.personio."), domain, F.lit("/job/"))

    def shape(j: Column) -> Column:
        sections = F.transform(
            F.coalesce(j["jobDescriptions"]["jobDescription"], F.array()),
            lambda d: headed_section(d["name"], strip_html(d["value"])),
        )
        return _role(
            j["name"],
            F.concat(site, blank_to_null(j["id"])),
            join_sections(sections),
            parse_iso(j["createdAt"]),
            present(j["department"], j["recruitingCategory"], j["occupationCategory"]),
            blank_to_null(j["office"]),
            j["id"],
            contract=contract_from_label(j["employmentType"]),
        )

    return F.when(slug.rlike(r"^[^.]+\..+$"), _roles(items, cap, shape))


PLATFORMS: dict[str, Callable[..., Column]] = {
    "ashby": ashby,
    "greenhouse": greenhouse,
    "lever": lever,
    "workable": workable,
    "recruitee": recruitee,
    "personio": personio,
}


def roles_in_payload(platform: Column, slug: Column, payload: Column, cap: int | None = None) -> Column:
    """Roles of any platform; null for an unknown one, none for a broken payload."""
    roles = F.lit(None)
    for name, parse in PLATFORMS.items():
        roles = F.when(platform == name, parse(payload, slug, cap)).otherwise(roles)
    return roles


def with_snippets(rows: DataFrame, pages: DataFrame | None) -> DataFrame:
    """Extend the prose of Workable roles by the snippet of their landed page (url, html)."""
    if pages is None:
        return rows
    is_thin = F.coalesce(F.col("platform") == "workable", F.lit(False)) & F.col("url").isNotNull()
    # Only roles with a page to look up take part in the join, and only their pages are searched.
    thin, rest = rows.filter(is_thin), rows.filter(~is_thin)
    wanted = thin.select("url").distinct()
    snippets = pages.join(wanted, "url", "left_semi").groupBy("url").agg(F.min(page_snippet(F.col("html"))).alias("_snippet"))
    text = F.concat_ws("\n", "description", F.col("_snippet"))
    found = thin.join(snippets, "url", "left").withColumn(
        "description", F.when(F.col("_snippet").isNotNull(), text).otherwise(F.col("description"))
    )
    return found.select(*rows.columns).unionByName(rest)


def with_original(rows: DataFrame) -> DataFrame:
    """Put the text a Workable board was found in above its thin role lines."""
    joined = join_sections(F.array("original_description", "description"), "\n\n---\n")
    return rows.withColumn(
        "description", F.when(F.col("platform") == "workable", joined).otherwise(F.col("description"))
    )


def board_postings(payloads: DataFrame, cap: int | None = None, pages: DataFrame | None = None) -> DataFrame:
    """Content rows (with platform, board_slug) of landed board payloads.

    Input: platform, board_slug, payload, company, comment_id, fallback_date,
    original_description, source, ord.
    """
    roles = roles_in_payload(F.col("platform"), F.col("board_slug"), F.col("payload"), cap)
    context = [c for c in payloads.columns if c != "payload"]
    rows = payloads.select(*context, F.posexplode(roles).alias("_pos", "_role")).select(
        "platform",
        "board_slug",
        "_role.title",
        F.coalesce("_role.company", "company").alias("company"),
        "_role.description",
        "original_description",
        "_role.url",
        "source",
        F.coalesce("_role.posted", "fallback_date").alias("posted_date"),
        "_role.tags",
        F.col("_role.location").alias("location_text"),
        F.lit("url").alias("application_channel"),
        F.concat_ws(":", "comment_id", "platform", "_role.role_id").alias("source_id"),
        F.col("_role.contract").alias("contract_type_guess"),
        child_order(F.col("ord"), F.col("_pos")).alias("ord"),
    )
    rows = with_original(with_snippets(rows, pages))
    return conform(rows, "platform string, board_slug string, " + CONTENT_DDL)
