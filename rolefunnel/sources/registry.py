"""Registry polling, board expansion, link lists, and the union of all sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolefunnel.functions.text import SPACE, stripped_or_null
from rolefunnel.functions.urls import URL_PATTERN
from rolefunnel.operators.barrier import add_once
from rolefunnel.operators.boards import resolve_boards
from rolefunnel.schema import CONTENT_DDL, ORDER_BITS, arrival_order, child_order, conform
from rolefunnel.session import cut_lineage
from rolefunnel.sources import feeds
from rolefunnel.sources.board_payloads import board_postings, roles_in_payload, with_original, with_snippets
from rolefunnel.sources.threads import FREELANCE, HIRING, PERMALINK, expand_role_links, thread_postings

REGISTRY_SOURCE = "ats_board_registry"

# The place of each source in the arrival order, the same whatever is switched on; the registry has 0.
RANKS = {
    name: rank
    for rank, name in enumerate(
        ["remoteok", "remotive", "hn_whoishiring", "hn_freelancer", "himalayas", "jobicy", "weworkremotely", "arbeitnow"], 1
    )
}

# Source name -> DataFrame function, in processing order; the registry goes first.
SOURCES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "remoteok": lambda landed: feeds.remoteok(landed, RANKS["remoteok"]),
    "remotive": lambda landed: feeds.remotive(landed, RANKS["remotive"]),
    "hn_whoishiring": lambda threads: thread_postings(threads, HIRING, RANKS["hn_whoishiring"]),
    "hn_freelancer": lambda threads: thread_postings(threads, FREELANCE, RANKS["hn_freelancer"]),
    "himalayas": lambda landed: feeds.himalayas(landed, RANKS["himalayas"]),
    "jobicy": lambda landed: feeds.jobicy(landed, RANKS["jobicy"]),
    "weworkremotely": lambda landed: feeds.weworkremotely(landed, RANKS["weworkremotely"]),
    "arbeitnow": lambda landed: feeds.arbeitnow(landed, RANKS["arbeitnow"]),
}


def poll_registry(
    boards: DataFrame, payloads: DataFrame, as_of: Column, pages: DataFrame | None = None, cap: int | None = None
) -> DataFrame:
    """Postings (with platform, board_slug) of every enabled board that has a landed payload.

    ``payloads`` is (platform, board_slug, payload), one row per board.  A board
    without a payload, or with a broken one, contributes nothing and disturbs no
    other board.  ``cap`` keeps the first roles of each board; by default all stay.
    """
    key = ["platform", "board_slug"]
    # Boards have no arrival order: hash buckets plus a number inside the bucket
    # give each a unique place without sorting all of them in one task.
    bucket = F.pmod(F.xxhash64(*key), F.lit(1 << ORDER_BITS["page"]))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*key))
    enabled = (
        boards.filter(F.col("enabled"))
        .select(*key, F.col("company").alias("_company"), bucket.alias("_bucket"))
        .withColumn("_place", place)
    )
    rows = payloads.join(enabled, key).select(
        *key,
        "payload",
        F.coalesce("_company", "board_slug").alias("company"),
        F.concat_ws(":", F.lit("registry"), "platform", "board_slug").alias("comment_id"),
        as_of.alias("fallback_date"),
        F.lit(None).cast("string").alias("original_description"),
        F.lit(REGISTRY_SOURCE).alias("source"),
        arrival_order(0, F.col("_bucket"), F.col("_place")).alias("ord"),
    )
    return board_postings(rows, cap, pages)


def discovered_boards(linked: DataFrame) -> DataFrame:
    """Boards the postings of ``resolve_boards`` link to, for the board table."""
    return linked.filter(F.col("board").isNotNull()).select(
        F.col("board.platform").alias("platform"),
        F.col("board.slug").alias("board_slug"),
        "company",
        F.lit("hn_whoishiring").alias("discovered_via"),
        F.col("url").alias("discovered_url"),
        "ord",
    )


def link_boards(postings: DataFrame, pages: DataFrame) -> DataFrame:
    """Add ``board`` to thread postings; a permalink is no link to resolve."""
    own = postings.withColumn("_lookup", F.when(~F.startswith("url", F.lit(PERMALINK)), F.col("url")))
    # Written once: addresses are long expressions over the text, and every pattern of a board would hold them anew.
    return resolve_boards(cut_lineage(own), pages, "_lookup").drop("_lookup")


def expand_boards(linked: DataFrame, payloads: DataFrame, pages: DataFrame | None = None, cap: int | None = None) -> DataFrame:
    """Replace a posting that links to a whole board by the board's roles.

    ``linked`` comes from ``link_boards``; ``payloads`` is (platform, board_slug,
    payload), one row per board.  A posting whose board delivers nothing is split
    into its bulleted role links, and failing that kept as it is.  ``cap`` keeps
    the first roles of each board; by default all stay.
    """
    boards = payloads.select("platform", "board_slug", "payload")
    # Written once: below it is read by both sides of two unions and by the lookup of pages,
    # and each of them would hold, plan and compile the whole parsing of comments anew.
    linked = cut_lineage(linked)
    keyed = linked.withColumns({"platform": F.col("board.platform"), "board_slug": F.col("board.slug")})
    # Most postings link to no board: they have nothing to join, and would all meet on one null key.
    linked_to = F.col("platform").isNotNull() & F.col("board_slug").isNotNull()
    rows = keyed.filter(linked_to).join(boards, ["platform", "board_slug"], "left").unionByName(
        keyed.filter(~linked_to), allowMissingColumns=True
    )
    roles = roles_in_payload(F.col("platform"), F.col("board_slug"), F.col("payload"), cap)
    rows = add_once(rows, {"_roles": roles}).drop("payload")
    some = F.when(F.size("_roles") > 0, F.col("_roles"))
    rows = rows.select(*[c for c in rows.columns if c != "_roles"], F.posexplode_outer(some).alias("_pos", "_role"))
    found = F.col("_role").isNotNull()

    def swap(role: Column, own: str) -> Column:
        return F.when(found, role).otherwise(F.col(own)).alias(own)

    expanded = rows.select(
        "platform",
        swap(F.col("_role.title"), "title"),
        F.coalesce("_role.company", "company").alias("company"),
        swap(F.col("_role.description"), "description"),
        F.when(found, F.col("description")).alias("original_description"),
        swap(F.col("_role.url"), "url"),
        # Roles found through a comment are labelled as the hiring thread's.
        swap(F.lit("hn_whoishiring"), "source"),
        F.coalesce("_role.posted", "posted_date").alias("posted_date"),
        swap(F.col("_role.tags"), "tags"),
        F.col("_role.location").alias("location_text"),
        swap(F.lit("url"), "application_channel"),
        swap(F.concat_ws(":", "source_id", "platform", "_role.role_id"), "source_id"),
        swap(F.col("_role.contract"), "contract_type_guess"),
        child_order(F.col("ord"), F.col("_pos")).alias("ord"),
        "hrefs",
        found.alias("_found"),
    )
    prose = with_original(with_snippets(expanded.withColumn("platform", F.when(F.col("_found"), F.col("platform"))), pages))
    return conform(expand_role_links(prose, ~F.col("_found")), CONTENT_DDL)


def candidate_links(documents: DataFrame, key: str = "source_name", text: str = "text") -> DataFrame:
    """(key, url, ord): distinct links of each link-list document, in order of appearance."""
    urls = F.transform(
        F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(URL_PATTERN), F.lit(0)),
        lambda u: F.rtrim(u, F.lit(".,;:)]")),
    )
    return documents.select(key, F.posexplode(F.array_distinct(urls)).alias("ord", "url"))


def frontmatter_links(files: DataFrame, prefix: str, field: str) -> DataFrame:
    """(path, url): one scalar front-matter field of every Markdown file below ``prefix``.

    ``files`` is (path, type, content).  Files without a leading front-matter
    block, or with the field missing, blank or not a plain scalar, are left out.
    """
    chosen = files.filter(
        (F.col("type") == "blob")
        & F.startswith("path", F.lit(prefix))
        & F.endswith("path", F.lit(".md"))
    )
    block = F.regexp_extract("content", rf"(?s)^---[{SPACE}]*?\n(.*?\n)---[{SPACE}]*?\n", 1)
    line = F.regexp_extract(block, rf"(?m)^{field}[ \t]*:[ \t]+(\S.*?)[ \t]*$", 1)
    quoted = F.regexp_replace(line, r"""^(["'])(.*)\1$""", "$2")
    bare = F.regexp_replace(quoted, r"[ \t]+#.*$", "")
    scalar = ~bare.rlike(r"^([\[{&*!|>%@`]|-?\d+(\.\d+)?$|(?i)(true|false|null|yes|no|on|off|~)$)")
    value = F.when(scalar, stripped_or_null(bare))
    return chosen.select("path", value.alias("url")).filter(F.col("url").isNotNull())


def enabled_sources(toggles: dict[str, bool], names: list[str] | None = None) -> list[str]:
    """Names to process, in order; a source the toggles do not mention is on."""
    return [name for name in (names or list(SOURCES)) if toggles.get(name, True)]


def filter_enabled(df: DataFrame, toggles: DataFrame) -> DataFrame:
    """Rows of the sources that are not switched off (source, enabled)."""
    return (
        df.join(toggles, "source", "left").filter(F.coalesce("enabled", F.lit(True))).drop("enabled")
    )


def union_sources(landed: dict[str, DataFrame], toggles: dict[str, bool] | None = None) -> DataFrame:
    """One relation of all enabled sources; ``ord`` carries source, page and position."""
    names = [n for n in enabled_sources(toggles or {}) if n in landed]
    if not names:
        raise ValueError("no enabled source has landed data")
    union = SOURCES[names[0]](landed[names[0]])
    for name in names[1:]:
        union = union.unionByName(SOURCES[name](landed[name]), allowMissingColumns=True)
    return union
