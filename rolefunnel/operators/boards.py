"""Recruiting boards: recognise them in URLs and pages, decide what to poll."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefunnel.functions.entities import html_unescape
from rolefunnel.functions.text import stripped_or_null
from rolefunnel.functions.urls import extract_hrefs

# Board roots per platform, in the order they are tried; group 1 is
# the slug, group 2 (where present) is appended to it after a dot.
BOARD_PATTERNS = [
    ("ashby", r"(?i)^https?://jobs\.ashbyhq\.com/([^/?#]+)/?$"),
    ("greenhouse", r"(?i)^https?://(?:boards|job-boards)\.greenhouse\.io/([^/?#]+)/?$"),
    ("lever", r"(?i)^https?://jobs\.lever\.co/([^/?#]+)/?$"),
    ("workable", r"(?i)^https?://apply\.workable\.com/([^/?#]+)/?$"),
    ("workable", r"(?i)^https?://(?!apply\.|www\.)([^./]+)\.workable\.com/?$"),
    ("recruitee", r"(?i)^https?://([^./]+)\.recruitee\.com/?$"),
    ("personio", r"(?i)^https?://([^./]+)\.jobs\.personio\.(de|com)/?$"),
]
KNOWN_HOST_PATTERN = (
    r"(?i)^https?://(?:jobs\.ashbyhq\.com|(?:boards|job-boards)\.greenhouse\.io|jobs\.lever\.co|"
    r"[^./]+\.workable\.com|[^./]+\.recruitee\.com|[^./]+\.jobs\.personio\.(?:de|com))/"
)
META_DESCRIPTION_PATTERN = r"""(?i)<meta\s+name=["']description["']\s+content=["']([^"']*)["']"""

Patterns = list[tuple[str, str]]


def detect_board(url: Column, patterns: Patterns = BOARD_PATTERNS) -> Column:
    """struct(platform, slug) of a bare board root, else null."""
    found = F.lit(None)
    for platform, pattern in reversed(patterns):
        slug = F.regexp_extract(url, pattern, 1)
        if pattern.count("(") - pattern.count("(?") > 1:
            slug = F.concat(slug, F.lit("."), F.regexp_extract(url, pattern, 2))
        found = F.when(
            url.rlike(pattern), F.struct(F.lit(platform).alias("platform"), slug.alias("slug"))
        ).otherwise(found)
    return found


def on_known_host(url: Column, pattern: str = KNOWN_HOST_PATTERN) -> Column:
    return F.coalesce(url.rlike(pattern), F.lit(False))


def board_in_page(final_url: Column, hrefs: Column, patterns: Patterns = BOARD_PATTERNS) -> Column:
    """Board of the address a page ended at, else of its first link to a board root."""
    linked = F.array_compact(F.transform(hrefs, lambda h: detect_board(h, patterns)))
    return F.coalesce(detect_board(final_url, patterns), F.get(linked, F.lit(0)))


def page_boards(pages: DataFrame, patterns: Patterns = BOARD_PATTERNS) -> DataFrame:
    """(url, board) for landed pages (url, final_url, html) that reveal a board."""
    board = board_in_page(F.col("final_url"), extract_hrefs(F.col("html")), patterns)
    return pages.select("url", board.alias("board")).filter(F.col("board").isNotNull())


def page_snippet(html: Column) -> Column:
    """Decoded meta description of a page, null when blank or absent."""
    return stripped_or_null(html_unescape(F.regexp_extract(html, META_DESCRIPTION_PATTERN, 1)))


def resolve_boards(
    links: DataFrame,
    pages: DataFrame,
    url: str = "url",
    patterns: Patterns = BOARD_PATTERNS,
    known_host: str = KNOWN_HOST_PATTERN,
) -> DataFrame:
    """Add ``board``: straight from the URL, else from the landed page of that URL.

    Each distinct unresolved URL is looked at once.  URLs on a known host that
    are no board root are specific already and stay unresolved.
    """
    direct = links.withColumn("_direct", detect_board(F.col(url), patterns))
    pending = F.col("_direct").isNull() & ~on_known_host(F.col(url), known_host)
    wanted = direct.filter(pending).select(F.col(url).alias("url")).distinct()
    # A page may have landed more than once; any link gets one board.
    resolved = (
        page_boards(pages.join(wanted, "url", "left_semi"), patterns)
        .groupBy(F.col("url").alias(url))
        .agg(F.min("board").alias("_resolved"))
    )
    return (
        direct.join(resolved, url, "left")
        .withColumn("board", F.coalesce("_direct", F.when(pending, F.col("_resolved"))))
        .drop("_direct", "_resolved")
    )


def due_sources(sources: DataFrame, scans: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Sources never scanned, or last scanned at least ``days`` ago."""
    age = F.unix_micros(as_of) - F.unix_micros("last_scanned_at")
    due = F.col("last_scanned_at").isNull() | (age >= days * 86_400_000_000)
    return sources.join(scans, "source_name", "left").filter(due).drop("last_scanned_at")


def not_polled_yet(discovered: DataFrame, polled: DataFrame) -> DataFrame:
    """Boards found in this run: recorded now, polled from the next run on."""
    return discovered.join(polled, ["platform", "board_slug"], "left_anti")


def seed_boards(
    candidates: DataFrame, pages: DataFrame, via_prefix: str = "github", patterns: Patterns = BOARD_PATTERNS
) -> DataFrame:
    """Boards behind the candidate links (source_name, url, ord) of scanned lists."""
    found = resolve_boards(candidates, pages, "url", patterns).filter(F.col("board").isNotNull())
    return found.select(
        F.col("board.platform").alias("platform"),
        F.col("board.slug").alias("board_slug"),
        F.lit(None).cast("string").alias("company"),
        F.concat(F.lit(f"{via_prefix}:"), "source_name").alias("discovered_via"),
        F.col("url").alias("discovered_url"),
        "ord",
    )


def poll_counts(polled: DataFrame, postings: DataFrame) -> DataFrame:
    """Postings per polled board, 0 for a board that delivered nothing."""
    counts = postings.groupBy("platform", "board_slug").agg(F.count("*").alias("n"))
    return (
        polled.select("platform", "board_slug")
        .join(counts, ["platform", "board_slug"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
    )
