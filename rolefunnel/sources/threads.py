"""Comment threads: each top-level comment of the newest matching thread is a posting."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefunnel.functions.dates import parse_iso
from rolefunnel.functions.headers import (
    ALL,
    MIN_ROLE_LINKS,
    ROLE_MARKER_PATTERN,
    ROLE_NOT_STATED,
    SELF_PROFILE_PATTERN,
    Limits,
    bulleted_title,
    first_line,
    parse_header,
    role_links,
    strip_role_marker,
)
from rolefunnel.functions.text import strip_html
from rolefunnel.functions.urls import (
    application_channel,
    best_apply_url,
    extract_email,
    extract_hrefs,
)
from rolefunnel.operators.barrier import add_once
from rolefunnel.schema import CONTENT_DDL, arrival_order, child_order, conform

PERMALINK = "https://news.ycombinator.com/item?id="

# Stories (story_id, title, created) and comments (story_id, pos, id, text, ...).
COMMENT_DDL = "id bigint, text string, created_at string, deleted boolean, dead boolean"
THREAD_DDL = f"id string, title string, created_at string, children array<struct<{COMMENT_DDL}>>"


@dataclass(frozen=True)
class ThreadKind:
    """What differs between the monthly threads."""

    name: str
    title_test: Callable[[Column], Column]
    accept: Callable[[Column], Column]
    header: Callable[[Column], Column]


def title_includes(*wanted: str, without: tuple[str, ...] = ()) -> Callable[[Column], Column]:
    def test(title: Column) -> Column:
        lowered = F.lower(F.coalesce(title, F.lit("")))
        ok = F.lit(True)
        for word in wanted:
            ok = ok & F.contains(lowered, F.lit(word))
        for word in without:
            ok = ok & ~F.contains(lowered, F.lit(word))
        return ok

    return test


def not_self_profile(text: Column, opening: int | None = None) -> Column:
    """Hiring, not someone presenting themselves; judged by the first ``opening`` characters, or all."""
    return ~(text if opening is None else F.left(text, F.lit(opening))).rlike(SELF_PROFILE_PATTERN)


def leads_with_marker(text: Column) -> Column:
    return text.rlike(ROLE_MARKER_PATTERN)


HIRING = ThreadKind(
    "hn_whoishiring",
    title_includes("who is hiring", without=("wants to be hired", "freelancer")),
    not_self_profile,
    first_line,
)
FREELANCE = ThreadKind(
    "hn_freelancer",
    title_includes("freelancer", "seeking freelancer"),
    leads_with_marker,
    lambda text: strip_role_marker(first_line(text)),
)


def threads_from_json(landed: DataFrame) -> DataFrame:
    """(id, title, created_at, children) from landed thread payloads."""
    return landed.select(F.from_json("payload", THREAD_DDL).alias("t")).select("t.*")


def stories(threads: DataFrame) -> DataFrame:
    """(id, title, created_at): what says which thread is wanted, without a comment."""
    return threads.select("id", "title", "created_at")


def comment_rows(threads: DataFrame) -> DataFrame:
    """(id, parent, thread, pos, text, created_at, deleted, dead): threads taken apart; their comments have the thread as parent."""
    children = F.filter("children", lambda c: c.isNotNull())
    rows = threads.select(F.col("id").alias("thread"), F.posexplode(children).alias("pos", "c"))
    return rows.select("c.id", F.col("thread").alias("parent"), "thread", "pos", "c.text", "c.created_at", "c.deleted", "c.dead")


def latest_thread(threads: DataFrame, kind: ThreadKind) -> DataFrame:
    """The newest thread whose title passes the test: one row or none."""
    return (
        threads.filter(kind.title_test(F.col("title")))
        .agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))
        .filter(F.col("id").isNotNull())
    )


def top_level_comments(threads: DataFrame) -> DataFrame:
    """(thread, pos, id, text, created_at, deleted, dead), replies left out."""
    return comment_rows(threads).drop("parent")


def comments_of(comments: DataFrame, thread: DataFrame) -> DataFrame:
    """Top-level comments of the one thread (id) among ``comments`` (id, parent, pos, ...), replies left out.

    A comment is a row, so the comments of one thread are spread over all tasks and no
    text is read of any other thread.
    """
    # One row, hence the broadcast.
    root = F.broadcast(thread.select(F.col("id").cast("string").alias("_root")))
    return comments.join(root, F.col("parent").cast("string") == F.col("_root")).withColumnRenamed("_root", "thread_id")


def live_comments(comments: DataFrame) -> DataFrame:
    """Drop deleted, dead and empty comments."""
    gone = F.coalesce("deleted", F.lit(False)) | F.coalesce("dead", F.lit(False))
    return comments.filter(~gone & (F.coalesce("text", F.lit("")) != ""))


def comment_postings(comments: DataFrame, kind: ThreadKind, rank: int, limits: Limits = ALL) -> DataFrame:
    """Postings of top-level comments, with the fields expansion needs: hrefs."""
    rows = (
        add_once(live_comments(comments), {"plain": strip_html(F.col("text"))})
        .filter(F.col("plain") != "")
        .filter(kind.accept(F.col("plain")))
        .withColumns(
            {
                "named": parse_header(kind.header(F.col("plain")), limits=limits),
                "hrefs": extract_hrefs(F.col("text")),
                "email": extract_email(F.col("plain")),
            }
        )
        .withColumn("apply_url", best_apply_url(F.col("plain"), F.col("hrefs")))
    )
    unnamed = F.col("named.title") == ROLE_NOT_STATED
    title = F.when(unnamed, F.coalesce(bulleted_title(F.col("plain"), limits=limits), F.col("named.title")))
    return rows.select(
        title.otherwise(F.col("named.title")).alias("title"),
        "named.company",
        F.col("plain").alias("description"),
        F.coalesce("apply_url", F.concat(F.lit(PERMALINK), F.col("id").cast("string"))).alias("url"),
        F.lit(kind.name).alias("source"),
        parse_iso(F.col("created_at")).alias("posted_date"),
        F.array().cast("array<string>").alias("tags"),
        application_channel(F.col("apply_url").isNotNull(), F.col("email"), email_first=True).alias(
            "application_channel"
        ),
        F.col("id").cast("string").alias("source_id"),
        F.lit("unclear").alias("contract_type_guess"),
        arrival_order(rank, F.lit(0), F.col("pos")).alias("ord"),
        "hrefs",
    )


def expand_role_links(postings: DataFrame, where: Column | None = None, limits: Limits = ALL) -> DataFrame:
    """One row per bulleted role with its own link; rows without such bullets unchanged.

    ``where`` restricts the expansion to some rows.
    """
    links = role_links(F.col("description"), F.col("hrefs"), limits=limits)
    if where is not None:
        links = F.when(where, links)
    several = F.when(F.size("_links") >= MIN_ROLE_LINKS, F.col("_links"))
    rows = add_once(postings, {"_links": links}).select(
        *postings.columns, F.posexplode_outer(several).alias("_i", "_link")
    )
    child = F.col("_link").isNotNull()
    return rows.withColumns(
        {
            "title": F.when(child, F.col("_link.name")).otherwise(F.col("title")),
            "url": F.when(child, F.col("_link.url")).otherwise(F.col("url")),
            "application_channel": F.when(child, "url").otherwise(F.col("application_channel")),
            "source_id": F.when(
                child, F.concat(F.col("source_id"), F.lit(":bullet:"), F.col("_i").cast("string"))
            ).otherwise(F.col("source_id")),
            "ord": child_order(F.col("ord"), F.col("_i")),
        }
    ).drop("_i", "_link")


def newest_from_rows(stories: DataFrame, comments: DataFrame, kind: ThreadKind = HIRING, rank: int = 2, limits: Limits = ALL) -> DataFrame:
    """Postings (with ``hrefs``) of the newest matching thread among ``stories`` (id, title, created_at), nothing expanded yet.

    ``comments`` is (id, parent, pos, text, created_at, deleted, dead), replies included.
    """
    return comment_postings(comments_of(comments, latest_thread(stories, kind)), kind, rank, limits)


def newest_postings(threads: DataFrame, kind: ThreadKind = HIRING, rank: int = 2, limits: Limits = ALL) -> DataFrame:
    """``newest_from_rows`` for threads with nested comments; these are dealt out before their texts are parsed."""
    newest = threads.join(F.broadcast(latest_thread(stories(threads), kind)), "id", "left_semi")
    return comment_postings(comment_rows(newest).repartition("id"), kind, rank, limits)


def thread_postings(threads: DataFrame, kind: ThreadKind = HIRING, rank: int = 2, limits: Limits = ALL) -> DataFrame:
    """Content rows of the newest matching thread, bulleted role links expanded."""
    return conform(expand_role_links(newest_postings(threads, kind, rank, limits), limits=limits), CONTENT_DDL)
