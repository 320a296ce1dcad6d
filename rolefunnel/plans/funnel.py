"""The whole run: sources, duplicates, classification, scores, merge, report."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefunnel.operators.boards import due_sources, poll_counts, seed_boards
from rolefunnel.operators.classify import classify
from rolefunnel.operators.dedupe import dedupe
from rolefunnel.operators.external import RESPONSE_DDL, select_score
from rolefunnel.operators.report import bucket_counts, console_table, counters_of, top_n, write_counted
from rolefunnel.operators.rules import Settings
from rolefunnel.operators.scoring import score
from rolefunnel.operators.store import BucketTable, merge_boards, merge_postings, record_polls, record_scans
from rolefunnel.schema import CONTENT_DDL, conform
from rolefunnel.session import cut_lineage, prepare, scratch_path
from rolefunnel.sources.registry import (
    RANKS,
    SOURCES,
    candidate_links,
    discovered_boards,
    enabled_sources,
    expand_boards,
    link_boards,
    poll_registry,
)
from rolefunnel.sources.threads import FREELANCE, HIRING, newest_postings

THREAD_KINDS = {kind.name: kind for kind in (HIRING, FREELANCE)}


@dataclass
class RunResult:
    """What a run reports: this run's counters, and views over all stored rows."""

    snapshot: DataFrame
    counters: DataFrame
    buckets: DataFrame
    top: DataFrame


@dataclass
class Collected:
    """All content of a run, and what it says about boards."""

    postings: DataFrame
    discovered: DataFrame | None
    polls: DataFrame


def collect_sources(
    landed: dict[str, DataFrame],
    boards: DataFrame,
    payloads: DataFrame,
    pages: DataFrame,
    settings: Settings,
    as_of: Column,
) -> Collected:
    """Registry first, then every enabled source; threads expand the boards they link to.

    ``payloads`` (platform, board_slug, payload) and ``pages`` (url, final_url,
    html) are what was landed for boards and links.
    """
    polled = poll_registry(boards, payloads, as_of, pages)
    parts, found = [conform(polled, CONTENT_DDL)], []
    for name in enabled_sources(settings.sources):
        if name not in landed:
            continue
        kind = THREAD_KINDS.get(name)
        if kind is None:
            parts.append(SOURCES[name](landed[name]))
        else:
            linked = link_boards(newest_postings(landed[name], kind, RANKS[name]), pages)
            parts.append(expand_boards(linked, payloads, pages))
            found.append(discovered_boards(linked))
    return Collected(
        postings=reduce(DataFrame.unionByName, parts),
        discovered=reduce(DataFrame.unionByName, found) if found else None,
        polls=poll_counts(boards.filter(F.col("enabled")), polled),
    )


def update_boards(boards: DataFrame, collected: Collected, now: Column, seeded: DataFrame | None = None) -> DataFrame:
    """The board table after a run: polls recorded, then discoveries merged."""
    updated = record_polls(boards, collected.polls, now)
    for found in (collected.discovered, seeded):
        if found is not None:
            updated = merge_boards(updated, found, now)
    return updated


@dataclass
class Seeded:
    """What scanning the link lists that were due has changed."""

    due: DataFrame
    boards: DataFrame
    scans: DataFrame


def seed_from_lists(
    sources: DataFrame, lists: DataFrame, boards: DataFrame, scans: DataFrame, pages: DataFrame, settings: Settings, as_of: Column
) -> Seeded:
    """Scan the lists (source_name, text) whose source is due, merge the boards they lead to, record the scan.

    ``sources`` (source_name) are the configured ones, so few: the names of those that
    are due become a filter, which prunes the partitions of ``lists`` where those are
    partitioned by source.  Lists that are not due are not opened.
    """
    due = cut_lineage(due_sources(sources.select("source_name").distinct(), scans, as_of, settings.scan_interval_days).select("source_name"))
    scanned = lists.filter(F.col("source_name").isin([r["source_name"] for r in due.collect()]))
    # Documents of one source follow each other by a number where they have one.
    first = F.col("part") if "part" in lists.columns else F.lit(0)
    links = candidate_links(scanned.withColumn("_list", F.struct("source_name", first.cast("bigint").alias("part"))), "_list")
    rows = links.select(F.col("_list.source_name").alias("source_name"), "url", F.struct("_list.part", "ord", "_list.source_name", "url").alias("ord"))
    found = seed_boards(rows, pages)
    return Seeded(due, merge_boards(boards, found, as_of), record_scans(scans, due.withColumn("last_scanned_at", as_of)))


def rank_postings(
    unique: DataFrame,
    settings: Settings,
    as_of: Column,
    stored: DataFrame | None = None,
    responses: DataFrame | None = None,
) -> DataFrame:
    """Classify and score de-duplicated postings."""
    classified = classify(unique, settings.rules, keep_hits=True)
    if settings.ranking_mode == "ai" and stored is not None:
        if responses is None:  # nothing new: cached results still count
            responses = classified.sparkSession.createDataFrame([], f"dedup_key string, r struct<{RESPONSE_DDL}>")
        return select_score(classified, settings.rules, as_of, stored, responses)
    return score(classified, settings.rules, as_of)


def run(
    spark: SparkSession,
    postings: DataFrame,
    store: BucketTable,
    settings: Settings,
    as_of: Column,
    responses: DataFrame | None = None,
) -> RunResult:
    """One run over ``postings`` (content schema with a unique ``ord``).

    The content is written to the shared folder once, since parsing and
    clustering both read it; the merge rewrites the buckets its rows fall into.
    """
    prepare(spark)
    content, fetched = write_counted(conform(postings, CONTENT_DDL), scratch_path(spark, "content"))
    stored = store.read()
    unique = dedupe(content)
    ranked = rank_postings(unique, settings, as_of, stored, responses)
    # The outcome of clustering is read twice by the merge: write it once, and count it.
    ranked, unique_rows = write_counted(ranked, scratch_path(spark, "ranked"))
    store.merge(ranked, lambda old, new: merge_postings(old, new, as_of))
    snapshot = store.read()
    return RunResult(
        snapshot=snapshot,
        counters=counters_of(spark, fetched["rows"], unique_rows["rows"]),
        buckets=bucket_counts(snapshot),
        top=console_table(top_n(snapshot, minimum=settings.min_score_threshold)),
    )
