"""Record schemas and closed value sets shared by sources, operators and stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The closed vocabularies of the enumerated columns.
CHANNELS = ["platform", "email", "url", "unknown"]
BUCKETS = ["eligible", "excluded", "needs_review"]
CONTRACT_TYPES = ["b2b", "employment", "freelance", "unclear"]
STATUSES = ["new", "interested", "applied", "interview", "rejected", "ignored"]
RANKING_SOURCES = ["heuristic", "ai"]
SENIORITY_FITS = ["under_qualified", "match", "over_qualified", "unclear"]

# What a source delivers; everything later stages add is in POSTING_DDL.
CONTENT_DDL = (
    "title string, company string, description string, url string, source string, "
    "posted_date timestamp, salary_text string, tags array<string>, location_text string, "
    "application_channel string, source_id string, contract_type_guess string, ord bigint"
)

SCORE_DDL = (
    "score int, skill_match int, eligibility_confidence int, contract_type_guess string, "
    "reasons array<string>, red_flags array<string>, ranking_source string, seniority_fit string"
)

POSTING_DDL = (
    "dedup_key string, source string, source_id string, title string, company string, "
    "description string, url string, posted_date timestamp, salary_text string, "
    "tags array<string>, location_text string, application_channel string, "
    "eligibility_bucket string, eligibility_reason string, is_relevant boolean, "
    + SCORE_DDL
    + ", status string, first_seen_at timestamp, last_seen_at timestamp"
)

BOARD_DDL = (
    "platform string, board_slug string, company string, discovered_via string, "
    "discovered_url string, enabled boolean, first_seen_at timestamp, last_seen_at timestamp, "
    "last_polled_at timestamp, last_poll_result_count int"
)

SCAN_DDL = "source_name string, last_scanned_at timestamp"


def ddl_fields(ddl: str) -> list[tuple[str, str]]:
    """``"a int, b string"`` -> ``[("a", "int"), ("b", "string")]``."""
    return [tuple(part.strip().split(" ", 1)) for part in ddl.split(",")]


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Project onto ``ddl``: missing columns become typed nulls, extras are dropped."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(name) if name in have else F.lit(None)).cast(dtype).alias(name)
            for name, dtype in ddl_fields(ddl)
        ]
    )


def allowed(column: Column, values: list[str]) -> Column:
    """True where ``column`` holds one of the closed set ``values``."""
    return F.coalesce(column.isin(values), F.lit(False))


def arrival_order(source_rank: int | Column, page: Column, position: Column) -> Column:
    """Pack (source, page, position, child) in one BIGINT, so order needs no global sort.

    The bits of each part are in ``ORDER_BITS``.  A part that needs more is an
    error: two rows must never get one place.
    """
    rank = F.lit(source_rank) if isinstance(source_rank, int) else source_rank
    packed = F.lit(0).cast("bigint")
    for name, value in zip(ORDER_BITS, (rank, page, position), strict=False):
        packed = F.shiftleft(packed, ORDER_BITS[name]) + _in_range(value.cast("bigint"), name)
    return F.shiftleft(packed, ORDER_BITS["child"])


def child_order(parent: Column, child: Column) -> Column:
    """Order of the ``child``-th row expanded from ``parent``."""
    return parent + _in_range(F.coalesce(child, F.lit(0)).cast("bigint"), "child")


# Sources; payload files of a source; items of a file; rows an item is expanded into.
ORDER_BITS = {"source": 4, "page": 21, "position": 20, "child": 18}


def _in_range(value: Column, part: str) -> Column:
    held = (value >= 0) & (value < 1 << ORDER_BITS[part])
    return F.when(held | value.isNull(), value).otherwise(F.raise_error(F.lit(f"{part} of an arrival order is out of range")).cast("bigint"))
