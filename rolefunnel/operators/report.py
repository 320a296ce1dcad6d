"""Counts, top lists and report tables over stored postings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rolefunnel.functions.text import blank_to_null, truncate
from rolefunnel.operators.classify import effective_bucket
from rolefunnel.session import cut_lineage

BUCKET_ORDER = ["eligible", "needs_review", "excluded", "irrelevant"]


def bucket_of_row() -> Column:
    return effective_bucket(F.col("is_relevant"), F.col("eligibility_bucket"))


def bucket_counts(df: DataFrame) -> DataFrame:
    """(bucket, n, ord) in display order, zero where a bucket is empty."""
    counts = df.groupBy(bucket_of_row().alias("bucket")).agg(F.count("*").alias("n"))
    shelf = df.sparkSession.createDataFrame(list(enumerate(BUCKET_ORDER)), "ord int, bucket string")
    return shelf.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), "ord")


def score_or_zero() -> Column:
    return F.coalesce(F.col("score"), F.lit(0))


def above_threshold(df: DataFrame, minimum: int) -> DataFrame:
    """Rows in a shown bucket that reach the minimum score."""
    return df.filter(bucket_of_row().isin("eligible", "needs_review") & (score_or_zero() >= minimum))


def by_score(df: DataFrame) -> DataFrame:
    """All rows, best first; ties by key so the order is total.

    A range sort reads its input twice, to sample the ranges and to sort: the rows
    are written once before, so that whatever made them runs once.
    """
    rows = cut_lineage(df)
    return rows.orderBy(score_or_zero().desc(), "dedup_key")


def top_n(df: DataFrame, n: int = 20, minimum: int = 0) -> DataFrame:
    """The best ``n`` shown rows; each task keeps only its own best ``n``."""
    return above_threshold(df, minimum).orderBy(score_or_zero().desc(), "dedup_key").limit(n)


def console_table(df: DataFrame) -> DataFrame:
    return df.select(
        score_or_zero().alias("score"),
        bucket_of_row().alias("bucket"),
        "source",
        truncate(F.col("title"), 45).alias("title"),
        truncate(F.col("company"), 25).alias("company"),
        F.col("contract_type_guess").alias("contract"),
    )


def audit_table(df: DataFrame) -> DataFrame:
    """Every stored row, best first, with its explanation as text."""
    reasons = F.coalesce(
        blank_to_null(F.array_join("reasons", "; ")), F.col("eligibility_reason"), F.lit("")
    )
    shown = df.select(
        "dedup_key",
        score_or_zero().alias("score"),
        bucket_of_row().alias("bucket"),
        "source",
        "title",
        "company",
        "url",
        F.col("contract_type_guess").alias("contract"),
        F.coalesce(F.date_format("posted_date", "yyyy-MM-dd"), F.lit("?")).alias("posted"),
        reasons.alias("reasons"),
        F.coalesce(F.array_join("red_flags", "; "), F.lit("")).alias("red_flags"),
    )
    return by_score(shown).drop("dedup_key")


def faceted(
    df: DataFrame,
    bucket: str | None = None,
    source: str | None = None,
    status: str | None = None,
    min_score: int = 0,
) -> DataFrame:
    """Rows matching every facet that is set."""
    if bucket:
        df = df.filter(bucket_of_row() == bucket)
    if source:
        df = df.filter(F.col("source") == source)
    if status:
        df = df.filter(F.col("status") == status)
    return df.filter(score_or_zero() >= min_score)


def facet_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def source_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count("*").alias("n"))


def run_counters(fetched: DataFrame, unique: DataFrame) -> DataFrame:
    """One row: rows fetched and rows left after removing duplicates."""
    one, none = F.lit(1), F.lit(0)
    flags = fetched.select(one.alias("f"), none.alias("u")).unionAll(unique.select(none.alias("f"), one.alias("u")))
    return flags.agg(F.sum("f").alias("fetched"), F.sum("u").alias("unique_rows"))


def write_counted(df: DataFrame, path: str, sources: Sequence[str] = ()) -> tuple[DataFrame, dict[str, int]]:
    """Write ``df`` to ``path`` and count it on the way: (the table read back, counts).

    ``rows`` counts all rows, each name of ``sources`` the rows with that ``source``.
    Counts are observed in the writing tasks themselves, so nothing is read twice.
    """
    seen = Observation()
    each = [F.count_if(F.col("source") == name).alias(name) for name in sources]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *each).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


def counters_of(spark, fetched: int, unique: int) -> DataFrame:
    """The row of ``run_counters`` from counts that were observed."""
    return spark.createDataFrame([(fetched, unique)], "fetched bigint, unique_rows bigint")
