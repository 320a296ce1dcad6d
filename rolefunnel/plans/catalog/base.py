"""Registration of queries and the inputs several of them share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefunnel.session import prepare

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: QueryFn
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def add(fn: QueryFn) -> QueryFn:
        CATALOG[name] = Query(fn, sql)
        return fn

    return add


#: Session setting: number of partitions that tables are dealt out to once read, for files of one row group.
INPUT_PARTITIONS = "spark.rolefunnel.inputPartitions"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table; how it is split is for the session to say.

    ``spark.sql.files.maxPartitionBytes`` cuts files between row groups; where they have
    only one, ``INPUT_PARTITIONS`` deals the rows out.  Unset, files are read as they lie.
    """
    rows = prepare(spark).read.parquet(f"{folder}/{name}.parquet")
    parts = spark.conf.get(INPUT_PARTITIONS, None)
    return rows.repartition(int(parts)) if parts else rows


def title_of(text: str = "text"):
    """The first line."""
    return F.substring_index(text, "\n", 1)


def documents_as_postings(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """Documents in the shape of postings; ``POSTINGS_SQL`` is the same in SQL."""
    docs = table(spark, folder, "documents")
    # Posting dates spread over two weeks before AS_OF, by document number.
    posted = F.timestamp_micros(F.lit(AS_OF_US) - (F.col("doc_id") % 20) * 17 * 3_600_000_000)
    rows = docs.select(
        "doc_id",
        title_of().alias("title"),
        F.col("source").alias("company"),
        F.col("text").alias("description"),
        F.concat(F.lit("https://www.example.org/post/"), F.col("doc_id").cast("string"), F.lit("/?ref=1")).alias("url"),
        "source",
        posted.alias("posted_date"),
        F.array("lang", "source").alias("tags"),
        F.col("lang").alias("location_text"),
        F.col("doc_id").cast("string").alias("source_id"),
        F.when(F.col("doc_id") % 7 == 0, "employment").otherwise("unclear").alias("contract_type_guess"),
        F.col("doc_id").alias("ord"),
    )
    return rows.select(*columns) if columns else rows


AS_OF = "2024-01-31T00:00:00Z"
AS_OF_US = 1_706_659_200_000_000

# --- SQL fragments -------------------------------------------------------------

WORD = r"\p{L}\p{N}_"


def sql_norm(x: str) -> str:
    spaced = f"translate(lower(coalesce({x}, '')), '-_/', '   ')"
    kept = rf"regexp_replace({spaced}, '[^\p{{L}}\p{{N}}_\s\p{{Z}}]', '', 'g')"
    return rf"trim(regexp_replace({kept}, '[\s\p{{Z}}]+', ' ', 'g'))"


def sql_unescape(x: str) -> str:
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">")):
        x = f"replace({x}, '{entity}', '{char}')"
    return f"replace({x}, '&amp;', '&')"


def sql_strip_html(x: str) -> str:
    x = rf"regexp_replace({sql_unescape(x)}, '(?i)</?(p|div|br|li|tr|h[1-6])\s*/?>', chr(10), 'g')"
    x = rf"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    x = rf"regexp_replace({x}, '[ \t\x{{a0}}]+', ' ', 'g')"
    x = rf"regexp_replace({x}, '\s*\n\s*', chr(10), 'g')"
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def sql_normalize_url(x: str) -> str:
    host = rf"regexp_replace(lower(regexp_extract(trim({x}), '^https?://([^/?#]*)', 1)), '^www\.', '')"
    path = rf"rtrim(regexp_extract(trim({x}), '^https?://[^/?#]*([^?#]*)', 1), '/')"
    return f"'https://' || {host} || {path}"


SQL_TITLE = "split_part(text, chr(10), 1)"
SQL_EMAIL = r"nullif(regexp_extract(text, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+', 0), '')"

POSTINGS_SQL = f"""
postings AS (
  SELECT doc_id, {SQL_TITLE} AS title, source AS company, text AS description,
         'https://www.example.org/post/' || doc_id || '/?ref=1' AS url, source,
         (doc_id % 20) * 17 / 24.0::DOUBLE AS age, lang AS location_text,
         CASE WHEN doc_id % 7 = 0 THEN 'employment' ELSE 'unclear' END AS stated_contract
  FROM documents)"""


def with_place(ordered: DataFrame) -> DataFrame:
    """Number the rows of a globally sorted frame without gathering them.

    Partitions are sorted ranges, so a row's place is the number of rows in
    earlier partitions plus its number inside its own.
    """
    from pyspark.sql import Window

    from rolefunnel.session import cut_lineage

    parts = cut_lineage(
        ordered.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_seq"))
    )
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row per partition of the sort: bounded by the number of shuffle partitions.
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.col("_seq") - F.shiftleft(F.col("_part").cast("bigint"), 33)
    return (
        parts.join(F.broadcast(offsets), "_part")
        .withColumn("place", F.col("_before") + inside + 1)
        .drop("_part", "_seq", "_before")
    )
