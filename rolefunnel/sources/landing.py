"""Landed payloads: one row (page, payload) per file, whatever its format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolefunnel.operators.windows import first_wins


def read_landed(spark: SparkSession, path: str, page_pattern: str = r"(\d+)\D*$") -> DataFrame:
    """(page, path, payload) of a folder of payload files.

    Pages count the files from 0, ordered by the number that ``page_pattern`` finds
    in the file name (0 without one) and then by path: no two files share a page,
    and a long number (a date, say) makes no long page.
    """
    number = F.regexp_extract(F.regexp_extract("path", r"([^/]*)$", 1), page_pattern, 1)
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))
    # One row per file and no payload: small enough to be counted in one task.
    order = Window.orderBy(F.coalesce(F.nullif(number, F.lit("")), F.lit("0")).cast("decimal(38,0)"), "path")
    pages = files.select("path").withColumn("page", (F.row_number().over(order) - 1).cast("bigint"))
    return files.join(pages, "path")


def _explode_items(landed: DataFrame, items: Column) -> DataFrame:
    # The parse goes straight into the generator: as a column of its own it would
    # be repeated in the not-empty filter Spark derives for generators.
    context = [c for c in landed.columns if c != "payload"]
    return landed.select(*context, F.posexplode(items).alias("pos", "_item")).select("*", "_item.*").drop("_item")


def json_items(landed: DataFrame, ddl: str, member: str | None) -> DataFrame:
    """One row per item: (page, pos, and the fields of ``ddl``).

    ``member`` names the array inside a wrapped object; None means the payload
    is a bare array.  A payload of another shape yields no rows; an item that is no
    object has null fields and disturbs no other item.
    """
    def parse(item: str) -> Column:
        schema = f"array<{item}>" if member is None else f"struct<{member}: array<{item}>>"
        parsed = F.from_json("payload", schema, {"mode": "PERMISSIVE"})
        return parsed if member is None else parsed[member]

    # One scalar among the objects makes the whole array unreadable as structs: then item by item.
    item = f"struct<{ddl}>"
    items = F.coalesce(parse(item), F.transform(parse("string"), lambda i: F.from_json(i, item, {"mode": "PERMISSIVE"})))
    shaped = F.startswith(F.ltrim("payload"), F.lit("[" if member is None else "{"))
    return _explode_items(landed, F.when(shaped, items))


def xml_items(landed: DataFrame, ddl: str, row_tag: str, members: str) -> DataFrame:
    """Like ``json_items`` for XML: ``members`` is the dotted way from the root to the items."""
    schema = f"array<struct<{ddl}>>"
    for name in reversed(members.split(".")):
        schema = f"struct<`{name}`: {schema}>"
    parsed = F.from_xml("payload", schema, {"rowTag": row_tag, "mode": "PERMISSIVE"})
    for name in members.split("."):
        parsed = parsed[name]
    return _explode_items(landed, parsed)


def json_item_count(member: str) -> Column:
    """Number of items of a wrapped payload; null when it does not parse."""
    return F.json_array_length(F.get_json_object("payload", f"$.{member}"))


def page_report(pages: DataFrame, size: Column, page_size: int | None = None, first_page: int = 0) -> DataFrame:
    """(page, n, short, gap): what has landed of a paged source; every page is reported and stays readable.

    ``size`` counts the items of a row, and a page may span several rows.  ``short`` is
    a page with fewer items than ``page_size``, or with none; ``gap`` a page whose
    predecessor has not landed.  A pager that stops early shows as one short page at the
    end, a hole as a gap.
    """
    sizes = pages.groupBy("page").agg(F.sum(F.coalesce(size, F.lit(0))).cast("bigint").alias("n"))
    before = sizes.select((F.col("page") + 1).alias("page"), F.lit(True).alias("_before"))
    return sizes.join(before, "page", "left").select(
        "page", "n", (F.col("n") < (page_size or 1)).alias("short"), (F.col("_before").isNull() & (F.col("page") > first_page)).alias("gap")
    )


def reached_items(items: DataFrame, size: Column, page_size: int | None = None, first_page: int = 0) -> DataFrame:
    """All rows of ``items`` with ``read``: whether a reader going page by page gets there.

    Reading starts at ``first_page`` and ends with the first page that is missing, empty
    or, where ``page_size`` is given, shorter than it.  No row is dropped.
    """
    sizes = items.filter(F.col("page") >= first_page).groupBy("page").agg(F.sum(F.coalesce(size, F.lit(0))).alias("n"))
    full = sizes.filter(F.col("n") >= (page_size or 1)).select("page")
    # Each full page reaches its follower; the least page reached but not full is the last one read.
    start = items.sparkSession.range(first_page, first_page + 1).select(F.col("id").alias("page"))
    reached = start.unionByName(full.select((F.col("page") + 1).alias("page")))
    stop = reached.join(full, "page", "left_anti").agg(F.min("page").alias("_stop"))
    # One row, hence the broadcast.
    read = F.coalesce(F.col("page").between(first_page, F.col("_stop")), F.lit(False))
    return items.join(F.broadcast(stop)).withColumn("read", read).drop("_stop")


def first_by(df: DataFrame, key: str) -> DataFrame:
    """First arrival per key, in (page, position) order."""
    return first_wins(df, [key], F.struct("page", "pos"))
