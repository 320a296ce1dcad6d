"""Keyed merges that keep what belongs to the user, and the bucketed table they are kept in."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefunnel.schema import BOARD_DDL, POSTING_DDL, SCAN_DDL, STATUSES, allowed, conform, ddl_fields
from rolefunnel.session import cut_lineage

# Columns a merge never overwrites on a known key.
POSTING_KEPT = ["status", "first_seen_at"]
BOARD_KEPT = ["enabled", "first_seen_at", "last_polled_at", "last_poll_result_count"]
BOARD_KEY = ["platform", "board_slug"]


def merge_keyed(
    stored: DataFrame, incoming: DataFrame, keys: list[str], kept: list[str], ddl: str
) -> DataFrame:
    """Full outer merge: incoming columns win except ``kept``, which stay with the store.

    ``incoming`` must hold one row per key.  Overwriting includes overwriting
    with null, as an update of the named columns does.
    """
    old = stored.select(*[F.col(c).alias(c if c in keys else f"_old_{c}") for c, _ in ddl_fields(ddl)], F.lit(True).alias("_is_old"))
    new = conform(incoming, ddl).withColumn("_is_new", F.lit(True))
    joined = new.join(old, keys, "full")
    known, fresh = F.col("_is_old").isNotNull(), F.col("_is_new").isNotNull()
    columns = []
    for name, dtype in ddl_fields(ddl):
        if name in keys:
            columns.append(F.col(name))
        else:
            take_old = known if name in kept else ~fresh
            columns.append(F.when(take_old, F.col(f"_old_{name}")).otherwise(F.col(name)).cast(dtype).alias(name))
    return joined.select(*columns)


def last_arrivals(incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The row with the greatest ``ord`` of each key; one of them where several share it.

    Only ids are aggregated and only keys that repeat come back: wide rows are
    not sorted ahead of the shuffle the merge needs anyway.
    """
    repeated = (
        incoming.groupBy(*keys)
        .agg(F.max("ord").alias("_last"), F.count("*").alias("_n"))
        .filter(F.col("_n") > 1)
        .drop("_n")
    )
    marked = incoming.join(repeated, keys, "left")
    last = marked.filter(F.col("ord") == F.col("_last")).dropDuplicates(keys)
    return marked.filter(F.col("_last").isNull()).unionByName(last).drop("_last")


def merge_postings(stored: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Upsert by ``dedup_key``; the last arrival wins among equal incoming keys."""
    if "ord" in incoming.columns:
        incoming = last_arrivals(incoming, ["dedup_key"])
    seen = F.col("first_seen_at") if "first_seen_at" in incoming.columns else F.lit(None).cast("timestamp")
    status = F.col("status") if "status" in incoming.columns else F.lit(None).cast("string")
    stamped = incoming.withColumns(
        {
            "status": F.coalesce(status, F.lit("new")),
            "first_seen_at": F.coalesce(seen, now),
            "last_seen_at": now,
        }
    )
    return merge_keyed(stored, stamped, ["dedup_key"], POSTING_KEPT, POSTING_DDL)


def set_status(stored: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply the newest valid change (dedup_key, status, ts) of each key.

    Returns (table, rejected changes): values outside the vocabulary and keys
    that are not stored are rejected and touch nothing.
    """
    valid = allowed(F.col("status"), STATUSES)
    last = (
        changes.filter(valid)
        .groupBy("dedup_key")
        .agg(F.max(F.struct("ts", "status"))["status"].alias("_status"))
    )
    table = (
        stored.join(last, "dedup_key", "left")
        .withColumn("status", F.coalesce("_status", "status"))
        .drop("_status")
    )
    unknown = changes.filter(valid).join(stored.select("dedup_key"), "dedup_key", "left_anti")
    rejected = (
        changes.filter(~valid)
        .withColumn("error", F.lit("unknown status"))
        .unionByName(unknown.withColumn("error", F.lit("unknown key")))
    )
    return table, rejected


def merge_boards(stored: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Upsert discovered boards; ``found`` may repeat a board, its last ``ord`` wins."""
    if "ord" in found.columns:
        found = last_arrivals(found, BOARD_KEY)
    stamped = found.withColumns({"enabled": F.lit(True), "first_seen_at": now, "last_seen_at": now})
    return merge_keyed(stored, stamped, BOARD_KEY, BOARD_KEPT, BOARD_DDL)


def record_polls(boards: DataFrame, counts: DataFrame, now: Column) -> DataFrame:
    """Set the two poll columns of the polled boards (platform, board_slug, n)."""
    polled = F.col("n").isNotNull()
    return (
        boards.join(counts.select(*BOARD_KEY, F.col("n").cast("int")), BOARD_KEY, "left")
        .withColumns(
            {
                "last_polled_at": F.when(polled, now).otherwise(F.col("last_polled_at")),
                "last_poll_result_count": F.coalesce("n", "last_poll_result_count"),
            }
        )
        .drop("n")
    )


def set_enabled(boards: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply the newest (platform, board_slug, enabled, ts) of each board."""
    last = changes.groupBy(*BOARD_KEY).agg(F.max(F.struct("ts", "enabled"))["enabled"].alias("_enabled"))
    return (
        boards.join(last, BOARD_KEY, "left")
        .withColumn("enabled", F.coalesce("_enabled", "enabled"))
        .drop("_enabled")
    )


def record_scans(scans: DataFrame, done: DataFrame) -> DataFrame:
    """Last scan per source after adding ``done`` (source_name, last_scanned_at)."""
    both = scans.select("source_name", "last_scanned_at").unionByName(done.select("source_name", "last_scanned_at"))
    return both.groupBy("source_name").agg(F.max("last_scanned_at").alias("last_scanned_at"))


def known_boards(boards: DataFrame, enabled_only: bool = True) -> DataFrame:
    return boards.filter(F.col("enabled")) if enabled_only else boards


def lookup(stored: DataFrame, key: str) -> DataFrame:
    """One row by key; the predicate reaches the Parquet scan."""
    return stored.filter(F.col("dedup_key") == key)


_ORDER_TERM = re.compile(r"([A-Za-z_][A-Za-z0-9_]*)(?:\s+(ASC|DESC))?")


def ordered(df: DataFrame, order_by: str) -> DataFrame:
    """Global order from ``"col [ASC|DESC], ..."``; anything else is an error.

    Nulls come first ascending and last descending.
    """
    terms = []
    for part in order_by.strip().split(","):
        match = _ORDER_TERM.fullmatch(part.strip())
        if not match or match.group(1) not in df.columns:
            raise ValueError(f"unsafe order_by clause: {order_by!r}")
        column = F.col(match.group(1))
        terms.append(column.desc_nulls_last() if match.group(2) == "DESC" else column.asc_nulls_first())
    return cut_lineage(df).orderBy(*terms)  # written once: a range sort reads its input twice


class BucketTable:
    """A keyed table as Parquet folders, one for each bucket of a hash of the key.

    A merge reads and rewrites only the buckets its rows fall into, through Spark's
    own committer (dynamic partition overwrite): the new files are complete before
    they take the place of the old ones, and other buckets are not touched.  The
    number of buckets belongs to the table; choose it so that a bucket fits one task.
    Files carry bloom filters of the key, so that a look-up opens one bucket and reads
    no row group without the key.

    One writer at a time; a frame read before a merge must not be read after it.
    Merging a batch again gives the same rows, so a replayed batch does no harm.
    """

    def __init__(self, spark: SparkSession, path: str, ddl: str, keys: list[str], buckets: int = 64):
        if buckets < 1:
            raise ValueError("a table needs a bucket")
        self.spark, self.ddl, self.keys, self.buckets = spark, ddl, keys, buckets
        self.path = path.rstrip("/")

    @classmethod
    def postings(cls, spark: SparkSession, path: str, buckets: int = 64) -> BucketTable:
        return cls(spark, path, POSTING_DDL, ["dedup_key"], buckets)

    @classmethod
    def boards(cls, spark: SparkSession, path: str, buckets: int = 16) -> BucketTable:
        return cls(spark, path, BOARD_DDL, BOARD_KEY, buckets)

    @classmethod
    def scans(cls, spark: SparkSession, path: str, buckets: int = 1) -> BucketTable:
        return cls(spark, path, SCAN_DDL, ["source_name"], buckets)

    def bucket_of(self, *keys: Column | str) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def _folders(self) -> DataFrame:
        """Rows with their bucket; ``of`` is the number of buckets they were written for."""
        schema = f"{self.ddl}, of int, bucket int"
        try:
            rows = self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
        wrong = f"{self.path} was written with another number of buckets than {self.buckets}"
        same = F.when(F.col("of") == self.buckets, True).otherwise(F.raise_error(F.lit(wrong)).cast("boolean"))
        return rows.filter(same)

    def read(self) -> DataFrame:
        return self._folders().drop("of", "bucket")

    def lookup(self, *key: str) -> DataFrame:
        """The row of one key: one bucket is listed, its bloom filters and statistics are asked."""
        rows = self._folders().filter(F.col("bucket") == self.bucket_of(*[F.lit(k) for k in key]))
        for name, value in zip(self.keys, key, strict=True):
            rows = rows.filter(F.col(name) == F.lit(value))
        return rows.drop("of", "bucket")

    def merge(self, rows: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the buckets of ``rows`` by ``how(stored rows of these buckets, rows)``; returns their numbers.

        ``rows`` is read twice.  ``how`` must keep every stored row that it does not change.
        """
        placed = rows.withColumn("_bucket", self.bucket_of(*self.keys))
        touched = sorted(r[0] for r in placed.select("_bucket").distinct().collect())  # no more than there are buckets
        if touched:
            old = self._folders().filter(F.col("bucket").isin(touched)).drop("of", "bucket")
            self._write(how(old, rows))
        return touched

    def replace(self, rows: DataFrame) -> None:
        """Write the buckets that ``rows`` fall into, whole: for a first load."""
        self._write(rows)

    def _write(self, rows: DataFrame) -> None:
        bucket = self.bucket_of(*self.keys).alias("bucket")
        out = conform(rows, self.ddl).select("*", F.lit(self.buckets).alias("of"), bucket)
        writer = out.repartition("bucket").sortWithinPartitions("bucket", *self.keys).write.partitionBy("of", "bucket").mode("overwrite")
        writer = writer.option("partitionOverwriteMode", "dynamic")
        for key in self.keys:
            writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
        writer.parquet(self.path)
