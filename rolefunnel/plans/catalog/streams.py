"""Streaming twins: events as a file stream, the result read back from the sink."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from rolefunnel.functions.dates import utc_timestamp
from rolefunnel.operators.store import BucketTable, merge_postings
from rolefunnel.plans.catalog.base import query, table
from rolefunnel.session import prepare, scratch_path
from rolefunnel.streaming.incremental import append_stream, suppress_repeats, upsert_stream
from rolefunnel.streaming.survivors import SURVIVOR_DDL, keep_richest, use_rocksdb


def _event_stream(spark, d):
    schema = table(spark, d, "events").schema
    return (
        prepare(spark)
        .readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(d)
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )


@query(
    "stream_upsert",
    """SELECT 'user ' || user_id AS dedup_key, arg_max(event_type, event_id) AS title, 'new' AS status,
       epoch_us(TIMESTAMP '2024-02-01') AS first_seen FROM events GROUP BY user_id""",
)
def _(spark, d):
    rows = _event_stream(spark, d).select(
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("dedup_key"),
        F.col("event_type").alias("title"),
        F.lit("stream").alias("source"),
        F.col("event_id").alias("ord"),
    )
    store = BucketTable.postings(spark, scratch_path(spark, "stream-store"), buckets=8)
    now = utc_timestamp("2024-02-01T00:00:00Z")
    job = upsert_stream(
        rows, store, scratch_path(spark, "stream-state"), lambda old, new: merge_postings(old, new, now)
    )
    job.awaitTermination()
    return store.read().select(
        "dedup_key", "title", "status", F.unix_micros("first_seen_at").alias("first_seen")
    )


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, d):
    """The horizon spans the whole table, so this is first sight overall."""
    rows = suppress_repeats(
        _event_stream(spark, d).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "3650 days"
    )
    out = scratch_path(spark, "stream-out")
    append_stream(rows, out, scratch_path(spark, "stream-state")).awaitTermination()
    return spark.read.schema("user_id bigint, event_type string, ts timestamp").parquet(out).select(
        "user_id", "event_type"
    )


@query(
    "stream_survivors",
    """WITH e AS (SELECT user_id % 40 || ' ' || event_type AS key, event_id, length(props || repeat('x', (event_id % 7)::INT)) AS chars, 't' || event_id % 3 AS tag FROM events)
    SELECT key, arg_max(event_id, (chars, -event_id)) AS ord, min(event_id) AS first_ord, count(*) AS members, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags FROM e GROUP BY key""",
)
def _(spark, d):
    """Richest copy of every key over several micro-batches; an event far ahead closes them all."""
    events = table(spark, d, "events")
    folder = scratch_path(spark, "stream-events")
    events.repartition(3).write.parquet(folder)
    end = events.agg(F.max("event_id") + 1, F.max("ts")).toDF("event_id", "ts")
    ahead = end.select("event_id", (F.col("ts") + F.expr("INTERVAL 4000 DAYS")).alias("ts"), F.lit(None).cast("bigint").alias("user_id"),
                       F.lit("end").alias("event_type"), F.lit(None).cast("double").alias("value"), F.lit("").alias("props"))
    ahead.select(*events.columns).write.mode("append").parquet(folder)
    stream = prepare(spark).readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    rows = stream.select(
        F.concat(F.coalesce((F.col("user_id") % 40).cast("string"), F.lit("end")), F.lit(" "), "event_type").alias("key"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("ord"),
        F.concat("props", F.repeat(F.lit("x"), (F.col("event_id") % 7).cast("int"))).alias("description"),
        F.array(F.concat(F.lit("t"), (F.col("event_id") % 3).cast("string"))).alias("tags"),
    )
    use_rocksdb(spark)
    out = scratch_path(spark, "stream-survivors")
    # Nothing expires before the event far ahead: files may arrive in any order.
    kept = keep_richest(rows, "key", "ts", timedelta(days=3650), delay="100 days")
    append_stream(kept, out, scratch_path(spark, "stream-state")).awaitTermination()
    found = spark.read.schema(SURVIVOR_DDL).parquet(out)
    return found.select("key", "ord", "first_ord", "members", F.array_join("tags", ",").alias("tags"))
