"""Keyed merges: all customers stored, all orders and suppliers arriving."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolefunnel.functions.dates import utc_timestamp
from rolefunnel.operators import store as st
from rolefunnel.plans.catalog.base import query, table
from rolefunnel.schema import BOARD_DDL, POSTING_DDL, conform
from rolefunnel.session import scratch_path

THEN, NOW = "2001-08-01T00:00:00Z", "2001-08-02T00:00:00Z"
_STATUS = "CASE c_custkey % 3 WHEN 1 THEN 'applied' ELSE 'new' END"


def _stored(spark, d):
    """All customers, some with a user status."""
    rows, then = table(spark, d, "customer"), utc_timestamp(THEN)
    return conform(
        rows.select(
            F.col("c_name").alias("dedup_key"),
            F.col("c_mktsegment").alias("title"),
            F.lit("stored").alias("source"),
            F.col("c_nationkey").alias("score"),
            F.lit("old note").alias("salary_text"),
            F.when(F.col("c_custkey") % 3 == 1, "applied").otherwise("new").alias("status"),
            then.alias("first_seen_at"),
            then.alias("last_seen_at"),
        ),
        POSTING_DDL,
    )


def _customer_name():
    return F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))


def _incoming(spark, d):
    """Every order as new content of its customer, the last one counts; every supplier as a key not seen before."""
    orders = table(spark, d, "orders").select(
        _customer_name().alias("dedup_key"),
        F.col("o_orderpriority").alias("title"),
        F.lit("order").alias("source"),
        F.col("o_orderkey").cast("int").alias("score"),
        F.col("o_orderkey").alias("ord"),
    )
    suppliers = table(spark, d, "supplier").select(
        F.col("s_name").alias("dedup_key"), F.lit("supplier").alias("title"), F.lit("list").alias("source"),
        F.col("s_nationkey").cast("int").alias("score"), F.col("s_suppkey").alias("ord"),
    )
    return orders.unionByName(suppliers)


_SQL_UPSERT = f"""WITH i AS (SELECT 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') AS dedup_key, arg_max(o_orderpriority, o_orderkey) AS title,
      'order' AS source, max(o_orderkey) AS score FROM orders GROUP BY o_custkey
    UNION ALL SELECT s_name, 'supplier', 'list', s_nationkey FROM supplier)
    SELECT coalesce(i.dedup_key, c_name) AS dedup_key,
      CASE WHEN i.dedup_key IS NOT NULL THEN i.title ELSE c_mktsegment END AS title,
      CASE WHEN i.dedup_key IS NOT NULL THEN i.source ELSE 'stored' END AS source,
      CASE WHEN i.dedup_key IS NOT NULL THEN i.score ELSE c_nationkey END AS score,
      CASE WHEN i.dedup_key IS NULL THEN 'old note' END AS salary_text,
      CASE WHEN c_custkey IS NOT NULL THEN {_STATUS} ELSE 'new' END AS status,
      epoch_us(CASE WHEN c_custkey IS NOT NULL THEN TIMESTAMP '2001-08-01' ELSE TIMESTAMP '2001-08-02' END) AS first_seen,
      epoch_us(CASE WHEN i.dedup_key IS NOT NULL THEN TIMESTAMP '2001-08-02' ELSE TIMESTAMP '2001-08-01' END) AS last_seen
    FROM customer FULL JOIN i ON i.dedup_key = c_name"""


def _upserted(merged):
    return merged.select(
        "dedup_key", "title", "source", "score", "salary_text", "status",
        F.unix_micros("first_seen_at").alias("first_seen"), F.unix_micros("last_seen_at").alias("last_seen"),
    )


@query("upsert_postings", _SQL_UPSERT)
def _(spark, d):
    return _upserted(st.merge_postings(_stored(spark, d), _incoming(spark, d), utc_timestamp(NOW)))


@query("bucket_upsert", _SQL_UPSERT)
def _(spark, d):
    """The same through the bucketed table: a first load, then orders and suppliers as two batches."""
    kept = st.BucketTable.postings(spark, scratch_path(spark, "bucket-upsert"), buckets=8)
    kept.replace(_stored(spark, d))
    rows = _incoming(spark, d)
    for part in (rows.filter("source = 'order'"), rows.filter("source = 'list'")):
        kept.merge(part, lambda old, new: st.merge_postings(old, new, utc_timestamp(NOW)))
    return _upserted(kept.read())


def _status_changes(spark, d):
    """Orders as status changes of their customer, some values no status; suppliers as keys that are not stored."""
    word = F.when(F.col("o_orderstatus") == "F", "rejected").when(F.col("o_orderstatus") == "O", "interview")
    orders = table(spark, d, "orders").withColumn("status", word.otherwise("archived"))
    unknown = table(spark, d, "supplier").select(F.col("s_name").alias("dedup_key"), F.lit("applied").alias("status"), F.col("s_suppkey").alias("ts"))
    return orders.select(_customer_name().alias("dedup_key"), "status", F.col("o_orderkey").alias("ts")).unionByName(unknown)


_SQL_CHANGES = """ch AS (SELECT 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') AS dedup_key, o_orderkey AS ts,
   CASE o_orderstatus WHEN 'F' THEN 'rejected' WHEN 'O' THEN 'interview' ELSE 'archived' END AS status FROM orders
   UNION ALL SELECT s_name, s_suppkey, 'applied' FROM supplier)"""


@query(
    "set_status",
    f"""WITH {_SQL_CHANGES}, l AS (SELECT dedup_key, arg_max(status, ts) AS s FROM ch WHERE status <> 'archived' GROUP BY 1)
    SELECT c_name AS dedup_key, coalesce(s, {_STATUS}) AS status FROM customer LEFT JOIN l ON l.dedup_key = c_name""",
)
def _(spark, d):
    return st.set_status(_stored(spark, d), _status_changes(spark, d))[0].select("dedup_key", "status")


@query(
    "status_unknown_keys",
    f"""WITH {_SQL_CHANGES} SELECT dedup_key, ts, 'unknown status' AS error FROM ch WHERE status = 'archived'
    UNION ALL SELECT dedup_key, ts, 'unknown key' FROM ch WHERE status <> 'archived'
      AND dedup_key NOT IN (SELECT c_name FROM customer)""",
)
def _(spark, d):
    rejected = st.set_status(_stored(spark, d), _status_changes(spark, d))[1]
    return rejected.select("dedup_key", "ts", "error")


# --- boards: segments as platforms, names as slugs ------------------------------------


def _boards(spark, d):
    then = utc_timestamp(THEN)
    rows = table(spark, d, "customer")
    return conform(
        rows.select(
            F.lower("c_mktsegment").alias("platform"),
            F.col("c_name").alias("board_slug"),
            F.lit("Old Co").alias("company"),
            F.lit("list").alias("discovered_via"),
            (F.col("c_custkey") % 5 != 0).alias("enabled"),
            then.alias("first_seen_at"),
            then.alias("last_seen_at"),
            F.col("c_nationkey").alias("last_poll_result_count"),
        ),
        BOARD_DDL,
    )


_SQL_BOARDS = "bo AS (SELECT lower(c_mktsegment) AS platform, c_name AS board_slug, * FROM customer)"


def _found_boards(spark, d):
    """Every order finds the board of its customer again, every supplier a new one."""
    customers = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_name")
    orders = table(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.lower("c_mktsegment").alias("platform"),
        F.col("c_name").alias("board_slug"),
        F.col("o_orderpriority").alias("company"),
        F.lit("thread").alias("discovered_via"),
        F.col("o_orderkey").alias("ord"),
    )
    suppliers = table(spark, d, "supplier").select(
        F.lit("list").alias("platform"), F.col("s_name").alias("board_slug"), F.lit("Supplier").alias("company"),
        F.lit("list").alias("discovered_via"), F.col("s_suppkey").alias("ord"),
    )
    return orders.unionByName(suppliers).withColumn("discovered_url", F.lit("https://x.example.org"))


@query(
    "upsert_boards",
    """WITH i AS (SELECT lower(c_mktsegment) AS platform, c_name AS board_slug, arg_max(o_orderpriority, o_orderkey) AS company, 'thread' AS via
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL
      UNION ALL SELECT 'list', s_name, 'Supplier', 'list' FROM supplier)
    SELECT coalesce(i.platform, lower(c_mktsegment)) AS platform, coalesce(i.board_slug, c_name) AS board_slug,
      coalesce(i.company, 'Old Co') AS company, coalesce(i.via, 'list') AS via,
      CASE WHEN c_custkey IS NOT NULL THEN c_custkey % 5 <> 0 ELSE true END AS enabled,
      c_nationkey AS polled,
      epoch_us(CASE WHEN c_custkey IS NOT NULL THEN TIMESTAMP '2001-08-01' ELSE TIMESTAMP '2001-08-02' END) AS first_seen
    FROM customer FULL JOIN i ON i.platform = lower(c_mktsegment) AND i.board_slug = c_name""",
)
def _(spark, d):
    boards = st.BucketTable.boards(spark, scratch_path(spark, "bucket-boards"), buckets=4)
    boards.replace(_boards(spark, d))
    boards.merge(_found_boards(spark, d), lambda old, new: st.merge_boards(old, new, utc_timestamp(NOW)))
    return boards.read().select(
        "platform", "board_slug", "company", F.col("discovered_via").alias("via"), "enabled",
        F.col("last_poll_result_count").alias("polled"), F.unix_micros("first_seen_at").alias("first_seen"),
    )


def _counts(spark, d):
    orders = table(spark, d, "orders").join(
        table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    return orders.groupBy(F.lower("c_mktsegment").alias("platform"), F.col("c_name").alias("board_slug")).agg(
        F.count("*").alias("n")
    )


@query(
    "record_poll",
    f"""WITH {_SQL_BOARDS}, n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
    SELECT platform, board_slug, coalesce(n, c_nationkey) AS polled, n IS NOT NULL AS was_polled
    FROM bo LEFT JOIN n ON o_custkey = c_custkey""",
)
def _(spark, d):
    polled = st.record_polls(_boards(spark, d), _counts(spark, d), utc_timestamp(NOW))
    return polled.select(
        "platform", "board_slug", F.col("last_poll_result_count").alias("polled"),
        F.col("last_polled_at").isNotNull().alias("was_polled"),
    )


@query(
    "set_enabled",
    f"""WITH {_SQL_BOARDS}, l AS (SELECT o_custkey, arg_max(o_orderstatus = 'F', o_orderkey) AS e FROM orders GROUP BY 1)
    SELECT platform, board_slug, coalesce(e, c_custkey % 5 <> 0) AS enabled FROM bo LEFT JOIN l ON o_custkey = c_custkey""",
)
def _(spark, d):
    changes = (
        table(spark, d, "orders")
        .join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.lower("c_mktsegment").alias("platform"),
            F.col("c_name").alias("board_slug"),
            (F.col("o_orderstatus") == "F").alias("enabled"),
            F.col("o_orderkey").alias("ts"),
        )
    )
    return st.set_enabled(_boards(spark, d), changes).select("platform", "board_slug", "enabled")


@query(
    "board_scan",
    f"""WITH {_SQL_BOARDS} SELECT platform, board_slug,
        row_number() OVER (ORDER BY platform, board_slug) AS place FROM bo WHERE c_custkey % 5 <> 0""",
)
def _(spark, d):
    from rolefunnel.plans.catalog.base import with_place

    enabled = st.known_boards(_boards(spark, d)).select("platform", "board_slug")
    return with_place(st.ordered(enabled, "platform, board_slug"))


@query(
    "record_scan",
    """SELECT 'user ' || user_id AS source_name, epoch_us(max(ts)) AS last_scan FROM events GROUP BY 1""",
)
def _(spark, d):
    events = table(spark, d, "events").select(
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("source_name"),
        F.col("ts").cast("timestamp").alias("last_scanned_at"),
        "event_id",
    )
    stored = events.filter(F.col("event_id") % 3 != 0).groupBy("source_name").agg(
        F.max("last_scanned_at").alias("last_scanned_at")
    )
    done = events.filter(F.col("event_id") % 3 == 0)
    return st.record_scans(stored, done).select("source_name", F.unix_micros("last_scanned_at").alias("last_scan"))
