"""Selections per key, unions, toggles, counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolefunnel.functions.text import normalize_text
from rolefunnel.operators import report as rp
from rolefunnel.operators import windows as w
from rolefunnel.operators.store import lookup
from rolefunnel.plans.catalog.base import query, sql_norm, table, title_of
from rolefunnel.session import scratch_path
from rolefunnel.sources.registry import filter_enabled


@query(
    "first_wins",
    """SELECT user_id, event_id, event_type FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1""",
)
def _(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return w.first_wins(events, ["user_id"], F.col("event_id"))


@query(
    "cap_per_group",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) <= 2""",
)
def _(spark, d):
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return w.cap_per_group(lines, ["l_orderkey"], order, 2).drop("l_suppkey", "l_extendedprice")


@query(
    "latest_per_group",
    """SELECT o_custkey, o_orderkey FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def _(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    newest = w.latest(orders, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    return newest.drop("o_orderdate")


def _three_sources(spark, d):
    docs = table(spark, d, "documents").select(
        F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "source", title_of().alias("title")
    )
    pages = table(spark, d, "pages").select(
        F.lit("pages").alias("origin"), F.col("page_id").alias("id"), F.col("url").alias("title")
    )
    talks = table(spark, d, "conversations").select(
        F.lit("conversations").alias("origin"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.col("role").alias("source"),
        title_of().alias("title"),
    )
    return docs.unionByName(pages, allowMissingColumns=True).unionByName(talks, allowMissingColumns=True)


_SQL_THREE = """
  SELECT 'documents' AS origin, doc_id AS id, source, split_part(text, chr(10), 1) AS title FROM documents
  UNION ALL SELECT 'pages', page_id, NULL, url FROM pages
  UNION ALL SELECT 'conversations', conv_id * 1000 + turn, role, split_part(text, chr(10), 1) FROM conversations"""


@query("union_sources", _SQL_THREE)
def _(spark, d):
    return _three_sources(spark, d)


@query(
    "source_toggle",
    "SELECT doc_id, source FROM documents WHERE source NOT IN ('src0', 'src7')",
)
def _(spark, d):
    toggles = spark.createDataFrame(
        [("src0", False), ("src7", False), ("src1", True)], "source string, enabled boolean"
    )
    return filter_enabled(table(spark, d, "documents").select("doc_id", "source"), toggles).select("doc_id", "source")


@query("source_counts", f"SELECT coalesce(source, origin) AS source, count(*) AS n FROM ({_SQL_THREE}) GROUP BY 1")
def _(spark, d):
    return rp.source_counts(_three_sources(spark, d).withColumn("source", F.coalesce("source", "origin")))


@query(
    "run_counters",
    f"SELECT count(*) AS fetched, count(DISTINCT {sql_norm('text')}) AS unique_rows FROM documents",
)
def _(spark, d):
    docs = table(spark, d, "documents")
    unique = docs.select(F.sha2(normalize_text(F.col("text")), 256).alias("h")).distinct()
    return rp.run_counters(docs, unique)


@query(
    "counters_observed",
    f"SELECT 'fetched' AS counter, count(*) AS n FROM documents UNION ALL SELECT 'unique', count(DISTINCT {sql_norm('text')}) FROM documents "
    "UNION ALL SELECT s.source, (SELECT count(*) FROM documents d WHERE d.source = s.source) FROM (SELECT DISTINCT source FROM documents) s",
)
def _(spark, d):
    """The counters of a run, of all rows and by source, taken while its tables are written."""
    docs = table(spark, d, "documents")
    names = [r["source"] for r in docs.select("source").distinct().collect()]
    content, fetched = rp.write_counted(docs, scratch_path(spark, "observed-content"), names)
    unique = content.select(F.sha2(normalize_text(F.col("text")), 256).alias("h")).distinct()
    left = rp.write_counted(unique, scratch_path(spark, "observed-unique"))[1]
    rows = [("fetched", fetched.pop("rows")), ("unique", left["rows"]), *fetched.items()]
    return spark.createDataFrame(rows, "counter string, n bigint")


@query("distinct_urls", "SELECT DISTINCT regexp_extract(url, '^https?://[^/]+') AS site FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select(F.regexp_extract("url", "^https?://[^/]+", 0).alias("site")).distinct()


@query("point_lookup", "SELECT c_name AS dedup_key, c_acctbal FROM customer WHERE c_name = 'Customer#000000042'")
def _(spark, d):
    stored = table(spark, d, "customer").select(F.col("c_name").alias("dedup_key"), "c_acctbal")
    return lookup(stored, "Customer#000000042")
