"""Keyed merges and the bucketed table."""

import pytest
from pyspark.sql import functions as F

from rolefunnel.functions.dates import utc_timestamp
from rolefunnel.operators import store as st
from rolefunnel.schema import POSTING_DDL, conform


def incoming(spark, *rows):
    df = spark.createDataFrame(list(rows), "dedup_key string, title string, score int, ord bigint")
    return conform(df, POSTING_DDL + ", ord bigint")


def upsert(day):
    return lambda old, new: st.merge_postings(old, new, utc_timestamp(day))


def test_upsert_keeps_status_and_first_seen(spark, tmp_path):
    table = st.BucketTable.postings(spark, str(tmp_path / "t"), buckets=4)
    table.merge(incoming(spark, ("a", "old", 1, 0), ("b", "b", 2, 1)), upsert("2026-01-01"))
    changes = spark.createDataFrame([("a", "applied", 1), ("a", "nonsense", 2), ("z", "new", 1)], "dedup_key string, status string, ts int")
    rejected = st.set_status(table.read(), changes)[1]
    assert {(r["dedup_key"], r["error"]) for r in rejected.collect()} == {("a", "unknown status"), ("z", "unknown key")}
    table.merge(changes, lambda old, new: st.set_status(old, new)[0])
    again = incoming(spark, ("a", "new", None, 5), ("a", "newest", 9, 6), ("c", "c", 3, 7))
    for _ in range(2):  # a replay changes nothing
        table.merge(again, upsert("2026-02-01"))
        got = {r["dedup_key"]: r for r in table.read().collect()}
        assert set(got) == {"a", "b", "c"} and table.read().count() == 3
        a = got["a"]
        assert (a["title"], a["score"], a["status"]) == ("newest", 9, "applied")
        assert (a["first_seen_at"].month, a["last_seen_at"].month) == (1, 2)
        assert got["b"]["last_seen_at"].month == 1 and got["c"]["status"] == "new"


def files_of(path):
    return {f.relative_to(path): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_a_batch_rewrites_its_buckets_only(spark, tmp_path):
    path = tmp_path / "b"
    table = st.BucketTable.postings(spark, str(path), buckets=32)
    rows = spark.range(4000).select(F.concat(F.lit("key "), F.col("id").cast("string")).alias("dedup_key"), F.lit("t").alias("title"), F.col("id").cast("int").alias("score"), F.col("id").alias("ord"))
    assert table.merge(rows, upsert("2026-01-01")) == list(range(32))
    before = files_of(path)
    assert len(before) == 32
    batch = incoming(spark, *[(f"key {k}", "changed", k, k) for k in range(0, 100, 10)])
    touched = table.merge(batch, upsert("2026-01-02"))
    after = files_of(path)
    same = {f for f in before if after.get(f) == before[f]}
    assert 1 <= len(touched) <= 10 and len(after) == 32
    assert {int(f.parent.name.split("=")[1]) for f in same} == set(range(32)) - set(touched)
    assert table.read().count() == 4000 and table.read().filter("title = 'changed'").count() == 10
    assert table.merge(batch.limit(0), upsert("2026-01-03")) == [] and files_of(path) == after


def test_a_lookup_reads_one_bucket(spark, tmp_path):
    table = st.BucketTable.boards(spark, str(tmp_path / "l"), buckets=8)
    rows = spark.range(200).select(F.lit("lever").alias("platform"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("board_slug"), F.lit("c").alias("company"))
    table.replace(conform(rows, table.ddl))
    found = table.lookup("lever", "s17")
    assert [r["board_slug"] for r in found.collect()] == ["s17"] and table.lookup("lever", "none").count() == 0
    # Every folder but one is pruned before anything is opened.
    plan = found._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().apply(0)
    assert scan.metrics().get("numFiles").get().value() == 1
    assert "PartitionFilters" in plan.toString() and "EqualTo(board_slug,s17)" in plan.toString()


def test_another_number_of_buckets_is_an_error(spark, tmp_path):
    rows = spark.createDataFrame([("x",)], "source_name string")
    table = st.BucketTable.scans(spark, str(tmp_path / "n"))
    assert table.read().count() == 0
    table.replace(rows)
    with pytest.raises(Exception, match="another number of buckets"):
        st.BucketTable.scans(spark, str(tmp_path / "n"), buckets=2).read().collect()


def test_order_by_is_an_allow_list(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "a int, score int")
    assert [r["a"] for r in st.ordered(df, "score DESC, a").collect()] == [2, 1]
    for bad in ("score; drop", "nope", "score desc nulls", ""):
        with pytest.raises(ValueError):
            st.ordered(df, bad)


def test_one_row_for_a_repeated_arrival(spark):
    rows = incoming(spark, ("a", "one", 1, 3), ("a", "two", 2, 3), ("b", "b", 1, 1))
    assert sorted(r["dedup_key"] for r in st.last_arrivals(rows, ["dedup_key"]).collect()) == ["a", "b"]
