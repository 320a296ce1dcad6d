"""Quarantine of landed JSON, counters observed on the way, due lists only, flat threads, limits."""

import json

import pytest
from pyspark.sql import functions as F

from rolefunnel.functions import headers as h
from rolefunnel.functions.dates import utc_timestamp
from rolefunnel.operators.report import write_counted
from rolefunnel.operators.rules import Rules, Settings, settings_from
from rolefunnel.plans.funnel import seed_from_lists
from rolefunnel.schema import BOARD_DDL
from rolefunnel.sources import threads as th
from rolefunnel.sources.quarantine import split_feed, split_items


def landed(spark, *payloads):
    return spark.createDataFrame(list(enumerate(payloads)), "page bigint, payload string")


def test_one_bad_item_costs_no_other(spark):
    good = {"id": 1, "title": "T", "company_name": "C", "url": "u", "tags": ["a"], "salary": 7}
    jobs = [good, 3, "x", None, [1], {"title": "T", "url": "u"}, {**good, "tags": "no array"}, {**good, "title": {"x": 1}}, {**good, "title": None}]
    rows, bad = split_feed(landed(spark, json.dumps({"jobs": jobs}), json.dumps({"jobs": []}), "{broken", "", None, "[1]", '{"jobs": 5}', '{"jobs": null}'), "remotive")
    kept = rows.collect()
    assert [(r.page, r.pos, r.id, r.title, r.tags, r.salary) for r in kept] == [(0, 0, "1", "T", ["a"], "7")]
    got = {(r.page, r.pos): r.reason for r in bad.collect()}
    assert got == {
        (0, 1): "item is no object", (0, 2): "item is no object", (0, 3): "item is no object", (0, 4): "item is no object",
        (0, 5): "field company_name is missing", (0, 6): "field tags is no array<string>", (0, 7): "field title is no string", (0, 8): "field title is missing",
        (2, None): "payload is no JSON", (3, None): "payload is empty", (4, None): "payload is empty", (5, None): "payload has no array jobs",
        (6, None): "payload has no array jobs", (7, None): "payload has no array jobs",
    }
    raw = {(r.page, r.pos): r.raw for r in bad.collect()}
    assert raw[2, None] == "{broken" and json.loads(raw[0, 6])["tags"] == "no array" and raw[4, None] is None


def test_bare_array_and_other_types(spark):
    rows, bad = split_items(landed(spark, '[{"legal": 1}, {"n": 4, "ok": true}, {"n": "five"}, {"ok": "yes"}]', '{"n": 1}'), "n int, ok boolean", None, ("n",), skip_first=True)
    assert [(r.pos, r.n, r.ok) for r in rows.collect()] == [(1, 4, True)]
    assert {(r.page, r.pos): r.reason for r in bad.collect()} == {(0, 2): "field n is no int", (0, 3): "field n is missing", (1, None): "payload is no array"}


def test_counts_come_from_the_writing_tasks(spark, tmp_path):
    marks = str(tmp_path / "marks")

    def touch(frames):
        import os
        import uuid

        os.makedirs(marks, exist_ok=True)
        open(f"{marks}/{uuid.uuid4().hex}", "w").close()
        yield from frames

    rows = spark.createDataFrame([(k, f"s{k % 3}") for k in range(100)], "n int, source string").repartition(5).mapInPandas(touch, "n int, source string")
    table, counts = write_counted(rows, str(tmp_path / "out"), ["s0", "s1", "none"])
    assert counts == {"rows": 100, "s0": 34, "s1": 33, "none": 0} and table.count() == 100
    assert len(list((tmp_path / "marks").iterdir())) == 5  # one pass: every partition once


def test_only_due_lists_are_read(spark, tmp_path):
    path = str(tmp_path / "lists")
    rows = [(f"s{k}", n, f"- https://jobs.lever.co/b{k}-{n}") for k in range(10) for n in range(3)]
    spark.createDataFrame(rows, "source_name string, part bigint, text string").write.partitionBy("source_name").parquet(path)
    lists = spark.read.schema("part bigint, text string, source_name string").parquet(path)
    sources = spark.createDataFrame([(f"s{k}",) for k in range(10)], "source_name string")
    scans = spark.createDataFrame([(f"s{k}", f"2026-01-{k + 1:02d}") for k in range(8)], "source_name string, d string").select("source_name", F.to_timestamp("d").alias("last_scanned_at"))
    pages = spark.createDataFrame([], "url string, final_url string, html string")
    settings = Settings(Rules(), {}, scan_interval_days=7)
    out = seed_from_lists(sources, lists, spark.createDataFrame([], BOARD_DDL), scans, pages, settings, utc_timestamp("2026-01-10"))
    due = {"s0", "s1", "s2", "s8", "s9"}
    assert {r.source_name for r in out.due.collect()} == due
    assert {r.board_slug for r in out.boards.collect()} == {f"b{k[1]}-{n}" for k in due for n in range(3)}
    assert {r.source_name: r.last_scanned_at.day for r in out.scans.collect()} == {f"s{k}": 10 if f"s{k}" in due else k + 1 for k in range(10)}
    # The lists that are not due are not opened.
    for name in {f"s{k}" for k in range(10)} - due:
        for file in (tmp_path / "lists" / f"source_name={name}").glob("*.parquet"):
            file.write_bytes(b"not to be read")
    again = seed_from_lists(sources, lists, spark.createDataFrame([], BOARD_DDL), scans, pages, settings, utc_timestamp("2026-01-10"))
    assert again.boards.count() == 15


def test_interval_comes_from_the_configuration():
    assert settings_from({"github_lists": {"scan_interval_days": 3}}).scan_interval_days == 3 and settings_from({}).scan_interval_days == 7


def test_comments_of_one_thread_are_spread(spark):
    stories = spark.createDataFrame([("1", "Ask HN: Who is hiring? (May)", "a"), ("2", "Ask HN: Who is hiring? (June)", "b")], "id string, title string, created_at string")
    rows = [(k, "2" if k % 7 else str(k - 1), k, f"Co {k} | Dev {k}", "2024-01-01T00:00:00Z", False, False) for k in range(10, 400)] + [(9, "1", 0, "Old | Dev", None, None, None)]
    comments = spark.createDataFrame(rows, "id bigint, parent string, pos int, text string, created_at string, deleted boolean, dead boolean").repartition(6)
    got = th.newest_from_rows(stories, comments)
    assert sorted(r.company for r in got.collect()) == sorted(f"Co {k}" for k in range(10, 400) if k % 7)
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() == 6


@pytest.mark.parametrize("limits", [h.ALL, h.SHORT])
def test_limits_of_headers(spark, limits):
    long, words = "N" * 150, "w " * 20 + "end"
    rows = [(f"{long} | {long} role",), ("x" * 100,), (f"Co | ok\nOpen roles:\n- {'R' * 90}: a\n- {words}: b\n- short: c\n- d\n- e\n- f\n- g\n- h",)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(h.parse_header(h.first_line(F.col("t")), limits=limits).alias("p"), h.bulleted_title(F.col("t"), limits=limits).alias("b")).collect()
    short = limits is h.SHORT
    assert (len(got[0].p.company), len(got[0].p.title)) == ((120, 120) if short else (150, 155))
    assert len(got[1].p.title) == (80 if short else 100)
    assert got[2].b == ("Multiple roles: short, d, e, f, g (+1 more)" if short else f"Multiple roles: {'R' * 90}, {words}, short, d, e, f, g, h")
