"""Readers on small landed files, and the run end to end."""

import json

import pytest
from pyspark.sql import functions as F

from rolefunnel.functions.dates import utc_timestamp
from rolefunnel.operators.rules import settings_from
from rolefunnel.operators.store import BucketTable, set_status
from rolefunnel.plans.catalog import CATALOG
from rolefunnel.plans.funnel import collect_sources, run, update_boards
from rolefunnel.schema import BOARD_DDL, arrival_order, conform
from rolefunnel.sources import feeds, threads
from rolefunnel.sources.board_payloads import board_postings, workable
from rolefunnel.sources.landing import json_item_count, page_report, reached_items, read_landed
from rolefunnel.sources.registry import SOURCES, enabled_sources, expand_boards, link_boards, union_sources


def land(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, body in files.items():
        (folder / name).write_text(body if isinstance(body, str) else json.dumps(body, indent=1))
    return str(folder)


def test_paged_feed_is_read_whole_and_reported(spark, tmp_path):
    def page(items):
        return {"jobs": items}

    def item(n, **over):
        return {"title": f"T{n}", "guid": f"https://h/{n}", "companyName": "", "pubDate": 1784703724, "description": "", "excerpt": "e", **over}

    path = land(tmp_path / "h", page_0=page([item(1), item(2)]), page_1=page([item(2, title="again"), item(3)]),
                page_2=page([item(4)]), page_3=page([item(5), item(6)]))
    landed = read_landed(spark, path)
    rows = feeds.himalayas(landed).orderBy("ord").collect()
    assert [(r["title"], r["company"], r["description"]) for r in rows] == [(f"T{n}", "Unknown", "e") for n in range(1, 7)]
    assert sorted({r["ord"] for r in rows}) == [r["ord"] for r in rows]
    report = page_report(landed.filter("page <> 1"), json_item_count("jobs"), page_size=2).orderBy("page").collect()
    assert [tuple(r) for r in report] == [(0, 2, False, False), (2, 1, True, True), (3, 2, False, False)]


def test_reached_items_keep_every_row(spark):
    pages = [0, 0, 1, 1, 2, 3, 3, -1, None]
    items = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "item bigint, page bigint")
    got = {r["item"]: r["read"] for r in reached_items(items, F.lit(1), page_size=2).collect()}
    assert got == {i: p in (0, 1, 2) for i, p in enumerate(pages)}
    late = reached_items(items.filter("page > 0"), F.lit(1), page_size=2).collect()
    assert len(late) == 5 and not any(r["read"] for r in late)


def test_page_window_lists_every_order(spark, tmp_path):
    orders = [(1, 0), (2, 0), (3, 0), (4, 2), (5, None)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint").write.parquet(str(tmp_path / "orders.parquet"))
    rows = CATALOG["page_window"].run(spark, str(tmp_path)).orderBy("o_orderkey").collect()
    assert [(r["o_orderkey"], r["page"], r["n"], r["short"], r["gap"], r["read"]) for r in rows] == [
        (1, 0, 3, True, False, True), (2, 0, 3, True, False, True), (3, 0, 3, True, False, True), (4, 2, 1, True, True, False),
        (5, None, 1, True, None, False)]


def test_plan_of_expanded_boards_stays_small(spark):
    stories = spark.createDataFrame([("0", "Ask HN: Who is hiring?", "1")], "id string, title string, created_at string")
    texts = ["A | Dev<p>https://jobs.lever.co/a", "B | Dev<p>- R: https://x.example/jobs/1<p>- S: https://x.example/jobs/2"]
    comments = spark.createDataFrame(
        [(i, "0", i, t, "2024-01-01T00:00:00.000Z", False, None) for i, t in enumerate(texts)],
        "id bigint, parent string, pos bigint, text string, created_at string, deleted boolean, dead boolean")
    payloads = spark.createDataFrame([("lever", "a", '[{"id":"x","text":"Role","hostedUrl":"https://l/x"}]')], "platform string, board_slug string, payload string")
    pages = spark.createDataFrame([], "url string, final_url string, html string")
    rows = expand_boards(link_boards(threads.newest_from_rows(stories, comments), pages), payloads, pages)
    # The parsing of comments was held a dozen times over: twenty million characters.
    assert len(rows._jdf.queryExecution().optimizedPlan().treeString()) < 3_000_000
    assert sorted(r["source_id"] for r in rows.collect()) == ["0:lever:x", "1:bullet:0", "1:bullet:1"]


def test_workable_payload_is_parsed_once(spark):
    body = json.dumps({"name": " ACME ", "jobs": [{"title": f"T{i}", "shortcode": f"s{i}", "url": f"https://w/{i}"} for i in range(3)]})
    df = spark.createDataFrame([(body,), ("{broken",), (None,)], "payload string")
    found = df.select(workable(F.col("payload"), F.lit("b")).alias("roles"))
    assert found._jdf.queryExecution().optimizedPlan().treeString().count("from_json") == 1
    assert [[(x["title"], x["company"]) for x in r["roles"] or []] for r in found.collect()] == [[("T0", "ACME"), ("T1", "ACME"), ("T2", "ACME")], [], []]


def test_broken_payload_loses_nothing_else(spark, tmp_path):
    good = [{"legal": 1}, {"id": 1, "slug": "s", "position": "P", "company": "C", "url": "https://r/1", "tags": ["a"]},
            {"id": 2, "slug": "s", "company": "no position"}, None]
    path = land(tmp_path / "r", f_0=good, f_1="{broken", f_2={"jobs": []})
    rows = feeds.remoteok(read_landed(spark, path)).collect()
    assert [(r["source_id"], r["title"], r["application_channel"]) for r in rows] == [("1", "P", "url")]


def test_rss(spark, tmp_path):
    xml = ("<rss><channel><item><title>Acme: Dev: x</title><region></region><country>DE</country><guid>https://w/1</guid>"
           "<pubDate>Sun, 09 Mar 2025 05:06:07 +0000</pubDate><type>Contract</type></item>"
           "<item><title>Solo</title><guid>https://w/2</guid></item></channel></rss>")
    path = land(tmp_path / "w", feed_0=xml, feed_1=xml.replace("Solo", "Later"), feed_2="<rss><chan")
    rows = feeds.weworkremotely(read_landed(spark, path)).orderBy("url").collect()
    assert [(r["company"], r["title"], r["location_text"], r["contract_type_guess"]) for r in rows] == [
        ("Acme", "Dev: x", "DE", "freelance"), ("(company not stated)", "Solo", None, "unclear")]


def test_lever_wrapped_payload_has_no_roles(spark):
    role = {"id": "1", "text": "Role", "hostedUrl": "https://l/1"}
    ctx = ("Co", "c", None, None, "s", 0)
    df = spark.createDataFrame(
        [("lever", "a", json.dumps([role]), *ctx), ("lever", "b", json.dumps({"jobs": [role]}), *ctx), ("nope", "c", "[]", *ctx),
         ("personio", "noslug", "<workzag-jobs><position><id>1</id><name>x</name></position></workzag-jobs>", *ctx)],
        "platform string, board_slug string, payload string, company string, comment_id string, fallback_date timestamp, "
        "original_description string, source string, ord bigint")
    assert [(r["source_id"], r["title"]) for r in board_postings(df).collect()] == [("c:lever:1", "Role")]


def thread_payload():
    kids = [
        {"id": 1, "text": "Acme | Data Engineer | Remote<p>LLM work. Apply https:&#x2F;&#x2F;acme.io&#x2F;jobs", "created_at": "2026-08-09T00:00:00Z"},
        {"id": 2, "text": "Globex | Remote<p>Open roles:<p>- LLM Engineer: https://g.io/1<p>- ML Engineer: https://g.io/2"},
        {"id": 3, "text": "gone", "deleted": True}, {"id": 4, "text": ""},
        {"id": 5, "text": "Willing to relocate: yes<p>Resume/CV: x"},
    ]
    return {"id": "9", "title": "Ask HN: Who is hiring?", "created_at": "2026-08-01", "children": kids}


def test_thread(spark, tmp_path):
    old = {"id": "8", "title": "Ask HN: Who is hiring?", "created_at": "2026-07-01", "children": [{"id": 77, "text": "x"}]}
    other = {"id": "10", "title": "Ask HN: Freelancer? Seeking freelancer?", "created_at": "2026-08-02", "children": []}
    path = land(tmp_path / "t", t_1=thread_payload(), t_2=old, t_3=other)
    rows = threads.thread_postings(threads.threads_from_json(read_landed(spark, path))).orderBy("ord").collect()
    assert [(r["source_id"], r["company"], r["title"], r["url"]) for r in rows] == [
        ("1", "Acme", "Data Engineer", "https://acme.io/jobs"),
        ("2:bullet:0", "Globex", "LLM Engineer", "https://g.io/1"),
        ("2:bullet:1", "Globex", "ML Engineer", "https://g.io/2")]


def test_toggles():
    assert enabled_sources({"remotive": False}) == [n for n in SOURCES if n != "remotive"]


def test_run_twice(spark, tmp_path):
    def feed(body):
        return [{"legal": 1}, {"id": 1, "slug": "a", "position": "Data Engineer", "company": "Acme Inc", "url": "https://www.acme.io/jobs/?x=1",
                               "description": body, "tags": ["z"]},
                {"id": 2, "slug": "b", "position": "Cook", "company": "Soup", "url": "https://soup.io/1", "description": "soup", "tags": []}]

    settings = settings_from({"filters": {"relevance_keywords": ["llm"], "exclude_phrases": ["us only"]},
                              "ranker": {"keyword_groups": {"g": {"weight": 1, "phrases": ["llm"]}}}, "min_score_threshold": 10})
    table = BucketTable.postings(spark, str(tmp_path / "store"))
    for n, body in enumerate(("short", "a much longer text about LLM work than the comment has, really a lot longer")):
        landed = {"remoteok": read_landed(spark, land(tmp_path / f"r{n}", f_0=feed(body))),
                  "hn_whoishiring": threads.threads_from_json(read_landed(spark, land(tmp_path / f"t{n}", t_1=thread_payload())))}
        out = run(spark, union_sources(landed), table, settings, utc_timestamp(f"2026-08-1{n}"))
        # The comment and the feed entry share a URL and become one posting.
        assert tuple(out.counters.first()) == (5, 4)
        if n == 0:
            change = spark.createDataFrame([("https://acme.io/jobs", "applied", 1)], "dedup_key string, status string, ts int")
            table.merge(change, lambda old, new: set_status(old, new)[0])
    stored = {r["dedup_key"]: r for r in out.snapshot.collect()}
    acme = stored["https://acme.io/jobs"]
    assert len(stored) == 4 and acme["status"] == "applied" and acme["first_seen_at"].day == 10 and acme["last_seen_at"].day == 11
    assert acme["company"] == "Acme Inc" and acme["tags"] == ["z"]
    assert {r["bucket"]: r["n"] for r in out.buckets.collect()} == {"eligible": 3, "needs_review": 0, "excluded": 0, "irrelevant": 1}
    assert out.top.count() == 3


def test_collect_polls_expands_and_records_boards(spark, tmp_path):
    thread = {"id": "9", "title": "Ask HN: Who is hiring?", "created_at": "2026-08-01", "children": [
        {"id": 1, "text": "Acme | Many roles<p>https://jobs.lever.co/acme"},
        {"id": 2, "text": "Globex | Dev<p>https://globex.io/careers"},
        {"id": 3, "text": "Quiet | Dev<p>https://quiet.recruitee.com"}]}
    landed = {"hn_whoishiring": threads.threads_from_json(read_landed(spark, land(tmp_path / "t", t_1=thread)))}
    boards = conform(spark.createDataFrame(
        [("ashby", "old", "Old Co", True), ("ashby", "off", None, False), ("lever", "mute", None, True)],
        "platform string, board_slug string, company string, enabled boolean"), BOARD_DDL)
    payloads = spark.createDataFrame([
        ("ashby", "old", json.dumps({"jobs": [{"id": 5, "title": "R", "jobUrl": "https://o/5"}]})),
        ("ashby", "off", json.dumps({"jobs": [{"id": 6, "title": "R", "jobUrl": "https://o/6"}]})),
        ("lever", "acme", json.dumps([{"id": "x", "text": "L", "hostedUrl": "https://l/x"}, {"id": "y", "text": "M", "hostedUrl": "https://l/y"}])),
        ("workable", "globex", json.dumps({"name": "Globex AG", "jobs": [{"title": "W", "shortcode": "s", "url": "https://w/s"}]}))],
        "platform string, board_slug string, payload string")
    pages = spark.createDataFrame(
        [("https://globex.io/careers", "https://globex.io/careers", '<a href="https://apply.workable.com/globex/">jobs</a>'),
         ("https://w/s", "https://w/s", '<meta name="description" content="A &amp; B">')],
        "url string, final_url string, html string")
    got = collect_sources(landed, boards, payloads, pages, settings_from({}), utc_timestamp("2026-08-10"))
    rows = {r["source_id"]: r for r in got.postings.collect()}
    assert set(rows) == {"registry:ashby:old:ashby:5", "1:lever:x", "1:lever:y", "2:workable:s", "3"}
    assert rows["2:workable:s"]["company"] == "Globex AG"
    assert rows["2:workable:s"]["description"].endswith("\n\n---\nRole: W\nA & B")
    assert len({r["ord"] for r in rows.values()}) == 5
    table = {(r["platform"], r["board_slug"]): r for r in update_boards(boards, got, utc_timestamp("2026-08-10")).collect()}
    assert set(table) == {("ashby", "old"), ("ashby", "off"), ("lever", "mute"), ("lever", "acme"), ("workable", "globex"), ("recruitee", "quiet")}
    assert table["ashby", "old"]["last_poll_result_count"] == 1 and table["lever", "mute"]["last_poll_result_count"] == 0
    assert table["ashby", "off"]["last_polled_at"] is None and table["lever", "acme"]["enabled"]


def test_all_landed_pages_are_read(spark, tmp_path):
    pages = {f"page_{n}": {"jobs": [{"title": f"T{n}", "guid": f"https://h/{n}"}] if n != 3 else []} for n in range(20)}
    path = land(tmp_path / "all", **pages)
    assert feeds.himalayas(read_landed(spark, path)).count() == 19
    dated = land(tmp_path / "dated", jobs_20260731235959={"jobs": [{"title": "A", "guid": "https://h/a"}]},
                 other_20260731235959={"jobs": [{"title": "B", "guid": "https://h/b"}]})
    rows = feeds.himalayas(read_landed(spark, dated)).collect()
    assert len({r["ord"] for r in rows}) == 2


def test_board_of_a_hundred_roles(spark):
    roles = [{"id": n, "title": f"R{n}", "absolute_url": f"https://g/{n}"} for n in range(100)]
    df = spark.createDataFrame([("greenhouse", "a", json.dumps({"jobs": roles}), "Co", "c", None, None, "s", 0)],
                               "platform string, board_slug string, payload string, company string, comment_id string, fallback_date timestamp, "
                               "original_description string, source string, ord bigint")
    rows = board_postings(df).collect()
    assert len(rows) == len({r["ord"] for r in rows}) == 100
    assert board_postings(df, cap=40).count() == 40


def test_order_out_of_range_is_an_error(spark):
    df = spark.range(1).select(arrival_order(1, F.lit(1 << 40), F.lit(0)).alias("o"))
    with pytest.raises(Exception, match="out of range"):
        df.collect()


def test_scalar_items_disturb_no_other(spark, tmp_path):
    item = {"id": 1, "slug": "s", "position": "P", "company": "C", "url": "https://r/1", "tags": ["a"]}
    bare = land(tmp_path / "bare", f_0=[{"legal": 1}, 7, item, "text", None, [1]])
    assert [r["source_id"] for r in feeds.remoteok(read_landed(spark, bare)).collect()] == ["1"]
    wrapped = land(tmp_path / "wrapped", f_0={"jobs": [3, {"title": "T", "guid": "https://h/1"}]})
    assert [r["title"] for r in feeds.himalayas(read_landed(spark, wrapped)).collect()] == ["T"]
