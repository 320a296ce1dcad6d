"""Column functions against the standard library and by example."""

import html
from datetime import datetime
from email.utils import parsedate_to_datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rolefunnel.functions import dates, headers, labels, text, urls
from rolefunnel.functions.entities import html_unescape
from rolefunnel.operators.rules import norm_phrase


def apply(spark, values, fn, ddl="x string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {ddl}")
    return [r["y"] for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_unescape_examples(spark):
    values = ["a &amp; b", "&amp;lt; &notit; &notin; &copy &copyx &#8212; &#x2F; &#128; &#0; &#xD800; &#x110000;",
              "&#99999999999999; &#xfffe; &#x1f600; & &; &foo; &#; &#x; &#13; &nbsp;x &NotEqualTilde; x&y=1&lt&gt;",
              "plain", "", None]
    assert apply(spark, values, html_unescape) == [None if v is None else html.unescape(v) for v in values]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="&#;xaAmpltgcoy0189 ", max_size=14), min_size=20, max_size=60))
def test_unescape_random(spark, values):
    assert apply(spark, values, html_unescape) == [html.unescape(v) for v in values]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="aÄßé_-/.,'! \t\n  中9", max_size=20), min_size=20, max_size=60))
def test_normalize_equals_phrase_twin(spark, values):
    assert apply(spark, values, text.normalize_text) == [norm_phrase(v) for v in values]
    joined = apply(spark, values, lambda c: F.array_join(text.tokens(c), " "))
    assert joined == [norm_phrase(v) for v in values]


def test_strip_html(spark):
    values = ["<p>One</p><p class=x>Two</p>", "a&nbsp; b<br/>c<li>d", "&lt;p&gt;x&lt;/p&gt;y", "<script>k</script>", None]
    assert apply(spark, values, text.strip_html) == ["One\nTwo", "a b\nc\nd", "x\ny", "k", ""]


def test_normalize_url(spark):
    values = ["HTTP://WWW.Acme.io/Jobs/?a=1#x", "acme.io/x", " https://acme.io ", "", None, "mailto:a@b.c"]
    assert apply(spark, values, urls.normalize_url) == [
        "https://acme.io/Jobs", "https:///acme.io/x", "https://acme.io", "", "", "https:///a@b.c"]
    kept = apply(spark, ["https://n.io/item?id=3#x", "https://m.io/item?id=3"],
                 lambda c: urls.normalize_url(c, ["n.io"]))
    assert kept == ["https://n.io/item?id=3", "https://m.io/item"]


def test_apply_link_prefers_known_host_then_path_then_cue(spark):
    values = ["Blog https://a.io/blog and https://b.io/careers, or https://jobs.lever.co/x.",
              "Blog https://a.io/blog and https://b.io/careers.", "See https://a.io/post. To apply go https://b.io/z",
              "https://a.io/1 then https://a.io/2", "none"]
    got = apply(spark, values, lambda c: urls.best_apply_url(c, F.array().cast("array<string>")))
    assert got == ["https://jobs.lever.co/x", "https://b.io/careers", "https://b.io/z", "https://a.io/1", None]


def test_dates(spark):
    micros = lambda text: int(datetime.fromisoformat(text).timestamp() * 1_000_000)
    iso = ["2025-03-09T05:06:07Z", "2025-03-09", "2025-03-09 05:06:07.5+02:00", "March", "2025-03", None, ""]
    got = apply(spark, iso, lambda c: F.unix_micros(dates.parse_iso(c)))
    assert got == [micros(iso[0]), micros("2025-03-09T00:00:00+00:00"), micros(iso[2]), None, None, None, None]
    short = ["20250309", "2025-03-09T05Z", "2025-03-09T05:06:07.1234567Z", "20250309T050607+0130", "2025-03-09T05:06-03"]
    want = [micros(v if "T" in v else v + "T00:00:00+00:00") for v in short]
    assert apply(spark, short, lambda c: F.unix_micros(dates.parse_iso(c))) == want
    mail = ["Sun, 09 Mar 2025 05:06:07 +0000", "9 Mar 2025 05:06 -0130", "Tue, 9 Mar 99 5:06:07 GMT"]
    want = [int(parsedate_to_datetime(v).timestamp()) for v in mail]
    assert apply(spark, mail + ["2025-03-09T05:06:07Z"], lambda c: F.unix_seconds(dates.parse_rfc822(c))) == want + [None]
    assert apply(spark, ["1741496767", "x", "1e30"], lambda c: F.unix_seconds(dates.parse_epoch(c))) == [1741496767, None, None]


def test_salary_and_location(spark):
    rows = [("50000", "90000", "USD", "annual"), ("85", "85", "EUR", "hourly"), ("0", None, "USD", ""), ("x", "1", "", "")]
    df = spark.createDataFrame(rows, "a string, b string, c string, p string")
    got = [r[0] for r in df.select(labels.salary_range(*[F.col(x) for x in "abcp"])).collect()]
    assert got == ["$50,000 - $90,000 (annual)", "85 EUR (hourly)", None, None]
    places = [["USA"], ["Remote", "EU"], ["US only"], [" "], None]
    assert apply(spark, places, labels.location_allow_list, "x array<string>") == [
        "USA only", "Remote, EU", "US only", None, None]


def test_contract_labels(spark):
    values = ["B2B contract (six months)", "FULL_TIME", "Freiberuflich", "", None, "Other"]
    assert apply(spark, values, labels.contract_from_label) == [
        "freelance", "employment", "freelance", "unclear", "unclear", "unclear"]


def test_header(spark):
    values = ["Acme | $100k | Remote | Full-time | Data Engineer | x", "Acme | Remote | https://a.io", "just text", "  "]
    got = apply(spark, values, headers.parse_header)
    assert [(r["company"], r["title"]) for r in got] == [
        ("Acme", "Data Engineer"), ("Acme", headers.ROLE_NOT_STATED), ("just text", "just text"),
        (headers.EMPTY_HEADER, headers.EMPTY_HEADER)]


def test_bulleted_title(spark):
    body = "Acme | Remote\nOpen roles:\n- Data Engineer — builds\n- ML Engineer (Berlin)\n\n- Ends with dot.\n- SRE\nOther\n- perk"
    assert apply(spark, [body, "Open now\n- One", "- a\n- b"], headers.bulleted_title) == [
        "Multiple roles: Data Engineer, ML Engineer, SRE", None, None]


def test_role_links(spark):
    body = ("Hi\n- Data Engineer: https://a.io/1...\n- *Acme* - x https://a.io/2\n- VP, ex Apple https://linkedin.com/in/x\n"
            "- SRE (Oslo)\nmore https://a.io/3.\n- No link")
    links = apply(spark, [body], lambda c: headers.role_links(c, F.array(F.lit("https://a.io/"), F.lit("https://a.io/1-full"))))
    assert [(r["name"], r["url"]) for r in links[0]] == [("Data Engineer", "https://a.io/1-full"), ("SRE", "https://a.io/3")]
