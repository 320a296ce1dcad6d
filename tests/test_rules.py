"""Classification and scoring by example."""

import pytest
from pyspark.sql import functions as F

from rolefunnel.functions.dates import utc_timestamp
from rolefunnel.operators.classify import classify, drop_disclosures
from rolefunnel.operators.rules import DISCLOSURE_WORDS, KeywordGroup, Rules, rule_table, settings_from
from rolefunnel.operators.scoring import score

RULES = Rules(
    exclude=("us only", "no visa sponsorship", "security clearance"),
    hybrid_onsite=("hybrid", "on-site"),
    remote_indicator=("remote", "work from home"),
    needs_review=("eu only", "emea"),
    positive=("worldwide", "async", "contractor"),
    relevance=("llm", "machine learning", "artificial intelligence"),
    relevance_weak=("ai", "ml"),
    non_role_title=("sales", "account executive"),
    keyword_groups=(KeywordGroup("llm", 3.0, ("llm", "rag")), KeywordGroup("py", 1.0, ("python",))),
    role_targets=("AI Engineer",),
    core_skills=("Python", "RAG", "Docker"),
)
AS_OF = "2026-08-10"
DDL = "title string, description string, location_text string, posted_date timestamp, contract_type_guess string"


def postings(spark, *rows):
    full = [(i, r[0], r[1], r[2] if len(r) > 2 else None, None, "unclear") for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "i int, " + DDL)


@pytest.mark.parametrize("body, place, bucket, reason", [
    ("US-only role, EMEA", None, "excluded", "excluded: matched ['us only']"),
    ("EMEA or U.S. only", None, "excluded", "excluded: matched ['us only']"),
    ("no security clearance needed", None, "eligible", None),
    ("not a security clearance job; later a security clearance", None, "excluded", "excluded: matched ['security clearance']"),
    ("there is no visa sponsorship", None, "excluded", "excluded: matched ['no visa sponsorship']"),
    ("hybrid in Berlin", None, "excluded", "excluded: matched ['hybrid'] with no remote indicator present"),
    ("hybrid or remote", None, "eligible", None),
    ("any", "EU only", "needs_review", "needs_review: matched ['eu only']"),
    ("plain", None, "eligible", None),
    ("focus only on this", None, "eligible", None),
])
def test_eligibility(spark, body, place, bucket, reason):
    row = classify(postings(spark, ("Role", body, place)), RULES).first()
    assert (row["eligibility_bucket"], row["eligibility_reason"]) == (bucket, reason)


@pytest.mark.parametrize("title, body, relevant", [
    ("Account Executive", "sell our LLM", False),
    ("Engineer", "works on LLM things", True),
    ("Engineer", "our AI product", False),
    ("AI Engineer", "nothing else", True),
    ("HTML dev", "chain of html", False),
    ("Guard", "We use Artificial Intelligence to screen each applicant. Be strong.", False),
    ("Guard", "We use Artificial Intelligence. We screen each applicant.", True),
])
def test_relevance(spark, title, body, relevant):
    assert classify(postings(spark, (title, body)), RULES).first()["is_relevant"] is relevant


def test_disclosure_keeps_unfinished_sentence(spark):
    df = spark.createDataFrame([("A. AI to review your application. B",), ("AI to review your application",)], "t string")
    got = [r[0] for r in df.select(drop_disclosures(F.col("t"), DISCLOSURE_WORDS)).collect()]
    assert got == ["A.  B", "AI to review your application"]


def scored(spark, *rows):
    return score(classify(postings(spark, *rows), RULES, keep_hits=True), RULES, utc_timestamp(AS_OF)).orderBy("i").collect()


def test_scores(spark):
    strong, review, out, off = scored(
        spark,
        ("AI Engineer", "LLM and Python, worldwide, contractor"),
        ("AI thing", "EMEA"),
        ("AI Engineer", "LLM, US only"),
        ("Cook", "soup"),
    )
    # 40 (both groups) + 15 (title) + 4 (two positives) of 80.
    assert strong["score"] == 74 and strong["skill_match"] == 33 and strong["contract_type_guess"] == "freelance"
    assert strong["reasons"] == [
        "keyword group 'llm' matched (weight 3.0): ['llm']", "keyword group 'py' matched (weight 1.0): ['python']",
        "title matches role target(s): ['AI Engineer']", "positive signals: ['worldwide', 'contractor']",
        "skill match: ['Python']"]
    assert review["score"] == 1 and review["eligibility_confidence"] == 60 and len(review["red_flags"]) == 2
    assert out["score"] == 0 and out["reasons"] == ["not ranked: excluded (excluded: matched ['us only'])"]
    assert off["score"] == 0 and off["reasons"] == ["not ranked: irrelevant to profile"]


def test_settings(spark):
    made = settings_from({"filters": {"exclude_phrases": ["a"]}, "sources": {"x": False}}, {"core_skills": ["Git"]})
    assert made.rules.exclude == ("a",) and made.ranking_mode == "heuristic" and made.min_score_threshold == 30
    assert rule_table(spark, made.rules).count() == 2
    with pytest.raises(ValueError):
        settings_from({"ranking_mode": "magic"})
