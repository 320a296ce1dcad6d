"""The weighted, explainable score and its parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefunnel.functions.dates import age_days
from rolefunnel.functions.labels import bucket_confidence
from rolefunnel.functions.text import clamp
from rolefunnel.operators.barrier import spread_once
from rolefunnel.operators.classify import HIT_COLUMNS, RELEVANCE_HITS, TITLE_HITS
from rolefunnel.operators.phrases import any_match, matched, quoted_list
from rolefunnel.operators.rules import Rules

KEYWORD_POINTS = 40.0
SCORE_FIELDS = [
    "score",
    "skill_match",
    "eligibility_confidence",
    "contract_type_guess",
    "reasons",
    "red_flags",
    "ranking_source",
    "seniority_fit",
]


def keyword_group_points(hits: Column, rules: Rules) -> Column:
    """Weight of the groups with a hit over the weight of all groups, times 40."""
    if not rules.keyword_groups:
        return F.lit(0.0)
    total = sum(g.weight for g in rules.keyword_groups) or 1.0
    gained = F.lit(0.0)
    for group in rules.keyword_groups:
        gained = gained + F.when(any_match(hits, group.phrases), group.weight).otherwise(0.0)
    return gained / F.lit(total) * F.lit(KEYWORD_POINTS)


def title_bonus(title_hits: Column, rules: Rules) -> Column:
    return F.when(any_match(title_hits, rules.role_targets), float(rules.title_match_bonus)).otherwise(0.0)


def positive_bonus(hits: Column, rules: Rules) -> Column:
    """Two points per positive phrase, up to the cap."""
    count = F.size(matched(hits, rules.positive))
    return F.least(F.lit(float(rules.positive_signal_bonus_cap)), F.lit(2.0) * count)


def recency_bonus(age: Column, maximum: int) -> Column:
    """Full within 3 days, half within 7, a fifth within 14, else nothing."""
    return (
        F.when(age <= 3, maximum * 1.0)
        .when(age <= 7, maximum * 0.5)
        .when(age <= 14, maximum * 0.2)
        .otherwise(0.0)
    )


def skill_match(hits: Column, rules: Rules) -> Column:
    """Share of the core skills found, as a half-even rounded percentage."""
    if not rules.core_skills:
        return F.lit(0)
    share = F.lit(100.0) * F.size(matched(hits, rules.core_skills)) / F.lit(len(rules.core_skills))
    return clamp(F.bround(share).cast("int"))


def contract_guess(hits: Column, rules: Rules) -> Column:
    """First contract list with a hit in the prose."""
    guess = F.lit("unclear")
    for name, phrases in reversed(rules.contract.items()):
        guess = F.when(any_match(hits, phrases), name).otherwise(guess)
    return guess


def resolve_contract(stated: Column, guess: Column) -> Column:
    """What the source states wins unless it says nothing."""
    return F.when(F.coalesce(stated, F.lit("unclear")) != "unclear", stated).otherwise(guess)


def heuristic_score(points: Column, bucket: Column, rules: Rules) -> Column:
    """Points to 0-100; a row under review keeps at least 1."""
    score = clamp(F.bround(points / F.lit(rules.max_score) * 100.0).cast("int"))
    return F.when(bucket == "needs_review", F.greatest(score, F.lit(1))).otherwise(score)


def _reasons(body: Column, title: Column, age: Column, rules: Rules) -> Column:
    def said(text: str, phrases: Column) -> Column:
        return F.when(F.size(phrases) > 0, F.concat(F.lit(text), quoted_list(phrases)))

    groups = [
        said(f"keyword group '{g.name}' matched (weight {g.weight}): ", matched(body, g.phrases))
        for g in rules.keyword_groups
    ]
    days = F.concat(F.lit("posted "), F.format_string("%.1f", age), F.lit(" days ago"))
    recent = F.when(age <= 3, F.concat(days, F.lit(" (recent)"))).when(age <= 14, days)
    return F.array_compact(
        F.array(
            *groups,
            said("title matches role target(s): ", matched(title, rules.role_targets)),
            said("positive signals: ", matched(body, rules.positive)),
            recent,
            said("skill match: ", matched(body, rules.core_skills)),
        )
    )


def _red_flags(body: Column, bucket: Column, rules: Rules) -> Column:
    return F.array_compact(
        F.array(
            F.when(bucket == "needs_review", "needs_review bucket: eligibility ambiguous, score penalized"),
            F.when(~any_match(body, rules.core_skills), "no core skills from profile found in description"),
        )
    )


def rankable(bucket: Column, is_relevant: Column) -> Column:
    """Excluded or irrelevant rows are stored but never scored."""
    return (bucket != "excluded") & is_relevant


def trivial_result(bucket: Column, reason: Column, is_relevant: Column) -> Column:
    """Score struct of a row that is not rankable."""
    why = (
        F.when(
            bucket == "excluded",
            F.concat(F.lit("not ranked: excluded ("), F.coalesce(reason, F.lit("None")), F.lit(")")),
        )
        .when(~is_relevant, "not ranked: irrelevant to profile")
        .otherwise("not ranked")
    )
    return F.struct(
        F.lit(0).alias("score"),
        F.lit(0).alias("skill_match"),
        bucket_confidence(bucket).alias("eligibility_confidence"),
        F.lit("unclear").alias("contract_type_guess"),
        F.array(why).alias("reasons"),
        F.array().cast("array<string>").alias("red_flags"),
        F.lit("heuristic").alias("ranking_source"),
        F.lit(None).cast("string").alias("seniority_fit"),
    )


def heuristic_result(rules: Rules, as_of: Column) -> Column:
    """Score struct of a rankable row with classification and hit columns."""
    body, title, bucket = F.col(RELEVANCE_HITS), F.col(TITLE_HITS), F.col("eligibility_bucket")
    age = age_days(F.col("posted_date"), as_of)
    penalty = F.when(bucket == "needs_review", float(rules.near_miss_penalty)).otherwise(0.0)
    points = (
        keyword_group_points(body, rules)
        + title_bonus(title, rules)
        + positive_bonus(body, rules)
        + recency_bonus(age, rules.recency_bonus_max)
        - penalty
    )
    return F.struct(
        heuristic_score(points, bucket, rules).alias("score"),
        skill_match(body, rules).alias("skill_match"),
        bucket_confidence(bucket).alias("eligibility_confidence"),
        resolve_contract(F.col("contract_type_guess"), contract_guess(body, rules)).alias("contract_type_guess"),
        _reasons(body, title, age, rules).alias("reasons"),
        _red_flags(body, bucket, rules).alias("red_flags"),
        F.lit("heuristic").alias("ranking_source"),
        F.lit(None).cast("string").alias("seniority_fit"),
    )


def score(df: DataFrame, rules: Rules, as_of: Column) -> DataFrame:
    """Score classified postings (with hit columns) by formula alone."""
    bucket, relevant = F.col("eligibility_bucket"), F.col("is_relevant")
    result = F.when(rankable(bucket, relevant), heuristic_result(rules, as_of)).otherwise(
        trivial_result(bucket, F.col("eligibility_reason"), relevant)
    )
    return spread_once(df, result, SCORE_FIELDS).drop(*HIT_COLUMNS)
