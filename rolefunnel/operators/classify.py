"""The two classification axes: eligibility and relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefunnel.functions.text import WORD, let, tokens
from rolefunnel.operators.barrier import add_once
from rolefunnel.operators.phrases import any_match, matched, phrase_hits, quoted_list
from rolefunnel.operators.rules import Rules

# Columns with the phrase hits of one row; scoring reads them, then they are dropped.
ELIGIBILITY_HITS, RELEVANCE_HITS, TITLE_HITS = "_hits_eligibility", "_hits_relevance", "_hits_title"
HIT_COLUMNS = [ELIGIBILITY_HITS, RELEVANCE_HITS, TITLE_HITS]


def drop_disclosures(text: Column, words: tuple[str, str, str]) -> Column:
    """Blank out every sentence that names A, then B, then C (three alternations).

    Sentences are cut first and each is tested with possessive groups, so the
    cost stays linear however long a sentence is.
    """
    subject, action, person = words
    edge, start = rf"(?<![{WORD}])", r"(?isu)^"
    pattern = (
        rf"{start}(?>.*?{edge}(?:{subject})(?![{WORD}]))(?>.*?{edge}(?:{action})).*?{edge}(?:{person})"
    )

    def sentences(pieces: Column) -> Column:
        def keep(piece: Column, i: Column) -> Column:
            return (
                F.when(i == F.size(pieces) - 1, piece)
                .when(piece.rlike(pattern), F.lit(" "))
                .otherwise(F.concat(piece, F.lit(".")))
            )

        return F.array_join(F.transform(pieces, keep), "")

    mentioned = text.rlike(rf"(?iu)(?:{subject})")
    return F.when(mentioned, let(F.split(text, r"\.", -1), sentences)).otherwise(text)


def eligibility_text(title: Column, description: Column, location: Column) -> Column:
    return F.concat_ws(" ", title, description, F.coalesce(location, F.lit("")))


def relevance_text(title: Column, description: Column, rules: Rules) -> Column:
    return drop_disclosures(F.concat_ws(" ", title, description), rules.disclosure)


def _phrases_for_eligibility(rules: Rules) -> list[str]:
    return [*rules.exclude, *rules.hybrid_onsite, *rules.remote_indicator, *rules.needs_review]


def _phrases_for_body(rules: Rules) -> list[str]:
    grouped = [p for g in rules.keyword_groups for p in g.phrases]
    contract = [p for phrases in rules.contract.values() for p in phrases]
    return [*rules.relevance, *rules.positive, *rules.core_skills, *grouped, *contract]


def _phrases_for_title(rules: Rules) -> list[str]:
    return [*rules.non_role_title, *rules.relevance_weak, *rules.role_targets]


def with_hits(df: DataFrame, rules: Rules, axes: tuple[str, ...] = tuple(HIT_COLUMNS)) -> DataFrame:
    """Add the hit arrays of the asked axes; each text is normalised and scanned once."""
    title, body, place = F.col("title"), F.col("description"), F.col("location_text")
    texts = {
        ELIGIBILITY_HITS: (eligibility_text(title, body, place), _phrases_for_eligibility(rules)),
        RELEVANCE_HITS: (relevance_text(title, body, rules), _phrases_for_body(rules)),
        TITLE_HITS: (title, _phrases_for_title(rules)),
    }
    words = {axis: f"_words{axis}" for axis in axes}
    df = df.withColumns({words[a]: tokens(texts[a][0]) for a in axes})
    hits = {a: phrase_hits(F.col(words[a]), texts[a][1], rules.negation) for a in axes}
    return add_once(df, hits).drop(*words.values())


def eligibility(hits: Column, rules: Rules) -> Column:
    """struct(bucket, reason): exclude, then on-site without remote, then review."""
    excluded = matched(hits, rules.exclude)
    onsite = matched(hits, rules.hybrid_onsite)
    review = matched(hits, rules.needs_review)
    onsite_only = any_match(hits, rules.hybrid_onsite) & ~any_match(hits, rules.remote_indicator)

    def verdict(bucket: str, reason: Column) -> Column:
        return F.struct(F.lit(bucket).alias("bucket"), reason.cast("string").alias("reason"))

    def because(label: str, phrases: Column, tail: str = "") -> Column:
        return F.concat(F.lit(f"{label}: matched "), quoted_list(phrases), F.lit(tail))

    return (
        F.when(any_match(hits, rules.exclude), verdict("excluded", because("excluded", excluded)))
        .when(onsite_only, verdict("excluded", because("excluded", onsite, " with no remote indicator present")))
        .when(any_match(hits, rules.needs_review), verdict("needs_review", because("needs_review", review)))
        .otherwise(verdict("eligible", F.lit(None)))
    )


def relevance(title_hits: Column, body_hits: Column, rules: Rules) -> Column:
    """Title veto, else a strong keyword anywhere, else a weak keyword in the title."""
    return (
        F.when(any_match(title_hits, rules.non_role_title), False)
        .when(any_match(body_hits, rules.relevance), True)
        .otherwise(any_match(title_hits, rules.relevance_weak))
    )


def classify(df: DataFrame, rules: Rules, keep_hits: bool = False) -> DataFrame:
    """Add eligibility_bucket, eligibility_reason and is_relevant to postings."""
    verdict = eligibility(F.col(ELIGIBILITY_HITS), rules)
    df = add_once(
        with_hits(df, rules),
        {"_verdict": verdict, "is_relevant": relevance(F.col(TITLE_HITS), F.col(RELEVANCE_HITS), rules)},
    )
    df = df.withColumns(
        {"eligibility_bucket": F.col("_verdict.bucket"), "eligibility_reason": F.col("_verdict.reason")}
    ).drop("_verdict")
    return df if keep_hits else df.drop(*HIT_COLUMNS)


def effective_bucket(is_relevant: Column, bucket: Column) -> Column:
    """Irrelevance outranks the eligibility bucket."""
    return F.when(~is_relevant, "irrelevant").otherwise(bucket)
