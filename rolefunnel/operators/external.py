"""Scores supplied by an external scorer: requests out, landed responses in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefunnel.functions.labels import bucket_confidence
from rolefunnel.functions.text import clamp
from rolefunnel.operators.barrier import spread_once
from rolefunnel.operators.classify import HIT_COLUMNS
from rolefunnel.operators.rules import Rules
from rolefunnel.operators.scoring import (
    SCORE_FIELDS,
    heuristic_result,
    rankable,
    resolve_contract,
    trivial_result,
)
from rolefunnel.operators.store import BucketTable
from rolefunnel.schema import CONTRACT_TYPES, SENIORITY_FITS, allowed, ddl_fields
from rolefunnel.session import cut_lineage

RESPONSE_DDL = (
    "is_job_posting boolean, score int, skill_match int, contract_type_guess string, "
    "seniority_fit string, reasons array<string>, red_flags array<string>"
)
SPAM_FLAG = "AI flagged this listing as not a genuine job posting (possible spam)"


def build_requests(postings: DataFrame, profile: dict, instructions: str, max_chars: int | None = None) -> DataFrame:
    """(dedup_key, request): one JSON request per posting, for any batch scorer; ``max_chars`` shortens descriptions."""
    job = F.struct(
        "title",
        "company",
        "tags",
        "salary_text",
        "location_text",
        (F.col("description") if max_chars is None else F.left("description", F.lit(max_chars))).alias("description"),
    )
    candidate = F.struct(*[F.lit(v).alias(k) for k, v in profile.items()])
    body = F.struct(
        job.alias("job"), candidate.alias("candidate_profile"), F.lit(instructions).alias("instructions")
    )
    return postings.select("dedup_key", F.to_json(body, {"ignoreNullFields": "false"}).alias("request"))


Scorer = Callable[[str], str]
_SCORED_ROWS = 256


def score_requests(requests: DataFrame, make_scorer: Callable[[], Scorer] | None = None) -> DataFrame:
    """(dedup_key, response, error) for every request (dedup_key, request).

    ``make_scorer`` is called once per partition and gives the scorer, a callable from
    request to response text; a request it fails on becomes a row with the error and no
    response, which ``validate_responses`` puts into quarantine.  Without a scorer
    nothing is scored.  Partitions bound how many scorers run at a time.
    """
    if make_scorer is None:
        return requests.select("dedup_key", F.lit(None).cast("string").alias("response"), F.lit(None).cast("string").alias("error")).limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = make_scorer()
        for batch in batches:
            # Few rows at a time: what a worker holds beside a batch does not follow its size.
            for low in range(0, batch.num_rows, _SCORED_ROWS):
                part = batch.slice(low, _SCORED_ROWS)
                responses, errors = [], []
                for request in part.column(1):
                    try:
                        response, error = scorer(request.as_py()), None
                    except Exception as failure:  # whatever a scorer raises belongs to this request
                        response, error = None, f"{type(failure).__name__}: {failure}"
                    responses.append(response)
                    errors.append(error)
                columns = [part.column(0), pa.array(responses, pa.string()), pa.array(errors, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["dedup_key", "response", "error"])

    return requests.select("dedup_key", "request").mapInArrow(run, "dedup_key string, response string, error string")


def validate_responses(landed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split landed (dedup_key, response, ...) into (valid with struct ``r``, quarantined).

    A response is valid when it parses, lacks no field and respects both
    vocabularies; anything else goes to quarantine with the reason.
    """
    parsed = landed.withColumn("r", F.from_json("response", RESPONSE_DDL, {"mode": "PERMISSIVE"}))
    r = F.col("r")
    incomplete = F.lit(False)
    for name, _ in ddl_fields(RESPONSE_DDL):
        incomplete = incomplete | r[name].isNull()
    vocabulary = allowed(r["contract_type_guess"], CONTRACT_TYPES) & allowed(r["seniority_fit"], SENIORITY_FITS)
    error = (
        F.when(F.col("response").isNull() | (F.trim("response") == ""), "no structured block")
        .when(r.isNull() | incomplete, "response does not match the schema")
        .when(~vocabulary, "value outside its vocabulary")
    )
    if "error" in landed.columns:  # the scorer itself has failed
        error = F.coalesce("error", error)
    checked = parsed.withColumn("error", error)
    return (
        checked.filter(F.col("error").isNull()).drop("error", "response"),
        checked.filter(F.col("error").isNotNull()).drop("r"),
    )


def external_result(r: Column, bucket: Column, stated_contract: Column) -> Column:
    """Score struct from a valid response; not a posting scores 0 with a red flag."""
    genuine = r["is_job_posting"]
    flags = F.when(genuine, r["red_flags"]).otherwise(F.concat(r["red_flags"], F.array(F.lit(SPAM_FLAG))))
    return F.struct(
        F.when(genuine, clamp(r["score"])).otherwise(0).alias("score"),
        clamp(r["skill_match"]).alias("skill_match"),
        bucket_confidence(bucket).alias("eligibility_confidence"),
        resolve_contract(stated_contract, r["contract_type_guess"]).alias("contract_type_guess"),
        r["reasons"].alias("reasons"),
        flags.alias("red_flags"),
        F.lit("ai").alias("ranking_source"),
        r["seniority_fit"].alias("seniority_fit"),
    )


def cached_results(stored: DataFrame, hash_column: str | None = None) -> DataFrame:
    """(dedup_key, cached): results of the external scorer worth reusing."""
    numbers = ["score", "skill_match", "eligibility_confidence"]
    members = [
        F.coalesce(F.col(name), F.lit(0)).alias(name) if name in numbers else F.col(name)
        for name in SCORE_FIELDS
    ]
    extra = [F.col(hash_column).alias("_cached_hash")] if hash_column else []
    return stored.filter(F.col("ranking_source") == "ai").select(
        "dedup_key", F.struct(*members).alias("_cached"), *extra
    )


def one_response(responses: DataFrame) -> DataFrame:
    """(dedup_key, _response): one response per key; of a repeated one the newest ``received_at``, else the greatest."""
    newest = F.struct(F.col("received_at"), F.col("r")) if "received_at" in responses.columns else F.struct("r")
    return responses.groupBy("dedup_key").agg(F.max(newest)["r"].alias("_response"))


def select_score(
    classified: DataFrame,
    rules: Rules,
    as_of: Column,
    stored: DataFrame,
    responses: DataFrame,
    content_hash: str | None = None,
) -> DataFrame:
    """Per row: trivial, else cached, else external, else formula.

    ``classified`` carries the hit columns.  ``responses`` is (dedup_key, r) from
    ``validate_responses``.  With ``content_hash`` a cached result is reused only
    while the named column is unchanged.
    """
    bucket, relevant = F.col("eligibility_bucket"), F.col("is_relevant")
    df = classified.join(cached_results(stored, content_hash), "dedup_key", "left").join(
        one_response(responses), "dedup_key", "left"
    )
    cached = F.col("_cached")
    if content_hash:
        cached = F.when(F.col("_cached_hash").eqNullSafe(F.col(content_hash)), cached)
        df = df.withColumn("_cached", cached).drop("_cached_hash")
        cached = F.col("_cached")
    external = external_result(F.col("_response"), bucket, F.col("contract_type_guess"))
    result = (
        F.when(~rankable(bucket, relevant), trivial_result(bucket, F.col("eligibility_reason"), relevant))
        .when(cached.isNotNull(), cached)
        .when(F.col("_response").isNotNull(), external)
        .otherwise(heuristic_result(rules, as_of))
    )
    return spread_once(df, result, SCORE_FIELDS).drop("_cached", "_response", *HIT_COLUMNS)


def forced_rescore(keys: DataFrame, stored: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Re-score the asked keys from responses, bypassing the cache.

    Returns (rows to merge, errors).  Unknown keys, rows that are never ranked
    and keys without a valid response become error rows, not fallbacks.
    """
    asked = keys.select("dedup_key").distinct()
    found = asked.join(stored.withColumn("_known", F.lit(True)), "dedup_key", "left").join(
        one_response(responses), "dedup_key", "left"
    )
    error = (
        F.when(F.col("_known").isNull(), "unknown key")
        .when(~rankable(F.col("eligibility_bucket"), F.col("is_relevant")), "excluded or irrelevant, never ranked")
        .when(F.col("_response").isNull(), "no valid response")
    )
    checked = found.withColumn("error", error)
    result = external_result(F.col("_response"), F.col("eligibility_bucket"), F.col("contract_type_guess"))
    good = checked.filter(F.col("error").isNull())
    rows = spread_once(good, result, SCORE_FIELDS).drop("_known", "_response", "error")
    return rows, checked.filter(F.col("error").isNotNull()).select("dedup_key", "error")


def rescore_into(table: BucketTable, keys: DataFrame, responses: DataFrame) -> DataFrame:
    """Re-score the asked keys and write the scores into their buckets; returns the errors (dedup_key, error).

    Only the scores of rows change; what belongs to the user and the times stay.
    """
    rows, errors = forced_rescore(keys, table.read(), responses)
    errors = cut_lineage(errors)  # read from the buckets as they were

    def with_scores(old: DataFrame, asked: DataFrame) -> DataFrame:
        new = forced_rescore(asked, old, responses)[0].select("dedup_key", F.struct(*SCORE_FIELDS).alias("_new"))
        joined = old.join(new, "dedup_key", "left")
        return joined.withColumns({c: F.when(F.col("_new").isNull(), F.col(c)).otherwise(F.col(f"_new.{c}")) for c in SCORE_FIELDS}).drop("_new")

    table.merge(rows.select("dedup_key"), with_scores)
    return errors


def usage_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls, tokens and cost per (provider, model); an unlisted price leaves cost null."""
    totals = calls.groupBy("provider", "model").agg(
        F.count("*").alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )
    cost = (
        F.col("input_tokens") / 1e6 * F.col("input_per_m")
        + F.col("output_tokens") / 1e6 * F.col("output_per_m")
    )
    return (
        totals.join(prices, ["provider", "model"], "left")
        .withColumn("cost", cost)
        .drop("input_per_m", "output_per_m")
    )
