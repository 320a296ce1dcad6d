"""Labels as the responses of an external scorer, documents as the postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolefunnel.functions.dates import utc_timestamp
from rolefunnel.operators import external as ex
from rolefunnel.operators.classify import classify
from rolefunnel.operators.dedupe import with_dedup_key
from rolefunnel.operators.store import BucketTable
from rolefunnel.plans.catalog.base import AS_OF, SQL_TITLE, documents_as_postings, query, table
from rolefunnel.plans.catalog.ranking import RULES, SCORED_SQL
from rolefunnel.session import scratch_path

_KEY = "'https://example.org/post/' || doc_id"


def _key(doc_id="doc_id"):
    return F.concat(F.lit("https://example.org/post/"), F.col(doc_id).cast("string"))


def _responses(spark, d):
    """Landed responses: out-of-range scores, bad vocabulary, broken and missing blocks."""
    labels = table(spark, d, "labels")
    body = F.to_json(
        F.struct(
            (F.col("toxic") == 0).alias("is_job_posting"),
            (F.col("quality") * 130 + F.col("doc_id") % 50).cast("int").alias("score"),
            (F.col("doc_id") % 120).cast("int").alias("skill_match"),
            F.when(F.col("doc_id") % 9 == 0, "internship").otherwise("b2b").alias("contract_type_guess"),
            F.lit("match").alias("seniority_fit"),
            F.array(F.lit("looks fine")).alias("reasons"),
            F.array().cast("array<string>").alias("red_flags"),
        )
    )
    response = (
        F.when(F.col("doc_id") % 10 == 7, F.lit(None))
        .when(F.col("doc_id") % 10 == 8, '{"score": 5}')
        .when(F.col("doc_id") % 10 == 3, "not json at all")
        .otherwise(body)
    )
    return labels.select(
        "doc_id",
        _key().alias("dedup_key"),
        response.alias("response"),
        F.when(F.col("quality") == 1, "p0").otherwise("p1").alias("provider"),
        F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")).alias("model"),
        (F.col("doc_id") * 10).alias("input_tokens"),
        (F.col("doc_id") + 5).alias("output_tokens"),
    )


_SQL_VALID = f"""
valid AS (SELECT doc_id, {_KEY} AS dedup_key, toxic = 0 AS genuine,
   greatest(0, least(100, CASE WHEN toxic = 0 THEN quality * 130 + doc_id % 50 ELSE 0 END)) AS x_score,
   least(100, doc_id % 120) AS x_skill FROM labels WHERE doc_id % 10 NOT IN (7, 8, 3) AND doc_id % 9 <> 0)"""


@query(
    "response_quarantine",
    """SELECT doc_id, CASE WHEN doc_id % 10 = 7 THEN 'no structured block' WHEN doc_id % 10 IN (8, 3) THEN 'response does not match the schema'
       ELSE 'value outside its vocabulary' END AS error FROM labels WHERE doc_id % 10 IN (7, 8, 3) OR doc_id % 9 = 0""",
)
def _(spark, d):
    return ex.validate_responses(_responses(spark, d))[1].select("doc_id", "error")


@query(
    "external_apply",
    f"""WITH {_SQL_VALID} SELECT doc_id, x_score AS score, x_skill AS skill_match, 60 AS confidence,
        CASE WHEN doc_id % 2 = 0 THEN 'freelance' ELSE 'b2b' END AS contract, CASE WHEN genuine THEN 0 ELSE 1 END AS flags FROM valid""",
)
def _(spark, d):
    valid = ex.validate_responses(_responses(spark, d))[0]
    stated = F.when(F.col("doc_id") % 2 == 0, "freelance").otherwise("unclear")
    rows = valid.select("doc_id", ex.external_result(F.col("r"), F.lit("needs_review"), stated).alias("s"))
    return rows.select(
        "doc_id",
        "s.score",
        "s.skill_match",
        F.col("s.eligibility_confidence").alias("confidence"),
        F.col("s.contract_type_guess").alias("contract"),
        F.size("s.red_flags").alias("flags"),
    )


def _stored(spark, d):
    """Every fifth document was scored externally before, some with a null score."""
    docs = table(spark, d, "documents").filter(F.col("doc_id") % 5 == 0)
    external = F.col("doc_id") % 2 == 0
    return docs.select(
        "doc_id",
        _key().alias("dedup_key"),
        F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 100).cast("int")).alias("score"),
        F.lit(42).alias("skill_match"),
        F.lit(None).cast("int").alias("eligibility_confidence"),
        F.lit("b2b").alias("contract_type_guess"),
        F.array(F.lit("stored")).alias("reasons"),
        F.array().cast("array<string>").alias("red_flags"),
        F.when(external, "ai").otherwise("heuristic").alias("ranking_source"),
        F.when(external, "match").alias("seniority_fit"),
        F.when(F.col("doc_id") % 25 == 0, "excluded").otherwise("eligible").alias("eligibility_bucket"),
        (F.col("doc_id") % 35 != 0).alias("is_relevant"),
    )


@query(
    "cache_reuse",
    """SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN CASE WHEN doc_id % 3 <> 0 THEN doc_id % 100 ELSE 0 END END AS cached_score
       FROM documents""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", _key().alias("dedup_key"))
    cached = ex.cached_results(_stored(spark, d))
    return docs.join(cached, "dedup_key", "left").select(
        "doc_id", F.col("_cached.score").cast("bigint").alias("cached_score")
    )


@query(
    "scorer_selection",
    SCORED_SQL
    + f""", {_SQL_VALID.strip()}
    SELECT s.doc_id,
      CASE WHEN NOT rankable THEN 0 WHEN s.doc_id % 10 = 0 THEN CASE WHEN s.doc_id % 3 <> 0 THEN s.doc_id % 100 ELSE 0 END
           WHEN x_score IS NOT NULL THEN x_score ELSE score END AS score,
      CASE WHEN NOT rankable THEN 'heuristic' WHEN s.doc_id % 10 = 0 OR x_score IS NOT NULL THEN 'ai' ELSE 'heuristic' END AS ranking_source,
      CASE WHEN NOT rankable THEN 'unclear' WHEN s.doc_id % 10 = 0 THEN 'b2b'
           WHEN x_score IS NOT NULL THEN CASE WHEN stated_contract <> 'unclear' THEN stated_contract ELSE 'b2b' END ELSE contract END AS contract
    FROM scored s LEFT JOIN valid v ON v.doc_id = s.doc_id""",
)
def _(spark, d):
    classified = with_dedup_key(classify(documents_as_postings(spark, d), RULES, keep_hits=True))
    responses = ex.validate_responses(_responses(spark, d))[0]
    rows = ex.select_score(classified, RULES, utc_timestamp(AS_OF), _stored(spark, d), responses)
    return rows.select("doc_id", "score", "ranking_source", F.col("contract_type_guess").alias("contract"))


@query(
    "request_build",
    f"""SELECT doc_id, {SQL_TITLE} AS title, source AS company, text AS description, 'engineer' AS role,
        'Score it.' AS instructions, 2 AS tags, true AS has_salary_field FROM documents""",
)
def _(spark, d):
    """Requests are JSON; they are read back field by field."""
    docs = with_dedup_key(documents_as_postings(spark, d)).withColumn("salary_text", F.lit(None).cast("string"))
    requests = ex.build_requests(docs, {"role_targets": ["engineer"]}, "Score it.")
    back = requests.join(docs.select("dedup_key", "doc_id"), "dedup_key").withColumn(
        "q",
        F.from_json(
            "request",
            "job struct<title: string, company: string, tags: array<string>, description: string>, "
            "candidate_profile struct<role_targets: array<string>>, instructions string",
        ),
    )
    return back.select(
        "doc_id",
        "q.job.title",
        "q.job.company",
        "q.job.description",
        F.get("q.candidate_profile.role_targets", F.lit(0)).alias("role"),
        "q.instructions",
        F.size("q.job.tags").alias("tags"),
        F.contains("request", F.lit('"salary_text":null')).alias("has_salary_field"),
    )


def _asked(spark, d):
    """Keys to score again: stored ones, and some nobody knows."""
    return table(spark, d, "labels").filter(F.col("doc_id") % 5 == 0).select(
        F.when(F.col("doc_id") % 20 == 0, F.concat(F.lit("gone:"), F.col("doc_id").cast("string")))
        .otherwise(_key())
        .alias("dedup_key")
    )


_SQL_ASKED = f"""
asked AS (SELECT DISTINCT doc_id, CASE WHEN doc_id % 20 = 0 THEN 'gone:' || doc_id ELSE {_KEY} END AS dedup_key FROM labels WHERE doc_id % 5 = 0),
judged AS (SELECT a.dedup_key, x_score, CASE WHEN a.doc_id % 20 = 0 THEN 'unknown key'
   WHEN a.doc_id % 25 = 0 OR a.doc_id % 35 = 0 THEN 'excluded or irrelevant, never ranked'
   WHEN v.dedup_key IS NULL THEN 'no valid response' END AS error FROM asked a LEFT JOIN valid v USING (dedup_key))"""


@query("forced_rescore", f"WITH {_SQL_VALID}, {_SQL_ASKED} SELECT dedup_key, x_score AS score, 'ai' AS ranking_source FROM judged WHERE error IS NULL")
def _(spark, d):
    responses = ex.validate_responses(_responses(spark, d))[0]
    rows, _ = ex.forced_rescore(_asked(spark, d), _stored(spark, d), responses)
    return rows.select("dedup_key", "score", "ranking_source")


@query("forced_rescore_errors", f"WITH {_SQL_VALID}, {_SQL_ASKED} SELECT dedup_key, error FROM judged WHERE error IS NOT NULL")
def _(spark, d):
    responses = ex.validate_responses(_responses(spark, d))[0]
    return ex.forced_rescore(_asked(spark, d), _stored(spark, d), responses)[1]


@query(
    "rescore_into_store",
    f"""WITH {_SQL_VALID}, {_SQL_ASKED} SELECT {_KEY} AS dedup_key,
        CASE WHEN j.x_score IS NOT NULL THEN j.x_score WHEN doc_id % 3 <> 0 THEN doc_id % 100 END AS score,
        CASE WHEN j.x_score IS NOT NULL OR doc_id % 2 = 0 THEN 'ai' ELSE 'heuristic' END AS ranking_source, 'applied' AS status,
        epoch_us(TIMESTAMP '2024-01-01') AS last_seen
        FROM documents d LEFT JOIN (SELECT * FROM judged WHERE error IS NULL) j ON j.dedup_key = {_KEY} WHERE doc_id % 5 = 0""",
)
def _(spark, d):
    """Asked keys scored again inside the stored table; everything else stays as it was."""
    kept = BucketTable.postings(spark, scratch_path(spark, "rescore"), buckets=8)
    seen = utc_timestamp("2024-01-01")
    kept.replace(_stored(spark, d).withColumns({"status": F.lit("applied"), "first_seen_at": seen, "last_seen_at": seen}))
    ex.rescore_into(kept, _asked(spark, d), ex.validate_responses(_responses(spark, d))[0])
    return kept.read().select("dedup_key", "score", "ranking_source", "status", F.unix_micros("last_seen_at").alias("last_seen"))


def _deterministic_scorer():
    """A scorer that needs no service: it counts in the request and fails on some."""
    import json

    def score(request: str) -> str:
        job = json.loads(request)["job"]
        size = len(job["description"])
        if size % 7 == 0:
            raise ValueError("no answer")
        if size % 11 == 0:
            return "{}"
        return json.dumps(
            {"is_job_posting": size % 5 != 0, "score": size % 150, "skill_match": 50, "contract_type_guess": "b2b",
             "seniority_fit": "match", "reasons": [job["company"]], "red_flags": []}
        )

    return score


def _hooked(spark, d):
    docs = with_dedup_key(documents_as_postings(spark, d)).withColumn("salary_text", F.lit(None).cast("string"))
    requests = ex.build_requests(docs, {"role_targets": ["engineer"]}, "Score it.")
    return docs, ex.validate_responses(ex.score_requests(requests, _deterministic_scorer))


_SQL_HOOK = "h AS (SELECT doc_id, source, length(text) AS n FROM documents)"


@query(
    "scorer_hook",
    f"""WITH {_SQL_HOOK} SELECT doc_id, CASE WHEN n % 5 = 0 THEN 0 ELSE least(100, n % 150) END AS score, source AS reason,
        CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END AS flags, CASE WHEN doc_id % 7 = 0 THEN 'employment' ELSE 'b2b' END AS contract
        FROM h WHERE n % 7 <> 0 AND n % 11 <> 0""",
)
def _(spark, d):
    """Requests of all documents through a scorer, its answers as scores."""
    docs, (valid, _) = _hooked(spark, d)
    rows = valid.join(docs.select("dedup_key", "doc_id", "contract_type_guess"), "dedup_key")
    scored = rows.select("doc_id", ex.external_result(F.col("r"), F.lit("eligible"), F.col("contract_type_guess")).alias("s"))
    return scored.select(
        "doc_id", "s.score", F.get("s.reasons", F.lit(0)).alias("reason"), F.size("s.red_flags").alias("flags"), F.col("s.contract_type_guess").alias("contract")
    )


@query(
    "scorer_hook_errors",
    f"""WITH {_SQL_HOOK} SELECT doc_id, CASE WHEN n % 7 = 0 THEN 'ValueError: no answer' ELSE 'response does not match the schema' END AS error
        FROM h WHERE n % 7 = 0 OR n % 11 = 0""",
)
def _(spark, d):
    docs, (_, bad) = _hooked(spark, d)
    return bad.join(docs.select("dedup_key", "doc_id"), "dedup_key").select("doc_id", "error")


@query(
    "usage_cost",
    """WITH c AS (SELECT CASE WHEN quality = 1 THEN 'p0' ELSE 'p1' END AS provider, 'm' || doc_id % 3 AS model,
         count(*) AS calls, sum(doc_id * 10)::BIGINT AS input_tokens, sum(doc_id + 5)::BIGINT AS output_tokens FROM labels GROUP BY 1, 2),
       p AS (SELECT 'p' || n_nationkey % 2 AS provider, 'm' || n_nationkey AS model, n_nationkey + 0.5::DOUBLE AS a, n_nationkey * 2.0::DOUBLE AS b
             FROM nation)
       SELECT c.*, round(input_tokens / 1e6::DOUBLE * a + output_tokens / 1e6::DOUBLE * b, 9) AS cost
       FROM c LEFT JOIN p USING (provider, model)""",
)
def _(spark, d):
    prices = table(spark, d, "nation").select(
        F.concat(F.lit("p"), (F.col("n_nationkey") % 2).cast("string")).alias("provider"),
        F.concat(F.lit("m"), F.col("n_nationkey").cast("string")).alias("model"),
        (F.col("n_nationkey") + 0.5).alias("input_per_m"),
        (F.col("n_nationkey") * 2.0).alias("output_per_m"),
    )
    return ex.usage_cost(_responses(spark, d), prices).withColumn("cost", F.round("cost", 9))
