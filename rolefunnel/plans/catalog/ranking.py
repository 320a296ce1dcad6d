"""Phrase rules, the two classification axes, scores and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolefunnel.functions.dates import age_days, utc_timestamp
from rolefunnel.operators import classify as c
from rolefunnel.operators import phrases as ph
from rolefunnel.operators import report as rp
from rolefunnel.operators import scoring as sc
from rolefunnel.operators.rule_join import phrase_hits_joined
from rolefunnel.operators.rules import KeywordGroup, Negation, Rules, norm_phrase, rule_table
from rolefunnel.plans.catalog.base import AS_OF, POSTINGS_SQL, documents_as_postings, query, sql_norm, table

# Rule lists made of words that do occur in the documents.
RULES = Rules(
    exclude=("All rights reserved", "license", "and-the"),
    hybrid_onsite=("nicht", "que la", "of the"),
    remote_indicator=("und die", "fr", "in the"),
    needs_review=("that is", "no", "los", "des"),
    positive=("the", "to the", "in", "de la", "und", "que", "for the", "is", "et"),
    relevance=("and", "der", "les", "with", "para"),
    relevance_weak=("on", "ch", "th"),
    non_role_title=("is", "ai", "ist"),
    keyword_groups=(
        KeywordGroup("articles", 3.0, ("the", "de", "of the")),
        KeywordGroup("joins", 2.0, ("und", "der", "el")),
        KeywordGroup("others", 1.0, ("to", "for", "in", "la")),
    ),
    role_targets=("the", "la", "der", "el"),
    core_skills=("and", "und", "et", "y", "of", "nicht", "que"),
    contract={"b2b": ["license"], "freelance": ["no", "por"], "employment": ["are", "ist"]},
    negation=Negation(words=("that", "of", "der"), window=5),
    disclosure=("the|der", "and|und", "of|die"),
)
LISTS = {
    "exclude": RULES.exclude,
    "hybrid": RULES.hybrid_onsite,
    "remote": RULES.remote_indicator,
    "review": RULES.needs_review,
    "positive": RULES.positive,
    "relevance": RULES.relevance,
    "weak": RULES.relevance_weak,
    "title_veto": RULES.non_role_title,
    "skills": RULES.core_skills,
    "targets": RULES.role_targets,
    **{f"group:{g.name}": g.phrases for g in RULES.keyword_groups},
    **{f"contract:{k}": v for k, v in RULES.contract.items()},
}

_PHRASES = sorted({norm_phrase(p) for phrases in LISTS.values() for p in phrases})
_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_NEG = _IN(RULES.negation.words)


def sql_hits(name: str, source: str, key: str, text: str) -> str:
    """CTE ``name``(key, phrase): phrases with an occurrence that is not negated."""
    lags = " OR ".join(f"coalesce(lag(w, {n}) OVER z IN {_NEG}, false)" for n in range(1, RULES.negation.window + 1))
    longest = max(len(p.split()) for p in _PHRASES)
    grams, gram = [], "w"
    for n in range(1, longest + 1):
        grams.append(f"{gram} AS g{n}")
        gram += f" || ' ' || lead(w, {n}) OVER z"
    union = " UNION ".join(
        f"SELECT {key}, g{n} AS phrase FROM {name}_g WHERE NOT neg AND g{n} IN {_IN(_PHRASES)}" for n in range(1, longest + 1)
    )
    return f"""
  {name}_t AS (SELECT {key}, string_split({sql_norm(text)}, ' ') AS ws FROM {source}),
  {name}_w AS (SELECT {key}, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM {name}_t),
  {name}_g AS (SELECT {key}, {", ".join(grams)}, ({lags}) AS neg FROM {name}_w
               WINDOW z AS (PARTITION BY {key} ORDER BY i)),
  {name} AS ({union})"""


def sql_rule_values(lists: dict) -> str:
    rows = [
        f"('{name}', '{norm_phrase(p)}', '{p}', {i})" for name, phrases in lists.items() for i, p in enumerate(phrases)
    ]
    return "rules(list_name, norm, phrase, pos) AS (VALUES " + ", ".join(rows) + ")"


_EDGE = r"[^\p{L}\p{N}_]"
_A, _B, _C = RULES.disclosure
_SQL_SENTENCE = rf"(?is)(?:^|{_EDGE})(?:{_A}){_EDGE}(?:.*{_EDGE})?(?:{_B}).*{_EDGE}(?:{_C})"


def sql_drop(x: str) -> str:
    parts = f"string_split({x}, '.')"
    return f"""array_to_string(list_transform({parts}, lambda s, i: CASE WHEN i = len({parts}) THEN s
      WHEN regexp_matches(s, '{_SQL_SENTENCE}') THEN ' ' ELSE s || '.' END), '')"""


_ELIG = "title || ' ' || description || ' ' || location_text"
_BODY = sql_drop("(title || ' ' || description)")

SCORED_SQL = f"""
WITH {POSTINGS_SQL}, {sql_rule_values(LISTS)},
{sql_hits('he', 'postings', 'doc_id', _ELIG)},
{sql_hits('hb', 'postings', 'doc_id', _BODY)},
{sql_hits('ht', 'postings', 'doc_id', 'title')},
lists_e AS (SELECT doc_id, list_name, list(r.phrase ORDER BY pos) AS ps FROM he JOIN rules r ON he.phrase = r.norm GROUP BY ALL),
lists_b AS (SELECT doc_id, list_name, list(r.phrase ORDER BY pos) AS ps FROM hb JOIN rules r ON hb.phrase = r.norm GROUP BY ALL),
lists_t AS (SELECT doc_id, list_name, list(r.phrase ORDER BY pos) AS ps FROM ht JOIN rules r ON ht.phrase = r.norm GROUP BY ALL),
pe AS (SELECT doc_id, {", ".join(f"max(ps) FILTER (list_name = '{n}') AS {n}" for n in ("exclude", "hybrid", "remote", "review"))} FROM lists_e GROUP BY doc_id),
pb AS (SELECT doc_id, {", ".join(f'max(ps) FILTER (list_name = {chr(39)}{n}{chr(39)}) AS "{n}"' for n in LISTS)} FROM lists_b GROUP BY doc_id),
pt AS (SELECT doc_id, {", ".join(f"max(ps) FILTER (list_name = '{n}') AS {n}" for n in ("title_veto", "weak", "targets"))} FROM lists_t GROUP BY doc_id),
classified AS (SELECT p.*,
  CASE WHEN pe.exclude IS NOT NULL THEN 'excluded' WHEN pe.hybrid IS NOT NULL AND pe.remote IS NULL THEN 'excluded'
       WHEN pe.review IS NOT NULL THEN 'needs_review' ELSE 'eligible' END AS bucket,
  CASE WHEN pe.exclude IS NOT NULL THEN 'excluded: matched [''' || array_to_string(pe.exclude, ''', ''') || ''']'
       WHEN pe.hybrid IS NOT NULL AND pe.remote IS NULL THEN 'excluded: matched [''' || array_to_string(pe.hybrid, ''', ''') || '''] with no remote indicator present'
       WHEN pe.review IS NOT NULL THEN 'needs_review: matched [''' || array_to_string(pe.review, ''', ''') || ''']' END AS reason,
  CASE WHEN pt.title_veto IS NOT NULL THEN false WHEN pb.relevance IS NOT NULL THEN true ELSE pt.weak IS NOT NULL END AS is_relevant,
  pb."group:articles" AS ga, pb."group:joins" AS gj, pb."group:others" AS go, pb.positive AS pos_hits, pb.skills AS skill_hits,
  pt.targets AS target_hits,
  CASE WHEN pb."contract:b2b" IS NOT NULL THEN 'b2b' WHEN pb."contract:freelance" IS NOT NULL THEN 'freelance'
       WHEN pb."contract:employment" IS NOT NULL THEN 'employment' ELSE 'unclear' END AS guess
  FROM postings p LEFT JOIN pe USING (doc_id) LEFT JOIN pb USING (doc_id) LEFT JOIN pt USING (doc_id)),
parts AS (SELECT *,
  ((CASE WHEN ga IS NOT NULL THEN 3.0 ELSE 0.0 END + CASE WHEN gj IS NOT NULL THEN 2.0 ELSE 0.0 END
    + CASE WHEN go IS NOT NULL THEN 1.0 ELSE 0.0 END)::DOUBLE / 6.0::DOUBLE) * 40.0::DOUBLE AS kw,
  CASE WHEN target_hits IS NOT NULL THEN 15.0 ELSE 0.0 END::DOUBLE AS tb,
  least(15.0, 2.0 * coalesce(len(pos_hits), 0))::DOUBLE AS pos,
  CASE WHEN age <= 3 THEN 10.0 WHEN age <= 7 THEN 5.0 WHEN age <= 14 THEN 2.0 ELSE 0.0 END::DOUBLE AS rec,
  CASE WHEN bucket = 'needs_review' THEN 10.0 ELSE 0.0 END::DOUBLE AS pen,
  round_even(100.0 * coalesce(len(skill_hits), 0) / 7.0, 0)::INT AS skill FROM classified),
raw AS (SELECT *, greatest(0, least(100, round_even((kw + tb + pos + rec - pen) / 80.0::DOUBLE * 100.0::DOUBLE, 0)))::INT AS pts,
  bucket <> 'excluded' AND is_relevant AS rankable FROM parts),
scored AS (SELECT *, 'https://example.org/post/' || doc_id AS dedup_key,
  CASE WHEN NOT rankable THEN 0 WHEN bucket = 'needs_review' THEN greatest(pts, 1) ELSE pts END AS score,
  CASE WHEN NOT rankable THEN 0 ELSE skill END AS skill_match,
  CASE bucket WHEN 'eligible' THEN 100 WHEN 'needs_review' THEN 60 ELSE 0 END AS confidence,
  CASE WHEN NOT rankable THEN 'unclear' WHEN stated_contract <> 'unclear' THEN stated_contract ELSE guess END AS contract,
  CASE WHEN is_relevant THEN bucket ELSE 'irrelevant' END AS shown FROM raw)
"""


def _classified(spark, d, axes=None):
    docs = documents_as_postings(spark, d)
    return c.with_hits(docs, RULES, axes) if axes else c.classify(docs, RULES, keep_hits=True)


def scored_documents(spark, d):
    """Documents classified and scored, with the key postings are stored under."""
    from rolefunnel.operators.dedupe import with_dedup_key

    return with_dedup_key(sc.score(_classified(spark, d), RULES, utc_timestamp(AS_OF)))


@query(
    "phrase_hits",
    f"""WITH {POSTINGS_SQL}, {sql_rule_values(LISTS)}, {sql_hits('h', 'postings', 'doc_id', 'description')}
    SELECT doc_id, list_name, string_agg(r.phrase, '|' ORDER BY pos) AS phrases, count(*) AS n
    FROM h JOIN rules r ON h.phrase = r.norm GROUP BY doc_id, list_name""",
)
def _(spark, d):
    from rolefunnel.functions.text import tokens

    docs = documents_as_postings(spark, d, ["doc_id", "description"])
    docs = docs.select("doc_id", tokens(F.col("description")).alias("words"))
    every = [p for phrases in LISTS.values() for p in phrases]
    hits = docs.select("doc_id", ph.phrase_hits(F.col("words"), every, RULES.negation).alias("hits"))
    return ph.hits_per_list(hits, "hits", LISTS, "doc_id").select(
        "doc_id", "list_name", F.array_join("phrases", "|").alias("phrases"), F.size("phrases").alias("n")
    )


@query("eligibility", SCORED_SQL + "SELECT doc_id, bucket, reason FROM scored")
def _(spark, d):
    rows = _classified(spark, d, (c.ELIGIBILITY_HITS,))
    verdict = c.eligibility(F.col(c.ELIGIBILITY_HITS), RULES)
    return rows.select("doc_id", verdict.alias("v")).select("doc_id", "v.bucket", "v.reason")


@query("relevance", SCORED_SQL + "SELECT doc_id, is_relevant FROM scored")
def _(spark, d):
    rows = _classified(spark, d, (c.RELEVANCE_HITS, c.TITLE_HITS))
    relevant = c.relevance(F.col(c.TITLE_HITS), F.col(c.RELEVANCE_HITS), RULES)
    return rows.select("doc_id", relevant.alias("is_relevant"))


@query("sentence_drop", f"SELECT doc_id, {sql_drop('text')} AS kept FROM documents")
def _(spark, d):
    kept = c.drop_disclosures(F.col("text"), RULES.disclosure)
    return table(spark, d, "documents").select("doc_id", kept.alias("kept"))


@query("effective_bucket", SCORED_SQL + "SELECT doc_id, shown FROM scored")
def _(spark, d):
    return _classified(spark, d).select("doc_id", rp.bucket_of_row().alias("shown"))


@query(
    "bucket_counts",
    SCORED_SQL
    + """SELECT b.bucket, b.ord, count(doc_id) AS n FROM (VALUES ('eligible', 0), ('needs_review', 1), ('excluded', 2),
       ('irrelevant', 3)) b(bucket, ord) LEFT JOIN scored ON shown = b.bucket GROUP BY b.bucket, b.ord""",
)
def _(spark, d):
    return rp.bucket_counts(_classified(spark, d))


@query("keyword_group_score", SCORED_SQL + "SELECT doc_id, round(kw, 6) AS points FROM scored")
def _(spark, d):
    points = sc.keyword_group_points(F.col(c.RELEVANCE_HITS), RULES)
    return _classified(spark, d, (c.RELEVANCE_HITS,)).select("doc_id", F.round(points, 6).alias("points"))


@query("skill_match", SCORED_SQL + "SELECT doc_id, skill FROM scored")
def _(spark, d):
    rows = _classified(spark, d, (c.RELEVANCE_HITS,))
    return rows.select("doc_id", sc.skill_match(F.col(c.RELEVANCE_HITS), RULES).alias("skill"))


@query("positive_bonus", SCORED_SQL + "SELECT doc_id, pos FROM scored")
def _(spark, d):
    rows = _classified(spark, d, (c.RELEVANCE_HITS,))
    return rows.select("doc_id", sc.positive_bonus(F.col(c.RELEVANCE_HITS), RULES).alias("pos"))


@query(
    "recency_bonus",
    """WITH a AS (SELECT o_orderkey, greatest(0, (epoch_us(TIMESTAMP '2001-08-02') - epoch_us(o_orderdate)) / 86400000000.0) AS age
         FROM orders)
       SELECT o_orderkey, CASE WHEN age <= 3 THEN 10.0 WHEN age <= 7 THEN 5.0 WHEN age <= 14 THEN 2.0 ELSE 0.0 END::DOUBLE AS bonus
       FROM a""",
)
def _(spark, d):
    age = age_days(F.col("o_orderdate").cast("timestamp"), utc_timestamp("2001-08-02"))
    return table(spark, d, "orders").select("o_orderkey", sc.recency_bonus(age, 10).alias("bonus"))


@query("contract_guess", SCORED_SQL + "SELECT doc_id, guess FROM scored")
def _(spark, d):
    rows = _classified(spark, d, (c.RELEVANCE_HITS,))
    return rows.select("doc_id", sc.contract_guess(F.col(c.RELEVANCE_HITS), RULES).alias("guess"))


@query(
    "contract_precedence",
    SCORED_SQL
    + "SELECT doc_id, CASE WHEN stated_contract <> 'unclear' THEN stated_contract ELSE guess END AS contract FROM scored",
)
def _(spark, d):
    rows = _classified(spark, d, (c.RELEVANCE_HITS,))
    guess = sc.contract_guess(F.col(c.RELEVANCE_HITS), RULES)
    return rows.select("doc_id", sc.resolve_contract(F.col("contract_type_guess"), guess).alias("contract"))


@query(
    "trivial",
    SCORED_SQL
    + """SELECT doc_id, 0 AS score, confidence, 'unclear' AS contract,
       CASE WHEN bucket = 'excluded' THEN 'not ranked: excluded (' || reason || ')'
            ELSE 'not ranked: irrelevant to profile' END AS why FROM scored WHERE NOT rankable""",
)
def _(spark, d):
    rows = _classified(spark, d).filter(~sc.rankable(F.col("eligibility_bucket"), F.col("is_relevant")))
    result = sc.trivial_result(F.col("eligibility_bucket"), F.col("eligibility_reason"), F.col("is_relevant"))
    return rows.select("doc_id", result.alias("r")).select(
        "doc_id",
        "r.score",
        F.col("r.eligibility_confidence").alias("confidence"),
        F.col("r.contract_type_guess").alias("contract"),
        F.get("r.reasons", F.lit(0)).alias("why"),
    )


@query(
    "heuristic_score",
    SCORED_SQL + "SELECT doc_id, score, skill_match, confidence, contract FROM scored",
)
def _(spark, d):
    return scored_documents(spark, d).select(
        "doc_id",
        "score",
        "skill_match",
        F.col("eligibility_confidence").alias("confidence"),
        F.col("contract_type_guess").alias("contract"),
    )


def _sql_said(text: str, hits: str) -> str:
    return f"CASE WHEN {hits} IS NOT NULL THEN '{text}[''' || array_to_string({hits}, ''', ''') || ''']' END"


_SQL_WHY = f"""whys AS (SELECT *, CASE WHEN NOT rankable THEN [CASE WHEN bucket = 'excluded' THEN 'not ranked: excluded (' || reason || ')'
        ELSE 'not ranked: irrelevant to profile' END] ELSE list_filter([
        {_sql_said("keyword group ''articles'' matched (weight 3.0): ", "ga")},
        {_sql_said("keyword group ''joins'' matched (weight 2.0): ", "gj")},
        {_sql_said("keyword group ''others'' matched (weight 1.0): ", "go")},
        {_sql_said("title matches role target(s): ", "target_hits")},
        {_sql_said("positive signals: ", "pos_hits")},
        CASE WHEN age <= 14 THEN 'posted ' || printf('%.1f', round(age, 1)) || ' days ago' || CASE WHEN age <= 3 THEN ' (recent)' ELSE '' END END,
        {_sql_said("skill match: ", "skill_hits")}], lambda x: x IS NOT NULL) END AS why,
      CASE WHEN NOT rankable THEN [] ELSE list_filter([
        CASE WHEN bucket = 'needs_review' THEN 'needs_review bucket: eligibility ambiguous, score penalized' END,
        CASE WHEN skill_hits IS NULL THEN 'no core skills from profile found in description' END], lambda x: x IS NOT NULL) END AS flags FROM scored)"""


@query(
    "reasons",
    SCORED_SQL + f", {_SQL_WHY} SELECT doc_id, len(why) AS n, array_to_string(why, '; ') AS reasons, array_to_string(flags, '; ') AS red_flags FROM whys",
)
def _(spark, d):
    return scored_documents(spark, d).select(
        "doc_id", F.size("reasons").alias("n"), F.array_join("reasons", "; ").alias("reasons"), F.array_join("red_flags", "; ").alias("red_flags")
    )


_RULE_LISTS = {
    "exclude_phrases": RULES.exclude,
    "hybrid_onsite_phrases": RULES.hybrid_onsite,
    "remote_indicator_phrases": RULES.remote_indicator,
    "needs_review_phrases": RULES.needs_review,
    "positive_phrases": RULES.positive,
    "relevance_keywords": RULES.relevance,
    "relevance_keywords_weak": RULES.relevance_weak,
    "non_role_title_phrases": RULES.non_role_title,
    "role_targets": RULES.role_targets,
    "core_skills": RULES.core_skills,
    **{f"keyword_groups:{g.name}": g.phrases for g in RULES.keyword_groups},
}


@query(
    "rule_tables",
    f"WITH {sql_rule_values(_RULE_LISTS)}, {POSTINGS_SQL}, {sql_hits('h', 'postings', 'doc_id', 'title')} "
    "SELECT split_part(list_name, ':', 1) AS list_name, split_part(list_name, ':', 2) AS group_name, r.phrase, norm AS phrase_norm, pos AS ord, "
    "count(DISTINCT doc_id) AS titles FROM rules r LEFT JOIN h ON h.phrase = norm GROUP BY ALL",
)
def _(spark, d):
    """All rules in long form, each with the number of document titles it fires in."""
    from rolefunnel.functions.text import tokens

    docs = documents_as_postings(spark, d, ["doc_id", "title"]).select("doc_id", tokens(F.col("title")).alias("w"))
    phrases = [p for group in _RULE_LISTS.values() for p in group]
    fired = docs.select("doc_id", F.explode(ph.phrase_hits(F.col("w"), phrases, RULES.negation)).alias("phrase_norm"))
    counts = fired.groupBy("phrase_norm").agg(F.count("*").alias("titles"))
    return rule_table(spark, RULES).join(counts, "phrase_norm", "left").select(
        "list_name", "group_name", "phrase", "phrase_norm", "ord", F.coalesce("titles", F.lit(0)).alias("titles")
    )


# --- report tables ---------------------------------------------------------------------


@query(
    "top_n",
    SCORED_SQL
    + """SELECT dedup_key, score FROM scored WHERE shown IN ('eligible', 'needs_review')
       ORDER BY score DESC, dedup_key LIMIT 20""",
)
def _(spark, d):
    return rp.top_n(scored_documents(spark, d), 20).select("dedup_key", "score")


@query(
    "score_threshold",
    SCORED_SQL + "SELECT doc_id, score FROM scored WHERE shown IN ('eligible', 'needs_review') AND score >= 30",
)
def _(spark, d):
    return rp.above_threshold(scored_documents(spark, d), 30).select("doc_id", "score")


@query(
    "faceted_filter",
    SCORED_SQL + "SELECT doc_id, score FROM scored WHERE shown = 'eligible' AND source = 'src3' AND score >= 10",
)
def _(spark, d):
    rows = rp.faceted(scored_documents(spark, d), bucket="eligible", source="src3", min_score=10)
    return rows.select("doc_id", "score")


@query("facets", "SELECT DISTINCT source FROM documents")
def _(spark, d):
    return rp.facet_values(table(spark, d, "documents"), "source")


@query(
    "ordered_scan",
    SCORED_SQL + "SELECT dedup_key, score, row_number() OVER (ORDER BY score DESC, dedup_key) AS place FROM scored",
)
def _(spark, d):
    """Every row in global score order; the place is given by the range-sorted position."""
    from rolefunnel.operators.store import ordered
    from rolefunnel.plans.catalog.base import with_place

    return with_place(ordered(scored_documents(spark, d).select("dedup_key", "score"), "score DESC, dedup_key ASC"))


@query(
    "audit_report",
    SCORED_SQL
    + f""", {_SQL_WHY} SELECT score, shown AS bucket, source, title, company, url, contract,
       strftime(make_timestamp(1706659200000000 - (doc_id % 20) * 17 * 3600000000), '%Y-%m-%d') AS posted,
       coalesce(nullif(array_to_string(why, '; '), ''), reason, '') AS reasons, array_to_string(flags, '; ') AS red_flags FROM whys""",
)
def _(spark, d):
    return rp.audit_table(scored_documents(spark, d))


@query(
    "console_table",
    SCORED_SQL
    + """SELECT score, shown AS bucket, source, CASE WHEN length(title) > 45 THEN left(title, 44) || '…' ELSE title END AS title,
       company, contract FROM scored WHERE shown IN ('eligible', 'needs_review') AND score >= 30
       ORDER BY score DESC, dedup_key LIMIT 20""",
)
def _(spark, d):
    return rp.console_table(rp.top_n(scored_documents(spark, d), 20, 30))


_BIG_NEGATION = Negation(words=("old",), window=2)


def _name_runs(spark, d):
    """Names of one to four parts in a row as phrases: four for every part."""
    parts = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("n0"))
    names = parts
    for k in range(1, 4):
        names = names.join(parts.select((F.col("p_partkey") - k).alias("p_partkey"), F.col("n0").alias(f"n{k}")), "p_partkey", "left")
    runs = F.array(*[F.concat_ws(" ", *[f"n{j}" for j in range(k + 1)]) for k in range(4)])
    return names.select(F.explode(runs).alias("phrase")).distinct()


def _ordered_parts(spark, d):
    """The names of an order's parts, line by line, as its text."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_name"))).alias("names"))
    return rows.select("l_orderkey", F.array_join(F.transform("names", lambda n: n["p_name"]), " ").alias("text"))


@query(
    "phrase_table_join",
    """WITH n AS (SELECT a.p_name AS n0, b.p_name AS n1, c.p_name AS n2, e.p_name AS n3 FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey + 1
         LEFT JOIN part c ON c.p_partkey = a.p_partkey + 2 LEFT JOIN part e ON e.p_partkey = a.p_partkey + 3),
    r AS (SELECT DISTINCT unnest([concat_ws(' ', n0), concat_ws(' ', n0, n1), concat_ws(' ', n0, n1, n2), concat_ws(' ', n0, n1, n2, n3)]) AS phrase FROM n),
    t AS (SELECT l_orderkey, string_split(string_agg(p_name, ' ' ORDER BY l_linenumber, l_partkey), ' ') AS w FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
    g AS (SELECT DISTINCT l_orderkey, array_to_string(w[i:i + k - 1], ' ') AS phrase
          FROM (SELECT l_orderkey, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM t, (SELECT unnest([2, 4, 6, 8]) AS k) WHERE len(w) >= k)
          WHERE NOT coalesce(list_contains(w[greatest(i - 2, 1):i - 1], 'old'), false) OR i = 1)
    SELECT l_orderkey, phrase FROM g JOIN r USING (phrase)""",
)
def _(spark, d):
    """Orders whose line of parts holds one of tens of thousands of phrases, none after the word that negates."""
    return phrase_hits_joined(_ordered_parts(spark, d), "l_orderkey", F.col("text"), _name_runs(spark, d), _BIG_NEGATION)
