"""Duplicate keys, exact and fuzzy duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolefunnel.functions.text import normalize_text
from rolefunnel.operators import dedupe as dd
from rolefunnel.plans.catalog.base import query, sql_norm, sql_normalize_url, table, title_of


def _pages_as_postings(spark, d):
    return table(spark, d, "pages").select(
        F.col("page_id").alias("ord"),
        F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title"),
        F.lit("c").alias("company"),
        F.col("html").alias("description"),
        F.when(F.col("page_id") % 11 == 0, "").otherwise(F.regexp_replace("url", r"/[^/]*$", "")).alias("url"),
        F.concat(F.lit("s"), (F.col("page_id") % 3).cast("string")).alias("source"),
        F.when(F.col("page_id") % 2 == 0, F.col("page_id").cast("string")).alias("source_id"),
        F.array(
            F.concat(F.lit("m"), (F.col("page_id") % 4).cast("string")),
            F.concat(F.lit("k"), (F.col("page_id") % 3).cast("string")),
        ).alias("tags"),
    )


_SQL_PAGES = rf"""
  b AS (SELECT page_id, html, CASE WHEN page_id % 11 = 0 THEN '' ELSE regexp_replace(url, '/[^/]*$', '') END AS url,
          's' || page_id % 3 AS source, CASE WHEN page_id % 2 = 0 THEN page_id::VARCHAR END AS source_id,
          'page ' || page_id AS title, ['m' || page_id % 4, 'k' || page_id % 3] AS tags FROM pages),
  n AS (SELECT *, CASE WHEN url = '' THEN '' ELSE {sql_normalize_url('url')} END AS norm FROM b)"""


@query(
    "dedup_key",
    f"""WITH {_SQL_PAGES} SELECT page_id, CASE WHEN norm <> '' THEN norm ELSE source || ':' || coalesce(source_id, title) END AS dedup_key FROM n""",
)
def _(spark, d):
    return dd.with_dedup_key(_pages_as_postings(spark, d)).select(F.col("ord").alias("page_id"), "dedup_key")


@query(
    "exact_dedupe",
    f"""WITH {_SQL_PAGES},
    k AS (SELECT *, CASE WHEN norm <> '' THEN norm ELSE 'row:' || page_id END AS ck FROM n),
    r AS (SELECT *, min(page_id) OVER (PARTITION BY ck) AS first_id, count(*) OVER (PARTITION BY ck) AS members,
             row_number() OVER (PARTITION BY ck ORDER BY length(html) DESC, page_id) AS rn FROM k),
    t AS (SELECT ck, list_sort(list(DISTINCT tag)) AS u FROM (SELECT ck, unnest(tags) AS tag FROM k) GROUP BY ck)
    SELECT first_id AS ord, title, length(html) AS chars,
           array_to_string(CASE WHEN members > 1 THEN u ELSE tags END, ',') AS tags
    FROM r JOIN t USING (ck) WHERE rn = 1""",
)
def _(spark, d):
    rows = dd.exact_dedupe(_pages_as_postings(spark, d))
    return rows.select(
        "ord", "title", F.length("description").cast("bigint").alias("chars"), F.array_join("tags", ",").alias("tags")
    )


@query(
    "survivor_merge",
    f"""WITH n AS (SELECT doc_id, {sql_norm('text')} AS ck, length(text) AS chars, [lang, source] AS tags FROM documents),
    r AS (SELECT *, min(doc_id) OVER (PARTITION BY ck) AS first_id, count(*) OVER (PARTITION BY ck) AS members,
             row_number() OVER (PARTITION BY ck ORDER BY chars DESC, doc_id) AS rn FROM n),
    t AS (SELECT ck, list_sort(list(DISTINCT tag)) AS u FROM (SELECT ck, unnest(tags) AS tag FROM n) GROUP BY ck)
    SELECT first_id AS ord, doc_id, chars, array_to_string(CASE WHEN members > 1 THEN u ELSE tags END, ',') AS tags
    FROM r JOIN t USING (ck) WHERE rn = 1""",
)
def _(spark, d):
    docs = table(spark, d, "documents").withColumns({"ord": F.col("doc_id"), "tags": F.array("lang", "source")})
    members = docs.select(
        "ord", F.sha2(normalize_text(F.col("text")), 256).alias("cluster"), F.length("text").alias("len"), "tags"
    )
    merged = dd.merge_survivors(docs.select("ord", "doc_id", "n_chars", "text", "tags"), dd.cut_lineage(members))
    return merged.select(
        "ord", "doc_id", F.length("text").cast("bigint").alias("chars"), F.array_join("tags", ",").alias("tags")
    )


_SQL_COMPANY = "p_brand || CASE p_partkey % 3 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' Co & Sons' ELSE '' END"
_SQL_ROLE = "CASE WHEN p_partkey % 2 = 0 THEN 'Sr. ' ELSE 'Jr ' END || p_name"


@query(
    "fuzzy_keys",
    f"""WITH k AS (SELECT p_partkey,
        array_to_string(list_filter(string_split({sql_norm(_SQL_COMPANY)}, ' '), lambda x: x NOT IN ('inc', 'llc', 'ltd', 'gmbh', 'corp', 'corporation', 'co')), ' ') AS company_key,
        array_to_string(list_transform(string_split({sql_norm(_SQL_ROLE)}, ' '), lambda x: CASE x WHEN 'sr' THEN 'senior' WHEN 'jr' THEN 'junior' ELSE x END), ' ') AS title_key
        FROM part) SELECT p_partkey, company_key, company_key || ' ' || title_key AS full_key FROM k""",
)
def _(spark, d):
    kind = F.col("p_partkey") % 3
    company = F.concat("p_brand", F.when(kind == 0, " Inc.").when(kind == 1, " Co & Sons").otherwise(""))
    title = F.concat(F.when(F.col("p_partkey") % 2 == 0, "Sr. ").otherwise("Jr "), "p_name")
    return table(spark, d, "part").select(
        "p_partkey", dd.company_key(company).alias("company_key"), dd.fuzzy_key(company, title).alias("full_key")
    )


@query(
    "role_id_guard",
    """SELECT p_partkey, p_partkey % 5 = 0 OR p_partkey % 4 IN (0, 1) AS guarded FROM part""",
)
def _(spark, d):
    key = F.col("p_partkey")
    source = F.when(key % 5 == 0, "jobicy").otherwise("remotive")
    text = key.cast("string")
    source_id = (
        F.when(key % 4 == 0, F.concat(text, F.lit(":bullet:"), text))
        .when(key % 4 == 1, F.concat(F.lit("registry:lever:acme:lever:"), text))
        .when(key % 4 == 2, F.concat(text, F.lit(":other:1")))
    )
    return table(spark, d, "part").select("p_partkey", dd.has_role_id(source, source_id).alias("guarded"))


def _documents_for_fuzzy(spark, d):
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("ord"),
        F.left(title_of(), F.lit(80)).alias("title"),
        F.col("lang").alias("company"),
        F.col("text").alias("description"),
        F.lit("").alias("url"),
        "source",
        F.col("doc_id").cast("string").alias("source_id"),
        F.array("lang", "source").alias("tags"),
    )


# The ratio in SQL: the longest common block of a window (earliest first), then the
# windows to its left and right.  The edit distance bound keeps the pairs few.
# Company keys are two-letter codes here: a ratio of one half is one shared letter.
_SQL_FUZZY_PAIRS = f"""
WITH RECURSIVE k AS (SELECT doc_id, lang AS c, array_to_string(list_transform(string_split({sql_norm('left(split_part(text, chr(10), 1), 80)')}, ' '),
         lambda x: CASE x WHEN 'sr' THEN 'senior' WHEN 'jr' THEN 'junior' ELSE x END), ' ') AS t FROM documents),
nodes AS (SELECT c, CASE WHEN t = '' THEN c ELSE c || ' ' || t END AS key, min(doc_id) AS node FROM k GROUP BY ALL),
cand AS (SELECT a.node AS a, b.node AS b, a.key AS ka, b.key AS kb FROM nodes a JOIN nodes b ON a.node > b.node
   AND least(length(a.key), length(b.key)) >= greatest(length(a.key), length(b.key)) * 0.785
   AND (contains(b.c, a.c[1]) OR contains(b.c, a.c[2]))
   AND levenshtein(a.key, b.key) <= (length(a.key) + length(b.key)) * 0.1200001),
runs AS (SELECT a, b, i, j, len(list_filter(range(1, 90), lambda n: i + n - 1 <= length(ka) AND j + n - 1 <= length(kb)
             AND substr(ka, i, n) = substr(kb, j, n))) AS n
   FROM cand, unnest(range(1, length(ka) + 1)) AS x(i), unnest(range(1, length(kb) + 1)) AS y(j) WHERE ka[i] = kb[j]),
w(a, b, alo, ahi, blo, bhi, m) AS (
   SELECT a, b, 1::BIGINT, length(ka) + 1, 1::BIGINT, length(kb) + 1, 0::BIGINT FROM cand
   UNION ALL
   SELECT s.a, s.b, CASE side WHEN 0 THEN alo ELSE p.i + p.n END, CASE side WHEN 0 THEN p.i ELSE ahi END,
          CASE side WHEN 0 THEN blo ELSE p.j + p.n END, CASE side WHEN 0 THEN p.j ELSE bhi END, CASE side WHEN 0 THEN p.n ELSE 0 END
   FROM (SELECT w.a, w.b, alo, ahi, blo, bhi, max(row(least(n, ahi - i, bhi - j), -i, -j)) AS best
         FROM w JOIN runs r ON r.a = w.a AND r.b = w.b AND i >= alo AND i < ahi AND j >= blo AND j < bhi
         GROUP BY w.a, w.b, alo, ahi, blo, bhi) s,
        LATERAL (SELECT best[1] AS n, -best[2] AS i, -best[3] AS j) p, (VALUES (0), (1)) v(side)),
total AS (SELECT a, b, sum(m) AS m FROM w GROUP BY a, b)
SELECT a, b, round(2.0::DOUBLE * m / (length(ka) + length(kb)), 6) AS similarity
FROM total JOIN cand USING (a, b) WHERE 2.0::DOUBLE * m / (length(ka) + length(kb)) >= 0.88"""


@query("fuzzy_pairs", _SQL_FUZZY_PAIRS)
def _(spark, d):
    """Pairs of distinct (company, title) keys at or above the threshold."""
    nodes = dd.cut_lineage(dd.fuzzy_nodes(dd._slim(_documents_for_fuzzy(spark, d))))
    return dd.fuzzy_pairs(nodes).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("fuzzy_dedupe")
def _(spark, d):
    """The whole duplicate removal; tested against a sequential scan in Python."""
    rows = dd.dedupe(_documents_for_fuzzy(spark, d))
    return rows.select("ord", "dedup_key", "title", F.array_join("tags", ",").alias("tags"))


@query("fuzzy_dedupe_catalog")
def _(spark, d):
    """The same over parts (brand and name): a few hundred words give many near copies."""
    parts = table(spark, d, "part").select(
        F.col("p_partkey").alias("ord"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("company"),
        F.col("p_type").alias("description"),
        F.lit("").alias("url"),
        F.lit("parts").alias("source"),
        F.lit(None).cast("string").alias("source_id"),
        F.array("p_type").alias("tags"),
    )
    return dd.dedupe(parts).select("ord", "title", "company", F.array_join("tags", ",").alias("tags"))
