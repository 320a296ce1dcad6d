"""The queries of this subpackage, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefunnel.llm import backoff, collocations, decontaminate, language, ledger, merkle, packing, pieces, quality, repeats, simhash, spotsigs, toxicity
from rolefunnel.llm.common import fold_of, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Scores from here on count as label 1.
CUT = 0.3


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _classified(scores: DataFrame, folds: int, held: int) -> DataFrame:
    return scores.select(
        F.col("id").alias("doc_id"), (fold_of("id", folds) == held).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )


@register("op2_quality_rules")
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document by a rule ensemble learned outside fold 0 of 5."""
    scores = quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"), fold_of("id", 5) != 0)
    return _classified(scores, 5, 0)


@register("op6_toxicity_kneser_ney")
def op6_toxicity_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document by two bigram models learned outside fold 2 of 4."""
    scores = toxicity.toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"), fold_of("id", 4) != 2)
    return _classified(scores, 4, 2)


@register("op5_simhash_popcount")
def op5_simhash_popcount(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


@register(
    "op4_positional_index",
    r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS p
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS p
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
hits AS (SELECT doc_id, item_id, dw.k, i FROM dw JOIN win ON dw.p = win.p AND dw.k = win.k),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)""",
)
def op4_positional_index(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows of ten words in every document."""
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
    )


@register("op8_pieces_viterbi")
def op8_pieces_viterbi(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document, and the checksum of what they decode to."""
    found = pieces.encode_and_decode(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "ids", F.size("ids").alias("n_ids"), F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op1_packed_ids")
def op1_packed_ids(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as rows of 2,048 token ids."""
    return packing.pack(table(spark, folder, "documents"))


@register("op7_language_crf")
def op7_language_crf(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document by a random field learned outside fold 1 of 3."""
    found = language.document_languages(table(spark, folder, "documents"), fold_of("id", 3) != 1)
    return found.select(F.col("id").alias("doc_id"), (fold_of("id", 3) == 1).alias("held_out"), "lang_pred", "score")


def _spotsigs_sql() -> str:
    stops = ", ".join(f"'{a}'" for a in spotsigs.ANCHORS)

    def sigs(name: str, text: str) -> str:
        words = rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
        return f"""
{name}_w AS (SELECT doc_id, {words} AS w FROM t),
{name}_c AS (SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(stops, w[i])) AS c FROM {name}_w, s),
{name}_k AS (SELECT doc_id, list_transform(range(1, len(c) + 1), lambda k:
    CASE WHEN c[k] > 1 AND list_contains(stops, w[c[k] - 1]) THEN left(md5(w[c[k] - 1] || '_' || w[c[k]] || coalesce(' ' || w[c[k + 1]], '')), 8) END) AS a,
    list_transform(range(1, len(c) + 1), lambda k: left(md5(w[c[k]] || coalesce(' ' || w[c[k + 1]], '')), 8)) AS b FROM {name}_c, s),
{name} AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(list_filter(a, lambda x: x IS NOT NULL)) > 0 THEN list_filter(a, lambda x: x IS NOT NULL) ELSE b END)) AS g FROM {name}_k)"""

    like = lambda a, b: f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 ELSE CAST(len(list_intersect({a}, {b})) AS DOUBLE) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"
    return f"""
WITH s AS (SELECT [{stops}] AS stops),
d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
n AS (SELECT doc_id, x, coalesce(lead(x) OVER (ORDER BY doc_id DESC), first_value(x) OVER (ORDER BY doc_id DESC)) AS y FROM d),
t AS (SELECT doc_id, x, y, left(x, length(x) - length(x) // 3) || left(y, length(x) // 3) AS e FROM n),{sigs("own", "x")},{sigs("changed", "e")},{sigs("following", "y")}
SELECT t.doc_id, CAST(length(x) AS BIGINT) AS n_chars, sha256(e) AS edited_sha256, array_to_string(own.g, '') AS fingerprint, array_to_string(changed.g, '') AS edited_fingerprint,
       {like("own.g", "changed.g")} AS near_edited, {like("own.g", "following.g")} AS near_next
FROM t JOIN own USING (doc_id) JOIN changed USING (doc_id) JOIN following USING (doc_id)"""


@register("op9_spotsigs", _spotsigs_sql())
def op9_spotsigs(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    found = spotsigs.fingerprints(table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.fingerprint(F.col("own")).alias("fingerprint"),
        spotsigs.fingerprint(F.col("changed")).alias("edited_fingerprint"),
        spotsigs.likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        spotsigs.likeness(F.col("own"), F.col("following")).alias("near_next"),
    )


@register(
    "op3_stupid_backoff",
    r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT doc_id, w[i] AS w, CASE WHEN i > 1 THEN w[i - 1] ELSE '' END AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
one AS (SELECT w, count(*) AS c FROM t GROUP BY w UNION ALL SELECT '', count(*) FROM d WHERE len(w) > 0),
two AS (SELECT v, w, count(*) AS c FROM t GROUP BY v, w),
s AS (SELECT doc_id, CASE WHEN two.c IS NOT NULL THEN ln(two.c / a.c) ELSE ln(0.4 * b.c / (SELECT count(*) FROM t)) END AS x
      FROM t JOIN one a ON a.w = t.v JOIN one b ON b.w = t.w LEFT JOIN two ON two.v = t.v AND two.w = t.w)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, round(coalesce(avg(x), 0.0), 6) AS score
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id, len(d.w)""",
)
def op3_stupid_backoff(spark: SparkSession, folder: str) -> DataFrame:
    """Mean log score per word of every document against the bigrams of all documents."""
    found = backoff.backoff_scores(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", F.round(F.col("total") / F.greatest("n_words", F.lit(1)), 6).alias("score"))


@register("op10_run_length_repeats")
def op10_run_length_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """What removing earlier strings of 100 bytes leaves of every document."""
    found = repeats.remove_repeats(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _merkle_sql() -> str:
    mark = lambda x: f"coalesce(CAST(strlen(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"
    row = lambda n: "sha256(" + " || ".join(mark(x) for x in ("doc_id", "source", "lang", n, "text")) + ")"
    # crc32: every byte, then eight shifts of one bit.
    steps = "list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: [ord(d), -1, -1, -1, -1, -1, -1, -1, -1])))"
    crc = f"xor(list_reduce(CAST({steps} AS BIGINT[]), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"
    climb = lambda t: f"SELECT g, lvl + 1, pos // 2, any_value(n), sha256(string_agg(h, '' ORDER BY pos)) FROM {t} WHERE n > 2 ** lvl GROUP BY g, lvl, pos // 2"
    return f"""
WITH RECURSIVE d AS (SELECT *, coalesce('=' || lang, '') AS g, {crc} % 7 = 0 AS tampered FROM documents),
l AS (SELECT doc_id, g, {row("n_chars")} AS leaf, CASE WHEN tampered THEN {row("n_chars + 1")} ELSE {row("n_chars")} END AS seen FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM l),
t AS (SELECT g, 0 AS lvl, pos, n, leaf AS h FROM p UNION ALL {climb("t")}),
s AS (SELECT g, h FROM t WHERE n <= 2 ** lvl),
q AS (SELECT g AS lang, '' AS g, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM s),
u AS (SELECT g, 0 AS lvl, pos, n, h FROM q UNION ALL {climb("u")}),
lower_steps AS (SELECT doc_id, lvl, t.h, ((p.pos >> t.lvl) & 1) = 1 AS after FROM p JOIN (SELECT unnest(range(0, 64)) AS k) x ON p.n > 2 ** k
  LEFT JOIN t ON t.g = p.g AND t.lvl = k AND t.pos = xor(p.pos >> k, 1) WHERE t.h IS NOT NULL
  UNION ALL SELECT doc_id, k, '', false FROM p JOIN (SELECT unnest(range(0, 64)) AS k) x ON p.n > 2 ** k ANTI JOIN t ON t.g = p.g AND t.lvl = k AND t.pos = xor(p.pos >> k, 1)),
upper_steps AS (SELECT doc_id, 100 + k AS lvl, coalesce(u.h, '') AS h, ((q.pos >> k) & 1) = 1 AS after FROM p JOIN q ON q.lang = p.g JOIN (SELECT unnest(range(0, 64)) AS k) x ON q.n > 2 ** k
  LEFT JOIN u ON u.lvl = k AND u.pos = xor(q.pos >> k, 1)),
steps AS (SELECT doc_id, h, after, row_number() OVER (PARTITION BY doc_id ORDER BY lvl) AS k FROM (FROM lower_steps UNION ALL FROM upper_steps)),
f AS (SELECT doc_id, 0 AS k, seen AS h FROM l UNION ALL
  SELECT f.doc_id, f.k + 1, sha256(CASE WHEN after THEN s.h || f.h ELSE f.h || s.h END) FROM f JOIN steps s ON s.doc_id = f.doc_id AND s.k = f.k + 1),
e AS (SELECT doc_id, arg_max(h, k) AS folded_root FROM f GROUP BY doc_id),
proofs AS (SELECT doc_id, sha256(string_agg(h, '' ORDER BY k)) AS proof FROM steps GROUP BY doc_id)
SELECT p.doc_id, leaf, s.h AS subroot, r.h AS root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = r.h AS verified
FROM p JOIN s ON s.g = p.g JOIN e ON e.doc_id = p.doc_id LEFT JOIN proofs ON proofs.doc_id = p.doc_id, (SELECT h FROM u WHERE n <= 2 ** lvl) r"""


@register("op11_merkle_slots", _merkle_sql())
def op11_merkle_slots(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest of all documents, and whether each, some with a count changed by one, still folds to its root."""
    docs = table(spark, folder, "documents")
    tampered = F.when(fold_of("doc_id", 7) == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = merkle.manifest(docs, claimed={"n_chars": tampered}).withColumn("folded_root", merkle.fold(F.coalesce("claimed", "leaf"), F.col("path")))
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


#: The version of the policy that counts now.
POLICY = "2"


def _ledger_sql() -> str:
    fails = {r.name: r.fails for r in ledger.RULES}
    bits = " + ".join(f"CASE WHEN {r.fails} THEN {r.value} ELSE 0 END" for r in ledger.RULES)
    verdict = " OR ".join(f"({fails[n]})" for n in ledger.POLICIES[POLICY])
    alone = " ".join(f"WHEN failed & {ledger.mask(ledger.POLICIES[POLICY])} = {r.value} THEN '{r.name}'" for r in ledger.RULES)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
x AS (SELECT *, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^ 	-
]')) AS ls,
      list_transform(range(1, len(w) - 6), lambda i: w[i:i + 7]) AS v FROM d),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS times FROM (SELECT doc_id, unnest(v) AS g, unnest(range(1, len(v) + 1)) AS i FROM x)),
again AS (SELECT doc_id, count(DISTINCT j) AS c FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM win WHERE times > 1) GROUP BY doc_id),
m AS (SELECT x.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda a: length(a))), 0) AS BIGINT) AS word_chars,
      CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
      CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words FROM x LEFT JOIN again USING (doc_id)),
b AS (SELECT *, CAST({bits} AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {" OR ".join(f"({fails[n]})" for n in ledger.BASE)} AS base_failed,
       NOT ({verdict}) AS kept, failed, CASE {alone} END AS decisive_rule, '{POLICY}' AS policy FROM b"""


@register("op13_rule_ledger", _ledger_sql())
def op13_rule_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Measurements and failed rules of every document, and its verdict under the policy that counts now."""
    names = ledger.POLICIES[POLICY]
    found = ledger.ledger(table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~ledger.kept(ledger.BASE)).alias("base_failed"),
        ledger.kept(names).alias("kept"),
        "failed",
        ledger.decisive(names).alias("decisive_rule"),
        F.lit(POLICY).alias("policy"),
    )


@register(
    "op12_fingerprint_phrases",
    r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k) GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 30),
cuts AS (SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS j FROM c),
s AS (SELECT cuts.lang, cuts.phrase, cuts.a, j, x.a AS l, y.a AS r, CAST(2000000 * CAST(cuts.a AS HUGEINT) // (x.a + y.a) AS BIGINT) AS score
      FROM cuts JOIN f x ON x.lang = cuts.lang AND x.k = j AND x.phrase = array_to_string(w[1:j], ' ')
                JOIN f y ON y.lang = cuts.lang AND y.k = cuts.k - j AND y.phrase = array_to_string(w[j + 1:], ' ')),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_part AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
      FROM (SELECT lang, w, k, a, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k) GROUP BY ALL),
ranked AS (SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank
      FROM best LEFT JOIN inner_part i ON i.lang = best.lang AND i.phrase = best.phrase WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
)
def op12_fingerprint_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The best collocations of each language of all documents."""
    return collocations.collocations(table(spark, folder, "documents"))
