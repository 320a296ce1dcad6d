"""Duplicate removal: exact by canonical URL, then fuzzy by company and title.

Fuzzy stage.  Rows are reduced to distinct (source class, company key, full key)
nodes; candidate pairs come from an equi-join on key segments that cannot miss
a pair at the threshold; an Arrow UDF computes the exact ratio for the
candidates; leaders are then picked in arrival order, which is what a
sequential first-match scan does.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from rolefunnel.functions.constants import const_map
from rolefunnel.functions.text import tokens
from rolefunnel.functions.urls import normalize_url
from rolefunnel.operators.barrier import add_once
from rolefunnel.operators.rare_parts import entry_turns
from rolefunnel.session import cut_lineage, shuffles_released

# Thresholds and word lists results depend on.
FUZZY_THRESHOLD = 0.88
MIN_COMPANY_SIMILARITY = 0.5
COMPANY_SUFFIXES = ["inc", "llc", "ltd", "gmbh", "corp", "corporation", "co"]
TITLE_ABBREVIATIONS = {"sr": "senior", "jr": "junior"}
UNIQUE_ROLE_SOURCES = ["himalayas", "jobicy", "arbeitnow", "weworkremotely"]
ROLE_ID_PATTERN = r":(?:ashby|greenhouse|lever|workable|recruitee|personio|bullet):"

#: Nodes whose entries are on disk together, and turns at most, since all keys are cut anew in each: no result depends on them.
TURN_NODES = 50_000
MOST_TURNS = 4


def dedup_key(url: Column, source: Column, source_id: Column, title: Column) -> Column:
    """Canonical URL, else ``source:source_id``, else ``source:title``."""
    local = F.coalesce(F.nullif(source_id, F.lit("")), title)
    return F.coalesce(F.nullif(url, F.lit("")), F.concat_ws(":", source, local))


def company_key(company: Column) -> Column:
    """Company name without its legal suffix words."""
    kept = F.filter(tokens(company), lambda t: ~t.isin(COMPANY_SUFFIXES))
    return F.array_join(kept, " ")


def fuzzy_key(company: Column, title: Column) -> Column:
    """Company key and title with usual abbreviations spelled out."""
    full = const_map(TITLE_ABBREVIATIONS)
    words = F.transform(tokens(title), lambda t: F.coalesce(F.element_at(full, t), t))
    return F.array_join(F.concat(F.array(company_key(company)), words), " ")


def has_role_id(source: Column, source_id: Column) -> Column:
    """The source itself gave every role its own identity."""
    stamped = F.coalesce(source_id, F.lit("")).rlike(ROLE_ID_PATTERN)
    return stamped | source.isin(UNIQUE_ROLE_SOURCES)


def _slim(df: DataFrame, keep_query_hosts: list[str] | None = None) -> DataFrame:
    """What clustering needs of a row; the wide columns stay behind."""
    guarded = has_role_id(F.col("source"), F.col("source_id"))
    keys = {
        "norm_url": F.nullif(normalize_url(F.col("url"), keep_query_hosts), F.lit("")),
        "src": F.when(guarded, F.col("source")),
        "company_key": company_key(F.col("company")),
        "full_key": fuzzy_key(F.col("company"), F.col("title")),
        "len": F.coalesce(F.length("description"), F.lit(0)),
    }
    return add_once(df, keys).select("ord", *keys, "tags")


def _with_root(slim: DataFrame) -> DataFrame:
    """Add ``root``: the first row with the same canonical URL (itself without one)."""
    repeated = (
        slim.filter(F.col("norm_url").isNotNull())
        .groupBy("norm_url")
        .agg(F.min("ord").alias("first"), F.count("*").alias("n"))
        .filter(F.col("n") > 1)
        .select("norm_url", "first")
    )
    # Rows without a URL have nothing to join and would all meet on one null key.
    some, none = slim.filter(F.col("norm_url").isNotNull()), slim.filter(F.col("norm_url").isNull())
    rooted = some.join(repeated, "norm_url", "left").withColumn("root", F.coalesce("first", "ord")).drop("first")
    return rooted.unionByName(none.withColumn("root", F.col("ord")))


def merge_survivors(df: DataFrame, members: DataFrame) -> DataFrame:
    """Collapse every cluster of ``members`` (ord, cluster, len, tags) to its richest row.

    The longest description wins, ties go to the earlier row; tags become the
    sorted union; ``ord`` becomes that of the first member.  Ids and lengths are
    aggregated first, combined on the map side, so a huge cluster is harmless;
    wide rows then meet one small row each.  Rows alone keep their tags as is.
    """
    summary = members.groupBy("cluster").agg(
        F.max(F.struct("len", (-F.col("ord")).alias("neg"))).alias("best"),
        F.min("ord").alias("_first"),
        F.count("*").alias("size"),
    )
    tags = (
        members.select("cluster", F.explode("tags").alias("tag"))
        .groupBy("cluster")
        .agg(F.sort_array(F.collect_set("tag")).alias("_union"))
    )
    winners = (
        summary.join(tags, "cluster", "left")
        .select(
            (-F.col("best.neg")).alias("ord"),
            "_first",
            F.when(F.col("size") > 1, F.coalesce("_union", F.array().cast("array<string>"))).alias("_union"),
        )
    )
    return (
        df.join(winners, "ord")
        .withColumns({"tags": F.coalesce("_union", "tags"), "ord": F.col("_first")})
        .drop("_first", "_union")
    )


def with_dedup_key(df: DataFrame, keep_query_hosts: list[str] | None = None) -> DataFrame:
    norm = normalize_url(F.col("url"), keep_query_hosts)
    return df.withColumn("dedup_key", dedup_key(norm, F.col("source"), F.col("source_id"), F.col("title")))


def exact_dedupe(df: DataFrame, keep_query_hosts: list[str] | None = None) -> DataFrame:
    """One row per canonical URL; rows without a URL stay as they are."""
    slim = cut_lineage(_slim(df, keep_query_hosts))
    members = _with_root(slim).select("ord", F.col("root").alias("cluster"), "len", "tags")
    return merge_survivors(with_dedup_key(df, keep_query_hosts), members)


# --- fuzzy stage -----------------------------------------------------------------


def fuzzy_nodes(slim: DataFrame) -> DataFrame:
    """Distinct comparable identities with their first arrival as ``node``.

    Rows with equal keys have the same neighbours, so they share one fate and are
    one node, however many copies there are.  ``src`` is the source of rows that
    carry a source-given role id, else null.
    """
    return (
        slim.filter((F.col("company_key") != "") & (F.col("full_key") != ""))
        .groupBy("src", "company_key", "full_key")
        .agg(F.min("ord").alias("node"))
    )


def _unmatched(side: str) -> Column:
    """Characters on one side of a part that cannot be matched: a lower bound, since classes hold several and counts go round."""
    return sum(F.bit_count(F.col(f"l_{side}_{k}").bitwiseXOR(F.col(f"s_{side}_{k}"))) for k in (0, 1))


def candidate_pairs(nodes: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """Pairs (a later, b earlier) that may reach ``threshold``: complete, not exact.

    Lossless filters only.  The longer key is cut into its rarest parts, of which one
    recurs unchanged in the shorter with as many unmatched characters before it as
    there are parts: an equi-join on that part and its place, carrying ids and
    numbers only.  Length ratio, shift, same-source guard and counts of the characters
    on either side thin the pairs inside the join, a bounded edit distance before the
    exact ratio.  Entries take several times the space of their keys: those of many
    nodes are made and joined in turns, and what a turn has shuffled goes with it.
    """
    if not 0.5 < threshold < 1.0:
        raise ValueError("the part join needs a threshold between one half and one")
    turns = max(1, min(MOST_TURNS, -(-nodes.count() // TURN_NODES)))
    if turns == 1:
        return _met(nodes, *next(entry_turns(nodes, threshold, 1)), threshold)
    found = None
    with shuffles_released(nodes.sparkSession):
        for longer, shorter in entry_turns(nodes, threshold, turns):
            part = cut_lineage(_met(nodes, longer, shorter, threshold))
            found = part if found is None else found.union(part)
    return found.distinct()


def _met(nodes: DataFrame, longer: DataFrame, shorter: DataFrame, threshold: float) -> DataFrame:
    """The candidate pairs among entries of ``nodes``."""
    ratio_floor, share = threshold / (2.0 - threshold), 1.0 - threshold
    longer, shorter = (
        rows.select("key", *[F.col(c).alias(f"{side}_{c}") for c in rows.columns if c != "key"])
        for side, rows in (("l", longer), ("s", shorter))
    )
    matched = F.ceil((F.col("l_len") + F.col("s_len")) * (threshold / 2.0) - F.lit(1e-9))
    shift, rest = F.col("l_shift"), F.col("l_len") + F.col("s_len") - 2 * matched - F.col("l_part")
    # Entries are many more than nodes, which the planner cannot know: never to be sent to all tasks.
    met = shorter.join(longer.hint("merge"), "key").filter(
        ((F.col("l_len") > F.col("s_len")) | ((F.col("l_len") == F.col("s_len")) & (F.col("l_node") > F.col("s_node"))))
        & (F.col("s_len") >= F.col("l_len") * ratio_floor - F.lit(1e-9))
        & shift.between(matched - F.col("l_len"), F.col("s_len") - matched)
        & (F.abs(shift + F.col("l_len") - F.col("s_len")) <= rest)
        & ~F.coalesce(F.col("l_src") == F.col("s_src"), F.lit(False))
        & (_unmatched("before") <= F.col("l_part"))
        & (_unmatched("after") <= rest)
    )
    pairs = met.select(
        F.greatest("l_node", "s_node").alias("a"), F.least("l_node", "s_node").alias("b")
    ).distinct()
    keys = nodes.select("node", "company_key", "full_key", F.length("full_key").alias("len"))

    def side(name: str) -> DataFrame:
        return keys.select(*[F.col(c).alias(name if c == "node" else f"{name}_{c}") for c in keys.columns])

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    # Unmatched characters bound the edit distance, which the JVM decides quickly.
    allowed = F.floor((F.col("a_len") + F.col("b_len")) * share + F.lit(1e-9)).cast("int")
    distance = F.call_function("levenshtein", F.col("a_full_key"), F.col("b_full_key"), allowed)
    return both.filter(distance >= 0).drop("a_len", "b_len")


def _similarity_udf():
    # A nested function travels to the workers by value: they need not have this package.
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")

    return F.pandas_udf(ratio, DoubleType())


similarity_ratio = _similarity_udf()


def _with_close_companies(candidates: DataFrame, company_floor: float) -> DataFrame:
    """Candidates whose company keys reach ``company_floor``; the ratio of two companies is computed once."""
    sides = ["a_company_key", "b_company_key"]
    close = candidates.select(*sides).distinct().filter(similarity_ratio(*sides) >= company_floor)
    return candidates.join(close, sides)


def fuzzy_pairs(
    nodes: DataFrame, threshold: float = FUZZY_THRESHOLD, company_floor: float = MIN_COMPANY_SIMILARITY
) -> DataFrame:
    """(a, b, similarity) for node pairs at or above the threshold, a later than b."""
    candidates = cut_lineage(candidate_pairs(nodes, threshold))
    return (
        _with_close_companies(candidates, company_floor)
        .withColumn("similarity", similarity_ratio("a_full_key", "b_full_key"))
        .filter(F.col("similarity") >= threshold)
        .select("a", "b", "similarity")
    )


def similar_nodes(
    nodes: DataFrame, threshold: float = FUZZY_THRESHOLD, company_floor: float = MIN_COMPANY_SIMILARITY
) -> DataFrame:
    """(x, y): a row of node x is similar to an earlier row of node y; the ratio is not quite symmetric."""
    candidates = candidate_pairs(nodes, threshold)
    sides = ["company_key", "full_key"]
    turned = candidates.select(
        F.col("b").alias("a"), F.col("a").alias("b"),
        *[F.col(f"b_{c}").alias(f"a_{c}") for c in sides], *[F.col(f"a_{c}").alias(f"b_{c}") for c in sides],
    )
    both = cut_lineage(candidates.select(turned.columns).union(turned))
    return (
        _with_close_companies(both, company_floor)
        .filter(similarity_ratio("a_full_key", "b_full_key") >= threshold)
        .select(F.col("a").alias("x"), F.col("b").alias("y"))
    )


def _least(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key, first leading and first open unit of its rows)."""
    return rows.groupBy(key).agg(
        F.min(F.when(F.col("state") == "leads", F.col("unit"))).alias(f"{name}_leads"),
        F.min(F.when(F.col("state") == "open", F.col("unit"))).alias(f"{name}_open"),
    )


def _least_near(edges: DataFrame, by_node: DataFrame) -> DataFrame:
    """(node_key, first leading and first open unit among similar nodes)."""
    met = edges.join(by_node.withColumnRenamed("node_key", "y"), "y")
    return met.groupBy(F.col("x").alias("node_key")).agg(
        F.min("node_leads").alias("near_leads"), F.min("node_open").alias("near_open")
    )


def elect_leaders(units: DataFrame, edges: DataFrame) -> DataFrame:
    """``units`` with ``state`` leads or follows: the outcome of one scan in arrival order.

    A unit (unit, url_key, node_key, guarded) follows when an earlier leading unit
    has its URL, its node (unless guarded) or a similar node; else it leads.  Every
    round settles the units none of whose earlier partners is open, or one of which
    leads.  Partners are never paired: URLs, nodes and their neighbours give the
    least place of a leading and of an open unit, which is all a unit has to know.
    """
    def several(key: str, rows: DataFrame) -> DataFrame:
        return rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > 1).select(key)

    near = edges.select(F.col("x").alias("node_key")).union(edges.select("y")).distinct()
    contested = (
        units.join(several("url_key", units), "url_key", "left_semi").select("unit")
        .union(units.join(several("node_key", units.filter(~F.col("guarded"))).union(near).distinct(), "node_key", "left_semi").select("unit"))
        .distinct()
    )
    state = cut_lineage(units.join(contested, "unit", "left_semi").withColumn("state", F.lit("open")))
    settled = units.join(contested, "unit", "left_anti").withColumn("state", F.lit("leads"))
    while not state.filter(F.col("state") == "open").isEmpty():
        by_url, by_node = _least(state, "url_key", "url"), _least(state, "node_key", "node")
        view = (
            state.filter(F.col("state") == "open")
            .join(by_url, "url_key").join(by_node, "node_key").join(_least_near(edges, by_node), "node_key", "left")
        )

        def first(which: str) -> Column:
            own = F.when(~F.col("guarded"), F.col(f"node_{which}"))
            return F.least(F.col(f"url_{which}"), own, F.col(f"near_{which}"))

        now = (
            F.when(first("leads") < F.col("unit"), "follows")
            .when(first("open") < F.col("unit"), "open")
            .otherwise("leads")
        )
        decided = view.select("unit", "url_key", "node_key", "guarded", F.coalesce(now, F.lit("leads")).alias("state"))
        state = cut_lineage(decided.unionByName(state.filter(F.col("state") != "open")))
    return settled.unionByName(state)


def _clusters(slim: DataFrame, threshold: float, company_floor: float) -> DataFrame:
    """(ord, cluster, len, tags): the leading row that every row belongs to.

    A row with the URL of an earlier leading row belongs to it, any other to the
    earliest similar leading row.  Only leading rows stand for their URL: one that
    was merged by similarity does not hand its URL on.
    """
    nodes = cut_lineage(fuzzy_nodes(slim))
    edges = cut_lineage(similar_nodes(nodes, threshold, company_floor))
    same = ["src", "company_key", "full_key"]
    # No key is null: a row without URL or node gets one of its own.
    own = F.concat(F.lit("#"), F.col("ord").cast("string"))
    plain = slim.filter((F.col("company_key") == "") | (F.col("full_key") == "") | F.col("company_key").isNull() | F.col("full_key").isNull())
    named = slim.join(
        nodes.select(*[F.col(c).alias(f"_{c}") for c in same], "node"),
        F.col("src").eqNullSafe(F.col("_src")) & (F.col("company_key") == F.col("_company_key")) & (F.col("full_key") == F.col("_full_key")),
    ).drop(*[f"_{c}" for c in same])
    rows = cut_lineage(
        named.unionByName(plain.withColumn("node", F.lit(None).cast("bigint"))).select(
            "ord", "len", "tags",
            F.coalesce("norm_url", own).alias("url_key"),
            F.coalesce("node", -1 - F.col("ord")).alias("node_key"),
            F.col("src").isNotNull().alias("guarded"),
            # Rows with one URL and node, or one node and no URL, share one fate but for the first.
            F.when(F.col("norm_url").isNotNull(), F.col("norm_url")).when(F.col("src").isNotNull() | F.col("node").isNull(), own).otherwise(F.lit("")).alias("_unit"),
        )
    )
    units = rows.groupBy("node_key", "_unit").agg(F.min("ord").alias("unit"), F.min_by("url_key", "ord").alias("url_key"), F.first("guarded").alias("guarded"))
    state = cut_lineage(elect_leaders(cut_lineage(units.drop("_unit")), edges))
    by_url, by_node = _least(state, "url_key", "url"), _least(state, "node_key", "node")
    found = rows.join(by_url, "url_key", "left").join(by_node, "node_key", "left").join(_least_near(edges, by_node), "node_key", "left")
    similar = F.least(F.when(~F.col("guarded"), F.col("node_leads")), F.col("near_leads"))
    cluster = F.coalesce(
        F.when(F.col("url_leads") <= F.col("ord"), F.col("url_leads")), F.when(similar < F.col("ord"), similar), F.col("ord")
    )
    return found.select("ord", cluster.alias("cluster"), "len", "tags")


def dedupe(
    df: DataFrame,
    threshold: float = FUZZY_THRESHOLD,
    company_floor: float = MIN_COMPANY_SIMILARITY,
    keep_query_hosts: list[str] | None = None,
) -> DataFrame:
    """Exact and fuzzy duplicates merged; every row leaves with its ``dedup_key``.

    ``df`` needs a unique ``ord``.  Clustering runs on slim columns written once
    to the shared folder; the wide rows are shuffled once, by ``ord``.
    """
    members = _clusters(cut_lineage(_slim(df, keep_query_hosts)), threshold, company_floor)
    return merge_survivors(with_dedup_key(df, keep_query_hosts), cut_lineage(members))
