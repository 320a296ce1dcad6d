"""Merkle manifest of a dataset: trees per group of rows, their roots again a tree, a proof for every row.

Rows become leaves, are numbered in order within their tree, and fold upwards:
each run of ``fanout`` nodes is hashed into its parent until one node is left.  The
fold is a slot pivot: conditional aggregates spread the children of a block into
columns, one for each slot; the columns of a run, side by side, are hashed into the
parent, and the same columns without a node's own are its siblings.  A block spans
``depth`` levels, so a tree of n rows takes log(n) / depth aggregations, each over
``fanout ** depth`` times fewer rows than the one before.

Proofs come down again: every block joins the path of its own digest, and only
then are its slots spread into rows, so paths are never shuffled once per row but
once per block.  Numbers come from a range partitioning and the counts of its
partitions; no window holds a tree.

Cases: a null value is marked apart from every text and number.  Rows without an
id come first; rows with one id are ordered by their digest, and equal rows stand
side by side, each a leaf of its own.  Rows with a null group are a tree of their
own, the first one.  A tree of one row is its leaf; the topmost one of one tree
its root.  An empty table gives no rows.  Columns not named are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolefunnel.llm.common import stored

FANOUT = 2
#: Levels that one aggregation folds: blocks of fanout ** depth slots.
DEPTH = 4


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts side by side."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _side_by_side(slots: list[str]) -> str:
    """SQL: the digests of some slots, without the empty ones."""
    return f"concat({', '.join(f"coalesce({s}, '')" for s in slots)})" if slots else "''"


def leaf(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows with ``pos``, from 0 in the order ``by`` within ``tree`` (not null), and ``total``, the rows of the tree."""
    slim = stored(rows.withColumn("__tie", F.monotonically_increasing_id()), "merkle-rows")
    order = ["tree", *by, "__tie"]  # the tie parts even a hot id
    ranged = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stored(ranged.withColumn("__seq", F.monotonically_increasing_id()).drop("__tie"), "merkle-ranged")
    part = F.shiftright("__seq", 33).alias("__part")
    runs = ranged.groupBy("tree", part).agg(F.min("__seq").alias("first"), F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    before = F.sum("n").over(tree.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("tree", "__part", (F.col("first") - F.coalesce(before, F.lit(0))).alias("shift"), F.sum("n").over(tree).alias("total"))
    return ranged.withColumn("__part", part).join(runs, ["tree", "__part"]).withColumn("pos", F.col("__seq") - F.col("shift")).drop("__part", "__seq", "shift")


@dataclass(frozen=True)
class Forest:
    """The blocks of every pass, from the leaves up."""

    passes: list[DataFrame]
    fanout: int
    depth: int

    def done(self, p: int) -> Column:
        """Whether the tree of a block ends in pass ``p``."""
        return F.col("height") <= (p + 1) * self.depth

    def name(self, level: int, slot: int) -> str:
        return f"l{level}_{slot}"

    def roots(self) -> DataFrame:
        """(tree, root) of every tree."""
        top = [b.where(self.done(p)).select("tree", F.col(self.name(self.depth, 0)).alias("root")) for p, b in enumerate(self.passes)]
        out = top[0]
        for more in top[1:]:
            out = out.union(more)
        return out


def build(nodes: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> Forest:
    """Fold the leaves (tree, pos, total, digest, held) of all trees; ``held`` is a struct that goes with each leaf."""
    if fanout < 2 or depth < 1:
        raise ValueError("fanout of at least 2, depth of at least 1")
    most = nodes.agg(F.max("total")).first()[0] or 0
    steps = [h for h in range(63) if fanout**h < 1 << 63]
    height = F.coalesce(*[F.when(F.col("total") <= fanout**h, F.lit(h)) for h in steps])
    level = nodes.select("tree", height.alias("height"), "pos", F.struct("digest", "held").alias("node"))
    width, passes, forest = fanout**depth, [], None
    while forest is None or fanout ** (depth * len(passes)) < most:
        forest = Forest(passes, fanout, depth)
        base = depth * len(passes)
        blocks = level.groupBy("tree", "height", F.expr(f"pos div {width}L").alias("pos")).agg(
            *[F.expr(f"max(CASE WHEN pos % {width} = {i} THEN node END) AS s{i}") for i in range(width)]
        )
        blocks = blocks.selectExpr("*", *[f"s{i}.digest AS {forest.name(0, i)}" for i in range(width)])
        for j in range(depth):
            folded = []
            for g in range(fanout ** (depth - j - 1)):
                run = [forest.name(j, k) for k in range(g * fanout, (g + 1) * fanout)]
                parent = f"CASE WHEN {run[0]} IS NOT NULL THEN sha2({_side_by_side(run)}, 256) END"
                folded.append(f"CASE WHEN height > {base + j} THEN {parent} ELSE {run[0]} END AS {forest.name(j + 1, g)}")
            blocks = blocks.selectExpr("*", *folded)
        passes.append(stored(blocks, "merkle-blocks"))
        top = F.struct(F.col(forest.name(depth, 0)).alias("digest"), F.lit(None).cast(nodes.schema["held"].dataType).alias("held"))
        level = passes[-1].where(~forest.done(len(passes) - 1)).select("tree", "height", "pos", top.alias("node"))
    return forest


def _siblings(forest: Forest, base: int, slot: int) -> str:
    """SQL: the steps (left, right) of one slot within its block, the columns of each run but the node's own."""
    steps = []
    for j in range(forest.depth):
        own = slot // forest.fanout**j
        first = own - own % forest.fanout
        left = [forest.name(j, k) for k in range(first, own)]
        right = [forest.name(j, k) for k in range(own + 1, first + forest.fanout)]
        steps.append(f"named_struct('left', {_side_by_side(left)}, 'right', {_side_by_side(right)})")
    return f"slice(array({', '.join(steps)}), 1, greatest(0, height - {base}))"


def paths(forest: Forest, tails: DataFrame | None = None) -> DataFrame:
    """(tree, pos, digest, held, path, root, top) of every leaf.

    ``path`` holds the siblings on either side, level by level from the leaf; ``root``
    is the root of the leaf's tree.  ``tails`` (tree, path, top) goes on from there to
    the root above all trees, ``top``; without it the path ends at the tree's root.
    """
    width, above = forest.fanout**forest.depth, None
    none = F.array().cast("array<struct<left:string,right:string>>")
    for p in reversed(range(len(forest.passes))):
        blocks = forest.passes[p]
        last = blocks.where(forest.done(p)).withColumn("root", F.col(forest.name(forest.depth, 0)))
        if tails is None:
            last = last.withColumns({"__tail": none, "top": F.col("root")})
        else:
            last = last.join(tails.select("tree", F.col("path").alias("__tail"), "top"), "tree")
        if above is not None:
            rest = blocks.where(~forest.done(p)).join(above.select("tree", "pos", F.col("path").alias("__tail"), "root", "top"), ["tree", "pos"])
            last = last.unionByName(rest)
        slots = [f"named_struct('pos', pos * {width} + {i}, 'node', s{i}, 'steps', {_siblings(forest, p * forest.depth, i)})" for i in range(width)]
        spread = last.selectExpr("tree", "__tail", "root", "top", f"explode(filter(array({', '.join(slots)}), s -> s.node IS NOT NULL)) AS s")
        above = spread.select("tree", "s.pos", "s.node.digest", "s.node.held", F.concat("s.steps", "__tail").alias("path"), "root", "top")
        if p:
            above = stored(above, "merkle-paths")
    return above


def proof(path: Column) -> Column:
    """One digest of all siblings of a path, from the leaf up and from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path give."""
    return F.aggregate(path, start, lambda node, s: digest(s["left"], node, s["right"]))


def manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    tree_col: str = "lang",
    claimed: dict[str, Column] | None = None,
    fanout: int = FANOUT,
    depth: int = DEPTH,
) -> DataFrame:
    """(id, leaf, claimed, subroot, root, path) of every row.

    ``claimed`` replaces fields by other values, as a later reader may find them; the
    column of that name holds the digest of such a row where it differs, else null.
    """
    own = leaf(*[F.col(c) for c in fields])
    other = leaf(*[(claimed or {}).get(c, F.col(c)) for c in fields]) if claimed else F.lit(None).cast("string")
    # Null first, then by bytes.
    tree = F.coalesce(F.concat(F.lit("="), F.col(tree_col).cast("string")), F.lit(""))
    rows = docs.select(tree.alias("tree"), F.col(id_col).alias("id"), own.alias("digest"), other.alias("other"))
    rows = rows.select("tree", "id", "digest", F.when(F.col("other") != F.col("digest"), F.col("other")).alias("other"))
    placed = numbered(rows, ["id", "digest"])
    groups = build(stored(placed.select("tree", "pos", "total", "digest", F.struct("id", "other").alias("held")), "merkle-leaves"), fanout, depth)
    subroots = groups.roots().select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    upper = numbered(subroots, ["name"]).select("tree", "pos", "total", "digest", F.struct("name").alias("held"))
    tails = paths(build(stored(upper, "merkle-subroots"), fanout, depth)).select(F.col("held.name").alias("tree"), "path", F.col("root").alias("top"))
    found = paths(groups, stored(tails, "merkle-tails"))
    return found.select("held.id", F.col("digest").alias("leaf"), F.col("held.other").alias("claimed"), F.col("root").alias("subroot"), F.col("top").alias("root"), "path")
