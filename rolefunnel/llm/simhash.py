"""Near-duplicates by SimHash fingerprints, found through segment popcounts.

A fingerprint is cut into segments; the counts of set bits per segment are a
point whose Manhattan distance to another point never exceeds the Hamming
distance of the fingerprints.  Two points within distance 2 have a lattice point
within 1 of both, so every fingerprint is entered at its own grid cell and at
the neighbouring ones, and only fingerprints that meet another in a cell are
verified.  Two in a cell are compared.  Where more meet, verification is as exact
but forms no pairs: two fingerprints differ in at most 2 bits exactly when some
64-bit value differs from each in at most 1 bit, so they meet in those values and
each is linked to the smallest fingerprint there.  A thousand fingerprints close together thus make a
thousand links, not half a million.  Links are closed into components in rounds
of joins and written tables.

Cases: a text with no words (null, empty, white space) has fingerprint 0 and is
linked like any other; fewer words than a shingle are one shingle.  Equal texts
share a fingerprint and meet as one row.  Repeated ids give repeated rows.
Other columns of the input are not read.

Bits reach only the closest copies: a pair whose sets of five-word shingles have
Jaccard similarity 0.8 differs in ten bits of 64 on average, as far as popcounts of
unrelated fingerprints may be apart.  ``similar`` links the closest copies by their
fingerprints, each pair verified on whole sets, and for the others embeds the sets
themselves: the shingles in each of 256 segments of the hash space are counted, and
the Manhattan distance of the counts is a lower bound of the symmetric difference.
Candidates come without loss: a pair at ``similarity`` shares one of the first
n - ceil(similarity * n) + 1 shingles of both sets in any fixed order; common
shingles come last in it.  Nodes that meet in such a shingle are compared with the
smallest one there, the lead: each with one of its leads, then with more and with
all of those that it is not yet in one component with.  Then what is still apart
where it meets first is compared.  Where a crowd meets, sets that have most of their
shingles in common would all be compared with each other; there each set is described
by its difference from a centre, the shingles that most sets of the crowd have.  Two sets
with p and q shingles in theirs, x and y beyond what the similarity allows from the centre,
are similar exactly when they have (x + y) / 2 of them in common: none is needed of those that
the set next to the centre links, and the others meet in the rarest shingles of their
differences, which copies edited in different places do not share.  Pairs that the bound
leaves are verified on whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolefunnel.llm.common import LOWER, VISIBLE, Filter, PrefixHash, Scratch, flat, map_batches, map_slices, mix, row_of, spans, stored

BITS = 64
_CHUNK = 1 << 15
#: Of so many documents one, and so many shingles at most, settle which shingles count as common: only the order depends on them, no result.
ORDER_SHARE = 4
COMMON = 500_000
#: Leads that a set is compared with in each round of stars; the last round has all.
STAR_ROUNDS = (1, 8, None)
#: Shared shingles before one that are looked at for an earlier meeting.
EARLIER = 8
#: Members up to which the sets at a shared shingle are compared as they are, and members that settle the centre of a larger crowd: no result depends on them.
CROWD = 16
CENTRE = 15
#: Segments of the hash space in which the shingles of a set are counted.
SEGMENTS = 256


def _shingles(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """The words of all texts with one space between them, start and end of every shingle there, its row; rows."""
    data, off = flat(column)
    n = len(off) - 1
    starts, ends = spans(data, off, VISIBLE)
    rows = row_of(off, starts)
    # The words of each text with one space between them; a shingle is then a slice.
    size = ends - starts
    to = np.cumsum(size + 1)
    first = to - size - 1
    body = np.full(int(to[-1]) if len(to) else 0, 0x20, np.uint8)
    shift = np.repeat(starts - first, size)
    at = np.arange(len(shift)) + np.repeat(np.arange(len(size)), size)
    body[at] = LOWER[data[at + shift]]
    count = np.bincount(rows, minlength=n)
    before = np.cumsum(count) - count
    opens = np.arange(len(rows))
    closes = np.minimum(opens + words, (before + count)[rows]) - 1
    keep = (closes - opens == words - 1) | ((opens == before[rows]) & (count[rows] < words))
    opens, closes = opens[keep], closes[keep]
    return body, first[opens], (to - 1)[closes], rows[opens], n


def fingerprints_of(column: pa.Array, words: int = 3, seed: int = 42) -> np.ndarray:
    """SimHash of every text over shingles of ``words`` words, as unsigned 64-bit integers."""
    body, starts, ends, owner, n = _shingles(column, words)
    text = body.tobytes()
    digest = xxhash.xxh64_intdigest
    parts = ((starts[low : low + _CHUNK].tolist(), ends[low : low + _CHUNK].tolist()) for low in range(0, len(starts), _CHUNK))
    hashes = np.fromiter((digest(text[a:b], seed) for part in parts for a, b in zip(*part, strict=True)), np.uint64, len(starts))
    total = np.zeros((n, BITS), np.int64)
    for low in range(0, len(hashes), _CHUNK):
        part, who = hashes[low : low + _CHUNK], owner[low : low + _CHUNK]
        bits = np.unpackbits(part.byteswap().view(np.uint8).reshape(-1, 8), axis=1)
        cut = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        total[who[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    ones = 2 * total > np.bincount(owner, minlength=n)[:, None]
    return np.packbits(ones, axis=1).reshape(n, 8).copy().view(">u8").astype(np.uint64).ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp) of every document, fp as a signed 64-bit integer."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints_of(part.column(1), words, seed).view(np.int64))], ["id", "fp"])

    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return map_slices(slim, work, "id bigint, fp bigint")


def _signed(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("bigint")


def popcounts(fp: Column, segments: int = 16) -> Column:
    """The counts of set bits of 16 or 8 segments, side by side in one integer."""
    if segments not in (8, 16):
        raise ValueError("segments: 8 or 16")
    halves = []  # of 32 bits, so that no sum reaches the sign
    for half in (F.shiftrightunsigned(fp, 32), fp.bitwiseAND(_signed((1 << 32) - 1))):
        for width in (1, 2, 4)[: 2 if segments == 16 else 3]:
            mask = _signed(((1 << 32) - 1) // ((1 << width) + 1))  # 0101..., 00110011..., 00001111...
            half = half.bitwiseAND(mask) + F.shiftrightunsigned(half, width).bitwiseAND(mask)
        halves.append(half)
    return F.shiftleft(halves[0], 32).bitwiseOR(halves[1])


def cells(own: Column, segments: int = 16) -> Column:
    """A grid cell, as of ``popcounts``, and every cell at Manhattan distance 1."""
    width = BITS // segments
    near = [own]
    for low in range(0, BITS, width):
        one = _signed(1 << low)
        count = F.shiftrightunsigned(own, low).bitwiseAND(_signed((1 << width) - 1))
        near += [F.when(count < width, own + one), F.when(count > 0, own - one)]
    return F.array_compact(F.array(*near))


def _around(fp: Column) -> Column:
    """The fingerprint and all values one bit away."""
    return F.array(fp, *[fp.bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63)).cast("bigint")) for b in range(BITS)])


def links(fps: DataFrame, segments: int = 16) -> DataFrame:
    """Distinct (a, b), a < b, that connect all fingerprints (column ``fp``, distinct) at 2 or fewer differing bits."""
    entered = fps.select("fp", popcounts(F.col("fp"), segments).alias("own")).select("fp", F.explode(cells(F.col("own"), segments)).alias("cell"))
    shared = stored(entered.groupBy("cell").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count("*").alias("n")).where("n > 1"), "simhash-cells")
    # Most cells hold two, and those are compared at once.
    pairs = shared.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    candidates = stored(entered.join(shared.where("n > 2"), "cell", "left_semi").select("fp").distinct(), "simhash-candidates")
    met = candidates.select("fp", F.explode(_around(F.col("fp"))).alias("value"))
    # At most 65 fingerprints have a value, so a window holds them; in a join the planner takes all values for as small as the candidates
    # before they are exploded, and sends them through the driver.
    least = met.withColumn("a", F.min("fp").over(Window.partitionBy("value"))).where("a < fp")
    return least.select("a", F.col("fp").alias("b")).union(pairs).distinct()


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the smallest node reachable.

    Alternating large-star and small-star steps: each round links nodes to the
    smallest neighbour, so a chain of n nodes is done in about log n rounds.  A
    round is a pre-aggregated minimum and a join, and ends in a written table.
    """
    stored = (scratch or Scratch(edges.sparkSession)).stored
    edges = stored(edges.select("a", "b"), "component-edges")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = stored(both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct(), "component-large")
        # Small star: every node and its smaller neighbours go to the smallest of them.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select("a", "b", "m")
        new = stored(
            small.select(F.col("m").alias("a"), "b").union(small.where("m < a").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct(), "component-small"
        )
        # Stars: no node is both a root and below one.
        if new.join(new.select(F.col("b").alias("a")), "a", "left_semi").isEmpty() and new.count() == new.select("b").distinct().count():
            return new.select(F.col("b").alias("node"), F.col("a").alias("root")).union(new.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        edges = new


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, segments: int = 16) -> DataFrame:
    """(id, fp, component) of every document; component is the smallest id reachable through links."""
    found = stored(fingerprints(docs, id_col, text_col, words), "simhash-fingerprints")
    groups = stored(found.groupBy("fp").agg(F.min("id").alias("first")), "simhash-groups")
    named = components(links(groups.select("fp"), segments)).withColumnRenamed("node", "fp")
    roots = named.join(groups, "fp")
    best = roots.groupBy("root").agg(F.min("first").alias("component"))
    linked = roots.join(best, "root").select("fp", "component")
    every = groups.join(linked, "fp", "left").select("fp", F.coalesce("component", "first").alias("component"))
    return found.join(every, "fp").select("id", "fp", "component")


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all texts, ascending within each; their rows; size and 64-bit hash of each set."""
    body, starts, ends, owner, n = _shingles(column, words)
    hashes = PrefixHash(body).of(starts, ends)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    size = np.bincount(owner, minlength=n)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes ^ np.uint64(0xA0761D6478BD642F)), out=total[1:])
    bounds = np.concatenate([[0], np.cumsum(size)])
    node = mix(total[bounds[1:]] - total[bounds[:-1]] + size.astype(np.uint64))
    return hashes, owner, size, node.view(np.int64)


def _common(slim: DataFrame, words: int) -> np.ndarray:
    """Shingles that recur in a fixed share of the documents, the rarest first: the bar is the same at every size."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        keys, n = np.unique(shingle_sets(part.column("text"), words)[0], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

    sample = slim.where(F.pmod(F.xxhash64(F.lit("order"), "id"), F.lit(ORDER_SHARE)) == 0)
    found = map_slices(sample, work, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where("n > 2")
    top = found.orderBy(F.desc("n"), "key").limit(COMMON).toArrow()
    return top.column("key").to_numpy().view(np.uint64)[::-1].copy()


def segment_counts(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Shingles of every set in each of ``SEGMENTS`` segments of the hash space, up to 255: n rows of bytes.

    The Manhattan distance of two rows never exceeds the symmetric difference of the sets.
    """
    place = owner.astype(np.int64) * SEGMENTS + (hashes >> np.uint64(64 - SEGMENTS.bit_length() + 1)).astype(np.int64)
    return np.minimum(np.bincount(place, minlength=n * SEGMENTS), 255).astype(np.uint8).reshape(n, SEGMENTS)


def _prefix_rows(slim: DataFrame, ranked, words: int, similarity: float, shared=None) -> DataFrame:
    """(key, node, size, place): each set by the first shingles of which two sets at ``similarity`` share one; ``place`` counts those before.

    ``ranked`` is broadcast, the common shingles sorted and the rank of each; ``shared``
    the filter of the keys that are wanted, none for all.
    """

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        common, rank = ranked.value
        hashes, owner, size, node = shingle_sets(part.column("text"), words)
        place = np.zeros(len(hashes), np.int64)  # common shingles after all others, by rank
        if len(common):
            at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
            place = np.where(common[at] == hashes, rank[at] + 1, 0)
        order = np.lexsort((hashes, place, owner))
        hashes, owner = hashes[order], owner[order]
        within = np.arange(len(hashes)) - (np.cumsum(size) - size)[owner]
        length = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
        keep = within < length[owner]
        if shared is not None:
            keep[keep] = shared.value.has(hashes[keep])
        rows = np.unique(np.stack([hashes[keep].view(np.int64), node[owner[keep]], size[owner[keep]], within[keep]]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(r) for r in rows], ["key", "node", "size", "place"])

    return map_slices(slim, work, "key bigint, node bigint, size bigint, place bigint")


def _fits(similarity: float) -> Column:
    """Whether sets of ``m`` and ``n`` shingles that meet with ``i`` and ``j`` shingles before can be that similar.

    Where two sets meet first, all that they share comes no earlier, so that what is left of
    either must hold it; a pair that fails this where it meets again has passed it before.
    """
    shared = F.ceil((F.col("m") + F.col("n")) * F.lit(similarity / (1 + similarity)) - F.lit(1e-9))
    return (F.least("m", "n") >= F.lit(similarity) * F.greatest("m", "n") - F.lit(1e-9)) & (F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j")) >= shared)


def _with_earlier(apart: DataFrame, similarity: float) -> DataFrame:
    """``apart`` (key, node, size, place, root) with a band of sizes and the keys that come before each in its set."""
    band = F.floor(F.log("size") / F.lit(-math.log(similarity)) + F.lit(1e-9)) if similarity < 1 else F.col("size")
    earlier = F.collect_list("key").over(Window.partitionBy("node").orderBy("place").rowsBetween(-EARLIER, -1))
    return apart.withColumns({"band": band.cast("bigint"), "earlier": earlier})


def _first_meetings(apart: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: nodes of different roots at a shared key, the larger set with the smaller ones of its own and the next lower band of sizes.

    Two sets that have one of the earlier keys in common have met there and are not brought together again.
    """
    left = apart.select("key", "band", *(F.col(c).alias(n) for c, n in zip(("node", "size", "place", "root", "earlier"), ("a", "m", "i", "ra", "ea"), strict=True)))
    right = apart.select(
        "key", F.explode(F.array("band", F.col("band") + 1)).alias("band"),
        *(F.col(c).alias(n) for c, n in zip(("node", "size", "place", "root", "earlier"), ("b", "n", "j", "rb", "eb"), strict=True)),
    )
    larger = (F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("a") > F.col("b")))
    pairs = left.join(right, ["key", "band"]).where((F.col("ra") != F.col("rb")) & larger & _fits(similarity) & ~F.arrays_overlap("ea", "eb"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _differences(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``members`` (g, node, size) with ``own``, what is only in the set or only in the centre of g, and ``x``, its size less what is allowed."""
    few = members.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("node"), "node"))).where(F.col("k") <= CENTRE)
    common = few.select("g", "node").join(sets, "node").select("g", F.explode("set").alias("key")).groupBy("g", "key").count().where(F.col("count") > CENTRE // 2)
    centres = common.groupBy("g").agg(F.collect_list("key").alias("centre"))
    held = members.join(sets, "node").join(centres, "g", "left").withColumn("centre", F.coalesce("centre", F.array().cast("array<bigint>")))
    held = held.select("g", "node", "size", F.array_union(F.array_except("set", "centre"), F.array_except("centre", "set")).alias("own"))
    return held.withColumn("x", F.size("own") - F.lit((1 - similarity) / (1 + similarity)) * F.col("size"))


def _nearest(held: DataFrame) -> DataFrame:
    """(g, lead, least): the member with the smallest ``x`` of each crowd."""
    return held.groupBy("g").agg(F.min(F.struct("x", "node")).alias("m")).select("g", F.col("m.node").alias("lead"), F.col("m.x").alias("least"))


def _overlap(x: Column, y: Column) -> Column:
    """How much of their differences two sets must have in common."""
    return F.greatest(F.lit(1), F.ceil((x + y) / 2 - F.lit(1e-6)))


def _around_centre(held: DataFrame) -> DataFrame:
    """(a, b), a < b: each member of a crowd (g, node, x) that is similar to the one next to the centre, with that one; two members
    that need nothing in common in their differences both are."""
    close = held.join(_nearest(held), "g").where((F.col("x") + F.col("least") <= 1e-6) & (F.col("node") != F.col("lead")))
    return close.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()


def _entries(held: DataFrame) -> DataFrame:
    """(g, key, node, size, root, x, d, place, earlier): crowds (g, node, size, root, own, x) by the first shingles of their differences, the rarest
    first, of which two similar members of different roots share one unless ``_around_centre`` has both."""
    own = held.select("g", "node", "size", "root", "x", F.size("own").alias("d"), F.explode("own").alias("key"))
    mixed = own.groupBy("g", "key").agg(F.count("*").alias("n"), F.min("root").alias("one"), F.max("root").alias("other")).where("one < other")
    each = Window.partitionBy("g", "node")
    ranked = own.join(mixed.select("g", "key", "n"), ["g", "key"]).withColumn("rank", F.row_number().over(each.orderBy("n", "key")))
    # Shingles that nobody of another root has come before all others.
    ranked = ranked.withColumn("place", F.col("d") - F.count("*").over(each) + F.col("rank") - 1)
    ranked = ranked.withColumn("earlier", F.collect_list("key").over(each.orderBy("place").rowsBetween(-EARLIER, -1)))
    kept = ranked.join(_nearest(held).select("g", "least"), "g").where(F.col("d") - F.col("place") >= _overlap(F.col("x"), F.col("least")))
    return kept.select("g", "key", "node", "size", "root", "x", "d", "place", "earlier")


def _met_in_crowds(entries: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: members of different roots where their differences meet first, if enough of both is left there."""
    fields = ("node", "size", "root", "x", "d", "place", "earlier")
    one, two = (entries.select("g", "key", *(F.col(c).alias(f"{side}_{c}") for c in fields)) for side in "ab")
    left = F.least(F.col("a_d") - F.col("a_place"), F.col("b_d") - F.col("b_place"))
    alike = F.least("a_size", "b_size") >= F.lit(similarity) * F.greatest("a_size", "b_size") - F.lit(1e-9)
    held = alike & (left >= _overlap(F.col("a_x"), F.col("b_x"))) & ~F.arrays_overlap("a_earlier", "b_earlier")
    pairs = one.join(two, ["g", "key"]).where((F.col("a_node") < F.col("b_node")) & (F.col("a_root") != F.col("b_root")) & held)
    return pairs.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()


def _near_enough(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose segment counts do not rule the similarity out."""
    for side in "ab":
        pairs = pairs.join(sketches.select(F.col("node").alias(side), F.col("size").alias(f"n{side}"), F.col("counts").alias(f"c{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, _CHUNK):
                part = batch.slice(low, _CHUNK)
                one, two = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(-1, SEGMENTS).astype(np.int16) for c in ("ca", "cb"))
                total = part.column("na").to_numpy() + part.column("nb").to_numpy()
                # Sets of together t shingles at Jaccard s differ in t (1 - s) / (1 + s) of them.
                held = np.abs(one - two).sum(1) <= total * (1 - similarity) / (1 + similarity) + 1e-6
                yield part.select(["a", "b"]).filter(pa.array(held))

    return map_batches(pairs.select("a", "b", "na", "nb", "ca", "cb"), run, "a bigint, b bigint")


def met_by_fingerprint(nodes: DataFrame, segments: int = 16) -> DataFrame:
    """Distinct (a, b), a < b, of nodes (node, fp): those with one fingerprint and its smallest node, and the smallest of linked fingerprints."""
    leads = stored(nodes.groupBy("fp").agg(F.min("node").alias("lead")), "simhash-leads")
    same = nodes.join(leads, "fp").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    linked = links(leads.select("fp"), segments)
    for side in "ab":
        linked = linked.join(leads.select(F.col("fp").alias(side), F.col("lead").alias(f"{side}_lead")), side)
    linked = linked.select(F.least("a_lead", "b_lead").alias("a"), F.greatest("a_lead", "b_lead").alias("b"))
    return same.union(linked).where("a < b").distinct()


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component) of every document; sets of shingles with at least this Jaccard similarity are linked.

    Equal sets, also empty ones, are one node, named by a 64-bit hash.  Fingerprints
    propose the first pairs; the prefixes, what they leave apart.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    send = scratch.sent
    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))

    def name(part: pa.RecordBatch) -> pa.RecordBatch:
        hashes, owner, size, node = shingle_sets(part.column(1), words)
        counts = segment_counts(hashes, owner, part.num_rows)
        fp = fingerprints_of(part.column(1), words).view(np.int64)
        cells = [part.column(0), pa.array(node), pa.array(size), pa.array([c.tobytes() for c in counts], pa.binary()), pa.array(fp)]
        return pa.RecordBatch.from_arrays(cells, ["id", "node", "size", "counts", "fp"])

    found = scratch.stored(map_slices(slim, name, "id bigint, node bigint, size bigint, counts binary, fp bigint"), "similar-nodes")
    # Equal sets whose shingles recur differently have several fingerprints, of which one is enough.
    groups = scratch.stored(found.groupBy("node").agg(F.min("id").alias("first"), F.min("fp").alias("fp")), "similar-groups")
    # One document stands for all with its set, also where ids are null or repeated.
    ranked = _common(slim, words)
    by_hash = np.argsort(ranked)
    order = send((ranked[by_hash], by_hash))
    met = _prefix_rows(slim, order, words, similarity).groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last"))
    keys = scratch.stored(met.where("lead < last").select("key", "lead"), "similar-keys")
    shared = send(Filter.of(keys.select("key")))
    rows = _prefix_rows(slim, order, words, similarity, shared).distinct()
    met = scratch.stored(rows.join(keys, "key"), "similar-met")
    scratch.recall()
    sketches = found.join(met.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    sketches = scratch.stored(sketches.select("node", "size", "counts"), "similar-sketches")

    leads = met.where("node = lead").select("key", F.col("size").alias("m"), F.col("place").alias("i"))
    stars = met.join(leads, "key").where("lead < node").withColumnsRenamed({"size": "n", "place": "j"}).where(_fits(similarity))
    stars = scratch.stored(stars.select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "similar-stars")

    def sets_of(nodes: DataFrame, label: str) -> DataFrame:
        # Sets are made again for one document of each of these nodes.
        speakers = send(Filter.of(nodes.join(groups, "node").select(F.xxhash64("first"))))

        def lists(part: pa.RecordBatch) -> pa.RecordBatch:
            part = part.filter(pa.array(speakers.value.has(part.column("speaker").to_numpy(zero_copy_only=False).view(np.uint64))))
            hashes, _, size, node = shingle_sets(part.column("text"), words)
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(node), pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.view(np.int64)))], ["node", "set"])

        texts = slim.select(F.xxhash64("id").alias("speaker"), "text")
        sets = scratch.stored(map_slices(texts, lists, "node bigint, set array<bigint>").dropDuplicates(["node"]), f"similar-sets-{label}")
        scratch.recall()
        return sets

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        near = scratch.stored(_near_enough(pairs, sketches, similarity), f"similar-near-{label}")
        sets = sets_of(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), label)
        left = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
        right = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
        common = F.size(F.array_intersect("sa", "sb"))
        held = common >= F.lit(similarity) * (F.size("sa") + F.size("sb") - common) - F.lit(1e-9)
        return scratch.stored(near.join(left, "a").join(right, "b").where(held).select("a", "b"), f"similar-edges-{label}")

    # The closest copies are one component after the round of fingerprints, large groups after the next, so that later rounds have few pairs.
    tried = scratch.stored(met_by_fingerprint(groups.select("node", "fp")), "similar-fingerprints")
    edges = verified(tried, "fingerprints")
    named = components(edges, scratch)

    def untried(pairs: DataFrame) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(named.select(F.col("node").alias(side), F.col("root").alias(f"r{side}")), side, "left")
        return pairs.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b").join(tried, ["a", "b"], "left_anti")

    for most in STAR_ROUNDS:
        pairs = untried(stars)
        if most == 1:
            pairs = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        elif most:
            pairs = pairs.withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy("a"))).where(F.col("k") <= most).select("a", "b")
        pairs = scratch.stored(pairs, f"similar-stars-{most}")
        if pairs.isEmpty():
            continue
        tried = tried.union(pairs)
        edges = edges.union(verified(pairs, f"stars-{most}"))
        named = components(edges, scratch)
    # What is still apart where it meets: a crowd by its differences from a centre, others as they are.
    apart = met.join(named, "node", "left").select("key", "node", "size", "place", "lead", F.coalesce("root", "node").alias("root"))
    mixed = apart.groupBy("key").agg(F.min("root").alias("one"), F.max("root").alias("other"), F.count("*").alias("n")).where("one < other")
    apart = scratch.stored(apart.join(mixed.select("key", "n"), "key"), "similar-apart")
    few = scratch.stored(_with_earlier(apart.where(F.col("n") <= CROWD).drop("lead", "n"), similarity), "similar-few")
    pairs = _first_meetings(few, similarity)
    crowds = scratch.stored(apart.where(F.col("n") > CROWD).select(F.col("lead").alias("g"), "node", "size").distinct(), "similar-crowds")
    if not crowds.isEmpty():
        sets = sets_of(crowds.select("node").distinct(), "crowds")
        held = scratch.stored(_differences(crowds, sets, similarity), "similar-held")
        close = scratch.stored(untried(_around_centre(held)), "similar-close")
        tried = tried.union(close)
        edges = edges.union(verified(close, "close"))
        named = components(edges, scratch)
        rooted = held.join(named, "node", "left").withColumn("root", F.coalesce("root", "node"))
        entries = scratch.stored(_entries(rooted), "similar-entries")
        pairs = pairs.union(_met_in_crowds(entries, similarity))
    rest = verified(scratch.stored(untried(pairs.distinct()), "similar-rest"), "rest")
    roots = components(edges.unionByName(rest), scratch).join(groups, "node")
    best = roots.groupBy("root").agg(F.min("first").alias("component"))
    linked = roots.join(best, "root").select("node", "component")
    every = groups.join(linked, "node", "left").select("node", F.coalesce("component", "first").alias("component"))
    out = stored(found.select("id", "node").join(every, "node").select("id", "component"), "similar-components")
    scratch.release()
    return out
