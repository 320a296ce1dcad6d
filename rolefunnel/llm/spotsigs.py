"""Document fingerprints from chains of content words behind common words (SpotSigs).

Words are maximal runs of letters and digits of the lower-cased text.  Wherever a
common word (the anchor) stands directly before a content word, that word and the
next content word form a chain; a chain with its anchor, hashed, is a signature,
and the set of signatures is the fingerprint.  Text around the running prose,
such as menus and lists, has few anchors and so weighs little.  A text without any
anchored content word takes the chains of all its content words instead.

Everything is DataFrame and SQL functions.  Sets are compared by Jaccard
similarity; ``near_pairs`` finds all pairs above a threshold: sets are put into
partitions of set lengths so wide that a match lies in the same or the next one,
meet there in their rarest signatures only, as many as a match must share, and are
compared when their lengths allow the threshold.

Cases: a null text is an empty one; a text without content words has an empty
fingerprint, and two empty sets have likeness 1.  Equal texts have equal
fingerprints.  Repeated ids are ordered by their text.  Other columns of the
input are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolefunnel.llm.common import stored
from rolefunnel.operators.barrier import add_once

# Frequent function words of four languages, the default anchors.
ANCHORS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was", "with", "as", "be", "by", "an", "are", "this", "from",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "für",
    "de", "la", "le", "et", "les", "du", "un", "une", "que", "est", "pour", "dans", "qui", "sur", "au",
    "el", "los", "se", "del", "las", "por", "con", "no", "para", "su", "al", "lo", "y", "en",
)
#: Sets whose ids, one per this many documents, order the neighbours across buckets.
BUCKET_ROWS = 4096
#: A bucket table up to this many rows (24 bytes each) is broadcast; a larger one is joined.
BROADCAST_ROWS = 1_000_000


def signatures(text: Column, anchors: tuple[str, ...] = ANCHORS) -> Column:
    """The sorted set of signatures of a text, 8 hexadecimal digits each."""
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    # An anchor is tied to the word behind it, so that a unit is a content word with the anchors before it.
    tied = F.regexp_replace(plain, f"(?<= )({'|'.join(anchors)}) ", "$1_")
    units = F.filter(F.split(tied, " "), lambda u: (u != "") & ~F.endswith(u, F.lit("_")))

    def chains(units: Column) -> Column:
        def chain(u: Column, k: Column) -> Column:
            return F.left(F.md5(F.concat_ws(" ", F.substring_index(u, "_", -2), F.substring_index(F.get(units, k + 1), "_", -1)).cast("binary")), F.lit(8))

        some = F.exists(units, lambda u: F.contains(u, F.lit("_")))
        found = F.transform(units, lambda u, k: F.when(~some | F.contains(u, F.lit("_")), chain(u, k)))
        return F.array_sort(F.array_distinct(F.array_compact(found)))

    # Through a one-element array, so that the units are computed once.
    return F.element_at(F.transform(F.array(units), chains), 1)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; of two empty ones 1."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def fingerprint(sigs: Column) -> Column:
    return F.array_join(sigs, "")


def with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, text, next): next is the text of the document with the next smaller id, for the smallest that of the largest.

    Ids are cut into buckets of equal width, about ``bucket_rows`` documents each
    where ids are spread evenly.  The largest document of a bucket is also sent to
    the nearest bucket above, as the one that follows there; then every bucket is
    a window of its own.
    """
    ids = docs.select("id")
    low, high, n = ids.agg(F.min("id"), F.max("id"), F.count("id")).first()
    if not n:
        return docs.select("id", "text", F.col("text").alias("next"))
    width = max(1, (high - low + 1) * bucket_rows // n)
    bucket = F.floor((F.col("id") - F.lit(low)) / F.lit(width)).cast("bigint")
    tops = ids.groupBy(bucket.alias("bucket")).agg(F.max("id").alias("top"))
    every = Window.orderBy("bucket")
    tops = stored(
        tops.select("bucket", "top", F.coalesce(F.lead("bucket").over(every), F.min("bucket").over(Window.partitionBy())).alias("above")), "bucket-tops"
    )
    slim = tops.select(F.col("top").alias("id"), "above")
    rows = docs.join(F.broadcast(slim) if tops.count() <= BROADCAST_ROWS else slim, "id", "left")
    # Of repeated ids the first by text follows the bucket above.
    placed = rows.select("id", "text", F.explode(F.when(F.col("above").isNull(), F.array(bucket)).otherwise(F.array(bucket, F.col("above")))).alias("bucket"), bucket.alias("own"), "above")
    placed = placed.select("id", "text", "bucket", ((F.col("bucket") != F.col("own")) | F.lit(False)).alias("guest"))
    if tops.count() == 1:  # the only bucket is its own neighbour: the guest is the second copy
        placed = docs.select("id", "text", F.lit(0).cast("bigint").alias("bucket"), F.lit(False).alias("guest")).unionByName(
            docs.where(F.col("id") == high).select("id", "text", F.lit(0).cast("bigint").alias("bucket"), F.lit(True).alias("guest"))
        )
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("id"), "text")
    return placed.select("id", "text", "guest", F.lead("text").over(order).alias("next")).where("not guest").drop("guest")


def edited(text: Column, following: Column) -> Column:
    """The last third of the code points replaced by the first as many, or all, of the next text."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.left(text, F.length(text) - third), F.left(following, third))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchors: tuple[str, ...] = ANCHORS) -> DataFrame:
    """(id, text, edited, own, changed, following): the sets of every text, its edited text and the next text."""
    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id is not null")
    texts = add_once(with_next(slim), {"edited": edited(F.col("text"), F.col("next"))})
    sets = {name: signatures(F.col(c), anchors) for name, c in (("own", "text"), ("changed", "edited"), ("following", "next"))}
    return add_once(texts, sets).drop("next")


def length_partition(size: Column, threshold: float) -> Column:
    """Sets in partitions that differ by two or more cannot reach the threshold."""
    return F.floor(F.log(F.greatest(size, F.lit(1))) / F.lit(-math.log(threshold)) + F.lit(1e-9)).cast("int")


def near_pairs(sets: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, likeness) of classes with likeness of at least ``threshold``, and the members (id, class) of the classes.

    ``sets`` has id and sigs.  Equal sets form a class, named by its smallest id.
    """
    named = sets.select("id", "sigs", F.sha2(fingerprint(F.col("sigs")), 256).alias("key"))
    least = named.groupBy("key").agg(F.min("id").alias("class"), F.min_by("sigs", "id").alias("sigs"))
    classes = stored(least, "spotsigs-classes")
    members = named.select("id", "key").join(classes.select("key", "class"), "key").select("id", "class")
    part = classes.where(F.size("sigs") > 0).select("class", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    rank = Window.partitionBy("class").orderBy("df", "sig")
    counted = part.join(part.groupBy("sig").agg(F.count("*").alias("df")), "sig").where("df > 1").withColumn("k", F.row_number().over(rank))
    # A match shares at least ceil(threshold * n) signatures, so one of the rarest n - that + 1 of each;
    # those that no other set has come first in the order and need no place.
    alone = part.groupBy("class").agg(F.first("n").alias("size"), F.count("*").alias("all")).drop("all")
    shared = counted.groupBy("class").agg(F.count("*").alias("common"))
    rare = counted.join(alone.join(shared, "class"), "class").where(F.col("k") + F.col("size") - F.col("common") <= F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - F.lit(1e-9)) + 1)
    probe = rare.select("class", "n", "sig", length_partition(F.col("n"), threshold).alias("p"))
    left, right = probe.select(F.col("class").alias("a"), F.col("n").alias("na"), "sig", "p"), probe.select(
        F.col("class").alias("b"), F.col("n").alias("nb"), "sig", F.explode(F.array(F.col("p"), F.col("p") - 1)).alias("p")
    )
    met = left.join(right, ["sig", "p"]).where("a != b").where((F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - F.lit(1e-9)))
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    body = classes.select("class", "sigs")
    both = met.join(body.select(F.col("class").alias("a"), F.col("sigs").alias("sa")), "a").join(body.select(F.col("class").alias("b"), F.col("sigs").alias("sb")), "b")
    return both.select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness")).where(F.col("likeness") >= threshold), members
