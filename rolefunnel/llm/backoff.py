"""Stupid-backoff scores of documents against bigram counts of the whole corpus.

    S(w | v) = c(v w) / c(v)            where c(v w) >= min_count
               alpha * c(w) / N         otherwise

Counts are taken over all documents, and the documents scored are those that were
counted.  So with ``min_count=1``, the default, every bigram of a document was seen,
and the score of a text is the sum of log c(v w) less the sum of log c(v).  The
second sum is known where a document is read.  For the first, each document's bigrams
are shuffled once, as (key, id, n): rows of one key are counted in a window where
they arrive, and every row takes the log of that count home to its document.  No table
of bigrams is written and nothing is joined; bigrams seen once add nothing and end there.
Very frequent bigrams would be hot keys of the window.  A fixed share of the documents
says which they are (at most ``hot``), all documents how often each was seen, and they
are looked up where the documents are read.

With a greater ``min_count`` bigrams seen less often back off to their word.  The table
holds the others, keyed by the numbers of their words; with each goes its gain, what the
bigram adds to the score of the single word.  Documents are exploded to bigrams, joined
to the table on the key and summed, all but the commonest ``hot`` ones.

Every word has its own count.  The ``common`` commonest words (all with a count at or
above the least count that keeps them within that number) are numbered and sent to
all tasks, like the hot bigrams: 16 bytes an entry, bounded by these two parameters.
Other words, and bigrams with one, are keyed by hashes and counted by the same
window, or by tables and the same join.  With ``vocabulary`` set, and only then,
words beyond the commonest count as one unknown word.

Cases: a null text, or one without words, has 0 words and a score of 0.  Repeated
rows count, and are scored, as often as they occur; rows with the same id are
scored as one.  Rows with a null id count but are not scored.  Other columns of
the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolefunnel.llm.common import LOWER, WORD, PrefixHash, flat, map_batches, pair_hash, row_of, slices, spans, stored

_START = np.uint64(1)
#: Bits of a word's number inside a bigram's key.
_BITS = 31
#: The two upper bits of a key: 00 two numbered words, 01 a document's own row, 10 a bigram with another word, 11 such a word.
_OWN, _PAIR, _WORD = np.int64(1 << 62), np.uint64(1 << 63), np.uint64(3 << 62)
#: Of so many documents one shows which bigrams are frequent, and how often it must have been met there: they cost time, no result.
HOT_SHARE, HOT_SEEN = 16, 64


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    data, off = flat(column)
    data = LOWER[data]
    starts, ends = spans(data, off, WORD)
    return PrefixHash(data).of(starts, ends), row_of(off, starts), len(off) - 1


def _tally(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    unique, at = np.unique(np.concatenate(keys), return_inverse=True)
    return unique, np.bincount(at, weights=np.concatenate(counts), minlength=len(unique)).astype(np.int64)


def _counted(docs: DataFrame, keys_of, schema: str = "key bigint, n bigint") -> DataFrame:
    """Counts of keys, summed within each batch before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(keys_of(part.column("text")), return_counts=True) for part in slices(batch, "text")]
            if found:
                keys, n = _tally(*map(list, zip(*found, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

    return map_batches(docs, run, schema).groupBy("key").agg(F.sum("n").alias("n"))


def word_keys(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(2) | _WORD).view(np.int64)


@dataclass
class Lexicon:
    """The vocabulary: sorted word hashes, the number of each (by falling count), counts by number."""

    hashes: np.ndarray
    numbers: np.ndarray
    counts: np.ndarray  # by number; then the unknown word, then the start of a text
    total: int
    open: bool  # words without a number keep counts of their own

    def pairs(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]:
        """Key of every word and the word before it, the word's number, its row; rows; names of both words: number or key."""
        hashes, rows, n = _words(column)
        unique, at = np.unique(hashes, return_inverse=True)
        unknown = len(self.hashes)
        if unknown:
            place = np.minimum(np.searchsorted(self.hashes, unique), unknown - 1)
            numbers = np.where(self.hashes[place] == unique, self.numbers[place], unknown)[at]
        else:
            numbers = np.zeros(len(hashes), np.int64)
        before = np.full(len(numbers), unknown + 1)
        before[1:] = np.where(rows[1:] == rows[:-1], numbers[:-1], unknown + 1)
        keys, name, name_before = before << _BITS | numbers, numbers, before
        if self.open:
            name = np.where(numbers == unknown, word_keys(hashes), numbers)
            name_before = before.copy()
            name_before[1:] = np.where(rows[1:] == rows[:-1], name[:-1], before[1:])
            other = (numbers == unknown) | (before == unknown)
            left, right = name_before[other].view(np.uint64), name[other].view(np.uint64)
            keys[other] = (pair_hash(left, right) >> np.uint64(2) | _PAIR).view(np.int64)
        return keys, numbers, rows, n, name_before, name

    def single(self, alpha: float) -> np.ndarray:
        """log(alpha * c(w) / N) by number; 0 for words that are joined."""
        out = np.log(alpha * np.maximum(self.counts, 1) / max(self.total, 1))
        if self.open:
            out[len(self.hashes)] = 0.0
        return out

    def gains(self, keys: np.ndarray, counts: np.ndarray, alpha: float) -> np.ndarray:
        return np.log(counts / self.counts[keys >> _BITS]) - self.single(alpha)[keys & ((1 << _BITS) - 1)]


def lexicon(docs: DataFrame, most: int, open: bool) -> tuple[Lexicon, DataFrame]:
    """Count all words and number the commonest; ``docs`` has text.  Also (key, n) of the other words."""
    words = stored(_counted(docs, lambda c: _words(c)[0]), "backoff-words")
    # Words per count: the least count that keeps the vocabulary within its size.
    by_count = words.groupBy(F.least("n", F.lit(1 << 20)).alias("n")).agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect()
    least, size = 1 << 62, 0
    for row in by_count:
        if size + row["words"] > most:
            break
        least, size = row["n"], size + row["words"]
    all_words = words.agg(F.sum("n")).first()[0] or 0
    kept = words.where(F.col("n") >= least).toArrow()
    hashes, counts = kept.column("key").to_numpy().view(np.uint64), kept.column("n").to_numpy()
    by_rank = np.lexsort((hashes, -counts))
    numbers = np.empty(len(hashes), np.int64)
    numbers[by_rank] = np.arange(len(hashes))
    order = np.argsort(hashes)
    texts = docs.where(F.lower("text").rlike(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")).count()
    found = Lexicon(hashes[order], numbers[order], np.concatenate([counts[by_rank], [all_words - counts.sum(), texts]]).astype(np.float64), int(all_words), open)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(word_keys(batch.column("key").to_numpy().view(np.uint64))), batch.column("n")], ["key", "n"])

    return found, map_batches(words.where(F.col("n") < least), named, "key bigint, n bigint")


def other_bigrams(docs: DataFrame, sent, others: DataFrame, min_count: int, alpha: float) -> DataFrame:
    """(key, n, gain) of every bigram with a word that has no number, as in ``bigram_table``; ``others`` counts those words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value.counts
        for batch in batches:
            for part in slices(batch, "text"):
                keys, _, _, _, v, w = sent.value.pairs(part.column("text"))
                at = np.flatnonzero(keys < 0)
                unique, first, n = np.unique(keys[at], return_index=True, return_counts=True)
                v, w = v[at][first], w[at][first]
                # A numbered word brings its count, and a name that no table has.
                count = [np.where(x >= 0, counts[np.maximum(x, 0)], 0).astype(np.int64) for x in (v, w)]
                name = [np.where(x >= 0, unique, x) for x in (v, w)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (unique, n, *name, *count)], ["key", "n", "v", "w", "cv", "cw"])

    rows = map_batches(docs, run, "key bigint, n bigint, v bigint, w bigint, cv bigint, cw bigint")
    counted = rows.groupBy("key").agg(F.sum("n").alias("n"), *[F.max(c).alias(c) for c in ("v", "w", "cv", "cw")]).where(F.col("n") >= min_count)
    for name in ("v", "w"):
        counted = counted.join(others.select(F.col("key").alias(name), F.col("n").alias(f"n{name}")), name, "left")
    v, w = F.coalesce("nv", "cv"), F.coalesce("nw", "cw")
    return counted.select("key", "n", (F.log(F.col("n") / v) - F.log(F.lit(alpha) * w / F.lit(float(max(sent.value.total, 1))))).alias("gain"))


def bigram_table(docs: DataFrame, sent, min_count: int, alpha: float) -> DataFrame:
    """(key, n, gain) of every bigram of numbered words seen at least ``min_count`` times; ``sent`` is the broadcast lexicon."""

    def numbered(column: pa.Array) -> np.ndarray:
        keys = sent.value.pairs(column)[0]
        return keys[keys >= 0].view(np.uint64)

    counts = _counted(docs, numbered).where(F.col("n") >= min_count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gains = sent.value.gains(batch.column("key").to_numpy(), batch.column("n").to_numpy(), alpha)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(gains)], ["key", "n", "gain"])

    return map_batches(counts, run, "key bigint, n bigint, gain double")


def _least_count(table: DataFrame, most: int) -> int:
    """The least count ``n`` that about the ``most`` commonest keys, at most, have."""
    step = F.floor(F.log2("n") * 4).cast("int")
    sizes = table.groupBy(step.alias("k")).agg(F.count("*").alias("size"), F.min("n").alias("n")).orderBy(F.desc("k")).collect()
    least, size = 1 << 62, 0
    for row in sizes:
        if size + row["size"] > most:
            break
        least, size = row["n"], size + row["size"]
    return least


def _hot(table: DataFrame, most: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Least count of a hot bigram, sorted keys, gains: about the ``most`` commonest, at most."""
    least = _least_count(table, most)
    found = table.where(F.col("n") >= least).select("key", "gain").toArrow()
    keys, gains = found.column("key").to_numpy(), found.column("gain").to_numpy()
    order = np.argsort(keys)
    return least, keys[order], gains[order]


def _among(keys: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is one of ``sorted_keys``, and its place there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    place = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[place] == keys, place


def hot_bigrams(slim: DataFrame, sent, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of bigrams of numbered words that a share of the documents shows to be frequent; their counts in all documents."""

    def numbered(column: pa.Array) -> np.ndarray:
        keys = sent.value.pairs(column)[0]
        return keys[keys >= 0].view(np.uint64)

    sample = slim.where(F.pmod(F.xxhash64(F.lit("hot"), "id"), F.lit(HOT_SHARE)) == 0)
    met = stored(_counted(sample.select("text"), numbered).where(F.col("n") >= HOT_SEEN), "backoff-frequent")
    keys = np.sort(met.where(F.col("n") >= _least_count(met, most)).toArrow().column("key").to_numpy())
    if not len(keys):
        return keys, np.zeros(0)
    wanted = slim.sparkSession.sparkContext.broadcast(keys)

    def chosen(column: pa.Array) -> np.ndarray:
        found = sent.value.pairs(column)[0]
        return found[_among(found, wanted.value)[0]].view(np.uint64)

    counts = _counted(slim.select("text"), chosen).toArrow()
    keys, n = counts.column("key").to_numpy(), counts.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order].astype(np.float64)


def _seen_scores(slim: DataFrame, sent, hot: int) -> DataFrame:
    """(id, n_words, total) where every bigram that was seen counts."""
    near = slim.sparkSession.sparkContext.broadcast(hot_bigrams(slim, sent, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (keys_hot, counts_hot) = sent.value, near.value
        logs, logs_hot = np.log(np.maximum(words.counts, 1)), np.log(counts_hot)
        for batch in batches:
            for part in slices(batch, "text"):
                keys, _, rows, n, before, name = words.pairs(part.column("text"))
                count = np.bincount(rows, minlength=n)
                base = -np.bincount(rows, weights=np.where(before >= 0, logs[np.maximum(before, 0)], 0.0), minlength=n)
                is_hot, place = _among(keys, keys_hot)
                base += np.bincount(rows[is_hot], weights=logs_hot[place[is_hot]], minlength=n)
                # One row for each bigram of a document, and for each word without a number.
                other = np.flatnonzero(name < 0)
                cold = np.concatenate([keys[~is_hot], name[other]])
                unique, at = np.unique(cold, return_inverse=True)
                size = max(len(unique), 1)
                both, many = np.unique(np.concatenate([rows[~is_hot], rows[other]]) * size + at, return_counts=True)
                many *= 2
                # The last word of a text stands before no other: the odd number says so.
                last = np.flatnonzero(np.append(rows[1:] != rows[:-1], True)) if len(rows) else rows
                last = last[name[last] < 0]
                many[np.searchsorted(both, rows[last] * size + np.searchsorted(unique, name[last]))] += 1
                ids = part.column("id")
                # A document's own row has a key that no bigram has.
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([_OWN + np.arange(n), unique[both % size]])), pa.concat_arrays([ids, ids.take(pa.array(both // size))]),
                        pa.array(np.concatenate([count, many])), pa.array(np.concatenate([base, np.zeros(len(both))])),
                    ],
                    ["key", "id", "n", "base"],
                )

    rows = map_batches(slim, run, "key bigint, id bigint, n bigint, base double")
    times = F.shiftright("n", 1)
    counted = rows.withColumn("c", F.sum(times).over(Window.partitionBy("key")))
    mine = F.col("key") >= F.lit(int(_OWN))
    word = F.col("key").between(F.lit(-(1 << 62)), F.lit(-1))
    log = F.when(word, F.col("n").bitwiseAND(F.lit(1)) - times).otherwise(times) * F.log("c")
    return counted.where(F.col("id").isNotNull() & (mine | (F.col("c") > 1))).groupBy("id").agg(
        F.sum(F.when(mine, F.col("n")).otherwise(F.lit(0))).alias("n_words"),
        F.sum(F.when(mine, F.col("base")).otherwise(log)).alias("total"),
    )


def backoff_scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    alpha: float = 0.4,
    min_count: int = 1,
    vocabulary: int | None = None,
    hot: int = 1_000_000,
    common: int = 1_000_000,
) -> DataFrame:
    """(id, n_words, total): words and summed log scores of every document.

    With a greater ``min_count`` bigrams seen less often back off to their word.
    """
    context = docs.sparkSession.sparkContext
    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    found, others = lexicon(slim.select("text"), common if vocabulary is None else vocabulary, vocabulary is None)
    sent = context.broadcast(found)
    if min_count <= 1:
        return _seen_scores(slim, sent, hot)
    counts = bigram_table(slim.select("text"), sent, min_count, alpha)
    if found.open and not others.isEmpty():
        others = stored(others, "backoff-others")
        alone = others.select("key", "n", F.log(F.lit(alpha) * F.col("n") / F.lit(float(found.total))).alias("gain"))
        counts = counts.unionByName(other_bigrams(slim.select("text"), sent, others, min_count, alpha)).unionByName(alone)
    table = stored(counts, "backoff-bigrams")
    least, hot_keys, hot_gains = _hot(table, hot)
    near = context.broadcast((hot_keys, hot_gains))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (keys_hot, gains_hot) = sent.value, near.value
        single = words.single(alpha)
        for batch in batches:
            for part in slices(batch, "text"):
                keys, numbers, rows, n, _, name = words.pairs(part.column("text"))
                count = np.bincount(rows, minlength=n)
                base = np.bincount(rows, weights=single[numbers], minlength=n)
                other = name < 0  # what these words score alone is in the table as well
                keys, rows = np.concatenate([keys, name[other]]), np.concatenate([rows, rows[other]])
                unique, at = np.unique(keys, return_inverse=True)
                is_hot = np.zeros(len(unique), bool)
                if len(keys_hot):
                    place = np.minimum(np.searchsorted(keys_hot, unique), len(keys_hot) - 1)
                    is_hot = keys_hot[place] == unique
                    base += np.bincount(rows, weights=np.where(is_hot, gains_hot[place], 0.0)[at], minlength=n)
                cold = np.flatnonzero(~is_hot[at])
                # One row for each bigram of a document.
                both, many = np.unique(rows[cold] * len(unique) + at[cold], return_counts=True)
                ids = part.column("id").to_numpy(zero_copy_only=False)
                owner, which = both // max(len(unique), 1), both % max(len(unique), 1)
                # A document's own row has a key that no bigram has.
                own = _OWN + np.arange(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([own, unique[which]])), pa.array(np.concatenate([ids, ids[owner]])),
                        pa.array(np.concatenate([count, many])), pa.array(np.concatenate([base, np.zeros(len(which))])),
                    ],
                    ["key", "id", "n", "base"],
                )

    rows = map_batches(slim.where("id is not null"), run, "key bigint, id bigint, n bigint, base double")
    joined = rows.join(table.where(F.col("n") < least).select("key", "gain"), "key", "left")
    mine = F.col("key") >= F.lit(int(_OWN))
    return joined.groupBy("id").agg(
        F.sum(F.when(mine, F.col("n")).otherwise(F.lit(0))).alias("n_words"),
        F.sum(F.when(mine, F.col("base")).otherwise(F.col("n") * F.coalesce("gain", F.lit(0.0)))).alias("total"),
    )
