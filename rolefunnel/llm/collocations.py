"""Phrases that occur more often than their parts suggest, found through Rabin-Karp fingerprints.

Prefix polynomials over the words of a text, one space between them, give the
fingerprint of every run of words in one subtraction.  Fingerprints, not phrases,
are counted and shuffled, each with a pointer to an occurrence and the sum of a
second, independent fingerprint over all occurrences.  A phrase is frequent only
where both runs of one word less are, so each length is counted among the runs
that the length before leaves open; what is open is known from a filter of fixed
size (``Filter``), which can let a run pass that is not open, never hold one back.

Frequent fingerprints become phrases at the texts they point to.  There the second
fingerprint of the phrase, times its count, must be the sum of all occurrences;
where it is not, different phrases share a fingerprint, and those are counted again
by their text.  So counts are those of phrases, also with short fingerprints.

Cases: a null text is an empty one and has no phrases; a null language is ``und``
and one with documents so marked.  Repeated rows count as often as they occur, and
ids are not read, so null and repeated ids are as good as others.  Texts of any
length are read whole.  An empty table, or one with no frequent phrase, gives no
rows.  Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolefunnel.llm.common import LOWER, SECOND_BASE, Filter, PrefixHash, flat, map_batches, pair_hash, slices, stored

LEAST = 30
LONGEST = 4
TOP = 2000
#: Counted fingerprints that a task holds before it hands them on, and how many at a time.
HELD = 1 << 19
GIVEN = 1 << 16
#: Bits of the second fingerprint; their sum fits 63 bits up to 2 ** 41 occurrences.
CHECK_BITS = 22

#: A word, for Spark's own functions.
WORD_PATTERN = r"[^ \t.,;:!?\n\x0B\f\r]+"

_WORD, _BLANK, _CUT = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = _CUT


class Words:
    """The words of all texts of a column, and fingerprints of their runs."""

    def __init__(self, column: pa.Array, group: np.ndarray, bits: int = 64):
        data, off = flat(column)
        n = len(off) - 1
        data = np.insert(data, off[1:], 0x0A)  # no piece goes on into the next text
        off = off + np.arange(n + 1)
        kind = _KIND[data]
        inside = kind == _WORD
        step = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        keep = inside.copy()
        keep[ends] = True
        self.body = np.where(inside, LOWER[data], np.uint8(0x20))[keep]
        self.closes = np.cumsum(ends - starts + 1) - 1
        self.opens = self.closes - (ends - starts)
        self.piece = np.cumsum(kind == _CUT)[starts]
        self.row = np.searchsorted(off, starts, "right") - 1
        self.group = group
        self.bits = bits
        self._hashes: dict[int, PrefixHash] = {}

    def runs(self, n: int) -> np.ndarray:
        """First words of all runs of ``n`` words within a piece."""
        at = np.arange(max(len(self.opens) - n + 1, 0))
        return at[self.piece[at] == self.piece[at + n - 1]] if n > 1 else at

    def _of(self, base: int | None, at: np.ndarray, n: int) -> np.ndarray:
        if base not in self._hashes:
            self._hashes[base] = PrefixHash(self.body, base) if base else PrefixHash(self.body)
        return pair_hash(self.group[self.row[at]], self._hashes[base].of(self.opens[at], self.closes[at + n - 1]))

    def fingerprints(self, at: np.ndarray, n: int) -> np.ndarray:
        return self._of(None, at, n) >> np.uint64(64 - self.bits)

    def checks(self, at: np.ndarray, n: int) -> np.ndarray:
        return (self._of(SECOND_BASE, at, n) >> np.uint64(64 - CHECK_BITS)).astype(np.int64)

    def phrase(self, at: int, n: int) -> str:
        return self.body[self.opens[at] : self.closes[at + n - 1]].tobytes().decode("utf-8", "replace")


def _spread(h: Column, bits: int) -> Column:
    """Fingerprints as well mixed 64-bit integers, also short ones."""
    return h if bits == 64 else F.xxhash64(h)


def _united(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct fingerprints with the sums of counts and checks and the smallest pointer."""
    h, n, check, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h, kind="stable")
    h = h[order]
    cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    if not len(cut):
        return h, n, check, doc
    return h[cut], np.add.reduceat(n[order], cut), np.add.reduceat(check[order], cut), np.minimum.reduceat(doc[order], cut)


def _slim(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    lang, text = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(lang.alias("lang"), text.alias("text"))
    return rows.select("lang", "text", F.xxhash64("lang").alias("group"), F.xxhash64(F.lit("doc"), "lang", "text").alias("doc"))


def _words(part: pa.RecordBatch, bits: int) -> Words:
    return Words(part.column("text"), part.column("group").to_numpy(zero_copy_only=False).view(np.uint64), bits)


def counted(slim: DataFrame, n: int, open_runs: Filter | None, bits: int) -> DataFrame:
    """(h, n, check, doc) of runs of ``n`` words, with a filter of those both of whose shorter runs are open."""
    sent = slim.sparkSession.sparkContext.broadcast(open_runs) if open_runs else None

    def count(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        words = _words(part, bits)
        at = words.runs(n)
        if sent:
            shorter = sent.value.has(spread(words.fingerprints(np.arange(max(len(words.opens) - n + 2, 0)), n - 1), bits))
            at = at[shorter[at] & shorter[at + 1]]
        doc = part.column("doc").to_numpy(zero_copy_only=False)[words.row[at]]
        return _united([(words.fingerprints(at, n).view(np.int64), np.ones(len(at), np.int64), words.checks(at, n), doc)])

    def batches_of(found: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(found[0]), GIVEN):
            yield pa.RecordBatch.from_arrays([pa.array(x[low : low + GIVEN]) for x in found], ["h", "n", "check", "doc"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            for part in slices(whole, "text"):
                held.append(count(part))
                size += len(held[-1][0])
                if size > HELD:
                    held = [_united(held)]
                    if len(held[0][0]) > HELD // 2:
                        yield from batches_of(held.pop())
                    size = sum(len(x[0]) for x in held)
        if held:
            yield from batches_of(_united(held))

    return map_batches(slim, run, "h bigint, n bigint, check bigint, doc bigint")


def spread(h: np.ndarray, bits: int) -> np.ndarray:
    """What ``_spread`` gives; short fingerprints are mixed by Spark's own hash of a bigint."""
    if bits == 64:
        return h
    import xxhash

    one = {v: xxhash.xxh64_intdigest(int(v).to_bytes(8, "little"), 42) for v in np.unique(h).tolist()}
    return np.array([one[v] for v in h.tolist()], np.uint64)


def _recounted(slim: DataFrame, wanted: DataFrame, longest: int, bits: int) -> DataFrame:
    """(lang, words, phrase, n) of all phrases with a wanted (words, h), counted by their text."""
    sent = slim.sparkSession.sparkContext.broadcast([Filter.of(wanted.where(F.col("words") == k).select(_spread(F.col("h"), bits))) for k in range(1, longest + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                words, langs = _words(part, bits), part.column("lang").to_pylist()
                for k in range(1, longest + 1):
                    at = words.runs(k)
                    h = words.fingerprints(at, k)
                    hit = np.flatnonzero(sent.value[k - 1].has(spread(h, bits)))
                    rows = [(langs[words.row[at[i]]], k, int(h[i].view(np.int64)), words.phrase(at[i], k)) for i in hit]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["lang", "words", "h", "phrase"])

    found = map_batches(slim, run, "lang string, words bigint, h bigint, phrase string")
    counts = found.groupBy("lang", "words", "h", "phrase").agg(F.count("*").alias("n"))
    return counts.join(wanted.select("words", "h"), ["words", "h"], "left_semi").select("lang", "words", "phrase", "n")


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, n) of every phrase of 1 to ``longest`` words that occurs ``least`` times in its language,
    and (lang, total), the number of words of each language.  ``bits`` is the length of a fingerprint."""
    slim, frequent = _slim(docs, text_col, lang_col), []
    for k in range(1, longest + 1):
        open_runs = Filter.of(frequent[-1].select(_spread(F.col("h"), bits))) if frequent else None
        sums = counted(slim, k, open_runs, bits).groupBy("h").agg(F.sum("n").alias("n"), F.sum("check").alias("check"), F.min("doc").alias("doc"))
        sums = stored(sums.where(F.col("n") >= least), f"collocations-{k}")
        frequent.append(sums.select(F.lit(k).cast("bigint").alias("words"), "h", "n", "check", "doc"))
    totals = slim.groupBy("lang").agg(F.sum(F.regexp_count("text", F.lit(WORD_PATTERN)).cast("bigint")).alias("total"))
    wanted = frequent[0]
    for more in frequent[1:]:
        wanted = wanted.union(more)
    shown = stored(materialised(slim, wanted, longest, bits), "collocations-shown")
    # All occurrences are the phrase shown where the sum of their second fingerprints says so.
    both = wanted.join(shown, ["words", "h"], "left")
    sound = stored(both.where(F.col("n").cast("decimal(38,0)") * F.col("second") == F.col("check")).select("lang", "words", "phrase", "n", "h"), "collocations-sound")
    shared = wanted.join(sound.select("words", "h"), ["words", "h"], "left_anti").select("words", "h")
    out = sound.select("lang", "words", "phrase", "n")
    if not (shared := stored(shared, "collocations-shared")).isEmpty():
        out = out.union(_recounted(slim, shared, longest, bits).where(F.col("n") >= least).select("lang", "words", "phrase", "n"))
    return out, totals


def materialised(slim: DataFrame, wanted: DataFrame, longest: int, bits: int) -> DataFrame:
    """(lang, words, h, phrase, second) of the wanted (words, h, doc), read at the documents they point to."""
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("words", "h")).alias("wanted"))  # no more than the runs of one text
    sent = slim.sparkSession.sparkContext.broadcast(Filter.of(wanted.select("doc")))

    def pointed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keep = sent.value.has(part.column("doc").to_numpy(zero_copy_only=False).view(np.uint64))
            if keep.any():
                yield part.filter(pa.array(keep))

    texts = map_batches(slim, pointed, "lang string, text string, group bigint, doc bigint").dropDuplicates(["doc"])

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                words, langs, rows = _words(part, bits), part.column("lang").to_pylist(), []
                asked = part.column("wanted").combine_chunks() if isinstance(part.column("wanted"), pa.ChunkedArray) else part.column("wanted")
                asked = asked.flatten()
                lengths, hashes = asked.field("words").to_numpy(zero_copy_only=False), asked.field("h").to_numpy(zero_copy_only=False)
                for k in range(1, longest + 1):
                    at = words.runs(k)
                    h = words.fingerprints(at, k).view(np.int64)
                    hit = np.flatnonzero(np.isin(h, hashes[lengths == k]))
                    first = hit[np.unique(h[hit], return_index=True)[1]]
                    second = words.checks(at[first], k)
                    rows += [(langs[words.row[at[i]]], k, int(h[i]), words.phrase(at[i], k), int(s)) for i, s in zip(first, second, strict=True)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["lang", "words", "h", "phrase", "second"])

    found = map_batches(texts.join(lists, "doc"), show, "lang string, words bigint, h bigint, phrase string, second bigint")
    # The same run can be met in several slices; of different phrases with one fingerprint any does, the sums tell.
    return found.dropDuplicates(["words", "h"])


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, bits: int = 64
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of 2 to ``longest`` words of each language.

    A phrase that occurs ``a`` times is cut in two parts that occur ``l`` and ``r`` times;
    its score is floor(2000000 a / (l + r)) at the cut where that is lowest.  A phrase
    within a longer one that occurs at least 80% as often is left out.
    """
    found, totals = phrases(docs, text_col, lang_col, least, longest, bits)
    found = stored(found, "collocations-phrases")
    counts = found.select("lang", "phrase", F.col("n").alias("count"))
    long = found.where("words > 1").select("lang", "phrase", F.col("words").cast("int").alias("words"), F.col("n").alias("a"))
    cuts = long.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - words)")})
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("count").alias(name)), ["lang", side])
    scored = cuts.withColumn("score", F.expr("(2000000 * cast(a AS decimal(20, 0))) div (cast(l AS decimal(20, 0)) + r)"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # What each phrase is part of.
    parts = long.where("words > 2").select("lang", "words", "a", F.split("phrase", " ").alias("w"))
    parts = parts.select("lang", "a", "w", F.explode(F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> (i, m))))")).alias("at"))
    parts = parts.select("lang", F.expr("array_join(slice(w, at.i, at.m), ' ')").alias("phrase"), "a")
    within = parts.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(within, ["lang", "phrase"], "left").where("longer IS NULL OR 5 * cast(longer AS decimal(20, 0)) < 4 * cast(a AS decimal(20, 0))")
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("share"))
    # Ranked in shares first, so that no language is one task.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
