"""Toxicity by two class-conditional Kneser-Ney bigram models.

One model is counted on toxic, one on ordinary labelled texts.  Each
interpolates its discounted bigrams with the continuation counts of words, those
with the continuation counts of word stems (leading bytes, for inflected forms)
and the last with continuation counts of both classes together, so that a rare
expression falls back on the same probability in both.  A text is judged by the
difference of log-likelihoods per word: over the whole text, over its worst run
of ``window`` words (insults hide in long texts), and by what its words exceed
``EXCESS`` by.  A logistic curve fitted on labelled texts left out of the counts
turns that into a score.

The counts come from about ``most`` toxic texts and ``ORDINARY`` times as many
ordinary ones at most (a documented bound on the model, which is sent to all
tasks); every text is scored, in whole.  They are summed by Spark; pairs seen once
count for the lower levels but have no entry of their own.

Cases: a text without words (null, empty, marks only) has difference 0 and gets
the score that the curve has there.  Labels other than 0, 1 or null are ignored;
of several labels of a document the largest counts.  Without labels of both
classes the score is the smoothed share of label 1.  Repeated rows are scored
alike.  Other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefunnel.llm.common import LOWER, WORD, PrefixHash, bounded_sample, flat, map_slices, pair_hash, row_of, spans, stored

DISCOUNT = 0.75
EXCESS = 3.0
#: Ordinary texts in the sample for each toxic one.
ORDINARY = 4
#: Bytes of a word's stems, from long to short.
STEMS = (5, 4)
_START = np.uint64(1)
_KEYS = ["v", "w", *(f"s{k}" for k in STEMS)]


def word_pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Hashes of every word and its stems (levels x words), of the word before it (a mark at a text's start), its row; rows."""
    data, off = flat(column)
    data = LOWER[data]
    starts, ends = spans(data, off, WORD)
    rows = row_of(off, starts)
    hashes = PrefixHash(data)
    levels = np.stack([hashes.of(starts, ends), *(hashes.of(starts, np.minimum(ends, starts + k)) for k in STEMS)])
    before = np.full(len(starts), _START)
    before[1:] = np.where(rows[1:] == rows[:-1], levels[0, :-1], _START)
    return levels, before, rows, len(off) - 1


@dataclass
class ToxicModel:
    """Arrays in the order of sorted keys; index 0 is toxic, 1 ordinary."""

    words: np.ndarray
    base: np.ndarray  # 2 x words: interpolated unigram probability
    contexts: np.ndarray
    left: np.ndarray  # 2 x contexts: weight of the unigram level after this word
    pairs: np.ndarray
    part: np.ndarray  # 2 x pairs: discounted relative frequency
    stems: list[tuple[np.ndarray, np.ndarray]]  # per stem level: sorted keys, 2 x keys: probability of an unknown word with it
    curve: np.ndarray = None  # mean, spread, weights of the logistic curve
    window: int = 3

    def ratios(self, levels: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log p(word | toxic) - log p(word | ordinary) of every word."""
        base = np.ones((2, len(before)))
        for hashes, (keys, prob) in reversed(list(zip(levels[1:], self.stems, strict=True))):
            at, known = _find(keys, hashes)
            base = np.where(known, prob[:, at], base)
        w, known = _find(self.words, levels[0])
        base = np.where(known, self.base[:, w], base)
        v, after = _find(self.contexts, before)
        p, found = _find(self.pairs, pair_hash(before, levels[0]))
        # A word that no text of the sample has: its probability given the stem is shared and cancels out.
        prob = np.where(found, self.part[:, p], 0) + np.where(after, self.left[:, v], 1) * base
        return np.log(prob[0]) - np.log(prob[1])

    def differences(self, column: pa.Array) -> np.ndarray:
        """Per text: mean log-ratio, log-ratio per word of the worst window, log excess, log length."""
        levels, before, rows, n = word_pairs(column)
        if not len(before):
            return np.zeros((n, len(MEASURES)))
        ratio = self.ratios(levels, before)
        total = np.concatenate([[0], np.cumsum(ratio)])
        count = np.bincount(rows, minlength=n)
        first = np.cumsum(count) - count
        size = np.minimum(count, self.window)
        mean = (total[first + count] - total[first]) / np.maximum(count, 1)
        at = np.arange(len(before))
        upto = at + size[rows]
        inside = upto <= (first + count)[rows]
        worst = np.full(n, -np.inf)
        np.maximum.at(worst, rows[inside], (total[upto[inside]] - total[at[inside]]) / size[rows[inside]])
        excess = np.bincount(rows, weights=np.maximum(ratio - EXCESS, 0), minlength=n)
        return np.stack([mean, np.where(count > 0, worst, 0), np.log1p(excess), np.log1p(count)], 1)

    def score(self, differences: np.ndarray) -> np.ndarray:
        mean, spread, w = self.curve
        return 1 / (1 + np.exp(-np.clip(((differences - mean[:-1]) / spread[:-1]) @ w[:-1] + w[-1], -30, 30)))


MEASURES = ["mean", "worst", "excess", "length"]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _level(which: np.ndarray, size: int, seen: np.ndarray, below: np.ndarray) -> np.ndarray:
    """2 x size: discounted continuation counts of each class over the level ``below`` (2 x size, sums to 1)."""
    out = np.empty((2, size))
    for c in range(2):
        count = np.bincount(which, weights=seen[c], minlength=size)
        total = count.sum()
        out[c] = (np.maximum(count - DISCOUNT, 0) + DISCOUNT * (count > 0).sum() * below[c]) / total if total else below[c]
    return out


def kneser_ney(words: tuple[np.ndarray, np.ndarray], contexts: tuple[np.ndarray, np.ndarray], pairs: tuple[np.ndarray, np.ndarray]) -> ToxicModel:
    """From keys and 2 x n counts by class of words, contexts and pairs.

    Words have rows of their hash and their stems, and count the distinct words
    before them; contexts count their followers; pairs (word before, word) may be
    some of all pairs, the rest being left to the lower level.
    """
    keys, seen = words
    order = np.argsort(keys[0])
    keys, seen = keys[:, order], seen[:, order]
    both = seen.sum(0).astype(float)
    levels = [np.unique(k, return_inverse=True) for k in reversed(keys[1:])] + [(keys[0], np.arange(keys.shape[1]))]
    shared = [np.bincount(at, weights=both, minlength=len(k)) + 1 for k, at in levels]
    base = np.stack([shared[0] / shared[0].sum()] * 2)
    stems = []
    for i, (k, at) in enumerate(levels):
        if i:
            up = np.zeros(len(k), np.int64)
            up[at] = levels[i - 1][1]
            given = shared[i] / np.bincount(up, weights=shared[i], minlength=len(levels[i - 1][0]))[up]
            base = base[:, up] * given
        base = _level(at, len(k), seen, base)
        if i < len(levels) - 1:
            stems.insert(0, (k, base))
    by_context = np.argsort(contexts[0])
    context, total = contexts[0][by_context], np.maximum(contexts[1][:, by_context], 1)
    v = np.searchsorted(context, pairs[0][0])
    part = np.maximum(pairs[1] - DISCOUNT, 0) / total[:, v]
    left = np.stack([1 - np.bincount(v, weights=part[c], minlength=len(context)) for c in range(2)])
    ids = pair_hash(*pairs[0])
    by_pair = np.argsort(ids)
    return ToxicModel(keys[0], base, context, left, ids[by_pair], part[:, by_pair].astype(np.float32), stems)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Mean, spread and weights of a ridge logistic fit by Newton steps."""
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.concatenate([(x - mean) / spread, np.ones((len(x), 1))], 1)
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        ridge = np.diag([1.0] * x.shape[1] + [1e-3])
        w += np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - ridge @ w)
    return np.stack([np.append(mean, 0), np.append(spread, 1), w])


def _arrays(frame: DataFrame, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts by class of a table that the bounded sample keeps small."""
    table = frame.select(*keys, "toxic", "ordinary").toArrow()
    return np.stack([table.column(k).to_numpy().view(np.uint64) for k in keys]), np.stack([table.column(c).to_numpy() for c in ("toxic", "ordinary")])


def _single(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return keys[0], counts


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, label: str = "toxic", most: int = 2000, window: int = 3) -> ToxicModel | float:
    """The model, or the smoothed share of label 1 where the labels hold one class only; ``docs`` has id and text."""
    truth = labels.where(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(F.max(label).alias("y"))
    truth = truth if train is None else truth.where(train)
    sizes = dict(truth.groupBy("y").count().collect())
    if not (sizes.get(0) and sizes.get(1)):
        return (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
    chosen = bounded_sample(truth.where("y = 1"), "id", most).union(bounded_sample(truth.where("y = 0"), "id", ORDINARY * most))
    # The sample is bounded by ``most``, so it may be sent to all tasks.
    texts = docs.join(F.broadcast(chosen), "id").select("id", "y", "text", (F.pmod(F.xxhash64(F.lit("curve"), "id"), F.lit(4)) == 0).alias("curve"))

    def count(part: pa.RecordBatch) -> pa.RecordBatch | None:
        levels, before, rows, _ = word_pairs(part.column("text"))
        y = part.column("y").to_numpy(zero_copy_only=False)[rows].astype(np.int64)
        _, first, at = np.unique(pair_hash(before, levels[0]), return_index=True, return_inverse=True)
        tallies = [np.bincount(at[y == c], minlength=len(first)) for c in (1, 0)]
        columns = [before[first], *levels[:, first]]
        return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns] + [pa.array(t.astype(np.int32)) for t in tallies], [*_KEYS, "toxic", "ordinary"])

    pairs = map_slices(texts.where("not curve"), count, ", ".join(f"{c} bigint" for c in _KEYS) + ", toxic int, ordinary int")
    pairs = stored(pairs.groupBy("v", "w").agg(*(F.first(k).alias(k) for k in _KEYS[2:]), *(F.sum(c).cast("int").alias(c) for c in ("toxic", "ordinary"))), "toxicity-pairs")
    if pairs.isEmpty():
        return (sizes[1] + 1) / (sum(sizes.values()) + 2)
    kinds = [F.sum((F.col(c) > 0).cast("int")).alias(c) for c in ("toxic", "ordinary")]
    sums = [F.sum(c).alias(c) for c in ("toxic", "ordinary")]
    model = kneser_ney(
        _arrays(pairs.groupBy("w").agg(*(F.first(k).alias(k) for k in _KEYS[2:]), *kinds), _KEYS[1:]),
        _single(*_arrays(pairs.groupBy("v").agg(*sums), ["v"])),
        _arrays(pairs.where("toxic + ordinary > 1"), ["v", "w"]),
    )
    model.window = window
    held = _apply(texts.where("curve"), model, "y int", lambda m, d: d).toPandas()
    x, y = held[MEASURES].to_numpy(), held["y"].to_numpy()
    drawn = np.bincount(y, minlength=2)
    model.curve = _logistic(x, y, (np.array([sizes[0], sizes[1]]) / np.maximum(drawn, 1))[y] * len(y) / sum(sizes.values()))
    return model


def _apply(docs: DataFrame, model: ToxicModel, keep: str, finish) -> DataFrame:
    """``finish`` of the differences of every text beside the column ``keep``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    name = keep.split()[0]
    columns = MEASURES if finish(None, None) is None else ["score"]

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        found = finish(sent.value, sent.value.differences(part.column("text")))
        return pa.RecordBatch.from_arrays([part.column(name), *(pa.array(x) for x in np.atleast_2d(found.T))], [name, *columns])

    return map_slices(docs.select(name, "text"), work, f"{keep}, " + ", ".join(f"{c} double" for c in columns))


def toxicity_scores(docs: DataFrame, labels: DataFrame, train: Column | None = None, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = 2000, window: int = 3) -> DataFrame:
    """(id, score) of every document; labels are learned from rows where ``train`` holds, a column over ``id``."""
    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    model = fit(slim, labels, train, label, most, window)
    if isinstance(model, float):
        return slim.select("id", F.lit(model).alias("score"))
    return _apply(slim, model, "id bigint", lambda m, d: "score" if m is None else m.score(d))
