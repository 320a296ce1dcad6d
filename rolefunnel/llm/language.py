"""Languages of words and documents by a linear-chain conditional random field.

A word's features are its bytes as a whole (lexicon), its leading and trailing
bytes (affixes) and its byte trigrams; weights of features and of transitions
between the labels of neighbouring words are learned together by gradient steps
on the conditional likelihood.  Learning sees a bounded, documented sample of
labelled texts per language, cut into stretches that are put into a mixed order,
so that the transitions are those of text that switches.  Inference is exact
forward-backward over the whole document: stretches of a document are condensed
to label-by-label matrices side by side, the messages between the stretches are
passed on, and then each stretch is worked through.

A document's language is the label with the largest sum of word marginals (of
equal ones the first in order), and its score is that sum per word.

Cases: ``und`` with score 0 for a null text, an empty one, one without a letter,
or where no labelled text exists.  A single learned language is predicted with
score 1.  Repeated rows get equal results; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefunnel.llm.common import LOWER, PrefixHash, flat, map_slices, mix, row_of, spans

BUCKETS = 1 << 16
#: Words of a stretch.
STRETCH = 32
#: Of a longer training text a stretch of so many characters is learned from; texts to label may have any length.
LONGEST_SAMPLE = 20_000
_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True


@dataclass
class Words:
    """Words of some texts, in order: which distinct word each is, its row, and features of the distinct words."""

    kind: np.ndarray
    row: np.ndarray
    rows: int
    feature: np.ndarray
    owner: np.ndarray
    kinds: int


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    return (mix(h + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(48)).astype(np.int64)


def words_of(column: pa.Array) -> Words:
    data, off = flat(column)
    data = LOWER[data]
    starts, ends = spans(data, off, _LETTER)
    hashes = PrefixHash(data)
    _, first, kind = np.unique(hashes.of(starts, ends), return_index=True, return_inverse=True)
    s, e = starts[first], ends[first]
    n = len(first)
    feature, owner = [_bucket(hashes.of(s, e), 0)], [np.arange(n)]
    for k in (1, 2, 3):
        feature += [_bucket(hashes.of(s, np.minimum(s + k, e)), k), _bucket(hashes.of(np.maximum(e - k, s), e), 8 + k)]
        owner += [np.arange(n)] * 2
    grams = np.maximum(e - s - 2, 0)
    who = np.repeat(np.arange(n), grams)
    at = s[who] + np.arange(len(who)) - np.repeat(np.cumsum(grams) - grams, grams)
    three = data[at].astype(np.uint64) << np.uint64(16) | data[at + 1].astype(np.uint64) << np.uint64(8) | data[at + 2] if len(at) else np.zeros(0, np.uint64)
    feature.append(_bucket(three, 20))
    owner.append(who)
    return Words(kind.ravel(), row_of(off, starts), len(off) - 1, np.concatenate(feature), np.concatenate(owner), n)


def _layout(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches per row, the first stretch of each row, and (stretch, place in it) as one flat index per word."""
    stretches = -(-count // STRETCH)
    first = np.cumsum(stretches) - stretches
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    stretch = np.repeat(first, count) + within // STRETCH
    return stretches, first, within % STRETCH * max(int(stretches.sum()), 1) + stretch


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(-1, keepdims=True)


def marginals(scores: np.ndarray, transitions: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of every word's label (words x labels) and expected transitions; rows of ``count`` words each."""
    labels = scores.shape[1]
    a = np.exp(transitions)
    stretches, first, place = _layout(count)
    n = int(stretches.sum())
    e = np.ones((STRETCH * n, labels))
    e[place] = np.exp(scores - scores.max(1, keepdims=True))
    e = e.reshape(STRETCH, n, labels)
    real = np.zeros(STRETCH * n, bool)
    real[place] = True
    real = real.reshape(STRETCH, n)
    whole = np.broadcast_to(np.eye(labels), (n, labels, labels)).copy()
    for t in range(STRETCH):
        step = (whole.reshape(-1, labels) @ a).reshape(n, labels, labels) * e[t][:, None, :]
        step /= step.sum((1, 2), keepdims=True)
        whole = np.where(real[t][:, None, None], step, whole)
    into, out = np.full((n, labels), 1 / labels), np.full((n, labels), 1 / labels)
    active = np.flatnonzero(stretches > 1)
    for k in range(1, int(stretches.max(initial=0))):
        active = active[stretches[active] > k]
        here = first[active] + k
        into[here] = _unit(np.einsum("nk,nkj->nj", into[here - 1], whole[here - 1]))
        back = first[active] + stretches[active] - 1 - k
        out[back] = _unit(np.einsum("nkj,nj->nk", whole[back + 1], out[back + 1]))
    alpha = np.empty((STRETCH, n, labels))
    before = into
    for t in range(STRETCH):
        alpha[t] = _unit((before @ a) * e[t])
        before = alpha[t]
    post = np.empty((STRETCH, n, labels))
    pairs = np.zeros((labels, labels))
    beta = out
    for t in range(STRETCH - 1, -1, -1):
        post[t] = _unit(alpha[t] * beta)
        right = e[t] * beta
        left = alpha[t - 1] if t else into
        weight = real[t] / np.maximum(np.einsum("ni,ij,nj->n", left, a, right), 1e-300)
        pairs += a * (left.T @ (right * weight[:, None]))
        beta = np.where(real[t][:, None], _unit(right @ a.T), beta)
    return post.reshape(-1, labels)[place], pairs


@dataclass
class LanguageModel:
    labels: list[str]
    weights: np.ndarray  # buckets x labels
    transitions: np.ndarray

    def emissions(self, words: Words) -> np.ndarray:
        return np.stack([np.bincount(words.owner, weights=w[words.feature], minlength=words.kinds) for w in self.weights.T], 1)

    def label_words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
        """Label posteriors of every word, its row, number of rows."""
        words = words_of(column)
        if not len(words.kind):
            return np.zeros((0, len(self.labels))), words.row, words.rows
        scores = self.emissions(words)[words.kind]
        return marginals(scores, self.transitions, np.bincount(words.row, minlength=words.rows))[0], words.row, words.rows

    def label_texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Label number (-1 without words) and score of every text."""
        post, row, n = self.label_words(column)
        sums = np.stack([np.bincount(row, weights=p, minlength=n) for p in post.T], 1)
        count = np.bincount(row, minlength=n)
        best = sums.argmax(1)
        return np.where(count > 0, best, -1), np.minimum(sums[np.arange(n), best] / np.maximum(count, 1), 1.0)


def fit_texts(texts: list[str], langs: list[str], rounds: int = 40, rate: float = 0.15, ridge: float = 1e-4, seed: int = 7) -> LanguageModel:
    """Adam on the conditional likelihood of the mixed stretches of all texts."""
    labels = sorted(set(langs))
    words = words_of(pa.array(texts, pa.string()))
    gold = np.array([labels.index(x) for x in langs])[words.row] if len(words.row) else np.zeros(0, np.int64)
    size = len(labels)
    model = LanguageModel(labels, np.zeros((BUCKETS, size)), np.zeros((size, size)))
    if size < 2 or not len(words.kind):
        return model
    # Stretches of a text in a mixed order, a label weighing the same whatever its share.
    count = np.bincount(words.row, minlength=words.rows)
    within = np.arange(len(gold)) - np.repeat(np.cumsum(count) - count, count)
    stretch = np.cumsum(np.append([0], (np.diff(words.row) != 0) | (within[1:] % STRETCH == 0)))
    order = np.argsort(np.random.default_rng(seed).permutation(stretch[-1] + 1)[stretch], kind="stable")
    kind, gold = words.kind[order], gold[order]
    weight = (len(gold) / size / np.maximum(np.bincount(gold, minlength=size), 1))[gold]
    chain = np.full(-(-len(gold) // 4096), 4096)
    chain[-1] = len(gold) - 4096 * (len(chain) - 1)
    seen = np.zeros((size, size))
    inner = np.flatnonzero(np.arange(1, len(gold)) % 4096)
    np.add.at(seen, (gold[inner], gold[inner + 1]), 1)
    parts = [model.weights, model.transitions]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    truth = np.eye(size)[gold]
    for r in range(1, rounds + 1):
        post, pairs = marginals(model.emissions(words)[kind], model.transitions, chain)
        miss = (post - truth) * weight[:, None] / len(gold)
        by_kind = np.stack([np.bincount(kind, weights=m, minlength=words.kinds) for m in miss.T], 1)
        grads = [
            np.stack([np.bincount(words.feature, weights=g[words.owner], minlength=BUCKETS) for g in by_kind.T], 1) + ridge * model.weights / 100,
            (pairs - seen) / len(gold) + ridge * model.transitions,
        ]
        for p, g, m, v in zip(parts, grads, first, second, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p -= rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return model


def fit(docs: DataFrame, train: Column | None = None, per_language: int = 300, longest: int = LONGEST_SAMPLE) -> LanguageModel | None:
    """Learn from about ``per_language`` texts of each language at most; ``docs`` has id, text and lang.

    A text of more than ``longest`` characters is learned from by a stretch of that
    length, which a hash of its id places, so a language of long texts is learned too.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known if train is None else known.where(train)
    sizes = known.groupBy("lang").count().collect()  # a row per language
    if not sizes:
        return None
    parts = 1 << 30
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(int(parts * min(1.0, per_language / r["count"]))))])
    chosen = known.where(F.pmod(F.xxhash64(F.lit("language"), "id"), F.lit(parts)) < share[F.col("lang")])
    room = F.greatest(F.length("text") - longest, F.lit(0)) + 1
    start = F.pmod(F.xxhash64(F.lit("stretch"), "id"), room).cast("int") + 1
    rows = chosen.select("id", F.substr("text", start, F.lit(longest)).alias("text"), "lang").toArrow().sort_by([("id", "ascending"), ("text", "ascending")])
    if not rows.num_rows:
        return None
    return fit_texts(rows.column("text").to_pylist(), rows.column("lang").to_pylist())


def document_languages(
    docs: DataFrame,
    train: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 300,
    longest: int = LONGEST_SAMPLE,
) -> DataFrame:
    """(id, lang_pred, score) of every document, learned from rows with a language where ``train``, a column over ``id``, holds."""
    all_ = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = fit(all_, train, per_language, longest)
    slim = all_.select("id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if model is None:
        return slim.select("id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        found, score = sent.value.label_texts(part.column("text"))
        some = part.column("letters").to_numpy(zero_copy_only=False).astype(bool) & (found >= 0)
        names = np.array([*sent.value.labels, "und"], object)
        return pa.RecordBatch.from_arrays([part.column("id"), pa.array(names[np.where(some, found, -1)], pa.string()), pa.array(np.where(some, score, 0.0))], ["id", "lang_pred", "score"])

    return map_slices(slim, work, "id bigint, lang_pred string, score double")
