"""Quality scores from a sparse ensemble of rules over text statistics.

Shallow boosted trees are grown on a bounded sample of labelled rows; every path
from a root is a conjunction of thresholds, i.e. a rule.  A logistic model with
an L1 penalty keeps few of the rules, and those become one Spark column
expression over the statistics, so that scoring is a projection.

Cases: a null text counts as empty; all statistics of an empty text are 0 and it
is scored like any other.  Repeated rows are scored alike.  Labels other than 0
and 1 or null are ignored; of several labels of a document the largest counts.
With no label, or one class only, the score is the smoothed share of label 1.
Columns of the input other than id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefunnel.llm.common import LOWER, VISIBLE, PrefixHash, bounded_sample, flat, map_slices, pair_hash, per_row, row_of, spans, stored

FEATURES = (
    "n_words", "word_len", "longest", "upper", "digit", "stop", "comma", "symbol", "high", "space",
    "short", "symbol_end", "stutter", "distinct", "commonest", "dup_words3", "line_len", "dup_lines", "entropy", "pipe",
)


def _bytes(chars: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars.encode())] = True
    return found


_UPPER, _LOWERCASE, _DIGIT = (_bytes("".join(map(chr, range(ord(a), ord(z) + 1)))) for a, z in ("AZ", "az", "09"))
_STOP, _COMMA, _PIPE = _bytes(".!?"), _bytes(",;:'\"-()"), _bytes("|")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[0x21:0x7F] = True
_SYMBOL &= ~(_UPPER | _LOWERCASE | _DIGIT | _STOP | _COMMA)
_HIGH = np.zeros(256, bool)
_HIGH[0x80:] = True
_NOT_LINE = np.ones(256, bool)
_NOT_LINE[10] = False


def _distinct(keys: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each row, and the count of its commonest key."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, rows))
    k, r = keys[order], rows[order]
    first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])]))
    count = np.diff(np.append(first, len(k)))
    most = np.zeros(n)
    np.maximum.at(most, r[first], count)
    return np.bincount(r[first], minlength=n), most


def statistics_of(column: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of every text of an Arrow string column."""
    data, off = flat(column)
    n, size = len(off) - 1, np.maximum(np.diff(off), 1)
    share = lambda kind: per_row(kind[data], off) / size
    starts, ends = spans(data, off, VISIBLE)
    rows = row_of(off, starts)
    words = np.bincount(rows, minlength=n)
    some = np.maximum(words, 1)
    each = lambda flags: np.bincount(rows, weights=flags, minlength=n) / some
    length = ends - starts
    longest = np.zeros(n)
    np.maximum.at(longest, rows, length)
    hashes = PrefixHash(LOWER[data]).of(starts, ends)
    same = np.zeros(len(rows), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    distinct, commonest = _distinct(hashes, rows, n)
    three = np.flatnonzero(rows[2:] == rows[:-2]) if len(rows) > 2 else np.zeros(0, np.int64)
    triples, _ = _distinct(pair_hash(pair_hash(hashes[three], hashes[three + 1]), hashes[three + 2]), rows[three], n)
    n_triples = np.bincount(rows[three], minlength=n)
    line_from, line_to = spans(data, off, _NOT_LINE)
    line_rows = row_of(off, line_from)
    lines = np.bincount(line_rows, minlength=n)
    distinct_lines, _ = _distinct(PrefixHash(data).of(line_from, line_to), line_rows, n)
    letters = np.maximum(per_row(_UPPER[data] | _LOWERCASE[data], off), 1)
    doc = np.repeat(np.arange(n), np.diff(off))
    counts = np.bincount(doc * 128 + (LOWER[data] & 127), minlength=n * 128).reshape(n, 128)
    p = counts / size[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    last = data[ends - 1] if len(ends) else data
    out = {
        "n_words": words, "word_len": each(length), "longest": longest, "upper": per_row(_UPPER[data], off) / letters,
        "digit": share(_DIGIT), "stop": share(_STOP), "comma": share(_COMMA), "symbol": share(_SYMBOL), "high": share(_HIGH),
        "space": share(~VISIBLE), "short": each(length <= 3), "symbol_end": each(_SYMBOL[last] | (last == ord("!"))),
        "stutter": each(same), "distinct": distinct / some, "commonest": commonest / some,
        "dup_words3": 1 - triples / np.maximum(n_triples, 1) * (n_triples > 0) - (n_triples == 0),
        "line_len": np.bincount(line_rows, weights=line_to - line_from, minlength=n) / np.maximum(lines, 1),
        "dup_lines": 1 - distinct_lines / np.maximum(lines, 1) - (lines == 0), "entropy": entropy, "pipe": share(_PIPE),
    }
    return {k: np.asarray(out[k], np.float64) for k in FEATURES}


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, one double per statistic) of every document."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, statistics_of(part.column(1)).values())], ["id", *FEATURES])

    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return map_slices(slim, work, "id bigint, " + ", ".join(f"{f} double" for f in FEATURES))


Condition = tuple[int, bool, float]  # feature, above the threshold?, threshold


@dataclass
class RuleModel:
    """``intercept`` plus the weight of every rule that holds, through a logistic curve."""

    intercept: float
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def column(self, names: Sequence[str] = FEATURES) -> Column:
        """The score as one expression over columns called ``names``."""
        margin = F.lit(float(self.intercept))
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for feature, above, at in conditions:
                value = F.col(names[feature])
                holds = holds & (value > F.lit(at) if above else value <= F.lit(at))
            margin = margin + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def _holds(x: np.ndarray, conditions: Sequence[Condition]) -> np.ndarray:
    held = np.ones(len(x), bool)
    for feature, above, at in conditions:
        held &= (x[:, feature] > at) if above else (x[:, feature] <= at)
    return held


def _tree(x: np.ndarray, cuts: list[np.ndarray], bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, leaf: int):
    """Paths of one tree, root first; each with its rows and its Newton step."""
    paths, todo = [], [((), np.arange(len(x)))]
    while todo:
        path, rows = todo.pop()
        g, h = grad[rows].sum(), hess[rows].sum()
        split = None
        if len(path) < depth and len(rows) >= 2 * leaf:
            best = 1e-6
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                b, k = bins[rows, f], len(cut) + 1
                gl = np.cumsum(np.bincount(b, weights=grad[rows], minlength=k))[:-1]
                hl = np.cumsum(np.bincount(b, weights=hess[rows], minlength=k))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=k))[:-1]
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                gain[(nl < leaf) | (len(rows) - nl < leaf)] = 0
                at = int(np.argmax(gain))
                if gain[at] > best:
                    best, split = gain[at], (f, at)
        if path:
            paths.append((path, rows, g / (h + 1), split is None))
        if split:
            f, at = split
            low = bins[rows, f] <= at
            for above, part in ((False, rows[low]), (True, rows[~low])):
                todo.append(((*path, (f, above, float(cuts[f][at]))), part))
    return paths


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 4e-4, rounds: int = 300) -> RuleModel:
    """Grow trees on the sample, turn their paths into rules, weigh the rules with a lasso."""
    share = (y.sum() + 1) / (len(y) + 2)
    prior = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return RuleModel(prior)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 49))) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    leaf, margin, rules = max(3, len(y) // 1000), np.full(len(y), prior), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        for path, rows, step, is_leaf in _tree(x, cuts, bins, y - p, p * (1 - p), depth, leaf):
            rules[tuple(sorted(path))] = None
            if is_leaf:
                margin[rows] += 0.3 * step
    paths = list(rules)
    held = np.stack([_holds(x, r) for r in paths], 1).astype(np.float32)
    mean = held.mean(0)
    spread = np.maximum(np.sqrt(mean * (1 - mean)), 0.01)
    z = (held - mean) / spread
    step = 4 * len(y) / max(np.linalg.norm(z[:: max(1, len(z) // 4000)], 2) ** 2 * max(1, len(z) // 4000) * 1.1, 1e-9)
    w, bias, ahead, t = np.zeros(len(paths)), prior, np.zeros(len(paths)), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(z @ ahead.astype(np.float32) + bias)))
        new = ahead + step * (z.T @ (y - p).astype(np.float32)) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        bias += 4 * (y - p).mean()
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (last - 1) / t * (new - w), new
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    raw = w / spread
    return RuleModel(float(bias - (raw * mean).sum()), [(paths[i], float(raw[i])) for i in kept])


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", most: int = 20_000) -> RuleModel:
    """A rule model from about ``most`` labelled rows at most; ``stats`` as of ``text_statistics``."""
    truth = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.max(label).alias("y"))
    sample = bounded_sample(stats.join(truth, "id"), "id", most).select("y", *FEATURES).toPandas()
    return fit_rules(sample[list(FEATURES)].to_numpy(np.float64), sample["y"].to_numpy(np.float64))


def quality_scores(docs: DataFrame, labels: DataFrame, train: Column | None = None, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = 20_000) -> DataFrame:
    """(id, score) of every document; labels are learned from rows where ``train`` holds, a column over ``id``."""
    stats = stored(text_statistics(docs, id_col, text_col), "quality-statistics")
    model = fit(stats if train is None else stats.where(train), labels, label, id_col, most)
    return stats.select("id", model.column().alias("score"))
