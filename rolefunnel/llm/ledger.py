"""Quality rules as a ledger: every rule is judged once, policies are masks over the stored bits.

One pass over the texts takes the measurements of each document.  Every rule is a
condition on them and owns one bit; a document's failed rules are one integer.  A
policy is a named, versioned choice of rules, hence a mask: its verdict is a
bitwise AND with the stored bits, so a new version, a comparison of two versions
or an ablation never reads a text again.  Ablations come from the number of
documents per distinct set of bits: at most 2 ** rules rows, whatever the corpus.

Measurements are exact: words and lines are compared as strings through
dictionaries, windows of eight words through ranks of pairs, of pairs of pairs,
and of those; no hash stands for a text.

Cases: a text that is null, empty or white space has no words and fails the base
rules.  Every row is judged by itself: repeated ids, repeated rows and rows
without an id come back as often as they came.  An empty table gives an empty
ledger.  Other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefunnel.llm.common import VISIBLE, flat, map_slices, per_row, row_of, spans

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rule:
    """A condition on the measurements that a document fails; ``bit`` never changes once it is stored."""

    name: str
    bit: int
    fails: str

    @property
    def value(self) -> int:
        return 1 << self.bit


RULES = (
    Rule("few_words", 0, "n_words < 20"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 30 * n_words"),
    Rule("many_symbols", 2, "100 * n_symbols > 10 * word_chars"),
    Rule("repeated_lines", 3, "n_lines > 1 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", 4, "word_chars < 2 * n_words"),
    Rule("long_words", 5, "word_chars > 12 * n_words"),
    Rule("some_symbols", 6, "100 * n_symbols > 3 * word_chars"),
    Rule("few_lines_of_many_words", 7, "n_words > 5000 * greatest(n_lines, 1)"),
)
BASE = ("few_words", "repeated_words")
#: Versions of the policy; a published version is never changed.
POLICIES = {
    "1": BASE,
    "2": (*BASE, "many_symbols", "repeated_lines", "short_words", "long_words"),
    "3-strict": tuple(r.name for r in RULES),
}


def _ids(body: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of the byte strings that stand side by side in ``body``: equal numbers for equal strings."""
    bounds = np.concatenate([[0], ends]).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(body))])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs."""
    if not len(left):
        return left
    return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1].astype(np.int64)


def _repeated_words(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether each word lies in a window that its text holds twice or more."""
    n = len(ids) - WINDOW + 1
    hit = np.zeros(len(ids), bool)
    if n < 2:
        return hit
    # A window is told apart by its text first; ranks of 2, 4 and 8 words follow.
    ranks, step = ids, 1
    while step < WINDOW:
        ranks = _ranks(ranks[: len(ranks) - step], ranks[step:])
        step *= 2
    whole = np.flatnonzero(rows[:n] == rows[WINDOW - 1 :])
    pairs = _ranks(rows[whole], ranks[whole])
    twice = whole[np.bincount(pairs)[pairs] > 1] if len(whole) else whole
    change = np.zeros(len(ids) + 1, np.int64)
    change[twice] += 1
    change[twice + WINDOW] -= 1  # starts are distinct, so plain indexing adds each once
    return np.cumsum(change)[:-1] > 0


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of every text of a column."""
    data, off = flat(column)
    n = len(off) - 1
    starts, ends = spans(data, off, VISIBLE)
    rows = row_of(off, starts)
    inside = VISIBLE[data]
    word_ids = _ids(data[inside], np.cumsum(ends - starts))
    lead = (data & 0xC0) != 0x80
    # Lines: one more than the newlines of each text.
    feed = data == 0x0A
    feeds = np.flatnonzero(feed)
    feed_rows = row_of(off, feeds)
    per_text = np.bincount(feed_rows, minlength=n) + 1
    first_line = np.cumsum(per_text) - per_text
    line_ends = np.concatenate([feeds, off[1:]])
    line_rows = np.concatenate([feed_rows, np.arange(n)])
    order = np.lexsort((np.concatenate([np.zeros(len(feeds), np.int8), np.ones(n, np.int8)]), line_ends, line_rows))
    line_ends, line_rows = line_ends[order], line_rows[order]
    before = np.concatenate([[0], np.cumsum(feed)])
    line_ids = _ids(data[~feed], line_ends - before[line_ends])
    word_line = first_line[rows] + before[starts] - before[off[:-1]][rows]
    spoken = np.flatnonzero(np.bincount(word_line, minlength=len(line_ends)) > 0)
    pairs = _ranks(line_rows[spoken], line_ids[spoken])
    once = np.unique(pairs, return_index=True)[1]
    lines = np.bincount(line_rows[spoken], minlength=n)
    again = _repeated_words(word_ids, rows)
    return {
        "n_words": np.bincount(rows, minlength=n),
        "word_chars": per_row(inside & lead, off),
        "n_symbols": per_row(_SYMBOL[data], off),
        "n_lines": lines,
        "n_dup_lines": lines - np.bincount(line_rows[spoken[once]], minlength=n),
        "n_repeat_words": np.bincount(rows[again], minlength=n),
    }


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, measurements, failed) of every document: ``failed`` holds the bit of each rule that it fails."""
    if len({r.bit for r in rules}) < len(rules) or not all(0 <= r.bit < 63 for r in rules):
        raise ValueError("each rule needs a bit of its own from 0 to 62")

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        found = measure(part.column("__text"))
        return pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(found[m].astype(np.int64)) for m in MEASURES)], ["id", *MEASURES])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"))
    kind = slim.schema["id"].dataType.simpleString()
    found = map_slices(slim, work, f"id {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES), text="__text")
    bits = F.lit(0).cast("bigint")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(rule.value)).otherwise(0).cast("bigint"))
    return found.withColumn("failed", bits)


def mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    """The bits of the named rules."""
    of = {r.name: r.value for r in rules}
    return sum(of[n] for n in set(names))


def failed_of(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> Column:
    """The bits of ``failed`` that count under a policy of these rules."""
    return F.col("failed").bitwiseAND(F.lit(mask(names, rules)).cast("bigint"))


def kept(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> Column:
    return failed_of(names, rules) == 0


def decisive(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> Column:
    """The name of the one rule without which the policy would keep the document; else null."""
    bits, out = failed_of(names, rules), F.lit(None).cast("string")
    for rule in rules:
        out = F.when(bits == rule.value, F.lit(rule.name)).otherwise(out)
    return out


def histogram(found: DataFrame) -> DataFrame:
    """(failed, n): documents per set of failed rules, at most 2 ** rules rows."""
    return found.groupBy("failed").agg(F.count("*").alias("n"))


def ablations(found: DataFrame, policies: dict[str, tuple[str, ...]] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(policy, rule, n_docs, n_kept, n_failed, n_decisive, n_kept_without) for every rule of every policy.

    ``n_decisive`` documents fail this rule of the policy and no other; without the
    rule they would be kept too.
    """
    of = {r.name: r.value for r in rules}
    plans = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask(names, rules)).cast("bigint").alias("mask"), F.lit(of[r]).cast("bigint").alias("bit"))
                      for p, names in policies.items() for r in sorted(set(names), key=of.__getitem__)])
    rows = histogram(found).select("failed", "n", F.inline(plans))
    bits = F.col("failed").bitwiseAND(F.col("mask"))
    count = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0)).alias
    out = rows.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_docs"),
        count(bits == 0)("n_kept"),
        count(bits.bitwiseAND(F.col("bit")) != 0)("n_failed"),
        count(bits == F.col("bit"))("n_decisive"),
    )
    return out.withColumn("n_kept_without", F.col("n_kept") + F.col("n_decisive"))


def changes(found: DataFrame, old: tuple[str, ...], new: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(kept_before, kept_now, n): what a new version of a policy does to the documents of the old one."""
    both = histogram(found).select(kept(old, rules).alias("kept_before"), kept(new, rules).alias("kept_now"), "n")
    return both.groupBy("kept_before", "kept_now").agg(F.sum("n").alias("n"))
