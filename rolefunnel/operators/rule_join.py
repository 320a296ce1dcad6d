"""Phrase matching for rule sets too large for literals: a table of phrases, joined.

``phrases.phrase_hits`` puts its phrases into the plan, which is right for
hundreds.  Here phrases stay rows.  A text gives the n-grams of the lengths that
phrases have, only at words that may open a phrase of that length and are not
negated; each text names an n-gram once, and n-grams meet phrases by an equi-join.
Whether a word may open one is asked of a bit set of fixed size, which the phrases
are folded into in Spark: it lets some words pass that open none, never holds one back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefunnel.functions.constants import const_array
from rolefunnel.functions.text import normalize_text, tokens
from rolefunnel.operators.barrier import add_once
from rolefunnel.operators.rules import Negation

#: Bits that phrase openings are folded into: 8 KiB in the plan, whatever the rules.
OPENING_BITS = 16


def phrase_table(rules: DataFrame) -> DataFrame:
    """``rules`` (phrase, ...) with ``phrase_norm``, its number of words and its first word; empty ones go."""
    normed = add_once(rules, {"phrase_norm": normalize_text(F.col("phrase"))}).filter(F.col("phrase_norm") != "")
    return normed.select("*", F.size(F.split("phrase_norm", " ")).alias("n_words"), F.substring_index("phrase_norm", " ", 1).alias("first_word"))


def _place(word: Column, n: Column) -> Column:
    return F.xxhash64(word, n).bitwiseAND(F.lit((1 << OPENING_BITS) - 1))


def _openings(table: DataFrame) -> tuple[list[int], list[int]]:
    """The lengths of phrases, and the bit set of (first word, length) as 64-bit words."""
    bits = table.select("n_words", _place(F.col("first_word"), F.col("n_words")).alias("p"))
    folded = bits.groupBy(F.shiftright("p", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS INT))")).alias("bits"), F.collect_set("n_words").alias("lengths")
    )
    words, lengths = [0] * (1 << (OPENING_BITS - 6)), set()
    for row in folded.collect():  # at most one row per word of the bit set
        words[row["word"]] = row["bits"]
        lengths.update(row["lengths"])
    return sorted(lengths), words


def candidate_grams(words: Column, lengths: list[int], bits: Column, negation: Negation) -> Column:
    """The distinct n-grams of a text that may be phrases."""
    negators = const_array(negation.words)

    def opens(word: Column, n: int) -> Column:
        p = _place(word, F.lit(n))
        held = F.get(bits, F.shiftright(p, 6).cast("int"))
        return F.call_function("getbit", held, p.bitwiseAND(F.lit(63)).cast("int")) == 1

    def free(i: Column) -> Column:
        before = F.slice(words, F.greatest(i - negation.window, F.lit(0)) + 1, F.least(F.lit(negation.window), i))
        return ~F.arrays_overlap(before, negators)

    def of(n: int) -> Column:
        starts = F.transform(words, lambda w, i: F.when((i <= F.size(words) - n) & opens(w, n) & free(i), F.array_join(F.slice(words, i + 1, n), " ")))
        return F.array_compact(starts)

    return F.array_distinct(F.flatten(F.array(*[of(n) for n in lengths])))


def phrase_hits_joined(docs: DataFrame, key: str, text: Column, rules: DataFrame, negation: Negation = Negation()) -> DataFrame:
    """``rules`` columns and ``key`` for every rule (phrase, ...) with an occurrence in the text that is not negated.

    The same hits as ``phrases.phrase_hits``; ``key`` must be unique.
    """
    table = phrase_table(rules)
    lengths, words = _openings(table)
    if not lengths:
        return docs.select(key).limit(0).join(rules.limit(0), F.lit(True))
    bits = F.array(*[F.lit(w).cast("bigint") for w in words])
    named = add_once(docs.select(key, text.alias("_text")), {"_words": tokens(F.col("_text"))}).drop("_text")
    grams = named.select(key, F.explode(candidate_grams(F.col("_words"), lengths, bits, negation)).alias("phrase_norm"))
    return grams.join(table.drop("n_words", "first_word"), "phrase_norm").select(key, *rules.columns)
