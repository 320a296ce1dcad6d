"""Negation-aware phrase matching, local to the row.

A normalised text holds only words and single spaces, so "the phrase occurs on
word boundaries" means "its words occur consecutively in the token array".
Rule lists are configuration (hundreds of phrases), hence literals: matching
needs neither a join nor a shuffle, and the documents never move.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefunnel.functions.constants import const_array
from rolefunnel.operators.rules import Negation, norm_phrase


def phrase_hits(words: Column, phrases: Iterable[str], negation: Negation = Negation()) -> Column:
    """Distinct normalised phrases with at least one occurrence that is not negated.

    Only positions whose word opens some phrase are looked at; there, one n-gram
    per phrase length that word can open is checked against the phrase set.
    """
    wanted = sorted({n for n in map(norm_phrase, phrases) if n})
    if not wanted:
        return F.array().cast("array<string>")
    openers: dict[int, set[str]] = {}
    for phrase in wanted:
        parts = phrase.split()
        openers.setdefault(len(parts), set()).add(parts[0])
    any_opener = sorted(set().union(*openers.values()))
    negators = const_array(negation.words)

    def negated(i: Column) -> Column:
        before = F.slice(words, F.greatest(i - negation.window, F.lit(0)) + 1, F.least(F.lit(negation.window), i))
        return F.arrays_overlap(before, negators)

    def hits_at(i: Column) -> Column:
        word = F.get(words, i)
        grams = F.array_compact(
            F.array(
                *[
                    F.when(word.isin(sorted(firsts)), F.array_join(F.slice(words, i + 1, n), " "))
                    for n, firsts in sorted(openers.items())
                ]
            )
        )
        return F.filter(grams, lambda g: g.isin(wanted) & ~negated(i))

    starts = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(any_opener), i)))
    return F.array_distinct(F.flatten(F.transform(starts, hits_at)))


def matched(hits: Column, phrases: Sequence[str]) -> Column:
    """The members of a rule list among ``hits``: original spelling, list order."""
    pairs = [(norm_phrase(p), p) for p in phrases]
    pairs = [(n, p) for n, p in pairs if n]
    if not pairs:
        return F.array().cast("array<string>")
    spelled = const_array(p for _, p in pairs)
    norms = const_array(n for n, _ in pairs)
    fired = F.transform(norms, lambda n, i: F.when(F.array_contains(hits, n), F.get(spelled, i)))
    return F.array_compact(fired)


def any_match(hits: Column, phrases: Sequence[str]) -> Column:
    """True when at least one member of the list fired."""
    norms = sorted({n for n in map(norm_phrase, phrases) if n})
    if not norms:
        return F.lit(False)
    return F.arrays_overlap(hits, const_array(norms))


def quoted_list(phrases: Column) -> Column:
    """``['a', 'b']``, the audit form of a list of phrases."""
    quoted = F.transform(
        phrases,
        lambda p: F.when(F.contains(p, F.lit("'")), F.concat(F.lit('"'), p, F.lit('"'))).otherwise(
            F.concat(F.lit("'"), p, F.lit("'"))
        ),
    )
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def hits_per_list(df: DataFrame, hits: str, lists: dict[str, Sequence[str]], key: str) -> DataFrame:
    """Long form (key, list_name, phrases) for every list with a hit."""
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("list_name"), matched(F.col(hits), phrases).alias("phrases"))
            for name, phrases in lists.items()
        ]
    )
    return df.select(key, F.inline(F.filter(entries, lambda e: F.size(e["phrases"]) > 0)))
