"""Evaluate costly columns once, whatever is filtered on afterwards.

Catalyst moves a filter below the projection it refers to and repeats the
projected expression inside it.  For cheap columns that is a gain; for phrase
matching or HTML stripping it multiplies the main cost.  Columns produced by a
generator are not taken apart, and a one-element ``inline`` costs nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Like ``withColumns``, but the expressions stay where they are."""
    keep = [c for c in df.columns if c not in columns]
    packed = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*keep, F.inline(F.array(packed)))


def spread_once(df: DataFrame, result: Column, names: list[str]) -> DataFrame:
    """Replace the columns ``names`` by the members of the struct ``result``."""
    return df.select(*[c for c in df.columns if c not in names], F.inline(F.array(result)))
