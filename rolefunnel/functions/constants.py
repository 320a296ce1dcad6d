"""Constant arrays and maps built from one literal each.

The optimizer folds them before execution; built member by member they would
cost one round trip to the JVM per member whenever a plan is put together.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_ENTRY, _PAIR = "\x01", "\x02"


def const_array(values: Iterable[str]) -> Column:
    values = list(values)
    if not values:
        return F.array().cast("array<string>")
    return F.split(F.lit(_ENTRY.join(values)), _ENTRY, -1)


def const_map(entries: dict[str, str]) -> Column:
    text = _ENTRY.join(f"{k}{_PAIR}{v}" for k, v in entries.items())
    return F.str_to_map(F.lit(text), F.lit(_ENTRY), F.lit(_PAIR))
