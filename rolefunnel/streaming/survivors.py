"""Duplicate suppression on a stream that keeps the richest copy, not the first.

``suppress_repeats`` lets the first sight of a key pass and drops what follows.  Here
each key holds its richest copy so far in keyed state (longest description, of equal
ones the earliest), the first place it was seen at and the union of its tags.  An
event-time timer, ``horizon`` after the newest copy, sends the survivor on and clears
the state, so state is bounded by the keys of one horizon.  Copies are reduced within
a micro-batch before state is touched once per key.

The state store must be RocksDB (``use_rocksdb``), which keeps large state off the heap.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SURVIVOR_DDL = "key string, ord bigint, first_ord bigint, members bigint, tags array<string>, payload string"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(PROVIDER_CONF, ROCKSDB)


def _survivors(horizon: timedelta) -> StatefulProcessor:
    # A nested class travels to the workers by value: they need not have this package.
    class Survivors(StatefulProcessor):
        """State of a key: length, place and payload of its richest copy; first place, number and tags of all."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.best = handle.getValueState("best", "length bigint, ord bigint, first_ord bigint, members bigint, tags string, payload string, due bigint")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            held = self.best.get() if self.best.exists() else None
            best = (held[0], -held[1], held[5]) if held else None
            first, members = (held[2], held[3]) if held else (None, 0)
            tags, due = (set(json.loads(held[4])), held[6]) if held else (set(), 0)
            for frame in rows:
                for length, ord_, own, payload, at in zip(frame["length"], frame["ord"], frame["tags"], frame["payload"], frame["event_time"], strict=True):
                    mine = (int(length), -int(ord_), payload)
                    best = mine if best is None or mine[:2] > best[:2] else best
                    first = int(ord_) if first is None else min(first, int(ord_))
                    members += 1
                    tags.update(own if own is not None else ())
                    due = max(due, int(at.timestamp() * 1000) + int(horizon.total_seconds() * 1000))
            if held and held[6] != due:
                self.handle.deleteTimer(held[6])
            if not held or held[6] != due:
                self.handle.registerTimer(due)
            self.best.update((best[0], -best[1], first, members, json.dumps(sorted(tags)), best[2], due))
            yield from ()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            _, ord_, first, members, tags, payload, _ = self.best.get()
            self.best.clear()
            yield pd.DataFrame({"key": [key[0]], "ord": [ord_], "first_ord": [first], "members": [members], "tags": [json.loads(tags)], "payload": [payload]})

        def close(self) -> None:
            pass

    return Survivors()


def keep_richest(stream: DataFrame, key: str, event_time: str, horizon: timedelta, delay: str = "0 seconds") -> DataFrame:
    """One row per key and horizon, as ``dedupe.merge_survivors`` makes it: (key, ord, first_ord, members, tags, payload).

    ``stream`` has ``ord``, ``description``, ``tags`` and the columns of the posting,
    which come back in ``payload`` as JSON of the richest copy.  ``delay`` is how late
    rows may be.  Tags are the sorted union of all copies.
    """
    fields = [c for c in stream.columns if c not in (key, event_time)]
    rows = stream.select(
        F.col(key).cast("string").alias("key"),
        F.col(event_time).alias("event_time"),
        F.coalesce(F.length("description"), F.lit(0)).cast("bigint").alias("length"),
        F.col("ord").cast("bigint").alias("ord"),
        "tags",
        F.to_json(F.struct(*fields)).alias("payload"),
    )
    grouped = rows.withWatermark("event_time", delay).groupBy("key")
    return grouped.transformWithStateInPandas(statefulProcessor=_survivors(horizon), outputStructType=SURVIVOR_DDL, outputMode="Append", timeMode="EventTime")
