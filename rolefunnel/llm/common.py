"""What several operators share: word spans and hashes over Arrow text, tables, folds.

Texts reach Python as Arrow batches and are cut into slices of bounded bytes;
inside a slice all work is numpy over the UTF-8 bytes.  A text is never cut.
"""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefunnel.session import scratch_path

SLICE_BYTES = 1 << 19
#: Bits of a filter: 16 MiB on every executor, whatever the corpus.
FILTER_BITS = 27

_A_Z = slice(ord("A"), ord("Z") + 1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[_A_Z] += 32
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after lower-casing A-Z.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True
#: Bytes of `[^\x20\x09-\x0D]`.
VISIBLE = np.ones(256, bool)
VISIBLE[0x20] = VISIBLE[0x09:0x0E] = False

_BASE = 0x9E3779B97F4A7C15 | 1
#: For a second hash that is independent of the first.
SECOND_BASE = 0xD1342543DE82EF95
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for later slices of this worker."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 2 * SLICE_BYTES), base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if len(have) <= 8 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + (right ^ np.uint64(0xD6E8FEB86659FD93)))


class PrefixHash:
    """Hashes of arbitrary byte ranges of one buffer, as polynomials in an odd ``base``."""

    def __init__(self, data: np.ndarray, base: int = _BASE):
        terms = (data.astype(np.uint64) + np.uint64(1)) * _power(base, len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(terms, out=self.sums[1:])
        self.inverse = _power(pow(base, -1, 1 << 64), len(data) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; a null is empty."""
    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``most`` bytes of text, or a single longer row."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes of ``kind``; no run crosses a row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = kind[data]
    step = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cut = np.unique(offsets[1:-1])
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = cut[inside[cut - 1] & inside[cut]]
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends


def row_of(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The row that holds each byte position."""
    return np.searchsorted(offsets, at, "right") - 1


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``bounds``; empty rows give 0."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = Path(__file__).resolve().parent.parent
    name = f"{tempfile.mkdtemp(prefix='code-')}/{package.name}.zip"
    with zipfile.ZipFile(name, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(name)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def map_slices(
    df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text", most: int = SLICE_BYTES
) -> DataFrame:
    """Apply ``work`` to bounded slices of every Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, most):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out

    return map_batches(df, run, schema)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str, **options: object) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables and broadcast values that are only needed until a result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.out = spark, [], []

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(self.spark, label)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def sent(self, value: object) -> Broadcast:
        """``value`` for the workers, until it is recalled."""
        self.out.append(self.spark.sparkContext.broadcast(value))
        return self.out[-1]

    def recall(self) -> None:
        """Free what was sent, which the driver holds as well; whatever needs it must have been written."""
        while self.out:
            self.out.pop().destroy()

    def release(self) -> None:
        """Remove the tables; whatever is read from them must have been written."""
        self.recall()
        jvm = self.spark._jvm
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.paths.clear()


@dataclass(frozen=True)
class Filter:
    """A set of 64-bit integers, two bits for each, in an array of fixed size: no member is ever missing."""

    words: np.ndarray

    @staticmethod
    def of(values: DataFrame, bits: int = FILTER_BITS) -> Filter:
        """``values`` has one column of well mixed bigints; bits are united in Spark, so at most 2 ** bits / 64 words arrive, a partition at a time."""
        v = F.col(values.columns[0])
        places = values.select(F.explode(F.array(F.shiftrightunsigned(v, 64 - bits), v.bitwiseAND(F.lit((1 << bits) - 1)))).alias("p"))
        bit = F.expr("shiftleft(1L, cast(p & 63 AS INT))")
        rows = places.groupBy(F.shiftright("p", 6).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy().tobytes()], pa.binary()) for c in batch.columns], ["word", "bits"])

        words = np.zeros(1 << (bits - 6), np.uint64)
        for word, some in map_batches(rows, run, "word binary, bits binary").toLocalIterator():
            words[np.frombuffer(word, np.int32)] = np.frombuffer(some, np.uint64)
        return Filter(words)

    def has(self, values: np.ndarray) -> np.ndarray:
        bits = np.uint64(len(self.words).bit_length() - 1 + 6)
        out = np.ones(len(values), bool)
        for place in (values >> (np.uint64(64) - bits), values & np.uint64((1 << int(bits)) - 1)):
            out &= (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return out


def fold_of(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n))


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows at most, chosen by a hash of ``key``: the same rows on every run."""
    n = rows.count()
    if n <= most:
        return rows
    parts = 1 << 30
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(parts)) < F.lit(int(parts * most / n)))
