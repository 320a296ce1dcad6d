"""Entries of keys by their rarest parts: where two similar keys are sure to meet.

A key is cut into one part more than it may lose characters to a partner no longer
than itself.  Count the unmatched characters of both up to a place and take off the
parts up to it: this begins at nothing or more, ends below nothing and falls by one
at a time, so it passes from 0 to -1 in some part.  That part i is unchanged in the
partner, exactly i unmatched characters stand before it and the others after it.  It
has thus moved by at most i places, by as many as i has parity, and the characters
before it differ in at most i, those after it in at most what is left.

Any cut serves.  Each key is cut so that its parts are expected at the fewest places
of other keys, by counts of a bounded sample: only the number of meetings depends on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys whose pieces are counted to tell rare parts from common ones.
SAMPLE = 20_000


def _tools(threshold: float) -> tuple[Callable, Callable, Callable]:
    """Counts of pieces, entries of keys as the longer and as the shorter of a pair.

    Nested functions travel to the workers by value: they need not have this package.
    """
    share, least = 1.0 - threshold, threshold / (2.0 - threshold)
    # Sizes of parts around the even cut; the first, which moves nowhere, may be longer.
    below, above, first_above, own_places = 1, 2, 8, 6
    cells, cut_up_to, most_cells = 21, 500, 1 << 21
    side_names = ["before_0", "before_1", "after_0", "after_1"]
    odd, golden = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(32))) * golden
        x = (x ^ (x >> np.uint64(32))) * golden
        return x ^ (x >> np.uint64(32))

    def plan(n: int) -> tuple[int, int, int, int]:
        """Parts of a key of n characters, sizes of a part from and to, largest size of the first."""
        count = int(2 * share * n + 1e-9) + 1
        even = n // count
        return count, max(1, even - below), min(n, even + above), min(n, even + first_above)

    def partners(m: int) -> tuple[list[int], list[int]]:
        """Sizes that a part, and a first part, of a partner no shorter than m characters may have."""
        plans = [plan(n) for n in range(m, int(m / least + 1e-9) + 1)]
        some = {q for _, low, high, _ in plans for q in range(low, high + 1) if q <= m}
        return sorted(some), sorted({q for _, low, _, first in plans for q in range(low, first + 1) if q <= m} - some)

    def moves(n: int) -> tuple[np.ndarray, np.ndarray]:
        """Parts and the places by which each may have moved in some partner no longer than n characters."""
        part = np.arange(plan(n)[0])
        low, high = np.full(len(part), n), np.full(len(part), -n)
        for m in range(int(np.ceil(n * least - 1e-9)), n + 1):
            matched = int(np.ceil((n + m) * threshold / 2 - 1e-9))
            rest = n + m - 2 * matched - part
            start = np.maximum(np.maximum(-part, matched - n), m - n - rest)
            stop = np.minimum(np.minimum(part, m - matched), m - n + rest)
            start, stop = start + ((start - part) & 1), stop - ((stop - part) & 1)
            some = (start <= stop) & (rest >= 0)
            low, high = np.where(some, np.minimum(low, start), low), np.where(some, np.maximum(high, stop), high)
        found = [(i, s) for i in part.tolist() for s in range(int(low[i]), int(high[i]) + 1, 2)]
        return np.array([i for i, _ in found], np.int64), np.array([s for _, s in found], np.int64)

    def hashes(codes: np.ndarray, longest: int) -> np.ndarray:
        """Hash of the piece of every size (less one) of every key from every place, as far as there is one."""
        keys, n = codes.shape
        out = np.zeros((longest, keys, n), np.uint64)
        last = np.zeros_like(codes)
        for q in range(1, longest + 1):
            last = last[:, : n - q + 1] * odd + codes[:, q - 1 :]
            out[q - 1, :, : n - q + 1] = last
        return out

    def cell(piece: np.ndarray, size, place) -> np.ndarray:
        # The first places have counts of their own: keys begin alike.
        where = np.minimum(place, own_places).astype(np.uint64) * np.uint64(64) + np.uint64(size)
        return (mix(piece + mix(np.atleast_1d(where + np.uint64(1)))) >> np.uint64(64 - cells)).astype(np.int64)

    def entry(piece: np.ndarray, size, place) -> np.ndarray:
        where = np.asarray(place).astype(np.uint64) * np.uint64(1 << 20) + np.asarray(size).astype(np.uint64)
        return mix(piece + mix(where + np.uint64(1))).view(np.int64)

    def of_one_length(keys: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of the keys of one length and their characters, in bounded groups."""
        lengths = np.array([len(k) for k in keys])
        for n in np.unique(lengths[lengths > 0]).tolist():
            rows = np.flatnonzero(lengths == n)
            step = max(1, min(1000, most_cells // (plan(n)[0] * (n + 1))))
            for low in range(0, len(rows), step):
                some = rows[low : low + step]
                text = "".join(keys[r] for r in some).encode("utf-32-le", "surrogatepass")
                yield some, np.frombuffer(text, np.uint32).reshape(len(some), n).astype(np.uint64) + np.uint64(1)

    def counts(keys: list[str]) -> np.ndarray:
        """Keys, by the cell of a piece, that are expected to have it at one place."""
        total = np.zeros(1 << cells)
        for _, codes in of_one_length(keys):
            n = codes.shape[1]
            _, low, high, first = plan(n)
            pieces = hashes(codes, first)
            for q in range(low, first + 1):
                places = np.arange(n - q + 1 if q <= high else 1)
                weight = np.where(places < own_places, 1.0, 1.0 / max(1, n - q + 1 - own_places))
                at = cell(pieces[q - 1, :, : len(places)], q, places)
                total += np.bincount(at.ravel(), np.broadcast_to(weight, at.shape).ravel(), 1 << cells)
        return total.astype(np.float32)

    def cut(pieces: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Where the parts of every key begin, and its end: the cut whose parts are expected to meet the fewest keys."""
        _, keys, n = pieces.shape
        count, low, high, first = plan(n)
        if n > cut_up_to:
            return np.broadcast_to(np.arange(count + 1) * n // count, (keys, count + 1))
        cost = {q: table[cell(pieces[q - 1, :, : n - q + 1], q, np.arange(n - q + 1))] + np.float32(0.05) for q in range(low, high + 1)}
        best = np.full((keys, n + 1), np.inf, np.float32)
        for q in range(low, first + 1):
            best[:, q] = table[cell(pieces[q - 1, :, 0], q, np.int64(0))] + np.float32(0.05)
        sizes = []
        for i in range(1, count):
            width = np.float32(max(0, min(i, count - 1 - i, int(n * share))) + 1)
            after, size = np.full((keys, n + 1), np.inf, np.float32), np.zeros((keys, n + 1), np.int16)
            for q in range(low, high + 1):
                total = best[:, : n + 1 - q] + cost[q] * width
                less = total < after[:, q:]
                np.copyto(after[:, q:], total, where=less)
                np.copyto(size[:, q:], np.int16(q), where=less)
            best = after
            sizes.append(size)
        starts, row = np.zeros((keys, count + 1), np.int64), np.arange(keys)
        starts[:, count] = n
        for i in range(count - 1, 0, -1):
            starts[:, i] = starts[:, i + 1] - sizes[i - 1][row, starts[:, i + 1]]
        return starts

    def profiles(codes: np.ndarray) -> list[np.ndarray]:
        """Counts of 32 classes of characters before every place, then from it: four bits each, two integers.

        The codes of counts go round in eight, one bit changing at a time, so that no more bits differ than counts do,
        and up to four exactly as many, however large the counts.
        """
        keys, n = codes.shape
        before, after = np.zeros((2, keys, n + 1), np.int64), np.zeros((2, keys, n + 1), np.int64)
        bits = np.array([0, 1, 3, 7, 15, 14, 12, 8], np.int64)
        seen = np.zeros((keys, n + 1), np.int64)
        for c in range(32):
            np.cumsum((codes & np.uint64(31)) == np.uint64(c), axis=1, out=seen[:, 1:])
            before[c % 2] |= bits[seen & 7] << (4 * (c // 2))
            after[c % 2] |= bits[(seen[:, -1:] - seen) & 7] << (4 * (c // 2))
        return [*before, *after]

    def longer(batch: pa.RecordBatch, table: np.ndarray, turn: int, turns: int) -> Iterator[pa.RecordBatch]:
        for rows, codes in of_one_length(batch.column("full_key").to_pylist()):
            keys, n = codes.shape
            pieces = hashes(codes, plan(n)[3])
            starts, sides, (part, shift) = cut(pieces, table), profiles(codes), moves(n)
            for low in range(0, keys, step := max(1, most_cells // 8 // len(part))):
                own = starts[low : low + step]
                begin, end = own[:, part], own[:, part + 1]
                which, at = np.nonzero((begin + shift >= 0) & (end + shift <= n))
                begin, end, which = begin[which, at], end[which, at], which + low
                key = entry(pieces[end - begin - 1, which, begin], end - begin, begin + shift[at])
                if turns > 1:
                    some = np.flatnonzero(key.view(np.uint64) % np.uint64(turns) == turn)
                    key, which, at, begin, end = (x[some] for x in (key, which, at, begin, end))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), *(batch.column(c).take(pa.array(rows[which])) for c in ("node", "src")), pa.array(np.full(len(key), n, np.int32)),
                     pa.array(part[at].astype(np.int32)), pa.array(shift[at].astype(np.int32)),
                     *(pa.array(side[which, at]) for side, at in zip(sides, (begin, begin, end, end)))],
                    ["key", "node", "src", "len", "part", "shift", *side_names])

    def shorter(batch: pa.RecordBatch, turn: int, turns: int) -> Iterator[pa.RecordBatch]:
        for rows, codes in of_one_length(batch.column("full_key").to_pylist()):
            keys, n = codes.shape
            (some, first), sides = partners(n), profiles(codes)
            pieces = hashes(codes, max(some + first))
            for q in some + first:
                places = np.arange(n - q + 1 if q in some else 1)
                key = entry(pieces[q - 1, :, : len(places)], np.int64(q), places)
                which, at = np.nonzero(key.view(np.uint64) % np.uint64(turns) == turn)
                at = places[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[which, at]), *(batch.column(c).take(pa.array(rows[which])) for c in ("node", "src")), pa.array(np.full(len(which), n, np.int32)),
                     *(pa.array(side[which, at]) for side, at in zip(sides, (at, at, at + q, at + q)))],
                    ["key", "node", "src", "len", *side_names])

    return counts, longer, shorter


def entry_turns(nodes: DataFrame, threshold: float, turns: int) -> Iterator[tuple[DataFrame, DataFrame]]:
    """``part_entries`` in ``turns`` parts, each with all entries of its share of the keys of entries."""
    spark = nodes.sparkSession
    counts, longer, shorter = _tools(threshold)
    sample = nodes.select("full_key").orderBy(F.xxhash64("full_key"), "full_key").limit(SAMPLE)
    table = spark.sparkContext.broadcast(counts([r[0] for r in sample.collect()]))
    # A key gives some hundred entries: few partitions of nodes would be few long tasks.
    dealt = nodes.select("node", "src", "full_key").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    columns, sides = "key bigint, node bigint, src string, len int", "before_0 bigint, before_1 bigint, after_0 bigint, after_1 bigint"

    def entries(turn: int) -> tuple[DataFrame, DataFrame]:
        def run_longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from longer(batch, table.value, turn, turns)

        def run_shorter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from shorter(batch, turn, turns)

        return dealt.mapInArrow(run_longer, f"{columns}, part int, shift int, {sides}"), dealt.mapInArrow(run_shorter, f"{columns}, {sides}")

    return (entries(turn) for turn in range(turns))


def part_entries(nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(key, node, src, len, part, shift, sides) of every node (node, src, full_key) as the longer
    and (key, node, src, len, sides) as the shorter of a pair: similar ones share a key.

    The sides, ``before_0`` to ``after_1``, are the counts of character classes on both sides of the part:
    no more bits of ``before`` or ``after`` differ than characters there are unmatched.
    """
    return next(entry_turns(nodes, threshold, 1))
