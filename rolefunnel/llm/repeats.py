"""Long passages that occur before, removed with run-length indexes.

A byte goes when some string of ``length`` bytes that covers it also starts
earlier: in a document with a smaller id, or earlier in the same one.  Strings do
not cross documents and are judged on the input.

1. Each window of ``length`` bytes picks its smallest hashed k-gram as seed, so
   equal windows have equal seeds at the same offset.  Consecutive windows with
   one seed are a context, which is known by two hashes: of the seed and of its
   bytes.  Within a batch a context that was there before is settled at once, so
   a passage that stands everywhere is one row per batch afterwards.
2. Contexts meet by seed.  All windows of a context that has an equal one before
   it are repeats.  A seed with one context is done; this is most text.
3. Where a seed has several contexts (the edges of copies, edited copies), their
   bytes are fetched and indexed in groups of whole seeds: the first context of
   each seed forms the text of a run-compressed Burrows-Wheeler transform with
   the suffix array sampled at run ends; the later contexts are streamed through
   it backwards for matching statistics, and windows with a match of ``length``
   bytes are repeats.  What is left of a context in turn becomes index text for
   the later ones, until no seed has two contexts left.
4. Seeds with more than ``most_contexts`` contexts (a common phrase in ever new
   surroundings) are settled window by window instead, by the least place of each
   window's hash: as exact, and spread over all tasks.

Hashes have 64 bits (windows of step 4 have 128).  Cases: null and empty texts,
and those shorter than ``length``, stay whole.  Rows with one id and one text get
the same result and are not repeats of each other; rows without an id are left
out.  Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolefunnel.llm.common import SECOND_BASE, PrefixHash, flat, map_batches, pair_hash, per_row, row_of, slices, stored

LENGTH = 100
SEED = 40
#: Bytes of context that are indexed together (whole seeds; more if one seed has more).
INDEX_BYTES = 1 << 21
#: A long document is searched for seeds in stretches of this many windows.
STRETCH = 1 << 20


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[: len(v) - (width - have)], v[width - have :]) if have < width else v


def contexts_of(data: np.ndarray, off: np.ndarray, length: int = LENGTH, seed: int = SEED) -> list[np.ndarray]:
    """Rows, first window, last window, seed place (in bytes of ``data``), seed hash, context hash of all contexts."""
    none = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    if len(data) < length:
        return none
    hashes = PrefixHash(data)
    at = np.arange(len(data) - seed + 1)
    grams = hashes.of(at, at + seed)
    ranked = (grams & ~np.uint64((1 << 26) - 1)) | at.astype(np.uint64) & np.uint64((1 << 26) - 1)
    place = (_sliding_min(ranked, length - seed + 1) & np.uint64((1 << 26) - 1)).astype(np.int64)
    window = np.arange(len(data) - length + 1)
    place = place[: len(window)]
    ends = np.repeat(off[1:], np.diff(off))[: len(window)]
    window = window[window + length <= ends]
    if not len(window):
        return none
    place = place[window]
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(window) != 1) | (row_of(off, window[1:]) != row_of(off, window[:-1]))]))
    low, high, place = window[cut], window[np.append(cut[1:], len(window)) - 1], place[cut]
    return [row_of(off, low), low, high, place, grams[place], pair_hash(hashes.of(low, high + length), (place - low).astype(np.uint64))]


def _stretches(part: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets, first byte's place in its document): slices, long documents in overlapping stretches."""
    ids = part.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
    data, off = flat(part.column("text"))
    if part.num_rows > 1 or len(data) <= 2 * STRETCH:
        yield ids, data, off, 0
        return
    for low in range(0, len(data) - length + 1, STRETCH):
        piece = data[low : low + STRETCH + length - 1]
        yield ids, piece, np.array([0, len(piece)]), low


def _seeds(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """A row per context that its batch has not had before; settled ones have ``done`` and a key of their own.

    ``place`` is the first window, shifted by 16 bits, with the number of further windows in 8 and the seed's offset in 8.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for part in slices(batch, "text"):
                for ids, data, off, shift in _stretches(part, length):
                    row, low, high, place, h, c = contexts_of(data, off, length, seed)
                    if len(row):
                        found.append((h, c, ids[row], (low - off[row] + shift) << 16 | (high - low) << 8 | (place - low)))
            if not found:
                continue
            h, c, doc, place = (np.concatenate(x) for x in zip(*found, strict=True))
            key = pair_hash(h, c)
            order = np.lexsort((place, doc, key))
            h, c, doc, place, key = h[order], c[order], doc[order], place[order], key[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            twin = ~new & np.concatenate([[False], (doc[1:] == doc[:-1]) & (place[1:] == place[:-1])])
            h, c, doc, place, done = (x[~twin] for x in (h, c, doc, place, ~new))
            h = np.where(done, pair_hash(doc.astype(np.uint64), place.astype(np.uint64)), h)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(doc), pa.array(place), pa.array(done)], ["h", "c", "doc", "place", "done"])

    return map_batches(docs, run, "h bigint, c bigint, doc bigint, place bigint, done boolean")


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of a text (codes 1..256, 0 ends each part), with the suffix array at run ends."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        self.text = np.concatenate([text, np.zeros(256, text.dtype)]).astype(np.int64)
        # Ranks of substrings of 1, 2, 4, ... 64 codes: the order of suffixes, and common prefixes of any two.
        rank = self.text[: n + 128].copy()
        self.ranks = [rank.astype(np.int32)]
        width = 1
        while width < 64:
            joined = rank[: n + 128 - width] * (int(rank.max()) + 1) + rank[width : n + 128]
            values, rank_ = np.unique(joined, return_inverse=True)
            rank = np.concatenate([rank_, np.zeros(width, np.int64)])
            width *= 2
            self.ranks.append(rank.astype(np.int32))
        rank64 = rank[: n + 64]
        order = np.argsort(rank64[:n] * (int(rank64.max()) + 1) + rank64[64 : n + 64], kind="stable")
        before = np.where(order > 0, self.text[order - 1], 0)
        first = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        last = np.append(first[1:], n) - 1
        self.first, self.code = first, before[first]
        self.at_first, self.at_last = order[first], order[last]
        by_code = np.argsort(self.code, kind="stable")
        sizes = last - first + 1
        self.target = np.empty(len(first), np.int64)  # where a run's first row goes in the LF mapping
        self.target[by_code] = np.cumsum(sizes[by_code]) - sizes[by_code]
        self.keys = self.code[by_code] * len(first) + by_code
        self.by_code = by_code

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes at two places, up to 127 codes."""
        done = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            done += (self.ranks[k][a + done] == self.ranks[k][b + done]).astype(np.int64) << k
        return done

    def matching_statistics(self, patterns: np.ndarray) -> np.ndarray:
        """Length of the longest match at every place of every pattern (rows padded at the left; codes as in the text)."""
        m, width = patterns.shape
        out = np.zeros((m, width), np.int16)
        row = np.zeros(m, np.int64)
        at = np.full(m, self.at_first[0])
        size = np.zeros(m, np.int64)
        runs = len(self.first)
        for t in range(width - 1, -1, -1):
            code = patterns[:, t].astype(np.int64)
            run = np.searchsorted(self.first, row, "right") - 1
            off = np.flatnonzero(self.code[run] != code)
            if len(off):
                # Jump to the nearest run of the code that shares more with the match so far.
                place = np.searchsorted(self.keys, code[off] * runs + run[off])
                up, down = self.by_code[np.maximum(place - 1, 0)], self.by_code[np.minimum(place, runs - 1)]
                has_up, has_down = (place > 0) & (self.code[up] == code[off]), (place < runs) & (self.code[down] == code[off])
                share_up = np.where(has_up, np.minimum(size[off], self.common(at[off], self.at_last[up])), -1)
                share_down = np.where(has_down, np.minimum(size[off], self.common(at[off], self.at_first[down])), -1)
                take_up = share_up >= share_down
                to = np.where(take_up, up, down)
                none = ~has_up & ~has_down
                ends = np.append(self.first[1:], self.last_row + 1) - 1
                size[off] = np.maximum(np.where(take_up, share_up, share_down), 0)
                row[off] = np.where(take_up, ends[to], self.first[to])
                at[off] = np.where(take_up, self.at_last[to], self.at_first[to])
                run[off] = to
                lost = off[none]
            else:
                lost = off
            row = self.target[run] + row - self.first[run]
            at = at - 1
            size = size + 1
            if len(lost):  # the text does not have this code
                row[lost], at[lost], size[lost] = 0, self.at_first[0], 0
            out[:, t] = size
        return out

    @property
    def last_row(self) -> int:
        return len(self.text) - 257


def mark_contexts(group: np.ndarray, bodies: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Per context which of its windows an earlier context of its group has; groups are sorted, contexts in order of place."""
    sizes = np.array([len(b) for b in bodies])
    marks = [np.zeros(s - length + 1, bool) for s in sizes]
    alive = np.arange(len(bodies))
    while len(alive):
        first = np.concatenate([[True], group[alive][1:] != group[alive][:-1]])
        follow = alive[~first]
        if not len(follow):
            break
        # Only a context with others behind it is worth indexing.
        lead = alive[first & np.append(~first[1:], False)]
        index = RunIndex(np.concatenate([np.append(np.frombuffer(bodies[i], np.uint8).astype(np.int64) + 1, 0) for i in lead]))
        width = int(sizes[follow].max())
        patterns = np.zeros((len(follow), width), np.int16)
        for r, i in enumerate(follow):
            patterns[r, width - sizes[i] :] = np.frombuffer(bodies[i], np.uint8).astype(np.int16) + 1
        found = index.matching_statistics(patterns) >= length
        left = []
        for r, i in enumerate(follow):
            marks[i] |= found[r, width - sizes[i] : width - length + 1]
            if not marks[i].all():
                left.append(i)
        # A context whose windows are all repeats adds nothing to the index of its seed.
        alive = np.array(left, np.int64)
    return marks


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.diff(marks.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1


def _settled(contexts: DataFrame, length: int, index_bytes: int) -> DataFrame:
    """(doc, low, high) of repeated windows; ``contexts`` (h, doc, low, body) is sorted by h, doc, low in its partitions."""

    def settle(h: list, doc: list, low: list, body: list) -> pa.RecordBatch:
        docs, lows, highs = [], [], []
        for d, at, marks in zip(doc, low, mark_contexts(np.array(h, np.int64), body, length), strict=True):
            a, b = _runs(marks)
            docs += [d] * len(a)
            lows += (at + a).tolist()
            highs += (at + b).tolist()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, lows, highs)], ["doc", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= index_bytes and row[0] != held[0][-1]:
                    yield settle(*held)
                    held, size = [[], [], [], []], 0
                for cells, x in zip(held, row, strict=True):
                    cells.append(x)
                size += len(row[3])
        if size:
            yield settle(*held)

    return map_batches(contexts, run, "doc bigint, low bigint, high bigint")


def _by_window(contexts: DataFrame, length: int) -> DataFrame:
    """(doc, low, high) of repeated windows, each window by itself; one row per window and batch is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, doc, low, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = np.frombuffer(body, np.uint8)
                at = np.arange(len(data) - length + 1)
                found.append((PrefixHash(data).of(at, at + length), PrefixHash(data, SECOND_BASE).of(at, at + length), np.full(len(at), doc), low + at))
            if not found:
                continue
            one, two, doc, low = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((low, doc, two, one))
            one, two, doc, low = one[order], two[order], doc[order], low[order]
            done = np.concatenate([[False], (one[1:] == one[:-1]) & (two[1:] == two[:-1])])
            # A window that its batch has had is settled; it gets a key of its own.
            two = np.where(done, pair_hash(doc.astype(np.uint64), low.astype(np.uint64)), two)
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(doc), pa.array(low), pa.array(done)], ["one", "two", "doc", "low", "done"])

    windows = map_batches(contexts, run, "one bigint, two bigint, doc bigint, low bigint, done boolean")
    least = F.min(F.struct("doc", "low")).over(Window.partitionBy("one", "two"))
    return windows.withColumn("least", least).where(F.col("done") | (F.struct("doc", "low") > F.col("least"))).select("doc", "low", F.col("low").alias("high"))


def repeated_windows(docs: DataFrame, length: int = LENGTH, seed: int = SEED, most_contexts: int = 16, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(doc, low, high): runs of windows, by their first bytes, that also start earlier; ``docs`` has id and text."""
    by_context = Window.partitionBy("h", "c").orderBy("doc", "place")
    by_seed = Window.partitionBy("h")
    met = _seeds(docs, length, seed).repartition("h").withColumn("k", F.row_number().over(by_context)).withColumn("first", F.first(F.struct("doc", "place")).over(by_context))
    met = met.withColumn("kinds", F.sum((F.col("k") == 1).cast("int")).over(by_seed))
    again = F.col("done") | (F.struct("doc", "place") > F.col("first"))
    known = stored(met.select("h", "doc", "place", again.alias("again"), "kinds").where("again or kinds > 1"), "repeat-contexts")
    low, more = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(F.lit(255).cast("bigint"))
    settled = known.where("again").select("doc", low.alias("low"), (low + more).alias("high"))
    wanted = known.where("not again").groupBy("doc").agg(F.collect_list(F.struct("h", low.alias("low"), more.alias("more"), "kinds")).alias("wanted"))
    texts = docs.join(wanted, docs["id"] == wanted["doc"]).select("id", "text", "wanted")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, off = flat(part.column("text"))
                lists = part.column("wanted")
                at, cells = lists.offsets.to_numpy(), lists.values
                begin, end = int(at[0]), int(at[-1])
                h, low, more, kinds = (cells.field(k).to_numpy(zero_copy_only=False)[begin:end] for k in range(4))
                row = np.repeat(np.arange(part.num_rows), np.diff(at))
                start = off[row] + low
                stop = start + more + length
                raw = data.tobytes()
                body = [raw[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
                ids = part.column("id").to_numpy(zero_copy_only=False)[row]
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids), pa.array(low), pa.array(body, pa.binary()), pa.array(kinds)], ["h", "doc", "low", "body", "kinds"])

    contexts = stored(map_batches(texts, fetch, "h bigint, doc bigint, low bigint, body binary, kinds bigint"), "repeat-bodies")
    few = contexts.where(F.col("kinds") <= most_contexts).drop("kinds").repartition("h").sortWithinPartitions("h", "doc", "low")
    many = contexts.where(F.col("kinds") > most_contexts).drop("kinds")
    return stored(settled.unionByName(_settled(few, length, index_bytes)).unionByName(_by_window(many, length)), "repeat-windows")


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    seed: int = SEED,
    most_contexts: int = 16,
    index_bytes: int = INDEX_BYTES,
    whole_characters: bool = False,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(id, carried, n_bytes, n_removed, n_spans, kept): what stays of every document with an id.

    ``kept`` is binary.  With ``whole_characters`` a character goes only if all its
    bytes do, so that ``kept`` is valid UTF-8; the counts are of what goes then.
    ``carried`` is a struct of the columns ``carry``.
    """
    slim = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(*(docs[c] for c in carry), F.lit(True).alias("here")).alias("carried")
    ).where("id is not null")
    windows = repeated_windows(slim.select("id", "text"), length, seed, most_contexts, index_bytes)
    runs = windows.groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, off = flat(part.column("text"))
                lists = part.column("runs")
                many = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                cells = pc.list_flatten(lists)
                row = np.repeat(np.arange(part.num_rows), many)
                step = np.zeros(len(data) + 1, np.int32)
                if len(row):
                    np.add.at(step, off[row] + cells.field("low").to_numpy(zero_copy_only=False), 1)
                    np.add.at(step, off[row] + cells.field("high").to_numpy(zero_copy_only=False) + length, -1)
                gone = np.cumsum(step[:-1]) > 0
                if whole_characters and len(data):
                    begins = np.flatnonzero((data & 0xC0) != 0x80)
                    gone = np.repeat(np.logical_and.reduceat(gone, begins), np.diff(np.append(begins, len(data))))
                at = np.flatnonzero(gone & np.concatenate([[True], ~gone[:-1]]) if len(gone) else gone)
                heads = np.unique(off[:-1][np.diff(off) > 0])
                heads = heads[(heads > 0)]
                at = np.union1d(at, heads[gone[heads] & gone[heads - 1]])
                removed, spans = per_row(gone, off), np.bincount(row_of(off, at), minlength=part.num_rows)
                left = data[~gone].tobytes()
                to = off - np.concatenate([[0], np.cumsum(removed)])
                kept = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(to.astype(np.int32).tobytes()), pa.py_buffer(left)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("carried"), pa.array(np.diff(off)), pa.array(removed), pa.array(spans.astype(np.int64)), kept],
                    ["id", "carried", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    joined = slim.join(runs, slim["id"] == runs["doc"], "left").select("id", "text", "carried", "runs")
    return map_batches(joined, cut, f"id bigint, carried {slim.schema['carried'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
