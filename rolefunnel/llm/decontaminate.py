"""Benchmark passages in a corpus, found with a positional inverted index.

The index is a table of segments.  A segment covers a run of documents with a
bounded amount of text and stores, for every term, the ascending positions at
which it stands; the positions of one segment run through its documents, with a
gap between two documents that no phrase can bridge.  Segments are independent:
they are built and searched where their rows lie, without a shuffle.

A search takes the test phrases in blocks of bounded size.  In each segment it
orders the terms of a phrase by the length of their lists there, takes the
offset-adjusted list of the rarest as candidates, and intersects it with the
offset-adjusted lists of the others, from rare to common; what is left are exact
occurrences.  ``near_matches`` keeps places where a stretch of some words holds all
terms instead, in any order.

Terms are 64-bit hashes of words.  Cases: a null or empty text has no words, no
postings and no phrases; an item with fewer words than a window is one window; of
repeated ids every row is counted by itself.  An item id that occurs twice stands
for the phrases of both rows.  Other columns of the inputs are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefunnel.llm.common import LOWER, WORD, PrefixHash, flat, map_batches, map_slices, row_of, spans, stored

WINDOW = 10
#: Bytes of text in a segment; one longer document is a segment of its own.
SEGMENT_BYTES = 1 << 20
#: Distinct test phrases in a block: it is sent to all tasks, about 100 bytes each.
BLOCK_PHRASES = 200_000

_INDEX = "ids binary, words binary, terms binary, ends binary, places binary"
_NAMES = ["ids", "words", "terms", "ends", "places"]
#: Cells of a stored row: those of a segment, then its number, which no other segment has.
_SEGMENT = len(_NAMES)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    data, off = flat(column)
    data = LOWER[data]
    starts, ends = spans(data, off, WORD)
    return PrefixHash(data).of(starts, ends), row_of(off, starts), len(off) - 1


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = WINDOW) -> DataFrame:
    """One row per segment: ids and word counts of its documents, sorted terms, the end of each term's list, the lists, its number.

    Numbers hold once the index is stored.
    """

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        terms, rows, n = _words(part.column("text"))
        count = np.bincount(rows, minlength=n)
        place = np.arange(len(terms)) + rows * gap
        order = np.argsort(terms, kind="stable")
        ordered = terms[order]
        last = np.flatnonzero(np.append(ordered[1:] != ordered[:-1], True)) if len(ordered) else np.zeros(0, np.int64)
        ids = part.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
        cells = [ids, count.astype(np.int64), ordered[last], (last + 1).astype(np.int32), place[order].astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], _NAMES)

    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    return map_slices(slim, work, _INDEX, most=SEGMENT_BYTES).withColumn("segment", F.monotonically_increasing_id())


class Segment:
    """One row of the index."""

    def __init__(self, cells: list[bytes], gap: int = WINDOW):
        kinds = (np.int64, np.int64, np.uint64, np.int32, np.int32)
        self.ids, self.words, self.terms, self.ends, self.places = (np.frombuffer(c, k) for c, k in zip(cells, kinds, strict=True))
        self.first = np.cumsum(self.words + gap) - self.words - gap  # position of each document's first word
        self.size = int(self.words.sum()) + gap * len(self.words)

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of the list of every term; length 0 where it does not occur."""
        if not len(self.terms):
            return np.zeros(terms.shape, np.int64), np.zeros(terms.shape, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        low = np.where(at > 0, self.ends[at - 1], 0).astype(np.int64)
        return low, np.where(self.terms[at] == terms, self.ends[at] - low, 0)

    def term_at(self) -> np.ndarray:
        """Which term stands at every position: all lists laid side by side, -1 in the gaps."""
        out = np.full(self.size + 1, -1, np.int32)
        out[self.places] = np.repeat(np.arange(len(self.terms), dtype=np.int32), np.diff(self.ends, prepend=0))
        return out

    def phrases(self, phrases: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of every exact occurrence of phrases (n x ``length`` terms)."""
        low, size = self.lists(phrases)
        alive = np.flatnonzero((size > 0).all(1))
        if not len(alive):
            return alive, alive
        rarest_first = np.argsort(size[alive], axis=1, kind="stable")
        number = np.searchsorted(self.terms, phrases[alive])
        lead = rarest_first[:, 0]
        many = size[alive, lead]
        which = np.repeat(np.arange(len(alive)), many)
        within = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        start = self.places[low[alive, lead][which] + within].astype(np.int64) - lead[which]
        held = (start >= 0) & (start + length <= self.size)
        which, start = which[held], start[held]
        stands = self.term_at()
        for k in range(1, length):  # intersect with the next rarest list
            offset = rarest_first[which, k]
            held = stands[start + offset] == number[which, offset]
            which, start = which[held], start[held]
        return alive[which], start

    def near(self, phrases: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of every term of a phrase from which on ``within`` words of one document hold all its terms, in any order."""
        low, size = self.lists(phrases)
        out = [[], []]
        for p in np.flatnonzero((size > 0).all(1)):
            distinct = np.unique(phrases[p], return_index=True)[1]
            lists = [self.places[low[p, k] : low[p, k] + size[p, k]].astype(np.int64) for k in distinct[np.argsort(size[p, distinct], kind="stable")]]
            at = np.unique(np.concatenate(lists))
            doc = self.document(at)
            last = np.minimum(at + within, self.first[doc] + self.words[doc]) - 1
            for places in lists:  # the rarest first: it leaves the fewest
                nearest = np.searchsorted(places, at)
                held = (nearest < len(places)) & (places[np.minimum(nearest, len(places) - 1)] <= last)
                at, last = at[held], last[held]
            out[0].append(np.full(len(at), p))
            out[1].append(at)
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, "right") - 1


def test_phrases(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(phrase: terms side by side, items: sorted ids): the distinct windows of all items."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        terms, rows, n = _words(part.column("text"))
        count = np.bincount(rows, minlength=n)
        names, out, of = part.column("id").to_pylist(), [], []
        at = 0
        for k in range(n):
            own, at = terms[at : at + count[k]], at + count[k]
            found = {own[i : i + window].tobytes() for i in range(max(1, len(own) - window + 1))} if len(own) else ()
            out += found
            of += [names[k]] * len(found)
        return pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(of, pa.string())], ["phrase", "item"])

    slim = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    return map_slices(slim, work, "phrase binary, item string").groupBy("phrase").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _blocks(phrases: DataFrame, most: int) -> Iterator[tuple[list[bytes], list[list[str]]]]:
    """The phrases, ``most`` at a time or so: blocks are cut by a hash, one in the driver at once."""
    total = phrases.count()
    n = -(-total // most) if total else 0
    for k in range(n):
        rows = phrases.where(F.pmod(F.xxhash64("phrase"), F.lit(n)) == k).toArrow()
        yield rows.column("phrase").to_pylist(), rows.column("items").to_pylist()


_HITS = "doc_id bigint, n_words bigint, row string, begins array<bigint>, ends array<bigint>, items array<string>"


def _search(index: DataFrame, sent) -> DataFrame:
    """Per document row: the hit words as runs, and the items with an occurrence; one block of phrases, broadcast."""

    def run(batches):
        phrases, items = sent.value
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(phrases):
            by_length.setdefault(len(p) // 8, []).append(i)
        tables = {n: (np.array(at), np.frombuffer(b"".join(phrases[i] for i in at), np.uint64).reshape(-1, n)) for n, at in by_length.items()}
        for batch in batches:
            for cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                segment = Segment(list(cells[:_SEGMENT]))
                which, start, size = [], [], []
                for n, (at, terms) in tables.items():
                    w, s = segment.phrases(terms, n)
                    which.append(at[w])
                    start.append(s)
                    size.append(np.full(len(s), n))
                yield _rows(segment, cells[_SEGMENT], items, *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (which, start, size)))

    return map_batches(index, run, _HITS)


def _rows(segment: Segment, number: int, items: list[list[str]], which: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    n = len(segment.ids)
    doc = segment.document(start)
    step = np.zeros(segment.size + 2, np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, start + size, -1)
    hit = np.cumsum(step) > 0
    change = np.diff(hit.astype(np.int8), prepend=0)
    begins, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    at = segment.document(begins)
    runs = np.bincount(at, minlength=n)
    cut = pa.array(np.concatenate([[0], np.cumsum(runs)]).astype(np.int32))
    found: list[list[str]] = [[] for _ in range(n)]
    pairs = np.unique(np.stack([doc, which]), axis=1)
    for d, w in pairs.T.tolist():
        found[d].extend(items[w])
    names = [sorted(set(f)) for f in found]
    # Rows are told apart by segment and place in it, so that blocks can be put together again.
    rows = [f"{number}-{k}" for k in range(n)]
    return pa.RecordBatch.from_arrays(
        [pa.array(segment.ids), pa.array(segment.words), pa.array(rows), *(pa.ListArray.from_arrays(cut, pa.array(x - segment.first[at])) for x in (begins, ends)), pa.array(names, pa.list_(pa.string()))],
        ["doc_id", "n_words", "row", "begins", "ends", "items"],
    )


def find_phrases(index: DataFrame, phrases: DataFrame, most: int = BLOCK_PHRASES) -> DataFrame:
    """Per document: n_words, hit runs (``begins``, ``ends`` in words) and sorted ``items``, over all blocks."""
    context, parts = index.sparkSession.sparkContext, []
    blocks = -(-phrases.count() // most)
    if blocks <= 1:
        return _search(index, context.broadcast(next(_blocks(phrases, most), ([], [])))).drop("row")
    for block in _blocks(phrases, most):  # one block is broadcast at a time, its hits written before the next
        sent = context.broadcast(block)
        parts.append(stored(_search(index, sent).where("size(items) > 0") if parts else _search(index, sent), "phrase-hits"))
        sent.destroy()
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    merged = out.groupBy("doc_id", "n_words", "row").agg(F.flatten(F.collect_list(F.arrays_zip("begins", "ends"))).alias("runs"), F.flatten(F.collect_list("items")).alias("items"))
    joined = F.aggregate(
        F.array_sort("runs"),
        F.array().cast("array<struct<begins:bigint,ends:bigint>>"),
        lambda done, r: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["ends"] >= r["begins"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["begins"].alias("begins"), F.greatest(F.element_at(done, -1)["ends"], r["ends"]).alias("ends")))),
        ).otherwise(F.concat(done, F.array(F.struct(r["begins"].alias("begins"), r["ends"].alias("ends"))))),
    )
    return merged.select("doc_id", "n_words", joined.alias("runs"), F.array_sort(F.array_distinct("items")).alias("items")).select("doc_id", "n_words", F.col("runs.begins").alias("begins"), F.col("runs.ends").alias("ends"), "items")


def near_matches(index: DataFrame, phrases: DataFrame, within: int, most: int = BLOCK_PHRASES) -> DataFrame:
    """(doc_id, item, places): where some ``within`` words of a document hold all terms of a phrase of the item, in any order.

    ``places`` are the word numbers at which such stretches begin with a term of the
    phrase, ascending.  A passage with words inserted, left out of place or swapped,
    which has no exact window, is found here.
    """
    context, parts = index.sparkSession.sparkContext, []
    for block in _blocks(phrases, most):
        sent = context.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            phrases, items = sent.value
            by_length: dict[int, list[int]] = {}
            for i, p in enumerate(phrases):
                by_length.setdefault(len(p) // 8, []).append(i)
            for batch in batches:
                for cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    segment = Segment(list(cells[:_SEGMENT]))
                    found: dict[tuple[int, str], set[int]] = {}
                    for n, numbers in by_length.items():
                        terms = np.frombuffer(b"".join(phrases[i] for i in numbers), np.uint64).reshape(-1, n)
                        which, at = segment.near(terms, within)
                        doc = segment.document(at)
                        for w, d, place in zip(which.tolist(), doc.tolist(), (at - segment.first[doc]).tolist()):
                            for item in items[numbers[w]]:
                                found.setdefault((d, item), set()).add(place)
                    if found:
                        ids = [int(segment.ids[d]) for d, _ in found]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids), pa.array([item for _, item in found]), pa.array([sorted(p) for p in found.values()], pa.list_(pa.int64())), pa.array([f"{cells[_SEGMENT]}-{d}" for d, _ in found])],
                            ["doc_id", "item", "places", "row"],
                        )

        parts.append(stored(map_batches(index, run, "doc_id bigint, item string, places array<bigint>, row string"), "phrase-near"))
        sent.destroy()
    if not parts:
        return index.sparkSession.createDataFrame([], "doc_id bigint, item string, places array<bigint>")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    merged = out.groupBy("doc_id", "item", "row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"))
    return merged.drop("row")


def n_hit() -> Column:
    """Words inside the runs of ``find_phrases``."""
    return F.aggregate(F.zip_with("ends", "begins", lambda e, b: e - b), F.lit(0).cast("bigint"), lambda a, x: a + x)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most: int = BLOCK_PHRASES) -> DataFrame:
    """Build and store the index of ``docs``, then search it for all windows of ``items``."""
    segments = build_index(docs, id_col, text_col)
    # Small row groups: a reader holds one of them at a time.
    index = stored(segments, "phrase-index", **{"parquet.block.size": 16 << 20})
    return find_phrases(index, test_phrases(items, item_col, item_text), most)
