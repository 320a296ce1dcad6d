"""Documents as rows of token ids: byte-level BPE, best-fit-decreasing packing, binary output.

Every document is tokenised whole and closed by an end mark.  One longer than a
row is split into full rows and a rest, without loss.  Pieces are then packed in
blocks of about ``block_tokens`` tokens, longest first, each into the open row
with the least room that still holds it; a segment tree over the capacities finds
that row in log(row length) steps.  A row of the result is a row of the id matrix:
ids padded to the full length, the positions (restarting at 0 with each piece),
the cumulative piece lengths, and which document each piece comes from and where
it starts there.  Ids and positions are little-endian binary, 2 or 4 bytes each;
``id_matrix`` reads them back.

Packing needs no shuffle: a block is a run of documents as they are scanned, and
what the end of a block leaves open is well below one row in a thousand.

Cases: a null or empty text is its end mark only; repeated rows are packed once
each; a row without an id is packed with a null id.  Other columns are not read.
The vocabulary file is read, never trained; its path is a parameter.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefunnel.llm.common import map_batches, slices

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this public vocabulary cuts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that are tokenised at a time.
STRETCH = 1 << 20

# Between a mark and " x" the pattern above always cuts, so a long text may be cut there first.
_CUT = re.compile(r"(?<=\S)(?= \S)")


class Tokenizer:
    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.size = max(ranks.values()) + 1
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        out, low = [], 0
        while low < len(text):
            cut = _CUT.search(text, low + STRETCH) if len(text) - low > STRETCH else None
            high = cut.start() if cut else len(text)
            out.append(np.array(self.encoding.encode_ordinary(text[low:high]), np.uint32))
            low = high
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


@lru_cache(2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


class Capacities:
    """A segment tree over 0..most: the smallest capacity of at least some size that a row has."""

    def __init__(self, most: int):
        self.base = 1 << most.bit_length()
        self.some = [0] * (2 * self.base)

    def change(self, capacity: int, by: int) -> None:
        at = capacity + self.base
        while at:
            self.some[at] += by
            at >>= 1

    def at_least(self, size: int) -> int | None:
        at = size + self.base
        if not self.some[at]:
            while at > 1 and (at & 1 or not self.some[at + 1]):  # up, until a subtree to the right has a row
                at >>= 1
            if at == 1:
                return None
            at += 1
            while at < self.base:
                at = 2 * at if self.some[2 * at] else 2 * at + 1
        return at - self.base


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Rows as lists of item numbers; ties go to the lower number and the row opened last."""
    tree, open_rows, rows = Capacities(capacity), [[] for _ in range(capacity + 1)], []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[item]
        room = tree.at_least(size)
        if room is None:
            room = capacity
            rows.append([item])
            row = len(rows) - 1
        else:
            row = open_rows[room].pop()
            tree.change(room, -1)
            rows[row].append(item)
        if room > size:
            open_rows[room - size].append(row)
            tree.change(room - size, 1)
    return rows


def _packed(docs: list, starts: list[int], pieces: list[np.ndarray], length: int, pad: int, kind: type) -> pa.RecordBatch:
    sizes = [len(p) for p in pieces]
    rows = best_fit_decreasing(sizes, length)
    order = [i for row in rows for i in row]
    matrix, positions = np.full((len(rows), length), pad, kind), np.zeros((len(rows), length), np.uint16 if length <= 1 << 16 else np.uint32)
    ends: list[int] = []
    for r, row in enumerate(rows):
        at = 0
        ends.append(0)
        for i in row:
            matrix[r, at : at + sizes[i]] = pieces[i]
            positions[r, at : at + sizes[i]] = np.arange(sizes[i])
            at += sizes[i]
            ends.append(at)
    many = np.array([len(row) for row in rows])
    cut = np.concatenate([[0], np.cumsum(many)])
    lists = lambda values, kind, bounds: pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))
    last = np.array(ends)[np.cumsum(many + 1) - 1]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(last.astype(np.int32)), pa.array([m.tobytes() for m in matrix], pa.binary()), pa.array([p.tobytes() for p in positions], pa.binary()),
            lists(ends, pa.int32(), cut + np.arange(len(cut))), lists([docs[i] for i in order], pa.int64(), cut), lists([starts[i] for i in order], pa.int64(), cut),
        ],
        ["n_tokens", "ids", "positions", "cu_seqlens", "doc_ids", "starts"],
    )


PACKED = "n_tokens int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<bigint>, starts array<bigint>"


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, ranks: str = DEFAULT_RANKS, end_id: int | None = None, block_tokens: int = 1 << 21
) -> DataFrame:
    """Rows of ``length`` ids; padding is the end mark, by default the first id that the vocabulary leaves free."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(ranks)
        end = tok.size if end_id is None else end_id
        kind = np.uint16 if max(tok.size, end) < 1 << 16 else np.uint32
        owners, starts, pieces, held = [], [], [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                for doc, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.append(tok.encode(text or ""), np.uint32(end)).astype(kind)
                    for start in range(0, len(ids), length):
                        owners.append(doc)
                        starts.append(start)
                        pieces.append(ids[start : start + length])
                    held += len(ids)
                    if held >= block_tokens:
                        yield _packed(owners, starts, pieces, length, end, kind)
                        owners, starts, pieces, held = [], [], [], 0
        if pieces:
            yield _packed(owners, starts, pieces, length, end, kind)

    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return map_batches(slim, run, PACKED)


def id_matrix(rows: list[bytes], length: int, width: int = 2) -> np.ndarray:
    """The matrix of some rows of ``ids`` or ``positions``."""
    return np.frombuffer(b"".join(rows), f"<u{width}").reshape(-1, length)


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Write the packed rows as Parquet through Spark's own committer, for any store it can reach."""
    pack(docs, **options).write.parquet(path)
