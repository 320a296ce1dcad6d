"""Sentence pieces: encoding by a streaming Viterbi search, and decoding.

The vocabulary file gives pieces and scores; an encoding is the sequence of
pieces with the largest sum of scores (of equal ones, the one whose last differing
boundary comes from the longer piece).  The search reads a text once.  A piece
ends at most ``longest`` characters after the position read, so only the scores
of that window are alive; whenever the paths that are alive run through one
boundary, everything before it is settled and its ids are committed.  A text of
any length takes memory for what is not settled, never for a whole lattice.

Where no piece of the vocabulary goes on over the start of a word, each word's
start is such a boundary, and so is each place between two characters that stand
side by side in no piece.  The search then restarts there, and a worker keeps the
ids of words and parts it has met: the ids are the same as those of one search.

A character that no piece holds becomes its UTF-8 bytes.  A literal U+2581, which
stands for a space inside pieces, is spelled in bytes too, so that decoding
returns every text exactly.  Cases: null and empty texts have no ids and decode
to an empty text; repeated rows are encoded alike.  The vocabulary is only read,
never trained; its path is a parameter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefunnel.llm.common import map_batches, map_slices

SPACE = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: What a character without a piece costs beyond the worst piece.
UNKNOWN_PENALTY = 10.0
#: Words whose ids a worker keeps.
KEPT_WORDS = 400_000
#: Characters that are taken at a time from a long text.
STRETCH = 1 << 20

#: Bits of a character inside an edge, and texts that are searched side by side.
_CHAR_BITS, _ABREAST = 21, 1 << 13

_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


class Vocabulary:
    """Pieces and scores, and the search over them."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], size: int):
        self.pieces = {p: v for p, v in pieces.items() if p}
        self.byte_ids = byte_ids
        self.longest = max(map(len, self.pieces), default=1)
        # character -> [characters behind it, id, score of the piece that ends here, if one does]
        self.trie: dict[str, list] = {}
        for p, (i, score) in self.pieces.items():
            node = self.trie
            for c in p:
                entry = node.setdefault(c, [{}, -1, None])
                node = entry[0]
            entry[1:] = [i, score]
        self._spread()
        self.unknown = min((s for _, s in self.pieces.values()), default=0.0) - UNKNOWN_PENALTY
        self.words_split = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.pieces)
        #: Neighbouring characters inside some piece; between two others every path has a boundary.
        self.joined = np.unique([ord(p[k]) << _CHAR_BITS | ord(p[k + 1]) for p in self.pieces for k in range(len(p) - 1)]).astype(np.int64)
        self.kept: dict[str, bytes] = {}  # ids side by side, 32 bits each
        self.mark = _packed([byte_ids[b] for b in SPACE.encode()])  # of a literal U+2581
        table = [b""] * size
        for p, (i, _) in self.pieces.items():
            table[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(byte_ids):
            table[i] = bytes([b])
        self.table = np.frombuffer(b"".join(table), np.uint8)
        self.ends = np.cumsum([len(t) for t in table])

    def _spread(self) -> None:
        """The trie as arrays: an edge is a node and a character; the root is 0, a piece is worth its score at its last node."""
        nodes, edges = {"": 0}, []
        for p in self.pieces:
            for k, c in enumerate(p, 1):
                if p[:k] not in nodes:
                    nodes[p[:k]] = len(nodes)
                    edges.append((nodes[p[: k - 1]] << _CHAR_BITS | ord(c), nodes[p[:k]]))
        edges.sort()
        self.edges, self.behind = np.array(edges, np.int64).reshape(-1, 2).T.copy()
        self.worth, self.ident = np.full(len(nodes), -np.inf), np.full(len(nodes), -1, np.int32)
        for p, (i, score) in self.pieces.items():
            self.worth[nodes[p]], self.ident[nodes[p]] = score, i

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): (i, model.get_score(i)) for i in plain}
        return cls(pieces, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], size)

    def stream(self, text: str) -> Iterator[list[int]]:
        """Runs of ids as they are settled; ``text`` has its spaces replaced already."""
        longest = self.longest
        n, settled = len(text), 0
        best: dict[int, float] = {0: 0.0}
        back: dict[int, tuple[int, int]] = {}  # boundary -> (boundary before, id or -1 for bytes)
        reach = 0  # furthest boundary that a live path has
        for i in range(n):
            here = best.pop(i)
            if reach == i and i > settled:  # one boundary left: all paths run through it
                yield self._between(text, back, settled, i)
                back.clear()
                settled = i
            elif len(back) > 8 * longest and (common := self._meeting(back, best, i, settled)) > settled:
                yield self._between(text, back, settled, common)
                back = {k: v for k, v in back.items() if k > common}
                settled = common
            node, single = self.trie, text[i] in self.pieces
            for end in range(i + 1, n + 1):
                entry = node.get(text[end - 1])
                if entry is None:
                    break
                node, piece, worth = entry
                if worth is not None:
                    score = here + worth
                    if end not in best or score > best[end]:
                        best[end], back[end] = score, (i, piece)
                        reach = max(reach, end)
            if not single:
                score = here + self.unknown
                if i + 1 not in best or score > best[i + 1]:
                    best[i + 1], back[i + 1] = score, (i, -1)
                    reach = max(reach, i + 1)
        if n > settled:
            yield self._between(text, back, settled, n)

    def _meeting(self, back: dict, best: dict, here: int, settled: int) -> int:
        """The last boundary that the paths to ``here`` and to all live boundaries share."""
        shared = None
        for at in (here, *best):
            path = set()
            while at > settled:
                if at <= here:
                    path.add(at)
                at = back[at][0]
            shared = path if shared is None else shared & path
        return max(shared, default=settled)

    def _between(self, text: str, back: dict, low: int, high: int) -> list[int]:
        out: list[int] = []
        while high > low:
            before, piece = back[high]
            out += [piece] if piece >= 0 else [self.byte_ids[b] for b in reversed(text[before:high].encode())]
            high = before
        return out[::-1]

    def _short(self, text: str) -> list[int]:
        """The same search over a text that fits a window or two: nothing needs to be committed early."""
        n, trie, unknown = len(text), self.trie, self.unknown
        best, start, piece = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here, end = best[i], i + 1
            entry = trie.get(text[i])
            if (entry is None or entry[2] is None) and here + unknown > best[end]:
                best[end], start[end], piece[end] = here + unknown, i, -1
            while entry is not None:
                node, found, worth = entry
                if worth is not None and here + worth > best[end]:
                    best[end], start[end], piece[end] = here + worth, i, found
                if end == n or not node:
                    break
                entry = node.get(text[end])
                end += 1
        out = []
        while n:
            if piece[n] >= 0:
                out.append(piece[n])
            else:
                out += [self.byte_ids[b] for b in reversed(text[start[n] : n].encode())]
            n = start[n]
        return out[::-1]

    def search(self, text: str) -> list[int]:
        if len(text) <= 2 * self.longest:
            return self._short(text)
        return [i for run in self.stream(text) for i in run]

    def _abreast(self, texts: list[str]) -> list[bytes]:
        """``_short`` for many texts at once: a column for each text, one step for all at each boundary."""
        texts_by_size = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        size = np.array([len(texts[k]) for k in texts_by_size])
        most, many = int(size[0]), len(texts)
        chars = np.zeros((many, most), np.int64)
        chars[np.arange(most) < size[:, None]] = np.frombuffer("".join([texts[k] for k in texts_by_size]).encode("utf-32-le"), np.uint32)
        chars = chars.T.copy()
        best = np.full((most + 1, many), -np.inf)
        start, piece = np.zeros((most + 1, many), np.int32), np.full((most + 1, many), -1, np.int32)
        best[0] = 0.0
        top, strange = max(len(self.edges) - 1, 0), np.zeros(many, bool)
        for i in range(most):
            live = np.arange(np.searchsorted(-size, -i))  # those that go on, the longest first
            node = np.zeros(len(live), np.int64)
            for end in range(i + 1, most + 1):
                edge = node << _CHAR_BITS | chars[end - 1, live]
                at = np.minimum(np.searchsorted(self.edges, edge), top)
                met = self.edges[at] == edge if len(self.edges) else np.zeros(len(edge), bool)
                if end == i + 1:
                    known = met & (self.ident[self.behind[at]] >= 0) if len(self.edges) else met
                    strange[live[~known]] = True
                live, node = live[met], self.behind[at[met]]
                if not len(live):
                    break
                score = best[i, live] + self.worth[node]
                more = score > best[end, live]
                to = live[more]
                best[end, to], start[end, to], piece[end, to] = score[more], i, self.ident[node[more]]
        # Texts with a character that no piece holds are left to the search of one text.
        at, steps = size.copy(), []
        at[strange] = 0
        column = np.arange(many)
        while at.any():
            steps.append(np.where(at > 0, piece[at, column], -1))
            at = np.where(at > 0, start[at, column], 0)
        found = [b""] * many
        ids = np.array(steps[::-1], np.int32).reshape(len(steps), many).T
        flat, ends = ids[ids >= 0].tobytes(), (4 * np.cumsum((ids >= 0).sum(1))).tolist()
        for k, low, high, odd in zip(texts_by_size, [0, *ends], ends, strange.tolist(), strict=False):
            found[k] = _packed(self._short(texts[k])) if odd else flat[low:high]
        return found

    def _cuts(self, words: list[str]) -> tuple[list[int], list[int]]:
        """Sure boundaries inside the words: the place of each word that has one, and the characters before it there."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        ends = np.cumsum(size)
        sure = np.ones(len(chars), bool)
        if len(self.joined):
            two = chars[:-1] << _CHAR_BITS | chars[1:]
            sure[1:] = self.joined[np.minimum(np.searchsorted(self.joined, two), len(self.joined) - 1)] != two
        sure[(ends - size)[size > 0]] = False
        at = np.flatnonzero(sure)
        owner = np.searchsorted(ends, at, "right")
        return owner.tolist(), (at - (ends - size)[owner]).tolist()

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of every word, packed; those that this worker has not met are searched together."""
        found = [*map(self.kept.get, words)]
        places = [k for k, ids in enumerate(found) if ids is None and words[k]]
        new = [words[k] for k in places]
        # Words with a sure boundary fall into parts, the others are searched as they are.
        cuts: dict[int, list[int]] = {}
        for owner, cut in zip(*self._cuts(new), strict=True):
            cuts.setdefault(owner, [0]).append(cut)
        parts = {}
        for owner, at in cuts.items():
            word = new[owner]
            parts[word] = [word[a:b] for a, b in zip(at, [*at[1:], None], strict=True)]
        wanted = dict.fromkeys(w for w in new if w not in parts) | dict.fromkeys(chain.from_iterable(parts.values()))
        fresh = {p: ids for p, ids in zip(wanted, map(self.kept.get, wanted), strict=True) if ids is not None}
        missed = [p for p in wanted if p not in fresh] if fresh else [*wanted]
        short = [p for p in missed if len(p) <= 2 * self.longest]
        for low in range(0, len(short), _ABREAST):
            some = short[low : low + _ABREAST]
            fresh.update(zip(some, self._abreast(some), strict=True))
        if len(short) < len(missed):
            fresh.update((p, _packed(self.search(p))) for p in missed if len(p) > 2 * self.longest)
        for word, ps in parts.items():
            fresh[word] = b"".join([fresh[p] for p in ps])
        for k, word in zip(places, new, strict=True):
            found[k] = fresh[word]
        for long in [w for w in new if len(w) > 64]:
            for w in {long, *parts.get(long, ())}:
                if len(w) > 64:
                    fresh.pop(w, None)
        if len(self.kept) + len(fresh) > KEPT_WORDS:
            self.kept.clear()
        self.kept.update(fresh)
        return [self.mark if ids is None else ids for ids in found]

    def units(self, text: str) -> Iterator[list[str]]:
        """Parts of a text that can be searched one by one: words, by the stretch; "" is a literal U+2581."""
        for k, part in enumerate(text.split(SPACE) if text else []):
            if k:
                yield [""]
            part = ("" if k else SPACE) + part.replace(" ", SPACE)
            if not self.words_split:
                yield [part] if part else []
                continue
            low = 0
            while low < len(part):
                high = low + STRETCH
                while high < len(part) and not (part[high] == SPACE and part[high - 1] != SPACE):
                    high += 1
                yield _WORD.findall(part[low:high])
                low = high

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(b"".join([ids for unit in self.units(text or "") for ids in self.words(unit)]), np.int32).tolist()

    def decode(self, values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of id sequences side by side, and the offsets of the texts; the leading space goes."""
        ends = self.ends[values]
        sizes = ends - np.where(values > 0, self.ends[values - 1], 0)
        to = np.concatenate([[0], np.cumsum(sizes)])
        data = self.table[np.repeat(ends - to[1:], sizes) + np.arange(to[-1])]
        at = to[bounds]
        some = at[1:] > at[:-1]
        keep = np.ones(len(data), bool)
        keep[at[:-1][some]] = False
        return data[keep], at - np.concatenate([[0], np.cumsum(some)])


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary.load(path)


def encode_column(column: pa.Array, model: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts side by side, and the offsets of the texts."""
    voc = vocabulary(model)
    values, ends, total, held = [], [], 0, []

    def settle() -> None:
        """The ids of the words held, each distinct word looked up once."""
        nonlocal total
        place: dict[str, int] = {w: k for k, w in enumerate(dict.fromkeys(held))}
        at = np.fromiter(map(place.__getitem__, held), np.int64, len(held))
        found = voc.words(list(place))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = np.frombuffer(b"".join(found), np.int32)
        first, many = (np.cumsum(sizes) - sizes)[at], sizes[at]
        to = np.cumsum(many)
        values.append(ids[np.repeat(first - (to - many), many) + np.arange(to[-1])])
        # Where each text that ended among these words ends in the ids.
        for k in range(len(ends)):
            if ends[k] < 0:
                ends[k] = total + (int(to[-ends[k] - 2]) if ends[k] < -1 else 0)
        total += int(to[-1])
        held.clear()

    for text in column.to_pylist():
        for unit in voc.units(text or ""):
            held += unit
            if len(held) >= STRETCH:
                settle()
        ends.append(-len(held) - 1 if held else total)
    if held:
        settle()
    return np.concatenate([np.zeros(0, np.int32), *values]), np.array([0, *ends], np.int64)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """(id, ids) of every document."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        values, bounds = encode_column(part.column("text"), model)
        return pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))], ["id", "ids"])

    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return map_slices(slim, work, "id bigint, ids array<int>")


def decode_column(ids: pa.Array, model: str) -> pa.Array:
    voc = vocabulary(model)
    bounds = ids.offsets.to_numpy().astype(np.int64)
    data, off = voc.decode(ids.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]], bounds - bounds[0])
    return pa.StringArray.from_buffers(len(ids), pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))


def decode(encoded: DataFrame, id_col: str = "id", ids_col: str = "ids", model: str = DEFAULT_MODEL) -> DataFrame:
    """(id, text) of id sequences; null is an empty sequence."""
    slim = encoded.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).cast("array<int>").alias("ids"))

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                ids = pa.concat_arrays([part.column("ids")])
                yield pa.RecordBatch.from_arrays([part.column("id"), decode_column(ids, model)], ["id", "text"])

    return map_batches(slim, run, "id bigint, text string")


def encode_and_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """(id, ids, decoded) of every document in one pass."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        values, bounds = encode_column(part.column("text"), model)
        ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))
        return pa.RecordBatch.from_arrays([part.column("id"), ids, decode_column(ids, model)], ["id", "ids", "decoded"])

    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return map_slices(slim, work, "id bigint, ids array<int>, decoded string")
