"""Byte-level BPE encoding and decoding by a file of ranks.

Texts are cut into pieces without a regular expression. Every code point has a class; each class is
a function from the automaton's states to its states; functions compose associatively, so all
positions are solved by a scan: blocks of positions compose their functions side by side, block
results are chained, and a second sweep gives every position its state. Piece starts follow from a
state, the one before it and the next class. Pieces are slices of the text; the ids of a piece are
merged once and cached.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from netlantern.llm.common import text_or_empty

# Classes of code points.
END, LETTER, NUMBER, SPACE, WHITE, OTHER, QUOTE, ONE, R, V, EL, E = range(12)
# What the automaton knows after a position.
START, WORD, DIGITS, SIGNS, BLANK, GAP, QUOTED, AFTER_R, AFTER_V, AFTER_L, SUFFIX = range(11)
STATES = 11
#: The white space of the splitting pattern, and the letters of its suffixes
#: 's 't 'm 'd, 're, 've, 'll.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SUFFIX_LETTERS = {"s": ONE, "t": ONE, "m": ONE, "d": ONE, "r": R, "v": V, "l": EL, "e": E}

WINDOW = 1 << 20
BLOCK = 32
#: Pieces in each of the cache's two generations, and the longest piece kept.
CACHED = 400_000
CACHED_CHARS = 64
SHORT = 32
#: Rows that are decoded at a time.
DECODED = 500


@lru_cache(1)
def class_table() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            table[point] = LETTER
        elif kind == "N":
            table[point] = NUMBER
    table[[ord(c) for c in WHITE_SPACE]] = WHITE
    table[ord(" ")] = SPACE
    table[ord("'")] = QUOTE
    for letter, kind in SUFFIX_LETTERS.items():
        table[ord(letter)] = kind
    return table


@lru_cache(1)
def transitions() -> np.ndarray:
    """``transitions()[class, state]``: the state after a code point of that class."""
    step = np.zeros((12, STATES), np.uint8)
    step[END] = START
    step[[LETTER, ONE, R, V, EL, E]] = WORD
    step[NUMBER] = DIGITS
    step[SPACE] = BLANK
    step[WHITE] = GAP
    step[OTHER] = SIGNS
    step[QUOTE] = QUOTED
    step[QUOTE, [SIGNS, BLANK, QUOTED]] = SIGNS
    step[ONE, QUOTED] = SUFFIX
    step[R, QUOTED], step[V, QUOTED], step[EL, QUOTED] = AFTER_R, AFTER_V, AFTER_L
    step[E, [AFTER_R, AFTER_V]] = SUFFIX
    step[EL, AFTER_L] = SUFFIX
    return step


def scan(classes: np.ndarray, before: int = START) -> np.ndarray:
    """The state after every position, given the state before the first."""
    n = len(classes)
    rows = -(-n // BLOCK)
    padded = np.zeros(rows * BLOCK, np.intp)
    padded[:n] = classes
    moves = (padded * STATES).reshape(rows, BLOCK).T.copy()
    step = transitions().ravel()
    whole = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (rows, STATES))
    for move in moves:
        whole = step[move[:, None] + whole]
    entering = np.empty(rows, np.uint8)
    at = before
    for i, row in enumerate(whole.tolist()):
        entering[i] = at
        at = row[at]
    out = np.empty((BLOCK, rows), np.uint8)
    for j, move in enumerate(moves):
        entering = step[move + entering]
        out[j] = entering
    return out.T.ravel()[:n]


#: starts()[state before, state now]: a piece begins here, unless white space says otherwise.
@lru_cache(1)
def starts() -> np.ndarray:
    begin = np.ones((STATES, STATES), bool)
    begin[:, START] = False
    begin[BLANK] = False
    begin[WORD, WORD] = False
    begin[DIGITS, DIGITS] = False
    begin[SIGNS, SIGNS] = begin[QUOTED, SIGNS] = False
    begin[QUOTED, [SUFFIX, AFTER_R, AFTER_V, AFTER_L]] = False
    begin[[AFTER_R, AFTER_V, AFTER_L], WORD] = False
    begin[[AFTER_R, AFTER_V, AFTER_L], SUFFIX] = False
    for white in (BLANK, GAP):
        begin[:, white] = True
        begin[[BLANK, GAP], white] = False
    begin[:, START] = False
    return begin


def piece_starts(texts: list[str], units: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces begin in the texts laid end to end, one END after each; and the ENDs' places.

    With ``units``, only pieces that don't stand behind white space: a unit is a run of white space
    and the piece behind it.
    """
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    stream = "\n".join(texts) + "\n"
    table, state, found = class_table(), START, []
    open_suffix = np.zeros(STATES, bool)
    open_suffix[[AFTER_R, AFTER_V, AFTER_L]] = True
    for at in range(0, len(stream), WINDOW):
        points = np.frombuffer(stream[at : at + WINDOW + 1].encode("utf-32-le"), "<u4")
        classes = table[points]
        marks = ends[np.searchsorted(ends, at) : np.searchsorted(ends, at + len(points))]
        classes[marks - at] = END
        n = min(WINDOW, len(points))
        after = np.full(n, END, np.uint8)
        after[: len(classes) - 1] = classes[1 : n + 1]
        now = scan(classes[:n], state)
        before = np.empty(n, np.uint8)
        before[0], before[1:] = state, now[:-1]
        begin = starts()[before, now]
        white = (now == BLANK) | (now == GAP)
        follows = (after != END) & (after != SPACE) & (after != WHITE)
        begin |= white & follows
        if units:
            begin &= (before != BLANK) & (before != GAP)
        # A quote and r, v or l that don't become a suffix were two pieces.
        split = open_suffix[before] & (now != SUFFIX)
        begin[np.flatnonzero(split[1:])] = True
        if split[0]:
            found.append(np.array([at - 1]))
        found.append(np.flatnonzero(begin) + at)
        state = int(now[-1])
    return (np.concatenate(found) if found else np.empty(0, np.int64)), ends


def pieces(texts: list[str], units: bool = False) -> Iterator[list[str]]:
    """The pieces (or units) of each text, in order; an empty text has none."""
    begins, ends = piece_starts(texts, units)
    first = 0
    for text, low, high in zip(
        texts,
        np.searchsorted(begins, np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends).tolist(),
        np.searchsorted(begins, ends).tolist(),
    ):
        own = (begins[low:high] - first).tolist()
        yield [text[a:b] for a, b in zip(own, [*own[1:], len(text)])]
        first += len(text) + 1


NEVER = 1 << 62


def merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Look all pairs over before each merge: quadratic, and quick for a word."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get = ranks.get
    pairs = [get(piece[i : i + 2], NEVER) for i in range(len(piece) - 1)]
    while pairs and (lowest := min(pairs)) < NEVER:
        i = pairs.index(lowest)
        parts[i] += parts[i + 1]
        del parts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], NEVER)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], NEVER)
    return [ranks[part] for part in parts]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap of pairs over a linked list: linear memory, n log n time."""
    n = len(piece)
    # Of the part that begins at a: where it ends (0: it was merged away), and its neighbours.
    stop, after, back = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for a in range(n - 1):
        rank = ranks.get(piece[a : a + 2])
        if rank is not None:
            heap.append((rank, a, a + 2))
    heapq.heapify(heap)
    while heap:
        _, a, until = heapq.heappop(heap)
        if not stop[a]:
            continue
        b = after[a]
        if b >= n or stop[b] != until:
            continue
        stop[a], stop[b] = until, 0
        after[a] = after[b]
        if after[a] < n:
            back[after[a]] = a
        for left in (a, back[a]):
            right = after[left] if left >= 0 else n
            if right < n:
                rank = ranks.get(piece[left : stop[right]])
                if rank is not None:
                    heapq.heappush(heap, (rank, left, stop[right]))
    out, a = [], 0
    while a < n:
        out.append(ranks[piece[a : stop[a]]])
        a = after[a]
    return out


class Codec(dict):
    """Pieces to their ids as little-endian unsigned 32-bit integers, for one file of ranks.

    The dict is the younger generation of the cache; when it is full it replaces the older one, from
    which pieces still in use come back. Neither holds long pieces.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        self.older: dict[str, bytes] = {}
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.lengths = np.zeros(max(self.tokens, default=-1) + 1, np.int64)
        for rank, token in self.tokens.items():
            self.lengths[rank] = len(token)

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = np.array(self.merge(piece.encode("utf-8")), "<u4").tobytes()
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def merge(self, piece: bytes) -> list[int]:
        """Merge neighbours, lowest rank first and leftmost on ties."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return merge_short(piece, self.ranks) if len(piece) <= SHORT else merge_long(piece, self.ranks)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        get = self.__getitem__
        for found in pieces(texts):
            yield b"".join(map(get, found))

    def offsets(self, ids: bytes) -> np.ndarray:
        """Where in the text's bytes each token begins, and where the last one ends."""
        lengths = self.lengths[np.frombuffer(ids, "<u4")]
        return np.concatenate([[0], np.cumsum(lengths)]).astype("<u4")

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def slices(texts: pa.Array, size: int = WINDOW) -> Iterator[tuple[int, pa.Array]]:
    """A batch's texts some at a time, about ``size`` bytes each: (first, texts)."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        done = int(ends[first - 1]) if first else 0
        end = min(len(texts), int(np.searchsorted(ends, done + size)) + 1)
        yield first, texts.slice(first, end - first)
        first = end


def in_parts(texts: pa.Array, size: int = WINDOW) -> Iterator[tuple[int, int, list[str]]]:
    """The same as lists: (first, end, texts)."""
    for first, part in slices(texts, size):
        yield first, first + len(part), part.to_pylist()


def encode(docs: DataFrame, ranks_path: str, text: str = "text") -> DataFrame:
    """``doc_id, ids, offsets`` of every row.

    ``ids`` holds the token ids as little-endian unsigned 32-bit integers, ``offsets`` the byte at
    which each begins and at last the text's length, likewise: token ``i`` covers bytes ``offsets[i]``
    to ``offsets[i + 1]``. Null counts as empty, which has no ids and one offset, 0. Repeated rows
    stay; an empty table gives no rows; other columns are not read. ``ranks_path`` is a file that every
    executor has. Long batches are worked on and handed over in parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(ranks_path)
        for batch in batches:
            for low, high, texts in in_parts(batch.column(1)):
                ids = list(known.encode(texts))
                places = [known.offsets(x).tobytes() for x in ids]
                columns = [
                    batch.column(0).slice(low, high - low),
                    pa.array(ids, pa.binary()),
                    pa.array(places, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "offsets"])

    fields = [docs.schema["doc_id"]] + [T.StructField(n, T.BinaryType()) for n in ("ids", "offsets")]
    return docs.select("doc_id", text_or_empty(text).alias("text")).mapInArrow(run, T.StructType(fields))


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id, ids, decoded`` of every row of ``encoded``: the bytes that its ``ids`` stand for.

    Null ids decode to null; an id that the file lacks fails the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(ranks_path)
        for batch in batches:
            for low in range(0, len(batch), DECODED):
                part = batch.slice(low, DECODED)
                found = [None if x is None else known.decode(x) for x in part.column(1).to_pylist()]
                columns = [part.column(0), part.column(1), pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"])

    fields = [encoded.schema[n] for n in ("doc_id", "ids")] + [T.StructField("decoded", T.BinaryType())]
    return encoded.select("doc_id", "ids").mapInArrow(run, T.StructType(fields))


def decode_span(ids: bytes, offsets: bytes, start: int, end: int, known: Codec) -> bytes:
    """The bytes ``start`` to ``end`` of the text, from the tokens that cover them alone."""
    places = np.frombuffer(offsets, "<u4")
    low = max(int(np.searchsorted(places, start, "right")) - 1, 0)
    high = int(np.searchsorted(places, end, "left"))
    found = known.decode(ids[4 * low : 4 * high])
    return found[start - int(places[low]) : end - int(places[low])]
