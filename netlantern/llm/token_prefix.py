"""Token counts at every prefix of a text, by dynamic programming, for a byte-level BPE vocabulary.

The encoding of a prefix ends in one token ``t``, and what stands before it is the encoding of a
shorter prefix. So going through a word byte by byte, the last token of each prefix is the one that
ends there and *follows* the last token of the prefix before it: the two, laid together, are encoded
as just those two. Its count is that prefix's plus one. No prefix is encoded anew.

A text is a sequence of units: a run of white space with the word, number or signs behind it. A
prefix within a unit leaves the units before it as they are, so what each code point adds to the
count depends on its unit alone and is computed once per distinct unit. A text's steps, one signed
byte per code point, answer how many tokens any prefix has, and the longest prefix within a budget.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlantern.llm.byte_bpe import WHITE_SPACE, in_parts, merge_long, merge_short, pieces
from netlantern.llm.common import text_or_empty

CACHED = 400_000
CACHED_CHARS = 64
LIMIT = 1024


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable ones for themselves, the
    others, in order, for the code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Counter(dict):
    """Units to their steps; the dict is the younger of the cache's two generations."""

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, encoding="utf-8") as f:
            known = json.load(f)
        model, letters = known["model"], byte_letters()
        if model["type"] != "BPE" or known["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError(f"{path} isn't a byte-level BPE vocabulary")
        self.special = [t["content"] for t in known["added_tokens"] if t["special"]]
        self.marks = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        whole = {t: bytes(letters[c] for c in t) for t in model["vocab"] if t not in self.special}
        self.tokens = {b: model["vocab"][t] for t, b in whole.items()}
        # Pairs merge by their place in the list, whatever the ids.
        self.ranks = {bytes([b]): -1 for b in range(256)}
        for place, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[whole[a] + whole[b]] = place
        self.lengths = sorted({len(b) for b in self.tokens}, reverse=True)
        self.longest = max(self.lengths, default=1)
        self.older: dict[str, bytes] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.begun: dict[bytes, tuple[bytes, bytes, bytes]] = {}

    def follows(self, a: bytes, b: bytes) -> bool:
        """Whether ``a`` and ``b`` laid together are encoded as just those two."""
        known = self.pairs.get((a, b))
        if known is None:
            whole = a + b
            merge = merge_short if len(whole) <= 32 else merge_long
            known = whole not in self.tokens and self._ends(whole, merge) == len(a)
            if len(self.pairs) >= 4 * CACHED:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def _ends(self, whole: bytes, merge) -> int:
        """Where the first of two tokens ends, or -1 if there are more than two."""
        spans = merge(whole, _Parts(self.ranks))
        return len(spans[0]) if len(spans) == 2 else -1

    def prefixes(self, word: bytes) -> tuple[bytes, bytes, bytes]:
        """For every prefix of one piece, from the empty one on: its tokens, the length of its last
        token, and (without the empty one) what its last byte added to the tokens.

        Goes on from the longest beginning that an earlier word shared. Pieces of 256 tokens or more
        don't fit in bytes; see :meth:`_long_prefixes`.
        """
        end, known = len(word), None
        while end and (known := self.begun.get(word[:end])) is None:
            end -= 1
        counts, lasts, steps = known or (b"\0", b"\0", b"")
        tokens, longest = self.tokens, self.longest
        while end < len(word):
            end += 1
            for start in range(end - longest if end > longest else 0, end):
                token = word[start:end]
                if token in tokens and (
                    not start or self.follows(word[start - lasts[start] : start], token)
                ):
                    break
            else:
                raise ValueError(f"no token ends a prefix of {word!r}")
            n = counts[start] + 1
            steps += bytes([(n - counts[-1]) & 255])
            counts += bytes([n])
            lasts += bytes([end - start])
            if len(self.begun) >= 2 * CACHED:
                self.begun.clear()
            self.begun[word[:end]] = counts, lasts, steps
        return counts, lasts, steps

    def _long_prefixes(self, word: bytes) -> list[int]:
        """The same counts for a piece of any length, without sharing its beginnings."""
        counts, last, tokens = [0], [b""], self.tokens
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - self.longest), end):
                token = word[start:end]
                if token in tokens and (not start or self.follows(last[start], token)):
                    last.append(token)
                    counts.append(counts[start] + 1)
                    break
            else:
                raise ValueError(f"no token ends a prefix of {word!r}")
        return counts

    def _at_points(self, piece: str) -> list[int]:
        """Tokens of every prefix of one piece that ends with a whole code point, from the first."""
        word = piece.encode("utf-8")
        counts = self.prefixes(word)[0] if len(word) <= CACHED_CHARS else self._long_prefixes(word)
        if len(word) == len(piece):
            return list(counts[1:])
        return [n for n, byte in zip(counts[1:], (*word[1:], 0)) if byte & 0xC0 != 0x80]

    @staticmethod
    def alone(unit: str) -> bool:
        """Whether a unit is one piece, and so is each of its beginnings."""
        if unit[0] == " ":
            return unit[1:2] not in WHITE_SPACE
        return unit[0] not in WHITE_SPACE and (unit[0] != "'" or not unit[1:2].isalpha())

    def unit(self, unit: str) -> list[int]:
        """Tokens of every prefix of a unit, from the first code point on."""
        word = unit.lstrip(WHITE_SPACE)
        gap = unit[: len(unit) - len(word)]
        out = self._at_points(gap) if gap else []
        if not word:
            return out
        before = 0
        if gap:
            # Before a word the run of white space ends one code point sooner; a plain space then
            # begins the word's piece, anything else is a piece of its own.
            before = out[-2] if len(gap) > 1 else 0
            if gap[-1] != " ":
                before += self._at_points(gap[-1])[-1]
        led = gap[-1:] == " "
        inside = self._at_points(" " + word)[1:] if led else self._at_points(word)
        if word[0] == "'" and word[1:].isalpha() and not led:
            # A suffix that isn't complete yet is a quote and letters.
            quote = self._at_points("'")[-1]
            inside[1:-1] = [quote + n for n in self._at_points(word[1:])[:-1]]
        return out + [before + n for n in inside]

    def __missing__(self, unit: str) -> bytes:
        steps = self.older.get(unit)
        if steps is None:
            if not self.alone(unit):
                steps = _differences(self.unit(unit))
            elif unit.isascii() and len(unit) <= CACHED_CHARS:
                steps = self.prefixes(unit.encode("utf-8"))[2]
            else:
                steps = _differences(self._at_points(unit))
        if len(unit) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.older = dict(self)
                self.clear()
            self[unit] = steps
        return steps

    def plain(self, text: str) -> bytes:
        return next(self.plain_all([text]))

    def plain_all(self, texts: list[str]) -> Iterator[bytes]:
        get = self.__getitem__
        for units in pieces(texts, units=True):
            yield b"".join(map(get, units))

    def steps_all(self, texts: list[str]) -> Iterator[bytes]:
        """What each code point of each text adds to its tokens, one signed byte each."""
        if not any(mark in text for mark in self.special for text in texts):
            yield from self.plain_all(texts)
        else:
            yield from map(self.steps, texts)

    def steps(self, text: str) -> bytes:
        """The same for one text. A special string counts as one token once it is complete, and
        as ordinary text before.
        """
        out, at = [], 0
        for mark in self.marks.finditer(text):
            part = text[at : mark.start()]
            own = self.plain(part)
            out.append(own)
            # Its beginnings may run on from the last unit, and from nothing before that.
            tail = "".join(next(pieces([part], units=True))[-1:])
            held = total(self.plain(tail))
            grown = [total(self.plain(tail + mark[0][:i])) - held for i in range(1, len(mark[0]))]
            out.append(_differences([*grown, 1]))
            at = mark.end()
        out.append(self.plain(text[at:]) if at else self.plain(text))
        return b"".join(out)


class _Parts(dict):
    """Ranks for merging, with every part standing for itself in the result."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.get = ranks.get

    def __missing__(self, part: bytes) -> bytes:
        return part


def _differences(counts: list[int]) -> bytes:
    return bytes([(b - a) & 255 for a, b in zip((0, *counts), counts)])


def total(steps: bytes) -> int:
    return int(np.frombuffer(steps, np.int8).sum(dtype=np.int64))


def count_at(steps: bytes, points: int) -> int:
    """Tokens of the first ``points`` code points."""
    return total(steps[:points])


def longest_within(steps: bytes, budget: int) -> int:
    """The most code points a prefix of at most ``budget`` tokens can have."""
    counts = np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_prefixes(
    docs: DataFrame, vocabulary_path: str, budget: int = LIMIT, text: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, fit_points, steps`` of every row.

    ``steps`` holds for each code point of the text what it adds to the number of tokens, as a signed
    byte; its sum over a prefix is the count the library gives for that prefix, without begin, end or
    other added tokens. ``n_tokens`` is the whole text's; ``fit_points`` the length of the longest
    prefix of at most ``budget`` tokens. Null counts as empty: no bytes, no tokens, no steps. Repeated
    rows stay, an empty table gives no rows, other columns are not read. ``vocabulary_path`` is a file
    that every executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(vocabulary_path)
        for batch in batches:
            for low, high, texts in in_parts(batch.column(1)):
                steps = list(known.steps_all(texts))
                counts = [total(s) for s in steps]
                fits = [
                    len(s) if n <= budget and len(s) <= budget else longest_within(s, budget)
                    for s, n in zip(steps, counts)
                ]
                columns = [
                    batch.column(0).slice(low, high - low),
                    batch.column(2).slice(low, high - low),
                    pa.array(counts, pa.int64()),
                    pa.array(fits, pa.int64()),
                    pa.array(steps, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    fields = [
        docs.schema["doc_id"],
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("fit_points", T.LongType()),
        T.StructField("steps", T.BinaryType()),
    ]
    whole = text_or_empty(text)
    n_bytes = F.octet_length(whole).cast("long").alias("n_bytes")
    rows = docs.select("doc_id", whole.alias("text"), n_bytes)
    return rows.mapInArrow(run, T.StructType(fields))
