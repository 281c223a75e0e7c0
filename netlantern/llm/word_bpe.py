"""Token ids by a vocabulary of words with end marks (lower case, white space dropped).

Nothing reaches across a space, so a text's ids are those of its chunks between spaces. The different
chunks of many texts are looked up once, and the ids of all are gathered from those. Chunks are cached
without the signs at their end; the library encodes new ones, many at a time, with a character between
them that has a token of its own.
"""

from __future__ import annotations

import json
import os
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from netlantern.llm.byte_bpe import WHITE_SPACE

#: Entries of one generation of the cache, and the longest chunk kept in it.
CACHED = 400_000
CACHED_CHARS = 64
#: Fixed value: how the vocabulary cuts normalised text into words.
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^"
    + "".join(f"\\u{ord(c):04x}" for c in WHITE_SPACE)
    + r"\p{L}\p{N}]+"
)
SIGNS = string.punctuation
#: New chunks handed to the library as one text, and what stands between them.
TOGETHER = 512
BETWEEN = "\0"


def without_signs(chunk: str) -> tuple[str, str]:
    """A chunk as what it begins with and the ASCII signs at its end, ids of which are those of both.

    Words end between a letter or digit and a sign. ASCII letters come in lower case, as the vocabulary
    has them. Letters that normalising could give a mark at the end keep their signs.
    """
    key = chunk.rstrip(SIGNS)
    end = key[-1:]
    if not (end.isascii() or "\xc0" <= end <= "\xff") or not end.isalnum():
        key = chunk
    return key.lower() if key.isascii() else key, chunk[len(key) :]


class WordCodec:
    """Texts to their ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, cached: int = CACHED) -> None:
        self.cached = cached
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            known = json.load(f)
        end = known["model"]["end_of_word_suffix"]
        cut = known["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        plain = cut.replace("[\\p{L}]", "\\p{L}").replace("[\\p{N}]", "\\p{N}")
        if not end or plain.replace("\\s", "") != regex.sub(r"\\u[0-9a-f]{4}", "", WORDS):
            raise ValueError(f"{path} isn't a vocabulary of words with end marks")
        self.marks = [t["content"] for t in known["added_tokens"]]
        if not all(mark.startswith("<") for mark in self.marks):
            raise ValueError(f"a special string of {path} doesn't begin with <")
        between = self.library.encode(BETWEEN, add_special_tokens=False).ids
        if len(between) != 1:
            raise ValueError(f"{path} has no token of its own for what stands between chunks")
        self.between = between[0]
        # Two generations: a full one becomes the older, and what is still in use returns.
        self.chunks: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _by_library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, keys: list[str]) -> None:
        """Add the ids of new keys, none of them long or holding a special string or ``BETWEEN``."""
        for at in range(0, len(keys), TOGETHER):
            lot = keys[at : at + TOGETHER]
            joined = f" {BETWEEN} ".join([*lot, ""])
            ids = np.array(self.library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(ids == self.between) * 4
            data, last = ids.tobytes(), 0
            if len(stops) != len(lot):
                self.chunks.update((k, self._by_library(k)) for k in lot)
                continue
            for key, stop in zip(lot, stops.tolist()):
                self.chunks[key] = data[last:stop]
                last = stop + 4

    def _ids(self, chunks: list[str]) -> list[bytes]:
        """The ids of different chunks."""
        if len(self.chunks) >= self.cached:
            self.older, self.chunks = self.chunks, {"": b""}
        get, old = self.chunks.get, self.older.get
        ids = list(map(get, chunks))
        # Lists of strings and numbers alone: many small tuples would keep the garbage collector busy.
        places, keys, signs = [], [], []
        for i in [i for i, x in enumerate(ids) if x is None]:
            c = chunks[i]
            if len(c) > CACHED_CHARS or BETWEEN in c or ("<" in c and any(m in c for m in self.marks)):
                ids[i] = self._by_library(c)
                continue
            key, sign = without_signs(c)
            places.append(i)
            keys.append(key)
            signs.append(sign)
        new = []
        for k in {*keys, *signs}:
            if get(k) is None:
                if (x := old(k)) is None:
                    new.append(k)
                else:
                    self.chunks[k] = x
        self._learn(new)
        for i, key, sign in zip(places, keys, signs):
            ids[i] = get(key) + get(sign) if sign else get(key)
        return ids

    def encode_all(self, texts: pa.Array | list[str]) -> Iterator[bytes]:
        """The ids of each text; many texts at a time cost less."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        ids = self._ids(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy()
        ends = np.cumsum(np.append(0, sizes[codes]))
        at = np.repeat(starts[codes] - ends[:-1], sizes[codes]) + np.arange(ends[-1])
        data = np.frombuffer(b"".join(ids), "<u4")[at].tobytes()
        last = 0
        for stop in ends[np.cumsum(pc.list_value_length(split).to_numpy())].tolist():
            yield data[last * 4 : stop * 4]
            last = stop

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))


@lru_cache(2)
def word_codec(path: str, cached: int = CACHED) -> WordCodec:
    return WordCodec(path, cached)
