"""64-bit SimHash fingerprints of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHINGLE_WORDS = 3
SEED = 42
CHUNK = 1 << 15


def simhash(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one whole text, unsigned; 0 when it has no word.

    ASCII letters are lower-cased, words end at ASCII white space, shingles count as often as
    they occur, and a text of fewer words is one shingle. A bit is set if it is set in over half
    the shingles' hashes.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    last = ends[words - 1 :] if len(found) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        spans = zip(starts[at : min(at + CHUNK, n)].tolist(), last[at : at + CHUNK].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


@F.pandas_udf(T.LongType())
def simhash_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        prints = np.fromiter((simhash(t) for t in batch), np.uint64, len(batch))
        yield pd.Series(prints.view(np.int64))
