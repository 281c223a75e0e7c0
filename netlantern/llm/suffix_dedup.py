"""Removal of every byte covered by a string of ``LENGTH`` bytes that also starts earlier.

Method: suffix arrays, built by linear grouping (``suffix_order.py``), over strings that can hold the same
window of ``LENGTH`` bytes. To bring those together each window names its least gram of bytes, the leftmost
of equal ones: equal windows name the same gram, and neighbouring windows share theirs. A run of windows
with one gram, which lies in the same third of all of them, is a piece of text; all its windows hold the
same longer core about the gram. Pieces whose core occurs once in all documents are left
out; equal pieces are one piece, whose first occurrence stands for all, and the windows of the others start
earlier elsewhere by that alone. The different pieces of a core go to one string, in which the core is one
letter; its suffixes are sorted, and equal windows are neighbours there; all but the first start earlier
elsewhere.

A core inside a line of a third of all documents has very many different pieces. Such pieces are cut into
their single windows, which then are equal or have nothing in common, so that no string is larger than
``PIECES`` pieces. Pieces are told apart by 128 bits of hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlantern.llm.common import forget, row_hash, text_or_empty, written
from netlantern.llm.suffix_order import suffix_array
from netlantern.plans.sizing import broadcast_if_small, is_small

LENGTH = 100
GRAM = 24
#: Parts of the places that a gram can have in a window.
PARTS = 3
#: A core with more different pieces has them cut into windows.
PIECES = 2048
#: The pieces of several cores share a string of about so many bytes.
STRING_BYTES = 1 << 17
#: Windows looked at together; a power of two.
AT_ONCE = 1 << 19
#: Bits of the map of cores that occur again. It saves work; what it lets through by chance does no harm.
MAP_BITS = 27
#: Pieces with more than one in so many of the rows are looked up from a broadcast; there are fewer of them.
HOT_SHARE = 4096

#: A document: without doc_id or with one, and the hash of its text.
DOC = ["no_id", "id", "h"]
PLACE = [*DOC, "a"]


def documents(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(
        F.isnull("doc_id").alias("no_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        row_hash().alias("h"),
        *more,
    )


# --- pieces of a text -------------------------------------------------------------------------------

BASE, ODD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def gram_hashes(values: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes at each place, put together from spans of powers of two."""
    out, done, span = None, 0, values.astype(np.uint64) + np.uint64(1)
    size = 1
    while size <= gram:
        if gram & size:
            times = np.uint64(pow(BASE, size, 1 << 64))
            out = span.copy() if out is None else out[: len(span) - done] * times + span[done:]
            done += size
        if 2 * size <= gram:
            span = span[:-size] * np.uint64(pow(BASE, size, 1 << 64)) + span[size:]
        size *= 2
    out ^= out >> np.uint64(32)
    out *= np.uint64(ODD)
    return out ^ (out >> np.uint64(29))


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of the ``width`` values from each place on."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def core_bytes(length: int, gram: int) -> int:
    """The bytes about a gram that all windows of a piece hold."""
    width = length - gram + 1
    return length - -(-width // PARTS) + 1


def pieces(text: bytes, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(first windows, numbers of windows, starts of the cores from there, their hashes), in parts.

    The least gram is that of the least leading hash bits, then the leftmost: the same in equal windows. So
    is its place in them, and the core, which begins at the least place of its part.
    """
    for start in range(0, len(text) - length + 1, AT_ONCE):
        part = np.frombuffer(text, np.uint8)[start : start + AT_ONCE + length - 1]
        first, r, c, keys = _cut(part, np.zeros(len(part) - length + 1, np.int8), length, gram)
        yield start + first, r, c, keys


def _cut(values: np.ndarray, of: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The pieces of some bytes. ``of`` tells windows of different texts apart; negative ones are none."""
    width = length - gram + 1
    part = -(-width // PARTS)
    reach = width - part  # from the first gram of a core to its last
    place = np.uint64(2 * AT_ONCE - 1)
    hashes = gram_hashes(values, gram)
    ranked = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)
    least = (least_of(ranked, width) & place).astype(np.int64)
    at = (least - np.arange(len(least))) // part
    new = (least[1:] != least[:-1]) | (at[1:] != at[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(np.r_[True, new])
    r = np.diff(np.r_[first, len(least)])
    some = of[first] >= 0
    first, r = first[some], r[some]
    core = least[first] - at[first] * part
    keys = hashes[core]
    for k in sorted({*range(gram, reach, gram), reach}):
        keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(ODD) + hashes[core + k]
    keys ^= keys >> np.uint64(29)
    return first, r, core - first, (keys * np.uint64(BASE)).view(np.int64)


def all_pieces(texts: pa.Array, length: int, gram: int) -> Iterator[tuple]:
    """(bytes, texts' numbers, places in the bytes, first windows, numbers of windows, starts and hashes
    of the cores) of the pieces of binary texts. Short ones are looked at many at once."""
    sizes = pc.binary_length(texts).to_numpy()
    low = 0
    while low < len(sizes):
        if sizes[low] > AT_ONCE:
            text = texts[low].as_buffer().to_pybytes()
            for a, r, c, keys in pieces(text, length, gram):
                yield text, np.full(len(a), low), a, a, r, c, keys
            low += 1
            continue
        ends = np.cumsum(sizes[low:])
        n = max(1, int(np.searchsorted(ends, AT_ONCE, "right")))
        ends = ends[:n]
        joined = b"".join([v.as_buffer() for v in texts.slice(low, n)])
        if len(joined) >= length:
            starts = ends - sizes[low : low + n]
            of = np.repeat(np.arange(n), sizes[low : low + n])[: len(joined) - length + 1]
            whole = np.arange(len(of)) + length <= ends[of]
            first, r, c, keys = _cut(np.frombuffer(joined, np.uint8), np.where(whole, of, -1), length, gram)
            own = of[first]
            yield joined, low + own, first, first - starts[own], r, c, keys
        low += n


def piece_hashes(text: bytes, a: np.ndarray, r: np.ndarray, length: int) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    found = (digest(text[i : i + n]) for i, n in zip(a.tolist(), (r + length - 1).tolist()))
    return np.fromiter(found, np.uint64, len(a)).view(np.int64)


# --- occurrences ------------------------------------------------------------------------------------


def recurring(docs: DataFrame, length: int, gram: int) -> np.ndarray:
    """A map of bits: set for the hashes of all cores that occur twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, keys in all_pieces(batch.column(0), length, gram):
                yield pa.RecordBatch.from_arrays([pa.array(keys)], names=["key"])

    texts = docs.select(text_or_empty().cast("binary").alias("text"))
    texts = texts.filter(F.octet_length("text") >= length)
    counts = texts.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n"))
    at = F.shiftrightunsigned("key", 64 - MAP_BITS)
    bit = F.expr("shiftleft(1L, CAST(at % 64 AS INT))")
    words = counts.filter("n > 1").select(at.alias("at")).groupBy((F.col("at") / 64).cast("long").alias("w"))
    found = words.agg(F.bit_or(bit).alias("bits")).toArrow()  # at most 2 ** MAP_BITS bits
    bits = np.zeros(1 << (MAP_BITS - 6), np.int64)
    bits[found["w"].to_numpy()] = found["bits"].to_numpy()
    return bits


def occurrences(docs: DataFrame, shared: Broadcast, length: int, gram: int) -> DataFrame:
    """``no_id, id, h, a, r, c, key, seg``: pieces from window ``a`` on whose cores, ``c`` bytes behind, may
    occur again, written."""
    names = [*PLACE, "r", "c", "key", "seg"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for text, *found in all_pieces(batch.column("text"), length, gram):
                at = (found[-1].view(np.uint64) >> np.uint64(64 - MAP_BITS)).astype(np.int64)
                some = np.flatnonzero((bits[at >> 6] >> (at & 63)) & 1)
                doc, place, a, r, c, keys = (x[some] for x in found)
                segs = piece_hashes(text, place, r, length)
                columns = [batch.column(x).take(pa.array(doc)) for x in DOC]
                columns += [pa.array(x, pa.int64()) for x in (a, r, c, keys, segs)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    texts = documents(docs, text_or_empty().cast("binary").alias("text"))
    texts = texts.filter(F.octet_length("text") >= length)
    schema = "no_id boolean, id long, h long, a long, r long, c long, key long, seg long"
    return written(texts.mapInArrow(run, schema), "pieces")


def first_pieces(found: DataFrame) -> DataFrame:
    """``key, seg, r, c, n`` and the place of the first of each different piece, written."""
    least = F.min(F.struct(*PLACE)).alias("first")
    each = found.groupBy("key", "seg", "r", "c").agg(least, F.count("*").alias("n"))
    return written(each.select("key", "seg", "r", "c", "n", "first.*"), "first")


def later_spans(found: DataFrame, first: DataFrame, length: int) -> DataFrame:
    """``no_id, id, h, a, b``: the bytes of all occurrences but the first of equal pieces.

    Pieces with many occurrences are looked up from a broadcast of those few; the others are shuffled.
    """
    total = first.agg(F.sum("n")).first()[0] or 0
    named = first.select("key", "seg", "r", "n", F.struct(*PLACE).alias("first")).filter("n > 1")
    hot = named.filter(F.col("n") * HOT_SHARE > total)
    cold = named.filter(F.col("n") * HOT_SHARE <= total)
    by = ["key", "seg", "r"]
    both = [found.join(F.broadcast(hot), by), found.join(cold, by)]
    spans = [
        one.filter(F.struct(*PLACE) != F.col("first")).select(
            *PLACE, (F.col("a") + F.col("r") + length - 1).alias("b")
        )
        for one in both
    ]
    return spans[0].unionByName(spans[1])


# --- strings ----------------------------------------------------------------------------------------


def cut_out(docs: DataFrame, wanted: DataFrame, length: int, single: bool) -> DataFrame:
    """The texts of the ``wanted`` pieces, or with ``single`` the occurrences of their windows."""
    each = wanted.groupBy(*DOC).agg(F.collect_list(F.struct("a", "r", "c", "key")).alias("cuts"))
    each = written(each, "cuts")
    texts = documents(docs, F.col("text").cast("binary").alias("text"))
    if is_small(each):
        texts = texts.join(F.broadcast(each.select(*DOC)), DOC, "left_semi")
    rows = texts.join(each, DOC)
    cut = F.explode("cuts").alias("cut")
    if not single:
        held = F.substring(F.col("text"), F.col("cut.a") + 1, F.col("cut.r") + length - 1)
        return rows.select(*DOC, "text", cut).select(*DOC, "cut.*", held.alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, value in enumerate(batch.column("text")):
                text = value.as_buffer().to_pybytes()
                cuts = batch.column("cuts")[k].as_py()
                starts = np.concatenate([np.arange(c["a"], c["a"] + c["r"]) for c in cuts])
                for low in range(0, len(starts), 1 << 16):
                    at = starts[low : low + (1 << 16)]
                    digests = [xxhash.xxh3_128_digest(text[i : i + length]) for i in at.tolist()]
                    pairs = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                    doc = [pa.repeat(batch.column(c)[k], len(at)) for c in DOC]
                    columns = [*doc, pa.array(at), *[pa.array(np.full(len(at), x)) for x in (1, 0)]]
                    columns += [pa.array(np.ascontiguousarray(pairs[:, j])) for j in (0, 1)]
                    yield pa.RecordBatch.from_arrays(columns, names=[*PLACE, "r", "c", "key", "seg"])

    schema = "no_id boolean, id long, h long, a long, r long, c long, key long, seg long"
    return rows.mapInArrow(run, schema)


def repeated_windows(rows: pd.DataFrame, length: int, core: int) -> pd.DataFrame:
    """``no_id, id, h, a, b``: bytes of windows of these pieces that start earlier in another of them.

    Windows are equal only within a core's pieces, which are all here. A window is the bytes before its
    core, a letter for the core, and the bytes behind, and begins where it does in the text.
    """
    held, begin = rows["held"].tolist(), rows["c"].to_numpy()
    ends = [c + core for c in begin.tolist()]
    letters: dict[bytes, int] = {}
    known = [letters.setdefault(h[e - core : e], len(letters)) for h, e in zip(held, ends)]
    flat = b"".join([h[: e - core] + b" " + h[e:] + b" " for h, e in zip(held, ends)])
    string = np.frombuffer(flat, np.uint8).astype(np.int64) + 1
    sizes = np.fromiter(map(len, held), np.int64, len(held)) - core + 1
    begins = np.cumsum(sizes + 1) - sizes - 1
    string[begins + begin] = 257 + np.array(known, np.int64)
    string[begins + sizes] = 0  # a letter below all others parts the pieces
    piece = np.repeat(np.arange(len(held)), sizes + 1)
    offset = np.arange(len(string)) - begins[piece]
    order = np.array(suffix_array(string), np.int64)
    order = order[offset[order] < rows["r"].to_numpy()[piece[order]]]
    windows = np.lib.stride_tricks.sliding_window_view(string.astype(np.int32), length - core + 1)
    same = np.zeros(len(order), bool)
    for low in range(1, len(order), 1 << 15):
        at = order[low : low + (1 << 15)]
        same[low : low + len(at)] = (windows[at] == windows[order[low - 1 : low - 1 + len(at)]]).all(1)
    group = np.cumsum(~same)
    # Documents in their order; the first window of a group is its least (document, place).
    doc = rows.groupby(DOC, sort=True).ngroup().to_numpy()[piece[order]]
    at = rows["a"].to_numpy()[piece[order]] + offset[order]
    by = np.lexsort((at, doc, group))
    group, doc, at, own = group[by], doc[by], at[by], piece[order][by]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, int)
    first = np.repeat(starts, np.diff(np.r_[starts, len(group)]))
    later = (doc != doc[first]) | (at != at[first])
    own, at = own[later], at[later]
    by = np.lexsort((at, own))
    own, at = own[by], at[by]
    new = np.r_[True, (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)] if len(own) else np.empty(0, bool)
    low = np.flatnonzero(new)
    last = np.r_[low[1:], len(own)] - 1
    found = rows[DOC].iloc[own[low] if len(own) else []].reset_index(drop=True)
    return found.assign(a=at[low], b=at[last] + length if len(own) else at[low])


def sorted_spans(docs: DataFrame, wanted: DataFrame, length: int, core: int) -> DataFrame:
    """``no_id, id, h, a, b`` of windows that several of the ``wanted`` pieces of a core share."""
    total = wanted.agg(F.sum(F.col("r") + length - core)).first()[0] or 0
    strings = max(1, -(-total // STRING_BYTES))
    texts = cut_out(docs, wanted.select(*PLACE, "r", "c", "key"), length, False)
    dealt = texts.withColumn("string", F.pmod(F.xxhash64("key"), F.lit(strings)))
    schema = "no_id boolean, id long, h long, a long, b long"
    return dealt.groupBy("string").applyInPandas(lambda rows: repeated_windows(rows, length, core), schema)


# --- documents --------------------------------------------------------------------------------------


def removed_spans(docs: DataFrame, length: int = LENGTH, gram: int | None = None) -> DataFrame:
    """``no_id, id, h, spans``: each document's removed runs ``(a, b)``, rising and apart, written."""
    gram = gram or max(1, min(GRAM, length // 4))
    shared = docs.sparkSession.sparkContext.broadcast(recurring(docs, length, gram))
    found = occurrences(docs, shared, length, gram)
    first = first_pieces(found)
    scratch = [found, first]
    several = first.groupBy("key").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    several = written(several, "several")
    spans = [later_spans(found, first, length)]
    few = several.filter(F.col("kinds") <= PIECES)
    wanted = written(first.join(broadcast_if_small(few), "key"), "wanted")
    scratch.append(wanted)
    spans.append(sorted_spans(docs, wanted, length, core_bytes(length, gram)))
    many = several.filter(F.col("kinds") > PIECES)
    if not many.isEmpty():
        # Each such core has over PIECES of the rows joined here, so hot ones are fewer still.
        held = many.agg(F.sum("kinds")).first()[0]
        hot = F.col("kinds") * HOT_SHARE > F.lit(held)
        wide = first.join(F.broadcast(many.filter(hot)), "key", "left_semi")
        wide = wide.unionByName(first.join(many.filter(~hot), "key", "left_semi"))
        windows = written(cut_out(docs, wide, length, True), "windows")
        scratch.append(windows)
        spans.append(later_spans(windows, first_pieces(windows), length))
    every = spans[0]
    for more in spans[1:]:
        every = every.unionByName(more)
    listed = every.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))
    out = written(listed.mapInArrow(_joined, listed.schema), "spans")
    forget(docs.sparkSession, scratch)
    return out


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's spans, which rise, with those that touch or overlap made one."""
    for batch in batches:
        spans = batch.column("spans")
        low, high = (spans.flatten().field(k).to_numpy() for k in (0, 1))
        sizes = spans.value_lengths().to_numpy()
        begins = np.cumsum(sizes) - sizes
        out_low, out_high, counts = [], [], []
        for begin, size in zip(begins.tolist(), sizes.tolist()):
            a, b = low[begin : begin + size], np.maximum.accumulate(high[begin : begin + size])
            new = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
            out_low.append(a[new])
            out_high.append(b[np.r_[new[1:], size] - 1])
            counts.append(len(new))
        ends = np.cumsum([0, *counts]).astype(np.int32)
        flat = [pa.array(np.concatenate(x or [low])) for x in (out_low, out_high)]
        joined = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(flat, names=["a", "b"]))
        columns = [*(batch.column(c) for c in DOC), joined]
        yield pa.RecordBatch.from_arrays(columns, names=[*DOC, "spans"])


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` of every row: removed runs ``(a, b)`` and the bytes that are left.

    A text counts as its UTF-8 bytes, a null one as empty. A byte goes where a string of ``length`` bytes
    covers it that also starts earlier: in a document with a smaller doc_id, or before in the same one.
    Strings never cross documents and are judged on the texts as they came. A null doc_id comes after all
    others; texts that share a doc_id, or have none, come in the order of their hashes. Rows that repeat
    both doc_id and text are one document: each is returned, with the same answer. What is left may begin
    or end within a character, so ``kept`` is binary. Texts shorter than ``length`` stay whole; an empty
    table gives no rows; other columns are not read.
    """
    spans = removed_spans(docs, length)
    text = text_or_empty().cast("binary").alias("text")
    rows = documents(docs, F.col("doc_id").alias("doc_id"), text).join(spans, DOC, "left")
    names = ["doc_id", "n_bytes", "spans", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, kept = [], []
            for value, cuts in zip(batch.column("text"), batch.column("spans")):
                whole = value.as_buffer()
                sizes.append(len(whole))
                at, parts = 0, []
                for cut in cuts.as_py() or ():
                    parts.append(whole[at : cut["a"]])
                    at = cut["b"]
                kept.append(b"".join([*parts, whole[at:]]))
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), batch.column("spans")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary())], names=names)

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_bytes long, spans array<struct<a: bigint, b: bigint>>, kept binary"
    return rows.select("doc_id", "text", "spans").mapInArrow(run, schema)
