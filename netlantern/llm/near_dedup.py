"""Near-duplicates by SimHash, checked and completed by the Jaccard similarity of five-word shingles.

Method: each set of shingles has a SimHash fingerprint, and fingerprints within a few bits are found by
the generalised pigeonhole of ``simhash_dedup``. Sets with such fingerprints are candidates; links are
those that are similar enough on the shingles of the whole texts. Similar sets may be further apart in
bits, so what fingerprints don't connect is found by prefix filtering, which misses no pair. Under any one
order of shingles, two sets of similarity 4/5 or more share a shingle among the first
``n - ceil(4n / 5) + 1`` of each, so sets meet only at those. The order is by a sketch of how many texts
hold a shingle, rarest first: a line in a third of all texts then counts only for texts made of little
else. Heads' shingles that no other head holds are left out by a map of bits.

Every candidate is verified on the shingles of the whole texts. Before these move, bitmaps of about a bit
a shingle leave out nearly all pairs that aren't similar: each bit says whether an odd number of a set's
shingles falls on it, so two sets differ in at least as many shingles as their bitmaps in bits. Pairs are
verified in lots, and what a lot has written and shuffled goes before the next one, so that disk follows
the input however many candidates there are.

A large group of near copies shares many shingles. So a shingle's sets are first verified against one
set drawn from them, a star instead of all pairs; pairs that are connected by then need no check. Stars
are repeated with other draws while they leave fewer pairs and many are left. What is left of a shingle of
at most ``BLOCK_SETS`` sets is verified pair by pair, each pair once whatever it shares, if the shingle can
be the first that both share. The sets of other shingles are compared in blocks, where only links that
connect something are passed on; shingles of much the same sets count as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlantern.llm.common import forget, give_back, row_hash, text_or_empty, written
from netlantern.llm.components import components
from netlantern.llm.fingerprint import CHUNK, SEED
from netlantern.llm.simhash_dedup import first_of_classes
from netlantern.llm.simhash_dedup import links as near_prints
from netlantern.plans.sizing import broadcast_if_small, is_small

WORDS = 5
#: Sets link at a similarity of OVER / UNDER or more.
OVER, UNDER = 4, 5
#: The sketch counts shingles by this many leading bits of their hashes.
SKETCH_BITS = 18
#: Tasks that add up the sketches of all others.
ADDERS = 16
#: Bits of the map of shingles that several heads hold. What it lets through by chance does no harm.
MAP_BITS = 27
#: Stars are repeated while more pairs than this for each set at a shingle are left.
PAIRS_LEFT = 20
ROUNDS = 6
#: Pairs of one set that a task gets at once.
AT_ONCE = 500
#: Keys with more than one in so many of the rows are split or looked up apart; there are fewer of them.
HOT_SHARE = 4096
#: Sets, and shingles of them, that a block holds.
BLOCK_SETS, BLOCK_SHINGLES = 256, 1 << 19
#: Rows handed over at once.
ROWS_OUT = 1000
#: Bits of a bitmap at most.
PARITY_BITS = 1 << 16
#: Bytes that a lot of pairs carries, and pairs that shingles give in a lot before repeated ones go.
LOT_BYTES, LOT_PAIRS = 1 << 28, 1 << 26
#: A lot carries up to one in so many of all shingles where that is more.
LOT_SHARE = 4


def shingles(text: bytes | str | None, words: int = WORDS) -> np.ndarray:
    """The hashes of a whole text's different shingles, rising; words are those of ``simhash``."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    found = raw.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    n = max(1, len(found) - words + 1)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    last = (ends[words - 1 :] if len(found) >= words else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = (digest(joined[a:b], SEED) for a, b in zip(starts, last))
    return np.unique(np.fromiter(hashes, np.uint64, n))


def set_print(found: np.ndarray) -> int:
    """SimHash of a set of shingles, unsigned: bits set in over half of their hashes; 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), CHUNK):
        part = found[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(found), bitorder="little").tobytes(), "little")


def parities(found: np.ndarray, size: int | None = None) -> np.ndarray:
    """A bitmap of a set's shingles, as words: where an odd number of them falls.

    It has a power of two of bits, 64 at least, and about as many as there are shingles.
    """
    size = size or min(PARITY_BITS, max(64, 1 << (len(found) - 1).bit_length()))
    odd = np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def apart(some: pa.Array, others: pa.Array) -> np.ndarray:
    """In how many bits the bitmaps of each pair differ, at the size of the smaller one."""
    sizes = np.stack([pc.binary_length(x).to_numpy() for x in (some, others)])
    out = np.zeros(len(some), np.int64)
    for pair in np.unique(sizes, axis=1).T:
        at = np.flatnonzero((sizes == pair[:, None]).all(axis=0))
        folded = []
        for side in (some, others):
            words = np.frombuffer(b"".join(side.take(pa.array(at)).to_pylist()), np.uint64)
            folded.append(np.bitwise_xor.reduce(words.reshape(len(at), -1, pair.min() // 8), axis=1))
        out[at] = np.bitwise_count(folded[0] ^ folded[1]).sum(axis=1, dtype=np.int64)
    return out


def may_link(far: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether sets of ``sizes`` shingles, both together, can link if no fewer than ``far`` are of one alone."""
    return far * (OVER + UNDER) <= sizes * (UNDER - OVER)


def _buckets(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def shingle_order(docs: DataFrame) -> np.ndarray:
    """A rank for each bucket of hashes, by how many more texts than the mean hold its shingles."""
    size = 1 << SKETCH_BITS

    def one(held: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], names=["held"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.uint32)
        for batch in batches:
            for value in batch.column(0):
                at, n = np.unique(_buckets(shingles(value.as_buffer().to_pybytes())), return_counts=True)
                held[at] += n.astype(np.uint32)
        yield one(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.uint64)
        for batch in batches:
            for value in batch.column(0):
                part = value.as_buffer()
                held += np.frombuffer(part, np.uint32 if len(part) == 4 * size else np.uint64)
        yield one(held)

    texts = docs.select(text_or_empty().cast("binary").alias("text"))
    parts = texts.mapInArrow(count, "held binary").repartition(ADDERS).mapInArrow(add, "held binary")
    total = np.zeros(size, np.uint64)
    for row in parts.toArrow()["held"]:  # one for each adder
        total += np.frombuffer(row.as_buffer(), np.uint64)
    mean = max(1.0, float(total.sum()) / size)
    ranks = np.zeros(size, np.uint8)
    often = total > 1.25 * mean
    ranks[often] = np.minimum(1 + 4 * np.log2(total[often] / mean), 255).astype(np.uint8)
    return ranks


def prefixed(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """``doc_id, h, fp, n, head, print, bits`` of every row, as a written table.

    ``fp`` stands for the set of shingles, ``n`` is its size, ``head`` its first shingles, ``print`` its
    SimHash and ``bits`` its bitmap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(low, ROWS_OUT)
                names, sizes, heads, prints, bits = [], [], [], [], []
                for value in batch.column("text"):
                    found = shingles(value.as_buffer().to_pybytes())
                    n = len(found)
                    most = n - -(-OVER * n // UNDER) + 1
                    heads.append(found[np.lexsort((found, ranks[_buckets(found)]))[:most]])
                    names.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                    prints.append(set_print(found))
                    bits.append(parities(found).tobytes())
                    sizes.append(n)
                columns = [
                    batch.column("doc_id"),
                    batch.column("h"),
                    pa.array(np.array(names, np.uint64).view(np.int64)),
                    pa.array(sizes, pa.int64()),
                    _lists(heads),
                    pa.array(np.array(prints, np.uint64).view(np.int64)),
                    pa.array(bits, pa.binary()),
                ]
                names = ["doc_id", "h", "fp", "n", "head", "print", "bits"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select("doc_id", row_hash().alias("h"), text_or_empty().cast("binary").alias("text"))
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    schema = f"doc_id {kind}, h long, fp long, n long, head array<long>, print long, bits binary"
    return written(rows.mapInArrow(run, schema), "prefixes")


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    flat = np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def shared_heads(rows: DataFrame) -> DataFrame:
    """``fp, n, bits, head, places`` of the sets with a shingle that several heads hold, written.

    ``head`` is what of it other heads may hold, ``places`` are those of its shingles in the whole head.
    """
    keys = rows.select(F.explode("head").alias("k")).groupBy("k").agg(F.count("*").alias("held"))
    at = F.shiftrightunsigned("k", 64 - MAP_BITS)
    words = keys.filter("held > 1").select(at.alias("at"))
    words = words.groupBy((F.col("at") / 64).cast("long").alias("w"))
    bit = F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("bits")
    found = words.agg(bit).toArrow()  # at most 2 ** MAP_BITS bits
    bits = np.zeros(1 << (MAP_BITS - 6), np.int64)
    bits[found["w"].to_numpy()] = found["bits"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            heads = batch.column("head")
            keys = heads.flatten().to_numpy()
            lengths = heads.value_lengths().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), lengths)
            place = np.arange(len(keys)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            at = (keys.view(np.uint64) >> np.uint64(64 - MAP_BITS)).astype(np.int64)
            some = np.flatnonzero((bits[at >> 6] >> (at & 63)) & 1)
            left, sizes = np.unique(row[some], return_counts=True)
            ends = pa.array(np.cumsum([0, *sizes]).astype(np.int32))
            columns = [batch.column(c).take(pa.array(left)) for c in ("fp", "n", "bits")]
            for values in (keys, place.astype(np.int32)):
                columns.append(pa.ListArray.from_arrays(ends, pa.array(values[some])))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["fp", "n", "bits", "head", "places"]
    schema = "fp long, n long, bits binary, head array<long>, places array<int>"
    heads = rows.select("fp", "n", "head", "bits").mapInArrow(run, schema)
    same = written(heads.groupBy("fp").agg(*(F.first(c).alias(c) for c in names[1:])), "sets")
    shared.destroy()
    forget(rows.sparkSession, [])
    return same


# --- verifying ---------------------------------------------------------------------------------


def alike(n: str, m: str) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(n, m) * UNDER >= F.greatest(n, m) * OVER


def _many(pairs: DataFrame, side: str) -> DataFrame:
    """The sets in a large share of the pairs, written, and how many parts their pairs go to."""
    counts = pairs.groupBy(side).agg(F.count("*").alias("_n"))
    hot = (F.col("_n") > AT_ONCE) & (F.col("_n") * HOT_SHARE > pairs.count())
    many = counts.filter(hot).select(side, F.ceil(F.col("_n") / AT_ONCE).cast("int").alias("_parts"))
    return written(many, "many")


def _with_facts(pairs: DataFrame, facts: DataFrame, side: str, many: DataFrame) -> DataFrame:
    """``pairs`` with the facts of one side. A set in a large share of them goes to several tasks."""
    many = F.broadcast(many)
    parts = F.coalesce("_parts", F.lit(1))
    own = facts.select(F.col("fp").alias(side), F.struct(*facts.columns[1:]).alias(f"{side}s"))
    own = own.join(many, side, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), parts - 1))
    )
    dealt = pairs.join(many, side, "left").withColumn(
        "_part", F.pmod(F.xxhash64("a", "b"), parts).cast("int")
    )
    return dealt.drop("_parts").join(own.drop("_parts"), [side, "_part"]).drop("_part")


def _with_both(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    many = {side: _many(pairs, side) for side in ("a", "b")}
    return _with_facts(_with_facts(pairs, facts, "a", many["a"]), facts, "b", many["b"])


def lots(rows: DataFrame, size: float, most: float, *by: str) -> Iterator[DataFrame]:
    """``rows`` in as many parts as it takes to have no more than about ``most`` of ``size`` in one.

    Before the next part what was shuffled for the one before goes.
    """
    n = max(1, int(-(-size // most)))
    for k in range(n):
        if k:
            forget(rows.sparkSession, [])
        yield rows if n == 1 else rows.filter(F.pmod(F.xxhash64(F.lit("lot"), *by), F.lit(n)) == k)


def lot_bytes(rows: DataFrame) -> float:
    """What a lot may carry, by the shingles of all ``rows``."""
    return max(LOT_BYTES, 8 * (rows.agg(F.sum("n")).first()[0] or 0) / LOT_SHARE)


def promising(sets: DataFrame, pairs: DataFrame, most: float) -> DataFrame:
    """Those of the written ``pairs(a, b)`` that can be similar enough, written, with the sum ``n`` of sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = apart(batch.column("x"), batch.column("y"))
            some = np.flatnonzero(may_link(far, batch.column("n").to_numpy()))
            yield batch.select(["a", "b", "n"]).take(pa.array(some))

    each = sets.agg(F.avg(F.length("bits"))).first()[0] or 0
    found = []
    for lot in lots(pairs, pairs.count() * (each + 16), most, "a", "b"):
        both = _with_both(lot, sets.select("fp", "n", "bits"))
        n = (F.col("as.n") + F.col("bs.n")).alias("n")
        both = both.select("a", "b", n, F.col("as.bits").alias("x"), F.col("bs.bits").alias("y"))
        found.append(written(both.mapInArrow(run, "a long, b long, n long"), "promising"))
    if len(found) == 1:
        return found[0]
    whole = written(reduce(DataFrame.unionByName, found), "promising")
    forget(sets.sparkSession, found)
    return whole


def members(docs: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``fp, every``: all shingles of the sets named by the written, distinct ``wanted(fp)``, written."""
    named = rows.select("doc_id", "h", "fp").join(broadcast_if_small(wanted), "fp")
    named = named.groupBy("fp", "doc_id", "h").agg(F.count("*").alias("copies"))
    one = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "h", "copies")).alias("one")
    named = named.groupBy("fp").agg(one)
    named = written(named.select("fp", F.col("one.doc_id").alias("id"), "one.h", "one.copies"), "wanted")
    texts = docs.select("doc_id", text_or_empty().cast("binary").alias("t"), row_hash().alias("own"))
    where = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("h"))
    texts = texts.join(broadcast_if_small(named), where).select("fp", "t")
    if not named.filter("copies > 1").isEmpty():
        texts = texts.dropDuplicates(["fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(low, ROWS_OUT)
                found = [shingles(v.as_buffer().to_pybytes()) for v in batch.column("t")]
                yield pa.RecordBatch.from_arrays([batch.column("fp"), _lists(found)], names=["fp", "every"])

    found = written(texts.mapInArrow(run, "fp long, every array<long>"), "members")
    forget(docs.sparkSession, [named])
    return found


def verified(docs: DataFrame, rows: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the written ``pairs(a, b)`` whose sets are similar enough, as a written table."""
    spark, most = docs.sparkSession, lot_bytes(rows)
    near = promising(sets, pairs, most)
    whole = near.agg(F.sum("n")).first()[0]
    if not whole:
        return near.select("a", "b")
    found = []
    for lot in lots(near, 8 * whole, most, "a", "b"):
        lot = lot.select("a", "b")
        wanted = written(lot.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "wanted")
        every = members(docs, rows, wanted)
        both = _with_both(lot, every)
        common = F.size(F.array_intersect("as.every", "bs.every"))
        sizes = F.size(F.col("as.every")) + F.size(F.col("bs.every"))
        links = both.filter(common * (OVER + UNDER) >= sizes * OVER).select("a", "b")
        found.append(written(links, "verified"))
        forget(spark, [wanted, every])
    if len(found) == 1:
        forget(spark, [near])
        return found[0]
    whole = written(reduce(DataFrame.unionByName, found), "verified")
    forget(spark, [near, *found])
    return whole


# --- what stars leave ---------------------------------------------------------------------------


def size_class() -> Column:
    """Sets of similar sizes are in one class or in two that follow one another."""
    return F.floor(F.log("n") / F.log(F.lit(UNDER / OVER)))


def compared(rows: pd.DataFrame) -> pd.DataFrame:
    """``a, b``: links that connect the sets of two blocks as all pairs similar enough do.

    ``rows`` has ``fp, c, side, every``; a set of both sides stands for a block compared with itself.
    """
    rows = rows.drop_duplicates(["fp", "side"])
    first, second = (rows[rows["side"] != k].drop_duplicates("fp") for k in (1, 0))
    root = {c: c for c in rows["c"]}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    links = []
    both = set(rows["fp"][rows["side"] == 2])
    ones = list(zip(first["fp"], first["c"], first["every"]))
    others = list(zip(second["fp"], second["c"], second["every"]))
    most = max(map(len, rows["every"]))
    size = min(PARITY_BITS, max(64, 1 << (most - 1).bit_length()))
    sizes = np.array([len(y) for _, _, y in others], np.int64)
    bits = np.array([parities(y.view(np.uint64), size) for _, _, y in others])
    for a, ca, x in ones if others else ():
        far = np.bitwise_count(bits ^ parities(x.view(np.uint64), size)).sum(axis=1, dtype=np.int64)
        for at in np.flatnonzero(may_link(far, sizes + len(x))).tolist():
            b, cb, y = others[at]
            n, m = len(x), len(y)
            if (a >= b and a in both) or min(n, m) * UNDER < max(n, m) * OVER or top(ca) == top(cb):
                continue
            common = len(np.intersect1d(x, y, assume_unique=True))
            if common * (OVER + UNDER) >= (n + m) * OVER:
                links.append((min(a, b), max(a, b)))
                root[top(ca)] = top(cb)
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def _one_of_same(shared: DataFrame) -> DataFrame:
    """``k, fp, n, c`` with one key for shingles whose sets, taken together, make fewer pairs than one by one.

    Near copies share many shingles. Shingles with a set in common are taken together, directly or by others.
    """
    held = written(shared.groupBy("k").agg(F.min("fp").alias("first"), F.count("*").alias("m")), "held")
    ends = _join_counted(shared.select("k", "fp"), held, ["k"])
    ends = ends.select(F.col("fp").alias("a"), F.col("first").alias("b"))
    bags = written(components(ends).select(F.col("node").alias("fp"), F.col("component").alias("bag")), "bags")
    one_by_one = held.join(bags.withColumnRenamed("fp", "first"), "first")
    one_by_one = one_by_one.groupBy("bag").agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("pairs"))
    together = bags.groupBy("bag").agg(F.count("*").cast("double").alias("m"))
    better = written(together.join(one_by_one, "bag").filter("m * m <= pairs").select("bag", "m"), "better")
    sets = shared.join(bags, "fp")
    sets = sets.join(broadcast_if_small(better), "bag", "left")
    key = F.when(F.isnotnull("m"), F.xxhash64(F.lit(0), "bag")).otherwise(F.xxhash64(F.lit(1), "k"))
    found = written(sets.select(key.alias("k"), "fp", "n", "c").distinct(), "together")
    forget(shared.sparkSession, [held, bags, better])
    return found


def in_blocks(docs: DataFrame, rows: DataFrame, shared: DataFrame) -> DataFrame:
    """``a, b``: links of the written ``shared(k, fp, n, c)`` between different components ``c``.

    A shingle's sets of a size class are cut into blocks of bounded size, and blocks of one class or of
    neighbouring ones meet.
    """
    spark = docs.sparkSession
    shared = _one_of_same(shared)
    sized = shared.withColumn("s", size_class())
    room = F.least(F.lit(BLOCK_SETS), F.ceil(BLOCK_SHINGLES / F.pow(F.lit(UNDER / OVER), F.col("s") + 1)))
    held = sized.groupBy("k", "s").agg(F.count("*").alias("m"))
    held = written(held.withColumn("blocks", F.ceil(F.col("m") / room).cast("int")), "blocks")
    block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    one = held.select("k", F.col("s").alias("s1"), block.alias("b1"))
    two = held.withColumn("s1", F.explode(F.array(F.col("s"), F.col("s") + 1)))
    two = two.select("k", "s1", F.col("s").alias("s2"), block.alias("b2"))
    meets = one.join(two, ["k", "s1"]).filter("s2 < s1 OR b1 <= b2")
    meets = written(meets.withColumn("meet", F.monotonically_increasing_id()), "meets")
    sides = meets.select("k", F.col("s1").alias("s"), F.col("b1").alias("b"), "meet", F.lit(0).alias("side"))
    same = (F.col("s1") == F.col("s2")) & (F.col("b1") == F.col("b2"))
    side = F.when(same, 2).otherwise(1)
    other = meets.select("k", F.col("s2").alias("s"), F.col("b2").alias("b"), "meet", side.alias("side"))
    sides = sides.join(meets.filter(same).select("meet"), "meet", "left_anti").unionByName(other)
    counts = held.withColumn("b", block).select("k", "s", "b", "blocks")
    # A block holds a bounded number of sets, so joins by block have no large keys.
    dealt = sized.join(held.select("k", "s", "blocks"), ["k", "s"])
    dealt = dealt.withColumn("b", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = dealt.join(counts.select("k", "s", "b"), ["k", "s", "b"]).join(sides, ["k", "s", "b"])
    dealt = written(dealt.select("meet", "side", "fp", "n", "c"), "dealt")
    wanted = written(shared.select("fp").distinct(), "wanted")
    every = members(docs, rows, wanted)
    found = []
    for lot in lots(dealt, 8 * (dealt.agg(F.sum("n")).first()[0] or 0), lot_bytes(rows), "meet"):
        met = lot.select("meet", "side", "fp", "c").join(every, "fp")
        links = met.groupBy("meet").applyInPandas(lambda g: compared(g), "a long, b long")
        found.append(written(links, "blocks"))
    whole = written(reduce(DataFrame.unionByName, found).distinct(), "blocks")
    forget(spark, [wanted, every, dealt, shared, *found])
    return whole


# --- documents ---------------------------------------------------------------------------------


def _in_components(shared: DataFrame, links: DataFrame) -> DataFrame:
    """``shared`` with ``c``, the component so far, where a shingle's sets are in several; written."""
    near = components(links).withColumnRenamed("node", "fp")
    joined = shared.join(broadcast_if_small(near), "fp", "left")
    columns = ["k", "fp", "n", "place", F.coalesce("component", "fp").alias("c")]
    named = written(joined.select(*columns), "shared")
    split = named.groupBy("k").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("*").alias("m"))
    split = written(split.filter("x <> y").select("k", "m"), "split")
    found = written(_join_counted(named, split, ["k"]), "shared")
    forget(shared.sparkSession, [named, split])
    return found


def _join_counted(rows: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """Rows joined with a written table that has ``m``, the number of rows of each key.

    Keys with a large share of the rows, which are few, are looked up from a broadcast of those.
    """
    if is_small(table):
        return rows.join(F.broadcast(table.drop("m")), by)
    total = table.agg(F.sum("m")).first()[0]
    hot = F.col("m") * HOT_SHARE > F.lit(total)
    parts = [table.filter(hot), table.filter(~hot)]
    parts = [F.broadcast(parts[0].drop("m")), parts[1].drop("m")]
    return rows.join(parts[0], by).unionByName(rows.join(parts[1], by))


def print_links(docs: DataFrame, rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: links between sets whose fingerprints differ in few bits and that are similar enough.

    The sets of one fingerprint meet the first of them, and the first ones of near fingerprints meet, so
    candidates grow with the fingerprints, however many sets share one.
    """
    named = rows.select("fp", "print").distinct()
    firsts = written(named.groupBy("print").agg(F.min("fp").alias("first")), "prints")
    same = named.join(firsts, "print").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    near = near_prints(firsts.select(F.col("print").alias("fp")))
    for end in ("a", "b"):
        own = firsts.select(F.col("print").alias(end), F.col("first").alias(f"first_{end}"))
        near = near.join(own, end)
    near = near.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
    pairs = written(same.filter("a < b").unionByName(near).distinct(), "near")
    forget(docs.sparkSession, [firsts])
    links = verified(docs, rows, sets, pairs)
    forget(docs.sparkSession, [pairs])
    return links


def similar_links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``a, b``: links that connect all sets of ``rows`` that pairs similar enough connect.

    Those of near fingerprints come first; stars and pairs are of what these leave apart.
    """
    spark, sets = docs.sparkSession, shared_heads(rows)
    zipped = sets.select(F.explode(F.arrays_zip("head", "places")).alias("at"), "fp", "n")
    shared = zipped.select(F.col("at.head").alias("k"), "fp", "n", F.col("at.places").alias("place"))
    links = written(print_links(docs, rows, sets).select("a", "b"), "links")
    shared, made = shared.withColumn("c", F.col("fp")), []
    if not links.isEmpty():
        shared = _in_components(shared.drop("c"), links)
        made = [shared]
    before = float("inf")
    for turn in range(ROUNDS):
        size = size_class()
        # A set also meets the centre of the class below its own.
        draw = F.min(F.struct(F.xxhash64(F.lit(turn), "fp"), "fp", "n", "c")).alias("centre")
        centres = shared.groupBy("k", size.alias("size")).agg(draw, F.count("*").alias("m"))
        centres = written(centres, "centres")
        met = shared.withColumn("size", F.explode(F.array(size, size - 1)))
        met = _join_counted(met, centres, ["k", "size"])
        met = met.filter((F.col("c") != F.col("centre.c")) & alike("n", "centre.n"))
        a, b = F.least("fp", "centre.fp").alias("a"), F.greatest("fp", "centre.fp").alias("b")
        stars = written(met.select(a, b).distinct(), "stars")
        forget(spark, [centres])
        if not stars.isEmpty():
            links = written(links.unionByName(verified(docs, rows, sets, stars)), "links")
        shared = _in_components(shared.drop("c"), links)
        forget(spark, [*made, stars])
        made = [shared]
        own = shared.groupBy("k", "c").agg(F.count("*").alias("n"))
        left = own.groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
        unmet = (F.col("n").cast("double") * F.col("n") - F.col("own")) / 2
        left = left.agg(F.sum(unmet).alias("p"), F.sum("n").alias("n")).first()
        if not left.n:
            forget(spark, [*made, sets])
            return links
        if left.p <= PAIRS_LEFT * left.n or left.p >= 0.9 * before:
            break
        before = left.p
    held = written(shared.groupBy("k").agg(F.count("*").alias("m")), "held")
    rest = _in_pairs(shared, held.filter(F.col("m") <= BLOCK_SETS))
    if not rest.isEmpty():
        links = written(links.unionByName(verified(docs, rows, sets, rest)), "links")
    forget(spark, [rest])
    large = held.filter(F.col("m") > BLOCK_SETS)
    if large.isEmpty():
        forget(spark, [*made, sets])
        return links
    large = written(_join_counted(shared, large, ["k"]).drop("place"), "large")
    forget(spark, [*made, sets])
    found = in_blocks(docs, rows, large)
    forget(spark, [large])
    return links.unionByName(found)


def _in_pairs(shared: DataFrame, held: DataFrame) -> DataFrame:
    """``a, b``: pairs of sets in different components, each once, that share a shingle of ``held(k, m)``.

    A pair comes from a shingle only if that may be the first both share, with enough left behind it.
    """
    found = []
    pairs = held.agg(F.sum(F.col("m").cast("double") * F.col("m") / 2)).first()[0] or 0
    after = F.col("n") - F.col("place")
    for lot in lots(shared.join(broadcast_if_small(held.drop("m")), "k"), pairs, LOT_PAIRS, "k"):
        one, two = (
            lot.select("k", *(F.col(x).alias(y + x) for x in ("fp", "n", "c")), after.alias(f"{y}left")) for y in "ab"
        )
        enough = F.least("aleft", "bleft") * (OVER + UNDER) >= (F.col("an") + F.col("bn")) * OVER
        rest = one.join(two, "k").filter("afp < bfp AND ac <> bc").filter(alike("an", "bn") & enough)
        found.append(written(rest.select(F.col("afp").alias("a"), F.col("bfp").alias("b")).distinct(), "rest"))
    if len(found) == 1:
        return found[0]
    whole = written(reduce(DataFrame.unionByName, found).distinct(), "rest")
    forget(shared.sparkSession, found)
    return whole


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, one of each class: the one with the smallest doc_id.

    A class is what pairs of texts connect whose sets of five-word shingles have a Jaccard similarity of
    4/5 or more; a text of fewer words is one shingle, and texts without a word, null ones included, are
    equal. All columns stay as they are, whatever their names. Rows without a doc_id come last; of rows that
    share that doc_id one text is kept, and of rows repeated in full any one. An empty table gives no rows.
    """
    rows = prefixed(docs, shingle_order(docs))
    near = components(similar_links(docs, rows)).select(
        F.col("node").alias("fp"), F.col("component").alias("root")
    )
    named = rows.select("fp").distinct().join(near, "fp", "left")
    named = written(named.select("fp", F.coalesce("root", "fp").alias("root")), "classes")
    kept = first_of_classes(docs, rows, named)
    forget(docs.sparkSession, [rows, named])
    return kept
