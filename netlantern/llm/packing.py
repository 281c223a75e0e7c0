"""Packing documents into as few token sequences of bounded length as it can.

Pieces are dealt at random into groups of bounded size, and each group is packed by itself: best fit
on falling lengths gives an incumbent, then bin completion looks for fewer sequences. A node fills the
sequence of the largest piece left; its branches are the undominated fillings of any number of pieces,
fullest first; it is cut off when its waste already exceeds what one sequence fewer would allow. A group
meets its lower bound almost always at once; where it doesn't, the search ends after ``NODES`` steps and
the incumbent stands, so the result is whole in any case. Groups cost at most one sequence each.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlantern.llm.byte_bpe import slices
from netlantern.llm.common import give_back, text_or_empty, written
from netlantern.llm.word_bpe import CACHED, word_codec

CAPACITY = 4096
GROUP = 8192
NODES = 250_000
END_ID = 1
#: Bytes of texts whose different chunks are looked up together.
TOGETHER = 1 << 22


# --- one group ---------------------------------------------------------------------------------


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices by sequence: falling lengths, each into the fullest sequence that has room."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    rooms: list[tuple[int, int]] = []
    out: list[list[int]] = []
    for i in order:
        at = bisect_left(rooms, (lengths[i], -1))
        if at < len(rooms):
            room, s = rooms.pop(at)
            out[s].append(i)
        else:
            room, s = capacity, len(out)
            out.append([i])
        if room > lengths[i]:
            insort(rooms, (room - lengths[i], s))
    return out


def lower_bound(lengths: list[int], capacity: int) -> int:
    """Martello and Toth's L2: pieces over half a sequence can't meet, and what lies beside them is full.

    For each least length counted, large pieces have a sequence each, and the others of that length or
    more need what room is left there and sequences of their own.
    """
    rising = sorted(lengths)
    sums = [0]
    for n in rising:
        sums.append(sums[-1] + n)
    half = bisect_right(rising, capacity // 2)
    best = 0
    for least in {0, *(n for n in rising[:half])}:
        alone = bisect_right(rising, capacity - least)  # longer ones leave no room for the least
        small = bisect_left(rising, least)
        large = len(rising) - half
        room = (alone - half) * capacity - (sums[alone] - sums[half]) if alone > half else 0
        rest = sums[half] - sums[small] - room
        best = max(best, large + max(0, -(-rest // capacity)))
    return best


def dominated(filling: tuple[int, ...], room: int, kinds: list[int], left: Counter) -> bool:
    """Whether a piece left out could stand in for part of the filling and waste less.

    Such a filling needn't be tried: swapping the two gives a packing no worse. ``left`` counts the
    lengths ``kinds`` that there are beside the largest piece.
    """
    slack = room - sum(filling)
    if not slack:
        return False
    parts = 1  # bit s: some part of the filling has the sum s
    for n in filling:
        parts |= parts << n
    window = (1 << slack) - 1
    for n in kinds:
        near = parts >> (n - slack) if n > slack else parts << (slack - n)
        if near & window and left[n] > filling.count(n):
            return True
    return False


def fillings(
    largest: int, left: Counter, capacity: int, waste: int, budget: list[int]
) -> Iterator[tuple[int, ...]]:
    """Undominated fillings beside the largest piece that waste at most ``waste``, the fullest first and
    of equal ones those with the longest pieces.

    ``left`` counts the lengths of the other pieces; any number of them may make a filling. Sums that the
    shortest lengths can have are bits of whole numbers, so no step is taken that leads to none. Steps are
    taken from ``budget[0]``, and none come when that is used up.
    """
    room = capacity - largest
    kinds = sorted(n for n, c in left.items() if c > 0 and n <= room)
    whole = (1 << (room + 1)) - 1
    sums = [1]
    for n in kinds:
        bits, some, size = sums[-1], min(left[n], room // n), 1
        while some > 0:
            size = min(size, some)
            bits |= (bits << (n * size)) & whole
            some -= size
            size *= 2
        sums.append(bits)
    budget[0] -= 1 + len(kinds) // 16

    def grow(total: int, upto: int) -> Iterator[tuple[int, ...]]:
        if not total:
            yield ()
            return
        # The longest length of the filling, then how many of it.
        for i in range(min(upto, bisect_right(kinds, total)), 0, -1):
            if budget[0] <= 0 or not (sums[i] >> total) & 1:
                return
            n = kinds[i - 1]
            for some in range(min(left[n], total // n), 0, -1):
                if (sums[i - 1] >> (total - some * n)) & 1:
                    budget[0] -= 1
                    for rest in grow(total - some * n, i - 1):
                        yield (n,) * some + rest

    for total in range(room, max(room - waste, 0) - 1, -1):
        if (sums[-1] >> total) & 1:
            for filling in grow(total, len(kinds)):
                budget[0] -= len(kinds) // 16 if total < room else 0
                if not dominated(filling, room, kinds, left):
                    yield filling
        if budget[0] <= 0:
            return


def fewest(lengths: list[int], capacity: int = CAPACITY, nodes: int = NODES) -> list[list[int]]:
    """Indices by sequence, in as few sequences as found; no length exceeds the capacity."""
    incumbent = best_fit(lengths, capacity)
    whole = sum(lengths)
    bound = -(-whole // capacity)
    if len(incumbent) <= max(bound, sum(2 * n > capacity for n in lengths)):
        return incumbent
    bound = max(bound, lower_bound(lengths, capacity))
    budget = [nodes]
    while len(incumbent) > bound and budget[0] > 0:
        # Ask for one fewer: all of its waste is then spread over that many sequences.
        target = len(incumbent) - 1
        best = _complete(lengths, capacity, target, target * capacity - whole, budget)
        if best is None:
            break
        places: dict[int, list[int]] = {}
        for i, n in enumerate(lengths):
            places.setdefault(n, []).append(i)
        incumbent = [[places[n].pop() for n in lot] for lot in best]
    return incumbent


def _complete(
    lengths: list[int], capacity: int, target: int, spare: int, budget: list[int]
) -> list[tuple[int, ...]] | None:
    """At most ``target`` sequences, or None: depth first over fillings of the largest piece left.

    A branch ends where the waste left for it isn't enough, and at the last sequence allowed.
    """
    left, many = Counter(lengths), len(lengths)
    rising = sorted(lengths)
    stack: list[tuple] = []
    lots: list[tuple[int, ...]] = []

    def open_node(at: int, spare: int) -> None:
        """``at``: pieces from there on are used up or none is left of their length."""
        while not left[rising[at]]:
            at -= 1
        largest = rising[at]
        left[largest] -= 1
        stack.append((at, largest, spare, fillings(largest, left, capacity, spare, budget)))

    open_node(len(rising) - 1, spare)
    while stack:
        if len(lots) == len(stack):  # back from a branch
            left.update(lots[-1][1:])
            many += len(lots.pop())
        at, largest, spare, branches = stack[-1]
        filling = next(branches, None) if budget[0] > 0 else None
        if filling is None:
            if budget[0] <= 0:
                return None
            stack.pop()
            left[largest] += 1
            continue
        left.subtract(filling)
        lots.append((largest, *filling))
        many -= len(lots[-1])
        if not many:
            return lots
        if len(lots) < target:
            open_node(at, spare - (capacity - largest - sum(filling)))
    return None


# --- documents ---------------------------------------------------------------------------------


def token_pieces(
    docs: DataFrame,
    vocabulary_path: str,
    capacity: int = CAPACITY,
    keep_ids: bool = False,
    cached: int = CACHED,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every piece of every row."""
    end = np.array([END_ID], "<u4").tobytes()
    fields = [
        docs.schema["doc_id"],
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        *([T.StructField("ids", T.BinaryType())] if keep_ids else []),
    ]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        known = word_codec(vocabulary_path, cached)
        for batch in batches:
            for low, texts in slices(batch.column(1), TOGETHER):
                rows = [
                    (i, at // (4 * capacity), ids[at : at + 4 * capacity])
                    for i, found in enumerate(known.encode_all(texts), low)
                    for ids in [found + end]
                    for at in range(0, len(ids), 4 * capacity)
                ]
                piece = np.array([r[1] for r in rows], np.int64)
                columns = [
                    batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                    pa.array(piece.astype(np.int32)),
                    pa.array(piece * capacity),
                    pa.array([len(r[2]) // 4 for r in rows], pa.int64()),
                    pa.array([zlib.crc32(r[2]) for r in rows], pa.int64()),
                    *([pa.array([r[2] for r in rows], pa.binary())] if keep_ids else []),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return rows.mapInArrow(run, T.StructType(fields))


def pack(
    docs: DataFrame,
    vocabulary_path: str,
    capacity: int = CAPACITY,
    keep_ids: bool = False,
    group: int = GROUP,
    nodes: int = NODES,
    cached: int = CACHED,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``) of every piece.

    A row's ids are those of its text, then the end id; only longer ones are cut, into pieces of
    ``capacity`` ids, the last perhaps shorter. A null or empty text is the end id alone. Every row is
    packed, repeated ones too, each by itself; an empty table gives no rows; other columns are not
    read. Pieces are dealt into groups by their place in the written table, whatever their keys, so no
    key makes a group large. A worker's cache holds about ``cached`` entries in each of its two generations:
    more take memory, fewer take time.
    """
    pieces = written(token_pieces(docs, vocabulary_path, capacity, keep_ids, cached), "pieces")
    columns = pieces.columns
    groups = max(1, -(-pieces.count() // group))
    placed = pieces.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), "length"
    ).withColumn("lot", F.pmod(F.xxhash64("file", "row"), F.lit(groups)))

    def solve(lot: pd.DataFrame) -> pd.DataFrame:
        lot = lot.sort_values(["file", "row"], ignore_index=True)
        lengths = lot["length"].to_numpy()
        number, offset = np.zeros(len(lot), np.int64), np.zeros(len(lot), np.int64)
        for s, indices in enumerate(fewest(lengths.tolist(), capacity, nodes)):
            number[indices] = s
            offset[indices] = np.cumsum(lengths[indices]) - lengths[indices]
        ids = (lot["lot"].to_numpy() << 24) + number
        return pd.DataFrame(
            {"file": lot["file"], "row": lot["row"], "sequence_id": ids, "offset": offset}
        )

    solved = placed.groupBy("lot").applyInPandas(
        solve, "file string, row long, sequence_id long, offset long"
    )
    rows = pieces.select(
        *columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    )
    return rows.join(solved, ["file", "row"]).select(*columns, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the ids of each sequence, from :func:`pack` with ``keep_ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.unhex(F.lit("")), lambda all_, p: F.concat(all_, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
