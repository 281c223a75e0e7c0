"""Exact dedup and sharding against plain Python."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from netlantern.llm import exact_dedup, sharding
from tests.llm.conftest import EXTRA, ODD

WHITE = str.maketrans("", "", " \t\n\x0b\x0c\r")


def bare(text):
    return (text or "").translate(WHITE)


def winner(rows):
    """(points, id) order: most code points, then smallest id, none last."""
    return min(rows, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))


def test_exact_groups(docs_of):
    got = exact_dedup.exact_groups(docs_of(ODD)).collect()
    assert len(got) == len(ODD)
    groups = defaultdict(list)
    for r in ODD:
        groups[bare(r[1])].append(r)
    want = Counter()
    for i, t in ODD:
        group = groups[bare(t)]
        best = winner(group)
        kept = best[0] == i and best[1] == t
        sha = hashlib.sha256(bare(t).encode()).hexdigest()
        want[i, best[0], len(group), kept, sha] += 1
    # Null and empty texts are the same document to the operator only if the text is the same.
    assert Counter(tuple(r) for r in got) == want


def test_frequent_digests_take_the_same_answer(llm, docs_of):
    rows = [(i, "hot") for i in range(400)] + [(1000 + i, f"t{i % 150}") for i in range(300)]
    docs = docs_of(rows)
    hot = exact_dedup.frequent(exact_dedup.digested(docs)).collect()
    assert [bytes(r.digest).hex() for r in hot] == [hashlib.sha256(b"hot").hexdigest()]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect()}
    assert got[0] == (0, 400, True) and got[399] == (0, 400, False)
    assert got[1149] == (1149, 2, True) and got[1299] == (1149, 2, False)


def test_a_frequent_digest_sends_one_row_a_task(llm, docs_of):
    """Of a text in a third of the rows, no more partial winners are shuffled than there are tasks."""
    rows = [(i, "hot " if i % 3 else " hot") for i in range(400)] + [(1000 + i, f"t{i}") for i in range(200)]
    dealt = exact_dedup.written(docs_of(rows).repartition(5), "dealt")
    common = exact_dedup.written(
        exact_dedup.digested(dealt).filter(F.hex("digest") == hashlib.sha256(b"hot").hexdigest().upper()),
        "common",
    )
    (best,) = exact_dedup.frequent_winners(common).collect()
    assert (best.keep_id, best.group_size, best.copies) == (0, 400, 1)
    plan = common.groupBy("digest").agg(F.min(F.struct("points", "doc_id")))
    lines = plan._jdf.queryExecution().executedPlan().toString().split("\n")
    exchange = next(i for i, line in enumerate(lines) if "Exchange" in line)
    assert any("partial_min" in line for line in lines[exchange:])
    kept = exact_dedup.drop_copies(dealt).collect()
    assert sorted(r.doc_id for r in kept) == [0, *range(1000, 1200)]


def test_losers_of_frequent_digests_go_before_the_shuffle(llm, docs_of):
    """They are dropped by a broadcast join; what is left to shuffle holds one row of the digest."""
    rows = [(i, " hot"[i % 2 :]) for i in range(300)] + [(None, "hot"), (0, " hot"), (500, "other"), (501, None)]
    docs = docs_of(rows)
    _, verified, _, _ = exact_dedup.grouped(exact_dedup.digested(docs))
    left = exact_dedup.without_losers(docs, verified)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(
        [(0, " hot"), (0, " hot"), (500, "other"), (501, None)], key=repr
    )
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_misra_gries_bound():
    values = ["a"] * 300 + [f"x{i}" for i in range(2000)] + ["b"] * 200
    batches = [pd.DataFrame({"digest": values[i::7]}) for i in range(7)]
    (found,) = exact_dedup.summarise(iter(batches), counters=20)
    held = dict(zip(found["digest"], found["n"]))
    assert len(held) <= 20
    for value, n in Counter(values).items():
        assert n - len(values) / 20 <= held.get(value, 0) <= n


def test_drop_copies(docs_of):
    docs = docs_of(ODD)
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    groups = defaultdict(list)
    for r in ODD:
        groups[bare(r[1])].append(r)
    want = sorted((winner(g) for g in groups.values()), key=repr)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == want


@pytest.mark.parametrize("work", [exact_dedup.exact_groups, exact_dedup.drop_copies, sharding.shard_documents])
def test_empty_tables(docs_of, work):
    assert work(docs_of([])).count() == 0


def test_shards(docs_of):
    rows = ODD + [(i, f"text {i}") for i in range(100, 700)]
    got = sharding.shard_documents(docs_of(rows)).collect()
    assert len(got) == len(rows)
    by_key = {}
    for r in got:
        assert r.grown_shard in (r.shard, sharding.SHARDS) and 0 <= r.shard < sharding.SHARDS
        assert by_key.setdefault(r.doc_id, r.shard) == r.shard
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    moved = sum(r.grown_shard != r.shard for r in got)
    assert 0 < moved < len(rows) / 10


def test_shard_scores_in_python(docs_of):
    def far(key, shard):
        digest = hashlib.md5(f"{key}:{shard}".encode()).hexdigest()[: sharding.DIGITS]
        return -math.log((int(digest, 16) + 0.5) / 16.0**sharding.DIGITS)

    got = sharding.shard_documents(docs_of([(i, "x") for i in range(200)])).collect()
    for r in got:
        assert r.shard == min(range(40), key=lambda s: far(r.doc_id, s))
        assert r.grown_shard == min(range(41), key=lambda s: far(r.doc_id, s))


def test_weights(llm):
    ids = llm.range(4000).withColumnRenamed("id", "doc_id")
    weights = (1.0, 3.0, 0.0)
    shard = sharding.rendezvous(ids["doc_id"].cast("string"), weights)
    sizes = {r.s: r["count"] for r in ids.select(shard.alias("s")).groupBy("s").count().collect()}
    assert set(sizes) == {0, 1} and 0.7 < sizes[1] / 4000 < 0.8
    more = sharding.rendezvous(ids["doc_id"].cast("string"), (1.0, 3.0, 1.0))
    both = ids.select(shard.alias("a"), more.alias("b")).filter("a <> b")
    assert {r.b for r in both.select("b").distinct().collect()} == {2}
    with pytest.raises(ValueError):
        sharding.rendezvous(ids["doc_id"], (0.0, 0.0))


def test_extra_columns_are_there(docs_of):
    assert set(EXTRA) < set(docs_of(ODD).columns)
