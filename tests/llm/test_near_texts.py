"""The pipeline's near-dedup stage against brute force over five-word shingles."""

import os
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from netlantern.llm import near_dedup
from netlantern.plans.sizing import shared_dir
from tests.llm.conftest import ODD
from tests.llm.test_near import roots


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def classes_of(rows):
    """For each place in ``rows`` the first place of its class, and how many unequal pairs link."""
    held = [plain_shingles(t) for _, t in rows]
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if held[i] == held[j] or 9 * len(held[i] & held[j]) >= 4 * (len(held[i]) + len(held[j])) > 0
    ]
    return roots(range(len(rows)), links), sum(held[i] != held[j] for i, j in links)


def copies():
    """Texts changed in a few words, from hardly to below the limit, one of them very often."""
    draw = random.Random(5)
    out = []
    for k in range(30):
        words = [f"w{draw.randrange(3000)}" for _ in range(draw.choice((3, 8, 60, 300)))]
        for _ in range(60 if k == 3 else draw.choice((1, 2, 4))):
            own = words[: len(words) - draw.choice((0, 0, 3))]
            for at in draw.sample(range(len(own)), min(len(own), draw.randrange(1 + len(words) // 40))):
                own[at] = f"x{draw.randrange(10**6)}"
            out.append(" ".join(own))
    line = " a line that very many of all the texts share"
    return [(100 + i, t + line * (i % 3 == 0)) for i, t in enumerate(out)]


@pytest.mark.parametrize("rounds, least", [(6, 0), (6, 20), (1, 0)])
def test_stage_finds_every_similar_pair(llm, docs_of, monkeypatch, rounds, least):
    monkeypatch.setattr(near_dedup, "PAIRS_LEFT", least)
    monkeypatch.setattr(near_dedup, "ROUNDS", rounds)
    monkeypatch.setattr(near_dedup, "AT_ONCE", 7)
    monkeypatch.setattr(near_dedup, "HOT_SHARE", 20)
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", 5)
    rows = ODD + copies()
    low, linked = classes_of(rows)
    names = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            names[low[k]] = min(i, names.get(low[k], i))
    kept = dict(corpus_pipeline.STAGES)["simhash near-dedup"](llm, docs_of(rows), "")
    want = sorted((names.get(c) for c in set(low.values())), key=repr)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == want
    assert linked > 200 and len(want) < len(rows) / 2


def test_stage_on_the_check_table(llm):
    path = "/root/testdata/sf0.001/documents.parquet"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{path}' ORDER BY doc_id").fetchall()
    low, linked = classes_of(rows)
    kept = dict(corpus_pipeline.STAGES)["simhash near-dedup"](llm, llm.read.parquet(path), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted({rows[c][0] for c in low.values()})
    assert linked


def test_one_shingle_in_many_unlike_texts(llm, docs_of):
    """Texts made of little else than a line that all hold are compared in blocks; few of them are alike."""
    draw = random.Random(9)
    line = "these five words are common"
    texts = [f"{line} x{k}" if k % 9 else f"{line} x{k // 45} y z" for k in range(500)]
    texts += [" ".join(draw.sample("a b c d e f g h".split(), 8)) + f" {line}" for _ in range(60)]
    rows = list(enumerate(texts))
    low, _ = classes_of(rows)
    kept = near_dedup.drop_near_copies(docs_of(rows)).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(low.values()))


def test_blocks_link_all_classes(llm, docs_of, monkeypatch):
    """All sets of one shingle in small blocks of several size classes, against all pairs."""
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", 4)
    rows = copies()[:90]
    low, _ = classes_of(rows)
    heads = near_dedup.prefixed(docs_of(rows), near_dedup.shingle_order(docs_of(rows)))
    shared = near_dedup.written(
        heads.selectExpr("0L AS k", "fp", "n", "fp AS c").distinct(), "shared"
    )
    links = near_dedup.in_blocks(docs_of(rows), heads, shared).collect()
    fps = {r.doc_id: r.fp for r in heads.collect()}
    got = roots(set(fps.values()), [(r.a, r.b) for r in links])
    same = lambda i, j: got[fps[rows[i][0]]] == got[fps[rows[j][0]]]
    assert all(same(i, j) == (low[i] == low[j]) for i in range(len(rows)) for j in range(i))


def test_links_of_near_fingerprints(llm, docs_of):
    """Fingerprints in few bits are the stage's first candidates, and only similar texts of them link."""
    rows = ODD + copies()
    docs = docs_of(rows)
    heads = near_dedup.prefixed(docs, near_dedup.shingle_order(docs))
    found = near_dedup.print_links(docs, heads, near_dedup.shared_heads(heads)).collect()
    facts = {r.fp: r for r in heads.select("fp", "n", "print").collect()}
    held = {}
    for _, text in rows:
        hashes = near_dedup.shingles(text)
        held[int(near_dedup.xxhash.xxh64_intdigest(hashes.tobytes(), near_dedup.SEED))] = set(hashes.tolist())
    held = {fp - (1 << 64) if fp >> 63 else fp: h for fp, h in held.items()}
    assert len(found) >= 10
    for a, b in found:
        x, y = held[a], held[b]
        assert bin((facts[a].print ^ facts[b].print) & (1 << 64) - 1).count("1") <= 3
        assert 5 * len(x & y) >= 4 * len(x | y)
    # Sets that are alone with their fingerprint miss no near and similar one.
    alone = [r for r in facts.values() if sum(o.print == r.print for o in facts.values()) == 1]
    want = {
        (min(a.fp, b.fp), max(a.fp, b.fp))
        for a in alone
        for b in alone
        if a.fp < b.fp
        and bin((a.print ^ b.print) & (1 << 64) - 1).count("1") <= 3
        and 5 * len(held[a.fp] & held[b.fp]) >= 4 * len(held[a.fp] | held[b.fp]) > 0
    }
    assert want <= {(r.a, r.b) for r in found} and want


def test_bitmaps_never_differ_in_more_than_the_sets():
    """Bitmaps of any two sizes tell sets apart that aren't similar, and never say more than is so."""
    draw = random.Random(3)
    words = [draw.getrandbits(64) for _ in range(4000)]
    sets = [set(draw.sample(words, n)) for n in (1, 1, 40, 70, 500, 500, 900, 3000)] + [set()]
    sets += [s | {draw.getrandbits(64)} for s in sets]
    found = [near_dedup.parities(np.array(sorted(s), np.uint64)).tobytes() for s in sets]
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets))]
    far = near_dedup.apart(*(pa.array([found[p[k]] for p in pairs], pa.binary()) for k in (0, 1)))
    sizes = np.array([len(sets[i]) + len(sets[j]) for i, j in pairs])
    kept = near_dedup.may_link(far, sizes)
    for (i, j), least, stays in zip(pairs, far.tolist(), kept.tolist()):
        x, y = sets[i], sets[j]
        assert least <= len(x ^ y)
        assert stays or 5 * len(x & y) < 4 * len(x | y)
    assert not kept[pairs.index((4, 5))] and {len(b) for b in found} >= {8, 64, 128, 512}


def test_unlike_texts_move_no_shingles(llm, docs_of, monkeypatch):
    """Of texts that share a few words, bitmaps leave no pair whose shingles are then read."""
    draw = random.Random(7)
    line = "rare words that these texts share"
    texts = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(60)) + f" {line}" for _ in range(40)]
    docs = docs_of(list(enumerate(texts)))
    heads = near_dedup.prefixed(docs, near_dedup.shingle_order(docs))
    sets = near_dedup.shared_heads(heads)
    fps = sorted(r.fp for r in heads.select("fp").collect())
    pairs = llm.createDataFrame([(a, b) for a in fps for b in fps if a < b], "a long, b long")
    pairs = near_dedup.written(pairs, "pairs")
    monkeypatch.setattr(near_dedup, "members", None)
    assert near_dedup.verified(docs, heads, sets, pairs).count() == 0


def test_lots_and_scratch(llm, docs_of, monkeypatch):
    """Many small lots give the same classes; tables that grow with the input go once they are used."""
    for name in ("LOT_BYTES", "LOT_PAIRS"):
        monkeypatch.setattr(near_dedup, name, 20_000)
    monkeypatch.setattr(near_dedup, "LOT_SHARE", 3)
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", 16)
    monkeypatch.setattr(near_dedup, "ROUNDS", 1)
    shared = f"{shared_dir(llm)}".removeprefix("file:")
    had = set(os.listdir(shared))
    rows = copies()[:70]
    low, _ = classes_of(rows)
    kept = near_dedup.drop_near_copies(docs_of(rows)).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == sorted({rows[c][0] for c in low.values()})
    left = {x.partition("-")[0] for x in set(os.listdir(shared)) - had}
    large = "prefixes sets shared centres stars promising members rest large dealt classes".split()
    assert not left & set(large)


def test_common_shingles_count_as_one(llm):
    """Shingles of the same sets have one key; those of other sets keep theirs where that makes fewer pairs."""
    rows = [(k, fp, 9, fp) for k in (1, 2, 3) for fp in range(k % 2, 8)]
    rows += [(k, 100 * k + fp if fp else 100, 9, fp) for k in (5, 6, 7, 8) for fp in range(8)]
    shared = near_dedup.written(llm.createDataFrame(rows, "k long, fp long, n long, c long"), "shared")
    found = {}
    for r in near_dedup._one_of_same(shared).collect():
        found.setdefault(r.k, []).append(r.fp)
    groups = sorted(sorted(x) for x in found.values())
    alone = [sorted({fp for k, fp, _, _ in rows if k == key}) for key in (5, 6, 7, 8)]
    assert groups == sorted([list(range(8)), *alone])
