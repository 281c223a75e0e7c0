"""Lexical search and hard negatives against plain Python, and their bounds made small."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from netlantern.llm import hard_negatives as hard
from netlantern.llm import lexical_search as lex
from tests.llm.conftest import EXTRA, ODD

ASCII_LOWER = str.maketrans(lex.UPPER, lex.LOWER)


def terms(text):
    return re.findall(lex.TERM, (text or "").translate(ASCII_LOWER))


def plain_search(docs, items, most):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    total, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in wanted.items():
        found = []
        for i, c in counts:
            m = 50 + 50 * sum(c.values()) * total // length
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                for t in own & c.keys()
            )
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k, f[3], -f[0]) for k, f in enumerate(sorted(found)[:most], 1)]
    return sorted(out, key=str)


def got_search(docs, items, most=lex.BEST):
    rows = lex.search(docs, items, most).collect()
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rows), key=str)


ITEMS = [
    (1, "The quick, brown FOX and the fox"),
    (2, "no id here; another text x"),
    (2, "Straße 日本"),
    (3, None),
    (4, " .,-"),
    (None, "jumps lazy"),
    (5, "nowhere0found"),
    (6, "é \U0001f600 0 stop"),
]


def items_of(spark, rows):
    return spark.createDataFrame(
        [(i, t, "x", None) for i, t in rows], "item_id long, text string, rank string, score string"
    )


@pytest.mark.parametrize("most", [1, 3, 50])
def test_search_odd(llm, docs_of, most):
    docs = ODD + [(i, "fox " * (i % 3)) for i in range(20, 40)]
    got = got_search(docs_of(docs), items_of(llm, ITEMS), most)
    assert got == plain_search(docs, ITEMS, most) and got


def test_search_blocks(llm, docs_of, monkeypatch):
    """Items in many blocks, scores added up in small tables and cut often give the same rows."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)] + ["é", "Ñandú", "0"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(300)]
    items = [(k, ", ".join(rng.choices(words, k=5))) for k in range(25)]
    want = plain_search(docs, items, 5)
    monkeypatch.setattr(lex, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(lex, "CELLS", 40)
    assert lex.item_terms(items_of(llm, items)).select("block").distinct().count() > 3
    assert got_search(docs_of(docs), items_of(llm, items), 5) == want


def test_search_empty(llm, docs_of):
    assert got_search(docs_of([]), items_of(llm, ITEMS)) == []
    assert got_search(docs_of(ODD), items_of(llm, [])) == []
    assert got_search(docs_of([(1, None), (2, " ")]), items_of(llm, ITEMS)) == []


def test_best_keeps_ties():
    best = lex.Best(1, 3)
    for i in (9, 7, 8, 1, 3):
        best.add(np.array([[5]]), np.array([i == 1]), np.array([i]))
    assert best.cut()[3].tolist() == [3, 7, 8]


# --- hard negatives --------------------------------------------------------------------------------


def usable(row):
    return row[2] is not None and row[1] is not None and all(
        x is not None and math.isfinite(x) for x in row[1]
    )


def plain_mine(rows):
    rows = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in filter(usable, rows)]
    out = []
    for k, (a, va, la) in enumerate(rows):
        if a is None or a % 100:
            continue
        scored = [
            (-sum(x * y for x, y in zip(va, v)), i is None, i or 0, label == la)
            for j, (i, v, label) in enumerate(rows)
            if j != k
        ]
        scored.sort()
        for s, none, i, _ in [x for x in scored if x[3]][:5]:
            p = -s
            window = [x for x in scored if not x[3] and 30 * p <= -100 * x[0] <= 90 * p][:10]
            out += [
                (a, None if none else i, n, None if x[1] else x[2], p, -x[0])
                for n, x in enumerate(window, 1)
            ]
    return sorted(out, key=str)


def vectors_of(spark, rows):
    more = [c for c in EXTRA if c != "label"]
    schema = "vec_id long, embedding array<float>, label int, " + ", ".join(f"{c} string" for c in more)
    return spark.createDataFrame([(*r, *["x"] * len(more)) for r in rows], schema)


def got_mine(df):
    found = hard.mine(df, F.col("vec_id") % 100 == 0).collect()
    names = "anchor_id positive_id rank negative_id positive_score negative_score".split()
    return sorted((tuple(r[n] for n in names) for r in found), key=str)


def sample(n, seed, clusters=6, size=8):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(clusters, size))
    where = rng.integers(0, clusters, n)
    v = np.round(centre[where] + 0.3 * rng.normal(size=(n, size)), 2).astype(np.float32)
    label = np.where(rng.random(n) < 0.8, where % 4, rng.integers(0, 4, n))
    return [(int(i) * 5, [float(x) for x in v[i]], int(label[i])) for i in range(n)]


def test_mine_odd(llm):
    nan, inf = float("nan"), float("inf")
    rows = sample(200, 1)
    rows += [rows[0]] * 2 + [rows[20]] * 30 + [(7, rows[20][1], 3)] * 15  # repeats and ties
    rows += [(None, [1.0] * 8, 1), (None, [1.0] * 8, 0), (100, None, 1), (200, [1.0] * 8, None)]
    rows += [(300, [nan] + [1.0] * 7, 1), (400, [inf] * 8, 1), (500, [None] * 8, 1), (600, [], 1)]
    rows += [(700, [0.0] * 8, 2), (800, [1.0, 2.0], 1), (900, [-1.0] * 8, 3), (1000, [1e-3] * 8, 77)]
    want = plain_mine(rows)
    assert got_mine(vectors_of(llm, rows)) == want and len(want) > 50


def test_mine_deep_tree(llm, monkeypatch):
    """Small leaves, blocks and chunks give the same rows; so do many equal vectors in one leaf."""
    monkeypatch.setattr(hard, "LEAF_ROWS", 40)
    monkeypatch.setattr(hard, "CHUNK", 6)
    rows = sample(300, 2) + [(10_000 + 50 * i, [0.5] * 8, i % 3) for i in range(90)]
    df = vectors_of(llm, rows)
    dealt = hard.deal(hard.whole_numbers(df))
    assert dealt.tree.leaves > 7 and dealt.blocks.filter("blocks > 1").count()
    assert got_mine(df) == plain_mine(rows)


def test_mine_empty(llm):
    assert got_mine(vectors_of(llm, [])) == []
    assert got_mine(vectors_of(llm, [(100, [1.0], 1)])) == []
    assert got_mine(vectors_of(llm, [(100, [], 1), (1, [], 1), (2, [], 2)])) == plain_mine(
        [(100, [], 1), (1, [], 1), (2, [], 2)]
    )


def test_tree_leaves_out():
    """Ranges leave subtrees out, and never one that holds a row of the window."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(40, 6)) * 400
    rows = np.floor(centre[rng.integers(0, 40, 4000)] + 10 * rng.normal(size=(4000, 6)))
    tree = hard.fit_tree(rows[:1000], float((rows**2).sum(1).max()), 100.0)
    leaf, seen = hard.descend(tree, tree.lifted(rows))
    for node, far, home in seen:
        for j in range(far.shape[1]):
            if (home == j).any():
                tree.low[node][:, j] = far[home == j].min(0)
                tree.high[node][:, j] = far[home == j].max(0)
    anchors = rows[:50]
    scores = anchors @ rows.T
    low = np.sort(scores, 1)[:, -40][:, None]
    high = np.sort(scores, 1)[:, -10][:, None]
    here = hard.visited(tree, anchors, *hard.radii(tree, anchors, low, high))
    for k in range(len(anchors)):
        inside = set(leaf[(scores[k] >= low[k]) & (scores[k] <= high[k])])
        assert inside <= {n for n, at in enumerate(here) if k in at}
    assert sum(map(len, here)) < 0.5 * tree.leaves * len(anchors)
