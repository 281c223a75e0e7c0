"""Near duplicates: fingerprints, components and vectors against brute force."""

import random

import numpy as np
import pytest
import xxhash

from netlantern.llm import embedding_dedup, simhash_dedup
from netlantern.llm.components import components
from netlantern.llm.fingerprint import simhash
from tests.llm.conftest import ODD


def plain_simhash(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ")
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", " ".join(words))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def roots(nodes, links):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def test_fingerprints():
    draw = random.Random(2)
    texts = [" ".join(draw.choice(("The", "é\x1cx", "dog", "A b")) for _ in range(n)) for n in range(40)]
    for text in [*texts, None, "", " \x0b", "One two", "a\n" * 70]:
        assert simhash(text) == plain_simhash(text)


def near_prints(n, seed=1):
    """Random fingerprints, each with some that differ from it in a few bits."""
    draw = random.Random(seed)
    out = set()
    while len(out) < n:
        one = draw.getrandbits(64)
        out.add(one)
        for _ in range(draw.choice((0, 0, 1, 4))):
            other = one
            for b in draw.sample(range(64), draw.randint(1, 5)):
                other ^= 1 << b
            out.add(other)
    return sorted(out)


@pytest.mark.parametrize("thresholds", [None, (1, 1), (1, 0, 0), (0, 0, 0, 0), (2, 0), (3, -1)])
def test_links_are_exact(llm, thresholds):
    prints = near_prints(300)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = llm.createDataFrame([(p,) for p in signed], "fp long")
    parts = None
    if thresholds:
        groups = simhash_dedup.group_bits(0, np.zeros((64, 64)), len(thresholds))
        assert sorted(b for g in groups for b in g) == list(range(64))
        parts = [simhash_dedup.Part(g, t) for g, t in zip(groups, thresholds)]
    got = simhash_dedup.links(frame, parts=parts).collect()
    mask = (1 << 64) - 1
    want = {
        tuple(sorted((a, b)))
        for i, a in enumerate(signed)
        for b in signed[:i]
        if ((a ^ b) & mask).bit_count() <= 3
    }
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want and want


def test_thresholds_cover_every_distance():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (5000, 64))
    for n in (10, 5000, 10**8):
        parts = simhash_dedup.choose_parts(n, (bits.T @ bits) * n / 5000)
        assert sum(p.threshold + 1 for p in parts) == simhash_dedup.MAX_BITS + 1
        assert sorted(b for p in parts for b in p.bits) == list(range(64))
    # Whatever the distribution of flipped bits over the parts, one part is within its threshold.
    assert len(simhash_dedup.choose_parts(10**12, (bits.T @ bits) * 1e12 / 5000)) == 2


def test_components(llm):
    draw = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(0, n) for n in range(1, 40)] + [(7, 7), (900, 900)]
    links += [tuple(draw.sample(range(1000, 1400), 2)) for _ in range(250)] + [(5, 3)] * 3
    frame = llm.createDataFrame([*links, (None, 4), (8, None)], "a long, b long")
    got = {r.node: r.component for r in components(frame).collect()}
    assert got == roots({n for link in links for n in link}, links)
    assert components(frame.limit(0)).count() == 0


def test_simhash_classes(docs_of):
    base = " ".join(f"w{i}" for i in range(400))
    rows = ODD + [(20, base), (21, base.replace("w77 ", "x ")), (22, base.upper()), (23, base + " w400")]
    got = simhash_dedup.simhash_classes(docs_of(rows)).collect()
    prints = [simhash(t) for _, t in rows]
    links = [
        (i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3
    ]
    low = roots(range(len(rows)), links)
    names = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            names[low[k]] = min(i, names.get(low[k], i))
    want = sorted(
        ((i, f"{prints[k]:016x}", names.get(low[k])) for k, (i, _) in enumerate(rows)), key=repr
    )
    assert sorted((tuple(r) for r in got), key=repr) == want
    kept = simhash_dedup.drop_near_copies(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert ids == sorted((names.get(c) for c in set(low.values())), key=repr)
    assert simhash_dedup.simhash_classes(docs_of([])).count() == 0
    assert simhash_dedup.drop_near_copies(docs_of([])).count() == 0


def vectors(n=260, width=8, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, width))
    x = centres[rng.integers(0, 25, n)] + rng.normal(size=(n, width)) * rng.choice([0.05, 0.4, 1.0], n)[:, None]
    rows = [(int(i), [float(v) for v in row]) for i, row in enumerate(x.astype(np.float32))]
    rows += [(1000 + i, rows[0][1]) for i in range(30)] + [rows[1]] * 3
    rows += [(2000, [2 * v for v in rows[0][1]]), (2001, [1e-30 * v for v in rows[2][1]])]
    rows += [(3000, None), (3001, []), (3002, [0.0] * width), (3003, [float("nan")] * width)]
    rows += [(3004, [float("inf")] + [1.0] * (width - 1)), (3005, [None] + [1.0] * (width - 1))]
    rows += [(4000, [1.0, 2.0]), (4001, [2.0, 4.0]), (4002, [-1.0, 0.0]), (None, rows[3][1]), (None, None)]
    return rows


@pytest.mark.parametrize("block", [16, 4096])
def test_vectors(llm, monkeypatch, block):
    rows = vectors()
    monkeypatch.setattr(embedding_dedup.range_join, "__defaults__", (0.9, block, 12))
    monkeypatch.setattr(embedding_dedup, "STRIP", 7)
    frame = llm.createDataFrame(
        [(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, rep string, copies int"
    )
    got = embedding_dedup.near_vectors(frame).collect()

    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.asarray(np.asarray(v, np.float32), float)
        return x / np.linalg.norm(x)

    u = [unit(v) for _, v in rows]
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if u[i] is not None and u[j] is not None and len(u[i]) == len(u[j]) and u[i] @ u[j] >= 0.9
    ]
    low = roots(range(len(rows)), links)
    n_links = np.bincount([k for link in links for k in link], minlength=len(rows))
    names = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            names[low[k]] = min(i, names.get(low[k], i))
    want = [
        (i, int(n_links[k]), names.get(low[k]), i == names.get(low[k])) for k, (i, _) in enumerate(rows)
    ]
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    assert embedding_dedup.near_vectors(frame.limit(0)).count() == 0
