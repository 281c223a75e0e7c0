"""Toxicity and quality: exact neighbours, held-out accuracy, and odd input."""

import zlib

import duckdb
import numpy as np
import pytest

from netlantern.llm import quality, toxicity
from netlantern.llm.common import labelled_sample
from netlantern.llm.queries import QUERIES
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labels():
    rows = duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{SF}/labels.parquet'").fetchall()
    return {i: (q, t) for i, q, t in rows}


def auc(scores, y):
    good, bad = scores[y == 1], scores[y == 0]
    more = (good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean()
    return more


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.mark.parametrize("name, which, least", [("op4_toxicity", 1, 0.95), ("op6_quality", 0, 0.97)])
def test_held_out_accuracy(llm, labels, name, which, least):
    got = QUERIES[name](llm, SF).collect()
    assert len(got) == 10_000 and {r.doc_id for r in got} == set(range(10_000))
    assert all(r.held_out == held_out(r.doc_id) for r in got)
    cut = 0.7 if which else 0.5
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= cut) for r in got)
    told = [r for r in got if r.held_out and r.doc_id in labels]
    y = np.array([labels[r.doc_id][which] for r in told])
    scores, predicted = (np.array([r[c] for r in told], float) for c in ("score", "predicted"))
    assert auc(scores, y) >= least and (predicted == y).mean() >= 0.9


def test_neighbours_are_exact():
    rng = np.random.default_rng(3)
    terms = 60
    vectors = []
    for n in rng.integers(0, 9, 400):
        at = np.sort(rng.choice(terms, n, replace=False))
        w = rng.random(n)
        vectors.append((at, w / np.sqrt(w @ w) if n else w))
    vectors += vectors[:20]
    dense = np.zeros((len(vectors), terms))
    for i, (at, w) in enumerate(vectors):
        dense[i, at] = w
    index = toxicity.BlockMaxIndex(vectors, terms)
    for i in range(0, len(vectors), 3):
        for k in (1, 10):
            found, cosines = index.nearest(*vectors[i], k, but=i)
            all_ = dense @ dense[i]
            all_[i] = -1
            want = np.sort(all_[all_ > 1e-12])[::-1][:k]
            assert np.allclose(cosines, want) and np.allclose(all_[found], cosines)
            assert i not in found and len(set(found.tolist())) == len(found)


def test_isotonic_rises():
    rng = np.random.default_rng(1)
    x = rng.random(500).round(2)
    knots, values = toxicity.isotonic(x, (rng.random(500) < x).astype(float))
    assert (np.diff(knots) > 0).all() and (np.diff(values) >= 0).all()
    assert 0 < values[0] < values[-1] < 1


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_odd_documents(llm, docs_of, module, label):
    rows = [(100 + i, f"good words here number {i} and idiot" if i % 2 else f"good words, {i}!!") for i in range(60)]
    marks = llm.createDataFrame(
        [(100 + i, i % 2) for i in range(60)] + [(1, 1), (3, None), (None, 1), (101, 1)], f"doc_id long, {label} int"
    )
    docs = docs_of(ODD + rows)
    model = module.fit(docs, marks)
    if module is toxicity:
        found = toxicity.with_toxicity(docs, model, "mark").collect()
        scores = {r.text: r.mark.score for r in found}
        assert scores["good words here number 1 and idiot"] > 0.8 and scores["good words, 0!!"] < 0.2
        near = next(r.mark.neighbours for r in found if r.text == "good words here number 1 and idiot")
        assert 0 < len(near) <= toxicity.K and near[0].label == 1
        assert all(a.cosine >= b.cosine for a, b in zip(near, near[1:]))
        left = toxicity.drop_toxic(docs, marks)
    else:
        found = quality.with_quality(docs, model, "mark").collect()
        scores = {r.text: r.mark for r in found}
        left = quality.drop_poor(docs, marks)
    assert len(found) == len(ODD + rows) and all(0 <= s <= 1 for s in scores.values())
    assert left.columns == docs.columns
    cut = (lambda s: s < 0.7) if module is toxicity else (lambda s: s >= 0.5)
    assert left.count() == sum(cut(scores[t]) for _, t in ODD + rows)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_nothing_labelled_or_no_documents(llm, docs_of, module):
    none = llm.createDataFrame([], "doc_id long, quality int, toxic int")
    drop = toxicity.drop_toxic if module is toxicity else quality.drop_poor
    assert drop(docs_of(ODD), none).count() == len(ODD)
    assert drop(docs_of([]), none).count() == 0


def test_sample(llm, docs_of):
    rows = [(i, f"t{i}") for i in range(50)] + [(3, "again")]
    marks = llm.createDataFrame([(i, 1) for i in range(60)] + [(5, 0)], "doc_id long, toxic int")
    got = {r.doc_id for r in labelled_sample(docs_of(rows), marks, "toxic", 100).collect()}
    assert got == {i for i in range(50) if not held_out(i)} - {3, 5}
    assert labelled_sample(docs_of(rows), marks, "toxic", 7).count() == 7


def test_bradley_terry_against_a_plain_optimiser():
    """Newton's weights have the least loss: small steps downhill from elsewhere come to the same."""
    rng = np.random.default_rng(4)
    better, worse = rng.normal(0.3, 1, (400, 5)), rng.normal(0, 1, (400, 5))
    z = better - worse

    def loss(w):
        return np.logaddexp(0, -z @ w).mean() + quality.RIDGE / 2 * w @ w

    found, plain = quality.bradley_terry(better, worse), rng.normal(size=5)
    for _ in range(20_000):
        slope = -(z / (1 + np.exp(z @ plain))[:, None]).mean(0) + quality.RIDGE * plain
        plain = plain - 0.3 * slope
    assert np.allclose(found, plain, atol=1e-6)
    for k in range(5):
        for step in (-1e-3, 1e-3):
            assert loss(found) < loss(found + step * np.eye(5)[k])


@pytest.mark.parametrize("seed", range(20))
def test_best_cut_against_all_cuts(seed):
    """No cut has fewer labels on its wrong side, and none falls between equal scores."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 40))
    scores = rng.integers(0, 8, n).astype(float)
    y = (scores + rng.normal(0, 3, n) > 4).astype(float)
    wrong = lambda cut: int(((scores > cut) != (y > 0)).sum())
    cuts = [-1.0, *(np.unique(scores) + 0.5)]
    cut = quality.best_cut(scores, y)
    assert cut not in scores and wrong(cut) == min(map(wrong, cuts))


def test_repeated_rows_and_equal_scores(llm, docs_of):
    """Rows that repeat have one score each, the same; a score at the threshold stays."""
    rows = [(k, t) for k in range(3) for t in ("Good words, and some more.", "bad bad bad bad !!!", "", None)]
    x = np.array([quality.features(t or "") for _, t in rows[:2]])
    model = quality.fit_quality(x, np.array([1.0, 0.0]))
    found = quality.with_quality(docs_of(rows), model, "mark").collect()
    scores = {}
    for r in found:
        scores.setdefault(r.text or "", set()).add(r.mark)
    assert len(found) == len(rows) and all(len(s) == 1 for s in scores.values())
    half = quality.QualityModel(model.mean, model.spread, np.zeros(quality.FEATURES), 0.0)
    assert set(half.score(x).tolist()) == {0.5}
