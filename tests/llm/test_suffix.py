"""Suffix arrays against sorting, and removal of repeated strings against a dictionary of all windows."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netlantern.llm import suffix_dedup
from netlantern.llm.queries import op13_suffix_dedup
from netlantern.llm.suffix_order import suffix_array
from tests.llm.conftest import ODD, SF


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(values):
    text = bytes(values)
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("text", [b"a" * 3000, b"ab" * 1500, bytes(range(256)) * 8, b"zyxw" * 5 + b"a"])
def test_suffix_array_periods(text):
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def plain(docs, length, own=suffix_dedup):
    """Each (doc_id, text)'s removed bytes; the order within a doc_id is the operator's, by ``rank``."""
    first = {}
    order = sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0, rank(d[1])))
    for d, text in order:
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            first.setdefault(raw[i : i + length], (d, text, i))
    out = {}
    for d, text in order:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] != (d, text, i):
                gone[i : i + length] = b"\1" * length
        edges = np.diff(np.r_[0, np.frombuffer(gone, np.uint8), 0].astype(int))
        spans = list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()))
        out[d, text] = (spans, bytes(b for b, g in zip(raw, gone) if not g))
    return out


HASHES = {}


def rank(text):
    return HASHES[text]


def check(spark, make, docs, length):
    df = make(docs)
    for r in df.selectExpr("text", "xxhash64(text) AS h").collect():
        HASHES[r.text] = r.h
    want = plain(docs, length)
    got = suffix_dedup.without_repeats(df, length).collect()
    assert len(got) == len(docs)
    texts = sorted((str(r.doc_id), r.n_bytes, [tuple(s) for s in r.spans or []], bytes(r.kept)) for r in got)
    assert texts == sorted((str(d), len((t or "").encode()), *want[d, t]) for d, t in docs)
    return got


def test_odd(llm, docs_of):
    got = check(llm, docs_of, ODD, 20)
    assert any(r.spans for r in got)
    check(llm, docs_of, ODD, 100)


def test_empty(llm, docs_of):
    assert suffix_dedup.without_repeats(docs_of([])).count() == 0
    assert [tuple(r) for r in suffix_dedup.without_repeats(docs_of([(1, None)])).collect()] == [
        (1, 0, None, b"")
    ]


def repeating(n, seed):
    """Texts with copies, shared passages, a line that most of them hold, and periods."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 5)))
    passages = [" ".join(word() for _ in range(15)) for _ in range(6)]
    line = " the line that stands in very many of them "
    docs = []
    for i in range(n):
        text = " ".join(word() for _ in range(rng.randint(0, 12)))
        text += rng.choice(["", line, line * 2]) + rng.choice([*passages, "", "xy" * 40, word() * 30])
        text += " ".join(word() for _ in range(rng.randint(0, 12)))
        docs.append((rng.choice([i, i, None]), text))
    return docs + [(n + k, rng.choice(docs)[1]) for k in range(n // 4)]


@pytest.mark.parametrize("length", [8, 30])
def test_repeats(llm, docs_of, length):
    check(llm, docs_of, repeating(150, length), length)


def test_wide_grams(llm, docs_of, monkeypatch):
    """Grams with many different pieces are cut into windows; texts are looked at in small parts."""
    monkeypatch.setattr(suffix_dedup, "PIECES", 3)
    monkeypatch.setattr(suffix_dedup, "STRING_BYTES", 500)
    monkeypatch.setattr(suffix_dedup, "HOT_SHARE", 40)
    check(llm, docs_of, repeating(150, 3), 30)


def test_parts():
    """A long text's pieces don't depend on where it is cut, as far as grams go."""
    text = random.Random(1).randbytes(5000) * 2
    whole = {}
    for at_once in (1 << 12, 1 << 20):
        old, suffix_dedup.AT_ONCE = suffix_dedup.AT_ONCE, at_once
        keys = np.zeros(len(text), np.int64)
        for a, r, _, k in suffix_dedup.pieces(text, 100, 24):
            for i, n, key in zip(a, r, k):
                keys[i : i + n] = key
        suffix_dedup.AT_ONCE = old
        whole[at_once] = keys
    low, high = whole.values()
    assert (low[:4900] == low[5000:9900]).all() and (high[:4900] == high[5000:9900]).all()


def test_query(llm):
    """The registered query over the smallest table."""
    docs = [(r.doc_id, r.text) for r in llm.read.parquet(f"{SF}/documents.parquet").collect()]
    HASHES.update({t: 0 for _, t in docs})
    want = plain(docs, 100)
    got = op13_suffix_dedup(llm, SF).collect()
    assert len(got) == len(docs) and sum(r.n_removed for r in got) > 0
    import hashlib

    for r in got:
        (spans, kept) = next(v for k, v in want.items() if k[0] == r.doc_id)
        assert (r.n_spans, r.n_removed) == (len(spans), sum(b - a for a, b in spans))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
