"""Token ids, counts at every prefix, and packing against the libraries and brute force."""

import base64
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from netlantern.llm import byte_bpe, packing, token_prefix, word_bpe
from tests.llm.conftest import ODD

RANKS, COUNTED, WORDS = (
    P.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json")
)
LETTERS = "  \n\t'''stmdrvelxXQS09!.éÉé　日\U0001f600\x1c\x00<|Σİß\xa0"


def noise(n, longest=40, special=0.03):
    draw = random.Random(5)
    return [
        "".join(
            draw.choice(LETTERS) if draw.random() >= special else "<|endoftext|>"
            for _ in range(draw.randint(0, longest))
        )
        for _ in range(n)
    ]


@pytest.fixture(scope="module")
def tik():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(params=[53, byte_bpe.WINDOW])
def window(request, monkeypatch):
    monkeypatch.setattr(byte_bpe, "WINDOW", request.param)


def test_encode(tik, window):
    known = byte_bpe.codec(RANKS)
    texts = noise(1500) + ["", "a" * 3000, " " * 300, "'" * 9, "\n", "x" + "ab" * 400 + " y"]
    for text, ids in zip(texts, known.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tik.encode_ordinary(text)
        assert known.decode(ids) == text.encode()
    assert list(known.encode([])) == []


def test_short_and_long_merging_agree():
    known = byte_bpe.codec(RANKS)
    draw = random.Random(3)
    for _ in range(300):
        piece = bytes(draw.choice(b" aaabtheningtion\xc3\xa9") for _ in range(draw.randint(2, 32)))
        assert byte_bpe.merge_short(piece, known.ranks) == byte_bpe.merge_long(piece, known.ranks)


def test_cache_generations(monkeypatch, tik):
    monkeypatch.setattr(byte_bpe, "CACHED", 3)
    known = byte_bpe.Codec(RANKS)
    text = "one two three four five one two three nine one"
    assert np.frombuffer(next(known.encode([text])), "<u4").tolist() == tik.encode_ordinary(text)
    assert len(known) <= 3 and len(known.older) <= 3


def test_encode_documents(docs_of, tik):
    found = byte_bpe.encode(docs_of(ODD), RANKS)
    rows = byte_bpe.decode(found, RANKS).collect()
    want = sorted(((i, tik.encode_ordinary(t or "")) for i, t in ODD), key=repr)
    got = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows]
    assert sorted(got, key=repr) == want
    assert sorted(bytes(r.decoded) for r in rows) == sorted((t or "").encode() for _, t in ODD)
    known = byte_bpe.codec(RANKS)
    for r in found.filter("doc_id = 8").collect():
        text = ODD[11][1].encode()
        for a in range(0, len(text), 3):
            for b in (a, a + 1, len(text)):
                assert byte_bpe.decode_span(r.ids, r.offsets, a, b, known) == text[a:b]
    assert byte_bpe.encode(docs_of([]), RANKS).count() == 0


def test_every_prefix(window):
    library, known = Tokenizer.from_file(COUNTED), token_prefix.counter(COUNTED)
    texts = noise(400, 30) + ["  <|endoftext|> x", "a!<|endoftext|>!b", "<|endoftext|><|endoftext|>", " 's 'll'll"]
    for text in texts:
        steps = known.steps(text)
        counts = np.cumsum(np.frombuffer(steps, np.int8)).tolist()
        prefixes = [text[: i + 1] for i in range(len(text))]
        want = [len(e.ids) for e in library.encode_batch(prefixes, add_special_tokens=False)]
        assert counts == want, text
        for budget in (0, 1, 5):
            fits = [i + 1 for i, n in enumerate(want) if n <= budget]
            assert token_prefix.longest_within(steps, budget) == (fits[-1] if fits else 0)
        assert token_prefix.count_at(steps, 3) == ([0, *want][min(3, len(want))])


def test_long_words_count():
    library, known = Tokenizer.from_file(COUNTED), token_prefix.Counter(COUNTED)
    for text in ("ab" * 900, " " * 500, "日本" * 200, "!?" * 300 + "x"):
        assert token_prefix.total(known.steps(text)) == len(library.encode(text).ids)


def test_count_documents(docs_of):
    library = Tokenizer.from_file(COUNTED)
    got = token_prefix.token_prefixes(docs_of(ODD), COUNTED).collect()
    texts = [(i, t or "") for i, t in ODD]
    want = [(i, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in texts]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=repr) == sorted(want, key=repr)
    assert all(len(r.steps) >= r.fit_points for r in got)
    assert token_prefix.token_prefixes(docs_of([]), COUNTED).count() == 0


def test_word_ids():
    library, known = Tokenizer.from_file(WORDS), word_bpe.WordCodec(WORDS)
    texts = noise(2000) + ["", "a" * 3000, " " * 300, "İ İstanbul ΣΣ"]
    for text, ids in zip(texts, known.encode_all(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_word_chunks_by_generation():
    """A small cache, odd chunks between, and texts in an Arrow slice; a worker's cache stays small."""
    library, known = Tokenizer.from_file(WORDS), word_bpe.WordCodec(WORDS, 50)
    odd = ["a\0b", "İ, J\u030c. É! don't. x…, ²; 5) ß? ×, Ab\x01. ŉ. Ω, \ufb1d,", "\0", "\0 \0\0", "x<|endoftext|>y <|endoftext|>", "a\u2003b \u0301c", "\t \n\n x\r", "é" * 70, "J\u030c"]
    texts = noise(500) + odd + ["Word, word. WORD!"] * 3
    whole = pa.array(["before", *texts, "after"])
    for _ in range(2):
        for low in range(0, len(texts), 40):
            part = whole.slice(low + 1, min(40, len(texts) - low))
            for text, ids in zip(texts[low : low + 40], known.encode_all(part), strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert list(known.encode_all([])) == []
    # The cache is all that a worker keeps: no second one of words, and no more entries than twice 400,000.
    held = [k for k, v in vars(known).items() if isinstance(v, dict)]
    assert sorted(held) == ["chunks", "older"] and word_bpe.CACHED <= 400_000


def fewest(lengths, capacity):
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i]:
                rooms[k] -= lengths[i]
                place(i + 1, rooms)
                rooms[k] += lengths[i]
        rooms.append(capacity - lengths[i])
        place(i + 1, rooms)
        rooms.pop()

    place(0, [])
    return best[0]


def test_fewest_sequences():
    better = 0
    for seed in range(250):
        draw = random.Random(seed)
        low, high = ((15, 60), (20, 50), (1, 100))[seed % 3]
        lengths = [draw.randint(low, high) for _ in range(draw.randint(0, 9))]
        lots = packing.fewest(lengths, 100)
        assert sorted(i for lot in lots for i in lot) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in lot) <= 100 for lot in lots)
        assert len(lots) == (fewest(sorted(lengths, reverse=True), 100) if lengths else 0)
        better += len(lots) < len(packing.best_fit(lengths, 100))
    assert better


def test_search_is_bounded():
    draw = random.Random(1)
    lengths = [draw.randint(900, 1700) for _ in range(600)]
    lots = packing.fewest(lengths, 4096, nodes=2000)
    assert sorted(i for lot in lots for i in lot) == list(range(600))
    assert len(lots) <= len(packing.best_fit(lengths, 4096))


@pytest.mark.parametrize("group", [4, 8192])
def test_pack_documents(docs_of, group):
    library = Tokenizer.from_file(WORDS)
    got = packing.pack(docs_of(ODD), WORDS, capacity=512, keep_ids=True, group=group).cache()
    rows = got.collect()
    want = []
    for i, t in ODD:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 512)):
            data = np.array(ids[at : at + 512], "<u4").tobytes()
            want.append((i, k, at, len(data) // 4, zlib.crc32(data)))
    have = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    lots = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == lots.get(r.sequence_id, 0)
        lots[r.sequence_id] = r.offset + r.length
    assert max(lots.values()) <= 512
    joined = packing.sequences(got).collect()
    assert {r.sequence_id: len(r.ids) // 4 for r in joined} == lots
    assert packing.pack(docs_of([]), WORDS).count() == 0


@pytest.mark.parametrize(
    "low, high, n, gain", [(900, 1700, 600, 4), (330, 480, 2000, 4), (900, 1700, 3000, 20), (330, 480, 4000, 6)]
)
def test_search_beats_best_fit(low, high, n, gain):
    """Sequences of four and of ten pieces: the search saves sequences that best fit leaves open."""
    draw = random.Random(n)
    lengths = [draw.randint(low, high) for _ in range(n)]
    lots = packing.fewest(lengths)
    assert sorted(i for lot in lots for i in lot) == list(range(n))
    assert all(sum(lengths[i] for i in lot) <= packing.CAPACITY for lot in lots)
    bound = packing.lower_bound(lengths, packing.CAPACITY)
    assert bound <= len(lots) <= max(bound, len(packing.best_fit(lengths, packing.CAPACITY)) - gain)


def test_lower_bound_counts_halves():
    assert packing.lower_bound([60] * 7 + [30] * 4, 100) == 7
    assert packing.lower_bound([60] * 7 + [45] * 4, 100) == 9
    assert packing.lower_bound([50] * 5, 100) == 3 and packing.lower_bound([], 100) == 0
