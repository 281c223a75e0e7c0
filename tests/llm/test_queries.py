"""The registered corpus queries and the pipeline on the smallest tables."""

import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
import corpus_pipeline
from check import normal, same
from netlantern.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import ODD, SF
from tests.llm.test_near_texts import classes_of


def test_all_are_registered():
    found = entry_points.queries()
    assert set(QUERIES) <= set(found) and "pipeline" in found
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(llm, name):
    con = duckdb.connect()
    for name_ in ("documents", "embeddings", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {name_} AS SELECT * FROM '{SF}/{name_}.parquet'")
    got, want = QUERIES[name](llm, SF).toPandas(), con.sql(ORACLES[name]).df()
    a, b = normal(got), normal(want)
    assert sorted(got.columns) == sorted(want.columns) and len(a) == len(b)
    assert all(same(x, y) for x, y in zip(a, b))


def test_stages(llm, docs_of):
    """Each stage on odd rows: columns stay, and only what it is meant to drop goes."""
    docs = docs_of(ODD)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(llm, docs, SF).columns == docs.columns
        assert stage(llm, docs_of([]), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](llm, docs_of([]), SF).count() == 0


def test_pipeline(llm):
    """The last two stages and the packing against plain Python over what the first three kept."""
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(llm, docs, SF)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    low, _ = classes_of(rows)
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = []
    for k in sorted(set(low.values())):
        ids = [*library.encode(rows[k][1] or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            want.append((rows[k][0], n, zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())))
    got = corpus_pipeline.run(llm, SF).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in got) == want
    assert 0 < len(rows) < 200
