import pytest

from netlantern.llm.common import ship

SF = "/root/testdata/sf0.001"
#: Names that operators use inside, so that input columns of the same name would clash.
EXTRA = (
    "fp h copies _keep_id _keep_h _keep _copies score toxicity quality_score digest points n label "
    "shard slot ids steps piece lot file row component root kept"
).split()
LONG = "word and another one. " * 20_000


@pytest.fixture(scope="session")
def llm(spark):
    return ship(spark)


@pytest.fixture(scope="session")
def docs_of(llm):
    """Documents from (doc_id, text) pairs, with many more columns; null in all of them for some."""

    def make(pairs):
        schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in EXTRA)
        rows = [
            (i, t, *[None if k % 2 else f"{c}{k % 3}" for c in EXTRA]) for k, (i, t) in enumerate(pairs)
        ]
        return llm.createDataFrame(rows, schema)

    return make


ODD = [
    (1, "the quick brown fox jumps over the lazy dog"),
    (1, "the quick brown fox jumps over the lazy dog"),
    (2, "the quick  brown fox\tjumps over the lazy dog"),
    (3, None),
    (None, None),
    (4, ""),
    (5, " \n\t"),
    (None, "no id here"),
    (None, "no id here"),
    (6, LONG),
    (7, LONG + "x"),
    (8, "Straße \U0001f600 日本 é don't   stop <|endoftext|> 'sa 'll"),
    (9, "the quick brown fox jumps over the lazy dog!"),
    (1, "another text under the same id"),
    (-5, "0"),
    (2**62, "0"),
]
