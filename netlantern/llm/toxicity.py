"""Toxicity by the votes of the nearest labelled examples.

Documents and examples are TF-IDF vectors over terms (words and their first four to eight letters,
and whether those come twice or three times) that tell the labels apart in the sample, by chi-square. Document frequencies count all documents.
The examples nearest by cosine are found exactly through an inverted index in blocks: for every term
and block of examples it holds the largest weight, so a product with the document's vector bounds
every cosine in a block. Blocks are scored, highest bound first, until the bound falls below the last
of the ``K`` best found. Votes weigh as the inverse of distance; isotonic regression over the
examples, each scored by the others, turns them into probabilities.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlantern.llm.common import labelled_sample, new_name, text_or_empty

#: Bounds of the model: labelled rows it is fitted on, and terms it keeps.
EXAMPLES = 12_000
TERMS = 1024
#: Chi-square that a term must reach, and rows of the sample it must be in.
CHI_SQUARE = 30.0
ROWS_WITH_TERM = 3
LETTERS = 32
ROWS_AT_ONCE = 500
PREFIXES = (4, 5, 6, 7, 8)
REPEATS = (2, 3)
K = 10
BLOCK = 64
NEAR = 0.05
PRIOR = 1.0
THRESHOLD = 0.7

WORD = re.compile(r"\w+").findall

NEIGHBOURS = T.ArrayType(
    T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("label", T.IntegerType()),
            T.StructField("cosine", T.DoubleType()),
        ]
    )
)


def terms_of(word: str) -> list[str]:
    """The terms of a lower-cased word: itself, and its beginnings marked by a star."""
    own = [word] if len(word) <= LETTERS else []
    return own + [word[:n] + "*" for n in PREFIXES if len(word) >= n]


def term_counts(words: Counter) -> Counter:
    """How often a text's words hold each term, and for repeated ones that they are repeated."""
    out: Counter = Counter()
    for word, n in words.items():
        for term in terms_of(word):
            out[term] += n
    for times in REPEATS:
        out.update({f"{t}@{times}": 1 for t, n in out.items() if n >= times and "@" not in t})
    return out


class Vocabulary:
    """Terms to their numbers; texts to counts of the terms they hold."""

    def __init__(self, terms: list[str]) -> None:
        self.number = {t: i for i, t in enumerate(terms)}
        self.begun = {t.split("@")[0].rstrip("*")[: PREFIXES[0]] for t in terms}

    def counts(self, text: str) -> dict[int, int]:
        begun, first, number = self.begun, PREFIXES[0], self.number
        hits = Counter([w for w in WORD(text.lower()) if w[:first] in begun])
        return {number[t]: n for t, n in term_counts(hits).items() if t in number} if hits else {}


class BlockMaxIndex:
    """Examples in blocks, and for each term its largest weight in every block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int) -> None:
        # Alike examples next to one another make bounds tight.
        self.order = sorted(
            range(len(vectors)),
            key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]) if len(vectors[i][0]) else -1, i),
        )
        n = max(1, -(-len(vectors) // BLOCK))
        self.most = np.zeros((terms, n))
        self.row = np.full((n, terms), -1, np.int32)
        self.weights: list[np.ndarray] = []
        self.members: list[np.ndarray] = []
        for b in range(n):
            members = self.order[b * BLOCK : (b + 1) * BLOCK]
            held = np.unique(np.concatenate([vectors[i][0] for i in members] or [np.empty(0, np.int64)]))
            self.row[b, held] = np.arange(len(held))
            dense = np.zeros((len(held), len(members)))
            for column, i in enumerate(members):
                dense[self.row[b, vectors[i][0]], column] = vectors[i][1]
            self.most[held, b] = dense.max(axis=1, initial=0)
            self.weights.append(dense)
            self.members.append(np.array(members, np.int64))

    def nearest(
        self, at: np.ndarray, weight: np.ndarray, k: int, but: int = -1
    ) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples with the largest positive cosine, and the cosines; of equal ones, the
        first. ``but`` is left out."""
        bounds = weight @ self.most[at]
        found, cosines, last = [], [], 0.0
        for b in np.argsort(-bounds, kind="stable"):
            if bounds[b] <= 0 or bounds[b] + 1e-9 < last:
                break
            rows = self.row[b, at]
            there = rows >= 0
            scores = weight[there] @ self.weights[b][rows[there]]
            good = (scores > 0) & (scores >= last - 1e-9) & (self.members[b] != but)
            if not good.any():
                continue
            found.append(self.members[b][good])
            cosines.append(scores[good])
            if sum(map(len, found)) >= k:
                ids, own = np.concatenate(found), np.concatenate(cosines)
                best = np.lexsort((ids, -own))[:k]
                found, cosines, last = [ids[best]], [own[best]], float(own[best[-1]])
        if not found:
            return np.empty(0, np.int64), np.empty(0)
        ids, own = np.concatenate(found), np.concatenate(cosines)
        best = np.lexsort((ids, -own))[:k]
        return ids[best], np.minimum(own[best], 1.0)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function nearest to the points; pools are shrunk towards one half."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for xi, yi in zip(x[order], y[order]):
        pools.append([xi, xi, yi, 1.0])
        while len(pools) > 1 and (
            pools[-2][1] == pools[-1][0]
            or pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]
        ):
            low, high, s, n = pools.pop()
            pools[-1] = [pools[-1][0], high, pools[-1][2] + s, pools[-1][3] + n]
    knots, values = [], []
    for low, high, s, n in pools:
        value = (s + 0.5) / (n + 1)
        knots += [low, high] if high > low else [low]
        values += [value, value] if high > low else [value]
    return np.array(knots), np.maximum.accumulate(np.array(values))


class ToxicityModel:
    """Vocabulary, weights of its terms, examples, and the map from votes to probabilities."""

    def __init__(self, terms, idf, vectors, labels, ids) -> None:
        self.terms, self.idf, self.vectors = terms, idf, vectors
        self.labels, self.ids = np.asarray(labels, float), np.asarray(ids, np.int64)
        bare = np.array([not len(v[0]) for v in vectors], bool)
        told = self.labels[bare]
        #: What a text without any term gets; a half where nothing is known.
        self.base = (told.sum() + 0.5) / (len(told) + 1)
        self._prepare()
        votes = np.array([self.vote(*v, but=i)[0] for i, v in enumerate(vectors)])
        self.knots, self.values = (
            isotonic(votes, self.labels) if len(votes) else (np.array([0.0, 1.0]),) * 2
        )

    def _prepare(self) -> None:
        self.vocabulary = Vocabulary(self.terms)
        self.index = BlockMaxIndex(self.vectors, max(1, len(self.terms)))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("vocabulary", "index")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._prepare()

    def vote(self, at: np.ndarray, weight: np.ndarray, but: int = -1):
        if not len(at):
            return self.base, at, weight
        found, cosines = self.index.nearest(at, weight, K, but)
        say = 1 / (NEAR + 1 - cosines)
        share = (say @ self.labels[found] + PRIOR * self.base) / (say.sum() + PRIOR)
        return float(share), found, cosines

    def score(self, text: str) -> tuple[float, list[dict]]:
        at, weight = weighted(self.vocabulary.counts(text), self.idf)
        share, found, cosines = self.vote(at, weight)
        near = [
            {"id": int(self.ids[i]), "label": int(self.labels[i]), "cosine": float(c)}
            for i, c in zip(found, cosines)
        ]
        return float(np.interp(share, self.knots, self.values)), near


def weighted(counts: dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the terms, rising, and their weights as a vector of length 1."""
    at = np.array(sorted(counts), np.int64)
    if not len(at):
        return at, np.empty(0)
    weight = (1 + np.log([counts[i] for i in at.tolist()])) * idf[at]
    return at, weight / np.sqrt(weight @ weight)


def choose_terms(sample: DataFrame, most: int = TERMS) -> list[str]:
    """The terms whose rows in ``sample(text, y)`` depend most on the label, by chi-square."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), ROWS_AT_ONCE):
                held, toxic = Counter(), Counter()
                part = batch.iloc[at : at + ROWS_AT_ONCE]
                for text, y in zip(part["text"], part["y"]):
                    terms = list(term_counts(Counter(WORD(text.lower()))))
                    held.update(terms)
                    if y:
                        toxic.update(terms)
                yield pd.DataFrame(
                    {"term": list(held), "n": list(held.values()), "p": [toxic[t] for t in held]},
                    columns=["term", "n", "p"],
                )

    total = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("p")).first()
    rows = sample.select("y", "text").mapInPandas(count, "term string, n long, p long")
    seen = rows.groupBy("term").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    n, p = float(total.n), float(total.p)
    a, b = F.col("p"), F.col("n") - F.col("p")
    c, d = F.lit(p) - a, F.lit(n - p) - b
    chi = n * (a * d - b * c) ** 2 / (F.col("n") * (F.lit(n) - F.col("n")) * F.lit(p * (n - p)))
    best = (
        seen.filter(F.col("n") >= ROWS_WITH_TERM)
        .filter((F.col("n") < n) & F.lit(0 < p < n))
        .withColumn("chi", chi)
        .filter(F.col("chi") >= CHI_SQUARE)
    )
    return [r.term for r in best.orderBy(F.desc("chi"), "term").limit(most).select("term").collect()]


def document_frequencies(docs: DataFrame, terms: list[str]) -> tuple[int, np.ndarray]:
    """How many documents there are, and how many hold each term; all are counted.

    Every task forwards one number per term, whatever it read.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, n, held = Vocabulary(terms), 0, np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            n += len(batch)
            for text in batch["text"]:
                held[list(known.counts(text))] += 1
        held[-1] = n
        yield pd.DataFrame({"held": [held]})

    parts = docs.select(text_or_empty().alias("text")).mapInPandas(count, "held array<long>")
    sums = parts.select(F.posexplode("held").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n"))
    out = np.zeros(len(terms) + 1, np.int64)
    for row in sums.collect():
        out[row.i] = row.n
    return int(out[-1]), out[:-1]


def fit(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES) -> ToxicityModel:
    """Learn from at most ``most`` rows of ``docs`` that ``labels(doc_id, toxic)`` marks.

    Held-out rows are left out. Without any labelled row every score is one half.
    """
    sample = labelled_sample(docs, labels, "toxic", most)
    terms = choose_terms(sample)
    n, held = document_frequencies(docs, terms)
    idf = np.log((1 + n) / (1 + held)) + 1

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Vocabulary(terms)
        for batch in batches:
            pairs = [weighted(known.counts(t), idf) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "y": batch["y"],
                    "at": [p[0].tolist() for p in pairs],
                    "w": [p[1].tolist() for p in pairs],
                }
            )

    schema = "doc_id long, y int, at array<long>, w array<double>"
    rows = sample.select(F.col("doc_id").cast("long"), "text", "y").mapInPandas(vectors, schema)
    rows = rows.orderBy("doc_id").toPandas()
    pairs = [
        (np.asarray(a, np.int64), np.asarray(w, float)) for a, w in zip(rows["at"], rows["w"])
    ]
    return ToxicityModel(terms, idf, pairs, rows["y"].to_numpy(), rows["doc_id"].to_numpy())


def with_toxicity(docs: DataFrame, model: ToxicityModel, name: str = "toxicity") -> DataFrame:
    """``docs`` with a struct: ``score``, and as evidence the nearest ``neighbours``, best first.

    Scores are from 0 to 1 and depend on the text alone. A null or empty text, like any without a term
    of the model, has no neighbours and gets the share of toxic rows among such examples. Rows and
    other columns stay as they are; ``name`` must be new.
    """
    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("neighbours", NEIGHBOURS)])

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scored = [model.score(t) for t in batch]
            yield pd.DataFrame(
                {"score": [s for s, _ in scored], "neighbours": [n for _, n in scored]},
                columns=["score", "neighbours"],
            )

    return docs.withColumn(name, run(text_or_empty()))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns as they are."""
    name = new_name(docs, "toxicity")
    scored = with_toxicity(docs, fit(docs, labels), name)
    return scored.filter(F.col(name)["score"] < threshold).select(*[docs[c] for c in docs.columns])
