"""Text quality by Bradley-Terry ranking.

In a pair of documents, the one of good quality is preferred with probability
``1 / (1 + exp(-(s(good) - s(bad))))``, where ``s`` is linear in the features of a text. The weights
minimise the logistic loss on feature differences over pairs drawn from a bounded labelled sample.
The cut between good and bad is the quantile of the sample's scores that tells its labels apart
best; a score says how far above it a document stands.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlantern.llm.common import labelled_sample, new_name, text_or_empty

#: Bounds of the fit: labelled rows, and pairs drawn from them.
SAMPLE = 12_000
PAIRS = 60_000
RIDGE = 1e-3
STEPS = 30
THRESHOLD = 0.5

UPPER = np.arange(ord("A"), ord("Z") + 1)
LOWER = np.arange(ord("a"), ord("z") + 1)
DIGIT = np.arange(ord("0"), ord("9") + 1)
SYMBOL = np.array([ord(c) for c in "#$%&*+=<>@^_`{}|~\\/[]"])
STOP = np.array([ord(c) for c in ".!?"])
FEATURES = 19


def features(text: str) -> list[float]:
    """What the ranking sees of a whole text; every entry is finite, for the empty text too."""
    data = text.encode("utf-8", "surrogatepass")
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(1, len(data))
    words, lines = text.split(), [line for line in text.split("\n") if line.strip()]
    w = max(1, len(words))
    counts, rows = Counter(words), Counter(lines)
    letters = max(1, int(seen[UPPER].sum() + seen[LOWER].sum() + seen[128:].sum()))
    twice = sum(len(line) * c for line, c in rows.items() if c > 1)
    return [
        np.log1p(len(data)),
        np.log1p(len(words)),
        len(data) / w if words else 0.0,
        float(seen[UPPER].sum() / letters),
        float(seen[DIGIT].sum() / n),
        float(seen[SYMBOL].sum() / n),
        float(seen[ord("|")] / w),
        float(seen[ord("!")] / w),
        float(seen[STOP].sum() / w),
        float(seen[ord(",")] / w),
        float(seen[ord(" ")] / n),
        float(seen[128:].sum() / n),
        len(counts) / w,
        np.log1p(len(counts)) / np.log1p(w),
        max(counts.values(), default=0) / w,
        sum(map(eq, words, words[1:])) / w,
        twice / n,
        sum(line.rstrip()[-1] in ".!?" for line in lines) / max(1, len(lines)),
        float(len(words) / max(1, int(seen[STOP].sum()))) ** 0.5,
    ]


@dataclass
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.cut, -500, 500)))


def bradley_terry(better: np.ndarray, worse: np.ndarray) -> np.ndarray:
    """Weights by Newton's method on the logistic loss of feature differences, with a small ridge."""
    z = better - worse
    w = np.zeros(z.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        slope = z.T @ (p - 1) / len(z) + RIDGE * w
        curve = (z * (p * (1 - p))[:, None]).T @ z / len(z) + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def best_cut(scores: np.ndarray, y: np.ndarray) -> float:
    """The sample quantile of the scores with the fewest labels on its wrong side."""
    order = np.argsort(scores, kind="stable")
    s, good = scores[order], y[order] > 0
    wrong = np.concatenate([[0], np.cumsum(good)]) + np.concatenate(
        [np.cumsum((~good)[::-1])[::-1], [0]]
    )
    # A cut between equal scores is none.
    wrong = wrong + np.concatenate([[0], (s[1:] == s[:-1]) * len(s), [0]])
    best = np.flatnonzero(wrong == wrong.min())
    at = int(best[len(best) // 2])
    if at == 0 or at == len(s):
        return float(s[0] - 1) if at == 0 else float(s[-1] + 1)
    return float((s[at - 1] + s[at]) / 2)


def fit_quality(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> QualityModel:
    """Fit on the features and labels of a sample; with one label only, every score is one half."""
    mean = x.mean(axis=0) if len(x) else np.zeros(FEATURES)
    spread = np.maximum(x.std(axis=0), 1e-6) if len(x) else np.ones(FEATURES)
    good, bad = np.flatnonzero(y > 0), np.flatnonzero(y <= 0)
    if not len(good) or not len(bad):
        return QualityModel(mean, spread, np.zeros(FEATURES), 0.0)
    scaled = np.clip((x - mean) / spread, -6, 6)
    draw = np.random.default_rng(seed)
    n = min(pairs, len(good) * len(bad))
    weights = bradley_terry(scaled[draw.choice(good, n)], scaled[draw.choice(bad, n)])
    return QualityModel(mean, spread, weights, best_cut(scaled @ weights, y))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> QualityModel:
    """Learn from at most ``most`` rows of ``docs`` that ``labels(doc_id, quality)`` marks, held-out
    rows left out. Only the features of those rows come to the driver."""
    sample = labelled_sample(docs, labels, "quality", most)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "y": batch["y"], "x": [features(t) for t in batch["text"]]}
            )

    schema = "doc_id long, y int, x array<double>"
    rows = sample.select(F.col("doc_id").cast("long"), "text", "y").mapInPandas(measure, schema)
    rows = rows.orderBy("doc_id").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(-1, FEATURES)
    return fit_quality(x, rows["y"].to_numpy(float))


def with_quality(docs: DataFrame, model: QualityModel, name: str = "quality_score") -> DataFrame:
    """``docs`` with a score from 0 to 1, which depends on the whole text alone.

    A null text counts as empty, and that has a score like any other. Rows and other columns stay as
    they are, and rows that repeat get equal scores; an empty table stays empty; ``name`` must be new.
    """

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.array([features(t) for t in batch], float).reshape(-1, FEATURES)
            yield pd.Series(model.score(x))

    return docs.withColumn(name, run(text_or_empty()))


def drop_poor(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least the threshold, all columns as they are.

    A score equal to the threshold stays; of rows that repeat all stay or none. Without labels of both
    kinds every score is one half, and all rows stay at the default threshold.
    """
    name = new_name(docs, "quality_score")
    scored = with_quality(docs, fit(docs, labels), name)
    return scored.filter(F.col(name) >= threshold).select(*[docs[c] for c in docs.columns])
