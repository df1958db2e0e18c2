"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k | x) = sigmoid(threshold_k - w.x): one weight per hashed text feature, shared by all grades, and ordered thresholds.
Features are the distinct words, word beginnings and symbol runs of the whole text and a few coarse shape measures, hashed to 2**BITS slots; of
these only slots seen in MIN_DOCS training documents carry a weight. Training takes at most SAMPLE labelled rows, those
with the smallest hash of their id, and runs on the driver over the sparse rows; scoring runs in the tasks over every document.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

SAMPLE = 16_000  # labelled rows that the weights are fitted on, at most
BITS = 30
MIN_DOCS = 4
PENALTY = 5e-4
STEPS = 80
RATE = 0.2
KEEP_TAIL = 2  # a document is kept when its grade is at least this ...
KEEP_PROBABILITY = 0.5  # ... with at least this probability
TOKENS = re.compile(r"[^\W_]+|[^\w\s]+|_+")
KEPT = 500_000
FIT_ROWS = 1_024
PREFIX = 4


def shape(text: str, tokens: list[str]) -> list[str]:
    """Coarse measures of the whole text as feature names."""
    n = max(1, len(tokens))
    letters = max(1, len(text))
    upper = sum(map(len, re.findall(r"[A-ZÀ-ÖØ-Þ]+", text))) / letters
    again = sum(a == b for a, b in zip(tokens, tokens[1:])) / n
    symbols = sum(map(len, re.findall(r"[^\w\s]+", text))) / letters
    return [f"\x00upper{int(upper * 10)}", f"\x00again{int(again * 10)}", f"\x00symbol{int(symbols * 20)}", f"\x00size{min(6, n.bit_length() // 2)}"]


def features(text: str | None) -> set[str]:
    tokens = TOKENS.findall((text or "").lower())
    words = set(tokens)
    return {*words, *["\x01" + w[:PREFIX] for w in words if len(w) > PREFIX], *shape(text or "", tokens)}


def slot(feature: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(feature.encode("utf-8", "surrogatepass")) >> (64 - BITS)


@dataclass
class Model:
    slots: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...: one column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def fit(rows: list[np.ndarray], grades: np.ndarray, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> Model:
    """Full-batch Adam on the cumulative-link likelihood; thresholds stay ordered by construction (first one and positive gaps)."""
    top, n = max(1, int(grades.max(initial=0))), len(rows)
    flat = np.concatenate(rows).astype("int32") if n else np.empty(0, dtype="int32")  # BITS of 30 fit
    sizes = [len(r) for r in rows]
    slots, counts = np.unique(flat, return_counts=True)
    slots = slots[counts >= MIN_DOCS]
    at = np.searchsorted(slots, flat).astype("int32")
    known = slots[np.minimum(at, len(slots) - 1)] == flat if len(slots) else np.zeros(len(flat), dtype=bool)
    at, owner, d = at[known], np.repeat(np.arange(n, dtype="int32"), sizes)[known], len(slots)
    del flat, known, counts
    if not n:
        return Model(slots, np.zeros(0), np.arange(top, dtype="float64"))
    edges = [*range(0, n, FIT_ROWS), n]
    blocks = [(a, b, *np.searchsorted(owner, [a, b])) for a, b in zip(edges[:-1], edges[1:])]  # keeps what a step allocates small
    p = np.zeros(d + top)
    p[d] = -2.0
    first, second = np.zeros_like(p), np.zeros_like(p)
    low, high = np.maximum(grades - 1, 0), np.minimum(grades, top - 1)
    for step in range(1, steps + 1):
        theta = p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1:]))])
        score = np.concatenate([np.bincount(owner[x:y] - a, p[at[x:y]], b - a) for a, b, x, y in blocks])
        upper = np.where(grades < top, 1 / (1 + np.exp(np.clip(score - theta[high], -50, 50))), 1.0)
        lower = np.where(grades > 0, 1 / (1 + np.exp(np.clip(score - theta[low], -50, 50))), 0.0)
        mass = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / mass, lower * (1 - lower) / mass
        g = np.zeros_like(p)
        pull = (du - dl) / n
        for _, _, x, y in blocks:
            g[:d] += np.bincount(at[x:y], pull[owner[x:y]], d)
        g[:d] += penalty * p[:d]
        to_theta = (np.bincount(low, dl * (grades > 0), top) - np.bincount(high, du * (grades < top), top)) / n
        g[d] = to_theta.sum()
        after = np.cumsum(to_theta[::-1])[::-1]
        g[d + 1:] = after[1:] * np.exp(p[d + 1:])
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        p = p - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    theta = p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1:]))])
    return Model(slots, p[:d], theta)


class Weights(dict):
    """Weight by feature, filled from the model on demand."""

    def __init__(self, model: Model):
        super().__init__()
        self.known = dict(zip(model.slots.tolist(), model.weights.tolist()))

    def __missing__(self, feature: str) -> float:
        w = self.known.get(slot(feature), 0.0)
        if len(self) >= KEPT:
            self.clear()
        if len(feature) <= 64:
            self[feature] = w
        return w


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 toxic, 1 of low quality, 2 good. The worst of several labels holds; rows with a null don't count."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & F.col("quality").isNotNull())
    return known.groupBy("doc_id").agg(F.min(grade).alias("grade"))


def train(docs: DataFrame, grades: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Model from at most `sample` graded documents, those of docs with the smallest id hashes; None if docs holds no graded one.
    Their feature slots, never their texts, reach the driver."""
    present = grades.join(docs.select("doc_id"), "doc_id", "left_semi")
    taken = present.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    @F.pandas_udf("binary")
    def slots(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(np.array([slot(f) for f in features(t)], dtype="int32")).tobytes() for t in texts])

    rows = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").select("doc_id", "grade", slots("text").alias("slots"))
    rows = rows.dropDuplicates(["doc_id", "slots"]).orderBy("doc_id", "slots").limit(sample).collect()
    if not rows:
        return None
    return fit([np.frombuffer(r.slots, dtype="int32") for r in rows], np.array([r.grade for r in rows]))


def rate(docs: DataFrame, model: Model | None, tail: int = KEEP_TAIL, probability: float = KEEP_PROBABILITY, text: str = "text") -> DataFrame:
    """docs with expected_grade, tail_probability (of a grade of at least `tail`) and kept; columns of these names are replaced.

    Null and empty texts are rated by their shape alone. Without a model nothing is rated (nulls) and every row is kept.
    Repeated rows are rated each; empty tables work; all other columns pass through.
    """
    rest = docs.drop("expected_grade", "tail_probability", "kept")
    if model is None:
        return rest.select("*", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_probability"), F.lit(True).alias("kept"))

    @F.pandas_udf("expected double, tail double")
    def rated(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights = Weights(model)
        for texts in batches:
            score = np.array([sum(map(weights.__getitem__, features(t))) for t in texts])
            tails = model.tails(score)
            yield pd.DataFrame({"expected": tails.sum(axis=1), "tail": tails[:, min(tail, tails.shape[1]) - 1]})

    out = rest.withColumn("_rated", rated(text))
    return out.select(*[F.col(f"`{c}`") for c in rest.columns], F.col("_rated.expected").alias("expected_grade"), F.col("_rated.tail").alias("tail_probability"),
                      (F.col("_rated.tail") >= probability).alias("kept"))


def op10_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, graded(table(spark, sf_dir, "labels")))
    return rate(docs, model).select("doc_id", "expected_grade", "tail_probability", "kept")
