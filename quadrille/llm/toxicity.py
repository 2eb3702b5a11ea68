"""Toxicity by cumulative-link ordinal regression on sparse text features (operator 1).

Severity grades 0 < 1 < ... < K-1 share one weight vector w over word-presence features;
ordered thresholds t1 < ... separate them: P(grade >= k) = sigmoid(w.x - t_k).  The
result is the expected severity, the sum of those probabilities.

Grades for training come from 0/1 labels: clean documents have grade 0, toxic ones
rise with the number of distinct words that are over-represented in toxic documents.
Only a bounded sample of labelled rows is used for fitting (``max_train``); word counts
of the sample are taken on the executors, and the driver sees no more than ``max_train``
rows of at most ``max_features`` word numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass(frozen=True)
class OrdinalModel:
    features: tuple[str, ...]
    weights: np.ndarray
    thresholds: np.ndarray

    def exceed(self, margin: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., a row for each margin w.x."""
        return _sigmoid(np.asarray(margin)[:, None] - self.thresholds[None, :])


def fit_ordinal(x: np.ndarray, y: np.ndarray, n_grades: int, l2: float = 2e-5, steps: int = 1500, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by maximum likelihood (Adam on the full batch).

    Thresholds are a first one plus positive steps, so they stay ordered.  Grades that
    never occur only move their threshold.
    """
    n, d = x.shape
    theta = np.zeros(d + n_grades - 1)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    rows = np.arange(n)
    for step in range(1, steps + 1):
        w, raw = theta[:d], theta[d:]
        gaps = np.exp(np.clip(raw[1:], -10, 10))
        t = raw[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        above = np.hstack([np.ones((n, 1)), _sigmoid((x @ w)[:, None] - t[None, :]), np.zeros((n, 1))])
        here, after = above[rows, y], above[rows, y + 1]
        p = np.maximum(here - after, 1e-12)
        up, down = here * (1 - here) / p, after * (1 - after) / p  # slope of log p by each sigmoid's argument
        slope = np.zeros((n, n_grades + 1))
        slope[rows, y] += up
        slope[rows, y + 1] -= down
        by_t = -slope[:, 1:n_grades].sum(axis=0) / n
        gradient = np.concatenate([x.T @ (up - down) / n - l2 * w, [by_t.sum()], [by_t[k + 1 :].sum() * g for k, g in enumerate(gaps)]])
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        theta = theta + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(np.clip(theta[d + 1 :], -10, 10))
    return theta[:d], theta[d] + np.concatenate([[0.0], np.cumsum(gaps)])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", n_grades: int = 4, max_train: int = 20_000, max_features: int = 1024, least_z: float = 6.0, least_docs: int = 5) -> OrdinalModel:
    """Fit on at most ``max_train`` labelled rows, chosen by a hash of the key.

    Rows whose key or label is null or that have no document are not used; equal texts
    count once, as copies would make their rare words look telling; of several texts of one
    key all count, up to ``max_train`` in all.  Without any toxic or
    any clean row the model has no features and grades everything 0.
    """
    chosen = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).dropna().groupBy("_k").agg(F.max("_y").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("_k"), "_k").limit(max_train)
    # at most max_train pairs of numbers, so the broadcast has a proven bound
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(chosen), "_k")

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"_h": frame["_h"], "_y": frame["_y"], "words": [sorted(words_of(t)) for t in frame["_t"]]})

    found = rows.select(F.xxhash64("_t").alias("_h"), "_y", "_t").mapInPandas(features, "_h long, _y int, words array<string>")
    found = found.groupBy("_h").agg(F.max("_y").alias("_y"), F.first("words").alias("words")).orderBy("_h").limit(max_train).persist()
    try:
        n_clean, n_toxic = (found.where(F.col("_y") == v).count() for v in (0, 1))
        if not n_clean or not n_toxic:
            return OrdinalModel((), np.zeros(0), np.full(n_grades - 1, 40.0))
        counted = found.select(F.explode("words").alias("w"), "_y").groupBy("w").agg(F.sum("_y").alias("a"), F.count("*").alias("n"))
        share = n_toxic / (n_toxic + n_clean)
        # how far the word's share of toxic documents is from the general one, in standard errors
        z = (F.col("a") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
        top = counted.where(F.col("n") >= least_docs).withColumn("z", z).where(F.abs("z") >= least_z).orderBy(F.abs("z").desc(), "w").limit(max_features).collect()
        names = tuple(r["w"] for r in top)
        toxic_words = F.array(*[F.lit(r["w"]) for r in top if r["z"] > 0]).cast("array<string>")
        kept = found.select("_y", F.array_intersect("words", F.array(*map(F.lit, names)).cast("array<string>")).alias("f"), F.size(F.array_intersect("words", toxic_words)).alias("hits")).collect()
    finally:
        found.unpersist()
    at = {w: i for i, w in enumerate(names)}
    x = np.zeros((len(kept), len(names)))
    for i, r in enumerate(kept):
        x[i, [at[w] for w in r["f"]]] = 1
    y = np.array([r["_y"] for r in kept])
    hits = np.array([r["hits"] for r in kept])
    cuts = np.quantile(hits[y > 0], np.arange(1, n_grades - 1) / (n_grades - 1))
    grade = np.where(y > 0, 1 + (hits[:, None] > cuts[None, :]).sum(axis=1), 0)
    weights, thresholds = fit_ordinal(x, grade, n_grades)
    return OrdinalModel(names, weights, thresholds)


def score(docs: DataFrame, model: OrdinalModel, text: str = "text", reject_from: float = 0.5) -> DataFrame:
    """``docs`` with expected_severity, p_toxic (of grade 1 or more) and rejected.

    A null or empty text has no features.  Existing columns of these names are replaced.
    The model that goes to the executors has at most ``max_features`` words.
    """
    added = ["expected_severity", "p_toxic", "rejected"]
    weight = dict(zip(model.features, model.weights.tolist()))
    names = weight.keys()

    @F.pandas_udf("struct<expected_severity double, p_toxic double, rejected boolean>")
    def severity(texts: pd.Series) -> pd.DataFrame:
        margin = [sum(map(weight.__getitem__, sorted(names & words_of(t)))) for t in texts]
        p = model.exceed(np.array(margin, dtype=float))
        return pd.DataFrame({"expected_severity": p.sum(axis=1), "p_toxic": p[:, 0], "rejected": p[:, 0] >= reject_from})

    kept = docs.drop(*added)
    return kept.withColumn("_s", severity(F.col(text))).select(*[F.col(f"`{c}`") for c in kept.columns], "_s.*")
