"""Quality by importance resampling (operator 5).

Two bag-of-hashed-n-gram models, one of target text and one of the raw corpus, give each
document a log importance weight, the sum over its n-grams of log p_target - log p_raw.
Adding independent Gumbel noise and keeping the k largest keys draws k documents without
replacement in proportion to their weights.

Counts of the raw model cover every document: each task adds up its own documents and
sends one row per bucket, so what is shuffled is buckets x tasks, never n-grams.  The
target model counts at most MAX_TARGET labelled documents in the same scan: their keys
are broadcast, so no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import unit_interval

#: Buckets of hashed n-grams; one half is for single words, one for pairs.
BUCKETS = 1 << 17
#: Labelled documents, chosen by a hash of their key, that the target model counts and that the cut is set by.
MAX_TARGET, MAX_CALIBRATION = 20_000, 20_000
_REMEMBERED = 100_000


class _WordNumbers(dict):
    def __missing__(self, word: str) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(word) <= 48:
            if len(self) >= _REMEMBERED:
                self.clear()
            self[word] = found
        return found


@lru_cache(maxsize=1)
def _numbers() -> _WordNumbers:
    return _WordNumbers()


def ngram_buckets(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of every word and of every pair of neighbouring words."""
    words = (text or "").split()
    ids = np.fromiter(map(_numbers().__getitem__, words), dtype=np.uint64, count=len(words))
    half = np.uint64(buckets // 2)
    pairs = (ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.concatenate([ids % half, (pairs >> np.uint64(32)) % half + half]).astype(np.int64)


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, wanted: Column | None = None) -> DataFrame:
    """(bucket, n, n_wanted) over all n-grams of all documents, and of those for which ``wanted`` is true."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, some = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        for frame in frames:
            for value, flag in zip(frame["_t"], frame["_w"]):
                found = ngram_buckets(value, buckets)
                np.add.at(total, found, 1)
                if flag:
                    np.add.at(some, found, 1)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at], "n_wanted": some[at]})

    flag = F.lit(False) if wanted is None else F.coalesce(wanted, F.lit(False))
    counted = docs.select(F.col(text).alias("_t"), flag.alias("_w")).mapInPandas(count, "bucket long, n long, n_wanted long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("n_wanted").alias("n_wanted"))


def log_model(counts: np.ndarray, smoothing: float) -> np.ndarray:
    """Log probabilities of the buckets, the words' half and the pairs' half each adding to 1."""
    smooth = counts + smoothing
    halves = smooth.reshape(2, -1)
    return np.log(halves / halves.sum(axis=1, keepdims=True)).ravel()


def target_keys(labels: DataFrame, key: str = "doc_id", label: str = "quality", max_target: int = MAX_TARGET) -> DataFrame:
    """The keys of the documents of the target model: labelled 1, at most ``max_target`` by a hash, without nulls or repeats."""
    good = labels.where(F.col(label) == 1).select(F.col(key).alias("_good")).dropna().distinct()
    return good.orderBy(F.xxhash64("_good"), "_good").limit(max_target)


def log_ratios(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, smoothing: float = 0.5) -> np.ndarray:
    """log p_target - log p_raw of every bucket; ``target`` holds the distinct keys ``_good`` of a bounded number of documents.

    The raw model counts all of ``docs``; the target's is smoothed by the raw model
    (weight ``smoothing`` x buckets), so a bucket that neither knows says nothing.
    """
    marked = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(target), F.col("_key") == F.col("_good"), "left")
    raw, wanted = np.zeros(buckets), np.zeros(buckets)
    for r in bucket_counts(marked, "_text", buckets, F.col("_good").isNotNull()).collect():  # at most ``buckets`` rows
        raw[r["bucket"]], wanted[r["bucket"]] = r["n"], r["n_wanted"]
    prior = np.exp(log_model(raw, smoothing))
    return log_model(wanted + prior * smoothing * buckets, 1e-9) - np.log(prior)


def score(docs: DataFrame, ratios: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with n_grams, log_weight (the sum) and mean_log_ratio (0 for a text without words)."""
    buckets = len(ratios)

    @F.pandas_udf("struct<n_grams long, log_weight double, mean_log_ratio double>")
    def weigh(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for value in texts:
            found = ngram_buckets(value, buckets)
            total = float(ratios[found].sum()) if len(found) else 0.0
            rows.append((len(found), total, total / len(found) if len(found) else 0.0))
        return pd.DataFrame(rows, columns=["n_grams", "log_weight", "mean_log_ratio"])

    kept = docs.drop("n_grams", "log_weight", "mean_log_ratio")
    return kept.withColumn("_s", weigh(F.col(text))).select(*[F.col(f"`{c}`") for c in kept.columns], "_s.*")


def gumbel(seed: int, *columns: Column | str) -> Column:
    """Standard Gumbel noise that depends on the columns alone, so a lost task draws the same again."""
    return -F.log(-F.log(unit_interval(F.lit(seed), *columns)))


def kth_largest(keys: DataFrame, column: str, k: int, fan: int = 4096, rounds: int = 12) -> float | None:
    """The k-th largest value of a double column, exactly, without sorting or gathering it.

    Each round splits the range that holds it into ``fan`` parts and counts them, so the
    driver sees ``fan`` rows; it ends when the range holds a single value.  None if there
    are fewer than k values.
    """
    values = keys.select(F.col(column).alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if k > n or k < 1:
        return None
    for _ in range(rounds):
        if low == high:
            break
        width = (high - low) / fan
        inside = values.where((F.col("v") >= low) & (F.col("v") <= high))
        if width == 0 or low + width == low:
            parts = [(r["v"], r["v"], r["n"]) for r in inside.groupBy("v").agg(F.count("*").alias("n")).orderBy(F.desc("v")).collect()]
        else:
            part = F.floor((F.col("v") - low) / width)
            parts = [(r["a"], r["b"], r["n"]) for r in inside.groupBy(part.alias("p")).agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count("*").alias("n")).orderBy(F.desc("p")).collect()]
        for a, b, count in parts:
            if k <= count:
                low, high = a, b
                break
            k -= count
    return high


def sample_key(key: str = "doc_id", seed: int = 17) -> Column:
    """log_weight + Gumbel noise, of a scored table; the noise depends on the key and the row's weight."""
    return F.col("log_weight") + gumbel(seed, F.col(key), F.col("log_weight"), F.col("n_grams"))


def sampling_threshold(scored: DataFrame, k: int, key: str = "doc_id", seed: int = 17) -> float:
    """The k-th largest sample key: rows with a key of at least that are the sample.

    Rows that tie with it, as repeated rows do, are all in the sample.  k of at least the
    number of rows selects all, 0 none.
    """
    if k <= 0:
        return float("inf")
    least = kth_largest(scored.withColumn("_key", sample_key(key, seed)), "_key", k)
    return float("-inf") if least is None else least


def calibrate(scored: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", max_rows: int = MAX_CALIBRATION) -> float:
    """The mean log ratio that best splits labelled rows (balanced accuracy), on at most ``max_rows`` of them.

    Rows of one key count as one, with their mean.
    """
    chosen = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).dropna().groupBy("_k").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_k"), "_k").limit(max_rows)
    rows = scored.select(F.col(key).alias("_k"), "mean_log_ratio").join(F.broadcast(chosen), "_k").groupBy("_k", "_y").agg(F.avg("mean_log_ratio").alias("mean_log_ratio")).select("_y", "mean_log_ratio").collect()
    y = np.array([r[0] for r in rows], dtype=int)
    s = np.array([r[1] for r in rows], dtype=float)
    if not (y == 1).any() or not (y == 0).any():
        return float("-inf")
    order = np.argsort(s, kind="stable")
    good, bad = np.cumsum(y[order] == 1), np.cumsum(y[order] == 0)  # at or below each score
    gain = bad / bad[-1] - good / good[-1]
    best = int(np.argmax(gain))
    above = s[order[best + 1]] if best + 1 < len(s) else s[order[best]]
    return float((s[order[best]] + above) / 2)
