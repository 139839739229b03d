"""Operator 9: quality classifier, hashed word n-gram logistic regression trained with FTRL."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, binary, crc_mod, ship, slices, words

BITS = 18


def features(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Distinct buckets of the text's words and word pairs."""
    ws = words(text)
    if not ws:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:]
    pairs *= np.uint64(0xD6E8FEB86659FD93)
    seen = np.zeros(1 << BITS, bool)
    seen[(h >> np.uint64(64 - BITS)).astype(np.int64)] = True
    seen[(pairs >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return np.flatnonzero(seen)


def ftrl(examples: list[tuple[np.ndarray, float]], epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, float]:
    """Follow-the-regularised-leader, each feature with its own rate. Returns weights and bias."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(i: np.ndarray | slice) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for buckets, y in examples:
            i = np.append(buckets, 1 << BITS)
            x = np.full(len(i), 1 / np.sqrt(max(1, len(buckets))))
            x[-1] = 1.0
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(slice(None))
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 16_000, shards: int = 1, epochs: int = 4, alpha: float = 8.0, beta: float = 0.05, l1: float = 0.0, l2: float = 0.0, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    """Weights from at most about ``max_rows`` labelled rows (the documented bound).

    Labels are thinned by a hash of the id to that expected number, which bounds what is
    broadcast; texts stay where they are and only buckets are shuffled. ``shards`` learners
    run FTRL on their rows in order of the hash, and their weights are averaged; one learner
    fits far better than the mean of several, and its rows are bounded by ``max_rows``. Without
    labelled rows all weights are zero. Null labels are left out; an id with several labels
    has their mean. Of a text of any length a learner holds at most 2**18 bucket numbers.
    """
    ship(docs.sparkSession)
    usable = labels.select(F.col(id_col).alias("label_id"), F.col(label).cast("double").alias("y")).where(F.col("y").isNotNull() & F.col("label_id").isNotNull()).groupBy("label_id").agg(F.avg("y").alias("y"))
    n = usable.count()
    order = F.pmod(F.xxhash64(F.lit("sample"), F.col("label_id")), F.lit(1 << 30))
    usable = usable.withColumn("order", order).where(F.col("order") < int((1 << 30) * min(1.0, max_rows / max(1, n))))
    rows = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).join(F.broadcast(usable), "label_id")

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in slices(batches):
            found = [features(t, hashes).astype(np.int32) for t in binary(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("order"), b.column("y"), pa.array(found, pa.list_(pa.int32()))], names=["order", "y", "buckets"])

    def learn(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["order", "y"], kind="stable")
        w, bias = ftrl(list(zip(part["buckets"], part["y"], strict=True)), epochs, alpha, beta, l1, l2)
        return pd.DataFrame({"shard": [key[0]], "w": [np.append(w, bias).tobytes()]})

    found = rows.mapInArrow(extract, "order long, y double, buckets array<int>")
    learned = found.groupBy(F.pmod("order", F.lit(shards)).alias("shard")).applyInPandas(learn, "shard long, w binary")
    # The driver gets one row of 2 MB for each learner.
    weights = [np.frombuffer(r["w"]) for r in sorted(learned.collect(), key=lambda r: r["shard"])]
    mean = sum(weights) / len(weights) if weights else np.zeros((1 << BITS) + 1)
    return mean[:-1], float(mean[-1])


def score(docs: DataFrame, weights: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score: the probability of label 1 for each whole text, in one pass without a shuffle.

    The weights are 2**18 numbers whatever the data, so they travel with the task. Null and
    empty texts have no words and score by the bias alone.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, hashes = held.value.astype(np.float64), WordHashes()
        for b in slices(batches):
            out = []
            for t in binary(b.column("text")):
                i = features(t, hashes)
                out.append(1 / (1 + np.exp(-np.clip(bias + w[i].sum() / np.sqrt(max(1, len(i))), -35, 35))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, fold: int = 5, threshold: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted. Rows whose crc32(id) mod ``fold`` is 0 are never learned from.

    Null and empty texts score by the bias alone. Null ids are not held out and have no label.
    Rows that repeat an id are learned from as often as they come, by the id's one label. Equal
    texts have equal scores; ties among training rows are broken by label, so reruns agree.
    Other columns are not read. An empty table gives an empty result.
    """
    mod = crc_mod("doc_id", fold)
    w, bias = train(docs, labels.where(mod != 0))
    out = score(docs, w, bias)
    return out.select("doc_id", F.coalesce(mod == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
