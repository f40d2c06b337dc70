"""Quality classifier: hashed word and character n-gram vectors, averaged per document, softmax, trained by SGD."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, pieces, released, small_batches
from .rolling import Rolling, code_points, words_of

#: Hash buckets, vector length, character n-gram lengths.
BUCKETS, DIM, GRAMS = 1 << 18, 8, (3, 5)
#: The documented bound of the training sample: so many labelled documents of each class, least digest first.
PER_CLASS = 1500
EPOCHS, RATE, THRESHOLD = 4, 0.5, 0.3


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: bucket ids of all texts in order, and where each text's ids start (end as last)."""
    codes, starts = code_points(texts)
    rolling = Rolling(codes)
    ws, we = words_of(codes, starts)
    yield (rolling.slices(ws, we) % np.uint64(BUCKETS)).astype(np.int32), np.searchsorted(ws, starts)
    for q in GRAMS:
        ids = (rolling.grams(q) % np.uint64(BUCKETS)).astype(np.int32)
        lengths = np.diff(starts)
        inside = np.ones(len(ids), bool)
        ends = starts[1:]
        for back in range(1, q):  # no n-gram runs from one text into the next
            at = ends - back
            at = at[(at >= starts[:-1]) & (at < len(ids))]
            inside[at] = False
        yield ids[inside], np.r_[0, np.cumsum(np.maximum(lengths - q + 1, 0))]


def train(texts: list[str], labels: list[int], seed: int = 7) -> tuple[np.ndarray, float]:
    """Vectors E (BUCKETS x DIM) and softmax weights W by SGD; returns E @ (W[:, 1] - W[:, 0]) and the bias, all that
    scoring needs, since the output is linear in the average. No labels of both classes: zeros, so every score is .5."""
    rng = np.random.default_rng(seed)
    if len(set(labels)) < 2:
        return np.zeros(BUCKETS, np.float32), 0.0
    rows = []
    for a, b in pieces(texts):
        kinds = list(features(texts[a:b]))
        for i in range(b - a):
            ids = np.concatenate([k[s[i] : s[i + 1]] for k, s in kinds])
            rows.append(np.unique(ids, return_counts=True))
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    weights, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    y = np.asarray(labels)
    share = {c: 0.5 / max(1e-9, float(np.mean(y == c))) for c in (0, 1)}
    step, total = 0, EPOCHS * len(rows)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            ids, counts = rows[i]
            rate = RATE * (1 - step / total) * share[int(y[i])]
            step += 1
            if not len(ids):
                continue
            part = (counts / counts.sum()).astype(np.float32)
            mean = part @ vectors[ids]
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1.0
            back = weights @ p
            weights -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
            vectors[ids] -= (rate * len(ids) ** 0.5) * part[:, None] * back[None, :]
    return vectors @ (weights[:, 1] - weights[:, 0]), float(bias[1] - bias[0])


def score_texts(texts: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    """Softmax probability of label 1 for each text; a text without features gets the bias alone."""
    out = np.zeros(len(texts))
    for a, b in pieces(texts):
        total, n = np.zeros(b - a), np.zeros(b - a)
        for ids, starts in features(texts[a:b]):
            got = np.diff(starts)
            full = np.flatnonzero(got)
            if len(full):
                total[full] += np.add.reduceat(table[ids].astype(np.float64), starts[:-1][full])
            n += got
        out[a:b] = total / np.maximum(n, 1)
    return 1 / (1 + np.exp(-np.clip(out + bias, -60, 60)))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """Learns from at most per_class labelled documents of each class (the bound of the sample), in one task; labels
    of held-out documents are never read into it. The result is one table of fixed size."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality").distinct()
    usable = usable.withColumn("draw", F.md5(F.col("doc_id").cast("string")))
    picked = [usable.where(F.col("quality") == q).orderBy("draw", "doc_id").limit(per_class) for q in (0, 1)]
    sample = picked[0].unionByName(picked[1])
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(sample), "doc_id").repartition(1).sortWithinPartitions("draw", "doc_id", "text")

    def learn(batches):
        held, y = [], []
        for batch in batches:
            held += batch.column(0).to_pylist()
            y += batch.column(1).to_pylist()
        table, bias = train(held, y)
        yield pa.RecordBatch.from_arrays([pa.array([table.astype(np.float32).tobytes()], pa.binary()), pa.array([bias], pa.float64())], names=["table", "bias"])

    got = mapped(texts.select("text", "quality"), learn, "table binary, bias double").collect()
    if not got:
        return np.zeros(BUCKETS, np.float32), 0.0
    return np.frombuffer(got[0]["table"], np.float32), got[0]["bias"]


def scorer(spark, model):
    """A pandas UDF text -> score; the model (1 MB, of fixed size) goes out as a broadcast variable."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table, bias = shared.value
        for text in parts:
            yield pd.Series(score_texts(text.fillna("").tolist(), table, bias))
        released()

    return score


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1) and predicted (1: keep) added, for every row and whole text.

    Null and empty texts get the model's bias as score. Without usable labels of both classes every score is 0.5.
    Repeated rows get equal scores; null doc_ids count as not held out and are never learned from. Columns of docs
    named score or predicted are replaced.
    """
    small_batches(docs.sparkSession)
    score = scorer(docs.sparkSession, fit(docs, labels))
    return docs.withColumn("score", score("text")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
