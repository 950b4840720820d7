"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Features are the hashed character n-grams (of the lower-case text) that a document has, each once. r, the log ratio
of their smoothed frequencies in documents with and without the label, scales them; a logistic regression is fitted
on the scaled features.

Training reads a sample of at most ``most_rows`` labelled documents (those with the least hash of their id), so its
ids can be broadcast to the scan of the texts. Counts for r are summed over the sample; the regression is fitted on
groups of at most about ``group_rows`` documents, each in a task of its own, and the groups' weights are averaged.
The model is ``n_buckets`` numbers. Scoring is one pass over all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettercrate.llm.common import discard, written

N_BUCKETS = 1 << 20
SIZES = (3, 4, 5, 6)
MOST_ROWS, GROUP_ROWS = 16_000, 4_000
LEAST_DOCS, CERTAIN = 3, 2.5
#: Odd multipliers: one between characters of an n-gram, one that spreads the sum over the buckets.
SPREAD, LAST = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15


def buckets_of(text: str | None, n_buckets: int = N_BUCKETS, sizes: tuple[int, ...] = SIZES) -> np.ndarray:
    """The sorted buckets of the character n-grams of a text in lower case, with a space before and after it."""
    points = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    shift, marks = np.uint64(64 - int(n_buckets).bit_length() + 1), np.zeros(n_buckets, dtype=bool)
    step, spread, last = 1 << 20, np.uint64(SPREAD), np.uint64(LAST)
    for at in range(0, len(points), step):  # a very long text goes through in overlapping parts
        c = points[at : at + step + max(sizes) - 1].astype(np.uint64)
        code = c
        for n in range(1, max(sizes) + 1):
            if n > 1:
                code = code[:-1] * spread + c[n - 1 :]
            if n in sizes:
                marks[((code + np.uint64(n)) * last) >> shift] = True
            if len(code) < 2:
                break
    return np.flatnonzero(marks).astype(np.int32)


def training_rows(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, text, label of at most most_rows labelled documents outside the held-out third.

    Repeated labels of a document count as 1 if any is; null labels and ids are left out. Ids are ordered by a hash.
    """
    ids = labels.where("doc_id is not null and toxic is not null").where(~held_out())
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("label"))
    ids = ids.orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id").limit(most_rows)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # most_rows numbers at most


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def _ratios(rows: DataFrame, n_pos: int, n_neg: int, n_buckets: int, smoothing: float = 0.5) -> np.ndarray:
    """r for every bucket: the log ratio of the parts of labelled and other documents that have it, drawn towards 0 by
    CERTAIN standard errors, so that what chance may explain is 0."""
    sums = rows.select("label", F.explode("buckets").alias("bucket")).groupBy("bucket")
    sums = sums.agg(F.sum("label").alias("p"), F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCS).toPandas()  # n_buckets rows at most
    pos = sums["p"].to_numpy(dtype=float) + smoothing
    neg = (sums["n"] - sums["p"]).to_numpy(dtype=float) + smoothing
    ratio = np.log(pos / (n_pos + 2 * smoothing)) - np.log(neg / (n_neg + 2 * smoothing))
    sure = np.abs(ratio) - CERTAIN * np.sqrt(1 / pos + 1 / neg)
    out = np.zeros(n_buckets, dtype=np.float32)
    out[sums["bucket"].to_numpy(dtype=np.int64)] = np.sign(ratio) * np.maximum(sure, 0)
    return out


def _fit(lists: list[np.ndarray], label: np.ndarray, r: np.ndarray, rounds: int = 120, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights of r's features and the intercept: full-batch Adam on the log loss with squared-weight decay."""
    lists = [x[r[x] != 0] for x in lists]
    flat, ends = np.concatenate([[0], *lists]).astype(np.int64)[1:], np.cumsum([len(x) for x in lists])
    used = np.unique(flat)
    where = np.searchsorted(used, flat)
    scale, own = r[used].astype(float), np.repeat(np.arange(len(lists)), np.diff(np.concatenate([[0], ends])))
    w, m, v = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(used))
    b = mb = vb = 0.0
    for k in range(1, rounds + 1):
        z = np.bincount(own, weights=(w * scale)[where], minlength=len(lists)) + b
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label
        grad = np.bincount(where, weights=g[own], minlength=len(used)) * scale / len(lists) + decay * w
        gb = g.mean()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        rate = 0.05 / (1 + k / 60)
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**k)) / (math.sqrt(vb / (1 - 0.999**k)) + 1e-8)
    out = np.zeros(len(r))
    out[used] = w * scale
    return out, b


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, n_buckets: int = N_BUCKETS) -> tuple[np.ndarray, float]:
    """(a weight for each bucket, intercept). Without documents of both labels all weights are 0 and the intercept
    says that none, or all, have the label."""

    rows = written(training_rows(docs, labels, most_rows))  # the texts: their features are ten times as large, so they are made twice
    count = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("p")).first()
    if not 0 < count["p"] < count["n"]:
        return np.zeros(n_buckets, dtype=np.float32), 6.0 if count["p"] else -6.0

    def features(ratios=None):
        def per_batch(batches):
            r = None if ratios is None else ratios.value
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    found = [buckets_of(x, n_buckets) for x in part.column(1).to_pylist()]
                    found = pa.array(found if r is None else [b[r[b] != 0] for b in found], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([part.column(0), found, part.column(2).cast(pa.int32())], names=["doc_id", "buckets", "label"])

        return rows.select("doc_id", "text", "label").mapInArrow(per_batch, "doc_id bigint, buckets array<int>, label int")

    shared = docs.sparkSession.sparkContext.broadcast(_ratios(features(), count["p"], count["n"] - count["p"], n_buckets))
    groups = max(1, count["n"] // GROUP_ROWS)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id", kind="stable")
        w, b = _fit([np.asarray(x, dtype=np.int64) for x in group["buckets"]], group["label"].to_numpy(dtype=float), shared.value)
        at = np.flatnonzero(w)
        return pd.DataFrame({"bucket": np.append(at, -1), "weight": np.append(w[at], b), "n": len(group)})

    # few features have a ratio other than 0, so little is shuffled
    parts = features(shared).groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("g")).applyInPandas(fit, "bucket int, weight double, n int")
    mean = parts.groupBy("bucket").agg(F.sum(F.col("weight") * F.col("n")).alias("w")).toPandas()  # n_buckets rows at most
    discard(rows)
    weights = np.zeros(n_buckets + 1)
    weights[mean["bucket"].to_numpy(dtype=np.int64)] = mean["w"].to_numpy(dtype=float) / count["n"]
    return np.round(weights[:-1], 7).astype(np.float32), round(float(weights[-1]), 7)


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score, 0 to 1, for each row of docs (doc_id, text; other columns are ignored). A null text counts as
    empty; a text without any known n-gram gets the intercept's score."""
    weights, intercept = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def per_batch(batches: Iterable[pa.RecordBatch]):
        w = shared.value
        for batch in batches:
            z = [intercept + float(w[buckets_of(x.as_py(), len(w))].sum(dtype=float)) for x in batch.column(1)]
            found = 1 / (1 + np.exp(-np.clip(np.array(z, dtype=float), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(per_batch, "doc_id bigint, score double")
