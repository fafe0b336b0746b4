"""Quality classifier: naive Bayes support vectors.

A text is a set of indicators: its hashed words and word pairs (A-Z lower-cased), and a few of its
shape (length, share of repeated 3-word windows, share of words without a letter or digit). Indicators are scaled by
the log ratio of their smoothed class counts, and a linear hinge-loss model is fitted on the scaled,
length-normalised vectors by dual coordinate descent; a sigmoid fitted to its margins gives the score.

Class counts, hinge loss and sigmoid are fitted on one bounded sample: the `TRAIN_ROWS` labelled
documents with the smallest hashed doc_id (all, if there are fewer). Labels are joined by doc_id and are
no input of a score. Every document is scored whole.

Defined results: a null or empty text is scored by its shape alone; without labels of both classes all
scores are 0.5; several labels of one doc_id count as the largest, and of several texts of one doc_id one is learnt
from (that of the smallest hash); a null doc_id is not held out and never learnt from; repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import column, lists, read, slices
from tidemill.llm.textarrays import buffer_of, mix, shingles, word_hashes, word_spans

#: Labelled documents that the model is fitted on, at most, and the buckets of hashed indicators.
TRAIN_ROWS, BITS = 12_000, 18
SHAPES = 64
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def indicators(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(indicator numbers of all texts one after another, how many each has)."""
    raw, offsets = buffer_of(texts)
    starts, ends, first = word_spans(raw, offsets)
    words = word_hashes(raw, starts, ends, lower=True)
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    pair = row[1:] == row[:-1]
    mask = np.uint64((1 << BITS) - 1)
    pairs = mix(words[:-1][pair] * np.uint64(0x9E3779B97F4A7C15) + words[1:][pair])
    three, three_row = shingles(words, first, 3)
    order = np.lexsort((three, three_row))
    same = (three[order][1:] == three[order][:-1]) & (three_row[order][1:] == three_row[order][:-1])
    repeats = np.bincount(three_row[order][1:][same], minlength=len(counts))
    total = np.concatenate(([0], np.cumsum(_ALNUM[raw])))
    bare = np.bincount(row[total[ends] == total[starts]], minlength=len(counts))
    twice = np.bincount(row[1:][pair & (words[1:] == words[:-1])], minlength=len(counts))
    share = lambda x: np.ceil(9 * x / np.maximum(counts, 1)).astype(np.int64).clip(0, 9)
    shape = [np.minimum(np.log2(counts + 1).astype(np.int64), 19), 20 + share(repeats), 30 + share(bare), 40 + share(twice)]
    key = [(row.astype(np.int64) << 32) | (words & mask).astype(np.int64), (row[1:][pair].astype(np.int64) << 32) | (pairs & mask).astype(np.int64)]
    key += [(np.arange(len(counts)) << 32) | ((1 << BITS) + s) for s in shape]
    key = np.unique(np.concatenate(key))
    return (key & 0xFFFFFFFF).astype(np.int32), np.bincount(key >> 32, minlength=len(counts))


def dual_descent(features: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, c: float = 1.0, epochs: int = 12, seed: int = 3) -> np.ndarray:
    """Weights of the L2-regularised hinge loss (classes weigh the same), by dual coordinate descent; the last is the bias."""
    w, alpha, rng = np.zeros(size + 1), np.zeros(len(y)), np.random.default_rng(seed)
    most = np.where(y > 0, c * len(y) / (2 * max((y > 0).sum(), 1)), c * len(y) / (2 * max((y < 0).sum(), 1)))
    norm = np.array([1.0 + float(v @ v) for v in values])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)).tolist():
            f, v = features[i], values[i]
            gradient = y[i] * (w[f] @ v + w[size]) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
                w[f] += step * v
                w[size] += step
        if moved < 1e-3:
            break
    return w


class Model:
    """Weights of the indicators, a bias, and the sigmoid's slope and offset."""

    def __init__(self, features: list[np.ndarray], labels: np.ndarray):
        size = (1 << BITS) + SHAPES
        self.known = 0 < labels.sum() < len(labels)
        if not self.known:
            return
        y = np.where(labels > 0, 1.0, -1.0)
        count = [1.0 + np.bincount(np.concatenate([f for f, t in zip(features, y, strict=True) if t == k]), minlength=size) for k in (1, -1)]
        ratio = np.log((count[0] / count[0].sum()) / (count[1] / count[1].sum()))
        values = [ratio[f] / np.sqrt(len(f)) for f in features]
        w = dual_descent(features, values, y, size)
        self.weights, self.bias = w[:-1] * ratio, w[-1]
        margins = np.array([self.weights[f].sum() / np.sqrt(len(f)) for f in features]) + self.bias
        self.slope, self.offset = 1.0, 0.0
        target = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
        for _ in range(50):  # Newton steps of the log loss
            p = 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -30, 30)))
            d, h = p - target, p * (1 - p) + 1e-9
            a, b, e = (h * margins**2).sum() + 1e-6, (h * margins).sum(), h.sum() + 1e-6
            g = np.array([(d * margins).sum(), d.sum()])
            det = a * e - b * b
            step = np.array([e * g[0] - b * g[1], a * g[1] - b * g[0]]) / max(det, 1e-12)
            self.slope, self.offset = self.slope - step[0], self.offset - step[1]
            if np.abs(step).max() < 1e-8:
                break

    def scores(self, texts: pa.Array) -> np.ndarray:
        f, n = indicators(texts)
        if not self.known:
            return np.full(len(n), 0.5)
        if not len(n):
            return np.zeros(0)
        # Row by row: a score must not hang on the rows beside it. Every row has indicators of its shape.
        margin = np.add.reduceat(self.weights[f], np.cumsum(n) - n) / np.sqrt(n) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """A model of the labelled documents that are not held out; `rows` bounds the sample."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).alias("_label")).where("_id is not null and _label is not null")
    known = known.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_label").cast("int").alias("_label"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)  # the bound of what is broadcast

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            f, n = indicators(column(part, "text"))
            yield pa.record_batch({"label": column(part, "_label"), "id": column(part, "_id"), "features": lists(f, n)})

    found = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("_id", "_label", "text")
    found = found.groupBy("_id", "_label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))  # one row a doc_id
    found = found.mapInArrow(described, "label int, id long, features array<int>").toArrow().sort_by("id")
    features = found["features"].combine_chunks()
    at, flat = features.offsets.to_numpy(), features.values.to_numpy()
    return Model([flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], found["label"].to_numpy())


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.record_batch({"doc_id": column(part, "doc_id"), "score": shared.value.scores(column(part, "text"))})

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return scored(docs, fit(docs, read(spark, sf_dir, "labels")))
