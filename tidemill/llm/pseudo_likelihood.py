"""Scoring documents by masked pseudo-likelihood.

Every token is predicted from the tokens on both sides of it: `side` to the left and `side` to the right,
each through an embedding table of its place; their sum passes a tanh and two softmax layers, first over
classes of tokens, then over the tokens of the class, so a conditional probability is exact and costs
twice the square root of the vocabulary.

The network's tokens are the most frequent words of all documents (A-Z lower-cased), counted over the whole
table; other words share hashed tokens, and one token pads the ends of a text. The probability of a word that shares
a token is the token's times the word's share of all words of that token, by their counts, so every word of the
corpus has a probability of its own and they sum to one. A document's score is the sum of the log-probabilities of its
words. The counts grow with the corpus and meet the documents' words in a join by word. Training is stochastic
gradient descent (Adagrad) in numpy, all tokens of the table once: rows are dealt over rounds and shards by a hash
of text and doc_id, and a shard's rows are sorted by it, so the model follows the rows and not their partitions. In
each round every shard starts from the same weights, and the weights are averaged by tokens in Spark. What
is gathered is one set of weights a shard and round, summed per weight before it reaches the driver, so it
follows the input while the driver holds one set.

Defined results: a null, empty or wordless text has n_tokens 0, log_prob 0 and a null mean; repeated rows
get equal scores (in double precision, row by row, rounded to six places); other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import column, lists, read, saved, slices
from tidemill.llm.textarrays import buffer_of, word_hashes, word_spans

#: Classes and tokens of a class; of all tokens, the last SHARED (a power of two) are shared by hashed words.
CLASSES, SHARED = 32, 128
SIZE = CLASSES * CLASSES
#: Words of a shard, about, and the most shards of a round: beyond that shards grow.
SHARD, SHARDS = 1 << 20, 20_000


class Network:
    """Weights, kept as one vector of which the layers are views."""

    def __init__(self, side: int = 2, width: int = 8, seed: int = 5, kind: type = np.float32):
        self.side, self.width, self.kind = side, width, kind
        self.shapes = {"tables": (2 * side, SIZE + 1, width), "classes": (CLASSES, width + 1), "tokens": (CLASSES, CLASSES, width + 1)}
        rng = np.random.default_rng(seed)
        self.load(rng.normal(0, 0.3, sum(int(np.prod(s)) for s in self.shapes.values())))

    def load(self, weights: np.ndarray) -> None:
        self.weights, at = weights.astype(self.kind), 0
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            setattr(self, name, self.weights[at : at + n].reshape(shape))
            at += n

    def _hidden(self, around: np.ndarray) -> np.ndarray:
        h = self.tables[0][around[0]]
        for k in range(1, len(around)):
            h = h + self.tables[k][around[k]]
        return np.tanh(h)

    def log_probs(self, around: np.ndarray, token: np.ndarray, train: float = 0.0, sums: dict | None = None) -> np.ndarray:
        """The log-probability of each token given the tokens around it; with `train`, one step at that rate."""
        group, member = token // CLASSES, token % CLASSES
        order = np.argsort(group.astype(np.uint8), kind="stable")
        around, group, member = around[:, order], group[order], member[order]
        ends = np.searchsorted(group, np.arange(CLASSES + 1))
        h = self._hidden(around)
        n, each = len(token), np.arange(len(token))
        p = h @ self.classes[:, :-1].T + self.classes[:, -1]
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        out = np.log(np.maximum(p[each, group], 1e-30))
        q = np.empty((n, CLASSES), self.kind)
        for c in range(CLASSES):
            a, b = ends[c], ends[c + 1]
            if a < b:
                q[a:b] = h[a:b] @ self.tokens[c, :, :-1].T + self.tokens[c, :, -1]
        q -= q.max(1, keepdims=True)
        np.exp(q, out=q)
        q /= q.sum(1, keepdims=True)
        out += np.log(np.maximum(q[each, member], 1e-30))
        if train:
            p[each, group] -= 1
            q[each, member] -= 1
            dh = p @ self.classes[:, :-1]
            step = {"classes": np.concatenate((p.T @ h, p.sum(0)[:, None]), 1), "tokens": np.zeros(self.tokens.shape, np.float32), "tables": np.zeros(self.tables.shape, np.float32)}
            for c in range(CLASSES):
                a, b = ends[c], ends[c + 1]
                if a < b:
                    dh[a:b] += q[a:b] @ self.tokens[c, :, :-1]
                    step["tokens"][c, :, :-1] = q[a:b].T @ h[a:b]
                    step["tokens"][c, :, -1] = q[a:b].sum(0)
            dh *= 1 - h * h
            for k in range(len(around)):
                for d in range(self.width):
                    step["tables"][k, :, d] = np.bincount(around[k], dh[:, d], SIZE + 1)
            for name, g in step.items():
                sums[name] += g * g
                getattr(self, name)[...] -= train * g / np.sqrt(sums[name] + 1e-6)
        result = np.empty(n)
        result[order] = out
        return result


class Vocabulary:
    def __init__(self, words: np.ndarray):
        keep = words[: SIZE - SHARED]
        order = np.argsort(keep)
        self.words, self.ids = keep[order], order.astype(np.int64)

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(token of every word of all texts, each text's first word)."""
        return self.hashed(texts)[1:]

    def hashed(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of every word of all texts, its token, each text's first word)."""
        raw, offsets = buffer_of(texts)
        starts, ends, first = word_spans(raw, offsets)
        words = word_hashes(raw, starts, ends, lower=True)
        out = (SIZE - SHARED + words % np.uint64(SHARED)).astype(np.int64)
        if len(self.words) and len(words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            out = np.where(self.words[at] == words, self.ids[at], out)
        return words, out, first


def around(tokens: np.ndarray, first: np.ndarray, side: int) -> np.ndarray:
    """The tokens at the 2 * side places around each token of the same text; SIZE pads."""
    counts = np.diff(first)
    low, high = np.repeat(first[:-1], counts), np.repeat(first[1:], counts)
    here, out = np.arange(len(tokens)), []
    for d in [*range(-side, 0), *range(1, side + 1)]:
        at = here + d
        out.append(np.where((at >= low) & (at < high), tokens[at.clip(0, max(len(tokens) - 1, 0))], SIZE))
    return np.array(out)


def counted(docs: DataFrame) -> DataFrame:
    """(word, n) for the hash of every word of docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 16 << 20):
            raw, at = buffer_of(column(part, "text"))
            starts, ends, _ = word_spans(raw, at)
            w, n = np.unique(word_hashes(raw, starts, ends, lower=True), return_counts=True)
            yield pa.record_batch({"word": w.view(np.int64), "n": n.astype(np.int64)})

    return saved(docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))


def vocabulary(docs: DataFrame, counts: DataFrame | None = None) -> Vocabulary:
    top = (counted(docs) if counts is None else counts).orderBy(F.desc("n"), "word").limit(SIZE - SHARED).toArrow()
    return Vocabulary(top["word"].to_numpy().view(np.uint64))


def train(docs: DataFrame, words: Vocabulary, rounds: int = 2, batch: int = 4096, rate: float = 0.1, side: int = 2, width: int = 8, size: int | None = None) -> Network:
    """A network that has met every token of docs once; `size` is the number of their words, if known."""
    net, spark = Network(side, width), docs.sparkSession
    if size is None:
        size = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    shards = int(min(max(1, -(-size // (rounds * SHARD))), SHARDS))
    dealt = docs.where("text is not null").select("text", F.xxhash64("text", "doc_id").alias("h"))
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((words, net.weights))

        def learn(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            words, weights = shared.value
            own, seen = Network(side, width), 0
            own.load(weights)
            sums = {name: np.zeros(shape, np.float32) for name, shape in own.shapes.items()}
            for part in slices(batches, "text", 1 << 20):
                tokens, first = words.tokens(column(part, "text"))
                near = around(tokens, first, side)
                order = np.random.default_rng(seen).permutation(len(tokens))
                for k in range(0, len(order), batch):
                    some = order[k : k + batch]
                    own.log_probs(near[:, some], tokens[some], rate, sums)
                seen += len(tokens)
            if seen:
                yield pa.record_batch({"at": np.arange(len(own.weights), dtype=np.int32), "value": own.weights.astype(np.float64) * seen, "seen": np.full(len(own.weights), seen, np.int64)})

        some = dealt.where(F.pmod("h", F.lit(rounds)) == turn).repartition(shards, "h").sortWithinPartitions("h")
        parts = some.select("text").mapInArrow(learn, "at int, value double, seen long")
        mean = parts.groupBy("at").agg((F.sum("value") / F.sum("seen")).alias("value")).toArrow().sort_by("at")
        if mean.num_rows:
            net.load(mean["value"].to_numpy())
    return net


def scored(docs: DataFrame, words: Vocabulary, net: Network, counts: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_tokens, log_prob, mean_log_prob) for every row of docs (doc_id, text): of its words by their `counts`, or else of its tokens."""
    own = np.zeros(SIZE)
    if counts is not None:
        others = counts.where(~F.col("word").isin(words.words.view(np.int64).tolist()))
        many = others.groupBy(F.col("word").bitwiseAND(F.lit(SHARED - 1)).alias("at")).agg(F.sum("n").alias("n")).toArrow()
        own[SIZE - SHARED + many["at"].to_numpy()] = -np.log(many["n"].to_numpy())
    shared, side, width = docs.sparkSession.sparkContext.broadcast((words, net.weights, own)), net.side, net.width
    listed = counts is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights, own = shared.value
        model = Network(side, width, kind=np.float64)
        model.load(weights)
        for part in slices(batches, "text", 1 << 20):
            hashes, tokens, first = words.hashed(column(part, "text"))
            near, logs = around(tokens, first, side), [np.zeros(0)]
            for k in range(0, len(tokens), 16384):
                some = tokens[k : k + 16384]
                logs.append(model.log_probs(near[:, k : k + 16384], some) + own[some])
            n, sums = np.diff(first), np.zeros(part.num_rows)
            if len(tokens):  # row by row: a score must not hang on the rows beside it
                sums[n > 0] = np.add.reduceat(np.concatenate(logs), first[:-1][n > 0])
            out = {"row": column(part, "row"), "doc_id": column(part, "doc_id"), "n_tokens": n.astype(np.int64), "log_prob": np.where(n > 0, sums, 0.0)}
            if listed:
                other = np.flatnonzero(tokens >= SIZE - SHARED)
                out["words"] = lists(hashes[other].view(np.int64), np.diff(np.searchsorted(other, first)))
            yield pa.record_batch(out)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    rows = rows.mapInArrow(run, "row long, doc_id long, n_tokens long, log_prob double" + (", words array<long>" if listed else ""))
    total = F.col("log_prob")
    if listed:  # a word met once has log n = 0
        rows = saved(rows)
        found = rows.select("row", F.explode("words").alias("word")).join(others.where("n > 1").hint("shuffle_hash"), "word")
        rows = rows.drop("words").join(found.groupBy("row").agg(F.sum(F.log("n")).alias("counts")), "row", "left")
        total = total + F.coalesce("counts", F.lit(0.0))
    rows = rows.select("doc_id", "n_tokens", F.round(total, 6).alias("log_prob"))
    return rows.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))


def op1_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    counts = counted(docs)
    words = vocabulary(docs, counts)
    size = counts.agg(F.sum("n")).first()[0] or 0
    return scored(docs, words, train(docs, words, size=size), counts)
