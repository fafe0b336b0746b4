"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

Equal vectors are folded into one member with the k + 1 smallest ids that have it, which is all that k neighbours can
need of it. The top of the tree is fitted on a bounded sample (the `SAMPLE` vectors with the smallest hashed
ids): nodes are split by k-means on unit vectors until they hold few sample vectors. Leaves that hold more than `ROWS`
members of the table are split further on the executors, each by k-means on a hashed sample of its own members, so leaves
grow in number with the table (as long as the centres fit in `CENTRES` bytes, which every task holds).

A query walks the tree through a priority queue that always opens the most similar node, so leaves come out nearest bin
first. How many leaves a query visits is calibrated on the whole table: the neighbours of `PROBES` members, found by brute
force over all rows, must lie in the visited leaves with recall `RECALL`.

Leaves are searched on the executors: members of a leaf are dealt into blocks and its queries into chunks of bounded size,
every pair of block and chunk returns its best, and the best of these are the answer, all by exact cosine on the original
vectors in double precision. A query whose leaves hold too few candidates is answered by all leaves, so it always gets
min(k, all).

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take no part; nor do rows with a null
id; equal scores rank by smaller id. Rows with the same id and vector count once; rows with the same id and different vectors are
queries and candidates of their own. The dimension is that of the sample's commonest length; other lengths take
no part. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import column, lists, read, saved, spread

#: Vectors that the top of the tree is fitted on at most, members of a block, queries of a chunk, and the recall that visits are widened to.
SAMPLE, BLOCK, CHUNK, RECALL = 20_000, 2048, 2048, 0.97
BRANCH, LEAF = 8, 64
#: Members of the table above which a leaf is split, sampled members for that, bytes of all centres, and members whose neighbours calibrate the visits.
ROWS, SPLIT, CENTRES, PROBES = 2048, 2048, 64 << 20, 100


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(unit centres, each vector's centre); centres that lose all members are dropped."""
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = np.argmax(x @ centres.T, 1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        norm = np.linalg.norm(sums, axis=1)
        centres = sums[norm > 1e-12] / norm[norm > 1e-12, None]
    return centres, np.argmax(x @ centres.T, 1)


class Tree:
    """Nodes with centres; children of inner nodes are contiguous. A leaf has a number."""

    def __init__(self, x: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 13):
        rng, self.children, self.centres, self.leaf = np.random.default_rng(seed), {}, [np.zeros(x.shape[1])], {}
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            centres, at = (None, None) if len(rows) <= leaf else _kmeans(x[rows], min(branch, len(rows)), rng)
            if at is None or len(np.unique(at)) < 2:
                self.leaf[node] = len(self.leaf)
                continue
            first = len(self.centres)
            self.centres.extend(centres)
            self.children[node] = (first, first + len(centres))
            todo += [(first + j, rows[at == j]) for j in range(len(centres))]
        self.centres = np.array(self.centres)

    def grow(self, centres: dict[int, np.ndarray]) -> None:
        """Splits leaves (by number) at the given centres; their children are leaves with new numbers."""
        node_of, next_ = {number: node for node, number in self.leaf.items()}, max(self.leaf.values()) + 1
        for number, found in sorted(centres.items()):
            node, first = node_of[number], len(self.centres)
            del self.leaf[node]
            self.children[node] = (first, first + len(found))
            self.leaf |= {first + j: next_ + j for j in range(len(found))}
            next_ += len(found)
            self.centres = np.concatenate((self.centres, found))

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each unit vector descends to."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node in self.leaf:
                out[rows] = self.leaf[node]
            elif len(rows):
                a, b = self.children[node]
                at = np.argmax(x[rows] @ self.centres[a:b].T, 1)
                todo += [(a + j, rows[at == j]) for j in range(b - a)]
        return out

    def visits(self, q: np.ndarray, most: int) -> list[int]:
        """Up to `most` leaves in the order in which best-bin-first opens them for the unit vector q."""
        queue, out = [(-1.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if node in self.leaf:
                out.append(self.leaf[node])
            else:
                a, b = self.children[node]
                for child, similar in enumerate((self.centres[a:b] @ q).tolist(), a):
                    heapq.heappush(queue, (-similar, child))
        return out


def calibrated(tree: Tree, probes: np.ndarray, leaves: list[list[int]], recall: float) -> tuple[int, float]:
    """(visits, recall there): the number of visits at which unit vectors find their neighbours, of which `leaves` tells the leaf."""
    rank = []
    for q, own in zip(probes, leaves, strict=True):
        place = {v: n for n, v in enumerate(tree.visits(q, len(tree.leaf)))} if own else {}
        rank += [place[v] for v in own]
    rank = np.sort(rank)
    visits = 1
    while visits < len(tree.leaf) and len(rank) and np.searchsorted(rank, visits, "left") < recall * len(rank):
        visits = min(len(tree.leaf), visits + max(1, visits // 4))
    return visits, float(np.searchsorted(rank, visits, "left") / max(len(rank), 1))


def _matrix(values: pa.Array) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v) of the vectors that take part."""
    v = F.col(embedding).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda c: c != 0)
    return vectors.where(F.col(vec_id).isNotNull()).where(good).select(F.col(vec_id).cast("long").alias("id"), v.alias("v"))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def members_of(all_: DataFrame, k: int) -> DataFrame:
    """(c1, c2, v, ids): every different vector of all_ (id, c1, c2, v) with the k + 1 smallest ids that have it."""
    order = Window.partitionBy("c1", "c2").orderBy("id")
    ids = all_.select("c1", "c2", "id").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    ids = ids.groupBy("c1", "c2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return all_.groupBy("c1", "c2").agg(F.first("v").alias("v")).join(ids, ["c1", "c2"])


def _placed(members: DataFrame, tree: Tree) -> DataFrame:
    """members with the number of their leaf."""
    shared = members.sparkSession.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf = shared.value.leaves_of(_unit(_matrix(column(b, "v"))))
                yield pa.record_batch([*(column(b, n) for n in ("c1", "c2", "v", "ids")), pa.array(leaf)], names=["c1", "c2", "v", "ids", "leaf"])

    return saved(members.select("c1", "c2", "v", "ids").mapInArrow(place, "c1 long, c2 int, v array<double>, ids array<long>, leaf long"))


def grown(members: DataFrame, tree: Tree, width: int, rounds: int = 5) -> DataFrame:
    """members in their leaves, after leaves with more than ROWS of them have been split (tree is changed); rows come back (.., leaf)."""
    placed = _placed(members, tree)
    for _ in range(rounds):
        free = CENTRES // (8 * width) - len(tree.centres)
        big = placed.groupBy("leaf").agg(F.count("*").alias("members")).where(F.col("members") > ROWS)
        big = big.withColumn("parts", F.least(F.ceil(F.col("members") / (ROWS // 4)), F.lit(64)).cast("int"))
        big = saved(big.orderBy(F.desc("members"), "leaf").limit(max(free // 64, 0)))  # their centres are what is collected
        if big.isEmpty():
            break
        some = placed.join(F.broadcast(big), "leaf").where(F.pmod(F.xxhash64("c1", "c2"), F.lit(1 << 20)) < F.lit(float(SPLIT << 20)) / F.col("members"))

        def split(part: pd.DataFrame) -> pd.DataFrame:
            x = _unit(np.stack(part["v"].to_numpy()))
            centres, at = _kmeans(x, min(int(part["parts"].iloc[0]), len(x)), np.random.default_rng(17))
            centres = centres[np.unique(at)]
            return pd.DataFrame({"leaf": part["leaf"].iloc[0], "centre": list(centres)}) if len(centres) > 1 else pd.DataFrame({"leaf": [], "centre": []})

        found: dict[int, list] = {}
        for r in some.select("leaf", "parts", "v").groupBy("leaf").applyInPandas(split, "leaf long, centre array<double>").collect():
            found.setdefault(r["leaf"], []).append(r["centre"])
        if not found:
            break
        tree.grow({leaf: np.array(sorted(c)) for leaf, c in found.items()})
        placed = _placed(placed, tree)
    return placed


def probed(placed: DataFrame, k: int) -> tuple[np.ndarray, list[list[int]]]:
    """PROBES hashed members as unit vectors, and the leaves of the k members nearest to each, by brute force over all rows."""
    some = placed.orderBy(F.xxhash64("c1", F.lit(5)), "c2").limit(PROBES).select("c1", "v").toArrow()
    own, probes = some["c1"].to_numpy(), _unit(_matrix(some["v"].combine_chunks()))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 4096):
                part = b.slice(a, 4096)
                score = _unit(_matrix(column(part, "v"))) @ probes.T
                score[column(part, "c1").to_numpy()[:, None] == own[None, :]] = -np.inf
                best = np.argsort(-score, 0)[:k]
                probe = np.broadcast_to(np.arange(len(own)), best.shape)
                leaf = column(part, "leaf").to_numpy()[best]
                yield pa.record_batch({"probe": probe.ravel(), "score": score[best, probe].ravel(), "leaf": leaf.ravel()})

    found = placed.select("c1", "v", "leaf").mapInArrow(near, "probe long, score double, leaf long").where("score > double('-inf')")
    order = Window.partitionBy("probe").orderBy(F.desc("score"), "leaf")
    leaves: list[list[int]] = [[] for _ in own]
    for r in found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).collect():  # PROBES * k rows
        leaves[r["probe"]].append(r["leaf"])
    return probes, leaves


def nearest(vectors: DataFrame, is_query: str = "id % 50 = 0", k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", rows: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query (rows of which `is_query` holds) among all other rows."""
    spark, all_ = vectors.sparkSession, usable(vectors, vec_id, embedding)
    sample = all_.orderBy(F.xxhash64("id"), "id").limit(rows).toArrow()
    if sample.num_rows == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = np.array([len(v) for v in sample["v"]])
    width = int(np.bincount(sizes).argmax())
    x = _unit(_matrix(sample["v"].combine_chunks().filter(pa.array(sizes == width))))
    tree = Tree(np.unique(x, axis=0))
    all_ = all_.where(F.size("v") == width).withColumns({"c1": F.xxhash64("v"), "c2": F.hash("v")})
    placed = grown(members_of(all_, k), tree, width)
    visits, _ = calibrated(tree, *probed(placed, k), recall)
    shared = spark.sparkContext.broadcast(tree)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = [shared.value.visits(q, visits) for q in _unit(_matrix(column(b, "v")))]
                n = np.array([len(f) for f in found])
                yield pa.record_batch({"c1": column(b, "c1"), "c2": column(b, "c2"), "v": column(b, "v"), "leaves": lists(np.concatenate(found).astype(np.int64), n)})

    size = saved(placed.groupBy("leaf").agg(F.count("*").alias("members")).withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("long")))  # a row a leaf
    queries = saved(all_.where(is_query).select("id", "c1", "c2").distinct())
    different = placed.select("c1", "c2", "v").join(queries.select("c1", "c2").distinct(), ["c1", "c2"], "left_semi")
    sent = different.mapInArrow(asked, "c1 long, c2 int, v array<double>, leaves array<long>")
    sent = saved(sent.select("c1", "c2", "v", F.explode("leaves").alias("leaf")))
    few = saved(sent.join(F.broadcast(size), "leaf").groupBy("c1", "c2").agg(F.sum("members").alias("seen"), F.first("v").alias("v")).where(f"seen < {k + 1}").select("c1", "c2", "v"))
    if not few.isEmpty():  # queries of nearly empty neighbourhoods go to all leaves
        numbers = F.array(*(F.lit(n).cast("long") for n in sorted(tree.leaf.values())))
        sent = saved(sent.join(few.select("c1", "c2"), ["c1", "c2"], "left_anti").union(few.select("c1", "c2", "v", F.explode(numbers).alias("leaf"))))
    asks = saved(sent.groupBy("leaf").agg(F.ceil(F.count("*") / CHUNK).cast("long").alias("chunks")).join(size, "leaf"))
    numbers = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = sent.join(F.broadcast(asks), "leaf").select("leaf", numbers("blocks").alias("block"), F.pmod(F.xxhash64("c1", "c2"), F.col("chunks")).alias("chunk"), "c1", "c2", "v")
    right = placed.join(F.broadcast(asks), "leaf").select("leaf", F.pmod(F.xxhash64("c1", "c2"), F.col("blocks")).alias("block"), numbers("chunks").alias("chunk"), "c1", "ids", "v")
    kind = {"c1": "int64", "c2": "int32", "m1": "int64", "vec": "int64", "score": "float64"}

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({n: [] for n in kind}).astype(kind)
        v, out = np.stack(right["v"].to_numpy()), []
        m1, ids = right["c1"].to_numpy(), right["ids"].tolist()
        norm = np.sqrt((v * v).sum(1))
        for a in range(0, len(left), 32):
            part = left.iloc[a : a + 32]
            q = np.stack(part["v"].to_numpy())
            score = (q @ v.T) / (np.sqrt((q * q).sum(1))[:, None] * norm)
            # Products in blocks round differently from one vector at a time: take all near the last place, then score exactly.
            at = max(score.shape[1] - k - 1, 0)
            row, col = np.nonzero(score >= np.partition(score, at, axis=1)[:, at][:, None] - 1e-9)
            exact = (q[row] * v[col]).sum(1) / (np.sqrt((q[row] ** 2).sum(1)) * np.sqrt((v[col] ** 2).sum(1)))
            many = np.array([len(ids[c]) for c in col.tolist()])
            vec = np.array([i for c in col.tolist() for i in ids[c]], np.int64)
            row, col, exact = np.repeat(row, many), np.repeat(col, many), np.repeat(exact, many)
            order = np.lexsort((vec, -exact, row))
            row, col, exact, vec = row[order], col[order], exact[order], vec[order]
            some = spread(np.bincount(row, minlength=len(part))) < k + 1
            row, col = row[some], col[some]
            out.append(pd.DataFrame({"c1": part["c1"].to_numpy()[row], "c2": part["c2"].to_numpy()[row], "m1": m1[col], "vec": vec[some], "score": exact[some]}))
        return pd.concat(out)

    keys = ["leaf", "block", "chunk"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, "c1 long, c2 int, m1 long, vec long, score double")
    order = Window.partitionBy("c1", "c2").orderBy(F.desc("score"), "vec", "m1")
    found = saved(found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n"))  # of a query's own vector
    own = Window.partitionBy("id", "c1", "c2").orderBy(F.desc("score"), "vec", "m1")
    out = queries.join(found, ["c1", "c2"]).where("not (vec = id and m1 = c1)").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return out.select(F.col("id").alias("query_id"), "rank", F.col("vec").alias("vec_id"), "score")


def op6_vector_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))
