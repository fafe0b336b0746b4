"""Mixing sources to target weights by subset-sum budget fitting.

Each source has a weight; together the targets make up `share` of all words. A target stops at
`repeats` times its source's size, and what is above goes to the other sources by weight. A source's
documents are all taken as often as the target holds the source's whole size; the budget that then
remains is fitted on the source's histogram of exact lengths: first the same part of every length,
then a bounded-knapsack dynamic program over the lengths that are left. Which documents of a length
are taken follows a seeded hash of doc_id and text, so reruns agree.

Defined results: a null text has size 0, a document of size 0 is taken 0 words, a null source is a
source of its own (last), rows with the same doc_id are documents of their own, and an empty table
gives an empty result. Other columns are ignored by `mix`, and kept by `mixed`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import ranked, read, saved, subset_sum

WORD = r"[^\x20\x09-\x0D]+"
#: The dynamic program fits budgets up to this many times the longest document of at most `LONGEST` words; longer ones are taken whole before it.
BUDGET, LONGEST = 4, 1 << 20


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """(source, at, source_size, target) from (source, source_size): one row a source, filled like water up to each one's limit."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int")).cast("double")
    s = sizes.withColumn("at", F.row_number().over(order) - 1).withColumn("weight", w)
    s = s.withColumn("ratio", F.struct(F.col("source_size") * repeats / F.col("weight"), "at"))
    every, before = Window.partitionBy(), Window.orderBy("ratio").rowsBetween(Window.unboundedPreceding, -1)
    limit = (F.col("source_size") * repeats).cast("double")
    total = F.sum("source_size").over(every) * F.lit(share)
    level = (total - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", level).withColumn("full", limit <= F.col("level") * F.col("weight"))
    rest = F.min_by("level", F.when(~F.col("full"), F.col("ratio"))).over(every)  # the level at which nobody else is full
    return s.select("source", "at", "source_size", F.when(F.col("full"), limit).otherwise(rest * F.col("weight")).alias("target"))


def fit(sizes: np.ndarray, counts: np.ndarray, total: int, target: float, repeats: int) -> tuple[int, np.ndarray]:
    """(times that all are taken, how many of each size are taken once more)."""
    times = min(int(target // total), repeats)
    budget = target - times * total
    if times == repeats or budget < 0.5:
        return times, np.zeros(len(sizes), np.int64)
    extra = np.floor(counts * (budget / total)).astype(np.int64)
    budget = int(round(budget - float((extra * sizes).sum())))
    left, span = counts - extra, BUDGET * int(min(sizes.max(), LONGEST))
    for i in np.argsort(-sizes, kind="stable"):
        if budget > span and left[i]:
            k = min(int(left[i]), (budget - span // 2) // int(sizes[i]))
            extra[i] += k
            left[i] -= k
            budget -= k * int(sizes[i])
    if budget > span:  # what is left are documents so long that one of them may come near the budget or overshoot it
        some = np.flatnonzero(left)
        near = some[np.argmin(np.abs(sizes[some] - budget))] if len(some) else None
        if near is not None and abs(int(sizes[near]) - budget) < budget:
            extra[near] += 1
        return times, extra
    return times, extra + subset_sum(sizes, left, budget)


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, repeats: int = 3, seed: int = 11) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs (doc_id, text, source)."""
    sized = saved(docs.select("doc_id", "source", n_words("text").alias("size"), F.xxhash64("text").alias("tie")))
    return _planned(sized, ["doc_id", "tie"], weights, share, repeats, seed).select("doc_id", "size", "source_size", "target", "taken")


def _planned(sized: DataFrame, ties: list[str], weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, repeats: int = 3, seed: int = 11) -> DataFrame:
    """The rows of `sized` (doc_id, source, size and others; a saved table) with source_size, target and taken; `ties` order rows of one doc_id."""
    aim = saved(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats))
    a = aim.withColumnRenamed("source", "source_")
    sized = sized.join(a, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    count = sized.where("size > 0").groupBy("at", "source_size", "target", "size").agg(F.count("*").alias("many"))

    def fitted(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size")
        times, extra = fit(part["size"].to_numpy(), part["many"].to_numpy(), int(part["source_size"].iloc[0]), float(part["target"].iloc[0]), repeats)
        return pd.DataFrame({"at": part["at"], "size": part["size"], "times": times, "extra": extra})

    plan = saved(count.groupBy("at").applyInPandas(fitted, "at int, size long, times int, extra long"))
    sized = sized.withColumn("h", F.xxhash64(*ties, F.lit(seed)))
    rows = ranked(sized, ["at", "size"], "h", ties).join(plan, ["at", "size"], "left")
    taken = F.coalesce(F.col("size") * (F.col("times") + (F.col("rank") < F.col("extra")).cast("int")), F.lit(0)).cast("long")
    return rows.withColumn("taken", taken)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents that the mix takes, each row as often as it is taken (all columns kept).

    Every row is planned on its own and carried through the plan, so rows with one doc_id, or copies without one, are
    taken as often as each of them is planned. Rows without a doc_id are ordered by their text.
    """
    rows = docs.select("doc_id", "source", n_words("text").alias("size"), F.xxhash64("text").alias("tie"), F.struct(*docs.columns).alias("row"))
    taken = _planned(saved(rows), ["doc_id", "tie"], **how).where("taken > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int")))).select("row.*")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))
