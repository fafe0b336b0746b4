"""Normalisation, linear models from aggregate statistics, the sweep over configurations, metrics and gates.

A fit is one aggregation: sums of products of the design's columns. Its size is the square of the number of columns,
whatever the number of rows, and the driver solves from it. A sweep over blocks groups the same sums by block.
"""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.folds import inside, train_intervals
from tidemill.operators.ordered import running_sum
from tidemill.operators.written import written

#: Buckets that distinct values are dealt into for their ranks.
QUANTILES = 64
FEATURES, TARGET = ("imb_top", "ofi", "trade_flow"), "ret_10s_mid"


def finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def fit_normalisation(df: DataFrame, features: tuple[str, ...], train_end: int | None = None) -> DataFrame:
    """(feature, count, mean, m2, std, excluded) over the finite values of rows up to train_end."""
    rows = df if train_end is None else df.where(F.col("etime") <= train_end)
    ok = lambda f: F.when(finite(F.col(f)), F.col(f))
    each = [F.struct(F.lit(f).alias("feature"), F.count(ok(f)).alias("count"), F.avg(ok(f)).alias("mean"), F.var_pop(ok(f)).alias("_v"), F.stddev_samp(ok(f)).alias("std"), (F.count("*") - F.count(ok(f))).alias("excluded")) for f in features]
    out = rows.agg(F.array(*each).alias("a")).select(F.explode("a").alias("s")).select("s.*")
    return out.select("feature", "count", "mean", (F.col("_v") * F.col("count")).alias("m2"), "std", "excluded")


def normalised(df: DataFrame, params: dict[str, tuple[float, float]], suffix: str = "_z") -> DataFrame:
    return df.withColumns({f + suffix: (F.col(f) - mean) / std for f, (mean, std) in params.items()})


def expanding_z(df: DataFrame, feature: str, name: str, bucket: str = "day") -> DataFrame:
    """The z-score of each row by mean and deviation of all rows up to it; null while there are fewer than two or no spread.

    Sums are taken about the first day's mean, which keeps their differences well conditioned.
    """
    ok = finite(F.col(feature))
    first = df.where(ok).groupBy(bucket).agg(F.avg(feature).alias("_c")).agg(F.min_by("_c", bucket).alias("_centre"))
    d = df.crossJoin(F.broadcast(first)).withColumn("_x", F.when(ok, F.col(feature) - F.col("_centre")))  # one row
    d = running_sum(d, {"_n": F.col("_x").isNotNull().cast("long"), "_s": F.col("_x"), "_q": F.col("_x") * F.col("_x")}, bucket, ["etime"])
    var = (F.col("_q") - F.col("_s") * F.col("_s") / F.col("_n")) / F.nullif(F.col("_n") - 1, F.lit(0))
    z = F.when(F.col("_x").isNotNull() & (F.col("_n") > 1) & (var > 1e-12), (F.col("_x") - F.col("_s") / F.col("_n")) / F.sqrt(var))
    return d.withColumn(name, z).drop("_centre", "_x", "_n", "_s", "_q")


def degree_two(features: tuple[str, ...]) -> dict[str, Column]:
    """The features, then their products in order."""
    out = {f: F.col(f) for f in features}
    return out | {f"{a}*{b}": F.col(a) * F.col(b) for a, b in combinations_with_replacement(features, 2)}


def gram(df: DataFrame, design: dict[str, Column], target: str, by: list[str] | None = None) -> DataFrame:
    """Sums of products of (1, design, target) over rows that are finite in all: one row (a group), with a flat upper triangle `products`."""
    columns = [F.lit(1.0), *design.values(), F.col(target).cast("double")]
    ok = F.lit(True)
    for c in columns[1:]:
        ok = ok & finite(c)
    rows = df.where(ok).select(*(by or []), *(c.cast("double").alias(f"_x{i}") for i, c in enumerate(columns)))
    pairs = combinations_with_replacement(range(len(columns)), 2)
    return rows.groupBy(*(by or [])).agg(F.array(*(F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")) for i, j in pairs)).alias("products"))


def unpacked(products: list[float]) -> np.ndarray:
    m = int((math.isqrt(8 * len(products) + 1) - 1) // 2)
    out = np.zeros((m, m))
    out[np.triu_indices(m)] = products
    return out + np.triu(out, 1).T


@dataclass(frozen=True)
class Config:
    """A model class with its hyper-parameters."""

    kind: str  # ols, ridge, elastic_net, poly2
    alpha: float = 0.0
    l1_ratio: float = 0.0


#: The grid of 17 (fixed values): one plain fit, four ridges, nine elastic nets, three of degree two.
ALPHAS = (0.1, 1.0, 10.0, 100.0)


def grid() -> list[Config]:
    nets = [Config("elastic_net", a, r) for a in (1e-4, 1e-3, 1e-2) for r in (0.1, 0.5, 0.9)]
    return [Config("ols"), *(Config("ridge", a) for a in ALPHAS), *nets, *(Config("poly2", a) for a in (1.0, 10.0, 100.0))]


def design_of(config: Config, features: tuple[str, ...]) -> dict[str, Column]:
    return degree_two(features) if config.kind == "poly2" else {f: F.col(f) for f in features}


def solve(g: np.ndarray, config: Config, rounds: int = 1000, tolerance: float = 1e-9) -> np.ndarray:
    """(intercept, coefficients) from the sums of (1, x, y): the intercept is not penalised.

    ridge and poly2: squared error + alpha |w|^2. elastic_net: squared error / 2n + alpha (l1 |w|_1 + (1 - l1) |w|^2 / 2), by coordinate descent.
    """
    n, sx, sy = g[0, 0], g[0, 1:-1], g[0, -1]
    a, b = g[1:-1, 1:-1] - np.outer(sx, sx) / n, g[1:-1, -1] - sx * sy / n
    if config.kind == "elastic_net":
        w = np.zeros(len(b))
        for _ in range(rounds):
            moved = 0.0
            for j in range(len(w)):
                r = (b[j] - a[j] @ w + a[j, j] * w[j]) / n
                new = math.copysign(max(abs(r) - config.alpha * config.l1_ratio, 0.0), r) / (a[j, j] / n + config.alpha * (1 - config.l1_ratio))
                moved, w[j] = max(moved, abs(new - w[j])), new
            if moved <= tolerance * max(1e-12, np.abs(w).max()):
                break
    else:
        w = np.linalg.lstsq(a + config.alpha * np.eye(len(b)), b, rcond=None)[0]
    return np.concatenate(([(sy - sx @ w) / n], w))


@dataclass(frozen=True)
class Frozen:
    """A fitted model as data."""

    config: Config
    features: tuple[str, ...]
    weights: tuple[float, ...]

    def predict(self) -> Column:
        out = F.lit(self.weights[0])
        for w, c in zip(self.weights[1:], design_of(self.config, self.features).values(), strict=True):
            out = out + F.lit(w) * c
        return out

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, separators=(",", ":"))

    @classmethod
    def from_json(cls, text: str) -> Frozen:
        d = json.loads(text)
        return cls(Config(**d["config"]), tuple(d["features"]), tuple(d["weights"]))


def predictor_id(config: Config, seed: int, code: str, normalisation: str) -> str:
    recipe = {"config": asdict(config), "seed": seed, "code": code, "normalisation": normalisation}
    return hashlib.sha256(json.dumps(recipe, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def fit(df: DataFrame, config: Config, features: tuple[str, ...] = FEATURES, target: str = TARGET) -> Frozen:
    bad = [f for f in (*features, target) if f not in df.columns or "price" in f]
    if bad:
        raise ValueError(f"not allowed in a fit: {bad}")
    row = gram(df, design_of(config, features), target).first()
    return Frozen(config, tuple(features), tuple(solve(unpacked(row["products"]), config).tolist()))


def rank_correlation(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Spearman's correlation with average ranks for ties; null if a side is constant.

    A value's average rank is (rows below it) + (rows of it + 1) / 2: counts of distinct values are ranked, not rows.
    Distinct values are dealt by size into buckets between quantiles of theirs, so no task sorts them all, whatever their spread.
    """
    by = by or []
    d = df.where(finite(F.col(a)) & finite(F.col(b))).select(*by, F.col(a).alias("_a"), F.col(b).alias("_b"))
    d = written(d)  # read three times
    for c in ("_a", "_b"):
        join = (lambda x, y: x.join(F.broadcast(y), by)) if by else (lambda x, y: x.crossJoin(F.broadcast(y)))
        count = written(d.groupBy(*by, c).agg(F.count("*").alias("_many")))
        bounds = count.groupBy(*by).agg(F.percentile_approx(c, [k / QUANTILES for k in range(1, QUANTILES)], 1000).alias("_bounds"))
        place = F.size(F.filter("_bounds", lambda b: b < F.col(c))).cast("long")  # noqa: B023
        count = running_sum(join(count, bounds).withColumn("_bucket", place).drop("_bounds"), {"_upto": F.col("_many")}, "_bucket", [c], by)
        d = d.join(count.select(*by, c, (F.col("_upto") - (F.col("_many") - 1) / 2.0).alias(f"_r{c}")), [*by, c])
    x, y = F.col("_r_a"), F.col("_r_b")
    out = d.groupBy(*by).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"))
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    ic = F.when((vx > 1e-9) & (vy > 1e-9), (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(vx * vy))
    return out.select(*by, "n", ic.alias("rank_ic"))


def r_squared(df: DataFrame, pred: str, y: str, train_mean: float, by: list[str] | None = None) -> DataFrame:
    """R2 against zero, against the mean, and of the constant train mean against zero."""
    d = df.where(finite(F.col(pred)) & finite(F.col(y)))
    p, t = F.col(pred), F.col(y)
    s = d.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.sum((t - p) * (t - p)).alias("sse"), F.sum(t * t).alias("syy"), F.var_pop(t).alias("v"), F.sum((t - train_mean) * (t - train_mean)).alias("ssm"))
    over = lambda a, b: F.when(b > 0, 1 - a / b)
    return s.select(*(by or []), "n", over(F.col("sse"), F.col("syy")).alias("r2_zero"), over(F.col("sse"), F.col("v") * F.col("n")).alias("r2_mean"), over(F.col("ssm"), F.col("syy")).alias("r2_constant"))


def sweep(df: DataFrame, blocks: list[tuple[int, int]], purge: int, embargo: int, features: tuple[str, ...] = FEATURES, target: str = TARGET, configs: list[Config] | None = None) -> DataFrame:
    """(config, block, n, rank_ic, r2_zero, r2_mean, r2_constant): every configuration fitted off every block and scored on it.

    Two aggregations give the sums of all blocks, for either design; one pass scores all configurations.
    """
    configs, spark = configs or grid(), df.sparkSession
    t, start, end = F.col("etime"), blocks[0][0], blocks[-1][1]
    member = F.array_compact(F.array(*(F.when(inside(t, train_intervals(start, end, [b], purge, embargo)), F.lit(i)) for i, b in enumerate(blocks))))
    train = df.where((t >= start) & (t < end)).withColumn("_block", F.explode(member))
    models: dict[tuple[int, int], Frozen] = {}
    means = {}
    for poly in (False, True):
        chosen = [(i, c) for i, c in enumerate(configs) if (c.kind == "poly2") == poly]
        if chosen:
            for row in gram(train, design_of(chosen[0][1], features), target, ["_block"]).collect():  # a row a block
                g = unpacked(row["products"])
                means[row["_block"]] = g[0, -1] / g[0, 0]
                models |= {(i, row["_block"]): Frozen(c, features, tuple(solve(g, c).tolist())) for i, c in chosen}
    at = F.lit(None).cast("int")
    for i, (a, b) in enumerate(blocks):
        at = F.when((t >= a) & (t < b), F.lit(i)).otherwise(at)
    rows = df.withColumn("block", at).where("block is not null")
    each = []
    for i in range(len(configs)):
        pred = F.lit(None).cast("double")
        for k in range(len(blocks)):
            if (i, k) in models:
                pred = F.when(F.col("block") == k, models[i, k].predict()).otherwise(pred)
        each.append(F.struct(F.lit(i).alias("config"), pred.alias("pred")))
    scored = rows.select("block", target, F.explode(F.array(*each)).alias("s")).select("block", target, "s.*")
    ic = rank_correlation(scored, "pred", target, ["config", "block"])
    mean = spark.createDataFrame([(k, float(m)) for k, m in means.items()], "block int, _mean double")
    s = scored.where(finite(F.col("pred")) & finite(F.col(target))).join(F.broadcast(mean), "block")
    p, y = F.col("pred"), F.col(target)
    s = s.groupBy("config", "block").agg(F.sum((y - p) * (y - p)).alias("sse"), F.sum(y * y).alias("syy"), (F.var_pop(y) * F.count("*")).alias("sst"), F.sum((y - F.col("_mean")) * (y - F.col("_mean"))).alias("ssm"))
    over = lambda a, b: F.when(F.col(b) > 0, 1 - F.col(a) / F.col(b))
    return ic.join(s, ["config", "block"]).select("config", "block", "n", "rank_ic", over("sse", "syy").alias("r2_zero"), over("sse", "sst").alias("r2_mean"), over("ssm", "syy").alias("r2_constant"))


def summary(scores: DataFrame) -> DataFrame:
    """Per configuration the mean, least, most and population deviation of its blocks' rank correlation, and the mean R2."""
    ok = gate(F.col("rank_ic"), F.col("r2_zero"), F.col("r2_mean")) == "pass"
    return scores.groupBy("config").agg(F.avg("rank_ic").alias("mean_ic"), F.min("rank_ic").alias("min_ic"), F.max("rank_ic").alias("max_ic"), F.stddev_pop("rank_ic").alias("std_ic"), F.avg("r2_mean").alias("mean_r2"), F.bool_and(ok).alias("eligible"))


def winner(summaries: DataFrame) -> DataFrame:
    """The best eligible configuration: mean rank correlation, then mean R2, then the lowest number."""
    return summaries.where("eligible").orderBy(F.desc_nulls_last("mean_ic"), F.desc_nulls_last("mean_r2"), "config").limit(1)


def gate(ic: Column, r2_zero: Column, r2_mean: Column) -> Column:
    """pass, or the first reason that a forecast fails for."""
    return F.when(ic.isNull(), "rank_ic_undefined").when((r2_zero <= 0) | r2_zero.isNull(), "r2_zero_not_positive").when((r2_mean <= 0) | r2_mean.isNull(), "r2_mean_not_positive").when(ic <= 0, "rank_ic_not_positive").otherwise("pass")


def price_of_return(mid: Column, pred: Column) -> Column:
    """mid * (1 + pred); a prediction that is not finite counts as no move, a bad mid fails."""
    safe = F.when(finite(pred), pred).otherwise(0.0)
    return F.when(finite(mid) & (mid > 0), mid * (1 + safe)).otherwise(F.raise_error(F.lit("mid must be finite and positive")).cast("double"))


def aligned(frame: DataFrame, table: DataFrame) -> DataFrame:
    """(unmatched, moved): etimes in one of the two alone, and etimes with differing decision_seq; both 0 if aligned."""
    a, b = (d.select("etime", F.col("decision_seq").alias(n)) for d, n in ((frame, "_a"), (table, "_b")))
    both = a.join(b, "etime", "full")
    lone = F.col("_a").isNull() | F.col("_b").isNull()
    return both.agg(F.count_if(lone).alias("unmatched"), F.count_if(~lone & (F.col("_a") != F.col("_b"))).alias("moved"))
