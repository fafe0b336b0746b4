"""Ordered computation over a whole table without one task that holds it.

A global order is split into buckets that follow it (days, say). Inside a bucket a window does the work;
one summary row a bucket is combined by a window over the summaries, and joined back. What the summary and the rows
both need is written once, so scans in a row do not double the work.
Every function takes the order as SQL expressions; `bucket` must not decrease along it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemill.operators.written import written


def within(bucket: list[str] | str, order: list) -> WindowSpec:
    return Window.partitionBy(*([bucket] if isinstance(bucket, str) else bucket)).orderBy(*order)


def up_to(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _key(order: list) -> Column:
    return F.struct(*(F.expr(o) if isinstance(o, str) else o for o in order))


def carry(df: DataFrame, values: dict[str, Column], bucket: str, order: list[str], inclusive: bool = True, by: list[str] | None = None) -> DataFrame:
    """df with, for each name, the last non-null value up to a row (or before it, if not inclusive), over all buckets."""
    by = by or []
    frame = (up_to if inclusive else before)(within([*by, bucket], [F.expr(o) for o in order]))
    held = df.withColumns({f"_v_{n}": c for n, c in values.items()})
    held = written(held.withColumns({f"_i_{n}": F.last(f"_v_{n}", ignorenulls=True).over(frame) for n in values}))
    last = held.groupBy(*by, bucket).agg(*(F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), _key(order))).alias(f"_l_{n}") for n in values))
    past = before(Window.partitionBy(*by).orderBy(bucket))
    last = last.select(*by, bucket, *(F.last(f"_l_{n}", ignorenulls=True).over(past).alias(f"_p_{n}") for n in values))
    out = held.join(last, [*by, bucket])
    out = out.withColumns({n: F.coalesce(f"_i_{n}", f"_p_{n}") for n in values})
    return out.drop(*(f"_{k}_{n}" for k in "vipl" for n in values))


def running_sum(df: DataFrame, values: dict[str, Column], bucket: str, order: list[str], by: list[str] | None = None) -> DataFrame:
    """df with, for each name, the sum of the value over all rows up to this one (null counts 0)."""
    by = by or []
    frame = up_to(within([*by, bucket], [F.expr(o) for o in order]))
    held = df.withColumns({f"_v_{n}": F.coalesce(c, F.lit(0)) for n, c in values.items()})
    held = written(held.withColumns({f"_i_{n}": F.sum(f"_v_{n}").over(frame) for n in values}))
    total = held.groupBy(*by, bucket).agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values))
    past = before(Window.partitionBy(*by).orderBy(bucket))
    total = total.select(*by, bucket, *(F.coalesce(F.sum(f"_t_{n}").over(past), F.lit(0)).alias(f"_p_{n}") for n in values))
    out = held.join(total, [*by, bucket])
    return out.withColumns({n: F.col(f"_i_{n}") + F.col(f"_p_{n}") for n in values}).drop(*(f"_{k}_{n}" for k in "vip" for n in values))


def order_violations(df: DataFrame, bucket: str, order: list[str]) -> DataFrame:
    """Rows whose key does not come strictly after the one before it, when rows are dealt in the order of the first key alone and `arrival`."""
    key = _key(order)
    w = within(bucket, [F.col("arrival")])
    return df.withColumn("previous", F.lag(key).over(w)).where(~(key > F.col("previous"))).drop("previous")


def asof(probes: DataFrame, builds: DataFrame, time: str, values: list[str], bucket_width: int, strict: bool = False, forward: bool = False, tie: str = "seq") -> DataFrame:
    """probes with the values of the nearest build at or before each probe's time (after, if forward).

    strict leaves out builds at the probe's own time. Of builds at one time the last by `tie` wins
    (the first, if forward). A union is sorted once, so no pair of rows is formed and
    a probe costs the same whatever lies around it. Values of a build that are null stay null.
    """
    sign = -1 if forward else 1
    names = probes.columns
    first, second = (0, 1) if not strict else (1, 0)  # builds come before or after probes of the same time
    p = probes.select(F.struct(*names).alias("_row"), (F.col(time) * sign).alias("_t"), F.lit(second).alias("_kind"), F.lit(0).cast("long").alias("_tie"), F.lit(None).cast(_struct(builds, values)).alias("_build"))
    b = builds.select(F.lit(None).cast(_struct(probes, names)).alias("_row"), (F.col(time) * sign).alias("_t"), F.lit(first).alias("_kind"), (F.col(tie).cast("long") * sign).alias("_tie"), F.struct(*values).alias("_build"))
    both = p.union(b).withColumn("_bucket", F.floor(F.col("_t") / bucket_width).cast("long"))
    out = carry(both, {"_found": F.col("_build")}, "_bucket", ["_t", "_kind", "_tie"])
    return out.where(F.col("_row").isNotNull()).select("_row.*", *(F.col(f"_found.{v}").alias(v) for v in values))


def _struct(df: DataFrame, names: list[str]):
    return df.select(F.struct(*names).alias("s")).schema["s"].dataType
