"""Folds over time: segments, purge and embargo, out-of-fold blocks, stale books, admission, errata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.clock import SECOND
from tidemill.operators.ordered import carry

#: Age of a row that has no quote before it (a fixed value), the purge on both sides, and the embargo after.
NO_QUOTE, PURGE, EMBARGO = 2**62, 600 * SECOND, SECOND


@dataclass(frozen=True)
class Segment:
    """A half-open interval [start, end) of etime with a role: train, val or held_out."""

    name: str
    role: str
    start: int
    end: int


def checked(segments: list[Segment], covered: tuple[int, int]) -> list[Segment]:
    """The segments in order of time; raises if they are empty, overlap, leave the covered range or have not one held-out."""
    ordered = sorted(segments, key=lambda s: s.start)
    for s in ordered:
        if not covered[0] <= s.start < s.end <= covered[1]:
            raise ValueError(f"{s.name} is empty or outside of what is covered")
    for a, b in zip(ordered, ordered[1:]):
        if b.start < a.end:
            raise ValueError(f"{a.name} and {b.name} overlap")
    if sum(s.role == "held_out" for s in ordered) != 1:
        raise ValueError("one segment must be held out")
    return ordered


def merged_intervals(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(i for i in intervals if i[0] < i[1]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def remaining(start: int, end: int, excluded: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of [start, end)."""
    out, at = [], start
    for a, b in merged_intervals(excluded):
        if a > at and at < end:
            out.append((at, min(a, end)))
        at = max(at, b)
    if at < end:
        out.append((at, end))
    return [i for i in out if i[0] < i[1]]


def train_intervals(start: int, end: int, others: list[tuple[int, int]], purge: int = PURGE, embargo: int = EMBARGO) -> list[tuple[int, int]]:
    """Train time outside of [a - purge, b + purge + embargo) of every other entry."""
    return remaining(start, end, [(a - purge, b + purge + embargo) for a, b in others])


def inside(etime: Column, intervals: list[tuple[int, int]]) -> Column:
    """Whether etime lies in one of the intervals: a predicate that reaches the scan."""
    out = F.lit(False)
    for a, b in intervals:
        out = out | ((etime >= a) & (etime < b))
    return out


def blocks(start: int, end: int, k: int) -> list[tuple[int, int]]:
    """k blocks of equal whole width; the last takes the rest."""
    width = (end - start) // k
    if k < 1 or width < 1:
        raise ValueError("too many blocks")
    return [(start + i * width, start + (i + 1) * width if i < k - 1 else end) for i in range(k)]


def block_of(etime: Column, start: int, end: int, k: int) -> Column:
    return F.least(F.floor((etime - start) / ((end - start) // k)), F.lit(k - 1)).cast("int")


def training_rows(df: DataFrame, all_: list[tuple[int, int]], index: int, purge: int = PURGE, embargo: int = EMBARGO) -> DataFrame:
    """Rows of all blocks but one, purged around it."""
    return df.where(inside(F.col("etime"), train_intervals(all_[0][0], all_[-1][1], [all_[index]], purge, embargo)))


def purge_counts(df: DataFrame, train: Segment, others: list[Segment], purge: int = PURGE, embargo: int = EMBARGO) -> DataFrame:
    """How many rows of a train segment are purged, under embargo (purge comes first), and kept."""
    t = F.col("etime")
    purged = inside(t, [(s.start - purge, s.end + purge) for s in others])
    held = inside(t, [(s.end + purge, s.end + purge + embargo) for s in others])
    rows = df.where((t >= train.start) & (t < train.end))
    return rows.agg(F.count_if(purged).alias("purged"), F.count_if(~purged & held).alias("embargoed"), F.count_if(~purged & ~held).alias("kept"))


def with_age(df: DataFrame, bucket: str = "day") -> DataFrame:
    """Decision rows with `book_age`: time since the last decision row that was a quote, over all days; NO_QUOTE without one."""
    quote = F.when(F.col("decision_source_rank") == 0, F.col("etime"))
    out = carry(df, {"_quoted": quote}, bucket, ["etime"])
    return out.withColumn("book_age", F.coalesce(F.col("etime") - F.col("_quoted"), F.lit(NO_QUOTE))).drop("_quoted")


def admission(max_age: int = 5 * SECOND) -> Column:
    """admitted, stale or undefined, from book_age."""
    return F.when(F.col("book_age") == NO_QUOTE, "undefined").when(F.col("book_age") > max_age, "stale").otherwise("admitted")


def admission_counts(df: DataFrame, segments: list[Segment], max_age: int = 5 * SECOND) -> DataFrame:
    name = F.lit(None).cast("string")
    for s in segments:
        name = F.when((F.col("etime") >= s.start) & (F.col("etime") < s.end), s.name).otherwise(name)
    rows = df.withColumn("segment", name).where("segment is not null").withColumn("_a", admission(max_age))
    return rows.groupBy("segment").agg(*(F.count_if(F.col("_a") == a).alias(a) for a in ("admitted", "stale", "undefined")))


def errata(committed: DataFrame, recomputed: DataFrame, label: str) -> DataFrame:
    """(etime, decision_seq, shape) of the cells whose label differs; shape says whether it is the one that may be masked, 0.0 to null."""
    a, b = (d.select("etime", "decision_seq", F.col(label).alias(n)) for d, n in ((committed, "_a"), (recomputed, "_b")))
    both = a.join(b, ["etime", "decision_seq"]).where(~F.col("_a").eqNullSafe(F.col("_b")))
    allowed = (F.col("_a") == 0.0) & F.col("_b").isNull()
    return both.select("etime", "decision_seq", F.when(F.coalesce(allowed, F.lit(False)), "zero_to_null").otherwise("other").alias("shape"))


def masked(df: DataFrame, cells: DataFrame, label: str) -> DataFrame:
    """df with the label of the listed cells nulled."""
    hit = cells.select("etime", "decision_seq").distinct().withColumn("_hit", F.lit(True))
    return df.join(hit, ["etime", "decision_seq"], "left").withColumn(label, F.when(F.col("_hit").isNull(), F.col(label))).drop("_hit").select(df.columns)


def materialised(features: DataFrame, segment: Segment, segments: list[Segment], cells: DataFrame | None = None, label: str = "label", max_age: int = 5 * SECOND, purge: int = PURGE, embargo: int = EMBARGO) -> DataFrame:
    """The rows of a segment as a model may see them: age before slicing, slice, purge and embargo of a train segment, admission, errata. A held-out segment is refused."""
    if segment.role == "held_out":
        raise PermissionError(f"{segment.name} is held out")
    out = with_age(features).where((F.col("etime") >= segment.start) & (F.col("etime") < segment.end))
    if segment.role == "train":
        out = out.where(inside(F.col("etime"), train_intervals(segment.start, segment.end, [(s.start, s.end) for s in segments if s != segment], purge, embargo)))
    out = out.where(admission(max_age) == "admitted")
    return masked(out, cells, label) if cells is not None else out
