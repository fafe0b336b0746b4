"""Forward returns of decision rows, with one of four reasons where there is none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.clock import DAY
from tidemill.operators.ordered import asof, carry

#: The reasons in the order in which they apply (fixed values).
REASONS = ("null_no_mid", "null_past_end", "null_gap", "null_stale")


def quote_mids(quotes: DataFrame) -> DataFrame:
    return quotes.select("etime", "seq", ((F.col("bid_price") + F.col("ask_price")) / 2).alias("quote_mid"))


def big_gaps(quotes: DataFrame, threshold: int) -> DataFrame:
    """(gap_start, gap_end) of consecutive distinct quote times more than the threshold apart."""
    times = quotes.select("etime").distinct().withColumn("_day", F.floor(F.col("etime") / DAY).cast("long"))
    out = carry(times, {"gap_start": F.col("etime")}, "_day", ["etime"], inclusive=False)
    return out.where(F.col("etime") - F.col("gap_start") > threshold).select("gap_start", F.col("etime").alias("gap_end"))


def labels_of(decisions: DataFrame, quotes: DataFrame, horizons: dict[str, int], gap_threshold: int) -> DataFrame:
    """decisions with a struct (label, reason) for each horizon by its name.

    The quote that stands at t + horizon is the last at or before it. Quotes may reach into the
    next day. A gap that ends at t or starts at t + horizon does not count. The probes of all horizons are
    looked up at once: two lookups, however many horizons there are.
    """
    mids = quote_mids(quotes).withColumn("quote_time", F.col("etime"))
    end = mids.agg(F.max("etime").alias("_end"))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(h).cast("long").alias("h")) for n, h in horizons.items())))
    probes = decisions.select(F.struct(*decisions.columns).alias("_row"), F.col("etime").alias("_t"), "mid", each.alias("_h"))
    probes = probes.select("_row", "_t", "mid", F.col("_h.name").alias("_name"), (F.col("_t") + F.col("_h.h")).alias("etime"))
    found = asof(probes, mids.select("etime", "seq", "quote_mid", "quote_time"), "etime", ["quote_mid", "quote_time"], DAY)
    gaps = big_gaps(quotes, gap_threshold).select(F.col("gap_start").alias("etime"), F.col("gap_end").alias("seq"), "gap_end")
    found = asof(found, gaps, "etime", ["gap_end"], DAY, strict=True).crossJoin(F.broadcast(end))  # one row
    t = F.col("_t")
    reason = F.when(F.col("mid").isNull() | F.col("quote_mid").isNull(), REASONS[0]).when(F.col("etime") > F.col("_end"), REASONS[1])
    reason = reason.when(F.coalesce(F.col("gap_end") > t, F.lit(False)), REASONS[2]).when(F.col("quote_time") <= t, REASONS[3])
    out = found.withColumn("_reason", reason)
    label = F.when(F.col("_reason").isNull(), F.when(F.col("mid") > 0, (F.col("quote_mid") - F.col("mid")) / F.col("mid")).otherwise(F.raise_error(F.lit("mid must be positive")).cast("double")))
    out = out.select("_row", "_t", "_name", F.struct(label.alias("label"), F.col("_reason").alias("reason")).alias("_s"))
    if len(horizons) == 1:
        return out.select("_row.*", F.col("_s").alias(next(iter(horizons))))
    out = out.groupBy("_t").agg(F.first("_row").alias("_row"), *(F.first(F.when(F.col("_name") == n, F.col("_s")), ignorenulls=True).alias(f"_{k}") for k, n in enumerate(horizons)))
    return out.select("_row.*", *(F.col(f"_{k}").alias(n) for k, n in enumerate(horizons)))


def labels(decisions: DataFrame, quotes: DataFrame, horizon: int, gap_threshold: int) -> DataFrame:
    """decisions with `label` and `reason` for one horizon."""
    return labels_of(decisions, quotes, {"_label": horizon}, gap_threshold).select(*decisions.columns, "_label.label", "_label.reason")


def label_stats(labelled: DataFrame) -> DataFrame:
    """Counts by reason, share of zeros, mean and population deviation."""
    has = F.col("label").isNotNull()
    return labelled.agg(
        F.count("*").alias("n_rows"), F.count_if(has).alias("labelled"), *(F.count_if(F.coalesce(F.col("reason") == r, F.lit(False))).alias(r) for r in REASONS),
        F.avg(F.when(has, (F.col("label") == 0).cast("double"))).alias("zero_fraction"), F.avg("label").alias("mean"), F.stddev_pop("label").alias("std"),
    )


def asof_disagreement(decisions: DataFrame, quotes: DataFrame, horizon: int) -> DataFrame:
    """How often the first quote at or after t + horizon has another mid than the last at or before it."""
    mids = quote_mids(quotes)
    probes = decisions.select((F.col("etime") + horizon).alias("etime"))
    back = asof(probes, mids, "etime", ["quote_mid"], DAY).withColumnRenamed("quote_mid", "back")
    both = asof(back, mids, "etime", ["quote_mid"], DAY, forward=True)
    both = both.where("back is not null and quote_mid is not null")
    return both.agg(F.count("*").alias("compared"), F.count_if(F.col("back") != F.col("quote_mid")).alias("disagreeing"))


def post_gap_tags(decisions: DataFrame, windows: DataFrame) -> DataFrame:
    """decisions with `post_gap_warmup`: whether the last window (start, stop) that starts at or before etime still holds it."""
    builds = windows.select(F.col("start").alias("etime"), F.col("stop").alias("seq"), "stop")
    found = asof(decisions, builds, "etime", ["stop"], DAY)
    return found.withColumn("post_gap_warmup", F.coalesce(F.col("etime") < F.col("stop"), F.lit(False))).drop("stop")
