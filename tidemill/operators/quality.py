"""Data-quality checks per day, their report and the verdict that gates a read.

Every check gives (day, stream, check, status, value, count, detail); status is ok, degraded, failed or n/a.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.clock import DAY, SECOND, day_start

#: Thresholds (fixed values).
THRESHOLDS = {
    "gap_failed_s": 900, "gap_degraded_s": 60, "missing_pct": 0.5, "placeholder_pct": 2.0, "loss_ids": 100, "loss_ns": SECOND,
    "sparse_ns": 30 * SECOND, "label_null_pct": 2.0, "skew_low_ns": -60 * SECOND, "skew_high_ns": 3600 * SECOND, "resync_ns": 60 * SECOND,
}
STATUSES = ("n/a", "ok", "degraded", "failed")


def row(day: Column, stream: str, check: str, status: Column, value: Column | None = None, count: Column | None = None, detail: Column | None = None) -> list[Column]:
    none = lambda c, t: (F.lit(None) if c is None else c).cast(t)
    return [day.alias("day"), F.lit(stream).alias("stream"), F.lit(check).alias("check"), status.alias("status"), none(value, "double").alias("value"), none(count, "long").alias("count"), none(detail, "string").alias("detail")]


def outages(ledger: DataFrame) -> DataFrame:
    """(start, end) of merged silences of ledger version 2 and up: one row a start, with the latest end."""
    rows = ledger.withColumn("ledger_version", F.coalesce("ledger_version", F.lit(1))) if "ledger_version" in ledger.columns else ledger.withColumn("ledger_version", F.lit(1))
    rows = rows.where((F.col("ledger_version") >= 2) & F.col("cause").startswith("merged-silent"))
    return rows.groupBy(F.col("gap_start_rtime").alias("start")).agg(F.max("gap_end_rtime").alias("end"))


def by_day(intervals: DataFrame) -> DataFrame:
    """(day, start, end): each half-open interval cut at midnights."""
    days = F.sequence(F.floor(F.col("start") / DAY).cast("long"), F.floor((F.col("end") - 1) / DAY).cast("long"))
    cut = intervals.where("end > start").select("start", "end", F.explode(days).alias("day"))
    return cut.select("day", F.greatest("start", day_start(F.col("day"))).alias("start"), F.least("end", day_start(F.col("day") + 1)).alias("end"))


def gap_coverage(ledger: DataFrame, stream: str = "all") -> DataFrame:
    seconds = by_day(outages(ledger)).groupBy("day").agg((F.sum(F.col("end") - F.col("start")) / float(SECOND)).alias("s"), F.count("*").alias("n"))
    status = F.when(F.col("s") > THRESHOLDS["gap_failed_s"], "failed").when(F.col("s") > THRESHOLDS["gap_degraded_s"], "degraded").otherwise("ok")
    return seconds.select(*row(F.col("day"), stream, "gap_coverage", status, F.col("s"), F.col("n")))


def resync_windows(ledger: DataFrame, warmup: int = THRESHOLDS["resync_ns"]) -> DataFrame:
    """(day, start, end, stop): outages by the day they end on, and when the warm-up after them is over."""
    return outages(ledger).select(F.floor(F.col("end") / DAY).cast("long").alias("day"), "start", "end", (F.col("end") + warmup).alias("stop"))


def reconciliation(counts: DataFrame, stream: str = "trade") -> DataFrame:
    a, c, b = F.col("archive_only"), F.col("capture_only"), F.col("in_both")
    worst = F.greatest(100.0 * a / F.nullif(a + b, F.lit(0)), 100.0 * c / F.nullif(c + b, F.lit(0)))
    return counts.select(*row(F.col("day"), stream, "reconciliation", F.when(worst.isNull(), "n/a").when(worst > THRESHOLDS["missing_pct"], "degraded").otherwise("ok"), worst, a + c))


def placeholder_rate(counts: DataFrame, stream: str = "trade") -> DataFrame:
    rate = 100.0 * F.col("dropped") / F.nullif(F.col("kept") + F.col("dropped"), F.lit(0))
    return counts.select(*row(F.col("day"), stream, "na_placeholder", F.when(rate.isNull(), "n/a").when(rate > THRESHOLDS["placeholder_pct"], "degraded").otherwise("ok"), rate, F.col("dropped")))


def probable_loss(trades: DataFrame, key: str = "id", ids: int = THRESHOLDS["loss_ids"], span: int = THRESHOLDS["loss_ns"]) -> DataFrame:
    """Skips in the ids of a day that are long in ids and in time, and the largest skip of all; informational. n/a below two trades."""
    w = Window.partitionBy("day").orderBy(key)
    d = trades.select("day", (F.col(key) - F.lag(key).over(w) - 1).alias("skip"), (F.col("etime") - F.lag("etime").over(w)).alias("span"))
    flagged = (F.col("skip") > ids) & (F.col("span") > span)
    out = d.groupBy("day").agg(F.count_if(flagged).alias("n"), F.max(F.when(flagged, F.col("skip"))).alias("most"), F.count("skip").alias("pairs"), F.max("skip").alias("top"), F.max("span").alias("long"))
    detail = F.concat(F.lit("largest skip "), F.col("top").cast("string"), F.lit(", longest step "), F.col("long").cast("string"))
    return out.select(*row(F.col("day"), "trade", "probable_loss", F.when(F.col("pairs") == 0, "n/a").otherwise("ok"), F.col("most"), F.col("n"), detail))


def crossed_or_locked(quotes: DataFrame) -> DataFrame:
    out = quotes.groupBy("day").agg(F.count_if(F.col("bid_price") >= F.col("ask_price")).alias("n"))
    return out.select(*row(F.col("day"), "quote", "crossed_locked_book", F.lit("ok"), None, F.col("n")))


def sparsity(quotes: DataFrame, threshold: int = THRESHOLDS["sparse_ns"], regime_start: int | None = None, now: int | None = None) -> DataFrame:
    """The longest time of a day without a quote: between quotes, from midnight (or the regime's start) to the first, and from the last to midnight if the day is over."""
    w = Window.partitionBy("day").orderBy("etime")
    d = quotes.select("day", "etime", (F.col("etime") - F.lag("etime").over(w)).alias("step"))
    g = d.groupBy("day").agg(F.max("step").alias("inner"), F.min("etime").alias("first"), F.max("etime").alias("last"))
    start = F.greatest(day_start(F.col("day")), F.lit(regime_start)) if regime_start is not None else day_start(F.col("day"))
    end = day_start(F.col("day") + 1)
    tail = F.when(end <= now, end - F.col("last")) if now is not None else end - F.col("last")
    gap = F.greatest(F.col("inner"), F.col("first") - start, tail)
    return g.select(*row(F.col("day"), "quote", "l1_sparsity", F.when(gap > threshold, "degraded").otherwise("ok"), gap / float(SECOND)))


def plausible_times(rows: DataFrame, column: str, stream: str) -> DataFrame:
    """Whether a day's times lie from the day before to the end of the day after, both included."""
    g = rows.groupBy("day").agg(F.min(column).alias("low"), F.max(column).alias("high"))
    a, b = day_start(F.col("day") - 1), day_start(F.col("day") + 2)
    ok = F.col("low").between(a, b) & F.col("high").between(a, b)
    return g.select(*row(F.col("day"), stream, f"{column}_plausibility", F.when(F.col("low").isNull(), "n/a").when(ok, "ok").otherwise("failed"), None, None, F.concat_ws("..", "low", "high")))


def plausible_receive_times(rows: DataFrame, stream: str, source: Column, built_at: int) -> DataFrame:
    """Archive rows are received after all events, captured ones close to theirs, none after the build; other sources fail."""
    skew = F.col("rtime") - F.col("etime")
    g = rows.withColumn("_source", source).groupBy("day").agg(F.min("rtime").alias("low"), F.max("rtime").alias("high"), F.max("etime").alias("last"), F.min(skew).alias("s0"), F.max(skew).alias("s1"), F.max("_source").alias("source"), F.count_distinct("_source").alias("sources"))
    archive = (F.col("source") == "archive") & (F.col("low") >= F.col("last"))
    capture = (F.col("source") == "capture") & (F.col("s0") >= THRESHOLDS["skew_low_ns"]) & (F.col("s1") <= THRESHOLDS["skew_high_ns"])
    ok = (F.col("sources") == 1) & (archive | capture) & (F.col("high") <= built_at)
    return g.select(*row(F.col("day"), stream, "rtime_plausibility", F.when(F.coalesce(ok, F.lit(False)), "ok").otherwise("failed"), F.col("s1") / float(SECOND)))


def feature_checks(stats: DataFrame) -> DataFrame:
    """The six checks of a feature day from its statistics (day, rows, dropped, null_labels, zero_labels, warmup_rows, sidecar, overflow, compared, disagreeing)."""
    pct = lambda a, b: 100.0 * F.col(a) / F.nullif(F.col(b), F.lit(0))
    null = pct("null_labels", "rows")
    day = F.col("day")
    checks = [
        row(day, "features", "feature_row_filters", F.lit("ok"), None, F.col("dropped")),
        row(day, "features", "feature_label_coverage", F.when(null.isNull(), "n/a").when(null > THRESHOLDS["label_null_pct"], "degraded").otherwise("ok"), null, F.col("null_labels")),
        row(day, "features", "feature_quantization", F.lit("ok"), pct("zero_labels", "rows"), F.col("zero_labels")),
        row(day, "features", "feature_warmup", F.when(F.col("sidecar"), "ok").otherwise("degraded"), None, F.col("warmup_rows")),
        row(day, "features", "feature_window", F.when(F.col("overflow") > 0, "failed").otherwise("ok"), None, F.col("overflow")),
        row(day, "features", "feature_asof_convention", F.lit("ok"), pct("disagreeing", "compared"), F.col("disagreeing")),
    ]
    return stats.select(F.explode(F.array(*(F.struct(*c) for c in checks))).alias("r")).select("r.*")


def report(*checks: DataFrame) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def verdict(report_: DataFrame) -> DataFrame:
    """(day, stream, verdict): failed over degraded over ok; missing if nothing but n/a is there."""
    level = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status")) - 1
    worst = report_.groupBy("day", "stream").agg(F.max(level).alias("w"))
    return worst.select("day", "stream", F.when(F.col("w") == 0, "missing").otherwise(F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("w") + 1).cast("int"))).alias("verdict"))


def write_report(report_: DataFrame, path: str) -> str:
    """Writes a report as Parquet by day, in place of these days alone, and returns it as Markdown (a row a check and day)."""
    report_.write.partitionBy("day").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    return markdown(report_.orderBy("day", "stream", "check").collect())


def markdown(rows: list) -> str:
    """A report's rows as a table; bars in cells are escaped."""
    names = ("day", "stream", "check", "status", "value", "count", "detail")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(cell(r[n]) for n in names) + " |" for r in rows)]) + "\n"
