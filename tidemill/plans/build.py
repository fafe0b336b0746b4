"""Feature builds: curated quotes and trades of many days to feature rows with labels, written once by date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.clock import DURATIONS, HOUR, SECOND, date_string
from tidemill.lake import Refused
from tidemill.operators import features, labels

HORIZONS = {f"ret_{d}_mid": DURATIONS[d] for d in ("10s", "1s", "1min", "10min")}
SCHEMA_VERSION = 2


def feature_rows(quotes: DataFrame, trades: DataFrame, windows: DataFrame | None = None, horizons: dict[str, int] = HORIZONS, window: int = SECOND, gap: int = 30 * SECOND) -> DataFrame:
    """The 16 columns of a feature row and its day. trades have sides; windows (start, stop) are times of warm-up after an outage."""
    rows = features.decisions(features.merge(quotes, trades), window)
    rows = labels.labels_of(rows, quotes, horizons, gap)
    rows = rows.withColumns({name: F.col(f"{name}.label") for name in horizons})
    rows = labels.post_gap_tags(rows, windows) if windows is not None else rows.withColumn("post_gap_warmup", F.lit(False))
    names = ["day", "etime", "decision_source_rank", "decision_seq", "bid_price", "ask_price", "mid", "imb_top", "ofi", "trade_flow", *horizons, "warmup", "post_gap_warmup"]
    return features.nan_to_null(rows.select(*names)).withColumn("schema_version", F.lit(SCHEMA_VERSION))


def buildable(days: list[int], curated: set[int], built: set[int], held_out: set[int]) -> dict[int, str]:
    """Per day: already_present, quarantined, no_source, next_day_missing or ready. A day needs the next day's quotes for its labels."""
    out = {}
    for d in days:
        out[d] = "already_present" if d in built else "quarantined" if {d, d + 1} & held_out else "no_source" if d not in curated else "next_day_missing" if d + 1 not in curated else "ready"
    return out


def build(quotes: DataFrame, trades: DataFrame, path: str, days: list[int], statuses: dict[int, str], **how) -> dict[int, str]:
    """Writes the days that are ready in one job, each as a folder of its own; labels read quotes of the day after."""
    ready = [d for d in days if statuses[d] == "ready"]
    if ready:
        near = sorted({*ready, *(d + 1 for d in ready)})
        rows = feature_rows(quotes.where(F.col("day").isin(near)), trades.where(F.col("day").isin(ready)), **how).where(F.col("day").isin(ready))
        rows = rows.withColumn("date", date_string(F.col("etime")))
        rows.repartition("date", F.floor(F.col("etime") / HOUR)).sortWithinPartitions("date", "etime").write.partitionBy("date").option("compression", "zstd").mode("append").parquet(path)
    return statuses | dict.fromkeys(ready, "written")


def write_predictions(rows: DataFrame, path: str, segment: str, predictor: str) -> None:
    """(etime, decision_seq, pred) once for each segment and predictor; keys must not be null."""
    bad = rows.where("etime is null or decision_seq is null").limit(1).count()
    if bad:
        raise Refused("a prediction has no key")
    out = rows.select("etime", "decision_seq", F.col("pred").cast("double").alias("pred"))
    out.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/segment={segment}/predictor={predictor}")


def read_predictions(spark, path: str, segment: str, predictor: str) -> DataFrame:
    return spark.read.parquet(f"{path}/segment={segment}/predictor={predictor}").select("etime", "decision_seq", "pred")
