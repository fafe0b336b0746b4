"""What capture does to frames: decode, parse, de-duplicate, find gaps, number. All as batch operators; streaming/ runs the same on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.clock import SECOND, ms_to_ns
from tidemill.operators.ordered import carry

#: A frame names its stream and holds data whose short keys differ by case (fixed format), so data is read as a map.
FRAME_JSON = "stream string, data map<string,string>"


def kind(stream: Column) -> Column:
    return F.when(stream.endswith("@bookTicker"), "quote").when(stream.endswith("@trade"), "trade").otherwise("unknown")


def with_kind(frames: DataFrame) -> DataFrame:
    """frames (conn_id, rtime, frame) with the stream's kind; a frame that is no JSON is malformed."""
    name = F.get_json_object("frame", "$.stream")
    return frames.withColumn("kind", F.when(name.isNull(), "malformed").otherwise(kind(name)))


def _fields(frames: DataFrame, which: str) -> DataFrame:
    return with_kind(frames).where(F.col("kind") == which).withColumn("j", F.from_json("frame", FRAME_JSON)["data"])


def parsed_quotes(frames: DataFrame) -> DataFrame:
    k = lambda name, to, key: F.try_element_at("j", F.lit(key)).cast(to).alias(name)
    ns = lambda name, key: ms_to_ns(F.try_element_at("j", F.lit(key))).alias(name)
    return _fields(frames, "quote").select(
        "conn_id", "rtime", k("symbol", "string", "s"), k("id", "long", "u"), ns("etime", "T"), ns("event_time", "E"),
        k("bid_price", "double", "b"), k("bid_qty", "double", "B"), k("ask_price", "double", "a"), k("ask_qty", "double", "A"),
    )


def parsed_trades(frames: DataFrame) -> DataFrame:
    k = lambda name, to, key: F.try_element_at("j", F.lit(key)).cast(to).alias(name)
    ns = lambda name, key: ms_to_ns(F.try_element_at("j", F.lit(key))).alias(name)
    return _fields(frames, "trade").select(
        "conn_id", "rtime", k("symbol", "string", "s"), k("id", "long", "t"), ns("etime", "T"), ns("event_time", "E"),
        k("price", "double", "p"), k("qty", "double", "q"), k("is_buyer_maker", "boolean", "m"), k("exec_type", "string", "X"),
    )


def first_deliveries(rows: DataFrame, key: list[str], ttl: int = 120 * SECOND) -> DataFrame:
    """Rows of a key that come more than ttl after the last kept one are kept again; others are redeliveries.

    A row more than ttl behind the one before it is kept whatever came earlier, so each key falls into chains. The first row
    of a chain is kept; only the times of a chain beyond ttl from its start are folded in order.
    """
    w = Window.partitionBy(*key).orderBy("rtime", "conn_id")
    step = F.col("rtime") - F.lag("rtime").over(w)
    chain = F.sum((F.coalesce(step, F.lit(2**62)) > ttl).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = rows.withColumn("_chain", chain)
    d = d.withColumn("_start", F.min("rtime").over(Window.partitionBy(*key, "_chain").orderBy("rtime").rowsBetween(Window.unboundedPreceding, 0)))
    far = (F.col("rtime") == F.col("_start")) | (F.col("rtime") > F.col("_start") + ttl)
    times = d.where(far).groupBy(*key, "_chain").agg(F.sort_array(F.collect_set("rtime")).alias("_times"))
    fold = lambda kept, t: F.when((F.size(kept) == 0) | (t - F.element_at(kept, -1) > ttl), F.concat(kept, F.array(t))).otherwise(kept)
    times = times.select(*key, F.explode(F.aggregate("_times", F.array().cast("array<bigint>"), fold)).alias("rtime"))
    d = d.join(times, [*key, "rtime"], "left_semi")
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy(*key, "rtime").orderBy("conn_id")))
    return d.where("_n = 1").select(*rows.columns)


def merged_gaps(rows: DataFrame, threshold: int = 5 * SECOND, bucket: str = "day") -> DataFrame:
    """Times without a row on any connection for more than the threshold."""
    d = carry(rows.select(bucket, "rtime", "conn_id"), {"before": F.col("rtime")}, bucket, ["rtime", "conn_id"], inclusive=False)
    return d.where(F.col("rtime") - F.col("before") > threshold).select(F.lit("merged-silent").alias("cause"), F.lit(None).cast("int").alias("conn_id"), F.col("before").alias("gap_start_rtime"), F.col("rtime").alias("gap_end_rtime"))


def connection_gaps(rows: DataFrame, threshold: int = 5 * SECOND, bucket: str = "day") -> DataFrame:
    """Times without a row on one connection while another had one less than the threshold ago; a merged gap takes precedence."""
    d = carry(rows.select(bucket, "rtime", "conn_id"), {"anyone": F.col("rtime")}, bucket, ["rtime", "conn_id"], inclusive=False)
    d = carry(d, {"own": F.col("rtime")}, bucket, ["rtime"], inclusive=False, by=["conn_id"])
    d = d.where((F.col("rtime") - F.col("own") > threshold) & (F.col("rtime") - F.col("anyone") <= threshold))
    return d.select(F.lit("connection-silent").alias("cause"), F.col("conn_id").cast("int").alias("conn_id"), F.col("own").alias("gap_start_rtime"), F.col("rtime").alias("gap_end_rtime"))


def id_skips(rows: DataFrame, key: str = "id", bucket: str = "day") -> DataFrame:
    """(id, prior, missing): ids more than one above the largest before them in arrival order; a smaller id never lowers the prior.

    The largest so far over all days is a running maximum: inside a day by a window, across days from one row a day.
    """
    w = Window.partitionBy(bucket).orderBy("rtime", key).rowsBetween(Window.unboundedPreceding, -1)
    d = rows.withColumn("_in", F.max(key).over(w))
    day = rows.groupBy(bucket).agg(F.max(key).alias("_m"))
    day = day.select(bucket, F.max("_m").over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)).alias("_past"))  # a row a day
    d = d.join(day, bucket).withColumn("prior", F.greatest("_in", "_past"))
    return d.where(F.col(key) - F.col("prior") > 1).select(F.col(key).alias("id"), "prior", (F.col(key) - F.col("prior") - 1).alias("missing"))


def silent_connections(rows: DataFrame, now: int, threshold: int) -> DataFrame:
    """Connections with no row for more than the threshold at `now`."""
    return rows.groupBy("conn_id").agg(F.max("rtime").alias("last")).where(F.lit(now) - F.col("last") > threshold).select("conn_id", (F.lit(now) - F.col("last")).alias("silent"))
