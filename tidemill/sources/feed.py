"""A quote and trade feed made from the `events` table, so that every operator can run on the driver's data.

Times are floored to ten minutes, which makes ties; purchases are trades and all other events quotes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.clock import DAY, micros

BUCKET_US = 600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both streams in one schema; columns that a stream lacks are null."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), micros(F.col("ts")).alias("us"), "event_type", "value")
    low = F.floor(F.col("value") * 10).cast("long") + 1000
    high, trade = low + 1 + F.col("id") % 3, F.col("event_type") == "purchase"
    crossed = F.col("id") % 101 == 0
    quote = lambda c: F.when(~trade, c)
    etime = (F.col("us") - F.col("us") % BUCKET_US) * 1000
    return e.select(
        "id", F.col("id").alias("seq"), etime.alias("etime"), (F.col("us") * 1000).alias("rtime"), F.floor(etime / DAY).cast("long").alias("day"),
        trade.cast("byte").alias("source_rank"),
        quote(F.when(crossed, high).otherwise(low)).alias("bid_ticks"), quote(F.when(crossed, low).otherwise(high)).alias("ask_ticks"),
        quote((F.col("id") % 97 + 1) * F.lit(100000) / 1e8).alias("bid_qty"), quote((F.col("id") % 89 + 1) * F.lit(100000) / 1e8).alias("ask_qty"),
        F.when(trade, low).alias("trade_ticks"), F.when(trade, (F.col("id") % 50 + 1) * F.lit(100000) / 1e8).alias("trade_qty"),
        F.when(trade & (F.col("id") % 11 != 0), F.col("id") % 2 == 0).alias("is_buyer_maker"),
        F.when(trade & (F.col("id") % 13 == 0), F.lit("NA")).when(trade & (F.col("id") % 5 != 0), F.lit("MARKET")).alias("exec_type"),
    ).withColumns({f"{c}_price": F.col(f"{c}_ticks") / 10.0 for c in ("bid", "ask", "trade")})


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir).where("source_rank = 0").select("id", "seq", "etime", "rtime", "day", "source_rank", "bid_price", "bid_qty", "ask_price", "ask_qty")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = feed(spark, sf_dir).where("source_rank = 1")
    return kept.select("id", "seq", "etime", "rtime", "day", "source_rank", F.col("trade_price").alias("price"), F.col("trade_qty").alias("qty"), "is_buyer_maker", "exec_type", F.lit(2).alias("schema_version"))


#: The same feed for DuckDB.
SQL = """
feed AS (
  SELECT id, id AS seq, (us - us % 600000000) * 1000 AS etime, us * 1000 AS rtime, us // 86400000000 AS day, source_rank,
         CASE WHEN source_rank = 0 THEN CASE WHEN id % 101 = 0 THEN high ELSE low END END AS bid_ticks,
         CASE WHEN source_rank = 0 THEN CASE WHEN id % 101 = 0 THEN low ELSE high END END AS ask_ticks,
         CASE WHEN source_rank = 0 THEN CAST((id % 97 + 1) * 100000 AS DOUBLE) / 1e8 END AS bid_qty,
         CASE WHEN source_rank = 0 THEN CAST((id % 89 + 1) * 100000 AS DOUBLE) / 1e8 END AS ask_qty,
         CASE WHEN source_rank = 1 THEN low END AS trade_ticks,
         CASE WHEN source_rank = 1 THEN CAST((id % 50 + 1) * 100000 AS DOUBLE) / 1e8 END AS trade_qty,
         CASE WHEN source_rank = 1 AND id % 11 <> 0 THEN id % 2 = 0 END AS is_buyer_maker,
         CASE WHEN source_rank = 1 AND id % 13 = 0 THEN 'NA' WHEN source_rank = 1 AND id % 5 <> 0 THEN 'MARKET' END AS exec_type,
         CAST(bid_ticks AS DOUBLE) / 10 AS bid_price, CAST(ask_ticks AS DOUBLE) / 10 AS ask_price, CAST(trade_ticks AS DOUBLE) / 10 AS trade_price
  FROM (SELECT event_id AS id, epoch_us(ts) AS us, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS source_rank,
               CAST(floor(value * 10) AS BIGINT) + 1000 AS low, CAST(floor(value * 10) AS BIGINT) + 1001 + event_id % 3 AS high FROM events)
), quotes AS (SELECT * FROM feed WHERE source_rank = 0),
trades AS (SELECT *, trade_price AS price, trade_qty AS qty, 2 AS schema_version FROM feed WHERE source_rank = 1)
"""
