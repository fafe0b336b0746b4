"""Curation of a day's raw rows: placeholders, trade side, redeliveries, sequence numbers, choice of source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.clock import DAY
from tidemill.operators.ordered import asof, within


def is_placeholder(columns: list[str]) -> Column:
    """Rows that stand for no trade: version 1 writes zeros, version 2 says so. Unknown is no placeholder."""
    old = (F.col("schema_version") == 1) & (F.col("price") == 0) & (F.col("qty") == 0)
    new = (F.col("schema_version") == 2) & (F.col("exec_type") == "NA") if "exec_type" in columns else F.lit(False)
    return F.coalesce(old, F.lit(False)) | F.coalesce(new, F.lit(False))


def without_placeholders(trades: DataFrame) -> DataFrame:
    return trades.where(~is_placeholder(trades.columns))


def placeholder_counts(trades: DataFrame, by: str) -> DataFrame:
    return trades.groupBy(by).agg(F.count_if(~is_placeholder(trades.columns)).alias("kept"), F.count_if(is_placeholder(trades.columns)).alias("dropped"))


def side_of_flag(flag: Column) -> Column:
    return F.when(flag, -1).when(~flag, 1).otherwise(0).cast("byte")


def prevailing_quotes(quotes: DataFrame) -> DataFrame:
    """The last quote of every etime."""
    last = F.max_by(F.struct("seq", "bid_price", "ask_price"), "seq").alias("q")
    return quotes.groupBy("etime").agg(last).select("etime", "q.*")


def nearest_side(trades: DataFrame, quotes: DataFrame) -> DataFrame:
    """trades with `near_side`: the side of the nearer price of the last quote strictly before the trade; 0 on a tie or without one."""
    found = asof(trades, prevailing_quotes(quotes), "etime", ["bid_price", "ask_price"], DAY, strict=True)
    to_bid, to_ask = F.abs(F.col("price") - F.col("bid_price")), F.abs(F.col("price") - F.col("ask_price"))
    side = F.when(to_bid < to_ask, -1).when(to_ask < to_bid, 1).otherwise(0).cast("byte")
    return found.withColumn("near_side", side).drop("bid_price", "ask_price")


def with_sides(trades: DataFrame, quotes: DataFrame | None = None) -> DataFrame:
    """trades with `trade_side` and `side_method`: the flag if there is one, else the nearest quote if quotes are given."""
    exact = F.col("is_buyer_maker").isNotNull()
    if quotes is None:
        return trades.withColumn("trade_side", side_of_flag(F.col("is_buyer_maker"))).withColumn("side_method", F.when(exact, "exact_flag").otherwise("unknown"))
    out = nearest_side(trades, quotes)
    side = F.when(exact, side_of_flag(F.col("is_buyer_maker"))).otherwise(F.col("near_side"))
    method = F.when(exact, "exact_flag").when(F.col("near_side") != 0, "nearest_quote").otherwise("unknown")
    return out.withColumn("trade_side", side).withColumn("side_method", method).drop("near_side")


def side_agreement(trades: DataFrame, quotes: DataFrame) -> DataFrame:
    """How often the nearest quote gives the side of the flag; unknown counts as disagreement."""
    out = nearest_side(trades.where("is_buyer_maker is not null"), quotes)
    same = F.col("near_side") == side_of_flag(F.col("is_buyer_maker"))
    return out.agg(F.count("*").alias("n_rows"), F.count_if(same).alias("agreeing"))


def without_redeliveries(rows: DataFrame, key: str, ignored: tuple[str, ...] = ("seq", "rtime")) -> DataFrame:
    """Rows of a key that agree in all but the ignored columns become the one of lowest seq; a key with differing contents keeps all its rows."""
    content = F.struct(*(c for c in rows.columns if c not in ignored))
    per_key = rows.groupBy(key).agg(F.count_distinct(content).alias("_contents"))
    w = Window.partitionBy(key).orderBy("seq")
    numbered = rows.join(per_key, key).withColumn("_n", F.row_number().over(w))
    return numbered.where("_contents > 1 or _n = 1").select(rows.columns)


def with_sequence(rows: DataFrame, key: str, by: list[str], name: str = "seq") -> DataFrame:
    """Rows with a fresh number from 0 over (etime, key) inside each of `by`; the old number goes to capture_seq."""
    out = rows.withColumnRenamed("seq", "capture_seq") if "seq" in rows.columns else rows
    return out.withColumn(name, (F.row_number().over(within(by, ["etime", key])) - 1).cast("long"))


def resumed_sequence(rows: DataFrame, written: DataFrame, key: str, by: list[str], name: str = "seq") -> DataFrame:
    """with_sequence, going on after the largest number that `written` has for each group."""
    last = written.groupBy(*by).agg((F.max(name) + 1).alias("_next"))  # a row a group
    out = with_sequence(rows, key, by, name).join(last, by, "left")
    return out.withColumn(name, F.col(name) + F.coalesce("_next", F.lit(0))).drop("_next")


def duplicate_keys(rows: DataFrame, key: str, by: str) -> DataFrame:
    return rows.groupBy(by).agg((F.count("*") - F.count_distinct(key)).alias("duplicates"))


def reconciled(archive: DataFrame, capture: DataFrame, key: str, by: str) -> DataFrame:
    """Per day the ids in both sources, and in one alone, inside the id range that both cover. Placeholders take ids that the archive leaves out, so they are removed first."""
    archive, capture = (without_placeholders(d) if "exec_type" in d.columns else d for d in (archive, capture))
    a, c = archive.select(by, key).distinct().withColumn("_a", F.lit(1)), capture.select(by, key).distinct().withColumn("_c", F.lit(1))
    bounds = lambda d, p: d.groupBy(by).agg(F.min(key).alias(f"_{p}0"), F.max(key).alias(f"_{p}1"))
    span = bounds(a, "a").join(bounds(c, "c"), by).select(by, F.greatest("_a0", "_c0").alias("_low"), F.least("_a1", "_c1").alias("_high"))
    both = a.join(c, [by, key], "full").join(span, by).where(F.col(key).between(F.col("_low"), F.col("_high")))
    return both.groupBy(by).agg(F.count_if(F.col("_a").isNotNull() & F.col("_c").isNotNull()).alias("in_both"), F.count_if(F.col("_c").isNull()).alias("archive_only"), F.count_if(F.col("_a").isNull()).alias("capture_only"))


def chosen_source(archive: DataFrame, capture: DataFrame, published: DataFrame, by: str) -> DataFrame:
    """Per day the source to use: the archive if it is published, else the capture, else the archive. Rows are never mixed."""
    days = lambda d, n: d.select(by).distinct().withColumn(n, F.lit(True))
    all_ = days(archive, "_a").join(days(capture, "_c"), by, "full").join(published.select(by).distinct().withColumn("_p", F.lit(True)), by, "left")
    return all_.select(by, F.when(F.col("_a") & F.col("_p"), "archive").when(F.col("_c"), "capture").when(F.col("_a"), "archive").alias("source"))


def curated(archive: DataFrame, capture: DataFrame, published: DataFrame, key: str, by: str, quotes: DataFrame | None = None) -> DataFrame:
    """The curated trades of all days: source chosen, placeholders gone, sides set, redeliveries dropped, numbered."""
    choice = chosen_source(archive, capture, published, by)
    take = lambda d, name: d.join(choice.where(F.col("source") == name).select(by), by, "left_semi").withColumn("source", F.lit(name))
    clean = without_redeliveries(take(capture, "capture"), key)
    rows = take(archive, "archive").unionByName(clean, allowMissingColumns=True)
    return with_sequence(with_sides(without_placeholders(rows), quotes), key, [by])
