"""Features of the merged stream: the ordered merge, decision rows, mid, imbalance, order-flow imbalance, trade flow, warm-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.functions.clock import HOUR, SECOND
from tidemill.functions.fixed import QTY_SCALE, exact_quantity
from tidemill.operators.ordered import before, up_to, within
from tidemill.operators.written import written

ORDER = ["etime", "source_rank", "seq"]
MERGED = ["day", "etime", "source_rank", "seq", "bid_price", "bid_qty", "ask_price", "ask_qty", "trade_price", "trade_qty", "trade_side"]


def _by(df: DataFrame) -> list[str]:
    """What a scan starts anew for: a day, of each symbol if there are several."""
    return [*(["symbol"] if "symbol" in df.columns else []), "day"]


def merge(quotes: DataFrame, trades: DataFrame) -> DataFrame:
    """One stream in the order (etime, quotes first, seq). trades must have `trade_side`; what a stream lacks is null."""
    by = [c for c in _by(quotes) if c in trades.columns]
    q = quotes.select(*by, "etime", F.lit(0).cast("byte").alias("source_rank"), "seq", "bid_price", "bid_qty", "ask_price", "ask_qty")
    t = trades.select(*by, "etime", F.lit(1).cast("byte").alias("source_rank"), "seq", F.col("price").alias("trade_price"), F.col("qty").alias("trade_qty"), F.col("trade_side").cast("byte").alias("trade_side"))
    return q.unionByName(t, allowMissingColumns=True).select(*by[:-1], *MERGED)


def ofi_of(b: Column, bq: Column, a: Column, aq: Column, b0: Column, bq0: Column, a0: Column, aq0: Column) -> Column:
    """The four independent parts of order-flow imbalance between a quote and the one before it; null for a first quote."""
    part = lambda when, x: F.when(when, x).otherwise(0.0)
    return F.when(b0.isNotNull(), part(b >= b0, bq) - part(b <= b0, bq0) - part(a <= a0, aq) + part(a >= a0, aq0))


def scanned(merged: DataFrame, window: int = SECOND) -> DataFrame:
    """Every event with the state after it. State starts anew each day (of each symbol).

    A day is dealt into buckets of an hour (of `window`, if that is longer). The events of the last `window` before a bucket come into it
    too, so the trailing window (t - window, t] is exact in each: the running sum less the sum up to t - window. What else
    a bucket needs of those before it is one row a bucket: the book, its last two quotes, their number, the first time. One
    exchange and one sort serve all windows, and what they give is written once for the rows and the summary.
    """
    by, width = _by(merged), max(window, HOUR)
    at = F.expr(f"(etime - pmod(etime, {width}L)) div {width}L")
    late = F.col("etime") + window > (at + 1) * width
    d = merged.withColumn("_b", F.explode(F.when(late, F.array(at, at + 1)).otherwise(F.array(at)))).withColumn("_own", F.col("_b") == at)
    w = within([*by, "_b"], ORDER)
    now = up_to(w)
    is_quote = F.col("source_rank") == 0
    signed = F.coalesce(exact_quantity(F.col("trade_qty")) * F.col("trade_side").cast("long"), F.lit(0).cast("long"))
    d = d.withColumn("_signed", signed).withColumn("_trade", (~is_quote).cast("long"))
    quote = F.when(F.col("_own") & is_quote, F.struct("bid_price", "bid_qty", "ask_price", "ask_qty"))
    d = d.withColumn("_pair", F.when(quote.isNotNull(), F.struct(quote.alias("q"), F.last(quote, ignorenulls=True).over(before(w)).alias("p"))))
    past = Window.partitionBy(*by, "_b").orderBy("etime").rangeBetween(Window.unboundedPreceding, -window)
    last = lambda c: F.last(F.when(F.col("_own"), F.col(c)), ignorenulls=True).over(now)
    trailing = lambda c: F.sum(c).over(now) - F.coalesce(F.sum(c).over(past), F.lit(0))
    d = d.withColumns({
        "bid": last("bid_price"), "ask": last("ask_price"), "_bq": last("bid_qty"), "_aq": last("ask_qty"), "_pair": last("_pair"),
        "flow_scaled": trailing("_signed"), "in_window": trailing("_trade"),
        "_quotes": F.count_if(F.col("_own") & is_quote).over(now), "_first": F.min(F.when(F.col("_own"), F.col("etime"))).over(now), "_next": F.lead("etime").over(w),
    })
    d = written(d.where("_own").drop("_own", "_signed", "_trade"))
    state = ["bid", "ask", "_bq", "_aq", "_pair", "_quotes", "_first"]
    ends = d.groupBy(*by, "_b").agg(F.max_by(F.struct(*state), F.struct(*ORDER)).alias("s")).select(*by, "_b", "s.*")
    ahead = before(Window.partitionBy(*by).orderBy("_b"))  # a row a bucket
    ends = ends.withColumn("_l", F.last(F.col("_pair")["q"], ignorenulls=True).over(ahead))
    whole = F.when(F.col("_pair").isNotNull(), F.struct(F.col("_pair")["q"].alias("q"), F.coalesce(F.col("_pair")["p"], F.col("_l")).alias("p")))
    ends = ends.withColumn("_pair", whole)
    ends = ends.select(
        *by, "_b", *(F.last(c, ignorenulls=True).over(ahead).alias(f"_0{c}") for c in state[:5]),
        F.coalesce(F.sum("_quotes").over(ahead), F.lit(0)).alias("_0_quotes"), F.min("_first").over(ahead).alias("_0_first"),
    )
    d = d.join(ends, [*by, "_b"])
    q = F.coalesce(F.col("_pair")["q"], F.col("_0_pair")["q"])
    p = F.when(F.col("_pair").isNotNull(), F.coalesce(F.col("_pair")["p"], F.col("_0_pair")["q"])).otherwise(F.col("_0_pair")["p"])
    d = d.withColumn("ofi", ofi_of(*(x[c] for x in (q, p) for c in ("bid_price", "bid_qty", "ask_price", "ask_qty"))))
    d = d.withColumns({c: F.coalesce(c, f"_0{c}") for c in state[:4]})
    d = d.withColumns({
        "mid": (F.col("bid") + F.col("ask")) / 2, "imb_top": (F.col("_bq") - F.col("_aq")) / F.nullif(F.col("_bq") + F.col("_aq"), F.lit(0.0)),
        "trade_flow": F.col("flow_scaled") / float(QTY_SCALE), "warmup": (F.col("_quotes") + F.col("_0_quotes") < 2) | (F.col("etime") < F.least("_first", "_0_first") + window),
        "is_decision": ~F.col("etime").eqNullSafe(F.col("_next")),
    })
    return d.select(*merged.columns, "bid", "ask", "ofi", "flow_scaled", "in_window", "mid", "imb_top", "trade_flow", "warmup", "is_decision")


def decisions(merged: DataFrame, window: int = SECOND) -> DataFrame:
    """The feature row of each distinct etime: the state after its last event."""
    d = scanned(merged, window).where("is_decision")
    return d.select(*_by(merged), "etime", F.col("source_rank").alias("decision_source_rank"), F.col("seq").alias("decision_seq"), F.col("bid").alias("bid_price"), F.col("ask").alias("ask_price"), "mid", "imb_top", "ofi", "trade_flow", "warmup")


def counters(merged: DataFrame, window: int = SECOND) -> DataFrame:
    """Per day: most trades in a window, events and decision rows with an empty window, crossed and locked quotes."""
    d = scanned(merged, window)
    quote = F.col("source_rank") == 0
    return d.groupBy(*_by(merged)).agg(
        F.max("in_window").alias("max_in_window"), F.count_if((F.col("in_window") == 0) & F.col("is_decision")).alias("empty_windows"), F.count_if(quote & (F.col("bid_price") > F.col("ask_price"))).alias("crossed"),
        F.count_if(quote & (F.col("bid_price") == F.col("ask_price"))).alias("locked"), F.count_if("is_decision").alias("decision_rows"), F.count("*").alias("events"),
    )


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every NaN of a float column as NULL: the only way 'undefined' is written."""
    floats = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})
