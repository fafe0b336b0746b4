"""The flip-only threshold policy in whole ticks, as running windows over days with carried state.

At each decision row a prediction above the ask by more than x is a long trigger, one below the bid by more
than x a short trigger. Flat, a long trigger wins; a long position answers to short triggers alone and a short
one to long triggers alone. So a row with one trigger sets the position to its sign, and a row with both flips it (from flat:
long). With d the last single trigger and k the rows with both after it, the position is d * (-1)**k, or without d 0
for k = 0 and (-1)**(k - 1) else: two carried values, no state machine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.fixed import LOT_SCALED, PRICE_SCALE, TICK_SCALED, ceil_div, floor_div, position_size, price_to_ticks
from tidemill.operators.ordered import before, carry, up_to, within
from tidemill.operators.written import written

#: Most notional at the 1e-8 scale (a fixed value: 100).
MAX_NOTIONAL = 100 * 10**8


def arrays(df: DataFrame) -> DataFrame:
    """(day, etime, bid_ticks, ask_ticks, pred) of rows with prices; fails for prices off the grid."""
    return df.where("bid_price is not null and ask_price is not null").select("day", "etime", price_to_ticks(F.col("bid_price")).alias("bid_ticks"), price_to_ticks(F.col("ask_price")).alias("ask_ticks"), "pred")


def _refused() -> Column:
    bad = F.isnan("pred") | (F.abs("pred") == float("inf")) | (F.col("pred") < 0) | (F.col("bid_ticks") <= 0) | (F.col("ask_ticks") <= 0)
    return F.coalesce(bad, F.lit(True))


def refusals(rows: DataFrame) -> DataFrame:
    """The smallest etime of a row whose prediction is missing, negative or not finite, or whose prices are not positive: null if all can be run."""
    return rows.agg(F.min(F.when(_refused(), F.col("etime"))).alias("first_bad"), F.count_if(_refused()).alias("bad_rows"))


def checked(rows: DataFrame) -> DataFrame:
    """rows, failing at the first that `refusals` would count."""
    told = F.concat(F.lit("refused: the row of etime "), F.col("etime").cast("string"))
    return rows.withColumn("pred", F.when(_refused(), F.raise_error(told).cast("double")).otherwise(F.col("pred")))


def triggers(rows: DataFrame, x_bps: int = 0) -> DataFrame:
    s = F.rint(F.col("pred") * float(PRICE_SCALE)).cast("long")
    x = floor_div((F.col("bid_ticks") + F.col("ask_ticks")) * x_bps, 20000)
    up = floor_div(s, TICK_SCALED) > F.col("ask_ticks") + x
    down = ceil_div(s, TICK_SCALED) < F.col("bid_ticks") - x
    return rows.withColumn("go_long", up).withColumn("go_short", down)


def _position(last: Column, k: Column) -> Column:
    """The position after k rows with both triggers in all, of which `last`, the last row with one, has seen some."""
    left = k - F.coalesce(last["k"], F.lit(0))
    flip = F.when(left % 2 == 0, 1).otherwise(-1)
    return F.when(last.isNotNull(), last["d"] * flip).when(left == 0, 0).otherwise(-flip).cast("int")


def positions(rows: DataFrame, bucket: str = "day") -> DataFrame:
    """rows with `position` after each row and `was` before it, carried over days."""
    one, both = F.col("go_long") != F.col("go_short"), F.col("go_long") & F.col("go_short")
    w = within(bucket, ["etime"])
    d = rows.withColumn("_k", F.count_if(both).over(up_to(w)))
    sign = F.when(one, F.struct(F.when(F.col("go_long"), 1).otherwise(-1).alias("d"), F.col("_k").alias("k")))
    d = d.withColumn("_s", F.last(sign, ignorenulls=True).over(up_to(w)))
    d = written(d.withColumns({"_k1": F.coalesce(F.lag("_k").over(w), F.lit(0)), "_s1": F.lag("_s").over(w)}))
    past = before(Window.orderBy(bucket))  # a row a bucket
    ends = d.groupBy(bucket).agg(F.max("_k").alias("k"), F.max_by("_s", "etime").alias("s"))
    ends = ends.withColumn("_k0", F.coalesce(F.sum("k").over(past), F.lit(0)))
    moved = lambda s: F.when(s.isNotNull(), F.struct(s["d"].alias("d"), (s["k"] + F.col("_k0")).alias("k")))
    ends = ends.select(bucket, "_k0", F.last(moved(F.col("s")), ignorenulls=True).over(past).alias("_s0"))
    d = d.join(ends, bucket)
    at = lambda s, k: _position(F.coalesce(moved(F.col(s)), F.col("_s0")), F.col("_k0") + F.col(k))
    return d.select(*rows.columns, at("_s", "_k").alias("position"), at("_s1", "_k1").alias("was"))


def fills(rows: DataFrame, max_notional: int = MAX_NOTIONAL, lot: int = LOT_SCALED, bucket: str = "day") -> DataFrame:
    """(day, etime, side, price_ticks, qty_scaled, position_after) of every change of position; fails if a fill has no lot."""
    d = rows.where(F.col("position") != F.col("was"))
    price = F.when(F.col("position") > 0, F.col("ask_ticks")).otherwise(F.col("bid_ticks"))
    qty = position_size(price, max_notional, lot)
    qty = F.when(qty > 0, qty).otherwise(F.raise_error(F.lit("the position has no lot")).cast("long"))
    return d.select(bucket, "etime", F.col("position").alias("side"), price.alias("price_ticks"), qty.alias("qty_scaled"), F.col("position").alias("position_after"))


def _won(old: Column, price: Column) -> Column:
    """What a fill at this price realises of the one before it; 0 if there is none."""
    return F.coalesce(old["side"].cast("long") * (price - old["price_ticks"]) * old["qty_scaled"], F.lit(0).cast("long"))


def equity(rows: DataFrame, trades: DataFrame, bucket: str = "day") -> DataFrame:
    """(day, etime, position, equity): what flips have realised with the old quantity, plus the open position marked at the price that would close it, in ticks times quantity."""
    w = within(bucket, ["etime"])
    d = rows.select(bucket, "etime", "position", "bid_ticks", "ask_ticks")
    d = d.join(trades.select("etime", F.struct("side", "price_ticks", "qty_scaled").alias("_f")), "etime", "left")
    old = F.last("_f", ignorenulls=True).over(before(w))
    d = d.withColumn("_w", F.when(F.col("_f").isNotNull(), _won(old, F.col("_f.price_ticks"))).otherwise(0))
    d = written(d.withColumns({"_r": F.sum("_w").over(up_to(w)), "_o": F.last("_f", ignorenulls=True).over(up_to(w))}))
    past, some = before(Window.orderBy(bucket)), F.when(F.col("_f").isNotNull(), F.col("etime"))
    ends = d.groupBy(bucket).agg(F.sum("_w").alias("w"), F.min_by("_f", some).alias("_first"), F.max_by("_f", some).alias("l"))  # a row a bucket
    ends = ends.withColumn("_l0", F.last("l", ignorenulls=True).over(past))
    ends = ends.withColumn("_w0", F.when(F.col("_first").isNotNull(), _won(F.col("_l0"), F.col("_first.price_ticks"))).otherwise(0))
    ends = ends.select(bucket, "_l0", "_w0", F.coalesce(F.sum(F.col("w") + F.col("_w0")).over(past), F.lit(0)).alias("_r0"))
    d = d.join(ends, bucket).withColumn("_open", F.coalesce("_o", "_l0"))
    realised = F.col("_r0") + F.col("_r") + F.when(F.col("_o").isNotNull(), F.col("_w0")).otherwise(0)
    mark = F.when(F.col("_open.side") > 0, F.col("bid_ticks")).otherwise(F.col("ask_ticks"))
    return d.select(bucket, "etime", "position", (realised + _won(F.col("_open"), mark)).alias("equity"))


def closed_pnl(trades: DataFrame, bucket: str = "day") -> DataFrame:
    """(trades, pnl_ticks): every fill but the last is closed by the next."""
    t = carry(trades.withColumn("_f", F.struct("side", "price_ticks")), {"_old": F.col("_f")}, bucket, ["etime"], inclusive=False)
    won = F.col("_old.side") * (F.col("price_ticks") - F.col("_old.price_ticks"))
    return t.agg(F.count("*").alias("trades"), F.coalesce(F.sum(won), F.lit(0)).cast("long").alias("pnl_ticks"))


def simulated(df: DataFrame, x_bps: int = 0, fee_bps: int = 0, latency_ns: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows with positions, fills) of rows (day, etime, bid_price, ask_price, pred), none of which may be refused. fee_bps and latency_ns are reserved."""
    rows = positions(triggers(checked(arrays(df)), x_bps))
    return rows, fills(rows)


def ceiling(df: DataFrame, label: str) -> DataFrame:
    """Closed P&L of a forecaster that knows the label."""
    known = df.where(F.col(label).isNotNull()).withColumn("pred", F.col("mid") * (1 + F.col(label)))
    return closed_pnl(simulated(known)[1])


def monetisation_gate(trades: Column, pnl: Column) -> Column:
    return F.when(trades <= 0, "no_trades").when(pnl <= 0, "pnl_not_positive").otherwise("pass")


def guard_against_ceiling(pnl_ticks: int, ceiling_ticks: int, segment: str) -> None:
    if pnl_ticks >= ceiling_ticks:
        raise ValueError(f"{segment}: {pnl_ticks} ticks are not below the ceiling of {ceiling_ticks}")


def usd(ticks: Column, lot: float = 0.001) -> Column:
    return ticks * 0.1 * lot


def daily_sharpe(curve: DataFrame, least_days: int = 30) -> DataFrame:
    """mean / deviation * sqrt(365) of the days' P&L; null below least_days or without spread."""
    end = curve.groupBy("day").agg(F.max_by("equity", "etime").alias("e"))
    d = end.withColumn("pnl", F.col("e") - F.coalesce(F.lag("e").over(Window.orderBy("day")), F.lit(0)))  # a row a day
    s = F.stddev_samp(F.col("pnl").cast("double"))
    return d.agg(F.count("*").alias("days"), F.when((F.count("*") >= least_days) & (s > 0), F.avg("pnl") / s * F.sqrt(F.lit(365.0))).alias("sharpe"))
