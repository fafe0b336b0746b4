"""Fixed-point arithmetic: quantities at 1e-8 and prices in ticks, as LONGs; rounding is half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quantity scale, price scale, a tick and a lot on those scales.
QTY_SCALE, PRICE_SCALE, TICK_SCALED, LOT_SCALED = 10**8, 10**8, 10**7, 10**5


#: The most notional whose product with the quantity scale fits a LONG.
MOST_NOTIONAL = (2**63 - 1) // QTY_SCALE


def scaled(value: Column, scale: int = QTY_SCALE) -> Column:
    """value * scale as a LONG; fails for what is not finite."""
    ok = value.isNull() | (~F.isnan(value) & (F.abs(value) < float("inf")))
    return F.when(ok, F.rint(value * float(scale)).cast("long")).otherwise(F.raise_error(F.lit("value is not finite")).cast("long"))


def floor_div(a: Column, b) -> Column:
    """Division that floors, for any sign of a and a positive b."""
    b = b if isinstance(b, Column) else F.lit(b)
    rest = F.pmod(a, b)
    return ((a - rest).cast("decimal(38,0)") / b.cast("decimal(20,0)")).cast("long")


def ceil_div(a: Column, b) -> Column:
    return -floor_div(-a, b)


def price_to_ticks(price: Column) -> Column:
    """A price in whole ticks of 0.1, rounded down; fails for half a tick or more above one, and for a price that its LONG does not give back to 1e-6."""
    s = scaled(price, PRICE_SCALE)
    close = F.abs(s / float(PRICE_SCALE) - price) < 1e-6
    near = F.pmod(s, F.lit(TICK_SCALED)) < TICK_SCALED // 2
    return F.when(price.isNull() | (close & near), floor_div(s, TICK_SCALED)).otherwise(F.raise_error(F.concat(F.lit("not near a whole tick: "), price.cast("string"))).cast("long"))


def exact_quantity(value: Column) -> Column:
    """A quantity on the 1e-8 scale; fails for one that lies between two of its steps."""
    s = scaled(value)
    return F.when(value.isNull() | (s / float(QTY_SCALE) == value), s).otherwise(F.raise_error(F.concat(F.lit("not on the quantity scale: "), value.cast("string"))).cast("long"))


def position_size(price_ticks: Column, max_notional_scaled: int, lot_scaled: int = LOT_SCALED) -> Column:
    """Quantity on the 1e-8 scale that max_notional buys at this price, in whole lots."""
    if max_notional_scaled > MOST_NOTIONAL:
        raise ValueError(f"a notional of {max_notional_scaled} is above {MOST_NOTIONAL}")
    most = floor_div(F.lit(max_notional_scaled).cast("decimal(38,0)") * QTY_SCALE, price_ticks.cast("decimal(20,0)") * TICK_SCALED)
    return floor_div(most, lot_scaled) * lot_scaled


def ticks_to_price(ticks: Column) -> Column:
    """A whole number of ticks as a price."""
    return ticks / F.lit(10.0)
