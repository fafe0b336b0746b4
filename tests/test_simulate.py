from __future__ import annotations

import random

import pytest

from tidemill.operators import simulate

ROWS = "day long, etime long, go_long boolean, go_short boolean, bid_ticks long, ask_ticks long"


def walked(rows):
    pos, out = 0, []
    for r in sorted(rows, key=lambda r: r[1]):
        up, down = r[2], r[3]
        pos = (1 if up else -1 if down else 0) if pos == 0 else (-1 if down else 1) if pos > 0 else (1 if up else -1)
        out.append((r[1], pos))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_positions_with_rows_that_trigger_both(spark, seed):
    r = random.Random(seed)
    rows = [(k // 25, k, r.random() < 0.25, r.random() < 0.25, 1000, 1001) for k in range(200)]
    got = simulate.positions(spark.createDataFrame(rows, ROWS)).select("etime", "position").collect()
    assert sorted(map(tuple, got)) == walked(rows)


def test_three_fills_two_flips_four_ticks(spark):
    frame = [(0, 1, 100.0, 100.1, 101.0), (0, 2, 100.4, 100.5, 99.0), (0, 3, 100.2, 100.3, 101.0)]
    rows, fills = simulate.simulated(spark.createDataFrame(frame, "day long, etime long, bid_price double, ask_price double, pred double"))
    log = sorted(map(tuple, fills.select("etime", "side", "price_ticks").collect()))
    assert log == [(1, 1, 1001), (2, -1, 1004), (3, 1, 1003)]
    assert tuple(simulate.closed_pnl(fills).first()) == (3, 4)
    curve = {r["etime"]: r["equity"] for r in simulate.equity(rows, fills).collect()}
    qty = {r["etime"]: r["qty_scaled"] for r in fills.collect()}
    assert curve[1] == -qty[1] and curve[2] == 3 * qty[1] - qty[2] and curve[3] == 3 * qty[1] + qty[2] - qty[3]


def test_no_prediction_above_the_spread_gives_no_trade(spark):
    frame = [(0, t, 100.0, 100.1, 100.05) for t in range(5)]
    rows, fills = simulate.simulated(spark.createDataFrame(frame, "day long, etime long, bid_price double, ask_price double, pred double"))
    assert fills.count() == 0 and tuple(simulate.closed_pnl(fills).first()) == (0, 0)


def test_prices_off_the_grid_are_refused(spark):
    frame = [(0, 1, 100.05, 100.1, 1.0)]
    with pytest.raises(Exception, match="near a whole tick"):
        simulate.arrays(spark.createDataFrame(frame, "day long, etime long, bid_price double, ask_price double, pred double")).collect()


def test_bad_predictions_are_found_with_the_first_time(spark):
    frame = [(0, 1, 1000, 1001, 5.0), (0, 2, 1000, 1001, -1.0), (0, 3, 1000, 1001, float("nan"))]
    assert tuple(simulate.refusals(spark.createDataFrame(frame, "day long, etime long, bid_ticks long, ask_ticks long, pred double")).first()) == (2, 2)


def test_ceiling_guard():
    simulate.guard_against_ceiling(3, 4, "val")
    with pytest.raises(ValueError):
        simulate.guard_against_ceiling(4, 4, "val")


def test_prices_within_half_a_tick_are_floored(spark):
    frame = [(0, k, p, p, 1.0) for k, p in enumerate((100.0, 100.04, 100.0499, 99.9))]
    rows = simulate.arrays(spark.createDataFrame(frame, "day long, etime long, bid_price double, ask_price double, pred double"))
    assert [r["bid_ticks"] for r in rows.orderBy("etime").collect()] == [1000, 1000, 1000, 999]


def test_refused_rows_do_not_run(spark):
    for pred in (None, -1.0, float("nan"), float("inf")):
        frame = [(0, 1, 100.0, 100.1, 101.0), (0, 2, 100.0, 100.1, pred)]
        with pytest.raises(Exception, match="refused"):
            simulate.simulated(spark.createDataFrame(frame, "day long, etime long, bid_price double, ask_price double, pred double"))[0].collect()


def test_notional_is_bounded_and_a_hundred_by_default(spark):
    from pyspark.sql import functions as F

    from tidemill.functions import fixed

    price = spark.createDataFrame([(1000,)], "p long")
    assert price.select(fixed.position_size(F.col("p"), simulate.MAX_NOTIONAL)).first()[0] == 10**8
    with pytest.raises(ValueError):
        fixed.position_size(F.col("p"), fixed.MOST_NOTIONAL + 1)
