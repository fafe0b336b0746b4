"""The features and labels against a plain sequential rendering of their rules, and the boundary cases one by one."""

from __future__ import annotations

import random

import pytest

from tidemill.functions.clock import SECOND
from tidemill.operators import features, labels, ordered

W = SECOND
Q = "day long, etime long, source_rank byte, seq long, bid_price double, bid_qty double, ask_price double, ask_qty double, trade_price double, trade_qty double, trade_side byte"


def quote(t, seq, b, bq, a, aq, day=0):
    return (day, t, 0, seq, float(b), float(bq), float(a), float(aq), None, None, None)


def trade(t, seq, qty, side, day=0):
    return (day, t, 1, seq, None, None, None, None, 100.0, float(qty), side)


def walked(events):
    out, book, ofi, quotes, first, done = [], None, None, 0, None, []
    events = sorted(events, key=lambda e: (e[0], e[1], e[2], e[3]))
    for i, e in enumerate(events):
        if i and e[0] != events[i - 1][0]:
            book, ofi, quotes, first, done = None, None, 0, None, []
        first = e[1] if first is None else first
        if e[2] == 0:
            new = e[4:8]
            if book:
                ofi = (new[1] if new[0] >= book[0] else 0) - (book[1] if new[0] <= book[0] else 0) - (new[3] if new[2] <= book[2] else 0) + (book[3] if new[2] >= book[2] else 0)
            book, quotes = new, quotes + 1
        else:
            done.append((e[1], round(e[9] * 1e8) * e[10]))
        if i + 1 < len(events) and events[i + 1][:2] == e[:2]:
            continue
        flow = sum(v for t, v in done if e[1] - W < t <= e[1]) / 1e8
        mid = (book[0] + book[2]) / 2 if book else None
        imb = (book[1] - book[3]) / (book[1] + book[3]) if book else None
        out.append((e[0], e[1], e[3], mid, imb, ofi, flow, quotes < 2 or e[1] < first + W))
    return out


def decided(spark, events):
    d = features.decisions(spark.createDataFrame(events, Q), W)
    return sorted(tuple(r) for r in d.select("day", "etime", "decision_seq", "mid", "imb_top", "ofi", "trade_flow", "warmup").collect())


SHAPES = {
    "trade_before_quote": [trade(0, 1, 1, 1), quote(10, 2, 100, 1, 101, 2)],
    "window_open_end": [quote(0, 1, 100, 1, 101, 2), trade(0, 2, 1, 1), quote(W, 3, 100, 1, 101, 2)],
    "window_one_inside": [quote(0, 1, 100, 1, 101, 2), trade(1, 2, 1, 1), quote(W, 3, 100, 1, 101, 2)],
    "cancelled": [quote(0, 1, 100, 1, 101, 2), trade(5, 2, 1, 1), trade(5, 3, 1, -1)],
    "unknown_side": [quote(0, 1, 100, 1, 101, 2), trade(5, 2, 1, 0)],
    "repeated_quote": [quote(0, 1, 100, 1, 101, 2), quote(5, 2, 100, 1, 101, 2)],
    "bid_up_ask_down": [quote(0, 1, 100, 1, 103, 2), quote(5, 2, 101, 3, 102, 4)],
    "bid_down_ask_up": [quote(0, 1, 100, 1, 101, 2), quote(5, 2, 99, 3, 102, 4)],
    "resized": [quote(0, 1, 100, 1, 101, 2), quote(5, 2, 100, 7, 101, 9)],
    "locked_and_crossed": [quote(0, 1, 100, 1, 100, 2), quote(5, 2, 101, 1, 100, 2), quote(9, 3, 100, 1, 101, 2)],
    "ties": [quote(0, 1, 100, 1, 101, 2), trade(0, 1, 2, 1), quote(0, 2, 101, 1, 102, 2), trade(0, 2, 3, -1)],
    "new_day": [quote(0, 1, 100, 1, 101, 2), trade(5, 2, 1, 1), quote(6, 3, 100, 2, 101, 2, day=1)],
    "single": [quote(0, 1, 100, 1, 101, 2)],
}


@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_shape(spark, shape):
    assert decided(spark, SHAPES[shape]) == walked(SHAPES[shape])


def stream(seed, n=60):
    r, out, t = random.Random(seed), [], 0
    for k in range(n):
        t += r.choice([0, 0, 1, W // 2, W, 2 * W, 31 * W])
        day = k * 3 // n
        if r.random() < 0.4:
            out.append(trade(t, k, r.randrange(1, 9) / 8, r.choice([-1, 0, 1]), day))
        else:
            b = r.randrange(90, 110)
            out.append(quote(t, k, b, r.randrange(1, 9), b + r.choice([0, 1, 2, -1]), r.randrange(1, 9), day))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_random_streams(spark, seed):
    events = stream(seed)
    assert decided(spark, events) == walked(events)


def test_the_future_does_not_leak(spark):
    events = stream(11)
    cut = sorted(e[1] for e in events)[len(events) // 2]
    past = [e for e in events if e[1] <= cut]
    assert [r for r in decided(spark, events) if r[1] <= cut] == decided(spark, past)


def test_a_leak_would_show(spark):
    """The check above fails for a feature that looks ahead."""
    d = features.scanned(spark.createDataFrame(stream(11), Q), 10 * W).where("is_decision")
    ahead = d.selectExpr("etime", "lead(mid) over (order by etime) as x")
    events = sorted(e[1] for e in stream(11))
    cut = events[len(events) // 2]
    part = features.scanned(spark.createDataFrame([e for e in stream(11) if e[1] <= cut], Q), 10 * W).where("is_decision").selectExpr("etime", "lead(mid) over (order by etime) as x")
    assert {tuple(r) for r in ahead.where(f"etime <= {cut}").collect()} != {tuple(r) for r in part.collect()}


QUOTES = "day long, etime long, seq long, bid_price double, bid_qty double, ask_price double, ask_qty double"


def slow_label(t, mid, quotes, h, gap):
    past = [q for q in quotes if q[0] <= t + h]
    if mid is None or not past:
        return None, "null_no_mid"
    if t + h > max(q[0] for q in quotes):
        return None, "null_past_end"
    times = sorted({q[0] for q in quotes})
    if any(b - a > gap and a < t + h and b > t for a, b in zip(times, times[1:])):
        return None, "null_gap"
    last = max(past)
    if last[0] <= t:
        return None, "null_stale"
    return (last[2] - mid) / mid, None


@pytest.mark.parametrize("seed", range(3))
def test_labels_against_the_rule(spark, seed):
    r, t, quotes = random.Random(seed), 0, []
    for k in range(60):
        t += r.choice([0, 1, 2, 5, 10, 31]) * SECOND
        quotes.append((t, k, 100 + r.randrange(9)))
    probes = [(r.randrange(-5, t // SECOND + 5) * SECOND, r.choice([100.0, 101.0, None])) for _ in range(80)]
    probes = list(dict(probes).items())
    q = spark.createDataFrame([(0, a, b, float(c), 1.0, float(c), 1.0) for a, b, c in quotes], QUOTES)
    p = spark.createDataFrame(probes, "etime long, mid double")
    got = {x["etime"]: (x["label"], x["reason"]) for x in labels.labels(p, q, 10 * SECOND, 30 * SECOND).collect()}
    assert got == {t: slow_label(t, m, quotes, 10 * SECOND, 30 * SECOND) for t, m in probes}


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("forward", [False, True])
def test_asof_with_ties(spark, strict, forward):
    r = random.Random(5)
    builds = [(r.randrange(40), k, float(k)) for k in range(60)]
    probes = [(k, t) for k, t in enumerate(r.randrange(45) for _ in range(50))]
    got = ordered.asof(spark.createDataFrame(probes, "k long, t long"), spark.createDataFrame(builds, "t long, seq long, v double"), "t", ["v"], 7, strict, forward)
    for row in got.collect():
        if forward:
            fit = [b for b in builds if (b[0] > row["t"] if strict else b[0] >= row["t"])]
            want = min(fit)[2] if fit else None
        else:
            fit = [b for b in builds if (b[0] < row["t"] if strict else b[0] <= row["t"])]
            want = max(fit)[2] if fit else None
        assert row["v"] == want, row
    assert got.count() == 50


@pytest.mark.parametrize("seed", range(3))
def test_state_goes_over_buckets_of_a_day(spark, monkeypatch, seed):
    """Buckets of two windows: books, order flow, trailing sums and warm-up go on from one to the next."""
    monkeypatch.setattr(features, "HOUR", 2 * W)
    events = stream(seed, 120)
    assert len({e[1] // (2 * W) for e in events}) > 5
    assert decided(spark, events) == walked(events)


def test_symbols_do_not_mix(spark):
    one, two = stream(1), stream(2)
    both = spark.createDataFrame([("a", *e) for e in one] + [("b", *e) for e in two], "symbol string, " + Q)
    got = features.decisions(both, W)
    for symbol, events in (("a", one), ("b", two)):
        rows = got.where(f"symbol = '{symbol}'").select("day", "etime", "decision_seq", "mid", "imb_top", "ofi", "trade_flow", "warmup").collect()
        assert sorted(map(tuple, rows)) == walked(events)
