from __future__ import annotations

import json
import random

import pytest

from tidemill.functions import catalogue
from tidemill.functions.clock import DAY, SECOND
from tidemill.lake import Refused, Registry
from tidemill.operators import curate, folds, quality
from tidemill.plans import build, slice

Q = "day long, etime long, seq long, bid_price double, bid_qty double, ask_price double, ask_qty double"
T = "day long, etime long, seq long, price double, qty double, is_buyer_maker boolean"


def market(spark, days=2, n=400):
    """Quotes whose imbalance moves the next quote, and trades."""
    r, mid, quotes, trades = random.Random(1), 1000, [], []
    for k in range(days * n):
        t = k * 4 * SECOND + (k // n) * (DAY - n * 4 * SECOND)
        up = r.random()
        quotes.append((k // n, t, k, mid / 10, float(1 + int(up * 9)), (mid + 1) / 10, float(10 - int(up * 9))))
        trades.append((k // n, t + SECOND, k, mid / 10, 0.5, up < 0.5))
        mid += 3 if up > 0.6 else -3 if up < 0.4 else 0
    return spark.createDataFrame(quotes, Q), curate.with_sides(spark.createDataFrame(trades, T))


def test_feature_rows_have_sixteen_columns_and_are_written_once(spark, tmp_path):
    quotes, trades = market(spark)
    statuses = build.buildable([0, 1, 2], {0, 1}, set(), set())
    assert statuses == {0: "ready", 1: "next_day_missing", 2: "no_source"}
    done = build.build(quotes, trades, str(tmp_path / "f"), [0, 1, 2], statuses)
    assert done[0] == "written"
    rows = spark.read.parquet(str(tmp_path / "f"))
    assert len(rows.drop("day", "date").columns) == 16 and rows.where("day = 0").count() == rows.count() == 800
    assert build.buildable([0, 1], {0, 1, 2}, {0}, {2}) == {0: "already_present", 1: "quarantined"}
    assert rows.where("ret_10s_mid is not null").count() > 700


def test_slice_selects_freezes_and_looks_once(spark, tmp_path):
    quotes, trades = market(spark, 1, 1500)
    rows = build.feature_rows(quotes, trades).cache()
    end = 1500 * 4 * SECOND
    segments = [folds.Segment("train", "train", 0, end // 2), folds.Segment("val", "val", end // 2, end - 100 * SECOND), folds.Segment("test", "held_out", end - 100 * SECOND, end)]
    how = {"target": "ret_10s_mid", "purge": 10 * SECOND, "embargo": SECOND, "max_age": 5 * SECOND}
    chosen = slice.select(rows, segments, 3, **how)
    assert chosen["config"] and chosen["mean_ic"] > 0.2
    frozen = json.loads(json.dumps(slice.freeze(rows, segments, chosen, **how)))
    registry = Registry(tmp_path)
    out = slice.validate(rows, segments, frozen, **how, registry=registry, manifest="m")
    assert out["forecast_gate"] == "pass" and out["pnl_ticks"] < out["ceiling_ticks"]
    with pytest.raises(Refused, match="looks"):
        slice.validate(rows, segments, frozen, **how, registry=registry, manifest="m")


def test_predictions_are_written_once(spark, tmp_path):
    d = spark.createDataFrame([(1, 1, 0.5)], "etime long, decision_seq long, pred double")
    build.write_predictions(d, str(tmp_path), "val", "p")
    assert build.read_predictions(spark, str(tmp_path), "val", "p").collect() == d.collect()
    with pytest.raises(Exception):
        build.write_predictions(d, str(tmp_path), "val", "p")
    with pytest.raises(Refused):
        build.write_predictions(d.selectExpr("null as etime", "decision_seq", "pred"), str(tmp_path), "val", "q")


def test_information_sets():
    s = catalogue.sight
    assert s("t") == catalogue.Sight() and s("[prev_l1_update, t]") == catalogue.Sight(back=None, updates=1)
    assert s("[t-1s, t]").back == SECOND and s("data through t + 10min").ahead == 600 * SECOND
    both = s("data through t + 10s for the VALUE; arrivals through t + 10s + label_gap.max_quote_gap_seconds decide")
    assert both.ahead == 10 * SECOND and both.widened_by
    for bad in ("", "T", "[t-2s, t]", "[t-1s, t)", "data through t + 10s for the VALUE", "data through t + 10s; t + 10s + x", "data through t + 10s for the VALUE; t + 1s + label_gap.max_quote_gap_seconds"):
        with pytest.raises(ValueError):
            s(bad)
    assert catalogue.embargo(">= 1min") == 60 * SECOND


def test_catalogue_entries(tmp_path):
    body = 'horizon = "10s"\ncomputation = "c|d"\ninformation_set = "data through t + 10s"\nembargo = ">= {}"\nnotes = ""\nversion = 1\nintroduced = "x"\n'
    (tmp_path / "a.toml").write_text("[r]\n" + body.format("10s"))
    entries = catalogue.load(tmp_path / "a.toml", catalogue.LABEL_KEYS)
    assert catalogue.get(entries, "r").sight.ahead == 10 * SECOND and "c\\|d" in catalogue.markdown(entries, "computation")
    with pytest.raises(KeyError):
        catalogue.get(entries, "x")
    (tmp_path / "a.toml").write_text("[r]\n" + body.format("1s"))
    with pytest.raises(ValueError):
        catalogue.load(tmp_path / "a.toml", catalogue.LABEL_KEYS)


def test_errata_holdout_and_quarantine(spark, tmp_path):
    from tidemill.lake import load, partition_entry

    registry, root = Registry(tmp_path / "r"), str(tmp_path / "lake")
    spark.range(3).selectExpr("id as etime").write.parquet(f"{root}/features/d=2")
    body = registry.issue("f", "features", 1, [], [partition_entry(spark, root, "features/d=2", "2024-01-02")], "c")
    assert registry.declare_holdout(["2024-01-02"], "x", dry_run=True) == ["2024-01-01", "2024-01-02"] and not registry.held_out()
    box = registry.quarantine("f", "2024-01-02", root, "held out")
    assert load(spark, registry, root, "f-lockbox", box["manifest_id"], "lockbox").count() == 3
    with pytest.raises(Exception):
        load(spark, registry, root, "f", body["manifest_id"], "features").count()
    key = registry.issue_errata("f", [{"etime": 1, "decision_seq": 2, "shape": "zero_to_null"}], body["manifest_id"])
    assert registry.errata("f", key)[0]["etime"] == 1
    with pytest.raises(Refused):
        registry.issue_errata("f", [{"etime": 1, "decision_seq": 2, "shape": "other"}], "m")


def test_report_and_verdict(spark, tmp_path):
    r = spark.createDataFrame([(1, "q", "a|b", "ok", 1.0, 2, None), (1, "q", "c", "degraded", None, None, "x"), (2, "q", "c", "n/a", None, None, None)], "day long, stream string, check string, status string, value double, count long, detail string")
    assert "a\\|b" in quality.write_report(r, str(tmp_path / "rep"))
    assert {x["day"]: x["verdict"] for x in quality.verdict(r).collect()} == {1: "degraded", 2: "missing"}
