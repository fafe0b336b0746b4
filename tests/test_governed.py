"""Governed builds: what is written, what is refused, and the report's applicability."""

from __future__ import annotations

import random

import pytest

from tidemill.functions.clock import DAY, HOUR, SECOND
from tidemill.lake import Refused, Registry, load
from tidemill.operators import folds, models, simulate
from tidemill.plans import governed as g


@pytest.fixture
def registry(tmp_path):
    return Registry(tmp_path / "registry")


def day_rows(spark, days, n=40):
    return spark.createDataFrame([(d, d * DAY + k * (DAY // n), k, k % 3) for d in days for k in range(n)], "day long, etime long, id long, v long")


def test_curated_ranges_by_status(spark, registry, tmp_path):
    root = str(tmp_path / "lake")
    rows = day_rows(spark, [1, 2, 4])
    assert g.build_curated(spark, registry, root, "t", rows, [1, 2, 3, 9], today=9, code="c") == {1: "written", 2: "written", 3: "no_source", 9: "not_final"}
    first = registry.of_date("t", "1970-01-02")
    assert load(spark, registry, root, "t", first["manifest_id"], "curated", ["id"]).count() == 80
    assert g.build_curated(spark, registry, root, "t", rows, [1, 4], today=9, code="c") == {1: "already_present", 4: "written"}
    assert g.build_curated(spark, registry, root, "t", rows.where("id < 5"), [1, 3], today=9, code="d", supersede=True) == {1: "superseded", 3: "no_source"}
    now = registry.of_date("t", "1970-01-02")
    assert now["rows"] == 5 and load(spark, registry, root, "t", first["manifest_id"], "curated").count() == 80
    (tmp_path / "lake/curated/t/build=3/date=1970-01-06").mkdir(parents=True)
    assert g.build_curated(spark, registry, root, "t", day_rows(spark, [5]), [5], today=9, code="c") == {5: "orphan"}
    assert g.verify_all(spark, registry, root, "t") == []
    spark.range(1).selectExpr("id as etime").write.mode("append").parquet(f"{root}/curated/t/build=1/date=1970-01-05")
    assert g.verify_all(spark, registry, root, "t") == ["curated/t/build=1/date=1970-01-05"]


def test_curated_quotes_are_numbered_and_sent_once(spark):
    rows = spark.createDataFrame([(0, 5, 2, 1.0), (0, 5, 2, 1.0), (0, 1, 1, 1.0)], "day long, etime long, id long, bid_price double").selectExpr("*", "etime as rtime", "id as seq")
    got = g.curated_quotes(rows, "id").select("id", "seq", "source").collect()
    assert sorted(map(tuple, got)) == [(1, 0, "capture"), (2, 1, "capture")]


def decisions(spark, days=10):
    return spark.createDataFrame([(t // DAY, t, k % 2, k) for k, t in enumerate(range(0, days * DAY, HOUR))], "day long, etime long, decision_source_rank int, decision_seq long")


def segments():
    return [folds.Segment("train", "train", 0, 5 * DAY), folds.Segment("val", "val", 5 * DAY, 7 * DAY), folds.Segment("test", "held_out", 7 * DAY, 9 * DAY)]


@pytest.fixture
def features_manifest(spark, registry, tmp_path):
    root = str(tmp_path / "lake")
    g.build_curated(spark, registry, root, "f", decisions(spark).withColumnRenamed("decision_seq", "id"), list(range(10)), today=99, code="c")
    return root, [b["manifest_id"] for b in registry.manifests("f")]


def test_segments_are_issued_with_counts_and_blocks(spark, registry, features_manifest):
    _, ids = features_manifest
    assert g.covered_range(registry, "f", ids) == (0, 10 * DAY - HOUR + 1)
    body = g.issue_segments(registry, decisions(spark), "f", ids, segments(), {"val": 1}, k=5, max_age=HOUR, purge=HOUR, embargo=HOUR)
    by = {s["name"]: s for s in body["segments"]}
    assert by["val"]["counts"]["admitted"] == 48 and len(body["blocks"]) == 5 and body["train_counts"] == {"purged": 1, "embargoed": 0, "kept": 119}
    for wrong in (segments()[:2], [*segments()[:2], folds.Segment("test", "held_out", 6 * DAY, 9 * DAY)], [*segments()[:2], folds.Segment("test", "held_out", 7 * DAY, 11 * DAY)]):
        with pytest.raises(Refused):
            g.issue_segments(registry, decisions(spark), "f", ids, wrong, {})
    registry.look(body["manifest_id"], "val", 1, {})
    with pytest.raises(Refused, match="exhausted"):
        g.issue_segments(registry, decisions(spark), "f", ids, segments(), {"val": 1})


def test_a_cached_segment_costs_one_look(spark, registry, features_manifest):
    root, ids = features_manifest
    body = g.issue_segments(registry, decisions(spark), "f", ids, segments(), {"val": 1})
    for _ in range(2):
        assert g.materialise_once(spark, registry, root, body, "val", lambda: decisions(spark).where(f"etime >= {5 * DAY} and etime < {7 * DAY}"), {}).count() == 48
    assert registry.looks(body["manifest_id"], "val") == 1
    with pytest.raises(Refused, match="held out"):
        g.materialise_once(spark, registry, root, body, "test", lambda: decisions(spark), {})


def test_masks(spark):
    rows = decisions(spark, 2)
    mask = g.block_mask(rows, [(0, 10 * HOUR)], 10).select("etime", "kept")
    assert g.masked_rows(rows, mask).count() == 10
    for bad in (mask.limit(5), mask.union(mask.limit(1)), mask.selectExpr("etime", "cast(null as boolean) as kept")):
        with pytest.raises(Refused):
            g.masked_rows(rows, bad)
    with pytest.raises(Refused):
        g.block_mask(rows, [(0, 10 * HOUR)], 11)
    assert g.validate_features(models.FEATURES) and g.validate_target(models.TARGET)
    for call in (lambda: g.validate_features(("imb_top", "bid_price", "ofi")), lambda: g.validate_target("ret_1s_mid"), lambda: g.assert_ascending(rows.union(rows.limit(1)))):
        with pytest.raises(Refused):
            call()
    assert tuple(g.bounds(rows, "etime").first()) == (0, 47 * HOUR, 48) and tuple(g.bounds(rows, "none").first()) == (None, None, 48)


def test_predictions_pass_their_gates(spark, registry, tmp_path):
    root = str(tmp_path / "lake")
    frame = decisions(spark, 2).select("etime", "decision_seq")
    rows = frame.selectExpr("*", "0.5D as pred")
    body = g.issue_predictions(spark, registry, root, rows, "val", "p1", "frame", "c")
    assert g.load_predictions(spark, registry, root, body["manifest_id"], frame).count() == 48
    with pytest.raises(Refused, match="written"):
        g.issue_predictions(spark, registry, root, rows, "val", "p1", "frame", "c")
    with pytest.raises(Refused, match="meet"):
        g.load_predictions(spark, registry, root, body["manifest_id"], frame.selectExpr("etime", "decision_seq + 1 as decision_seq"))
    with pytest.raises(Refused, match="keys"):
        g.issue_predictions(spark, registry, root, rows.union(rows.limit(1)), "val", "p2", "frame", "c")
    registry.hold_out(["1970-01-02"], "x")
    with pytest.raises(Refused, match="held out"):
        g.load_predictions(spark, registry, root, body["manifest_id"], frame)


def test_normalisations_are_named_by_hash(spark, registry):
    d = spark.createDataFrame([(k, float(k), float(k % 7)) for k in range(100)], "etime long, ofi double, imb_top double")
    params = models.fit_normalisation(d, ("ofi", "imb_top"))
    name = g.write_normalisation(registry, params, ["1970-01-01"], ["m"])
    assert g.write_normalisation(registry, params, ["1970-01-01"], ["m"]) == name
    assert g.load_normalisation(registry, name)["ofi"][0] == pytest.approx(49.5)
    path = registry.root / "normalisations" / f"{name}.json"
    path.write_text(path.read_text().replace("49.5", "49.6"))
    with pytest.raises(Refused, match="hash"):
        g.load_normalisation(registry, name)
    flat = models.fit_normalisation(d.selectExpr("etime", "1D as ofi"), ("ofi",))
    with pytest.raises(Refused, match="spread"):
        g.write_normalisation(registry, flat, [], [])
    other = g.write_normalisation(registry, params, ["1970-01-05"], [])
    registry.hold_out(["1970-01-05"], "x")
    with pytest.raises(Refused, match="held out"):
        g.load_normalisation(registry, other)


def test_the_report_holds_the_checks_that_apply(spark):
    quotes = spark.createDataFrame([(d, d * DAY + k * HOUR, d * DAY + k * HOUR + SECOND, 1.0, 2.0) for d in (1, 2, 3) for k in range(24)], "day long, etime long, rtime long, bid_price double, ask_price double")
    late = {1: 10 * DAY, 2: None, 3: 10 * DAY, 4: None}
    trades = spark.createDataFrame([(d, d * DAY + k * HOUR, late[d] or d * DAY + k * HOUR + SECOND, k) for d in (1, 2, 3, 4) for k in range(24)], "day long, etime long, rtime long, id long")
    sources = spark.createDataFrame([(1, "archive", False, True), (2, "capture", True, True), (3, "archive", True, True), (4, "capture", True, False)], "day long, source string, capture boolean, stats boolean")
    ledger = spark.createDataFrame([(d * DAY, d * DAY + 120 * SECOND, "merged-silent", 2) for d in (1, 2)], "gap_start_rtime long, gap_end_rtime long, cause string, ledger_version int")
    recon = spark.createDataFrame([(d, 100, 0, 0) for d in (1, 2, 3)], "day long, in_both long, archive_only long, capture_only long")
    holders = spark.createDataFrame([(d, 99, 1) for d in (1, 2, 3)], "day long, kept long, dropped long")
    got = {}
    for r in g.day_report(quotes, trades, sources, ledger, recon, holders, 20 * DAY).collect():
        got.setdefault((r["day"], r["stream"]), {})[r["check"]] = r["status"]
    assert got[1, "trade"]["gap_coverage"] == "n/a" and got[2, "trade"]["gap_coverage"] == "degraded" and got[1, "quote"]["gap_coverage"] == "degraded" and got[3, "quote"]["gap_coverage"] == "ok"
    assert got[1, "trade"]["probable_loss"] == "ok" and got[3, "trade"]["probable_loss"] == "n/a" and "probable_loss" not in got[2, "trade"]
    assert got[4, "trade"]["build_stats"] == "failed" and "reconciliation" not in got[4, "trade"] and "build_stats" not in got[1, "trade"]
    assert got[1, "trade"]["reconciliation"] == got[1, "trade"]["na_placeholder"] == "ok"
    assert {"crossed_locked_book", "l1_sparsity", "etime_plausibility", "rtime_plausibility", "gap_coverage"} == set(got[1, "quote"])
    assert all(s[c] == "ok" for k, s in got.items() for c in s if c.endswith("plausibility")), got


def test_steps_are_those_of_the_batch(spark):
    r = random.Random(1)
    rows = []
    for k in range(300):
        bid = 1000 + r.randrange(5)
        rows.append((k // 50, k, bid / 10, (bid + 1) / 10, (bid + r.randrange(-6, 7)) / 10))
    d = spark.createDataFrame(rows, "day long, etime long, bid_price double, ask_price double, pred double")
    want = sorted(map(tuple, simulate.simulated(d, 3)[0].select("etime", "position").collect()))
    got = list(g.steps([(t, round(b * 10), round(a * 10), p) for _, t, b, a, p in rows], 3))
    assert [(t, p) for t, p, _ in got] == want
    assert sum(c for *_, c in got) == simulate.simulated(d, 3)[1].count()
    with pytest.raises(Refused):
        list(g.steps([(1, 1000, 1001, float("nan"))]))
