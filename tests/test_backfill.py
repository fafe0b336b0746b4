"""Backfill by months and days, downloads that go on, numbers that go on, and the watchdog."""

from __future__ import annotations

import hashlib

import pytest

from tidemill.functions.clock import SECOND
from tidemill.operators import curate
from tidemill.sources import archive
from tidemill.streaming.watchdog import Watchdog

UNIT = archive.units("um", "trades")


def trades(spark, days, n=5):
    raw = spark.createDataFrame([(d * 100 + k, "1.5", "2", "3", d * 86400000 + k * 1000, True) for d in days for k in range(n)], UNIT.columns)
    return archive.normalised(raw, UNIT, "S", 7)


def test_months_then_days(spark, tmp_path):
    path, asked = str(tmp_path / "out"), []

    def month(name, days):
        asked.append(name)
        return trades(spark, [d for d in days if d != 40]) if name == "1970-02" else None

    def day(d):
        asked.append(d)
        return trades(spark, [d]) if d in (29, 30, 60) else None

    got = archive.backfill_months(29, 61, month, day, path, "S")
    assert asked[0] == "1970-02" and "1970-01" not in asked and "1970-03" not in asked
    assert {d for d, s in got.items() if s == "no_rows"} == {40, 59, 61}
    assert archive.read_days(spark, path).count() == 5 * 30
    again = archive.backfill_months(29, 61, month, day, path, "S")
    assert {s for d, s in again.items() if d not in (40, 59, 61)} == {"already_present"}
    assert archive.read_days(spark, path).count() == 5 * 30


def test_a_month_must_account_for_all_its_rows(spark, tmp_path):
    with pytest.raises(ValueError, match="other days"):
        archive.ingest_span(trades(spark, [31, 32, 99]), str(tmp_path / "out"), "S", [31, 32], whole=True)
    assert archive.ingest_span(trades(spark, [31, 32, 99]), str(tmp_path / "out"), "S", [31, 32]) == {31: "written", 32: "written"}


def test_downloads_go_on_where_they_stopped(tmp_path):
    data, asked = bytes(range(256)) * 40, []

    def broken(url, at):
        asked.append(at)
        yield data[at : at + 3000]
        if at + 3000 < len(data):
            raise ConnectionError

    digest = hashlib.sha256(data).hexdigest()
    assert archive.resumed(broken, "u", digest, tmp_path / "f").read_bytes() == data
    assert asked == [0, 3000, 6000, 9000]
    assert archive.resumed(lambda u, n: 1 / 0, "u", digest, tmp_path / "f").exists()
    with pytest.raises(ConnectionError):
        archive.resumed(broken, "u", digest, tmp_path / "g", tries=2)
    assert archive.resumed(broken, "u", digest, tmp_path / "g", tries=2).read_bytes() == data
    with pytest.raises(ValueError):
        archive.resumed(lambda u, n: iter([b"x"]), "u", digest, tmp_path / "h")


def test_numbers_go_on(spark):
    old = curate.with_sequence(spark.createDataFrame([(0, 5, 1), (0, 6, 2), (1, 9, 3)], "day long, etime long, id long"), "id", ["day"])
    new = spark.createDataFrame([(0, 8, 5), (0, 7, 4), (2, 1, 6)], "day long, etime long, id long")
    got = {r["id"]: r["seq"] for r in curate.resumed_sequence(new, old, "id", ["day"]).collect()}
    assert got == {4: 2, 5: 3, 6: 0}


def test_an_episode_alarms_once():
    w = Watchdog((0, 1), started=0, stall=10 * SECOND, least_free=100)
    assert w.check(5 * SECOND, {}, 1000) == []
    assert w.check(11 * SECOND, {1: 9 * SECOND}, 1000) == [("silent", 0, 0)]
    assert w.check(12 * SECOND, {1: 9 * SECOND}, 50) == [("disk", None, 12 * SECOND)]
    assert w.check(30 * SECOND, {1: 9 * SECOND}, 50) == [("silent", 1, 9 * SECOND), ("all_silent", None, 9 * SECOND)]
    assert w.check(31 * SECOND, {0: 31 * SECOND, 1: 9 * SECOND}, 500) == [("silent_over", 0, 31 * SECOND), ("all_silent_over", None, 31 * SECOND), ("disk_over", None, 31 * SECOND)]
    assert w.check(32 * SECOND, {0: 31 * SECOND, 1: 9 * SECOND}, 500) == []
