from __future__ import annotations

import json
import random
import zipfile

import pytest

from tidemill.functions.clock import DAY, SECOND
from tidemill.lake import Refused, Registry, load, partition_entry
from tidemill.operators import capture, curate
from tidemill.sources import archive
from tidemill.streaming import capture as stream


@pytest.fixture
def lake(spark, tmp_path):
    root = tmp_path / "lake"
    spark.range(10).selectExpr("id as etime", "id * 2 as v").write.parquet(f"{root}/curated/a")
    registry = Registry(tmp_path / "registry")
    entry = partition_entry(spark, str(root), "curated/a", "1970-01-01")
    body = registry.issue("quotes", "curated", 1, ["raw/source=capture/x"], [entry], "c0de")
    return str(root), registry, body


def test_load_passes_all_gates(spark, lake):
    root, registry, body = lake
    assert load(spark, registry, root, "quotes", body["manifest_id"], "curated", ["v"]).count() == 10
    assert registry.of_date("quotes", "1970-01-01") == body and registry.source(body) == "capture"


def test_changed_bytes_and_bodies_are_refused(spark, lake):
    root, registry, body = lake
    path = registry.root / "manifests" / "quotes" / f"{body['manifest_id']}.json"
    path.write_text(json.dumps(body | {"rows": 9}))
    with pytest.raises(Refused, match="hash"):
        registry.resolve("quotes", body["manifest_id"])
    path.write_text(json.dumps(body))
    spark.range(3).selectExpr("id as etime", "id as v").write.mode("append").parquet(f"{root}/curated/a")
    with pytest.raises(Refused, match="changed"):
        load(spark, registry, root, "quotes", body["manifest_id"], "curated")


def test_write_once_tiers_quarantine_and_quality(lake):
    _, registry, body = lake
    with pytest.raises(Refused):
        registry.issue("quotes", "curated", 1, [], body["partitions"], "c0de")
    with pytest.raises(Refused):
        registry.resolve("quotes", body["manifest_id"], "lockbox")
    with pytest.raises(Refused):
        registry.assert_quality("quotes", {"d": ("degraded", ["x"])})
    registry.acknowledge("quotes", "d", ["x"], "me")
    registry.assert_quality("quotes", {"d": ("degraded", ["x"])})
    with pytest.raises(Refused):
        registry.assert_quality("quotes", {"d": ("degraded", ["x", "y"])})
    registry.hold_out(["1970-01-01"], "test")
    with pytest.raises(Refused):
        registry.assert_open(["1970-01-01"])
    with pytest.raises(FileExistsError):
        registry.hold_out([], "again")


def test_looks_tokens_and_negative_results(lake):
    _, registry, body = lake
    assert registry.look("m", "val", 1, {}) == 1
    with pytest.raises(Refused):
        registry.look("m", "val", 1, {})
    assert registry.exhausted({("m", "val"): 1, ("m", "x"): 1}) == [("m", "val")]
    assert registry.negative({"a": 1}, "no") == 1 and registry.negative({"a": 1}, "no") == 2
    box = registry.issue("box", "lockbox", 1, [], [{**body["partitions"][0], "path": "lockbox/a"}], "c")
    registry.issue_token("t", "box", box["manifest_id"], "final")
    with pytest.raises(Refused):
        registry.open_once("t", "other")
    assert registry.open_once("t", "final") == box
    with pytest.raises(Refused, match="used"):
        registry.open_once("t", "final")
    with pytest.raises(Refused):
        registry.run({"code": 1})


def test_archive_csv_to_days(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,price,qty,quote_qty,time,is_buyer_maker\n1,10.5,2,21,86399999,true\n2,10.6,1,10.6,86400000,false\n")
    unit = archive.units("um", "trades")
    rows = archive.normalised(archive.read_csv(spark, str(tmp_path / "x.csv"), unit), unit, "S", 7)
    archive.ingested(archive.assert_clock(rows), lambda d: archive.write_days(d, str(tmp_path / "out")))
    back = archive.read_days(spark, str(tmp_path / "out"), "1970-01-02")
    assert [(r["id"], r["etime"], str(r["date"])) for r in back.collect()] == [(2, DAY, "1970-01-02")]
    assert archive.row_count(spark, str(tmp_path / "none")) == 0
    with pytest.raises(Exception):
        archive.write_days(rows, str(tmp_path / "out"))
    with pytest.raises(KeyError):
        archive.units("um", "nothing")
    with pytest.raises(ValueError):
        archive.assert_clock(rows.limit(0))


def test_download_and_zip(tmp_path):
    import hashlib

    data = b"abc"
    digest = hashlib.sha256(data).hexdigest()
    assert archive.download(lambda u: data, "u", digest, tmp_path / "f").read_bytes() == data
    assert archive.download(lambda u: 1 / 0, "u", digest, tmp_path / "f").exists()
    with pytest.raises(ValueError):
        archive.download(lambda u: b"x", "u", digest, tmp_path / "g")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.csv", "1")
    assert archive.member(tmp_path / "z.zip", "a.csv", tmp_path).read_text() == "1"
    with pytest.raises(ValueError):
        archive.member(tmp_path / "z.zip", "b.csv", tmp_path)
    assert archive.published_days(["d/S-trades-2024-01-02.zip", "d/S-trades-2024-01.zip"], "S") == ["2024-01-02"]
    assert archive.pages(lambda m: (["a"], "x") if m == "" else (["b"], None)) == ["a", "b"]


def test_placeholders_of_both_versions_and_unknown_types(spark):
    rows = [(1, 1, 0.0, 0.0, None), (2, 1, 0.0, 1.0, None), (3, 2, 5.0, 1.0, "NA"), (4, 2, 5.0, 1.0, None), (5, 2, 0.0, 0.0, "MARKET")]
    d = spark.createDataFrame(rows, "id long, schema_version int, price double, qty double, exec_type string")
    assert sorted(r["id"] for r in curate.without_placeholders(d).collect()) == [2, 4, 5]
    assert sorted(r["id"] for r in curate.without_placeholders(d.drop("exec_type")).collect()) == [2, 3, 4, 5]


def test_redeliveries_with_nulls(spark):
    rows = [(1, 1, 10, None), (1, 2, 11, None), (2, 3, 10, "a"), (2, 4, 10, None)]
    d = spark.createDataFrame(rows, "id long, seq long, rtime long, x string")
    assert sorted(r["seq"] for r in curate.without_redeliveries(d, "id").collect()) == [1, 3, 4]


def frame(kind, **data):
    return json.dumps({"stream": f"s@{kind}", "data": data})


def frames(spark):
    rows = [
        (0, 1 * SECOND, frame("trade", e="trade", E=5, T=4, s="S", t=1, p="10.5", q="1", X="MARKET", m=True)),
        (1, 2 * SECOND, frame("trade", e="trade", E=5, T=4, s="S", t=1, p="10.5", q="1", X="MARKET", m=True)),
        (0, 9 * SECOND, frame("bookTicker", e="q", u=7, s="S", b="1", B="2", a="3", A="4", T=6, E=6)),
        (0, 10 * SECOND, "not json"),
        (1, 300 * SECOND, frame("trade", e="trade", E=5, T=4, s="S", t=1, p="10.5", q="1", X="MARKET", m=True)),
    ]
    return spark.createDataFrame(rows, stream.FRAMES)


def test_frames_are_routed_and_parsed_with_case(spark):
    f = frames(spark)
    assert sorted(r["kind"] for r in capture.with_kind(f).collect()) == ["malformed", "quote", "trade", "trade", "trade"]
    q = capture.parsed_quotes(f).first()
    assert (q["id"], q["etime"], q["bid_price"], q["bid_qty"], q["ask_price"], q["ask_qty"]) == (7, 6_000_000, 1.0, 2.0, 3.0, 4.0)
    kept = capture.first_deliveries(capture.parsed_trades(f), ["symbol", "id"]).select("rtime").collect()
    assert sorted(r[0] for r in kept) == [SECOND, 300 * SECOND]


def test_stream_gives_the_rows_of_the_batch(spark, tmp_path):
    frames(spark).where(f"rtime < {100 * SECOND}").coalesce(1).write.json(str(tmp_path / "in"))
    s = stream.frames(spark, str(tmp_path / "in"))
    out = stream.deduplicated(capture.parsed_trades(s), ["symbol", "id"])
    stream.to_days(out, str(tmp_path / "out"), str(tmp_path / "ck"), {"availableNow": True}).awaitTermination(60)
    assert [(r["id"], r["price"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 10.5)]
    q = stream.gaps(s).writeStream.format("memory").queryName("gaps").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("gaps").collect()] == [(0, SECOND, 9 * SECOND)]


def test_streamed_features_are_those_of_the_batch(spark, tmp_path):
    from test_features import Q, W, decided, stream as events

    rows = sorted(events(3), key=lambda e: (e[0], e[1], e[2], e[3]))
    for k in range(0, len(rows), 7):  # seven events a batch, cut anywhere
        spark.createDataFrame(rows[k : k + 7], Q).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    d = stream.decisions(spark.readStream.schema(Q).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")), W)
    q = d.writeStream.format("memory").queryName("decided").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("decided").collect())
    want = decided(spark, rows)
    last = {max(r[1] for r in want if r[0] == day) for day in {r[0] for r in want}}
    assert got == [r for r in want if r[1] not in last]  # the last row of a day waits for the next


def deliveries(spark, seed=0):
    r = random.Random(seed)
    rows, at = [], 0
    for _ in range(300):
        at += r.choice([1, 30, 60, 119, 120, 121, 200]) * SECOND
        rows.append((f"s{r.randrange(2)}", r.randrange(3), at, r.randrange(4), r.choice([None, 2**60 + r.randrange(9)]), r.choice([None, 0.1, 1e-7])))
    return sorted(set(rows), key=lambda x: (x[2], x[1])), "symbol string, conn_id int, rtime long, id long, big long, price double"


def folded(rows, ttl=120 * SECOND):
    last, out = {}, []
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        k = (r[0], r[3])
        if k not in last or r[2] - last[k] > ttl:
            last[k] = r[2]
            out.append(r)
    return out


def test_a_key_lives_from_its_first_kept_delivery(spark):
    d = spark.createDataFrame([("s", 0, t * SECOND, 1) for t in (0, 100, 200, 300, 420, 421, 600)], "symbol string, conn_id int, rtime long, id long")
    assert sorted(r["rtime"] // SECOND for r in capture.first_deliveries(d, ["id"]).collect()) == [0, 200, 420, 600]
    for seed in range(3):
        rows, kind = deliveries(spark, seed)
        got = capture.first_deliveries(spark.createDataFrame(rows, kind).repartition(3), ["symbol", "id"]).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, folded(rows)))


def test_the_stream_keeps_what_the_batch_keeps(spark, tmp_path):
    rows, kind = deliveries(spark, 7)
    for k in range(0, len(rows), 40):
        spark.createDataFrame(rows[k : k + 40], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/p{k:05}"))
    s = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = stream.deduplicated(s, ["symbol", "id"]).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(str, map(tuple, spark.table("kept").collect()))) == sorted(map(str, folded(rows)))


def test_the_streamed_ledger_is_that_of_the_batch(spark, tmp_path):
    r, rows, at, last = random.Random(2), [], 0, 0
    for _ in range(400):
        at += r.choice([1, 1, 1, 2, 7]) * SECOND
        last += r.choice([1, 1, 1, 3])
        rows.append(("s", 0 if r.random() < 0.9 else 1, at, last if r.random() < 0.8 else None))
    kind = "symbol string, conn_id int, rtime long, id long"
    for k in range(0, len(rows), 50):
        spark.createDataFrame(rows[k : k + 50], kind).coalesce(1).write.parquet(str(tmp_path / f"in/p{k:05}"))
    s = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    stream.to_ledger(stream.ledger(s), str(tmp_path / "out"), str(tmp_path / "ck"), {"availableNow": True}).awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out"))
    batch = spark.createDataFrame(rows, kind).selectExpr("*", "rtime div 60000000000 as day")
    pick = lambda d: sorted((r["gap_start_rtime"], r["gap_end_rtime"], r["conn_id"]) for r in d.collect())
    assert pick(found.where("cause = 'merged-silent'")) == pick(capture.merged_gaps(batch)) != []
    assert pick(found.where("cause = 'connection-silent'")) == pick(capture.connection_gaps(batch)) != []
    skips = [r["missing"] for r in capture.id_skips(batch.where("id is not null")).collect()]
    assert sorted(r["missing"] for r in found.where("cause = 'id-skip'").collect()) == sorted(skips) != []


def test_parts_of_one_name_are_told_apart(spark, tmp_path):
    import hashlib

    paths = []
    for day in ("a", "b"):
        spark.range(5 if day == "a" else 7).coalesce(1).write.parquet(str(tmp_path / day))
        part = next((tmp_path / day).glob("part-*.parquet")).rename(tmp_path / day / "part-0.parquet")
        paths.append(str(part))
    digests = {p: hashlib.sha256(open(p, "rb").read()).hexdigest() for p in paths}
    assert archive.verified(spark, digests).count() == 12
    with pytest.raises(ValueError):
        archive.verified(spark, {paths[0]: digests[paths[0]], paths[1]: digests[paths[0]]})
