"""Governed builds: curated days, segments, predictions and normalisations under manifests, and the day report.

Rows are written and checked by Spark for all days at once; the driver handles one small body a build and one row a file or day.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.clock import HOUR, SECOND, date_string
from tidemill.lake import Refused, Registry, body_id, entries, load, verify, write_new
from tidemill.operators import curate, folds, quality
from tidemill.operators.models import FEATURES, TARGET


def _date(day: int) -> str:
    from datetime import date, timedelta

    return (date(1970, 1, 1) + timedelta(days=day)).isoformat()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


# Curated days.
def curated_statuses(days: Iterable[int], today: int, sources: set[int], manifests: set[int], folders: set[int], supersede: bool = False) -> dict[int, str]:
    """Per day: not_final (today or later), already_present, orphan (a folder without a manifest), no_source, superseded or ready to be written."""
    out = {}
    for d in days:
        if d >= today:
            out[d] = "not_final"
        elif d in manifests:
            out[d] = "already_present" if not supersede else "superseded" if d in sources else "no_source"
        elif d in folders:
            out[d] = "orphan"
        else:
            out[d] = "ready" if d in sources else "no_source"
    return out


def curated_quotes(capture: DataFrame, key: str = "id", by: str = "day") -> DataFrame:
    """The curated quotes of all days: redeliveries dropped, numbered. Quotes come from the capture alone."""
    return curate.with_sequence(curate.without_redeliveries(capture.withColumn("source", F.lit("capture")), key), key, [by])


def build_curated(spark: SparkSession, registry: Registry, root: str, dataset: str, rows: DataFrame, days: list[int], today: int, code: str, supersede: bool = False) -> dict[int, str]:
    """Writes the curated rows (day, etime, ..) of the days that are ready in one job and issues their manifest; returns a status a day.

    A build writes to a folder named by its manifests' number, so a day that is superseded keeps its old bytes under
    its old manifest. Rows of a day are dealt over tasks by the hour.
    """
    bodies = registry.manifests(dataset)
    done = {p["date"] for b in bodies for p in b["partitions"]}
    folder = f"curated/{dataset}/build={len(bodies)}"
    wanted = rows.where(F.col("day").isin(list(days)))
    sources = {r["day"] for r in wanted.select("day").distinct().collect()}  # a row a day
    folders = {d for d in days if exists(spark, f"{root}/{folder}/date={_date(d)}")}
    statuses = curated_statuses(days, today, sources, {d for d in days if _date(d) in done}, folders, supersede)
    ready = [d for d, s in statuses.items() if s in ("ready", "superseded")]
    if not ready:
        return statuses
    out = wanted.where(F.col("day").isin(ready)).withColumn("date", date_string(F.col("etime")))
    out.repartition("date", F.floor(F.col("etime") / HOUR)).sortWithinPartitions("date", "etime").write.partitionBy("date").option("compression", "zstd").mode("append").parquet(f"{root}/{folder}")
    found = entries(spark, root, {f"{folder}/date={_date(d)}": _date(d) for d in ready})
    registry.issue(dataset, "curated", 1, [f"source={dataset}"], found, code)
    return {d: "written" if s == "ready" else s for d, s in statuses.items()}


# Segments.
def covered_range(registry: Registry, dataset: str, manifest_ids: list[str]) -> tuple[int, int]:
    """[first, last + 1) etime of the manifests, from their bodies alone."""
    bodies = [registry.resolve(dataset, m) for m in manifest_ids]
    if not bodies:
        raise Refused("no manifests are given")
    return min(b["etime_min"] for b in bodies), max(b["etime_max"] for b in bodies) + 1


def issue_segments(registry: Registry, decisions: DataFrame, dataset: str, manifest_ids: list[str], segments: list[folds.Segment], allowance: dict[str, int], k: int = 5, max_age: int = 5 * SECOND, purge: int = folds.PURGE, embargo: int = folds.EMBARGO, errata_id: str | None = None) -> dict:
    """A manifest of segments in the manifests' covered range, with the rows that each admits and the blocks of the train segment.

    Refused: segments that overlap, leave the covered range or have not one held out; a block outside of the train
    segment; a segment that meets one whose looks are spent.
    """
    covered = covered_range(registry, dataset, manifest_ids)
    try:
        ordered = folds.checked(segments, covered)
    except ValueError as e:
        raise Refused(str(e)) from None
    train = [s for s in ordered if s.role == "train"]
    if len(train) != 1:
        raise Refused("one segment must be for training")
    blocks = folds.blocks(train[0].start, train[0].end, k)
    if blocks[0][0] < train[0].start or blocks[-1][1] > train[0].end:
        raise Refused("a block leaves the train segment")
    for old in segment_manifests(registry):
        for s in old["segments"]:
            spent = registry.looks(old["manifest_id"], s["name"]) >= old["allowance"].get(s["name"], 1)
            if spent and any(s["start"] < t.end and t.start < s["end"] for t in ordered if t.role != "train"):
                raise Refused(f"{s['name']} of {old['manifest_id']} is exhausted")
    counts = {r["segment"]: r.asDict() for r in folds.admission_counts(folds.with_age(decisions), ordered, max_age).collect()}  # a row a segment
    kept = folds.purge_counts(decisions, train[0], [s for s in ordered if s != train[0]], purge, embargo).first().asDict()
    body = {
        "dataset": dataset, "inputs": sorted(manifest_ids), "covered": list(covered), "allowance": allowance, "errata_id": errata_id, "purge": purge, "embargo": embargo, "max_age": max_age,
        "segments": [{"name": s.name, "role": s.role, "start": s.start, "end": s.end, "counts": counts.get(s.name, {})} for s in ordered], "train_counts": kept, "blocks": [list(b) for b in blocks], "issued_at": registry.clock(),
    }
    body["manifest_id"] = body_id(body)
    write_new(registry.root / "segments" / f"{body['manifest_id']}.json", json.dumps(body))
    return body


def segment_manifests(registry: Registry) -> list[dict]:
    return [json.loads(p.read_text()) for p in sorted((registry.root / "segments").glob("*.json"))]


def materialise_once(spark: SparkSession, registry: Registry, root: str, body: dict, name: str, make: Callable[[], DataFrame], tags: dict) -> DataFrame:
    """The rows of a segment from its cache, or made once: the look is spent when the cache is filled, not when it is read."""
    path = f"{root}/cache/{body['manifest_id']}/{name}"
    if not exists(spark, f"{path}/_SUCCESS"):
        if next(s for s in body["segments"] if s["name"] == name)["role"] == "held_out":
            raise Refused(f"{name} is held out")
        registry.look(body["manifest_id"], name, body["allowance"].get(name, 1), tags)
        make().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


# Masks and names.
def block_mask(rows: DataFrame, intervals: list[tuple[int, int]], expected: int) -> DataFrame:
    """rows with `kept`, a Boolean that is never null; refused if it keeps another number of rows than expected."""
    out = rows.withColumn("kept", F.coalesce(folds.inside(F.col("etime"), intervals), F.lit(False)))
    if (n := out.agg(F.count_if("kept")).first()[0]) != expected:
        raise Refused(f"the mask keeps {n} rows, not {expected}")
    return out


def masked_rows(rows: DataFrame, mask: DataFrame) -> DataFrame:
    """The rows that a mask (etime, kept) keeps; refused unless the mask has each etime of rows just once, and no null."""
    a, b = rows.select("etime"), mask.select(F.col("etime").alias("_t"), F.col("kept").alias("_k"))
    both = a.join(b, F.col("etime") == F.col("_t"), "full")
    bad = both.agg(F.count_if(F.col("etime").isNull() | F.col("_t").isNull() | F.col("_k").isNull()).alias("bad"), F.count("*").alias("n")).first()
    if bad["bad"] or bad["n"] != rows.count():
        raise Refused("the mask does not fit the rows")
    return rows.join(mask.where("kept").select("etime"), "etime", "left_semi")


def validate_features(names: Iterable[str]) -> tuple[str, ...]:
    """The features that a model may read, and no others, in their order."""
    if tuple(names) != FEATURES:
        raise Refused(f"features must be {FEATURES}, not {tuple(names)}")
    return FEATURES


def validate_target(name: str) -> str:
    if name != TARGET:
        raise Refused(f"the target must be {TARGET}, not {name}")
    return name


def assert_ascending(rows: DataFrame, key: str = "etime") -> DataFrame:
    """rows, if no key is null or comes twice (rows of a frame have no order but their key)."""
    n, known, different = rows.agg(F.count("*"), F.count(key), F.count_distinct(key)).first()
    if not n == known == different:
        raise Refused(f"{n} rows have {known} keys, {different} of them different")
    return rows


def bounds(rows: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """(.., low, high, n) of a column; nulls if there is no such column."""
    c = F.col(column) if column in rows.columns else F.lit(None).cast("long")
    return rows.groupBy(*(by or [])).agg(F.min(c).alias("low"), F.max(c).alias("high"), F.count("*").alias("n"))


# Predictions.
def issue_predictions(spark: SparkSession, registry: Registry, root: str, rows: DataFrame, segment: str, predictor: str, frame_id: str, code: str) -> dict:
    """Writes (etime, decision_seq, pred) once for a segment and predictor and issues their manifest."""
    out = assert_ascending(rows.select("etime", "decision_seq", F.col("pred").cast("double").alias("pred")))
    path = f"predictions/segment={segment}/predictor={predictor}"
    if exists(spark, f"{root}/{path}"):
        raise Refused(f"{path} is written")
    out.write.mode("errorifexists").option("compression", "zstd").parquet(f"{root}/{path}")
    return registry.issue("predictions", "predictions", 1, [frame_id, f"segment={segment}"], entries(spark, root, {path: segment}), code)


def load_predictions(spark: SparkSession, registry: Registry, root: str, manifest_id: str, frame: DataFrame) -> DataFrame:
    """The predictions of a manifest that fit the frame (etime, decision_seq): hash, tier, bytes, schema, quarantined dates, unique keys and alignment are checked."""
    out = load(spark, registry, root, "predictions", manifest_id, "predictions")
    if dict(out.dtypes) != {"etime": "bigint", "decision_seq": "bigint", "pred": "double"}:
        raise Refused(f"predictions of another schema: {out.dtypes}")
    registry.assert_open([r["d"] for r in out.select(date_string(F.col("etime")).alias("d")).distinct().collect()])  # a row a day
    assert_ascending(out)
    pair = frame.select("etime", F.col("decision_seq").alias("_seq")).join(out, "etime", "full")
    apart = pair.agg(F.count_if(~F.col("_seq").eqNullSafe(F.col("decision_seq")))).first()[0]
    if apart:
        raise Refused(f"{apart} rows of the frame and the predictions do not meet")
    return out


# Normalisations.
def write_normalisation(registry: Registry, params: DataFrame, dates: list[str], inputs: list[str]) -> str:
    """Means and deviations (feature, count, mean, std, ..) as a body named by its hash, written once; returns the name."""
    rows = {r["feature"]: {"mean": r["mean"], "std": r["std"], "count": r["count"]} for r in params.collect()}  # a row a feature
    if bad := [f for f, r in rows.items() if not r["std"] or not math.isfinite(r["std"]) or not math.isfinite(r["mean"])]:
        raise Refused(f"no spread or not finite: {bad}")
    body = {"params": rows, "dates": sorted(dates), "inputs": sorted(inputs)}
    path = registry.root / "normalisations" / f"{body_id(body)}.json"
    if not path.exists():
        write_new(path, json.dumps(body))
    return body_id(body)


def load_normalisation(registry: Registry, name: str) -> dict[str, tuple[float, float]]:
    """Feature to (mean, deviation); refused if the body does not hash to its name, or was fitted on dates that are held out now."""
    body = json.loads((registry.root / "normalisations" / f"{name}.json").read_text())
    if body_id(body) != name:
        raise Refused(f"normalisation {name} does not hash to its name")
    registry.assert_open(body["dates"])
    return {f: (r["mean"], r["std"]) for f, r in body["params"].items()}


# The report of days.
def day_report(quotes: DataFrame, trades: DataFrame, sources: DataFrame, ledger: DataFrame, recon: DataFrame, placeholders: DataFrame, built_at: int, features: DataFrame | None = None) -> DataFrame:
    """All checks that apply to each day and stream, in one frame; days are dealt over the cluster, none is looped over.

    sources (day, source, capture, stats): where a trade day comes from, whether the capture has it too, whether the build's
    counts are there. An outage of the capture says nothing of trades from the archive; loss by id skips is judged for these alone,
    and where the capture overlaps, reconciliation judges it. Without the build's counts a trade day fails.
    """
    src = sources.select("day", "source", "capture", "stats")
    days = lambda rows, stream: rows.select("day").distinct().withColumn("_stream", F.lit(stream))
    archive = F.col("source") == "archive"

    def told(checks: DataFrame, when: Column, why: str) -> DataFrame:
        d = checks.join(src, "day", "left").withColumn("_na", F.coalesce(when, F.lit(False)))
        n_a = lambda c, kind: F.when(~F.col("_na"), F.col(c)).cast(kind).alias(c)
        return d.select("day", "stream", "check", F.when(F.col("_na"), "n/a").otherwise(F.col("status")).alias("status"), n_a("value", "double"), n_a("count", "long"), F.when(F.col("_na"), why).otherwise(F.col("detail")).alias("detail"))

    def gaps(rows: DataFrame, stream: str) -> DataFrame:
        found = days(rows, stream).join(quality.gap_coverage(ledger, stream).drop("stream"), "day", "left")
        zero = F.lit(0)
        return found.select("day", F.col("_stream").alias("stream"), F.lit("gap_coverage").alias("check"), F.coalesce("status", F.lit("ok")).alias("status"), F.coalesce("value", zero.cast("double")).alias("value"), F.coalesce("count", zero.cast("long")).alias("count"), "detail")

    parts = [gaps(quotes, "quote"), told(gaps(trades, "trade"), archive, "trades come from the archive")]
    for rows, stream in ((quotes, "quote"), (trades, "trade")):
        parts.append(quality.plausible_times(rows, "etime", stream))
        if "event_time" in rows.columns:
            parts.append(quality.plausible_times(rows, "event_time", stream))
        of = rows.join(src.select("day", F.col("source").alias("_s")), "day", "left") if stream == "trade" else rows.withColumn("_s", F.lit("capture"))
        parts.append(quality.plausible_receive_times(of.withColumn("_s", F.coalesce("_s", F.lit("unknown"))), stream, F.col("_s"), built_at))
    loss = quality.probable_loss(trades).join(src.where(archive).select("day"), "day", "left_semi")
    parts.append(told(loss, F.col("capture"), "reconciliation judges a day that the capture has too"))
    with_stats = src.where("stats").select("day")
    parts += [c.join(with_stats, "day", "left_semi").select(c.columns) for c in (quality.reconciliation(recon), quality.placeholder_rate(placeholders))]
    without = days(trades, "trade").join(with_stats, "day", "left_anti")
    parts.append(without.select(*quality.row(F.col("day"), "trade", "build_stats", F.lit("failed"), None, None, F.lit("the build's counts are missing"))))
    parts += [quality.crossed_or_locked(quotes), quality.sparsity(quotes)]
    if features is not None:
        parts.append(quality.feature_checks(features))
    return quality.report(*parts)


# Steps of a simulation, one row at a time.
def steps(rows: Iterable[tuple[int, int, int, float]], x_bps: int = 0) -> Iterator[tuple[int, int, bool]]:
    """(etime, position, changed) after each row (etime, bid_ticks, ask_ticks, pred) in order, by the rules of operators.simulate: for a caller that has rows as they come."""
    position = 0
    for etime, bid, ask, pred in rows:
        if pred is None or not math.isfinite(pred) or pred < 0 or bid <= 0 or ask <= 0:
            raise Refused(f"the row of etime {etime} cannot be run")
        scaled, x = round(pred * 10**8), (bid + ask) * x_bps // 20000
        up, down = scaled // 10**7 > ask + x, -(-scaled // 10**7) < bid - x
        if position == 0:
            new = 1 if up else -1 if down else 0
        else:
            new = -position if (down if position > 0 else up) else position
        yield etime, new, new != position
        position = new


def day_of(date: str) -> int:
    from datetime import date as d

    return (d.fromisoformat(date) - d(1970, 1, 1)).days


def verify_all(spark: SparkSession, registry: Registry, root: str, dataset: str) -> list[str]:
    """The partitions of every manifest of a dataset whose bytes have changed, found in one job."""
    return verify(spark, root, [p for b in registry.manifests(dataset) for p in b["partitions"]])


