"""Archive files: CSV by declared types, normalised to trade rows; verified reads; write-once partitions."""

from __future__ import annotations

import hashlib
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.clock import DAY, HOUR, date_string, ms_to_ns


@dataclass(frozen=True)
class Units:
    """How a dataset's files are to be read."""

    time_unit: str
    header: bool
    columns: str


#: (market, dataset) to its units: fixed formats.
UNITS = {
    ("um", "trades"): Units("ms", True, "id long, price string, qty string, quote_qty string, time long, is_buyer_maker boolean"),
    ("spot", "trades"): Units("us", False, "id long, price string, qty string, quote_qty string, time long, is_buyer_maker boolean, is_best_match boolean"),
}


def units(market: str, dataset: str) -> Units:
    try:
        return UNITS[market, dataset]
    except KeyError:
        raise KeyError(f"no units are registered for {market}/{dataset}") from None


def read_csv(spark: SparkSession, path: str | list[str], unit: Units) -> DataFrame:
    """Raw rows; a value that does not fit its declared type fails the read."""
    return spark.read.schema(unit.columns).option("header", str(unit.header).lower()).option("mode", "FAILFAST").csv(path)


def normalised(raw: DataFrame, unit: Units, symbol: str, rtime_ns: int) -> DataFrame:
    if unit.time_unit != "ms":
        raise ValueError(f"times in {unit.time_unit} are not accepted")
    etime = ms_to_ns(F.col("time"))
    return raw.select(
        F.lit(symbol).alias("symbol"), F.lit("trade").alias("stream"), F.lit("archive").alias("source"), "id", etime.alias("etime"), etime.alias("event_time"), F.lit(rtime_ns).cast("long").alias("rtime"), F.lit(-1).cast("long").alias("seq"),
        F.col("price").cast("double").alias("price"), F.col("qty").cast("double").alias("qty"), "is_buyer_maker", F.lit(1).alias("schema_version"), F.lit(None).cast("string").alias("exec_type"),
    )


def clock_problems(rows: DataFrame) -> DataFrame:
    """(n_rows, null_etime): a partition is good if the first is positive and the second 0."""
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(F.col("etime").isNull()).alias("null_etime"))


def assert_clock(rows: DataFrame) -> DataFrame:
    n, bad = clock_problems(rows).first()
    if n == 0 or bad:
        raise ValueError(f"{n} rows, {bad} without etime")
    return rows


def of_day(etime: Column, day: int) -> Column:
    return (etime >= day * DAY) & (etime < (day + 1) * DAY)


def ingested(raw: DataFrame, write: Callable[[DataFrame], None]) -> tuple[int, int]:
    """Writes all rows and returns (rows read, rows with a day): they are equal, or rows were lost."""
    total, dated = raw.agg(F.count("*"), F.count("etime")).first()
    if total != dated:
        raise ValueError(f"{total - dated} rows have no day")
    write(raw)
    return total, dated


def write_days(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder a (symbol, stream, date); rows of a day are dealt over several tasks before they are written."""
    out = rows.withColumn("date", date_string(F.col("etime")))
    out.repartition("symbol", "stream", "date", F.floor(F.col("etime") / HOUR)).write.partitionBy("symbol", "stream", "date").option("compression", "zstd").mode(mode).parquet(path)


def read_days(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The days' rows, files of either schema version: a column that a file lacks is null. Only the days asked for are read."""
    out = spark.read.option("mergeSchema", "true").parquet(path)
    if first:
        out = out.where(F.col("date") >= first)
    return out.where(F.col("date") <= last) if last else out


def file_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, sha256, size) of files, computed where they are read."""
    return spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark names it: parts of different days may have one base name."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def verified(spark: SparkSession, expected: dict[str, str], columns: list[str] | None = None) -> DataFrame:
    """Rows of Parquet files whose bytes have the expected digests; raises if one differs."""
    found = {r["path"]: r["sha256"] for r in file_digests(spark, list(expected)).collect()}  # a row a file
    wrong = [p for p, d in expected.items() if found.get(qualified(spark, p)) != d]
    if wrong:
        raise ValueError(f"digests differ: {wrong}")
    out = spark.read.parquet(*expected)
    return out.select(columns) if columns else out


def row_count(spark: SparkSession, path: str) -> int:
    try:
        return spark.read.parquet(path).count()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0


def published_days(keys: list[str], symbol: str) -> list[str]:
    """Dates in a listing of archive keys."""
    import re

    return sorted({m[1] for k in keys if (m := re.search(rf"{re.escape(symbol)}-trades-(\d{{4}}-\d\d-\d\d)\.zip$", k))})


def pages(fetch: Callable[[str], tuple[list[str], str | None]]) -> list[str]:
    """All keys of a paged listing; fetch(marker) gives (keys, next marker)."""
    out, marker = [], ""
    while marker is not None:
        keys, marker = fetch(marker)
        out += keys
    return out


def download(fetch: Callable[[str], bytes], url: str, checksum: str, to: Path) -> Path:
    """Writes what is fetched if its SHA-256 is the expected one; a file that is there and right is not fetched again."""
    if to.exists() and hashlib.sha256(to.read_bytes()).hexdigest() == checksum:
        return to
    data = fetch(url)
    if hashlib.sha256(data).hexdigest() != checksum:
        raise ValueError(f"{url} has another digest")
    part = to.with_name(to.name + ".part")
    part.write_bytes(data)
    return part.replace(to)


def member(archive: Path, name: str, to: Path) -> Path:
    """Extracts the one member of that name; others are refused."""
    with zipfile.ZipFile(archive) as z:
        if z.namelist() != [name]:
            raise ValueError(f"{archive} holds {z.namelist()}, not {name}")
        (to / name).write_bytes(z.read(name))
    return to / name


def backfill(days: list[str], existing: Callable[[str], int], load: Callable[[str], DataFrame | None], write: Callable[[DataFrame, str], None]) -> dict[str, str]:
    """Per day: already_present, no_rows or written. Running it again does nothing twice."""
    out = {}
    for day in days:
        if existing(day):
            out[day] = "already_present"
            continue
        rows = load(day)
        if rows is None or rows.isEmpty():
            out[day] = "no_rows"
        else:
            write(rows, day)
            out[day] = "written"
    return out


def resumed(open_at: Callable[[str, int], Iterator[bytes]], url: str, digest: str, path: Path, tries: int = 5) -> Path:
    """Downloads a file of any size in pieces: open_at(url, n) gives what follows byte n.

    Pieces are appended to a part file, so a broken transfer goes on where it stopped, in this call or a later one; the
    file gets its name only after its digest is right, and a file that is there is not fetched again.
    """
    if path.exists():
        return path
    part = path.with_name(f"{path.name}.part")
    part.parent.mkdir(parents=True, exist_ok=True)
    for left in reversed(range(tries)):
        try:
            with part.open("ab") as f:
                for piece in open_at(url, f.tell()):
                    f.write(piece)
            break
        except OSError:
            if not left:
                raise
    found = hashlib.sha256()
    with part.open("rb") as f:
        while piece := f.read(1 << 20):
            found.update(piece)
    if found.hexdigest() != digest:
        part.unlink()
        raise ValueError(f"the digest of {url} differs")
    return part.rename(path)


def days_written(spark: SparkSession, path: str, symbol: str, stream: str, days: list[int]) -> set[int]:
    """The days whose folder is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path
    at = {d: p(f"{path}/symbol={symbol}/stream={stream}/date={(date(1970, 1, 1) + timedelta(days=d)).isoformat()}") for d in days}
    fs = p(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return {d for d, x in at.items() if fs.exists(x)}


def ingest_span(rows: DataFrame, path: str, symbol: str, days: list[int], whole: bool = False) -> dict[int, str]:
    """Writes the rows of the days that are not there yet in one job; a status a day: written, already_present or no_rows.

    One scan counts rows by day. If the file is asked for as a whole, every row it has must belong to one of the days, or
    rows would be lost: then nothing is written.
    """
    spark, day = rows.sparkSession, F.expr(f"etime div {DAY}L")
    counts = {r["day"]: r["count"] for r in rows.groupBy(day.alias("day")).count().collect()}  # a row a day
    if None in counts or whole and (astray := sorted(set(counts) - set(days))):
        raise ValueError("rows without a day" if None in counts else f"rows of other days: {astray}")
    there = days_written(spark, path, symbol, "trade", days)
    todo = [d for d in days if d not in there and counts.get(d)]
    if todo:
        write_days(rows.where(day.isin(todo)), path, "append")
        back = read_days(spark, path).where((F.col("symbol") == symbol) & day.isin(todo)).count()
        if back != sum(counts[d] for d in todo):
            raise ValueError(f"{back} rows were written of {sum(counts[d] for d in todo)}")
    return {d: "already_present" if d in there else "written" if d in todo else "no_rows" for d in days}


def backfill_months(first: int, last: int, month: Callable[[str, list[int]], DataFrame | None], day: Callable[[int], DataFrame | None], path: str, symbol: str) -> dict[int, str]:
    """Ingests the days from first to last: months that lie inside by their monthly file, then what is left day by day.

    month(year-month, days) and day(day) give normalised rows, or None where nothing is published.
    """
    of = lambda d: (date(1970, 1, 1) + timedelta(days=d)).isoformat()[:7]
    days, out = list(range(first, last + 1)), {}
    for name in sorted({of(d) for d in days}):
        own = [d for d in days if of(d) == name]
        complete = of(own[0] - 1) != name and of(own[-1] + 1) != name
        rows = month(name, own) if complete else None
        if rows is not None:
            out |= ingest_span(rows, path, symbol, own, whole=True)
    for d in days:
        if out.get(d, "no_rows") == "no_rows":
            rows = day(d)
            out[d] = ingest_span(rows, path, symbol, [d])[d] if rows is not None else out.get(d, "no_rows")
    return out
