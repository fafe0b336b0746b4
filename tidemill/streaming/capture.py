"""The capture as Structured Streaming: frames in, de-duplicated rows by date and a ledger of gaps out."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemill.functions.clock import SECOND, date_string

FRAMES = "conn_id int, rtime long, frame string"


def frames(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """A stream of frames from a folder of JSON lines (any source with these columns will do)."""
    return spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", files_at_once).json(path)


def archive(frames_: DataFrame, path: str, checkpoint: str, trigger: dict[str, Any] | None = None) -> StreamingQuery:
    """Writes frames as they came, as compressed JSON lines by UTC day and connection, before anything else is done with them."""
    out = frames_.withColumn("date", date_string(F.col("rtime")))
    return out.writeStream.format("json").partitionBy("date", "conn_id").option("path", path).option("compression", "gzip").option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "60 seconds"})).start()


def deduplicated(rows: DataFrame, key: list[str], ttl: int = 120 * SECOND) -> DataFrame:
    """The rows that operators.capture.first_deliveries keeps: state is the time of a key's last kept row, forgotten when the watermark has passed it by ttl."""

    def step(_key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frame = pd.concat(list(parts)).sort_values(["rtime", "conn_id"], kind="stable")
        last, kept = state.get[0] if state.exists else None, []
        for k, t in enumerate(frame["rtime"].tolist()):
            if last is None or t - last > ttl:
                kept.append(k)
                last = t
        state.update((last,))
        state.setTimeoutTimestamp(max((last + ttl) // 10**6 + 1, state.getCurrentWatermarkMs() + 1))
        yield frame.iloc[kept][["row"]]

    kind = rows.schema
    keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]
    packed = rows.select(*keys, "rtime", "conn_id", F.timestamp_micros((F.col("rtime") / 1000).cast("long")).alias("_at"), F.to_json(F.struct(*rows.columns)).alias("row"))
    packed = packed.withWatermark("_at", f"{ttl // SECOND} seconds").groupBy(*(f"_k{i}" for i in range(len(key))))
    out = packed.applyInPandasWithState(step, "row string", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.from_json("row", kind).alias("r")).select("r.*")


def ledger(rows: DataFrame, threshold: int = 5 * SECOND, by: str = "symbol") -> DataFrame:
    """(symbol, cause, conn_id, gap_start_rtime, gap_end_rtime, missing) of rows (symbol, conn_id, rtime, id) in order of arrival.

    The rules of operators.capture: no row on any connection for longer than the threshold is merged-silent; one connection
    alone is connection-silent, and a merged gap takes precedence; an id more than one above the largest before it is an id-skip. A
    symbol is a group of its own; its state is the last time of each connection and the largest id.
    """
    out = f"{by} string, cause string, conn_id int, gap_start_rtime long, gap_end_rtime long, missing long"
    names = [by, "cause", "conn_id", "gap_start_rtime", "gap_end_rtime", "missing"]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(parts)).sort_values(["rtime", "conn_id", "id"], kind="stable")
        conns, lasts, most = state.get if state.exists else ([], [], None)
        last = dict(zip(conns, lasts, strict=True))
        t, conn, ids = frame["rtime"].to_numpy(), frame["conn_id"].to_numpy(), frame["id"].astype("Int64")
        low = np.iinfo(np.int64).min
        anyone = np.maximum.accumulate(np.concatenate(([max(last.values(), default=low)], t)))[:-1]
        own = np.full(len(t), low)
        for c in np.unique(conn).tolist():
            at = np.flatnonzero(conn == c)
            own[at] = np.maximum.accumulate(np.concatenate(([last.get(c, low)], t[at])))[:-1]
            last[c] = max(last.get(c, low), int(t[at].max()))
        merged = (anyone > low) & (t - np.where(anyone > low, anyone, t) > threshold)
        alone = (own > low) & ~merged & (t - np.where(own > low, own, t) > threshold)
        known = np.flatnonzero(ids.notna().to_numpy())
        number = ids.iloc[known].to_numpy(dtype=np.int64)
        prior = np.maximum.accumulate(np.concatenate(([low if most is None else most], number)))[:-1]
        skip = (prior > low) & (number - np.where(prior > low, prior, number) > 1)
        found = [(key[0], "merged-silent", None, int(a), int(b), None) for a, b in zip(anyone[merged], t[merged], strict=True)]
        found += [(key[0], "connection-silent", int(c), int(a), int(b), None) for c, a, b in zip(conn[alone], own[alone], t[alone], strict=True)]
        before = np.where(anyone > low, anyone, t)[known]
        found += [(key[0], "id-skip", None, int(a), int(b), int(n)) for a, b, n in zip(before[skip], t[known][skip], (number - prior - 1)[skip], strict=True)]
        if len(number):
            most = max(int(number.max()), low if most is None else most)
        state.update((list(last), [last[c] for c in last], most))
        yield pd.DataFrame(found, columns=names).astype({"conn_id": "Int32", "gap_start_rtime": "int64", "gap_end_rtime": "int64", "missing": "Int64"})

    some = rows.select(by, "conn_id", "rtime", "id")
    return some.groupBy(by).applyInPandasWithState(step, out, "conns array<int>, lasts array<long>, most long", "append", GroupStateTimeout.NoTimeout)


def to_ledger(found: DataFrame, path: str, checkpoint: str, trigger: dict[str, Any] | None = None) -> StreamingQuery:
    """Appends gaps as Parquet by the date on which they end."""
    out = found.withColumn("date", date_string(F.col("gap_end_rtime")))
    return out.writeStream.format("parquet").partitionBy("date").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "60 seconds"})).start()


def gaps(rows: DataFrame, threshold: int = 5 * SECOND) -> DataFrame:
    """(conn_id, gap_start_rtime, gap_end_rtime) of silences of each connection, found as its next row arrives. State is one number a connection."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = pd.concat([p["rtime"] for p in parts]).sort_values().to_numpy()
        last, out = state.get[0] if state.exists else None, []
        for t in times.tolist():
            if last is not None and t - last > threshold:
                out.append((key[0], last, t))
            last = t if last is None else max(last, t)
        state.update((last,))
        yield pd.DataFrame(out, columns=["conn_id", "gap_start_rtime", "gap_end_rtime"]).astype({"conn_id": "int32", "gap_start_rtime": "int64", "gap_end_rtime": "int64"})

    out = "conn_id int, gap_start_rtime long, gap_end_rtime long"
    return rows.groupBy("conn_id").applyInPandasWithState(step, out, "last long", "append", GroupStateTimeout.NoTimeout)


def to_days(rows: DataFrame, path: str, checkpoint: str, trigger: dict[str, Any] | None = None) -> StreamingQuery:
    """Writes a stream as Parquet by date; files appear whole, once, whatever restarts."""
    out = rows.withColumn("date", date_string(F.col("etime")))
    return out.writeStream.format("parquet").partitionBy("date").option("path", path).option("compression", "zstd").option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "900 seconds"})).start()


def decisions(events: DataFrame, window: int = SECOND) -> DataFrame:
    """Decision rows of a stream of merged events in order of time, one group a day: the features of operators.features, carried over batches.

    The last event of a batch is held back until its etime is over. State is the book, the window's trades and the row held back.
    """
    out = "day long, etime long, decision_seq long, mid double, imb_top double, ofi double, trade_flow double, warmup boolean"
    kept = "bid double, bq double, ask double, aq double, ofi double, quotes long, first long, times array<long>, volumes array<long>, held_etime long, held_seq long"

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["etime", "source_rank", "seq"])
        b, bq, a, aq, ofi, quotes, first, times, volumes, held, held_seq = state.get if state.exists else (None, None, None, None, None, 0, None, [], [], None, None)
        times, volumes, done = list(times), list(volumes), []

        def emit() -> None:
            while times and times[0] <= held - window:
                times.pop(0), volumes.pop(0)
            mid = None if b is None else (b + a) / 2
            imb = None if b is None or bq + aq == 0 else (bq - aq) / (bq + aq)
            done.append((key[0], held, held_seq, mid, imb, ofi, sum(volumes) / 1e8, quotes < 2 or held < first + window))

        for r in rows.itertuples(index=False):
            if held is not None and r.etime != held:
                emit()
            first = r.etime if first is None else first
            if r.source_rank == 0:
                if b is not None:
                    ofi = (r.bid_qty if r.bid_price >= b else 0.0) - (bq if r.bid_price <= b else 0.0) - (r.ask_qty if r.ask_price <= a else 0.0) + (aq if r.ask_price >= a else 0.0)
                b, bq, a, aq, quotes = r.bid_price, r.bid_qty, r.ask_price, r.ask_qty, quotes + 1
            else:
                times.append(r.etime)
                volumes.append(int(round(r.trade_qty * 1e8)) * int(r.trade_side))
            held, held_seq = r.etime, r.seq
        state.update((b, bq, a, aq, ofi, quotes, first, times, volumes, held, held_seq))
        frame = pd.DataFrame(done, columns=["day", "etime", "decision_seq", "mid", "imb_top", "ofi", "trade_flow", "warmup"])
        yield frame.astype({"day": "int64", "etime": "int64", "decision_seq": "int64", "mid": "float64", "imb_top": "float64", "ofi": "float64", "trade_flow": "float64", "warmup": "bool"})

    return events.groupBy("day").applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.NoTimeout)
