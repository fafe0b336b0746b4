"""The lake's governance: content-addressed manifests, gates on reads, quarantine, looks, and ledgers of small rows.

All of this is driver-side metadata (one small JSON body a partition set, one row a look); rows of data stay in Spark.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Refused(RuntimeError):
    """A read or write that a gate does not allow."""


def canonical(body: dict) -> bytes:
    """Sorted, compact JSON of a body without its own id."""
    return json.dumps({k: v for k, v in body.items() if k != "manifest_id"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def body_id(body: dict) -> str:
    return hashlib.sha256(canonical(body)).hexdigest()


def write_new(path: Path, text: str) -> None:
    """Creates a file whole or fails if it is there."""
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{os.getpid()}.{time.monotonic_ns()}")
    part.write_text(text)
    try:
        os.link(part, path)
    finally:
        part.unlink()


@dataclass
class Registry:
    """Manifests, holdout, looks and acknowledgements under one folder."""

    root: Path
    clock: callable = field(default=time.time_ns)

    def issue(self, dataset: str, tier: str, schema_version: int, inputs: list[str], partitions: list[dict], code: str) -> dict:
        """A manifest of partitions (path, sha256, rows, etime_min, etime_max, date): paths are relative, unique, and never issued before."""
        paths = [p["path"] for p in partitions]
        if not partitions or len(set(paths)) != len(paths):
            raise Refused("partitions are missing or come twice")
        taken = {p["path"] for m in self.manifests(dataset) for p in m["partitions"]}
        if bad := [p for p in paths if p in taken or os.path.isabs(p) or ".." in Path(p).parts or not p.startswith(f"{tier}/")]:
            raise Refused(f"these paths are written, or outside of {tier}: {bad}")
        body = {
            "dataset": dataset, "tier": tier, "schema_version": schema_version, "inputs": sorted(inputs), "partitions": sorted(partitions, key=lambda p: p["path"]), "code": code, "issued_at": self.clock(),
            "rows": sum(p["rows"] for p in partitions), "etime_min": min(p["etime_min"] for p in partitions), "etime_max": max(p["etime_max"] for p in partitions),
        }
        body["manifest_id"] = body_id(body)
        write_new(self.root / "manifests" / dataset / f"{body['manifest_id']}.json", json.dumps(body))
        for d in {p["date"] for p in partitions}:
            pointer = self.root / "by_date" / dataset / f"{d}.json"
            pointer.parent.mkdir(parents=True, exist_ok=True)
            pointer.write_text(json.dumps({"manifest_id": body["manifest_id"]}))
        return body

    def manifests(self, dataset: str) -> list[dict]:
        return [json.loads(p.read_text()) for p in sorted((self.root / "manifests" / dataset).glob("*.json"))]

    def resolve(self, dataset: str, manifest_id: str, tier: str | None = None) -> dict:
        body = json.loads((self.root / "manifests" / dataset / f"{manifest_id}.json").read_text())
        if body_id(body) != manifest_id:
            raise Refused(f"manifest {manifest_id} does not hash to its name")
        if tier and body["tier"] != tier:
            raise Refused(f"manifest {manifest_id} is of tier {body['tier']}")
        return body

    def of_date(self, dataset: str, date: str) -> dict | None:
        pointer = self.root / "by_date" / dataset / f"{date}.json"
        return self.resolve(dataset, json.loads(pointer.read_text())["manifest_id"]) if pointer.exists() else None

    def source(self, body: dict) -> str:
        found = {part.split("=", 1)[1] for p in [*body["inputs"], *(q["path"] for q in body["partitions"])] for part in p.split("/") if part.startswith("source=")}
        return found.pop() if len(found) == 1 else "unknown"

    def hold_out(self, dates: list[str], reason: str) -> None:
        write_new(self.root / "holdout.json", json.dumps({"dates": sorted(dates), "reason": reason, "locked_at": self.clock()}))

    def held_out(self) -> set[str]:
        path = self.root / "holdout.json"
        return set(json.loads(path.read_text())["dates"]) if path.exists() else set()

    def assert_open(self, dates: list[str]) -> None:
        if locked := sorted(self.held_out() & set(dates)):
            raise Refused(f"held out: {locked}")

    def declare_holdout(self, dates: list[str], reason: str, dry_run: bool = False) -> list[str]:
        """Locks the dates and the day before each, whose labels read them; returns what is, or would be, locked."""
        days = {date.fromisoformat(d) for d in dates}
        locked = sorted(d.isoformat() for d in days | {d - timedelta(days=1) for d in days})
        if not dry_run:
            self.hold_out(locked, reason)
        return locked

    def issue_errata(self, name: str, cells: list[dict], of: str) -> str:
        """A hash-named list of cells (etime, decision_seq) whose label is not to be used; only zeros that became null may be listed."""
        if bad := [c for c in cells if c.get("shape") != "zero_to_null"]:
            raise Refused(f"cells of another shape: {bad[:3]}")
        body = {"of": of, "cells": sorted(cells, key=lambda c: (c["etime"], c["decision_seq"]))}
        write_new(self.root / "errata" / name / f"{body_id(body)}.json", json.dumps(body))
        return body_id(body)

    def errata(self, name: str, errata_id: str) -> list[dict]:
        body = json.loads((self.root / "errata" / name / f"{errata_id}.json").read_text())
        if body_id(body) != errata_id:
            raise Refused(f"errata {errata_id} does not hash to its name")
        return body["cells"]

    def quarantine(self, dataset: str, date_: str, root: str, reason: str) -> dict:
        """Moves a date's partition into the lockbox tier; the old manifest can no longer be loaded.

        The manifest is issued first: after a crash the bytes are still where one of the two manifests says, and calling again moves the rest.
        """
        body = self.of_date(dataset, date_)
        entries = [p for p in body["partitions"] if p["date"] == date_]
        moved = [p | {"path": "lockbox/" + p["path"].split("/", 1)[1]} for p in entries]
        known = self.of_date(f"{dataset}-lockbox", date_)
        boxed = known or self.issue(f"{dataset}-lockbox", "lockbox", body["schema_version"], [body["manifest_id"], reason], moved, body["code"])
        for old, new in zip(entries, moved, strict=True):
            os.makedirs(os.path.dirname(f"{root}/{new['path']}"), exist_ok=True)
            if os.path.exists(f"{root}/{old['path']}"):
                os.rename(f"{root}/{old['path']}", f"{root}/{new['path']}")
        return boxed

    def acknowledge(self, dataset: str, date: str, findings: list[str], by: str) -> None:
        write_new(self.root / "acknowledged" / dataset / f"{date}.json", json.dumps({"findings": sorted(findings), "by": by, "at": self.clock()}))

    def assert_quality(self, dataset: str, verdicts: dict[str, tuple[str, list[str]]]) -> None:
        """verdicts: date to (verdict, checks that are not ok). What is not ok needs an acknowledgement of just these findings."""
        for date, (verdict, findings) in sorted(verdicts.items()):
            path = self.root / "acknowledged" / dataset / f"{date}.json"
            known = json.loads(path.read_text()) if path.exists() else {}
            if verdict != "ok" and (known.get("findings") != sorted(findings) or known["at"] > self.clock()):
                raise Refused(f"{dataset} {date} is {verdict}: {findings}")

    @contextlib.contextmanager
    def locked(self, name: str) -> Iterator[None]:
        path = self.root / "locks" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        try:
            os.close(os.open(path, os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            raise Refused(f"{name} is in use") from None
        try:
            yield
        finally:
            path.unlink()

    def _ledger(self, name: str) -> list[dict]:
        path = self.root / f"{name}.jsonl"
        return [json.loads(x) for x in path.read_text().splitlines()] if path.exists() else []

    def _append(self, name: str, row: dict) -> None:
        self.root.mkdir(parents=True, exist_ok=True)
        with (self.root / f"{name}.jsonl").open("a") as f:
            f.write(json.dumps(row | {"at": self.clock()}) + "\n")

    def looks(self, manifest_id: str, segment: str) -> int:
        return sum(r["manifest_id"] == manifest_id and r["segment"] == segment for r in self._ledger("looks"))

    def look(self, manifest_id: str, segment: str, allowance: int, tags: dict) -> int:
        """Spends one look at a segment, or refuses; returns how many are spent."""
        with self.locked(f"look-{manifest_id}-{segment}"):
            if (spent := self.looks(manifest_id, segment)) >= allowance:
                raise Refused(f"{segment}: {spent} of {allowance} looks are spent")
            self._append("looks", {"manifest_id": manifest_id, "segment": segment, "tags": tags})
            return spent + 1

    def exhausted(self, allowances: dict[tuple[str, str], int]) -> list[tuple[str, str]]:
        return sorted(k for k, most in allowances.items() if self.looks(*k) >= most)

    def negative(self, config: dict, reason: str) -> int:
        """Records a result that failed; returns how often this configuration has."""
        self._append("negative", {"fingerprint": body_id(config), "config": config, "reason": reason})
        return len(self.negatives(body_id(config)))

    def negatives(self, fingerprint: str) -> list[dict]:
        return sorted((r for r in self._ledger("negative") if r["fingerprint"] == fingerprint), key=lambda r: r["at"])

    def issue_token(self, token: str, dataset: str, manifest_id: str, purpose: str) -> None:
        write_new(self.root / "tokens" / f"{token}.json", json.dumps({"dataset": dataset, "manifest_id": manifest_id, "purpose": purpose}))

    def open_once(self, token: str, purpose: str) -> dict:
        """The manifest of a token for held-out data; stamped as used before it is handed out, so it opens once."""
        body = json.loads((self.root / "tokens" / f"{token}.json").read_text())
        if body["purpose"] != purpose:
            raise Refused("the token is for another purpose")
        try:
            write_new(self.root / "tokens" / f"{token}.used", str(self.clock()))
        except FileExistsError:
            raise Refused("the token is used") from None
        return self.resolve(body["dataset"], body["manifest_id"], "lockbox")

    def run(self, tags: dict, needed: tuple[str, ...] = ("code", "data", "segment", "seed")) -> None:
        if missing := [t for t in needed if t not in tags]:
            raise Refused(f"tags are missing: {missing}")
        self._append("runs", tags)


def _digests(spark: SparkSession, root: str, paths: list[str]) -> dict[str, str]:
    """Partition to a digest over its files' digests, for all partitions in one job."""
    from tidemill.sources.archive import file_digests, qualified

    names = {qualified(spark, f"{root}/{p}"): p for p in paths}
    files: dict[str, list] = {p: [] for p in paths}
    for r in file_digests(spark, [f"{root}/{p}" for p in paths]).collect():  # a row a file
        folder, name = r["path"].rsplit("/", 1)
        if folder in names:
            files[names[folder]].append((name, r["sha256"]))
    return {p: hashlib.sha256(json.dumps(sorted(found)).encode()).hexdigest() for p, found in files.items()}


def entries(spark: SparkSession, root: str, dates: dict[str, str]) -> list[dict]:
    """What a manifest says of written partitions (path to date): digest, rows and times, in two jobs for all of them."""
    from tidemill.sources.archive import qualified

    found = _digests(spark, root, list(dates))
    names = {qualified(spark, f"{root}/{p}"): p for p in dates}
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    rows = spark.read.parquet(*(f"{root}/{p}" for p in dates)).select(folder.alias("_folder"), "etime").groupBy("_folder").agg(F.count("*").alias("n"), F.min("etime").alias("low"), F.max("etime").alias("high"))
    stats = {names[qualified(spark, r["_folder"].replace("%3D", "="))]: r for r in rows.collect()}  # a row a partition
    return [{"path": p, "sha256": found[p], "rows": stats[p]["n"], "etime_min": stats[p]["low"], "etime_max": stats[p]["high"], "date": d} for p, d in dates.items()]


def partition_entry(spark: SparkSession, root: str, path: str, date: str) -> dict:
    return entries(spark, root, {path: date})[0]


def verify(spark: SparkSession, root: str, partitions: list[dict]) -> list[str]:
    """The paths of partitions whose bytes are not those of their entries, found in one job."""
    found = _digests(spark, root, [p["path"] for p in partitions]) if partitions else {}
    return [p["path"] for p in partitions if found[p["path"]] != p["sha256"]]


def load(spark: SparkSession, registry: Registry, root: str, dataset: str, manifest_id: str, tier: str, columns: list[str] | None = None, verdicts: dict | None = None) -> DataFrame:
    """The rows of a manifest after all gates: tier, quarantine, quality, and the partitions' bytes."""
    body = registry.resolve(dataset, manifest_id, tier)
    registry.assert_open([p["date"] for p in body["partitions"]])
    if verdicts is not None:
        registry.assert_quality(dataset, verdicts)
    if changed := verify(spark, root, body["partitions"]):
        raise Refused(f"{changed} has changed")
    out = spark.read.parquet(*(f"{root}/{p['path']}" for p in body["partitions"]))
    return out.select(columns) if columns else out


def overlapping(bodies: list[dict], start: int, end: int) -> list[dict]:
    """Manifests whose inclusive range of times meets the half-open segment."""
    return [b for b in bodies if b["etime_min"] < end and b["etime_max"] >= start]
