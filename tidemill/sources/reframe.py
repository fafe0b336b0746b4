"""Raw archives of zstd-compressed lines, rewritten in place with larger frames; and what crashed writers left behind.

A file per task step, read as a stream: a frame's end is where the decompressor says so, so a writer that died in a
frame is told from a clean end. The new file is written beside the old one, read back, and takes its place only if
its lines are the same by count and digest. Tasks may run again: a rewritten file is a clean file. Files are
opened by path, so the archive lies in a file system that all executors mount.
"""

from __future__ import annotations

import hashlib
import os
import time
import uuid
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote, urlparse

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession

from tidemill.operators.written import written

#: Seconds for which a file counts as open after its last change, and for which an unfinished file is left alone.
ACTIVE_S, UNFINISHED_S = 300, 10
SUFFIX = ".reframe.tmp"
REPORT = "path string, status string, lines long, bytes_before long, bytes_after long, whole_frame_bytes long, dropped_bytes long"
_CHUNK = 64 << 10


class Archive:
    """The lines of one file; once they are read, `lines`, `digest`, `whole` (bytes of finished frames) and `dropped` (bytes of a last line that was cut off)."""

    def __init__(self, path: Path):
        self.path, self.size = path, path.stat().st_size
        self.lines = self.whole = self.dropped = 0
        self._digest = hashlib.sha256()

    @property
    def digest(self) -> str:
        return self._digest.hexdigest()

    @property
    def truncated(self) -> bool:
        return self.whole < self.size

    def _bytes(self) -> Iterator[bytes]:
        reader, frame, at = zstandard.ZstdDecompressor(), None, 0
        with self.path.open("rb") as f:
            while data := f.read(_CHUNK):
                at += len(data)
                while data:
                    frame = frame or reader.decompressobj()
                    yield frame.decompress(data)
                    if not frame.eof:
                        break
                    data, frame = frame.unused_data, None
                    self.whole = at - len(data)
        self.size = at

    def _counted(self, lines: list[bytes]) -> list[bytes]:
        lines = [x for x in lines if x]
        self.lines += len(lines)
        for x in lines:
            self._digest.update(x + b"\n")
        return lines

    def read(self) -> Iterator[list[bytes]]:
        """Lists of lines without their ends; empty lines are left out, and so is a last line without an end in a truncated file."""
        rest: list[bytes] = []
        for part in self._bytes():
            first, *more = part.split(b"\n")
            rest.append(first)
            if more:
                yield self._counted([b"".join(rest), *more[:-1]])
                rest = more[-1:]
        last = b"".join(rest)
        if self.truncated:
            self.dropped = len(last)
        else:
            yield self._counted([last])


def _write(lines: Iterator[list[bytes]], to: Path, every: int) -> None:
    """Frames of `every` lines, on stable storage when this returns."""
    writer, held = zstandard.ZstdCompressor(), []
    with to.open("wb") as f:
        for some in lines:
            held += some
            full = len(held) // every * every
            for k in range(0, full, every):
                f.write(writer.compress(b"\n".join(held[k : k + every]) + b"\n"))
            held = held[full:]
        if held:
            f.write(writer.compress(b"\n".join(held) + b"\n"))
        f.flush()
        os.fsync(f.fileno())


def active(path: Path, now: float) -> bool:
    """Whether a writer may still have the file open: it lies in today's (UTC) folder or changed a short while ago."""
    return f"date={time.strftime('%Y-%m-%d', time.gmtime(now))}" in path.parts or now - path.stat().st_mtime < ACTIVE_S


def reframe_file(path: Path, every: int = 500, accept_truncated: bool = False) -> tuple:
    """Rewrites one file; a row of REPORT.

    An empty file, a file that is no zstd, and, unless accepted, a file whose last frame is unfinished stay as they are. Of an
    accepted one the whole lines are rewritten, and the old bytes stay beside it as <name>.crashed, which is never overwritten.
    Raises ValueError, with the old file in place, if the lines differ or the file changed meanwhile.
    """
    before = path.stat()
    if not before.st_size:
        return str(path), "empty", 0, 0, 0, 0, 0
    old, new = Archive(path), path.with_name(f"{path.name}.{uuid.uuid4().hex}{SUFFIX}")
    row = lambda status, after: (str(path), status, old.lines, before.st_size, after, old.whole, old.dropped)
    try:
        try:
            _write(old.read(), new, every)
        except zstandard.ZstdError:
            return row("corrupt", None)
        if old.truncated and not accept_truncated:
            return row("truncated", None)
        again = Archive(new)
        for _ in again.read():
            pass
        after = path.stat()
        if (again.lines, again.digest, again.truncated) != (old.lines, old.digest, False):
            raise ValueError(f"{path}: the rewritten lines differ")
        if (before.st_size, before.st_mtime_ns, before.st_ino) != (after.st_size, after.st_mtime_ns, after.st_ino):
            raise ValueError(f"{path}: changed while it was read")
        if old.truncated:
            crashed = path.with_name(path.name + ".crashed")
            if not (crashed.exists() and crashed.samefile(path)):  # a task that died between link and replace left it
                os.link(path, crashed)
        os.replace(new, path)
    finally:
        new.unlink(missing_ok=True)
    folder = os.open(path.parent, os.O_RDONLY)
    try:
        os.fsync(folder)
    finally:
        os.close(folder)
    return row("reframed_truncated" if old.truncated else "reframed", again.size)


def reframed(spark: SparkSession, root: str, every: int = 500, accept_truncated: bool = False, skip_active: bool = True) -> DataFrame:
    """Rewrites all .zst files below root, dealt over tasks by size; a row of REPORT a file, `active` for those that a writer may have open.

    An empty file has no row: the listing leaves it out, and there is nothing to rewrite.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zst").load(root).select("path")

    def step(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in REPORT.split(", ")]
        for part in parts:
            for name in part["path"]:
                path = Path(unquote(urlparse(name).path))
                if skip_active and active(path, time.time()):
                    out = (str(path), "active", None, path.stat().st_size, None, None, None)
                else:
                    out = reframe_file(path, every, accept_truncated)
                yield pd.DataFrame([out], columns=names).astype({n: "Int64" for n in names[2:]})

    return written(files.mapInPandas(step, REPORT))


def sweep_unfinished(root: str, suffixes: tuple[str, ...] = (SUFFIX, ".parquet.tmp"), seconds: float = UNFINISHED_S, now: float | None = None) -> list[str]:
    """Deletes files with these suffixes below root that nothing has written to for so many seconds; their paths. To be called before any writer starts."""
    now, gone = time.time() if now is None else now, []
    for path in sorted(Path(root).rglob("*")):
        if path.name.endswith(suffixes) and path.is_file() and now - path.stat().st_mtime >= seconds:
            path.unlink()
            gone.append(str(path))
    return gone
