from __future__ import annotations

import os
import random
import time

import pytest
import zstandard

from tidemill.sources import reframe as r


def lines(n, seed=1):
    rng = random.Random(seed)
    return [b'{"conn_id":%d,"rtime":%d,"frame":"%s"}' % (k % 2, k, b"x" * rng.randrange(200)) for k in range(n)]


def one_by_one(rows):
    """A frame a line, as a writer without a shared compressor leaves it."""
    return b"".join(zstandard.ZstdCompressor().compress(x + b"\n") for x in rows)


def read(path):
    with zstandard.ZstdDecompressor().stream_reader(path.open("rb"), read_across_frames=True) as f:
        return f.read().splitlines()


def aged(path, data, seconds=1000):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    os.utime(path, (time.time() - seconds,) * 2)
    return path


@pytest.mark.parametrize("n", [1, 499, 500, 501, 5000])
def test_the_lines_stay_and_the_file_shrinks(tmp_path, n):
    rows = lines(n)
    path = aged(tmp_path / "a.zst", one_by_one(rows))
    row = r.reframe_file(path)
    assert read(path) == rows and row[1:4] == ("reframed", n, len(one_by_one(rows)))
    assert row[4] == path.stat().st_size and (n < 500 or row[4] < row[3] / 2)
    assert r.reframe_file(path)[1:3] == ("reframed", n) and read(path) == rows
    assert [p.name for p in tmp_path.iterdir()] == ["a.zst"]


def test_empty_lines_a_last_line_without_end_and_skippable_frames(tmp_path):
    c = zstandard.ZstdCompressor()
    skippable = (0x184D2A50).to_bytes(4, "little") + (5).to_bytes(4, "little") + b"12345"
    path = aged(tmp_path / "a.zst", c.compress(b"one\n\ntw") + skippable + c.compress(b"o\nthree"))
    assert r.reframe_file(path)[1:3] == ("reframed", 3)
    assert read(path) == [b"one", b"two", b"three"]


@pytest.mark.parametrize("cut", [1, 3, 9, 40])
def test_a_writer_that_died_in_a_frame(tmp_path, cut):
    rows = lines(300)
    whole = one_by_one(rows[:-50])
    last = zstandard.ZstdCompressor().compress(b"\n".join(rows[-50:]))
    path = aged(tmp_path / "a.zst", whole + last[:cut])
    row = r.reframe_file(path)
    assert row[1] == "truncated" and row[2] >= 250 and row[5] == len(whole) and path.read_bytes() == whole + last[:cut]
    row = r.reframe_file(path, accept_truncated=True)
    assert row[1] == "reframed_truncated" and read(path) == rows[: row[2]]
    assert (tmp_path / "a.zst.crashed").read_bytes() == whole + last[:cut]
    assert r.reframe_file(path, accept_truncated=True)[1] == "reframed"


def test_old_bytes_of_a_crash_are_never_overwritten(tmp_path):
    path = aged(tmp_path / "a.zst", one_by_one(lines(9))[:-3])
    (tmp_path / "a.zst.crashed").write_bytes(b"other")
    with pytest.raises(FileExistsError):
        r.reframe_file(path, accept_truncated=True)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.zst", "a.zst.crashed"] and (tmp_path / "a.zst.crashed").read_bytes() == b"other"


def test_an_empty_file_stays(tmp_path):
    path = aged(tmp_path / "a.zst", b"")
    assert r.reframe_file(path)[1:] == ("empty", 0, 0, 0, 0, 0) and path.read_bytes() == b""


def test_a_rewrite_that_differs_leaves_the_old_file(tmp_path, monkeypatch):
    path = aged(tmp_path / "a.zst", one_by_one(lines(9)))
    kept = path.read_bytes()
    write = r._write
    monkeypatch.setattr(r, "_write", lambda rows, to, every: write(([x[:-1] for x in some] for some in rows), to, every))
    with pytest.raises(ValueError, match="differ"):
        r.reframe_file(path)
    assert path.read_bytes() == kept and [p.name for p in tmp_path.iterdir()] == ["a.zst"]


def test_all_files_of_a_folder(spark, tmp_path):
    root = tmp_path / "raw lines"  # a space: paths are escaped
    today = time.strftime("%Y-%m-%d", time.gmtime())
    aged(root / "date=2024-01-01" / "a.zst", one_by_one(lines(700)))
    aged(root / "date=2024-01-01" / "b.zst", b"")
    aged(root / "date=2024-01-02" / "a.zst", one_by_one(lines(20))[:-2])
    aged(root / "date=2024-01-02" / "bad.zst", b"no zstd at all")
    aged(root / "date=2024-01-02" / "new.zst", one_by_one(lines(5)), 10)
    aged(root / f"date={today}" / "a.zst", one_by_one(lines(5)))
    aged(root / "notes.txt", b"left alone")
    got = {x["path"].split("/", 1)[1].split("raw lines/")[1]: (x["status"], x["lines"]) for x in r.reframed(spark, str(root)).collect()}
    assert got == {
        "date=2024-01-01/a.zst": ("reframed", 700), "date=2024-01-02/a.zst": ("truncated", 19),
        "date=2024-01-02/bad.zst": ("corrupt", 0), "date=2024-01-02/new.zst": ("active", None), f"date={today}/a.zst": ("active", None),
    }
    assert read(root / "date=2024-01-01" / "a.zst") == lines(700) and not (root / "date=2024-01-01" / "b.zst").read_bytes()


def test_unfinished_files_are_swept_once_they_are_old(tmp_path):
    old = aged(tmp_path / "date=1" / "part.parquet.tmp", b"x", 60)
    new = aged(tmp_path / "date=1" / "other.parquet.tmp", b"x", 1)
    kept = aged(tmp_path / "part.parquet", b"x", 60)
    assert r.sweep_unfinished(str(tmp_path)) == [str(old)]
    assert new.exists() and kept.exists() and not old.exists()
