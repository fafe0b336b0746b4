"""WebSocket connections that land frames as JSON lines, from which `capture.frames` streams them.

A socket cannot be read again, so it is no source of a stream by itself: a connection writes what it receives, word for
word, into files of the folder that the stream reads. A file is written under a hidden name and appears, whole,
when it has enough lines or is old enough; a file is never appended to, and what a killed process leaves hidden
has whole lines up to its last. Several connections to one feed differ in conn_id alone.
"""

from __future__ import annotations

import asyncio
import base64
import hashlib
import json
import os
import ssl
import struct
import time
from collections.abc import AsyncIterator, Callable
from pathlib import Path
from urllib.parse import urlsplit

#: Fixed values of RFC 6455: the handshake's suffix and the kinds of frames.
_SUFFIX = "258EAFA5-E914-47DA-95CA-C5AB0DC85B11"
_MORE, _TEXT, _BINARY, _CLOSE, _PING, _PONG = 0, 1, 2, 8, 9, 10


class Silent(RuntimeError):
    """A stream that was asked for has sent nothing in the time allowed after the first connection."""


class Closed(ConnectionError):
    """The other side ended the connection; code is None where it sent no close frame."""

    def __init__(self, code: int | None = None):
        super().__init__(f"closed, code {code}")
        self.code = code


def accept_key(key: str) -> str:
    return base64.b64encode(hashlib.sha1((key + _SUFFIX).encode()).digest()).decode()


def encoded(kind: int, body: bytes, masked: bool = True, last: bool = True) -> bytes:
    """One frame of the protocol; a client's are masked."""
    n, bit = len(body), 0x80 if masked else 0
    head = bytes([kind | (0x80 if last else 0)])
    head += bytes([bit | n]) if n < 126 else bytes([bit | 126]) + struct.pack(">H", n) if n < 1 << 16 else bytes([bit | 127]) + struct.pack(">Q", n)
    if not masked:
        return head + body
    mask = os.urandom(4)
    return head + mask + bytes(b ^ mask[i & 3] for i, b in enumerate(body))


async def read_frame(reader: asyncio.StreamReader, most: int = 16 << 20) -> tuple[int, bool, bytes]:
    """(kind, whether it ends a message, body)."""
    first, second = await reader.readexactly(2)
    n = second & 0x7F
    if n > 125:
        n = int.from_bytes(await reader.readexactly(2 if n == 126 else 8), "big")
    if n > most:
        raise ConnectionError(f"a frame of {n} bytes")
    mask = await reader.readexactly(4) if second & 0x80 else b""
    body = await reader.readexactly(n)
    return first & 0x0F, bool(first & 0x80), bytes(b ^ mask[i & 3] for i, b in enumerate(body)) if mask else body


async def messages(url: str, idle: float = 20.0, opened: Callable[[], None] = lambda: None) -> AsyncIterator[str]:
    """The texts that a server sends. Pings are answered; one is sent after `idle` seconds of silence, and after as long again without a word the connection counts as lost.

    `opened` is called once the connection stands. Raises ValueError for a url that is not wss://, or ws:// on this machine.
    """
    at = urlsplit(url)
    if at.scheme != "wss" and (at.scheme, at.hostname) not in (("ws", "127.0.0.1"), ("ws", "localhost")):
        raise ValueError(f"no secure url: {url}")
    secure = ssl.create_default_context() if at.scheme == "wss" else None
    coming = None
    reader, writer = await asyncio.wait_for(asyncio.open_connection(at.hostname, at.port or (443 if secure else 80), ssl=secure), idle)
    try:
        key = base64.b64encode(os.urandom(16)).decode()
        target = (at.path or "/") + (f"?{at.query}" if at.query else "")
        head = [f"GET {target} HTTP/1.1", f"Host: {at.netloc.rpartition('@')[2]}", "Upgrade: websocket", "Connection: Upgrade", f"Sec-WebSocket-Key: {key}", "Sec-WebSocket-Version: 13"]
        writer.write(("\r\n".join(head) + "\r\n\r\n").encode())
        status, *fields = (await asyncio.wait_for(reader.readuntil(b"\r\n\r\n"), idle)).decode("latin-1").split("\r\n")
        told = {k.strip().lower(): v.strip() for k, _, v in (f.partition(":") for f in fields)}
        if status.split(" ")[1:2] != ["101"] or told.get("sec-websocket-accept") != accept_key(key):
            raise ConnectionError(f"no WebSocket: {status}")
        opened()
        parts, asked = [], False
        while True:
            coming = coming or asyncio.ensure_future(read_frame(reader))  # kept over a timeout: a frame that has begun is not lost
            done, _ = await asyncio.wait({coming}, timeout=idle)
            if not done:
                if asked:
                    raise Closed()
                writer.write(encoded(_PING, b""))
                asked = True
                continue
            kind, last, body = coming.result()
            asked, coming = False, None
            if kind == _CLOSE:
                writer.write(encoded(_CLOSE, body[:2]))
                raise Closed(int.from_bytes(body[:2], "big") if len(body) > 1 else None)
            if kind == _PING:
                writer.write(encoded(_PONG, body))
            elif kind in (_MORE, _TEXT, _BINARY):
                parts.append(body)
                if last:
                    yield b"".join(parts).decode("utf-8", "replace")
                    parts = []
    except asyncio.IncompleteReadError as e:
        raise Closed() from e
    finally:
        if coming is not None:
            coming.cancel()
        writer.close()


class Landing:
    """Files of (conn_id, rtime, frame) lines that appear whole after `lines` lines or `seconds` seconds."""

    def __init__(self, folder: str, conn_id: int, lines: int = 500, seconds: float = 5.0):
        self.folder, self.conn_id, self.most, self.seconds = Path(folder), conn_id, lines, seconds
        self.folder.mkdir(parents=True, exist_ok=True)
        self._file = None
        self._stamp = 0

    def append(self, rtime: int, frame: str) -> None:
        if self._file is None:
            self._stamp = max(time.time_ns(), self._stamp + 1)  # names of one process never go back
            self._path = self.folder / f".conn_{self.conn_id}.{self._stamp}.json"
            self._file, self._n, self._since = self._path.open("x", encoding="utf-8"), 0, time.monotonic()
        self._file.write(json.dumps({"conn_id": self.conn_id, "rtime": rtime, "frame": frame}) + "\n")
        self._file.flush()
        self._n += 1
        if self._n >= self.most:
            self.close()

    def tick(self) -> None:
        """Lets a file that is old enough appear though nothing comes."""
        if self._file is not None and time.monotonic() - self._since >= self.seconds:
            self.close()

    def close(self) -> None:
        if self._file is not None:
            os.fsync(self._file.fileno())
            self._file.close()
            self._path.rename(self._path.with_name(self._path.name[1:]))
            self._file = None


def stream_kind(text: str) -> str | None:
    """What operators.capture.kind calls the frame's stream; None for what is no frame."""
    try:
        name = json.loads(text).get("stream")
    except (ValueError, AttributeError):
        return None
    return "quote" if str(name).endswith("@bookTicker") else "trade" if str(name).endswith("@trade") else None


async def listen(
    url: str, conn_id: int, folder: str, expected: set[str] = frozenset({"quote", "trade"}), startup: float = 10.0, wait: float = 1.0, longest: float = 60.0, idle: float = 20.0,
    tell: Callable[[str], None] = print, **landing,
) -> None:
    """Lands what a connection sends, and connects again whenever it ends, until cancelled.

    Raises Silent if a kind in `expected` has not come within `startup` seconds after the first connection stood; later connections are not
    asked. Between attempts it waits `wait` seconds, twice as long after each failure in a row, up to `longest`.
    """
    out, missing, up = Landing(folder, conn_id, **landing), set(expected), asyncio.Event()

    async def ticking() -> None:
        while True:
            await asyncio.sleep(min(1.0, out.seconds))
            out.tick()

    async def awake() -> None:
        await up.wait()
        await asyncio.sleep(startup)
        if missing:
            raise Silent(f"connection {conn_id}: nothing from {sorted(missing)} within {startup} s")
        await asyncio.Event().wait()

    async def receiving() -> None:
        attempt, pause = 0, wait
        while True:
            attempt += 1
            began = time.monotonic()
            try:
                async for text in messages(url, idle, up.set):
                    out.append(time.time_ns(), text)
                    missing.discard(stream_kind(text))
                    pause = wait
            except OSError as e:  # refused, reset, timed out, closed
                tell(f"connection {conn_id}: attempt {attempt} ended after {time.monotonic() - began:.1f} s: {e}")
            if up.is_set():
                missing.clear()
            await asyncio.sleep(pause)
            pause = min(2 * pause, longest)

    tasks = [asyncio.ensure_future(t()) for t in (ticking, awake, receiving)]
    try:
        done, _ = await asyncio.wait(tasks, return_when=asyncio.FIRST_EXCEPTION)
        for t in done:
            t.result()
    finally:
        for t in tasks:
            t.cancel()
        await asyncio.gather(*tasks, return_exceptions=True)
        out.close()


async def capture(urls: list[str], folder: str, **options) -> None:
    """Redundant connections, numbered from 0, into one folder; what `capture.frames` reads and `capture.deduplicated` makes single. One that raises ends all."""
    async with asyncio.TaskGroup() as group:
        for k, url in enumerate(urls):
            group.create_task(listen(url, k, folder, **options))
