from __future__ import annotations

import asyncio
import json

import pytest

from tidemill.streaming import capture
from tidemill.streaming import websocket as w

QUOTE = json.dumps({"stream": "x@bookTicker", "data": {"u": 1}})
TRADE = json.dumps({"stream": "x@trade", "data": {"t": 1}})


class Server:
    """A server whose n-th connection (the last again and again) sends the n-th script: bytes go out as they are, a number is a pause, None hangs up."""

    def __init__(self, *scripts):
        self.scripts, self.seen, self.got = scripts, 0, []

    async def __aenter__(self):
        self.server = await asyncio.start_server(self.serve, "127.0.0.1", 0)
        return f"ws://127.0.0.1:{self.server.sockets[0].getsockname()[1]}/stream?streams=a/b"

    async def __aexit__(self, *_):
        self.server.close()

    async def serve(self, reader, writer):
        script = self.scripts[min(self.seen, len(self.scripts) - 1)]
        self.seen += 1
        head = (await reader.readuntil(b"\r\n\r\n")).decode()
        key = head.split("Sec-WebSocket-Key: ")[1].split("\r\n")[0]
        writer.write(f"HTTP/1.1 101 Switching Protocols\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Accept: {w.accept_key(key)}\r\n\r\n".encode())

        async def hear():
            while True:
                self.got.append(await w.read_frame(reader))

        ears = asyncio.ensure_future(hear())
        for x in script:
            if x is None:
                break
            await asyncio.sleep(x) if isinstance(x, float) else writer.write(x)
        ears.cancel()
        await asyncio.gather(ears, return_exceptions=True)
        writer.close()


def sent(text, kind=1, last=True):
    return w.encoded(kind, text.encode(), masked=False, last=last)


def landed(folder):
    return [json.loads(x) for p in sorted(folder.glob("*.json")) for x in p.read_text(encoding="utf-8").splitlines()]


async def some(url, folder, n, seconds=20.0, **options):
    """Listens until n lines have appeared."""
    task = asyncio.ensure_future(w.listen(url, 3, str(folder), lines=1, wait=0.05, tell=lambda _: None, **options))
    for _ in range(int(seconds / 0.05)):
        await asyncio.sleep(0.05)
        if task.done() or len(landed(folder)) >= n:
            break
    task.cancel()
    await asyncio.gather(task, return_exceptions=True)
    if not task.cancelled():
        task.result()


def test_the_handshake_of_the_standard():
    assert w.accept_key("dGhlIHNhbXBsZSBub25jZQ==") == "s3pPLMBiTxaQ9kYGzzhZRbK+xOo="


@pytest.mark.parametrize("n", [0, 125, 126, 65535, 65536])
@pytest.mark.parametrize("masked", [True, False])
def test_frames_of_all_lengths(n, masked):
    async def run():
        reader = asyncio.StreamReader()
        reader.feed_data(w.encoded(1, bytes(k % 251 for k in range(n)), masked))
        return await w.read_frame(reader)

    assert asyncio.run(run()) == (1, True, bytes(k % 251 for k in range(n)))


def test_texts_pieces_pings_and_what_is_no_frame_land_word_for_word(tmp_path):
    pieces = sent(TRADE[:10], last=False) + sent("hear me", kind=9) + sent(TRADE[10:], kind=0)
    server = Server([sent(QUOTE) + pieces + sent("no json ü"), 30.0])

    async def run():
        async with server as url:
            await some(url, tmp_path, 3)

    asyncio.run(run())
    got = landed(tmp_path)
    assert [x["frame"] for x in got] == [QUOTE, TRADE, "no json ü"]
    assert {x["conn_id"] for x in got} == {3} and [x["rtime"] for x in got] == sorted(x["rtime"] for x in got)
    assert (10, True, b"hear me") in server.got
    assert not list(tmp_path.glob(".*"))


def test_it_connects_again_after_a_close_and_after_a_cut(tmp_path):
    closing = w.encoded(8, (1001).to_bytes(2, "big"), masked=False)
    cut = sent(QUOTE)[:-4]
    server = Server([sent(QUOTE), closing, 0.2, None], [sent(TRADE) + cut, None], [sent("third"), 30.0])

    async def run():
        async with server as url:
            await some(url, tmp_path, 3)

    asyncio.run(run())
    assert [x["frame"] for x in landed(tmp_path)] == [QUOTE, TRADE, "third"] and server.seen == 3


def test_silence_is_found_by_a_ping_without_answer(tmp_path):
    server = Server([sent(QUOTE), 30.0], [sent(TRADE), 30.0])

    async def run():
        async with server as url:
            await some(url, tmp_path, 2, idle=0.2)

    asyncio.run(run())
    assert [x["frame"] for x in landed(tmp_path)] == [QUOTE, TRADE] and any(k == 9 for k, _, _ in server.got)


def test_a_stream_that_sends_nothing_at_the_start_is_loud(tmp_path):
    server = Server([sent(QUOTE), 30.0])

    async def run():
        async with server as url:
            with pytest.raises(w.Silent, match="trade"):
                await some(url, tmp_path, 5, startup=0.4)

    asyncio.run(run())
    assert [x["frame"] for x in landed(tmp_path)] == [QUOTE]


@pytest.mark.parametrize("url", ["ws://example.org/x", "http://127.0.0.1/x", "ws://127.0.0.1.example.org/"])
def test_urls_without_encryption_are_refused(tmp_path, url):
    with pytest.raises(ValueError, match="secure"):
        asyncio.run(w.listen(url, 0, str(tmp_path)))


def test_files_appear_whole_and_two_connections_are_made_single(spark, tmp_path):
    frames = [json.dumps({"stream": "x@trade", "data": {"t": k}}) for k in range(40)]
    folder = tmp_path / "in"

    async def run():
        async with Server([b"".join(sent(f) for f in frames), 30.0]) as one, Server([b"".join(sent(f) for f in frames[:30]), 30.0]) as two:
            task = asyncio.ensure_future(w.capture([one, two], str(folder), expected=set(), lines=16, seconds=0.3, tell=lambda _: None))
            for _ in range(200):
                await asyncio.sleep(0.05)
                if len(landed(folder)) == 70:
                    break
            task.cancel()
            await asyncio.gather(task, return_exceptions=True)

    asyncio.run(run())
    assert len(list(folder.glob("conn_0.*"))) >= 3
    rows = capture.frames(spark, str(folder))
    query = rows.writeStream.format("memory").queryName("landed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("landed")
    assert got.count() == 70 and got.select("frame").distinct().count() == 40
    assert {r["conn_id"]: r["count"] for r in got.groupBy("conn_id").count().collect()} == {0: 40, 1: 30}
