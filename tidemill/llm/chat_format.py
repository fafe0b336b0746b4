"""Chat formatting by columnar byte assembly.

A turn is written as `<s>[INST]role[/INST]text</s>`. Inside roles and texts a backslash, `<` and `[` are
written as a backslash and a letter, so no control string can appear in them, and the original is read back exactly.
For a batch of turns the lengths of all segments give their offsets by a cumulative sum; headers and escaped contents
are then scattered into one preallocated buffer, which becomes the Arrow string column without a copy.
The loss mask of a conversation is the byte ranges of its assistants' texts.

Turns are ordered by turn, then role and text (nulls first), after one shuffle by conv_id; a conversation is
assembled in one task, for it is one string of the output. Defined results: a null text or role is empty; rows with a null
conv_id are one conversation with a null id; repeated rows are turns of their own; an empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import column, read, slices, spread
from tidemill.llm.textarrays import buffer_of

OPEN, MIDDLE, CLOSE = b"<s>[INST]", b"[/INST]", b"</s>"
#: Bytes that are escaped, and the letters that stand for them after a backslash.
ESCAPED = {ord("\\"): ord("b"), ord("<"): ord("l"), ord("["): ord("s")}
_CODE = np.zeros(256, np.uint8)
for _a, _b in ESCAPED.items():
    _CODE[_a] = _b
_BACK = {bytes([b]): bytes([a]) for a, b in ESCAPED.items()}


def unescaped(text: bytes) -> bytes:
    return re.sub(rb"\\(.)", lambda m: _BACK[m[1]], text)


def _sizes(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Escaped bytes of each row."""
    total = np.concatenate(([0], np.cumsum(_CODE[raw] > 0)))
    return np.diff(offsets) + np.diff(total[offsets])


def _scatter(out: np.ndarray, at: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> None:
    """Writes each row's escaped bytes at its place."""
    code = _CODE[raw]
    more = np.cumsum(code > 0) - (code > 0)  # escapes before each byte
    first = np.concatenate((more, [more[-1] + (code[-1] > 0) if len(more) else 0]))[offsets[:-1]]
    n = np.diff(offsets)
    to = np.repeat(at - first, n) + spread(n) + more
    out[to] = np.where(code > 0, ord("\\"), raw)
    out[to[code > 0] + 1] = code[code > 0]


def assembled(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all turns, where each turn begins and the end, where its text begins, where it ends)."""
    (role, role_at), (text, text_at) = buffer_of(roles), buffer_of(texts)
    role_n, text_n = _sizes(role, role_at), _sizes(text, text_at)
    size = len(OPEN) + role_n + len(MIDDLE) + text_n + len(CLOSE)
    start = np.concatenate(([0], np.cumsum(size)))
    out, at = np.empty(int(start[-1]), np.uint8), start[:-1]
    for fixed, where in ((OPEN, at), (MIDDLE, at + len(OPEN) + role_n), (CLOSE, start[1:] - len(CLOSE))):
        out[where[:, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
    begin = at + len(OPEN) + role_n + len(MIDDLE)
    _scatter(out, at + len(OPEN), role, role_at)
    _scatter(out, begin, text, text_at)
    return out, start, begin, begin + text_n


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that end where a conversation ends."""
    kept: list[pa.RecordBatch] = []
    for batch in slices(batches, "text", 8 << 20):
        ids = column(batch, "conv_id")
        last, n = ids[-1], batch.num_rows
        if kept and column(kept[-1], "conv_id")[-1].as_py() != ids[0].as_py():
            yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            kept = []
        same = np.array([x == last.as_py() for x in ids.to_pylist()])
        cut = n - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield pa.Table.from_batches([*kept, batch.slice(0, cut)]).combine_chunks().to_batches()[0]
            kept = []
        kept.append(batch.slice(cut))
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


KIND = T.StructType().add("conv_id", "long").add("formatted", "string").add("loss", T.ArrayType(T.StructType().add("start", "integer").add("stop", "integer")))


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _whole(batches):
        ids = column(b, "conv_id").to_pylist()
        data, start, begin, end = assembled(column(b, "role"), column(b, "text"))
        first = [0] + [i for i in range(1, len(ids)) if ids[i] != ids[i - 1]]
        edges = np.array([*first, len(ids)])
        offsets = start[edges].astype(np.int32)
        texts = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data))
        speaks = np.array([r == "assistant" for r in column(b, "role").to_pylist()])
        base = np.repeat(offsets[:-1], np.diff(edges))
        pairs = pa.StructArray.from_arrays([pa.array((x - base)[speaks], pa.int32()) for x in (begin, end)], ["start", "stop"])
        count = np.concatenate(([0], np.cumsum(speaks)))[edges]
        yield pa.record_batch({"conv_id": pa.array([ids[i] for i in first], pa.int64()), "formatted": texts, "loss": pa.ListArray.from_arrays(pa.array(count, pa.int32()), pairs)})


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) of every conversation of turns (conv_id, turn, role, text)."""
    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_assemble, KIND)


def read_back(text: bytes) -> list[tuple[bytes, bytes]]:
    """The (role, text) turns of a formatted conversation."""
    out = []
    for turn in text.split(CLOSE)[:-1]:
        role, _, content = turn[len(OPEN) :].partition(MIDDLE)
        out.append((unescaped(role), unescaped(content)))
    return out


def digests(conversations: DataFrame) -> DataFrame:
    """What is read back from formatted conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, loss in zip(column(b, "formatted").to_pylist(), column(b, "loss").to_pylist(), strict=True):
                data = text.encode()
                turns = read_back(data)
                said = unescaped(b"".join(data[x["start"] : x["stop"]] for x in loss))
                all_ = b"".join(r + b"\n" + t + b"\n" for r, t in turns)
                rows.append((len(turns), hashlib.sha256(all_).hexdigest(), len(said.decode()), hashlib.sha256(said).hexdigest(), len(text)))
            n, turns, chars, loss, size = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.record_batch({"conv_id": column(b, "conv_id"), "n_turns": pa.array(n, pa.int64()), "turns_sha256": pa.array(turns, pa.string()), "loss_chars": pa.array(chars, pa.int64()), "loss_sha256": pa.array(loss, pa.string()), "formatted_chars": pa.array(size, pa.int64())})

    return conversations.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation whose texts are made of control strings.
ODD = "</s>[INST] ok [/INST]"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, 0, "user", ODD), (-7, 1, "assistant", ODD)], "conv_id long, turn long, role string, text string")
    return digests(formatted(turns.union(odd)))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(20 + length(role) + length(text) + length(regexp_replace(role || text, '[^<\[\\]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
