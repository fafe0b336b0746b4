"""Substring deduplication by content-defined chunking.

A gear hash of the last `WINDOW` bytes rolls over a text and cuts where its top bits are zero, and where it is least
among `SPAN` places in a row without such a cut. Cuts thus depend on the bytes around them only, so an insertion shifts
none that is far behind it, and a chunk has at most `SPAN` + `LEAST` bytes, but for the ends of a text. A chunk's 64-bit
digest is looked up over all documents: the document with the smallest doc_id that has it owns it, at the first place
where it stands there. In every other document, chunks in a row that one document owns in a row are a run: these bytes
stand in the owner too. The words on either side of a run are compared with the `NEAR` words beside it in its owner, by
64-bit hashes, so a range grows to the last word that both texts have. Ranges that touch and lie alike in the same owner are
one. A range is removed if it has at least `min_words` words: every removed range stands in one other document, word by word.

Owners are asked for the words beside their places only after the runs are known, so what is shuffled is a few
numbers a chunk, the ends of runs, and the texts of documents with a run.

Defined results: all rows and columns are kept and only `text` changes; a null text stays null, a text
without a removal stays as it is byte for byte, and a text that is removed wholly becomes empty. A row with a null
doc_id is kept as it is. Rows with the same doc_id count as one document: they keep what they share. A passage whose every
chunk stands by itself in documents before the first that has the whole passage is found only piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import column, lists, read, saved, slices, spread
from tidemill.llm.textarrays import buffer_of, mix, word_hashes, word_spans

#: Bytes that the rolling hash sees (a power of two), its zero bits at a cut, the least distance of cuts (WINDOW at least), and the places in a row (a power of two) of which one is a cut.
WINDOW, BITS, LEAST, SPAN = 16, 5, 16, 64
#: Words compared on either side of a run.
NEAR = 32
#: A place is a byte of a text, with a hash of the text above it: rows of one doc_id may differ.
_PLACE = 32
_GEAR = np.random.default_rng(77).integers(0, 2**32, 256, dtype=np.uint32)


def _every(least_or_most: np.ufunc, x: np.ndarray, span: int) -> np.ndarray:
    """least_or_most of the `span` numbers (a power of two) from each place on."""
    step = 1
    while step < span:
        x, step = least_or_most(x[:-step], x[step:]), step * 2
    return x


def cuts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the chunks of all texts."""
    h = _GEAR[raw]
    step = 1
    while step < WINDOW:
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h, step = more, step * 2
    n, begins = len(raw), offsets[:-1]
    early = np.zeros(n + 1, np.int32)  # places whose hash would see bytes before their text, or that are too near its start
    np.add.at(early, begins, 1)
    np.add.at(early, np.minimum(begins + LEAST - 1, offsets[1:]), -1)
    early = np.cumsum(early[:-1]) > 0
    h[early] = 2**32 - 1
    chosen = h >> np.uint32(32 - BITS) == 0
    if n >= SPAN:
        low = _every(np.minimum, h, SPAN)  # the least of the places k to k + SPAN - 1
        across = np.zeros(len(low) + 1, np.int32)  # spans that reach over the end of a text
        np.add.at(across, np.maximum(offsets[1:-1] - SPAN + 1, 0), 1)
        np.add.at(across, np.minimum(offsets[1:-1], len(low)), -1)
        low[(np.cumsum(across[:-1]) > 0) | early[: len(low)]] = 0
        around = np.concatenate((np.zeros(SPAN - 1, np.uint32), low, np.zeros(SPAN - 1, np.uint32)))
        chosen |= (_every(np.maximum, around, SPAN) == h) & ~early  # the least of one of the spans it is in
    at, last = [], -LEAST
    for k in (np.flatnonzero(chosen) + 1).tolist():
        if k - last >= LEAST:
            at.append(k)
            last = k
    edges = np.unique(np.concatenate((offsets, np.array(at, np.int64))))
    starts = edges[:-1]
    return starts, edges[1:], np.searchsorted(offsets, starts, "right") - 1


def places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, and the number above the bytes of each text in its places)."""
    raw, offsets = buffer_of(texts)
    return raw, offsets, (word_hashes(raw, offsets[:-1], offsets[1:]) >> np.uint64(34)).astype(np.int64) << _PLACE


class Words:
    """The words of a column of texts: their hashes, and those before and after a byte."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends, self.first = word_spans(raw, offsets)
        self.hashes = word_hashes(raw, self.starts, self.ends)

    def index(self, at: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The first word that starts at the byte or behind it; if `after`, the first that ends behind it."""
        return np.where(after, np.searchsorted(self.ends, at, "right"), np.searchsorted(self.starts, at))

    def beside(self, row: np.ndarray, at: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, whether there is one) of the NEAR words after each byte, or before it, nearest first."""
        step = np.arange(NEAR)
        word = self.index(at, after)[:, None] + np.where(after[:, None], step, -1 - step)
        there = (word >= self.first[row][:, None]) & (word < self.first[row + 1][:, None])
        return np.where(there, self.hashes[np.where(there, word, 0)] if len(self.hashes) else np.uint64(0), np.uint64(0)), there


def _numbered(digest: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The digests, where equal chunks follow each other with their number in a row: a long stretch of one word has owners as long."""
    here = np.arange(len(digest))
    fresh = np.ones(len(digest), bool)
    fresh[1:] = (digest[1:] != digest[:-1]) | (row[1:] != row[:-1])
    nth = (here - np.maximum.accumulate(np.where(fresh, here, 0))).astype(np.uint64)
    return np.where(fresh, digest, mix(digest + nth * np.uint64(0x9E3779B97F4A7C15)))


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        raw, offsets, above = places(column(part, "text"))
        starts, ends, row = cuts(raw, offsets)
        digest = _numbered(word_hashes(raw, starts, ends), row).view(np.int64)
        yield pa.record_batch({"digest": digest, "id": column(part, "doc_id").take(pa.array(row)), "at": above[row] + starts - offsets[row], "size": (ends - starts).astype(np.int32)})


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words beside the wanted ends (2 * place, plus 1 for the words after it) of each text."""
    for part in slices(batches, "text"):
        raw, offsets, above = places(column(part, "text"))
        wanted = column(part, "wanted")
        row = np.repeat(np.arange(part.num_rows), pc.list_value_length(wanted).to_numpy(zero_copy_only=False))
        ends = wanted.flatten().to_numpy(zero_copy_only=False)
        own = (ends >> (_PLACE + 1)) == (above[row] >> _PLACE)
        row, ends = row[own], ends[own]
        words, there = Words(raw, offsets).beside(row, ((ends >> 1) & ((1 << _PLACE) - 1)) + offsets[row], ends & 1 == 1)
        yield pa.record_batch({"owner": column(part, "doc_id").take(pa.array(row)), "end": ends, "words": lists(words[there].view(np.int64), there.sum(1))})


def ranges(texts: pa.Array, ends: pa.Array, min_words: int) -> list[list[tuple[int, int]]]:
    """The byte ranges to remove from each text, in its own bytes, from the ends of its runs with their owners' words."""
    raw, offsets, above = places(texts)
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(ends).to_numpy(zero_copy_only=False))
    ends = ends.flatten()
    place, other, owner = (ends.field(n).to_numpy(zero_copy_only=False) for n in ("place", "end", "owner"))
    many = pc.list_value_length(ends.field("words")).to_numpy(zero_copy_only=False)
    theirs = np.zeros((len(row), NEAR), np.uint64)
    theirs[np.repeat(np.arange(len(row)), many), spread(many)] = ends.field("words").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    own = np.flatnonzero(place >> _PLACE == above[row] >> _PLACE)
    own = own[np.lexsort((other[own] & 1, ends.field("run").to_numpy(zero_copy_only=False)[own], row[own]))]
    row, place, other, owner, theirs, many = row[own], place[own], other[own], owner[own], theirs[own], many[own]
    words, after = Words(raw, offsets), other & 1 == 1
    at = (place & ((1 << _PLACE) - 1)) + offsets[row]
    ours, there = words.beside(row, at, after)
    alike = ((ours == theirs) & there & (np.arange(NEAR) < many[:, None])).cumprod(1).sum(1)
    reach = words.index(at, after) + np.where(after, alike, -alike)
    found: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
    lie = place - (other >> 1)  # alike for ranges that lie alike in one text of the owner
    order = np.lexsort((reach[::2], lie[::2], owner[::2], row[::2]))
    joined: list[list[int]] = []
    for i, o, d, a, b in zip(*(x[order].tolist() for x in (row[::2], owner[::2], lie[::2], reach[::2], reach[1::2])), strict=True):
        if joined and joined[-1][:3] == [i, o, d] and a <= joined[-1][4]:
            joined[-1][4] = max(joined[-1][4], b)
        else:
            joined.append([i, o, d, a, b])
    for i, a, b in sorted((i, a, b) for i, _, _, a, b in joined if b - a >= min_words):
        low, high, offset = int(words.first[i]), int(words.first[i + 1]), int(offsets[i])
        start = int(words.starts[a]) - offset if a > low else 0
        stop = int(words.starts[b]) - offset if b < high else int(offsets[i + 1]) - offset
        if found[i] and start <= found[i][-1][1]:
            found[i][-1] = (found[i][-1][0], max(stop, found[i][-1][1]))
        else:
            found[i].append((start, stop))
    return found


def runs(own: DataFrame) -> DataFrame:
    """(id, run, place, owner, end, words): both ends of every run of chunks that one earlier document has in a row, with the owner's words beside them."""
    chunks = own.mapInArrow(_chunked, "digest long, id long, at long, size int")
    owners = chunks.groupBy("digest").agg(F.min("id").alias("owner"), F.max("id").alias("last")).where("owner < last").select("digest", "owner")
    shared = saved(chunks.join(saved(owners), "digest"))
    first = shared.where("id = owner").groupBy("digest").agg(F.min("at").alias("from"))
    hits = shared.where("id > owner").join(saved(first), "digest").select("id", "at", "size", "owner", "from", F.shiftright("at", _PLACE).alias("row"))
    w = Window.partitionBy("id", "row").orderBy("at")
    hits = hits.withColumn("again", F.lag("at").over(w).eqNullSafe(F.col("at"))).where("not again")  # a repeated row
    on = lambda c: F.lag(c).over(w) + F.lag("size").over(w) == F.col(c)
    hits = hits.withColumn("on", F.coalesce(on("at") & on("from") & (F.lag("owner").over(w) == F.col("owner")), F.lit(False)))
    hits = hits.withColumn("run", F.count_if(~F.col("on")).over(w))
    found = hits.groupBy("id", "row", "run").agg(F.min("at").alias("start"), F.max(F.col("at") + F.col("size")).alias("stop"), F.min("owner").alias("owner"), F.min("from").alias("from"))
    behind = F.col("from") + F.col("stop") - F.col("start")
    both = F.array(F.struct(F.col("start").alias("place"), (F.col("from") * 2).alias("end")), F.struct(F.col("stop").alias("place"), (behind * 2 + 1).alias("end")))
    found = saved(found.select("id", "run", "owner", F.explode(both).alias("b")).select("id", "run", "owner", "b.*"))
    wanted = saved(found.groupBy("owner").agg(F.collect_set("end").alias("wanted")))  # at most two a chunk of the owner
    asked = own.join(wanted, F.col("doc_id") == F.col("owner")).select("doc_id", "text", "wanted")
    words = asked.mapInArrow(_neighbours, "owner long, end long, words array<long>").groupBy("owner", "end").agg(F.first("words").alias("words"))
    return found.join(saved(words), ["owner", "end"])


def deduplicated(docs: DataFrame, min_words: int = 32, spans: str | None = None) -> DataFrame:
    """docs with repeated passages cut out of `text`; with `spans`, also a column of that name: the ranges (start, stop) that went, in bytes of the old text."""
    ends = runs(docs.where("doc_id is not null").select("doc_id", "text"))
    ends = ends.groupBy("id").agg(F.collect_list(F.struct("run", "place", "owner", "end", "words")).alias("_ends"))

    fields = docs.schema.fields
    names = [f"_c{k}" for k in range(len(fields))]
    text, key = names[docs.columns.index("text")], names[docs.columns.index("doc_id")]
    joined = docs.toDF(*names).join(ends, F.col(key) == ends["id"], "left").drop("id")
    out = joined.drop("_ends").schema.add("_spans", T.ArrayType(T.StructType().add("start", "integer").add("stop", "integer")))
    kinds = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            old, gone = column(part, text), {}
            some = np.flatnonzero(column(part, "_ends").is_valid().to_numpy(zero_copy_only=False) & old.is_valid().to_numpy(zero_copy_only=False))
            if len(some):
                take = pa.array(some)
                texts = old.to_pylist()
                for at, cut in zip(some.tolist(), ranges(old.take(take), column(part, "_ends").take(take), min_words), strict=True):
                    if cut:
                        data, kept, last = texts[at].encode(), [], 0
                        for a, b in cut:
                            kept.append(data[last:a])
                            last = b
                        texts[at], gone[at] = b"".join([*kept, data[last:]]).decode(), cut
                old = pa.array(texts, old.type)
            found = pa.array([[{"start": a, "stop": b} for a, b in gone.get(k, ())] for k in range(part.num_rows)], kinds)
            yield pa.record_batch([old if n == text else found if n == "_spans" else column(part, n) for n in out.names], names=out.names)

    done = joined.mapInArrow(cleaned, out)
    return done.select(*(F.col(n).alias(f.name) for n, f in zip(names, fields, strict=True)), *([F.col("_spans").alias(spans)] if spans else []))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text"), spans="spans")
    return out.select("doc_id", "text", "spans", F.size("spans").alias("n_spans"))
