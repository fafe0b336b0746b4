"""Packing documents into sequences by cutting-stock column generation.

A document's ids (and a closing id) are cut into pieces of whole sequences, one piece that is a
multiple of `grain`, and one shorter than `grain`; so a histogram of all pieces has few lengths
however many documents there are. On that histogram a linear program chooses patterns, multisets of
lengths that fill a sequence exactly. Patterns are columns: the simplex prices them by a knapsack
dynamic program over the duals. The fractional solution is rounded down, then up while pieces last,
then more exact patterns are sought among what is left by a bounded knapsack. Pieces of one length
are ranked by a seeded hash and the ranks are dealt to the patterns' places. The few pieces that no
pattern takes are cut at powers of two, which fill sequences without a gap; so no sequence is padded:
each has `length` ids or a power of two.

The driver holds the histogram, the patterns and the place table: at most length / grain + grain
lengths, and as many patterns. Texts are tokenized once, word by word through a bounded memo, which
gives the whole text's ids because the tokenizer drops white space and never merges across it.

Defined results: a null or empty text is the closing id alone; rows with the same doc_id are
documents of their own; an empty table gives an empty result. Other columns are ignored by `pack`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import column, ranked, read, saved, slices, spread, subset_sum
from tidemill.llm.textarrays import buffer_of, word_hashes, word_spans

#: Words whose ids a worker remembers (20 bytes each in the table, and their ids).
MEMO = 1 << 20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[44, 46]] = True


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Table:
    """A hash table from 64-bit keys to numbers, searched and filled for whole vectors at once."""

    def __init__(self, most: int):
        self.mask = np.uint64((1 << (2 * most - 1).bit_length()) - 1)
        self.keys, self.values = np.zeros(int(self.mask) + 1, np.uint64), np.zeros(int(self.mask) + 1, np.int32)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of the keys, -1 where there is none."""
        out, at, left = np.full(len(keys), -1, np.int32), keys & self.mask, np.arange(len(keys))
        while len(left):
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (there != 0)
            left, at = left[on], (at[on] + np.uint64(1)) & self.mask
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that are not yet in the table."""
        at = keys & self.mask
        while len(keys):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[free]
            won = free & (self.keys[at] == keys)
            self.values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + np.uint64(1)) & self.mask


class WordTokenizer:
    """Ids of texts by a tokenizer that lower-cases, drops white space, and never merges across it.

    Words are found and hashed for a whole column at once; each is encoded when it is first met. A
    full stop or comma between a letter and white space is a word of its own, as it is for the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.closes = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.closes[[k for word, k in self.tokenizer.get_vocab().items() if word.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.table, self.ids, self.starts, self.sizes, self.words, self.used = Table(MEMO), np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0, 0

    def _add(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while self.words + len(keys) > len(self.starts):
            self.starts, self.sizes = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.sizes))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[self.words : self.words + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.words : self.words + len(keys)] = sizes
        self.table.put(keys, np.arange(self.words, self.words + len(keys), dtype=np.int32))
        self.words, self.used = self.words + len(keys), self.used + len(ids)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        plain = np.array([w.isalpha() for w in words])
        odd = np.flatnonzero(~plain).tolist()
        plain = np.flatnonzero(plain)
        for k in range(0, len(plain), 512):
            part = plain[k : k + 512]
            ids = np.array(self.tokenizer.encode(" ".join([words[i] for i in part.tolist()]), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids])
            if len(ends) == len(part):  # one piece for each word
                self._add(keys[part], ids, np.diff(ends, prepend=-1))
            else:
                odd += part.tolist()
        for k in range(0, len(odd), 512):
            part = odd[k : k + 512]
            found = [x.ids for x in self.tokenizer.encode_batch([words[i] for i in part], add_special_tokens=False)]
            self._add(keys[part], np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each text has)."""
        raw, offsets = buffer_of(texts)
        starts, ends, first = word_spans(raw, offsets)
        if len(starts) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        tail = ends - 1
        one, two = raw[np.maximum(tail - 1, 0)], raw[np.maximum(tail - 2, 0)]
        letter = _LETTER[one] | ((two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7) & (ends - starts > 2))
        mark = np.flatnonzero(_MARK[raw[tail]] & (ends - starts > 1) & letter)
        first = first + np.searchsorted(mark, first)
        starts, ends = np.insert(starts, mark + 1, tail[mark]), np.insert(ends, mark, tail[mark])
        keys = word_hashes(raw, starts, ends, lower=True) | np.uint64(1)
        at = self.table.get(keys)
        if (at < 0).any():
            new, where = np.unique(keys[at < 0], return_index=True)
            if self.words + len(new) > MEMO:
                self.clear()
                new, where = np.unique(keys, return_index=True)
            else:
                where = np.flatnonzero(at < 0)[where]
            spans = zip(starts[where].tolist(), ends[where].tolist(), strict=True)
            data = raw.tobytes()
            self._learn(new, [data[a:b].decode() for a, b in spans])
            at = self.table.get(keys)
        size = self.sizes[at].astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(size)))[first]
        return self.ids[np.repeat(self.starts[at], size) + spread(size)], np.diff(ends)


_KEPT: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    """The worker's tokenizer of that file: what it has learnt serves its later tasks too."""
    if path not in _KEPT:
        _KEPT[path] = WordTokenizer(path)
    return _KEPT[path]


def _cut(ids: np.ndarray, length: int, grain: int) -> list[tuple[int, int, int, list[int]]]:
    """(start, length, crc, crcs of its powers of two from the largest) of a document's pieces."""
    crc = lambda a, b: zlib.crc32(memoryview(ids[a:b]))
    whole = len(ids) // length * length
    out = [(a, length, crc(a, a + length), []) for a in range(0, whole, length)]
    for size in ((len(ids) - whole) // grain * grain, (len(ids) - whole) % grain):
        if size:
            parts, at = [], whole
            for bit in range(size.bit_length() - 1, -1, -1):
                if size >> bit & 1:
                    parts.append(crc(at, at + (1 << bit)))
                    at += 1 << bit
            out.append((whole, size, crc(whole, whole + size), parts))
            whole += size
    return out


def pieces(docs: DataFrame, tokenizer: str, closing: int, length: int, grain: int) -> DataFrame:
    """(doc_id, doc_tokens, start, length, crc, parts) of all pieces of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer_of(tokenizer)
        for part in slices(batches, "text"):
            ids, counts = own.encode(column(part, "text"))
            rows, at, which, size = [], 0, [], []
            for i, n in enumerate(counts.tolist()):
                found = _cut(np.append(ids[at : at + n], np.uint32(closing)).astype("<u4"), length, grain)
                at += n
                rows += found
                which += [i] * len(found)
                size += [n + 1] * len(found)
            start, long, crc, parts = zip(*rows, strict=True)
            yield pa.record_batch({"doc_id": column(part, "doc_id").take(pa.array(which)), "doc_tokens": pa.array(size, pa.int64()), "start": pa.array(start, pa.int64()), "length": pa.array(long, pa.int64()), "crc": pa.array(crc, pa.int64()), "parts": pa.array(parts, pa.list_(pa.int64()))})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, doc_tokens long, start long, length long, crc long, parts array<long>")


def _priced(lengths: np.ndarray, price: np.ndarray, total: int) -> tuple[float, np.ndarray]:
    """The cheapest multiset of lengths with exactly this total, by dynamic program, and its price."""
    best, last = np.full(total + 1, np.inf), np.full(total + 1, -1)
    best[0] = 0
    for c in range(1, total + 1):
        k = int(np.searchsorted(lengths, c, "right"))
        if k:
            costs = best[c - lengths[:k]] + price[:k]
            last[c] = j = int(np.argmin(costs))
            best[c] = costs[j]
    pattern, c = np.zeros(len(lengths), np.int64), total
    while c > 0 and np.isfinite(best[total]):
        pattern[last[c]] += 1
        c -= int(lengths[last[c]])
    return float(best[total]), pattern


def patterns(lengths: np.ndarray, counts: np.ndarray, total: int, rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """Exact patterns and how often each is used; no length is used more than counts allow.

    Maximises the number of exact sequences. Rows are lengths (ascending), the first basis is all slack, columns
    enter by the priced knapsack. `rounds` ends a stalling simplex: then the rounding starts from a feasible point.
    """
    m = len(lengths)
    if m == 0 or (counts * lengths).sum() < total:
        return []
    scale = float(counts.sum())
    columns: list[np.ndarray | None] = [None] * m  # None: a slack
    inverse, x, gain = np.eye(m), counts / scale, np.zeros(m)
    for step in range(rounds):
        price = gain @ inverse
        slack = int(np.argmin(price))
        cost, pattern = _priced(lengths, np.maximum(price, 0.0), total)
        if 1 - cost > 1e-7:
            entering, column_, value = inverse @ pattern, pattern, 1.0
        elif price[slack] < -1e-9:
            entering, column_, value = inverse[:, slack].copy(), None, 0.0
        else:
            break
        able = entering > 1e-9
        if not able.any():
            break
        ratio = np.where(able, x / np.where(able, entering, 1), np.inf)
        out = int(np.argmin(ratio))
        far = ratio[out]
        x = np.maximum(x - far * entering, 0)
        x[out] = far
        inverse[out] /= entering[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(entering[others], inverse[out])
        columns[out], gain[out] = column_, value
        if column_ is None:
            columns[out] = None
    used = [(c, v * scale) for c, v in zip(columns, x, strict=True) if c is not None and v > 0]
    left, result = counts.copy(), []
    for pattern, v in sorted(used, key=lambda u: -(u[1] % 1)):
        n = int(v + 1e-6)
        n = min(n, int((left[pattern > 0] // pattern[pattern > 0]).min()))
        left -= n * pattern
        result.append([pattern, n])
    for pair in result:
        if (left >= pair[0]).all():
            left -= pair[0]
            pair[1] += 1
    while (left * lengths).sum() >= total:
        some = np.flatnonzero(left)[::-1]
        pattern = np.zeros(m, np.int64)
        pattern[some] = subset_sum(lengths[some], left[some], total)
        if int((pattern * lengths).sum()) != total:
            break
        n = int((left[pattern > 0] // pattern[pattern > 0]).min())
        left -= n * pattern
        result.append([pattern, n])
    return [(p, n) for p, n in result if n]


def _places(lengths: np.ndarray, counts: np.ndarray, total: int) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """From the histogram: (length, from rank, to rank, first sequence, a sequence, offset) of pattern places,
    (length, from rank, bit, first position, size) of powers of two, (from, to, sequence) of position ranges that these fill."""
    full = dict(zip(lengths.tolist(), counts.tolist(), strict=True)).get(total, 0)
    inner = lengths < total
    lengths, counts = lengths[inner], counts[inner]
    places, sequence, rank = [(total, 0, full, 0, 1, 0)], full, np.zeros(len(lengths), np.int64)
    for pattern, n in patterns(lengths, counts, total):
        offset = 0
        for i in np.flatnonzero(pattern)[::-1].tolist():
            a, size = int(pattern[i]), int(lengths[i])
            places.append((size, int(rank[i]), int(rank[i]) + a * n, sequence, a, offset))
            rank[i] += a * n
            offset += a * size
        sequence += n
    rest, bits, position = counts - rank, [], 0
    for bit in range(total.bit_length() - 1, -1, -1):
        for i, size in enumerate(lengths.tolist()):
            if size >> bit & 1 and rest[i]:
                bits.append((size, int(rank[i]), bit, position, 1 << bit))
                position += int(rest[i]) << bit
    ranges, at = [], position // total * total
    for bit in range(total.bit_length() - 1, -1, -1):
        if position - at >= 1 << bit:
            ranges.append((at, at + (1 << bit), sequence + position // total + len(ranges)))
            at += 1 << bit
    return places, bits, [(0, position // total * total, sequence), *ranges]


def pack(docs: DataFrame, tokenizer: str, closing: int = 1, length: int = 2048, grain: int = 64, seed: int = 7) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    spark = docs.sparkSession
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    cut = saved(pieces(docs, tokenizer, closing, length, grain).withColumn("h", F.xxhash64("doc_id", "start", "crc", "doc_tokens", F.lit(seed))))
    count = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # length / grain + grain rows at most
    sizes = np.array(sorted(count), np.int64)
    places, bits, ranges = _places(sizes, np.array([count[s] for s in sizes.tolist()], np.int64), length)
    items = ranked(cut, ["length"], "h", ["doc_id", "start", "crc", "doc_tokens", "parts"])  # rows alike in all of these are the same piece
    place = spark.createDataFrame(places, "length_ long, low long, high long, first long, many long, at long")
    items = items.join(F.broadcast(place), (F.col("length") == F.col("length_")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left")
    k = F.col("rank") - F.col("low")
    whole = F.struct("start", "length", "crc", (F.col("first") + F.floor(k / F.col("many"))).alias("sequence"), (F.col("at") + k % F.col("many") * F.col("length")).alias("offset"))
    out = items.where("low is not null").select("doc_id", "doc_tokens", whole.alias("p"))
    if bits:
        # A place in the list of positions; the last positions fill ever smaller powers of two.
        bit = spark.createDataFrame(bits, "length_ long, low_ long, bit int, first_ long, size_ long")
        left = items.where("low is null").drop("length_").join(F.broadcast(bit), F.col("length") == F.col("length_"))
        where = F.col("first_") + (F.col("rank") - F.col("low_")) * F.col("size_")
        above = F.col("length") - F.col("length") % (2 * F.col("size_"))
        nth = F.expr("bit_count(shiftright(length, bit))")
        sequence, offset = F.lit(None).cast("long"), F.lit(None).cast("long")
        for a, b, s in ranges[1:]:
            sequence, offset = F.when((where >= a) & (where < b), F.lit(s)).otherwise(sequence), F.when((where >= a) & (where < b), where - a).otherwise(offset)
        a, b, s = ranges[0]
        sequence, offset = F.when(where < b, s + F.floor(where / length)).otherwise(sequence), F.when(where < b, where % length).otherwise(offset)
        part = F.struct((F.col("start") + above).alias("start"), F.col("size_").alias("length"), F.element_at("parts", nth.cast("int")).alias("crc"), sequence.alias("sequence"), offset.alias("offset"))
        out = out.union(left.select("doc_id", "doc_tokens", part.alias("p")))
    return out.select("doc_id", F.col("p.start").alias("start"), F.col("p.length").alias("length"), F.col("p.crc").alias("ids_crc32"), "doc_tokens", F.col("p.sequence").alias("sequence_id"), F.col("p.offset").alias("offset"))


def op3_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), default_tokenizer())
