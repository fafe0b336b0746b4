"""N-gram Jaccard join by grouped prefixes, and the classes of near-duplicate documents.

A document is the set of its distinct word shingles. Two documents link when
100 * |A & B| >= percent * |A | B|; the result gives the connected components of these links.

1. Shingles get one global order, rarest first as far as counts of bounded size tell: the
   commonest words of all documents give each shingle a rarity, and shingles found in very many
   documents' prefixes go last. The order decides speed only; any order gives the same links.
2. Of documents that link, the first |A| - ceil(percent * |A| / 100) + 1 shingles (the prefix)
   share one. Equal sets fold into one class first; classes with the same size and the same prefix
   fold into one group, and only groups are looked up by shingle.
3. In a short list of groups that share a shingle all pairs of groups are formed; in a long list each group is
   paired with one pivot, the one whose prefix holds the fewest shingles of its own. Only pairs of groups that pass the size and
   position filter are expanded, into pairs of members, or into members and the pivot's first member.
4. Of the members' pairs, those stay whose sketches allow a link. A sketch holds the parity of the set's shingles in each
   of `PARTS` parts; a part of different parity has a shingle that only one of two sets has, so no link is
   lost. What is left is verified by the intersection of the whole sets, in the JVM.
5. Links with pivots give first components. Of a long list whose members are in several, those outside its
   largest component are held against the others of the list by size, position and sketch, and what passes is verified.
   Pairs in one component are never written out, nor are pairs of templates that share much and do not link: a
   group of n near copies costs n verifications rather than n * n.

Defined results: a null or wordless text has n_shingles 0 and is its own component. Rows with
the same doc_id count as one document: their components join. A row with a null doc_id takes the component of a
row with an equal set, or null if there is none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import column, components, lists, read, saved, slices, spread, work_folder
from tidemill.llm.textarrays import buffer_of, mix, shingles, word_hashes, word_spans

#: Words whose counts are kept, and shingles that may be marked as frequent: both bound what is broadcast (8 bytes each).
WORDS, FREQUENT = 1 << 16, 1 << 19
#: Rows of numbers up to so many bytes are broadcast to pick documents; more are joined by shuffle.
BROADCAST = 16 << 20
#: A shingle in more prefixes than this is frequent; a list of more documents than LONG is compared with pivots first.
OFTEN, LONG = 24, 8
#: Parts of a sketch (a bit each), and the rows of one pivot and shingle that one task compares with all others of it.
PARTS, SALTED = 1024, 4096
_HASH = np.uint64((1 << 58) - 1)
#: The bits of a key by which frequent shingles are counted and marked: a shorter key takes less of the shuffle.
_SHORT = np.uint64((1 << 40) - 1)


def prefix_length(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def _common_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", 4 << 20):
        raw, at = buffer_of(column(part, "text"))
        starts, ends, _ = word_spans(raw, at)
        w, c = np.unique(word_hashes(raw, starts, ends, lower=True), return_counts=True)
        some = c > 3
        yield pa.record_batch({"word": w[some].view(np.int64), "n": c[some].astype(np.int64)})


class ShingleOrder:
    """Turns texts into sorted shingle keys: frequent (1 bit), commonness of the words (5 bits), hash (58 bits)."""

    def __init__(self, width: int, percent: int, words: np.ndarray, counts: np.ndarray, frequent: np.ndarray):
        order = np.argsort(words)
        self.width, self.percent, self.words, self.frequent = width, percent, words[order], frequent
        self.level = np.floor(np.log2(np.maximum(counts[order], 1))).astype(np.uint64)

    def sets(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(keys, sizes): each row's distinct keys in ascending order, and how many there are."""
        raw, at = buffer_of(texts)
        starts, ends, first = word_spans(raw, at)
        words = word_hashes(raw, starts, ends, lower=True)
        keys, row = shingles(words, first, self.width)
        level = np.zeros(len(words) + self.width, np.uint64)
        if len(self.words) and len(words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            level[: len(words)] = np.where(self.words[at] == words, self.level[at], 0)
        counts = np.diff(first)
        n = np.where(counts >= self.width, counts - self.width + 1, np.minimum(counts, 1))
        where = np.repeat(first[:-1], n) + spread(n)
        size = np.minimum(counts, self.width)[row]
        common = sum(np.where(size > k, level[where + k], 0).astype(np.uint64) for k in range(self.width))
        common = np.minimum(common * np.uint64(3) // np.uint64(2 * self.width), np.uint64(31)).astype(np.uint64)
        keys = (keys & _HASH) | (common << np.uint64(58))
        if len(self.frequent) and len(keys):
            short = keys & _SHORT
            at = np.minimum(np.searchsorted(self.frequent, short), len(self.frequent) - 1)
            keys = np.where(self.frequent[at] == short, keys | np.uint64(1 << 63), keys)
        order = np.argsort(keys)
        order = order[np.argsort(row[order].astype(np.uint16) if len(counts) < 65536 else row[order], kind="stable")]
        keys, row = keys[order], row[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
        return keys[new], np.bincount(row[new], minlength=len(counts))

    def heads(self, keys: np.ndarray, sizes: np.ndarray, times: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """The first keys of each row, `times` prefixes long."""
        most = np.where(sizes > 0, np.minimum(sizes, times * prefix_length(sizes, self.percent)), 0)
        return keys[np.repeat(np.cumsum(sizes) - sizes, most) + spread(most)], most


def _fit(docs: DataFrame, width: int, percent: int) -> ShingleOrder:
    words = docs.select("text").mapInArrow(_common_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = words.orderBy(F.desc("n"), "word").limit(WORDS).toArrow()
    first = ShingleOrder(width, percent, words["word"].to_numpy().view(np.uint64), words["n"].to_numpy(), np.zeros(0, np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast(first)

    def seen(batches):
        for part in slices(batches, "text", 4 << 20):
            keys, _ = shared.value.heads(*shared.value.sets(column(part, "text")), times=2)
            keys, n = np.unique(keys & _SHORT, return_counts=True)
            yield pa.record_batch({"key": keys.view(np.int64), "n": n.astype(np.int32)})

    keys = docs.select("text").mapInArrow(seen, "key long, n int").groupBy("key").agg(F.sum("n").alias("n"))
    keys = keys.where(F.col("n") > OFTEN).orderBy(F.desc("n"), "key").limit(FREQUENT).select("key").toArrow()
    return ShingleOrder(width, percent, first.words, np.exp2(first.level.astype(float)), np.sort(keys["key"].to_numpy().view(np.uint64)))


def sketches(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per row the parity of its keys in each of PARTS parts, as 64-bit numbers."""
    part = np.repeat(np.arange(len(sizes)), sizes) * PARTS + (mix(keys) & np.uint64(PARTS - 1)).astype(np.int64)
    odd = (np.bincount(part, minlength=len(sizes) * PARTS) & 1).astype(bool)
    return np.packbits(odd, bitorder="little").view(np.int64).reshape(len(sizes), PARTS // 64)


def picked(rows: DataFrame) -> DataFrame:
    """rows (of numbers alone; a saved table) with a broadcast hint if they are at most BROADCAST bytes."""
    return F.broadcast(rows) if rows.count() * 8 * len(rows.columns) <= BROADCAST else rows


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    work_folder(spark)
    order = spark.sparkContext.broadcast(_fit(docs, width, percent))

    def described(batches):
        for part in slices(batches, "text"):
            keys, sizes = order.value.sets(column(part, "text"))
            head, most = order.value.heads(keys, sizes)
            ends = np.cumsum(sizes)
            digest = []
            for salt in (1, 2):
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(keys + np.uint64(salt)), dtype=np.uint64)))
                digest.append((total[ends] - total[ends - sizes]).view(np.int64))
            listed = lists(sketches(keys, sizes).ravel(), np.full(len(sizes), PARTS // 64))
            yield pa.record_batch({"doc_id": column(part, "doc_id"), "n": sizes.astype(np.int64), "d1": digest[0], "d2": digest[1], "prefix": lists(head.view(np.int64), most), "bits": listed})

    def whole(batches):
        for part in slices(batches, "text"):
            keys, sizes = order.value.sets(column(part, "text"))
            yield pa.record_batch({"id": column(part, "doc_id"), "keys": lists(keys.view(np.int64), sizes)})

    base = docs.mapInArrow(described, "doc_id long, n long, d1 long, d2 long, prefix array<long>, bits array<long>")
    base = saved(base.withColumn("p1", F.xxhash64("prefix")).withColumn("p2", F.hash("prefix")))
    some = base.where("n > 0 and doc_id is not null")
    classes = saved(base.where("n > 0").groupBy("n", "d1", "d2", "p1", "p2").agg(F.min("doc_id").alias("id")).where("id is not null"))
    groups = saved(classes.groupBy("n", "p1", "p2").agg(F.min("id").alias("gid"), F.count("*").alias("members")))
    members = classes.join(groups.select("n", "p1", "p2", "gid"), ["n", "p1", "p2"]).select("gid", "id").distinct()
    members = saved(members)

    # Lists of groups by the shingles of their prefixes.
    heads = some.select("n", "p1", "p2", F.col("doc_id").alias("gid"), "prefix").join(picked(groups), ["n", "p1", "p2", "gid"])
    tokens = heads.select("gid", "n", "members", F.posexplode("prefix").alias("pos", "token"))
    counts = tokens.groupBy("token").agg(F.sum("members").alias("total")).where("total > 1")
    tokens = saved(tokens.drop("members").join(saved(counts), "token"))
    alone = tokens.groupBy("gid").agg((F.expr(f"max(n) - (max({percent} * n) + 99) div 100 + 1") - F.count("*")).alias("alone"))

    of_group = tokens.select("gid").distinct()
    members = saved(members.join(of_group, "gid").join(some.select(F.col("doc_id").alias("id"), "n", "bits").dropDuplicates(["id", "n", "bits"]), "id"))

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose whole sets link."""
        ids = saved(pairs.select("a").union(pairs.select("b")).distinct().select(F.col("a").alias("id")))
        own = docs.join(picked(ids), docs["doc_id"] == ids["id"], "left_semi")
        sets = own.mapInArrow(whole, "id long, keys array<long>")  # one exchange by id serves both joins
        one, two = sets.select(F.col("id").alias("a"), F.col("keys").alias("of_a")), sets.select(F.col("id").alias("b"), F.col("keys").alias("of_b"))
        out = pairs.join(one, "a").join(two, "b")
        out = out.select("a", "b", F.size("of_a").alias("n"), F.size("of_b").alias("m"), F.size(F.array_intersect("of_a", "of_b")).alias("same"))
        return saved(out.where(f"100 * same >= {percent} * (n + m - same)").select("a", "b"))

    # Pairs of groups that the filters leave, then their members.
    fits = _may_link(percent, "n", "pos", "n_o", "pos_o")
    short = tokens.where(F.col("total") <= LONG).select("token", "gid", "n", "pos")
    near = short.join(_other(short, "gid", "n", "pos"), "token").where("gid > gid_o").where(fits)
    twins = groups.where(f"members > 1 and members <= {LONG} and {100 + percent} * (n - 1) >= {2 * percent} * n")
    near = near.select("gid", "gid_o").union(twins.select("gid", F.col("gid").alias("gid_o")))
    long = saved(tokens.where(F.col("total") > LONG).select("token", "gid", "n", "pos"))
    pivots = long.join(saved(alone), "gid").groupBy("token").agg(F.min(F.struct("alone", "n", "gid", "pos")).alias("pivot"))
    star = long.join(saved(pivots.select("token", F.col("pivot.gid").alias("gid_o"), F.col("pivot.n").alias("n_o"), F.col("pivot.pos").alias("pos_o"))), "token").where(fits)
    pairs = saved(near.select("gid", "gid_o", F.lit(0).alias("star")).union(star.select("gid", "gid_o", F.lit(1).alias("star"))).groupBy("gid", "gid_o").agg(F.max("star").alias("star")))
    other = members.select(F.col("gid").alias("gid_o"), *(F.col(c).alias(f"{c}_o") for c in ("id", "n", "bits")))
    inner = pairs.join(members, "gid").join(other, "gid_o").where("id <> id_o and (if(star = 1, id_o = gid_o, gid <> gid_o or id > id_o))").where(_may_differ(percent))
    tried = saved(inner.select(F.greatest("id", "id_o").alias("a"), F.least("id", "id_o").alias("b")).distinct())
    links = linked(tried)
    so_far = saved(components(links))

    # Of long lists the pairs of members that may link although they are not yet in one component.
    rows = long.join(members.select("gid", "id"), "gid").join(so_far, F.col("id") == F.col("node"), "left")
    rows = saved(rows.select("token", "id", "n", "pos", F.coalesce("component", "id").alias("part")))
    parts = rows.groupBy("token", "part").agg(F.count("*").alias("many")).groupBy("token")
    parts = parts.agg(F.sum("many").alias("many"), F.max(F.struct("many", "part")).alias("most"), F.count("*").alias("parts"))
    parts = saved(parts.where("parts > 1").select("token", "many", F.col("most.part").alias("main")))
    rows = saved(rows.join(parts, "token").join(members.select("id", "n", "bits"), ["id", "n"]))
    lone = rows.where("part <> main")
    rest = _salted(lone, rows, ["token"], ("id", "n", "pos", "part", "bits"))
    rest = rest.where("part <> part_o and (part_o = main or id > id_o)").where(fits).where(_may_differ(percent))
    rest = rest.select(F.greatest("id", "id_o").alias("a"), F.least("id", "id_o").alias("b")).distinct()
    rest = saved(rest.join(tried, ["a", "b"], "left_anti"))
    final = so_far if rest.isEmpty() else components(links.union(linked(rest)))

    classes = classes.select("n", "d1", "d2", "id").join(final, F.col("id") == F.col("node"), "left").select("n", "d1", "d2", F.coalesce("component", "id").alias("component"))
    out = base.select("doc_id", "n", "d1", "d2").join(saved(classes), ["n", "d1", "d2"], "left")
    out = saved(out.select("doc_id", "n", F.coalesce("component", "doc_id").alias("component")))
    # A doc_id whose rows are in several components joins them.
    several = out.where("doc_id is not null").groupBy("doc_id").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    several = saved(several.select("doc_id", "low"))
    if not several.isEmpty():
        joins = out.join(several, "doc_id").select(F.col("component").alias("a"), F.col("low").alias("b"))
        roots = saved(components(joins))
        out = out.join(roots, out["component"] == roots["node"], "left").select("doc_id", "n", F.coalesce(roots["component"], out["component"]).alias("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _other(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select("token", *(F.col(c).alias(f"{c}_o") for c in columns))


def _salted(left: DataFrame, right: DataFrame, keys: list[str], columns: tuple[str, ...]) -> DataFrame:
    """left joined with right (its `columns` named with _o) on the keys; `many`, the rows of a key, says over how many tasks the left side of a hot key is dealt."""
    salts = F.ceil(F.col("many") / SALTED).cast("int")
    left = left.withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int"))
    right = right.select(*keys, *(F.col(c).alias(f"{c}_o") for c in columns), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    return left.join(right, [*keys, "salt"])


def distinct_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near duplicates, that of the smallest doc_id; all columns stay.

    Rows with a null doc_id are kept as they are. Of rows with the same doc_id one stays.
    """
    found = saved(near_duplicates(docs, width, percent))

    def without(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        return rows.join(picked(ids), rows["doc_id"] == ids["_id"], how)

    gone = saved(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct())
    kept = without(docs, gone, "left_anti")
    twice = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("n")).where("n > 1").select("_id")
    twice = saved(twice)
    if twice.isEmpty():
        return kept
    return without(kept, twice, "left_anti").union(without(kept, twice, "left_semi").dropDuplicates(["doc_id"]))


def _may_differ(percent: int) -> str:
    """Whether sketches differ in no more parts than sets of these sizes that link can."""
    differ = " + ".join(f"bit_count(bits[{k}] ^ bits_o[{k}])" for k in range(PARTS // 64))
    most = f"n + n_o - 2 * (({percent} * (n + n_o) + {99 + percent}) div {100 + percent})"
    return f"100 * least(n, n_o) >= {percent} * greatest(n, n_o) and {differ} <= {most}"


def _may_link(percent: int, n1: str, p1: str, n2: str, p2: str) -> str:
    """Size and position filter: the overlap that sets of n1 and n2 need, and the most they can have if they share the keys at p1 and p2."""
    size = f"100 * least({n1}, {n2}) >= {percent} * greatest({n1}, {n2})"
    most = f"least({p1}, {p2}) + 1 + least({n1} - {p1} - 1, {n2} - {p2} - 1)"
    return f"{size} and {100 + percent} * ({most}) >= {percent} * ({n1} + {n2})"


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), width=3, percent=90)
