"""The registered queries that SQL cannot express, over whole tables of a folder, against brute force."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from conftest import SCHEMA
from test_jaccard_join import brute
from test_mixing import poured
from test_packing import PATH, checked
from tidemill.llm.queries import QUERIES


@pytest.fixture(scope="module")
def folder(spark, docs, corpus, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    docs.write.parquet(str(root / "documents.parquet"))
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[100:250] = x[100]  # a hot vector
    x[300:350] = 2 * x[301]  # the same direction, but for rounding
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    rows += [(700, [0.0] * 16, 1), (701, None, 1), (702, [None] + [1.0] * 15, 1), (750, [float("nan")] * 16, 1), (703, [float("inf")] * 16, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(str(root / "embeddings.parquet"))
    return root, x.astype(float)


@pytest.fixture(scope="module")
def blank(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("blank")
    spark.createDataFrame([], SCHEMA).write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(root / "embeddings.parquet"))
    return root


def words(t):
    return re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())


def test_op2_sizes_targets_and_words_taken(spark, folder, corpus):
    got = QUERIES["op2_source_mixing"](spark, str(folder[0])).collect()
    sizes = defaultdict(int)
    for r in corpus:
        sizes[r[3]] += len(words(r[1]))
    want = poured(sizes, (5, 2, 1), 3)
    known = {r[0]: (len(words(r[1])), sizes[r[3]], want[r[3]]) for r in corpus if r[0] is not None}
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == sorted(r[0] for r in corpus if r[0] is not None) and len(got) == len(corpus)
    taken = defaultdict(int)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["size"], r["source_size"]) == known[r["doc_id"]][:2] and r["target"] == pytest.approx(known[r["doc_id"]][2])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source_size"]] += r["taken"]
    assert len(set(sizes.values())) == len(sizes)  # so that a size names its source
    for source, size in sizes.items():
        base, sums = int(want[source] // size) * size, 1  # all documents so often, and the nearest of all sums of some of them
        for r in corpus:
            if r[3] == source and base < 3 * size:
                sums |= sums << len(words(r[1]))
        near = min(abs(base + k - want[source]) for k in range(sums.bit_length()) if sums >> k & 1)
        # The same part of every length is taken before the program, so a sum may be missed by little.
        assert near - 1e-6 <= abs(taken[size] - want[source]) <= near + 0.001 * want[source], source
    again = QUERIES["op2_source_mixing"](spark, str(folder[0])).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_op3_every_id_lies_in_one_piece(spark, folder, corpus):
    tokenizer = Tokenizer.from_file(PATH)
    everything = QUERIES["op3_sequence_packing"](spark, str(folder[0])).collect()
    assert {r["doc_id"] for r in everything} == {r[0] for r in corpus}
    total = sum(len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in corpus)
    assert sum(r["length"] for r in everything) == total
    texts = {r[0]: r[1] for r in corpus}
    # Rows without an id are two documents under one key: they are told apart by their number of tokens.
    nulls = {len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1: r[1] for r in corpus if r[0] is None}
    rows = [{**r.asDict(), "doc_id": r["doc_id"] if r["doc_id"] is not None else ("null", r["doc_tokens"])} for r in everything]
    checked(rows, texts | {("null", n): t for n, t in nulls.items()}, tokenizer)


def test_op5_components_are_those_of_all_pairs(spark, folder, corpus):
    got = QUERIES["op5_ngram_jaccard_join"](spark, str(folder[0])).where("doc_id is not null").collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute([(r[0], r[1]) for r in corpus], 3, 90)


def test_op6_scores_ranks_and_recall(spark, folder):
    root, x = folder
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    got = defaultdict(list)
    for r in QUERIES["op6_vector_tree"](spark, str(root)).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 700, 50))
    found = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == [1, 2, 3, 4, 5] and q not in [r[1] for r in rows] and len({r[1] for r in rows}) == 5
        for _, v, score in rows:
            assert score == pytest.approx(float((x[q] * x[v]).sum() / (np.sqrt((x[q] ** 2).sum()) * np.sqrt((x[v] ** 2).sum()))), abs=1e-12)
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        score = unit @ unit[q]
        score[q] = -2
        fifth = np.sort(score)[-5]
        found += sum(s >= fifth - 1e-9 for _, _, s in rows)
    assert found >= 0.9 * 5 * len(got)


def test_op9_what_went_repeats_and_what_repeats_went(spark, folder, corpus):
    old = {r[0]: r[1] for r in corpus if r[0] is not None}
    got = {r["doc_id"]: r for r in QUERIES["op9_substring_dedup"](spark, str(folder[0])).collect() if r["doc_id"] is not None}
    assert set(got) == set(old)

    def windows(t, n):
        w = words(t)
        return [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]

    homes = defaultdict(set)  # the documents of each window of 32 words
    for i, t in old.items():
        for x in windows(t, 32):
            homes[x].add(i)
    for i, r in got.items():
        data, out, last = (old[i] or "").encode(), [], 0
        for g in r["spans"]:
            out.append(data[last : g["start"]])
            last = g["stop"]
        assert b"".join([*out, data[last:]]).decode() == (r["text"] or ""), i
        at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", data)]
        repeats = np.zeros(len(at) + 1, bool)
        for k, x in enumerate(windows(old[i], 32)):
            if len(homes[x]) > 1:
                repeats[k : k + 32] = True
        for g in r["spans"]:
            inside = [k for k, (a, b) in enumerate(at) if a < g["stop"] and b > g["start"]]
            assert repeats[inside].all(), i
    left = defaultdict(set)
    for i, r in got.items():
        for x in windows(r["text"], 50):
            left[x].add(i)
    assert all(len(x) == 1 for x in left.values())
    assert any(r["spans"] for r in got.values())


@pytest.mark.parametrize("name", [k for k in QUERIES if k.split("_")[0] in ("op1", "op2", "op3", "op4", "op5", "op6", "op9")])
def test_empty_tables_give_empty_results(spark, blank, name):
    assert QUERIES[name](spark, str(blank)).count() == 0
