from __future__ import annotations

import random

import pytest

from conftest import text
from tidemill.llm import jaccard_join as j

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingled(t, width):
    w = (t or "").encode().translate(LOWER).split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, width, percent):
    """Component of each row with an id, by comparing all pairs."""
    sets = [(i, shingled(t, width)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for k, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(k)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80), (1, 50)])
def test_components_are_those_of_all_pairs(docs, corpus, width, percent):
    got = j.near_duplicates(docs, width, percent).where("doc_id is not null").collect()
    assert sorted(map(tuple, got)) == brute([(r[0], r[1]) for r in corpus], width, percent)


def test_rows_without_an_id_take_the_component_of_an_equal_text(docs):
    got = sorted((r["n_shingles"], r["component_id"]) for r in j.near_duplicates(docs, 3, 90).where("doc_id is null").collect())
    assert got[0] == (0, None) and got[1][1] is not None


@pytest.mark.parametrize("seed", range(2))
def test_a_large_family_of_edits_with_chains(spark, seed, monkeypatch):
    """Long lists: members beyond the pivot's reach that link with each other, deletions, chains of edits."""
    monkeypatch.setattr(j, "LONG", 3)
    monkeypatch.setattr(j, "OFTEN", 5)
    rng = random.Random(seed)
    base, rows = text(rng, 60).split(), []
    for i in range(120):
        w = list(base if i < 60 or not rows else rows[rng.randrange(len(rows))][1].split())
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(w))
            if rng.random() < 0.4 and len(w) > 30:
                del w[k]
            else:
                w[k] = "edit" + str(rng.randrange(500))
        rows.append((i, " ".join(w)))
    got = j.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert sorted(map(tuple, got)) == brute(rows, 3, 90)


def test_empty_table(none):
    assert j.near_duplicates(none, 3, 90).count() == 0


def test_one_document_of_each_group_stays(docs, corpus):
    kept = j.distinct_documents(docs, 5, 80)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.where("doc_id is not null").select("doc_id").collect())
    assert ids == sorted({c for _, _, c in brute([(r[0], r[1]) for r in corpus], 5, 80)})
    assert kept.where("doc_id is null").count() == 2


def test_rows_of_one_doc_id_join_their_components(spark):
    rng = random.Random(3)
    x, y, z = (text(rng, 30) for _ in range(3))
    rows = [(3, x), (5, x), (5, y), (9, y), (11, z), (11, None), (12, "")]
    got = sorted((r["doc_id"], r["component_id"]) for r in j.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect())
    assert got == [(3, 3), (5, 3), (5, 3), (9, 3), (11, 11), (11, 11), (12, 12)]


def templates(n, seed=1):
    """Documents of 20 of 30 shared sentences, in the same order."""
    rng = random.Random(seed)
    sentences = [text(rng, 20) for _ in range(30)]
    return [(i, " ".join(sentences[k] for k in sorted(rng.sample(range(30), 20)))) for i in range(n)]


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_templates_are_not_paired_with_each_other(spark, monkeypatch, width, percent):
    """Documents that share much and do not link: pairs that are verified grow with the documents, not with their square."""
    many = {}
    for n in (150, 300):
        written, before = [], j.saved
        with monkeypatch.context() as m:
            m.setattr(j, "saved", lambda d: (written.append(before(d)), written[-1])[1])
            rows = templates(n)
            got = j.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()
        assert sorted(map(tuple, got)) == brute(rows, width, percent)
        many[n] = sum(d.count() for d in written if d.columns == ["a", "b"])
    assert many[300] < 300 and many[150] < 150


def test_sketches_differ_in_no_more_parts_than_sets(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, 500, dtype=np.uint64)
    b = np.concatenate((a[:480], rng.integers(0, 2**63, 25, dtype=np.uint64)))
    x, y = j.sketches(np.concatenate((a, b)), np.array([500, 505])).view(np.uint64)
    assert 20 < np.bitwise_count(x ^ y).sum() <= 45


def test_hot_keys_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(j, "SALTED", 5)
    monkeypatch.setattr(j, "LONG", 3)
    rng = random.Random(7)
    base = text(rng, 60).split()
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(30))
        rows.append((i, " ".join(w)))
    got = j.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()
    assert sorted(map(tuple, got)) == brute(rows, 3, 80)
