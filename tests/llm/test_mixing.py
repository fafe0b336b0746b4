from __future__ import annotations

import re
from collections import defaultdict
from itertools import product

import numpy as np
import pytest

from tidemill.llm import mixing
from tidemill.llm.common import subset_sum


def test_subset_sum_is_the_nearest_of_all():
    rng = np.random.default_rng(1)
    for _ in range(40):
        sizes = rng.choice(np.arange(1, 40), 4, replace=False)
        counts, target = rng.integers(1, 4, 4), int(rng.integers(1, 200))
        best = min(abs(target - int(np.dot(c, sizes))) for c in product(*(range(n + 1) for n in counts)))
        got = subset_sum(sizes, counts, target)
        assert (got <= counts).all() and abs(int(got @ sizes) - target) == best


def poured(sizes, weights, repeats):
    """Targets by refilling until nothing is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(out.values())) / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] >= repeats * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        out |= {s: float(repeats * sizes[s]) for s in over}
        open_ -= over
    return out


def test_targets_and_words_taken(docs, corpus):
    got = mixing.mix(docs).collect()
    assert len(got) == len(corpus)
    size = lambda t: len(re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode()))
    sizes = defaultdict(int)
    for r in corpus:
        sizes[r[3]] += size(r[1])
    want = poured(sizes, (5, 2, 1), 3)
    source, words = {r[0]: r[3] for r in corpus if r[0] is not None}, {r[0]: size(r[1]) for r in corpus if r[0] is not None}
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        if r["doc_id"] is not None:
            assert r["size"] == words[r["doc_id"]]
            assert r["source_size"] == sizes[source[r["doc_id"]]] and r["target"] == pytest.approx(want[source[r["doc_id"]]])
            taken[source[r["doc_id"]]] += r["taken"]
        else:
            taken[{120: "s2", 0: None}[r["size"]]] += r["taken"]
    for s, t in want.items():
        longest = max(size(r[1]) for r in corpus if r[3] == s)
        assert abs(taken[s] - t) <= longest, s


def test_reruns_agree(docs):
    a, b = (sorted(map(str, mixing.mix(d).collect())) for d in (docs, docs.repartition(5)))
    assert a == b


def test_mixed_rows_and_empty_tables(docs, none):
    plan = {(r["doc_id"]): r["taken"] // r["size"] for r in mixing.mix(docs.dropDuplicates(["doc_id"])).where("taken > 0 and doc_id is not null").collect()}
    out = mixing.mixed(docs.dropDuplicates(["doc_id"]))
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["count"] for r in out.where("doc_id is not null").groupBy("doc_id").count().collect()} == plan
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def test_all_texts_empty(spark):
    d = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {r["taken"] for r in mixing.mix(d).collect()} == {0}


def test_documents_longer_than_the_program_bound_its_memory():
    import tracemalloc

    sizes, counts = np.array([3, 5, 90_000_000]), np.array([1000, 1000, 2])
    tracemalloc.start()
    times, extra = mixing.fit(sizes, counts, int((sizes * counts).sum()), 100_000_000.0, 3)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert times == 0 and abs(int((sizes * extra).sum()) - 100_000_000) <= 10_000_000
