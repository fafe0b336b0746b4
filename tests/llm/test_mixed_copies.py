from __future__ import annotations

from collections import Counter

from tidemill.llm import mixing


def test_repeated_rows_and_copies_without_an_id_keep_to_the_plan(spark):
    rows = [(k, f"w{k} " * 10, "a") for k in range(40)]
    rows += [(7, "w7 " * 10, "a")] * 3 + [(8, "other words " * 6, "a")]  # repeated rows, and an id with two texts
    rows += [(None, "copy of it " * 5, "b")] * 6 + [(100 + k, "b " * 20, "b") for k in range(10)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    target = {"a" if r["source_size"] == 442 else "b": r["target"] for r in mixing.mix(d).collect()}
    out = mixing.mixed(d)
    assert out.columns == d.columns
    took, words, old = Counter(), Counter(), Counter(rows)
    for r in out.collect():
        took[tuple(r)] += 1
        words[r["source"]] += len(r["text"].split())
    for r, n in took.items():
        assert n <= 3 * old[r], r
    for s, t in target.items():
        assert abs(words[s] - t) <= 20, (s, words[s], t)
