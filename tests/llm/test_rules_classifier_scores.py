from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.llm import pseudo_likelihood as pl
from tidemill.llm import quality_classifier as qc
from tidemill.llm import quality_rules as qr


def measured(t):
    t = t or ""
    w = [x.decode(errors="surrogateescape") for x in re.findall(rb"[^\x20\x09-\x0d]+", t.encode())]
    lines = [x for x in t.split("\n") if re.search(rb"[^\x20\x09-\x0d]", x.encode())]
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(g)
    covered = {i + k for i, x in enumerate(g) if c[x] > 1 for k in range(3)}
    m = len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered)
    return (*m, m[0] < 50 or 100 * m[4] > 50 * m[0])


def test_measures(docs, corpus):
    got = Counter(tuple(r) for r in qr.judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    assert got == Counter((r[0], *measured(r[1])) for r in corpus)


@pytest.mark.parametrize("few", [0, 48])
def test_repeats_by_either_way(spark, few, monkeypatch):
    monkeypatch.setattr(qr, "FEW", few)
    texts = ["a b c a b c a b c", "a a a a a", "a b c d e f a b c x d e f", "x y", "a b c\na b c\n \na b c", " ".join(str(k % 70) for k in range(300))]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in qr.judged(d).collect()}
    assert got == {i: measured(t) for i, t in enumerate(texts)}


def test_the_order_of_rules_does_not_change_the_verdict(docs):
    ids = lambda rules: sorted(str(r["doc_id"]) for r in docs.where(qr.let(qr.words_of(F.col("text")), lambda w: qr.verdict(rules, qr._of_text(F.col("text"), w)))).collect())
    assert ids(qr.RULES) == ids(qr.RULES[::-1]) == sorted(str(r["doc_id"]) for r in qr.kept(docs).collect())
    judged = qr.judged(docs)
    assert sorted(str(r["doc_id"]) for r in judged.where("kept").collect()) == ids(qr.RULES)
    assert qr.kept(docs).columns == docs.columns


def test_the_plan_measures_each_rule(docs, none):
    plan = qr.plan(docs)
    assert {r.name for r, _, _ in plan} == {r.name for r in qr.RULES} and all(s > 0 and 0 <= x <= 1 for _, s, x in plan)
    rate = [x / s for _, s, x in plan]
    assert rate == sorted(rate, reverse=True)
    assert qr.judged(none).count() == 0 and qr.kept(none).count() == 0


def test_the_order_of_rules_hangs_on_the_rows_alone(docs):
    """Any partitioning and any run gives one order; a sample is of all parts of the table."""
    orders = {tuple((r.name, round(s, 3), round(x, 6)) for r, s, x in qr.plan(docs.repartition(n), rows=40)) for n in (1, 2, 5, 5)}
    assert len(orders) == 1


def test_what_only_later_rules_need_is_made_inside_the_chain(docs):
    plan = qr.judged(docs)._jdf.queryExecution().optimizedPlan().toString()
    chain = plan[plan.index("base_failed") :]
    assert "n_lines" not in plan and "CASE WHEN" in chain


def test_rules_run_no_python(docs):
    assert "Python" not in qr.judged(docs)._jdf.queryExecution().toString()


def test_sql_on_the_smallest_tables(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(qr.SQL)
    got = qr.op4_quality_rules(spark, "/root/testdata/sf0.001").select(want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_classifier_on_held_out_labels(spark):
    out = qc.op10_quality_classifier(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.97
    by = {q: np.mean([r["predicted"] == q for r in rows if r["quality"] == q]) for q in (0, 1)}
    assert min(by.values()) > 0.9
    for r in out.limit(50).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_classifier_with_odd_rows(spark, docs, corpus, none):
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(40)] + [(1, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = qc.fit(docs, labels)
    out = qc.scored(docs, model).collect()
    assert len(out) == len(corpus) and not any(math.isnan(r["score"]) for r in out)
    assert {r["held_out"] for r in out if r["doc_id"] is None} == {False}
    assert {r["score"] for r in qc.scored(docs, qc.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert qc.scored(none, model).count() == 0


def test_scores_of_single_texts_and_of_repeated_rows(spark, docs, corpus):
    """Against a plain rendering: indicators of one text at a time, their weights added up; equal texts get equal scores."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = qc.fit(docs, labels)
    text = next(r[1] for r in corpus if r[0] == 8)
    many = spark.createDataFrame([(i, text if i % 2 else f"{text} and {i} more") for i in range(120)], "doc_id long, text string").repartition(5)
    assert len({r["score"] for r in qc.scored(many, model).where("doc_id % 2 = 1").collect()}) == 1
    got = {r["doc_id"]: r["score"] for r in qc.scored(docs, model).collect() if r["doc_id"] is not None}
    for i, t, *_ in corpus[:40]:
        f, n = qc.indicators(pa.array([t]))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(model.slope * (sum(model.weights[k] for k in f.tolist()) / math.sqrt(n[0]) + model.bias) + model.offset))), abs=1e-9)


def test_a_repeated_doc_id_is_learnt_from_once(spark):
    rows = [(i % 6, f"word{i % 6} text {i // 6}") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    d = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = qc.fit(d, labels), qc.fit(d.repartition(7), labels)
    assert np.array_equal(a.weights, b.weights)


def test_held_out_labels_are_not_learnt_from(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    flipped = labels.withColumn("quality", F.when(qc.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = qc.fit(docs, labels), qc.fit(docs, flipped)
    assert np.array_equal(a.weights, b.weights) and a.slope == b.slope


def test_dual_descent_meets_the_primal():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(60, 4)), np.where(rng.random(60) < 0.5, 1.0, -1.0)
    x[:, 0] += y
    f = [np.arange(4)] * 60
    w = qc.dual_descent(f, list(x), y, 4, epochs=400)
    most = np.where(y > 0, 60 / (2 * (y > 0).sum()), 60 / (2 * (y < 0).sum()))
    primal = lambda w: 0.5 * w @ w + (most * np.maximum(0, 1 - y * (x @ w[:4] + w[4]))).sum()
    assert all(primal(w) <= primal(w + d) + 1e-3 for d in rng.normal(scale=0.01, size=(200, 5)))


def test_conditionals_sum_to_one_and_gradients_are_right():
    net, rng = pl.Network(width=3), np.random.default_rng(1)
    around = rng.integers(0, pl.SIZE + 1, (4, 1))
    every = net.log_probs(np.repeat(around, pl.SIZE, 1), np.arange(pl.SIZE))
    assert np.exp(every).sum() == pytest.approx(1, abs=1e-3)
    near, tokens = rng.integers(0, pl.SIZE + 1, (4, 64)), rng.integers(0, pl.SIZE, 64)
    sums = {k: np.zeros(s, np.float32) for k, s in net.shapes.items()}
    before = net.log_probs(near, tokens).mean()
    for _ in range(20):
        net.log_probs(near, tokens, 0.05, sums)
    assert net.log_probs(near, tokens).mean() > before + 0.5


def test_around_stays_inside_the_text():
    got = pl.around(np.array([5, 6, 7, 8]), np.array([0, 3, 3, 4]), 2).T.tolist()
    pad = pl.SIZE
    assert got == [[pad, pad, 6, 7], [pad, 5, 7, pad], [5, 6, pad, pad], [pad, pad, pad, pad]]


def test_scores_against_one_text_at_a_time(docs, corpus, none):
    words = pl.vocabulary(docs)
    net = pl.train(docs, words)
    got = {r["doc_id"]: r for r in pl.scored(docs, words, net).collect() if r["doc_id"] is not None}
    assert len(got) == len({r[0] for r in corpus if r[0] is not None})
    for i, t, *_ in corpus:
        if i is None:
            continue
        tokens, first = words.tokens(pa.array([t]))
        logs = [net.log_probs(pl.around(tokens, first, 2)[:, k : k + 1], tokens[k : k + 1])[0] for k in range(min(len(tokens), 300))]
        assert got[i]["n_tokens"] == len(tokens)
        if len(tokens) <= 300:
            assert got[i]["log_prob"] == pytest.approx(sum(logs), rel=1e-4, abs=1e-6)
    assert got[71]["log_prob"] == 0 and got[71]["mean_log_prob"] is None
    assert pl.scored(none, pl.vocabulary(none), pl.train(none, pl.vocabulary(none))).count() == 0


def test_training_beats_the_start(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = pl.vocabulary(d)
    mean = lambda net: pl.scored(d, words, net).agg(F.sum("log_prob") / F.sum("n_tokens")).first()[0]
    assert mean(pl.train(d, words)) > mean(pl.Network()) + 1.0
