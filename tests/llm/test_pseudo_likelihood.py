from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemill.llm import pseudo_likelihood as pl


def test_words_that_a_large_slice_holds_once_are_counted(spark):
    words = [f"w{k}" for k in range(10_100)]
    d = spark.createDataFrame([(1, " ".join(words + words[:200]))], "doc_id long, text string")
    assert len(pl.vocabulary(d).words) == pl.SIZE - pl.SHARED


@pytest.fixture(scope="module")
def zipf():
    """Texts over 1,000 frequent and 3,000 rare words, one text of words met once, and texts that are null, empty or repeated."""
    rng = random.Random(8)
    texts = [" ".join(f"F{rng.randrange(1000)}" if rng.random() < 0.8 else f"r{rng.randrange(3000)}" for _ in range(200)) for _ in range(100)]
    return [*texts, " ".join(f"once{k}" for k in range(300)), None, "", texts[0]]


def test_every_word_has_its_own_share_of_its_token(spark, zipf):
    d = spark.createDataFrame(list(enumerate(zipf)), "doc_id long, text string").repartition(3)
    counts = pl.counted(d)
    words = pl.vocabulary(d, counts)
    net = pl.train(d, words)
    tokens, first = words.tokens(pa.array(zipf))
    flat = [w.lower() for t in zipf for w in (t or "").split()]
    n, of = Counter(flat), dict(zip(flat, tokens.tolist(), strict=True))
    many = Counter(tokens.tolist())
    share = {w: n[w] / many[of[w]] for w in n}
    assert sum(share.values()) == pytest.approx(len(many))  # one a token
    near = pl.around(tokens, first, 2)
    logs = net.log_probs(near, tokens) + np.log([share[w] for w in flat])
    for r in pl.scored(d, words, net, counts).collect():
        a, b = first[r["doc_id"]], first[r["doc_id"] + 1]
        assert r["n_tokens"] == b - a and r["log_prob"] == pytest.approx(logs[a:b].sum(), rel=1e-5)
        assert r["mean_log_prob"] == (pytest.approx(logs[a:b].mean(), rel=1e-5) if b > a else None)


def test_one_model_for_any_partitioning_and_equal_scores_for_equal_rows(spark, zipf):
    rows = [(i, t) for i, t in enumerate(zipf)] + [(1000 + i, zipf[5]) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    words = pl.vocabulary(d)
    nets = [pl.train(d.repartition(n), words, size=400_000) for n in (3, 7)]
    assert np.abs(nets[0].weights - nets[1].weights).max() < 1e-4
    got = pl.scored(d.repartition(5), words, nets[0]).where("doc_id >= 1000 or doc_id = 5").collect()
    assert len(got) == 61 and len({r["log_prob"] for r in got}) == 1


def plain(net, words, text):
    """The score of a text, word by word from the definition."""
    ids = [words.tokens(pa.array([w]))[0][0] for w in text.split()]
    total = 0.0
    for i, t in enumerate(ids):
        hidden = np.zeros(net.width)
        for k, d in enumerate([*range(-net.side, 0), *range(1, net.side + 1)]):
            hidden += net.tables[k][ids[i + d] if 0 <= i + d < len(ids) else pl.SIZE]
        hidden = np.append(np.tanh(hidden), 1.0)
        for weights, at in ((net.classes, t // pl.CLASSES), (net.tokens[t // pl.CLASSES], t % pl.CLASSES)):
            z = weights.astype(float) @ hidden
            total += z[at] - np.log(np.exp(z).sum())
    return total


def test_scores_against_a_plain_rendering(spark, zipf):
    d = spark.createDataFrame(list(enumerate(zipf)), "doc_id long, text string")
    words = pl.vocabulary(d)
    net = pl.train(d, words)
    got = {r["doc_id"]: r["log_prob"] for r in pl.scored(d, words, net).collect()}
    for i in (0, 1, 50, 100):
        assert got[i] == pytest.approx(plain(net, words, zipf[i]), rel=1e-6)


def test_words_met_once_score_below_frequent_ones(spark, zipf, tmp_path):
    spark.createDataFrame(list(enumerate(zipf)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["mean_log_prob"] for r in pl.op1_pseudo_likelihood(spark, str(tmp_path)).collect()}
    assert len(got) == len(zipf) and got[100] < min(got[k] for k in range(100)) - 1.0
