from __future__ import annotations

import random

import numpy as np
import pytest

from tidemill.llm import substring_dedup as s


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(1, 12))) for _ in range(n)]


def cleaned(spark, rows):
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    return {r["doc_id"]: r["text"].split() for r in s.deduplicated(d).collect()}


def test_every_random_passage_of_just_over_fifty_words_goes(spark):
    rng, n = random.Random(6), 3000
    passages = [words(rng, rng.randrange(51, 61)) for _ in range(n)]
    own = [(words(rng, 30), words(rng, 30)) for _ in range(2 * n)]
    rows = [[*a, *passages[i % n], *b] for i, (a, b) in enumerate(own)]
    got = cleaned(spark, rows)
    for i, (a, b) in enumerate(own):
        if i < n:
            assert got[i] == rows[i]
        else:
            assert len(got[i]) - len(a) - len(b) < 16, i
            assert got[i][:25] == a[:25] and got[i][-25:] == b[-25:], i


@pytest.mark.parametrize("period", [1, 2, 3, 5, 11])
def test_periodic_passages_go(spark, period):
    rng = random.Random(period)
    few = words(rng, period)
    passage = [few[k % period] for k in range(90)]
    own = [(words(rng, 40), words(rng, 40)) for _ in range(2)]
    got = cleaned(spark, [[*a, *passage, *b] for a, b in own])
    assert len(got[1]) - 80 < 50 and got[1][:30] == own[1][0][:30] and got[1][-30:] == own[1][1][-30:]


def test_a_long_stretch_goes_although_a_shorter_one_comes_first(spark):
    rng = random.Random(12)
    own = [(words(rng, 40), words(rng, 40)) for _ in range(4)]
    got = cleaned(spark, [[*a, *["de"] * n, *b] for (a, b), n in zip(own, (20, 150, 150, 90), strict=True)])
    assert len(got[0]) == 100 and len(got[1]) - 80 >= 118
    assert len(got[2]) - 80 < 16 and len(got[3]) - 80 < 16
    assert got[2][:40] == own[2][0] and got[3][-40:] == own[3][1]


def test_chunks_are_bounded_and_do_not_hang_on_their_neighbours(odd_texts):
    rng = random.Random(7)
    texts = [(t or "").encode() for t in odd_texts] + [" ".join(words(rng, rng.randrange(0, 90))).encode() for _ in range(300)]
    at = np.cumsum([0, *map(len, texts)])
    starts, ends, row = s.cuts(np.frombuffer(b"".join(texts), np.uint8), at)
    for i, t in enumerate(texts):
        alone, stop, _ = s.cuts(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert (starts[row == i] - at[i]).tolist() == alone.tolist()
        assert len(t) == 0 or (stop - alone)[1:-1].max(initial=0) <= s.SPAN + s.LEAST
