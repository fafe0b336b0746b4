from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from conftest import text
from tidemill.llm import substring_dedup as s


def test_cuts_shift_with_an_insertion():
    rng = random.Random(1)
    a = text(rng, 500)
    b = "inserted words here " + a
    ends = lambda t: set(len(t) - s.cuts(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[1])
    assert len(ends(a) - ends(b)) <= 1 and len(ends(a)) > 30


def test_chunks_tile_every_text(odd_texts):
    raw, offsets, _ = s.places(pa.array(odd_texts))
    starts, ends, row = s.cuts(raw, offsets)
    for i, t in enumerate(odd_texts):
        own = row == i
        assert b"".join(bytes(raw[a:b]) for a, b in zip(starts[own], ends[own])) == (t or "").encode()


def planted(spark, n=12):
    rng = random.Random(2)
    passage = text(rng, 70)
    own = [(text(rng, 80), text(rng, 80)) for _ in range(n)]
    rows = [(i, f"{a} {passage} {b}") for i, (a, b) in enumerate(own)]
    rows += [(100 + i, text(rng, 120)) for i in range(10)]
    return passage, own, rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_a_passage_stays_in_its_first_document_alone(spark):
    passage, own, rows, d = planted(spark)
    got = {r["doc_id"]: r["text"] for r in s.deduplicated(d).collect()}
    assert got[0] == rows[0][1]
    for i, (a, b) in enumerate(own):
        if i:
            words = got[i].split()
            assert words == (a + " " + b).split(), i
    for i, t in rows[12:]:
        assert got[i] == t


def test_spans_tell_what_went(spark):
    _, _, rows, d = planted(spark)
    old = dict(rows)
    for r in s.deduplicated(d, spans="gone").collect():
        data, last, out = old[r["doc_id"]].encode(), 0, b""
        for g in r["gone"]:
            out += data[last : g["start"]]
            last = g["stop"]
        assert (out + data[last:]).decode() == r["text"]


def test_copies_vanish_and_the_rest_is_untouched(docs, corpus):
    out = s.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == len(corpus)
    got = {r["doc_id"]: r["text"] for r in out.collect() if r["doc_id"] is not None}
    base = next(r[1] for r in corpus if r[0] == 60)
    assert sum(t == base for t in got.values()) <= 1
    assert all(got[i] == "" or len(got[i]) < len(base) for i in range(61, 66))
    old = {r[0]: r[1] for r in corpus}
    for i in range(70, 80):
        assert got[i] == old[i]
    assert got[3] == old[3]  # a repeated row keeps its text
    nulls = [r["text"] for r in out.where("doc_id is null").collect()]
    assert None in nulls and base in nulls


def test_within_a_document_nothing_goes(spark):
    t = text(random.Random(5), 60)
    d = spark.createDataFrame([(1, f"{t} {t} {t}"), (2, "other words")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in s.deduplicated(d).collect()}[1] == f"{t} {t} {t}"


def test_empty_table(none):
    assert s.deduplicated(none).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_every_repeat_of_fifty_words_is_caught(spark, seed):
    """Against brute force: no 50-word window of a later document is found in an earlier one."""
    rng, pool = random.Random(seed), []
    pool = [text(rng, 55 + k) for k in range(6)]
    rows = [(i, " ".join([text(rng, 20), rng.choice(pool), text(rng, 20), rng.choice(pool), text(rng, 5)])) for i in range(25)]
    got = {r["doc_id"]: r["text"].split() for r in s.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = {}
    for i in sorted(got):
        for k in range(len(got[i]) - 49):
            w = tuple(got[i][k : k + 50])
            assert first.setdefault(w, i) == i


def test_no_word_outside_a_passage_goes(spark):
    """2,000 documents against brute force: what is lost is the passage alone, to the word; no 50-word repeat is left."""
    rng = random.Random(8)
    passages = [text(rng, 50 + k) for k in range(0, 60, 3)]
    own = [(text(rng, 20 + i % 30), passages[i % 20], text(rng, 20 + i % 17)) for i in range(2000)]
    whole = [" ".join(x) for x in own]
    d = spark.createDataFrame(list(enumerate(whole)), "doc_id long, text string")
    more = 0
    for r in s.deduplicated(d, spans="gone").collect():
        i, (a, _, b) = r["doc_id"], own[r["doc_id"]]
        gone = [whole[i].encode()[g["start"] : g["stop"]].decode().strip() for g in r["gone"]]
        assert len(gone) == (i >= 20)
        for g in gone:  # a word beside the passage goes only if it stands beside it in an earlier document too
            assert any(f" {g} " in f" {whole[k]} " for k in range(i % 20, i, 20)), i
        if i >= 20:
            more += r["text"].split() != f"{a} {b}".split()
    assert more < 20


def test_chunks_of_different_owners_are_no_passage(spark):
    """Forty short pieces of forty documents in a row: none of them is long, so nothing goes."""
    rng = random.Random(9)
    pieces = [text(rng, 20) for _ in range(40)]
    rows = [(i, f"{text(rng, 30)} {p} {text(rng, 30)}") for i, p in enumerate(pieces)] + [(99, " ".join(pieces))]
    got = {r["doc_id"]: r["text"] for r in s.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(rows)


def test_a_common_phrase_inside_a_passage_does_not_break_it(spark):
    rng = random.Random(10)
    phrase = text(rng, 12)
    passage = f"{text(rng, 25)} {phrase} {text(rng, 25)}"
    own = [(text(rng, 30), text(rng, 30)) for _ in range(3)]
    rows = [(0, f"{text(rng, 40)} {phrase} {text(rng, 40)}")] + [(1 + i, f"{a} {passage} {b}") for i, (a, b) in enumerate(own)]
    got = {r["doc_id"]: r["text"].split() for r in s.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[1][1].split()
    assert [got[2], got[3]] == [f"{a} {b}".split() for a, b in own[1:]]


def test_rows_of_one_id_with_other_texts(spark):
    """Both texts of doc_id 1 keep what they share; doc_id 2 loses what either has; the places of the two are not mixed up."""
    rng = random.Random(11)
    p, q = text(rng, 60), text(rng, 60)
    rows = [(1, f"{p} {q}"), (1, f"{q} {p}"), (1, f"{q} {p}"), (2, f"{text(rng, 9)} {p}"), (2, None), (3, q)]
    got = [(r["doc_id"], r["text"]) for r in s.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(t for i, t in got if i == 1) == sorted(t for i, t in rows if i == 1)
    two = [t for i, t in got if i == 2]
    assert None in two and len(next(t for t in two if t).split()) == 9
    assert (3, "") in got
