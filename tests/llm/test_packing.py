from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemill.llm import packing

PATH = packing.default_tokenizer()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, t):
    return np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")


def test_words_give_the_ids_of_whole_texts(tokenizer, odd_texts):
    texts = [*odd_texts, "a.b. c., ...x \"Hi.\" Ünï. É, x², İstanbul. ΣΑΣ. don't. <|endoftext|>. a—. …. é×. ñ. ́a. á.", ". , a", "A.", ".", "x,\ny.\tz"]
    own = packing.WordTokenizer(PATH)
    for _ in range(2):  # first met, then remembered
        ids, counts = own.encode(pa.array(texts))
        at = 0
        for t, n in zip(texts, counts.tolist(), strict=True):
            assert ids[at : at + n].tolist() == ids_of(tokenizer, t)[:-1].tolist(), t and t[:80]
            at += n


def test_a_full_memo_starts_anew(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "MEMO", 8)
    own = packing.WordTokenizer(PATH)
    for t in ("aa bb cc dd ee", "ff gg hh ii jj", "aa gg"):
        assert own.encode(pa.array([t]))[0].tolist() == ids_of(tokenizer, t)[:-1].tolist()


def checked(rows, texts, tokenizer, length=2048):
    """Every id in one piece, sequences gapless, none padded but to a power of two's own length."""
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for doc_id, pieces in docs.items():
        ids = ids_of(tokenizer, texts[doc_id])
        copies = sum(p["start"] == 0 for p in pieces)
        got = sorted((p["start"], p["length"], p["ids_crc32"]) for p in pieces)
        covered = np.zeros(len(ids), int)
        for start, n, crc in got:
            assert zlib.crc32(ids[start : start + n].tobytes()) == crc
            covered[start : start + n] += 1
        assert (covered == copies).all() and {p["doc_tokens"] for p in pieces} == {len(ids)}
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= length and (at == length or at & (at - 1) == 0)
    return docs


def test_every_row_is_packed(docs, corpus):
    rows = packing.pack(docs, PATH).collect()
    assert sum(r["start"] == 0 for r in rows) >= len(corpus) and {r["doc_id"] for r in rows} == {r[0] for r in corpus}


@pytest.mark.parametrize("length,grain", [(2048, 64), (128, 8), (64, 64)])
def test_documents_with_ids(docs, corpus, tokenizer, length, grain):
    rows = packing.pack(docs.where("doc_id is not null"), PATH, length=length, grain=grain).collect()
    found = checked(rows, {r[0]: r[1] for r in corpus if r[0] is not None}, tokenizer, length)
    assert len(found) == len({r[0] for r in corpus if r[0] is not None})


def test_empty_table_and_one_empty_document(spark, none):
    assert packing.pack(none, PATH).count() == 0
    row = packing.pack(spark.createDataFrame([(5, None)], "doc_id long, text string"), PATH).collect()
    assert [(r["doc_id"], r["start"], r["length"], r["doc_tokens"], r["offset"]) for r in row] == [(5, 0, 1, 1, 0)]


def test_the_linear_program_uses_nearly_all():
    rng = np.random.default_rng(2)
    lengths = np.array([*range(1, 64), *range(64, 2048, 64)])
    counts = rng.integers(50, 400, len(lengths))
    used = np.zeros(len(lengths), int)
    for pattern, n in packing.patterns(lengths, counts, 2048):
        assert n > 0 and pattern @ lengths == 2048
        used += pattern * n
    assert (used <= counts).all()
    assert used @ lengths > 0.99 * (counts @ lengths)


def test_pricing_finds_the_cheapest_exact_pattern():
    lengths, price = np.array([2, 3, 5]), np.array([0.5, 0.6, 1.3])
    cost, pattern = packing._priced(lengths, price, 11)
    best = min(a * 0.5 + b * 0.6 + c * 1.3 for a in range(6) for b in range(4) for c in range(3) if 2 * a + 3 * b + 5 * c == 11)
    assert cost == pytest.approx(best) and pattern @ lengths == 11
