from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import textarrays as ta
from tidemill.llm.common import slices
from tidemill.llm.packing import Table

TEXT = st.one_of(st.none(), st.text(alphabet=" \t\n\r\x0b\x0cabé日\x1c", max_size=30))


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=8))
def test_words_are_those_of_each_text(texts):
    raw, offsets = ta.buffer_of(pa.array(texts, pa.string()))
    starts, ends, first = ta.word_spans(raw, offsets)
    got = [[bytes(raw[a:b]) for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(first, first[1:])]
    assert got == [(t or "").encode().split() for t in texts]
    h = ta.word_hashes(raw, starts, ends)
    words = [w for t in got for w in t]
    by = {}
    assert all(by.setdefault(w, x) == x for w, x in zip(words, h.tolist())) and len(set(by.values())) == len(by)


def test_hashes_do_not_depend_on_blocks(monkeypatch, odd_texts):
    raw, offsets = ta.buffer_of(pa.array(odd_texts))
    starts, ends, _ = ta.word_spans(raw, offsets)
    whole = ta.word_hashes(raw, starts, ends, lower=True)
    monkeypatch.setattr(ta, "BLOCK", 1000)  # the longest word is longer
    assert np.array_equal(whole, ta.word_hashes(raw, starts, ends, lower=True))


def test_sliced_arrays_have_their_own_bytes():
    column = pa.array(["aa", None, "bb cc", "d"]).slice(1, 2)
    raw, offsets = ta.buffer_of(column)
    assert bytes(raw) == b"bb cc" and offsets.tolist() == [0, 0, 5]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=9), max_size=5), st.integers(1, 4))
def test_shingles_are_those_of_each_text(rows, width):
    column = pa.array([" ".join(r) for r in rows], pa.string())
    raw, offsets = ta.buffer_of(column)
    starts, ends, first = ta.word_spans(raw, offsets)
    h, row = ta.shingles(ta.word_hashes(raw, starts, ends), first, width)
    want = [(i, tuple(r[k : k + width])) for i, r in enumerate(rows) if r for k in range(max(1, len(r) - width + 1))]
    assert row.tolist() == [i for i, _ in want]
    by = {}
    assert all(by.setdefault(w, x) == x for (_, w), x in zip(want, h.tolist())) and len(set(by.values())) == len(by)


def test_slices_hold_all_rows_in_order(odd_texts):
    batch = pa.record_batch({"text": pa.array(odd_texts)})
    parts = list(slices(iter([batch, batch.slice(0, 0)]), "text", 1000))
    assert [x for p in parts for x in p.column(0).to_pylist()] == odd_texts and len(parts) > 2


def test_table_finds_what_was_put():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(1, 2**63, 900).astype(np.uint64))
    keys = np.concatenate((keys, keys[:50] + (np.uint64(1) << np.uint64(63))))  # equal low bits
    table = Table(1000)
    table.put(keys[:500], np.arange(500, dtype=np.int32))
    table.put(keys[500:], np.arange(500, len(keys), dtype=np.int32))
    assert np.array_equal(table.get(keys), np.arange(len(keys)))
    assert (table.get(keys ^ np.uint64(1 << 40)) == -1).all()
