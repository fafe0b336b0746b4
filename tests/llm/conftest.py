from __future__ import annotations

import random

import pytest

WORDS = [a + b + c for a in ("ka", "lo", "mi", "ru") for b in ("ne", "ti", "so") for c in ("", "n", "ra", "vel")]


def text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, one word, control and multi-byte characters, one very long word, a very long text."""
    rng = random.Random(3)
    return [None, "", " \t\n ", "one", "ünï çödé 日本語 <b> </s>[INST]", "a\x00b \x1c c\x85d", "x" * 70_000, text(rng, 30_000), "same same same same", "A. b, c's 12.5"]


@pytest.fixture(scope="session")
def corpus(odd_texts):
    """(doc_id, text, lang, source, n_chars): copies, near copies, shared passages, repeated rows, nulls in every column, ties."""
    rng, out = random.Random(4), []
    passage = text(rng, 60)
    base = text(rng, 120)
    for i in range(60):
        t = text(rng, rng.randrange(1, 200))
        if i % 5 == 0:
            t = f"{t} {passage} {text(rng, 30)}"
        if i % 6 == 0:
            w = base.split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = "new" + str(rng.randrange(99))
            t = " ".join(w)
        out.append((i, t, "en" if i % 7 else None, f"s{i % 4}" if i % 9 else None, len(t)))
    out += [(60 + k, base, "en", "s0", None) for k in range(6)]
    out += [(70 + k, t, None, "s1", 0) for k, t in enumerate(odd_texts)]
    out += [out[3], out[3], (None, base, "en", "s2", 1), (None, None, None, None, None)]
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    # Extra columns whose names the operators use inside.
    d = spark.createDataFrame(corpus, SCHEMA).selectExpr("*", "1 as id", "'x' as `rank`", "2L as size", "array(1) as keys", "0 as n", "3 as _text")
    return d.repartition(3).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
