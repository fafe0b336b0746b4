from __future__ import annotations

import hashlib

import duckdb
import numpy as np
import pytest

from tidemill.llm import chat_format as cf
from tidemill.llm import vector_tree as vt
from tidemill.llm import warc_fixity as wf


def vectors(spark, n=600, hot=200):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 8)).astype(np.float32)
    x[:hot] = x[0]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(1000, None, 0), (1050, [0.0] * 8, 0), (1100, [float("nan")] * 8, 0), (1150, [1.0, None] + [1.0] * 6, 0), (1200, [float("inf")] * 8, 0), (None, [1.0] * 8, 0), (1250, [1.0, 2.0], 0), (1300, [], 0)]
    return x.astype(float), spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


@pytest.mark.parametrize("block", [64, 2048])
def test_neighbours_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(vt, "BLOCK", block)
    x, d = vectors(spark)
    got = {}
    for r in vt.nearest(d).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    assert sorted(got) == list(range(0, 600, 50))
    norm, hits = np.sqrt((x * x).sum(1)), 0
    for q, found in got.items():
        s = (x * x[q]).sum(1) / (norm * norm[q])
        s[q] = -9
        want = np.lexsort((np.arange(len(x)), -s))[:5].tolist()
        assert [r for *_, r in found] == [1, 2, 3, 4, 5]
        assert np.allclose([s[i] for i, *_ in found], [v for _, v, _ in found], atol=1e-12)
        hits += len(set(want) & {i for i, *_ in found})
        if q < 200:  # a query among copies: the smallest ids of the copies
            assert [i for i, *_ in found] == [i for i in range(6) if i != q][:5]
    assert hits >= 0.9 * 5 * len(got)


def test_few_candidates_and_none(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r["vec_id"]) for r in vt.nearest(d).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert vt.nearest(d.limit(0)).count() == 0
    assert vt.nearest(d.where("vec_id = 0")).count() == 0


def test_best_bin_first_visits_every_leaf_once():
    x = np.random.default_rng(2).normal(size=(500, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = vt.Tree(x, leaf=20)
    order = tree.visits(x[3], 10**6)
    assert sorted(order) == list(range(len(tree.leaf))) and order[0] == tree.leaves_of(x[3:4])[0]


def test_repeated_rows_count_once_and_other_vectors_of_an_id_are_their_own(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [rows[0], rows[0], rows[11], rows[11], (0, x[39].tolist())]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in vt.nearest(d).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 12)))

    def wanted(q, own):
        s = x @ q / (np.linalg.norm(x, axis=1) * np.linalg.norm(q))
        found = [(round(-v, 12), i) for i, v in enumerate(s) if not (i == own[0] and own[1] == i)] + [(round(-s[39], 12), 0)]
        if own[1] == 39:
            found.remove((round(-s[39], 12), 0))
        return [(i, -v) for v, i in sorted(found)[:5]]

    assert list(got) == [0] and len(got[0]) == 10
    both = sorted([(n + 1, *w) for o in (0, 39) for n, w in enumerate(wanted(x[o], (0, o)))])
    assert sorted(got[0]) == both


@pytest.mark.parametrize("rows", [60, 100_000])
def test_leaves_grow_with_the_table(spark, monkeypatch, rows):
    """Recall against brute force over all rows, with leaves that the executors split and without."""
    monkeypatch.setattr(vt, "ROWS", rows)
    monkeypatch.setattr(vt, "CHUNK", 3)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 8)) + 2 * rng.normal(size=(30, 8))[rng.integers(0, 30, 3000)]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    leaves, before = [], vt.calibrated
    monkeypatch.setattr(vt, "calibrated", lambda tree, *a: (leaves.append(len(tree.leaf)), before(tree, *a))[1])
    got = {}
    for r in vt.nearest(d, rows=500).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert (leaves[0] > 60) == (rows == 60)
    unit, hits = x / np.linalg.norm(x, axis=1, keepdims=True), 0
    for q in range(0, 3000, 50):
        s = unit @ unit[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:5].tolist()) & got[q])
    assert hits >= 0.9 * 5 * 60


def pages(spark, n=400):
    rows = [(i, f"http://h/{i}", f"<p>{i} ü\r\n\r\n</p>" if i % 9 else None) for i in range(-20, n)] + [(3, "http://h/3", "again"), (None, "u", "h"), (7, None, "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_audit_finds_each_damage_and_nothing_else(spark):
    p = pages(spark)
    assert wf.audit(p, p.repartition(5), 4).count() == 0
    other = p.where("page_id is null or page_id not in (100, 3)").union(spark.createDataFrame([(3, "http://h/3", "again"), (5000, "u", "h"), (-77, "u", "h")], p.schema))
    other = other.selectExpr("page_id", "url", "case when page_id = 55 then 'bad' else html end as html")
    got = {(r["page_id"], r["kind"]) for r in wf.audit(p, other, 4).collect()}
    assert got == {(100, "missing"), (3, "changed"), (5000, "extra"), (-77, "extra"), (55, "changed")}


def test_audit_of_empty_replicas(spark):
    p = pages(spark, 20)
    n = p.where("page_id is not null").select("page_id").distinct().count()
    assert wf.audit(p, p.limit(0)).where("kind = 'missing'").count() == n
    assert wf.audit(p.limit(0), p).where("kind = 'extra'").count() == n
    assert wf.audit(p.limit(0), p.limit(0)).count() == 0


def test_records_are_read_back(spark):
    p = pages(spark).where("page_id is not null")
    got = wf.parsed(wf.records(p))
    want = p.selectExpr("page_id", "coalesce(url, '') as url", "coalesce(html, '') as html")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name,module", [("op7_warc_fixity", wf), ("op8_chat_format", cf)])
def test_sql_on_the_smallest_tables(spark, name, module):
    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS FROM '/root/testdata/sf0.01/{t}.parquet'")
    want = con.sql(module.SQL)
    got = getattr(module, name)(spark, "/root/testdata/sf0.01").select(want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_turns_come_back_byte_for_byte(spark, odd_texts):
    texts = [*odd_texts, cf.ODD, "\\", "\\l", "a<b[c\\d", "[/INST]</s>", "<s>[INST]assistant[/INST]x</s>"]
    rows = [(k // 5, k, ("user", "assistant", None, "sys<tem[", "")[k % 5], t) for k, t in enumerate(texts)]
    rows += [(None, 0, "assistant", "null conv"), (99, 1, "assistant", "later"), (99, None, "user", "first"), (99, 1, "assistant", "later")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as formatted", "2 as loss").repartition(3)
    got = {r["conv_id"]: r for r in cf.formatted(d).collect()}
    by = {}
    for c, turn, role, t in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", t or ""))
    assert set(got) == set(by)
    digest = {r["conv_id"]: r for r in cf.digests(cf.formatted(d)).collect()}
    for c, turns in by.items():
        turns.sort()
        data = got[c]["formatted"].encode()
        assert [(a.decode(), b.decode()) for a, b in cf.read_back(data)] == [t[2:] for t in turns]
        said = [cf.unescaped(data[x["start"] : x["stop"]]).decode() for x in got[c]["loss"]]
        assert said == [t for _, _, r, t in turns if r == "assistant"]
        assert digest[c]["loss_sha256"] == hashlib.sha256("".join(said).encode()).hexdigest() and digest[c]["n_turns"] == len(turns)
        assert digest[c]["formatted_chars"] == len(got[c]["formatted"])


def test_no_conversations(spark):
    d = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cf.digests(cf.formatted(d)).count() == 0


def test_urls_with_line_breaks_are_read_back(spark):
    urls = ["http://h/a", "http://h/a%0Db", "http://h/a\rb", "x\r\nContent-Length: 3\r\n\r\n%25%0A", "", "tail\n"]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "concat('<p>', url) as html")
    assert sorted(map(tuple, wf.parsed(wf.records(d)).collect())) == [(i, u, f"<p>{u}") for i, u in enumerate(urls)]
