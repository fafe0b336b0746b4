from __future__ import annotations

import corpus_pipeline
from tidemill.llm import jaccard_join, mixing, packing, quality_rules, queries, substring_dedup
from tidemill.llm.common import components

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, rows = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns, name
        rows.append(docs.count())
    assert rows[0] > rows[1] > rows[2] == rows[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    tokens = {r["doc_id"]: r["doc_tokens"] for r in packed.collect()}
    times = {r["doc_id"]: r["count"] for r in docs.groupBy("doc_id").count().collect()}
    assert packed.agg({"length": "sum"}).first()[0] == sum(tokens[i] * n for i, n in times.items())


def test_the_stages_are_their_operators(spark):
    """The whole run against the operators one by one."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    d = quality_rules.kept(docs)
    found = jaccard_join.near_duplicates(d, 5, 80)
    d = d.join(found.where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi")
    d = substring_dedup.deduplicated(d)
    d = mixing.mixed(d)
    want = packing.pack(d, packing.default_tokenizer()).groupBy("doc_id", "doc_tokens").sum("length").collect()
    got = corpus_pipeline.run(spark, DATA).groupBy("doc_id", "doc_tokens").sum("length").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got


def test_odd_documents_pass_all_stages(spark, docs, none):
    for table in (docs, none):
        d = table
        for _, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, DATA)
        assert (d.count() > 0) == (table is docs)


def test_eleven_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in queries.QUERIES} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 9), (9, 8), (20, 21), (5, 5)] + [(100, k) for k in range(101, 160)] + [(k, k + 1) for k in range(200, 230)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {**dict.fromkeys((1, 2, 3, 4), 1), **dict.fromkeys((8, 9, 10), 8), 20: 20, 21: 20, **{k: 100 for k in range(100, 160)}, **{k: 200 for k in range(200, 231)}}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
