"""The corpus pipeline: stages applied to the documents one after another.

Documents that the quality rules reject go; of each group of near duplicates one document stays; passages that
repeat across documents are cut out of all but the first; sources are mixed to their target weights, so a document
may come up to three times; and what remains is packed into training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import jaccard_join, mixing, packing, quality_rules, substring_dedup
from tidemill.llm.common import WRITTEN, drop, read, saved


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.distinct_documents(docs, width=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = substring_dedup.deduplicated(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("source_mixing", mixture),
    ("sequence_packing", packed),
]
#: Hashed shingles, a rolling hash and integer programs are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again by the next; what a stage wrote on its way goes."""
    docs = read(spark, sf_dir, "documents")
    last: list[str] = []
    for _, stage in STAGES[:-1]:
        before = len(WRITTEN)
        docs = saved(stage(spark, docs, sf_dir))
        last, done = WRITTEN[-1:], [*last, *WRITTEN[before:-1]]
        drop(spark, done)
    return STAGES[-1][1](spark, docs, sf_dir)
