"""The corpus pipeline: quality, exact dedup, near dedup, decontamination,
packing.  Each stage reads what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideflow.llm import chosen_path, packing, quality_knn, tree_dedup, winnow
from strideflow.llm.common import read, stage
from strideflow.llm.queries import TOKENIZER


def _plain(docs: DataFrame) -> DataFrame:
    """``docs`` with neutral names, so that no column is taken for a result."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"__column{i}" for i, c in enumerate(docs.columns)])


def _named(out: DataFrame, like: DataFrame) -> DataFrame:
    return out.select(*_plain(like).columns).toDF(*like.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    out = quality_knn.score(_plain(docs), read(spark, sf_dir, "labels"))
    return _named(out.filter("predicted = 1"), docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return tree_dedup.drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts stays."""
    return chosen_path.drop_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    out = winnow.decontaminate(_plain(docs), read(spark, sf_dir, "benchmark"), keep_text=True)
    return _named(out.filter(~F.col("contaminated")), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack(docs, TOKENIZER)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packed)]
ORACLE_SQL = None  # token ids and the quality model are not SQL; tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
