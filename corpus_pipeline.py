"""Corpus pipeline: each stage calls one operator and hands its documents on as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordloom.llm.chunks import without_repeats
from recordloom.llm.minhash import one_of_each_class
from recordloom.llm.mixing import mixed_documents
from recordloom.llm.packing import pack_documents
from recordloom.llm.quality import clean_documents
from recordloom.sources.scratch import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line-first cleaning; rejected documents go, also null, empty and wordless ones.

    Repeated rows, tied or missing ids and columns of any other name make no difference.
    """
    return clean_documents(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the one with the smallest id, once.

    Texts that share an id are documents of their own. Null and empty texts are no
    copies of each other; rows without an id all stay.
    """
    return one_of_each_class(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out; documents of which nothing is left go.

    Null and empty texts and rows without an id stay as they are; rows that repeat an
    id and its text are cut alike, other texts under that id are left alone.
    """
    return without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that token shares come near the targets.

    The draw expects 90 % of the input's tokens, so shares that only more tokens of a
    cell could raise stay below their target; these are stored and logged.
    Null sources and languages are values of their own; rows with one id fall
    alike; texts without words stay as far as their cell does.
    """
    return mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What stays is packed into sequences; one row per piece. Null and empty texts are one token."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup),
    ("mixing", mixing),
    ("best-fit packing", best_fit_packing),
]

#: Later stages are not expressible in SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
