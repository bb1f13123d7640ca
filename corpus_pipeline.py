"""The corpus pipeline: language, near duplicates, personal data, mixture, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns a table that is
written and read again as the next one's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import bpe, language, mixing, pii, similar
from lacuna.llm.common import table
from lacuna.llm.queries import tokenizer_path
from lacuna.operators.lineage import written

#: Rows of whole texts that go to Python at once; Arrow's buffers outside the heap keep the size of the largest batch.
ARROW_ROWS = 1_000


def _long_texts(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language go on; those without any (null, or no letter) are rejected. doc_id may be null."""
    _long_texts(spark)
    return language.identified_documents(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5-word shingles, similarity of 0.8 or more), exactly one row goes on.

    SimHash's index gives the first candidates and a count filter on shingles those beyond its reach; all are verified.
    """
    _long_texts(spark)
    return similar.kept(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents go on, each span of personal data replaced by its kind."""
    _long_texts(spark)
    return pii.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes go on, once for each epoch in which it takes them."""
    _long_texts(spark)
    return mixing.mixed_documents(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the ids of each document's text, with their number; ``docs`` is a table of files."""
    _long_texts(spark)
    return bpe.encode(docs, tokenizer_path(), "doc_id", "text", "source", from_files=True).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identified),
    ("near_duplicates", deduplicated),
    ("pii", redacted),
    ("mixing", mixed),
    ("bpe", tokenised),
]

#: No stage but the choice of columns can be said in SQL: a trained network, hashes of shingles and BPE are not.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
