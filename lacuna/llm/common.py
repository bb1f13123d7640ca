"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the key and the text (null: empty); other columns, however named, take no part."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def numbered(docs: DataFrame, *columns: str) -> tuple[DataFrame, list[Column], list[Column]]:
    """The rows under names that no operator uses, the columns asked for, and all columns under their own names again."""
    rows = docs.toDF(*[f"column_{i}" for i in range(len(docs.columns))])
    asked = [F.col(rows.columns[docs.columns.index(c)]) for c in columns]
    return rows, asked, [F.col(new).alias(old) for new, old in zip(rows.columns, docs.columns, strict=True)]


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of so many rows go to Python while actions run in this block: long texts and sets make large ones too large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
