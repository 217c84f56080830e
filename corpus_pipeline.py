"""Corpus pipeline: quality, near duplicates, decontamination, secrets, packing.

``STAGES`` lists (name, function); each function takes ``(spark, docs, sf_dir)``
with all documents its predecessor kept and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``.  All but the last return
the columns of ``documents``.  Edge cases are those of the operators: documents
without text pass the filters and are packed as their end id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrascope.llm import decontaminate, ngram_join, packing, quality, secret_scan
from terrascope.llm.common import documents, keep_table
from terrascope.llm.queries import QUALITY_ROWS, tokenizer_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.3 or more)."""
    rows = quality.training_rows(docs, _table(spark, sf_dir, "labels"), "quality", QUALITY_ROWS)
    return quality.keep_good(docs, quality.train(rows), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a similarity of 0.8."""
    return ngram_join.keep_first(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items, also under other numbers or names."""
    return decontaminate.keep_clean(docs, _table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked."""
    length = "n_chars" if "n_chars" in docs.columns else None
    return secret_scan.mask(docs, length_column=length)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path(), end_id=0, capacity=1024)


STAGES = [("quality", quality_filter), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secrets", secrets), ("packing", pack)]

#: SQL cannot express the learned filter, the search for links or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the ``documents`` table under ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = keep_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
