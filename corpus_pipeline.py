"""From raw documents to packed training sequences, in stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import line_dedup, near_dedup, packing, quality, toxicity
from palimpsest.llm.common import materialize

#: (name, function of (spark, docs, sf_dir)). All but the last return the columns of documents.
STAGES = [
    ("quality", quality.stage),
    ("toxicity", toxicity.stage),
    ("line_dedup", line_dedup.stage),
    ("near_dedup", near_dedup.stage),
    ("packing", packing.stage),
]

#: Classifiers, sampling and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
