"""Corpus pipeline: language, quality, near-duplicates, secrets, packing.

``STAGES`` lists (name, function) in order; a function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``; the last returns the packed pieces
(doc_id, piece, start, length, ids_crc32, sequence_id, offset).  Nulls, empty and very long
texts, repeated rows, empty tables and extra columns have the results that the operators'
own descriptions state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import stages
from vellum.session import scratch_path

STAGES = [
    ("language_id", stages.language_id),
    ("quality_rules", stages.quality_rules),
    ("simhash_near_dedup", stages.near_duplicates),
    ("secret_scans", stages.secret_scans),
    ("best_fit_packing", stages.best_fit_packing),
]

#: Tokenising, fingerprints and the learned stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, each stored in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
