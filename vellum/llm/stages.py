"""The operators as stages over ``documents``: rows in, rows of the same columns out.

A stage's own columns never meet the table's (the row travels as one struct, or their names
are chosen apart), so extra columns of any name pass unchanged.  Every stage reads all rows of its input; rows leave
only by the stage's own decision.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import common as C
from vellum.llm import langid, packing, quality, secret_scan, simhash
from vellum.session import materialize

SHINGLE = 4
MAX_BITS = 4


def _row(df: DataFrame, *names: str) -> DataFrame:
    """The whole row as struct ``__row``, and the named columns."""
    return df.select(F.struct(*[C.col(c) for c in df.columns]).alias("__row"), *[C.col(c) for c in names])


def _back(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("__row").getField(c).alias(c) for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: no letter, or far from every centroid, go."""
    model = langid.fit(docs)
    kept = langid.predict(_row(docs, "text"), model).where(~F.col("rejected"))
    return _back(kept, docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules themselves and whose host is not rejected."""
    return _back(quality.judge(_row(docs, "text", "source")).where("kept"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the smallest doc_id (null last).

    Rows are known by a hash of all their columns (96 bits).  Only these hashes, keys and
    fingerprints are stored; the rows that go are anti-joined.  Among rows that tie for the
    smallest doc_id the smallest hash stays, and of rows equal in every column one.
    """
    a, b = C.fresh(docs, "__a", "__b")
    keyed = docs.withColumns(dict(zip((a, b), C.row_hash(docs))))
    prints = materialize(simhash.fingerprints(keyed, SHINGLE, carry=(a, b, "doc_id")), "row-fingerprints")
    rows = prints.groupBy(a, b).agg(F.first("doc_id").alias("doc_id"), F.first("fp").alias("fp"),
                                    F.count("*").alias("__n"))
    placed = materialize(rows.join(simhash.classes(prints, MAX_BITS, "doc_id").hint("merge"), "fp"), "placed")
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", a, b)
    first = placed.groupBy("root").agg(F.min(order).alias("first"))
    stays = (F.col(a) == F.col(f"first.{a}")) & (F.col(b) == F.col(f"first.{b}"))
    # what is not simply kept: rows that go, and rows of which equal ones go
    marked = materialize(placed.join(first.hint("merge"), "root").where(~stays | (F.col("__n") > 1))
                         .select(a, b, stays.alias("__repeated")), "near-duplicates")
    # always by a shuffle: the marked rows grow with the corpus
    joined = keyed.join(marked.hint("merge"), [a, b], "left")
    kept = joined.where(F.col("__repeated").isNull()).select(*[C.col(c) for c in docs.columns])
    if not marked.where("__repeated").head(1):
        return kept
    once = joined.where("__repeated").dropDuplicates([a, b]).select(*[C.col(c) for c in docs.columns])
    return kept.unionByName(once)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, reported secrets masked; n_chars follows the text."""
    masked = secret_scan.redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    kind = docs.schema["n_chars"].dataType
    n = F.when(C.col("n_chars").isNotNull() & C.col("text").isNotNull(), F.length(C.col("text")))
    return masked.withColumn("n_chars", F.coalesce(n.cast(kind), C.col("n_chars")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets.

    The workers also serve the other stages, so they do not keep the words they have seen.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), carry=("doc_id",),
                                  remember=False)
