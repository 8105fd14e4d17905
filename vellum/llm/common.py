"""Helpers shared by the operators of this subpackage.

Tables enter Python as Arrow batches (``mapInArrow``).  Text travels as bytes and is
decoded with U+FFFD for invalid sequences, so a broken string never fails a job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.session import ship_package

#: ASCII white space, the word separator of the contracts: \x20 and \x09-\x0D.
ASCII_SPACE = r"[ \t-\r]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash (in any letter case) with those of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def col(name: str) -> Column:
    """A top-level column by its literal name (dots and back-ticks included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def schema(df: DataFrame, keep: Sequence[str], extra: str) -> T.StructType:
    """The fields of ``df`` named in ``keep``, then those of a DDL string."""
    return T.StructType([df.schema[c] for c in keep] + T.StructType.fromDDL(extra).fields)


def text_bytes(name: str) -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(col(name).cast("binary"), F.lit("").cast("binary"))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch],
              schema: str) -> DataFrame:
    """``mapInArrow`` with one result batch for each input batch."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def computed(df: DataFrame, value: Column, fn: Callable[[pa.Array], pa.Array], ddl: str) -> Column:
    """A column that Python computes from one column, by Arrow batches.

    Only that column goes to Python; the rest of a row waits in the JVM.  Marked
    non-deterministic so that the optimizer never evaluates it twice, once per use.
    """
    ship_package(df.sparkSession)

    def run(column: pa.Array) -> pa.Array:
        return fn(column)

    return F.arrow_udf(run, ddl).asNondeterministic()(value)


def decode(raw: bytes | None) -> str:
    return "" if raw is None else raw.decode("utf-8", "replace")


def row_hash(df: DataFrame) -> tuple[Column, Column]:
    """Two hashes (64 and 32 bits) of all columns of a row; nulls count by their place."""
    parts = [x for c in df.columns for x in (col(c), col(c).isNull())]
    return F.xxhash64(*parts), F.hash(F.lit(1), *parts)


def words(text: Column, separators: str = " \t\n\x0b\f\r",
          pattern: str = ASCII_SPACE) -> Column:
    """The words between separators as an array (null text: no words).

    Separators are trimmed off first, so that splitting leaves no empty word.
    """
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(separators))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, pattern))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times inside ``body``.

    The optimizer inlines projected columns into the lambdas that read them, which
    would evaluate an array again for every element; a lambda variable is bound once.
    """
    return F.transform(F.array(value), body)[0]
