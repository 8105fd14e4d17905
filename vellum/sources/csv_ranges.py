"""CSV with quoted line breaks, read by many tasks, and its column types.

A quoted field may hold line breaks, so where a record begins depends on all quotes before
it.  That is a prefix scan:

1. every byte range (an input split of the text reader) counts its quotes; the parity of the
   quotes before a range, one number per range, says whether it starts inside quotes;
2. with that, a range joins its own lines into whole records.  The lines before its first
   record start close a record of an earlier range, and its last record may stay open: at
   most two fragments per range, put together by file and place of the record's start;
3. records are parsed where they are (``from_csv``).

Only the ranges' parities (one row per range) and the fragments move.  Quoting is that of
RFC 4180, which the library and pandas write: a field with a quote, a separator or a line
break stands in quotes, and a quote inside is doubled.

``infer_types`` gives the types that the reference's reader would: one aggregate over all
columns at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.session import materialize, ship_package

#: Options under which a value is exactly what stands in the file; only ``a,,b`` has a null.
PLAIN_VALUES = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
                "emptyValue": "", "nullValue": "\u0001"}

# The tokens that stand for a missing value, and the spellings of booleans.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
           "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null")
TRUE = ("True", "TRUE", "true")
FALSE = ("False", "FALSE", "false")
_INT = r"^[ \t]*[+-]?[0-9]+[ \t]*$"
_FLOAT = r"^[ \t]*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))[ \t]*$"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The files' lines with their file and the first byte of their range, in order inside a range."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"))


def range_parities(lines: DataFrame) -> DataFrame:
    """(id, file, range, inside, crlf): whether a range starts inside quotes, and whether its file's
    lines end in \\r\\n (as its first one does); one row per range, stored."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    own = lines.groupBy("file", "range").agg((F.sum(quotes) % 2).alias("odd"), F.first("value").alias("line"))
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return materialize(own.select(
        F.monotonically_increasing_id().alias("id"), "file", "range", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"),
        F.first("line").over(whole).endswith("\r").alias("crlf")), "csv-ranges")


#: kinds of rows: a whole record; the open end of a range; lines that go on with or close a record
WHOLE, OPEN, MORE, CLOSE = 0, 1, 2, 3


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, range, number, kind, record): every record, header included, or its fragments.

    ``range`` and ``number`` tell where a record starts: the range, and its place among the
    records that start there.
    """
    lines = _lines(spark, path)
    parity = range_parities(lines).withColumnsRenamed({"file": "__file", "range": "__range"})
    # one row per range: the lines stay where they are, and each carries its range's number only
    known = lines.join(F.broadcast(parity), (F.col("file") == F.col("__file")) & (F.col("range") == F.col("__range")),
                       "left").select("value", F.when(
                           F.col("inside").isNull(), F.raise_error(F.lit("ranges changed between two reads")))
                       .otherwise(F.col("id")).alias("id"), "crlf", "inside")
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = None                # the range that is being read
        held: list[pa.Array] = []   # lines of the record that is open
        inside = head = False       # inside quotes; whether the open record began in an earlier range
        number = 0

        def out(kind, texts, first) -> pa.RecordBatch:
            n = len(texts)
            return pa.RecordBatch.from_arrays([
                pa.array([place] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()),
                pa.array([kind] * n, pa.int32()), texts], names=["id", "number", "kind", "record"])

        def whole() -> pa.Array:
            return pa.array(["\n".join(x for part in held for x in part.to_pylist())], pa.string())

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(1).to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for a, b in zip(starts, starts[1:]):
                if place != int(ids[a]):
                    if held:
                        yield out(MORE if head else OPEN, whole(), number)
                    inside = head = batch.column(3)[a].as_py()
                    place, held, number = int(ids[a]), [], 0
                values = batch.column(0).slice(a, b - a)
                if batch.column(2)[a].as_py():  # \r\n is one line break, which the reader of whole files turns into \n
                    values = pc.if_else(pc.ends_with(values, "\r"), pc.utf8_slice_codeunits(values, 0, -1), values)
                within = (np.cumsum(pc.count_substring(values, '"').to_numpy()) + inside) % 2 == 1
                inside = bool(within[-1])
                ends = np.flatnonzero(~within) + 1  # a record is complete behind these lines
                if not len(ends):
                    held.append(values)
                    continue
                held.append(values.slice(0, int(ends[0])))
                yield out(CLOSE if head else WHOLE, whole(), number)
                number += not head
                if len(ends) > 1:
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                    yield out(WHOLE, pc.binary_join(lists, "\n"), number)
                    number += len(ends) - 1
                rest = values.slice(int(ends[-1]))
                held, head = [rest] if len(rest) else [], False
        if held:
            yield out(MORE if head else OPEN, whole(), number)

    pieces = known.mapInArrow(run, "id long, number long, kind int, record string")
    ranges = parity.select("id", F.col("__file").alias("file"), F.col("__range").alias("range"))
    return pieces.join(F.broadcast(ranges), "id").select("file", "range", "number", "kind", "record")


def _joined(pieces: DataFrame) -> DataFrame:
    """Fragments put together: each belongs to the last open record before it in its file."""
    parts = pieces.where(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("range", (F.col("kind") == OPEN).cast("int"))
    begun = parts.withColumn("of", F.sum((F.col("kind") == OPEN).cast("int")).over(order))
    one = begun.groupBy("file", "of").agg(
        F.min_by(F.struct("range", "number"), F.struct("range", (F.col("kind") == OPEN).cast("int"))).alias("at"),
        F.sort_array(F.collect_list(F.struct("range", "record"))).alias("parts"))
    return one.select("file", "at.range", "at.number", F.array_join(F.col("parts.record"), "\n").alias("record"))


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Every column of a header CSV as text, any file read by as many tasks as it has ranges.

    ``columns`` are the names by the header (read from the files' first record if not given).
    A file that ends inside quotes keeps its last record as far as it goes.
    """
    if columns is None:
        columns = spark.read.option("header", True).option("multiLine", True).options(**PLAIN_VALUES).csv(path).columns
    pieces = materialize(records(spark, path), "csv-records")  # read for whole records and for fragments
    whole = pieces.where(F.col("kind") == WHOLE).select("file", "range", "number", "record")
    every = whole.unionByName(_joined(pieces))
    # a file's first record is its header; empty lines are no records
    body = every.where((F.col("range") > 0) | (F.col("number") > 0)).where("record <> ''")
    fields = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(columns))])
    parsed = body.select(F.from_csv("record", fields.simpleString()[7:-1].replace(":", " "), PLAIN_VALUES).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(columns)])


# ---- types ----------------------------------------------------------------------------------


def _verdicts(c: str) -> list:
    """What one aggregate must know of a column: over its values that are not missing."""
    x = F.col(f"`{c}`")
    there = x.isNotNull() & ~x.isin(*MISSING)
    number = F.btrim(x).try_cast("decimal(38,0)")
    integer = x.rlike(_INT)
    fits = number.between(-(1 << 63), (1 << 63) - 1)
    return [F.count_if(there).alias("n"), F.count_if(~there).alias("missing"),
            F.count_if(there & integer).alias("ints"),
            F.count_if(there & integer & F.coalesce(fits, F.lit(False))).alias("longs"),
            F.count_if(there & integer & F.coalesce(number.between(0, Decimal((1 << 64) - 1)), F.lit(False))).alias("unsigned"),
            F.count_if(there & (integer | x.rlike(_FLOAT))).alias("floats"),
            F.count_if(there & x.isin(*TRUE, *FALSE)).alias("booleans")]


def infer_types(df: DataFrame) -> dict[str, str]:
    """The type of each text column: bigint, decimal(20,0), double, boolean or string.

    Integers without a missing value are long (or unsigned, as decimal, beyond it; string if
    neither holds all); numbers with a missing value or a fraction are double, so is a column
    of missing values alone; booleans must be complete; the rest, and a column without
    rows, is string.  One aggregate, one row on the driver, whatever the number of rows.
    """
    if not df.columns:
        return {}
    row = df.agg(*[F.struct(*_verdicts(c)).alias(f"v{i}") for i, c in enumerate(df.columns)]).first()
    return {c: _type(row[f"v{i}"]) for i, c in enumerate(df.columns)}


def _type(v) -> str:
    if v["n"] == 0:
        return "double" if v["missing"] else "string"
    if v["ints"] == v["n"] and not v["missing"]:
        return "bigint" if v["longs"] == v["n"] else "decimal(20,0)" if v["unsigned"] == v["n"] else "string"
    if v["floats"] == v["n"]:
        return "double" if v["ints"] < v["n"] or v["longs"] == v["n"] or v["unsigned"] == v["n"] else "string"
    return "boolean" if v["booleans"] == v["n"] and not v["missing"] else "string"


def with_types(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Text columns cast to their (inferred) types; missing tokens are null in every column."""
    types = infer_types(df) if types is None else types

    def typed(c: str, kind: str):
        x = F.col(f"`{c}`")
        there = F.when(~x.isin(*MISSING), x)
        if kind == "string":
            return there.alias(c)
        return (there.isin(*TRUE) if kind == "boolean" else F.btrim(there).cast(kind)).alias(c)

    return df.select(*[typed(c, types.get(c, "string")) for c in df.columns])
