"""Categorical encoders.

A fitted label encoder is a ``(value, code)`` table, coded distributed (``fit_code_table``)
and stored in the shared folder; no label passes the driver.  It is applied by one left
join, whatever its size: the planner knows the stored table's bytes and broadcasts it only
below ``spark.sql.autoBroadcastJoinThreshold``, else AQE handles hot labels.

Multi-label vocabularies (E4) come in two forms: a fitted ``CountVectorizerModel``, whose
vocabulary is on the driver and therefore bounded by ``max_classes``, and
``multi_hot_codes``, sparse slots by a join to a code table of any size, which
``sparse_vectors`` turns into the vectors that a forest reads.

Unseen-label policies, one per reference encoder:

* ``"error"``   - E1/E2: the job fails on an unseen or null label.
* ``"default"`` - E3: unseen and null labels get ``default`` (-1).
* multi-hot (E4) silently ignores unseen elements and collapses duplicates.

``transform(observation=...)`` counts unseen and null labels in the scoring pass itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.session import materialize, scratch_path

#: Most classes that are gathered into a driver-side vocabulary; more is an error.
MAX_CLASSES = 1_000_000


# --- A2 ---------------------------------------------------------------------
def fit_classes(df: DataFrame, col: str, multi: bool = False,
                max_classes: int = MAX_CLASSES) -> list[str]:
    """Sorted distinct non-null labels (code-point order), or elements when ``multi``.

    The distinct runs distributed with a map-side partial aggregate, so a hot label
    is collapsed inside each task before the shuffle.  Only the distinct values reach
    the driver, where they are sorted: Python's string order is code-point order,
    the same as Spark's binary (UTF-8) order, so no extra sort job is needed.
    """
    return fit_classes_many(df, [col], {col} if multi else set(), max_classes)[col]


def _tagged(c: str):
    return lambda x: F.struct(F.lit(c).alias("c"), x.cast("string").alias("v"))


def fit_classes_many(df: DataFrame, cols: Sequence[str], multi: set | frozenset = frozenset(),
                     max_classes: int = MAX_CLASSES) -> dict[str, list[str]]:
    """A2 for several columns in one scan: one ``(column, value)`` array per row, exploded.

    More than ``max_classes`` values in all raise an error that names the code-table form.
    """
    parts = []
    for c in cols:
        if c in multi:
            parts.append(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")),
                                     _tagged(c)))
        else:
            parts.append(F.array(F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v"))))
    both = parts[0] if len(parts) == 1 else F.concat(*parts)
    u = df.select(F.explode(both).alias("p")).select("p.c", "p.v")
    rows = u.where(F.col("v").isNotNull()).distinct().limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        raise ValueError(f"more than {max_classes} classes in {list(cols)}: use fit_code_table "
                         "(multi=True) and multi_hot_codes, which keep them distributed")
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in rows:
        out[r["c"]].append(r["v"])
    return {c: sorted(v) for c, v in out.items()}


# --- E1 / E2 / E3 -----------------------------------------------------------
class LabelEncoderModel:
    """Fitted encoder: label -> position in the sorted classes, as an int column.

    Held as a ``(value, code)`` table, given directly or as a class list, and applied by
    a left join.  The output has no nominal ML metadata, so tree learners treat codes as
    ordered numbers (as the reference does).
    """

    def __init__(self, classes: Sequence[str] | None, col: str, out: str | None = None,
                 on_unseen: str = "error", default: int = -1, codes: DataFrame | None = None):
        if on_unseen not in ("error", "default"):
            raise ValueError("on_unseen must be 'error' or 'default'")
        if classes is None and codes is None:
            raise ValueError("give classes or a code table")
        self.classes = list(classes) if classes is not None else None
        self.codes = codes
        self.col, self.out = col, out or col
        self.on_unseen, self.default = on_unseen, int(default)

    def code_table(self, spark: SparkSession) -> DataFrame:
        if self.codes is not None:
            return self.codes.select("value", "code")
        return code_table(spark, self.classes)

    def transform(self, df: DataFrame, observation: Observation | None = None) -> DataFrame:
        """The codes; an ``observation`` gets rows, unseen (not null) and null labels of the pass.

        It is filled by the first action on the result, without a job of its own.
        """
        codes = self.code_table(df.sparkSession)
        if observation is not None:
            label, unseen = F.col(self.col), F.col("__code").isNull()
            joined = _joined(df, codes, self.col).observe(
                observation, F.count("*").alias("rows"), F.count_if(unseen & label.isNotNull()).alias("unseen"),
                F.count_if(label.isNull()).alias("nulls"))
            if self.on_unseen == "default":
                return joined.withColumn(self.out, F.coalesce("__code", F.lit(self.default)).cast("int")).drop(
                    "__k", "__code")
            return self._checked(joined)
        if self.on_unseen == "default":
            return lookup_codes(df, codes, self.col, self.out, self.default)
        return self._checked(_joined(df, codes, self.col))

    def _checked(self, joined: DataFrame) -> DataFrame:
        label = F.col(self.col).cast("string")
        code = F.when(F.col("__code").isNull(), F.raise_error(F.concat(
            F.lit(f"unseen or null label in {self.col}: "),
            F.coalesce(label, F.lit("NULL"))))).otherwise(F.col("__code"))
        return joined.withColumn(self.out, code.cast("int")).drop("__k", "__code")

    def save(self, spark: SparkSession, path: str) -> None:
        """The code table, and a one-row table of the settings (an encoder may have no class)."""
        self.code_table(spark).write.mode("overwrite").parquet(f"{path}/codes")
        spark.createDataFrame([(self.col, self.out, self.on_unseen, self.default)],
                              "col string, out string, on_unseen string, default int") \
            .write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LabelEncoderModel:
        r = spark.read.parquet(f"{path}/settings").first()
        return cls(None, r["col"], r["out"], r["on_unseen"], r["default"],
                   codes=spark.read.parquet(f"{path}/codes"))


def observed_multi_hot(df: DataFrame, classes: Sequence[str], col: str, observation: Observation) -> DataFrame:
    """``df``, with its elements outside ``classes`` counted in the pass that reads it next.

    The reference's encoder warns of them; the counts are ``elements`` and ``unseen``
    (distinct within a row, as the encoder sees them).
    """
    held = F.array_distinct(F.coalesce(F.col(col), F.array().cast("array<string>")))
    known = F.filter(held, lambda x: x.isin(list(classes)))
    return df.observe(observation, F.sum(F.size(held)).alias("elements"),
                      F.sum(F.size(held) - F.size(known)).alias("unseen"))


def fit_label_encoder(df: DataFrame, col: str, out: str | None = None,
                      on_unseen: str = "error", default: int = -1) -> LabelEncoderModel:
    """A2 + E1 / E3 fit: the distinct labels coded distributed, stored once."""
    return LabelEncoderModel(None, col, out, on_unseen, default, codes=fit_code_table(df, col))


# --- O3 / J3 ----------------------------------------------------------------
def fit_code_table(df: DataFrame, col: str, partitions: int | None = None,
                   value_col: str = "value", code_col: str = "code", multi: bool = False
                   ) -> DataFrame:
    """O3 fully distributed: dense codes over the sorted distinct values of ``col``.

    ``multi`` codes the elements of an array column.  Distinct values are range
    partitioned (partition ``i`` holds only values below those of ``i + 1``), written
    to the shared checkpoint folder so partition ids are fixed, numbered inside their
    partition, and shifted by the number of values in lower partitions - a table with
    one row per partition.  The final codes are written once; no step gathers the values.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    value = F.explode(F.col(col)) if multi else F.col(col)
    distinct = df.select(value.alias("__v")).select(F.col("__v").cast("string").alias("__v")).where(
        F.col("__v").isNotNull()).distinct()
    ranged = materialize(distinct.repartitionByRange(n, "__v")
                         .withColumn("__pid", F.spark_partition_id()), "values")
    local = ranged.withColumn(
        "__rn", F.row_number().over(Window.partitionBy("__pid").orderBy("__v")))
    sizes = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    below = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__pid", F.coalesce(F.sum("__n").over(below), F.lit(0))
                           .alias("__off"))  # one row per partition
    return materialize(local.join(F.broadcast(offsets), "__pid").select(
        F.col("__v").alias(value_col),
        (F.col("__off") + F.col("__rn") - 1).cast("int").alias(code_col)), "codes")


def code_table(spark: SparkSession, classes: Sequence[str], value_col: str = "value",
               code_col: str = "code") -> DataFrame:
    """``(value, code)`` table of a fitted class list (the persisted encoder form)."""
    return spark.createDataFrame([(v, i) for i, v in enumerate(classes)],
                                 f"`{value_col}` string, `{code_col}` int")


def _joined(df: DataFrame, codes: DataFrame, key: str, value_col: str = "value",
            code_col: str = "code") -> DataFrame:
    """Left join to a code table as ``__k``, ``__code``; the planner picks the join by bytes."""
    right = codes.select(F.col(value_col).alias("__k"), F.col(code_col).alias("__code"))
    return df.join(right, df[key].cast("string") == right["__k"], "left")


def lookup_codes(df: DataFrame, codes: DataFrame, key: str, out: str, default: int = -1,
                 value_col: str = "value", code_col: str = "code") -> DataFrame:
    """Dictionary lookup with a default: left join to a code table + coalesce."""
    return (_joined(df, codes, key, value_col, code_col)
            .withColumn(out, F.coalesce(F.col("__code"), F.lit(default)).cast("int"))
            .drop("__k", "__code"))


# --- E4 / E5 ----------------------------------------------------------------
def multi_hot_encoder(classes: Sequence[str], col: str, out: str) -> CountVectorizerModel:
    """Presence vector over sorted classes: duplicates collapse, unseen are ignored."""
    return CountVectorizerModel.from_vocabulary(list(classes), inputCol=col, outputCol=out,
                                                binary=True)


def fit_multi_hot(df: DataFrame, col: str, out: str) -> CountVectorizerModel:
    return multi_hot_encoder(fit_classes(df, col, multi=True), col, out)


def multi_hot_codes(df: DataFrame, codes: DataFrame, key: str, col: str, out: str) -> DataFrame:
    """E4 for vocabularies of any size: the sorted slots of each row's presence vector.

    ``key`` identifies a row.  Elements are joined to the code table and folded by key;
    unseen elements are ignored, duplicates collapse, a row without any has no slots.
    """
    seen = (df.select(F.col(key).alias("__row"), F.explode(F.array_distinct(col)).alias("value"))
            .join(codes.select("value", "code"), "value")
            .groupBy("__row").agg(F.sort_array(F.collect_set("code")).alias("__slots")))
    return (df.join(seen, df[key] == seen["__row"], "left")
            .withColumn(out, F.coalesce("__slots", F.array().cast("array<int>")))
            .drop("__row", "__slots"))


def sparse_vectors(df: DataFrame, slots: str, size: int, out: str) -> DataFrame:
    """``df`` with slots of ones as an ML sparse vector column, built in the JVM; stored.

    A vector is stored as (type, size, indices, values), and read back under the vector type,
    so no row passes Python and no vocabulary the driver.
    """
    parts = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"), F.col(slots).alias("indices"),
                     F.transform(slots, lambda _: F.lit(1.0)).alias("values"))
    stored = df.withColumn(out, parts)
    path = scratch_path(df.sparkSession, "vectors")
    stored.write.parquet(path)
    fields = [T.StructField(out, VectorUDT()) if f.name == out else f for f in stored.schema.fields]
    return df.sparkSession.read.schema(T.StructType(fields)).parquet(path)


def fit_multi_hot_vectors(df: DataFrame, key: str, col: str, out: str) -> tuple[DataFrame, DataFrame]:
    """(``df`` with the presence vector of ``col``, its stored code table), any vocabulary."""
    codes = fit_code_table(df, col, multi=True)
    slots = multi_hot_codes(df, codes, key, col, "__slots_of")
    return sparse_vectors(slots, "__slots_of", max(1, codes.count()), out).drop("__slots_of"), codes


def slot_names(codes: DataFrame, prefix: str, first_slot: int = 0) -> DataFrame:
    """E5 as a table: ``(slot, name)`` of the vector block that a code table stands for."""
    return codes.select((F.col("code") + first_slot).alias("slot"), F.concat(F.lit(prefix), "value").alias("name"))


def feature_names(prefix: str, classes: Sequence[str]) -> list[str]:
    """E5: ``prefix + class`` for every slot, in vector order."""
    return [f"{prefix}{c}" for c in classes]
