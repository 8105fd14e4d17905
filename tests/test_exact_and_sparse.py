"""Exact-size hold-out and sparse vectors without a driver vocabulary."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from vellum.operators import encode, model, split


def smallest(keys, k, seed=split.SEED):
    h = lambda x: int(hashlib.md5(f"{seed}:{'' if x is None else x}".encode()).hexdigest()[:15], 16)
    return sorted(sorted(map(h, keys))[:k])


@pytest.mark.parametrize("n", [0, 1, 3, 10, 1003])
def test_holdout_has_the_exact_size(spark, n):
    df = spark.createDataFrame([(i, i % 7) for i in range(n)], "id long, x long")
    out = split.exact_holdout_flag(df, "id").repartition(3)
    held = [r["id"] for r in out.where("is_test").collect()]
    assert len(held) == math.ceil(0.3 * n) and out.count() == n
    h = lambda x: int(hashlib.md5(f"42:{x}".encode()).hexdigest()[:15], 16)
    assert sorted(map(h, held)) == smallest(range(n), len(held))
    again = split.exact_holdout_flag(df.repartition(5), "id").where("is_test").collect()
    assert sorted(held) == sorted(r["id"] for r in again)


def test_holdout_with_repeated_and_null_keys(spark):
    rows = [(5, i) for i in range(60)] + [(None, i) for i in range(20)] + [(i, 0) for i in range(100, 120)]
    df = spark.createDataFrame(rows, "id long, x long")
    train, test = split.exact_split(df, "id")
    assert (test.count(), train.count()) == (30, 70)
    assert sorted(map(tuple, train.unionByName(test).collect()), key=repr) == sorted(rows, key=repr)
    with_copies = spark.createDataFrame([(1, 1)] * 10, "id long, x long")
    assert split.exact_split(with_copies, "id")[1].count() == 3


def test_sparse_vectors_equal_the_driver_form(spark):
    rows = [(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["zz", "c"]), (5, ["é"])]
    df = spark.createDataFrame(rows, "id int, tags array<string>")
    out, codes = encode.fit_multi_hot_vectors(df, "id", "tags", "vec")
    want = encode.fit_multi_hot(df.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))), "tags", "vec")
    expected = {r["id"]: r["vec"].toArray().tolist() for r in want.transform(
        df.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))).collect()}
    assert {r["id"]: r["vec"].toArray().tolist() for r in out.collect()} == expected
    names = [r["name"] for r in encode.slot_names(codes, "tags_", 3).orderBy("slot").collect()]
    assert names == encode.feature_names("tags_", want.vocabulary)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_forest_reads_sparse_vectors_and_names_by_join(spark):
    rows = [(i, [f"t{i % 5}", f"u{i % 3}"], float(i % 5 == 2) * 10) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, tags array<string>, y double")
    params = model.ForestParams(num_trees=2, max_depth=2, bootstrap=False)
    out, codes = encode.fit_multi_hot_vectors(df, "id", "tags", "vec")
    forest = model.forest_of(model.fit_forest(out, ["vec"], "y", params))
    got = [(r["name"], round(r["value"], 9)) for r in
           model.importances_by_slot(forest, encode.slot_names(codes, "tags_")).collect()]
    driver = encode.fit_multi_hot(df, "tags", "vec")
    other = model.forest_of(model.fit_forest(driver.transform(df), ["vec"], "y", params))
    want = model.importance_table(spark, other, encode.feature_names("tags_", driver.vocabulary)).collect()
    assert got == [(r["name"], round(r["value"], 9)) for r in want] and got[0] == ("tags_t2", 1.0)
