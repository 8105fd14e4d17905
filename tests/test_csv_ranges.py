"""Parallel CSV with quoted line breaks, column types, positional merges."""

import io
import random

import pandas as pd
import pytest

from vellum.sources import articles as A
from vellum.sources import csv_ranges as R


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of a few hundred bytes, so that records cross them."""
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0",
            "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def awkward_frame(rows: int, seed: int) -> pd.DataFrame:
    rng = random.Random(seed)
    def text():
        return "".join(rng.choice(["a", '"', ",", "\n", " ", "é", "long words ", "\n\n", '""']) for _ in range(rng.randrange(40)))
    table = [{"id": str(i), "x": text(), "y": text(), "z": rng.choice(["", "v"])} for i in range(rows)]
    table[rows // 2]["x"] = "line\n" * 400 + '"'  # one record over many ranges
    return pd.DataFrame(table)


def whole_reader(spark, path):
    return (spark.read.option("header", True).option("multiLine", True).options(**R.PLAIN_VALUES).csv(path))


@pytest.mark.parametrize("crlf", [False, True])
def test_many_tasks_read_what_one_task_reads(spark, tmp_path, small_ranges, crlf):
    folder = tmp_path / "csv"
    folder.mkdir()
    for k in range(3):
        body = awkward_frame(120, k).to_csv(index=False, lineterminator="\n")
        (folder / f"part-{k}.csv").write_bytes((body.replace("\n", "\r\n") if crlf else body).encode())
    (folder / "part-9.csv").write_bytes(b"id,x,y,z\n" if not crlf else b"id,x,y,z\r\n")
    got = R.read_csv(spark, str(folder))
    want = whole_reader(spark, str(folder))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert got.count() == 360 and got.columns == want.columns
    assert R._lines(spark, str(folder)).rdd.getNumPartitions() > 50 > want.rdd.getNumPartitions()
    kinds = {r["kind"] for r in R.records(spark, str(folder)).select("kind").distinct().collect()}
    assert kinds == {R.WHOLE, R.OPEN, R.MORE, R.CLOSE}


def test_a_file_that_ends_inside_quotes_keeps_its_rest(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_text('a,b\n1,x\n2,"open\n' + "more\n" * 100)
    rows = R.read_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [r["a"] for r in rows] == ["1", "2"] and rows[1]["b"].count("more") == 100


def test_types_equal_the_reference_reader(spark, tmp_path):
    cols = {
        "ints": ["1", "-2", " 3"], "gaps": ["1", "", "3"], "floats": ["1.5", "2", "-3e4"], "dots": [".5", "5.", "1"],
        "infs": ["inf", "-Infinity", "1"], "bools": ["True", "false", "TRUE"], "boolgap": ["True", "", "False"],
        "words": ["a", "1", "2"], "empty": ["", "", ""], "tokens": ["NA", "null", "4"], "big": ["9223372036854775808", "1", "2"],
        "huge": ["18446744073709551616", "1", "2"], "mixed": ["9223372036854775808", "-1", "2"], "hex": ["0x1", "1", "2"],
        "plus": ["+1", "2", "3"], "nulltext": ["nan", "x", "y"], "under": ["1_0", "2", "3"],
    }
    frame = pd.DataFrame(cols)
    body = frame.to_csv(index=False)
    (tmp_path / "t.csv").write_text(body)
    want = pd.read_csv(io.StringIO(body)).dtypes
    kinds = {"int64": "bigint", "uint64": "decimal(20,0)", "float64": "double", "bool": "boolean", "object": "string", "str": "string"}
    got = A.read_inferred_csv(spark, str(tmp_path / "t.csv"))
    assert dict(got.dtypes) == {c: kinds[str(t)] for c, t in want.items()}
    assert [r["gaps"] for r in got.collect()] == [1.0, None, 3.0] and got.first()["ints"] == 1
    assert R.infer_types(spark.createDataFrame([], "a string")) == {"a": "string"}


def test_positional_merge_pairs_by_place(spark):
    left = spark.createDataFrame([(i, i * 10) for i in range(50)], "id int, v int").repartitionByRange(5, "id").sortWithinPartitions("id")
    right = spark.createDataFrame([(i, str(i)) for i in range(40)], "v int, w string").repartitionByRange(3, "v").sortWithinPartitions("v")
    got = A.positional_merge(left, right)
    assert got.columns == ["id", "v_x", "v_y", "w"]
    assert sorted(map(tuple, got.collect())) == [(i, i * 10, i, str(i)) for i in range(40)]
