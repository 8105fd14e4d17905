"""Encoders (A2, O3, E1-E5, J3, D4) and list functions."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from vellum.functions import lists as L
from vellum.operators import encode

LABELS = [("train", "b"), ("train", "a"), ("train", "c"), ("train", "a"),
          ("test", "a"), ("test", "unseen"), ("test", None)]


def test_fit_classes_sorted_code_points(spark):
    df = spark.createDataFrame([("b",), ("a",), ("B",), ("é",), ("a",), (None,)], "c string")
    assert encode.fit_classes(df, "c") == sorted({"b", "a", "B", "é"})


def test_strict_encoder_codes_and_error(spark):
    df = spark.createDataFrame(LABELS, "split string, c string")
    train = df.where("split = 'train'")
    enc = encode.fit_label_encoder(train, "c", "code")
    got = [(r["c"], r["code"]) for r in enc.transform(train).collect()]
    assert sorted(set(got)) == [("a", 0), ("b", 1), ("c", 2)]
    with pytest.raises(Exception):
        enc.transform(df.where("split = 'test'")).collect()


def test_default_encoder_unseen_and_null(spark):
    df = spark.createDataFrame(LABELS, "split string, c string")
    enc = encode.fit_label_encoder(df.where("split = 'train'"), "c", "code", on_unseen="default")
    got = [r["code"] for r in enc.transform(df.where("split = 'test'")).collect()]
    assert got == [0, -1, -1]


def test_code_table_lookup_matches_encoder(spark):
    df = spark.createDataFrame(LABELS, "split string, c string")
    classes = encode.fit_classes(df.where("split = 'train'"), "c")
    codes = encode.code_table(spark, classes)
    got = encode.lookup_codes(df, codes, "c", "code").orderBy("split", "c").collect()
    by_label = {r["c"]: r["code"] for r in got}
    assert by_label == {"a": 0, "b": 1, "c": 2, "unseen": -1, None: -1}


def test_codes_are_a_bijection(spark, sf001):
    part = spark.read.parquet(f"{sf001}/part.parquet")
    enc = encode.fit_label_encoder(part, "p_brand", "code")
    pairs = enc.transform(part).select("p_brand", "code").distinct().collect()
    codes = sorted(r["code"] for r in pairs)
    assert codes == list(range(len(codes)))
    assert len({r["p_brand"] for r in pairs}) == len(codes)


def test_label_encoder_roundtrip(spark, tmp_path):
    df = spark.createDataFrame(LABELS, "split string, c string")
    enc = encode.fit_label_encoder(df.where("split = 'train'"), "c", "code", on_unseen="default")
    enc.save(spark, str(tmp_path / "enc"))
    back = encode.LabelEncoderModel.load(spark, str(tmp_path / "enc"))
    assert (back.col, back.out, back.on_unseen, back.default) == (enc.col, enc.out, enc.on_unseen, enc.default)
    table = sorted(tuple(r) for r in back.code_table(spark).collect())
    assert table == sorted(tuple(r) for r in enc.code_table(spark).collect()) and len(table) == 3


def test_encoder_without_classes_keeps_its_settings(spark, tmp_path):
    empty = spark.createDataFrame([], "c string")
    encode.fit_label_encoder(empty, "c", "code", on_unseen="default", default=-7).save(spark, str(tmp_path / "e"))
    back = encode.LabelEncoderModel.load(spark, str(tmp_path / "e"))
    assert (back.col, back.out, back.on_unseen, back.default) == ("c", "code", "default", -7)
    assert back.transform(spark.createDataFrame([("x",)], "c string")).first()["code"] == -7


def test_vocabulary_bound_is_an_error_and_the_join_form_has_none(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["c", None]), (3, []), (4, None)], "id int, t array<string>")
    with pytest.raises(ValueError, match="fit_code_table"):
        encode.fit_classes(df, "t", multi=True, max_classes=2)
    codes = encode.fit_code_table(df.where("id < 2"), "t", multi=True)
    got = {r["id"]: r["s"] for r in encode.multi_hot_codes(df, codes, "id", "t", "s").collect()}
    assert got == {1: [0, 1], 2: [], 3: [], 4: []}


def test_multi_hot_ignores_unseen_and_collapses_duplicates(spark):
    train = spark.createDataFrame([(["b", "a"],), (["c"],), ([],)], "t array<string>")
    test = spark.createDataFrame([(["a", "a", "zzz"],), ([],)], "t array<string>")
    cv = encode.fit_multi_hot(train, "t", "v")
    assert cv.vocabulary == ["a", "b", "c"]
    assert encode.feature_names("tags_", cv.vocabulary) == ["tags_a", "tags_b", "tags_c"]
    got = [r[0] for r in cv.transform(test).select(vector_to_array("v")).collect()]
    assert got == [[1.0, 0.0, 0.0], [0.0, 0.0, 0.0]]
    wide = L.membership("t", cv.vocabulary, "tags_")
    row = test.select(*[c.alias(n) for n, c in wide.items()]).first()
    assert row.asDict() == {"tags_a": 1, "tags_b": 0, "tags_c": 0}


LIST_EDGE = [(1, "[]"), (2, "['a']"), (3, "['a', 'a', 'b']"), (4, None)]


def test_list_literal_parse(spark):
    df = spark.createDataFrame(LIST_EDGE, "id int, v string")
    got = [r[0] for r in df.orderBy("id").select(L.parse_list_literal("v")).collect()]
    assert got == [[], ["a"], ["a", "a", "b"], None]


def test_list_literal_malformed(spark):
    df = spark.createDataFrame([(1, "['a', ")], "id int, v string")
    with pytest.raises(Exception):
        df.select(L.parse_list_literal("v")).collect()
    assert df.select(L.parse_list_literal("v", strict=False)).first()[0] is None


def test_list_literal_roundtrip(spark):
    df = spark.createDataFrame([(["x", "y"],), ([],)], "a array<string>")
    lit = [r[0] for r in df.select(L.to_list_literal("a")).collect()]
    assert lit == ["['x', 'y']", "[]"]
    back = spark.createDataFrame([(s,) for s in lit], "s string").select(L.parse_list_literal("s"))
    assert [r[0] for r in back.collect()] == [["x", "y"], []]


def test_distributed_code_table_equals_sorted_classes(spark, sf001):
    orders = spark.read.parquet(f"{sf001}/orders.parquet").select(
        F.col("o_custkey").cast("string").alias("a"))
    want = {v: i for i, v in enumerate(encode.fit_classes(orders, "a"))}
    got = {r["value"]: r["code"] for r in encode.fit_code_table(orders, "a", partitions=5).collect()}
    assert got == want


def test_list_literal_strict_reads_the_whole_value(spark):
    import ast
    good = ["[]", " [ 'a' , \"b\" ,] ", r'''['it\'s', "say \"x\"", 'tab\there', 'b\\s']''', r"['\xa0x', '\u00e9']",
            "['a', None]", "['[x, y]', ',']", "['None', '\"']", "['" + "long " * 20_000 + "']",
            "[" + ", ".join(f"'{i}'" for i in range(5000)) + "]"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(good)], "id int, v string")
    got = [r[0] for r in df.orderBy("id").select(L.parse_list_literal("v")).collect()]
    assert got == [ast.literal_eval(s.strip()) for s in good]
    for bad in ["", "['a'] junk", "['a' 'b']", "x", "['a',, 'b']", "[,]", "'a'", "['a'"]:
        one = spark.createDataFrame([(bad,)], "v string")
        with pytest.raises(Exception):
            one.select(L.parse_list_literal("v")).collect()
        assert one.select(L.parse_list_literal("v", strict=False)).first()[0] is None
