"""Text functions against plain-Python twins written from the documented semantics."""

import re

import pytest
from pyspark.sql import functions as F

from vellum.functions import text as T

TEXT_EDGE = [
    (1, ""),
    # 10 words (dropped) and 11 words (kept)
    (2, "one two three four five six seven eight nine ten. "
        "one two three four five six seven eight nine ten eleven. tail"),
    (3, "a b c d e f g h i j k l m\n\n\nx y z"),
    (4, "no.space here one two three four five six seven eight nine ten eleven"),
    (5, "   \n  \n"),
    (6, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12\nv1 v2 v3 v4 v5 v6 v7 v8 v9 v10 v11. "
        "u1\tu2\x0bu3\x1cu4 u5 u6 u7 u8 u9 u10 u11 u12 u13"),
]


def twin_sentence_stats(text):
    lens = [len(s.split()) for s in re.split(r"\. |\n+", text) if s.strip()]
    lens = [n for n in lens if n > 10]
    if not lens:
        return 0.0, 0, 0
    return sum(lens) / len(lens), max(lens), min(lens)


def test_sentence_stats_match_twin(spark):
    df = spark.createDataFrame(TEXT_EDGE, "doc_id int, text string")
    rows = T.with_sentence_stats(df, "text").orderBy("doc_id").collect()
    for (i, text), r in zip(TEXT_EDGE, rows):
        avg, mx, mn = twin_sentence_stats(text)
        assert r["avg_sentence_len"] == pytest.approx(avg), i
        assert (r["max_sentence_len"], r["min_sentence_len"]) == (mx, mn), i
        assert r["min_sentence_len"] <= r["avg_sentence_len"] <= max(r["max_sentence_len"], 0)


def test_text_length_counts_code_points(spark):
    df = spark.createDataFrame([("a\U0001F600b",)], "t string")
    assert df.select(T.text_length("t")).first()[0] == len("a\U0001F600b") == 3


def test_whitespace_set_equals_python_isspace(spark):
    chars = [chr(c) for c in range(0x10000) if not 0xD800 <= c <= 0xDFFF]
    probe = ["x" + c + "y" for c in chars]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(probe)], "i int, s string")
    got = {r["i"]: r["n"] for r in df.select("i", T.word_count(F.col("s")).alias("n")).collect()}
    for i, s in enumerate(probe):
        assert got[i] == len(s.split()), hex(ord(chars[i]))


LINES_EDGE = [
    (1, "Pro line here\nkept line one\nРоссия Москва Мир marker\nafter marker line"),
    (2, "first kept line\nsecond kept line"),
    (3, "Читайте на РБК Pro\nkept after marker"),
    (4, "kept before\nРоссия Москва Мир\nmiddle line\nЧитайте на РБК Pro again\nlast kept line"),
    (5, "single\n\ttab\tjoined\ndouble  space\n leading space\n  \nend line here"),
    (6, ""),
    (7, "www.example one\nSource: x\nИсточник: y z\n0 (за сутки) a\nЧитать подробнее b c"),
]


def twin_cleaned(text, prefixes=T.BOILERPLATE_PREFIXES, markers=T.SECTION_MARKERS):
    full, before, seen = [], [], False
    for line in text.split("\n"):
        if any(line.startswith(m) for m in markers):
            seen = True
        drop = any(line.startswith(p) for p in prefixes) or len(line.strip(" ").split(" ")) == 1
        if not drop:
            full.append(line)
            if not seen:
                before.append(line)
    f, b = " ".join(full), " ".join(before)
    return f, len(b) / max(1, len(f)), len(f), len(b)


def test_cleaned_text_matches_twin(spark):
    df = spark.createDataFrame(LINES_EDGE, "doc_id int, text string")
    rows = T.with_cleaned_text(df, "text").orderBy("doc_id").collect()
    for (i, text), r in zip(LINES_EDGE, rows):
        f, ratio, lf, lb = twin_cleaned(text)
        assert r["full_cleaned_text"] == f, i
        assert r["before_pro_text_ratio"] == pytest.approx(ratio), i
        assert (r["cleaned_text_length"], r["cleaned_text_before_pro_length"]) == (lf, lb), i
        assert lb <= lf


def test_custom_prefixes_and_no_markers(spark):
    df = spark.createDataFrame(LINES_EDGE, "doc_id int, text string")
    rows = T.with_cleaned_text(df, "text", prefixes=("kept",), markers=()).orderBy("doc_id").collect()
    for (i, text), r in zip(LINES_EDGE, rows):
        assert r["full_cleaned_text"] == twin_cleaned(text, ("kept",), ())[0], i


def test_article_id_prefix(spark):
    df = spark.createDataFrame([("0123456789abcdef01234567XYZ",), ("short",), (None,)], "d string")
    assert [r[0] for r in df.select(T.article_id("d")).collect()] == \
        ["0123456789abcdef01234567", "short", None]


def test_flatten_once(spark):
    df = spark.createDataFrame([([["a", "b"], [], ["c"]],)], "x array<array<string>>")
    assert df.select(T.flatten_once("x")).first()[0] == ["a", "b", "c"]


def test_an_empty_text_has_the_cleaned_values_written_down(spark):
    rows = spark.createDataFrame([(1, ""), (2, None), (3, " "), (4, "An x y\nOn z\nk l")], "id int, text string")
    for prefixes, markers in ((("An",), ("On",)), (("",), ("",)), (("x",), ())):
        plain = rows.select("id", *[c.alias(k) for k, c in T.cleaned_text_features("text", prefixes, markers).items()])
        short = T.with_cleaned_text(rows, "text", prefixes, markers).drop("text")
        assert sorted(plain.collect()) == sorted(short.collect()) and plain.dtypes == short.dtypes
        assert dict(zip(short.columns[1:], short.where("id = 1").first()[1:])) == T.EMPTY_CLEANED
    plan = T.with_cleaned_text(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN (text") >= 3
