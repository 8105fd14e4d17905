"""Registered queries over tables in files, positions, exact splits, phrases and sparse vectors."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Observation
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import encode, entities, model, split
from vellum.session import scratch_path
from vellum.sources import articles as A
from vellum.sources import csv_ranges


def _t(spark, d, name):
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


# --- S1: quoted line breaks, types --------------------------------------------------------
_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
        "emptyValue": '""'}


def q_csv_multiline(spark, d):
    """Texts with quotes, separators and line breaks, written as CSV and read by byte ranges."""
    x = F.concat(F.lit('"'), F.replace("text", F.lit(" "), F.lit(' \n"')), F.lit(",\n"))
    path = scratch_path(spark, "csv-multiline")
    _t(spark, d, "documents").select("doc_id", x.alias("body"), "lang").write.options(**_CSV).csv(path)
    back = csv_ranges.read_csv(spark, path)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.col("body").cast("binary")).alias("body_md5"),
                       F.length("body").cast("long").alias("n_chars"), "lang")


SQL_CSV_MULTILINE = r"""
WITH x AS (SELECT doc_id, lang, '"' || replace(text, ' ', ' ' || chr(10) || '"') || ',' || chr(10) AS body FROM documents)
SELECT doc_id, md5(body) AS body_md5, CAST(length(body) AS BIGINT) AS n_chars, lang FROM x"""

#: column -> its text in Spark SQL and DuckDB alike, over ``events``
_TYPED = {
    "whole": "CAST(event_id AS STRING)",
    "gaps": "CASE WHEN event_id % 5 = 0 THEN 'NA' ELSE CAST(user_id AS STRING) END",
    "fraction": "CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS STRING) ELSE '-1.5e3' END",
    "flag": "CASE WHEN value > 10 THEN 'True' ELSE 'False' END",
    "flag_gaps": "CASE WHEN event_id % 3 = 0 THEN '' WHEN value > 10 THEN 'True' ELSE 'False' END",
    "unsigned": "CASE WHEN event_id % 2 = 0 THEN '18446744073709551615' ELSE '0' END",
    "words": "event_type",
    "missing": "CASE WHEN value > 0 THEN 'null' ELSE 'nan' END",
    "few_words": "CASE WHEN event_id = (SELECT max(event_id) FROM events) THEN 'x' ELSE '1' END",
}


def q_csv_types(spark, d):
    """The inferred type and the number of values of each column of a CSV written from ``events``."""
    path = scratch_path(spark, "csv-types")
    _t(spark, d, "events").createOrReplaceTempView("events")
    cols = ", ".join(f"{x} AS {c}" for c, x in _TYPED.items())
    try:
        spark.sql(f"SELECT {cols} FROM events").write.options(**_CSV).csv(path)
    finally:
        spark.catalog.dropTempView("events")
    typed = A.read_inferred_csv(spark, path)
    kinds = dict(typed.dtypes)
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(k).alias("type"), F.col(c).isNotNull().alias("there"))
                              for c, k in kinds.items()])).alias("v")
    return typed.select(one).groupBy("v.name", "v.type").agg(F.count_if("v.there").alias("n_values"))


def _sql_types() -> str:
    missing = ", ".join("'" + m + "'" for m in csv_ranges.MISSING)
    one = []
    for c, x in _TYPED.items():
        x = x.replace("STRING", "VARCHAR")
        one.append(f"SELECT '{c}' AS name, {x} AS v FROM events")
    return f"""
WITH x AS ({' UNION ALL '.join(one)}),
y AS (SELECT name, CASE WHEN v NOT IN ({missing}) THEN v END AS v FROM x),
a AS (
  SELECT name, count(v) AS n, count(*) - count(v) AS gaps,
         count(*) FILTER (regexp_full_match(v, '[+-]?[0-9]+')) AS ints, bool_and(TRY_CAST(v AS BIGINT) IS NOT NULL)
           FILTER (v IS NOT NULL) AS longs, bool_and(TRY_CAST(v AS UBIGINT) IS NOT NULL) FILTER (v IS NOT NULL) AS unsigned,
         count(*) FILTER (TRY_CAST(v AS DOUBLE) IS NOT NULL) AS floats,
         count(*) FILTER (lower(v) IN ('true', 'false')) AS flags
  FROM y GROUP BY name)
SELECT name, CASE WHEN n = 0 THEN 'double' WHEN ints = n AND gaps = 0 AND longs THEN 'bigint'
  WHEN ints = n AND gaps = 0 AND unsigned THEN 'decimal(20,0)' WHEN floats = n THEN 'double'
  WHEN flags = n AND gaps = 0 THEN 'boolean' ELSE 'string' END AS type, n AS n_values
FROM a"""


# --- J1 / J2: frames without a key ----------------------------------------------------------
def q_positional_merge(spark, d):
    """Orders by key beside customers by name, place by place; equal names get suffixes."""
    orders = _t(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_totalprice").orderBy("key")
    cust = _t(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_acctbal").orderBy(F.desc("key"))
    return A.positional_merge(orders, cust)


SQL_POSITIONAL_MERGE = """
WITH a AS (SELECT o_orderkey AS key_x, o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders),
b AS (SELECT c_custkey AS key_y, c_acctbal, row_number() OVER (ORDER BY c_custkey DESC) AS i FROM customer)
SELECT key_x, o_totalprice, key_y, c_acctbal FROM a JOIN b USING (i)"""


# --- M1: exact size ----------------------------------------------------------------------------
def q_exact_split(spark, d):
    orders = _t(spark, d, "orders").select("o_orderkey")
    out = split.exact_holdout_flag(orders, "o_orderkey")
    return out.select("o_orderkey", F.col("is_test").cast("long").alias("is_test"))


SQL_EXACT_SPLIT = f"""
WITH h AS (SELECT o_orderkey, substr(md5('{split.SEED}:' || CAST(o_orderkey AS VARCHAR)), 1, 15) AS h FROM orders)
SELECT o_orderkey, CAST(row_number() OVER (ORDER BY h, o_orderkey) <=
  (SELECT (count(*) * 3 + 9) // 10 FROM orders) AS BIGINT) AS is_test FROM h"""


# --- E3 / E4: unseen labels counted while scoring ----------------------------------------------
def q_unseen_labels(spark, d):
    """Labels that the encoder does not know, counted in the pass that encodes them."""
    orders = _t(spark, d, "orders").select("o_orderkey", F.concat(
        F.lit("c"), (F.col("o_custkey") % 50).cast("string")).alias("label"))
    known = orders.where("o_orderkey % 7 = 0 AND o_custkey % 50 < 40")
    seen = Observation("labels")
    enc = encode.fit_label_encoder(known, "label", "code", on_unseen="default")
    enc.transform(orders, observation=seen).write.parquet(scratch_path(spark, "encoded"))
    got = seen.get
    return spark.createDataFrame([(got["rows"], got["unseen"], got["nulls"])], "n_rows long, n_unseen long, n_null long")


SQL_UNSEEN_LABELS = """
WITH o AS (SELECT o_orderkey, o_custkey % 50 AS label FROM orders),
k AS (SELECT DISTINCT label FROM o WHERE o_orderkey % 7 = 0 AND label < 40)
SELECT count(*) AS n_rows, count(*) FILTER (k.label IS NULL) AS n_unseen, CAST(0 AS BIGINT) AS n_null
FROM o LEFT JOIN k USING (label)"""


# --- N2: entries of several words -----------------------------------------------------------
PHRASES = {"rewh": "PER", "orre la": "ORG", "la": "LOC", "la orre": "MISC", "the": "MISC", "de la": "LOC", "de": "LOC",
           "und die": "ORG", "und": "MISC", "in the": "PER", "of the": "LOC", "que la": "ORG", "que": "PER"}


def q_phrase_mentions(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text")
    entries = spark.createDataFrame(sorted(PHRASES.items()), "token string, label string")
    found = entities.phrase_mentions(docs, entries, key="doc_id", text_col="text")
    folded = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "length", "label"))).alias("m"))
    every = docs.select("doc_id").join(folded, "doc_id", "left")
    return every.select("doc_id", F.coalesce(F.array_join(F.transform("m", lambda m: F.concat_ws(
        ":", m["length"], m["label"])), ","), F.lit("")).alias("mentions"))


def _sql_phrases() -> str:
    longest = sorted(PHRASES, key=lambda p: (-len(p.split()), p))
    pattern = "|".join("".join(f"<{w}>" for w in p.split()) for p in longest)
    cases = " ".join(f"WHEN '{''.join(f'<{w}>' for w in p.split())}' THEN '{len(p.split())}:{label}'"
                     for p, label in PHRASES.items())
    from vellum.plans.catalog import SQL_WS
    norm = "regexp_replace(lower(regexp_replace(t, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')), '[<>]', '_', 'g')"
    return f"""
WITH x AS (
  SELECT doc_id, coalesce(array_to_string(list_transform(regexp_split_to_array(text, '{SQL_WS}'),
         lambda t: '<' || {norm} || '>'), ''), '') AS line FROM documents)
SELECT doc_id, coalesce(array_to_string(list_transform(regexp_extract_all(line, '{pattern}'),
  lambda m: CASE m {cases} END), ','), '') AS mentions FROM x"""


# --- E3 / E4 / P11: sparse vectors without a vocabulary on the driver -------------------------
def q_multi_hot_sparse(spark, d):
    """Part names as sparse vectors from a stored code table; slots named by join."""
    part = _t(spark, d, "part").select("p_partkey", F.split("p_name", " ", -1).alias("tags"))
    out, codes = encode.fit_multi_hot_vectors(part, "p_partkey", "tags", "vec")
    held = out.select("p_partkey", F.posexplode(vector_to_array("vec")).alias("slot", "x")).where("x > 0")
    return held.join(encode.slot_names(codes, "tags_"), "slot").groupBy("p_partkey").agg(
        F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"), F.count("*").alias("n_tags"))


SQL_MULTI_HOT_SPARSE = """
SELECT p_partkey, array_to_string(list_transform(list_sort(list_distinct(string_split(p_name, ' '))),
  lambda t: 'tags_' || t), ',') AS names, CAST(len(list_distinct(string_split(p_name, ' '))) AS BIGINT) AS n_tags
FROM part"""


def q_feature_select_sparse(spark, d):
    """P11 as ``feature_select``, the tag block and its names from the code table."""
    from vellum.plans import catalog
    part = _t(spark, d, "part").select("p_partkey", F.split("p_name", " ", -1).alias("tags"))
    vectors, codes = encode.fit_multi_hot_vectors(part, "p_partkey", "tags", "vec")
    li = catalog._wide(_t(spark, d, "lineitem"))
    rows = li.join(vectors.select("p_partkey", "vec"), li.l_partkey == F.col("p_partkey")).select(
        *catalog.LINE_KEY, "vec", F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_key"),
        F.expr(f"CAST({catalog.LINE_TARGETS['views']} AS DOUBLE)").alias("views"))
    train, _ = split.split(rows, "row_key")
    fitted = model.fit_forest(model.laid_out(train, catalog.LINE_KEY), ["vec"], "views", catalog.STUMP)
    names = encode.slot_names(codes, "tags_")
    return model.select_by_importance(model.importances_by_slot(model.forest_of(fitted), names))


# --- P9: many prefixes ------------------------------------------------------------------------
MANY_PREFIXES = tuple(f"{a}{b}{c}" for a in "ABDEILORSTU" for b in "aeioun" for c in "nrstlmc ") + ("The ", "Und")


def q_prefix_set(spark, d):
    """Lines of the texts that begin with one of some 500 prefixes, by hash lookup."""
    ls = F.split("text", "\n", -1)
    hit = F.filter(ls, lambda x: T.starts_with_any(x, MANY_PREFIXES))
    return _t(spark, d, "documents").select("doc_id", F.size(hit).cast("long").alias("n_lines"))


def _sql_prefixes() -> str:
    held = ", ".join(f"'{p}'" for p in MANY_PREFIXES)
    return f"""
SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: list_contains([{held}], x[1:3])
  OR x[1:4] = 'The ')) AS BIGINT) AS n_lines FROM documents"""


# --- S5: names ----------------------------------------------------------------------------------
def q_selected_names(spark, d):
    """The distinct tags of all parts written as a name list and read back."""
    part = _t(spark, d, "part").select(F.split("p_name", " ", -1).alias("tags"))
    codes = encode.fit_code_table(part, "tags", multi=True)
    path = scratch_path(spark, "names")
    A.write_names(spark, encode.slot_names(codes, "tags_").select(F.col("slot").alias("rank"), "name"), path)
    return spark.read.parquet(path)


SQL_SELECTED_NAMES = """
WITH t AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS t FROM part)
SELECT CAST(row_number() OVER (ORDER BY t) - 1 AS INTEGER) AS rank, 'tags_' || t AS name FROM t"""


QUERIES = {
    "csv_multiline": q_csv_multiline, "csv_types": q_csv_types, "positional_merge": q_positional_merge,
    "exact_split": q_exact_split, "unseen_labels": q_unseen_labels, "phrase_mentions": q_phrase_mentions,
    "multi_hot_sparse": q_multi_hot_sparse, "feature_select_sparse": q_feature_select_sparse,
    "prefix_set": q_prefix_set, "selected_names": q_selected_names,
}


def oracle_sql(feature_select: str) -> dict[str, str]:
    """The oracles; the sparse selection has that of the dense one."""
    return {
        "csv_multiline": SQL_CSV_MULTILINE, "csv_types": _sql_types(), "positional_merge": SQL_POSITIONAL_MERGE,
        "exact_split": SQL_EXACT_SPLIT, "unseen_labels": SQL_UNSEEN_LABELS, "phrase_mentions": _sql_phrases(),
        "multi_hot_sparse": SQL_MULTI_HOT_SPARSE, "feature_select_sparse": feature_select,
        "prefix_set": _sql_prefixes(), "selected_names": SQL_SELECTED_NAMES,
    }
