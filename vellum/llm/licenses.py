"""License scan by diagonal voting (operator 6), in DataFrame functions only.

A text is lower-cased (A-Z) and read as words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`.  The hash
of every run of ``K`` words is joined to the template positions of that hash.  A match of
text position p and template position t votes for the diagonal p - t, the place where the
template would start.  Votes are summed by (document, template, diagonal).

* A phrase is found at each diagonal that all its positions vote for.
* A template sentence may have words inserted or left out: diagonals at most ``DRIFT``
  apart are merged, and a merged span is verified by the share of the template's
  positions that it covers (``MIN_COVER``).  It adds its label.

Matches are verified word by word where they are made, so a hash collision counts for
nothing.  Templates are a parameter and small (one literal table), hence broadcast; the
text's runs are never shuffled, only the matches are.

Defined results: null text is empty (no words, no labels, score 0); repeated rows stay;
an empty table gives an empty result.  score is the largest share covered of a template
whose label is given (1.0 for a phrase), 0 without a label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm import common as C
from vellum.session import materialize

K = 3
DRIFT = 3
MIN_COVER = 0.6
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SEPARATORS = "".join(map(chr, range(128))).translate(
    {c: None for c in (*range(0x30, 0x3A), *range(0x61, 0x7B))})

#: label -> phrase that must stand word for word (the contract's)
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}
#: label -> sentence that may be altered a little (common notices, as parameters)
SENTENCES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this "
           "software and associated documentation files the software to deal in the software "
           "without restriction",
    "apache-2": "you may not use this file except in compliance with the license you may obtain "
                "a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are "
           "permitted provided that the following conditions are met",
    "gpl": "this program is free software you can redistribute it and or modify it under the "
           "terms of the gnu general public license as published by the free software foundation",
    "cc-by": "this work is licensed under the creative commons attribution 4 0 international "
             "license",
}


def words(text: Column) -> Column:
    """The lower-cased words of a text.

    ``lower`` also maps non-ASCII letters, none of them to an ASCII one but the Kelvin
    sign, which is put aside first; so words of ASCII letters come out as A-Z lower-cased.
    """
    return C.words(F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u00e5"))), _SEPARATORS, SEPARATOR)


def _grams(w: Column) -> Column:
    """Hash of the K words from each position on, and these words."""
    def runs(b: Column) -> Column:
        h = F.slice(b["h"], 1, F.greatest(F.size(b["h"]) - (K - 1), F.lit(0)))
        return F.transform(h, lambda x, i: F.struct(
            F.xxhash64(x, *[F.get(b["h"], i + j) for j in range(1, K)]).alias("hash"),
            F.slice(b["w"], i + 1, K).alias("gram")))

    hashed = C.let(w, lambda x: F.struct(x.alias("w"), F.transform(x, lambda y: F.xxhash64(y)).alias("h")))
    return C.let(hashed, runs)


def template_table(spark: SparkSession, phrases: dict[str, str],
                   sentences: dict[str, str]) -> DataFrame:
    """(template, label, phrase, size, t, gram, hash): every position of every template."""
    rows = []
    for exact, source in ((True, phrases), (False, sentences)):
        for label, line in source.items():
            w = line.split()
            if len(w) < K:
                raise ValueError(f"a template needs {K} words: {line!r}")
            n = len(w) - K + 1
            rows += [(f"{'p' if exact else 's'}:{label}", label, exact, n, t, w[t:t + K]) for t in range(n)]
    table = spark.createDataFrame(rows, "template string, label string, phrase boolean, size int, "
                                        "t int, gram array<string>")
    return table.withColumn("hash", _grams(F.col("gram"))[0]["hash"])


#: A hash that stands for the document itself, so that each one passes the join once.
_SELF = "self"


def matches(df: DataFrame, templates: DataFrame, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """One row per verified match, and one with null template for each document.

    Columns: ``__doc`` (a number of the row), the carried ones, n_words, template, label,
    phrase, size, t, p.
    """
    spark = df.sparkSession
    own = spark.createDataFrame([()], T.StructType([])).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in templates.schema if f.name != "hash"],
        F.xxhash64(F.lit(_SELF)).alias("hash"))
    table = templates.unionByName(own)
    # a row carries the words of its own run only, so a text costs what it is long
    itself = F.struct(F.xxhash64(F.lit(_SELF)).alias("hash"), F.lit(None).cast("array<string>").alias("gram"))
    base = df.select(F.monotonically_increasing_id().alias("__doc"), *[C.col(c) for c in carry],
                     _grams(words(C.col(text_col))).alias("__g"), F.size(words(C.col(text_col))).alias("__n"))
    runs = base.select("__doc", *[C.col(c) for c in carry], "__n", F.posexplode(
        F.concat(F.array(itself), F.col("__g"))).alias("p", "__run"))
    runs = runs.select("__doc", *[C.col(c) for c in carry], "__n", (F.col("p") - 1).alias("p"),
                       F.col("__run.hash").alias("__h"), F.col("__run.gram").alias("__words"))
    met = runs.join(F.broadcast(table), F.col("__h") == F.col("hash"))
    return met.where(F.col("gram").eqNullSafe(F.col("__words"))).select(
        "__doc", *[C.col(c) for c in carry], F.col("__n").cast("long").alias("n_words"),
        "template", "label", "phrase", "size", "t", "p")


def diagonals(found: DataFrame) -> DataFrame:
    """Votes of each (document, template, diagonal)."""
    return (found.where(F.col("template").isNotNull())
            .groupBy("__doc", "template", "label", "phrase", "size",
                     (F.col("p") - F.col("t")).alias("diagonal"))
            .agg(F.count_distinct("t").alias("votes"), F.collect_set("t").alias("ts")))


def spans(voted: DataFrame, drift: int = DRIFT) -> DataFrame:
    """Sentences: neighbouring diagonals merged into spans with the share covered."""
    from pyspark.sql import Window

    by = Window.partitionBy("__doc", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(by)
    begun = voted.where(~F.col("phrase")).withColumn("new", F.when(gap <= drift, 0).otherwise(1))
    merged = begun.withColumn("span", F.sum("new").over(by))
    return (merged.select("__doc", "template", "label", "size", "span", "diagonal", F.explode("ts").alias("t"))
            .groupBy("__doc", "template", "label", "size", "span")
            .agg((F.count_distinct("t") / F.first("size")).alias("cover"),
                 F.min("diagonal").alias("start"))
            .drop("size"))


def scan(df: DataFrame, text_col: str = "text", carry: tuple[str, ...] = (),
         phrases: dict[str, str] | None = None, sentences: dict[str, str] | None = None,
         min_cover: float = MIN_COVER) -> DataFrame:
    """Per row: the carried columns, n_words, n_base, first_word, last_word, base_labels,
    labels, score.

    Matches and document rows are written once to the shared folder (the text is not).
    """
    phrases = PHRASES if phrases is None else phrases
    sentences = SENTENCES if sentences is None else sentences
    table = template_table(df.sparkSession, phrases, sentences)
    found = materialize(matches(df, table, text_col, carry), "license-matches")
    voted = diagonals(found)
    places = (voted.where(F.col("phrase") & (F.col("votes") == F.col("size")))
              .select("__doc", "label", F.col("diagonal").alias("start"), F.lit(1.0).alias("cover"),
                      F.lit(True).alias("base")))
    near = spans(voted).where(F.col("cover") >= min_cover).select(
        "__doc", "label", "start", "cover", F.lit(False).alias("base"))
    base = F.col("base")
    summed = places.unionByName(near).groupBy("__doc").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("cover").alias("score"))
    rows = found.where(F.col("template").isNull()).select(
        "__doc", *[C.col(c) for c in carry], "n_words")
    out = rows.join(summed, "__doc", "left")
    empty = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""),
             "score": F.lit(0.0)}
    return out.withColumns({c: F.coalesce(F.col(c), x) for c, x in empty.items()}).drop("__doc")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels and the places of the base phrases in every document."""
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, carry=("doc_id",)).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _sql_rows(source: dict[str, str]) -> str:
    return ", ".join(f"('{label}', '{line}')" for label, line in source.items())


#: Phrases by list slices; sentences by joining word triples as text.
ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
phrase AS (SELECT label, string_split(line, ' ') AS pw FROM (VALUES {_sql_rows(PHRASES)}) t(label, line)),
sentence AS (SELECT label, string_split(line, ' ') AS sw FROM (VALUES {_sql_rows(SENTENCES)}) t(label, line)),
pos AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d),
place AS (
  SELECT rid, label, i - 1 AS start FROM pos JOIN phrase
  ON w[i] = pw[1] AND w[i:i + len(pw) - 1] = pw),
b AS (
  SELECT rid, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place GROUP BY rid),
tri AS (SELECT label, len(sw) - 2 AS size, t, sw[t:t + 2] AS g
        FROM (SELECT label, sw, unnest(range(1, len(sw) - 1)) AS t FROM sentence)),
hit AS (SELECT DISTINCT rid, label, size, i - t AS diag, t FROM pos JOIN tri ON w[i] = g[1] AND w[i:i + 2] = g),
dg AS (SELECT DISTINCT rid, label, diag FROM hit),
gr AS (
  SELECT rid, label, diag, sum(new) OVER (PARTITION BY rid, label ORDER BY diag) AS span
  FROM (SELECT *, CASE WHEN diag - lag(diag) OVER (PARTITION BY rid, label ORDER BY diag) <= {DRIFT}
        THEN 0 ELSE 1 END AS new FROM dg)),
cov AS (
  SELECT rid, label, count(DISTINCT t) / any_value(size) AS cover
  FROM hit JOIN gr USING (rid, label, diag) GROUP BY rid, label, span),
lab AS (
  SELECT rid, label, 1.0::DOUBLE AS cover FROM place
  UNION ALL SELECT rid, label, cover FROM cov WHERE cover >= {MIN_COVER}),
l AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score
      FROM lab GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0) AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN l USING (rid)
"""
