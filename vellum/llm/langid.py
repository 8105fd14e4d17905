"""Language identification by nearest centroid (operator 2).

A text becomes a vector of hashed byte 2- and 3-grams of its letters (other ASCII characters
count as one space), weighted by TF-IDF and scaled to length one.  Each language has
several centroids, found by spherical k-means on its labelled texts, because one mean does
not fit prose, lists and short lines alike.  A text takes the language of the centroid
with the largest cosine, which is its score.

Rejection by distance: for each language and size class (powers of two of the number of
n-grams) the training texts and their beginnings give a low quantile of the cosine to their
own language; a text below ``REJECT_SHARE`` of it is too far from every centroid and is
marked ``rejected``.

Training uses at most about ``SAMPLE_PER_LANG`` texts per language, chosen by a hash of
key and text, repeated rows counted once; the model is languages x ``CLUSTERS`` x ``DIMENSIONS`` numbers, and is all that passes
the driver.  Prediction reads every whole text once, with no shuffle.

Defined results: null text or text without a letter is ``und`` with score 0 and rejected;
ties take the alphabetically first language; without any labelled text every text is
``und``; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import common as C
from vellum.session import materialize, ship_package

DIMENSIONS = 4096
CLUSTERS = 4
SAMPLE_PER_LANG = 500
#: Rejection: this share of this quantile of the training cosines.
REJECT_QUANTILE = 0.01
REJECT_SHARE = 0.5
SIZE_CLASSES = 24
UNKNOWN = "und"
#: Bytes of a text that are counted at once.
SLICE = 1 << 20
#: Texts whose vectors are compared at once.
BLOCK = 256

#: A-Z become lower case, every other ASCII character but a-z a space.
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32
                 for c in range(256))
_ASCII_LETTER = re.compile(rb"[A-Za-z]").search


def has_letter(text: bytes) -> bool:
    """Whether a UTF-8 text has a letter of any script."""
    if _ASCII_LETTER(text):
        return True
    return not text.isascii() and any(map(str.isalpha, C.decode(text)))


def counts(text: bytes) -> np.ndarray:
    """Counts of the hashed 2- and 3-grams of a text."""
    body = b" " + b" ".join(text.translate(_LETTERS).split()) + b" "
    out = np.zeros(DIMENSIONS)
    for a in range(0, max(1, len(body) - 2), SLICE):
        b = np.frombuffer(body, np.uint8, min(len(body) - a, SLICE + 2), a).astype(np.uint32)
        two = (b[:-1] << np.uint32(8)) | b[1:] | np.uint32(1 << 24)
        three = ((two[:-1] & np.uint32(0xFFFF)) << np.uint32(8)) | b[2:]
        for grams in (two[:len(three)] if len(three) else two, three):
            code = (grams * np.uint32(2654435761)) >> np.uint32(20)
            out += np.bincount(code, minlength=DIMENSIONS)
    return out


class Model(NamedTuple):
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # (centroid, dimension), unit rows
    owner: np.ndarray      # language number of each centroid
    floor: np.ndarray      # (language, size class) cosine below which a text is rejected

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        v = np.sqrt(grams) * self.idf
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(norm > 0, norm, 1)

    def nearest(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language number and cosine of rows of counts."""
        close = self.vectors(grams) @ self.centroids.T
        best = close.argmax(axis=1)
        return self.owner[best], np.clip(close[np.arange(len(best)), best], 0, 1)


def size_class(grams: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(grams.sum(axis=1), 1)).astype(int), SIZE_CLASSES - 1)


def training_rows(key: Column) -> Column:
    """Rows that may teach: crc32 of the key as text, modulo 4, is not 2."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(4)) != 2, F.lit(True))


def held_out(key: Column) -> Column:
    return ~training_rows(key)


def sample(df: DataFrame, key_col: str, text_col: str, lang_col: str,
           per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """(lang, raw): about ``per_lang`` different labelled training texts of each language, stored.

    Rows of one key and text are one; which are taken depends on a hash of both, so rows that
    share a key (or have none) are taken or left each on its own.  A language with fewer
    gives all it has.
    """
    lang, key, mark = C.col(lang_col), C.col(key_col), F.col("mark")
    usable = lang.isNotNull() & C.col(text_col).isNotNull() & training_rows(key)
    rows = df.where(usable).select(lang.alias("l"), F.xxhash64(key, C.col(text_col), F.lit("langid")).alias("mark"),
                                   C.text_bytes(text_col).alias("raw"))
    # stored, so that the planner knows how small it is and the texts are not moved
    sizes = materialize(rows.select(F.col("l").alias("lang"), "mark").distinct()
                        .groupBy("lang").agg(F.count("*").alias("n")), "languages")
    picked = F.pmod(mark, F.lit(1 << 30)) < per_lang / F.col("n") * (1 << 30)
    return materialize(rows.join(sizes, F.col("l") == F.col("lang")).where(picked)
                       .groupBy("lang", "mark").agg(F.min("raw").alias("raw")).select("lang", "raw"),
                       "language-sample")


def _clusters(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from the mean and then the farthest texts in turn."""
    centre = vectors.mean(axis=0, keepdims=True)
    found = [int((vectors @ centre[0]).argmax())]
    while len(found) < min(k, len(vectors)):
        near = (vectors @ vectors[found].T).max(axis=1)
        far = int(near.argmin())
        if near[far] > 1 - 1e-9:
            break
        found.append(far)
    centres = vectors[found]
    for _ in range(rounds):
        member = (vectors @ centres.T).argmax(axis=1)
        sums = np.stack([vectors[member == j].sum(axis=0) if (member == j).any() else centres[j]
                         for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def fit(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        clusters: int = CLUSTERS, per_lang: int = SAMPLE_PER_LANG) -> Model | None:
    """Learn the model from the labelled training rows (None without any)."""
    ship_package(df.sparkSession)
    rows = sample(df, key_col, text_col, lang_col, per_lang)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for raw in batch.column(1):
                have += counts(raw.as_py()) > 0
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(DIMENSIONS), pa.int32()), pa.array(have),
                 pa.array(np.full(DIMENSIONS, n))], names=["i", "df", "n"])

    found = (rows.mapInArrow(frequencies, "i int, df long, n long").groupBy("i")
             .agg(F.sum("df").alias("df"), F.sum("n").alias("n")).collect())  # DIMENSIONS rows
    if not found:
        return None
    idf = np.zeros(DIMENSIONS)
    for r in found:
        idf[r["i"]] = np.log((1 + r["n"]) / (1 + r["df"])) + 1
    blank = Model([], idf, np.zeros((0, DIMENSIONS)), np.zeros(0, int), np.zeros((0, SIZE_CLASSES)))

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        grams = np.stack([np.asarray(x, float) for x in pdf["grams"]])
        centres = _clusters(blank.vectors(grams), clusters)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroid": list(centres)})

    def grams(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [counts(x.as_py()).astype(np.float32) for x in batch.column(1)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(made, pa.list_(pa.float32()))], names=["lang", "grams"])

    centres = (C.map_arrow(rows, grams, "lang string, grams array<float>").groupBy("lang")
               .applyInPandas(cluster, "lang string, centroid array<double>").collect())
    langs = sorted({r["lang"] for r in centres})
    centres = sorted(centres, key=lambda r: langs.index(r["lang"]))
    model = Model(langs, idf, np.array([r["centroid"] for r in centres]),
                  np.array([langs.index(r["lang"]) for r in centres]), np.zeros((len(langs), SIZE_CLASSES)))

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                number = langs.index(lang)
                parts = [raw[:1 << b] for b in range(3, 22) if 1 << b < len(raw)] + [raw]
                g = np.stack([counts(p) for p in parts])
                own = model.vectors(g) @ model.centroids[model.owner == number].T
                out += [(number, int(s), float(c)) for s, c in zip(size_class(g), own.max(axis=1))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.float64()))],
                names=["lang", "size", "cosine"])

    low = (rows.mapInArrow(cosines, "lang int, size int, cosine double").groupBy("lang", "size")
           .agg(F.percentile_approx("cosine", F.lit(REJECT_QUANTILE), F.lit(1000)).alias("low")).collect())
    for r in low:
        model.floor[r["lang"], r["size"]] = REJECT_SHARE * r["low"]
    for k in range(1, SIZE_CLASSES):  # a size never seen takes the next smaller one's floor
        unseen = model.floor[:, k] == 0
        model.floor[unseen, k] = model.floor[unseen, k - 1]
    return model


def predict(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred, score and rejected (replacing columns of these names)."""
    made = ("lang_pred", "score", "rejected")
    (found,) = C.fresh(df, "__found")
    kinds = [pa.string(), pa.float64(), pa.bool_()]

    def run(texts: pa.Array) -> pa.Array:
        lang, score, rejected = [], [], []
        for a in range(0, len(texts), BLOCK):
            part = [x.as_py() for x in texts[a:a + BLOCK]]
            if model is None:
                lang += [UNKNOWN] * len(part)
                score += [0.0] * len(part)
                rejected += [True] * len(part)
                continue
            known = np.array([has_letter(x) for x in part])
            grams = np.stack([counts(x) for x in part])
            best, close = model.nearest(grams)
            far = close < model.floor[best, size_class(grams)]
            lang += [model.langs[b] if k else UNKNOWN for b, k in zip(best, known)]
            score += np.where(known, close, 0.0).tolist()
            rejected += (far | ~known).tolist()
        return pa.StructArray.from_arrays(
            [pa.array(c, t) for c, t in zip((lang, score, rejected), kinds)], names=list(made))

    column = C.computed(df, C.text_bytes(text_col), run, "lang_pred string, score double, rejected boolean")
    keep = [c for c in df.columns if c.lower() not in made]
    return df.withColumn(found, column).select(
        *[C.col(c) for c in keep], *[F.col(found).getField(c).alias(c) for c in made])


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score",
                      "rejected")
