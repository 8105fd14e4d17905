"""Spelling variants by PartEnum signatures (operator 11).

Words are the maximal runs `[A-Za-z\\u00C0-\\u00FF]+`, A-Z lower-cased, with at least
``MIN_LENGTH`` code points and ``MIN_COUNT`` occurrences.  Two words are near if one
insertion, deletion or replacement of a code point makes them equal.  A word's form is its
most frequent near word (ties: the smallest) if that occurs ``RATIO`` times as often; its root
is reached by following forms to the last.

PartEnum: a word's letter multiset is a set of (letter, occurrence) dimensions, that is, a
binary vector.  One edit changes at most two dimensions (Hamming distance at most
``MAX_HAMMING``).  The dimensions are hashed into ``PARTS`` parts; near words agree on all but
at most two of the parts, hence on at least one choice of PARTS - 2 parts.  Every such choice
with the word's dimensions in it is a signature.  Beside it stand the first or the last
MIN_LENGTH // 2 code points, of which one edit in a word of MIN_LENGTH leaves one side alone;
that keeps anagrams and words of few letters from meeting in one group.  Words are equi-joined
on exact signatures and verified by ``levenshtein`` inside the join; distinct pairs are kept.
A signature's group is split by AQE if it is large; nothing is cut off.

Counting runs in Python over Arrow batches: a task counts by word and hands on at most
``FLUSH`` entries at a time, and Spark adds them up; the rest are joins over distinct words.

The query's words are read with a fault built in (``drop_every``): where the crc32 of
`<key>:<run>` is divisible by it, the run loses one code point.

Defined results: null texts have no words; a null key counts as ''; repeated rows count as
often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import common as C
from vellum.session import materialize, ship_package

MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
MAX_HAMMING = 2
PARTS = 4
DROP_EVERY = 199
#: Words that a task holds before it hands their counts on.
FLUSH = 400_000

#: runs of a lower-cased UTF-8 text; bytes C3 80 to C3 BF are the code points C0 to FF
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def read_word(key: bytes, run: bytes, drop_every: int | None) -> str:
    """A run as it is read: whole, or without the code point that its checksum names."""
    word = run.decode()
    if drop_every:
        h = zlib.crc32(run, zlib.crc32(key))
        if h % drop_every == 0:
            at = h % len(word)
            return word[:at] + word[at + 1:]
    return word


def vocabulary(df: DataFrame, key_col: str | None = "doc_id", text_col: str = "text",
               min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
               drop_every: int | None = None) -> DataFrame:
    """(word, n) of every word long and frequent enough; stored."""
    ship_package(df.sparkSession)

    def rows(count: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()),
                                           pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[str, int] = {}
        for batch in batches:
            for key, raw in zip(batch.column(0), batch.column(1)):
                own: dict[bytes, int] = {}
                for r in _RUN.findall(raw.as_py().lower()):  # bytes: only A-Z
                    own[r] = own.get(r, 0) + 1
                prefix = f"{key.as_py()}:".encode()
                for r, n in own.items():
                    word = read_word(prefix, r, drop_every)
                    if len(word) >= min_length:
                        count[word] = count.get(word, 0) + n
                if len(count) > FLUSH:
                    yield rows(count)
                    count = {}
        yield rows(count)

    key = F.coalesce(C.col(key_col).cast("string"), F.lit("")) if key_col else F.lit("")
    part = df.select(key.alias("key"), C.text_bytes(text_col).alias("raw")).mapInArrow(run, "word string, n long")
    return materialize(part.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count), "words")


def signatures(word: str, parts: int = PARTS, distance: int = MAX_HAMMING, side: int = MIN_LENGTH // 2) -> list[int]:
    """The PartEnum signatures of a word's letter multiset, each with either end of the word."""
    held: list[list[str]] = [[] for _ in range(parts)]
    seen: dict[str, int] = {}
    for c in sorted(word):
        k = seen[c] = seen.get(c, 0) + 1
        dimension = f"{c}{k}"
        held[zlib.crc32(dimension.encode()) % parts].append(dimension)
    text = [" ".join(x) for x in held]
    out = []
    for chosen in combinations(range(parts), max(parts - distance, 0)):
        projected = "|".join(f"{i} {text[i]}" for i in chosen)
        for end in (f"<{word[:side]}", f">{word[-side:]}"):
            out.append(xxhash.xxh64_intdigest(f"{projected}|{end}") - (1 << 63))
    return out


def near_pairs(words: DataFrame, parts: int = PARTS, side: int = MIN_LENGTH // 2) -> DataFrame:
    """(a, a_n, b, b_n), a < b: words one edit apart, each pair once; stored."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1),
            pa.array([signatures(w, parts, side=side) for w in batch.column(0).to_pylist()], pa.list_(pa.int64()))],
            names=["word", "n", "signatures"])

    signed = C.map_arrow(words, run, "word string, n long, signatures array<long>").select(
        "word", "n", F.explode("signatures").alias("signature"))
    signed = materialize(signed, "signatures")
    a = signed.select(F.col("word").alias("a"), F.col("n").alias("a_n"), "signature")
    b = signed.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("signature").alias("s"))
    one_edit = F.levenshtein("a", "b", 1) == 1
    met = a.join(b.hint("merge"), (F.col("signature") == F.col("s")) & (F.col("a") < F.col("b")) & one_edit)
    return materialize(met.select("a", "a_n", "b", "b_n").distinct(), "near-words")


def forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, form, form_n, n_near) of every word; stored."""
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(
        F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word"))).alias("best"))
    best_n = -F.col("best.less")
    enough = best_n >= ratio * F.col("n")
    return materialize(words.join(best.hint("merge"), "word", "left").select(
        "word", "n", F.when(enough, F.col("best.word")).alias("form"), F.when(enough, best_n).alias("form_n"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")), "forms")


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) of every word with a form, by pointer jumping.

    Forms grow in frequency, so there is no cycle; a round doubles the steps, and the rounds
    are as many as the logarithm of the longest chain.
    """
    current = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = current.select(F.col("word").alias("at"), F.col("root").alias("to"))
        step = materialize(current.join(ahead.hint("merge"), F.col("root") == F.col("at"), "left").select(
            "word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")), "roots")
        if not step.where("moved").head(1):
            return step.select("word", "root")
        current = step.select("word", "root")


def group(df: DataFrame, key_col: str | None = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
          min_count: int = MIN_COUNT, ratio: int = RATIO, drop_every: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    if min_length < 2:
        raise ValueError("words need two code points: one edit must leave one end alone")
    words = vocabulary(df, key_col, text_col, min_length, min_count, drop_every)
    formed = forms(words, near_pairs(words, side=min_length // 2), ratio)
    last = roots(formed).withColumnRenamed("word", "__of")
    return formed.join(last.hint("merge"), F.col("word") == F.col("__of"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents, read with one code point in 199 runs lost, and their roots."""
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text")
    return group(docs, drop_every=DROP_EVERY)
