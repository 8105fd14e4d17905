"""Document fingerprints as Merkle trees (operator 8).

The text is cut by its own content: paragraphs end after a line feed; phrases end, inside a
paragraph, after a space that follows a byte of ``_ENDS``, or after MAX_PHRASE bytes; sections end after a paragraph
whose hash is divisible by 4.  A phrase's hash covers its bytes (white space included),
every other node the hashes below it, and the root the sections' and the length.  So
equal texts have equal roots, and an edit changes only the branches above it, whatever
it does to the places of the rest.

The fingerprint is one string, ``root:sections:paragraphs:phrases``: the root as 32
hex digits, then 24 bits of each node's hash, level by level, in base64.

Likeness of two fingerprints, from 0 to 1, is one measure for texts of any length: 1 for
equal roots; else the share of the phrases that match: a common beginning and end, and
those found in both middles whatever their place.  A phrase has two or three words, so a text of
a few words has a coarse likeness.

Defined results: null text is empty (one empty tree); equal keys keep an order by
text; a null key comes last; an empty table gives an empty result; a single row is its
own neighbour.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import common as C
from vellum.session import ship_package

#: Bytes that, before a space, end a phrase: every fourth byte value.
_ENDS = np.arange(256) % 4 == 1
#: A phrase of more bytes is cut every so many bytes from its beginning.
MAX_PHRASE = 96
#: Rows of one range of neighbours at most, but for rows of equal places (``_place``).
RANGE_ROWS = 4000
#: Bytes of a place: nine of the key, the rest of the text.
PLACE = 32


class Tree(NamedTuple):
    root: str
    sections: np.ndarray
    paragraphs: np.ndarray
    phrases: np.ndarray
    #: byte offset at which each phrase ends
    ends: np.ndarray


def _hash_runs(data, ends: list[int]) -> np.ndarray:
    digest, start, out = xxhash.xxh64_intdigest, 0, []
    for end in ends:
        out.append(digest(data[start:end]))
        start = end
    return np.array(out, np.uint64)


def tree(text: bytes) -> Tree:
    """The Merkle tree of a UTF-8 text."""
    raw = np.frombuffer(text, np.uint8)
    if len(raw):
        line = raw == 10
        cut = line.copy()
        cut[1:] |= (raw[1:] == 32) & _ENDS[raw[:-1]]
        cut[-1] = True
        ends = np.flatnonzero(cut) + 1
        starts = np.concatenate([[0], ends[:-1]])
        wide = np.flatnonzero(ends - starts > MAX_PHRASE)
        if len(wide):
            more = [np.arange(a + MAX_PHRASE, b, MAX_PHRASE) for a, b in zip(starts[wide], ends[wide])]
            ends = np.sort(np.concatenate([ends, *more]))
        closes = line[ends - 1]
        closes[-1] = True
    else:
        ends, closes = np.empty(0, np.int64), np.empty(0, bool)
    view = memoryview(text)
    phrases = _hash_runs(view, ends.tolist())
    paragraphs = _hash_runs(memoryview(phrases.tobytes()), ((np.flatnonzero(closes) + 1) * 8).tolist())
    last = paragraphs % np.uint64(4) == 0
    if len(last):
        last[-1] = True
    sections = _hash_runs(memoryview(paragraphs.tobytes()), ((np.flatnonzero(last) + 1) * 8).tolist())
    root = hashlib.blake2b(sections.tobytes() + len(text).to_bytes(8, "big"), digest_size=16).hexdigest()
    return Tree(root, sections, paragraphs, phrases, ends)


def _short(hashes: np.ndarray) -> str:
    low = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 5:]
    return base64.b64encode(low.tobytes()).decode()


def fingerprint(t: Tree) -> str:
    return ":".join([t.root, *map(_short, (t.sections, t.paragraphs, t.phrases))])


def _nodes(part: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(part), np.uint8).reshape(-1, 3).astype(np.int64)
    return (raw[:, 0] << 16) | (raw[:, 1] << 8) | raw[:, 2]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def likeness(one: str, other: str) -> float:
    """Likeness of two fingerprints."""
    x, y = one.split(":"), other.split(":")
    if x[0] == y[0]:
        return 1.0
    a, b = _nodes(x[3]), _nodes(y[3])
    most = max(len(a), len(b))
    head = _common(a, b)
    a, b = a[head:], b[head:]
    tail = _common(a[::-1], b[::-1])
    middle = Counter(a[:len(a) - tail].tolist()) & Counter(b[:len(b) - tail].tolist())
    return (head + tail + sum(middle.values())) / most


def edited_span(a: Tree, b: Tree) -> tuple[int, int]:
    """Byte span of ``a`` outside which both texts have the same phrases (0, 0: equal)."""
    if a.root == b.root:
        return 0, 0
    head = _common(a.phrases, b.phrases)
    tail = _common(a.phrases[head:][::-1], b.phrases[head:][::-1])
    begin = int(a.ends[head - 1]) if head else 0
    stop = len(a.ends) - tail
    return begin, max(begin, int(a.ends[stop - 1]) if stop else 0)


def document_trees(df: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The carried columns, and the fingerprint of every text."""
    work = df.select(*[C.col(c) for c in carry], C.text_bytes(text_col).alias("__raw"))
    schema = C.schema(df, carry, "fingerprint string")
    names = [f.name for f in schema.fields]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = batch.column(batch.num_columns - 1)
        prints = pa.array([fingerprint(tree(x.as_py())) for x in raw], pa.string())
        return pa.RecordBatch.from_arrays(list(batch.columns[:-1]) + [prints], names=names)

    return C.map_arrow(work, run, schema)


def _place(key: Column, raw: Column) -> Column:
    """Bytes that sort like descending key (null last), then text: the key with all but its
    sign bit flipped, behind a byte for null, and the first bytes of the text.
    """
    flipped = F.unhex(F.lpad(F.hex(key.bitwiseXOR(F.lit(2**63 - 1))), 16, "0"))
    of_key = F.concat(F.lit(b"\0"), flipped)
    return F.concat(F.coalesce(of_key, F.lit(b"\1" + bytes(8))), F.substring(raw, 1, PLACE - 9))


def _openings(places: DataFrame) -> np.ndarray:
    """The places that open a range, sorted: the first of each sorted partition, and every
    ``RANGE_ROWS``-th behind it.
    """
    every = RANGE_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            yield batch.take(pa.array(range(-seen % every, batch.num_rows, every), pa.int64()))
            seen += batch.num_rows

    cuts = places.repartitionByRange("place").sortWithinPartitions("place").mapInArrow(run, "place binary")
    return np.unique(np.array(cuts.toArrow()["place"].to_pylist(), f"S{PLACE}"))


def with_next(df: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """Rows (range, ghost, key, raw) sorted so that each text precedes its next one.

    The order is by descending key (null last), equal keys by text; the last row's next is
    the first row.  Rows are dealt by ranges of their places, so rows of one key, or
    without a key, are cut apart by their texts.  A range ends in a ghost, a copy of
    the row that opens the following range, so no range needs another.  Only the places
    that open a range pass the driver: ``PLACE`` bytes for ``RANGE_ROWS`` rows, and for
    each partition.
    """
    rows = df.select(C.col(key_col).cast("long").alias("key"), C.text_bytes(text_col).alias("raw"))
    ship_package(df.sparkSession)
    rows = rows.withColumn("place", _place(F.col("key"), F.col("raw")))
    opens = _openings(rows.select("place"))
    last = max(0, len(opens) - 1)

    def find(places: pd.Series) -> pd.Series:  # the range; -1 - range for a place that opens it
        own = np.array(places.tolist(), opens.dtype)
        at = np.searchsorted(opens, own, side="right") - 1
        return pd.Series(np.where(opens[at] == own, -1 - at, at)).astype("int32")

    found = F.pandas_udf(find, "int")
    dealt = rows.select("key", "raw", found("place").alias("at"))
    at = F.col("at")
    every = dealt.select("key", "raw", F.when(at < 0, -1 - at).otherwise(at).alias("range"), F.lit(0).alias("ghost"))
    before = F.when(at == -1, F.lit(last)).otherwise(-2 - at)
    opening = (dealt.where(at < 0).groupBy(before.alias("range"), "key").agg(F.min("raw").alias("raw"))
               .select("key", "raw", "range", F.lit(1).alias("ghost")))
    return every.unionByName(opening).repartition("range").sortWithinPartitions(
        "range", "ghost", F.col("key").desc_nulls_last(), "raw")


def compare_edited(df: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has the last third replaced by the beginning of the next document.
    """
    ordered = with_next(df, key_col, text_col).select("range", "ghost", "key", "raw")
    schema = ("key long, n_chars long, edited_sha256 string, fingerprint string, "
              "edited_fingerprint string, near_edited double, near_next double")
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def pair(key, text: str, print_: str, after: str, next_print: str) -> tuple:
        n = len(text)
        cut = n // 3
        edited = (text[:n - cut] + after[:cut]).encode()
        edited_print = fingerprint(tree(edited))
        return (key, n, hashlib.sha256(edited).hexdigest(), print_, edited_print,
                likeness(print_, edited_print), likeness(print_, next_print))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for where, ghost, key, raw in zip(*(batch.column(i) for i in range(4))):
                where, text = where.as_py(), C.decode(raw.as_py())
                print_ = fingerprint(tree(text.encode()))
                if held is not None and held[0] == where:
                    out.append(pair(held[1], held[2], held[3], text, print_))
                held = None if ghost.as_py() else (where, key.as_py(), text, print_)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return ordered.mapInArrow(run, schema).withColumnRenamed("key", key_col)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document against its edited text and the next document."""
    return compare_edited(C.read(spark, sf_dir, "documents").select("doc_id", "text"))
