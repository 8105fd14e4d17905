"""Byte-level BPE encoding and decoding with the tiktoken library (operator 9).

The vocabulary is a local rank file (``<base64 token> <rank>`` lines) whose path is a
parameter; every Python worker loads it once.  Texts longer than ``SPLIT_CHARS`` are
cut at boundaries where the splitting pattern always ends a match, so the pieces give
the ids of the whole text while no regex call sees an unbounded string.  Ids decode to
raw bytes, never through text, because a token may hold part of a character.

Null text encodes as the empty text (no ids); repeated rows stay; an empty table gives
an empty result; other columns pass through untouched, those of an output's name are replaced.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm import common as C

#: Texts above this many characters are cut at safe boundaries before encoding.
SPLIT_CHARS = 1 << 16
#: ASCII letter or digit followed by ASCII white space: the pattern's letter, digit and
#: contraction alternatives all end there and white space starts a new match.
_SAFE = re.compile(r"(?<=[A-Za-z0-9.,])(?=[ \n])")


def pieces(text: str, size: int = SPLIT_CHARS) -> list[str]:
    """Cut a text at safe boundaries into parts of about ``size`` characters.

    A part ends before white space that follows a letter, digit, full stop or comma.
    A stretch without such a place stays whole, however long it is.
    """
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while len(text) - start > size:
        m = _SAFE.search(text, start + size)
        if m is None:
            break
        out.append(text[start:m.start()])
        start = m.start()
    out.append(text[start:])
    return out


class Codec:
    """The encoding of one rank file; lives once in each Python worker."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._enc = tiktoken.Encoding("local-ranks", pat_str=pattern, mergeable_ranks=ranks,
                                      special_tokens={})

    def encode(self, text: str) -> list[int]:
        if len(text) <= SPLIT_CHARS:
            return self._enc.encode_ordinary(text)
        out: list[int] = []
        for part in pieces(text):
            out.extend(self._enc.encode_ordinary(part))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return self._enc.decode_bytes(ids)


@functools.lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str) -> Codec:
    """Cached per worker process; the path must exist on every executor."""
    return Codec(ranks_path, pattern)


def _with_columns(df: DataFrame, source: str, outputs: str,
                  make: Callable[[list], list[pa.Array]]) -> DataFrame:
    """The columns of ``df`` and those that ``make`` computes from the column ``source``."""
    made = {f.name.lower() for f in T.StructType.fromDDL(outputs)}
    keep = [c for c in df.columns if c.lower() not in made]
    text = isinstance(df.schema[source].dataType, T.StringType)
    value = C.text_bytes(source) if text else C.col(source)
    work = df.select(*[C.col(c) for c in keep], value.alias("__source"))
    names = [*keep, *T.StructType.fromDDL(outputs).names]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = make(batch.column(batch.num_columns - 1).to_pylist())
        return pa.RecordBatch.from_arrays(list(batch.columns[:-1]) + columns, names=names)

    return C.map_arrow(work, run, C.schema(df, keep, outputs))


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text",
           ids_col: str = "ids") -> DataFrame:
    """``df`` with the token ids of every text as ``array<int>``."""
    def make(raw: list) -> list[pa.Array]:
        enc = codec(ranks_path, pattern)
        return [pa.array([enc.encode(C.decode(x)) for x in raw], pa.list_(pa.int32()))]

    return _with_columns(df, text_col, f"`{ids_col}` array<int>", make)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids",
           bytes_col: str = "decoded") -> DataFrame:
    """``df`` with the raw bytes that every list of ids stands for (null ids: no bytes)."""
    def make(ids: list) -> list[pa.Array]:
        enc = codec(ranks_path, pattern)
        return [pa.array([enc.decode(x or []) for x in ids], pa.binary())]

    return _with_columns(df, ids_col, f"`{bytes_col}` binary", make)


@functools.lru_cache(maxsize=1)
def _decimals() -> list[bytes]:
    return [str(i).encode() for i in range(1 << 16)]


def ids_digest(ids: list[int]) -> str:
    """SHA-256 of the ids as decimals joined by commas."""
    names = _decimals()
    try:
        joined = b",".join([names[i] for i in ids])
    except IndexError:  # a vocabulary of more than 65,536 ranks
        joined = b",".join([str(i).encode() for i in ids])
    return hashlib.sha256(joined).hexdigest()


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Encode, decode and digest every text in one pass, without moving the ids.

    Adds n_tokens, ids_sha256 and decoded_sha256: what ``encode`` and ``decode`` give,
    digested where they are made, since the ids of a corpus are larger than its text.
    """
    out = "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def make(raw: list) -> list[pa.Array]:
        enc = codec(ranks_path, pattern)
        n, digests, back = [], [], []
        for x in raw:
            ids = enc.encode(C.decode(x))
            n.append(len(ids))
            digests.append(ids_digest(ids))
            back.append(hashlib.sha256(enc.decode(ids)).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(digests), pa.array(back)]

    return _with_columns(df, text_col, out, make)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the bytes they decode to, as digests."""
    import public_tokenizers
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text")
    out = round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                     public_tokenizers.PATTERN)
    return out.select("doc_id", F.col("n_tokens").cast("long"), "ids_sha256", "decoded_sha256")
