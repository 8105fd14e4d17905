"""Sum-of-squares packing of token sequences (operator 3).

Documents become token ids plus one separator id; only a document longer than the
capacity is cut, into full pieces and a last one.  Pieces are dealt by a key hash to
shards of about ``SHARD_PIECES`` pieces; every shard is packed on its own by the
sum-of-squares rule.  With N(g) open sequences of residual gap g, a piece of length s
goes where the sum of N(g)^2 becomes smallest:

    into a gap g > s:  2 * (N(g - s) - N(g) + 1)
    into a gap g = s:  1 - 2 * N(g)              (a full sequence is no longer open)
    into a new one:    2 * N(capacity - s) + 1

Ties take the smallest gap.  Within a shard longer pieces come first, which leaves the
short ones to close gaps.  A shard wastes at most a few sequences, so the total stays
close to ceil(tokens / capacity) whatever the number of shards.

Null text is the empty text (the separator alone).  Repeated rows are packed each on
their own.  An empty table gives an empty result.  Other columns do not take part.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import common as C
from vellum.session import materialize, ship_package

CAPACITY = 4096
SEPARATOR = 1
#: Pieces of one shard, all held by one task (about 100 bytes each).
SHARD_PIECES = 20_000
#: Words that one worker remembers at most (about 200 bytes each, for as long as the worker
#: lives); beyond that its memory starts anew.
CACHE_WORDS = 600_000
#: Characters that are encoded together (about 30 bytes of memory each, for a moment).
BATCH_CHARS = 4_000_000

#: Punctuation that, after a letter or digit at the end of a word, is a match of its own
#: (no apostrophe).
_TAIL = ".,;:!?%$&*#"
_PLAIN = re.compile("[a-z]+").fullmatch


class WordEncoder(dict):
    """Token ids of texts by a word-level BPE file of the tokenizers library.

    The vocabulary's pattern drops white space and never matches across it, and its
    normaliser works character by character, so a text's ids are those of its
    space-separated words in turn.  Each distinct word is encoded by the library once and
    remembered as an index into flat arrays; a text is then one gather.

    A special token's own string in a text becomes its id, as the library's plain call does;
    with ``special_as_text`` it is ordinary text and cannot forge a control token.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        super().__init__()
        from tokenizers import Tokenizer
        self._tok = Tokenizer.from_file(path)
        self._tok.encode_special_tokens = special_as_text
        added = [] if special_as_text else self._tok.get_added_tokens_decoder().values()
        # found in the text before it is normalised, so their letters' case counts
        self._special = [t.content for t in added if not t.normalized]
        self._model = self._tok.model
        self._cores: dict[str, list[int]] = {}
        self.forget()

    def forget(self) -> None:
        self.clear()
        self._flat, self._start, self._len = array("I"), array("q"), array("q")

    def _add(self, word: str, ids: list[int] | array) -> int:
        index = len(self._start)
        self._start.append(len(self._flat))
        self._len.append(len(ids))
        self._flat.extend(ids)
        self[word] = index
        return index

    def _known(self, word: str) -> array:
        at = self[word]
        start = self._start[at]
        return self._flat[start:start + self._len[at]]

    def __missing__(self, word: str) -> int:
        core = word.rstrip(_TAIL)
        # A word and the punctuation after it.  The pattern takes a whole run of other
        # characters at once, so the word must end in what stays a letter or digit.
        if core and len(core) < len(word) and core[-1] < "Ā" and core[-1].isalnum():
            return self._add(word, self._known(core) + self._known(word[len(core):]))
        if _PLAIN(word):  # one match of the pattern, mapped to itself
            return self._add(word, [t.id for t in self._model.tokenize(word)])
        return self._add(word, self._tok.encode(word, add_special_tokens=False).ids)

    def _lower(self, text: str) -> str:
        """Lower case, which only saves distinct words.

        Beyond these letters the normaliser does it (it knows no final sigma), and so it does
        where lower-casing makes a special token of what is none.
        """
        if not text.isascii() and max(text) >= "ɐ":
            return text
        low = text.lower()
        same = all(low.count(t) == text.count(t) for t in self._special)
        return low if same else text

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text as unsigned 32-bit numbers.

        Arrow numbers the distinct words of the batch, so Python looks each up once.
        """
        if len(self) > CACHE_WORDS:
            self.forget()
        texts = [self._lower(x) for x in texts]
        parts = pc.split_pattern(pa.array([x.replace("\n", " ") for x in texts],
                                          pa.large_string()), " ")
        coded = parts.values.dictionary_encode()
        known = np.array([self[w] for w in coded.dictionary.to_pylist()], np.int64)
        index = known[coded.indices.to_numpy()]
        start = np.frombuffer(self._start, np.int64)[index]
        size = np.frombuffer(self._len, np.int64)[index]
        end = np.cumsum(size)
        at = np.arange(int(end[-1])) + np.repeat(start - (end - size), size)
        flat = np.frombuffer(self._flat, np.uint32)[at] if len(at) else np.empty(0, np.uint32)
        bounds = np.concatenate([[0], end])[parts.offsets.to_numpy()]
        return [flat[i:j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def encode_all(self, texts: Iterable[str], chars: int = BATCH_CHARS) -> Iterator[np.ndarray]:
        """The ids of the texts in turn, made in batches of about ``chars`` characters."""
        held, n = [], 0
        for x in texts:
            held.append(x)
            n += len(x)
            if n >= chars:
                yield from self.encode_batch(held)
                held, n = [], 0
        if held:
            yield from self.encode_batch(held)


@functools.lru_cache(maxsize=2)
def word_encoder(path: str, special_as_text: bool = False) -> WordEncoder:
    """Cached per worker process; the path must exist on every executor."""
    return WordEncoder(path, special_as_text)


def token_pieces(df: DataFrame, tokenizer_path: str, text_col: str = "text",
                 carry: tuple[str, ...] = (), capacity: int = CAPACITY,
                 separator: int = SEPARATOR, with_ids: bool = False, remember: bool = True,
                 special_as_text: bool = False) -> DataFrame:
    """One row per piece: the carried columns, piece, start, length, ids_crc32 (and ids).

    ``special_as_text``: a text that holds a special token's string does not get its id. With ``remember`` a worker keeps the words it has seen for its next task (about 100 MB);
    without, it also encodes in smaller batches.
    ``ids_crc32`` is the CRC-32 of the ids as little-endian unsigned 32-bit numbers.
    """
    ship_package(df.sparkSession)
    work = df.select(*[C.col(c) for c in carry], C.text_bytes(text_col).alias("__raw"))
    extra = "piece int, start long, length long, ids_crc32 long"
    schema = C.schema(df, carry, extra + ", ids array<int>" * with_ids)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_encoder(tokenizer_path, special_as_text)
        end = np.array([separator], np.uint32)
        for batch in batches:
            row, piece, start, length, crc, out = [], [], [], [], [], []
            texts = (C.decode(x.as_py()) for x in batch.column(batch.num_columns - 1))
            for i, ids in enumerate(enc.encode_all(texts, BATCH_CHARS if remember else BATCH_CHARS // 3)):
                ids = np.concatenate([ids, end]).astype("<u4", copy=False)
                for k, a in enumerate(range(0, len(ids), capacity)):
                    part = ids[a:a + capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        out.append(part.astype(np.int32))
            take = pa.array(row, pa.int64())
            cols = [c.take(take) for c in batch.columns[:-1]]
            cols += [pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                cols.append(pa.array(out, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=names)
        if not remember:
            enc.forget()

    return work.mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length (1..capacity), in the order given."""
    gaps = np.zeros(capacity + 1, np.int64)  # open sequences per residual gap, 0 < g < capacity
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    never = np.iinfo(np.int64).max
    sequence = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    used = 0
    for i, s in enumerate(lengths.tolist()):
        if s < capacity:
            have = gaps[s:capacity]
            cost = np.where(have > 0, 2 * (gaps[:capacity - s] - have + 1), never)
            if have[0]:
                cost[0] = 1 - 2 * have[0]
            k = int(cost.argmin())
            if cost[k] <= 2 * gaps[capacity - s] + 1:
                gap = s + k
                b = open_at[gap].pop()
                gaps[gap] -= 1
            else:
                gap, b, used = capacity, used, used + 1
        else:
            gap, b, used = capacity, used, used + 1
        sequence[i], offset[i] = b, capacity - gap
        if gap > s:
            gaps[gap - s] += 1
            open_at[gap - s].append(b)
    return sequence, offset


def pack(pieces: DataFrame, length_col: str = "length", capacity: int = CAPACITY,
         shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` with sequence_id and offset (both long).

    ``pieces`` must be a stored table: it is read twice, and its rows are dealt by a hash
    of all their columns and their place in the files, so that repeated rows spread.
    """
    ship_package(pieces.sparkSession)
    shards = max(1, math.ceil(pieces.count() / shard_pieces))
    (shard,) = C.fresh(pieces, "__shard")
    key = F.xxhash64(F.monotonically_increasing_id(), *[C.col(c) for c in pieces.columns])
    work = pieces.withColumn(shard, F.pmod(key, F.lit(shards)))
    schema = C.schema(pieces, pieces.columns, "sequence_id long, offset long")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(length_col, ascending=False, kind="stable")
        number, at = sum_of_squares(pdf[length_col].to_numpy(np.int64), capacity)
        base = int(pdf[shard].iloc[0]) << 32
        return pdf.drop(columns=[shard]).assign(sequence_id=base + number, offset=at)

    return work.groupBy(shard).applyInPandas(run, schema)


def pack_documents(df: DataFrame, tokenizer_path: str, text_col: str = "text",
                   carry: tuple[str, ...] = (), capacity: int = CAPACITY,
                   remember: bool = True, special_as_text: bool = False) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its sequence and offset.

    Tokenising is the dear part, so the pieces (a few numbers each) are written once to
    the shared folder and packed from there.
    """
    stored = materialize(token_pieces(df, tokenizer_path, text_col, carry, capacity,
                                      remember=remember, special_as_text=special_as_text), "pieces")
    return pack(stored, capacity=capacity)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, packed into sequences of at most 4096 tokens."""
    import public_tokenizers
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text")
    out = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), carry=("doc_id",))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
