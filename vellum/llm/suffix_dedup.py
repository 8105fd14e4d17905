"""Repeated passages by suffix sorting, deep-shallow (operator 13).

Texts are UTF-8 bytes.  A byte goes if a string of ``LENGTH`` bytes covers it that also starts
earlier: in a text of a smaller key, or earlier in the same text.  Strings are judged on the
input and never cross texts.

* Dealing the suffixes: the hash of every ``GRAM`` bytes is taken at each place; the smallest
  one among the LENGTH - GRAM + 1 places of a LENGTH-byte string is the string's anchor (the
  leftmost of equal ones).  It depends on the string alone, so equal strings have equal
  anchors and meet in one group.  Neighbouring starts with one anchor form a segment (about
  34 starts).
* Equal segments collapse: within an anchor the first of equal segments stays, and the others
  go whole, first inside a task's slice of texts, then over all.  So exact copies and
  passages that a third of all rows share are one row per task before anything is sorted.
* Sorting: the different segments that share an anchor are fetched, and all their suffixes
  are sorted, up to LENGTH bytes.  Multikey quicksort orders them by eight bytes at a time,
  every group with its own pivot, to ``SHALLOW`` bytes.  Groups that still agree are ordered by
  blind tries: a suffix is led down by its branching bytes alone, compared once with the
  leaf that it reaches, and put in where they part.  Suffixes equal over LENGTH bytes are one
  leaf; all but the earliest are repeats.
* An anchor with more than ``HOT_SEGMENTS`` different segments is not sorted in one task: its
  segments are cut into single starts, dealt by the hash of their LENGTH bytes; equal ones
  collapse the same way.

Segments are known by two 64-bit hashes (anchor and bytes), texts by key and a 64-bit hash.

Defined results: null text is empty; texts below LENGTH bytes lose nothing; a null key comes
after all others (as 2^63 - 1), ties on the key are ordered by the text's hash; of rows equal
in key and text one is the first, the others are repeats of it; an empty table gives an empty
result.  Work is linear in a text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm import common as C
from vellum.session import materialize, ship_package

LENGTH = 100
GRAM = 32
#: Multikey quicksort stops at this many equal bytes.
SHALLOW = 32
#: Different segments of one anchor that are sorted together; more are dealt by start.
HOT_SEGMENTS = 4096
#: Starts that are hashed at once, and segments after which a task collapses what it has.
SLICE = 1 << 18
HELD = 1 << 17
#: Bytes of segments that are sorted at once.
SORTED = 1 << 20
#: Bytes of texts and segments that one batch hands on.
HANDED = 1 << 24
_NO_KEY = (1 << 63) - 1
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


# ---- anchors and segments ---------------------------------------------------------------


def _words(raw: np.ndarray, count: int) -> np.ndarray:
    """The eight bytes from each of the first ``count`` places on, as numbers."""
    out = np.zeros(count, np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | raw[i:i + count].astype(np.uint64)
    return out


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    n = len(raw) - gram + 1
    eight = _words(raw, n + gram - 8)
    h = np.zeros(n, np.uint64)
    for i in range(0, gram, 8):
        h = (h + eight[min(i, gram - 8):][:n]) * _M1
        h ^= h >> np.uint64(29)
        h *= _M2
        h ^= h >> np.uint64(32)
    return h


def segments(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first start and number of starts of each segment of a text."""
    data = np.frombuffer(raw, np.uint8)
    starts = len(data) - length + 1
    wide = length - gram + 1
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, max(starts, 0), SLICE):
        n = min(SLICE, starts - at)
        h = _gram_hashes(data[at:at + n + length - 1], gram)
        # upper bits of the hash, then the place: the smallest is the leftmost of equal ones
        low = np.uint64((1 << 20) - 1)
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while 2 * size <= wide:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[:n], least[wide - size:][:n])
        place = (least & low).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        found.append((h[place[begin]].view(np.int64), begin + at, np.diff(np.append(begin, n))))
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def _identity(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) - (1 << 63)


_PLACE = ["key", "text_hash", "start", "n"]


def _collapse(rows: list[np.ndarray], groups: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows by group columns, then place; and which rows repeat an earlier one.

    Columns: the group's ``groups`` ones, key, text hash, start.  Rows of one place are one.
    """
    order = np.lexsort(rows[::-1])
    first = np.zeros(len(order), bool)
    first[:1] = True
    for c in rows[:groups]:
        x = c[order]
        first[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(first)[np.cumsum(first) - 1]
    again = np.zeros(len(order), bool)
    for c in rows[groups:groups + 3]:
        x = c[order]
        again |= x != x[at]
    return order, again


#: kinds of rows: repeats of an earlier string; segments to sort; segments to deal by start
REPEAT, SORT, DEAL = 0, 1, 2
_PIECES = "anchor long, body long, key long, text_hash long, start int, n int, kind int"


def _batch(columns: list[np.ndarray], kind) -> pa.RecordBatch:
    a, b, key, text, start, n = columns
    kind = np.broadcast_to(np.asarray(kind, np.int32), a.shape)
    return pa.RecordBatch.from_arrays(
        [pa.array(a), pa.array(b), pa.array(key), pa.array(text), pa.array(start.astype(np.int32)),
         pa.array(n.astype(np.int32)), pa.array(kind)],
        names=["anchor", "body", "key", "text_hash", "start", "n", "kind"])


def _collapsed_pieces(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The held segments: the first of equal ones to be looked at further, the others repeats."""
    rows = [np.concatenate(c) for c in zip(*held)]
    order, again = _collapse(rows, 2)
    rows = [c[order] for c in rows]
    yield _batch([c[~again] for c in rows], SORT)
    yield _batch([c[again] for c in rows], REPEAT)


def _key_and_text(key_col: str, text_col: str) -> tuple[Column, Column]:
    return (F.coalesce(C.col(key_col).cast("long"), F.lit(_NO_KEY)).alias("key"), C.text_bytes(text_col).alias("raw"))


def all_segments(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Every text's segments, equal ones within a task's slice of texts collapsed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = value.as_py()
                anchor, start, n = segments(raw, length, gram)
                if not len(anchor):
                    continue
                view, digest = memoryview(raw), xxhash.xxh64_intdigest
                body = np.fromiter((digest(view[a:b]) for a, b in zip(
                    start.tolist(), (start + n + length - 1).tolist())), np.uint64, len(start)).view(np.int64)
                same = np.full(len(anchor), key, np.int64), np.full(len(anchor), _identity(raw), np.int64)
                held.append([anchor, body, *same, start, n])
                size += len(anchor)
                if size > HELD:
                    yield from _collapsed_pieces(held)
                    held, size = [], 0
        if held:
            yield from _collapsed_pieces(held)

    return texts.mapInArrow(run, _PIECES)


# ---- groups of one anchor -----------------------------------------------------------------


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    for batch in batches:
        if batch.num_rows:
            yield batch
    yield None


def groups(pieces: DataFrame, hot: int = HOT_SEGMENTS) -> DataFrame:
    """Repeats, and the different segments of the anchors that have several; single ones go.

    Of an anchor whose end is not seen yet only the first of equal segments is held, and beyond
    ``hot`` of them they are passed on (kind ``DEAL``) but for the last, which may go on.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        passed: int | None = None
        for batch in _and_end(batches):
            if batch is not None:
                known = pc.equal(batch.column(6), REPEAT)
                yield batch.filter(known)
                batch = batch.filter(pc.invert(known))
                if not batch.num_rows:
                    continue
            rows = [c.to_numpy() for c in batch.columns[:6]] if batch is not None else rest
            if rows is None:
                return
            if batch is not None and rest is not None:
                rows = [np.concatenate(x) for x in zip(rest, rows)]
            order, again = _collapse(rows, 2)
            rows = [c[order] for c in rows]
            yield _batch([c[again] for c in rows], REPEAT)
            rows = [c[~again] for c in rows]
            # rows of one place (a text that stands in several rows) are one segment
            new = np.ones(len(rows[0]), bool)
            new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
            rows = [c[new] for c in rows]
            _, begin, counts = np.unique(rows[0], return_index=True, return_counts=True)
            count = np.repeat(counts, counts)
            many = count > hot
            many |= rows[0] == passed if passed is not None else False
            out = many | (count > 1)
            if batch is not None:  # the last anchor may go on
                last, crowded = begin[-1], bool(many[-1])
                out[last:] = crowded
                out[-1] = False
                passed = int(rows[0][-1]) if crowded else None
                rest = [c[-1:] if crowded else c[last:] for c in rows]
            yield _batch([c[out] for c in rows], np.where(many, DEAL, SORT)[out])

    # what is known to be a repeat need not meet its anchor, and lies anywhere
    place = F.when(F.col("kind") == REPEAT, F.xxhash64("key", "text_hash", "start")).otherwise(F.col("anchor"))
    dealt = pieces.repartition(place).sortWithinPartitions("kind", "anchor", "body", "key", "text_hash", "start")
    return dealt.mapInArrow(run, _PIECES)


# ---- deep-shallow sorting -----------------------------------------------------------------


def multikey_quicksort(eight: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int
                       ) -> tuple[np.ndarray, np.ndarray]:
    """An order of the suffixes inside their groups, and where suffixes that agree begin.

    ``eight`` holds the eight bytes at each place as a number.  Every round splits each
    group by its middle suffix into smaller, equal and larger ones; equal ones go eight bytes
    deeper, to ``depth`` at most.  The result marks the first of each set that agrees so far.
    """
    order = np.argsort(group, kind="stable")
    g = group[order]
    first = np.ones(len(order), bool)
    first[1:] = g[1:] != g[:-1]
    at = np.zeros(len(order), np.int64)
    slot = np.arange(len(order))
    while len(slot):
        begin = np.flatnonzero(first[slot])
        size = np.diff(np.append(begin, len(slot)))
        open_ = np.repeat(size > 1, size) & (at[slot] < depth)
        slot = slot[open_]
        if not len(slot):
            break
        begin = np.flatnonzero(first[slot])
        size = np.diff(np.append(begin, len(slot)))
        of = np.repeat(np.arange(len(begin)), size)
        word = eight[starts[order[slot]] + at[slot]]
        pivot = word[begin + size // 2][of]
        side = (word > pivot).astype(np.int8) + (word >= pivot)
        way = np.lexsort((side, of))
        order[slot] = order[slot][way]
        side = side[way]
        first[slot[1:]] = (of[1:] != of[:-1]) | (side[1:] != side[:-1])
        at[slot] += 8 * (side == 1)
    return order, first


def blind_trie(tails: list[bytes]) -> list[list[int]]:
    """Numbers of the strings (of one length) in order, equal ones together.

    A node is [depth, {byte: node}], a leaf [-1, string, numbers].  A string is led down by
    the bytes at the nodes' depths alone and compared with the leaf where it ends.
    """
    root: list = [-1, tails[0], [0]]
    whole = len(tails[0])
    for k, x in enumerate(tails[1:], 1):
        node = root
        while node[0] >= 0:
            node = node[1].get(x[node[0]]) or next(iter(node[1].values()))
        y = node[1]
        if x == y:
            node[2].append(k)
            continue
        differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
        depth = whole - (differ.bit_length() + 7) // 8
        above, node = None, root
        while 0 <= node[0] < depth:
            above, node = node, node[1][x[node[0]]]
        leaf = [-1, x, [k]]
        if node[0] == depth:
            node[1][x[depth]] = leaf
            continue
        new = [depth, {y[depth]: node, x[depth]: leaf}]
        if above is None:
            root = new
        else:
            above[1][x[above[0]]] = new
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[0] < 0:
            out.append(node[2])
        else:
            stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
    return out


def deep_shallow(data: bytes, starts: np.ndarray, group: np.ndarray, length: int,
                 shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """An order of the suffixes inside their groups, and the first of each set equal over ``length``."""
    shallow = min(shallow, length) // 8 * 8
    padded = np.frombuffer(data + bytes(8), np.uint8)
    order, first = multikey_quicksort(_words(padded, len(data)), starts, group, shallow)
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, len(order)))
    place = starts[order].tolist()
    for a, n in zip(begin[size > 1].tolist(), size[size > 1].tolist()):
        tails = [data[p + shallow:p + length] for p in place[a:a + n]]
        members = order[a:a + n].tolist()
        for leaf in blind_trie(tails):
            order[a:a + len(leaf)] = [members[k] for k in leaf]
            first[a] = True
            a += len(leaf)
    return order, first


def _repeats(rows: list[tuple], length: int) -> pa.RecordBatch:
    """The repeated starts among the segments (anchor, bytes, key, text hash, start, n)."""
    anchor, raw, *place = zip(*rows)
    key, text, start, n = (np.array(x, np.int64) for x in place)
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    of = np.repeat(np.arange(len(raw)), n)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    begin = (np.cumsum(size) - size)[of] + inside
    group = np.unique(np.array(anchor, np.int64), return_inverse=True)[1][of]
    order, first = deep_shallow(b"".join(raw), begin, group, length)
    of, inside = of[order], inside[order]
    # a text that stands in several rows brings a place several times: it repeats other places only
    by_place, later = _collapse([np.cumsum(first), key[of], text[of], start[of] + inside], 1)
    again = by_place[later]
    again = again[np.lexsort((inside[again], of[again]))]
    of, inside = of[again], inside[again]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (inside[1:] != inside[:-1] + 1)
    head = np.flatnonzero(new)
    lead = of[head]
    none = np.zeros(len(head), np.int64)
    return _batch([none, none, key[lead], text[lead], start[lead] + inside[head],
                   np.diff(np.append(head, len(of)))], REPEAT)


def sort_segments(fetched: DataFrame, length: int) -> DataFrame:
    """Repeats among the fetched segments, anchors side by side in a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > SORTED and row[0] != last:
                    yield _repeats(held, length)
                    held, size = [], 0
                held.append(row)
                size += len(row[1])
                last = row[0]
        if held:
            yield _repeats(held, length)

    return fetched.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, _PIECES)


# ---- texts ----------------------------------------------------------------------------------


def packed(df: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """(key, text_hash, given, packed): the texts as they travel, by key and hash."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=3).compress
        raw = [x.as_py() for x in batch.column(1)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([_identity(x) for x in raw], pa.int64()), batch.column(2),
             pa.array([pack(x) for x in raw], pa.binary())], names=["key", "text_hash", "given", "packed"])

    given = df.select(*_key_and_text(key_col, text_col), C.col(key_col).isNotNull().alias("given"))
    return C.map_arrow(given, run, "key long, text_hash long, given boolean, packed binary")


def _handed(rows: Iterator[tuple], sizes: int, fields: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Batches of rows, bounded by the bytes of column ``sizes``."""
    out: list[tuple] = []
    held = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), fields)],
                                          names=[n for n, _ in fields])

    for row in rows:
        out.append(row)
        held += len(row[sizes]) + 64
        if held > HANDED:
            yield batch()
            out, held = [], 0
    if out:
        yield batch()


def _unpack(value: pa.Scalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(value.as_py())


def _of_text(pieces: DataFrame, *names: str) -> DataFrame:
    """One row per text with its pieces, as many as its bytes allow."""
    return pieces.groupBy("key", "text_hash").agg(F.collect_list(F.struct(*names)).alias("pieces"))


def fetch(texts: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """(anchor, bytes, key, text_hash, start, n) of the chosen segments."""
    fields = [("anchor", pa.int64()), ("bytes", pa.binary()), ("key", pa.int64()), ("text_hash", pa.int64()),
              ("start", pa.int32()), ("n", pa.int32())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for key, text, value, pieces in zip(*batch.columns):
                raw, key, text = _unpack(value), key.as_py(), text.as_py()
                for p in pieces.as_py():
                    yield (p["anchor"], raw[p["start"]:p["start"] + p["n"] + length - 1], key, text, p["start"], p["n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _handed(cut(batches), 1, fields)

    # rows equal in key and text are one text here
    joined = texts.select("key", "text_hash", "packed").join(
        _of_text(chosen, "anchor", "start", "n").hint("merge"), ["key", "text_hash"])
    return joined.mapInArrow(run, "anchor long, bytes binary, key long, text_hash long, start int, n int")


def single_starts(fetched: DataFrame, length: int) -> DataFrame:
    """The fetched segments cut into single starts, dealt by the hash of their bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            for _, raw, key, text, start, n in zip(*(c.to_pylist() for c in batch.columns)):
                cut = [raw[i:i + length] for i in range(n)]
                one = np.fromiter(map(_identity, cut), np.int64, n)
                two = np.fromiter((xxhash.xxh64_intdigest(x, 1) - (1 << 63) for x in cut), np.int64, n)
                held.append([one, two, np.full(n, key, np.int64), np.full(n, text, np.int64),
                             start + np.arange(n), np.ones(n, np.int64)])
                size += n
                if size > HELD:
                    yield from _collapsed_pieces(held)
                    held, size = [], 0
        if held:
            yield from _collapsed_pieces(held)

    return fetched.mapInArrow(run, _PIECES)


def removed(raw: bytes, pieces: list[dict], length: int) -> tuple[bytes, int]:
    """A text without the bytes that its repeated starts cover, and the number of runs that go."""
    if not pieces:
        return raw, 0
    start = np.array([p["start"] for p in pieces], np.int64)
    stop = start + np.array([p["n"] for p in pieces], np.int64) + length - 1
    edge = np.zeros(len(raw) + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, stop, -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), runs


def repeats(df: DataFrame, texts: DataFrame, key_col: str, text_col: str, length: int, gram: int,
            hot: int) -> DataFrame:
    """(key, text_hash, start, n): every start of a string that also starts earlier; stored parts."""
    plain = df.select(*_key_and_text(key_col, text_col))
    pieces = materialize(groups(all_segments(plain, length, gram), hot), "segments")
    found = pieces.where(F.col("kind") == REPEAT)
    chosen = pieces.where(F.col("kind") == SORT)
    found = found.unionByName(materialize(sort_segments(fetch(texts, chosen, length), length), "sorted-repeats"))
    crowded = pieces.where(F.col("kind") == DEAL)
    if crowded.head(1):
        single = groups(single_starts(fetch(texts, crowded, length), length), _NO_KEY)
        found = found.unionByName(materialize(single.where(F.col("kind") == REPEAT), "single-repeats"))
    return found


def dedup(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
          gram: int = GRAM, hot: int = HOT_SEGMENTS) -> DataFrame:
    """Per row: the key, kept (binary), n_bytes, n_removed and n_spans."""
    if not 8 <= gram <= length:
        raise ValueError("a gram has 8 bytes at least and lies inside a string")
    ship_package(df.sparkSession)
    texts = packed(df, key_col, text_col)
    found = repeats(df, texts, key_col, text_col, length, gram, hot)
    joined = texts.join(_of_text(found, "start", "n").hint("merge"), ["key", "text_hash"], "left")
    # of rows equal in key and text one is the first
    number = F.row_number().over(Window.partitionBy("key", "text_hash").orderBy("given"))

    fields = [("key", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
              ("n_spans", pa.int64())]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for key, given, value, pieces, number in zip(*batch.columns):
                raw, pieces = _unpack(value), pieces.as_py()
                if number.as_py() > 1:
                    pieces = [{"start": 0, "n": len(raw) - length + 1}] if len(raw) >= length else []
                kept, spans = removed(raw, pieces, length)
                yield key.as_py() if given.as_py() else None, kept, len(raw), len(raw) - len(kept), spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _handed(keep(batches), 1, fields)

    rows = joined.select("key", "given", "packed", "pieces", number.alias("number")).mapInArrow(
        run, "key long, kept binary, n_bytes long, n_removed long, n_spans long")
    return rows.withColumnRenamed("key", key_col)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 100-byte strings that stand earlier in the corpus."""
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
