"""SimHash near-duplicates by the generalised pigeonhole principle (operator 5).

A fingerprint has 64 bits; bit b is 1 if it is set in more than half of the XXH64 hashes
(seed 42) of the text's word shingles, repeats included.  Texts without a word have the
fingerprint zero.  Fingerprints that differ in at most ``max_bits`` bits are linked.

Finding the links (generalised pigeonhole): the 64 bits are split into m parts with
thresholds t_1..t_m, where sum(t_i) = max_bits - m + 1.  Two fingerprints within
``max_bits`` then differ in at most t_i bits in some part i.  Part i is probed by
every value within t_i bits of a fingerprint's own value, against the exact values.

* Parts: correlated bits go together.  Bit counts and pairwise co-occurrence of all
  fingerprints (a 64 x 64 table, whatever the input) order the bits.
* Thresholds: dynamic programming over the parts minimises the estimated number of probes
  and candidates; m is chosen by the same estimate.
* Verification is ``bit_count(xor) <= max_bits`` inside the join.

Dense groups: where more than ``HOT_BUCKET`` distinct fingerprints share a part's value,
joining them would emit all pairs of the group.  There every fingerprint that probes the
value emits instead the points within max_bits // 2 bits of itself; two fingerprints share
such a point exactly if they differ in at most max_bits bits (max_bits even).  That is
linear in the group, exact, and no fingerprint is capped or dropped.

Every join of a table that grows with the corpus asks for a sort-merge join: the planner's
size estimate ignores the fan-out of ``explode`` and the width of stored tables in memory,
so it would broadcast them.

Only distinct fingerprints are joined; copies ride on their fingerprint.  Components come
from alternating large-star / small-star rounds on tables in the shared folder.

Defined results: null and word-less texts have fingerprint zero and are linked like any
other; repeated rows stay; component_id is the smallest non-null key of the component (null
if all are null); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import common as C
from vellum.session import materialize

BITS = 64
SEED = 42
#: Distinct fingerprints on one part's value above which points replace pairs.
HOT_BUCKET = 1000
#: Relative cost of a probe row against a candidate pair.
PROBE_COST = 2.0
#: Texts of more shingles are summed in slices of this many.
SLICE = 1 << 16


def fingerprint(text: bytes, shingle: int) -> int:
    """The fingerprint of a UTF-8 text as a signed 64-bit number."""
    words = text.lower().split()  # bytes: only A-Z, only \\x20 and \\x09-\\x0D
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size)
    begin = (end - size)[:n].tolist()
    stop = (end[min(shingle, len(words)) - 1:] - 1).tolist()
    line = memoryview(b" ".join(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(begin, stop)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for a in range(0, n, SLICE):
        bits = np.unpackbits(hashes[a:a + SLICE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > n).tobytes()
    return int.from_bytes(packed, "big", signed=True)


def fingerprints(df: DataFrame, shingle: int, text_col: str = "text",
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """The carried columns and the fingerprint (long) of every text, as column ``fp``."""
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(x.as_py(), shingle) for x in texts], pa.int64())

    fp = C.computed(df, C.text_bytes(text_col), run, "long")
    return df.select(*[C.col(c) for c in carry], fp.alias("fp"))


# ---- plan: parts and thresholds -------------------------------------------------------


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how many have bits i and j set, over all of them."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
        counts = np.zeros((BITS, BITS))
        for a in range(0, len(values), SLICE):
            bits = np.unpackbits(values[a:a + SLICE].astype("<u8").view(np.uint8).reshape(-1, 8),
                                 axis=1, bitorder="little").astype(np.float64)
            counts += bits.T @ bits
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        return pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()),
             pa.array(counts.ravel().astype(np.int64)),
             pa.array(np.full(BITS * BITS, len(values)), pa.int64())],
            names=["i", "j", "n", "rows"])

    part = C.map_arrow(fps.select("fp"), run, "i int, j int, n long, rows long")
    rows = part.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")).collect()
    table = np.zeros((BITS, BITS))
    for r in rows:  # 4,096 rows
        table[r["i"], r["j"]] = r["n"]
    return (int(rows[0]["rows"]) if rows else 0), table


def order_bits(n: int, table: np.ndarray) -> list[int]:
    """Bits in an order that keeps correlated ones together (greedy, ties by number)."""
    p = np.diag(table) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(table / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left = list(range(1, BITS))
    order, near = [0], corr[0].copy()
    while left:
        b = max(left, key=lambda x: (round(near[x], 6), -x))
        left.remove(b)
        order.append(b)
        near = np.maximum(0.7 * near, corr[b])
    return order


def plan_parts(n: int, table: np.ndarray, max_bits: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part, with the least estimated probes and candidates.

    The chance that two fingerprints differ in at most t bits of a part comes from the
    bits' own frequencies; a threshold of -1 leaves a part out.
    """
    order = order_bits(n, table)
    p = np.diag(table) / max(n, 1)
    same = p * p + (1 - p) * (1 - p)
    best: tuple[float, list] | None = None
    for m in range(2, max_bits + 2):
        edges = [round(k * BITS / m) for k in range(m + 1)]
        parts = [sorted(order[a:b]) for a, b in zip(edges[:-1], edges[1:])]
        top = max_bits - m + 1
        cost: list[dict[int, float]] = []
        for bits in parts:
            differ = np.array([1.0])
            for b in bits:
                differ = np.convolve(differ, [same[b], 1 - same[b]])
            within = np.cumsum(differ)
            one = {-1: 0.0}
            for t in range(top + len(parts)):
                probes = sum(math.comb(len(bits), k) for k in range(t + 1))
                one[t] = n * (PROBE_COST * probes + n * float(within[min(t, len(bits))]))
            cost.append(one)
        # dynamic programming: reach[s] = least cost of thresholds that sum to s so far
        reach: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for one in cost:
            step: dict[int, tuple[float, list[int]]] = {}
            for s, (c, ts) in reach.items():
                for t, x in one.items():
                    if s + t not in step or c + x < step[s + t][0]:
                        step[s + t] = (c + x, [*ts, t])
            reach = step
        if best is None or reach[top][0] < best[0]:
            best = (reach[top][0], list(zip(parts, reach[top][1])))
    return [(bits, t) for bits, t in best[1] if t >= 0]


# ---- links ------------------------------------------------------------------------------


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def flips(bits: list[int], most: int) -> list[int]:
    """All ways to flip at most ``most`` of the given bits, as signed masks."""
    return [_signed(sum(1 << b for b in chosen))
            for k in range(most + 1) for chosen in combinations(bits, k)]


def _exploded(fps: DataFrame, parts: list[tuple[list[int], int]], probe: bool) -> DataFrame:
    """(fp, part, value) rows: exact values, or all values within each part's threshold."""
    one = []
    for k, (bits, most) in enumerate(parts):
        mask = _signed(sum(1 << b for b in bits))
        for x in flips(bits, most if probe else 0):
            one.append(F.struct(F.lit(k).alias("part"), F.lit(mask).alias("mask"), F.lit(x).alias("flip")))
    return fps.select("fp", F.explode(F.array(*one)).alias("k")).select(
        "fp", "k.part", F.col("fp").bitwiseAND(F.col("k.mask")).bitwiseXOR(F.col("k.flip")).alias("value"))


def within(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, point) for every point within ``radius`` bits of each fingerprint, each once.

    Bits are flipped in rising order; number 64 stands for no further flip.
    """
    out = fps.select("fp", F.col("fp").alias("point"), F.lit(0).alias("low"))
    for _ in range(radius):
        flip = out.select("fp", "point", F.explode(F.sequence("low", F.lit(BITS))).alias("bit"))
        mask = F.when(F.col("bit") < BITS, F.expr("shiftleft(1L, bit)")).otherwise(F.lit(0).cast("long"))
        out = flip.select("fp", F.col("point").bitwiseXOR(mask).alias("point"),
                          F.least(F.col("bit") + 1, F.lit(BITS)).alias("low"))
    return out.select("fp", "point")


def links(fps: DataFrame, max_bits: int, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Edges (a, b) whose connected components are those of all links of ``fps.fp``.

    ``fps`` holds distinct fingerprints and must be a stored table.  Outside hot values
    the edges are the links themselves, b < a; inside them, b is the smallest
    fingerprint around a common point.
    """
    if max_bits % 2:
        raise ValueError("max_bits must be even: dense groups meet at points half-way")
    n, table = bit_statistics(fps)
    parts = plan_parts(max(n, 1), table, max_bits)
    index = _exploded(fps, parts, probe=False)
    hot = materialize(index.groupBy("part", "value").agg(F.count("*").alias("n"))
                      .where(F.col("n") > hot_bucket).select("part", "value"), "hot-values")
    any_hot = bool(hot.head(1))
    probes = _exploded(fps, parts, probe=True)
    if any_hot:
        index = index.join(hot.hint("merge"), ["part", "value"], "left_anti")
    i, q = index.alias("i"), probes.alias("q")
    near = (F.bit_count(F.col("i.fp").bitwiseXOR(F.col("q.fp"))) <= max_bits)
    pairs = (q.join(i.hint("merge"), (F.col("q.part") == F.col("i.part")) & (F.col("q.value") == F.col("i.value"))
                    & (F.col("i.fp") < F.col("q.fp")) & near)
             .select(F.col("q.fp").alias("a"), F.col("i.fp").alias("b")))
    # the pair may meet with the larger one probing or the smaller one: flips are symmetric,
    # so the larger one's probes reach the smaller one's exact value in either case
    if not any_hot:
        return pairs
    dense = materialize(probes.join(hot.hint("merge"), ["part", "value"], "left_semi").select("fp").distinct(), "dense")
    points = within(dense, max_bits // 2)
    least = (points.groupBy("point").agg(F.min("fp").alias("b"), F.max("fp").alias("top"))
             .where(F.col("b") < F.col("top")).select("point", "b"))
    met = (points.join(least.hint("merge"), "point").where(F.col("fp") > F.col("b"))
           .select(F.col("fp").alias("a"), "b").distinct())
    return pairs.unionByName(met)


# ---- components ----------------------------------------------------------------------------


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, root) for every vertex of (a, b) edges that is not its component's smallest one.

    Alternating large-star / small-star: each round writes one table to the shared folder,
    so lineage stays short and a lost executor costs one round.  Rounds keep components as
    they are, so they may end as soon as the edges are separate stars: no vertex has two
    roots, and no root has one.
    """
    current = materialize(edges.where(F.col("a") != F.col("b"))
                          .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                          .distinct(), "edges")
    for _ in range(max_rounds):
        ends = current.select(F.col("a").alias("v"), F.lit(1).alias("leaf")).unionByName(
            current.select(F.col("b").alias("v"), F.lit(0).alias("leaf")))
        inner = ends.groupBy("v").agg(F.sum("leaf").alias("roots"), F.min("leaf").alias("least"))
        mixed = (F.col("roots") > 1) | ((F.col("roots") == 1) & (F.col("least") == 0))
        if not inner.agg(F.max(mixed)).first()[0]:
            return current.select("a", F.col("b").alias("root"))
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # stored, so that both sides of the join are shuffles and a large star's edges are split
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("u"), F.least("a", "m").alias("m")), "least")
        large = (both.where(F.col("b") > F.col("a")).join(least.hint("merge"), F.col("a") == F.col("u"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")))
        # small-star: a's neighbours are all smaller than a here
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low.hint("merge"), "a").where(F.col("b") != F.col("m"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        current = materialize(small, "edges")
    raise RuntimeError("components did not converge")


def near_duplicates(df: DataFrame, shingle: int, max_bits: int, key_col: str = "doc_id",
                    text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The carried columns, the key, ``fp`` (long) and component_id of every row."""
    keep = (*carry, *([] if key_col in carry else [key_col]))
    docs = materialize(fingerprints(df, shingle, text_col, keep), "fingerprints")
    return docs.join(classes(docs, max_bits, key_col).drop("root").hint("merge"), "fp")


def classes(docs: DataFrame, max_bits: int, key_col: str) -> DataFrame:
    """(fp, root, component_id) of every distinct ``fp`` of a stored table.

    root is the component's own smallest fingerprint, component_id its smallest key.
    """
    unique = materialize(docs.groupBy("fp").agg(F.min(C.col(key_col)).alias("least")), "distinct-fp")
    roots = components(links(unique, max_bits))
    member = unique.join(roots.hint("merge"), unique.fp == roots.a, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return materialize(member.join(smallest.hint("merge"), "root").select("fp", "root", "component_id"), "components")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint (4-word shingles) and component (4 bits or fewer)."""
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text")
    out = near_duplicates(docs, shingle=4, max_bits=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      "component_id")
