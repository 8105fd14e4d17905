"""Source divergence audit with dominance skybands (operator 12).

Within a language every source is compared with every other one, and with the language as a
whole, by the smoothed shares of the terms.  Null text, lang and source count as ''.  A term
is a run of ASCII letters and non-ASCII code points, A-Z lower-cased; a language keeps the V
terms that at least ``MIN_DOCS`` of its documents hold.  A group (lang, source), or a whole
language, with N occurrences of kept terms gives a term that it holds c times

    p = 1 + floor(SCALE * (c + 2) / (N + 2 V)),    and two shares differ by
    f = floor((p - q)^2 / (p + q)).

Part ``pair``: every other source of the language, f summed over all kept terms.  Part
``term``: the ``TOP`` kept terms that the group holds and uses more than the language does.

* Counting: a task counts terms by group in Python, ``FLUSH`` entries at most before it hands
  them on, and Spark adds them up, so a hot source arrives pre-aggregated.
* Top terms by dominance: for one group f grows with the group's count and falls with the
  language's count.  A term is dominated by another with no smaller group count, no larger
  language count and an earlier UTF-8 name; that one is then ranked before it.  Every
  partition keeps, for each of its groups, the terms dominated by fewer than ``TOP`` others
  (the skyband); skybands are merged by the same rule, and what is left is ranked exactly.
  A term dominated ``TOP`` times is dominated by ``TOP`` members of the skyband, since the
  first of its dominators in sorted order are themselves dominated less often.
* Pairs: a language's terms are dealt into buckets and its sources into blocks of about
  ``BLOCK``; a task sees one bucket and two blocks as two matrices of shares and returns one
  sum for each pair of sources.  Terms that neither block holds add f of the two smallest
  shares.  Nothing is emitted for each term and pair, and a hot source is one row of a matrix.

All arithmetic is exact: shares by decimals, the rest in 64 bits (shares are at most
SCALE + 1, so squares stay below 2^63).

Defined results: an empty table gives an empty result; a group without terms takes part (its
shares are the smoothing alone); a language without kept terms has pairs of value 0 and no
terms; repeated rows count as often as they occur; keys are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm import common as C
from vellum.session import materialize, ship_package

MIN_DOCS = 10
SCALE = 1_000_000_000
TOP = 10
#: Term counts that a task holds before it hands them on.
FLUSH = 400_000
#: Sources of a block, and terms of a bucket (both on average).
BLOCK = 128
BUCKET = 4096

#: bytes of a term (letters, and all of non-ASCII code points), lower-cased; others end it
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 32
                    for b in range(256))


def terms(raw: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return raw.translate(_TERM_BYTES).split()


def count_terms(df: DataFrame, text_col: str = "text", lang_col: str = "lang",
                source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs), and a row with null term for each group; stored."""
    ship_package(df.sparkSession)
    names = ["lang", "source", "term", "n", "docs"]

    def rows(found: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), table in found.items():
            keys = [None, *table]
            size = len(keys)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()),
                pa.array([k if k is None else k.decode("utf-8", "replace") for k in keys], pa.string()),
                pa.array([0, *(v[0] for v in table.values())], pa.int64()),
                pa.array([0, *(v[1] for v in table.values())], pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = defaultdict(dict)
        held = 0
        for batch in batches:
            for raw, lang, source in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                table = found[lang, source]
                held -= len(table)
                own: dict[bytes, int] = {}
                for t in terms(raw.as_py()):
                    own[t] = own.get(t, 0) + 1
                for t, n in own.items():
                    entry = table.get(t)
                    if entry is None:
                        table[t] = [n, 1]
                    else:
                        entry[0] += n
                        entry[1] += 1
                held += len(table)
                if held > FLUSH:
                    yield from rows(found)
                    found, held = defaultdict(dict), 0
        yield from rows(found)

    def name(c: str):
        return F.make_valid_utf8(F.coalesce(C.col(c).cast("string"), F.lit(""))).alias(c)

    part = df.select(C.text_bytes(text_col).alias("__raw"), name(lang_col), name(source_col)).mapInArrow(
        run, "lang string, source string, term string, n long, docs long")
    return materialize(part.groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")


def _share(count, total, kept):
    """p by decimals; a language without kept terms has no share to give (1)."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)")
    bottom = F.greatest(total + 2 * kept, F.lit(1)).cast("decimal(19,0)")
    return F.call_function("div", top, bottom).cast("long") + 1


def _shares(counts: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """Stored tables of the groups (with the share of an absent term) and of their kept terms."""
    kept = (counts.where("term IS NOT NULL").groupBy("lang", "term")
            .agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs))
    kept = materialize(kept.drop("docs"), "kept-terms")
    held = materialize(counts.where("term IS NOT NULL").drop("docs").join(kept.hint("merge"), ["lang", "term"]),
                       "group-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    sums = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (counts.where("term IS NULL").select("lang", "source")
              .join(langs.hint("merge"), "lang", "left").join(sums.hint("merge"), ["lang", "source"], "left")
              .fillna(0, ["v", "lang_total", "total"]))
    many = Window.partitionBy("lang")
    groups = groups.withColumns({
        "absent": _share(F.lit(0), F.col("total"), F.col("v")),
        "blocks": F.ceil(F.count("*").over(many) / BLOCK).cast("int"),
        "buckets": F.greatest(F.ceil(F.col("v") / BUCKET), F.lit(1)).cast("int")})
    groups = materialize(groups.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")),
                         "source-groups")
    shares = held.join(groups.hint("merge"), ["lang", "source"]).select(
        "lang", "source", "term", "n", "lang_n", "block", "blocks", "buckets",
        _share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
        _share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"))
    return groups, materialize(shares, "term-shares")


# ---- terms: skybands ------------------------------------------------------------------------


def skyband(n: np.ndarray, lang_n: np.ndarray, most: int) -> np.ndarray:
    """Which of a group's terms fewer than ``most`` others dominate.

    The terms come in order of name, so a dominator stands before: with n no smaller and
    lang_n no larger.  Only members of the band are compared with.
    """
    keep = np.zeros(len(n), bool)
    band_n, band_l, size = np.empty(64, np.int64), np.empty(64, np.int64), 0
    for i, (a, b) in enumerate(zip(n.tolist(), lang_n.tolist())):
        if np.count_nonzero((band_n[:size] >= a) & (band_l[:size] <= b)) < most:
            keep[i] = True
            if size == len(band_n):
                band_n, band_l = np.resize(band_n, 2 * size), np.resize(band_l, 2 * size)
            band_n[size], band_l[size] = a, b
            size += 1
    return keep


def band(rows: DataFrame, most: int) -> DataFrame:
    """The skyband of every group within each partition; rows sorted by group and term.

    A group may come in several batches: the band that is kept so far goes before the next
    rows, so memory holds one band and one batch.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            table = table.combine_chunks()
            lang, source = table["lang"].combine_chunks(), table["source"].combine_chunks()
            size = table.num_rows
            if not size:
                continue
            new = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(source[1:], source[:-1]))
            cuts = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), size]
            n, lang_n = table["n"].to_numpy(), table["lang_n"].to_numpy()
            keep = np.concatenate([skyband(n[a:b], lang_n[a:b], most) for a, b in zip(cuts[:-1], cuts[1:])])
            last = cuts[-2]
            yield from table.filter(pa.array(keep & (np.arange(size) < last))).to_batches()
            rest = table.slice(last).filter(pa.array(keep[last:]))
        if rest is not None:
            yield from rest.to_batches()

    ship_package(rows.sparkSession)
    return rows.sortWithinPartitions("lang", "source", "term").mapInArrow(run, rows.schema)


def _difference(p, q):
    return F.call_function("div", (p - q) * (p - q), p + q)


def top_terms(shares: DataFrame, most: int = TOP) -> DataFrame:
    """(lang, source, item, value): the terms a group uses more than its language, best first."""
    own = shares.where(F.col("p") > F.col("q")).select("lang", "source", "term", "n", "lang_n", "p", "q")
    merged = band(band(own, most).repartition("lang", "source"), most)
    value = _difference(F.col("p"), F.col("q"))
    ranked = merged.select("lang", "source", F.col("term").alias("item"), value.alias("value"))
    return _ranked(ranked).where(F.col("rank") <= most)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


# ---- pairs ----------------------------------------------------------------------------------


def block_sums(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sum of f over the columns for each row of the left and each of the right matrix."""
    out = np.empty((len(left), len(right)), np.int64)
    for i, row in enumerate(left):
        gap = right - row
        out[i] = (gap * gap // (right + row)).sum(axis=1)
    return out


def pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, source, item, value): f summed over all kept terms for each ordered pair."""
    ship_package(groups.sparkSession)
    # a block meets each block that is not before it: side 0 as the first, side 1 as the second
    def met(i, j, side: int):
        return F.named_struct(F.lit("i"), i, F.lit("j"), j, F.lit("side"), F.lit(side))

    own = F.col("block")
    first = F.transform(F.sequence(own, F.col("blocks") - 1), lambda x: met(own, x, 0))
    second = F.transform(F.sequence(F.lit(0), own), lambda x: met(x, own, 1))
    both = F.explode(F.concat(first, second)).alias("k")
    entries = shares.select("lang", "source", "term", "p", F.pmod(
        F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket"), both)
    names = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("absent").alias("p"),
                          F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), both)
    rows = entries.unionByName(names).select("lang", "bucket", "k.*", "source", "term", "p")

    def sums(key, table):
        lang, _, i, j = (x.as_py() for x in key)
        side = table["side"].to_numpy()
        source = np.array(table["source"].to_pylist(), object)
        p, absent = table["p"].to_numpy(), table["term"].is_null().to_numpy()
        place = pc.fill_null(table["term"].combine_chunks().dictionary_encode().indices, -1).to_numpy()
        width = int(place.max(initial=-1)) + 1
        matrix, own = [], []
        for k in (0, 1):
            at = absent & (side == k)
            where = {s: r for r, s in enumerate(source[at].tolist())}
            m = np.repeat(p[at][:, None], width, axis=1)
            held = ~absent & (side == k)
            row = np.fromiter((where[s] for s in source[held].tolist()), np.int64, int(held.sum()))
            m[row, place[held]] = p[held]
            matrix.append(m)
            own.append((source[at], p[at]))
        value = block_sums(*matrix)
        (a, pa_), (b, pb) = own
        x, y = (g.ravel() for g in np.meshgrid(np.arange(len(a)), np.arange(len(b)), indexing="ij"))
        other = a[x] != b[y]
        x, y = x[other], y[other]
        return pa.table({
            "lang": pa.array([lang] * len(x), pa.string()), "source": pa.array(a[x].tolist(), pa.string()),
            "item": pa.array(b[y].tolist(), pa.string()), "value": pa.array(value[x, y], pa.int64()),
            "seen": pa.array(np.full(len(x), width), pa.int64()), "p": pa.array(pa_[x], pa.int64()),
            "q": pa.array(pb[y], pa.int64()), "twice": pa.array(np.full(len(x), i != j), pa.bool_())})

    part = rows.groupBy("lang", "bucket", "i", "j").applyInArrow(
        sums, "lang string, source string, item string, value long, seen long, p long, q long, twice boolean")
    one = part.groupBy("lang", "source", "item", "p", "q", "twice").agg(
        F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    kept = groups.groupBy("lang").agg(F.first("v").alias("v"))
    whole = one.join(kept.hint("merge"), "lang").withColumn(
        "value", F.col("value") + (F.col("v") - F.col("seen")) * _difference(F.col("p"), F.col("q")))
    mirrored = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    # blocks that differ are met once, in one order
    return whole.select("lang", "value", F.explode(F.when(F.col("twice"), mirrored)
                                                   .otherwise(F.slice(mirrored, 1, 1))).alias("e")).select(
        "lang", "e.source", "e.item", "value")


def audit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          min_docs: int = MIN_DOCS, most: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of both parts."""
    plain = df.select(C.col(text_col).alias("text"), C.col(lang_col).alias("lang"), C.col(source_col).alias("source"))
    groups, shares = _shares(count_terms(plain), min_docs)
    pair = _ranked(pairs(groups, shares)).withColumn("part", F.lit("pair"))
    term = top_terms(shares, most).withColumn("part", F.lit("term"))
    return pair.unionByName(term).select("lang", "source", "part", "item", "value", "rank")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of every language against the others, and its own terms."""
    return audit(C.read(spark, sf_dir, "documents").select("text", "lang", "source"))


#: Every group with every kept term, all pairs of them, ranked.
ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
o AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM o GROUP BY lang, term HAVING count(DISTINCT rid) >= {MIN_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
s AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
         1 + (({SCALE}::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * l.v)) AS p,
         1 + (({SCALE}::HUGEINT * (kept.lang_n + 2)) // (l.total + 2 * l.v)) AS q
  FROM g JOIN l USING (lang) JOIN kept USING (lang)
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
  LEFT JOIN t ON t.lang = g.lang AND t.source = g.source),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
allpair AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(pair.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
term AS (
  SELECT lang, source, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value
  FROM s WHERE n > 0 AND p > q),
r AS (
  SELECT lang, source, 'pair' AS part, item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM allpair
  UNION ALL
  SELECT lang, source, 'term' AS part, item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM term)
SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank FROM r WHERE part = 'pair' OR rank <= {TOP}
"""
