"""Host-level quality rules (operator 7), in DataFrame functions only.

Every document gets rule counts and fails if it is too short or repeats itself.  Failures
are summed per host; the raw rate of a small host says little, so rates are shrunk with a
beta prior fitted to all hosts by moments.  A host of n documents counts with weight
w = n / (n + HALF), W is the sum of these.  With the weighted mean m of the raw rates p,

    sum w (p - m)^2  =  m (1 - m) (A + r (B - A))   on average, where
    A = sum (w / n) (1 - w / W),   B = sum w (1 - w / W);

A is what the drawing of few documents adds, so the correlation r inside hosts comes without it:

    s = 1 / r - 1, alpha = m s, beta = (1 - m) s,
    rate = (failures + alpha) / (documents + alpha + beta)

A host whose shrunk rate reaches ``max_rate`` is rejected, and its documents with it.  Hosts
are counted with partial aggregation, so a host with a third of all rows is a few numbers
per task; only the rejected hosts are joined back.

Defined results: null text has no words (it fails as too short); a null host belongs to no
host and is never rejected as one; without spread between hosts beyond that of drawing
(r <= 0, also one host or equal rates) the prior weighs like ``MAX_PRIOR`` documents; repeated rows each count; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import common as C
from vellum.session import materialize

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
MAX_RATE = 0.5
#: Documents at which a host counts half in the fit of the prior.
HALF = 9
#: Bounds of alpha + beta, in documents.
MIN_PRIOR, MAX_PRIOR = 2.0, 1000.0
SYMBOLS = r"[#*$%&|<>]"


def _windows(words: Column) -> Column:
    """64-bit hashes of all windows of 8 words, built by doubling (1, 2, 4, 8 words)."""
    def double(h: Column, step: int) -> Column:
        return F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step)))

    eight = C.let(F.transform(words, lambda w: F.xxhash64(w)), lambda one: C.let(
        double(one, 1), lambda two: C.let(double(two, 2), lambda four: double(four, 4))))
    return F.slice(eight, 1, F.size(words) - (WINDOW - 1))


def _covered(windows: Column) -> Column:
    """Words inside windows that occur at least twice: equal hashes become neighbours."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"])
                         | (F.get(s, j + 1)["h"] == x["h"]))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def total(p: Column) -> Column:
        each = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.get(p, j + 1) - x))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)

    return C.let(placed, lambda s: C.let(starts(s), total))


def rule_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(C.col(text_col), F.lit(""))
    blank = F.lit(" \t\n\x0b\f\r")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, blank) != "")
    zero = F.lit(0).cast("long")

    def counts(w: Column) -> Column:
        repeated = C.let(_windows(w), lambda h: F.when(
            F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(_covered(h)))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.when(F.size(w) > WINDOW, repeated).otherwise(zero).alias("n_repeat_words"))

    (c,) = C.fresh(df, "__counts")
    out = df.withColumn(c, C.let(C.words(C.col(text_col)), counts))
    n, repeat = F.col(f"{c}.n_words"), F.col(f"{c}.n_repeat_words")
    return out.withColumns({
        "n_words": n,
        "word_chars": F.col(f"{c}.word_chars"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": C.let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat,
        "base_failed": (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n),
    }).drop(c)


def host_rates(counted: DataFrame, host_col: str) -> DataFrame:
    """(host, docs, failed, rate): every non-null host with its shrunk failure rate."""
    hosts = (counted.where(C.col(host_col).isNotNull()).groupBy(C.col(host_col).alias("host"))
             .agg(F.count("*").alias("docs"), F.sum(F.col("base_failed").cast("long")).alias("failed")))
    n, p = F.col("docs"), F.col("failed") / F.col("docs")
    w = n / (n + HALF)
    total, squares, drawn, drawn_squares, mean, spread = hosts.agg(
        *[F.coalesce(F.sum(x), F.lit(0.0)) for x in (w, w * w, w / n, w * w / n, w * p, w * p * p)]).first()
    m, weight = 0.0, MAX_PRIOR
    if total:
        m = mean / total
        a, b = drawn - drawn_squares / total, total - squares / total
        if m * (1 - m) > 0 and b - a > 1e-9:
            r = ((spread - mean * m) / (m * (1 - m)) - a) / (b - a)
            weight = min(max(1 / r - 1, MIN_PRIOR), MAX_PRIOR) if r > 0 else MAX_PRIOR
    return hosts.withColumn("rate", (F.col("failed") + m * weight) / (F.col("docs") + weight))


def rejected_hosts(counted: DataFrame, host_col: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """(__host) of the hosts whose shrunk rate reaches ``max_rate``; stored, so the planner
    knows its size and rows are not moved to join it where it is small.
    """
    rates = host_rates(counted.select(C.col(host_col), "base_failed"), host_col)
    return materialize(rates.where(F.col("rate") >= max_rate).select(F.col("host").alias("__host")),
                       "rejected-hosts")


def with_verdict(counted: DataFrame, bad: DataFrame, host_col: str = "source") -> DataFrame:
    """Rows with rule counts, and host_rejected and kept."""
    host, flag = C.fresh(counted, "__rejected_host", "__rejected")
    table = bad.select(F.col("__host").alias(host), F.lit(True).alias(flag))
    out = counted.join(table, C.col(host_col) == F.col(host), "left")
    return out.withColumn("host_rejected", F.coalesce(F.col(flag), F.lit(False))).withColumn(
        "kept", ~F.col("base_failed") & ~F.col("host_rejected")).drop(host, flag)


def verdicts(counted: DataFrame, host_col: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """Rows with rule counts, and host_rejected and kept.

    The counted rows are written once to the shared folder: counting is the dear part and
    both the host sums and the verdict need it.
    """
    stored = materialize(counted, "rule-counts")
    return with_verdict(stored, rejected_hosts(stored, host_col, max_rate), host_col)


def judge(df: DataFrame, host_col: str = "source", text_col: str = "text",
          max_rate: float = MAX_RATE) -> DataFrame:
    """``df`` with rule counts, base_failed, host_rejected and kept for every document.

    Nothing but the rejected hosts is stored: the texts are counted twice, once for the hosts
    and once for the result, which is cheaper than keeping a copy of the corpus.
    """
    counted = rule_counts(df, text_col)
    return with_verdict(counted, rejected_hosts(counted, host_col, max_rate), host_col)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and verdict of every document; its source is its host."""
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    counted = rule_counts(docs).drop("text")  # the counts are stored, not the text
    return verdicts(counted).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                    "n_repeat_words", "base_failed", "kept")


#: The same by list functions and window positions, without hashes.
ORACLE_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT rid, doc_id, source, text,
         list_filter(regexp_split_to_array(text, '[ \\t-\\r]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS lines
  FROM d),
win AS (
  SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS k
  FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
twice AS (
  SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt
  FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat FROM twice GROUP BY rid),
c AS (
  SELECT w.rid, doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
h AS (
  SELECT source AS host, count(*) AS docs, sum(CAST(base_failed AS INT)) AS failed
  FROM f WHERE source IS NOT NULL GROUP BY source),
g AS (SELECT docs, failed / docs AS p, docs / (docs + 9) AS w FROM h),
p AS (
  SELECT sum(w * p) / sum(w) AS m, sum(w * p * p) - sum(w * p) * sum(w * p) / sum(w) AS spread,
         sum(w / docs) - sum(w * w / docs) / sum(w) AS a, sum(w) - sum(w * w) / sum(w) AS b FROM g),
q AS (SELECT m, CASE WHEN m * (1 - m) > 0 AND b - a > 1e-9 THEN (spread / (m * (1 - m)) - a) / (b - a) ELSE 0 END AS r
      FROM p),
s AS (SELECT m, CASE WHEN r > 0 THEN least(greatest(1 / r - 1, 2), 1000) ELSE 1000 END AS k FROM q),
bad AS (SELECT host FROM h, s WHERE (failed + m * k) / (docs + k) >= 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND bad.host IS NULL AS kept
FROM f LEFT JOIN bad ON f.source = bad.host
"""
