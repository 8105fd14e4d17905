"""Registered queries over the driver tables, each with its DuckDB oracle SQL.

Every query reads whole driver tables (no id subsets, no row caps).  Column names
and types line up with the oracle: counts are ``bigint``, float results are rounded
to 6 places, array results are rendered as strings.

The forest queries fit one tree of depth 1 without bootstrap on columns of few distinct
values, so that every threshold is a candidate: split, leaf means, importances and chained
predictions are then plain SQL (``sql_stump``).  Without bootstrap and with all features
every tree of a forest is the same, so one tree cuts no work.  ``article_chain_r2`` grows such
trees to their leaves (``sql_tree``).  The reference's bagged forest of 500 trees runs in ``chained_forest`` and ``article_forest``, whose registered
output is what SQL can know of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import dates as D
from vellum.functions import lists as L
from vellum.functions import text as T
from vellum.operators import clean, encode, entities, metrics, model, split
from vellum.plans import enrich as E
from vellum.session import materialize, scratch_path

# ---------------------------------------------------------------------------
# Parameters of the driver-table queries (the driver tables are not news pages, so
# selectors / prefixes / allow-lists are chosen to exercise every branch on them).
# ---------------------------------------------------------------------------
PAGE_SELECTORS = {"body_selector": "article", "category_selector": "h1"}
LICENSE_PREFIXES = (" ", "Licensed", "Released", "This work", "www")
LICENSE_MARKERS = ("Licensed", "Released")
LINE_PREFIXES = ("An", "Er", "La", "En", "Es")
LINE_MARKERS = ("On", "In", "De", "Ge", "Ci", "Th")
VALUE_CAP = 20.0
SOURCE_ALLOW = tuple(f"src{i}" for i in range(10))
ENTITY_DICTIONARY = {"the": "MISC", "de": "LOC", "der": "ORG", "la": "PER", "rewh": "PER",
                     "orre": "LOC", "und": "ORG", "que": "MISC"}
R2_PRICE_FACTOR = 1500.0
SPLIT_THRESHOLD = int(split.TEST_FRACTION * 2 ** 32)
STUMP = model.ForestParams(num_trees=1, max_depth=1, max_bins=64, bootstrap=False)
READ_PARTITIONS = "spark.vellum.read.partitions"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def _wide(df: DataFrame) -> DataFrame:
    """The table, dealt over as many partitions as the session asks for (by default: as read).

    The driver's tables are one row group each, which one task reads; a local session
    sets ``spark.vellum.read.partitions`` to use its cores.  No result depends on it.
    """
    n = df.sparkSession.conf.get(READ_PARTITIONS, None)
    return df.repartition(int(n)) if n else df


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- SQL fragments (DuckDB) ----------------------------------------------------
SQL_WORD = ("[^\\s\\x0B\\x1C-\\x1F\\x85\\xA0\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}"
            "\\x{202F}\\x{205F}\\x{3000}]+")
SQL_WS = SQL_WORD.replace("[^", "[", 1)


def sql_lens(text: str) -> str:
    return (f"list_filter(list_transform(regexp_split_to_array({text}, '\\. |\\n+'), "
            f"lambda s: len(regexp_extract_all(s, '{SQL_WORD}'))), lambda n: n > 10)")


def sql_stats(lens: str, gate: str = "TRUE") -> str:
    return (f"ROUND(CASE WHEN {gate} AND len({lens}) > 0 THEN list_sum({lens}) / len({lens}) "
            f"ELSE 0.0 END, 6) AS avg_sentence_len, "
            f"CAST(CASE WHEN {gate} THEN coalesce(list_max({lens}), 0) ELSE 0 END AS BIGINT) "
            f"AS max_sentence_len, "
            f"CAST(CASE WHEN {gate} THEN coalesce(list_min({lens}), 0) ELSE 0 END AS BIGINT) "
            f"AS min_sentence_len")


def _sql_any_prefix(x: str, prefixes) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {_sql_str(p)})" for p in prefixes) + ")" \
        if prefixes else "FALSE"


def sql_cleaned(text: str, prefixes, markers, with_text: bool = True) -> str:
    """Select list computing the cleaned-text columns from ``text``."""
    keep = f"lambda x: NOT {_sql_any_prefix('x', prefixes)} AND contains(trim(x, ' '), ' ')"
    ls = f"string_split({text}, chr(10))"
    pos = f"coalesce(list_position(list_transform({ls}, lambda x: {_sql_any_prefix('x', markers)}), true), 0)"
    before = f"(CASE WHEN {pos} = 0 THEN {ls} ELSE {ls}[1:{pos} - 1] END)"
    full = f"coalesce(array_to_string(list_filter({ls}, {keep}), ' '), '')"
    bef = f"coalesce(array_to_string(list_filter({before}, {keep}), ' '), '')"
    head = f"{full} AS full_cleaned_text, " if with_text else ""
    return (f"{head}CAST(length({full}) AS BIGINT) AS cleaned_text_length, "
            f"CAST(length({bef}) AS BIGINT) AS cleaned_text_before_pro_length, "
            f"ROUND(length({bef}) / greatest(1, length({full})), 6) AS before_pro_text_ratio")


def _sql_strip(x: str) -> str:
    s = f"regexp_replace({x}, '(?s)<script[^>]*>.*?</script>', '', 'g')"
    s = f"regexp_replace({s}, '(?s)<style[^>]*>.*?</style>', '', 'g')"
    s = f"regexp_replace({s}, '(?s)<!--.*?-->', '', 'g')"
    s = f"regexp_replace({s}, '<[^>]*>', '', 'g')"
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                    ("&amp;", "&")):
        s = f"replace({s}, {_sql_str(ent)}, {_sql_str(ch)})"
    return s


def _sql_has_class(x: str, cls: str) -> str:
    return f"regexp_matches({x}, 'class\\s*=\\s*\"[^\"]*\\b{cls}\\b')"


SQL_PAGE_FEATURES = f"""
pg AS (
  SELECT page_id, html FROM pages
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY url NULLS FIRST, md5(html) NULLS FIRST) = 1),
pb AS (
  SELECT page_id,
    regexp_matches(html, '<article[\\s>]') AS has_body,
    regexp_matches(html, '<h1[\\s>]') AS has_cat,
    regexp_extract(html, '(?s)<article(?:\\s[^>]*)?>(.*?)</article>', 1) AS art,
    regexp_extract(html, '(?s)<h1(?:\\s[^>]*)?>(.*?)</h1>', 1) AS cat_html
  FROM pg),
pt AS (
  SELECT page_id, has_body, has_cat, art,
    CASE WHEN has_body THEN {_sql_strip('art')} ELSE '' END AS text,
    {_sql_strip('cat_html')} AS cat_text
  FROM pb),
pl AS (SELECT *, {sql_lens('text')} AS lens FROM pt),
pf AS (
  SELECT page_id, text,
    CAST(length(text) AS BIGINT) AS text_length,
    CASE WHEN NOT has_body THEN '' WHEN has_cat THEN cat_text ELSE NULL END AS sub_cat,
    CAST(CASE WHEN has_body AND has_cat AND {_sql_has_class('art', 'article__main-image__image')}
         THEN 1 ELSE 0 END AS BIGINT) AS img,
    CAST(CASE WHEN has_body AND has_cat AND {_sql_has_class('art', 'article__inline-video')}
         THEN 1 ELSE 0 END AS BIGINT) AS video,
    CAST(CASE WHEN has_body AND has_cat THEN len(regexp_extract_all(art, '<p[\\s>/]')) ELSE 0 END
         AS BIGINT) AS p,
    CAST(CASE WHEN has_body AND has_cat THEN len(list_filter(
           regexp_extract_all(art, '<a(?:\\s[^>]*)?>'),
           lambda t: NOT regexp_matches(t, 'class\\s*=\\s*("\\s*[^"\\s]|''\\s*[^''\\s]|[^\\s"''>])')))
         ELSE 0 END AS BIGINT) AS a,
    {sql_stats('lens', 'has_body AND has_cat')}
  FROM pl)"""


def sql_entity_list(title: str) -> str:
    cases = " ".join(f"WHEN {_sql_str(k)} THEN {_sql_str(v)}"
                     for k, v in sorted(ENTITY_DICTIONARY.items()))
    norm = "lower(regexp_replace(t, '^[[:punct:]]+|[[:punct:]]+$', '', 'g'))"
    return (f"list_filter(list_transform(regexp_split_to_array({title}, '{SQL_WS}'), "
            f"lambda t: CASE {norm} {cases} ELSE NULL END), lambda x: x IS NOT NULL)")


def sql_holdout(key: str, seed: int = split.SEED) -> str:
    return (f"(('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8))::UBIGINT "
            f"< {SPLIT_THRESHOLD})")


# ---------------------------------------------------------------------------
# Text (T1-T9, A3, P9)
# ---------------------------------------------------------------------------
def q_sentence_stats(spark, d):
    docs = _wide(_t(spark, d, "documents").select("doc_id", "text"))
    out = T.with_sentence_stats(docs, "text")
    return out.select(
        "doc_id", T.text_length("text").cast("long").alias("text_length"),
        F.round("avg_sentence_len", 6).alias("avg_sentence_len"),
        F.col("max_sentence_len").cast("long").alias("max_sentence_len"),
        F.col("min_sentence_len").cast("long").alias("min_sentence_len"),
        "n_long_sentences")


SQL_SENTENCE_STATS = f"""
WITH s AS (SELECT doc_id, text, {sql_lens('text')} AS lens FROM documents)
SELECT doc_id, CAST(length(text) AS BIGINT) AS text_length, {sql_stats('lens')},
  CAST(len(lens) AS BIGINT) AS n_long_sentences
FROM s"""


def _cleaned(spark, d, prefixes, markers):
    docs = _wide(_t(spark, d, "documents").select("doc_id", "text"))
    out = T.with_cleaned_text(docs, "text", prefixes, markers)
    return out.select(
        "doc_id", "full_cleaned_text",
        F.col("cleaned_text_length").cast("long").alias("cleaned_text_length"),
        F.col("cleaned_text_before_pro_length").cast("long")
        .alias("cleaned_text_before_pro_length"),
        F.round("before_pro_text_ratio", 6).alias("before_pro_text_ratio"))


def q_boilerplate_clean(spark, d):
    return _cleaned(spark, d, T.BOILERPLATE_PREFIXES, T.SECTION_MARKERS)


def q_boilerplate_license(spark, d):
    return _cleaned(spark, d, LICENSE_PREFIXES, LICENSE_MARKERS)


def q_boilerplate_midtext(spark, d):
    """T6 / T7 / T9 with prefixes and markers that open lines anywhere in a text."""
    return _cleaned(spark, d, LINE_PREFIXES, LINE_MARKERS)


SQL_BOILERPLATE_CLEAN = (f"SELECT doc_id, {sql_cleaned('text', T.BOILERPLATE_PREFIXES, T.SECTION_MARKERS)} "
                         f"FROM documents")
SQL_BOILERPLATE_LICENSE = (f"SELECT doc_id, {sql_cleaned('text', LICENSE_PREFIXES, LICENSE_MARKERS)} "
                           f"FROM documents")


SQL_BOILERPLATE_MIDTEXT = (f"SELECT doc_id, {sql_cleaned('text', LINE_PREFIXES, LINE_MARKERS)} "
                           f"FROM documents")


# ---------------------------------------------------------------------------
# HTML (H1, A6) and the page join
# ---------------------------------------------------------------------------
HTML_COLUMNS = ("text", "text_length", "sub_cat", "img", "video", "p", "a",
                "avg_sentence_len", "max_sentence_len", "min_sentence_len")


def _typed_page_cols(df: DataFrame) -> list:
    casts = {"text_length": "long", "img": "long", "video": "long", "p": "long", "a": "long",
             "max_sentence_len": "long", "min_sentence_len": "long"}
    cols = []
    for c in HTML_COLUMNS:
        if c in casts:
            cols.append(F.col(c).cast(casts[c]).alias(c))
        elif c == "avg_sentence_len":
            cols.append(F.round(c, 6).alias(c))
        else:
            cols.append(F.col(c))
    return cols


def q_html_features(spark, d):
    feats = E.page_features(_wide(_t(spark, d, "pages")), **PAGE_SELECTORS)
    return feats.select(F.col("__aid").cast("long").alias("page_id"), *_typed_page_cols(feats))


SQL_HTML_FEATURES = f"WITH {SQL_PAGE_FEATURES.strip()}\nSELECT * FROM pf"


PAGE_VARIANTS = {
    # every link of the page counts; footers and bold text stand for image and video
    "links": {"body_selector": "body", "category_selector": "h1", "image_selector": "footer",
              "video_selector": "section"},
    "no_category": {"body_selector": "nav", "category_selector": "h2", "image_selector": "ul",
                    "video_selector": "article"},
    "no_body": {"body_selector": "main", "category_selector": "h1", "image_selector": "footer",
                "video_selector": "footer"},
}


def q_html_variants(spark, d):
    """H1 / A6 with selectors that reach the link, image, video, no-body and no-category rows."""
    pages = _wide(_t(spark, d, "pages"))
    out = None
    for name, selectors in PAGE_VARIANTS.items():
        for independent in (False, True):
            feats = E.page_features(pages, independent=independent, **selectors)
            one = feats.select(
                F.lit(name).alias("variant"), F.lit(independent).alias("independent"),
                F.col("__aid").cast("long").alias("page_id"), "sub_cat",
                *[F.col(c).cast("long").alias(c) for c in ("img", "video", "p", "a")], "page_status")
            out = one if out is None else out.unionByName(one)
    return out


def _sql_html_variants() -> str:
    parts = []
    for name, s in PAGE_VARIANTS.items():
        body = f"regexp_extract(html, '(?s)<{s['body_selector']}(?:\\s[^>]*)?>(.*?)(?:</{s['body_selector']}>|$)', 1)"
        for independent in (False, True):
            has = f"regexp_matches(html, '<{s['body_selector']}[\\s>]')"
            cat = f"regexp_matches(html, '<{s['category_selector']}[\\s>]')"
            ok = has if independent else f"({has} AND {cat})"

            def count(pattern: str, flag: bool = False) -> str:
                n = f"len(regexp_extract_all({body}, '{pattern}'))"
                n = f"least(1, {n})" if flag else n
                return f"CAST(CASE WHEN {ok} THEN {n} ELSE 0 END AS BIGINT)"

            sub = (f"CASE WHEN {cat} THEN cat_text ELSE '' END" if independent else
                   f"CASE WHEN NOT {has} THEN '' WHEN {cat} THEN cat_text END")
            parts.append(f"""
SELECT '{name}' AS variant, {independent} AS independent, page_id,
  {sub} AS sub_cat,
  {count(f"<{s['image_selector']}[\\s>]", True)} AS img,
  {count(f"<{s['video_selector']}[\\s>]", True)} AS video,
  {count('<p[\\s>/]')} AS p, {count('<a[\\s>]')} AS a,
  CASE WHEN NOT {has} THEN 'no_body' WHEN {cat} THEN 'ok' ELSE 'no_category' END AS page_status
FROM clean""")
    h1 = _sql_strip("regexp_extract(html, '(?s)<h1(?:\\s[^>]*)?>(.*?)</h1>', 1)")
    strip = ("regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>', '', 'g'), "
             "'(?s)<!--.*?-->', '', 'g')")
    return f"""
WITH one AS (
  SELECT page_id, html FROM pages
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY url NULLS FIRST, md5(html) NULLS FIRST) = 1),
clean AS (SELECT page_id, {strip} AS html, {h1} AS cat_text FROM one)""" + "\nUNION ALL".join(parts)


SQL_HTML_VARIANTS = _sql_html_variants()


def q_page_join(spark, d):
    """P1 + J4: keys longer than 24 characters are cut to the article id."""
    docs = _t(spark, d, "documents").select(
        F.concat(F.lpad(F.col("doc_id").cast("string"), 24, "0"), F.lit("-v"),
                 F.pmod("doc_id", F.lit(7)).cast("string")).alias("document_id"))
    # the smallest url decides (null first); the html is not read
    pages = _t(spark, d, "pages").groupBy("page_id").agg(
        F.when(F.count("url") == F.count("*"), F.min("url")).alias("url")).select(
        F.lpad(F.col("page_id").cast("string"), 24, "0").alias("__pid"), "page_id", "url")
    j = docs.withColumn("__aid", T.article_id("document_id")) \
        .join(pages, F.col("__aid") == F.col("__pid"), "left")
    return j.select("document_id", "page_id", "url")


SQL_PAGE_JOIN = """
WITH pg AS (
  SELECT page_id, url FROM pages
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY url NULLS FIRST) = 1),
dc AS (SELECT lpad(CAST(doc_id AS VARCHAR), 24, '0') || '-v' || CAST(doc_id % 7 AS VARCHAR) AS document_id
       FROM documents)
SELECT document_id, pg.page_id, pg.url
FROM dc LEFT JOIN pg ON substr(document_id, 1, 24) = lpad(CAST(pg.page_id AS VARCHAR), 24, '0')"""


def _articles_from_documents(spark, d) -> DataFrame:
    """Documents as articles; the entity tagger reads the whole document text."""
    docs = _wide(_t(spark, d, "documents"))
    return docs.select(F.col("doc_id").cast("string").alias("document_id"),
                       F.col("text").alias("title"))


def _enriched_out(out: DataFrame) -> DataFrame:
    return out.select(
        "document_id", *_typed_page_cols(out),
        F.array_join("ents", ",").alias("ents"), F.size("ents").cast("long").alias("n_ents"),
        F.col("cleaned_text_length").cast("long").alias("cleaned_text_length"),
        F.col("cleaned_text_before_pro_length").cast("long")
        .alias("cleaned_text_before_pro_length"),
        F.round("before_pro_text_ratio", 6).alias("before_pro_text_ratio"))


def q_enrich_articles(spark, d):
    """Flagship: the whole enrichment plan (P1, J4, H1, T1-T9, N1/N2) on the driver tables."""
    arts = _articles_from_documents(spark, d)
    pages = _wide(_t(spark, d, "pages"))
    out = E.enrich(arts, pages, key="document_id", title_col="title",
                   dictionary=ENTITY_DICTIONARY, inline=True, prefixes=LICENSE_PREFIXES,
                   markers=LICENSE_MARKERS, **PAGE_SELECTORS)
    return _enriched_out(out)


def q_enrich_articles_colocated(spark, d):
    """The flagship against pages stored bucketed by article id (co-located join)."""
    import uuid

    from vellum.sources.articles import bucket_pages
    table = f"vellum_pages_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket_pages(_t(spark, d, "pages"), table, buckets, scratch_path(spark, "pages-bucketed"))
    out = E.enrich_colocated(_articles_from_documents(spark, d), table, key="document_id",
                             title_col="title", dictionary=ENTITY_DICTIONARY, inline=True,
                             prefixes=LICENSE_PREFIXES, markers=LICENSE_MARKERS,
                             **PAGE_SELECTORS)
    spark.sql(f"DROP TABLE {table}")  # the plan holds the files; only the name goes
    return _enriched_out(out)


SQL_ENRICH_ARTICLES = f"""
WITH {SQL_PAGE_FEATURES.strip()},
ar AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, text AS title FROM documents),
j AS (
  SELECT ar.document_id, ar.title, pf.page_id IS NOT NULL AS found, pf.* EXCLUDE (page_id)
  FROM ar LEFT JOIN pf ON substr(ar.document_id, 1, 24) = CAST(pf.page_id AS VARCHAR)),
f AS (
  SELECT document_id, title,
    CASE WHEN found THEN text ELSE '' END AS text,
    CASE WHEN found THEN text_length ELSE 0 END AS text_length,
    CASE WHEN found THEN sub_cat ELSE '' END AS sub_cat,
    coalesce(img, 0) AS img, coalesce(video, 0) AS video, coalesce(p, 0) AS p,
    coalesce(a, 0) AS a, coalesce(avg_sentence_len, 0.0) AS avg_sentence_len,
    coalesce(max_sentence_len, 0) AS max_sentence_len,
    coalesce(min_sentence_len, 0) AS min_sentence_len
  FROM j),
e AS (SELECT *, {sql_entity_list('title')} AS ents FROM f)
SELECT document_id, text, text_length, sub_cat, img, video, p, a, avg_sentence_len,
  max_sentence_len, min_sentence_len,
  coalesce(array_to_string(ents, ','), '') AS ents, CAST(len(ents) AS BIGINT) AS n_ents,
  {sql_cleaned('text', LICENSE_PREFIXES, LICENSE_MARKERS, with_text=False)}
FROM e"""


# ---------------------------------------------------------------------------
# Dates (D1-D3), cleaning
# ---------------------------------------------------------------------------
def q_date_parts(spark, d):
    ev = _wide(_t(spark, d, "events")).select(
        "event_id", F.date_format("ts", D.PUBLISH_FORMAT).alias("publish_date"))
    ts = D.parse_wall_clock("publish_date")
    parts = D.date_parts(ts)
    return ev.select(
        "event_id",
        *[parts[k].cast("long").alias(k) for k in ("day", "month", "hour")],
        D.hour_flag(parts["hour"]).cast("long").alias("hour_binary"),
        D.hour_flag(parts["hour"], compat=True).cast("long").alias("hour_binary_compat"),
        D.epoch_seconds(ts, "UTC").alias("timestamp"))


SQL_DATE_PARTS = """
WITH e AS (SELECT event_id, date_trunc('second', ts) AS t FROM events)
SELECT event_id, CAST(day(t) AS BIGINT) AS day, CAST(month(t) AS BIGINT) AS month,
  CAST(hour(t) AS BIGINT) AS hour,
  CAST(CASE WHEN hour(t) BETWEEN 7 AND 17 THEN 1 ELSE 0 END AS BIGINT) AS hour_binary,
  CAST(1 AS BIGINT) AS hour_binary_compat,
  CAST(epoch(t) AS DOUBLE) AS timestamp
FROM e"""


def q_cap_impute(spark, d):
    ev = _t(spark, d, "events").select("event_id", "value")
    out = clean.cap_and_impute(ev, "value", cap=VALUE_CAP)
    return out.select("event_id", F.round("value", 6).alias("value"))


SQL_CAP_IMPUTE = f"""
WITH m AS (SELECT avg(value) AS mu FROM events WHERE value <= {VALUE_CAP})
SELECT event_id, ROUND(coalesce(CASE WHEN value <= {VALUE_CAP} THEN value END, m.mu), 6) AS value
FROM events, m"""


def q_rare_bucket(spark, d):
    docs = _t(spark, d, "documents")
    return docs.select("doc_id", clean.bucket_rare("source", SOURCE_ALLOW).alias("source_bucket"))


_SQL_ALLOW = ", ".join(_sql_str(s) for s in SOURCE_ALLOW)
SQL_RARE_BUCKET = (f"SELECT doc_id, CASE WHEN source IN ({_SQL_ALLOW}) THEN source "
                   f"ELSE '{clean.RARE_LABEL}' END AS source_bucket FROM documents")


# ---------------------------------------------------------------------------
# Encoders (A2, O3, E1-E5, J3, D4, T10, T11)
# ---------------------------------------------------------------------------
def q_label_encode(spark, d):
    part = _t(spark, d, "part").select("p_partkey", "p_brand")
    enc = encode.fit_label_encoder(part, "p_brand", "brand_code")
    return enc.transform(part).select("p_partkey", "p_brand",
                                      F.col("brand_code").cast("long").alias("brand_code"))


SQL_LABEL_ENCODE = """
WITH c AS (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code
           FROM (SELECT DISTINCT p_brand FROM part))
SELECT p_partkey, part.p_brand, CAST(code AS BIGINT) AS brand_code
FROM part JOIN c ON part.p_brand = c.p_brand"""


def _orders_authors(spark, d):
    return _t(spark, d, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("author"))


def q_label_encode_unseen(spark, d):
    """Codes fitted on the training split, unseen authors -> -1 (code-table join).

    The code table is built distributed (no driver-side label list); it is broadcast
    only when its counted size is small, otherwise joined by a shuffle.
    """
    orders = _orders_authors(spark, d)
    train, _ = split.split(orders, "o_orderkey")
    codes = encode.fit_code_table(train, "author")
    out = encode.lookup_codes(orders, codes, "author", "author_code")
    return out.select("o_orderkey", "author", F.col("author_code").cast("long").alias("author_code"))


def q_label_encode_default(spark, d):
    """E3 as a fitted model (index lookup inside the task, no join)."""
    orders = _orders_authors(spark, d)
    train, _ = split.split(orders, "o_orderkey")
    enc = encode.fit_label_encoder(train, "author", "author_code", on_unseen="default")
    return enc.transform(orders).select(
        "o_orderkey", "author", F.col("author_code").cast("long").alias("author_code"))


SQL_LABEL_ENCODE_UNSEEN = f"""
WITH o AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS author FROM orders),
c AS (SELECT author, dense_rank() OVER (ORDER BY author) - 1 AS code
      FROM (SELECT DISTINCT author FROM o WHERE NOT {sql_holdout('o_orderkey')}))
SELECT o.o_orderkey, o.author, CAST(coalesce(c.code, -1) AS BIGINT) AS author_code
FROM o LEFT JOIN c ON o.author = c.author"""


def q_bucket_encode(spark, d):
    docs = _t(spark, d, "documents").select(
        "doc_id", clean.bucket_rare("source", SOURCE_ALLOW).alias("source"))
    enc = encode.fit_label_encoder(docs, "source", "source_code")
    return enc.transform(docs).select("doc_id",
                                      F.col("source_code").cast("long").alias("source_code"))


SQL_BUCKET_ENCODE = f"""
WITH b AS (SELECT doc_id, CASE WHEN source IN ({_SQL_ALLOW}) THEN source
                  ELSE '{clean.RARE_LABEL}' END AS s FROM documents),
c AS (SELECT s, dense_rank() OVER (ORDER BY s) - 1 AS code FROM (SELECT DISTINCT s FROM b))
SELECT doc_id, CAST(code AS BIGINT) AS source_code FROM b JOIN c USING (s)"""


def q_list_literal(spark, d):
    part = _t(spark, d, "part")
    lit = L.to_list_literal(F.split("p_name", " ", -1))
    parsed = part.select("p_partkey", "p_brand", "p_type",
                         L.parse_list_literal(lit).alias("items"))
    flat = T.flatten_once(F.array(F.col("items"), F.array("p_brand", "p_type")))
    return parsed.select(
        "p_partkey", F.size("items").cast("long").alias("n_items"),
        F.array_join("items", "|").alias("items"),
        F.size(flat).cast("long").alias("n_flat"), F.array_join(flat, "|").alias("flat"))


SQL_LIST_LITERAL = """
WITH p AS (SELECT p_partkey, p_brand, p_type, string_split(p_name, ' ') AS items FROM part)
SELECT p_partkey, CAST(len(items) AS BIGINT) AS n_items, array_to_string(items, '|') AS items,
  CAST(len(items) + 2 AS BIGINT) AS n_flat,
  array_to_string(list_concat(items, [p_brand, p_type]), '|') AS flat
FROM p"""

# The 16 distinct name tokens of the part table (8 adjectives, 8 nouns), sorted.
PART_TOKENS = ("anvil", "blue", "bolt", "cold", "gear", "gizmo", "hot", "large", "new", "old",
               "plate", "red", "ring", "rod", "small", "widget")


def q_multi_hot(spark, d):
    part = _t(spark, d, "part").select("p_partkey", F.split("p_name", " ", -1).alias("tags"))
    vec = encode.fit_multi_hot(part, "tags", "tags_vec")
    classes = vec.vocabulary
    wide = L.membership("tags", classes, "tags_")
    out = vec.transform(part)
    n_tags = F.aggregate(vector_to_array("tags_vec"), F.lit(0.0), lambda a, x: a + x)
    return out.select("p_partkey", *[c.alias(n) for n, c in wide.items()],
                      n_tags.cast("long").alias("n_tags"))


SQL_MULTI_HOT = ("WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS t FROM part) "
                 "SELECT p_partkey, "
                 + ", ".join(f"CAST(list_contains(t, '{c}') AS INTEGER) AS tags_{c}"
                             for c in PART_TOKENS)
                 + ", CAST(len(list_distinct(t)) AS BIGINT) AS n_tags FROM p")


# ---------------------------------------------------------------------------
# Entities (N1, N2)
# ---------------------------------------------------------------------------
def _entity_out(df: DataFrame) -> DataFrame:
    return df.select(F.col("document_id").cast("long").alias("doc_id"),
                     F.array_join("ents", ",").alias("ents"),
                     F.size("ents").cast("long").alias("n_ents"))


def q_entity_types(spark, d):
    arts = _articles_from_documents(spark, d)
    dictionary = spark.createDataFrame(sorted(ENTITY_DICTIONARY.items()), "token string, label string")
    mentions = entities.dictionary_mentions(arts, dictionary)
    return _entity_out(entities.entity_types(arts, mentions))


def q_entity_types_inline(spark, d):
    arts = _articles_from_documents(spark, d)
    return _entity_out(entities.dictionary_entity_types(arts, ENTITY_DICTIONARY))


SQL_ENTITY_TYPES = f"""
WITH a AS (SELECT doc_id, text AS title FROM documents),
e AS (SELECT doc_id, {sql_entity_list('title')} AS ents FROM a)
SELECT doc_id, coalesce(array_to_string(ents, ','), '') AS ents, CAST(len(ents) AS BIGINT) AS n_ents
FROM e"""


# ---------------------------------------------------------------------------
# Split and metrics (M1, A4, A5)
# ---------------------------------------------------------------------------
def q_hash_split(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey")
    return o.select("o_orderkey", split.holdout_flag("o_orderkey").cast("long").alias("is_test"))


SQL_HASH_SPLIT = (f"SELECT o_orderkey, CAST({sql_holdout('o_orderkey')} AS BIGINT) AS is_test "
                  f"FROM orders")


def q_r2_metric(spark, d):
    li = _t(spark, d, "lineitem")
    pred = F.col("l_quantity") * F.lit(R2_PRICE_FACTOR)
    return li.select("l_extendedprice", pred.alias("p")) \
        .agg(F.round(metrics.r2_expr("l_extendedprice", "p"), 6).alias("r2"))


SQL_R2_METRIC = f"""
SELECT ROUND(1 - sum(pow(l_extendedprice - l_quantity * {R2_PRICE_FACTOR}, 2))
       / (var_pop(l_extendedprice) * count(l_extendedprice)), 6) AS r2
FROM lineitem"""

_COMPOSITE_PAIRS = {
    "views": ("l_extendedprice", f"l_quantity * {R2_PRICE_FACTOR}"),
    "depth": ("l_tax", "l_discount"),
    "full_reads_percent": ("l_quantity", "l_linenumber * 10"),
}


def q_composite_score(spark, d):
    li = _t(spark, d, "lineitem")
    cols = {f"__p_{k}": F.expr(p) for k, (_, p) in _COMPOSITE_PAIRS.items()}
    pairs = {k: (y, f"__p_{k}") for k, (y, _) in _COMPOSITE_PAIRS.items()}
    out = metrics.composite_score(li.withColumns(cols), pairs)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


SQL_COMPOSITE_SCORE = (
    "WITH r AS (SELECT "
    + ", ".join(f"1 - sum(pow({y} - ({p}), 2)) / (var_pop({y}) * count({y})) AS r2_{k}"
                for k, (y, p) in _COMPOSITE_PAIRS.items())
    + " FROM lineitem) SELECT "
    + ", ".join(f"ROUND(r2_{k}, 6) AS r2_{k}" for k in _COMPOSITE_PAIRS)
    + ", ROUND(" + " + ".join(f"{w} * r2_{k}" for k, w in metrics.COMPOSITE_WEIGHTS.items())
    + ", 6) AS score FROM r")


# ---------------------------------------------------------------------------
# Forest chain on lineitem
# ---------------------------------------------------------------------------
LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
LINE_BASE = ("l_quantity", "l_linenumber", "returnflag", "linestatus")
# targets of few distinct values, each related to a feature or to the target before it
LINE_TARGETS = {
    "views": "floor(l_extendedprice / 5000)",
    "depth": "floor(l_extendedprice / 5000) * 2 + l_linenumber",
    "full_reads_percent": "floor(l_extendedprice / 5000) + 3 * l_linenumber + l_quantity % 2",
}


def lineitem_training_table(spark, d) -> tuple[DataFrame, dict[str, list[str]]]:
    """Encoded lineitem rows: scalar features, a part-name tag block, three targets."""
    li = _wide(_t(spark, d, "lineitem"))
    part = _t(spark, d, "part").select("p_partkey", F.split("p_name", " ", -1).alias("tags"))
    rows = li.join(part, li.l_partkey == part.p_partkey, "left").withColumn(
        "tags", F.coalesce("tags", F.array().cast("array<string>")))
    flag = encode.fit_label_encoder(li, "l_returnflag", "returnflag")
    status = encode.fit_label_encoder(li, "l_linestatus", "linestatus")
    tags = encode.fit_multi_hot(part, "tags", "tags_vec")
    rows = status.transform(flag.transform(rows))
    rows = tags.transform(rows).select(
        *LINE_KEY, "l_quantity", "returnflag", "linestatus", "tags_vec",
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_key"),
        *[F.expr(f"CAST({src} AS DOUBLE)").alias(t) for t, src in LINE_TARGETS.items()])
    blocks = {"tags_vec": encode.feature_names("tags_", tags.vocabulary)}
    return rows, blocks


def line_targets(params: model.ForestParams = STUMP) -> list[model.Target]:
    base = [*LINE_BASE, "tags_vec"]
    return [model.Target("views", base, params),
            model.Target("depth", base + ["views"], params),
            model.Target("full_reads_percent", base + ["views", "depth"], params)]


def _line_chain(spark, d, params=STUMP):
    rows, blocks = lineitem_training_table(spark, d)
    train, test = split.split(rows, "row_key")
    return model.fit_chain(train, line_targets(params), LINE_KEY), train, test, blocks


def _line_predictions(chain, test):
    out = model.score_chain(chain, test, keep=LINE_KEY)
    return out.select(*LINE_KEY, *[F.round(t, 6).alias(t) for t in LINE_TARGETS])


def q_chained_score(spark, d):
    chain, _, test, _ = _line_chain(spark, d)
    return _line_predictions(chain, test)


def q_pipeline_roundtrip(spark, d):
    from pyspark.ml import PipelineModel
    chain, _, test, _ = _line_chain(spark, d)
    path = scratch_path(spark, "chain")
    chain.write().overwrite().save(path)
    return _line_predictions(PipelineModel.load(path), test)


def q_chain_r2(spark, d):
    """Hold-out R^2 per link, each fed the true upstream targets, and the composite."""
    from vellum.plans.train import holdout_scores
    chain, _, test, _ = _line_chain(spark, d)
    scores = holdout_scores(chain, test)
    row = {f"r2_{k}": round(float(v), 6) for k, v in scores.items()}
    row["score"] = round(float(sum(metrics.COMPOSITE_WEIGHTS[k] * v for k, v in scores.items())), 6)
    return spark.createDataFrame([row])


def _line_importances(spark, d, target: model.Target):
    rows, blocks = lineitem_training_table(spark, d)
    train, _ = split.split(rows, "row_key")
    fitted = model.fit_forest(model.laid_out(train, LINE_KEY), target.features, target.name, target.params)
    names = model.feature_names(target.features, blocks)
    return model.importance_table(spark, model.forest_of(fitted), names)


def q_importance_top(spark, d):
    return _line_importances(spark, d, line_targets()[0]).limit(5)


def q_feature_select(spark, d):
    """Tags that matter for the part's price (a forest over the tag block alone)."""
    target = model.Target("views", ["tags_vec"], STUMP)
    return model.select_by_importance(_line_importances(spark, d, target))


def q_chained_forest(spark, d):
    """The reference's 500 bagged trees (depth 3 here): what can be known of the predictions."""
    params = model.ForestParams(max_depth=3, max_bins=64)
    chain, train, test, _ = _line_chain(spark, d, params)
    bounds = train.agg(*[f(t).alias(f"{n}_{t}") for t in LINE_TARGETS for n, f in (("lo", F.min), ("hi", F.max))])
    scored = model.score_chain(chain, test, keep=LINE_KEY)
    r = bounds.first()  # one row
    return scored.select(*LINE_KEY, *[
        F.col(t).between(r[f"lo_{t}"], r[f"hi_{t}"]).alias(f"{t}_in_range") for t in LINE_TARGETS])


# --- the same in SQL: a depth-1 regression tree is one pass over sorted distinct values ---
def sql_stump(name: str, rows: str, features, target: str, min_leaf: int = 1, allowed: str = "TRUE") -> str:
    """CTEs ending in ``name``: (feature, threshold, lm, rm) of the best split of ``rows``.

    Every midpoint of neighbouring distinct values is a candidate; the gain is the fall in
    the sum of squares; ties go to the earlier feature, then the lower threshold.
    """
    values = " UNION ALL ".join(
        f"SELECT {i} AS i, '{f}' AS feature, CAST({f} AS DOUBLE) AS v, count(*) AS n, sum({target}) AS s "
        f"FROM {rows} GROUP BY 3" for i, f in enumerate(features))
    return f"""
{name}_v AS ({values}),
{name}_c AS (
  SELECT *, sum(n) OVER w AS ln, sum(s) OVER w AS ls, sum(n) OVER (PARTITION BY i) AS tn,
         sum(s) OVER (PARTITION BY i) AS ts, lead(v) OVER (PARTITION BY i ORDER BY v) AS nv
  FROM {name}_v WINDOW w AS (PARTITION BY i ORDER BY v ROWS UNBOUNDED PRECEDING)),
{name}_g AS (
  SELECT i, feature, (v + nv) / 2 AS threshold, ls / ln AS lm, (ts - ls) / (tn - ln) AS rm,
         ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln) - ts * ts / tn AS gain
  FROM {name}_c WHERE nv IS NOT NULL AND ln >= {min_leaf} AND tn - ln >= {min_leaf} AND ({allowed})),
{name} AS (SELECT * FROM {name}_g ORDER BY gain DESC, i, threshold LIMIT 1)"""


def sql_predict(stump: str, features) -> str:
    """The stump's prediction for a row whose columns are in scope, as a scalar expression."""
    value = " ".join(f"WHEN '{f}' THEN CAST({f} AS DOUBLE)" for f in features)
    return (f"CASE WHEN (CASE (SELECT feature FROM {stump}) {value} END) <= (SELECT threshold FROM {stump}) "
            f"THEN (SELECT lm FROM {stump}) ELSE (SELECT rm FROM {stump}) END")


def sql_chain(rows: str, targets: dict[str, list], min_leaf: dict | None = None, allowed: str = "TRUE",
              prefix: str = "m") -> str:
    """CTEs of one stump per target over the training rows, with true upstream targets."""
    return ",".join(sql_stump(f"{prefix}_{t}", rows, f, t, (min_leaf or {}).get(t, 1), allowed)
                    for t, f in targets.items())


def sql_chain_scores(test: str, targets: dict[str, list], prefix: str = "m") -> str:
    """CTEs that end in ``scored``: each target replaced by its prediction, in chain order."""
    out, source = [], test
    for t, f in targets.items():
        out.append(f"s_{t} AS (SELECT * REPLACE ({sql_predict(f'{prefix}_{t}', f)} AS {t}) FROM {source})")
        source = f"s_{t}"
    out.append(f"scored AS (SELECT * FROM {source})")
    return ",\n".join(out)


def sql_chain_r2(test: str, targets: dict[str, list], prefix: str = "m") -> str:
    """R^2 per target on ``test`` with true upstream targets, rounded, and the composite."""
    cols = [f"1 - sum(pow({t} - p_{t}, 2)) / (var_pop({t}) * count(*)) AS r2_{t}" for t in targets]
    preds = [f"{sql_predict(f'{prefix}_{t}', f)} AS p_{t}" for t, f in targets.items()]
    score = " + ".join(f"{metrics.COMPOSITE_WEIGHTS[t]} * r2_{t}" for t in targets)
    return (f"p AS (SELECT *, {', '.join(preds)} FROM {test}), r AS (SELECT {', '.join(cols)} FROM p)\n"
            f"SELECT {', '.join(f'ROUND(r2_{t}, 6) AS r2_{t}' for t in targets)}, "
            f"ROUND({score}, 6) AS score FROM r")


def sql_tree(name: str, rows: str, features, target: str, min_leaf: int = 1, max_depth: int = 30) -> str:
    """CTEs ending in ``name``: (rid, y, p) of the hold-out rows, predicted by one regression tree of the others.

    Thresholds as in ``sql_stump``, the same in every node; a node whose labels differ is split at its best gain while
    both sides keep ``min_leaf`` rows; gains within 1e-9 of the node's sum of squares are equal.  WITH RECURSIVE.
    """
    n = len(features)
    return f"""
{name}_x AS (SELECT row_number() OVER () AS rid, is_test, CAST({target} AS DOUBLE) AS y,
  [{', '.join(f'CAST({f} AS DOUBLE)' for f in features)}] AS xs FROM {rows}),
{name}_th AS (SELECT i, v, (v + lead(v) OVER (PARTITION BY i ORDER BY v)) / 2 AS thr FROM (
  SELECT DISTINCT unnest(range(1, {n + 1})) AS i, unnest(xs) AS v FROM {name}_x WHERE NOT is_test)),
{name}_t(depth, node, rid, is_test, y, xs, p) AS (
  SELECT 0, CAST(1 AS BIGINT), rid, is_test, y, xs, (SELECT avg(y) FROM {name}_x WHERE NOT is_test) FROM {name}_x
  UNION ALL
  SELECT depth + 1, node, rid, is_test, y, xs, avg(y) FILTER (NOT is_test) OVER (PARTITION BY node) FROM (
    SELECT depth, 2 * t.node + CASE WHEN xs[i] <= thr THEN 0 ELSE 1 END AS node, rid, is_test, y, xs
    FROM {name}_t t JOIN (
      SELECT node, i, thr FROM (
        SELECT *, max(gain) OVER (PARTITION BY node) AS top FROM (
          SELECT node, i, v, spread, ls * ls * tn / (ln * (tn - ln)) AS gain FROM (
            SELECT node, i, v, any_value(tn) AS tn, any_value(spread) AS spread,
                   sum(count(*)) OVER w AS ln, sum(sum(c)) OVER w AS ls
            FROM (
              SELECT node, tn, c, sum(c * c) OVER (PARTITION BY node) AS spread,
                     unnest(range(1, {n + 1})) AS i, unnest(xs) AS v
              FROM (SELECT node, xs, y - avg(y) OVER p AS c, count(*) OVER p AS tn, min(y) OVER p < max(y) OVER p AS more
                    FROM {name}_t WHERE NOT is_test AND depth < {max_depth} WINDOW p AS (PARTITION BY node))
              WHERE more)
            GROUP BY node, i, v WINDOW w AS (PARTITION BY node, i ORDER BY v ROWS UNBOUNDED PRECEDING))
          WHERE ln >= {min_leaf} AND tn - ln >= {min_leaf}))
      JOIN {name}_th USING (i, v) WHERE top > 1e-9 * spread AND gain >= top - 1e-9 * spread
      QUALIFY row_number() OVER (PARTITION BY node ORDER BY i, v) = 1) b ON t.node = b.node)),
{name} AS (SELECT rid, any_value(y) AS y, arg_max(p, depth) AS p FROM {name}_t WHERE is_test GROUP BY rid)"""


def sql_trees_r2(rows: str, targets: dict[str, list], min_leaf: dict | None = None, prefix: str = "m") -> str:
    """R^2 per target of whole trees with true upstream targets, rounded, and the composite.  WITH RECURSIVE."""
    trees = ",".join(sql_tree(f"{prefix}_{t}", rows, f, t, (min_leaf or {}).get(t, 1)) for t, f in targets.items())
    r2 = ", ".join(f"(SELECT 1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)) FROM {prefix}_{t}) AS r2_{t}" for t in targets)
    score = " + ".join(f"{metrics.COMPOSITE_WEIGHTS[t]} * r2_{t}" for t in targets)
    return (f"{trees},\nr AS (SELECT {r2})\nSELECT {', '.join(f'ROUND(r2_{t}, 6) AS r2_{t}' for t in targets)}, "
            f"ROUND({score}, 6) AS score FROM r")


_TAGS = [f"tags_{c}" for c in PART_TOKENS]
_LINE_FEATURES = {
    "views": [*LINE_BASE, *_TAGS],
    "depth": [*LINE_BASE, *_TAGS, "views"],
    "full_reads_percent": [*LINE_BASE, *_TAGS, "views", "depth"],
}
SQL_LINES = f"""
pt AS (SELECT p_partkey, string_split(p_name, ' ') AS t FROM part),
fc AS (SELECT l_returnflag, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS returnflag
       FROM (SELECT DISTINCT l_returnflag FROM lineitem)),
sc AS (SELECT l_linestatus, dense_rank() OVER (ORDER BY l_linestatus) - 1 AS linestatus
       FROM (SELECT DISTINCT l_linestatus FROM lineitem)),
li AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, returnflag, linestatus,
    {', '.join(f"CAST(coalesce(list_contains(t, '{c}'), false) AS INT) AS tags_{c}" for c in PART_TOKENS)},
    {', '.join(f'CAST({src} AS DOUBLE) AS {t}' for t, src in LINE_TARGETS.items())},
    {sql_holdout("concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey)")} AS is_test
  FROM lineitem JOIN fc USING (l_returnflag) JOIN sc USING (l_linestatus)
  LEFT JOIN pt ON l_partkey = p_partkey),
tr AS (SELECT * FROM li WHERE NOT is_test), te AS (SELECT * FROM li WHERE is_test)"""
_SQL_KEY = ", ".join(LINE_KEY)
SQL_CHAINED_SCORE = (f"WITH {SQL_LINES.strip()}, {sql_chain('tr', _LINE_FEATURES)},\n"
                     f"{sql_chain_scores('te', _LINE_FEATURES)}\nSELECT {_SQL_KEY}, "
                     + ", ".join(f"ROUND({t}, 6) AS {t}" for t in LINE_TARGETS) + " FROM scored")
SQL_CHAIN_R2 = (f"WITH {SQL_LINES.strip()}, {sql_chain('tr', _LINE_FEATURES)},\n"
                f"{sql_chain_r2('te', _LINE_FEATURES)}")
SQL_IMPORTANCE_TOP = (
    f"WITH {SQL_LINES.strip()}, {sql_stump('m', 'tr', _LINE_FEATURES['views'], 'views')},\n"
    f"n AS (SELECT unnest({_LINE_FEATURES['views']!r}) AS name)\n"
    "SELECT name, CAST(CASE WHEN name = (SELECT feature FROM m) THEN 1 ELSE 0 END AS DOUBLE) AS value "
    "FROM n ORDER BY value DESC, name LIMIT 5")
SQL_FEATURE_SELECT = (f"WITH {SQL_LINES.strip()}, {sql_stump('m', 'tr', _TAGS, 'views')}\n"
                      "SELECT feature AS name, CAST(1 AS DOUBLE) AS value FROM m WHERE gain > 0")
SQL_CHAINED_FOREST = (f"WITH {SQL_LINES.strip()}\nSELECT {_SQL_KEY}, "
                      + ", ".join(f"true AS {t}_in_range" for t in LINE_TARGETS) + " FROM te")


# ---------------------------------------------------------------------------
# The article pipeline itself (3.2 + 3.3) on articles derived from the driver tables
# ---------------------------------------------------------------------------
ORDER_PRIORITY_ALLOW = ("1-URGENT", "2-HIGH", "3-MEDIUM")
ARTICLE_STUMP = model.ForestParams(num_trees=1, max_depth=1, max_bins=2048, bootstrap=False)
#: The reference's depth, as deep as the library's trees go; every tree of such a forest is the same without a draw.
ARTICLE_TREE = model.ForestParams(num_trees=1, max_depth=model.MLLIB_MAX_DEPTH, max_bins=2048, bootstrap=False)
LIST_TYPE = "array<struct<l_linenumber:int,l_returnflag:string>>"


def orders_as_articles(spark, d) -> DataFrame:
    """Orders in the raw-article schema, enriched with page features.

    author = customer group, category = order status, sub-category = priority, tags = the
    part-name tokens of the order's lines, entity types = the line return flags in line
    order; targets are line aggregates (the full-reads target exceeds 100 on some rows,
    so the cap and the imputation run).  Page features come from the enrichment plan
    (most orders have no page: the failed-fetch defaults).
    """
    o = _t(spark, d, "orders")
    li = _wide(_t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber",
                                               "l_extendedprice", "l_quantity", "l_discount",
                                               "l_returnflag"))
    part = _t(spark, d, "part").select("p_partkey", "p_name")
    lines = li.join(part, li.l_partkey == part.p_partkey, "left")
    per_order = lines.groupBy("l_orderkey").agg(
        F.sum(F.floor(F.col("l_extendedprice") / 5000)).cast("double").alias("views"),
        F.sum("l_quantity").alias("depth"),
        (F.sum(F.round(F.col("l_discount") * 100)) * 15 / F.count("*")).alias("full_reads_percent"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(
            F.split(F.coalesce("p_name", F.lit("")), " ", -1))))).alias("tags"),
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("__rf"))
    month = F.date_trunc("month", "o_orderdate").cast("long") + F.pmod("o_orderkey", F.lit(4)) * 6 * 3600
    arts = o.join(per_order, o.o_orderkey == per_order.l_orderkey, "left").select(
        F.col("o_orderkey").cast("string").alias("document_id"),
        F.col("o_orderpriority").alias("title"),
        F.date_format(F.timestamp_seconds(month), D.PUBLISH_FORMAT).alias("publish_date"),
        F.pmod("o_custkey", F.lit(50)).cast("string").alias("authors"),
        F.col("o_orderstatus").alias("category"),
        F.array_remove(F.coalesce("tags", F.array().cast("array<string>")), "").alias("tags"),
        F.coalesce("__rf", F.array().cast(LIST_TYPE)).getField("l_returnflag").alias("ents"),
        F.floor(F.col("o_totalprice") / 20000).cast("double").alias("ctr"),
        F.coalesce("views", F.lit(0.0)).alias("views"),
        F.coalesce("depth", F.lit(0.0)).alias("depth"),
        F.col("full_reads_percent"))
    pages = _t(spark, d, "pages")
    enriched = E.enrich(arts, pages, key="document_id", title_col="title",
                        prefixes=LICENSE_PREFIXES, markers=LICENSE_MARKERS, **PAGE_SELECTORS)
    return enriched.withColumn("sub_cat", F.col("title"))


def _train_articles(spark, d, params=ARTICLE_STUMP):
    """Enriched articles are written once (a table in the shared checkpoint folder), as
    the reference writes its enriched table; training and scoring read that table."""
    from vellum.plans import train as TR
    arts = materialize(orders_as_articles(spark, d), "articles")
    trained = TR.train(arts, params=params, zone="UTC", allowed=ORDER_PRIORITY_ALLOW)
    return arts, trained


def _rounded_scores(df: DataFrame) -> DataFrame:
    return df.select("document_id", *[F.round(t, 6).alias(t) for t in LINE_TARGETS])


def q_article_chain(spark, d):
    """Train the three-target chain on the training split, score the hold-out split."""
    from vellum.plans import score as SC
    arts, trained = _train_articles(spark, d)
    _, test = split.split(arts, "document_id")
    return _rounded_scores(SC.score(test, trained, zone="UTC"))


def q_article_chain_r2(spark, d):
    """Hold-out R^2 per target (true upstream targets) and the composite, of trees grown to their leaves."""
    _, trained = _train_articles(spark, d, ARTICLE_TREE)
    row = {f"r2_{k}": round(float(v), 6) for k, v in trained.scores.items()}
    row["score"] = round(float(trained.composite), 6)
    return spark.createDataFrame([row])


def q_article_tag_selection(spark, d):
    """P11 end to end: keep tags with full-reads importance >= 1e-7, retrain, score."""
    from vellum.plans import score as SC
    from vellum.plans import train as TR
    arts, trained = _train_articles(spark, d)
    keep = TR.select_tags(spark, trained, "full_reads_percent")
    again = TR.train(arts, params=ARTICLE_STUMP, zone="UTC", allowed=ORDER_PRIORITY_ALLOW,
                     tag_selection=keep)
    _, test = split.split(arts, "document_id")
    return _rounded_scores(SC.score(test, again, zone="UTC"))


def q_article_forest(spark, d):
    """The reference's 500 bagged trees (depth 3 here) on articles: keys and ranges."""
    from vellum.plans import score as SC
    arts, trained = _train_articles(spark, d, model.ForestParams(max_depth=3, max_bins=64))
    train, test = split.split(arts, "document_id")
    r = train.agg(F.min("views").alias("a"), F.max("views").alias("b"), F.min("depth").alias("c"),
                  F.max("depth").alias("d")).first()  # one row
    out = SC.score(test, trained, zone="UTC")
    return out.select("document_id", F.col("views").between(r["a"], r["b"]).alias("views_in_range"),
                      F.col("depth").between(r["c"], r["d"]).alias("depth_in_range"),
                      F.col("full_reads_percent").between(0, clean.FULL_READS_CAP)
                      .alias("full_reads_percent_in_range"))


_ENTS = ["ents_A", "ents_N", "ents_R"]


def _article_features() -> dict[str, list[str]]:
    """P3-P5 by slot name; a reserved word is quoted."""
    tail = [*_ENTS, *_TAGS]
    return {"views": [*model.VIEWS_FEATURES, *tail], "depth": [*model.DEPTH_FEATURES, *tail],
            "full_reads_percent": [*model.FRP_FEATURES, *tail]}


SQL_ARTICLES = f"""
{SQL_PAGE_FEATURES.strip()},
ln AS (
  SELECT l_orderkey, CAST(sum(floor(l_extendedprice / 5000)) AS DOUBLE) AS views, sum(l_quantity) AS depth,
    sum(round(l_discount * 100)) * 15 / count(*) AS frp, list(l_returnflag) AS rf,
    list_distinct(flatten(list(string_split(coalesce(p_name, ''), ' ')))) AS tags
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
a0 AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS document_id, CAST(o_custkey % 50 AS VARCHAR) AS author,
    o_orderstatus AS cat, CASE WHEN o_orderpriority IN ({", ".join(map(_sql_str, ORDER_PRIORITY_ALLOW))})
      THEN o_orderpriority ELSE '{clean.RARE_LABEL}' END AS sub,
    date_trunc('month', o_orderdate) + to_hours(CAST((o_orderkey % 4) * 6 AS BIGINT)) AS ts,
    floor(o_totalprice / 20000) AS ctr, coalesce(views, 0) AS views, coalesce(depth, 0) AS depth,
    CASE WHEN frp <= {clean.FULL_READS_CAP} THEN frp END AS frp, coalesce(rf, []) AS rf, coalesce(tags, []) AS tags
  FROM orders LEFT JOIN ln ON o_orderkey = l_orderkey),
a1 AS (
  SELECT a0.*, coalesce(pf.text, '') AS text, coalesce(text_length, 0) AS text_length, coalesce(img, 0) AS img,
    coalesce(video, 0) AS video, coalesce(a, 0) AS a, coalesce(p, 0) AS p,
    coalesce(avg_sentence_len, 0) AS avg_sentence_len, coalesce(max_sentence_len, 0) AS max_sentence_len,
    coalesce(min_sentence_len, 0) AS min_sentence_len
  FROM a0 LEFT JOIN pf ON substr(document_id, 1, 24) = CAST(page_id AS VARCHAR)),
a2 AS (SELECT *, {sql_cleaned('text', LICENSE_PREFIXES, LICENSE_MARKERS, with_text=False)} FROM a1),
ca AS (SELECT author, dense_rank() OVER (ORDER BY author) - 1 AS authors FROM (SELECT DISTINCT author FROM a0)),
cc AS (SELECT cat, dense_rank() OVER (ORDER BY cat) - 1 AS category FROM (SELECT DISTINCT cat FROM a0)),
cs AS (SELECT sub, dense_rank() OVER (ORDER BY sub) - 1 AS sub_cat FROM (SELECT DISTINCT sub FROM a0)),
mu AS (SELECT avg(frp) AS m FROM a0),
ft AS (
  SELECT document_id, authors, ctr, category, sub_cat, epoch(ts) AS timestamp, CAST(hour(ts) AS DOUBLE) AS hour,
    text_length, img, video, a, p, avg_sentence_len, max_sentence_len, min_sentence_len,
    before_pro_text_ratio, cleaned_text_length, cleaned_text_before_pro_length,
    {', '.join(f"CAST(list_contains(rf, '{c[5:]}') AS INT) AS {c}" for c in _ENTS)},
    {', '.join(f"CAST(list_contains(tags, '{c[5:]}') AS INT) AS {c}" for c in _TAGS)},
    CAST(views AS DOUBLE) AS views, CAST(depth AS DOUBLE) AS depth,
    coalesce(frp, (SELECT m FROM mu)) AS full_reads_percent, {sql_holdout('document_id')} AS is_test
  FROM a2 JOIN ca USING (author) JOIN cc USING (cat) JOIN cs USING (sub)),
tr AS (SELECT * FROM ft WHERE NOT is_test), te AS (SELECT * FROM ft WHERE is_test)"""
_ARTICLE_FEATURES = _article_features()
_MIN_LEAF = {"full_reads_percent": 5}
_SQL_ARTICLE_OUT = ("\nSELECT document_id, "
                    + ", ".join(f"ROUND({t}, 6) AS {t}" for t in LINE_TARGETS) + " FROM scored")
SQL_ARTICLE_CHAIN = (f"WITH {SQL_ARTICLES.strip()}, {sql_chain('tr', _ARTICLE_FEATURES, _MIN_LEAF)},\n"
                     f"{sql_chain_scores('te', _ARTICLE_FEATURES)}{_SQL_ARTICLE_OUT}")
SQL_ARTICLE_CHAIN_R2 = (f"WITH RECURSIVE {SQL_ARTICLES.strip()},"
                        f"{sql_trees_r2('ft', _ARTICLE_FEATURES, _MIN_LEAF)}")
SQL_ARTICLE_TAG_SELECTION = (
    f"WITH {SQL_ARTICLES.strip()}, {sql_chain('tr', _ARTICLE_FEATURES, _MIN_LEAF)}, "
    + sql_chain("tr", _ARTICLE_FEATURES, _MIN_LEAF,
                "NOT starts_with(feature, 'tags_') OR feature = (SELECT feature FROM m_full_reads_percent)", "n")
    + f",\n{sql_chain_scores('te', _ARTICLE_FEATURES, 'n')}{_SQL_ARTICLE_OUT}")
SQL_ARTICLE_FOREST = (f"WITH a AS (SELECT CAST(o_orderkey AS VARCHAR) AS document_id FROM orders)\n"
                      "SELECT document_id, true AS views_in_range, true AS depth_in_range, "
                      f"true AS full_reads_percent_in_range FROM a WHERE {sql_holdout('document_id')}")


# ---------------------------------------------------------------------------
# CSV in and out
# ---------------------------------------------------------------------------
def q_csv_roundtrip(spark, d):
    """Documents written as an enriched CSV table, with lists and an index, and read back."""
    from vellum.sources import articles as A
    docs = _wide(_t(spark, d, "documents"))
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    out = docs.select(F.col("doc_id").cast("string").alias("document_id"),
                      F.concat(F.lit("  "), F.col("text"), F.lit(' \\ "\' ')).alias("title"),
                      F.transform(lines, lambda x: F.concat(x, F.lit("\\'\""))).alias("tags"),
                      F.array("lang", F.lit(None).cast("string"), "source").alias("ents"),
                      (F.col("n_chars") / 7).alias("ctr"))
    path = scratch_path(spark, "enriched-csv")
    A.write_enriched(out, path, fmt="csv")
    back = A.read_enriched_csv(spark, path)
    return back.select(
        "document_id", F.md5(F.col("title").cast("binary")).alias("title_md5"),
        F.size("tags").cast("long").alias("n_tags"),
        F.md5(F.array_join("tags", "\n").cast("binary")).alias("tags_md5"),
        F.array_join("ents", ",", "NULL").alias("ents"), F.round("ctr", 6).alias("ctr"),
        (F.col("row_id") >= 0).alias("has_index"))


SQL_CSV_ROUNDTRIP = r"""
WITH x AS (
  SELECT doc_id, text, lang, source, n_chars,
         list_transform(list_filter(string_split(text, chr(10)), lambda x: x <> ''),
                        lambda x: x || '\''"') AS tags
  FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS document_id, md5('  ' || text || ' \ "'' ') AS title_md5,
  CAST(len(tags) AS BIGINT) AS n_tags, md5(coalesce(array_to_string(tags, chr(10)), '')) AS tags_md5,
  lang || ',NULL,' || source AS ents, ROUND(n_chars / 7, 6) AS ctr, true AS has_index
FROM x"""


# ---------------------------------------------------------------------------
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "sentence_stats": q_sentence_stats,
    "boilerplate_clean": q_boilerplate_clean,
    "boilerplate_license": q_boilerplate_license,
    "boilerplate_midtext": q_boilerplate_midtext,
    "html_features": q_html_features,
    "html_variants": q_html_variants,
    "page_join": q_page_join,
    "enrich_articles": q_enrich_articles,
    "enrich_articles_colocated": q_enrich_articles_colocated,
    "date_parts": q_date_parts,
    "cap_impute": q_cap_impute,
    "rare_bucket": q_rare_bucket,
    "label_encode": q_label_encode,
    "label_encode_unseen": q_label_encode_unseen,
    "label_encode_default": q_label_encode_default,
    "bucket_encode": q_bucket_encode,
    "list_literal": q_list_literal,
    "multi_hot": q_multi_hot,
    "entity_types": q_entity_types,
    "entity_types_inline": q_entity_types_inline,
    "hash_split": q_hash_split,
    "r2_metric": q_r2_metric,
    "composite_score": q_composite_score,
    "chained_score": q_chained_score,
    "chain_r2": q_chain_r2,
    "importance_top": q_importance_top,
    "feature_select": q_feature_select,
    "pipeline_roundtrip": q_pipeline_roundtrip,
    "chained_forest": q_chained_forest,
    "article_chain": q_article_chain,
    "article_chain_r2": q_article_chain_r2,
    "article_tag_selection": q_article_tag_selection,
    "article_forest": q_article_forest,
    "csv_roundtrip": q_csv_roundtrip,
}

ORACLE_SQL: dict[str, str] = {
    "sentence_stats": SQL_SENTENCE_STATS,
    "boilerplate_clean": SQL_BOILERPLATE_CLEAN,
    "boilerplate_license": SQL_BOILERPLATE_LICENSE,
    "boilerplate_midtext": SQL_BOILERPLATE_MIDTEXT,
    "html_features": SQL_HTML_FEATURES,
    "html_variants": SQL_HTML_VARIANTS,
    "page_join": SQL_PAGE_JOIN,
    "enrich_articles": SQL_ENRICH_ARTICLES,
    "enrich_articles_colocated": SQL_ENRICH_ARTICLES,
    "date_parts": SQL_DATE_PARTS,
    "cap_impute": SQL_CAP_IMPUTE,
    "rare_bucket": SQL_RARE_BUCKET,
    "label_encode": SQL_LABEL_ENCODE,
    "label_encode_unseen": SQL_LABEL_ENCODE_UNSEEN,
    "label_encode_default": SQL_LABEL_ENCODE_UNSEEN,
    "bucket_encode": SQL_BUCKET_ENCODE,
    "list_literal": SQL_LIST_LITERAL,
    "multi_hot": SQL_MULTI_HOT,
    "entity_types": SQL_ENTITY_TYPES,
    "entity_types_inline": SQL_ENTITY_TYPES,
    "hash_split": SQL_HASH_SPLIT,
    "r2_metric": SQL_R2_METRIC,
    "composite_score": SQL_COMPOSITE_SCORE,
    "chained_score": SQL_CHAINED_SCORE,
    "chain_r2": SQL_CHAIN_R2,
    "importance_top": SQL_IMPORTANCE_TOP,
    "feature_select": SQL_FEATURE_SELECT,
    "pipeline_roundtrip": SQL_CHAINED_SCORE,
    "chained_forest": SQL_CHAINED_FOREST,
    "article_chain": SQL_ARTICLE_CHAIN,
    "article_chain_r2": SQL_ARTICLE_CHAIN_R2,
    "article_tag_selection": SQL_ARTICLE_TAG_SELECTION,
    "article_forest": SQL_ARTICLE_FOREST,
    "csv_roundtrip": SQL_CSV_ROUNDTRIP,
}

from vellum.plans import catalog_tables  # noqa: E402  (it reads this module's SQL parts)

QUERIES.update(catalog_tables.QUERIES)
ORACLE_SQL.update(catalog_tables.oracle_sql(SQL_FEATURE_SELECT))
