"""S1-S3, S5, S6/J4 dedupe, the streaming enrichment and the driver contract."""

import hashlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from articles_fixture import SCHEMA, rows
from vellum.functions.lists import parse_list_literal
from vellum.plans import catalog
from vellum.plans import enrich as E
from vellum.sources import articles as A
from vellum.streaming.enrich_stream import enrich_stream, read_article_stream


def test_csv_roundtrip_with_lists(spark, tmp_path):
    df = spark.createDataFrame(rows(10), SCHEMA)
    parsed = df.withColumn("tags", parse_list_literal("tags"))
    out = str(tmp_path / "enriched_csv")
    A.write_enriched(parsed.coalesce(1), out, fmt="csv")
    back = A.read_enriched_csv(spark, out)
    assert back.count() == 10
    a = {r["document_id"]: r["tags"] for r in parsed.collect()}
    b = {r["document_id"]: r["tags"] for r in back.collect()}
    assert a == b


def test_raw_csv_multiline_quotes(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text('document_id,title,publish_date,authors,category,tags,ctr,views,depth,'
                    'full_reads_percent\nabc,"two\nline ""title""",2022-01-01 10:00:00,x,c,'
                    '"[\'t1\', \'t2\']",1.5,10,1.1,50\n', encoding="utf-8")
    df = A.read_articles_csv(spark, str(path), parse_lists=("tags",))
    r = df.first()
    assert r["title"] == 'two\nline "title"' and r["tags"] == ["t1", "t2"] and r["ctr"] == 1.5


def test_write_names(spark, tmp_path):
    A.write_names(spark, ["tags_b", "tags_a"], str(tmp_path / "names"))
    got = spark.read.parquet(str(tmp_path / "names")).orderBy("rank").collect()
    assert [r["name"] for r in got] == ["tags_b", "tags_a"]


def test_dedupe_pages_keeps_one_copy(spark):
    pages = spark.createDataFrame(
        [(1, "u2", "<p>b</p>"), (1, "u1", "<p>z</p>"), (1, "u1", "<p>a</p>"), (2, "v", "x")],
        "page_id int, url string, html string")
    got = {r["page_id"]: (r["url"], r["html"]) for r in A.dedupe_pages(pages).collect()}
    # smallest (url, md5(html)) wins
    pick = min(["<p>z</p>", "<p>a</p>"], key=lambda h: hashlib.md5(h.encode()).hexdigest())
    assert got == {1: ("u1", pick), 2: ("v", "x")}


def test_page_join_defaults_and_hot_key(spark):
    html = "<article><h1>C</h1><p>x y</p></article>"
    pages = spark.createDataFrame([(7, "u", html)] * 30 + [(8, "u", html)],
                                  "page_id int, url string, html string")
    arts = spark.createDataFrame([("7",), ("9",)], "document_id string")
    out = {r["document_id"]: r for r in E.attach_pages(
        arts, pages, body_selector="article", category_selector="h1").collect()}
    assert out["7"]["p"] == 1 and out["7"]["sub_cat"] == "C"
    assert (out["9"]["text"], out["9"]["sub_cat"], out["9"]["p"]) == ("", "", 0)
    assert len(out) == 2


def test_stream_enrichment(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    html = "<article><h1>Cat</h1><p>one two three</p></article>"
    pages = spark.createDataFrame([(0, "u", html)], "page_id long, url string, html string")
    (spark.createDataFrame([("0", "t", "2022-01-01 00:00:00", "a", "c", "[]", 1.0, 1.0, 1.0, 1.0)],
                           A.RAW_ARTICLE_SCHEMA)
     .write.option("header", True).csv(str(src / "batch1")))
    stream = read_article_stream(spark, str(src / "batch1"))
    dictionary = {"T": ["MISC", "LOC"]}
    with pytest.raises(TypeError):
        enrich_stream(stream, pages, "x", "y", dictionary=spark.createDataFrame(
            [("t", "MISC")], "token string, label string"))
    q = enrich_stream(stream, pages, str(tmp_path / "out"), str(tmp_path / "ckpt"),
                      dictionary=dictionary, trigger_once=True,
                      body_selector="article", category_selector="h1")
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 1 and got[0]["sub_cat"] == "Cat"
    table = spark.createDataFrame([("t", "MISC"), ("t", "LOC")], "token string, label string")
    batch = E.attach_entities(spark.createDataFrame([("0", "t")], "document_id string, title string"),
                              dictionary=table)
    assert got[0]["ents"] == batch.first()["ents"] == ["LOC", "MISC"]  # stream and batch agree


def test_entry_contract(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "document_id" in df.columns
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert set(catalog.QUERIES) <= set(qs)
    # each of these has an oracle, so test_oracles.py runs them all
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_stream_resumes_from_checkpoint(spark, tmp_path):
    src, out, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    src.mkdir()
    pages = spark.createDataFrame([(0, "u", "<article><h1>C</h1><p>x</p></article>")],
                                  "page_id long, url string, html string")

    def land(name, doc_id):
        (spark.createDataFrame([(doc_id, "t", "2022-01-01 00:00:00", "a", "c", "[]",
                                 1.0, 1.0, 1.0, 1.0)], A.RAW_ARTICLE_SCHEMA)
         .coalesce(1).write.option("header", True).csv(str(src / name)))

    def run():
        stream = read_article_stream(spark, str(src / "*"))
        q = enrich_stream(stream, pages, out, ckpt, dictionary={"t": "MISC"}, trigger_once=True,
                          body_selector="article", category_selector="h1")
        q.awaitTermination(120)

    land("b1", "0")
    run()
    land("b2", "5")
    run()  # restarts from the checkpoint: only the new file is read
    ids = sorted(r["document_id"] for r in spark.read.parquet(out).collect())
    assert ids == ["0", "5"]


def test_pandas_style_enriched_csv(spark, tmp_path):
    """The reference writes its row index as an unnamed first column."""
    path = tmp_path / "enriched_train.csv"
    path.write_text(",document_id,tags,ents,views\n"
                    "0,a1,\"['t1', 't2']\",\"['LOC']\",10.5\n"
                    "1,a2,[],[],3.0\n", encoding="utf-8")
    df = A.read_enriched_csv(spark, str(path))
    assert df.columns[0] == "row_id"
    got = {r["document_id"]: (r["row_id"], r["tags"], r["ents"]) for r in df.collect()}
    assert got == {"a1": (0, ["t1", "t2"], ["LOC"]), "a2": (1, [], [])}
    assert dict(df.dtypes)["views"] == "double"


HEADER = "document_id,title,publish_date,authors,category,tags,ctr,views,depth,full_reads_percent"


def test_csv_columns_are_found_by_name(spark, tmp_path):
    """Another order of columns, an index column and a further one: values stay with their names."""
    path = tmp_path / "raw.csv"
    path.write_text(",extra,title,document_id,full_reads_percent,depth,views,ctr,tags,category,authors,publish_date\n"
                    "0,e,T1,id0,50,1.5,10,0.25,[],c,a,2022-01-01 10:00:00\n", encoding="utf-8")
    df = A.read_articles_csv(spark, str(path))
    assert df.columns == HEADER.split(",")
    r = df.first()
    assert (r["document_id"], r["title"], r["ctr"], r["views"], r["depth"]) == ("id0", "T1", 0.25, 10.0, 1.5)
    path.write_text("title,document_id\nT1,id0\n", encoding="utf-8")
    with pytest.raises(ValueError, match="views"):
        A.read_articles_csv(spark, str(path))


def test_csv_stream_refuses_another_order(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.csv").write_text("title,document_id\nT1,id0\n", encoding="utf-8")
    stream = read_article_stream(spark, str(src), schema="document_id string, title string")
    q = (stream.writeStream.format("parquet").option("path", str(tmp_path / "o"))
         .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    with pytest.raises(Exception):
        q.awaitTermination(60)


def test_csv_keeps_values(spark, tmp_path):
    """Outer white space, quotes, backslashes, line breaks, empty strings and nulls come back."""
    titles = ["  lead and trail \n", 'say "hi"', "back\\slash", "", None, "a,b", "\ttab\r\n", "it's"]
    lists = [["it's"], ["a', 'b"], ["x", None], [], ['q"q', "b\\", ""], None, ["line\nbreak"], ["\u00e9"]]
    df = spark.createDataFrame([(str(i), t, a) for i, (t, a) in enumerate(zip(titles, lists))],
                               "document_id string, title string, tags array<string>")
    A.write_enriched(df.repartition(3), str(tmp_path / "csv"), fmt="csv")
    back = A.read_enriched_csv(spark, str(tmp_path / "csv"))
    assert back.columns[0] == "row_id"
    rows = back.collect()
    assert sorted(r["row_id"] for r in rows) == list(range(len(titles)))
    got = {int(r["document_id"]): (r["title"], r["tags"]) for r in rows}
    assert got == {i: (t, a) for i, (t, a) in enumerate(zip(titles, lists))}


def test_page_status(spark):
    pages = [(1, "u", "<article><h1>C</h1></article>"), (2, "u", "<article>x</article>"), (3, "u", "<p>x</p>"),
             (4, "u", None)]
    feats = E.page_features(spark.createDataFrame(pages, "page_id long, url string, html string"),
                            body_selector="article", category_selector="h1")
    assert {r["__aid"]: r["page_status"] for r in feats.collect()} == {
        "1": "ok", "2": "no_category", "3": "no_body", "4": "missing"}


def test_branches_occur_in_the_driver_tables(spark):
    """Each branch that a registered query is there for holds rows at sf0.01."""
    sf = "/root/testdata/sf0.01"
    v = catalog.q_html_variants(spark, sf).groupBy("variant", "independent").agg(
        F.sum("a").alias("a"), F.sum("img").alias("img"), F.sum("video").alias("video"),
        F.count_if(F.col("sub_cat").isNull()).alias("no_cat"),
        F.count_if(F.col("page_status") == "no_body").alias("no_body")).collect()
    by = {(r["variant"], r["independent"]): r for r in v}
    assert by["links", False]["a"] > 0 and by["links", False]["img"] > 0 and by["links", False]["video"] == 0
    assert by["no_category", False]["no_cat"] > 0 and by["no_category", True]["a"] > 0
    assert by["no_body", False]["no_body"] > 0
    r = catalog.q_boilerplate_midtext(spark, sf).agg(
        F.count_if(F.col("before_pro_text_ratio").between(0.001, 0.999)).alias("part"),
        F.count_if(F.col("before_pro_text_ratio") == 0).alias("first")).first()
    assert r["part"] > 0 and r["first"] > 0
    j = catalog.q_page_join(spark, sf).agg(
        F.count_if(F.length("document_id") > 24).alias("cut"), F.count("page_id").alias("hit")).first()
    assert j["cut"] > 0 and j["hit"] > 0
