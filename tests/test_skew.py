"""Hot keys: a third of all rows on one key, most articles on one page or without an id."""

import random

from pyspark.sql import functions as F

from vellum.operators import encode
from vellum.plans import enrich as E
from vellum.session import materialize
from vellum.sources.articles import keep_first


def _rows(n=3000, seed=5):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = 7 if i % 3 == 0 else rnd.randint(0, 400)  # key 7 holds a third of the rows
        out.append((key, f"u{rnd.randint(0, 5)}", f"h{rnd.randint(0, 10**6)}"))
    return out


def test_keep_first_hot_key(spark):
    data = _rows()
    df = spark.createDataFrame(data, "k int, url string, h string").repartition(8)
    got = {r["k"]: (r["url"], r["h"]) for r in keep_first(df, "k", ["url", "h"]).collect()}
    want = {}
    for k, u, h in data:
        want[k] = min(want.get(k, (u, h)), (u, h))
    assert got == want
    plan = keep_first(df, "k", ["url", "h"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan  # reduced inside each task before the shuffle


def test_code_table_with_hot_label(spark):
    data = _rows()
    df = spark.createDataFrame([(str(k),) for k, _, _ in data], "a string").repartition(8)
    want = {v: i for i, v in enumerate(sorted({str(k) for k, _, _ in data}))}
    got = {r["value"]: r["code"] for r in encode.fit_code_table(df, "a", partitions=6).collect()}
    assert got == want


def _final_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()  # runs df's own plan only through AQE
    rows = df.collect()
    assert rows
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_article_id_is_split(spark):
    """90 % of the articles on one page: the final join splits the hot partition."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        pages = spark.createDataFrame([(i, "u", f"<article><h1>C</h1><p>{i}</p></article>") for i in range(200)],
                                      "page_id long, url string, html string")
        feats = materialize(E.page_features(pages, body_selector="article", category_selector="h1"), "feats")
        rows = [(str(7 if i % 10 else i % 200), f"title {i}" * 20) for i in range(8000)]
        arts = spark.createDataFrame(rows, "document_id string, title string").repartition(8)
        out = E.join_page_features(arts, feats)
        plan = _final_plan(out)
        assert "skew=true" in plan, plan
        assert out.count() == 8000
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_articles_without_id_are_spread_and_get_defaults(spark):
    feats = E.page_features(spark.createDataFrame([(1, "u", "<article><h1>C</h1></article>")],
                                                  "page_id long, url string, html string"),
                            body_selector="article", category_selector="h1")
    arts = spark.createDataFrame([(None, f"t{i}") for i in range(300)] + [("1", "x")],
                                 "document_id string, title string")
    out = E.join_page_features(arts, feats)
    by = out.groupBy("page_status").count().collect()
    assert {r["page_status"]: r["count"] for r in by} == {"missing": 300, "ok": 1}
    left = arts.withColumn("k", F.coalesce("document_id", F.concat(
        F.lit("\0"), F.monotonically_increasing_id().cast("string"))))
    assert left.select("k").distinct().count() == 301


def test_recomputation_is_deterministic(spark, sf001):
    """A lost task is recomputed from lineage: the same inputs must give the same rows."""
    from vellum.plans import catalog as C
    a = sorted(tuple(r) for r in C.q_enrich_articles(spark, sf001).collect())
    b = sorted(tuple(r) for r in C.q_enrich_articles(spark, sf001).collect())
    assert a == b
    orders = spark.read.parquet(f"{sf001}/orders.parquet").select(
        F.col("o_custkey").cast("string").alias("a"))
    c1 = {r["value"]: r["code"] for r in encode.fit_code_table(orders.repartition(3), "a").collect()}
    c2 = {r["value"]: r["code"] for r in encode.fit_code_table(orders.repartition(7), "a").collect()}
    assert c1 == c2
