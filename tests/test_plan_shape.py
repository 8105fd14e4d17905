"""Physical-plan properties that the scale design relies on."""

import pytest

from vellum.plans import catalog as C


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def at_scale(spark):
    """Plan as on a large input: no broadcast shortcut, tables as they are read."""
    old = {k: spark.conf.get(k, None) for k in
           ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", C.READ_PARTITIONS)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.unset(C.READ_PARTITIONS)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_enrichment_shuffles_twice_and_never_the_html(at_scale, sf001):
    from vellum.plans import enrich as E
    plan = _plan(C.q_enrich_articles(at_scale, sf001))
    assert plan.count("Exchange") == 2 and "SortMergeJoin" in plan, plan
    assert "html" not in plan and "MapInPandas" not in plan  # features are stored before the join
    feats = _plan(E.page_features(at_scale.read.parquet(f"{sf001}/pages.parquet"), **C.PAGE_SELECTORS))
    assert feats.count("Exchange") == 1, feats
    assert "Exchange" not in feats[feats.index("MapInPandas"):], feats  # none below the parser
    # copies are reduced before the sentence statistics
    assert "split" not in feats[feats.index("Exchange"):], feats


def test_only_wanted_pages_are_parsed(at_scale, sf001):
    from vellum.plans import enrich as E
    pages = at_scale.read.parquet(f"{sf001}/pages.parquet")
    wanted = at_scale.createDataFrame([("3",), ("5",), ("5",), (None,)], "document_id string")
    feats = E.page_features(pages, wanted=wanted, **C.PAGE_SELECTORS)
    assert {r["__aid"] for r in feats.collect()} == {"3", "5"}
    plan = _plan(feats)
    assert plan.index("MapInPandas") < plan.index("LeftSemi")


def test_page_join_does_not_read_html(at_scale, sf001):
    plan = _plan(C.q_page_join(at_scale, sf001))
    assert "html" not in plan and "page_id:bigint,url:string" in plan, plan


def test_bucketed_pages_have_one_file_per_bucket(spark, sf001, tmp_path):
    from vellum.sources.articles import bucket_pages
    pages = spark.read.parquet(f"{sf001}/pages.parquet").repartition(6)
    bucket_pages(pages, "bucket_test", 8, str(tmp_path / "b"))
    try:
        assert len(list((tmp_path / "b").glob("part-*"))) <= 8
        assert spark.table("bucket_test").count() == pages.count()
    finally:
        spark.sql("DROP TABLE bucket_test")


def test_text_queries_stay_in_the_jvm(at_scale, sf001):
    for q in (C.q_sentence_stats, C.q_boilerplate_clean, C.q_entity_types_inline, C.q_date_parts):
        plan = _plan(q(at_scale, sf001))
        for node in ("MapInPandas", "ArrowEvalPython", "BatchEvalPython", "Exchange"):
            assert node not in plan, (q.__name__, node)


def test_scans_read_only_needed_columns(at_scale, sf001):
    plan = _plan(C.q_sentence_stats(at_scale, sf001))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan, plan
    plan = _plan(C.q_hash_split(at_scale, sf001))
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan, plan


def test_mention_fold_is_partial_aggregate(at_scale, sf001):
    plan = _plan(C.q_entity_types(at_scale, sf001))
    assert "partial_collect_list" in plan


def test_colocated_enrichment_moves_only_articles(at_scale, sf001):
    plan = _plan(C.q_enrich_articles_colocated(at_scale, sf001))
    assert plan.count("Exchange") == 1, plan
    assert "SortMergeJoin" in plan
    join_at = plan.index("SortMergeJoin")
    assert plan.index("MapInPandas") < join_at  # parsed above (after) the join
