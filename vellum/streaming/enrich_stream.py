"""Incremental enrichment of article files as they land (Structured Streaming).

The reference enriches one CSV per run (train, test, validation).  The same plan runs
unchanged on a file stream: every step is stateless per row except the page join,
which is a stream-static join against the crawled ``pages`` table, so no state store,
watermark or window is needed.  Progress is tracked in the checkpoint folder that the
caller names, so a query restarted with it resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vellum.functions import text as T
from vellum.plans.enrich import enrich, page_features
from vellum.session import materialize
from vellum.sources.articles import RAW_ARTICLE_SCHEMA


def read_article_stream(spark: SparkSession, path: str, schema: str = RAW_ARTICLE_SCHEMA,
                        fmt: str = "csv", max_files_per_trigger: int = 100) -> DataFrame:
    """A stream of article files.

    A CSV stream must declare its columns, so ``schema`` lists them in the files' order; a
    file whose header names others fails the query instead of being read by position.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        reader = (reader.option("header", True).option("multiLine", True).option("escape", '"')
                  .option("enforceSchema", False))
    return reader.format(fmt).load(path)


def enrich_stream(articles: DataFrame, pages: DataFrame | None, out_path: str, checkpoint: str,
                  mentions: DataFrame | None = None,
                  dictionary: Mapping[str, str | Sequence[str]] | None = None,
                  prefixes: Sequence[str] = T.BOILERPLATE_PREFIXES,
                  markers: Sequence[str] = T.SECTION_MARKERS, trigger_once: bool = False,
                  feats: DataFrame | None = None, **selectors: str) -> StreamingQuery:
    """Start the enrichment stream writing Parquet to ``out_path``.

    ``checkpoint`` is required: a restart with the same folder reads only new files.
    ``feats`` is a stored table of ``page_features``; without it they are computed from
    ``pages`` once per start and stored.  Entities come from a mentions table, or from a
    dictionary as an explicit mapping, which is looked up inside each row; a dictionary
    table would need a group-by on the stream, so it is refused.
    """
    if isinstance(dictionary, DataFrame):
        raise TypeError("a stream takes a mentions table or a mapping, not a dictionary table")
    if feats is None:
        feats = materialize(page_features(pages, **selectors), "page-features")
    out = enrich(articles, None, mentions=mentions, dictionary=dictionary, inline=True,
                 prefixes=prefixes, markers=markers, feats=feats)
    writer = (out.writeStream.format("parquet").option("path", out_path)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    writer = writer.trigger(availableNow=True) if trigger_once else writer
    return writer.start()
