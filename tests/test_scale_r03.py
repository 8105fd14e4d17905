"""What a task holds and how often it reads, for the steps that grew too fast."""

import pandas as pd

from vellum.operators import entities, html
from vellum.sources import csv_ranges


def test_pages_leave_the_parser_a_few_at_a_time():
    selectors = {**html.REFERENCE_SELECTORS, "body_selector": "article"}
    run = html._batch_parser("k", "html", ("url",), selectors)
    pages = [None, b"<article>\xff x</article>", *[b"<article>%d</article>" % i for i in range(300)], b"y" * (9 << 20)]
    pdf = pd.DataFrame({"k": range(len(pages)), "html": pages, "url": [str(i) for i in range(len(pages))]})
    out = list(run(iter([pdf])))
    assert max(map(len, out)) <= html.SLICE_ROWS and len(out[-1]) == 1
    whole = pd.concat(out)
    assert whole["k"].tolist() == list(range(len(pages))) and whole["url"].tolist() == [str(i) for i in range(len(pages))]
    assert whole["text"].tolist()[:4] == ["", "� x", "0", "1"]


def test_csv_lines_pass_python_once(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text('id,body\n1,"x\n""y\n"\n2,\n3,"a,\n\nb"\n')
    passes = []
    frame = type(spark.range(1))
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **b: passes.append(1) or plain(self, *a, **b))
    stored = []
    keep = csv_ranges.materialize
    monkeypatch.setattr(csv_ranges, "materialize", lambda df, name: stored.append(name) or keep(df, name))
    rows = csv_ranges.read_csv(spark, str(tmp_path / "a.csv"))
    assert sorted(tuple(r) for r in rows.collect()) == [("1", 'x\n"y\n'), ("2", None), ("3", "a,\n\nb")]
    assert len(passes) == 1 and "csv-records" in stored


def test_phrases_are_built_where_a_first_word_stands(spark):
    docs = spark.createDataFrame([(1, "a b, c a"), (2, ""), (3, "b - the x"), (4, "a  b a b c")], "id int, t string")
    entries = spark.createDataFrame([("a b", "X"), ("b", "Y"), ("a b c", "Z"), ("- the", "W")], "token string, label string")
    found = entities.phrase_mentions(docs, entries, key="id", text_col="t")
    assert sorted(tuple(r) for r in found.collect()) == [
        (1, 0, 3, "Z"), (3, 0, 1, "Y"), (3, 1, 2, "W"), (4, 2, 1, "Y"), (4, 3, 3, "Z")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
