"""Published model versions, mentions of several words, observed labels, many prefixes."""

import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import encode, entities, model
from vellum.plans import train as TR


def trained(spark, value: float):
    rows = [(float(i), float(i % 3) + value) for i in range(30)]
    df = spark.createDataFrame(rows, "x double, views double")
    chain = model.fit_chain(df.withColumn("k", F.col("x").cast("string")),
                            [model.Target("views", ["x"], model.ForestParams(num_trees=1, max_depth=1, bootstrap=False))], "k", 2)
    labels = encode.fit_label_encoder(spark.createDataFrame([("a",), ("b",)], "v string"), "v")
    enc = TR.ArticleEncoders(labels, labels, labels, encode.multi_hot_encoder(["t"], "tags", "tags_vec"),
                             encode.multi_hot_encoder(["e"], "ents", "ents_vec"))
    return TR.TrainedArticleModel(enc, chain, "k", {"views": value}, value)


def test_a_broken_save_leaves_the_version_before(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "model")
    with pytest.raises(FileNotFoundError):
        TR.TrainedArticleModel.load(spark, path)
    first = trained(spark, 1.0).save(spark, path)
    later = trained(spark, 2.0)
    with monkeypatch.context() as m:
        def broken(self, spark, path):
            raise OSError("disk full")
        m.setattr(TR.ArticleEncoders, "save", broken)
        with pytest.raises(OSError):
            later.save(spark, path)
    assert TR.TrainedArticleModel.load(spark, path).composite == 1.0
    second = later.save(spark, path)
    assert TR.TrainedArticleModel.load(spark, path).scores == {"views": 2.0}
    assert TR.TrainedArticleModel.load(spark, path, first).composite == 1.0
    assert [r["version"] for r in TR.published(spark, path)] == [first, second]


def greedy(title, entries):
    toks = [t.strip(entities.EDGE_PUNCT).lower() for t in title.split()]
    out, i = [], 0
    while i < len(toks):
        best = max((n for n in range(1, 4) if i + n <= len(toks) and " ".join(toks[i:i + n]) in entries), default=0)
        if best:
            out.append((i, best, entries[" ".join(toks[i:i + best])]))
        i += best or 1
    return out


def test_leftmost_longest_mentions(spark):
    rng = random.Random(1)
    entries = {"new york": "LOC", "new york times": "ORG", "york": "PER", "times": "MISC", "a a": "LOC", "a": "ORG", "b a a": "PER"}
    titles = ["New York Times, (York)", "", "a a a a b a a", "york", "new  york"]
    titles += [" ".join(rng.choice(["New", "york", "times!", "a", "b", "x"]) for _ in range(rng.randrange(1, 20))) for _ in range(80)]
    titles = [" ".join(t.split()) for t in titles]
    df = spark.createDataFrame(list(enumerate(titles)), "id int, title string")
    table = spark.createDataFrame([*entries.items(), ("Times", "ZZ")], "token string, label string")
    got = {}
    for r in entities.phrase_mentions(df, table, key="id").collect():
        got.setdefault(r["id"], []).append((r["pos"], r["length"], r["label"]))
    assert {i: sorted(v) for i, v in got.items()} == {i: g for i, t in enumerate(titles) if (g := greedy(t, entries))}


def test_unseen_labels_are_observed(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("zz",), ("zz",)], "v string")
    enc = encode.fit_label_encoder(df.where("v IN ('a', 'b')"), "v", "code", on_unseen="default")
    seen = Observation()
    rows = enc.transform(df, seen).collect()
    assert sorted(r["code"] for r in rows) == [-1, -1, -1, 0, 1]
    assert seen.get == {"rows": 5, "unseen": 2, "nulls": 1}
    lists = spark.createDataFrame([(["a", "q", "q"],), ([],), (None,), (["r"],)], "t array<string>")
    elements = Observation()
    vec = encode.multi_hot_encoder(["a", "b"], "t", "vec")
    known = encode.observed_multi_hot(lists.withColumn("t", F.coalesce("t", F.array().cast("array<string>"))), ["a", "b"], "t", elements)
    vec.transform(known).collect()
    assert elements.get == {"elements": 3, "unseen": 2}


def test_many_prefixes_equal_the_chain(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 9)))
    prefixes = sorted({word() for _ in range(10_000)})
    lines = [word() + word() for _ in range(300)] + ["", "a"]
    df = spark.createDataFrame([(x,) for x in lines] + [(None,)], "x string")
    out = df.select("x", T.starts_with_any(F.col("x"), prefixes).alias("hit"))
    for r in out.collect():
        assert r["hit"] == (None if r["x"] is None else any(r["x"].startswith(p) for p in prefixes))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StartsWith") == 0 and plan.count("substring") <= 10
    few = df.select(T.starts_with_any(F.col("x"), ["", "a"]).alias("a"), T.starts_with_set(F.col("x"), ["", "a"]).alias("b"))
    assert all(r["a"] == r["b"] for r in few.collect())


def test_training_takes_partitions_and_an_exact_split():
    import inspect
    names = inspect.signature(TR.train).parameters
    assert {"partitions", "exact"} <= set(names)


def test_bagged_forest_values_by_a_walk_over_the_saved_trees(spark, tmp_path):
    """Predictions of a small bagged forest from its stored node table, walked in Python."""
    rng = random.Random(3)
    rows = [(float(rng.randrange(20)), float(rng.randrange(5)), rng.random() * 10) for _ in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    fitted = model.fit_forest(df, ["a", "b"], "y", model.ForestParams(num_trees=7, max_depth=4, max_bins=32))
    path = str(tmp_path / "forest")
    model.forest_of(fitted).write().save(path)
    nodes = {}
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():
        nodes.setdefault(r["treeID"], {})[r["id"]] = r

    def walk(tree, x):
        node = tree[0]
        while node["leftChild"] >= 0:
            s = node["split"]
            node = tree[node["leftChild"] if x[s["featureIndex"]] <= s["leftCategoriesOrThreshold"][0] else node["rightChild"]]
        return node["prediction"]

    assert len(nodes) == 7 and len({len(t) for t in nodes.values()}) > 1
    for r in fitted.transform(df).collect():
        want = sum(walk(t, (r["a"], r["b"])) for t in nodes.values()) / 7
        assert r["y_pred"] == pytest.approx(want)
