"""Operators 11 and 12: brute force, oracle, properties of the methods."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex

from vellum.llm import catalog, common, divergence, variants

import edge


@pytest.fixture(scope="module")
def folder(spark, sf001, tmp_path_factory):
    return edge.write_documents(spark, str(tmp_path_factory.mktemp("terms")), real=sf001)


# ---- 11 spelling variants -----------------------------------------------------------------


def brute_words(rows):
    count = Counter()
    for key, text in rows:
        for r in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            r = r.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if key is None else key}:{r}".encode())
            if h % 199 == 0:
                r = r[:h % len(r)] + r[h % len(r) + 1:]
            count[r] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows):
    words = brute_words(rows)
    by = {}
    for w in words:
        by.setdefault(len(w), []).append(w)
    out, form = [], {}
    for w, n in words.items():
        close = [x for m in (len(w) - 1, len(w), len(w) + 1) for x in by.get(m, []) if x != w and near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
        out.append((w, n, len(close)))
    res = []
    for w, n, k in out:
        root = w
        while form[root] is not None:
            root = form[root]
        res.append((form[w], words[form[w]] if form[w] else None, n, k, root, w))
    return res


def test_variants_brute_force(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in common.read(spark, folder, "documents").collect()]
    got = edge.spark_rows(variants.op11_spelling_variants(spark, folder))
    want = sorted(brute_variants(rows), key=repr)
    assert got == want and any(r[0] for r in want)


def test_variants_of_anagrams_and_long_chains(spark):
    rng = random.Random(5)
    base = ["".join(rng.sample("abcdefghi", 9)) for _ in range(300)]
    chain = [("abcdef", 5), ("abcdeg", 30), ("abcdhg", 200), ("abckhg", 1200), ("ablkhg", 7000)]
    words = [w for w in dict.fromkeys(base) for _ in range(6)] + [w for w, n in chain for _ in range(n)]
    words += ["aaaaaaaa"] * 9 + ["aaaaaaa"] * 50 + ["étéséé"] * 5 + ["étéséa"] * 40
    rows = [(None, " ".join(words[i::7])) for i in range(7)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = edge.spark_rows(variants.group(df, drop_every=199))
    assert got == sorted(brute_variants(rows), key=repr)
    plain = {r["word"]: r for r in variants.group(df).collect()}
    assert plain["abcdef"]["root"] == "ablkhg" and plain["aaaaaaaa"]["form"] == "aaaaaaa"


def test_signatures_cover_one_edit():
    rng = random.Random(1)
    letters = "abcdeéÿ"
    for _ in range(3000):
        w = [rng.choice(letters) for _ in range(rng.randint(6, 12))]
        x, at = list(w), rng.randrange(len(w))
        kind = rng.randrange(3)
        if kind == 0:
            x[at] = rng.choice(letters)
        elif kind == 1:
            x.insert(at, rng.choice(letters))
        elif len(w) > 6:
            del x[at]
        assert set(variants.signatures("".join(w))) & set(variants.signatures("".join(x)))


def test_counts_do_not_depend_on_flushes(spark, folder, monkeypatch):
    docs = common.read(spark, folder, "documents")
    want = edge.spark_rows(variants.vocabulary(docs))
    want_terms = edge.spark_rows(divergence.count_terms(docs))
    monkeypatch.setattr(variants, "FLUSH", 50)
    monkeypatch.setattr(divergence, "FLUSH", 50)
    assert edge.spark_rows(variants.vocabulary(docs)) == want
    assert edge.spark_rows(divergence.count_terms(docs)) == want_terms


# ---- 12 divergence ------------------------------------------------------------------------


def test_divergence_matches_oracle(spark, folder):
    got = edge.spark_rows(divergence.op12_divergence(spark, folder))
    assert got == edge.oracle(divergence.ORACLE_SQL, folder, "documents")
    assert {r[2] for r in got} == {"pair", "term"}


def test_divergence_in_many_blocks_and_buckets(spark, folder, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 3)
    monkeypatch.setattr(divergence, "BUCKET", 7)
    got = edge.spark_rows(divergence.op12_divergence(spark, folder))
    assert got == edge.oracle(divergence.ORACLE_SQL, folder, "documents")


def test_groups_without_terms_and_languages_without_kept_terms(spark):
    rows = ([("one two three", "en", "a")] * 10 + [("123", "en", "b"), (None, "en", None), ("one", "en", "c")]
            + [("rare", "xx", "a"), ("words", "xx", "b")])
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    out = divergence.audit(df).collect()
    pairs = {(r["lang"], r["source"], r["item"]): r["value"] for r in out if r["part"] == "pair"}
    assert len(pairs) == 12 + 2 and pairs["xx", "a", "b"] == 0 == pairs["en", "b", ""]
    assert pairs["en", "a", "c"] == pairs["en", "c", "a"] > 0
    assert {r["item"] for r in out if r["part"] == "term" and r["source"] == "c"} == {"one"}


def test_skyband_holds_every_top_list():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n, lang_n = rng.integers(1, 30, 200), rng.integers(1, 30, 200)
        keep = divergence.skyband(n, lang_n, 5)
        for i in range(200):
            above = int(((n[:i] >= n[i]) & (lang_n[:i] <= lang_n[i])).sum())
            assert keep[i] == (above < 5)


def test_shares_are_exact_for_huge_counts(spark):
    from pyspark.sql import functions as F
    c, total, kept = 3_000_000_000_000, 7_000_000_000_123, 911
    df = spark.createDataFrame([(c, total, kept)], "c long, total long, kept long")
    got = df.select(divergence._share(F.col("c"), F.col("total"), F.col("kept"))).first()[0]
    assert got == 1 + (10**9 * (c + 2)) // (total + 2 * kept)


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_divergence"])
def test_empty(spark, tmp_path, name):
    path = edge.write_documents(spark, str(tmp_path), empty=True)
    assert catalog.QUERIES[name](spark, path).collect() == []
