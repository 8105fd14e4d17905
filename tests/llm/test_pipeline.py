"""The pipeline's stages: columns, decisions, awkward rows, and a brute-force version."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from vellum.llm import common, langid, quality, stages

import edge
from test_text_operators import PLANTED, brute_components, brute_fingerprint, check_packed

SF = ""
FILTERS = [s for s in corpus_pipeline.STAGES[:-1]]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("name,stage", FILTERS)
def test_stage_keeps_columns_and_takes_awkward_rows(spark, tmp_path, sf001, name, stage):
    docs = common.read(spark, edge.write_documents(spark, str(tmp_path), real=sf001), "documents")
    out = stage(spark, docs, SF)
    assert out.schema.names == docs.schema.names
    assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    before, after = Counter(rows_of(docs)), Counter(rows_of(out))
    if name == "secret_scans":
        assert sum(before.values()) == sum(after.values())
    else:
        assert not after - before and after


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_empty_table(spark, tmp_path, name, stage):
    docs = common.read(spark, edge.write_documents(spark, str(tmp_path), empty=True), "documents")
    assert stage(spark, docs, SF).collect() == []


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i:i + 8]), []).append(i)
    inside = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    return len(words), len(inside)


def test_pipeline_brute_force(spark, tmp_path, sf001):
    folder = edge.write_documents(spark, str(tmp_path), real=sf001)
    table = common.read(spark, folder, "documents")
    names = table.columns
    docs = [dict(zip(names, r)) for r in rows_of(table)]
    # 1: the fitted model, applied text by text
    model = langid.fit(table)

    def known(d):
        raw = (d["text"] or "").encode()
        if not langid.has_letter(raw):
            return False
        grams = langid.counts(raw)[None, :]
        best, close = model.nearest(grams)
        return close[0] >= model.floor[best[0], langid.size_class(grams)[0]]

    docs = [d for d in docs if known(d)]
    # 2: rules and host rates
    for d in docs:
        n, repeat = brute_counts(d["text"] or "")
        d["failed"] = n < 20 or 100 * repeat > 30 * n
    hosts = {}
    for d in docs:
        if d["source"] is not None:
            hosts.setdefault(d["source"], []).append(d["failed"])
    rates = [sum(x) / len(x) for x in hosts.values()]
    m = sum(rates) / len(rates)
    v = sum((x - m) ** 2 for x in rates) / len(rates)
    k = min(max(m * (1 - m) / v - 1, quality.MIN_PRIOR), quality.MAX_PRIOR) if v else quality.MAX_PRIOR
    bad = {h for h, x in hosts.items() if (sum(x) + m * k) / (len(x) + k) >= quality.MAX_RATE}
    docs = [d for d in docs if not d["failed"] and d["source"] not in bad]
    # 3: components over all pairs
    prints = [brute_fingerprint(d["text"] or "", 4) for d in docs]
    roots = brute_components(set(prints), 4)
    best = {}
    for d, f in zip(docs, prints):
        at = (d["doc_id"] is None, d["doc_id"] or 0)
        if roots[f] not in best or at < best[roots[f]][0]:
            best[roots[f]] = (at, d)
    docs = [d for _, d in best.values()]
    # 4 and 5
    from tokenizers import Tokenizer
    import public_tokenizers
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for d in docs:
        text = PLANTED.sub("[SECRET]", d["text"] or "")
        left = len(tok.encode(text, add_special_tokens=False).ids) + 1
        for start in range(0, left, 4096):
            want[(d["doc_id"], start, min(4096, left - start))] += 1
    rows = corpus_pipeline.run(spark, folder).collect()
    got = Counter((r["doc_id"], r["start"], r["length"]) for r in rows)
    assert got == want
    used, least = check_packed(rows)
    assert used <= least + 2


def test_copies_leave_exactly_one(spark):
    text = " ".join(f"w{i % 83}x{i}" for i in range(60))
    rows = [(5, text, "a"), (5, text, "a"), (3, text, "b"), (3, text, "b"), (None, text, "c"),
            (9, "an unrelated text", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    out = rows_of(stages.near_duplicates(spark, docs, SF))
    assert sorted(out) == [(3, text, "b"), (9, "an unrelated text", "d")]
