"""Operator 13 against brute force, and its parts."""

import hashlib
import random

import numpy as np
import pytest

from vellum.llm import common, suffix_dedup as S

import edge


def brute(rows, length=S.LENGTH):
    """Rows (key, text) -> sorted (key, n_bytes, n_removed, n_spans, sha of the rest)."""
    raw = [(k, (t or "").encode()) for k, t in rows]
    raw.sort(key=lambda r: (r[0] is None, r[0] or 0, S._identity(r[1])))
    seen, out = set(), []
    for key, x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            gram = hashlib.md5(x[i:i + length]).digest()
            if gram in seen:
                gone[i:i + length] = b"\1" * length
            seen.add(gram)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((key, len(x), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(df, **options):
    rows = S.dedup(df, **options).collect()
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"],
                    hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in rows), key=repr)


def awkward(seed=4):
    rng = random.Random(seed)
    def prose(n):
        return " ".join(rng.choice("alpha beta gamma delta épsilon zeta 日本 x".split()) + str(rng.randrange(60))
                        for _ in range(n))
    shared, long = prose(40), prose(400)
    rows = [(i, prose(rng.randrange(5, 60)) + shared[rng.randrange(60):] + prose(rng.randrange(30))) for i in range(40)]
    rows += [(100 + i, long[:1500 + 17 * i] + " " + prose(3) + long[1600:]) for i in range(12)]
    rows += [(200, "a" * 700), (201, "ab" * 300), (202, "a" * 99), (203, "a" * 100), (204, ""), (205, None)]
    rows += [(300, long)] * 3 + [(301, long[:99])] * 2 + [(None, long), (None, prose(80)), (None, None), (302, shared)]
    rows += [(-5, shared + shared), (303, shared[:150]), (303, shared[20:170]), (303, prose(50))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [S.HOT_SEGMENTS, 1])
def test_brute_force_of_awkward_rows(spark, monkeypatch, hot):
    rows = awkward()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(df, hot=hot) == brute(rows)
    assert result(df, length=40, gram=16, hot=hot) == brute(rows, 40)


def test_brute_force_of_documents_and_clashing_columns(spark, sf001, tmp_path):
    folder = edge.write_documents(spark, str(tmp_path), real=sf001)
    rows = [(r["doc_id"], r["text"]) for r in common.read(spark, folder, "documents").collect()]
    got = sorted((tuple(r) for r in S.op13_suffix_dedup(spark, folder).collect()), key=repr)
    assert got == brute(rows) and sum(r[2] for r in got) > 0


def test_empty(spark, tmp_path):
    assert S.op13_suffix_dedup(spark, edge.write_documents(spark, str(tmp_path), empty=True)).collect() == []


def test_groups_across_batches_and_hot_anchors(spark):
    """Batches of two rows; an anchor with more segments than may be held is passed on once each."""
    rows = [(a, b, k, 7, 3, 2, S.SORT) for a, b, k in
            [(1, 1, 0), (2, 1, 1), (2, 2, 2), (2, 2, 5), (2, 2, 5), (4, 9, 9), (4, 9, 3)]
            + [(3, b, k) for b in range(9) for k in range(b, b + 3)]]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        out = S.groups(spark.createDataFrame(rows, S._PIECES), hot=4).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    got = sorted((r["anchor"], r["body"], r["key"], r["kind"]) for r in out)
    want = [(2, 1, 1, S.SORT), (2, 2, 2, S.SORT), (2, 2, 5, S.REPEAT), (4, 9, 9, S.REPEAT)]
    want += [(3, b, b, S.DEAL) for b in range(9)] + [(3, b, k, S.REPEAT) for b in range(9) for k in (b + 1, b + 2)]
    assert sorted(set(got)) == sorted(want) and len(got) == len(want) + 1


def test_deep_shallow_orders_suffixes():
    rng = random.Random(9)
    text = "".join(rng.choice("ab") for _ in range(300)) * 3 + "a" * 200 + "".join(rng.choice("abcd") for _ in range(400))
    data = text.encode()
    starts = np.array([i for i in range(len(data) - 100)] )
    for group in (np.zeros(len(starts), np.int64), starts % 5):
        order, first = S.deep_shallow(data, starts, group, 100)
        keys = [(int(group[i]), data[starts[i]:starts[i] + 100]) for i in order]
        assert keys == sorted(keys)
        assert [bool(f) for f in first[1:]] == [a != b for a, b in zip(keys, keys[1:])]


def test_blind_trie_orders_strings():
    rng = random.Random(3)
    for _ in range(200):
        tails = [bytes(rng.choice(b"\x00ab\xff") for _ in range(6)) for _ in range(rng.randrange(1, 40))]
        leaves = S.blind_trie(tails)
        assert [tails[k] for leaf in leaves for k in leaf] == sorted(tails)
        assert all(len({tails[k] for k in leaf}) == 1 for leaf in leaves) and len(leaves) == len(set(tails))


def test_equal_strings_have_one_anchor(monkeypatch):
    rng = random.Random(8)
    passage = bytes(rng.choice(b"abcdefgh ") for _ in range(400))
    texts = [bytes(rng.choice(b"abcdefgh ") for _ in range(n)) + passage + b"zz" * 50 for n in (0, 13, 700)]
    def anchors(raw):
        return {int(s) + i: int(a) for a, s, n in zip(*S.segments(raw)) for i in range(n)}
    tables = []
    for raw in texts:
        at, found = raw.index(passage), anchors(raw)
        assert sorted(found) == list(range(len(raw) - 99))
        tables.append([found[at + i] for i in range(301)])
    assert tables[0] == tables[1] == tables[2]
    whole = anchors(texts[2])
    monkeypatch.setattr(S, "SLICE", 64)
    assert anchors(texts[2]) == whole
