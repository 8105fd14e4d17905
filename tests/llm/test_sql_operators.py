"""Operators with a SQL form: the oracle on awkward rows, empty tables, small pieces."""

import pytest

from vellum.llm import catalog, licenses, quality, warc
from vellum.session import scratch_path

import edge

DOCS = ["op6_license_scan", "op7_quality_rules"]


@pytest.mark.parametrize("name", DOCS)
def test_documents_match_oracle(spark, tmp_path, sf001, name):
    folder = edge.write_documents(spark, str(tmp_path), real=sf001)
    got = edge.spark_rows(catalog.QUERIES[name](spark, folder))
    want = edge.oracle(catalog.ORACLE_SQL[name], folder, "documents")
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b) if not any(isinstance(x, str) for x in a) else a == b


@pytest.mark.parametrize("name", DOCS)
def test_documents_empty(spark, tmp_path, name):
    folder = edge.write_documents(spark, str(tmp_path), empty=True)
    assert catalog.QUERIES[name](spark, folder).collect() == []


def test_license_places_and_kelvin_sign(spark):
    text = "under the mit license x under the MIT License. cc by nc cc by nc \u212a"
    r = licenses.scan(spark.createDataFrame([(text,)], "text string")).first()
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (16, 4, 0, 12)
    assert (r["base_labels"], r["labels"], r["score"]) == ("cc-by-nc,mit", "cc-by-nc,mit", 1.0)
    k = spark.createDataFrame([("\u212a KEY",)], "text string")
    first, second = k.select(licenses.words(k.text)).first()[0]
    assert first != "k" and second == "key"


def test_altered_sentence_adds_label(spark):
    words = licenses.SENTENCES["bsd"].split()
    words[9:9] = ["whether", "or", "not"]          # inserted: a neighbouring diagonal
    df = spark.createDataFrame([(" ".join(words),), (" ".join(words[:8]),)], "text string")
    rows = licenses.scan(df, carry=("text",)).collect()
    by = {r["text"]: r for r in rows}
    assert by[" ".join(words)]["labels"] == "bsd" and by[" ".join(words)]["base_labels"] == ""
    assert licenses.MIN_COVER <= by[" ".join(words)]["score"] < 1
    assert by[" ".join(words[:8])]["labels"] == ""


def test_host_rates_shrink_small_hosts(spark):
    rows = ([("big", i < 90) for i in range(100)] + [("small", True)] + [(f"h{i}", False) for i in range(30)]
            + [(None, True)])
    df = spark.createDataFrame(rows, "source string, base_failed boolean")
    rate = {r["host"]: r["rate"] for r in quality.host_rates(df, "source").collect()}
    assert None not in rate
    assert rate["big"] > 0.5 and 0 < rate["small"] < 1 and rate["h0"] > 0


def test_rejected_host_takes_its_documents(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = ([(i, "bad", "short") for i in range(40)] + [(99, "bad", good)]
            + [(100 + i, f"ok{i % 5}", good + f" {i}") for i in range(40)] + [(200, None, good)])
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(df).collect()}
    assert not kept[99] and kept[100] and kept[200] and not kept[0]


def test_single_host_uses_bounded_prior(spark):
    df = spark.createDataFrame([("a", True)], "source string, base_failed boolean")
    assert quality.host_rates(df, "source").first()["rate"] == pytest.approx(1.0)


def test_warc_matches_oracle(spark, tmp_path):
    folder = edge.write_pages(spark, str(tmp_path))
    got = edge.spark_rows(catalog.QUERIES["op10_warc"](spark, folder))
    assert got == edge.oracle(catalog.ORACLE_SQL["op10_warc"], folder, "pages")


def test_warc_empty(spark, tmp_path):
    folder = edge.write_pages(spark, str(tmp_path), empty=True)
    assert catalog.QUERIES["op10_warc"](spark, folder).collect() == []


def test_warc_payloads_come_back_and_magic_is_rejected(spark):
    inner = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nhi\r\n\r\ny"
    pages = [(i, f"http://h/{i}", inner + str(i)) for i in range(25)] + [(100, "http://h", inner + "3")]
    path = scratch_path(spark, "warc-test")
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2)
    warc.write_archives(df, path, records_per_file=7)
    back = {int(r["key"]): r for r in warc.read_archives(spark, path).collect()}
    assert sorted(back) == sorted(p[0] for p in pages)
    for key, url, body in pages:
        r = back[key]
        assert r["url"] == url and r["digest_ok"] and r["payload_bytes"] == len(body.encode())
        if key == 100:
            assert (r["record_type"], r["refers_to"], r["payload"]) == ("revisit", "3", None)
        else:
            assert r["record_type"] == "response" and bytes(r["payload"]).decode() == body


def test_warc_small_payloads_are_all_responses(spark):
    path = scratch_path(spark, "warc-test")
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "long enough"), (4, "u", "long enough")],
                               "page_id long, url string, html string")
    warc.write_archives(df, path, min_revisit_bytes=5)
    kinds = {r["key"]: r["record_type"] for r in warc.read_archives(spark, path).collect()}
    assert kinds == {"1": "response", "2": "response", "3": "response", "4": "revisit"}


def test_warc_archives_are_bounded_by_bytes(spark):
    pages = [(i, f"http://h/{i}", f"{i} " * (2_000 if i % 3 else 10)) for i in range(300)]
    pages[150] = (150, "http://h/150", "long " * 40_000)
    path = scratch_path(spark, "warc-test")
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2)
    warc.write_archives(df, path, bytes_per_file=50_000, records_per_file=20)
    sizes = sorted(r["length"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*")
                   .load(path).select("length").collect())
    assert sizes[-2] <= 50_000 + 9_000 and sizes[-1] <= 50_000 + 201_000
    assert len(sizes) <= 2 * sum(sizes) / 50_000 + 300 / 20
    back = {int(r["key"]): r for r in warc.read_archives(spark, path).collect()}
    assert len(back) == len(pages)
    assert all(back[k]["digest_ok"] and bytes(back[k]["payload"]).decode() == body for k, _, body in pages)
    counts = spark.createDataFrame([(r["archive"],) for r in back.values()], "archive string").groupBy("archive").count()
    assert max(r["count"] for r in counts.collect()) <= 20


def test_license_scan_is_linear_in_words(spark):
    """A million words in one text, with a phrase at either end."""
    import time
    n = 1_000_000
    text = "under the mit license " + " ".join(f"w{i % 9973}" for i in range(n)) + " cc by nc"
    t0 = time.perf_counter()
    r = licenses.scan(spark.createDataFrame([(text,)], "text string")).first()
    assert time.perf_counter() - t0 < 60
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n + 7, 2, 0, n + 4)
