"""WARC archives: writing, and reading by boundary-chain verification (operator 10).

Writing.  Every page becomes one WARC/1.1 record in uncompressed archives, written by Spark's
text writer (a record ends in CRLF CRLF, of which the second is the writer's line end).
An archive is bounded by records and by bytes: a task's records are counted in units of
``bytes_per_file / records_per_file`` bytes, at least one each, and the running number of
units chooses the archive.  It has at most ``bytes_per_file`` bytes and one record more.
Pages of equal payload are grouped by digest: the smallest key's record is a response
with the payload, the others are revisits of it without one.

Reading.  A task takes an archive, looks for the record
magic anywhere, also inside payloads, and emits each candidate with the offset where
its record would end.  Pointer jumping from offset 0 of each archive, in log2(records)
joins, keeps the reachable candidates; a magic inside a payload is on no chain.

Defined results: null payload is empty; a null key is written as such and read back as null;
among equal payloads a null key never becomes the response unless all keys are null, and then
each of them is a response; rows that tie for the smallest key (repeated rows) are all
responses; line breaks in a url become spaces; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import common as C
from vellum.session import materialize, scratch_path, ship_package

CRLF = "\r\n"
#: Bound an archive, which one task reads whole.
RECORDS_PER_FILE = 2000
BYTES_PER_FILE = 32 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_HEADER = re.compile(rb"^([^:\r\n]+):[ \t]*([^\r\n]*?)[ \t]*\r?$", re.M)


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column."""
    digits = F.sha1(data)
    out = []
    for k in range(8):  # 5 hex digits are 20 bits, 4 letters
        group = F.conv(F.substring(digits, 5 * k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            five = F.shiftright(group, shift).bitwiseAND(F.lit(31))
            out.append(F.substring(F.lit(_ALPHABET), five + 1, F.lit(1)))
    return F.concat(*out)


def write_archives(df: DataFrame, path: str, key_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", min_revisit_bytes: int = 0,
                   records_per_file: int = RECORDS_PER_FILE, date: str = DATE,
                   bytes_per_file: int = BYTES_PER_FILE) -> None:
    """Write a record per row under ``path`` (any folder that Spark can write)."""
    body = F.coalesce(C.col(payload_col).cast("string"), F.lit(""))
    rows = df.select(C.col(key_col).alias("key"), C.col(url_col).alias("url"), body.alias("body")
                     ).withColumns({"digest": base32_sha1(F.col("body").cast("binary")),
                                    "bytes": F.octet_length("body")})
    shared = (rows.where(F.col("bytes") >= min_revisit_bytes).groupBy("digest")
              .agg(F.min("key").alias("first"), F.count("*").alias("n")).where(F.col("n") > 1))
    # only repeated payloads, stored: the planner knows the size, and where it is small the
    # pages are not moved
    shared = materialize(shared.select("digest", "first"), "shared-payloads")
    rows = rows.join(shared, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))

    def name(c: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))

    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"
                          "Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.when(revisit, http).otherwise(F.concat(http, "body"))
    fields = [
        F.lit("WARC/1.1"),
        F.when(revisit, F.lit("WARC-Type: revisit")).otherwise(F.lit("WARC-Type: response")),
        F.concat(F.lit("WARC-Record-ID: "), name("key")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "),
                 F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name("first"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"),
        F.concat(F.lit("X-Payload-Length: "), F.col("bytes").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    record = F.concat(F.concat_ws(CRLF, *fields), F.lit(CRLF + CRLF), block, F.lit(CRLF))
    # a row per unit, of which the last one has the record; the rows' numbers in their
    # partition (the lower 33 bits) are then the running sum
    unit = max(1, bytes_per_file // records_per_file)
    units = F.ceil(F.octet_length("value") / F.lit(unit)).cast("int")
    rows = rows.select(record.alias("value")).select(F.explode_outer(F.transform(
        F.sequence(F.lit(1), units), lambda k: F.when(k == units, F.col("value")))).alias("value"))
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    (rows.select(F.floor(number / F.lit(records_per_file)).alias("archive"), "value").where("value IS NOT NULL")
     .write.partitionBy("archive").option("lineSep", CRLF).text(path))


def candidates(data: bytes) -> Iterator[tuple[int, int, dict[str, str], int, int]]:
    """(offset, successor, headers, block start, block end) of every plausible record.

    A candidate needs a header block with a length whose record ends within the archive
    in CRLF CRLF; whether it is a record is decided by the chain.
    """
    for m in _MAGIC.finditer(data):
        head = data.find(b"\r\n\r\n", m.end() - 2)
        if head < 0:
            continue
        fields = {k.decode("latin-1").strip().lower(): v.decode("utf-8", "replace")
                  for k, v in _HEADER.findall(data, m.end(), head)}
        size = fields.get("content-length", "")
        if not size.isdecimal():
            continue
        begin = head + 4
        end = begin + int(size)
        if data[end:end + 4] == b"\r\n\r\n":
            yield m.start(), end + 4, fields, begin, end


def _page(uri: str) -> str | None:
    inner = uri.strip("<>").removeprefix("urn:page:")
    return None if inner == "null" or not uri else inner


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records under ``path``: archive, offset, record_type, key, refers_to, url,
    payload_bytes, payload_digest, digest_ok (and payload; null for revisits).

    Of a response the length and digest are those of the payload read; digest_ok tells
    whether the header agrees.  A revisit has them from its header.
    """
    ship_package(spark)
    schema = ("archive string, offset long, successor long, record_type string, key string, "
              "refers_to string, url string, payload_bytes long, payload_digest string, "
              "digest_ok boolean" + ", payload binary" * with_payload)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, data = [], content.as_py()
                for offset, successor, head, begin, end in candidates(data):
                    kind = head.get("warc-type", "")
                    said = head.get("warc-payload-digest", "").removeprefix("sha1:")
                    payload, size, digest = None, int(head.get("x-payload-length") or 0), said
                    if kind == "response":
                        http = data.find(b"\r\n\r\n", begin, end)
                        payload = data[http + 4 if http >= 0 else begin:end]
                        size = len(payload)
                        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    row = [where, offset, successor, kind, _page(head.get("warc-record-id", "")),
                           _page(head.get("warc-refers-to", "")), head.get("warc-target-uri", ""),
                           size, digest, digest == said]
                    rows.append(row + [payload] * with_payload)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(),
             pa.int64(), pa.string(), pa.bool_()] + [pa.binary()] * with_payload
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
             .select("path", "content"))
    found = materialize(files.mapInArrow(run, schema).withColumns(
        {"__a": F.xxhash64("archive"), "__b": F.xxhash64("archive", F.lit("b"))}), "warc-candidates")
    chain = reachable(found.select("__a", "__b", "offset", "successor"))
    return found.join(chain.hint("merge"), ["__a", "__b", "offset"], "left_semi").drop("successor", "__a", "__b")


def reachable(candidate: DataFrame) -> DataFrame:
    """(__a, __b, offset) of the candidates on the chain from each archive's first byte.

    An archive is known by two 64-bit hashes of its path, so that a row is four numbers in
    memory as on disk.  The tables grow with the records and meet by sort-merge at every size.  Pointer jumping:
    after round k the set holds the first 2^k records of every chain and the jumps span 2^k
    records.  Every round is written to the shared folder.
    """
    def met(left: DataFrame, place: str) -> DataFrame:
        return left.join(ahead.hint("merge"), (F.col("__a") == F.col("a")) & (F.col("__b") == F.col("b"))
                         & (F.col(place) == F.col("at")))

    jump = candidate
    chain = candidate.where(F.col("offset") == 0).select("__a", "__b", "offset")
    while True:
        ahead = jump.select(F.col("__a").alias("a"), F.col("__b").alias("b"),
                            F.col("offset").alias("at"), F.col("successor").alias("to"))
        more = met(chain, "offset").select("__a", "__b", F.col("to").alias("offset"))
        chain = materialize(chain.unionByName(more), "warc-chain")
        jump = materialize(met(jump, "successor").select("__a", "__b", "offset", F.col("to").alias("successor")),
                           "warc-jumps")
        if not jump.head(1):
            return chain.join(candidate.select("__a", "__b", "offset").hint("merge"),
                              ["__a", "__b", "offset"], "left_semi")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page, written to archives in the shared folder and read back."""
    pages = C.read(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    back = read_archives(spark, path, with_payload=False)
    return back.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest",
                       "record_type", F.col("refers_to").cast("long").alias("refers_to"))


#: The same from the pages, without archives.
ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
q AS (
  SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
         list_aggregate(list_transform(range(0, 32), lambda i: substr('{_ALPHABET}',
           CAST(((CAST(('0x' || substr(hex, 1 + 5 * (i // 4), 5)) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS INT) + 1,
           1)), 'string_agg', '') AS payload_digest,
         min(page_id) OVER (PARTITION BY hex) AS first
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM q
"""
