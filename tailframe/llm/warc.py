"""WARC archives: written with revisit records, read back by boundary-chain verification."""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gated, materialize, table_path

VERSION = "WARC/1.1"
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
CRLF = "\r\n"
DATE = "2026-01-01T00:00:00Z"
#: Payloads of fewer bytes are stored each time.
REVISIT_BYTES = 100
#: Bytes of one archive file, about, which bounds what a reading task holds; a larger record has a file to itself.
FILE_BYTES = 64 << 20
#: Records are written by size, in classes of at most so many bytes, as files are cut by a count of records.
CLASSES = (32 << 10, 1 << 20, 32 << 20)
#: How many times the bytes of a file the first pass digests, before it leaves the rest of its candidates to the second.
DIGEST_PASSES = 3
#: What ends a header block, and a record.
BREAK = b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = REVISIT_BYTES) -> None:
    """Writes a WARC record for every row under ``path``, in files of about FILE_BYTES bytes at most.

    Of equal payloads of at least ``least`` bytes the row with the smallest key is a response and the others
    revisit it; rows that repeat the smallest key too are responses. Null html is an empty payload;
    keys of any type are written as text, url-encoded; a null key has a name without one and is the smallest only among nulls; a null url has no target header and control
    characters in a url are dropped. A record ends in two line breaks, which the text writer puts in as
    its separator, so files are committed by Spark and a lost task leaves nothing behind.
    """
    rows = pages.select(pages[key].alias("k"), pages[url].alias("u"), F.coalesce(pages[html], F.lit("")).alias("x"))
    rows = rows.withColumns({"digest": F.sha2("x", 256), "bytes": F.octet_length("x").cast("long")})
    copies = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.min("k").alias("first")).where("n > 1").drop("n")
    copies = materialize(copies, "copies")
    rows = rows.join(gated(copies), "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("k").eqNullSafe(F.col("first"))
    name = lambda c: F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(F.col(c).cast("string")), F.lit(">")), F.lit("<urn:page>"))
    block = F.when(again, F.lit("")).otherwise(F.col("x"))
    head = [
        F.lit(VERSION), F.concat(F.lit("WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response"))), F.concat(F.lit("WARC-Record-ID: "), name("k")), F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("u", r"[\x00-\x1F\x7F]", "")), F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), F.when(again, F.concat(F.lit("WARC-Refers-To: "), name("first"))),
        F.lit("Content-Type: text/html"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    record = F.concat(F.concat_ws(CRLF, *head), F.lit(CRLF * 2), block)
    records = rows.select(record.alias("value"), size_class().alias("c"))
    seen = pages.select(F.coalesce(F.octet_length(pages[html]), F.lit(0)).cast("long").alias("bytes"), pages[url].alias("u")).select(size_class().alias("c")).distinct().collect()  # one row for each class
    for c in sorted(r["c"] for r in seen) or [0]:
        most = FILE_BYTES // CLASSES[c] if c < len(CLASSES) else 1
        records.where(F.col("c") == c).select("value").write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", most).text(f"{path}/class{c}")


def size_class() -> Column:
    """Which of CLASSES a record belongs to, from its payload, its url and 1 KB for the header's other fields."""
    size = F.col("bytes") + F.coalesce(F.octet_length("u"), F.lit(0)) + 1024
    out = F.lit(len(CLASSES))
    for n in reversed(range(len(CLASSES))):
        out = F.when(size <= CLASSES[n], n).otherwise(out)
    return out


def scan(data: bytes) -> Iterator[tuple]:
    """Every place where a record may start, in or out of payloads: offset, successor, and what the record says.

    A candidate has a whole header, however long, with a content length, and two line breaks where that length ends.
    Places whose headers have the same end are read together, so that each byte is parsed once. Payloads are digested while these
    come to DIGEST_PASSES times the file: candidates nested in each other's payloads would cost its square. The digests of the
    others are null, and made later of those that prove to be records.
    """
    left = DIGEST_PASSES * len(data)
    for x in candidates_of(data):
        start, length = x[-2:]
        left -= length
        yield *x, hashlib.sha256(memoryview(data)[start : start + length]).hexdigest() if left >= 0 else None


def candidates_of(data: bytes) -> Iterator[tuple]:
    starts, end = [], -1
    for m in MAGIC.finditer(data):
        if m.start() > end:
            yield from headers(data, starts, end)
            starts, end = [], data.find(BREAK, m.start())
            if end < 0:
                return
        starts.append((m.start(), m.end()))
    yield from headers(data, starts, end)


def headers(data: bytes, starts: list[tuple[int, int]], end: int) -> Iterator[tuple]:
    """The candidates among ``starts`` (ascending, where a magic begins and ends), all with their header's end at ``end``.

    Read backwards: the lines of a start are its own up to the next start, and those of the next. The last of equal names counts.
    """
    fields: dict[bytes, bytes] = {}
    start, upto = end + len(BREAK), end
    for at, begin in reversed(starts):
        for line in reversed(data[begin:upto].split(b"\r\n")):
            name, colon, value = line.partition(b":")
            if colon:
                fields.setdefault(name.strip().lower(), value.strip())
        upto = begin - 2
        length = fields.get(b"content-length", b"")
        if not length.isdigit() or len(length) > 12:
            continue
        stop = start + int(length)
        if data[stop : stop + len(BREAK)] != BREAK:
            continue
        text = lambda k: fields[k].decode("utf-8", "replace") if k in fields else None
        yield at, stop + len(BREAK), text(b"warc-type"), text(b"warc-record-id"), text(b"warc-target-uri"), text(b"warc-refers-to"), text(b"warc-payload-digest"), start, stop - start


FIELDS = "file string, off long, next long, type string, id string, uri string, refers string, declared string, start long, length long, sha256 string"


def contents(spark: SparkSession, path: str) -> DataFrame:
    """file, content of the archives under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("file"), "content")


def plain(file: str, content: bytes) -> bytes:
    """An archive's records: what all members of a ``.gz`` hold, one after the other. A task holds an archive whole."""
    return gzip.decompress(content) if file.endswith(".gz") else bytes(content)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row for each candidate record of each archive under ``path``, and one at each file's end, with next -1."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, content in zip(part["file"], part["content"], strict=True):
                data = plain(file, content)
                last = (len(data), -1, *[None] * 5, len(data), 0, None)
                yield pd.DataFrame([(file, *x) for x in (*scan(data), last)], columns=[f.split()[0] for f in FIELDS.split(", ")])

    return contents(spark, path).mapInPandas(run, FIELDS)


def late_digests(spark: SparkSession, path: str, records: DataFrame) -> DataFrame:
    """file, off, digest of the ``records`` that the first pass left without one: their archives are read once more."""
    wanted = records.groupBy("file").agg(F.collect_list(F.struct("off", "start", "length")).alias("places"))  # a file's records are bounded by its bytes

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, content, places in zip(part["file"], part["content"], part["places"], strict=True):
                data = plain(file, content)
                yield pd.DataFrame([(file, p["off"], hashlib.sha256(data[p["start"] : p["start"] + p["length"]]).hexdigest()) for p in places], columns=["file", "off", "digest"])

    return contents(spark, path).join(wanted, "file").mapInPandas(run, "file string, off long, digest string")


def reachable(found: DataFrame) -> DataFrame:
    """The candidates on the chain of records that starts at offset 0 of their file: file, off.

    Pointer jumping: after round r the first 2^r records of a file are marked and each pointer spans 2^r records,
    so an archive of n records takes about log2(n) rounds of two equi-joins, all of them distributed. A magic inside
    a payload is a candidate, but no true record leads to it.
    """
    nodes = materialize(found.select("file", "off", F.col("next").alias("jump"), (F.col("off") == 0).alias("seen")), "chain")
    while True:
        targets = nodes.select("file", F.col("off").alias("jump"), F.col("jump").alias("far"))
        marks = nodes.where("seen").select("file", F.col("jump").alias("off"), F.lit(True).alias("mark")).distinct()
        step = nodes.join(marks, ["file", "off"], "left").join(targets, ["file", "jump"], "left")
        nodes = materialize(step.select("file", "off", F.coalesce("far", F.lit(-1)).alias("jump"), (F.col("seen") | F.coalesce("mark", F.lit(False))).alias("seen")), "chain")
        if nodes.where("seen and jump >= 0").isEmpty():
            return nodes.where("seen").select("file", "off")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The true records of the archives under ``path``, with the payload's place (start, length) in its file.

    A file whose chain of records does not end exactly at its size fails the job, so no record can be lost in silence.
    """
    found = materialize(candidates(spark, path), "candidates")
    chain = reachable(found)
    broken = found.where("next < 0").join(chain, ["file", "off"], "left_anti").select("file").first()  # one name, for the message
    if broken is not None:
        raise ValueError(f"the records of archive {broken['file']} do not end at its size")
    records = found.where("next >= 0").join(chain, ["file", "off"])
    late = records.where("sha256 is null")
    if late.isEmpty():
        return records
    late = materialize(late_digests(spark, path, materialize(late, "late")), "digests")
    return records.join(late, ["file", "off"], "left").withColumn("sha256", F.coalesce("sha256", "digest")).drop("digest")


def resolve(records: DataFrame, kind: str = "long") -> DataFrame:
    """page (the written key, read as ``kind``; a text that is none fails the job), payload_bytes, payload_digest, record_type, refers_to; a revisit has the payload of its response.

    A response whose payload is not what its header declares fails the job.
    """
    number = lambda c: F.when(F.col(c).startswith("<urn:page:"), F.url_decode(F.regexp_extract(c, r"^<urn:page:(.*)>$", 1)).cast(kind))
    r = records.select(number("id").alias("page"), "type", number("refers").alias("to"), F.regexp_extract("declared", "^sha256:([0-9a-f]{64})$", 1).alias("declared"), "length", "sha256")
    r = materialize(r, "records")
    whole = r.where("type = 'response'")
    whole = whole.withColumn("ok", F.when(F.col("declared") == F.col("sha256"), F.lit(True)).otherwise(F.raise_error(F.lit("a payload differs from its digest"))))
    first = materialize(whole.groupBy("sha256").agg(F.max("length").alias("n"), F.min("ok").alias("ok")), "payloads")
    again = r.where("type = 'revisit'").select("page", "declared", "to")
    again = again.join(first, again.declared == first.sha256, "left").select("page", F.col("n").alias("payload_bytes"), F.col("declared").alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("to").alias("refers_to"))
    whole = whole.where("ok").select("page", F.col("length").alias("payload_bytes"), F.col("sha256").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast(kind).alias("refers_to"))
    return whole.union(again)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = table_path(spark, "warc")
    write_archives(pages, path)
    return resolve(read_archives(spark, path)).withColumnRenamed("page", "page_id")


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM q
"""
