"""WARC archives: a writer with revisit records, and a splittable reader.

The writer makes one gzip member per record and lets Spark's text sink put the members one after the other, so that
the output is committed as Spark commits any table. (The sink ends each row with a byte of its own. A member of less than 16 MB
ends with a zero byte, the top byte of its length; the row leaves it out and the sink's line end puts it back. A larger member
is followed by an empty member that ends so.)

The reader's tasks take byte ranges of the files. A task scans its range for the gzip magic, accepts a place as a member
if it decodes with a sound checksum and starts with a WARC header, and owns the records that start inside its range; it reads past
the end of the range to finish its last one. Memory holds one record and one read block.

Defined cases: null html is an empty payload, a null url leaves out the target address; a null page id is written as
an empty one and read as null; repeated rows are records of their own, and all rows with the largest page id of a payload are responses;
an empty table gives an archive without records; other columns aren't read.
"""

from __future__ import annotations

import base64
import gzip
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import new_path, settle

#: Equal payloads of at least so many bytes are written once.
REVISIT_BYTES = 1000
SPLIT_BYTES = 16 << 20
BLOCK = 1 << 20
MAGIC = b"\x1f\x8b\x08"
HEAD = b"WARC/1."
DATE = "2020-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, payload, digest`` (SHA-1 in hex), ``record_type`` and ``refers_to`` of every row."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload")})
    large = rows.filter(F.col("bytes") >= REVISIT_BYTES)
    winners = large.groupBy("digest", "bytes").agg(F.max("page_id").alias("winner"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    joined = rows.join(winners, ["digest", "bytes"], "left")
    revisit = F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner"))
    return joined.select(
        "page_id",
        "url",
        "payload",
        "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("winner")).alias("refers_to"),
    )


def _record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One gzip member without its last byte, which the sink writes."""
    name = lambda x: f"<urn:quern:page:{'' if x is None else x}>"
    block = HTTP if kind == "revisit" else HTTP + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {' '.join(url.split())}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    data = gzip.compress("\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)
    if data[-1]:
        data += gzip.compress(b"", mtime=0)
    return data[:-1]


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write ``pages`` as WARC archives into the folder ``path``."""

    @F.arrow_udf(T.BinaryType())
    def member(page_id: pa.Array, url: pa.Array, payload: pa.Array, digest: pa.Array, kind: pa.Array, refers_to: pa.Array) -> pa.Array:
        rows = zip(*(x.to_pylist() for x in (page_id, url, payload, digest, kind, refers_to)))
        return pa.array([_record(*x) for x in rows], pa.binary())

    planned = plan_records(pages, key, url, html)
    members = planned.select(member("page_id", "url", "payload", "digest", "record_type", "refers_to").cast("string").alias("value"))
    members.write.option("lineSep", "\0").option("compression", "none").text(path)


class _Window:
    """Bytes of a file from a position on, read in blocks as they are asked for."""

    def __init__(self, file, at: int):
        self.file, self.at, self.data = file, at, bytearray()  # grows and shrinks without being copied as a whole
        file.seek(at)

    def more(self) -> bool:
        block = self.file.read(BLOCK)
        self.data += block
        return bool(block)

    def drop(self, upto: int) -> None:
        del self.data[: upto - self.at]
        self.at = upto


def _member(window: _Window, start: int):
    """Content of the gzip member at ``start`` and where it ends, or None if there is no sound one with a WARC record."""
    decoder, out, fed = zlib.decompressobj(31), bytearray(), start - window.at
    while not decoder.eof:
        if fed == len(window.data) and not window.more():
            return None
        part = bytes(memoryview(window.data)[fed : fed + BLOCK])
        fed += len(part)
        try:
            out += decoder.decompress(part)
        except zlib.error:
            return None
        if not out.startswith(HEAD[: len(out)]):
            return None
    return (bytes(out), window.at + fed - len(decoder.unused_data)) if out.startswith(HEAD) else None


def records_in(file, start: int, end: int):
    """Contents of the records that start at ``start`` or later and before ``end``."""
    window = _Window(file, start)
    at = start
    while at < end:
        window.drop(at)
        while (found := window.data.find(MAGIC)) < 0:
            keep = max(window.at, window.at + len(window.data) - 2)  # the magic may lie across two blocks
            if keep >= end:
                return
            window.drop(keep)
            if not window.more():
                return
        at = window.at + found
        if at >= end:
            return
        got = _member(window, at)
        if got is None:
            at += 1
        else:
            content, at = got
            yield content


def _parsed(content: bytes):
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[: int(fields.get("content-length", 0))]
    return fields, block.partition(b"\r\n\r\n")[2]


def _page(urn: str | None):
    number = (urn or "").strip("<>").rpartition(":")[2]
    return int(number) if number else None


def _open(path: str):
    """A file of any store that Arrow reads: local, HDFS, S3, GCS."""
    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file://" + path[5:]
    path = path.replace("s3a://", "s3://", 1)
    system, inner = pafs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def read(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the archives in ``path``: ``page_id, record_type, url, payload, digest, refers_to``."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))
    ranges = files.select("path", F.explode(starts).alias("start")).withColumn("end", F.col("start") + split_bytes)
    # as many tasks as ranges; a range is a row of a few bytes, so Spark would put them all into one
    ranges = ranges.repartition(max(1, ranges.count()))
    schema = "page_id long, record_type string, url string, payload binary, digest string, refers_to long"

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                out, size = [], 0
                with _open(row["path"]) as file:
                    for content in records_in(file, row["start"], row["end"]):
                        f, payload = _parsed(content)
                        digest = base64.b32decode(f["warc-payload-digest"].partition(":")[2]).hex() if "warc-payload-digest" in f else None
                        out.append((_page(f.get("warc-record-id")), f.get("warc-type"), f.get("warc-target-uri"), payload, digest, _page(f.get("warc-refers-to"))))
                        size += len(payload)
                        if size > 8 << 20:
                            yield _batch(out)
                            out, size = [], 0
                if out:
                    yield _batch(out)

    return ranges.mapInArrow(run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64()]
    names = ["page_id", "record_type", "url", "payload", "digest", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)



def resolve(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to``; a revisit has the payload of the response that it names.

    The archives are read once: what the join needs of a record is kept as a table."""
    measured = records.select("page_id", "record_type", "digest", "refers_to", F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha"))
    measured = settle(measured, "records")
    full = measured.filter("record_type = 'response'")
    targets = full.groupBy(F.col("page_id").alias("refers_to"), F.col("sha").alias("digest")).agg(F.max("bytes").alias("full_bytes"))
    again = measured.filter("record_type = 'revisit'").join(targets, ["refers_to", "digest"], "left")
    return full.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("sha").alias("payload_digest"), "record_type", "refers_to").unionByName(
        again.select("page_id", F.col("full_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    )


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ``pages`` to new archives in the shared folder and resolve what is read back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, key, url, html)
    out = resolve(read(spark, path))
    return out if key == "page_id" else out.withColumnRenamed("page_id", key)


ORACLE_SQL = f"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(encode(coalesce(html, ''))) as d from pages),
w as (select n, d, max(page_id) as winner from p where n >= {REVISIT_BYTES} group by n, d)
select p.page_id, p.n::bigint as payload_bytes, p.d as payload_digest,
  case when w.winner is not null and p.page_id is distinct from w.winner then 'revisit' else 'response' end as record_type,
  case when w.winner is not null and p.page_id is distinct from w.winner then w.winner end as refers_to
from p left join w on p.n = w.n and p.d = w.d
"""
