"""WARC archives: written by Spark's text writer, read by a Python data source with pushdown.

Writing. A record is a string of headers and payload; the text writer puts the record end after it, compresses each file
and commits it atomically, so a lost executor leaves no half archive, on any file system Spark can write. Records with
equal payloads become one response and revisits without payload.

Reading. The data source plans one partition a file. It takes equality filters on the record type and on headers: headers
are parsed first, and the payload of a record that fails a filter, or of any record when payloads are not asked for, is
passed over without decoding or hashing.

Defined results: a null html is the empty payload; equal payloads count from ``least`` bytes on; among equal payloads the
smallest page_id is the response, repeated rows of it too; a row without an id is a response without a record id, and no other record
refers to it; line ends in an address are left out; a very long payload is one value in one task; other columns are not read; an empty table
gives an empty archive and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

END, RECORDS_A_FILE = "\r\n\r\n", 4000
# Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
    "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "payload_length": "x-payload-length",
}
SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, payload_length string, content_length long, payload binary"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1, with SQL functions: five hexadecimal digits are four of base 32."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """page_id, url, payload (a string), its digest and length, and refers_to: null for responses."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    digests = p.select("page_id", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))
    # Counted before the shuffle, so a hot payload is one row a task there; only payloads seen twice go on.
    first = digests.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    p = p.withColumns({"digest": base32_sha1(F.col("payload")), "bytes": F.octet_length("payload").cast("long")})
    p = p.join(first, ["digest", "bytes"], "left")
    return p.withColumn("refers_to", F.when(F.col("first") < F.col("page_id"), F.col("first"))).drop("first")


def records(planned: DataFrame) -> DataFrame:
    """One string a WARC record, its end excluded."""
    revisit = F.col("refers_to").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", "")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("bytes").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("refers_to")))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
    ]
    return planned.select(F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), F.when(revisit, "").otherwise(F.col("payload"))).alias("value"))


def write_archive(planned: DataFrame, path: str) -> None:
    records(planned).write.mode("overwrite").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


def _filesystem(path: str):
    """(file system, path in it); local paths need no library, others go through Arrow's file systems."""
    from pyarrow import fs

    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(path).path
    return fs.FileSystem.from_uri(path)


def parse_archive(stream, wanted, payloads: bool = True) -> Iterator[tuple[dict[str, str], int, bytes | None]]:
    """(headers, content length, payload) of the records that wanted(headers) holds for, in file order."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"not a record's first line: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        n = int(headers["content-length"])
        take = wanted(headers)
        if take and payloads:
            payload = stream.read(n)
            if len(payload) != n:
                raise ValueError("truncated payload")
            digest = headers.get("warc-payload-digest", "").partition("sha1:")[2]
            if headers.get("warc-type") == "response" and digest and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"payload digest of {headers.get('warc-record-id')}")
            yield headers, n, payload
        else:
            left = n
            while left and (got := len(stream.read(min(left, 1 << 20)))):
                left -= got
            if take:
                yield headers, n, None


class WarcFile(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.payloads = options["path"], options.get("payloads", "true").lower() == "true"
        self.equal: list[tuple[str, str]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in HEADERS and isinstance(f.value, str):
                self.equal.append((f.attribute[0], f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, at = _filesystem(self.path)
        found = [f.path for f in store.get_file_info(fs.FileSelector(at)) if f.is_file and not f.base_name.startswith(("_", "."))]
        return [WarcFile(p) for p in sorted(found)]

    def read(self, partition: WarcFile) -> Iterator[pa.RecordBatch]:
        equal = [(c, HEADERS[c], v) for c, v in self.equal]
        names = [*HEADERS, "content_length", "payload"]
        kinds = [*[pa.string()] * len(HEADERS), pa.int64(), pa.binary()]

        def shown(column: str, headers: dict[str, str]) -> str | None:
            value = headers.get(HEADERS[column])
            return value.partition("sha1:")[2] if column == "payload_digest" and value else value

        def wanted(headers: dict[str, str]) -> bool:
            return all(shown(c, headers) == v for c, _, v in equal)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        store, _ = _filesystem(self.path)
        rows, size = [], 0
        with store.open_input_stream(partition.path, compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) as stream:
            for headers, n, payload in parse_archive(stream, wanted, self.payloads):
                rows.append((*(shown(c, headers) for c in HEADERS), n, payload))
                size += n if payload is not None else 200
                if len(rows) >= 1000 or size > 8 << 20:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)


class WarcSource(DataSource):
    """spark.read.format("weft_warc").option("payloads", "true" or "false").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "weft_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options)


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    # The source plans its own filters; without this setting Spark would apply them after reading.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("weft_warc").option("payloads", str(payloads).lower()).load(path)


def page_id(urn: str) -> Column:
    return F.regexp_extract(urn, r"<urn:page:(-?\d+)>", 1).cast("long")


def archive_rows(spark: SparkSession, path: str) -> DataFrame:
    """What the archives say of each page: responses by their payloads, revisits by their headers alone."""
    full = read_archive(spark, path).where(F.col("record_type") == "response")
    full = full.select(
        page_id("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"),
    )
    again = read_archive(spark, path, payloads=False).where(F.col("record_type") == "revisit")
    again = again.select(page_id("record_id").alias("page_id"), F.col("payload_length").cast("long").alias("payload_bytes"), "payload_digest", "record_type", page_id("refers_to").alias("refers_to"))
    return full.unionByName(again)
