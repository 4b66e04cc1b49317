"""WARC archives: native writer with revisits, an index of offsets first, then coalesced byte-range reads of the wanted records."""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegrid.llm import _shared as S

#: Digits of base 32 as Spark's conv() writes them, and as RFC 4648 does.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 160 bits are four times 40 bits, each eight digits."""
    h = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def with_revisits(rows: DataFrame, min_bytes: int = 0, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(id, payload, ...) with refers_to: of equal payloads of at least `min_bytes` bytes the largest id, null for that one itself.

    Payloads are equal when SHA-256 and length are. Ids and hashes are grouped, with salts as in _shared.with_group, never
    payloads; the ids that refer to another come back to the payloads by broadcast while their counted size is at most
    `broadcast_bytes`, else by a join on the id and the hash. A row without an id refers to nothing and nothing refers to it."""
    n = 2 * S.partitions(rows.sparkSession)
    key = F.unhex(F.sha2("payload", 256))
    told = rows.where(F.col("id").isNotNull() & (F.octet_length("payload") >= min_bytes)).select("id", key.alias("key"))
    told = told.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    sums = told.groupBy("key", "salt").agg(F.max("id").alias("top"), F.min("id").alias("low"))
    w = W.partitionBy("key")
    tops = sums.select("key", "salt", F.max("top").over(w).alias("top"), F.min("low").over(w).alias("low")).where("low < top")
    again = S.written(told.join(tops, ["key", "salt"]).where("id < top").select("id", "key", F.col("top").alias("refers_to")).distinct(), "revisits")
    found = S.small(again, 80 * again.count(), broadcast_bytes)
    return rows.withColumn("key", key).join(found, ["id", "key"], "left").drop("key")


def record(at: str = "2024-01-01T00:00:00Z") -> Column:
    """One record of (id, url, payload, refers_to) as bytes, without the line feed at its end, which the writer adds.

    Both kinds hold the HTTP head, whose Content-Length is that of the whole payload; only a response holds the payload too. Page-ID
    and Refers-To-Page-ID carry the integers, WARC-Record-ID and WARC-Refers-To the identifiers made of them and of the digest."""
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    digest = F.col("digest")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(CRLF * 2))
    again = F.col("refers_to").isNotNull()

    def urn(page: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), digest, F.lit(">"))

    size = F.octet_length(head) + F.when(again, 0).otherwise(F.octet_length("payload"))
    fields = [
        ("WARC-Type", F.when(again, "revisit").otherwise("response")),
        ("WARC-Record-ID", urn(F.col("id"))),
        ("WARC-Date", F.lit(at)),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        ("Page-ID", F.col("id").cast("string")),
        ("WARC-Profile", F.when(again, PROFILE)),
        ("WARC-Refers-To", F.when(again, urn(F.col("refers_to")))),
        ("Refers-To-Page-ID", F.col("refers_to").cast("string")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", size.cast("string")),
    ]
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")) for name, value in fields]
    top = F.concat(F.lit(f"WARC/1.1{CRLF}"), *lines, F.lit(CRLF), head)
    return F.concat(top.cast("binary"), F.when(again, F.lit("").cast("binary")).otherwise(F.col("payload")), F.lit("\r\n\r").cast("binary"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> None:
    """A record for each row of pages, in archives under path/archives, one for each task that reads the table, in the rows' order there.

    A null payload is empty. Of equal payloads of at least `min_bytes` bytes the one with the largest id is a response and the others
    are revisits of it; smaller ones are all responses. Rows that share the largest id and the payload are all responses. Null ids
    are responses without a Page-ID. Blanks and control characters in an address become %20. Written by Spark's own writer,
    so a lost task is written again by another and no archive is seen before it is whole; payloads are not shuffled unless there are
    more revisits than may be broadcast."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary")).alias("payload"))
    rows = with_revisits(rows, min_bytes).withColumn("digest", base32_sha1(F.col("payload")))
    # The text writer writes a string's bytes as they are, and its separator after each: the record's last byte.
    rows.select(record().cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/archives")


class Window:
    """Reads a file front to back through a window, so that heads cost few reads and long payloads are jumped over."""

    def __init__(self, source, size: int, window: int = 1 << 20) -> None:
        self.source, self.size, self.window, self.first, self.held = source, size, window, 0, b""

    def get(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if not (self.first <= at and at + n <= self.first + len(self.held)):
            self.first, self.held = at, self.source.read_at(min(max(n, self.window), self.size - at), at)
        return self.held[at - self.first : at - self.first + n]


def fields(head: bytes) -> dict[str, str]:
    """Named fields of a record's head, in lower case; the version line is checked."""
    first, *lines = head.decode("utf-8", "replace").split(CRLF)
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def head_at(file: Window, at: int) -> bytes:
    """The head of the record at a place, with the empty line that ends it."""
    n = 1024
    while True:
        got = file.get(at, n)
        end = got.find(b"\r\n\r\n")
        if end >= 0:
            return got[: end + 4]
        if len(got) < n:
            raise ValueError(f"damaged record at {at}")
        n *= 4


def plain_records(file: Window) -> Iterator[tuple[int, int, dict]]:
    """(offset, length, fields) of each record; payloads are not read."""
    at = 0
    while at < file.size:
        head = head_at(file, at)
        known = fields(head)
        n = len(head) + int(known["content-length"]) + 4
        if at + n > file.size:
            raise ValueError(f"damaged record at {at}")
        yield at, n, known
        at += n


def packed_records(file: Window) -> Iterator[tuple[int, int, dict]]:
    """The same for archives of one gzip member for each record; offset and length are those of the member."""
    at = 0
    while at < file.size:
        member, head, end = zlib.decompressobj(31), b"", at
        while not member.eof:
            chunk = file.get(end, 1 << 14)
            if not chunk:
                raise ValueError(f"damaged record at {at}")
            got = member.decompress(chunk)
            if b"\r\n\r\n" not in head:
                head += got
            end += len(chunk) - len(member.unused_data)
        yield at, end - at, fields(head[: head.find(b"\r\n\r\n")])
        at = end


def _opened(uri: str):
    """A file that Arrow can open by its address: local and shared folders, S3, GCS, HDFS."""
    if uri.startswith("file:"):
        return pa.OSFile(uri.removeprefix("file:").replace("///", "/", 1))
    fs, path = pa.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return fs.open_input_file(path)


def write_index(spark: SparkSession, path: str, archives: str | None = None) -> DataFrame:
    """Reads the heads of all records under path/archives (or `archives`) and writes and returns the index, path/index:
    file, offset, length, url, digest, record_type, page_id, refers_to.

    Spark lists the files and deals them out by size; a task reads heads through a window of 1 MB and jumps over what lies between.
    Names that end in .gz are archives of a gzip member for each record. Records without a Page-ID have page_id null; other
    types of records than response and revisit are indexed too. A damaged record raises ValueError."""
    files = spark.read.format("binaryFile").load(archives or f"{path}/archives").select("path", "length")
    names = ["file", "offset", "length", "url", "digest", "record_type", "page_id", "refers_to"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def number(x: str | None) -> int | None:
        return None if x is None else int(x)

    def scan(batches):
        for b in batches:
            for uri, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with _opened(uri) as source:
                    rows, file = [], Window(source, size)
                    for at, n, f in packed_records(file) if uri.endswith(".gz") else plain_records(file):
                        digest = f.get("warc-payload-digest")
                        rows.append((uri, at, n, f.get("warc-target-uri"), digest and digest.removeprefix("sha1:"), f.get("warc-type"), number(f.get("page-id")), number(f.get("refers-to-page-id"))))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "file string, offset long, length long, url string, digest string, record_type string, page_id long, refers_to long"
    files.mapInArrow(scan, schema).write.parquet(f"{path}/index")
    return spark.read.schema(schema).parquet(f"{path}/index")


def ranges(places: list[tuple[str, int, int]], gap: int, most: int) -> Iterator[tuple[int, int, int, int]]:
    """(first, last + 1, start, end) of runs of sorted places of one file that are read together: gaps of at most `gap`
    bytes, at most `most` bytes unless one record is longer."""
    i = 0
    while i < len(places):
        file, start, n = places[i]
        end, j = start + n, i + 1
        while j < len(places) and places[j][0] == file and places[j][1] - end <= gap and max(end, places[j][1] + places[j][2]) - start <= most:
            end, j = max(end, places[j][1] + places[j][2]), j + 1
        yield i, j, start, end
        i = j


def parse(data: bytes, packed: bool = False) -> tuple[dict, bytes, bytes]:
    """Fields, HTTP head and payload of one record's bytes."""
    data = zlib.decompress(data, 31) if packed else data
    head = head_at(Window(pa.BufferReader(data), len(data)), 0)
    known = fields(head)
    block = data[len(head) : len(head) + int(known["content-length"])]
    http, mid, payload = block.partition(b"\r\n\r\n") if known.get("content-type", "").startswith("application/http") else (b"", b"", block)
    return known, http + mid, payload


def read_records(wanted: DataFrame, gap: int = 64 << 10, most: int = 8 << 20, task_bytes: int = 32 << 20) -> DataFrame:
    """Rows of the index -> page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload: each read at its place.

    The rows are range-partitioned by file and offset, as many partitions as keep a task near `task_bytes`, and sorted; neighbours
    with gaps of at most `gap` bytes are fetched by one read of at most `most` bytes, so memory holds that or one record. A response's
    digest is taken from the payload read and must be the recorded one, else ValueError is raised. A revisit has no payload (null);
    its payload_bytes are what its HTTP head records, its digest the recorded one. Records listed twice are read twice."""
    size = int(wanted.agg(F.sum("length")).first()[0] or 0)
    rows = wanted.select("file", "offset", "length").repartitionByRange(max(1, -(-size // task_bytes)), "file", "offset").sortWithinPartitions("file", "offset")
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def one(data: bytes, uri: str) -> tuple:
        f, http, payload = parse(data, uri.endswith(".gz"))
        digest, kind = f.get("warc-payload-digest", "").removeprefix("sha1:") or None, f.get("warc-type")
        n = len(payload)
        if kind == "revisit":
            n = int(next((x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"0"))
            payload = None
        else:
            own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if digest not in (None, own):
                raise ValueError(f"payload of {f.get('warc-record-id')} has another digest than recorded")
            digest = own
        page, other = f.get("page-id"), f.get("refers-to-page-id")
        return None if page is None else int(page), f.get("warc-target-uri"), kind, None if other is None else int(other), n, digest, payload

    def fetch(batches):
        for b in batches:
            places = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            name, source = None, io.BytesIO()
            for i, j, start, end in ranges(places, gap, most):
                if places[i][0] != name:
                    source.close()
                    name = places[i][0]
                    source = _opened(name)
                held = source.read_at(end - start, start)
                got = [one(held[at - start : at - start + n], uri) for uri, at, n in places[i:j]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)], names)
            source.close()

    return rows.mapInArrow(fetch, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")
