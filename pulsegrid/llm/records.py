"""Length-delimited binary records of token ids with masked checksums, and a separate offset index.

A data file is a sequence of records:

    u32 length of the payload | u32 masked crc32 of these four bytes | payload | u32 masked crc32 of the payload | 0x0A
    payload: u8 flags (1: the id is null, 2: ids are u32, else u16) | i64 id | token ids

All integers are little-endian. The index is a Parquet table beside the data: part (file number), offset, length, id, n_tokens,
before (ids of all earlier records in the file), ids_crc32 (of the ids as u32).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegrid.llm import _shared as S
from pulsegrid.llm import tokens as T

HEAD, TAIL, KEY = struct.Struct("<II"), struct.Struct("<I"), struct.Struct("<Bq")


def masked(data: bytes) -> int:
    """crc32, rotated and shifted so that a checksum of data that holds checksums stays sound."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(key: int | None, ids: bytes, width: int) -> bytes:
    """A record without its last byte, the 0x0A that the writer adds."""
    payload = KEY.pack((key is None) | (width == 4) << 1, key or 0) + ids
    size = len(payload).to_bytes(4, "little")
    return b"".join((size, TAIL.pack(masked(size)), payload, TAIL.pack(masked(payload))))


def unframe(data: bytes | memoryview, at: int = 0) -> tuple[int | None, np.ndarray, int]:
    """The record at a place: id, token ids, the place after it. Raises ValueError if a checksum is wrong."""
    size, check = HEAD.unpack_from(data, at)
    payload = bytes(data[at + 8 : at + 8 + size])
    if masked(bytes(data[at : at + 4])) != check or len(payload) != size or TAIL.unpack_from(data, at + 8 + size)[0] != masked(payload):
        raise ValueError(f"damaged record at {at}")
    flags, key = KEY.unpack_from(payload)
    ids = np.frombuffer(payload, dtype="<u4" if flags & 2 else "<u2", offset=KEY.size)
    return None if flags & 1 else key, ids, at + 8 + size + 5


def write_records(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, vocabulary: str | None = None, file_bytes: int = 32 << 20) -> None:
    """Writes docs as records in ascending order of the id: range-partitioned by id, one file for each range.

    Null ids come first. Null and empty texts give records with the end id alone. Equal ids stand together, in any order. Files
    hold near `file_bytes` of input; they go through Spark's writer, so a lost task is written again by another.
    """
    vocabulary = T.vocabulary_path(vocabulary)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    size = S.input_bytes(rows)
    n = max(1, -(-size // file_bytes), min(S.partitions(docs.sparkSession), size >> 20))
    ordered = rows.repartitionByRange(n, "id").sortWithinPartitions("id")

    def frames(batches):
        enc = T.made(T.Encoder, vocabulary)
        end = np.array([end_id], dtype=enc.kind).tobytes()
        for b in T.by_chars(batches, 1, T.BATCH_BYTES, 512):
            ids = enc.batch(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([frame(k, x + end, enc.width) for k, x in zip(b.column(0).to_pylist(), ids, strict=True)], pa.binary())], ["value"])

    # The text writer writes a string's bytes as they are, and the separator after each: the record's last byte.
    ordered.mapInArrow(frames, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/data")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{path}/data").select(F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("long").alias("part"), "content")


def _scan(part: int, data: memoryview) -> Iterator[tuple]:
    at = before = 0
    while at < len(data):
        key, ids, after = unframe(data, at)
        yield part, at, after - at, key, len(ids), before, zlib.crc32(ids.astype("<u4").tobytes())
        at, before = after, before + len(ids)


def write_index(spark: SparkSession, path: str) -> DataFrame:
    """Reads all data files, checks each record, writes the offset index and returns it with `start`: ids of all records before."""
    names = ["part", "offset", "length", "id", "n_tokens", "before", "ids_crc32"]

    def scan(batches):
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = list(_scan(part, memoryview(data.as_buffer())))
                for i in range(0, len(rows), 8192):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 8192], strict=True)], names)

    schema = ", ".join(f"{c} long" for c in names)
    _files(spark, path).mapInArrow(scan, schema).write.parquet(f"{path}/index")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index with `start`. One row for each file goes through one window; rows find their file's start by its number."""
    index = spark.read.parquet(f"{path}/index")
    sums = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    first = sums.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    return index.join(first, "part").withColumn("start", (F.col("first") + F.col("before")).cast("long")).drop("first")


def read_records(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Random access: rows of the index (part, offset, and other columns) -> these with key and ids, each read at its offset and checked."""
    places = wanted.groupBy("part").agg(F.collect_list("offset").alias("offsets"))
    files = _files(spark, path).join(places, "part")

    def fetch(batches):
        for b in batches:
            for part, data, offsets in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                view = memoryview(data.as_buffer())
                got = [unframe(view, o) for o in offsets]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(got), pa.int64()), pa.array(offsets, pa.int64()), pa.array([k for k, _, _ in got], pa.int64()), pa.array([x.tolist() for _, x, _ in got], pa.list_(pa.int64()))], ["part", "offset", "key", "ids"])

    return files.mapInArrow(fetch, "part long, offset long, key long, ids array<long>")
