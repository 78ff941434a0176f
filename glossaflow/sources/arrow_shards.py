"""Arrow IPC shards (``.arrow``, stream or file format) as ordered tables.

One job reads the message headers of every shard, a few bytes per record batch, and
leaves a table of where each batch stands and how many rows it has. Positions are
prefix sums of that table. A second job reads record batches, each by itself: those
that a slice does not touch are never opened, and a task holds one batch at a time.

Shards are listed by Spark and opened through ``pyarrow.fs``, so they can be in any
store that it reads (local or mounted folders, HDFS, S3, GCS).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from glossaflow.sources.ordering import prefix_sums

# Bytes of record batches that one task reads, one after the other.
TASK_BYTES = 64 << 20

# Fixed values of the Arrow IPC format.
MAGIC = b"ARROW1\0\0"
CONTINUATION = 0xFFFFFFFF
SCHEMA_HEADER, DICTIONARY_HEADER, BATCH_HEADER = 1, 2, 3

NUMBERS = ("batch", "head", "start", "size", "_n")
INDEX = "path STRING, " + ", ".join(f"{c} BIGINT" for c in NUMBERS)


def _open(path: str) -> pa.NativeFile:
    if path.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    if "://" not in path:
        return pafs.LocalFileSystem().open_input_file(path)
    store, inner = pafs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def _field(table: bytes, at: int, number: int, kind: str, default: int) -> int:
    """A field of the flatbuffer table at ``at``; ``kind`` is its ``struct`` format."""
    fields = at - struct.unpack_from("<i", table, at)[0]
    slot = 4 + 2 * number
    if slot >= struct.unpack_from("<H", table, fields)[0]:
        return default
    offset = struct.unpack_from("<H", table, fields + slot)[0]
    return struct.unpack_from(kind, table, at + offset)[0] if offset else default


def messages(file: pa.NativeFile) -> Iterator[tuple[int, int, int, int]]:
    """``(kind, start, size, rows)`` of each message; bodies are skipped."""
    at = len(MAGIC) if file.read(len(MAGIC)) == MAGIC else 0
    while True:
        file.seek(at)
        head = file.read(8)
        if len(head) < 8:
            return
        mark, length = struct.unpack("<Ii", head)
        lead = 8
        if mark != CONTINUATION:
            # Before version 0.15 the length stood first.
            length, lead = mark, 4
        if not length:
            return
        file.seek(at + lead)
        table = file.read(length)
        root = struct.unpack_from("<I", table)[0]
        kind = _field(table, root, 1, "<B", 0)
        body = _field(table, root, 3, "<q", 0)
        rows = 0
        if kind == BATCH_HEADER:
            slot = 4 + 2 * 2
            fields = root - struct.unpack_from("<i", table, root)[0]
            header = root + struct.unpack_from("<H", table, fields + slot)[0]
            rows = _field(table, header + struct.unpack_from("<I", table, header)[0], 0, "<q", 0)
        yield kind, at, lead + length + body, rows
        at += lead + length + body


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the record batches of the listed shards stand."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            found, head = [], 0
            with _open(path) as file:
                for kind, start, size, rows in messages(file):
                    if kind == BATCH_HEADER:
                        found.append((start, size, rows))
                    elif found:
                        raise ValueError(f"{path}: dictionaries that change between batches are not read")
                    else:
                        head = start + size
            for k in range(0, len(found), 10_000):
                part = found[k:k + 10_000]
                yield pa.RecordBatch.from_pydict({
                    "path": [path] * len(part), "batch": list(range(k, k + len(part))), "head": [head] * len(part),
                    "start": [x[0] for x in part], "size": [x[1] for x in part], "_n": [x[2] for x in part],
                }, schema=pa.schema([("path", pa.string())] + [(c, pa.int64()) for c in NUMBERS]))


def _head(file: pa.NativeFile, stop: int) -> bytes:
    """Schema and dictionaries, as a stream begins."""
    file.seek(0)
    head = file.read(stop)
    return head[len(MAGIC):] if head.startswith(MAGIC) else head


def read(
    spark: SparkSession,
    path: str,
    columns: list[str] | None = None,
    glob: str = "*.arrow",
    rows: tuple[int, int] | None = None,
) -> DataFrame:
    """Rows of all shards below ``path`` with ``row_idx``, shards in name order."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path")
    first = listed.orderBy("path").first()
    if first is None:
        raise FileNotFoundError(f"no Arrow shard in {path!r}")
    with _open(first["path"]) as file:
        stop = next(start + size for kind, start, size, _ in messages(file) if kind == SCHEMA_HEADER)
        schema = pa.ipc.open_stream(pa.BufferReader(_head(file, stop))).schema
    names = columns or schema.names
    plain = pa.schema([
        f.with_type(f.type.value_type) if pa.types.is_dictionary(f.type) else f for f in map(schema.field, names)
    ])
    found = from_arrow_schema(plain, prefer_timestamp_ntz=True)
    wanted = to_arrow_schema(found, prefers_large_types=False)

    index = prefix_sums(listed.mapInArrow(_index, INDEX), "path", "batch")
    if rows is not None:
        start, stop = rows
        index = index.filter((F.col("_offset") < stop) & (F.col("_offset") + F.col("_n") > start))
    size = index.agg(F.sum("size")).first()[0] or 0
    index = index.repartitionByRange(max(1, -(-size // TASK_BYTES)), "path", "batch").sortWithinPartitions("path", "batch")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, file, head = None, None, b""
        for listed_batches in batches:
            for place in listed_batches.to_pylist():
                if place["path"] != at:
                    if file is not None:
                        file.close()
                    at, file = place["path"], _open(place["path"])
                    head = _head(file, place["head"])
                file.seek(place["start"])
                data = pa.ipc.open_stream(pa.BufferReader(head + file.read(place["size"]))).read_next_batch()
                place_of = pa.array(range(place["_offset"], place["_offset"] + data.num_rows), pa.int64())
                arrays = [data.column(data.schema.get_field_index(n)).cast(wanted.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays([place_of, *arrays], ["row_idx", *names])
        if file is not None:
            file.close()

    placed = StructType(StructType.fromDDL("row_idx BIGINT").fields + found.fields)
    out = index.select("path", "head", "start", "size", "_offset").mapInArrow(decode, placed)
    if rows is not None:
        out = out.filter((F.col("row_idx") >= rows[0]) & (F.col("row_idx") < rows[1]))
    return out

