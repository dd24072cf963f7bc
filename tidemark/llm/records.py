"""Token ids as length-delimited binary records, with a separate index of offsets: a data source to write, read and shuffle.

A record is framed as ``length (8 bytes) | masked checksum of the length (4) | payload | masked checksum of
the payload (4)``, all little-endian, so that a reader knows a damaged length before it trusts it. The payload
is ``flags (1) | id (8) | token ids``, two bytes each or four; bit 0 of the flags says that the id is null,
bit 1 that token ids have four bytes. The checksum is CRC-32, turned and shifted so that a checksum of data
that holds checksums is not one of them again.

Each task writes ``<name>.rec`` and beside it ``<name>.idx``, which has an entry of 32 bytes for each record:
id, offset, length of the payload, tokens of the file before it. Names hold the attempt, so a task that runs
twice disturbs nothing; ``manifest.json``, written last, lists the files that count, in order, with their
records and tokens. A path without a manifest holds nothing.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import slices, text_of

ENTRY = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u8"), ("start", "<u8")])
MANIFEST = "manifest.json"
#: Records that one reading task takes; larger files are split by their index.
SPLIT = 65_536
SCHEMA = "doc_id long, start long, n_tokens long, token_ids array<int>, ids_crc32 long, file string, entry long"
HEAD, TAIL, PREFIX = 12, 4, 9


class Damaged(ValueError):
    """A frame whose checksum does not hold."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join([size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))])


def payload_of(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return struct.pack("<Bq", (doc_id is None) | (width == 4) << 1, doc_id or 0) + ids.astype(f"<u{width}").tobytes()


def unframed(data: memoryview | bytes, at: int = 0) -> tuple[bytes, int]:
    """The payload of the frame at ``at``, and where the next one begins."""
    head = bytes(data[at : at + HEAD])
    if len(head) < HEAD or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise Damaged(f"length of the record at byte {at}")
    end = at + HEAD + struct.unpack("<Q", head[:8])[0]
    payload, tail = bytes(data[at + HEAD : end]), bytes(data[end : end + TAIL])
    if len(tail) < TAIL or struct.unpack("<I", tail)[0] != masked(payload):
        raise Damaged(f"payload of the record at byte {at}")
    return payload, end + TAIL


def tokens_of(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = struct.unpack_from("<Bq", payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=PREFIX)


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(path))


def manifest_of(path: str) -> list[dict]:
    store, base = _store(path)
    with store.open_input_stream(f"{base}/{MANIFEST}") as f:
        return json.loads(f.read())["files"]


def entries_of(store: pafs.FileSystem, base: str, name: str, first: int, count: int) -> np.ndarray:
    with store.open_input_file(f"{base}/{name}.idx") as f:
        return np.frombuffer(f.read_at(count * ENTRY.itemsize, first * ENTRY.itemsize), ENTRY)


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str
    records: int
    tokens: int


class Writer(DataSourceArrowWriter):
    """Writes rows of (doc_id, ids as little-endian binary of ``width`` bytes each) in the order they come."""

    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = _store(self.path)
        store.create_dir(base, recursive=True)
        partition = TaskContext.get().partitionId()
        name = f"part-{partition:06d}-{uuid.uuid4().hex}"
        records = tokens = offset = 0
        with store.open_output_stream(f"{base}/{name}.rec") as out, store.open_output_stream(f"{base}/{name}.idx") as index:
            for batch in iterator:
                parts, entries = [], np.zeros(batch.num_rows, ENTRY)
                for k, (doc_id, raw) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                    ids = np.frombuffer(raw, f"<u{self.width}")
                    frame = framed(payload_of(doc_id, ids, self.width))
                    entries[k] = (doc_id or 0, offset, len(frame) - HEAD - TAIL, tokens)
                    parts.append(frame)
                    offset, tokens = offset + len(frame), tokens + len(ids)
                out.write(b"".join(parts))
                index.write(entries.tobytes())
                records += batch.num_rows
        return Written(partition, name, records, tokens)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = _store(self.path)
        done = sorted((m for m in messages if m and m.records), key=lambda m: m.partition)
        for m in messages:
            if m and not m.records:
                for end in ("rec", "idx"):
                    store.delete_file(f"{base}/{m.name}.{end}")
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/{MANIFEST}") as f:
            f.write(json.dumps({"files": [{"name": m.name, "records": m.records, "tokens": m.tokens} for m in done]}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, base = _store(self.path)
        for m in filter(None, messages):
            for end in ("rec", "idx"):
                store.delete_file(f"{base}/{m.name}.{end}")


@dataclass
class Span(InputPartition):
    """Records ``first`` to ``first + count`` of a file; ``before``: tokens of all files before it."""

    name: str
    first: int
    count: int
    before: int


class Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], split: int):
        self.path, self.columns, self.split = path, columns, split

    def partitions(self) -> list[Span]:
        out, before = [], 0
        for f in manifest_of(self.path):
            out += [Span(f["name"], first, min(self.split, f["records"] - first), before) for first in range(0, f["records"], self.split)]
            before += f["tokens"]
        return out or [Span("", 0, 0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if not span.count:
            return
        store, base = _store(self.path)
        entries = entries_of(store, base, span.name, span.first, span.count)
        with store.open_input_file(f"{base}/{span.name}.rec") as f:
            yield from _rows(f, entries, span, self.columns)


def _rows(f: pa.NativeFile, entries: np.ndarray, span: Span, columns: list[str], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Frames that follow one another, read in stretches of about ``most`` bytes."""
    ends = (entries["offset"] + entries["length"]).astype(np.int64) + HEAD + TAIL
    k = 0
    while k < len(entries):
        at = int(entries["offset"][k])
        stop = max(k + 1, int(np.searchsorted(ends, at + most, "right")))
        data = memoryview(f.read_at(int(ends[stop - 1]) - at, at))
        found, place = [], 0
        for _ in range(k, stop):
            payload, place = unframed(data, place)
            found.append(tokens_of(payload))
        yield batch_of(found, entries["start"][k:stop].astype(np.int64) + span.before, span.name, np.arange(span.first + k, span.first + stop), columns)
        k = stop


def batch_of(found: list[tuple[int | None, np.ndarray]], starts: np.ndarray, name: str | list[str], entries: np.ndarray, columns: list[str]) -> pa.RecordBatch:
    sizes = np.array([len(ids) for _, ids in found], np.int64)
    made = {
        "doc_id": lambda: pa.array([d for d, _ in found], pa.int64()), "start": lambda: pa.array(starts, pa.int64()), "n_tokens": lambda: pa.array(sizes),
        "token_ids": lambda: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(np.concatenate([ids for _, ids in found]).astype(np.int32))),
        "ids_crc32": lambda: pa.array([zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in found], pa.int64()), "file": lambda: pa.array([name] * len(found) if isinstance(name, str) else name), "entry": lambda: pa.array(entries, pa.int64()),
    }
    return pa.RecordBatch.from_arrays([made[c]() for c in columns], names=columns)


class RecordSource(DataSource):
    """``path``: a folder that driver and executors share; ``width``: bytes of a token id when writing (2 or 4); ``split``: records of a reading task."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_records"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], int(self.options.get("width", 4)))

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema.fieldNames(), int(self.options.get("split", SPLIT)))


def write(encoded: DataFrame, path: str, width: int = 4) -> None:
    """Write ``encoded`` (doc_id long, ids binary) in its own order, partition after partition; ``path`` must be new."""
    spark = encoded.sparkSession
    spark.dataSource.register(RecordSource)
    encoded.select("doc_id", "ids").write.format(RecordSource.name()).option("path", path).option("width", width).mode("append").save()


def read(spark: SparkSession, path: str, columns: list[str] | None = None, split: int = SPLIT) -> DataFrame:
    """All records, or these ``columns`` of ``SCHEMA``; every checksum is tested, and a damaged record ends the job."""
    spark.dataSource.register(RecordSource)
    wanted = SCHEMA if columns is None else ", ".join(c for c in SCHEMA.split(", ") if c.split(" ")[0] in columns)
    return spark.read.format(RecordSource.name()).schema(wanted).option("split", split).load(path)


def index(spark: SparkSession, path: str) -> DataFrame:
    """The entries of the index alone: ``file``, ``entry``, ``offset``, ``length``, ``start`` (over all files)."""
    files, before = [], 0
    for f in manifest_of(path):
        files.append((f["name"], f["records"], before))
        before += f["tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(path)
        for batch in batches:
            for name, records, earlier in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for first in range(0, records, SPLIT):
                    e = entries_of(store, base, name, first, min(SPLIT, records - first))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(e)), pa.array(np.arange(first, first + len(e))), *[pa.array(e[c].astype(np.int64)) for c in ("offset", "length")], pa.array(e["start"].astype(np.int64) + earlier)], names=["file", "entry", "offset", "length", "start"])

    table = spark.createDataFrame(files, "file string, records long, before long").repartition(max(1, len(files)), "file")
    return table.mapInArrow(run, "file string, entry long, offset long, length long, start long")


def fetch(places: DataFrame, path: str) -> DataFrame:
    """The records at ``places`` (rows of ``index``), in the order of the rows, each by one read of its own bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(path)
        files: dict[str, pa.NativeFile] = {}
        columns = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            names, entries, offsets, lengths, starts = (batch.column(c).to_pylist() for c in ("file", "entry", "offset", "length", "start"))
            for k in range(0, len(names), 256):
                found = []
                for name, offset, length in zip(names[k : k + 256], offsets[k : k + 256], lengths[k : k + 256], strict=True):
                    if name not in files:
                        files[name] = store.open_input_file(f"{base}/{name}.rec")
                    found.append(tokens_of(unframed(files[name].read_at(HEAD + length + TAIL, offset))[0]))
                yield batch_of(found, np.array(starts[k : k + 256]), names[k : k + 256], np.array(entries[k : k + 256]), columns)
        for f in files.values():
            f.close()

    return places.select("file", "entry", "offset", "length", "start").mapInArrow(run, SCHEMA)


def shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """All records in a random order that ``seed`` settles: only the index is sorted, records are read where they lie."""
    keyed = index(spark, path).withColumn("key", F.xxhash64(F.lit(seed), "file", "entry"))
    return fetch(keyed.repartitionByRange("key").sortWithinPartitions("key"), path)


def encode(docs: DataFrame, path: str, end: int | None = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (little-endian, two bytes each where the vocabulary allows) of every row, in the order of ``doc_id``.

    ``path``: a vocabulary with word ends in the tokenizers format, present on every executor; ``end`` is
    appended to each text's ids. A null or empty text has that one id alone. Null ids come last; rows that
    share an id follow each other in the order of the input, and may lie in several partitions.
    """
    from .units import word_coder, word_table

    width = width_of(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, table = word_coder(path)
        for part in slices(batches):
            ids = word_table([x.decode("utf-8", "replace") for x in part.column(1).to_pylist()], coder, table)
            if end is not None:
                ids = [np.append(x, end) for x in ids]
            raw = np.concatenate(ids).astype(f"<u{width}") if ids else np.zeros(0, f"<u{width}")
            offsets = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32) * width
            yield pa.RecordBatch.from_arrays([part.column(0), pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])], names=["doc_id", "ids"])

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(docs, text).cast("binary").alias("text"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_last(), "row").sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "row")
    return ordered.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def width_of(path: str) -> int:
    from .units import spec_of

    spec = spec_of(path)
    return 2 if max([*spec["model"]["vocab"].values(), *[x["id"] for x in spec["added_tokens"]]]) < 1 << 16 else 4
