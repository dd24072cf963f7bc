"""Packs of chunks and their indexes: files of fixed-width records (SC7).

An index has a header (magic, format, number of records) and records of hash, offset and length,
little-endian, in the order of hashes. A pack has a header too, and before each chunk its hash and length.
The magic strings are parameters. The format bounds a pack, and so its index; there may be any number of them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format.
HEADER = np.dtype([("magic", "V8"), ("format", "<u4"), ("records", "<u4")])
ENTRY = np.dtype([("hash", "V32"), ("offset", "<u8"), ("len", "<u4")])
FRAME = np.dtype([("hash", "V32"), ("len", "<u4")])
FORMAT = 2
RECORDS = "pack string, hash binary, offset long, len long"


class DamagedIndex(ValueError):
    """An index of another kind, or one that is cut off."""


def entries_of(data: bytes, magic: bytes, name: str = "") -> np.ndarray:
    """The records of one index."""
    head = np.frombuffer(data[: HEADER.itemsize].ljust(HEADER.itemsize, b"\0"), HEADER)[0]
    if head["magic"].tobytes() != magic or len(data) != HEADER.itemsize + int(head["records"]) * ENTRY.itemsize:
        raise DamagedIndex(f"{name}: not an index, or cut off; leave it out and its pack is read instead")
    return np.frombuffer(data, ENTRY, offset=HEADER.itemsize)


def frames_of(file: pa.NativeFile, magic: bytes) -> np.ndarray:
    """The records of one pack, from the frames of its chunks alone; the first that does not fit ends it."""
    size, at, found = file.size(), HEADER.itemsize, []
    if file.read(8) != magic:
        return np.zeros(0, ENTRY)
    while at + FRAME.itemsize <= size:
        frame = np.frombuffer(file.read_at(FRAME.itemsize, at), FRAME)[0]
        at += FRAME.itemsize
        if not frame["len"] or at + int(frame["len"]) > size:
            break
        found.append((frame["hash"], at, frame["len"]))
        at += int(frame["len"])
    return np.array(found, ENTRY)


def _stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def _batch(pack: str, entries: np.ndarray) -> pa.RecordBatch:
    hashes = pa.Array.from_buffers(pa.binary(32), len(entries), [None, pa.py_buffer(entries["hash"].tobytes())]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([pack] * len(entries), pa.string()), hashes, *[pa.array(entries[c].astype(np.int64)) for c in ("offset", "len")]], names=["pack", "hash", "offset", "len"])


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """``file:/a`` is how Spark writes a local path."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path)) if ":" in path else (pafs.LocalFileSystem(), path)


def _files(spark: SparkSession, path: str, ending: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{ending}").load(path)


def index_records(spark: SparkSession, path: str, magic: bytes) -> DataFrame:
    """``RECORDS`` of all indexes (``<pack>.idx``) below ``path``; a damaged one ends the job. No index, no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(*batch.columns, strict=True):
                yield _batch(_stem(name.as_py()), entries_of(data.as_py(), magic, name.as_py()))

    return _files(spark, path, "idx").select("path", "content").mapInArrow(run, RECORDS)


def pack_records(packs: DataFrame, magic: bytes) -> DataFrame:
    """``RECORDS`` of the packs at the paths of ``packs``, read from their frames; chunks are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, at = _store(name)
                with store.open_input_file(at) as file:
                    yield _batch(_stem(name), frames_of(file, magic))

    return packs.select("path").mapInArrow(run, RECORDS)


def chunk_records(spark: SparkSession, path: str, index_magic: bytes, pack_magic: bytes) -> DataFrame:
    """Records of every pack below ``path``: by its index, or from its content where it has none."""
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("pack")
    bare = _files(spark, path, "pack").select("path", stem).join(_files(spark, path, "idx").select(stem), "pack", "left_anti")
    return index_records(spark, path, index_magic).unionByName(pack_records(bare, pack_magic))


def write_indexes(records: DataFrame, path: str, magic: bytes) -> int:
    """One index for each pack of ``records`` (pack, hash, offset, len) below ``path``; how many records there are.

    A group is a pack, which the format bounds. A file gets its name when it is whole, so that a task may run again.
    """

    def one(table: pa.Table) -> pa.Table:
        store, base = _store(path)
        store.create_dir(base, recursive=True)
        pack = table["pack"][0].as_py()
        entries = np.zeros(table.num_rows, ENTRY)
        raw = b"".join(table["hash"].to_pylist())
        if len(raw) != 32 * table.num_rows:
            raise ValueError(f"{pack}: a hash has 32 bytes")
        entries["hash"], entries["offset"], entries["len"] = np.frombuffer(raw, "V32"), table["offset"].to_numpy(), table["len"].to_numpy()
        entries = entries[np.argsort(np.frombuffer(raw, "S32"), kind="stable")]
        head = np.array([(np.void(magic), FORMAT, len(entries))], HEADER)
        own = f"{base}/{pack}.{uuid.uuid4().hex}"
        with store.open_output_stream(own) as out:
            out.write(head.tobytes() + entries.tobytes())
        store.move(own, f"{base}/{pack}.idx")
        return pa.table({"records": [len(entries)]})

    written = records.select("pack", "hash", F.col("offset").cast("long"), F.col("len").cast("long")).groupBy("pack").applyInArrow(one, "records long")
    return written.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
