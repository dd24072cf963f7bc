"""Readers over files."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.sources import packs, readers


def test_listing_and_archive(spark, tmp_path):
    for name in ("00000001000000000000000A", "00000001000000000000000B.zst", ".hidden", "00000001000000000000000C.partial", "00000002.history", "sub/00000002000000000000000B.gz"):
        file = tmp_path / "wal" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(b"x" * len(name))
    found = {r.key: r["size"] for r in readers.listing(spark, str(tmp_path / "wal")).collect()}
    assert found["sub/00000002000000000000000B.gz"] == 31 and "00000002.history" in found
    assert sorted((r.tli, r.segno) for r in readers.archive(spark, str(tmp_path / "wal"), str(tmp_path / "wal" / "sub")).collect()) == [(1, 10), (1, 11), (2, 11)]


def test_manifests(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    (tmp_path / "s1" / "manifest.json").write_text(json.dumps({"files": {"base/5/1": {"size": 3, "mode": 1, "mtime": 2.0, "kind": "pages", "chunks": [{"offset": 0, "len": 3, "hash": "ab"}]}, "PG_VERSION": {"size": 2, "kind": "whole", "chunks": []}}}, indent=1))
    files, chunks = readers.manifests(spark, str(tmp_path / "*" / "manifest.json"))
    assert sorted((r.set_id, r.rel, r["size"]) for r in files.collect()) == [("s1", "PG_VERSION", 2), ("s1", "base/5/1", 3)]
    assert [(r.rel, r.hash) for r in chunks.collect()] == [("base/5/1", "ab")]


def test_compressed_manifest(spark, tmp_path):
    (tmp_path / "set_id=s2").mkdir()
    (tmp_path / "set_id=s2" / "manifest").write_bytes(zlib.compress(json.dumps({"files": {"a": {"size": 3, "mode": 384, "kind": "whole", "chunks": []}}}).encode()))
    files, chunks = readers.manifests(spark, str(tmp_path))
    assert [(r.set_id, r.rel, r["size"], r["mode"], r.mtime) for r in files.collect()] == [("s2", "a", 3, 384, None)] and chunks.isEmpty()


INDEX, PACK = b"INDEX--1", b"PACK---1"


def _pack(chunks: list[tuple[bytes, bytes]], end: bytes = b"") -> bytes:
    return PACK + struct.pack("<II", 2, 0) + b"".join(h + struct.pack("<I", len(x)) + x for h, x in chunks) + end


def test_packs_with_and_without_index(spark, tmp_path):
    h = [bytes([k]) * 31 + b"\0" for k in (9, 200, 3)]
    records = spark.createDataFrame([("p1", bytearray(h[0]), 900, 5), ("p1", bytearray(h[1]), 16 + 36, 2**32 - 1), ("p2", bytearray(h[0]), 2**40, 5)], "pack string, hash binary, offset long, len long")
    assert packs.write_indexes(records, str(tmp_path), INDEX) == 3
    raw = (tmp_path / "p1.idx").read_bytes()
    assert raw == INDEX + struct.pack("<II", 2, 2) + struct.pack("<32sQI", h[0], 900, 5) + struct.pack("<32sQI", h[1], 52, 2**32 - 1)
    (tmp_path / "p1.pack").write_bytes(_pack([(h[2], b"not read, as there is an index")]))
    (tmp_path / "p3.pack").write_bytes(_pack([(h[2], b"abc"), (h[0], b"defgh")], end=h[1] + struct.pack("<I", 50) + b"cut off"))
    (tmp_path / "p4.pack").write_bytes(b"something else")
    (tmp_path / "p5.pack").write_bytes(_pack([]))
    found = packs.chunk_records(spark, str(tmp_path), INDEX, PACK)
    assert sorted((r.pack, bytes(r.hash), r.offset, r.len) for r in found.collect()) == [("p1", h[0], 900, 5), ("p1", h[1], 52, 2**32 - 1), ("p2", h[0], 2**40, 5), ("p3", h[2], 52, 3), ("p3", h[0], 91, 5)]
    index = {bytes(r.hash): (r.pack, r.offset) for r in readers.chunk_index(found.withColumn("location", F.lit(0))).collect()}
    assert index == {h[0]: ("p1", 900), h[1]: ("p1", 52), h[2]: ("p3", 52)}


def test_damaged_index(spark, tmp_path):
    (tmp_path / "p1.idx").write_bytes(INDEX + struct.pack("<II", 2, 2) + struct.pack("<32sQI", b"a" * 32, 16, 5))
    with pytest.raises(Exception, match="cut off"):
        packs.index_records(spark, str(tmp_path), INDEX).collect()


def test_dumped_events(spark, tmp_path):
    line = "rmgr: Transaction len: 1, tx: 7, lsn: 0/A, desc: COMMIT 2024-01-01 00:00:00 UTC; rels: base/5/1"
    (tmp_path / "a.txt").write_text(f"{line}\nrmgr: Heap x\n")
    (tmp_path / "b.txt").write_text(f"{line}\n")
    assert readers.dumped_events(spark, str(tmp_path)).count() == 1
