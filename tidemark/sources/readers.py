"""Listings, logs, manifests, pack indexes and catalog snapshots as tables."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import wal

MANIFEST = "files MAP<STRING, STRUCT<size: BIGINT, mode: BIGINT, mtime: DOUBLE, kind: STRING, chunks: ARRAY<STRUCT<offset: BIGINT, len: BIGINT, hash: STRING>>>>"


def listing(spark: SparkSession, path: str) -> DataFrame:
    """``key``, ``size``, ``mtime`` of all files below a path or bucket (SC12, SC14); contents are never read."""
    root = path.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    return files.select(F.substring_index("path", root.split(":")[-1].lstrip("/") + "/", -1).alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def archive(spark: SparkSession, *paths: str) -> DataFrame:
    """Distinct segments of an archive and its previous locations (SC1, S2)."""
    found = wal.union_all([listing(spark, p).select(F.element_at(F.split("key", "/"), -1).alias("name")) for p in paths])
    return wal.segments_of_names(found)


def dumped_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of dumped log files (SC2, SC4): a record belongs to the segment that owns its position; overlapping windows repeat none."""
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    return distinct_events(wal.parse_lines(lines))


def distinct_events(events: DataFrame) -> DataFrame:
    return events.dropDuplicates([c for c in ("tli", "lsn", "kind") if c in events.columns])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [zlib.decompress(x) if x[:1] == b"\x78" else x for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["path", "content"])


def manifests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Files and chunks of manifests (SC6), one JSON document in each file, plain or as a zlib stream; its folder (``<id>`` or ``set_id=<id>``) names the set."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(_unpacked, "path string, content binary")
    docs = found.select(F.regexp_extract("path", r"([^/=]+)/[^/]+$", 1).alias("set_id"), F.explode(F.from_json(F.decode("content", "UTF-8"), MANIFEST)["files"]).alias("rel", "f"))
    return docs.select("set_id", "rel", "f.size", "f.mode", "f.mtime", "f.kind"), docs.select("set_id", "rel", F.explode("f.chunks").alias("c")).select("set_id", "rel", "c.*")


def chunk_index(records: DataFrame) -> DataFrame:
    """One place for each hash (SC7): of repeated ones the first by location and pack."""
    return records.groupBy("hash").agg(F.min(F.struct("location", "pack", "offset", "len")).alias("x")).select("hash", "x.*")


def catalog_snapshot(classes: DataFrame, namespaces: DataFrame, indexes: DataFrame, inherits: DataFrame) -> DataFrame:
    """Relations of a system catalog (SC8): with their schema, and what they index or are a partition of."""
    return (
        classes.join(namespaces.withColumnsRenamed({"oid": "relnamespace", "nspname": "schema"}), "relnamespace").join(indexes.select(F.col("indexrelid").alias("oid"), F.col("indrelid").alias("index_of")), "oid", "left")
        .join(inherits.select(F.col("inhrelid").alias("oid"), F.col("inhparent").alias("parent")), "oid", "left").select("oid", "schema", "name", "kind", "size", "index_of", "parent")
    )


def sparse_files(files: DataFrame, databases: list[int], system: list[int]) -> DataFrame:
    """Files that a restore of some databases needs (F11): of other databases only the version and the map."""
    base = F.regexp_extract("rel", r"^base/(\d+)/", 1)
    space = F.regexp_extract("rel", r"^pg_tblspc/\d+/[^/]+/(\d+)/", 1)
    db = F.when(base != "", base).when(space != "", space)
    wanted = db.isNull() | db.isin([str(x) for x in [*databases, *system]]) | ((base != "") & F.col("rel").rlike(r"/(PG_VERSION|pg_filenode\.map)$"))
    return files.filter(wanted)


def standalone(endpoints: DataFrame, clusters: DataFrame) -> DataFrame:
    """Found servers whose host is in no known cluster."""
    return endpoints.join(clusters.select("host").distinct(), "host", "left_anti")


def tool_mismatch(servers: DataFrame, tools: DataFrame) -> DataFrame:
    """Nodes whose tools are of another major than their server (X15): older tools cannot read it, newer ones mostly can."""
    both = servers.join(tools, "node_id")
    code = F.when(F.col("tool_major") < F.col("server_major"), "tool_older").when(F.col("tool_major") > F.col("server_major"), "tool_newer")
    return both.select("node_id", code.alias("code"), F.when(code == "tool_older", "critical").otherwise("warning").alias("severity")).filter("code IS NOT NULL")


def base_changed(sets: DataFrame) -> DataFrame:
    """Sets whose checksum flag or segment size is not their base's (X11); what either does not say is no change."""
    differ = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(False))
    return sets.select("id", (differ("checksums", "base_checksums") | differ("segment", "base_segment")).alias("changed"))


def retired_branch(segments: DataFrame, tails: DataFrame) -> DataFrame:
    """Segments of a tail's range (X14): what filing a dead branch away would move."""
    return segments.distinct().join(tails.select("tli", F.col("first").alias("a"), F.col("last").alias("b")), "tli").filter("segno BETWEEN a AND b").select("tli", "segno")


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Distinct keys in the order they came (S3): the first of each stays."""
    rest = [c for c in rows.columns if c not in [*keys, *order]]
    return rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("x")).select(*keys, "x.*")


def strip(sets: DataFrame, start: int, end: int) -> DataFrame:
    """Sets on a time axis from 0 to 1."""
    return sets.filter(F.col("started").between(start, end)).select("id", F.round((F.col("started") - start) / (end - start), 6).alias("position"))


def key_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of either side and on which they are (S1): left, right or both."""
    both = a.select("key").distinct().withColumn("l", F.lit(True)).join(b.select("key").distinct().withColumn("r", F.lit(True)), "key", "full_outer")
    return both.select("key", F.when(F.col("r").isNull(), "left").when(F.col("l").isNull(), "right").otherwise("both").alias("side"))


def size_sums(databases: DataFrame) -> DataFrame:
    """Bytes of each node's databases (G10); a node with none has no row."""
    return databases.groupBy("node_id").agg(F.sum("size").alias("bytes")).filter("bytes > 0")
