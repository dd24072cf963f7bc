"""Catalog snapshots, indexes, filters and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import steps, wal
from ..sources import packs, readers
from . import testbed as T


def sc2_distinct_events(spark: SparkSession, d: str) -> DataFrame:
    ev = T.table(spark, d, "events").select((F.col("user_id") % 3).alias("tli"), (F.col("event_id") % 4000).alias("lsn"), F.when(F.col("event_id") % 4000 % 2 == 0, "DROP").otherwise("CREATE").alias("kind"))
    return readers.distinct_events(ev)


def sc7_chunk_index(spark: SparkSession, d: str) -> DataFrame:
    li = T.table(spark, d, "lineitem")
    return readers.chunk_index(li.select((F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("hash"), (F.col("l_orderkey") % 3).alias("location"), F.col("l_suppkey").alias("pack"), F.col("l_orderkey").alias("offset"), F.col("l_quantity").cast("long").alias("len"))).withColumnRenamed("offset", "at_offset")


#: The magic of the indexes that the query writes.
INDEX_MAGIC = b"TIDEINDX"


def sc7_pack_records(spark: SparkSession, d: str) -> DataFrame:
    """Index files of fixed-width records, one for each pack, written and read again; of a hash stored twice the first pack's place counts."""
    li = T.table(spark, d, "lineitem")
    records = li.select(
        F.lpad(F.col("l_suppkey").cast("string"), 8, "0").alias("pack"), F.unhex(F.sha2((F.col("l_partkey") * 10 + F.col("l_linenumber")).cast("string"), 256)).alias("hash"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("offset"), F.col("l_quantity").cast("long").alias("len"),
    )
    path = f"{steps.shared_dir(spark)}/packs-{uuid.uuid4().hex}"
    packs.write_indexes(records, path, INDEX_MAGIC)
    found = readers.chunk_index(packs.index_records(spark, path, INDEX_MAGIC).withColumn("location", F.lit(0)))
    return found.select(F.lower(F.hex("hash")).alias("hash"), "pack", F.col("offset").alias("at_offset"), "len")


def sc6_manifest_files(spark: SparkSession, d: str) -> DataFrame:
    """Parts as the files of 50 sets: a document for each set, written as text and read as manifests."""
    k = F.col("p_partkey")
    file = F.struct(T.cents("p_retailprice").alias("size"), F.when(k % 4 > 0, F.lit(384) + k % 2).alias("mode"), (k * 0.5).alias("mtime"), F.when(k % 3 == 0, "whole").otherwise("pages").alias("kind"), F.transform(F.sequence(F.lit(0), k % 3), lambda i: F.struct((i * 65536).alias("offset"), (k % 100 + i).alias("len"), F.md5(k.cast("string")).alias("hash"))).alias("chunks"))
    docs = T.table(spark, d, "part").groupBy((k % 50).alias("set_id")).agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("base/5/"), k.cast("string")), file))).alias("files"))).alias("value"))
    path = f"{steps.shared_dir(spark)}/manifests-{uuid.uuid4().hex}"
    docs.repartition("set_id").write.partitionBy("set_id").text(path)
    files, chunks = readers.manifests(spark, path)
    return files.join(chunks.groupBy("set_id", "rel").agg(F.count("*").alias("chunks"), F.sum("len").alias("bytes"), F.max("offset").alias("last_offset"), F.min("hash").alias("hash")), ["set_id", "rel"])


def sc12_folder_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Parts written as text files of 40 folders, and the folders' bytes from their listing alone (SC12, SC14)."""
    path = f"{steps.shared_dir(spark)}/walk-{uuid.uuid4().hex}"
    T.table(spark, d, "part").select((F.col("p_partkey") % 40).alias("folder"), "p_name").repartition("folder").write.partitionBy("folder").text(path)
    files = readers.listing(spark, path)
    return files.groupBy(F.regexp_extract("key", r"^folder=(\d+)/[^/]+$", 1).cast("long").alias("folder")).agg(F.sum("size").alias("bytes"), F.count_if(F.col("mtime").isNull()).alias("undated"))


def sc8_catalog_snapshot(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    p = T.table(spark, d, "part")
    classes = p.select(k.alias("oid"), (k % 7).alias("relnamespace"), F.col("p_name").alias("name"), F.when(k % 5 == 1, "i").otherwise("r").alias("kind"), T.cents("p_retailprice").alias("size"))
    spaces = spark.range(6).select(F.col("id").alias("oid"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("nspname"))
    return readers.catalog_snapshot(classes, spaces, p.filter("p_partkey % 5 = 1").select(k.alias("indexrelid"), (k - 1).alias("indrelid")), p.filter("p_partkey % 10 = 7").select(k.alias("inhrelid"), (k - 7).alias("inhparent")))


def f11_sparse_files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 6 == 0, "PG_VERSION").otherwise(k.cast("string"))
    rel = F.when(k % 3 == 0, F.concat(F.lit("base/"), (k % 8).cast("string"), F.lit("/"), name)).when(k % 3 == 1, F.concat(F.lit("pg_tblspc/16/PG_16/"), (k % 8).cast("string"), F.lit("/"), name)).otherwise(F.concat(F.lit("global/"), name))
    return readers.sparse_files(T.table(spark, d, "part").select(rel.alias("rel")), [3], [1, 5])


def x18_standalone(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return readers.standalone(T.table(spark, d, "customer").select(k.alias("port"), F.concat(F.lit("h"), (k % 300).cast("string")).alias("host")), T.table(spark, d, "supplier").select(F.concat(F.lit("h"), (F.col("s_suppkey") * 2).cast("string")).alias("host")))


def x15_tool_mismatch(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = T.table(spark, d, "customer")
    return readers.tool_mismatch(c.select(k.alias("node_id"), (k % 5 + 12).alias("server_major")), c.filter("c_custkey % 4 <> 0").select(k.alias("node_id"), (k % 6 + 12).alias("tool_major")))


def x11_base_changed(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return readers.base_changed(T.table(spark, d, "orders").select(k.alias("id"), (k % 2 == 0).alias("checksums"), F.when(k % 3 == 0, k % 4 == 0).alias("base_checksums"), (k % 5).alias("segment"), F.when(k % 7 == 0, k % 6).alias("base_segment")))


def x14_retired_branch(spark: SparkSession, d: str) -> DataFrame:
    return readers.retired_branch(T.segments(spark, d), wal.branch_tails(T.segments(spark, d), T.history(spark)))


def s1_key_differences(spark: SparkSession, d: str) -> DataFrame:
    o = T.table(spark, d, "orders")
    return readers.key_differences(o.filter("o_orderkey % 3 <> 0").select((F.col("o_orderkey") % 5000).alias("key")), o.filter("o_orderkey % 4 = 0").select((F.col("o_orderkey") % 6000).alias("key")))


def s3_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return readers.first_seen(T.table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])


def w20_strip(spark: SparkSession, d: str) -> DataFrame:
    return readers.strip(T.backup_sets(spark, d), 10_000 * 86400, 10_800 * 86400)


def g10_size_sums(spark: SparkSession, d: str) -> DataFrame:
    o = T.table(spark, d, "orders")
    return readers.size_sums(o.select(F.col("o_custkey").alias("node_id"), F.when(F.col("o_orderkey") % 2 == 0, T.cents("o_totalprice")).otherwise(0).alias("size")))


SQL = {
    "sc12_folder_sizes": "SELECT p_partkey % 40 AS folder, CAST(sum(strlen(p_name) + 1) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS undated FROM part GROUP BY 1",
    "sc2_distinct_events": "SELECT DISTINCT user_id % 3 AS tli, event_id % 4000 AS lsn, CASE WHEN event_id % 4000 % 2 = 0 THEN 'DROP' ELSE 'CREATE' END AS kind FROM events",
    "sc7_chunk_index": "SELECT hash, x.location, x.pack, x.at_offset, x.len FROM (SELECT l_partkey * 10 + l_linenumber AS hash, min({'location': l_orderkey % 3, 'pack': l_suppkey, 'at_offset': l_orderkey, 'len': CAST(l_quantity AS BIGINT)}) AS x FROM lineitem GROUP BY 1)",
    "sc7_pack_records": "SELECT hash, x.pack, x.at_offset, x.len FROM (SELECT sha256(CAST(l_partkey * 10 + l_linenumber AS VARCHAR)) AS hash, min({'pack': lpad(CAST(l_suppkey AS VARCHAR), 8, '0'), 'at_offset': l_orderkey * 10 + l_linenumber, 'len': CAST(l_quantity AS BIGINT)}) AS x FROM lineitem GROUP BY 1)",
    "sc6_manifest_files": "SELECT CAST(p_partkey % 50 AS VARCHAR) AS set_id, 'base/5/' || CAST(p_partkey AS VARCHAR) AS rel, CAST(round(p_retailprice * 100) AS BIGINT) AS size, CASE WHEN p_partkey % 4 > 0 THEN 384 + p_partkey % 2 END AS mode, CAST(p_partkey AS DOUBLE) / 2 AS mtime, CASE WHEN p_partkey % 3 = 0 THEN 'whole' ELSE 'pages' END AS kind, p_partkey % 3 + 1 AS chunks, (p_partkey % 3 + 1) * (p_partkey % 100) + (p_partkey % 3) * (p_partkey % 3 + 1) // 2 AS bytes, 65536 * (p_partkey % 3) AS last_offset, md5(CAST(p_partkey AS VARCHAR)) AS hash FROM part",
    "sc8_catalog_snapshot": "SELECT p_partkey AS oid, 's' || CAST(p_partkey % 7 AS VARCHAR) AS schema, p_name AS name, CASE WHEN p_partkey % 5 = 1 THEN 'i' ELSE 'r' END AS kind, CAST(round(p_retailprice * 100) AS BIGINT) AS size, CASE WHEN p_partkey % 5 = 1 THEN p_partkey - 1 END AS index_of, CASE WHEN p_partkey % 10 = 7 THEN p_partkey - 7 END AS parent FROM part WHERE p_partkey % 7 < 6",
    "f11_sparse_files": """WITH f AS (SELECT p_partkey % 8 AS db, p_partkey % 3 AS t, CASE WHEN p_partkey % 6 = 0 THEN 'PG_VERSION' ELSE CAST(p_partkey AS VARCHAR) END AS n FROM part)
 SELECT CASE t WHEN 0 THEN 'base/' || CAST(db AS VARCHAR) || '/' WHEN 1 THEN 'pg_tblspc/16/PG_16/' || CAST(db AS VARCHAR) || '/' ELSE 'global/' END || n AS rel FROM f WHERE t = 2 OR db IN (1, 3, 5) OR t = 0 AND n = 'PG_VERSION'""",
    "x18_standalone": "SELECT c_custkey AS port, 'h' || CAST(c_custkey % 300 AS VARCHAR) AS host FROM customer WHERE c_custkey % 300 NOT IN (SELECT s_suppkey * 2 FROM supplier)",
    "x15_tool_mismatch": "WITH b AS (SELECT c_custkey AS k, c_custkey % 5 AS s, c_custkey % 6 AS t FROM customer WHERE c_custkey % 4 <> 0) SELECT k AS node_id, CASE WHEN t < s THEN 'tool_older' ELSE 'tool_newer' END AS code, CASE WHEN t < s THEN 'critical' ELSE 'warning' END AS severity FROM b WHERE s <> t",
    "x11_base_changed": "SELECT o_orderkey AS id, o_orderkey % 3 = 0 AND (o_orderkey % 2 = 0) <> (o_orderkey % 4 = 0) OR o_orderkey % 7 = 0 AND o_orderkey % 5 <> o_orderkey % 6 AS changed FROM orders",
    "x14_retired_branch": f"WITH {T.SEGMENTS}, {T.HISTORY}, e AS (SELECT ancestor AS tli, max(end_lsn) AS fork FROM history GROUP BY 1) SELECT s.tli, segno FROM segments s JOIN e USING (tli) WHERE segno * {T.SEGMENT} > fork",
    "s1_key_differences": "WITH a AS (SELECT DISTINCT o_orderkey % 5000 AS key FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT DISTINCT o_orderkey % 6000 AS key FROM orders WHERE o_orderkey % 4 = 0) SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'left' WHEN a.key IS NULL THEN 'right' ELSE 'both' END AS side FROM a FULL JOIN b ON a.key = b.key",
    "s3_first_seen": "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY 1",
    "w20_strip": f"WITH {T.SETS} SELECT id, round((started - {10_000 * 86400}) / {800 * 86400}, 6) AS position FROM sets WHERE started BETWEEN {10_000 * 86400} AND {10_800 * 86400}",
    "g10_size_sums": "SELECT o_custkey AS node_id, CAST(sum(CASE WHEN o_orderkey % 2 = 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS bytes FROM orders GROUP BY 1 HAVING bytes > 0",
}
QUERIES = {name: globals()[name] for name in SQL}
