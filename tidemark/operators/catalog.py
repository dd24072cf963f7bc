"""Catalog analytics: footprints, roll-ups, searches and fingerprints.

``relations(oid, schema, name, kind, size, toast, index_of, parent)``; kinds are r, p, i, t, m and so on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import tops


def footprints(relations: DataFrame) -> DataFrame:
    """Bytes of each table with its indexes, its overflow table and its partitions."""
    overflow = relations.filter("toast IS NOT NULL").select(F.col("toast").alias("oid"), F.col("oid").alias("of_table"))
    up = relations.join(overflow, "oid", "left").select(F.col("oid").alias("node"), F.coalesce("index_of", "of_table", "parent").alias("up"))
    hung = tops(up.filter("up IS NOT NULL"))
    top = up.join(hung, "node", "left").filter("up IS NULL OR top IS NOT NULL").select(F.col("node").alias("oid"), F.coalesce("top", "node").alias("root"))
    own = relations.select(F.col("oid").alias("root"), "name", F.col("size").alias("own_bytes"))
    return top.join(relations.select("oid", "size"), "oid").groupBy("root").agg(F.sum("size").alias("bytes"), F.count("*").alias("parts")).join(own, "root").select(F.col("root").alias("oid"), "name", "own_bytes", "bytes", "parts")


def roll_up(relations: DataFrame) -> DataFrame:
    """Per database and schema (null for all): tables, materialised views, schemas and bytes."""
    figures = [F.count_if(F.col("kind").isin("r", "p")).alias("tables"), F.count_if(F.col("kind") == "m").alias("matviews"), F.countDistinct("schema").alias("schemas"), F.sum("size").alias("bytes")]
    return relations.rollup("db", "schema").agg(*figures, F.grouping("schema").alias("total")).filter("db IS NOT NULL").drop("total")


def search(relations: DataFrame, text: str) -> DataFrame:
    """Tables whose schema or name has ``text``, or one of whose partitions has."""
    low = text.lower()
    hit = F.lower("name").contains(low) | F.lower("schema").contains(low)
    by_part = relations.filter(F.col("parent").isNotNull() & hit).select(F.col("parent").alias("oid")).distinct().withColumn("part", F.lit(True))
    return relations.filter("parent IS NULL").join(by_part, "oid", "left").filter(hit | F.col("part")).select("oid", "schema", "name", F.coalesce("part", F.lit(False)).alias("by_partition"))


def largest(relations: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest, and whether there were more (L2)."""
    total = relations.agg(F.count("*").alias("all"))
    return relations.orderBy(F.desc("size"), "oid").limit(n).join(F.broadcast(total)).withColumn("truncated", F.col("all") > n).drop("all")


def page_digest(pages: DataFrame) -> DataFrame:
    """Per object the md5 of its pages' md5s in their order (G19); an object's pages are bounded by its format."""
    return pages.groupBy("object").agg(F.sort_array(F.collect_list(F.struct("page_no", F.md5("data").alias("m")))).alias("p")).select("object", F.md5(F.array_join(F.transform("p", lambda x: x["m"]), "")).alias("digest"))


def table_fingerprint(rows: DataFrame, buckets: int = 4096) -> DataFrame:
    """One row: md5 over all rows whatever their order, and their count.

    Rows (``body``) are dealt out by the first hex digits of their md5; each bucket's sorted md5s are
    digested apart, then the buckets' digests. The number of buckets is part of the definition. A bucket
    is sorted by Spark and streamed through its digest, so that none is ever held whole.
    """
    digits = len(f"{buckets - 1:x}")
    each = rows.select(F.md5(F.coalesce("body", F.lit(""))).alias("m")).select(F.substring("m", 1, digits).alias("b"), "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, n, out = None, None, 0, []
        for batch in batches:
            for name, part in groupby(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), key=lambda x: x[0]):
                if name != now:
                    out += [(now, state.hexdigest(), n)] if n else []
                    now, state, n = name, hashlib.md5(), 0
                hashes = [x[1] for x in part]
                state.update("".join(hashes).encode())
                n += len(hashes)
        out += [(now, state.hexdigest(), n)] if n else []
        yield pa.RecordBatch.from_pylist([dict(zip("bmn", x, strict=True)) for x in out], schema=pa.schema([("b", pa.string()), ("m", pa.string()), ("n", pa.int64())]))

    told = each.repartition("b").sortWithinPartitions("b", "m").mapInArrow(run, "b string, m string, n long")
    # One row for each bucket: their number is fixed.
    return told.agg(F.md5(F.array_join(F.sort_array(F.collect_list(F.concat("b", "m"))), "")).alias("fingerprint"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def roles(owners: DataFrame, grants: DataFrame) -> DataFrame:
    """All roles that owners (``owner``) and access lists (``acl``: array of role names) mention."""
    return owners.select(F.col("owner").alias("role")).union(grants.select(F.explode("acl").alias("role"))).filter("role IS NOT NULL AND role <> ''").distinct()
