"""The provided tables seen as inputs of the operators, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR, DAY = 3_600_000_000, 86_400_000_000
#: 2024-01-31 00:00:00 UTC in microseconds: the instant that stands for now.
NOW = 1_706_659_200_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """The key of a table as ``k``, dealt out by it before rows are made of it: a few bytes on disk may be many rows."""
    return table(spark, sf_dir, name).select(F.col(key).alias("k")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def cents(value: str) -> Column:
    return F.round(F.col(value) * 100).cast("long")


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select((F.col("user_id") % 3).cast("int").alias("tli"), F.floor(micros("ts") / HOUR).cast("long").alias("segno"))


SEGMENTS = f"segments AS (SELECT DISTINCT CAST(user_id % 3 AS INTEGER) AS tli, epoch_us(ts) // {HOUR} AS segno FROM events)"
#: Hour 0 of the events table, and forks 200 and 450 hours later.
FIRST = 473_352
SEGMENT = 16 * 1024 * 1024
FORKS = [(1, 0, (FIRST + 200) * SEGMENT + 5), (2, 0, (FIRST + 200) * SEGMENT + 5), (2, 1, (FIRST + 450) * SEGMENT)]


def history(spark: SparkSession) -> DataFrame:
    return inline(spark, FORKS, "tli int, ancestor int, end_lsn long")


HISTORY = "history AS (SELECT * FROM (VALUES " + ", ".join(f"({a}, {b}, CAST({c} AS BIGINT))" for a, b, c in FORKS) + ") AS t(tli, ancestor, end_lsn))"


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter("l_returnflag IN ('R', 'A')")
    return li.select(
        F.lit(1).alias("tli"), F.floor(F.col("l_orderkey") / 500).cast("long").alias("seg"), F.col("l_suppkey").alias("xid"), F.lit(1).alias("db"), (F.col("l_partkey") % 16).alias("rel"),
        (F.col("l_orderkey") * 1048576 + F.col("l_partkey")).alias("lsn"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).cast("long").alias("del"), F.when(F.col("l_returnflag") == "A", 1).otherwise(0).cast("long").alias("upd"),
    )


CHANGES = """changes AS (SELECT 1 AS tli, l_orderkey // 500 AS seg, l_suppkey AS xid, 1 AS db, l_partkey % 16 AS rel, l_orderkey * 1048576 + l_partkey AS lsn,
 CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS del, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS upd FROM lineitem WHERE l_returnflag IN ('R', 'A')),
 part_counts AS (SELECT tli, seg, xid, db, rel, min(lsn) AS lsn, sum(del) AS del, sum(upd) AS upd FROM changes GROUP BY ALL),
 enough AS (SELECT * FROM (SELECT *, sum(del + upd) OVER (PARTITION BY tli, seg, xid) AS total FROM part_counts) WHERE total >= 20),
 counts AS (SELECT tli, xid, db, rel, min(lsn) AS lsn, CAST(sum(del) AS BIGINT) AS del, CAST(sum(upd) AS BIGINT) AS upd, min(seg) AS first_seg, max(seg) AS last_seg FROM enough GROUP BY ALL)"""


#: Errors of failed work: some are refusals by their text, some by their code, and some only look like it.
ERROR = "CASE WHEN {id} % 8 = 0 THEN concat('refused: step ', {id}, ' locked') WHEN {id} % 8 = 4 THEN concat('PGA-GEN-0', 30 + {id} % 9, ' step ', {id}, ' locked') WHEN {id} % 8 = 1 THEN concat('step ', {id}, ' would Lock-Out the console') WHEN {id} % 8 = 5 THEN concat('the connection was refused in step ', {id}) ELSE concat('step ', {id}, ' not mounted') END"


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as finished work of clusters (user) and nodes."""
    ev = table(spark, sf_dir, "events")
    kind = F.element_at(F.array(*[F.lit(x) for x in KINDS]), (F.col("event_id") % len(KINDS) + 1).cast("int"))
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "running").otherwise("succeeded")
    return ev.select(
        F.col("event_id").alias("id"), kind.alias("type"), (F.col("user_id") % 20).alias("cluster_id"), F.col("user_id").alias("node_id"), status.alias("status"), micros("ts").alias("updated_at"),
        F.when(status == "failed", F.expr(ERROR.format(id="event_id"))).alias("error"), (F.col("event_id") % 3).alias("work"), F.col("props"),
    )


KINDS = ["backup_run", "backup_verify", "restore_drill", "backup_expire", "pg_restart", "restore_plan"]
OPERATIONS = f"""operations AS (SELECT *, CASE WHEN status = 'failed' THEN {ERROR.format(id="id")} END AS error FROM (
 SELECT event_id AS id, [{", ".join(f"'{k}'" for k in KINDS)}][CAST(event_id % {len(KINDS)} + 1 AS INTEGER)] AS type, user_id % 20 AS cluster_id, user_id AS node_id,
 CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' ELSE 'succeeded' END AS status, epoch_us(ts) AS updated_at, event_id % 3 AS work, props FROM events))"""


def backup_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the backup sets of their customers."""
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "full").when(F.col("o_orderstatus") == "O", "incr").otherwise("diff")
    status = F.when(F.col("o_orderkey") % 11 == 0, "FAILED").when(F.col("o_orderkey") % 13 == 0, "PENDING_WAL").otherwise("COMPLETE")
    day = F.floor(micros("o_orderdate") / DAY).cast("long")
    return o.select(
        F.col("o_custkey").alias("stanza"), F.col("o_orderkey").alias("id"), kind.alias("type"), status.alias("status"), day.alias("day"), (day * 86400).alias("started"), (day * 86400 + F.col("o_orderkey") % 7200).alias("ended"),
        (day * 1000 + F.col("o_orderkey") % 1000).alias("stop_pos"), (F.col("o_orderkey") % 17 == 0).alias("promoted"), cents("o_totalprice").alias("bytes"),
    )


SETS = f"""sets AS (SELECT *, day * 86400 AS started, day * 86400 + id % 7200 AS ended, day * 1000 + id % 1000 AS stop_pos FROM (SELECT o_custkey AS stanza, o_orderkey AS id,
 CASE o_orderstatus WHEN 'F' THEN 'full' WHEN 'O' THEN 'incr' ELSE 'diff' END AS type, CASE WHEN o_orderkey % 11 = 0 THEN 'FAILED' WHEN o_orderkey % 13 = 0 THEN 'PENDING_WAL' ELSE 'COMPLETE' END AS status,
 epoch_us(o_orderdate) // {DAY} AS day, o_orderkey % 17 = 0 AS promoted, CAST(round(o_totalprice * 100) AS BIGINT) AS bytes FROM orders))"""
