"""Fleet state, health findings, objectives and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fleet
from . import testbed as T

NOW = T.NOW
MINUTE = 60_000_000


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    null = lambda n, v: F.when(k % n != 0, v)
    return T.table(spark, d, "customer").select(
        k.alias("node_id"), (k % 400).alias("cluster_id"), F.concat(F.lit("n"), k.cast("string")).alias("name"), F.when(k % 3 == 0, F.concat(F.lit("m"), k.cast("string"))).alias("member_name"), null(17, F.lit(NOW) - k % 60 * 1_000_000).alias("last_seen"), null(23, k % 3 != 0).alias("in_recovery"),
        F.when(k % 29 == 0, "leader").alias("dcs_role"), F.when(k % 7 == 1, "sync").alias("sync_state"), (k * 1_000_003 % 500_000_000).alias("lsn"), F.when(k % 6 == 0, k * 4096).alias("reported_lag"), (F.col("c_acctbal") / 1000).alias("load"), (k % 8 + 1).alias("ncpu"),
        F.when(k % 90 == 5, F.lit(NOW) - k * 1_000_000).alias("duplicate_at"), (k % 201).alias("conn_used"), null(31, F.lit(200)).alias("conn_max"), (k % 14 - 10).alias("pending_restart"), F.when(k % 4 == 0, F.lit(NOW) - k % 70 * T.HOUR).alias("offsite_ok"), (k % 5 == 0).alias("offsite_on"), null(11, k % 9 != 0).alias("zstd"), (k % 2 == 0).alias("scheduled"),
    )


_NODES = f"""nodes AS (SELECT k AS node_id, k % 400 AS cluster_id, 'n' || CAST(k AS VARCHAR) AS name, CASE WHEN k % 3 = 0 THEN 'm' || CAST(k AS VARCHAR) END AS member_name, CASE WHEN k % 17 <> 0 THEN {NOW} - k % 60 * 1000000 END AS last_seen, CASE WHEN k % 23 <> 0 THEN k % 3 <> 0 END AS in_recovery, CASE WHEN k % 29 = 0 THEN 'leader' END AS dcs_role,
 CASE WHEN k % 7 = 1 THEN 'sync' END AS sync_state, k * 1000003 % 500000000 AS lsn, CASE WHEN k % 6 = 0 THEN k * 4096 END AS reported_lag, bal / 1000 AS load, k % 8 + 1 AS ncpu, CASE WHEN k % 90 = 5 THEN {NOW} - k * 1000000 END AS duplicate_at, k % 201 AS conn_used, CASE WHEN k % 31 <> 0 THEN 200 END AS conn_max, k % 14 - 10 AS pending_restart,
 CASE WHEN k % 4 = 0 THEN {NOW} - k % 70 * {T.HOUR} END AS offsite_ok, k % 5 = 0 AS offsite_on, CASE WHEN k % 11 <> 0 THEN k % 9 <> 0 END AS zstd, k % 2 = 0 AS scheduled, coalesce({NOW} - CASE WHEN k % 17 <> 0 THEN {NOW} - k % 60 * 1000000 END < 45000000, FALSE) AS up FROM (SELECT c_custkey AS k, c_acctbal AS bal FROM customer))"""


def w9_counter_rates(spark: SparkSession, d: str) -> DataFrame:
    ev = T.table(spark, d, "events").select(F.col("user_id").alias("node_id"), T.micros("ts").alias("at_time"), F.when(F.col("event_id") % 20 == 0, 0).otherwise(F.col("event_id") * 100).cast("long").alias("total"))
    return fleet.counter_rates(ev)


def st1_latest_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return fleet.latest_snapshots(T.table(spark, d, "events").select(F.col("user_id").alias("node_id"), T.micros("ts").alias("at_time"), "event_id", "event_type"))


def roles_and_lag(spark: SparkSession, d: str) -> DataFrame:
    return fleet.roles(_nodes(spark, d), NOW)


def cluster_status(spark: SparkSession, d: str) -> DataFrame:
    return fleet.cluster_status(fleet.roles(_nodes(spark, d), NOW))


def _members(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return T.table(spark, d, "customer").select((k % 400).alias("cluster_id"), F.concat(F.when(k % 2 == 0, "m").otherwise("n"), k.cast("string")).alias("member"))


def j7_match_members(spark: SparkSession, d: str) -> DataFrame:
    return fleet.match_members(_members(spark, d), _nodes(spark, d))


def j8_without_agent(spark: SparkSession, d: str) -> DataFrame:
    return fleet.without_agent(_members(spark, d), _nodes(spark, d))


def _slots(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return T.table(spark, d, "orders").select(F.col("o_custkey").alias("node_id"), (F.col("o_custkey") % 400).alias("cluster_id"), F.concat(F.lit("s"), (k % 9).cast("string")).alias("name"), (k % 4 == 0).alias("active"), (T.cents("o_totalprice") * 700).alias("retained_bytes"), F.when(k % 50 == 1, "lost").when(k % 3 == 0, "reserved").alias("wal_status"))


_SLOTS = "slots AS (SELECT o_custkey AS node_id, o_custkey % 400 AS cluster_id, 's' || CAST(o_orderkey % 9 AS VARCHAR) AS name, o_orderkey % 4 = 0 AS active, CAST(round(o_totalprice * 100) AS BIGINT) * 700 AS retained_bytes, CASE WHEN o_orderkey % 50 = 1 THEN 'lost' WHEN o_orderkey % 3 = 0 THEN 'reserved' END AS wal_status FROM orders)"


def j9_standby_slots(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    standbys = T.table(spark, d, "customer").select(k.alias("standby_id"), (k % 100).alias("primary_id"), F.concat(F.lit("s"), (k % 9).cast("string")).alias("slot"))
    return fleet.standby_slots(standbys, _slots(spark, d))


def j14_storage_hosts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = T.table(spark, d, "supplier")
    hosts = s.select(k.alias("host_id"), F.array(F.concat(F.lit("h"), (k % 60).cast("string")), F.concat(F.lit("ip"), (k % 30).cast("string"))).alias("aliases"))
    return fleet.storage_hosts(T.table(spark, d, "customer").select(F.col("c_custkey").alias("storage_id"), F.concat(F.when(F.col("c_custkey") % 2 == 0, "h").otherwise("ip"), (F.col("c_custkey") % 80).cast("string")).alias("remote_host")), hosts)


def r7_site_groups(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = T.table(spark, d, "customer")
    return fleet.site_groups(c.select(k.alias("cluster_id"), (k % 700).alias("system"), (k % 13 == 0).alias("opt_out")), c.filter("c_custkey % 50 = 3").select(k.alias("src"), (k + 1).alias("dst")))


def r8_elect(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return fleet.elect(T.table(spark, d, "customer").select((k % 200).alias("group_id"), k.alias("cluster_id"), (k % 41 == 0).alias("failover_target"), (k % 17 == 0).alias("declared"), (k % 5 == 0).alias("is_upstream")))


def g21_drift(spark: SparkSession, d: str) -> DataFrame:
    li = T.table(spark, d, "lineitem").select((F.col("l_suppkey") % 30).alias("cluster_id"), F.col("l_suppkey").alias("node_id"), F.concat(F.lit("p"), (F.col("l_partkey") % 300).cast("string")).alias("name"), F.when(F.col("l_orderkey") % 97 == 0, "odd").otherwise("std").alias("value"))
    return fleet.drift(li, ["p1", "p2"])


def g22_worker_stores(spark: SparkSession, d: str) -> DataFrame:
    o = T.table(spark, d, "orders")
    return fleet.worker_stores(o.select(F.col("o_custkey").alias("cluster_id"), (F.col("o_orderkey") % 6).alias("worker_id"), F.col("o_orderstatus").alias("kind")))


def g17_volume_needs(spark: SparkSession, d: str) -> DataFrame:
    o = T.table(spark, d, "orders").select((F.col("o_custkey") % 120).alias("device"), (T.cents("o_totalprice") * 50).alias("bytes"))
    s = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("device"), (F.col("s_suppkey") * 4_000_000_000).alias("free"), (F.col("s_suppkey") * 8_000_000_000).alias("total"))
    return fleet.volume_needs(o, s)


def version_tiers(spark: SparkSession, d: str) -> DataFrame:
    v = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"), (F.col("s_suppkey") % 12 + 8).cast("int").alias("major"))
    return v.select("node_id", "major", fleet.classify_version(F.col("major"), F.lit("2025-11-14").cast("date")).alias("c")).select("node_id", "major", "c.tier", F.col("c.last_day").cast("string").alias("last_day"), "c.eol")


#: Version texts of customers' servers, in both engines.
_VERSION = "CASE k % 7 WHEN 0 THEN concat(8 + k % 12, '.', k % 5) WHEN 1 THEN concat('v', 9 + k % 3, '.6.', k % 4) WHEN 2 THEN concat(17 + k % 3, 'beta1') WHEN 3 THEN concat(' ', 10 + k % 9, '.1 (built here)') WHEN 4 THEN '9' WHEN 5 THEN 'devel 16' END"


def version_findings(spark: SparkSession, d: str) -> DataFrame:
    n = T.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return fleet.version_findings(n.selectExpr("k % 400 AS cluster_id", "k AS node_id", f"CASE WHEN k % 17 <> 0 THEN {NOW} - k % 60 * 1000000 END AS last_seen", f"{_VERSION} AS version"), NOW, F.lit("2024-01-31").cast("date"))


def node_findings(spark: SparkSession, d: str) -> DataFrame:
    return fleet.node_findings(_nodes(spark, d), NOW)


def slot_findings(spark: SparkSession, d: str) -> DataFrame:
    return fleet.slot_findings(_slots(spark, d))


def replica_findings(spark: SparkSession, d: str) -> DataFrame:
    return fleet.replica_findings(_slots(spark, d).select("cluster_id", "name", (F.col("retained_bytes") / 8).cast("long").alias("lag_bytes")))


def disk_findings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return fleet.disk_findings(T.table(spark, d, "orders").select((F.col("o_custkey") % 400).alias("cluster_id"), F.col("o_custkey").alias("node_id"), F.concat(F.lit("d"), (k % 3).cast("string")).alias("label"), (k % 101 * 1000).alias("free_bytes"), F.when(k % 7 == 0, 0).otherwise(100_000).alias("total_bytes")))


def worker_findings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    majors = F.array(*[F.lit(x) for x in (13, 14, 15, 16)])
    return fleet.worker_findings(T.table(spark, d, "supplier").select(k.alias("worker_id"), F.when(k % 9 != 0, F.lit(NOW) - k % 60 * 1_000_000).alias("last_seen"), (k % 50).alias("free_bytes"), F.when(k % 7 != 0, 100).alias("total_bytes"), F.when(k % 5 != 0, F.slice(majors, 1, (k % 4 + 1).cast("int"))).alias("installed"), F.slice(majors, F.lit(2), (k % 3).cast("int")).alias("required")), NOW)


def site_findings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return fleet.site_findings(T.table(spark, d, "customer").select(k.alias("cluster_id"), F.when(k % 11 != 0, F.lit(NOW) - k % 300 * 1_000_000).alias("primary_seen"), (k % 3).alias("witnesses"), (k % 2).alias("witnesses_lost"), (k % 13 == 0).alias("failed_over"), (k % 4 == 0).alias("auto"), (k % 8 == 0).alias("armed"), F.when(k % 6 != 0, k * 1_000_000).alias("lag_bytes"), (k % 10 - 8).alias("checks_bad"), (k % 12 - 9).alias("checks_warn")), NOW)


#: Each column of the clusters fixture, as an expression that both engines read.
_CLUSTER = {
    "cluster_id": "k", "name": "concat('c', k)", "environment": "CASE WHEN k % 3 = 0 THEN 'prod' ELSE 'dev' END", "sets": "CASE WHEN k % 8 = 0 THEN 0 ELSE k % 20 END", "nodes": "k % 4 + 1", "up": "k % 5", "has_primary": "k % 6 <> 0", "standby_site": "k % 10 = 7",
    "last_news": f"CASE WHEN k % 14 <> 0 THEN {NOW} - k * {MINUTE} * 5 END", "enrolled_at": f"{NOW} - k * {MINUTE}", "clock_skew": "CASE WHEN k % 33 = 1 THEN 900000000 WHEN k % 33 = 2 THEN NULL ELSE 0 END", "last_backup": f"CASE WHEN k % 8 <> 0 THEN {NOW} - (k % 90 - 2) * {T.HOUR} END", "last_run_ok": f"CASE WHEN k % 2 = 0 THEN {NOW} - k % 50 * {T.HOUR} END",
    "scheduled": "k % 4 <> 1", "full_hours": "k % 50 + 1", "incr_hours": "k % 12 + 1", "failed_runs": "k % 7 - 3", "gc_postponed": "k % 9", "verify_failed": "k % 11 - 9", "last_verify": f"CASE WHEN k % 3 <> 1 THEN {NOW} - k % 300 * {T.HOUR} END", "verify_hours": "k % 100", "drill_failed": "CASE WHEN k % 16 = 3 THEN 1 ELSE 0 END", "drill_days": "k % 30",
    "last_drill": f"CASE WHEN k % 5 <> 2 THEN {NOW} - k % 120 * {T.DAY} END", "gap_count": "CASE WHEN k % 25 = 4 THEN 2 ELSE 0 END", "tails": "CASE WHEN k % 26 = 5 THEN 1 ELSE 0 END", "conflicts": "k % 27 - 24", "conflicts_newest": f"{NOW} - k % 20 * {T.DAY}", "off_history": "k % 5 - 2", "last_failed": f"CASE WHEN k % 12 = 5 THEN {NOW} - k % 9 * {T.HOUR} END",
    "last_archived": f"CASE WHEN k % 15 <> 1 THEN {NOW} - k % 4000 * 1000000 END", "spool_error": "k % 40 = 9", "spool_pending": "k % 300", "spool_age": "CASE WHEN k % 3 = 0 THEN k * 7 % 4000 END", "current_lsn": "CASE WHEN k % 9 = 0 THEN k * 16777216 ELSE k * 16777216 + 12345 END", "archived_segno": "CASE WHEN k % 2 = 0 THEN k - 1 ELSE k - k % 200 END", "archive_mode": "CASE WHEN k % 21 = 0 THEN 'off' ELSE 'on' END",
    "last_full": f"CASE WHEN k % 8 <> 0 AND k % 9 > 0 THEN {NOW} - (k % 700 + 1) * {T.HOUR} END", "archiver_failed": "k % 17", "has_archiver": "k % 6 <> 0", "wal_stores": "k % 3", "paused": "k % 18 = 11", "archive_timeout": "CASE WHEN k % 2 = 0 THEN 300 END", "rpo_minutes": "k % 4 * 10", "rto_minutes": "k % 5 * 15", "size_bytes": "k * 1000000007 % 90000000000",
}
_CLUSTERS = "clusters AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _CLUSTER.items()) + " FROM (SELECT c_custkey AS k FROM customer))"


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "customer").select(F.col("c_custkey").alias("k")).selectExpr(*[f"{v} AS {k}" for k, v in _CLUSTER.items()])


def cluster_findings(spark: SparkSession, d: str) -> DataFrame:
    return fleet.cluster_findings(_clusters(spark, d), NOW)


def g6_severity_counts(spark: SparkSession, d: str) -> DataFrame:
    return fleet.severity_counts(fleet.slot_findings(_slots(spark, d)))


def g9_worst_status(spark: SparkSession, d: str) -> DataFrame:
    return fleet.worst_status(_clusters(spark, d), fleet.slot_findings(_slots(spark, d)))


def protection(spark: SparkSession, d: str) -> DataFrame:
    clusters = _clusters(spark, d)
    return fleet.protection(clusters, fleet.cluster_findings(clusters, NOW), fleet.recovery_points(clusters, NOW))


def st5_clock_skews(spark: SparkSession, d: str) -> DataFrame:
    at = T.micros("ts")
    told = F.when(F.col("event_id") % 4 > 0, at / 1e6 + (F.col("event_id") % 100) / 8.0)
    return fleet.clock_skews(T.table(spark, d, "events").select(F.col("user_id").alias("node_id"), at.alias("at_time"), told.alias("agent_now")))


def x19_host_digests(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    names = F.transform(F.sequence(F.lit(0), (key % 30).cast("int")), lambda k: F.when(k % 5 == 4, "").otherwise(F.concat(F.lit("process-"), (k % 17).cast("string"))))
    told = F.transform(F.sequence(F.lit(1), (key % 6 + 1).cast("int")), lambda k: F.concat(F.lit("w"), k.cast("string")))
    hosts = T.table(spark, d, "customer").select(key.alias("host"), names.alias("processes"), told.alias("warnings"))
    return fleet.host_digests(hosts).select("host", F.array_join("processes", ",").alias("processes"), F.array_join("warnings", ",").alias("warnings"))


def w16_recovery_points(spark: SparkSession, d: str) -> DataFrame:
    return fleet.recovery_points(_clusters(spark, d), NOW)


def w17_recovery_times(spark: SparkSession, d: str) -> DataFrame:
    o = T.table(spark, d, "orders")
    drills = o.select(F.col("o_custkey").alias("cluster_id"), (F.lit(NOW) - F.col("o_orderkey") % 150 * T.DAY).alias("at_time"), (F.col("o_orderkey") % 3000 - 5).alias("seconds"), (T.cents("o_totalprice") * 900).alias("bytes"))
    return fleet.recovery_times(_clusters(spark, d), drills, NOW)


def m_metrics(spark: SparkSession, d: str) -> DataFrame:
    found = fleet.slot_findings(_slots(spark, d))
    gauges = fleet.metrics(_clusters(spark, d), fleet.worst_status(_clusters(spark, d), found), fleet.severity_counts(found))
    return gauges.select("metric", F.col("labels")["cluster"].alias("cluster"), F.col("labels")["severity"].alias("severity"), "value")


def _gauges(spark: SparkSession, d: str) -> DataFrame:
    clusters = _clusters(spark, d)
    found = fleet.cluster_findings(clusters, NOW)
    counts = fleet.severity_counts(found)
    k = F.col("s_suppkey")
    drills = T.table(spark, d, "orders").select(F.col("o_custkey").alias("cluster_id"), (F.lit(NOW) - F.col("o_orderkey") % 150 * T.DAY).alias("at_time"), (F.col("o_orderkey") % 3000 - 5).alias("seconds"), (T.cents("o_totalprice") * 900).alias("bytes"))
    replicas = T.table(spark, d, "orders").filter("o_orderkey % 20 = 0").select(F.col("o_custkey").alias("cluster_id"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("name"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") * 100).alias("lag_bytes"))
    workers = T.table(spark, d, "supplier").select(F.when(k % 9 != 0, F.lit(NOW) - k % 60 * 1_000_000).alias("last_seen"))
    return fleet.all_metrics(clusters, fleet.worst_status(clusters, found), counts, fleet.recovery_points(clusters, NOW), fleet.recovery_times(clusters, drills, NOW), replicas, workers, T.operations(spark, d), NOW)


def m_all_metrics(spark: SparkSession, d: str) -> DataFrame:
    entries = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return _gauges(spark, d).select("metric", F.array_join(entries, ",").alias("labels"), "value")


def sk1_text(spark: SparkSession, d: str) -> DataFrame:
    return fleet.exposition_text(_gauges(spark, d), fleet.GAUGES)


def sk1_exposition(spark: SparkSession, d: str) -> DataFrame:
    p = T.table(spark, d, "part")
    value = F.when(F.col("p_partkey") % 10 == 0, F.lit(None)).when(F.col("p_partkey") % 10 == 1, F.lit(float("nan"))).when(F.col("p_partkey") % 2 == 0, F.col("p_size") + 0.5).otherwise(F.col("p_size").cast("double"))
    return fleet.exposition(p.select(F.lit("fleet_size").alias("metric"), F.create_map(F.lit("name"), F.concat("p_name", F.lit('"\\'), F.col("p_partkey").cast("string")), F.lit("brand"), F.col("p_brand")).alias("labels"), value.alias("value")))


_SLOT_FINDINGS = """sf AS (SELECT cluster_id, CASE WHEN coalesce(wal_status = 'lost', FALSE) THEN 'critical' WHEN retained_bytes > 10737418240 THEN 'critical' ELSE 'warning' END AS severity, CASE WHEN coalesce(wal_status = 'lost', FALSE) THEN 'slot_invalidated' ELSE 'slot_stale' END AS code, name AS detail FROM slots WHERE coalesce(wal_status = 'lost', FALSE) OR NOT active AND retained_bytes > 1073741824)"""
_N, _H, _D = NOW, T.HOUR, T.DAY
_RULES = [
    ("no_primary", f"CASE WHEN last_news IS NULL AND {_N} - enrolled_at < 900000000 THEN 'info' WHEN up = 0 AND coalesce({_N} - last_news > {3 * _D}, FALSE) AND environment <> 'prod' THEN 'warning' ELSE 'critical' END", "NOT has_primary AND NOT standby_site", "''"),
    ("no_backup", "CASE WHEN environment = 'prod' OR scheduled THEN 'critical' ELSE 'warning' END", "sets = 0 AND NOT standby_site AND NOT (last_news IS NULL AND up = 0)", "''"),
    ("clock_ahead", "'warning'", f"sets > 0 AND (coalesce(last_backup > {_N} + 600000000, FALSE) OR coalesce(clock_skew, 0) > 600000000)", "''"),
    ("backup_stale", f"CASE WHEN {_N} - eff > 4 * least(full_hours, incr_hours) * {_H} THEN 'critical' ELSE 'warning' END", f"sets > 0 AND scheduled AND {_N} - eff > 2 * least(full_hours, incr_hours) * {_H}", "''"),
    ("no_schedule", "CASE WHEN environment = 'prod' THEN 'warning' ELSE 'info' END", "sets > 0 AND NOT standby_site AND NOT scheduled", "''"),
    ("backup_failed", "CASE WHEN failed_runs >= 3 AND (environment = 'prod' OR scheduled) THEN 'critical' ELSE 'warning' END", "failed_runs > 0", "''"),
    ("gc_postponed", "'warning'", "gc_postponed >= 5", "''"),
    ("verify_failed", "CASE WHEN environment = 'prod' THEN 'critical' ELSE 'warning' END", "verify_failed > 0", "''"),
    ("verify_stale", "'info'", f"scheduled AND verify_hours > 0 AND sets > 0 AND {_N} - coalesce(last_verify, last_backup) > verify_hours * 2 * {_H}", "''"),
    ("drill_failed", "CASE WHEN environment = 'prod' THEN 'warning' ELSE 'info' END", "sets > 0 AND NOT standby_site AND drill_failed > 0", "''"),
    ("drill_stale", "CASE WHEN scheduled AND drill_days > 0 AND last_drill IS NOT NULL THEN 'warning' ELSE 'info' END", f"environment = 'prod' AND sets > 0 AND NOT standby_site AND drill_failed = 0 AND (last_drill IS NULL OR {_N} - last_drill > CASE WHEN scheduled AND drill_days > 0 THEN 2 * drill_days ELSE 90 END * {_D})", "''"),
    ("wal_gap", "'critical'", "gap_count > 0 AND NOT standby_site", "''"), ("wal_branch_tail", "'critical'", "tails > 0 AND NOT standby_site", "''"),
    ("wal_conflict", f"CASE WHEN {_N} - conflicts_newest > {7 * _D} THEN 'warning' ELSE 'critical' END", "conflicts > 0 AND NOT standby_site", "''"), ("wal_leftovers", "'info'", "conflicts = 0 AND off_history > 0 AND NOT standby_site", "''"),
    ("archiver_failing", "'critical'", f"last_failed IS NOT NULL AND (last_archived IS NULL OR last_failed > last_archived) AND {_N} - last_failed < {6 * _H}", "''"), ("wal_spool_failing", "'critical'", "spool_error", "''"),
    ("wal_spool_behind", "CASE WHEN spool_pending >= 256 OR coalesce(spool_age, 0) > 3600 THEN 'critical' ELSE 'warning' END", "NOT spool_error AND (spool_pending >= 64 OR coalesce(spool_age, 0) > 900) AND spool_pending > 0", "''"),
    ("archiver_lag", "CASE WHEN current_lsn // 16777216 - archived_segno - 1 >= 128 THEN 'critical' ELSE 'warning' END", "current_lsn // 16777216 - archived_segno - 1 >= 16", "CAST(current_lsn // 16777216 - archived_segno - 1 AS VARCHAR)"),
    ("archive_off", "'warning'", "scheduled AND archive_mode = 'off'", "''"), ("wal_not_shared", "'warning'", "wal_stores >= 2", "''"), ("patroni_paused", "CASE WHEN has_primary OR standby_site THEN 'warning' ELSE 'critical' END", "paused", "''"),
]
_EFF = f"eff AS (SELECT *, CASE WHEN abs(coalesce(clock_skew, 0)) > 600000000 THEN last_backup - clock_skew WHEN coalesce(last_backup > {_N} + 600000000, FALSE) THEN last_run_ok ELSE last_backup END AS eff FROM clusters)"
_CF = "cf AS (" + " UNION ALL ".join(f"SELECT cluster_id, {sev} AS severity, '{code}' AS code, {detail} AS detail FROM eff WHERE {when}" for code, sev, when, detail in _RULES) + ")"
_POINTS = f"""b AS (SELECT *, coalesce(archive_timeout, 0) AS t, greatest(0, ({_N} - last_archived) / 1000000) AS since, last_failed IS NOT NULL AND (last_archived IS NULL OR last_failed > last_archived) AS failing, CASE WHEN last_news IS NULL THEN 0 ELSE greatest(0, ({_N} - last_news) / 1000000) END AS age FROM clusters),
 x AS (SELECT *, CASE WHEN current_lsn // 16777216 - archived_segno - 1 = 0 THEN CASE WHEN current_lsn % 16777216 = 0 THEN floor(age + 0.5) WHEN t > 0 THEN least(t, since) ELSE since END ELSE greatest(since, t) END + coalesce(spool_age, 0) AS bound FROM b),
 y AS (SELECT *, CASE WHEN bound <= greatest(t, 60) * 2 THEN 'ok' WHEN bound <= 3600 THEN 'warn' ELSE 'bad' END AS s0 FROM x), points AS (SELECT cluster_id, CASE WHEN has_primary AND archive_mode <> 'off' AND NOT failing AND last_archived IS NOT NULL THEN CAST(floor(bound + 0.5) AS BIGINT) END AS seconds,
 CASE WHEN NOT has_primary THEN 'unknown' WHEN archive_mode = 'off' OR failing THEN 'bad' WHEN last_archived IS NULL THEN 'warn' WHEN rpo_minutes > 0 THEN CASE WHEN bound > rpo_minutes * 60 THEN 'bad' WHEN t = 0 THEN 'warn' ELSE s0 END ELSE s0 END AS state FROM y)"""
_OWN = "'cluster=' || name || ',cluster_id=' || c.cluster_id || ',environment=' || environment"
_METRICS = f"""{T.OPERATIONS}, {_CLUSTERS}, {_EFF}, {_CF}, {_POINTS}, times AS (WITH d AS (SELECT o_custkey AS cluster_id, {_N} - o_orderkey % 150 * {_D} AS a, o_orderkey % 3000 - 5 AS s, CAST(round(o_totalprice * 100) AS BIGINT) * 900 AS b FROM orders), l AS (SELECT cluster_id, max({{'a': a, 's': s, 'b': b}}) AS d FROM d WHERE s > 0 GROUP BY 1),
 e AS (SELECT c.cluster_id, rto_minutes * 60 AS target, d, CAST(floor(d.s * CASE WHEN d.b > 0 AND size_bytes > 0 THEN greatest(1.0, size_bytes / d.b) ELSE 1.0 END + 0.5) AS BIGINT) AS est FROM clusters c LEFT JOIN l ON l.cluster_id = c.cluster_id)
 SELECT cluster_id, est AS seconds, CASE WHEN d IS NULL THEN 'unknown' WHEN target > 0 AND est > target THEN 'bad' WHEN {_N} - d.a > {90 * _D} THEN 'stale' ELSE 'ok' END AS state FROM e), n AS (SELECT cluster_id, max(CASE severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END) AS r, count(*) FILTER (severity = 'info') AS i, count(*) FILTER (severity = 'warning') AS w, count(*) FILTER (severity = 'critical') AS cr FROM cf GROUP BY 1),
 c AS (SELECT c.*, CASE WHEN up = 0 THEN 3 ELSE coalesce(n.r, 1) - 1 END AS status, coalesce(n.i, 0) AS n_info, coalesce(n.w, 0) AS n_warning, coalesce(n.cr, 0) AS n_critical, p.seconds AS rpo, p.state AS rpo_state, t.seconds AS rto FROM clusters c LEFT JOIN n ON n.cluster_id = c.cluster_id LEFT JOIN points p ON p.cluster_id = c.cluster_id LEFT JOIN times t ON t.cluster_id = c.cluster_id),
 m AS (""" + " UNION ALL ".join(f"SELECT 'fleet_{k}' AS metric, {_OWN} || '{more}' AS labels, CAST({v} AS DOUBLE) AS value FROM c" for k, v, more in [
    ("cluster_status", "status", ""), ("cluster_findings", "n_info", ",severity=info"), ("cluster_findings", "n_warning", ",severity=warning"), ("cluster_findings", "n_critical", ",severity=critical"), ("cluster_last_backup_timestamp_seconds", "CASE WHEN sets > 0 THEN last_backup // 1000000 END", ""),
    ("cluster_last_full_backup_timestamp_seconds", "CASE WHEN sets > 0 THEN last_full // 1000000 END", ""), ("cluster_backup_sets", "sets", ""), ("cluster_archiver_failed_total", "CASE WHEN has_archiver THEN archiver_failed END", ""), ("cluster_archiver_last_failed_timestamp_seconds", "CASE WHEN has_archiver THEN coalesce(last_failed // 1000000, 0) END", ""),
    ("cluster_wal_gaps", "gap_count", ""), ("cluster_wal_conflicts", "conflicts", ""), ("cluster_nodes", "up", ",state=online"), ("cluster_nodes", "nodes - up", ",state=offline"), ("cluster_size_bytes", "CASE WHEN size_bytes > 0 THEN size_bytes END", ""), ("cluster_rpo_seconds", "coalesce(rpo, CASE WHEN rpo_state = 'bad' THEN -1 END)", ""),
    ("cluster_rto_estimate_seconds", "rto", ""), ("cluster_rpo_target_seconds", "CASE WHEN rpo_minutes > 0 THEN rpo_minutes * 60 END", ""), ("cluster_rto_target_seconds", "CASE WHEN rto_minutes > 0 THEN rto_minutes * 60 END", ""),
]) + f""" UNION ALL SELECT 'fleet_cluster_replication_lag_bytes', {_OWN} || ',replica=r' || o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey * 100.0 ELSE 0 END FROM orders JOIN clusters c ON c.cluster_id = o_custkey WHERE o_orderkey % 20 = 0
 UNION ALL SELECT 'fleet_workers', 'state=' || s, count(*) FILTER ((s = 'online') = (s_suppkey % 9 <> 0 AND s_suppkey % 60 < 45)) FROM supplier, (VALUES ('online'), ('offline')) t(s) GROUP BY s
 UNION ALL SELECT 'fleet_operations_24h', 'status=' || status || ',type=' || type, count(*) FROM operations WHERE updated_at >= {_N} - {_D} GROUP BY status, type UNION ALL SELECT 'fleet_operations_running', '', count(*) FILTER (status IN ('queued', 'running')) FROM operations
 UNION ALL SELECT 'fleet_findings', 'severity=' || s, count(*) FILTER (severity = s) FROM cf, (VALUES ('info'), ('warning'), ('critical')) t(s) GROUP BY s), metrics AS (SELECT * FROM m WHERE value IS NOT NULL)"""
_RANK = "CASE severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END"
def _setups(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    name = lambda n, at: F.when(k % n == at, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array().cast("array<string>"))
    pick = lambda n, at, yes, no: F.when(k % n == at, yes).otherwise(no)
    return T.table(spark, d, "customer").select(
        k.alias("cluster_id"), pick(2, 0, F.lit("prod"), F.lit("dev")).alias("environment"), (k % 3 == 0).alias("scheduled"), (k % 5).alias("incr_hours"), name(11, 1).alias("plain_agents"), name(13, 2).alias("unchecked_agents"), F.array(F.lit("a"), F.lit("b")).alias("members"),
        pick(7, 3, F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b"))).alias("known"), F.array(F.lit("1"), F.lit("2")).alias("tablespaces"), pick(8, 1, F.array(F.lit("1")), pick(8, 2, F.lit(None), F.array(F.lit("1"), F.lit("2")))).alias("full_tablespaces"), name(9, 4).alias("restoring"), name(18, 4).alias("busy"),
        pick(10, 0, F.lit("mod"), F.lit(" ")).alias("archive_library"), pick(20, 0, F.lit("(disabled)"), F.lit("cp %p %f")).alias("archive_command"), (k % 4 == 0).alias("failing"), pick(12, 0, F.lit("00000003.history"), F.lit("000000030000000000000001")).alias("last_failed_wal"), pick(24, 0, F.lit("PGA-WAL-031: other"), F.lit("PGA-WAL-030")).alias("archive_error"),
        pick(3, 1, F.lit("off"), F.lit(None)).alias("summarize_wal"), pick(6, 1, F.lit("off"), pick(6, 2, F.lit("on"), F.lit(None))).alias("wal_log_hints"), (k % 30 == 1).alias("checksums"), (k % 4 < 3).alias("patroni_ok"), (k % 3 + 1).alias("patroni_members"), F.when(k % 5 != 2, k % 5 != 3).alias("use_pg_rewind"), F.when(k % 2 == 0, k % 14 != 0).alias("local_replication_ok"),
        F.when(k % 6 != 0, k % 1000).alias("rpo_seconds"), pick(3, 0, F.lit("ok"), pick(3, 1, F.lit("warn"), F.lit("bad"))).alias("rpo_state"), (k % 4).alias("rpo_minutes"), F.when(k % 7 != 0, k % 5000).alias("rto_seconds"), pick(4, 1, F.lit("bad"), F.lit("ok")).alias("rto_state"), (k % 3).alias("rto_minutes"),
        F.array(F.lit("x"), pick(15, 4, F.lit("y"), pick(15, 5, F.lit(None), F.lit("x")))).alias("repo_stores"), name(16, 9).alias("off_server"),
    )


def setup_findings(spark: SparkSession, d: str) -> DataFrame:
    return fleet.setup_findings(_setups(spark, d))


_SETUP = [
    ("CASE WHEN k % 2 = 0 THEN 'warning' ELSE 'info' END", "agent_insecure_transport", "'plain:a,b'", "k % 11 = 1"), ("CASE WHEN k % 2 = 0 THEN 'warning' ELSE 'info' END", "agent_insecure_transport", "'noverify:a,b'", "k % 13 = 2"), ("'warning'", "node_without_agent", "'b'", "k % 7 = 3"), ("'warning'", "tablespace_after_full", "'2'", "k % 8 = 1"),
    ("'warning'", "restore_incomplete", "'a,b'", "k % 9 = 4 AND k % 18 <> 4"), ("'critical'", "archive_both_set", "''", "k % 10 = 0 AND k % 20 <> 0"), ("'critical'", "archiver_history_conflict", "'00000003.history'", "k % 24 = 0"),
    ("CASE WHEN k % 3 = 2 THEN 'critical' ELSE 'warning' END", "rpo_target", "CAST(k % 1000 AS VARCHAR)", "k % 4 > 0 AND k % 6 <> 0 AND k % 3 <> 0"), ("'warning'", "rto_target", "CAST(k % 5000 AS VARCHAR)", "k % 3 > 0 AND k % 4 = 1 AND k % 7 <> 0"), ("'warning'", "repo_not_shared", "''", "k % 15 = 4"), ("'warning'", "backup_server_mismatch", "'a,b'", "k % 16 = 9"),
    ("'warning'", "patroni_rewind", "CASE WHEN k % 5 IN (2, 3) THEN 'off' ELSE 'hints' END", "k % 4 < 3 AND k % 3 >= 1 AND (k % 5 IN (2, 3) OR k % 6 = 1 AND k % 30 <> 1)"), ("'warning'", "patroni_local_replication", "''", "k % 14 = 0"), ("'info'", "summarize_wal_off", "''", "k % 3 = 1 AND k % 3 = 0"),
]
SQL = {
    "setup_findings": "WITH c AS (SELECT c_custkey AS k FROM customer) " + " UNION ALL ".join(f"SELECT k AS cluster_id, {level} AS severity, '{code}' AS code, {detail} AS detail FROM c WHERE {when}" for level, code, detail, when in _SETUP),
    "w9_counter_rates": """WITH s AS (SELECT user_id AS node_id, epoch_us(ts) AS at_time, CASE WHEN event_id % 20 = 0 THEN 0 ELSE event_id * 100 END AS total FROM events), l AS (SELECT *, (at_time - lag(at_time) OVER w) / 1000000 AS s, total - lag(total) OVER w AS m FROM s WINDOW w AS (PARTITION BY node_id ORDER BY at_time))
 SELECT node_id, at_time, CASE WHEN m >= 0 AND s > 0 THEN floor(m / s * 10 + 0.5) / 10 END AS rate FROM l""",
    "st1_latest_snapshots": "SELECT user_id AS node_id, max(epoch_us(ts)) AS at_time, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1",
    "roles_and_lag": f"""WITH {_NODES}, l AS (SELECT cluster_id, arg_min(lsn, node_id) AS lead FROM nodes WHERE up AND NOT in_recovery GROUP BY 1)
 SELECT node_id, n.cluster_id, coalesce(dcs_role, CASE WHEN sync_state = 'sync' THEN 'sync_standby' END, CASE WHEN in_recovery THEN 'replica' WHEN NOT in_recovery THEN 'primary' END, 'unknown') AS role, coalesce(reported_lag, CASE WHEN in_recovery AND lead IS NOT NULL THEN greatest(0, lead - lsn) END) AS lag, CASE WHEN up THEN 'online' ELSE 'offline' END AS state,
 CAST(least(100, floor(load / ncpu * 100 + 0.5)) AS INTEGER) AS cpu FROM nodes n LEFT JOIN l ON l.cluster_id = n.cluster_id""",
    "j7_match_members": f"WITH {_NODES}, m AS (SELECT c_custkey % 400 AS cluster_id, CASE WHEN c_custkey % 2 = 0 THEN 'm' ELSE 'n' END || CAST(c_custkey AS VARCHAR) AS member FROM customer) SELECT m.cluster_id, member, coalesce((SELECT min(node_id) FROM nodes n WHERE n.cluster_id = m.cluster_id AND member_name = member), (SELECT min(node_id) FROM nodes n WHERE n.cluster_id = m.cluster_id AND n.name = member)) AS node_id FROM m",
    "j8_without_agent": "SELECT c_custkey % 400 AS cluster_id, 'm' || CAST(c_custkey AS VARCHAR) AS member FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0",
    "j9_standby_slots": f"WITH {_SLOTS} SELECT c_custkey AS standby_id, c_custkey % 100 AS primary_id, 's' || CAST(c_custkey % 9 AS VARCHAR) AS slot, active, retained_bytes FROM customer LEFT JOIN slots ON node_id = c_custkey % 100 AND name = 's' || CAST(c_custkey % 9 AS VARCHAR)",
    "j14_storage_hosts": "WITH h AS (SELECT DISTINCT s_suppkey AS id, unnest(['h' || CAST(s_suppkey % 60 AS VARCHAR), 'ip' || CAST(s_suppkey % 30 AS VARCHAR)]) AS a FROM supplier) SELECT c_custkey AS storage_id, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR)), '') AS hosts FROM customer LEFT JOIN h ON a = CASE WHEN c_custkey % 2 = 0 THEN 'h' ELSE 'ip' END || CAST(c_custkey % 80 AS VARCHAR) GROUP BY 1",
    "r7_site_groups": """WITH RECURSIVE c AS (SELECT c_custkey AS id, c_custkey % 700 AS s FROM customer WHERE c_custkey % 13 <> 0), b0 AS (SELECT a.id AS src, b.id AS dst FROM c a JOIN c b ON a.s = b.s AND a.id <> b.id UNION SELECT a.id, b.id FROM c a JOIN c b ON b.id = a.id + 1 WHERE a.id % 50 = 3), b AS (SELECT src, dst FROM b0 UNION SELECT dst, src FROM b0),
 w AS (SELECT id AS node, id AS root FROM c UNION SELECT b.dst, w.root FROM w JOIN b ON b.src = w.node WHERE w.root < b.dst), r AS (SELECT node, min(root) AS root FROM w GROUP BY 1), z AS (SELECT root, count(*) AS size FROM r GROUP BY 1 HAVING count(*) >= 2) SELECT node AS cluster_id, root AS group_id, size FROM r JOIN z USING (root)""",
    "r8_elect": "WITH p AS (SELECT c_custkey % 200 AS group_id, c_custkey AS id, CASE WHEN c_custkey % 41 = 0 THEN 0 WHEN c_custkey % 17 = 0 THEN 1 WHEN c_custkey % 5 = 0 THEN 2 ELSE 3 END AS priority FROM customer) SELECT group_id, arg_min(id, (priority, id)) AS primary, min(priority) AS priority FROM p GROUP BY 1",
    "g21_drift": "SELECT l_suppkey % 30 AS cluster_id, 'p' || CAST(l_partkey % 300 AS VARCHAR) AS name, count(DISTINCT l_suppkey) AS nodes, 2 AS kinds, 'odd,std' AS found FROM lineitem WHERE l_partkey % 300 NOT IN (1, 2) GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) >= 2 AND count(DISTINCT l_orderkey % 97 = 0) > 1",
    "g22_worker_stores": "SELECT o_custkey AS cluster_id, count(DISTINCT o_orderkey % 6) AS workers, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS kinds FROM orders GROUP BY 1",
    "g17_volume_needs": "WITH n AS (SELECT o_custkey % 120 AS device, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT) * 50) AS BIGINT) AS need, count(*) AS parts FROM orders GROUP BY 1) SELECT device, need, parts, s_suppkey * 4000000000 AS free, need <= s_suppkey * 4000000000 - greatest(1073741824, CAST(trunc(s_suppkey * 8000000000 * 0.05) AS BIGINT)) AS fits FROM n LEFT JOIN supplier ON s_suppkey = device",
    "version_tiers": """WITH v AS (SELECT CAST(range AS INTEGER) AS major, CASE WHEN range < 10 THEN DATE '2021-11-11' ELSE CAST(make_date(2012 + range, 11, 1) + CAST((4 - isodow(make_date(2012 + range, 11, 1)) + 7) % 7 + 7 AS INTEGER) AS DATE) END AS d FROM range(8, 20))
 SELECT s_suppkey AS node_id, major, CASE WHEN major < 10 THEN 'unsupported' WHEN major < 12 THEN 'legacy' WHEN major <= 18 THEN 'supported' ELSE 'newer' END AS tier, CAST(d AS VARCHAR) AS last_day, DATE '2025-11-14' > d AS eol FROM supplier JOIN v ON major = s_suppkey % 12 + 8""",
    "version_findings": f"""WITH s AS (SELECT k % 400 AS cluster_id, {_VERSION} AS v FROM (SELECT c_custkey AS k FROM customer) WHERE k % 17 <> 0 AND k % 60 < 45), t AS (SELECT *, TRY_CAST(regexp_extract(v, '^ *v?([0-9]+)', 1) AS INTEGER) AS a, TRY_CAST(regexp_extract(v, '^ *v?[0-9]+[.]([0-9]+)', 1) AS INTEGER) AS b FROM s),
 u AS (SELECT DISTINCT cluster_id, a, CASE WHEN a >= 10 THEN CAST(a AS VARCHAR) ELSE CAST(a AS VARCHAR) || '.' || CAST(coalesce(b, 0) AS VARCHAR) END AS detail FROM t WHERE a IS NOT NULL), e AS (SELECT CAST(2012 + a AS INTEGER) AS y, * FROM u),
 f AS (SELECT *, a < 10 OR DATE '2024-01-31' > make_date(y, 11, 1) + CAST((4 - isodow(make_date(y, 11, 1)) + 7) % 7 + 7 AS INTEGER) AS ended FROM e)
 SELECT cluster_id, CASE WHEN a < 10 THEN 'critical' WHEN a < 12 THEN 'warning' ELSE 'info' END AS severity, CASE WHEN a < 10 THEN 'pg_unsupported' WHEN a < 12 THEN 'pg_legacy' ELSE 'pg_newer' END AS code, detail FROM f WHERE a < 12 OR a > 18 UNION ALL SELECT cluster_id, 'warning', 'pg_eol', detail FROM f WHERE a >= 10 AND ended""",
    "node_findings": f"""WITH {_NODES}, n AS (SELECT *, bool_or(up) OVER (PARTITION BY cluster_id) AS some_up, CAST(node_id AS VARCHAR) AS detail, conn_used / conn_max AS u, ({_N} - offsite_ok) / {_H} AS b FROM nodes) SELECT cluster_id, 'warning' AS severity, 'node_offline' AS code, detail FROM n WHERE NOT up AND some_up
 UNION ALL SELECT cluster_id, 'critical', 'agent_duplicate', detail FROM n WHERE {_N} - duplicate_at < 900000000 UNION ALL SELECT cluster_id, CASE WHEN u > 0.95 THEN 'critical' ELSE 'warning' END, 'connections', detail FROM n WHERE up AND u > 0.85 UNION ALL SELECT cluster_id, 'info', 'pending_restart', detail FROM n WHERE up AND pending_restart > 0
 UNION ALL SELECT cluster_id, CASE WHEN offsite_ok IS NULL OR b > 48 THEN 'critical' ELSE 'warning' END, 'offsite_behind', detail FROM n WHERE up AND offsite_on AND (offsite_ok IS NULL OR b > 6) UNION ALL SELECT cluster_id, CASE WHEN scheduled THEN 'warning' ELSE 'info' END, 'no_zstd_python', detail FROM n WHERE up AND NOT zstd""",
    "slot_findings": f"WITH {_SLOTS}, {_SLOT_FINDINGS} SELECT * FROM sf",
    "replica_findings": f"WITH {_SLOTS}, r AS (SELECT cluster_id, name, retained_bytes // 8 AS lag FROM slots) SELECT cluster_id, CASE WHEN lag > 1073741824 THEN 'critical' ELSE 'warning' END AS severity, 'repl_lag' AS code, name AS detail FROM r WHERE lag > 67108864",
    "disk_findings": "WITH d AS (SELECT o_custkey % 400 AS cluster_id, CAST(o_custkey AS VARCHAR) || ':d' || CAST(o_orderkey % 3 AS VARCHAR) AS detail, o_orderkey % 101 / 100 AS f FROM orders WHERE o_orderkey % 7 <> 0) SELECT cluster_id, CASE WHEN f < 0.07 THEN 'critical' ELSE 'warning' END AS severity, 'disk' AS code, detail FROM d WHERE f < 0.15",
    "cluster_findings": f"WITH {_CLUSTERS}, {_EFF}, {_CF} SELECT * FROM cf",
    "worker_findings": f"""WITH w AS (SELECT s_suppkey AS k, coalesce({_N} - CASE WHEN s_suppkey % 9 <> 0 THEN {_N} - s_suppkey % 60 * 1000000 END < 45000000, FALSE) AS up, CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 50 / 100 END AS f, [14, 15, 16][1:s_suppkey % 3] AS req, CASE WHEN s_suppkey % 5 <> 0 THEN [13, 14, 15, 16][1:s_suppkey % 4 + 1] ELSE [] END AS inst FROM supplier),
 l AS (SELECT *, 'worker:' || CAST(k AS VARCHAR) AS cluster_id, list_sort(list_filter(req, lambda x: NOT list_contains(inst, x))) AS miss FROM w) SELECT cluster_id, 'critical' AS severity, 'worker_offline' AS code, '' AS detail FROM l WHERE NOT up AND len(req) > 0 UNION ALL SELECT cluster_id, CASE WHEN f < 0.07 THEN 'critical' ELSE 'warning' END, 'worker_disk', '' FROM l WHERE up AND f < 0.15
 UNION ALL SELECT cluster_id, 'warning', 'worker_pg_missing', array_to_string(miss, ',') FROM l WHERE up AND len(miss) > 0""",
    "site_findings": f"""WITH s AS (SELECT c_custkey AS k, (c_custkey % 11 = 0 OR c_custkey % 300 >= 120) AND c_custkey % 3 > 0 AND c_custkey % 2 = c_custkey % 3 AS lost, c_custkey % 13 = 0 AS fo, CASE WHEN c_custkey % 6 <> 0 THEN c_custkey * 1000000 END AS lag, c_custkey % 10 - 8 AS bad, c_custkey % 12 - 9 AS warn FROM customer)
 SELECT k AS cluster_id, 'critical' AS severity, 'geo_primary_lost' AS code, '' AS detail FROM s WHERE lost AND NOT fo UNION ALL SELECT k, 'warning', 'geo_auto_inactive', '' FROM s WHERE k % 4 = 0 AND k % 8 <> 0 UNION ALL SELECT k, 'warning', 'geo_failed_over', '' FROM s WHERE fo
 UNION ALL SELECT k, CASE WHEN bad > 0 THEN 'critical' ELSE 'warning' END, 'geo_dr_readiness', CAST(bad + warn AS VARCHAR) FROM s WHERE bad > 0 OR warn > 0 UNION ALL SELECT k, CASE WHEN lag IS NULL OR lag > 1073741824 THEN 'critical' ELSE 'warning' END, 'geo_replication', '' FROM s WHERE NOT fo AND NOT lost AND (lag IS NULL OR lag > 67108864)""",
    "g6_severity_counts": f"WITH {_SLOTS}, {_SLOT_FINDINGS} SELECT cluster_id, count(*) FILTER (severity = 'info') AS info, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'critical') AS critical FROM sf GROUP BY 1",
    "g9_worst_status": f"WITH {_CLUSTERS}, {_SLOTS}, {_SLOT_FINDINGS}, w AS (SELECT cluster_id, max({_RANK}) AS r FROM sf GROUP BY 1) SELECT c.cluster_id, CASE WHEN up = 0 THEN 3 ELSE coalesce(r, 1) - 1 END AS status FROM clusters c LEFT JOIN w ON w.cluster_id = c.cluster_id",
    "protection": f"""WITH {_CLUSTERS}, {_EFF}, {_CF}, {_POINTS}, w AS (SELECT cluster_id, max({_RANK}) AS r FROM cf WHERE code IN ('no_primary', 'clock_ahead', 'gc_postponed', 'no_backup', 'no_schedule', 'verify_failed', 'backup_stale', 'backup_failed', 'archiver_failing', 'archive_both_set', 'archive_off', 'rpo_target', 'wal_gap', 'wal_branch_tail',
  'backup_server_mismatch', 'wal_spool_failing', 'offsite_behind', 'archiver_lag', 'tablespace_after_full', 'restore_incomplete') GROUP BY 1)
 SELECT c.cluster_id, CASE WHEN sets = 0 AND standby_site THEN 'none' WHEN sets = 0 OR r = 3 OR p.state = 'bad' THEN 'bad' WHEN r = 2 OR p.state IN ('warn', 'unknown') THEN 'warn' ELSE 'ok' END AS protection FROM clusters c LEFT JOIN w ON w.cluster_id = c.cluster_id LEFT JOIN points p ON p.cluster_id = c.cluster_id""",
    "w16_recovery_points": f"WITH {_CLUSTERS}, {_POINTS} SELECT * FROM points",
    "w17_recovery_times": f"""WITH {_CLUSTERS}, d AS (SELECT o_custkey AS cluster_id, {_N} - o_orderkey % 150 * {_D} AS a, o_orderkey % 3000 - 5 AS s, CAST(round(o_totalprice * 100) AS BIGINT) * 900 AS b FROM orders), l AS (SELECT cluster_id, max({{'a': a, 's': s, 'b': b}}) AS d FROM d WHERE s > 0 GROUP BY 1),
 e AS (SELECT c.cluster_id, rto_minutes * 60 AS target, d, CAST(floor(d.s * CASE WHEN d.b > 0 AND size_bytes > 0 THEN greatest(1.0, size_bytes / d.b) ELSE 1.0 END + 0.5) AS BIGINT) AS est FROM clusters c LEFT JOIN l ON l.cluster_id = c.cluster_id)
 SELECT cluster_id, est AS seconds, CASE WHEN d IS NULL THEN 'unknown' WHEN target > 0 AND est > target THEN 'bad' WHEN {_N} - d.a > {90 * _D} THEN 'stale' ELSE 'ok' END AS state FROM e""",
    "m_all_metrics": f"WITH {_METRICS} SELECT * FROM metrics",
    "sk1_text": f"""WITH {_METRICS}, h(metric, help) AS (VALUES {", ".join(f"('fleet_{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in fleet.GAUGES.items())}),
 t AS (SELECT metric, 0 AS place, '# HELP ' || metric || ' ' || help AS line FROM h UNION ALL SELECT metric, 1, '# TYPE ' || metric || ' gauge' FROM h) SELECT * FROM t SEMI JOIN metrics USING (metric)
 UNION ALL SELECT metric, 2, metric || CASE WHEN labels = '' THEN '' ELSE '{{' || regexp_replace(labels, '=([^,]*)', '="\\1"', 'g') || '}}' END || ' ' || CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END FROM metrics""",
    "m_metrics": f"""WITH {_CLUSTERS}, {_SLOTS}, {_SLOT_FINDINGS}, w AS (SELECT cluster_id, max({_RANK}) AS r, count(*) FILTER (severity = 'info') AS info, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'critical') AS critical FROM sf GROUP BY 1),
 a AS (SELECT c.*, CASE WHEN up = 0 THEN 3 ELSE coalesce(r, 1) - 1 END AS status, coalesce(info, 0) AS i, coalesce(warning, 0) AS w, coalesce(critical, 0) AS cr FROM clusters c LEFT JOIN w ON w.cluster_id = c.cluster_id),
 g AS (SELECT name AS cluster, unnest([{{'m': 'cluster_status', 's': NULL, 'v': status::DOUBLE}}, {{'m': 'cluster_nodes', 's': NULL, 'v': nodes::DOUBLE}}, {{'m': 'cluster_nodes_online', 's': NULL, 'v': up::DOUBLE}}, {{'m': 'database_bytes', 's': NULL, 'v': CASE WHEN size_bytes > 0 THEN size_bytes::DOUBLE END}}, {{'m': 'last_backup_timestamp', 's': NULL, 'v': last_backup / 1000000}}, {{'m': 'wal_gaps', 's': NULL, 'v': gap_count::DOUBLE}},
 {{'m': 'findings', 's': 'info', 'v': i::DOUBLE}}, {{'m': 'findings', 's': 'warning', 'v': w::DOUBLE}}, {{'m': 'findings', 's': 'critical', 'v': cr::DOUBLE}}]) AS x FROM a) SELECT 'fleet_' || x.m AS metric, cluster, x.s AS severity, x.v AS value FROM g WHERE x.v IS NOT NULL""",
    "sk1_exposition": "SELECT 'fleet_size{brand=\"' || p_brand || '\",name=\"' || p_name || '\\\"\\\\' || CAST(p_partkey AS VARCHAR) || '\"} ' || CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) || '.5' ELSE CAST(p_size AS VARCHAR) END AS line FROM part WHERE p_partkey % 10 > 1",
    "cluster_status": f"""WITH {_NODES}, l AS (SELECT cluster_id, arg_min(lsn, node_id) AS lead FROM nodes WHERE up AND NOT in_recovery GROUP BY 1), r AS (SELECT n.cluster_id, up, coalesce(dcs_role, CASE WHEN sync_state = 'sync' THEN 's' END, CASE WHEN NOT in_recovery THEN 'primary' END, '') = 'primary' AS p, coalesce(reported_lag, CASE WHEN in_recovery AND lead IS NOT NULL THEN greatest(0, lead - lsn) END) AS lag FROM nodes n LEFT JOIN l ON l.cluster_id = n.cluster_id),
 e AS (SELECT cluster_id, count(*) AS nodes, count(*) FILTER (up) AS up, count(*) FILTER (p AND up) AS leads, max(lag) AS worst_lag FROM r GROUP BY 1) SELECT *, CASE WHEN up = 0 THEN 'down' WHEN leads = 0 OR up < nodes OR coalesce(worst_lag > 67108864, FALSE) THEN 'degraded' ELSE 'healthy' END AS status FROM e""",
    "st5_clock_skews": "SELECT user_id AS node_id, arg_max(CAST((event_id % 100) * 125 AS BIGINT), ts) AS skew_ms FROM events WHERE event_id % 4 > 0 GROUP BY 1",
    "x19_host_digests": """WITH p AS (SELECT DISTINCT c_custkey AS host, unnest(range(0, c_custkey % 30 + 1)) AS k FROM customer), f AS (SELECT host, k % 17 AS m, min(k) AS k FROM p WHERE k % 5 <> 4 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY k) AS n FROM f)
 SELECT host, string_agg('process-' || CAST(m AS VARCHAR), ',' ORDER BY k) AS processes, array_to_string(['w1', 'w2', 'w3', 'w4'][1:least(4, host % 6 + 1)], ',') AS warnings FROM r WHERE n <= 12 GROUP BY host""",
}
QUERIES = {name: globals()[name] for name in SQL}
