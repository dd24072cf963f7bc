"""Operation histories, scopes and access rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access, operations, scopes
from . import testbed as T

NOW = T.NOW


def _names(spark: SparkSession) -> DataFrame:
    return spark.range(20).select(F.col("id").alias("cluster_id"), F.concat(F.lit("cluster-"), F.col("id").cast("string")).alias("cluster_name"))


def f1_history(spark: SparkSession, d: str) -> DataFrame:
    return operations.history(T.operations(spark, d), _names(spark), NOW, 24 * 10, "failed", "LOCKED", 5, 40).select("id", "type", "cluster_name", "status", "updated_at", "error")


def f1_search(spark: SparkSession, d: str) -> DataFrame:
    told = T.operations(spark, d).withColumn("created_by", F.concat(F.lit("Person"), (F.col("id") % 7).cast("string")))
    found = operations.search_history(told, _names(spark), NOW - 5 * T.DAY, 90, 3, "all", "PERSON5", 1, 25)
    return found.select("id", "type", "cluster_name", "status", "created_by", "total")


def f3_search(spark: SparkSession, d: str) -> DataFrame:
    entries = _audit(spark, d).withColumns({"cluster_id": F.col("id") % 20, "details": F.concat(F.lit("set "), F.col("id").cast("string"))})
    return operations.search_audit(entries, _names(spark), 4, "all", "SUCCESS", "Set 1", 50).select("id", "category", "outcome", "cluster_name", "total")


def f4_search(spark: SparkSession, d: str) -> DataFrame:
    ev = T.table(spark, d, "events")
    level = F.element_at(F.array(*[F.lit(x) for x in operations.SEVERITIES]), (F.col("event_id") % 5 + 1).cast("int"))
    rows = ev.select("event_id", level.alias("level"), F.col("event_type").alias("service"), F.col("props").alias("message"), F.concat(F.lit("node"), (F.col("user_id") % 3).cast("string")).alias("node_name"), F.lit(None).cast("string").alias("raw"), (F.col("user_id") % 4).alias("cluster_id"))
    return operations.logs(rows, "debug", cluster=2, node="node1").select("event_id", "level")


def f2_slim(spark: SparkSession, d: str) -> DataFrame:
    return operations.slim(T.operations(spark, d), NOW).select("id", "status", "updated_at")


def _audit(spark: SparkSession, d: str) -> DataFrame:
    actions = ["op.patroni_switchover", "op.pg_set_param", "token.create", "op.backup_run", "op.restore_drill", "discovery.scan", "op.checkpoint"]
    statuses = ["ok", "FAILED", "partial", "SUCCEEDED"]
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("event_id") % len(xs) + 1).cast("int"))
    return T.table(spark, d, "events").select(F.col("event_id").alias("id"), T.micros("ts").alias("at_time"), pick(actions).alias("action"), pick(statuses).alias("status"))


def f3_audit(spark: SparkSession, d: str) -> DataFrame:
    return operations.audit(_audit(spark, d), "", 700)


def f4_logs(spark: SparkSession, d: str) -> DataFrame:
    ev = T.table(spark, d, "events")
    level = F.element_at(F.array(*[F.lit(x) for x in operations.SEVERITIES]), (F.col("event_id") % 5 + 1).cast("int"))
    return operations.logs(ev.select("event_id", level.alias("level"), F.col("event_type").alias("service"), F.col("props").alias("message"), F.col("user_id").cast("string").alias("node_name"), F.lit(None).cast("string").alias("raw")), "warning", "click", '": 4').select("event_id", "level", "message")


def f5_online(spark: SparkSession, d: str) -> DataFrame:
    seen = T.table(spark, d, "events").groupBy("user_id").agg(F.max(T.micros("ts")).alias("last_seen"))
    return seen.select("user_id", operations.is_online(F.when(F.col("user_id") % 10 == 0, None).otherwise(F.col("last_seen")), NOW - 7_200_000_000).alias("online"))


def f6_window_start(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    at = lambda n: F.when(k % n == 0, T.micros("ts"))
    return T.table(spark, d, "events").select(k, operations.window_start(at(5), at(3), F.when(k % 2 == 0, k % 100), NOW).alias("start"))


def f7_heavy_hours(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return T.table(spark, d, "events").select(k, operations.heavy_hours(F.floor(T.micros("ts") / T.HOUR) % 24, k % 24, (k * 7) % 24).alias("heavy"))


def f8_masked(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    return T.table(spark, d, "orders").select("o_orderkey", operations.masked(F.concat(F.lit("failed at /var/lib/pg/"), k, F.lit(" with Password=x"), k, F.lit(" token=a b"))).alias("text"))


def f9_refusals(spark: SparkSession, d: str) -> DataFrame:
    return T.operations(spark, d).filter("status = 'failed'").select("id", operations.is_refusal(F.col("type"), F.col("error")).alias("refusal"))


def g7_counts_24h(spark: SparkSession, d: str) -> DataFrame:
    return operations.counts_24h(T.operations(spark, d), NOW)


def g8_failure_groups(spark: SparkSession, d: str) -> DataFrame:
    return operations.failure_groups(T.operations(spark, d), 30)


def b_last_day(spark: SparkSession, d: str) -> DataFrame:
    return operations.last_day(T.operations(spark, d), NOW - 3 * T.DAY)


def j15_unresolved(spark: SparkSession, d: str) -> DataFrame:
    return operations.unresolved(T.operations(spark, d)).select("id", "type", "cluster_id", "updated_at")


def j16_open_verifications(spark: SparkSession, d: str) -> DataFrame:
    ops = T.operations(spark, d).withColumns({"type": F.lit("backup_verify"), "deep": F.col("id") % 7 == 0, "set_id": F.when(F.col("id") % 3 != 0, F.col("id") % 40)})
    return operations.open_verifications(ops.filter("status <> 'succeeded' OR id % 31 = 5"))


def w7_latest(spark: SparkSession, d: str) -> DataFrame:
    return operations.latest(T.operations(spark, d), ["cluster_id", "type"])


def w8_failure_streaks(spark: SparkSession, d: str) -> DataFrame:
    return operations.failure_streaks(T.operations(spark, d))


def w10_kept(spark: SparkSession, d: str) -> DataFrame:
    return operations.kept(T.operations(spark, d), NOW, 7, 150).select("id", "status")


def w12_buckets(spark: SparkSession, d: str) -> DataFrame:
    return T.operations(spark, d).groupBy("cluster_id", operations.bucket(F.col("updated_at"), 6 * T.HOUR).alias("bucket")).agg(F.count("*").alias("n"))


def w13_due(spark: SparkSession, d: str) -> DataFrame:
    policies = spark.range(20).select(F.col("id").alias("cluster_id"), (F.col("id") % 4 * 30 + 1).alias("full_hours"), (F.col("id") % 3 * 10 + 2).alias("incr_hours"), (F.col("id") * 4 + 4).alias("verify_hours"), (F.col("id") % 5 + 1).alias("drill_days"))
    return operations.due(policies, T.operations(spark, d).filter("type <> 'backup_run' OR id % 2 = 0"), NOW)


#: Each column of the planner's inputs, as an expression that both engines read; k is a customer, who stands for a cluster.
_POLICY = {"cluster_id": "k", "enabled": "k % 11 <> 0", "full_hours": "k % 4 * 30 + 1", "incr_hours": "k % 3 * 10", "verify_hours": "k % 7 * 24", "drill_days": "k % 5", "retry_minutes": "30", "window_from": "k % 24", "window_to": "(k + k % 8) % 24"}
_STATE = {
    "cluster_id": "k", "reachable": "k % 13 <> 0", "sets": "k % 6", "set_at": f"CASE WHEN k % 6 > 0 THEN {NOW} - (k % 40 - 2) * {T.HOUR} END", "full_at": f"CASE WHEN k % 6 > 2 THEN {NOW} - (k % 90 - 2) * {T.HOUR} END", "new_tablespaces": "CASE WHEN k % 10 = 3 THEN concat(16384 + k % 7, '-', 16400) WHEN k % 10 = 4 THEN '' END", "standby_away": "k % 4 = 1",
}
_WORK = {
    "id": "id", "type": "type", "cluster_id": "CAST(floor(id / 6) AS BIGINT) % 200 + 1", "status": "CASE WHEN id % 9 = 0 THEN 'cancelled' WHEN status IN ('queued', 'running') AND id % 5 > 0 THEN 'failed' ELSE status END", "run_type": "CASE WHEN work = 0 THEN 'full' ELSE 'incr' END", "created_at": "updated_at - 60000000", "updated_at": "updated_at",
    "key": f"CASE WHEN id % 10 = 7 THEN concat('manual-', id) ELSE concat('sched:', CAST(floor(id / 6) AS BIGINT) % 200 + 1, ':', CASE type WHEN 'backup_run' THEN concat(CASE WHEN work = 0 THEN 'full' WHEN id % 4 = 0 THEN concat('tsfull:', 16384 + (CAST(floor(id / 6) AS BIGINT) % 200 + 1) % 7, '-16400') ELSE 'incr' END, ':', CAST(floor({NOW} / (10 * {T.HOUR})) AS BIGINT), ':', id) WHEN 'backup_expire' THEN concat('expire:', id - 3) WHEN 'backup_verify' THEN concat('verify:', CAST(floor({NOW} / (24 * {T.HOUR})) AS BIGINT)) ELSE concat('drill:', CAST(floor({NOW} / {T.DAY}) AS BIGINT)) END) END",
}
_as = lambda columns: [f"{v} AS {c}" for c, v in columns.items()]
PLAN_HOUR = 5


def w13_plan(spark: SparkSession, d: str) -> DataFrame:
    customers = T.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return operations.plan_work(customers.selectExpr(*_as(_POLICY)), customers.selectExpr(*_as(_STATE)), T.operations(spark, d).selectExpr(*_as(_WORK)), NOW, PLAN_HOUR)


def w14_ring(spark: SparkSession, d: str) -> DataFrame:
    return operations.ring(T.operations(spark, d), 10).select("cluster_id", "id")


def w15_timeline(spark: SparkSession, d: str) -> DataFrame:
    ops = T.operations(spark, d)
    return operations.timeline(ops.filter("id % 2 = 0"), ops.filter("id % 3 = 0").select("id", "updated_at", F.col("error").alias("text")))


def o4_conflicts(spark: SparkSession, d: str) -> DataFrame:
    ops = T.operations(spark, d)
    return operations.conflicts(ops.filter("status = 'failed'").select(F.col("id").alias("request"), "cluster_id", "type", (F.col("id") % 2 == 0).alias("forced")), ops.filter("id % 5 < 2"))


#: Request or operation, cluster, type, status, attempts, dry run, quarantine database, new name, forced.
WORK = [
    (1, 1, "hba_rollback", None, 0, False, None, None, False), (2, 1, "hba_restore", None, 0, False, None, None, False), (3, 2, "restore_promote", None, 0, False, "q1", None, False), (4, 2, "restore_promote", None, 0, False, "q9", None, False), (5, 2, "restore_object", None, 0, False, "q2", None, False), (6, 3, "restore_database", None, 0, False, None, "copy", False), (7, 3, "restore_database", None, 0, False, None, "other", False),
    (8, 4, "patroni_failover", None, 0, False, None, None, False), (9, 4, "patroni_failover", None, 0, False, None, None, True), (10, 5, "patroni_restart", None, 0, False, None, None, False), (11, 5, "pg_restart", None, 0, True, None, None, False), (12, 6, "restore_kept_drop", None, 0, False, None, None, False), (13, 7, "backup_expire", None, 0, False, None, None, False), (14, 8, "geo_promote", None, 0, False, None, None, False), (15, 9, "ephemeral_install", None, 0, False, None, None, False), (16, 9, "restore_plan", None, 0, False, None, None, False),
]
HELD = [
    (101, 1, "hba_restore", "queued", 0, False, None, None), (102, 2, "restore_object", "running", 1, False, "q1", None), (103, 2, "restore_promote", "queued", 0, False, "q2", None), (104, 3, "restore_database", "leased", 1, False, None, "copy"), (105, 4, "restore_db_swap", "running", 1, False, None, None), (106, 5, "archive_enable", "queued", 0, False, None, None), (107, 5, "restore_drill", "succeeded", 1, False, None, None),
    (108, 6, "geo_demote", "queued", 0, False, None, None), (109, 7, "destination_migrate", "running", 1, True, None, None), (110, 8, "geo_archive_fallback", "running", 1, False, None, None), (111, 9, "ephemeral_install", "queued", 0, False, None, None), (112, 9, "backup_expire", "queued", 0, False, None, None), (113, 5, "restore_object", "queued", 2, False, "z", None),
]


def _per_customer(spark: SparkSession, d: str, rows: list[tuple], names: str) -> DataFrame:
    """The small table ``rows`` once for each customer, whose clusters and numbers are its own."""
    kinds = dict(x.split(" ") for x in names.split(", "))
    each = F.explode(F.array(*[F.struct(*[F.lit(v).cast(kind).alias(c) for v, (c, kind) in zip(r, kinds.items(), strict=True)]) for r in rows])).alias("r")
    made = T.dealt(spark, d, "customer", "c_custkey").select("k", each).select("k", "r.*")
    return made.withColumns({c: F.col("k") * by + F.col(c) for c, by in (("cluster_id", 10), ("request", 1000), ("id", 1000)) if c in kinds}).drop("k")


def o4_all_rules(spark: SparkSession, d: str) -> DataFrame:
    """Each rule of the conflicts once or twice in the clusters of every customer."""
    made = _per_customer(spark, d, WORK, "request long, cluster_id long, type string, status string, attempts int, dry_run boolean, stage_db string, new_name string, forced boolean").drop("status", "attempts")
    held = _per_customer(spark, d, HELD, "id long, cluster_id long, type string, status string, attempts int, dry_run boolean, stage_db string, new_name string")
    return operations.conflicts(made, held.withColumn("updated_at", F.col("id")))


def o7_by_parameters(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    kinds = ["restore_database", "restore_instance", "restore_object", "restore_promote", "restore_apply_rows", "wal_retire_branch", "pg_restart", "restore_kept_drop", "checkpoint", "hba_apply"]
    kind = F.element_at(F.array(*[F.lit(x) for x in kinds]), (k % 10 + 1).cast("int"))
    params = {"dry_run": k % 4 == 0, "replace_original": k % 3 == 0, "replace_production": F.when(k % 5 != 0, k % 3 == 1), "keep_archiving": k % 7 == 0, "finish": F.when(k % 3 == 0, "promote").when(k % 3 == 1, "rows_all"), "promote_mode": F.when(k % 8 == 2, "replace").otherwise("as_new"), "mode": F.when(k % 4 == 3, "replace"), "rows": k % 8 == 4}
    return T.table(spark, d, "orders").select("o_orderkey", operations.needs_approval(kind, k % 6 != 5, **params).alias("needed"))


def _queue(spark: SparkSession, d: str) -> DataFrame:
    return T.operations(spark, d).withColumns({"lane": F.col("work"), "attempts": F.when(F.col("id") % 50 == 1, 6).otherwise(F.lit(0)), "submitted_at": F.col("updated_at") - 60_000_000, "ttl_seconds": F.col("id") % 100_000, "lease_until": F.col("updated_at") + 120_000_000})


def o5_admitted(spark: SparkSession, d: str) -> DataFrame:
    return operations.admitted(_queue(spark, d).filter("status = 'queued' OR id % 40 = 3"))


def o6_submissions(spark: SparkSession, d: str) -> DataFrame:
    ops = T.operations(spark, d)
    return operations.submissions(ops.select((F.col("id") % 3000).alias("key"), "id", F.col("updated_at").alias("submitted_at"), F.col("type").alias("request")))


def o7_approvals(spark: SparkSession, d: str) -> DataFrame:
    return T.operations(spark, d).select("id", operations.needs_approval(F.col("type"), F.col("cluster_id") < 5).alias("needed"))


def st9_lease_states(spark: SparkSession, d: str) -> DataFrame:
    return operations.lease_states(_queue(spark, d), NOW)


def x17_prune_requests(spark: SparkSession, d: str) -> DataFrame:
    return operations.prune_requests(T.operations(spark, d), NOW).select("id", "status")


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    c = T.table(spark, d, "customer")
    folder = F.when(F.col("c_custkey") % 5 > 0, F.concat_ws("/", F.concat(F.lit(" r"), (F.col("c_nationkey") % 5).cast("string")), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.lit("")))
    return c.select(F.col("c_custkey").alias("cluster_id"), folder.alias("folder"), F.col("c_mktsegment").alias("environment"))


ASSIGNED = [("global", "", "t1", None, False), ("env", "BUILDING", None, "own-env", False), ("env", "MACHINERY", None, None, True), ("folder", "r1", "t2", "x", False), ("folder", "r1/n6", "missing", None, False), ("folder", "r2/n2", "missing", "fallback", False), ("cluster", "4", None, None, True), ("cluster", "6", "t1", None, False)]
VALUES = [("global", "", "limit", "1"), ("env", "BUILDING", "limit", "2"), ("folder", "r1", "limit", "3"), ("folder", "r1/n6", "path", "/p"), ("cluster", "6", "limit", "9"), ("env", "MACHINERY", "extra", "e")]


def o1_resolve(spark: SparkSession, d: str) -> DataFrame:
    assigned = T.inline(spark, ASSIGNED, "scope string, key string, template string, policy string, disabled boolean")
    return scopes.resolve(_clusters(spark, d), assigned, T.inline(spark, [("t1", "weekly"), ("t2", "daily")], "template string, template_policy string"))


def o2_overlay(spark: SparkSession, d: str) -> DataFrame:
    return scopes.overlay(_clusters(spark, d), T.inline(spark, VALUES, "scope string, key string, field string, value string"), T.inline(spark, [("limit", "0"), ("path", "/d")], "field string, default string"))


def o3_folder_chain(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d).select("cluster_id", F.array_join(scopes.folder_chain(F.col("folder")), "|").alias("chain"))


#: Columns of access rules, as expressions that both engines read; k is a customer, who stands for a server, and r the rule's number.
_RULE = {
    "server": "k", "rule_no": "r", "type": "CASE WHEN r % 3 = 0 THEN 'hostssl' WHEN r = 4 THEN 'hostnossl' WHEN r = 8 THEN 'local' ELSE 'host' END", "database": "CASE (k + r) % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'app' ELSE 'replication' END", "user": "CASE (k + 2 * r) % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'web' ELSE '+dba' END",
    "address": "CASE WHEN r = 7 AND k % 5 = 0 THEN 'db.example' WHEN r = 7 AND k % 5 = 1 THEN '127.0.0.1/32' WHEN r = 8 THEN '' ELSE concat('10.', (k + r) % 2, '.', k % 3, '.7/', (k + r) % 4 * 8 + 8) END", "method": "CASE WHEN r >= 6 AND k % 7 < 3 THEN 'trust' WHEN (k + r) % 5 = 0 THEN 'reject' ELSE 'scram' END",
}
_NEED = {"server": "k", "rule_no": "k * 2 + r", "type": "CASE WHEN k % 2 = 0 THEN 'host' ELSE 'hostssl' END", "database": "CASE r WHEN 1 THEN 'app' ELSE 'replication' END", "user": "'web'", "address": "concat('10.', k % 2, '.', (k + r) % 3, '.9/32')", "method": "'x'"}
_PROBE = {"server": "k", "probe": "k * 4 + r", "database": "CASE WHEN r < 3 THEN 'app' ELSE 'replication' END", "user": "CASE WHEN r % 2 = 0 THEN 'web' ELSE 'ann' END", "ip": "concat('10.', (k + r) % 2, '.', r % 3, '.', k % 100)", "ssl": "k % 2 = 0"}


def _made(spark: SparkSession, d: str, columns: dict[str, str], n: int) -> DataFrame:
    customers = T.dealt(spark, d, "customer", "c_custkey").select("k", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("r"))
    return customers.selectExpr(*[f"{v} AS `{c}`" for c, v in columns.items()])


def _rules(spark: SparkSession, d: str) -> DataFrame:
    return _made(spark, d, _RULE, 8)


def j11_first_match(spark: SparkSession, d: str) -> DataFrame:
    return access.first_match(_made(spark, d, _NEED, 2), _rules(spark, d))


def j12_shadowing(spark: SparkSession, d: str) -> DataFrame:
    return access.shadowing(_rules(spark, d))


def l4_ordered_rules(spark: SparkSession, d: str) -> DataFrame:
    return access.ordered(_rules(spark, d))


def x1_decisions(spark: SparkSession, d: str) -> DataFrame:
    return access.decisions(_made(spark, d, _PROBE, 4), _rules(spark, d), T.inline(spark, [("dba", "ann")], "role string, user string"))


def x2_rule_problems(spark: SparkSession, d: str) -> DataFrame:
    wrong = F.when((F.col("rule_no") == 5) & (F.col("server") % 9 == 0), "10.1.300.7/24").otherwise(F.col("address"))
    return access.problems(_rules(spark, d).withColumn("address", wrong))


def x3_expired_rules(spark: SparkSession, d: str) -> DataFrame:
    o = T.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 < 2, F.concat(F.lit("temporary [until="), F.expr("date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm\")"), F.lit("Z]"))).alias("comment"))
    return access.expired(o, "1999-01-01T00:00").select("o_orderkey", "until")


def x4_access_needs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return access.needs_of(T.table(spark, d, "customer").select((k % 50).alias("server"), F.when(k % 9 == 0, F.concat(F.lit("fe80::"), (k % 100).cast("string"))).otherwise(F.concat(F.lit("10.0.0."), (k % 200).cast("string"))).alias("ip")))


def x7_longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    paths = T.table(spark, d, "customer").select((k % 3).alias("host"), F.concat(F.lit("/srv/n"), (k % 7).cast("string"), F.lit("/data/"), k.cast("string")).alias("path"))
    mounts = T.inline(spark, [(h, m) for h in range(3) for m in ("/", "/srv", "/srv/n1", "/srv/n2/data", "/srv/n10")], "host long, mount string")
    return access.longest_prefix(paths, mounts)


def x8_preferred(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return access.preferred(T.table(spark, d, "orders").select(F.col("o_custkey").alias("node"), (k % 5).alias("priority"), F.concat(F.lit("/usr/pg"), (k % 11).cast("string")).alias("value")), ["node"])


def _sql_rows(rows: list[tuple], names: str) -> str:
    lit = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).upper()
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({names}))"


_CANDIDATES = """cl AS (SELECT c_custkey AS cluster_id, c_nationkey AS n, c_mktsegment AS env, c_custkey % 5 > 0 AS f FROM customer), cand AS (SELECT cluster_id, 0 AS rank, 'cluster' AS scope, CAST(cluster_id AS VARCHAR) AS key FROM cl
 UNION ALL SELECT cluster_id, 1, 'folder', 'r' || CAST(n % 5 AS VARCHAR) || '/n' || CAST(n AS VARCHAR) FROM cl WHERE f UNION ALL SELECT cluster_id, 2, 'folder', 'r' || CAST(n % 5 AS VARCHAR) FROM cl WHERE f UNION ALL SELECT cluster_id, 3, 'env', env FROM cl UNION ALL SELECT cluster_id, 4, 'global', '' FROM cl)"""
_REFUSED = r"(type = 'restore_plan' OR regexp_matches(error, '^refused\b|would lock out|refused before touching|lock.?out', 'i') OR regexp_matches(error, '^PGA-(SEC-030|GEN-03[0-4]|GEN-065|GEN-08[0-8]|GEN-09[34]|PITR-00[12]|PITR-016|RST-03[1-3]|RST-04[01]|WAL-022|INS-002)\b'))"
_PLACE = "CASE WHEN type IN ('backup_run', 'backup_expire') THEN -1 ELSE node_id END"
_OK = f"ok AS (SELECT type, cluster_id, {_PLACE} AS place, work, max(updated_at) AS ok_at FROM operations WHERE status = 'succeeded' GROUP BY ALL)"
_STREAK = "st AS (SELECT cluster_id, type, count(*) AS streak, max(updated_at) AS last_fail FROM (SELECT *, coalesce(max(updated_at) FILTER (status = 'succeeded') OVER (PARTITION BY cluster_id, type), 0) AS ok_at FROM src) WHERE status IN ('failed', 'cancelled') AND updated_at > ok_at GROUP BY 1, 2), streaks AS (SELECT *, CAST(least(1800 * pow(2, streak - 1), 21600) AS BIGINT) AS wait_seconds FROM st)"
_columns = lambda made: ", ".join(f'{v} AS "{c}"' for c, v in made.items())
#: Networks by arithmetic, not from their texts; a host name has none, a local rule needs none.
_RULES = f"""rules AS (SELECT *, CASE WHEN address LIKE '10.%' THEN n - n % (1 << (32 - prefix)) WHEN address LIKE '127%' THEN 2130706433 END AS lo, CASE WHEN address LIKE '10.%' THEN n - n % (1 << (32 - prefix)) + (1 << (32 - prefix)) - 1 WHEN address LIKE '127%' THEN 2130706433 END AS hi, CASE WHEN address LIKE '127%' THEN 32 WHEN address LIKE '10.%' THEN prefix END AS bits FROM (
 SELECT {_columns(_RULE)}, 10 * 16777216 + (k + r) % 2 * 65536 + k % 3 * 256 + 7 AS n, CAST((k + r) % 4 * 8 + 8 AS INTEGER) AS prefix FROM (SELECT c_custkey AS k, unnest(range(1, 9)) AS r FROM customer)))"""
_COVERS = """(a.type = b.type OR a.type = 'host' AND b.type IN ('hostssl', 'hostnossl')) AND (CASE WHEN b.database = 'replication' AND a.type <> 'local' THEN a.database = 'replication' WHEN a.database = 'all' THEN b.database <> 'replication' ELSE a.database = b.database END) AND (a.user = 'all' OR a.user = b.user)
 AND (a.type = 'local' OR coalesce(CASE WHEN a.lo IS NULL OR b.lo IS NULL THEN a.address = b.address ELSE a.lo <= b.lo AND a.hi >= b.hi END, FALSE))"""
_LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)
SQL = {
    "f1_history": f"WITH {T.OPERATIONS} SELECT id, type, 'cluster-' || CAST(cluster_id AS VARCHAR) AS cluster_name, status, updated_at, error FROM operations WHERE status = 'failed' AND updated_at >= {NOW} - 240 * {T.HOUR} AND error LIKE '%locked%' ORDER BY updated_at DESC, id DESC LIMIT 40 OFFSET 5",
    "f1_search": f"""WITH {T.OPERATIONS}, r AS (SELECT id, type, 'cluster-' || CAST(cluster_id AS VARCHAR) AS cluster_name, status, 'Person' || CAST(id % 7 AS VARCHAR) AS created_by, updated_at FROM operations WHERE status IN ('succeeded', 'failed') AND updated_at >= {NOW} - 5 * {T.DAY} - 90 * {T.HOUR} AND cluster_id = 3 AND id % 7 = 5)
 SELECT id, type, cluster_name, status, created_by, (SELECT count(*) FROM r) AS total FROM r ORDER BY updated_at DESC, id DESC LIMIT 25 OFFSET 1""",
    "f3_search": """WITH a AS (SELECT event_id AS id, ts, ['ha_patroni', 'parameters', 'security', 'backup', 'pitr', 'discovery', 'agent'][CAST(event_id % 7 + 1 AS INTEGER)] AS category, 'SUCCESS' AS outcome, 'cluster-4' AS cluster_name FROM events WHERE event_id % 20 = 4 AND event_id % 4 IN (0, 3) AND starts_with(CAST(event_id AS VARCHAR), '1'))
 SELECT id, category, outcome, cluster_name, (SELECT count(*) FROM a) AS total FROM a ORDER BY ts DESC, id DESC LIMIT 50""",
    "f4_search": "SELECT event_id, ['debug', 'info', 'warning', 'error', 'critical'][CAST(event_id % 5 + 1 AS INTEGER)] AS level FROM events WHERE user_id % 4 = 2 AND user_id % 3 = 1",
    "f2_slim": f"WITH {T.OPERATIONS} SELECT id, status, updated_at FROM operations WHERE status IN ('queued', 'running') OR updated_at >= {NOW} - {T.HOUR} ORDER BY updated_at DESC, id DESC LIMIT 200",
    "f3_audit": """WITH a AS (SELECT event_id AS id, epoch_us(ts) AS at_time, ['op.patroni_switchover', 'op.pg_set_param', 'token.create', 'op.backup_run', 'op.restore_drill', 'discovery.scan', 'op.checkpoint'][CAST(event_id % 7 + 1 AS INTEGER)] AS action, ['ha_patroni', 'parameters', 'security', 'backup', 'pitr', 'discovery', 'agent'][CAST(event_id % 7 + 1 AS INTEGER)] AS category,
 ['ok', 'FAILED', 'partial', 'SUCCEEDED'][CAST(event_id % 4 + 1 AS INTEGER)] AS status, ['SUCCESS', 'FAILED', 'WARNING', 'SUCCESS'][CAST(event_id % 4 + 1 AS INTEGER)] AS outcome FROM events) SELECT * FROM a ORDER BY at_time DESC, id DESC LIMIT 700""",
    "f4_logs": "SELECT event_id, ['debug', 'info', 'warning', 'error', 'critical'][CAST(event_id % 5 + 1 AS INTEGER)] AS level, props AS message FROM events WHERE event_id % 5 >= 2 AND event_type = 'click' AND props LIKE '%\": 4%'",
    "f5_online": f"SELECT user_id, CASE WHEN user_id % 10 = 0 THEN FALSE ELSE {NOW - 7_200_000_000} - max(epoch_us(ts)) < 45000000 END AS online FROM events GROUP BY 1",
    "f6_window_start": f"SELECT event_id, coalesce(CASE WHEN event_id % 5 = 0 OR event_id % 3 = 0 THEN epoch_us(ts) - 900000000 END, CASE WHEN event_id % 2 = 0 THEN {NOW} - event_id % 100 * {T.HOUR} END, 0) AS start FROM events",
    "f7_heavy_hours": "WITH h AS (SELECT event_id, hour(ts) AS h, event_id % 24 AS a, event_id * 7 % 24 AS b FROM events) SELECT event_id, a = b OR CASE WHEN a < b THEN h >= a AND h < b ELSE h >= a OR h < b END AS heavy FROM h",
    "f8_masked": "SELECT o_orderkey, 'failed at <path> with Password=*** token=*** b' AS text FROM orders",
    "f9_refusals": f"WITH {T.OPERATIONS} SELECT id, {_REFUSED} AS refusal FROM operations WHERE status = 'failed'",
    "g7_counts_24h": f"WITH {T.OPERATIONS} SELECT type, status, count(*) AS n FROM operations WHERE updated_at >= {NOW - T.DAY} GROUP BY 1, 2",
    "g8_failure_groups": f"""WITH {T.OPERATIONS}, {_OK}, g AS (SELECT type, cluster_id, {_PLACE} AS place, work, regexp_replace(error, '[0-9]+', '#', 'g') AS pattern, count(*) AS n, min(updated_at) AS first, max(updated_at) AS last, arg_max(error, (updated_at, id)) AS error FROM operations WHERE status = 'failed' AND NOT {_REFUSED} GROUP BY 1, 2, 3, 4, 5)
 SELECT g.*, coalesce(ok_at > last, FALSE) AS resolved FROM g LEFT JOIN ok USING (type, cluster_id, place, work) ORDER BY resolved, last DESC, type, cluster_id, place, work, pattern LIMIT 30""",
    "b_last_day": f"""WITH {T.OPERATIONS}, r AS (SELECT *, {_PLACE} AS place FROM operations WHERE updated_at >= {NOW} - 4 * {T.DAY}), ok AS (SELECT type, cluster_id, place, work, max(updated_at) AS ok_at FROM r WHERE status = 'succeeded' GROUP BY ALL)
 SELECT count(*) AS operations, count(*) FILTER (status = 'failed' AND NOT {_REFUSED}) AS failed, count(*) FILTER (status = 'failed' AND NOT {_REFUSED} AND (ok_at IS NULL OR ok_at <= updated_at)) AS unresolved, count(*) FILTER (status = 'failed' AND {_REFUSED}) AS refused,
  count(*) FILTER (type = 'backup_run' AND status = 'succeeded') AS backups FROM r LEFT JOIN ok USING (type, cluster_id, place, work)""",
    "j15_unresolved": f"WITH {T.OPERATIONS}, {_OK} SELECT id, o.type, o.cluster_id, updated_at FROM operations o LEFT JOIN ok ON ok.type = o.type AND ok.cluster_id = o.cluster_id AND ok.work = o.work AND place = CASE WHEN o.type IN ('backup_run', 'backup_expire') THEN -1 ELSE node_id END WHERE status = 'failed' AND (ok_at IS NULL OR ok_at <= updated_at)",
    "j16_open_verifications": f"""WITH {T.OPERATIONS}, v AS (SELECT *, id % 7 = 0 AS deep, CASE WHEN id % 3 <> 0 THEN id % 40 END AS set_id FROM operations WHERE status <> 'succeeded' OR id % 31 = 5)
 SELECT id, cluster_id, set_id, deep, updated_at FROM v f WHERE status = 'failed' AND NOT EXISTS (SELECT 1 FROM v x WHERE x.status = 'succeeded' AND x.cluster_id = f.cluster_id AND x.updated_at > f.updated_at AND (x.deep OR NOT f.deep) AND (x.set_id IS NULL OR x.set_id = f.set_id))""",
    "w7_latest": f"WITH {T.OPERATIONS} SELECT cluster_id, type, arg_max(id, (updated_at, id)) AS id, max(updated_at) AS updated_at FROM operations WHERE status = 'succeeded' GROUP BY 1, 2",
    "w8_failure_streaks": f"WITH {T.OPERATIONS}, src AS (SELECT * FROM operations), {_STREAK} SELECT * FROM streaks",
    "w10_kept": f"""WITH {T.OPERATIONS}, p AS (SELECT arg_max(id, (updated_at, id)) AS id FROM operations WHERE status = 'succeeded' AND type IN ('restore_drill', 'backup_verify') GROUP BY cluster_id, type), s AS (SELECT * FROM operations WHERE status NOT IN ('succeeded', 'failed') OR id IN (SELECT id FROM p) OR updated_at >= {NOW - 7 * T.DAY}),
 t AS (SELECT id, status FROM s WHERE status IN ('succeeded', 'failed') ORDER BY updated_at DESC, id DESC LIMIT 150) SELECT id, status FROM s WHERE status NOT IN ('succeeded', 'failed') UNION ALL SELECT * FROM t""",
    "w12_buckets": f"WITH {T.OPERATIONS} SELECT cluster_id, updated_at // {6 * T.HOUR} AS bucket, count(*) AS n FROM operations GROUP BY 1, 2",
    "w13_due": f"""WITH {T.OPERATIONS}, src AS (SELECT * FROM operations WHERE type <> 'backup_run' OR id % 2 = 0), {_STREAK}, p AS (SELECT range AS cluster_id, range % 4 * 30 + 1 AS fh, range % 3 * 10 + 2 AS ih, range * 4 + 4 AS vh, range % 5 + 1 AS dd FROM range(20)),
 l AS (SELECT cluster_id, max(updated_at) FILTER (type = 'backup_run' AND work = 0) AS f, max(updated_at) FILTER (type = 'backup_run') AS a, max(updated_at) FILTER (type = 'backup_verify') AS v, max(updated_at) FILTER (type = 'restore_drill') AS dr FROM src WHERE status = 'succeeded' GROUP BY 1)
 SELECT p.cluster_id, CASE WHEN coalesce(last_fail + wait_seconds * 1000000 > {NOW}, FALSE) THEN 'wait' WHEN coalesce({NOW} - f >= fh * {T.HOUR}, TRUE) THEN 'full' WHEN coalesce({NOW} - a >= ih * {T.HOUR}, TRUE) THEN 'incr' WHEN coalesce({NOW} - v >= vh * {T.HOUR}, TRUE) THEN 'verify' WHEN coalesce({NOW} - dr >= dd * {T.DAY}, TRUE) THEN 'drill' ELSE 'none' END AS due
 FROM p LEFT JOIN l ON l.cluster_id = p.cluster_id LEFT JOIN streaks s ON s.cluster_id = p.cluster_id AND s.type = 'backup_run'""",
    "w13_plan": f"""WITH {T.OPERATIONS}, cu AS (SELECT c_custkey AS k FROM customer), p AS (SELECT {", ".join(_as(_POLICY))} FROM cu), st AS (SELECT {", ".join(_as(_STATE))} FROM cu), o AS (SELECT {", ".join(_as(_WORK))} FROM operations),
 cal AS (SELECT p.*, st.* EXCLUDE (cluster_id), {PLAN_HOUR} AS h, {NOW} AS now, 'sched:' || p.cluster_id || ':' AS pre FROM p JOIN st USING (cluster_id) WHERE enabled),
 runs AS (SELECT cluster_id, max(created_at) FILTER (created_at <= {NOW} + 300000000) AS run_at, max(created_at) FILTER (run_type = 'full' AND created_at <= {NOW} + 300000000) AS run_full_at, max(updated_at) AS ok_at, arg_max(id, (updated_at, id)) AS ok_id, bool_or(run_type = 'full' AND {NOW} - created_at < 1800000000) AS recent_full FROM o WHERE type = 'backup_run' AND status = 'succeeded' GROUP BY 1),
 c AS (SELECT cal.*, run_at, run_full_at, coalesce(ok_at, 0) AS ok_at, ok_id, coalesce(recent_full, FALSE) AS recent_full, greatest(CASE WHEN set_at <= now + 300000000 THEN set_at END, run_at) AS any_at, greatest(CASE WHEN full_at <= now + 300000000 THEN full_at END, run_full_at) AS f_at, window_from = window_to OR CASE WHEN window_from < window_to THEN h >= window_from AND h < window_to ELSE h >= window_from OR h < window_to END AS heavy,
  EXISTS (SELECT 1 FROM o WHERE o.cluster_id = cal.cluster_id AND status NOT IN ('succeeded', 'failed', 'expired', 'cancelled') AND type IN ({_LIST(operations.PLANNED_ALONE)})) AS open, EXISTS (SELECT 1 FROM o WHERE o.cluster_id = cal.cluster_id AND status NOT IN ('succeeded', 'failed', 'expired', 'cancelled') AND type IN ({_LIST(operations.DISRUPTIVE)})) AS disrupted,
  (SELECT max(updated_at) FROM o WHERE o.cluster_id = cal.cluster_id AND type = 'restore_drill' AND status = 'succeeded' AND updated_at <= {NOW} + 300000000) AS drill_at FROM cal LEFT JOIN runs USING (cluster_id)),
 fl AS (SELECT c.cluster_id, count(*) AS streak, max(updated_at) AS last_fail FROM c JOIN o USING (cluster_id) WHERE type = 'backup_run' AND status IN ('failed', 'cancelled') AND starts_with(key, 'sched:') AND updated_at > ok_at GROUP BY 1),
 k AS (SELECT c.*, coalesce(streak, 0) AS streak, last_fail, now // (full_hours * {T.HOUR}) AS fb, CASE WHEN incr_hours > 0 THEN now // (incr_hours * {T.HOUR}) END AS ib, CASE WHEN verify_hours > 0 THEN now // (verify_hours * {T.HOUR}) END AS vb, CASE WHEN drill_days > 0 THEN now // (drill_days * {T.DAY}) END AS db, (f_at IS NULL OR now - f_at >= full_hours * {T.HOUR}) AND (heavy OR f_at IS NULL) AS need_full FROM c LEFT JOIN fl USING (cluster_id)),
 t AS (SELECT k.*, (SELECT count(*) FROM o WHERE o.cluster_id = k.cluster_id AND starts_with(key, pre || 'full:' || fb)) AS ft, (SELECT count(*) FROM o WHERE o.cluster_id = k.cluster_id AND starts_with(key, pre || 'incr:' || ib)) AS it, (SELECT count(*) FROM o WHERE o.cluster_id = k.cluster_id AND starts_with(key, pre || 'tsfull:' || new_tablespaces)) AS tt,
  EXISTS (SELECT 1 FROM o WHERE o.cluster_id = k.cluster_id AND key = pre || 'expire:' || ok_id) AS ed, EXISTS (SELECT 1 FROM o WHERE o.cluster_id = k.cluster_id AND key = pre || 'verify:' || vb) AS vd, EXISTS (SELECT 1 FROM o WHERE o.cluster_id = k.cluster_id AND key = pre || 'drill:' || db) AS dd FROM k),
 r AS (SELECT *, CASE WHEN NOT reachable OR open THEN 1 WHEN streak > 0 AND now - last_fail < least(retry_minutes * 60000000 * pow(2, greatest(streak - 1, 0)), 21600000000) THEN 2 WHEN coalesce(new_tablespaces, '') <> '' AND NOT recent_full AND tt < 3 AND NOT disrupted THEN 3 WHEN need_full AND NOT disrupted THEN 4
  WHEN NOT need_full AND incr_hours > 0 AND (any_at IS NULL OR now - any_at >= incr_hours * {T.HOUR}) AND NOT (standby_away AND any_at IS NOT NULL AND now - any_at < 3 * incr_hours * {T.HOUR}) AND NOT disrupted THEN 5 WHEN ok_id IS NOT NULL AND NOT ed AND NOT disrupted THEN 6 WHEN verify_hours > 0 AND heavy AND sets > 0 AND NOT vd THEN 7
  WHEN drill_days > 0 AND heavy AND sets > 0 AND (drill_at IS NULL OR now - drill_at >= drill_days * {T.DAY}) AND NOT dd AND NOT disrupted THEN 8 ELSE 9 END AS w FROM t)
 SELECT cluster_id, ['busy', 'wait', 'full', 'full', 'incr', 'expire', 'verify', 'drill', 'none'][w] AS work, CASE w WHEN 3 THEN pre || 'tsfull:' || new_tablespaces || ':' || tt WHEN 4 THEN pre || 'full:' || fb || ':' || ft WHEN 5 THEN pre || 'incr:' || ib || ':' || it WHEN 6 THEN pre || 'expire:' || ok_id WHEN 7 THEN pre || 'verify:' || vb WHEN 8 THEN pre || 'drill:' || db END AS key FROM r""",
    "w14_ring": f"WITH {T.OPERATIONS} SELECT cluster_id, id FROM operations QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY updated_at DESC, id DESC) <= 10",
    "w15_timeline": f"WITH {T.OPERATIONS} SELECT id, updated_at, 0 AS kind, status AS text FROM operations WHERE id % 2 = 0 UNION ALL SELECT id, updated_at, 1, error FROM operations WHERE id % 3 = 0",
    "o4_conflicts": f"""WITH {T.OPERATIONS}, a AS (SELECT * FROM operations WHERE id % 5 < 2 AND status IN ('queued', 'running')), m AS (SELECT n.id AS request, n.cluster_id, o.id AS with_id, o.updated_at AS t, CASE WHEN n.type IN ({_LIST(operations.SINGLE)}) AND o.type = n.type THEN 'singleton' WHEN n.type = 'backup_expire' AND o.type IN ({_LIST(operations.READERS)}) THEN 'reader' WHEN n.type IN ({_LIST(operations.READERS)}) AND o.type = 'backup_expire' THEN 'reader'
 WHEN n.type = 'pg_restart' AND o.type IN ({_LIST(operations.DATA_WORK)}) AND o.status <> 'queued' AND n.id % 2 <> 0 THEN 'interrupts' WHEN n.type IN ({_LIST(operations.DATA_WORK)}) AND o.type = 'pg_restart' THEN 'disrupted' END AS rule FROM operations n JOIN a o USING (cluster_id) WHERE n.status = 'failed')
 SELECT request, cluster_id, arg_min(with_id, (t, with_id)) AS with_id, arg_min(rule, (t, with_id)) AS rule, arg_min(rule, (t, with_id)) = 'interrupts' AS overridable FROM m WHERE rule IS NOT NULL GROUP BY 1, 2""",
    "o4_all_rules": f"SELECT c_custkey * 1000 + request AS request, c_custkey * 10 + cluster_id AS cluster_id, c_custkey * 1000 + with_id AS with_id, rule, overridable FROM customer CROSS JOIN {_sql_rows([(1, 1, 101, 'group', False), (2, 1, 101, 'singleton', False), (3, 2, 102, 'stage', False), (5, 2, 103, 'stage', False), (6, 3, 104, 'name', False), (8, 4, 105, 'interrupts', True), (10, 5, 113, 'interrupts', True), (12, 6, 108, 'disrupted', False), (14, 8, 110, 'group', False), (15, 9, 111, 'singleton', False)], 'request, cluster_id, with_id, rule, overridable')}",
    "o7_by_parameters": """SELECT o_orderkey, k % 6 <> 5 AND CASE k % 10 WHEN 0 THEN k % 3 = 0 WHEN 1 THEN k % 5 <> 0 AND k % 3 = 1 AND k % 4 <> 0 OR k % 7 = 0 WHEN 2 THEN k % 3 = 0 AND k % 8 = 2 OR k % 3 = 1 WHEN 3 THEN k % 4 = 3 WHEN 4 THEN k % 8 = 4 WHEN 5 THEN k % 4 <> 0 WHEN 6 THEN k % 4 <> 0 WHEN 7 THEN TRUE WHEN 8 THEN FALSE ELSE TRUE END AS needed FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)""",
    "o5_admitted": f"WITH {T.OPERATIONS}, q AS (SELECT *, CASE WHEN id % 50 = 1 THEN 6 ELSE 0 END AS attempts FROM operations WHERE status = 'queued' OR id % 40 = 3), busy AS (SELECT DISTINCT cluster_id, work FROM q WHERE status = 'running' OR status = 'queued' AND attempts > 0) SELECT cluster_id, work AS lane, arg_min(id, (updated_at, id)) AS id FROM q ANTI JOIN busy USING (cluster_id, work) WHERE status = 'queued' AND attempts = 0 GROUP BY 1, 2",
    "o6_submissions": f"WITH {T.OPERATIONS} SELECT id % 3000 AS key, arg_min(id, (updated_at, id)) AS id, count(*) AS n, count(DISTINCT type) > 1 AS conflict FROM operations GROUP BY 1",
    "o7_approvals": f"WITH {T.OPERATIONS} SELECT id, cluster_id < 5 AND type = 'pg_restart' AS needed FROM operations",
    "st9_lease_states": f"WITH {T.OPERATIONS}, q AS (SELECT *, CASE WHEN id % 50 = 1 THEN 6 ELSE 0 END AS attempts FROM operations) SELECT id, CASE WHEN status = 'queued' AND {NOW} - CASE WHEN attempts > 0 THEN updated_at ELSE updated_at - 60000000 END > id % 100000 * 1000000 THEN 'expired' WHEN status = 'running' AND updated_at + 120000000 < {NOW} THEN CASE WHEN attempts >= 5 THEN 'failed' ELSE 'queued' END ELSE status END AS status FROM q",
    "x17_prune_requests": f"WITH {T.OPERATIONS} SELECT id, status FROM operations WHERE {NOW} - updated_at < CASE WHEN status = 'queued' THEN {T.DAY} ELSE {7 * T.DAY} END",
    "o1_resolve": f"""WITH {_CANDIDATES}, a AS {_sql_rows(ASSIGNED, "scope, key, template, policy, disabled")}, e AS (SELECT cluster_id, rank, scope, disabled, coalesce(CASE template WHEN 't1' THEN 'weekly' WHEN 't2' THEN 'daily' END, policy) AS p FROM cand JOIN a USING (scope, key)),
 x AS (SELECT cluster_id, arg_min({{'s': scope, 'd': disabled, 'p': p}}, rank) AS x FROM e WHERE disabled OR p IS NOT NULL GROUP BY 1) SELECT cl.cluster_id, CASE WHEN NOT x.d THEN x.p END AS policy, x.s AS source, coalesce(x.d, FALSE) AS disabled FROM cl LEFT JOIN x USING (cluster_id)""",
    "o2_overlay": f"""WITH {_CANDIDATES}, v AS {_sql_rows(VALUES, "scope, key, field, value")}, x AS (SELECT cluster_id, field, arg_min(value, rank) AS value, arg_min(scope, rank) AS source FROM cand JOIN v USING (scope, key) GROUP BY 1, 2), e AS (SELECT cluster_id, unnest(['limit', 'path']) AS field FROM cl)
 SELECT coalesce(x.cluster_id, e.cluster_id) AS cluster_id, coalesce(x.field, e.field) AS field, coalesce(x.value, CASE e.field WHEN 'limit' THEN '0' ELSE '/d' END) AS value, coalesce(x.source, 'default') AS source FROM e FULL JOIN x ON x.cluster_id = e.cluster_id AND x.field = e.field""",
    "o3_folder_chain": "SELECT c_custkey AS cluster_id, CASE WHEN c_custkey % 5 > 0 THEN 'r' || CAST(c_nationkey % 5 AS VARCHAR) || '/n' || CAST(c_nationkey AS VARCHAR) || '|r' || CAST(c_nationkey % 5 AS VARCHAR) ELSE '' END AS chain FROM customer",
    "j11_first_match": f"""WITH {_RULES}, needs AS (SELECT {_columns(_NEED)}, 10 * 16777216 + k % 2 * 65536 + (k + r) % 3 * 256 + 9 AS lo, 10 * 16777216 + k % 2 * 65536 + (k + r) % 3 * 256 + 9 AS hi FROM (SELECT c_custkey AS k, unnest(range(1, 3)) AS r FROM customer)),
 m AS (SELECT b.server, b.rule_no AS need_no, min(a.rule_no) AS rule_no FROM rules a JOIN needs b ON a.server = b.server AND {_COVERS} GROUP BY 1, 2) SELECT n.server, n.rule_no AS need_no, m.rule_no, coalesce(r.method, 'none') AS method FROM needs n LEFT JOIN m ON m.server = n.server AND m.need_no = n.rule_no LEFT JOIN rules r ON r.server = m.server AND r.rule_no = m.rule_no""",
    "j12_shadowing": f"""WITH {_RULES}, p AS (SELECT b.server, b.rule_no, a.rule_no AS w, a.type = b.type AND a.database = b.database AND a.user = b.user AND a.address = b.address AND a.method = b.method AS same, (a.method = 'reject') = (b.method = 'reject') AS alike, {_COVERS} AS covers FROM rules a JOIN rules b ON a.server = b.server AND a.rule_no < b.rule_no)
 SELECT server, rule_no, min(w) AS with_rule, arg_min(CASE WHEN same THEN 'duplicate' WHEN alike THEN 'redundant' ELSE 'shadowed' END, w) AS code FROM p WHERE same OR covers GROUP BY 1, 2""",
    "l4_ordered_rules": f"""WITH {_RULES} SELECT server, rule_no, row_number() OVER (PARTITION BY server ORDER BY CASE type WHEN 'local' THEN 0 WHEN 'hostssl' THEN 1 WHEN 'hostnossl' THEN 2 ELSE 3 END, CASE WHEN type = 'local' THEN 0 ELSE -coalesce(bits, 30) END, method <> 'reject', "user" = 'all', database = 'all', rule_no) AS place FROM rules""",
    "x1_decisions": f"""WITH {_RULES}, probes AS (SELECT {_columns(_PROBE)}, 10 * 16777216 + (k + r) % 2 * 65536 + r % 3 * 256 + k % 100 AS at FROM (SELECT c_custkey AS k, unnest(range(1, 5)) AS r FROM customer)),
 m AS (SELECT p.server, p.probe, r.rule_no, r.method, r.at_in AS hit FROM (SELECT p.*, unnest([1]) FROM probes p) p JOIN LATERAL (SELECT rule_no, method, CASE WHEN lo IS NULL THEN NULL ELSE p.at BETWEEN lo AND hi END AS at_in FROM rules r WHERE r.server = p.server AND (r.type = 'host' OR r.type = 'hostssl' AND p.ssl OR r.type = 'hostnossl' AND NOT p.ssl)
   AND (CASE WHEN p.database = 'replication' THEN r.database = 'replication' ELSE r.database IN ('all', p.database) END) AND (r.user IN ('all', p.user) OR r.user = '+dba' AND p.user = 'ann')) r ON TRUE WHERE r.at_in IS NULL OR r.at_in),
 b AS (SELECT server, probe, min(rule_no) FILTER (hit) AS rule_no, arg_min(method, rule_no) FILTER (hit) AS method, min(rule_no) FILTER (hit IS NULL) AS unknown FROM m GROUP BY 1, 2)
 SELECT p.server, p.probe, b.rule_no, coalesce(b.method, 'refused') AS method, coalesce(unknown < coalesce(b.rule_no, 1 << 30), FALSE) AS uncertain FROM probes p LEFT JOIN b USING (server, probe)""",
    "x2_rule_problems": f"""WITH {_RULES}, w AS (SELECT server, rule_no, type, database, "user", method, CASE WHEN rule_no = 5 AND server % 9 = 0 THEN '10.1.300.7/24' ELSE address END AS address FROM rules),
 x AS (SELECT *, CASE WHEN address LIKE '%.300.%' THEN 'network' WHEN method = 'trust' AND type <> 'local' AND address <> '127.0.0.1/32' THEN 'trust' END AS problem, min(rule_no) OVER (PARTITION BY server, type, database, "user", address, method) AS first FROM w)
 SELECT server, rule_no, problem, CASE WHEN first < rule_no THEN first END AS duplicate_of FROM x WHERE problem IS NOT NULL OR first < rule_no""",
    "x3_expired_rules": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M') AS until FROM orders WHERE o_orderkey % 3 < 2 AND strftime(o_orderdate, '%Y-%m-%dT%H:%M') <= '1999-01-01T00:00'",
    "x4_access_needs": "WITH h AS (SELECT DISTINCT c_custkey % 50 AS server, CASE WHEN c_custkey % 9 = 0 THEN 'fe80::' || CAST(c_custkey % 100 AS VARCHAR) || '/128' ELSE '10.0.0.' || CAST(c_custkey % 200 AS VARCHAR) || '/32' END AS address FROM customer) SELECT server, address, unnest(['replication', 'admin']) AS purpose FROM h",
    "x7_longest_prefix": "SELECT c_custkey % 3 AS host, '/srv/n' || CAST(c_custkey % 7 AS VARCHAR) || '/data/' || CAST(c_custkey AS VARCHAR) AS path, CASE c_custkey % 7 WHEN 1 THEN '/srv/n1' WHEN 2 THEN '/srv/n2/data' ELSE '/srv' END AS mount FROM customer",
    "x8_preferred": "SELECT o_custkey AS node, arg_min('/usr/pg' || CAST(o_orderkey % 11 AS VARCHAR), (o_orderkey % 5, '/usr/pg' || CAST(o_orderkey % 11 AS VARCHAR))) AS value, min(o_orderkey % 5) AS priority FROM orders GROUP BY 1",
}
QUERIES = {name: globals()[name] for name in SQL}
