"""Sites of one database: their view, health, readiness for a takeover, and lost primaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import advice, sites
from . import testbed as T

NOW = T.NOW
SECOND = 1_000_000

#: Three nodes of each cluster and three clusters of each group, as expressions that both engines read; ``c`` is the cluster, ``g`` the group.
_NODE = {
    "cluster_id": "c", "node_id": "k", "name": "concat('n', k)", "last_seen": f"CASE WHEN k % 17 <> 0 AND c % 37 <> 0 THEN {NOW} - k % 50 * {SECOND} END", "in_recovery": "CASE WHEN c = g THEN k % 3 <> 0 WHEN c % 41 = 5 THEN k % 3 <> 0 WHEN k % 23 <> 0 THEN TRUE END",
    "accessible": "c % 5 <> 0", "manager_role": "CASE WHEN c = g AND k % 3 = 0 THEN 'leader' WHEN c <> g AND k % 3 = 1 AND c % 5 <> 0 AND c % 41 <> 5 THEN 'standby_leader' ELSE 'replica' END", "system": "CASE WHEN c % 29 = 3 THEN NULL WHEN c % 31 = 7 THEN concat('z', c) ELSE concat('y', g) END",
    "lsn": "CASE WHEN c = g THEN 9000000000 ELSE 9000000000 - (c % 40 - 2) * 60000000 END", "timeline": "CASE WHEN c <> g AND c % 7 = 1 THEN 1 ELSE 2 END", "replay_at": f"CASE WHEN k % 4 <> 0 THEN {NOW} - k % 1500 * {SECOND} END",
    "receiver_status": "CASE WHEN c <> g AND k % 13 <> 0 THEN CASE WHEN k % 6 = 1 THEN 'waiting' ELSE 'streaming' END END", "receiver_host": "CASE WHEN c <> g THEN concat('vip', g) END", "receiver_port": "5000", "receiver_slot": "concat('geo_', c)", "receiver_silent": "CASE WHEN k % 8 <> 0 THEN k % 150 * 0.5 END",
    "upstream_host": "CASE WHEN c <> g AND c % 5 <> 0 AND c % 41 <> 5 THEN CASE WHEN c % 10 = 3 THEN concat('n', g + 1) ELSE concat('vip', g) END END", "upstream_port": "5000", "upstream_slot": "CASE WHEN c % 4 <> 1 THEN concat('geo_', c) END", "upstream_restore": "c % 2 = 0",
    "major": "CASE WHEN c % 19 = 3 THEN 15 WHEN c % 19 <> 6 THEN 16 END", "archive_mode": "CASE WHEN k % 7 = 0 THEN 'off' WHEN k % 11 = 0 THEN 'Always' WHEN k % 13 <> 1 THEN 'on' END", "archive_command": "CASE WHEN k % 10 = 0 THEN 'cp %p /wal' WHEN k % 10 <> 7 THEN 'tide-wal put %p' END",
    "max_connections": "CASE WHEN k % 6 <> 5 THEN 100 + k % 3 * 50 END", "max_prepared_transactions": "k % 2", "max_locks_per_transaction": "64", "max_wal_senders": "10 - k % 14 * 0", "max_worker_processes": "CASE WHEN c = g THEN 8 ELSE 8 - c % 16 + c % 15 END",
    "use_rewind": "CASE WHEN c % 6 <> 0 THEN k % 9 <> 4 END", "hba_ok": "CASE WHEN k % 8 <> 0 THEN k % 12 <> 1 END", "recovery_restore": "CASE WHEN k % 5 <> 1 THEN k % 4 <> 2 END", "last_failed": f"CASE WHEN k % 4 = 1 THEN {NOW} - k % 5000 * {SECOND} END", "last_archived": f"CASE WHEN k % 3 <> 1 THEN {NOW} - k % 3000 * {SECOND} END",
    "last_backup": f"CASE WHEN k % 5 < 3 THEN {NOW} - k % 240 * {T.HOUR} END",
}
_CLUSTER = {
    "cluster_id": "c", "group_id": "g", "declared_primary": "CASE WHEN c % 11 = 4 THEN c - 3 WHEN c % 11 = 6 THEN g END", "was_site": "c % 2 = 1", "failover_target": "c % 41 = 5 AND c % 2 = 0", "declared": "c = g", "is_upstream": "FALSE", "endpoint": "c % 3 = 0 AND c % 12 <> 0",
}
_GROUP = {"group_id": "g", "auto": "g % 2 = 0", "rpo_target": "CASE WHEN g % 5 <> 0 THEN g % 4 * 15 END", "last_test": f"CASE WHEN g % 3 = 0 AND g % 4 <> 0 THEN {NOW} - g % 400 * {T.DAY} END"}
_BASE = "SELECT *, k - k % 3 AS c, k - k % 9 AS g FROM (SELECT c_custkey AS k FROM customer)"
_SLOT = {"cluster_id": "g", "name": "concat('geo_', c)", "active": "CASE WHEN c % 16 <> 3 THEN c % 8 <> 4 END", "retained_bytes": "CASE WHEN c % 9 <> 0 THEN c * 100000007 % 12000000000 END", "permanent": "CASE WHEN c % 7 <> 0 THEN c % 5 <> 2 END"}


def _columns(fields: dict[str, str]) -> list[str]:
    return [f"{v} AS {k}" for k, v in fields.items()]


def _cte(name: str, fields: dict[str, str], where: str = "TRUE") -> str:
    return f"{name} AS (SELECT DISTINCT {', '.join(_columns(fields))} FROM base WHERE {where})"


def _base(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return T.table(spark, d, "customer").select(k.alias("k"), (k - k % 3).alias("c"), (k - k % 9).alias("g"))


def _view(spark: SparkSession, d: str) -> DataFrame:
    return sites.view(_base(spark, d).selectExpr(*_columns(_NODE)), NOW)


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    base = _base(spark, d)
    return sites.grouped(_view(spark, d), base.selectExpr(*_columns(_CLUSTER)).distinct(), base.filter("c <> g AND c % 13 <> 2").selectExpr(*_columns(_SLOT)).distinct())


def ge_site_view(spark: SparkSession, d: str) -> DataFrame:
    return _view(spark, d).drop("told")


def ge_site_health(spark: SparkSession, d: str) -> DataFrame:
    return sites.health(_grouped(spark, d))


def _checks(spark: SparkSession, d: str) -> DataFrame:
    base = _base(spark, d)
    return sites.readiness(_grouped(spark, d), base.selectExpr("c AS cluster_id", "concat('n', k) AS host"), base.selectExpr(*_columns(_GROUP)).distinct(), NOW)


def ge_readiness(spark: SparkSession, d: str) -> DataFrame:
    return _checks(spark, d)


def ge_readiness_status(spark: SparkSession, d: str) -> DataFrame:
    return sites.status(_checks(spark, d))


_POLICY = {"group_id": "k", "auto": "k % 4 <> 0", "outside": "k % 5 <> 0", "confirm_seconds": "k % 3 * 20000000", "snoozed_until": f"CASE WHEN k % 6 = 0 THEN {NOW} + k % 2 * 2 - 1 END", "failed_over_at": f"CASE WHEN k % 7 = 0 THEN {NOW} - k % 2 * 2 * {T.HOUR} END"}
_VIEW = {"group_id": "user_id", "witness": "CASE WHEN event_id % 2 = 0 THEN 'console' ELSE 'standby' END", "blind": "CASE WHEN event_type = 'click' THEN NULL ELSE event_type <> 'purchase' END"}


def ge_lost_primaries(spark: SparkSession, d: str) -> DataFrame:
    """Events as what two witnesses saw of each user's primary site; customers carry the policies."""
    seen = T.table(spark, d, "events").select(*[F.expr(v).alias(k) for k, v in _VIEW.items()], T.micros("ts").alias("at_time"))
    return sites.lost_primaries(seen, T.table(spark, d, "customer").select(F.col("c_custkey").alias("k")).selectExpr(*_columns(_POLICY)), NOW)


#: What discovery saw on suppliers' hosts, as expressions that both engines read.
_HOST = {"host": "k", "psql": "CASE WHEN k % 5 <> 0 THEN k % 4 <> 0 END", "waldump": "k % 3 <> 0", "zstd": "k % 7 <> 2"}
_INSTANCE = {
    "host": "k % 700", "target": "concat('/d', k)", "running": "CASE WHEN k % 19 <> 0 THEN k % 6 <> 0 END", "owned": "k % 8 = 1", "readable": "CASE WHEN k % 13 <> 0 THEN k % 17 <> 0 END", "archive_mode": "CASE WHEN k % 9 = 0 THEN 'OFF' WHEN k % 9 = 1 THEN '' WHEN k % 9 > 2 THEN 'on' END", "foreign_tool": "CASE WHEN k % 4 = 0 THEN 'other' WHEN k % 4 = 1 THEN '' END",
    "wal_level": "CASE WHEN k % 23 = 0 THEN 'minimal' WHEN k % 23 > 1 THEN 'replica' END", "control": "k % 5 <> 0", "checksums": "CASE WHEN k % 3 <> 0 THEN k % 2 = 0 END", "hints": "CASE WHEN k % 7 > 2 THEN 'on' WHEN k % 7 = 0 THEN 'off' END", "ssl": "CASE WHEN k % 11 < 3 THEN 'off' WHEN k % 11 < 8 THEN 'on' WHEN k % 11 = 8 THEN '' END",
    "fsync": "CASE WHEN k % 29 = 0 THEN 'off' WHEN k % 29 < 20 THEN 'on' END", "full_page_writes": "CASE WHEN k % 31 = 0 THEN 'off' END",
}
_MANAGER = {"host": "k", "scope": "concat('s', k)", "url": "CASE WHEN k % 3 = 0 THEN 'http' WHEN k % 3 = 1 THEN '' END", "reachable": "CASE WHEN k % 4 <> 0 THEN k % 2 = 0 END"}
_STORE = {"host": "k", "name": "concat('e', k)", "members": "CASE WHEN k % 6 <> 5 THEN k % 6 END"}


def host_advice(spark: SparkSession, d: str) -> DataFrame:
    s, c = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), T.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return advice.host_advice(s.selectExpr(*_columns(_HOST)), c.selectExpr(*_columns(_INSTANCE)), s.selectExpr(*_columns(_MANAGER)), s.selectExpr(*_columns(_STORE)))


_ADVICE = [
    ("h", "critical", "NO_PSQL", "'host'", "psql IS NOT TRUE"), ("h", "info", "NO_WALDUMP", "'host'", "waldump IS NOT TRUE"), ("h", "warning", "NO_ZSTD", "'host'", "zstd IS NOT TRUE"),
    ("i", "critical", "UNREADABLE", "target", "readable IS FALSE"), ("i", "warning", "NOT_RUNNING", "target", "running IS NOT TRUE"), ("i", "warning", "ARCHIVE_OFF", "target", "coalesce(archive_mode, '') IN ('', 'OFF')"), ("i", "warning", "ARCHIVE_FOREIGN", "target", "archive_mode = 'on' AND foreign_tool <> ''"),
    ("i", "critical", "WAL_MINIMAL", "target", "wal_level = 'minimal'"), ("i", "info", "NO_CHECKSUMS", "target", "control AND checksums IS NOT TRUE AND hints IS DISTINCT FROM 'on'"), ("i", "warning", "SSL_OFF", "target", "ssl = 'off'"), ("i", "critical", "UNSAFE_DURABILITY", "target", "fsync = 'off' OR full_page_writes = 'off'"),
    ("m", "warning", "PATRONI_REST", "scope", "reachable IS FALSE AND url <> ''"), ("e", "warning", "ETCD_EVEN", "name", "members IN (2, 4)"), ("e", "warning", "ETCD_SINGLE", "name", "members = 1"),
]
_SEEN = ", ".join(f"{x} AS (SELECT {', '.join(_columns(f))} FROM (SELECT {k} AS k FROM {t}))" for x, f, k, t in (("h", _HOST, "s_suppkey", "supplier"), ("i", _INSTANCE, "c_custkey", "customer"), ("m", _MANAGER, "s_suppkey", "supplier"), ("e", _STORE, "s_suppkey", "supplier")))
_TOLD = "{'node_id': node_id, 'lsn': lsn, 'timeline': timeline, 'replay_at': replay_at, 'status': receiver_status, 'host': receiver_host, 'slot': receiver_slot, 'silent': receiver_silent, " + ", ".join(f"'{x}': {x}" for x in sites.LEAD) + "}"
_FIRST = lambda value, when, name: f"arg_min({value}, node_id) FILTER (WHERE {when}) AS {name}"
_SITES = f"""base AS ({_BASE}), {_cte("nodes", _NODE)}, n AS (SELECT *, coalesce({NOW} - last_seen < 45000000, FALSE) AS up FROM nodes),
 e AS (SELECT cluster_id, {_FIRST(_TOLD, "up AND NOT in_recovery", "prim")}, {_FIRST(_TOLD, "up AND manager_role = 'standby_leader'", "led")}, {_FIRST(_TOLD, "up AND receiver_status IS NOT NULL", "receives")}, {_FIRST(_TOLD, "up", "reachable")},
  bool_and(in_recovery IS TRUE AND accessible IS NOT TRUE) FILTER (WHERE up) AS bare, {_FIRST("{'host': upstream_host, 'slot': upstream_slot, 'restore': upstream_restore}", "upstream_host <> ''", "named")},
  {_FIRST("system", "system IS NOT NULL", "system")}, {_FIRST("last_backup", "last_backup IS NOT NULL", "last_backup")} FROM n GROUP BY 1),
 f AS (SELECT *, coalesce(led, plain) AS follows, coalesce(prim, led, plain) AS lead, coalesce(named, CASE WHEN plain.host IS NOT NULL THEN {{'host': plain.host, 'slot': plain.slot, 'restore': FALSE}} END) AS upstream FROM (SELECT *, CASE WHEN prim IS NULL AND bare THEN receives END AS plain FROM e)),
 v AS (SELECT *, CASE WHEN prim IS NOT NULL AND upstream IS NULL THEN 'primary' WHEN upstream IS NOT NULL OR follows IS NOT NULL THEN 'standby' ELSE 'unknown' END AS role FROM f),
 view AS (SELECT cluster_id, role, lead.node_id AS leader, lead IS NOT NULL AS online, lead.lsn AS lsn, lead.timeline AS timeline, system, upstream.host AS up_host, CASE WHEN upstream IS NOT NULL THEN 5000 END AS up_port, upstream.slot AS up_slot, coalesce(upstream.restore, FALSE) AS up_restore, named IS NOT NULL AS up_managed,
  coalesce(follows.status, CASE WHEN role = 'standby' THEN 'none' END) AS receiver, follows.silent AS silent, CASE WHEN follows.replay_at IS NOT NULL THEN greatest(0, floor(({NOW} - follows.replay_at) / 1000000 + 0.5)) END AS replay_delay, coalesce(lead, reachable) AS told, last_backup FROM v)"""
_HEALTH = f"""{_SITES}, {_cte("clusters", _CLUSTER)}, {_cte("slots", _SLOT, "c <> g AND c % 13 <> 2")},
 j AS (SELECT view.* EXCLUDE (role), c.* EXCLUDE (cluster_id), coalesce(o.system <> view.system, FALSE) AS invalid, CASE WHEN o.system <> view.system THEN 'standby' ELSE role END AS role FROM view JOIN clusters c ON c.cluster_id = view.cluster_id LEFT JOIN (SELECT cluster_id, system FROM view) o ON o.cluster_id = declared_primary),
 ch AS (SELECT group_id, arg_min(cluster_id, [CASE WHEN failover_target THEN 0 WHEN declared THEN 1 ELSE 3 END, cluster_id]) AS "primary" FROM j WHERE role = 'primary' GROUP BY 1),
 r AS (SELECT j.*, "primary", coalesce(role = 'primary' AND cluster_id <> "primary", FALSE) AS rival FROM j LEFT JOIN ch ON ch.group_id = j.group_id),
 k AS (SELECT r.*, count(*) FILTER (WHERE rival AND was_site) OVER w AS splits, count(*) FILTER (WHERE rival AND NOT was_site) OVER w AS copies, count(*) FILTER (WHERE role = 'standby') OVER w AS standbys, count(*) OVER w AS members, count(*) FILTER (WHERE role = 'standby' AND up_host IS NOT NULL) OVER w > 0 AS addressed FROM r WINDOW w AS (PARTITION BY group_id)),
 h AS (SELECT k.*, p.lsn AS p_lsn, p.timeline AS p_timeline, p.told AS p_told, s.active AS slot_active, s.retained_bytes AS slot_retained, s.permanent AS slot_permanent, s.name AS slot_name, CASE WHEN role = 'standby' AND NOT invalid AND p.lsn >= k.lsn THEN p.lsn - k.lsn WHEN role = 'standby' AND NOT invalid AND p.lsn < k.lsn THEN 0 END AS lag,
  coalesce(receiver = 'streaming', FALSE) AS streams FROM k LEFT JOIN (SELECT cluster_id, lsn, timeline, told FROM view) p ON p.cluster_id = "primary" LEFT JOIN slots s ON s.cluster_id = "primary" AND s.name = up_slot WHERE NOT (rival AND NOT was_site) AND (members - copies >= 2 OR standbys > 0 OR splits > 0))"""
_ENOUGH = f"coalesce(replay_delay < 600, FALSE) OR coalesce(lag < {64 * sites.MIB}, FALSE)"
_LINK = f"""CASE WHEN role <> 'standby' OR invalid OR (declared_primary IS NOT NULL AND system IS NULL) THEN NULL WHEN NOT online THEN 'bad:unreachable' WHEN timeline < p_timeline AND NOT streams THEN 'bad:older_timeline' WHEN NOT streams AND up_restore AND ({_ENOUGH}) THEN 'warn:from_archive' WHEN NOT streams THEN 'bad:not_receiving' END"""
_PROBLEMS = f"""list_filter([CASE WHEN splits > 0 AND (cluster_id = "primary" OR rival) THEN 'bad:two_primaries' END, {_LINK}, CASE WHEN role <> 'standby' OR (up_restore AND NOT streams) THEN NULL WHEN silent > 120 THEN 'bad:silent' WHEN silent > 30 THEN 'warn:silent' END,
 CASE WHEN lag > {sites.GIB} THEN 'bad:lag' WHEN lag > {64 * sites.MIB} THEN 'warn:lag' END, CASE WHEN role = 'standby' AND up_slot IS NOT NULL AND slot_active IS NOT TRUE THEN 'warn:slot_inactive' END, CASE WHEN role = 'standby' AND slot_retained > {8 * sites.GIB} THEN 'bad:slot_full' END,
 CASE WHEN role = 'standby' AND "primary" IS NULL AND NOT invalid THEN 'warn:no_primary' END, CASE WHEN role = 'standby' AND invalid THEN 'bad:other_database' END, CASE WHEN role = 'standby' AND declared_primary IS NOT NULL AND system IS NULL THEN 'warn:unmeasured' END, CASE WHEN copies > 0 AND cluster_id = "primary" THEN 'warn:copy' END], lambda x: x IS NOT NULL)"""
_MANAGED = "up_managed AND up_restore"
_LOSS = f"CASE WHEN lag = 0 THEN 0 WHEN streams AND silent < 10 AND coalesce(lag, 0) < {16 * sites.MIB} THEN floor(silent + 0.5) ELSE replay_delay END"
_GOAL = "CASE WHEN rpo_target > 0 THEN rpo_target ELSE 60 END"
_STANDBY_CHECKS = {
    "version": "CASE WHEN told.major <> p_told.major THEN 'bad' END", "slot": f"CASE WHEN up_slot IS NULL THEN CASE WHEN {_MANAGED} THEN 'info' ELSE 'warn' END WHEN slot_name IS NULL OR slot_permanent IS FALSE THEN 'bad' ELSE 'ok' END",
    "upstream": "CASE WHEN up_host IN (SELECT n2.name FROM nodes n2 WHERE n2.cluster_id = q.\"primary\") THEN 'warn' WHEN up_host IS NOT NULL THEN 'ok' END", "archive": "CASE WHEN up_managed THEN CASE WHEN up_restore THEN 'ok' ELSE 'warn' END END",
    "standby_archive": "CASE WHEN coalesce(told.archive_mode, '') = '' THEN NULL WHEN lower(told.archive_mode) NOT IN ('on', 'always') THEN 'warn' WHEN contains(coalesce(told.archive_command, ''), 'tide-wal') THEN 'ok' ELSE 'warn' END",
    **{f"param:{x}": f"CASE WHEN told.{x} < p_told.{x} THEN 'bad' END" for x in sites.STANDBY_LEAST},
    "rpo": f"CASE WHEN loss IS NULL THEN CASE WHEN {_MANAGED} THEN 'warn' ELSE 'bad' END WHEN loss > ({_GOAL}) * 10 THEN 'bad' WHEN loss > ({_GOAL}) THEN 'warn' ELSE 'ok' END", "endpoint": "CASE WHEN NOT endpoint THEN 'warn' END", "rewind": "CASE WHEN told.accessible AND told.use_rewind IS NOT TRUE THEN 'warn' END",
    "hba_local": "CASE WHEN NOT told.hba_ok THEN 'bad' END", "dr_endpoint": "CASE WHEN auto THEN CASE WHEN endpoint THEN 'ok' ELSE 'bad' END END",
}
_PRIMARY_CHECKS = {
    "endpoint": "CASE WHEN NOT endpoint AND NOT addressed THEN 'warn' END", "archive_primary": "CASE WHEN told.accessible THEN CASE WHEN told.recovery_restore IS TRUE THEN 'ok' ELSE 'warn' END END", "rewind": "CASE WHEN told.accessible AND told.use_rewind IS NOT TRUE THEN 'warn' END", "hba_local": "CASE WHEN NOT told.hba_ok THEN 'bad' END",
    "archiver": f"CASE WHEN told.last_failed IS NOT NULL AND (told.last_archived IS NULL OR told.last_failed > told.last_archived) AND {NOW} - told.last_failed < {T.HOUR} THEN 'bad' END", "backup": f"CASE WHEN last_backup IS NULL OR {NOW} - last_backup > {8 * T.DAY} THEN 'warn' ELSE 'ok' END",
    "tested": f"CASE WHEN last_test IS NULL OR {NOW} - last_test > {180 * T.DAY} THEN 'info' ELSE 'ok' END",
}
_READY = f"""{_HEALTH}, {_cte("groups", _GROUP)}, q AS (SELECT h.*, auto, rpo_target, last_test, {_LOSS} AS loss FROM h LEFT JOIN groups ON groups.group_id = h.group_id),
 checks AS ({" UNION ALL ".join([f"SELECT group_id, cluster_id, '{i}' AS id, {x} AS level, {'loss' if i == 'rpo' else 'NULL'} AS seconds FROM q WHERE role = 'standby' AND \"primary\" IS NOT NULL" for i, x in _STANDBY_CHECKS.items()] + [f"SELECT group_id, cluster_id, '{i}', {x}, NULL FROM q WHERE cluster_id = \"primary\"" for i, x in _PRIMARY_CHECKS.items()] + ["SELECT DISTINCT group_id, NULL, 'primary', 'bad', NULL FROM q WHERE \"primary\" IS NULL"])})"""

SQL = {
    "host_advice": f"WITH {_SEEN} " + " UNION ALL ".join(f"SELECT host, '{level}' AS severity, '{code}' AS code, {detail} AS detail FROM {x} WHERE {when}" for x, level, code, detail, when in _ADVICE) + " UNION ALL SELECT host, 'warning', 'MULTI_INSTANCE', 'host' FROM i WHERE running AND NOT owned GROUP BY host HAVING count(*) > 1",
    "ge_site_view": f"WITH {_SITES} SELECT * EXCLUDE (told) FROM view",
    "ge_site_health": f"""WITH {_HEALTH}, x AS (SELECT *, {_PROBLEMS} AS found FROM h) SELECT group_id, cluster_id, role, "primary", lag, receiver, replay_delay, array_to_string(found, ',') AS problems, CASE WHEN len(list_filter(found, lambda y: y[1:3] = 'bad')) > 0 THEN 'bad' WHEN len(found) > 0 THEN 'warn' ELSE 'ok' END AS health FROM x""",
    "ge_readiness": f"WITH {_READY} SELECT group_id, cluster_id, id, level, CAST(seconds AS BIGINT) AS seconds FROM checks WHERE level IS NOT NULL",
    "ge_readiness_status": f"WITH {_READY}, t AS (SELECT group_id, count(*) FILTER (WHERE level = 'bad') AS bad, count(*) FILTER (WHERE level = 'warn') AS warn, CAST(max(seconds) AS BIGINT) AS rpo_seconds FROM checks WHERE level IS NOT NULL GROUP BY 1) SELECT *, CASE WHEN bad > 0 THEN 'not_ready' WHEN warn > 0 THEN 'degraded' ELSE 'ready' END AS status FROM t",
    "ge_lost_primaries": f"""WITH s AS (SELECT {", ".join(_columns(_VIEW))}, epoch_us(ts) AS at_time FROM events), u AS (SELECT *, max(CASE WHEN blind IS NOT TRUE THEN at_time END) OVER (PARTITION BY group_id, witness) AS clear_at FROM s WHERE at_time <= {NOW}),
 x AS (SELECT group_id, min(at_time) FILTER (WHERE witness = 'console' AND blind AND (clear_at IS NULL OR at_time > clear_at)) AS console_since, min(at_time) FILTER (WHERE witness = 'standby' AND blind AND (clear_at IS NULL OR at_time > clear_at)) AS standby_since FROM u GROUP BY 1),
 p AS (SELECT {", ".join(_columns(_POLICY))} FROM (SELECT c_custkey AS k FROM customer)),
 y AS (SELECT p.*, x.group_id IS NOT NULL AS heard, console_since, standby_since, CASE WHEN console_since IS NOT NULL AND standby_since IS NOT NULL THEN greatest(console_since, standby_since) END AS down_since FROM p LEFT JOIN x ON x.group_id = p.group_id),
 z AS (SELECT *, CASE WHEN auto AND down_since IS NOT NULL THEN CAST(greatest(0, ceil((down_since + confirm_seconds * 1000000 - {NOW}) / 1000000)) AS BIGINT) END AS act_in FROM y)
 SELECT group_id, console_since, standby_since, down_since, act_in, CASE WHEN NOT heard THEN 'unknown' WHEN console_since IS NULL THEN 'answers_console' WHEN standby_since IS NULL THEN 'still_sends' WHEN NOT auto THEN 'lost' WHEN NOT outside THEN 'waits_for_person' WHEN coalesce(snoozed_until > {NOW}, FALSE) THEN 'snoozed'
  WHEN coalesce({NOW} - failed_over_at < {T.HOUR}, FALSE) THEN 'taken_over' WHEN act_in > 0 THEN 'confirming' ELSE 'take_over' END AS state FROM z""",
}
QUERIES = {name: globals()[name] for name in SQL}
