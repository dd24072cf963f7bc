"""Fleet state from node snapshots: roles, lag, sites, health findings, objectives and metrics.

``nodes`` has a row for each node with its latest snapshot's fields; what a snapshot does not say is
null, which means unknown and never 0. Times are microseconds, ``now`` is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lsn import SEGMENT_BYTES
from .graphs import components
from .operations import DAY, HOUR, ONLINE_MICROS

MIB, GIB = 1 << 20, 1 << 30
RANKS = ["info", "warning", "critical"]


def clock_skews(reports: DataFrame) -> DataFrame:
    """How far the clock of each node is ahead of the console's, in milliseconds (ST5).

    ``reports(node_id, agent_now, at_time)``: seconds as the node tells them, and microseconds here. The
    newest report of a node that tells a time counts, on a tie the one further ahead.
    """
    skew = F.floor(F.col("agent_now") * 1000 - F.col("at_time") / 1000 + 0.5)
    newest = reports.filter("agent_now IS NOT NULL AND NOT isnan(agent_now)").groupBy("node_id").agg(F.max(F.struct("at_time", skew.alias("skew"))).alias("x"))
    return newest.select("node_id", F.col("x.skew").alias("skew_ms"))


def host_digests(hosts: DataFrame, names: int = 12, warnings: int = 4) -> DataFrame:
    """What a console keeps of each host's discovery (X19): the first distinct process names and the first warnings.

    Names are cut at 20 characters before they are compared and warnings at 200; the limits are the feature.
    """
    short = lambda texts, size: F.transform(texts, lambda t: F.substring(F.trim(t), 1, size))
    seen = F.array_distinct(F.filter(short(F.col("processes"), 20), lambda t: t != ""))
    return hosts.select("host", F.slice(seen, 1, names).alias("processes"), F.slice(short(F.col("warnings"), 200), 1, warnings).alias("warnings"))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in RANKS]), severity).cast("int")


def online(last_seen: Column, now: int) -> Column:
    return F.coalesce(F.lit(now) - last_seen < ONLINE_MICROS, F.lit(False))


def counter_rates(samples: DataFrame) -> DataFrame:
    """Rate of a counter per second, rounded to a tenth (W9, ST3); null for a first sample, a reset or no time between."""
    along = Window.partitionBy("node_id").orderBy("at_time")
    seconds = (F.col("at_time") - F.lag("at_time").over(along)) / 1_000_000
    more = F.col("total") - F.lag("total").over(along)
    return samples.select("node_id", "at_time", F.when((more >= 0) & (seconds > 0), F.floor(more / seconds * 10 + 0.5) / 10).alias("rate"))


def latest_snapshots(reports: DataFrame) -> DataFrame:
    """The last report of each node (ST1)."""
    rest = [c for c in reports.columns if c not in ("node_id", "at_time")]
    return reports.groupBy("node_id").agg(F.max(F.struct("at_time", *rest)).alias("x")).select("node_id", "x.*")


def roles(nodes: DataFrame, now: int) -> DataFrame:
    """Role, lag and state of every node: the cluster manager's role, else the replication state, else the recovery flag.

    Lag is the reported one, else the primary's position less the node's, else null.
    """
    on = online(F.col("last_seen"), now)
    lead = nodes.filter(on & ~F.col("in_recovery")).groupBy("cluster_id").agg(F.min_by("lsn", "node_id").alias("lead_lsn"))
    role = F.coalesce("dcs_role", F.when(F.col("sync_state") == "sync", "sync_standby"), F.when(F.col("in_recovery"), "replica").when(~F.col("in_recovery"), "primary"), F.lit("unknown"))
    lag = F.coalesce("reported_lag", F.when(F.col("in_recovery") & F.col("lead_lsn").isNotNull(), F.greatest(F.lit(0), F.col("lead_lsn") - F.col("lsn"))))
    cpu = F.least(F.lit(100), F.floor(F.col("load") / F.col("ncpu") * 100 + 0.5)).cast("int")
    return nodes.join(lead, "cluster_id", "left").select("node_id", "cluster_id", role.alias("role"), lag.alias("lag"), F.when(on, "online").otherwise("offline").alias("state"), cpu.alias("cpu"))


def cluster_status(derived: DataFrame) -> DataFrame:
    """Per cluster: healthy, or degraded without a lead, with an offline node or a lag of over 64 MiB; down if all are silent."""
    each = derived.groupBy("cluster_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("state") == "online").alias("up"), F.count_if((F.col("role") == "primary") & (F.col("state") == "online")).alias("leads"), F.max("lag").alias("worst_lag"))
    bad = (F.col("leads") == 0) | (F.col("up") < F.col("nodes")) | F.coalesce(F.col("worst_lag") > 64 * MIB, F.lit(False))
    return each.withColumn("status", F.when(F.col("up") == 0, "down").when(bad, "degraded").otherwise("healthy"))


def match_members(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """The node of each member (J7): by its member name, else its own name, in this order."""
    names = nodes.select("cluster_id", "node_id", F.explode(F.array(F.struct(F.lit(0).alias("priority"), F.col("member_name").alias("member")), F.struct(F.lit(1).alias("priority"), F.col("name").alias("member")))).alias("n")).select("cluster_id", "node_id", "n.*")
    hit = names.filter("member IS NOT NULL").groupBy("cluster_id", "member").agg(F.min(F.struct("priority", "node_id")).alias("x"))
    return members.join(hit, ["cluster_id", "member"], "left").select("cluster_id", "member", F.col("x.node_id").alias("node_id"))


def without_agent(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members that no node is known for, each once."""
    known = nodes.select("cluster_id", F.explode(F.array("member_name", "name")).alias("member")).filter("member IS NOT NULL").distinct()
    return members.select("cluster_id", "member").distinct().join(known, ["cluster_id", "member"], "left_anti")


def standby_slots(standbys: DataFrame, slots: DataFrame) -> DataFrame:
    """The slot of each standby on its primary (J9), null where there is none."""
    return standbys.join(slots.select(F.col("node_id").alias("primary_id"), F.col("name").alias("slot"), "active", "retained_bytes"), ["primary_id", "slot"], "left")


def storage_hosts(storages: DataFrame, hosts: DataFrame) -> DataFrame:
    """Hosts behind each storage by any of their aliases (J14): ``aliases`` is an array.

    Storages with the same remote hosts have the same list, which is made once and joined to each of them.
    """
    asked = storages.groupBy("storage_id").agg(F.sort_array(F.collect_set("remote_host")).alias("remote"))
    known = hosts.select("host_id", F.explode("aliases").alias("remote_host")).distinct()
    lists = asked.select("remote").distinct().withColumn("remote_host", F.explode("remote")).join(known, "remote_host")
    lists = lists.groupBy("remote").agg(F.array_join(F.sort_array(F.collect_set(F.col("host_id").cast("string"))), ",").alias("hosts"))
    return asked.join(lists, "remote", "left").select("storage_id", F.coalesce("hosts", F.lit("")).alias("hosts"))


def site_groups(clusters: DataFrame, links: DataFrame, least: int = 2) -> DataFrame:
    """Clusters that share a system identifier or are linked by hand, in groups of at least ``least`` (R7); some opt out."""
    part = clusters.filter("NOT opt_out")
    hub = part.groupBy("system").agg(F.min("cluster_id").alias("hub"))
    same = part.join(hub, "system").filter("hub <> cluster_id").select(F.col("cluster_id").alias("src"), F.col("hub").alias("dst"))
    hand = links.join(part.select(F.col("cluster_id").alias("src")), "src", "left_semi").join(part.select(F.col("cluster_id").alias("dst")), "dst", "left_semi").select("src", "dst")
    found = components(same.unionByName(hand), part.select(F.col("cluster_id").alias("node")))
    big = found.groupBy("root").agg(F.count("*").alias("size")).filter(F.col("size") >= least)
    return found.join(big, "root").select(F.col("node").alias("cluster_id"), F.col("root").alias("group_id"), "size")


def elect(members: DataFrame) -> DataFrame:
    """The primary of each group (R8): failover target, declared, named as upstream, else the first."""
    priority = F.when(F.col("failover_target"), 0).when(F.col("declared"), 1).when(F.col("is_upstream"), 2).otherwise(3)
    return members.groupBy("group_id").agg(F.min(F.struct(priority.alias("priority"), "cluster_id")).alias("x")).select("group_id", F.col("x.cluster_id").alias("primary"), F.col("x.priority").alias("priority"))


def drift(settings: DataFrame, ignored: list[str]) -> DataFrame:
    """Settings (``cluster_id``, ``node_id``, ``name``, ``value``) that differ among two or more nodes."""
    rows = settings.filter(~F.col("name").isin(ignored))
    return rows.groupBy("cluster_id", "name").agg(F.countDistinct("node_id").alias("nodes"), F.countDistinct("value").alias("kinds"), F.array_join(F.sort_array(F.collect_set("value")), ",").alias("found")).filter("nodes >= 2 AND kinds > 1")


def worker_stores(stores: DataFrame) -> DataFrame:
    """Per cluster the workers that hold its storage and the kinds."""
    return stores.groupBy("cluster_id").agg(F.countDistinct("worker_id").alias("workers"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))


def volume_needs(needs: DataFrame, volumes: DataFrame, reserve: float = 0.05) -> DataFrame:
    """Bytes that all work on one file system needs, and whether they fit beside a reserve."""
    sums = needs.groupBy("device").agg(F.sum("bytes").alias("need"), F.count("*").alias("parts"))
    return sums.join(volumes, "device", "left").select("device", "need", "parts", "free", F.when(F.col("free").isNotNull(), F.col("need") <= F.col("free") - F.greatest(F.lit(GIB), (F.col("total") * reserve).cast("long"))).alias("fits"))


def classify_version(major: Column, now_date: Column) -> Column:
    """Tier of a server's major version; past its last day it is end_of_life.

    The last day is the second Thursday of November five years after release; versions below 10 ended on
    2021-11-11 at the latest.
    """
    november = F.make_date(F.lit(2012) + major, F.lit(10), F.lit(31))
    last = F.when(major < 10, F.lit("2021-11-11").cast("date")).otherwise(F.date_add(F.next_day(november, "Thu"), 7))
    tier = F.when(major < 10, "unsupported").when(major < 12, "legacy").when(major <= 18, "supported").otherwise("newer")
    return F.struct(tier.alias("tier"), last.alias("last_day"), (now_date > last).alias("eol"))


def _finding(severity: Column | str, code: str, when: Column, detail: Column | None = None) -> Column:
    level = F.lit(severity) if isinstance(severity, str) else severity
    row = F.struct(level.alias("severity"), F.lit(code).alias("code"), (detail.cast("string") if detail is not None else F.lit("")).alias("detail"))
    return F.when(F.coalesce(when, F.lit(False)), row)


def _worse(bad: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), "critical").otherwise("warning")


def _explode(rows: DataFrame, found: list[Column]) -> DataFrame:
    every = F.filter(F.array(*found), lambda x: x.isNotNull())
    return rows.select("cluster_id", F.explode(every).alias("f")).select("cluster_id", "f.*")


def node_findings(nodes: DataFrame, now: int) -> DataFrame:
    """Findings of single nodes, all in one pass: ``cluster_id``, ``severity``, ``code``, ``detail``."""
    on = online(F.col("last_seen"), now)
    some_up = F.max(on).over(Window.partitionBy("cluster_id"))
    use = F.col("conn_used") / F.when(F.col("conn_max") > 0, F.col("conn_max"))
    behind = (F.lit(now) - F.col("offsite_ok")) / HOUR
    node = F.col("node_id")
    up = nodes.withColumns({"on": on, "some_up": some_up})
    on = F.col("on")
    return _explode(up, [
        _finding("warning", "node_offline", ~on & F.col("some_up"), node),
        _finding("critical", "agent_duplicate", F.lit(now) - F.col("duplicate_at") < 15 * 60_000_000, node),
        _finding(_worse(use > 0.95), "connections", on & (use > 0.85), node),
        _finding("info", "pending_restart", on & (F.col("pending_restart") > 0), node),
        _finding(_worse(F.col("offsite_ok").isNull() | (behind > 48)), "offsite_behind", on & F.col("offsite_on") & (F.col("offsite_ok").isNull() | (behind > 6)), node),
        _finding(F.when(F.col("scheduled"), "warning").otherwise("info"), "no_zstd_python", on & ~F.col("zstd"), node),
    ])


def replica_findings(replicas: DataFrame) -> DataFrame:
    lag = F.col("lag_bytes")
    return _explode(replicas, [_finding(_worse(lag > GIB), "repl_lag", lag > 64 * MIB, F.col("name"))])


def slot_findings(slots: DataFrame) -> DataFrame:
    lost, kept = F.coalesce(F.col("wal_status") == "lost", F.lit(False)), F.col("retained_bytes")
    return _explode(slots, [_finding("critical", "slot_invalidated", lost, F.col("name")), _finding(_worse(kept > 10 * GIB), "slot_stale", ~lost & ~F.col("active") & (kept > GIB), F.col("name"))])


def disk_findings(disks: DataFrame) -> DataFrame:
    free = F.col("free_bytes") / F.when(F.col("total_bytes") > 0, F.col("total_bytes"))
    return _explode(disks, [_finding(_worse(free < 0.07), "disk", free < 0.15, F.concat_ws(":", F.col("node_id").cast("string"), "label"))])


def cluster_findings(clusters: DataFrame, now: int) -> DataFrame:
    """Findings of whole clusters from one row each: primary, backups, schedule, verification, drills, archive and objectives."""
    has, prod, planned = F.col("sets") > 0, F.col("environment") == "prod", F.col("scheduled")
    standby = F.col("standby_site")
    silent = F.lit(now) - F.col("last_news")
    skew = F.coalesce("clock_skew", F.lit(0))
    ahead = (F.col("last_backup") > now + 600_000_000) | (skew > 600_000_000)
    effective = F.when(F.abs(skew) > 600_000_000, F.col("last_backup") - skew).when(ahead, F.col("last_run_ok")).otherwise(F.col("last_backup"))
    expect = F.when(planned, F.least("full_hours", "incr_hours")) * HOUR
    age = F.lit(now) - effective
    no_lead = ~F.col("has_primary") & ~standby
    new = F.col("last_news").isNull() & (F.lit(now) - F.col("enrolled_at") < 15 * 60_000_000)
    verify_base = F.coalesce("last_verify", "last_backup")
    stale_days = F.when(planned & (F.col("drill_days") > 0), 2 * F.col("drill_days")).otherwise(90)
    failing = F.col("last_failed").isNotNull() & (F.col("last_archived").isNull() | (F.col("last_failed") > F.col("last_archived"))) & (F.lit(now) - F.col("last_failed") < 6 * HOUR)
    spool, oldest = F.col("spool_pending"), F.coalesce("spool_age", F.lit(0))
    backlog = F.floor(F.col("current_lsn") / SEGMENT_BYTES) - F.col("archived_segno") - 1
    return _explode(clusters, [
        _finding(F.when(new, "info").when((F.col("up") == 0) & (silent > 3 * DAY) & ~prod, "warning").otherwise("critical"), "no_primary", no_lead),
        _finding(_worse(prod | planned), "no_backup", ~has & ~standby & ~(F.col("last_news").isNull() & (F.col("up") == 0))),
        _finding("warning", "clock_ahead", has & ahead),
        _finding(_worse(age > 4 * expect), "backup_stale", has & (age > 2 * expect)),
        _finding(F.when(prod, "warning").otherwise("info"), "no_schedule", has & ~standby & ~planned),
        _finding(_worse((F.col("failed_runs") >= 3) & (prod | planned)), "backup_failed", F.col("failed_runs") > 0),
        _finding("warning", "gc_postponed", F.col("gc_postponed") >= 5),
        _finding(_worse(prod), "verify_failed", F.col("verify_failed") > 0),
        _finding("info", "verify_stale", planned & (F.col("verify_hours") > 0) & has & (F.lit(now) - verify_base > F.col("verify_hours") * 2 * HOUR)),
        _finding(F.when(prod, "warning").otherwise("info"), "drill_failed", has & ~standby & (F.col("drill_failed") > 0)),
        _finding(F.when(planned & (F.col("drill_days") > 0) & F.col("last_drill").isNotNull(), "warning").otherwise("info"), "drill_stale", prod & has & ~standby & (F.col("drill_failed") == 0) & (F.col("last_drill").isNull() | (F.lit(now) - F.col("last_drill") > stale_days * DAY))),
        _finding("critical", "wal_gap", (F.col("gap_count") > 0) & ~standby),
        _finding("critical", "wal_branch_tail", (F.col("tails") > 0) & ~standby),
        _finding(F.when(F.lit(now) - F.col("conflicts_newest") > 7 * DAY, "warning").otherwise("critical"), "wal_conflict", (F.col("conflicts") > 0) & ~standby),
        _finding("info", "wal_leftovers", (F.coalesce("conflicts", F.lit(0)) == 0) & (F.col("off_history") > 0) & ~standby),
        _finding("critical", "archiver_failing", failing),
        _finding("critical", "wal_spool_failing", F.col("spool_error")),
        _finding(_worse((spool >= 256) | (oldest > 3600)), "wal_spool_behind", ~F.col("spool_error") & ((spool >= 64) | (oldest > 900)) & (spool > 0)),
        _finding(_worse(backlog >= 128), "archiver_lag", backlog >= 16, backlog),
        _finding("warning", "archive_off", planned & (F.col("archive_mode") == "off")),
        _finding("warning", "wal_not_shared", F.col("wal_stores") >= 2),
        _finding(F.when(F.col("has_primary") | standby, "warning").otherwise("critical"), "patroni_paused", F.col("paused")),
    ])


def setup_findings(clusters: DataFrame) -> DataFrame:
    """Findings about how a cluster is set up, from one row each.

    Lists of names: ``plain_agents`` and ``unchecked_agents`` (online nodes that talk in clear or without
    checking), ``members`` and ``known`` (of the cluster manager, of nodes), ``tablespaces`` and
    ``full_tablespaces`` (null: unknown), ``restoring`` and ``busy`` (databases marked as being restored, and
    those that a restore works on), ``repo_stores`` (of online nodes), ``off_server`` (nodes whose backups go
    to another machine than the configured one). Settings: ``archive_library``, ``archive_command``,
    ``last_failed_wal``, ``archive_error``, ``failing``, ``summarize_wal``, ``wal_log_hints``, ``checksums``.
    Cluster manager: ``patroni_ok``, ``patroni_members``, ``use_pg_rewind``, ``local_replication_ok``.
    Objectives: ``rpo_seconds`` with ``rpo_state`` and ``rpo_minutes``, ``rto_seconds`` with ``rto_state`` and
    ``rto_minutes``. Also ``environment``, ``scheduled``, ``incr_hours``, ``standby_site``.
    """
    names = lambda column: F.array_join(F.sort_array(column), ",")
    some = lambda column: F.size(column) > 0
    level = F.when(F.col("environment") == "prod", "warning").otherwise("info")
    orphan, fresh, broken = F.array_except("members", "known"), F.array_except("tablespaces", "full_tablespaces"), F.array_except("restoring", "busy")
    set_ = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    both = set_("archive_library") & set_("archive_command") & (F.trim("archive_command") != "(disabled)")
    hints = F.coalesce(F.col("wal_log_hints") == "on", F.lit(False)) | F.coalesce("checksums", F.lit(False))
    rewind = F.col("patroni_ok") & (F.col("patroni_members") >= 2)
    unusable = F.coalesce("use_pg_rewind", F.lit(False)) & F.col("wal_log_hints").isNotNull() & ~hints
    rpo = (F.col("rpo_minutes") > 0) & F.col("rpo_seconds").isNotNull() & (F.col("rpo_state") != "ok")
    return _explode(clusters, [
        _finding(level, "agent_insecure_transport", some("plain_agents"), F.concat(F.lit("plain:"), names("plain_agents"))),
        _finding(level, "agent_insecure_transport", some("unchecked_agents"), F.concat(F.lit("noverify:"), names("unchecked_agents"))),
        _finding("warning", "node_without_agent", some(orphan), names(orphan)),
        _finding("warning", "tablespace_after_full", some(fresh), names(fresh)),
        _finding("warning", "restore_incomplete", some(broken), names(broken)),
        _finding("critical", "archive_both_set", both),
        _finding("critical", "archiver_history_conflict", F.col("failing") & F.col("last_failed_wal").endswith(".history") & F.col("archive_error").rlike("PGA-WAL-03[13]"), F.col("last_failed_wal")),
        _finding(F.when(F.col("rpo_state") == "bad", "critical").otherwise("warning"), "rpo_target", rpo, F.col("rpo_seconds")),
        _finding("warning", "rto_target", (F.col("rto_minutes") > 0) & (F.col("rto_state") == "bad") & F.col("rto_seconds").isNotNull(), F.col("rto_seconds")),
        _finding("warning", "repo_not_shared", F.size(F.array_distinct(F.array_compact("repo_stores"))) >= 2),
        _finding("warning", "backup_server_mismatch", some("off_server"), names("off_server")),
        _finding("warning", "patroni_rewind", rewind & (~F.coalesce("use_pg_rewind", F.lit(False)) | unusable), F.when(unusable, "hints").otherwise("off")),
        _finding("warning", "patroni_local_replication", ~F.col("local_replication_ok")),
        _finding("info", "summarize_wal_off", (F.col("summarize_wal") == "off") & F.col("scheduled") & (F.col("incr_hours") > 0)),
    ])


def worker_findings(workers: DataFrame, now: int) -> DataFrame:
    """Findings of machines that restores run on: silent, full, or without a major that clusters need.

    ``worker_id``, ``last_seen``, ``free_bytes``, ``total_bytes``, ``installed`` and ``required`` (arrays of majors).
    """
    on = online(F.col("last_seen"), now)
    free = F.col("free_bytes") / F.when(F.col("total_bytes") > 0, F.col("total_bytes"))
    lacking = F.array_except("required", F.coalesce("installed", F.array().cast("array<int>")))
    rows = workers.withColumn("cluster_id", F.concat(F.lit("worker:"), F.col("worker_id").cast("string")))
    return _explode(rows, [
        _finding("critical", "worker_offline", ~on & (F.size("required") > 0)),
        _finding(_worse(free < 0.07), "worker_disk", on & (free < 0.15)),
        _finding("warning", "worker_pg_missing", on & (F.size(lacking) > 0), F.array_join(F.sort_array(lacking), ",")),
    ])


def site_findings(sites: DataFrame, now: int, confirm_seconds: int = 120) -> DataFrame:
    """Findings of pairs of sites: a lost primary, a failover done or open, and replication between them.

    ``cluster_id``, ``primary_seen`` and ``standby_seen`` (times), ``witnesses`` and ``witnesses_lost``,
    ``failed_over``, ``auto``, ``armed``, ``lag_bytes``, ``checks_bad`` and ``checks_warn`` (counts).
    """
    silent = F.coalesce((F.lit(now) - F.col("primary_seen")) / 1_000_000 >= confirm_seconds, F.lit(True))
    lost = silent & (F.col("witnesses") > 0) & (F.col("witnesses_lost") == F.col("witnesses"))
    lag = F.col("lag_bytes")
    return _explode(sites, [
        _finding("critical", "geo_primary_lost", lost & ~F.col("failed_over")),
        _finding("warning", "geo_auto_inactive", F.col("auto") & ~F.col("armed")),
        _finding("warning", "geo_failed_over", F.col("failed_over")),
        _finding(_worse(F.col("checks_bad") > 0), "geo_dr_readiness", (F.col("checks_bad") > 0) | (F.col("checks_warn") > 0), F.col("checks_bad") + F.col("checks_warn")),
        _finding(_worse(lag.isNull() | (lag > GIB)), "geo_replication", ~F.col("failed_over") & ~lost & (lag.isNull() | (lag > 64 * MIB))),
    ])


def version_findings(nodes: DataFrame, now: int, day: Column) -> DataFrame:
    """Findings of the servers' versions, each once for a cluster, code and label; ``day`` is the date of ``now``.

    ``nodes(cluster_id, node_id, last_seen, version)``: texts such as ``16.15 (Ubuntu)``, ``9.6.24`` or
    ``17beta1``; a text that does not begin with a number says nothing, nor does a silent node. Below 10 the
    label has two numbers. Unsupported servers get no further finding on their last day.
    """
    number = lambda k: F.regexp_extract("version", r"^\s*v?(\d+)(?:\.(\d+))?", k)
    on = nodes.filter(online(F.col("last_seen"), now) & (number(1) != "")).withColumn("a", number(1).cast("int"))
    label = F.when(F.col("a") >= 10, F.col("a").cast("string")).otherwise(F.concat_ws(".", F.col("a").cast("string"), F.when(number(2) == "", "0").otherwise(number(2).cast("int").cast("string"))))
    seen = on.select("cluster_id", "a", label.alias("label")).distinct().withColumn("c", classify_version(F.col("a"), day))
    tier = F.col("c.tier")
    return _explode(seen, [
        _finding("critical", "pg_unsupported", tier == "unsupported", F.col("label")),
        _finding("warning", "pg_legacy", tier == "legacy", F.col("label")),
        _finding("info", "pg_newer", tier == "newer", F.col("label")),
        _finding("warning", "pg_eol", (tier != "unsupported") & F.col("c.eol"), F.col("label")),
    ])


def severity_counts(findings: DataFrame) -> DataFrame:
    """Findings per cluster and severity, 0 where there are none."""
    return findings.groupBy("cluster_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in RANKS])


def worst_status(clusters: DataFrame, findings: DataFrame) -> DataFrame:
    """0 healthy, 1 warning, 2 critical, 3 down (G9); informational findings leave a cluster healthy."""
    worst = findings.groupBy("cluster_id").agg(F.max(severity_rank(F.col("severity"))).alias("rank"))
    return clusters.join(worst, "cluster_id", "left").select("cluster_id", F.when(F.col("up") == 0, 3).otherwise(F.greatest(F.lit(0), F.coalesce("rank", F.lit(1)) - 1)).alias("status"))


#: Findings that bear on whether a cluster is protected.
PROTECTION = ["no_primary", "clock_ahead", "gc_postponed", "no_backup", "no_schedule", "verify_failed", "backup_stale", "backup_failed", "archiver_failing", "archive_both_set", "archive_off", "rpo_target", "wal_gap", "wal_branch_tail", "backup_server_mismatch", "wal_spool_failing", "offsite_behind", "archiver_lag", "tablespace_after_full", "restore_incomplete"]


def protection(clusters: DataFrame, findings: DataFrame, points: DataFrame) -> DataFrame:
    """ok, warn, bad or none for each cluster: its sets, the findings that bear on them, and its recovery point (``recovery_points``).

    A standby site without sets of its own is protected on its primary: none.
    """
    worst = findings.filter(F.col("code").isin(PROTECTION)).groupBy("cluster_id").agg(F.max(severity_rank(F.col("severity"))).alias("rank"))
    point = points.select("cluster_id", F.col("state").alias("point"))
    rank, none = F.coalesce("rank", F.lit(0)), F.col("sets") == 0
    state = F.when(none & F.col("standby_site"), "none").when(none | (rank == 3) | (F.col("point") == "bad"), "bad").when((rank == 2) | F.coalesce("point", F.lit("unknown")).isin("warn", "unknown"), "warn").otherwise("ok")
    return clusters.join(worst, "cluster_id", "left").join(point, "cluster_id", "left").select("cluster_id", state.alias("protection"))


def recovery_points(clusters: DataFrame, now: int) -> DataFrame:
    """Seconds of changes at risk in each cluster and how they stand to the objective (W16): null seconds where they have no bound or are unknown."""
    timeout = F.coalesce("archive_timeout", F.lit(0))
    failing = F.col("last_failed").isNotNull() & (F.col("last_archived").isNull() | (F.col("last_failed") > F.col("last_archived")))
    since = F.greatest(F.lit(0.0), (F.lit(now) - F.col("last_archived")) / 1_000_000)
    age = F.greatest(F.lit(0.0), (F.lit(now) - F.col("last_news")) / 1_000_000)
    near = F.floor(F.col("current_lsn") / SEGMENT_BYTES) - F.col("archived_segno") - 1 == 0
    at_start = F.pmod(F.col("current_lsn"), F.lit(SEGMENT_BYTES)) == 0
    bound = F.when(F.coalesce(near, F.lit(False)), F.when(at_start, F.floor(age + 0.5)).when(timeout > 0, F.least(timeout.cast("double"), since)).otherwise(since)).otherwise(F.greatest(since, timeout.cast("double"))) + F.coalesce("spool_age", F.lit(0))
    state = F.when(bound <= F.greatest(timeout, F.lit(60)) * 2, "ok").when(bound <= 3600, "warn").otherwise("bad")
    target = F.col("rpo_minutes") * 60
    state = F.when(target > 0, F.when(bound > target, "bad").when(timeout == 0, "warn").otherwise(state)).otherwise(state)
    known = F.col("has_primary") & (F.col("archive_mode") != "off") & ~failing & F.col("last_archived").isNotNull()
    return clusters.select("cluster_id", F.when(known, F.floor(bound + 0.5).cast("long")).alias("seconds"), F.when(~F.col("has_primary"), "unknown").when(F.col("archive_mode") == "off", "bad").when(failing, "bad").when(F.col("last_archived").isNull(), "warn").otherwise(state).alias("state"))


def recovery_times(clusters: DataFrame, drills: DataFrame, now: int) -> DataFrame:
    """Estimated seconds of a whole restore (W17): the last drill's, scaled to today's size, stale after 90 days."""
    last = drills.filter("seconds > 0").groupBy("cluster_id").agg(F.max(F.struct("at_time", "seconds", "bytes")).alias("d"))
    size = F.col("size_bytes")
    est = F.floor(F.col("d.seconds") * F.when((F.col("d.bytes") > 0) & (size > 0), F.greatest(F.lit(1.0), size / F.col("d.bytes"))).otherwise(1.0) + 0.5).cast("long")
    target = F.col("rto_minutes") * 60
    state = F.when(F.col("d").isNull(), "unknown").when((target > 0) & (est > target), "bad").when(F.lit(now) - F.col("d.at_time") > 90 * DAY, "stale").otherwise("ok")
    return clusters.join(last, "cluster_id", "left").select("cluster_id", est.alias("seconds"), state.alias("state"))


def metrics(clusters: DataFrame, status: DataFrame, counts: DataFrame) -> DataFrame:
    """Gauges in long form: ``metric``, ``labels`` (map), ``value``; what is unknown has no row."""
    rows = clusters.join(status, "cluster_id").join(counts, "cluster_id", "left")
    label = F.create_map(F.lit("cluster"), F.col("name"))
    pairs = [("cluster_status", F.col("status")), ("cluster_nodes", F.col("nodes")), ("cluster_nodes_online", F.col("up")), ("database_bytes", F.when(F.col("size_bytes") > 0, F.col("size_bytes"))), ("last_backup_timestamp", F.col("last_backup") / 1_000_000), ("wal_gaps", F.col("gap_count"))]
    each = [F.when(v.isNotNull(), F.struct(F.lit(f"fleet_{k}").alias("metric"), label.alias("labels"), v.cast("double").alias("value"))) for k, v in pairs]
    each += [F.struct(F.lit("fleet_findings").alias("metric"), F.create_map(F.lit("cluster"), F.col("name"), F.lit("severity"), F.lit(s)).alias("labels"), F.coalesce(F.col(s), F.lit(0)).cast("double").alias("value")) for s in RANKS]
    return rows.select(F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("m")).select("m.*")


#: Name and meaning of each gauge of ``all_metrics``.
GAUGES = {
    "cluster_status": "0 healthy, 1 degraded, 2 critical, 3 down or unknown.", "cluster_findings": "Open findings of a cluster by severity.", "cluster_last_backup_timestamp_seconds": "When the newest good set began.", "cluster_last_full_backup_timestamp_seconds": "When the newest good full set began.",
    "cluster_backup_sets": "Good sets of a cluster.", "cluster_archiver_failed_total": "Failures of the primary's archiver.", "cluster_archiver_last_failed_timestamp_seconds": "The archiver's last failure, 0 for never.", "cluster_wal_gaps": "Holes in the archived log.", "cluster_wal_conflicts": "Divergent copies in quarantine.",
    "cluster_nodes": "Nodes with an agent by state.", "cluster_replication_lag_bytes": "How far each replica is behind.", "cluster_size_bytes": "Bytes of all databases.", "cluster_rpo_seconds": "Bound of what is not archived yet, -1 for none.", "cluster_rto_estimate_seconds": "Recovery time scaled from the last drill.",
    "cluster_rpo_target_seconds": "Objective for lost changes.", "cluster_rto_target_seconds": "Objective for recovery time.", "workers": "Worker hosts by state.", "operations_24h": "Operations of the last day by type and status.", "operations_running": "Operations that are open now.", "findings": "Open findings of all clusters by severity.",
}


def all_metrics(clusters: DataFrame, status: DataFrame, counts: DataFrame, points: DataFrame, times: DataFrame, replicas: DataFrame, workers: DataFrame, operations: DataFrame, now: int) -> DataFrame:
    """All gauges in long form: ``metric``, ``labels``, ``value`` (2.9.2); what is unknown has no row, so that no alert fires on a made-up zero.

    ``clusters`` as for the findings, with ``last_full``, ``archiver_failed`` and ``has_archiver``; ``status``
    (``worst_status``), ``counts`` (``severity_counts``), ``points`` and ``times`` (recovery points and times),
    ``replicas(cluster_id, name, lag_bytes)``, ``workers(last_seen)``, ``operations(type, status, updated_at)``.
    """
    seconds = lambda c: F.floor(F.col(c) / 1_000_000)
    rows = clusters.join(status, "cluster_id").join(counts, "cluster_id", "left").join(points.select("cluster_id", F.col("seconds").alias("rpo"), F.col("state").alias("rpo_state")), "cluster_id", "left").join(times.select("cluster_id", F.col("seconds").alias("rto")), "cluster_id", "left")
    own = [F.lit("cluster"), F.col("name"), F.lit("environment"), F.col("environment"), F.lit("cluster_id"), F.col("cluster_id").cast("string")]
    told, archiver = F.col("sets") > 0, F.col("has_archiver")
    pairs = [
        ("cluster_status", F.col("status"), []), *[("cluster_findings", F.coalesce(F.col(s), F.lit(0)), ["severity", s]) for s in RANKS], ("cluster_last_backup_timestamp_seconds", F.when(told, seconds("last_backup")), []), ("cluster_last_full_backup_timestamp_seconds", F.when(told, seconds("last_full")), []),
        ("cluster_backup_sets", F.col("sets"), []), ("cluster_archiver_failed_total", F.when(archiver, F.col("archiver_failed")), []), ("cluster_archiver_last_failed_timestamp_seconds", F.when(archiver, F.coalesce(seconds("last_failed"), F.lit(0))), []), ("cluster_wal_gaps", F.col("gap_count"), []), ("cluster_wal_conflicts", F.col("conflicts"), []),
        ("cluster_nodes", F.col("up"), ["state", "online"]), ("cluster_nodes", F.col("nodes") - F.col("up"), ["state", "offline"]), ("cluster_size_bytes", F.when(F.col("size_bytes") > 0, F.col("size_bytes")), []), ("cluster_rpo_seconds", F.coalesce("rpo", F.when(F.col("rpo_state") == "bad", -1)), []), ("cluster_rto_estimate_seconds", F.col("rto"), []),
        ("cluster_rpo_target_seconds", F.when(F.col("rpo_minutes") > 0, F.col("rpo_minutes") * 60), []), ("cluster_rto_target_seconds", F.when(F.col("rto_minutes") > 0, F.col("rto_minutes") * 60), []),
    ]
    gauge = lambda name, value, labels: F.struct(F.lit(f"fleet_{name}").alias("metric"), (F.create_map(*labels) if labels else F.create_map().cast("map<string,string>")).alias("labels"), value.cast("double").alias("value"))
    each = [F.when(v.isNotNull(), gauge(k, v, [*own, *map(F.lit, more)])) for k, v, more in pairs]
    of_clusters = rows.select(F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("m")).select("m.*")
    lags = replicas.filter("name IS NOT NULL").join(clusters.select("cluster_id", F.col("name").alias("cluster_name"), "environment"), "cluster_id")
    of_replicas = lags.select(gauge("cluster_replication_lag_bytes", F.coalesce("lag_bytes", F.lit(0)), [F.lit("cluster"), F.col("cluster_name"), *own[2:], F.lit("replica"), F.col("name")]).alias("m")).select("m.*")
    up = F.coalesce(F.lit(now) - F.col("last_seen") < 45_000_000, F.lit(False))
    states = workers.agg(F.count_if(up).alias("on"), F.count_if(~up).alias("off"))
    of_workers = states.select(F.explode(F.array(gauge("workers", F.col("on"), [F.lit("state"), F.lit("online")]), gauge("workers", F.col("off"), [F.lit("state"), F.lit("offline")]))).alias("m")).select("m.*")
    recent = operations.filter(F.col("updated_at") >= now - DAY).groupBy("type", "status").agg(F.count("*").alias("n"))
    of_work = recent.select(gauge("operations_24h", F.col("n"), [F.lit("type"), F.col("type"), F.lit("status"), F.col("status")]).alias("m")).select("m.*")
    running = operations.agg(F.count_if(F.col("status").isin("queued", "leased", "running")).alias("n")).select(gauge("operations_running", F.col("n"), []).alias("m")).select("m.*")
    all_counts = counts.agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in RANKS])
    of_all = all_counts.select(F.explode(F.array(*[gauge("findings", F.col(s), [F.lit("severity"), F.lit(s)]) for s in RANKS])).alias("m")).select("m.*")
    return of_clusters.unionByName(of_replicas).unionByName(of_workers).unionByName(of_work).unionByName(running).unionByName(of_all)


def exposition_text(gauges: DataFrame, about: dict[str, str], prefix: str = "fleet_") -> DataFrame:
    """The whole text of an exposition (SK1): ``metric``, ``place``, ``line``; by these two in order, HELP and TYPE come before a metric's samples."""
    names = F.array(*[F.struct(F.lit(prefix + k).alias("metric"), F.lit(v).alias("help")) for k, v in about.items()])
    there = gauges.select("metric").distinct().join(F.broadcast(gauges.sparkSession.range(1).select(F.explode(names).alias("x")).select("x.*")), "metric")
    heads = there.select("metric", F.explode(F.array(F.struct(F.lit(0).alias("place"), F.concat_ws(" ", F.lit("# HELP"), "metric", "help").alias("line")), F.struct(F.lit(1).alias("place"), F.concat(F.lit("# TYPE "), F.col("metric"), F.lit(" gauge")).alias("line")))).alias("x")).select("metric", "x.*")
    return heads.unionByName(exposition(gauges).select(F.regexp_extract("line", "^[a-z0-9_]+", 0).alias("metric"), F.lit(2).alias("place"), "line"))


def exposition(gauges: DataFrame) -> DataFrame:
    """Gauges as lines of text with escaped labels (SK1); values that are not finite are left out."""
    escaped = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"]), F.lit('"')))
    value = F.when(F.col("value") == F.floor("value"), F.floor("value").cast("long").cast("string")).otherwise(F.col("value").cast("string"))
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    labels = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    return gauges.filter(finite).select(F.concat(F.col("metric"), labels, F.lit(" "), value).alias("line"))
