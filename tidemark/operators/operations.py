"""Operation histories: queries, grouping, retention, lanes and plans.

``operations(id, type, cluster_id, node_id, status, updated_at, error, work, ...)`` with times in
microseconds; ``now`` is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR, DAY = 3_600_000_000, 86_400_000_000
TERMINAL = ["succeeded", "failed", "expired", "cancelled"]
ACTIVE = ["queued", "leased", "running"]
#: Kinds whose latest success is kept as evidence, and rows that outlive any retention at most.
EVIDENCE, HARD_CAP = ["restore_drill", "backup_verify"], 5000
#: Silence after which a node is offline, ring lengths, attempts, page size, severity order.
ONLINE_MICROS, RING, MAX_ATTEMPTS, PAGE = 45_000_000, 400, 5, 500
SEVERITIES = ["debug", "info", "warning", "error", "critical"]
#: Texts and codes of errors that are refusals.
REFUSAL_TEXT = r"(?i)^refused\b|would lock out|refused before touching|lock.?out"
REFUSAL_CODES = r"^PGA-(SEC-030|GEN-03[0-4]|GEN-065|GEN-08[0-8]|GEN-09[34]|PITR-00[12]|PITR-016|RST-03[1-3]|RST-04[01]|WAL-022|INS-002)\b"
#: Fixed values of the planner: work that a cluster has one at a time, how far ahead a clock may be, how long a full for new tablespaces holds, tries for it.
PLANNED_ALONE = ["backup_run", "backup_verify", "backup_expire", "restore_instance", "restore_database", "restore_object", "restore_promote", "restore_drill"]
AHEAD, FULL_HOLDS, TABLESPACE_TRIES, LONGEST_WAIT = 300_000_000, 1_800_000_000, 3, 21_600_000_000
#: Fixed values of the conflict rules: work that reads backup sets, work on data, work that interrupts it, work of which a cluster has one at a time, work on one and the same thing.
READERS = ["restore_instance", "restore_database", "restore_object", "restore_drill", "backup_verify"]
DATA_WORK = ["backup_run", "backup_expire", "destination_migrate", "destination_drop_old", "restore_instance", "restore_database", "restore_object", "restore_promote", "restore_drill", "restore_apply_rows", "archive_enable", "restore_db_swap", "restore_kept_drop"]
DISRUPTIVE = ["pg_restart", "patroni_switchover", "patroni_failover", "patroni_restart", "patroni_reinit", "geo_promote", "geo_demote"]
SINGLE = ["pg_restart", "backup_run", "backup_expire", "destination_migrate", "destination_drop_old", "backup_verify", "archive_enable", "restore_instance", "restore_drill", "patroni_switchover", "patroni_failover", "patroni_pause", "patroni_config_patch", "hba_apply", "ephemeral_install", "geo_promote", "geo_demote"]
GROUPS = [["hba_apply", "hba_restore", "hba_expire", "hba_rollback"], ["geo_archive_fallback", "geo_promote", "geo_demote"]]
#: Work that needs a second person whatever its parameters are.
RISKY = ["hba_cluster_apply", "hba_apply", "hba_rollback", "hba_restore", "pg_set_param", "patroni_switchover", "patroni_failover", "patroni_restart", "pg_restart", "patroni_reinit", "archive_enable", "patroni_config_patch", "patroni_pause", "ephemeral_install", "geo_promote", "geo_demote", "geo_switchover", "restore_db_swap", "destination_apply", "destination_drop_old", "restore_kept_drop"]


def history(operations: DataFrame, names: DataFrame, now: int, hours: int, status: str = "", text: str = "", offset: int = 0, limit: int = PAGE) -> DataFrame:
    """Finished work of the last hours, newest first, one page (F1, L3); ``failed`` includes expired ones."""
    low = text.lower()
    rows = operations.filter(F.col("status").isin(TERMINAL) & (F.col("updated_at") >= now - hours * HOUR)).join(names, "cluster_id", "left")
    if status:
        rows = rows.filter(F.col("status").isin(["failed", "expired"] if status == "failed" else [status]))
    if low:
        rows = rows.filter(F.lower(F.concat_ws(" ", "type", "cluster_name", "error")).contains(low))
    return rows.orderBy(F.desc("updated_at"), F.desc("id")).offset(max(0, offset)).limit(min(max(limit, 1), PAGE))


def with_total(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of ``rows``, each with the ``total`` of all pages."""
    page = rows.orderBy(*order).offset(max(0, offset)).limit(limit)
    return page.join(F.broadcast(rows.agg(F.count("*").alias("total"))))


def search_history(operations: DataFrame, names: DataFrame, now: int, hours: float = 0, cluster: int | None = None, status: str = "all", text: str = "", offset: int = 0, limit: int = 100, days: int = 7) -> DataFrame:
    """``history`` with all its filters and the total before paging (F1).

    ``hours`` lies between one and the retention (0: all of it); ``status`` is all, failed (expired ones
    too) or succeeded; ``text`` is looked for in type, name, error and who asked (``created_by``).
    """
    hours = min(max(hours or days * 24, 1), days * 24)
    rows = operations.filter(F.col("status").isin(TERMINAL) & (F.col("updated_at") >= now - int(hours * HOUR)))
    if cluster is not None:
        rows = rows.filter(F.col("cluster_id") == cluster)
    if status in ("failed", "succeeded"):
        rows = rows.filter(F.col("status").isin(["failed", "expired"] if status == "failed" else [status]))
    rows = rows.join(names, "cluster_id", "left")
    if text:
        found = F.lit(False)
        for c in ("type", "cluster_name", "error", "created_by"):
            found = found | F.lower(F.coalesce(c, F.lit(""))).contains(text.lower())
        rows = rows.filter(found)
    return with_total(rows, [F.desc("updated_at"), F.desc("id")], offset, min(max(limit, 1), PAGE))


def slim(operations: DataFrame, now: int, recent: int = HOUR, most: int = 200) -> DataFrame:
    """Open work and what ended recently, the last ``most`` (F2)."""
    return operations.filter(~F.col("status").isin(TERMINAL) | (F.col("updated_at") >= now - recent)).orderBy(F.desc("updated_at"), F.desc("id")).limit(most)


def audit_category(action: Column) -> Column:
    """First pattern that fits."""
    inner = F.when(action.rlike("backup"), "backup").otherwise("pitr")
    return (
        F.when(action.rlike("patroni|switchover|failover"), "ha_patroni").when(action.rlike("set_param|parameter|reload"), "parameters").when(action.rlike(r"^(auth|token|node\.revoke)"), "security")
        .when(action.rlike("backup|restore|pitr|wal|verify"), inner).when(action.rlike("discovery"), "discovery").otherwise("agent")
    )


def audit_rows(entries: DataFrame) -> DataFrame:
    outcome = F.when(F.upper("status").isin("OK", "SUCCEEDED", "SUCCESS"), "SUCCESS").when(F.upper("status").rlike("FAIL|ERROR"), "FAILED").otherwise("WARNING")
    return entries.withColumn("category", audit_category(F.col("action"))).withColumn("outcome", outcome)


def audit(entries: DataFrame, category: str = "", limit: int = 100) -> DataFrame:
    """Audit entries with category and outcome, newest first."""
    rows = audit_rows(entries)
    return (rows.filter(F.col("category") == category) if category else rows).orderBy(F.desc("at_time"), F.desc("id")).limit(min(limit, 1000))


def search_audit(entries: DataFrame, names: DataFrame, cluster: int | None = None, category: str = "all", status: str = "all", text: str = "", limit: int = 100) -> DataFrame:
    """``audit`` with all its filters and the total before the limit (F3): by cluster, category, outcome, and text in action, details or cluster name."""
    rows = audit_rows(entries)
    for column, wanted in (("cluster_id", cluster), ("category", None if category == "all" else category), ("outcome", None if status == "all" else status)):
        if wanted is not None:
            rows = rows.filter(F.col(column) == wanted)
    rows = rows.join(names, "cluster_id", "left")
    if text:
        found = F.lit(False)
        for c in ("action", "details", "cluster_name"):
            found = found | F.lower(F.coalesce(c, F.lit(""))).contains(text.lower())
        rows = rows.filter(found)
    return with_total(rows, [F.desc("at_time"), F.desc("id")], 0, min(limit, 1000))


def logs(entries: DataFrame, least: str = "info", service: str = "all", text: str = "", cluster: int | None = None, node: str = "all") -> DataFrame:
    """Log lines of at least a severity, of a service, cluster and node, with a text in them (F4, ST6); works on streams too."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("level"))
    rows = entries.filter(rank >= SEVERITIES.index(least) + 1)
    if service != "all":
        rows = rows.filter(F.col("service") == service)
    if cluster is not None:
        rows = rows.filter(F.col("cluster_id") == cluster)
    if node != "all":
        rows = rows.filter(F.col("node_name") == node)
    return rows.filter(F.lower(F.concat_ws(" ", "message", "node_name", "raw")).contains(text.lower())) if text else rows


def is_online(last_seen: Column, now: int) -> Column:
    """Heard of within 45 seconds; never heard of is offline."""
    return last_seen.isNotNull() & (F.lit(now) - last_seen < ONLINE_MICROS)


def window_start(explicit: Column, last_backup: Column, hours: Column, now: int, margin: int = 900_000_000) -> Column:
    """Where a search begins."""
    return F.coalesce(explicit - margin, last_backup - margin, F.lit(now) - hours * HOUR, F.lit(0).cast("long"))


def heavy_hours(hour: Column, start: Column, end: Column) -> Column:
    """Whether an hour of the day is in [start, end), which may pass midnight; equal ends are always."""
    return (start == end) | F.when(start < end, (hour >= start) & (hour < end)).otherwise((hour >= start) | (hour < end))


def masked(text: Column) -> Column:
    """Secrets and paths in a text replaced (F8)."""
    return F.regexp_replace(F.regexp_replace(text, r"(?i)(password|secret|token)=\S+", "$1=***"), r"/(?:[\w.-]+/)+[\w.-]*", "<path>")


def is_refusal(kind: Column, error: Column) -> Column:
    """Failures that are refusals (F9): a check said no before anything was changed, or a plan's answer is no."""
    return (kind == "restore_plan") | F.coalesce(error.rlike(REFUSAL_TEXT) | error.rlike(REFUSAL_CODES), F.lit(False))


def counts_24h(operations: DataFrame, now: int) -> DataFrame:
    return operations.filter(F.col("updated_at") >= now - DAY).groupBy("type", "status").agg(F.count("*").alias("n"))


def error_pattern(error: Column) -> Column:
    return F.substring(F.regexp_replace(error, r"[0-9A-F]{24}|\d{8}-\d{6}[FDI]?|\d+", "#"), 1, 120)


def _same_place() -> Column:
    return F.when(F.col("type").isin("backup_run", "backup_expire"), F.lit(-1)).otherwise(F.col("node_id"))


def failure_groups(operations: DataFrame, most: int = 8) -> DataFrame:
    """Failures of one kind as one line with a count, and whether the same work succeeded later."""
    work = ["type", "cluster_id", "place", "work"]
    placed = operations.withColumn("place", _same_place())
    ok = placed.filter("status = 'succeeded'").groupBy(*work).agg(F.max("updated_at").alias("ok_at"))
    failed = placed.filter("status = 'failed'").filter(~is_refusal(F.col("type"), F.col("error")))
    groups = failed.groupBy(*work, error_pattern(F.col("error")).alias("pattern")).agg(F.count("*").alias("n"), F.min("updated_at").alias("first"), F.max("updated_at").alias("last"), F.max_by("error", F.struct("updated_at", "id")).alias("error"))
    marked = groups.join(ok, work, "left").withColumn("resolved", F.coalesce(F.col("ok_at") > F.col("last"), F.lit(False))).drop("ok_at")
    return marked.orderBy("resolved", F.desc("last"), *work, "pattern").limit(most)


def last_day(operations: DataFrame, now: int) -> DataFrame:
    """One row of the briefing: operations of the last 24 hours, failures that are none of refusals, how many of them nothing has made good since, refusals, backups."""
    recent = operations.filter(F.col("updated_at") >= now - DAY).withColumn("place", _same_place())
    work = ["type", "cluster_id", "place", "work"]
    ok = recent.filter("status = 'succeeded'").groupBy(*work).agg(F.max("updated_at").alias("ok_at"))
    failed = F.col("status") == "failed"
    refused = failed & is_refusal(F.col("type"), F.col("error"))
    real = failed & ~refused
    return recent.join(ok, work, "left").agg(
        F.count("*").alias("operations"), F.count_if(real).alias("failed"), F.count_if(real & (F.col("ok_at").isNull() | (F.col("ok_at") <= F.col("updated_at")))).alias("unresolved"), F.count_if(refused).alias("refused"),
        F.count_if((F.col("type") == "backup_run") & (F.col("status") == "succeeded")).alias("backups"),
    )


def unresolved(operations: DataFrame) -> DataFrame:
    """Failures after which the same work has not succeeded."""
    work = ["type", "cluster_id", "place", "work"]
    placed = operations.withColumn("place", _same_place())
    ok = placed.filter("status = 'succeeded'").groupBy(*work).agg(F.max("updated_at").alias("ok_at"))
    return placed.filter("status = 'failed'").join(ok, work, "left").filter("ok_at IS NULL OR ok_at <= updated_at").drop("ok_at", "place")


def open_verifications(operations: DataFrame) -> DataFrame:
    """Failed verifications without a later success of the cluster that checks at least as much.

    A success covers a failure if it is deep or the failure is not, and if it names no set or the same
    one: the latest success of each of these four kinds decides.
    """
    ok = operations.filter("type = 'backup_verify' AND status = 'succeeded'")
    best = ok.groupBy("cluster_id").agg(F.max(F.when(F.col("deep") & F.col("set_id").isNull(), F.col("updated_at"))).alias("deep_all"), F.max(F.when(F.col("set_id").isNull(), F.col("updated_at"))).alias("any_all"))
    by_set = ok.filter("set_id IS NOT NULL").groupBy("cluster_id", "set_id").agg(F.max(F.when(F.col("deep"), F.col("updated_at"))).alias("deep_set"), F.max("updated_at").alias("any_set"))
    failed = operations.filter("type = 'backup_verify' AND status = 'failed'").join(best, "cluster_id", "left").join(by_set, ["cluster_id", "set_id"], "left")
    last = F.when(F.col("deep"), F.greatest("deep_all", "deep_set")).otherwise(F.greatest("any_all", "any_set"))
    return failed.filter(F.coalesce(last <= F.col("updated_at"), F.lit(True))).select("id", "cluster_id", "set_id", "deep", "updated_at")


def latest(operations: DataFrame, keys: list[str], status: str = "succeeded") -> DataFrame:
    """The last operation of a status of each entity."""
    return operations.filter(F.col("status") == status).groupBy(*keys).agg(F.max(F.struct("updated_at", "id")).alias("x")).select(*keys, "x.id", "x.updated_at")


def failure_streaks(operations: DataFrame, retry_seconds: int = 1800, most_seconds: int = 21_600) -> DataFrame:
    """Failures since the last success of each cluster and kind, and the wait before the next try."""
    ok = F.max(F.when(F.col("status") == "succeeded", F.col("updated_at"))).over(Window.partitionBy("cluster_id", "type"))
    since = operations.withColumn("ok_at", F.coalesce(ok, F.lit(0))).filter("status IN ('failed', 'cancelled') AND updated_at > ok_at")
    out = since.groupBy("cluster_id", "type").agg(F.count("*").alias("streak"), F.max("updated_at").alias("last_fail"))
    return out.withColumn("wait_seconds", F.least(F.lit(retry_seconds) * F.pow(F.lit(2.0), F.least(F.col("streak") - 1, F.lit(30))), F.lit(float(most_seconds))).cast("long"))


def kept(operations: DataFrame, now: int, days: int = 7, cap: int = HARD_CAP) -> DataFrame:
    """Operations that stay (W10): open, recent or evidence, and of finished ones the newest ``cap``."""
    rank = F.row_number().over(Window.partitionBy("cluster_id", "type").orderBy(F.desc("updated_at"), F.desc("id")))
    proof = operations.filter(F.col("type").isin(EVIDENCE) & (F.col("status") == "succeeded")).withColumn("r", rank).filter("r = 1").select("id", F.lit(True).alias("proof"))
    done = F.col("status").isin(TERMINAL)
    stays = operations.join(proof, "id", "left").filter(~done | F.col("proof") | (F.col("updated_at") >= now - days * DAY)).drop("proof")
    newest = stays.filter(done).orderBy(F.desc("updated_at"), F.desc("id")).limit(cap)
    return stays.filter(~done).unionByName(newest)


def bucket(at: Column, period: int) -> Column:
    """The period a time falls into."""
    return F.floor(at / period)


def due(policies: DataFrame, operations: DataFrame, now: int) -> DataFrame:
    """Work that is due for each cluster (W13): a full or incremental backup, a verification, a drill.

    ``policies(cluster_id, full_hours, incr_hours, verify_hours, drill_days)``; backing off after failures.
    """
    last = lambda kind, also=F.lit(True): F.max(F.when((F.col("type") == kind) & (F.col("status") == "succeeded") & also, F.col("updated_at")))
    seen = operations.groupBy("cluster_id").agg(last("backup_run", F.col("work") == 0).alias("full_at"), last("backup_run").alias("any_at"), last("backup_verify").alias("verify_at"), last("restore_drill").alias("drill_at"))
    wait = failure_streaks(operations).filter("type = 'backup_run'").select("cluster_id", (F.col("last_fail") + F.col("wait_seconds") * 1_000_000).alias("not_before"))
    old = lambda at, period: F.coalesce(F.lit(now) - F.col(at) >= period, F.lit(True))
    out = policies.join(seen, "cluster_id", "left").join(wait, "cluster_id", "left")
    held = F.coalesce(F.col("not_before") > now, F.lit(False))
    work = F.when(held, "wait").when(old("full_at", F.col("full_hours") * HOUR), "full").when(old("any_at", F.col("incr_hours") * HOUR), "incr").when(old("verify_at", F.col("verify_hours") * HOUR), "verify").when(old("drill_at", F.col("drill_days") * DAY), "drill").otherwise("none")
    return out.select("cluster_id", work.alias("due"))


def plan_work(policies: DataFrame, clusters: DataFrame, operations: DataFrame, now: int, hour: int) -> DataFrame:
    """The work that a planner submits next for each cluster, whole (W13): ``cluster_id``, ``work``, ``key``.

    ``policies(cluster_id, enabled, full_hours, incr_hours, verify_hours, drill_days, retry_minutes,
    window_from, window_to)``; nulls and zeros switch a period off. ``clusters(cluster_id, reachable, sets,
    set_at, full_at, new_tablespaces, standby_away)``: what its agent says, ``new_tablespaces`` being those
    that the last full set does not know. ``operations(id, type, cluster_id, status, run_type, created_at,
    updated_at, key)``; ``hour``: the hour of ``now`` in the policies' zone.

    In order, the first that applies: nothing while the cluster is out of reach or has such work open
    (``busy``), nor while failures of planned runs hold it back (``wait``, doubling up to six hours since the
    last success); ``full`` for new tablespaces, three times at most and not within half an hour of a full;
    ``full`` when due, in the hours for heavy work or at once where there is none; else ``incr`` when due,
    unless the standby that takes them is away for a moment; ``expire`` once after each success; ``verify``
    and ``drill`` once in their period, in those hours. Times ahead of ``now`` do not count. A key that was
    submitted before, and work that a switchover or the like forbids, are passed over.
    """
    at_most = lambda c: F.when(c <= now + AHEAD, c)
    kind = lambda name, *status: (F.col("type") == name) & F.col("status").isin(*status)
    ok = kind("backup_run", "succeeded")
    active = ~F.col("status").isin(TERMINAL)
    seen = operations.groupBy("cluster_id").agg(
        F.max(active & F.col("type").isin(PLANNED_ALONE)).alias("open"), F.max(active & F.col("type").isin(DISRUPTIVE)).alias("disrupted"), F.max(F.when(ok, at_most(F.col("created_at")))).alias("run_at"), F.max(F.when(ok & (F.col("run_type") == "full"), at_most(F.col("created_at")))).alias("run_full_at"),
        F.max(F.when(ok, F.col("updated_at"))).alias("ok_at"), F.max(F.when(ok, F.struct("updated_at", "id"))).alias("last_ok"), F.max(ok & (F.col("run_type") == "full") & (F.lit(now) - F.col("created_at") < FULL_HOLDS)).alias("recent_full"), F.max(F.when(kind("restore_drill", "succeeded"), at_most(F.col("updated_at")))).alias("drill_at"),
    )
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    bucket = lambda period: F.floor(F.lit(now) / F.when(period > 0, period)).cast("string")
    name = F.concat(F.lit("sched:"), F.col("cluster_id").cast("string"), F.lit(":"))
    keyed = policies.join(clusters, "cluster_id").join(seen, "cluster_id", "left").select(
        "*", *[F.concat(name, F.lit(f"{work}:"), bucket(F.col(period) * unit)).alias(f"{work}_key") for work, period, unit in (("full", "full_hours", HOUR), ("incr", "incr_hours", HOUR), ("verify", "verify_hours", HOUR), ("drill", "drill_days", DAY))],
        F.concat(name, F.lit("tsfull:"), "new_tablespaces").alias("tsfull_key"), F.concat(name, F.lit("expire:"), F.col("last_ok.id").cast("string")).alias("expire_key"),
    )
    begins = lambda c: F.count_if(F.col("key").startswith(F.col(c)))
    failed = F.col("type").isin("backup_run") & F.col("status").isin("failed", "cancelled") & F.col("key").startswith("sched:") & (F.col("updated_at") > F.coalesce("ok_at", F.lit(0)))
    told = operations.select("cluster_id", "type", "status", "updated_at", "key").join(keyed.select("cluster_id", "ok_at", *[f"{w}_key" for w in ("full", "incr", "tsfull", "expire", "verify", "drill")]), "cluster_id").groupBy("cluster_id").agg(
        F.count_if(failed).alias("streak"), F.max(F.when(failed, F.col("updated_at"))).alias("last_fail"), *[begins(f"{w}_key").alias(f"{w}_tries") for w in ("full", "incr", "tsfull")], *[F.max(F.col("key") == F.col(f"{w}_key")).alias(f"{w}_done") for w in ("expire", "verify", "drill")],
    )
    all_ = keyed.join(told, "cluster_id", "left")
    streak = F.coalesce("streak", F.lit(0))
    wait = F.least(F.col("retry_minutes") * 60_000_000 * F.pow(F.lit(2.0), F.greatest(streak - 1, F.lit(0))), F.lit(float(LONGEST_WAIT)))
    any_at, full_at = F.greatest(at_most(F.col("set_at")), F.col("run_at")), F.greatest(at_most(F.col("full_at")), F.col("run_full_at"))
    inside = heavy_hours(F.lit(hour), F.col("window_from"), F.col("window_to"))
    free = ~yes("disrupted")
    on = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    old = lambda at, period: at.isNull() | (F.lit(now) - at >= period)
    need_full = old(full_at, F.col("full_hours") * HOUR) & (inside | full_at.isNull())
    away = yes("standby_away") & any_at.isNotNull() & (F.lit(now) - any_at < 3 * F.col("incr_hours") * HOUR)
    sets = F.coalesce(F.col("sets") > 0, F.lit(False))
    tries = lambda w: F.concat(F.col(f"{w}_key"), F.lit(":"), F.coalesce(f"{w}_tries", F.lit(0)).cast("string"))
    steps = [
        ("busy", ~yes("reachable") | yes("open"), None), ("wait", (streak > 0) & (F.lit(now) - F.col("last_fail") < wait), None),
        ("full", (F.coalesce("new_tablespaces", F.lit("")) != "") & ~yes("recent_full") & (F.coalesce("tsfull_tries", F.lit(0)) < TABLESPACE_TRIES) & free, tries("tsfull")), ("full", need_full & free, tries("full")),
        ("incr", ~need_full & on("incr_hours") & old(any_at, F.col("incr_hours") * HOUR) & ~away & free, tries("incr")), ("expire", F.col("last_ok").isNotNull() & ~yes("expire_done") & free, F.col("expire_key")),
        ("verify", on("verify_hours") & inside & sets & ~yes("verify_done"), F.col("verify_key")), ("drill", on("drill_days") & inside & sets & old(F.col("drill_at"), F.col("drill_days") * DAY) & ~yes("drill_done") & free, F.col("drill_key")),
    ]
    work, key = F.lit("none"), F.lit(None).cast("string")
    for step, applies, named in reversed(steps):
        work, key = F.when(applies, step).otherwise(work), F.when(applies, F.lit(None) if named is None else named).otherwise(key)
    return all_.filter("enabled").select("cluster_id", work.alias("work"), key.alias("key"))


def ring(entries: DataFrame, n: int = RING) -> DataFrame:
    """The newest ``n`` entries of each cluster."""
    return entries.withColumn("place", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("updated_at"), F.desc("id")))).filter(F.col("place") <= n).drop("place")


def timeline(history_rows: DataFrame, log_rows: DataFrame) -> DataFrame:
    """Two lists of events as one by time (W15, X20); at one instant history comes first."""
    a = history_rows.select("id", "updated_at", F.lit(0).alias("kind"), F.col("status").alias("text"))
    return a.unionByName(log_rows.select("id", "updated_at", F.lit(1).alias("kind"), "text"))


def _with(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """``rows`` with the columns it lacks."""
    return rows.withColumns({c: v for c, v in defaults.items() if c not in rows.columns})


def conflicts(requests: DataFrame, operations: DataFrame) -> DataFrame:
    """For each request the first active operation of its cluster that forbids it, with the rule.

    ``requests(request, cluster_id, type, forced)``; parameters that either side may have are ``dry_run``,
    ``stage_db`` and ``new_name``, and operations may have ``attempts``. A restart that is only looked at
    conflicts with nothing. Overridable conflicts can be forced.
    """
    none = {"dry_run": F.lit(False), "stage_db": F.lit(None).cast("string"), "new_name": F.lit(None).cast("string"), "attempts": F.lit(0)}
    new, old = F.col("type"), F.col("o_type")
    active = _with(operations.filter(F.col("status").isin(ACTIVE)), none).filter("NOT (type = 'pg_restart' AND dry_run)")
    waits = (F.col("status") == "queued") & (F.col("attempts") == 0)
    active = active.select("cluster_id", new.alias("o_type"), waits.alias("waits"), F.col("dry_run").alias("o_dry"), F.col("stage_db").alias("o_stage"), F.col("new_name").alias("o_name"), F.col("id").alias("with_id"), "updated_at")
    # Operations of one kind, state and target forbid the same: the first of each stands for all.
    same = ["cluster_id", "o_type", "waits", "o_dry", "o_stage", "o_name"]
    active = active.groupBy(*same).agg(F.min(F.struct("updated_at", "with_id")).alias("x")).select(*same, "x.*")
    grouped = F.lit(False)
    for g in GROUPS:
        grouped = grouped | (new.isin(g) & old.isin(g))
    stage = F.col("stage_db") == F.col("o_stage")
    rule = (
        F.when(grouped & (old != new), "group").when((new.isin(SINGLE) | grouped) & (old == new), "singleton")
        .when(((new == "destination_migrate") & (old == "backup_expire")) | ((new == "backup_expire") & (old == "destination_migrate") & ~F.col("o_dry")), "cleanup")
        .when((new == "backup_expire") & old.isin(READERS), "reader").when(new.isin(READERS) & (old == "backup_expire"), "reader")
        .when((new == "restore_promote") & old.isin("restore_promote", "restore_object") & stage, "stage").when((new == "restore_object") & old.isin("restore_object", "restore_promote") & stage, "stage")
        .when((new == "restore_database") & (old == new) & (F.col("new_name") == F.col("o_name")), "name")
        .when(new.isin(DISRUPTIVE) & old.isin(DATA_WORK) & ~F.col("waits") & ~F.col("forced"), "interrupts").when(new.isin(DATA_WORK) & old.isin(DISRUPTIVE), "disrupted")
    )
    asked = _with(requests, none).filter("NOT (type = 'pg_restart' AND dry_run)")
    met = asked.join(active.hint("merge"), "cluster_id").withColumn("rule", rule).filter("rule IS NOT NULL")
    return met.groupBy("request", "cluster_id").agg(F.min(F.struct("updated_at", "with_id", "rule")).alias("x")).select("request", "cluster_id", "x.with_id", "x.rule", (F.col("x.rule") == "interrupts").alias("overridable"))


def admitted(operations: DataFrame) -> DataFrame:
    """Of each lane (``cluster_id``, ``lane``) without work in flight the first queued operation."""
    busy = operations.filter("status IN ('leased', 'running') OR status = 'queued' AND attempts > 0").select("cluster_id", "lane").distinct()
    free = operations.filter("status = 'queued' AND attempts = 0").join(busy, ["cluster_id", "lane"], "left_anti")
    return free.groupBy("cluster_id", "lane").agg(F.min(F.struct("submitted_at", "id")).alias("x")).select("cluster_id", "lane", "x.id")


def submissions(requests: DataFrame) -> DataFrame:
    """Per idempotency key the first request and whether another asked for something else."""
    return requests.groupBy("key").agg(F.min_by("id", F.struct("submitted_at", "id")).alias("id"), F.count("*").alias("n"), (F.countDistinct("request") > 1).alias("conflict"))


def is_risky(kind: Column, **params: Column) -> Column:
    """Whether work changes live access, parameters, topology or data.

    ``params``: ``dry_run``, ``replace_original``, ``replace_production``, ``keep_archiving``, ``rows``
    (whether rows are put back or deleted), ``finish``, ``promote_mode``, ``mode``; what is not given or
    null is false or nothing.
    """
    yes = lambda name: F.coalesce(params.get(name, F.lit(False)), F.lit(False))
    says = lambda name, *values: F.coalesce(params.get(name, F.lit("")).isin(*values), F.lit(False))
    dry = yes("dry_run")
    return (
        F.when(kind.isin("pg_restart", "restore_db_swap", "wal_retire_branch"), ~dry).when(kind == "restore_database", yes("replace_original"))
        .when(kind == "restore_instance", (yes("replace_production") & ~dry) | yes("keep_archiving")).when(kind == "restore_object", (says("finish", "promote") & says("promote_mode", "replace")) | says("finish", "rows_all"))
        .when(kind == "restore_promote", says("mode", "replace")).when(kind == "restore_apply_rows", yes("rows")).otherwise(kind.isin(RISKY))
    )


def needs_approval(kind: Column, protected: Column, **params: Column) -> Column:
    """Risky work in a protected environment needs a second person."""
    return protected & is_risky(kind, **params)


def lease_states(operations: DataFrame, now: int) -> DataFrame:
    """Statuses as of now (ST9): queued past its time expires, a lapsed lease is queued again or fails after five attempts."""
    late = (F.col("status") == "queued") & (F.lit(now) - F.when(F.col("attempts") > 0, F.col("updated_at")).otherwise(F.col("submitted_at")) > F.col("ttl_seconds") * 1_000_000)
    lapsed = F.col("status").isin("leased", "running") & (F.col("lease_until") < now)
    return operations.select("id", F.when(late, "expired").when(lapsed, F.when(F.col("attempts") >= MAX_ATTEMPTS, "failed").otherwise("queued")).otherwise(F.col("status")).alias("status"))


def prune_requests(requests: DataFrame, now: int) -> DataFrame:
    """Enrolment requests that stay: pending ones a day, decided ones a week."""
    ttl = F.when(F.col("status") == "queued", DAY).otherwise(7 * DAY)
    return requests.filter(F.lit(now) - F.col("updated_at") < ttl)
