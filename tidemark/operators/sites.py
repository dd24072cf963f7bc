"""Sites that hold the same database: what each is, how replication between them stands, whether a takeover would work, and when a primary site counts as lost.

Times are microseconds, ``now`` is a parameter, and null is what nobody told. A group's sites are few, but
groups are many, so everything is an aggregate or a join on the cluster or the group; evidence, which is
long, is folded by aggregates that combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fleet import DAY, GIB, HOUR, MIB, elect, online

# Settings that a hot standby needs at least as high as its primary.
STANDBY_LEAST = ["max_connections", "max_prepared_transactions", "max_locks_per_transaction", "max_wal_senders", "max_worker_processes"]
#: What the leading node of a site tells beside its state.
LEAD = ["major", "archive_mode", "archive_command", *STANDBY_LEAST, "accessible", "use_rewind", "hba_ok", "recovery_restore", "last_failed", "last_archived"]
NODE = ["node_id", "lsn", "timeline", "replay_at", "receiver_status", "receiver_host", "receiver_port", "receiver_slot", "receiver_silent", *LEAD]


def view(nodes: DataFrame, now: int) -> DataFrame:
    """One row for each cluster: its role among sites, who leads it, and where it replicates from.

    A site is a standby if its manager names an upstream, if a node leads as ``standby_leader``, or if all
    reachable nodes are in recovery without a manager and one receives. It is primary if a reachable node is
    writable and there is no upstream. Of several nodes the one with the lowest id counts. ``receiver`` is
    ``none`` for a standby whose leader has no receiver.
    """
    on = online(F.col("last_seen"), now)
    told = F.struct(*NODE)
    up = F.struct("node_id", F.col("upstream_host").alias("host"), F.col("upstream_port").alias("port"), F.col("upstream_slot").alias("slot"), F.col("upstream_restore").alias("restore"))
    writable, recovering = F.coalesce(~F.col("in_recovery"), F.lit(False)), F.coalesce("in_recovery", F.lit(False))
    each = nodes.groupBy("cluster_id").agg(
        F.min(F.when(on & writable, told)).alias("prim"),
        F.min(F.when(on & (F.col("manager_role") == "standby_leader"), told)).alias("led"),
        F.min(F.when(on & F.col("receiver_status").isNotNull(), told)).alias("receives"),
        F.min(F.when(on, told)).alias("reachable"),
        F.count_if(on).alias("up"), F.count_if(on & ~(recovering & ~F.coalesce("accessible", F.lit(False)))).alias("managed"),
        F.min(F.when(F.col("upstream_host") != "", up)).alias("named"),
        F.min(F.when(F.col("system").isNotNull(), F.struct("node_id", "system"))).alias("system"),
        F.min(F.when(F.col("last_backup").isNotNull(), F.struct("node_id", "last_backup"))).alias("backup"),
    )
    plain = F.when(F.col("prim").isNull() & (F.col("up") > 0) & (F.col("managed") == 0), F.col("receives"))
    rows = each.withColumn("plain", plain).withColumn("follows", F.coalesce("led", "plain")).withColumn("lead", F.coalesce("prim", "follows"))
    by_hand = F.when(F.col("plain.receiver_host").isNotNull(), F.struct("plain.node_id", F.col("plain.receiver_host").alias("host"), F.col("plain.receiver_port").alias("port"), F.col("plain.receiver_slot").alias("slot"), F.lit(False).alias("restore")))
    rows = rows.withColumn("upstream", F.coalesce("named", by_hand))
    role = F.when(F.col("prim").isNotNull() & F.col("upstream").isNull(), "primary").when(F.col("upstream").isNotNull() | F.col("follows").isNotNull(), "standby").otherwise("unknown")
    return rows.select(
        "cluster_id", role.alias("role"), F.col("lead.node_id").alias("leader"), F.col("lead").isNotNull().alias("online"), "lead.lsn", "lead.timeline", "system.system",
        F.col("upstream.host").alias("up_host"), F.col("upstream.port").alias("up_port"), F.col("upstream.slot").alias("up_slot"), F.coalesce("upstream.restore", F.lit(False)).alias("up_restore"), F.col("named").isNotNull().alias("up_managed"),
        F.coalesce("follows.receiver_status", F.when(role == "standby", "none")).alias("receiver"), F.col("follows.receiver_silent").alias("silent"),
        F.when(F.col("follows.replay_at").isNotNull(), F.greatest(F.lit(0), F.floor((F.lit(now) - F.col("follows.replay_at")) / 1_000_000 + 0.5))).alias("replay_delay"), F.coalesce("lead", "reachable").alias("told"), "backup.last_backup",
    )


def grouped(sites: DataFrame, clusters: DataFrame, slots: DataFrame) -> DataFrame:
    """Sites of each group with its primary, the lag behind it and the slot there.

    ``clusters(cluster_id, group_id, declared_primary, was_site, failover_target, declared, is_upstream,
    endpoint)``, ``slots(cluster_id, name, active, retained_bytes, permanent)``. Writable clusters that are not
    the primary are ``split`` if they were sites before, else copies, which are no sites and are left out.
    A site declared to follow a cluster of another system is an invalid standby, without a lag.
    """
    other = sites.select(F.col("cluster_id").alias("declared_primary"), F.col("system").alias("declared_system"))
    rows = sites.join(clusters, "cluster_id").join(other, "declared_primary", "left")
    rows = rows.withColumn("invalid", F.coalesce(F.col("declared_system") != F.col("system"), F.lit(False))).withColumn("role", F.when(F.col("invalid"), "standby").otherwise(F.col("role")))
    chosen = elect(rows.filter("role = 'primary'")).select("group_id", "primary")
    rows = rows.join(chosen, "group_id", "left").withColumn("rival", F.coalesce((F.col("role") == "primary") & (F.col("cluster_id") != F.col("primary")), F.lit(False)))
    lead = rows.filter("cluster_id = primary").select("group_id", F.col("lsn").alias("p_lsn"), F.col("timeline").alias("p_timeline"), F.col("told").alias("p_told"))
    sums = rows.groupBy("group_id").agg(
        F.count_if(F.col("rival") & F.col("was_site")).alias("splits"), F.count_if(F.col("rival") & ~F.col("was_site")).alias("copies"), F.count_if(F.col("role") == "standby").alias("standbys"),
        F.count("*").alias("members"), F.max((F.col("role") == "standby") & F.col("up_host").isNotNull()).alias("addressed"),
    )
    kept = rows.join(sums, "group_id").join(lead, "group_id", "left").filter("NOT (rival AND NOT was_site)").filter("members - copies >= 2 OR standbys > 0 OR splits > 0")
    slot = slots.select(F.col("cluster_id").alias("primary"), F.col("name").alias("up_slot"), F.col("active").alias("slot_active"), F.col("retained_bytes").alias("slot_retained"), F.col("permanent").alias("slot_permanent"), F.lit(True).alias("slot_known"))
    lag = F.when((F.col("role") == "standby") & ~F.col("invalid"), F.greatest(F.lit(0), F.col("p_lsn") - F.col("lsn")))
    return kept.join(slot, ["primary", "up_slot"], "left").withColumn("lag", F.when(F.col("p_lsn").isNotNull() & F.col("lsn").isNotNull(), lag))


def _problem(level: str, code: str, when: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.concat_ws(":", F.lit(level), F.lit(code)))


def health(rows: DataFrame) -> DataFrame:
    """Problems and health of each site of :func:`grouped`: bad before warn before ok.

    Problems are ``level:code`` in a fixed order. A standby that streams no more but is close and can read the
    archive is warned about, not lost; silence of its receiver is then not measured.
    """
    standby, streams, manual = F.col("role") == "standby", F.coalesce(F.col("receiver") == "streaming", F.lit(False)), F.col("declared_primary").isNotNull()
    quiet = (manual & F.col("system").isNull()) | F.col("invalid")
    behind = F.coalesce(F.col("timeline") < F.col("p_timeline"), F.lit(False)) & ~streams
    close = ~streams & F.col("up_restore") & (F.coalesce(F.col("replay_delay") < 600, F.lit(False)) | F.coalesce(F.col("lag") < 64 * MIB, F.lit(False)))
    measured = standby & ~(F.col("up_restore") & ~streams)
    here = standby & ~quiet
    found = F.filter(F.array(
        _problem("bad", "two_primaries", (F.col("splits") > 0) & ((F.col("cluster_id") == F.col("primary")) | F.col("rival"))),
        _problem("bad", "unreachable", here & ~F.col("online")),
        _problem("bad", "older_timeline", here & F.col("online") & behind),
        _problem("warn", "from_archive", here & F.col("online") & ~behind & close),
        _problem("bad", "not_receiving", here & F.col("online") & ~behind & ~close & ~streams),
        _problem("bad", "silent", measured & (F.col("silent") > 120)),
        _problem("warn", "silent", measured & (F.col("silent") > 30) & (F.col("silent") <= 120)),
        _problem("bad", "lag", standby & (F.col("lag") > GIB)),
        _problem("warn", "lag", standby & (F.col("lag") > 64 * MIB) & (F.col("lag") <= GIB)),
        _problem("warn", "slot_inactive", standby & F.col("up_slot").isNotNull() & ~F.coalesce("slot_active", F.lit(False))),
        _problem("bad", "slot_full", standby & (F.col("slot_retained") > 8 * GIB)),
        _problem("warn", "no_primary", standby & F.col("primary").isNull() & ~F.col("invalid")),
        _problem("bad", "other_database", standby & F.col("invalid")),
        _problem("warn", "unmeasured", standby & manual & F.col("system").isNull()),
        _problem("warn", "copy", (F.col("copies") > 0) & (F.col("cluster_id") == F.col("primary"))),
    ), lambda x: x.isNotNull())
    worst = F.when(F.exists(found, lambda x: x.startswith("bad")), "bad").when(F.size(found) > 0, "warn").otherwise("ok")
    return rows.select("group_id", "cluster_id", "role", "primary", "lag", "receiver", "replay_delay", F.array_join(found, ",").alias("problems"), worst.alias("health"))


def _check(name: str, level: Column, seconds: Column | None = None) -> Column:
    return F.when(level.isNotNull(), F.struct(F.lit(name).alias("id"), level.alias("level"), (seconds if seconds is not None else F.lit(None)).cast("long").alias("seconds")))


def _yes(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def _exploded(rows: DataFrame, checks: list[Column], cluster: Column) -> DataFrame:
    return rows.select("group_id", cluster.alias("cluster_id"), F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("c")).select("group_id", "cluster_id", "c.*")


def readiness(rows: DataFrame, hosts: DataFrame, groups: DataFrame, now: int, tool: str = "tide-wal", target: int = 60) -> DataFrame:
    """Checks of whether a site of :func:`grouped` could take over: ``id``, ``level`` (ok, info, warn, bad) and, for ``rpo``, ``seconds`` that would be lost.

    ``hosts(cluster_id, host)`` are names of single nodes, ``groups(group_id, auto, rpo_target, last_test)``.
    ``tool`` is a pattern of an archive command that reaches the shared archive. A group without a primary has
    the one check ``primary``. Checks that nobody's report decides are not made.
    """
    s = rows.join(groups, "group_id", "left")
    t, p = (lambda c: F.col("told")[c]), (lambda c: F.col("p_told")[c])
    known = s.filter("primary IS NOT NULL")
    goal = F.when(F.col("rpo_target") > 0, F.col("rpo_target")).otherwise(F.lit(target))
    named = hosts.select(F.col("cluster_id").alias("primary"), F.col("host").alias("up_host")).distinct().withColumn("single", F.lit(True))
    sb = known.filter("role = 'standby'").join(named, ["primary", "up_host"], "left")
    streams, mode = _yes(F.col("receiver") == "streaming"), F.lower(t("archive_mode"))
    lost = F.when(_yes(F.col("lag") == 0), F.lit(0)).when(streams & _yes(F.col("silent") < 10) & (F.coalesce("lag", F.lit(0)) < 16 * MIB), F.floor(F.col("silent") + 0.5)).otherwise(F.col("replay_delay"))
    restore = F.col("up_managed") & F.col("up_restore")
    standby = [
        _check("version", F.when(t("major") != p("major"), "bad")),
        _check("slot", F.when(F.col("up_slot").isNull(), F.when(restore, "info").otherwise("warn")).when(F.col("slot_known").isNull() | ~F.coalesce("slot_permanent", F.lit(True)), "bad").otherwise("ok")),
        _check("upstream", F.when(F.col("up_host").isNotNull(), F.when(F.col("single"), "warn").otherwise("ok"))),
        _check("archive", F.when(F.col("up_managed"), F.when(F.col("up_restore"), "ok").otherwise("warn"))),
        _check("standby_archive", F.when(mode != "", F.when(~mode.isin("on", "always") | ~F.coalesce(t("archive_command"), F.lit("")).rlike(tool), "warn").otherwise("ok"))),
        *[_check("param:" + x, F.when(t(x) < p(x), "bad")) for x in STANDBY_LEAST],
        _check("rpo", F.when(lost.isNull(), F.when(restore, "warn").otherwise("bad")).when(lost > goal * 10, "bad").when(lost > goal, "warn").otherwise("ok"), lost),
        _check("endpoint", F.when(~F.col("endpoint"), "warn")),
        _check("rewind", F.when(_yes(t("accessible")) & ~_yes(t("use_rewind")), "warn")),
        _check("hba_local", F.when(~t("hba_ok"), "bad")),
        _check("dr_endpoint", F.when(_yes(F.col("auto")), F.when(F.col("endpoint"), "ok").otherwise("bad"))),
    ]
    stuck = t("last_failed").isNotNull() & (t("last_archived").isNull() | (t("last_failed") > t("last_archived"))) & (F.lit(now) - t("last_failed") < HOUR)
    primary = [
        _check("endpoint", F.when(~F.col("endpoint") & ~F.col("addressed"), "warn")),
        _check("archive_primary", F.when(_yes(t("accessible")), F.when(_yes(t("recovery_restore")), "ok").otherwise("warn"))),
        _check("rewind", F.when(_yes(t("accessible")) & ~_yes(t("use_rewind")), "warn")),
        _check("hba_local", F.when(~t("hba_ok"), "bad")),
        _check("archiver", F.when(_yes(stuck), "bad")),
        _check("backup", F.when(_yes(F.lit(now) - F.col("last_backup") <= 8 * DAY), "ok").otherwise("warn")),
        _check("tested", F.when(_yes(F.lit(now) - F.col("last_test") <= 180 * DAY), "ok").otherwise("info")),
    ]
    none = s.filter("primary IS NULL").select("group_id").distinct().select("group_id", F.lit(None).cast("long").alias("cluster_id"), F.lit("primary").alias("id"), F.lit("bad").alias("level"), F.lit(None).cast("long").alias("seconds"))
    return _exploded(sb, standby, F.col("cluster_id")).unionByName(_exploded(known.filter("cluster_id = primary"), primary, F.col("cluster_id"))).unionByName(none)


def status(checks: DataFrame) -> DataFrame:
    """The fold of a group's checks: not_ready with a bad one, degraded with a warning, else ready; and the worst loss in seconds."""
    each = checks.groupBy("group_id").agg(F.count_if(F.col("level") == "bad").alias("bad"), F.count_if(F.col("level") == "warn").alias("warn"), F.max("seconds").alias("rpo_seconds"))
    return each.select("group_id", "bad", "warn", "rpo_seconds", F.when(F.col("bad") > 0, "not_ready").when(F.col("warn") > 0, "degraded").otherwise("ready").alias("status"))


def lost_primaries(evidence: DataFrame, policies: DataFrame, now: int) -> DataFrame:
    """Whether two witnesses agree that a group's primary site is gone, since when, and whether a takeover may start.

    ``evidence(group_id, witness, at_time, blind)``: what ``console`` (no node of the site answers) and
    ``standby`` (a reachable standby receives nothing) saw, in any order; a view holds until the next one of
    the same witness, and of views at the same time a clear one counts. The site is down since the later of
    the starts of both present blind stretches. ``policies(group_id, auto, outside, confirm_seconds,
    snoozed_until, failed_over_at)``: a takeover starts by itself only if the console runs outside both sites,
    nobody asked it to wait, the confirmation is over, and none was done within the last hour.

    The fold needs no order: the last clear view of a witness, then the first blind view after it, each an
    aggregate that combines before the shuffle. Groups without evidence are ``unknown``.
    """
    seen = evidence.filter(F.col("witness").isin("console", "standby") & (F.col("at_time") <= now))
    keys = ["group_id", "witness"]
    clear = seen.groupBy(*keys).agg(F.max(F.when(~F.coalesce("blind", F.lit(False)), F.col("at_time"))).alias("clear_at"))
    after = seen.filter("blind").join(clear, keys).filter("clear_at IS NULL OR at_time > clear_at")
    since = after.groupBy("group_id").agg(*[F.min(F.when(F.col("witness") == w, F.col("at_time"))).alias(w) for w in ("console", "standby")])
    heard = seen.groupBy("group_id").agg(F.max("at_time").alias("last_evidence"))
    rows = policies.join(heard, "group_id", "left").join(since, "group_id", "left")
    both = F.col("console").isNotNull() & F.col("standby").isNotNull()
    down = F.when(both, F.greatest("console", "standby"))
    wait = F.when(F.col("auto") & both, F.greatest(F.lit(0), F.ceil((down + F.col("confirm_seconds") * 1_000_000 - now) / 1_000_000)))
    held = _yes(F.col("snoozed_until") > now)
    recent = _yes(F.lit(now) - F.col("failed_over_at") < HOUR)
    state = (
        F.when(F.col("last_evidence").isNull(), "unknown").when(F.col("console").isNull(), "answers_console").when(F.col("standby").isNull(), "still_sends")
        .when(~F.col("auto"), "lost").when(~F.col("outside"), "waits_for_person").when(held, "snoozed").when(recent, "taken_over").when(wait > 0, "confirming").otherwise("take_over")
    )
    return rows.select("group_id", F.col("console").alias("console_since"), F.col("standby").alias("standby_since"), down.alias("down_since"), wait.alias("act_in"), state.alias("state"))
