"""Sites of one database by hand: roles, problems, checks, and the fold of two witnesses."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import advice, sites

SECOND, NOW = 1_000_000, 1_000_000_000_000
NODES = "cluster_id long, node_id long, name string, last_seen long, in_recovery boolean, manager_role string, system string, lsn long, timeline int, replay_at long, receiver_status string, receiver_host string, receiver_port int, receiver_slot string, receiver_silent double, upstream_host string, upstream_port int, upstream_slot string, upstream_restore boolean, accessible boolean, major int, archive_mode string, archive_command string, max_connections int, max_prepared_transactions int, max_locks_per_transaction int, max_wal_senders int, max_worker_processes int, use_rewind boolean, hba_ok boolean, recovery_restore boolean, last_failed long, last_archived long, last_backup long"
FIELDS = [f.split()[0] for f in NODES.split(", ")]
CLUSTERS = "cluster_id long, group_id long, declared_primary long, was_site boolean, failover_target boolean, declared boolean, is_upstream boolean, endpoint boolean"
GB = 1 << 30


def node(**told):
    base = {"last_seen": NOW, "system": "a", "timeline": 1, "accessible": True, "major": 16, "archive_mode": "on", "archive_command": "tide-wal put", "max_connections": 100, "use_rewind": True, "hba_ok": True, "recovery_restore": True}
    return tuple((base | told).get(f) for f in FIELDS)


def primary(cluster, **told):
    return node(**({"cluster_id": cluster, "node_id": cluster * 10, "name": f"n{cluster}", "in_recovery": False, "manager_role": "leader", "lsn": 20 * GB, "last_backup": NOW} | told))


def standby(cluster, **told):
    base = {"cluster_id": cluster, "node_id": cluster * 10, "name": f"n{cluster}", "in_recovery": True, "manager_role": "standby_leader", "lsn": 20 * GB, "receiver_status": "streaming", "receiver_silent": 1.0, "upstream_host": "vip", "upstream_port": 5000, "upstream_slot": f"geo_{cluster}", "upstream_restore": True, "replay_at": NOW - SECOND}
    return node(**(base | told))


def _grouped(spark, nodes, clusters=None, slots=()):
    view = sites.view(spark.createDataFrame(nodes, NODES), NOW)
    rows = clusters or [(c, 1, None, False, False, c == 1, False, True) for c in sorted({n[0] for n in nodes})]
    return sites.grouped(view, spark.createDataFrame(rows, CLUSTERS), spark.createDataFrame(list(slots), "cluster_id long, name string, active boolean, retained_bytes long, permanent boolean"))


def _problems(*args, **kwargs):
    return {r.cluster_id: (r.problems, r.health) for r in sites.health(_grouped(*args, **kwargs)).collect()}


def test_a_pair_that_streams_is_well(spark):
    assert _problems(spark, [primary(1), standby(2)], slots=[(1, "geo_2", True, 1024, True)]) == {1: ("", "ok"), 2: ("", "ok")}


@pytest.mark.parametrize(
    ("told", "problems", "health"),
    [
        ({"last_seen": NOW - 60 * SECOND}, "bad:unreachable", "bad"),
        ({"receiver_status": None}, "warn:from_archive", "warn"),
        ({"receiver_status": None, "upstream_restore": False}, "bad:not_receiving", "bad"),
        ({"receiver_status": None, "replay_at": None, "lsn": 18 * GB}, "bad:not_receiving,bad:lag", "bad"),
        ({"receiver_silent": 31.0}, "warn:silent", "warn"),
        ({"receiver_silent": 121.0}, "bad:silent", "bad"),
        ({"receiver_status": "stopping", "receiver_silent": 500.0}, "warn:from_archive", "warn"),
        ({"lsn": 20 * GB - 100 * (1 << 20)}, "warn:lag", "warn"),
        ({"timeline": 0}, "", "ok"),
        ({"timeline": 0, "receiver_status": None}, "bad:older_timeline", "bad"),
        ({"lsn": 21 * GB}, "", "ok"),
    ],
)
def test_problems_of_a_standby(spark, told, problems, health):
    assert _problems(spark, [primary(1), standby(2, **told)], slots=[(1, "geo_2", True, 1024, True)])[2] == (problems, health)


def test_slots_and_plain_standbys(spark):
    assert _problems(spark, [primary(1), standby(2)], slots=[(1, "geo_2", False, 9 * GB, True)])[2] == ("warn:slot_inactive,bad:slot_full", "bad")
    plain = standby(2, manager_role=None, accessible=False, upstream_host=None, upstream_slot=None, receiver_host="n1", receiver_port=5432, receiver_slot="geo_2")
    rows = _grouped(spark, [primary(1), plain]).filter("cluster_id = 2").collect()
    assert [(r.role, r.up_host, r.up_slot, r.up_managed, r.up_restore) for r in rows] == [("standby", "n1", "geo_2", False, False)]


def test_copies_are_left_out_and_two_primaries_told(spark):
    three = [primary(1), standby(2), primary(3, node_id=30)]
    of = lambda was: [(1, 1, None, False, False, True, False, True), (2, 1, None, False, False, False, False, True), (3, 1, None, was, False, False, False, True)]
    slots = [(1, "geo_2", True, 0, True)]
    assert _problems(spark, three, of(False), slots) == {1: ("warn:copy", "warn"), 2: ("", "ok")}
    assert _problems(spark, three, of(True), slots) == {1: ("bad:two_primaries", "bad"), 2: ("", "ok"), 3: ("bad:two_primaries", "bad")}


def test_declared_sites(spark):
    rows = [(1, 1, None, False, False, True, False, True), (2, 1, 1, False, False, False, False, True)]
    slots = [(1, "geo_2", True, 0, True)]
    assert _problems(spark, [primary(1), standby(2, system="b", lsn=1)], rows, slots)[2] == ("bad:other_database", "bad")
    assert _problems(spark, [primary(1), standby(2, system=None, receiver_status=None)], rows, slots)[2] == ("warn:unmeasured", "warn")


def test_one_cluster_is_no_group_and_no_rows_give_none(spark):
    assert _problems(spark, [primary(1)]) == {}
    empty = spark.createDataFrame([], NODES)
    assert sites.view(empty, NOW).count() == 0


def _ready(spark, nodes, slots=((1, "geo_2", True, 0, True),), groups=((1, False, 60, NOW),), clusters=None):
    rows = _grouped(spark, nodes, clusters, slots)
    hosts = spark.createDataFrame([(n[0], n[2]) for n in nodes], "cluster_id long, host string")
    checks = sites.readiness(rows, hosts, spark.createDataFrame(list(groups), "group_id long, auto boolean, rpo_target long, last_test long"), NOW)
    state = sites.status(checks).collect()
    return {(r.cluster_id, r.id): r.level for r in checks.collect()}, [(r.status, r.rpo_seconds) for r in state]


def test_a_pair_that_is_ready(spark):
    checks, state = _ready(spark, [primary(1), standby(2)])
    assert set(checks.values()) == {"ok"} and state == [("ready", 0)]


@pytest.mark.parametrize(
    ("told", "check", "level", "status"),
    [
        ({"major": 15}, (2, "version"), "bad", "not_ready"),
        ({"max_connections": 50}, (2, "param:max_connections"), "bad", "not_ready"),
        ({"upstream_slot": None}, (2, "slot"), "info", "ready"),
        ({"upstream_slot": None, "upstream_restore": False}, (2, "slot"), "warn", "degraded"),
        ({"upstream_slot": "other"}, (2, "slot"), "bad", "not_ready"),
        ({"upstream_host": "n1"}, (2, "upstream"), "warn", "degraded"),
        ({"archive_mode": "off"}, (2, "standby_archive"), "warn", "degraded"),
        ({"archive_command": None}, (2, "standby_archive"), "warn", "degraded"),
        ({"use_rewind": None}, (2, "rewind"), "warn", "degraded"),
        ({"hba_ok": False}, (2, "hba_local"), "bad", "not_ready"),
        ({"lsn": 20 * GB - 1, "receiver_silent": 70.0, "replay_at": NOW - 70 * SECOND}, (2, "rpo"), "warn", "degraded"),
        ({"lsn": 20 * GB - 1, "receiver_silent": 700.0, "replay_at": NOW - 601 * SECOND}, (2, "rpo"), "bad", "not_ready"),
        ({"lsn": None, "receiver_status": None, "replay_at": None}, (2, "rpo"), "warn", "degraded"),
        ({"lsn": None, "receiver_status": None, "replay_at": None, "upstream_restore": False}, (2, "rpo"), "bad", "not_ready"),
    ],
)
def test_checks_of_a_standby(spark, told, check, level, status):
    checks, state = _ready(spark, [primary(1), standby(2, **told)])
    assert checks[check] == level and state[0][0] == status


def test_checks_of_the_primary_and_of_a_group_without_one(spark):
    checks, _ = _ready(spark, [primary(1, last_failed=NOW - 10, last_archived=NOW - 20, last_backup=NOW - 9 * 86400 * SECOND, recovery_restore=None), standby(2)], groups=[(1, True, None, None)], clusters=[(1, 1, None, False, False, True, False, False), (2, 1, None, False, False, False, False, False)])
    assert {k[1]: v for k, v in checks.items() if k[0] == 1 and v != "ok"} == {"archiver": "bad", "backup": "warn", "archive_primary": "warn", "tested": "info"}
    assert checks[2, "dr_endpoint"] == "bad" and checks[2, "endpoint"] == "warn"
    assert _ready(spark, [standby(2), standby(3)]) == ({(None, "primary"): "bad"}, [("not_ready", None)])


POLICY = "group_id long, auto boolean, outside boolean, confirm_seconds long, snoozed_until long, failed_over_at long"


def _plain(evidence, auto, outside, confirm, snoozed, failed_over):
    """The monitor, a step for each instant: down since the first instant at which both are blind and nothing has cleared it."""
    blind, down = {"console": False, "standby": False}, None
    for at, here in itertools.groupby(sorted(evidence), key=lambda e: e[0]):
        here = list(here)
        for w in {e[1] for e in here}:
            blind[w] = all(e[2] for e in here if e[1] == w)
        down = (at if down is None else down) if all(blind.values()) else None
    if not evidence:
        return "unknown", None
    if down is None:
        return "answers_console" if not blind["console"] else "still_sends", None
    if not auto:
        return "lost", down
    late = -(-(down + confirm * SECOND - NOW) // SECOND)
    for state, when in (("waits_for_person", not outside), ("snoozed", (snoozed or 0) > NOW), ("taken_over", failed_over is not None and NOW - failed_over < 3600 * SECOND), ("confirming", late > 0)):
        if when:
            return state, down
    return "take_over", down


def test_two_witnesses_equal_a_plain_monitor_in_any_order(spark):
    rng = random.Random(7)
    evidence, policies, expected = [], [], {}
    for g in range(300):
        mine = [(NOW - rng.randrange(40) * SECOND, rng.choice(["console", "standby"]), rng.random() < 0.8) for _ in range(rng.randrange(12))]
        policy = (rng.random() < 0.8, rng.random() < 0.8, rng.choice([0, 10, 60]), rng.choice([None, NOW - 1, NOW + 1]), rng.choice([None, None, NOW - SECOND, NOW - 7200 * SECOND]))
        evidence += [(g, w, at, b) for at, w, b in mine]
        policies.append((g, *policy))
        expected[g] = _plain(mine, *policy)
    rng.shuffle(evidence)
    got = sites.lost_primaries(spark.createDataFrame(evidence, "group_id long, witness string, at_time long, blind boolean").repartition(7), spark.createDataFrame(policies, POLICY), NOW)
    assert {r.group_id: (r.state, r.down_since) for r in got.collect()} == expected
    assert {s for s, _ in expected.values()} >= {"unknown", "answers_console", "still_sends", "lost", "waits_for_person", "snoozed", "taken_over", "confirming", "take_over"}


def test_later_views_and_other_witnesses_do_not_count(spark):
    seen = spark.createDataFrame([(1, "console", NOW, True), (1, "standby", NOW, True), (1, "standby", NOW + 1, False), (1, "rumour", NOW, False), (1, None, NOW, False)], "group_id long, witness string, at_time long, blind boolean")
    got = sites.lost_primaries(seen.withColumn("extra", F.lit(1)), spark.createDataFrame([(1, True, True, 0, None, None)], POLICY), NOW).collect()
    assert [(r.state, r.act_in) for r in got] == [("take_over", 0)]


def test_advice_on_hosts(spark):
    hosts = spark.createDataFrame([("a", True, True, True), ("b", None, False, True)], "host string, psql boolean, waldump boolean, zstd boolean")
    fields = "host string, target string, running boolean, owned boolean, readable boolean, archive_mode string, foreign_tool string, wal_level string, control boolean, checksums boolean, hints string, ssl string, fsync string, full_page_writes string"
    well = ("a", "/1", True, False, True, "on", None, "replica", True, True, None, "on", None, None)
    ill = ("b", "/2", True, None, False, None, "x", "minimal", True, None, "off", "off", "off", None)
    silent = ("b", "/3", True, True, None, "always", "x", None, None, None, None, None, None, None)
    instances = spark.createDataFrame([well, ill, silent, ("a", "/4", True, False, True, "on", "", "replica", False, None, None, "", "on", "on")], fields)
    managers = spark.createDataFrame([("a", "s", "http", False), ("a", "t", None, False), ("b", "u", "http", None)], "host string, scope string, url string, reachable boolean")
    stores = spark.createDataFrame([("a", "e", 1), ("a", "f", 2), ("a", "g", 3), ("b", "h", 0), ("b", "i", None)], "host string, name string, members int")
    got = {(r.host, r.code, r.detail) for r in advice.host_advice(hosts, instances, managers, stores).collect()}
    assert got == {
        ("b", "NO_PSQL", "host"), ("b", "NO_WALDUMP", "host"), ("a", "MULTI_INSTANCE", "host"), ("b", "UNREADABLE", "/2"), ("b", "ARCHIVE_OFF", "/2"), ("b", "WAL_MINIMAL", "/2"), ("b", "NO_CHECKSUMS", "/2"), ("b", "SSL_OFF", "/2"),
        ("b", "UNSAFE_DURABILITY", "/2"), ("b", "ARCHIVE_FOREIGN", "/3"), ("a", "PATRONI_REST", "s"), ("a", "ETCD_SINGLE", "e"), ("a", "ETCD_EVEN", "f"),
    }
