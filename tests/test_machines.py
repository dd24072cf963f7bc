"""Machines with timers: streams, however cut, against the plain fold of each key's rows."""

import random
import tempfile
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import machines, stateful

SECOND = 1_000_000
T0 = 1_700_000_000 * SECOND


def cut_stream(spark, rows, schema, cuts):
    """Rows by their times, in as many files as ``cuts``, read one file a micro-batch."""
    rows = sorted(rows, key=lambda r: r[1])
    path = f"file://{tempfile.mkdtemp(prefix='cut-')}"
    for k in range(cuts):
        spark.createDataFrame(rows[k * len(rows) // cuts : (k + 1) * len(rows) // cuts], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def by_key(rows, names):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(SimpleNamespace(**dict(zip(names, r, strict=True))))
    return out


def clock(rows):
    """The last watermark, in microseconds: ten seconds behind the newest row, in whole milliseconds."""
    return (max(r[1] for r in rows) // 1000 - 10_000) * 1000


def looks():
    rng = random.Random(4)
    rows = [(6, T0, "info"), (6, T0 + 500 * SECOND, "critical"), (1, T0, "warning"), (2, T0, "critical"), (2, T0 + 400 * SECOND, None), (3, T0 + SECOND, "info"), (4, T0, "warning"), (4, T0 + 30 * SECOND, None), (5, T0, "critical"), (5, T0 + 60 * SECOND, "info")]
    for key in range(10, 18):
        at = T0
        for _ in range(rng.randrange(1, 7)):
            at += rng.choice([20, 90, 130, 310, 900, 90_000]) * SECOND + rng.randrange(5)
            rows.append((key, at, rng.choice(["info", "warning", "critical", None, None])))
    rows.append((99, max(r[1] for r in rows) + 2 * 86_400 * SECOND, None))
    return rows


def fails(channel, key, at):
    return zlib.crc32(f"{channel}|{key}|{at}".encode()) % 3 == 0


def send(channel, lines):
    return [not fails(channel, k, t) for k, t in zip(lines["key"], lines["at_time"], strict=True)]


@pytest.mark.parametrize("cuts", [1, 6])
def test_notices_are_delivered(spark, cuts):
    rows = looks()
    channels = [("ops", "info"), ("phone", "critical")]
    want = []
    for channel, least in channels:
        for key, own in by_key(rows, ["key", "at_time", "severity"]).items():
            for r in own:
                r.least = stateful.RANKS[least]
            deliver = lambda told, c=channel, k=key: SimpleNamespace(at_time=told[0], ok=not fails(c, k, told[0]))
            want += [(channel, key, *told, not fails(channel, key, told[0])) for told in machines.folded(machines.Notices(), own, clock(rows), deliver)]
    stream = cut_stream(spark, rows, "key long, at_time long, severity string", cuts)
    got = [tuple(r) for r in machines.delivered(stream, spark.createDataFrame(channels, "channel string, least string"), send).collect()]
    assert Counter(got) == Counter(want)
    assert {r[3] for r in got} == {"opened", "worse", "reminder", "resolved"} and any(not r[5] for r in got)


def test_deliveries_take_no_micro_batches_of_their_own(spark, tmp_path, monkeypatch):
    for module in (machines, stateful):
        monkeypatch.setattr(module, "shared_dir", lambda spark: f"file://{tmp_path}", raising=False)
    rows = [(key, T0 + k * 86_400 * SECOND + key, "critical") for key in range(50) for k in range(9)] + [(None, T0, "critical")]
    stream = cut_stream(spark, rows, "key long, at_time long, severity string", 1)
    got = machines.delivered(stream, spark.createDataFrame([("ops", "info")], "channel string, least string"), lambda channel, lines: [True] * len(lines)).collect()
    assert Counter(r.event for r in got if r.key is not None) == {"opened": 50, "reminder": 50 * 7}
    assert sorted((r.at_time, r.event) for r in got if r.key is None)[:2] == [(T0, "opened"), (T0 + 86_400 * SECOND, "reminder")]
    batches = [x for x in next(tmp_path.glob("streams/notices-*/state/commits")).iterdir() if x.name.isdigit()]
    assert len(batches) <= 2  # the looks, and what falls due before the last watermark; an answer is none


@pytest.mark.parametrize("later", [0, 1])
def test_timers_of_the_last_millisecond(spark, later):
    rows = [(1, T0, "warning"), (2, T0 + 130 * SECOND + later * 1000, None)]
    stream = cut_stream(spark, rows, "key long, at_time long, severity string", 1)
    got = machines.delivered(stream, spark.createDataFrame([("ops", "info")], "channel string, least string"), lambda channel, lines: [True] * len(lines)).collect()
    assert [(r.at_time, r.event) for r in got] == [(T0 + 120 * SECOND, "opened")] * later


def notices(rows, least="info", ok=lambda told: True):
    own = [SimpleNamespace(at_time=T0 + t * SECOND, severity=s, least=stateful.RANKS[least]) for t, s in rows]
    told = machines.folded(machines.Notices(), own, T0 + 10**6 * SECOND, lambda x: SimpleNamespace(at_time=x[0], ok=ok(((x[0] - T0) // SECOND, x[1]))))
    return [((t - T0) // SECOND, e) for t, e, _ in told if t < T0 + 80_000 * SECOND]


def test_rules_of_notices():
    assert notices([(0, "warning")]) == [(120, "opened")]
    assert notices([(0, "critical"), (100, None)]) == [(0, "opened"), (400, "resolved")]  # gone for five minutes, without another row
    assert notices([(0, "warning"), (60, None), (90, "warning")]) == [(210, "opened")]  # flapping starts the two minutes anew
    assert notices([(0, "critical"), (50, None), (200, "critical"), (260, None)]) == [(0, "opened"), (560, "resolved")]
    assert notices([(0, "warning"), (500, "critical")]) == [(120, "opened"), (500, "worse")]
    assert notices([(0, "critical"), (50, "info")], "critical") == [(0, "opened")]  # still there, below the channel's threshold
    assert notices([(0, "critical"), (50, "info"), (90, None)], "critical") == [(0, "opened"), (390, "resolved")]
    assert notices([(0, "warning")], "critical") == []
    assert notices([(0, "critical")], ok=lambda x: x[0] >= 600) == [(0, "opened"), (300, "opened"), (600, "opened")]  # repeated until it is delivered
    assert notices([(0, "critical"), (10, None)], ok=lambda x: False) == [(0, "opened")]  # never delivered and gone: nothing to resolve


def work():
    rng = random.Random(9)
    rows = []
    for op in range(40):
        at = T0 + rng.randrange(1000)
        rows.append((op, at, "submit", rng.choice([60, 400, 5000]) * SECOND))
        for _ in range(rng.randrange(0, 16)):
            at += rng.choice([5, 50, 119, 120, 121, 130, 500]) * SECOND + rng.randrange(3)
            rows.append((op, at, rng.choice(["poll", "poll", "poll", "running", "running", "submit", rng.choice(["succeeded", "failed", "poll", "poll"])]), 60 * SECOND))
    op, at = 100, T0
    rows.append((op, at, "submit", 10_000 * SECOND))
    for k in range(5):
        rows.append((op, at + (1 + 200 * k) * SECOND, "poll", 0))
    rows.append((op, at + 2000 * SECOND, "running", 0))
    rows.append((101, T0 + 10**5 * SECOND, "submit", 5 * SECOND))
    return rows


@pytest.mark.parametrize("cuts", [1, 5])
def test_leases(spark, cuts):
    rows = work()
    want = [(op, *told) for op, own in by_key(rows, ["op", "at_time", "kind", "ttl"]).items() for told in machines.folded(machines.Leases(), own, clock(rows))]
    stream = cut_stream(spark, rows, "op long, at_time long, kind string, ttl long", cuts)
    got = [tuple(r) for r in stateful.drained(machines.leases(stream), "leases").collect()]
    assert Counter(got) == Counter(want)
    fifth = [(t - T0, e) for op, t, e, *_ in sorted(want) if op == 100 and e in ("given up", "adopted")]
    # The fifth lease lapses on time; the agent's word counts after all, and lapses again when nothing follows it.
    assert fifth == [(921 * SECOND, "given up"), (2000 * SECOND, "adopted"), (2120 * SECOND, "given up")]
    assert {e for _, _, e, *_ in want} >= {"queued", "leased", "running", "redelivered", "expired", "given up", "adopted", "refused", "succeeded", "failed"}


@pytest.mark.parametrize("cuts", [1, 4])
def test_frames_drop_the_oldest(spark, cuts):
    entries = [(k, T0 + k * 1000, k % 3, k % 5) for k in range(1500)] + [(9000, T0 + 60 * SECOND, 0, 0)]
    subscriptions = [(1, None, 0), (2, 1, 0), (3, None, 4), (4, 7, 0)]
    stream = cut_stream(spark, entries, "entry long, at_time long, cluster_id long, rank int", cuts)
    got = stateful.drained(machines.frames(stream, spark.createDataFrame(subscriptions, "subscriber long, cluster_id long, least int"), 400, SECOND), "frames").collect()
    want = Counter()
    for s, cluster, least in subscriptions:
        ticks = defaultdict(list)
        for k, at, c, rank in entries[:-1]:
            if (cluster is None or c == cluster) and rank >= least:
                ticks[(at // SECOND + 1) * SECOND].append(k)
        want.update((s, at, tuple(own[-400:]), max(0, len(own) - 400)) for at, own in ticks.items())
    assert Counter((r.subscriber, r.at_time, tuple(r.entries), r.dropped) for r in got) == want
    assert [r.dropped for r in sorted(got, key=lambda r: r.at_time) if r.subscriber == 1] == [600, 100]


def test_entries_of_a_tick_come_together(spark):
    rows = [(s, T0 + k * 1000, k) for s in (1, 2) for k in range(3000)]
    parts = machines.ticked(spark.createDataFrame(rows, "subscriber long, at_time long, entry long").repartition(3), 10, SECOND).collect()
    assert len(parts) <= 2 * 3 * 3 and all(len(p.entries) <= 10 for p in parts)
    assert sum(len(p.entries) + p.dropped for p in parts) == len(rows)
    for s in (1, 2):
        own = [SimpleNamespace(**p.asDict(), entry=None) for p in parts if p.subscriber == s]
        assert machines.folded(machines.Frames(10, SECOND), own, T0 + 9 * SECOND) == [(T0 + (k + 1) * SECOND, list(range(1000 * k + 990, 1000 * k + 1000)), 990) for k in range(3)]


def test_a_subscriber_that_is_backed_up():
    rows = [SimpleNamespace(at_time=T0 + k * 100_000, entry=k, busy_until=None) for k in range(40)] + [SimpleNamespace(at_time=T0 + 150_000, entry=None, busy_until=T0 + 2 * SECOND + 1)]
    told = machines.folded(machines.Frames(12, SECOND), rows, T0 + 100 * SECOND)
    assert [((t - T0) // SECOND, len(e), d) for t, e, d in told] == [(3, 12, 18), (4, 10, 0)]
    assert machines.folded(machines.Frames(600, SECOND), [SimpleNamespace(at_time=T0, entry=k, busy_until=None) for k in range(650)], T0 + 9 * SECOND) == [(T0 + SECOND, list(range(50, 650)), 50)]


def test_keys_without_state_are_forgotten(spark):
    rows = [(1, T0, "info"), (1, T0 + 10 * SECOND, None)]
    stream = cut_stream(spark, rows, "key long, at_time long, severity string", 1)
    assert machines.delivered(stream.withColumn("key", F.col("key")), spark.createDataFrame([("ops", "critical")], "channel string, least string"), send).count() == 0
