"""As-of joins and interval differences against plain loops, over bucket edges and ties."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import catalog, chains, intervals


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_as_of(spark, width):
    rng = random.Random(width)
    known = [(rng.choice([1, 1, 1, 2]), rng.randrange(-40, 60), rng.randrange(9)) for _ in range(120)]
    asked = [(rng.choice([1, 2, 3]), rng.randrange(-50, 70), k) for k in range(80)]
    got = intervals.as_of(spark.createDataFrame(asked, "key long, when long, row long"), spark.createDataFrame(known, "key long, when long, value long"), ["key"], width)
    want = [(k, w, r, max((v for a, b, v in known if a == k and b <= w), default=None)) for k, w, r in asked]
    assert Counter(map(tuple, got.collect())) == Counter(want)


@pytest.mark.parametrize("bucket", [1, 4, 1000])
def test_difference(spark, bucket):
    rng = random.Random(bucket)
    held = [(m, a, a + rng.randrange(0, 6)) for m in (0, 1) for a in range(-20, 60, 9) if rng.random() < 0.8] + [(0, 5, 30), (0, 8, 9)]
    wanted = [(k, m, a, a + n) for k in range(30) for a, n in [(rng.randrange(-25, 50), rng.randrange(-1, 30))] for m in rng.choice([[0], [1], [0, 1], [7]])]
    got = intervals.difference(spark.createDataFrame(wanted, "id long, m int, lo long, hi long"), spark.createDataFrame(held, "m int, first long, last long"), ["id"], ["m"], bucket)
    want = []
    for k in range(30):
        mine = [x for x in wanted if x[0] == k]
        ms = {m for _, m, _, _ in mine}
        free = [n for n in range(mine[0][2], mine[0][3] + 1) if not any(m in ms and a <= n <= b for m, a, b in held)]
        want += [(k, n, next(e for e in range(n, 999) if e + 1 not in free)) for n in free if n - 1 not in free]
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_one_stanza_is_spread_over_buckets(spark):
    sets = spark.range(4000).selectExpr("1 AS stanza", "id", "id * 10 AS stop_pos", "id * 10 AS ended", "if(id % 50 = 0, 'full', 'incr') AS type", "'COMPLETE' AS status")
    targets = spark.createDataFrame([(1, 1, "lsn", 39_999), (2, 1, "lsn", 5), (3, 1, "xid", 777), (4, 1, "xid", None), (5, 1, "name", None), (6, 1, "latest", None), (7, 1, "time", 101), (8, 1, "time", 102), (9, 1, "lsn", -1), (10, 1, "xid", -1), (11, 2, "latest", None), (12, 1, "time", None)], "target long, stanza int, kind string, value long")
    got = {r.target: (r.set_id, r.problem) for r in chains.choose_by_target(targets, sets, width=128, day=256).collect()}
    early, none = "earlier than every backup", "no backup"
    assert got == {1: (3999, None), 2: (0, None), 3: (77, None), 4: (3950, None), 5: (3950, None), 6: (3999, None), 7: (9, None), 8: (10, None), 9: (None, early), 10: (3950, None), 11: (None, none), 12: (3999, None)}


def test_fingerprint_of_any_parts(spark):
    rows = spark.range(500).select(F.concat(F.lit("row "), "id").alias("body"))
    one = catalog.table_fingerprint(rows).collect()
    assert one == catalog.table_fingerprint(rows.orderBy(F.desc("body")).repartition(7)).collect()
    assert one != catalog.table_fingerprint(rows.union(rows.limit(1))).collect() != catalog.table_fingerprint(rows.union(rows.limit(2))).collect()
    assert catalog.table_fingerprint(rows.limit(0)).collect()[0].n == 0


def test_fingerprint_is_that_of_the_sorted_rows(spark):
    from hashlib import md5

    bodies = [f"row {k % 450}" for k in range(500)]
    buckets = {}
    for m in sorted(md5(b.encode()).hexdigest() for b in bodies):
        buckets.setdefault(m[:2], []).append(m)
    want = md5("".join(b + md5("".join(ms).encode()).hexdigest() for b, ms in sorted(buckets.items())).encode()).hexdigest()
    got = catalog.table_fingerprint(spark.createDataFrame([(b,) for b in bodies], "body string"), 256).collect()
    assert [tuple(r) for r in got] == [(want, 500)]


def test_trees_with_keys_of_two_columns(spark):
    """A table that refers to itself by two columns: what goes anyway is no victim, a null part refers to nothing."""
    from tidemark.operators import diff

    people = [(1, 1, None), (1, 2, 1), (1, 3, 2), (1, 4, 2), (2, 1, None), (2, 2, 1), (1, 5, None), (1, 6, 7), (1, 7, 6)]
    tables = {"person": spark.createDataFrame(people, "org long, id long, boss long"), "desk": spark.createDataFrame([(1, 3), (2, 2), (1, None), (None, 4), (1, 7)], "of_org long, of_id long")}
    keys = [("person", ["org", "boss"], "person", ["org", "id"], "cascade"), ("desk", ["of_org", "of_id"], "person", ["org", "id"], "set_default")]
    effects = lambda gone: sorted(map(tuple, diff.delete_effects(tables, keys, "person", tables["person"].filter(gone)).collect()))
    assert effects("org = 1 AND id = 1") == [(1, "person", "cascade", 1), (2, "person", "cascade", 2), (3, "desk", "set_default", 1)]
    assert effects("org = 1 AND id <= 2") == [(1, "person", "cascade", 2), (2, "desk", "set_default", 1)]
    assert effects("id = 7") == [(1, "desk", "set_default", 1), (1, "person", "cascade", 1)]
