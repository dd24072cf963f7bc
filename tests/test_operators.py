"""Small cases by hand, each a rule that is easy to get wrong."""

import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions import lsn
from tidemark.operators import access, chains, diff, fleet, graphs, operations, scopes, wal
from tidemark.plans import operations as plans
from tidemark.plans import catalog as plans_catalog
from tidemark.plans import chains as plans_chains
from tidemark.plans import testbed as T
from tidemark.streaming import stateful


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


def test_positions_beyond_signed_64_bits(spark):
    df = spark.createDataFrame([("FFFFFFFF/FFFFFFFF",), ("0/1",), ("x",), (None,), ("12",)], "t string")
    got = [r.n for r in df.select(lsn.lsn_number(F.col("t")).alias("n")).collect()]
    assert [None if x is None else int(x) for x in got] == [2**64 - 1, 1, None, None, 12]
    back = df.select(lsn.lsn_text(lsn.lsn_number(F.col("t"))).alias("b")).first().b
    assert back == "FFFFFFFF/FFFFFFFF"


def test_segment_names_round_trip(spark):
    df = spark.createDataFrame([(7, 0), (1, 255), (3, 256), (2, 123_456_789)], "tli int, segno long")
    named = df.withColumn("name", lsn.segment_name(F.col("tli"), F.col("segno")))
    assert named.filter("segno = 256").first().name == "000000030000000100000000"
    assert rows(named.select("tli", "segno", lsn.parse_segment(F.col("name")).alias("p")).filter("p.tli = tli AND p.segno = segno"), "tli") == [(1,), (2,), (3,), (7,)]


def test_last_segment_on_a_boundary(spark):
    df = spark.createDataFrame([(32 << 20, True), (32 << 20, False), ((32 << 20) + 1, True)], "stop long, standby boolean")
    assert [r.s for r in df.select(lsn.last_segment(F.col("stop"), F.col("standby")).alias("s")).collect()] == [1, 2, 2]


def test_gap_over_the_edge_of_a_stretch(spark):
    edge = wal.STRETCH
    df = spark.createDataFrame([(1, edge - 2), (1, edge - 1), (1, edge + 5), (1, 3 * edge), (2, 5), (2, 5)], "tli int, segno long")
    assert rows(wal.gaps(df)) == [(1, edge, edge + 4, 5), (1, edge + 6, 3 * edge - 1, 2 * edge - 6)]
    assert rows(wal.gaps(df.filter("tli = 3"))) == []


def test_lines_that_report_nothing(spark):
    lines = [
        "rmgr: Transaction len: 1, tx: 7, lsn: 0/A, desc: COMMIT 2024-01-01 00:00:00.5 UTC; rels: base/5/1 pg_tblspc/9/PG_16/5/2",
        "rmgr: Transaction len: 1, tx: 7, lsn: 0/B, desc: ABORT; rels: base/5/1",
        "rmgr: Storage len: 1, tx: 7, lsn: 0/C, desc: TRUNCATE base/5/1 to 0",
        'rmgr: Tablespace len: 1, tx: 7, lsn: 0/D, desc: CREATE 16 "/srv/t"',
        "rmgr: Database len: 1, tx: 7, lsn: 0/E, desc: CREATE copy dir 1663/4 to 1663/5",
        "rmgr: Database len: 1, tx: 7, lsn: 0/F, desc: DROP dir 1663/5",
        "rmgr: Heap len: 1, tx: 7, lsn: 0/10, desc: INSERT",
        "rmgr: Database len: 1, tx: 7, lsn: 0/20, desc: DROP 1663/5 1664/5",
        "rmgr: Database len: 1, tx: 7, lsn: 0/30, desc: DROP dir 1663/5 of 9/9",
    ]
    got = wal.parse_lines(spark.createDataFrame([(x,) for x in lines], "line string"))
    assert [(r.lsn, r.xid, r.kind, r.nrels) for r in got.orderBy(F.length("lsn"), "lsn").collect()] == [("0/A", "7", "DROP", 2), ("0/D", "?", "CREATE TABLESPACE", 1), ("0/E", "?", "CREATE DATABASE", 1), ("0/F", "7", "DROP DATABASE", 1), ("0/20", "7", "DROP DATABASE", 2), ("0/30", "7", "DROP DATABASE", 1)]
    assert got.filter("kind = 'DROP'").first().rels[1].rel == "2"


def test_chain_problems(spark):
    sets = [(1, None, "full", "COMPLETE"), (2, 1, "incr", "COMPLETE"), (3, 2, "incr", "FAILED"), (4, 3, "incr", "COMPLETE"), (5, 99, "diff", "COMPLETE"), (6, 7, "incr", "COMPLETE"), (7, 6, "incr", "COMPLETE"), (8, None, "incr", "COMPLETE")]
    got = rows(chains.parent_chains(spark.createDataFrame(sets, "id long, parent long, type string, status string")))
    assert got == [(1, 1, 1, None), (2, 1, 2, None), (3, 1, 3, None), (4, None, None, "incomplete"), (5, None, None, "missing"), (6, None, None, "cycle"), (7, None, None, "cycle"), (8, None, None, "not_full")]


def test_long_parent_chains(spark):
    sets = [(k, k - 1 if k else None, "incr" if k else "full", "COMPLETE") for k in range(300)] + [(k, 1000 + (k - 999) % 3, "incr", "COMPLETE") for k in range(1000, 1003)]
    got = {r.id: (r.base, r.length, r.problem) for r in chains.parent_chains(spark.createDataFrame(sets, "id long, parent long, type string, status string")).collect()}
    assert got == {k: (0, k + 1, None) for k in range(300)} | {k: (None, None, "cycle") for k in range(1000, 1003)}


def test_uncovered_at_the_end_of_a_long_chain(spark, tmp_path):
    """The registered query over one stanza that needs segments 0 to 600, of which timeline 0 has all but 300 and timeline 1 none."""
    orders = [(1, 6300, "F"), (1, 6900, "F")]
    spark.createDataFrame(orders, "o_custkey long, o_orderkey long, o_orderstatus string").selectExpr("*", "timestamp'2001-01-01' AS o_orderdate", "1.0 AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(601).filter("id <> 300").selectExpr("3 AS user_id", f"timestamp_seconds(({T.FIRST} + id) * 3600) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    assert rows(plans_chains.j4_uncovered_all(spark, str(tmp_path))) == [(1, T.FIRST + 300)]


def _sets(spark, sets):
    return spark.createDataFrame(sets, "stanza long, id long, base long, type string, status string, started long, ended long, promoted boolean")


def test_retention_keeps_the_full_that_carries_the_cutoff(spark):
    day = 86400
    sets = _sets(spark, [(1, k, k, "full", "COMPLETE", k * 7 * day, k * 7 * day + (3 * day if k == 3 else 60), False) for k in range(1, 9)])
    none = spark.createDataFrame([], "id long")
    got = dict((i, v) for _, i, v in rows(chains.retention(sets, 58 * day, 2, 35, none)))
    # The cutoff is day 23: full 3 started on day 21 but ended on day 24, so full 2 carries the cutoff.
    assert [k for k, v in got.items() if v == "expire"] == [1, 3] and got[2] == "keep"


def test_retention_counts_planned_fulls(spark):
    sets = _sets(spark, [(1, 1, 1, "full", "COMPLETE", 1, 2, False), (1, 2, 2, "full", "COMPLETE", 3, 4, True), (1, 3, 3, "full", "COMPLETE", 5, 6, False), (1, 4, 3, "incr", "COMPLETE", 7, 8, False), (1, 5, 9, "incr", "COMPLETE", 8, 9, False), (1, 6, 3, "incr", "FAILED", 9, 9, False)])
    got = dict((i, v) for _, i, v in rows(chains.retention(sets, 100, 2, 0, spark.createDataFrame([(5,)], "id long"))))
    assert got == {1: "keep", 2: "keep", 3: "keep", 4: "keep", 5: "pinned", 6: "junk"}


def test_margin_of_incremental_sets(spark):
    sets = spark.createDataFrame([(1, 1, "full", "COMPLETE", 100), (1, 2, "incr", "COMPLETE", 110)], "stanza long, id long, type string, status string, stop_pos long")
    targets = spark.createDataFrame([(1, 99), (1, 100), (1, 111), (1, 112)], "stanza long, target long")
    assert rows(chains.choose_sets(targets, sets)) == [(1, 99, None), (1, 100, 1), (1, 111, 1), (1, 112, 2)]


def test_diff_of_nulls_and_columns_of_one_side(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, 5, "x")], "k int, v int, only string")
    b = spark.createDataFrame([(1, None), (2, None), (3, 1)], "k int, v int")
    assert rows(diff.row_diff(a, b, ["k"])) == [(1, "same", None), (2, "changed", "v"), (3, "added_since", None)]


def test_levels_of_a_cycle_are_zero(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 4), (6, 4)], "src int, dst int")
    got = rows(graphs.levels(edges, spark.createDataFrame([(k,) for k in range(1, 7)], "node int")))
    assert got == [(1, 2), (2, 1), (3, 0), (4, 0), (5, 0), (6, 0)]


def test_tops_of_a_long_path_and_of_a_cycle(spark):
    pointers = spark.createDataFrame([(k, k - 1) for k in range(1, 41)] + [(100, 101), (101, 102), (102, 100), (103, 100)], "node long, up long")
    assert rows(graphs.tops(pointers), "node", "top") == [(k, 0) for k in range(1, 41)]


def test_components_of_a_long_path(spark):
    edges = spark.range(300).selectExpr("id AS src", "id + 1 AS dst").union(spark.createDataFrame([(500, 501)], "src long, dst long"))
    nodes = edges.selectExpr("src AS node").union(edges.selectExpr("dst")).distinct()
    assert graphs.components(edges, nodes).groupBy("root").count().orderBy("root").collect() == [(0, 301), (500, 2)]


def test_components_of_all_orders(spark, tmp_path):
    orders = [(k % 37 + 2000, k * 17) for k in range(1, 60)] + [(5001, 7), (5002, 1007), (5003, 13)]
    spark.createDataFrame(orders, "o_custkey long, o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    groups = []
    for a, b in orders:
        met = [g for g in groups if a in g or b % 1000 in g]
        groups = [g for g in groups if g not in met] + [{a, b % 1000}.union(*met)]
    assert rows(plans_catalog.r7_components_all(spark, str(tmp_path)), "node", "root") == sorted((n, min(g)) for g in groups for n in g)


def test_closures_of_all_views(spark, tmp_path):
    parts = range(1, 61)
    spark.createDataFrame([(k,) for k in parts], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    below = {k: {k // 2, k // 3} for k in parts}
    below[3] = below[3] | {7}  # part 7 and its half depend on each other
    want = []
    for root in parts:
        depth, front = {root: 0}, [root]
        for node in front:
            for following in below.get(node, ()):
                if following not in depth:
                    depth[following] = depth[node] + 1
                    front.append(following)
        want += [(root, node, n) for node, n in depth.items()]
    assert rows(plans_catalog.r5_view_closure_all(spark, str(tmp_path)), "root", "node", "depth") == sorted(want)


def test_levels_of_a_closure_are_written_in_blocks(spark, monkeypatch):
    written = []
    keep = graphs.cut

    def cut(df):
        done = keep(df)
        written.append(done.count())
        return done

    monkeypatch.setattr(graphs, "cut", cut)
    edges = spark.range(1, 641).selectExpr("id AS src", "id DIV 2 AS dst")
    got = graphs.closure(edges, spark.range(1, 641).selectExpr("id AS root"))
    want = sorted((k, k >> n, n) for k in range(1, 641) for n in range(k.bit_length() + 1))
    assert rows(got, "root", "node", "depth") == want
    assert sum(written) < len(want) / 2  # edges, names of roots and first level are 1,920 of it


def test_rounds_of_a_closure_leave_no_shuffle_files(spark):
    def there():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}

    before = there()
    got = graphs.closure(spark.range(1, 200).selectExpr("id AS src", "id DIV 2 AS dst"), spark.range(1, 200).selectExpr("id AS root"))
    until = time.time() + 20
    while there() - before and time.time() < until:  # files go a moment after their query
        time.sleep(0.2)
    assert not there() - before
    assert got.count() == sum(k.bit_length() + 1 for k in range(1, 200))


def test_roots_of_a_closure_may_be_names_or_unknown(spark):
    names = [f"v{k:03}" for k in range(130)]
    edges = spark.createDataFrame([(n, "hub") for n in names[:129]] + [("hub", "v005"), ("hub", None)], "src string, dst string")
    got = graphs.closure(edges, spark.createDataFrame([(n,) for n in [*names, "v000", None]], "root string"), 2).collect()
    want = {(n, n, 0) for n in [*names, None]} | {(n, "hub", 1) for n in names[:129]} | {(n, x, 2) for n in names[:129] for x in ("v005", None) if n != x}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_unknown_address_is_not_covered(spark):
    rules = spark.createDataFrame([(1, 1, "host", "all", "all", "db.example", "md5"), (1, 2, "host", "all", "all", "10.0.0.1/32", "md5")], "server int, rule_no int, type string, database string, user string, address string, method string")
    assert rows(access.shadowing(rules)) == []


def test_disabled_scope_stops_the_search(spark):
    clusters = spark.createDataFrame([(1, "a/b", "prod"), (2, "a", "prod"), (3, None, "dev")], "cluster_id long, folder string, environment string")
    said = spark.createDataFrame([("folder", "a/b", None, None, True), ("env", "prod", None, "p", False)], "scope string, key string, template string, policy string, disabled boolean")
    got = rows(scopes.resolve(clusters, said, spark.createDataFrame([], "template string, template_policy string")))
    assert got == [(1, None, "folder", True), (2, "p", "env", False), (3, None, None, False)]


def test_unknown_lag_stays_unknown(spark):
    nodes = spark.createDataFrame([(1, 1, None, True, None, None, 5, None, None, None)], "node_id long, cluster_id long, last_seen long, in_recovery boolean, dcs_role string, sync_state string, lsn long, reported_lag long, load double, ncpu int")
    assert rows(fleet.roles(nodes, 100), "role", "lag", "state") == [("replica", None, "offline")]


def test_midnight_window(spark):
    df = spark.createDataFrame([(23, 22, 6), (6, 22, 6), (7, 5, 5)], "h int, a int, b int")
    assert [r.x for r in df.select(operations.heavy_hours(F.col("h"), F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, True]


def _stream(spark, tmp_path, batches, schema):
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def test_notifications_over_micro_batches(spark, tmp_path):
    s = 1_000_000
    looks = [(1, 0, "warning"), (1, 60 * s, "warning"), (1, 120 * s, "warning"), (1, 130 * s, "critical"), (1, 140 * s, None), (1, 200 * s, "critical"), (1, 300 * s, None), (1, 700 * s, None), (2, 0, "info"), (2, 10 * s, None), (3, 5 * s, "critical")]
    stream = _stream(spark, tmp_path, [looks[:3] + looks[8:], looks[3:8]], "key long, at_time long, severity string")
    got = rows(stateful.drained(stateful.notifications(stream), "n"))
    assert got == [(1, 120 * s, "opened", "warning"), (1, 130 * s, "worse", "critical"), (1, 700 * s, "resolved", None), (3, 5 * s, "opened", "critical")]


def test_reports_that_conflict(spark, tmp_path):
    said = [(1, 1, "leased"), (1, 2, "running"), (1, 3, "succeeded"), (1, 4, "succeeded"), (1, 5, "failed"), (2, 1, "running"), (3, 1, "leased"), (3, 2, "expired"), (3, 3, "succeeded")]
    got = rows(stateful.drained(stateful.reports(_stream(spark, tmp_path, [said], "op long, at_time long, report string")), "r"), "op", "at_time", "verdict", "status")
    assert got == [(1, 1, "accepted", "leased"), (1, 2, "accepted", "running"), (1, 3, "accepted", "succeeded"), (1, 4, "accepted", "succeeded"), (1, 5, "refused", "succeeded"), (2, 1, "refused", "queued"), (3, 1, "accepted", "leased"), (3, 2, "accepted", "expired"), (3, 3, "accepted", "succeeded")]


def test_cascades_that_refer_to_themselves(spark):
    """A table whose rows point at each other, one loop among them, and two keys that lead to the same child."""
    people = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 6), (6, 5), (7, None)], "id int, boss int")
    notes = spark.createDataFrame([(1, 2, 2), (2, 4, 1), (3, 7, 7), (4, 7, 3)], "note int, by int, about int")
    marks = spark.createDataFrame([(1,), (1,), (3,), (4,)], "note int")
    keys = [("people", "boss", "people", "id", "cascade"), ("notes", "by", "people", "id", "cascade"), ("notes", "about", "people", "id", "cascade"), ("marks", "note", "notes", "note", "block")]
    tables = {"people": people, "notes": notes, "marks": marks}
    got = {(r.level, r.child, r.action, r.n) for r in diff.delete_effects(tables, keys, "people", people.filter("id = 1")).collect()}
    assert got == {(1, "people", "cascade", 1), (1, "notes", "cascade", 1), (2, "people", "cascade", 1), (2, "notes", "cascade", 1), (3, "people", "cascade", 1), (3, "notes", "cascade", 1), (3, "marks", "block", 2), (4, "marks", "block", 1)}
    loop = diff.delete_effects({"people": people}, keys[:1], "people", people.filter("id = 5")).collect()
    assert [(r.level, r.n) for r in loop] == [(1, 1)]
    with pytest.raises(ValueError):
        diff.delete_effects({"people": people}, keys[:1], "people", people.filter("id = 1"), depth=2)


def test_closures_have_no_limit_of_their_own(spark):
    edges = spark.range(27).selectExpr("id AS src", "id + 1 AS dst")
    roots = spark.createDataFrame([(0,)], "root long")
    assert graphs.closure(edges, roots).agg({"depth": "max"}).first()[0] == 27 and graphs.closure(edges, roots, 25).count() == 26


def test_networks_of_both_families(spark):
    import ipaddress

    good = ["10.1.2.3", "10.1.2.3/17", "0.0.0.0/0", "::/0", "::1", "fe80::1:2/10", "2001:db8::/33", "2001:DB8:0:1:2:3:4:5/127", "1:2:3:4:5:6:7::", "2001:db8::ff/126", "::ffff:1/121"]
    bad = ["host.example", "1::2::3", "1:2:3", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7:8::", "12345::", "::1/129", "10.0.0.256", "::g", "samenet", ":1", "1:"]
    df = spark.createDataFrame([(x,) for x in [*good, *bad]], "address string")
    got = {r.address: r.net for r in df.select("address", access.network(F.col("address")).alias("net")).collect()}
    for x in good:
        n = ipaddress.ip_network(x, strict=False)
        digits = lambda a: f"{n.version}{int(a):0{n.max_prefixlen // 4}x}"  # noqa: B023, E731
        assert tuple(got[x]) == (digits(n[0]), digits(n[-1]), n.prefixlen), x
    assert [x for x in bad if got[x] is not None] == []


def test_decisions_by_pattern_family_and_gss(spark):
    rules = spark.createDataFrame([(1, 1, "hostgssenc", "all", "all", "all", "gss"), (1, 2, "host", "/^app_", "/^svc[0-9]+$", "2001:db8::/32", "scram"), (1, 3, "hostnogssenc", "all", "all", "10.0.0.0/8", "cert")], "server int, rule_no int, type string, database string, user string, address string, method string")
    probes = spark.createDataFrame([(1, 1, "app_x", "svc7", "2001:db8::5", True, False), (1, 2, "app_x", "svc", "2001:db8::5", True, False), (1, 3, "y", "z", "10.9.9.9", True, False), (1, 4, "y", "z", "fe80::1", True, True), (1, 5, "y", "z", "fe80::1", True, None)], "server int, probe int, database string, user string, ip string, ssl boolean, gss boolean")
    members = spark.createDataFrame([], "role string, user string")
    assert rows(access.decisions(probes, rules, members), "probe", "method") == [(1, "scram"), (2, "refused"), (3, "cert"), (4, "gss"), (5, "refused")]


def test_paths_and_times(spark):
    from tidemark.functions import text

    paths = {"db.s.t": ["db", "s", "t"], 'db."a.b".t': ["db", "a.b", "t"], '"x""y"': ['x"y'], "": [""], ".a": ["", "a"], "a..b": ["a", "", "b"], 'a"b.c': ['a"b', "c"], '"a"b': None, '"a': None, '"a""': None, '""."x"': ["", "x"], "a.": ["a", ""], '"a\n.b".c': ["a\n.b", "c"]}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.s for r in df.select("p", text.split_path(F.col("p")).alias("s")).collect()} == paths
    times = {"2026-07-26T16:34:11Z": ("2026-07-26 16:34:11+00", 1785083651000000), "2026-07-26 18:34:11+02": ("2026-07-26 18:34:11+02", 1785083651000000), "2026-07-26 16:34:11": (None, None), "2026-13-01 00:00:00 utc": (None, None), "2026-13-01 00:00:00 UTC": ("2026-13-01 00:00:00+00", None)}
    df = spark.createDataFrame([(t,) for t in times], "t string")
    assert {r.t: (r.a, r.b) for r in df.select("t", text.target_time(F.col("t")).alias("a"), text.target_micros(F.col("t")).alias("b")).collect()} == times


def test_runs_over_the_edges_of_stretches(spark):
    e = wal.STRETCH
    numbers = [0, 1, 5, *range(e - 3, e), e, e + 1, *range(2 * e - 2, 3 * e + 2), 4 * e - 1, 4 * e + 1]
    df = spark.createDataFrame([(k, n) for k in (1, 2) for n in numbers], "tli int, segno long")
    got = rows(wal.islands(df, ["tli"], "segno").filter("tli = 2"), "first", "last", "n")
    assert got == [(0, 1, 2), (5, 5, 1), (e - 3, e + 1, 5), (2 * e - 2, 3 * e + 1, e + 4), (4 * e - 1, 4 * e - 1, 1), (4 * e + 1, 4 * e + 1, 1)]
    cut = rows(wal.windows(df, 4).filter(f"tli = 1 AND first < {e + 2}"), "first", "last", "n")
    assert cut == [(0, 1, 2), (5, 5, 1), (e - 3, e, 4), (e + 1, e + 1, 1)]
    assert wal.windows(df.limit(0)).count() == 0


@pytest.mark.parametrize("ends", [[10], [10, 25], [16, 25], [20, 9], [0]])
def test_holes_of_a_path_over_timelines(spark, ends):
    """Against a plain loop over numbers; segments of 4 bytes, so that forks fall inside segments and at their starts."""
    size, held = 4, {(t, n) for t in range(1, 5) for n in range(12) if (t * 7 + n * n) % 3}
    history = [(len(ends) + 1, t + 1, e) for t, e in enumerate(ends)]
    for floor in (0, 3):
        got = wal.cross_timeline_gaps(spark.createDataFrame(sorted(held), "tli int, segno long"), spark.createDataFrame(history, "tli int, ancestor int, end_lsn long"), floor, size)
        first, spans = 0, []
        for t, e in enumerate(ends):
            spans.append((t + 1, first, e // size - (e % size == 0)))
            first = e // size
        latest = len(ends) + 1
        lo = max(floor, min(n for t, n in held if t <= latest))
        hi = max(n for t, n in held if t == latest)
        spans.append((latest, first, hi))
        missing = {}
        for n in range(lo, hi + 1):
            on = [t for t, a, b in spans if a <= n <= b]
            if on and not any((t, n) in held for t in on):
                missing[n] = min(on)
        found = {n: r.tli for r in got.collect() for n in range(r.missing_from, r.missing_to + 1)}
        assert found == missing


def test_first_holes_of_a_chain(spark):
    s = spark.createDataFrame([(1, n) for n in (3, 4, 7)] + [(2, 5)], "tli int, segno long")
    chain = spark.createDataFrame([(1,)], "tli int")
    assert rows(wal.chain_holes(chain, s, 2, 9)) == [(1, n) for n in (2, 5, 6, 8, 9)]
    assert rows(wal.chain_holes(chain, s, 2, 9, most=3)) == [(1, 2), (1, 5), (1, 6)]
    assert rows(wal.chain_holes(chain, s.limit(0), 2, 9)) == []


def test_rows_made_of_a_small_table_are_dealt_out(spark):
    sf, parts = "/root/testdata/sf0.001", int(spark.conf.get("spark.sql.shuffle.partitions"))
    for made in (plans._rules(spark, sf), plans._per_customer(spark, sf, plans.HELD[:1], "id long, cluster_id long, type string, status string, attempts int, dry_run boolean, stage_db string, new_name string")):
        assert made.rdd.getNumPartitions() == parts
    for query in (plans.o4_all_rules, plans.x1_decisions, plans.j11_first_match, plans.j12_shadowing):
        text = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        # Only the roles of x1, a fixed table, may be broadcast.
        assert "SortMergeJoin" in text and text.count("BroadcastHashJoin") <= (query is plans.x1_decisions), query.__name__


def test_networks_of_every_form(spark):
    told = {"10.1.2.3/8": ("40a000000", "40affffff", 8), "1.2.3.4": ("401020304", "401020304", 32), "300.1.1.1": None, "1.2.3.4/33": None, "0.0.0.0/0": ("400000000", "4ffffffff", 0), "db.example": None, "": ("4", "7", 0)}
    got = spark.createDataFrame([(x,) for x in told], "a string").select("a", access.network(F.col("a")).alias("n")).collect()
    assert {r.a: r.n and tuple(r.n) for r in got} == told


def test_levels_and_closures_collect_nothing(spark):
    edges = spark.createDataFrame([(3, 2), (2, 1), (3, 1), (5, 6), (6, 5), (7, 9)], "src long, dst long")
    nodes = spark.createDataFrame([(n,) for n in (1, 2, 3, 5, 6, 7)], "node long")
    found = graphs.levels(edges, nodes)
    assert rows(found) == [(1, 0), (2, 1), (3, 2), (5, 0), (6, 0), (7, 0)]
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    roots = spark.createDataFrame([(3,), (5,)], "root long")
    assert rows(graphs.closure(edges, roots)) == [(3, 1, 1), (3, 2, 1), (3, 3, 0), (5, 5, 0), (5, 6, 1)]
    assert rows(graphs.closure(edges, roots, 0)) == [(3, 3, 0), (5, 5, 0)]


def test_storages_with_the_same_remote_share_their_list(spark):
    hosts = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"])], "host_id long, aliases array<string>")
    storages = spark.createDataFrame([(1, "b"), (2, "b"), (3, "x"), (4, "a"), (4, "b"), (5, None)], "storage_id long, remote_host string")
    found = fleet.storage_hosts(storages, hosts)
    assert rows(found) == [(1, "1,2"), (2, "1,2"), (3, ""), (4, "1,2"), (5, "")]


def test_many_sets_that_want_the_same_share_their_holes(spark):
    sets = spark.range(5000).selectExpr("id", "1 AS tli", "10L AS first", "14L AS last")
    held = spark.createDataFrame([(1, n) for n in (10, 11, 13)], "tli int, segno long")
    found = chains.missing_segments(sets, held)
    assert found.groupBy("segno").count().orderBy("segno").collect() == [(12, 5000), (14, 5000)]


def test_a_range_without_a_hole_has_a_row(spark):
    whole = spark.createDataFrame([(1, n) for n in range(5, 10)], "tli int, segno long")
    assert rows(wal.first_hole(whole, 5, 9)) == [(None,)]
    assert rows(wal.first_hole(whole.filter("segno <> 7"), 5, 9)) == [(7,)]
    assert rows(wal.first_hole(whole.limit(0), 5, 9)) == [(None,)]


def test_a_faulty_pattern_makes_only_its_own_rule_unknown(spark):
    schema = "server int, rule_no int, type string, database string, user string, address string, method string"
    rules = spark.createDataFrame([(1, 1, "host", "/[a", "all", "all", "trust"), (1, 2, "host", "/^app[0-9]$", "all", "all", "scram"), (2, 1, "host", "all", "/web(", "all", "md5"), (3, 1, "host", "app1", "web,/(", "all", "cert")], schema)
    probes = spark.createDataFrame([(1, 1, "app1", "web", "10.0.0.1", False), (1, 2, "other", "web", "10.0.0.1", False), (2, 3, "x", "web", "10.0.0.1", False), (3, 4, "app1", "web", "10.0.0.1", False), (3, 5, "no", "web", "10.0.0.1", False)], "server int, probe int, database string, user string, ip string, ssl boolean")
    got = rows(access.decisions(probes, rules, spark.createDataFrame([], "role string, user string")), "probe", "method", "uncertain")
    assert got == [(1, "scram", True), (2, "refused", True), (3, "refused", True), (4, "cert", False), (5, "refused", False)]


def test_refusals_by_text_and_code(spark):
    cases = [("Refused: wrong target", True), ("refusedly", False), ("the connection was refused by the host", False), ("table is locked", False), ("this would lock out the console", True), ("Lock-Out of all", True), ("PGA-SEC-030 no", True), ("PGA-GEN-034 x", True), ("PGA-GEN-035 x", False), ("PGA-GEN-0341", False), ("x PGA-SEC-030", False), (None, False)]
    frame = spark.createDataFrame([(k, e) for k, (e, _) in enumerate(cases)], "id long, error string")
    got = rows(frame.select("id", operations.is_refusal(F.lit("backup_run"), F.col("error")).alias("r")))
    assert got == [(k, want) for k, (_, want) in enumerate(cases)]
    assert rows(frame.select(operations.is_refusal(F.lit("restore_plan"), F.col("error")).alias("r")).distinct()) == [(True,)]


def test_planner_in_its_order(spark):
    """One cluster a rule, from the first to the last, and what passes it over."""
    hour, now = 3_600_000_000, 1_000_000 * 3_600_000_000 // 1
    policy = lambda c, **more: {"cluster_id": c, "enabled": True, "full_hours": 168, "incr_hours": 6, "verify_hours": 24, "drill_days": 7, "retry_minutes": 30, "window_from": 0, "window_to": 0} | more
    state = lambda c, **more: {"cluster_id": c, "reachable": True, "sets": 3, "set_at": now - hour, "full_at": now - 5 * hour, "new_tablespaces": "", "standby_away": False} | more
    op = lambda c, i, kind, status, age=hour, **more: {"id": i, "type": kind, "cluster_id": c, "status": status, "run_type": "incr", "created_at": now - age, "updated_at": now - age, "key": f"sched:{c}:x:{i}"} | more
    policies, states, ops, want = [], [], [], {}

    def case(c, work, key=None, p=(), s=(), work_done=()):
        policies.append(policy(c, **dict(p)))
        states.append(state(c, **dict(s)))
        ops.extend(work_done)
        want[c] = (work, key)

    bucket = lambda hours: now // (hours * hour)
    case(1, "busy", work_done=[op(1, 1, "restore_drill", "running")])
    case(2, "busy", s={"reachable": False})
    case(3, "wait", work_done=[op(3, 3, "backup_run", "failed", hour // 3)])
    case(4, "wait", work_done=[op(4, 40 + k, "backup_run", "failed", hour + k) for k in range(3)])  # 30 minutes, doubled twice
    case(5, "full", "sched:5:tsfull:16400:0", s={"new_tablespaces": "16400"})
    case(6, "verify", f"sched:6:verify:{bucket(24)}", s={"new_tablespaces": "16400"}, work_done=[op(6, 60 + k, "backup_run", "failed", 99 * hour, key=f"sched:6:tsfull:16400:{k}") for k in range(3)])  # three tries, long ago
    case(7, "full", f"sched:7:full:{bucket(168)}:0", s={"full_at": now - 200 * hour})
    case(8, "incr", f"sched:8:incr:{bucket(6)}:0", p={"window_from": 9, "window_to": 10}, s={"full_at": now - 200 * hour, "set_at": now - 7 * hour})  # the full waits for its hours, the increment does not
    case(9, "full", f"sched:9:full:{bucket(168)}:0", p={"window_from": 9, "window_to": 10}, s={"full_at": None, "set_at": None, "sets": 0})  # no full at all: at once
    case(10, "verify", f"sched:10:verify:{bucket(24)}", s={"set_at": now - 7 * hour, "standby_away": True})
    case(11, "incr", f"sched:11:incr:{bucket(6)}:0", s={"set_at": now - 19 * hour, "standby_away": True})
    case(12, "expire", "sched:12:expire:120", work_done=[op(12, 120, "backup_run", "succeeded")])
    case(13, "drill", f"sched:13:drill:{bucket(168)}", work_done=[op(13, 130, "backup_run", "succeeded"), op(13, 131, "backup_expire", "succeeded", key="sched:13:expire:130"), op(13, 132, "backup_verify", "failed", key=f"sched:13:verify:{bucket(24)}")])
    case(14, "none", p={"verify_hours": 0, "drill_days": 7}, work_done=[op(14, 140, "restore_drill", "succeeded", 100 * hour)])
    case(15, "verify", f"sched:15:verify:{bucket(24)}", s={"full_at": now - 200 * hour}, work_done=[op(15, 150, "pg_restart", "running")])  # a restart forbids the full, not the check
    case(16, "incr", f"sched:16:incr:{bucket(6)}:0", s={"set_at": now + 48 * hour, "full_at": now - 5 * hour})  # a clock that is ahead holds nothing back
    frame = lambda data, schema: spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in schema.split(", ")) for r in data], schema)
    plan = operations.plan_work(
        frame(policies, "cluster_id long, enabled boolean, full_hours long, incr_hours long, verify_hours long, drill_days long, retry_minutes long, window_from int, window_to int"),
        frame(states, "cluster_id long, reachable boolean, sets long, set_at long, full_at long, new_tablespaces string, standby_away boolean"),
        frame(ops, "id long, type string, cluster_id long, status string, run_type string, created_at long, updated_at long, key string"), now, 3,
    )
    assert {r.cluster_id: (r.work, r.key) for r in plan.collect()} == want


def test_findings_of_versions_come_once_for_a_cluster_and_label(spark):
    now = 1_000_000_000_000
    texts = [(1, 1, "16.15 (built here)"), (1, 2, "17beta1"), (1, 3, "v9.6.24"), (1, 4, "9"), (1, 5, "11.2"), (1, 6, "11.9"), (1, 7, "19devel"), (1, 8, "unknown 16"), (1, 9, None), (1, 10, ""), (2, 11, " 12")]
    nodes = spark.createDataFrame([(c, n, now, v) for c, n, v in texts] + [(1, 12, now - 60_000_000, "10"), (1, 13, None, "10")], "cluster_id long, node_id long, last_seen long, version string")
    got = fleet.version_findings(nodes, now, F.lit("2024-11-15").cast("date"))
    assert rows(got) == sorted([(1, "critical", "pg_unsupported", "9.0"), (1, "critical", "pg_unsupported", "9.6"), (1, "info", "pg_newer", "19"), (1, "warning", "pg_eol", "11"), (1, "warning", "pg_legacy", "11"), (2, "warning", "pg_eol", "12")])
    assert rows(fleet.version_findings(nodes, now, F.lit("2024-11-14").cast("date")).filter("cluster_id = 2")) == []
