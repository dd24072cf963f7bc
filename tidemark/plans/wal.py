"""Archive continuity and forensics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lsn
from ..operators import wal
from . import testbed as T

FLOOR = T.FIRST + 20
NOW_S = 1_706_659_200


def w1_wal_gaps(spark: SparkSession, d: str) -> DataFrame:
    return wal.gaps(T.segments(spark, d), FLOOR)


def w2_cross_timeline_gaps(spark: SparkSession, d: str) -> DataFrame:
    return wal.cross_timeline_gaps(T.segments(spark, d).filter("segno % 5 <> 0"), T.history(spark), FLOOR)


def w3_branch_tails(spark: SparkSession, d: str) -> DataFrame:
    return wal.branch_tails(T.segments(spark, d), T.history(spark))


def w4_interval_cover(spark: SparkSession, d: str) -> DataFrame:
    ev = T.table(spark, d, "events").select(F.col("user_id").alias("k"), F.floor(T.micros("ts") / T.DAY).cast("long").alias("start"), (F.floor(T.micros("ts") / T.DAY) + 1 + F.col("event_id") % 3).cast("long").alias("end"))
    wanted = ev.groupBy("k").agg(F.min("start").alias("lo"), (F.min("start") + 15).alias("hi"))
    return wal.covers(ev, wanted, "k")


def w5_segment_windows(spark: SparkSession, d: str) -> DataFrame:
    return wal.windows(T.segments(spark, d), 4)


def w18_recovery_path(spark: SparkSession, d: str) -> DataFrame:
    """Every supplier's number is a timeline that forked off half of it; its history names all it came from."""
    k, i = F.col("s_suppkey"), F.col("i")
    rows = T.table(spark, d, "supplier").filter("s_suppkey > 0").select(k, F.explode(F.sequence(F.lit(1), F.floor(F.log2(k)).cast("int") + 1)).alias("i"))
    at = lambda n: F.floor(k / F.pow(F.lit(2.0), n)).cast("long")
    return wal.recovery_path(rows.select(k.cast("int").alias("tli"), at(i).cast("int").alias("ancestor"), (at(i - 1) * T.SEGMENT + 5).alias("end_lsn")), 0)


def w19_first_hole(spark: SparkSession, d: str) -> DataFrame:
    return wal.first_hole(T.segments(spark, d).filter("tli = 1"), T.FIRST + 50, T.FIRST + 600)


def x10_chain_holes(spark: SparkSession, d: str) -> DataFrame:
    s = T.segments(spark, d)
    return wal.chain_holes(s.filter("tli = 2").select("tli").distinct(), s, T.FIRST, T.FIRST + 700)


def x5_rescue(spark: SparkSession, d: str) -> DataFrame:
    s = T.segments(spark, d).distinct()
    return wal.rescue(s, s.filter("segno % 7 <> 0"), 1, T.FIRST + 300, FLOOR)


#: Columns of the rescue fixture, as expressions that both engines read; k is a supplier, who stands for a server, r a segment near its own.
_SERVER = {"server": "k", "in_recovery": "k % 3 > 0", "tli": "CAST(k % 4 + 1 AS INTEGER)", "segno": "k * 10 + 80", "floor": "k * 10 + k % 30"}
_LOCAL = {"server": "k", "tli": "CAST(r % 5 AS INTEGER)", "segno": "k * 10 + r", "whole": "r % 11 <> 0", "since": f"{NOW_S} - r * 7 % 200"}
_STAGED = {"server": "k", "tli": "CAST(r % 4 AS INTEGER)", "segno": "k * 10 + r * 2", "whole": "r % 9 <> 0"}


def x5_rescue_plan(spark: SparkSession, d: str) -> DataFrame:
    s = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    near = lambda n: s.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    made = lambda rows, columns: rows.selectExpr(*[f"{v} AS {c}" for c, v in columns.items()])
    archive = T.table(spark, d, "orders").select((F.col("o_orderkey") % 5).cast("int").alias("tli"), F.col("o_custkey").alias("segno"))
    return wal.rescue_plan(made(s, _SERVER), made(near(100), _LOCAL), made(near(70).filter("k % 2 = 0"), _STAGED), archive, NOW_S)


def x6_ready_prefix(spark: SparkSession, d: str) -> DataFrame:
    return wal.ready_prefix(T.segments(spark, d).distinct().withColumn("waiting", (F.col("segno") % 97 == 3) & (F.col("tli") < 2)))


def sc1_archive_listing(spark: SparkSession, d: str) -> DataFrame:
    s = T.segments(spark, d)
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("", ".zst", ".partial", ".gz", ".meta")]), (F.col("segno") % 5 + 1).cast("int"))
    return wal.segments_of_names(s.select(F.concat(lsn.segment_name(F.col("tli"), F.col("segno")), suffix).alias("name")))


def sc5_history_lines(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.when(k % 7 == 0, F.concat(k.cast("string"), F.lit(".history"))).otherwise(F.concat(F.lpad(F.hex(k), 8, "0"), F.lit(".history")))
    line = F.when(k % 5 == 0, "# comment").when(k % 5 == 1, F.concat(k.cast("string"), F.lit("\t0/"), F.hex(k + 4096), F.lit("\tno recovery target specified"))).when(k % 5 == 2, F.concat(F.lit("  "), (k % 90).cast("string"), F.lit(" "), F.hex(k % 300), F.lit("/5000 before"))).when(k % 5 == 3, "junk").otherwise(F.concat((k % 9).cast("string"), F.lit(" A/"), F.lower(F.hex(k))))
    rows = T.table(spark, d, "orders").select(name.alias("name"), line.alias("line"))
    found = wal.history_of_lines(rows)
    return found.select("tli", "ancestor", lsn.lsn_number(F.col("end_lsn")).cast("long").alias("end_lsn"))


def sc4_parse_lines(spark: SparkSession, d: str) -> DataFrame:
    li = T.table(spark, d, "lineitem")
    at = F.concat(F.lit("rmgr: "), F.element_at(F.array(F.lit("Transaction"), F.lit("Storage"), F.lit("Heap")), (F.col("l_partkey") % 3 + 1).cast("int")), F.lit(" len: 1, tx: "), F.col("l_suppkey").cast("string"), F.lit(", lsn: 0/"), F.hex("l_orderkey"), F.lit(", desc: "))
    body = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("COMMIT 2024-01-02 03:04:05.678 UTC; rels: base/5/"), F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" base/5/"), F.col("l_suppkey").cast("string"))).otherwise("")))
    line = F.concat(at, F.coalesce(body, F.concat(F.lit("CREATE base/5/"), F.col("l_partkey").cast("string"))))
    parsed = wal.parse_lines(li.select(line.alias("line")))
    return parsed.groupBy("kind", "xid").agg(F.count("*").alias("n"), F.sum("nrels").alias("files"), F.min("lsn").alias("first_lsn"), F.max(F.col("rels")[0]["rel"]).alias("last_rel"), F.max("time").alias("commit_time"))


def w6_fold_truncates(spark: SparkSession, d: str) -> DataFrame:
    li = T.table(spark, d, "lineitem")
    ev = li.groupBy((F.col("l_orderkey") * 2 + F.when(F.col("l_returnflag") == "N", 1).otherwise(0)).alias("k"), F.col("l_orderkey").cast("string").alias("xid"), F.when(F.col("l_returnflag") == "N", "CREATE").otherwise("DROP").alias("kind")).agg(F.count("*").alias("nrels"))
    return wal.fold_truncates(ev.select("xid", "kind", "nrels"))


def g1_change_counts(spark: SparkSession, d: str) -> DataFrame:
    return wal.change_counts(T.changes(spark, d))


def _roots(spark: SparkSession) -> DataFrame:
    return T.inline(spark, [(1, k, k // 4) for k in range(16) if k // 4 != k], "db int, rel long, root long")


def g4_root_rollup(spark: SparkSession, d: str) -> DataFrame:
    return wal.roll_up(wal.change_counts(T.changes(spark, d)), _roots(spark))


def g5_mass_changes(spark: SparkSession, d: str) -> DataFrame:
    outcomes = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("xid"), F.when(F.col("s_suppkey") % 5 == 0, "aborted").when(F.col("s_suppkey") % 5 < 4, "committed").alias("outcome")).filter("outcome IS NOT NULL")
    return wal.mass_changes(wal.change_counts(T.changes(spark, d)), outcomes, 5, 40)


def j1_event_names(spark: SparkSession, d: str) -> DataFrame:
    catalogs = T.table(spark, d, "part").select((F.col("p_partkey") % 6).alias("set_no"), F.lit(1).alias("db"), (F.floor(F.col("p_partkey") / 6) % 14).cast("long").alias("rel"), "p_partkey").groupBy("set_no", "db", "rel").agg(F.concat(F.lit("t"), F.max("p_partkey").cast("string")).alias("name"))
    return wal.with_names(wal.change_counts(T.changes(spark, d)), wal.newest_names(catalogs)).select("xid", "rel", "name", "del", "upd")


def l1_last_ascending(spark: SparkSession, d: str) -> DataFrame:
    return wal.last_ascending(wal.change_counts(T.changes(spark, d)).select("lsn", "xid", "rel", "del"), ["lsn", "xid", "rel"], 25)


def _conflicts(spark: SparkSession, d: str) -> DataFrame:
    ev = T.table(spark, d, "events")
    return ev.select((F.col("user_id") % 3).cast("int").alias("tli"), F.floor(T.micros("ts") / T.HOUR).cast("long").alias("segno"), F.concat(F.lit("s"), (F.col("event_id") % 50).cast("string")).alias("name"), (F.col("event_id") % 4).alias("sha"), F.floor(T.micros("ts") / 1000000).cast("long").alias("at"))


def r11_conflict_kinds(spark: SparkSession, d: str) -> DataFrame:
    kinds = wal.classify_conflicts(_conflicts(spark, d), wal.spans(T.history(spark)), FLOOR)
    return kinds.groupBy("kind", "tli").agg(F.count("*").alias("n"), F.min("segno").alias("first"), F.max("segno").alias("last"))


def g18_conflict_counts(spark: SparkSession, d: str) -> DataFrame:
    return wal.conflict_counts(wal.classify_conflicts(_conflicts(spark, d), wal.spans(T.history(spark)), FLOOR))


_SPANS = f"""spans AS (SELECT * FROM (VALUES (0, 0, {T.FIRST + 200}), (1, {T.FIRST + 200}, {T.FIRST + 449}), (2, {T.FIRST + 450}, NULL)) AS t(tli, a, b))"""
_KINDS = f"""c AS (SELECT CAST(user_id % 3 AS INTEGER) AS tli, epoch_us(ts) // {T.HOUR} AS segno, 's' || CAST(event_id % 50 AS VARCHAR) AS name, event_id % 4 AS sha, epoch_us(ts) // 1000000 AS c_at FROM events),
 k AS (SELECT c.*, CASE WHEN segno < {FLOOR} THEN 'expired' WHEN NOT (segno >= a AND (b IS NULL OR segno <= b)) THEN 'off_history' ELSE 'divergent' END AS kind FROM c JOIN spans USING (tli))"""
_sql = lambda columns: ", ".join(f"{v} AS {c}" for c, v in columns.items())
SQL = {
    "w1_wal_gaps": f"WITH {T.SEGMENTS}, n AS (SELECT tli, segno, lead(segno) OVER (PARTITION BY tli ORDER BY segno) AS f FROM segments WHERE segno >= {FLOOR}) SELECT tli, segno + 1 AS missing_from, f - 1 AS missing_to, f - segno - 1 AS missing FROM n WHERE f > segno + 1",
    "w2_cross_timeline_gaps": f"""WITH {T.SEGMENTS}, {_SPANS}, h AS (SELECT * FROM segments WHERE segno % 5 <> 0), lim AS (SELECT greatest(min(segno), {FLOOR}) AS lo, max(segno) FILTER (tli = 2) AS hi FROM h),
 n AS (SELECT unnest(range(lo, hi + 1)) AS segno FROM lim), o AS (SELECT n.segno, min(s.tli) AS tli, count(h.segno) AS there FROM n JOIN spans s ON n.segno >= s.a AND (s.b IS NULL OR n.segno <= s.b) LEFT JOIN h ON h.tli = s.tli AND h.segno = n.segno GROUP BY 1),
 m AS (SELECT tli, segno, segno - row_number() OVER (PARTITION BY tli ORDER BY segno) AS g FROM o WHERE there = 0) SELECT tli, min(segno) AS missing_from, max(segno) AS missing_to, count(*) AS missing FROM m GROUP BY tli, g""",
    "w3_branch_tails": f"""WITH {T.SEGMENTS}, {T.HISTORY}, e AS (SELECT ancestor AS tli, max(end_lsn) AS fork, arg_min(tli, (-end_lsn, tli)) AS successor FROM history GROUP BY 1)
 SELECT s.tli, successor, fork, count(*) AS n, min(segno) AS first, max(segno) AS last FROM segments s JOIN e USING (tli) WHERE segno * {T.SEGMENT} > fork GROUP BY ALL""",
    "w4_interval_cover": f"""WITH i AS (SELECT user_id AS k, epoch_us(ts) // {T.DAY} AS start, epoch_us(ts) // {T.DAY} + 1 + event_id % 3 AS stop FROM events), w AS (SELECT k, min(start) AS lo, min(start) + 15 AS hi FROM i GROUP BY 1),
 n AS (SELECT k, lo, hi, start, stop, coalesce(max(stop) OVER (PARTITION BY k ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo) AS reach FROM i JOIN w USING (k) WHERE stop > lo AND start < hi),
 a AS (SELECT k, min(reach) FILTER (start > reach) AS hole, max(stop) AS far, any_value(hi) AS hi FROM n GROUP BY 1), r AS (SELECT k, coalesce(hole, CASE WHEN far < hi THEN far END) AS first_hole FROM a) SELECT k, first_hole IS NULL AS covered, first_hole FROM r""",
    "w5_segment_windows": f"""WITH {T.SEGMENTS}, r AS (SELECT tli, segno, segno - row_number() OVER (PARTITION BY tli ORDER BY segno) AS run FROM segments), p AS (SELECT *, (row_number() OVER (PARTITION BY tli, run ORDER BY segno) - 1) // 4 AS piece FROM r)
 SELECT tli, min(segno) AS first, max(segno) AS last, count(*) AS n FROM p GROUP BY tli, run, piece""",
    "w18_recovery_path": f"WITH RECURSIVE p AS (SELECT max(s_suppkey) AS top, max(s_suppkey) AS k FROM supplier WHERE s_suppkey > 0 UNION ALL SELECT top, k // 2 FROM p WHERE k > 1) SELECT CAST(top AS INTEGER) AS top, CAST(k // 2 AS INTEGER) AS ancestor, k * {T.SEGMENT} + 5 AS end_lsn FROM p",
    "w19_first_hole": f"WITH {T.SEGMENTS}, n AS (SELECT unnest(range({T.FIRST + 50}, (SELECT max(segno) + 1 FROM segments WHERE tli = 1 AND segno <= {T.FIRST + 600}))) AS s) SELECT min(s) AS first_hole FROM n WHERE s > {T.FIRST + 50} AND s NOT IN (SELECT segno FROM segments WHERE tli = 1)",
    "x10_chain_holes": f"WITH {T.SEGMENTS}, n AS (SELECT unnest(range({T.FIRST}, {T.FIRST + 701})) AS segno) SELECT 2 AS tli, segno FROM n WHERE segno NOT IN (SELECT segno FROM segments WHERE tli = 2) ORDER BY segno LIMIT 1000",
    "x5_rescue": f"WITH {T.SEGMENTS} SELECT tli, segno FROM segments WHERE (tli < 1 OR tli = 1 AND segno < {T.FIRST + 300}) AND segno >= {FLOOR} AND segno % 7 = 0",
    "x5_rescue_plan": f"""WITH s AS (SELECT s_suppkey AS k FROM supplier), sv AS (SELECT {_sql(_SERVER)} FROM s), l AS (SELECT {_sql(_LOCAL)} FROM s, range(100) t(r)), st AS (SELECT {_sql(_STAGED)} FROM s, range(70) t(r) WHERE k % 2 = 0), ar AS (SELECT DISTINCT CAST(o_orderkey % 5 AS INTEGER) AS tli, o_custkey AS segno FROM orders),
 c AS (SELECT st.*, in_recovery, sv.tli AS now_tli, segno_ IS NOT NULL OR st.segno < floor AS gone FROM st JOIN sv ON sv.server = st.server LEFT JOIN (SELECT tli, segno, segno AS segno_ FROM ar) a ON a.tli = st.tli AND a.segno = st.segno),
 w AS (SELECT l.*, in_recovery, sv.tli AS now_tli, EXISTS (SELECT 1 FROM st WHERE st.server = l.server AND st.tli = l.tli AND st.segno = l.segno) AS kept FROM l JOIN sv ON sv.server = l.server WHERE (l.tli < sv.tli OR l.tli = sv.tli AND l.segno < sv.segno) AND l.segno >= floor AND whole AND NOT EXISTS (SELECT 1 FROM ar WHERE ar.tli = l.tli AND ar.segno = l.segno)),
 stage AS (SELECT server, tli, segno FROM w WHERE in_recovery AND NOT kept AND {NOW_S} - since >= 90), held AS (SELECT server, tli, segno FROM c WHERE NOT gone AND in_recovery UNION ALL SELECT * FROM stage)
 SELECT *, 'stage' AS action FROM stage UNION ALL SELECT server, tli, segno, 'forget' FROM c WHERE gone UNION ALL SELECT server, tli, segno, 'forget' FROM (SELECT *, row_number() OVER (PARTITION BY server ORDER BY tli DESC, segno DESC) AS back FROM held) WHERE back > 48
 UNION ALL SELECT server, tli, segno, 'publish' FROM w WHERE NOT in_recovery AND tli < now_tli AND NOT kept UNION ALL SELECT server, tli, segno, 'publish' FROM c WHERE NOT gone AND NOT in_recovery AND tli < now_tli AND whole""",
    "x6_ready_prefix": f"WITH {T.SEGMENTS}, q AS (SELECT *, segno % 97 = 3 AND tli < 2 AS waiting FROM segments) SELECT tli, segno, waiting FROM q WHERE segno < coalesce((SELECT min(segno) FROM q p WHERE p.tli = q.tli AND p.waiting), 9223372036854775807)",
    "sc1_archive_listing": f"WITH {T.SEGMENTS} SELECT tli, segno FROM segments WHERE segno % 5 IN (0, 1, 3)",
    "sc5_history_lines": """SELECT CAST(o_orderkey AS INTEGER) AS tli, CAST(CASE o_orderkey % 5 WHEN 1 THEN o_orderkey WHEN 2 THEN o_orderkey % 90 ELSE o_orderkey % 9 END AS INTEGER) AS ancestor,
 CASE o_orderkey % 5 WHEN 1 THEN o_orderkey + 4096 WHEN 2 THEN o_orderkey % 300 * 4294967296 + 20480 ELSE 42949672960 + o_orderkey END AS end_lsn FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 IN (1, 2, 4)""",
    "sc4_parse_lines": """WITH p AS (SELECT CASE WHEN l_partkey % 3 = 0 THEN 'DROP' ELSE 'CREATE' END AS kind, CAST(l_suppkey AS VARCHAR) AS xid, CASE WHEN l_partkey % 3 = 0 AND l_linenumber % 2 = 0 THEN 2 ELSE 1 END AS nrels, '0/' || upper(to_hex(l_orderkey)) AS lsn, CAST(l_partkey AS VARCHAR) AS rel,
 CASE WHEN l_partkey % 3 = 0 THEN '2024-01-02 03:04:05.678 UTC' END AS t FROM lineitem WHERE l_partkey % 3 < 2) SELECT kind, xid, count(*) AS n, CAST(sum(nrels) AS BIGINT) AS files, min(lsn) AS first_lsn, max(rel) AS last_rel, max(t) AS commit_time FROM p GROUP BY kind, xid""",
    "w6_fold_truncates": """WITH e AS (SELECT CAST(l_orderkey AS VARCHAR) AS xid, count(*) FILTER (l_returnflag = 'N' AND l_orderkey <> 0) AS made, count(*) FILTER (l_returnflag <> 'N') AS gone FROM lineitem GROUP BY 1)
 SELECT xid, 'TRUNCATE' AS kind, made AS nrels FROM e WHERE made > 0 AND gone > 0 UNION ALL SELECT xid, 'DROP', gone - made FROM e WHERE gone > made""",
    "g1_change_counts": f"WITH {T.CHANGES} SELECT * FROM counts",
    "g4_root_rollup": f"""WITH {T.CHANGES} SELECT tli, xid, db, CAST(CASE WHEN rel // 4 <> rel THEN rel // 4 ELSE rel END AS BIGINT) AS rel, min(lsn) AS lsn, CAST(sum(del) AS BIGINT) AS del, CAST(sum(upd) AS BIGINT) AS upd, min(first_seg) AS first_seg, max(last_seg) AS last_seg,
 coalesce(string_agg(CAST(rel AS VARCHAR), ',' ORDER BY rel) FILTER (rel // 4 <> rel), '') AS leaves FROM counts GROUP BY 1, 2, 3, 4""",
    "g5_mass_changes": f"""WITH {T.CHANGES}, l AS (SELECT * FROM counts WHERE del + upd >= 5 ORDER BY lsn DESC, xid, rel LIMIT 80)
 SELECT l.*, CASE WHEN upd = 0 THEN 'DELETE' WHEN del = 0 THEN 'UPDATE' ELSE 'DELETE+UPDATE' END AS kind, xid % 5 BETWEEN 1 AND 3 AS committed FROM l WHERE xid % 5 <> 0 ORDER BY lsn DESC, xid, rel LIMIT 40""",
    "j1_event_names": f"""WITH {T.CHANGES}, c AS (SELECT p_partkey % 6 AS set_no, p_partkey // 6 % 14 AS rel, 't' || CAST(max(p_partkey) AS VARCHAR) AS name FROM part GROUP BY 1, 2), n AS (SELECT rel, arg_max(name, set_no) AS name FROM c WHERE set_no IN (SELECT DISTINCT set_no FROM c ORDER BY 1 DESC LIMIT 4) GROUP BY 1)
 SELECT xid, rel, coalesce(name, '1/' || CAST(rel AS VARCHAR)) AS name, del, upd FROM counts LEFT JOIN n USING (rel)""",
    "l1_last_ascending": f"WITH {T.CHANGES} SELECT lsn, xid, rel, del FROM counts ORDER BY lsn DESC, xid DESC, rel DESC LIMIT 25",
    "r11_conflict_kinds": f"WITH {_SPANS}, {_KINDS} SELECT kind, tli, count(*) AS n, min(segno) AS first, max(segno) AS last FROM k GROUP BY 1, 2",
    "g18_conflict_counts": f"WITH {_SPANS}, {_KINDS} SELECT count(DISTINCT (name, sha)) FILTER (kind = 'divergent') AS conflicts, max(c_at) FILTER (kind = 'divergent') AS conflicts_newest, count(DISTINCT (name, sha)) FILTER (kind = 'off_history') AS off_history, count(DISTINCT (name, sha)) FILTER (kind = 'expired') AS expired FROM k",
}
QUERIES = {name: globals()[name] for name in SQL}
