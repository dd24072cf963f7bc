"""Backup chains, retention and garbage collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import chains
from . import testbed as T

#: Day 11323 is 2001-01-01.
NOW = 11_323 * 86400
KEEP, DAYS = 2, 700
KINDS = ["time", "lsn", "xid", "xid", "name", "latest"]


def _parents(spark: SparkSession, d: str) -> DataFrame:
    along = Window.partitionBy("stanza").orderBy("day", "id")
    sets = T.backup_sets(spark, d)
    full = F.last(F.when(F.col("type") == "full", F.col("id")), ignorenulls=True).over(along)
    previous = F.lag("id").over(along)
    return sets.withColumn("parent", F.when(F.col("type") == "full", None).when(F.col("type") == "diff", F.coalesce(full, -F.col("id") - 1)).otherwise(F.coalesce(previous, -F.col("id") - 1)))


_PARENTS = f"""{T.SETS}, p AS (SELECT *, CASE type WHEN 'full' THEN NULL WHEN 'diff' THEN coalesce(last_value(CASE WHEN type = 'full' THEN id END IGNORE NULLS) OVER w, -id - 1) ELSE coalesce(lag(id) OVER w, -id - 1) END AS parent FROM sets WINDOW w AS (PARTITION BY stanza ORDER BY day, id))"""


def r1_parent_chains(spark: SparkSession, d: str) -> DataFrame:
    return chains.parent_chains(_parents(spark, d))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    li = T.table(spark, d, "lineitem")
    one = li.groupBy(F.col("l_orderkey").alias("set_id"), (F.col("l_partkey") % 8).alias("rel"), F.col("l_linenumber").cast("long").alias("offset")).agg(F.max(F.struct("l_partkey", "l_suppkey", "l_quantity")).alias("x"))
    return one.select("set_id", "rel", "offset", (F.col("x.l_partkey") * 1000 + F.col("x.l_suppkey")).alias("hash"), F.col("x.l_quantity").cast("long").alias("len"), (F.col("rel") == 0).alias("whole"))


_CHUNKS = "chunks AS (SELECT set_id, rel, \"offset\", x.a * 1000 + x.b AS hash, CAST(x.c AS BIGINT) AS len, rel = 0 AS whole FROM (SELECT l_orderkey AS set_id, l_partkey % 8 AS rel, CAST(l_linenumber AS BIGINT) AS \"offset\", max({'a': l_partkey, 'b': l_suppkey, 'c': l_quantity}) AS x FROM lineitem GROUP BY ALL))"
_MEMBERS = f"""{T.SETS}, g AS (SELECT *, sum(CASE WHEN type = 'full' THEN 1 ELSE 0 END) OVER (PARTITION BY stanza ORDER BY day, id) AS b FROM sets WHERE status = 'COMPLETE'), g2 AS (SELECT *, max(b) OVER (PARTITION BY stanza) AS m FROM g),
 members AS (SELECT *, row_number() OVER (PARTITION BY stanza ORDER BY day, id) AS chain_pos, count(*) OVER (PARTITION BY stanza) AS chain_size FROM g2 WHERE b = m AND b > 0)"""


def r2_chain_overlay(spark: SparkSession, d: str) -> DataFrame:
    return chains.overlay(_chunks(spark, d), chains.chain_members(T.backup_sets(spark, d), ["day", "id"])).withColumnRenamed("offset", "at_offset")


def j3_choose_set(spark: SparkSession, d: str) -> DataFrame:
    targets = T.table(spark, d, "customer").select(F.col("c_custkey").alias("stanza"), ((10_000 + F.col("c_custkey") % 1000) * 1000 + 7).alias("target"))
    return chains.choose_sets(targets, T.backup_sets(spark, d), width=100_000)


def j3_targets(spark: SparkSession, d: str) -> DataFrame:
    """Targets of every kind: instants, positions, transactions with and without a position, named points, the latest."""
    k = F.col("c_custkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in KINDS]), (k % 6 + 1).cast("int"))
    value = F.when(k % 6 == 0, (10_000 + k % 1000) * 86400 + 7).when(k % 6 < 3, (10_000 + k % 1000) * 1000 + 7)
    targets = T.table(spark, d, "customer").select(k.alias("target"), k.alias("stanza"), kind.alias("kind"), value.alias("value"))
    return chains.choose_by_target(targets, T.backup_sets(spark, d), day=100 * 86400, width=100_000)


def _needs(spark: SparkSession, d: str) -> DataFrame:
    first = F.col("id") % 700 + T.FIRST
    return T.backup_sets(spark, d).select("stanza", "id", (F.col("id") % 3).cast("int").alias("tli"), first.alias("first"), (first + F.col("id") % 4).alias("last"))


def j4_missing_segments(spark: SparkSession, d: str) -> DataFrame:
    return chains.missing_segments(_needs(spark, d), T.segments(spark, d))


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    return _needs(spark, d).filter("tli < 2").groupBy("stanza").agg(F.collect_set("tli").alias("tlis"), F.min("first").alias("lo"), F.max("last").alias("hi"))


def j4_uncovered(spark: SparkSession, d: str) -> DataFrame:
    return chains.uncovered(_ranges(spark, d), T.segments(spark, d))


def j4_uncovered_all(spark: SparkSession, d: str) -> DataFrame:
    """The name under which J4 over the whole range was kept apart while ``j4_uncovered`` stopped early."""
    return j4_uncovered(spark, d)


def j4_uncovered_runs(spark: SparkSession, d: str) -> DataFrame:
    return chains.uncovered_runs(_ranges(spark, d), T.segments(spark, d)).select("stanza", F.col("first").alias("from_seg"), F.col("last").alias("to_seg"))


def _based(spark: SparkSession, d: str) -> DataFrame:
    along = Window.partitionBy("stanza").orderBy("started", "id")
    return T.backup_sets(spark, d).withColumn("base", F.last(F.when(F.col("type") == "full", F.col("id")), ignorenulls=True).over(along))


def _pins(spark: SparkSession, d: str) -> DataFrame:
    return T.backup_sets(spark, d).filter("id % 19 = 0").select("id")


def w11_retention(spark: SparkSession, d: str) -> DataFrame:
    return chains.retention(_based(spark, d), NOW, KEEP, DAYS, _pins(spark, d))


def w11_log_floor(spark: SparkSession, d: str) -> DataFrame:
    sets = _based(spark, d)
    return chains.log_floor(sets, chains.retention(sets, NOW, KEEP, DAYS, _pins(spark, d)))


_RETENTION = f"""{T.SETS}, b AS (SELECT *, last_value(CASE WHEN type = 'full' THEN id END IGNORE NULLS) OVER (PARTITION BY stanza ORDER BY started, id) AS base FROM sets),
 f AS (SELECT * FROM b WHERE status = 'COMPLETE' AND type = 'full'), c AS (SELECT *, (NOT promoted OR NOT bool_or(NOT promoted) OVER (PARTITION BY stanza)) AS counts FROM f),
 n AS (SELECT *, row_number() OVER (PARTITION BY stanza ORDER BY started DESC, id DESC) AS pos FROM c), th AS (SELECT stanza, nth.pos AS pos FROM (SELECT stanza, pos, row_number() OVER (PARTITION BY stanza ORDER BY pos) AS k FROM n WHERE counts) nth WHERE k = {KEEP}),
 sp AS (SELECT stanza, arg_max(id, (started, id)) AS id FROM f WHERE ended < {NOW - DAYS * 86400} GROUP BY 1),
 doomed AS (SELECT n.stanza, n.id FROM n JOIN th USING (stanza) LEFT JOIN sp ON sp.stanza = n.stanza WHERE n.pos > th.pos AND n.started < {NOW - DAYS * 86400} AND n.id IS DISTINCT FROM sp.id),
 v AS (SELECT b.stanza, b.id, b.status, b.started, CASE WHEN d.id IS NOT NULL THEN 'expire' WHEN b.status IN ('FAILED', 'PENDING_WAL') THEN CASE WHEN b.status = 'PENDING_WAL' AND {NOW} - b.started < 604800 THEN 'wait' ELSE 'junk' END
 WHEN b.status = 'COMPLETE' AND b.type <> 'full' AND f.id IS NULL THEN 'orphan' ELSE 'keep' END AS raw FROM b LEFT JOIN doomed d ON d.stanza = b.stanza AND d.id = b.base LEFT JOIN f ON f.stanza = b.stanza AND f.id = b.base),
 verdicts AS (SELECT stanza, id, status, started, CASE WHEN raw IN ('expire', 'junk', 'orphan') AND id % 19 = 0 THEN 'pinned' ELSE raw END AS verdict FROM v)"""


def j13_sibling_floors(spark: SparkSession, d: str) -> DataFrame:
    floors = T.backup_sets(spark, d).groupBy("stanza").agg(F.min("started").alias("floor")).withColumn("system", F.col("stanza") % 40)
    return chains.sibling_floors(floors)


def _kept(spark: SparkSession, d: str) -> DataFrame:
    return T.backup_sets(spark, d).filter("id % 3 = 0 AND status = 'COMPLETE'")


def g14_live_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chains.live_chunks(_chunks(spark, d), _kept(spark, d))


def _packs(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).groupBy("hash").agg(F.max("len").alias("len")).select((F.floor(F.col("hash") / 1000) % 200).cast("long").alias("pack"), "hash", "len", (F.lit(NOW) - F.floor(F.col("hash") / 1000) % 200 * 3600).cast("long").alias("mtime"))


_PACKS = f"packs AS (SELECT hash // 1000 % 200 AS pack, hash, max(len) AS len, {NOW} - hash // 1000 % 200 * 3600 AS mtime FROM chunks GROUP BY hash)"


def g15_pack_garbage(spark: SparkSession, d: str) -> DataFrame:
    return chains.pack_garbage(_packs(spark, d), chains.live_chunks(_chunks(spark, d), _kept(spark, d)), NOW)


def g16_verify_report(spark: SparkSession, d: str) -> DataFrame:
    index = _packs(spark, d).filter("hash % 50 <> 0").select("hash", (F.col("hash") % 37 != 0).alias("good"))
    return chains.verify_report(T.backup_sets(spark, d), _chunks(spark, d), index)


def d10_file_plan(spark: SparkSession, d: str) -> DataFrame:
    p = T.table(spark, d, "part")
    files = p.select(F.col("p_partkey").alias("rel"), F.col("p_size").cast("long").alias("size"))
    parent = p.filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("rel"), (F.col("p_size") + F.when(F.col("p_partkey") % 7 == 0, 1).otherwise(0)).cast("long").alias("size"))
    changed = T.table(spark, d, "lineitem").filter("l_partkey % 3 = 0").select(F.col("l_partkey").alias("rel"), F.col("l_linenumber").alias("chunk"))
    return chains.file_plan(files, parent, changed)


def d11_blocks_to_chunks(spark: SparkSession, d: str) -> DataFrame:
    li = T.table(spark, d, "lineitem")
    return chains.blocks_to_chunks(li.select((F.col("l_partkey") % 50).alias("relfilenode"), (F.col("l_orderkey") * 37 % 400000).alias("block"), ((F.col("l_suppkey") == 3) & (F.col("l_partkey") % 2 == 0)).alias("is_limit")))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    li = T.table(spark, d, "lineitem")
    return li.select((F.col("l_partkey") % 30).alias("rel"), F.floor(F.col("l_orderkey") / 16).cast("long").alias("chunk"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("block"), (F.col("l_suppkey") * 1000 + F.col("l_partkey")).alias("page_lsn"), (F.col("l_quantity") == 50).alias("zero"), (F.col("l_tax") == 0.08).alias("torn"), (F.col("l_partkey") % 30 == 7).alias("new_file"))


def d12_pages_to_keep(spark: SparkSession, d: str) -> DataFrame:
    return chains.pages_to_keep(_pages(spark, d), F.lit(95_000))


def j17_contradictions(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d).select("rel", "block", "page_lsn")
    return chains.contradictions(pages, pages.filter("block % 3 <> 0").select("rel", "block").distinct(), F.lit(20_000), F.lit(30_000))


def x9_budgeted_sample(spark: SparkSession, d: str) -> DataFrame:
    return chains.budgeted_sample(T.table(spark, d, "orders").select(F.col("o_orderkey").alias("rel"), T.cents("o_totalprice").alias("size")), least_budget=1 << 20)


def x12_backup_type(spark: SparkSession, d: str) -> DataFrame:
    o = T.table(spark, d, "orders")
    k = F.col("o_orderkey")
    return chains.backup_type(o.select(k.alias("id"), F.when(k % 4 == 0, "full").when(k % 4 == 1, "diff").otherwise("incr").alias("requested"), (k % 9 != 0).alias("has_full"), (k % 2 == 0).alias("checksums"), F.when(k % 5 == 0, k % 10 == 0).alias("base_checksums"), (k % 3).alias("segment"), F.when(k % 7 == 0, F.lit(1)).alias("base_segment"), (k % 6).alias("timeline"), (k % 5).alias("base_timeline"), (k % 8 == 3).cast("int").alias("wal_missing"), (k % 12 == 7).alias("new_tablespace")))


def x16_repository_stats(spark: SparkSession, d: str) -> DataFrame:
    return chains.repository_stats(T.backup_sets(spark, d), NOW)


def x16_dedup_ratios(spark: SparkSession, d: str) -> DataFrame:
    return chains.dedup_ratios(T.backup_sets(spark, d), _chunks(spark, d))


def x13_live_pins(spark: SparkSession, d: str) -> DataFrame:
    return chains.live_pins(T.backup_sets(spark, d).select("id", F.col("ended").alias("until")), 10_500 * 86400)


def g13_database_sets(spark: SparkSession, d: str) -> DataFrame:
    return chains.database_sets(T.backup_sets(spark, d).select((F.col("id") % 300).alias("db"), F.col("stanza").alias("set_no"), "bytes").groupBy("db", "set_no").agg(F.max("bytes").alias("size")))


_UNCOVERED = f"""{T.SETS}, {T.SEGMENTS}, n AS (SELECT stanza, CAST(id % 3 AS INTEGER) AS tli, id % 700 + {T.FIRST} AS a, id % 700 + {T.FIRST} + id % 4 AS b FROM sets WHERE id % 3 < 2), c AS (SELECT stanza, list(DISTINCT tli) AS tlis, min(a) AS lo, max(b) AS hi FROM n GROUP BY 1),
 e AS (SELECT stanza, tlis, unnest(range(lo, hi + 1)) AS segno FROM c), u AS (SELECT stanza, segno FROM e WHERE NOT EXISTS (SELECT 1 FROM segments s WHERE s.segno = e.segno AND list_contains(e.tlis, s.tli)))"""
SQL = {
    "r1_parent_chains": f"""WITH RECURSIVE {_PARENTS}, c AS (SELECT id, id AS at_id, parent, type, 1 AS length, CAST(NULL AS VARCHAR) AS problem FROM p UNION ALL
 SELECT c.id, q.id, q.parent, q.type, c.length + 1, CASE WHEN q.status <> 'COMPLETE' THEN 'incomplete' END FROM c JOIN p q ON q.id = c.parent WHERE c.problem IS NULL),
 e AS (SELECT c.id, c.at_id, c.length, CASE WHEN problem IS NOT NULL THEN problem WHEN c.parent IS NOT NULL THEN 'missing' WHEN c.type <> 'full' THEN 'not_full' END AS problem FROM c WHERE problem IS NOT NULL OR parent IS NULL OR parent NOT IN (SELECT id FROM p))
 SELECT id, CASE WHEN problem IS NULL THEN at_id END AS base, CASE WHEN problem IS NULL THEN CAST(length AS BIGINT) END AS length, problem FROM e""",
    "r2_chain_overlay": f"""WITH {_MEMBERS}, {_CHUNKS}, pl AS (SELECT k.*, m.stanza, chain_pos, chain_size FROM chunks k JOIN members m ON m.id = k.set_id), fl AS (SELECT DISTINCT stanza, rel FROM pl WHERE chain_pos = chain_size)
 SELECT stanza, rel, "offset" AS at_offset, arg_max(set_id, chain_pos) AS set_id, arg_max(hash, chain_pos) AS hash, arg_max(len, chain_pos) AS len, count(*) AS versions FROM pl SEMI JOIN fl USING (stanza, rel) WHERE NOT whole OR chain_pos = chain_size GROUP BY ALL""",
    "j3_choose_set": f"""WITH {T.SETS}, t AS (SELECT c_custkey AS stanza, (10000 + c_custkey % 1000) * 1000 + 7 AS target FROM customer)
 SELECT t.stanza, target, arg_max(id, (stop_pos, id)) AS set_id FROM t LEFT JOIN sets s ON s.stanza = t.stanza AND status = 'COMPLETE' AND stop_pos + CASE WHEN type = 'full' THEN 0 ELSE 2 END <= target GROUP BY ALL""",
    "j3_targets": f"""WITH {T.SETS}, t AS (SELECT c_custkey AS k, {KINDS}[CAST(c_custkey % 6 + 1 AS INTEGER)] AS kind, CASE WHEN c_custkey % 6 = 0 THEN (10000 + c_custkey % 1000) * 86400 + 7 WHEN c_custkey % 6 < 3 THEN (10000 + c_custkey % 1000) * 1000 + 7 END AS value FROM customer),
 g AS (SELECT * FROM sets WHERE status = 'COMPLETE'), n AS (SELECT stanza, arg_max(id, (stop_pos, id)) AS newest, arg_max(id, (stop_pos, id)) FILTER (type = 'full') AS newest_full FROM g GROUP BY 1),
 f AS (SELECT k, arg_max(g.id, (g.stop_pos, g.id)) AS id FROM t JOIN g ON g.stanza = k AND value IS NOT NULL AND CASE WHEN kind = 'time' THEN ended + CASE WHEN type = 'full' THEN 0 ELSE 2 END ELSE stop_pos END <= value GROUP BY 1),
 c AS (SELECT k, kind, newest, CASE WHEN f.id IS NOT NULL THEN f.id WHEN kind IN ('xid', 'name') THEN newest_full WHEN kind = 'latest' THEN newest END AS set_id FROM t LEFT JOIN n ON n.stanza = k LEFT JOIN f USING (k))
 SELECT k AS target, k AS stanza, set_id, CASE WHEN newest IS NULL THEN 'no backup' WHEN set_id IS NOT NULL THEN NULL WHEN kind IN ('xid', 'name') THEN 'no full backup' ELSE 'earlier than every backup' END AS problem FROM c""",
    "j4_missing_segments": f"WITH {T.SETS}, {T.SEGMENTS}, n AS (SELECT id, CAST(id % 3 AS INTEGER) AS tli, unnest(range(id % 700 + {T.FIRST}, id % 700 + {T.FIRST} + id % 4 + 1)) AS segno FROM sets) SELECT * FROM n ANTI JOIN segments USING (tli, segno)",
    "j4_uncovered": f"WITH {_UNCOVERED} SELECT * FROM u",
    "j4_uncovered_all": f"WITH {_UNCOVERED} SELECT * FROM u",
    "j4_uncovered_runs": f"WITH {_UNCOVERED} SELECT stanza, min(segno) AS from_seg, max(segno) AS to_seg FROM (SELECT *, segno - row_number() OVER (PARTITION BY stanza ORDER BY segno) AS run FROM u) GROUP BY stanza, run",
    "w11_retention": f"WITH {_RETENTION} SELECT stanza, id, verdict FROM verdicts",
    "w11_log_floor": f"WITH {_RETENTION} SELECT stanza, min(started) AS floor FROM verdicts WHERE verdict IN ('keep', 'pinned') AND status = 'COMPLETE' GROUP BY 1",
    "j13_sibling_floors": f"WITH {T.SETS}, f AS (SELECT stanza, min(started) AS floor, stanza % 40 AS system FROM sets GROUP BY 1) SELECT system, stanza, (SELECT min(floor) FROM f g WHERE g.system = f.system AND g.stanza <> f.stanza) AS sibling_floor FROM f",
    "g14_live_chunks": f"WITH {T.SETS}, {_CHUNKS} SELECT DISTINCT hash FROM chunks WHERE set_id IN (SELECT id FROM sets WHERE id % 3 = 0 AND status = 'COMPLETE')",
    "g15_pack_garbage": f"""WITH {T.SETS}, {_CHUNKS}, {_PACKS}, live AS (SELECT DISTINCT hash FROM chunks WHERE set_id IN (SELECT id FROM sets WHERE id % 3 = 0 AND status = 'COMPLETE')),
 e AS (SELECT pack, count(*) AS chunks, count(*) FILTER (l.hash IS NULL) AS dead_chunks, CAST(sum(len) AS BIGINT) AS bytes, CAST(sum(CASE WHEN l.hash IS NULL THEN len ELSE 0 END) AS BIGINT) AS dead_bytes, max(mtime) AS mtime FROM packs p LEFT JOIN live l ON l.hash = p.hash GROUP BY 1)
 SELECT pack, chunks, dead_chunks, bytes, dead_bytes, CASE WHEN {NOW} - mtime < 172800 THEN 'keep' WHEN dead_chunks = chunks THEN 'delete' WHEN dead_bytes >= 0.25 * bytes THEN 'repack' ELSE 'keep' END AS action FROM e""",
    "g16_verify_report": f"""WITH {T.SETS}, {_CHUNKS}, r AS (SELECT set_id AS id, count(DISTINCT rel) AS files, count(*) FILTER (hash % 50 = 0) AS missing, count(*) FILTER (hash % 50 <> 0 AND hash % 37 = 0) AS corrupt FROM chunks GROUP BY 1)
 SELECT s.id, coalesce(files, 0) AS files, coalesce(missing, 0) AS missing, coalesce(corrupt, 0) AS corrupt, coalesce(missing, 0) + coalesce(corrupt, 0) = 0 AS ok FROM sets s LEFT JOIN r ON r.id = s.id""",
    "d10_file_plan": """WITH c AS (SELECT l_partkey AS rel, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS chunks FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY 1),
 x AS (SELECT p_partkey AS rel, chunks, CASE WHEN p_partkey % 5 = 0 THEN 'full' WHEN chunks IS NOT NULL THEN 'partial' WHEN p_partkey % 7 <> 0 THEN 'skip' ELSE 'full' END AS plan FROM part LEFT JOIN c ON c.rel = p_partkey) SELECT rel, plan, CASE WHEN plan = 'partial' THEN chunks END AS chunks FROM x""",
    "d11_blocks_to_chunks": """WITH b AS (SELECT l_partkey % 50 AS relfilenode, l_orderkey * 37 % 400000 AS block, l_suppkey = 3 AND l_partkey % 2 = 0 AS lim FROM lineitem), e AS (SELECT relfilenode, block // 131072 AS part, list_sort(list(DISTINCT block % 131072 // 128)) AS l, bool_or(lim) AS lim FROM b GROUP BY 1, 2)
 SELECT relfilenode, part, array_to_string(l, ',') AS chunks, bool_or(lim) OVER (PARTITION BY relfilenode) AS whole FROM e""",
    "d12_pages_to_keep": """WITH p AS (SELECT l_partkey % 30 AS rel, l_orderkey // 16 AS chunk, l_quantity = 50 OR l_tax = 0.08 OR l_partkey % 30 = 7 OR l_suppkey * 1000 + l_partkey >= 95000 AS k FROM lineitem) SELECT rel, chunk, count(*) AS pages, count(*) FILTER (k) AS fresh, bool_or(k) AS keep FROM p GROUP BY 1, 2""",
    "j17_contradictions": "SELECT l_partkey % 30 AS rel, l_orderkey * 8 + l_linenumber AS block, l_suppkey * 1000 + l_partkey AS page_lsn FROM lineitem WHERE l_suppkey * 1000 + l_partkey >= 20000 AND l_suppkey * 1000 + l_partkey < 30000 AND (l_orderkey * 8 + l_linenumber) % 3 = 0",
    "x12_backup_type": """WITH x AS (SELECT o_orderkey AS k, CASE k % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'diff' ELSE 'incr' END AS requested, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 9 = 0 THEN 'no full' WHEN k % 5 = 0 AND (k % 2 = 0) <> (k % 10 = 0) THEN 'checksums changed' WHEN k % 7 = 0 AND k % 3 <> 1 THEN 'segment size changed'
 WHEN k % 6 < k % 5 THEN 'timeline' WHEN k % 8 = 3 THEN 'log missing' WHEN k % 12 = 7 THEN 'tablespace' END AS reason FROM orders) SELECT k AS id, CASE WHEN reason IS NULL THEN requested ELSE 'full' END AS type, CASE WHEN reason IS NOT NULL THEN requested END AS promoted_from, reason FROM x""",
    "x16_repository_stats": f"""WITH {T.SETS} SELECT stanza, count(*) AS sets, count(*) FILTER (status = 'COMPLETE') AS complete, count(*) FILTER (status = 'COMPLETE' AND type = 'full') AS fulls, count(*) FILTER (status = 'FAILED') AS failed, CAST(sum(bytes) FILTER (status = 'COMPLETE') AS BIGINT) AS bytes,
 arg_max(id, (started, id)) FILTER (status = 'COMPLETE' AND type = 'full') AS last_full, min(started) FILTER (status = 'COMPLETE') AS oldest, max(started) FILTER (status = 'FAILED') AS last_failure, ({NOW} - max(started) FILTER (status = 'COMPLETE')) // 3600 AS age_hours FROM sets GROUP BY 1""",
    "x16_dedup_ratios": f"""WITH {T.SETS}, {_CHUNKS}, g AS (SELECT * FROM sets WHERE status = 'COMPLETE'), l AS (SELECT stanza, CAST(sum(bytes) AS BIGINT) AS logical FROM g GROUP BY 1), h AS (SELECT stanza, hash, max(len) AS len FROM chunks JOIN g ON g.id = set_id GROUP BY 1, 2), s AS (SELECT stanza, CAST(sum(len) AS BIGINT) AS stored, count(*) AS chunks FROM h GROUP BY 1)
 SELECT stanza, logical, coalesce(stored, 0) AS stored, coalesce(chunks, 0) AS chunks, CASE WHEN stored > 0 THEN floor(logical * 100 / stored + 0.5) / 100 END AS ratio FROM l LEFT JOIN s USING (stanza)""",
    "x13_live_pins": f"WITH {T.SETS} SELECT id, ended AS until FROM sets WHERE ended > {10_500 * 86400}",
    "g13_database_sets": f"WITH {T.SETS}, c AS (SELECT id % 300 AS db, stanza AS set_no, max(bytes) AS size FROM sets GROUP BY 1, 2) SELECT db, arg_max(size, set_no) AS size, count(*) AS sets, min(set_no) AS first, max(set_no) AS last, max(set_no) = (SELECT max(set_no) FROM c) AS in_latest FROM c GROUP BY db",
}
SQL["x9_budgeted_sample"] = """WITH f AS (SELECT o_orderkey AS rel, CAST(round(o_totalprice * 100) AS BIGINT) AS size FROM orders),
 t AS (SELECT greatest(3, least(50, count(*) // 100)) AS k, greatest(1048576, CAST(floor(CAST(sum(size) AS DOUBLE) * CAST(0.01 AS DOUBLE)) AS BIGINT)) AS budget FROM f),
 d AS (SELECT *, row_number() OVER (ORDER BY md5('1:' || CAST(rel AS VARCHAR)), rel) AS no FROM f),
 c AS (SELECT rel, size, budget, row_number() OVER (ORDER BY size, rel) AS place, sum(size) OVER (ORDER BY size, rel ROWS UNBOUNDED PRECEDING) AS upto FROM d, t WHERE no <= k)
 SELECT rel, size FROM c WHERE place = 1 OR upto <= budget"""
QUERIES = {name: globals()[name] for name in SQL}
