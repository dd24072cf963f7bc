"""Row differences, merge plans and mirrors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff
from . import testbed as T


def d2_row_keys(spark: SparkSession, d: str) -> DataFrame:
    part = T.table(spark, d, "part").select(F.col("p_partkey").alias("table"))
    kind = F.col("table") % 4
    sure = F.col("table") % 8 < 4
    no, yes = F.lit(False), F.lit(True)
    attribute = lambda k, name, not_null, generated, identity, dropped: F.struct(F.lit(k).alias("attnum"), F.lit(name).alias("name"), not_null.alias("not_null"), generated.alias("generated"), identity.alias("identity"), dropped.alias("dropped"))
    index = lambda name, primary, partial, *keys: F.struct(F.lit(name).alias("index"), primary.alias("is_primary"), yes.alias("is_unique"), yes.alias("valid"), partial.alias("partial"), F.array(*[F.lit(k) for k in keys]).alias("keys"))
    found = F.array(attribute(1, "id", yes, no, F.when(F.col("table") % 3 == 0, "a"), no), attribute(2, "code", sure, no, F.lit(None).cast("string"), no), attribute(3, "total", no, yes, F.lit(None).cast("string"), F.col("table") % 5 == 0))
    wide, by_code, by_id = index("by_all", no, no, 1, 2), index("by_code", no, no, 2), index("by_id", no, no, 1)
    held = F.when(kind == 0, F.array(index("pk", yes, no, 2, 1), by_id)).when((kind == 1) & sure, F.array(wide, by_code)).when(kind == 1, F.array(wide, by_code, by_id)).when(kind == 2, F.array(index("some", no, yes, 1))).otherwise(F.array(index("lower", no, no, 0)))
    keys = diff.row_keys(part.select("table", F.inline(found)), part.select("table", F.inline(held)))
    return keys.select("table", F.array_join("columns", ",").alias("columns"), F.array_join("generated", ",").alias("generated"), "identity_always", F.array_join("key", ",").alias("key"), "key_from")


def _restored(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "orders").filter("o_orderkey % 17 <> 0").select("o_orderkey", "o_custkey", T.cents("o_totalprice").alias("price"), "o_orderstatus")


def _live(spark: SparkSession, d: str) -> DataFrame:
    o = T.table(spark, d, "orders").filter("o_orderkey % 13 <> 0")
    changed = F.col("o_orderkey") % 5 == 0
    return o.select("o_orderkey", "o_custkey", (T.cents("o_totalprice") + F.when(changed, 100).otherwise(0)).alias("price"), F.when(F.col("o_orderkey") % 15 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.lit("x").alias("extra"))


def _diff(spark: SparkSession, d: str) -> DataFrame:
    return diff.row_diff(_restored(spark, d), _live(spark, d), ["o_orderkey"])


def d1_row_diff(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d)


def d1_class_counts(spark: SparkSession, d: str) -> DataFrame:
    return diff.class_counts(_diff(spark, d))


def l5_class_samples(spark: SparkSession, d: str) -> DataFrame:
    return diff.class_samples(_diff(spark, d), ["o_orderkey"], 7)


def d3_apply_plan(spark: SparkSession, d: str) -> DataFrame:
    return diff.apply_plan(_diff(spark, d), ["missing_now", "changed"], None, ["o_orderkey"])


def d3_apply_keys(spark: SparkSession, d: str) -> DataFrame:
    asked = T.table(spark, d, "orders").filter("o_orderkey % 10 = 0").select((F.col("o_orderkey") * 2).alias("o_orderkey"))
    return diff.apply_plan(_diff(spark, d), [], asked, ["o_orderkey"])


def d4_merged(spark: SparkSession, d: str) -> DataFrame:
    plan = diff.apply_plan(_diff(spark, d), diff.CLASSES, None, ["o_orderkey"])
    return diff.merged(_live(spark, d), _restored(spark, d), plan, ["o_orderkey"])


def d5_delete_effects(spark: SparkSession, d: str) -> DataFrame:
    tables = {t: T.table(spark, d, t) for t in ("nation", "customer", "orders", "lineitem", "supplier")}
    keys = [("customer", "c_nationkey", "nation", "n_nationkey", "cascade"), ("supplier", "s_nationkey", "nation", "n_nationkey", "block"), ("orders", "o_custkey", "customer", "c_custkey", "cascade"), ("lineitem", "l_orderkey", "orders", "o_orderkey", "set_null")]
    return diff.delete_effects(tables, keys, "nation", tables["nation"].filter("n_nationkey IN (3, 7)"))


def _offers(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], list]:
    """Offers of a part by a supplier, lines that order one, and notes on returned lines: keys of two columns."""
    li = T.table(spark, d, "lineitem")
    tables = {"part": T.table(spark, d, "part"), "line": li, "offer": li.select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")).distinct(), "note": li.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"))}
    return tables, [("offer", "part", "part", "p_partkey", "cascade"), ("line", ["l_suppkey", "l_partkey"], "offer", ["supplier", "part"], "cascade"), ("note", ["order", "line"], "line", ["l_orderkey", "l_linenumber"], "set_default")]


def d5_composite_keys(spark: SparkSession, d: str) -> DataFrame:
    tables, keys = _offers(spark, d)
    return diff.delete_effects(tables, keys, "part", tables["part"].filter("p_size < 5"))


def j6_update_effects(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of some offers are exchanged; lines by both columns refer to them, parts do not change."""
    tables, keys = _offers(spark, d)
    before = tables["offer"].withColumn("id", F.concat_ws("/", "part", "supplier"))
    after = before.withColumn("supplier", F.when(F.col("part") % 5 == 0, F.col("supplier") + 1).otherwise(F.col("supplier")))
    return diff.update_effects(tables, [*keys, ("note", "line", "offer", "part", "block")], "offer", before, after, "id")


def j5_orphans(spark: SparkSession, d: str) -> DataFrame:
    return diff.orphans(T.table(spark, d, "orders"), T.table(spark, d, "customer").filter("c_custkey % 7 <> 0"), [("o_custkey", "c_custkey")]).select("o_orderkey", "o_custkey")


def _store(spark: SparkSession, d: str, wrong: int, without: int) -> DataFrame:
    k = F.col("p_partkey")
    prefix = F.element_at(F.array(F.lit("chunks/"), F.lit("wal/"), F.lit("backup/"), F.lit("id/")), (k % 4 + 1).cast("int"))
    return T.table(spark, d, "part").filter(k % without != 0).select(F.concat(prefix, k.cast("string")).alias("key"), (F.col("p_size") + F.when(k % wrong == 0, 1).otherwise(0)).alias("size"), (k % 4 < 2).alias("immutable"))


_KEY = "['chunks/', 'wal/', 'backup/', 'id/'][CAST(p_partkey % 4 + 1 AS INTEGER)] || CAST(p_partkey AS VARCHAR)"


def d7_mirror_plan(spark: SparkSession, d: str) -> DataFrame:
    return diff.mirror_plan(_store(spark, d, 9, 11), _store(spark, d, 1 << 30, 6).drop("immutable"))


def d8_migration_plan(spark: SparkSession, d: str) -> DataFrame:
    p = T.table(spark, d, "part").select(F.col("p_partkey").alias("name"), F.col("p_size").alias("sha"))
    return diff.migration_plan(p.filter("name % 3 <> 0"), p.filter("name % 4 <> 0").withColumn("sha", F.col("sha") + F.when(F.col("name") % 10 == 1, 1).otherwise(0)), p.filter("name % 25 = 0"))


def d9_rehydrate_plan(spark: SparkSession, d: str) -> DataFrame:
    return diff.rehydrate_plan(_store(spark, d, 9, 11), _store(spark, d, 1 << 30, 3), _store(spark, d, 1, 1 << 30).filter("key LIKE '%5'"))


def d13_merge_duplicates(spark: SparkSession, d: str) -> DataFrame:
    c = T.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 97).alias("cluster_key"), F.col("c_mktsegment").alias("environment"), T.cents("c_acctbal").alias("created"))
    return diff.merge_duplicates(c, T.table(spark, d, "orders").select(F.col("o_custkey").alias("cluster_id")))


def d13_repointed(spark: SparkSession, d: str) -> DataFrame:
    rows = T.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("cluster_id"))
    return diff.repointed(rows, d13_merge_duplicates(spark, d))


def d6_promotion_plan(spark: SparkSession, d: str) -> DataFrame:
    p = T.table(spark, d, "part").select(F.col("p_partkey").alias("name"), (F.col("p_size") % 5 == 0).alias("unlogged"))
    return diff.promotion_plan(p, p.filter("name % 3 = 0"), "replace")


_DIFF = """r AS (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS price, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 17 <> 0),
 l AS (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderkey % 5 = 0 THEN 100 ELSE 0 END AS price, o_custkey, CASE WHEN o_orderkey % 15 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 13 <> 0),
 j AS (SELECT coalesce(r.k, l.k) AS o_orderkey, r.k AS rk, l.k AS lk, array_to_string(list_filter([CASE WHEN r.o_custkey IS DISTINCT FROM l.o_custkey THEN 'o_custkey' END, CASE WHEN r.o_orderstatus IS DISTINCT FROM l.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN r.price IS DISTINCT FROM l.price THEN 'price' END], lambda x: x IS NOT NULL), ',') AS cols FROM r FULL JOIN l ON r.k = l.k),
 diff AS (SELECT o_orderkey, CASE WHEN lk IS NULL THEN 'missing_now' WHEN rk IS NULL THEN 'added_since' WHEN cols <> '' THEN 'changed' ELSE 'same' END AS class, CASE WHEN lk IS NOT NULL AND rk IS NOT NULL AND cols <> '' THEN cols END AS columns FROM j)"""
_ACTION = "CASE class WHEN 'missing_now' THEN 'insert' WHEN 'changed' THEN 'update' WHEN 'added_since' THEN 'delete' WHEN 'same' THEN 'none' ELSE 'unknown' END"
_DUPLICATES = """c AS (SELECT c_custkey AS id, c_custkey % 97 AS k, c_mktsegment AS e, CAST(round(c_acctbal * 100) AS BIGINT) AS created, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS ops FROM customer),
 m AS (SELECT id, first_value(id) OVER (PARTITION BY k, e ORDER BY ops DESC, created, id) AS keeper FROM c)"""
SQL = {
    "d1_row_diff": f"WITH {_DIFF} SELECT * FROM diff",
    "d1_class_counts": f"WITH {_DIFF} SELECT class, count(*) AS n FROM diff GROUP BY 1",
    "l5_class_samples": f"WITH {_DIFF} SELECT * FROM diff WHERE class <> 'same' QUALIFY row_number() OVER (PARTITION BY class ORDER BY o_orderkey) <= 7",
    "d3_apply_plan": f"WITH {_DIFF} SELECT o_orderkey, {_ACTION} AS action FROM diff WHERE class IN ('missing_now', 'changed')",
    "d3_apply_keys": f"WITH {_DIFF}, a AS (SELECT DISTINCT o_orderkey * 2 AS o_orderkey FROM orders WHERE o_orderkey % 10 = 0) SELECT o_orderkey, {_ACTION} AS action FROM a LEFT JOIN diff USING (o_orderkey)",
    "d4_merged": f"""WITH {_DIFF} SELECT r.k AS o_orderkey, r.o_custkey, r.price, r.o_orderstatus, CASE WHEN l.k IS NOT NULL THEN 'x' END AS extra FROM r LEFT JOIN l USING (k)""",
    "d5_delete_effects": """WITH c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 7)), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT * FROM c)),
 x AS (SELECT 1 AS level, 'customer' AS child, 'cascade' AS action, (SELECT count(*) FROM c) AS n UNION ALL SELECT 1, 'supplier', 'block', (SELECT count(*) FROM supplier WHERE s_nationkey IN (3, 7)) UNION ALL SELECT 2, 'orders', 'cascade', (SELECT count(*) FROM o)
 UNION ALL SELECT 3, 'lineitem', 'set_null', (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT * FROM o))) SELECT * FROM x WHERE n > 0""",
    "d5_composite_keys": """WITH p AS (SELECT p_partkey FROM part WHERE p_size < 5), o AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT * FROM p)), l AS (SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem SEMI JOIN o USING (l_partkey, l_suppkey)),
 x AS (SELECT 1 AS level, 'offer' AS child, 'cascade' AS action, (SELECT count(*) FROM o) AS n UNION ALL SELECT 2, 'line', 'cascade', (SELECT count(*) FROM l) UNION ALL SELECT 3, 'note', 'set_default', (SELECT count(*) FROM lineitem r SEMI JOIN l USING (l_orderkey, l_linenumber) WHERE r.l_returnflag = 'R')) SELECT * FROM x WHERE n > 0""",
    "j6_update_effects": "SELECT 'line' AS child, 'cascade' AS action, count(*) AS n FROM lineitem WHERE l_partkey % 5 = 0",
    "j5_orphans": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)",
    "d7_mirror_plan": f"""WITH x AS (SELECT {_KEY} AS key, p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN 'delete' WHEN p_partkey % 6 = 0 THEN 'upload' WHEN p_partkey % 9 <> 0 THEN 'same' WHEN p_partkey % 4 < 2 THEN 'conflict' ELSE 'upload' END AS plan FROM part WHERE p_partkey % 11 <> 0 OR p_partkey % 6 <> 0)
 SELECT key, plan, CASE plan WHEN 'upload' THEN CAST(k % 4 AS INTEGER) WHEN 'delete' THEN CAST(3 - k % 4 AS INTEGER) END AS turn FROM x""",
    "d8_migration_plan": "SELECT p_partkey AS name, CASE WHEN p_partkey % 3 = 0 THEN 'kept' WHEN p_partkey % 25 = 0 THEN 'retired' WHEN p_partkey % 4 = 0 THEN 'copy' WHEN p_partkey % 10 = 1 THEN 'conflict' ELSE 'skip' END AS plan FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 4 <> 0",
    "d9_rehydrate_plan": f"""WITH x AS (SELECT {_KEY} AS key, p_partkey AS k FROM part WHERE p_partkey % 11 <> 0), y AS (SELECT key, k, CASE WHEN k % 3 <> 0 THEN CASE WHEN k % 9 = 0 THEN 'differs' END WHEN key LIKE '%5' THEN 'retired' ELSE 'missing' END AS plan FROM x)
 SELECT key, plan, CASE k % 4 WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS turn FROM y WHERE plan IS NOT NULL""",
    "d13_merge_duplicates": f"WITH {_DUPLICATES} SELECT * FROM m WHERE id <> keeper",
    "d13_repointed": f"WITH {_DUPLICATES} SELECT o_orderkey, keeper AS cluster_id FROM orders JOIN m ON m.id = o_custkey",
    "d6_promotion_plan": "SELECT p_partkey AS name, CASE WHEN p_partkey % 3 <> 0 THEN 'create' WHEN p_size % 5 = 0 THEN 'skip' ELSE 'swap' END AS action, p_partkey % 3 = 0 AND p_size % 5 = 0 AS warning FROM part",
    "d2_row_keys": """SELECT p_partkey AS "table", CASE WHEN p_partkey % 5 = 0 THEN 'id,code' ELSE 'id,code,total' END AS columns, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'total' END AS generated, p_partkey % 3 = 0 AS identity_always,
 CASE WHEN p_partkey % 4 = 0 THEN 'code,id' WHEN p_partkey % 4 = 1 THEN CASE WHEN p_partkey % 8 < 4 THEN 'code' ELSE 'id' END END AS key, CASE WHEN p_partkey % 4 = 0 THEN 'primary key' WHEN p_partkey % 4 = 1 THEN CASE WHEN p_partkey % 8 < 4 THEN 'unique index by_code' ELSE 'unique index by_id' END END AS key_from FROM part""",
}
QUERIES = {name: globals()[name] for name in SQL}
