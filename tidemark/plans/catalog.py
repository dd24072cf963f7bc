"""Catalogs and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, graphs
from . import testbed as T


def _relations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return T.table(spark, d, "part").select(
        k.alias("oid"), F.concat(F.lit("db"), (k % 3).cast("string")).alias("db"), F.col("p_brand").alias("schema"), F.concat("p_name", F.lit("_"), k.cast("string")).alias("name"), F.element_at(F.array(F.lit("r"), F.lit("i"), F.lit("t"), F.lit("p"), F.lit("m")), (k % 5 + 1).cast("int")).alias("kind"),
        T.cents("p_retailprice").alias("size"), F.when(k % 20 == 10, k + 2).alias("toast"), F.when(k % 5 == 1, k - 1).alias("index_of"), F.when((k % 10 == 5) & (k > 10), k - k % 100).alias("parent"),
    )


_RELATIONS = """rel AS (SELECT p_partkey AS oid, 'db' || CAST(p_partkey % 3 AS VARCHAR) AS db, p_brand AS schema, p_name || '_' || CAST(p_partkey AS VARCHAR) AS name, ['r', 'i', 't', 'p', 'm'][CAST(p_partkey % 5 + 1 AS INTEGER)] AS kind, CAST(round(p_retailprice * 100) AS BIGINT) AS size,
 CASE WHEN p_partkey % 20 = 10 THEN p_partkey + 2 END AS toast, CASE WHEN p_partkey % 5 = 1 THEN p_partkey - 1 END AS index_of, CASE WHEN p_partkey % 10 = 5 AND p_partkey > 10 THEN p_partkey - p_partkey % 100 END AS parent FROM part)"""


def g11_footprints(spark: SparkSession, d: str) -> DataFrame:
    return catalog.footprints(_relations(spark, d))


def g12_rollup(spark: SparkSession, d: str) -> DataFrame:
    return catalog.roll_up(_relations(spark, d))


def f10_search(spark: SparkSession, d: str) -> DataFrame:
    return catalog.search(_relations(spark, d), "RED")


def l2_largest(spark: SparkSession, d: str) -> DataFrame:
    return catalog.largest(_relations(spark, d).select("oid", "size"), 30)


def g19_page_digest(spark: SparkSession, d: str) -> DataFrame:
    li = T.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("object"), F.col("l_orderkey").alias("page_no")).agg(F.sum("l_linenumber").alias("s"))
    return catalog.page_digest(li.select("object", "page_no", F.col("s").cast("string").alias("data")))


def g20_table_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    o = T.table(spark, d, "orders")
    return catalog.table_fingerprint(o.select(F.concat_ws("|", F.col("o_orderkey").cast("string"), T.cents("o_totalprice").cast("string"), "o_orderstatus").alias("body")), 256)


def r12_roles(spark: SparkSession, d: str) -> DataFrame:
    c = T.table(spark, d, "customer")
    return catalog.roles(c.select(F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("owner")), c.select(F.array(F.concat(F.lit("role_"), (F.col("c_custkey") % 40).cast("string")), F.lit("")).alias("acl")))


def _views(spark: SparkSession, d: str) -> DataFrame:
    """Each part depends on two smaller ones; a few pairs depend on each other."""
    k = F.col("p_partkey")
    p = T.table(spark, d, "part").filter("p_partkey > 0")
    down = p.select(k.alias("src"), F.explode(F.array(F.floor(k / 2).cast("long"), F.floor(k / 3).cast("long"))).alias("dst"))
    return down.unionByName(p.filter("p_partkey % 500 = 7").select(F.floor(k / 2).cast("long").alias("src"), k.alias("dst"))).distinct()


_VIEWS = "e AS (SELECT DISTINCT src, dst FROM (SELECT p_partkey AS src, unnest([p_partkey // 2, p_partkey // 3]) AS dst FROM part WHERE p_partkey > 0 UNION ALL SELECT p_partkey // 2, p_partkey FROM part WHERE p_partkey % 500 = 7))"


def r5_view_closure(spark: SparkSession, d: str) -> DataFrame:
    return graphs.closure(_views(spark, d), T.table(spark, d, "part").filter("p_partkey % 40 = 11").select(F.col("p_partkey").alias("root")), depth=25)


def r5_view_closure_all(spark: SparkSession, d: str) -> DataFrame:
    """R5 over all parts; ``r5_view_closure`` and its SQL start from one in 40."""
    return graphs.closure(_views(spark, d), T.table(spark, d, "part").select(F.col("p_partkey").alias("root")), depth=25)


def r6_levels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    p = T.table(spark, d, "part")
    edges = p.filter("p_partkey > 0").select(k.alias("src"), F.explode(F.array(F.floor(k / 2).cast("long"), F.floor(k / 3).cast("long"))).alias("dst")).distinct()
    return graphs.levels(edges, p.select(k.alias("node")))


def r3_partition_closure(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    p = T.table(spark, d, "part")
    return graphs.closure(p.filter("p_partkey >= 10").select(F.floor(k / 10).cast("long").alias("src"), k.alias("dst")), p.filter("p_partkey BETWEEN 1 AND 9").select(k.alias("root")), 8)


def r4_ancestor_closure(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    p = T.table(spark, d, "part")
    return graphs.tops(p.filter("p_partkey >= 10").select(k.alias("node"), F.floor(k / 10).cast("long").alias("up")))


def r7_components(spark: SparkSession, d: str) -> DataFrame:
    o = T.table(spark, d, "orders").filter("o_orderkey % 3 = 0")
    edges = o.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 1000).alias("dst")).filter("dst % 4 = 0")
    return graphs.components(edges, edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct())


def r7_components_all(spark: SparkSession, d: str) -> DataFrame:
    """R7 over all orders; ``r7_components`` and its SQL keep one in 12."""
    edges = T.table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 1000).alias("dst"))
    return graphs.components(edges, edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct())


SQL = {
    "g11_footprints": f"""WITH {_RELATIONS}, u AS (SELECT oid, size, coalesce(index_of, (SELECT min(t.oid) FROM rel t WHERE t.toast = rel.oid), parent) AS up FROM rel), u1 AS (SELECT a.oid, a.size, coalesce(b.up, a.up, a.oid) AS r FROM u a LEFT JOIN u b ON b.oid = a.up), u2 AS (SELECT a.oid, a.size, coalesce(b.up, a.r) AS r FROM u1 a LEFT JOIN u b ON b.oid = a.r),
 u3 AS (SELECT a.oid, a.size, coalesce(b.up, a.r) AS r FROM u2 a LEFT JOIN u b ON b.oid = a.r) SELECT r AS oid, any_value(rel.name) AS name, any_value(rel.size) AS own_bytes, CAST(sum(u3.size) AS BIGINT) AS bytes, count(*) AS parts FROM u3 JOIN rel ON rel.oid = r GROUP BY r""",
    "g12_rollup": f"WITH {_RELATIONS} SELECT db, schema, count(*) FILTER (kind IN ('r', 'p')) AS tables, count(*) FILTER (kind = 'm') AS matviews, count(DISTINCT schema) AS schemas, CAST(sum(size) AS BIGINT) AS bytes FROM rel GROUP BY GROUPING SETS ((db, schema), (db))",
    "f10_search": f"WITH {_RELATIONS}, h AS (SELECT *, lower(name) LIKE '%red%' OR lower(schema) LIKE '%red%' AS hit FROM rel) SELECT oid, schema, name, EXISTS (SELECT 1 FROM h p WHERE p.parent = h.oid AND p.hit) AS by_partition FROM h WHERE parent IS NULL AND (hit OR EXISTS (SELECT 1 FROM h p WHERE p.parent = h.oid AND p.hit))",
    "l2_largest": f"WITH {_RELATIONS} SELECT oid, size, (SELECT count(*) FROM rel) > 30 AS truncated FROM rel ORDER BY size DESC, oid LIMIT 30",
    "g19_page_digest": "WITH p AS (SELECT l_suppkey AS object, l_orderkey AS n, md5(CAST(sum(l_linenumber) AS VARCHAR)) AS m FROM lineitem GROUP BY 1, 2) SELECT object, md5(string_agg(m, '' ORDER BY n)) AS digest FROM p GROUP BY 1",
    "g20_table_fingerprint": """WITH r AS (SELECT md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR), o_orderstatus)) AS m FROM orders), b AS (SELECT left(m, 2) AS b, md5(string_agg(m, '' ORDER BY m)) AS m, count(*) AS n FROM r GROUP BY 1)
 SELECT md5(string_agg(b || m, '' ORDER BY b)) AS fingerprint, CAST(sum(n) AS BIGINT) AS n FROM b""",
    "r12_roles": "SELECT c_mktsegment AS role FROM customer WHERE c_custkey % 3 = 0 UNION SELECT 'role_' || CAST(c_custkey % 40 AS VARCHAR) FROM customer",
    "r5_view_closure": f"""WITH RECURSIVE {_VIEWS}, w AS (SELECT p_partkey AS root, p_partkey AS node, 0 AS depth FROM part WHERE p_partkey % 40 = 11 UNION SELECT root, dst, depth + 1 FROM w JOIN e ON e.src = w.node WHERE depth < 25) SELECT root, node, min(depth) AS depth FROM w GROUP BY 1, 2""",
    "r6_levels": "WITH RECURSIVE e AS (SELECT p_partkey AS src, unnest([p_partkey // 2, p_partkey // 3]) AS dst FROM part WHERE p_partkey > 0), w AS (SELECT p_partkey AS node, 0 AS level FROM part WHERE p_partkey = 0 UNION SELECT src, level + 1 FROM w JOIN e ON e.dst = w.node) SELECT node, max(level) AS level FROM w GROUP BY 1",
    "r3_partition_closure": "WITH RECURSIVE w AS (SELECT p_partkey AS root, p_partkey AS node, 0 AS depth FROM part WHERE p_partkey BETWEEN 1 AND 9 UNION ALL SELECT root, p_partkey, depth + 1 FROM w JOIN part ON p_partkey // 10 = node WHERE p_partkey >= 10) SELECT * FROM w",
    "r4_ancestor_closure": "SELECT p_partkey AS node, CAST(left(CAST(p_partkey AS VARCHAR), 1) AS BIGINT) AS top FROM part WHERE p_partkey >= 10",
    "r7_components": """WITH RECURSIVE g AS (SELECT DISTINCT o_custkey AS src, o_orderkey % 1000 AS dst FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 1000 % 4 = 0), b AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g),
 w AS (SELECT DISTINCT src AS node, src AS root FROM b UNION SELECT b.dst, w.root FROM w JOIN b ON b.src = w.node WHERE w.root < b.dst) SELECT node, min(root) AS root FROM w GROUP BY 1""",
}
QUERIES = {name: globals()[name] for name in [*SQL, "r5_view_closure_all", "r7_components_all"]}
