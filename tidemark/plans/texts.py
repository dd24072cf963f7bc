"""Functions on text over the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parameters, text
from . import testbed as T


def t1_human(spark: SparkSession, d: str) -> DataFrame:
    o = T.table(spark, d, "orders")
    size = F.pow(F.lit(1024.0), (F.col("o_orderkey") % 6).cast("double")) * (F.col("o_orderkey") % 997)
    return o.select("o_orderkey", text.human_bytes(size).alias("size"), text.human_hours((F.col("o_orderkey") % 4000) / 16.0).alias("age"))


def t2_paths(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    c = T.table(spark, d, "customer").withColumn("path", text.join_path(F.array(F.lit("db"), F.concat(F.when(F.col("c_custkey") % 2 == 0, "a.").otherwise(""), key), F.concat(key, F.when(F.col("c_custkey") % 3 == 0, '"x"').otherwise("")))))
    back = text.split_path(F.when(F.col("c_custkey") % 7 == 0, F.concat("path", F.lit('."open'))).otherwise(F.col("path")))
    return c.select("c_custkey", "path", F.array_join(back, "|").alias("parts"))


def t3_target_times(spark: SparkSession, d: str) -> DataFrame:
    ending = F.element_at(F.array(F.lit("Z"), F.lit(" UTC"), F.lit("+02"), F.lit("-03:30"), F.lit("")), (F.col("event_id") % 5 + 1).cast("int"))
    said = F.concat(F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), ending)
    return T.table(spark, d, "events").select("event_id", said.alias("said")).select("event_id", text.target_time(F.col("said")).alias("target"), text.target_micros(F.col("said")).alias("at_time"))


def t4_json_keys(spark: SparkSession, d: str) -> DataFrame:
    n = T.table(spark, d, "supplier")
    work = F.create_map(F.lit("node"), F.col("s_suppkey").cast("string"), F.lit("dryRun"), F.lit("true"), F.lit("database"), F.col("s_name"))
    return n.select(text.json_key(F.col("s_suppkey"), F.col("s_name"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey"))).alias("key"), text.stable_json(work, ("dryRun",)).alias("work"))


def t5_event_times(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp_ntz")
    full = F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    said = F.array(full, *[F.concat(full, F.lit(x)) for x in ("Z", " UTC", "+02", "-0330")], F.date_format(ts, "yyyy-MM-dd"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm"), F.date_format(ts, "yyyy-'13'-dd"))
    return T.table(spark, d, "events").select("event_id", text.event_micros(F.element_at(said, (F.col("event_id") % 8 + 1).cast("int"))).alias("at_time"))


def t6_slugs(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("page_id") % 10 == 0, None).when(F.col("page_id") % 10 == 1, "--./").otherwise(F.col("url"))
    return T.table(spark, d, "pages").select("page_id", text.slug(name).alias("slug"))


def t7_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Nested parameters as they may be shown, and their stable text."""
    k = F.col("o_orderkey").cast("string")
    said = F.format_string('{"path": "/b/%s", "source": "%s", "into": {"password": "p%s", "db": "d"}, "steps": [{"repo": ["/r", {"wal": "/w", "n": 1}], "b": 2, "a": %s}]}%s', k, F.when(F.col("o_orderkey") % 2 == 0, "agent").otherwise("/s"), k, k, F.when(F.col("o_orderkey") % 7 == 0, "}").otherwise(""))
    return T.table(spark, d, "orders").select("o_orderkey", said.alias("said")).select("o_orderkey", parameters.shown(F.col("said")).alias("shown"), parameters.stable(F.col("said")).alias("stable"))


SQL = {
    "t5_event_times": """WITH e AS (SELECT event_id, event_id % 8 AS m, CAST(ts AS TIMESTAMP) AS t FROM events)
 SELECT event_id, CASE m WHEN 3 THEN epoch_us(t) - 7200000000 WHEN 4 THEN epoch_us(t) + 12600000000 WHEN 5 THEN epoch_us(CAST(date_trunc('day', t) AS TIMESTAMP)) WHEN 6 THEN epoch_us(CAST(date_trunc('minute', t) AS TIMESTAMP)) WHEN 7 THEN NULL ELSE epoch_us(t) END AS at_time FROM e""",
    "t6_slugs": "SELECT page_id, CASE WHEN page_id % 10 < 2 THEN 'cluster' ELSE coalesce(nullif(substr(trim(regexp_replace(lower(url), '[^a-z0-9_-]+', '-', 'g'), '-'), 1, 60), ''), 'cluster') END AS slug FROM pages",
    "t7_parameters": """WITH o AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k, o_orderkey % 2 = 0 AS word, o_orderkey % 7 = 0 AS bad FROM orders)
 SELECT o_orderkey, CASE WHEN NOT bad THEN '{"path":"(hidden)","source":"' || CASE WHEN word THEN 'agent' ELSE '(hidden)' END || '","into":{"password":"•••","db":"d"},"steps":[{"repo":["(hidden)",{"wal":"(hidden)","n":1}],"b":2,"a":' || k || '}]}' END AS shown,
 CASE WHEN NOT bad THEN '{"into":{"db":"d","password":"p' || k || '"},"path":"/b/' || k || '","source":"' || CASE WHEN word THEN 'agent' ELSE '/s' END || '","steps":[{"a":' || k || ',"b":2,"repo":["/r",{"n":1,"wal":"/w"}]}]}' END AS stable FROM o""",
    "t1_human": """SELECT o_orderkey, CASE WHEN b < 1024 THEN printf('%.1f B', b) WHEN b < 1024.0 ** 2 THEN printf('%.1f KiB', b / 1024) WHEN b < 1024.0 ** 3 THEN printf('%.1f MiB', b / 1024.0 ** 2) WHEN b < 1024.0 ** 4 THEN printf('%.1f GiB', b / 1024.0 ** 3) WHEN b < 1024.0 ** 5 THEN printf('%.1f TiB', b / 1024.0 ** 4) ELSE printf('%.1f PiB', b / 1024.0 ** 5) END AS size,
 CASE WHEN h >= 48 THEN CAST(CAST(floor(h / 24 + 0.5) AS BIGINT) AS VARCHAR) || ' days' WHEN h >= 2 THEN CAST(CAST(floor(h + 0.5) AS BIGINT) AS VARCHAR) || ' hours' WHEN greatest(1, floor(h * 60 + 0.5)) = 1 THEN '1 minute' ELSE CAST(CAST(floor(h * 60 + 0.5) AS BIGINT) AS VARCHAR) || ' minutes' END AS age
 FROM (SELECT o_orderkey, CAST(1024.0 ** (o_orderkey % 6) * (o_orderkey % 997) AS DOUBLE) AS b, (o_orderkey % 4000) / 16.0 AS h FROM orders)""",
    "t2_paths": '''WITH p AS (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS k, CASE WHEN c_custkey % 2 = 0 THEN 'a.' ELSE repeat('a', 0) END || CAST(c_custkey AS VARCHAR) AS s, c_custkey % 3 = 0 AS q FROM customer)
 SELECT c_custkey, 'db.' || CASE WHEN c_custkey % 2 = 0 THEN '"' || s || '"' ELSE s END || '.' || CASE WHEN q THEN '"' || k || '""x"""' ELSE k END AS path, CASE WHEN c_custkey % 7 > 0 THEN 'db|' || s || '|' || k || CASE WHEN q THEN '"x"' ELSE repeat('a', 0) END END AS parts FROM p''',
    "t3_target_times": """WITH e AS (SELECT event_id, event_id % 5 AS m, ts, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS t FROM events)
 SELECT event_id, CASE m WHEN 0 THEN t || '+00' WHEN 1 THEN t || '+00' WHEN 2 THEN t || '+02' WHEN 3 THEN t || '-03:30' END AS target, CASE m WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(ts) WHEN 2 THEN epoch_us(ts) - 7200000000 WHEN 3 THEN epoch_us(ts) + 12600000000 END AS at_time FROM e""",
    "t4_json_keys": """SELECT '[' || CAST(s_suppkey AS VARCHAR) || ', "' || s_name || '", ' || CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_nationkey AS VARCHAR) ELSE 'null' END || ']' AS key, '[["database","' || s_name || '"],["node","' || CAST(s_suppkey AS VARCHAR) || '"]]' AS work FROM supplier""",
}
QUERIES = {name: globals()[name] for name in SQL}
