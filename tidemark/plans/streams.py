"""Streams over the events table, each held against the batch query that says the same."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import operations
from ..streaming import machines, stateful
from . import testbed as T


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream of files; a single file is found by its pattern."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parque[t]")


def st2_outages(spark: SparkSession, d: str) -> DataFrame:
    return stateful.drained(stateful.outages(_events(spark, d).select(F.col("user_id").alias("node_id"), T.micros("ts").alias("at_time")), 12 * T.HOUR), "outages")


def st3_rates(spark: SparkSession, d: str) -> DataFrame:
    total = F.when(F.col("event_id") % 20 == 0, 0).otherwise(F.col("event_id") * 100).cast("long")
    return stateful.drained(stateful.rates(_events(spark, d).select(F.col("user_id").alias("node_id"), T.micros("ts").alias("at_time"), total.alias("total"))), "rates")


def st6_log_stream(spark: SparkSession, d: str) -> DataFrame:
    level = F.element_at(F.array(*[F.lit(x) for x in operations.SEVERITIES]), (F.col("event_id") % 5 + 1).cast("int"))
    rows = _events(spark, d).select("event_id", level.alias("level"), F.col("event_type").alias("service"), F.col("props").alias("message"), F.col("user_id").cast("string").alias("node_name"), F.lit(None).cast("string").alias("raw"))
    return stateful.drained(operations.logs(rows, "warning", "click").select("event_id", "level", "message"), "logs")


def st4_restarts(spark: SparkSession, d: str) -> DataFrame:
    return stateful.drained(stateful.restarts(_events(spark, d).select((F.col("user_id") % 50).alias("node_id"), T.micros("ts").alias("at_time"), (F.col("event_id") % 40).alias("started"))), "restarts")


def st8_notifications(spark: SparkSession, d: str) -> DataFrame:
    severity = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "view", "warning").when(F.col("event_type") == "click", "info")
    return stateful.drained(stateful.notifications(_events(spark, d).select((F.col("user_id") % 40).alias("key"), T.micros("ts").alias("at_time"), severity.alias("severity"))), "notifications")


def st10_reports(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "view", "running").when(F.col("event_type") == "signup", "expired").otherwise("leased")
    return stateful.drained(stateful.reports(_events(spark, d).select((F.col("event_id") % 700).alias("op"), T.micros("ts").alias("at_time"), said.alias("report"))), "reports")


def st11_sustained(spark: SparkSession, d: str) -> DataFrame:
    return stateful.drained(stateful.sustained(_events(spark, d).select((F.col("user_id") % 30).alias("pair"), T.micros("ts").alias("at_time"), F.when(F.col("event_type") != "view", F.col("event_id") % 6 != 0).alias("lost")), 4 * T.HOUR), "sustained")


def st2_presence(spark: SparkSession, d: str) -> DataFrame:
    return stateful.drained(stateful.presence(_events(spark, d).select(F.col("user_id").alias("node_id"), T.micros("ts").alias("at_time")), 12 * T.HOUR), "presence")


def st11_confirmed(spark: SparkSession, d: str) -> DataFrame:
    lost = F.when(F.col("event_type") != "view", F.col("event_id") % 6 != 0)
    return stateful.drained(stateful.confirmed(_events(spark, d).select((F.col("user_id") % 30).alias("pair"), T.micros("ts").alias("at_time"), lost.alias("lost")), 4 * T.HOUR), "confirmed")


def st8_delivered(spark: SparkSession, d: str) -> DataFrame:
    """Two channels with thresholds; deliveries that fail are repeated. Held against a plain fold in the tests."""
    severity = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "view", "warning").when(F.col("event_type") == "click", "info")
    looks = _events(spark, d).select(F.floor(F.col("event_id") / 6).alias("key"), T.micros("ts").alias("at_time"), severity.alias("severity"))
    channels = spark.createDataFrame([("ops", "info"), ("phone", "critical")], "channel string, least string")
    return machines.delivered(looks, channels, _sends, remind=40 * 24 * T.HOUR)


def _sends(channel: str, lines: pd.DataFrame) -> list[bool]:
    """Stands for a channel that now and then cannot be reached."""
    return [(k + t // 1_000_000) % 7 > 0 for k, t in zip(lines["key"], lines["at_time"], strict=True)]


def st9_leases(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    said = F.when(n < 700, "submit").when((F.col("event_type") == "error") & (n % 3 == 0), "failed").when((F.col("event_type") == "purchase") & (n % 3 == 0), "succeeded").when(F.col("event_type") == "signup", "running").otherwise("poll")
    return stateful.drained(machines.leases(_events(spark, d).select((n % 700).alias("op"), T.micros("ts").alias("at_time"), said.alias("kind"), ((n % 5 + 1) * 24 * T.HOUR).alias("ttl"))), "leases")


def st6_frames(spark: SparkSession, d: str) -> DataFrame:
    entries = _events(spark, d).select(F.col("event_id").alias("entry"), T.micros("ts").alias("at_time"), (F.col("user_id") % 20).alias("cluster_id"), (F.col("event_id") % 5).cast("int").alias("rank"))
    k = F.col("n_nationkey").cast("long")
    subscriptions = T.table(spark, d, "nation").select(k.alias("subscriber"), F.when(k % 4 > 0, k % 20).alias("cluster_id"), (k % 4).cast("int").alias("least"))
    found = stateful.drained(machines.frames(entries, subscriptions, 20, 6 * T.HOUR), "frames")
    return found.select("subscriber", "at_time", F.size("entries").cast("long").alias("n"), "dropped", F.element_at("entries", 1).alias("first_entry"), F.element_at("entries", -1).alias("last_entry"))


def _numbered(key: str, more: str) -> str:
    """Rows of the events table by key, numbered in the order of their times."""
    return f"e AS (SELECT {key}, epoch_us(ts) AS tm, {more}, row_number() OVER (PARTITION BY {key.split(' AS ')[0]} ORDER BY ts) AS n FROM events)"


#: A timer rings if it falls due before the watermark, ten seconds behind the newest event, in whole milliseconds.
CLOCK = "(SELECT max(epoch_us(ts)) // 1000 - 10000 FROM events)"
_ENDED = "('succeeded', 'failed', 'expired', 'cancelled')"
SQL = {
    "st6_frames": f"""WITH s AS (SELECT n_nationkey AS subscriber, CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey % 20 END AS cluster, n_nationkey % 4 AS least FROM nation),
 m AS (SELECT subscriber, event_id, (epoch_us(ts) // {6 * T.HOUR} + 1) * {6 * T.HOUR} AS at_time, row_number() OVER (PARTITION BY subscriber, epoch_us(ts) // {6 * T.HOUR} ORDER BY ts DESC, event_id DESC) AS back FROM events JOIN s ON event_id % 5 >= least AND (cluster IS NULL OR cluster = user_id % 20))
 SELECT subscriber, at_time, least(count(*), 20) AS n, greatest(count(*) - 20, 0) AS dropped, arg_max(event_id, back) FILTER (back <= 20) AS first_entry, arg_min(event_id, back) AS last_entry FROM m WHERE at_time - 1 < {CLOCK} * 1000 GROUP BY 1, 2""",
    "st9_leases": f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY op ORDER BY tm, rnk) AS n FROM (SELECT event_id % 700 AS op, epoch_us(ts) AS tm, 0 AS rnk, (event_id % 5 + 1) * {24 * T.HOUR} AS life,
   CASE WHEN event_id < 700 THEN 'submit' WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'failed' WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'succeeded' WHEN event_type = 'signup' THEN 'running' ELSE 'poll' END AS kind FROM events
  UNION ALL SELECT DISTINCT event_id % 700, {CLOCK} * 1000, 1, 0, 'end' FROM events)),
 f AS (SELECT DISTINCT op, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS tm, '' AS status, 0 AS attempts, CAST(-1 AS BIGINT) AS since, CAST(-1 AS BIGINT) AS until, CAST(0 AS BIGINT) AS ttl, FALSE AS gave_up, CAST(NULL AS VARCHAR) AS event, CAST(NULL AS BIGINT) AS lapse_at, '' AS lapsed_to, CAST(NULL AS BIGINT) AS expire_at, 0 AS had FROM e
 UNION ALL SELECT op, n, tm, CASE WHEN event IN ('adopted', 'alive') THEN 'running' WHEN event IN ('refused', 'repeated') OR event IS NULL THEN s2 ELSE event END, CASE event WHEN 'leased' THEN attempts + 1 WHEN 'queued' THEN 0 ELSE attempts END,
  CASE WHEN event IS NULL OR event IN ('alive', 'refused', 'repeated') THEN since2 ELSE tm END, CASE WHEN event IN ('leased', 'running', 'adopted', 'alive') THEN tm + 120000000 WHEN s2 IN ('leased', 'running') AND event IS NULL THEN until ELSE -1 END,
  CASE WHEN event = 'queued' THEN life ELSE ttl END, CASE WHEN event IS NULL OR event IN ('refused', 'repeated') THEN g2 ELSE FALSE END, event, lapse_at, s1, expire_at, attempts FROM (
  SELECT *, CASE WHEN kind = 'end' THEN NULL WHEN kind = 'submit' THEN CASE WHEN s2 = '' THEN 'queued' END WHEN s2 = '' THEN NULL WHEN kind = 'poll' THEN CASE WHEN s2 = 'queued' THEN 'leased' END
    WHEN s2 IN {_ENDED} AND NOT g2 THEN CASE WHEN s2 = kind THEN 'repeated' ELSE 'refused' END
    WHEN kind = 'running' THEN CASE WHEN s2 = 'queued' AND attempts = 0 THEN 'refused' WHEN s2 = 'running' THEN 'alive' WHEN g2 OR s2 = 'queued' THEN 'adopted' ELSE 'running' END ELSE kind END AS event FROM (
   SELECT *, CASE WHEN s1 = 'queued' AND since1 + ttl < tm THEN since1 + ttl END AS expire_at, CASE WHEN s1 = 'queued' AND since1 + ttl < tm THEN 'expired' ELSE s1 END AS s2,
     CASE WHEN s1 = 'queued' AND since1 + ttl < tm THEN since1 + ttl ELSE since1 END AS since2, CASE WHEN s1 = 'queued' AND since1 + ttl < tm THEN attempts > 0 ELSE g1 END AS g2 FROM (
    SELECT op, n, tm, kind, life, attempts, ttl, until, CASE WHEN lapsed THEN until END AS lapse_at, CASE WHEN lapsed THEN CASE WHEN attempts >= 5 THEN 'failed' ELSE 'queued' END ELSE status END AS s1, CASE WHEN lapsed THEN until ELSE since END AS since1, CASE WHEN lapsed THEN attempts >= 5 ELSE gave_up END AS g1 FROM (
     SELECT e.op, e.n, e.tm, e.kind, e.life, f.status, f.attempts, f.since, f.until, f.ttl, f.gave_up, f.status IN ('leased', 'running') AND f.until < e.tm AS lapsed FROM f JOIN e ON e.op = f.op AND e.n = f.n + 1)))))
 SELECT op, tm AS at_time, event, status, attempts FROM f WHERE event <> 'alive' UNION ALL SELECT op, lapse_at, CASE lapsed_to WHEN 'failed' THEN 'given up' ELSE 'redelivered' END, lapsed_to, had FROM f WHERE lapse_at IS NOT NULL UNION ALL SELECT op, expire_at, 'expired', 'expired', had FROM f WHERE expire_at IS NOT NULL""",
    "st2_presence": f"""WITH s AS (SELECT user_id AS node_id, epoch_us(ts) AS tm, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS after FROM events), g AS (SELECT *, tm + {12 * T.HOUR} AS due FROM s)
 SELECT node_id, due AS at_time, 'offline' AS event FROM g WHERE due < after OR (after IS NULL AND due // 1000 + 1 <= {CLOCK}) UNION ALL SELECT node_id, after, 'online' FROM g WHERE due < after""",
    "st11_confirmed": f"""WITH e AS (SELECT user_id % 30 AS pair, epoch_us(ts) AS t, coalesce(event_type <> 'view' AND event_id % 6 <> 0, FALSE) AS l FROM events), g AS (SELECT *, sum(CASE WHEN l THEN 0 ELSE 1 END) OVER (PARTITION BY pair ORDER BY t) AS run FROM e),
 s AS (SELECT pair, run, min(t) FILTER (l) + {4 * T.HOUR} AS due FROM g GROUP BY pair, run), n AS (SELECT *, (SELECT min(t) FROM g WHERE g.pair = s.pair AND g.run = s.run + 1) AS broken FROM s)
 SELECT pair, due AS at_time FROM n WHERE due < broken OR (broken IS NULL AND due // 1000 + 1 <= {CLOCK})""",
    "st4_restarts": f"""WITH RECURSIVE {_numbered("user_id % 50 AS node_id", "event_id % 40 AS own")}, f AS (SELECT node_id, n, own AS started, tm AS seen, tm, CAST(NULL AS VARCHAR) AS event FROM e WHERE n = 1
 UNION ALL SELECT node_id, n, CASE WHEN event = 'duplicate' THEN started ELSE own END, CASE WHEN event = 'duplicate' THEN seen ELSE tm END, tm, event FROM (
  SELECT e.node_id, e.n, e.own, e.tm, f.started, f.seen, CASE WHEN e.own = f.started THEN NULL WHEN e.own > f.started OR e.tm - f.seen > 90000000 THEN 'restart' ELSE 'duplicate' END AS event FROM f JOIN e ON e.node_id = f.node_id AND e.n = f.n + 1))
 SELECT node_id, tm AS at_time, event FROM f WHERE event IS NOT NULL""",
    "st8_notifications": f"""WITH RECURSIVE {_numbered("user_id % 40 AS key", "CASE event_type WHEN 'error' THEN 2 WHEN 'view' THEN 1 WHEN 'click' THEN 0 END AS r")},
 f AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS since, CAST(-1 AS BIGINT) AS gone, CAST(-1 AS BIGINT) AS sent, -1 AS rank, CAST(0 AS BIGINT) AS tm, CAST(NULL AS VARCHAR) AS event, CAST(NULL AS INTEGER) AS r FROM e
 UNION ALL SELECT key, n, CASE WHEN r IS NOT NULL AND sent < 0 AND event IS NULL THEN s ELSE -1 END, CASE WHEN r IS NULL AND sent >= 0 AND event IS NULL THEN g ELSE -1 END,
  CASE WHEN event = 'resolved' THEN -1 WHEN event IS NOT NULL THEN tm ELSE sent END, CASE WHEN event = 'resolved' THEN -1 WHEN event IS NOT NULL THEN r WHEN sent < 0 THEN coalesce(r, -1) ELSE rank END, tm, event, r FROM (
  SELECT *, CASE WHEN r IS NOT NULL AND sent < 0 AND (r = 2 OR tm - s >= 120000000) THEN 'opened' WHEN r IS NOT NULL AND sent >= 0 AND r > rank THEN 'worse' WHEN r IS NOT NULL AND sent >= 0 AND tm - sent >= 86400000000 THEN 'reminder'
   WHEN r IS NULL AND sent >= 0 AND tm - g >= 300000000 THEN 'resolved' END AS event FROM (
   SELECT e.key, e.n, e.tm, e.r, f.sent, f.rank, CASE WHEN f.since < 0 THEN e.tm ELSE f.since END AS s, CASE WHEN f.gone < 0 THEN e.tm ELSE f.gone END AS g FROM f JOIN e ON e.key = f.key AND e.n = f.n + 1)))
 SELECT key, tm AS at_time, event, CASE WHEN event <> 'resolved' THEN ['info', 'warning', 'critical'][r + 1] END AS severity FROM f WHERE event IS NOT NULL""",
    "st10_reports": f"""WITH RECURSIVE {_numbered("event_id % 700 AS op", "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' WHEN 'view' THEN 'running' WHEN 'signup' THEN 'expired' ELSE 'leased' END AS said")},
 f AS (SELECT DISTINCT op, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS tm, CAST(NULL AS VARCHAR) AS report, CAST(NULL AS VARCHAR) AS verdict, 'queued' AS status, 0 AS attempts FROM e
 UNION ALL SELECT op, n, tm, said, CASE WHEN said = 'leased' THEN 'accepted' WHEN final THEN CASE WHEN status = said OR (status = 'cancelled' AND said = 'failed') THEN 'accepted' ELSE 'refused' END WHEN early THEN 'refused' ELSE 'accepted' END,
  CASE WHEN said = 'leased' THEN CASE WHEN status = 'queued' THEN 'leased' ELSE status END WHEN final OR early THEN status ELSE said END, attempts + CASE WHEN said = 'leased' AND status = 'queued' THEN 1 ELSE 0 END FROM (
  SELECT e.op, e.n, e.tm, e.said, f.status, f.attempts, f.status IN ('succeeded', 'failed', 'expired', 'cancelled') AND NOT (f.status = 'expired' AND f.attempts > 0) AS final, e.said = 'running' AND f.status = 'queued' AND f.attempts = 0 AS early FROM f JOIN e ON e.op = f.op AND e.n = f.n + 1))
 SELECT op, tm AS at_time, report, verdict, status FROM f WHERE n > 0""",
    "st2_outages": f"WITH s AS (SELECT user_id AS node_id, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS from_time, epoch_us(ts) AS to_time FROM events) SELECT * FROM s WHERE to_time - from_time > {12 * T.HOUR}",
    "st3_rates": """WITH s AS (SELECT user_id AS node_id, epoch_us(ts) AS at_time, CASE WHEN event_id % 20 = 0 THEN 0 ELSE event_id * 100 END AS total FROM events), l AS (SELECT *, (at_time - lag(at_time) OVER w) / 1000000 AS s, total - lag(total) OVER w AS m FROM s WINDOW w AS (PARTITION BY node_id ORDER BY at_time))
 SELECT node_id, at_time, CASE WHEN m >= 0 AND s > 0 THEN floor(m / s * 10 + 0.5) / 10 END AS rate FROM l""",
    "st6_log_stream": "SELECT event_id, ['debug', 'info', 'warning', 'error', 'critical'][CAST(event_id % 5 + 1 AS INTEGER)] AS level, props AS message FROM events WHERE event_id % 5 >= 2 AND event_type = 'click'",
    "st11_sustained": f"""WITH e AS (SELECT user_id % 30 AS pair, epoch_us(ts) AS t, event_id, coalesce(event_type <> 'view' AND event_id % 6 <> 0, FALSE) AS l FROM events), g AS (SELECT *, sum(CASE WHEN l THEN 0 ELSE 1 END) OVER (PARTITION BY pair ORDER BY t) AS run FROM e),
 s AS (SELECT *, min(t) FILTER (l) OVER (PARTITION BY pair, run) AS since FROM g) SELECT pair, min(t) AS at_time FROM s WHERE l AND t - since >= {4 * T.HOUR} GROUP BY pair, run""",
}
QUERIES = {name: globals()[name] for name in [*SQL, "st8_delivered"]}
