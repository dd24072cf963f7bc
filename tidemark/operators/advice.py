"""Advice on hosts from what discovery saw: tools, instances, cluster managers and their stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fleet import _explode, _finding


def host_advice(hosts: DataFrame, instances: DataFrame, managers: DataFrame, stores: DataFrame) -> DataFrame:
    """``host``, ``severity``, ``code`` and ``detail`` (what it is about); what nobody told raises nothing.

    ``hosts(host, psql, waldump, zstd)``: whether the tools are there. ``instances(host, target, running,
    owned, readable, archive_mode, foreign_tool, wal_level, control, checksums, hints, ssl, fsync,
    full_page_writes)``; an unknown ``archive_mode`` is off, and instances that the tool runs itself
    (``owned``) do not count towards several. ``managers(host, scope, url, reachable)``; ``stores(host, name,
    members)``.
    """
    i, no = F.col, lambda x: ~F.coalesce(F.col(x), F.lit(False))
    several = instances.filter(i("running") & no("owned")).groupBy("host").agg(F.count("*").alias("n"))
    mode, off = F.lower(F.coalesce(F.when(i("archive_mode") != "", i("archive_mode")), F.lit("off"))), lambda x: F.coalesce(F.col(x), F.lit("on")) == "off"
    named = lambda rows: rows.withColumnRenamed("host", "cluster_id")
    parts = [
        _explode(named(hosts), [_finding("critical", "NO_PSQL", no("psql"), F.lit("host")), _finding("info", "NO_WALDUMP", no("waldump"), F.lit("host")), _finding("warning", "NO_ZSTD", no("zstd"), F.lit("host"))]),
        _explode(named(several), [_finding("warning", "MULTI_INSTANCE", i("n") > 1, F.lit("host"))]),
        _explode(named(instances), [
            _finding("critical", "UNREADABLE", ~i("readable"), i("target")), _finding("warning", "NOT_RUNNING", no("running"), i("target")), _finding("warning", "ARCHIVE_OFF", mode == "off", i("target")),
            _finding("warning", "ARCHIVE_FOREIGN", (mode != "off") & (i("foreign_tool") != ""), i("target")), _finding("critical", "WAL_MINIMAL", i("wal_level") == "minimal", i("target")),
            _finding("info", "NO_CHECKSUMS", i("control") & no("checksums") & (F.coalesce("hints", F.lit("off")) != "on"), i("target")), _finding("warning", "SSL_OFF", (i("ssl") != "") & (i("ssl") != "on"), i("target")),
            _finding("critical", "UNSAFE_DURABILITY", off("fsync") | off("full_page_writes"), i("target")),
        ]),
        _explode(named(managers), [_finding("warning", "PATRONI_REST", ~i("reachable") & (i("url") != ""), i("scope"))]),
        _explode(named(stores), [_finding("warning", "ETCD_EVEN", (i("members") > 0) & (i("members") % 2 == 0), i("name")), _finding("warning", "ETCD_SINGLE", i("members") == 1, i("name"))]),
    ]
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return found.withColumnRenamed("cluster_id", "host")
