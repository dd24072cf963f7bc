"""Settings that are assigned to scopes: cluster, folders from the deepest up, environment, global."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folder_chain(folder: Column) -> Column:
    """``a/b/c`` as ``a/b/c``, ``a/b``, ``a`` (O3); blanks around parts and empty parts are dropped."""
    parts = F.filter(F.transform(F.split(F.coalesce(folder, F.lit("")), "/"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def candidates(clusters: DataFrame) -> DataFrame:
    """Each cluster's scopes (``scope``, ``key``) with ``rank``, the most specific 0."""
    one = lambda scope, key: F.struct(F.lit(scope).alias("scope"), key.cast("string").alias("key"))
    every = F.concat(F.array(one("cluster", F.col("cluster_id"))), F.transform(folder_chain(F.col("folder")), lambda f: one("folder", f)), F.array(one("env", F.col("environment")), one("global", F.lit(""))))
    return clusters.select("cluster_id", F.posexplode(every).alias("rank", "s")).select("cluster_id", "rank", "s.*")


def resolve(clusters: DataFrame, assignments: DataFrame, templates: DataFrame) -> DataFrame:
    """The policy of each cluster (O1): the most specific scope that is disabled or has a policy decides.

    ``assignments(scope, key, template, policy, disabled)``; a template that exists wins over the own
    policy. ``source`` is null where no scope says anything.
    """
    said = candidates(clusters).join(assignments, ["scope", "key"]).join(templates, "template", "left")
    policy = F.coalesce("template_policy", "policy")
    first = said.withColumn("effective", policy).filter("disabled OR effective IS NOT NULL").groupBy("cluster_id").agg(F.min_by(F.struct("scope", "key", "disabled", "effective"), "rank").alias("x"))
    return clusters.select("cluster_id").join(first, "cluster_id", "left").select("cluster_id", F.when(~F.col("x.disabled"), F.col("x.effective")).alias("policy"), F.col("x.scope").alias("source"), F.coalesce("x.disabled", F.lit(False)).alias("disabled"))


def overlay(clusters: DataFrame, values: DataFrame, defaults: DataFrame) -> DataFrame:
    """Per cluster and field the value of the most specific scope that sets it, and where it came from (O2)."""
    set_ = candidates(clusters).join(values, ["scope", "key"]).groupBy("cluster_id", "field").agg(F.min_by(F.struct("value", "scope"), "rank").alias("x"))
    fields = defaults.agg(F.collect_list(F.struct("field", "default")).alias("d"))  # one row: the kind's fields
    every = clusters.select("cluster_id").join(F.broadcast(fields)).select("cluster_id", F.explode("d").alias("d")).select("cluster_id", "d.*")
    own = set_.select("cluster_id", "field", "x.value", "x.scope")
    return every.join(own, ["cluster_id", "field"], "full_outer").select("cluster_id", "field", F.coalesce("value", "default").alias("value"), F.coalesce("scope", F.lit("default")).alias("source"))
