"""Two versions of a table or a store: differences, merge plans and their effects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .steps import cut

CLASSES = ["missing_now", "added_since", "changed"]


def row_keys(attributes: DataFrame, indexes: DataFrame) -> DataFrame:
    """How the rows of each table are told apart (D2): its columns, and the key and where that comes from.

    ``attributes(table, attnum, name, not_null, generated, identity, dropped)``; ``indexes(table, index,
    is_primary, is_unique, valid, partial, keys)`` with ``keys`` the numbers of the attributes, 0 for an
    expression. The primary key, else the narrowest whole unique index over columns that are never null;
    else the key is null. Lists are those of one table's columns.
    """
    live = attributes.filter(~F.col("dropped"))
    names = lambda shown: F.transform(F.array_sort(F.collect_list(F.when(shown, F.struct("attnum", "name")))), lambda x: x["name"])
    columns = live.groupBy("table").agg(names(F.lit(True)).alias("columns"), names(F.col("generated")).alias("generated"), F.max(F.coalesce(F.col("identity") == "a", F.lit(False))).alias("identity_always"))
    places = indexes.filter("is_primary OR (is_unique AND valid AND NOT partial AND NOT array_contains(keys, 0))").select("table", "index", "is_primary", F.posexplode("keys").alias("place", "attnum"))
    met = places.join(live.select("table", "attnum", "name", "not_null"), ["table", "attnum"], "left").groupBy("table", "index", "is_primary")
    held = met.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("key"), F.min(F.coalesce("not_null", F.lit(False))).alias("sure"))
    rank = F.struct((~F.col("is_primary")).alias("second"), F.size("key").alias("width"), "index", "key")
    best = held.filter("is_primary OR sure").groupBy("table").agg(F.min(rank).alias("best"))
    source = F.when(F.col("best.second"), F.concat(F.lit("unique index "), F.col("best.index"))).when(~F.col("best.second"), "primary key")
    return columns.join(best, "table", "left").select("table", "columns", "generated", "identity_always", F.col("best.key").alias("key"), source.alias("key_from"))


def row_diff(restored: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Each key with its ``class`` and the ``columns`` that differ.

    Only columns that both have are compared, null equal to null. ``missing_now``: only in the restored
    version; ``added_since``: only in the live one; ``changed``; ``same``. Keys must be unique and not null.
    """
    common = sorted(set(restored.columns) & set(live.columns) - set(keys))
    a = restored.select(*keys, F.struct(F.lit(True).alias("there"), *[F.col(c) for c in common]).alias("a"))
    b = live.select(*keys, F.struct(F.lit(True).alias("there"), *[F.col(c) for c in common]).alias("b"))
    differ = F.filter(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c) for c in common]), lambda c: c.isNotNull()) if common else F.array().cast("array<string>")
    kind = F.when(F.col("b").isNull(), "missing_now").when(F.col("a").isNull(), "added_since").when(F.size("columns") > 0, "changed").otherwise("same")
    both = a.join(b, keys, "full_outer").withColumn("columns", differ)
    return both.select(*keys, kind.alias("class"), F.when(kind == "changed", F.array_join("columns", ",")).alias("columns"))


def class_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("class").agg(F.count("*").alias("n"))


def class_samples(diff: DataFrame, keys: list[str], limit: int = 20) -> DataFrame:
    """The first ``limit`` keys of each class that differs (L5), each by a bounded sort of its own."""
    return reduce(DataFrame.unionByName, [diff.filter(F.col("class") == c).orderBy(*keys).limit(limit) for c in CLASSES])


def apply_plan(diff: DataFrame, classes: list[str], chosen: DataFrame | None, keys: list[str]) -> DataFrame:
    """What to do with each key (D3): insert, update or delete for the chosen classes or keys; ``unknown`` keys are refused."""
    action = F.when(F.col("class") == "missing_now", "insert").when(F.col("class") == "changed", "update").when(F.col("class") == "added_since", "delete")
    if chosen is None:
        return diff.filter(F.col("class").isin(classes)).select(*keys, action.alias("action"))
    asked = chosen.select(*keys).distinct().join(diff, keys, "left")
    return asked.select(*keys, F.coalesce(action, F.when(F.col("class") == "same", "none"), F.lit("unknown")).alias("action"))


def merged(live: DataFrame, restored: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """The live version after the plan (D4): rows to delete or replace go, the restored ones come in.

    Columns that only the live version has are kept for rows that are updated and null for new ones.
    """
    touched = plan.filter("action IN ('insert', 'update', 'delete')")
    rest = live.join(touched.select(*keys), keys, "left_anti")
    own = [c for c in live.columns if c not in restored.columns]
    incoming = restored.join(touched.filter("action <> 'delete'").select(*keys), keys, "left_semi")
    if own:
        incoming = incoming.join(live.select(*keys, *own), keys, "left")
    return rest.unionByName(incoming.select(*live.columns))


Columns = str | list[str] | tuple[str, ...]


def _listed(columns: Columns) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def _pointing(child: DataFrame, columns: list[str], parents: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``child`` whose key is that of one of ``parents``; a key with a null part points at nothing."""
    return child.join(parents.select(*[F.col(k).alias(c) for c, k in zip(columns, key, strict=True)]).distinct(), columns, "left_semi")


def delete_effects(tables: dict[str, DataFrame], keys: list[tuple[str, Columns, str, Columns, str]], table: str, gone: DataFrame, depth: int = 30) -> DataFrame:
    """Rows that deleting ``gone`` rows of ``table`` reaches over foreign keys.

    ``keys``: child table, its columns, parent table, the columns that they refer to (one or several, in
    the same order), and what deleting does: cascade, set_null, set_default or block. Cascades go on from
    the child's rows that were not reached before, so that a table that refers to itself ends and the rows
    that go anyway are no victims of their own cascade; rows over more than one key are followed once.
    ``level``, ``child``, ``action``, ``n``. More than ``depth`` levels are refused, never cut short.
    """
    keys = [(child, _listed(columns), of, _listed(key), action) for child, columns, of, key, action in keys]
    led = {parent: sorted({c for _, _, p, key, _ in keys if p == parent for c in key}) for _, _, parent, _, _ in keys}
    known = {table: cut(gone.select(*led[table]).distinct())} if table in led else {}
    out, front, level = [], {table: gone}, 0
    while front:
        level += 1
        if level > depth:
            raise ValueError(f"deleting from {table} reaches over {depth} levels of keys")
        reached: dict[str, list[DataFrame]] = {}
        for child, columns, of, key, action in keys:
            if of in front:
                hit = _pointing(tables[child], columns, front[of], key)
                if child == of and child in known:
                    hit = hit.join(known[child], led[child], "left_anti")
                if action == "cascade" and child in led:
                    hit = cut(hit.join(known[child], led[child], "left_anti") if child in known and child != of else hit)
                    reached.setdefault(child, []).append(hit)
                out.append(hit.agg(F.count("*").alias("n")).select(F.lit(level).alias("level"), F.lit(child).alias("child"), F.lit(action).alias("action"), "n"))
        front = {}
        for child, hits in reached.items():
            fresh = cut(reduce(DataFrame.unionByName, hits).dropDuplicates(led[child]))
            if not fresh.isEmpty():
                front[child] = fresh
                ids = fresh.select(*led[child])
                known[child] = cut(known[child].unionByName(ids)) if child in known else ids
    return reduce(DataFrame.unionByName, out).filter("n > 0")


def update_effects(tables: dict[str, DataFrame], keys: list[tuple[str, Columns, str, Columns, str]], table: str, before: DataFrame, after: DataFrame, identity: Columns) -> DataFrame:
    """Rows that refer to rows of ``table`` whose referenced columns change (J6): ``child``, ``action``, ``n``.

    ``before`` and ``after`` are versions of the same rows by ``identity``. A key matters only if one of
    its own columns differs, null counting as a value; what an update does is the key's action here.
    """
    ids = _listed(identity)
    out = []
    for child, columns, of, key, action in keys:
        if of == table:
            columns, key = _listed(columns), _listed(key)
            new = after.select(*ids, *[F.col(c).alias(f"__{c}") for c in key])
            differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key])
            hit = _pointing(tables[child], columns, before.join(new, ids).filter(differs), key)
            out.append(hit.agg(F.count("*").alias("n")).select(F.lit(child).alias("child"), F.lit(action).alias("action"), "n"))
    return reduce(DataFrame.unionByName, out).filter("n > 0")


def orphans(child: DataFrame, parent: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """Child rows whose key, no part of it null, has no parent."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c, _ in columns])
    return child.filter(whole).join(parent.select(*[F.col(p).alias(c) for c, p in columns]).distinct(), [c for c, _ in columns], "left_anti")


def mirror_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Per object (``key``, ``size``, ``immutable``): upload, delete, conflict or same, and its turn.

    An immutable object is never overwritten. Uploads go in the order of their classes, deletes in reverse.
    """
    both = local.select("key", F.col("size").alias("l"), "immutable").join(remote.select("key", F.col("size").alias("r")), "key", "full_outer")
    plan = F.when(F.col("l").isNull(), "delete").when(F.col("r").isNull(), "upload").when(F.col("l") == F.col("r"), "same").when(F.col("immutable"), "conflict").otherwise("upload")
    group = F.when(F.col("key").startswith("chunks/"), 0).when(F.col("key").startswith("wal/"), 1).when(F.col("key").startswith("backup/"), 2).otherwise(3)
    return both.select("key", plan.alias("plan"), F.when(plan == "upload", group).when(plan == "delete", 3 - group).alias("turn"))


def migration_plan(old: DataFrame, new: DataFrame, retired: DataFrame) -> DataFrame:
    """Per archived object (``name``, ``sha``): copy, skip, conflict, kept or retired."""
    both = old.select("name", F.col("sha").alias("a")).join(new.select("name", F.col("sha").alias("b")), "name", "full_outer").join(retired.select("name", F.lit(True).alias("gone")), "name", "left")
    return both.select("name", F.when(F.col("a").isNull(), "kept").when(F.col("gone"), "retired").when(F.col("b").isNull(), "copy").when(F.col("a") == F.col("b"), "skip").otherwise("conflict").alias("plan"))


def rehydrate_plan(remote: DataFrame, local: DataFrame, retired: DataFrame) -> DataFrame:
    """Remote objects to bring back (D9): missing, ``retired`` on purpose, or of a size that ``differs``; in order of ``turn``."""
    both = remote.join(local.select("key", F.col("size").alias("l")), "key", "left").join(retired.select("key", F.lit(True).alias("gone")), "key", "left")
    plan = F.when(F.col("l").isNotNull(), F.when(F.col("l") != F.col("size"), "differs")).when(F.col("gone"), "retired").otherwise("missing")
    turn = F.when(F.col("key").startswith("id/"), 0).when(F.col("key").startswith("wal/"), 1).otherwise(2)
    return both.select("key", plan.alias("plan"), turn.alias("turn")).filter("plan IS NOT NULL")


def merge_duplicates(clusters: DataFrame, operations: DataFrame) -> DataFrame:
    """Old id to kept id of clusters of the same key and environment (D13): most operations wins, then the oldest."""
    counted = clusters.join(operations.groupBy(F.col("cluster_id").alias("id")).agg(F.count("*").alias("ops")), "id", "left").fillna(0, ["ops"])
    best = F.first("id").over(Window.partitionBy("cluster_key", "environment").orderBy(F.desc("ops"), "created", "id"))
    return counted.select("id", best.alias("keeper")).filter("id <> keeper")


def repointed(rows: DataFrame, mapping: DataFrame, column: str = "cluster_id") -> DataFrame:
    return rows.join(mapping.select(F.col("id").alias(column), "keeper"), column, "left").withColumn(column, F.coalesce("keeper", column)).drop("keeper")


def promotion_plan(restored: DataFrame, live: DataFrame, mode: str) -> DataFrame:
    """Per restored table (``name``, ``unlogged``): copy, skip, swap or create."""
    both = restored.join(live.select("name", F.lit(True).alias("there")), "name", "left")
    there = F.coalesce("there", F.lit(False))
    action: Column = F.lit("copy") if mode == "as_new" else F.when(there & (F.lit(mode) == "missing_only"), "skip").when(there & F.col("unlogged"), "skip").when(there, "swap").otherwise("create")
    return both.select("name", action.alias("action"), (there & F.col("unlogged") & (F.lit(mode) == "replace")).alias("warning"))
