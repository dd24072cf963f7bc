"""Backup sets: chains, overlays, coverage, retention, garbage collection, verification and plans.

Inputs: ``sets(stanza, id, type, status, started, ended, ...)``, ``chunks(set_id, rel, offset, len, hash)``,
``packs(pack, hash, len, mtime)``. Types are full, incr and diff; a set is good if it is COMPLETE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import as_of, difference
from .steps import cut
from .wal import islands

#: Dead share of a pack's bytes that makes it worth rewriting, and hours that a new pack is left alone.
REPACK_SHARE, YOUNG_HOURS = 0.25, 48
#: Seconds between a target and the end of a set that is not full; days that a set may wait for its log.
MARGIN, GRACE_DAYS = 2, 7
#: Bytes of log that one bucket of an as-of choice spans.
WIDTH = 1 << 36
JUNK = ["FAILED", "UNRECOVERABLE", "RUNNING", "PENDING_WAL", "EXPIRING"]
#: Pages of a relation segment and of a chunk.
SEGMENT_PAGES, CHUNK_PAGES = 131_072, 128


def parent_chains(sets: DataFrame) -> DataFrame:
    """For each set (``id``, ``parent``, ``type``, ``status``) its chain's base, length and ``problem``.

    Pointers are doubled: after k rounds 2^k parents have been followed, until all have ended or more were
    followed than there are sets. What has not ended by then is a ``cycle``; other problems are a parent that is ``missing`` or ``incomplete`` and a base that is
    ``not_full``.
    """
    flat = sets.select("id", "parent", "type", "status")
    up = flat.select(F.col("id").alias("parent"), F.col("status").alias("p_status"))
    walk = cut(
        flat.join(up, "parent", "left").select(
            "id",
            F.when(F.col("parent").isNull(), F.col("id")).otherwise(F.col("parent")).alias("at"),
            F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("steps"),
            F.when(F.col("parent").isNotNull() & F.col("p_status").isNull(), "missing").when(F.col("parent").isNotNull() & (F.col("p_status") != "COMPLETE"), "incomplete").alias("problem"),
            F.col("parent").isNull().alias("done"),
        )
    )
    followed, most = 1, walk.count()
    while followed <= most and not walk.filter("NOT done AND problem IS NULL").isEmpty():
        followed *= 2
        step = walk.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more"), F.col("problem").alias("later"), F.col("done").alias("ended"))
        go = ~F.col("done") & F.col("problem").isNull()
        walk = cut(
            walk.join(step, "at", "left").select(
                "id",
                F.when(go, F.col("next")).otherwise(F.col("at")).alias("at"),
                F.when(go, F.col("steps") + F.col("more")).otherwise(F.col("steps")).alias("steps"),
                F.coalesce("problem", F.when(go, F.col("later"))).alias("problem"),
                F.when(go, F.col("ended")).otherwise(F.col("done")).alias("done"),
            )
        )
    base = flat.select(F.col("id").alias("at"), F.col("type").alias("base_type"))
    out = walk.join(base, "at", "left")
    problem = F.coalesce("problem", F.when(~F.col("done"), "cycle"), F.when(F.col("base_type") != "full", "not_full"))
    return out.select("id", F.when(problem.isNull(), F.col("at")).alias("base"), F.when(problem.isNull(), F.col("steps") + 1).alias("length"), problem.alias("problem"))


def chain_members(sets: DataFrame, order: list[str]) -> DataFrame:
    """Good sets of each stanza since its latest full one, with their place in the chain."""
    along = Window.partitionBy("stanza").orderBy(*order)
    numbered = sets.filter("status = 'COMPLETE'").withColumn("base_no", F.sum((F.col("type") == "full").cast("long")).over(along))
    last = F.max("base_no").over(Window.partitionBy("stanza"))
    chain = numbered.withColumn("newest", last).filter("base_no = newest AND base_no > 0")
    place = F.row_number().over(along)
    return chain.withColumns({"chain_pos": place.cast("long"), "chain_size": F.count("*").over(Window.partitionBy("stanza"))}).drop("base_no", "newest")


def overlay(chunks: DataFrame, members: DataFrame) -> DataFrame:
    """What a restore reads: of every file of the chain's last set, for each offset the latest chunk (R2).

    ``whole`` files come from the last set alone; files that the last set does not have stay gone.
    """
    placed = chunks.join(members.select(F.col("id").alias("set_id"), "stanza", "chain_pos", "chain_size"), "set_id")
    files = placed.filter("chain_pos = chain_size").select("stanza", "rel").distinct()
    usable = placed.filter("NOT whole OR chain_pos = chain_size").join(files, ["stanza", "rel"], "left_semi")
    return usable.groupBy("stanza", "rel", "offset").agg(F.max_by(F.struct("set_id", "hash", "len"), "chain_pos").alias("from"), F.count("*").alias("versions")).select("stanza", "rel", "offset", "from.*", "versions")


def choose_sets(targets: DataFrame, sets: DataFrame, margin: int = MARGIN, width: int = WIDTH) -> DataFrame:
    """For each target (``stanza``, ``target``) the newest good set that had ended by then.

    A set that is not full must have ended ``margin`` before, since its end is only known to the
    second. Sets and targets are never paired, and one stanza's are spread over buckets of ``width``.
    """
    ready = sets.filter("status = 'COMPLETE'").select("stanza", (F.col("stop_pos") + F.when(F.col("type") == "full", 0).otherwise(margin)).alias("when"), F.struct("stop_pos", "id").alias("value"))
    return as_of(targets.select("stanza", F.col("target").alias("when")), ready, ["stanza"], width).select("stanza", F.col("when").alias("target"), F.col("value.id").alias("set_id"))


def choose_by_target(targets: DataFrame, sets: DataFrame, margin: int = MARGIN, day: int = 86_400, width: int = WIDTH) -> DataFrame:
    """The set that a recovery starts from, for targets of every kind (J3): ``target``, ``stanza``, ``set_id``, ``problem``.

    ``targets(target, stanza, kind, value)``: ``time`` (seconds), ``lsn`` (a position), ``xid`` (``value``: a
    position that its commit is known not to lie before, or null), ``name`` (a named restore point) or
    ``latest``. The newest good set that had ended by then is taken; by time one that is not full needs
    ``margin`` seconds more. A transaction without a position and a named point cannot be placed among
    sets, so only the newest full one is safe. A transaction before every set falls back to that too.
    """
    good = sets.filter("status = 'COMPLETE'")
    key = F.struct("stop_pos", "id")
    ends = lambda when: good.select("stanza", when.alias("when"), key.alias("value"))
    asked = targets.select("stanza", F.col("value").alias("when"), "target", "kind")
    timed = as_of(asked.filter("kind = 'time' AND when IS NOT NULL"), ends(F.col("ended") + F.when(F.col("type") == "full", 0).otherwise(margin)), ["stanza"], day)
    placed = as_of(asked.filter("kind IN ('lsn', 'xid') AND when IS NOT NULL"), ends(F.col("stop_pos")), ["stanza"], width)
    others = asked.filter("kind IN ('name', 'latest') OR when IS NULL").withColumn("value", F.lit(None).cast("struct<stop_pos:bigint,id:bigint>"))
    newest = good.groupBy("stanza").agg(F.max(key).alias("any"), F.max(F.when(F.col("type") == "full", key)).alias("full"))
    found = timed.unionByName(placed).unionByName(others).join(newest, "stanza", "left")
    unplaced = F.col("kind").isin("xid", "name")
    chosen = F.when(F.col("value").isNotNull(), F.col("value")).when(unplaced, F.col("full")).when((F.col("kind") == "latest") | F.col("when").isNull(), F.col("any"))
    problem = F.when(F.col("any").isNull(), "no backup").when(chosen.isNotNull(), None).when(unplaced, "no full backup").otherwise("earlier than every backup")
    return found.select("target", "stanza", chosen["id"].alias("set_id"), problem.alias("problem"))


def missing_segments(sets: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments from ``first`` to ``last`` of each set that are not there under its timeline."""
    holes = difference(sets.select("id", "tli", F.col("first").alias("lo"), F.col("last").alias("hi")), islands(segments.select("tli", "segno").distinct(), ["tli"], "segno"), ["id", "tli"], ["tli"])
    return holes.select("tli", F.explode(F.sequence("first", "last")).alias("segno"), "id")


def uncovered_runs(stanza: DataFrame, segments: DataFrame) -> DataFrame:
    """``stanza``, ``first``, ``last``: the runs from a chain's ``lo`` to ``hi`` that exist under none of its timelines (``tlis``)."""
    wanted = stanza.select("stanza", F.explode("tlis").alias("tli"), "lo", "hi")
    return difference(wanted, islands(segments.select("tli", "segno").distinct(), ["tli"], "segno"), ["stanza"], ["tli"])


def uncovered(stanza: DataFrame, segments: DataFrame) -> DataFrame:
    """The numbers of ``uncovered_runs``; rows are made for what is missing alone."""
    return uncovered_runs(stanza, segments).select("stanza", F.explode(F.sequence("first", "last")).alias("segno"))


def retention(sets: DataFrame, now: int, keep_full: int, days: int, pinned: DataFrame) -> DataFrame:
    """``stanza``, ``id``, ``verdict`` of every set: keep, expire, junk, orphan, pinned or wait.

    Counted are planned fulls; promoted ones only where there are no others. With ``days`` a full that
    started since the cutoff stays, and so does the newest one that had ended before it, which carries
    the cutoff. A set goes with its full (``base``). Unfinished sets are junk, those that only wait for
    their log after a week. Sets whose full is gone are orphans. Pinned sets stay for now.
    """
    cutoff = now - days * 86400
    full = F.col("type") == "full"
    fulls = sets.filter("status = 'COMPLETE' AND type = 'full'")
    whole = Window.partitionBy("stanza")
    newest = Window.partitionBy("stanza").orderBy(F.desc("started"), F.desc("id"))
    counted = fulls.withColumn("planned", F.max(~F.col("promoted")).over(whole)).withColumn("counts", ~F.col("promoted") | ~F.col("planned"))
    ranked = counted.withColumn("rank", F.sum(F.col("counts").cast("int")).over(newest)).withColumn("ended_before", F.col("ended") < cutoff)
    # The full that carries the cutoff is the last in order of those that had ended.
    spans = F.max(F.when(F.col("ended_before"), F.struct("started", "id"))).over(whole)
    after = (F.col("rank") > keep_full) | ((F.col("rank") == keep_full) & ~F.col("counts"))
    doomed = ranked.withColumn("spans", F.struct("started", "id") == spans).filter(after)
    if days:
        doomed = doomed.filter((F.col("started") < cutoff) & ~F.coalesce("spans", F.lit(False)))
    gone = doomed.select("stanza", F.col("id").alias("base"), F.lit(True).alias("doomed"))
    good = fulls.select("stanza", F.col("id").alias("base"), F.lit(True).alias("good"))
    out = sets.join(gone, ["stanza", "base"], "left").join(good, ["stanza", "base"], "left").join(pinned.select("id", F.lit(True).alias("pin")), "id", "left")
    young = (F.col("status") == "PENDING_WAL") & (F.lit(now) - F.col("started") < GRACE_DAYS * 86400)
    verdict = (
        F.when(F.col("doomed"), "expire").when(F.col("status").isin(JUNK), F.when(young, "wait").otherwise("junk")).when((F.col("status") == "COMPLETE") & ~full & F.col("good").isNull(), "orphan").otherwise("keep")
    )
    leaving = verdict.isin("expire", "junk", "orphan")
    return out.select("stanza", "id", F.when(leaving & F.coalesce("pin", F.lit(False)), "pinned").otherwise(verdict).alias("verdict"))


def log_floor(sets: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The lowest start position that kept and pinned sets of each stanza need."""
    kept = verdicts.filter("verdict IN ('keep', 'pinned')")
    return sets.filter("status = 'COMPLETE'").join(kept, ["stanza", "id"], "left_semi").groupBy("stanza").agg(F.min("started").alias("floor"))


def sibling_floors(floors: DataFrame) -> DataFrame:
    """For each stanza the lowest floor of the others of its system (J13): ``system``, ``stanza``, ``floor``."""
    low = floors.groupBy("system").agg(F.sort_array(F.collect_list(F.struct("floor", "stanza"))).alias("all")).select("system", F.col("all")[0].alias("a"), F.get("all", F.lit(1)).alias("b"))
    return floors.join(low, "system").select("system", "stanza", F.when(F.col("a.stanza") == F.col("stanza"), F.col("b.floor")).otherwise(F.col("a.floor")).alias("sibling_floor"))


def live_chunks(chunks: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct hashes that any of ``sets`` refers to."""
    return chunks.join(sets.select(F.col("id").alias("set_id")), "set_id", "left_semi").select("hash").distinct()


def pack_garbage(packs: DataFrame, live: DataFrame, now: int) -> DataFrame:
    """Dead chunks and bytes of every pack and what to do with it (G15, R9): keep, repack or delete."""
    marked = packs.join(live.select("hash", F.lit(True).alias("live")), "hash", "left")
    dead = F.col("live").isNull()
    each = marked.groupBy("pack").agg(F.count("*").alias("chunks"), F.count_if(dead).alias("dead_chunks"), F.sum("len").alias("bytes"), F.sum(F.when(dead, F.col("len")).otherwise(0)).alias("dead_bytes"), F.max("mtime").alias("mtime"))
    action = F.when(F.lit(now) - F.col("mtime") < YOUNG_HOURS * 3600, "keep").when(F.col("dead_chunks") == F.col("chunks"), "delete").when(F.col("dead_bytes") >= REPACK_SHARE * F.col("bytes"), "repack").otherwise("keep")
    return each.withColumn("action", action).drop("mtime")


def verify_report(sets: DataFrame, chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Files, missing and corrupt chunks of each set (G16, J10): ``index`` has ``hash`` and ``good``; a set without files has zeros."""
    seen = chunks.join(index, "hash", "left").groupBy(F.col("set_id").alias("id")).agg(F.countDistinct("rel").alias("files"), F.count_if(F.col("good").isNull()).alias("missing"), F.count_if(~F.col("good")).alias("corrupt"))
    out = sets.select("id").join(seen, "id", "left").fillna(0, ["files", "missing", "corrupt"])
    return out.withColumn("ok", (F.col("missing") == 0) & (F.col("corrupt") == 0))


def file_plan(files: DataFrame, parent: DataFrame, changed: DataFrame) -> DataFrame:
    """Per file of an incremental set: skip, partial (with its chunks) or full."""
    marks = changed.groupBy("rel").agg(F.sort_array(F.collect_set("chunk")).alias("chunks"))
    both = files.join(parent.select("rel", F.col("size").alias("old_size")), "rel", "left").join(marks, "rel", "left")
    plan = F.when(F.col("old_size").isNull(), "full").when(F.col("chunks").isNotNull(), "partial").when(F.col("old_size") == F.col("size"), "skip").otherwise("full")
    return both.select("rel", plan.alias("plan"), F.when(plan == "partial", F.array_join("chunks", ",")).alias("chunks"))


def blocks_to_chunks(blocks: DataFrame) -> DataFrame:
    """Changed blocks (``relfilenode``, ``block``, ``is_limit``) as chunks of file segments.

    A truncation marks every segment of its relation that any block names.
    """
    at = blocks.select("relfilenode", F.floor(F.col("block") / SEGMENT_PAGES).alias("part"), F.floor(F.col("block") % SEGMENT_PAGES / CHUNK_PAGES).alias("chunk"), "is_limit")
    each = at.groupBy("relfilenode", "part").agg(F.sort_array(F.collect_set("chunk")).alias("chunks"), F.max("is_limit").alias("limit"))
    cut_short = F.max("limit").over(Window.partitionBy("relfilenode"))
    return each.select("relfilenode", "part", F.array_join("chunks", ",").alias("chunks"), cut_short.alias("whole"))


def pages_to_keep(pages: DataFrame, parent_start: Column) -> DataFrame:
    """Chunks with a page that is zero, torn or not older than the parent's start, or of a new file."""
    keep = F.col("zero") | F.col("torn") | F.col("new_file") | (F.col("page_lsn") >= parent_start)
    return pages.groupBy("rel", "chunk").agg(F.count("*").alias("pages"), F.count_if(keep).alias("fresh"), F.coalesce(F.max(keep), F.lit(False)).alias("keep"))


def contradictions(pages: DataFrame, summarised: DataFrame, previous: Column, start: Column) -> DataFrame:
    """Pages changed between the previous and this start that no summary names."""
    return pages.filter((F.col("page_lsn") >= previous) & (F.col("page_lsn") < start)).join(summarised, ["rel", "block"], "left_anti")


def budgeted_sample(files: DataFrame, seed: int = 1, least_budget: int = 256 << 20, share: float = 0.01) -> DataFrame:
    """A seeded sample to check (X9): a hundredth of the files, 3 to 50 of them, the smallest first within the budget."""
    totals = files.agg(F.greatest(F.lit(3), F.least(F.lit(50), F.floor(F.count("*") / 100))).alias("k"), F.greatest(F.lit(least_budget), (F.sum("size") * share).cast("long")).alias("budget"))
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col("rel").cast("string")))
    drawn = files.withColumn("draw", draw).orderBy("draw", "rel").limit(50).withColumn("no", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("draw", "rel")))
    chosen = drawn.join(F.broadcast(totals)).filter("no <= k")
    before = F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("size", "rel").rowsBetween(Window.unboundedPreceding, 0))
    first = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("size", "rel"))
    return chosen.withColumns({"sum": before, "place": first}).filter("place = 1 OR sum <= budget").select("rel", "size")


def backup_type(requests: DataFrame) -> DataFrame:
    """The type that a requested backup gets (X12): an incremental one becomes full for the first reason that holds."""
    reason = (
        F.when(F.col("requested") == "full", None).when(~F.col("has_full"), "no full").when(F.col("base_checksums").isNotNull() & (F.col("checksums") != F.col("base_checksums")), "checksums changed")
        .when(F.col("base_segment").isNotNull() & (F.col("segment") != F.col("base_segment")), "segment size changed").when(F.col("timeline") < F.col("base_timeline"), "timeline").when(F.col("wal_missing") > 0, "log missing").when(F.col("new_tablespace"), "tablespace")
    )
    return requests.select("id", F.when(reason.isNotNull(), "full").otherwise(F.col("requested")).alias("type"), F.when(reason.isNotNull(), F.col("requested")).alias("promoted_from"), reason.alias("reason"))


def repository_stats(sets: DataFrame, now: int) -> DataFrame:
    """Per stanza: sets by status and type, bytes, newest full, oldest good, last failure and age."""
    good = F.col("status") == "COMPLETE"
    return sets.groupBy("stanza").agg(
        F.count("*").alias("sets"), F.count_if(good).alias("complete"), F.count_if(good & (F.col("type") == "full")).alias("fulls"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.sum(F.when(good, F.col("bytes"))).alias("bytes"),
        F.max_by("id", F.when(good & (F.col("type") == "full"), F.struct("started", "id"))).alias("last_full"), F.min(F.when(good, F.col("started"))).alias("oldest"), F.max(F.when(F.col("status") == "FAILED", F.col("started"))).alias("last_failure"),
        F.floor((F.lit(now) - F.max(F.when(good, F.col("started")))) / 3600).alias("age_hours"),
    )


def dedup_ratios(sets: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per stanza: logical bytes of its good sets, bytes stored (each chunk once), chunks, and their ratio to two places.

    ``chunks(set_id, hash, len)`` are what the sets refer to; a ratio without stored bytes is null.
    """
    good = sets.filter("status = 'COMPLETE'")
    logical = good.groupBy("stanza").agg(F.sum("bytes").alias("logical"))
    held = chunks.join(good.select(F.col("id").alias("set_id"), "stanza"), "set_id").groupBy("stanza", "hash").agg(F.max("len").alias("len"))
    stored = held.groupBy("stanza").agg(F.sum("len").alias("stored"), F.count("*").alias("chunks"))
    out = logical.join(stored, "stanza", "left").select("stanza", "logical", F.coalesce("stored", F.lit(0)).alias("stored"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
    return out.withColumn("ratio", F.when(F.col("stored") > 0, F.floor(F.col("logical") * 100 / F.col("stored") + 0.5) / 100))


def live_pins(pins: DataFrame, now: int) -> DataFrame:
    return pins.filter(F.col("until") > now)


def database_sets(catalogs: DataFrame) -> DataFrame:
    """Per database over all sets' catalogs (G13): the newest set's figures win."""
    top = catalogs.agg(F.max("set_no").alias("top"))
    each = catalogs.groupBy("db").agg(F.max_by("size", "set_no").alias("size"), F.count("*").alias("sets"), F.min("set_no").alias("first"), F.max("set_no").alias("last"))
    return each.join(F.broadcast(top)).select("db", "size", "sets", "first", "last", (F.col("last") == F.col("top")).alias("in_latest"))
