"""Graphs in edge tables: closures, levels and components, by rounds of joins that end by themselves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .steps import cut, shuffles_dropped

#: Roots that one row of a closure's level stands for: the bits of a long.
BLOCK = 64


def closure(edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """``root``, ``node``, ``depth`` of all nodes below each root (R3, R4, R5), or of those within ``depth``: a node counts once, at its least depth; cycles end.

    Roots are numbered in their order and walk in blocks: a row of a level is a node and the bits of those
    roots of a block that come to it there. Only the result has a row for each root, made where it is read.
    """
    with shuffles_dropped(edges.sparkSession):
        steps = cut(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct())
        number = F.monotonically_increasing_id()
        named = cut(roots.select("root").distinct().orderBy("root").select("root", F.floor(number / BLOCK).alias("block"), (number % BLOCK).cast("int").alias("bit")))
        # Each level is written once, and its shuffle files go then; all joins are merge joins, so that nothing is collected for a broadcast.
        levels_ = [cut(named.select("block", F.col("root").alias("node"), F.expr("shiftleft(1L, bit)").alias("bits")))]
        while depth is None or len(levels_) <= depth:
            following = levels_[-1].hint("merge").join(steps, "node").select("block", F.col("next").alias("node"), "bits", F.lit(0).cast("long").alias("seen"))
            earlier = reduce(DataFrame.unionByName, levels_).select("block", "node", F.lit(0).cast("long").alias("bits"), F.col("bits").alias("seen"))
            met = following.unionByName(earlier).groupBy("block", "node").agg(F.bit_or("bits").alias("bits"), F.bit_or("seen").alias("seen"))
            fresh = cut(met.select("block", "node", F.expr("bits & ~seen").alias("bits")).filter("bits <> 0"))
            if fresh.isEmpty():
                break
            levels_.append(fresh)
    # Few bytes here are many rows of the result: blocks are dealt out by number, which adaptive execution leaves alone.
    share = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = named.repartition(share, "block").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bit", "root"))).alias("own"))
    found = reduce(DataFrame.unionByName, [x.withColumn("depth", F.lit(n)) for n, x in enumerate(levels_)]).repartition(share, "block")
    return found.hint("merge").join(names, "block").select(F.explode(F.expr("filter(own, x -> (shiftright(bits, x.bit) & 1) = 1)")).alias("x"), "node", "depth").select("x.root", "node", "depth")


def tops(pointers: DataFrame) -> DataFrame:
    """``node``, ``top``: where following ``up`` ends (G4, G11, R4); pointers are doubled, a cycle has no top.

    Rounds end when no pointer has moved on, or when more steps were followed than there are nodes: what
    still moves then goes round a cycle.
    """
    now = cut(pointers.select("node", "up"))
    still = pointers.select(F.col("node").alias("up"))
    followed, most = 1, now.count()
    while followed <= most and not now.join(still, "up", "left_semi").isEmpty():
        followed *= 2
        step = now.select(F.col("node").alias("up"), F.col("up").alias("further"))
        now = cut(now.join(step, "up", "left").select("node", F.coalesce("further", "up").alias("up")))
    return now.join(still, "up", "left_anti").select("node", F.col("up").alias("top"))


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node``, ``level``: one more than the highest level it depends on, 0 without dependencies or on a cycle.

    What a round has placed is counted off the nodes that wait for it; those that wait for nothing more
    are next, and what is never placed hangs on a cycle.
    """
    steps = cut(edges.select("src", "dst"))
    waiting = cut(steps.filter("src IS NOT NULL").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("open"), F.lit(-1).alias("highest")))
    fresh = cut(nodes.select("node").distinct().join(waiting, "node", "left_anti").withColumn("level", F.lit(0)))
    placed = []
    while not fresh.isEmpty():
        placed.append(fresh)
        said = steps.join(fresh.select(F.col("node").alias("dst"), "level").hint("merge"), "dst").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("done"), F.max("level").alias("top"))
        told = cut(waiting.hint("merge").join(said, "node", "left").select("node", (F.col("open") - F.coalesce("done", F.lit(0))).alias("open"), F.greatest("highest", "top").alias("highest")))
        fresh, waiting = told.filter("open = 0").select("node", (F.col("highest") + 1).alias("level")), told.filter("open > 0")
    if not placed:
        return nodes.withColumn("level", F.lit(0))
    return nodes.hint("merge").join(reduce(DataFrame.unionByName, placed), "node", "left").fillna(0, ["level"])


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node`` and the least node ``root`` of its component.

    Each node takes the least label next to it and then its label's label, so that rounds grow with the
    logarithm of the longest path.
    """
    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct())
    label = cut(nodes.select("node", F.col("node").alias("root")).distinct())
    while True:
        near = both.join(label.withColumnsRenamed({"node": "dst"}), "dst").groupBy(F.col("src").alias("node")).agg(F.min("root").alias("least"))
        lower = label.join(near, "node", "left").select("node", "root", F.least("root", "least").alias("to"))
        jump = lower.select(F.col("node").alias("to"), F.col("to").alias("further"))
        after = cut(lower.join(jump, "to", "left").select("node", F.coalesce("further", "to").alias("next"), "root"))
        moved = after.filter("next <> root")
        if moved.isEmpty():
            return after.select("node", "root")
        label = after.select("node", F.col("next").alias("root"))
