"""Joins on order without pairing: the last value before an instant, and what intervals leave of others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers that one bucket of an interval difference holds.
BUCKET = 1024


def as_of(asked: DataFrame, known: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``asked`` with ``value``: the greatest one of its keys in ``known`` whose ``when`` is not later.

    Both sides are cut into buckets of ``width`` along ``when``. Within a bucket they are sorted together;
    each bucket's greatest value is carried on into the later ones. So a key with most of the rows is
    spread over its buckets, and only one row of each bucket meets the others of its key.
    """
    extra = [c for c in asked.columns if c not in (*keys, "when")]
    kind = known.schema["value"].dataType.simpleString()
    ready = known.select(*keys, "when", "value", F.lit(0).alias("__side"), F.lit(None).cast(asked.select(F.struct(*extra)).schema[0].dataType if extra else "int").alias("__row"))
    wanted = asked.select(*keys, "when", F.lit(None).cast(kind).alias("value"), F.lit(1).alias("__side"), (F.struct(*extra) if extra else F.lit(None).cast("int")).alias("__row"))
    both = ready.unionByName(wanted).withColumn("__bucket", F.floor(F.col("when") / width))
    inside = Window.partitionBy(*keys, "__bucket").orderBy("when", "__side").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy(*keys, "__bucket").agg(F.max("value").alias("__top")).select(*keys, "__bucket", F.max("__top").over(before).alias("__carried"))
    found = both.withColumn("value", F.max("value").over(inside)).filter("__side = 1").join(carried, [*keys, "__bucket"])
    rows = [F.col("__row")[c].alias(c) for c in extra]
    return found.select(*keys, "when", *rows, F.greatest("value", "__carried").alias("value"))


def difference(wanted: DataFrame, held: DataFrame, ids: list[str], match: list[str], bucket: int = BUCKET) -> DataFrame:
    """``ids``, ``first``, ``last``: the runs of numbers from ``lo`` to ``hi`` that no run of ``held`` has.

    ``wanted(ids, match, lo, hi)`` may have several rows of one id, which then want the same numbers under
    any of their ``match``; ``held(match, first, last)``. Both are cut at bucket edges. Ids that want the same
    numbers of a bucket under the same matches share their holes, which are looked for once: a bucket has no
    more stretches than pairs of its numbers, however many ids want them. Holes are told by the ends of what is
    held, so there is never a row for each number. Only holes at bucket edges meet again.
    """
    edges = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket)))
    cut = lambda a, b: (F.greatest(F.col(a), F.col("__bucket") * bucket), F.least(F.col(b), F.col("__bucket") * bucket + (bucket - 1)))
    w = wanted.filter("lo <= hi").withColumn("__bucket", edges("lo", "hi"))
    a, b = cut("lo", "hi")
    w = w.select(*ids, F.struct(*match).alias("__match"), "__bucket", a.alias("__a"), b.alias("__b"))
    own = [*ids, "__bucket", "__a", "__b"]
    if set(match) <= set(ids):  # one match for each id
        w = w.select(*own, F.array("__match").alias("__any")).distinct()
    else:
        w = w.groupBy(*own).agg(F.sort_array(F.collect_set("__match")).alias("__any"))
    h = held.withColumn("__bucket", edges("first", "last"))
    a, b = cut("first", "last")
    h = h.select(F.struct(*match).alias("__match"), "__bucket", a.alias("__from"), b.alias("__to"))
    same = ["__any", "__bucket", "__a", "__b"]
    stretches = w.select(*same).distinct()
    met = stretches.withColumn("__match", F.explode("__any")).join(h, ["__match", "__bucket"], "left")
    # What does not meet the wanted stretch says nothing, but keeps the stretch itself.
    apart = (F.col("__to") < F.col("__a")) | (F.col("__from") > F.col("__b"))
    met = met.select(*same, F.when(~apart, F.col("__from")).alias("__from"), F.when(~apart, F.col("__to")).alias("__to")).distinct()
    along = Window.partitionBy(*same).orderBy(F.col("__from").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    inner = met.select(*same, F.coalesce(F.max("__to").over(along) + 1, F.col("__a")).alias("first"), (F.col("__from") - 1).alias("last"))
    tail = met.groupBy(*same).agg(F.max("__to").alias("__to")).select(*same, F.coalesce(F.col("__to") + 1, F.col("__a")).alias("first"), F.col("__b").alias("last"))
    holes = w.join(inner.unionByName(tail).filter("first <= last"), same).select(*ids, "first", "last")
    at_edge = (F.pmod("first", F.lit(bucket)) == 0) | (F.pmod("last", F.lit(bucket)) == bucket - 1)
    order = Window.partitionBy(*ids).orderBy("first")
    new = F.coalesce(F.col("first") != F.lag("last").over(order) + 1, F.lit(True)).cast("int")
    joined = holes.filter(at_edge).withColumn("__new", new).withColumn("__run", F.sum("__new").over(order)).groupBy(*ids, "__run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return holes.filter(~at_edge).unionByName(joined.select(*ids, "first", "last"))
