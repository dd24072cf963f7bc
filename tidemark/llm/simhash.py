"""SimHash near duplicates, compared bit-sliced in blocks that share some of their bits.

Fingerprints that differ in at most ``RADIUS`` of 64 bits agree on at least ``BLOCKS - RADIUS`` of
``BLOCKS`` groups of bits, so each is dealt out once for every choice of that many groups. What meets
there is stored as bit planes: the differing bits of many fingerprints are counted at once by
carry-save counters, and a block is left as soon as all of it is beyond the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_bytes, materialise, slices, text_of

BITS, RADIUS, BLOCKS, SHINGLE = 64, 4, 6, 4
#: Fingerprints that are compared in one go; larger groups are dealt out as pairs of tiles.
TILE = 4096
#: Planes between two looks at whether a block can be left.
STRIDE = 8


def _blocks() -> list[tuple[int, int]]:
    """First bit and mask of each group of bits."""
    edges = [round(k * BITS / BLOCKS) for k in range(BLOCKS + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def fingerprint(words: list[bytes]) -> int:
    """Each bit as in over half of the shingles' hashes; 0 of no words."""
    if not words:
        return 0
    hashed = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + SHINGLE]), seed=42) for i in range(max(1, len(words) - SHINGLE + 1))), dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for part in np.array_split(hashed, 1 + len(hashed) // 65_536):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashed), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the signed 64-bit ``fp`` of every row; a null or empty text has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = np.array([fingerprint(x.lower().split()) for x in part.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return id_and_bytes(docs, doc_id, text).mapInArrow(run, "doc_id long, fp long")


def planes_of(values: np.ndarray) -> np.ndarray:
    """64 rows of bits, packed: bit j of word w in row b is bit b of value 64 w + j."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.ascontiguousarray(np.packbits(np.pad(bits, ((0, 0), (0, -len(values) % 64))), axis=1, bitorder="little")).view(np.uint64)


def within(queries: np.ndarray, values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``queries`` and ``values`` of all pairs at most ``radius`` (up to 6) bits apart."""
    planes = planes_of(values)
    alive = np.arange(len(queries))
    high = np.uint64(0xFFFFFFFFFFFFFFFF)
    over = np.zeros((len(queries), planes.shape[1]), np.uint64)
    tail = len(values) % 64
    if tail:
        over[:, -1] = high << np.uint64(tail)
    c0, c1, c2 = (np.zeros_like(over) for _ in range(3))
    for b in range(BITS):
        flip = np.where((queries[alive] >> np.uint64(b)) & np.uint64(1), high, np.uint64(0))
        c0, c1, c2, beyond = _counted(c0, c1, c2, planes[b] ^ flip[:, None], radius)
        over |= beyond
        if b % STRIDE == STRIDE - 1:
            left = (~over).any(axis=1)
            if not left.all():
                alive, over, c0, c1, c2 = (x[left] for x in (alive, over, c0, c1, c2))
            if not len(alive):
                break
    if not len(alive):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    q, v = np.nonzero(np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little"))
    return alive[q], v


def near(x: np.ndarray, y: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Whether each of ``x`` is at most ``radius`` (up to 6) bits from the one of ``y`` in its place.

    Many short pairs are counted like one long block, by the bit planes of their differences.
    """
    planes = planes_of(x ^ y)
    alive = np.arange(planes.shape[1])
    over = np.zeros(len(alive), np.uint64)
    left = over.copy()
    c0, c1, c2 = (over.copy() for _ in range(3))
    for b in range(BITS):
        c0, c1, c2, beyond = _counted(c0, c1, c2, planes[b, alive], radius)
        left |= beyond
        if b % STRIDE == STRIDE - 1:
            over[alive] = left
            stay = ~left != 0
            alive, left, c0, c1, c2 = (v[stay] for v in (alive, left, c0, c1, c2))
            if not len(alive):
                break
    return np.unpackbits((~over).view(np.uint8), bitorder="little")[: len(x)].astype(bool)


def _counted(c0: np.ndarray, c1: np.ndarray, c2: np.ndarray, carry: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The three-bit counts after ``carry`` is added, and where they are above the radius or have overflowed."""
    c0, carry = c0 ^ carry, c0 & carry
    c1, carry = c1 ^ carry, c1 & carry
    c2, carry = c2 ^ carry, c2 & carry
    for n in range(radius + 1, 8):
        carry = carry | (c0 if n & 1 else ~c0) & (c1 if n & 2 else ~c1) & (c2 if n & 4 else ~c2)
    return c0, c1, c2, carry


def forest(a: np.ndarray, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect what is linked within ``a``, or between ``a`` and ``b``: each value with the first of its set."""
    nodes = a if b is None else np.concatenate([a, b])
    root = np.arange(len(nodes))
    step = 512
    for start in range(0, len(a), step):
        other, shift = (a[start:], start) if b is None else (b, len(a))
        q, v = within(a[start : start + step], other)
        q, v = q + start, v + shift
        while len(q):
            x, y = root[q], root[v]
            apart = x != y
            if not apart.any():
                break
            q, v, x, y = q[apart], v[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                shorter = root[root]
                if (shorter == root).all():
                    break
                root = shorter
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def links(distinct: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of fingerprints that connect all that are within the radius, directly or by others.

    ``distinct`` has each ``fp`` once. Every group of equal bits gives a spanning forest of its links.
    A group of over ``TILE`` is dealt out as pairs of tiles, so that no task holds it whole.
    """
    fp = F.col("fp")
    cuts = _blocks()
    keys = []
    for k, chosen in enumerate(combinations(range(BLOCKS), BLOCKS - RADIUS)):
        mask = sum(cuts[i][1] << cuts[i][0] for i in chosen)
        keys.append(F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))))
    dealt = distinct.select(fp, F.explode(F.array(*keys)).alias("key"))
    sizes = dealt.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = dealt.join(sizes, "key")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    tile = F.pmod(F.xxhash64(fp, F.lit(7)), tiles).cast("int")
    # Each tile meets each other one, and itself, once.
    spread = met.select("fp", "key", tile.alias("t"), F.explode(F.when(tiles > 1, F.sequence(F.lit(0), tiles - 1)).otherwise(F.array(F.lit(0)))).alias("u"))
    spread = spread.select("fp", "key", "t", F.least("t", "u").alias("lo"), F.greatest("t", "u").alias("hi"))
    groups = spread.withColumn("bucket", F.xxhash64("key", "lo", "hi"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = pdf["bucket"].iloc[-1]
            cut = int(np.searchsorted(pdf["bucket"].to_numpy(), last))
            rest, pdf = pdf.iloc[cut:], pdf.iloc[:cut]
            if len(pdf):
                yield linked(pdf)
        if rest is not None and len(rest):
            yield linked(rest)

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = pdf["bucket"].to_numpy()
        values, first = pdf["fp"].to_numpy().view(np.uint64), pdf["t"].to_numpy() == pdf["lo"].to_numpy()
        same = (pdf["lo"] == pdf["hi"]).to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        sizes = np.diff(edges)
        out = []
        two = edges[:-1][sizes == 2]
        if len(two):  # most groups are just one pair; all of them are counted at once
            x, y = values[two], values[two + 1]
            close = near(x, y)
            out.append((x[close], y[close]))
        for a, b in zip(edges[:-1][sizes > 2], edges[1:][sizes > 2], strict=True):
            v, f = values[a:b], first[a:b]
            out.append(forest(v, None) if same[a] else forest(v[f], v[~f]))
        a, b = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.uint64) for k in (0, 1))
        return pd.DataFrame({"a": np.maximum(a.view(np.int64), b.view(np.int64)), "b": np.minimum(a.view(np.int64), b.view(np.int64))})

    return groups.repartition("bucket").sortWithinPartitions("bucket").select("fp", "t", "lo", "hi", "bucket").mapInPandas(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and the smallest node ``root`` it is connected with, of ``edges`` (``a``, ``b``) with a != b.

    Large-star and small-star rounds: every node hands its neighbours to the smallest one it knows,
    until nothing changes; the number of rounds grows with the logarithm of the longest path.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a != b").distinct()
        after = materialise(small, "edges")
        # A fixed point is a set of stars: no node hangs on two, or on one that hangs on another.
        edges = after
        hung = after.groupBy("a").agg(F.count("*").alias("n"))
        centres = after.select(F.col("b").alias("a")).distinct().withColumn("centre", F.lit(True))
        if hung.join(centres, "a", "left").filter("n > 1 OR centre").isEmpty():
            break
    return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")


def _roots(distinct: DataFrame) -> DataFrame:
    """``fp`` and the ``root`` of its class for each row of ``distinct``."""
    found = components(links(distinct.select("fp")).filter("a != b"))
    return distinct.join(found, distinct["fp"] == found["node"], "left").select(*distinct.columns, F.coalesce("root", "fp").alias("root"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every row of ``docs``.

    ``component_id`` is the smallest id that is reached over links of at most ``RADIUS`` differing
    bits, itself included. Texts without words have fingerprint 0 and are linked like any other;
    equal texts share a fingerprint and are never paired. A null id takes no part in the smallest.
    """
    held = materialise(fingerprints(docs, doc_id, text), "fingerprints")
    member = _roots(materialise(held.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct"))
    lowest = member.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = materialise(member.join(lowest, "root").select("fp", "component_id"), "classes")
    return held.join(linked, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class of ``docs``, with the columns it came with: the one with the smallest id.

    A null id counts as the largest; of rows that share the smallest id one stays, whatever their other
    columns are. Rows are told apart by a number they get when they are written, not by their ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = np.array([fingerprint(x.lower().split()) for x in part.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], names=["row", "fp"])

    rows = docs.select(F.struct("*").alias("row"), text_of(docs, text).cast("binary").alias("text"))
    held = rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("fp", T.LongType())])).withColumn("n", F.monotonically_increasing_id())
    held = materialise(held, "printed")
    place = F.struct(F.col("row")[doc_id].cast("long").isNull().alias("none"), F.col("row")[doc_id].cast("long").alias("id"), "n")
    each = materialise(held.groupBy("fp").agg(F.min(place).alias("first"), F.count("*").alias("many")), "distinct")
    member = _roots(each)
    best = member.groupBy("root").agg(F.min("first").alias("first"), F.sum("many").alias("many")).filter("many > 1").select("root", "first.n")
    copies = materialise(member.join(best, "root").select("fp", "n"), "classes")  # of classes with more rows than one
    gone = held.select("fp", F.col("n").alias("own")).join(copies, "fp").filter("own <> n").select("own")
    stay = held.join(gone, held["n"] == gone["own"], "left_anti")
    return stay.select(*[F.col("row")[c].alias(c) for c in docs.columns])
