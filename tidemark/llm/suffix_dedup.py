"""Long repeated byte strings by run-length compressed Burrows-Wheeler transforms.

Anchors bring together the regions of text that may hold equal strings. The regions that share anchors
form blocks of bounded size; for each block a Burrows-Wheeler transform is built and kept as runs, with
the lengths of common prefixes sampled at the two ends of each. Streaming along the text, every other
position's matching statistic follows from the last sample before it, and windows whose statistic
reaches the width are marked. Equal regions are sorted once and lengthen their runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import BASES, Chosen, Prefix, anchors, byte_hashes, covered, identified, with_lists
from .common import Scratch, flat, materialise, slices

#: Bytes of a window, and of the strings that anchors are chosen from.
WIDTH, GRAM = 200, 32
#: Bytes of regions in one transform.
BLOCK = 1 << 18
#: Different regions of one anchor that a block takes; those of an anchor with more are dealt out as single windows.
MOST_REGIONS = 2048
#: Symbols in one packed number: nine bits each, 0 stands for the end of a region.
PACK = 7


def _units(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat(col)
    return byte_hashes(data), offsets


class Suffixes:
    """The suffixes of some regions, each up to the end of its region; held only while an index is built."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n, sizes = len(data), np.diff(offsets)
        self.n, self.end = n, np.repeat(offsets[1:], sizes)
        packed = np.zeros(n, np.uint64)
        for j in range(PACK):
            inside = np.arange(j, n + j) < self.end
            symbol = np.zeros(n, np.uint64)
            symbol[: n - j] = data[j:].astype(np.uint64) + np.uint64(1)
            packed = packed << np.uint64(9) | np.where(inside, symbol, np.uint64(0))
        self.packed = packed
        self.order = self._order(int(sizes.max(initial=0)))

    def _order(self, longest: int) -> np.ndarray:
        """Suffixes in order, each up to the end of its region; equal ones by their place.

        Ranks by ever longer prefixes: only suffixes that share theirs with another are sorted again.
        """
        order = np.argsort(self.packed)
        at = np.arange(self.n)  # the slots of ``order`` whose suffixes are not told apart yet
        key, reach = self.packed[order], PACK
        rank = np.empty(self.n, np.int64)  # the first slot of the suffix's group
        while True:
            new = np.concatenate([[True], key[1:] != key[:-1]])
            rank[order[at]] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            apart = new & np.concatenate([new[1:], [True]])
            if apart.all() or reach >= longest:
                break
            at = at[~apart]
            suffix = order[at]
            follow = suffix + reach
            second = np.where(follow < self.end[suffix], rank[np.minimum(follow, self.n - 1)] + 1, 0)
            key = (rank[suffix].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
            by = np.argsort(key)
            order[at], key = suffix[by], key[by]
            reach *= 2
        tied = at[~apart]
        suffix = order[tied]
        order[tied] = suffix[np.argsort((rank[suffix].astype(np.uint64) << np.uint64(32)) | suffix.astype(np.uint64))]
        return order

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at ``p`` and ``q``, each up to its region's end."""
        most = np.minimum(self.end[p] - p, self.end[q] - q)
        length = np.zeros(len(p), np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):
            a, b = self.packed[p[live] + length[live]], self.packed[q[live] + length[live]]
            differ = a ^ b
            same = differ == 0
            # The highest bit that differs tells how many of the packed symbols are equal.
            top = np.zeros(len(live), np.int64)
            top[~same] = np.floor(np.log2((differ[~same] >> np.uint64(9 * PACK - 63)).astype(np.float64) * (1 + 2**-52))).astype(np.int64) if (~same).any() else 0
            equal = np.where(same, PACK, (9 * PACK - 1 - top) // 9)
            length[live] += equal
            live = live[same & (length[live] < most[live])]
        return np.minimum(length, most)


class RunLengthIndex:
    """The transform of some regions as runs: their letters, their lengths and samples at their two ends.

    A region that stands ``copies`` times is sorted once; each of its suffixes counts so often in the
    length of its run. ``place`` and ``common`` are the samples, ordered by place: a suffix at a run's end
    and the length of its longest prefix that stands next to it in the order, on either side (its own copy
    stands there too). All that was needed to sort is gone; what is left grows with the runs.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, copies: np.ndarray | None = None):
        sizes = np.diff(offsets)
        suffixes = Suffixes(data, offsets)
        order, n = suffixes.order, len(data)
        weight = np.repeat(np.ones(len(sizes), np.int64) if copies is None else np.asarray(copies, np.int64), sizes)
        before = np.concatenate([data[-1:], data[:-1]]).astype(np.int16)
        before[offsets[:-1][sizes > 0]] = -1  # a region's start has no letter before it and ends every run
        letter = before[order]
        heads = np.concatenate([[True], (letter[1:] != letter[:-1]) | (letter[1:] < 0)])[:n]
        first = np.flatnonzero(heads)
        self.n, self.letters = n, letter[first]
        self.lengths = np.add.reduceat(weight[order], first) if n else np.zeros(0, np.int64)
        last = np.append(first[1:], n) - 1 if n else first
        self.place, self.common = [], []
        for ends, step in ((first, -1), (last, 1)):
            at, near = order[ends], ends + step
            has = (near >= 0) & (near < n)
            common = np.zeros(len(ends), np.int64)
            common[has] = suffixes.common(at[has], order[near[has]])
            common = np.where(weight[at] > 1, suffixes.end[at] - at, common)
            by = np.argsort(at)
            self.place.append(at[by])
            self.common.append(common[by])

    def repeats(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last place of each run of places whose matching statistic reaches ``width``.

        Along the text, a statistic falls by one from place to place until the next sample; a sample so says
        how far the places after it reach.
        """
        starts, stops = [], []
        for place, common in zip(self.place, self.common, strict=True):
            until = np.append(place[1:], self.n) - 1
            long = common >= width
            starts.append(place[long])
            stops.append(np.minimum(place[long] + common[long] - width, until[long]))
        start, stop = np.concatenate(starts), np.concatenate(stops)
        by = np.argsort(start, kind="stable")
        start, reach = start[by], np.maximum.accumulate(stop[by])
        new = np.concatenate([[True], start[1:] > reach[:-1] + 1])[: len(start)]
        return start[new], reach[np.append(np.flatnonzero(new)[1:], len(start)) - 1] if len(start) else reach

    def statistics(self) -> np.ndarray:
        """For each place the longest prefix of its suffix that starts somewhere else too."""
        out = np.zeros(self.n, np.int64)
        for place, common in zip(self.place, self.common, strict=True):
            last = np.searchsorted(place, np.arange(self.n), "right") - 1
            out = np.maximum(out, common[last] - (np.arange(self.n) - place[last]))
        return out


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``key``, ``ctx``, ``n``, ``region`` sorted by ``key``: repeated windows ``a`` to ``b`` of each region."""
    held: list[pa.RecordBatch] = []
    size = 0

    def settle(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        data, offsets = flat(table.column(3))
        starts, stops = RunLengthIndex(data, offsets, np.asarray(table.column(2))).repeats(WIDTH)
        row = np.searchsorted(offsets, starts, "right") - 1
        which = pa.array(row)
        return pa.RecordBatch.from_arrays([table.column(0).take(which), table.column(1).take(which), pa.array((starts - offsets[row]).astype(np.int32)), pa.array((stops - offsets[row]).astype(np.int32))], names=["key", "ctx", "a", "b"])

    for batch in batches:
        keys = np.asarray(batch.column(0))
        for at, stop in _by_key(keys):
            part = batch.slice(at, stop - at)
            if held and size >= BLOCK and held[-1].column(0)[-1].as_py() != keys[at]:
                yield settle(held)
                held, size = [], 0
            held.append(part)
            data, _ = flat(part.column(3))
            size += len(data)
    if held:
        yield settle(held)


def _by_key(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of a sorted batch at changes of the key, some hundred rows each or one key."""
    edges = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
    at = 0
    while at < len(keys):
        stop = int(edges[min(len(edges) - 1, np.searchsorted(edges, at + 512))])
        yield at, stop
        at = stop


def _marked(regions: DataFrame) -> DataFrame:
    return regions.select("key", "ctx", "n", "region").repartition("key").sortWithinPartitions("key").mapInArrow(_marks, "key long, ctx long, a int, b int")


def _regions(asked: DataFrame) -> DataFrame:
    """The bytes of every asked run of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2 << 20):
            runs = Chosen(part, WIDTH, GRAM, _units)
            texts = part.column(2).to_pylist()
            first = runs.first()
            cut = [texts[r][a : b + WIDTH] for r, a, b in zip(*(x[first].tolist() for x in (runs.row, runs.lo, runs.hi)), strict=True)]
            names = [runs.asked.field(k).take(pa.array(runs.ask[first])) for k in range(4)]
            for at in range(0, len(cut), 4096):
                yield pa.RecordBatch.from_arrays([*[x.slice(at, 4096) for x in names], pa.array(cut[at : at + 4096], pa.binary())], names=["key", "ctx", "n", "hot", "region"])

    return asked.select("doc", "th", "text", "ask").mapInArrow(run, "key long, ctx long, n long, hot boolean, region binary")


def _windows(regions: DataFrame) -> DataFrame:
    """Two hashes (``w1``, ``w2``) of every window of the regions, with its place ``a`` there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1 << 19, "region"):
            data, offsets = flat(part.column(3))
            hashed, many = byte_hashes(data), np.maximum(np.diff(offsets) - WIDTH + 1, 0)
            row = np.repeat(np.arange(len(many)), many)
            place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            at, which = offsets[row] + place, pa.array(row)
            w1, w2 = (Prefix(hashed, b).of(at, at + WIDTH) for b in (BASES[1], BASES[2]))
            yield pa.RecordBatch.from_arrays([*[part.column(k).take(which) for k in range(3)], pa.array(place.astype(np.int32)), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64))], names=["key", "ctx", "n", "a", "w1", "w2"])

    return regions.select("key", "ctx", "n", "region").mapInArrow(run, "key long, ctx long, n long, a int, w1 long, w2 long")


def _crowded(regions: DataFrame, scratch: Scratch) -> DataFrame:
    """``_marked`` of the regions of anchors that have very many.

    They are dealt out as windows, so that no block has more of one anchor than fit; a window that meets
    another goes through the transform as a region of its own.
    """
    held = materialise(_windows(regions), "windows", scratch=scratch)
    twice = held.groupBy("w1", "w2").agg(F.min(F.struct("key", "ctx", "a")).alias("x"), F.sum("n").alias("n")).filter("n > 1").select("w1", "w2", "n", "x.*")
    cut = twice.join(regions.select("key", "ctx", "region"), ["key", "ctx"]).select(F.col("w1").alias("key"), F.col("w2").alias("ctx"), "n", F.substr("region", F.col("a") + 1, F.lit(WIDTH)).alias("region"))
    marks = _marked(cut).select(F.col("key").alias("w1"), F.col("ctx").alias("w2"))
    return held.join(marks, ["w1", "w2"]).select("key", "ctx", "a", F.col("a").alias("b"))


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The ``identified`` rows of ``docs``, and the runs (``doc``, ``th``, ``lo``, ``hi``) of windows that start elsewhere too."""
    source = identified(docs, doc_id, text)
    with Scratch(docs.sparkSession) as scratch:
        own = anchors(source, WIDTH, GRAM, _units).select("doc", "th", "key", "ctx", "lo")
        own = materialise(own, "anchors", scratch=scratch)
        each = own.groupBy("key", "ctx").agg(F.min("doc").alias("doc"), F.min_by("th", "doc").alias("th"), F.count("*").alias("n"))
        of_key = each.groupBy("key").agg(F.sum("n").alias("all"), (F.count("*") > MOST_REGIONS).alias("hot")).filter("all > 1").select("key", "hot")
        shared = materialise(each.join(of_key, "key"), "shared", scratch=scratch)
        asked = with_lists(source, shared.select("doc", "th", "key", "ctx", "n", "hot"), "ask", "inner")
        regions = materialise(_regions(asked), "regions", scratch=scratch)  # so that the texts' shuffle is gone before theirs
        marks, hot = _marked(regions.filter("NOT hot")), regions.filter("hot")
        if not hot.isEmpty():
            marks = marks.unionByName(_crowded(hot, scratch))
        marks = materialise(marks, "marks", scratch=scratch)
        found = own.join(marks, ["key", "ctx"]).select("doc", "th", (F.col("lo") + F.col("a")).alias("lo"), (F.col("lo") + F.col("b")).alias("hi"))
        return source, materialise(found, "repeated")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``spans`` (removed runs, first byte and end) and ``kept`` of every row.

    A byte goes if a string of ``WIDTH`` bytes that covers it also starts anywhere else, in the same
    document or another; no string crosses documents. Rows with equal id and text are copies of each
    other and go; a null or empty text and one of fewer bytes stays.
    """
    source, found = removals(docs, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2 << 20):
            removed, cuts, kept = [], [], []
            for raw, spans in zip(part.column(1).to_pylist(), part.column(2), strict=True):
                if spans.is_valid and len(spans):
                    lo, hi = (np.asarray(spans.values.field(j), dtype=np.int64) for j in (0, 1))
                    gone = covered(lo, hi + WIDTH, len(raw))
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    starts, stops = edge[::2].tolist(), edge[1::2].tolist()
                    kept.append(b"".join([raw[a:b] for a, b in zip([0, *stops], [*starts, len(raw)], strict=True)]))
                    cuts.append([{"first": a, "end": b} for a, b in zip(starts, stops, strict=True)])
                    removed.append(int(gone.sum()))
                else:
                    kept.append(raw)
                    cuts.append([])
                    removed.append(0)
            n = pa.array([len(x) for x in part.column(1).to_pylist()], pa.int64())
            spans = pa.array(cuts, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([part.column(0), n, pa.array(removed, pa.int64()), spans, pa.array(kept, pa.binary())], names=["doc", "n_bytes", "n_removed", "spans", "kept"])

    rows = with_lists(source, found, "spans", "left").select("doc", "text", "spans")
    out = rows.mapInArrow(run, "doc long, n_bytes long, n_removed long, spans array<struct<first:long,end:long>>, kept binary")
    return out.select(F.when(F.col("doc") < (1 << 63) - 1, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "spans", "kept")


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
