"""Sampled fingerprints of all windows of a fixed width, over words or over bytes.

A window of ``width`` units is known by its anchor: of the ``gram``-unit strings inside it the one with
the least hash, the leftmost on a tie. Equal windows have equal anchors at the same place inside them,
and neighbouring windows mostly share one, so that few rows stand for all windows. A row is an anchor
with the run of windows it stands for: its hash (``key``), a digest of all that the run covers and of
where the anchor stands in it (``ctx``), and the first and last window start (``lo``, ``hi``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, slices, text_of

#: Units that are hashed in one go; longer texts are taken in pieces that overlap by a window.
PIECE = 1 << 21
#: Odd multipliers of the polynomial hashes, modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
IDENTITY = "doc long, th long"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in SPACES]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASES[1]))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of a base and of its inverse."""
    held = _powers.get(base)
    if held is None or len(held[0]) <= n:
        size = max(n + 1, 1 << 16)
        held = tuple(np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size, b, np.uint64))]) for b in (base, pow(base, -1, 1 << 64)))
        if n <= 2 * PIECE:
            _powers[base] = held
    return held


class Prefix:
    """Hashes of any runs of units from prefix sums."""

    def __init__(self, units: np.ndarray, base: int):
        self.up, self.down = powers(base, len(units))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(units * self.up[: len(units)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def rolling(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each row with the total at the end."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    rows = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[rows] = inside[rows]
    last[rows[rows > 0] - 1] = inside[rows[rows > 0] - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a sum of numbers drawn for each byte at its place."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    begin = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(begin[-1], dtype=np.int64) - np.repeat(begin[:-1], size)
    drawn = mix((data[place + np.repeat(starts, size)].astype(np.uint64) | (place.astype(np.uint64) << np.uint64(8))) * np.uint64(BASES[0]))
    return mix(np.add.reduceat(drawn, begin[:-1]) + size.astype(np.uint64))


def byte_hashes(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def _sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    size = 1
    n = len(v) - width + 1
    while 2 * size <= width:
        v = np.minimum(v[: len(v) - size], v[size:])
        size *= 2
    return np.minimum(v[:n], v[width - size : width - size + n]) if size < width else v[:n]


def runs(units: np.ndarray, bounds: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, key, ctx, first and last window start (in units, from the row's start) of each anchor's run.

    ``bounds``: first unit of each row in ``units``, with the total at the end.
    """
    n = len(units)
    if n < width:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    grams = Prefix(units, BASES[0]).rolling(gram)
    bits = np.uint64(max(1, int(n).bit_length()))
    low = np.uint64((1 << int(bits)) - 1)
    least = _sliding_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), width - gram + 1)
    anchor = (least & low).astype(np.int64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(anchor)]
    whole = np.arange(len(anchor)) + width <= bounds[1:][row]
    starts = np.flatnonzero(whole)
    if not len(starts):
        return runs(units[:0], bounds * 0, width, gram)
    at, row = anchor[starts], row[starts]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])])
    lo, hi = starts[new], starts[np.concatenate([new[1:], [True]])]
    at, row = at[new], row[new]
    ctx = Prefix(units, BASES[1]).of(lo, hi + width)
    ctx = mix(ctx ^ mix((at - lo).astype(np.uint64) << np.uint64(32) | (hi - lo).astype(np.uint64)))
    return row, grams[at], ctx, lo - bounds[row], hi - bounds[row]


def pieces(units: np.ndarray, bounds: np.ndarray, width: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``runs`` of whole rows together up to ``PIECE`` units, and of longer rows piece by piece."""
    row = 0
    while row < len(bounds) - 1:
        stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + PIECE, side="right")) - 1)
        base, end = int(bounds[row]), int(bounds[stop])
        if end - base <= 2 * PIECE:
            r, *rest = runs(units[base:end], bounds[row : stop + 1] - base, width, gram)
            yield (r + row, *rest)
        else:  # one long row; each window is in the piece where it starts
            for a in range(0, end - base - width + 1, PIECE):
                b = min(end - base, a + PIECE + width - 1)
                r, key, ctx, lo, hi = runs(units[base + a : base + b], np.array([0, b - a]), width, gram)
                yield (r + row, key, ctx, lo + a, hi + a)
        row = stop


def identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc`` and ``th`` (what a row is known by), and the text's bytes.

    A null id counts as the largest; ``th``, a hash of the text, tells rows of equal ids apart.
    """
    body = text_of(docs, text)
    return docs.select(F.coalesce(docs[doc_id].cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(body).alias("th"), body.cast("binary").alias("text"))


def _all_runs(col: pa.Array, width: int, gram: int, units) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    hashed, bounds = units(col)
    parts = list(pieces(hashed, bounds, width, gram)) or [runs(hashed[:0], bounds * 0, width, gram)]
    return hashed, bounds, tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _name(row: np.ndarray, key: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    return mix(key ^ mix(ctx ^ mix(row.astype(np.uint64) + np.uint64(1))))


def anchors(source: DataFrame, width: int, gram: int, units) -> DataFrame:
    """``doc``, ``th``, ``key``, ``ctx``, ``lo``, ``hi`` of all runs of the texts of ``identified`` rows.

    ``units`` gives the unit hashes and row bounds of a column of bytes. ``again``: whether the same run
    stands earlier in the same text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2 << 20):
            _, _, (row, key, ctx, lo, hi) = _all_runs(part.column(2), width, gram, units)
            again = np.ones(len(row), bool)
            again[np.unique(_name(row, key, ctx), return_index=True)[1]] = False
            which = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(which), part.column(1).take(which), pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(again)],
                names=["doc", "th", "key", "ctx", "lo", "hi", "again"],
            )

    return source.select("doc", "th", "text").mapInArrow(run, f"{IDENTITY}, key long, ctx long, lo int, hi int, again boolean")


class Chosen:
    """Of the texts of a batch (``doc``, ``th``, ``text``, ``ask``: array of structs that begin with ``key`` and ``ctx``) the runs that are asked for."""

    def __init__(self, part: pa.RecordBatch, width: int, gram: int, units):
        self.hashed, self.bounds, found = _all_runs(part.column(2), width, gram, units)
        asks = pa.concat_arrays([part.column(3)])
        self.asked = asks.flatten()
        row = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(asks.offsets)))
        key, ctx = (np.asarray(self.asked.field(k), dtype=np.int64).view(np.uint64) for k in (0, 1))
        wanted, have = _name(row, key, ctx), _name(*found[:3])
        order = np.argsort(wanted)
        near = order[np.minimum(np.searchsorted(wanted[order], have), len(wanted) - 1)] if len(wanted) else np.zeros(len(have), np.int64)
        hit = np.flatnonzero(wanted[near] == have) if len(wanted) else np.zeros(0, np.int64)
        self.row, self.lo, self.hi = (found[k][hit] for k in (0, 3, 4))
        self.ask = near[hit]

    def first(self) -> np.ndarray:
        """The place of the first run of each ask."""
        return np.unique(self.ask, return_index=True)[1]


def windows(asked: DataFrame, width: int, gram: int, units) -> DataFrame:
    """Two hashes of every window in the asked runs with its place; ``again``: whether it stands earlier among those of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2 << 20):
            runs_ = Chosen(part, width, gram, units)
            many = runs_.hi - runs_.lo + 1
            start = np.repeat(runs_.lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(many) else np.zeros(0, np.int64)
            row = np.repeat(runs_.row, many)
            order = np.lexsort((start, row))
            row, start = row[order], start[order]
            at = runs_.bounds[row] + start
            w1, w2 = (Prefix(runs_.hashed, b).of(at, at + width) for b in (BASES[1], BASES[2]))
            again = np.ones(len(row), bool)
            again[np.unique(_name(row, w1, w2), return_index=True)[1]] = False
            which = pa.array(row)
            yield pa.RecordBatch.from_arrays([part.column(0).take(which), part.column(1).take(which), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(again)], names=["doc", "th", "w1", "w2", "start", "again"])

    return asked.select("doc", "th", "text", "ask").mapInArrow(run, f"{IDENTITY}, w1 long, w2 long, start int, again boolean")


def with_lists(source: DataFrame, found: DataFrame, name: str, how: str) -> DataFrame:
    """``source`` with all structs of ``found`` of the same document as one list; a list is as long as its text at most.

    Documents are matched by ``doc`` and ``th``, so that the many of a shared or null id do not meet.
    """
    keys = ["doc", "th"]
    lists = found.groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in found.columns if c not in keys])).alias(name))
    return source.join(lists, keys, how)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n units lie in any of the runs from start to end."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0
