"""Fill-in-the-middle transformation; cuts are found by a scan of chunks that need not know what came before.

A small automaton reads UTF-8 bytes. It knows whether a letter run is open, so that it can tell where units
(`[A-Za-z]+|[^A-Za-z]`) begin, and how much of a sentinel (`<P>`, `<S>`, `<M>`) has been seen. A chunk gives,
for each state it may be entered in, the state it is left in, the units that begin in it and the sentinels
that end in it. These functions compose associatively, so the chunks of one huge document are read by as many
tasks as there are; composing them tells each chunk's true entry state and rank, and only the chunks that
hold a cut are asked where it is. A text of one chunk is the same with nothing to compose.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, flat, materialise, slices, text_of

#: Bytes of a chunk; longer texts are read by several tasks.
CHUNK = 1 << 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The automaton's states: nothing open, a letter run, after ``<``, after ``<`` and a sentinel's letter.
PLAIN, LETTER, OPEN, NAMED = range(4)
STATES = 4
_BYTES = np.arange(256)
_IS_LETTER = ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122))
_IS_NAME = np.isin(_BYTES, list(b"PSM"))
_LEADS = (_BYTES & 0xC0) != 0x80  # the first byte of a character


@dataclass
class Scan:
    """What chunks do, by entry state: arrays of (chunks, states)."""

    leave: np.ndarray
    units: np.ndarray
    sentinels: np.ndarray

    def then(self, other: Scan) -> Scan:
        """First these chunks, then those of ``other``; associative."""
        take = lambda x: np.take_along_axis(x, self.leave, 1)
        return Scan(take(other.leave), self.units + take(other.units), self.sentinels + take(other.sentinels))


def unit_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Which bytes begin a unit, if each chunk is entered with nothing open."""
    letter = _IS_LETTER[data]
    joined = np.zeros(len(data), bool)
    joined[1:] = letter[1:] & letter[:-1]
    joined[begins[begins < len(data)]] = False
    return _LEADS[data] & ~joined


def scan(data: np.ndarray, offsets: np.ndarray) -> Scan:
    """The functions of the chunks that ``offsets`` cut ``data`` into.

    The automaton remembers two bytes at most, so a function is read off a chunk's ends and two counts.
    """
    begins, ends = offsets[:-1], offsets[1:]
    size = ends - begins
    n = len(size)
    add = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    started = add(unit_starts(data, begins))
    units = np.repeat((started[ends] - started[begins])[:, None], STATES, axis=1)
    closing = np.zeros(len(data), bool)
    closing[2:] = (data[2:] == 62) & _IS_NAME[data[1:-1]] & (data[:-2] == 60)
    closed = add(closing)
    inner = np.minimum(begins + 2, ends)  # a sentinel inside ends at the third byte or later
    sentinels = np.repeat((closed[ends] - closed[inner])[:, None], STATES, axis=1)
    leave = np.tile(np.arange(STATES), (n, 1))
    at = lambda place, there: np.where(there, data[np.where(there, place, 0)] if len(data) else 0, 0)
    some, more = size > 0, size > 1
    first, second, last, before = at(begins, some), at(begins + 1, more), at(ends - 1, some), at(ends - 2, more)
    opens = some & _IS_LETTER[first]
    units[:, LETTER] -= opens
    units[:, NAMED] -= opens
    sentinels[:, NAMED] += some & (first == 62)
    sentinels[:, OPEN] += more & _IS_NAME[first] & (second == 62)
    seen = np.where(last == 60, OPEN, np.where(_IS_LETTER[last], np.where(_IS_NAME[last] & (before == 60), NAMED, LETTER), PLAIN))
    leave[some] = seen[some, None]
    leave[some & ~more & _IS_NAME[first], OPEN] = NAMED
    return Scan(leave, units, sentinels)


def composed(scans: Scan) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Of consecutive chunks: each one's entry state and the units before it; all units and sentinels."""
    state, units, sentinels = PLAIN, 0, 0
    entries, before = [], []
    for leave, u, s in zip(scans.leave.tolist(), scans.units.tolist(), scans.sentinels.tolist(), strict=True):
        entries.append(state)
        before.append(units)
        units, sentinels, state = units + u[state], sentinels + s[state], leave[state]
    return np.array(entries), np.array(before), units, sentinels


def place(data: np.ndarray, entry: int, rank: int) -> int:
    """The byte of one chunk at which its unit of this rank begins, if it is entered in ``entry``."""
    starts = unit_starts(data, np.zeros(1, np.int64))
    if len(data) and entry in (LETTER, NAMED) and _IS_LETTER[data[0]]:
        starts[0] = False
    return int(np.flatnonzero(starts)[rank])


def draws(docs: DataFrame, doc_id: str, seed: int) -> list[Column]:
    """Four 32-bit draws of a document, from its id alone; a null id draws as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[doc_id].cast("long").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


CUTS = "doc_id long, text string, h3 long, h4 long, n long, marked boolean, first long, second long"


def _in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of one chunk: their units, and the bytes at which prefix and middle end."""
    for part in slices(batches):
        data, offsets = flat(part.column("text"))
        found = scan(data, offsets)
        n = found.units[:, PLAIN]
        starts = np.append(np.flatnonzero(unit_starts(data, offsets[:-1])), len(data))
        begun = np.concatenate([[0], np.cumsum(n)])
        h1, h2 = (np.asarray(part.column(c)) % (n + 1) for c in ("h1", "h2"))
        low, high = np.minimum(h1, h2), np.maximum(h1, h2)
        first, second = (np.where(x < n, starts[begun[:-1] + np.minimum(x, n)], offsets[1:]) - offsets[:-1] for x in (low, high))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("text").cast(pa.string()), part.column("h3"), part.column("h4"), pa.array(n), pa.array(found.sentinels[:, PLAIN] > 0), pa.array(first), pa.array(second)], names=[c.split(" ")[0] for c in CUTS.split(", ")],
        )


def _chunked(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, chunk):
            for row, raw in zip(part.column("row").to_pylist(), part.column("text").to_pylist(), strict=True):
                for k, at in enumerate(range(0, len(raw), chunk)):
                    yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([k]), pa.array([raw[at : at + chunk]])], names=["row", "k", "piece"])

    return run


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        found = scan(*flat(part.column("piece")))
        yield pa.RecordBatch.from_arrays([part.column("row"), part.column("k"), *[pa.array(x.tolist()) for x in (found.leave, found.units, found.sentinels)]], names=["row", "k", "leave", "units", "sentinels"])


def _selected(table: pa.Table) -> pa.Table:
    """One document's chunk functions: which chunk and rank each of its two cuts has."""
    table = table.sort_by("k")
    entries, before, n, sentinels = composed(Scan(*[np.array(table[c].to_pylist()) for c in ("leave", "units", "sentinels")]))
    drawn = sorted(table[c][0].as_py() % (n + 1) for c in ("h1", "h2"))
    holders = [int(np.searchsorted(before, x, "right")) - 1 if x < n else None for x in drawn]
    return pa.table({"row": [table["row"][0].as_py()] * 2, "cut": [0, 1], "n": [n] * 2, "marked": [sentinels > 0] * 2, "k": pa.array(holders, pa.int64()), "entry": [0 if k is None else int(entries[k]) for k in holders], "rank": [0 if k is None else x - int(before[k]) for k, x in zip(holders, drawn, strict=True)]})


def _places(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            cols = [part.column(c).to_pylist() for c in ("k", "entry", "rank", "piece")]
            found = [k * chunk + place(np.frombuffer(raw, np.uint8), entry, rank) for k, entry, rank, raw in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("cut"), pa.array(found, pa.int64())], names=["row", "cut", "place"])

    return run


def _spread(long: DataFrame, chunk: int) -> DataFrame:
    """Texts of several chunks. ``long`` is a written table: row, doc_id, text (bytes), h1 to h4."""
    pieces = long.select("row", "text").mapInArrow(_chunked(chunk), "row long, k long, piece binary").repartition("row", "k")
    scans = pieces.mapInArrow(_scanned, "row long, k long, leave array<long>, units array<long>, sentinels array<long>")
    cuts = scans.join(long.select("row", "h1", "h2"), "row").groupBy("row").applyInArrow(_selected, "row long, cut long, n long, marked boolean, k long, entry long, rank long")
    found = cuts.join(pieces, ["row", "k"]).mapInArrow(_places(chunk), "row long, cut long, place long")
    ends = cuts.select("row", "cut", "n", "marked").join(found, ["row", "cut"], "left").groupBy("row").agg(
        F.max("n").alias("n"), F.max("marked").alias("marked"), *[F.max(F.when(F.col("cut") == c, F.col("place"))).alias(name) for c, name in ((0, "first"), (1, "second"))]
    )
    size = F.octet_length("text").cast("long")
    return long.join(ends, "row").select("doc_id", F.decode("text", "UTF-8").alias("text"), "h3", "h4", "n", "marked", *[F.coalesce(c, size).alias(c) for c in ("first", "second")])


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, chunk: int = CHUNK) -> DataFrame:
    """``doc_id``, ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of every row.

    Prefix and middle end after as many units as two draws say. ``form`` is ``plain`` (the text as it is) for
    an empty or null text, for one that holds a sentinel, and for ``plain_percent`` of the rest; else ``spm``
    (suffix first) for ``spm_percent`` and ``psm``. Draws come from the id, so equal ids are cut by the same
    draws; a null id draws as an empty one; repeated rows are each transformed. Other columns are ignored.
    Texts of up to ``chunk`` bytes stay in their task; only longer ones are dealt out.
    """
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(docs, text).cast("binary").alias("text"), *draws(docs, doc_id, seed))
    cut = rows.where(F.octet_length("text") <= chunk).mapInArrow(_in_place, CUTS)
    numbered = rows.withColumn("row", F.monotonically_increasing_id()).where(F.octet_length("text") > chunk)
    with Scratch(docs.sparkSession) as scratch:
        long = materialise(numbered, "fim-long", scratch=scratch)
        if long.isEmpty():
            return formed(cut, plain_percent, spm_percent)
        spread = materialise(_spread(long, chunk), "fim-cut")
    return formed(cut.unionByName(spread), plain_percent, spm_percent)


def formed(cut: DataFrame, plain_percent: int, spm_percent: int) -> DataFrame:
    raw = F.col("text").cast("binary")
    part = lambda start, size: F.decode(F.substring(raw, start + 1, size), "UTF-8")
    first, second = F.col("first").cast("int"), F.col("second").cast("int")
    pieces = cut.select(
        "doc_id", "text", "n", F.when((F.col("n") == 0) | F.col("marked") | (F.col("h3") % 100 >= 100 - plain_percent), "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm").alias("form"),
        part(F.lit(0), first).alias("prefix"), part(first, second - first).alias("middle"), part(second, F.octet_length(raw) - second).alias("suffix"),
    )
    plain = F.col("form") == "plain"
    psm, spm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"), F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    return pieces.select(
        "doc_id", "n", "form", *[F.when(~plain, F.length(c).cast("long")).alias(f"{c}_chars") for c in ("prefix", "middle")], F.when(plain, F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that ``transform`` made ``output`` of, from output and form alone."""
    at = {m: F.locate(m, output) for m in (PREFIX, SUFFIX, MIDDLE)}
    between = lambda a, b: F.substring(output, at[a] + 3, at[b] - at[a] - 3)
    middle = F.substring(output, at[MIDDLE] + 3, F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))).otherwise(F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX)))


def digests(transformed: DataFrame) -> DataFrame:
    """What the query returns of ``transform``."""
    return transformed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
