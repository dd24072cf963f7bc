"""Benchmark decontamination by q-gram counts in diagonal bands.

Text and items are reduced to lower-case letters and digits with single spaces. An item that stands in
a text with at most e edits shares with it at least ``m + 1 - q - q*e`` q-grams (m: the item's
length), all within e diagonals of each other. Shared q-grams are counted in bands of diagonals that
overlap by half; bands with enough of them are verified by an alignment that is kept to the band.
Items too short to be sure of two 8-grams take the longest q of which one is sure to be shared. Items
of up to 8 characters have no edits to spare: they are looked up whole, as whole words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, id_and_bytes, slices, text_of

Q = 8
#: Edits allowed as a share of the item's characters; 1 - this is the least similarity.
EDITS = 0.1
#: Bytes of items that are sent to the tasks at once; a larger table takes further passes.
PASS_BYTES = 8 << 20
#: Log2 of the slots of the bit table that sorts out most q-grams.
SLOTS = 22


def _folded() -> np.ndarray:
    """For each byte what it is compared as: lower case, or a space where it is no letter or digit."""
    table = np.full(256, 0x20, np.uint8)
    for b in range(256):
        if chr(b).isalnum() and b < 128:
            table[b] = ord(chr(b).lower())
    table[0x80:] = np.arange(0x80, 0x100)
    return table


FOLD = _folded()
#: UTF-8 second bytes after 0xC3 of the Latin-1 capitals are folded to the small letters' by adding 32.
LATIN_LEAD, LATIN_FIRST, LATIN_LAST = 0xC3, 0x80, 0x9E


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes with single spaces, their offsets by row, and where each came from."""
    out = FOLD[data]
    latin = np.flatnonzero((data[:-1] == LATIN_LEAD) & (data[1:] >= LATIN_FIRST) & (data[1:] <= LATIN_LAST) & (data[1:] != 0x97)) + 1
    out[latin] += 32
    space = out == 0x20
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    keep[starts] = ~space[starts]
    at = np.flatnonzero(keep)
    return out[at], np.searchsorted(at, offsets), at


def gram_hashes(data: np.ndarray, q: int = Q) -> np.ndarray:
    """One 64-bit number for each place where ``q`` bytes start: the bytes themselves, mixed."""
    if len(data) < q:
        return np.zeros(0, np.uint64)
    packed = np.zeros(len(data) - q + 1, np.uint64)
    for j in range(q):
        packed = packed << np.uint64(8) | data[j : len(data) - q + 1 + j]
    return packed * np.uint64(0x9E3779B97F4A7C15)


def budget(length: int) -> int:
    return int(length * EDITS)


def gram_size(length: int) -> int:
    """Q, where an item with all its edits still shares two of them; else as long as its longest sure piece."""
    e = budget(length)
    return Q if length + 1 - Q - Q * e >= 2 else min(Q, length // (e + 1))


class Items:
    """The q-grams of one pass of benchmark items, for look-up."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        self.ids, self.texts, grams, short = [], [], {}, {}
        for i, raw in zip(ids, texts, strict=True):
            data = np.frombuffer(raw, np.uint8)
            folded = fold(data, np.array([0, len(data)]))[0] if len(data) else data
            folded = folded[: len(folded) - (len(folded) > 0 and folded[-1] == 0x20)]
            if not len(folded):
                continue
            if len(folded) <= Q:
                short.setdefault(len(folded), []).append((gram_hashes(folded, len(folded))[0], len(self.ids)))
            else:
                q = gram_size(len(folded))
                h = gram_hashes(folded, q)
                grams.setdefault(q, []).append((h, np.full(len(h), len(self.ids), np.int64), np.arange(len(h))))
            self.ids.append(i)
            self.texts.append(folded)
        self.length = np.array([len(x) for x in self.texts], np.int64)
        self.edits = (self.length * EDITS).astype(np.int64)
        q = np.array([gram_size(len(x)) for x in self.texts], np.int64)
        self.least = self.length + 1 - q - q * self.edits
        self.short = {m: (np.array([h for h, _ in sorted(x)], np.uint64), np.array([i for _, i in sorted(x)], np.int64)) for m, x in short.items()}
        self.grams = {}
        for q, parts in grams.items():
            hashed, item, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(hashed, kind="stable")
            slots = np.zeros(1 << SLOTS, bool)
            slots[hashed >> np.uint64(64 - SLOTS)] = True
            self.grams[q] = hashed[order], item[order], place[order], slots

    def _bands(self, data: np.ndarray, offsets: np.ndarray, q: int) -> set[tuple[int, int, int, int]]:
        """Row, item, first diagonal and width of the bands with enough shared q-grams."""
        hashed, of_item, of_place, slots = self.grams[q]
        h = gram_hashes(data, q)
        at = np.flatnonzero(slots[h >> np.uint64(64 - SLOTS)])
        low = np.searchsorted(hashed, h[at], "left")
        many = np.searchsorted(hashed, h[at], "right") - low
        at, low, many = at[many > 0], low[many > 0], many[many > 0]
        found: set[tuple[int, int, int, int]] = set()
        if not len(at):
            return found
        pick = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        at = np.repeat(at, many)
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + q <= offsets[row + 1]
        at, row, pick = at[inside], row[inside], pick[inside]
        if not len(at):
            return found
        item, local = of_item[pick], at - offsets[row]
        diagonal = local - of_place[pick]
        width = 2 * self.edits[item] + 2
        items = len(self.ids)
        pair = row * items + item  # rows and items are far below 2^31 each; bands and places are sorted beside them, so that no product overflows
        for half in (0, 1):  # each band has the one that starts at its middle beside it
            band = (diagonal + half * (width // 2)) // width
            order = np.lexsort((of_place[pick], band, pair))
            p, b, at_place = pair[order], band[order], of_place[pick][order]
            new_band = np.concatenate([[True], (p[1:] != p[:-1]) | (b[1:] != b[:-1])])
            once = new_band | np.concatenate([[True], at_place[1:] != at_place[:-1]])  # a q-gram of the item counts once in a band
            begins = np.flatnonzero(new_band)
            shared = np.add.reduceat(once.astype(np.int64), begins)
            p, b = p[begins], b[begins]
            enough = shared >= self.least[p % items]
            for key, k in zip(p[enough].tolist(), b[enough].tolist(), strict=True):
                r, i = divmod(key, items)
                w = 2 * int(self.edits[i]) + 2
                found.add((r, i, k * w - half * (w // 2), w))
        return found

    def _words(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """``hits`` of the items of up to Q characters."""
        out: list[tuple[int, int, int, int, int]] = []
        edge = np.zeros(len(data) + 1, bool)  # where a word may begin, and one place after where it may end
        edge[offsets] = True
        space = data == 0x20
        for m, (hashed, of_item) in self.short.items():
            h = gram_hashes(data, m)
            low = np.searchsorted(hashed, h, "left")
            many = np.searchsorted(hashed, h, "right") - low
            at = np.flatnonzero(many)
            row = np.searchsorted(offsets, at, "right") - 1
            alone = (at + m <= offsets[row + 1]) & (edge[at] | space[np.maximum(at - 1, 0)]) & (edge[at + m] | space[np.minimum(at + m, len(data) - 1)])
            for r, a in zip(row[alone].tolist(), at[alone].tolist(), strict=True):
                start = a - int(offsets[r])
                out += [(r, i, start, start + m, 0) for i in of_item[low[a] : low[a] + many[a]].tolist()]
        return out

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Row, item, first and end byte in the folded row, edits: of each verified region."""
        out = self._words(data, offsets)
        found = {x for q in self.grams for x in self._bands(data, offsets, q)}
        whole = data.tobytes()
        regions: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        if not found:
            return out
        r, i, d, w = np.array(sorted(found), np.int64).T
        e, m, begin = self.edits[i], self.length[i], offsets[r]
        lo, hi = np.maximum(0, d - e), np.minimum(offsets[r + 1] - begin, d + w + m + e)
        near = []
        for c, (x, a, b) in enumerate(zip(i.tolist(), (begin + lo).tolist(), (begin + hi).tolist(), strict=True)):
            equal = whole.find(self.texts[x].tobytes(), a, b) - a
            if equal >= 0:
                regions.setdefault((int(r[c]), x), []).append((0, int(lo[c]) + equal, int(lo[c]) + equal + int(m[c])))
            else:
                near.append(c)
        for part in np.array_split(np.array(near, np.int64), 1 + len(near) // 256):
            fits = fewest([self.texts[x] for x in i[part]], e[part], data, (begin + lo)[part], (hi - lo)[part], (d - lo - e)[part], (w + 2 * e)[part])
            for c in part[fits].tolist():
                a = int(begin[c] + lo[c])
                edits, start, end = align(self.texts[i[c]], data[a : int(begin[c] + hi[c])], int(d[c] - lo[c] - e[c]), int(w[c] + 2 * e[c]))
                regions.setdefault((int(r[c]), int(i[c])), []).append((edits, int(lo[c]) + start, int(lo[c]) + end))
        for (r, i), all_of in regions.items():  # of overlapping regions the one with the fewest edits
            kept: list[tuple[int, int, int]] = []
            for edits, start, end in sorted(all_of):
                if all(end <= a or start >= b for _, a, b in kept):
                    kept.append((edits, start, end))
            out += [(r, i, start, end, edits) for edits, start, end in kept]
        return out


def fewest(items: list[np.ndarray], edits: np.ndarray, data: np.ndarray, begin: np.ndarray, n: np.ndarray, first: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Which of many items fit in their texts within their edits: ``align`` for all at once, without places.

    An item is left as soon as no cell of its band is within its edits any more.
    """
    fits = np.zeros(len(items), bool)
    live = np.argsort([-len(x) for x in items], kind="stable")
    length = np.array([len(x) for x in items], np.int64)
    if not len(live):
        return fits
    letters = np.zeros((len(items), length.max()), np.uint8)
    for k, x in enumerate(items):
        letters[k, : len(x)] = x
    ramp = np.arange(width.max())
    far = 1 << 40
    place = first[live, None] + ramp
    cost = np.where((place >= 0) & (place <= n[live, None]) & (ramp < width[live, None]), 0, far)
    for step in range(int(length.max())):
        place = first[live, None] + ramp + (step + 1)
        ok = (place >= 0) & (place <= n[live, None]) & (ramp < width[live, None])
        there = data[np.clip(begin[live, None] + place - 1, 0, len(data) - 1)]
        new = np.where(place >= 1, cost + (there != letters[live, step][:, None]), far)
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
        new[~ok] = far
        cost = np.where(ok, np.minimum.accumulate(new - ramp, axis=1) + ramp, far)
        ended = length[live] == step + 1
        if ended.any() or step % 8 == 7:
            good = cost.min(axis=1) <= edits[live]
            fits[live[ended & good]] = True
            live, cost = live[good & ~ended], cost[good & ~ended]
            if not len(live):
                break
    return fits


def align(item: np.ndarray, text: np.ndarray, first: int, width: int) -> tuple[int, int, int]:
    """Fewest edits that put the whole item somewhere in the text, and where, on ``width`` diagonals from ``first``.

    Row i of the table holds the cells of diagonals first..first+width-1; the start of the best path
    is carried along. The step to the right within a row is a running minimum.
    """
    m, n = len(item), len(text)
    far = m + n + 1
    place, ramp = np.arange(first, first + width), np.arange(width)
    cost, start = np.where((place >= 0) & (place <= n), 0, far), np.clip(place, 0, n)
    padded = np.concatenate([np.zeros(1, np.uint8), text])
    for letter in item:
        place = place + 1
        ok = (place >= 0) & (place <= n)
        across = np.where(ok & (place >= 1), cost + (padded[np.clip(place, 0, n)] != letter), far)
        up = np.append(cost[1:], far) + 1
        new = np.where(ok, np.minimum(across, up), far)
        begun = np.where(up < across, np.append(start[1:], 0), start)
        level = np.minimum.accumulate(new - ramp)
        source = np.maximum.accumulate(np.where(new - ramp == level, ramp, 0))
        cost, start = np.where(ok, level + ramp, far), begun[source]
    best = int(np.argmin(cost))
    return int(cost[best]), int(start[best]), int(np.clip(place[best], 0, n))


def _passes(benchmark: DataFrame, item_id: str, item_text: str) -> Iterator[tuple[list[int], list[bytes]]]:
    """Ids and texts of the items, each once, at most about ``PASS_BYTES`` at a time."""
    items = benchmark.select(benchmark[item_id].cast("long").alias("item_id"), benchmark[item_text].cast("binary").alias("item")).filter(F.col("item").isNotNull()).distinct()
    passes = 1 + int((items.agg(F.sum(F.octet_length("item")).alias("n")).first().n or 0) // PASS_BYTES)
    for k in range(passes):
        chosen = items.filter(F.pmod(F.xxhash64("item_id", "item"), F.lit(passes)) == k).toArrow()
        yield chosen.column(0).to_pylist(), chosen.column(1).to_pylist()


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id``, ``item_id``, ``first``, ``last`` (bytes of the text), ``edits`` and ``similarity`` of each region.

    A null or empty text, and an item without letters or digits, has none; repeated rows give a row each,
    and rows with a null id give theirs with a null id. Items are taken in passes of at most
    ``PASS_BYTES``, each over all documents.
    """
    source, found = id_and_bytes(docs, doc_id, text), None
    for ids, texts in _passes(benchmark, item_id, item_text):
        one = source.mapInArrow(_finder(ids, texts), "doc_id long, item_id long, first long, last long, edits int, similarity double")
        found = one if found is None else found.unionByName(one)
    return found


def _searched(items: Items, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Row ends in the folded text, where its bytes came from, row starts in the text, and the hits of a batch's texts (its column 1)."""
    data, offsets = flat(part.column(1))
    if not len(data):
        return offsets, offsets, offsets, []
    folded, ends, at = fold(data, offsets)
    return ends, at, offsets, items.hits(folded, ends) if len(folded) else []


def _finder(ids: list[int], texts: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(ids, texts)
        for part in slices(batches):
            ends, at, offsets, hits = _searched(items, part)
            if hits:
                row, item, first, last, edits = (np.array(x, np.int64) for x in zip(*hits, strict=True))
                came = lambda k: at[np.minimum(ends[row] + k, len(at) - 1)] - offsets[row]
                which = part.column(0).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [which, pa.array([items.ids[i] for i in item], pa.int64()), pa.array(came(first)), pa.array(came(last - 1) + 1), pa.array(edits.astype(np.int32)), pa.array(1 - edits / items.length[item])],
                    names=["doc_id", "item_id", "first", "last", "edits", "similarity"],
                )

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, with the columns they came with.

    Each row is judged by its own text, whatever its id: a clean row that shares its id with a dropped
    one stays, a contaminated one with a null id goes, and so do all its repeats. Nothing is shuffled.
    """
    schema = docs.schema
    rows = docs.select(F.struct("*").alias("row"), text_of(docs, text).cast("binary").alias("text"))
    for ids, texts in _passes(benchmark, item_id, item_text):
        rows = rows.mapInArrow(_sieve(ids, texts), rows.schema)
    return rows.select(*[F.col("row")[c].alias(c) for c in schema.names])


def _sieve(ids: list[int], texts: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(ids, texts)
        for part in slices(batches):
            clean = np.ones(part.num_rows, bool)
            clean[[r for r, *_ in _searched(items, part)[3]]] = False
            yield part.filter(pa.array(clean))

    return run
