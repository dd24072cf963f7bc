"""Token alignment of two vocabularies by a sweep over the ends of their tokens.

Each text is encoded twice. An event is a token's end; the events of both sides are united, dealt out by
document and sorted by offset within each partition, and a machine that keeps no more than the open group
streams through them: where a token of either side ends at the same byte, the group closes. Events travel
packed, as runs of token ids with the byte at which a run begins; the ends follow from the tokens' lengths.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, id_and_bytes, materialise, slices
from .units import LONGEST, REMEMBERED, ByteTokens, PieceTokens, Table, numbered, regular, settled

#: Tokens in a run of events, tokens (of both sides) that the machine reads at once, and groups so large that equal tokens in them are put together first.
RUN, WINDOW, LARGE = 1 << 16, 1 << 20, 1 << 14
#: Bytes of text, and documents, whose links ask for their counts together.
BLOCK, DOCUMENTS = 8 << 20, 1 << 17
EVENTS = "row long, doc_id long, side int, at long, ids binary"


class Coders:
    """Both vocabularies, the lengths of their tokens, and the words both have encoded so far."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.sides = ByteTokens(a), PieceTokens(b)
        self.length = [np.zeros(1 + max(s.raw), np.int64) for s in self.sides]
        for length, side in zip(self.length, self.sides, strict=True):
            for i, token in side.raw.items():
                length[i] = len(token)
        self.digits = [_digits(len(x)) for x in self.length]
        self.words = Table(2)

    def encode_words(self, new: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """All new words in one string: each begins with a space that no token goes past."""
        text = "".join(new)
        last = np.cumsum([len(w.encode()) for w in new])
        out = []
        for side, length in zip(self.sides, self.length, strict=True):
            ids = side.encode(text, True)
            count = np.searchsorted(np.cumsum(length[ids]), last, "right")
            out.append((ids, np.diff(count, prepend=0)))
        return out

    def one(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """A text by itself; nothing if either side's bytes are not those of the text."""
        text, sure = f" {text}", settled(text)
        both = [side.encode(text, sure) for side in self.sides]
        for side, ids in zip(self.sides, both, strict=True):
            if b"".join([side.raw.get(i, b"") for i in ids.tolist()]) != text.encode():
                return (np.zeros(0, np.int32),) * 2
        return both[0], both[1]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        if len(self.words) > REMEMBERED:
            self.words = Table(2)
        out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(texts)
        runs, owners = [], []
        for k, text in enumerate(texts):
            if not text:
                out[k] = (np.zeros(0, np.int32),) * 2
                continue
            own = text.split(" ")
            if not (settled(text) and regular(text)) or max(map(len, own)) > LONGEST:
                out[k] = self.one(text)
            else:
                runs += own
                owners.append((k, len(own)))
        if runs:
            at = numbered(self.words, runs, lambda new: self.encode_words([f" {w}" for w in new]))
            sides = []
            for coder in range(2):
                ids, sizes = self.words.of(coder, at)
                sides.append((ids, np.append(0, np.cumsum(sizes))))
            done = 0
            for k, n in owners:
                out[k] = tuple(ids[bounds[done] : bounds[done + n]] for ids, bounds in sides)
                done += n
        return out


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below ``n`` in decimal, right-aligned, with room for one separator; and which places count."""
    width = len(str(n - 1))
    numbers = np.arange(n)[:, None] // 10 ** np.arange(width - 1, -1, -1)
    digits = np.full((n, width + 1), ord(","), np.uint8)
    digits[:, :-1] = numbers % 10 + 48
    used = np.ones((n, width + 1), bool)
    used[:, :-2] = numbers[:, :-1] > 0
    return digits, used


@lru_cache(maxsize=1)
def coders(a: str, b: str) -> Coders:
    return Coders(a, b)


def events(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """The ends of both sides' tokens, united: runs of ids, each with its document, side and first byte."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = coders(a, b)
        for part in slices(batches):
            rows, ids_of = part.column("row").to_pylist(), part.column("doc_id").to_pylist()
            found = both.encode([x.decode("utf-8", "replace") for x in part.column("text").to_pylist()])
            out = [], [], [], [], []
            for row, doc, sides in zip(rows, ids_of, found, strict=True):
                for side, ids in enumerate(sides):
                    if len(ids) > run:
                        ends = np.append(0, np.cumsum(both.length[side][ids]))
                    for k in range(0, max(len(ids), 1), run):
                        piece = ids[k : k + run]
                        for column, value in zip(out, (row, doc, side, int(ends[k]) if k else 0, piece.astype(np.uint16 if len(both.length[side]) <= 1 << 16 else np.uint32).tobytes()), strict=True):
                            column.append(value)
            kinds = pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=[c.split(" ")[0] for c in EVENTS.split(", ")])

    rows = id_and_bytes(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(encode, EVENTS)


def by_document(found: DataFrame) -> DataFrame:
    """Each document's events in one partition, in the order of their offsets."""
    return found.repartition("row").sortWithinPartitions("row", "at", "side")


class Groups:
    """Closed groups of some documents, in order: ids of both sides, how many of them each group has, groups of each document."""

    def __init__(self, rows: list[tuple[int, int | None]], ids: list[np.ndarray], sizes: list[np.ndarray], of_doc: np.ndarray, open_end: bool):
        self.rows, self.ids, self.sizes, self.of_doc, self.open_end = rows, ids, sizes, of_doc, open_end


def sweep(batches: Iterator[pa.RecordBatch], both: Coders, window: int = WINDOW) -> Iterator[Groups]:
    """The machine. Its state is what has come since the last common end, and the document that is open.

    A document may come in several parts; ``open_end`` tells that the last one goes on.
    """
    kinds = [np.uint16 if len(x) <= 1 << 16 else np.uint32 for x in both.length]
    rest: list[np.ndarray] = [np.zeros(0, np.int32)] * 2
    rest_of: int | None = None
    rows: list[tuple[int, int | None]] = []
    taken: list[list[np.ndarray]] = [[], []]
    bytes_of: list[int] = []  # of side A, document by document
    held = 0

    def close(final: bool) -> Groups:
        nonlocal rest, rest_of, rows, taken, bytes_of, held
        ids = [np.concatenate([rest[s], *taken[s]]) for s in range(2)]
        ends = [np.cumsum(both.length[s][ids[s]]) for s in range(2)]
        common = np.intersect1d(ends[0], ends[1], assume_unique=True)
        cut = [np.searchsorted(e, common[-1], "right") if len(common) else 0 for e in ends]
        group_of = [np.searchsorted(common, ends[s][: cut[s]]) for s in range(2)]
        bounds = np.cumsum(bytes_of)
        of_doc = np.bincount(np.searchsorted(bounds, common), minlength=len(rows))[: len(rows)]
        out = Groups(rows, [ids[s][: cut[s]] for s in range(2)], [np.bincount(g, minlength=len(common)) for g in group_of], of_doc, not final)
        rest = [ids[s][cut[s] :] for s in range(2)]
        # What is left over belongs to the last document; its bytes are counted from the last common end.
        left = int(bounds[-1] - (common[-1] if len(common) else 0))
        rows, taken, bytes_of, held = ([], [[], []], [], 0) if final else ([rows[-1]], [[], []], [left], 0)
        return out

    for batch in batches:
        for row, doc, side, raw in zip(*[batch.column(c).to_pylist() for c in ("row", "doc_id", "side", "ids")], strict=True):
            if row != rest_of:
                if held >= window:
                    yield close(True)
                rows.append((row, doc))
                bytes_of.append(0)
                rest_of = row
            elif held >= window and side == 0:
                yield close(False)
            ids = np.frombuffer(raw, kinds[side]).astype(np.int32)
            taken[side].append(ids)
            held += len(ids) + 1
            if side == 0:
                bytes_of[-1] += int(both.length[0][ids].sum())
    if rows:
        yield close(True)


def groups(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, run: int = RUN) -> DataFrame:
    """``doc_id``, ``part``, and for each group in order the ids of both sides, as two lists of lists.

    A document that the machine reads in several steps has several parts, to be taken in order; one without
    tokens (null or empty text, or bytes that either side does not give back) has no groups. Repeated rows
    and shared ids are each aligned (``row`` tells them apart); a null id stays null.
    """

    def run_sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_of: dict[int, int] = {}
        for g in sweep(batches, coders(a, b), window):
            lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(g.sizes[s])), pa.int32()), pa.array(g.ids[s])) for s in range(2)]
            offsets = pa.array(np.append(0, np.cumsum(g.of_doc)), pa.int32())
            parts = [part_of.get(row, 0) for row, _ in g.rows]
            part_of = {g.rows[-1][0]: parts[-1] + 1} if g.open_end else {}
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in g.rows]), pa.array([d for _, d in g.rows], pa.int64()), pa.array(parts), *[pa.ListArray.from_arrays(offsets, x) for x in lists]], names=["row", "doc_id", "part", "a_ids", "b_ids"])

    return by_document(events(docs, a, b, doc_id, text, run)).mapInArrow(run_sweep, "row long, doc_id long, part long, a_ids array<array<int>>, b_ids array<array<int>>")


def links(grouped: DataFrame) -> DataFrame:
    """``row``, ``doc_id``, ``a``, ``b``: every pair of token occurrences that share a group."""
    one = grouped.select("row", "doc_id", F.explode(F.arrays_zip("a_ids", "b_ids")).alias("g")).select("row", "doc_id", F.explode("g.a_ids").alias("a"), F.col("g.b_ids").alias("bs"))
    return one.select("row", "doc_id", "a", F.explode("bs").alias("b"))


def pairs_of(g: Groups, n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked pairs of ids: document (its place in ``g.rows``), pair (``a * n_b + b``) and how many links, once for each document.

    Equal tokens of a large group are put together before they are paired.
    """
    (a, b), (na, nb) = g.ids, g.sizes
    doc_of = np.repeat(np.arange(len(g.rows)), g.of_doc)
    start_a, start_b = np.cumsum(na) - na, np.cumsum(nb) - nb
    small = na * nb <= LARGE
    group_of_a = np.repeat(np.arange(len(na)), na)
    mine = small[group_of_a]
    of, left = group_of_a[mine], a[mine].astype(np.int64)
    times = nb[of]
    before = np.cumsum(times) - times
    right = b[np.repeat(start_b[of] - before, times) + np.arange(times.sum())]
    docs, pairs, counts = [np.repeat(doc_of[of], times)], [np.repeat(left, times) * n_b + right], [np.ones(int(times.sum()), np.int64)]
    for k in np.flatnonzero(~small):
        (x, cx), (y, cy) = (np.unique(z, return_counts=True) for z in (a[start_a[k] : start_a[k] + na[k]], b[start_b[k] : start_b[k] + nb[k]]))
        docs.append(np.full(len(x) * len(y), doc_of[k]))
        pairs.append((x.astype(np.int64)[:, None] * n_b + y).ravel())
        counts.append((cx[:, None] * cy).ravel())
    return summed(np.concatenate(docs), np.concatenate(pairs), np.concatenate(counts))


def summed(docs: np.ndarray, pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal (document, pair), in their order. Pairs have less than 42 bits and documents of a step less than 21."""
    key = docs.astype(np.int64) << 42 | pairs
    if len(counts) and counts.max() == 1:
        key, total = np.unique(key, return_counts=True)
    else:
        order = np.argsort(key, kind="stable")
        key, counts = key[order], counts[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        key, total = key[first], np.add.reduceat(counts, first) if len(first) else counts
    return key >> 42, key & ((1 << 42) - 1), total


def written_out(g: Groups, both: Coders) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;``: the bytes of all groups, and where each document's end."""
    (na, nb), (da, ua), (db, ub) = g.sizes, *both.digits
    width = max(da.shape[1], db.shape[1])
    group_of = [np.repeat(np.arange(len(x)), x) for x in (na, nb)]
    before_b, upto_a = np.cumsum(nb) - nb, np.cumsum(na)
    total = len(g.ids[0]) + len(g.ids[1])
    chars, used = np.zeros((total, width), np.uint8), np.zeros((total, width), bool)
    for s, (digits, use, other, mark) in enumerate(((da, ua, before_b, "|"), (db, ub, upto_a, ";"))):
        at = np.arange(len(g.ids[s])) + other[group_of[s]]
        cells = digits[g.ids[s]]
        cells[np.cumsum(g.sizes[s]) - 1, -1] = ord(mark)
        chars[at, width - digits.shape[1] :], used[at, width - digits.shape[1] :] = cells, use[g.ids[s]]
    size = np.append(0, np.cumsum(used.sum(1)))
    ends = np.append(0, np.cumsum(na + nb))[np.cumsum(g.of_doc)]
    return chars[used], size[ends]


#: One row for each block: its documents, their pairs as places in ``pairs`` (packed), and in how many of its documents each pair is.
BLOCKS = "block long, docs array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string>>, sizes array<int>, places binary, times binary, pairs array<long>, in_docs array<int>"


class Block:
    """Documents whose links ask for their counts together; a document's own sums grow while it is open."""

    def __init__(self, both: Coders):
        self.both, self.n_b = both, len(both.length[1])
        self.docs: list[dict] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.tokens = 0
        self.open_row: int | None = None

    def add(self, g: Groups) -> None:
        first = len(self.docs)
        doc, pair, times = pairs_of(g, self.n_b)
        text, text_ends = written_out(g, self.both)
        groups_before = np.append(0, np.cumsum(g.of_doc))
        sums = [np.append(0, np.cumsum(x))[groups_before] for x in (g.sizes[0], g.sizes[1], g.sizes[0] * g.sizes[1])]
        joined = self.open_row is not None and g.rows and g.rows[0][0] == self.open_row
        at = 0
        for k, (row, doc_id) in enumerate(g.rows):
            if k or not joined:
                self.docs.append({"doc_id": doc_id, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "sha": hashlib.sha256()})
            own = self.docs[-1]
            end = int(text_ends[k])
            # Each part ends in a separator; between parts it stands, at the very end it does not count.
            if end > at:
                own["sha"].update(own.pop("mark", b"") + text[at : end - 1].tobytes())
                own["mark"] = b";"
            own["n_groups"] += int(g.of_doc[k])
            for name, x in zip(("n_a", "n_b", "n_links"), sums, strict=True):
                own[name] += int(x[k + 1] - x[k])
            at = end
        self.parts.append((doc + first - joined, pair, times))
        self.tokens += len(g.ids[0])
        self.open_row = g.rows[-1][0] if g.open_end else None

    def record(self, block: int) -> pa.RecordBatch:
        doc, pair, times = summed(*[np.concatenate(x) for x in zip(*self.parts, strict=True)])
        pairs, place, in_docs = np.unique(pair, return_inverse=True, return_counts=True)
        docs = [{k: v for k, v in d.items() if k not in ("sha", "mark")} | {"groups_sha256": d["sha"].hexdigest() if d["n_groups"] else ""} for d in self.docs]
        first = np.append(True, doc[1:] != doc[:-1]) if len(doc) else np.zeros(0, bool)
        steps = np.where(first, place, np.diff(place, prepend=0))
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string())]))
        return pa.RecordBatch.from_arrays([
            pa.array([block]), pa.array([docs], kind), pa.array([np.bincount(doc, minlength=len(docs)).astype(np.int32)], pa.list_(pa.int32())), pa.array([packed(steps)]), pa.array([packed(times)]), pa.array([pairs], pa.list_(pa.int64())), pa.array([in_docs.astype(np.int32)], pa.list_(pa.int32())),
        ], names=["block", "docs", "sizes", "places", "times", "pairs", "in_docs"])


def packed(numbers: np.ndarray) -> bytes:
    """Numbers of up to 32 bits, byte plane by byte plane, so that the empty planes shrink to nothing."""
    planes = np.ascontiguousarray(numbers.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return bytes(pa.compress(planes.tobytes(), "zstd", asbytes=True)) if len(numbers) else b""


def unpacked(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(raw, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def blocks(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, run: int = RUN, size: int = BLOCK) -> DataFrame:
    """The sweep, with its groups turned into figures, digests and linked pairs, block by block."""
    most = size // 3  # a token of side A has about three bytes

    def run_sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, done = coders(a, b), TaskContext.get().partitionId() << 32
        block = Block(both)
        for g in sweep(batches, both, window):
            block.add(g)
            if (block.tokens >= most or len(block.docs) >= DOCUMENTS) and block.open_row is None:
                yield block.record(done)
                block, done = Block(both), done + 1
        if block.docs:
            yield block.record(done)

    return by_document(events(docs, a, b, doc_id, text, run)).mapInArrow(run_sweep, BLOCKS)


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _answered(held: pa.Table, counts: pa.Table) -> pa.Table:
    """One block: its documents' sums over links of the pairs' counts in the whole corpus."""
    n_docs, best = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, bool)
    place = counts["place"].to_numpy()
    n_docs[place], best[place] = counts["n_docs"].to_numpy(), counts["best"].to_numpy(zero_copy_only=False)
    figures: dict[str, list] = {c.split(" ")[0]: [] for c in RESULT.split(", ")}
    for docs, sizes, places, times in zip(*[held[c].to_pylist() for c in ("docs", "sizes", "places", "times")], strict=True):
        n = sum(sizes)
        steps, times = unpacked(places, n), unpacked(times, n)
        doc = np.repeat(np.arange(len(docs)), sizes)
        # Places are steps from one to the next within a document, and whole at its first.
        run = np.cumsum(steps)
        start = np.append(0, np.cumsum(sizes))[:-1]
        before = np.where(start > 0, run[np.minimum(start, max(n - 1, 0)) - 1], 0) if n else np.zeros(len(docs), np.int64)
        at = run - before[doc]
        for name, each in (("n_best", best[at] * times), ("count_sum", n_docs[at] * times)):
            total = np.zeros(len(docs), np.int64)
            np.add.at(total, doc, each)
            figures[name] += total.tolist()
        for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"):
            figures[name] += [d[name] for d in docs]
    kinds = {"groups_sha256": pa.string()}
    return pa.table({c: pa.array(x, kinds.get(c, pa.int64())) for c, x in figures.items()})


def align(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, run: int = RUN, size: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: tokens of both sides, groups, links, links whose pair is its A id's most frequent, and the sum of the pairs' counts.

    A pair's count is in how many documents of the corpus it is linked. ``a`` (byte-level, tokenizers format)
    and ``b`` (pieces, sentencepiece format) are vocabulary files that every executor has. A null or empty
    text, and one whose bytes either side does not give back, has zeros and an empty digest; repeated rows
    and rows that share an id are documents of their own; a null id stays null; other columns are ignored.
    Counts are summed within blocks of documents before they are shuffled, and come back to blocks, so no
    pair is sent once for each document.
    """
    with Scratch(docs.sparkSession) as scratch:
        held = materialise(blocks(docs, a, b, doc_id, text, window, run, size), "alignment", scratch=scratch)
        n_b = piece_count(b)
        asked = held.select("block", F.posexplode(F.arrays_zip("pairs", "in_docs")).alias("place", "x")).select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.in_docs").alias("n"))
        counts = asked.groupBy("pair").agg(F.sum("n").cast("long").alias("n_docs"))
        most = counts.groupBy(first_of(F.col("pair"), n_b).alias("a")).agg(F.max("n_docs").alias("most"))
        known = counts.withColumn("a", first_of(F.col("pair"), n_b)).join(most, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))
        told = asked.select(F.col("block").alias("asked_by"), "place", "pair").join(known, "pair").select("asked_by", "place", "n_docs", "best")
        return materialise(held.select("block", "docs", "sizes", "places", "times").groupBy("block").cogroup(told.groupBy("asked_by")).applyInArrow(_answered, RESULT), "alignment-figures")


def first_of(pair: Column, n_b: int) -> Column:
    return F.floor(pair / F.lit(n_b)).cast("long")


def piece_count(path: str) -> int:
    """One more than the largest piece id."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
