"""A hidden Markov language model over whole corpora.

Every word of the training texts has emissions of its own. They stand in a Spark table that grows with the
vocabulary: its parts are ranges of word hashes. Texts are packed into blocks; a block asks each part once
for its different words, whatever their number in the block, so that frequent words are no hot keys.
Latent states are trained by Baum-Welch: blocks run exact forward and backward passes over whole texts
(their segments are joined by products of matrices) and send expected counts back to the parts. A text's
exact log likelihood comes from the scaled forward recursion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import mix, word_bounds, word_hashes
from .common import Scratch, flat, materialise, slices, text_of

#: A part of the emission table gets about ``ASKED * FREQUENT`` words asked for by blocks; it leaves no word out.
FREQUENT, ASKED = 1 << 16, 16
STATES, ROUNDS = 4, 3
#: Longest stretch of tokens that is one matrix product; texts are joined again from their segments.
SEGMENT = 256
#: Bytes of text of a block and of what is split into words at a time, segments that are worked on at a time.
BLOCK, SLICE, LANES = 12 << 20, 1 << 20, 1024
#: Added to every expected count.
PRIOR = 0.01
#: The hash that stands for a text's end.
END = 0x7265_6164_7468_6973
#: Documents whose crc32 of the id leaves this remainder are held out.
FOLDS, HELD_OUT = 7, 2

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def held_out(doc_id: Column) -> Column:
    """A null id counts as an empty text and has remainder 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def _tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words of each row, each row's end included, and the row bounds."""
    data, offsets = flat(col)
    lower = _LOWER[data]
    starts, ends, bounds = word_bounds(lower, offsets)
    hashed = word_hashes(lower, starts, ends).view(np.int64)
    return np.insert(hashed, bounds[1:], END), bounds + np.arange(len(bounds))


def _read(value: pa.Scalar, kind: type, *shape: int) -> np.ndarray:
    """The numbers of a binary value; rows of ``shape`` if given."""
    flat_values = np.frombuffer(value.as_py(), kind) if len(value.as_py()) else np.zeros(0, kind)
    return flat_values.reshape(-1, *shape)


def _pack(arrays: list[np.ndarray | None]) -> pa.Array:
    return pa.array([None if x is None else x.tobytes() for x in arrays], pa.binary())


def blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for every block of about ``BLOCK`` bytes of text: ids, token bounds and tokens of its texts.

    Tokens are places in ``words``, the block's different hashes in rising order; ``counts`` has how often
    each occurs in training texts. Every text ends with the end token.
    """
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), held_out(docs[doc_id]).alias("held_out"), text_of(docs, text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, BLOCK):
            hashed, sizes = [], []
            for piece in slices([part], SLICE):
                one, bounds = _tokens(piece.column(2))
                hashed.append(one)
                sizes.append(np.diff(bounds))
            size = np.concatenate(sizes)
            words, at = np.unique(np.concatenate(hashed).view(np.uint64), return_inverse=True)
            learnt = np.repeat(~np.asarray(part.column(1)), size)
            counts = np.bincount(at[learnt], minlength=len(words)).astype(np.int64)
            lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(k)) for k in (0, 1)]
            packed = [_pack([x]) for x in (np.concatenate([[0], np.cumsum(size)]).astype(np.int64), at.astype(np.int32), words, counts)]
            yield pa.RecordBatch.from_arrays([*lists, *packed, pa.array([len(words)]), pa.array([int(counts.sum())])], names=["doc_ids", "held_out", "bounds", "tokens", "words", "counts", "n_words", "n_train"])

    schema = "doc_ids array<long>, held_out array<boolean>, bounds binary, tokens binary, words binary, counts binary, n_words long, n_train long"
    return rows.mapInArrow(run, schema).withColumn("block", F.monotonically_increasing_id())


def bends(words: np.ndarray, states: int) -> np.ndarray:
    """A fixed pseudo-random factor between 0.5 and 1.5 for each word and state."""
    return np.stack([0.5 + (mix(words ^ mix(np.full(1, 7 + z, np.uint64))) >> np.uint64(11)) / float(1 << 53) for z in range(states)], axis=1)


INDEX = "part int, block long, at binary, n binary, counts binary, sums array<double>"


def index(packed: DataFrame, bits: int, states: int) -> DataFrame:
    """Rows of two kinds for each of ``2 ** bits`` parts of the hashes.

    One row without a block: how often each training word occurs (``n``), its first expected ``counts`` by
    state, in single precision as they are sent about, and their ``sums``. A row for each block: the places of its words among them, -1 for words that
    training has not seen.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, counts = _read(batch.column(1)[i], np.uint64), _read(batch.column(2)[i], np.int64)
                part = (words >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(words), np.int64)
                parts, first = np.unique(part, return_index=True)
                cut = [slice(a, b) for a, b in zip(first, [*first[1:], len(words)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.repeat(batch.column(0)[i], len(parts)), _pack([words[c] for c in cut]), _pack([counts[c] for c in cut])], names=["part", "block", "words", "counts"])

    def build(rows: pa.Table) -> pa.Table:
        asked = [_read(x, np.uint64) for x in rows.column("words")]
        words, at = np.unique(np.concatenate(asked), return_inverse=True)
        n = np.rint(np.bincount(at, np.concatenate([_read(x, np.int64) for x in rows.column("counts")]), len(words))).astype(np.int64)
        known = n > 0
        place = np.where(known, np.cumsum(known) - 1, -1).astype(np.int32)[at]
        counts = (n[known, None] * bends(words[known], states)).astype(np.float32)
        places = np.split(place, np.cumsum([len(x) for x in asked])[:-1])
        none = [None] * len(asked)
        columns = [pa.repeat(rows.column("part")[0], 1 + len(asked)), pa.array([None, *rows.column("block").to_pylist()], pa.int64()), _pack([None, *places]), _pack([n[known], *none]), _pack([counts, *none]), pa.array([counts.sum(0, dtype=np.float64).tolist(), *none], pa.list_(pa.float64()))]
        return pa.Table.from_arrays(columns, names=["part", "block", "at", "n", "counts", "sums"])

    dealt = packed.select("block", "words", "counts").mapInArrow(deal, "part int, block long, words binary, counts binary")
    return dealt.groupBy("part").applyInArrow(build, INDEX)


class Model:
    """Start, transition and emission probabilities (emission: words by states)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, counts: np.ndarray, states: int = STATES) -> Model:
        """Word frequencies, bent a little for each state by a fixed pseudo-random factor."""
        emit = (counts[:, None] + PRIOR) * bends(np.arange(len(counts), dtype=np.uint64), states)
        move = np.full((states, states), 0.2 / max(1, states - 1))
        np.fill_diagonal(move, 0.8 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(0))

    @classmethod
    def of_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        start, move, emit = start + PRIOR, move + PRIOR, emit + PRIOR
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _segments(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First token, length and row of each segment, longest first."""
    size = np.diff(bounds)
    many = -(-size // SEGMENT)
    row = np.repeat(np.arange(len(size)), many)
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    start = bounds[:-1][row] + step * SEGMENT
    length = np.minimum(SEGMENT, bounds[1:][row] - start)
    order = np.argsort(-length, kind="stable")
    return start[order], length[order], row[order]


def _products(model: Model, classes: np.ndarray, start: np.ndarray, length: np.ndarray, begun: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each segment's scaled matrix from the state before it to the state at its end, and the log of the scale.

    Segments are given longest first; the ones that are ``begun`` are a text's first, whose first token is not moved to.
    """
    states = len(model.start)
    product, logs = np.empty((len(start), states, states)), np.zeros(len(start))
    for at in range(0, len(start), LANES):
        s, n, new = start[at : at + LANES], length[at : at + LANES], begun[at : at + LANES]
        m = np.broadcast_to(np.eye(states), (len(s), states, states)).copy()
        for t in range(int(n[0])):
            k = int(np.searchsorted(-n, -t, side="left"))
            moved = (m[:k].reshape(-1, states) @ model.move).reshape(k, states, states)
            if t == 0:
                moved[new[:k]] = np.eye(states)
            m[:k] = moved * model.emit[classes[s[:k] + t]][:, None, :]
            if t % 8 == 7:
                size = m[:k].max(axis=(1, 2))
                m[:k] /= size[:, None, None]
                logs[at : at + k] += np.log(size)
        product[at : at + LANES] = m
    return product, logs


def _steps(row: np.ndarray) -> list[np.ndarray]:
    """Places of the first, second, ... segments of all rows; ``row`` is in rising order."""
    step = np.arange(len(row)) - np.searchsorted(row, row)
    order = np.argsort(step, kind="stable")
    return np.split(order, np.searchsorted(step[order], np.arange(1, int(step.max(initial=0)) + 1)))


def _messages(model: Model, classes: np.ndarray, start: np.ndarray, length: np.ndarray, row: np.ndarray, begun: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each segment the state distribution before it (zero for a text's first) and the weight of what follows it."""
    states = len(model.start)
    before, after = np.zeros((len(start), states)), np.ones((len(start), states))
    some = np.flatnonzero(np.bincount(row)[row] > 1) if len(row) else np.zeros(0, np.int64)
    if not len(some):
        return before, after
    product, _ = _products(model, classes, start[some], length[some], begun[some])
    order = np.argsort(start[some], kind="stable")
    place, product = some[order], product[order]
    steps = _steps(row[place])
    for following in steps[1:]:
        at = following - 1
        v = np.einsum("ns,nst->nt", np.where(begun[place[at], None], model.start, before[place[at]]), product[at])
        before[place[following]] = v / v.sum(1, keepdims=True)
    for at in steps[:0:-1]:
        v = np.einsum("nst,nt->ns", product[at], after[place[at]])
        after[place[at - 1]] = v / v.sum(1, keepdims=True)
    return before, after


def expected(model: Model, classes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of starts, moves and emissions of whole texts, and their log likelihood."""
    states = len(model.start)
    start, length, row = _segments(bounds)
    begun = start == bounds[:-1][row]
    before, after = _messages(model, classes, start, length, row, begun)
    first, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((len(model.emit), states))
    total = 0.0
    for at in range(0, len(start), LANES):
        s, n, new, came = start[at : at + LANES], length[at : at + LANES], begun[at : at + LANES], before[at : at + LANES]
        longest = int(n[0])
        live = np.searchsorted(-n, -np.arange(longest), side="left")  # segments of over t tokens
        alpha = np.zeros((longest, len(s), states))
        scale = np.ones((longest, len(s)))
        seen = []
        for t in range(longest):
            k = live[t]
            c = classes[s[:k] + t]
            b = model.emit[c]
            a = (alpha[t - 1, :k] @ model.move if t else np.where(new[:, None], model.start, came @ model.move)) * b
            scale[t, :k] = a.sum(1)
            alpha[t, :k] = a / scale[t, :k, None]
            seen.append((c, b))
        total += float(np.log(scale).sum())
        beta = after[at : at + LANES]
        beta = beta / (alpha[n - 1, np.arange(len(s))] * beta).sum(1, keepdims=True)
        gammas, places = [], []
        for t in range(longest - 1, -1, -1):
            k = live[t]
            c, b = seen[t]
            gammas.append(alpha[t, :k] * beta[:k])
            places.append(c)
            pull = b * beta[:k] / scale[t, :k, None]
            move += model.move * ((alpha[t - 1, :k] if t else came).T @ pull)
            beta[:k] = pull @ model.move.T
        first += gammas[-1][new].sum(0)
        gamma, place = np.concatenate(gammas), np.concatenate(places)
        for z in range(states):
            emit[:, z] += np.bincount(place, gamma[:, z], len(emit))
    return first, move, emit, total


def log_likelihood(model: Model, classes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Exact log likelihood of each row: its segments' matrices, scaled, applied one after the other."""
    rows = len(bounds) - 1
    start, length, row = _segments(bounds)
    product, logs = _products(model, classes, start, length, start == bounds[:-1][row])
    order = np.argsort(start, kind="stable")
    product, logs, row = product[order], logs[order], row[order]
    out = np.zeros(rows)
    vector = np.tile(model.start, (rows, 1))
    for at in _steps(row):
        r = row[at]
        v = np.einsum("ns,nst->nt", vector[r], product[at])
        size = v.sum(1)
        vector[r] = v / size[:, None]
        out[r] += np.log(size) + logs[at]
    return out


def _answers(table: DataFrame, asked: DataFrame, states: int) -> DataFrame:
    """For each block and part the places, training counts and expected counts of the words that the block asks for.

    One count, dealt over the states, is kept for words that training has not seen.
    """
    unseen = np.full((1, states), 1 / states, np.float32)

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        if asked.num_rows:
            n = np.append(_read(held.column("n")[0], np.int64), 0)
            counts = np.concatenate([_read(held.column("counts")[0], np.float32, states), unseen])
            at = [_read(x, np.int32) for x in asked.column("at")]
            found = [_pack([n[x] for x in at]), _pack([counts[x] for x in at])]
        else:
            found = [_pack([]), _pack([])]
        return pa.Table.from_arrays([asked.column("part"), asked.column("block"), asked.column("at"), *found], names=["part", "block", "at", "n", "counts"])

    return asked.groupBy("part").cogroup(table.groupBy("part")).applyInArrow(run, "part int, block long, at binary, n binary, counts binary")


def _emissions(counts: list[np.ndarray], sums: np.ndarray, n_words: int) -> np.ndarray:
    """Probabilities of a block's words in each state: over all words and the unseen one they add up to one."""
    return (np.concatenate(counts).astype(np.float64) + PRIOR) / (sums + 1 / len(sums) + PRIOR * (n_words + 1))


def _met(answers: pa.Table, column: str, kind: type, *shape: int) -> list[np.ndarray]:
    """A column of a block's answers, in the order of the block's words."""
    return [_read(x, kind, *shape) for x in answers.column(column)]


def _round(packed: DataFrame, table: DataFrame, asked: DataFrame, model: Model, sums: np.ndarray, n_words: int) -> DataFrame:
    """The table with the expected counts under the present one; part -1 sums up starts and moves."""
    start, move, states = model.start, model.move, len(model.start)

    def learn(block: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("part")
        held = _met(answers, "counts", np.float32, states)
        bounds, tokens = _read(block.column("bounds")[0], np.int64), _read(block.column("tokens")[0], np.int32)
        learnt = ~np.asarray(block.column("held_out")[0].values, dtype=bool)
        size = np.diff(bounds)
        first, moves, counts, _ = expected(Model(start, move, _emissions(held, sums, n_words)), tokens[np.repeat(learnt, size)], np.concatenate([[0], np.cumsum(size[learnt])]).astype(np.int64))
        pieces = np.split(counts.astype(np.float32), np.cumsum([len(x) for x in held])[:-1])
        summed = np.concatenate([first, moves.ravel()]).tolist()
        columns = [pa.array([-1, *answers.column("part").to_pylist()], pa.int32()), pa.array([None, *answers.column("at").to_pylist()], pa.binary()), _pack([None, *pieces]), pa.array([summed, *[None] * len(pieces)], pa.list_(pa.float64()))]
        return pa.Table.from_arrays(columns, names=["part", "at", "counts", "sums"])

    def add(held: pa.Table, sent: pa.Table) -> pa.Table:
        names = ["part", "n", "counts", "sums"]
        if not held.num_rows or held.column("part")[0].as_py() < 0:
            summed = np.sum(sent.column("sums").to_pylist(), axis=0).tolist()
            return pa.Table.from_arrays([pa.array([-1], pa.int32()), _pack([None]), _pack([None]), pa.array([summed], pa.list_(pa.float64()))], names=names)
        counts = np.zeros((len(_read(held.column("n")[0], np.int64)), states))
        for at, value in zip(sent.column("at"), sent.column("counts"), strict=True):
            at, value = _read(at, np.int32), _read(value, np.float32, states)
            counts[at[at >= 0]] += value[at >= 0]  # a block names each word once
        counts = counts.astype(np.float32)
        return pa.Table.from_arrays([held.column("part"), held.column("n"), _pack([counts]), pa.array([counts.sum(0, dtype=np.float64).tolist()], pa.list_(pa.float64()))], names=names)

    answers = _answers(table, asked, states).select("part", "block", "at", "counts")
    sent = packed.select("block", "held_out", "bounds", "tokens").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(learn, "part int, at binary, counts binary, sums array<double>")
    return table.groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(add, "part int, n binary, counts binary, sums array<double>")


def _sums(table: DataFrame) -> tuple[np.ndarray, np.ndarray | None]:
    """Expected counts of each state over all parts, and the sums of starts and moves; a short row for each part."""
    rows = table.select("part", "sums").collect()
    return np.sum([r.sums for r in rows if r.part >= 0], axis=0), next((np.array(r.sums) for r in rows if r.part < 0), None)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row.

    ``base_score`` is the add-one unigram model's log10 likelihood, ``score`` the hidden Markov model's.
    A null or empty text is its end token alone. Rows that share an id are scored each by its own text.
    Without training rows every word is unknown and has probability one.
    """
    spark = docs.sparkSession
    packed = materialise(blocks(docs, doc_id, text), "blocks")
    whole = packed.agg(F.sum("n_words").alias("asked"), F.sum("n_train").alias("n")).first()
    n_train, bits = int(whole.n or 0), max(0, (int(whole.asked or 0) - 1) // (ASKED * FREQUENT)).bit_length()
    both = materialise(index(packed, bits, states), "index")
    asked, table = both.filter("block IS NOT NULL").select("part", "block", "at"), both.filter("block IS NULL").select("part", "n", "counts", "sums")
    n_words = int(table.agg(F.sum(F.octet_length("n") / 8)).first()[0] or 0)
    model = Model.first(np.zeros(1), states)
    sums = _sums(table)[0] if n_train else np.zeros(states)
    before = Scratch(spark)
    for _ in range(rounds if n_train else 0):
        with before:  # the round's own table replaces it
            mine = Scratch(spark)
            table = materialise(_round(packed, table, asked, model, sums, n_words), "emissions", scratch=mine)
        before = mine
        sums, moved = _sums(table)
        model = Model.of_counts(moved[:states], moved[states:].reshape(states, states), np.zeros((1, states)))
    start, move, per_token = model.start, model.move, n_train + n_words + 1

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("part")
        now = Model(start, move, _emissions(_met(answers, "counts", np.float32, states), sums, n_words))
        n = np.concatenate(_met(answers, "n", np.int64))
        bounds, tokens = _read(block.column("bounds")[0], np.int64), _read(block.column("tokens")[0], np.int32)
        size = np.diff(bounds)
        row = np.repeat(np.arange(len(size)), size)
        known = np.bincount(row, n[tokens] > 0, len(size)).astype(np.int64)
        base = np.bincount(row, np.log10((n + 1) / per_token)[tokens], len(size))
        columns = [block.column("doc_ids")[0].values, block.column("held_out")[0].values, pa.array(size), pa.array(known), pa.repeat(pa.scalar(n_train, pa.int64()), len(size)), pa.array(base), pa.array(log_likelihood(now, tokens, bounds) / np.log(10))]
        return pa.Table.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    answers = _answers(table, asked, states).select("part", "block", "n", "counts")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return packed.select("block", "doc_ids", "held_out", "bounds", "tokens").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
