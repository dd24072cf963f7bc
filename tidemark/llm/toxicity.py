"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; each model sees the words of a text and the
probabilities of the categories before it. In training those probabilities are out of fold: they come
from models that have not seen the document, so that a later model can trust them as they will be.
A word's feature is the log of how much more often it stands in documents of the category than in
others; logistic models weigh these features. Where a category begins (its least probability) is chosen
on the out-of-fold probabilities too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import word_bounds, word_hashes
from .common import flat, id_and_bytes, materialise, slices, text_of

#: Labelled documents that the chain is fitted to at most: those with the least hashes of their ids.
SAMPLE = 20_000
FOLDS, PENALTY = 5, 1.0
#: Steps of a fit at most, and the relative gain below which it has converged.
STEPS, CONVERGED = 200, 1e-6
#: Pairs that the quasi-Newton steps remember.
MEMORY = 8
#: Words that a fit looks at together.
BLOCK = 1 << 19
#: Categories in the chain's order, and how each follows from ``labels``.
CATEGORIES = [("low_quality", "quality = 0"), ("toxic", "toxic = 1")]

_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[97:123] = _LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different words of each row, in rising order, and the row bounds.

    Words are runs of ASCII letters, in lower case, and of characters beyond ASCII.
    """
    data, offsets = flat(col)
    letters = _LETTER[data]
    starts, ends, bounds = word_bounds(letters, offsets)
    hashed = word_hashes(letters, starts, ends)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashed, row))
    hashed, row = hashed[order], row[order]
    new = np.concatenate([[True], (hashed[1:] != hashed[:-1]) | (row[1:] != row[:-1])])[: len(hashed)]
    return hashed[new], np.searchsorted(row[new], np.arange(len(bounds)))


class Model:
    """Weights of words (by rising hash), of the categories before and of nothing at all."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, before: np.ndarray, bias: float):
        self.hashes, self.weights, self.before, self.bias = hashes, weights, before, bias

    def probabilities(self, hashed: np.ndarray, bounds: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Of rows with the different words ``hashed`` and a column of ``before`` for each category before."""
        weight = np.zeros(len(hashed))
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
            weight = np.where(self.hashes[at] == hashed, self.weights[at], 0.0)
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        return _sigmoid(np.bincount(row, weight, len(bounds) - 1) + before @ self.before + self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _row_blocks(bounds: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows with about ``BLOCK`` words each, or one row; the fit's temporary arrays are of this size."""
    cuts = [0]
    while cuts[-1] < len(bounds) - 1:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(bounds, bounds[cuts[-1]] + BLOCK, side="right")) - 1))
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def fit_model(hashed: np.ndarray, bounds: np.ndarray, before: np.ndarray, label: np.ndarray) -> Model:
    """The logistic model with the least penalised loss; without rows all weights are 0."""
    n, extra = len(label), before.shape[1]
    if not n:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(extra), 0.0)
    hashes, lengths, blocks = np.unique(hashed), np.diff(bounds), _row_blocks(bounds)
    size = len(hashes)
    word = np.empty(len(hashed), np.int32)
    for a, b in blocks:
        word[bounds[a] : bounds[b]] = np.searchsorted(hashes, hashed[bounds[a] : bounds[b]])

    def by_row(weight: np.ndarray) -> np.ndarray:
        parts = [np.bincount(np.repeat(np.arange(b - a), lengths[a:b]), weight[word[bounds[a] : bounds[b]]], b - a) for a, b in blocks]
        return np.concatenate(parts)

    def by_word(value: np.ndarray) -> np.ndarray:
        total = np.zeros(size)
        for a, b in blocks:
            total += np.bincount(word[bounds[a] : bounds[b]], np.repeat(value[a:b], lengths[a:b]), size)
        return total

    many, yes = by_word(np.ones(n)), by_word(label)
    ratio = np.log((yes + 0.5) / (label.sum() + 1)) - np.log((many - yes + 0.5) / (n - label.sum() + 1))
    penalty = np.concatenate([np.full(size, PENALTY), np.full(extra + 1, 1e-3)])

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = by_row(ratio * w[:size]) + before @ w[size:-1] + w[-1]
        away = _sigmoid(z) - label
        gradient = np.concatenate([ratio * by_word(away), before.T @ away, [away.sum()]]) + penalty * w
        return float((np.logaddexp(0, z) - label * z).sum() + 0.5 * (penalty * w * w).sum()), gradient

    w = _least(loss, np.zeros(size + extra + 1))
    return Model(hashes, ratio * w[:size], w[size:-1], float(w[-1]))


def _least(loss, w: np.ndarray) -> np.ndarray:
    """Where a smooth convex function is least: quasi-Newton steps of limited memory, halved until they gain."""
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    now, slope = loss(w)
    for _ in range(STEPS):
        way, held = slope.copy(), []
        for s, y, r in reversed(steps):
            held.append(r * (s @ way))
            way -= held[-1] * y
        way *= 1 / (steps[-1][2] * (steps[-1][1] @ steps[-1][1])) if steps else 1 / max(1.0, float(np.linalg.norm(slope)))
        for (s, y, r), a in zip(steps, reversed(held), strict=True):
            way += s * (a - r * (y @ way))
        length, gain = 1.0, float(slope @ way)
        while True:
            there, new = loss(w - length * way)
            if there <= now - 1e-4 * length * gain or length < 1e-9:
                break
            length /= 2
        s, y = -length * way, new - slope
        w = w + s
        if s @ y > 1e-12:
            steps = [*steps, (s, y, 1 / float(s @ y))][-MEMORY:]
        close = now - there <= CONVERGED * max(abs(now), 1.0)
        now, slope = there, new
        if close:
            break
    return w


_FITTED = "id long, p double, hashes binary, weights binary, before array<double>, bias double"


def _folds(rows: DataFrame, at: int) -> DataFrame:
    """A fit for each fold without its rows, which it then predicts, and one (``hashes`` is set) with all rows."""

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("id")
        fold = part.column("part")[0].as_py()
        learnt = np.asarray(part.column("fold")) != fold
        label = np.asarray(part.column("y").combine_chunks().flatten()).reshape(part.num_rows, -1)[:, at].astype(float)
        before = np.asarray(part.column("ps").combine_chunks().flatten()).reshape(part.num_rows, at).astype(float)
        raw, offsets = flat(part.column("words").combine_chunks())
        hashed, size = raw.view(np.uint64), np.diff(offsets) // 8

        def chosen(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return hashed[np.repeat(which, size)], np.concatenate([[0], np.cumsum(size[which])]), before[which]

        model = fit_model(*chosen(learnt), label[learnt])
        if fold < 0:
            columns = [[None], [None], [model.hashes.tobytes()], [model.weights.tobytes()], [model.before.tolist()], [model.bias]]
        else:
            ids = part.column("id").filter(pa.array(~learnt)).to_pylist()
            none = [None] * len(ids)
            columns = [ids, model.probabilities(*chosen(~learnt)).tolist(), none, none, none, none]
        kinds = [pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.float64()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _FITTED.split(", ")])

    every = rows.withColumn("part", F.explode(F.sequence(F.lit(-1), F.lit(FOLDS - 1))))
    return every.groupBy("part").applyInArrow(run, _FITTED)


def begins(p: np.ndarray, label: np.ndarray) -> float:
    """The least probability of the category: where precision and recall on ``label`` have the greatest harmonic mean.

    Half way to the next probability below; 0.5 where there is nothing to tell apart.
    """
    if not label.any() or label.all():
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, hit = p[order], np.cumsum(label[order])
    last = np.concatenate([p[1:] != p[:-1], [True]])  # equal probabilities are on one side
    score = np.where(last, 2 * hit / (np.arange(1, len(p) + 1) + label.sum()), 0)
    k = int(np.argmax(score))
    return float((p[k] + (p[k + 1] if k + 1 < len(p) else 0.0)) / 2)


class Chain:
    """Fitted models in the order of their categories, and where each category begins."""

    def __init__(self, names: list[str], models: list[Model], least: list[float]):
        self.names, self.models, self.least = names, models, least

    def predict(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """``doc_id`` and a column ``p_<category>`` for each category."""
        names, held = [f"p_{x}" for x in self.names], docs.sparkSession.sparkContext.broadcast(self.models)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, 2 << 20):
                hashed, bounds = words(part.column(1))
                known = np.zeros((part.num_rows, 0))
                for model in held.value:
                    known = np.column_stack([known, model.probabilities(hashed, bounds, known)])
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(known[:, k]) for k in range(len(names))]], names=["doc_id", *names])

        return id_and_bytes(docs, doc_id, text).mapInArrow(run, ", ".join(["doc_id long", *[f"{x} double" for x in names]]))


def labelled(docs: DataFrame, labels: DataFrame, categories: list[tuple[str, str]], doc_id: str, text: str, sample: int) -> DataFrame:
    """``id``, ``words`` (hashes), ``y`` (a label for each category), ``ps`` (no probabilities yet) and ``fold`` of at most ``sample`` ids."""
    names = [f"y_{x}" for x, _ in categories]
    marked = labels.select(labels[doc_id].cast("long").alias("id"), *[F.coalesce(F.expr(rule), F.lit(False)).cast("int").alias(f"y_{x}") for x, rule in categories])
    marked = marked.filter("id IS NOT NULL").groupBy("id").agg(*[F.max(x).alias(x) for x in names])
    body = docs.select(docs[doc_id].cast("long").alias("id"), text_of(docs, text).alias("body"))
    chosen = marked.join(body.select("id"), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(sample)
    one = body.join(F.broadcast(chosen.select("id")), "id", "left_semi").groupBy("id").agg(F.min("body").alias("body"))
    fold = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(FOLDS)).cast("int")
    rows = one.join(F.broadcast(chosen), "id").select("id", F.col("body").cast("binary").alias("body"), F.array(*names).alias("y"), fold.alias("fold"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2 << 20, "body"):
            hashed, bounds = words(part.column(1))
            cut = [hashed[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            none = pa.ListArray.from_arrays(pa.array(np.zeros(part.num_rows + 1, np.int32)), pa.array([], pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cut, pa.binary()), part.column(2), none, part.column(3)], names=["id", "words", "y", "ps", "fold"])

    return rows.mapInArrow(run, "id long, words binary, y array<int>, ps array<double>, fold int")


def fit(docs: DataFrame, labels: DataFrame, categories: list[tuple[str, str]] | None = None, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Chain | None:
    """A chain fitted to at most ``sample`` labelled documents; none if no document is labelled.

    ``categories`` are names with conditions on the columns of ``labels``. A category whose condition
    is null for a document is taken as false; labels that repeat an id count as true if any is; of
    documents that share an id the least text is taken, so that the sample has its bound. A task
    that fits has the different words of the sample.
    """
    categories = categories or CATEGORIES
    rows = materialise(labelled(docs, labels, categories, doc_id, text, sample), "labelled")
    if rows.isEmpty():
        return None
    models, least = [], []
    for k in range(len(categories)):
        fitted = materialise(_folds(rows, k), "folds")
        m = fitted.filter("hashes IS NOT NULL").first()
        models.append(Model(np.frombuffer(m.hashes, np.uint64), np.frombuffer(m.weights, np.float64), np.array(m.before, np.float64), m.bias))
        out = fitted.filter("hashes IS NULL").select("id", "p")
        known = rows.join(out, "id").select("p", F.col("y")[k].alias("y")).toArrow()  # two numbers for each of the sample
        least.append(begins(np.asarray(known.column("p")), np.asarray(known.column("y")).astype(bool)))
        if k + 1 < len(categories):
            rows = materialise(rows.join(out, "id").select("id", "words", "y", F.concat("ps", F.array("p")).alias("ps"), "fold"), "out-of-fold")
    return Chain([x for x, _ in categories], models, least)


def score(docs: DataFrame, labels: DataFrame, categories: list[tuple[str, str]] | None = None, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``doc_id`` and ``p_<category>`` of every row, and ``<category>``: whether it is one by its probability.

    A null or empty text has no words and gets what the models say of none. Without any labelled
    document all are null. Rows that share an id, null ids among them, are scored each by its own text.
    """
    names = [x for x, _ in categories or CATEGORIES]
    chain = fit(docs, labels, categories, doc_id, text, sample)
    if chain is None:
        scored = docs.select(docs[doc_id].cast("long").alias("doc_id"), *[F.lit(None).cast("double").alias(f"p_{x}") for x in names])
    else:
        scored = chain.predict(docs, doc_id, text)
    least = chain.least if chain else [0.5] * len(names)
    return scored.select("doc_id", *[f"p_{x}" for x in names], *[(F.col(f"p_{x}") >= t).alias(x) for x, t in zip(names, least, strict=True)])
