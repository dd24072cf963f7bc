"""Incremental substring dedup with a log-structured index of window fingerprints.

Documents come in batches in the order of their ids. What is known of earlier batches lies in sorted
immutable runs (tables bucketed and sorted by fingerprint). A batch is merge-joined with every run,
candidate windows are verified against both texts, and the batch's own fingerprints become a new run;
when there are too many runs they are compacted into one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import IDENTITY, anchors, covered, identified, windows, with_lists, word_bounds, word_hashes
from .common import Scratch, flat, materialise, shuffles_dropped, slices, text_of

#: Words of a window, and words of the strings that anchors are chosen from.
WIDTH, GRAM = 20, 8
#: Batches that a whole table is taken in, and runs that are kept before they are compacted: the second run is.
BATCHES, MOST_RUNS = 3, 1



def _earliest() -> list[Column]:
    """The first document of rows that are grouped."""
    return [F.min("doc").alias("doc"), F.min_by("th", "doc").alias("th")]


def _units(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat(col)
    starts, ends, bounds = word_bounds(data, offsets)
    return word_hashes(data, starts, ends), bounds


class Index:
    """The runs of one corpus; rows are ``key``, ``ctx`` and the first document (``doc``, ``th``) that had them."""

    def __init__(self, spark: SparkSession, most_runs: int = MOST_RUNS):
        self.spark, self.most_runs, self.runs = spark, most_runs, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def add(self, rows: DataFrame) -> None:
        """Write ``rows`` as a run; compact all runs into one when there are more than ``most_runs``."""
        self._write(rows)
        if len(self.runs) > self.most_runs:
            self.compact()

    def _write(self, rows: DataFrame) -> None:
        name = f"tidemark_run_{uuid.uuid4().hex}"
        with shuffles_dropped(self.spark):
            rows.select("key", "ctx", "doc", "th").repartition(self.buckets, "key").write.option("compression", "zstd").bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name)
        self.runs.append(name)

    def compact(self) -> None:
        """Merge all runs; of equal fingerprints the earliest document stays."""
        old, self.runs = self.runs, []
        self._write(self._all(old).groupBy("key", "ctx").agg(*_earliest()))
        for name in old:
            self.spark.sql(f"DROP TABLE {name}")

    def _all(self, names: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.table(x) for x in names])

    def matching(self, keys: DataFrame) -> DataFrame:
        """The rows of all runs that have one of the (distinct) ``keys``: a merge join with each run."""
        return reduce(DataFrame.unionByName, [self.spark.table(x).hint("merge").join(keys, "key", "left_semi") for x in self.runs])

    def drop(self) -> None:
        for name in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.runs = []


def repeated(seen: DataFrame, batch: DataFrame, index: Index, grow: bool = True) -> DataFrame:
    """Runs of windows (``doc``, ``th``, ``lo``, ``hi``) of ``batch`` that also start earlier.

    ``batch`` and ``seen`` (it and all that the index has) are ``identified`` rows; with ``grow`` the
    batch's fingerprints become a run of the index.
    """
    with Scratch(batch.sparkSession) as news, Scratch(batch.sparkSession) as scratch:
        own = materialise(anchors(batch, WIDTH, GRAM, _units), "anchors", scratch=scratch)
        place = ["doc", "th", "lo", "hi"]
        mine = own.filter("NOT again").groupBy("key", "ctx").agg(*_earliest(), F.count("*").alias("n"))
        if index.runs:
            mine = materialise(mine, "fingerprints", scratch=scratch)
            known = index.matching(mine.select("key").distinct())
            both = mine.withColumn("old", F.lit(False)).unionByName(known.withColumns({"n": F.lit(1).cast("long"), "old": F.lit(True)}))
            both = both.groupBy("key", "ctx").agg(*_earliest(), F.sum("n").alias("n"), F.max("old").alias("old"))
        else:
            both = mine.withColumn("old", F.lit(False))
        both = materialise(both, "merged", scratch=news)
        # The same run with the same surroundings: all but the first go.
        often = both.filter("n > 1").select("key", "ctx", F.col("doc").alias("first"), F.col("th").alias("first_th"))
        met = own.join(often, ["key", "ctx"]).filter("doc > first OR doc = first AND th <> first_th")
        met = materialise(met.select(*place, "key", "ctx", "first"), "met", scratch=scratch)
        gone, tied = met.filter("doc > first").select(*place), met.filter("doc = first").select("doc", "th", "key", "ctx").distinct()
        # The same anchor with other surroundings: the windows of the first of each (of all texts, where its id has
        # more than one) are compared one by one.
        mixed = both.groupBy("key").agg(F.min("ctx").alias("a"), F.max("ctx").alias("b")).filter("a <> b").select("key")
        asked = both.select("doc", "th", "key", "ctx").unionByName(tied).join(mixed, "key", "left_semi")
        held = materialise(windows(with_lists(seen, asked, "ask", "inner"), WIDTH, GRAM, _units), "windows", scratch=scratch)
        span = [F.col("start").alias("lo"), F.col("start").alias("hi")]
        twice = held.groupBy("w1", "w2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select("w1", "w2", "first")
        later = held.join(twice, ["w1", "w2"]).filter("doc > first").select("doc", "th", *span)
        found = gone.unionByName(own.filter("again").select(*place)).unionByName(later).unionByName(held.filter("again").select("doc", "th", *span))
        found = materialise(found, "repeated")
        scratch.clear()  # before runs are merged, which takes disk of its own
        if grow:  # what the index has already would only be news in an earlier document
            index.add(both.filter("NOT old"))
        return found


def _kept(with_spans: DataFrame) -> DataFrame:
    """``n_words``, ``n_removed`` and ``kept``, what is left: the words joined by a space, or null where nothing goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2 << 20):
            data, offsets = flat(part.column(2))
            starts, ends, bounds = word_bounds(data, offsets)
            whole = data.tobytes()
            removed, kept = [], []
            for k, spans in enumerate(part.column(3)):
                s, e = starts[bounds[k] : bounds[k + 1]], ends[bounds[k] : bounds[k + 1]]
                if spans.is_valid and len(spans):
                    lo, hi = (np.asarray(spans.values.field(j), dtype=np.int64) for j in (0, 1))
                    stay = ~covered(lo, hi + WIDTH, len(s))
                    removed.append(len(s) - int(stay.sum()))
                    s, e = s[stay], e[stay]
                else:
                    removed.append(0)
                kept.append(b" ".join([whole[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(bounds)), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc", "th", "n_words", "n_removed", "kept"])

    return with_spans.select("doc", "th", "text", "spans").mapInArrow(run, f"{IDENTITY}, n_words long, n_removed long, kept binary")


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """``doc``, ``th``, ``lo``, ``hi``: all runs of windows of ``docs`` that also start earlier.

    The table is taken in ``batches`` of about as many ids, in their order.
    """
    source = identified(docs, doc_id, text)
    spark = docs.sparkSession
    cuts = source.agg(F.percentile_approx("doc", [k / batches for k in range(1, batches)], 10_000).alias("c")).first().c or []
    edges = sorted({int(c) for c in cuts})
    index, found = Index(spark), None
    try:
        for k in range(len(edges) + 1):
            seen = source.filter(F.col("doc") <= edges[k]) if k < len(edges) else source
            batch = seen.filter(F.col("doc") > edges[k - 1]) if k else seen
            one = repeated(seen, batch, index, grow=k < len(edges))
            found = one if found is None else found.unionByName(one)
    finally:
        index.drop()
    return found


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (bytes: the words left, joined by one space) of every row.

    A word goes if a window of ``WIDTH`` words that covers it also starts earlier: in a document with a
    smaller id (a null id is the largest; rows that share an id lose nothing to each other) or earlier
    in the same one. A null or empty text and one of fewer words loses nothing.
    """
    source = identified(docs, doc_id, text)
    spans = removals(docs, doc_id, text, batches)
    out = _kept(with_lists(source, spans, "spans", "left"))
    return out.select(F.when(F.col("doc") < (1 << 63) - 1, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept")


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated words taken out of ``text``; a text that loses none stays as it is.

    ``n_chars`` follows the text where there is such a column. All rows stay, with their columns.
    """
    spans = removals(docs, doc_id, text).groupBy("doc", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    body = text_of_row(docs, doc_id, text)
    joined = body.join(spans, ["doc", "th"], "left")
    changed = _kept(joined.filter("spans IS NOT NULL").select("doc", "th", F.col("__text").cast("binary").alias("text"), "spans").dropDuplicates(["doc", "th"]))
    changed = materialise(changed.select("doc", "th", F.col("kept").cast("string").alias("__new")), "changed")
    out = body.join(changed, ["doc", "th"], "left")
    new = {text: F.coalesce("__new", F.col(f"__row.{text}"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("__new").isNull(), F.col("__row.n_chars")).otherwise(F.length("__new").cast(docs.schema["n_chars"].dataType))
    return out.select(*[new.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def text_of_row(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Each row as the struct ``__row`` with what it is known by and its text."""
    body = text_of(docs, text)
    return docs.select(F.struct("*").alias("__row"), F.coalesce(docs[doc_id].cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(body).alias("th"), body.alias("__text"))
