"""Substring, suffix-array and near-duplicate removal against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tidemark.llm import anchors, simhash, substring_dedup, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected_words(rows, width=20):
    """Kept words of each row by the definition: a window goes if it starts earlier in a smaller id or the same row."""
    order = sorted(((d if d is not None else 1 << 63, t or "") for d, *t in ((r[0], r[1]) for r in rows) for t in t), key=lambda x: x[0])
    first: dict[tuple, int] = {}
    for d, t in order:
        w = WORD.findall(t)
        for s in range(len(w) - width + 1):
            first.setdefault(tuple(w[s : s + width]), d)
    out = []
    for d, t in order:
        w = WORD.findall(t)
        gone, own = [False] * len(w), set()
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            if first[key] < d or key in own:
                gone[s : s + width] = [True] * width
            own.add(key)
        out.append((d if d < 1 << 63 else None, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_substrings(docs, rows, batches):
    got = substring_dedup.digests(substring_dedup.dedup(docs, batches=batches))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == expected_words(rows)


def test_substrings_of_an_empty_table(none):
    assert substring_dedup.dedup(none).count() == 0


def test_cleaned_rows_keep_their_columns(docs, rows):
    got = substring_dedup.clean(docs)
    assert got.columns == docs.columns and got.count() == len(rows)
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[5].text == rows[5][1] and by_id[0].text is None and by_id[5].n_chars == len(rows[5][1])
    assert by_id[7].text == "" and by_id[7].n_chars == 0


def test_index_grows_and_compacts(spark, docs):
    source = anchors.identified(docs)
    index = substring_dedup.Index(spark, most_runs=1)
    for k in range(4):
        substring_dedup.repeated(source.filter(f"doc < {6 * k + 6}"), source.filter(f"doc >= {6 * k} AND doc < {6 * k + 6}"), index)
    assert len(index.runs) == 1
    table = spark.table(index.runs[0])
    assert table.count() == table.select("key", "ctx").distinct().count() > 0
    index.drop()


def expected_bytes(rows, width=200):
    raws = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(t[s : s + width] for _, t in raws for s in range(len(t) - width + 1))
    out = []
    for d, t in raws:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - width + 1):
            if seen[t[s : s + width]] > 1:
                gone[s : s + width] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("most", [2048, 1])
def test_byte_strings(docs, rows, most, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_REGIONS", most)
    got = suffix_dedup.digests(suffix_dedup.dedup(docs))
    assert Counter(tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == expected_bytes(rows)


def test_byte_strings_of_an_empty_table(none):
    assert suffix_dedup.dedup(none).count() == 0


@pytest.mark.parametrize("letters", [1, 2, 20])
def test_statistics_of_the_transform(letters):
    rng = np.random.default_rng(letters)
    sizes = rng.integers(1, 60, 40)
    data = rng.integers(0, letters, sizes.sum()).astype(np.uint8)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    index = suffix_dedup.RunLengthIndex(data, offsets)
    got = index.statistics()
    assert index.lengths.sum() == len(data) and all(int(a) != int(b) or a < 0 for a, b in zip(index.letters[1:], index.letters[:-1], strict=True))
    regions = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    seen = Counter(r[i:j] for r in regions for i in range(len(r)) for j in range(i + 1, len(r) + 1))
    want = [max((n for n in range(len(r) - i + 1) if n == 0 or seen[r[i : i + n]] > 1)) for r in regions for i in range(len(r))]
    assert got.tolist() == want


def test_copies_lengthen_their_runs():
    rng = np.random.default_rng(9)
    sizes, copies = rng.integers(1, 40, 25), rng.integers(1, 4, 25)
    data = rng.integers(0, 2, sizes.sum()).astype(np.uint8)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    index = suffix_dedup.RunLengthIndex(data, offsets, copies)
    regions = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    seen = Counter()
    for r, n in zip(regions, copies, strict=True):
        for i in range(len(r)):
            for j in range(i + 1, len(r) + 1):
                seen[r[i:j]] += int(n)
    want = [max((n for n in range(len(r) - i + 1) if n == 0 or seen[r[i : i + n]] > 1)) for r in regions for i in range(len(r))]
    assert index.lengths.sum() == (sizes * copies).sum() and index.statistics().tolist() == want
    for width in (1, 5, 12):
        starts, stops = index.repeats(width)
        marked = np.zeros(len(data), bool)
        for a, b in zip(starts, stops, strict=True):
            marked[a : b + 1] = True
        assert marked.tolist() == [x >= width for x in want] and (starts[1:] > stops[:-1] + 1).all()


def test_null_ids_and_shared_ids(spark):
    """Rows without an id, and different texts under one id, keep their own spans."""
    rng = random.Random(2)
    some = [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(99)) for _ in range(rng.randrange(30, 90))) for _ in range(12)]
    rows = [(None if k % 3 else 7, some[k % 12] + (f" tail {k} " + some[(k * 5) % 12] if k % 2 else "")) for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.digests(substring_dedup.dedup(frame))
    assert Counter(tuple(r) for r in got.collect()) == expected_words(rows)
    got = suffix_dedup.digests(suffix_dedup.dedup(frame))
    assert Counter(tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == expected_bytes(rows)


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(anchors, "PIECE", 50)
    rng = np.random.default_rng(1)
    units = rng.integers(0, 9, 700).astype(np.uint64)
    bounds = np.array([0, 30, 30, 640, 700])
    got = {(int(r), s) for r, _, _, lo, hi in (tuple(x) for p in anchors.pieces(anchors.mix(units), bounds, 20, 6) for x in zip(*p, strict=True)) for s in range(lo, hi + 1)}
    assert got == {(r, s) for r, n in enumerate(np.diff(bounds)) for s in range(n - 19)}


def brute_simhash(text):
    words = WORD.findall((text or "").translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashed = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def test_fingerprints_and_components(docs, rows):
    got = Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.classes(docs).collect())
    prints = [(r[0], brute_simhash(r[1])) for r in rows]
    group = list(range(len(prints)))
    for _ in prints:
        for i, (_, a) in enumerate(prints):
            for j, (_, b) in enumerate(prints):
                if (a ^ b).bit_count() <= 4:
                    group[i] = group[j] = min(group[i], group[j])
    least = {g: min((d for (d, _), h in zip(prints, group, strict=True) if h == g and d is not None), default=None) for g in group}
    assert got == Counter((d, f, least[g]) for (d, f), g in zip(prints, group, strict=True))


def test_one_of_each_class_stays(docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {6, 7} & {r.doc_id for r in kept.collect()} == {6}


def test_one_row_of_each_class_whatever_its_id(spark):
    base = " ".join(f"w{k}" for k in range(90))
    rows = [(5, base, "a"), (5, base, "b"), (5, "something else entirely here", "c"), (None, base, "d"), (None, "all alone with no id", "e"), (None, "all alone with no id", "f"), (9, "x " * 100_000, "g"), (8, "x " * 100_000, "h"), (1, None, "i"), (2, "", "j")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, tag string").selectExpr("*", "1 AS fp", "2 AS n", "3 AS row", "4 AS root")
    got = simhash.keep_one(frame)
    tags = {r.tag for r in got.collect()}
    assert got.columns == frame.columns and len(tags & {"a", "b"}) == 1 and len(tags & {"e", "f"}) == 1 and tags - {"a", "b", "e", "f"} == {"c", "h", "i"} and got.count() == 5


def test_no_documents_no_classes(none):
    assert simhash.classes(none).count() == 0 and simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("radius", [0, 4, 6])
def test_bit_planes(radius):
    rng = random.Random(radius)
    centres = [rng.getrandbits(64) for _ in range(20)]

    def flipped(value):
        for _ in range(rng.randrange(5)):
            value ^= 1 << rng.randrange(64)
        return value

    values = np.array([flipped(rng.choice(centres)) for _ in range(333)], np.uint64)
    q, v = simhash.within(values[:50], values, radius)
    want = {(i, j) for i in range(50) for j in range(333) if int(values[i] ^ values[j]).bit_count() <= radius}
    assert set(zip(q.tolist(), v.tolist(), strict=True)) == want
    other = np.array([flipped(int(x)) if k % 3 else rng.getrandbits(64) for k, x in enumerate(values)], np.uint64)
    assert simhash.near(values, other, radius).tolist() == [int(x ^ y).bit_count() <= radius for x, y in zip(values, other, strict=True)]
    assert simhash.near(values[:1], values[:1] ^ np.uint64(255), radius).tolist() == [False]


def test_large_groups_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(6)]
    values = sorted({c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in centres for _ in range(30)})
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"))
    found = {r.node: r.root for r in simhash.components(edges.filter("a <> b")).collect()}
    label = {v: v for (v,) in signed}
    for _ in range(6):
        for (a,) in signed:
            for (b,) in signed:
                if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                    label[a] = label[b] = min(label[a], label[b])
    assert {v: found.get(v, v) for (v,) in signed} == label
