"""Alignment, fill-in-the-middle and binary records, against plain versions of what each must give."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PythonException
from tokenizers import Tokenizer

from tidemark.llm import alignment, fill_in_middle, records, units
from tidemark.llm.bpe import _byte_letters
from tidemark.llm.common import new_path

BYTES, PIECES, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
LETTERS = _byte_letters()
ODD = st.text(alphabet=st.sampled_from("aeTsz1'² \n\t.,=éßİ\x00\x1c\x85\xa0日🙂▁<|>"), max_size=120) | st.text(max_size=60)


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(WORDS)


def more(spark, rows, extra, columns):
    return spark.createDataFrame([*rows, *extra], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *columns)


# fill in the middle


def filled(doc_id, text):
    text = text or ""
    u = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    form = "plain" if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sizes = (None, None) if form == "plain" else (len(p), len(m))
    return doc_id, len(u), form, *sizes, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("chunk", [fill_in_middle.CHUNK, 700, 5, 1])
def test_fill_in_middle(spark, rows, chunk):
    rng = random.Random(1)
    extra = [(100 + k, "".join(rng.choice("<<PSM>ab é日\n") for _ in range(rng.randrange(60))), None, None, 0) for k in range(200)] + [(400, "word é " * 30_000, None, None, 0)] * (chunk > 5)
    got = Counter(tuple(r) for r in fill_in_middle.digests(fill_in_middle.transform(more(spark, rows, extra, ["1 AS h1", "2 AS n", "'x' AS form", "3 AS row"]), chunk=chunk)).collect())
    assert got == Counter(filled(r[0], r[1]) for r in [*rows, *extra])


def test_fill_in_middle_of_an_empty_table(none):
    assert fill_in_middle.transform(none).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("<PSM>aé1"), max_size=40), st.lists(st.integers(0, 80), max_size=6), st.integers(0, 10))
def test_chunks_compose_in_any_grouping(text, cuts, split):
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    bounds = np.array([0, *sorted(min(c, len(raw)) for c in cuts), len(raw)])
    chunks = fill_in_middle.scan(data, bounds)
    one = lambda k: fill_in_middle.Scan(*[x[k : k + 1] for x in (chunks.leave, chunks.units, chunks.sentinels)])
    n = len(bounds) - 1
    def fold(a, b):  # noqa: E306
        return one(a) if b - a == 1 else fold(a, m := a + 1 + split % (b - a - 1) if b - a > 2 else a + 1).then(fold(m, b))
    whole = fold(0, n)
    assert whole.units[0, 0] == len(re.findall("[A-Za-z]+|[^A-Za-z]", text)) and whole.sentinels[0, 0] == len(re.findall("<[PSM]>", text))
    assert fill_in_middle.composed(chunks)[2:] == (whole.units[0, 0], whole.sentinels[0, 0])


# binary records


def written(spark, docs, name):
    path = new_path(spark, name)
    records.write(records.encode(docs, WORDS), path, records.width_of(WORDS))
    return path


def test_records_round_trip(spark, docs, rows, libraries):
    path = written(spark, docs.orderBy("n_chars"), "records")
    for split in (records.SPLIT, 3):
        got = sorted(records.read(spark, path, split=split).collect(), key=lambda r: r.start)
        assert Counter((r.doc_id, tuple(r.token_ids)) for r in got) == Counter((r[0], (*libraries[2].encode(r[1] or "", add_special_tokens=False).ids, 2)) for r in rows)
        assert [r.doc_id for r in got] == [*sorted(r[0] for r in rows if r[0] is not None), None]
        assert [r.start for r in got] == np.cumsum([0, *[len(r.token_ids) for r in got]]).tolist()[:-1]
        assert all(r.n_tokens == len(r.token_ids) and r.ids_crc32 == zlib.crc32(np.array(r.token_ids, "<u4").tobytes()) for r in got)
    one, two, again = ([tuple(r) for r in records.shuffled(spark, path, seed).collect()] for seed in (1, 2, 1))
    assert one == again != two and Counter(map(str, one)) == Counter(map(str, two)) == Counter(str(tuple(r)) for r in got)
    assert records.read(spark, path, ["start", "doc_id"]).columns == ["doc_id", "start"]


def test_no_records(spark, none):
    path = written(spark, none, "no-records")
    assert records.read(spark, path).count() == records.index(spark, path).count() == records.shuffled(spark, path, 1).count() == 0


def test_wide_ids():
    frame = records.framed(records.payload_of(-7, np.array([1, 70_000]), 4))
    payload, end = records.unframed(frame)
    assert end == len(frame) and records.tokens_of(payload)[0] == -7 and records.tokens_of(payload)[1].tolist() == [1, 70_000]


@pytest.mark.parametrize("at", range(25))
def test_each_damaged_byte_is_noticed(at):
    frame = bytearray(records.framed(records.payload_of(5, np.array([3, 4]), 2)))
    assert len(frame) == 29
    frame[at] ^= 1
    with pytest.raises(records.Damaged):
        records.unframed(bytes(frame))


def test_a_damaged_file_ends_the_job(spark, docs):
    path = written(spark, docs, "damaged")
    file = f"{path.removeprefix('file://')}/{records.manifest_of(path)[0]['name']}.rec"
    with open(file, "r+b") as f:
        f.seek(30)
        byte = f.read(1)
        f.seek(30)
        f.write(bytes([byte[0] ^ 255]))
    with pytest.raises(PythonException, match="record at byte"):
        records.read(spark, path).count()


def test_files_of_lost_attempts_do_not_count(spark, docs, rows):
    path = written(spark, docs, "attempts")
    name = records.manifest_of(path)[0]["name"]
    folder = path.removeprefix("file://")
    for end in ("rec", "idx"):
        with open(f"{folder}/{name}.{end}", "rb") as a, open(f"{folder}/{name}-lost.{end}", "wb") as b:
            b.write(a.read()[:40])
    assert records.read(spark, path).count() == len(rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, max_size=6))
def test_word_table_as_the_library(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts] + ["it's <|endoftext|> x", "A  b\x1cc"]
    coder, table = units.word_coder(WORDS)
    assert [x.tolist() for x in units.word_table(texts, coder, table)] == [coder.library.encode(t, add_special_tokens=False).ids for t in texts]


# alignment


def groups_of(text, libraries):
    if not text:
        return []
    a, b, _ = libraries
    raw = f" {text}".encode()
    one = [(i, b"<|endoftext|>" if i == 50256 else bytes(LETTERS[c] for c in a.id_to_token(i))) for i in a.encode(f" {text}", add_special_tokens=False).ids]
    two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    if any(b"".join(x for _, x in side) != raw for side in (one, two)):
        return []
    ends = []
    for side in (one, two):
        at = np.cumsum([len(x) for _, x in side]).tolist()
        ends.append(list(zip([i for i, _ in side], at, strict=True)))
    out, low = [], 0
    for cut in sorted({e for _, e in ends[0]} & {e for _, e in ends[1]}):
        out.append(tuple([i for i, e in side if low < e <= cut] for side in ends))
        low = cut
    return out


def aligned(rows, libraries):
    found = [groups_of(r[1], libraries) for r in rows]
    count, best = Counter(), defaultdict(int)
    for g in found:
        count.update({(x, y) for a, b in g for x in a for y in b})
    for (x, _), c in count.items():
        best[x] = max(best[x], c)
    out = []
    for r, g in zip(rows, found, strict=True):
        links = [(x, y) for a, b in g for x in a for y in b]
        digest = hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g).encode()).hexdigest() if g else ""
        out.append((r[0], sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), digest))
    return Counter(out)


@pytest.fixture(scope="module")
def odd_rows(rows):
    rng = random.Random(5)
    extra = [(100, "a▁b"), (101, "<|endoftext|> <s> x"), (102, "=-" * 3000), (103, " lead  two\n\n tail "), (104, "日本語テキスト" * 40), (105, "\x00\x01 é́ 🙂🙂 ")]
    extra += [(200 + k, "".join(rng.choice(["the ", " of", "é", "日", "  ", "\n", "=", "ab", "<|endoftext|>", "🙂", "1", "'s"]) for _ in range(rng.randrange(40)))) for k in range(80)]
    return [*rows, *[(d, t, None, None, 0) for d, t in extra]]


@pytest.mark.parametrize("window, run, size", [(alignment.WINDOW, alignment.RUN, alignment.BLOCK), (50, 7, 300), (1, 1, 1)])
def test_alignment(spark, odd_rows, libraries, window, run, size):
    docs = more(spark, [], odd_rows, ["1 AS row", "2 AS side", "3 AS at", "4 AS block"])
    assert Counter(tuple(r) for r in alignment.align(docs, BYTES, PIECES, window=window, run=run, size=size).collect()) == aligned(odd_rows, libraries)


def test_groups_and_links(spark, odd_rows, libraries):
    docs = more(spark, [], odd_rows, [])
    found = alignment.groups(docs, BYTES, PIECES, window=50, run=7)
    parts = defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: (r.row, r.part)):
        parts[r.row, r.doc_id] += zip(r.a_ids, r.b_ids, strict=True)
    want = [(r[0], groups_of(r[1], libraries)) for r in odd_rows]
    assert Counter((d, str(g)) for (_, d), g in parts.items()) == Counter((d, str(g)) for d, g in want)
    assert alignment.links(found).count() == sum(len(a) * len(b) for _, g in want for a, b in g)


def test_large_groups_count_equal_tokens_once(monkeypatch):
    g = alignment.Groups([(1, 1)], [np.array([5, 6, 5, 5]), np.array([7, 8, 7])], [np.array([4]), np.array([3])], np.array([1]), False)
    plain = [x.tolist() for x in alignment.pairs_of(g, 10)]
    monkeypatch.setattr(alignment, "LARGE", 1)
    assert [x.tolist() for x in alignment.pairs_of(g, 10)] == plain == [[0] * 4, [57, 58, 67, 68], [6, 3, 2, 1]]


def test_alignment_of_an_empty_table(none):
    assert alignment.align(none, BYTES, PIECES).count() == 0


@settings(max_examples=200, deadline=None)
@given(ODD)
def test_both_sides_as_their_libraries(text):
    text = text.encode("utf-8", "replace").decode()
    both = alignment.coders(BYTES, PIECES)
    a, b = (side.library for side in both.sides)
    for found in (both.one(text), both.encode([text])[0]):
        if text and len(found[0]):
            assert found[0].tolist() == a.encode(f" {text}", add_special_tokens=False).ids and found[1].tolist() == b.encode(text)


def test_every_piece_alone_and_inside():
    side = units.PieceTokens(PIECES)
    for raw in side.raw.values():
        text = raw.decode("utf-8", "replace")
        if units.settled(text):
            for x in (f" {text}", f" q{text}z"):
                assert side.encode(x, True).tolist() == side.library.encode(x[1:])
