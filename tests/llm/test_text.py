"""Counting, encoding, scoring, rules, licenses, toxicity and decontamination."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, decontaminate, hmm, licenses, quality_rules, token_counts, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_token_counts(docs, rows, library):
    for chunk, overlap in ((16_384, 256), (64, 4)):
        got = Counter(tuple(r) for r in token_counts.count_tokens(docs, PATH, chunk=chunk, overlap=overlap).collect())
        assert got == Counter((d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in rows)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeT1 \n\t'.é日<|>" + "s"), max_size=300) | st.text(max_size=60), st.sampled_from([8, 32]), st.sampled_from([2, 8]))
def test_spliced_counts_are_exact(text, chunk, overlap):
    text += "<|endoftext|> the end"
    assert token_counts.counter(PATH).count(text.encode("utf-8", "replace"), False, chunk, overlap) == len(Tokenizer.from_file(PATH).encode(text.encode("utf-8", "replace").decode(), add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet=st.sampled_from("aest hinor \n'.,19é<|endoftext|>"), max_size=120))
def test_encoding_as_the_library(text):
    text = text.encode("utf-8", "replace").decode()
    coder, library = bpe.coder(PATH), _library()
    ids = np.frombuffer(coder.encode(text), "<i4").tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


_held = {}


def _library():
    return _held.setdefault("t", Tokenizer.from_file(PATH))


def test_encode_and_decode(docs, rows, library):
    got = Counter(tuple(r) for r in bpe.digests(bpe.encode_decode(docs, PATH)).collect())
    want = []
    for d, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == Counter(want)


def figures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_rule_figures(docs, rows):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = Counter(tuple(r[c] for c in ["doc_id", *names]) for r in quality_rules.judge(docs, keep_columns=False).collect())
    assert got == Counter((d, *figures(t)) for d, t, *_ in rows)


def test_bad_hosts_take_their_documents(spark):
    rng = random.Random(1)
    good = " ".join(str(rng.random()) for _ in range(30))
    rows = [(k, "short" if k % 10 else good, "bad.example") for k in range(400)] + [(1000 + k, good if k % 20 else "short", f"h{k % 9}") for k in range(900)] + [(5000, good, None)]
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), keep_columns=False).collect()}
    assert not got[0] and not got[10] and got[1001] and not got[1000] and got[5000]
    kept = quality_rules.filter_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert kept.columns == ["doc_id", "text", "source"] and kept.count() == sum(got.values())


def test_rules_on_an_empty_table(none):
    assert quality_rules.judge(none, keep_columns=False).count() == 0


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def test_license_phrases(docs, rows):
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(docs).collect())
    want = []
    for d, t, *_ in rows:
        w = license_words(t)
        at = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        places = [i for i, _ in at]
        want.append((d, len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))))
    assert got == Counter(want)


def test_license_spans_with_edits(spark):
    body = licenses.TEMPLATES[0][1].split()
    edited = [w for k, w in enumerate(body) if k % 17 != 5]
    rows = [(1, "intro words " + " ".join(body) + " tail"), (2, " ".join(edited)), (3, " ".join(body[:12])), (4, "nothing of the kind"), (5, None)]
    spans = {(r.doc_id, r.label): r for r in licenses.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert spans[1, "mit"].share == 1.0 and spans[1, "mit"]["first"] == 2 and 0.6 < spans[2, "mit"].share < 1 and (3, "mit") not in spans and {d for d, _ in spans} == {1, 2}
    got = {r.doc_id: (r.labels, r.score > 0) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("mit", True), 2: ("mit", True), 3: ("", False), 4: ("", False), 5: ("", False)}


@pytest.mark.parametrize("few", [10_000, 3])
def test_licenses_by_row(spark, few, monkeypatch):
    """Rows that share an id or have none are judged each by its own text, whether templates are few or many."""
    monkeypatch.setattr(licenses, "FEW_GRAMS", few)
    mit, gpl = licenses.TEMPLATES[0][1], licenses.TEMPLATES[6][1]
    half = mit.split()
    rows = [(1, mit), (1, gpl), (1, "neither"), (None, mit), (None, "none"), (2, " ".join(half[:30])), (2, " ".join(half[30:])), (3, "word " * 50_000 + mit), (4, mit), (4, mit)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS h", "'x' AS w", "3 AS hits")
    got = Counter((r.doc_id, r.labels) for r in licenses.scan(frame).collect())
    assert got == Counter([(1, "mit"), (1, "gpl"), (1, ""), (None, "mit"), (None, ""), (2, ""), (2, ""), (3, "mit"), (4, "mit"), (4, "mit")])


def test_diagonal_votes_by_brute_force(spark):
    """Shares of templates with words put in, left out and changed, against counting equal grams by hand."""
    rng = random.Random(8)
    rows = []
    for k in range(40):
        body = license_words(licenses.TEMPLATES[k % len(licenses.TEMPLATES)][1])
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(body))
            body[at : at + rng.randrange(2)] = rng.choice([[], ["other"]])
        rows.append((k, "before it " + " ".join(body) + " and after"))
    want = Counter()
    for d, t in rows:
        w = license_words(t)
        for n, (label, template) in enumerate(licenses.TEMPLATES):
            x = license_words(template)
            cells = {}
            for i in range(len(w) - 3):
                for j in range(len(x) - 3):
                    if w[i : i + 4] == x[j : j + 4]:
                        cells.setdefault(i - j, set()).add(j)
            group, last = [], None
            for diagonal in [*sorted(cells), None]:
                if group and (diagonal is None or diagonal - last > licenses.MERGE):
                    covered = {j + s for g in group for j in cells[g] for s in range(4)}
                    if len(covered) / len(x) >= licenses.MIN_SHARE and len(covered) >= min(licenses.MIN_WORDS, len(x)):
                        want[d, n, len(covered)] += 1
                    group = []
                if diagonal is not None:
                    group.append(diagonal)
                    last = diagonal
    got = licenses.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes = [len(license_words(t)) for _, t in licenses.TEMPLATES]
    assert Counter((r.doc_id, r.template, round(r.share * sizes[r.template])) for r in got) == want


def test_license_scan_of_an_empty_table(none):
    assert licenses.scan(none).count() == 0


@pytest.mark.parametrize("length", [9, 10, 11, 16, 17, 20, 24, 30, 32, 40, 41, 60])
def test_short_items_with_all_their_edits(length):
    """Substitutions spread so that the pieces between them are as short as can be."""
    rng = random.Random(length)
    edits = decontaminate.budget(length)
    places = [(k + 1) * length // (edits + 1) - 1 for k in range(edits)] if length != 30 else [7, 15, 23]
    for _ in range(20):
        item = "".join(rng.choice("abcdefghij") for _ in range(length))
        edited = "".join("z" if k in places else c for k, c in enumerate(item))
        text = f"one two {edited} three".encode()
        hits = decontaminate.Items([5], [item.encode()]).hits(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert [(r, i, e) for r, i, _, _, e in hits] == [(0, 0, edits)]


def model_tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]


@pytest.mark.parametrize("frequent", [1 << 16, 20])
def test_language_model_base(docs, rows, frequent, monkeypatch):
    monkeypatch.setattr(hmm, "FREQUENT", frequent)
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    c = Counter(w for d, t, *_ in rows if not held(d) for w in model_tokens(t))
    n, v = sum(c.values()), len(c)
    want = defaultdict(list)
    for d, t, *_ in rows:
        tokens = model_tokens(t)
        want[d].append((held(d), len(tokens), sum(c[w] > 0 for w in tokens), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens)))
    got = hmm.score(docs).collect()
    assert len(got) == len(rows) and all(r.score < 0 for r in got)
    for r in got:
        assert any((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and abs(r.base_score - w[4]) <= 1e-9 * abs(w[4]) for w in want[r.doc_id])


def test_forward_recursion_is_exact():
    rng = np.random.default_rng(1)
    model = hmm.Model.first(rng.integers(1, 9, 20).astype(float), 3)
    classes, bounds = rng.integers(0, 20, 3000), np.array([0, 1, 700, 701, 1956, 3000])
    got = hmm.log_likelihood(model, classes, bounds)
    for i in range(5):
        x = classes[bounds[i] : bounds[i + 1]]
        a, total = model.start * model.emit[x[0]], 0.0
        for c in x[1:]:
            total += math.log(a.sum())
            a = (a / a.sum() @ model.move) * model.emit[c]
        assert abs(got[i] - total - math.log(a.sum())) < 1e-6


def test_training_never_lowers_the_likelihood():
    rng = np.random.default_rng(2)
    classes, bounds = np.concatenate([rng.integers(0, 5, 400), rng.integers(5, 10, 400)]), np.array([0, 200, 400, 600, 800])
    model, seen = hmm.Model.first(np.bincount(classes, minlength=10).astype(float), 2), []
    for _ in range(8):
        *counts, total = hmm.expected(model, classes, bounds)
        seen.append(total)
        model = hmm.Model.of_counts(*counts)
    assert all(b > a - 0.5 for a, b in zip(seen[:-1], seen[1:], strict=True)) and seen[-1] > seen[0] + 100


def test_expected_counts_of_long_texts():
    """Plain forward and backward passes over whole texts; only real starts count as starts."""
    rng = np.random.default_rng(4)
    model = hmm.Model.first(rng.integers(1, 9, 12).astype(float), 3)
    classes, bounds = rng.integers(0, 12, 2300), np.array([0, 5, 900, 901, 1157, 2300])
    first, move, emit, total = np.zeros(3), np.zeros((3, 3)), np.zeros((12, 3)), 0.0
    for i in range(5):
        x = classes[bounds[i] : bounds[i + 1]]
        alpha, scale = np.zeros((len(x), 3)), np.zeros(len(x))
        for t, c in enumerate(x):
            a = (alpha[t - 1] @ model.move if t else model.start) * model.emit[c]
            scale[t] = a.sum()
            alpha[t] = a / scale[t]
        beta = np.ones(3)
        for t in range(len(x) - 1, -1, -1):
            emit[x[t]] += alpha[t] * beta
            if t:
                pull = model.emit[x[t]] * beta / scale[t]
                move += model.move * np.outer(alpha[t - 1], pull)
                beta = model.move @ pull
        first += alpha[0] * beta
        total += np.log(scale).sum()
    got = hmm.expected(model, classes, bounds)
    assert abs(got[0].sum() - 5) < 1e-9
    assert all(np.allclose(a, b, rtol=1e-8, atol=1e-10) for a, b in zip(got, (first, move, emit, total), strict=True))


@pytest.mark.parametrize("frequent", [1 << 16, 64])
def test_rare_words_keep_their_states(spark, frequent, monkeypatch):
    """Held-out texts whose words are rare but of one topic score above the same words across topics, whatever ``FREQUENT`` is."""
    monkeypatch.setattr(hmm, "FREQUENT", frequent)
    rng = random.Random(6)
    topics = [[f"{t}{k}" for k in range(2500)] for t in "xy"]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    ids = [k for k in range(400) if not held(k)]
    rows = [(d, " ".join(rng.choice(topics[d % 2]) for _ in range(240))) for d in ids]
    probes = [k for k in range(1000, 2000) if held(k)][:2]
    words = [[rng.choice(t) for _ in range(40)] for t in topics]
    rows += [(probes[0], " ".join(words[0] + words[1])), (probes[1], " ".join(w for pair in zip(*words, strict=True) for w in pair))]
    got = {r.doc_id: r for r in hmm.score(spark.createDataFrame(rows, "doc_id long, text string"), states=2, rounds=5).collect()}
    pure, mixed = got[probes[0]], got[probes[1]]
    assert abs(pure.base_score - mixed.base_score) < 1e-6 and pure.score > mixed.score + 5


def test_probabilities_add_up(docs):
    model = hmm.Model.first(np.ones(7), 3)
    every = np.array([[a, b] for a in range(7) for b in range(7)]).ravel()
    assert abs(np.exp(hmm.log_likelihood(model, every, np.arange(0, 99, 2))).sum() - 1) < 1e-9


def test_language_model_of_an_empty_table(none):
    assert hmm.score(none).count() == 0


def test_chain_of_classifiers(spark):
    rng = random.Random(3)
    plain = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(600):
        toxic, low = int(k % 5 == 0), int(k % 3 == 0 and k % 5 != 0)
        words = [rng.choice(plain).translate({ord(str(d)): "abcdefghij"[d] for d in range(10)}) for _ in range(60)]
        words += ["nasty", "vile"] * toxic + ["spam", "junk"] * low
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, 1 - low, toxic))
    docs = spark.createDataFrame([*rows, (9000, None), (9001, "")], "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, table.filter("doc_id < 450")).collect()}
    test = [k for k in range(450, 600)]
    assert len(got) == 602 and sum(got[k].toxic == bool(labels[k][2]) for k in test) >= 148 and sum(got[k].low_quality == (not labels[k][1]) for k in test) >= 145
    assert not got[9000].toxic and got[9000].p_toxic == got[9001].p_toxic
    again = docs.unionByName(docs.filter("doc_id < 5")).unionByName(spark.createDataFrame([(None, "nasty vile"), (9002, "word " * 100_000)], docs.schema)).selectExpr("*", "1 AS id", "2 AS body", "'x' AS words", "0 AS toxic", "3 AS fold", "4 AS p")
    more = toxicity.score(again, table.unionByName(table.limit(7)).filter("doc_id < 450"))
    assert more.count() == 609 and all(abs(r.p_toxic - got[r.doc_id].p_toxic) < 1e-6 for r in more.collect() if r.doc_id in got) and {r.toxic for r in more.collect() if r.doc_id is None} == {True}
    assert toxicity.score(docs.limit(0), table).count() == 0
    untaught = toxicity.score(docs, table.limit(0))
    assert untaught.count() == 602 and untaught.filter("p_toxic IS NOT NULL").isEmpty()


def test_fits_are_least():
    """The model of some rows against plain gradient steps on the same penalised loss."""
    rng = np.random.default_rng(3)
    label = (rng.random(60) < 0.4).astype(float)
    has = rng.random((60, 25)) < 0.2 + 0.3 * label[:, None] * (np.arange(25) < 4)
    before, bounds = rng.random((60, 1)), np.concatenate([[0], np.cumsum(has.sum(1))])
    hashed = np.nonzero(has)[1].astype(np.uint64)
    model = toxicity.fit_model(hashed, bounds, before, label)
    yes, no = has[label > 0].sum(0), has[label == 0].sum(0)
    x = np.column_stack([has * (np.log((yes + 0.5) / (label.sum() + 1)) - np.log((no + 0.5) / ((1 - label).sum() + 1))), before, np.ones(60)])
    penalty, w = np.array([toxicity.PENALTY] * 25 + [1e-3] * 2), np.zeros(27)
    for _ in range(60_000):
        w -= 0.01 * (x.T @ (1 / (1 + np.exp(-x @ w)) - label) + penalty * w)
    assert np.allclose(model.probabilities(hashed, bounds, before), 1 / (1 + np.exp(-x @ w)), atol=2e-2)


def test_a_fit_is_the_same_in_blocks_of_any_size(monkeypatch):
    rng = np.random.default_rng(4)
    size = rng.integers(0, 30, 80)
    size[[0, 40, 79]] = 0
    hashed, bounds = rng.integers(0, 50, size.sum()).astype(np.uint64), np.concatenate([[0], np.cumsum(size)])
    before, label = rng.random((80, 1)), (rng.random(80) < 0.4).astype(float)
    whole = toxicity.fit_model(hashed, bounds, before, label)
    for most in (1, 7, 100):
        monkeypatch.setattr(toxicity, "BLOCK", most)
        blocks = toxicity._row_blocks(bounds)
        assert [k for a, b in blocks for k in range(a, b)] == list(range(80)) and all(bounds[b] - bounds[a] <= most or b == a + 1 for a, b in blocks)
        part = toxicity.fit_model(hashed, bounds, before, label)
        assert (part.hashes == whole.hashes).all() and np.allclose(part.weights, whole.weights, atol=1e-6) and part.bias == pytest.approx(whole.bias, abs=1e-6)


def test_where_a_category_begins():
    p, y = np.array([0.9, 0.4, 0.3, 0.3, 0.1]), np.array([1, 1, 0, 1, 0], bool)
    assert toxicity.begins(p, y) == pytest.approx(0.2) and toxicity.begins(p, y & False) == 0.5 and toxicity.begins(p, y | True) == 0.5


def folded(text):
    return " ".join(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.translate(LOWER)))


def edits(a, b):
    """Fewest edits that put the whole of ``a`` somewhere in ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(last + (x != y), row[j] + 1, row[j + 1] + 1)
    return min(row)


def test_leaks_with_edits(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(12, 40)))) for k in range(12)] + [(90, None), (91, ""), (92, "short"), (93, words[7][:1]), (94, words[3][:8]), (95, f"{words[5]}, {words[6]}"[:8]), (96, "a"), (97, "--")]
    docs = []
    for k in range(60):
        body = [rng.choice(words) for _ in range(rng.randrange(0, 300))]
        if k % 3 == 0:
            item = list(items[k % 12][1].upper() if k % 2 else items[k % 12][1])
            for _ in range(rng.randrange(0, max(1, len(item) // 6))):
                at = rng.randrange(len(item))
                item[at : at + rng.randrange(2)] = rng.choice(["", "z", "zz"])
            body.insert(rng.randrange(len(body) + 1), "".join(item))
        docs.append((k, " ".join(body)))
    docs += [(100, None), (101, ""), (102, "A"), (103, f"b-a {words[3][:8]}"), (104, f"{words[3][:8]}x x{words[3][:8]}")]
    table = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(frame, table).collect()}
    want = {}
    for d, t in docs:
        for i, x in items:
            a, b = folded(x or ""), folded(t or "")
            if a and len(a) <= decontaminate.Q:
                if f" {a} " in f" {b} ":
                    want[d, i] = 0
            elif a and (e := edits(a, b)) <= decontaminate.budget(len(a)):
                want[d, i] = e
    assert {k: r.edits for k, r in got.items()} == want
    kept = decontaminate.drop_contaminated(frame.withColumn("gone", F.lit(1)), table)
    assert kept.columns == ["doc_id", "text", "gone"] and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}


@pytest.mark.parametrize("length", [*range(1, 50), 77, 123, 250, 400])
def test_leaks_of_all_lengths(length):
    """Items of every length with none to all of their edits, against the plain count of edits."""
    rng = random.Random(length)
    item = "".join(rng.choice("abcdef") for _ in range(length))
    for e in range(decontaminate.budget(length) + 2):
        changed = list(item)
        for k in rng.sample(range(length), min(e, length)):
            changed[k] = rng.choice(["z", "", changed[k] + "z"])
        text = f"one {rng.choice('xyz')}two {''.join(changed)} three".encode()
        hits = decontaminate.Items([5], [item.encode()]).hits(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        least = edits(item, text.decode())
        fits = f" {item} " in f" {text.decode()} " if length <= decontaminate.Q else least <= decontaminate.budget(length)
        assert sorted({x[4] for x in hits})[:1] == ([least] if fits else [])


def test_many_rows_items_and_bands_at_once():
    """Rows, items, bands and places whose product is beyond 64 bits: planted copies are found as they are alone."""
    rng = np.random.default_rng(4)
    words = ["".join(x) for x in rng.choice(list("abcdefghijklmnop"), (4000, 5))]
    some = lambda n: " ".join(words[k] for k in rng.integers(0, len(words), n))
    items = [some(10) for _ in range(60_000)] + [some(8000)]
    planted = {12_000: 59_998, 30_000: 7}
    texts = [some(6) for _ in range(30_001)] + [some(300_000)]
    for row, item in planted.items():
        texts[row] = f"{some(3)} {items[item]} {some(3)}"
    raw = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(x) for x in raw]))
    known = decontaminate.Items(list(range(len(items))), [x.encode() for x in items])
    assert len(texts) * len(items) * (2 * len(raw[-1]) // 2 + 50_000) * 48_000 > 1 << 63
    hits = known.hits(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert {r: i for r, i, *_, e in hits if e == 0} == planted


def test_repeated_items_count_once(spark):
    table = spark.createDataFrame([(1, "some item of a benchmark")] * 3 + [(2, "some item of a benchmark")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "here is some item of a benchmark")], "doc_id long, text string")
    assert sorted(r.item_id for r in decontaminate.matches(docs, table).collect()) == [1, 2]


def test_rows_are_judged_alone(spark, docs, rows):
    """Null, repeated and shared ids, a long text, columns whose names clash: each row goes by its own text."""
    item = "the quick brown fox jumps over the lazy dog again and again"
    table = spark.createDataFrame([(1, item)], "item_id long, text string")
    some = [(1, f"x {item} y"), (1, "clean"), (None, item), (None, "clean too"), (2, item), (2, item), (3, "word " * 200_000 + item), (4, None)]
    frame = spark.createDataFrame(some, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS item_id", "3 AS n")
    assert Counter((r.doc_id, r.item_id, r.edits) for r in decontaminate.matches(frame, table).collect()) == Counter([(1, 1, 0), (None, 1, 0), (2, 1, 0), (2, 1, 0), (3, 1, 0)])
    kept = decontaminate.drop_contaminated(frame, table)
    assert kept.columns == frame.columns and Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, "clean"), (None, "clean too"), (4, None)])
    assert decontaminate.drop_contaminated(docs, table).count() == len(rows)


def test_leaks_without_rows(docs, none, spark):
    assert decontaminate.matches(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert decontaminate.matches(none, spark.createDataFrame([(1, "some item of a benchmark")], "item_id long, text string")).count() == 0
