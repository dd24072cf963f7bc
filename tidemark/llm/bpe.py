"""Byte-level BPE by dynamic programming over prefixes, and its inverse.

For each prefix of a piece of text exactly one token can be the last of the piece's encoding: the one
that is a suffix of the prefix and goes together with the last token of what is left before it. An
automaton over the vocabulary finds the suffixes, a test on pairs of tokens settles which one holds,
and following the stored tokens backwards gives the ids.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import id_and_bytes, slices

#: Pieces and words that one worker remembers before it starts anew.
REMEMBERED = 600_000
#: A text where white space meets white space, or an end, is cut by the pattern and not at its spaces.
IRREGULAR = re.compile(r"\s\s|^\s|\s$")
#: Characters up to here belong to the same classes in every Unicode version in use.
LAST_SETTLED = "ԯ"
#: The cut of the vocabulary's own library (a fixed value of the format).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
NEVER = 1 << 62


def _byte_letters() -> dict[str, int]:
    """The format writes each byte as a letter: printable ones as themselves, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder of one vocabulary file; null texts are the caller's to make empty."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        ids = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.bytes_of = [b""] * (1 + max([*ids.values(), *self.added.values()]))
        for token, i in (ids | {k.encode(): v for k, v in self.added.items()}).items():
            self.bytes_of[i] = token
        self.merged: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(spec["model"]["merges"]):
            a, b = (ids[bytes(letters[c] for c in x)] for x in (left, right))
            whole = ids[self.bytes_of[a] + self.bytes_of[b]]
            self.merged[a, b] = rank
            parts.setdefault(whole, (rank, a, b))
        # Along each token's edge: the tokens that stood there, each with the rank at which it was merged away.
        self.right_edge, self.left_edge = ([self._edge(i, parts, side) for i in range(len(self.bytes_of))] for side in (2, 1))
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.bytes_of))]
        self.fits: dict[int, bool] = {}
        self.matches = ahocorasick.Automaton()
        for token, i in ids.items():
            self.matches.add_word(token.decode("latin-1"), (len(token), i))
        self.matches.make_automaton()
        self.library = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    @staticmethod
    def _edge(token: int, parts: dict[int, tuple[int, int, int]], side: int) -> list[tuple[int, int]]:
        edge, until = [(token, NEVER)], NEVER
        while token in parts:
            until, token = parts[token][0], parts[token][side]
            edge.append((token, until))
        return edge

    def compatible(self, pair: int) -> bool:
        """Whether the bytes of two tokens together are encoded as just these two.

        They are not if some token on the first one's right edge and some on the second one's left edge
        would have been merged before either was merged within its own side (on a tie the left comes first).
        """
        fit = True
        for x, x_until in self.right_edge[pair >> 20]:
            for y, y_until in self.left_edge[pair & 0xFFFFF]:
                rank = self.merged.get((x, y))
                if rank is not None and rank < x_until and rank <= y_until:
                    fit = False
        if len(self.fits) > 2 * REMEMBERED:
            self.fits.clear()
        self.fits[pair] = fit
        return fit

    def encode_piece(self, piece: str) -> bytes:
        """The ids of one piece, as little-endian 32-bit numbers."""
        known = self.pieces.get(piece)
        if known is not None:
            return known
        raw = piece.encode()
        last = [0] * (len(raw) + 1)
        done, fits = 0, self.fits.get  # the prefix of length done has its token
        for end, (size, token) in self.matches.iter(raw.decode("latin-1")):
            if end < done:
                continue
            start = end + 1 - size
            if start:
                pair = last[start] << 20 | token
                fit = fits(pair)
                if fit is False or fit is None and not self.compatible(pair):
                    continue
            done = end + 1
            last[done] = token
        out, end, of = [], len(raw), self.bytes_of
        while end:
            out.append(self.packed[last[end]])
            end -= len(of[last[end]])
        found = b"".join(reversed(out))
        if len(self.pieces) > REMEMBERED // 2:
            self.pieces.clear()
        self.pieces[piece] = found
        return found

    def cut(self, text: str) -> list[str]:
        """The pieces that are encoded apart; by the library where Unicode versions may differ."""
        if text.isascii() or max(text) <= LAST_SETTLED:
            return PIECES.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def encode_word(self, word: str) -> bytes:
        known = self.words.get(word)
        if known is None:
            known = b"".join([self.encode_piece(p) for p in self.cut(word)])
            if len(self.words) > REMEMBERED:
                self.words.clear()
            if len(word) < 64:
                self.words[word] = known
        return known

    def _plain(self, text: str) -> bytes:
        if IRREGULAR.search(text):
            return b"".join(map(self.encode_piece, self.cut(text)))
        first, *rest = text.split(" ")
        word, get = self.encode_word, self.words.get
        return b"".join([word(first), *[get(w) or word(w) for w in [" " + w for w in rest]]])

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return b"".join([self.packed[self.added[x]] if k % 2 else self._plain(x) if x else b"" for k, x in enumerate(parts)])

    def decode(self, ids: list[int]) -> str:
        of = self.bytes_of
        return b"".join([of[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def coder(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_decode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``token_ids`` and ``decoded`` of every row of ``docs``.

    ``path``: a byte-level BPE vocabulary in the tokenizers format, present on every executor. A null
    or empty text has no ids and decodes to nothing; special strings in a text are their own tokens;
    repeated rows are each encoded. Nothing is shuffled and each slice of rows is worked off alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for part in slices(batches, 2 << 20):
            coded = [bpe.encode(x.decode("utf-8", "replace")) for x in part.column(1).to_pylist()]
            sizes = np.fromiter((len(x) // 4 for x in coded), np.int32, len(coded))
            ids = np.frombuffer(b"".join(coded), dtype="<i4")
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            numbers = ids.tolist()
            decoded = [bpe.decode(numbers[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array(decoded, pa.string())], names=["doc_id", "token_ids", "decoded"])

    return id_and_bytes(docs, doc_id, text).mapInArrow(run, "doc_id long, token_ids array<int>, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    """What the query returns of ``encode_decode``."""
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
