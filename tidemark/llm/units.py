"""Token ids of whole texts at the speed of a word table: texts are cut where no token can span, each new word is encoded once."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import regex
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from .bpe import IRREGULAR, LAST_SETTLED, PIECES, _byte_letters

#: Words that one worker remembers before it starts anew, and the longest of them.
REMEMBERED, LONGEST = 400_000, 64
#: Normal forms leave characters below this one alone.
FIRST_COMBINING = "̀"
END = "</w>"
#: Characters that Python takes for white space and the format does not.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: The cut of the vocabulary with word ends (a fixed value of its format).
WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SETTLED_WORDS = regex.compile(WORD_PIECES)


def spec_of(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def ranked(tokens: dict[bytes, int], first: list[bytes] = ()) -> tuple[dict[bytes, int], np.ndarray]:
    """Ranks for the merging library and the id of each rank: bytes, then ``first``, then all others by id."""
    order = dict.fromkeys([bytes([b]) for b in range(256)]) | dict.fromkeys(first) | dict.fromkeys(sorted(tokens, key=tokens.get))
    return {t: k for k, t in enumerate(order)}, np.array([tokens.get(t, -1) for t in order], np.int32)


class ByteTokens:
    """The byte-level vocabulary; strings of its special tokens are plain text."""

    def __init__(self, path: str):
        spec, letters = spec_of(path), _byte_letters()
        tokens = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        tokens |= {x["content"].encode(): x["id"] for x in spec["added_tokens"] if x["content"].encode() not in tokens}
        self.raw = {i: t for t, i in tokens.items()}
        ordinary = {t: i for t, i in tokens.items() if t.decode("utf-8", "replace") not in {x["content"] for x in spec["added_tokens"]}}
        self.fast = tiktoken.Encoding("bytes", pat_str=PIECES.pattern, mergeable_ranks=ordinary, special_tokens={})
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True

    def encode(self, text: str, settled: bool) -> np.ndarray:
        if settled:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)


class PieceTokens:
    """The vocabulary of pieces. A text begins with a space, which the library adds itself."""

    def __init__(self, path: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(lib.get_piece_size())
        single = {i: bytes([int(lib.id_to_piece(i)[3:5], 16)]) for i in ids if lib.is_byte(i)}
        whole = {i: lib.id_to_piece(i).replace("▁", " ").encode() for i in ids if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))}
        self.raw = single | whole
        by_score = {t: i for i, t in sorted(whole.items(), key=lambda x: (-lib.get_score(x[0]), x[0]))}
        # Characters are the smallest pieces, so those of two bytes are put together before all else.
        order, of_rank = ranked(dict(zip(by_score, range(len(by_score)), strict=True)), [t for t in by_score if len(t) == 2 and len(t.decode()) == 1])
        back = np.array(list(by_score.values()), np.int32)
        bytes_of = {t: i for i, t in single.items()}
        self.id_of = np.array([back[k] if k >= 0 else bytes_of.get(t, -1) for t, k in zip(order, of_rank.tolist(), strict=True)], np.int32)
        self.fast = tiktoken.Encoding("pieces", pat_str=r"\x20*[^\x20]+|\x20+", mergeable_ranks=order, special_tokens={})

    def encode(self, text: str, settled: bool) -> np.ndarray:
        """``text`` with its leading space."""
        if settled:
            return self.id_of[self.fast.encode_to_numpy(text, disallowed_special=())]
        return np.array(self.library.encode(text[1:]), np.int32)


class WordTokens:
    """The vocabulary with word ends: normal form, lower case, white space dropped.

    The merging library has no mark for an end, so a piece is written with a space behind it, which its
    last byte takes up before anything else. Special strings and texts whose normal form or character
    classes depend on a Unicode version go to the vocabulary's own library.
    """

    def __init__(self, path: str):
        spec, letters = spec_of(path), _byte_letters()
        self.special = [x["content"] for x in spec["added_tokens"]]
        tokens = {}
        for t, i in spec["model"]["vocab"].items():
            if t not in self.special:
                tokens[bytes(letters[c] for c in t.removesuffix(END)) + (b" " if t.endswith(END) else b"")] = i
        order, self.id_of = ranked(tokens, [bytes([b, 32]) for b in range(256)])
        self.fast = tiktoken.Encoding("words", pat_str=r"[^\x20]+\x20", mergeable_ranks=order, special_tokens={})
        self.ends = np.zeros(1 + max(spec["model"]["vocab"].values()), bool)
        self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(END)]] = True
        self.library = Tokenizer.from_file(path)
        self.size = len(self.ends)

    def settled(self, text: str) -> bool:
        return (text.isascii() or max(text) < FIRST_COMBINING) and not any(x in text for x in self.special)

    def encode(self, text: str, settled: bool) -> np.ndarray:
        if not settled:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)
        return self.pieces(_SETTLED_WORDS.findall(text.lower()))

    def pieces(self, found: list[str]) -> np.ndarray:
        return self.id_of[self.fast.encode_to_numpy(" ".join([*found, ""]), disallowed_special=())] if found else np.zeros(0, np.int32)


class Table:
    """Encodings of words, one after the other: word k has ids ``start[k]`` to ``start[k + 1]``, for each of several coders."""

    def __init__(self, coders: int):
        self.known: dict[str, int] = {}
        self.ids = [np.zeros(1 << 16, np.int32) for _ in range(coders)]
        self.start = [np.zeros(1 << 14, np.int64) for _ in range(coders)]
        self.filled = [0] * coders

    def __len__(self) -> int:
        return len(self.known)

    @staticmethod
    def _room(x: np.ndarray, n: int) -> np.ndarray:
        return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, len(x) * 2) - len(x), x.dtype)])

    def add(self, words: list[str], coded: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """``coded``, for each coder: all ids of ``words`` and how many each word has."""
        had = len(self.known)
        self.known.update(zip(words, range(had, had + len(words)), strict=True))
        for k, (ids, sizes) in enumerate(coded):
            self.ids[k], self.start[k] = self._room(self.ids[k], self.filled[k] + len(ids)), self._room(self.start[k], had + len(words) + 1)
            self.ids[k][self.filled[k] : self.filled[k] + len(ids)] = ids
            self.start[k][had + 1 : had + len(words) + 1] = self.filled[k] + np.cumsum(sizes)
            self.filled[k] += len(ids)

    def of(self, coder: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words in their order, and how many each has."""
        low, size = self.start[coder][words], self.start[coder][words + 1] - self.start[coder][words]
        before = np.cumsum(size) - size
        return self.ids[coder][np.repeat(low - before, size) + np.arange(size.sum())], size


def numbered(table: Table, words: list[str], encode) -> np.ndarray:
    """Numbers of ``words`` in ``table``; ``encode`` is called once for all that are new."""
    found = list(map(table.known.get, words))
    if None in found:
        new = list(dict.fromkeys(w for w, k in zip(words, found, strict=True) if k is None))
        table.add(new, encode(new))
        found = list(map(table.known.get, words))
    return np.array(found, np.int64)


def word_table(texts: list[str], words: WordTokens, table: Table) -> list[np.ndarray]:
    """The ids of each text under the vocabulary with word ends."""
    if len(table) > REMEMBERED:
        table.__init__(1)
    out: list[np.ndarray | None] = [None] * len(texts)
    runs, owners = [], []
    for k, text in enumerate(texts):
        if not words.settled(text):
            out[k] = words.encode(text, False)
            continue
        own = text.lower().split()
        if SEPARATORS.search(text) or max(map(len, own), default=0) > LONGEST:
            out[k] = words.encode(text, True)
        else:
            runs += own
            owners.append((k, len(own)))

    def encode(new: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        cut = [_SETTLED_WORDS.findall(w) for w in new]
        ids = words.pieces([p for c in cut for p in c])
        ends = np.append(0, np.flatnonzero(words.ends[ids]) + 1)
        last = np.cumsum([len(c) for c in cut])
        return [(ids, np.diff(np.append(0, ends[last])))]

    ids, sizes = table.of(0, numbered(table, runs, encode)) if runs else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    bounds, at = np.append(0, np.cumsum(sizes)), 0
    for k, n in owners:
        out[k] = ids[bounds[at] : bounds[at + n]]
        at += n
    return out


def settled(text: str) -> bool:
    return text.isascii() or max(text) <= LAST_SETTLED


def regular(text: str) -> bool:
    """Whether each space stands alone between visible characters, so that no token goes past the front of one."""
    return bool(text) and not IRREGULAR.search(text)


@lru_cache(maxsize=2)
def word_coder(path: str) -> tuple[WordTokens, Table]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokens(path), Table(1)
