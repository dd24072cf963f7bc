"""Token counts of whole documents, huge ones by overlapping chunks that are spliced again.

A text is cut into chunks that overlap. Each chunk is encoded alone, with the byte at which each of
its tokens ends. Two neighbours are spliced at a token end that both have and that no context can
move: before an ASCII space that follows a visible ASCII character. Where the overlap holds none, it
is widened, and in the end the two chunks become one.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import PIECES, _byte_letters
from .common import flat, id_and_bytes, slices

CHUNK, OVERLAP = 16_384, 256
#: UTF-8 lead bytes from here on stand for characters whose class differs among Unicode versions.
UNSETTLED = 0xD4


class Counter:
    """Token ends of a byte string under one vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        ids = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.fast = tiktoken.Encoding("own", pat_str=PIECES.pattern, mergeable_ranks=ids, special_tokens=self.special)
        self.size = np.zeros(1 + max([*ids.values(), *self.special.values()]), np.int64)
        for token, i in (ids | {k.encode(): v for k, v in self.special.items()}).items():
            self.size[i] = len(token)

    def ids(self, raw: bytes, settled: bool) -> np.ndarray:
        text = raw.decode("utf-8", "replace")
        if settled:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype(np.int64)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.int64)

    def ends(self, raw: bytes, settled: bool) -> np.ndarray:
        return np.cumsum(self.size[self.ids(raw, settled)])

    def count(self, raw: bytes, settled: bool, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        if len(raw) <= chunk + overlap:
            return len(self.ids(raw, settled))
        return self.spliced(raw, settled, chunk, overlap)

    def spliced(self, raw: bytes, settled: bool, chunk: int, overlap: int) -> int:
        n = len(raw)
        data = np.frombuffer(raw, np.uint8)
        visible = (data > 0x20) & (data < 0x7F)
        stable = np.zeros(n + 1, bool)
        stable[1:n] = visible[:-1] & (data[1:] == 0x20)
        inner = (data & 0xC0) == 0x80  # the bytes of a character after its first

        def whole(at: int, step: int) -> int:
            while 0 < at < n and inner[at]:
                at += step
            return min(max(at, 0), n)

        cuts = [whole(at, -1) for at in range(chunk, n - overlap, chunk)]
        width = [overlap] * len(cuts)
        ends: list[np.ndarray | None] = [None] * (len(cuts) + 1)
        splice: list[int | None] = [None] * len(cuts)
        while True:
            for k in range(len(ends)):
                if ends[k] is None:
                    start = whole(cuts[k - 1] - width[k - 1], -1) if k else 0
                    stop = whole(cuts[k] + width[k], 1) if k < len(cuts) else n
                    ends[k] = start + self.ends(raw[start:stop], settled)
            failed = None
            for k, cut in enumerate(cuts):
                if splice[k] is None:
                    low, high = cut - width[k], min(cut + width[k], n - 1)
                    both = np.intersect1d(ends[k][(ends[k] > low) & (ends[k] < high)], ends[k + 1][(ends[k + 1] > low) & (ends[k + 1] < high)], assume_unique=True)
                    both = both[stable[both]]
                    if len(both):
                        splice[k] = int(both[np.argmin(np.abs(both - cut))])
                    else:
                        failed = k
                        break
            if failed is None:
                break
            k, room = failed, min(cuts[failed] - (cuts[failed - 1] if failed else 0), (cuts[failed + 1] if failed + 1 < len(cuts) else n) - cuts[failed])
            if 4 * width[k] < room:
                width[k] *= 2
                ends[k] = ends[k + 1] = None
            else:
                for own in (cuts, width, splice):
                    del own[k]
                ends[k : k + 2] = [None]
        bounds = [0, *splice, n]
        return sum(int(np.searchsorted(e, b, "right") - np.searchsorted(e, a, "right")) for e, a, b in zip(ends, bounds[:-1], bounds[1:], strict=True))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``n_tokens`` of every row of ``docs``.

    ``path``: a byte-level BPE vocabulary in the tokenizers format, present on every executor. A null
    or empty text has 0 of both; special strings count as the library takes them; repeated rows are
    each counted; a text without any stable boundary is encoded in one piece. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for part in slices(batches):
            data, offsets = flat(part.column(1))
            odd = np.concatenate([[0], np.cumsum(data >= UNSETTLED)])
            settled = odd[offsets[1:]] == odd[offsets[:-1]]
            found = [tokens.count(x, bool(s), chunk, overlap) for x, s in zip(part.column(1).to_pylist(), settled, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(found, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return id_and_bytes(docs, doc_id, text).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def with_limit(counts: DataFrame, limit: int = 1024) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
