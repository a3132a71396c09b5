"""Vectorised k-gram fingerprints of whole documents (the per-document helper of CLN1).

Per document: tokens ``[a-z0-9]+`` of the lower-cased text (as ``functions.text.ascii_tokens``), two 64-bit hashes
per distinct token, then for every window of k tokens the polynomial fingerprint sum(h[i+j] * B^j) mod 2^64,
computed for all windows at once from prefix sums weighted by B^j and the inverse powers B^-i (B odd, so invertible
mod 2^64; numpy uint64 arithmetic wraps). Two bases over two independent token hashes give 128 bits.

A fingerprint row is small but there is one per token, about eight times the text. So the texts are dealt out by
document in front of this step: one shuffle of the texts, where a file of a single row group
would otherwise be one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Odd multipliers of the two fingerprints (any odd 64-bit constants work).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
TOKEN_SEEDS = (0, 0x5151)
# Positions handed back to Spark at once, and distinct tokens whose hashes a task remembers (memory bounds).
MAX_ROWS_PER_OUTPUT, MAX_TOKENS = 250_000, 500_000

TOKEN = re.compile(r"[a-z0-9]+")

SCHEMA = ("project string, doc long, pos int, h1 long, h2 long, prev long, next long, first_line int, last_line int")


def _fingerprints(h: np.ndarray, k: int, base: int) -> np.ndarray:
    n = len(h)
    b = np.uint64(base)
    binv = np.uint64(pow(base, -1, 1 << 64))
    with np.errstate(over="ignore"):
        pw = np.cumprod(np.full(n, b, dtype=np.uint64)) * binv      # B^j, j = 0..n-1
        ipw = np.cumprod(np.full(n, binv, dtype=np.uint64)) * b     # B^-j
        s = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * pw)])
        m = n - k + 1
        return ((s[k:k + m] - s[:m]) * ipw[:m]).view(np.int64)


class Tokens(dict):
    """token -> number; the hashes of token n are ``hashes[:, n]``. At most MAX_TOKENS are remembered from text to text."""

    def __init__(self):
        import xxhash  # required on every worker: all must hash alike

        self._hash = xxhash.xxh64_intdigest
        self.hashes = np.empty((len(TOKEN_SEEDS), 1 << 14), np.uint64)

    def __missing__(self, token: str) -> int:
        value = len(self)
        if value == self.hashes.shape[1]:
            self.hashes = np.concatenate([self.hashes, np.empty_like(self.hashes)], axis=1)
        for i, seed in enumerate(TOKEN_SEEDS):
            self.hashes[i, value] = self._hash(token, seed)
        self[token] = value
        return value

    def of(self, words: list[str]) -> np.ndarray:
        """Both hashes of the tokens of a text, in order."""
        if len(self) > MAX_TOKENS:
            self.clear()
        code = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.hashes[:, code]


def text_hash(text: str | None, seed: int) -> int:
    """64-bit hash of a text or of none."""
    import xxhash

    return xxhash.xxh64_intdigest("none" if text is None else "=" + text, seed)


def apart(h: np.ndarray, k: int, places: np.ndarray) -> np.ndarray:
    """Which of the places (ascending) of k-grams count, if those of one k-gram must not overlap: in order, each that
    begins at least k tokens after the last counted one."""
    counted = np.ones(len(h), bool)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    starts = np.flatnonzero(np.concatenate([[True], ~same]))
    close = np.unique(np.searchsorted(starts, np.flatnonzero(same & (np.diff(places[order]) < k)), "right") - 1)
    for group in close:  # k-grams of short patterns that are repeated on end
        last = -k
        for at in order[starts[group]:starts[group + 1] if group + 1 < len(starts) else None].tolist():
            if places[at] - last >= k:
                last = places[at]
            else:
                counted[at] = False
    return counted


def _rolling(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column(2)[row].as_py()
                if text is None:
                    continue
                words, per_line = [], []
                for line in text.lower().split("\n"):
                    found = TOKEN.findall(line)
                    per_line.append(len(found))
                    words += found
                n = len(words)
                if n < k:
                    continue
                line = np.repeat(np.arange(1, len(per_line) + 1, dtype=np.int32), per_line)
                h1, h2 = (_fingerprints(t, k, base) for t, base in zip(tokens.of(words), BASES, strict=True))
                m = len(h1)
                prev, after, inner = np.roll(h1, 1), np.roll(h1, -1), np.arange(m)
                for at in range(0, m, MAX_ROWS_PER_OUTPUT):  # also inside a long document
                    cut = inner[at:at + MAX_ROWS_PER_OUTPUT]
                    same = pa.array(np.full(len(cut), row), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(same), batch.column(1).take(same), pa.array(cut.astype(np.int32)),
                         pa.array(h1[cut]), pa.array(h2[cut]), pa.array(prev[cut], mask=cut == 0),
                         pa.array(after[cut], mask=cut == m - 1), pa.array(line[cut]), pa.array(line[cut + k - 1])],
                        ["project", "doc", "pos", "h1", "h2", "prev", "next", "first_line", "last_line"])

    return run


def rolling_fingerprints(docs: DataFrame, project_col: str, doc_col: str, text_col: str,
                         k: int = 20) -> DataFrame:
    """(project, doc, pos, h1, h2, prev, next, first_line, last_line) for every k-gram position; prev and next are h1 of
    the k-grams one position before and after (null at the ends of the document)."""
    src = docs.select(F.col(project_col).cast("string").alias("project"),
                      F.col(doc_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    wide = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), src.rdd.getNumPartitions())
    return src.repartition(wide, "doc").mapInArrow(_rolling(k), SCHEMA)
