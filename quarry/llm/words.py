"""Shared small helpers of the Python steps: ASCII-white-space words and their hashes."""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import xxhash

_SPACE = re.compile(r"[ \t-\r]")
#: Characters of text split into words at once; longer texts go through in pieces.
PIECE_CHARS = 1 << 20
#: Words whose hash a worker remembers before it starts afresh (about 80 MB).
MEMO_WORDS = 400_000

_MIX1 = np.uint64(0xFF51AFD7ED558CCD)
_MIX2 = np.uint64(0xC4CEB9FE1A85EC53)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def per_process(key: object, make: Callable[[], object]) -> object:
    """``make()`` once per Python process and key. Functions shipped by value bring
    fresh module globals with every task, so what is dear to build lives in sys.modules."""
    module = sys.modules.setdefault("quarry_worker_store", types.ModuleType("quarry_worker_store"))
    store = module.__dict__.setdefault("store", {})
    if key not in store:
        store[key] = make()
    return store[key]


def text_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut only before ASCII white space."""
    at = 0
    while len(text) - at > size:
        m = _SPACE.search(text, at + size)
        if not m:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:] if at else text


def split_words(piece: str) -> list[bytes]:
    """Lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; bytes.split() has these separators."""
    return piece.encode("utf-8", "surrogatepass").lower().split()


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to MEMO_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the words of a whole text, in order."""
        if not text:
            return np.empty(0, np.uint64)
        parts = []
        for piece in text_pieces(text):
            words = split_words(piece)
            parts.append(np.fromiter(map(self.__getitem__, words), np.uint64, len(words)))
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX2
    return x ^ (x >> np.uint64(33))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; a shorter, non-empty sequence is
    one shingle by itself; no words give none."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(n, width)
    acc = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        acc = mix(acc * _MULT + hashes[i:n - k + 1 + i])
    return np.unique(acc)
