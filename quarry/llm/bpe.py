"""Byte-level BPE by backtracking over longest matches.

The bytes of a vocabulary entry are written as Latin-1 characters, so a string
automaton (pyahocorasick) finds longest matches over bytes. A piece is encoded
by taking the longest entry at the current place, as long as it is compatible
with the entry before it; else shorter entries are tried, and if none is left
the entry before is given up and its place marked as a dead end. Two adjacent
entries are compatible when the merge rules would leave the border between them
uncrossed; that test walks down how the two entries are themselves built and is
remembered per pair. A dead end is never entered twice, so the work is linear in
the piece, and the result equals that of applying the merges in rank order.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as Ty

from quarry.llm.words import per_process

#: Pieces a worker remembers (short ones only) and pieces handled at once of a long text.
MEMO_PIECES, MEMO_CHARS, AT_ONCE = 400_000, 64, 1 << 17


class BytePairs:
    """The vocabulary of a rank file, with the tables that the backtracking needs."""

    def __init__(self, rank_file: str):
        import ahocorasick

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.ranks, self.size = ranks, max(ranks.values()) + 1
        self.entry = [b""] * self.size
        for entry, rank in ranks.items():
            self.entry[rank] = entry
        if any(bytes([x]) not in ranks for x in range(256)):
            raise ValueError("a byte-level vocabulary has all single bytes")
        self.automaton = ahocorasick.Automaton()
        for entry, rank in ranks.items():
            self.automaton.add_word(entry.decode("latin-1"), rank)
        self.automaton.make_automaton()
        # the longest entry that is a proper prefix of each entry; -1: none
        self.shorter = [-1] * self.size
        for entry, rank in ranks.items():
            for end in range(len(entry) - 1, 0, -1):
                if (found := ranks.get(entry[:end])) is not None:
                    self.shorter[rank] = found
                    break
        self.halves = [(r, r) for r in range(self.size)]
        self.merged: dict[tuple[int, int], int] = {}
        self._agree: dict[tuple[int, int], bool] = {}
        for rank in range(self.size):  # in rank order: halves have lower ranks
            left = self.shorter[rank]
            while left >= 0:
                right = ranks.get(self.entry[rank][len(self.entry[left]):])
                if right is not None and left < rank and right < rank and self._compatible(left, right):
                    self.halves[rank], self.merged[left, right] = (left, right), rank
                    break
                left = self.shorter[left]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border between the two entries before both are built:
        undo the later of the two inner merges step by step, and look at each pair that meets
        at the border for a merge that would have come first."""
        bound = self.size
        while True:
            if self.merged.get((left, right), self.size) < bound:
                return False
            if left > right:  # the left entry was completed later: undo it
                bound, inner = left, self.halves[left][1]
                if inner != left:
                    left = inner
                    continue
                bound, inner = right + 1, self.halves[right][0]
                if inner == right:
                    return True
                right = inner
            else:
                bound, inner = right + 1, self.halves[right][0]
                if inner != right:
                    right = inner
                    continue
                bound, inner = left, self.halves[left][1]
                if inner == left:
                    return True
                left = inner

    def compatible(self, left: int, right: int) -> bool:
        pair = (left, right)
        known = self._agree.get(pair)
        if known is None:
            if len(self._agree) >= 1 << 20:
                self._agree.clear()
            known = self._agree[pair] = self._compatible(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one piece (a match of the split pattern)."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if not piece:
            return []
        chars, n = piece.decode("latin-1"), len(piece)

        def longest(at: int) -> int:
            return next(self.automaton.iter_long(chars, at))[1]

        ids: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest(0)
        while True:
            end = at + len(self.entry[token])
            if not dead[end] and (not ids or self.compatible(ids[-1], token)):
                ids.append(token)
                at = end
                if at == n:
                    return ids
                token = longest(at)
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:  # nothing fits here: give up the entry before
                dead[at] = 1
                token = ids.pop()
                at -= len(self.entry[token])


class _Pieces(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, pairs: BytePairs):
        super().__init__()
        self.pairs = pairs

    def __missing__(self, piece: str) -> bytes:
        ids = self.pairs.encode_piece(piece.encode("utf-8", "surrogatepass"))
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = out
        return out


def _tools(rank_file: str, pattern: str):
    import regex

    def make():
        pairs = BytePairs(rank_file)
        return pairs, _Pieces(pairs), regex.compile(pattern)

    return per_process(("bpe", rank_file, pattern), make)


def encode_text(text: str | None, pieces: _Pieces, split) -> bytes:
    if not text:
        return b""
    if len(text) <= AT_ONCE:
        return b"".join([pieces[p] for p in split.findall(text)])
    out, found = [], split.finditer(text)
    while some := [pieces[m.group()] for m in islice(found, AT_ONCE)]:
        out.append(b"".join(some))
    return b"".join(out)


def decode_ids(ids: bytes | None, entry: list[bytes]) -> bytes:
    if not ids:
        return b""
    step = 4 * AT_ONCE
    return b"".join(b"".join([entry[i] for (i,) in struct.iter_unpack("<I", ids[at:at + step])])
                    for at in range(0, len(ids), step))


def _mapped(df: DataFrame, source: str, out: str, keep: list[str], work) -> DataFrame:
    """``keep`` columns and ``out`` = ``work`` over the values of ``source``, in small record batches."""
    frame = df.select(*[df[c] for c in keep], df[source].alias("_source"))
    schema = Ty.StructType([Ty.StructField(c, df.schema[c].dataType) for c in keep]
                           + [Ty.StructField(out, Ty.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                one = one or work()
                made = pa.array([one(x) for x in part.column(part.num_columns - 1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], made], [*keep, out])

    return frame.mapInArrow(run, schema)


def bpe_encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", out: str = "ids",
               keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but ``text``) and ``out``: the ids of the whole text as
    little-endian unsigned 32-bit integers in one binary value.

    ``rank_file`` (on every worker) and ``pattern`` name the tokenizer; each match of the pattern
    is encoded by itself, special tokens are ordinary text. Null and empty texts give no ids.
    Rows map one to one, so ties, repeated rows and null keys are kept as they are; an empty
    table gives no rows; a text of any length goes through in blocks of matches. A column named
    like ``out`` among ``keep`` is an error. No shuffle.
    """
    keep = [c for c in df.columns if c not in (text, out)] if keep is None else list(keep)

    def work():
        _, pieces, split = _tools(rank_file, pattern)
        return lambda text: encode_text(text, pieces, split)

    return _mapped(df, text, out, keep, work)


def bpe_decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", out: str = "decoded",
               keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) and ``out``: the bytes that the ids stand for. Null: empty."""
    keep = [c for c in df.columns if c != out] if keep is None else list(keep)

    def work():
        pairs, _, _ = _tools(rank_file, pattern)
        return lambda value: decode_ids(value, pairs.entry)

    return _mapped(df, ids, out, keep, work)
