"""Which k-grams of a project are repeated, decided in blocks of documents without a row per token.

A k-gram's anchor is the least fingerprint of the shorter runs inside it (half its length). It depends on the k-gram's
tokens only, so the places of a repeated k-gram have equal anchors at different places: about one anchor per k / 3
tokens is counted, and only k-grams whose anchor stands in more than one place of the project are looked at further.

A block is the documents of one hash value (the same ones whatever order the input is read in). What blocks send is
packed, one row per block and bucket of hashes, and what comes back is a byte per hash. So a k-gram that a third of all
documents hold is one entry per block, and the texts are shuffled once, as often as Spark reuses that exchange.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.fingerprints import BASES, TOKEN, Tokens, _fingerprints, apart, text_hash

#: Blocks of documents, and buckets of hashes, per input partition.
BLOCKS, BUCKETS = 16, 8
ANCHORS = "bucket int, block long, hashes binary, twice binary"
GRAMS = "bucket int, block long, grams binary"
#: A block's k-gram: hashes with the project's, hashes of its neighbours, and flags.
_GRAM = np.dtype([("a", "<u8"), ("b", "<u8"), ("prev", "<u8"), ("next", "<u8"), ("flags", "u1")])
#: Flags: stands twice; each place has the same k-gram before, after it.
TWICE, PREV, NEXT = 1, 2, 4
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _sliding(x: np.ndarray, width: int, of) -> np.ndarray:
    """The least (or greatest) of each ``width`` values in a row."""
    size, n = 1, len(x) - width + 1
    while 2 * size <= width:
        x = of(x[:-size], x[size:])
        size *= 2
    return of(x[:n], x[width - size:width - size + n])


def _dealt(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of hashes by bucket, and where each bucket ends."""
    with np.errstate(over="ignore"):
        bucket = ((hashes * _MULT) >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _packed(block: int, hashes: np.ndarray, buckets: int, /, **values: np.ndarray) -> pa.Table:
    """One row per bucket that has any of the hashes, with the ``values`` of its hashes as bytes."""
    order, ends = _dealt(hashes, buckets)
    some = np.flatnonzero(ends[1:] > ends[:-1])
    return pa.table({"bucket": pa.array(some.astype(np.int32)), "block": pa.array(np.full(len(some), block, np.int64))} | {
        name: pa.array([x[order[ends[b]:ends[b + 1]]].tobytes() for b in some], pa.binary()) for name, x in values.items()})


def _answers(hashes: np.ndarray, table: pa.Table, column: str, buckets: int) -> np.ndarray:
    """The byte of each of a block's hashes, from the rows that came back to the block."""
    order, ends = _dealt(hashes, buckets)
    out = np.zeros(len(hashes), np.uint8)
    table = table.filter(pc.is_valid(table.column(column)))
    for bucket, x in zip(table.column("bucket").to_pylist(), table.column(column).to_pylist(), strict=True):
        out[order[ends[bucket]:ends[bucket + 1]]] = np.frombuffer(x, np.uint8)
    return out


def _returned(table: pa.Table, values: np.ndarray, sizes: list[int], column: str) -> pa.Table:
    cuts = np.cumsum([0, *sizes])
    return pa.table({"bucket": table.column("bucket"), "block": table.column("block"),
                     column: pa.array([values[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})


class _Block:
    """The tokens of a block's documents in a row, with the anchors of their k-grams."""

    def __init__(self, docs: pa.Table, k: int, memo: dict):
        tokens = memo.setdefault("tokens", Tokens()) if "tokens" not in memo else memo["tokens"]
        self.k, self.docs = k, docs
        parts = [tokens.of(TOKEN.findall((text or "").lower())) for text in docs.column("text").to_pylist()]
        self.h = np.concatenate(parts, axis=1)
        sizes = np.array([p.shape[1] for p in parts])
        self.first, self.row = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(parts)), sizes)
        names = docs.column("project").to_pylist()
        of = {name: [text_hash(name, seed) for seed in (7, 8)] for name in set(names)}
        self.salt = np.array([of[name] for name in names], np.uint64).T
        half, n = (k + 1) // 2, self.h.shape[1]
        self.whole = self.row[:n - k + 1] == self.row[k - 1:] if n >= k else np.empty(0, bool)
        self.anchors, runs, width = np.empty(0, np.uint64), np.empty(0, np.uint64), k - half + 1
        self.own = np.empty(0, bool)
        if n >= k:
            runs = _fingerprints(self.h[0], half, BASES[0]).view(np.uint64)
            self.anchors, edge = _sliding(runs, width, np.minimum), np.zeros(width - 1, np.uint64)
            # anchors of some k-gram: the greatest of the anchors of all k-grams around them
            self.own = _sliding(np.concatenate([edge, np.where(self.whole, self.anchors, 0), edge]), width, np.maximum) == runs
        places = np.flatnonzero(self.own)
        self.place_row = self.row[places]
        self.hashes, self.number, self.counts = np.unique(
            runs[places] ^ self.salt[0][self.place_row], return_inverse=True, return_counts=True)

    def candidates(self, answers: pa.Table, buckets: int) -> np.ndarray:
        """Places in the block of the k-grams that may be repeated."""
        repeated = _answers(self.hashes, answers, "repeated", buckets) > 0
        rows = np.zeros(self.docs.num_rows, bool)
        rows[self.place_row[repeated[self.number]]] = True
        at = np.flatnonzero(self.whole & rows[self.row[:len(self.whole)]])
        return at[repeated[np.searchsorted(self.hashes, self.anchors[at] ^ self.salt[0][self.row[at]])]] if len(at) else at


class _Grams:
    """A block's k-grams that may be repeated, at the places that count (``apart``)."""

    def __init__(self, block: _Block, at: np.ndarray):
        k, row = block.k, block.row
        self.h1, self.h2 = (_fingerprints(h, k, base).view(np.uint64) if len(at) else np.empty(0, np.uint64)
                            for h, base in zip(block.h, BASES, strict=True))
        with np.errstate(over="ignore"):
            own = self.h1[at] ^ (row[at].astype(np.uint64) * _MULT)  # the places of one document
        counted = block.whole.copy()
        counted[at] = apart(own, k, at)
        self.at = at = at[counted[at]]
        m = len(counted)
        # the k-gram before and after, of the same document
        self.before = np.zeros(m, bool)
        self.before[1:] = counted[1:] & counted[:-1] & (row[1:m] == row[:max(m - 1, 0)])
        after = np.append(self.before[1:], False)
        a, b = (h[at] ^ s[row[at]] for h, s in zip((self.h1, self.h2), block.salt, strict=True))
        prev, later = (np.where(has[at], self.h1[np.clip(at + by, 0, m - 1)], 0).astype(np.uint64) if len(at) else a
                       for has, by in ((self.before, -1), (after, 1)))
        flags = np.where(self.before[at], PREV, 0) | np.where(after[at], NEXT, 0)
        self.grams = np.zeros(len(at), _GRAM)
        for name, value in zip(_GRAM.names, (a, b, prev, later, flags.astype(np.uint8)), strict=True):
            self.grams[name] = value
        self.grams, self.number = _merged(self.grams)


def _merged(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One entry per k-gram; and the entry of each of the given ones."""
    order = np.lexsort((grams["b"], grams["a"]))
    g = grams[order]
    new = np.ones(len(g), bool)
    new[1:] = (g["a"][1:] != g["a"][:-1]) | (g["b"][1:] != g["b"][:-1])
    head = np.flatnonzero(new)
    number = np.empty(len(g), np.int64)
    number[order] = np.cumsum(new) - 1
    out = g[head]
    if len(head):
        twice = (np.bitwise_or.reduceat(g["flags"], head) & TWICE) | (np.diff(np.append(head, len(g))) > 1)
        both = np.bitwise_and.reduceat(g["flags"], head)
        for name, flag in (("prev", PREV), ("next", NEXT)):
            both &= np.where(np.minimum.reduceat(g[name], head) == np.maximum.reduceat(g[name], head), 255, 255 - flag).astype(np.uint8)
        out["flags"] = (both & (PREV | NEXT)) | twice.astype(np.uint8)
    return out, number


def _send_anchors(k: int, buckets: int):
    """Group function: a block -> its anchors, packed by bucket."""
    memo: dict = {}

    def run(docs: pa.Table) -> pa.Table:
        block = _Block(docs, k, memo)
        return _packed(docs.column("block")[0].as_py(), block.hashes, buckets, hashes=block.hashes, twice=(block.counts > 1).astype(np.uint8))

    return run


def _count_anchors(table: pa.Table) -> pa.Table:
    """Group function: the rows of a bucket -> bucket, block, repeated: a byte per anchor, 1 where it stands in two places."""
    lists = [np.frombuffer(x, "<u8") for x in table.column("hashes").to_pylist()]
    _, number, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    repeated = counts > 1
    repeated[number[np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("twice").to_pylist()]) > 0]] = True
    return _returned(table, repeated[number].astype(np.uint8), [len(x) for x in lists], "repeated")


def _send_grams(k: int, buckets: int):
    """Cogroup function: a block and its repeated anchors -> its k-grams that may be repeated, packed by bucket."""
    memo: dict = {}

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(docs, k, memo)
        grams = _Grams(block, block.candidates(answers, buckets)).grams
        return _packed(docs.column("block")[0].as_py(), grams["a"], buckets, grams=grams)

    return run


def _count_grams(table: pa.Table) -> pa.Table:
    """Group function: the rows of a bucket -> bucket, block, flags: a byte per k-gram."""
    lists = [np.frombuffer(x, _GRAM) for x in table.column("grams").to_pylist()]
    grams, number = _merged(np.concatenate(lists))
    return _returned(table, grams["flags"][number], [len(x) for x in lists], "flags")


def _rows(block: _Block, at: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> dict:
    """Columns of the k-grams at some places of a block."""
    row = block.row[at]
    pick = pa.array(row, pa.int64())
    return {"project": block.docs.column("project").take(pick), "doc": block.docs.column("doc").take(pick),
            "pos": pa.array((at - block.first[row]).astype(np.int32)), "h1": pa.array(h1[at].view(np.int64)), "h2": pa.array(h2[at].view(np.int64))}


def _find_grams(k: int, buckets: int):
    """Cogroup function: a block and its repeated anchors -> a row per k-gram that may be repeated."""
    memo: dict = {}

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(docs, k, memo)
        at = block.candidates(answers, buckets)
        h1, h2 = (_fingerprints(h, k, base).view(np.uint64) if len(at) else np.empty(0, np.uint64) for h, base in zip(block.h, BASES, strict=True))
        return pa.table(_rows(block, at, h1, h2))

    return run


def _find_ends(k: int, buckets: int):
    """Cogroup function: a block and all answers -> the ends of its runs of repeated k-grams that always occur as a whole."""
    memo: dict = {}

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(docs, k, memo)
        g = _Grams(block, block.candidates(answers, buckets))
        flags = np.zeros(len(g.before) + 1, np.uint8)
        flags[g.at] = _answers(g.grams["a"], answers, "flags", buckets)[g.number]
        # joined to the next one: each place of either stands next to the other
        joined = ((flags[:-1] & NEXT) > 0) & ((flags[1:] & PREV) > 0) & np.append(g.before[1:], False)
        head, tail = ~np.append(False, joined[:-1]), ~joined
        at = np.flatnonzero(((flags[:-1] & TWICE) > 0) & (head | tail))
        line = np.zeros(len(block.row), np.int32)
        texts = docs.column("text")
        for row in np.unique(block.row[at]).tolist():
            found = [len(TOKEN.findall(x)) for x in texts[row].as_py().lower().split("\n")]
            line[block.first[row]:block.first[row] + sum(found)] = np.repeat(np.arange(1, len(found) + 1), found)
        return pa.table(_rows(block, at, g.h1, g.h2) | {
            "first_line": pa.array(line[at]), "last_line": pa.array(line[at + k - 1]), "head": pa.array(head[at]), "tail": pa.array(tail[at])})

    return run


class Repeats:
    """The repeated k-grams of (project, doc, text) rows."""

    def __init__(self, docs: DataFrame, project_col: str, doc_col: str, text_col: str, k: int):
        rows = docs.select(F.col(project_col).cast("string").alias("project"), F.col(doc_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
        self.parts = parts = rows.rdd.getNumPartitions()
        self.k, self.buckets = k, BUCKETS * parts + 16
        self.blocks = rows.where("text is not null").select(
            F.pmod(F.xxhash64("project", "doc", "text"), F.lit(BLOCKS * parts)).alias("block"), "project", "doc", "text")
        self.anchors = (self.blocks.groupBy("block").applyInArrow(_send_anchors(k, self.buckets), ANCHORS)
                        .groupBy("bucket").applyInArrow(_count_anchors, "bucket int, block long, repeated binary"))

    def _with(self, answers: DataFrame, function, schema: str) -> DataFrame:
        return self.blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(function(self.k, self.buckets), schema)

    def grams(self) -> DataFrame:
        """(project, doc, pos, h1, h2): every place of every repeated k-gram, and few others."""
        return self._with(self.anchors, _find_grams, "project string, doc long, pos int, h1 long, h2 long")

    def ends(self) -> DataFrame:
        """(project, doc, pos, h1, h2, first_line, last_line, head, tail): the first and last k-grams of the runs of
        repeated k-grams that always occur as a whole; overlapping places of a k-gram in a document count once (``apart``)."""
        flags = self._with(self.anchors, _send_grams, GRAMS).groupBy("bucket").applyInArrow(_count_grams, "bucket int, block long, flags binary")
        answers = self.anchors.withColumn("flags", F.lit(None).cast("binary")).unionByName(flags, allowMissingColumns=True)
        return self._with(answers, _find_ends, "project string, doc long, pos int, h1 long, h2 long, first_line int, last_line int, "
                                               "head boolean, tail boolean")
