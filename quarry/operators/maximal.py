"""Maximal token clones (CLN1, CLN2): every repeated fragment that can't be extended, with all its occurrences.

A fragment of at least k tokens is a clone if it occurs twice or more in a project, and maximal if no longer fragment
has the same occurrences: not all of them continue, or begin, alike. Where texts 1 and 3 share 100 tokens and
text 2 holds the first 50 of them, there are two: 100 tokens in {1, 3} and 50 in {1, 2, 3}. No pair of
occurrences is ever formed, and a fragment copied a million times is one group of a partially aggregated count.
Overlapping places of one k-gram in a document count once (a word repeated on end is no clone of itself at every
length): after a counted place, the next one begins at least k tokens later.

1. *Symbols.* Two neighbouring k-grams belong together if each occurrence of one stands next to the other (one
   count per k-gram, and whether one k-gram is before and after all its places, decide that: ``repeats``). Runs of such
   k-grams occur as a whole; a text becomes the short sequence of its runs, its symbols. A maximal
   clone begins and ends with a symbol.
2. *Extents.* If not all occurrences of a window of symbols have the same symbol before them, the same is true of every
   shorter window from there, as that has those occurrences and more. So a symbol has a left extent, the most symbols
   that a window from it may have, and likewise a right extent for windows that end with it. Windows of 1, 2, 4, ... symbols
   are tested in packed blocks (``repeats``), a few lengths a round and only where those of the round before held: both extents are
   known to a factor of two after logarithmically many rounds, and to a quarter after one more.
3. *Windows.* The windows within both extents of their ends are counted with the symbol before and after them: where all
   occurrences share one, the fragment isn't maximal and goes. Nearly all that become rows are occurrences of clones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.fingerprints import BASES, text_hash
from quarry.operators.repeats import _GRAM, GRAMS, NEXT, PREV, TWICE, Repeats, _answers, _count_grams, _merged, _packed
from quarry.operators.stored import drop, stored

#: Candidate windows that a block looks at together (a memory bound).
MAX_WINDOWS = 4_000_000
#: Doublings of the length that are tested in one round, and blocks of symbols for each input partition.
STEP, BLOCKS = 3, 2
ANSWERS = "bucket int, block long, flags binary"
#: The level of the tests between the lengths of the rounds.
BETWEEN = -1


def symbols(repeats: Repeats) -> tuple[DataFrame, str]:
    """(project, doc, start, stop, s1, s2, first_line, last_line, block): the runs of repeated k-grams that always occur as a
    whole, named by their first k-gram; ``stop`` is the position of the last one. Also the path of the table."""
    rows = repeats.ends()
    # of a document's ends, each head that isn't a tail is followed by its tail
    place = Window.partitionBy("project", "doc").orderBy("pos")
    rows = rows.select(
        "project", "doc", F.col("pos").alias("start"), F.when(F.col("tail"), F.col("pos")).otherwise(F.lead("pos").over(place)).alias("stop"),
        F.col("h1").alias("s1"), F.col("h2").alias("s2"), "first_line",
        F.when(F.col("tail"), F.col("last_line")).otherwise(F.lead("last_line").over(place)).alias("last_line"), "head",
        F.pmod(F.xxhash64("project", "doc"), F.lit(BLOCKS * repeats.parts + 16)).alias("block"))
    return stored(rows.where("head").drop("head"))


class _Chains:
    """The symbols of a block's documents in order; neighbours hang together in chains. The tests whose answers are given
    are gone through again: ``left`` and ``right`` are how many lengths 1, 2, 4, ... of windows from, and up to, a symbol have held."""

    def __init__(self, table: pa.Table, answers: pa.Table, buckets: int):
        table = table.sort_by([(c, "ascending") for c in ("project", "doc", "start", "stop")])
        self.table, self.n, self.buckets = table, table.num_rows, buckets
        self.col = {c: table.column(c).to_numpy() for c in table.column_names if c not in ("project", "doc", "block")}
        place = np.arange(self.n)
        docs = list(zip(table.column("project").to_pylist(), table.column("doc").to_pylist(), strict=True))
        new = np.array([x != y for x, y in zip(docs[1:], docs, strict=False)], bool)
        self.doc = np.concatenate([[0], np.cumsum(new)])
        broken = new | (self.col["start"][1:] != self.col["stop"][:-1] + 1)
        ends, starts = np.append(np.flatnonzero(broken), self.n - 1), np.append(0, np.flatnonzero(broken) + 1)
        self.first, self.last = starts[np.searchsorted(starts, place, "right") - 1], ends[np.searchsorted(ends, place)]
        of = {name: [text_hash(name, seed) for seed in (7, 8)] for name, _ in set(docs)}
        self.salt = np.array([of[name] for name, _ in docs], np.uint64).T
        self.sums, self.back = [], []
        with np.errstate(over="ignore"):
            for name, base in (("s1", BASES[0]), ("s2", BASES[1])):
                h, b, inverse = self.col[name].view(np.uint64), np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
                power = np.cumprod(np.full(self.n, b)) * inverse
                self.back.append(np.cumprod(np.full(self.n, inverse)) * b)
                self.sums.append(np.concatenate([[np.uint64(0)], np.cumsum(h * power)]))
        self.left, self.right = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        levels = np.array(answers.column("level").to_pylist(), np.int64)
        for level in range(int(levels.max(initial=-1)) + 1):
            self._learn(level, answers.filter(pa.array(levels == level)))
        # the greatest lengths that may hold
        self.from_, self.to = ((1 << powers) - 1 for powers in (self.left, self.right))
        if (levels == BETWEEN).any():
            self._narrow(answers.filter(pa.array(levels == BETWEEN)))

    def hashes(self, at: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        """Both hashes of the windows from ``at`` to ``last``."""
        with np.errstate(over="ignore"):
            return [(sums[last + 1] - sums[at]) * back[at] for sums, back in zip(self.sums, self.back, strict=True)]

    def lengths(self, level: int) -> list[tuple[int, int]]:
        """The lengths tested at a level, each with how many powers must have held."""
        if level != BETWEEN:
            return [(1 << i, STEP * level) for i in range(STEP * level, STEP * level + STEP)]
        most = int(max(self.left.max(initial=0), self.right.max(initial=0)))
        return [(n, i + 1) for i in range(1, most) for n in sorted({(1 << i) * c // 4 for c in (5, 6, 7)} - {1 << i})]

    def tests(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last symbols of the windows tested at a level. All occurrences of a window are tested or none, as
        windows at its start and end decide that."""
        firsts, lasts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for size, held in self.lengths(level):
            some = self.left >= held
            from_end = np.flatnonzero(self.right >= held) - size + 1
            some[from_end[from_end >= 0]] = True
            at = np.flatnonzero(some)
            at = at[at + size - 1 <= self.last[at]]
            firsts.append(at)
            lasts.append(at + size - 1)
        return np.concatenate(firsts), np.concatenate(lasts)

    def grams(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The windows tested at a level, an entry for each different one; the entry, first and last symbol of each."""
        at, last = self.tests(level)
        out = np.zeros(len(at), _GRAM)
        before, after = at > self.first[at], last < self.last[last]
        names = self.col["s1"].view(np.uint64)
        for name, value, salt in zip(("a", "b"), self.hashes(at, last), self.salt, strict=True):
            out[name] = value ^ salt[at]
        out["prev"][before], out["next"][after] = names[at[before] - 1], names[last[after] + 1]
        out["flags"] = np.where(before, PREV, 0) | np.where(after, NEXT, 0)
        grams, number = _merged(out)
        return grams, number, at, last

    def _held(self, level: int, answers: pa.Table):
        grams, number, at, last = self.grams(level)
        flags = _answers(grams["a"], answers, "flags", self.buckets)[number]
        twice = (flags & TWICE) > 0
        return at, last, twice & ((flags & PREV) == 0), twice & ((flags & NEXT) == 0)

    def _learn(self, level: int, answers: pa.Table) -> None:
        at, last, left, right = self._held(level, answers)
        size = last - at + 1
        for i in range(STEP * level, STEP * level + STEP):
            for held, places in ((self.left, at[left & (size == 1 << i)]), (self.right, last[right & (size == 1 << i)])):
                held[places[held[places] == i]] = i + 1

    def _narrow(self, answers: pa.Table) -> None:
        at, last, left, right = self._held(BETWEEN, answers)
        size = last - at + 1
        for bound, powers, places, held in ((self.from_, self.left, at, left), (self.to, self.right, last, right)):
            own = ~held & (size >> (np.maximum(powers[places], 1) - 1) == 1)  # between the last length that held and the next
            np.minimum.at(bound, places[own], size[own] - 1)


def _send_windows(level: int, buckets: int):
    """Cogroup function: a block and the answers so far -> the windows tested at a level, packed by bucket."""

    def run(syms: pa.Table, answers: pa.Table) -> pa.Table:
        grams = _Chains(syms, answers, buckets).grams(level)[0]
        return _packed(syms.column("block")[0].as_py(), grams["a"], buckets, grams=grams)

    return run


def extents(syms: DataFrame, buckets: int) -> tuple[DataFrame, list[str]]:
    """The answers to the tests of windows: bucket, block, flags (a byte per window of the block), level. Also the paths of
    the tables read for them. Rounds end when no window is left to be tested."""
    spark, syms = syms.sparkSession, syms.drop("first_line", "last_line")
    answers, paths = spark.createDataFrame([], ANSWERS + ", level int"), []

    def ask(level: int) -> bool:
        nonlocal answers
        sent = syms.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_send_windows(level, buckets), GRAMS)
        flags, path = stored(sent.groupBy("bucket").applyInArrow(_count_grams, ANSWERS).withColumn("level", F.lit(level)))
        paths.append(path)
        answers = answers.unionByName(flags) if len(paths) > 1 else flags
        return not flags.isEmpty()

    level = 0
    while ask(level):
        level += 1
    if level > 1:
        ask(BETWEEN)
    return answers, paths


def _windows(buckets: int):
    """Cogroup function: the symbols of a block and all answers -> its windows within both extents; ``in_doc`` of a window's
    first row counts its places in the document, that of its other rows is 0."""

    def run(syms: pa.Table, answers: pa.Table) -> pa.Table:
        c = _Chains(syms, answers, buckets)
        starts, stops = np.flatnonzero(c.from_), np.flatnonzero(c.to)
        low = np.searchsorted(stops, starts)
        many = np.searchsorted(stops, np.minimum(starts + c.from_[starts] - 1, c.last[starts]), "right") - low
        total = np.cumsum(many)
        firsts, lasts, begin = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        while begin < len(starts):
            done = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, done + MAX_WINDOWS, "right")))
            size = many[begin:end]
            last = stops[np.repeat(low[begin:end] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            at = np.repeat(starts[begin:end], size)
            both = last - at < c.to[last]
            firsts.append(at[both])
            lasts.append(last[both])
            begin = end
        at, last = np.concatenate(firsts), np.concatenate(lasts)
        size, hashes = last - at + 1, [h.view(np.int64) for h in c.hashes(at, last)]
        keys = (c.doc[at], *hashes, size)
        order = np.lexsort(keys[::-1])
        same = np.all([x[order][1:] == x[order][:-1] for x in keys], axis=0)
        heads = np.flatnonzero(np.concatenate([np.ones(min(len(at), 1), bool), ~same]))
        in_doc = np.zeros(len(at), np.int32)
        in_doc[order[heads]] = np.diff(np.append(heads, len(at)))
        col, pick = c.col, pa.array(at)
        before, after = np.roll(col["s1"], 1), np.roll(col["s1"], -1)
        return pa.table({
            "project": c.table.column("project").take(pick), "doc": c.table.column("doc").take(pick),
            "start": pa.array(col["start"][at], pa.int32()), "size": pa.array(size, pa.int32()),
            "grams": pa.array(col["stop"][last] - col["start"][at] + 1, pa.int32()), "w1": pa.array(hashes[0]), "w2": pa.array(hashes[1]),
            "prev": pa.array(before[at], mask=at == c.first[at]), "next": pa.array(after[last], mask=last == c.last[last]),
            "first_line": pa.array(col["first_line"][at], pa.int32()), "last_line": pa.array(col["last_line"][last], pa.int32()),
            "in_doc": pa.array(in_doc)})

    return run


WINDOW_SCHEMA = ("project string, doc long, start int, size int, grams int, w1 long, w2 long, prev long, next long, "
                 "first_line int, last_line int, in_doc int")
KEY = ["project", "w1", "w2", "size"]


def clone_windows(docs: DataFrame, project_col: str, doc_col: str, text_col: str, k: int = 20) -> DataFrame:
    """Every window of symbols that may be a clone, one row per occurrence (see ``WINDOW_SCHEMA``)."""
    repeats = Repeats(docs, project_col, doc_col, text_col, k)
    syms, syms_path = symbols(repeats)
    buckets = repeats.parts + 16
    answers, paths = extents(syms, buckets)
    windows, _ = stored(syms.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_windows(buckets), WINDOW_SCHEMA))
    drop(docs.sparkSession, syms_path, *paths)
    return windows


def maximal_clones(windows: DataFrame, k: int = 20) -> DataFrame:
    """One row per maximal clone: project, w1, w2, size (its key), tokens, n_occ, n_docs, the first occurrence (doc,
    start, first_line, last_line), lines, and both kinds as flags: ``same_file`` (some document holds more than one
    occurrence) and ``across_file`` (some document holds just one). One partially aggregated ``groupBy``; a
    fragment of a third of all documents is combined before the shuffle. A null project is a project."""
    alone = {c: (F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c)) for c in ("prev", "next")}
    found = windows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_occ"), F.count_if(F.col("in_doc") > 0).alias("n_docs"),
        F.min(F.struct("doc", "start", "first_line", "last_line")).alias("first"), F.first("grams").alias("grams"),
        (F.max("in_doc") > 1).alias("same_file"), F.bool_or(F.col("in_doc") == 1).alias("across_file"),
        F.coalesce(alone["prev"] | alone["next"], F.lit(False)).alias("extends"))
    return found.where("n_occ >= 2 and not extends").select(
        *KEY, (F.col("grams") + (k - 1)).cast("long").alias("tokens"), "n_occ", "n_docs", "first.*",
        (F.col("first.last_line") - F.col("first.first_line") + 1).alias("lines"), "same_file", "across_file")


def clone_occurrences(windows: DataFrame, clones: DataFrame) -> DataFrame:
    """The occurrences of the clones: project, the clone's first occurrence and tokens (its natural key), doc, start, line."""
    c = clones.select(*[F.col(x).alias("_" + x) for x in KEY], "tokens", F.col("doc").alias("first_doc"), F.col("start").alias("first_start"))
    same = F.col("project").eqNullSafe(F.col("_project"))
    for x in KEY[1:]:
        same = same & (F.col(x) == F.col("_" + x))
    return windows.join(c, same).select("project", "first_doc", "first_start", "tokens", "doc", "start", F.col("first_line").alias("line"))
