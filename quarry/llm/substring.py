"""Removal of repeated lines and passages: unit hashing with global digests and original offsets.

Every whole text has two kinds of units: its lines of at least ``min_words`` words, and all runs of ``run_words`` + 1
words, wherever they start, line breaks folded. A unit is normalised (case, white space) and hashed to 128 bits. The
earliest occurrence over all documents, by (doc_id, place), stays; every other one is cut out, and cuts that overlap
merge.

1. *Candidates.* A word run's anchor is the least hash of the shorter word runs inside it (half its length). It
   depends on the run's words only, so equal runs have equal anchors wherever they stand: about one anchor per 13
   words is counted instead of a digest per word, and only units whose anchor (or line) stands in more than one
   place can be repeated. The counts are packed by blocks of documents (``packed``).
2. *Earliest places.* A block sends the first place of each candidate digest, packed by bucket; the others in the block
   are repeats anyway, so a line that a third of all documents hold is one entry per block. What comes back
   is a byte per digest: whether an earlier place exists elsewhere.
3. *Cutting.* The block's documents meet that answer, and the spans are merged and cut out.

Texts are shuffled by block, once for steps 2 and 3 together where Spark reuses the exchange; nothing is kept in
tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quarry.llm.packed import BLOCK_BYTES, CLASSES, PACKED, PER_BLOCK, cut, frequencies, numbered, packed, unpacked
from quarry.llm.words import mix, per_process

#: Shorter lines are no units: common phrases repeat without being copied.
MIN_WORDS = 10
#: A passage has more words than that.
RUN_WORDS = 50
#: Distinct words a task remembers.
HELD = 200_000
_WORD = re.compile(r"\S+")  # the words of str.split()
_NONE = np.empty(0, np.uint64)
#: A digest's place: its document (known: not null) by id and hash of the text, and where it stands there.
_PLACE = np.dtype([("high", "<u8"), ("low", "<u8"), ("known", "u1"), ("id", "<i8"), ("print", "<i8"), ("place", "<i4")])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_MULT, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def unit_digest(words: list[str]) -> bytes:
    """Digest of the normal form of a line (lower case, single spaces), given its lower-cased words."""
    return xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "replace"))


class _Words(dict):
    """Lower-cased word -> 64-bit hash, remembered up to HELD words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= HELD:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, words: list[str]) -> np.ndarray:
        """Hashes of words, in order."""
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _runs(h: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hashes of all runs of ``length`` words, put together from runs of powers of two."""
    out, done, size, by = None, 0, 1, _MULT
    while True:
        if length & size:
            out = h if out is None else out[:len(h) - done] * by + h[done:done + len(out)]
            done += size
        if 2 * size > length:
            return out
        h = h[:-size] * by + h[size:]
        by = np.multiply(by, by)
        size *= 2


def _sliding(x: np.ndarray, width: int, of=np.minimum) -> np.ndarray:
    """The least (or greatest) of each ``width`` values in a row."""
    size, n = 1, len(x) - width + 1
    while 2 * size <= width:
        x = of(x[:-size], x[size:])
        size *= 2
    return of(x[:n], x[width - size:width - size + n])


def _half(length: int) -> tuple[int, int]:
    """Words of an anchor's run, and how many such runs a unit has."""
    half = (length + 1) // 2
    return half, length - half + 1


class _Block:
    """The units of a block of texts: lines, and word runs with their anchors."""

    def __init__(self, texts: list, min_words: int, length: int | None):
        self.texts = [t or "" for t in texts]
        self.length, hashes = length, per_process("passage words", _Words)
        self.lines, self.words, self.anchors, places = [], [], [], []
        for t in self.texts:
            found, parts, every, at = [], [], [], 0
            # the words of a text are those of its lines: each line is lower-cased and split once for both kinds of units
            for line in t.split("\n"):
                stop, words = min(at + len(line) + 1, len(t)), line.lower().split()
                if len(words) >= min_words and line:
                    found.append((*np.frombuffer(unit_digest(words), np.uint64).tolist(), at, stop))
                if length:
                    every += words
                    if len(every) >= HELD:
                        parts.append(hashes.of(every))
                        every = []
                at = stop
            self.lines.append(found)
            places.append(np.array([x[0] for x in found], np.uint64))
            words, least = np.concatenate([*parts, hashes.of(every)]) if length else _NONE, _NONE
            if length and len(words) >= length:
                half, width = _half(length)
                runs = _runs(words, half)
                least = _sliding(runs, width)
                edge = np.zeros(width - 1, np.uint64)
                places.append(runs[_sliding(np.concatenate([edge, least, edge]), width, np.maximum) == runs])
            self.words.append(words)
            self.anchors.append(least)
        self.distinct, self.counts = np.unique(np.concatenate(places) if places else _NONE, return_counts=True)

    def entries(self, rank: np.ndarray, repeated: np.ndarray) -> dict[str, np.ndarray]:
        """The units that may be repeated: digest (high, low), row, its rank, place (order inside a text), start, stop."""
        parts = [[] for _ in range(6)]

        def often(x):
            return repeated[np.searchsorted(self.distinct, x)]

        for row, text in enumerate(self.texts):
            found = [x for x in self.lines[row] if often(np.uint64(x[0]))]
            if found:
                x = np.array([f[:2] for f in found], np.uint64)
                span = np.array([f[2:] for f in found], np.int64)
                for part, value in zip(parts, (x[:, 0], x[:, 1], np.full(len(x), row), span[:, 0], span[:, 0], span[:, 1]), strict=True):
                    part.append(value)
            some = np.flatnonzero(often(self.anchors[row])) if len(self.anchors[row]) else ()
            if len(some):
                h = self.words[row]
                at = np.array([m.span() for m in _WORD.finditer(text)], np.int64)
                for part, value in zip(parts, (_runs(h, self.length)[some], _runs(mix(h ^ _OTHER), self.length)[some], np.full(len(some), row), some,
                                               at[some, 0], at[some + self.length - 1, 1]), strict=True):
                    part.append(value)
        names = ("high", "low", "row", "place", "start", "stop")
        out = {n: np.concatenate(x) if x else np.empty(0, np.uint64 if n in names[:2] else np.int64) for n, x in zip(names, parts, strict=True)}
        return out | {"rank": rank[out["row"]]}


def _order(ids: pa.ChunkedArray, prints: np.ndarray) -> np.ndarray:
    """The rank of each row by id (null first), then by its text's hash; equal rows have equal ranks."""
    null = ids.is_null().to_numpy()
    keys = np.stack([(~null).astype(np.int64), ids.fill_null(0).to_numpy(), prints], 1)
    order = np.lexsort((keys[:, 2], keys[:, 1], keys[:, 0]))
    new = np.concatenate([[False], (keys[order][1:] != keys[order][:-1]).any(axis=1)])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _firsts(high, low, *place) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per digest, in order: the entry with the least place; the digest's number of each entry; and whether an entry
    has that place itself."""
    order = np.lexsort((*place[::-1], low, high))
    h, w = high[order], low[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])]) if len(h) else np.empty(0, bool)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    head = order[new]
    same = np.ones(len(order), bool)
    for p in place:
        same &= p == p[head][number]
    return head, number, same


def _counted(min_words: int, length: int | None, buckets: int, size: int):
    """Map function: (..., text) -> the block's anchors and line hashes, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in numbered(batches, size):
            block = _Block(table.column(table.num_columns - 1).to_pylist(), min_words, length)
            yield packed(number, block.distinct, block.counts, buckets)

    return run


def _tagged(names: list[str], size: int):
    """Map function: the rows (text last) with their block's number in front."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in numbered(batches, size):
            for batch in table.to_batches():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, number, np.int64)), *batch.columns], ["block", *names])

    return run


def _candidates(docs: pa.Table, answers: pa.Table, min_words: int, length: int | None, buckets: int):
    """A block's entries, sorted out: (entries, head of each digest, digest of each entry, whether it has the head's place)."""
    block = _Block(docs.column("_source").to_pylist(), min_words, length)
    classes = answers.filter(pc.is_valid(answers.column("classes")))
    rank = _order(docs.column("_id"), docs.column("_print").to_numpy())
    e = block.entries(rank, unpacked(block.distinct, classes, buckets) > 0)
    return e, *_firsts(e["high"], e["low"], e["rank"], e["place"])


def _heads(min_words: int, length: int | None, buckets: int):
    """Cogroup function: a block's documents and classes -> the first place of each candidate digest, packed by bucket."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        e, head, _, _ = _candidates(docs, answers, min_words, length, buckets)
        row = e["row"][head]
        ids = docs.column("_id")
        entry = np.zeros(len(head), _PLACE)
        entry["high"], entry["low"], entry["place"] = e["high"][head], e["low"][head], e["place"][head]
        entry["known"], entry["id"] = ids.is_valid().to_numpy()[row], ids.fill_null(0).to_numpy()[row]
        entry["print"] = docs.column("_print").to_numpy()[row]
        order, ends = cut(entry["high"], buckets)
        some = np.flatnonzero(ends[1:] > ends[:-1])
        number = docs.column("block")[0].as_py()
        return pa.table({"bucket": pa.array(some.astype(np.int32)), "block": pa.array(np.full(len(some), number, np.int64)),
                         "places": pa.array([entry[order[ends[b]:ends[b + 1]]].tobytes() for b in some], pa.binary())})

    return run


def _earliest(table: pa.Table) -> pa.Table:
    """Group function: places of a bucket -> bucket, block, later: a byte per place, 1 where another block has an earlier one."""
    lists = [np.frombuffer(x, _PLACE) for x in table.column("places").to_pylist()]
    e = np.concatenate(lists)
    _, _, same = _firsts(e["high"], e["low"], e["known"], e["id"], e["print"], e["place"])
    later, cuts = (~same).astype(np.uint8), np.cumsum([0, *map(len, lists)])
    return pa.table({"bucket": table.column("bucket"), "block": table.column("block"),
                     "later": pa.array([later[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})


def _without(names: list[str], min_words: int, length: int | None, buckets: int):
    """Cogroup function: a block's documents and all answers -> ``names``, the cut text and the spans."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        e, head, number, same = _candidates(docs, answers, min_words, length, buckets)
        order, ends = cut(e["high"][head], buckets)
        later = np.zeros(len(head), bool)
        found = answers.filter(pc.is_valid(answers.column("later")))
        for bucket, x in zip(found.column("bucket").to_pylist(), found.column("later").to_pylist(), strict=True):
            later[order[ends[bucket]:ends[bucket + 1]]] = np.frombuffer(x, np.uint8) == 1
        gone = ~same | later[number]
        row, start, stop = (e[c][gone] for c in ("row", "start", "stop"))
        order = np.lexsort((stop, start, row))
        row, start, stop = row[order], start[order], stop[order]
        texts, spans = [], []
        ends = np.searchsorted(row, np.arange(docs.num_rows + 1))
        for i, text in enumerate(docs.column("_source").to_pylist()):
            own = []
            for s, t in zip(start[ends[i]:ends[i + 1]].tolist(), stop[ends[i]:ends[i + 1]].tolist(), strict=True):
                if own and s < own[-1]["stop"]:
                    own[-1]["stop"] = max(own[-1]["stop"], t)
                else:
                    own.append({"start": s, "stop": t})
            if own:
                cuts = [0, *(x for o in own for x in (o["start"], o["stop"])), len(text)]
                text = "".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
            texts.append(text)
            spans.append(own)
        return pa.table([*(docs.column(n) for n in names), pa.array(texts, pa.string()), pa.array(spans, _SPANS)],
                        names=[*names, "_text", "_spans"])

    return run


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None,
                   min_words: int = MIN_WORDS, run_words: int | None = None, removed: str = "removed",
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every document with the repeated units cut out of its text: the ``keep`` columns (default:
    all, the text replaced) and ``removed`` (the column's name), the cut spans (start, stop; characters of the original
    text, in order). A unit's earliest occurrence over all documents stays, by doc_id (a long; null
    first), then text, then place; a repeat inside one document goes as well.

    Units are lines of at least ``min_words`` words, their end included, and, with ``run_words``, passages of more words than
    that (lower-cased, between white space; line breaks count as spaces), wherever they start and stop: every word that
    stands in such a run with an earlier place goes, and the earlier place may overlap it. Spans that overlap are put
    together; spans that only touch stay apart.

    A null text stays null and an empty one empty, with nothing removed; a document may end up
    empty, but its row stays. Rows with the same doc_id and the same text count as one document
    and get the same cuts. Lines of any length are hashed whole. An empty table gives no rows. A column named like
    ``removed`` must not be among ``keep``. ``df`` must give the same rows in the same order when read again, as files do.
    """
    keep = list(df.columns) if keep is None else list(keep)
    if removed in keep:
        raise ValueError(f"a column {removed} is there already")
    rest = [c for c in keep if c != text]
    names = [f"_k{i}" for i in range(len(rest))]
    rows = df.select(*[df[c].alias(n) for c, n in zip(rest, names, strict=True)], df[doc_id].cast("long").alias("_id"),
                     F.coalesce(F.xxhash64(df[text]), F.lit(0)).alias("_print"), df[text].cast("string").alias("_source"))
    length = run_words + 1 if run_words else None
    buckets = PER_BLOCK * df.rdd.getNumPartitions() + 16
    classes = rows.select("_source").mapInArrow(_counted(min_words, length, buckets, block_bytes), PACKED).groupBy("bucket").applyInArrow(
        frequencies, CLASSES)
    columns = StructType([StructField("block", LongType()), *rows.schema.fields])
    tagged = rows.mapInArrow(_tagged(rows.columns, block_bytes), columns)
    places = tagged.groupBy("block").cogroup(classes.groupBy("block")).applyInArrow(
        _heads(min_words, length, buckets), "bucket int, block long, places binary")
    later = places.groupBy("bucket").applyInArrow(_earliest, "bucket int, block long, later binary")
    answers = classes.withColumn("later", F.lit(None).cast("binary")).unionByName(later, allowMissingColumns=True)
    schema = StructType([*rows.schema.fields[:len(rest)], *StructType.fromDDL(
        "_text string, _spans array<struct<start:bigint,stop:bigint>>").fields])
    out = tagged.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_without(names, min_words, length, buckets), schema)
    places_of = dict(zip(rest, names, strict=True)) | {text: "_text"}
    return out.select(*[F.col(places_of[c]).alias(c) for c in keep], F.col("_spans").alias(removed))
