"""Source divergence audit by chunk factorization: how far each source's words are from its language's.

Texts are cut at white space into chunks; a term never crosses one. Each distinct chunk of the corpus
is tokenized once, and its terms are joined back to what was counted by chunk:

1. *Blocks.* A task counts the chunks of each document, a bounded block of documents at a time, and adds
   them up by (lang, source): occurrences and documents. Chunks are dealt into buckets by their letters, so
   that "Word," and "word" meet; a block gives one packed row per bucket.
2. *Buckets.* The rows of a bucket are merged (in steps of bounded fan-in where there are many blocks), each
   distinct chunk is tokenized, and its counts go to its terms: (lang, source, term) rows, summed by Spark.
3. *Documents.* A document may hold several chunks of a term, so their documents add up to at least the
   term's, and the most frequent chunk's are at most the term's. Where both bounds fall on one side of the limit,
   the term is decided. The others' chunks (a Bloom filter of fixed size finds them in a second pass over the
   texts, a join with the dictionary makes that exact) give (document, term) rows, whose distinct documents are counted.

Shares are integers and all arithmetic is exact (decimals where a product may pass 64 bits).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.bloom import filter_of, may_hold
from quarry.llm.tables import kept, remove
from quarry.session import ensure_checkpoint_dir

#: Bytes of text and documents of a block (two-byte numbers).
BLOCK_BYTES, BLOCK_DOCS = 1 << 24, (1 << 16) - 1
#: Blocks that one task merges.
FAN = 256
#: Cells (sources x terms) and sources of one task of the pairwise comparison.
PAIR_CELLS, PAIR_SOURCES = 4_000_000, 512

#: A term: ASCII letters and bytes of other characters (of UTF-8, lower-cased A-Z).
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_NO_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())

#: Chunks (joined by line feeds), groups per chunk, and per chunk and group its number, occurrences and documents.
_PACKED = ("bucket int, block long, words binary, sizes binary, groups binary, n binary, docs binary, "
           "names array<struct<lang:string,source:string>>")
_COUNTED = ("lang string, source string, term string, n long, most long, least long, words binary, terms binary")


class _Index(dict):
    """Key -> number in order of appearance."""

    def __missing__(self, key) -> int:
        value = self[key] = len(self)
        return value


def _packed(bucket, block, words, sizes, groups, n, docs, names) -> dict:
    return {"bucket": bucket, "block": block, "words": b"\n".join(words), "sizes": sizes.astype("<u4").tobytes(),
            "groups": groups.astype("<u4").tobytes(), "n": n.astype("<u8").tobytes(), "docs": docs.astype("<u8").tobytes(),
            "names": [{"lang": a, "source": b} for a, b in names]}


def _batch(rows: list[dict], like: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=like)


_NAMES = pa.list_(pa.struct([("lang", pa.string()), ("source", pa.string())]))
_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in ("words", "sizes", "groups", "n", "docs")),
                    ("names", _NAMES)])


def _sums(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys in order, and the sums of the values of each."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return key[starts], *(np.add.reduceat(v[order], starts) if len(key) else v for v in values)


def _blocks(buckets: int, block_bytes: int):
    """Map function: (lang, source, text) -> packed rows of the blocks of a partition."""

    def rows(block, index, ids, groups):
        words = list(index)
        names = _Index()
        of_doc = np.fromiter((names[g] for g in groups), np.int64, len(groups))
        flat, doc = np.concatenate(ids).astype(np.int64), np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        once, n = _sums(flat * len(ids) + doc, np.ones(len(flat), np.int64))  # per chunk and document
        cells, n, docs = _sums(once // len(ids) * len(names) + of_doc[once % len(ids)], n, np.ones(len(once), np.int64))
        word, group = cells // len(names), cells % len(names)
        bucket = np.fromiter((zlib.crc32(w.lower().translate(None, _NO_LETTERS)) % buckets for w in words), np.int64, len(words))
        order = np.argsort(bucket[word], kind="stable")
        word, group, n, docs = word[order], group[order], n[order], docs[order]
        ends = np.searchsorted(bucket[word], np.arange(buckets + 1))
        names = list(names)
        for b in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
            cut = slice(ends[b], ends[b + 1])
            own, sizes = np.unique(word[cut], return_counts=True)  # in order already
            used, number = np.unique(group[cut], return_inverse=True)
            yield _batch([_packed(b, block, [words[i] for i in own], sizes, number, n[cut], docs[cut], [names[i] for i in used])], _ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 16
        index, ids, groups, size = _Index(), [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(),
                                              part.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    words = text.split()  # ASCII white space
                    ids.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
                    groups.append((lang, source))
                    size += len(text)
                    if size >= block_bytes or len(ids) >= BLOCK_DOCS:
                        yield from rows(block, index, ids, groups)
                        block += 1
                        index, ids, groups, size = _Index(), [], [], 0
        if index:
            yield from rows(block, index, ids, groups)

    return run


def _merged(table: pa.Table):
    """The packed rows of a bucket in one: words, groups, and per word and group occurrences and documents."""
    index, names, parts = _Index(), _Index(), []
    for r in table.to_pylist():
        words = r["words"].split(b"\n")
        ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        where = np.fromiter((names[g["lang"], g["source"]] for g in r["names"]), np.int64, len(r["names"]))
        parts.append((np.repeat(ids, np.frombuffer(r["sizes"], "<u4")), where[np.frombuffer(r["groups"], "<u4")],
                      np.frombuffer(r["n"], "<u8").astype(np.int64), np.frombuffer(r["docs"], "<u8").astype(np.int64)))
    word, group, n, docs = (np.concatenate(x) for x in zip(*parts, strict=True))
    cells, n, docs = _sums(word * len(names) + group, n, docs)
    return list(index), list(names), cells // len(names), cells % len(names), n, docs


def _merge(key: tuple, table: pa.Table) -> pa.Table:
    """Group function: packed rows -> one packed row."""
    words, names, word, group, n, docs = _merged(table)
    return pa.Table.from_batches([_batch([_packed(key[0].as_py(), key[1].as_py(), words, np.unique(word, return_counts=True)[1],
                                                  group, n, docs, names)], _ARROW)])


def _count(table: pa.Table) -> pa.Table:
    """Group function: the packed rows of a bucket -> its (lang, source, term) counts, and a row with its dictionary."""
    words, names, word, group, n, docs = _merged(table)
    index, per_word = _Index(), [_TERM.findall(w.lower()) for w in words]
    some = [(i, index[t], k) for i, ts in enumerate(per_word) for t, k in (((ts[0], 1),) if len(ts) == 1 else Counter(ts).items())]
    pairs = np.array(some, np.int64).reshape(-1, 3)  # word, term, k: by word
    many = np.bincount(pairs[:, 0], minlength=len(words))
    first = np.cumsum(many) - many
    times = many[word]  # each cell once per term of its word
    cell = np.repeat(np.arange(len(word)), times)
    pair = first[word[cell]] + np.arange(len(cell)) - np.repeat(np.cumsum(times) - times, times)
    term = pairs[pair, 1]
    cells, n_term, most = _sums(term * len(names) + group[cell], n[cell] * pairs[pair, 2], docs[cell])
    # documents of each word in each lang, and per lang and term those of its most frequent word
    langs = _Index()
    lang = np.fromiter((langs[a] for a, _ in names), np.int64, len(names))
    of_word, total = _sums(word * len(langs) + lang[group], docs)
    spread = many[of_word // len(langs)]
    at = np.repeat(np.arange(len(of_word)), spread)
    of_pair = first[of_word[at] // len(langs)] + np.arange(len(at)) - np.repeat(np.cumsum(spread) - spread, spread)
    keys = pairs[of_pair, 1] * len(langs) + of_word[at] % len(langs)
    order = np.lexsort((total[at], keys))
    last = np.flatnonzero(np.concatenate([keys[order][1:] != keys[order][:-1], [True]])) if len(keys) else np.empty(0, np.int64)
    least_keys, least = keys[order][last], total[at][order][last]
    t, g = cells // len(names), cells % len(names)
    low = least[np.searchsorted(least_keys, t * len(langs) + lang[g])]
    terms = pa.array(list(index), pa.binary()).cast(pa.string()) if index else pa.array([], pa.string())
    rows = len(cells)
    g = pa.array(g, pa.int64())
    dictionary = [b"\n".join(words), b"\n".join(b" ".join(ts) for ts in per_word)]

    def column(values, kind, tail=None):
        return pa.concat_arrays([values, pa.array([tail], kind)])

    return pa.table({
        "lang": column(pa.array([a for a, _ in names], pa.string()).take(g), pa.string()),
        "source": column(pa.array([b for _, b in names], pa.string()).take(g), pa.string()),
        "term": column(terms.take(pa.array(t, pa.int64())), pa.string()), "n": column(pa.array(n_term, pa.int64()), pa.int64()),
        "most": column(pa.array(most, pa.int64()), pa.int64()), "least": column(pa.array(low, pa.int64()), pa.int64()),
        "words": column(pa.nulls(rows, pa.binary()), pa.binary(), dictionary[0]),
        "terms": column(pa.nulls(rows, pa.binary()), pa.binary(), dictionary[1])})


def _entries(bits: bytes):
    """Map function: dictionaries (words, terms) -> chunk, term where the filter may hold the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, terms in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = [x.split(b" ") for x in terms.split(b"\n")]
                distinct = list({t for x in lines for t in x})
                held = {t for t, x in zip(distinct, may_hold(bits, distinct), strict=True) if x}
                out = [(w.decode("utf-8", "replace"), t.decode("utf-8", "replace")) for w, x in zip(words.split(b"\n"), lines, strict=True) for t in set(x) if t in held]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.string()), pa.array([t for _, t in out], pa.string())],
                                                 ["chunk", "term"])

    return run


def _holders(bits: bytes):
    """Map function: (lang, text) -> lang, document (a number of its own), chunk: the chunks the filter may hold, each
    once per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets = [set(x.split()) for x in part.column(1).cast(pa.binary()).to_pylist()]
                words = list(set().union(*sets))
                held = {w for w, x in zip(words, may_hold(bits, words), strict=True) if x}
                found = [(i, w) for i, x in enumerate(sets) for w in x & held]
                row = np.array([i for i, _ in found], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(row + number), pa.array([w.decode("utf-8", "replace") for _, w in found], pa.string())],
                    ["lang", "document", "chunk"])
                number += part.num_rows

    return run


def term_counts(df: DataFrame, min_docs: int, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """(lang, term, source, n): occurrences of each lang's kept terms (in at least ``min_docs`` of its
    documents) in each of its sources, where there are any. ``df``: lang, source, text without nulls; each
    row is a document."""
    spark = df.sparkSession
    parts = df.rdd.getNumPartitions()
    rows = df.mapInArrow(_blocks(2 * parts + 16, block_bytes), _PACKED)
    while parts > fan:  # hot chunks stand in every block: their rows are merged step by step
        parts = -(-parts // fan)
        rows = rows.groupBy("bucket", F.pmod(F.xxhash64("block"), F.lit(parts)).alias("part")).applyInArrow(_merge, _PACKED)
    counted, path = kept(rows.groupBy("bucket").applyInArrow(_count, _COUNTED))
    cells = counted.where("term is not null").groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("most").alias("most"), F.max("least").alias("least"))
    cells, cells_path = kept(cells)
    bounds = cells.groupBy("lang", "term").agg(F.sum("most").alias("most"), F.max("least").alias("least")).where(F.col("most") >= min_docs)
    bounds, bounds_path = kept(bounds)
    sure, open_terms = bounds.where(F.col("least") >= min_docs).select("lang", "term"), bounds.where(F.col("least") < min_docs).select("lang", "term")
    if not open_terms.isEmpty():
        entries = counted.where("words is not null").select("words", "terms").mapInArrow(_entries(filter_of(open_terms, "term")), "chunk string, term string")
        entries, entries_path = kept(entries.join(open_terms.select("term").distinct(), "term"))
        held = df.select("lang", "text").mapInArrow(_holders(filter_of(entries, "chunk")), "lang string, document long, chunk string")
        docs = held.join(entries, "chunk").select("lang", "term", "document").distinct().groupBy("lang", "term").agg(F.count("*").alias("docs"))
        sure = sure.unionByName(open_terms.join(docs.where(F.col("docs") >= min_docs), ["lang", "term"]).select("lang", "term"))
    out, _ = kept(cells.join(sure, ["lang", "term"]).select("lang", "term", "source", "n"))
    remove(spark, path)
    remove(spark, cells_path)
    remove(spark, bounds_path)
    return out


def _pair_sums(key: tuple, table: pa.Table) -> pa.Table:
    """Group function: shares (source, term, p; a null term: of a term that the source lacks) of some terms of a
    lang -> lang, a, b, value for the sources a of the block and all sources b after them."""
    table = table.sort_by("source")
    base = table.filter(table.column("term").is_null())
    cell = table.filter(table.column("term").is_valid())
    sources = base.column("source").to_pylist()
    where = {s: i for i, s in enumerate(sources)}
    term = cell.column("term").dictionary_encode().combine_chunks() if cell.num_rows else None
    width = len(term.dictionary) if term is not None else 0
    p = np.repeat(base.column("p").to_numpy()[:, None], width, axis=1)
    if width:
        at = np.fromiter((where[s] for s in cell.column("source").to_pylist()), np.int64, cell.num_rows)
        p[at, term.indices.to_numpy()] = cell.column("p").to_numpy()
    left, right, value = [], [], []
    for i in np.flatnonzero(base.column("home").to_numpy() == key[2].as_py()):
        sums = np.abs(p[i + 1:] - p[i]).sum(axis=1)
        left.append(np.full(len(sums), i))
        right.append(np.arange(i + 1, len(sources)))
        value.append(sums)
    names = pa.array(sources, pa.string())
    flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right, value)]
    return pa.table({"lang": pa.array([key[0].as_py()] * len(flat[0]), pa.string()), "a": names.take(pa.array(flat[0], pa.int64())),
                     "b": names.take(pa.array(flat[1], pa.int64())), "value": pa.array(flat[2], pa.int64())})


def source_divergence(df: DataFrame, min_docs: int = 30, top: int = 50, smooth: int = 5, scale: int = 1_000_000_000,
                      lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Per (lang, source): part ``pair`` with the distance to each other source of the lang (sum over all
    kept terms of the difference of their shares), and part ``term`` with the ``top`` terms whose share is above the
    lang's: lang, source, part, item, value, rank (by value descending, item ascending in UTF-8).

    A term is a run of ASCII letters and non-ASCII characters, A-Z lowered; a lang keeps those in at least
    ``min_docs`` of its documents. The share of a term with c of N occurrences of V kept terms is
    1 + floor(scale * (c + smooth) / (N + smooth * V)).

    Null text, lang and source count as empty ones; every row is a document of its own, repeated rows too.
    A group without terms has the smoothed shares only; a lang without kept terms has pairs of value 0 and
    no terms; a group alone in its lang has no pairs. Texts of any length are cut whole; ties go by item. An empty
    table gives no rows. Other columns are not looked at.
    """
    ensure_checkpoint_dir(df.sparkSession)
    docs = df.select(*[F.coalesce(df[c].cast("string"), F.lit("")).alias(n) for c, n in
                       ((lang, "lang"), (source, "source"), (text, "text"))])
    cells = term_counts(docs, min_docs)
    of_lang = cells.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = of_lang.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    per_lang = Window.partitionBy("lang")
    groups, _ = kept(groups.fillna(0, ["total", "v", "total_lang"])
                     .withColumn("many", F.count("*").over(per_lang)).withColumn(
                         "at", F.row_number().over(per_lang.orderBy("source")) - 1))

    def share(count, total):
        return F.expr(f"1 + (cast({scale} as decimal(10,0)) * (cast({count} as decimal(20,0)) + {smooth})) "
                      f"div (cast({total} as decimal(20,0)) + {smooth} * cast(v as decimal(10,0)))")

    shares, _ = kept(cells.join(groups, ["lang", "source"]).join(of_lang, ["lang", "term"]).withColumn("p", share("n", "total")).withColumn(
        "q", share("n_lang", "total_lang")).select("lang", "source", "term", "p", "q", "v", "many"))

    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                         (F.col("p") - F.col("q")).alias("value")).withColumn("rank", F.row_number().over(place))

    buckets = F.greatest(F.ceil(F.col("v") * F.col("many") / PAIR_CELLS), F.lit(1)).cast("int")
    homes = F.sequence(F.lit(0), F.floor((F.col("many") - 1) / PAIR_SOURCES).cast("int"))
    none = F.when(F.col("v") > 0, share("0", "total")).otherwise(0)
    base = groups.where("many > 1").select("lang", F.explode(F.sequence(F.lit(0), buckets - 1)).alias("bucket"), "source",
                                           F.lit(None).cast("string").alias("term"), none.alias("p"),
                                           F.floor(F.col("at") / PAIR_SOURCES).cast("int").alias("home"), homes.alias("homes"))
    some = shares.where("many > 1").select("lang", F.pmod(F.xxhash64("term"), buckets).cast("int").alias("bucket"), "source", "term", "p",
                                           F.lit(None).cast("int").alias("home"), homes.alias("homes"))
    work = base.unionByName(some).withColumn("row", F.explode("homes")).drop("homes")
    sums = work.groupBy("lang", "bucket", "row").applyInArrow(_pair_sums, "lang string, a string, b string, value long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), "value"),
                                                F.struct(F.col("b").alias("source"), F.col("a").alias("item"), "value"))))
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(place))
    return pairs.unionByName(terms.where(F.col("rank") <= top))
