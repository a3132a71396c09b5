"""Personal data by patterns, and the words around it that give it away.

Information-theoretic sanitisation: what a term t tells about a protected entity c (one address or number found by
the patterns) is their pointwise mutual information, PMI(c; t) = log(p(c, t) / (p(c) p(t))), against all that can be
told, the entity's information content IC(c) = -log p(c). Probabilities are shares of the corpus's word
occurrences: t is seen with c where it stands among the nearest ``window`` words on either side. A term whose
PMI / IC reaches the threshold discloses the entity and is generalised to its shape (letters x, digits 9), or
removed where the shape itself discloses. Estimates need evidence that copies don't give: a pair must be seen in
several different surroundings (the next words outside the window), and these must be at least half of its
occurrences.

On Spark: windows are cut where entities stand and counted by partial aggregation; only terms that could qualify
are counted over the corpus (a Bloom filter of fixed size keeps the rest out of the shuffle); the places of
disclosing terms are joined to the documents by a digest of the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.llm.bloom import filter_of, may_hold
from quarry.llm.tables import kept
from quarry.session import ensure_checkpoint_dir

KINDS = ("email", "ip", "card", "phone", "term")
#: Words on either side of an entity, surroundings a pair needs, and the share of IC that discloses.
WINDOW, SURROUNDINGS, THRESHOLD = 5, 3, 0.95
#: Words counted by a task before it passes their counts on.
HELD = 500_000

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS, _WORD = re.compile(r"[0-9]+"), re.compile(r"\w+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, stop) of the patterns' matches, by kind, then start.

    An address is looked for from its @ (what stands before it is the run of allowed characters up to the last match), a
    dotted number only where a run of digits begins: the same matches as a search from every place, in linear time."""
    out = []
    if "@" in text:
        end = 0
        for m in _DOMAIN.finditer(text):
            at = start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = m.end()
                out.append((0, start, end))
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15:
                    out.append((3, *m.span()))
    return out


def outside(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """The words of a text (lower case, start, stop) that don't touch a span."""
    words = [(m.group().lower(), *m.span()) for m in _WORD.finditer(text)]
    if not spans:
        return words
    out, at, busy = [], 0, sorted((s, e) for _, s, e in spans)
    reach = -1
    for w in words:
        while at < len(busy) and busy[at][0] < w[2]:
            reach = max(reach, busy[at][1])
            at += 1
        if w[1] >= reach:
            out.append(w)
    return out


def shape(term: str) -> str:
    """The general form of a term: runs of digits become 9, other runs x."""
    return re.sub("[^9]+", "x", re.sub(r"\d+", "9", term))


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def _windows(width: int):
    """Map function: (text) -> entity, term, context of each word near an entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entity, term, context = [], [], []
            for text in batch.column(0).to_pylist():
                spans = base_spans(text or "")
                if not spans:
                    continue
                words = outside(text, spans)
                starts = [w[1] for w in words]
                near = {}  # an occurrence counts once for an entity, however often that stands nearby
                for kind, s, e in spans:
                    i = bisect_left(starts, s)
                    first, last = max(0, i - width), min(len(words), i + width)
                    edge = (words[first - 1][0] if first else "", words[last][0] if last < len(words) else "")
                    name = _digest(f"{kind}:{text[s:e].lower()}")
                    where = xxhash.xxh3_64_intdigest("\n".join(edge).encode("utf-8", "surrogatepass")) >> 1
                    for j in range(first, last):
                        near.setdefault((name, j), where)
                for (name, j), where in near.items():
                    entity.append(name)
                    term.append(words[j][0])
                    context.append(where)
            yield pa.RecordBatch.from_arrays([pa.array(entity, pa.binary()), pa.array(term, pa.string()), pa.array(context, pa.int64())],
                                             ["entity", "term", "context"])

    return run


def _counts(bits: bytes):
    """Map function: (text) -> kind, term, n: occurrences of the filter's terms, of every shape, and of all words."""

    def rows(words: Counter) -> pa.RecordBatch:
        names = list(words)
        wanted = may_hold(bits, [w.encode("utf-8", "surrogatepass") for w in names])
        shapes = Counter()
        for w, n in words.items():
            shapes[shape(w)] += n
        some = [w for w, x in zip(names, wanted, strict=True) if x]
        return pa.RecordBatch.from_arrays(
            [pa.array(["term"] * len(some) + ["shape"] * len(shapes) + ["all"], pa.string()),
             pa.array([*some, *shapes, ""], pa.string()),
             pa.array([*(words[w] for w in some), *shapes.values(), sum(words.values())], pa.int64())], ["kind", "term", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                spans = base_spans(text or "")
                words.update(w[0] for w in outside(text, spans)) if spans else words.update(_WORD.findall((text or "").lower()))
                if len(words) > HELD:
                    yield rows(words)
                    words = Counter()
        if words:
            yield rows(words)

    return run


def _share(together: str, alone: str) -> Column:
    """PMI over IC of a pair from its counts: 1 + log p(c | t) / IC(c); 0 where an entity surrounds every word."""
    content = F.log(F.col("n_all") / F.col("n_entity"))
    return F.when(content > 0, 1 + F.log(F.col(together) / F.col(alone)) / content).otherwise(0.0)


def disclosing_terms(df: DataFrame, text: str = "text", window: int = WINDOW, surroundings: int = SURROUNDINGS,
                     threshold: float = THRESHOLD) -> DataFrame:
    """(term, disclosure, replacement): the terms (lower case) that disclose an entity, with their largest PMI / IC,
    and what stands in for them: their shape, or nothing where that discloses the entity too. Null and empty texts
    tell nothing; copies of a text give one surrounding; no entities or an empty table: no rows."""
    ensure_checkpoint_dir(df.sparkSession)
    texts = df.select(df[text].cast("string").alias("text"))
    seen = texts.mapInArrow(_windows(window), "entity binary, term string, context long")
    seen, _ = kept(seen.groupBy("entity", "term", "context").agg(F.count("*").alias("n")))
    pairs = seen.groupBy("entity", "term").agg(F.sum("n").alias("n_pair"), F.count("*").alias("contexts"))
    pairs, _ = kept(pairs.where((F.col("contexts") >= surroundings) & (2 * F.col("contexts") >= F.col("n_pair"))))
    if pairs.isEmpty():
        return df.sparkSession.createDataFrame([], "term string, disclosure double, replacement string")
    counts = texts.mapInArrow(_counts(filter_of(pairs, "term")), "kind string, term string, n long")
    counts, _ = kept(counts.groupBy("kind", "term").agg(F.sum("n").alias("n")))
    general = F.regexp_replace(F.regexp_replace("term", r"\p{Nd}+", "9"), "[^9]+", "x")
    totals = seen.groupBy("entity").agg(F.sum("n").alias("n_entity"))
    shapes = seen.groupBy("entity", general.alias("form")).agg(F.sum("n").alias("n_form"))
    every = counts.where("kind = 'all'").select(F.col("n").alias("n_all"))
    rows = (pairs.withColumn("form", general).join(totals, "entity").join(shapes, ["entity", "form"])
            .join(counts.where("kind = 'term'").select("term", F.col("n").alias("n_term")), "term")
            .join(counts.where("kind = 'shape'").select(F.col("term").alias("form"), F.col("n").alias("n_shape")), "form")
            .withColumn("n_all", F.lit(every.first()["n_all"]))  # one row
            .withColumn("disclosure", _share("n_pair", "n_term")).where(F.col("disclosure") >= threshold))
    known = F.max(_share("n_form", "n_shape")) >= threshold
    return rows.groupBy("term").agg(F.max("disclosure").alias("disclosure"),
                                    F.when(known, "").otherwise(F.max("form")).alias("replacement"))


def _base(names: list[str]):
    """Map function: the columns ``names`` and _source -> ``names``, the text's digest, and its base spans."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("_source").to_pylist()]
            spans = [[{"kind": KINDS[k], "start": s, "stop": e} for k, s, e in base_spans(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(map(_digest, texts), pa.binary()),
                                              pa.array(spans, kind)], [*names, "_print", "_base"])

    return run


def _places(bits: bytes):
    """Map function: (text) -> digest, term, start, stop of the words that the filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, lists = ["_print", "term", "start", "stop"], ([], [], [], [])
            texts = [t or "" for t in batch.column(0).to_pylist()]
            words = list(set().union(*(_WORD.findall(t.lower()) for t in texts)))
            some = may_hold(bits, [w.encode("utf-8", "surrogatepass") for w in words])
            held = {w for w, x in zip(words, some, strict=True) if x}
            for t in texts:
                if held.isdisjoint(_WORD.findall(t.lower())):
                    continue
                name = _digest(t)
                for row in outside(t, base_spans(t)):
                    if row[0] in held:
                        for column, value in zip(lists, (name, *row), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(lists[0], pa.binary()), pa.array(lists[1], pa.string()),
                                              pa.array(lists[2], pa.int64()), pa.array(lists[3], pa.int64())], names)

    return run


def private_spans(df: DataFrame, keep: list[str], text: str = "text", **how) -> DataFrame:
    """The ``keep`` columns of every row and ``spans``: array<struct<kind, start, stop, replacement>> by kind (email, ip, card,
    phone, term), then start; places in characters, the stop exclusive. ``how``: as for ``disclosing_terms``.

    Null and empty texts have no spans. Patterns may overlap; terms don't touch them. Rows with the same text have the same
    spans; texts of any length are searched whole; an empty table gives no rows. A column named ``spans`` or starting
    with an underscore must not be among ``keep``."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    rows = df.select(*[df[c] for c in keep], df[text].cast("string").alias("_source"))
    found = StructType.fromDDL("_print binary, _base array<struct<kind:string,start:bigint,stop:bigint>>")
    based = rows.mapInArrow(_base(list(keep)), StructType([*rows.drop("_source").schema.fields, *found.fields]))
    label = F.transform("_base", lambda s: F.struct(s["kind"], s["start"], s["stop"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("replacement")))
    terms, _ = kept(disclosing_terms(df, text, **how))
    if terms.isEmpty():
        return based.select(*keep, label.alias("spans"))
    places = rows.select("_source").mapInArrow(_places(filter_of(terms, "term")), "_print binary, term string, start long, stop long")
    found = places.join(terms, "term").groupBy("_print").agg(F.array_sort(F.collect_set(
        F.struct(F.lit("term").alias("kind"), "start", "stop", "replacement"))).alias("_terms"))
    found, _ = kept(found)
    none = F.array().cast("array<struct<kind:string,start:bigint,stop:bigint,replacement:string>>")
    return based.join(found, "_print", "left").select(*keep, F.concat(label, F.coalesce("_terms", none)).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:stop of the spans in order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        texts = []
        for t, spans in zip(batch.column("_whole").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            if t is not None:
                out, done = [], 0
                for s in sorted(spans, key=lambda s: (s["start"], -s["stop"])):
                    if s["start"] >= done:
                        out += [t[done:s["start"]], s["replacement"]]
                    done = max(done, s["stop"])
                t = "".join([*out, t[done:]])
            texts.append(t)
        rest = [n for n in names if n != "_whole"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(texts, pa.string())], [*rest, "sanitised"])


def sanitise(df: DataFrame, keep: list[str], text: str = "text", **how) -> DataFrame:
    """``private_spans`` with the text itself, ``sanitised``: patterns become their kind in brackets, disclosing terms their
    shape or nothing; of spans that overlap, the first (the longer one of two that start together) gives the replacement
    and all are covered. A null text stays null. ``sanitised`` must not be among ``keep``."""
    found = private_spans(df.withColumn("_whole", df[text].cast("string")), [*keep, "_whole"], text, **how)
    schema = found.drop("_whole").schema.add("sanitised", "string")
    return found.mapInArrow(_replace, schema)
