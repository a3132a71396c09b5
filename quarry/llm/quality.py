"""Quality classifier: regularised quadratic discriminant over document statistics.

Each whole text becomes a short vector of transformed statistics (lengths, character
classes, vocabulary, repetition). Per class of the labels, moment sums give a mean
and a covariance, shrunk towards the pooled diagonal. A document's score compares
its log-densities under the two classes, each a Mahalanobis distance computed with
the cached Cholesky factor of the class covariance.

Fitting reads all labelled training rows: moments are summed per partition and then
over partitions, so a few hundred numbers reach the driver whatever the input's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from quarry.llm.words import WordHashes, mix, per_process
from quarry.session import ensure_checkpoint_dir

FEATURES = ("log_chars", "log_words", "log_word_length", "letters", "upper", "digits", "punctuation",
            "odd_symbols", "sentence_ends", "distinct_words", "top_word", "repeated_pairs",
            "log_line_words", "repeated_lines")
#: Share of the pooled diagonal in each class covariance, and what softens the log-density difference.
SHRINKAGE, RIDGE, TEMPERATURE, THRESHOLD = 0.1, 1e-3, 4.0, 0.7

_OTHER, _LOWER, _UPPER, _DIGIT, _SPACE, _PUNCT, _ODD, _END, _HIGH, _INNER = range(10)


def _classes() -> np.ndarray:
    """Class of each byte: UTF-8 lead bytes beyond ASCII count as letters, continuation bytes as nothing."""
    out = np.full(256, _OTHER, np.uint8)
    for chars, kind in (("abcdefghijklmnopqrstuvwxyz", _LOWER), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER),
                        ("0123456789", _DIGIT), (" \t\n\r\x0b\x0c", _SPACE), (",;:'\"()-", _PUNCT),
                        (".!?", _END), ("#$%&*+/<=>@[\\]^_`{|}~", _ODD)):
        for c in chars:
            out[ord(c)] = kind
    out[0x80:0xC0] = _INNER
    out[0xC0:] = _HIGH
    return out


_CLASS_OF = _classes()


def _share(part: float, whole: float) -> float:
    return float(np.arcsin(np.sqrt(min(1.0, part / whole)))) if whole > 0 else 0.0


def statistics(text: str | None, hashes: WordHashes) -> list[float]:
    """The FEATURES of a whole text; zeros for a null or empty one."""
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return [0.0] * len(FEATURES)
    kinds = np.zeros(10, np.int64)
    for at in range(0, len(raw), 1 << 20):
        kinds += np.bincount(_CLASS_OF[np.frombuffer(raw, np.uint8, min(1 << 20, len(raw) - at), at)], minlength=10)
    chars = len(raw) - int(kinds[_INNER])
    inked = chars - int(kinds[_SPACE])
    letters = int(kinds[_LOWER] + kinds[_UPPER] + kinds[_HIGH])
    words = hashes.of(text)
    n = len(words)
    _, counts = np.unique(words, return_counts=True)
    pairs = len(np.unique(mix(words[:-1]) + words[1:])) if n > 1 else 0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        float(np.log1p(chars)), float(np.log1p(n)), float(np.log1p(inked / n)) if n else 0.0,
        _share(letters, inked), _share(int(kinds[_UPPER]), letters), _share(int(kinds[_DIGIT]), inked),
        _share(int(kinds[_PUNCT]), inked), _share(int(kinds[_ODD]), inked), _share(int(kinds[_END]), n),
        _share(len(counts), n), _share(int(counts.max()) if n else 0, n), _share(n - 1 - pairs, n - 1),
        float(np.log1p(n / len(lines))) if lines else 0.0,
        _share(len(lines) - len(set(lines)), len(lines)),
    ]


def with_statistics(df: DataFrame, text: str = "text", out: str = "features",
                    keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but the text) and ``out``: the statistics as array<double>."""
    keep = [c for c in df.columns if c not in (text, out)] if keep is None else list(keep)
    frame = df.select(*[df[c] for c in keep], df[text].alias("_source"))
    kinds = frame.drop("_source").schema.add(out, Ty.ArrayType(Ty.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                hashes = hashes if hashes is not None else per_process("word hashes", WordHashes)
                part = batch.slice(at, 512)
                made = [statistics(t, hashes) for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(made, pa.list_(pa.float64()))],
                                                 [*keep, out])

    return frame.mapInArrow(run, kinds)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per label, the count, sums and sums of products of a partition's vectors, as one list."""
    d = len(FEATURES)
    sums = {}
    for batch in batches:
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        y = batch.column(0).to_numpy(zero_copy_only=False)
        for label in (0, 1):
            own = x[y == label]
            if len(own):
                part = np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
                sums[label] = sums.get(label, 0) + part
    yield pa.RecordBatch.from_pydict({"label": pa.array(list(sums), pa.int32()),
                                      "sums": pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))})


class Discriminant:
    """The fitted model: per class mean, Cholesky factor and log-determinant, and the log prior ratio."""

    def __init__(self, sums: dict[int, np.ndarray], shrinkage: float, ridge: float):
        d = len(FEATURES)
        count = {k: float(s[0]) for k, s in sums.items()}
        self.trained = count.get(0, 0) > 0 and count.get(1, 0) > 0
        self.only = 1.0 if count.get(1, 0) >= count.get(0, 0) else 0.0
        if not self.trained:
            return
        mean = {k: s[1:d + 1] / s[0] for k, s in sums.items()}
        second = {k: s[d + 1:].reshape(d, d) / s[0] for k, s in sums.items()}
        n = count[0] + count[1]
        self.centre = (sums[0][1:d + 1] + sums[1][1:d + 1]) / n
        spread = (sums[0][d + 1:] + sums[1][d + 1:]).reshape(d, d) / n - np.outer(self.centre, self.centre)
        self.scale = np.sqrt(np.maximum(np.diag(spread), 1e-12)) + 1e-6
        own = {k: (second[k] - np.outer(mean[k], mean[k])) / np.outer(self.scale, self.scale) for k in (0, 1)}
        pooled = np.diag(sum(count[k] * np.diag(own[k]) for k in (0, 1)) / n)
        self.mean = {k: (mean[k] - self.centre) / self.scale for k in (0, 1)}
        self.factor, self.log_det = {}, {}
        for k in (0, 1):
            share = min(1.0, shrinkage + d / (d + count[k]))  # few rows: mostly the pooled diagonal
            self.factor[k] = np.linalg.cholesky((1 - share) * own[k] + share * pooled + ridge * np.eye(d))
            self.log_det[k] = 2 * float(np.log(np.diag(self.factor[k])).sum())
        self.log_prior = float(np.log(count[1] / count[0]))

    def scores(self, x: np.ndarray, temperature: float) -> np.ndarray:
        if not self.trained:
            return np.full(len(x), self.only)
        z = (x - self.centre) / self.scale
        log_density = {}
        for k in (0, 1):
            r = np.linalg.solve(self.factor[k], (z - self.mean[k]).T)
            log_density[k] = -0.5 * ((r * r).sum(0) + self.log_det[k])
        gap = (log_density[1] - log_density[0] + self.log_prior) / temperature
        return 1.0 / (1.0 + np.exp(-np.clip(gap, -700, 700)))


def fit(features: DataFrame, label: str = "label", column: str = "features",
        shrinkage: float = SHRINKAGE, ridge: float = RIDGE) -> Discriminant:
    """Fit on all rows whose label is 0 or 1 (others are passed over)."""
    known = features.where(F.col(label).isin(0, 1)).select(F.col(label).cast("int"), column)
    parts = known.mapInArrow(_moments, "label int, sums array<double>")
    rows = (parts.select("label", F.posexplode("sums").alias("at", "x"))
            .groupBy("label", "at").agg(F.sum("x").alias("x")).orderBy("label", "at").collect())
    sums: dict[int, list[float]] = {}
    for r in rows:
        sums.setdefault(r.label, []).append(r.x)
    return Discriminant({k: np.array(v) for k, v in sums.items()}, shrinkage, ridge)


def score(features: DataFrame, model: Discriminant, column: str = "features", out: str = "score",
          temperature: float = TEMPERATURE) -> DataFrame:
    """All other columns and ``out``: how likely label 1 is, 0 to 1."""
    keep = [c for c in features.columns if c not in (column, out)]
    frame = features.select(*keep, column)
    kinds = frame.drop(column).schema.add(out, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(len(keep)).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.scores(x, temperature))], [*keep, out])

    return frame.mapInArrow(run, kinds)


def classify(df: DataFrame, labels: DataFrame, train: Column | None = None, doc_id: str = "doc_id",
             text: str = "text", label: str = "quality", keep: list[str] | None = None,
             threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns of every document (default: doc_id), ``score`` and ``predicted`` (1 from the
    threshold on). Learns from the documents with a 0/1 label for which ``train`` (a condition on
    ``keep`` columns; default: all) holds; labels and ids are never inputs of a score.

    A null or empty text has all-zero statistics and a score like any other; a null doc_id is
    scored, but has no label; a document's contradictory labels count as 1; repeated documents
    are scored (and learnt from) each; other label values are ignored. Without both labels, the
    score is 1 (or 0, if only label 0 was seen). An empty table gives no rows. Statistics are
    checkpointed, so texts are read once.
    """
    ensure_checkpoint_dir(df.sparkSession)
    keep = [doc_id] if keep is None else list(keep)
    features = with_statistics(df, text, "_features", keep).checkpoint()
    known = labels.where(labels[label].isin(0, 1) & labels[doc_id].isNotNull()).groupBy(
        labels[doc_id].alias("_doc")).agg(F.max(label).alias("_label"))
    chosen = features if train is None else features.where(train)
    pairs = chosen.join(known, chosen[doc_id] == known["_doc"]).select("_label", "_features")
    model = fit(pairs, "_label", "_features")
    scored = score(features, model, "_features", "score")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
