"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights (term = component number). A block of
candidate rows is turned into postings: per term, the rows that hold it and their
weights. Each query row walks its own terms and scatters query weight times
posting weights into a dense array of scores, one per row of the block; the best
k are selected from it, kept per partition and merged over all partitions.

The query set goes over all rows in blocks of at most QUERY_BLOCK queries, each
broadcast (a bounded size) and answered by one map-only pass over the candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries broadcast at once, and candidate rows with one dense score array.
QUERY_BLOCK, SCORE_BLOCK = 16_384, 8_192
#: A weight beyond this magnitude is taken as that: products of two, summed over 2**10 components, fit 38 digits.
_LARGEST = float(1 << 58)
#: Scores on their way to the merge.
_SCORE = pa.decimal128(38, 0)


def integer_weights(vectors: Column, scale: int) -> Column:
    """floor(scale * x) per component as array<long>, at most 2^58 in magnitude; null for vectors that are null or
    hold null or non-finite components."""
    bound = F.lit(_LARGEST)
    weights = F.transform(vectors, lambda x: F.floor(F.least(F.greatest(x.cast("double") * F.lit(float(scale)), -bound), bound)).cast("long"))
    bad = F.exists(vectors, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.when(vectors.isNotNull() & ~F.coalesce(bad, F.lit(True)), weights)


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a list column: row number, term and weight of each non-zero weight."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    weights = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    term = np.arange(len(weights)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    some = weights != 0
    return row[some], term[some], weights[some]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, in that order."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= kth)
    else:
        at = np.arange(len(scores))
    if scores.dtype == object:  # wider than 64 bits
        return np.array(sorted(at.tolist(), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _search(queries, k: int):
    """Map function: a partition's candidates -> its best k per query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q_terms, q_weights = queries.value
        top: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(q_ids)
        for whole in batches:
            for at in range(0, whole.num_rows, SCORE_BLOCK):
                batch = whole.slice(at, SCORE_BLOCK)
                ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                row, term, weight = _rows(batch.column(1))
                order = np.argsort(term, kind="stable")
                row, term, weight = row[order], term[order], weight[order]
                names, first = np.unique(term, return_index=True)
                stops = np.append(first[1:], len(term))
                postings = {int(t): (row[a:b] if b - a < len(ids) else slice(None), weight[a:b])
                            for t, a, b in zip(names, first, stops, strict=True)}
                largest = max((abs(int(w)) for w in (weight.min(initial=0), weight.max(initial=0))), default=0)
                for n, own in enumerate(q_ids):
                    wide = largest * sum(map(abs, q_weights[n])) >= 1 << 62  # else no sum can overflow
                    scores = np.zeros(len(ids), object if wide else np.int64)
                    for t, w in zip(q_terms[n], q_weights[n], strict=True):
                        if t in postings:
                            rows, weights = postings[t]
                            scores[rows] += w * (weights.astype(object) if wide else weights)
                    others = np.flatnonzero(ids != own)
                    s, i = scores[others], ids[others]
                    if top[n] is not None:
                        s, i = np.concatenate([top[n][0], s]), np.concatenate([top[n][1], i])
                    best = _best(s, i, k)
                    top[n] = (s[best], i[best])
        found = [n for n, t in enumerate(top) if t is not None and len(t[0])]
        for at in range(0, len(found), 1024):
            some = found[at:at + 1024]
            yield pa.RecordBatch.from_pydict({
                "query_id": pa.array(np.concatenate([np.full(len(top[n][0]), q_ids[n]) for n in some])),
                "vec_id": pa.array(np.concatenate([top[n][1] for n in some])),
                "score": pa.concat_arrays([pa.array(top[n][0].tolist(), pa.int64()).cast(_SCORE) if top[n][0].dtype != object
                                           else pa.array([Decimal(x) for x in top[n][0]], _SCORE) for n in some])})

    return run


def top_k(df: DataFrame, queries: Column, k: int = 10, scale: int = 1024, vec_id: str = "vec_id",
          vector: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """Per row for which ``queries`` holds, the ``k`` other rows with the highest integer inner
    product, over all rows: query_id, rank (from 1), vec_id, score. Ties go to the smaller vec_id.

    Weights are floor(scale * x), at most 2^58 in magnitude. Rows whose vector is null or holds null or non-finite
    components take no part, nor do rows without an id; an empty vector scores 0; scores are exact and ranked so, and
    one beyond 64 bits is shown as the nearest long; vectors of unlike lengths meet in the terms they share. "Other" goes by id: rows that repeat the
    query's id are not its candidates; other repeated rows are candidates each; a repeated query
    id is answered once, by its first weights in order. A query without candidates and an empty
    table give no rows. Other columns are not looked at.
    """
    spark = df.sparkSession
    base = df.select(df[vec_id].cast("long").alias("vec_id"), integer_weights(df[vector], scale).alias("weights"),
                     queries.alias("asks"))
    base = base.where("vec_id is not null and weights is not null")
    asked = base.where("asks").groupBy("vec_id").agg(F.min("weights").alias("weights"))
    n_blocks = -(-asked.count() * 5 // 4 // query_block)  # blocks by hash: room for uneven ones
    parts = []
    for b in range(n_blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b).toArrow() if n_blocks > 1 \
            else asked.toArrow()
        row, term, weight = _rows(block.column("weights"))
        cuts = np.searchsorted(row, np.arange(1, block.num_rows))
        value = (block.column("vec_id").to_pylist(), [x.tolist() for x in np.split(term, cuts)],
                 [x.tolist() for x in np.split(weight, cuts)]) if block.num_rows else ([], [], [])
        parts.append(base.select("vec_id", "weights").mapInArrow(
            _search(spark.sparkContext.broadcast(value), k), "query_id long, vec_id long, score decimal(38,0)"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", F.least(F.greatest("score", F.lit(-2 ** 63).cast("decimal(38,0)")),
                                                          F.lit(2 ** 63 - 1).cast("decimal(38,0)")).cast("long").alias("score")))
