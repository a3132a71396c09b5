"""Running sums per key without one task per key.

``sum(x) OVER (PARTITION BY keys ORDER BY order ROWS UNBOUNDED PRECEDING)``
runs every key in one task. ``running_sum`` range-partitions on (keys,
order) instead - Spark samples split points, so a key with very many rows
is spread over many partitions - and sums in each sorted partition. The
partition totals per key (at most one row per (key, partition)) become
offsets through a window over partitions, which is bounded by the number of
partitions a key spans. The sorted rows are checkpointed to the shared
checkpoint folder before being read twice, so partition numbers stay
consistent if tasks are re-run.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from quarry.session import ensure_checkpoint_dir


def sorted_partitions_map(df: DataFrame, sort_cols: Sequence[str], fn, schema,
                          num_partitions: int | None = None) -> DataFrame:
    """Range-partition and sort ``df`` on ``sort_cols``, run ``fn`` over each sorted
    partition (``mapInPandas``; ``fn`` may read ``TaskContext.partitionId()``), and
    checkpoint the result to the shared folder so partition numbers stay fixed for
    every later read. Without ``num_partitions`` AQE may coalesce small range
    partitions; they stay contiguous ranges, so partition order follows the sort.
    """
    ensure_checkpoint_dir(df.sparkSession)
    cols = list(sort_cols)
    ranged = (df.repartitionByRange(num_partitions, *cols) if num_partitions
              else df.repartitionByRange(*cols)).sortWithinPartitions(*cols)
    return ranged.mapInPandas(fn, schema).checkpoint(eager=True)


def _local_cumsum(keys: list[str], value: str, out: str):
    def fn(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        last_key, carry = None, 0
        for pdf in batches:
            if len(pdf) == 0:
                continue
            vals = pdf[value].to_numpy(dtype=np.int64)
            kcols = [pdf[k].astype(object).where(pdf[k].notna(), None).to_numpy() for k in keys]
            start = np.zeros(len(pdf), dtype=bool)  # a new key starts at this row
            for a in kcols:
                start[1:] |= a[1:] != a[:-1]
            continues = tuple(a[0] for a in kcols) == last_key  # first key carried over
            start[0] = True
            group = np.cumsum(start) - 1
            sums = np.cumsum(vals)
            base = np.concatenate([[0], sums])[np.flatnonzero(start)]  # sum before each group
            local = sums - base[group]
            if continues:
                local[group == 0] += carry
            res = pdf.copy()
            res[out] = pd.Series(local, dtype="int64")
            res["_pid"] = pid
            yield res
            last_key = tuple(a[-1] for a in kcols)
            carry = int(local[-1])

    return fn


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                out: str = "running", method: str = "range") -> DataFrame:
    """Add ``out`` = sum of integer ``value`` over rows of the same ``keys`` up to and
    including this one in ``order`` (rows unique on keys + order).

    ``method="window"`` is the plain window form (one task per key).
    """
    keys, order = list(keys), list(order)
    if method == "window":
        w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(*order)
        return df.withColumn(out, F.sum(value).over(
            w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    if method != "range":
        raise ValueError(method)
    if not keys:
        df = df.withColumn("_k0", F.lit(0))
        keys = ["_k0"]
    schema = Ty.StructType(list(df.schema.fields) + [
        Ty.StructField(out, Ty.LongType(), False), Ty.StructField("_pid", Ty.IntegerType(), False)])
    mapped = sorted_partitions_map(df, keys + order, _local_cumsum(keys, value, out), schema)
    tot = mapped.groupBy(*keys, "_pid").agg(F.sum(value).alias("_ptot"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.withColumn("_off", F.coalesce(F.sum("_ptot").over(before), F.lit(0))).drop("_ptot")
    off = off.withColumnsRenamed({k: f"_of_{k}" for k in [*keys, "_pid"]})
    same = mapped["_pid"] == off["_of__pid"]
    for k in keys:  # a null key is a group like any other
        same = same & mapped[k].eqNullSafe(off[f"_of_{k}"])
    res = mapped.join(off, same).withColumn(out, F.col(out) + F.col("_off"))
    return res.drop("_pid", "_off", *off.columns, *(["_k0"] if "_k0" in res.columns else []))
