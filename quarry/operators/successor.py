"""Next row of the same key in a given order, without putting a hot key in one task.

``lead(...) OVER (PARTITION BY keys ORDER BY order)`` sends every row of a key
to one task; when one key holds a large share of all rows that task is the
whole job. ``next_in_order`` instead range-partitions on (keys, order) -
Spark samples the data for split points, so a hot key is spread over many
partitions - and computes successors inside each sorted partition. Only the
last row of a partition can have its successor in a later partition; those
tails (at most one per partition) are resolved against the first row of the
next non-empty partition. The heads/tails tables have at most
``num_partitions`` rows (default: the shuffle partition count), so
broadcasting them is bounded by a parameter.

The range-partitioned, sorted rows are checkpointed to the shared
checkpoint folder before they are read twice, so partition numbers stay
consistent even when tasks are re-run after an executor loss.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from quarry.operators.prefix import sorted_partitions_map

_INT_TYPES = (Ty.ByteType, Ty.ShortType, Ty.IntegerType, Ty.LongType)


def _null_column(values: np.ndarray, mask: np.ndarray, is_int: bool) -> pd.Series:
    if is_int:
        arr = pd.array(values, dtype="Int64")
        arr[~mask] = pd.NA
        return pd.Series(arr)
    out = values.astype(object)
    out[~mask] = None
    return pd.Series(out)


def _successor_fn(keys: list[str], carry: list[str], prefix: str, int_carry: set[str], matched_only: bool):
    def fn(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        held = None
        head_sent = False

        def finish(pdf: pd.DataFrame, kind: str, nxt: dict) -> pd.DataFrame:
            out = pdf.reset_index(drop=True).copy()
            for c in carry:
                out[prefix + c] = nxt[c]
            out["_kind"] = kind
            out["_pid"] = pid
            return out

        def empty_next(n: int) -> dict:
            return {c: _null_column(np.zeros(n, dtype=np.int64) if c in int_carry
                                    else np.empty(n, dtype=object), np.zeros(n, bool),
                                    c in int_carry) for c in carry}

        for pdf in batches:
            if len(pdf) == 0:
                continue
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not head_sent:
                yield finish(pdf.iloc[:1], "head", empty_next(1))
                head_sent = True
            n = len(pdf)
            if n > 1:
                same = np.ones(n - 1, dtype=bool)
                for k in keys:
                    a = pdf[k].to_numpy()
                    null = pd.isna(a)
                    same &= ((a[1:] == a[:-1]) & ~null[1:]) | (null[1:] & null[:-1])
                some = same if matched_only else np.ones(n - 1, dtype=bool)
                nxt = {c: _null_column(pdf[c].to_numpy()[1:][some], same[some], c in int_carry) for c in carry}
                yield finish(pdf.iloc[: n - 1][some], "row", nxt)
            held = pdf.iloc[n - 1:].reset_index(drop=True)
        if held is not None:
            yield finish(held, "tail", empty_next(1))

    return fn


def next_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  carry: Sequence[str], prefix: str = "next_",
                  num_partitions: int | None = None, method: str = "range",
                  matched_only: bool = False) -> DataFrame:
    """Add ``prefix + c`` for c in ``carry``: the values of the next row with the same
    ``keys`` in ``order`` (NULL for the last row of a key; null keys are equal). Rows must be
    unique on (keys, order). ``matched_only`` leaves out rows without a next row, before
    anything is written; the first carried column must not be null then.

    ``method="window"`` is the plain ``lead`` form (one task per key), kept for
    small inputs and as the reference in tests.
    """
    keys, order, carry = list(keys), list(order), list(carry)
    if method == "window":
        w = Window.partitionBy(*keys).orderBy(*order)
        out = df
        for c in carry:
            out = out.withColumn(prefix + c, F.lead(c).over(w))
        return out.filter(F.col(prefix + carry[0]).isNotNull()) if matched_only else out
    if method != "range":
        raise ValueError(method)

    fields = {f.name: f for f in df.schema.fields}
    int_carry = {c for c in carry if isinstance(fields[c].dataType, _INT_TYPES)}
    out_schema = Ty.StructType(
        list(df.schema.fields)
        + [Ty.StructField(prefix + c, Ty.LongType() if c in int_carry else fields[c].dataType, True)
           for c in carry]
        + [Ty.StructField("_kind", Ty.StringType(), False),
           Ty.StructField("_pid", Ty.IntegerType(), False)])
    mapped = sorted_partitions_map(df, keys + order, _successor_fn(keys, carry, prefix, int_carry, matched_only),
                                   out_schema, num_partitions)

    heads = mapped.filter(F.col("_kind") == "head").select(
        F.col("_pid").alias("_hpid"), *[F.col(k).alias("_hk_" + k) for k in keys],
        *[F.col(c).alias("_hc_" + c) for c in carry])
    heads = heads.withColumn("_prev", F.lag("_hpid").over(Window.orderBy("_hpid")))
    tails = mapped.filter(F.col("_kind") == "tail").drop(*[prefix + c for c in carry])
    cond = F.col("_pid") == F.col("_prev")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col("_hk_" + k))
    fixed = tails.join(F.broadcast(heads), cond, "inner" if matched_only else "left")
    fixed = fixed.select(*df.columns, *[F.col("_hc_" + c).cast(
        out_schema[prefix + c].dataType).alias(prefix + c) for c in carry])
    rows = mapped.filter(F.col("_kind") == "row").select(*df.columns, *[prefix + c for c in carry])
    return rows.unionByName(fixed)
