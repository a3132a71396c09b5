"""Relational building blocks the reference's SQL and loaders use.

Joins are written declaratively; Catalyst/AQE choose the strategy at run time
(a side becomes a broadcast only after AQE has measured it under
``spark.sql.adaptive.autoBroadcastJoinThreshold``). Explicit ``broadcast`` is
used only for frames whose size is bounded by construction (parameter tables).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_counts(left: DataFrame, right: DataFrame, key: str | Sequence[str],
                 value: str = "count", drop_zero: bool = True) -> DataFrame:
    """Key-wise sum of two keyed count frames (a key present on either side).

    ``union`` + ``groupBy.sum``: one shuffle with map-side combine, no outer join.
    ``drop_zero`` removes keys whose merged count is 0.
    """
    keys = [key] if isinstance(key, str) else list(key)
    both = left.select(*keys, F.col(value).cast("long").alias(value)).unionByName(
        right.select(*keys, F.col(value).cast("long").alias(value)))
    out = both.groupBy(*keys).agg(F.sum(value).alias(value))
    return out.filter(F.col(value) != 0) if drop_zero else out


def missing_from(left: DataFrame, right: DataFrame, left_key: str,
                 right_key: str | None = None) -> DataFrame:
    """Rows of ``left`` whose key has no match in ``right`` (duplicates on the left kept)."""
    right_key = right_key or left_key
    r = right.select(F.col(right_key).alias("_rk")).distinct()
    return left.join(r, F.col(left_key) == F.col("_rk"), "left_anti")


def first_seen_ids(df: DataFrame, key: str, order_col: str, id_col: str = "id",
                   method: str = "range") -> DataFrame:
    """Dimension of distinct ``key`` values with a dense id in first-seen order.

    The distinct keys are found by a partially aggregated ``groupBy``; the
    dense numbering then runs over the dimension only, never over the fact
    rows, range-partitioned so that no task holds the whole dimension.
    ``method="window"`` numbers it in one task (rule, ruleset, type dimensions).
    """
    first = f"first_{order_col}"
    dim = df.groupBy(key).agg(F.min(order_col).alias(first))
    if method == "window":
        w = Window.orderBy(first, key)
        return dim.withColumn(id_col, F.row_number().over(w).cast("long"))
    from quarry.operators.prefix import running_sum

    ones = dim.withColumn("_one", F.lit(1).cast("long"))
    return running_sum(ones, [], [first, key], "_one", out=id_col, method=method).drop("_one")


def insert_ignore(existing: DataFrame, incoming: DataFrame, key: str | Sequence[str],
                  order_col: str | None = None) -> DataFrame:
    """INSERT IGNORE: append incoming rows whose key is new; the first of equal keys wins.

    ``order_col`` fixes which incoming duplicate is "first"; without it any one
    of them is kept (as ``dropDuplicates`` does).
    """
    keys = [key] if isinstance(key, str) else list(key)
    if order_col is None:
        fresh = incoming.dropDuplicates(keys)
    else:
        cols = [c for c in incoming.columns if c not in keys]
        firsts = incoming.groupBy(*keys).agg(
            F.min_by(F.struct(*cols), F.col(order_col)).alias("_row"))
        fresh = firsts.select(*keys, "_row.*")
    fresh = fresh.join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def lookup_ids(df: DataFrame, dim: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    """Resolve a natural key to a surrogate id (NULL when the key is unknown)."""
    return df.join(dim.select(key, id_col), key, "left")


def distinct_through(fact: DataFrame, fact_key: str, parent: DataFrame, parent_key: str,
                     carry: str) -> DataFrame:
    """Distinct ``carry`` values of parent rows that have at least one fact row.

    Written as a semi-join so only the fact's key column is shuffled, and
    ``carry`` is de-duplicated before any further join.
    """
    keys = fact.select(F.col(fact_key).alias("_fk"))
    return (parent.join(keys, F.col(parent_key) == F.col("_fk"), "left_semi")
            .select(carry).distinct())
