"""Exact distinct counts of integer ids as mergeable bitmaps.

Ids are dealt into ranges of 32,768 (Spark's bitmap buckets); a group keeps one bitmap per range, filled before the
shuffle, so a project with a million rows is one bit. Bitmaps of several groups are combined by OR, which a
``count(DISTINCT)`` can only do by expanding its rows. Meant for ids that lie close together (project ids, keys); a
range with a single id costs 4 KB all the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bitmaps(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """(keys, _range, _bits): the ids of each group, a row per range of ids. A null id sets no bit."""
    value = F.col(id_col).cast("long")
    return df.groupBy(*keys, F.bitmap_bucket_number(value).alias("_range")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("_bits"))


def _number() -> Column:
    return F.sum(F.bitmap_count("_bits")).cast("long")


def distinct_ids(maps: DataFrame, keys: Sequence[str], alias: str) -> DataFrame:
    """Distinct ids of each group of ``bitmaps``."""
    return maps.groupBy(*keys).agg(_number().alias(alias))


def distinct_in_any(maps: DataFrame, alias: str) -> DataFrame:
    """Distinct ids over all groups: one row, none if there is no group."""
    return maps.groupBy("_range").agg(F.bitmap_or_agg("_bits").alias("_bits")).agg(_number().alias(alias)).where(F.col(alias).isNotNull())
