"""Relational store access through Spark's built-in JDBC source (SRC15).

Not exercised in this repository: no database may run here. The library's
own store is Parquet; this is how a table kept in a SQL database is read in
parallel (``numPartitions`` range splits on a numeric column).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, url: str, table_or_query: str, partition_column: str | None = None,
               lower: int | None = None, upper: int | None = None, num_partitions: int = 8,
               properties: dict | None = None) -> DataFrame:
    """Read a table (or ``(SELECT ...) AS t``) with range-partitioned parallel scans."""
    props = dict(properties or {})
    if partition_column is None:
        return spark.read.jdbc(url, table_or_query, properties=props)
    return spark.read.jdbc(url, table_or_query, column=partition_column, lowerBound=lower,
                           upperBound=upper, numPartitions=num_partitions, properties=props)
