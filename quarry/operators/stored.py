"""Tables written once to the shared checkpoint folder and read again.

A step whose result is read several times, or that goes round in a loop, is written as Parquet: later reads don't
recompute it, executors may be lost, and the planner sees its real size. Unlike ``checkpoint()`` the
caller can delete it once nothing reads it any more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quarry.session import ensure_checkpoint_dir


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows of ``df``, written and read again, and their path."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/quarry-stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables that ``stored`` wrote and nothing reads any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
