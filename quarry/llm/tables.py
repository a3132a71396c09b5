"""Tables written to the shared checkpoint folder, for steps that go round in a loop.

``DataFrame.checkpoint()`` cuts the lineage but keeps the planner's size estimate, and a join's
estimate is the product of its sides': over a dozen rounds it becomes a number with millions of digits,
which stalls the driver. A table read again is estimated by its files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quarry.session import ensure_checkpoint_dir


def kept(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows of ``df``, written as Parquet into the checkpoint folder and read again; and their path."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/quarry-table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that ``kept`` wrote and nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
