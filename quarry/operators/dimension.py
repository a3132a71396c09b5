"""A dimension table that stays over loads: bucketed by its key, with ids that never change (SNK9, WN1, JN7).

The table is bucketed and sorted by its key. A load aggregates the incoming rows to one per key and anti-joins them to
the table: only the incoming keys are shuffled, into the table's own buckets, and the stored side is read bucket by
bucket where it lies. New keys get dense ids after the table's highest one, numbered over a range partitioning (counts
per partition become offsets), and are appended; nothing stored is rewritten, and an append that fails leaves
the table as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.prefix import running_sum
from quarry.operators.stored import stored
from quarry.session import ensure_checkpoint_dir


class StoredDimension:
    """Distinct keys with the least ``order`` of the load that brought them and a dense id in that order."""

    def __init__(self, spark: SparkSession, key: Sequence[str], order: str, id_col: str = "id", buckets: int = 8,
                 name: str | None = None, path: str | None = None):
        """``name``: of the table, an existing one to go on with; ``path``: where it lies (default: the checkpoint folder)."""
        self.spark, self.key, self.order, self.id_col, self.buckets = spark, list(key), order, id_col, buckets
        self.name = name or f"quarry_dimension_{uuid.uuid4().hex}"
        self.path = path or f"{ensure_checkpoint_dir(spark)}/{self.name}"

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def new_rows(self, incoming: DataFrame) -> DataFrame:
        """One row per key of ``incoming`` that the table doesn't have: its columns key and order. A row with a null in
        its key has no place in the dimension."""
        some = incoming.dropna(subset=self.key).groupBy(*self.key).agg(F.min(self.order).alias(self.order))
        return some.join(self.rows().select(*self.key), self.key, "left_anti") if self.exists() else some

    def load(self, incoming: DataFrame) -> None:
        """INSERT IGNORE of the incoming rows; ids of earlier loads stay as they are."""
        fresh = self.new_rows(incoming)
        top = self.rows().agg(F.coalesce(F.max(self.id_col), F.lit(0))).first()[0] if self.exists() else 0
        ones = fresh.withColumn("_one", F.lit(1).cast("long"))
        numbered = running_sum(ones, [], [self.order, *self.key], "_one", out=self.id_col).drop("_one")
        numbered = numbered.withColumn(self.id_col, F.col(self.id_col) + F.lit(top)).select(*self.key, self.order, self.id_col)
        (numbered.repartition(self.buckets, *self.key).write.mode("append").format("parquet").option("path", self.path)
         .bucketBy(self.buckets, *self.key).sortBy(*self.key).saveAsTable(self.name))

    def lookup(self, facts: DataFrame) -> DataFrame:
        """The facts with the id of their key (null where it is unknown)."""
        return facts.join(self.rows().drop(self.order), self.key, "left")

    def taken(self, rows: DataFrame) -> DataFrame:
        """``rows`` written to a table of their own, and the dimension's name given back: its files stay."""
        out, _ = stored(rows)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        return out
