"""Directory trees as a frontier of folders that is expanded level by level in tasks (SRC1-SRC4).

Spark's own listing leaves out names that begin with '_' or '.', and sees no folder without files. Here a folder is
a row: each round deals the folders of one level out to tasks, which list them, and the folders
found are the next level's rows. No listing passes through the driver; rounds are as many as the tree is deep. Files are
opened through pyarrow's file systems (local and shared folders, object stores, HDFS), whole and one at a time.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from quarry.operators.stored import drop, stored

SCHEMA = "rel string, name string, is_dir boolean, length long"


def _open(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(root))


def _children(root: str):
    """Map function: (rel) of folders -> what they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, top = _open(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = [x for x in system.get_file_info(fs.FileSelector(f"{top}/{folder}" if folder else top))
                         if x.type in (fs.FileType.File, fs.FileType.Directory)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{folder}/{x.base_name}" if folder else x.base_name for x in found], pa.string()),
                     pa.array([x.base_name for x in found], pa.string()),
                     pa.array([x.type == fs.FileType.Directory for x in found], pa.bool_()),
                     pa.array([x.size if x.is_file else None for x in found], pa.int64())], ["rel", "name", "is_dir", "length"])

    return run


def tree(spark: SparkSession, root: str, hidden_top: bool = False) -> DataFrame:
    """Every file and folder below ``root``: (rel, name, is_dir, length), ``rel`` the path from ``root``. Directly under
    ``root``, names that begin with '.' are left out unless ``hidden_top``; below that every name counts."""
    root = root.rstrip("/")
    folders = spark.createDataFrame([("",)], "rel string")
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    levels, paths = None, []
    while True:
        found = folders.mapInArrow(_children(root), SCHEMA)
        if levels is None and not hidden_top:
            found = found.where(~F.startswith("name", F.lit(".")))
        found, path = stored(found)
        paths.append(path)
        levels = found if levels is None else levels.unionByName(found)
        folders = found.where("is_dir").select("rel")
        if folders.isEmpty():
            break
        folders = folders.repartition(wide, "rel")  # a folder of many folders is listed by many tasks
    out, _ = stored(levels)
    drop(spark, *paths)
    return out


def with_contents(files: DataFrame, root: str, rel: str = "rel", out: str = "content") -> DataFrame:
    """The rows of files with their bytes; each file is read whole by the task that holds its row."""
    root = root.rstrip("/")
    names = files.columns
    schema = StructType([*files.schema.fields, StructField(out, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _open(root)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                with system.open_input_stream(f"{top}/{row.column(names.index(rel))[0].as_py()}") as source:
                    data = source.read()
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([data], pa.binary())], [*names, out])

    return files.mapInArrow(run, schema)
