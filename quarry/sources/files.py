"""Project file trees: recursive listing, project ids, decoding, sizes (SRC1-SRC4, SRC6, SRC16, SRC17).

Layout: ``<root>/<project id>/**/<file>``. The tree is listed by ``sources.tree`` (every name, folders without
files too); contents are read by the tasks, only of the files that a scan by suffix or name wants.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.paths import id_from_name
from quarry.functions.text import java_trim
from quarry.sources.tree import tree, with_contents


def _abs(root: str) -> str:
    return root if "://" in root else os.path.abspath(root)


def _located(rows: DataFrame, root: str) -> DataFrame:
    project = F.substring_index("rel", "/", 1)
    return rows.select(project.alias("project"), F.col("rel").alias("file"), "name", F.concat(F.lit(root + "/"), "rel").alias("path"),
                       "is_dir", "length", project.try_cast("int").alias("project_id"))


def list_files(spark: SparkSession, root: str, wanted: Column | None = None, contents: bool = True) -> DataFrame:
    """Regular files under ``root`` with (project, file, name, path, length, project_id) and, if ``contents``, content.

    ``file`` is the path relative to ``root``; ``project`` the first folder (a file directly under ``root``: its own name);
    ``project_id`` its integer value (NULL for a non-numeric folder: a reject, see ``split_rejects``).
    ``wanted`` is a condition on these columns; other files are never opened. Names that begin with '.' are
    left out directly under ``root`` only.
    """
    root = _abs(root).rstrip("/")
    files = _located(tree(spark, root), root).where(~F.col("is_dir")).drop("is_dir")
    files = files if wanted is None else files.where(wanted)
    return with_contents(files, root, "file") if contents else files


def list_projects(spark: SparkSession, root: str) -> DataFrame:
    """(project, project_id) of every folder directly under ``root``, those without files too, and of every stray file
    there (SRC4)."""
    root = _abs(root).rstrip("/")
    return _located(tree(spark, root), root).where(~F.contains("file", F.lit("/"))).select("project", "project_id")


def split_rejects(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a project_id, rejects): files and reports whose folder or name gives no integer
    belong to no project and must not be merged into one."""
    return rows.filter(F.col("project_id").isNotNull()), rows.filter(F.col("project_id").isNull())


def scan_project_files(spark: SparkSession, root: str, suffix: str = ".java") -> DataFrame:
    """Files whose trimmed, lower-cased name ends with ``suffix`` (case-insensitive)."""
    return list_files(spark, root, F.endswith(F.lower(java_trim("name")), F.lit(suffix.lower())))


def scan_files_named(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Files with exactly this name, compared case-insensitively (SRC2)."""
    return list_files(spark, root, F.lower("name") == F.lit(name.lower()))


def project_index(files: DataFrame) -> DataFrame:
    """Distinct project folders ordered by their integer id; non-numeric ids are NULL (SRC4).

    ``files``: a listing of files, or ``list_projects``, which has the folders without files too.
    """
    return (files.select("project", "project_id").distinct()
            .orderBy(F.col("project_id").asc_nulls_last(), "project"))


def decode_source(files: DataFrame, charset: str = "ISO-8859-1") -> DataFrame:
    """Add ``text``: the file bytes decoded with ``charset`` (Latin-1 by default, SRC6)."""
    return files.withColumn("text", F.decode("content", charset))


def folder_sizes(files: DataFrame, flag_col: str | None = None) -> DataFrame:
    """Total bytes per project, and without flagged (empty) files when ``flag_col`` is given (SRC16)."""
    aggs = [F.sum("length").cast("long").alias("folder_size")]
    if flag_col:
        aggs.append(F.coalesce(F.sum(F.when(~F.col(flag_col), F.col("length"))), F.lit(0))
                    .cast("long").alias("folder_size_after"))
    return files.groupBy("project_id").agg(*aggs)


# Suffixes of the project archives (zip format).
ARCHIVE_SUFFIXES = (".gfar", ".zip")


def list_archives(spark: SparkSession, root: str, suffixes=ARCHIVE_SUFFIXES) -> DataFrame:
    """Archives ``<id>.<ext>`` directly or recursively under ``root``: (archive, project_id, length, content)."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(_abs(root))
    name = F.substring_index("path", "/", -1)
    cond = F.lit(False)
    for s in suffixes:
        cond = cond | F.endswith(F.lower(name), F.lit(s))
    return df.filter(cond).select(name.alias("archive"), id_from_name(name).alias("project_id"),
                                  "length", "content")


def archive_sizes(projects: DataFrame, archives: DataFrame) -> DataFrame:
    """Each project with the byte size of its archive, 0 when it has none (SRC17)."""
    sizes = archives.groupBy("project_id").agg(F.sum("length").cast("long").alias("package_size"))
    return projects.join(sizes, "project_id", "left").withColumn(
        "package_size", F.coalesce("package_size", F.lit(0)).cast("long"))
