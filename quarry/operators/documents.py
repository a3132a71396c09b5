"""Per-file and per-project corpus operators (emptiness, sizes, counters, index, SLOC).

Inputs are "file" frames keyed by a project column; every operator is one
or two aggregations with map-side combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

# Parameters of the document fixture: a file under this many characters is
# "empty"; a file is "failed" (would not parse) when it holds a replacement
# character or no ASCII letter at all.
DOC_EMPTY_MIN_CHARS = 20
DOC_FAILED_SQL = "(contains(text, chr(65533)) OR NOT regexp_matches(text, '[A-Za-z]'))"


def doc_failed(text: Column) -> Column:
    return F.contains(text, F.lit("�")) | ~F.regexp_like(text, F.lit("[A-Za-z]"))


def flag_empty_docs(docs: DataFrame, min_chars: int = DOC_EMPTY_MIN_CHARS) -> DataFrame:
    """Add ``is_empty`` (size rule) and ``failed`` (parse-failure rule) to document rows."""
    return docs.withColumn("is_empty", F.col("n_chars") < min_chars).withColumn(
        "failed", doc_failed(F.col("text")))


def empty_file_predicate(fields: Column, methods: Column, ctors: Column,
                         private_fields: Column) -> Column:
    """The source-file emptiness rule: no methods, no constructors, and either
    no fields or only private fields."""
    no_code = (methods == 0) & (ctors == 0)
    return (no_code & (fields == 0)) | (no_code & (fields == private_fields))


def empty_projects(files: DataFrame, project_col: str, flag_col: str = "is_empty") -> DataFrame:
    """Per project: files, empty files, and whether every file is empty (MET8)."""
    return files.groupBy(project_col).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.col(flag_col).cast("int")).cast("long").alias("n_empty"),
        F.bool_and(flag_col).alias("all_empty"))


def project_sizes(files: DataFrame, project_col: str, size_col: str,
                  package: DataFrame | None = None, package_col: str = "package_size") -> DataFrame:
    """Size per project before and after dropping empty files, plus a package size.

    ``package`` (project, package_size) is left-joined; projects without one
    get 0. Ordered by size descending (ties by project).
    """
    sizes = files.groupBy(project_col).agg(
        F.sum(size_col).cast("long").alias("folder_size"),
        F.coalesce(F.sum(F.when(~F.col("is_empty"), F.col(size_col))), F.lit(0))
        .cast("long").alias("folder_size_after"))
    if package is None:
        out = sizes.withColumn(package_col, F.lit(0).cast("long"))
    else:
        out = sizes.join(package.select(project_col, package_col), project_col, "left").withColumn(
            package_col, F.coalesce(F.col(package_col), F.lit(0)).cast("long"))
    return out.select(project_col, "folder_size", "folder_size_after", package_col).orderBy(
        F.col("folder_size").desc(), project_col)


def corpus_counters(files: DataFrame, project_col: str) -> DataFrame:
    """One row of corpus counters; per-project partials first, then a tiny final agg."""
    per = files.groupBy(project_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("is_empty").cast("long")).alias("e"),
        F.sum(F.col("failed").cast("long")).alias("f"),
        F.sum(F.col("labelled").cast("long")).alias("l"))
    return per.agg(
        F.sum("n").cast("long").alias("n_files"),
        (F.sum("n") - F.sum("f")).cast("long").alias("n_parsed"),
        F.sum("e").cast("long").alias("n_empty"),
        (F.sum("n") - F.sum("e")).cast("long").alias("n_nonempty"),
        F.sum("f").cast("long").alias("n_failed"),
        F.sum("l").cast("long").alias("n_labelled"),
        F.count(F.lit(1)).alias("n_projects"),
        F.sum(F.when(F.col("e") == F.col("n"), 1).otherwise(0)).cast("long").alias("n_empty_projects"))


def project_index(files: DataFrame, project_col: str, id_pattern: str) -> DataFrame:
    """Distinct project names with their integer id; non-matching names get NULL."""
    names = files.select(project_col).distinct()
    pid = F.regexp_extract(project_col, id_pattern, 1).try_cast("int")
    return names.select(project_col, pid.alias("project_id")).orderBy(
        F.col("project_id").asc_nulls_last(), project_col)


def sloc_per_project(files: DataFrame, project_col: str, text_col: str) -> DataFrame:
    """Files and source lines (non-blank after comment removal) per project."""
    return files.groupBy(project_col).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(T.sloc(text_col)).cast("long").alias("sloc"))
