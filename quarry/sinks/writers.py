"""Output writers (SNK1-SNK6, SNK10). Parquet is the store; these are the exports.

Each writer is a plain ``DataFrameWriter`` call. Sorted exports use
``orderBy`` (range-partitioned, so part files come out in order) rather
than funnelling rows into one task; only the LaTeX table, whose size is one
row per summary metric, is written as a single file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.stats import latex_rows

# The reference's export headers.
PROJECT_SIZES_HEADER = ["Project", "Folder Size", "Folder Size After File Move", "Package Size"]
SLOC_HEADER = ["Project", "SLOC Count"]
ISSUE_HEADER = ["key", "type", "reporter", "date"]


def write_project_sizes(sizes: DataFrame, path: str) -> None:
    """SNK1: CSV ordered by folder size, descending."""
    out = sizes.orderBy(F.col("folder_size").desc(), "project_id").select(
        *[F.col(c).alias(h) for c, h in zip(
            ["project_id", "folder_size", "folder_size_after", "package_size"], PROJECT_SIZES_HEADER)])
    out.write.mode("overwrite").option("header", True).csv(path)


def write_project_stats(stats: DataFrame, path: str) -> None:
    """SNK2: the 13-column project statistics as CSV with a header."""
    stats.write.mode("overwrite").option("header", True).csv(path)


def write_sloc(sloc: DataFrame, path: str) -> None:
    """SNK3: ``Project,SLOC Count`` ordered by integer project id."""
    sloc.orderBy("project_id").select(F.col("project_id").alias(SLOC_HEADER[0]),
                                      F.col("sloc").alias(SLOC_HEADER[1])) \
        .write.mode("overwrite").option("header", True).csv(path)


def write_failed(failed: DataFrame, path: str, col: str = "file") -> None:
    """SNK4: one path per line, no header."""
    failed.select(F.col(col).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_issues(issues: DataFrame, path: str) -> None:
    """SNK5: ``key;type;reporter;date`` with ';' as separator."""
    issues.select(*[F.col(c).alias(h) for c, h in zip(["key", "type", "reporter", "epoch"], ISSUE_HEADER)]) \
        .write.mode("overwrite").option("header", True).option("sep", ";").csv(path)


def latex_table(summary: DataFrame, caption: str, label: str) -> DataFrame:
    """SNK6 as lines: header, one row per summary line, ``\\hline`` after each group, footer.

    Sort key columns (``_g``, ``_o``) order the lines; the table has one row
    per summary metric, so it is small by construction.
    """
    rows = latex_rows(summary)
    groups = summary.groupBy("metric_group").agg(F.min("ord").alias("_first"))
    order = rows.join(groups, "metric_group").select(
        F.col("_first"), "metric_group", F.col("ord").alias("_o"), "line")
    hlines = groups.select("_first", "metric_group", F.lit(1 << 30).alias("_o"), F.lit("\\hline").alias("line"))
    body = order.unionByName(hlines)
    # The head and foot lines of the LaTeX table.
    head = [f"\\caption{{{caption}}}", f"\\label{{{label}}}\\begin{{tabularx}}{{\\textwidth}}{{llrrrrrr}}",
            " & & \\textbf{mean} & \\textbf{min} & \\textbf{Q1} & \\textbf{median} & \\textbf{Q3} "
            "& \\textbf{max} \\\\ ", "\\hline"]
    spark = summary.sparkSession
    top = spark.createDataFrame([(i, s) for i, s in enumerate(head)], "_k int, line string")
    bottom = spark.createDataFrame([(0, "\\end{tabularx}")], "_k int, line string")
    ordered = (top.select(F.lit(0).alias("_s"), F.lit(0).alias("_first"), F.lit("").alias("metric_group"),
                          F.col("_k").alias("_o"), "line")
               .unionByName(body.select(F.lit(1).alias("_s"), "_first", "metric_group", "_o", "line"))
               .unionByName(bottom.select(F.lit(2).alias("_s"), F.lit(0).alias("_first"),
                                          F.lit("").alias("metric_group"), F.col("_k").alias("_o"), "line")))
    return ordered


def write_latex_table(summary: DataFrame, path: str, caption: str, label: str,
                      group_order: list[str] | None = None) -> None:
    """Write the LaTeX table as one text file (small: one line per metric)."""
    t = latex_table(summary, caption, label)
    if group_order:
        rank = F.array_position(F.array(*[F.lit(g) for g in group_order]), F.col("metric_group"))
        t = t.withColumn("_first", F.when(F.col("_s") == 1, rank).otherwise(F.col("_first")))
    t.orderBy("_s", "_first", "metric_group", "_o").select("line").coalesce(1) \
        .write.mode("overwrite").text(path)


def route_empty(files: DataFrame, path: str, flag_col: str = "is_empty") -> None:
    """SNK10: write files split by emptiness (``<path>/is_empty=true|false``); inputs are not moved."""
    files.write.mode("overwrite").partitionBy(flag_col).parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, batch_size: int = 50,
               properties: dict | None = None) -> None:
    """SNK7/SNK8: append rows to a SQL table in batches (Spark's JDBC sink; one
    connection per partition, not per row). Not exercised here: no database."""
    df.write.option("batchsize", batch_size).jdbc(url, table, mode="append", properties=dict(properties or {}))
