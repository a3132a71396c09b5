"""The corpus statistics table (AG10): 21 five-number rows in three groups, one job.

Every row's sample is a column of one of the corpus frames, filtered as the
reference's queries filter it. All samples are stacked into one long
(metric_group, ord, name, value) frame and summarised by ``stats.summary``:
one histogram shuffle, one window over distinct values, one aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import stats

# Group labels and row captions of the reference's statistics table, in order.
SIZE_GROUP = "Size"
COMPLEXITY_GROUP = "Complexity"
OOP_GROUP = "OOP Concepts"
SIZE_ROWS = [
    "Number of classes per Scenario",
    "Number of methods per Scenario with methods",
    "Number of methods per Java per Scenario with methods",
    "Number of fields per Scenario",
    "Number of fields per Java file per Scenario",
    "Number of non-empty Java files per Scenario",
    "Number of Java class files per Scenario",
    "Package size per Scenario (in KB)",
    "SLOC count per scenario",
    "SLOC count per Java file per scenario",
]
COMPLEXITY_ROWS = [
    "Cyclomatic Complexity (CC) per class",
    "Cyclomatic Complexity (CC) per method per class",
]
OOP_ROWS = [
    ("Number of Interfaces per Scenario", "interface_count"),
    ("Number of Abstract Classes per Scenario", "abs_class_count"),
    ("Number of Abstract Methods per Scenario", "abs_method_count"),
    ("Number of Generic Classes per Scenario", "gen_class_count"),
    ("Number of Generic Methods per Scenario", "gen_method_count"),
    ("Number of Generic Interfaces per Scenario", "gen_interface_count"),
    ("Total Class Inheritance per Scenario", "class_inheritance_count"),
    ("Total Interface Inheritance per Scenario", "interface_inheritance_count"),
    ("Total Polymorphism usages per Scenario", "polymorphism_usage_count"),
]


def _sample(df: DataFrame, group: str, ord_: int, name: str, value) -> DataFrame:
    return df.select(F.lit(group).alias("metric_group"), F.lit(ord_).alias("ord"),
                     F.lit(name).alias("name"), value.cast("double").alias("value"))


def statistics_long(project_stats: DataFrame, per_file: DataFrame, nonempty_files: DataFrame,
                    total_files: DataFrame, project_sizes: DataFrame, project_sloc: DataFrame,
                    file_sloc: DataFrame, class_complexity: DataFrame,
                    method_complexity: DataFrame) -> DataFrame:
    """Stack every row's sample into one (metric_group, ord, name, value) frame.

    Inputs: ``project_stats`` (MET18 columns), ``per_file`` (project_id,
    method_count, field_count), ``nonempty_files``/``total_files`` (project_id,
    count), ``project_sizes`` (project_id, package_size bytes),
    ``project_sloc`` (project_id, sloc), ``file_sloc`` (sloc),
    ``class_complexity``/``method_complexity`` (value).
    """
    with_classes = project_stats.filter(F.col("class_count") > 0)
    files_of_classy = per_file.join(with_classes.select("project_id"), "project_id", "left_semi")
    size = [
        (with_classes, F.col("class_count")),
        (with_classes.filter(F.col("method_count") > 0), F.col("method_count")),
        (files_of_classy.filter(F.col("method_count") > 0), F.col("method_count")),
        (with_classes, F.col("field_count")),
        (files_of_classy, F.col("field_count")),
        (nonempty_files.filter(F.col("count") > 0), F.col("count")),
        (total_files.filter(F.col("count") > 0), F.col("count")),
        (project_sizes, F.expr("package_size div 1024")),
        (project_sloc, F.col("sloc")),
        (file_sloc, F.col("sloc")),
    ]
    parts = [_sample(df, SIZE_GROUP, i + 1, SIZE_ROWS[i], v) for i, (df, v) in enumerate(size)]
    parts += [_sample(class_complexity, COMPLEXITY_GROUP, 1, COMPLEXITY_ROWS[0], F.col("value")),
              _sample(method_complexity, COMPLEXITY_GROUP, 2, COMPLEXITY_ROWS[1], F.col("value"))]
    parts += [_sample(project_stats, OOP_GROUP, i + 1, name, F.col(c)) for i, (name, c) in enumerate(OOP_ROWS)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def statistics_table(*frames: DataFrame, rule: str = "reference") -> DataFrame:
    """The 21-row summary (metric_group, ord, name, n, mean, min, q1, median, q3, max)."""
    return stats.summary(statistics_long(*frames), rule=rule)
