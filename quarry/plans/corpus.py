"""The reference's analyst queries over an ingested corpus (its query list, group by group).

Inputs are the frames the sources and metrics build from a real corpus:
``project_stats`` (metrics.project_stats), ``violations`` (reports.read_violation_reports,
``report_set`` 'main' and 'min'), clone ``dups``/``occs`` (reports.read_clone_reports).
Rules are selected by **name**: the reference's numeric rule ids depended
on load order. Each function returns a DataFrame; nothing is collected.
These are not registered driver queries because the fixture tables hold no
source corpus. ``tests/test_corpus.py`` runs them on a corpus written to disk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import bitmaps as B
from quarry.operators import clones as C
from quarry.operators import relational as rel
from quarry.operators import rules as R
from quarry.operators import stats
from quarry.sources import reports

# Bucket lists of the reference's IN-list histograms. The method
# list is the query's {1, 8, 16, ..., 816} (1, then steps of 8); the published
# chart used {1, 2, 4, ..., 128}, so the list is a parameter.
METHOD_BUCKETS = [1] + list(range(8, 817, 8))
CLASS_BUCKETS = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 16, 24, 32, 40, 48, 56, 64]
COMPLEXITY_BUCKETS = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096]

# Rule names behind the reference's unused-code and size-rule queries.
UNUSED_CODE_RULES = ["UnusedPrivateField", "UnusedLocalVariable", "UnusedPrivateMethod",
                     "UnusedFormalParameter", "UnusedModifier"]
SIZE_RULE_NAMES = ["ExcessiveMethodLength", "ExcessiveParameterList", "ExcessiveClassLength",
                   "ExcessivePublicCount", "TooManyFields", "TooManyMethods"]
COMPLEXITY_RULE = "CyclomaticComplexity"
GOD_CLASS_RULE = "GodClass"

# The zero-feature prevalence features (one row each; the
# reference's second and last captions reused other predicates).
ZERO_FEATURES = ["abs_class_count", "abs_method_count", "polymorphism_usage_count", "interface_count",
                 "gen_class_count", "gen_method_count", "gen_interface_count",
                 "class_inheritance_count", "interface_inheritance_count"]


def main_set(violations: DataFrame) -> DataFrame:
    return violations.filter(F.col("report_set") == "main")


def method_complexity_values(violations: DataFrame) -> DataFrame:
    """Method-level cyclomatic complexity values of the first report set."""
    return reports.size_values(main_set(violations).filter(
        (F.col("rule") == COMPLEXITY_RULE) & F.col("method").isNotNull()))


def with_classes(project_stats: DataFrame) -> DataFrame:
    return project_stats.filter(F.col("class_count") > 0)


def methods_histogram(project_stats: DataFrame, buckets=METHOD_BUCKETS) -> DataFrame:
    """Projects per method count, on the bucket list (projects with classes)."""
    return stats.histogram(with_classes(project_stats), "method_count", "project_count", buckets)


def classes_histogram(project_stats: DataFrame, buckets=CLASS_BUCKETS) -> DataFrame:
    return stats.histogram(with_classes(project_stats), "class_count", "project_count", buckets)


def feature_histogram(project_stats: DataFrame, column: str) -> DataFrame:
    """Projects per value of one feature (interfaces, abstract classes, class inheritance, ...)."""
    return stats.histogram(with_classes(project_stats), column, "project_count")


def class_complexity(violations: DataFrame) -> DataFrame:
    """Class-level cyclomatic complexity values: rule by name (a scalar lookup in the
    reference), class rows are those without a method, value = first number of the message.
    Only the first report set counts: the second runs the same size rules again."""
    cc = main_set(violations).filter((F.col("rule") == COMPLEXITY_RULE) & F.col("method").isNull())
    return reports.size_values(cc).select("project_id", "file", "class", "value", "max")


def complexity_histogram(violations: DataFrame, buckets=COMPLEXITY_BUCKETS) -> DataFrame:
    """Classes per complexity value on the bucket list (grouped by value: the reference's
    GROUP BY named a column neither table has; its published output is by value)."""
    return stats.histogram(class_complexity(violations).withColumnRenamed("value", "complexity"),
                           "complexity", "file_count", buckets)


def complexity_count(violations: DataFrame, value: int = 2) -> DataFrame:
    """Number of classes with exactly this complexity, and their share of all classes."""
    cc = class_complexity(violations)
    return cc.agg(F.sum(F.when(F.col("value") == value, 1).otherwise(0)).cast("long").alias("n"),
                  F.count(F.lit(1)).alias("total")).withColumn(
        "pct", F.round(F.try_divide(F.lit(100.0) * F.col("n"), F.col("total")), 1))


def clone_histograms(dups: DataFrame, occs: DataFrame) -> dict[str, DataFrame]:
    """The four clone histograms: same-file / across-file, by tokens / by lines."""
    flagged = C.classify_duplications(dups, occs)
    same, across = flagged.filter("same_file"), flagged.filter("across_file")
    return {"same_by_tokens": C.clone_histogram(same, "tokens", "file_count"),
            "same_by_lines": C.clone_histogram(same, "lines", "file_count"),
            "across_by_tokens": C.clone_histogram(across, "tokens", "file_count"),
            "across_by_lines": C.clone_histogram(across, "lines", "file_count")}


def projects_with_clones(dups: DataFrame, occs: DataFrame, n_projects: int | None = None) -> DataFrame:
    """Projects having same-file and across-file clones (with % of ``n_projects``)."""
    flagged = C.classify_duplications(dups, occs)
    same = flagged.filter("same_file").select(F.lit("same_file").alias("kind"), "project_id")
    across = flagged.filter("across_file").select(F.lit("across_file").alias("kind"), "project_id")
    out = B.distinct_ids(B.bitmaps(same.unionByName(across), ["kind"], "project_id"), ["kind"], "project_count")
    if n_projects:
        out = out.withColumn("pct", F.round(F.lit(100.0) * F.col("project_count") / F.lit(n_projects), 2))
    return out


def god_class_projects(violations: DataFrame) -> DataFrame:
    """Distinct projects with a god-class violation in the first report set."""
    found = reports.godclass_values(main_set(violations), GOD_CLASS_RULE)
    return B.distinct_ids(B.bitmaps(found, [], "project_id"), [], "project_count").fillna(0)


def rule_projects(violations: DataFrame, rule_names, report_set: str = "main") -> DataFrame:
    """Distinct projects per named rule and for any of them ('*any*')."""
    v = violations.filter((F.col("report_set") == report_set) & F.col("rule").isin(list(rule_names)))
    return R.rule_prevalence(v, "project_id", alias="project_count")


def unused_code_projects(violations: DataFrame) -> DataFrame:
    return rule_projects(violations, UNUSED_CODE_RULES, "main")


def size_rule_projects(violations: DataFrame) -> DataFrame:
    """Size rules are read from the second report set, run with the default thresholds."""
    return rule_projects(violations, SIZE_RULE_NAMES, "min")


def class_share(project_stats: DataFrame, share: float = 0.2) -> DataFrame:
    """How many of the smallest projects hold ``share`` of all classes."""
    return stats.pareto_share(project_stats, "class_count", share)


def zero_features(project_stats: DataFrame) -> DataFrame:
    """Projects with none of each feature, and their share of all projects."""
    return stats.zero_prevalence(project_stats, ZERO_FEATURES)


def violation_files_dimension(violations: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The (report_set, project_id, file) dimension with first-seen insert-ignore semantics."""
    files = violations.select("report_set", "project_id", "file")
    if existing is None:
        return files.distinct()
    return rel.insert_ignore(existing, files, ["report_set", "project_id", "file"])
