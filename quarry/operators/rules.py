"""Threshold rules as data: a (rule, metric, op, threshold) table users extend with rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from quarry.operators.bitmaps import bitmaps, distinct_ids, distinct_in_any

RULE_SCHEMA = "rule string, metric string, op string, threshold double"
OPS = (">=", ">", "<=", "<", "=")

# The size-rule thresholds recorded with the reference's prevalence queries.
SIZE_RULES = [
    ("ExcessiveMethodLength", "method_lines", ">=", 100.0),
    ("ExcessiveParameterList", "n_params", ">=", 10.0),
    ("ExcessiveClassLength", "class_lines", ">=", 1000.0),
    ("ExcessivePublicCount", "public_members", ">=", 45.0),
    ("TooManyFields", "n_fields", ">", 15.0),
    ("TooManyMethods", "n_methods", ">", 10.0),
]


def rules_frame(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    bad = [r for r in rows if r[2] not in OPS]
    if bad:
        raise ValueError(f"unknown operators in {bad}")
    return spark.createDataFrame(list(rows), RULE_SCHEMA)


def _holds(value: Column, op: Column, threshold: Column) -> Column:
    return (F.when(op == ">=", value >= threshold).when(op == ">", value > threshold)
            .when(op == "<=", value <= threshold).when(op == "<", value < threshold)
            .when(op == "=", value == threshold).otherwise(F.lit(False)))


def apply_rules(metrics_long: DataFrame, rules: DataFrame, metric_col: str = "metric",
                value_col: str = "value") -> DataFrame:
    """One violation row per (metric row, rule) whose threshold test holds.

    ``rules`` is a parameter table (one row per rule), so broadcasting it is
    bounded by construction; the metric rows are never shuffled for this join.
    """
    r = F.broadcast(rules.withColumnRenamed("metric", "_rule_metric"))
    joined = metrics_long.join(r, F.col(metric_col) == F.col("_rule_metric"), "inner")
    return joined.filter(_holds(F.col(value_col).cast("double"), F.col("op"),
                                F.col("threshold"))).drop("_rule_metric")


def rule_prevalence(violations: DataFrame, entity_col: str, rule_col: str = "rule",
                    any_label: str = "*any*", alias: str = "n_entities") -> DataFrame:
    """Distinct entities per rule plus one row for entities violating any rule.

    Integer entities are counted as bitmaps, and "any" is their OR (``operators.bitmaps``); for other types,
    ``rollup`` computes both levels from one scan, ``grouping`` telling the grand total from a real NULL rule.
    """
    if isinstance(violations.schema[entity_col].dataType, IntegralType):
        maps = bitmaps(violations, [rule_col], entity_col)
        every = distinct_in_any(maps, alias).select(F.lit(any_label).alias(rule_col), alias)
        return distinct_ids(maps, [rule_col], alias).unionByName(every)
    agg = violations.rollup(rule_col).agg(
        F.count_distinct(entity_col).alias(alias), F.grouping(rule_col).alias("_g"))
    return agg.select(
        F.when(F.col("_g") == 1, F.lit(any_label)).otherwise(F.col(rule_col)).alias(rule_col),
        alias)
