"""External tool reports: clone XML, rule-violation XML, line-count text (SRC7-SRC11).

The XML reports are read with Spark's XML source and explicit schemas (no
inference); the project id comes from the report's file name. Surrogate ids
are replaced by natural keys or by hashes of them, which stay stable across
runs and need no counter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.paths import id_from_name
from quarry.functions.text import with_marker_line
from quarry.sources.tree import tree, with_contents

XML_GLOB = "*.[xX][mM][lL]"
TXT_GLOB = "*.[tT][xX][tT]"
# Fixed value: the ruleset whose messages hold size values.
SIZE_RULESET = "Code Size"

CLONE_SCHEMA = ("_lines int, _tokens int, "
                "file array<struct<_line: int, _path: string, _VALUE: string>>, codefragment string")
VIOLATION_SCHEMA = (
    "_name string, violation array<struct<_beginline: int, _endline: int, _begincolumn: int, "
    "_endcolumn: int, _rule: string, _ruleset: string, _class: string, _priority: int, "
    "_variable: string, _method: string, _VALUE: string>>")


def read_clone_reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(duplications, occurrences) of every ``<id>.xml`` clone report under ``path``.

    duplications(dup_id, project_id, lines, tokens, code, report);
    occurrences(dup_id, line, path). A report with an empty root gives no row;
    a report whose name does not start with an integer gets project_id NULL.
    """
    raw = (spark.read.format("xml").option("rowTag", "duplication").option("recursiveFileLookup", "true")
           .option("pathGlobFilter", XML_GLOB).schema(CLONE_SCHEMA).load(path)
           .withColumn("report", F.col("_metadata.file_name")))
    return clones_from_xml_rows(raw)


def clones_from_xml_rows(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(duplications, occurrences) from ``<duplication>`` rows (CLONE_SCHEMA + ``report`` name).

    Shared by the batch reader and the streaming ingest.
    """
    keyed = raw.withColumn("dup_id", F.xxhash64("report", "_lines", "_tokens", "codefragment",
                                                F.to_json("file")))
    dups = keyed.select("dup_id", id_from_name("report").alias("project_id"),
                        F.col("_lines").alias("lines"), F.col("_tokens").alias("tokens"),
                        F.col("codefragment").alias("code"), "report")
    occs = keyed.select("dup_id", F.inline("file")).select(
        "dup_id", F.col("_line").alias("line"), F.col("_path").alias("path"))
    return dups, occs


def read_violation_reports(spark: SparkSession, path: str, report_set: str = "main") -> DataFrame:
    """One row per ``<violation>`` of every ``<ruleset>/<id>.xml`` report under ``path``.

    Absent ``class``/``rule``/``ruleset`` attributes become '' (DOM
    semantics); absent ``variable``/``method`` stay NULL. The message text is
    trimmed (the XML reader trims element text).
    """
    raw = (spark.read.format("xml").option("rowTag", "file").option("recursiveFileLookup", "true")
           .option("pathGlobFilter", XML_GLOB).schema(VIOLATION_SCHEMA).load(path)
           .withColumn("report", F.col("_metadata.file_path")))
    return violations_from_xml_rows(raw, report_set)


def violations_from_xml_rows(raw: DataFrame, report_set: str = "main") -> DataFrame:
    """Flatten ``<file>`` rows (VIOLATION_SCHEMA + ``report`` path) to one row per violation.

    Shared by the batch reader and the streaming ingest.
    """
    v = raw.select(F.col("_name").alias("file"), "report", F.explode("violation").alias("v"))
    name = F.substring_index("report", "/", -1)
    # surrogate id = hash of the violation's natural key (stable across runs, no counter)
    vid = F.xxhash64(F.lit(report_set), "report", "file", "v._beginline", "v._endline", "v._begincolumn",
                     "v._endcolumn", "v._ruleset", "v._rule", "v._class", "v._method", "v._variable", "v._VALUE")
    return v.select(
        vid.alias("violation_id"),
        F.lit(report_set).alias("report_set"), id_from_name(name).alias("project_id"), "file",
        F.col("v._beginline").alias("begin_line"), F.col("v._endline").alias("end_line"),
        F.col("v._begincolumn").alias("begin_column"), F.col("v._endcolumn").alias("end_column"),
        F.coalesce("v._rule", F.lit("")).alias("rule"),
        F.coalesce("v._ruleset", F.lit("")).alias("ruleset"),
        F.coalesce("v._class", F.lit("")).alias("class"),
        F.col("v._priority").alias("priority"), F.col("v._variable").alias("variable"),
        F.col("v._method").alias("method"), F.trim(F.col("v._VALUE")).alias("message"))


def malformed_reports(spark: SparkSession, path: str) -> DataFrame:
    """(report, project_id, reason) of the XML reports under ``path`` (named from there) that aren't well-formed to their end (cut off,
    broken tags, no element at all). The row readers give what they find before the break, or nothing;
    this tells such a file from an empty report. A file is parsed whole, by one task, in PERMISSIVE mode with its text
    routed to the corrupt-record column."""
    found = tree(spark, path).where(~F.col("is_dir") & F.endswith(F.lower("name"), F.lit(".xml")))  # empty files too
    files = with_contents(found, path).select(F.col("content").cast("string").alias("value"), F.col("rel").alias("report"))
    parsed = F.from_xml("value", "_any string, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    broken = files.select("report", "value", parsed.alias("_x")).where(
        (F.trim("value") == "") | F.col("_x").isNull() | F.col("_x._corrupt").isNotNull())
    return broken.select("report", id_from_name(F.substring_index("report", "/", -1)).alias("project_id"),
                         F.when(F.trim("value") == "", "no element").otherwise("not well-formed").alias("reason"))


def violation_dimensions(violations: DataFrame) -> dict[str, DataFrame]:
    """Natural-key dimensions of a violation set: files, rules, rulesets (distinct)."""
    return {"files": violations.select("report_set", "project_id", "file").distinct(),
            "rules": violations.select("rule").distinct(),
            "rulesets": violations.select("ruleset").distinct()}


def read_sloc_reports(spark: SparkSession, path: str, per_file: bool = False,
                      marker: str = "sloc", needle: str = "java=") -> DataFrame:
    """Line counts from line-counter text reports (whole file per row).

    Per report: after the first line whose trimmed lower-cased text starts
    with ``marker``, the first later line containing ``needle``; its first
    token is the count. No such line -> no row.
    ``per_file=False``: ``<id>.txt`` -> (project_id, sloc).
    ``per_file=True``: ``<project>/<name>.txt`` -> (project_id, file, sloc).
    """
    # ``text()`` sets wholetext itself, so it must be passed there, not as an option
    df = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", TXT_GLOB)
          .text(path, wholetext=True)
          .withColumn("report", F.col("_metadata.file_path")))
    return sloc_from_text_rows(df, per_file, marker, needle)


def sloc_from_text_rows(df: DataFrame, per_file: bool = False, marker: str = "sloc",
                        needle: str = "java=") -> DataFrame:
    """Line counts from whole-file text rows (``value`` + ``report`` path); batch and stream."""
    r = with_marker_line(df.select("report", "value"), "value", marker, needle, out="m").filter(
        F.col("m").isNotNull())
    sloc = F.col("m.value").try_cast("int").alias("sloc")
    name = F.substring_index("report", "/", -1)
    if not per_file:
        return r.select(id_from_name(name).alias("project_id"), sloc)
    folder = F.substring_index(F.substring_index("report", "/", -2), "/", 1)
    return r.select(folder.try_cast("int").alias("project_id"), F.col("report").alias("file"), sloc)


def projects_without_reports(projects: DataFrame, reports: DataFrame) -> DataFrame:
    """Project folders that produced no report row (left anti join on project_id)."""
    return projects.join(reports.select("project_id").distinct(), "project_id", "left_anti")


def size_values(violations: DataFrame, ruleset: str = SIZE_RULESET) -> DataFrame:
    """(violation_id, project_id, file, rule, class, method, value, max) from the messages of the
    size ruleset (EXP1)."""
    from quarry.functions.messages import value_and_max

    m = violations.filter(F.col("ruleset") == ruleset).withColumn("_m", value_and_max("message")).filter(F.col("_m").isNotNull())
    return m.select("violation_id", "project_id", "file", "rule", "class", "method",
                    F.col("_m.value").alias("value"), F.col("_m.max").alias("max"))


def godclass_values(violations: DataFrame, rule: str = "GodClass") -> DataFrame:
    """(violation_id, project_id, file, class, wmc, atfd, tcc) of god-class violations (EXP2)."""
    from quarry.functions.messages import godclass_triple

    g = violations.filter(F.col("rule") == rule).withColumn("_t", godclass_triple("message"))
    return g.select("violation_id", "project_id", "file", "class", "_t.wmc", "_t.atfd", "_t.tcc")
