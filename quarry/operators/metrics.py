"""Source metrics as DataFrame expressions over ``scan_declarations`` rows (MET1-MET23)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.documents import empty_file_predicate

# Framework base classes whose extension is not counted as inheritance.
FRAMEWORK_BASES = ("Actor", "World")

PROJECT_STATS_COLUMNS = (
    "project_id", "method_count", "field_count", "abs_class_count", "abs_method_count",
    "gen_class_count", "gen_method_count", "gen_interface_count", "class_count",
    "interface_count", "class_inheritance_count", "interface_inheritance_count",
    "polymorphism_usage_count")


def _n(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("int")


def _kind(k: str) -> Column:
    return F.col("kind") == k


def _has(mod: str) -> Column:
    return F.array_contains("modifiers", mod)


def per_file_metrics(decls: DataFrame) -> DataFrame:
    """MET1-MET7 per file: methods (all / non-empty), constructors (non-empty), field
    declarations, private fields, parse flag and the emptiness rule.

    Members count only when they are direct members of a file-level type. A
    method counts as non-empty unless it has a body holding nothing but its
    braces (comments and whitespace removed); body-less methods count. ``is_empty`` uses non-empty methods (the rule's
    intent); ``is_empty_all_methods`` counts every method as the reference's
    run did.
    """
    top = F.col("top_level_member")
    # a body-less (abstract / interface) method is a declaration, not an empty body
    nonempty = F.col("body_chars").isNull() | (F.col("body_chars") > 2)
    per = decls.groupBy("project_id", "file").agg(
        F.max(F.col("parse_ok").cast("int")).cast("boolean").alias("parse_ok"),
        _n(_kind("method") & top).alias("method_count_all"),
        _n(_kind("method") & top & nonempty).alias("method_count"),
        _n(_kind("ctor") & top & nonempty).alias("constructor_count"),
        _n(_kind("field") & top).alias("field_count"),
        _n(_kind("field") & top & _has("private")).alias("private_field_count"))
    empty = empty_file_predicate(F.col("field_count"), F.col("method_count"),
                                 F.col("constructor_count"), F.col("private_field_count"))
    empty_all = empty_file_predicate(F.col("field_count"), F.col("method_count_all"),
                                     F.col("constructor_count"), F.col("private_field_count"))
    return per.withColumn("is_empty", F.col("parse_ok") & empty).withColumn(
        "is_empty_all_methods", F.col("parse_ok") & empty_all)


def project_emptiness(per_file: DataFrame) -> DataFrame:
    """MET8: a project is empty when every file is empty (unparsable = not empty)."""
    return per_file.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum(F.col("is_empty").cast("int")).cast("long").alias("n_empty"),
        F.bool_and("is_empty").alias("is_empty_project"))


def corpus_counters(per_file: DataFrame) -> DataFrame:
    """MET9: total files, parsed, empty files, empty projects (one row)."""
    per_project = per_file.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("parse_ok").cast("long")).alias("ok"),
        F.sum(F.col("is_empty").cast("long")).alias("e"))
    return per_project.agg(
        F.sum("n").cast("long").alias("total_files"), F.sum("ok").cast("long").alias("passed_parsing"),
        F.sum("e").cast("long").alias("empty_files"),
        F.sum(F.when(F.col("e") == F.col("n"), 1).otherwise(0)).cast("long").alias("empty_projects"))


def failed_files(per_file: DataFrame) -> DataFrame:
    """SNK4 input: paths of files that did not parse."""
    return per_file.filter(~F.col("parse_ok")).select("file")


def project_stats(decls: DataFrame, bases: Sequence[str] = FRAMEWORK_BASES,
                  files: DataFrame | None = None) -> DataFrame:
    """MET10-MET16 and MET18: the 13-column per-project statistics row.

    ``files`` (project_id, file) restricts the declarations to those files
    (e.g. the non-empty files left after routing). A file that did not parse
    counts nothing; a project with no other files has a row of zeros.
    """
    if files is not None:
        decls = decls.join(files.select("project_id", "file"), ["project_id", "file"], "left_semi")
    decls = decls.withColumn("kind", F.when(F.col("parse_ok"), F.col("kind")))
    base_arr = F.array(*[F.lit(b) for b in bases])
    is_class, is_iface = _kind("class"), _kind("interface")
    own_ext = F.size(F.filter("extends", lambda x: ~F.array_contains(base_arr, x)))
    poly = _kind("localvar") & (F.col("decl_type") != F.col("new_type"))
    return decls.groupBy("project_id").agg(
        _n(_kind("method") & F.col("top_level_member")).alias("method_count"),
        _n(_kind("field") & F.col("top_level_member")).alias("field_count"),
        _n(is_class & _has("abstract")).alias("abs_class_count"),
        _n(_kind("method") & _has("abstract")).alias("abs_method_count"),
        _n(is_class & (F.col("n_type_params") > 0)).alias("gen_class_count"),
        _n(_kind("method") & (F.col("n_type_params") > 0)).alias("gen_method_count"),
        _n(is_iface & (F.col("n_type_params") > 0)).alias("gen_interface_count"),
        _n(is_class).alias("class_count"),
        _n(is_iface).alias("interface_count"),
        F.sum(F.when(is_class, own_ext).otherwise(0)).cast("int").alias("class_inheritance_count"),
        F.sum(F.when(is_iface, F.size("extends") + F.size("implements"))
              .when(is_class, F.size("implements")).otherwise(0)).cast("int")
        .alias("interface_inheritance_count"),
        _n(poly).alias("polymorphism_usage_count"))


def files_per_project(per_file: DataFrame) -> tuple[DataFrame, DataFrame]:
    """MET19 / MET20: (non-empty files per project, all files per project).

    The total is the key-wise merge of the non-empty and empty counts; projects
    whose count is 0 are dropped, as in the statistics table.
    """
    from quarry.operators.relational import merge_counts

    nonempty = per_file.filter(~F.col("is_empty")).groupBy("project_id").agg(
        F.count(F.lit(1)).alias("count"))
    empty = per_file.filter(F.col("is_empty")).groupBy("project_id").agg(
        F.count(F.lit(1)).alias("count"))
    return nonempty, merge_counts(nonempty, empty, "project_id", "count")


def method_complexity(decls: DataFrame) -> DataFrame:
    """MET22 per method and per class: 1 + decision points; class value = rounded
    mean of its methods (our definition; not an external tool's)."""
    m = decls.filter(_kind("method") | _kind("ctor")).filter(F.col("decisions").isNotNull())
    per_method = m.select("project_id", "file", "parent", "name",
                          (F.col("decisions") + 1).alias("complexity"))
    per_class = per_method.groupBy("project_id", "file", "parent").agg(
        F.round(F.avg("complexity")).cast("int").alias("complexity"),
        F.max("complexity").alias("max_method_complexity"))
    return per_method, per_class


def size_metrics_long(decls: DataFrame) -> DataFrame:
    """MET23 inputs as (project_id, file, parent, name, metric, value) rows for ``rules.apply_rules``."""
    members = decls.filter(F.col("parse_ok"))
    meth = members.filter(_kind("method") | _kind("ctor")).select(
        "project_id", "file", "parent", "name",
        F.array(F.struct(F.lit("method_lines").alias("metric"),
                         (F.col("end_line") - F.col("begin_line") + 1).cast("double").alias("value")),
                F.struct(F.lit("n_params").alias("metric"),
                         F.col("n_params").cast("double").alias("value"))).alias("_m"))
    per_type = members.filter(F.col("parent").isNotNull()).groupBy("project_id", "file", "parent").agg(
        _n(_kind("field")).alias("n_fields"), _n(_kind("method")).alias("n_methods"),
        _n((_kind("field") | _kind("method")) & _has("public")).alias("public_members"))
    types = members.filter(_kind("class") | _kind("interface") | _kind("enum")).select(
        "project_id", "file", F.col("name").alias("parent"),
        (F.col("end_line") - F.col("begin_line") + 1).alias("class_lines"))
    tt = types.join(per_type, ["project_id", "file", "parent"], "left").select(
        "project_id", "file", "parent", F.col("parent").alias("name"),
        F.array(*[F.struct(F.lit(c).alias("metric"),
                           F.coalesce(F.col(c), F.lit(0)).cast("double").alias("value"))
                  for c in ("class_lines", "n_fields", "n_methods", "public_members")]).alias("_m"))
    both = meth.unionByName(tt)
    return both.select("project_id", "file", "parent", "name", F.inline("_m"))


def self_call_candidates(decls: DataFrame) -> DataFrame:
    """MET17 (experimental): per project, unscoped calls with >= 1 argument whose name
    and arity equal the enclosing method's - recursion candidates. Calls are not
    resolved, so an overload of the same arity also counts. The reference
    detects these but never reports them."""
    return decls.filter(_kind("selfcall")).groupBy("project_id").agg(
        F.count(F.lit(1)).alias("self_call_candidates"))
