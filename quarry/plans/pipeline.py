"""The whole corpus chain as plain function composition.

files -> decode -> declarations -> per-file metrics -> empty routing ->
project stats -> statistics table, plus the optional report ingest (clone
XML, violation XML in two report sets, line-count text) and the analyst
queries over them. Every value returned is a lazy DataFrame; ``write_all``
persists them as Parquet tables (the store the queries read back).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import javascan as J
from quarry.operators import metrics as M
from quarry.operators import statistics_table as ST
from quarry.plans import corpus as Q
from quarry.sources import files as FS
from quarry.sources import reports as R


def analyse_corpus(spark: SparkSession, corpus_root: str, archives_root: str | None = None,
                   clone_reports: str | None = None, violation_reports: str | None = None,
                   size_reports: str | None = None, sloc_reports: str | None = None,
                   file_sloc_reports: str | None = None) -> dict[str, DataFrame]:
    """All tables of one corpus (missing report folders leave their tables out). Files and report
    rows whose folder or report name gives no project id are in the ``rejected_*`` tables only."""
    scanned, rejected = FS.split_rejects(FS.scan_project_files(spark, corpus_root))
    files = FS.decode_source(scanned)
    decls = J.scan_declarations(files)
    per_file = M.per_file_metrics(decls)
    kept = per_file.filter(~F.col("is_empty")).select("project_id", "file")
    stats_ = M.project_stats(decls, files=kept)
    nonempty, total = M.files_per_project(per_file)
    out: dict[str, DataFrame] = {
        "declarations": decls, "per_file_metrics": per_file, "project_stats": stats_,
        "files_nonempty": nonempty, "files_total": total,
        "corpus_counters": M.corpus_counters(per_file), "failed_files": M.failed_files(per_file),
        "self_call_candidates": M.self_call_candidates(decls),
        "rejected_files": rejected.select("project", "file", "length"),
    }
    listed, _ = FS.split_rejects(FS.list_files(spark, corpus_root, contents=False))
    folders, _ = FS.split_rejects(FS.list_projects(spark, corpus_root))
    projects = FS.project_index(folders).select("project_id")
    # bytes per project before and after its empty files are taken out
    sizes = FS.folder_sizes(scanned.join(per_file.select("project_id", "file", "is_empty"),
                                         ["project_id", "file"], "left")
                            .withColumn("is_empty", F.coalesce("is_empty", F.lit(False))), "is_empty")
    out["folder_sizes"] = sizes
    if archives_root:
        out["project_sizes"] = FS.archive_sizes(projects, FS.list_archives(spark, archives_root))
    broken = [R.malformed_reports(spark, folder) for folder in (clone_reports, violation_reports, size_reports) if folder]
    if broken:
        out["rejected_reports"] = reduce(DataFrame.unionByName, broken)
    if clone_reports:
        dups, occs = R.read_clone_reports(spark, clone_reports)
        dups, out["rejected_duplications"] = FS.split_rejects(dups)
        occs = occs.join(out["rejected_duplications"].select("dup_id"), "dup_id", "left_anti")
        out.update(duplications=dups, duplication_files=occs)
        out.update({f"clones_{k}": v for k, v in Q.clone_histograms(dups, occs).items()})
    violations = None
    if violation_reports:
        violations = R.read_violation_reports(spark, violation_reports, "main")
    if size_reports:
        size = R.read_violation_reports(spark, size_reports, "min")
        violations = size if violations is None else violations.unionByName(size)
    if violations is not None:
        violations, out["rejected_violations"] = FS.split_rejects(violations)
        out.update(violations=violations, violation_size=R.size_values(violations),
                   violation_godclass=R.godclass_values(violations),
                   unused_code_projects=Q.unused_code_projects(violations),
                   size_rule_projects=Q.size_rule_projects(violations),
                   god_class_projects=Q.god_class_projects(violations),
                   complexity_histogram=Q.complexity_histogram(violations))
    if sloc_reports:
        out["project_sloc"] = R.read_sloc_reports(spark, sloc_reports)
    if file_sloc_reports:
        out["project_file_sloc"] = R.read_sloc_reports(spark, file_sloc_reports, per_file=True)
    out.update(classes_histogram=Q.classes_histogram(stats_), methods_histogram=Q.methods_histogram(stats_),
               zero_features=Q.zero_features(stats_), class_share=Q.class_share(stats_))
    needed = ("project_sizes", "project_sloc", "project_file_sloc", "violations")
    if all(k in out for k in needed):
        cc = Q.class_complexity(out["violations"])
        out["statistics_table"] = ST.statistics_table(
            stats_, per_file.select("project_id", "method_count", "field_count"), nonempty, total,
            out["project_sizes"], out["project_sloc"], out["project_file_sloc"].select("sloc"),
            cc.select("value"), Q.method_complexity_values(out["violations"]).select("value"))
    return out


def write_all(tables: dict[str, DataFrame], out_dir: str) -> None:
    """Write every table as Parquet under ``out_dir/<name>``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/{name}")
