"""End to end on a tiny corpus written to disk: files -> scanner -> metrics -> reference queries."""

import os

from pyspark.sql import functions as F

from quarry.operators import javascan as J
from quarry.operators import metrics as M
from quarry.operators import statistics_table as ST
from quarry.plans import corpus as Q
from quarry.sources import files as FS
from quarry.sources import reports as R
from tests.test_sources import CLONE_XML, write

PMD_MAIN = """<?xml version="1.0"?><pmd>
<file name="/c/1/A.java">
<violation beginline="1" endline="9" begincolumn="1" endcolumn="1" rule="UnusedPrivateField" ruleset="Unused Code" class="A" variable="x" priority="3">Avoid unused private fields such as 'x'.</violation>
<violation beginline="1" endline="9" begincolumn="1" endcolumn="1" rule="CyclomaticComplexity" ruleset="Code Size" class="A" priority="3">The class 'A' has a Cyclomatic Complexity of 2 (Highest = 3).</violation>
<violation beginline="2" endline="5" begincolumn="1" endcolumn="1" rule="CyclomaticComplexity" ruleset="Code Size" class="A" method="f" priority="3">The method 'f' has a Cyclomatic Complexity of 3.</violation>
<violation beginline="1" endline="9" begincolumn="1" endcolumn="1" rule="GodClass" ruleset="Design" priority="3">Possible God Class (WMC=60, ATFD=8, TCC=0.100)</violation>
</file></pmd>"""
PMD_MAIN_2 = """<?xml version="1.0"?><pmd>
<file name="/c/2/B.java">
<violation beginline="1" endline="4" begincolumn="1" endcolumn="1" rule="UnusedLocalVariable" ruleset="Unused Code" class="B" method="g" variable="y" priority="3">Avoid unused local variables such as 'y'.</violation>
<violation beginline="1" endline="4" begincolumn="1" endcolumn="1" rule="CyclomaticComplexity" ruleset="Code Size" class="B" priority="3">The class 'B' has a Cyclomatic Complexity of 2 (Highest = 2).</violation>
</file></pmd>"""
PMD_MIN = """<?xml version="1.0"?><pmd>
<file name="/c/2/B.java">
<violation beginline="1" endline="4" begincolumn="1" endcolumn="1" rule="TooManyMethods" ruleset="Code Size" class="B" priority="3">This class has too many methods, consider refactoring it.</violation>
</file></pmd>"""


def test_reference_queries_on_disk_corpus(spark, tmp_dir):
    root = os.path.join(tmp_dir, "ExtractedProjectFiles")
    write(f"{root}/1/A.java", "class A extends Actor { private int x; void f() { if (a) b(); } }")
    write(f"{root}/1/I.java", "interface I { void m(); }")
    write(f"{root}/2/B.java", "abstract class B<T> extends Base implements I { abstract void g(); }")
    write(f"{root}/2/Empty.java", "class Empty { }")
    files = FS.decode_source(FS.scan_project_files(spark, root))
    decls = J.scan_declarations(files).cache()
    per_file = M.per_file_metrics(decls)
    keep = per_file.filter(~F.col("is_empty")).select("project_id", "file")
    ps = M.project_stats(decls, files=keep).cache()
    assert {r["project_id"]: r["class_count"] for r in ps.collect()} == {1: 1, 2: 1}

    assert [tuple(r) for r in Q.classes_histogram(ps).collect()] == [(1, 2)]
    assert [tuple(r) for r in Q.feature_histogram(ps, "interface_count").collect()] == [(0, 1), (1, 1)]
    zero = {r["feature"]: r["zero_count"] for r in Q.zero_features(ps).collect()}
    assert zero["abs_class_count"] == 1 and zero["gen_class_count"] == 1 and zero["class_inheritance_count"] == 1
    share = Q.class_share(ps, 0.5).collect()[0]
    assert (share["n_entities"], share["covered"]) == (1, 1)

    pmd = os.path.join(tmp_dir, "pmd")
    write(f"{pmd}/unused/1.xml", PMD_MAIN)
    write(f"{pmd}/unused/2.xml", PMD_MAIN_2)
    write(f"{tmp_dir}/pmdmin/size/2.xml", PMD_MIN)
    v = R.read_violation_reports(spark, pmd, "main").unionByName(
        R.read_violation_reports(spark, f"{tmp_dir}/pmdmin", "min")).cache()
    assert [tuple(r) for r in Q.complexity_histogram(v).collect()] == [(2, 2)]
    assert tuple(Q.complexity_count(v, 2).collect()[0]) == (2, 2, 100.0)
    assert Q.god_class_projects(v).collect()[0]["project_count"] == 1
    unused = {r["rule"]: r["project_count"] for r in Q.unused_code_projects(v).collect()}
    assert unused == {"UnusedPrivateField": 1, "UnusedLocalVariable": 1, "*any*": 2}
    size = {r["rule"]: r["project_count"] for r in Q.size_rule_projects(v).collect()}
    assert size == {"TooManyMethods": 1, "*any*": 1}
    assert Q.violation_files_dimension(v).count() == 3

    cpd = os.path.join(tmp_dir, "cpd")
    write(f"{cpd}/12.xml", CLONE_XML)
    dups, occs = R.read_clone_reports(spark, cpd)
    h = {k: [tuple(r) for r in df.collect()] for k, df in Q.clone_histograms(dups, occs).items()}
    assert h["same_by_tokens"] == [(31, 1)] and h["across_by_lines"] == [(2, 1), (4, 1)]
    pw = {r["kind"]: (r["project_count"], r["pct"]) for r in Q.projects_with_clones(dups, occs, 4).collect()}
    assert pw == {"same_file": (1, 25.0), "across_file": (1, 25.0)}

    nonempty, total = M.files_per_project(per_file)
    per_method, per_class = M.method_complexity(decls)
    table = ST.statistics_table(
        ps, per_file.select("project_id", "method_count", "field_count"), nonempty, total,
        spark.createDataFrame([(1, 3000), (2, 5000)], "project_id int, package_size long"),
        spark.createDataFrame([(1, 9), (2, 4)], "project_id int, sloc int"),
        spark.createDataFrame([(9,), (4,)], "sloc int"),
        Q.class_complexity(v).select("value"), per_method.select(F.col("complexity").alias("value")))
    assert table.count() == 21


def test_pipeline_end_to_end(spark, tmp_dir):
    import io
    import zipfile

    from quarry.plans import pipeline as P

    root = os.path.join(tmp_dir, "corpus")
    write(f"{root}/1/A.java", "class A extends Actor { private int x; void f() { if (a) b(); } }")
    write(f"{root}/2/B.java", "class B { void g() { h(); } }")
    arch = os.path.join(tmp_dir, "archives")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("A.java", "class A {}")
    write(f"{arch}/1.gfar", buf.getvalue(), "wb")
    write(f"{tmp_dir}/pmd/unused/1.xml", PMD_MAIN)
    write(f"{tmp_dir}/pmdmin/size/2.xml", PMD_MIN)
    write(f"{tmp_dir}/cpd/1.xml", CLONE_XML)
    write(f"{tmp_dir}/sloc/1.txt", "SLOC\n12 java=12\n")
    write(f"{tmp_dir}/sloc/2.txt", "SLOC\n5 java=5\n")
    write(f"{tmp_dir}/fsloc/1/A.txt", "SLOC\n7 java=7\n")
    write(f"{root}/2/Empty.java", "class Empty { }")
    write(f"{root}/3/Bad.java", "class {{{")
    write(f"{root}/named/D.java", "class D { void g() { h(); } }")
    t = P.analyse_corpus(spark, root, arch, f"{tmp_dir}/cpd", f"{tmp_dir}/pmd", f"{tmp_dir}/pmdmin",
                         f"{tmp_dir}/sloc", f"{tmp_dir}/fsloc")
    assert t["statistics_table"].count() == 21
    assert [r["project"] for r in t["rejected_files"].collect()] == ["named"]
    assert {r["project_id"]: r["class_count"] for r in t["project_stats"].collect()} == {1: 1, 2: 1, 3: 0}
    folder = {r["project_id"]: (r["folder_size"], r["folder_size_after"]) for r in t["folder_sizes"].collect()}
    assert set(folder) == {1, 2, 3} and folder[2][0] - folder[2][1] == len("class Empty { }")
    sizes = {r["project_id"]: r["package_size"] for r in t["project_sizes"].collect()}
    assert sizes[2] == 0 and sizes[1] > 0
    out = os.path.join(tmp_dir, "store")
    P.write_all({k: t[k] for k in ("project_stats", "violations", "duplications")}, out)
    assert spark.read.parquet(f"{out}/violations").count() == 5
