import io
import os
import zipfile

from pyspark.sql import functions as F

from quarry.sources import archives as A
from quarry.sources import files as FS
from quarry.sources import reports as R
from quarry.sources import web as W
from quarry.operators import clones as C


def write(path, text, mode="w", enc="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode, **({} if "b" in mode else {"encoding": enc})) as f:
        f.write(text)


def test_project_tree_listing(spark, tmp_dir):
    root = os.path.join(tmp_dir, "corpus")
    write(f"{root}/2/A.java", "class A {}")
    write(f"{root}/2/sub/B.JAVA ", "class B {}")
    write(f"{root}/10/C.java", "class C { String s = \"é\"; }", enc="latin-1")
    write(f"{root}/9/readme.txt", "x")
    write(f"{root}/9/project.meta", "y")
    write(f"{root}/.hidden/D.java", "class D {}")
    write(f"{root}/abc/E.java", "class E {}")
    java = FS.scan_project_files(spark, root)
    got = sorted(((r["project_id"] or -1), r["file"]) for r in java.collect())
    assert got == [(-1, "abc/E.java"), (2, "2/A.java"), (2, "2/sub/B.JAVA "), (10, "10/C.java")]
    idx = [tuple(r) for r in FS.project_index(FS.list_files(spark, root)).collect()]
    assert idx == [("2", 2), ("9", 9), ("10", 10), ("abc", None)]
    named = FS.scan_files_named(spark, root, "PROJECT.meta").collect()
    assert [r["project_id"] for r in named] == [9]
    txt = FS.decode_source(java.filter(F.col("project_id") == 10)).collect()[0]["text"]
    assert "é" in txt
    sizes = {r["project_id"]: r["folder_size"] for r in FS.folder_sizes(java).collect()}
    assert sizes[2] == 20


def test_every_name_below_the_top_is_listed(spark, tmp_dir):
    root = os.path.join(tmp_dir, "names")
    write(f"{root}/1/_x.java", "class X {}")
    write(f"{root}/1/_old/.hid/Deep.java", "class Deep {}")
    write(f"{root}/2/.hid/Y.java", "class Y {}")
    write(f"{root}/.git/Z.java", "class Z {}")
    write(f"{root}/stray.txt", "s")
    os.makedirs(f"{root}/77/empty/inner")
    for place in (root, f"file://{root}"):
        java = FS.scan_project_files(spark, place).collect()
        assert sorted((r["file"], r["project_id"], bytes(r["content"]).decode()) for r in java) == [
            ("1/_old/.hid/Deep.java", 1, "class Deep {}"), ("1/_x.java", 1, "class X {}"), ("2/.hid/Y.java", 2, "class Y {}")]
    assert [tuple(r) for r in FS.project_index(FS.list_projects(spark, root)).collect()] == [
        ("1", 1), ("2", 2), ("77", 77), ("stray.txt", None)]
    os.makedirs(os.path.join(tmp_dir, "nothing"))
    assert FS.list_files(spark, os.path.join(tmp_dir, "nothing")).count() == 0


def test_root_name_inside_a_project_and_rejects(spark, tmp_dir):
    root = os.path.join(tmp_dir, "src")
    inner = root.lstrip("/")  # the root's own path occurs again inside a project
    write(f"{root}/12/{inner}/main/A.java", "class A {}")
    write(f"{root}/bad1/B.java", "class B {}")
    write(f"{root}/bad2/C.java.bak", "class C {}")
    java = FS.scan_project_files(spark, f"file://{root}/")
    ok, rejects = FS.split_rejects(java)
    assert [(r["project_id"], r["file"]) for r in ok.collect()] == [(12, f"12/{inner}/main/A.java")]
    assert [r["file"] for r in rejects.collect()] == ["bad1/B.java"]


def test_archives(spark, tmp_dir):
    root = os.path.join(tmp_dir, "arch")
    os.makedirs(root)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("src\\A.java", "class A {}")
        z.writestr("dir/", "")
        z.writestr("../evil.java", "x")
        z.writestr("/abs.java", "x")
    write(f"{root}/5.gfar", buf.getvalue(), "wb")
    write(f"{root}/6.gfar", buf.getvalue()[:40], "wb")  # truncated
    arcs = FS.list_archives(spark, root)
    rows = A.read_archives(arcs).collect()
    ok = [(r["project_id"], r["entry"]) for r in rows if r["ok"]]
    assert ok == [(5, "src/A.java")]
    bad = sorted((r["project_id"], r["entry"] or "") for r in rows if not r["ok"])
    assert bad == [(5, "../evil.java"), (5, "/abs.java"), (6, "")]
    projects = spark.createDataFrame([(5,), (7,)], "project_id int")
    sz = {r["project_id"]: r["package_size"] for r in FS.archive_sizes(projects, arcs).collect()}
    assert sz[7] == 0 and sz[5] > 0


CLONE_XML = """<?xml version="1.0"?>
<pmd-cpd>
<duplication lines="4" tokens="31">
<file line="3" path="/p/A.java"/>
<file line="19" path="/p/A.java"/>
<file line="7" path="/p/B.java"/>
<codefragment><![CDATA[  int a = 1;
  a++;]]></codefragment>
</duplication>
<duplication lines="2" tokens="20">
<file line="1" path="/p/A.java"/>
<file line="5" path="/p/C.java"/>
<codefragment>x</codefragment>
</duplication>
</pmd-cpd>"""


def test_clone_reports(spark, tmp_dir):
    root = os.path.join(tmp_dir, "cpd")
    write(f"{root}/12.xml", CLONE_XML)
    write(f"{root}/13.xml", "<?xml version=\"1.0\"?><pmd-cpd></pmd-cpd>")
    write(f"{root}/notes.txt", "ignored")
    dups, occs = R.read_clone_reports(spark, root)
    d = sorted((r["project_id"], r["lines"], r["tokens"]) for r in dups.collect())
    assert d == [(12, 2, 20), (12, 4, 31)]
    assert occs.count() == 5
    same = C.same_file_duplications(dups, occs).collect()
    across = C.across_file_duplications(dups, occs).collect()
    assert [r["tokens"] for r in same] == [31] and sorted(r["tokens"] for r in across) == [20, 31]


VIOL_XML = """<?xml version="1.0"?>
<pmd>
<file name="/p/7/A.java">
<violation beginline="3" endline="40" begincolumn="1" endcolumn="2" rule="CyclomaticComplexity" ruleset="Code Size" class="A" method="f" priority="3">
The method 'f' has a Cyclomatic Complexity of 12.
</violation>
<violation beginline="1" endline="90" begincolumn="1" endcolumn="1" rule="CyclomaticComplexity" ruleset="Code Size" class="A" priority="3">
The class 'A' has a Cyclomatic Complexity of 4 (Highest = 12).
</violation>
<violation beginline="1" endline="90" begincolumn="1" endcolumn="1" rule="GodClass" ruleset="Design" priority="3">
Possible God Class (WMC=47, ATFD=10, TCC=0.222)
</violation>
</file>
</pmd>"""


def test_violation_reports(spark, tmp_dir):
    root = os.path.join(tmp_dir, "pmd")
    write(f"{root}/codesize/7.xml", VIOL_XML)
    v = R.read_violation_reports(spark, root).cache()
    assert v.count() == 3
    god = v.filter(F.col("rule") == "GodClass").collect()[0]
    assert god["class"] == "" and god["method"] is None and god["project_id"] == 7
    sizes = sorted(((r["method"] or ""), r["value"], r["max"] or -1) for r in R.size_values(v).collect())
    assert sizes == [("", 4, 12), ("f", 12, -1)]
    g = R.godclass_values(v).collect()[0]
    assert (g["wmc"], g["atfd"]) == (47, 10)
    dims = R.violation_dimensions(v)
    assert dims["rules"].count() == 2


def test_sloc_reports(spark, tmp_dir):
    root = os.path.join(tmp_dir, "sloc")
    write(f"{root}/3.txt", "Have a nice day\nSLOC\tDirectory\tSLOC-by-Language\n291  top  java=291\n")
    write(f"{root}/4.txt", "no marker here\n12 java=12\n")
    write(f"{root}/5.txt", "sloc\nnothing\n")
    write(f"{root}/6.log", "SLOC\n7 java=7\n")  # no .txt: not a report
    got = sorted(tuple(r) for r in R.read_sloc_reports(spark, root).collect())
    assert got == [(3, 291)]
    per = os.path.join(tmp_dir, "perfile")
    write(f"{per}/8/A.txt", "SLOC x\n40 java=40\n")
    got = [(r["project_id"], r["sloc"]) for r in R.read_sloc_reports(spark, per, per_file=True).collect()]
    assert got == [(8, 40)]
    projects = spark.createDataFrame([(8,), (9,)], "project_id int")
    miss = R.projects_without_reports(projects, R.read_sloc_reports(spark, per, per_file=True))
    assert [r["project_id"] for r in miss.collect()] == [9]


def test_issue_json_and_links(spark):
    js = ('{"issues":[{"key":"GF-1","fields":{"issuetype":{"name":"Bug"},"reporter":{"name":"ann"},'
          '"created":"2017-01-10T22:50:23.000+0000"}}]}')
    issues = W.read_issue_json(spark.createDataFrame([(js,)], "value string"))
    r = issues.collect()[0]
    assert (r["key"], r["type"], r["reporter"], r["epoch"]) == ("GF-1", "Bug", "ann", 1484088623)
    assert W.issue_lines(issues).collect()[0]["line"] == "GF-1;Bug;ann;1484088623"
    pages = spark.createDataFrame([(1, "a /scenarios/12 b /scenarios/7"), (2, "/scenarios/12 /scenarios/99")],
                                  "page_id long, html string")
    links = W.extract_links(pages, prefix=F.lit("http://www.example.org"))
    got = sorted((r["first_page"], r["first_pos"], r["link"]) for r in links.collect())
    assert got == [(1, 0, "http://www.example.org/scenarios/12"), (1, 1, "http://www.example.org/scenarios/7"),
                   (2, 1, "http://www.example.org/scenarios/99")]
    seeds = W.page_seeds(spark, "http://x/list", 1, 4).collect()
    assert [r["url"] for r in seeds] == ["http://x/list?page=1", "http://x/list?page=2", "http://x/list?page=3"]


def test_violation_ids_are_stable_and_unique(spark, tmp_dir):
    root = os.path.join(tmp_dir, "pmd2")
    write(f"{root}/codesize/7.xml", VIOL_XML)
    a = sorted(r["violation_id"] for r in R.read_violation_reports(spark, root).collect())
    b = sorted(r["violation_id"] for r in R.read_violation_reports(spark, root).collect())
    assert a == b and len(set(a)) == 3


def test_broken_reports_are_rejects(spark, tmp_dir):
    from quarry.sources import reports as R
    from quarry.sources import web as Wb

    root = os.path.join(tmp_dir, "clones")
    good = '<?xml version="1.0"?><pmd-cpd><duplication lines="2" tokens="30"><file line="1" path="a"/><codefragment>x</codefragment></duplication></pmd-cpd>'
    write(f"{root}/1.xml", good)
    write(f"{root}/2.xml", good[:-20])
    write(f"{root}/3.xml", "<pmd-cpd/>")
    write(f"{root}/sub/4.XML", "")
    write(f"{root}/5.xml", good.replace("</duplication>", ""))
    write(f"{root}/6.txt", "<")
    got = {r["project_id"]: r["reason"] for r in R.malformed_reports(spark, root).collect()}
    assert got == {2: "not well-formed", 4: "no element", 5: "not well-formed"}
    texts = ['{"issues": [{"key": "A-1"}]}', '{"issues": [{"key": "A-', '{"issues": []}', None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, value string")
    assert sorted(r["n"] for r in Wb.malformed_json(rows).collect()) == [1, 3]
    assert [r["key"] for r in Wb.read_issue_json(rows).collect()] == ["A-1"]
