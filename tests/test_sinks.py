import glob
import os

from quarry.sinks import writers as W


def read_text(path):
    out = []
    for f in sorted(glob.glob(os.path.join(path, "part-*"))):
        with open(f, encoding="utf-8") as fh:
            out += fh.read().splitlines()
    return out


def test_latex_table(spark, tmp_dir):
    rows = [("Trees", 1, "Leaves", 4, 2.25, 0.0, 1.0, 2.0, 3.5, 6.0),
            ("Trees", 2, "Boughs", 4, 17.5, 4.0, 9.0, 12.0, 30.0, 45.0),
            ("Birds", 1, "Nests", 4, 0.75, 0.0, 0.0, 0.0, 1.0, 3.0)]
    summary = spark.createDataFrame(rows, "metric_group string, ord int, name string, n long, mean double, "
                                          "min double, q1 double, median double, q3 double, max double")
    out = os.path.join(tmp_dir, "latex")
    W.write_latex_table(summary, out, "A wood", "tab:wood", group_order=["Trees", "Birds"])
    lines = read_text(out)
    assert lines[0] == "\\caption{A wood}"
    assert lines[4] == " Trees & Leaves & 2.2 & 0 & 1 & 2 & 3.5 & 6 \\\\ "
    assert lines[5] == "  & Boughs & 17.5 & 4 & 9 & 12 & 30 & 45 \\\\ "
    assert lines[6] == "\\hline"
    assert lines[7] == " Birds & Nests & 0.8 & 0 & 0 & 0 & 1 & 3 \\\\ "
    assert lines[-1] == "\\end{tabularx}"


def test_csv_exports_and_routing(spark, tmp_dir):
    sizes = spark.createDataFrame([(1, 10, 8, 0), (2, 30, 30, 5), (3, 20, 0, 7)],
                                  "project_id int, folder_size long, folder_size_after long, package_size long")
    out = os.path.join(tmp_dir, "sizes")
    W.write_project_sizes(sizes, out)
    back = spark.read.option("header", True).csv(out)
    assert back.columns == W.PROJECT_SIZES_HEADER
    assert sorted(int(r["Project"]) for r in back.collect()) == [1, 2, 3]
    files = spark.createDataFrame([("a", True), ("b", False)], "file string, is_empty boolean")
    routed = os.path.join(tmp_dir, "routed")
    W.route_empty(files, routed)
    assert os.path.isdir(os.path.join(routed, "is_empty=true"))
    failed = os.path.join(tmp_dir, "failed")
    W.write_failed(files.filter("is_empty"), failed)
    assert read_text(failed) == ["a"]


def test_sloc_issue_and_stats_exports(spark, tmp_dir):
    sloc = spark.createDataFrame([(10, 5), (2, 7), (9, 1)], "project_id int, sloc int")
    out = os.path.join(tmp_dir, "sloc")
    W.write_sloc(sloc, out)
    lines = read_text(out)
    body = [l for l in lines if l != "Project,SLOC Count"]
    assert lines[0] == "Project,SLOC Count" and body == ["2,7", "9,1", "10,5"]
    issues = spark.createDataFrame([("GF-1", "Bug", "ann", 1484088623)], "key string, type string, reporter string, epoch long")
    out = os.path.join(tmp_dir, "issues")
    W.write_issues(issues, out)
    got = read_text(out)  # every part file carries the header
    assert set(got) == {"key;type;reporter;date", "GF-1;Bug;ann;1484088623"}
    stats = spark.createDataFrame([(1, 2)], "project_id int, method_count int")
    out = os.path.join(tmp_dir, "stats")
    W.write_project_stats(stats, out)
    assert set(read_text(out)) == {"project_id,method_count", "1,2"}
