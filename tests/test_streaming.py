import os

from quarry.sources.reports import read_violation_reports
from quarry.streaming.ingest import start_violation_ingest
from tests.test_sources import VIOL_XML, write


def test_stream_ingest_matches_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "incoming")
    write(f"{src}/codesize/7.xml", VIOL_XML)
    table = os.path.join(tmp_dir, "violations")
    ckpt = os.path.join(tmp_dir, "ckpt")
    q = start_violation_ingest(spark, src, table, ckpt, available_now=True)
    q.awaitTermination(120)
    assert spark.read.parquet(table).count() == 3
    # a second report arrives; a restarted query picks up only the new file
    write(f"{src}/design/8.xml", VIOL_XML.replace("/p/7/", "/p/8/"))
    q = start_violation_ingest(spark, src, table, ckpt, available_now=True)
    q.awaitTermination(120)
    got = spark.read.parquet(table)
    assert got.count() == 6
    batch = read_violation_reports(spark, src)
    cols = ["project_id", "file", "rule", "message"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))


def test_clone_and_sloc_streams(spark, tmp_dir):
    from quarry.operators import clones as C
    from quarry.streaming.ingest import start_clone_ingest, start_sloc_ingest
    from tests.test_sources import CLONE_XML

    src = os.path.join(tmp_dir, "cpd_in")
    write(f"{src}/12.xml", CLONE_XML)
    dd, od, ck = (os.path.join(tmp_dir, x) for x in ("dups", "occs", "ck"))
    for q in start_clone_ingest(spark, src, dd, od, ck, available_now=True):
        q.awaitTermination(120)
    dups, occs = spark.read.parquet(dd), spark.read.parquet(od)
    assert dups.count() == 2 and occs.count() == 5
    assert [r["tokens"] for r in C.same_file_duplications(dups, occs).collect()] == [31]
    sl = os.path.join(tmp_dir, "sloc_in")
    write(f"{sl}/3.txt", "x\nSLOC\tDir\n291 top java=291\n")
    out = os.path.join(tmp_dir, "sloc_tab")
    q = start_sloc_ingest(spark, sl, out, os.path.join(tmp_dir, "ck2"), available_now=True)
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.read.parquet(out).collect()] == [(3, 291)]
