from pyspark.sql import functions as F

from quarry.functions import messages as M
from quarry.functions import paths as P
from quarry.functions import text as T
from quarry.operators import rules as R
from quarry.operators import relational as rel


def one(spark, col, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).collect()[0]["r"]


def test_message_numbers(spark):
    r = one(spark, M.value_and_max(F.col("s")), "The method 'f2x' has an NCSS line count of 120 max 99 and 7")
    assert (r["value"], r["max"], r["n_numbers"]) == (120, 99, 3)
    assert one(spark, M.value_and_max(F.col("s")), "no numbers here x1") is None
    r = one(spark, M.value_and_max(F.col("s")), "\t12345678901234567 big")
    assert r["value"] == 12345678901234567 and r["max"] is None


def test_godclass_triple(spark):
    r = one(spark, M.godclass_triple(F.col("s")), "Possible God Class (WMC=47, ATFD=10, TCC=0.222)")
    assert (r["wmc"], r["atfd"]) == (47, 10) and abs(r["tcc"] - 0.222) < 1e-9
    r = one(spark, M.godclass_triple(F.col("s")), "no triple")
    assert (r["wmc"], r["atfd"], r["tcc"]) == (None, None, None)


def test_key_values(spark):
    r = one(spark, M.key_value_pairs(F.col("s")), "http://h/x?page=2&ref=&q#top")
    assert [(x["key"], x["value"]) for x in r] == [("page", "2"), ("ref", None), ("q", None)]


def test_paths(spark):
    df = spark.createDataFrame([("12.xml",), ("abc",), ("/a/b(1)/C.java",)], "s string")
    got = df.select(P.id_from_name("s").alias("i"), P.suffix("s").alias("x"), P.sanitize("s").alias("z"),
                    P.base_name("s").alias("b")).collect()
    assert [tuple(r) for r in got] == [(12, "xml", "12.xml", "12.xml"), (None, "", "abc", "abc"),
                                       (None, "java", "/a/b_1_/C.java", "C.java")]


def test_marker_line_rules(spark):
    rows = [("x\nSLOC\tDirectory\n12 java=1\n 34  java=2",),  # first match after marker
            ("x\ny",),                                       # no marker
            ("java= 5\nsloc\nnothing",),                     # match only before marker
            ("  Sloc total\n\t77 java=9\n",)]
    df = spark.createDataFrame(rows, "s string")
    got = [r["r"] for r in df.select(T.marker_line("s", "sloc", "java=").alias("r")).collect()]
    assert (got[0]["marker"], got[0]["match"], got[0]["value"]) == (1, 2, "12")
    assert got[1] is None and got[2] is None
    assert got[3]["value"] == "77"


def test_sloc_and_complexity(spark):
    src = "/* header\n comment */\nclass A {\n  // x\n  int f(){ if (a && b || c) return x ? 1 : 2; }\n\n}\n"
    assert one(spark, T.sloc(F.col("s")), src) == 3
    assert one(spark, T.cyclomatic(F.col("s")), src) == 5


def test_rules_and_prevalence(spark):
    metrics = spark.createDataFrame([("p1", "n_methods", 12.0), ("p1", "n_fields", 3.0),
                                     ("p2", "n_methods", 10.0), ("p3", "n_fields", 16.0)],
                                    "project string, metric string, value double")
    viol = R.apply_rules(metrics, R.rules_frame(spark, R.SIZE_RULES))
    got = {r["rule"]: r["n"] for r in R.rule_prevalence(viol, "project", alias="n").collect()}
    assert got == {"TooManyMethods": 1, "TooManyFields": 1, "*any*": 2}


def test_insert_ignore_and_merge(spark):
    existing = spark.createDataFrame([("a", 1)], "k string, v long")
    incoming = spark.createDataFrame([("a", 9), ("b", 3), ("b", 2)], "k string, v long")
    got = sorted(tuple(r) for r in rel.insert_ignore(existing, incoming, "k", order_col="v").collect())
    assert got == [("a", 1), ("b", 2)]
    l = spark.createDataFrame([("x", 2), ("y", 1)], "k string, count long")
    r = spark.createDataFrame([("x", 1), ("z", 0)], "k string, count long")
    assert sorted(tuple(x) for x in rel.merge_counts(l, r, "k").collect()) == [("x", 3), ("y", 1)]
