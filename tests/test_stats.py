import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import stats


def ref_five(xs):
    """Plain-Python statement of the reference's rank rule."""
    x = sorted(xs)
    n = len(x)
    med = (x[n // 2 - 1] + x[n // 2]) / 2 if n % 2 == 0 else x[n // 2]
    q1 = (x[n // 4 - 1] + x[n // 4]) / 2 if n % 4 == 0 else x[n // 4]
    if n % 2 == 1:
        i = n // 4 + math.ceil(n / 2)
        q3 = x[i] if i < n else None
    elif n % 4 == 0:
        q3 = (x[3 * n // 4 - 1] + x[3 * n // 4]) / 2
    else:
        q3 = x[n // 4 + n // 2]
    return n, sum(x) / n, x[0], q1, med, q3, x[-1]


def test_rank_rule_small_n(spark):
    rows, expect = [], {}
    rnd = random.Random(7)
    for n in range(1, 12):
        xs = [rnd.randint(-5, 9) for _ in range(n)]  # ties and negatives
        rows += [(f"k{n}", float(v)) for v in xs]
        expect[f"k{n}"] = ref_five(xs)
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["n"], r["mean"], r["min"], r["q1"], r["median"], r["q3"], r["max"])
           for r in stats.five_number(df, "v", keys=["k"]).collect()}
    assert set(got) == set(expect)
    for k, e in expect.items():
        g = got[k]
        assert g[0] == e[0]
        for a, b in zip(g[1:], e[1:]):
            assert (a is None and b is None) or a == pytest.approx(b)


def test_rank_rule_doubles_and_empty(spark):
    xs = [0.5, 2.25, -1.75, 3.0, 3.0, 10.125, 7.5]
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    r = stats.five_number(df, "v").collect()[0]
    e = ref_five(xs)
    assert (r["n"], r["min"], r["q1"], r["median"], r["q3"], r["max"]) == (e[0], e[2], e[3], e[4], e[5], e[6])
    empty = spark.createDataFrame([], "k string, v double")
    assert stats.five_number(empty, "v", keys=["k"]).count() == 0


def test_n1_q3_is_null(spark):
    df = spark.createDataFrame([(4.0,)], "v double")
    r = stats.five_number(df, "v").collect()[0]
    assert r["q3"] is None and r["median"] == 4.0 and r["q1"] == 4.0


def test_sloc_golden_histogram(spark):
    # Re-typed small histogram; checks the rule on a histogram-shaped input.
    hist = [(8, 1), (10, 3), (12, 2), (15, 4), (20, 1), (31, 2)]
    xs = [v for v, c in hist for _ in range(c)]
    df = spark.createDataFrame([(float(v),) for v in xs], "v double")
    r = stats.five_number(df, "v").collect()[0]
    e = ref_five(xs)
    assert (r["q1"], r["median"], r["q3"]) == (e[3], e[4], e[5])


def test_linear_rule(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4]], "v double")
    r = stats.five_number(df, "v", rule="linear").collect()[0]
    assert r["q1"] == pytest.approx(1.75) and r["median"] == pytest.approx(2.5)


def test_histogram_buckets_not_zero_filled(spark):
    df = spark.createDataFrame([(1,), (1,), (3,), (8,)], "v int")
    got = [tuple(r) for r in stats.histogram(df, "v", "n", buckets=[1, 2, 8]).collect()]
    assert got == [(1, 2), (8, 1)]


def test_zero_prevalence(spark):
    df = spark.createDataFrame([(0, 1), (0, 0), (2, 0), (1, 0)], "a long, b long")
    got = {r["feature"]: (r["zero_count"], r["total"], r["pct"])
           for r in stats.zero_prevalence(df, ["a", "b"]).collect()}
    assert got == {"a": (2, 4, 50.0), "b": (3, 4, 75.0)}


def test_pareto_matches_row_level(spark):
    rnd = random.Random(3)
    vals = [rnd.randint(0, 30) for _ in range(200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, v long")
    r = stats.pareto_share(df, "v", 0.2).collect()[0]
    total = sum(vals)
    run, n, cov = 0, 0, 0
    for v in sorted(vals):
        run += v
        if run <= math.floor(0.2 * total):
            n, cov = n + 1, cov + v
    assert (r["n_entities"], r["covered"], r["total"]) == (n, cov, total)


def test_latex_rows_format(spark):
    rows = [("Size", 1, "A", 2, 0.15, 1.0, 2.0, 2.5, 3.0, 12345.25),
            ("Size", 2, "B", 2, 0.25, 0.0, 0.0, 0.0, 0.0, 2.0),
            ("OOP", 1, "C", 1, 0.35, 1.0, 1.0, 1.0, None, 1.0)]
    df = spark.createDataFrame(rows, "metric_group string, ord int, name string, n long, mean double, "
                                     "min double, q1 double, median double, q3 double, max double")
    got = {(r["metric_group"], r["ord"]): r["line"] for r in stats.latex_rows(df).collect()}
    assert got[("Size", 1)] == " Size & A & 0.1 & 1 & 2 & 2.5 & 3 & 12345.2 \\\\ "
    assert got[("Size", 2)] == "  & B & 0.2 & 0 & 0 & 0 & 0 & 2 \\\\ "
    assert got[("OOP", 1)] == " OOP & C & 0.3 & 1 & 1 & 1 &  & 1 \\\\ "


def test_range_method_equals_window(spark):
    rnd = random.Random(5)
    rows = [("hot", float(rnd.randint(-500, 500)) / 4) for _ in range(3000)]
    rows += [(f"k{i % 7}", float(rnd.randint(0, 30))) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v double")
    a = {r["k"]: tuple(r) for r in stats.five_number(df, "v", keys=["k"], method="range").collect()}
    b = {r["k"]: tuple(r) for r in stats.five_number(df, "v", keys=["k"], method="window").collect()}
    assert a == b
    ga = stats.five_number(df, "v", method="range").collect()[0]
    gb = stats.five_number(df, "v", method="window").collect()[0]
    assert tuple(ga) == tuple(gb)


def test_running_sum_batches_and_partitions(spark):
    from quarry.operators.prefix import running_sum

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [("a" if i < 40 else "b", i, i % 3 + 1) for i in range(100)]
        df = spark.createDataFrame(rows, "k string, o long, c long")
        got = {(r["k"], r["o"]): r["running"] for r in running_sum(df, ["k"], ["o"], "c").collect()}
        want, run, prev = {}, 0, None
        for k, o, c in rows:
            run = c if k != prev else run + c
            want[(k, o)] = run
            prev = k
        assert got == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pareto_and_dense_ids_range_equal_window(spark):
    from quarry.operators import relational as rel

    rnd = random.Random(9)
    df = spark.createDataFrame([(i, rnd.randint(0, 40)) for i in range(500)], "id long, v long")
    a = stats.pareto_share(df, "v", 0.3, method="range").collect()[0]
    b = stats.pareto_share(df, "v", 0.3, method="window").collect()[0]
    assert tuple(a) == tuple(b)
    ev = spark.createDataFrame([(i, f"t{rnd.randint(0, 60)}") for i in range(400)], "eid long, t string")
    x = sorted(map(tuple, rel.first_seen_ids(ev, "t", "eid", method="range").collect()))
    y = sorted(map(tuple, rel.first_seen_ids(ev, "t", "eid").collect()))
    assert x == y


def test_share_text(spark):
    df = spark.createDataFrame([(1988, 5968), (167, 5968), (3666, 5968), (0, 0)], "n long, t long")
    got = [r["s"] for r in df.select(stats.share_text(F.col("n"), F.col("t")).alias("s")).collect()]
    assert got == ["1988 (33.31) of 5968", "167 (2.8) of 5968", "3666 (61.43) of 5968", "0 () of 0"]


def test_running_sum_keeps_null_keys(spark):
    from quarry.operators.prefix import running_sum

    rows = [(k, i, i % 5) for i in range(60) for k in (None, 1, 2)]
    df = spark.createDataFrame(rows, "k long, i long, v long")
    got = {(r.k, r.i): r.running for r in running_sum(df, ["k"], ["i"], "v", method="range").collect()}
    want = {(r.k, r.i): r.running for r in running_sum(df, ["k"], ["i"], "v", method="window").collect()}
    assert got == want and len(got) == 180


def test_bitmap_counts_equal_distinct_counts(spark):
    from quarry.operators import bitmaps as B

    rows = [("a", i % 7) for i in range(50)] + [("b", 10 ** 6 + i) for i in range(9)] + [("a", -3), ("b", -3), ("c", None), (None, 5)]
    df = spark.createDataFrame(rows, "rule string, id long")
    maps = B.bitmaps(df, ["rule"], "id")
    got = {r.rule: r.n for r in B.distinct_ids(maps, ["rule"], "n").collect()}
    assert got == {"a": 8, "b": 10, "c": 0, None: 1}
    assert B.distinct_in_any(maps, "n").first().n == len({i for _, i in rows if i is not None})
    assert B.distinct_in_any(B.bitmaps(df.limit(0), ["rule"], "id"), "n").count() == 0
