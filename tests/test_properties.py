"""Property checks: the rank rule and the pareto cut against plain Python on random samples."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quarry.operators import stats
from tests.test_stats import ref_five

samples = st.lists(st.integers(min_value=-20, max_value=20), min_size=1, max_size=40)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(xs=samples)
def test_five_number_matches_reference_rule(spark, xs):
    df = spark.createDataFrame([(float(x),) for x in xs], "v double")
    r = stats.five_number(df, "v").collect()[0]
    e = ref_five(xs)
    assert r["n"] == e[0] and math.isclose(r["mean"], e[1], abs_tol=1e-9)
    assert (r["min"], r["q1"], r["median"], r["q3"], r["max"]) == tuple(
        None if x is None else float(x) for x in e[2:])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(xs=st.lists(st.integers(min_value=0, max_value=50), min_size=1, max_size=60),
       share=st.sampled_from([0.1, 0.2, 0.5]))
def test_pareto_matches_row_level(spark, xs, share):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id long, v long")
    r = stats.pareto_share(df, "v", share).collect()[0]
    total, run, n, cov = sum(xs), 0, 0, 0
    for v in sorted(xs):
        run += v
        if run <= math.floor(share * total):
            n, cov = n + 1, cov + v
    assert (r["n_entities"], r["covered"]) == (n, cov)


words = st.sampled_from(["a", "b", "c", "Ab", "x1"])
doc_text = st.lists(st.lists(words, min_size=0, max_size=6).map(" ".join), min_size=1, max_size=4).map("\n".join)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(doc_text, min_size=1, max_size=5))
def test_clones_match_brute_force(spark, texts):
    from quarry.operators import clones as C
    from tests.test_clones import _brute_fragments, _brute_kgrams, _found_fragments

    k = 3
    docs = [("p" if i % 2 else "q", i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "project string, doc long, text string")
    got = {(r["project"], r["kgram"]): (r["n_occ"], r["n_docs"])
           for r in C.token_clones(df, "project", "doc", "text", k=k).collect()}
    brute = _brute_kgrams(docs, k)
    assert got == {key: (len(v), len({d for d, _ in v})) for key, v in brute.items()}
    assert _found_fragments(spark, docs, k)[0] == _brute_fragments(docs, k)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 2), st.integers(0, 50),
                               st.integers(1, 9)), min_size=1, max_size=80, unique_by=lambda r: r[:3]),
       parts=st.integers(1, 6))
def test_range_operators_equal_windows(spark, rows, parts):
    from quarry.operators.prefix import running_sum
    from quarry.operators.successor import next_in_order

    df = spark.createDataFrame(rows, "k1 string, k2 int, o long, v long")
    a = next_in_order(df, ["k1", "k2"], ["o"], ["o", "v"], num_partitions=parts)
    b = next_in_order(df, ["k1", "k2"], ["o"], ["o", "v"], method="window")
    cols = ["k1", "k2", "o", "next_o", "next_v"]
    assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))
    c = running_sum(df, ["k1", "k2"], ["o"], "v")
    d = running_sum(df, ["k1", "k2"], ["o"], "v", method="window")
    cols = ["k1", "k2", "o", "running"]
    assert sorted(map(tuple, c.select(cols).collect())) == sorted(map(tuple, d.select(cols).collect()))
