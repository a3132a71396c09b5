"""Loads into a stored dimension: ids that stay, repeated and unknown keys, and a plan that leaves the stored side in place."""

from quarry.operators.dimension import StoredDimension


def test_ids_stay_over_loads(spark):
    dim = StoredDimension(spark, ["a", "b"], "at", buckets=3)
    schema = "a string, b long, at long, other string"
    dim.load(spark.createDataFrame([("x", 1, 5, "o"), ("x", 1, 3, "o"), ("y", 1, 4, "o"), (None, 1, 1, "o")], schema))
    first = {(r.a, r.b): (r["at"], r.id) for r in dim.rows().collect()}
    assert first == {("x", 1): (3, 1), ("y", 1): (4, 2)}
    dim.load(spark.createDataFrame([("y", 1, 0, "o"), ("z", 2, 9, "o"), ("w", 2, 9, "o")], schema))
    dim.load(spark.createDataFrame([], schema))
    both = {(r.a, r.b): (r["at"], r.id) for r in dim.rows().collect()}
    assert both == first | {("w", 2): (9, 3), ("z", 2): (9, 4)}
    facts = spark.createDataFrame([("z", 2), ("q", 1), (None, 1)], "a string, b long")
    assert sorted((str(r.a), r.id) for r in dim.lookup(facts).collect() if r.id) == [("z", 4)]
    again = StoredDimension(spark, ["a", "b"], "at", buckets=3, name=dim.name, path=dim.path)
    again.load(spark.createDataFrame([("v", 7, 1, "o")], schema))
    assert again.rows().count() == 5
    assert dim.taken(dim.rows()).count() == 5 and not dim.exists()


def test_the_stored_side_is_not_shuffled(spark):
    dim = StoredDimension(spark, ["a"], "at", buckets=4)
    dim.load(spark.range(500).selectExpr("id as a", "id as at"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = dim.new_rows(spark.range(400, 900).selectExpr("id as a", "id as at"))
        assert fresh.count() == 400
        plan = fresh._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    join = plan[plan.index("SortMergeJoin"):]
    stored_side = join[join.index("FileScan"):] if "FileScan" in join else ""
    assert "SortMergeJoin" in plan and "Bucketed: true" in stored_side
    assert plan.count("Exchange hashpartitioning") <= 1
    dim.taken(dim.rows())
