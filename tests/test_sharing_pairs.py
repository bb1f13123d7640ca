"""Pairs that share a value come once each, without a table of pairs that is searched for repeats."""

from lacuna.operators import matching
from lacuna.plans import catalogue


def test_pairs_come_once(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (2, "x"), (2, "y"), (3, "y"), (4, "z"), (5, None), (6, None), (None, "x")], "id int, v string")
    assert sorted(tuple(r) for r in matching.sharing_pairs(rows, "id", "v").collect()) == [(1, 2), (1, 3), (2, 3)]


def test_no_aggregate_over_pairs(spark):
    plan = catalogue.QUERIES["key_overlap_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join ")]
