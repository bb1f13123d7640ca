"""Open offers are written without a shuffle, and repeated pairs of ends count by their first offer."""

from pyspark.sql import functions as F

from lacuna.operators import allocation


def test_offers_are_not_shuffled_as_they_are(spark, monkeypatch):
    plans, write = [], allocation.written

    def told(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(allocation, "written", told)
    offers = spark.createDataFrame([(1, "a", 5), (1, "a", 2), (1, "b", 3), (2, "a", 4), (2, "a", 4), (2, "b", 9), (3, "a", 1), (None, "c", 0), (4, None, 0)], "who int, what string, at int")
    for most in (0, 100):
        got = allocation.allocate(offers, ["who"], ["what"], [F.col("who"), F.col("at")], most).collect()
        assert sorted(tuple(r) for r in got) == [(1, "a", 2), (2, "b", 9)]
    assert "Exchange" not in plans[0]
