from __future__ import annotations

from lectern.operators.tables import spread


def test_partitions_grow_with_the_rows(spark):
    rows = spark.range(1000).selectExpr("id % 100 AS a", "id % 7 AS b")
    assert spread(rows, 1000, "a", "b").rdd.getNumPartitions() == 4
    many = spread(rows, 1000, "a", "b", share=100)
    assert many.rdd.getNumPartitions() == 10
    found = many.distinct()
    assert found.count() == rows.distinct().count() == 700
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
