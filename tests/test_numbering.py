"""Consecutive numbers over a whole table."""

from inkwell.functions.numbering import numbered


def test_numbered(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 997 as v", "id").repartition(7)
    rows = sorted(numbered(df, "v", "k").collect(), key=lambda r: r.k)
    assert [r.k for r in rows] == list(range(1, 1001)) and [r.v for r in rows] == sorted(r.v for r in rows)
    assert numbered(df.limit(0), "v", "__k").collect() == []
    assert {r.k: r.v for r in numbered(spark.createDataFrame([(None,), (2,), (1,)], "v long"), "v", "k").collect()} == {1: None, 2: 1, 3: 2}
