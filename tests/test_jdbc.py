"""Reading over JDBC by balanced ranges, against an embedded database."""

import random

import pytest
from pyspark.sql import functions as F

from inkwell.sources.tables import balanced_ranges, read_jdbc

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def counts(values, low, width, end):
    out = {}
    for v in values:
        if low <= v < end:
            out[(v - low) // width] = out.get((v - low) // width, 0) + 1
    return out


@pytest.mark.parametrize("case", ["dense", "snowflake", "two heaps", "one value", "powers", "negative"])
def test_ranges_are_balanced(case):
    rng = random.Random(1)
    values = {
        "dense": list(range(1000)),
        "snowflake": [(1 << 61) + rng.randrange(1 << 40) for _ in range(1000)],
        "two heaps": list(range(500)) + [(1 << 62) + k for k in range(500)],
        "one value": [7] * 800 + list(range(200)),
        "powers": [1 << k for k in range(62)],
        "negative": [-(10**15) + k * k for k in range(700)],
    }[case]
    asked = []

    def histogram(start, end, width):
        asked.append((start, end))
        return counts(values, start, width, end)

    ranges = balanced_ranges(min(values), max(values), len(values), 8, histogram, 64)
    assert ranges[0][0] == min(values) and ranges[-1][1] == max(values) + 1
    assert all(a[1] == b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    sizes = [sum(a <= v < b for v in values) for a, b in ranges]
    assert sum(sizes) == len(values)
    heaviest = max(values.count(v) for v in set(values)) if case == "one value" else 1
    assert max(sizes) <= max(heaviest, -(-len(values) // 8))
    assert len(ranges) <= 17 and len(asked) <= 8 * 11


@pytest.fixture(scope="module")
def database(spark, tmp_path_factory):
    url = f"jdbc:derby:{tmp_path_factory.mktemp('db')}/site"
    rng = random.Random(2)
    ids = [1_600_000_000_000_000_000 + rng.randrange(1 << 45) for _ in range(600)] + list(range(1, 300))
    rows = [(i, f"tag {k}") for k, i in enumerate(ids)] + [(None, "without an id")] * 3
    spark.createDataFrame(rows, "id long, name string").coalesce(1).write.format("jdbc").options(url=f"{url};create=true", dbtable="tag", driver=DRIVER).save()
    spark.createDataFrame([], "id long, name string").write.format("jdbc").options(url=url, dbtable="empty_tag", driver=DRIVER).save()
    return url, rows


def test_every_row_is_read_once_in_even_parts(spark, database):
    url, rows = database
    df = read_jdbc(spark, url, "tag", '"id"', partitions=6, bins=32, driver=DRIVER)
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(rows, key=repr)
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 6 and max(sizes) <= len(rows) / 6 + 4


def test_tables_without_rows(spark, database):
    assert read_jdbc(spark, database[0], "tag", '"id"', table="empty_tag", driver=DRIVER).collect() == []
