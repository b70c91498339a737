"""Interval and lateral joins against all pairs."""

import random

import pytest
from oracle import check, connect
from pyspark.sql import functions as F

from quillstone.operators import ranges
from quillstone.plans import registry


def spans(seed, n, wide):
    r = random.Random(seed)
    out = []
    for k in range(n):
        start = r.randint(-500, 500)
        out.append((k, r.choice("xy"), start, start + r.choice([0, 1, 2, 3, 7, 8, 9, 64, r.randint(1, wide), -2])))
    return [*out, (n, None, 0, 10), (n + 1, "x", None, 5), (n + 2, "x", 5, None)]


@pytest.mark.parametrize("by", [[], ["k"]])
def test_overlaps_are_all_pairs_once(spark, by):
    a, b = spans(1, 120, 3000), spans(2, 150, 40)
    left = spark.createDataFrame(a, "i long, k string, s long, e long")
    right = spark.createDataFrame(b, "j long, k string, s2 long, e2 long")
    right = right if by else right.withColumnRenamed("k", "k2")
    got = sorted(tuple(x) for x in ranges.overlapping(left, right, by, ("s", "e"), ("s2", "e2")).select("i", "j").collect())
    full = lambda rows: [r for r in rows if None not in r[2:] and r[2] < r[3]]
    want = sorted((x[0], y[0]) for x in full(a) for y in full(b) if x[2] < y[3] and y[2] < x[3] and (not by or (x[1] is not None and x[1] == y[1])))
    assert got == want and len(want) > 200


def test_overlaps_of_nothing_and_their_plan(spark):
    rows = spark.createDataFrame(spans(1, 20, 9), "i long, k string, s long, e long")
    other = rows.withColumnsRenamed({"i": "j", "s": "s2", "e": "e2"})
    assert ranges.overlapping(rows.limit(0), other, ["k"], ("s", "e"), ("s2", "e2")).count() == 0
    found = ranges.overlapping(rows, other.drop("k"), [], ("s", "e"), ("s2", "e2"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert found.columns == ["i", "k", "s", "e", "j", "s2", "e2"]


def test_a_span_of_any_length_is_copied_twice_a_level(spark):
    rows = spark.createDataFrame([(1, 0, 1 << 40)] + [(k, k * 1000, k * 1000 + 3) for k in range(2, 50)], "i long, s long, e long")
    other = rows.withColumnsRenamed({"i": "j", "s": "s2", "e": "e2"})
    assert ranges.overlapping(rows, other, [], ("s", "e"), ("s2", "e2")).filter("i = 1").count() == 49


def test_last_of_each(spark):
    keys = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    rows = spark.createDataFrame([(1, t, f"a{t}") for t in range(5)] + [(2, 9, "b")], "k int, t int, v string")
    got = ranges.last_of(keys, rows, "k", [F.col("t").desc()], 2, "left").select("k", "t", "v").collect()
    assert sorted(map(str, map(tuple, got))) == ["(1, 3, 'a3')", "(1, 4, 'a4')", "(2, 9, 'b')", "(3, None, None)"]


@pytest.mark.parametrize("name", ["ship_order_overlaps", "during_errors", "last_orders"])
def test_queries_without_products(spark, name):
    folder = "/root/testdata/sf0.01"
    found = registry.all_queries()[name]
    df = found.run(spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    got, want = check(df, connect(folder), found.sql)
    assert got == want and got


def test_numbers_over_ranges(spark):
    rows = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("a"), "id").repartition(7)
    got = [(x["a"], x["id"], x["number"]) for x in ranges.numbered(rows, [F.col("a").desc(), "id"]).collect()]
    want = sorted(((a, i) for a, i, _ in got), key=lambda x: (-x[0], x[1]))
    assert sorted(got, key=lambda x: x[2]) == [(a, i, k + 1) for k, (a, i) in enumerate(want)]
    assert ranges.numbered(rows.limit(0), ["a"]).count() == 0
