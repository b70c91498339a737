"""Streams run to their end against batch SQL, late rows, and sketches that are united."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import check, connect
from pyspark.sql import functions as F

from quillstone.operators import sketches as K
from quillstone.plans import registry
from quillstone.streaming import events as E

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["stream_sessions", "stream_sent_once", "stream_enriched", "sketch_periods"])
def test_queries(spark, name):
    found = registry.all_queries()[name]
    got, want = check(found.run(spark, FOLDER), connect(FOLDER), found.sql)
    assert got == want and got


def event(k, minutes, user=1, value=1.0):
    return (k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes), user, "click", value, "{}")


def arrive(folder, name, rows):
    """One file, which a stream reads as one batch."""
    names = [c.split()[0] for c in E.SCHEMA.split(", ")]
    pq.write_table(pa.table({n: pa.array([r[i] for r in rows], pa.timestamp("us") if n == "ts" else None) for i, n in enumerate(names)}), f"{folder}/events{name}.parquet")


def test_a_late_row_is_dropped_and_a_stream_goes_on(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    arrive(folder, "1", [event(1, 0), event(2, 20), event(3, 600)])
    flow = lambda: E.sessions(E.read_stream(spark, str(folder), files_at_once=1), "1 hour", "10 minutes")
    got = [(r["start"].minute + 60 * r["start"].hour, r["n"]) for r in E.collected(flow(), out).collect()]
    assert got == [(0, 2)]  # the session at 600 minutes is open
    arrive(folder, "2", [event(4, 30), event(5, 610), event(6, 2000)])  # the first of these is too late
    got = sorted((r["start"].minute + 60 * r["start"].hour, r["n"]) for r in E.collected(flow(), out).collect())
    assert got == [(0, 2), (600, 2)]


def test_rows_sent_twice(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for name, rows in (("1", [event(1, 0), event(1, 1), event(2, 5)]), ("2", [event(2, 6), event(3, 7), event(4, 500)]), ("3", [event(4, 505), event(5, 3), event(6, 501)])):
        arrive(folder, name, rows)  # the fifth event is too late
        found = E.collected(E.sent_once(E.read_stream(spark, str(folder)), ["event_id"]), out)
    got = sorted(r["event_id"] for r in found.collect())
    assert got == [1, 2, 3, 4, 6]


def test_enriched_keeps_events_that_nothing_is_known_of(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    arrive(folder, "1", [event(1, 0, 1), event(2, 0, 2)])
    known = spark.createDataFrame([(1, "gold")], "user_id long, tier string")
    got = E.collected(E.enriched(E.read_stream(spark, str(folder)), known, "user_id", ["tier"])).select("event_id", "tier").collect()
    assert sorted((r[0], str(r[1])) for r in got) == [(1, "gold"), (2, "None")]


def test_united_sketches_are_near(spark):
    rows = spark.range(120_000).select((F.col("id") % 30).alias("d"), F.pmod(F.xxhash64("id"), F.lit(40_000)).alias("k"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10_000)) / 100).alias("v"))
    days = K.by_day(rows, F.col("d"), F.col("k"), F.col("v"))
    whole = K.estimates(K.united(days, F.lit("all")), at=(25, 90), quantiles=(0.5,)).first()
    exact = rows.agg(F.count_distinct("k")).first()[0]
    assert whole["n"] == 120_000 and abs(whole["n_keys"] - exact) <= 3 * K.COUNT_ERROR * exact
    assert abs(whole["rank_0"] - 0.25) < 3 * K.RANK_ERROR and abs(whole["rank_1"] - 0.9) < 3 * K.RANK_ERROR and abs(whole["quantile_0"] - 50) < 3
    halves = K.united(days, F.col("day") < 15).orderBy("period").collect()
    both = spark.createDataFrame([(halves[0]["common"], halves[1]["common"])], "a binary, b binary").select(K.shared_keys(F.col("a"), F.col("b"))).first()[0]
    real = rows.groupBy("k").agg(F.count_distinct(F.col("d") < 15).alias("n")).filter("n = 2").count()
    assert abs(both - real) <= 4 * K.COUNT_ERROR * exact
