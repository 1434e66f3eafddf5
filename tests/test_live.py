import datetime as dt

from pyspark.sql import functions as F

from siftspark.operators.graph import components
from siftspark.operators.live import current_rows, latest_wins, live_rows, usable_vector


def at(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(seconds=n)


def test_current_rows(spark):
    rows = [(1, at(1), None, "old", 0.0), (1, at(2), None, "new", 0.0), (1, at(2), None, "new", 0.0), (2, at(1), None, "x", 0.0), (2, at(3), True, "y", 0.0), (3, None, False, "z", 0.0), (None, at(1), False, "no", 0.0), (4, at(1), False, "a", 0.0), (4, at(1), True, "b", 0.0)]
    df = spark.createDataFrame(rows, "id bigint, created_at timestamp, deleted boolean, content string, t double")
    assert {(r.id, r.deleted, r.content) for r in current_rows(df, ["content"]).collect()} == {(1, False, "new"), (2, True, "y"), (3, False, "z"), (4, True, "b")}
    assert {r.id for r in live_rows(df, ["content"]).collect()} == {1, 3}
    assert current_rows(df.limit(0), ["content"]).count() == 0


def test_usable_vector(spark):
    nan, inf = float("nan"), float("inf")
    rows = [([1.0, 0.0],), ([0.0, 0.0],), ([1.0],), ([nan, 1.0],), ([inf, 1.0],), (None,), ([None, 1.0],)]
    df = spark.createDataFrame(rows, "v array<float>").select(usable_vector(F.col("v"), 2).alias("ok"))
    assert [r.ok for r in df.collect()] == [True] + [False] * 6


def test_latest_wins(spark):
    df = spark.createDataFrame([(1, 1, "upsert"), (1, 3, "delete"), (2, 2, "delete"), (2, 5, "upsert")], "id int, seq int, op string")
    assert [(r.id, r.seq) for r in latest_wins(df).collect()] == [(2, 5)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
