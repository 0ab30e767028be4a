"""Prefix scans over ranges must equal plain windows, for any width of the ranges and any number of partitions."""

import random

import pytest
from pyspark.sql import functions as F

from turnstone.operators import intervals, ordered as O


def _rows(n=400, seed=7):
    rnd = random.Random(seed)
    # one key holds more than half of all rows; one key is NULL
    return [(rnd.choice(["hot"] * 6 + ["a", "b", None]), i, rnd.randint(0, 60), rnd.choice([None, 1, 2, 3])) for i in range(n)]


def scans():
    return {
        "pos": O.number(), "total": O.running_sum(F.col("v")), "before": O.lag(F.col("v")), "after": O.lead(F.col("v")),
        "after3": O.lead(F.struct("id", "v"), 3), "known": O.last_known(F.col("v")), "top": O.running_max(F.col("v"))}


@pytest.mark.parametrize("width,parts,shuffled", [(1, 1, 8), (5, 8, 3), (5, 3, 11), (1000, 8, 8)])
def test_same_values_for_any_ranges(spark, width, parts, shuffled):
    df = spark.createDataFrame(_rows(), "k string, id int, t int, v int").repartition(parts)
    spark.conf.set("spark.sql.shuffle.partitions", str(shuffled))
    try:
        got = O.ordered_scan(df, ["k"], ["t", "id"], scans(), F.floor(F.col("t") / width)).orderBy("id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = []
    by_key = {}
    for r in sorted(_rows(), key=lambda r: (r[2], r[1])):
        by_key.setdefault(r[0], []).append(r)
    for k, rows in by_key.items():
        total, known, top = None, None, None
        for i, (_, id_, t, v) in enumerate(rows):
            if v is not None:
                total = (total or 0) + v
                known, top = v, v if top is None else max(top, v)
            at = lambda j: rows[j] if 0 <= j < len(rows) else None
            want.append((k, id_, t, v, i + 1, total, at(i - 1) and at(i - 1)[3], at(i + 1) and at(i + 1)[3],
                         at(i + 3) and (at(i + 3)[1], at(i + 3)[3]), known, top))
    want.sort(key=lambda r: r[1])
    assert [tuple(tuple(x) if isinstance(x, tuple) else x for x in r) for r in got] == want


def test_empty_input(spark):
    df = spark.createDataFrame([], "k string, id int, t int, v int")
    assert O.ordered_scan(df, ["k"], ["t", "id"], scans(), F.col("t")).count() == 0


@pytest.mark.parametrize("width", [1, 1000])
def test_as_of_takes_the_latest_at_or_before(spark, width):
    left = spark.sql("SELECT k, id, timestamp_seconds(s) AS at FROM VALUES ('x', 1, 5), ('x', 2, 10), ('x', 3, 99), ('y', 4, 7) AS v(k, id, s)")
    right = spark.sql("SELECT k, timestamp_seconds(s) AS since, n, n AS tie FROM VALUES ('x', 6, 1), ('x', 10, 2), ('x', 10, 3), ('z', 1, 9) AS v(k, s, n)")
    got = {r.id: r.n for r in intervals.as_of(left, right, ["k"], "at", "since", "tie", ["n"], width).collect()}
    assert got == {1: None, 2: 3, 3: 3, 4: None}


@pytest.mark.parametrize("unit", [1, 60, 10_000])
def test_points_in_intervals_matches_brute_force(spark, unit):
    rnd = random.Random(3)
    points = [(rnd.choice("ab"), i, rnd.randint(0, 5000)) for i in range(60)]
    spans = [(rnd.choice("ab"), i, (s := rnd.randint(0, 5000)), s + rnd.randint(-50, 900)) for i in range(40)]
    p = spark.createDataFrame(points, "k string, id int, s int").selectExpr("k", "id", "timestamp_seconds(s) AS at")
    w = spark.createDataFrame(spans, "k string, w int, a int, b int").selectExpr("k", "w", "timestamp_seconds(a) AS a", "timestamp_seconds(b) AS b")
    got = {(r.id, r.w) for r in intervals.points_in_intervals(p, w, ["k"], "at", "a", "b", unit).collect()}
    assert got == {(i, j) for k, i, s in points for k2, j, a, b in spans if k == k2 and a <= s <= b}
    latest = {r.id: (r.found, r.candidates) for r in intervals.latest_interval(p, w, ["k"], ["id"], "at", "a", "b", "w", "w", unit).collect()}
    held = {i: [j for k2, j, a, b in spans if k == k2 and a <= s <= b] for k, i, s in points}
    assert latest == {i: (max(js), len(js)) for i, js in held.items() if js}


def test_cover_is_small_and_exact(spark):
    rnd = random.Random(9)
    rows = [(i, (s := rnd.randint(-(1 << 30), 1 << 30)), s + rnd.choice([0, 1, 59, rnd.randint(0, 1 << 30)])) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, s long, e long").selectExpr("*", "timestamp_seconds(s) AS a", "timestamp_seconds(e) AS b")
    for r in df.withColumn("nodes", intervals.cover("a", "b", 60)).collect():
        whole = sorted((n.node << n.level, (n.node + 1) << n.level) for n in r.nodes if n.level >= 0)
        edges = {n.node for n in r.nodes if n.level < 0}
        units = set(range(r.s // 60, r.e // 60 + 1)) if r.e - r.s < 100_000 else None
        assert all(x[1] == y[0] for x, y in zip(whole, whole[1:])) and len(r.nodes) <= 60 and len(edges) <= 2
        assert all(a * 60 >= r.s and b * 60 <= r.e + 1 for a, b in whole)
        assert units is None or set().union(edges, *[range(a, b) for a, b in whole]) == units
