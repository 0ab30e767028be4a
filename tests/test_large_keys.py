"""Small keys are scanned and compared whole, large ones in ranges and nodes; both ways give the same rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from turnstone.operators import intervals, ordered as O


def final_plan(df):
    """The rows and the plan that adaptive execution ended with."""
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def scanned(spark):
    rnd = random.Random(11)
    rows = [(rnd.choice(["hot"] * 6 + ["a", "b", None]), rnd.choice([1, 2, None]), i, rnd.randint(0, 40), rnd.choice([None, 1, 2, 3])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, j int, id int, t int, v int")
    scans = {"pos": O.number(), "total": O.running_sum(F.col("v")), "before": O.lag(F.col("v")), "after": O.lead(F.col("v")),
             "after3": O.lead(F.col("id"), 3), "known": O.last_known(F.col("v")), "top": O.running_max(F.col("v"))}
    return df, O.ordered_scan(df, ["k", "j"], ["t", "id"], scans, F.floor(F.col("t") / 5))


@pytest.mark.parametrize("whole", [0, 60, 100_000])
def test_scans_agree_whatever_counts_as_large(spark, monkeypatch, whole):
    monkeypatch.setattr(O, "WHOLE", whole)
    df, got = scanned(spark)
    w = Window.partitionBy("k", "j").orderBy("t", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.row_number().over(w).alias("pos"), F.sum("v").over(upto).alias("total"), F.lag("v").over(w).alias("before"), F.lead("v").over(w).alias("after"),
                     F.lead("id", 3).over(w).alias("after3"), F.last("v", True).over(upto).alias("known"), F.max("v").over(upto).alias("top"))
    assert sorted(got.collect(), key=lambda r: r.id) == sorted(want.collect(), key=lambda r: r.id)


def test_small_keys_are_one_plain_window(spark):
    _, got = scanned(spark)
    rows, plan = final_plan(got)
    assert len(rows) == 300 and "isFinalPlan=true" in plan
    assert "SortMergeJoin" not in plan and "_s_total" not in plan                  # neither summaries of ranges nor a join with them


def pairs(spark, few=None):
    rnd = random.Random(5)
    points = [(rnd.choice(["hot"] * 4 + ["a", "b", None]), i, rnd.randint(0, 5000)) for i in range(80)]
    spans = [(rnd.choice(["hot"] * 6 + ["a", "b", None]), i, (s := rnd.randint(0, 5000)), s + rnd.randint(-50, 900)) for i in range(60)]
    p = spark.createDataFrame(points, "k string, id int, s int").selectExpr("k", "id", "timestamp_seconds(s) AS at")
    w = spark.createDataFrame(spans, "k string, w int, a int, b int").selectExpr("k", "w", "timestamp_seconds(a) AS a", "timestamp_seconds(b) AS b")
    want = sorted((i, j) for k, i, s in points for k2, j, a, b in spans if k is not None and k == k2 and a <= s <= b)
    return intervals.points_in_intervals(p, w, ["k"], "at", "a", "b", 60), want


@pytest.mark.parametrize("few", [0, 12, 64])
def test_points_meet_the_same_intervals_directly_and_by_nodes(spark, monkeypatch, few):
    monkeypatch.setattr(intervals, "FEW", few)
    got, want = pairs(spark)
    assert sorted((r.id, r.w) for r in got.collect()) == want


def test_points_of_keys_with_few_intervals_are_not_copied(spark):
    got, want = pairs(spark)
    rows, plan = final_plan(got)
    assert len(rows) == len(want) and "isFinalPlan=true" in plan
    assert "Generate" not in plan                                                  # neither nodes of intervals nor copies of points per level
