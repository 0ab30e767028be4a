"""A word that most texts hold is joined in several tasks, once per text, and finds the same names."""

import pytest

from turnstone.operators import claims as L


def tables(spark):
    texts = spark.createDataFrame([(i, "the the The vom Haus the " + ("Ghost sees Ghost" if i % 3 == 0 else "the Marine waits") + (" (x)" if i % 5 == 0 else "")) for i in range(40)]
                                  + [(40, None), (41, "")], "text_id int, text string")
    rows = [("The", "The"), ("Marine", "Marine"), ("the marine", "the Marine"), ("Ghost", "Ghost"), ("odd", "(x)")]
    return texts, spark.createDataFrame(rows, "entity string, alias string")


@pytest.mark.parametrize("sample,frequent", [(1, 5), (100, 1_000)])
def test_mentions_agree_whatever_counts_as_frequent(spark, monkeypatch, sample, frequent):
    monkeypatch.setattr(L, "SAMPLE", sample)
    monkeypatch.setattr(L, "FREQUENT", frequent)
    texts, names = tables(spark)
    want = {(i, "The") for i in range(40)} | {(i, "Ghost") for i in range(0, 40, 3)} | {(i, e) for i in range(40) if i % 3 for e in ("Marine", "the marine")} | {(i, "odd") for i in range(0, 40, 5)}
    got = [tuple(r) for r in L.mentions(texts, names).collect()]
    assert len(got) == len(want) and set(got) == want
    found = L.unknown_names(texts, names.filter("entity <> 'Ghost'"), spark.createDataFrame([], "term string")).collect()
    assert sorted((r.text_id, r.candidate) for r in found) == sorted([(i, c) for i in range(40) for c in (["Haus"] + (["Ghost"] * 2 if i % 3 == 0 else []))])


def test_a_frequent_word_is_shared_by_several_parts(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE", 1)
    monkeypatch.setattr(L, "FREQUENT", 50)
    rows = spark.range(2_000).selectExpr("id AS text_id", "CASE WHEN id < 1990 THEN 'the' ELSE concat('w', id) END AS w")
    names = spark.createDataFrame([("the",), ("w1995",)], "k string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = L.spread_join(rows, "w", names, "k")
        assert got.count() == 1991
        most = got.selectExpr("spark_partition_id() AS p").groupBy("p").count().selectExpr("max(count)").first()[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert most < 1990
