"""Retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions import exprs as X
from turnstone.operators import ordered as O

METRICS = ["recall", "mrr", "ndcg", "all_hit", "facts", "negative_ok"]


def tag_filter(df: DataFrame, wanted: list[str]) -> DataFrame:
    """F08 — rows that share at least one tag."""
    return df.filter(F.arrays_overlap("tags", X.const(wanted)))


def top_results(results: DataFrame, k: int, order: list) -> DataFrame:
    """K08 — first k results per query (the limit is applied on the map side first) with their rank."""
    w = Window.partitionBy("query_id").orderBy(*order)
    return results.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def score_queries(golden: DataFrame, top: DataFrame) -> DataFrame:
    """V01-V03, J12 — one row per query from its top k results.

    At most k result rows per query exist here, so the per-query arrays are bounded by k. Documents keep their first
    rank; a query without results scores 0. nDCG idealises over the retrieved documents.
    """
    docs = (top.filter(F.coalesce(F.col("doc_id").cast("string"), F.lit("")) != "").groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
            .groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("_docs")))
    best = top.groupBy("query_id").agg(
        F.max_by("score", -F.col("rank")).alias("_top_score"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("text", F.lit("")) != "", F.struct("rank", "text")))),
                                 lambda s: s["text"]), "\n").alias("_blob"))
    j = golden.join(docs, "query_id", "left").join(best, "query_id", "left")
    found = F.coalesce(F.transform("_docs", lambda d: d["doc_id"]), F.array().cast("array<string>"))
    expected = F.array_distinct("expected")
    j = j.withColumns({"_found": found, "_expected": expected})
    hits = F.filter("_expected", lambda d: F.array_contains(F.col("_found"), d))
    rel = F.transform("_found", lambda d: F.array_contains(F.col("_expected"), d).cast("double"))
    j = j.withColumns({"_hits": hits, "_rel": rel})

    def dcg(arr: Column) -> Column:
        terms = F.transform(arr, lambda r, i: r / F.log2((i + 2).cast("double")))
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)

    ideal = F.sort_array("_rel", asc=False)
    answerable = F.coalesce("answerable", F.lit(True))
    ranks = F.transform("_hits", lambda d: F.array_position("_found", d))
    n_exp, n_hit = F.size("_expected"), F.size("_hits")
    must = F.coalesce("must_contain", F.array().cast("array<string>"))
    held = F.size(F.filter(must, lambda s: F.contains(F.col("_blob"), s)))
    return j.select(
        "query_id", "tags", "difficulty", answerable.alias("answerable"),
        F.when(answerable & (n_exp > 0), n_hit / n_exp).alias("recall"),
        F.when(answerable, F.when((n_exp > 0) & (n_hit == n_exp), 1.0).otherwise(0.0)).alias("all_hit"),
        F.when(answerable, F.when(n_hit > 0, F.lit(1.0) / F.array_min(ranks)).otherwise(0.0)).alias("mrr"),
        F.when(answerable, F.coalesce(F.try_divide(dcg(F.col("_rel")), dcg(ideal)), F.lit(0.0))).alias("ndcg"),
        F.when(answerable & (F.size(must) > 0) & (F.coalesce("_blob", F.lit("")) != ""), held / F.size(must)).alias("facts"),
        F.when(~answerable, F.coalesce("_top_score", F.lit(0.0))).alias("top_score"))


def _mean4(c: str) -> Column:
    return F.bround(F.avg(c), 4)


def summary(scores: DataFrame, negative_threshold: float = 0.5) -> DataFrame:
    """A20 — means over the answerable queries and the share of unanswerable ones that stay under the threshold."""
    return scores.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("answerable").alias("n_answerable"), F.count_if(~F.col("answerable")).alias("n_negative"),
        *[_mean4(m).alias(m) for m in ("recall", "mrr", "ndcg", "all_hit", "facts")],
        F.bround(F.avg(F.when(~F.col("answerable"), (F.col("top_score") < negative_threshold).cast("double"))), 4).alias("negative_ok"))


def by_tag_and_difficulty(scores: DataFrame) -> DataFrame:
    """A21 — the same means by tag (a query counts under each of its tags) and by difficulty, in one grouping-sets pass."""
    pos = scores.filter("answerable")
    tagged = pos.select("recall", "mrr", "all_hit", F.lit("tag").alias("grouping"), F.explode(F.array_distinct("tags")).alias("value"))
    hard = pos.select("recall", "mrr", "all_hit", F.lit("difficulty").alias("grouping"), F.col("difficulty").alias("value"))
    return tagged.unionByName(hard).groupBy("grouping", "value").agg(
        F.count(F.lit(1)).alias("n"), *[_mean4(m).alias(m) for m in ("recall", "mrr", "all_hit")])


def worst_queries(scores: DataFrame, n: int = 10) -> DataFrame:
    """K09 — the n answerable queries with the lowest recall, then the lowest reciprocal rank."""
    zero = F.lit(0.0)
    return (scores.filter("answerable").select("query_id", "recall", "mrr")
            .orderBy(F.coalesce("recall", zero), F.coalesce("mrr", zero), "query_id").limit(n))


def regressions(now: DataFrame, baseline: DataFrame, metrics: list[str], tolerance: float) -> DataFrame:
    """R11 — metrics that fell below the baseline by more than the tolerance."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(*[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([], metrics, "metric", name)
    j = long(now, "now").join(long(baseline, "baseline"), "metric")
    return j.filter(F.col("now") < F.col("baseline") - tolerance).withColumn("delta", F.bround(F.col("now") - F.col("baseline"), 4))


def context_without_degradation(rows: DataFrame, order: list[str], bucket: Column, tolerance: float = 0.1) -> DataFrame:
    """W16 — largest context up to which the running success rate stays within the tolerance of the overall rate.

    All rows form one sequence, so the scan is cut along the context and never runs in a single task.
    """
    usable = rows.filter("context_tokens IS NOT NULL").withColumn("_all", F.lit(1))
    ok = F.col("success").cast("bigint")
    run = O.ordered_scan(usable, ["_all"], order, {"seen": O.number(), "ok": O.running_sum(ok)}, bucket)
    overall = usable.agg(F.avg(F.col("success").cast("double")).alias("overall"))
    return (run.crossJoin(F.broadcast(overall))                      # one row
            .agg(F.max(F.when(F.col("ok") / F.col("seen") >= F.col("overall") - tolerance, F.col("context_tokens"))).alias("max_context_tokens"),
                 F.max("overall").alias("overall")))
