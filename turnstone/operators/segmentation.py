"""Segmentation evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.operators import ordered as O


def pk(marks: DataFrame, run: int = 100_000) -> DataFrame:
    """W17 — Pk error per document. ``marks``: doc_id, i (0-based), is_ref, is_hyp, one row per turn.

    Segment numbers come from an ordered scan; a turn meets the one k places later by an equi join on
    ``(doc_id, i)``, so no document is gathered in one place. ``run``: turns of one range of the scan.
    """
    bucket = O.runs("i", run)
    seg = O.ordered_scan(marks, ["doc_id"], ["i"], {"_r": O.running_sum(F.col("is_ref").cast("bigint")),
                                                  "_h": O.running_sum(F.col("is_hyp").cast("bigint"))}, bucket)
    # turns before the first boundary belong to segment 0, like those after it
    seg = seg.select("doc_id", F.col("i").cast("bigint").alias("i"), F.greatest(F.lit(0), F.col("_r") - 1).alias("ref"),
                     F.greatest(F.lit(0), F.col("_h") - 1).alias("hyp"))
    sizes = marks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_ref").alias("refs"))
    k = F.greatest(F.lit(2), F.bround(F.col("n") / F.greatest(F.lit(1), F.col("refs")) / 2, 0).cast("bigint"))
    sizes = sizes.withColumn("k", F.when(k >= F.col("n"), F.col("n") - 1).otherwise(k))
    left = seg.join(sizes.select("doc_id", "k"), "doc_id").select("doc_id", (F.col("i") + F.col("k")).alias("i"), F.col("ref").alias("ref0"), F.col("hyp").alias("hyp0"))
    wrong = (F.col("ref0") == F.col("ref")) != (F.col("hyp0") == F.col("hyp"))
    errors = left.join(seg, ["doc_id", "i"]).groupBy("doc_id").agg(F.avg(wrong.cast("double")).alias("_pk"))
    return sizes.join(errors, "doc_id", "left").select("doc_id", "n", "k", F.when(F.col("n") < 2, 0.0).otherwise(F.coalesce("_pk", F.lit(0.0))).alias("pk"))


def judge_boundaries(marks: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """V04 — verdict per document: boundaries missed and invented, Pk and the first turn at fault with its reason."""
    missed, invented = F.col("is_ref") & ~F.col("is_hyp"), F.col("is_hyp") & ~F.col("is_ref")
    counts = marks.groupBy("doc_id").agg(
        F.count_if(missed).alias("missed"), F.count_if(invented).alias("invented"),
        F.coalesce(F.min(F.when(missed, F.col("i"))), F.min(F.when(invented, F.col("i")))).alias("fault_at"))
    out = counts.join(pk(marks).select("doc_id", "pk"), "doc_id")
    out = out.withColumn("label", F.when((F.col("missed") == 0) & (F.col("invented") == 0), "conforme").otherwise("non_conforme"))
    if reasons is not None:
        out = out.join(reasons.select("doc_id", F.col("i").alias("fault_at"), "reason"), ["doc_id", "fault_at"], "left")
    return out


def judge_reasons(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """V05 — each expected fragment must occur in the decision at the same place, and both lists must be equally long."""
    e = expected.select("doc_id", "i", F.col("fragment"))
    a = actual.select("doc_id", "i", F.col("reason"))
    j = e.join(a, ["doc_id", "i"], "full")
    good = F.coalesce(F.contains(F.col("reason"), F.col("fragment")), F.lit(False))
    g = j.groupBy("doc_id").agg(F.count("fragment").alias("expected"), F.count("reason").alias("found"),
                                F.min(F.when(~good, F.col("i"))).alias("fault_at"))
    return g.withColumn("label", F.when(F.col("fault_at").isNull() & (F.col("expected") == F.col("found")), "conforme").otherwise("non_conforme"))
