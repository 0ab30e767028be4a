"""Evaluation cases: loading rules, guards, campaign and gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.functions import exprs as X
from turnstone.functions import fixed_values as V
from turnstone.operators import dims


def privacy_guard(cases: DataFrame) -> DataFrame:
    """F10 — a versioned case must be shareable and must not cite a real transcript; refused rows say why."""
    why = (F.when(~F.coalesce("shareable", F.lit(True)), "not shareable")
           .when(F.col("origin") == "transcript", "cites a real transcript"))
    return cases.withColumn("why", why).withColumn("kept", F.col("why").isNull())


# ------------------------------------------------------------------------------------- verdicts
def score_labels(verdicts: DataFrame, scale_table: DataFrame | None = None) -> DataFrame:
    """R09 — label of a closed scale to score 1, 0 or NULL; a label outside the scale becomes undecided."""
    scales = dims.label_scales(verdicts.sparkSession) if scale_table is None else scale_table
    known = scales.select(F.col("scale"), F.lower("label").alias("_label"), F.col("score").alias("_score"),
                                      F.lit(True).alias("_known"))
    v = verdicts.withColumn("_label", F.lower("label")).join(known, ["scale", "_label"], "left")
    return (v.withColumns({"label": F.when(F.col("_known"), F.col("label")).otherwise(V.UNDECIDED), "score": F.col("_score")})
            .drop("_label", "_score", "_known"))


def evaluator_summary(verdicts: DataFrame) -> DataFrame:
    """A19 — passed, failed and undecided per evaluator; the rate counts decided ones only."""
    passed, undecided = F.coalesce(F.col("score") >= 1.0, F.lit(False)), F.col("score").isNull()
    return (verdicts.groupBy("evaluator").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(passed).alias("passed"), F.count_if(~passed & ~undecided).alias("failed"),
        F.count_if(undecided).alias("undecided"))
        .withColumn("rate", F.try_divide(F.col("passed"), F.col("passed") + F.col("failed"))))


def run_campaign(cases: DataFrame, producers: DataFrame, evaluators: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J08 — every case meets the producer and the evaluators of its family.

    ``producers`` has one row per family; ``evaluators`` has one row per evaluator. Both are registries with
    a fixed number of rows. Returns the pairs to judge and a warning for each case without a producer.
    """
    known = cases.join(producers, "family")
    pairs = known.join(evaluators, "family")
    orphans = cases.join(producers, "family", "left_anti").select(
        "case_id", F.concat(F.lit("no producer for family "), "family").alias("warning"))
    return pairs, orphans


def compare_with_approved(approved: DataFrame, current: DataFrame, scale_table: DataFrame | None = None) -> DataFrame:
    """J09 — what moved since the approved state: nouveau, régression, progrès, disparu.

    ``approved`` has case_id, evaluator, scale, label; ``current`` also score. Undecided current verdicts are skipped
    but still count as seen.
    """
    key = ["case_id", "evaluator"]
    before = score_labels(approved, scale_table).select(*key, F.col("label").alias("before"), F.col("score").alias("_was"))
    now = current.select(*key, F.col("label").alias("after"), F.col("score").alias("_now"), F.lit(True).alias("_seen"))
    j = before.join(now, key, "full")
    way = (F.when(F.col("_seen").isNull(), "disparu").when(F.col("_now").isNull(), None)
           .when(F.col("before").isNull(), "nouveau").when(F.col("before") == F.col("after"), None)
           .when(F.coalesce(F.col("_was") >= 1.0, F.lit(False)), "régression").otherwise("progrès"))
    return j.withColumn("way", way).filter("way IS NOT NULL").select(
        *key, F.coalesce("before", F.lit("—")).alias("before"), F.coalesce("after", F.lit("—")).alias("after"), "way")


def gate(current: DataFrame, approved: DataFrame, differences: DataFrame, warnings: int = 0) -> DataFrame:
    """R10 — 2 when nothing was measured, nothing is approved or there are warnings; 1 when something moved; else 0."""
    one = (current.agg(F.count(F.lit(1)).alias("measured"))
           .crossJoin(approved.agg(F.count(F.lit(1)).alias("approved")))
           .crossJoin(differences.agg(F.count(F.lit(1)).alias("moved"))))     # three one-row tables
    code = (F.when((F.col("measured") == 0) | (F.col("approved") == 0) | F.lit(warnings > 0), 2)
            .when(F.col("moved") > 0, 1).otherwise(0))
    return one.withColumn("code", code)


def set_fingerprint(df: DataFrame, row: Column, parts: int = 1024, digits: int = 16) -> DataFrame:
    """R12, S13 — fingerprint of a set of rows, independent of row order and of the partitioning.

    Row hashes are first combined inside ``parts`` groups, then over the groups. Sorting a group needs its rows in
    one place, so groups are combined by exact sums of the hash words instead of by concatenation.
    """
    return df.select(row_words(row)).agg(*combine_words()).select(word_fingerprint(digits).alias("fingerprint"))


def row_words(row: Column) -> Column:
    return F.sha2(row, 256).alias("_h")


def combine_words(name: str = "_h") -> list[Column]:
    """Order-free combination of 256-bit row hashes: four exact sums of 56-bit words and a count."""
    h = F.col(name)
    return [F.sum(F.conv(F.substring(h, 1 + 14 * i, 14), 16, 10).cast("decimal(20,0)")).alias(f"_w{i}") for i in range(4)] + [
        F.count(F.lit(1)).alias("_rows")]


def word_fingerprint(digits: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(f"_w{i}").cast("string"), F.lit("0")) for i in range(4)],
                                          F.col("_rows").cast("string")), 256), 1, digits)


def approved_extract(verdicts: DataFrame) -> DataFrame:
    """R12 — the deterministic verdicts as sorted ``case|evaluator`` keys with their label."""
    return (verdicts.filter("deterministic").select(F.concat_ws("|", "case_id", "evaluator").alias("key"), "label").orderBy("key"))


# ----------------------------------------------------------------------------------- publication
def canonical_example(cases: DataFrame) -> DataFrame:
    """V25 — published form of a case and its fingerprint: keys sorted, content left out when private."""
    c = F.col
    private = ~F.coalesce("shareable", F.lit(True)) | (c("origin") == "transcript")
    inp = F.when(private, F.create_map(F.lit("id"), c("case_id"))).otherwise(F.create_map(F.lit("entree"), c("input_json")))
    out = F.when(private, F.create_map(F.lit("intitule"), c("title"))).otherwise(F.create_map(F.lit("attendu"), c("expected_json")))
    meta = F.create_map(F.lit("epreuve_id"), c("case_id"), F.lit("etiquettes"), F.array_join("tags", ","),
                        F.lit("famille"), c("family"), F.lit("intitule"), c("title"), F.lit("origine"), c("origin"))
    whole = F.to_json(F.struct(inp.alias("input"), out.alias("output"), meta.alias("metadata")))
    return cases.withColumn("canonical", whole).withColumn("fingerprint", F.sha2("canonical", 256))


def missing_examples(cases: DataFrame, remote: DataFrame) -> DataFrame:
    """J10 — cases whose (id, fingerprint) is not published yet."""
    return cases.join(remote.select("case_id", "fingerprint").distinct(), ["case_id", "fingerprint"], "left_anti")


def attach_examples(cases: DataFrame, remote: DataFrame) -> DataFrame:
    """J11 — each case with its newest matching example, and a warning when there is none or more than one.

    The newest example is an aggregate, so many copies of one case never meet in one task. ``position`` is the
    place in the remote answer: without any date the last one wins.
    """
    dated = F.col("updated_at").isNotNull()
    best = remote.groupBy("case_id", "fingerprint").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.max_by("example_id", F.when(dated, F.struct("updated_at", -F.col("position")))).alias("_newest"),
        F.max_by("example_id", "position").alias("_last"))
    j = cases.join(best, ["case_id", "fingerprint"], "left")
    n = F.coalesce("candidates", F.lit(0))
    return j.select("case_id", "fingerprint", F.coalesce("_newest", "_last").alias("example_id"),
                    F.when(n == 0, "no example").when(n > 1, "several examples").alias("warning"))


def append_new(existing: DataFrame, proposed: DataFrame, text: str, keys: list[str], order: list[str]) -> DataFrame:
    """E07 — existing rows plus the proposals whose text is new (case ignored), first of equal proposals only."""
    low = F.lower(text)
    have = existing.select(*keys, low.alias("_low")).distinct()
    fresh = (proposed.withColumn("_low", low).join(have, [*keys, "_low"], "left_anti").groupBy(*keys, "_low")
             .agg(F.min_by(F.struct(*proposed.columns), F.struct(*order)).alias("_r")).select("_r.*"))
    return existing.withColumn("added", F.lit(False)).unionByName(fresh.withColumn("added", F.lit(True)))


# --------------------------------------------------------------------------------------- registry
EVALUATORS: dict[str, dict] = {}


def evaluator(name: str, family: str, scale: str, deterministic: bool = True):
    """V26 — register a function ``DataFrame -> DataFrame(case_id, label, evidence)`` as an evaluator of a family."""
    def add(fn):
        EVALUATORS[name] = {"family": family, "scale": scale, "deterministic": deterministic, "apply": fn}
        return fn
    return add


def evaluate(family: str, subjects: DataFrame) -> DataFrame:
    """V26 — all verdicts of one family: each registered evaluator judges the subjects, scores are added."""
    out = None
    for name, e in EVALUATORS.items():
        if e["family"] != family:
            continue
        v = e["apply"](subjects).withColumns({"evaluator": F.lit(name), "scale": F.lit(e["scale"]), "deterministic": F.lit(e["deterministic"])})
        out = v if out is None else out.unionByName(v)
    return score_labels(out)
