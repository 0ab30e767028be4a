"""Records to turns, calls and steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.functions import exprs as X
from turnstone.functions import fixed_values as V
from turnstone.operators import ordered as O


def user_text(message) -> Column:
    """P01 — text of a user message: the string itself, or its text blocks joined by line breaks."""
    m = X._c(message)
    plain = F.try_variant_get(m, "$.content", "string")
    is_text = F.schema_of_variant(F.try_variant_get(m, "$.content", "variant")) == "STRING"
    blocks = F.try_variant_get(m, "$.content", "array<variant>")
    texts = F.transform(
        F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string") == "text"),
        lambda b: F.try_variant_get(b, "$.text", "string"))
    joined = F.array_join(F.filter(texts, lambda x: x.isNotNull() & (x != "")), "\n")
    return F.when(is_text, plain).otherwise(F.coalesce(joined, F.lit("")))


def is_human_prompt(type_, is_meta, text, origin_kind) -> Column:
    """P02 — typed by a person: a user line, not injected, not blank, no tooling prefix; an origin decides when given."""
    t = X.trimmed(F.coalesce(X._c(text), F.lit("")))
    made_up = X.bind(F.lower(t), lambda low: reduce(Column.__or__, [low.startswith(F.lower(F.lit(p))) for p in V.SYNTHETIC_PREFIXES]))     # trimmed once, not per prefix
    origin = X._c(origin_kind)
    ok = (X._c(type_) == "user") & ~F.coalesce(X._c(is_meta), F.lit(False)) & (t != "") & ~made_up
    return F.coalesce(ok & F.when(origin.isNotNull(), F.lower(origin) == "human").otherwise(True), F.lit(False))


def assign_turns(records: DataFrame, seq: str, bucket: Column) -> DataFrame:
    """W02 — turn number of each record: how many human prompts its session has seen so far.

    Agent lines get their own lane; a human prompt always opens a turn of the main lane, even when it
    carries the sidechain flag. Turn 0 of the main lane is the continuation without a prompt.
    """
    out = O.ordered_scan(records, ["session_id"], [seq],
                         {"turn_no": O.running_sum(F.col("is_human").cast("bigint"))}, bucket)
    return out.withColumn("lane", F.when(F.col("is_sidechain") & ~F.col("is_human"), "agent").otherwise("main"))


def match_results(calls: DataFrame, results: DataFrame, keys: list[str], order: list[str], take: list[str],
                  bucket: Column) -> DataFrame:
    """J01 — a result belongs to the latest call with its id that is still open, once.

    In the order of the lines of one id, that is simply the line right after the call, if it is a result.
    One union and one ordered scan replace the join.
    """
    payload = F.struct(*take)
    c = calls.select(*keys, *order, F.struct(*calls.columns).alias("_call"),
                     F.lit(None).cast(results.select(payload).schema[0].dataType).alias("_result"))
    r = results.select(*keys, *[col for col in order if col in results.columns],
                       F.lit(None).cast(calls.select(F.struct("*")).schema[0].dataType).alias("_call"),
                       payload.alias("_result"),
                       *[F.lit(0).alias(col) for col in order if col not in results.columns])
    nxt = O.ordered_scan(c.unionByName(r), keys, order, {"_next": O.lead(F.col("_result"))}, bucket)
    return nxt.filter("_call IS NOT NULL").select("_call.*", *[F.col(f"_next.{x}").alias(x) for x in take])


def classify_result(matched: DataFrame, block: Column, extra: Column) -> DataFrame:
    """J02 — failure and its reason from the three places it may be written; duration, else the time between the lines."""
    is_error = F.try_variant_get(block, "$.is_error", "boolean")
    code = F.try_variant_get(extra, "$.code", "int")
    reason = (F.when(is_error, F.lit("is_error"))
              .when(F.try_variant_get(extra, "$.interrupted", "boolean"), F.lit("interrupted"))
              .when(~F.try_variant_get(extra, "$.success", "boolean"), F.lit("success=false"))
              .when(code != 0, F.concat(F.lit("code="), code.cast("string"))))
    elapsed = (F.unix_micros("result_at") - F.unix_micros("called_at")) / F.lit(1000.0)
    return (matched.withColumn("failure_reason", reason)
            .withColumn("failed", F.col("failure_reason").isNotNull())
            .withColumn("duration_ms", F.coalesce(F.try_variant_get(extra, "$.durationMs", "double"), elapsed)))
