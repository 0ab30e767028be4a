"""Transcript lines to sessions (P03, P04, F01, A01-A06 and the JSONL pipeline)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.functions import exprs as X
from turnstone.functions import fixed_values as V
from turnstone.operators import ordered as O, turns as U
from turnstone.session import stored


def with_session(records: DataFrame) -> DataFrame:
    """F01 — only records that name their session."""
    return records.filter(F.coalesce(F.col("session_id"), F.lit("")) != "")


def usage_counter(message, name: str) -> Column:
    """P04 — a token counter, 0 when missing or not a whole number."""
    kind = F.schema_of_variant(F.try_variant_get(X._c(message), f"$.usage.{name}", "variant"))
    n = F.try_variant_get(X._c(message), f"$.usage.{name}", "bigint")
    return F.coalesce(F.when(kind != "STRING", n), F.lit(0).cast("bigint"))


def blocks_of(message) -> Column:
    return F.try_variant_get(X._c(message), "$.content", "array<variant>")


def tool_use_blocks(rows: DataFrame, message: str, keep: list[str]) -> DataFrame:
    """P03 — one row per tool-use block that carries an id; position kept.

    The input is kept as the JSON text of the line when the record carries it (``block_inputs``), so that the order of
    its keys still counts when two inputs are compared.
    """
    texts = F.col("block_inputs") if "block_inputs" in rows.columns else F.lit(None).cast("array<string>")
    out = rows.select(*keep, texts.alias("_texts"), F.posexplode(blocks_of(message)).alias("pos", "_b"))
    return (out.filter(F.try_variant_get("_b", "$.type", "string") == "tool_use")
            .select(*keep, "pos", F.try_variant_get("_b", "$.id", "string").alias("tool_use_id"),
                    F.coalesce(F.try_variant_get("_b", "$.name", "string"), F.lit("unknown")).alias("name"),
                    F.coalesce(F.get("_texts", F.col("pos")), F.to_json(F.try_variant_get("_b", "$.input", "variant"))).alias("input_json"))
            .filter(F.coalesce("tool_use_id", F.lit("")) != ""))


def tool_result_blocks(rows: DataFrame, message: str, keep: list[str], max_text: int = 2000) -> DataFrame:
    """The tool-result blocks of user lines that are not human prompts.

    ``result_text`` is cut to ``max_text`` characters; ``result_ref`` is the fingerprint of the whole text.
    """
    out = rows.select(*keep, F.posexplode(blocks_of(message)).alias("pos", "block"))
    content = F.try_variant_get("block", "$.content", "variant")
    text = F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get("block", "$.content", "string")).otherwise(F.to_json(content))
    return (out.filter(F.try_variant_get("block", "$.type", "string") == "tool_result")
            .withColumns({"tool_use_id": F.try_variant_get("block", "$.tool_use_id", "string"),
                          "result_text": X.truncate(text, max_text), "result_ref": X.fingerprint(text)})
            .filter("tool_use_id IS NOT NULL"))


# ----------------------------------------------------------------------------------- parse report
def parse_report(lines: DataFrame) -> DataFrame:
    """A01 — totals of a scan; ``lines`` has ``line_len`` and ``readable``."""
    rate = F.try_divide(F.col("lines_unreadable"), F.col("lines_read"))
    return (lines.agg(F.count_if(F.col("line_len") > 0).alias("lines_read"),
                      F.count_if((F.col("line_len") > 0) & ~F.col("readable")).alias("lines_unreadable"),
                      F.count_if((F.col("line_len") > 0) & F.col("readable")).alias("records_kept"))
            .withColumn("unreadable_rate", F.coalesce(rate, F.lit(0.0)))
            .withColumn("looks_broken", (F.col("lines_read") > V.BROKEN_MIN_LINES) & (F.col("unreadable_rate") > V.BROKEN_RATE)))


def histogram(df: DataFrame, column, empty: str | None = "<sans type>") -> DataFrame:
    """A02 — counts per value; NULL gets a label, or is left out when ``empty`` is None."""
    c = X._c(column)
    rows = df if empty is not None else df.filter(F.coalesce(c, F.lit("")) != "")
    return rows.groupBy(F.coalesce(c, F.lit(empty or "")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def top_n(hist: DataFrame, n: int = 10) -> DataFrame:
    """K10 — the n most frequent values, ties by value."""
    return hist.orderBy(F.desc("n"), "value").limit(n)


def fields_by_type(df: DataFrame, type_, raw) -> DataFrame:
    """A03 — which field names occur on which record type."""
    rows = df.select(F.coalesce(X._c(type_), F.lit("<sans type>")).alias("type"),
                     F.explode(F.json_object_keys(X._c(raw))).alias("field"))
    return rows.groupBy("type", "field").agg(F.count(F.lit(1)).alias("n"))


def missing_critical(fields: DataFrame, critical=None) -> DataFrame:
    """A06 — required (type, field) pairs that never occur; a missing type is named once per pair."""
    critical = critical or V.CRITICAL_FIELDS
    want = fields.sparkSession.createDataFrame(critical, "type string, field string")
    present = fields.select("type", "field").distinct()
    types = fields.select(F.col("type").alias("_t")).distinct()
    miss = want.join(present, ["type", "field"], "left_anti").join(types, F.col("type") == F.col("_t"), "left")
    return miss.select("type", "field", F.when(F.col("_t").isNull(), F.concat("type", F.lit(" (type absent)")))
                       .otherwise(F.concat_ws(".", "type", "field")).alias("missing"))


LENGTH_RANGE = 1024


def length_summary(df: DataFrame, length: Column) -> DataFrame:
    """A05 — min, upper median and max of a length.

    Lengths are counted first, so only distinct lengths are ordered, never the rows. Their running count is a prefix scan over ranges of
    ``LENGTH_RANGE`` lengths, so no task sees all of them; the median is the first length whose running count passes the middle.
    """
    counts = df.groupBy(length.alias("len")).agg(F.count(F.lit(1)).alias("n")).filter("len IS NOT NULL").withColumn("_all", F.lit(1))
    ranked = O.ordered_scan(counts, ["_all"], ["len"], {"upto": O.running_sum(F.col("n"))}, O.runs("len", LENGTH_RANGE))
    total = counts.agg(F.sum("n").alias("total"))
    return ranked.crossJoin(F.broadcast(total)).agg(          # one row
        F.max("total").alias("n"), F.min("len").alias("min_len"), F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("len"))).alias("median_len"), F.max("len").alias("max_len"))


# ------------------------------------------------------------------------------------- sessions
RANGE_LINES = 1_000_000


def seq_bucket() -> Column:
    """Cuts a session at files and ranges of lines."""
    return F.struct("file", F.floor(F.col("line_no") / RANGE_LINES).alias("part"))


def mark_humans(records: DataFrame) -> DataFrame:
    text = U.user_text("message")
    origin = F.try_variant_get("origin", "$.kind", "string")
    return (records.withColumn("user_text", X.trimmed(text))
            .withColumn("is_human", U.is_human_prompt("type", "is_meta", "user_text", origin))
            .withColumn("is_sidechain", F.coalesce("is_sidechain", F.lit(False))))


def build_sessions(records: DataFrame) -> dict[str, DataFrame]:
    """W01-W03, J01, J02 — the session tables of a record scan ordered by (file, line_no).

    The records with their turn index feed every table below, so they are written once.
    """
    order = ["file", "line_no"]
    rank = F.struct(*order)
    marked = mark_humans(with_session(records))
    seen = O.ordered_scan(marked, ["session_id"], order, {
        "turn_index": O.running_sum(F.col("is_human").cast("bigint")),
        "ended_so_far": O.running_max(F.col("timestamp"))}, seq_bucket())
    seen = seen.withColumns({"lane": F.when(F.col("is_sidechain") & ~F.col("is_human"), "agent").otherwise("main"),
                             "at": F.coalesce("timestamp", "ended_so_far")})
    seen = stored(seen, "records")
    sessions = seen.groupBy("session_id").agg(
        *[F.min_by(c, rank).alias(c) for c in ("cwd", "git_branch", "version", "entrypoint")],
        F.min("timestamp").alias("started_at"), F.max("timestamp").alias("ended_at"))

    # a turn opens on a human prompt, or on the first assistant line of a lane
    key = ["session_id", "turn_index", "lane"]
    part = seen.filter("is_human OR type = 'assistant'")
    steps_only = F.col("type") == "assistant"
    stop = F.try_variant_get("message", "$.stop_reason", "string")
    texts = F.filter(blocks_of("message"), lambda b: (F.try_variant_get(b, "$.type", "string") == "text")
                     & ~X.is_blank(F.try_variant_get(b, "$.text", "string")))
    said = F.try_variant_get(F.try_element_at(texts, F.lit(-1)), "$.text", "string")
    turns = part.groupBy(*key).agg(
        F.min(rank).alias("opened"), F.min_by("at", rank).alias("started_at"),
        F.max_by("user_text", F.when(F.col("is_human"), rank)).alias("prompt"),
        F.max_by("prompt_id", F.when(F.col("is_human"), rank)).alias("prompt_id"),
        F.coalesce(F.bool_or(F.col("is_human") & F.col("is_sidechain")), F.lit(False)).alias("human_side"),
        F.max(F.when(steps_only, F.col("timestamp"))).alias("last_answer"),
        F.max_by(stop, F.when(steps_only & (F.coalesce(stop, F.lit("")) != ""), rank)).alias("stop_reason"),
        F.max_by(said, F.when(steps_only & said.isNotNull(), rank)).alias("final_message"))
    turns = turns.select(
        *key, "opened", "started_at", F.greatest("started_at", "last_answer").alias("ended_at"),
        F.coalesce("prompt", F.lit("")).alias("prompt"), "prompt_id",
        F.coalesce("final_message", F.lit("")).alias("final_message"), "stop_reason",
        (F.col("human_side") | (F.col("lane") == "agent")).alias("is_sidechain"))
    turns = O.ordered_scan(turns.withColumns({"file": F.col("opened.file"), "line_no": F.col("opened.line_no")}),
                           ["session_id"], order, {"pos": O.number()}, seq_bucket())
    turns = stored(turns.withColumn("turn_no", F.col("pos") - 1).drop("pos", "opened", "file", "line_no"), "turns")

    ids = turns.select(*key, "turn_no")
    answers = part.filter(steps_only).join(ids, key)
    place = ["session_id", "turn_no", *order]
    has_message = F.schema_of_variant("message").startswith("OBJECT")
    steps = answers.filter(has_message).select(
        *place, "at", F.try_variant_get("message", "$.model", "string").alias("model"), stop.alias("stop_reason"),
        *[usage_counter("message", f).alias(a) for f, a in [
            ("input_tokens", "input_tokens"), ("cache_read_input_tokens", "cache_read_tokens"),
            ("cache_creation_input_tokens", "cache_creation_tokens"), ("output_tokens", "output_tokens")]],
        F.coalesce(F.size(F.filter(blocks_of("message"), lambda b: F.try_variant_get(b, "$.type", "string") == "tool_use")),
                   F.lit(0)).alias("tool_blocks"))
    skills = (answers.filter(F.coalesce("attribution_skill", F.lit("")) != "")
              .select("session_id", "turn_no", F.col("attribution_skill").alias("skill")).distinct())
    calls = (tool_use_blocks(answers, "message", [*place, "at"])
             .withColumnRenamed("at", "called_at").withColumn("pos", F.col("pos").cast("bigint")))
    results = tool_result_blocks(seen.filter("type = 'user' AND NOT is_human"), "message",
                                 [*order, "timestamp", "tool_use_result"])
    results = results.select("tool_use_id", *order, F.col("pos").cast("bigint").alias("pos"),
                             F.col("timestamp").alias("result_at"), "result_text", "result_ref",
                             F.to_json("block").alias("block_json"), F.to_json("tool_use_result").alias("extra_json"))
    matched = U.match_results(calls, results, ["tool_use_id"], [*order, "pos"],
                              ["result_at", "result_text", "result_ref", "block_json", "extra_json"], seq_bucket())
    matched = U.classify_result(matched, F.try_parse_json("block_json"), F.try_parse_json("extra_json"))
    return {"sessions": sessions, "turns": turns, "steps": steps, "turn_skills": skills,
            "calls": matched.drop("block_json", "extra_json"), "records": seen}


def message_probe(rows: DataFrame) -> DataFrame:
    """A04 — usage fields, block types and tool names of assistant messages, as (what, value, n)."""
    blocks = rows.select(F.explode(blocks_of("message")).alias("b")).filter(F.schema_of_variant("b").startswith("OBJECT"))
    named = blocks.select(F.explode(F.array(
        F.struct(F.lit("block").alias("what"), F.try_variant_get("b", "$.type", "string").alias("value")),
        F.struct(F.lit("tool").alias("what"), F.try_variant_get("b", "$.name", "string").alias("value")))).alias("x")).select("x.*")
    usage = rows.select(F.explode(F.json_object_keys(F.to_json(F.try_variant_get("message", "$.usage", "variant")))).alias("value"))
    return (named.unionByName(usage.select(F.lit("usage").alias("what"), "value")).filter("value IS NOT NULL")
            .groupBy("what", "value").agg(F.count(F.lit(1)).alias("n")))
