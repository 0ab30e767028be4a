"""Turns to tasks: boundary decision, numbering, agent attachment and roll-up."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.functions import exprs as X
from turnstone.functions import fixed_values as V
from turnstone.operators import intervals, ordered as O

TURN_BUCKET = 100_000          # a hot session is cut every so many turns


@dataclass(frozen=True)
class BoundaryRules:
    silence_minutes: float = V.SILENCE_MINUTES
    unfinished_minutes: float = V.UNFINISHED_MINUTES
    short_chars: int = V.SHORT_PROMPT_CHARS
    corrective: list = field(default_factory=lambda: V.CORRECTIVE_OPENERS)
    continuation: list = field(default_factory=lambda: V.CONTINUATION_OPENERS)
    referential: str = V.REFERENTIAL_PATTERN


def turn_bucket() -> Column:
    return F.floor(F.col("turn_no") / TURN_BUCKET)


def is_referential(prompt, rules: BoundaryRules = BoundaryRules()) -> Column:
    """F05 — the prompt points back at something already said."""
    return X.word_match(F.lower(X._c(prompt)), rules.referential)


def completed(stop) -> Column:
    return F.coalesce(F.lower(X._c(stop)) == "end_turn", F.lit(False))


def in_progress(stop) -> Column:
    s = X._c(stop)
    return s.isNull() | (s == "tool_use")


def boundary_decisions(turns: DataFrame, rules: BoundaryRules = BoundaryRules()) -> DataFrame:
    """W05 — for each main turn: does it open a task, and why. Rule order decides."""
    main = turns.filter(~F.col("is_sidechain"))
    seen = O.ordered_scan(main, ["session_id"], ["turn_no"],
                          {"_prev": O.lag(F.struct("ended_at", "stop_reason"))}, turn_bucket())
    # trimmed and lower-cased once; the rules below only refer to the two columns
    seen = seen.withColumn("_p", X.trimmed(F.coalesce(F.col("prompt"), F.lit("")))).withColumn("_lp", F.lower("_p"))
    prompt, lower = F.col("_p"), F.col("_lp")
    gap = F.unix_micros("started_at") - F.unix_micros("_prev.ended_at")
    minute = 60_000_000
    corrective = X.first_opener(lower, rules.corrective)
    continuation = X.first_opener(lower, rules.continuation)
    is_short = (F.length(prompt) < rules.short_chars) & X.word_match(lower, rules.referential)
    cases = [
        (F.col("_prev").isNull(), True, "first", F.lit(V.REASON_FIRST)),
        (prompt == "", False, "no_prompt", F.lit(V.REASON_NO_PROMPT)),
        (gap > rules.silence_minutes * minute, True, "silence",
         F.format_string(V.REASON_SILENCE, F.round(gap / minute).cast("bigint"))),
        (corrective.isNotNull(), False, "corrective", F.format_string(V.REASON_CORRECTIVE, corrective)),
        (~completed("_prev.stop_reason") & (gap < rules.unfinished_minutes * minute), False, "unfinished",
         F.lit(V.REASON_UNFINISHED)),
        (continuation.isNotNull(), False, "continuation", F.format_string(V.REASON_CONTINUATION, continuation)),
        (is_short, False, "short", F.format_string(V.REASON_SHORT, F.length(prompt))),
    ]
    decided = F.struct(F.lit(True).alias("is_new"), F.lit("new").alias("rule"), F.lit(V.REASON_NEW).alias("reason"))
    for test, new, rule, reason in reversed(cases):
        decided = F.when(test, F.struct(F.lit(new).alias("is_new"), F.lit(rule).alias("rule"),
                                        reason.alias("reason"))).otherwise(decided)
    return seen.withColumn("_d", decided).select(*turns.columns, "_d.is_new", "_d.rule", "_d.reason")


def number_tasks(decided: DataFrame) -> DataFrame:
    """W06 — task number as the running count of boundaries; decisions stay as rows."""
    out = O.ordered_scan(decided, ["session_id"], ["turn_no"],
                         {"task_no": O.running_sum(F.col("is_new").cast("bigint"))}, turn_bucket())
    opened = F.when(F.col("is_new"), F.lit("ouverture — ")).otherwise(F.lit("rattaché — "))
    return out.withColumns({"task_id": F.concat_ws("#", F.col("session_id").cast("string"), F.col("task_no").cast("string")),
                            "decision": F.concat(opened, F.col("reason"))})


def attach_agent_turns(turns: DataFrame, task_turns: DataFrame) -> DataFrame:
    """J03 — each agent turn goes to the task open at its start, else to the first task of its session."""
    starts = (task_turns.filter("is_new").select("session_id", "task_no", F.col("started_at").alias("task_start")))
    agents = turns.filter("is_sidechain")
    hosted = intervals.as_of(agents, starts, ["session_id"], "started_at", "task_start", "task_no", ["task_no"])
    with_tasks = task_turns.select("session_id").distinct()
    return (hosted.join(with_tasks, "session_id", "left_semi")
            .withColumn("task_no", F.coalesce("task_no", F.lit(1).cast("bigint"))))


def drop_empty_turns(turns: DataFrame, calls: DataFrame, steps: DataFrame) -> DataFrame:
    """F02 — keep turns with a prompt, a call or a step."""
    used = (calls.select("session_id", "turn_no").unionByName(steps.select("session_id", "turn_no")).distinct()
            .withColumn("_used", F.lit(True)))
    return (turns.join(used, ["session_id", "turn_no"], "left")
            .filter((F.coalesce("prompt", F.lit("")) != "") | F.col("_used")).drop("_used"))


def active_time(marks: DataFrame, keys: list[str], cap_minutes: float = V.IDLE_GAP_MINUTES) -> DataFrame:
    """W04 — per key, the sum of the gaps between consecutive marks that are positive and within the cap."""
    gaps = O.ordered_scan(marks.filter("at IS NOT NULL"), keys, ["at"], {"_before": O.lag(F.unix_micros("at"))}, O.hours("at"))
    gap = F.unix_micros("at") - F.col("_before")
    counted = F.when((gap > 0) & (gap <= int(cap_minutes * 60_000_000)), gap).otherwise(F.lit(0))
    return gaps.groupBy(*keys).agg(F.sum(counted).alias("active_us"))


def turn_marks(turns: DataFrame, calls: DataFrame, steps: DataFrame) -> DataFrame:
    """Every instant at which something happened in a turn."""
    k = ["session_id", "turn_no"]
    return (turns.select(*k, F.explode(F.array("started_at", "ended_at")).alias("at"))
            .unionByName(steps.select(*k, "at"))
            .unionByName(calls.select(*k, F.explode(F.array("called_at", "result_at")).alias("at"))))


def task_rollup(task_turns: DataFrame, agent_turns: DataFrame, calls: DataFrame, turn_active: DataFrame) -> DataFrame:
    """W07 — one row per task."""
    key = ["session_id", "task_no"]
    base = task_turns.groupBy(*key, "task_id").agg(
        F.count(F.lit(1)).alias("turns"), F.min_by("started_at", "turn_no").alias("started_at"),
        F.max_by("ended_at", "turn_no").alias("ended_at"), F.min_by("prompt", "turn_no").alias("first_prompt"),
        F.max_by("stop_reason", "turn_no").alias("last_stop"))
    owner = (task_turns.select("session_id", "turn_no", "task_no", F.lit(False).alias("by_agent"))
             .unionByName(agent_turns.select("session_id", "turn_no", "task_no", F.lit(True).alias("by_agent"))))
    per_call = (calls.join(owner, ["session_id", "turn_no"]).groupBy(*key).agg(
        F.count(F.lit(1)).alias("tool_calls"),
        F.bool_or(F.col("name").isin("TaskCreate", "TaskUpdate") & ~F.col("by_agent")).alias("has_task_events")))
    per_agent = agent_turns.groupBy(*key).agg(F.count(F.lit(1)).alias("agent_turns"))
    active = (turn_active.join(task_turns.select("session_id", "turn_no", "task_no"), ["session_id", "turn_no"])
              .groupBy(*key).agg(F.sum("active_us").alias("active_us")))
    zero = F.lit(0).cast("bigint")
    title = X.make_title("first_prompt")
    return (base.join(per_call, key, "left").join(per_agent, key, "left").join(active, key, "left").select(
        "session_id", "task_no", "task_id", "turns", (F.col("turns") - 1).alias("rework_turns"), "first_prompt",
        F.when(title == "", F.lit(V.UNTITLED)).otherwise(title).alias("title"), "started_at", "ended_at",
        (F.unix_micros("ended_at") - F.unix_micros("started_at")).alias("wall_us"),
        F.coalesce("active_us", zero).alias("active_us"), completed("last_stop").alias("completed"),
        in_progress("last_stop").alias("in_progress"), F.coalesce("tool_calls", zero).alias("tool_calls"),
        F.coalesce("agent_turns", zero).alias("agent_turns"),
        F.coalesce("has_task_events", F.lit(False)).alias("has_task_events"),
        F.lit("heuristic").alias("source")))
