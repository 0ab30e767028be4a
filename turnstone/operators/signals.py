"""The 19 task signals (G01-G20) and the call-sequence operators they stand on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.functions import exprs as X
from turnstone.functions import fixed_values as V
from turnstone.operators import ordered as O

CALL_BUCKET = 100_000
SIGNAL_KEYS = [k for k, *_ in V.SIGNAL_SPECS if k != "compaction_mode"]
SIGNAL_LEVEL = {k: level for k, level, *_ in V.SIGNAL_SPECS}


def is_verification(name="name", input_json="input_json") -> Column:
    """F03 — a shell call that runs a test, a build or a linter."""
    return (X._c(name) == "Bash") & F.coalesce(X.word_match(input_json, V.VERIFICATION_PATTERN), F.lit(False))


def has_acceptance_cue(prompt, pattern: str = V.ACCEPTANCE_PATTERN) -> Column:
    """F04 — the prompt says what the result must look like."""
    return X.word_match(prompt, pattern)


def next_calls(calls: DataFrame, keys: list[str], order: list[str], bucket: Column) -> DataFrame:
    """Position of a call among those of its key, and the calls that follow it."""
    nxt = F.struct("name", "input_json")
    scans = {"idx": O.number()} | {f"next{i}": O.lead(nxt, i) for i in range(1, V.RETRY_HORIZON + 1)}
    return O.ordered_scan(calls, keys, order, scans, bucket)


def retry_kind() -> Column:
    """W08 — after a failed call, the first of the next three calls with the same name: identical or different input."""
    followers = F.array(*[F.col(f"next{i}") for i in range(1, V.RETRY_HORIZON + 1)])
    again = F.get(F.filter(followers, lambda f: f["name"] == F.col("name")), F.lit(0))
    return F.when(F.col("failed") & again.isNotNull(),
                  F.when(again["input_json"].eqNullSafe(F.col("input_json")), "identical").otherwise("different"))


def call_facts(calls: DataFrame, key: list[str], order: list[str], bucket: Column) -> DataFrame:
    """Everything the signals need from the calls of a key, as one partial aggregation."""
    seq = (next_calls(calls, key, order, bucket)
           .withColumns({"retry": retry_kind(), "verif": is_verification()}))
    n = F.col("name")
    whole = (n == "Read") & ~X.json_has_any("input_json", ["offset", "limit"])
    return seq.groupBy(*key).agg(
        F.count(F.lit(1)).alias("calls"), F.count_distinct(n).alias("tools"),
        F.count_if(whole).alias("whole_reads"), F.count_if(n.isin("Grep", "Glob")).alias("searches"),
        F.count_if(n == "Skill").alias("skill_calls"), F.count_if(X.is_mcp(n)).alias("mcp_calls"),
        F.count_if("failed").alias("failed_calls"), F.count_if("verif").alias("verifications"),
        F.max(F.when(F.col("verif"), F.struct("idx", "failed"))).alias("last_verif"),
        F.count_if(n == "TaskCreate").alias("plans"), F.count_if(n.isin("Agent", "Task")).alias("spawns"),
        F.count_if(F.col("retry") == "identical").alias("identical"),
        F.count_if(F.col("retry") == "different").alias("different"))


def closes_on_verification() -> Column:
    """W09 — the last verification succeeded and is among the last three calls."""
    v = F.col("last_verif")
    return F.coalesce(~v["failed"] & (v["idx"] >= F.col("calls") - 2), F.lit(False))


def signals_wide(tasks: DataFrame, task_turns: DataFrame, calls: DataFrame, steps: DataFrame, turn_skills: DataFrame,
                 turns: DataFrame, agent_turns: DataFrame, context_window: int = V.CONTEXT_WINDOW,
                 acceptance: str = V.ACCEPTANCE_PATTERN) -> DataFrame:
    """G01-G19 — one row per task with the raw facts and the 19 values (NULL = undetermined)."""
    key = ["session_id", "task_no"]
    owner = task_turns.select("session_id", "turn_no", "task_no")
    mine = calls.join(owner, ["session_id", "turn_no"])
    facts = call_facts(mine, key, ["turn_no", "call_no"], F.floor(F.col("turn_no") / CALL_BUCKET))
    total = X.total_input("input_tokens", "cache_read_tokens", "cache_creation_tokens")
    per_step = steps.join(owner, ["session_id", "turn_no"]).groupBy(*key).agg(
        F.count(F.lit(1)).alias("steps"), F.max(total).alias("peak"), F.sum(total).alias("read_tokens"),
        F.sum("cache_read_tokens").alias("cached_tokens"), F.count_if(F.col("tool_blocks") > 1).alias("parallel_steps"))
    per_skill = (turn_skills.join(owner, ["session_id", "turn_no"]).groupBy(*key)
                 .agg(F.count_distinct(F.lower("skill")).alias("skills")))
    agent_calls = (calls.join(agent_turns.select("session_id", "turn_no", "task_no"), ["session_id", "turn_no"])
                   .groupBy(*key).agg(F.count(F.lit(1)).alias("agent_calls")))
    isolated = turns.filter("is_sidechain").groupBy("session_id").agg(F.count(F.lit(1)).alias("sidechains"))

    wide = (tasks.select(*key, "task_id", "title", "started_at", "turns", "rework_turns", "first_prompt", "completed",
                         "in_progress", "agent_turns", F.col("tool_calls").alias("all_calls"))
            .join(facts, key, "left").join(per_step, key, "left").join(per_skill, key, "left")
            .join(agent_calls, key, "left").join(isolated, "session_id", "left"))
    counts = ["calls", "tools", "whole_reads", "searches", "skill_calls", "mcp_calls", "failed_calls", "verifications",
              "plans", "spawns", "identical", "different", "steps", "peak", "read_tokens", "cached_tokens",
              "parallel_steps", "skills", "agent_calls", "sidechains"]
    wide = wide.fillna(0, counts)

    def share(a, b, empty=0.0) -> Column:
        return F.when(b == 0, F.lit(float(empty))).otherwise(a / b)

    c = F.col
    one = F.lit(1.0)

    def flag(x: Column) -> Column:
        return F.when(x, one).otherwise(F.lit(0.0))

    values = {
        "rework_ratio": share(c("rework_turns"), c("turns")),
        "prompts_per_task": c("turns").cast("double"),
        "first_try_success": F.when(~c("in_progress"), flag((c("rework_turns") == 0) & c("completed"))),
        "has_acceptance_criteria": flag(F.coalesce(has_acceptance_cue("first_prompt", acceptance), F.lit(False))),
        "context_pressure": c("peak") / F.lit(float(context_window)) if context_window else F.lit(0.0),
        "cache_read_ratio": share(c("cached_tokens"), c("read_tokens")),
        "load_precision": share(c("searches"), c("searches") + c("whole_reads"), 1),
        "context_isolation": c("sidechains").cast("double"),
        "harness_breadth": c("tools").cast("double"),
        "skill_usage_rate": share(c("skill_calls") + c("skills"), c("calls")),
        "mcp_utilization": share(c("mcp_calls"), c("calls")),
        "tool_failure_rate": share(c("failed_calls"), c("calls")),
        "verification_present": flag(c("verifications") > 0),
        "autonomy_ratio": share(c("calls"), c("turns")),
        "parallelism_index": share(c("parallel_steps"), c("steps")),
        "loop_closure": F.when(~c("in_progress"), flag(closes_on_verification())),
        "plan_structure": flag(c("plans") > 0),
        "graph_depth": F.greatest(c("spawns"), c("agent_turns")).cast("double"),
        "self_correction": share(c("different"), c("different") + c("identical")),
    }
    return wide.withColumns(values).drop("last_verif")


def evidence() -> dict[str, Column]:
    """G20 — the sentence that explains each value, from the facts of the same row."""
    c, s = F.col, (lambda name: F.col(name).cast("string"))

    def say(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    return {
        "rework_ratio": say(s("rework_turns"), " follow-up(s) after the first prompt"),
        "prompts_per_task": say(s("turns"), " prompt(s) in this task"),
        "first_try_success": F.when(c("in_progress"), "task still open, outcome unknown")
        .when((c("rework_turns") == 0) & c("completed"), "closed without a follow-up")
        .otherwise("needed at least one follow-up"),
        "has_acceptance_criteria": F.when(c("has_acceptance_criteria") == 1, "the first prompt states the expected result")
        .otherwise("the first prompt does not state when it is done"),
        "context_pressure": say("largest context read: ", s("peak"), " tokens"),
        "cache_read_ratio": say(s("cached_tokens"), " of ", s("read_tokens"), " read tokens came from the cache"),
        "load_precision": say(s("searches"), " search(es) against ", s("whole_reads"), " whole-file read(s)"),
        "context_isolation": say(s("sidechains"), " turn(s) delegated to an agent"),
        "harness_breadth": say(s("tools"), " distinct tool(s)"),
        "skill_usage_rate": say(s("skills"), " skill(s) attributed, ", s("skill_calls"), " skill call(s)"),
        "mcp_utilization": say(s("mcp_calls"), " call(s) to a tool server"),
        "tool_failure_rate": say(s("failed_calls"), " failure(s) in ", s("calls"), " call(s)"),
        "verification_present": say(s("verifications"), " verification command(s)"),
        "autonomy_ratio": say(s("calls"), " call(s) for ", s("turns"), " human turn(s)"),
        "parallelism_index": say(s("parallel_steps"), " of ", s("steps"), " step(s) started several tools"),
        "loop_closure": F.when(c("in_progress"), "task still open, closure unknown")
        .when(c("loop_closure") == 1, "ends on a successful verification")
        .otherwise("ends without a final verification"),
        "plan_structure": F.when(c("plan_structure") == 1, "split into explicit tasks").otherwise("no explicit plan"),
        "graph_depth": say(F.greatest("spawns", "agent_turns").cast("string"), " agent(s), ", s("agent_calls"),
                           " delegated call(s)"),
        "self_correction": say(s("different"), " retry(ies) with another input, ", s("identical"), " identical"),
    }


def signals_long(wide: DataFrame) -> DataFrame:
    """G20 — one row per task and signal: key, level, value, evidence."""
    why = evidence()
    rows = F.array(*[F.struct(F.lit(k).alias("signal"), F.lit(SIGNAL_LEVEL[k]).alias("level"),
                              F.col(k).alias("value"), why[k].alias("evidence")) for k in SIGNAL_KEYS])
    return (wide.select("session_id", "task_no", "task_id", "title", "started_at", F.explode(rows).alias("_s"))
            .select("session_id", "task_no", "task_id", "title", "started_at", "_s.*"))
