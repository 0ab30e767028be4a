"""Queries on turns, tasks and task signals (W, G, F, J01-J03)."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstone.functions import exprs as X
from turnstone.operators import intervals, ordered as O, signals as G, tasks as K
from turnstone.plans.bridge import ACCEPTANCE, IDLE_MINUTES, RULES
from turnstone.plans.registry import query, r6, us


@query("w01_session_rollup", """
SELECT user_id AS session_id, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) AS ended_us,
  arg_min(event_type, (ts, event_id)) AS entrypoint, arg_min(props, (ts, event_id)) AS first_props, count(*) AS records
FROM events GROUP BY user_id""")
def w01(t):
    rank = F.struct("ts", "event_id")
    return t.raw("events").groupBy(F.col("user_id").alias("session_id")).agg(
        F.unix_micros(F.min("ts")).alias("started_us"), F.unix_micros(F.max("ts")).alias("ended_us"),
        F.min_by("event_type", rank).alias("entrypoint"), F.min_by("props", rank).alias("first_props"),
        F.count(F.lit(1)).alias("records"))


@query("w02_turn_assignment", """
SELECT conv_id AS session_id, turn AS seq, CASE WHEN role = 'system' THEN 'agent' ELSE 'main' END AS lane,
  CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS turn_no
FROM conversations""")
def w02(t):
    from turnstone.operators.turns import assign_turns
    c = t.raw("conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), (F.col("role") == "user").alias("is_human"),
        (F.col("role") == "system").alias("is_sidechain"))
    return assign_turns(c, "seq", F.floor(F.col("seq") / 100_000)).select("session_id", "seq", "lane", "turn_no")


@query("w03_turn_rollup", """
SELECT session_id, turn_no, max(total_in) AS peak_input, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, count(DISTINCT skill) AS skills,
  last(model ORDER BY call_no) AS last_model, last(command ORDER BY call_no) FILTER (command <> 'ls') AS last_command,
  count(*) FILTER (failed) AS failed_calls, count(*) AS calls
FROM turn_calls GROUP BY ALL""", "turn_calls")
def w03(t):
    total = X.total_input("input_tokens", "cache_read_tokens", "cache_creation_tokens")
    return t.turn_calls.groupBy("session_id", "turn_no").agg(
        F.max(total).alias("peak_input"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("cache_read_tokens").alias("cache_read_tokens"), F.count_distinct("skill").alias("skills"),
        F.max_by("model", "call_no").alias("last_model"),
        F.max_by("command", F.when(F.col("command") != "ls", F.col("call_no"))).alias("last_command"),
        F.count_if("failed").alias("failed_calls"), F.count(F.lit(1)).alias("calls"))


@query("w04_active_time_by_user", """
SELECT session_id, CAST(sum(CASE WHEN gap > 0 AND gap <= 21600000000 THEN gap ELSE 0 END) AS BIGINT) AS active_us
FROM (SELECT user_id AS session_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)
GROUP BY session_id""")
def w04(t):
    marks = t.raw("events").select(F.col("user_id").alias("session_id"), F.col("ts").alias("at"))
    return K.active_time(marks, ["session_id"], IDLE_MINUTES)


@query("w04_active_time_by_turn", "SELECT * FROM turn_active", "turn_active")
def w04b(t):
    return t.turn_active


@query("w05_boundary_decisions", "SELECT session_id, turn_no, is_new, rule, reason FROM task_turns", "task_turns")
def w05(t):
    return K.boundary_decisions(t.turns, RULES).select("session_id", "turn_no", "is_new", "rule", "reason")


@query("w06_task_numbering", "SELECT session_id, turn_no, task_no, task_id, decision FROM task_turns", "task_turns")
def w06(t):
    return K.number_tasks(K.boundary_decisions(t.turns, RULES)).select("session_id", "turn_no", "task_no", "task_id", "decision")


@query("w07_task_rollup", """
SELECT session_id, task_no, task_id, title, turns, rework_turns, epoch_us(started_at) AS started_us, epoch_us(ended_at) AS ended_us,
  wall_us, active_us, completed, in_progress, tool_calls, agent_turns, has_task_events, 'heuristic' AS source FROM tasks""", "tasks")
def w07(t):
    return t.tasks.select("session_id", "task_no", "task_id", "title", "turns", "rework_turns", us("started_at").alias("started_us"),
                          us("ended_at").alias("ended_us"), "wall_us", "active_us", "completed", "in_progress", "tool_calls",
                          "agent_turns", "has_task_events", "source")


@query("w08_retry_classification", """
WITH s AS (SELECT user_id, event_type = 'error' AS failed, event_type, props, lead(event_type, 1) OVER w AS e1, lead(props, 1) OVER w AS p1,
  lead(event_type, 2) OVER w AS e2, lead(props, 2) OVER w AS p2, lead(event_type, 3) OVER w AS e3, lead(props, 3) OVER w AS p3
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id AS session_id, count(*) FILTER (k = 'identical') AS identical, count(*) FILTER (k = 'different') AS different FROM (
 SELECT user_id, CASE WHEN e1 = event_type THEN CASE WHEN p1 = props THEN 'identical' ELSE 'different' END
   WHEN e2 = event_type THEN CASE WHEN p2 = props THEN 'identical' ELSE 'different' END
   WHEN e3 = event_type THEN CASE WHEN p3 = props THEN 'identical' ELSE 'different' END END AS k
 FROM s WHERE failed) GROUP BY user_id""")
def w08(t):
    calls = t.raw("events").select(F.col("user_id").alias("session_id"), "ts", "event_id", F.col("event_type").alias("name"),
                                   F.col("props").alias("input_json"), (F.col("event_type") == "error").alias("failed"))
    seq = G.next_calls(calls, ["session_id"], ["ts", "event_id"], O.hours("ts"))
    return (seq.filter("failed").withColumn("k", G.retry_kind()).groupBy("session_id")
            .agg(F.count_if(F.col("k") == "identical").alias("identical"), F.count_if(F.col("k") == "different").alias("different")))


@query("w09_closing_verification", """
SELECT session_id, task_no, coalesce(bool_or(idx = lv AND NOT failed AND idx >= n_calls - 2), false) AS closes
FROM (SELECT *, max(CASE WHEN verif THEN idx END) OVER (PARTITION BY session_id, task_no) AS lv FROM task_calls) GROUP BY ALL""", "task_calls")
def w09(t):
    mine = t.turn_calls.join(t.task_turns.select("session_id", "turn_no", "task_no"), ["session_id", "turn_no"])
    facts = G.call_facts(mine, ["session_id", "task_no"], ["turn_no", "call_no"], O.runs("turn_no"))
    return facts.select("session_id", "task_no", G.closes_on_verification().alias("closes"))


@query("f02_non_empty_turns", """
SELECT session_id, turn_no FROM turns t WHERE prompt <> '' OR EXISTS (SELECT 1 FROM turn_calls c WHERE c.session_id = t.session_id AND c.turn_no = t.turn_no)""",
       "turns", "turn_calls")
def f02(t):
    return K.drop_empty_turns(t.turns, t.turn_calls, t.steps).select("session_id", "turn_no")


@query("f03_verification_calls", """
SELECT name, count(*) AS calls, count(*) FILTER (name = 'Bash' AND input_json LIKE '%pytest%') AS verifications FROM calls GROUP BY name""", "calls")
def f03(t):
    return t.calls.groupBy("name").agg(F.count(F.lit(1)).alias("calls"), F.count_if(G.is_verification()).alias("verifications"))


@query("f04_acceptance_cue", r"""
SELECT role, count(*) AS prompts,
  count(*) FILTER (regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])(que|the|der|las?)([^\p{L}\p{N}_]|$)')) AS stand_in,
  count(*) FILTER (regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])(doit|devra|critère|attendu|il faut que|jusqu''à ce que|test|tests? (vert|passe)|vérifie|valide|sans (casser|régression)|renvoie|retourne)([^\p{L}\p{N}_]|$)')) AS cue
FROM conversations GROUP BY role""")
def f04(t):
    return t.raw("conversations").groupBy("role").agg(
        F.count(F.lit(1)).alias("prompts"), F.count_if(G.has_acceptance_cue("text", ACCEPTANCE)).alias("stand_in"),
        F.count_if(G.has_acceptance_cue("text")).alias("cue"))


@query("f05_referential_prompts", r"""
SELECT conv_id, turn,
  regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])(ça|ca|cela|celui|celle|ceux|le même|la même|ce|cette|cet|il|elle|ils|elles|y|en)([^\p{L}\p{N}_]|$)') AS referential,
  regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])(que|le|the|and|der|el)([^\p{L}\p{N}_]|$)') AS stand_in
FROM conversations""")
def f05(t):
    return t.raw("conversations").select("conv_id", "turn", K.is_referential("text").alias("referential"),
                                         K.is_referential("text", RULES).alias("stand_in"))


@query("f07_day_window", """
SELECT session_id, task_no, CAST(started_at AS DATE) AS day FROM tasks
WHERE CAST(started_at AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-21'""", "tasks")
def f07(t):
    day = F.to_date("started_at")
    return t.tasks.filter(day.between("2024-01-08", "2024-01-21")).select("session_id", "task_no", day.alias("day"))


@query("j01_call_results", """
SELECT session_id, call_id, epoch_us(called_at) AS called_us, epoch_us(result_at) AS result_us FROM calls""", "calls")
def j01(t):
    from turnstone.operators.turns import match_results
    e = t.raw("events").select(F.col("user_id").alias("session_id"), "event_id", "ts")
    # every event is a call of its user and, for the call before it, also the result
    calls = e.select("session_id", "ts", "event_id", F.lit(1).alias("side"), F.col("event_id").alias("call_id"))
    results = e.select("session_id", "ts", "event_id", F.lit(0).alias("side"))
    got = match_results(calls.withColumn("called_at", F.col("ts")), results.withColumn("result_at", F.col("ts")),
                        ["session_id"], ["ts", "event_id", "side"], ["result_at"], O.hours("ts"))
    return got.select("session_id", "call_id", us("called_at").alias("called_us"), us("result_at").alias("result_us"))


@query("j02_failure_reasons", """
SELECT failure_reason, count(*) AS calls, round(sum(duration_ms), 3) AS total_ms FROM (
 SELECT CASE WHEN event_id % 6 = 0 AND event_id % 4 = 0 THEN 'is_error' WHEN event_id % 10 = 3 THEN 'interrupted'
   WHEN event_id % 10 = 4 THEN 'success=false' WHEN event_id % 6 = 0 THEN 'code=1' END AS failure_reason,
   CASE WHEN event_id % 3 = 0 THEN value ELSE CAST(epoch_us(result_at) - epoch_us(ts) AS DOUBLE) / 1000 END AS duration_ms
 FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS result_at FROM events)) GROUP BY failure_reason""")
def j02(t):
    from turnstone.operators.turns import classify_result
    c = t.calls.withColumns({
        "block": F.expr("""CASE WHEN call_id % 6 = 0 AND call_id % 4 = 0 THEN '{"is_error":true}' ELSE '{"is_error":false}' END"""),
        "extra": F.concat(
            F.lit('{"interrupted":'), (F.col("call_id") % 10 == 3).cast("string"),
            F.lit(',"success":'), (F.col("call_id") % 10 != 4).cast("string"),
            F.lit(',"code":'), F.when(F.col("failed"), "1").otherwise("0"),
            F.when(F.col("call_id") % 3 == 0, F.concat(F.lit(',"durationMs":'), F.col("value").cast("string"))).otherwise(""),
            F.lit("}"))})
    done = classify_result(c, F.try_parse_json("block"), F.try_parse_json("extra"))
    return done.groupBy("failure_reason").agg(F.count(F.lit(1)).alias("calls"),
                                              F.round(F.sum("duration_ms"), 3).alias("total_ms"))


@query("j03_agent_turn_host", "SELECT session_id, turn_no, task_no FROM agent_turns", "agent_turns")
def j03(t):
    return K.attach_agent_turns(t.turns, t.task_turns).select("session_id", "turn_no", "task_no")


_FACTS = {
    "g01_rework_ratio": "rework_ratio", "g02_prompts_per_task": "prompts_per_task", "g03_first_try_success": "first_try_success",
    "g04_has_acceptance_criteria": "has_acceptance_criteria", "g05_context_pressure": "context_pressure",
    "g06_cache_read_ratio": "cache_read_ratio", "g07_load_precision": "load_precision", "g08_context_isolation": "context_isolation",
    "g09_harness_breadth": "harness_breadth", "g10_skill_usage_rate": "skill_usage_rate", "g11_mcp_utilization": "mcp_utilization",
    "g12_tool_failure_rate": "tool_failure_rate", "g13_verification_present": "verification_present",
    "g14_autonomy_ratio": "autonomy_ratio", "g15_parallelism_index": "parallelism_index", "g16_loop_closure": "loop_closure",
    "g17_plan_structure": "plan_structure", "g18_graph_depth": "graph_depth", "g19_self_correction": "self_correction",
}
for _name, _key in _FACTS.items():
    query(_name, f"SELECT session_id, task_no, round(CAST({_key} AS DOUBLE), 6) AS value FROM signals_wide", "signals_wide")(
        lambda t, k=_key: t.signals_wide.select("session_id", "task_no", r6(k).alias("value")))


@query("g20_signals_long", """
WITH said AS (SELECT session_id, task_no, unnest([
  {'k': 'rework_ratio', 'e': rework_turns || ' follow-up(s) after the first prompt'},
  {'k': 'prompts_per_task', 'e': turns || ' prompt(s) in this task'},
  {'k': 'first_try_success', 'e': CASE WHEN in_progress THEN 'task still open, outcome unknown' WHEN rework_turns = 0 AND completed THEN 'closed without a follow-up' ELSE 'needed at least one follow-up' END},
  {'k': 'has_acceptance_criteria', 'e': CASE WHEN has_acceptance_criteria = 1 THEN 'the first prompt states the expected result' ELSE 'the first prompt does not state when it is done' END},
  {'k': 'context_pressure', 'e': 'largest context read: ' || peak || ' tokens'},
  {'k': 'cache_read_ratio', 'e': cached_tokens || ' of ' || read_tokens || ' read tokens came from the cache'},
  {'k': 'load_precision', 'e': searches || ' search(es) against ' || whole_reads || ' whole-file read(s)'},
  {'k': 'context_isolation', 'e': sidechains || ' turn(s) delegated to an agent'},
  {'k': 'harness_breadth', 'e': tools || ' distinct tool(s)'},
  {'k': 'skill_usage_rate', 'e': skills || ' skill(s) attributed, ' || skill_calls || ' skill call(s)'},
  {'k': 'mcp_utilization', 'e': mcp_calls || ' call(s) to a tool server'},
  {'k': 'tool_failure_rate', 'e': failed_calls || ' failure(s) in ' || calls || ' call(s)'},
  {'k': 'verification_present', 'e': verifications || ' verification command(s)'},
  {'k': 'autonomy_ratio', 'e': calls || ' call(s) for ' || turns || ' human turn(s)'},
  {'k': 'parallelism_index', 'e': parallel_steps || ' of ' || steps || ' step(s) started several tools'},
  {'k': 'loop_closure', 'e': CASE WHEN in_progress THEN 'task still open, closure unknown' WHEN loop_closure = 1 THEN 'ends on a successful verification' ELSE 'ends without a final verification' END},
  {'k': 'plan_structure', 'e': CASE WHEN plan_structure = 1 THEN 'split into explicit tasks' ELSE 'no explicit plan' END},
  {'k': 'graph_depth', 'e': greatest(spawns, agent_turns) || ' agent(s), ' || agent_calls || ' delegated call(s)'},
  {'k': 'self_correction', 'e': different || ' retry(ies) with another input, ' || identical || ' identical'}]) AS u FROM signals_wide)
SELECT s.session_id, s.task_no, s.signal, s.level, round(s.value, 6) AS value, d.u.e AS evidence
FROM signals s JOIN said d ON d.session_id = s.session_id AND d.task_no = s.task_no AND d.u.k = s.signal""", "signals", "signals_wide")
def g20(t):
    return t.signals.select("session_id", "task_no", "signal", "level", r6("value").alias("value"), "evidence")
