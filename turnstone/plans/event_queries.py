"""Queries on the event log and the span tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstone.operators import events as E, ordered as O, usage as U
from turnstone.plans.bridge import IDLE_MINUTES
from turnstone.plans.oracle_base import part
from turnstone.plans.registry import query, r6, us

part("sessions", "calls", "turns")("""
SELECT session_id, min(called_at) AS started_at, max(called_at) AS ended_at, first(event_type ORDER BY call_no) AS entrypoint FROM calls
WHERE session_id IN (SELECT session_id FROM turns) GROUP BY session_id""")
part("windows", "turn_calls", "turns", "sessions")("""
SELECT *, CASE WHEN n = 1 THEN role ELSE role || '#' || n END AS actor FROM (
 SELECT c.session_id, c.turn_no, c.call_no, json_extract_string(input_json, '$.subagent_type') AS r0, c.called_at AS from_at, coalesce(c.result_at, s.ended_at) AS to_at,
  coalesce(json_extract_string(input_json, '$.subagent_type'), 'sous-agent') AS role,
  row_number() OVER (PARTITION BY c.session_id, coalesce(json_extract_string(input_json, '$.subagent_type'), 'sous-agent') ORDER BY c.turn_no, c.call_no) AS n
 FROM turn_calls c JOIN turns t ON t.session_id = c.session_id AND t.turn_no = c.turn_no AND NOT t.is_sidechain JOIN sessions s ON s.session_id = c.session_id WHERE c.name = 'Task')""")
part("actors", "turns", "windows")("""
SELECT t.session_id, t.turn_no, CASE WHEN t.is_sidechain AND k.n > 0 THEN k.actor ELSE 'principal' END AS actor, CASE WHEN t.is_sidechain THEN coalesce(k.n, 0) ELSE 0 END AS candidates
FROM turns t LEFT JOIN (SELECT t.session_id, t.turn_no, count(*) AS n, last(w.actor ORDER BY w.turn_no, w.call_no) AS actor FROM turns t JOIN windows w
  ON w.session_id = t.session_id AND t.started_at BETWEEN w.from_at AND w.to_at WHERE t.is_sidechain GROUP BY ALL) k USING (session_id, turn_no)""")
part("thinks", "turn_calls", "turns")("""
SELECT *, CASE WHEN len > 0 AND len <= 21600000000 THEN at_us + len ELSE at_us + 1000000 END AS end_us FROM (
 SELECT c.session_id, c.turn_no, c.call_no, epoch_us(c.called_at) AS at_us, c.total_in, c.output_tokens, c.model, c.tool_blocks,
  epoch_us(coalesce(lead(c.called_at) OVER (PARTITION BY c.session_id, c.turn_no ORDER BY c.call_no), t.ended_at)) - epoch_us(c.called_at) AS len
 FROM turn_calls c JOIN turns t USING (session_id, turn_no))""")


def sessions(t):
    return t.sessions


def windows(t):
    return t.windows


@query("j04_turn_actors", "SELECT * FROM actors", "actors")
def j04(t):
    return t.actors.select("session_id", "turn_no", "actor", "candidates")


@query("j04_points_in_intervals", """
WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate AS a, o_orderdate + INTERVAL 40 DAY AS b FROM orders)
SELECT p.o_custkey, p.o_orderkey, count(*) AS inside, max(o.o_orderkey) AS latest FROM orders p JOIN o ON o.o_custkey = p.o_custkey AND p.o_orderdate BETWEEN o.a AND o.b GROUP BY ALL""")
def j04b(t):
    from turnstone.operators.intervals import points_in_intervals
    o = t.raw("orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("at"))
    w = o.select("o_custkey", F.col("o_orderkey").alias("w"), F.col("at").alias("a"), F.expr("at + INTERVAL 40 DAYS").alias("b"))
    return (points_in_intervals(o, w, ["o_custkey"], "at", "a", "b", 86_400).groupBy("o_custkey", "o_orderkey")
            .agg(F.count(F.lit(1)).alias("inside"), F.max("w").alias("latest")))


@query("w10_spawn_names", "SELECT session_id, turn_no, call_no, actor, role FROM windows", "windows")
def w10(t):
    return windows(t).select("session_id", "turn_no", "call_no", "actor", "role")


@query("w10_rank_within_type", """
SELECT event_id, CASE WHEN n = 1 THEN event_type ELSE event_type || '#' || n END AS label FROM (
 SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events)""")
def w10b(t):
    e = t.raw("events").select("event_id", "user_id", "event_type", "ts")
    r = O.ordered_scan(e, ["user_id", "event_type"], ["ts", "event_id"], {"n": O.number()}, O.hours("ts"))
    return r.select("event_id", F.when(F.col("n") == 1, F.col("event_type")).otherwise(F.concat("event_type", F.lit("#"), F.col("n").cast("string"))).alias("label"))


@query("w11_think_intervals", "SELECT session_id, turn_no, call_no AS step_no, at_us, end_us FROM thinks", "thinks")
def w11(t):
    return E.think_intervals(t.steps, t.turns, t.turn_calls, IDLE_MINUTES).select(
        "session_id", "turn_no", "step_no", us("at").alias("at_us"), us("ends_at").alias("end_us"))


part("run_log", "sessions", "windows", "actors", "thinks", "turn_calls", "turns")("""
SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY at_us, phase, tn, grp, it, sub) - 1 AS seq,
  greatest(0, CAST(floor((at_us - t0) / 1000) AS BIGINT)) AS t FROM (SELECT e.*, epoch_us(s.started_at) AS t0 FROM (
 SELECT session_id, epoch_us(from_at) AS at_us, 0 AS phase, turn_no AS tn, 0 AS grp, call_no AS it, 0 AS sub, actor, 'agent.spawn' AS kind, 'depth=1;parent=principal;role=' || role AS body FROM windows
 UNION ALL SELECT session_id, epoch_us(to_at), 0, turn_no, 0, call_no, 1, actor, 'agent.end', 'status=completed' FROM windows
 UNION ALL SELECT session_id, epoch_us(started_at), 1, 0, 0, 0, 0, 'principal', 'run.start', 'task=' || session_id || ';title=' || CASE WHEN o.prompt = '' THEN '' ELSE '(contenu non capturé)' END FROM sessions JOIN (SELECT session_id, arg_min(prompt, turn_no) AS prompt FROM turns GROUP BY ALL) o USING (session_id)
 UNION ALL SELECT session_id, epoch_us(started_at), 1, 0, 0, 0, 1, 'principal', 'agent.spawn', 'depth=0;role=principal' FROM sessions
 UNION ALL SELECT t.session_id, epoch_us(t.started_at), 2, t.turn_no, 0, 0, 0, 'humain', 'human', 'text=(contenu non capturé);to=principal' FROM turns t
   JOIN (SELECT session_id, min(turn_no) AS f FROM turns GROUP BY ALL) f ON f.session_id = t.session_id AND t.turn_no > f.f WHERE NOT is_sidechain AND trim(prompt) <> ''
 UNION ALL SELECT k.session_id, at_us, 2, k.turn_no, 1, call_no, 0, actor, 'think.start', 'summary=' || model FROM thinks k JOIN actors USING (session_id, turn_no)
 UNION ALL SELECT k.session_id, end_us, 2, k.turn_no, 1, call_no, 1, actor, 'think.end', CASE WHEN tool_blocks > 1 THEN 'parallele=' || tool_blocks || ';' ELSE '' END || 'summary=' || model FROM thinks k JOIN actors USING (session_id, turn_no)
 UNION ALL SELECT c.session_id, epoch_us(called_at), 2, c.turn_no, 2, call_no, 0, actor, 'tool.start', 'args=' || tgt || ';tool=' || name FROM (SELECT *,
   coalesce(json_extract_string(input_json, '$.file_path'), json_extract_string(input_json, '$.path'), json_extract_string(input_json, '$.command'), json_extract_string(input_json, '$.pattern'), '') AS tgt FROM turn_calls) c JOIN actors USING (session_id, turn_no)
 UNION ALL SELECT c.session_id, CASE WHEN result_at IS NULL THEN epoch_us(called_at) + 1000 ELSE epoch_us(result_at) END, 2, c.turn_no, 2, call_no, 1, actor, 'tool.end',
   'args=' || tgt || ';ms=' || CAST(floor(coalesce(duration_ms, 1)) AS BIGINT) || ';ok=' || (NOT failed) || CASE WHEN failed THEN ';out=(contenu non capturé)' ELSE '' END || ';tool=' || name FROM (SELECT *,
   coalesce(json_extract_string(input_json, '$.file_path'), json_extract_string(input_json, '$.path'), json_extract_string(input_json, '$.command'), json_extract_string(input_json, '$.pattern'), '') AS tgt FROM turn_calls) c JOIN actors USING (session_id, turn_no)
 UNION ALL SELECT session_id, epoch_us(ended_at), 3, 0, 0, 0, 0, 'principal', 'agent.end', 'status=completed' FROM sessions
 UNION ALL SELECT session_id, epoch_us(ended_at), 3, 0, 0, 0, 1, 'principal', 'run.end', 'calls=' || n || ';eur=0.0;human_interventions=' || h || ';status=completed;tok_in_total=' || ti || ';tok_out_total=' || tout || ';wall_clock_ms='
   || CAST(floor((epoch_us(ended_at) - epoch_us(started_at)) / 1000) AS BIGINT) FROM sessions JOIN (SELECT session_id, count(*) AS n, CAST(sum(total_in) AS BIGINT) AS ti, CAST(sum(output_tokens) AS BIGINT) AS tout FROM turn_calls GROUP BY ALL) USING (session_id)
   JOIN (SELECT session_id, count(*) FILTER (turn_no > f AND NOT is_sidechain AND trim(prompt) <> '') AS h FROM (SELECT *, min(turn_no) OVER (PARTITION BY session_id) AS f FROM turns) GROUP BY ALL) USING (session_id)
) e JOIN sessions s USING (session_id))""")


def log(t):
    return t.run_log


@query("r07_run_events", "SELECT session_id, seq, t, actor, kind, body FROM run_log", "run_log")
def r07(t):
    body = F.array_join(F.transform(F.array_sort(F.map_entries("payload")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return log(t).select("session_id", "seq", "t", "actor", "kind", body.alias("body"))


@query("w12_event_sequence", "SELECT session_id, count(*) AS events, max(seq) AS last_seq, max(t) AS last_t FROM run_log GROUP BY session_id", "run_log")
def w12(t):
    return log(t).groupBy("session_id").agg(F.count(F.lit(1)).alias("events"), F.max("seq").alias("last_seq"), F.max("t").alias("last_t"))


@query("r07_run_agents", """
SELECT session_id, actor AS agent, role, 1 AS depth FROM windows UNION ALL SELECT session_id, 'principal', 'principal', 0 FROM sessions UNION ALL SELECT session_id, 'humain', 'humain', -1 FROM sessions""", "windows", "sessions")
def r07b(t):
    return E.run_agents(windows(t), t.sessions)


_SID = "substring(sha256({}), 1, 16)"
part("span_rows", "sessions", "tasks", "owners", "turns", "turn_calls")(f"""
SELECT {_SID.format("'session|' || session_id")} AS span_id, CAST(NULL AS VARCHAR) AS parent_span_id, 'session' AS name, 'AGENT' AS kind, epoch_us(started_at) AS start_us, epoch_us(ended_at) AS end_us, CAST(NULL AS VARCHAR) AS outcome FROM sessions
UNION ALL SELECT {_SID.format("'task|' || session_id || '|' || task_no")}, {_SID.format("'session|' || session_id")}, 'task', 'CHAIN', epoch_us(started_at), greatest(epoch_us(ended_at), epoch_us(started_at)),
  CASE WHEN in_progress THEN 'in_progress' WHEN completed THEN 'completed' ELSE 'open' END FROM tasks
UNION ALL SELECT {_SID.format("'turn|' || t.session_id || '|' || t.turn_no")}, {_SID.format("'task|' || o.session_id || '|' || o.task_no")}, 'turn', CASE WHEN is_sidechain THEN 'AGENT' ELSE 'CHAIN' END, epoch_us(started_at), greatest(epoch_us(ended_at), epoch_us(started_at)),
  CASE WHEN stop_reason = 'end_turn' THEN 'completed' ELSE 'interrupted' END FROM turns t JOIN owners o USING (session_id, turn_no)
UNION ALL SELECT {_SID.format("'tool|' || c.session_id || '|' || call_no")}, {_SID.format("'turn|' || c.session_id || '|' || c.turn_no")}, 'tool.' || name, 'TOOL', epoch_us(called_at), coalesce(epoch_us(result_at), epoch_us(called_at)),
  CASE WHEN failed THEN 'failed' ELSE 'ok' END FROM turn_calls c JOIN owners o USING (session_id, turn_no)""")


def span_tree(t):
    return E.spans(t.sessions, t.tasks, U.all_turns(t.task_turns, t.agent_turns), t.turns, t.turn_calls, t.steps, t.signals_wide)


@query("r08_span_tree", "SELECT * FROM span_rows", "span_rows")
def r08(t):
    return span_tree(t).select("span_id", "parent_span_id", "name", "kind", us("start_at").alias("start_us"), us("end_at").alias("end_us"),
                               F.try_element_at("attributes", F.lit("coaching.outcome")).alias("outcome"))


@query("s16_span_export", "SELECT name, kind, count(*) AS spans, count(DISTINCT span_id) AS ids FROM span_rows GROUP BY ALL", "span_rows")
def s16(t):
    from turnstone.session import stored
    back = stored(span_tree(t), "spans")
    return back.groupBy("name", "kind").agg(F.count(F.lit(1)).alias("spans"), F.count_distinct("span_id").alias("ids"))


@query("s15_signal_annotations", """
SELECT substring(sha256('task|' || session_id || '|' || task_no), 1, 16) AS span_id, signal AS identifier, round(CASE WHEN signal = 'rework_ratio' THEN 9.0 ELSE value END, 6) AS score, CAST(level AS VARCHAR) AS level FROM signals""", "signals")
def s15(t):
    a = E.annotations(t.signals)
    newer = a.filter("identifier = 'rework_ratio'").withColumn("score", F.lit(9.0))
    done = E.upsert(a, newer, ["span_id", "identifier"])
    return done.select("span_id", "identifier", r6("score").alias("score"), F.try_element_at("metadata", F.lit("level")).alias("level"))


@query("a24_run_totals", """
SELECT s.session_id, h AS human_interventions, n AS calls, ti AS tok_in, tout AS tok_out, round_even(ti / 1e6 * 3 + tout / 1e6 * 15, 4) AS eur, CAST(floor((epoch_us(ended_at) - epoch_us(started_at)) / 1000) AS BIGINT) AS wall_clock_ms
FROM sessions s JOIN (SELECT session_id, count(*) AS n, CAST(sum(total_in) AS BIGINT) AS ti, CAST(sum(output_tokens) AS BIGINT) AS tout FROM turn_calls GROUP BY ALL) USING (session_id)
JOIN (SELECT session_id, count(*) FILTER (turn_no > f AND NOT is_sidechain) AS h FROM (SELECT *, min(turn_no) OVER (PARTITION BY session_id) AS f FROM turns) GROUP BY ALL) USING (session_id)""", "sessions", "turn_calls", "turns")
def a24(t):
    r = E.run_totals(t.sessions, t.turns, t.steps, 3.0, 15.0)
    return r.select("session_id", "human_interventions", "calls", "tok_in", "tok_out", "eur", "wall_clock_ms")


@query("a25_ingest_counts", """
SELECT (SELECT count(DISTINCT session_id) FROM tasks) AS sessions, (SELECT count(*) FROM tasks) AS tasks, (SELECT count(*) FROM owners) AS turns,
 (SELECT count(*) FROM turn_calls JOIN owners USING (session_id, turn_no)) AS tool_calls, (SELECT count(*) FROM signals) AS signals""", "tasks", "owners", "turn_calls", "signals")
def a25(t):
    return E.ingest_counts(t.tasks, U.all_turns(t.task_turns, t.agent_turns), t.turn_calls, t.signals)


@query("a27_session_lines", """
SELECT session_id, CAST(round((epoch_us(ended_at) - epoch_us(started_at)) / 60000000.0) AS BIGINT) AS minutes, u.n AS turns, c.n AS tools, coalesce(k.n, 0) AS tasks FROM sessions
JOIN (SELECT session_id, count(*) AS n FROM turns GROUP BY ALL) u USING (session_id) JOIN (SELECT session_id, count(*) AS n FROM turn_calls GROUP BY ALL) c USING (session_id)
LEFT JOIN (SELECT session_id, count(*) AS n FROM tasks GROUP BY ALL) k USING (session_id)""", "sessions", "turns", "turn_calls", "tasks")
def a27(t):
    return E.session_lines(t.sessions, t.turns, t.turn_calls, t.tasks).drop("started_at")


@query("a28_last_turn_usage", """
SELECT session_id, turn_no, last(model ORDER BY call_no) AS model, max(total_in) AS prompt_tokens, CAST(sum(output_tokens) AS BIGINT) AS completion_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens FROM turn_calls GROUP BY ALL""", "turn_calls")
def a28(t):
    return E.last_turn_usage(t.steps)
