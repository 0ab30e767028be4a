"""Streaming queries: the event table read as a stream of hook events (ST01-ST12)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from turnstone.plans.oracle_base import part
from turnstone.plans.registry import query, us
from turnstone.session import shared_dir
from turnstone.streaming import live as S

WATERMARK_US = 600_000_000

part("hooks")("""
SELECT event_id, ts, CAST(user_id AS VARCHAR) AS session_id, user_id || '-' || day(ts) AS prompt_id, event_type AS tool_name, value AS ms, CASE event_id % 12 WHEN 0 THEN 'SessionStart' WHEN 1 THEN 'UserPromptSubmit' WHEN 2 THEN 'Stop'
 WHEN 3 THEN 'PostToolUse' WHEN 4 THEN 'PostToolUse' WHEN 5 THEN 'PostToolUse' WHEN 6 THEN 'PostToolUseFailure' WHEN 7 THEN 'SubagentStart' WHEN 8 THEN 'SubagentStop' WHEN 9 THEN 'PreCompact' WHEN 10 THEN 'SessionEnd' END AS hook
FROM events WHERE event_id % 12 <> 11""")


def event_stream(t):
    raw = t.spark.read.parquet(f"{t.dir}/events.parquet").schema
    e = S.read_events(t.spark, t.dir, raw, "events.parquet")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def hook_rows(e):
    segment = F.expr("""CASE event_id % 12 WHEN 0 THEN 'session-start' WHEN 1 THEN 'user-prompt' WHEN 2 THEN 'Stop' WHEN 3 THEN 'post-tool' WHEN 4 THEN 'post-tool' WHEN 5 THEN 'post-tool'
      WHEN 6 THEN 'post-tool-fail' WHEN 7 THEN 'subagent-start' WHEN 8 THEN 'subagent-stop' WHEN 9 THEN 'pre-compact' WHEN 10 THEN 'session-end' ELSE 'nobody' END""")
    return e.select(
        "ts", "event_id", segment.alias("url_segment"), F.lit("").alias("hook_event_name"), F.col("user_id").cast("string").alias("session_id"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.dayofmonth("ts").cast("string")).alias("prompt_id"), F.col("event_type").alias("tool_name"),
        F.col("event_id").cast("string").alias("tool_use_id"), F.col("value").alias("tool_execution_time_ms"), F.concat_ws("-a", F.col("user_id").cast("string"), (F.col("event_id") % 3).cast("string")).alias("agent_id"),
        F.col("event_type").alias("agent_type"))


def hook_stream(t):
    return S.canonical(hook_rows(event_stream(t)))


@query("st01_typed_hooks", "SELECT hook, count(*) AS n FROM hooks GROUP BY hook", "hooks")
def st01(t):
    body = F.to_json(F.struct("ts", "url_segment", "session_id", "prompt_id", "tool_name", "tool_execution_time_ms"))
    lines = hook_rows(event_stream(t)).select(F.when(F.col("event_id") % 12 == 11, F.lit("{broken")).otherwise(body).alias("value"))
    typed = S.canonical(S.parse_hooks(lines)).select("hook", "session_id", "ts")
    return S.drain(typed, "st01").groupBy("hook").agg(F.count(F.lit(1)).alias("n"))


@query("st05_tool_spans", """
SELECT session_id, 'tool.' || tool_name AS name, epoch_us(ts) - CAST(trunc(ms * 1000) AS BIGINT) AS start_us, epoch_us(ts) AS end_us, CASE hook WHEN 'PostToolUse' THEN 'ok' ELSE 'failed' END AS outcome FROM hooks WHERE hook LIKE 'PostToolUse%'""", "hooks")
def st05(t):
    out = S.drain(S.tool_spans(hook_stream(t)), "st05")
    return out.select("session_id", "name", us("start_at").alias("start_us"), us("end_at").alias("end_us"), "outcome")


@query("st06_markers", "SELECT session_id, epoch_us(ts) AS ts_us, 'context.compact' AS name, 'CHAIN' AS kind, 2 AS level, 'compaction_mode' AS signal FROM hooks WHERE hook = 'PreCompact'", "hooks")
def st06(t):
    return S.drain(S.markers(hook_stream(t)), "st06").select("session_id", us("ts").alias("ts_us"), "name", "kind", "level", "signal")


@query("st07_idle_sessions", f"""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT user_id AS session_id, count(*) AS events, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM s GROUP BY user_id, island
HAVING epoch_us(max(ts)) + 21600000000 <= (SELECT epoch_us(max(ts)) FROM events) - {WATERMARK_US}""")
def st07(t):
    out = S.drain(S.idle_sessions(event_stream(t).withColumnRenamed("user_id", "session_id")), "st07")
    return out.select("session_id", "events", us("first_at").alias("first_us"), us("last_at").alias("last_us"))


@query("st12_tumbling_counts", f"""
SELECT epoch_us(date_trunc('hour', ts)) AS start_us, hook, count(*) AS n FROM hooks GROUP BY 1, 2 HAVING epoch_us(date_trunc('hour', any_value(ts))) + 3600000000 <= (SELECT epoch_us(max(ts)) FROM hooks) - {WATERMARK_US}""", "hooks")
def st12(t):
    return S.drain(S.hook_counts(hook_stream(t)), "st12").select(us("start_at").alias("start_us"), "hook", "n")


@query("st12_sliding_failure_rate", f"""
WITH w AS (SELECT hook, 21600000000 * (CAST(floor(epoch_us(ts) / 21600000000) AS BIGINT) - k) AS start_us FROM hooks, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE hook LIKE 'PostToolUse%')
SELECT start_us, count(*) AS calls, count(*) FILTER (hook = 'PostToolUseFailure') AS failures FROM w GROUP BY start_us
HAVING start_us + 86400000000 <= (SELECT epoch_us(max(ts)) FROM hooks WHERE hook LIKE 'PostToolUse%') - {WATERMARK_US}""", "hooks")
def st12b(t):
    return S.drain(S.failure_rate(hook_stream(t)), "st12b").select(us("start_at").alias("start_us"), "calls", "failures")


@query("st08_last_turn_usage", """
SELECT CAST(user_id AS VARCHAR) AS session_id, user_id || '-' || day(ts) AS prompt_id, arg_max(CASE event_id % 4 WHEN 0 THEN 'x-opus' ELSE 'other' END, (ts, event_id)) AS model, max(v + (event_id % 3) * v) AS prompt_tokens,
 CAST(sum(event_id % 50) AS BIGINT) AS completion_tokens, CAST(sum(event_id % 3 * v) AS BIGINT) AS cache_read_tokens FROM (SELECT *, CAST(floor(value) AS BIGINT) AS v FROM events) WHERE event_id % 10 <> 7 GROUP BY ALL""")
def st08(t):
    S.use_rocksdb(t.spark)
    v = F.floor("value").cast("bigint")
    e = event_stream(t).select(
        "ts", F.col("event_id").alias("step_no"), F.col("user_id").cast("string").alias("session_id"),
        F.when(F.col("event_id") % 10 != 7, F.concat_ws("-", F.col("user_id").cast("string"), F.dayofmonth("ts").cast("string"))).alias("prompt_id"),
        F.when(F.col("event_id") % 4 == 0, "x-opus").otherwise("other").alias("model"), v.alias("input_tokens"), (F.col("event_id") % 3 * v).alias("cache_read_tokens"),
        F.lit(0).cast("bigint").alias("cache_creation_tokens"), (F.col("event_id") % 50).alias("output_tokens"))
    return S.drain_updates(S.last_turns(e, keep_hours=24), "st08", ["session_id", "prompt_id"])


def paired(t):
    """The hook stream with usage rows of the session log merged in."""
    e = event_stream(t)
    none = F.lit(None)
    h = S.canonical(hook_rows(e)).select(
        "ts", (F.col("event_id") * 2 + 1).alias("tie"), "hook", "session_id", "prompt_id", "tool_name", "tool_use_id", "tool_execution_time_ms", "agent_id", "agent_type", none.cast("string").alias("model"),
        none.cast("bigint").alias("total_in"), none.cast("bigint").alias("output_tokens"), none.cast("bigint").alias("cache_read_tokens"))
    u = e.filter("event_id % 12 = 2 OR event_id % 12 = 3").select(
        "ts", (F.col("event_id") * 2).alias("tie"), F.lit("usage").alias("hook"), F.col("user_id").cast("string").alias("session_id"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.dayofmonth("ts").cast("string")).alias("prompt_id"), none.cast("string").alias("tool_name"), none.cast("string").alias("tool_use_id"),
        none.cast("double").alias("tool_execution_time_ms"), none.cast("string").alias("agent_id"), none.cast("string").alias("agent_type"), F.concat(F.lit("m"), (F.col("event_id") % 4).cast("string")).alias("model"),
        F.floor("value").cast("bigint").alias("total_in"), (F.col("event_id") % 50).alias("output_tokens"), (F.col("event_id") % 7).alias("cache_read_tokens"))
    return h.unionByName(u)


def paired_spans(t):
    if not hasattr(t, "_spans"):
        S.use_rocksdb(t.spark)
        t._spans = S.drain(S.pair_spans(paired(t)), "st02")
    return t._spans


# The state machine once more as SQL: a step per event of each session, over lists of open spans.
def _with(span: str, **fields: str) -> str:
    names = ["key", "scope", "id", "name", "parent", "opened", "seen", "reason", "model", "peak", "produced", "cached"]
    return "{" + ", ".join(f"'{n}': {fields.get(n, f'{span}.{n}')}" for n in names) + "}"


def _new(key: str, scope: str, ident: str, name: str, parent: str, reason: str = "NULL::VARCHAR") -> str:
    return _with("", key=key, scope=scope, id=ident, name=name, parent=parent, opened="us", seen="us", reason=reason, model="NULL::VARCHAR", peak="0::BIGINT", produced="0::BIGINT", cached="0::BIGINT")


def _closed(span: str, start: str, end: str, outcome: str, usage: bool = False, **fields: str) -> str:
    cells = {n: fields.get(n, f"{span}.{n}") for n in ("scope", "id", "name", "parent")}
    cells |= {"start_us": start, "end_us": end, "outcome": outcome, "reason": fields.get("reason", f"{span}.reason")}
    cells |= {"model": f"{span}.model" if usage else "NULL::VARCHAR", "prompt_tokens": f"{span}.peak" if usage else "NULL::BIGINT",
              "completion_tokens": f"{span}.produced" if usage else "NULL::BIGINT", "cache_read_tokens": f"{span}.cached" if usage else "NULL::BIGINT"}
    return "{" + ", ".join(f"'{k}': {v}" for k, v in cells.items()) + "}"


OPEN_TYPE = "STRUCT(key VARCHAR, scope VARCHAR, id VARCHAR, name VARCHAR, parent VARCHAR, opened BIGINT, seen BIGINT, reason VARCHAR, model VARCHAR, peak BIGINT, produced BIGINT, cached BIGINT)[]"
DONE_TYPE = ("STRUCT(scope VARCHAR, id VARCHAR, name VARCHAR, parent VARCHAR, start_us BIGINT, end_us BIGINT, outcome VARCHAR, reason VARCHAR, model VARCHAR, "
             "prompt_tokens BIGINT, completion_tokens BIGINT, cache_read_tokens BIGINT)[]")
IDLE_US = 6 * 3600 * 1_000_000
_ROOT, _TURN, _AGENT = "'session:' || session_id", "'prompt:' || prompt_id", "'agent:' || agent_id"
_USES = "(hook IN ('PostToolUse', 'PostToolUseFailure', 'SubagentStart', 'PreCompact'))"

part("feed", "hooks")("""
SELECT session_id, epoch_us(ts) AS us, event_id * 2 + 1 AS tie, hook, prompt_id, tool_name, event_id || '' AS tool_use_id, ms, session_id || '-a' || (event_id % 3) AS agent_id, CAST(NULL AS VARCHAR) AS model,
 CAST(NULL AS BIGINT) AS total_in, CAST(NULL AS BIGINT) AS produced, CAST(NULL AS BIGINT) AS cached FROM hooks
UNION ALL
SELECT session_id, epoch_us(ts), event_id * 2, 'usage', prompt_id, NULL, NULL, NULL, NULL, 'm' || (event_id % 4), CAST(floor(ms) AS BIGINT), event_id % 50, event_id % 7 FROM hooks WHERE event_id % 12 IN (2, 3)""")

# only what the last watermark has passed is final
part("final_us", "feed")(f"SELECT (max(us) // 1000) * 1000 - {WATERMARK_US} AS w FROM feed")

part("due", "feed", "final_us")("SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY us, tie) AS i FROM feed WHERE us < (SELECT w FROM final_us)")

part("runs", "due")(f"""
WITH RECURSIVE steps AS (
 SELECT DISTINCT session_id, 0::BIGINT AS i, []::{OPEN_TYPE} AS open, []::{DONE_TYPE} AS done FROM due
 UNION ALL
 SELECT session_id, i, CAST(CASE hook
   WHEN 'SessionStart' THEN list_append(left_open, {_new(_ROOT, "'session'", "session_id", "'session'", "NULL::VARCHAR", "'start'")})
   WHEN 'UserPromptSubmit' THEN list_append(left_open, {_new(_TURN, "'prompt'", "prompt_id", "'turn'", "parent")})
   WHEN 'SubagentStart' THEN list_append(left_open, {_new(_AGENT, "'agent'", "agent_id", "'agent.' || tool_name", "parent")})
   WHEN 'usage' THEN list_transform(left_open, lambda x: CASE WHEN x.key = {_TURN} THEN {_with("x", model="f.model", peak="greatest(x.peak, f.total_in)", produced="x.produced + f.produced", cached="x.cached + f.cached")} ELSE x END)
   ELSE left_open END AS {OPEN_TYPE}),
  CAST(list_concat(list_concat(gone, list_transform(closing, lambda x: {_closed("x", "x.opened", "greatest(us, x.opened)", "how")})),
   list_concat(list_transform(list_filter(closing, lambda x: hook = 'Stop' AND x.model IS NOT NULL), lambda x: {_closed("x", "us", "us", "'ok'", True, scope="'llm'", name="'llm'", parent="x.key")}),
    CASE WHEN hook LIKE 'PostToolUse%' THEN [{_closed("", "us - CAST(trunc(greatest(0, ms) * 1000) AS BIGINT)", "us", "CASE hook WHEN 'PostToolUse' THEN 'ok' ELSE 'failed' END", scope="'tool'", id="tool_use_id", name="'tool.' || tool_name", parent="parent", reason="NULL::VARCHAR")}]
     WHEN hook = 'PreCompact' THEN [{_closed("", "us", "us", "'ok'", scope="'marker'", id="tool_use_id", name="'context.compact'", parent="parent", reason="NULL::VARCHAR")}] ELSE [] END)) AS {DONE_TYPE})
 FROM (
  SELECT *, list_filter(touched, lambda x: x.key = closes) AS closing, list_filter(touched, lambda x: x.key IS DISTINCT FROM closes) AS left_open FROM (
   SELECT *, CASE WHEN fresh THEN list_append(alive, {_new(_ROOT, "'session'", "session_id", "'session'", "NULL::VARCHAR", "'recovered'")})
      ELSE list_transform(alive, lambda x: CASE WHEN x.key = touches THEN {_with("x", seen="us")} ELSE x END) END AS touched FROM (
    SELECT *, CASE WHEN in_turn THEN {_TURN} WHEN needs_root THEN {_ROOT} END AS parent,
      CASE WHEN in_turn THEN {_TURN} WHEN needs_root AND has_root THEN {_ROOT} END AS touches, needs_root AND NOT has_root AS fresh,
      CASE WHEN hook IN ('SessionStart', 'SessionEnd') THEN {_ROOT} WHEN hook IN ('UserPromptSubmit', 'Stop') THEN {_TURN} WHEN hook IN ('SubagentStart', 'SubagentStop') THEN {_AGENT} END AS closes,
      CASE hook WHEN 'Stop' THEN 'completed' WHEN 'SessionEnd' THEN 'ended' WHEN 'SubagentStop' THEN 'ended' ELSE 'superseded' END AS how FROM (
     SELECT *, in_turn_open AND {_USES} AS in_turn, hook = 'UserPromptSubmit' OR ({_USES} AND NOT in_turn_open) AS needs_root FROM (
      SELECT *, len(list_filter(alive, lambda x: x.key = {_ROOT})) > 0 AS has_root, len(list_filter(alive, lambda x: x.key = {_TURN})) > 0 AS in_turn_open FROM (
       SELECT e.*, list_filter(s.open, lambda x: x.seen + {IDLE_US} > e.us) AS alive,
         list_transform(list_filter(s.open, lambda x: x.seen + {IDLE_US} <= e.us), lambda x: {_closed("x", "x.opened", f"greatest(x.seen + {IDLE_US}, x.opened)", "'abandoned'")}) AS gone
       FROM steps s JOIN due e ON e.session_id = s.session_id AND e.i = s.i + 1)))))) f)
SELECT * FROM steps""")

part("spans", "runs", "final_us")(f"""
SELECT session_id, unnest(done, recursive := true) FROM runs
UNION ALL
SELECT session_id, unnest(list_transform(list_filter(open, lambda x: x.seen + {IDLE_US} < w), lambda x: {_closed("x", "x.opened", f"greatest(x.seen + {IDLE_US}, x.opened)", "'abandoned'")}), recursive := true)
FROM (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY i DESC) = 1), final_us""")


@query("st02_paired_spans", "SELECT * FROM spans", "spans")
def st02(t):
    return paired_spans(t)


@query("st03_superseded_spans", "SELECT * FROM spans WHERE outcome = 'superseded'", "spans")
def st03(t):
    return paired_spans(t).filter("outcome = 'superseded'")


@query("st04_recovered_sessions", "SELECT * FROM spans WHERE reason = 'recovered'", "spans")
def st04(t):
    return paired_spans(t).filter("reason = 'recovered'")


@query("st07_abandoned_spans", "SELECT * FROM spans WHERE outcome = 'abandoned'", "spans")
def st07b(t):
    return paired_spans(t).filter("outcome = 'abandoned'")


@query("st09_model_child_rows", "SELECT * FROM spans WHERE name = 'llm'", "spans")
def st09(t):
    return paired_spans(t).filter("name = 'llm'")


@query("st05_tool_spans_with_parent", "SELECT session_id, id, name, parent, start_us, end_us, outcome FROM spans WHERE scope = 'tool'", "spans")
def st05b(t):
    return paired_spans(t).filter("scope = 'tool'").select("session_id", "id", "name", "parent", "start_us", "end_us", "outcome")


# one receiver fails on the first try of every batch, the other one always
@query("st11_deliver_once", "SELECT count(DISTINCT user_id || event_type || CAST(ts AS DATE)) AS sent, count(DISTINCT user_id || event_type || CAST(ts AS DATE)) AS abandoned, TRUE AS same_rows FROM events")
def st11(t):
    base = f"{shared_dir(t.spark)}/st11-{uuid.uuid4().hex}"
    e = event_stream(t).select("ts", F.concat("user_id", "event_type", F.to_date("ts").cast("string")).alias("identifier"))
    failed = set()

    def send(batch, batch_id):
        if batch_id not in failed:
            failed.add(batch_id)
            raise ConnectionError("receiver away")
        batch.write.mode("overwrite").parquet(f"{base}/sent/batch_id={batch_id}")

    def refuse(batch, batch_id):
        raise ConnectionError("no receiver")

    S.deliver(e, send, f"{base}/abandoned", watermark="31 days").awaitTermination()
    S.deliver(e, refuse, f"{base}/refused", watermark="31 days").awaitTermination()
    sent, refused = t.spark.read.parquet(f"{base}/sent"), S.abandoned_rows(t.spark, f"{base}/refused", e.schema).filter("reason LIKE '%no receiver'")
    both = sent.select("identifier", F.lit(1).alias("s"), F.lit(0).alias("a")).unionByName(refused.select("identifier", F.lit(0).alias("s"), F.lit(1).alias("a")))
    each = both.groupBy("identifier").agg(F.sum("s").alias("s"), F.sum("a").alias("a"))
    return each.agg(F.sum("s").alias("sent"), F.sum("a").alias("abandoned"), F.coalesce(F.bool_and(F.expr("s = 1 AND a = 1")), F.lit(True)).alias("same_rows"))
