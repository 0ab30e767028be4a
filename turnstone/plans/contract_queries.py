"""Queries on run contracts, task evaluation and format probes."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from turnstone.functions import exprs as X
from turnstone.operators import contract as Q, retrieval as I, transcript as TR
from turnstone.plans.oracle_base import part
from turnstone.plans.registry import query, r6
from turnstone.session import stored

SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["id", "total", "lines"],
    "properties": {
        "id": {"type": "integer", "minimum": 1}, "total": {"type": "number", "minimum": 1000, "maximum": 300000},
        "status": {"type": "string", "enum": ["F", "O"]}, "note": {"type": ["string", "null"], "minLength": 6},
        "lines": {"type": "array", "items": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "maximum": 4}}}},
    },
}


@query("v18_contract_violations", """
SELECT o_orderkey, array_to_string(list_sort(list_filter([
  CASE WHEN o_orderkey < 1 THEN '$.id: minimum' END, CASE WHEN o_orderkey % 7 = 3 THEN '$.total: type number' WHEN o_totalprice < 1000 THEN '$.total: minimum' WHEN o_totalprice > 300000 THEN '$.total: maximum' END,
  CASE WHEN o_orderstatus = 'P' THEN '$.status: enum' END, CASE WHEN o_orderkey % 5 <> 0 AND length(o_orderpriority) < 6 THEN '$.note: minLength' END, CASE WHEN o_orderkey % 6 = 2 THEN '$: required lines' END,
  CASE WHEN o_orderkey % 4 = 1 THEN '$: unknown extra' END, CASE WHEN o_orderkey % 6 <> 2 AND o_custkey % 6 > 4 THEN '$.lines[0].n: maximum' END, CASE WHEN o_orderkey % 6 <> 2 AND o_orderkey % 3 = 1 THEN '$.lines[1]: required n' END],
  lambda x: x IS NOT NULL)), ';') AS faults FROM orders""")
def v18(t):
    doc = F.expr("""concat('{"id":', o_orderkey, ',"total":', CASE WHEN o_orderkey % 7 = 3 THEN '"n/a"' ELSE CAST(o_totalprice AS STRING) END, ',"status":"', o_orderstatus, '","note":',
      CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE concat('"', o_orderpriority, '"') END, CASE WHEN o_orderkey % 6 = 2 THEN '' ELSE concat(',"lines":[{"n":', o_custkey % 6, '},', CASE WHEN o_orderkey % 3 = 1 THEN '{}' ELSE '{"n":1}' END, ']') END,
      CASE WHEN o_orderkey % 4 = 1 THEN ',"extra":1' ELSE '' END, '}')""")
    faults = Q.violations(F.try_parse_json(doc), SCHEMA)
    return t.raw("orders").select("o_orderkey", F.array_join(F.array_sort(faults), ";").alias("faults"))


@query("v18_event_props_contract", "SELECT event_type, count(*) AS n, count(*) FILTER (CAST(json_extract_string(props, '$.k') AS INT) > 90) AS too_large FROM events GROUP BY event_type")
def v18b(t):
    schema = {"type": "object", "required": ["k"], "additionalProperties": False, "properties": {"k": {"type": "integer", "minimum": 0, "maximum": 90}}}
    e = t.raw("events").select("event_type", Q.violations(F.try_parse_json("props"), schema).alias("faults"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("faults") > 0).alias("too_large"))


# ----------------------------------------------------------------- tasks as runs
part("runs", "signals_wide")("""
SELECT task_id, session_id, task_no, CASE WHEN completed THEN 'completed' ELSE 'failed' END AS status, first_prompt AS output_text, 'agent' || session_id % 3 AS agent, 'p' || session_id % 2 AS principal,
 calls AS cost_calls, read_tokens AS tokens_in, rework_turns AS human_interventions FROM signals_wide WHERE session_id % 9 <> 4""")
part("run_calls", "task_calls")("""
SELECT session_id || '#' || task_no AS task_id, idx - 1 AS i, name AS tool, NOT failed AS call_ok, CASE WHEN call_id % 2 = 0 THEN 'k' || call_id END AS idempotency_key, input_json, call_id, session_id FROM task_calls WHERE session_id % 9 <> 4""")


#: a passage of 40 characters from anywhere in the answer, chosen by the call; every 23rd one is in capitals
FRAGMENT = ("CASE WHEN call_id % 23 = 0 THEN upper(substring(output_text, CAST(1 + call_id * 7919 % greatest(length(output_text), 1) AS INT), 40)) "
            "ELSE substring(output_text, CAST(1 + call_id * 7919 % greatest(length(output_text), 1) AS INT), 40) END")

CONTRACT = {
    "type": "object", "additionalProperties": False,
    "required": ["task_id", "status", "agent", "principal", "allowed_tools", "tool_calls", "output", "provenance", "cost", "quota", "human_interventions"],
    "properties": {
        "task_id": {"type": "string", "minLength": 3}, "status": {"type": "string", "enum": ["completed", "failed"]}, "agent": {"type": "string"}, "principal": {"type": "string"},
        "allowed_tools": {"type": "array", "items": {"type": "string"}},
        "tool_calls": {"type": "array", "items": {"type": "object", "required": ["tool", "ok", "input", "output"],
                                                  "properties": {"tool": {"type": "string"}, "ok": {"type": "boolean"}, "idempotency_key": {"type": ["string", "null"]}, "input": {"type": "object"}, "output": {"type": "object"}}}},
        "output": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string"}}},
        "provenance": {"type": "array", "items": {"type": "object", "required": ["source", "fragment"], "properties": {"fragment": {"type": "string"}}}},
        "cost": {"type": "object", "required": ["calls", "tokens_in"], "properties": {"calls": {"type": "integer", "minimum": 0}, "tokens_in": {"type": "integer", "minimum": 0}}},
        "quota": {"type": "object"}, "human_interventions": {"type": "integer", "minimum": 0},
    },
}


class Runs:
    """Contract rows derived from the session tables."""

    def __init__(self, t):
        w = t.signals_wide
        self.golden = w.select(
            "task_id", "session_id", F.lit("completed").alias("expected_status"), X.const(["Read"]).alias("required"), X.const(["Skill"]).alias("forbidden"), X.const(["Grep", "Edit"]).alias("any_of"),
            (4 + F.col("task_no") % 4).alias("max_calls"), X.const(["e"]).alias("must_contain"), X.const(["zzz", "the "]).alias("must_not_contain"), X.const(["que", "and"]).alias("must_contain_any"), F.lit(True).alias("no_euro_amount"),
            (F.col("task_no") % 2 == 0).alias("provenance_required"), F.lit(6).alias("min_entries"), X.const(["doc-1"]).alias("must_cite"), F.lit(2).alias("side_max"), F.when(F.col("task_no") % 3 == 0, 1).alias("side_exactly"),
            (F.col("session_id") % 5 != 0).alias("answerable"))
        has_run = F.col("session_id") % 9 != 4
        self.runs = w.filter(has_run).select(
            "task_id", F.when(F.col("completed"), "completed").otherwise("failed").alias("status"), F.col("first_prompt").alias("output_text"), F.concat(F.lit("agent"), (F.col("session_id") % 3).cast("string")).alias("agent"),
            F.concat(F.lit("p"), (F.col("session_id") % 2).cast("string")).alias("principal"), X.const(["Read", "Grep", "Edit", "Bash", "Task"]).alias("allowed_tools"), F.col("calls").alias("cost_calls"),
            F.col("read_tokens").alias("tokens_in"), F.lit(0).alias("tokens_out"), F.lit(5).alias("wall_clock_ms"), F.lit(0.5).alias("eur"), F.lit(9).alias("max_calls"), F.lit(2000).alias("max_tokens"),
            F.lit(10).alias("max_wall_clock_ms"), F.lit(0.1).alias("max_eur"), F.col("rework_turns").alias("human_interventions"))
        from turnstone.operators import ordered as O
        mine = t.turn_calls.filter(has_run).join(t.task_turns.select("session_id", "turn_no", "task_id"), ["session_id", "turn_no"])
        mine = O.ordered_scan(mine, ["task_id"], ["turn_no", "call_no"], {"pos": O.number()}, O.runs("turn_no"))
        self.calls = stored(mine.select("task_id", (F.col("pos") - 1).alias("i"), F.col("name").alias("tool"), (~F.col("failed")).alias("call_ok"), "call_id", F.expr("CASE WHEN call_id % 2 = 0 THEN concat('k', call_id) END").alias("idempotency_key"),
                                 "input_json"), "run-calls").select(
                                 "*", F.try_parse_json("input_json").alias("input"), F.try_parse_json(F.expr("""concat('{"doc_id":"doc-', call_id % 4, '"}')""")).alias("output")).drop("input_json")
        self.tools = t.spark.createDataFrame([("Read", False), ("Grep", False), ("Edit", True), ("Bash", True), ("Task", False)], "tool string, side_effect boolean")
        self.policies = t.spark.createDataFrame([("agent0", ["Read", "Grep", "Edit", "Bash", "Task"], "p0"), ("agent1", ["Read"], "p1")], "agent string, allowed_tools array<string>, principal string")
        self.provenance = self.calls.join(self.runs.select("task_id", "output_text"), "task_id").select(
            "task_id", F.lit("document").alias("kind"), F.expr("concat('doc-', call_id % 5)").alias("source_id"), F.expr(FRAGMENT).alias("fragment"))
        self.seen = self.calls.filter("call_ok").select("task_id", F.get_json_object(F.to_json("output"), "$.doc_id").alias("doc_id"))
        self.judge = w.filter("session_id % 2 = 0").select("task_id", (F.col("session_id") % 4 == 0).alias("pass"))

    @cached_property
    def lines(self):
        """The runs as JSON lines, as they come from outside; sessions 3, 10, 17 ... break the contract in one of three ways."""
        call = F.to_json(F.struct("tool", F.col("call_ok").alias("ok"), "idempotency_key", "input", F.when(F.col("call_id") % 3 == 0, F.try_parse_json(
            F.expr("""concat('{"results":[{"doc_id":"doc-', call_id % 4, '"},{"doc_id":7}]}')"""))).otherwise(F.col("output")).alias("output")))
        joined = lambda items: F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
        calls = self.calls.groupBy("task_id").agg(joined(F.transform(F.array_sort(F.collect_list(F.struct("i", call.alias("j")))), lambda x: x["j"])).alias("_calls"))
        cited = self.provenance.groupBy("task_id").agg(joined(F.collect_list(F.to_json(F.struct(F.struct("kind", F.col("source_id").alias("id")).alias("source"), "fragment")))).alias("_cited"))
        r = self.runs.join(calls, "task_id", "left").join(cited, "task_id", "left").withColumn("sid", F.regexp_extract("task_id", "^([0-9]+)#", 1).cast("int"))
        fault = F.when(F.col("sid") % 7 == 3, F.col("sid") % 3)
        head = F.to_json(F.struct(
            "task_id", F.when(fault == 0, "paused").otherwise(F.col("status")).alias("status"), F.when(F.coalesce(fault != 1, F.lit(True)), F.col("agent")).alias("agent"), "principal", "allowed_tools",
            F.struct(F.col("output_text").alias("text")).alias("output"), F.struct(F.when(fault == 2, -1).otherwise(F.col("cost_calls")).alias("calls"), "tokens_in", "tokens_out", "wall_clock_ms", "eur").alias("cost"),
            F.struct("max_calls", "max_tokens", "max_wall_clock_ms", "max_eur").alias("quota"), "human_interventions"))
        line = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"tool_calls":'), F.coalesce("_calls", F.lit("[]")), F.lit(',"provenance":'), F.coalesce("_cited", F.lit("[]")), F.lit("}"))
        spread = int(r.sparkSession.conf.get("spark.sql.shuffle.partitions"))          # few rows, but each is walked for long
        return stored(r.select("task_id", F.try_parse_json(line).alias("run")).repartition(spread, "task_id"), "run-lines")

    def assertions(self):
        return Q.run_assertions(self.golden, self.lines, self.policies, self.tools, CONTRACT, SCHEMAS)


SCHEMAS = {"Read": {"input": {"type": "object", "required": ["offset"]}}, "Bash": {"input": {"properties": {"command": {"type": "string", "minLength": 3}}}}}


def runs(t) -> Runs:
    if not hasattr(t, "_runs"):
        t._runs = Runs(t)
    return t._runs


part("called", "run_calls")("SELECT task_id, list(DISTINCT tool) AS called, count(*) AS n_calls FROM run_calls GROUP BY task_id")
part("v19", "signals_wide", "runs", "called")("""
WITH j AS (SELECT s.task_id, s.task_no, r.status, r.task_id IS NOT NULL AS run, coalesce(c.called, []) AS called, coalesce(c.n_calls, 0) AS n_calls FROM signals_wide s LEFT JOIN runs r ON r.task_id = s.task_id LEFT JOIN called c ON c.task_id = s.task_id)
SELECT task_id, 'tools' AS grp, 'run_present' AS name, false AS ok FROM j WHERE NOT run
UNION ALL SELECT task_id, 'tools', 'status', status = 'completed' FROM j WHERE run UNION ALL SELECT task_id, 'tools', 'tool_required:Read', list_contains(called, 'Read') FROM j WHERE run
UNION ALL SELECT task_id, 'tools', 'tool_forbidden:Skill', NOT list_contains(called, 'Skill') FROM j WHERE run UNION ALL SELECT task_id, 'tools', 'tool_any_of', list_contains(called, 'Grep') OR list_contains(called, 'Edit') FROM j WHERE run
UNION ALL SELECT task_id, 'tools', 'max_tool_calls', n_calls <= 4 + task_no % 4 FROM j WHERE run""")
part("v20", "runs", "called")("""
WITH j AS (SELECT r.*, coalesce(c.called, []) AS called FROM runs r LEFT JOIN called c USING (task_id))
SELECT task_id, 'policy' AS grp, 'policy_allowlist' AS name, len(list_filter(called, lambda x: x NOT IN ('Read', 'Grep', 'Edit', 'Bash', 'Task'))) = 0 AS ok FROM j
UNION ALL SELECT task_id, 'policy', 'policy_declared', agent = 'agent0' FROM j UNION ALL SELECT task_id, 'policy', 'policy_identity', principal = replace(agent, 'agent', 'p') FROM j WHERE agent <> 'agent2'
UNION ALL SELECT task_id, 'policy', 'quota_calls', cost_calls <= 9 FROM j UNION ALL SELECT task_id, 'policy', 'quota_tokens', tokens_in <= 2000 FROM j
UNION ALL SELECT task_id, 'policy', 'quota_wall_clock', true FROM j UNION ALL SELECT task_id, 'policy', 'quota_eur', false FROM j""")
part("v21", "run_calls", "signals_wide", "runs")("""
SELECT task_id, 'calls' AS grp, 'tool_known[' || i || ']' AS name, false AS ok FROM run_calls WHERE tool NOT IN ('Read', 'Grep', 'Edit', 'Bash', 'Task')
UNION ALL SELECT task_id, 'calls', 'tool_io_valid[' || i || ']:' || tool, CASE tool WHEN 'Read' THEN input_json LIKE '%"offset"%' WHEN 'Bash' THEN length(json_extract_string(input_json, '$.command')) >= 3 ELSE true END FROM run_calls WHERE tool IN ('Read', 'Grep', 'Edit', 'Bash', 'Task')
UNION ALL SELECT task_id, 'calls', 'idempotency_key[' || i || ']:' || tool, idempotency_key IS NOT NULL FROM run_calls WHERE tool IN ('Edit', 'Bash')
UNION ALL SELECT s.task_id, 'calls', 'side_effects_max', coalesce(n, 0) <= 2 FROM runs s LEFT JOIN (SELECT task_id, count(*) AS n FROM run_calls WHERE tool IN ('Edit', 'Bash') GROUP BY ALL) c USING (task_id)
UNION ALL SELECT s.task_id, 'calls', 'side_effects_exactly', coalesce(n, 0) = 1 FROM runs s LEFT JOIN (SELECT task_id, count(*) AS n FROM run_calls WHERE tool IN ('Edit', 'Bash') GROUP BY ALL) c USING (task_id) WHERE s.task_no % 3 = 0""")
part("v22", "runs")(r"""
SELECT task_id, 'content' AS grp, 'must_contain:e' AS name, contains(output_text, 'e') AS ok FROM runs UNION ALL SELECT task_id, 'content', 'must_not_contain:zzz', NOT contains(output_text, 'zzz') FROM runs
UNION ALL SELECT task_id, 'content', 'must_not_contain:the ', NOT contains(output_text, 'the ') FROM runs UNION ALL SELECT task_id, 'content', 'must_contain_any', contains(output_text, 'que') OR contains(output_text, 'and') FROM runs
UNION ALL SELECT task_id, 'content', 'no_euro_amount', NOT regexp_matches(output_text, '(?i)\d+\s?(€|euros?)') FROM runs""")
part("v23", "runs", "run_calls")("""
WITH p AS (SELECT c.task_id, 'doc-' || call_id % 5 AS doc, CASE WHEN call_id % 23 = 0 THEN upper(substring(output_text, CAST(1 + call_id * 7919 % greatest(length(output_text), 1) AS INT), 40)) ELSE substring(output_text, CAST(1 + call_id * 7919 % greatest(length(output_text), 1) AS INT), 40) END AS fragment, output_text FROM run_calls c JOIN runs r USING (task_id)),
 seen AS (SELECT DISTINCT task_id, 'doc-' || call_id % 4 AS doc FROM run_calls WHERE call_ok),
 e AS (SELECT r.task_id, r.task_no, coalesce((SELECT count(*) FROM p WHERE p.task_id = r.task_id), 0) AS n, coalesce((SELECT count(*) FROM p WHERE p.task_id = r.task_id AND NOT contains(output_text, fragment)), 0) AS absent,
  coalesce((SELECT count(*) FROM p ANTI JOIN seen USING (task_id, doc) WHERE p.task_id = r.task_id), 0) AS lost, coalesce((SELECT count(*) FROM p WHERE p.task_id = r.task_id AND doc = 'doc-1'), 0) AS cited FROM runs r)
SELECT task_id, 'provenance' AS grp, 'provenance_present' AS name, n > 0 AS ok FROM e WHERE task_no % 2 = 0 UNION ALL SELECT task_id, 'provenance', 'provenance_min_entries', n >= 6 FROM e
UNION ALL SELECT task_id, 'provenance', 'provenance_traceable', lost = 0 FROM e UNION ALL SELECT task_id, 'provenance', 'provenance_fragments_in_output', absent = 0 FROM e UNION ALL SELECT task_id, 'provenance', 'provenance_cites:doc-1', cited > 0 FROM e""")
part("contracts", "runs")("""
SELECT task_id, session_id % 7 <> 3 AS valid, CASE WHEN session_id % 7 <> 3 THEN '' WHEN session_id % 3 = 0 THEN '$.status: enum' WHEN session_id % 3 = 1 THEN '$: required agent' ELSE '$.cost.calls: minimum' END AS errors FROM runs""")
part("all_assertions", "v19", "v20", "v21", "v22", "v23", "contracts")("""
SELECT a.* FROM (SELECT * FROM v19 UNION ALL SELECT * FROM v20 UNION ALL SELECT * FROM v21 UNION ALL SELECT * FROM v22 UNION ALL SELECT * FROM v23) a LEFT JOIN contracts c USING (task_id) WHERE coalesce(c.valid, true)
UNION ALL SELECT task_id, 'contract', 'contract_valid', valid FROM contracts""")
part("task_outcomes", "signals_wide", "runs", "all_assertions", "contracts")("""
SELECT s.task_id, s.session_id, s.task_no, a.ok AS assert_pass, j.pass AS judge_pass, a.ok AND coalesce(j.pass, true) AS success, coalesce(a.policy, false) AS policy_ok, coalesce(a.prov, false) AS provenance_ok,
 coalesce(c.valid, false) AS contract_valid,
 r.task_id IS NOT NULL AND r.human_interventions = 0 AND a.ok AND coalesce(j.pass, true) AS no_human FROM signals_wide s LEFT JOIN contracts c ON c.task_id = s.task_id
JOIN (SELECT task_id, bool_and(ok) AS ok, bool_and(ok) FILTER (grp = 'policy') AS policy, bool_and(ok) FILTER (grp = 'provenance') AS prov FROM all_assertions GROUP BY ALL) a ON a.task_id = s.task_id
LEFT JOIN (SELECT task_id, session_id % 4 = 0 AS pass FROM signals_wide WHERE session_id % 2 = 0) j ON j.task_id = s.task_id LEFT JOIN runs r ON r.task_id = s.task_id""")


@query("v19_tool_assertions", "SELECT task_id, name, ok FROM v19", "v19")
def v19(t):
    r = runs(t)
    return Q.tool_assertions(r.golden, r.runs, r.calls).select("task_id", "name", "ok")


@query("v20_policy_assertions", "SELECT task_id, name, ok FROM v20", "v20")
def v20(t):
    r = runs(t)
    return Q.policy_assertions(r.runs, r.calls, r.policies).select("task_id", "name", "ok")


@query("j14_policy_join", "SELECT agent, count(*) AS runs, agent <> 'agent2' AS declared FROM runs GROUP BY agent", "runs")
def j14(t):
    r = runs(t)
    known = r.policies.select("agent", F.lit(True).alias("known"))
    return r.runs.join(known, "agent", "left").groupBy("agent", F.coalesce("known", F.lit(False)).alias("declared")).agg(F.count(F.lit(1)).alias("runs"))


@query("e08_allow_list_subset", "SELECT task_id, len(list_filter(called, lambda x: x NOT IN ('Read', 'Grep', 'Edit', 'Bash', 'Task'))) = 0 AS allowed FROM called", "called")
def e08(t):
    r = runs(t)
    return Q.used_tools(r.calls).select("task_id", (F.size(F.array_except("called", X.const(["Read", "Grep", "Edit", "Bash", "Task"]))) == 0).alias("allowed"))


@query("v21_call_assertions", "SELECT task_id, name, ok FROM v21", "v21")
def v21(t):
    r = runs(t)
    g = r.golden.join(r.runs.select("task_id"), "task_id", "left_semi")
    return Q.call_assertions(r.calls, r.tools, SCHEMAS).unionByName(Q.side_effect_assertions(g, r.calls, r.tools)).select("task_id", "name", "ok")


@query("v21_property_assertions", """
SELECT task_id, 'tool_io_prop:Edit.input.path' AS name, true AS ok, count(*) AS calls FROM run_calls WHERE tool = 'Edit' GROUP BY task_id
UNION ALL SELECT task_id, 'tool_io_prop:Read.input.offset', input_json LIKE '%offset%', count(*) FROM run_calls WHERE tool = 'Read' GROUP BY task_id, input_json LIKE '%offset%'""", "run_calls")
def v21b(t):
    r = runs(t)
    want = r.golden.select("task_id", F.explode(F.array(F.struct(F.lit("Edit").alias("tool"), F.lit("input").alias("part"), F.lit("path").alias("path")),
                                                        F.struct(F.lit("Read").alias("tool"), F.lit("input").alias("part"), F.lit("offset").alias("path")))).alias("w")).select("task_id", "w.*")
    return Q.property_assertions(want, r.calls).groupBy("task_id", "name", "ok").agg(F.count(F.lit(1)).alias("calls"))


@query("v22_content_assertions", "SELECT task_id, name, ok FROM v22", "v22")
def v22(t):
    r = runs(t)
    return Q.content_assertions(r.golden, r.runs).select("task_id", "name", "ok")


@query("v22_echo_assertions", """
SELECT r.task_id, 'must_echo:Grep.doc_id' AS name, coalesce(bool_and(contains(output_text, 'doc-' || call_id % 4)), false) AS ok FROM runs r LEFT JOIN run_calls c ON c.task_id = r.task_id AND tool = 'Grep' AND call_ok GROUP BY r.task_id""", "runs", "run_calls")
def v22b(t):
    r = runs(t)
    want = r.runs.select("task_id", F.lit("Grep").alias("tool"), F.lit("doc_id").alias("field"))
    return Q.echo_assertions(want, r.calls, r.runs).select("task_id", "name", "ok")


@query("v23_provenance_assertions", "SELECT task_id, name, ok FROM v23", "v23")
def v23(t):
    r = runs(t)
    return Q.provenance_assertions(r.golden, r.runs, r.provenance, r.seen).select("task_id", "name", "ok")


@query("j15_untraceable_documents", """
SELECT task_id, 'doc-' || call_id % 5 AS doc_id, count(*) AS n FROM run_calls c WHERE NOT EXISTS (SELECT 1 FROM run_calls s WHERE s.task_id = c.task_id AND s.call_ok AND s.call_id % 4 = c.call_id % 5) GROUP BY ALL""", "run_calls")
def j15(t):
    r = runs(t)
    cited = r.provenance.select("task_id", F.col("source_id").alias("doc_id"))
    return cited.join(r.seen.distinct(), ["task_id", "doc_id"], "left_anti").groupBy("task_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))


def outcomes(t):
    r = runs(t)
    return Q.outcomes(r.golden, r.assertions(), r.judge, r.runs)


@query("v24_task_outcomes", "SELECT task_id, contract_valid, assert_pass, judge_pass, success, policy_ok, provenance_ok, no_human FROM task_outcomes", "task_outcomes")
def v24(t):
    return outcomes(t).select("task_id", "contract_valid", "assert_pass", "judge_pass", "success", "policy_ok", "provenance_ok", "no_human")


@query("v18_run_contract", "SELECT task_id, valid AS contract_valid, errors FROM contracts", "contracts")
def v18c(t):
    return Q.run_contract(runs(t).lines, CONTRACT).select("task_id", "contract_valid", "errors")


@query("v24_run_assertions", "SELECT task_id, grp, name, ok FROM all_assertions", "all_assertions")
def v24b(t):
    return runs(t).assertions().select("task_id", F.col("group").alias("grp"), "name", "ok")


@query("j13_golden_run_judge", "SELECT s.task_id, r.status, CASE WHEN s.session_id % 2 = 0 THEN s.session_id % 4 = 0 END AS judge_pass FROM signals_wide s LEFT JOIN runs r ON r.task_id = s.task_id", "signals_wide", "runs")
def j13(t):
    r = runs(t)
    return (r.golden.select("task_id").join(r.runs.select("task_id", "status"), "task_id", "left").join(r.judge.select("task_id", F.col("pass").alias("judge_pass")), "task_id", "left"))


_RATES = """
SELECT count(*) AS n, count(judge_pass) AS n_judged, round_even(avg(CAST(success AS INT)), 4) AS success_rate, round_even(avg(CAST(assert_pass AS INT)), 4) AS assert_rate, round_even(avg(CAST(judge_pass AS INT)), 4) AS judge_rate,
 round_even(avg(CAST(assert_pass = judge_pass AS INT)), 4) AS agreement, round_even(avg(CAST(contract_valid AS INT)), 4) AS contract_valid_rate, round_even(avg(CAST(policy_ok AS INT)), 4) AS policy_ok_rate, round_even(avg(CASE WHEN task_no % 2 = 0 THEN CAST(provenance_ok AS INT) END), 4) AS provenance_ok_rate,
 round_even(avg(CASE WHEN session_id % 5 = 0 THEN CAST(success AS INT) END), 4) AS negative_ok, round_even(avg(CAST(no_human AS INT)), 4) AS no_human_rate FROM task_outcomes"""


@query("a22_task_rates", _RATES, "task_outcomes")
def a22(t):
    return Q.task_summary(outcomes(t))


@query("a22_label_rates", """
SELECT count(*) AS n, round_even(avg(CAST(success AS INT)), 4) AS success_rate, round_even(avg(CASE WHEN judge THEN CAST(success AS INT) END), 4) AS judged_rate FROM (SELECT quality = 1 AS success, toxic = 1 AS judge FROM labels)""")
def a22b(t):
    lab = t.raw("labels").select((F.col("quality") == 1).alias("success"), (F.col("toxic") == 1).alias("judge"))
    return lab.agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg(F.col("success").cast("double")), 4).alias("success_rate"), F.bround(F.avg(F.when(F.col("judge"), F.col("success").cast("double"))), 4).alias("judged_rate"))


@query("a26_width_report", f"""
WITH r AS ({_RATES}) SELECT (SELECT count(DISTINCT name) FROM calls) AS tools_exposed, (SELECT count(*) FROM region) AS policy_exceptions, round_even((SELECT count(DISTINCT name) FROM calls) / (1 + (SELECT count(*) FROM region)), 2) AS ratio,
 r.success_rate, r.no_human_rate, (SELECT count(*) FROM labels) / 1.0 AS all_hit, 0.5 AS recall, (SELECT max(CAST(floor(o_totalprice) AS BIGINT)) FROM orders) AS max_context_tokens FROM r""", "task_outcomes", "calls")
def a26(t):
    tools = t.calls.select("name").distinct()
    retrieval = t.raw("labels").agg(F.count(F.lit(1)).cast("double").alias("all_hit"), F.lit(0.5).alias("recall"))
    rows = t.raw("orders").select("o_orderkey", "o_totalprice", F.floor("o_totalprice").cast("bigint").alias("context_tokens"), F.lit(True).alias("success"))
    ctx = I.context_without_degradation(rows, ["o_totalprice", "o_orderkey"], F.floor(F.col("o_totalprice") / 1000))
    return Q.width_report(tools, t.raw("region"), retrieval, a22(t), ctx)


@query("w18_consecutive_cycles", """
SELECT cycle, lag(cycle) OVER (ORDER BY cycle) AS previous, cycle = lag(cycle) OVER (ORDER BY cycle) + 1 AS consecutive FROM (SELECT DISTINCT CAST(d + d // 5 AS INT) AS cycle FROM (SELECT date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS d FROM orders))""")
def w18(t):
    day = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date"))
    return Q.consecutive_cycles(t.raw("orders").select((day + F.floor(day / 5)).cast("int").alias("cycle"))          # a hole after every fifth day
                                .distinct())


@query("j19_unresolved_references", """
SELECT DISTINCT name AS tool, k AS path, CASE WHEN name NOT IN ('Read', 'Grep') THEN 'unknown tool' ELSE 'unknown path' END AS problem FROM (SELECT name, unnest(json_keys(input_json)) AS k FROM calls)
WHERE name NOT IN ('Read', 'Grep') OR NOT ((name = 'Read' AND k = 'file_path') OR (name = 'Grep' AND k = 'pattern'))""", "calls")
def j19(t):
    want = t.calls.select(F.col("name").alias("tool"), F.explode(F.json_object_keys("input_json")).alias("path")).distinct()
    registry = t.spark.createDataFrame([("Read", "file_path"), ("Grep", "pattern")], "tool string, path string")
    return Q.unresolved_references(want, registry)


# ------------------------------------------------------------------------------ parse report and probe
@query("a01_parse_report", """
SELECT count(*) FILTER (length(html) > 0) AS lines_read, count(*) FILTER (length(html) > 0 AND NOT contains(html, '</body>')) AS lines_unreadable, count(*) FILTER (length(html) > 0 AND contains(html, '</body>')) AS records_kept,
 round(count(*) FILTER (length(html) > 0 AND NOT contains(html, '</body>')) / count(*) FILTER (length(html) > 0), 6) AS unreadable_rate,
 count(*) FILTER (length(html) > 0) > 50 AND count(*) FILTER (length(html) > 0 AND NOT contains(html, '</body>')) / count(*) FILTER (length(html) > 0) > 0.02 AS looks_broken FROM pages""")
def a01(t):
    lines = t.raw("pages").select(F.length("html").alias("line_len"), F.contains(F.col("html"), F.lit("</body>")).alias("readable"))
    return TR.parse_report(lines).withColumn("unreadable_rate", r6("unreadable_rate"))


@query("a02_type_histogram", "SELECT CASE WHEN event_id % 8 = 0 THEN '<sans type>' ELSE event_type END AS value, count(*) AS n FROM events GROUP BY 1")
def a02(t):
    return TR.histogram(t.raw("events"), F.when(F.col("event_id") % 8 != 0, F.col("event_type")))


@query("a03_fields_by_type", "SELECT tool AS type, k AS field, count(*) AS n FROM (SELECT tool, unnest(json_keys(input_json)) AS k FROM calls) GROUP BY ALL", "calls")
def a03(t):
    return TR.fields_by_type(t.calls, "tool", "input_json")


@query("a04_block_probe", """
SELECT 'block' AS what, 'text' AS value, count(*) AS n FROM calls UNION ALL SELECT 'block', 'tool_use', CAST(sum(tool_blocks) AS BIGINT) FROM calls UNION ALL SELECT 'tool', name, CAST(sum(tool_blocks) AS BIGINT) FROM calls GROUP BY name
UNION ALL SELECT 'usage', 'input_tokens', count(*) FROM calls UNION ALL SELECT 'usage', 'cache_read_input_tokens', count(*) FROM calls UNION ALL SELECT 'usage', 'output_tokens', count(*) FILTER (call_id % 5 <> 0) FROM calls""", "calls")
def a04(t):
    from turnstone.plans.record_queries import _assistant_message
    return TR.message_probe(t.calls.select(_assistant_message().alias("message")))


@query("a05_prompt_lengths", """
SELECT count(*) AS n, min(length(text)) AS min_len, list_sort(list(length(text)))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median_len, max(length(text)) AS max_len FROM conversations WHERE role = 'user'""")
def a05(t):
    return TR.length_summary(t.raw("conversations").filter("role = 'user'"), F.length("text").cast("bigint"))


@query("a06_missing_critical", """
WITH f AS (SELECT DISTINCT tool AS type, unnest(json_keys(input_json)) AS field FROM calls), w AS (SELECT * FROM (VALUES ('Bash', 'command'), ('Bash', 'cwd'), ('Read', 'file_path'), ('Write', 'path')) v(type, field))
SELECT type, field, CASE WHEN type = 'Write' THEN 'Write (type absent)' ELSE type || '.' || field END AS missing FROM w WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.type = w.type AND f.field = w.field)""", "calls")
def a06(t):
    return TR.missing_critical(TR.fields_by_type(t.calls, "tool", "input_json"), [("Bash", "command"), ("Bash", "cwd"), ("Read", "file_path"), ("Write", "path")])
