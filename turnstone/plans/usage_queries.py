"""Queries on usage, work kinds, alerts and spend."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstone.functions import exprs as X
from turnstone.operators import usage as U
from turnstone.plans.bridge import Tables
from turnstone.plans.oracle_base import part
from turnstone.plans.registry import query, r6

AS_OF, BUDGET = "2024-01-31", 3000

part("week_usage", "tasks", "owners", "turns", "turn_calls", "turn_active")("""
SELECT week, monday, CAST(sum(tasks) AS BIGINT) AS tasks, CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(calls) AS BIGINT) AS tool_calls,
  CAST(sum(active_us) AS BIGINT) AS active_us, CAST(sum(rd) AS BIGINT) AS read_tokens, CAST(sum(ca) AS BIGINT) AS cache_tokens,
  CAST(sum(ou) AS BIGINT) AS output_tokens, CAST(sum(ha) AS BIGINT) AS haiku_tokens, CAST(sum(so) AS BIGINT) AS sonnet_tokens,
  CAST(sum(op) AS BIGINT) AS opus_tokens, count(DISTINCT day) AS active_days, count(DISTINCT session_id) AS sessions
FROM (
 SELECT strftime(started_at, '%G-W%V') AS week, CAST(date_trunc('week', started_at) AS DATE) AS monday, session_id, NULL AS day,
   1 AS tasks, 0 AS turns, 0 AS calls, 0 AS active_us, 0 AS rd, 0 AS ca, 0 AS ou, 0 AS ha, 0 AS so, 0 AS op FROM tasks
 UNION ALL
 SELECT strftime(t.started_at, '%G-W%V'), CAST(date_trunc('week', t.started_at) AS DATE), o.session_id, CAST(t.started_at AS DATE),
   0, 1, coalesce(c.n, 0), coalesce(v.active_us, 0), coalesce(c.rd, 0), coalesce(c.ca, 0), coalesce(c.ou, 0), coalesce(c.ha, 0), coalesce(c.so, 0), coalesce(c.op, 0)
 FROM owners o JOIN turns t USING (session_id, turn_no) LEFT JOIN turn_active v USING (session_id, turn_no)
 LEFT JOIN (SELECT session_id, turn_no, count(*) AS n, sum(total_in) AS rd, sum(cache_read_tokens) AS ca, sum(output_tokens) AS ou,
   sum(total_in) FILTER (model LIKE '%haiku%') AS ha, sum(total_in) FILTER (model LIKE '%sonnet%') AS so, sum(total_in) FILTER (model LIKE '%opus%') AS op
   FROM turn_calls GROUP BY ALL) c USING (session_id, turn_no))
GROUP BY week, monday""")

part("week_models", "turn_calls", "owners", "turns")("""
SELECT strftime(t.started_at, '%G-W%V') AS week, coalesce(model, 'inconnu') AS model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
  CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, CAST(sum(cache_creation_tokens) AS BIGINT) AS cache_write_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CASE WHEN model LIKE '%haiku%' THEN 'Haiku' WHEN model LIKE '%sonnet%' THEN 'Sonnet'
   WHEN model LIKE '%opus%' THEN 'Opus' ELSE 'Autre' END AS family
FROM turn_calls c JOIN owners o USING (session_id, turn_no) JOIN turns t USING (session_id, turn_no) GROUP BY ALL""")

part("work_kinds", "tasks", "turn_calls", "owners")("""
SELECT t.session_id, t.task_no, t.started_at, CASE WHEN n IS NULL AND agent_turns = 0 THEN 'Conversation' WHEN agent_turns > 0 OR orch THEN 'Orchestration'
  WHEN edits THEN 'Edition' WHEN shells * 2 >= n THEN 'Execution' WHEN web THEN 'Recherche' WHEN expl THEN 'Exploration' ELSE 'Conversation' END AS kind
FROM tasks t LEFT JOIN (SELECT o.session_id, o.task_no, count(*) AS n, bool_or(name IN ('Agent', 'Task', 'Skill')) AS orch,
  bool_or(name IN ('Edit', 'Write', 'NotebookEdit', 'MultiEdit')) AS edits, count(*) FILTER (name = 'Bash') AS shells,
  bool_or(name IN ('WebSearch', 'WebFetch')) AS web, bool_or(name IN ('Read', 'Grep', 'Glob')) AS expl
  FROM turn_calls c JOIN owners o USING (session_id, turn_no) GROUP BY ALL) k USING (session_id, task_no)""")


def weeks(t: Tables):
    return U.week_usage(t.tasks, U.all_turns(t.task_turns, t.agent_turns), t.turn_calls, t.steps, t.turn_active)


def models(t: Tables):
    return U.week_models(t.steps, U.all_turns(t.task_turns, t.agent_turns))


def kinds(t: Tables):
    return U.work_kinds(t.tasks, U.all_turns(t.task_turns, t.agent_turns), t.turn_calls)


@query("e01_all_turns", "SELECT session_id, turn_no, task_no, by_agent FROM owners", "owners")
def e01(t):
    return U.all_turns(t.task_turns, t.agent_turns).select("session_id", "turn_no", "task_no", "by_agent")


@query("a07_week_usage", "SELECT * FROM week_usage", "week_usage")
def a07(t):
    return weeks(t)


@query("a08_week_models", "SELECT * FROM week_models", "week_models")
def a08(t):
    return models(t)


@query("a09_family_shares", "SELECT week, " + ", ".join(
    f"round(coalesce(sum(input_tokens + cache_read_tokens + cache_write_tokens) FILTER (family = '{f}'), 0) / sum(input_tokens + cache_read_tokens + cache_write_tokens), 6) AS {f.lower()}_tokens, "
    f"round(coalesce(sum(calls) FILTER (family = '{f}'), 0) / sum(calls), 6) AS {f.lower()}_calls" for f in ("Haiku", "Sonnet", "Opus", "Autre"))
    + " FROM week_models GROUP BY week", "week_models")
def a09(t):
    s = U.family_shares(models(t))
    return s.select("week", *[r6(c).alias(c) for c in s.columns if c != "week"])


@query("a10_work_kind", "SELECT session_id, task_no, kind FROM work_kinds", "work_kinds")
def a10(t):
    return kinds(t).select("session_id", "task_no", "kind")


@query("a11_work_mix", "SELECT strftime(started_at, '%G-W%V') AS week, kind, count(*) AS tasks FROM work_kinds GROUP BY ALL", "work_kinds")
def a11(t):
    return U.work_mix(kinds(t))


# per-user weeks straight from the event table: the alert rules over many keys at once
part("user_weeks")("""
SELECT user_id, strftime(ts, '%G-W%V') AS week, CAST(date_trunc('week', ts) AS DATE) AS monday, count(DISTINCT CAST(ts AS DATE)) AS active_days,
  count(*) AS tasks, CAST(sum(v) AS BIGINT) AS read_tokens, CAST(sum(CASE WHEN event_id % 4 = 1 THEN v ELSE 0 END) AS BIGINT) AS cache_tokens,
  CAST(sum(CASE WHEN event_type = 'view' THEN v ELSE 0 END) AS BIGINT) AS opus_tokens,
  CAST(sum(CASE WHEN event_type = 'click' THEN v ELSE 0 END) AS BIGINT) AS haiku_tokens
FROM (SELECT *, CAST(floor(value) AS BIGINT) AS v FROM events) GROUP BY ALL""")


def user_weeks(t: Tables):
    v = F.floor("value").cast("bigint")
    zero = F.lit(0).cast("bigint")
    return t.raw("events").groupBy("user_id", X.week_key("ts").alias("week"), X.monday_of("ts").alias("monday")).agg(
        F.count_distinct(F.to_date("ts")).alias("active_days"), F.count(F.lit(1)).alias("tasks"), F.sum(v).alias("read_tokens"),
        F.sum(F.when(F.col("event_id") % 4 == 1, v).otherwise(zero)).alias("cache_tokens"),
        F.sum(F.when(F.col("event_type") == "view", v).otherwise(zero)).alias("opus_tokens"),
        F.sum(F.when(F.col("event_type") == "click", v).otherwise(zero)).alias("haiku_tokens"))


def _alert_sql(source: str, keys: str, budget: int) -> str:
    k = keys + ", " if keys else ""
    p = f"PARTITION BY {keys} " if keys else ""
    return f"""
WITH c AS (SELECT *, lag(read_tokens) OVER ({p}ORDER BY monday) AS prev, row_number() OVER ({p}ORDER BY monday DESC) AS rn
  FROM {source} WHERE monday < DATE '2024-01-29'), l AS (SELECT * FROM c WHERE rn = 1)
SELECT {k}week, 'sous_utilisation' AS alert, 'attention' AS severity, round(read_tokens / {budget}.0, 6) AS value FROM l WHERE prev IS NOT NULL AND read_tokens / {budget}.0 < 0.5 AND prev / {budget}.0 < 0.5
UNION ALL SELECT {k}week, 'plafond_proche', 'attention', round(read_tokens / {budget}.0, 6) FROM l WHERE read_tokens / {budget}.0 > 0.9
UNION ALL SELECT {k}week, 'adoption_faible', 'attention', CAST(active_days AS DOUBLE) FROM l WHERE active_days <= 1
UNION ALL SELECT {k}week, 'cache_faible', 'attention', round(cache_tokens / read_tokens, 6) FROM l WHERE read_tokens > 0 AND cache_tokens / read_tokens < 0.3
UNION ALL SELECT {k}week, 'monoculture_opus', 'info', round(opus_tokens / read_tokens, 6) FROM l WHERE read_tokens > 0 AND opus_tokens / read_tokens > 0.95 AND tasks >= 5
UNION ALL SELECT {k}week, 'monoculture_haiku', 'info', round(haiku_tokens / read_tokens, 6) FROM l WHERE read_tokens > 0 AND haiku_tokens / read_tokens > 0.9 AND tasks >= 5
UNION ALL SELECT {k}week, 'decrochage', 'attention', round((read_tokens - prev) / prev, 6) FROM l WHERE prev > 0 AND (read_tokens - prev) / prev < -0.5"""


@query("r01_usage_alerts", _alert_sql("week_usage", "", BUDGET * 10), "week_usage")
def r01(t):
    return U.alerts(weeks(t), AS_OF, BUDGET * 10).withColumn("value", r6("value"))


@query("r01_usage_alerts_by_user", _alert_sql("user_weeks", "user_id", 300), "user_weeks")
def r01b(t):
    return U.alerts(user_weeks(t), AS_OF, 300, ["user_id"]).withColumn("value", r6("value"))


@query("k06_last_weeks", """
SELECT user_id, week, read_tokens FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY monday DESC) AS rn FROM user_weeks) WHERE rn <= 3""", "user_weeks")
def k06(t):
    return U.last_weeks(user_weeks(t), 3, ["user_id"]).select("user_id", "week", "read_tokens")


# spend report rows from the star schema
part("spend")("""
SELECT CASE WHEN l_linenumber % 2 = 0 THEN upper(c_name) ELSE c_name END AS email, o_orderpriority AS product,
  CASE CAST(replace(p_brand, 'Brand#', '') AS INT) % 4 WHEN 0 THEN 'x-Opus' WHEN 1 THEN 'x-sonnet' WHEN 2 THEN 'x-haiku' ELSE 'other' END AS model,
  1 AS requests, CAST(l_quantity AS BIGINT) AS prompt_tokens, CAST(l_linenumber AS BIGINT) AS completion_tokens, l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_discount = 0 THEN 0 ELSE CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2))) END AS net, CAST(round(l_extendedprice, 2) AS DECIMAL(18, 2)) AS gross
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey""")


def spend(t: Tables):
    li = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    o = t.raw("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    j = (li.join(o, li.l_orderkey == o.o_orderkey).join(t.raw("customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
         .join(t.raw("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")))
    return j.select(
        F.when(F.col("l_linenumber") % 2 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("email"), F.col("o_orderpriority").alias("product"),
        F.expr("CASE CAST(replace(p_brand, 'Brand#', '') AS INT) % 4 WHEN 0 THEN 'x-Opus' WHEN 1 THEN 'x-sonnet' WHEN 2 THEN 'x-haiku' ELSE 'other' END").alias("model"),
        F.lit(1).cast("bigint").alias("requests"), F.col("l_quantity").cast("bigint").alias("prompt_tokens"), F.col("l_linenumber").cast("bigint").alias("completion_tokens"),
        (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("line"),
        F.expr("CASE WHEN l_discount = 0 THEN 0 ELSE CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2))) END").cast("decimal(18,6)").alias("net"),
        F.round("l_extendedprice", 2).cast("decimal(18,2)").alias("gross"))


_LEARNERS = """SELECT lower(email) AS person, arg_min(email, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS email, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
  CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(CASE WHEN net <> 0 THEN net ELSE gross END) AS DOUBLE) AS spend,
  CAST(coalesce(sum(prompt_tokens + completion_tokens) FILTER (model LIKE '%haiku%'), 0) AS BIGINT) AS haiku_tokens, CAST(coalesce(sum(prompt_tokens + completion_tokens) FILTER (model LIKE '%sonnet%'), 0) AS BIGINT) AS sonnet_tokens,
  CAST(coalesce(sum(prompt_tokens + completion_tokens) FILTER (model LIKE '%Opus%'), 0) AS BIGINT) AS opus_tokens, CAST(coalesce(sum(prompt_tokens + completion_tokens) FILTER (model = 'other'), 0) AS BIGINT) AS autre_tokens,
  CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens FROM spend GROUP BY 1"""


def learners(t: Tables):
    return U.learner_spend(spend(t), ["line"])


@query("a12_learner_spend", _LEARNERS, "spend")
def a12(t):
    return learners(t).withColumn("spend", F.col("spend").cast("double"))


@query("a12_learner_products", "SELECT lower(email) AS person, lower(product) AS product, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens FROM spend GROUP BY ALL", "spend")
def a12b(t):
    return U.learner_products(spend(t))


@query("a13_team_utilisation", f"""
SELECT person, total_tokens, round(total_tokens / 4000.0, 6) AS utilisation, total_tokens / 4000.0 < 0.5 AS under_used, total_tokens = 0 AS idle FROM ({_LEARNERS})""", "spend")
def a13(t):
    return U.team_utilisation(learners(t), 1000, 4).select("person", "total_tokens", r6("utilisation").alias("utilisation"), "under_used", "idle")
