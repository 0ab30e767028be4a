"""Named SQL fragments of the independent check: the same session tables written for DuckDB."""

from __future__ import annotations

PARTS: dict[str, tuple[list[str], str]] = {}


def part(name: str, *deps: str):
    def add(sql: str) -> None:
        PARTS[name] = (list(deps), sql.strip())
    return add


def sql(body: str, *names: str) -> str:
    """``body`` preceded by the fragments it needs, in dependency order."""
    done: list[str] = []

    def visit(n: str) -> None:
        if n in done:
            return
        for d in PARTS[n][0]:
            visit(d)
        done.append(n)

    for n in names:
        visit(n)
    if not done:
        return body.strip()
    text = body.strip()
    ctes = ",\n".join(f"{n} AS MATERIALIZED (\n{PARTS[n][1]}\n)" for n in done)          # shared fragments run once
    recursive = "RECURSIVE " if any("WITH RECURSIVE" in PARTS[n][1] for n in done) else ""
    if text[:5].upper() == "WITH ":
        return f"WITH {recursive}{ctes},\n{text[5:]}"
    return f"WITH {recursive}{ctes}\n{text}"


part("b1")("""
SELECT user_id AS session_id, event_id AS call_id, ts AS called_at, value, event_type,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS call_no,
  lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS result_at,
  CASE event_type WHEN 'click' THEN 'Read' WHEN 'view' THEN 'Grep' WHEN 'purchase' THEN 'Edit'
                  WHEN 'signup' THEN 'Task' ELSE 'Bash' END AS tool,
  event_id % 6 = 0 AS failed,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 3 AS arg,
  CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'pytest -q' ELSE 'ls' END AS command,
  CASE event_id % 4 WHEN 0 THEN 'x-opus' WHEN 1 THEN 'x-sonnet' WHEN 2 THEN 'x-haiku' ELSE 'other' END AS model,
  CAST(floor(value) AS BIGINT) AS input_tokens,
  CASE WHEN event_id % 2 = 0 THEN 3 * CAST(floor(value) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS cache_read_tokens,
  event_id % 7 * 10 AS cache_creation_tokens, event_id % 50 AS output_tokens, 1 + event_id % 3 AS tool_blocks
FROM events""")

part("calls", "b1", "prompts")("""
SELECT * EXCLUDE (prompts), least(CAST(floor(call_no / 5) AS BIGINT), coalesce(prompts, 1) - 1) AS turn_no,
  CASE WHEN call_id % 11 = 0 THEN 'mcp__srv' || (call_id % 3) || '__query' WHEN call_id % 13 = 0 THEN 'Skill'
       WHEN call_id % 17 = 0 THEN 'TaskCreate' ELSE tool END AS name,
  CASE tool WHEN 'Bash' THEN '{"command":"' || command || '"}'
    WHEN 'Read' THEN '{"file_path":"src/f' || arg || '.py"' || CASE WHEN arg = 0 THEN ',"offset":10' ELSE '' END || '}'
    WHEN 'Grep' THEN '{"pattern":"p' || arg || '"}' WHEN 'Task' THEN '{"subagent_type":"agent' || arg || '"}'
    ELSE '{"path":"src/e' || arg || '.py","old":null}' END AS input_json,
  CASE WHEN failed THEN CASE call_id % 4 WHEN 0 THEN 'is_error' ELSE 'code=1' END END AS failure_reason,
  CASE WHEN call_id % 19 = 0 THEN 'skill-' || (call_id % 2) END AS skill,
  CAST(epoch_us(result_at) - epoch_us(called_at) AS DOUBLE) / 1000 AS duration_ms,
  input_tokens + cache_read_tokens + cache_creation_tokens AS total_in
FROM b1 LEFT JOIN (SELECT session_id, count(*) AS prompts FROM prompts GROUP BY ALL) USING (session_id)""")

part("prompts")("""
SELECT conv_id AS session_id, turn, role, text AS prompt,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_no
FROM conversations WHERE role IN ('user', 'system')""")

part("turns", "prompts", "calls")("""
SELECT c.session_id, c.turn_no, coalesce(p.prompt, '') AS prompt, coalesce(p.role = 'system', false) AS is_sidechain, c.started_at, c.ended_at,
  CASE c.last_call % 4 WHEN 2 THEN 'tool_use' WHEN 3 THEN CAST(NULL AS VARCHAR) ELSE 'end_turn' END AS stop_reason
FROM (SELECT session_id, turn_no, min(called_at) AS started_at, arg_max(called_at, call_no) AS ended_at, arg_max(call_id, call_no) AS last_call
      FROM calls GROUP BY ALL) c
LEFT JOIN prompts p ON p.session_id = c.session_id AND p.turn_no = c.turn_no""")

part("turn_calls", "turns", "calls")("""
SELECT c.* FROM calls c JOIN turns t ON t.session_id = c.session_id AND t.turn_no = c.turn_no""")

part("lagged", "turns")("""
SELECT *, trim(prompt) AS p, lower(trim(prompt)) AS lp,
  row_number() OVER w = 1 AS is_first, lag(stop_reason) OVER w AS prev_stop,
  epoch_us(started_at) - epoch_us(lag(ended_at) OVER w) AS gap
FROM turns WHERE NOT is_sidechain WINDOW w AS (PARTITION BY session_id ORDER BY turn_no)""")

part("opened", "lagged")(r"""
SELECT *, CASE WHEN starts_with(lp, 'th') THEN 'th' WHEN starts_with(lp, 'le') THEN 'le'
               WHEN starts_with(lp, 'in') THEN 'in' END AS corrective,
  CASE WHEN starts_with(lp, 'continue') THEN 'continue' WHEN starts_with(lp, 'poursuis') THEN 'poursuis'
    WHEN starts_with(lp, 'vas-y') THEN 'vas-y' WHEN starts_with(lp, 'ok') THEN 'ok' WHEN starts_with(lp, 'oui') THEN 'oui'
    WHEN starts_with(lp, 'd''accord') THEN 'd''accord' WHEN starts_with(lp, 'parfait') THEN 'parfait'
    WHEN starts_with(lp, 'super') THEN 'super' WHEN starts_with(lp, 'et maintenant') THEN 'et maintenant'
    WHEN starts_with(lp, 'ensuite') THEN 'ensuite' WHEN starts_with(lp, 'maintenant') THEN 'maintenant'
    WHEN starts_with(lp, 'aussi') THEN 'aussi' WHEN starts_with(lp, 'et ') THEN 'et '
    WHEN starts_with(lp, 'pareil') THEN 'pareil' END AS continuation,
  regexp_matches(lp, '(^|[^\p{L}\p{N}_])(que|le|the|and|der|el)([^\p{L}\p{N}_]|$)') AS refers
FROM lagged""")

part("decided", "opened")("""
SELECT *, CASE WHEN is_first THEN 'first' WHEN p = '' THEN 'no_prompt' WHEN gap > 43200000000 THEN 'silence'
    WHEN corrective IS NOT NULL THEN 'corrective'
    WHEN coalesce(lower(prev_stop) <> 'end_turn', true) AND gap < 14400000000 THEN 'unfinished'
    WHEN continuation IS NOT NULL THEN 'continuation' WHEN length(p) < 400 AND refers THEN 'short' ELSE 'new' END AS rule
FROM opened""")

part("task_turns", "decided")("""
SELECT *, session_id || '#' || task_no AS task_id,
  CASE WHEN is_new THEN 'ouverture — ' ELSE 'rattaché — ' END || reason AS decision
FROM (SELECT *, CAST(sum(CASE WHEN is_new THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn_no) AS BIGINT) AS task_no
  FROM (SELECT *, rule IN ('first', 'silence', 'new') AS is_new,
    CASE rule WHEN 'first' THEN 'premier tour de la session' WHEN 'no_prompt' THEN 'tour de continuation sans prompt'
      WHEN 'silence' THEN 'silence de ' || CAST(round(gap / 60000000.0) AS BIGINT) || ' min avant le prompt'
      WHEN 'corrective' THEN 'ouverture corrective « ' || corrective || ' »'
      WHEN 'unfinished' THEN 'le tour précédent n''avait pas rendu la main'
      WHEN 'continuation' THEN 'ouverture de continuation « ' || continuation || ' »'
      WHEN 'short' THEN 'prompt court (' || length(p) || ' car.) et référentiel' ELSE 'prompt autonome' END AS reason
    FROM decided))""")

part("agent_turns", "turns", "task_turns")("""
SELECT t.*, coalesce(s.task_no, 1) AS task_no
FROM (SELECT * FROM turns WHERE is_sidechain AND session_id IN (SELECT session_id FROM task_turns)) t
ASOF LEFT JOIN (SELECT session_id, task_no, started_at AS task_start FROM task_turns WHERE is_new) s
  ON s.session_id = t.session_id AND s.task_start <= t.started_at""")

part("turn_active", "turns", "turn_calls")("""
SELECT session_id, turn_no,
  CAST(sum(CASE WHEN gap > 0 AND gap <= 21600000000 THEN gap ELSE 0 END) AS BIGINT) AS active_us
FROM (SELECT session_id, turn_no, epoch_us(mark) - epoch_us(lag(mark) OVER (PARTITION BY session_id, turn_no ORDER BY mark)) AS gap
  FROM (SELECT session_id, turn_no, started_at AS mark FROM turns UNION ALL SELECT session_id, turn_no, ended_at FROM turns
        UNION ALL SELECT session_id, turn_no, called_at FROM turn_calls
        UNION ALL SELECT session_id, turn_no, result_at FROM turn_calls WHERE result_at IS NOT NULL))
GROUP BY ALL""")

part("owners", "task_turns", "agent_turns")("""
SELECT session_id, turn_no, task_no, false AS by_agent FROM task_turns
UNION ALL SELECT session_id, turn_no, task_no, true FROM agent_turns""")

part("tasks", "task_turns", "agent_turns", "turn_active", "turn_calls", "owners")(r"""
SELECT b.*, turns - 1 AS rework_turns, epoch_us(ended_at) - epoch_us(started_at) AS wall_us,
  coalesce(active_us, 0) AS active_us, coalesce(lower(last_stop) = 'end_turn', false) AS completed,
  coalesce(last_stop = 'tool_use', true) AS in_progress, coalesce(tool_calls, 0) AS tool_calls,
  coalesce(agent_n, 0) AS agent_turns, coalesce(has_task_events, false) AS has_task_events,
  CASE WHEN flat = '' THEN 'Travail sans prompt initial' WHEN length(flat) <= 80 THEN flat ELSE substring(flat, 1, 79) || '…' END AS title
FROM (SELECT *, trim(regexp_replace(CASE WHEN length(head) > 12 AND length(head) < length(tp) THEN head ELSE tp END,
                                    '\s+', ' ', 'g')) AS flat
  FROM (SELECT *, trim(first_prompt) AS tp, regexp_extract(trim(first_prompt), '^[^.?!\n]*') AS head FROM (
    SELECT session_id, task_no, task_id, count(*) AS turns, min(started_at) AS started_at,
      last(ended_at ORDER BY turn_no) AS ended_at, first(prompt ORDER BY turn_no) AS first_prompt,
      last(stop_reason ORDER BY turn_no) AS last_stop
    FROM task_turns GROUP BY ALL))) b
LEFT JOIN (SELECT o.session_id, o.task_no, count(*) AS tool_calls,
             bool_or(name IN ('TaskCreate', 'TaskUpdate') AND NOT by_agent) AS has_task_events
           FROM turn_calls c JOIN owners o USING (session_id, turn_no) GROUP BY ALL) c USING (session_id, task_no)
LEFT JOIN (SELECT session_id, task_no, count(*) AS agent_n FROM agent_turns GROUP BY ALL) a USING (session_id, task_no)
LEFT JOIN (SELECT session_id, task_no, CAST(sum(active_us) AS BIGINT) AS active_us
           FROM turn_active JOIN task_turns USING (session_id, turn_no) GROUP BY ALL) v USING (session_id, task_no)""")

part("task_calls", "turn_calls", "task_turns")("""
SELECT c.*, t.task_no, row_number() OVER w AS idx, count(*) OVER (PARTITION BY c.session_id, t.task_no) AS n_calls,
  c.name = 'Bash' AND regexp_matches(input_json, 'pytest') AS verif,
  CASE WHEN NOT failed THEN NULL
    WHEN lead(name, 1) OVER w = name THEN CASE WHEN lead(input_json, 1) OVER w = input_json THEN 'identical' ELSE 'different' END
    WHEN lead(name, 2) OVER w = name THEN CASE WHEN lead(input_json, 2) OVER w = input_json THEN 'identical' ELSE 'different' END
    WHEN lead(name, 3) OVER w = name THEN CASE WHEN lead(input_json, 3) OVER w = input_json THEN 'identical' ELSE 'different' END
  END AS retry
FROM turn_calls c JOIN task_turns t USING (session_id, turn_no)
WINDOW w AS (PARTITION BY c.session_id, t.task_no ORDER BY c.turn_no, c.call_no)""")

part("signals_wide", "tasks", "task_calls", "turn_calls", "agent_turns", "turns")(r"""
SELECT t.session_id, t.task_no, t.task_id, t.title, t.started_at, t.turns, t.rework_turns, t.completed, t.in_progress,
  t.first_prompt, t.tool_calls AS all_calls, f.*, coalesce(agent_calls, 0) AS agent_calls, t.agent_turns,
  CASE WHEN turns = 0 THEN 0 ELSE rework_turns / turns END AS rework_ratio, CAST(turns AS DOUBLE) AS prompts_per_task,
  CASE WHEN NOT in_progress THEN CASE WHEN rework_turns = 0 AND completed THEN 1.0 ELSE 0.0 END END AS first_try_success,
  CASE WHEN regexp_matches(first_prompt, '(?i)(^|[^\p{L}\p{N}_])(que|the|der|las?)([^\p{L}\p{N}_]|$)') THEN 1.0 ELSE 0.0 END AS has_acceptance_criteria,
  peak / 1000.0 AS context_pressure,
  CASE WHEN read_tokens = 0 THEN 0 ELSE cached_tokens / read_tokens END AS cache_read_ratio,
  CASE WHEN searches + whole_reads = 0 THEN 1 ELSE searches / (searches + whole_reads) END AS load_precision,
  CAST(coalesce(sidechains, 0) AS DOUBLE) AS context_isolation, CAST(tools AS DOUBLE) AS harness_breadth,
  (skill_calls + skills) / calls AS skill_usage_rate, mcp_calls / calls AS mcp_utilization,
  failed_calls / calls AS tool_failure_rate, CASE WHEN verifications > 0 THEN 1.0 ELSE 0.0 END AS verification_present,
  calls / turns AS autonomy_ratio, parallel_steps / steps AS parallelism_index,
  CASE WHEN NOT in_progress THEN CASE WHEN coalesce(closing, false) THEN 1.0 ELSE 0.0 END END AS loop_closure,
  CASE WHEN plans > 0 THEN 1.0 ELSE 0.0 END AS plan_structure,
  CAST(greatest(spawns, t.agent_turns) AS DOUBLE) AS graph_depth,
  CASE WHEN different + identical = 0 THEN 0 ELSE different / (different + identical) END AS self_correction,
  coalesce(sidechains, 0) AS sidechains
FROM tasks t
JOIN (SELECT session_id AS s1, task_no AS t1, count(*) AS calls, count(DISTINCT name) AS tools,
  count(*) FILTER (name = 'Read' AND NOT input_json LIKE '%"offset"%' AND NOT input_json LIKE '%"limit"%') AS whole_reads,
  count(*) FILTER (name IN ('Grep', 'Glob')) AS searches, count(*) FILTER (name = 'Skill') AS skill_calls,
  count(*) FILTER (name LIKE 'mcp\_\_%' ESCAPE '\') AS mcp_calls, count(*) FILTER (failed) AS failed_calls,
  count(*) FILTER (verif) AS verifications, count(*) FILTER (name = 'TaskCreate') AS plans,
  count(*) FILTER (name IN ('Agent', 'Task')) AS spawns, count(*) FILTER (retry = 'identical') AS identical,
  count(*) FILTER (retry = 'different') AS different, count(*) AS steps, max(total_in) AS peak,
  CAST(sum(total_in) AS BIGINT) AS read_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cached_tokens,
  count(*) FILTER (tool_blocks > 1) AS parallel_steps, count(DISTINCT skill) AS skills,
  bool_or(idx = last_verif AND NOT failed AND idx >= n_calls - 2) AS closing
  FROM (SELECT *, max(CASE WHEN verif THEN idx END) OVER (PARTITION BY session_id, task_no) AS last_verif FROM task_calls)
  GROUP BY ALL) f ON f.s1 = t.session_id AND f.t1 = t.task_no
LEFT JOIN (SELECT a.session_id AS s2, a.task_no AS t2, count(*) AS agent_calls FROM turn_calls JOIN agent_turns a USING (session_id, turn_no)
           GROUP BY ALL) g ON g.s2 = t.session_id AND g.t2 = t.task_no
LEFT JOIN (SELECT session_id AS s3, count(*) AS sidechains FROM turns WHERE is_sidechain GROUP BY ALL) h ON h.s3 = t.session_id""")

_LEVELS = [
    ("has_acceptance_criteria", 1), ("rework_ratio", 1), ("first_try_success", 1), ("prompts_per_task", 1),
    ("context_pressure", 2), ("cache_read_ratio", 2), ("load_precision", 2), ("context_isolation", 2),
    ("harness_breadth", 3), ("tool_failure_rate", 3), ("verification_present", 3), ("skill_usage_rate", 3),
    ("mcp_utilization", 3), ("autonomy_ratio", 4), ("parallelism_index", 4), ("loop_closure", 4), ("plan_structure", 4),
    ("graph_depth", 5), ("self_correction", 5)]
part("signals", "signals_wide")("\nUNION ALL ".join(
    f"SELECT session_id, task_no, task_id, title, started_at, '{k}' AS signal, {lv} AS level, CAST({k} AS DOUBLE) AS value FROM signals_wide"
    for k, lv in _LEVELS))

part("specs")("""
SELECT * FROM (VALUES
 (1,'has_acceptance_criteria',1,0.60,true,true,'demande_non_executable'), (2,'rework_ratio',1,0.30,false,true,'demande_non_executable'),
 (3,'first_try_success',1,0.50,true,true,'demande_non_executable'), (4,'prompts_per_task',1,NULL,true,false,'demande_non_executable'),
 (5,'context_pressure',2,0.80,false,true,'fenetre_subie'), (6,'cache_read_ratio',2,0.50,true,true,'fenetre_subie'),
 (7,'load_precision',2,0.40,true,true,'chargement_large'), (8,'context_isolation',2,NULL,true,false,'fenetre_subie'),
 (9,'compaction_mode',2,NULL,true,true,'fenetre_subie'), (10,'harness_breadth',3,4,true,false,'agent_non_equipe'),
 (11,'tool_failure_rate',3,0.15,false,true,'agent_non_equipe'), (12,'verification_present',3,0.70,true,true,'rien_ne_prouve'),
 (13,'skill_usage_rate',3,NULL,true,true,'agent_non_equipe'), (14,'mcp_utilization',3,NULL,true,true,'agent_non_equipe'),
 (15,'autonomy_ratio',4,8,true,false,'boucle_incomplete'), (16,'parallelism_index',4,0.15,true,true,'boucle_incomplete'),
 (17,'loop_closure',4,0.60,true,true,'boucle_incomplete'), (18,'plan_structure',4,NULL,true,true,'boucle_incomplete'),
 (19,'graph_depth',5,NULL,true,false,'echec_sans_lecon'), (20,'self_correction',5,0.50,true,true,'echec_sans_lecon'))
 AS v(spec_order, signal, spec_level, target, higher, ratio, problem)""")


def words(pattern: str) -> str:
    r"""A ``\b(a|b)\b`` word pattern in RE2 syntax, with the word edges spelled out so that accents count as letters."""
    inner = pattern.removeprefix(r"\b").removesuffix(r"\b")
    edge = r"[^\p{L}\p{N}_]"
    return f"(?i)(^|{edge}){inner}({edge}|$)".replace("'", "''")
