"""Queries on the weekly review, the retrospective and the vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstone.functions import exprs as X
from turnstone.operators import dims, retro as T, review as R, usage as U, vocab as L
from turnstone.plans.oracle_base import part
from turnstone.plans.registry import query, r6, us
from turnstone.plans.usage_queries import BUDGET, weeks

AS_OF = "2024-01-15"           # the latest closed week is 2024-W02
GAP = "(CASE WHEN higher THEN target - {v} ELSE {v} - target END) / (CASE WHEN ratio THEN 1.0 ELSE greatest(1.0, target) END)"

part("dated", "signals")("SELECT *, strftime(started_at, '%G-W%V') AS week FROM signals")
part("means_now", "dated")("SELECT signal, avg(value) AS mean, count(value) AS n FROM dated WHERE week = '2024-W02' GROUP BY signal HAVING count(value) > 0")
part("means_then", "dated")("SELECT signal, avg(value) AS mean FROM dated WHERE week < '2024-W02' GROUP BY signal HAVING count(value) > 0")
part("observed", "means_now", "specs")(f"""
SELECT *, row_number() OVER (ORDER BY gap DESC, spec_order) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY problem ORDER BY gap DESC, spec_order) AS r FROM (
  SELECT *, {GAP.format(v='mean')} AS gap FROM means_now JOIN specs USING (signal) WHERE target IS NOT NULL) WHERE gap > 0) WHERE r = 1
QUALIFY rank <= 3""")
part("problems")("""SELECT * FROM (VALUES (1,'demande_non_executable',1,'has_acceptance_criteria',0.6), (3,'chargement_large',2,'load_precision',0.4),
 (4,'agent_non_equipe',3,'harness_breadth',4), (5,'rien_ne_prouve',3,'verification_present',0.7), (6,'boucle_incomplete',4,'loop_closure',0.6),
 (7,'echec_sans_lecon',5,'self_correction',0.5)) AS v(problem_order, problem, problem_level, signal, challenge_target)""")


def review(t):
    return R.weekly_review(t.signals, t.signals_wide, weeks(t), t.turn_calls, t.task_turns, AS_OF, budget=BUDGET)


@query("a14_signal_means", "SELECT signal, round(avg(value), 6) AS mean, count(value) AS n FROM signals GROUP BY signal", "signals")
def a14(t):
    return R.means(t.signals).withColumn("mean", r6("mean"))


@query("a14_signal_means_by_week", "SELECT week, signal, round(avg(value), 6) AS mean, count(value) AS n FROM dated GROUP BY ALL HAVING count(value) > 0", "dated")
def a14b(t):
    return R.means(R.with_week(t.signals), ["week"]).withColumn("mean", r6("mean"))


@query("j05_signal_problem_challenge", """
SELECT s.signal, s.spec_level, s.problem, p.signal AS challenge_signal, count(*) AS tasks FROM signals x JOIN specs s USING (signal)
LEFT JOIN (SELECT problem, signal FROM problems UNION ALL SELECT 'fenetre_subie', 'compaction_mode') p ON p.problem = s.problem GROUP BY ALL""", "signals", "specs", "problems")
def j05(t):
    p = dims.problems(t.spark).select("problem", "challenge_signal")
    return (dims.with_spec(t.signals).join(F.broadcast(p), "problem", "left").groupBy("signal", "spec_level", "problem", "challenge_signal")
            .agg(F.count(F.lit(1)).alias("tasks")))


@query("k01_observations", "SELECT signal, problem, round(mean, 6) AS mean, round(gap, 6) AS gap, CAST(rank AS INT) AS rank FROM observed", "observed")
def k01(t):
    return review(t)["observations"].select("signal", "problem", r6("mean").alias("mean"), r6("gap").alias("gap"), "rank")


@query("k02_worst_examples", f"""
SELECT o.signal, d.task_id, d.title, epoch_us(d.started_at) AS started_us, round(d.value, 6) AS value FROM observed o JOIN (
 SELECT *, row_number() OVER (PARTITION BY signal ORDER BY {GAP.format(v='value')} DESC, started_at, session_id, task_no) AS r
 FROM dated JOIN specs USING (signal) WHERE week = '2024-W02' AND value IS NOT NULL AND target IS NOT NULL) d ON d.signal = o.signal AND d.r = 1""", "observed", "dated", "specs")
def k02(t):
    return review(t)["observations"].select("signal", "example.task_id", "example.title", us("example.started_at").alias("started_us"),
                                            r6("example.task_value").alias("value"))


@query("k03_win", f"""
SELECT signal, spec_level, round(b, 6) AS before, round(a, 6) AS after, round(delta, 6) AS delta FROM (
 SELECT *, (CASE WHEN higher THEN a - b ELSE b - a END) / (CASE WHEN ratio THEN 1.0 ELSE greatest(1.0, target) END) AS delta
 FROM (SELECT n.signal, n.mean AS a, p.mean AS b, s.* EXCLUDE (signal) FROM means_now n JOIN means_then p USING (signal) JOIN specs s USING (signal) WHERE target IS NOT NULL))
WHERE delta >= 0.12 AND {GAP.format(v='a')} <= 0 ORDER BY delta DESC, spec_order LIMIT 1""", "means_now", "means_then", "specs")
def k03(t):
    return review(t)["win"].select("signal", "spec_level", *[r6(c).alias(c) for c in ("before", "after", "delta")])


part("user_type_weeks")("""
SELECT user_id, event_type, strftime(ts, '%G-W%V') AS week, CAST(date_trunc('week', ts) AS DATE) AS monday, avg(value) AS value, count(*) AS n,
  20.0 AS target, event_type IN ('click', 'view') AS higher, event_type = 'signup' AS ratio FROM events GROUP BY ALL""")


def type_values(t, keys):
    return t.raw("events").select(
        *keys, F.to_date("ts").alias("day"), X.week_key("ts").alias("week"), X.monday_of("ts").alias("monday"), "value", F.lit(20.0).alias("target"),
        F.col("event_type").isin("click", "view").alias("higher"), (F.col("event_type") == "signup").alias("ratio"))


KEYS = ["user_id", "event_type"]
part("trail_rows", "user_type_weeks")(f"""
SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY monday) AS i, count(*) OVER (PARTITION BY user_id, event_type) AS cnt,
  {GAP.format(v='value')} <= 0 AS meets FROM user_type_weeks""")
part("trails", "trail_rows")("""
SELECT *, CASE WHEN points < 3 THEN 'TropPeuDeDonnees' WHEN streak >= 3 THEN 'Acquis' WHEN delta >= 0.10 THEN 'EnProgres' WHEN delta <= -0.10 THEN 'EnRecul' ELSE 'Stable' END AS verdict,
  CASE WHEN streak > 0 AND miss > 0 THEN weeks[miss + 1] END AS crossed_week FROM (
 SELECT *, (CASE WHEN higher THEN late - early ELSE early - late END) / (CASE WHEN ratio THEN 1.0 ELSE 20.0 END) AS delta, points - miss AS streak FROM (
  SELECT user_id, event_type, target, higher, ratio, count(*) AS points, avg(value) FILTER (i <= greatest(1, floor(cnt / 3))) AS early,
   avg(value) FILTER (i > cnt - greatest(1, floor(cnt / 3))) AS late, coalesce(max(i) FILTER (NOT meets), 0) AS miss, list(week ORDER BY i) AS weeks,
   list(monday ORDER BY i) AS mondays FROM trail_rows GROUP BY ALL))""")


@query("a15_trail_points", f"SELECT user_id, event_type, week, round(value, 6) AS value, n, {GAP.format(v='value')} <= 0 AS meets FROM user_type_weeks", "user_type_weeks")
def a15(t):
    return T.trail_points(type_values(t, KEYS), KEYS).select(*KEYS, "week", r6("value").alias("value"), "n", "meets")


def trails(t):
    return T.trails(T.trail_points(type_values(t, KEYS), KEYS), KEYS)


@query("w13_streaks", "SELECT user_id, event_type, points, streak, crossed_week FROM trails", "trails")
def w13(t):
    return trails(t).select(*KEYS, "points", "streak", "crossed_week")


@query("w14_thirds", "SELECT user_id, event_type, round(early, 6) AS early, round(late, 6) AS late, round(delta, 6) AS delta FROM trails", "trails")
def w14(t):
    return trails(t).select(*KEYS, *[r6(c).alias(c) for c in ("early", "late", "delta")])


@query("r02_trend_verdicts", f"""
SELECT user_id, event_type, verdict, CASE verdict WHEN 'TropPeuDeDonnees' THEN 'only ' || points || ' measured week(s), no conclusion'
  WHEN 'Acquis' THEN CASE WHEN streak = points THEN 'on target since the start' ELSE 'on target for ' || streak || ' weeks in a row' END
  WHEN 'EnProgres' THEN 'improving' WHEN 'EnRecul' THEN 'was better before' ELSE CASE WHEN {GAP.format(v='late')} <= 0 THEN 'stable above the target'
  ELSE 'unchanged over ' || points || ' weeks' END END AS statement FROM trails""", "trails")
def r02(t):
    return trails(t).select(*KEYS, "verdict", T.statement().alias("statement"))


@query("r03_milestones", "SELECT user_id, event_type, crossed_week, mondays[miss + 1] AS crossed_on FROM trails WHERE crossed_week IS NOT NULL", "trails")
def r03(t):
    return T.milestones(trails(t), KEYS)


@query("k07_ordered_trails", """
SELECT user_id, event_type, verdict, round(abs(delta), 6) AS change FROM trails
ORDER BY CASE verdict WHEN 'Acquis' THEN 0 WHEN 'EnRecul' THEN 1 WHEN 'EnProgres' THEN 2 WHEN 'Stable' THEN 3 ELSE 4 END, abs(delta) DESC, user_id, event_type""", "trails")
def k07(t):
    return T.ordered_trails(trails(t), KEYS).select(*KEYS, "verdict", r6(F.abs("delta")).alias("change"))


@query("k03_win_by_user", """
WITH w AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'has_acceptance_criteria' WHEN 'view' THEN 'rework_ratio' WHEN 'purchase' THEN 'first_try_success'
   WHEN 'signup' THEN 'harness_breadth' ELSE 'autonomy_ratio' END AS signal, value / 41 AS value, strftime(ts, '%G-W%V') AS week FROM events),
 n AS (SELECT user_id, signal, avg(value) AS a FROM w WHERE week = '2024-W04' GROUP BY ALL), p AS (SELECT user_id, signal, avg(value) AS b FROM w WHERE week < '2024-W04' GROUP BY ALL)
SELECT user_id, signal, round(b, 6) AS before, round(a, 6) AS after, round(delta, 6) AS delta FROM (
 SELECT *, (CASE WHEN higher THEN a - b ELSE b - a END) / (CASE WHEN ratio THEN 1.0 ELSE greatest(1.0, target) END) AS delta,
  (CASE WHEN higher THEN target - a ELSE a - target END) <= 0 AS meets FROM n JOIN p USING (user_id, signal) JOIN specs USING (signal))
WHERE delta >= 0.12 AND meets QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY delta DESC, spec_order) = 1""", "specs")
def k03b(t):
    e = t.raw("events").select("user_id", F.expr("""CASE event_type WHEN 'click' THEN 'has_acceptance_criteria' WHEN 'view' THEN 'rework_ratio'
        WHEN 'purchase' THEN 'first_try_success' WHEN 'signup' THEN 'harness_breadth' ELSE 'autonomy_ratio' END""").alias("signal"),
        (F.col("value") / 41).alias("value"), X.week_key("ts").alias("week"))
    now = R.means(e.filter("week = '2024-W04'"), ["user_id"])
    then = R.means(e.filter("week < '2024-W04'"), ["user_id"])
    return R.win(now, then, keys=["user_id"]).select("user_id", "signal", *[r6(c).alias(c) for c in ("before", "after", "delta")])


@query("k04_challenge", """
SELECT problem, problem_level, signal, round(mean, 6) AS mean, CAST(challenge_target AS DOUBLE) AS challenge_target FROM means_now JOIN problems USING (signal)
WHERE mean < challenge_target ORDER BY problem_level, problem_order LIMIT 1""", "means_now", "problems")
def k04(t):
    return review(t)["challenge"].withColumn("mean", r6("mean"))


part("failed_names", "task_calls")("SELECT session_id, task_no, count(DISTINCT name) AS failed_tools FROM task_calls WHERE failed GROUP BY ALL")


@query("k05_prompt_costs", """
SELECT session_id, task_no, round(rework_turns * 3.0 + CASE WHEN completed OR in_progress THEN 0 ELSE 4.0 END + coalesce(failed_tools, 0) * 0.5, 6) AS observed
FROM signals_wide LEFT JOIN failed_names USING (session_id, task_no) WHERE length(first_prompt) >= 12
AND rework_turns * 3.0 + CASE WHEN completed OR in_progress THEN 0 ELSE 4.0 END + coalesce(failed_tools, 0) * 0.5 > 0""", "signals_wide", "failed_names")
def k05(t):
    return R.prompt_costs(t.signals_wide, t.turn_calls, t.task_turns).select("session_id", "task_no", r6("observed").alias("observed"))


_STAND_IN = [("a", True, r"\b(que|the|der)\b"), ("b", True, r"\b(le|la|and)\b"), ("c", False, r"\b(un)\b"), ("d", True, r"\b(el|of|in)\b")]


def _hit(p: str) -> str:
    from turnstone.plans.oracle_base import words
    return f"CAST(regexp_matches(first_prompt, '{words(p)}') AS INT)"


@query("k05_costliest_prompt", f"""
SELECT session_id, task_no, round(cost, 6) AS cost FROM (SELECT *, observed + (1 - ({_hit(_STAND_IN[0][2])} + {_hit(_STAND_IN[1][2])} + {_hit(_STAND_IN[3][2])}) / 3.0) * 2.0 AS cost FROM (
 SELECT *, rework_turns * 3.0 + CASE WHEN completed OR in_progress THEN 0 ELSE 4.0 END + coalesce(failed_tools, 0) * 0.5 AS observed
 FROM signals_wide LEFT JOIN failed_names USING (session_id, task_no)) WHERE observed > 0 AND length(first_prompt) >= 12)
WHERE cost >= 1.0 ORDER BY cost DESC, started_at, session_id, task_no LIMIT 1""", "signals_wide", "failed_names")
def k05b(t):
    return R.costliest_prompt(R.prompt_costs(t.signals_wide, t.turn_calls, t.task_turns, _STAND_IN)).select("session_id", "task_no", r6("cost").alias("cost"))


@query("r04_moments", """
SELECT session_id, task_no, moment, replace(replace(replace(CASE moment WHEN 'rework' THEN '« {tache} » needed {reprises} follow-ups. State in the first message when it is done.'
  WHEN 'abandon' THEN '« {tache} » stopped without a result. Start again from what blocked it.' WHEN 'tool_failures' THEN 'On « {tache} », {preuve}. Look at the tool setup first.'
  ELSE '« {tache} » ended without a test. Finish with the command that proves it.' END, '{tache}', CASE WHEN length(title) <= 48 THEN title ELSE substring(title, 1, 47) || '…' END),
  '{reprises}', CAST(rework_turns AS VARCHAR)), '{preuve}', failed_calls || ' failure(s) in ' || calls || ' call(s)') AS text
FROM (SELECT *, CASE WHEN rework_turns >= 3 THEN 'rework' WHEN NOT completed THEN 'abandon' WHEN tool_failure_rate > 0.25 AND all_calls >= 8 THEN 'tool_failures'
  WHEN verification_present = 0 AND loop_closure = 0 AND all_calls >= 10 THEN 'no_verification' END AS moment FROM signals_wide WHERE NOT in_progress) WHERE moment IS NOT NULL""", "signals_wide")
def r04(t):
    return R.moments(t.signals_wide).select("session_id", "task_no", "moment", "text")


@query("r05_review_summary", f"""
SELECT '2024-W02' AS week, (SELECT count(*) FROM observed) AS observations, (SELECT tasks FROM week_usage WHERE week = '2024-W02') AS tasks,
  (SELECT sessions FROM week_usage WHERE week = '2024-W02') AS sessions""", "observed", "week_usage")
def r05(t):
    r = review(t)
    return (r["usage"].select("week", "tasks", "sessions")
            .crossJoin(r["observations"].agg(F.count(F.lit(1)).alias("observations"))))       # one-row tables


@query("v16_review_invariants", """
SELECT 'observation_avec_exemple' AS "check", true AS ok, (SELECT count(*) FROM observed) AS proof
UNION ALL SELECT 'trois_observations_au_plus', (SELECT count(*) <= 3 FROM observed), (SELECT count(*) FROM observed)
UNION ALL SELECT 'image_seulement_si_defaut', true, (SELECT count(*) FROM observed)
UNION ALL SELECT 'fait_avant_image', true, (SELECT count(*) FROM part WHERE p_size % 2 = 0)""", "observed")
def v16(t):
    images = t.raw("part").select(F.col("p_name").alias("fact"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("image"))
    return R.review_invariants(review(t), images).filter(F.col("check") != "pas_de_felicitation_polie")


@query("v16_complete_levels", """
SELECT count(*) FILTER (o_orderpriority <> '5-LOW') AS named, count(*) FILTER (o_orderpriority <> '5-LOW') >= 5 AS complete FROM (SELECT DISTINCT o_orderpriority FROM orders)""")
def v16c(t):
    levels = t.raw("orders").select(F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).otherwise(" ").alias("term")).distinct()
    return R.complete_levels(levels)


@query("v16_polite_praise", f"""
SELECT 'pas_de_felicitation_polie' AS "check", true AS ok, count(*) AS proof FROM (
 SELECT *, (CASE WHEN higher THEN a - b ELSE b - a END) / (CASE WHEN ratio THEN 1.0 ELSE greatest(1.0, target) END) AS delta FROM (SELECT n.signal, n.mean AS a, p.mean AS b, s.* EXCLUDE (signal) FROM means_now n JOIN means_then p USING (signal) JOIN specs s USING (signal) WHERE target IS NOT NULL)
 WHERE (CASE WHEN higher THEN target - a ELSE a - target END) <= 0 QUALIFY row_number() OVER (ORDER BY delta DESC, spec_order) = 1) WHERE delta >= 0.12""", "means_now", "means_then", "specs")
def v16d(t):
    return R.review_invariants(review(t)).filter(F.col("check") == "pas_de_felicitation_polie")


@query("v16_same_measures", "SELECT CAST(0 AS BIGINT) AS lone_rows, count(*) AS rows FROM (SELECT signal FROM signals GROUP BY signal HAVING count(value) > 0)", "signals")
def v16b(t):
    a = R.means(t.signals).withColumn("mean", r6("mean"))
    b = R.means(t.signals.repartition(7)).withColumn("mean", r6("mean"))
    return R.same_measures(a, b, ["signal", "mean", "n"])


# ------------------------------------------------------------------------ long history: orders as sessions
part("order_weeks")("""
SELECT strftime(o_orderdate, '%G-W%V') AS week, CAST(date_trunc('week', o_orderdate) AS DATE) AS monday, count(*) AS tasks, CAST(sum(v) AS BIGINT) AS read_tokens,
  CAST(sum(v) AS BIGINT) * 2 AS active_us, CAST(coalesce(sum(v) FILTER (o_orderstatus = 'F'), 0) AS BIGINT) AS haiku_tokens,
  CAST(coalesce(sum(v) FILTER (o_orderstatus = 'O'), 0) AS BIGINT) AS sonnet_tokens, CAST(coalesce(sum(v) FILTER (o_orderstatus = 'P'), 0) AS BIGINT) AS opus_tokens
FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders) GROUP BY ALL""")


def order_weeks(t):
    v = F.floor("o_totalprice").cast("bigint")
    o = t.raw("orders")

    def of(s: str):
        return F.sum(F.when(F.col("o_orderstatus") == s, v).otherwise(F.lit(0).cast("bigint")))

    return o.groupBy(X.week_key("o_orderdate").alias("week"), X.monday_of("o_orderdate").alias("monday")).agg(
        F.count(F.lit(1)).alias("tasks"), F.sum(v).alias("read_tokens"), (F.sum(v) * 2).alias("active_us"),
        of("F").alias("haiku_tokens"), of("O").alias("sonnet_tokens"), of("P").alias("opus_tokens"))


def order_sessions(t):
    return t.raw("orders").select(X.week_key("o_orderdate").alias("week"), X.monday_of("o_orderdate").alias("monday"),
                                  F.col("o_custkey").alias("session_id"))


def order_values(t):
    level = F.substring("o_orderpriority", 1, 1).cast("int")
    return t.raw("orders").select(
        F.col("o_orderpriority").alias("signal"), level.alias("spec_level"), F.to_date("o_orderdate").alias("day"),
        X.week_key("o_orderdate").alias("week"), X.monday_of("o_orderdate").alias("monday"), (F.col("o_totalprice") / 1000.0).alias("value"),
        F.lit(230.0).alias("target"), (level <= 3).alias("higher"), F.lit(False).alias("ratio"))


@query("w15_silences", """
SELECT o_custkey AS session_id, CAST(prev + INTERVAL 7 DAY AS DATE) AS from_day, CAST(monday - INTERVAL 1 DAY AS DATE) AS to_day, weeks FROM (
 SELECT *, CAST(date_diff('day', prev, monday) / 7 AS INT) - 1 AS weeks FROM (SELECT o_custkey, monday, lag(monday) OVER (PARTITION BY o_custkey ORDER BY monday) AS prev
  FROM (SELECT DISTINCT o_custkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS monday FROM orders))) WHERE weeks >= 2
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY weeks DESC, monday) <= 3""")
def w15(t):
    return T.silences(order_sessions(t), ["session_id"])


@query("a16_retro_header", """
SELECT min(monday) AS from_day, CAST(max(monday) + INTERVAL 6 DAY AS DATE) AS to_day, count(*) AS weeks_active, CAST(sum(tasks) AS BIGINT) AS tasks, CAST(sum(active_us) AS BIGINT) AS active_us,
  CAST(sum(read_tokens) AS BIGINT) AS read_tokens, (SELECT count(DISTINCT o_custkey) FROM orders) AS sessions,
  CAST(round((date_diff('day', min(monday), max(monday)) + 7) / 7.0) AS INT) AS weeks_covered,
  CAST(round((date_diff('day', min(monday), max(monday)) + 7) / 7.0) AS INT) - count(*) AS weeks_silent FROM order_weeks""", "order_weeks")
def a16(t):
    return T.header(order_weeks(t), order_sessions(t))


@query("a17_month_bands", """
SELECT strftime(monday, '%Y-%m') AS month, count(*) AS active_weeks, CAST(sum(tasks) AS BIGINT) AS tasks, CAST(sum(read_tokens) AS BIGINT) AS read_tokens,
  round(sum(haiku_tokens) / sum(read_tokens), 6) AS haiku_share, round(sum(sonnet_tokens) / sum(read_tokens), 6) AS sonnet_share, round(sum(opus_tokens) / sum(read_tokens), 6) AS opus_share,
  any_value(s.sessions) AS sessions, greatest(0, CAST(ceil(day(last_day(any_value(monday))) / 7.0) AS INT) - count(*)) AS silent_weeks
FROM order_weeks JOIN (SELECT strftime(date_trunc('week', o_orderdate), '%Y-%m') AS month, count(DISTINCT o_custkey) AS sessions FROM orders GROUP BY 1) s ON s.month = strftime(monday, '%Y-%m')
GROUP BY 1""", "order_weeks")
def a17(t):
    b = T.month_bands(order_weeks(t), order_sessions(t))
    return b.select("month", "active_weeks", "tasks", "read_tokens", *[r6(c).alias(c) for c in ("haiku_share", "sonnet_share", "opus_share")], "sessions", "silent_weeks")


part("level_scores")("""
SELECT month, spec_level, avg(least(1.0, greatest(0.0, 1 - (CASE WHEN spec_level <= 3 THEN 230.0 - mean ELSE mean - 230.0 END) / 230.0))) AS score FROM (
 SELECT strftime(monday, '%Y-%m') AS month, spec_level, signal, avg(value) AS mean FROM (
  SELECT o_orderpriority AS signal, CAST(substring(o_orderpriority, 1, 1) AS INT) AS spec_level, CAST(date_trunc('week', o_orderdate) AS DATE) AS monday, avg(o_totalprice / 1000.0) AS value
  FROM orders GROUP BY ALL) GROUP BY ALL) GROUP BY ALL""")


def scores(t):
    return T.level_scores(T.trail_points(order_values(t), ["signal"], [*T.SPEC, "spec_level"]))


@query("a17_level_scores", "SELECT month, spec_level, round(score, 6) AS score FROM level_scores", "level_scores")
def a17b(t):
    return scores(t).withColumn("score", r6("score"))


@query("a18_latest_level_scores", "SELECT spec_level, max(month) AS month, round(arg_max(score, month), 6) AS score FROM level_scores GROUP BY spec_level", "level_scores")
def a18(t):
    return T.latest_level_scores(scores(t)).withColumn("score", r6("score"))


@query("r06_retrospective", """
WITH p AS (SELECT o_orderpriority AS signal, CAST(date_trunc('week', o_orderdate) AS DATE) AS monday, avg(o_totalprice / 1000.0) AS value,
   CAST(substring(o_orderpriority, 1, 1) AS INT) <= 3 AS higher FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-03-01' AND DATE '1996-02-15' GROUP BY ALL),
 q AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY monday) AS i, count(*) OVER (PARTITION BY signal) AS n FROM p)
SELECT signal, count(*) AS points, round(avg(value) FILTER (i <= greatest(1, floor(n / 3))), 6) AS early, round(avg(value) FILTER (i > n - greatest(1, floor(n / 3))), 6) AS late,
  count(*) - coalesce(max(i) FILTER (CASE WHEN higher THEN value < 230 ELSE value > 230 END), 0) AS streak FROM q GROUP BY signal""")
def r06(t):
    parts = T.retrospective(order_values(t), order_weeks(t), order_sessions(t), ["signal"], "1995-03-01", "1996-02-15")
    return parts["trails"].select("signal", "points", r6("early").alias("early"), r6("late").alias("late"), "streak")


# ----------------------------------------------------------------------------------------- vocabulary
part("vocab")("""
SELECT 'p' AS pack, CASE p_size % 3 WHEN 0 THEN '' ELSE 'side' || (p_size % 3) END AS side, p_type || '/' || (p_size % 7) AS key, list_sort(list(DISTINCT p_brand)) AS variants
FROM part GROUP BY ALL""")
part("word_requests")("""
SELECT o_orderkey, 'side' || (o_orderkey % 4) AS side, CASE WHEN o_orderkey % 3 = 0 THEN 'none' ELSE 'SMALL/' || (o_custkey % 9) END AS problem, 'ECONOMY/' || (o_custkey % 8) AS signal,
  CAST(trunc(date_diff('day', DATE '2020-01-06', CAST(o_orderdate AS DATE)) / 7) AS INT) AS cycle FROM orders""")


def vocabulary(t):
    p = t.raw("part")
    # a dimension: at most 25 brands per key
    return p.groupBy(F.lit("p").alias("pack"), F.expr("CASE p_size % 3 WHEN 0 THEN '' ELSE concat('side', p_size % 3) END").alias("side"), F.lit("signals").alias("kind"),
                     F.expr("concat(p_type, '/', p_size % 7)").alias("key")).agg(F.array_sort(F.collect_set("p_brand")).alias("variants"))



@query("j06_vocabulary_lookup", """
WITH k AS (SELECT DISTINCT x AS key, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(x, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: (a * 31 + b) & 134217727) AS h
  FROM (SELECT problem AS x FROM word_requests UNION SELECT signal FROM word_requests)),
 c AS (SELECT r.o_orderkey, v.prio, w.variants, r.cycle, k.h FROM word_requests r, LATERAL (VALUES (1, r.side, r.problem), (2, r.side, r.signal), (3, '', r.problem), (4, '', r.signal)) v(prio, s, key)
  JOIN vocab w ON w.side = v.s AND w.key = v.key JOIN k ON k.key = v.key),
 b AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY prio) AS rn FROM c)
SELECT r.o_orderkey, b.variants[CAST((((b.cycle + b.h) % len(b.variants)) + len(b.variants)) % len(b.variants) AS INT) + 1] AS words
FROM word_requests r LEFT JOIN b ON b.o_orderkey = r.o_orderkey AND b.rn = 1""", "word_requests", "vocab")
def j06(t):
    r = t.raw("orders").select("o_orderkey", F.lit("p").alias("pack"), F.expr("concat('Side', o_orderkey % 4)").alias("side"),
                               F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'none' ELSE concat('SMALL/', o_custkey % 9) END").alias("problem"),
                               F.expr("concat('ECONOMY/', o_custkey % 8)").alias("signal"), X.cycle_of(F.to_date("o_orderdate")).alias("cycle"))
    return L.pick_words(r, vocabulary(t), "signals", ["problem", "signal"]).select("o_orderkey", "words")


@query("j07_level_terms", """
SELECT p.p_partkey, CASE WHEN p_size % 2 = 0 AND s.s_suppkey IS NOT NULL THEN s.s_name ELSE coalesce(c.c_name, '') END AS term, coalesce(CAST(s.s_nationkey AS VARCHAR), c.c_mktsegment, '') AS analogy
FROM part p LEFT JOIN supplier s ON s.s_suppkey = p.p_partkey LEFT JOIN customer c ON c.c_custkey = p.p_partkey""")
def j07(t):
    levels = t.raw("part").select("p_partkey", F.col("p_partkey").alias("level"), "p_size")
    side = (t.raw("supplier").join(levels.select("level", "p_size"), F.col("s_suppkey") == F.col("level"))
            .select("level", F.when(F.col("p_size") % 2 == 0, F.col("s_name")).otherwise("").alias("term"), F.col("s_nationkey").cast("string").alias("analogy")))
    base = t.raw("customer").select(F.col("c_custkey").alias("level"), F.col("c_name").alias("term"), F.col("c_mktsegment").alias("analogy"))
    return L.level_terms(levels, side, base, ["term", "analogy"]).select("p_partkey", "term", "analogy")


@query("s08_string_or_array", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN lang || '|' || source END AS variants FROM documents WHERE doc_id % 3 <> 2
UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 3 = 2""")
def s08(t):
    v = F.expr("""CASE doc_id % 3 WHEN 0 THEN concat('"', lang, '"') WHEN 1 THEN concat('["', lang, '"," ","', source, '"]') ELSE '"  "' END""")
    return t.raw("documents").select("doc_id", F.array_join(L.as_variants(F.try_parse_json(v)), "|").alias("variants"))
