"""Queries that write the session tables as files and read them back through the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from turnstone.operators import dims, events as E, review as R, transcript as TR, usage as U
from turnstone.plans.bridge import IDLE_MINUTES
from turnstone.plans.event_queries import log, windows
from turnstone.plans.oracle_base import PARTS, part
from turnstone.plans.registry import query, r6, us
from turnstone.plans.review_queries import AS_OF
from turnstone.plans.usage_queries import BUDGET
from turnstone.plans.usage_queries import _LEARNERS, spend, weeks
from turnstone.session import shared_dir, stored
from turnstone.sources import files as SF, spend as SP, transcripts as ST


_LINE_COLUMNS = {"call_no", "call_id", "name", "input_json", "tool_blocks", "called_at", "result_at", "skill", "model", "input_tokens", "cache_read_tokens",
                 "cache_creation_tokens", "output_tokens", "failure_reason"}


def transcript_folder(t) -> str:
    """The bridge sessions as transcript lines, in file order, with broken, empty and injected lines in between."""
    if hasattr(t, "_transcripts"):
        return t._transcripts
    sid = F.col("session_id").cast("string")
    at = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    k, big = ["session_id", "turn_no"], lambda x: (F.lit(x) if isinstance(x, int) else F.col(x)).cast("bigint")

    def row(df, kind, order, *columns):
        return df.select("session_id", *[big(o).alias(f"o{i}") for i, o in enumerate(order)], F.lit(kind).alias("kind"), *columns)

    # rows are dealt and sorted before their lines are made: the shuffle carries columns, and a call is one row for its two lines
    c = t.turn_calls.join(t.turns.select(*k, "is_sidechain", "stop_reason"), k)
    rows = (row(t.turns, "turn", ("turn_no", -1, 0), "turn_no", "is_sidechain", "started_at", "prompt")
            .unionByName(row(c, "call", ("turn_no", 0, "call_no"), "is_sidechain", "stop_reason", *[x for x in t.turn_calls.columns if x in _LINE_COLUMNS]), allowMissingColumns=True))
    noise = t.turns.filter("turn_no = 0").select("session_id", F.explode(F.array(*[big(i) for i in range(3)])).alias("i"))
    rows = rows.unionByName(row(noise, "noise", (99, "i", 0)), allowMissingColumns=True)

    def line(*fields):
        return F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})

    human = line(F.lit("user").alias("type"), sid.alias("sessionId"), at("started_at").alias("timestamp"),
                 F.concat(F.lit("p"), "turn_no").alias("promptId"), F.struct(F.lit("human").alias("kind")).alias("origin"), F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")).alias("message"))
    injected = line(F.lit("user").alias("type"), sid.alias("sessionId"), at("started_at").alias("timestamp"), F.lit(True).alias("isMeta"),
                    F.struct(F.lit("user").alias("role"), F.lit("<system-reminder>x</system-reminder>").alias("content")).alias("message"))
    last = F.col("call_no") % 5 == 4
    use = F.concat(F.lit('[{"type":"tool_use","id":"c'), "call_id", F.lit('","name":"'), "name", F.lit('","input":'), "input_json", F.lit("}"),
                   F.repeat(F.lit(',{"type":"tool_use","name":"more","input":{}}'), (F.col("tool_blocks") - 1).cast("int")), F.lit("]"))
    answer = F.concat(F.lit('{"type":"assistant","sessionId":"'), sid, F.lit('","timestamp":"'), at("called_at"), F.lit('","isSidechain":'), F.col("is_sidechain").cast("string"),
                      F.when(F.col("skill").isNotNull(), F.concat(F.lit(',"attributionSkill":"'), "skill", F.lit('"'))).otherwise(""),
                      F.lit(',"message":{"model":"'), "model", F.lit('","content":'), use, F.when(last & F.col("stop_reason").isNotNull(), F.concat(F.lit(',"stop_reason":"'), "stop_reason", F.lit('"'))).otherwise(""),
                      F.lit(',"usage":{"input_tokens":'), "input_tokens", F.lit(',"cache_read_input_tokens":'), "cache_read_tokens", F.lit(',"cache_creation_input_tokens":'), "cache_creation_tokens",
                      F.lit(',"output_tokens":'), "output_tokens", F.lit("}}}"))
    result = F.struct(F.lit("tool_result").alias("type"), F.concat(F.lit("c"), F.col("call_id").cast("string")).alias("tool_use_id"), F.lit("done").alias("content"),
                      F.when(F.col("failure_reason") == "is_error", True).alias("is_error"))
    back = line(F.lit("user").alias("type"), sid.alias("sessionId"), at("result_at").alias("timestamp"),
                F.struct(F.lit("user").alias("role"), F.array(result).alias("content")).alias("message"), F.struct(F.when(F.col("failure_reason") == "code=1", 1).alias("code"), F.lit(False).alias("interrupted")).alias("toolUseResult"))
    junk = F.when(F.col("o1") == 0, "{not json").when(F.col("o1") == 1, "[1,2,3]").otherwise("")
    lines = (F.when(F.col("kind") == "turn", F.when(~F.col("is_sidechain"), F.array(human, injected)).otherwise(F.array(injected)))
             .when(F.col("kind") == "call", F.when(F.col("result_at").isNotNull(), F.array(answer, back)).otherwise(F.array(answer))).otherwise(F.array(junk)))
    path = f"{shared_dir(t.spark)}/transcripts-{uuid.uuid4().hex}"
    order = ["session_id", "o0", "o1", "o2"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.explode(lines).alias("value")).write.text(path)
    t._transcripts = path
    return path


def scanned(t):
    if not hasattr(t, "_scanned"):
        t._scanned = stored(ST.scan(ST.number_lines(ST.read_lines(t.spark, transcript_folder(t), "*.txt"))), "scanned")
    return t._scanned


def rebuilt(t):
    if not hasattr(t, "_rebuilt"):
        parts = TR.build_sessions(ST.records(scanned(t)))
        t._rebuilt = {n: stored(parts[n], f"rebuilt-{n}") for n in ("sessions", "turns", "steps", "calls", "turn_skills")}
    return t._rebuilt


@query("s01_file_discovery", "SELECT true AS found, CAST(0 AS BIGINT) AS in_absent_folder FROM turns LIMIT 1", "turns")
def s01(t):
    folder = transcript_folder(t)
    found = ST.list_files(t.spark, folder, "*.txt").agg((F.count(F.lit(1)) > 0).alias("found"))
    return found.crossJoin(ST.list_files(t.spark, folder + "/absent").agg(F.count(F.lit(1)).alias("in_absent_folder")))       # two one-row tables


@query("s02_tolerant_scan", """
WITH n AS (SELECT (SELECT count(*) FROM turns WHERE NOT is_sidechain) + (SELECT count(*) FROM turns) + (SELECT count(*) FROM turn_calls) + (SELECT count(*) FROM turn_calls WHERE result_at IS NOT NULL) AS kept, (SELECT count(DISTINCT session_id) FROM turns) AS s)
SELECT kept + 2 * s AS lines_read, 2 * s AS lines_unreadable, kept AS records_kept, round(2 * s / (kept + 2 * s), 6) AS unreadable_rate, 2 * s / (kept + 2 * s) > 0.02 AS looks_broken FROM n""", "turns", "turn_calls")
def s02(t):
    return TR.parse_report(scanned(t)).withColumn("unreadable_rate", r6("unreadable_rate"))


@query("s03_file_cap", "SELECT CAST(1 AS BIGINT) AS files, true AS fewer FROM turns LIMIT 1", "turns")
def s03(t):
    capped = ST.read_lines(t.spark, transcript_folder(t), "*.txt", limit_files=1)
    return capped.agg(F.count_distinct("file").alias("files"), (F.count(F.lit(1)) > 0).alias("fewer"))


@query("s04_modified_after", "SELECT CAST(0 AS BIGINT) AS late, true AS early FROM turns LIMIT 1", "turns")
def s04(t):
    folder = transcript_folder(t)
    late = ST.read_lines(t.spark, folder, "*.txt", modified_after="2100-01-01T00:00:00").agg(F.count(F.lit(1)).alias("late"))
    early = ST.read_lines(t.spark, folder, "*.txt", modified_after="2000-01-01T00:00:00").agg((F.count(F.lit(1)) > 0).alias("early"))
    return late.crossJoin(early)           # two one-row tables


@query("e02_records_of_many_files", """
SELECT type, sum(n) AS n FROM (SELECT 'user' AS type, count(*) AS n FROM turns WHERE NOT is_sidechain UNION ALL SELECT 'user', count(*) FROM turns UNION ALL SELECT 'assistant', count(*) FROM turn_calls
 UNION ALL SELECT 'user', count(*) FROM turn_calls WHERE result_at IS NOT NULL) GROUP BY type""", "turns", "turn_calls")
def e02(t):
    return TR.histogram(ST.records(scanned(t)), "type").select(F.col("value").alias("type"), "n")


@query("w02_rebuilt_turns", """
SELECT CAST(session_id AS VARCHAR) AS session_id, turn_no, CASE WHEN is_sidechain THEN '' ELSE trim(prompt) END AS prompt, is_sidechain, epoch_us(started_at) AS started_us, epoch_us(ended_at) AS ended_us, stop_reason FROM turns""", "turns")
def w02r(t):
    return rebuilt(t)["turns"].select("session_id", "turn_no", "prompt", "is_sidechain", us("started_at").alias("started_us"), us("ended_at").alias("ended_us"), "stop_reason")


@query("w03_rebuilt_steps", """
SELECT CAST(session_id AS VARCHAR) AS session_id, turn_no, count(*) AS steps, max(total_in) AS peak, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(tool_blocks) AS BIGINT) AS tool_blocks, count(DISTINCT model) AS models FROM turn_calls GROUP BY ALL""", "turn_calls")
def w03r(t):
    total = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_creation_tokens")
    return rebuilt(t)["steps"].groupBy("session_id", "turn_no").agg(F.count(F.lit(1)).alias("steps"), F.max(total).alias("peak"), F.sum("output_tokens").alias("output_tokens"),
                                                                    F.sum("tool_blocks").alias("tool_blocks"), F.count_distinct("model").alias("models"))


@query("j01_rebuilt_calls", """
SELECT CAST(session_id AS VARCHAR) AS session_id, turn_no, 'c' || call_id AS tool_use_id, name, input_json, epoch_us(called_at) AS called_us, epoch_us(result_at) AS result_us, failed AND result_at IS NOT NULL AS failed, CASE WHEN result_at IS NOT NULL THEN failure_reason END AS failure_reason, round(duration_ms, 3) AS duration_ms FROM turn_calls""", "turn_calls")
def j01r(t):
    c = rebuilt(t)["calls"]
    return c.select("session_id", "turn_no", "tool_use_id", "name", "input_json", us("called_at").alias("called_us"), us("result_at").alias("result_us"), "failed", "failure_reason", F.round("duration_ms", 3).alias("duration_ms"))


@query("w01_rebuilt_sessions", """
SELECT CAST(session_id AS VARCHAR) AS session_id, epoch_us(min(called_at)) AS started_us, epoch_us(greatest(max(called_at), max(result_at))) AS ended_us FROM turn_calls GROUP BY session_id""", "turn_calls")
def w01r(t):
    return rebuilt(t)["sessions"].select("session_id", us("started_at").alias("started_us"), us("ended_at").alias("ended_us"))


# -------------------------------------------------------------------------------------- spend report
@query("s05_spend_csv", f"SELECT person, prompt_tokens, completion_tokens, requests, spend, opus_tokens FROM ({_LEARNERS})", "spend")
def s05(t):
    s = spend(t)
    path = f"{shared_dir(t.spark)}/spend-{uuid.uuid4().hex}"
    s.select(F.col("email").alias("User Email"), F.lit("u,1").alias("Account UUID"), F.concat(F.lit('say "'), "product", F.lit('"\nline')).alias("Product"), F.col("model").alias("Model"), F.lit("x").alias("Model Family"),
             F.col("requests").alias("Request Count"), F.format_number("prompt_tokens", 0).alias("Prompt Tokens"), F.col("completion_tokens").alias("Completion Tokens"),
             F.concat(F.lit("$"), F.col("net").cast("string")).alias("Net Spend (USD)"), F.concat(F.col("gross").cast("string"), F.lit(" $")).alias("Gross Spend (USD)")).write.csv(path, header=True, quote='"', escape='"', quoteAll=True)
    rows, _ = SP.read_spend(t.spark, path)
    return U.learner_spend(rows, ["email"]).select("person", "prompt_tokens", "completion_tokens", "requests", F.col("spend").cast("double").alias("spend"), "opus_tokens")


# ------------------------------------------------------------------------------------------ JSON lines
@query("s10_golden_and_results_files", """
SELECT CAST(query_id AS VARCHAR) AS query_id, count(*) AS results, min(score) AS lowest FROM (SELECT user_id AS query_id, value AS score FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 5) GROUP BY 1""")
def s10(t):
    from turnstone.plans.eval_queries import top
    rows = top(t)                           # at most ten rows per query
    nested = rows.groupBy(F.col("query_id").cast("string").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").alias("docId"), F.lit("c").alias("chunkId"), "score", "text"))).alias("results"))
    path = f"{shared_dir(t.spark)}/results-{uuid.uuid4().hex}"
    nested.write.json(path)
    back = SF.ranked_results(SF.read_jsonl(t.spark, path, SF.RESULTS_SCHEMA), 5)
    return back.groupBy("query_id").agg(F.count(F.lit(1)).alias("results"), F.min("score").alias("lowest"))


@query("s11_run_log_sink", "SELECT kind, count(*) AS events, CAST(sum(seq) AS BIGINT) AS seqs FROM run_log GROUP BY kind", "run_log")
def s11(t):
    path = f"{shared_dir(t.spark)}/runs-{uuid.uuid4().hex}"
    SF.write_run_log(log(t), E.run_agents(windows(t), t.sessions), path)
    return SF.read_run_log(t.spark, path).groupBy("kind").agg(F.count(F.lit(1)).alias("events"), F.sum("seq").alias("seqs"))


@query("s12_weekly_card", "SELECT week, tasks, turns, tool_calls, active_days, sessions FROM week_usage", "week_usage")
def s12(t):
    path = f"{shared_dir(t.spark)}/card-{uuid.uuid4().hex}"
    SF.write_report(weeks(t), path)
    return t.spark.read.schema("week string, tasks bigint, turns bigint, tool_calls bigint, active_days bigint, sessions bigint").json(path)


# ------------------------------------------------------------------------------- dimension and case files
part("loaded_specs", "specs")("SELECT * REPLACE (target * 1.5 AS target) FROM specs")
part("observed_loaded", "means_now", "loaded_specs")(PARTS["observed"][1].replace("specs", "loaded_specs"))


def spec_file(t, complete: bool) -> str:
    """The built-in specs with targets half as high again, as a data file; an incomplete one lacks the fifth level."""
    s = dims.specs(t.spark)
    signals = s.agg(F.transform(F.array_sort(F.collect_list(F.struct("spec_order", "signal", "spec_level", "target", "higher", "ratio"))), lambda x: F.struct(
        x["signal"].alias("cle"), x["spec_level"].alias("palier"), (x["target"] * 1.5).alias("cible"), x["higher"].alias("plus_haut_est_mieux"), x["ratio"].alias("ratio"))).alias("signaux"))
    owned = s.filter("problem IS NOT NULL").groupBy("problem").agg(F.min("spec_level").alias("palier"), F.collect_list("signal").alias("signaux"))
    owned = owned.agg(F.collect_list(F.struct(F.col("problem").alias("id"), "palier", "signaux")).alias("problematiques"))
    level = F.struct(F.lit("t").alias("term"), F.lit("a").alias("analogy"))
    levels = F.create_map(*[x for i in range(1, 6 if complete else 5) for x in (F.lit(str(i)), level)])
    path = f"{shared_dir(t.spark)}/specs-{uuid.uuid4().hex}"
    signals.crossJoin(owned).select(F.to_json(F.struct("signaux", "problematiques", levels.alias("paliers"))).alias("value")).coalesce(1).write.text(path)      # two one-row tables
    return path


@query("s07_loaded_specs", """
SELECT 'complete' AS file, 0 AS warnings, signal, problem, round(mean, 6) AS mean, round(gap, 6) AS gap, CAST(rank AS INT) AS rank FROM observed_loaded
UNION ALL SELECT 'incomplete', 1, signal, problem, round(mean, 6), round(gap, 6), CAST(rank AS INT) FROM observed""", "observed", "observed_loaded")
def s07(t):
    def under(name, complete):
        specs, warned = SF.load_specs(t.spark, spec_file(t, complete))
        seen = R.weekly_review(t.signals, t.signals_wide, weeks(t), t.turn_calls, t.task_turns, AS_OF, budget=BUDGET, specs=specs)["observations"]
        return seen.select(F.lit(name).alias("file"), F.lit(len(warned)).alias("warnings"), "signal", "problem", r6("mean").alias("mean"), r6("gap").alias("gap"), "rank")
    return under("complete", True).unionByName(under("incomplete", False))


@query("s09_case_files", """
WITH d AS (SELECT doc_id, doc_id // 40 AS f FROM documents), ok AS (SELECT * FROM d WHERE f % 7 <> 3 AND f % 7 <> 5),
 w AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'case without id' WHEN f % 7 = 2 THEN 'case without family' WHEN doc_id % 13 = 0 OR doc_id % 17 = 0 THEN 'not shareable' ELSE 'accepted' END AS what FROM ok
  UNION ALL SELECT DISTINCT ON (f) CASE WHEN f % 7 = 3 THEN 'malformed' ELSE 'no case list' END FROM d WHERE f % 7 IN (3, 5))
SELECT what, count(*) AS n FROM w GROUP BY what""")
def s09(t):
    d = t.raw("documents").select("doc_id", F.floor(F.col("doc_id") / 40).alias("f"))
    case = F.struct(F.when(F.col("doc_id") % 11 != 0, F.col("doc_id").cast("string")).alias("id"), F.when(F.col("doc_id") % 13 == 0, False).alias("partageable"), F.when(F.col("doc_id") % 17 == 0, "transcript").alias("origine"),
                    F.struct("doc_id").alias("entree"))
    files = d.groupBy("f").agg(F.collect_list(case).alias("epreuves"))                                     # forty cases a file
    body = F.to_json(F.struct(F.when(F.col("f") % 7 != 2, "corpus").alias("famille"), F.when(F.col("f") % 7 != 5, F.col("epreuves")).alias("epreuves")))
    path = f"{shared_dir(t.spark)}/cases-{uuid.uuid4().hex}"
    files.select(F.when(F.col("f") % 7 == 3, F.concat(F.lit("{oops"), body)).otherwise(body).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    cases, warned = SF.load_cases(t.spark, path, pattern="*.txt")
    what = cases.select(F.lit("accepted").alias("what")).unionByName(warned.select(F.element_at(F.split("warning", ": "), -1).alias("what")))
    return what.groupBy("what").agg(F.count(F.lit(1)).alias("n"))
