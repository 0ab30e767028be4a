"""The transcript reader and the session builder on hand-written lines."""

import json

import pytest
from pyspark.sql import functions as F

from turnstone.operators import signals as G, tasks as K, transcript as TR
from turnstone.sources import transcripts as ST


def _lines():
    def at(minute):
        return f"2026-08-18T{9 + minute // 60:02d}:{minute % 60:02d}:00+00:00"

    def user(minute, content, **more):
        return json.dumps({"type": "user", "sessionId": "s", "timestamp": at(minute), **more, "message": {"role": "user", "content": content}})

    def agent(minute, content, stop, tokens, **more):
        usage = dict(zip(("input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "output_tokens"), tokens))
        return json.dumps({"type": "assistant", "sessionId": "s", "timestamp": at(minute), **more,
                           "message": {"model": "m-opus", "stop_reason": stop, "usage": usage, "content": content}})

    human = {"origin": {"kind": "human"}}
    tool = lambda i, name, inp: {"type": "tool_use", "id": i, "name": name, "input": inp}
    done = lambda i, text: [{"type": "tool_result", "tool_use_id": i, "content": text}]
    return [
        user(0, "Ajoute un test sur le lecteur. Il doit passer.", cwd="/w", gitBranch="main", promptId="p1", **human),
        agent(1, [{"type": "thinking", "thinking": "x"}, tool("t1", "Grep", {"pattern": "p"}), tool("t2", "Bash", {"command": "dotnet test"})], "tool_use",
              (12000, 45000, 3000, 400), attributionSkill="eng:tests"),
        user(2, done("t1", "4 matches"), toolUseResult={"durationMs": 180.0}),
        user(3, done("t2", "1 failed"), toolUseResult={"code": 1, "interrupted": False}),
        "{not json",
        agent(4, [{"type": "text", "text": "Done."}], "end_turn", (13000, 46000, 0, 300)),
        user(5, "<system-reminder>x</system-reminder>", isMeta=True),
        user(6, "Non, il manque un cas.", promptId="p2", **human),
        agent(7, [{"type": "text", "text": "Fixed."}], "end_turn", (14000, 47000, 0, 200)),
        agent(8, [{"type": "text", "text": "exploration"}], "end_turn", (500, 0, 0, 50), isSidechain=True),
        "", "[1,2,3]",
        user(200, "Documente l'API publique du service", promptId="p3", **human),
        agent(205, [tool("t3", "Read", {"file_path": "a.cs"})], "tool_use", (9000, 1000, 0, 120)),
        agent(320, [tool("t4", "Write", {"file_path": "b.md"})], "tool_use", (9500, 1200, 0, 90)),
    ]


@pytest.fixture(scope="module", params=[(1_000_000, "128m"), (2, "200")])          # lines of a range, bytes of a split
def built(spark, tmp_path_factory, request):
    key, old = "spark.sql.files.maxPartitionBytes", (TR.RANGE_LINES, spark.conf.get("spark.sql.files.maxPartitionBytes"))
    TR.RANGE_LINES = request.param[0]
    spark.conf.set(key, request.param[1])
    folder = tmp_path_factory.mktemp("logs") / "deep"
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join(_lines()) + "\n", encoding="utf-8")
    (folder / "other.txt").write_text("ignored\n")
    scanned = ST.scan(ST.number_lines(ST.read_lines(spark, str(folder.parent)))).cache()
    parts = {k: v.cache() for k, v in TR.build_sessions(ST.records(scanned)).items()}
    for df in (scanned, *parts.values()):               # cached while the settings hold
        df.count()
    TR.RANGE_LINES = old[0]
    spark.conf.set(key, old[1])
    return scanned, parts


def test_scan_counts_and_numbers_lines(built):
    scanned, _ = built
    report = TR.parse_report(scanned).first()
    assert (report.lines_read, report.lines_unreadable, report.records_kept) == (14, 2, 12)
    warned = [r.warning for r in ST.warnings(scanned).collect()]
    assert [w.split(" ")[0] for w in warned] == ["a.jsonl:5", "a.jsonl:12"]


def test_long_results_with_one_start_have_different_refs(spark, built):
    from turnstone.operators.transcript import tool_result_blocks

    start = "x" * 2500
    lines = [json.dumps({"content": [{"type": "tool_result", "tool_use_id": i, "content": start + i}]}) for i in ("a", "b")]
    rows = spark.createDataFrame([(t,) for t in lines], "line string").select(F.parse_json("line").alias("message"))
    got = tool_result_blocks(rows, "message", []).collect()
    assert len({r.result_ref for r in got}) == 2 and {len(r.result_text) for r in got} == {2001}
    assert all((r.result_ref is None) == (r.result_text is None) for r in built[1]["calls"].collect())


def test_sessions_turns_and_calls(built):
    _, parts = built
    s = parts["sessions"].collect()
    assert len(s) == 1 and s[0].cwd == "/w" and s[0].git_branch == "main"
    assert parts["records"].filter("is_human").count() == 3
    turns = {r.turn_no: r for r in parts["turns"].collect()}
    assert len(turns) == 4 and [turns[i].is_sidechain for i in range(4)] == [False, False, True, False]
    assert turns[0].stop_reason == "end_turn" and turns[2].final_message == "exploration" and turns[1].final_message == "Fixed."
    calls = {r.tool_use_id: r for r in parts["calls"].collect()}
    assert calls["t2"].failed and calls["t2"].failure_reason == "code=1" and calls["t2"].duration_ms == 120_000
    assert not calls["t1"].failed and calls["t1"].duration_ms == 180.0 and calls["t1"].result_text == "4 matches"
    assert calls["t3"].result_at is None and json.loads(calls["t2"].input_json) == {"command": "dotnet test"}
    peak = parts["steps"].filter("turn_no = 0").agg(F.max(F.expr("input_tokens + cache_read_tokens + cache_creation_tokens"))).first()[0]
    assert peak == 60_000
    assert [r.skill for r in parts["turn_skills"].collect()] == ["eng:tests"]


def test_tasks_and_signals(built):
    _, parts = built
    turns = parts["turns"]
    calls = parts["calls"].withColumn("call_no", F.col("line_no") * 1000 + F.col("pos"))
    steps = parts["steps"].withColumn("step_no", F.col("line_no"))
    task_turns = K.number_tasks(K.boundary_decisions(turns))
    decided = {r.turn_no: (r.task_no, r.decision) for r in task_turns.collect()}
    assert {t: n for t, (n, _) in decided.items()} == {0: 1, 1: 1, 3: 2}
    assert "corrective « non »" in decided[1][1] and decided[3][1].startswith("ouverture — silence de 193 min")
    agents = K.attach_agent_turns(turns, task_turns)
    assert [(r.turn_no, r.task_no) for r in agents.collect()] == [(2, 1)]
    active = K.active_time(K.turn_marks(turns, calls, steps), ["session_id", "turn_no"])
    tasks = K.task_rollup(task_turns, agents, calls, active).orderBy("task_no").collect()
    assert [t.in_progress for t in tasks] == [False, True] and tasks[0].title == "Ajoute un test sur le lecteur"
    assert tasks[1].active_us == 5 * 60_000_000 and tasks[1].wall_us == 120 * 60_000_000        # the 115 idle minutes are left out
    wide = G.signals_wide(K.task_rollup(task_turns, agents, calls, active), task_turns, calls, steps, parts["turn_skills"], turns, agents)
    one, two = wide.orderBy("task_no").collect()
    assert one.rework_ratio == 0.5 and one.has_acceptance_criteria == 1.0 and one.tool_failure_rate == 0.5 and one.verification_present == 1.0
    assert abs(one.cache_read_ratio - 138_000 / 180_000) < 1e-9 and one.context_pressure == 61_000 / 200_000
    assert two.first_try_success is None and two.loop_closure is None and one.context_isolation == 1.0 and one.graph_depth == 1.0
    long = G.signals_long(wide)
    assert long.count() == 38 and long.filter("evidence IS NULL OR evidence = ''").count() == 0


def test_absent_folder_and_file_cap(spark, tmp_path):
    assert ST.read_lines(spark, str(tmp_path / "none")).count() == 0
    for n in "cab":
        (tmp_path / f"{n}.jsonl").write_text('{"type":"user"}\n')
    assert [r.file.rsplit("/", 1)[1] for r in ST.read_lines(spark, str(tmp_path), limit_files=2).orderBy("file").collect()] == ["a.jsonl", "b.jsonl"]
    assert ST.read_lines(spark, str(tmp_path), modified_after="2999-01-01T00:00:00").count() == 0


def test_result_goes_to_the_latest_open_call_once(spark):
    from turnstone.operators import turns as U
    calls = spark.sql("SELECT * FROM VALUES ('x', 1), ('x', 2), ('y', 5) AS v(id, seq)").withColumn("name", F.lit("n"))
    results = spark.sql("SELECT *, seq * 10 AS r FROM VALUES ('x', 3), ('x', 4), ('y', 1) AS v(id, seq)")
    got = {(r.id, r.seq): r.r for r in U.match_results(calls, results, ["id"], ["seq"], ["r"], F.col("seq")).collect()}
    assert got == {("x", 1): None, ("x", 2): 30, ("y", 5): None}


def test_failure_reasons_in_order(spark):
    from turnstone.operators import turns as U
    rows = spark.createDataFrame([
        (1, '{"is_error":true}', '{"interrupted":true,"code":2}'), (2, "{}", '{"interrupted":true,"success":false}'), (3, "{}", '{"success":false,"code":3}'),
        (4, "{}", '{"code":7}'), (5, '{"is_error":false}', '{"code":0,"success":true}'), (6, "{}", None)], "id int, b string, e string")
    rows = rows.withColumns({"called_at": F.timestamp_seconds(F.lit(0)), "result_at": F.timestamp_seconds(F.lit(1))})
    got = {r.id: (r.failed, r.failure_reason) for r in U.classify_result(rows, F.try_parse_json("b"), F.try_parse_json("e")).collect()}
    assert got == {1: (True, "is_error"), 2: (True, "interrupted"), 3: (True, "success=false"), 4: (True, "code=7"), 5: (False, None), 6: (False, None)}


@pytest.mark.parametrize("prompt,stop,gap,new,rule", [
    ("", "end_turn", 1, False, "no_prompt"), ("Refais la migration", "end_turn", 1, False, "corrective"), ("Documente l'API publique du service", "end_turn", 1, True, "new"),
    ("Autre sujet complet", "end_turn", 180, True, "silence"), ("Autre sujet complet", "tool_use", 2, False, "unfinished"), ("Autre sujet complet", "tool_use", 6, True, "new"),
    ("Continue avec la suite", "end_turn", 6, False, "continuation"), ("regarde cela de plus près", "end_turn", 6, False, "short"), ("non, toujours pas", "end_turn", 30, True, "silence"),
    ("Décris l'écran", "end_turn", 6, True, "new"), ("x " * 90 + "cela", "end_turn", 6, True, "new")])
def test_boundary_rules(spark, prompt, stop, gap, new, rule):
    rows = spark.createDataFrame([("s", 0, "premier", False, 0, 0, stop), ("s", 1, prompt, False, gap * 60, gap * 60, "end_turn")],
                                 "session_id string, turn_no int, prompt string, is_sidechain boolean, a int, z int, stop_reason string")
    turns = rows.selectExpr("*", "timestamp_seconds(a) AS started_at", "timestamp_seconds(z) AS ended_at")
    got = K.boundary_decisions(turns).filter("turn_no = 1").first()
    assert (got.is_new, got.rule) == (new, rule)
