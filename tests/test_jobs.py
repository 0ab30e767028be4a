"""Whole jobs over a folder of several weeks of transcripts."""

import datetime as dt
import json
import random

import pytest

from turnstone.operators import claims as L
from turnstone.plans import jobs
from turnstone.sources import files as SF


def _session(name, start, clean):
    """One short session: a clean one states its goal and ends on a passing test, a messy one needs a follow-up."""
    at = lambda m: (start + dt.timedelta(minutes=m)).isoformat() + "+00:00"
    user = lambda m, text, pid: {"type": "user", "sessionId": name, "timestamp": at(m), "promptId": pid, "message": {"role": "user", "content": text}}
    use = {"input_tokens": 100, "cache_read_input_tokens": 300, "cache_creation_input_tokens": 0, "output_tokens": 10}

    def agent(m, blocks, stop):
        return {"type": "assistant", "sessionId": name, "timestamp": at(m), "message": {"model": "m-sonnet", "stop_reason": stop, "usage": use, "content": blocks}}

    call = lambda i, n, inp: {"type": "tool_use", "id": f"{name}-{i}", "name": n, "input": inp}
    rows = [user(0, "Corrige le calcul dans date.py, le test doit passer" if clean else "Regarde la date", "p1"), agent(1, [call(1, "Grep" if clean else "Read", {"pattern": "d"})], "tool_use")]
    if clean:
        rows += [agent(2, [call(2, "Bash", {"command": "pytest -q"})], "tool_use"), agent(3, [{"type": "text", "text": "ok"}], "end_turn")]
    else:
        rows += [agent(2, [{"type": "text", "text": "?"}], "end_turn"), user(4, "Non, corrige aussi l'heure", "p2"), agent(5, [{"type": "text", "text": "ok"}], "end_turn")]
    return rows


@pytest.fixture(scope="module")
def t(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("weeks")
    monday = dt.datetime(2026, 1, 5, 9)
    for w in [0, 1, 2, 6, 7, 8]:                      # three messy weeks, a hole, three clean weeks
        lines = [json.dumps(r) for d in range(2) for r in _session(f"w{w}d{d}", monday + dt.timedelta(weeks=w, days=d), clean=w > 5)]
        (folder / f"{w}.jsonl").write_text("\n".join(lines) + "\n")
    return jobs.session_tables(spark, str(folder))


def test_weekly_review(t):
    r = jobs.weekly_review(t, as_of="2026-03-09")
    assert r["week"].first().last_week == "2026-W10"
    assert r["usage"].first().tasks == 2 and r["observations"].count() <= 3
    assert r["win"].first().signal in {"has_acceptance_criteria", "verification_present", "loop_closure", "first_try_success"}
    old = jobs.weekly_review(t, as_of="2026-03-09", week="2026-W02")
    # the three largest gaps, one per problem: 8 - 1 calls of 8, 4 - 1 tools of 4, no verification against 0.7
    assert {x.signal for x in old["observations"].collect()} == {"autonomy_ratio", "harness_breadth", "verification_present"}
    assert old["prompt"].first().first_prompt == "Regarde la date" and old["win"].count() == 0


def test_retrospective(t):
    r = jobs.retrospective(t)
    by = {x.signal: x for x in r["trails"].collect()}
    assert by["verification_present"].verdict == "Acquis" and by["verification_present"].crossed_week == "2026-W08"
    head = r["header"].first()
    assert (head.weeks_active, head.weeks_covered, head.weeks_silent, head.sessions, head.tasks) == (6, 9, 3, 12, 12)
    assert [(x.from_day, x.weeks) for x in r["silences"].collect()] == [(dt.date(2026, 1, 26), 3)]
    assert r["milestones"].count() >= 1 and [m.month for m in r["months"].orderBy("month").collect()] == ["2026-01", "2026-02", "2026-03"]


def test_log_spans_and_probe(t):
    log = jobs.run_log(t).filter("session_id = 'w0d0'").orderBy("seq").collect()
    assert [e.seq for e in log] == list(range(len(log))) and log[0].kind == "run.start"
    # the last model call lasts one second by rule, so its end comes after the end of the run
    assert [e.kind for e in log[-2:]] == ["run.end", "think.end"]
    assert log[-2].payload["human_interventions"] == "1" and [e.kind for e in log].count("think.start") == 3
    names = {r.name: r["count"] for r in jobs.span_tree(t).groupBy("name").count().collect()}
    assert names["session"] == 12 and names["task"] == 12 and names["turn"] == 18
    p = jobs.probe(t)
    assert p["missing"].count() == 0 and p["report"].first().lines_unreadable == 0
    assert {r.value for r in p["messages"].filter("what = 'tool'").collect()} == {"Grep", "Read", "Bash"}


def test_dictionary_file(spark, tmp_path):
    f = tmp_path / "facts.json"
    f.write_text('{ // facts\n "unites": [{"nom": "Roach", "alias": ["cafard"], "race": "Zerg"}], "batiments": [{"nom": "Spine Crawler"}], "mecaniques": [{"nom": "creep"}], "vernaculaire": [{"terme": "all-in"}],'
                 ' "punitions": [{"id": "p1", "palier": 2, "signal": "load_precision"}]}')
    names, terms, situations = SF.load_dictionary(spark, str(f))
    assert {r.alias for r in names.collect()} == {"Roach", "cafard", "Spine Crawler"} and {r.term for r in terms.collect()} == {"creep", "all-in"}
    asked = spark.createDataFrame([(1, "LOAD_PRECISION", None), (2, "other", None), (3, None, 2)], "request_id int, signal string, level int")
    got = {r.request_id: (r.found, r.covered) for r in L.situations(asked, situations).collect()}
    assert got == {1: (1, None), 2: (0, "load_precision"), 3: (1, None)}
    found = {r.request_id: (r.entity, r.suggestions) for r in L.lookup(spark.createDataFrame([(1, "CAFARD"), (2, "spine"), (3, "les roach"), (4, "zz")], "request_id int, asked string"), names).collect()}
    assert found == {1: ("Roach", None), 2: (None, ["Spine Crawler"]), 3: (None, ["Roach"]), 4: (None, [])}
    req = spark.createDataFrame([(1, "CREEP"), (2, "all in"), (3, "roach"), (4, "ree"), (5, "a creep"), (6, "")], "request_id int, asked string")
    got = {r.request_id: (r.kind, r.found, r.suggestions) for r in L.lookup_terms(req, terms, names).collect()}
    assert got == {1: ("mechanic", "creep", None), 2: ("slang", "all-in", None), 3: ("entity", "Roach", None), 4: (None, None, ["creep"]), 5: (None, None, []), 6: (None, None, [])}
    texts = spark.createDataFrame([(1, "on voit Creep et Banane, puis Banane"), (2, "un Rush rapide")], "text_id int, text string")
    slang = terms.selectExpr("place", "CASE WHEN kind = 'slang' THEN 'rush' ELSE term END AS term", "kind")
    assert sorted((r.text_id, r.candidate) for r in L.unknown_names(texts, names, slang).collect()) == [(1, "Banane"), (1, "Banane"), (2, "Rush")]
    assert SF.load_dictionary(spark, str(tmp_path / "none.json"))[0].count() == 0


def test_suggestions_by_rarest_piece_are_complete(spark):
    rnd = random.Random(6)
    word = lambda a, b: "".join(rnd.choice("aab c") for _ in range(rnd.randint(a, b)))
    asked, names = [(i, word(1, 9)) for i in range(60)], sorted({word(1, 7) for _ in range(80)})
    q = spark.createDataFrame(asked, "request_id int, _q string")
    pool = spark.createDataFrame([(n,) for n in names], "_a string")
    assert sorted((r.request_id, r._a) for r in L.containing(q, pool).collect()) == sorted((i, n) for i, x in asked for n in names if x in n)
    assert sorted((r.request_id, r._a) for r in L.contained(q, pool).collect()) == sorted((i, n) for i, x in asked for n in names if n in x)


def test_calls_are_numbered_over_all_files_of_a_session(spark, tmp_path):
    """A resumed session and a sub-agent file: the verification of the first file is not the last call."""
    start = dt.datetime(2026, 1, 5, 9)
    at = lambda m: (start + dt.timedelta(minutes=m)).isoformat() + "+00:00"

    def line(m, n, command, **more):
        return json.dumps({"type": "assistant", "sessionId": "s", "timestamp": at(m), **more, "message": {"model": "m-sonnet", "stop_reason": "tool_use", "usage": {"input_tokens": 1},
                           "content": [{"type": "tool_use", "id": f"c{n}", "name": "Bash", "input": {"command": command}}]}})

    prompt = json.dumps({"type": "user", "sessionId": "s", "timestamp": at(0), "promptId": "p1", "message": {"role": "user", "content": "Corrige le calcul"}})
    (tmp_path / "a.jsonl").write_text("\n".join([prompt, line(1, 1, "pytest -q"), line(2, 2, "ls")]) + "\n")
    (tmp_path / "b.jsonl").write_text("\n".join([line(3, 3, "ls"), line(4, 4, "ls"), line(5, 5, "ls")]) + "\n")
    (tmp_path / "c-agent.jsonl").write_text(line(6, 6, "ls", isSidechain=True) + "\n")
    t = jobs.session_tables(spark, str(tmp_path))
    assert [(r.call_id, r.call_no) for r in t["calls"].orderBy("call_no").collect()] == [(f"c{i}", i - 1) for i in range(1, 7)]
    assert sorted(r.step_no for r in t["steps"].collect()) == list(range(6))


def test_snapshot_keeps_versions_and_fails_on_other_errors(spark, tmp_path):
    from turnstone.operators.snapshot import read_versions, write_snapshot

    one = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    two = spark.createDataFrame([("a", 1), ("b", 3), ("c", 4)], "k string, v int")
    path = str(tmp_path / "snap")
    assert {r.outcome for r in write_snapshot(one, path, "k", "20260105-0900").collect()} == {"created"}
    assert {r.k: r.outcome for r in write_snapshot(two, path, "k", "20260112-0900").collect()} == {"a": "unchanged", "b": "archived", "c": "created"}
    rows = read_versions(spark, path, "k", one.schema).collect()
    assert {r.k: r.v for r in rows if r.is_current} == {"a": 1, "b": 3, "c": 4} and [(r.k, r.v) for r in rows if not r.is_current] == [("b", 2)]
    (tmp_path / "broken" / "manifest").mkdir(parents=True)
    (tmp_path / "broken" / "manifest" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        write_snapshot(two, str(tmp_path / "broken"), "k", "20260112-0900")
