"""Span pairing against a plain simulation, late rows, retries and windows."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from turnstone.functions import fixed_values as V
from turnstone.streaming import live as S

IDLE = 6 * 3600 * 1_000_000
COLUMNS = ["ts", "tie", "hook", "session_id", "prompt_id", "tool_name", "tool_use_id", "tool_execution_time_ms", "agent_id", "agent_type", "model", "total_in", "output_tokens", "cache_read_tokens"]


def _events(n=300, seed=5):
    rnd, t, out = random.Random(seed), dt.datetime(2026, 1, 1), []
    hooks = ["SessionStart", "SessionEnd", "UserPromptSubmit", "UserPromptSubmit", "Stop", "StopFailure", "PostToolUse", "PostToolUseFailure", "SubagentStart", "SubagentStop", "PreCompact", "usage", "usage"]
    for i in range(n):
        t += dt.timedelta(minutes=rnd.choice([1, 5, 30, 200, 400]))
        out.append((t, i, rnd.choice(hooks), rnd.choice(["s1", "s2"]), rnd.choice([None, "p1", "p2"]), "Bash", f"u{i}", float(rnd.randint(0, 5000)), rnd.choice([None, "a1", "a2"]), "kind", f"m{i % 3}", i, i % 5, i % 7))
    return out


def _us(t):
    return int((t - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000


def _simulate(events, final_us):
    """The rules told once more, one event at a time over one dictionary."""
    spans, closed = {}, []

    def close(key, end, outcome):
        s = spans.pop(key, None)
        if s:
            closed.append((*key, s["name"], s["parent"], s["start"], end, outcome))
        return s

    def sweep(session, now):
        for key in [k for k, s in spans.items() if (session is None or k[0] == session) and s["seen"] + IDLE <= now]:
            close(key, spans[key]["seen"] + IDLE, "abandoned")

    def start(key, name, parent, now):
        close(key, now, "superseded")
        spans[key] = {"name": name, "parent": parent, "start": now, "seen": now, "use": None}

    for ts, i, hook, sid, prompt, tool, use_id, ms, agent, kind, model, total, out, cache in events:
        now = _us(ts)
        sweep(sid, now)
        root, turn = (sid, "session", sid), (sid, "prompt", prompt or sid)

        def session():
            if root not in spans:
                start(root, "session", None, now)
            spans[root]["seen"] = now
            return f"session:{sid}"

        def context():
            if prompt and turn in spans:
                spans[turn]["seen"] = now
                return f"prompt:{prompt}"
            return session()

        if hook == "SessionStart":
            start(root, "session", None, now)
        elif hook == "SessionEnd":
            close(root, now, "ended")
        elif hook == "UserPromptSubmit":
            start(turn, "turn", session(), now)
        elif hook in ("Stop", "StopFailure"):
            s = close(turn, now, "completed" if hook == "Stop" else "failed")
            if s and s["use"]:
                closed.append((sid, "llm", prompt or sid, "llm", f"prompt:{prompt or sid}", now, now, "ok"))
        elif hook.startswith("PostToolUse"):
            closed.append((sid, "tool", use_id, "tool.Bash", context(), now - int(ms * 1000), now, "ok" if hook == "PostToolUse" else "failed"))
        elif hook == "SubagentStart" and agent:
            start((sid, "agent", agent), "agent.kind", context(), now)
        elif hook == "SubagentStop" and agent:
            close((sid, "agent", agent), now, "ended")
        elif hook == "PreCompact":
            closed.append((sid, "marker", use_id, "context.compact", context(), now, now, "ok"))
        elif hook == "usage" and turn in spans:
            spans[turn]["use"] = model
    sweep(None, final_us)
    return sorted(map(str, closed))


def _write(spark, rows, folder):
    df = spark.createDataFrame(pd.DataFrame(rows, columns=COLUMNS), "ts timestamp, tie bigint, hook string, session_id string, prompt_id string, tool_name string, tool_use_id string, "
                               "tool_execution_time_ms double, agent_id string, agent_type string, model string, total_in bigint, output_tokens bigint, cache_read_tokens bigint")
    df.coalesce(1).write.mode("append").parquet(folder)
    return df.schema


def _final(rows):
    """What the last watermark has passed is final: events before it, and spans idle until then."""
    limit = max(_us(r[0]) for r in rows) - 600_000_000
    return _simulate(sorted((r for r in rows if _us(r[0]) < limit), key=lambda r: (r[0], r[1])), limit - 1)


def _rows(out):
    return sorted(str((r.session_id, r.scope, r.id, r.name, r.parent, r.start_us, r.end_us, r.outcome)) for r in out.collect())


def test_span_pairing_matches_simulation(spark, tmp_path):
    rows = _events()
    schema = _write(spark, rows, str(tmp_path / "in"))
    out = S.drain(S.pair_spans(S.read_events(spark, str(tmp_path / "in"), schema)), "pair")
    assert _rows(out) == _final(rows)
    assert {r.outcome for r in out.collect()} >= {"abandoned", "superseded", "completed", "failed", "ended", "ok"}
    assert out.filter("reason = 'recovered'").count() > 0


def test_state_survives_a_restart(spark, tmp_path):
    rows, base = _events(120), str(tmp_path)
    schema = _write(spark, rows[:60], f"{base}/in")

    def run():
        q = (S.pair_spans(S.read_events(spark, f"{base}/in", schema)).writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
             .option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start())
        q.awaitTermination()
        return spark.read.parquet(f"{base}/out")

    run()
    _write(spark, rows[60:], f"{base}/in")
    assert _rows(run()) == _final(rows)


@pytest.mark.parametrize("batch,files", [(5, 1), (10_000, 1), (5, 7)])
def test_span_pairing_for_any_batches_and_files(spark, tmp_path, batch, files):
    rows, rnd = _events(200, 11), random.Random(1)
    mixed = rows[:]
    rnd.shuffle(mixed)                                   # order within the input is free
    parts = [mixed] if files == 1 else [rows[i * 30:(i + 1) * 30][::-1] for i in range(7)]
    for part in parts:
        schema = _write(spark, part, str(tmp_path / "in"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
        assert _rows(S.drain(S.pair_spans(stream), "pair")) == _final(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_turn_state_ends(spark, tmp_path):
    """A long stream of short turns: the store holds the running turns only."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    base, start = str(tmp_path), dt.datetime(2026, 1, 1)
    try:
        for day in range(6):
            rows = [(start + dt.timedelta(days=day, minutes=i), i, f"s{i % 2}", f"p{day}-{i % 5}", f"m{i % 3}", i, 2 * i, 0, 1) for i in range(20)]
            df = spark.createDataFrame(rows, "ts timestamp, step_no bigint, session_id string, prompt_id string, model string, input_tokens bigint, cache_read_tokens bigint, cache_creation_tokens bigint, output_tokens bigint")
            df.coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", "1").parquet(f"{base}/in")
        kept = []

        def put(batch, batch_id):
            batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

        q = S.last_turns(stream).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
        kept = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress]
        out = spark.read.parquet(f"{base}/out")
        assert out.select("session_id", "prompt_id").distinct().count() == 60
        last = out.filter("prompt_id = 'p3-1' AND session_id = 's1'").collect()          # steps 1 and 11
        assert [(r.model, r.prompt_tokens, r.completion_tokens, r.cache_read_tokens) for r in last] == [("m2", 33, 2, 24)]
        assert max(kept) <= 3 * 20 and len(kept) >= 6                                     # two days of turns and their timers, not six
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_hook_bodies_and_unknown_names(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"hook_event_name":"Stop","session_id":"s"}\n{"url_segment":"PRE-compact","session_id":"s"}\n{"hook_event_name":"Nope"}\n{bad\n\n')
    lines = spark.readStream.text(str(tmp_path / "in"))
    out = S.drain(S.canonical(S.parse_hooks(lines)).select("hook", "session_id"), "hooks")
    assert sorted(r.hook for r in out.collect()) == ["PreCompact", "Stop"]
    assert set(V.HOOK_MARKERS) <= set(V.HOOK_ROUTES.values())


def test_late_rows_are_dropped(spark, tmp_path):
    base, schema = str(tmp_path), "ts timestamp, hook string"
    put = lambda rows: spark.createDataFrame([(dt.datetime(2026, 1, 1, *hm), "Stop") for hm in rows], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")

    def run():
        q = (S.hook_counts(S.read_events(spark, f"{base}/in", schema)).writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
             .option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start())
        q.awaitTermination()

    put([(1, 5), (1, 50), (5, 0)])
    run()
    put([(1, 10), (9, 0)])            # the first row is hours behind the watermark
    run()
    got = {r.start_at.hour: r.n for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {1: 2, 5: 1}


@pytest.mark.parametrize("failures,kept", [(2, 2), (9, 0)])
def test_delivery_retries_then_abandons(spark, tmp_path, failures, kept):
    base = str(tmp_path)
    spark.createDataFrame([(dt.datetime(2026, 1, 1), "a"), (dt.datetime(2026, 1, 1, 0, 5), "a"), (dt.datetime(2026, 1, 1), "b")], "ts timestamp, identifier string").coalesce(1).write.parquet(f"{base}/in")
    calls, sent = [], []

    def send(batch, batch_id):
        calls.append(batch_id)
        if len(calls) <= failures:
            raise ConnectionError("away")
        sent.extend(r.identifier for r in batch.collect())

    def run(place):
        S.deliver(S.read_events(spark, f"{base}/in", "ts timestamp, identifier string"), send, f"{base}/dead", checkpoint=f"{base}/{place}", commits=f"{base}/log").awaitTermination()

    run("ck")
    assert len(sent) == kept == len(set(sent))
    run("other")                                         # the batch is replayed, as after a lost checkpoint
    log = spark.read.parquet(f"{base}/log").collect()
    assert len(sent) == kept and {r.outcome for r in log} == {"sent" if kept else "abandoned"} and len({r.batch for r in log}) == len(log)
    if not kept:
        assert spark.read.parquet(f"{base}/dead").filter(F.col("reason").contains("away")).count() == 2


@pytest.mark.parametrize("batch,files", [(10_000, 1), (7, 5)])
def test_sessions_share_state_groups(spark, tmp_path, batch, files):
    """A call of the processor serves many sessions, and none sees another's spans."""
    rnd = random.Random(3)
    names = [f"s{i}" for i in range(30)]
    rows = [(*r[:3], rnd.choice(names), *r[4:]) for r in _events(600, 5)]
    mixed = rows[:]
    if files == 1:
        rnd.shuffle(mixed)
    step = len(rows) // files
    for i in range(files):
        schema = _write(spark, mixed[i * step:(i + 1) * step][::-1], str(tmp_path / "in"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
        assert _rows(S.drain(S.pair_spans(stream, groups=3), "pair")) == _final(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


@pytest.mark.parametrize("batch,files", [(10_000, 1), (7, 4)])
def test_turn_usage_of_sessions_in_one_group(spark, tmp_path, batch, files):
    rnd, start = random.Random(4), dt.datetime(2026, 1, 1)
    rows = [(start + dt.timedelta(seconds=i), i, rnd.choice([None, "a", "b", "c"]), rnd.choice(["p1", "p2", "", None]), rnd.choice(["m1", "m2", None]), rnd.randrange(50), rnd.randrange(5), 0, rnd.randrange(9)) for i in range(400)]
    for i in range(files):
        df = spark.createDataFrame(rows[i::files], "ts timestamp, step_no bigint, session_id string, prompt_id string, model string, input_tokens bigint, cache_read_tokens bigint, cache_creation_tokens bigint, output_tokens bigint")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = {}
    for _, _, session, prompt, model, tokens, cached, _, made in rows:
        if prompt:
            _, most, out, read = want.get((session, prompt), (None, 0, 0, 0))
            want[session, prompt] = (model, max(most, tokens + cached), out + made, read + cached)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
        got = S.drain_updates(S.last_turns(stream, groups=2), "turns", ["session_id", "prompt_id"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert {(r.session_id, r.prompt_id): (r.model, r.prompt_tokens, r.completion_tokens, r.cache_read_tokens) for r in got} == want
