"""Run event log and span tree of sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.functions import exprs as X
from turnstone.functions import fixed_values as V
from turnstone.operators import intervals, ordered as O
from turnstone.operators.tasks import completed
from turnstone.session import stored

MAIN, HUMAN = "principal", "humain"


def select_sessions(sessions: DataFrame, prefix: str = "", everything: bool = False) -> DataFrame:
    """F06 — sessions by id prefix (case ignored); the newest one unless all are wanted."""
    picked = sessions.filter(F.lower("session_id").startswith(prefix.lower())) if prefix else sessions
    return picked if everything else picked.orderBy(F.desc("started_at"), F.desc("session_id")).limit(1)


def agent_windows(calls: DataFrame, turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """W10 — one window per agent launched from the main lane, named ``type`` and then ``type#2``, ``type#3`` …"""
    main = turns.filter(~F.col("is_sidechain")).select("session_id", "turn_no")
    spawns = (calls.filter(F.lower("name") == "task").join(main, ["session_id", "turn_no"])
              .withColumn("role", F.coalesce(X.json_field("input_json", "subagent_type"), F.lit("sous-agent"))))
    ranked = O.ordered_scan(spawns, ["session_id", "role"], ["turn_no", "call_no"], {"n": O.number()},
                            O.runs("turn_no"))
    named = F.when(F.col("n") == 1, F.col("role")).otherwise(F.concat("role", F.lit("#"), F.col("n").cast("string")))
    return (ranked.join(sessions.select("session_id", F.col("ended_at").alias("_end")), "session_id")
            .select("session_id", named.alias("actor"), "role", F.col("called_at").alias("from_at"),
                    F.coalesce("result_at", "_end").alias("to_at"), "turn_no", "call_no"))


def turn_actors(turns: DataFrame, windows: DataFrame) -> DataFrame:
    """J04 — who acted in each turn: the latest listed window that holds its start, else the main lane; with the decision."""
    key = ["session_id", "turn_no"]
    w = windows.select("session_id", "actor", "from_at", "to_at", F.struct("turn_no", "call_no").alias("_listed"))
    agent = turns.filter("is_sidechain").select(*key, "started_at")
    found = intervals.latest_interval(agent, w, ["session_id"], key, "started_at", "from_at", "to_at", "_listed", "actor").withColumnRenamed("found", "_actor")
    j = turns.join(found, key, "left")
    n = F.coalesce("candidates", F.lit(0).cast("bigint"))
    decision = (F.when(~F.col("is_sidechain") | (n == 1), F.lit(None).cast("string"))
                .when(n == 0, F.lit("outside every agent window: main lane"))
                .otherwise(F.concat(F.lit("inside "), n.cast("string"), F.lit(" agent windows: latest launched"))))
    return (j.withColumns({"actor": F.coalesce("_actor", F.lit(MAIN)), "candidates": n, "decision": decision}).drop("_actor"))


def think_intervals(steps: DataFrame, turns: DataFrame, calls: DataFrame, idle_minutes: float = V.IDLE_GAP_MINUTES) -> DataFrame:
    """W11 — end of each model call: the next step, the end of the turn or the first tool call after it, whichever is first.

    A length that is not positive or exceeds the idle gap becomes one second. The first call after the step comes
    from an ordered scan over the instants of the turn, without a range join.
    """
    key = ["session_id", "turn_no"]
    nxt = O.ordered_scan(steps, key, ["step_no"], {"_next": O.lead(F.col("at"))}, O.runs("step_no"))
    s = nxt.select(*key, "at", F.lit(0).alias("_kind"), F.col("step_no").alias("_no"), F.struct(*steps.columns, "_next").alias("_step"))
    c = calls.select(*key, F.col("called_at").alias("at"), F.lit(1).alias("_kind"), F.col("call_no").alias("_no"),
                     F.lit(None).cast(s.schema["_step"].dataType).alias("_step"))
    # backwards in time, steps ahead of calls of the same instant: the call seen last is the first one strictly after the step
    both = s.unionByName(c).withColumn("_t", -F.unix_micros("at"))
    seen = O.ordered_scan(both, key, ["_t", "_kind", "_no"], {"_call": O.last_known(F.when(F.col("_kind") == 1, F.col("at")))},
                          F.floor(F.col("_t") / 3_600_000_000))
    j = (seen.filter("_kind = 0").select("_step.*", "_call")
         .join(turns.select(*key, F.col("ended_at").alias("_turn_end")), key))
    bound = F.coalesce("_next", "_turn_end")
    stop = F.when(F.col("_call") < bound, F.col("_call")).otherwise(bound)
    length = F.unix_micros(stop) - F.unix_micros("at")
    fine = (length > 0) & (length <= int(idle_minutes * 60_000_000))
    return j.withColumn("ends_at", F.when(fine, stop).otherwise(F.timestamp_micros(F.unix_micros("at") + 1_000_000))).select(*steps.columns, "ends_at")


def run_events(sessions: DataFrame, turns: DataFrame, calls: DataFrame, steps: DataFrame, capture_args: bool = True, capture_text: bool = False,
               max_arg: int = 160, idle_minutes: float = V.IDLE_GAP_MINUTES, eur_in: float = 0.0, eur_out: float = 0.0,
               windows: DataFrame | None = None, actors: DataFrame | None = None) -> DataFrame:
    """R07, W12 — the ordered event log of every session.

    Each kind of event is one projection; their union is numbered per run by time and emission rank.
    The rank is a struct (phase, turn, item, part), so no driver-side counter is needed. ``windows`` and ``actors`` (W10, J04) are built
    and written here unless given.
    """
    key = ["session_id", "turn_no"]
    if windows is None:
        windows = stored(agent_windows(calls, turns, sessions), "windows")
    if actors is None:
        actors = stored(turn_actors(turns, windows).select(*key, "actor"), "actors")
    no = F.lit(0).cast("bigint")

    def ev(at, actor, kind: str, phase: int, turn=None, item=None, sub: int = 0, origin: str = "observed", ref=None, group: int = 0,
           tok_in=None, tok_out=None, calls_=None, **payload) -> Column:
        cells = [F.lit(x) if isinstance(x, str) else x for k, v in payload.items() for x in (k, v)]
        body = F.map_filter(F.create_map(*cells), lambda k, v: v.isNotNull())
        count = lambda c: (F.lit(None) if c is None else c).cast("bigint")
        return F.struct(
            X._c(at).alias("at"), F.lit(phase).alias("phase"), (no if turn is None else X._c(turn).cast("bigint")).alias("r_turn"),
            F.lit(group).alias("r_group"), (no if item is None else X._c(item).cast("bigint")).alias("r_item"), F.lit(sub).alias("r_sub"),
            (F.lit(actor) if actor in (MAIN, HUMAN) else F.col(actor)).alias("actor"), F.lit(origin).alias("origin"), F.lit(kind).alias("kind"),
            (F.lit(None).cast("string") if ref is None else ref).alias("ref"), count(tok_in).alias("tok_in"), count(tok_out).alias("tok_out"),
            count(None if calls_ is None else F.lit(calls_)).alias("calls"), body.alias("payload"))

    def emit(df: DataFrame, *events: Column) -> DataFrame:
        """All events of a row in one pass over its table."""
        return df.select("session_id", F.explode(F.array(*events)).alias("_e")).select("session_id", "_e.*")

    s = lambda c: F.col(c).cast("string")
    first = turns.groupBy("session_id").agg(F.min_by("prompt", "turn_no").alias("prompt"), F.min("turn_no").alias("first_turn"))
    opened = sessions.join(first, "session_id")
    follow = turns.join(first.select("session_id", "first_turn"), "session_id").filter(
        (F.col("turn_no") > F.col("first_turn")) & ~F.col("is_sidechain") & ~X.is_blank("prompt"))
    thinks = think_intervals(steps, turns, calls, idle_minutes).join(actors, key)
    read = X.total_input("input_tokens", "cache_read_tokens", "cache_creation_tokens")
    model = F.coalesce("model", F.lit("modèle"))
    args = X.call_target("input_json", max_arg) if capture_args else F.lit("")
    done = F.coalesce("result_at", F.timestamp_micros(F.unix_micros("called_at") + F.coalesce((F.col("duration_ms") * 1000).cast("bigint"), F.lit(1000).cast("bigint"))))
    ms = F.coalesce("duration_ms", (F.unix_micros(done) - F.unix_micros("called_at")) / 1000.0).cast("bigint")
    result_ref = F.col("result_ref") if "result_ref" in calls.columns else X.fingerprint("result_text") if "result_text" in calls.columns else None
    totals = (steps.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_calls"), F.sum(read).alias("t_in"), F.sum("output_tokens").alias("t_out"))
              .join(follow.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_human")), "session_id", "left"))
    closed = sessions.join(turns.select("session_id").distinct(), "session_id", "left_semi").join(totals, "session_id", "left")
    eur = F.bround(F.coalesce("t_in", no) / 1e6 * eur_in + F.coalesce("t_out", no) / 1e6 * eur_out, 4)
    wall = F.greatest(no, F.floor((F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1000).cast("bigint"))

    log = reduce(DataFrame.unionByName, [
        emit(windows, ev("from_at", "actor", "agent.spawn", 0, "turn_no", "call_no", 0, role=F.col("role"), parent=MAIN, depth="1"),
             ev("to_at", "actor", "agent.end", 0, "turn_no", "call_no", 1, status="completed")),
        emit(opened, ev("started_at", MAIN, "run.start", 1, ref=X.fingerprint("prompt"), task=F.substring(s("session_id"), 1, 8), title=X.redact("prompt", capture_text, 200)),
             ev("started_at", MAIN, "agent.spawn", 1, sub=1, role=MAIN, depth="0")),
        emit(follow, ev("started_at", HUMAN, "human", 2, "turn_no", origin="human", ref=X.fingerprint("prompt"), to=MAIN, text=X.redact("prompt", capture_text, 200))),
        emit(thinks, ev("at", "actor", "think.start", 2, "turn_no", "step_no", 0, group=1, summary=model),
             ev("ends_at", "actor", "think.end", 2, "turn_no", "step_no", 1, group=1, tok_in=read, tok_out=F.col("output_tokens"), calls_=1, summary=model,
                parallele=F.when(F.col("tool_blocks") > 1, s("tool_blocks")))),
        emit(calls.join(actors, key), ev("called_at", "actor", "tool.start", 2, "turn_no", "call_no", 0, group=2, tool=F.col("name"), args=args),
             ev(done, "actor", "tool.end", 2, "turn_no", "call_no", 1, group=2, ref=result_ref, tool=F.col("name"), args=args, ok=(~F.col("failed")).cast("string"), ms=ms.cast("string"),
                out=F.when(F.col("failed") & (F.coalesce("failure_reason", F.lit("")) != ""), X.redact("failure_reason", capture_text, 120)))),
        emit(closed, ev("ended_at", MAIN, "agent.end", 3, status="completed"),
             ev("ended_at", MAIN, "run.end", 3, sub=1, status="completed", calls=F.coalesce("n_calls", no).cast("string"), tok_in_total=F.coalesce("t_in", no).cast("string"),
                tok_out_total=F.coalesce("t_out", no).cast("string"), eur=eur.cast("string"), wall_clock_ms=wall.cast("string"), human_interventions=F.coalesce("n_human", no).cast("string"))),
    ])
    log = log.join(sessions.select("session_id", F.col("started_at").alias("_t0")), "session_id")
    log = log.withColumn("t", F.greatest(no, F.floor((F.unix_micros("at") - F.unix_micros("_t0")) / 1000).cast("bigint"))).drop("_t0")
    rank = ["at", "phase", "r_turn", "r_group", "r_item", "r_sub"]
    out = O.ordered_scan(stored(log, "run-log"), ["session_id"], rank, {"_pos": O.number()}, O.hours("at"))        # read twice
    return out.select("session_id", (F.col("_pos") - 1).alias("seq"), "t", "actor", "origin", "kind", "ref", "tok_in", "tok_out", "calls", "payload")


def run_agents(windows: DataFrame, sessions: DataFrame) -> DataFrame:
    """The agents declared in the header of a run."""
    fixed = sessions.select("session_id", F.explode(F.array(
        F.struct(F.lit(MAIN).alias("agent"), F.lit("principal").alias("role"), F.lit(0).alias("depth")),
        F.struct(F.lit(HUMAN).alias("agent"), F.lit("humain").alias("role"), F.lit(-1).alias("depth")))).alias("a")).select("session_id", "a.*")
    return fixed.unionByName(windows.select("session_id", F.col("actor").alias("agent"), "role", F.lit(1).alias("depth")))


def run_totals(sessions: DataFrame, turns: DataFrame, steps: DataFrame, eur_in: float = 0.0, eur_out: float = 0.0) -> DataFrame:
    """A24 — per run: model calls, tokens, cost, wall clock and human interventions."""
    first = turns.groupBy("session_id").agg(F.min("turn_no").alias("_first"))
    again = (turns.join(first, "session_id").groupBy("session_id").agg(F.count_if(
        (F.col("turn_no") > F.col("_first")) & ~F.col("is_sidechain") & ~X.is_blank("prompt")).alias("human_interventions")))
    read = X.total_input("input_tokens", "cache_read_tokens", "cache_creation_tokens")
    spent = steps.groupBy("session_id").agg(F.count(F.lit(1)).alias("calls"), F.sum(read).alias("tok_in"), F.sum("output_tokens").alias("tok_out"))
    return (sessions.join(again, "session_id").join(spent, "session_id", "left").fillna(0, ["calls", "tok_in", "tok_out"])
            .withColumns({"eur": F.bround(F.col("tok_in") / 1e6 * eur_in + F.col("tok_out") / 1e6 * eur_out, 4),
                          "wall_clock_ms": F.floor((F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1000)}))


# ------------------------------------------------------------------------------------------- spans
def span_id(*parts) -> Column:
    """Span ids come from the keys, so a replay writes the same spans again."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) and p in ("session", "task", "turn", "tool") else X._c(p).cast("string") for p in parts]), 256), 1, 16)


def spans(sessions: DataFrame, tasks: DataFrame, owners: DataFrame, turns: DataFrame, calls: DataFrame, steps: DataFrame, signals_wide: DataFrame | None = None,
          learner: str = "default", surface: str = "vscode", agent: str = "assistant", capture: bool = False, max_chars: int = 4000) -> DataFrame:
    """R08, S16 — the span tree session → task → turn → tool at the original times.

    ``owners`` says which task a turn belongs to. Text is only written when capture is on.
    """
    from turnstone.operators.signals import SIGNAL_KEYS
    common = {"session.id": F.col("session_id").cast("string"), "user.id": F.lit(learner), "coaching.learner": F.lit(learner),
              "coaching.surface": F.lit(surface), "coaching.source": F.lit("transcript")}

    def span(df: DataFrame, sid, parent, name, kind, start, end, **attrs) -> DataFrame:
        cells = [x for k, v in {**common, **attrs}.items() for x in (F.lit(k.replace("__", ".")), v.cast("string"))]
        return df.select("session_id", sid.alias("span_id"), parent.alias("parent_span_id"), name.alias("name"), kind.alias("kind"),
                         X._c(start).alias("start_at"), F.greatest(X._c(end), X._c(start)).alias("end_at"),
                         F.map_filter(F.create_map(*cells), lambda k, v: v.isNotNull()).alias("attributes"))

    c, text = F.col, (lambda x: X.truncate(x, max_chars, V.VALUE_MARKER))
    hidden = F.lit(None).cast("string")
    top = span_id("session", "session_id")
    with_turns = sessions.join(turns.select("session_id").distinct(), "session_id", "left_semi")
    meta = {f"coaching__{n}": c(x) for n, x in [("cwd", "cwd"), ("git_branch", "git_branch"), ("cc_version", "version"), ("entrypoint", "entrypoint")] if x in sessions.columns}
    s = span(with_turns, top, hidden, F.lit("session"), F.lit("AGENT"), "started_at", "ended_at", agent__name=F.lit(agent), **meta)

    t = tasks
    measured = {}
    if signals_wide is not None:
        t = tasks.join(signals_wide.select("session_id", "task_no", *SIGNAL_KEYS), ["session_id", "task_no"], "left")
        measured = {f"signal__{k}": c(k) for k in SIGNAL_KEYS}
    outcome = F.when(c("in_progress"), "in_progress").when(c("completed"), "completed").otherwise("open")
    t = span(t, span_id("task", "session_id", "task_no"), top, F.lit("task"), F.lit("CHAIN"), "started_at", "ended_at", coaching__task_id=c("task_id"), coaching__task_source=c("source"),
             coaching__task_decomposed=c("has_task_events"), coaching__active_minutes=F.bround(c("active_us") / 60e6, 1), coaching__rework_turns=c("rework_turns"),
             coaching__outcome=outcome, input__value=text("title"), **measured)

    read = X.total_input("input_tokens", "cache_read_tokens", "cache_creation_tokens")
    usage = steps.groupBy("session_id", "turn_no").agg(F.max(read).alias("_peak"), F.sum("output_tokens").alias("_out"), F.sum("cache_read_tokens").alias("_cache"),
                                                       F.max_by("model", "step_no").alias("_model"))
    u = turns.join(owners.select("session_id", "turn_no", "task_no"), ["session_id", "turn_no"]).join(usage, ["session_id", "turn_no"], "left")
    u = span(u, span_id("turn", "session_id", "turn_no"), span_id("task", "session_id", "task_no"), F.lit("turn"), F.when(c("is_sidechain"), "AGENT").otherwise("CHAIN"), "started_at", "ended_at",
             coaching__level=F.lit(1), coaching__signal=F.lit("prompt_clarity"), coaching__stop_reason=c("stop_reason"), coaching__outcome=F.when(completed("stop_reason"), "completed").otherwise("interrupted"),
             llm__token_count__prompt=F.when(c("_peak") > 0, c("_peak")), llm__token_count__completion=F.when(c("_out") > 0, c("_out")),
             **{"llm.token_count.prompt_details.cache_read": F.when(c("_cache") > 0, c("_cache")), "llm.model_name": c("_model"),
                "input.value": F.when(c("prompt") != "", text("prompt")) if capture else hidden})

    k = calls.join(owners.select("session_id", "turn_no"), ["session_id", "turn_no"], "left_semi")
    end = F.coalesce("result_at", F.timestamp_micros(F.unix_micros("called_at") + F.coalesce((c("duration_ms") * 1000).cast("bigint"), F.lit(0).cast("bigint"))))
    k = span(k, span_id("tool", "session_id", "call_no"), span_id("turn", "session_id", "turn_no"), F.concat(F.lit("tool."), c("name")), F.lit("TOOL"), "called_at", end,
             tool__name=c("name"), coaching__tool_use_id=c("call_id"), coaching__level=F.lit(3), coaching__signal=F.when(c("failed"), "tool_failure_rate").otherwise("harness_breadth"),
             coaching__outcome=F.when(c("failed"), "failed").otherwise("ok"), coaching__mcp_server=X.mcp_server("name"),
             **{"input.value": text("input_json") if capture else hidden, "error.message": F.when(c("failed"), c("failure_reason"))})
    return s.unionByName(t).unionByName(u).unionByName(k)


def annotations(signals: DataFrame, max_chars: int = 4000) -> DataFrame:
    """S15 — signals as annotations of their task span: NULL score kept, explanation cut, upsert key (span_id, identifier)."""
    return signals.select(span_id("task", "session_id", "task_no").alias("span_id"), F.col("signal").alias("name"), F.lit("CODE").alias("annotator_kind"),
                          F.col("value").alias("score"), X.truncate("evidence", max_chars, V.VALUE_MARKER).alias("explanation"),
                          F.create_map(F.lit("level"), F.col("level").cast("string"), F.lit("source"), F.lit("transcript")).alias("metadata"),
                          F.col("signal").alias("identifier"))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """S15 — incoming rows replace those of the same key."""
    return existing.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def ingest_counts(tasks: DataFrame, owners: DataFrame, calls: DataFrame, signals: DataFrame) -> DataFrame:
    """A25 — sessions, tasks, turns, calls and signals of an ingestion (one-row tables joined)."""
    n = F.count(F.lit(1))
    mine = calls.join(owners.select("session_id", "turn_no"), ["session_id", "turn_no"], "left_semi")
    return (tasks.agg(F.count_distinct("session_id").alias("sessions"), n.alias("tasks")).crossJoin(owners.agg(n.alias("turns")))
            .crossJoin(mine.agg(n.alias("tool_calls"))).crossJoin(signals.agg(n.alias("signals"))))


def session_lines(sessions: DataFrame, turns: DataFrame, calls: DataFrame, tasks: DataFrame) -> DataFrame:
    """A27 — one summary line per session."""
    n = F.count(F.lit(1))
    return (sessions.select("session_id", "started_at", F.round((F.unix_micros("ended_at") - F.unix_micros("started_at")) / 60e6).cast("bigint").alias("minutes"))
            .join(turns.groupBy("session_id").agg(n.alias("turns")), "session_id").join(calls.groupBy("session_id").agg(n.alias("tools")), "session_id", "left")
            .join(tasks.groupBy("session_id").agg(n.alias("tasks")), "session_id", "left").fillna(0, ["tools", "tasks"]))


def last_turn_usage(steps: DataFrame) -> DataFrame:
    """A28 — usage of each turn: peak prompt, output and cache sums, last model."""
    read = X.total_input("input_tokens", "cache_read_tokens", "cache_creation_tokens")
    return steps.groupBy("session_id", "turn_no").agg(
        F.max_by("model", "step_no").alias("model"), F.max(read).alias("prompt_tokens"), F.sum("output_tokens").alias("completion_tokens"),
        F.sum("cache_read_tokens").alias("cache_read_tokens"))
