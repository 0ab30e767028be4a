"""Live hook events to spans (ST01-ST12).

The stream carries its own event time. State lives in the checkpointed store, so a restarted query continues where
it stopped. Stateless parts are plain projections; only the pairing of open and close events keeps state.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from turnstone.functions import exprs as X
from turnstone.functions import fixed_values as V
from turnstone.session import shared_dir

HOOK_SCHEMA = (
    "ts timestamp, url_segment string, hook_event_name string, session_id string, prompt_id string, tool_name string, tool_use_id string, "
    "tool_execution_time_ms double, agent_id string, agent_type string, stop_reason string, error_message string")


def parse_hooks(lines: DataFrame, value: str = "value") -> DataFrame:
    """ST01 — hook bodies as text to typed rows. A bad body gives NULL fields and is dropped by the name filter, never an error."""
    return lines.select(F.from_json(value, HOOK_SCHEMA).alias("h")).select("h.*")


def canonical(hooks: DataFrame) -> DataFrame:
    """ST01 — name from the body or the URL; unknown events are left out."""
    name = X.hook_name("hook_event_name", "url_segment")
    known = list(V.HOOK_ROUTES.values())
    return hooks.withColumn("hook", name).filter(F.col("hook").isin(known))


def markers(hooks: DataFrame) -> DataFrame:
    """ST06 — zero-length spans for compaction, batches, task events and denials."""
    def pick(i: int) -> Column:
        cells = [F.lit(x) for k, v in V.HOOK_MARKERS.items() for x in (k, v[i])]
        return F.try_element_at(F.create_map(*cells), F.col("hook"))
    return (hooks.filter(F.col("hook").isin(list(V.HOOK_MARKERS))).select(
        "session_id", "prompt_id", "ts", "hook", pick(0).alias("name"), pick(1).alias("kind"), pick(2).alias("level"), pick(3).alias("signal"), "tool_name"))


def tool_spans(hooks: DataFrame) -> DataFrame:
    """ST05 — the span of a tool call, rebuilt from its end and its duration."""
    took = F.greatest(F.lit(0.0), F.coalesce("tool_execution_time_ms", F.lit(0.0)))
    start = F.timestamp_micros(F.unix_micros("ts") - (took * 1000).cast("bigint"))
    ok = F.col("hook") == "PostToolUse"
    return hooks.filter(F.col("hook").isin("PostToolUse", "PostToolUseFailure")).select(
        "session_id", "prompt_id", F.concat(F.lit("tool."), F.coalesce("tool_name", F.lit("unknown"))).alias("name"), start.alias("start_at"),
        F.col("ts").alias("end_at"), F.when(ok, "harness_breadth").otherwise("tool_failure_rate").alias("signal"), F.when(ok, "ok").otherwise("failed").alias("outcome"))


# ------------------------------------------------------------------------------- stateful pairing
SPAN_SCHEMA = ("session_id string, scope string, id string, name string, parent string, start_us bigint, end_us bigint, outcome string, reason string, "
               "model string, prompt_tokens bigint, completion_tokens bigint, cache_read_tokens bigint")
STATE_SCHEMA = "name string, parent string, opened_us bigint, seen_us bigint, reason string, model string, peak bigint, output bigint, cache bigint"
_US = 1_000_000


EVENT_COLUMNS = ["session_id", "us", "tie", "hook", "prompt_id", "tool_name", "tool_use_id", "tool_execution_time_ms", "agent_id", "agent_type", "model", "total_in",
                 "output_tokens", "cache_read_tokens"]
OUT_ROWS = 5_000
GROUPS = 1_024


def _group(groups: int) -> Column:
    """The state group of a session. A call of a state processor costs some 20 ms before any row is read, so sessions share calls."""
    return F.pmod(F.xxhash64("session_id"), F.lit(groups)).cast("int")


class SpanPairing(StatefulProcessor):
    """ST02-ST05, ST07, ST09 — open and close events of a session paired into spans, in event-time order.

    A state group holds the sessions of one hash value; each session has its own open spans, so the group changes no result. Events wait in
    state until the watermark passes them and are then taken in the order ``(us, tie)``, so the result does not
    depend on how rows are spread over files, micro-batches and Arrow batches. An Arrow batch waits as one sorted entry under its first
    and last time; release merges the entries, opening each only when the merge reaches its first row, and writes back what is not due. Open spans of
    a group are loaded once per call, and those that changed are written back. A span that is not seen for ``idle_hours`` of event time is
    closed as abandoned. One timer per group wakes it for the first waiting event or idle span.
    """

    def __init__(self, idle_hours: float = V.IDLE_SESSION_HOURS):
        self.idle_us = int(idle_hours * 3600 * _US)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "session_id string, key string", STATE_SCHEMA)
        self.waiting = handle.getMapState("waiting", "lo bigint, hi bigint, n bigint", "rows binary")
        self.serial = handle.getValueState("serial", "n bigint")

    def _wait(self, rows: pa.Table) -> None:
        """Put sorted rows into the buffer as one entry."""
        n = self.serial.get()[0] + 1 if self.serial.exists() else 0
        self.serial.update((n,))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as writer:
            writer.write_table(rows)
        us = rows.column("us")
        self.waiting.updateValue((us[0].as_py(), us[-1].as_py(), n), (sink.getvalue().to_pybytes(),))

    def _due(self, limit: int) -> Iterator[dict]:
        """Waiting events before ``limit`` in order; they leave the buffer."""
        entries = sorted(k for k in self.waiting.keys() if k[0] < limit)
        heads: list = []
        while entries or heads:
            while entries and (not heads or entries[0][0] <= heads[0][0]):
                key = entries.pop(0)
                rows = pa.ipc.open_stream(self.waiting.getValue(key)[0]).read_all()
                self.waiting.removeKey(key)
                ready = int(np.searchsorted(rows.column("us").to_numpy(), limit))
                if ready < rows.num_rows:
                    self._wait(rows.slice(ready))
                found = iter(rows.slice(0, ready).to_pylist())
                first = next(found)
                heapq.heappush(heads, (first["us"], first["tie"], key[2], first, found))
            _, _, n, event, found = heads[0]
            yield event
            following = next(found, None)
            if following is None:
                heapq.heappop(heads)
            else:
                heapq.heapreplace(heads, (following["us"], following["tie"], n, following, found))

    # one row per closed span, in SPAN_SCHEMA order
    def _span(self, session, key, s, end, outcome, usage=False):
        scope, _, ident = key.partition(":")
        base = [session, scope, ident, s["name"], s["parent"], s["opened_us"], max(end, s["opened_us"]), outcome, s["reason"]]
        return base + ([s["model"], s["peak"], s["output"], s["cache"]] if usage else [None, None, None, None])

    def _store(self, before: dict[tuple, tuple], spans: dict[str | None, dict[str, dict]]) -> None:
        now = {(session, key): tuple(s.values()) for session, of in spans.items() for key, s in of.items()}
        for at in before.keys() - now.keys():
            self.open.removeKey(at)
        for at, s in now.items():
            if before.get(at) != s:
                self.open.updateValue(at, s)

    def _reset_timer(self, spans: dict[str | None, dict[str, dict]], watermark: int) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        first = min([k[0] for k in self.waiting.keys()] + [s["seen_us"] + self.idle_us for of in spans.values() for s in of.values()], default=None)
        if first is not None:
            self.handle.registerTimer(max(first // 1000, watermark + 1))

    def _sweep(self, session, spans, now, out) -> None:
        for key in [k for k, s in spans.items() if s["seen_us"] + self.idle_us <= now]:
            s = spans.pop(key)
            out.append(self._span(session, key, s, s["seen_us"] + self.idle_us, "abandoned"))

    def _open(self, session, spans, scope, ident, name, parent, now, out, reason=None) -> str:
        key = f"{scope}:{ident}"
        if key in spans:
            out.append(self._span(session, key, spans.pop(key), now, "superseded"))
        spans[key] = {"name": name, "parent": parent, "opened_us": now, "seen_us": now, "reason": reason, "model": None, "peak": 0, "output": 0, "cache": 0}
        return key

    def _session(self, session, spans, now, out) -> str:
        key = f"session:{session}"
        if key not in spans:
            return self._open(session, spans, "session", session, "session", None, now, out, "recovered")
        spans[key]["seen_us"] = now
        return key

    def _context(self, session, spans, prompt, now, out) -> str:
        key = f"prompt:{prompt}"
        if prompt and key in spans:
            spans[key]["seen_us"] = now
            return key
        return self._session(session, spans, now, out)

    def _event(self, session, e, spans, out) -> None:
        now, hook, prompt = int(e["us"]), e["hook"], e["prompt_id"]
        self._sweep(session, spans, now, out)
        turn = prompt or session
        if hook == "SessionStart":
            self._open(session, spans, "session", session, "session", None, now, out, "start")
        elif hook == "SessionEnd":
            s = spans.pop(f"session:{session}", None)
            if s:
                out.append(self._span(session, f"session:{session}", s, now, "ended"))
        elif hook == "UserPromptSubmit":
            parent = self._session(session, spans, now, out)
            self._open(session, spans, "prompt", turn, "turn", parent, now, out)
        elif hook in ("Stop", "StopFailure"):
            key = f"prompt:{turn}"
            s = spans.pop(key, None)
            if s:
                out.append(self._span(session, key, s, now, "completed" if hook == "Stop" else "failed"))
                if s["model"] is not None:       # the model calls of the turn, without any text
                    child = {**s, "name": "llm", "parent": key, "opened_us": now}
                    out.append(self._span(session, f"llm:{turn}", child, now, "ok", usage=True))
        elif hook in ("PostToolUse", "PostToolUseFailure"):
            parent = self._context(session, spans, prompt, now, out)
            start = now - int(max(0.0, e["tool_execution_time_ms"] or 0.0) * 1000)
            s = {"name": f"tool.{e['tool_name'] or 'unknown'}", "parent": parent, "opened_us": start, "reason": None}
            out.append(self._span(session, f"tool:{e['tool_use_id']}", s, now, "ok" if hook == "PostToolUse" else "failed"))
        elif hook == "SubagentStart" and e["agent_id"]:
            parent = self._context(session, spans, prompt, now, out)
            self._open(session, spans, "agent", e["agent_id"], f"agent.{e['agent_type'] or 'unknown'}", parent, now, out)
        elif hook == "SubagentStop" and e["agent_id"]:
            key = f"agent:{e['agent_id']}"
            s = spans.pop(key, None)
            if s:
                out.append(self._span(session, key, s, now, "ended"))
        elif hook in V.HOOK_MARKERS:
            parent = self._context(session, spans, prompt, now, out)
            s = {"name": V.HOOK_MARKERS[hook][0], "parent": parent, "opened_us": now, "reason": None}
            out.append(self._span(session, f"marker:{e['tool_use_id']}", s, now, "ok"))
        elif hook == "usage":                    # one model call of the running turn, from the session log
            s = spans.get(f"prompt:{turn}")
            if s:
                s["model"] = e["model"]
                s["peak"] = max(s["peak"], int(e["total_in"]))
                s["output"] += int(e["output_tokens"])
                s["cache"] += int(e["cache_read_tokens"])

    def _advance(self, watermark: int) -> Iterator[pd.DataFrame]:
        """Everything that the watermark has passed: events in order, then idle spans."""
        limit, out = watermark * 1000, []
        names = [f.split()[0] for f in STATE_SCHEMA.split(", ")]
        before = {tuple(k): tuple(v) for k, v in self.open.iterator()}
        spans: dict[str | None, dict[str, dict]] = {}
        for (session, key), s in before.items():
            spans.setdefault(session, {})[key] = dict(zip(names, s))
        for e in self._due(limit):
            self._event(e["session_id"], e, spans.setdefault(e["session_id"], {}), out)
            if len(out) >= OUT_ROWS:
                yield _frame(out)
                out = []
        for session, of in spans.items():
            self._sweep(session, of, limit - 1, out)
            if len(out) >= OUT_ROWS:
                yield _frame(out)
                out = []
        self._store(before, spans)
        self._reset_timer(spans, watermark)
        if out:
            yield _frame(out)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for chunk in rows:
            if len(chunk):
                self._wait(pa.Table.from_pandas(chunk[EVENT_COLUMNS].sort_values(["us", "tie"], kind="stable"), preserve_index=False))
        yield from self._advance(timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._advance(timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def _frame(rows: list) -> pd.DataFrame:
    names = [f.split()[0] for f in SPAN_SCHEMA.split(", ")]
    df = pd.DataFrame(rows, columns=names)
    for f in SPAN_SCHEMA.split(", "):
        name, kind = f.split()
        df[name] = df[name].astype("Int64" if kind == "bigint" else object)
    return df


def pair_spans(hooks: DataFrame, watermark: str = "10 minutes", idle_hours: float = V.IDLE_SESSION_HOURS, groups: int = GROUPS) -> DataFrame:
    """ST02 — spans of a hook stream; needs the RocksDB state store.

    Columns: ts, tie, hook, session_id, prompt_id, tool_name, tool_use_id, tool_execution_time_ms, agent_id, agent_type, model,
    total_in, output_tokens, cache_read_tokens. Sessions are dealt over ``groups`` state groups; a checkpoint keeps to the number it began with.
    """
    rows = hooks.withColumns({"us": F.unix_micros("ts"), "state_group": _group(groups)}).withWatermark("ts", watermark)
    return rows.groupBy("state_group").transformWithStateInPandas(
        statefulProcessor=SpanPairing(idle_hours), outputStructType=SPAN_SCHEMA, outputMode="append", timeMode="eventTime")


# ----------------------------------------------------------------------------- windows over the live path
def idle_sessions(events: DataFrame, key: str = "session_id", gap: str = "6 hours", watermark: str = "10 minutes") -> DataFrame:
    """ST07 — sessions closed by inactivity, as an aggregate: one row when the gap has passed."""
    return (events.withWatermark("ts", watermark).groupBy(key, F.session_window("ts", gap).alias("w"))
            .agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at")))


def hook_counts(events: DataFrame, width: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """ST12 — tumbling counts per hook."""
    return (events.withWatermark("ts", watermark).groupBy(F.window("ts", width).alias("w"), "hook")
            .agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start_at"), "hook", "n"))


def failure_rate(events: DataFrame, width: str = "1 day", slide: str = "6 hours", watermark: str = "10 minutes") -> DataFrame:
    """ST12 — sliding failure rate of tool calls."""
    calls = events.filter(F.col("hook").isin("PostToolUse", "PostToolUseFailure"))
    return (calls.withWatermark("ts", watermark).groupBy(F.window("ts", width, slide).alias("w"))
            .agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("hook") == "PostToolUseFailure").alias("failures"))
            .select(F.col("w.start").alias("start_at"), "calls", "failures"))


TURN_SCHEMA = "model string, prompt_tokens bigint, completion_tokens bigint, cache_read_tokens bigint"


TURN_KEY = ["session_id", "prompt_id"]


class TurnUsage(StatefulProcessor):
    """ST08 — usage of running turns, each forgotten when the watermark is ``keep_hours`` past its last step.

    A state group holds the sessions of one hash value; its running turns are one list, read and written in one go. Each
    Arrow batch is folded to one row per turn before it meets the others.
    """

    def __init__(self, keep_hours: float = V.IDLE_SESSION_HOURS):
        self.keep_us = int(keep_hours * 3600 * _US)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", f"session_id string, prompt_id string, last_us bigint, last_no bigint, {TURN_SCHEMA}")

    def _load(self) -> dict[tuple, tuple]:
        return {row[:2]: row[2:] for row in self.turns.get()} if self.turns.exists() else {}

    def _store(self, turns: dict[tuple, tuple], watermark: int) -> None:
        """The running turns, and one timer for the turn that ends first."""
        if turns:
            self.turns.put([k + s for k, s in turns.items()])
        else:
            self.turns.clear()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if turns:
            self.handle.registerTimer(max((min(s[0] for s in turns.values()) + self.keep_us) // 1000, watermark + 1))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        turns, seen = self._load(), {}
        for chunk in rows:
            chunk = chunk.sort_values(["us", "step_no"], ignore_index=True)
            by_turn = chunk.groupby(TURN_KEY, dropna=False, sort=False)
            most, made, cached = by_turn["total"].transform("max"), by_turn["output_tokens"].transform("sum"), by_turn["cache_read_tokens"].transform("sum")
            last = by_turn.tail(1).index
            cells = [chunk[c] for c in (*TURN_KEY, "us", "step_no", "model")] + [most, made, cached]
            for session, prompt, us, no, model, most, made, cached in zip(*(c.loc[last].tolist() for c in cells)):
                at = (session, prompt)
                old = turns.get(at, (-1, -1, None, 0, 0, 0))
                head = (int(us), int(no), model) if (us, no) >= old[:2] else old[:3]
                turns[at] = seen[at] = (*head, max(old[3], most), old[4] + made, old[5] + cached)
        self._store(turns, timerValues.getCurrentWatermarkInMs())
        if seen:
            names = TURN_KEY + [f.split()[0] for f in TURN_SCHEMA.split(", ")]
            yield pd.DataFrame([at + s[2:] for at, s in seen.items()], columns=names)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        self._store({at: s for at, s in self._load().items() if s[0] + self.keep_us >= watermark * 1000}, watermark)
        return iter([])

    def close(self) -> None:
        pass


def last_turns(steps: DataFrame, watermark: str = "10 minutes", keep_hours: float = V.IDLE_SESSION_HOURS, groups: int = GROUPS) -> DataFrame:
    """ST08 — usage of each turn so far; a step without a prompt is left out, so it never counts for another turn.

    A turn's state lives until the watermark is ``keep_hours`` past its last step, so the store holds running turns only. Sessions are dealt over
    ``groups`` state groups; a checkpoint keeps to the number it began with.
    """
    total = X.total_input("input_tokens", "cache_read_tokens", "cache_creation_tokens")
    rows = steps.filter(F.coalesce("prompt_id", F.lit("")) != "").withWatermark("ts", watermark).select(
        "session_id", "prompt_id", "ts", _group(groups).alias("state_group"), F.unix_micros("ts").alias("us"), F.col("step_no").cast("bigint").alias("step_no"), "model",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(n) for c, n in ((total, "total"), (F.col("output_tokens"), "output_tokens"), (F.col("cache_read_tokens"), "cache_read_tokens"))])
    return rows.groupBy("state_group").transformWithStateInPandas(
        statefulProcessor=TurnUsage(keep_hours), outputStructType=f"session_id string, prompt_id string, {TURN_SCHEMA}", outputMode="update", timeMode="eventTime")


# --------------------------------------------------------------------------------------- running
def use_rocksdb(spark: SparkSession) -> None:
    """State processors with several states and timers need this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def drain(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over everything available and read its output back."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", checkpoint or f"{base}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def drain_updates(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run an update-mode stream; each micro-batch replaces its own folder, and the latest row per key counts."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    q = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    rows = spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_r")).select(*keys, "_r.*")


def deliver(stream: DataFrame, send: Callable[[DataFrame, int], None], abandoned: str, tries: int = 3, identifier: str = "identifier",
            watermark: str = "1 hour", checkpoint: str | None = None, commits: str | None = None):
    """ST11 — hand each micro-batch to ``send``; after the last try its rows go to the ``abandoned`` folder instead of stopping the stream.

    Repeats of an identifier within the watermark are sent once. A batch that was sent or abandoned leaves a row in the ``commits`` table; a
    restarted query that replays the batch finds it there and does not send it again.
    """
    spark = stream.sparkSession
    once = stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([identifier])
    place = checkpoint or f"{shared_dir(spark)}/deliver-{uuid.uuid4().hex}"
    log = commits or f"{place}-commits"
    done = {r["batch"] for r in _commits(spark, log).select("batch").collect()}          # one short row per batch

    def put(batch: DataFrame, batch_id: int) -> None:
        if batch_id in done:
            return batch.write.format("noop").mode("overwrite").save()          # the identifiers seen still go into the state
        outcome = "sent"
        for attempt in range(tries + 1):
            try:
                send(batch, batch_id)
                break
            except Exception as e:  # noqa: BLE001 — any failure of the receiver counts as a try
                reason = f"{type(e).__name__}: {e}"[:200]
        else:
            outcome = "abandoned"
            batch.withColumn("reason", F.lit(reason)).write.mode("overwrite").parquet(f"{abandoned}/batch_id={batch_id}")
        spark.createDataFrame([(batch_id, outcome)], COMMIT_SCHEMA).coalesce(1).write.mode("append").parquet(log)
        done.add(batch_id)

    return once.writeStream.foreachBatch(put).option("checkpointLocation", place).trigger(availableNow=True).start()


COMMIT_SCHEMA = "batch bigint, outcome string"


def _commits(spark: SparkSession, log: str) -> DataFrame:
    try:
        return spark.read.schema(COMMIT_SCHEMA).parquet(log)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT_SCHEMA)


def abandoned_rows(spark: SparkSession, abandoned: str, schema) -> DataFrame:
    """ST11 — the rows given up, with ``reason`` and ``batch_id``; none when the folder was never written."""
    try:
        return spark.read.option("basePath", abandoned).parquet(abandoned)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema).withColumns({"reason": F.lit(""), "batch_id": F.lit(0)})


def read_events(spark: SparkSession, folder: str, schema, files: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)
