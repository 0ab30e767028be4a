"""Session tables over the driver's parquet: calls from ``events``, turns from ``conversations``.

The tables are written once per session and input folder to the shared folder, so that the many
queries above them scan a few columns instead of rebuilding sessions each time.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.functions import exprs as X
from turnstone.operators import events as E, ordered as O, signals as G, tasks as K
from turnstone.session import prepare, stored

# stand-in rules that exercise the boundary decision on the synthetic texts
RULES = K.BoundaryRules(silence_minutes=720, unfinished_minutes=240, short_chars=400, corrective=["th", "le", "in"],
                        referential=r"\b(que|le|the|and|der|el)\b")
ACCEPTANCE = r"\b(que|the|der|las?)\b"
IDLE_MINUTES = 360
CONTEXT_WINDOW = 1_000


class Tables:
    """Driver tables and the session tables derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = prepare(spark), sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        """A driver table; zone-less timestamps become instants so that watermarks accept them."""
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        ntz = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df

    @cached_property
    def calls(self) -> DataFrame:
        e = self.raw("events").select("event_id", "ts", "user_id", "event_type", "value", "props")
        seen = O.ordered_scan(e, ["user_id"], ["ts", "event_id"],
                              {"pos": O.number(), "result_at": O.lead(F.col("ts"))}, O.hours("ts"))
        asked = self.prompts.groupBy("session_id").agg(F.count(F.lit(1)).alias("prompts"))
        seen = seen.join(asked, F.col("user_id") == F.col("session_id"), "left").drop("session_id").withColumn("prompts", F.coalesce("prompts", F.lit(1)))
        rows = seen.selectExpr(
            "user_id AS session_id", "event_id AS call_id", "ts AS called_at", "result_at", "pos - 1 AS call_no",
            "least(CAST(floor((pos - 1) / 5) AS BIGINT), prompts - 1) AS turn_no", "value", "event_type",
            """CASE event_type WHEN 'click' THEN 'Read' WHEN 'view' THEN 'Grep' WHEN 'purchase' THEN 'Edit'
               WHEN 'signup' THEN 'Task' ELSE 'Bash' END AS tool""",
            "event_id % 6 = 0 AS failed", "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 3 AS arg",
            "CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'pytest -q' ELSE 'ls' END AS command",
            "CASE event_id % 4 WHEN 0 THEN 'x-opus' WHEN 1 THEN 'x-sonnet' WHEN 2 THEN 'x-haiku' ELSE 'other' END AS model",
            "CAST(floor(value) AS BIGINT) AS input_tokens",
            "CASE WHEN event_id % 2 = 0 THEN 3 * CAST(floor(value) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS cache_read_tokens",
            "event_id % 7 * 10 AS cache_creation_tokens", "event_id % 50 AS output_tokens",
            "1 + event_id % 3 AS tool_blocks")
        rows = rows.selectExpr(
            "*",
            """CASE WHEN call_id % 11 = 0 THEN concat('mcp__srv', call_id % 3, '__query') WHEN call_id % 13 = 0 THEN 'Skill'
               WHEN call_id % 17 = 0 THEN 'TaskCreate' ELSE tool END AS name""",
            """CASE tool WHEN 'Bash' THEN concat('{"command":"', command, '"}')
               WHEN 'Read' THEN concat('{"file_path":"src/f', arg, '.py"', CASE WHEN arg = 0 THEN ',"offset":10' ELSE '' END, '}')
               WHEN 'Grep' THEN concat('{"pattern":"p', arg, '"}')
               WHEN 'Task' THEN concat('{"subagent_type":"agent', arg, '"}')
               ELSE concat('{"path":"src/e', arg, '.py","old":null}') END AS input_json""",
            "CASE WHEN failed THEN CASE call_id % 4 WHEN 0 THEN 'is_error' ELSE 'code=1' END END AS failure_reason",
            "CASE WHEN call_id % 19 = 0 THEN concat('skill-', call_id % 2) END AS skill",
            "CAST(unix_micros(result_at) - unix_micros(called_at) AS DOUBLE) / 1000 AS duration_ms")
        return stored(rows, "calls")

    @cached_property
    def prompts(self) -> DataFrame:
        """Prompts of a conversation, numbered from 0."""
        c = self.raw("conversations").filter(F.col("role").isin("user", "system"))
        return O.ordered_scan(c, ["conv_id"], ["turn"], {"pos": O.number()}, O.runs("turn")).select(
            F.col("conv_id").alias("session_id"), (F.col("pos") - 1).alias("turn_no"), "role", "turn",
            F.col("text").alias("prompt"))

    @cached_property
    def turns(self) -> DataFrame:
        """Turn j of a conversation owns calls 5j to 5j+4 of the session of the same number, the last turn all later ones.

        A session without prompts has one turn with an empty prompt, as a session that goes on from another file."""
        spans = self.calls.groupBy("session_id", "turn_no").agg(
            F.min("called_at").alias("started_at"), F.max_by("called_at", "call_no").alias("ended_at"), F.max_by("call_id", "call_no").alias("last_call"))
        t = spans.join(self.prompts, ["session_id", "turn_no"], "left").selectExpr(
            "session_id", "turn_no", "coalesce(prompt, '') AS prompt", "coalesce(role = 'system', false) AS is_sidechain", "started_at", "ended_at",
            """CASE last_call % 4 WHEN 2 THEN 'tool_use' WHEN 3 THEN CAST(NULL AS STRING) ELSE 'end_turn' END AS stop_reason""")
        return stored(t, "turns")

    @cached_property
    def turn_calls(self) -> DataFrame:
        """Calls that belong to a turn: every one does."""
        return self.calls

    @cached_property
    def sessions(self) -> DataFrame:
        """Sessions that have turns, over all their calls."""
        s = self.calls.groupBy("session_id").agg(F.min("called_at").alias("started_at"), F.max("called_at").alias("ended_at"),
                                                 F.min_by("event_type", "call_no").alias("entrypoint"))
        return stored(s.join(self.turns.select("session_id").distinct(), "session_id", "left_semi"), "sessions")

    @cached_property
    def windows(self) -> DataFrame:
        return stored(E.agent_windows(self.turn_calls, self.turns, self.sessions), "windows")

    @cached_property
    def actors(self) -> DataFrame:
        return stored(E.turn_actors(self.turns, self.windows), "actors")

    @cached_property
    def run_log(self) -> DataFrame:
        log = E.run_events(self.sessions, self.turns, self.turn_calls, self.steps, idle_minutes=IDLE_MINUTES, windows=self.windows,
                           actors=self.actors.select("session_id", "turn_no", "actor"))
        return stored(log, "run_events")

    @property
    def steps(self) -> DataFrame:
        return self.turn_calls.select(
            "session_id", "turn_no", F.col("call_no").alias("step_no"), F.col("called_at").alias("at"), "model",
            "input_tokens", "cache_read_tokens", "cache_creation_tokens", "output_tokens", "tool_blocks")

    @property
    def turn_skills(self) -> DataFrame:
        return self.turn_calls.filter("skill IS NOT NULL").select("session_id", "turn_no", "skill").distinct()

    @cached_property
    def task_turns(self) -> DataFrame:
        return stored(K.number_tasks(K.boundary_decisions(self.turns, RULES)), "task_turns")

    @cached_property
    def agent_turns(self) -> DataFrame:
        return stored(K.attach_agent_turns(self.turns, self.task_turns), "agent_turns")

    @cached_property
    def turn_active(self) -> DataFrame:
        marks = K.turn_marks(self.turns, self.turn_calls, self.steps)
        return stored(K.active_time(marks, ["session_id", "turn_no"], IDLE_MINUTES), "turn_active")

    @cached_property
    def tasks(self) -> DataFrame:
        return stored(K.task_rollup(self.task_turns, self.agent_turns, self.turn_calls, self.turn_active), "tasks")

    @cached_property
    def signals_wide(self) -> DataFrame:
        wide = G.signals_wide(self.tasks, self.task_turns, self.turn_calls, self.steps, self.turn_skills, self.turns,
                              self.agent_turns, CONTEXT_WINDOW, ACCEPTANCE)
        return stored(wide, "signals_wide")

    @cached_property
    def signals(self) -> DataFrame:
        """One row per task and signal, written so that a query on values does not carry the sentences."""
        return stored(G.signals_long(self.signals_wide), "signals")


_cache: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """One set of session tables per application and input folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _cache:
        _cache[key] = Tables(spark, sf_dir)
    return _cache[key]
