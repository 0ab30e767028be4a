"""Whole jobs from a transcript folder: session tables, weekly review, retrospective, event log, spans, probe."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.functions import fixed_values as V
from turnstone.operators import dims, events as E, ordered as O, retro as T, review as R, signals as G, tasks as K, transcript as TR, usage as U
from turnstone.session import stored
from turnstone.sources import files as SF, transcripts as ST


@dataclass(frozen=True)
class Settings:
    """Defaults of a job; ``budget`` is the weekly number of read tokens a seat is compared with (0 = no reference)."""
    rules: K.BoundaryRules = field(default_factory=K.BoundaryRules)
    idle_minutes: float = V.IDLE_GAP_MINUTES
    context_window: int = V.CONTEXT_WINDOW
    budget: int = 0
    hooks: bool = False
    capture_text: bool = False
    specs: str | None = None            # a data file that replaces the built-in signal specs when it is complete

    def spec_table(self, spark: SparkSession) -> DataFrame:
        return SF.load_specs(spark, self.specs)[0]


def _numbered(rows: DataFrame, order: list[str], into: str) -> DataFrame:
    """Places within the session over all its files: in order of file, line and block, from 0."""
    cut = F.struct("file", F.floor(F.col("line_no") / 100_000).alias("lines"))
    return O.ordered_scan(rows, ["session_id"], order, {into: O.number()}, cut).withColumn(into, F.col(into) - 1)


def session_tables(spark: SparkSession, root: str, settings: Settings = Settings(), **reading) -> dict[str, DataFrame]:
    """All session tables of a folder; ``reading`` takes the options of ``read_lines`` (pattern, modified_after, limit_files)."""
    scanned = stored(ST.scan(ST.number_lines(ST.read_lines(spark, root, **reading))), "lines")
    parts = TR.build_sessions(ST.records(scanned))
    calls = stored(_numbered(parts["calls"], ["file", "line_no", "pos"], "call_no").withColumn("call_id", F.col("tool_use_id")), "calls")
    steps = stored(_numbered(parts["steps"], ["file", "line_no"], "step_no"), "steps")
    turns = parts["turns"]
    task_turns = stored(K.number_tasks(K.boundary_decisions(turns, settings.rules)), "task_turns")
    agents = stored(K.attach_agent_turns(turns, task_turns), "agent_turns")
    active = stored(K.active_time(K.turn_marks(turns, calls, steps), ["session_id", "turn_no"], settings.idle_minutes), "active")
    tasks = stored(K.task_rollup(task_turns, agents, calls, active), "tasks")
    wide = stored(G.signals_wide(tasks, task_turns, calls, steps, parts["turn_skills"], turns, agents, settings.context_window), "signals")
    owners = U.all_turns(task_turns, agents)
    return {"lines": scanned, "sessions": parts["sessions"], "turns": turns, "calls": calls, "steps": steps, "turn_skills": parts["turn_skills"], "task_turns": task_turns,
            "agent_turns": agents, "owners": owners, "tasks": tasks, "signals_wide": wide, "signals": stored(G.signals_long(wide), "signals_long"),
            "weeks": U.week_usage(tasks, owners, calls, steps, active), "parse_report": TR.parse_report(scanned)}


def weekly_review(t: dict[str, DataFrame], as_of: str, week: str | None = None, settings: Settings = Settings()) -> dict[str, DataFrame]:
    return R.weekly_review(t["signals"], t["signals_wide"], t["weeks"], t["calls"], t["task_turns"], as_of, week, settings.budget, settings.hooks,
                           specs=settings.spec_table(t["signals"].sparkSession))


def retrospective(t: dict[str, DataFrame], since: str | None = None, until: str | None = None, settings: Settings = Settings()) -> dict[str, DataFrame]:
    dated = R.with_week(dims.with_spec(t["signals"], settings.spec_table(t["signals"].sparkSession))).filter("target IS NOT NULL").withColumn("day", F.to_date("started_at"))
    seen = R.with_week(t["owners"]).select("week", "monday", "session_id").distinct()
    return T.retrospective(dated, t["weeks"], seen, ["signal"], since, until)


def run_log(t: dict[str, DataFrame], settings: Settings = Settings(), **costs) -> DataFrame:
    return E.run_events(t["sessions"].join(t["turns"].select("session_id").distinct(), "session_id", "left_semi"), t["turns"], t["calls"], t["steps"],
                        capture_text=settings.capture_text, idle_minutes=settings.idle_minutes, **costs)


def span_tree(t: dict[str, DataFrame], settings: Settings = Settings()) -> DataFrame:
    return E.spans(t["sessions"], t["tasks"], t["owners"], t["turns"], t["calls"], t["steps"], t["signals_wide"], capture=settings.capture_text)


def probe(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A01-A06 — what the log contains, without a word of its text."""
    records = TR.mark_humans(ST.records(t["lines"]))
    raw = t["lines"].filter("readable").select(F.try_variant_get("raw", "$.type", "string").alias("type"), "value")
    fields = TR.fields_by_type(raw, "type", "value")
    return {"report": t["parse_report"], "types": TR.histogram(records, "type"), "versions": TR.histogram(records, "version", None), "entrypoints": TR.histogram(records, "entrypoint", None),
            "fields": fields, "missing": TR.missing_critical(fields), "messages": TR.message_probe(records.filter("type = 'assistant'").select("message")),
            "prompt_lengths": TR.length_summary(records.filter("is_human"), F.length("user_text").cast("bigint"))}
