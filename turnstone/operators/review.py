"""Weekly review: means, observations, win, challenge, costliest prompt, moments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions import exprs as X
from turnstone.functions import fixed_values as V
from turnstone.operators import dims, usage

# the sentences of the coach (own wording; a data file can replace them)
MOMENTS = {
    "rework": "« {tache} » needed {reprises} follow-ups. State in the first message when it is done.",
    "abandon": "« {tache} » stopped without a result. Start again from what blocked it.",
    "tool_failures": "On « {tache} », {preuve}. Look at the tool setup first.",
    "no_verification": "« {tache} » ended without a test. Finish with the command that proves it.",
}


def with_week(signals: DataFrame) -> DataFrame:
    return signals.withColumns({"week": X.week_key("started_at"), "monday": X.monday_of("started_at")})


def means(signals: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A14 — mean and count per signal over the tasks where it is determined."""
    return (signals.groupBy(*(keys or []), "signal").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
            .filter("n > 0"))


def observations(means_: DataFrame, limit: int = V.MAX_OBSERVATIONS, keys: list[str] | None = None, specs: DataFrame | None = None) -> DataFrame:
    """K01 — the largest gaps, at most one per problem; ties by spec order. Works on one row per signal."""
    keys = keys or []
    s = dims.with_spec(means_, specs).withColumn("gap", X.signal_gap("mean", "target", "higher", "ratio")).filter("gap > 0")
    problem = F.coalesce("problem", F.concat(F.lit("palier:"), F.col("spec_level").cast("string")))
    best = Window.partitionBy(*keys, "_problem").orderBy(F.desc("gap"), "spec_order")
    top = Window.partitionBy(*keys).orderBy(F.desc("gap"), "spec_order")
    return (s.withColumn("_problem", problem).withColumn("_r", F.row_number().over(best)).filter("_r = 1")
            .withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= limit).drop("_r", "_problem"))


def worst_examples(observed: DataFrame, signals: DataFrame, keys: list[str] | None = None, specs: DataFrame | None = None) -> DataFrame:
    """K02 — for each observed signal the task with the largest gap, first one on ties.

    An aggregate (``min_by``) instead of a ranking, so a signal with very many tasks stays a partial aggregation.
    """
    keys = keys or []
    s = dims.with_spec(signals.filter("value IS NOT NULL"), specs).withColumn("_gap", X.signal_gap("value", "target", "higher", "ratio"))
    worst = s.groupBy(*keys, "signal").agg(F.min_by(
        F.struct("task_id", "title", "started_at", "evidence", F.col("value").alias("task_value")),
        F.struct((-F.col("_gap")).alias("g"), "started_at", "session_id", "task_no")).alias("example"))
    return observed.join(worst, [*keys, "signal"])


def win(current: DataFrame, previous: DataFrame, floor: float = V.PROGRESS_FLOOR, keys: list[str] | None = None, specs: DataFrame | None = None) -> DataFrame:
    """K03 — the best improvement that passes the floor and meets the target; first of equal ones by spec order."""
    keys = keys or []
    j = dims.with_spec(current.select(*keys, "signal", F.col("mean").alias("after"))
                       .join(previous.select(*keys, "signal", F.col("mean").alias("before")), [*keys, "signal"]), specs)
    moved = F.when(F.col("higher"), F.col("after") - F.col("before")).otherwise(F.col("before") - F.col("after"))
    j = (j.filter("target IS NOT NULL").withColumn("delta", moved / X.signal_scale("target", "ratio"))
         .filter((F.col("delta") >= floor) & X.signal_meets("after", "target", "higher", "ratio")))
    w = Window.partitionBy(*keys).orderBy(F.desc("delta"), "spec_order")
    return j.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*keys, "signal", "spec_level", "before", "after", "delta")


def challenge(means_: DataFrame, hooks: bool = False, keys: list[str] | None = None) -> DataFrame:
    """K04 — the lowest-level problem whose own target is missed; problems that need hooks only when there are some."""
    keys = keys or []
    p = dims.problems(means_.sparkSession)
    j = means_.join(F.broadcast(p), F.col("signal") == F.col("challenge_signal"))
    missed = F.when(F.col("challenge_higher"), F.col("mean") < F.col("challenge_target")).otherwise(F.col("mean") > F.col("challenge_target"))
    w = Window.partitionBy(*keys).orderBy("problem_level", "problem_order")
    return (j.filter(missed & (F.lit(hooks) | ~F.col("needs_hooks"))).withColumn("_r", F.row_number().over(w)).filter("_r = 1")
            .select(*keys, "problem", "problem_level", "signal", "mean", "challenge_target"))


def prompt_costs(wide: DataFrame, calls: DataFrame, task_turns: DataFrame, rubric=None) -> DataFrame:
    """K05 — what each first prompt cost: follow-ups, abandonment, failed tools, then what its text lacks."""
    key = ["session_id", "task_no"]
    failed = (calls.filter("failed").join(task_turns.select("session_id", "turn_no", "task_no"), ["session_id", "turn_no"])
              .groupBy(*key).agg(F.count_distinct("name").alias("failed_tools")))
    j = wide.join(failed, key, "left").fillna(0, ["failed_tools"])
    observed = (F.col("rework_turns") * 3.0 + F.when(F.col("completed") | F.col("in_progress"), 0.0).otherwise(4.0)
                + F.col("failed_tools") * 0.5)
    return (j.filter(F.length("first_prompt") >= V.MIN_PROMPT_CHARS).withColumn("observed", observed).filter("observed > 0")
            .withColumn("cost", F.col("observed") + (1 - X.rubric_coverage("first_prompt", rubric)) * 2.0))


def costliest_prompt(costs: DataFrame) -> DataFrame:
    """K05 — the single costliest prompt, when it costs at least the minimum."""
    return costs.filter(F.col("cost") >= V.MIN_PROMPT_COST).orderBy(F.desc("cost"), "started_at", "session_id", "task_no").limit(1)


def moments(wide: DataFrame) -> DataFrame:
    """R04 — at most one notable moment per closed task; the first rule that fits decides."""
    c = F.col
    key = (F.when(c("rework_turns") >= V.REWORK_MOMENT, "rework")
           .when(~c("completed") & ~c("in_progress"), "abandon")
           .when((c("tool_failure_rate") > V.FAILURE_MOMENT) & (c("all_calls") >= V.FAILURE_MIN_CALLS), "tool_failures")
           .when((c("verification_present") == 0) & (c("loop_closure") == 0) & (c("all_calls") >= V.UNVERIFIED_MIN_CALLS), "no_verification"))
    texts = F.create_map(*[F.lit(x) for kv in MOMENTS.items() for x in kv])
    proof = F.concat(c("failed_calls").cast("string"), F.lit(" failure(s) in "), c("calls").cast("string"), F.lit(" call(s)"))
    return (wide.filter(~c("in_progress")).withColumn("moment", key).filter("moment IS NOT NULL")
            .withColumn("text", X.fill_template(F.try_element_at(texts, c("moment")), tache=X.short("title", 48),
                                                reprises="rework_turns", preuve=proof)))


def weekly_review(signals: DataFrame, wide: DataFrame, weeks: DataFrame, calls: DataFrame, task_turns: DataFrame, as_of: str,
                  week: str | None = None, budget: int = 0, hooks: bool = False, rubric=None, specs: DataFrame | None = None) -> dict[str, DataFrame]:
    """R05 — the parts of a review as tables; ``week`` defaults to the latest closed week with tasks, ``specs`` to the built-in ones."""
    dated = with_week(signals)
    target = (usage.last_closed_week(dated.select("week", "monday").distinct(), as_of) if week is None
              else signals.sparkSession.range(1).select(F.lit(week).alias("last_week")))
    one = F.broadcast(target)                                                   # one row
    mine = dated.join(one, F.col("week") == F.col("last_week")).drop("last_week")
    before = dated.join(one, F.col("week") < F.col("last_week")).drop("last_week")
    recent = F.broadcast(usage.last_weeks(before.select("week", "monday").distinct(), 3).select("week"))   # three rows
    now, then = means(mine), means(before.join(recent, "week"))
    obs = observations(now, specs=specs)
    dated_wide = wide.withColumn("week", X.week_key("started_at")).join(one, F.col("week") == F.col("last_week")).drop("last_week")
    return {
        "week": target, "means": now, "observations": worst_examples(obs, mine, specs=specs), "win": win(now, then, specs=specs),
        "challenge": challenge(now, hooks), "prompt": costliest_prompt(prompt_costs(dated_wide, calls, task_turns, rubric)),
        "usage": weeks.join(one, F.col("week") == F.col("last_week")).drop("last_week"),
        "alerts": usage.alerts(weeks.join(one, F.col("week") <= F.col("last_week")).drop("last_week"), as_of, budget),
    }


def review_invariants(review: dict[str, DataFrame], images: DataFrame | None = None) -> DataFrame:
    """V16 — checks on the parts of a review: (check, ok, proof). A check that does not apply has a NULL ok."""
    obs, week = review["observations"], F.broadcast(review["week"])
    dated = obs.crossJoin(week).withColumn("_inside", (X.week_key("example.started_at") == F.col("last_week"))
                                           & (F.col("example.title") != "") & (F.col("example.evidence") != ""))
    rows = [
        dated.agg(F.lit("observation_avec_exemple").alias("check"), F.bool_and("_inside").alias("ok"), F.count(F.lit(1)).alias("proof")),
        dims.with_spec(review["win"].select("signal", F.col("after"), "delta")).agg(
            F.lit("pas_de_felicitation_polie").alias("check"),
            F.bool_and((F.col("delta") >= V.PROGRESS_FLOOR) & X.signal_meets("after", "target", "higher", "ratio")).alias("ok"),
            F.count(F.lit(1)).alias("proof")),
        obs.agg(F.lit("trois_observations_au_plus").alias("check"), (F.count(F.lit(1)) <= V.MAX_OBSERVATIONS).alias("ok"),
                F.count(F.lit(1)).alias("proof")),
        obs.agg(F.lit("image_seulement_si_defaut").alias("check"), F.bool_and(F.col("gap") > 0).alias("ok"), F.count(F.lit(1)).alias("proof")),
    ]
    if images is not None:
        message = X.fact_first("fact", "image")
        rows.append(images.filter(~X.is_blank("image")).agg(
            F.lit("fait_avant_image").alias("check"), F.bool_and(message.startswith(F.col("fact"))).alias("ok"), F.count(F.lit(1)).alias("proof")))
    return reduce(DataFrame.unionByName, rows)


def same_measures(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """V16 — two builds carry the same measures: a full outer join that must not leave a lone row."""
    left = a.select(*columns, F.lit(True).alias("_l"))
    right = b.select(*columns, F.lit(True).alias("_r"))
    on = reduce(lambda x, y: x & y, [left[c].eqNullSafe(right[c]) for c in columns])
    return left.join(right, on, "full").agg(F.count_if(F.col("_l").isNull() | F.col("_r").isNull()).alias("lone_rows"),
                                           F.count(F.lit(1)).alias("rows"))


def complete_levels(levels: DataFrame, count: int = 5) -> DataFrame:
    """V16 — the neutral vocabulary names every level."""
    return levels.agg(F.count_if(~X.is_blank("term")).alias("named")).withColumn("complete", F.col("named") >= count)
