"""Usage by week, work kinds, alerts and spend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions import exprs as X
from turnstone.functions import fixed_values as V


def as_of_monday(as_of: str) -> Column:
    return X.monday_of(F.lit(as_of).cast("date"))


def closed_weeks(weeks: DataFrame, as_of: str) -> DataFrame:
    """F09 — weeks that ended before the week of ``as_of``."""
    return weeks.filter(F.col("monday") < as_of_monday(as_of))


def last_closed_week(weeks: DataFrame, as_of: str) -> DataFrame:
    """F09 — one row: the key of the latest closed week (NULL when there is none)."""
    return closed_weeks(weeks, as_of).agg(F.max("week").alias("last_week"))


def all_turns(task_turns: DataFrame, agent_turns: DataFrame) -> DataFrame:
    """E01 — main turns and agent turns of the tasks, in one table."""
    cols = ["session_id", "turn_no", "task_no", "started_at"]
    return (task_turns.select(*cols, F.lit(False).alias("by_agent"))
            .unionByName(agent_turns.select(*cols, F.lit(True).alias("by_agent"))))


def week_usage(tasks: DataFrame, turns: DataFrame, calls: DataFrame, steps: DataFrame, turn_active: DataFrame) -> DataFrame:
    """A07 — per week: tasks (week of the task), turns, calls, active time, days, sessions (week of the turn), tokens.

    Facts are stacked and grouped once, so there is one aggregation instead of a join per measure.
    """
    key = ["session_id", "turn_no"]
    zero = F.lit(0).cast("bigint")
    measures = ["tasks", "turns", "tool_calls", "active_us", "read_tokens", "cache_tokens", "output_tokens",
                "haiku_tokens", "sonnet_tokens", "opus_tokens"]

    def facts(df: DataFrame, at: str, day: Column, **m) -> DataFrame:
        return df.select(X.week_key(at).alias("week"), X.monday_of(at).alias("monday"), "session_id", day.alias("day"),
                         *[m.get(x, zero).cast("bigint").alias(x) for x in measures])

    one = F.lit(1)
    read = X.total_input("input_tokens", "cache_read_tokens", "cache_creation_tokens")
    family = X.model_family("model")
    per_turn = calls.groupBy(*key).agg(F.count(F.lit(1)).alias("n_calls"))
    turn_rows = turns.join(per_turn, key, "left").join(turn_active, key, "left")
    step_rows = steps.join(turns.select(*key, "started_at"), key)
    nothing = F.lit(None).cast("date")
    stacked = (
        facts(tasks, "started_at", nothing, tasks=one)
        .unionByName(facts(turn_rows, "started_at", F.to_date("started_at"), turns=one,
                           tool_calls=F.coalesce("n_calls", zero), active_us=F.coalesce("active_us", zero)))
        .unionByName(facts(step_rows, "started_at", nothing, read_tokens=read, cache_tokens=F.col("cache_read_tokens"),
                           output_tokens=F.col("output_tokens"),
                           **{f"{f.lower()}_tokens": F.when(family == f, read).otherwise(zero) for f in ("Haiku", "Sonnet", "Opus")})))
    return stacked.groupBy("week", "monday").agg(
        *[F.sum(m).alias(m) for m in measures], F.count_distinct("day").alias("active_days"),
        F.count_distinct("session_id").alias("sessions"))


def week_models(steps: DataFrame, turns: DataFrame) -> DataFrame:
    """A08 — per week and model: calls and token sums; the week is that of the turn."""
    rows = steps.join(turns.select("session_id", "turn_no", "started_at"), ["session_id", "turn_no"])
    name = F.coalesce("model", F.lit("inconnu"))
    return rows.groupBy(X.week_key("started_at").alias("week"), name.alias("model")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("cache_read_tokens").alias("cache_read_tokens"), F.sum("cache_creation_tokens").alias("cache_write_tokens"),
        F.sum("output_tokens").alias("output_tokens")).withColumn("family", X.model_family("model"))


def family_shares(models: DataFrame) -> DataFrame:
    """A09 — per week: share of read tokens and share of calls of each model family."""
    read = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens")
    fam = ("Haiku", "Sonnet", "Opus", "Autre")

    def part(x: Column, f: str) -> Column:
        return F.coalesce(F.try_divide(F.sum(F.when(F.col("family") == f, x).otherwise(0)), F.sum(x)), F.lit(0.0))

    return models.groupBy("week").agg(*[part(read, f).alias(f"{f.lower()}_tokens") for f in fam],
                                      *[part(F.col("calls"), f).alias(f"{f.lower()}_calls") for f in fam])


def work_kinds(tasks: DataFrame, owners: DataFrame, calls: DataFrame) -> DataFrame:
    """A10 — kind of work of each task, by priority, over its own calls and those of its agents."""
    n = F.col("name")
    key = ["session_id", "task_no"]
    seen = (calls.join(owners.select("session_id", "turn_no", "task_no"), ["session_id", "turn_no"]).groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(n.isin("Agent", "Task", "Skill")).alias("orchestrates"),
        F.bool_or(n.isin("Edit", "Write", "NotebookEdit", "MultiEdit")).alias("edits"), F.count_if(n == "Bash").alias("shells"),
        F.bool_or(n.isin("WebSearch", "WebFetch")).alias("searches"), F.bool_or(n.isin("Read", "Grep", "Glob")).alias("explores")))
    kind = (F.when(F.col("n").isNull() & (F.col("agent_turns") == 0), "Conversation")
            .when((F.col("agent_turns") > 0) | F.col("orchestrates"), "Orchestration")
            .when(F.col("edits"), "Edition").when(F.col("shells") * 2 >= F.col("n"), "Execution")
            .when(F.col("searches"), "Recherche").when(F.col("explores"), "Exploration").otherwise("Conversation"))
    return tasks.select(*key, "started_at", "agent_turns").join(seen, key, "left").select(*key, "started_at", kind.alias("kind"))


def work_mix(kinds: DataFrame) -> DataFrame:
    """A11 — tasks per week and kind of work."""
    return kinds.groupBy(X.week_key("started_at").alias("week"), "kind").agg(F.count(F.lit(1)).alias("tasks"))


def last_weeks(weeks: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """K06 — the latest n weeks (per key)."""
    w = Window.partitionBy(*(keys or [])).orderBy(F.desc("monday"))
    return weeks.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def alerts(weeks: DataFrame, as_of: str, budget: int = 0, keys: list[str] | None = None) -> DataFrame:
    """R01 — usage alerts on the latest closed week and the one before it (consecutive rows, not calendar weeks).

    Runs over week rows, of which a key has one per calendar week. Several keys are handled in one pass.
    """
    keys = keys or []
    w = Window.partitionBy(*keys).orderBy("monday")
    newest = Window.partitionBy(*keys).orderBy(F.desc("monday"))
    last = (closed_weeks(weeks, as_of)
            .withColumns({"prev_read": F.lag("read_tokens").over(w), "prev_week": F.lag("week").over(w),
                          "_rn": F.row_number().over(newest)}).filter("_rn = 1"))
    c = F.col
    read = c("read_tokens").cast("double")
    use, prev_use = read / F.lit(float(budget or 1)), c("prev_read") / F.lit(float(budget or 1))
    cache = F.try_divide(c("cache_tokens").cast("double"), read)
    opus, haiku = F.try_divide(c("opus_tokens").cast("double"), read), F.try_divide(c("haiku_tokens").cast("double"), read)
    drop = F.try_divide((c("read_tokens") - c("prev_read")).cast("double"), c("prev_read").cast("double"))
    has_budget = F.lit(budget > 0)

    def alert(test: Column, key: str, severity: str, value: Column) -> Column:
        return F.when(test, F.struct(F.lit(key).alias("alert"), F.lit(severity).alias("severity"), value.cast("double").alias("value")))

    found = F.array_compact(F.array(
        alert(has_budget & c("prev_read").isNotNull() & (use < V.UNDER_USE) & (prev_use < V.UNDER_USE), "sous_utilisation", "attention", use),
        alert(has_budget & (use > V.OVER_USE), "plafond_proche", "attention", use),
        alert(c("active_days") <= 1, "adoption_faible", "attention", c("active_days")),
        alert((read > 0) & (cache < V.LOW_CACHE), "cache_faible", "attention", cache),
        alert((opus > V.OPUS_SHARE) & (c("tasks") >= V.MONO_MIN_TASKS), "monoculture_opus", "info", opus),
        alert(~F.coalesce((opus > V.OPUS_SHARE) & (c("tasks") >= V.MONO_MIN_TASKS), F.lit(False)) & (haiku > V.HAIKU_SHARE)
              & (c("tasks") >= V.MONO_MIN_TASKS), "monoculture_haiku", "info", haiku),
        alert((c("prev_read") > 0) & (drop < V.DROP), "decrochage", "attention", drop)))
    return last.select(*keys, "week", F.explode(found).alias("_a")).select(*keys, "week", "_a.*")


# ------------------------------------------------------------------------------------------ spend
def learner_spend(rows: DataFrame, order: list[str]) -> DataFrame:
    """A12 — per person (case ignored): tokens, requests, spend (net, else gross) and tokens per model family.

    ``order`` decides which spelling of the address is shown. Sums are taken per spelling first: with one numeric order
    column that step is a hash aggregation on the map side, and only spellings meet afterwards.
    """
    tokens = F.col("prompt_tokens") + F.col("completion_tokens")
    family = X.model_family("model")
    zero = F.lit(0).cast("bigint")
    first = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    sums = {"prompt_tokens": F.col("prompt_tokens"), "completion_tokens": F.col("completion_tokens"), "requests": F.col("requests"),
            "spend": F.when(F.col("net") != 0, F.col("net")).otherwise(F.col("gross")),
            **{f"{f.lower()}_tokens": F.when(family == f, tokens).otherwise(zero) for f in ("Haiku", "Sonnet", "Opus", "Autre")}}
    spelled = (rows.filter(F.coalesce("email", F.lit("")) != "").groupBy(F.lower("email").alias("person"), "email")
               .agg(F.min(first).alias("_first"), *[F.sum(c).alias(n) for n, c in sums.items()]))
    return (spelled.groupBy("person").agg(F.min_by("email", "_first").alias("email"), *[F.sum(n).alias(n) for n in sums])
            .withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")))


def learner_products(rows: DataFrame) -> DataFrame:
    """A12 — tokens per person and product (case ignored)."""
    product = F.coalesce(F.when(F.col("product") != "", F.col("product")), F.lit("(inconnu)"))
    return rows.filter(F.coalesce("email", F.lit("")) != "").groupBy(F.lower("email").alias("person"), F.lower(product).alias("product")).agg(
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"))


def team_utilisation(learners: DataFrame, weekly_budget: int, weeks_back: int) -> DataFrame:
    """A13 — share of the budget used by each person, with the under-used and idle marks."""
    reference = float(weekly_budget * weeks_back)
    share = F.col("total_tokens") / F.lit(reference) if reference > 0 else F.lit(None).cast("double")
    return learners.withColumns({"utilisation": share,
                                 "under_used": F.coalesce(share < V.UNDER_USE, F.lit(False)),
                                 "idle": F.lit(reference > 0) & (F.col("total_tokens") == 0)})
