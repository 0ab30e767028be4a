"""Retrospective: weekly trails, verdicts, milestones, months, silences.

Everything here works on weekly rows: one per key and calendar week, so a window over a key is short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions import exprs as X
from turnstone.functions import fixed_values as V

SPEC = ["target", "higher", "ratio"]


def trail_points(values: DataFrame, keys: list[str], specs: list[str] | None = None) -> DataFrame:
    """A15 — weekly mean per key and whether it meets the target; ``values`` has keys, week, monday, value and the spec columns."""
    specs = specs or SPEC
    return (values.groupBy(*keys, "week", "monday", *specs).agg(F.avg("value").alias("value"), F.count("value").alias("n"))
            .filter("n > 0").withColumn("meets", X.signal_meets("value", "target", "higher", "ratio")))


def trails(points: DataFrame, keys: list[str], carry: list[str] | None = None) -> DataFrame:
    """W13, W14, R02 — per key: first and last third, signed change, streak on target, crossing week and verdict."""
    carry = carry or SPEC
    w = Window.partitionBy(*keys).orderBy("monday")
    n_all = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    p = points.withColumns({"_i": F.row_number().over(w), "_n": n_all})
    third = F.greatest(F.lit(1), F.floor(F.col("_n") / 3))
    p = p.withColumns({"_early": F.col("_i") <= third, "_late": F.col("_i") > F.col("_n") - third})
    miss = F.max(F.when(~F.col("meets"), F.col("_i")))
    g = p.groupBy(*keys, *carry).agg(
        F.max("_n").alias("points"), F.avg(F.when(F.col("_early"), F.col("value"))).alias("early"),
        F.avg(F.when(F.col("_late"), F.col("value"))).alias("late"), F.coalesce(miss, F.lit(0)).alias("_miss"),
        F.collect_list(F.struct("_i", "week", "monday")).alias("_weeks"))      # at most one item per calendar week
    change = F.when(F.col("higher"), F.col("late") - F.col("early")).otherwise(F.col("early") - F.col("late"))
    g = g.withColumns({"delta": change / X.signal_scale("target", "ratio"), "streak": F.col("points") - F.col("_miss")})
    first = F.get(F.filter("_weeks", lambda s: s["_i"] == F.col("_miss") + 1), F.lit(0))
    crossed = (F.col("streak") > 0) & (F.col("_miss") > 0)
    verdict = (F.when(F.col("points") < V.MIN_POINTS, "TropPeuDeDonnees").when(F.col("streak") >= V.STREAK_WEEKS, "Acquis")
               .when(F.col("delta") >= V.MOVEMENT_FLOOR, "EnProgres").when(F.col("delta") <= -V.MOVEMENT_FLOOR, "EnRecul")
               .otherwise("Stable"))
    return (g.withColumns({"crossed_week": F.when(crossed, first["week"]), "crossed_on": F.when(crossed, first["monday"]),
                           "verdict": verdict}).drop("_miss", "_weeks"))


def statement() -> Column:
    """R02 — one sentence per verdict (own wording)."""
    n, s = F.col("points").cast("string"), F.col("streak").cast("string")
    meets = X.signal_meets("late", "target", "higher", "ratio")

    def say(*p) -> Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])

    return (F.when(F.col("verdict") == "TropPeuDeDonnees", say("only ", n, " measured week(s), no conclusion"))
            .when((F.col("verdict") == "Acquis") & (F.col("streak") == F.col("points")), F.lit("on target since the start"))
            .when(F.col("verdict") == "Acquis", say("on target for ", s, " weeks in a row"))
            .when(F.col("verdict") == "EnProgres", F.lit("improving"))
            .when(F.col("verdict") == "EnRecul", F.lit("was better before"))
            .when(meets, F.lit("stable above the target")).otherwise(say("unchanged over ", n, " weeks")))


def verdict_rank() -> Column:
    return (F.when(F.col("verdict") == "Acquis", 0).when(F.col("verdict") == "EnRecul", 1).when(F.col("verdict") == "EnProgres", 2)
            .when(F.col("verdict") == "Stable", 3).otherwise(4))


def ordered_trails(trails_: DataFrame, tie: list[str]) -> DataFrame:
    """K07 — most telling first: verdict rank, then the size of the change."""
    return trails_.orderBy(verdict_rank(), F.desc(F.abs("delta")), *tie)


def milestones(trails_: DataFrame, keys: list[str]) -> DataFrame:
    """R03 — the dated crossings, in order."""
    return trails_.filter("crossed_on IS NOT NULL").select(*keys, "crossed_week", "crossed_on").orderBy("crossed_on", *keys)


def silences(active: DataFrame, keys: list[str] | None = None, limit: int = 3) -> DataFrame:
    """W15 — the longest gaps of two weeks or more between active Mondays (per key)."""
    keys = keys or []
    days = active.select(*keys, "monday").distinct()
    prev = F.lag("monday").over(Window.partitionBy(*keys).orderBy("monday"))
    gaps = (days.withColumn("_prev", prev).withColumn("weeks", (F.datediff("monday", "_prev") / 7).cast("int") - 1)
            .filter("weeks >= 2"))
    w = Window.partitionBy(*keys).orderBy(F.desc("weeks"), "monday")
    return (gaps.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit)
            .select(*keys, F.date_add("_prev", 7).alias("from_day"), F.date_add("monday", -1).alias("to_day"), "weeks"))


def header(weeks: DataFrame, sessions: DataFrame) -> DataFrame:
    """A16 — period, weeks covered and active, volumes; ``sessions`` has one row per (week, session_id) seen."""
    first, last = F.min("monday"), F.date_add(F.max("monday"), 6)
    totals = weeks.agg(first.alias("from_day"), last.alias("to_day"), F.count(F.lit(1)).alias("weeks_active"),
                       F.sum("tasks").alias("tasks"), F.sum("active_us").alias("active_us"), F.sum("read_tokens").alias("read_tokens"))
    distinct = sessions.join(weeks.select("week"), "week", "left_semi").agg(F.count_distinct("session_id").alias("sessions"))
    covered = F.round((F.datediff("to_day", "from_day") + 1) / 7).cast("int")
    return totals.crossJoin(distinct).withColumn("weeks_covered", covered).withColumn(      # two one-row tables
        "weeks_silent", F.col("weeks_covered") - F.col("weeks_active"))


def month_of(monday) -> Column:
    return F.date_format(X._c(monday), "yyyy-MM")


def month_bands(weeks: DataFrame, sessions: DataFrame) -> DataFrame:
    """A17 — per month: active and silent weeks, volumes, model mix; a week belongs to the month of its Monday."""
    m = month_of("monday")
    read = F.sum("read_tokens")

    def share(c: str) -> Column:
        return F.coalesce(F.try_divide(F.sum(c).cast("double"), read.cast("double")), F.lit(0.0)).alias(c.replace("_tokens", "_share"))

    bands = weeks.groupBy(m.alias("month")).agg(
        F.count(F.lit(1)).alias("active_weeks"), F.max(F.ceil(F.dayofmonth(F.last_day("monday")) / 7)).cast("int").alias("_in_month"),
        F.sum("tasks").alias("tasks"), read.alias("read_tokens"), *[share(c) for c in ("haiku_tokens", "sonnet_tokens", "opus_tokens")])
    distinct = sessions.groupBy(month_of("monday").alias("month")).agg(F.count_distinct("session_id").alias("sessions"))
    return (bands.join(distinct, "month", "left")
            .withColumn("silent_weeks", F.greatest(F.lit(0), F.col("_in_month") - F.col("active_weeks"))).drop("_in_month"))


def level_scores(points: DataFrame, key: str = "signal") -> DataFrame:
    """A17 — per month and level: mean over its signals of ``clamp(1 - gap, 0, 1)`` of the monthly mean."""
    per_signal = points.groupBy(month_of("monday").alias("month"), "spec_level", key, *SPEC).agg(F.avg("value").alias("_mean"))
    credit = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - X.signal_gap("_mean", "target", "higher", "ratio")))
    return per_signal.withColumn("_credit", credit).groupBy("month", "spec_level").agg(F.avg("_credit").alias("score"))


def latest_level_scores(scores: DataFrame) -> DataFrame:
    """A18 — the score of each level in the last month that has one."""
    return scores.groupBy("spec_level").agg(F.max("month").alias("month"), F.max_by("score", "month").alias("score"))


def retrospective(values: DataFrame, weeks: DataFrame, sessions: DataFrame, keys: list[str], since: str | None = None,
                  until: str | None = None) -> dict[str, DataFrame]:
    """R06 — all parts over a period: signals are cut by day, volumes count whole weeks."""
    kept = values
    if since:
        kept = kept.filter(F.col("day") >= F.lit(since).cast("date"))
    if until:
        kept = kept.filter(F.col("day") <= F.lit(until).cast("date"))
    points = trail_points(kept, keys, SPEC + (["spec_level"] if "spec_level" in values.columns else []))
    used = points.select("week").distinct()
    in_weeks = weeks.join(used, "week", "left_semi")
    carry = SPEC + (["spec_level"] if "spec_level" in values.columns else [])
    t = trails(points, keys, carry)
    return {"points": points, "trails": ordered_trails(t.withColumn("statement", statement()), keys), "milestones": milestones(t, keys),
            "header": header(in_weeks, sessions), "months": month_bands(in_weeks, sessions.join(used, "week", "left_semi")),
            "silences": silences(points.select("monday"))}
