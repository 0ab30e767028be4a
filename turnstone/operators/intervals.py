"""Interval and as-of joins without a cross product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.operators import ordered as O


LEVELS = 62               # powers of two that a count of units can hold
UNIT = 60                 # seconds; the units at the borders of an interval are compared by time, those inside by node
EDGE = -1                 # level of a border unit
FEW = 64                  # intervals of a key that each of its points is compared with


def _shifted(units: Column, level: Column) -> Column:
    return F.call_function("shiftright", units.cast("bigint"), level)


def cover(start: str, end: str, unit: int = UNIT) -> Column:
    """The dyadic nodes ``(level, node)`` of the units that lie wholly between start and end, at most two a level and disjoint, and its border units.

    At level k the nodes left to cover run from the first multiple of 2**k to the last one; an odd border is a node of its own.
    """
    size = unit * 1_000_000
    us, ue = F.unix_micros(start), F.unix_micros(end)
    low, high = F.ceil(us / size).cast("bigint"), F.floor((ue + 1) / size).cast("bigint")
    levels = F.sequence(F.lit(0), F.least(F.lit(LEVELS), F.floor(F.log2(F.greatest(high - low, F.lit(1)).cast("double"))).cast("int") + 1))

    def at(k: Column) -> Column:
        lo, hi = -_shifted(-low, k), _shifted(high, k)                     # rounded up and down
        node = lambda n: F.struct(k.alias("level"), n.cast("bigint").alias("node"))
        return F.array(F.when((lo < hi) & (lo % 2 != 0), node(lo)), F.when((lo < hi) & (hi % 2 != 0), node(hi - 1)))

    first, last = F.floor(us / size).cast("bigint"), F.floor(ue / size).cast("bigint")
    edge = lambda n, here: F.when(here, F.struct(F.lit(EDGE).alias("level"), n.alias("node")))
    outside = lambda n: (n < low) | (n >= high)
    borders = F.array(edge(first, outside(first)), edge(last, outside(last) & (last != first)))
    return F.filter(F.concat(F.flatten(F.transform(levels, at)), borders), lambda n: n.isNotNull())


def _ancestors(points: DataFrame, nodes: DataFrame, at: str, unit: int) -> DataFrame:
    """Each point once per level that the intervals use, under its node there."""
    used = nodes.agg(F.collect_set("level").alias("_levels"))                       # one row of at most LEVELS numbers
    spread = points.crossJoin(F.broadcast(used)).withColumn("level", F.explode("_levels")).drop("_levels")
    return spread.withColumn("node", _shifted(F.floor(F.unix_micros(at) / (unit * 1_000_000)), F.greatest("level", F.lit(0))))


def _nodes(intervals: DataFrame, start: str, end: str, unit: int) -> DataFrame:
    whole = intervals.filter(F.col(start) <= F.col(end))
    return whole.withColumn("_n", F.explode(cover(start, end, unit))).withColumns({"level": F.col("_n.level"), "node": F.col("_n.node")}).drop("_n")


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, unit: int = UNIT) -> DataFrame:
    """Points joined to the intervals of the same keys that contain them (bounds included).

    Where a key has at most ``FEW`` intervals, its points are compared with all of them: points and intervals are shuffled once by their
    key. Intervals of other keys are cut into dyadic nodes of whole units and two border units, a point looks up its ancestors: an equi
    join on ``(keys, level, node)`` whose output holds the wanted pairs, once each, and those of the border units, which are compared by
    time. ``unit`` (seconds) only trades levels for such comparisons.
    """
    whole = intervals.filter(F.col(start) <= F.col(end))
    many = whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > FEW).select(*keys)
    near = points.join(many, keys, "left_anti").join(whole.join(many, keys, "left_anti"), keys).filter(F.col(at).between(F.col(start), F.col(end)))
    nodes = _nodes(whole.join(many, keys, "left_semi"), start, end, unit)
    met = _ancestors(points.join(many, keys, "left_semi"), nodes, at, unit).join(nodes, [*keys, "level", "node"])
    return near.unionByName(met.filter((F.col("level") != EDGE) | F.col(at).between(F.col(start), F.col(end))).drop("level", "node"))


def latest_interval(points: DataFrame, intervals: DataFrame, keys: list[str], point: list[str], at: str, start: str, end: str, listed: str,
                    take: str, unit: int = UNIT) -> DataFrame:
    """Per point in an interval: ``found``, the value of ``take`` of the one listed last, and ``candidates``, how many hold it.

    Nodes keep the count and the last listed interval, so a point meets at most one row per level whatever the number of intervals, and
    the intervals that begin or end in its own unit.
    """
    nodes = _nodes(intervals.select(*keys, start, end, F.struct(F.col(listed).alias("l"), F.col(take).alias("t")).alias("_last")), start, end, unit)
    kept = nodes.filter(F.col("level") != EDGE).groupBy(*keys, "level", "node").agg(F.count(F.lit(1)).alias("_n"), F.max("_last").alias("_last"))
    looked = _ancestors(points.select(*dict.fromkeys([*keys, *point, at])), nodes, at, unit)
    inside = looked.join(kept, [*keys, "level", "node"]).select(*point, "_n", "_last")
    border = (looked.filter(F.col("level") == EDGE).join(nodes.filter(F.col("level") == EDGE), [*keys, "level", "node"])
              .filter(F.col(at).between(F.col(start), F.col(end))).select(*point, F.lit(1).cast("bigint").alias("_n"), "_last"))
    both = inside.unionByName(border).groupBy(*point).agg(F.max("_last").alias("_last"), F.sum("_n").alias("candidates"))
    return both.select(*point, F.col("_last.t").alias("found"), "candidates")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, tie: str,
          carry: list[str], bucket_seconds: int = 3600) -> DataFrame:
    """Each left row with the columns of the latest right row at or before it (NULL when there is none).

    One union and one ordered scan: linear in the rows, no range join. ``tie`` orders right rows of equal time.
    """
    payload = F.struct(*carry)
    r = right.select(*keys, F.col(right_at).alias("_at"), F.lit(0).alias("_side"),
                     F.col(tie).cast("bigint").alias("_tie"), payload.alias("_right"),
                     F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_left"))
    l = left.select(*keys, F.col(left_at).alias("_at"), F.lit(1).alias("_side"),
                    F.monotonically_increasing_id().alias("_tie"),
                    F.lit(None).cast(right.select(payload).schema[0].dataType).alias("_right"),
                    F.struct(*left.columns).alias("_left"))
    bucket = F.floor(F.unix_micros("_at") / (bucket_seconds * 1_000_000))
    scanned = O.ordered_scan(r.unionByName(l), keys, ["_at", "_side", "_tie"],
                             {"_found": O.last_known(F.col("_right"))}, bucket)
    return scanned.filter("_side = 1").select("_left.*", *[F.col(f"_found.{c}").alias(c) for c in carry])
