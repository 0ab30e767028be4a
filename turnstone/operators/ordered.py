"""Ordered scans as parallel prefix scans.

A plain window sends every row of a key to one task; when a single key holds a large share of all rows that task never ends. Large keys
are therefore cut into ranges of their order (``bucket``). Each range is scanned by its own task, one small summary row per key and range
goes through a scan over the ranges, and the carried state is joined back on ``(key, range)``. A large key's ranges, not its rows, meet in
one task. Keys of at most ``WHOLE`` rows are plain windows: one shuffle, where ranges of a row or two would cost four. The large keys are
counted inside the plan, at most one in ``WHOLE`` rows, and broadcast; when there is none, adaptive execution drops their branch.

The ranges come from the values themselves, so that both branches of the plan cut alike; ranges from a sample, as
``repartitionByRange`` takes them, could differ between the branches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


WHOLE = 100_000           # rows of a key (of equal first column) that one task may scan


@dataclass(frozen=True)
class Scan:
    kind: str                 # number | sum | lag | lead | last | max
    expr: Column | None = None
    n: int = 1


def number() -> Scan:
    """1-based position."""
    return Scan("number")


def running_sum(expr: Column) -> Scan:
    return Scan("sum", expr)


def lag(expr: Column) -> Scan:
    return Scan("lag", expr)


def lead(expr: Column, n: int = 1) -> Scan:
    return Scan("lead", expr, n)


def last_known(expr: Column) -> Scan:
    """Latest non-null value up to and including the row."""
    return Scan("last", expr)


def running_max(expr: Column) -> Scan:
    return Scan("max", expr)


def hours(at: Column | str) -> Column:
    """A range per hour, for scans in order of time."""
    return F.floor(F.unix_micros(at) / 3_600_000_000)


def runs(number_: Column | str, size: int = 100_000) -> Column:
    """A range per run of ``size`` numbers, for scans in order of a number."""
    return F.floor((F.col(number_) if isinstance(number_, str) else number_) / size)


def ordered_scan(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, Scan], bucket: Column) -> DataFrame:
    """Add one column per scan to ``df``.

    ``order`` lists ascending columns that are unique within a key; ``bucket`` never decreases along that order. ``df`` is read twice,
    for the count of its first key column and for the rows, and twice more where keys are large; write it first where it is dear to compute.
    """
    # expressions are evaluated once, before the columns of the scan exist; a struct key compares NULLs as equal
    given = df.withColumns({f"_x_{n}": s.expr for n, s in columns.items() if s.expr is not None} | {"_key": F.struct(F.col(keys[0]).alias("k0"))})
    large = F.broadcast(given.groupBy("_key").agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > WHOLE).select("_key"))
    few, many = given.join(large, "_key", "left_anti"), given.join(large, "_key", "left_semi")
    plain = few.withColumns(_local(columns, order, keys)).withColumns({n: F.col("_rn" if s.kind == "number" else f"_l_{n}") for n, s in columns.items()})
    return plain.select(*df.columns, *columns).unionByName(_divided(many, keys, order, columns, bucket).select(*df.columns, *columns))


def _divided(given: DataFrame, keys: list[str], order: list[str], columns: dict[str, Scan], bucket: Column) -> DataFrame:
    """The scans of keys that are cut into ranges."""
    given = given.withColumn("_range", F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], bucket.alias("b")))
    local = given.withColumns(_local(columns, order, ["_range"]))
    far = any(s.kind == "lead" and s.n > 1 for s in columns.values())         # the first n rows of a range are told by their position
    state = _carried(local if far else given, len(keys), order, columns)
    return local.join(state, "_range").withColumns({n: _combined(n, s) for n, s in columns.items()})


def _local(columns: dict[str, Scan], order: list[str], by: list[str]) -> dict[str, Column]:
    """The scans inside one range or one whole key."""
    w = Window.partitionBy(*by).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    made = {"_rn": F.row_number().over(w).cast("bigint")}
    for name, s in columns.items():
        x = F.col(f"_x_{name}")
        if s.kind in ("sum", "max"):
            made[f"_l_{name}"] = (F.sum if s.kind == "sum" else F.max)(x).over(upto)
        elif s.kind == "last":
            made[f"_l_{name}"] = F.last(x, ignorenulls=True).over(upto)
        elif s.kind == "lag":
            made[f"_l_{name}"] = F.lag(x).over(w)
        elif s.kind == "lead":
            made[f"_l_{name}"] = F.lead(x, s.n).over(w)
    return made


def _carried(given: DataFrame, n_keys: int, order: list[str], columns: dict[str, Scan]) -> DataFrame:
    """``_range`` and, for each scan, what the other ranges of the key hand to this one."""
    rank, summary, carry = F.struct(*order), [F.count(F.lit(1)).alias("_n")], {"_n": F.col("_n")}
    along = Window.partitionBy(*[f"_range.k{i}" for i in range(n_keys)]).orderBy("_range.b")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    for name, s in columns.items():
        x, made = F.col(f"_x_{name}"), f"_s_{name}"
        if s.kind == "number":
            carry[f"_c_{name}"] = F.sum("_n").over(before)
        elif s.kind in ("sum", "max"):
            agg = F.sum if s.kind == "sum" else F.max
            summary.append(agg(x).alias(made))
            carry[f"_c_{name}"] = agg(made).over(before)
        elif s.kind == "lag":
            summary.append(F.max_by(F.struct(x.alias("v")), rank).alias(made))
            carry[f"_c_{name}"] = F.lag(made).over(along)
        elif s.kind == "lead":
            head = F.struct(F.col("_rn").alias("i"), x.alias("v"))
            summary.append((F.min_by(F.array(F.struct(x.alias("v"))), rank) if s.n == 1 else F.array_sort(F.collect_list(F.when(F.col("_rn") <= s.n, head)))).alias(made))      # at most n items
            carry[f"_c_{name}"] = F.flatten(F.collect_list(made).over(along.rowsBetween(1, s.n)))
        elif s.kind == "last":
            summary.append(F.max_by(x, F.when(x.isNotNull(), rank)).alias(made))
            carry[f"_c_{name}"] = F.last(made, ignorenulls=True).over(before)
    return given.groupBy("_range").agg(*summary).withColumns(carry).select("_range", *carry)


def _combined(name: str, s: Scan) -> Column:
    mine, c = F.col("_rn") if s.kind == "number" else F.col(f"_l_{name}"), F.col(f"_c_{name}")
    if s.kind == "number":
        return mine + F.coalesce(c, F.lit(0))
    if s.kind == "sum":
        return F.when(mine.isNull(), c).when(c.isNull(), mine).otherwise(mine + c)
    if s.kind == "max":
        return F.greatest(mine, c)
    if s.kind == "last":
        return F.coalesce(mine, c)
    if s.kind == "lag":
        return F.when(F.col("_rn") == 1, c["v"]).otherwise(mine)
    over = (F.col("_rn") + s.n - F.col("_n")).cast("int")
    return F.when(over > 0, F.get(c, over - 1)["v"]).otherwise(mine)
