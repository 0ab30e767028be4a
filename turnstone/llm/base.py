"""Small helpers the operators share: columns of ``documents``, stored tables, table sizes."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.session import shared_dir

SPACES = " \t\n\x0b\x0c\r"                        # [\x20\x09-\x0D]
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once into the shared folder and read back: later steps reread files instead of recomputing."""
    path = f"{shared_dir(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def uniform_bits(*parts: Column, digits: int = 13) -> Column:
    """The first hex digits of md5 over the parts as a long: 52 even bits, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])), 1, digits), 16, 10).cast("long")


def numbered(df: DataFrame, group: list[str], order: list[Column], into: str, block: Column, *, per_group_start: int = 0, coarse: Column | None = None) -> DataFrame:
    """Gapless numbers within ``group``, in order of ``block`` and then ``order``, without a task per group.

    Rows are numbered inside (group, block); a table with one row per block carries the starts. ``block`` has to cut groups into
    pieces of bounded size. Where a group may have very many blocks, ``coarse`` (which must never fall as the block rises) cuts them
    into ranges: starts are summed up inside each range, and one row per range carries them on. Equal rows get different numbers;
    which one gets which is not defined.
    """
    from pyspark.sql import Window as W

    df = df.withColumn("_block", block)
    keys = [f"_g{i}" for i in range(len(group))]
    named = [F.col(c).alias(k) for c, k in zip(group, keys)]

    def before(by: list[str], place: str):
        return W.partitionBy(*by).orderBy(place).rowsBetween(W.unboundedPreceding, -1)

    def carried(counts: DataFrame, by: list[str], place: str) -> DataFrame:
        return counts.withColumn("_start", F.coalesce(F.sum("_n").over(before(by, place)), F.lit(0)))

    if coarse is None:
        starts = carried(df.groupBy(*named, F.col("_block").alias("_b")).agg(F.count("*").alias("_n")), keys, "_b")
    else:
        fine = df.groupBy(*named, coarse.alias("_c"), F.col("_block").alias("_b")).agg(F.count("*").alias("_n"))
        ranges = carried(fine.groupBy(*keys, "_c").agg(F.sum("_n").alias("_n")), keys, "_c")
        ranges = ranges.select(*[F.col(k).alias(f"_r{k}") for k in keys], F.col("_c").alias("_rc"), F.col("_start").alias("_carry"))
        same = [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys] + [F.col("_c") == F.col("_rc")]
        starts = carried(fine, [*keys, "_c"], "_b").join(ranges, same).select(*keys, "_b", "_n", (F.col("_start") + F.col("_carry")).alias("_start"))
    starts = starts.withColumn("_start", F.col("_start") + per_group_start).drop("_n")
    inside = W.partitionBy(*group, "_block").orderBy(*order)
    on = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(group, keys)] + [F.col("_block") == F.col("_b")]
    return (df.withColumn("_place", F.row_number().over(inside)).join(starts, on)
            .withColumn(into, (F.col("_start") + F.col("_place") - 1).cast("long"))
            .drop("_block", "_place", "_start", "_b", *keys))


def release() -> None:
    """Give a Python worker's free memory back to the system: idle workers stay alive beside later stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):          # no such call on this system
        pass


def blocks_for(rows: int, size: int = 65_536) -> int:
    return max(1, math.ceil(rows / size))
