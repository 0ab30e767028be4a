"""Mixing sources to target weights by systematic sampling (columns and SQL functions only).

A source's documents lie in order of size; each is expected ``target / source size`` times. One random offset per source is added to
the prefix sum of these expectations, and a document is emitted once per integer boundary that its step crosses. In order of size
the words taken stay within about one largest document of the target, for any offset. Documents of one source and one size make a
block, and only a size that more than ``BLOCK`` documents of a source have is cut into several. Blocks are summed up in ranges of
``RANGE`` neighbouring sizes, ranges in their source, so a source with most of the rows needs no task of its own: no task sees more
than about ``BLOCK`` documents, ``RANGE`` + rows / ``BLOCK`` blocks, or longest text / ``RANGE`` ranges.

A document's size is its number of words (null text: 0). Documents of size 0 take their steps like all others and add no words. A
null source is a source of its own, last in order. A source without words has target 0. Repeated rows are separate documents; null
ids are allowed. The words of long texts are counted whole. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnstone.llm.base import blocks_for, n_words, numbered, stored, text_or_empty, uniform_bits

WEIGHTS = (5, 2, 1)
MOST = 3                  # a target stops at this many times its source's size
SEED = 11
BLOCK, RANGE = 65_536, 256
SMALL = 200_000           # hot sizes up to which they are sent to every task
OFFSET_BITS = 20          # few enough for exact sums with steps that are whole numbers


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source its target. ``sizes``: one row per source (``source, source_size, n_docs``); this table is small, so one window may order it.

    Sharing the excess again and again ends at a common level: sources whose cap per weight lies below it get their cap, all others
    weight x level. In order of cap per weight, the level is the first (rest of the words) / (rest of the weights) that the next
    source's cap does not undercut.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    named = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    named = named.withColumn("cap", F.col("source_size") * most)
    rise = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    below = rise.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    named = (named.withColumn("rest", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(below), F.lit(0)))
             .withColumn("rest_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(below), F.lit(0)))
             .withColumn("level", F.when(F.col("cap") / F.col("weight") >= F.col("rest") / F.col("rest_weight"), F.col("rest") / F.col("rest_weight")))
             .withColumn("n_th", F.row_number().over(rise)))
    first = F.min(F.when(F.col("level").isNotNull(), F.struct("n_th", "level"))).over(whole)
    return named.withColumn("level", first["level"]).select(
        "source", "source_size", "n_docs", F.least(F.col("weight") * F.col("level"), F.col("cap").cast("double")).alias("target"))


def with_pieces(rows: DataFrame, block: int) -> DataFrame:
    """Adds ``pieces``, into how many blocks the row's (source, size) is cut; null where one is enough. There are at most rows / block hot sizes."""
    hot = rows.groupBy(F.col("source").alias("_of"), F.col("size").alias("_size")).agg(F.ceil(F.count("*") / block).alias("pieces")).filter("pieces > 1")
    hot = stored(hot, "mix-hot-sizes")
    if hot.count() <= SMALL:
        hot = F.broadcast(hot)
    return rows.join(hot, F.col("source").eqNullSafe(F.col("_of")) & (F.col("size") == F.col("_size")), "left").drop("_of", "_size")


def mix_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, keep: list[str] | None = None,
             block: int = BLOCK) -> DataFrame:
    """Per document ``doc_id, source, size, source_size, target, copies, taken`` (and the columns in ``keep``); ``copies`` may be 0."""
    keep = keep or []
    rows = stored(docs.select("doc_id", "source", n_words(text_or_empty()).alias("size"), *keep), "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    aims = targets(sizes, weights, most).withColumnsRenamed({"source": "of"})
    n = blocks_for(rows.count(), block)
    parted = rows.withColumn("part", F.pmod(uniform_bits(F.lit(seed), F.col("doc_id")), F.lit(n)))
    cut = F.struct("size", F.floor(F.col("part") * F.coalesce("pieces", F.lit(1)) / n).alias("nth"))         # rises with the part, so order is by part
    placed = numbered(with_pieces(parted, block), ["source"], [F.col("part"), F.col("doc_id")], "place", cut, coarse=F.floor(F.col("size") / RANGE))
    joined = placed.join(aims, F.col("source").eqNullSafe(F.col("of")))
    return joined.withColumn("copies", copies(seed)).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *keep)


def copies(seed: int) -> Column:
    """Integer boundaries between this document's prefix sum and the one before."""
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.pmod(uniform_bits(F.lit("offset"), F.lit(seed), F.col("source")), F.lit(1 << OFFSET_BITS)) / F.lit(float(1 << OFFSET_BITS))
    return F.floor((F.col("place") + 1) * step + offset) - F.floor(F.col("place") * step + offset)
