"""Rendezvous hashing of record keys over weighted shards (columns and SQL functions only).

Each shard draws a number u in (0, 1) from md5 of seed, key and shard; the shard with the largest ``-weight / ln(u)`` wins (ties:
smaller shard). A new shard takes rows only into itself, and a shard's share follows its weight. Slots number the rows of a shard
without gaps; they are counted in blocks of about 65,536 rows, so that no task sees a whole shard.

Null keys hash as the word ``null`` and lie together in one shard. Null texts have size 1 and the checksum of the empty text.
Repeated rows get the same shard and slots of their own. Long texts are measured whole. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.llm.base import blocks_for, numbered, text_or_empty, uniform_bits

SEED = 7


def rendezvous(key: Column, weights: list[float], seed: int = SEED) -> Column:
    """Index of the winning shard; shards of weight 0 or less take nothing."""
    live = [(i, w) for i, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("no shard has a positive weight")

    def strength(shard: int, weight: float) -> Column:
        u = (uniform_bits(F.lit(seed), key, F.lit(shard)) + F.lit(0.5)) / F.lit(float(1 << 52))
        return F.lit(float(-weight)) / F.ln(u)

    return -F.greatest(*[F.struct(strength(i, w).alias("strength"), F.lit(-i).alias("shard")) for i, w in live])["shard"] if len(live) > 1 else F.lit(live[0][0])


def shard_rows(docs: DataFrame, weights: list[float], grown_weights: list[float], seed: int = SEED) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``: shard under ``weights``, grown shard under ``grown_weights``."""
    raw = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("octets"), F.crc32(text_or_empty()).alias("text_crc32"))
    rows = raw.select("doc_id", (F.col("octets") + 1).alias("size"), "text_crc32", F.lit("key").alias("law"),
                      rendezvous(F.col("doc_id"), weights, seed).cast("int").alias("shard"),
                      rendezvous(F.col("doc_id"), grown_weights, seed).cast("int").alias("grown_shard"))
    n = blocks_for(docs.count())
    block = F.pmod(uniform_bits(F.lit("block"), F.col("doc_id"), F.col("text_crc32")), F.lit(n))
    out = numbered(rows, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot", block)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
