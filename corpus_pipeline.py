"""Corpus pipeline: toxicity, exact dedup, MinHash near-dedup, mixing to target weights, best-fit packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's
documents. All but the last keep the columns of the documents they get. Rows are told apart by id and text, so repeated rows share
a decision; after exact dedup none are left. After mixing a document stands in the table as often as the mix takes it.

Every stage reads whole texts of any length and only id, source and text; other columns travel along in one struct, so no name can clash.
Null texts: no stage drops them for being null. They count as empty in toxicity (lowest score), exact dedup (equal to empty texts) and packing (one
end token), have no shingles and hence no near copies, and add no words to the mix. Null ids are kept. An empty table gives no rows at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from turnstone.llm import exact_dedup, minhash, mixing, packing, toxicity
from turnstone.llm.base import stored, table
from turnstone.llm.queries import held_out, tokenizer


NEAR = 80            # per cent of common word shingles from which documents are near copies; op3 has its own


def _whole(docs: DataFrame) -> DataFrame:
    """The row as one column ``row`` beside its id, source and text, so that no column of the input can clash."""
    return docs.select(F.struct("*").alias("row"), "doc_id", "source", "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold go. The model learns from the labels outside the held-out quarter."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    return toxicity.score_rows(_whole(docs), model, ["row"]).filter(F.col("tox_score") < toxicity.THRESHOLD).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal normalised texts stays: the longest, then the smallest id."""
    found = exact_dedup.exact_duplicates(docs)
    kept = found.filter("kept").select(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("digest"))
    kept = kept.select("*", F.xxhash64("id", "digest").alias("key"))
    rows = _whole(docs).withColumn("clean", F.unhex(F.sha2(exact_dedup.normalised(), 256))).withColumn("own_key", F.xxhash64("doc_id", "clean"))
    met = rows.join(kept, (F.col("own_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("clean") == F.col("digest")))
    of_one = Window.partitionBy("own_key", "clean").orderBy(F.char_length(F.coalesce("text", F.lit(""))).desc())      # rows that repeat the id as well
    return met.withColumn("n", F.row_number().over(of_one)).filter("n = 1").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar word shingles the one with the smallest id stays. Rows without id stay."""
    gone = minhash.near_duplicates(docs, NEAR).filter("not kept").select(F.col("doc_id").alias("id"), F.col("text_id").alias("key")).distinct()
    rows = _whole(docs).withColumn("own_key", F.xxhash64("text"))
    return rows.join(gone, (F.col("doc_id") == F.col("id")) & (F.col("own_key") == F.col("key")), "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as systematic sampling to the target weights takes it."""
    taken = mixing.mix_rows(docs.select("doc_id", "source", "text", F.xxhash64("text").alias("text_key")), keep=["text_key"])
    copies = taken.filter("copies > 0").select(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.col("text_key").alias("key"), "copies").dropDuplicates(["id", "of", "key"])
    met = _whole(docs).withColumn("own_key", F.xxhash64("text")).join(
        copies, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("of")) & (F.col("own_key") == F.col("key")))
    return met.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents and their places in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack_documents)]

#: Toxicity scores, similarity components and token ids have no SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
