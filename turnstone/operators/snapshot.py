"""Snapshots that keep the previous version only when the content changed, and their history."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstone.operators.cases import combine_words, row_words, word_fingerprint


def partition_fingerprints(df: DataFrame, key: str, row: Column) -> DataFrame:
    """One fingerprint per partition key from exact sums of row hashes: rows never gather, order does not matter."""
    return df.select(F.col(key), row_words(row)).groupBy(key).agg(*combine_words()).select(key, word_fingerprint(64).alias("fingerprint"))


def write_outcomes(previous: DataFrame, current: DataFrame, key: str, row: Column) -> DataFrame:
    """S13 — per key: created, unchanged, archived (the previous version must be kept) or, when only the old one exists, absent."""
    old = partition_fingerprints(previous, key, row).withColumnRenamed("fingerprint", "_old")
    new = partition_fingerprints(current, key, row).withColumnRenamed("fingerprint", "_new")
    return compare_fingerprints(old, new, key)


def compare_fingerprints(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    outcome = (F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "absent")
               .when(F.col("_old") == F.col("_new"), "unchanged").otherwise("archived"))
    return old.join(new, key, "full").select(key, outcome.alias("outcome"))


# A version table: ``data`` holds the rows of the keys that a write created or changed, ``keys`` their fingerprints, ``outcome`` what the
# write found, each in one folder per write; ``manifest`` lists the writes that are complete. Folders that it does not list don't count.
_MANIFEST = "stamp string, place bigint"


def _or_none(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":          # any other failure must not pass for "nothing written yet"
            raise
        return spark.createDataFrame([], schema)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``stamp, place``: the complete writes in their order, one row each."""
    return _or_none(spark, f"{path}/manifest", _MANIFEST)


def _versions(spark: SparkSession, path: str, part: str, schema) -> DataFrame:
    """Rows of the complete writes with their ``stamp`` and ``place``."""
    kind = T.StructType([*schema.fields, T.StructField("stamp", T.StringType())])
    return _or_none(spark, f"{path}/{part}", kind).join(F.broadcast(manifest(spark, path)), "stamp")          # one row per write


def _key_schema(schema, key: str):
    return T.StructType([T.StructField(key, schema[key].dataType), T.StructField("fingerprint", T.StringType())])


def write_snapshot(current: DataFrame, path: str, key: str, stamp: str) -> DataFrame:
    """S13 — add a version of the keys that changed; returns the outcome per key.

    Only fingerprints are compared with the versions before; rows of unchanged keys are neither read nor written. The folders of a write are
    replaced when it runs again, and one row in the manifest makes it count, so a write that was cut off leaves nothing behind and a
    repeated one with the same stamp changes nothing and returns the same outcome. Folders grow with the writes, not with the keys.
    """
    spark, schema = current.sparkSession, current.schema
    result = T.StructType([T.StructField(key, schema[key].dataType), T.StructField("outcome", T.StringType())])
    done = {r["stamp"]: r["place"] for r in manifest(spark, path).collect()}          # one short row per write
    if stamp not in done:
        row = F.to_json(F.struct(*[c for c in current.columns if c != key]))
        old = latest_keys(spark, path, key, schema).select(key, F.col("fingerprint").alias("_old"))
        new = partition_fingerprints(current, key, row)
        new.write.mode("overwrite").parquet(f"{path}/pending/stamp={stamp}")
        new = spark.read.schema(_key_schema(schema, key)).parquet(f"{path}/pending/stamp={stamp}")
        outcome = compare_fingerprints(old, new.withColumnRenamed("fingerprint", "_new"), key)
        outcome.write.mode("overwrite").parquet(f"{path}/outcome/stamp={stamp}")
        fresh = spark.read.schema(result).parquet(f"{path}/outcome/stamp={stamp}").filter("outcome IN ('archived', 'created')").select(key)
        new.join(fresh, key, "left_semi").write.mode("overwrite").parquet(f"{path}/keys/stamp={stamp}")
        current.join(fresh, key, "left_semi").repartition(key).write.mode("overwrite").parquet(f"{path}/data/stamp={stamp}")
        spark.createDataFrame([(stamp, len(done))], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return spark.read.schema(result).parquet(f"{path}/outcome/stamp={stamp}")


def latest_keys(spark: SparkSession, path: str, key: str, schema) -> DataFrame:
    """``key, fingerprint, stamp`` of the current version of every key."""
    known = _versions(spark, path, "keys", _key_schema(schema, key))
    return known.groupBy(key).agg(F.max_by(F.struct("fingerprint", "stamp"), "place").alias("_v")).select(key, "_v.fingerprint", "_v.stamp")


def read_versions(spark: SparkSession, path: str, key: str, schema) -> DataFrame:
    """S13 — all rows ever written with their ``stamp`` and ``is_current``; the others are the archive."""
    now = latest_keys(spark, path, key, schema).select(F.col(key).alias("_k"), F.col("stamp").alias("_s"))
    rows = _versions(spark, path, "data", schema).drop("place")
    j = rows.join(now, (F.col(key) == F.col("_k")) & (F.col("stamp") == F.col("_s")), "left")
    return j.select(*[f.name for f in schema.fields], "stamp", F.col("_s").isNotNull().alias("is_current"))


def version_history(names: DataFrame, week: str) -> DataFrame:
    """S14 — archived files of a week, newest first: by the stamp in the name, then by its rank; odd names come last."""
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    rest = F.substring(stem, F.lit(len(week) + 2), F.length(stem))
    stamp = F.try_to_timestamp(F.regexp_extract(rest, r"^(\d{8}-\d{4})(-|$)", 1), F.lit("yyyyMMdd-HHmm"))
    rank = F.coalesce(F.regexp_extract(rest, r"^\d{8}-\d{4}-(\d+)", 1).try_cast("int"), F.lit(1))
    return (names.filter(F.col("name").startswith(week + "-")).withColumns({"stamp": stamp, "rank": rank})
            .orderBy(F.desc_nulls_last("stamp"), F.desc("rank")))
