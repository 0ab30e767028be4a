"""Small dimension tables built from fixed values; all have a known, fixed number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.functions import fixed_values as V


def specs(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, *r) for i, r in enumerate(V.SIGNAL_SPECS)]
    return spark.createDataFrame(rows, "spec_order int, signal string, spec_level int, target double, higher boolean, ratio boolean, problem string")


def problems(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, *r) for i, r in enumerate(V.PROBLEMS)]
    return spark.createDataFrame(rows, "problem_order int, problem string, problem_level int, challenge_signal string, "
                                       "challenge_target double, challenge_higher boolean, needs_hooks boolean")


def label_scales(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(V.LABEL_SCALES, "scale string, label string, score double")


def with_spec(signals: DataFrame, spec_table: DataFrame | None = None) -> DataFrame:
    """J05 — signal rows with their spec and problem; the dimension has one row per signal key."""
    s = specs(signals.sparkSession) if spec_table is None else spec_table
    return signals.join(s, "signal", "left")
