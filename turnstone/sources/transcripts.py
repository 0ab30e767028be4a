"""Transcript folders to typed records.

Reading never fails on content: a line that is not a JSON object costs that line and is counted. Two readings
differ from a reader that binds names loosely: field names are matched as the log writes them, and a field of
the wrong kind gives NULL instead of costing the line.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.operators import ordered as O

_LINES = "value string, file string, block bigint, pos bigint"
_BLOCK_INPUTS = "message STRUCT<content: ARRAY<STRUCT<input: STRING>>>"


def list_files(spark: SparkSession, root: str, pattern: str = "*.jsonl", modified_after: str | None = None) -> DataFrame:
    """S01 — path, size and time of the files; an absent folder has none. Only metadata is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    try:
        return reader.load(root).select("path", "length", "modificationTime")
    except AnalysisException:
        return spark.createDataFrame([], "path string, length bigint, modificationTime timestamp")


def read_lines(spark: SparkSession, root: str, pattern: str = "*.jsonl", modified_after: str | None = None,
               limit_files: int | None = None) -> DataFrame:
    """S01-S04 — the lines of all files with their place: (file, block, pos) orders the lines of a file.

    ``limit_files`` keeps the first files by path; their short list is what the scan reads.
    """
    if limit_files is not None:
        paths = [r.path for r in list_files(spark, root, pattern, modified_after).select("path").orderBy("path").limit(limit_files).collect()]
        if not paths:
            return spark.createDataFrame([], _LINES)
        lines = spark.read.text(paths)
    else:
        reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        if modified_after:
            reader = reader.option("modifiedAfter", modified_after)
        try:
            lines = reader.text(root)
        except AnalysisException:
            return spark.createDataFrame([], _LINES)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                        F.monotonically_increasing_id().alias("pos"))


def number_lines(lines: DataFrame) -> DataFrame:
    """S02 — line number in the file; a very long file is numbered block by block.

    ``pos`` counts the lines of a split without gaps, so a line's place in its split needs no sort: only one row per split, with its first
    position and its number of lines, is shuffled, summed up and sent to the readers; the text stays where it is read.
    """
    splits = lines.groupBy("file", "block").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    placed = O.ordered_scan(splits, ["file"], ["block"], {"upto": O.running_sum(F.col("n"))}, F.col("block"))
    offsets = placed.select(F.col("file").alias("_file"), F.col("block").alias("_block"), (F.col("upto") - F.col("n") - F.col("first") + 1).alias("_offset"))
    met = lines.join(F.broadcast(offsets), (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    return met.withColumn("line_no", F.col("pos") + F.col("_offset")).drop("block", "pos", "_file", "_block", "_offset")


def scan(lines: DataFrame) -> DataFrame:
    """S02 — every line with its JSON value and whether it is a readable record."""
    parsed = lines.withColumn("raw", F.try_parse_json("value"))
    # valid JSON is an object exactly when its first character is a brace
    is_object = F.col("raw").isNotNull() & F.ltrim("value").startswith("{")
    return parsed.withColumns({"line_len": F.length("value"), "readable": is_object})


def warnings(scanned: DataFrame) -> DataFrame:
    """S02 — places of the unreadable lines, in order."""
    name = F.element_at(F.split("file", "/"), -1)
    return (scanned.filter((F.col("line_len") > 0) & ~F.col("readable")).orderBy("file", "line_no")
            .select(F.concat(name, F.lit(":"), F.col("line_no").cast("string"), F.lit(" unreadable JSON line, skipped")).alias("warning")))


def records(scanned: DataFrame) -> DataFrame:
    """The readable lines as typed columns; nested values stay Variants."""
    def get(path: str, kind: str) -> Column:
        return F.try_variant_get("raw", path, kind)

    return scanned.filter((F.col("line_len") > 0) & F.col("readable")).select(
        "file", "line_no", get("$.type", "string").alias("type"), get("$.uuid", "string").alias("uuid"), get("$.parentUuid", "string").alias("parent_uuid"),
        get("$.sessionId", "string").alias("session_id"), get("$.timestamp", "string").try_cast("timestamp").alias("timestamp"),
        get("$.cwd", "string").alias("cwd"), get("$.gitBranch", "string").alias("git_branch"), get("$.version", "string").alias("version"),
        get("$.entrypoint", "string").alias("entrypoint"), get("$.isSidechain", "boolean").alias("is_sidechain"), get("$.isMeta", "boolean").alias("is_meta"),
        get("$.promptId", "string").alias("prompt_id"), get("$.origin", "variant").alias("origin"), get("$.message", "variant").alias("message"),
        get("$.toolUseResult", "variant").alias("tool_use_result"), get("$.attributionSkill", "string").alias("attribution_skill"),
        # a key may be spelled with escapes; without either text no block has an input
        F.when(F.contains("value", F.lit("input")) | F.contains("value", F.lit("\\u")), F.from_json("value", _BLOCK_INPUTS)["message"]["content"]["input"]).alias("block_inputs"))


def read_records(spark: SparkSession, root: str, pattern: str = "*.jsonl", **options) -> DataFrame:
    return records(scan(number_lines(read_lines(spark, root, pattern, **options))))
