"""Spend report CSV."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.functions import exprs as X
from turnstone.functions import fixed_values as V
from turnstone.operators import ordered as O
from turnstone.session import stored

_SCHEMA = ("email string, account string, product string, model string, requests bigint, prompt_tokens bigint, "
           "completion_tokens bigint, net decimal(18,6), gross decimal(18,6), day date")

_COUNTS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("quotes", pa.int64()), ("even", pa.int64()), ("odd", pa.int64())])
_PARTS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("record_no", pa.int64()), ("record", pa.string()), ("whole", pa.bool_())])


def map_header(columns: list[str]) -> dict[str, str]:
    """S06 — field to column by keyword, first match wins on both sides; works on the header only."""
    found: dict[str, str] = {}
    for column in columns:
        name = column.strip().lower()
        field = next((f for f, cues in V.SPEND_HEADER_CUES if f not in found and any(c in name for c in cues)), None)
        if field:
            found[field] = column
    return found


def missing_fields(columns: list[str]) -> list[str]:
    """S06 — required fields that no column provides."""
    found = map_header(columns)
    return [f for f in ("email", "model") if f not in found]


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """S05 — ``file, record_no, record``: the records of CSV files, each file read by as many tasks as it has splits.

    A line break ends a record when the quotes up to it are even in number. Lines are read split by split; the quotes of the splits are summed
    up in a prefix scan, one row per split, so every reader knows whether its split begins inside a cell and with which record, and joins the
    lines where it reads them. Only records that a border of a split cuts are shuffled. Line breaks inside a cell become ``\\n``.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    splits = lines.select("file", "block", quotes.cast("bigint").alias("q")).mapInArrow(_count_ends, "file string, block bigint, quotes bigint, even bigint, odd bigint")
    splits = stored(splits, "spend-splits")                     # one row per split, read by two scans
    began = O.ordered_scan(splits, ["file"], ["block"], {"upto": O.running_sum(F.col("quotes"))}, F.col("block"))
    began = began.withColumn("inside", (F.col("upto") - F.col("quotes")) % 2).withColumn("ends", F.when(F.col("inside") == 0, F.col("even")).otherwise(F.col("odd")))
    placed = O.ordered_scan(began, ["file"], ["block"], {"_to": O.running_sum(F.col("ends"))}, F.col("block"))
    placed = placed.select(F.col("file").alias("_file"), F.col("block").alias("_block"), "inside", (F.col("_to") - F.col("ends")).alias("first"))
    met = lines.join(F.broadcast(placed), (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block"))).select("file", "block", "inside", "first", "value")      # one row per split
    parts = met.mapInArrow(_join_lines, "file string, block bigint, record_no bigint, record string, whole boolean")
    # a record that a split cuts is one piece in each of its splits
    cut = parts.filter("NOT whole").groupBy("file", "record_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "record"))), lambda x: x["record"]), "\n").alias("record"))
    return parts.filter("whole").select("file", "record_no", "record").unionByName(cut)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """The splits in a batch with their rows; the rows of a split follow each other."""
    files, blocks = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
    of = files.indices.to_numpy()
    new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (blocks[1:] != blocks[:-1])]) if len(of) else []
    for lo, hi in zip(new, [*new[1:], len(of)]):
        yield (files.dictionary[of[lo]].as_py(), int(blocks[lo])), int(lo), int(hi)


def _count_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: its quotes, and the lines after which their number is even and odd."""
    names, split, seen = ["file", "block", "quotes", "even", "odd"], None, [0, 0, 0]
    for batch in batches:
        for key, lo, hi in _runs(batch):
            if key != split:
                if split:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, (*split, *seen)))], schema=_COUNTS)
                split, seen = key, [0, 0, 0]
            upto = seen[0] + np.cumsum(batch.column(2).to_numpy()[lo:hi])
            even = int(np.count_nonzero(upto % 2 == 0))
            seen = [int(upto[-1]), seen[1] + even, seen[2] + hi - lo - even]
    if split:
        yield pa.RecordBatch.from_pylist([dict(zip(names, (*split, *seen)))], schema=_COUNTS)


def _join_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of a split, joined from its lines as they are read; ``whole`` unless a border of the split may cut the record."""
    split, no, inside, left, cut = None, 0, 0, None, False        # left: the text of the record that is open

    def made(records, numbers, whole):
        n = len(records)
        return pa.RecordBatch.from_arrays([pa.array([split[0]] * n, pa.string()), pa.array([split[1]] * n, pa.int64()), pa.array(numbers, pa.int64()), records, pa.array(whole, pa.bool_())], schema=_PARTS)

    for batch in batches:
        for key, lo, hi in _runs(batch):
            if key != split:
                if left is not None:
                    yield made(pa.array([left], pa.string()), [no], [False])
                split, inside, no, left = key, int(batch.column(2)[lo].as_py()), int(batch.column(3)[lo].as_py()), None
                cut = inside == 1                        # the first record began in an earlier split
            values = batch.column(4).slice(lo, hi - lo)
            upto = inside + np.cumsum(pc.count_substring(values, '"').to_numpy())
            ends, inside = np.flatnonzero(upto % 2 == 0) + 1, int(upto[-1] % 2)
            if left is not None:
                values, ends = pa.concat_arrays([pa.array([left], values.type), values]), ends + 1
            done = int(ends[-1]) if len(ends) else 0
            if done:
                records = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), values), "\n")
                whole = np.ones(len(ends), bool)
                whole[0], cut = not cut, False
                yield made(records, np.arange(no, no + len(ends)), whole)
                no += len(ends)
            left = "\n".join(values.slice(done).to_pylist()) if done < len(values) else None
    if left is not None:
        yield made(pa.array([left], pa.string()), [no], [False])


def read_spend(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """S05, S06 — rows of the report and warnings. Unrelated headers give no rows and a warning.

    Quoted cells may hold commas, doubled quotes and line breaks. The header is read from the first record; each file has one.
    """
    columns = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False).columns          # reads one record
    missing = missing_fields(columns)
    if missing:
        return spark.createDataFrame([], _SCHEMA), [f"column « {m} » not found" for m in missing]
    found = map_header(columns)
    shape = ", ".join(f"c{i} string" for i in range(len(columns)))
    record = F.from_csv("record", shape, {"quote": '"', "escape": '"'})
    csv = csv_records(spark, path).filter("record_no > 0").select(record.alias("r")).select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(columns)])

    def cell(field: str):
        return F.coalesce(F.trim(F.col(f"`{found[field]}`")), F.lit("")) if field in found else F.lit("")

    filled = csv.filter(~X.is_blank(F.concat_ws("", *[F.col(f"`{c}`") for c in csv.columns])))
    return filled.select(
        cell("email").alias("email"), cell("account").alias("account"), cell("product").alias("product"), cell("model").alias("model"),
        X.number_from_text(cell("requests")).alias("requests"), X.number_from_text(cell("prompt")).alias("prompt_tokens"),
        X.number_from_text(cell("completion")).alias("completion_tokens"), X.money_from_text(cell("net")).alias("net"),
        X.money_from_text(cell("gross")).alias("gross"), cell("date").try_cast("date").alias("day")), []
