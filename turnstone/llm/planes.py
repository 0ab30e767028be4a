"""Token ids in bit-plane files: write in order of ``doc_id``, read back.

The ids of consecutive documents form a stream, cut into blocks of ``block`` ids. A block is transposed: plane p holds bit p (or
byte p) of all its ids. Each plane is compressed with zstandard on its own, so the nearly empty high planes cost a few bytes. A
segment is one row of the file: whole documents of about ``segment`` ids, their ids' lengths, the compressed planes behind each other, and
the chunk index (block, plane, where its bytes begin, how many). The files are Parquet, written and read by Spark, so they can lie in any store.

Documents are range-partitioned by id and sorted inside each partition; a partition's number and a segment's number in it give the
order. Start positions are prefix sums over segments, first inside a partition, then over partitions.

Null texts are empty and hold only the end id. Null ids come first. Rows that repeat an id stand next to each other, in the order of
their texts. A document longer than a segment gets a segment of its own, of any length. Other columns are not read. An empty table gives
empty files.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnstone.llm.base import partitions, text_or_empty
from turnstone.llm.tokens import encoder
from turnstone.session import shared_dir

BLOCK, SEGMENT = 65_536, 262_144
LEVEL = 3
CHUNK = pa.struct([("block", pa.int32()), ("plane", pa.int32()), ("begin", pa.int64()), ("size", pa.int64())])
SCHEMA = ("part int, segment int, n_ids bigint, ids array<{id}>, lengths array<bigint>, block bigint, kind string, "
          "chunks array<struct<block:int,plane:int,begin:bigint,size:bigint>>, data binary")


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Planes of unsigned 32-bit ids: 4 of bytes or 32 of bits, lowest first."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        rows = np.unpackbits(rows, axis=1, bitorder="little")
        return [np.packbits(plane, bitorder="little").tobytes() for plane in rows.T]
    return [plane.tobytes() for plane in rows.T]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "bit":
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        return np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(-1)
    return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)).view("<u4").reshape(-1)


def write_planes(docs: DataFrame, path: str, tokenizer_path: str, words: bool, end_id: int, kind: str = "byte",
                 block: int = BLOCK, segment: int = SEGMENT) -> None:
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    ordered = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        encode, squeeze = encoder(tokenizer_path, words, end_id).encode, zstandard.ZstdCompressor(level=LEVEL).compress

        def row(ids, held):
            stream = np.frombuffer(b"".join(held), "<u4")
            chunks, data, begin = [], [], 0
            for b, start in enumerate(range(0, len(stream), block)):
                for p, plane in enumerate(to_planes(stream[start:start + block], kind)):
                    small = squeeze(plane)
                    chunks.append({"block": b, "plane": p, "begin": begin, "size": len(small)})
                    data.append(small)
                    begin += len(small)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "segment": pa.array([made], pa.int32()), "n_ids": pa.array([len(stream)], pa.int64()),
                "ids": pa.array([ids]), "lengths": pa.array([[len(h) // 4 for h in held]], pa.list_(pa.int64())), "block": pa.array([block], pa.int64()),
                "kind": [kind], "chunks": pa.array([chunks], pa.list_(CHUNK)), "data": pa.array([b"".join(data)], pa.binary())}).cast(shape)

        ids, held, n, shape = [], [], 0, None
        for batch in batches:
            if shape is None:
                list_of = pa.list_(batch.schema.field("doc_id").type)
                shape = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("n_ids", pa.int64()), ("ids", list_of), ("lengths", pa.list_(pa.int64())),
                                   ("block", pa.int64()), ("kind", pa.string()), ("chunks", pa.list_(CHUNK)), ("data", pa.binary())])
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                data = encode(text.as_py())
                ids.append(doc_id), held.append(data)
                n += len(data) // 4
                if n >= segment:
                    yield row(ids, held)
                    ids, held, n, made = [], [], 0, made + 1
        if ids:
            yield row(ids, held)

    ordered.mapInArrow(run, SCHEMA.format(id=id_type)).write.parquet(path)


def chunk_index(files: DataFrame) -> DataFrame:
    """Per segment the number of ids before it. Reads no data."""
    sizes = files.groupBy("part", "segment").agg(F.sum("n_ids").alias("n"))
    parts = sizes.groupBy(F.col("part").alias("p")).agg(F.sum("n").alias("in_part"))
    parts = parts.withColumn("before", F.coalesce(F.sum("in_part").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = W.partitionBy("part").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return sizes.join(parts, F.col("part") == F.col("p")).select(
        F.col("part").alias("i_part"), F.col("segment").alias("i_segment"), (F.col("before") + F.col("inside")).alias("first_id"))


def read_planes(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` per document (and ``ids``), decoded from the files."""
    files = spark.read.parquet(path)
    id_type = files.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        import zlib

        import zstandard

        widen = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for r in range(batch.num_rows):
                part, segment, n, block, kind = (batch.column(c)[r].as_py() for c in ("part", "segment", "n_ids", "block", "kind"))
                data, blocks = batch.column("data")[r].as_buffer(), {}
                for c in batch.column("chunks")[r].as_py():
                    blocks.setdefault(c["block"], []).append(widen(memoryview(data)[c["begin"]:c["begin"] + c["size"]]))
                stream = b"".join(from_planes(blocks[b], min(block, n - b * block), kind).tobytes() for b in sorted(blocks))
                starts, sums, held, at = [], [], [], 0
                lengths = batch.column("lengths")[r].as_py()
                for length in lengths:
                    ids = stream[4 * at:4 * (at + length)]
                    starts.append(at), sums.append(zlib.crc32(ids)), held.append(ids if with_ids else None)
                    at += length
                out = {"doc_id": batch.column("ids")[r].values, "part": pa.array([part] * len(lengths), pa.int32()),
                       "segment": pa.array([segment] * len(lengths), pa.int32()), "inside": pa.array(starts, pa.int64()),
                       "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(sums, pa.int64())}
                yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(held, pa.binary())} if with_ids else {}))

    shape = f"doc_id {id_type}, part int, segment int, inside bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    found = files.select("part", "segment", "n_ids", "ids", "lengths", "block", "kind", "chunks", "data").mapInArrow(run, shape)
    joined = found.join(chunk_index(files), (F.col("part") == F.col("i_part")) & (F.col("segment") == F.col("i_segment")))
    return joined.select("doc_id", (F.col("first_id") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def round_trip(docs: DataFrame, tokenizer_path: str, words: bool, end_id: int, kind: str = "byte") -> DataFrame:
    """Write the files into the shared folder and read them back."""
    path = f"{shared_dir(docs.sparkSession)}/llm-planes-{uuid.uuid4().hex}"
    write_planes(docs, path, tokenizer_path, words, end_id, kind)
    return read_planes(docs.sparkSession, path)
