"""Best-fit packing of tokenised documents into sequences of one length, in bulk-synchronous rounds.

Documents are cut into pieces of at most ``size`` tokens (only longer ones; the first piece takes the rest). Sorting pieces and gaps
by range needs no sampling here: both are whole numbers up to ``size``, so a sorted range is the set of pieces, or of open
sequences, with one length or one gap. A round takes the longest pieces left and sweeps the gaps for their successor, the smallest
gap that holds them. Pieces and gaps that meet are matched by rank: the k-th piece of the range goes to the k-th sequence of the
gap's range, so no two want the same place. Then the gaps are updated, and the next round begins. Where no gap is large enough, new
sequences are opened.

The driver sweeps ranges, not rows: it holds at most ``size`` counts and a few thousand runs of sequence numbers that were treated
alike, for any number of documents. Ranks and placements of pieces are found by Spark, in blocks of bounded size.

Null texts are empty and consist of the end id. Null ids and repeated rows are packed like all others. Equal pieces may swap places.
Other columns are not read, except those named in ``keep``. An empty table gives no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.base import blocks_for, numbered, stored, text_or_empty, uniform_bits
from turnstone.llm.tokens import encoder

SIZE = 1024
END_ID = 2


def cut(n: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    start, length = 0, (n - 1) % size + 1
    while start < n:
        yield start, length
        start, length = start + length, size


def pieces(docs: DataFrame, tokenizer_path: str, words: bool = False, end_id: int = END_ID, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` per piece; ``with_ids`` adds ``ids``, little-endian unsigned 32-bit numbers."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import zlib

        encode = encoder(tokenizer_path, words, end_id).encode
        for batch in batches:
            row, no, starts, lengths, sums, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                data = encode(text.as_py())
                for k, (start, length) in enumerate(cut(len(data) // 4, size)):
                    part = data[4 * start:4 * (start + length)]
                    row.append(i), no.append(k), starts.append(start), lengths.append(length), sums.append(zlib.crc32(part))
                    ids.append(part if with_ids else None)
            out = {"doc_id": batch.column("doc_id").take(pa.array(row, pa.int64())), "piece": pa.array(no, pa.int32()), "start": pa.array(starts, pa.int64()),
                   "length": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(sums, pa.int64())}
            yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(ids, pa.binary())} if with_ids else {}))

    return rows.mapInArrow(run, f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def sweep(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Rounds over ranges: (length, first rank, pieces, first sequence, offset), one per run of pieces that meet a run of sequences."""
    gaps: dict[int, deque] = {}
    moves, opened = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            gap = next((g for g in range(length, size) if gaps.get(g)), None)
            if gap is None:                          # open as many sequences as these pieces fill
                gap, new = size, -(-left // (size // length))
                gaps.setdefault(size, deque()).append((opened, new))
                opened += new
            first, n = gaps[gap].popleft()
            taken = min(n, left)
            if taken < n:
                gaps[gap].appendleft((first + taken, n - taken))
            moves.append((length, rank, taken, first, size - gap))
            gaps.setdefault(gap - length, deque()).append((first, taken))
            rank, left = rank + taken, left - taken
    return moves


def best_fit(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``doc_id``, ``piece`` and ``length`` (1 to ``size``)."""
    spark = parts.sparkSession
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}     # at most ``size`` rows
    moves = spark.createDataFrame(sweep(counts, size), "of bigint, first_rank bigint, n bigint, first_sequence bigint, offset bigint")
    block = F.pmod(uniform_bits(F.col("doc_id"), F.col("piece")), F.lit(blocks_for(sum(counts.values()))))
    ranked = numbered(parts, ["length"], [F.col("doc_id"), F.col("piece")], "rank", block)
    met = (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n"))
    return (ranked.join(moves, met).withColumn("sequence_id", F.col("first_sequence") + F.col("rank") - F.col("first_rank"))
            .drop("of", "first_rank", "n", "first_sequence", "rank"))


def pack(docs: DataFrame, tokenizer_path: str, words: bool = False, end_id: int = END_ID, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``)."""
    return best_fit(stored(pieces(docs, tokenizer_path, words, end_id, size, with_ids), "pack-pieces"), size)
