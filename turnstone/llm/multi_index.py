"""Nearest neighbours by largest inner product with an inverted multi-index.

The vectors' two halves are quantised separately with ``CENTROIDS`` centroids each, fitted on at most ``SAMPLE`` vectors (the first by hash of
the id); a cell is a pair of centroids. A query sorts both lists of centroids by their inner product with its halves and takes the pairs
by their summed distance from a heap, until the cells taken hold ``SHARE`` of all entries (and ``LEAST`` entries at least). Entries of
those cells are ranked again by the inner product of the original vectors in double precision.

Cells are laid into blocks of about ``BLOCK`` entries, a larger cell into several; the queries that visit a block into chunks of about
``CHUNK``. A group of rows is one block and one chunk of its visitors, so a cell with a third of all vectors is no group of its own, an entry is copied
once per ``CHUNK`` visitors of its block, and entries that no query visits are not moved at all. Vectors that are spread evenly over the sphere, as those of the test
tables, have no near cells to speak of: nine tenths of the nearest are found in some two fifths of the entries. Clustered vectors need a
smaller share.

No part take rows with null id, null, empty or zero vectors, vectors with null or non-finite components, and vectors of another length
than the commonest one in the table (of equally common ones the largest). Of rows that repeat a query's id the smallest vector asks; a query never finds its own id. Ties go to the smaller
id. Other columns are not read. Empty tables give no rows; with fewer than k candidates found, all are returned.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnstone.llm.base import partitions, stored

CENTROIDS, SAMPLE, ROUNDS = 64, 8192, 12
SHARE, LEAST = 0.45, 2000
BLOCK, CHUNK = 8192, 4096
SLICE = 16_384            # visits that a task lays out at once
SMALL = 500_000           # blocks up to which their numbers of chunks are sent to every task


def sound(vectors: DataFrame, id_column: str, column: str, length: int | None = None) -> DataFrame:
    """``vec_id, vec`` (doubles) of the vectors that take part: those of the given length, else of the commonest (of equally common ones the largest)."""
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(column).cast("array<double>").alias("vec")).filter("vec_id is not null and size(vec) > 0")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(finite & F.exists("vec", lambda x: x != 0))
    if length is None:
        found = rows.groupBy(F.size("vec").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
        length = found["length"] if found else 0
    return rows.filter(F.size("vec") == length)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids ** 2).sum(1) - 2 * x @ centroids.T).argmin(1)


def codebook(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means centroids of the rows of x."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        mine = nearest(x, centroids)
        n = np.bincount(mine, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, mine, x)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centroids


def fit(rows: DataFrame, centroids: int = CENTROIDS, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray] | None:
    """Codebooks of the two halves."""
    found = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(sample).select("vec").collect()
    if not found:
        return None
    x = np.array([r["vec"] for r in found])
    half, k = (x.shape[1] + 1) // 2, max(1, min(centroids, len(x) // 8))
    second = x[:, half:] if x.shape[1] > half else np.zeros((len(x), 1))
    return codebook(x[:, :half], k, 1), codebook(second, k, 2)


def halves(x: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = books[0].shape[1]
    return x[:, :n], x[:, n:] if x.shape[1] > n else np.zeros((len(x), 1))


def assign(rows: DataFrame, books: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Adds ``cell``."""
    id_type, k = rows.schema["vec_id"].dataType.simpleString(), len(books[1])

    def run(batches):
        for batch in batches:
            a, b = halves(matrix(batch.column("vec")), books)
            cell = (nearest(a, books[0]) * k + nearest(b, books[1])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vec"), pa.array(cell)], names=["vec_id", "vec", "cell"])

    return rows.mapInArrow(run, f"vec_id {id_type}, vec array<double>, cell int")


def traverse(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
    """Cells in order of summed distance until they hold enough entries. ``first``, ``second``: distances of the halves' centroids."""
    i_of, j_of = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b, i_of, j_of = first[i_of].tolist(), second[j_of].tolist(), i_of.tolist(), j_of.tolist()
    k, got, out = len(b), 0, []
    heap = [(a[0] + b[0], 0, 0)]
    while heap and got < enough:
        _, i, j = heapq.heappop(heap)
        cell = i_of[i] * k + j_of[j]
        if sizes[cell]:
            out.append(cell)
            got += sizes[cell]
        if j + 1 < k:
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):                          # each pair is reached once: along its row
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return out


def lay_out(sizes: list[int], block: int) -> tuple[list[int], list[int]]:
    """Per cell its first block and its number of blocks."""
    first, parts, at, room = [], [], 0, block
    for n in sizes:
        if n > block:
            at += room < block
            first.append(at), parts.append(-(-n // block))
            at, room = at + parts[-1], block
            continue
        if n > room:
            at, room = at + 1, block
        first.append(at), parts.append(1)
        room -= n
    return first, parts


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, share: float = SHARE, least: int = LEAST, centroids: int = CENTROIDS,
           id_column: str = "vec_id", column: str = "embedding", block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's k nearest found. Both tables have the id and the vector column."""
    spark = vectors.sparkSession
    rows = stored(sound(vectors, id_column, column), "index-vectors")
    id_type = rows.schema["vec_id"].dataType.simpleString()
    books = fit(rows, centroids)
    if books is None:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score double")
    cells = len(books[0]) * len(books[1])
    entries = stored(assign(rows, books), "index-entries")
    counts = {r["cell"]: r["n"] for r in entries.groupBy("cell").agg(F.count("*").alias("n")).collect()}       # at most ``cells`` rows
    sizes = [counts.get(c, 0) for c in range(cells)]
    first, parts = lay_out(sizes, block)
    enough = max(least, math.ceil(share * sum(sizes)))
    places = spark.createDataFrame([(c, first[c], parts[c]) for c in range(cells) if sizes[c]], "of int, first int, parts int")

    asked = sound(queries, id_column, column, len(rows.first()["vec"])).repartition(partitions(spark), "vec_id").groupBy("vec_id").agg(F.min("vec").alias("vec"))

    def visit(batches):
        for batch in batches:
            a, b = halves(matrix(batch.column("vec")), books)
            near_a, near_b = -(a @ books[0].T), -(b @ books[1].T)
            row, where, taken = [], [], []
            for i in range(batch.num_rows):
                seen: dict[int, list[int]] = {}
                for c in traverse(near_a[i], near_b[i], sizes, enough):
                    for part in range(parts[c]):
                        seen.setdefault(first[c] + part, []).append(c)
                row += [i] * len(seen)
                where += seen
                taken += seen.values()
                if len(row) >= SLICE or i + 1 == batch.num_rows:
                    for lo in range(0, len(row), SLICE):
                        at = pa.array(row[lo:lo + SLICE], pa.int64())
                        yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("vec").take(at), pa.array(where[lo:lo + SLICE], pa.int32()),
                                                          pa.array(taken[lo:lo + SLICE], pa.list_(pa.int32()))], names=["query_id", "query", "block", "cells"])
                    row, where, taken = [], [], []

    visits = stored(asked.mapInArrow(visit, f"query_id {id_type}, query array<double>, block int, cells array<int>"), "index-visits")
    chunks = visits.groupBy(F.col("block").alias("in_block")).agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    if max(f + n for f, n in zip(first, parts)) <= SMALL:
        chunks = F.broadcast(chunks)
    visits = visits.join(chunks, F.col("block") == F.col("in_block")).select(
        "query_id", "query", "block", "cells", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int").alias("chunk"))
    placed = entries.join(places, F.col("cell") == F.col("of")).select(
        "vec_id", "vec", "cell", (F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("parts"))).cast("int").alias("block"))
    placed = placed.join(chunks, F.col("block") == F.col("in_block")).select(
        "vec_id", "vec", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))

    def rank(block_rows: pa.Table, query_rows: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not block_rows.num_rows or not query_rows.num_rows:
            return pa.table({"query_id": query_rows.column("query_id")[:0], "vec_id": block_rows.column("vec_id")[:0], "score": pa.array([], pa.float64())})
        block_rows = block_rows.sort_by([("cell", "ascending"), ("vec_id", "ascending")]).combine_chunks()
        x, ids, cell = matrix(block_rows.column("vec").combine_chunks()), block_rows.column("vec_id").to_numpy(), block_rows.column("cell").to_numpy()
        starts = {int(c): (int(s), int(n)) for c, s, n in zip(*np.unique(cell, return_index=True, return_counts=True))}
        q, asks = matrix(query_rows.column("query").combine_chunks()), query_rows.column("query_id").to_numpy()
        lists, found_q, found_v, found_s = query_rows.column("cells").to_pylist(), [], [], []
        for lo in range(0, len(q), 256):
            near = q[lo:lo + 256] @ x.T
            for i, scores in enumerate(near, lo):
                use = np.zeros(len(ids), bool)
                for c in lists[i]:
                    if c in starts:
                        s, n = starts[c]
                        use[s:s + n] = True
                at = np.flatnonzero(use & (ids != asks[i]))
                if len(at) > k:                                  # keep what may tie with the k-th, then rank by sums in one fixed order
                    kth = np.partition(scores[at], len(at) - k)[len(at) - k]
                    at = at[scores[at] >= kth - 1e-9 * max(1.0, abs(kth))]
                exact = (x[at] * q[i]).sum(axis=1)
                best = np.lexsort((ids[at], -exact))[:k]
                found_q.append(np.full(len(best), asks[i])), found_v.append(ids[at][best]), found_s.append(exact[best])
        return pa.table([pa.array(np.concatenate(found_q)), pa.array(np.concatenate(found_v)), pa.array(np.concatenate(found_s))], names=names)

    met = placed.groupBy("block", "chunk").cogroup(visits.groupBy("block", "chunk")).applyInArrow(rank, f"query_id {id_type}, vec_id {id_type}, score double")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
