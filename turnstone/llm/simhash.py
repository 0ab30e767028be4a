"""SimHash near-dedup: fingerprints compared through tables of distances to reference fingerprints.

A document's fingerprint has a bit set where more than half of the hashes of its word shingles (A-Z lowered, repeats counted; with
fewer words, the whole sequence) have it; without words it is zero. Equal fingerprints are one node, so copies cost one row.

Every node has a row of distances to ``REFERENCES`` reference fingerprints (rows of a Hadamard matrix, so that no two measure the same).
By the triangle inequality no distance of two nodes within ``bits`` differing bits is more than ``bits`` apart, so a pair whose
largest coordinate difference exceeds that is discarded unseen; survivors are verified on the fingerprints. Nodes meet in cells: of
``bits + 2`` ranges of the fingerprint at least two are untouched between linked nodes, so each pair of ranges makes a cell per value.
The nodes of a cell stand in order of their distance to the first reference, where the table ends each node's sweep; nodes that
are already connected are not compared. A task returns a spanning forest, never pairs. Cells of more than ``TILE`` nodes are divided into blocks that are
compared two by two by different tasks, so no link is lost and no task holds a large cell.

Components come from alternating large-star and small-star. Rows with null id take part like others but name no component; a component
of such rows only is null. Repeated rows get equal results. Texts of any length are hashed whole, in runs of shingles. Empty tables give
no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.llm.base import partitions, release, stored, text_or_empty
from turnstone.llm.minhash import components

SHINGLE, BITS, SEED = 4, 4, 42
REFERENCES, TILE, RUN = 24, 4096, 1 << 15
HOT = 10_000              # at most so many fingerprints count as hot: those with more than a ten-thousandth of all rows


def references(n: int = REFERENCES) -> np.ndarray:
    """The first n rows of the Hadamard matrix of order 64 as words of 64 bits: bit j of row i is the parity of i & j."""
    return np.array([sum((bin(i & j).count("1") & 1) << j for j in range(64)) for i in range(n)], np.uint64)


def fingerprint(text: str, n: int = SHINGLE) -> int:
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()             # both see ASCII only: A-Z, [\x20\x09-\x0D]
    if not words:
        return 0
    line, size, digest = b" ".join(words), min(n, len(words)), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    begins, ends = begins[:len(words) - size + 1].tolist(), ends[size - 1:].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, len(begins), RUN):
        h = np.fromiter((digest(line[s:e], SEED) for s, e in zip(begins[i:i + RUN], ends[i:i + RUN])), np.dtype("<u8"))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(begins), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """``doc_id, print``: the fingerprint's bits as a long."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), n) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "print"])
        release()

    return rows.mapInArrow(run, f"doc_id {kind}, print bigint")


def masks(bits: int = BITS) -> list[int]:
    """Masks of every two of ``bits + 2`` ranges of the 64 bits, as signed longs."""
    borders = [64 * i // (bits + 2) for i in range(bits + 3)]
    ranges = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(borders, borders[1:])]
    both = [a | b for a, b in combinations(ranges, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in both]


def cells(nodes: DataFrame, bits: int = BITS, tile: int = TILE) -> DataFrame:
    """``which, part, low, high, print``: nodes beside those that they may be linked with. Cells of one node are left out."""
    at = [F.struct(F.lit(i).alias("which"), F.col("print").bitwiseAND(F.lit(m).cast("long")).alias("part")) for i, m in enumerate(masks(bits))]
    spread = nodes.select("print", F.explode(F.array(*at)).alias("c")).select("c.which", "c.part", "print")
    sized = spread.groupBy("which", "part").agg(F.count("*").alias("size")).filter("size > 1")
    blocks = F.ceil(F.col("size") / tile).cast("int")
    mine = F.pmod(F.xxhash64("print"), blocks).cast("int")
    return (spread.join(sized, ["which", "part"]).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .select("which", "part", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "print"))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def forest(prints: np.ndarray, group: np.ndarray, bits: int = BITS, refs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ends of links that connect what is linked inside each group. Rows of a group stand together."""
    refs = references() if refs is None else refs
    first = popcount(prints ^ refs[0])
    order = np.lexsort((first, group))
    prints, group = prints[order], group[order]
    table = popcount(prints[:, None] ^ refs[None, :]).astype(np.int8)
    up = np.arange(len(prints))
    a, b = [], []
    live, step = np.arange(len(prints)), 0

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    while len(live):
        step += 1
        live = live[live + step < len(prints)]
        live = live[(group[live] == group[live + step]) & (table[live + step, 0] - table[live, 0] <= bits)]      # sorted: later rows are farther still
        i = live[up[live] != up[live + step]]
        for c in range(1, len(refs)):
            if not len(i):
                break
            i = i[np.abs(table[i, c] - table[i + step, c]) <= bits]
        i = i[popcount(prints[i] ^ prints[i + step]) <= bits]
        for x in i.tolist():
            p, q = top(x), top(x + step)
            if p != q:
                up[max(p, q)] = min(p, q)
                a.append(x), b.append(x + step)
        if len(i):
            while (up[up] != up).any():
                up = up[up]
    return order[np.array(a, np.int64)], order[np.array(b, np.int64)]


def links(nodes: DataFrame, bits: int = BITS, tile: int = TILE, refs: int = REFERENCES) -> DataFrame:
    """Edges ``a, b`` that connect what is linked among the different ``print`` of ``nodes``."""
    keys = ["which", "part", "low", "high"]
    met = cells(nodes, bits, tile)
    dealt = met.repartition(partitions(met.sparkSession), *keys).sortWithinPartitions(*keys)

    def run(batches):
        table, rest = references(refs), None

        def settle(found: pa.Table) -> pa.RecordBatch:
            key = [np.asarray(found.column(k)) for k in keys]
            new = np.zeros(found.num_rows, bool)
            for k in key:
                new[1:] |= k[1:] != k[:-1]
            prints = np.asarray(found.column("print")).view(np.uint64)
            a, b = forest(prints, np.cumsum(new), bits, table)
            return pa.RecordBatch.from_arrays([pa.array(prints[x].view(np.int64)) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([rest, now]).combine_chunks() if rest is not None else now
            same = np.ones(now.num_rows, bool)
            for k in keys:
                x = np.asarray(now.column(k))
                same &= x == x[-1]
            whole = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0                  # the last cell may go on
            rest = now.slice(whole)
            if whole:
                yield settle(now.slice(0, whole).combine_chunks())
        if rest is not None and rest.num_rows:
            yield settle(rest.combine_chunks())
        release()

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, tile: int = TILE, refs: int = REFERENCES) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id`` (smallest id that links reach) per document."""
    prints = stored(fingerprints(docs, shingle), "simhash-prints")
    nodes = stored(prints.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "simhash-nodes")
    found = components(stored(links(nodes.select("print"), bits, tile, refs), "simhash-links"))
    named = nodes.join(found, F.col("print") == F.col("node"), "left").select("print", "least", "rows", F.coalesce("component", "print").alias("component"))
    heads = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(named.join(heads, "component").select(F.col("print").alias("of"), "component_id", "rows"), "simhash-named")
    total = named.agg(F.sum("rows")).first()[0] or 0
    often = F.broadcast(named.filter(F.col("rows") > total // HOT).select("of", F.struct("component_id").alias("hot")))      # fewer than HOT rows
    marked = prints.join(often, F.col("print") == F.col("of"), "left").drop("of")
    of_hot = marked.filter("hot is not null").select("doc_id", "print", "hot.component_id")
    of_rest = marked.filter("hot is null").join(named, F.col("print") == F.col("of")).select("doc_id", "print", "component_id")
    return of_hot.unionByName(of_rest).select("doc_id", hex16(F.col("print")).alias("fingerprint"), "component_id")


def hex16(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))
