"""MinHash near-dedup: many universal hash minima, bands, verification by signature and by full sets, large-star and small-star.

A document's set holds the different runs of ``SHINGLE`` words (with fewer words, the whole sequence; without words it is empty and
linked with nothing); A-Z are lowered. Documents with equal sets form a class, represented by its smallest id, so copies cost
one row. Each representative gets ``ROWS`` minima of universal hash functions per band and one key per band. The number of bands
follows the similarity asked for: two representatives that just reach it share no key with probability ``MISS`` at most (24 bands at
0.85, 36 at 0.80).

No bucket is turned into pairs. Representatives connected by common bands form a group; its members are cut into blocks, and a task
compares two blocks on their full sets and returns a spanning forest of the links. Groups of more than ``LARGE`` are first thinned:
each member is compared with the smallest of the bucket that it meets in most bands, then bucket by bucket one pivot, another in
each round, with the members of other components, after a look at sizes and byte signatures; the buckets that still hold several
components are then settled in blocks like a group. Every pair that shares a band is compared or already connected.

Classes are linked under numbers of their own; a component is named by the smallest id in it. Rows with null id take part in no link
and keep a null component. Rows that repeat an id and text get equal results; each text of an id that comes with several is linked on
its own, and where several of them are in one component only one text (and its repeated rows) is kept. Other columns are not read.
Texts of any length are read whole; a long one costs its distinct shingles in memory. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.base import release, stored, text_or_empty

SHINGLE, BANDS, ROWS = 5, 24, 5
PERCENT, MISS = 85, 8e-7
SURE = 0.25               # a signature this far below the similarity asked for settles a pair: over 7 standard errors
TILE, LARGE = 256, 8192   # documents of a block; a group of more is first thinned by pivots
PIVOTS, LINEAR = 4, 8     # rounds by pivot; stop while open pairs are at most so many times the rows
_ODD = np.uint64(0x9E3779B97F4A7C15)


def bands_for(percent: int) -> int:
    """Bands with which a pair of this similarity is missed with probability ``MISS`` at most."""
    return 1 if percent >= 100 else math.ceil(math.log(MISS) / math.log1p(-(percent / 100) ** ROWS))


@lru_cache(maxsize=8)
def hash_functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of the first n universal hash functions."""
    rng, step, a, b = np.random.default_rng(20_240_607), BANDS * ROWS, [], []
    for _ in range(0, n, step):
        a.append(rng.integers(1, 1 << 63, step, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        b.append(rng.integers(0, 1 << 63, step, dtype=np.uint64))
    return np.concatenate(a)[:n], np.concatenate(b)[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, n: int = SHINGLE) -> np.ndarray:
    """Sorted different 64-bit hashes of the runs of n words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()         # both see ASCII only: A-Z, [\x20\x09-\x0D]
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, np.uint64(size), np.uint64)
    for i in range(size):
        out = out * _ODD + h[i:len(h) - size + 1 + i]
    return np.unique(_mix(out))


def minima(shingles: np.ndarray, bands: int = BANDS) -> np.ndarray:
    factors, summands = hash_functions(bands * ROWS)
    best = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 1024):
        part = shingles[start:start + 1024]
        best = np.minimum(best, (factors[:, None] * part[None, :] + summands[:, None]).min(axis=1))
    return best


def band_keys(best: np.ndarray) -> np.ndarray:
    rows = best.reshape(-1, ROWS)
    key = np.arange(len(rows), dtype=np.uint64)
    for i in range(ROWS):
        key = _mix(key * _ODD + rows[:, i])
    return key.view(np.int64)


def sketches(docs: DataFrame, n_bands: int = BANDS) -> DataFrame:
    """``doc_id, text_id, n_shingles, set_id, bands, marks``: hash of the text, digest of the set, key per band, lowest byte of each minimum."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_id"), text_or_empty().alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import hashlib

        for batch in batches:
            sizes, digests, bands, marks = [], [], [], []
            for text in batch.column("text"):
                found = shingle_set(text.as_py())
                sizes.append(len(found))
                if not len(found):
                    digests.append(None), bands.append(None), marks.append(None)
                    continue
                best = minima(found, n_bands)
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                bands.append(band_keys(best)), marks.append(best.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                names=["doc_id", "text_id", "n_shingles", "set_id", "bands", "marks"])
        release()

    return rows.mapInArrow(run, f"doc_id {id_type}, text_id bigint, n_shingles bigint, set_id binary, bands array<bigint>, marks binary")


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, small, n, marks``: compressed texts of the representatives that take part in a comparison, which is what comparisons move."""
    rows = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_id"), "text").filter("text is not null and doc_id is not null")

    def squeeze(batches):
        import zstandard

        tool = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            small = [tool.compress(t.as_py().encode("utf-8", "surrogatepass")) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_id"), pa.array(small, pa.binary())], names=["doc_id", "text_id", "small"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(squeeze, f"doc_id {id_type}, text_id bigint, small binary")
    return found.join(nodes.select("node", "doc_id", "text_id", "n", "marks"), ["doc_id", "text_id"]).drop("doc_id", "text_id").dropDuplicates(["node"])


def compare(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``a, b, linked, similarity`` of pairs of nodes; similarity is null where sizes or signatures settle the pair."""
    def side(s: str) -> DataFrame:
        return texts.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("marks").alias(f"m_{s}"), F.col("small").alias(f"t_{s}"))

    met = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    id_type = met.schema["a"].dataType.simpleString()

    def run(batches):
        import zstandard

        tool, sets = zstandard.ZstdDecompressor(), OrderedDict()

        def shingles(node, small):
            if node in sets:
                sets.move_to_end(node)
            else:
                sets[node] = shingle_set(tool.decompress(small).decode("utf-8", "surrogatepass"))
                if len(sets) > 64:
                    sets.popitem(last=False)
            return sets[node]

        for batch in batches:
            linked, similar = [], []
            col = {c: batch.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b", "m_a", "m_b", "t_a", "t_b")}
            for a, b, n, m, x, y, s, t in zip(*(col[c] for c in ("a", "b", "n_a", "n_b", "m_a", "m_b", "t_a", "t_b"))):
                agree = (np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).mean()
                if 100 * min(n, m) < percent * max(n, m) or agree < percent / 100 - SURE:
                    linked.append(False), similar.append(None)
                    continue
                both = len(np.intersect1d(shingles(a, s), shingles(b, t), assume_unique=True))
                linked.append(100 * both >= percent * (n + m - both)), similar.append(both / (n + m - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_()), pa.array(similar, pa.float64())],
                                             names=["a", "b", "linked", "similarity"])

    return met.mapInArrow(run, f"a {id_type}, b {id_type}, linked boolean, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) by alternating large-star and small-star until no edge changes."""
    pairs = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "stars")
    if not pairs.take(1):
        return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    def mark_of(p):
        return tuple(p.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    mark = mark_of(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))     # larger neighbours to the least
        pairs = stored(large.filter("u <> v").distinct(), "stars")
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))                                                   # all v < u here
        small = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        pairs = stored(small.filter("u <> v").distinct(), "stars")
        now = mark_of(pairs)
        if now == mark:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = now


def _open(buckets: DataFrame, found: DataFrame) -> tuple[DataFrame, int, int]:
    """Buckets whose members are in several components, with each member's component; their rows, and their pairs across components."""
    named = buckets.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = named.groupBy("bucket", "component").agg(F.count("*").cast("double").alias("k"))
    split = parts.groupBy("bucket").agg(F.sum("k").alias("rows"), ((F.sum("k") ** 2 - F.sum(F.col("k") ** 2)) / 2).alias("pairs")).filter("pairs > 0")
    split = stored(split, "minhash-split")
    total = split.agg(F.sum("rows"), F.sum("pairs")).first()
    return named.join(split.select("bucket"), "bucket", "left_semi"), int(total[0] or 0), int(total[1] or 0)


def _across_pivot(members: DataFrame, turn: int) -> DataFrame:
    """Pairs of a bucket's pivot, another one each turn, with the members of other components."""
    pivot = members.groupBy("bucket").agg(F.min_by(F.struct("node", "component"), F.xxhash64("node", F.lit(turn))).alias("p"))
    pairs = members.join(pivot, "bucket").filter(F.col("component") != F.col("p.component"))
    return pairs.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()


def tile_links(members: DataFrame, texts: DataFrame, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """Edges ``a, b`` that connect what is linked inside each group of ``members`` (``grp, node, size``).

    A group's members are cut into blocks of about ``tile``; a task compares two blocks on full sets, all at once by counting common
    shingles with matrix products, and returns a spanning forest: no more rows than members.
    """
    blocks = F.ceil(F.col("size") / tile).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(5)), blocks).cast("int")
    rows = (members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")}).select("grp", "low", "high", "node", "mine"))
    met = rows.join(texts.select("node", "small"), "node")
    id_type = met.schema["node"].dataType

    def run(found: pa.Table) -> pa.Table:
        import zstandard

        tool = zstandard.ZstdDecompressor()
        found = found.sort_by("node")
        nodes, mine = found.column("node").to_pylist(), np.array(found.column("mine").to_pylist())
        sets = [shingle_set(tool.decompress(t).decode("utf-8", "surrogatepass")) for t in found.column("small").to_pylist()]
        sizes = np.array([len(s) for s in sets], np.int64)
        both = common(sets)
        linked = (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)) & (both > 0)
        if len(set(mine.tolist())) > 1:
            linked &= mine[:, None] != mine[None, :]            # pairs inside a block belong to its own tile
        up, a, b = list(range(len(nodes))), [], []

        def top(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for x, y in zip(*np.nonzero(np.triu(linked, 1))):
            p, q = top(int(x)), top(int(y))
            if p != q:
                up[max(p, q)] = min(p, q)
                a.append(nodes[x]), b.append(nodes[y])
        kind = found.schema.field("node").type
        return pa.table({"a": pa.array(a, kind), "b": pa.array(b, kind)})

    return met.groupBy("grp", "low", "high").applyInArrow(run, f"a {id_type.simpleString()}, b {id_type.simpleString()}")


def common(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections."""
    out = np.zeros((len(sets), len(sets)), np.int64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    use = shared[which]
    row, place = row[use], place[which[use]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    for start in range(0, int(shared.sum()), columns):
        lo, hi = np.searchsorted(place, [start, start + columns])
        part = np.zeros((len(sets), columns), np.float32)
        part[row[lo:hi], place[lo:hi] - start] = 1
        out += (part @ part.T).astype(np.int64)
    return out


def _large_groups(buckets: DataFrame, texts: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Edges from comparisons with pivots, and what these leave open, as groups for tiles: the buckets with several components."""
    best = F.max(F.struct("shared_bands", (-F.col("first")).alias("f")))
    star = buckets.filter("first <> node").groupBy("node", "first").agg(F.count("*").alias("shared_bands")).groupBy("node").agg(best.alias("best"))
    seen = stored(compare(star.select((-F.col("best.f")).alias("a"), F.col("node").alias("b")), texts, percent), "minhash-compared")
    buckets = buckets.drop("first")
    for turn in range(PIVOTS + 1):
        members, rows, pairs = _open(buckets, components(seen.filter("linked")))
        if turn == PIVOTS or pairs <= LINEAR * rows:
            break
        new = _across_pivot(stored(members, "minhash-open"), turn).join(seen.select("a", "b"), ["a", "b"], "left_anti")
        seen = stored(seen.unionByName(compare(new, texts, percent)), "minhash-compared")
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"))
    return seen.filter("linked").select("a", "b"), members.join(sizes, "bucket").select(F.col("bucket").alias("grp"), "node", "size")


def links(docs: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges ``a, b`` among representatives (``node, doc_id, text_id, n, bands, marks``) that connect every linked pair which shares a band."""
    spread = nodes.select("node", F.explode("bands").alias("bucket")).distinct()
    shared = spread.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("members")).filter("members > 1")
    buckets = stored(spread.join(shared.select("bucket", "first"), "bucket"), "minhash-buckets")
    near = components(buckets.filter("first <> node").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct())
    near = near.unionByName(near.select(F.col("component").alias("node"), "component").distinct())
    sized = stored(near.join(near.groupBy(F.col("component").alias("c")).agg(F.count("*").alias("size")), F.col("component") == F.col("c")).drop("c"), "minhash-near")
    texts = stored(texts_of(docs, nodes.join(sized.select("node"), "node")), "minhash-texts")
    edges = tile_links(sized.filter(F.col("size") <= LARGE).select(F.col("component").alias("grp"), "node", "size"), texts, percent)
    large = sized.filter(F.col("size") > LARGE).select("node")
    if large.take(1):
        by_pivot, left = _large_groups(stored(buckets.join(large, "node"), "minhash-large"), texts, percent)
        edges = edges.unionByName(by_pivot).unionByName(tile_links(left, texts, percent))
    return stored(edges, "minhash-edges")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row ``doc_id, text_id, n_shingles, component_id, kept``, and ``class_id``, the smallest id with the same set."""
    sketch = stored(sketches(docs, bands_for(percent)), "minhash-sketches")
    classes = sketch.filter("set_id is not null and doc_id is not null").groupBy("set_id").agg(
        F.min(F.struct("doc_id", "text_id")).alias("least"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("marks").alias("marks"))
    nodes = stored(classes.select("set_id", F.monotonically_increasing_id().alias("node"), "least.doc_id", "least.text_id", "n", "bands", "marks"), "minhash-nodes")
    found = components(links(docs, nodes, percent)).withColumnRenamed("node", "of")
    member = nodes.select("set_id", "node", F.struct("doc_id", "text_id").alias("least")).join(found, F.col("node") == F.col("of"), "left")
    member = stored(member.select("set_id", "least", F.coalesce("component", "node").alias("component")), "minhash-members")
    heads = member.groupBy(F.col("component").alias("c")).agg(F.min("least").alias("head"))
    named = member.join(heads, F.col("component") == F.col("c")).select(F.col("set_id").alias("s"), F.col("least.doc_id").alias("class_id"), "head")
    component = F.coalesce("head.doc_id", "doc_id")
    own = F.col("doc_id").eqNullSafe(component) & F.coalesce(F.col("text_id") == F.col("head.text_id"), F.lit(True))
    return (sketch.drop("bands", "marks").join(named, F.col("set_id") == F.col("s"), "left")
            .select("doc_id", "text_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), own.alias("kept"), "class_id"))
