"""Substring dedup on a De Bruijn graph of word k-mers.

An edge is a window of ``WINDOW`` consecutive words, from the node of its first WINDOW - 1 words to the node of its last ones; both
nodes' 64-bit hashes name the edge. Only windows that can repeat become edges: each window is represented by its smallest run of
``ANCHOR`` words (equal windows have equal ones), and anchors that occur in one text only are left out. Documents with the same words
are handled as wholes: the smallest id stands for all of them.

Per edge Spark keeps its first occurrence (smallest id, first place). A node where every arriving edge goes on and every leaving one
comes from there, one of each, is passed through; edges joined by such nodes have the same occurrences, so a nonbranching path is
a stretch of neighbouring places of one document and compacts by one join of edges with nodes and one pass over each
document's places. Occurrences then meet paths by the path's first edge. Every span is verified at its source coordinates: the digest of its
words must be that of the words at the path's first occurrence.

A word is removed when a verified span of a document with a smaller id covers it; spans are found on the input. Null texts have no words.
Rows with null id neither remove nor lose words. Rows that repeat an id never remove from each other; each is handled by its own text.
Other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnstone.llm.base import stored, text_or_empty

WINDOW, ANCHOR = 50, 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, np.uint64(b))
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def runs_of(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n word hashes."""
    up, down = _powers(len(h))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * down, dtype=np.uint64)])
    x = (sums[n:] - sums[:-n]) * up[:len(h) - n + 1]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def anchor_places(h: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Per window the place of its anchor; hashes of all anchor-sized runs."""
    grams = runs_of(h, anchor)
    width = window - anchor + 1
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    places = np.concatenate([view[i:i + 4096].argmin(axis=1) for i in range(0, len(view), 4096)]) + np.arange(len(view))
    return places, grams


def split(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()          # bytes split at [\x20\x09-\x0D] only


def sha(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def whole_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, whole``: number of words and digest of all of them."""
    def run(batches):
        for batch in batches:
            sizes, digests = [], []
            for text in batch.column("text"):                  # one text's words at a time
                words = split(text.as_py())
                sizes.append(len(words)), digests.append(sha(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())], names=["doc_id", "n_words", "whole"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {_id_type(docs)}, n_words bigint, whole binary")


def anchors(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``anchor, text_key, doc_id, place`` of each anchor of each document; ``text_key`` is a hash of all words."""
    def run(batches):
        for batch in batches:
            row, key, found, at = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                words = split(text.as_py())
                if len(words) < window:
                    continue
                places, grams = anchor_places(word_hashes(words), window, anchor)
                places = np.unique(places)
                row.append(np.full(len(places), i)), found.append(grams[places]), at.append(places)
                key.append(np.full(len(places), int.from_bytes(sha(words)[:8], "little", signed=True), np.int64))
            join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array(join(found, np.uint64).view(np.int64)), pa.array(join(key, np.int64)), batch.column("doc_id").take(pa.array(join(row, np.int64))),
                 pa.array(join(at, np.int64).astype(np.int32))], names=["anchor", "text_key", "doc_id", "place"])

    rows = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    return rows.mapInArrow(run, f"anchor bigint, text_key bigint, doc_id {_id_type(docs)}, place int")


def candidates(docs: DataFrame, wholes: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id, small, places``: compressed texts that share anchors with another text, and where; one row for equal texts."""
    found = stored(anchors(docs, window, anchor), "substring-anchors")
    shared = found.groupBy("anchor").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high")).filter("low <> high").select("anchor")
    places = found.join(shared, "anchor").groupBy("doc_id", "text_key").agg(F.collect_set("place").alias("places"))      # one document's places
    least = wholes.filter("doc_id is not null").groupBy("whole").agg(F.min("doc_id").alias("doc_id"))
    places = places.join(least.select("doc_id", F.col("whole").alias("of")), "doc_id").drop("text_key")

    def squeeze(batches):
        import zstandard

        tool = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            digests, small = [], []
            for text in batch.column("text"):
                data = text.as_py()
                digests.append(sha(split(data))), small.append(tool.compress(data.encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(small, pa.binary())], names=["id", "whole", "small"])

    texts = docs.select("doc_id", "text").filter("doc_id is not null and text is not null").mapInArrow(squeeze, f"id {_id_type(docs)}, whole binary, small binary")
    met = texts.join(places, (F.col("id") == F.col("doc_id")) & (F.col("whole") == F.col("of")))
    return met.select("doc_id", "whole", "small", "places").dropDuplicates(["doc_id", "whole"])


def edges(texts: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``left, right, doc_id, place, first, last``: windows whose anchor is shared; whether the window before or after is no edge."""
    def run(batches):
        import zstandard

        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                h = word_hashes(tool.decompress(batch.column("small")[i].as_py()).split())
                anchor_at, _ = anchor_places(h, window, anchor)
                shared = np.zeros(len(h), bool)
                shared[np.array(batch.column("places")[i].as_py(), dtype=np.int64)] = True
                use = shared[anchor_at]
                nodes = runs_of(h, window - 1).view(np.int64)
                at = np.flatnonzero(use)
                before, after = np.r_[False, use[:-1]][at], np.r_[use[1:], False][at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[at]), pa.array(nodes[at + 1]), batch.column("doc_id").take(pa.array(np.full(len(at), i))), pa.array(at.astype(np.int32)),
                     pa.array(~before), pa.array(~after)], names=["left", "right", "doc_id", "place", "first", "last"])

    return texts.select("doc_id", "small", "places").mapInArrow(run, f"left bigint, right bigint, doc_id {_id_type(texts)}, place int, first boolean, last boolean")


def paths(found: DataFrame) -> DataFrame:
    """``left, right, source_id, source_place, n_edges`` per nonbranching path of repeated edges; named by its first edge."""
    each = stored(found.groupBy("left", "right").agg(F.min(F.struct("doc_id", "place")).alias("at"), F.max("doc_id").alias("top"),
                                                     F.max("first").alias("first"), F.max("last").alias("last")), "substring-edges")
    arriving = each.select(F.col("right").alias("node"), F.lit(1).alias("came"), F.lit(0).alias("went"), F.col("last").alias("ends"))
    leaving = each.select(F.col("left").alias("node"), F.lit(0).alias("came"), F.lit(1).alias("went"), F.col("first").alias("ends"))
    through = (arriving.unionByName(leaving).groupBy("node").agg(F.sum("came").alias("came"), F.sum("went").alias("went"), F.max("ends").alias("ends"))
               .filter("came = 1 and went = 1 and not ends").select(F.col("node").alias("left"), F.lit(True).alias("goes_on")))
    repeated = each.filter("at.doc_id < top").select("left", "right", F.col("at.doc_id").alias("source_id"), F.col("at.place").alias("source_place"))
    named = repeated.join(through, "left", "left").withColumn("head", F.col("goes_on").isNull())
    along = W.partitionBy("source_id").orderBy("source_place")                   # one document's places
    ranked = named.withColumn("path", F.sum(F.col("head").cast("long")).over(along.rowsBetween(W.unboundedPreceding, 0)))
    return ranked.groupBy("source_id", "path").agg(F.min(F.struct("source_place", "left", "right")).alias("h"), F.count("*").cast("int").alias("n_edges")).select(
        "h.left", "h.right", "source_id", F.col("h.source_place").alias("source_place"), "n_edges")


def _digests(words: list[bytes], places: list, counts: list, window: int) -> list[bytes]:
    return [hashlib.blake2b(b" ".join(words[p:p + n + window - 1]), digest_size=16).digest() for p, n in zip(places, counts)]


def spans(texts: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id, place, n_edges, digest, source_id, source_place``: repeats of paths in documents after the first, not yet verified."""
    all_edges = edges(texts, window, anchor)
    found = stored(paths(all_edges), "substring-paths")
    by_source = found.groupBy("source_id").agg(F.collect_list(F.struct("left", "right", "source_place", "n_edges")).alias("p"))

    def run(batches):
        import zstandard

        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                p = batch.column("p")[i].as_py()
                words = tool.decompress(batch.column("small")[i].as_py()).split()
                places, counts = [x["source_place"] for x in p], [x["n_edges"] for x in p]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["left"] for x in p], pa.int64()), pa.array([x["right"] for x in p], pa.int64()), batch.column("doc_id").take(pa.array([i] * len(p), pa.int64())),
                     pa.array(places, pa.int32()), pa.array(counts, pa.int32()), pa.array(_digests(words, places, counts, window), pa.binary())],
                    names=["left", "right", "source_id", "source_place", "n_edges", "digest"])

    named = texts.select("doc_id", "small").join(by_source, F.col("doc_id") == F.col("source_id")).select("doc_id", "small", "p")
    known = named.mapInArrow(run, f"left bigint, right bigint, source_id {_id_type(texts)}, source_place int, n_edges int, digest binary")
    return all_edges.select("left", "right", "doc_id", "place").join(known, ["left", "right"]).filter("doc_id > source_id").drop("left", "right")


def verified(texts: DataFrame, found: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, whole, starts, ends, n_removed, kept``: per document its verified spans as disjoint stretches of words, and the digest of the rest."""
    by_doc = found.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("place", "n_edges", "digest")).alias("spans"))

    def run(batches):
        import zstandard

        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            starts, ends, removed, kept = [], [], [], []
            for i in range(batch.num_rows):
                words = tool.decompress(batch.column("small")[i].as_py()).split()
                s = batch.column("spans")[i].as_py()
                now = _digests(words, [x["place"] for x in s], [x["n_edges"] for x in s], window)
                gone = np.zeros(len(words) + 2, np.int64)
                for x, digest in zip(s, now):
                    if digest == x["digest"]:
                        gone[x["place"] + 1] += 1
                        gone[x["place"] + x["n_edges"] + window] -= 1
                mask = np.cumsum(gone) > 0                   # shifted by one: starts with False, ends with False
                turns = np.flatnonzero(mask[1:] != mask[:-1])
                starts.append(turns[::2]), ends.append(turns[1::2]), removed.append(int(mask.sum()))
                kept.append(sha([w for w, m in zip(words, mask[1:]) if not m]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("whole"), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())),
                 pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "whole", "starts", "ends", "n_removed", "kept"])

    met = texts.select("doc_id", "whole", "small").join(by_doc, F.col("doc_id") == F.col("id")).select("doc_id", "whole", "small", "spans")
    return met.mapInArrow(run, f"doc_id {_id_type(texts)}, whole binary, starts array<bigint>, ends array<bigint>, n_removed bigint, kept binary")


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Per row ``doc_id, n_words, n_removed, kept_sha256`` and the removed stretches ``starts, ends`` (word numbers, end excluded)."""
    wholes = stored(whole_texts(docs), "substring-wholes")
    texts = stored(candidates(docs, wholes, window, anchor), "substring-texts")
    cut = stored(verified(texts, spans(texts, window, anchor), window), "substring-cut")
    least = wholes.filter("doc_id is not null").groupBy("whole").agg(F.min("doc_id").alias("least")).withColumnRenamed("whole", "w")
    rows = wholes.join(least, F.col("whole") == F.col("w"), "left").join(cut.withColumnsRenamed({"doc_id": "id", "whole": "of"}), (F.col("doc_id") == F.col("id")) & (F.col("whole") == F.col("of")), "left")
    copy = (F.col("doc_id") > F.col("least")) & (F.col("n_words") >= window)
    kept = F.when(copy, F.unhex(F.sha2(F.lit(""), 256))).otherwise(F.coalesce("kept", "whole"))
    return rows.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"), F.lower(F.hex(kept)).alias("kept_sha256"),
        F.when(copy, F.array(F.lit(0).cast("long"))).otherwise(F.col("starts")).alias("starts"), F.when(copy, F.array("n_words")).otherwise(F.col("ends")).alias("ends"))
