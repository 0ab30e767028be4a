"""Target-distribution importance resampling over hashed n-grams, hashed by prefix CRCs.

A text's letters A-Z are lowered and everything that is no digit, letter a-z or character beyond ASCII separates words. The words joined
by one space are scanned once, keeping the running CRC-32 after every word. The CRC of a run of words follows from two of these: the
running CRC at its end, less the one at its start moved on by the run's length (a linear map over GF(2), applied as byte tables for
powers of two), because zeros appended to a prefix cancel it. So n-grams of any order cost no further scan of the text.

A feature's bucket is its CRC modulo ``BUCKETS``. A bucket's gain is the floored logarithm of its smoothed share in the target over that in
the corpus; a document's weight is the floored mean of its features' gains; score is weight plus Gumbel noise drawn from the id, and the
highest scores among documents with enough words are the sample. Counts run over all features of all documents; the driver holds one count
per bucket, a number that does not grow. Ranks come from counts per score, so no task sorts the table.

Null and empty texts and texts without words have no features and weight 0. A null id draws as the text ``null`` and goes last among equal
scores; repeated rows get equal scores and different ranks. Long texts are read whole, in runs of words. Empty tables: no documents give
no rows, an empty target counts nothing. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.llm.base import numbered, release, stored, text_or_empty

BUCKETS, ORDER, LEAST_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7
RUN = 1 << 16
_WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_PIECE = re.compile(rb" ?[^ ]+")
_SPACE = zlib.crc32(b" ")


@lru_cache(maxsize=64)
def zeros(power: int) -> np.ndarray:
    """Tables by which 2**power zero bytes act on a CRC, one of 256 values for each of its four bytes."""
    if power:
        half = zeros(power - 1)
        images = [_apply(half, _apply(half, np.array([1 << i], np.uint32)))[0] for i in range(32)]
    else:
        byte = [zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)]         # the register's step, without its inversions
        images = [np.uint32(byte[v & 255] ^ (v >> 8)) for v in (1 << i for i in range(32))]
    out = np.zeros((4, 256), np.uint32)
    for j in range(4):
        for i in range(8):
            out[j, np.arange(256) >> i & 1 == 1] ^= images[8 * j + i]
    return out


def _apply(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    return tables[0][c & 255] ^ tables[1][c >> 8 & 255] ^ tables[2][c >> 16 & 255] ^ tables[3][c >> 24]


def moved(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each CRC after ``length`` further zero bytes."""
    out, power = crc.copy(), 0
    most = int(length.max(initial=0))
    while most >> power:
        use = np.flatnonzero(length >> power & 1)
        out[use] = _apply(zeros(power), out[use])
        power += 1
    return out


def running(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The running CRC after each word of the normalised text, and the words' lengths."""
    line = b" ".join(text.translate(_WORDS).split())
    pieces, ends, sizes, last = (m[0] for m in _PIECE.finditer(line)), [], [], 0
    while part := list(islice(pieces, RUN)):
        found = np.fromiter(accumulate(part, lambda c, p: zlib.crc32(p, c), initial=last), np.uint32, len(part) + 1)[1:]
        ends.append(found), sizes.append(np.fromiter(map(len, part), np.int64, len(part)))
        last = int(found[-1])
    if not ends:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    size = np.concatenate(sizes)
    size[1:] -= 1                                                                            # the space before
    return np.concatenate(ends), size


def ngram_crcs(ends: np.ndarray, sizes: np.ndarray, first: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """CRCs of all runs of 1 to ``order`` words, and the text of each. ``first`` gives for each word the place of its text's first word."""
    begins = np.zeros(len(ends), np.uint32)
    later = np.flatnonzero(np.arange(len(ends)) > first)
    begins[later] = moved(ends[later - 1], np.ones(len(later), np.int64)) ^ np.uint32(_SPACE)
    total = np.concatenate([[0], np.cumsum(sizes + 1)])
    out, owner = [], []
    for n in range(1, order + 1):
        i = np.arange(max(0, len(ends) - n + 1))
        i = i[first[i] == first[i + n - 1]]
        out.append(ends[i + n - 1] ^ moved(begins[i], total[i + n] - total[i] - 1))
        owner.append(first[i])
    return np.concatenate(out), np.concatenate(owner)


def features(docs: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_words, n_features, buckets``: the buckets as little-endian 32-bit numbers, repeats included."""
    rows = docs.select("doc_id" if "doc_id" in docs.columns else F.lit(None).cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            first = 0
            while first < batch.num_rows:
                found, room, last = [], 1 << 20, first
                while last < batch.num_rows and (room > 0 or last == first):
                    found.append(running(batch.column("text")[last].as_py()))
                    room -= len(found[-1][0])
                    last += 1
                words = np.array([len(e) for e, _ in found], np.int64)
                at = np.cumsum(words) - words
                crc, owner = ngram_crcs(np.concatenate([e for e, _ in found]), np.concatenate([s for _, s in found]), np.repeat(at, words), order)
                order_of = np.argsort(owner, kind="stable")
                n = sum(np.maximum(words - k, 0) for k in range(order))
                data = (crc[order_of] % np.uint32(buckets)).astype("<u4")
                borders = np.concatenate([[0], np.cumsum(4 * n)])
                column = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(borders), pa.py_buffer(data)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), pa.array(words), pa.array(n, pa.int64()), column], names=["doc_id", "n_words", "n_features", "buckets"])
                first = last
        release()

    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, buckets binary")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows. A task counts its rows; the driver gets one row per bucket."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for row in batch.column("buckets"):
                total += np.bincount(np.frombuffer(row.as_buffer(), "<u4"), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("buckets").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket: floor of a thousand times the logarithm of the smoothed shares' ratio."""
    k, all_c, all_t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.floor(1000 * np.log((target + 1.0) * (all_c + k) / ((corpus + 1.0) * (all_t + k)))).astype(np.int64)


def weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight``."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n, total = np.asarray(batch.column("n_features")), np.zeros(batch.num_rows, np.int64)
            for i, row in enumerate(batch.column("buckets")):
                total[i] = gain[np.frombuffer(row.as_buffer(), "<u4")].sum()
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), batch.column("n_features"), pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])
        release()

    return found.select("doc_id", "n_words", "n_features", "buckets").mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(seed: int = SEED) -> Column:
    """A thousand times standard Gumbel noise of the id, floored."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank``; rank is null outside the sample. ``target`` needs a column ``text`` only."""
    found = stored(features(docs, order, buckets), "resample-features")
    gain = gains(bucket_counts(found, buckets), bucket_counts(features(target.select("text"), order, buckets), buckets))
    scored = stored(weights(found, gain).withColumn("score", F.col("weight") + noise(seed)), "resample-scores")
    fit, small = scored.filter(F.col("n_words") >= least), scored.filter(F.col("n_words") < least)
    drawn = percent * fit.count() // 100
    placed = numbered(fit, [], [F.col("doc_id").asc_nulls_last()], "place", -F.col("score"), per_group_start=1)       # a block per score: the noise spreads them
    placed = placed.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return placed.select(*columns).unionByName(small.withColumn("rank", F.lit(None).cast("long")).select(*columns))
