"""Exact dedup with an extendible-hash index on shared files (columns and SQL functions only).

Every text is normalised (all ``[\\x20\\x09-\\x0D]`` deleted). The 64-bit hash of the result is the pseudo-key. The directory looks at the
first g bits of the pseudo-keys in use: a cell with more than ``capacity`` of them makes the directory double (g + 1) until no cell is
overfull; cells that were not overfull keep their smaller local depth and share one bucket. Contiguous buckets belong to an owner, a
range of keys with about ``owner_rows`` of them.

Rows are routed through the directory. Within a bucket rows with one pseudo-key form a chain, and each member of the chain is one text,
told apart by all its bytes; a member carries its number of rows and the row that stays. Members are formed before and after the
shuffle, so a thousand copies reach the owner as one row per task that read them. The owners write their chains in key order to
the shared folder (the index), and every row looks its member up there. ``probe`` does the same for another batch of documents without building the index again.
Members with more than a ten-thousandth of all rows (fewer than 10,000) are looked up by broadcast, so a group with a third of all rows needs no task
of its own. If different texts share digest and length, which the grouping by bytes notices, rows look their member up by whole texts.

Null texts count as empty, empty texts are equal to each other. Null ids sort after all others. Rows that repeat id and text are
members of one group; exactly one row of a group is kept. Texts of any length are
compared whole. Other columns of the input are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnstone.llm.base import SPACES, partitions, stored, text_or_empty

CAPACITY = 4096           # pseudo-keys in a bucket
OWNER_ROWS = 1_000_000    # pseudo-keys of an owner task
SMALL = 500_000           # directory cells up to which the directory is sent to every task


def normalised():
    return F.translate(text_or_empty(), SPACES, "")


def entries(docs: DataFrame, key=F.xxhash64, digest=lambda text: F.unhex(F.sha2(text, 256))) -> DataFrame:
    """One row per document, written once: id, length, digest, pseudo-key and text; ``row_no`` tells repeated rows apart. Later steps read the columns they need."""
    clean = docs.select("doc_id", F.char_length(text_or_empty()).cast("long").alias("points"), normalised().alias("clean"))
    rows = clean.select("doc_id", "points", F.octet_length("clean").cast("long").alias("octets"), digest(F.col("clean")).alias("digest"),
                        key(F.col("clean")).alias("pseudo_key"), F.monotonically_increasing_id().alias("row_no"), "clean")
    return stored(rows, "dedup-entries")


def cell(bits: int):
    """The first ``bits`` bits of the pseudo-key."""
    return F.lit(0).cast("long") if bits == 0 else F.shiftrightunsigned("pseudo_key", 64 - bits)


def directory(keys: DataFrame, capacity: int = CAPACITY, owner_rows: int = OWNER_ROWS) -> tuple[int, DataFrame]:
    """Global depth, and per cell its bucket, the bucket's local depth and its owner.

    ``keys``: the different pseudo-keys. The driver sees one number per doubling, the largest cell. The directory has about keys / capacity cells.
    """
    total = keys.count()
    first = depth = max(0, math.ceil(math.log2(max(1, total / capacity))))
    while depth < 64:           # different keys differ in 64 bits
        fullest = keys.groupBy(cell(depth).alias("cell")).count().agg(F.max("count")).first()[0] or 0
        if fullest <= capacity:
            break
        depth += 1
    cells = keys.groupBy(cell(depth).alias("cell")).agg(F.count("*").alias("n"))
    local = F.lit(depth)
    for bits in range(depth - 1, first - 1, -1):      # the shallowest depth at which the cell still fits
        prefix = F.shiftrightunsigned("cell", depth - bits)
        cells = cells.withColumn("fits", F.sum("n").over(W.partitionBy(prefix)) <= capacity)
        local = F.when(F.col("fits"), F.lit(bits)).otherwise(local)
        cells = cells.withColumn("local_depth", local).drop("fits")
        local = F.col("local_depth")
    if "local_depth" not in cells.columns:
        cells = cells.withColumn("local_depth", local)
    bucket = F.expr(f"shiftleft(shiftrightunsigned(cell, {depth} - local_depth), {depth} - local_depth)")
    step = max(1, owner_rows // capacity)             # neighbouring cells of an owner
    return depth, cells.select("cell", bucket.alias("bucket"), "local_depth", F.floor(F.col("cell") / step).alias("owner"), "n")


@dataclass
class Index:
    """Directory and chains on shared files: ``cells`` (cell, bucket, local_depth, owner), ``members`` (one per text), and the columns that find a member."""

    depth: int
    cells: DataFrame
    members: DataFrame
    rows: int
    finds: list[str]


def route(rows: DataFrame, depth: int, cells: DataFrame) -> DataFrame:
    """Adds owner, bucket and local depth by a look into the directory."""
    cells = cells.select(F.col("cell").alias("of_cell"), "bucket", "local_depth", "owner")
    if cells.count() <= SMALL:
        cells = F.broadcast(cells)
    return rows.join(cells, cell(depth) == F.col("of_cell")).drop("of_cell")


def chains(routed: DataFrame) -> DataFrame:
    """One member per different text, its bytes compared by the grouping: rows, and the row that stays (most code points, then smallest id)."""
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row_no")))
    found = routed.groupBy("pseudo_key", "digest", "octets", "clean", "owner", "bucket", "local_depth").agg(F.count("*").alias("group_size"), best.alias("best"))
    return found.select("owner", "bucket", "local_depth", "pseudo_key", "digest", "octets", "clean", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row_no").alias("keep_row"))


def build_index(rows: DataFrame, capacity: int = CAPACITY, owner_rows: int = OWNER_ROWS) -> Index:
    """The index files: owners hold key ranges, in them buckets, in them chains of texts with one pseudo-key."""
    keys = stored(rows.select("pseudo_key").distinct(), "dedup-keys")
    depth, cells = directory(keys, capacity, owner_rows)
    cells = stored(cells, "dedup-directory")
    routed = route(rows, depth, cells)
    members, finds = stored(chains(routed).drop("clean"), "dedup-members"), ["bucket", "pseudo_key", "digest", "octets"]
    if not members.groupBy(*finds).count().filter("count > 1").isEmpty():       # different texts with one digest and length
        members, finds = stored(chains(routed), "dedup-members"), ["bucket", "pseudo_key", "clean"]
    chain = W.partitionBy("owner", "bucket", "pseudo_key").orderBy("digest", "octets", "keep_row")
    placed = (members.repartition(partitions(rows.sparkSession), "owner", "bucket", "pseudo_key").withColumn("chain_place", F.row_number().over(chain))
              .sortWithinPartitions("owner", "bucket", "pseudo_key"))
    return Index(depth, cells, stored(placed, "dedup-index"), rows.count(), finds)


def probe(rows: DataFrame, index: Index) -> DataFrame:
    """The rows (of ``entries``, of the indexed table or another) with ``keep_id, keep_row, group_size, chain_place`` of their text's member; null where the index lacks the text."""
    routed = rows.withColumn("at", cell(index.depth))
    members = index.members.select(*[F.col(c).alias(f"m_{c}") for c in index.finds], "owner", "keep_id", "keep_row", "group_size", "chain_place")
    cells = index.cells.select(F.col("cell").alias("of_cell"), "bucket")
    if cells.count() <= SMALL:
        cells = F.broadcast(cells)
    routed = routed.join(cells, F.col("at") == F.col("of_cell"), "left").drop("at", "of_cell")
    on = [F.col(c) == F.col(f"m_{c}") for c in index.finds]
    often = max(1, index.rows // 10_000)
    hot, cold = F.broadcast(members.filter(F.col("group_size") > often)), members.filter(F.col("group_size") <= often)
    met = routed.join(hot, on).unionByName(routed.join(hot, on, "left_anti").join(cold, on, "left"))
    return met.drop(*[f"m_{c}" for c in index.finds])


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY, owner_rows: int = OWNER_ROWS, **hashes) -> DataFrame:
    """Per row: ``doc_id, keep_id, group_size, kept, text_sha256`` and where the index holds its text (``owner, bucket, chain_place``). ``hashes``: see ``entries``."""
    rows = entries(docs, **hashes)
    found = probe(rows, build_index(rows, capacity, owner_rows))
    return found.select("doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"),
                        F.lower(F.hex("digest")).alias("text_sha256"), "owner", "bucket", "chain_place")
