"""Fill-in-the-middle by displacement scatter.

A text is cut into tokens, a run of white space with the word after it (or the white space at the end), and two cuts part it into prefix,
middle and suffix. All texts of a batch lie in one byte array. The cuts are found there by one scan; at each cut a difference array holds
by how much the shift from input to output changes, its running sum gives every byte its shift, and one scatter writes all outputs. The
way back finds the markers in the output, builds the running sum from their places alone, and gathers the bytes.

A text stays plain where it is empty or null, holds a marker, or its id draws so. Cuts, forms and draws depend on id and text only, so
repeated rows get equal results and ties don't arise. A null id draws as the text ``null``. Texts of any length are cut whole: a batch is
worked in slices of about ``SLICE`` bytes, a longer text alone. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.llm.base import release, text_or_empty

SEED, RATE, SPM = 42, 50, 80                       # per cent of texts cut, and of those in suffix-first form
PLAIN, PSM, SPM_FORM = "plain", "psm", "spm"
SLICE = 4 << 20
PRE, SUF, MID = (np.frombuffer(m, np.uint8) for m in (b"<P>", b"<S>", b"<M>"))
MARK = 3                                           # bytes of a marker


def draws(seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers of a document: the first groups of the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, bytes, and borders of runs of rows of about ``limit`` bytes. The column is binary and holds no nulls."""
    borders = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(borders, borders[first] + limit, "right")) - 1)
        yield first, last, data[borders[first]:borders[last]], borders[first:last + 1] - borders[first]
        first = last


def words_end(data: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Places after the last byte of every word; words don't cross borders of texts."""
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = borders[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    last[inner - 1] = word[inner - 1]
    return np.flatnonzero(last) + 1


def markers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and letters of the markers."""
    if len(data) < MARK:
        return np.empty(0, np.int64), np.empty(0, np.uint8)
    mid = data[1:-1]
    at = np.flatnonzero((data[:-2] == PRE[0]) & (data[2:] == PRE[2]) & ((mid == PRE[1]) | (mid == SUF[1]) | (mid == MID[1])))
    return at, data[at + 1]


def shifts(n: int, places: list[np.ndarray], values: list[np.ndarray]) -> np.ndarray:
    """Shift per byte: running sum of a difference array. ``values`` of the k-th ``places`` hold from there to the (k+1)-th, text by text."""
    change, before = np.zeros(n + 1, np.int64), np.concatenate([[0], values[-1][:-1]])
    for at, value in zip(places, values):
        np.add.at(change, at, value - before)
        before = value
    return np.cumsum(change[:n])


def put(out: np.ndarray, at: np.ndarray, marker: np.ndarray) -> None:
    out[at[:, None] + np.arange(MARK)] = marker


def scatter(data: np.ndarray, borders: np.ndarray, h: list[np.ndarray], rate: int = RATE, spm: int = SPM):
    """``n, form, prefix_chars, middle_chars`` per text, and bytes and borders of the outputs."""
    start, end = borders[:-1], borders[1:]
    stops = words_end(data, borders)
    first, last = np.searchsorted(stops, start, "right"), np.searchsorted(stops, end, "right")
    words = last - first
    tail = np.where(words > 0, stops[np.maximum(last - 1, 0)] if len(stops) else 0, start) < end      # white space after the last word
    n = words + tail
    places, _ = markers(data)
    # a marker of three bytes lies in a text when it begins and ends there
    owner = np.searchsorted(borders, places, "right") - 1
    marked = np.zeros(len(n), bool)
    marked[owner[places + MARK <= borders[owner + 1]]] = True
    plain = (end == start) | marked | (h[2] % 100 >= rate)
    suffix_first = ~plain & (h[3] % 100 < spm)

    def cut(units: np.ndarray) -> np.ndarray:
        at = np.minimum(first + units, last) - 1
        return np.where(units > words, end, np.where(units > 0, stops[np.maximum(at, 0)] if len(stops) else start, start))

    a, b = h[0] % (n + 1), h[1] % (n + 1)
    p, m = np.where(plain, end, cut(np.minimum(a, b))), np.where(plain, end, cut(np.maximum(a, b)))
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])                                    # code points before a byte
    sizes = end - start + np.where(plain, 0, 3 * MARK)
    new = np.concatenate([[0], np.cumsum(sizes)])
    o = new[:-1]
    head, tail_size = p - start, end - m
    to_prefix = np.where(plain, o, np.where(suffix_first, o + 2 * MARK + tail_size, o + MARK))
    to_suffix = np.where(suffix_first, o + MARK, o + 2 * MARK + head)
    to_middle = o + 3 * MARK + head + tail_size
    place = np.arange(len(data)) + shifts(len(data), [start, p, m], [to_prefix - start, to_middle - p, to_suffix - m])
    out = np.empty(new[-1], np.uint8)
    out[place] = data
    cutting = ~plain
    put(out, (to_prefix - MARK)[cutting], PRE)
    put(out, (to_suffix - MARK)[cutting], SUF)
    put(out, (to_middle - MARK)[cutting], MID)
    form = np.where(plain, PLAIN, np.where(suffix_first, SPM_FORM, PSM))
    return n, form, lead[p] - lead[start], lead[m] - lead[p], out, new


def gather(out: np.ndarray, borders: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and borders of the texts, from outputs and forms alone."""
    o, end = borders[:-1], borders[1:]
    cutting, suffix_first = form != PLAIN, form == SPM_FORM
    at, letter = markers(out)
    owner = np.searchsorted(borders, at, "right") - 1
    use = cutting[owner] & (at + MARK <= end[owner])
    at, letter, owner = at[use], letter[use], owner[use]

    def of(marker: np.ndarray) -> np.ndarray:
        found = o.copy()
        found[owner[letter == marker[1]]] = at[letter == marker[1]]
        return found

    pre, suf, mid = of(PRE), of(SUF), of(MID)
    head = np.where(cutting, np.where(suffix_first, mid, suf) - pre - MARK, end - o)
    last = np.where(cutting, np.where(suffix_first, pre, mid) - suf - MARK, 0)
    new = np.concatenate([[0], np.cumsum(end - o - np.where(cutting, 3 * MARK, 0))])
    start, stop = new[:-1], new[1:]
    p, m = start + head, stop - last
    place = np.arange(new[-1]) + shifts(int(new[-1]), [start, p, m], [np.where(cutting, pre + MARK, o) - start, mid + MARK - p, suf + MARK - m])
    return out[place], new


def _column(data: np.ndarray, borders: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(borders) - 1, [None, pa.py_buffer(borders.astype(np.int64)), pa.py_buffer(data)])


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` per document; a map over the rows, no shuffle."""
    rows = docs.select("doc_id", text_or_empty().cast("binary").alias("text"), *[h.alias(f"h{i}") for i, h in enumerate(draws(seed))])
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            h = [np.asarray(batch.column(f"h{i}")) for i in range(4)]
            for first, last, data, borders in slices(batch.column("text")):
                n, form, head, middle, out, new = scatter(data, borders, [x[first:last] for x in h], rate, spm)
                none = form == PLAIN
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()),
                     pa.array(head, pa.int64(), mask=none), pa.array(middle, pa.int64(), mask=none), _column(out, new).cast(pa.binary())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
        release()

    return rows.mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary").withColumn("output", F.col("output").cast("string"))


def restore(cut: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in ``keep`` and ``restored``, the text rebuilt from ``output`` and ``form``."""
    rows = cut.select(*keep, F.col("output").cast("binary").alias("_output"), F.col("form").alias("_form"))
    from pyspark.sql import types as T

    shape = T.StructType([f for f in rows.schema if f.name not in ("_output", "_form")] + [T.StructField("restored", T.BinaryType())])

    def run(batches):
        for batch in batches:
            form = np.array(batch.column("_form").to_pylist(), dtype=object)
            for first, last, data, borders in slices(batch.column("_output")):
                text, new = gather(data, borders, form[first:last])
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(first, last - first) for c in keep], _column(text, new).cast(pa.binary())], names=[*keep, "restored"])
        release()

    return rows.mapInArrow(run, shape).withColumn("restored", F.col("restored").cast("string"))
