"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, compared window by window.

A window is one word of the text, in lower case, between its separators; words over 64 characters are cut into windows of 64. Every
character is spelled as four bytes, so that a character which no dictionary explains costs more than the rounding of a compressed
length to whole bytes, and a fixed carrier that both dictionaries hold stands before the window, so that it is never stored raw.

The ordinary dictionary is made of the windows of ordinary text. Of the toxic text those windows are used that a dictionary of *other* toxic
documents shortens by at least ``GAIN`` bytes against the ordinary one, so what toxic documents share and ordinary text lacks, be it
whole words or runs inside words that then need one match less. zstandard trains the toxic dictionary on them (``SHARE`` of their bytes, in
segments long enough to hold several words); it is placed behind the ordinary one, so that common words cost the same under both. A
window's distance is its compressed length with the ordinary dictionary less that with the toxic one. A worker remembers the distances of
the first ``CACHE`` different windows it meets, over all its tasks. A document's shares of windows
over several thresholds, and whether there are any, go through a logistic curve that is calibrated on labelled documents kept out of the
dictionaries, with the intercept moved to the share of label 1 among all labels used.

Fitting uses at most ``SAMPLE`` labelled documents of each label, the first by md5 of the id, and of longer texts the middle ``FIT_CHARS``
characters; the driver holds that sample. Scoring reads every whole text. Labels count when the id is not null and the label is 0 or 1; of repeated
labels of an id the largest counts. With no toxic or no ordinary label the score is the share of label 1 (0 without labels) for all.
Null and empty texts have no windows and get the lowest score. Repeated rows get equal scores; columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstone.llm import tokens
from turnstone.llm.base import release, text_or_empty

SAMPLE, FIT_CHARS = 4000, 10_000
ORDINARY_BYTES, TOXIC_BYTES, FOLD_BYTES = 3 << 19, 1 << 17, 2 << 20
SHARE, SEGMENT = 0.9, 1024
GAIN, LONGEST = 2, 64
LEVELS = (1, 2, 3, 4, 5, 6, 8)
CARRIER, SPACE = b"\x01window under two dictionaries\x02 ", zlib.crc32(b" ").to_bytes(4, "little")
CACHE = 400_000
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    intercept: float


class _Spelled(dict):
    def __missing__(self, ch: str) -> bytes:
        out = self[ch] = zlib.crc32(ch.encode("utf-8", "surrogatepass")).to_bytes(4, "little")
        return out


_SPELLED = _Spelled()


def spell(window: str) -> bytes:
    return b"".join(map(_SPELLED.__getitem__, window))


def windows(text: str) -> list[str]:
    words = text.lower().split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [w[i:i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]


class Lengths:
    """Compressed lengths of windows under one dictionary."""

    def __init__(self, content: bytes):
        import zstandard as z

        # tables large enough that the match finder reaches all of the dictionary
        params = z.ZstdCompressionParameters.from_level(
            3, strategy=z.STRATEGY_BTOPT, min_match=4, search_log=6, target_length=64, window_log=22, chain_log=22, hash_log=20,
            write_content_size=False, write_dict_id=False)
        data = z.ZstdCompressionDict(content + SPACE + CARRIER, dict_type=z.DICT_TYPE_RAWCONTENT)
        self.compress = z.ZstdCompressor(dict_data=data, compression_params=params).compress

    def __call__(self, window: str) -> int:
        return len(self.compress(CARRIER + SPACE + spell(window) + SPACE))


def dictionary(texts: list[str], size: int) -> bytes:
    """Dictionary of the texts' different windows, the commonest ones last, where matches are cheapest."""
    out, room = [], size
    for w, _ in sorted(Counter(w for t in texts for w in windows(t)).items(), key=lambda c: (-c[1], c[0])):
        out.append(SPACE + spell(w))
        room -= len(out[-1])
        if room <= 0:
            break
    return b"".join(reversed(out))[-size:]


def trained(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary that zstandard trains; text that is too little to train on is taken as it is."""
    import zstandard as z

    size = min(size, int(SHARE * sum(map(len, samples))))
    try:
        return z.train_dictionary(size, samples, k=SEGMENT, d=8).as_bytes()
    except z.ZstdError:
        return SPACE.join(samples)[:size]


def groups(spelled: list[str], n: int) -> list[bytes]:
    return [SPACE + SPACE.join(map(spell, spelled[i:i + n])) + SPACE for i in range(0, len(spelled), n)]


class Distance(dict):
    """Window to its distance; the first ``CACHE`` windows are remembered."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.plain, self.other = Lengths(ordinary), Lengths(ordinary + SPACE + toxic)

    def __missing__(self, window: str) -> int:
        out = self.plain(window) - self.other(window)
        if len(self) < CACHE:
            self[window] = out
        return out


@lru_cache(maxsize=1)
def distance_of(ordinary: bytes, toxic: bytes) -> Distance:
    """One per worker, kept between tasks: building the compressors takes as long as scoring thousands of windows."""
    return Distance(ordinary, toxic)


def features(text: str, distance: Distance) -> list[float]:
    found = np.fromiter(map(distance.__getitem__, windows(text)), dtype=np.int32)
    over = np.array([(found >= k).sum() for k in LEVELS], dtype=float)
    return [*np.minimum(1.0, 20 * over / max(1, len(found))), *np.log1p(over)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_texts(toxic: list[str], ordinary: list[str], share: float) -> Model:
    """``share``: of label 1 among all labels."""
    floor = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    none = Model(b"", b"", (0.0,) * (2 * len(LEVELS)), floor)
    if not toxic or not ordinary:
        return none
    fold, known = max(1, len(toxic) * 2 // 5), max(1, len(ordinary) * 3 // 5)
    first, second, rest = toxic[:fold], toxic[fold:2 * fold], toxic[2 * fold:] or toxic          # the rest calibrates
    base, check = ordinary[:known], ordinary[known:] or ordinary
    content = dictionary(base, ORDINARY_BYTES)
    plain, shared = Lengths(content), []
    for mine, others in ((first, second), (second, first)):
        other = Lengths(dictionary(others, FOLD_BYTES))
        shared += [w for w, n in sorted(Counter(w for t in mine for w in windows(t)).items()) if plain(w) - other(w) >= GAIN for _ in range(n)]
    np.random.default_rng(1).shuffle(shared)
    special = trained(groups(shared, 4), TOXIC_BYTES)
    distance = Distance(content, special)
    x = np.array([features(t, distance) for t in rest + check])
    y = np.array([1.0] * len(rest) + [0.0] * len(check))
    w = logistic(x, y)
    moved = float(w[-1]) + floor - float(np.log(len(rest) / len(check)))
    return Model(content, special, tuple(map(float, w[:-1])), moved)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from ``labels`` (``doc_id, toxic``); the driver collects at most ``sample`` texts of each label."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    texts = docs.select("doc_id", "text")
    found: dict[int, list[str]] = {}
    for label in (0, 1):
        chosen = known.filter(F.col("toxic") == label).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample).select("doc_id")
        size = F.char_length("text")
        middle = F.substring("text", F.greatest(F.lit(1), F.floor((size - FIT_CHARS) / 2).cast("int") + 1), F.lit(FIT_CHARS))
        rows = texts.join(F.broadcast(chosen), "doc_id").filter(size > 0).select(middle.alias("text")).distinct().collect()   # at most ``sample`` ids
        found[label] = sorted({r["text"] for r in rows}, key=lambda t: zlib.crc32(t.encode("utf-8", "surrogatepass")))
    return fit_texts(found[1], found[0], counts.get(1, 0) / max(1, sum(counts.values())))


def scorer(model: Model):
    """A function from texts to scores."""
    distance, weights = distance_of(model.ordinary, model.toxic), np.array(model.weights)

    def score(texts: Iterable[str]) -> np.ndarray:
        rows = []
        for text in texts:
            rows.append(features(text, distance) if weights.any() else [0.0] * len(weights))
        x = np.array(rows).reshape(-1, len(weights))
        return 1 / (1 + np.exp(-np.clip(x @ weights + model.intercept, -30, 30)))

    return score


def score_rows(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns in ``keep`` and ``tox_score``; a map over the rows, no shuffle."""
    rows = docs.select(*keep, text_or_empty().alias("_scored"))
    shape = T.StructType([f for f in rows.schema if f.name != "_scored"] + [T.StructField("tox_score", T.DoubleType())])

    def run(batches):
        tokens.forget()
        score = scorer(model)
        for batch in batches:
            out = pa.array(score(t.as_py() for t in batch.column("_scored")), pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], out], names=[*keep, "tox_score"])
        del score
        release()

    return rows.mapInArrow(run, shape)
