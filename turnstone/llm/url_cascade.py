"""URL filters by Bloom filter cascades (columns and SQL functions only).

A rule is a host and a start of a path; it fits its host and all subdomains. A url's possible rules are its host's suffixes (no more
labels than the longest listed host has) times the starts of its path (of the lengths that occur in the list); the longest listed
one decides. Membership in a list is asked of a cascade instead of a join: level 1 holds the listed keys, level 2 the keys of the
corpus that level 1 takes for listed, level 3 the listed keys that level 2 takes for those, and so on until a level errs on no key.
As every possible rule of every url of the corpus takes part, the answer is exact for all of them.

The first level is sized for about as many false positives as there are listed keys, so all levels together hold some
``1.44 n (log2(corpus keys / n) + 4)`` bits for n listed keys; ``MAX_BYTES`` bounds a level, and a longer list is an error. Only the
bits come to the driver, never keys.

Null urls and urls without ``://`` have empty host and path, fit no rule and get the method's verdict. Repeated pages are judged
alike. A key in both lists is blocked. Empty lists and empty tables are allowed. Other columns are not read.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.llm.base import LOWER, UPPER, stored

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
MAX_BYTES = 16 << 20
MOST_LEVELS = 64
Level = tuple[int, int, str]      # bits, hashes, the words as a JSON array


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.regexp_extract(url, PARTS, 2)


def possible_rules(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Array of (n, key), longest first: what a listed rule of this url can look like."""
    parts = F.split(host, "\\.")
    usable = F.filter(F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>"), lambda n: n <= F.char_length(path))

    def with_suffix(i: Column) -> Column:
        suffix = F.array_join(F.slice(parts, F.size(parts) - i + 1, i), ".")
        return F.transform(usable, lambda n: F.struct((F.char_length(suffix) + n).alias("n"), F.concat(suffix, F.substring(path, F.lit(1), n)).alias("key")))

    counts = F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(1, labels))))
    return F.when(host != "", F.sort_array(F.flatten(F.transform(counts, with_suffix)), asc=False)).otherwise(
        F.array().cast("array<struct<n:int,key:string>>"))


def _spots(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits).cast("long")) for i in range(hashes)]


def _fill(keys: DataFrame, level: int, n: int, rate: float) -> Level:
    """One Bloom filter over ``keys.key``; the driver gets its words, at most MAX_BYTES."""
    bits = max(64, 64 * math.ceil(1.44 * n * math.log2(1 / rate) / 64))
    if bits > 8 * MAX_BYTES:
        raise ValueError(f"a filter of {bits // 8} bytes is over the bound of {MAX_BYTES}; split the list")
    hashes = max(1, round(bits / n * math.log(2)))
    spots = keys.select(F.explode(F.array(*_spots(F.col("key"), level, bits, hashes))).alias("spot"))
    words = spots.groupBy(F.expr("spot div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot % 64 as int))")).alias("bits")).collect()
    filled = [0] * (bits // 64)
    for w in words:
        filled[w["word"]] = w["bits"]
    return bits, hashes, json.dumps(filled)


def _holds(key: Column, level: int, made: Level) -> Column:
    bits, hashes, words = made
    array = F.from_json(F.lit(words), "array<bigint>")           # folded to one constant

    def lit(spot: Column) -> Column:
        word = F.element_at(array, (F.floor(spot / 64) + 1).cast("int"))
        return F.getbit(word, (spot % 64).cast("int")) == 1

    out = F.lit(True)
    for spot in _spots(key, level, bits, hashes):
        out = out & lit(spot)
    return out


def build_cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Levels for the keys in ``listed`` against all keys in ``universe`` (one column ``key`` each). Null keys are ignored."""
    inside = stored(listed.select("key").filter("key is not null").distinct(), "cascade-listed")
    outside = stored(universe.select("key").filter("key is not null").distinct().join(inside, "key", "left_anti"), "cascade-rest")
    levels: list[Level] = []
    hold, other = inside, outside
    n_hold, n_other = inside.count(), outside.count()
    while n_hold and len(levels) < MOST_LEVELS:
        rate = min(0.5, n_hold / (1.42 * n_other)) if not levels and n_other else 0.5
        levels.append(_fill(hold, len(levels), n_hold, rate))
        wrong = stored(other.filter(_holds(F.col("key"), len(levels) - 1, levels[-1])), "cascade-wrong")
        hold, other, n_hold = wrong, hold, wrong.count()
    if n_hold:
        raise RuntimeError("the cascade did not end")
    return levels


def member(key: Column, levels: list[Level]) -> Column:
    """Exact for keys of the lists and the universe: the first level that does not hold the key decides."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        out = F.when(_holds(key, i, levels[i]), out).otherwise(F.lit(i % 2 == 1))
    return out


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict``. ``rules``: ``action`` (allow, block), ``host``, ``path``, hosts in lower case."""
    rules = rules.select("action", F.col("host"), F.col("path"), F.concat("host", "path").alias("key"))
    shape = rules.select(F.max(F.size(F.split("host", "\\."))), F.collect_set(F.char_length("path"))).first()
    labels, lengths = shape[0] or 1, sorted(shape[1])
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn(
        "possible", possible_rules(F.col("host"), F.col("path"), labels, lengths))
    universe = stored(urls.select(F.explode("possible.key").alias("key")).distinct(), "cascade-universe")
    block = build_cascade(rules.filter("action = 'block'"), universe)
    allow = build_cascade(rules.filter("action = 'allow'"), universe)
    hits = F.filter("possible", lambda p: member(p["key"], block) | member(p["key"], allow))
    judged = urls.withColumn("rule", F.when(F.size(hits) > 0, hits[0]["key"]))
    verdict = F.when(F.col("rule").isNull(), default).when(member(F.col("rule"), block), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
