"""Vocabulary packs: lookup with fallback, level terms, string-or-array normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.functions import exprs as X


def as_variants(v: Column) -> Column:
    """S08 — a field that is a text or an array of texts, as an array without blanks; NULL when nothing is left."""
    kind = F.schema_of_variant(v)
    many = F.try_variant_get(v, "$", "array<string>")
    one = F.array(F.try_variant_get(v, "$", "string"))
    items = F.filter(F.when(kind == "STRING", one).otherwise(many), lambda x: ~X.is_blank(x))
    return F.when(F.size(items) > 0, items)


def vocabulary_rows(packs: DataFrame, column: str = "pack_json") -> DataFrame:
    """Pack files to ``(pack, side, kind, key, variants)``; side is '' for the words shared by all sides."""
    v = packs.select(F.try_parse_json(column).alias("p"))
    shared = v.select(F.try_variant_get("p", "$.id", "string").alias("pack"), F.lit("").alias("side"), F.col("p").alias("body"))
    sides = (v.select(F.try_variant_get("p", "$.id", "string").alias("pack"),
                      F.explode(F.try_variant_get("p", "$.races", "map<string,variant>")).alias("side", "body")))
    bodies = shared.unionByName(sides)
    out = None
    for kind in ("signals", "challenges", "moments"):
        rows = bodies.select("pack", F.lower("side").alias("side"), F.lit(kind).alias("kind"),
                             F.explode(F.try_variant_get("body", f"$.{kind}", "map<string,variant>")).alias("key", "_v"))
        rows = rows.select("pack", "side", "kind", "key", as_variants(F.col("_v")).alias("variants")).filter("variants IS NOT NULL")
        out = rows if out is None else out.unionByName(rows)
    return out


def pick_words(requests: DataFrame, vocabulary: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    """J06 — the words for each request: its side first, then the shared words; within each, the given keys in order.

    ``vocabulary`` is unique per (pack, side, kind, key). Each level of the fallback is one left join; how it runs
    follows the size Spark measures for the vocabulary.
    """
    words = vocabulary.filter(F.col("kind") == kind).select("pack", "side", "key", "variants")
    out, found = requests, []
    for s, side in enumerate((F.lower(F.coalesce("side", F.lit(""))), F.lit(""))):
        for k, key in enumerate(keys):
            name = f"_v{s}{k}"
            w = words.select(F.col("pack").alias("_p"), F.col("side").alias("_s"), F.col("key").alias("_k"), F.col("variants").alias(name))
            out = out.join(w, (out["pack"] == F.col("_p")) & (side == F.col("_s")) & (out[key] == F.col("_k")), "left").drop("_p", "_s", "_k")
            found.append(F.when(F.size(name) > 0, X.pick_variant(name, key, "cycle")))
    return out.withColumn("words", F.coalesce(*found)).drop(*[c for c in out.columns if c.startswith("_v")])


def level_terms(levels: DataFrame, side: DataFrame, base: DataFrame, fields: list[str]) -> DataFrame:
    """J07 — each field of a level from the side's pack, or from the shared pack where the side leaves it blank."""
    def renamed(df: DataFrame, p: str) -> DataFrame:
        return df.select("level", *[F.col(f).alias(f"{p}{f}") for f in fields])
    j = levels.join(renamed(side, "_s_"), "level", "left").join(renamed(base, "_b_"), "level", "left")
    return j.select(*levels.columns, *[F.coalesce(F.nullif(F.col(f"_s_{f}"), F.lit("")), F.col(f"_b_{f}"), F.lit("")).alias(f) for f in fields])
