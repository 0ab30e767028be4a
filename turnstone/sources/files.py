"""Dimension files, evaluation cases, JSONL inputs and output folders."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.functions import fixed_values as V
from turnstone.operators import dims

_COMMENTS = {"allowComments": "true", "multiLine": "true"}
_SPEC_FILE = ("signaux array<struct<cle: string, palier: int, cible: double, plus_haut_est_mieux: boolean, ratio: boolean>>, "
              "problematiques array<struct<id: string, palier: int, signaux: array<string>>>, paliers map<string, struct<term: string, analogy: string>>")


def load_specs(spark: SparkSession, path: str | None) -> tuple[DataFrame, list[str]]:
    """S07 — signal specs from a data file, or the built-in ones when the file is absent, unreadable or incomplete.

    A usable file declares signals, at least one with a target, problems, and a term and an analogy for each of the
    five levels. Comments are allowed.
    """
    built_in = dims.specs(spark)
    if path is None:
        return built_in, []
    try:
        doc = spark.read.schema(_SPEC_FILE).options(**_COMMENTS).json(path)
        one = doc.select(
            (F.coalesce(F.size("signaux"), F.lit(0)) > 0).alias("signals"), F.exists("signaux", lambda s: s["cible"].isNotNull()).alias("graded"),
            (F.coalesce(F.size("problematiques"), F.lit(0)) > 0).alias("problems"),
            *[((F.coalesce(F.try_element_at("paliers", F.lit(str(n)))["term"], F.lit("")) != "") & (F.coalesce(F.try_element_at("paliers", F.lit(str(n)))["analogy"], F.lit("")) != "")).alias(f"level {n}")
              for n in range(1, 6)]).first()
    except AnalysisException:
        return built_in, []
    bad = ["unreadable"] if one is None else [name for name, ok in one.asDict().items() if not ok]
    if bad:
        return built_in, [f"{path}: {bad[0]} missing or incomplete, built-in values kept"]
    signals = doc.select(F.posexplode("signaux").alias("i", "s"))
    owners = (doc.select(F.posexplode("problematiques").alias("p", "x")).select("p", "x.id", F.explode("x.signaux").alias("cle"))
              .groupBy("cle").agg(F.min_by("id", "p").alias("problem")))
    out = signals.select((F.col("i") + 1).alias("spec_order"), F.col("s.cle").alias("signal"), F.col("s.palier").alias("spec_level"), F.col("s.cible").alias("target"),
                         F.coalesce("s.plus_haut_est_mieux", F.lit(True)).alias("higher"), F.coalesce("s.ratio", F.lit(True)).alias("ratio"))
    return out.join(owners, out["signal"] == owners["cle"], "left").drop("cle"), []


def load_packs(spark: SparkSession, folder: str, reserved: str = "maturite.json") -> DataFrame:
    """S07 — vocabulary pack files as text, one row per readable pack with an id; the neutral pack only when complete."""
    try:
        files = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    except AnalysisException:
        return spark.createDataFrame([], "pack_id string, pack_json string, file string")
    v = files.filter(F.lower("file") != reserved).withColumn("p", F.try_parse_json("value"))
    pack_id = F.try_variant_get("p", "$.id", "string")
    complete = F.lit(True)
    for n in range(1, 6):
        for f in ("term", "analogy"):
            complete = complete & (F.coalesce(F.try_variant_get("p", f"$.levels['{n}'].{f}", "string"), F.lit("")) != "")
    return (v.withColumn("pack_id", pack_id).filter((F.coalesce("pack_id", F.lit("")) != "") & ((F.lower("pack_id") != "neutre") | complete))
            .select("pack_id", F.col("value").alias("pack_json"), "file"))


_ENTITY = "nom: string, alias: array<string>, race: string, aerien: boolean, invisible: boolean, detecteur: boolean"
_DICTIONARY = (f"unites array<struct<{_ENTITY}>>, batiments array<struct<{_ENTITY}>>, mecaniques array<struct<nom: string>>, "
               "vernaculaire array<struct<terme: string>>, punitions array<struct<id: string, palier: int, signal: string>>")


def load_dictionary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S07 — a fact file as tables for the claim rules and lookups: names (one row per name or alias), terms, situations.

    An absent file gives empty tables.
    """
    try:
        doc = spark.read.schema(_DICTIONARY).options(**_COMMENTS).json(path)
    except AnalysisException:
        doc = spark.createDataFrame([], _DICTIONARY)

    def entities(column: str, kind: str) -> DataFrame:
        e = doc.select(F.explode(column).alias("e")).select("e.*")
        names = F.filter(F.concat(F.array("nom"), F.coalesce("alias", F.array().cast("array<string>"))), lambda x: F.coalesce(x, F.lit("")) != "")
        off = F.lit(False)
        return e.select(F.col("nom").alias("entity"), F.explode(names).alias("alias"), F.coalesce("race", F.lit("")).alias("side"), F.lit(kind).alias("kind"),
                        F.coalesce("aerien", off).alias("air"), F.coalesce("invisible", off).alias("cloaked"), F.coalesce("detecteur", off).alias("detector"))

    names = entities("unites", "unit").unionByName(entities("batiments", "building"))
    terms = (doc.select(F.posexplode("mecaniques.nom").alias("place", "term")).withColumn("kind", F.lit("mechanic"))
             .unionByName(doc.select(F.posexplode("vernaculaire.terme").alias("place", "term")).withColumn("kind", F.lit("slang"))))
    situations = doc.select(F.explode("punitions").alias("p")).select(F.col("p.id").alias("situation_id"), "p.signal", F.col("p.palier").alias("level"))
    return names, terms, situations


def load_cases(spark: SparkSession, folder: str, shareable_only: bool = True, pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """S09 — evaluation cases of a folder and the warnings: malformed files, cases without id or family, refused private cases."""
    try:
        files = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    except AnalysisException:
        files = spark.createDataFrame([], "value string, file string")
    v = files.withColumn("doc", F.try_parse_json("value"))
    items = F.try_variant_get("doc", "$.epreuves", "array<variant>")
    v = v.withColumn("items", items)
    broken = v.filter("items IS NULL").select("file", F.when(F.col("doc").isNull(), "malformed").otherwise("no case list").alias("warning"))
    e = v.select("file", F.try_variant_get("doc", "$.famille", "string").alias("_family"), F.explode("items").alias("e"))

    def get(name: str, kind: str = "string"):
        return F.try_variant_get("e", f"$.{name}", kind)

    rows = e.select("file", F.coalesce(get("id"), F.lit("")).alias("case_id"), F.coalesce(get("famille"), F.col("_family"), F.lit("")).alias("family"),
                    F.coalesce(get("intitule"), F.lit("")).alias("title"), F.coalesce(F.nullif(get("origine"), F.lit("")), F.lit("synthetique")).alias("origin"),
                    F.coalesce(get("partageable", "boolean"), F.lit(True)).alias("shareable"), F.coalesce(get("etiquettes", "array<string>"), F.array().cast("array<string>")).alias("tags"),
                    get("entree", "variant").alias("input"), get("attendu", "variant").alias("expected"))
    refused = (~F.col("shareable") | (F.col("origin") == "transcript")) if shareable_only else F.lit(False)
    why = F.when(F.col("case_id") == "", "case without id").when(F.col("family") == "", "case without family").when(refused, "not shareable")
    rows = rows.withColumn("warning", why)
    return rows.filter("warning IS NULL").drop("warning"), broken.unionByName(rows.filter("warning IS NOT NULL").select("file", F.concat_ws(": ", "case_id", "warning").alias("warning")))


def case_set_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """S09 — fingerprint of the files of a folder, line ends unified."""
    from turnstone.operators.cases import set_fingerprint
    files = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    return set_fingerprint(files, F.concat_ws("|", "file", F.regexp_replace("value", "\r\n?", "\n")), digits=8)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S10 — JSON lines with a declared schema (golden queries, results, runs, judge answers)."""
    return spark.read.schema(schema).json(path)


GOLDEN_SCHEMA = "id string, query string, expected_doc_ids array<string>, must_contain array<string>, answerable boolean, tags array<string>, difficulty string"
RESULTS_SCHEMA = "id string, results array<struct<docId: string, chunkId: string, score: double, text: string>>"


def ranked_results(results: DataFrame, k: int, doc_field: str = "docId") -> DataFrame:
    """S10 — the first k results of each nested row, as ranked rows."""
    top = F.slice("results", 1, k)
    return (results.select(F.col("id").alias("query_id"), F.posexplode(top).alias("i", "r"))
            .select("query_id", F.col(f"r.{doc_field}").alias("doc_id"), F.col("r.score").alias("score"), F.col("r.text").alias("text"), (F.col("i") + 1).alias("rank")))


# ------------------------------------------------------------------------------------------- sinks
def write_run_log(events: DataFrame, agents: DataFrame, path: str) -> None:
    """S11 — event log and run headers as JSON lines.

    Events are spread by (session, seq) ranges and sorted, so a run's events are adjacent and in order, and a long run
    may span files. A folder per run would make as many folders as there are sessions.
    """
    events.repartitionByRange("session_id", "seq").sortWithinPartitions("session_id", "seq").write.mode("overwrite").json(f"{path}/events")
    agents.write.mode("overwrite").json(f"{path}/agents")


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    schema = ("session_id string, seq bigint, t bigint, actor string, origin string, kind string, ref string, tok_in bigint, tok_out bigint, calls bigint, "
              "payload map<string,string>")
    return spark.read.schema(schema).json(f"{path}/events")


PRIVATE_COLUMNS = {"prompt", "first_prompt", "user_text", "final_message", "result_text", "input_json", "text", "title"}


def write_report(df: DataFrame, path: str) -> None:
    """S12 — a report as JSON, refused when it would carry any prompt text."""
    leaked = PRIVATE_COLUMNS & set(df.columns)
    if leaked:
        raise ValueError(f"a shared report must not hold {sorted(leaked)}")
    df.write.mode("overwrite").json(path)
