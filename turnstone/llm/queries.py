"""The dealt operators over their whole tables, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.llm import exact_dedup, fill_middle, minhash, mixing, multi_index, packing, planes, resample, shards, simhash, substrings, toxicity, url_cascade
from turnstone.llm.base import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return multi_index.search(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


@query
def op2_debruijn_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op3_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "class_id")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


@query
def op5_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~held_out()))
    scored = toxicity.score_rows(docs, model, ["doc_id"])
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("tox_score").alias("score"),
                         (F.col("tox_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query
def op6_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), True, 1)


@query
def op7_extendible_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLES["op7_extendible_dedup"] = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
           FROM documents),
g AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS place,
             first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM g
"""

SHARDS = 16


@query
def op8_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_rows(table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))


@query
def op9_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The mix as SQL; also used by the pipeline. {docs}: a relation with doc_id, text, source.
MIX_SQL = r"""
t AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM t GROUP BY source),
w AS (SELECT *, [5, 2, 1][((n - 1) % 3 + 1)::INT]::BIGINT AS weight, 3 * source_size AS cap FROM s),
r AS (SELECT *, (SELECT sum(source_size) FROM s)::BIGINT - coalesce(sum(cap) OVER below, 0)::BIGINT AS rest,
             (SELECT sum(weight) FROM w)::BIGINT - coalesce(sum(weight) OVER below, 0)::BIGINT AS rest_weight,
             row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS nth
      FROM w WINDOW below AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT rest / rest_weight AS level FROM r WHERE cap / weight >= rest / rest_weight ORDER BY nth LIMIT 1),
a AS (SELECT source, source_size, least(weight * (SELECT level FROM l), cap::DOUBLE) AS target FROM r),
m AS (SELECT greatest(1, ceil(count(*) / 65536))::BIGINT AS parts FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size,
                 ('0x' || substr(md5(concat_ws(':', '11', coalesce(doc_id::VARCHAR, 'null'))), 1, 13))::BIGINT % (SELECT parts FROM m), doc_id) - 1 AS place FROM t),
x AS (SELECT p.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS step,
             (('0x' || substr(md5(concat_ws(':', 'offset', '11', coalesce(p.source, 'null'))), 1, 13))::BIGINT % 1048576) / 1048576.0::DOUBLE AS u
      FROM p JOIN a ON p.source IS NOT DISTINCT FROM a.source),
mixed AS (SELECT *, (floor((place + 1) * step + u) - floor(place * step + u))::BIGINT AS copies FROM x)
"""
ORACLES["op9_systematic_mix"] = f"WITH {MIX_SQL.format(docs='documents')} SELECT doc_id, size, source_size, target, copies * size AS taken FROM mixed"

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query
def op10_bloom_cascade_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    return url_cascade.judge_urls(table(spark, sf_dir, "pages"), rules)


ORACLES["op10_bloom_cascade_urls"] = r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM pages),
r(action, h, start) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
f AS (SELECT page_id, host, path, h || start AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(h || start) DESC NULLS LAST) AS place
      FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, start))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM f WHERE place = 1
"""


@query
def op11_prefix_crc_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.fill_in_middle(table(spark, sf_dir, "documents")).withColumn("output_sha256", F.sha2("output", 256))
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"]
    return fill_middle.restore(cut, columns).select(*columns, F.sha2("restored", 256).alias("restored_sha256"))


ORACLES["op13_fill_in_middle"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
                  sha256('42:' || coalesce(doc_id::VARCHAR, 'null')) AS digest FROM documents),
h AS (SELECT *, len(units)::BIGINT AS n, ('0x' || substr(digest, 1, 8))::BIGINT AS h1, ('0x' || substr(digest, 9, 8))::BIGINT AS h2,
             ('0x' || substr(digest, 17, 8))::BIGINT AS h3, ('0x' || substr(digest, 25, 8))::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
