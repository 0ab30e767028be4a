"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns: defined results, no crash."""

import pytest

import corpus_pipeline
from turnstone.llm import exact_dedup, minhash, mixing, multi_index, packing, planes, shards, substrings, toxicity, url_cascade

P = pytest.importorskip("public_tokenizers")
CLASH = ["of", "n", "size", "shard", "slot", "node", "anchor", "left", "right", "place", "block", "_block", "id", "count", "digest", "copies", "rank", "part"]
LONG = " ".join(f"w{i % 977}" for i in range(60_000))


def documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", *[f"CAST(doc_id AS STRING) AS `{c}`" for c in CLASH]).repartition(3)


def odd(spark):
    again = " ".join(f"r{i}" for i in range(80))
    return documents(spark, [(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (4, " \t\n", "en", "", 0),
                             (None, "a b c d e f", "en", "s", 1), (None, None, None, None, None), (5, LONG, "en", "s", 1), (6, LONG + " z", "en", "t", 1), (7, again, "en", "t", 1),
                             (8, "x " + again, None, "t", 1), (9, "\u00e9\U0001f600 <|endoftext|> \x00", "fr", None, 3), (10, "y" * 70_000, "en", "s", 1)])


def labels(spark):
    return spark.createDataFrame([(1, 1), (1, 0), (7, 1), (8, 0), (5, 0), (3, 0), (None, 1), (9, None)], "doc_id long, toxic int")


RUN = {
    "dedup": lambda d, s: exact_dedup.exact_duplicates(d, capacity=2, owner_rows=4),
    "shards": lambda d, s: shards.shard_rows(d, [1.0, 2.0], [1.0, 2.0, 1.0]),
    "mix": lambda d, s: mixing.mix_rows(d),
    "pack": lambda d, s: packing.pack(d, P.path("byte_bpe_50k.json")),
    "planes": lambda d, s: planes.round_trip(d, P.path("word_bpe_49k.json"), True, 1),
    "toxicity": lambda d, s: toxicity.score_rows(d, toxicity.fit(d, labels(s)), d.columns),
    "minhash": lambda d, s: minhash.near_duplicates(d),
    "substrings": lambda d, s: substrings.remove_repeats(d),
}


@pytest.mark.parametrize("name", RUN)
def test_empty_table(spark, name):
    assert RUN[name](odd(spark).filter("false"), spark).collect() == []


def test_dedup_of_odd_rows(spark):
    rows = RUN["dedup"](odd(spark), spark).collect()
    assert len(rows) == 13
    empty = [r for r in rows if r.group_size == 4]                    # two null texts, an empty and a blank one
    assert len(empty) == 4 and {r.keep_id for r in empty} == {4} and sum(r.kept for r in empty) == 1
    same = [r for r in rows if r.group_size == 3]
    assert len(same) == 3 and {r.keep_id for r in same} == {1} and sum(r.kept for r in same) == 1
    assert sum(r.kept for r in rows) == 8


@pytest.mark.parametrize("weak", ["key", "digest", "both"])
def test_dedup_tells_colliding_texts_apart(spark, weak):
    from pyspark.sql import functions as F

    key = lambda text: F.char_length(text).cast("long")
    digest = lambda text: F.encode(F.substring(text, 1, 1), "UTF-8")
    hashes = {"key": {"key": key}, "digest": {"digest": digest}, "both": {"key": key, "digest": digest}}[weak]
    texts = ["ab", "a b", "ac", "ba", "ab ", "abc", "a  c", "xyz", "", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 40)], "doc_id long, text string").repartition(4)
    rows = {r.doc_id: r for r in exact_dedup.exact_duplicates(docs, capacity=1, owner_rows=2, **hashes).collect()}
    groups = {}
    for i, t in enumerate(texts * 40):
        groups.setdefault("".join((t or "").split()), []).append((-len(t or ""), i))
    assert len(rows) == 400
    for ids in groups.values():
        keep = min(ids)[1]
        assert all((rows[i].keep_id, rows[i].group_size, rows[i].kept) == (keep, len(ids), i == keep) for _, i in ids)
    members = {(r.bucket, r.chain_place, r.keep_id) for r in rows.values()}
    assert len(members) == len(groups)


def test_dedup_index_answers_another_batch(spark):
    first = spark.createDataFrame([(i, f"text {i % 70}") for i in range(100)], "doc_id long, text string")
    index = exact_dedup.build_index(exact_dedup.entries(first), capacity=4, owner_rows=8)
    local = [r.local_depth for r in index.members.collect()]
    assert index.depth >= 4 and max(local) == index.depth and min(local) < index.depth       # some buckets split, others shared by cells
    full = index.members.groupBy("bucket").count().collect()
    assert max(r["count"] for r in full) <= 4
    second = exact_dedup.entries(spark.createDataFrame([(1000, "text65"), (1001, "te xt 2"), (1002, "new"), (1003, None)], "doc_id long, text string"))
    assert {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.probe(second, index).collect()} == {1000: (65, 1), 1001: (2, 2), 1002: (None, None), 1003: (None, None)}


def test_shards_of_odd_rows(spark):
    rows = RUN["shards"](odd(spark), spark).collect()
    assert len(rows) == 13 and len({(r.shard, r.slot) for r in rows}) == 13 and all(r.grown_shard in (r.shard, 2) for r in rows)
    assert {r.size for r in rows if r.doc_id == 2} == {1}


def test_mix_of_odd_rows(spark):
    rows = RUN["mix"](odd(spark), spark).collect()
    assert len(rows) == 13 and all(0 <= r.taken <= 3 * r.size for r in rows)
    assert {r.source_size for r in rows if r.source is None} == {3} and {r.target for r in rows if r.source == ""} == {0.0}


def test_packing_of_odd_rows(spark):
    rows = RUN["pack"](odd(spark), spark).collect()
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    assert len({p[:2] for p in places}) == len(places)
    assert sum(r.length for r in rows if r.doc_id in (2, 3)) == 2 and sum(r.piece == 0 for r in rows) == 13


def test_planes_of_odd_rows(spark):
    rows = sorted(RUN["planes"](odd(spark), spark).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows][:2] == [None, None] and [r.doc_id for r in rows][2:] == sorted(r.doc_id for r in rows[2:]) and len(rows) == 13
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:]))


def test_toxicity_of_odd_rows(spark):
    rows = RUN["toxicity"](odd(spark), spark).collect()
    assert len(rows) == 13 and all(0 <= r.tox_score <= 1 for r in rows)
    none = toxicity.score_rows(odd(spark), toxicity.fit(odd(spark), labels(spark).filter("false")), ["doc_id"]).collect()
    assert len(none) == 13 and all(r.tox_score < 0.01 for r in none)


def test_minhash_of_odd_rows(spark):
    rows = RUN["minhash"](odd(spark), spark).collect()
    assert len(rows) == 13 and {r.component_id for r in rows if r.doc_id == 6} == {5} and {r.component_id for r in rows if r.doc_id == 8} == {7}
    assert all(r.component_id is None for r in rows if r.doc_id is None) and {(r.n_shingles, r.kept) for r in rows if r.doc_id in (2, 3, 4)} == {(0, True)}


def test_texts_that_share_an_id_are_linked_each(spark):
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(120)) for k in "abcd")
    rows = [(1, a), (1, b), (1, c), (2, a), (3, b), (4, c + " z"), (5, a + " z"), (5, d), (6, d), (7, a.upper()), (1, b + " z")]
    docs = documents(spark, [(i, t, "en", "s", 1) for i, t in rows])
    found = minhash.near_duplicates(docs)
    got = sorted((r.doc_id, r.component_id) for r in found.collect())
    assert got == [(1, 1)] * 4 + [(2, 1), (3, 1), (4, 1), (5, 1), (5, 5), (6, 5), (7, 1)]
    kept = sorted(r.doc_id for r in found.filter("kept").collect())
    assert kept == [1, 1, 1, 5]                                        # one text each of a, b, c and d
    left = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(i for i, _ in left) == kept and {t.split()[0] for _, t in left} == {"a0", "b0", "c0", "d0"} and (5, d) in left


def test_substrings_of_odd_rows(spark):
    rows = RUN["substrings"](odd(spark), spark).collect()
    gone = {r.doc_id: r.n_removed for r in rows}
    assert len(rows) == 13 and gone[6] == 60_000 and gone[8] == 80 and gone[5] == 0 and gone[None] == 0


def test_index_of_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (8, [2.0, 1.0]), (0, [1.0, 2.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cell", "2 AS rank", "3 AS block", "4 AS score", "5 AS vec")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in multi_index.search(df, df.filter("vec_id in (0, 2, 3, 5, 8)"), k=3).collect())
    assert got == [(0, 1, 1, 5.0), (0, 2, 8, 4.0), (8, 1, 0, 4.0), (8, 2, 0, 4.0), (8, 3, 1, 4.0)]
    assert multi_index.search(df.filter("false"), df, k=3).collect() == []


def test_index_keeps_the_commonest_length(spark):
    rows = [(i, [1.0, float(i)]) for i in range(1, 6)] + [(6, [1.0, 1.0, 9.0]), (7, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in multi_index.search(df, df.filter("vec_id in (1, 6, 7)"), k=2).collect())
    assert got == [(1, 1, 5), (1, 2, 4)]                              # the queries' own lengths do not count


def test_urls_of_odd_pages(spark):
    rules = spark.createDataFrame([], "action string, host string, path string")
    pages = spark.createDataFrame([(1, None), (None, "http://x/"), (2, ""), (2, "http://" + "a." * 3000 + "com/" + "p" * 50_000)], "page_id long, url string").selectExpr("*", "'q' AS key", "'q' AS host", "'q' AS rule")
    assert [(r.rule, r.verdict) for r in url_cascade.judge_urls(pages, rules).collect()] == [(None, "allow")] * 4
    one = spark.createDataFrame([("block", "com", "/p")], "action string, host string, path string")
    assert sorted(r.verdict for r in url_cascade.judge_urls(pages, one).collect()) == ["allow", "allow", "allow", "block"]
    assert url_cascade.judge_urls(pages.filter("false"), one).collect() == []


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_rows(spark, empty, tmp_path):
    labels(spark).selectExpr("doc_id", "1 AS quality", "0 AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd(spark).filter("false") if empty else odd(spark)
    columns, left = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/stage{i}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        assert name == "packing" or docs.columns == columns
        left.append(docs.count())
    assert left[:2] == ([0, 0] if empty else [13, 8]) and (left[4] == 0) == empty


def test_pipeline_decisions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, sf).cache()
    copies = corpus_pipeline.drop_copies(spark, clean, sf).cache()
    want = {r.keep_id for r in exact_dedup.exact_duplicates(clean).collect()}
    assert {r.doc_id for r in copies.collect()} == want and copies.count() == len(want)
    near = corpus_pipeline.drop_near_copies(spark, copies, sf).cache()
    assert {r.doc_id for r in near.collect()} == {r.doc_id for r in minhash.near_duplicates(copies, corpus_pipeline.NEAR).collect() if r.kept}
    mixed = corpus_pipeline.mix_sources(spark, near, sf).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in mixed} == {r.doc_id: r.copies for r in mixing.mix_rows(near).collect() if r.copies}
