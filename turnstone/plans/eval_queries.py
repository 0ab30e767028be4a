"""Queries of the evaluation kit (V, J08-J20, A19-A23, A26, E03-E08, K08, K09, R09-R12, S13, S14, W16-W18)."""

from __future__ import annotations

import uuid

import turnstone.operators.rewriting as RW
from pyspark.sql import functions as F

from turnstone.functions import exprs as X
from turnstone.functions import fixed_values as V
from turnstone.operators import cases as C, claims as L, contract as Q, retrieval as I, segmentation as S, snapshot as P
from turnstone.plans.oracle_base import part, words
from turnstone.plans.record_queries import _RUBRIC_SQL as RUBRIC_SQL
from turnstone.plans.registry import query, r6
from turnstone.session import shared_dir, stored

K = 10
part("golden")("""
SELECT user_id AS query_id, user_id % 10 <> 9 AS answerable, CASE user_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty
FROM (SELECT DISTINCT user_id FROM events UNION SELECT 1000000)""")
part("top10")("""
SELECT user_id AS query_id, event_type AS doc_id, value AS score, props AS text, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank
FROM events QUALIFY rank <= 10""")
part("docs10", "top10")("SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS pos FROM top10 GROUP BY query_id, doc_id")
part("scores", "golden", "docs10", "top10")("""
SELECT g.query_id, g.answerable, g.difficulty, CASE WHEN answerable THEN coalesce(hits, 0) / 2 END AS recall, CASE WHEN answerable THEN CASE WHEN hits = 2 THEN 1.0 ELSE 0.0 END END AS all_hit,
 CASE WHEN answerable THEN coalesce(1.0 / first_pos, 0) END AS mrr, CASE WHEN answerable THEN CASE WHEN hits > 0 THEN dcg / CASE hits WHEN 1 THEN 1.0 ELSE 1.0 + 1.0 / log2(3) END ELSE 0 END END AS ndcg,
 CASE WHEN answerable AND blob IS NOT NULL THEN (CAST(contains(blob, '"k": 5') AS INT) + CAST(contains(blob, '9}') AS INT)) / 2 END AS facts, CASE WHEN NOT answerable THEN coalesce(top_score, 0) END AS top_score
FROM golden g LEFT JOIN (SELECT query_id, count(*) AS hits, min(pos) AS first_pos, sum(1.0 / log2(pos + 1)) AS dcg FROM docs10 WHERE doc_id IN ('purchase', 'signup') GROUP BY query_id) h USING (query_id)
LEFT JOIN (SELECT query_id, string_agg(text, chr(10) ORDER BY rank) AS blob, arg_min(score, rank) AS top_score FROM top10 GROUP BY query_id) b USING (query_id)""")


def golden(t):
    g = t.raw("events").select("user_id").union(t.spark.range(1_000_000, 1_000_001)).distinct()
    return g.select(F.col("user_id").alias("query_id"), (F.col("user_id") % 10 != 9).alias("answerable"), F.expr("CASE user_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END").alias("difficulty"),
                    X.const(["purchase", "signup"]).alias("expected"), X.const(['"k": 5', "9}"]).alias("must_contain"),
                    F.expr("CASE WHEN user_id % 2 = 0 THEN array('even', 'all') ELSE array('all', 'all') END").alias("tags"))


def top(t):
    e = t.raw("events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("doc_id"), F.col("value").alias("score"), F.col("props").alias("text"), "event_id")
    return I.top_results(e, K, [F.desc("score"), F.col("event_id")])


def scores(t):
    return I.score_queries(golden(t), top(t))


@query("k08_top_results_dedup", "SELECT query_id, doc_id, pos FROM docs10", "docs10")
def k08(t):
    from pyspark.sql import Window
    docs = top(t).groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))      # at most k rows per query
    return docs.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("bigint").alias("pos"))


@query("j12_golden_results", "SELECT query_id, answerable, (SELECT count(*) FROM top10 t WHERE t.query_id = g.query_id) AS results FROM golden g", "golden", "top10")
def j12(t):
    n = top(t).groupBy("query_id").agg(F.count(F.lit(1)).alias("results"))
    return golden(t).join(n, "query_id", "left").select("query_id", "answerable", F.coalesce("results", F.lit(0).cast("bigint")).alias("results"))


@query("v01_retrieval_scores", "SELECT query_id, answerable, round(recall, 6) AS recall, round(all_hit, 6) AS all_hit, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM scores", "scores")
def v01(t):
    return scores(t).select("query_id", "answerable", *[r6(c).alias(c) for c in ("recall", "all_hit", "mrr", "ndcg")])


@query("v02_fact_coverage", "SELECT query_id, round(facts, 6) AS facts FROM scores WHERE facts IS NOT NULL", "scores")
def v02(t):
    return scores(t).filter("facts IS NOT NULL").select("query_id", r6("facts").alias("facts"))


@query("v02_fact_coverage_documents", """
SELECT doc_id AS query_id, round((CAST(contains(d.text, b.text) AS INT) + CAST(contains(d.text, ' the ') AS INT) + CAST(contains(d.text, lang) AS INT)) / 3, 6) AS facts
FROM documents d JOIN (SELECT *, count(*) OVER () AS items FROM benchmark) b ON b.item_id = d.doc_id % items WHERE d.text <> ''""")
def v02b(t):
    b = t.raw("benchmark").select("item_id", F.col("text").alias("passage"))
    items = b.agg(F.count(F.lit(1)).alias("items"))
    d = t.raw("documents").crossJoin(F.broadcast(items)).withColumn("item_id", F.col("doc_id") % F.col("items"))      # one row
    results = d.select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("doc_id"), F.lit(1.0).alias("score"), "text", F.lit(1).alias("rank"))
    want = d.join(b, "item_id").select(F.col("doc_id").alias("query_id"), F.lit(True).alias("answerable"), F.lit("medium").alias("difficulty"), F.array(F.col("doc_id").cast("string")).alias("expected"),
                                       F.array("passage", F.lit(" the "), "lang").alias("must_contain"), F.array("lang").alias("tags"))
    s = I.score_queries(want, results.withColumn("doc_id", F.col("doc_id").cast("string")))
    return s.filter("facts IS NOT NULL").select("query_id", r6("facts").alias("facts"))


@query("v03_negative_check", "SELECT query_id, top_score, top_score < 99 AS ok FROM scores WHERE NOT answerable", "scores")
def v03(t):
    return scores(t).filter("NOT answerable").select("query_id", "top_score", (F.col("top_score") < 99).alias("ok"))


@query("a20_retrieval_summary", """
SELECT count(*) AS n, count(*) FILTER (answerable) AS n_answerable, count(*) FILTER (NOT answerable) AS n_negative, round_even(avg(recall), 4) AS recall, round_even(avg(mrr), 4) AS mrr, round_even(avg(ndcg), 4) AS ndcg,
 round_even(avg(all_hit), 4) AS all_hit, round_even(avg(facts), 4) AS facts, round_even(avg(CASE WHEN NOT answerable THEN CAST(top_score < 99 AS INT) END), 4) AS negative_ok FROM scores""", "scores")
def a20(t):
    return I.summary(scores(t), 99.0)


@query("a21_by_tag_and_difficulty", """
SELECT "grouping", value, count(*) AS n, round_even(avg(recall), 4) AS recall, round_even(avg(mrr), 4) AS mrr, round_even(avg(all_hit), 4) AS all_hit FROM (
 SELECT 'tag' AS "grouping", 'all' AS value, * FROM scores WHERE answerable UNION ALL SELECT 'tag', 'even', * FROM scores WHERE answerable AND query_id % 2 = 0
 UNION ALL SELECT 'difficulty', difficulty, * FROM scores WHERE answerable) GROUP BY ALL""", "scores")
def a21(t):
    return I.by_tag_and_difficulty(scores(t))


@query("k09_worst_queries", "SELECT query_id, round(recall, 6) AS recall, round(mrr, 6) AS mrr FROM scores WHERE answerable ORDER BY scores.recall, scores.mrr, query_id LIMIT 10", "scores")
def k09(t):
    return I.worst_queries(scores(t)).select("query_id", r6("recall").alias("recall"), r6("mrr").alias("mrr"))


@query("r11_baseline_regression", """
WITH s AS (SELECT round_even(avg(recall), 4) AS recall, round_even(avg(mrr), 4) AS mrr, round_even(avg(ndcg), 4) AS ndcg FROM scores)
SELECT metric, now, baseline, round_even(now - baseline, 4) AS delta FROM (SELECT 'recall' AS metric, recall AS now, CAST(0.99 AS DOUBLE) AS baseline FROM s UNION ALL SELECT 'mrr', mrr, 0.1 FROM s UNION ALL SELECT 'ndcg', ndcg, 0.9 FROM s)
WHERE now < baseline - 0.02""", "scores")
def r11(t):
    base = t.spark.range(1).select(F.lit(0.99).alias("recall"), F.lit(0.1).alias("mrr"), F.lit(0.9).alias("ndcg"))
    return I.regressions(I.summary(scores(t), 99.0), base, ["recall", "mrr", "ndcg"], 0.02)


@query("w16_context_without_degradation", """
WITH r AS (SELECT o_totalprice, avg(CAST(o_orderstatus <> 'F' AS INT)) OVER (ORDER BY o_totalprice, o_orderkey ROWS UNBOUNDED PRECEDING) AS running, avg(CAST(o_orderstatus <> 'F' AS INT)) OVER () AS overall FROM orders)
SELECT max(CAST(floor(o_totalprice) AS BIGINT)) FILTER (running >= overall - 0.0005) AS max_context_tokens, round(max(overall), 6) AS overall FROM r""")
def w16(t):
    rows = t.raw("orders").select("o_orderkey", "o_totalprice", F.floor("o_totalprice").cast("bigint").alias("context_tokens"), (F.col("o_orderstatus") != "F").alias("success"))
    w = I.context_without_degradation(rows, ["o_totalprice", "o_orderkey"], F.floor(F.col("o_totalprice") / 1000), 0.0005)
    return w.withColumn("overall", r6("overall"))


# --------------------------------------------------------------------------------- segmentation
part("marks")("""
SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role = 'user' AS is_ref, length(text) > avg(length(text)) OVER (PARTITION BY conv_id) AS is_hyp, text FROM conversations""")
part("pks", "marks")("""
SELECT s.doc_id, any_value(s.n) AS n, any_value(k) AS k, CASE WHEN any_value(s.n) < 2 THEN 0.0 ELSE coalesce(avg(CASE WHEN b.i IS NOT NULL THEN CAST((s.r = b.r) <> (s.h = b.h) AS INT) END), 0) END AS pk FROM (
 SELECT *, CASE WHEN k0 >= n THEN n - 1 ELSE k0 END AS k FROM (SELECT *, greatest(2, CAST(round_even(n / greatest(1, refs) / 2, 0) AS BIGINT)) AS k0 FROM (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id) AS n, sum(CAST(is_ref AS INT)) OVER (PARTITION BY doc_id) AS refs, greatest(0, sum(CAST(is_ref AS INT)) OVER w - 1) AS r, greatest(0, sum(CAST(is_hyp AS INT)) OVER w - 1) AS h
  FROM marks WINDOW w AS (PARTITION BY doc_id ORDER BY i)))) s
LEFT JOIN (SELECT doc_id, i, greatest(0, sum(CAST(is_ref AS INT)) OVER w - 1) AS r, greatest(0, sum(CAST(is_hyp AS INT)) OVER w - 1) AS h FROM marks WINDOW w AS (PARTITION BY doc_id ORDER BY i)) b
 ON b.doc_id = s.doc_id AND b.i = s.i + s.k GROUP BY s.doc_id""")


def marks(t):
    from turnstone.operators import ordered as O
    c = t.raw("conversations").select(F.col("conv_id").alias("doc_id"), "turn", "role", F.length("text").alias("len"))
    c = O.ordered_scan(c, ["doc_id"], ["turn"], {"pos": O.number()}, O.runs("turn"))
    mean = c.groupBy("doc_id").agg(F.avg("len").alias("mean"))
    return c.join(mean, "doc_id").select("doc_id", (F.col("pos") - 1).alias("i"), (F.col("role") == "user").alias("is_ref"), (F.col("len") > F.col("mean")).alias("is_hyp"))


@query("w17_pk", "SELECT doc_id, n, k, round(pk, 6) AS pk FROM pks", "pks")
def w17(t):
    return S.pk(marks(t)).withColumn("pk", r6("pk"))


@query("v04_boundary_verdicts", """
SELECT doc_id, count(*) FILTER (is_ref AND NOT is_hyp) AS missed, count(*) FILTER (is_hyp AND NOT is_ref) AS invented, coalesce(min(i) FILTER (is_ref AND NOT is_hyp), min(i) FILTER (is_hyp AND NOT is_ref)) AS fault_at,
 CASE WHEN bool_and(is_ref = is_hyp) THEN 'conforme' ELSE 'non_conforme' END AS label, round(any_value(pk), 6) AS pk FROM marks JOIN pks USING (doc_id) GROUP BY doc_id""", "marks", "pks")
def v04(t):
    return S.judge_boundaries(marks(t)).withColumn("pk", r6("pk"))


@query("e03_missed_and_invented", """
SELECT 'missed' AS way, doc_id, i FROM marks WHERE is_ref AND NOT is_hyp UNION ALL SELECT 'invented', doc_id, i FROM marks WHERE is_hyp AND NOT is_ref""", "marks")
def e03(t):
    m = marks(t)
    ref, hyp = m.filter("is_ref").select("doc_id", "i"), m.filter("is_hyp").select("doc_id", "i")
    return (ref.exceptAll(hyp).withColumn("way", F.lit("missed")).unionByName(hyp.exceptAll(ref).withColumn("way", F.lit("invented"))))


@query("v05_reason_verdicts", """
SELECT session_id AS doc_id, count(*) AS expected, count(*) AS found, min(turn_no) FILTER (NOT good) AS fault_at, CASE WHEN bool_and(good) THEN 'conforme' ELSE 'non_conforme' END AS label
FROM (SELECT session_id, turn_no, contains(decision, CASE WHEN turn_no = 1 AND session_id % 3 = 0 THEN 'corrective' WHEN rule = 'silence' THEN 'silence' ELSE '—' END) AS good FROM task_turns) GROUP BY session_id""", "task_turns")
def v05(t):
    rows = t.task_turns.select(F.col("session_id").alias("doc_id"), F.col("turn_no").alias("i"), F.col("decision").alias("reason"), "rule")
    want = rows.select("doc_id", "i", F.when((F.col("i") == 1) & (F.col("doc_id") % 3 == 0), "corrective").when(F.col("rule") == "silence", "silence").otherwise("—").alias("fragment"))
    return S.judge_reasons(want, rows)


# -------------------------------------------------------------------------------------- rewriting
part("pairs")("""
SELECT a.conv_id || '-' || a.turn AS case_id, a.text AS original, a.role AS title, b.text AS rewrite FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'""")
part("doc_pairs")("SELECT a.doc_id AS case_id, a.text AS original, a.lang AS title, b.text AS rewrite FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")


def pairs(t):
    c = t.raw("conversations")
    a = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("original"), F.col("role").alias("title"))
    b = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("rewrite"))
    return a.join(b, ["conv_id", "turn"]).select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("case_id"), "original", "title", "rewrite")


def doc_pairs(t):
    d = t.raw("documents")
    a = d.select(F.col("doc_id").alias("case_id"), F.col("text").alias("original"), F.col("lang").alias("title"))
    return a.join(d.select((F.col("doc_id") - 1).alias("case_id"), F.col("text").alias("rewrite")), "case_id")


_TOK = r"string_split_regex(cand, '[^\p{L}\p{N}_]+')"


def _invention(source: str) -> str:
    return rf"""
WITH c AS (SELECT *, lower(original || ' ' || chr(10) || ' ' || title) AS src, regexp_replace(rewrite, '\[[^\]]*\]', ' ', 'g') AS cand FROM {source}),
 f AS (SELECT case_id, coalesce(
  list_filter(regexp_extract_all(cand, '(?i)[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_\-/.]*\.(?:cs|ts|js|py|json|html|scss|css|sql|md|yml|yaml|razor|xaml)\b'), lambda m: NOT contains(src, lower(m)))[1],
  list_filter({_TOK}, lambda w: regexp_full_match(w, '[A-Z][a-z]+([A-Z][A-Za-z0-9]*)+') AND NOT contains(src, lower(w)))[1],
  list_filter({_TOK}, lambda w: regexp_full_match(w, '\p{{Nd}}+') AND NOT contains(src, lower(w)))[1]) AS evidence FROM c)
SELECT case_id, CASE WHEN evidence IS NULL THEN 'conforme' ELSE 'non_conforme' END AS label, evidence FROM f"""


@query("v07_no_invention", _invention("doc_pairs"), "doc_pairs")
def v07(t):
    return RW.no_invention(doc_pairs(t))


@query("v08_bounded_length", """
SELECT case_id, CASE WHEN length(original) = 0 THEN 'indeterminable' WHEN length(rewrite) <= 2 * length(original) THEN 'conforme' ELSE 'non_conforme' END AS label FROM pairs""", "pairs")
def v08(t):
    return RW.bounded_length(pairs(t)).select("case_id", "label")


def _count_words(column: str, listed: list[str]) -> str:
    items = ", ".join(f"'{w}'" for w in listed)
    return rf"len(list_filter(string_split_regex(lower({column}), '[^\p{{L}}\p{{N}}_]+'), lambda w: w IN ({items})))"


@query("v09_language", f"""
SELECT case_id, CASE WHEN fr = 0 AND en = 0 THEN 'indeterminable' WHEN fr > en THEN 'conforme' ELSE 'non_conforme' END AS label, fr || '/' || en AS evidence
FROM (SELECT doc_id AS case_id, {_count_words('text', V.FRENCH_WORDS)} AS fr, {_count_words('text', V.ENGLISH_WORDS)} AS en FROM documents)""")
def v09(t):
    return RW.stays_french(t.raw("documents").select(F.col("doc_id").alias("case_id"), F.col("text").alias("rewrite")))


@query("v10_direct_address", f"""
SELECT case_id, CASE WHEN a <= b THEN 'conforme' ELSE 'non_conforme' END AS label, a || '/' || b AS evidence FROM (SELECT case_id, {_count_words('rewrite', V.ADDRESS_WORDS)} AS a, {_count_words('original', V.ADDRESS_WORDS)} AS b FROM doc_pairs)""", "doc_pairs")
def v10(t):
    return RW.no_direct_address(doc_pairs(t))


_COMMENT = """
WITH l AS (SELECT case_id, list_filter(list_transform(string_split(rewrite, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1] AS line FROM pairs)
SELECT case_id, CASE WHEN len(list_filter(['voici', 'voilà', 'ce prompt', 'le prompt', 'je propose', 'je te propose', 'il s''agit', 'cette réécriture', 'en résumé', 'note :', 'réécriture :'], lambda o: starts_with(lower(coalesce(line, '')), o))) > 0
 THEN 'non_conforme' ELSE 'conforme' END AS label FROM l"""


@query("v11_not_a_comment", _COMMENT, "pairs")
def v11(t):
    return RW.not_a_comment(pairs(t)).select("case_id", "label")


_R3 = [("a", True, r"\b(que|the|der)\b"), ("b", True, r"\b(avec|with|mit)\b"), ("c", False, r"\b(un|of)\b"), ("d", True, r"\b(el|des|in)\b")]


def _hits(col: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({col}, '{words(p)}') THEN '{k}' END" for k, _, p in _R3) + "], lambda x: x IS NOT NULL)"


@query("v12_rubric_coverage_change", f"""
WITH h AS (SELECT case_id, {_hits('original')} AS a, {_hits('rewrite')} AS b FROM pairs)
SELECT case_id, round(len(list_filter(a, lambda x: x <> 'c')) / 3, 6) AS before, round(len(list_filter(b, lambda x: x <> 'c')) / 3, 6) AS after FROM h""", "pairs")
def v12(t):
    c = RW.coverage_change("original", "rewrite", _R3)
    return pairs(t).select("case_id", r6(c["before"]).alias("before"), r6(c["after"]).alias("after"))


@query("e05_criteria_gained_lost", f"""
WITH h AS (SELECT case_id, {_hits('original')} AS a, {_hits('rewrite')} AS b FROM pairs)
SELECT case_id, array_to_string(list_filter(b, lambda x: NOT list_contains(a, x)), ',') AS gained, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ',') AS lost FROM h""", "pairs")
def e05(t):
    c = RW.coverage_change("original", "rewrite", _R3)
    return pairs(t).select("case_id", F.array_join(c["gained"], ",").alias("gained"), F.array_join(c["lost"], ",").alias("lost"))


def _essential(column: str) -> str:
    """Number of essential rubric criteria that a text meets."""
    return "(" + " + ".join(f"CAST({RUBRIC_SQL[k].replace('text', column)} AS INT)" for k, e, _ in V.RUBRIC if e) + ")"


@query("v26_registered_evaluators", f"""
SELECT 'longueur_bornee' AS evaluator, count(*) AS cases, count(*) FILTER (length(original) > 0 AND length(rewrite) <= 2 * length(original)) AS passed FROM pairs
UNION ALL SELECT 'reste_francais', count(*), count(*) FILTER ({_count_words('rewrite', V.FRENCH_WORDS)} > {_count_words('rewrite', V.ENGLISH_WORDS)}) FROM pairs
UNION ALL SELECT 'sans_adresse_directe', count(*), count(*) FILTER ({_count_words('rewrite', V.ADDRESS_WORDS)} <= {_count_words('original', V.ADDRESS_WORDS)}) FROM pairs
UNION ALL SELECT 'sans_invention', count(*), count(*) FILTER (label = 'conforme') FROM ({_invention('pairs')})
UNION ALL SELECT 'prompt_pas_explication', count(*), count(*) FILTER (label = 'conforme') FROM ({_COMMENT})
UNION ALL SELECT 'couverture_rubrique', count(*), count(*) FILTER ({_essential('rewrite')} >= {_essential('original')}) FROM pairs""", "pairs")
def v26(t):
    return C.evaluator_summary(C.evaluate("reecriture", pairs(t))).select("evaluator", "cases", "passed")


# ------------------------------------------------------------------------------------------ claims
part("tokens")(r"SELECT doc_id, unnest(string_split_regex(text, '[^\p{L}\p{N}_''’-]+')) AS w FROM documents")
part("names")(r"""
SELECT DISTINCT entity, kind, air, cloaked, detector FROM (SELECT entity, CASE WHEN strlen(entity) % 7 = 0 THEN 'building' ELSE 'unit' END AS kind, strlen(entity) % 2 = 0 AS air, strlen(entity) % 3 = 0 AS cloaked, strlen(entity) % 5 = 0 AS detector FROM (
 SELECT CASE WHEN k = 1 THEN a ELSE a || ' ' || b END AS entity FROM (
  SELECT s AS a, lead(s) OVER d AS gap, lead(s, 2) OVER d AS b FROM (SELECT n, unnest(p) AS s, unnest(range(len(p))) AS i FROM (
   SELECT row_number() OVER () AS n, regexp_extract_all(text, '[\p{L}\p{N}_''’-]+|[^\p{L}\p{N}_''’-]+') AS p FROM conversations)) WINDOW d AS (PARTITION BY n ORDER BY i)) w, (SELECT unnest([1, 2]) AS k) k
 WHERE regexp_full_match(a, '[A-ZÀ-Þ][a-zà-ÿ]{2,}') AND (k = 1 OR (gap = ' ' AND regexp_full_match(b, '[A-ZÀ-Þ][a-zà-ÿ]{2,}')))))""")
part("pieces")(r"SELECT doc_id, unnest(p) AS s, unnest(range(len(p))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_''’-]+|[^\p{L}\p{N}_''’-]+') AS p FROM documents)")
part("named", "pieces", "names")(r"""
SELECT DISTINCT doc_id, n.* EXCLUDE (form) FROM (SELECT doc_id, lower(s) AS run FROM pieces UNION SELECT doc_id, lower(s || lead(s) OVER d || lead(s, 2) OVER d) FROM pieces WINDOW d AS (PARTITION BY doc_id ORDER BY i)) r
JOIN (SELECT *, unnest([lower(entity), lower(entity) || 's']) AS form FROM names) n ON r.run = n.form""")


def entities(t):
    """The dictionary, stored once: several joins use it."""
    if not hasattr(t, "_entities"):
        t._entities = stored(_entities(t), "entities")
    return t._entities


def _entities(t):
    """All capitalised words of the conversations and all pairs of neighbouring ones, whatever their number."""
    text, cap = t.raw("conversations").select("text"), "[A-ZÀ-Þ][a-zà-ÿ]{2,}"
    edge = r"[\w'’-]"
    one = text.select(F.explode(F.regexp_extract_all("text", F.lit(f"(?U)(?<!{edge}){cap}(?!{edge})"), F.lit(0))).alias("entity"))
    two = text.select(F.explode(F.regexp_extract_all("text", F.lit(f"(?U)(?<!{edge})(?=({cap} {cap})(?!{edge}))"), F.lit(1))).alias("entity"))
    n = F.octet_length("entity")
    return one.unionByName(two).distinct().select("entity", F.col("entity").alias("alias"), F.when(n % 7 == 0, "building").otherwise("unit").alias("kind"), F.lit("Zerg").alias("side"),
                                                  (n % 2 == 0).alias("air"), (n % 3 == 0).alias("cloaked"), (n % 5 == 0).alias("detector"))


def texts(t):
    return t.raw("documents").select(F.col("doc_id").alias("text_id"), "text", F.when(F.col("doc_id") % 2 == 0, "Terran").otherwise("Zerg").alias("side"), F.col("lang").alias("pack"))


@query("j16_dictionary_mentions", "SELECT doc_id AS text_id, entity FROM named", "named")
def j16(t):
    return L.mentions(texts(t), entities(t))


_COMMON = ", ".join("'" + w.lower().replace("'", "''") + "'" for w in V.CLAIM_COMMON_WORDS)
_SIDES = ", ".join(f"'{w}'" for w in V.CLAIM_SIDE_NAMES)
# words and gaps by number; ``joins``: the word can end a pair whose first word is the one before it; in a chain of such words every second one starts a name
part("unknown", "names")(rf"""
WITH q AS (SELECT doc_id, s, i, lag(s) OVER d AS before, lead(s) OVER d AS gap, lead(s, 2) OVER d AS next_word FROM (
   SELECT doc_id, unnest(p) AS s, unnest(range(len(p))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') AS p FROM documents)) WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
 w AS (SELECT *, before IS NOT NULL AND regexp_full_match(s, '[A-ZÀ-Þ][a-zà-ÿ]{{2,}}') AND NOT regexp_matches(before, '[.!?…]\s$') AS starts, coalesce(regexp_full_match(s, '[A-ZÀ-Þ][a-zà-ÿ]+') AND regexp_full_match(before, '\s+'), false) AS ends
  FROM q WHERE regexp_matches(s, '^[\p{{L}}\p{{N}}_]')),
 l AS (SELECT *, ends AND coalesce(lag(starts) OVER d, false) AS joins, coalesce(lead(ends) OVER d, false) AS goes_on FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
 c AS (SELECT *, (i - max(CASE WHEN NOT joins THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)) // 2 % 2 = 0 AS even FROM l),
 f AS (SELECT doc_id, CASE WHEN goes_on THEN s || gap || next_word ELSE s END AS candidate FROM c WHERE starts AND even)
SELECT doc_id, candidate FROM f WHERE lower(candidate) NOT IN ({_COMMON}) AND candidate NOT IN ({_SIDES}) AND lower(candidate) NOT IN (SELECT lower(entity) FROM names)
 AND string_split(lower(candidate), ' ')[1] NOT IN (SELECT lower(entity) FROM names) AND lower(candidate) NOT IN (SELECT string_split(lower(entity), ' ')[1] FROM names WHERE contains(entity, ' '))""")

_CLAIM = rf"""
WITH m AS (SELECT doc_id, bool_or(kind = 'unit') AS named, bool_or(kind = 'unit' AND air) AS air, bool_or(kind = 'unit' AND cloaked) AS cloaked, bool_or(kind = 'unit' AND detector) AS detector FROM named GROUP BY doc_id),
 x AS (SELECT d.doc_id, d.lang, d.text, m.doc_id IS NOT NULL AS anchored, coalesce(m.named, false) AS named, coalesce(m.air, false) AS air, coalesce(m.cloaked, false) AS cloaked, coalesce(m.detector, false) OR regexp_matches(d.text, '(?i)(^|[^\p{{L}}\p{{N}}_])scan([^\p{{L}}\p{{N}}_]|$)') AS answer FROM documents d LEFT JOIN m USING (doc_id)),
 issues AS (SELECT doc_id, 'Erreur' AS level, 'invisible sans nom' AS rule FROM x WHERE regexp_matches(text, '(?i){V.CLAIM_THREAT}') AND NOT cloaked AND NOT answer
  UNION ALL SELECT doc_id, 'Erreur', 'anti-aérien sans air' FROM x WHERE regexp_matches(text, '(?i){V.CLAIM_ANTI_AIR.replace("'", "''")}') AND NOT air
  UNION ALL SELECT doc_id, 'Erreur', 'détection mal attribuée' FROM x WHERE NOT (regexp_matches(text, '(?i){V.CLAIM_THREAT}') AND NOT cloaked AND NOT answer) AND regexp_matches(text, '(?i){V.CLAIM_DETECTION}') AND named AND NOT cloaked AND NOT answer
  UNION ALL SELECT doc_id, 'Erreur', 'supply d''avant-patch' FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i){V.CLAIM_OUTDATED}')) FROM x)
  UNION ALL SELECT doc_id, 'Erreur', 'mauvais camp' FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:tes|ton|ta|mes|mon|ma|nos|notre)\s+([A-Za-zÀ-ÿ][\p{{L}}\p{{N}}_''’-]*)', 1)) AS word FROM x WHERE doc_id % 2 = 0)
    JOIN names ON lower(entity) = lower(word) AND kind = 'unit'
  UNION ALL SELECT doc_id, 'Doute', 'sans ancrage' FROM x WHERE NOT anchored
  UNION ALL SELECT doc_id, 'Doute', 'unité inconnue' FROM unknown)
"""


def no_terms(t):
    return t.spark.createDataFrame([], "term string")


@query("v13_text_claims", _CLAIM + "SELECT doc_id AS text_id, level, rule FROM issues", "named", "unknown")
def v13(t):
    return L.check_claims(texts(t), entities(t), no_terms(t)).select("text_id", "level", "rule")


@query("v13_unknown_names", "SELECT doc_id AS text_id, candidate FROM unknown", "unknown")
def v13b(t):
    return L.unknown_names(texts(t), entities(t), no_terms(t))


@query("v14_pack_lint", _CLAIM + """, p AS (SELECT doc_id, count(*) FILTER (level = 'Erreur') AS e, count(*) FILTER (level = 'Doute') AS d FROM issues GROUP BY doc_id)
SELECT lang AS pack, count(*) AS texts, count(*) FILTER (p.doc_id IS NULL) AS clean, CAST(coalesce(sum(e), 0) AS BIGINT) AS errors, CAST(coalesce(sum(d), 0) AS BIGINT) AS doubts, CASE WHEN coalesce(sum(e), 0) = 0 THEN 'conforme' ELSE 'non_conforme' END AS label
FROM documents LEFT JOIN p USING (doc_id) GROUP BY lang""", "named", "unknown")
def v14(t):
    return L.lint_summary(texts(t), L.check_claims(texts(t), entities(t), no_terms(t)))


@query("v15_expected_rules", """
WITH g AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS got FROM orders GROUP BY ALL), e AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN ['F', 'O', 'P'] ELSE ['F', 'O'] END AS want FROM customer)
SELECT c_custkey AS text_id, array_to_string(list_filter(want, lambda x: NOT list_contains(coalesce(got, []), x)), ',') AS missing, array_to_string(list_filter(coalesce(got, []), lambda x: NOT list_contains(want, x)), ',') AS superfluous,
 CASE WHEN coalesce(got, []) = want THEN 'conforme' ELSE 'non_conforme' END AS label FROM e LEFT JOIN g ON o_custkey = c_custkey""")
def v15(t):
    expected = t.raw("customer").select(F.col("c_custkey").alias("text_id"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN array('F', 'O', 'P') ELSE array('F', 'O') END").alias("rules"))
    issues = t.raw("orders").select(F.col("o_custkey").alias("text_id"), F.col("o_orderstatus").alias("rule"))
    r = L.judge_rules(expected, issues)
    return r.select("text_id", F.array_join("missing", ",").alias("missing"), F.array_join("superfluous", ",").alias("superfluous"), "label")


@query("e04_rules_missing_superfluous", """
SELECT c_custkey AS text_id, array_to_string(list_filter(['F', 'O'], lambda x: NOT list_contains(coalesce(got, []), x)), ',') AS missing, list_contains(coalesce(got, []), 'P') AS has_extra
FROM customer LEFT JOIN (SELECT o_custkey, list(DISTINCT o_orderstatus) AS got FROM orders GROUP BY ALL) ON o_custkey = c_custkey""")
def e04(t):
    expected = t.raw("customer").select(F.col("c_custkey").alias("text_id"), X.const(["F", "O"]).alias("rules"))
    r = L.judge_rules(expected, t.raw("orders").select(F.col("o_custkey").alias("text_id"), F.col("o_orderstatus").alias("rule")))
    return r.select("text_id", F.array_join("missing", ",").alias("missing"), (F.size("superfluous") > 0).alias("has_extra"))


part("names17")("SELECT p_name AS alias, min(p_partkey) AS entity FROM part GROUP BY p_name")
part("asked")("SELECT c_custkey AS request_id, CASE c_custkey % 4 WHEN 0 THEN upper(replace(p_name, ' ', '-')) WHEN 1 THEN substring(p_name, 3, 5) WHEN 2 THEN 'the ' || p_name || ' one' ELSE 'zz' END AS asked FROM customer JOIN part ON p_partkey = c_custkey")


@query("j17_alias_lookup", """
WITH h AS (SELECT a.request_id, n.entity FROM asked a JOIN names17 n ON replace(lower(a.asked), '-', ' ') = n.alias),
 s AS (SELECT a.request_id, n.entity FROM asked a JOIN names17 n ON contains(n.alias, lower(a.asked)) OR contains(lower(a.asked), n.alias) WHERE a.request_id NOT IN (SELECT request_id FROM h) QUALIFY row_number() OVER (PARTITION BY a.request_id ORDER BY n.entity) <= 5)
SELECT a.request_id, h.entity, CASE WHEN h.entity IS NULL THEN coalesce((SELECT array_to_string(list(s.entity ORDER BY s.entity), ',') FROM s WHERE s.request_id = a.request_id), '') END AS suggestions FROM asked a LEFT JOIN h USING (request_id)""", "asked", "names17")
def j17(t):
    p = t.raw("part")
    names = p.groupBy(F.col("p_name").alias("alias")).agg(F.min("p_partkey").alias("entity"))
    names = names.select("alias", F.format_string("%09d", "entity").alias("entity"))
    req = t.raw("customer").join(p, F.col("p_partkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("request_id"), F.expr(
        "CASE c_custkey % 4 WHEN 0 THEN upper(replace(p_name, ' ', '-')) WHEN 1 THEN substring(p_name, 3, 5) WHEN 2 THEN concat('the ', p_name, ' one') ELSE 'zz' END").alias("asked"))
    r = L.lookup(req, names)
    return r.select("request_id", F.col("entity").cast("bigint").alias("entity"), F.array_join(F.transform("suggestions", lambda x: x.cast("bigint").cast("string")), ",").alias("suggestions"))


@query("j17_term_lookup", """
WITH terms AS (SELECT DISTINCT p_type AS term, 'mechanic' AS kind, 0 AS rank FROM part UNION ALL SELECT DISTINCT p_brand, 'slang', 1 FROM part),
 a AS (SELECT c_custkey AS request_id, CASE c_custkey % 5 WHEN 0 THEN lower(replace(p_type, ' ', '-')) WHEN 1 THEN upper(p_brand) WHEN 2 THEN p_name WHEN 3 THEN substring(p_type, 4, 6) ELSE 'zz' || p_type END AS asked FROM customer JOIN part ON p_partkey = c_custkey),
 t AS (SELECT a.request_id, arg_min(term, (rank, term)) AS term, arg_min(kind, (rank, term)) AS kind FROM a JOIN terms ON replace(lower(asked), '-', ' ') = replace(lower(term), '-', ' ') GROUP BY ALL),
 e AS (SELECT a.request_id, min(p_partkey) AS entity FROM a JOIN part ON replace(lower(asked), '-', ' ') = replace(lower(p_name), '-', ' ') GROUP BY ALL),
 g AS (SELECT a.*, coalesce(t.kind, CASE WHEN e.entity IS NOT NULL THEN 'entity' END) AS kind, coalesce(t.term, e.entity::VARCHAR) AS found FROM a LEFT JOIN t USING (request_id) LEFT JOIN e USING (request_id)),
 h AS (SELECT g.request_id, term, row_number() OVER (PARTITION BY g.request_id ORDER BY rank, term) AS r FROM g JOIN terms ON contains(lower(term), lower(asked)) WHERE g.kind IS NULL QUALIFY r <= 5)
SELECT request_id, kind, found, CASE WHEN kind IS NULL THEN coalesce((SELECT string_agg(term, ',' ORDER BY r) FROM h WHERE h.request_id = g.request_id), '') END AS suggestions FROM g""")
def j17b(t):
    p = t.raw("part")
    terms = p.select(F.col("p_type").alias("term"), F.lit("mechanic").alias("kind")).union(p.select("p_brand", F.lit("slang"))).distinct()
    req = t.raw("customer").join(p, F.col("p_partkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("request_id"), F.expr(
        "CASE c_custkey % 5 WHEN 0 THEN lower(replace(p_type, ' ', '-')) WHEN 1 THEN upper(p_brand) WHEN 2 THEN p_name WHEN 3 THEN substring(p_type, 4, 6) ELSE concat('zz', p_type) END").alias("asked"))
    r = L.lookup_terms(req, terms, p.select(F.col("p_name").alias("alias"), F.col("p_partkey").alias("entity")))
    return r.select("request_id", "kind", "found", F.array_join("suggestions", ",").alias("suggestions"))


@query("j18_situations", """
WITH k AS (SELECT p_partkey AS id, p_type AS signal, p_size % 5 AS level FROM part), r AS (SELECT c_custkey AS request_id, CASE c_custkey % 3 WHEN 0 THEN 'economy' WHEN 1 THEN 'none' END AS signal, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey % 6 END AS level FROM customer)
SELECT request_id, count(k.id) AS found, min(k.id) AS first, CASE WHEN count(k.id) = 0 THEN (SELECT array_to_string(list_sort(list(DISTINCT p_type)), ', ') FROM part) END AS covered FROM r
LEFT JOIN k ON (r.signal IS NULL OR lower(k.signal) = r.signal) AND (r.level IS NULL OR k.level = r.level) AND NOT (r.signal IS NULL AND r.level IS NULL) GROUP BY request_id""")
def j18(t):
    k = t.raw("part").select(F.col("p_partkey").alias("situation_id"), F.col("p_type").alias("signal"), (F.col("p_size") % 5).alias("level"))
    r = t.raw("customer").select(F.col("c_custkey").alias("request_id"), F.expr("CASE c_custkey % 3 WHEN 0 THEN 'Economy' WHEN 1 THEN 'none' END").alias("signal"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN c_nationkey % 6 END").alias("level"))
    return L.situations(r, k)


# ------------------------------------------------------------------------------ verdicts and gates
part("label_verdicts")("""
SELECT doc_id AS case_id, CASE doc_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS evaluator, CASE quality WHEN 1 THEN 'conforme' ELSE CASE WHEN toxic = 1 THEN 'Non_Conforme' ELSE CASE WHEN doc_id % 5 = 0 THEN 'bizarre' ELSE 'indeterminable' END END END AS raw, doc_id % 7 <> 0 AS deterministic FROM labels""")
part("scored", "label_verdicts")("""
SELECT case_id, evaluator, deterministic, CASE WHEN lower(raw) IN ('conforme', 'non_conforme', 'indeterminable') THEN raw ELSE 'indeterminable' END AS label, CASE lower(raw) WHEN 'conforme' THEN 1.0 WHEN 'non_conforme' THEN 0.0 END AS score FROM label_verdicts""")


def verdicts(t):
    v = t.raw("labels").select(F.col("doc_id").alias("case_id"), F.expr("CASE doc_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END").alias("evaluator"), F.lit("conformite").alias("scale"), F.expr(
        "CASE quality WHEN 1 THEN 'conforme' ELSE CASE WHEN toxic = 1 THEN 'Non_Conforme' ELSE CASE WHEN doc_id % 5 = 0 THEN 'bizarre' ELSE 'indeterminable' END END END").alias("label"), (F.col("doc_id") % 7 != 0).alias("deterministic"))
    return C.score_labels(v)


@query("r09_label_scores", "SELECT case_id, label, score FROM scored", "scored")
def r09(t):
    return verdicts(t).select("case_id", "label", "score")


@query("a19_evaluator_summary", """
SELECT evaluator, count(*) AS cases, count(*) FILTER (score = 1) AS passed, count(*) FILTER (score = 0) AS failed, count(*) FILTER (score IS NULL) AS undecided,
 round(count(*) FILTER (score = 1) / count(*) FILTER (score IS NOT NULL), 6) AS rate FROM scored GROUP BY evaluator""", "scored")
def a19(t):
    return C.evaluator_summary(verdicts(t)).withColumn("rate", r6("rate"))


@query("r12_approved_extract", """
SELECT case_id || '|' || evaluator AS key, label FROM scored WHERE deterministic""", "scored")
def r12(t):
    return C.approved_extract(verdicts(t).withColumn("case_id", F.col("case_id").cast("string")))


@query("r12_set_fingerprint", """
WITH h AS (SELECT sha256(case_id || '|' || evaluator || '|' || label) AS h FROM scored WHERE deterministic)
SELECT substring(sha256(sum(CAST(('0x' || substring(h, 1, 14)) AS HUGEINT)) || '|' || sum(CAST(('0x' || substring(h, 15, 14)) AS HUGEINT)) || '|' || sum(CAST(('0x' || substring(h, 29, 14)) AS HUGEINT)) || '|'
 || sum(CAST(('0x' || substring(h, 43, 14)) AS HUGEINT)) || '|' || count(*)), 1, 16) AS fingerprint FROM h""", "scored")
def r12b(t):
    v = verdicts(t).filter("deterministic")
    return C.set_fingerprint(v, F.concat_ws("|", F.col("case_id").cast("string"), "evaluator", "label"))


_CMP = """
SELECT coalesce(a.case_id, c.case_id) AS case_id, coalesce(a.evaluator, c.evaluator) AS evaluator, coalesce(a.label, '—') AS before, coalesce(c.label, '—') AS after,
 CASE WHEN c.case_id IS NULL THEN 'disparu' WHEN c.score IS NULL THEN NULL WHEN a.case_id IS NULL THEN 'nouveau' WHEN a.label = c.label THEN NULL WHEN a.label = 'conforme' THEN 'régression' ELSE 'progrès' END AS way
FROM (SELECT o_custkey AS case_id, o_orderpriority AS evaluator, CASE WHEN sum(o_totalprice) > 300000 THEN 'conforme' ELSE 'non_conforme' END AS label FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL) a
FULL JOIN (SELECT o_custkey AS case_id, o_orderpriority AS evaluator, CASE WHEN count(*) > 3 THEN 'indeterminable' WHEN sum(o_totalprice) > 300000 THEN 'conforme' ELSE 'non_conforme' END AS label,
 CASE WHEN count(*) > 3 THEN NULL WHEN sum(o_totalprice) > 300000 THEN 1.0 ELSE 0.0 END AS score FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL) c ON a.case_id = c.case_id AND a.evaluator = c.evaluator"""


def revisions(t):
    o = t.raw("orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("evaluator"), "o_totalprice", "o_orderkey")

    def half(rest: int, doubt: bool):
        s = F.when(F.sum("o_totalprice") > 300000, "conforme").otherwise("non_conforme")
        label = F.when(F.count(F.lit(1)) > 3, "indeterminable").otherwise(s) if doubt else s
        return o.filter(F.col("o_orderkey") % 2 == rest).groupBy("case_id", "evaluator").agg(label.alias("label")).withColumn("scale", F.lit("conformite"))
    return half(0, False), C.score_labels(half(1, True))


@query("j09_approved_comparison", f"SELECT * FROM ({_CMP}) WHERE way IS NOT NULL")
def j09(t):
    before, now = revisions(t)
    return C.compare_with_approved(before, now)


@query("r10_gate_code", f"""
SELECT (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1)) AS measured, (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0)) AS approved,
 (SELECT count(*) FROM ({_CMP}) WHERE way IS NOT NULL) AS moved, 1 AS code""")
def r10(t):
    before, now = revisions(t)
    return C.gate(now, before, C.compare_with_approved(before, now))


@query("j08_campaign_pairs", """
SELECT doc_id AS case_id, lang AS family, e AS evaluator FROM documents JOIN (VALUES ('fr', 'e1'), ('fr', 'e2'), ('en', 'e3'), ('es', 'e4')) v(f, e) ON v.f = lang WHERE lang IN ('fr', 'en')
UNION ALL SELECT doc_id, lang, 'no producer for family ' || lang FROM documents WHERE lang NOT IN ('fr', 'en')""")
def j08(t):
    cases = t.raw("documents").select(F.col("doc_id").alias("case_id"), F.col("lang").alias("family"))
    producers = t.spark.createDataFrame([("fr", "p1"), ("en", "p2")], "family string, producer string")
    evaluators = t.spark.createDataFrame([("fr", "e1"), ("fr", "e2"), ("en", "e3"), ("es", "e4")], "family string, evaluator string")
    pairs_, orphans = C.run_campaign(cases, producers, evaluators)
    return pairs_.select("case_id", "family", "evaluator").unionByName(orphans.join(cases, "case_id").select("case_id", "family", F.col("warning").alias("evaluator")))


@query("j20_judge_agreement", """
WITH c AS (SELECT doc_id, CASE WHEN n_chars > 1500 THEN 'conforme' WHEN n_chars > 300 THEN 'non_conforme' END AS code, CASE quality WHEN 1 THEN 'conforme' WHEN 0 THEN CASE WHEN toxic = 1 THEN 'doute' ELSE 'non_conforme' END END AS judge FROM documents LEFT JOIN labels USING (doc_id))
SELECT CASE WHEN code IS NULL OR judge IS NULL THEN 'indeterminable' WHEN judge = 'doute' THEN 'douteux' WHEN judge = code THEN 'accord' ELSE 'desaccord' END AS label, count(*) AS n FROM c GROUP BY 1""")
def j20(t):
    code = C.score_labels(t.raw("documents").select(F.col("doc_id").alias("case_id"), F.lit("conformite").alias("scale"), F.expr(
        "CASE WHEN n_chars > 1500 THEN 'conforme' WHEN n_chars > 300 THEN 'non_conforme' ELSE 'indeterminable' END").alias("label")))
    judge = t.raw("labels").select(F.col("doc_id").alias("case_id"), F.expr("CASE quality WHEN 1 THEN 'conforme' ELSE CASE WHEN toxic = 1 THEN 'doute' ELSE 'non_conforme' END END").alias("label"))
    return RW.agreement_counts(RW.judge_agreement(code, judge))


@query("a23_cohen_kappa", """
SELECT n, round_even((po - pe) / (1 - pe), 4) AS kappa FROM (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe FROM (SELECT count(*) AS n, avg(CAST(quality = toxic AS INT)) AS po, avg(quality) AS pa, avg(toxic) AS pb FROM labels))""")
def a23(t):
    return Q.kappa(t.raw("labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b")), "a", "b").select("n", "kappa")


# ------------------------------------------------------------------------------------ publication
part("examples")(r"""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '{"input":{"id":"' || doc_id || '"},"output":{"intitule":"' || source || '"}' ELSE '{"input":{"entree":"' || lang || '"},"output":{"attendu":"' || n_chars || '"}' END
 || ',"metadata":{"epreuve_id":"' || doc_id || '","etiquettes":"' || lang || ',' || source || '","famille":"' || lang || '","intitule":"' || source || '","origine":"' || CASE WHEN doc_id % 10 = 0 THEN 'transcript' ELSE 'synthetique' END || '"}}' AS canonical FROM documents""")


def example_cases(t):
    return C.canonical_example(t.raw("documents").select(
        F.col("doc_id").cast("string").alias("case_id"), F.col("lang").alias("family"), F.col("source").alias("title"), F.when(F.col("doc_id") % 10 == 0, "transcript").otherwise("synthetique").alias("origin"),
        (F.col("doc_id") % 5 != 0).alias("shareable"), F.array("lang", "source").alias("tags"), F.col("lang").alias("input_json"), F.col("n_chars").cast("string").alias("expected_json")))


@query("v25_canonical_fingerprint", "SELECT CAST(doc_id AS VARCHAR) AS case_id, sha256(canonical) AS fingerprint FROM examples", "examples")
def v25(t):
    return example_cases(t).select("case_id", "fingerprint")


@query("j10_missing_examples", "SELECT CAST(doc_id AS VARCHAR) AS case_id FROM documents WHERE doc_id % 3 = 0 OR doc_id % 4 = 0")
def j10(t):
    c = example_cases(t)
    remote = c.filter("CAST(case_id AS BIGINT) % 3 <> 0").select("case_id", F.when(F.col("case_id").cast("bigint") % 4 == 0, "stale").otherwise(F.col("fingerprint")).alias("fingerprint"))
    return C.missing_examples(c, remote).select("case_id")


@query("j11_attached_examples", """
SELECT CAST(doc_id AS VARCHAR) AS case_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 'a' || doc_id WHEN doc_id % 2 = 0 THEN 'b' || doc_id ELSE 'c' || doc_id END AS example_id,
 CASE WHEN doc_id % 3 = 0 THEN 'no example' WHEN doc_id % 3 = 2 THEN 'several examples' END AS warning FROM documents""")
def j11(t):
    c = example_cases(t).select("case_id", "fingerprint").withColumn("id", F.col("case_id").cast("bigint"))
    a = c.filter("id % 3 <> 0").select("case_id", "fingerprint", F.concat(F.lit("a"), "case_id").alias("example_id"), F.lit(1).alias("position"), F.lit(None).cast("timestamp").alias("updated_at"))
    b = c.filter("id % 3 = 2").select("case_id", "fingerprint", F.concat(F.lit("b"), "case_id").alias("example_id"), F.lit(2).alias("position"), F.expr("CASE WHEN id % 2 = 0 THEN timestamp'2024-01-05' END").alias("updated_at"))
    d = c.filter("id % 3 = 2").select("case_id", "fingerprint", F.concat(F.lit("c"), "case_id").alias("example_id"), F.lit(3).alias("position"), F.expr("CASE WHEN id % 2 = 0 THEN timestamp'2024-01-02' END").alias("updated_at"))
    return C.attach_examples(c.drop("id"), a.unionByName(b).unionByName(d)).select("case_id", "example_id", "warning")


@query("e07_append_new", """
WITH e AS (SELECT lang, lower(text) AS low FROM documents WHERE source = (SELECT min(source) FROM documents)), p AS (SELECT lang, lower(text) AS low, min(doc_id) AS id FROM documents WHERE source <> (SELECT min(source) FROM documents) GROUP BY ALL)
SELECT lang, false AS added, count(*) AS n FROM e GROUP BY lang UNION ALL SELECT lang, true, count(*) FROM p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.lang = p.lang AND e.low = p.low) GROUP BY lang""")
def e07(t):
    d = t.raw("documents").select("doc_id", "lang", "source", F.col("text").alias("phrase"))
    first = F.broadcast(d.agg(F.min("source").alias("first")))               # one row
    d = d.crossJoin(first)
    old, new = d.filter("source = first").drop("first"), d.filter("source <> first").drop("first")
    return C.append_new(old, new, "phrase", ["lang"], ["doc_id"]).groupBy("lang", "added").agg(F.count(F.lit(1)).alias("n"))


@query("e06_distinct_sets", "SELECT count(DISTINCT user_id) AS sessions, count(DISTINCT event_type) AS tools, count(DISTINCT event_type) FILTER (event_id % 6 = 0) AS failed_tools FROM events")
def e06(t):
    return t.raw("events").agg(F.count_distinct("user_id").alias("sessions"), F.count_distinct("event_type").alias("tools"), F.count_distinct(F.when(F.col("event_id") % 6 == 0, F.col("event_type"))).alias("failed_tools"))


@query("k10_histogram_top", "SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def k10(t):
    from turnstone.operators.transcript import histogram, top_n
    return top_n(histogram(t.raw("events"), "event_type"), 3)


@query("s13_snapshot_outcome", """
WITH a AS (SELECT o_custkey, list_sort(list(o_orderpriority)) AS x FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL), b AS (SELECT o_custkey, list_sort(list(o_orderpriority)) AS x FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.x IS NULL THEN 'created' WHEN b.x IS NULL THEN 'absent' WHEN a.x = b.x THEN 'unchanged' ELSE 'archived' END AS outcome FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""")
def s13(t):
    o = t.raw("orders").select("o_custkey", "o_orderpriority", "o_orderkey")
    return P.write_outcomes(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1"), "o_custkey", F.col("o_orderpriority"))


@query("s13_written_versions", """
WITH a AS (SELECT o_custkey, list_sort(list(o_orderpriority)) AS x FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL), b AS (SELECT o_custkey, list_sort(list(o_orderpriority)) AS x FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN b.x IS NULL OR a.x = b.x THEN 's1' ELSE 's2' END AS stamp, CASE WHEN b.x IS NULL OR a.x = b.x THEN len(a.x) ELSE len(b.x) END AS current_rows,
 CASE WHEN a.x IS NOT NULL AND b.x IS NOT NULL AND a.x <> b.x THEN len(a.x) ELSE 0 END AS archived_rows FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""")
def s13w(t):
    path = f"{shared_dir(t.spark)}/versions-{uuid.uuid4().hex}"
    o = t.raw("orders")
    for stamp, odd in (("s1", 0), ("s2", 1), ("s2", 1)):                 # the last write is repeated
        P.write_snapshot(o.filter(f"o_orderkey % 2 = {odd}").select("o_custkey", "o_orderpriority"), path, "o_custkey", stamp)
    v = P.read_versions(t.spark, path, "o_custkey", o.select("o_custkey", "o_orderpriority").schema)
    return v.groupBy("o_custkey").agg(F.max(F.when(F.col("is_current"), F.col("stamp"))).alias("stamp"), F.count_if("is_current").alias("current_rows"), F.count_if(~F.col("is_current")).alias("archived_rows"))


@query("s14_version_history", """
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE epoch_us(TIMESTAMP '2024-01-01 00:00:00' + (doc_id % 400) * INTERVAL 1 HOUR) END AS stamp_us, CASE WHEN doc_id % 11 <> 0 AND doc_id % 3 = 0 THEN CAST(2 + doc_id % 9 AS INT) ELSE 1 END AS rank FROM documents WHERE doc_id % 2 = 0""")
def s14(t):
    d = t.raw("documents").select("doc_id")
    stamp = F.date_format(F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(doc_id % 400 AS int))"), "yyyyMMdd-HHmm")
    week = F.when(F.col("doc_id") % 2 == 0, "2026-W34").otherwise("2026-W35")
    name = F.concat(week, F.lit("-"), F.when(F.col("doc_id") % 11 == 0, "odd").otherwise(F.concat(stamp, F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("-"), (2 + F.col("doc_id") % 9).cast("string"))).otherwise(""))), F.lit(".html"))
    return P.version_history(d.select("doc_id", name.alias("name")), "2026-W34").select("doc_id", F.unix_micros("stamp").alias("stamp_us"), "rank")
