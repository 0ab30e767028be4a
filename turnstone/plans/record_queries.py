"""Per-row projections and predicates over the driver tables (P, F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstone.functions import exprs as X
from turnstone.functions import fixed_values as V
from turnstone.functions import rewrite as R
from turnstone.operators.turns import is_human_prompt, user_text
from turnstone.plans.oracle_base import words
from turnstone.plans.registry import query, r6


def _user_message():
    """Every other message carries its text in blocks."""
    blocks = F.to_json(F.struct(F.array(
        F.struct(F.lit("text").alias("type"), F.substring("text", 1, 10).alias("text")),
        F.struct(F.lit("tool_result").alias("type"), F.lit("ignored").alias("text")),
        F.struct(F.lit("text").alias("type"), F.expr("substring(text, 11)").alias("text"))).alias("content")))
    return F.try_parse_json(F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.col("text").alias("content")))).otherwise(blocks))


@query("p01_user_text", """
SELECT conv_id, turn, sha256(CASE WHEN turn % 2 = 0 THEN text WHEN length(text) > 10 THEN substring(text, 1, 10) || chr(10) || substring(text, 11)
  ELSE text END) AS text_hash FROM conversations""")
def p01(t):
    return t.raw("conversations").select("conv_id", "turn", F.sha2(user_text(_user_message()), 256).alias("text_hash"))


@query("p02_human_prompt", """
SELECT role, count(*) AS lines, count(*) FILTER (role = 'user' AND turn % 7 <> 3 AND trim(text) <> '' AND conv_id % 5 <> 0
  AND conv_id % 3 <> 2) AS human FROM conversations GROUP BY role""")
def p02(t):
    c = t.raw("conversations")
    text = F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("<System-Reminder>"), "text")).otherwise(F.col("text"))
    origin = F.expr("CASE conv_id % 3 WHEN 1 THEN 'Human' WHEN 2 THEN 'agent' END")
    human = is_human_prompt("role", F.col("turn") % 7 == 3, text, origin)
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("lines"), F.count_if(human).alias("human"))


def _assistant_message():
    """An assistant line with as many tool blocks as the step started, and a usage object that lacks a field now and then."""
    return F.try_parse_json(F.expr("""concat(
      '{"model":"', model, '","content":[{"type":"text","text":"t"},',
      array_join(transform(sequence(1, tool_blocks), i -> concat('{"type":"tool_use","id":"', call_id, '-', i, '","name":"', name, '","input":', input_json, '}')), ','),
      ',3],"usage":{"input_tokens":', input_tokens,
      CASE WHEN call_id % 2 = 0 THEN concat(',"cache_read_input_tokens":', cache_read_tokens) ELSE ',"cache_read_input_tokens":"n/a"' END,
      CASE WHEN call_id % 5 = 0 THEN '' ELSE concat(',"output_tokens":', output_tokens) END, '}}')"""))


@query("p03_tool_use_blocks", """
SELECT name, CAST(sum(tool_blocks) AS BIGINT) AS blocks, count(DISTINCT input_json) AS inputs FROM calls GROUP BY name""", "calls")
def p03(t):
    from turnstone.operators.transcript import tool_use_blocks
    rows = t.calls.select("call_id", _assistant_message().alias("message"))
    return tool_use_blocks(rows, "message", ["call_id"]).groupBy("name").agg(
        F.count(F.lit(1)).alias("blocks"), F.count_distinct("input_json").alias("inputs"))


@query("p04_usage_counters", """
SELECT model, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens,
  CAST(0 AS BIGINT) AS cache_creation_tokens, CAST(sum(CASE WHEN call_id % 5 = 0 THEN 0 ELSE output_tokens END) AS BIGINT) AS output_tokens
FROM calls GROUP BY model""", "calls")
def p04(t):
    from turnstone.operators.transcript import usage_counter
    m = t.calls.select("model", _assistant_message().alias("message"))
    return m.groupBy("model").agg(*[F.sum(usage_counter("message", f)).alias(a) for f, a in [
        ("input_tokens", "input_tokens"), ("cache_read_input_tokens", "cache_read_tokens"),
        ("cache_creation_input_tokens", "cache_creation_tokens"), ("output_tokens", "output_tokens")]])


@query("p05_total_input", "SELECT session_id, CAST(sum(total_in) AS BIGINT) AS total_in, max(total_in) AS peak FROM calls GROUP BY session_id", "calls")
def p05(t):
    total = X.total_input("input_tokens", "cache_read_tokens", "cache_creation_tokens")
    return t.calls.groupBy("session_id").agg(F.sum(total).alias("total_in"), F.max(total).alias("peak"))


@query("p06_mcp_server", """
SELECT split_part(name, '__', 2) AS server, count(*) AS calls FROM calls WHERE name LIKE 'mcp%' GROUP BY 1""", "calls")
def p06(t):
    return t.calls.filter(X.is_mcp("name")).groupBy(X.mcp_server("name").alias("server")).agg(F.count(F.lit(1)).alias("calls"))


@query("p07_model_family", """
SELECT CASE WHEN model LIKE '%haiku%' THEN 'Haiku' WHEN model LIKE '%sonnet%' THEN 'Sonnet' WHEN model LIKE '%opus%' THEN 'Opus' ELSE 'Autre' END AS family,
  count(*) AS calls FROM calls GROUP BY 1""", "calls")
def p07(t):
    return t.calls.groupBy(X.model_family(F.upper("model")).alias("family")).agg(F.count(F.lit(1)).alias("calls"))


@query("p08_week_key", "SELECT strftime(o_orderdate, '%G-W%V') AS week, count(*) AS n FROM orders GROUP BY 1")
def p08(t):
    return t.raw("orders").groupBy(X.week_key("o_orderdate").alias("week")).agg(F.count(F.lit(1)).alias("n"))


@query("p09_monday", "SELECT CAST(date_trunc('week', ts) AS DATE) AS monday, count(*) AS n FROM events GROUP BY 1")
def p09(t):
    return t.raw("events").groupBy(X.monday_of("ts").alias("monday")).agg(F.count(F.lit(1)).alias("n"))


@query("p10_cycle_of_week", """
SELECT DISTINCT strftime(o_orderdate, '%G-W%V') AS week, CAST(date_trunc('week', o_orderdate) AS DATE) AS monday,
  CAST(date_diff('day', DATE '2020-01-06', CAST(date_trunc('week', o_orderdate) AS DATE)) / 7 AS INT) AS cycle FROM orders""")
def p10(t):
    week = t.raw("orders").select(X.week_key("o_orderdate").alias("week")).distinct()
    return week.withColumn("monday", X.monday_of_week_key("week")).withColumn("cycle", X.cycle_of("monday"))


@query("p11_task_title", r"""
SELECT conv_id, turn, CASE WHEN length(f) <= 80 THEN f ELSE substring(f, 1, 79) || '…' END AS title FROM (
 SELECT conv_id, turn, trim(regexp_replace(CASE WHEN length(h) > 12 AND length(h) < length(p) THEN h ELSE p END, '\s+', ' ', 'g')) AS f
 FROM (SELECT conv_id, turn, trim(text) AS p, regexp_extract(trim(text), '^[^.?!\n]*') AS h FROM conversations))""")
def p11(t):
    return t.raw("conversations").select("conv_id", "turn", X.make_title("text").alias("title"))


@query("p12_truncate", """
SELECT doc_id, sha256(CASE WHEN length(text) <= 2000 THEN text ELSE substring(text, 1, 2000) || '…' END) AS result_text,
  sha256(CASE WHEN length(text) <= 4000 THEN text ELSE substring(text, 1, 4000) || '… [tronqué]' END) AS span_value,
  CASE WHEN length(source) <= 3 THEN source ELSE substring(source, 1, 2) || '…' END AS short_source FROM documents""")
def p12(t):
    return t.raw("documents").select(
        "doc_id", F.sha2(X.truncate("text", 2000), 256).alias("result_text"),
        F.sha2(X.truncate("text", 4000, V.VALUE_MARKER), 256).alias("span_value"), X.short("source", 3).alias("short_source"))


@query("p13_fingerprint", "SELECT doc_id, 'sha256:' || substring(sha256(text), 1, 16) AS ref FROM documents")
def p13(t):
    return t.raw("documents").select("doc_id", X.fingerprint("text").alias("ref"))


@query("p14_redaction", r"""
SELECT doc_id, CASE WHEN text = '' THEN '' ELSE '(contenu non capturé)' END AS hidden,
  CASE WHEN length(c) <= 200 THEN c ELSE substring(c, 1, 199) || '…' END AS shown
FROM (SELECT doc_id, text, trim(regexp_replace(text, '\r\n|[\n\r\f]', ' ', 'g')) AS c FROM documents)""")
def p14(t):
    return t.raw("documents").select("doc_id", X.redact("text", False, 200).alias("hidden"), X.redact("text", True, 200).alias("shown"))


@query("p15_call_target", """
SELECT coalesce(json_extract_string(input_json, '$.file_path'), json_extract_string(input_json, '$.path'), json_extract_string(input_json, '$.command'),
  json_extract_string(input_json, '$.pattern'), '') AS target, count(*) AS calls FROM calls GROUP BY 1""", "calls")
def p15(t):
    return t.calls.groupBy(X.call_target("input_json").alias("target")).agg(F.count(F.lit(1)).alias("calls"))


@query("p16_json_fields", """
SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS INT)) AS BIGINT) AS k, count(*) AS has_k, CAST(0 AS BIGINT) AS has_other
FROM events GROUP BY event_type""")
def p16(t):
    return t.raw("events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(X.json_field("props", "k").try_cast("int")).alias("k"),
        F.count_if(X.json_has_any("props", ["z", "k"])).alias("has_k"), F.count_if(X.json_has_any("props", ["z"])).alias("has_other"))


@query("p16_json_presence", """
SELECT tool, count(*) FILTER (input_json LIKE '%"offset"%') AS with_offset, count(*) FILTER (input_json LIKE '%"old"%') AS with_old FROM calls GROUP BY tool""", "calls")
def p16b(t):
    return t.calls.groupBy("tool").agg(F.count_if(X.json_has_any("input_json", ["offset", "limit"])).alias("with_offset"),
                                       F.count_if(X.json_has_any("input_json", ["old"])).alias("with_old"))


@query("p17_number_text", """
SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS whole, CAST(round(o_totalprice, 2) AS DOUBLE) AS amount, CAST(0 AS BIGINT) AS unreadable FROM orders""")
def p17(t):
    o = t.raw("orders")
    whole = F.format_number(F.floor("o_totalprice"), 0)
    return o.select("o_orderkey", X.number_from_text(whole).alias("whole"),
                    X.money_from_text(F.concat(F.lit("$ "), F.format_number("o_totalprice", 2))).cast("double").alias("amount"),
                    X.number_from_text("o_orderpriority").alias("unreadable"))


@query("p18_variant_pick", """
SELECT p_partkey, list_extract([p_brand, p_type, p_name], CAST((p_size + h) % 3 AS INT) + 1) AS picked, h AS key_hash FROM (
 SELECT *, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(p_name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, x: (a * 31 + x) & 134217727) AS h FROM part)""")
def p18(t):
    return t.raw("part").select("p_partkey", X.pick_variant(F.array("p_brand", "p_type", "p_name"), "p_name", "p_size").alias("picked"),
                                X.hash31("p_name").alias("key_hash"))


@query("p19_template_fill", """
SELECT p_partkey, 'On « ' || p_name || ' », size ' || p_size || ' (' || p_name || ')' AS filled FROM part""")
def p19(t):
    return t.raw("part").select("p_partkey", X.fill_template(F.lit("On « {tache} », size {reprises} ({tache})"),
                                                             tache="p_name", reprises="p_size").alias("filled"))


@query("p20_fact_first", """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || ' — ' || p_type ELSE p_name END AS message FROM part""")
def p20(t):
    image = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).when(F.col("p_size") % 3 == 0, F.lit("  "))
    return t.raw("part").select("p_partkey", X.fact_first("p_name", image).alias("message"))


@query("p21_infobox_fields", r"""
SELECT page_id, CASE WHEN length(hp) BETWEEN 1 AND 39 THEN hp END AS hp, CASE WHEN length(speed) BETWEEN 1 AND 39 THEN speed END AS speed,
  CAST(NULL AS VARCHAR) AS armor FROM (SELECT page_id, trim(regexp_replace(ti || ' ' || length(html), '\s+', ' ', 'g')) AS hp,
   trim(regexp_replace('x ' || split_part(url, '/', 3), '\s+', ' ', 'g')) AS speed
 FROM (SELECT *, trim(regexp_replace(regexp_replace(regexp_extract(html, '<title>([^<|\r\n]*)', 1), '''{2,}', '', 'g'), '\s+', ' ', 'g')) AS ti FROM pages))""")
def p21(t):
    title = F.regexp_extract("html", r"<title>([^<|\r\n]*)", 1)
    wiki = F.concat(F.lit("{{Infobox\n| HP = {{icon|1}} ".replace("|1", "")), title, F.lit(" <b>"), F.length("html").cast("string"),
                    F.lit("</b>\n| speed = x [[Host "), F.lit("]]"), F.lit("\n}}"))
    host = F.split_part("url", F.lit("/"), F.lit(3))
    wiki = F.replace(wiki, F.lit("[[Host ]]"), F.concat(F.lit("[["), host, F.lit("]]")))
    return t.raw("pages").select("page_id", R.infobox_field(wiki, "hp").alias("hp"), R.infobox_field(wiki, "speed").alias("speed"),
                                 R.infobox_field(wiki, "armor").alias("armor"))


_EXT = r"[\p{L}\p{N}_][\p{L}\p{N}_\-/.]*\.(cs|ts|js|py|json|html|scss|css|sql|md|yml|yaml|razor|xaml)([^\p{L}\p{N}_]|$)"
_RUBRIC_SQL = {
    k: f"regexp_matches(text, '{words(p)}')" for k, _, p in V.RUBRIC if p.startswith(r"\b(")
}
_RUBRIC_SQL["perimetre"] = (f"(regexp_matches(text, '(?i){_EXT}') OR regexp_matches(text, '"
                            + words(r"\b(dans le (module|dossier|service|projet|fichier)|uniquement dans|sans toucher|ne touche pas|hors de)\b") + "'))")
_ORDERED = [r[0] for r in V.RUBRIC if r[1]] + [r[0] for r in V.RUBRIC if not r[1]]


@query("p22_prompt_rubric", "SELECT doc_id, "
       + "concat_ws(',', " + ", ".join(f"CASE WHEN {_RUBRIC_SQL[k]} THEN '{k}' END" for k, _, _ in V.RUBRIC) + ") AS present, "
       + "concat_ws(',', " + ", ".join(f"CASE WHEN NOT {_RUBRIC_SQL[k]} THEN '{k}' END" for k in _ORDERED) + ") AS missing, round(("
       + " + ".join(f"CAST({_RUBRIC_SQL[k]} AS INT)" for k, e, _ in V.RUBRIC if e) + ") / 5.0, 6) AS coverage FROM documents")
def p22(t):
    d = t.raw("documents").select("doc_id", X.rubric_hits("text").alias("hits"))
    return d.select("doc_id", F.array_join("hits", ",").alias("present"), F.array_join(X.missing_of("hits"), ",").alias("missing"),
                    r6(X.coverage_of("hits")).alias("coverage"))


@query("p23_cost_phrase", """
SELECT session_id, task_no, concat_ws(', ', CASE WHEN rework_turns > 0 THEN rework_turns || ' follow-up(s)' END,
  CASE WHEN all_calls > 0 THEN all_calls || ' tool call(s)' END, CASE WHEN verifications = 0 THEN 'no verification' END,
  CASE WHEN failed_calls > 0 THEN failed_calls || ' failed tool(s)' END, CASE WHEN NOT completed THEN 'not completed' END) AS cost FROM signals_wide""", "signals_wide")
def p23(t):
    return t.signals_wide.select("session_id", "task_no", R.cost_phrase("rework_turns", "all_calls", F.col("verifications") > 0,
                                                                         "failed_calls", "completed").alias("cost"))


@query("p24_critique_skeleton", r"""
SELECT conv_id, turn, trim(text) || chr(10) || chr(10) || array_to_string(list_filter([""" + ", ".join(
    f"CASE WHEN NOT {_RUBRIC_SQL[k]} THEN '- {k} : [{R.PLACEHOLDERS[k]}]' END" for k in _ORDERED)
    + r"""], lambda x: x IS NOT NULL), chr(10)) AS rewrite FROM conversations""")
def p24(t):
    return t.raw("conversations").select("conv_id", "turn", R.critique_skeleton("text").alias("rewrite"))


@query("p25_grouped_thousands", r"""
SELECT o_orderkey, replace(format('{:,}', CAST(floor(o_totalprice) AS BIGINT)), ',', chr(8239)) AS shown FROM orders""")
def p25(t):
    return t.raw("orders").select("o_orderkey", X.thousands(F.floor("o_totalprice")).alias("shown"))


_HOOK_SQL = """CASE WHEN event_type = 'view' THEN 'Custom' ELSE CASE event_type WHEN 'click' THEN 'PostToolUse' WHEN 'purchase' THEN 'TaskCompleted'
  WHEN 'signup' THEN 'SessionStart' WHEN 'error' THEN 'PostToolUseFailure' END END"""


@query("p26_hook_names", f"SELECT {_HOOK_SQL} AS hook, count(*) AS n FROM events GROUP BY 1")
def p26(t):
    segment = F.expr("""CASE event_type WHEN 'click' THEN 'Post-Tool' WHEN 'purchase' THEN 'task-completed' WHEN 'signup' THEN 'session-start'
                        WHEN 'error' THEN 'post-tool-fail' ELSE 'unknown' END""")
    body = F.when(F.col("event_type") == "view", "Custom").when(F.col("event_type") == "error", "")
    return t.raw("events").groupBy(X.hook_name(body, segment).alias("hook")).agg(F.count(F.lit(1)).alias("n"))


@query("p27_signal_gap", """
SELECT session_id, task_no, signal, round((CASE WHEN higher THEN target - value ELSE value - target END) / (CASE WHEN ratio THEN 1.0 ELSE greatest(1.0, target) END), 6) AS gap,
  coalesce((CASE WHEN higher THEN target - value ELSE value - target END) <= 0, false) AS meets
FROM signals JOIN specs USING (signal) WHERE target IS NOT NULL""", "signals", "specs")
def p27(t):
    from turnstone.operators.dims import with_spec
    s = with_spec(t.signals).filter("target IS NOT NULL")
    args = ("value", "target", "higher", "ratio")
    return s.select("session_id", "task_no", "signal", r6(X.signal_gap(*args)).alias("gap"), X.signal_meets(*args).alias("meets"))


@query("p28_nested_path", """
SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: length(x)), ',') AS widths FROM documents""")
def p28(t):
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.struct(F.length(x).alias("width")).alias("size"), x.alias("line")))
    d = t.raw("documents").withColumn("body", F.struct(lines.alias("lines")))
    return d.select("doc_id", F.array_join(F.col("body.lines.size.width").cast("array<string>"), ",").alias("widths"))


@query("f01_drop_without_session", "SELECT event_type, count(*) FILTER (user_id % 9 NOT IN (0, 1)) AS kept FROM events GROUP BY event_type")
def f01(t):
    from turnstone.operators.transcript import with_session
    e = t.raw("events").withColumn("session_id", F.expr("CASE user_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE CAST(user_id AS STRING) END"))
    return with_session(e).groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"))


@query("f06_newest_by_prefix", """
SELECT CAST(user_id AS VARCHAR) AS session_id, epoch_us(min(ts)) AS started_us FROM events WHERE CAST(user_id AS VARCHAR) LIKE '1%'
GROUP BY user_id ORDER BY min(ts) DESC, user_id DESC LIMIT 1""")
def f06(t):
    from turnstone.operators.events import select_sessions
    s = t.raw("events").groupBy(F.col("user_id").cast("string").alias("session_id")).agg(F.min("ts").alias("started_at"))
    return select_sessions(s, prefix="1").select("session_id", F.unix_micros("started_at").alias("started_us"))


@query("f08_tag_filter", """
SELECT doc_id FROM documents WHERE lang IN ('fr', 'de') OR source IN ('fr', 'de')""")
def f08(t):
    from turnstone.operators.retrieval import tag_filter
    d = t.raw("documents").select("doc_id", F.array("lang", "source").alias("tags"))
    return tag_filter(d, ["fr", "de"]).select("doc_id")


@query("f09_closed_weeks", """
SELECT strftime(ts, '%G-W%V') AS week, count(*) AS n, strftime(ts, '%G-W%V') = '2024-W04' AS is_last FROM events
WHERE date_trunc('week', ts) < DATE '2024-01-29' GROUP BY 1""")
def f09(t):
    from turnstone.operators.usage import closed_weeks, last_closed_week
    w = t.raw("events").groupBy(X.week_key("ts").alias("week"), X.monday_of("ts").alias("monday")).agg(F.count(F.lit(1)).alias("n"))
    closed = closed_weeks(w, "2024-01-31")
    return closed.crossJoin(F.broadcast(last_closed_week(w, "2024-01-31"))).select("week", "n", (F.col("week") == F.col("last_week")).alias("is_last"))


@query("f10_privacy_guard", """
SELECT doc_id, quality = 1 AND toxic = 0 AS kept, CASE WHEN quality <> 1 THEN 'not shareable' WHEN toxic <> 0 THEN 'cites a real transcript' END AS why FROM labels""")
def f10(t):
    from turnstone.operators.cases import privacy_guard
    cases = t.raw("labels").select("doc_id", (F.col("quality") == 1).alias("shareable"),
                                   F.when(F.col("toxic") == 1, "transcript").otherwise("synthetique").alias("origin"))
    return privacy_guard(cases).select("doc_id", "kept", "why")
