"""Run contracts and task evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.functions import exprs as X
from turnstone.functions import fixed_values as V

_KINDS = {"object": "^OBJECT", "array": "^ARRAY", "string": "^STRING$", "boolean": "^BOOLEAN$", "null": "^VOID$",
          "integer": "^(TINYINT|SMALLINT|INT|BIGINT)$", "number": "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"}


def violations(value: Column, schema: dict, path: str = "$") -> Column:
    """V18 — array of ``path: rule`` texts for a Variant against a JSON schema (type, enum, bounds, required, closed, items).

    The schema is walked once while the plan is built; the result is a plain expression over each row.
    A wrong type ends the checks of its branch.
    """
    return _violations(value, schema, F.lit(path))


def _violations(value: Column, schema: dict, path: Column) -> Column:
    # containers are told apart by a cast, only where the schema allows for them: most values of a line are single ones
    type_ = schema.get("type")
    listed = type_ if isinstance(type_, list) else [type_]
    as_object, as_array = "object" in listed or bool({"properties", "required", "additionalProperties"} & set(schema)), "array" in listed or "items" in schema
    fields = F.try_variant_get(value, "$", "map<string,variant>") if as_object else F.lit(None).cast("map<string,variant>")
    items = F.try_variant_get(value, "$", "array<variant>") if as_array else F.lit(None).cast("array<variant>")
    if not (as_object or as_array):
        return X.bind(F.struct(value.alias("v"), F.schema_of_variant(value).alias("k")), lambda p: _checked(p["v"], fields, items, p["k"], schema, path))

    def described(p: Column) -> Column:
        kind = F.schema_of_variant(p["v"])
        kind = F.when(p["items"].isNotNull(), "ARRAY").otherwise(kind) if as_array else kind
        kind = F.when(p["fields"].isNotNull(), "OBJECT").otherwise(kind) if as_object else kind
        return X.bind(kind, lambda k: _checked(p["v"], p["fields"], p["items"], k, schema, path))

    parts = F.struct(value.alias("v"), fields.alias("fields"), items.alias("items"))

    return X.bind(parts, described)


def _checked(value: Column, fields: Column, items: Column, kind: Column, schema: dict, path: Column) -> Column:
    none = F.array().cast("array<string>")
    is_object = kind == "OBJECT"

    def fault(test: Column, rule: str) -> Column:
        return F.when(test, F.concat(path, F.lit(": " + rule)))

    flat: list[Column] = []           # at most one fault each
    nested: list[Column] = []         # arrays of faults
    if "enum" in schema:
        allowed = [str(v) for v in schema["enum"]]
        flat.append(fault(~F.coalesce(F.try_variant_get(value, "$", "string").isin(allowed), F.lit(False)), "enum"))
    if "minLength" in schema:
        flat.append(fault(kind.rlike(_KINDS["string"]) & (F.length(F.try_variant_get(value, "$", "string")) < schema["minLength"]), "minLength"))
    number = F.when(kind.rlike(_KINDS["number"]), F.try_variant_get(value, "$", "double"))
    if "minimum" in schema:
        flat.append(fault(number < schema["minimum"], "minimum"))
    if "maximum" in schema:
        flat.append(fault(number > schema["maximum"], "maximum"))
    props = schema.get("properties", {})

    def member(name: str) -> Column:
        """A JSON null is a value; only an absent field gives NULL."""
        return F.try_element_at(fields, F.lit(name))

    for name in schema.get("required", []):
        flat.append(fault(is_object & member(name).isNull(), f"required {name}"))
    for name, sub in props.items():
        nested.append(F.when(is_object & member(name).isNotNull(), _violations(member(name), sub, F.concat(path, F.lit("." + name)))).otherwise(none))
    listed = X.const(list(props)) if props else none
    extra = schema.get("additionalProperties")
    if extra is False:
        unknown = F.array_except(F.map_keys(fields), listed)
        nested.append(F.coalesce(F.transform(unknown, lambda k: F.concat(path, F.lit(": unknown "), k)), none))
    elif isinstance(extra, dict):
        rest = F.filter(F.map_entries(fields), lambda e: ~F.array_contains(listed, e["key"]))
        nested.append(F.coalesce(F.flatten(F.transform(rest, lambda e: _violations(e["value"], extra, F.concat(path, F.lit("."), e["key"])))), none))
    if "items" in schema:
        each = F.transform(items, lambda v, i: _violations(v, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        nested.append(F.coalesce(F.flatten(each), none))
    inside = F.concat(F.array_compact(F.array(*flat)) if flat else none, *nested)
    wanted = schema.get("type")
    if wanted is None:
        return inside
    wanted = wanted if isinstance(wanted, list) else [wanted]
    good = F.coalesce(reduce(lambda a, b: a | b, [kind.rlike(_KINDS[w]) for w in wanted]), F.lit(False))
    return F.when(~good, F.array(F.concat(path, F.lit(": type " + "|".join(wanted))))).otherwise(inside)


# ------------------------------------------------------------------------------------- assertions
def _rows(df: DataFrame, checks: list[tuple[object, Column]], group: str) -> DataFrame:
    """One row per check that applies (a NULL name does not apply)."""
    items = F.array(*[F.struct((F.lit(n) if isinstance(n, str) else n).alias("name"), ok.alias("ok")) for n, ok in checks])
    return (df.select("task_id", F.explode(items).alias("a")).select("task_id", F.lit(group).alias("group"), "a.name", F.coalesce("a.ok", F.lit(False)).alias("ok"))
            .filter("name IS NOT NULL"))


def _each(df: DataFrame, column: str, prefix: str, ok, group: str) -> DataFrame:
    """One row per item of an array column."""
    return (df.select("*", F.explode(column).alias("_x")).select("task_id", F.lit(group).alias("group"), F.concat(F.lit(prefix), "_x").alias("name"),
                                                                F.coalesce(ok(F.col("_x")), F.lit(False)).alias("ok")))


def used_tools(calls: DataFrame) -> DataFrame:
    """Tools and number of calls per run. A run's tool set is bounded by the number of distinct tools."""
    return calls.groupBy("task_id").agg(F.collect_set("tool").alias("called"), F.count(F.lit(1)).alias("n_calls"))


def tool_assertions(golden: DataFrame, runs: DataFrame, calls: DataFrame) -> DataFrame:
    """V19 — run present, status, required / forbidden / any-of tools, number of calls."""
    nothing = F.array().cast("array<string>")
    j = golden.join(runs.select("task_id", "status", F.lit(True).alias("_run")), "task_id", "left").join(used_tools(calls), "task_id", "left")
    j = j.withColumns({"called": F.coalesce("called", nothing), "n_calls": F.coalesce("n_calls", F.lit(0).cast("bigint"))})
    here = j.filter("_run")
    has = lambda x: F.array_contains(F.col("called"), x)
    any_of = F.when(F.size("any_of") > 0, F.lit("tool_any_of"))
    return reduce(DataFrame.unionByName, [
        _rows(j.filter("_run IS NULL"), [("run_present", F.lit(False))], "tools"),
        _rows(here, [("status", F.col("status") == F.coalesce("expected_status", F.lit("completed"))), (any_of, F.arrays_overlap("called", "any_of")),
                     (F.when(F.col("max_calls").isNotNull(), F.lit("max_tool_calls")), F.col("n_calls") <= F.col("max_calls"))], "tools"),
        _each(here, "required", "tool_required:", has, "tools"), _each(here, "forbidden", "tool_forbidden:", lambda x: ~has(x), "tools")])


def policy_assertions(runs: DataFrame, calls: DataFrame, policies: DataFrame) -> DataFrame:
    """V20, J14, E08 — allow-list, declared policy, identity and four quotas. An agent without a policy fails its declaration."""
    declared = policies.select("agent", F.col("allowed_tools").alias("_declared"), F.col("principal").alias("_principal"), F.lit(True).alias("_known"))
    j = runs.join(used_tools(calls), "task_id", "left").join(declared, "agent", "left")
    called = F.coalesce("called", F.array().cast("array<string>"))
    c = F.col
    return _rows(j, [
        ("policy_allowlist", F.size(F.array_except(called, "allowed_tools")) == 0),
        ("policy_declared", F.coalesce(F.size(F.array_except("allowed_tools", "_declared")) == 0, F.lit(False)) & c("_known")),
        (F.when(c("_known"), F.lit("policy_identity")), c("principal") == c("_principal")),
        ("quota_calls", c("cost_calls") <= c("max_calls")), ("quota_tokens", c("tokens_in") + c("tokens_out") <= c("max_tokens")),
        ("quota_wall_clock", c("wall_clock_ms") <= c("max_wall_clock_ms")), ("quota_eur", c("eur") <= c("max_eur"))], "policy")


def call_assertions(calls: DataFrame, tools: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """V21 — each call: known tool, typed input and output, idempotency key on side effects.

    ``schemas`` maps a tool to its input and output schema; the registry is small, its checks become one CASE.
    """
    j = calls.join(tools.select("tool", "side_effect", F.lit(True).alias("_known")), "tool", "left")
    bad = F.lit(0)
    for tool, s in (schemas or {}).items():
        faults = F.size(violations(F.col("input"), s.get("input", {}))) + F.when(F.col("call_ok"), F.size(violations(F.col("output"), s.get("output", {})))).otherwise(0)
        bad = F.when(F.col("tool") == tool, faults).otherwise(bad)
    at = F.concat(F.lit("["), F.col("i").cast("string"), F.lit("]"))
    known = F.col("_known").isNotNull()
    return _rows(j, [
        (F.when(~known, F.concat(F.lit("tool_known"), at)), F.lit(False)),
        (F.when(known, F.concat(F.lit("tool_io_valid"), at, F.lit(":"), "tool")), bad == 0),
        (F.when(known & F.col("side_effect"), F.concat(F.lit("idempotency_key"), at, F.lit(":"), "tool")), F.coalesce("idempotency_key", F.lit("")) != "")], "calls")


def side_effect_assertions(golden: DataFrame, calls: DataFrame, tools: DataFrame) -> DataFrame:
    """V21 — number of side effects against a maximum and an exact count."""
    n = calls.join(tools.filter("side_effect").select("tool"), "tool", "left_semi").groupBy("task_id").agg(F.count(F.lit(1)).alias("_n"))
    j = golden.join(n, "task_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0).cast("bigint")))
    return _rows(j, [(F.when(F.col("side_max").isNotNull(), F.lit("side_effects_max")), F.col("_n") <= F.col("side_max")),
                     (F.when(F.col("side_exactly").isNotNull(), F.lit("side_effects_exactly")), F.col("_n") == F.col("side_exactly"))], "calls")


def dotted(body: str, path: str) -> Column:
    """P28 — value at a dotted path held in a column; on an array, the values of its items."""
    return F.expr(f"coalesce(get_json_object({body}, concat('$.', {path})), get_json_object({body}, concat('$.', replace({path}, '.', '[*].'))))")


def property_assertions(wanted: DataFrame, calls: DataFrame) -> DataFrame:
    """V21 — ``wanted``: task_id, tool, part ('input' or 'output'), path. Each call of the tool must carry the property, not empty for outputs."""
    j = wanted.join(calls, ["task_id", "tool"])
    j = j.withColumn("_body", F.to_json(F.when(F.col("part") == "input", F.col("input")).otherwise(F.col("output"))))
    got = dotted("_body", "path")
    ok = got.isNotNull() & ((F.col("part") == "input") | (got != "[]"))
    return _rows(j, [(F.concat(F.lit("tool_io_prop:"), "tool", F.lit("."), "part", F.lit("."), "path"), ok)], "calls")


def content_assertions(golden: DataFrame, runs: DataFrame) -> DataFrame:
    """V22 — texts that must, must not or may occur, and no amount in euros."""
    j = golden.join(runs.select("task_id", F.col("output_text").alias("_text")), "task_id")
    text = F.coalesce("_text", F.lit(""))
    return reduce(DataFrame.unionByName, [
        _each(j, "must_contain", "must_contain:", lambda x: F.contains(text, x), "content"),
        _each(j, "must_not_contain", "must_not_contain:", lambda x: ~F.contains(text, x), "content"),
        _rows(j, [(F.when(F.size("must_contain_any") > 0, F.lit("must_contain_any")), F.exists("must_contain_any", lambda x: F.contains(text, x))),
                  (F.when(F.col("no_euro_amount"), F.lit("no_euro_amount")), ~text.rlike("(?i)" + V.EURO_PATTERN))], "content")])


def _is_text(body: Column, path: Column) -> Column:
    """Whether the value at a dotted path of objects is a JSON string: read as a Variant, level by level."""
    def step(v: Column, name: Column) -> Column:
        return F.to_json(F.try_element_at(F.try_variant_get(F.try_parse_json(v), "$", "map<string,variant>"), name))

    return F.coalesce(F.startswith(F.aggregate(F.split(path, r"\."), body, step), F.lit('"')), F.lit(False))


def echo_assertions(wanted: DataFrame, calls: DataFrame, runs: DataFrame) -> DataFrame:
    """V22 — ``wanted``: task_id, tool, field. The texts successful calls returned must all occur in the answer, and there must be one.

    Numbers, booleans, objects and arrays are no texts: a value counts when its JSON form is a string.
    """
    got = (wanted.join(calls.filter("call_ok"), ["task_id", "tool"]).withColumn("_body", F.to_json("output")).withColumn("_v", dotted("_body", "field"))
           .filter((F.coalesce("_v", F.lit("")) != "") & _is_text(F.col("_body"), F.col("field"))).join(runs.select("task_id", "output_text"), "task_id")
           .groupBy("task_id", "tool", "field").agg(F.bool_and(F.contains(F.col("output_text"), F.col("_v"))).alias("_ok")))
    j = wanted.join(got, ["task_id", "tool", "field"], "left")
    return _rows(j, [(F.concat(F.lit("must_echo:"), "tool", F.lit("."), "field"), F.col("_ok"))], "content")


def provenance_assertions(golden: DataFrame, runs: DataFrame, provenance: DataFrame, seen: DataFrame) -> DataFrame:
    """V23, J15 — entries present, enough, cited, traceable to a tool result of the same run, and quoted in the answer.

    ``provenance``: task_id, kind, source_id, fragment. ``seen``: task_id, doc_id returned by successful calls.
    """
    docs = provenance.filter("kind = 'document'").select("task_id", F.col("source_id").alias("doc_id"))
    lost = docs.join(seen.select("task_id", "doc_id").distinct(), ["task_id", "doc_id"], "left_anti").groupBy("task_id").agg(F.count(F.lit(1)).alias("_lost"))
    entries = (provenance.join(runs.select("task_id", "output_text"), "task_id").groupBy("task_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(~F.contains(F.col("output_text"), F.col("fragment"))).alias("_absent")))
    zero = F.lit(0).cast("bigint")
    j = (golden.join(runs.select("task_id"), "task_id", "left_semi").join(entries, "task_id", "left").join(lost, "task_id", "left")
         .withColumns({"_n": F.coalesce("_n", zero), "_absent": F.coalesce("_absent", zero), "_lost": F.coalesce("_lost", zero)}))
    cites = (golden.select("task_id", F.explode("must_cite").alias("doc_id")).join(runs.select("task_id"), "task_id", "left_semi")
             .join(docs.distinct().withColumn("_ok", F.lit(True)), ["task_id", "doc_id"], "left"))
    return reduce(DataFrame.unionByName, [
        _rows(j, [(F.when(F.col("provenance_required"), F.lit("provenance_present")), F.col("_n") > 0),
                  (F.when(F.col("min_entries").isNotNull(), F.lit("provenance_min_entries")), F.col("_n") >= F.col("min_entries")),
                  ("provenance_traceable", F.col("_lost") == 0), ("provenance_fragments_in_output", F.col("_absent") == 0)], "provenance"),
        _rows(cites, [(F.concat(F.lit("provenance_cites:"), "doc_id"), F.col("_ok"))], "provenance")])


def outcomes(golden: DataFrame, assertions: DataFrame, judge: DataFrame, runs: DataFrame) -> DataFrame:
    """V24, J13 — per task: all assertions, the judge when there is one, success, and success without a human."""
    valid = F.bool_and("contract_valid") if "contract_valid" in assertions.columns else F.bool_and(F.coalesce(F.when(F.col("name") == "run_present", F.col("ok")), F.lit(True)))
    per = assertions.groupBy("task_id").agg(valid.alias("contract_valid"), F.bool_and("ok").alias("assert_pass"), F.bool_and(F.when(F.col("group") == "policy", F.col("ok"))).alias("policy_ok"),
                                            F.bool_and(F.when(F.col("group") == "provenance", F.col("ok"))).alias("provenance_ok"))
    j = (golden.join(per, "task_id", "left").join(judge.select("task_id", F.col("pass").alias("judge_pass")), "task_id", "left")
         .join(runs.select("task_id", "human_interventions", F.lit(True).alias("_run")), "task_id", "left"))
    passed = F.coalesce("assert_pass", F.lit(True))
    success = passed & F.coalesce("judge_pass", F.lit(True))
    return j.withColumns({"assert_pass": passed, "success": success,
                          "no_human": F.coalesce(F.col("_run") & (F.coalesce("human_interventions", F.lit(0)) == 0) & success, F.lit(False)),
                          "policy_ok": F.coalesce("policy_ok", F.lit(False)), "provenance_ok": F.coalesce("provenance_ok", F.lit(False))}).drop("_run")


# ---------------------------------------------------------------------------- a run line as a whole
RUN_TYPE = (
    "struct<task_id string, status string, agent string, principal string, allowed_tools array<string>, "
    "tool_calls array<struct<tool string, ok boolean, idempotency_key string, input variant, output variant>>, output struct<text string>, "
    "provenance array<struct<source struct<kind string, id string>, fragment string>>, "
    "cost struct<calls bigint, tokens_in bigint, tokens_out bigint, wall_clock_ms bigint, eur double>, "
    "quota struct<max_calls bigint, max_tokens bigint, max_wall_clock_ms bigint, max_eur double>, human_interventions bigint>")


def strings_of(value: Column) -> Column:
    """A Variant's text, or the texts among its items; values of other kinds count for nothing."""
    one = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    many = F.transform(F.try_variant_get(value, "$", "array<variant>"), one)
    return F.array_compact(F.coalesce(many, F.array(one(value))))


def at_path(value: Column, names: list[str]) -> Column:
    """P28 — the Variant at a fixed path; on an array, the values of its items."""
    for i, name in enumerate(names):
        rest = names[i + 1:]
        inside = F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), F.lit(name))
        items = F.transform(F.try_variant_get(value, "$", "array<map<string,variant>>"), lambda m: F.try_element_at(m, F.lit(name)))
        if rest:
            items = F.transform(items, lambda v: at_path(v, rest))
            return F.coalesce(at_path(inside, rest), F.to_variant_object(items))
        value = F.coalesce(inside, F.to_variant_object(items))
    return value


def run_contract(lines: DataFrame, contract: dict, at_most: int = 5) -> DataFrame:
    """V18 — ``task_id, run`` and whether the line keeps the contract, with its first faults; one walk over the line."""
    faults = F.when(F.col("run").isNull(), F.array(F.lit("$: no object"))).otherwise(violations(F.col("run"), contract))
    return lines.withColumn("_faults", faults).withColumns(
        {"contract_valid": F.size("_faults") == 0, "errors": F.array_join(F.slice(F.array_sort("_faults"), 1, at_most), "; ")}).drop("_faults")


def run_assertions(golden: DataFrame, lines: DataFrame, policies: DataFrame, tools: DataFrame, contract: dict, schemas: dict[str, dict] | None = None) -> DataFrame:
    """V18-V24 — all assertions of a task in one pass: ``task_id, group, name, ok``, and the run's ``contract_valid``.

    A run is one line, so its calls are an array of the row: golden tasks meet runs and policies in two joins, everything else is an
    expression over the row, and the assertions are exploded once. A missing run fails ``run_present``, one that breaks its contract fails
    ``contract_valid``, and neither is looked at any further. ``tools`` is the registry, a dimension that fits into one row.
    """
    known = tools.agg(F.map_from_entries(F.collect_list(F.struct("tool", "side_effect"))).alias("_tools"))
    declared = policies.select(F.col("agent").alias("_agent"), F.col("allowed_tools").alias("_declared"), F.col("principal").alias("_principal"))
    checked = run_contract(lines, contract).withColumn("r", F.try_variant_get("run", "$", RUN_TYPE)).select("task_id", "contract_valid", "r", F.lit(True).alias("_here"))
    # tasks and runs are dealt by task: a line is short on disk and long in memory, so left to its estimate the join would pass all runs through the driver
    spread = int(golden.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    j = (golden.repartition(spread, "task_id").join(checked.repartition(spread, "task_id").hint("merge"), "task_id", "left").withColumn("_by", F.col("r.agent")).join(declared, F.col("_by") == F.col("_agent"), "left").crossJoin(F.broadcast(known)))     # one row
    none, c = F.array().cast("array<string>"), F.col
    calls, text = F.coalesce(c("r.tool_calls"), F.array().cast(f"array<{_element('tool_calls')}>")), F.coalesce(c("r.output.text"), F.lit(""))
    j = j.withColumns({"_calls": calls, "_text": text, "_prov": c("r.provenance")})
    j = j.withColumns({"_called": F.array_distinct(F.transform("_calls", lambda x: x["tool"])), "_ok_calls": F.filter("_calls", lambda x: x["ok"])})
    j = j.withColumns({"_seen": F.flatten(F.transform("_ok_calls", lambda x: F.concat(strings_of(at_path(x["output"], ["results", "doc_id"])), strings_of(at_path(x["output"], ["doc_id"]))))),
                       "_docs": F.transform(F.filter("_prov", lambda p: p["source"]["kind"] == "document"), lambda p: p["source"]["id"]),
                       "_effects": F.size(F.filter("_calls", lambda x: F.coalesce(F.try_element_at(c("_tools"), x["tool"]), F.lit(False))))})

    def one(group: str, name, ok: Column, when: Column | None = None) -> Column:
        item = F.struct(F.lit(group).alias("group"), (F.lit(name) if isinstance(name, str) else name).alias("name"), F.coalesce(ok, F.lit(False)).alias("ok"))
        return F.array(item) if when is None else F.when(F.coalesce(when, F.lit(False)), F.array(item)).otherwise(empty)

    def each(group: str, items: str, prefix: str, ok) -> Column:
        return F.coalesce(F.transform(items, lambda x: F.struct(F.lit(group).alias("group"), F.concat(F.lit(prefix), x).alias("name"), F.coalesce(ok(x), F.lit(False)).alias("ok"))), empty)

    empty = F.array().cast("array<struct<group:string,name:string,ok:boolean>>")
    has = lambda x: F.array_contains("_called", x)

    def of_call(x: Column, i: Column) -> Column:
        effect = F.try_element_at(c("_tools"), x["tool"])
        at, bad = F.concat(F.lit("["), i.cast("string"), F.lit("]")), F.lit(0)
        for tool, sch in (schemas or {}).items():
            faults = F.size(violations(x["input"], sch.get("input", {}))) + F.when(x["ok"], F.size(violations(x["output"], sch.get("output", {})))).otherwise(0)
            bad = F.when(x["tool"] == tool, faults).otherwise(bad)
        return F.concat(one("calls", F.concat(F.lit("tool_known"), at), F.lit(False), effect.isNull()),
                        one("calls", F.concat(F.lit("tool_io_valid"), at, F.lit(":"), x["tool"]), bad == 0, effect.isNotNull()),
                        one("calls", F.concat(F.lit("idempotency_key"), at, F.lit(":"), x["tool"]), F.coalesce(x["idempotency_key"], F.lit("")) != "", effect))

    cost, quota = c("r.cost"), c("r.quota")
    full = F.concat(
        one("contract", "contract_valid", F.lit(True)),
        one("tools", "status", c("r.status") == F.coalesce("expected_status", F.lit("completed"))), each("tools", "required", "tool_required:", has), each("tools", "forbidden", "tool_forbidden:", lambda x: ~has(x)),
        one("tools", "tool_any_of", F.arrays_overlap("_called", "any_of"), F.size("any_of") > 0), one("tools", "max_tool_calls", F.size("_calls") <= c("max_calls"), c("max_calls").isNotNull()),
        one("policy", "policy_allowlist", F.size(F.array_except("_called", c("r.allowed_tools"))) == 0),
        one("policy", "policy_declared", c("_agent").isNotNull() & (F.size(F.array_except(c("r.allowed_tools"), "_declared")) == 0)),
        one("policy", "policy_identity", c("r.principal") == c("_principal"), c("_agent").isNotNull()),
        one("policy", "quota_calls", cost["calls"] <= quota["max_calls"]), one("policy", "quota_tokens", cost["tokens_in"] + cost["tokens_out"] <= quota["max_tokens"]),
        one("policy", "quota_wall_clock", cost["wall_clock_ms"] <= quota["max_wall_clock_ms"]), one("policy", "quota_eur", cost["eur"] <= quota["max_eur"]),
        F.flatten(F.transform("_calls", of_call)),
        one("calls", "side_effects_max", c("_effects") <= c("side_max"), c("side_max").isNotNull()), one("calls", "side_effects_exactly", c("_effects") == c("side_exactly"), c("side_exactly").isNotNull()),
        each("content", "must_contain", "must_contain:", lambda x: F.contains("_text", x)), each("content", "must_not_contain", "must_not_contain:", lambda x: ~F.contains("_text", x)),
        one("content", "must_contain_any", F.exists("must_contain_any", lambda x: F.contains("_text", x)), F.size("must_contain_any") > 0),
        one("content", "no_euro_amount", ~c("_text").rlike("(?i)" + V.EURO_PATTERN), c("no_euro_amount")),
        one("provenance", "provenance_present", F.size("_prov") > 0, c("provenance_required")), one("provenance", "provenance_min_entries", F.size("_prov") >= c("min_entries"), c("min_entries").isNotNull()),
        each("provenance", "must_cite", "provenance_cites:", lambda x: F.array_contains("_docs", x)),
        one("provenance", "provenance_traceable", F.size(F.array_except("_docs", "_seen")) == 0), one("provenance", "provenance_fragments_in_output", F.forall("_prov", lambda p: F.contains("_text", p["fragment"]))))
    found = (F.when(c("_here").isNull(), one("tools", "run_present", F.lit(False))).when(~c("contract_valid"), one("contract", "contract_valid", F.lit(False))).otherwise(full))
    return j.select("task_id", F.coalesce("contract_valid", F.lit(False)).alias("contract_valid"), F.explode(found).alias("a")).select("task_id", "contract_valid", "a.*")


def _element(field: str) -> str:
    """Type of the items of an array field of a run."""
    from pyspark.sql import types as T

    return T.DataType.fromDDL(RUN_TYPE)[field].dataType.elementType.simpleString()


# ------------------------------------------------------------------------------------------ rates
def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """A23 — Cohen's kappa of two yes/no judges, 1 when chance agreement is certain, NULL without rows."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    m = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("po"), F.avg(x).alias("pa"), F.avg(y).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return m.withColumn("kappa", F.when(F.col("n") > 0, F.when(pe == 1.0, 1.0).otherwise(F.bround((F.col("po") - pe) / (1 - pe), 4))))


def task_summary(rows: DataFrame) -> DataFrame:
    """A22 — rates over the tasks; each rate counts only the rows where it is defined."""
    def rate(c: str, only: Column | None = None) -> Column:
        v = F.col(c).cast("double") if only is None else F.when(only, F.col(c).cast("double"))
        return F.bround(F.avg(v), 4)
    judged = F.col("judge_pass").isNotNull()
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(judged).alias("n_judged"), rate("success").alias("success_rate"), rate("assert_pass").alias("assert_rate"),
        rate("judge_pass").alias("judge_rate"), F.bround(F.avg(F.when(judged, (F.col("assert_pass") == F.col("judge_pass")).cast("double"))), 4).alias("agreement"),
        rate("contract_valid").alias("contract_valid_rate"), rate("policy_ok").alias("policy_ok_rate"), rate("provenance_ok", F.col("provenance_required")).alias("provenance_ok_rate"),
        rate("success", ~F.col("answerable")).alias("negative_ok"), rate("no_human").alias("no_human_rate"))


def width_report(tools: DataFrame, exceptions: DataFrame, retrieval: DataFrame, tasks: DataFrame, context: DataFrame) -> DataFrame:
    """A26 — the four measures of a cycle from one-row inputs: pass rates, tools per exception, context, tasks without a human."""
    n = F.count(F.lit(1))
    return (tools.agg(n.alias("tools_exposed")).crossJoin(exceptions.agg(n.alias("policy_exceptions")))
            .withColumn("ratio", F.bround(F.col("tools_exposed") / (1 + F.col("policy_exceptions")), 2))
            .crossJoin(retrieval.select("all_hit", "recall")).crossJoin(tasks.select("success_rate", "no_human_rate")).crossJoin(context.select("max_context_tokens")))


def consecutive_cycles(reports: DataFrame) -> DataFrame:
    """W18 — each published cycle (one row per cycle) against the one before it."""
    from pyspark.sql import Window
    prev = F.lag("cycle").over(Window.orderBy("cycle"))
    return reports.withColumn("previous", prev).withColumn("consecutive", F.col("cycle") == F.col("previous") + 1)


def unresolved_references(wanted: DataFrame, registry: DataFrame) -> DataFrame:
    """J19 — referenced tools and schema paths that the registry (tool, path) does not know."""
    known = registry.select("tool").distinct()
    no_tool = wanted.join(known, "tool", "left_anti").withColumn("problem", F.lit("unknown tool"))
    no_path = (wanted.filter("path IS NOT NULL").join(known, "tool", "left_semi").join(registry.select("tool", "path").distinct(), ["tool", "path"], "left_anti")
               .withColumn("problem", F.lit("unknown path")))
    return no_tool.unionByName(no_path)
