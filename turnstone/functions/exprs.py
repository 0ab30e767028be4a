"""Column expressions: text, time, tokens and JSON helpers.

Every helper returns a :class:`Column` made of built-in functions, so it stays inside whole-stage
code generation and can be pushed or pruned by the optimizer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnstone.functions import fixed_values as V


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def const(value) -> Column:
    """Literal that accepts any iterable of strings as an array."""
    return F.array(*[F.lit(v) for v in value]) if isinstance(value, (list, tuple)) else F.lit(value)


def bind(value: Column, use) -> Column:
    """Evaluate ``value`` once per row and hand it to ``use``: a one-item transform gives it a name."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# ------------------------------------------------------------------------------------------ time
def week_key(ts) -> Column:
    """P08 — ISO week key such as ``2026-W34``."""
    d = _c(ts)
    return F.format_string("%04d-W%02d", F.date_part(F.lit("YEAROFWEEK"), d).cast("int"), F.weekofyear(d))


def monday_of(ts) -> Column:
    """P09 — the Monday of the week of a timestamp or date."""
    return F.to_date(F.date_trunc("week", _c(ts)))


def cycle_of(day) -> Column:
    """P10 — whole weeks since Monday 2020-01-06, cut toward zero."""
    return (F.datediff(_c(day), F.lit("2020-01-06").cast("date")) / 7).cast("int")


def monday_of_week_key(week) -> Column:
    """P10 — Monday of an ISO week key; NULL when the key is malformed or the week does not exist."""
    w = _c(week)
    year = F.regexp_extract(w, r"^(\d{4})-[Ww](\d+)$", 1).try_cast("int")
    number = F.regexp_extract(w, r"^(\d{4})-[Ww](\d+)$", 2).try_cast("int")
    jan4 = F.make_date(year, F.lit(1), F.lit(4))
    first = F.to_date(F.date_trunc("week", jan4))
    monday = F.date_add(first, (number - 1) * 7)
    return F.when(F.date_part(F.lit("YEAROFWEEK"), monday).cast("int") == year, monday)


def epoch_us(ts) -> Column:
    return F.unix_micros(_c(ts))


# ---------------------------------------------------------------------------------------- tokens
def model_family(model) -> Column:
    """P07 — substring test in fixed order."""
    m = F.lower(F.coalesce(_c(model), F.lit("")))
    return (F.when(m.contains("haiku"), "Haiku").when(m.contains("sonnet"), "Sonnet")
            .when(m.contains("opus"), "Opus").otherwise("Autre"))


def total_input(inp, cache_read, cache_creation) -> Column:
    """P05 — everything the model read in one step."""
    return _c(inp) + _c(cache_read) + _c(cache_creation)


def is_mcp(name) -> Column:
    return _c(name).startswith("mcp__")


def mcp_server(name) -> Column:
    """P06 — second part of ``mcp__server__tool``."""
    n = _c(name)
    return F.when(is_mcp(n), F.get(F.split(n, "__"), F.lit(1)))


# ------------------------------------------------------------------------------------------ text
def trimmed(x) -> Column:
    """Trim every kind of white space, not just blanks."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def is_blank(x) -> Column:
    return F.coalesce(trimmed(x), F.lit("")) == ""


def truncate(x, limit: int, marker: str = "…", keep: int | None = None) -> Column:
    """P12 — cut at ``limit`` characters; ``keep`` characters stay in front of the marker."""
    s = _c(x)
    kept = limit if keep is None else keep
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.substring(s, 1, kept), F.lit(marker)))


def short(x, limit: int) -> Column:
    """P12 — at most ``limit`` characters, marker included."""
    return truncate(x, limit, "…", limit - 1)


def one_line(x) -> Column:
    return F.trim(F.regexp_replace(_c(x), r"\r\n|[\n\r\f\x{85}\x{2028}\x{2029}]", " "))


def make_title(prompt) -> Column:
    """P11 — first sentence of a prompt on one line, at most 80 characters."""
    text = trimmed(F.coalesce(_c(prompt), F.lit("")))
    stop = F.regexp_instr(text, F.lit(r"[.?!\n]"))          # 1-based, 0 when absent
    cut = F.when(stop - 1 > V.TITLE_MIN_CUT, F.substring(text, F.lit(1), stop - 1)).otherwise(text)
    flat = F.trim(F.regexp_replace(cut, r"(?U)\s+", " "))
    return short(flat, V.TITLE_MAX_CHARS)


def fingerprint(x) -> Column:
    """P13 — ``sha256:`` and 16 hex digits; NULL for empty text."""
    s = _c(x)
    return F.when(F.coalesce(s, F.lit("")) != "", F.concat(F.lit("sha256:"), F.substring(F.sha2(s, 256), 1, 16)))


def redact(x, capture: bool, limit: int) -> Column:
    """P14 — the text on one line when capture is on, otherwise a fixed marker; never a part of the text."""
    s = F.coalesce(_c(x), F.lit(""))
    shown = short(one_line(s), limit) if capture else F.lit(V.REDACTED)
    return F.when(s == "", F.lit("")).otherwise(shown)


def thousands(n) -> Column:
    """P25 — digits grouped with a narrow no-break space."""
    return F.replace(F.format_number(_c(n), 0), F.lit(","), F.lit("\u202f"))


def percent(x) -> Column:
    return F.concat(F.round(_c(x) * 100).cast("bigint").cast("string"), F.lit(" %"))


def fill_template(template, **values) -> Column:
    """P19 — replace ``{name}`` by a column; NULL for an empty template."""
    t = _c(template)
    out = t
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(_c(value).cast("string"), F.lit("")))
    return F.when(F.coalesce(t, F.lit("")) != "", out)


def fact_first(fact, image) -> Column:
    """P20 — ``fact`` alone, or ``fact — image`` when there is an image."""
    f, i = _c(fact), _c(image)
    return F.when(is_blank(i), f).otherwise(F.concat(f, F.lit(" — "), i))


def word_match(x, pattern: str) -> Column:
    return _c(x).rlike(V.UNICODE_FLAGS + pattern)


def word_count(x, words: list[str]) -> Column:
    return F.regexp_count(_c(x), F.lit(V.UNICODE_FLAGS + r"\b(" + "|".join(words) + r")\b"))


def first_opener(text, openers: list[str]) -> Column:
    """First listed opener that starts the text, else NULL. List order decides."""
    t = _c(text)
    return F.get(F.filter(const(openers), lambda o: t.startswith(o)), F.lit(0))


def hash31(key) -> Column:
    """P18 — polynomial hash of a key, kept on 27 bits."""
    chars = F.transform(F.split(_c(key), ""), lambda ch: F.ascii(ch).cast("bigint"))
    return F.aggregate(chars, F.lit(0).cast("bigint"),
                       lambda acc, ch: (acc * 31 + ch).bitwiseAND(F.lit(0x7FFFFFF).cast("bigint")))


def pick_variant(variants, key, cycle) -> Column:
    """P18 — the variant whose turn it is; NULL for an empty list."""
    v = _c(variants)
    n = F.size(v)
    index = F.pmod(_c(cycle).cast("bigint") + hash31(key), F.when(n > 0, n.cast("bigint"))).cast("int")
    return F.when(n > 0, F.get(v, index))


# ------------------------------------------------------------------------------------------ json
def json_field(j, name: str) -> Column:
    """P16 — a field as text, NULL when the input is not an object or the field is missing."""
    return F.get_json_object(_c(j), f"$.{name}")


def json_has_any(j, names: list[str]) -> Column:
    """P16 — does the object carry at least one of the names (even with a null value)."""
    return F.coalesce(F.arrays_overlap(F.json_object_keys(_c(j)), const(names)), F.lit(False))


def call_target(j, limit: int = 160) -> Column:
    """P15 — what a tool call points at: the first known field, on one line, shortened."""
    return short(one_line(F.coalesce(*[json_field(j, f) for f in V.TARGET_FIELDS], F.lit(""))), limit)


def number_from_text(s) -> Column:
    """P17 — integer with thousands separators, 0 when unreadable."""
    return F.coalesce(F.regexp_replace(_c(s), r"[ ,\x{a0}\x{202f}]", "").try_cast("bigint"), F.lit(0).cast("bigint"))


def money_from_text(s) -> Column:
    """P17 — amount with a currency sign, 0 when unreadable."""
    cleaned = F.regexp_replace(_c(s), r"[$€ \x{a0}\x{202f}]", "")
    plain = F.regexp_replace(cleaned, ",", "")
    return F.coalesce(plain.try_cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)"))


def hook_name(body_name, url_segment) -> Column:
    """P26 — name in the body, else the name mapped from the URL segment, else NULL."""
    routes = F.create_map(*[F.lit(x) for kv in V.HOOK_ROUTES.items() for x in kv])
    body = _c(body_name)
    return F.coalesce(F.when(body != "", body), F.try_element_at(routes, F.lower(_c(url_segment))))


# ---------------------------------------------------------------------------------------- rubric
def holds_any(lower_text, literals: list[str]) -> Column:
    """Plain byte search for any of the literals: cheap enough to run before a pattern."""
    t = _c(lower_text)
    found = F.contains(t, F.lit(literals[0]))
    for x in literals[1:]:
        found = found | F.contains(t, F.lit(x))
    return found


def rubric_hits(text, rubric=None) -> Column:
    """P22 — keys of the rubric criteria a prompt meets, in rubric order. Each pattern runs once, and only on texts
    that hold one of its literals."""
    t = _c(text)

    def met(low: Column, key: str, pattern: str) -> Column:
        literals = V.RUBRIC_LITERALS.get(key) if rubric is None else None
        full = word_match(t, pattern)
        return F.when(holds_any(low, literals), full).otherwise(False) if literals else full

    return bind(F.lower(t), lambda low: F.array_compact(F.array(*[F.when(met(low, k, p), F.lit(k)) for k, _, p in (rubric or V.RUBRIC)])))


def missing_of(hits, rubric=None) -> Column:
    """P22 — the criteria that are not met, essential ones first."""
    rubric = rubric or V.RUBRIC
    ordered = [r[0] for r in rubric if r[1]] + [r[0] for r in rubric if not r[1]]
    return F.array_except(const(ordered), _c(hits))


def coverage_of(hits, rubric=None) -> Column:
    """P22 — share of the essential criteria that are met."""
    essentials = [k for k, e, _ in (rubric or V.RUBRIC) if e]
    if not essentials:
        return F.lit(1.0)
    return F.size(F.array_intersect(_c(hits), const(essentials))) / F.lit(float(len(essentials)))


def rubric_missing(text, rubric=None) -> Column:
    return missing_of(rubric_hits(text, rubric), rubric)


def rubric_coverage(text, rubric=None) -> Column:
    return coverage_of(rubric_hits(text, rubric), rubric)


# ------------------------------------------------------------------------------------------ gaps
def signal_scale(target, ratio) -> Column:
    return F.when(_c(ratio), F.lit(1.0)).otherwise(F.greatest(F.lit(1.0), F.coalesce(_c(target), F.lit(0.0))))


def signal_gap(value, target, higher, ratio) -> Column:
    """P27 — distance to the target, normalised; NULL when there is no value or no target."""
    v, t = _c(value), _c(target)
    return F.when(_c(higher), t - v).otherwise(v - t) / signal_scale(t, ratio)


def signal_meets(value, target, higher, ratio) -> Column:
    return F.coalesce(signal_gap(value, target, higher, ratio) <= 0, F.lit(False))
