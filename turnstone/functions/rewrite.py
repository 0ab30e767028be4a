"""Small sentences about one prompt: what it cost and a skeleton of a better one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnstone.functions import exprs as X
from turnstone.functions import fixed_values as V

# what the writer is asked to fill in, per rubric key (own wording)
PLACEHOLDERS = {
    "objectif": "the verb and the exact object of the request",
    "perimetre": "the file or module concerned, and what must stay untouched",
    "acceptation": "how you will know it is done",
    "contraintes": "what must not change",
    "sortie": "what you expect back",
    "contexte": "what the agent cannot guess",
    "autonomie": "how far to go without asking",
}


def cost_phrase(rework, calls, verified, failed_tools, completed) -> Column:
    """P23 — the parts of the cost that occurred, in a fixed order."""
    c = X._c
    parts = F.array_compact(F.array(
        F.when(c(rework) > 0, F.concat(c(rework).cast("string"), F.lit(" follow-up(s)"))),
        F.when(c(calls) > 0, F.concat(c(calls).cast("string"), F.lit(" tool call(s)"))),
        F.when(~c(verified), F.lit("no verification")),
        F.when(c(failed_tools) > 0, F.concat(c(failed_tools).cast("string"), F.lit(" failed tool(s)"))),
        F.when(~c(completed), F.lit("not completed"))))
    return F.when(F.size(parts) == 0, F.lit("no measured cost")).otherwise(F.array_join(parts, ", "))


def critique_skeleton(prompt, rubric=None) -> Column:
    """P24 — the prompt and one line per missing criterion; NULL when none is missing."""
    rubric = rubric or V.RUBRIC
    hints = F.create_map(*[F.lit(x) for k, *_ in rubric for x in (k, PLACEHOLDERS.get(k, "to be completed"))])
    missing = X.rubric_missing(prompt, rubric)
    lines = F.transform(missing, lambda k: F.concat(F.lit("- "), k, F.lit(" : ["), F.try_element_at(hints, k), F.lit("]")))
    return F.when(F.size(missing) > 0, F.concat(X.trimmed(prompt), F.lit("\n\n"), F.array_join(lines, "\n")))


def infobox_field(text, field: str) -> Column:
    """P21 — one field of an info box, without templates, links, tags and emphasis; NULL unless 1 to 39 characters remain."""
    raw = F.regexp_extract(X._c(text), r"(?i)\|\s*" + field + r"\s*=\s*([^\r\n|]+)", 1)
    clean = F.regexp_replace(raw, r"\{\{[^}]*\}\}", " ")
    clean = F.regexp_replace(clean, r"\[\[([^\]|]*\|)?([^\]]*)\]\]", "$2")
    clean = F.regexp_replace(clean, r"<[^>]+>", " ")
    clean = F.regexp_replace(clean, r"'{2,}", "")
    clean = F.trim(F.regexp_replace(clean, r"\s+", " "))
    return F.when(F.length(clean).between(1, 39), clean)
