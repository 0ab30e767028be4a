"""Rewrite checks (V07-V12, E05, J20): each one judges rows of (case_id, original, title, rewrite)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.functions import exprs as X
from turnstone.functions import fixed_values as V
from turnstone.operators.cases import evaluator

UNDECIDED = V.UNDECIDED


def _verdict(df: DataFrame, label: Column, evidence: Column) -> DataFrame:
    return df.select("case_id", label.alias("label"), evidence.cast("string").alias("evidence"))


def invented(kind: str, pattern: str, flags: str = "(?U)") -> Column:
    """First match of a pattern in the rewrite (bracketed text left out) that the source does not contain, case ignored."""
    source = F.lower(F.concat(F.coalesce("original", F.lit("")), F.lit(" \n "), F.coalesce("title", F.lit(""))))
    candidate = F.regexp_replace("rewrite", V.BRACKETED_PATTERN, " ")
    found = F.regexp_extract_all(candidate, F.lit(flags + pattern), F.lit(0))
    return F.get(F.filter(found, lambda m: ~F.contains(source, F.lower(m))), F.lit(0)).alias(kind)


@evaluator("sans_invention", "reecriture", "conformite")
def no_invention(df: DataFrame) -> DataFrame:
    """V07 — file names, identifiers and numbers of the rewrite must occur in the source."""
    file = F.when(X.bind(F.lower("rewrite"), lambda low: X.holds_any(low, V.FILE_LITERALS)), invented("file", V.FILE_NAME_PATTERN, "(?iU)"))
    first = F.coalesce(file, invented("identifier", V.IDENTIFIER_PATTERN), invented("number", V.NUMBER_PATTERN))
    return _verdict(df, F.when(first.isNull(), "conforme").otherwise("non_conforme"), first)


@evaluator("longueur_bornee", "reecriture", "conformite")
def bounded_length(df: DataFrame) -> DataFrame:
    """V08 — at most twice as long as the original; undecided when the original is empty."""
    a, b = F.length("original"), F.length("rewrite")
    label = F.when(a == 0, UNDECIDED).when(b <= a * 2, "conforme").otherwise("non_conforme")
    return _verdict(df, label, F.when((a > 0) & (b > a * 2), F.concat_ws("/", b.cast("string"), (a * 2).cast("string"))))


@evaluator("reste_francais", "reecriture", "conformite")
def stays_french(df: DataFrame) -> DataFrame:
    """V09 — more French than English function words; undecided without either."""
    fr, en = X.word_count("rewrite", V.FRENCH_WORDS), X.word_count("rewrite", V.ENGLISH_WORDS)
    label = F.when((fr == 0) & (en == 0), UNDECIDED).when(fr > en, "conforme").otherwise("non_conforme")
    return _verdict(df, label, F.concat_ws("/", fr.cast("string"), en.cast("string")))


@evaluator("sans_adresse_directe", "reecriture", "conformite")
def no_direct_address(df: DataFrame) -> DataFrame:
    """V10 — no more words that address the author than the original has."""
    after, before = X.word_count("rewrite", V.ADDRESS_WORDS), X.word_count("original", V.ADDRESS_WORDS)
    return _verdict(df, F.when(after <= before, "conforme").otherwise("non_conforme"), F.concat_ws("/", after.cast("string"), before.cast("string")))


@evaluator("prompt_pas_explication", "reecriture", "conformite")
def not_a_comment(df: DataFrame) -> DataFrame:
    """V11 — the first line that is not blank does not open like a comment on the prompt."""
    line = F.get(F.filter(F.transform(F.split("rewrite", "\n", -1), X.trimmed), lambda x: x != ""), F.lit(0))
    opener = X.first_opener(F.lower(F.coalesce(line, F.lit(""))), V.COMMENT_OPENERS)
    return _verdict(df, F.when(opener.isNull(), "conforme").otherwise("non_conforme"), F.when(opener.isNotNull(), X.truncate(line, 60)))


def coverage_change(original, rewrite, rubric=None) -> dict[str, Column]:
    """V12, E05 — rubric coverage before and after, criteria gained and lost."""
    a, b = X.rubric_hits(original, rubric), X.rubric_hits(rewrite, rubric)
    return {"before": X.coverage_of(a, rubric), "after": X.coverage_of(b, rubric),
            "gained": F.array_except(b, a), "lost": F.array_except(a, b)}


@evaluator("couverture_rubrique", "reecriture", "conformite")
def keeps_rubric(df: DataFrame) -> DataFrame:
    """V12 — the rewrite covers at least as many essential criteria."""
    c = coverage_change("original", "rewrite")
    kept = c["after"] >= c["before"]
    return _verdict(df, F.when(kept, "conforme").otherwise("non_conforme"), F.array_join(F.when(kept, c["gained"]).otherwise(c["lost"]), ", "))


def judge_agreement(code: DataFrame, judge: DataFrame) -> DataFrame:
    """J20 — recorded answers of a judge next to the label of the code for the same case: accord, desaccord, douteux, indeterminable."""
    c = code.select("case_id", F.col("label").alias("_code"), F.col("score").alias("_score"))
    j = judge.select("case_id", F.col("label").alias("_judge"))
    both = c.join(j, "case_id", "left")
    said = F.lower(F.coalesce("_judge", F.lit("")))
    label = (F.when(F.col("_score").isNull() | (said == ""), UNDECIDED).when(said == "doute", "douteux")
             .when(said == F.lower("_code"), "accord").otherwise("desaccord"))
    return both.select("case_id", label.alias("label"))


def agreement_counts(verdicts: DataFrame) -> DataFrame:
    """J20 — how often judge and code agree, disagree, doubt or stay silent."""
    return verdicts.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
