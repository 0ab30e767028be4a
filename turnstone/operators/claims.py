"""Text claims against a reference dictionary, and dictionary lookups.

The dictionary is a table: ``entity, alias, side, kind ('unit' or 'building'), air, cloaked, detector``; one row per
name or alias. ``terms`` lists further anchor words. How the joins run follows the sizes Spark measures.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions import exprs as X
from turnstone.functions import fixed_values as V

_TOKEN = r"(?U)[\w'’-]+"
_EDGE = r"[\w'’-]"
SAMPLE = 100              # one text in so many is looked at for frequent words; it only decides how rows are spread
FREQUENT = 1_000          # rows of a word in that sample (some 100,000 in all) from which its rows go to several tasks
SPREAD = 16               # tasks that share a frequent word


def spread_join(rows: DataFrame, key: str, names: DataFrame, name_key: str, how: str = "inner") -> DataFrame:
    """``rows`` (with ``text_id``) joined to ``names`` where ``key`` equals ``name_key``; a frequent word does not meet in one task.

    Rows of a frequent word are dealt to ``SPREAD`` parts by their text, and its names are repeated for every part; all others are part 0.
    A word the sample misses is joined in one part: the result does not depend on it.
    """
    seen = rows.filter(F.pmod(F.xxhash64("text_id"), F.lit(SAMPLE)) == 0).groupBy(F.col(key).alias("_often")).agg(F.count(F.lit(1)).alias("_c"))
    often = F.broadcast(seen.filter(F.col("_c") >= FREQUENT).select("_often"))               # at most one word in FREQUENT rows of the sample
    mine = F.when(F.col("_often").isNotNull(), F.pmod(F.xxhash64("text_id", F.lit("part")), F.lit(SPREAD))).otherwise(0).cast("int")
    parts = F.when(F.col("_often").isNotNull(), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    dealt = rows.join(often, F.col(key) == F.col("_often"), "left").withColumn("_part", mine).drop("_often")
    copies = names.join(often, F.col(name_key) == F.col("_often"), "left").withColumn("_copy", F.explode(parts)).drop("_often")
    return dealt.join(copies, (F.col(key) == F.col(name_key)) & (F.col("_part") == F.col("_copy")), how).drop("_part", "_copy")


def _pieces(text: Column) -> Column:
    """The text cut into words and what lies between them; words stand at the even places (from 0)."""
    cut = F.regexp_extract_all(text, F.lit(r"(?U)[\w'’-]+|[^\w'’-]+"), F.lit(0))
    return F.when(text.rlike(r"(?U)^[\w'’-]"), cut).otherwise(F.concat(F.array(F.lit("")), cut))


def word_runs(text: Column, lengths: Column) -> Column:
    """All runs of so many words of a text, in lower case, with what lies between them as it is written."""
    def of(pieces: Column, n: Column) -> Column:
        first = F.when(F.element_at(pieces, 1) == "", 3).otherwise(1)
        last = F.size(pieces) - 2 * (n - 1)
        return F.when(last >= first, F.transform(F.sequence(first, last, F.lit(2)), lambda i: F.array_join(F.slice(pieces, i, 2 * n - 1), ""))).otherwise(F.array().cast("array<string>"))

    # the pieces are bound to a variable, else every run would cut the text again
    return X.bind(_pieces(F.lower(text)), lambda pieces: F.flatten(F.transform(lengths, lambda n: of(pieces, n))))


def mentions(texts: DataFrame, names: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """J16 — which names occur in which text, as whole words, with an optional plural ``s``, case ignored.

    A name is found by its whole run of words: a text's runs of as many words as names have meet the names in one equi join, whatever
    the length of the name. A run counts once per text, and frequent ones are spread (``spread_join``). Names that don't begin and end with a word character have no such run; these
    few meet the texts that hold their words and are searched there.
    """
    keep = keep or ["entity"]
    shape = names.select(*keep, F.lower("alias").alias("_alias"), _pieces(F.col("alias")).alias("_p"),
                         F.col("alias").rlike(r"(?U)^[\w'’-](.*[\w'’-])?$").alias("_whole"))
    whole = shape.filter("_whole").withColumn("_n", F.ceil(F.size("_p") / 2).cast("int"))
    lengths = whole.agg(F.coalesce(F.array_sort(F.collect_set("_n")), F.array().cast("array<int>")).alias("_lengths"))          # one row: the names' lengths in words
    runs = texts.select("text_id", "text").crossJoin(F.broadcast(lengths)).select("text_id", F.explode(F.array_distinct(word_runs(F.col("text"), F.col("_lengths")))).alias("_run"))
    forms = whole.select(*keep, F.explode(F.array("_alias", F.concat("_alias", F.lit("s")))).alias("_form"))
    found = spread_join(runs, "_run", forms, "_form").select("text_id", *keep)
    literal = F.concat(F.lit(V.UNICODE_FLAGS + f"(?<!{_EDGE})" + r"\Q"), "_alias", F.lit(r"\E" + f"s?(?!{_EDGE})"))
    words = lambda c: F.explode(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(0)), lambda x: F.lower(x))))
    odd = shape.filter("NOT _whole").select(*keep, "_alias", words(F.col("_alias")).alias("_w"))
    some = F.broadcast(odd.agg(F.count(F.lit(1)).alias("_odd")).filter("_odd > 0"))                  # a row when there are such names: only then texts are cut
    maybe = texts.select("text_id", "text").crossJoin(some).select("text_id", words(F.col("text")).alias("_w")).join(odd, "_w").select("text_id", *keep, "_alias").distinct()
    rest = maybe.join(texts.select("text_id", "text"), "text_id").filter(F.rlike(F.col("text"), literal)).select("text_id", *keep)
    return found.unionByName(rest).distinct()


def unknown_names(texts: DataFrame, names: DataFrame, terms: DataFrame) -> DataFrame:
    """V13 — capitalised words inside a sentence that the dictionary, its mechanics and the common words don't know; one row per place.

    Of ``terms`` those of ``kind`` mechanic count as known (all, when the column is absent): slang does not excuse a name.
    """
    found = texts.select("text_id", F.explode(F.regexp_extract_all("text", F.lit("(?U)" + V.CLAIM_CAPITALISED), F.lit(1))).alias("candidate"))
    low = F.lower("candidate")
    found = found.withColumns({"_low": low, "_head": F.element_at(F.split(low, " "), 1)})
    common = [w.lower() for w in V.CLAIM_COMMON_WORDS]
    found = found.filter(~F.col("_low").isin(common) & ~F.col("candidate").isin(V.CLAIM_SIDE_NAMES))
    mechanics = terms.filter("kind = 'mechanic'") if "kind" in terms.columns else terms
    known = names.select(F.lower("alias").alias("_k")).union(mechanics.select(F.lower("term")))
    units = names.select(F.lower("alias").alias("_k")).distinct()
    # a candidate may also be the beginning of a longer name: every leading part of a name, cut at a blank
    parts = F.split(F.lower("alias"), " ")
    prefixes = names.filter(F.contains("alias", F.lit(" "))).select(F.explode(F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), " "))).alias("_k"))
    out = spread_join(found, "_low", known.union(prefixes).distinct(), "_k", "left_anti")
    return spread_join(out, "_head", units, "_k", "left_anti").select("text_id", "candidate")


def wrong_side(texts: DataFrame, names: DataFrame) -> DataFrame:
    """V13 — a possessive that gives the player an entity of another side; texts carry their ``side``."""
    owned = texts.filter(F.coalesce("side", F.lit("")) != "").select("text_id", "side", F.explode(
        F.regexp_extract_all("text", F.lit(V.UNICODE_FLAGS + V.CLAIM_POSSESSIVE), F.lit(1))).alias("word"))
    n = names.filter("kind = 'unit'").select(F.lower("alias").alias("_k"), "entity", F.col("side").alias("_of"))
    hit = owned.join(n, F.lower("word") == F.col("_k")).filter((F.coalesce("_of", F.lit("")) != "") & (F.lower("_of") != F.lower("side")))
    return hit.select("text_id", "word", "entity")


def check_claims(texts: DataFrame, names: DataFrame, terms: DataFrame) -> DataFrame:
    """V13 — one row per issue: text_id, level (Erreur, Doute), rule, detail."""
    traits = ["entity", "kind", "air", "cloaked", "detector"]
    off = F.lit(False)
    anchors = terms.select(F.col("term").alias("entity"), F.col("term").alias("alias"), F.lit("term").alias("kind"), off.alias("air"), off.alias("cloaked"), off.alias("detector"))
    found = mentions(texts, names.select("alias", *traits).unionByName(anchors), traits)
    unit = F.col("kind") == "unit"
    facts = found.groupBy("text_id").agg(F.bool_or(unit).alias("named"), F.bool_or(unit & F.col("cloaked")).alias("menace"), F.bool_or(unit & F.col("detector")).alias("reveals"),
                                         F.bool_or(unit & F.col("air")).alias("flies"), F.lit(True).alias("anchored"))
    t = texts.select("text_id", "text").join(facts, "text_id", "left").fillna(False, ["named", "menace", "reveals", "flies", "anchored"])
    answer = F.col("reveals") | X.word_match("text", V.CLAIM_SCAN)
    threat = X.word_match("text", V.CLAIM_THREAT) & ~F.col("menace") & ~answer
    detection = ~threat & X.word_match("text", V.CLAIM_DETECTION) & F.col("named") & ~F.col("menace") & ~answer
    outdated = F.regexp_extract_all("text", F.lit(V.UNICODE_FLAGS + V.CLAIM_OUTDATED), F.lit(0))

    def issue(test: Column, level: str, rule: str) -> Column:
        return F.when(test, F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule"), F.lit("").alias("detail")))

    per_text = F.array_compact(F.array(
        issue(threat, "Erreur", "invisible sans nom"), issue(detection, "Erreur", "détection mal attribuée"),
        issue(X.word_match("text", V.CLAIM_ANTI_AIR) & ~F.col("flies"), "Erreur", "anti-aérien sans air"),
        issue(~F.col("anchored"), "Doute", "sans ancrage")))
    old = F.transform(outdated, lambda m: F.struct(F.lit("Erreur").alias("level"), F.lit("supply d'avant-patch").alias("rule"), m.alias("detail")))
    rows = t.select("text_id", F.explode(F.concat(per_text, old)).alias("i")).select("text_id", "i.*")
    unknown = unknown_names(texts, names, terms).select("text_id", F.lit("Doute").alias("level"), F.lit("unité inconnue").alias("rule"), F.col("candidate").alias("detail"))
    side = wrong_side(texts, names).select("text_id", F.lit("Erreur").alias("level"), F.lit("mauvais camp").alias("rule"), F.concat_ws(": ", "word", "entity").alias("detail"))
    return reduce(DataFrame.unionByName, [rows, unknown, side])


def lint_summary(texts: DataFrame, issues: DataFrame) -> DataFrame:
    """V14 — texts, clean texts, errors and doubts per pack, and the verdict on the pack."""
    per_text = issues.groupBy("text_id").agg(F.count_if(F.col("level") == "Erreur").alias("e"), F.count_if(F.col("level") == "Doute").alias("d"))
    zero = F.lit(0).cast("bigint")
    return (texts.select("pack", "text_id").join(per_text, "text_id", "left").groupBy("pack").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(F.col("e").isNull()).alias("clean"), F.sum(F.coalesce("e", zero)).alias("errors"), F.sum(F.coalesce("d", zero)).alias("doubts"))
        .withColumn("label", F.when(F.col("errors") == 0, "conforme").otherwise("non_conforme")))


def judge_rules(expected: DataFrame, issues: DataFrame) -> DataFrame:
    """V15, E04 — the set of rules a text triggers must be the expected set; missing and superfluous ones are named."""
    got = issues.groupBy("text_id").agg(F.collect_set("rule").alias("_got"))          # at most one item per rule
    j = expected.join(got, "text_id", "left").withColumn("_got", F.coalesce("_got", F.array().cast("array<string>")))
    missing, extra = F.array_sort(F.array_except("rules", "_got")), F.array_sort(F.array_except("_got", "rules"))
    return j.select("text_id", missing.alias("missing"), extra.alias("superfluous"),
                    F.when((F.size(missing) == 0) & (F.size(extra) == 0), "conforme").otherwise("non_conforme").alias("label"))


# ----------------------------------------------------------------------------------------- lookups
def _norm(c) -> Column:
    return F.replace(F.lower(X._c(c)), F.lit("-"), F.lit(" "))


def _grams(c: str, size: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - (size - 1))), lambda i: F.substring(F.col(c), i, F.lit(size))))


def _rarest(rows: DataFrame, key: str, text: str, freq: DataFrame) -> DataFrame:
    """``key, _g``: the piece of each text that the fewest names have. A text with a piece that no name has is left out."""
    pieces = rows.select(key, F.explode("_pieces").alias("_g")).join(freq, "_g", "left")
    best = pieces.groupBy(key).agg(F.min_by("_g", F.struct("_f", "_g")).alias("_g"), F.bool_or(F.col("_f").isNull()).alias("_none"))
    return best.filter("NOT _none").drop("_none")


def containing(asked: DataFrame, pool: DataFrame, n: int = 3) -> DataFrame:
    """``_q`` of ``asked`` with the rows of ``pool`` (``_a``) whose text contains it.

    A request is looked up under the one piece of ``n`` characters that is rarest among the names, so a piece that many names share is a
    key only where a request has no other. Requests shorter than a piece are looked up whole among pieces of their length.
    """
    q = asked.select("_q").distinct()
    pieces = pool.withColumn("_g", F.explode(_grams("_a", n)))
    freq = pieces.groupBy("_g").agg(F.count(F.lit(1)).alias("_f"))
    out = _rarest(q.filter(F.length("_q") >= n).withColumn("_pieces", _grams("_q", n)), "_q", "_q", freq).join(pieces, "_g").filter(F.contains("_a", F.col("_q")))
    for size in range(1, n):
        out = out.unionByName(q.filter(F.length("_q") == size).withColumn("_g", F.col("_q")).join(pool.withColumn("_g", F.explode(_grams("_a", size))), "_g").filter(F.contains("_a", F.col("_q"))))
    return asked.join(out.drop("_g"), "_q")


def contained(asked: DataFrame, pool: DataFrame, n: int = 3) -> DataFrame:
    """``_q`` of ``asked`` with the rows of ``pool`` whose text ``_a`` lies in it: each name is filed under its own rarest piece."""
    q, names = asked.select("_q").distinct(), pool.select("_a").distinct().filter("length(_a) > 0")
    long = names.filter(F.length("_a") >= n).withColumn("_pieces", _grams("_a", n))
    freq = long.select(F.explode("_pieces").alias("_g")).groupBy("_g").agg(F.count(F.lit(1)).alias("_f"))
    out = q.withColumn("_g", F.explode(_grams("_q", n))).join(_rarest(long, "_a", "_a", freq), "_g")
    for size in range(1, n):
        out = out.unionByName(q.withColumn("_g", F.explode(_grams("_q", size))).join(names.filter(F.length("_a") == size).withColumn("_g", F.col("_a")), "_g"))
    return asked.join(out.filter(F.contains("_q", F.col("_a"))).select("_q", "_a").distinct(), "_q").join(pool, "_a")


def _first(found: DataFrame, what: str, order: list[str], hints: int) -> DataFrame:
    """``request_id, suggestions``: the first ``hints`` per request, cut before they are gathered."""
    w = Window.partitionBy("request_id").orderBy(*order)
    best = found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= hints)
    return best.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(what).alias("w")))), lambda x: x["w"]).alias("suggestions"))


def lookup(requests: DataFrame, names: DataFrame, hints: int = 5, n: int = 3) -> DataFrame:
    """J17 — entity of each asked name, case ignored and ``-`` equal to a blank; misses get up to five suggestions.

    Suggestions are names that contain the asked text or are contained in it.
    """
    keyed = names.select("entity", _norm("alias").alias("_k")).groupBy("_k").agg(F.min("entity").alias("entity"))
    got = requests.withColumn("_k", _norm("asked")).join(keyed, "_k", "left")
    miss = got.filter("entity IS NULL").select("request_id", F.lower("asked").alias("_q")).filter(~X.is_blank("_q"))
    pool = names.select("entity", F.lower("alias").alias("_a")).distinct()
    both = containing(miss, pool, n).select("request_id", "entity").unionByName(contained(miss, pool, n).select("request_id", "entity")).distinct()
    best = _first(both, "entity", ["entity"], hints)
    return got.join(best, "request_id", "left").select("request_id", "asked", "entity", F.when(F.col("entity").isNull(), F.coalesce("suggestions", F.array().cast("array<string>"))).alias("suggestions"))


def lookup_terms(requests: DataFrame, terms: DataFrame, names: DataFrame, hints: int = 5, n: int = 3) -> DataFrame:
    """J17 — what an asked term is: ``kind`` mechanic, slang or, when it is no term, entity; ``found`` is its name.

    Mechanics come before slang and both before entities. A miss gets up to five terms that contain the asked text, mechanics first, in
    the order of their names (``place``, where the table has it); terms inside the asked text are no suggestion.
    """
    place = F.col("place") if "place" in terms.columns else F.lit(0)
    known = terms.select("term", "kind", place.alias("_place"), F.when(F.col("kind") == "mechanic", 0).otherwise(1).alias("_rank"))
    of_term = known.groupBy(_norm("term").alias("_k")).agg(F.min(F.struct("_rank", "_place", "term", "kind")).alias("_t"))
    of_name = names.groupBy(_norm("alias").alias("_k")).agg(F.min("entity").alias("_e"))
    asked = requests.withColumn("_k", _norm("asked")).join(of_term, "_k", "left").join(of_name, "_k", "left")
    found = F.coalesce("_t.term", F.col("_e").cast("string"))
    got = asked.select("request_id", "asked", F.when(F.col("_t").isNotNull(), F.col("_t.kind")).when(F.col("_e").isNotNull(), "entity").alias("kind"), found.alias("found"))
    miss = got.filter("kind IS NULL").select("request_id", F.lower("asked").alias("_q")).filter(~X.is_blank("_q"))
    best = _first(containing(miss, known.withColumn("_a", F.lower("term")), n), "term", ["_rank", "_place", "term"], hints)
    return got.join(best, "request_id", "left").withColumn("suggestions", F.when(F.col("kind").isNull(), F.coalesce("suggestions", F.array().cast("array<string>"))))


def situations(requests: DataFrame, known: DataFrame) -> DataFrame:
    """J18 — situations for a signal (case ignored) and/or a level; a miss answers with the covered signals.

    The covered signals are the distinct signals of the reference, a list as long as the signal table.
    """
    r = requests.select("request_id", F.lower("signal").alias("_s"), F.col("level").alias("_l")).filter("_s IS NOT NULL OR _l IS NOT NULL")
    k = known.select("situation_id", F.lower("signal").alias("_s"), F.col("level").alias("_l"))
    counted = [F.count(F.lit(1)).alias("found"), F.min("situation_id").alias("first")]

    def by(keys: list[str], asked: DataFrame) -> DataFrame:
        """The situations are counted per key before they meet the requests: at most one row per request."""
        return asked.join(k.dropna(subset=keys).groupBy(*keys).agg(*counted), keys).select("request_id", "found", "first")

    counts = reduce(DataFrame.unionByName, [by(["_s"], r.filter("_l IS NULL")), by(["_l"], r.filter("_s IS NULL")),
                                            by(["_s", "_l"], r.filter("_s IS NOT NULL AND _l IS NOT NULL"))])
    covered = known.agg(F.array_join(F.array_sort(F.collect_set("signal")), ", ").alias("covered"))
    out = requests.select("request_id", "signal", "level").join(counts, "request_id", "left").crossJoin(F.broadcast(covered))     # one row
    return out.select("request_id", F.coalesce("found", F.lit(0).cast("bigint")).alias("found"), "first", F.when(F.col("found").isNull(), F.col("covered")).alias("covered"))
