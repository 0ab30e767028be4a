"""Usage, spend, review, retrospective and vocabulary on hand-written rows."""

import datetime as dt

import random

import pytest
from pyspark.sql import functions as F

from turnstone.functions import exprs as X
from turnstone.operators import dims, retro as T, review as R, usage as U, vocab as L
from turnstone.sources import files as SF, spend as SP


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("day,week", [("2021-01-03", "2020-W53"), ("2024-12-30", "2025-W01"), ("2026-08-18", "2026-W34")])
def test_week_keys(spark, day, week):
    assert one(spark, X.week_key(F.lit(day).cast("date"))) == week
    assert one(spark, X.monday_of_week_key(F.lit(week))) == one(spark, X.monday_of(F.lit(day).cast("date")))


def test_small_expressions(spark):
    assert one(spark, X.monday_of_week_key(F.lit("2021-W53"))) is None and one(spark, X.monday_of_week_key(F.lit("bad"))) is None
    assert one(spark, X.hash31(F.lit("abc"))) == 96354
    assert one(spark, X.pick_variant(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit("abc"), F.lit(1))) == "bca"[96354 % 3]
    assert one(spark, X.thousands(F.lit(-1234567))) == "-1 234 567"
    assert one(spark, X.number_from_text(F.lit("1,234 567"))) == 1234567 and one(spark, X.number_from_text(F.lit("x"))) == 0
    assert float(one(spark, X.money_from_text(F.lit("$1,234.50")))) == 1234.5
    assert one(spark, X.redact(F.lit("secret"), False, 20)) == "(contenu non capturé)" and one(spark, X.redact(F.lit(""), False, 20)) == ""
    assert one(spark, X.make_title(F.lit("  Fais cela maintenant. Puis autre chose"))) == "Fais cela maintenant"
    assert one(spark, X.make_title(F.lit("Court. Puis\nla suite"))) == "Court. Puis la suite"
    assert one(spark, X.call_target(F.lit('{"pattern":"a\\nb","x":1}'))) == "a b" and one(spark, X.call_target(F.lit("broken"))) == ""
    assert one(spark, X.json_has_any(F.lit('{"limit":null}'), ["offset", "limit"])) and not one(spark, X.json_has_any(F.lit("nope"), ["limit"]))


def test_rubric(spark):
    full = ("Corrige le calcul dans lecteur.py, sans casser le reste. Le test doit passer, renvoie un patch parce que la date est fausse, "
            "et va jusqu'au bout, garde le style.")
    assert one(spark, X.rubric_missing(F.lit(full))) == []
    assert one(spark, X.rubric_missing(F.lit("Corrige le calcul"))) == ["perimetre", "acceptation", "contexte", "autonomie", "contraintes", "sortie"]
    assert one(spark, X.rubric_coverage(F.lit("Écris un test"))) == 0.2        # a leading accent is a letter, too


def _weeks(spark, rows):
    return spark.createDataFrame([(f"w{i}", dt.date(2026, 1, 5) + dt.timedelta(weeks=i), *r) for i, r in enumerate(rows)],
                                 "week string, monday date, read_tokens bigint, cache_tokens bigint, opus_tokens bigint, haiku_tokens bigint, tasks bigint, active_days bigint")


@pytest.mark.parametrize("rows,as_of,expected", [
    ([(100, 50, 0, 0, 9, 3), (100, 50, 0, 0, 9, 3)], "2026-02-01", {"sous_utilisation"}),
    ([(100, 50, 0, 0, 9, 3)], "2026-02-01", set()),                                   # a single week cannot be under-used twice
    ([(990, 500, 0, 0, 9, 1)], "2026-02-01", {"plafond_proche", "adoption_faible"}),
    ([(600, 10, 590, 0, 5, 3)], "2026-02-01", {"cache_faible", "monoculture_opus"}),
    ([(600, 300, 0, 590, 4, 3)], "2026-02-01", set()),                                # too few tasks to speak of a habit
    ([(900, 500, 0, 0, 9, 3), (600, 300, 0, 590, 5, 3), (200, 100, 0, 0, 9, 3)], "2026-02-01", {"decrochage"}),
    ([(900, 500, 0, 0, 9, 3), (200, 100, 0, 0, 9, 3)], "2026-01-13", set())])         # the running week is not judged
def test_alerts(spark, rows, as_of, expected):
    assert {r.alert for r in U.alerts(_weeks(spark, rows), as_of, 1000).collect()} == expected


def test_spend_csv(spark, tmp_path):
    f = tmp_path / "spend.csv"
    f.write_text('User Email,Account UUID,Product,Model,Model Family,Request Count,Prompt Tokens,Completion Tokens,Net Spend (USD),Gross Spend (USD)\n'
                 'A@x.org,u1,"Chat, ""web""",m-opus,Opus,3,"1,200",300,$0,$4.50\na@X.org,u1,"two\nlines",m-haiku,Haiku,1,100,50,1.25,2\n,,,,,,,,,\n')
    rows, warned = SP.read_spend(spark, str(f))
    assert not warned and rows.count() == 2 and {r.product for r in rows.collect()} == {'Chat, "web"', "two\nlines"}
    a = U.learner_spend(rows, ["model"]).first()
    assert (a.total_tokens, float(a.spend), a.opus_tokens, a.haiku_tokens, a.requests) == (1650, 5.75, 1500, 150, 4)
    g = tmp_path / "other.csv"
    g.write_text("date,amount\n1,2\n")
    none, warned = SP.read_spend(spark, str(g))
    assert none.count() == 0 and len(warned) == 2


def test_spend_csv_is_cut_anywhere(spark, tmp_path):
    """Many small splits: quoted line breaks, commas and quotes across their borders come out as a reader of the whole file sees them."""
    rnd, rows = random.Random(4), []
    for i in range(400):
        note = "".join(rnd.choice(['a', ' ', ',', '""', "\n", "\n\n", "é"]) for _ in range(rnd.randint(0, 60)))
        rows.append(f'u{i}@x.org,acc,"{note}",m-opus,Opus,{i},{i},1,$1,$2')
    head = "User Email,Account UUID,Product,Model,Model Family,Request Count,Prompt Tokens,Completion Tokens,Net Spend (USD),Gross Spend (USD)"
    for name, part in (("a.csv", rows[:300]), ("b.csv", rows[300:])):
        (tmp_path / name).write_text("\n".join([head, *part]) + "\n")
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "700")
    try:
        got, _ = SP.read_spend(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        found = sorted((r.email, r.product, r.requests) for r in got.collect())
    finally:
        spark.conf.set(key, old)
    plain = spark.read.csv(str(tmp_path), header=True, multiLine=True, quote='"', escape='"')
    want = sorted((r["User Email"], (r["Product"] or "").strip(" "), int(r["Request Count"])) for r in plain.collect())
    assert found == want and len(found) == 400


def test_team_marks_idle_and_under_used(spark):
    l = spark.createDataFrame([("a", 0), ("b", 100), ("c", 900)], "person string, total_tokens bigint")
    got = {r.person: (r.under_used, r.idle) for r in U.team_utilisation(l, 100, 4).collect()}
    assert got == {"a": (True, True), "b": (True, False), "c": (False, False)}
    assert U.team_utilisation(l, 0, 4).filter("under_used OR idle OR utilisation IS NOT NULL").count() == 0


def _points(spark, values, target=0.5, higher=True):
    rows = [("k", f"w{i:02d}", dt.date(2026, 1, 5) + dt.timedelta(weeks=i), v, target, higher, True) for i, v in enumerate(values)]
    return T.trail_points(spark.createDataFrame(rows, "signal string, week string, monday date, value double, target double, higher boolean, ratio boolean"), ["signal"])


@pytest.mark.parametrize("values,verdict,crossed,streak", [
    ([0.1, 0.9], "TropPeuDeDonnees", "w01", 1), ([0.1, 0.2, 0.6, 0.7, 0.8], "Acquis", "w02", 3), ([0.6, 0.7, 0.8], "Acquis", None, 3),
    ([0.1, 0.2, 0.4], "EnProgres", None, 0), ([0.45, 0.4, 0.2], "EnRecul", None, 0), ([0.3, 0.31, 0.3], "Stable", None, 0)])
def test_trend_verdicts(spark, values, verdict, crossed, streak):
    t = T.trails(_points(spark, values), ["signal"]).first()
    assert (t.verdict, t.crossed_week, t.streak) == (verdict, crossed, streak)


def test_silences_and_header(spark):
    mondays = [dt.date(2026, 1, 5) + dt.timedelta(weeks=w) for w in (0, 1, 5, 6, 8)]
    active = spark.createDataFrame([(m,) for m in mondays], "monday date")
    got = T.silences(active).collect()
    assert [(r.from_day, r.to_day, r.weeks) for r in got] == [(dt.date(2026, 1, 19), dt.date(2026, 2, 8), 3)]


def test_observations_once_per_problem_and_win(spark):
    now = spark.createDataFrame([("rework_ratio", 0.9, 3), ("first_try_success", 0.0, 3), ("tool_failure_rate", 0.5, 3), ("self_correction", 0.1, 3), ("autonomy_ratio", 1.0, 3),
                                 ("has_acceptance_criteria", 0.9, 3)], "signal string, mean double, n bigint")
    got = [r.signal for r in R.observations(now).orderBy("rank").collect()]
    assert got == ["autonomy_ratio", "rework_ratio", "self_correction"]
    then = spark.createDataFrame([("has_acceptance_criteria", 0.2), ("self_correction", 0.0)], "signal string, mean double")
    assert [r.signal for r in R.win(now, then).collect()] == ["has_acceptance_criteria"]
    assert R.challenge(now).first().problem == "echec_sans_lecon"
    assert R.challenge(now.filter("signal = 'rework_ratio'")).count() == 0


def test_specs_file_replaces_or_falls_back(spark, tmp_path):
    levels = ",".join(f'"{n}": {{"term": "t{n}", "analogy": "a"}}' for n in range(1, 6))
    good = tmp_path / "good.json"
    good.write_text('{ // own thresholds\n "signaux": [{"cle": "rework_ratio", "palier": 1, "cible": 0.2, "plus_haut_est_mieux": false}],\n'
                    f' "problematiques": [{{"id": "p", "palier": 1, "signaux": ["rework_ratio"]}}], "paliers": {{{levels}}} }}')
    specs, warned = SF.load_specs(spark, str(good))
    assert not warned and [(r.signal, r.target, r.problem) for r in specs.collect()] == [("rework_ratio", 0.2, "p")]
    bad = tmp_path / "bad.json"
    bad.write_text('{"signaux": [{"cle": "rework_ratio", "palier": 1}], "problematiques": [{"id": "p"}]}')
    specs, warned = SF.load_specs(spark, str(bad))
    assert warned and specs.count() == dims.specs(spark).count() == 20
    assert SF.load_specs(spark, str(tmp_path / "absent.json"))[0].count() == 20


def test_packs_and_word_lookup(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"id": "p", "signals": {"prob": ["one", " ", "two"], "sig": "base"}, "races": {"Z": {"signals": {"sig": "own"}}}}')
    (tmp_path / "neutre.json").write_text('{"id": "neutre", "levels": {"1": {"term": "x", "analogy": "y"}}}')
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "maturite.json").write_text('{"id": "m"}')
    packs = SF.load_packs(spark, str(tmp_path))
    assert [r.pack_id for r in packs.collect()] == ["p"]
    v = L.vocabulary_rows(packs)
    asked = spark.createDataFrame([(1, "p", "z", "prob", "sig", 0), (2, "p", None, "prob", "sig", 0), (3, "p", None, "none", "sig", 0), (4, "p", "z", "none", "nope", 0)],
                                  "id int, pack string, side string, problem string, signal string, cycle int")
    got = {r.id: r.words for r in L.pick_words(asked, v, "signals", ["problem", "signal"]).collect()}
    assert got[1] == "own" and got[2] in ("one", "two") and got[3] == "base" and got[4] is None
