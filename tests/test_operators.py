"""Operators on hand-made rows: ties, nulls, empty inputs and the traps of the formulas."""

import math

import pytest
from pyspark.sql import functions as F

from matchforge.functions import scoring, text
from matchforge.operators import evaluate, features, merge


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_form_score_weighs_the_latest_most(spark):
    score = lambda *xs: one(spark, scoring.form_score(F.array(*map(F.lit, xs)) if xs else F.expr("cast(array() as array<string>)")))
    assert score("L", "W") == round(2 / 3, 4) and score("W", "L") == round(1 / 3, 4)
    assert score("D", "?") == 0.4 and score() == 0.0


def test_poisson_grid_is_cut_and_not_scaled(spark):
    h, d, a = (one(spark, c) for c in scoring.poisson_1x2(F.lit(1.3), F.lit(0.9)))
    pmf = lambda k, r: math.exp(-r) * r**k / math.factorial(k)
    want = [sum(pmf(i, 1.3) * pmf(j, 0.9) for i in range(9) for j in range(9) if f(i, j)) for f in (lambda i, j: i > j, lambda i, j: i == j, lambda i, j: i < j)]
    assert [h, d, a] == pytest.approx(want, abs=1e-12) and h + d + a < 1


def test_ties_and_bounds(spark):
    assert one(spark, scoring.likeliest(F.lit(0.4), F.lit(0.4), F.lit(0.2))) == "H"
    assert one(spark, scoring.likeliest(F.lit(0.2), F.lit(0.4), F.lit(0.4))) == "D"
    assert one(spark, scoring.kelly(F.lit(0.5), F.lit(1.0))) == 0.0 and one(spark, scoring.kelly(F.lit(0.6), F.lit(2.0))) == 0.5
    assert one(spark, scoring.implied(F.lit(1.0))) == 0.0
    assert one(spark, scoring.rest_modifier(F.lit(None).cast("int"))) == 1.0


def test_text_parsers(spark):
    assert one(spark, text.leading_number(F.lit("12/17 (71%)"))) == 12.0 and one(spark, text.leading_number(F.lit("n/a"))) is None
    assert one(spark, text.percent(F.lit("85%"))) == 85.0 and one(spark, text.digits(F.lit("7 128"))) == 7128
    assert one(spark, text.slug(F.lit("  Shots on Target! "))) == "shots_on_target"
    assert one(spark, text.alias_of(F.lit(" Málaga "), {"malaga": "malaga cf"})) == "malaga cf" and one(spark, text.alias_of(F.lit(" Xyz "), {"a": "b"})) == "Xyz"


def test_marks_are_taken_off_any_letter(spark):
    import unicodedata

    name = "Şəki Đorđe Łódź Gençlerbirliği Žalgiris Ñandú Ελλάς e\u0301"
    want = "".join(c for c in unicodedata.normalize("NFD", name) if not unicodedata.combining(c))
    assert one(spark, text.unmarked(F.lit(name))) == want


def test_calibration_has_empty_bins_and_a_closed_top(spark):
    rows = spark.createDataFrame([("H", 1.0, 0.0, 0.0)], "result string, p_home double, p_draw double, p_away double")
    got = {(r["class"], r["bin"]): r["n"] for r in evaluate.calibration(rows).collect()}
    assert len(got) == 30 and got["H", 9] == 1 and got["D", 0] == 1 and got["A", 5] == 0


def test_source_rank_keeps_the_first_of_equals(spark):
    rows = spark.createDataFrame([(1, "a", 1, "old"), (1, "a", 2, "new"), (1, "b", 0, "worse"), (1, "z", 0, None), (2, "q", 5, "unknown")], "k int, s string, at int, v string")
    got = {r["k"]: (r["v"], r["s"]) for r in merge.by_source_rank(rows, "k", "s", {"z": 0, "a": 1, "b": 2}, ["at"], "v").collect()}
    assert got == {1: ("old", "a"), 2: ("unknown", "q")}


def test_fill_nulls_overwrites_nothing(spark):
    a = spark.createDataFrame([(1, None, 5), (2, 7, None), (3, None, None)], "k int, x int, y int")
    b = spark.createDataFrame([(1, 1, 1), (2, 2, 2)], "k int, x int, y int")
    once = merge.fill_nulls(a, b, "k", ["x", "y"])
    assert {tuple(r) for r in once.collect()} == {(1, 1, 5), (2, 7, 2), (3, None, None)}
    assert sorted(map(str, merge.fill_nulls(once, b, "k", ["x", "y"]).collect())) == sorted(map(str, once.collect()))


def test_alias_candidates_excludes_pairs_that_met(spark):
    rows = [("d", "l", "A", "X", 1, 0), ("d", "l", "B", "X", 1, 0), ("d", "l", "C", "X", 1, 0), ("e", "l", "A", "C", 0, 0)]
    m = spark.createDataFrame(rows, "day string, league string, home string, away string, home_goals int, away_goals int")
    assert {tuple(r) for r in merge.alias_candidates(m).collect()} == {("A", "B", 1), ("B", "C", 1)}


def test_alias_candidates_take_all_matches(spark):
    """On all matches between clubs, of which most pairs never met, against SQL; one pair of scale 0.1 met."""
    import duckdb

    from matchforge.plans import oracle, queries

    sf = "/root/testdata/sf0.1"
    clubs = oracle.MATCHES.replace("hn.n_name AS home, an.n_name AS away", "'club ' || c_custkey AS home, 'club ' || s_suppkey AS away").replace("hn.n_name <> an.n_name", "c_custkey <> s_suppkey")
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(f"""WITH {clubs}, s AS (SELECT DISTINCT day, league, 'h' AS side, home AS name, away AS other, home_goals, away_goals FROM m UNION SELECT DISTINCT day, league, 'a', away, home, home_goals, away_goals FROM m),
        c AS (SELECT a.name AS one, b.name AS two, count(*) AS evidence FROM s a JOIN s b USING (day, league, side, other, home_goals, away_goals) WHERE a.name < b.name GROUP BY 1, 2)
        SELECT one, two, evidence, EXISTS (SELECT 1 FROM m WHERE least(home, away) = one AND greatest(home, away) = two) AS met FROM c""").fetchall()
    got = sorted(map(tuple, queries.queries()["club_alias_candidates"](spark, sf).collect()))
    assert got == sorted(r[:3] for r in want if not r[3]) and len(got) > 50 and any(r[3] for r in want)


def test_elo_is_one_replay_over_leagues_and_rounds_only_when_read(spark):
    """Teams keep their ratings from league to league; a plain replay gives the same numbers, and teams that never meet don't matter."""
    rows = [(1, "2024-01-01", "l", "a", "b", 2, 0), (2, "2024-01-08", "l", "b", "a", 1, 1), (3, "2024-01-05", "other", "a", "c", 0, 3), (4, "2024-01-02", "l", "x", "y", 5, 0)]
    rows += [(k, f"2024-02-{k:02d}", "l", "abc"[k % 3], "abc"[(k + 1 + k % 2) % 3], k % 4, k % 3) for k in range(5, 29)]
    m = spark.createDataFrame(rows, "match_id int, day string, league string, home string, away string, home_goals int, away_goals int").withColumn("day", F.to_date("day"))
    rating, played, want = {}, {}, {}
    for i, _, _, h, a, hg, ag in sorted(rows, key=lambda r: (r[1], r[0])):
        rh, ra = rating.get(h, 1500.0), rating.get(a, 1500.0)
        lead, gap = rh + 50 - ra, abs(hg - ag)
        m_ = 1.0 if not gap else math.log(gap + 1) * (4.4 / (0.0005 * (lead if hg > ag else -lead) + 4.4))
        d = m_ * ((1.0 if hg > ag else 0.5 if hg == ag else 0.0) - 1 / (1 + 10 ** (-lead / 400)))
        rating[h], rating[a] = rh + (40 if played.get(h, 0) < 10 else 32) * d, ra - (40 if played.get(a, 0) < 10 else 32) * d
        played[h], played[a] = played.get(h, 0) + 1, played.get(a, 0) + 1
        want[i] = tuple(map(round, (rh, ra, rating[h], rating[a])))
    got = {r["match_id"]: (r["home_elo"], r["away_elo"], r["home_elo_after"], r["away_elo_after"]) for r in features.elo(m).collect()}
    assert got == want and got[3][0] != 1500 and len({g for _, g in features.team_groups(m).collect()}) == 2


def test_elo_streams_a_league_in_small_batches(spark, sf):
    """No task gathers a league, and neither the batches nor leagues that share a task change a rating."""
    import __spark_entry__ as e

    elo = lambda: e.queries()["elo_replay"](spark, sf)
    assert "FlatMapGroups" not in elo()._jdf.queryExecution().executedPlan().toString()
    want = sorted(map(tuple, elo().collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(tuple, elo().collect())) == want and len(want) > 1000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_runs_and_trend(spark):
    rows = spark.createDataFrame([("g", k, float(k), k > 2) for k in range(1, 6)] + [("all", 1, 1.0, True)], "g string, n int, v double, bad boolean")
    runs = {r["g"]: r["run"] for r in evaluate.leading_run(rows, "g", [F.desc("n")], F.col("bad")).collect()}
    assert runs == {"g": 3, "all": 1}
    t = {r["g"]: (r["early"], r["late"]) for r in evaluate.trend(rows, "g", [F.col("n")], "v").collect()}
    assert t["g"] == (1.5, 4.0) and t["all"] == (None, 1.0)


def test_prefix_of_the_entry_works_without_the_corpus_part():
    import __spark_entry__ as e

    assert "league_report" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
