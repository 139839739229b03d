"""What grows with the tables stays cut into parts: groups of rows, replays and windows of a team."""

from __future__ import annotations

import random
import re

from matchforge.operators import identity


def _roots(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components_equal_union_find_on_paths_stars_and_chance(spark):
    rng = random.Random(5)
    path = [(k, k + 1) for k in range(1, 40)]
    zigzag = [x for k in range(20) for x in ((100 + k, 200 + k), (101 + k, 200 + k))]
    chance = [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(150)]
    for links in (path, path[::-1], zigzag, [(900, 700), (900, 800), (900, 900)], path + zigzag + chance, [(7, 7)]):
        got = identity.components(spark.createDataFrame(links, "a long, b long")).collect()
        assert {r["id"]: r["root"] for r in got} == _roots(links) and len(got) == len(_roots(links))


def test_components_leave_out_groups_that_are_whole(spark, monkeypatch):
    written = []
    real = identity.checkpointed
    monkeypatch.setattr(identity, "checkpointed", lambda df: (out := real(df), written.append(out.count()))[0])
    identity.components(spark.range(100).selectExpr("id * 2 as a", "id * 2 + 1 as b")).collect()
    assert sum(written) <= 400


def test_recent_elsewhere_takes_the_last_day(spark, sf):
    from pyspark.sql import functions as F

    from matchforge.plans import lookup_queries
    from matchforge.sources import bridge

    last = bridge.matches(spark, sf).where("league not in ('ASIA', 'AFRICA')").agg(F.max("day").alias("d")).first()["d"]
    got = {r["match_id"] for r in lookup_queries.recent_elsewhere(spark, sf).collect()}
    assert got & {r["match_id"] for r in bridge.matches(spark, sf).where(F.col("day") == F.lit(last)).collect()}


def test_finishing_readiness_counts_every_match(spark, sf):
    from matchforge.plans import lookup_queries
    from matchforge.sources import bridge

    assert sum(r["played"] for r in lookup_queries.finishing_readiness(spark, sf).collect()) == bridge.matches(spark, sf).where("home_goals is not null").count()


def test_paired_tests_draw_each_row_by_itself(spark):
    # One row carries the difference: drawn by itself it is left out in exp(-1) of the replicates, in which the mean is 0.
    from pyspark.sql import functions as F

    from matchforge.operators import gates

    rows = spark.range(4000).selectExpr("'a' as g", "id", "if(id = 7, 4000.0D, 0.0D) as d")
    got = gates.paired_tests(rows, "g", "id", {"d": F.col("d")}, cells=None).first()
    assert (got["n"], got["delta"], got["low"]) == (4000, 1.0, 0.0) and 2.5 < got["high"] < 4.5
    u = spark.range(300).select(F.explode(F.sequence(F.lit(0), F.lit(999)).cast("array<bigint>")).alias("rep"), (F.col("id") * 7919 % 65537).alias("a"), (F.col("id") * 104729 % 65521).alias("b"))
    x = u.select(gates.mixed_uniform(F.col("a"), F.col("b"), F.col("rep")).alias("u"), gates.mixed_uniform(F.col("a"), F.col("b"), F.col("rep") + 1).alias("v")).agg(F.avg("u"), F.variance("u"), F.corr("u", "v")).first()
    assert abs(x[0] - 0.5) < 0.003 and abs(x[1] - 1 / 12) < 0.001 and abs(x[2]) < 0.01


def test_poisson_grid_equals_the_plain_sum_and_its_last_bits_at_equal_rates(spark):
    from math import exp, factorial

    from matchforge.functions import scoring

    def plain(h, a):
        out = [0.0, 0.0, 0.0]
        for j in range(9):
            for i in range(9):
                out[0 if i > j else 1 if i == j else 2] += exp(-h) * h**i / factorial(i) * exp(-a) * a**j / factorial(j)
        return out

    rates = [(0.2, 0.2), (0.2, 6.5), (6.5, 0.2), (1.35, 1.1), (2.2, 3.9), (1.6514, 1.6514), (2.1139, 2.1139), (1.8, 1.8)]
    got = spark.createDataFrame(rates, "h double, a double").select("h", "a", scoring.poisson_grid(*map(spark_col, "ha")).alias("g")).select("h", "a", "g.*").collect()
    for h, a, *p in got:
        assert max(abs(x - y) for x, y in zip(p, plain(h, a), strict=True)) < 1e-14
        if h == a:
            assert (p[0] < p[2]) == (plain(h, a)[0] < plain(h, a)[2])


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_fixtures_read_documents_in_one_pass(spark, sf):
    from matchforge.plans import model_queries

    plan = model_queries.provider_fixtures(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lineitem.parquet") <= 1 and plan.count("l_orderkey") > 0 and "Union" not in plan


def test_probabilities_are_worked_out_once(spark, sf):
    from matchforge.plans import profile_queries

    assert len(profile_queries.calibration_error(spark, sf)._jdf.queryExecution().optimizedPlan().toString()) < 100_000


def test_standings_as_of_cut_by_day_equal_a_plain_table(spark):
    # Two days, two matches on each; a tie of everything keeps the order of the first match.
    rows = [(1, "2020-08-01", "a", "b", 1, 0), (2, "2020-08-01", "c", "a", 1, 0), (3, "2020-08-02", "b", "d", 2, 0), (4, "2020-08-02", "a", "c", 0, 0), (5, "2021-08-02", "a", "c", 0, 0)]
    m = spark.createDataFrame([(k, d, "L", h, a, x, y, None, None) for k, d, h, a, x, y in rows], "match_id long, day string, league string, home string, away string, home_goals int, away_goals int, home_shots int, away_shots int").withColumn("day", spark_col("day").cast("date"))
    from matchforge.operators import features
    from matchforge.sources import bridge

    out = features.standings_as_of(bridge.team_matches(m))
    got = {(r["match_id"], r["team"]): r["rank"] for r in out.collect()}
    # Before 4: b has 3 points and +1, c 3 and +1 but fewer goals, a 3 and 0, d none.
    assert got == {(1, "a"): None, (1, "b"): None, (2, "c"): None, (2, "a"): 1, (3, "b"): 3, (3, "d"): None, (4, "a"): 3, (4, "c"): 2, (5, "a"): None, (5, "c"): None}
    windows = re.findall(r"windowspecdefinition\(([^()]*match_id[^()]*)", out._jdf.queryExecution().optimizedPlan().toString())
    assert all(re.search(r"day#\d+,", w) for w in windows), windows  # no window numbers matches beyond a day


def test_elo_in_stretches_equals_one_replay(spark, sf):
    from matchforge.operators import features
    from matchforge.sources import bridge

    m = bridge.matches(spark, sf)
    whole, cut = (sorted(map(tuple, features.elo(m, batch=n).collect())) for n in (10**9, 50))
    assert whole == cut and len(whole) == m.count()


def test_rolling_known_cut_by_day_equals_a_plain_loop(spark):
    from datetime import date, timedelta

    from matchforge.operators import features

    rng = random.Random(3)
    # Days with many matches of a team, with few, and with none that is known.
    many = {0: 9, 1: 1, 2: 0, 3: 2, 4: 12, 5: 3, 6: 1, 7: 8}
    rows, k = [], 0
    for d, n in many.items():
        for team in "ab":
            for _ in range(n + (team == "b")):
                k += 1
                rows.append((k, date(2020, 1, 1) + timedelta(d), team, None if d == 5 or rng.random() < 0.3 else rng.randrange(9)))
    out = features.rolling_known(spark.createDataFrame(rows, "match_id long, day date, team string, x int"), ["x"], 3)
    want, seen = {}, {"a": [], "b": []}
    for key, _, team, value in rows:
        last = seen[team][-3:]
        want[key] = sum(last) / len(last) if last else None
        if value is not None:
            seen[team].append(value)
    assert {r["match_id"]: r["avg_x"] for r in out.collect()} == want
    assert re.search(r"RepartitionByExpression \[team#\d+, stat#\d+, day#\d+\]", out._jdf.queryExecution().optimizedPlan().toString())


def test_recalibration_predicts_once(spark, sf):
    from matchforge.plans import lookup_queries

    plan = lookup_queries.learning_stats(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 2 and plan.count("Relation [") <= 21


def test_form_of_whole_numbers_and_grid_columns_equal_the_folds_bit_for_bit(spark):
    from itertools import product

    from pyspark.sql import functions as F

    from matchforge.functions import scoring

    lists = [(list(x),) for n in range(6) for x in product("WDL", repeat=n)] + [(list("WDLWWDLLDW"),), (list("LWDDLWDWLL"),)]
    got = spark.createDataFrame(lists, "o array<string>").select(scoring.form_score(F.col("o")).alias("a"), scoring.form_of_fifths(F.transform("o", scoring.fifths), 10).alias("b"))
    assert got.where("a <=> b").count() == len(lists)
    rates = [(0.2, 0.2), (0.2, 6.5), (6.5, 0.2), (1.35, 1.1), (1.6514, 1.6514), (None, 1.0)]
    x = scoring.with_grid(spark.createDataFrame(rates, "h double, a double"), "h", "a", ("x", "y", "z")).withColumn("g", scoring.poisson_grid(*map(spark_col, "ha")))
    assert x.where("x <=> g.home and y <=> g.draw and z <=> g.away").count() == len(rates)


def test_portfolio_is_dealt_by_match_once_and_folds_no_list(spark, sf):
    from matchforge.plans import queries

    plan = queries.portfolio(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(match_id", plan)) == 2  # predictions and prices
    assert "transform(" not in plan and "Generate inline(array(CASE" not in plan
