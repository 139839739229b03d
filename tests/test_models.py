"""State machines, champions, identity groups, explanations, filters and CSV types against plain loops and by hand."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from matchforge.functions import scoring
from matchforge.operators import champions, explain, filters, identity, machines, merge
from matchforge.sources import csv_files


def test_machine_equals_a_loop(spark):
    """One entity has most of the log, so it is cut over tasks."""
    rng = random.Random(2)
    states = list(machines.CHALLENGER)
    names = ["hot"] * 700 + ["a"] * 40 + ["b"] * 3 + [None] * 5
    rows = [(n, datetime(2024, 1, 1) + timedelta(minutes=rng.randint(0, 300)), k, rng.choice([*states, "?", None])) for k, n in enumerate(names)]
    rows += [("ok", datetime(2024, 1, 1, k), 9000 + k, s) for k, s in enumerate(["WAITING", "EVALUATING", "SUCCEEDED", "PROMOTED"])]
    df = spark.createDataFrame(rows, "who string, at timestamp, id long, target string").repartition(5)
    got = {r["entity"]: r for r in machines.replay(df, machines.CHALLENGER, "CREATED", "who", "at", "id", "target", parts=7).collect()}
    assert len(got) == 5
    for who in got:
        state, refused, first = "CREATED", 0, None
        mine = sorted((r for r in rows if r[0] == who), key=lambda r: (r[1], r[2]))
        for _, at, key, target in mine:
            if target in machines.CHALLENGER[state]:
                state = target
            else:
                refused += 1
                first = first or (at, key, state)
        r = got[who]
        assert (r["steps"], r["refused"], r["state"]) == (len(mine), refused, state)
        assert (r["refused_at"], r["refused_tie"], r["refused_from"]) == (first or (None, None, None))
    assert machines.replay(df.where("false"), machines.CHALLENGER, "CREATED", "who", "at", "id", "target").count() == 0


def test_champion_periods_by_hand(spark):
    log = [("x", 1, "rollback", None), ("x", 2, "promote", "a"), ("x", 3, "rollback", None), ("x", 4, "promote", "b"), ("x", 5, "rollback", None), ("x", 6, "rollback", None), ("x", 7, "rollback", None), ("x", 8, "promote", "c"), ("x", 9, "rollback", None), ("y", 2, "promote", "z"), ("y", 2, "noise", "q")]
    df = spark.createDataFrame([(s, datetime(2024, 1, d), k, kind, run) for k, (s, d, kind, run) in enumerate(log)], "scope string, at timestamp, seq long, kind string, run string")
    p = champions.periods(df)
    got = [(r["scope"], r["since"].day, r["until"].day if r["until"] else None, r["run"], r["predecessor"]) for r in p.orderBy("scope", "since").collect()]
    # The second rollback brings back what the first undid; the first champion cannot be rolled back.
    assert got == [("x", 2, 4, "a", None), ("x", 4, 5, "b", "a"), ("x", 5, 6, "a", "b"), ("x", 6, 7, "b", "a"), ("x", 7, 8, "a", "b"), ("x", 8, 9, "c", "a"), ("x", 9, None, "a", "c"), ("y", 2, None, "z", None)]
    rows = spark.createDataFrame([(s, date(2024, 1, 1) + timedelta(days=k)) for s in ("x", "y", "w") for k in range(70)], "league string, day date")
    at = {(r["league"], r["day"]): r["champion"] for r in champions.as_of(rows, p, "league", "day").collect()}
    assert len(at) == 210 and at["w", date(2024, 1, 9)] is None and at["x", date(2024, 1, 1)] is None
    assert [at["x", date(2024, 1, d)] for d in range(2, 11)] == ["a", "a", "b", "a", "b", "a", "c", "a", "a"] and at["x", date(2024, 3, 10)] == "a" and at["y", date(2024, 2, 20)] == "z"


def test_comparison_says_better_only_if_all_metrics_are(spark):
    rows = [("k", "H", 0.6, 0.2, 0.2, 0.4, 0.3, 0.3), ("k", "A", 0.2, 0.2, 0.6, 0.5, 0.2, 0.3), ("k", None, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0), ("m", "H", 0.4, 0.3, 0.3, 0.4, 0.3, 0.3), ("k", "D", 0.1, 0.8, 0.1, None, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "key string, result string, a double, b double, c double, d double, e double, f double")
    got = {r["key"]: r for r in champions.compare(df, ["key"], ("a", "b", "c"), ("d", "e", "f")).collect()}
    assert got["k"]["n"] == 2 and got["k"]["accuracy_delta"] == 0.5 and got["k"]["log_loss_delta"] < 0 and got["k"]["better"] is True
    assert got["m"]["better"] is False and got["m"]["brier_delta"] == 0


def plain_groups(rows, kinds, facts):
    """Union-find, again and again with one kind less."""
    out = {}

    def split(rows, n):
        if not n:
            out.update({r["id"]: (r["id"], 0) for r in rows})
            return
        up = {r["id"]: r["id"] for r in rows}

        def find(i):
            while up[i] != i:
                i = up[i]
            return i

        seen = {}
        for k in list(kinds)[:n]:
            for r in rows:
                v = tuple(r[c] for c in kinds[k])
                if None not in v:
                    a, b = find(r["id"]), find(seen.setdefault((k, v), r["id"]))
                    up[max(a, b)] = min(a, b)
        torn = []
        for root in {find(r["id"]) for r in rows}:
            mine = [r for r in rows if find(r["id"]) == root]
            if any(len({r[f] for r in mine if r[f] is not None}) > 1 for f in facts):
                torn += mine
            else:
                out.update({r["id"]: (root, n) for r in mine})
        if torn:
            split(torn, n - 1)

    split(rows, len(kinds))
    return out


def test_groups_equal_union_find(spark):
    rng = random.Random(8)
    none = lambda v, p=0.2: None if rng.random() < p else v
    rows = [{"id": i, "a": none(rng.randint(0, 90)), "b": none(rng.randint(0, 60)), "c": none(rng.randint(0, 120)), "goals": none(rng.randint(0, 1), 0.7), "cards": none(1, 0.5)} for i in range(250)]
    # A chain that only many rounds follow, and a hub that a third of the rows share.
    rows += [{"id": 1000 + i, "a": 5000 + i // 2, "b": 6000 + (i + 1) // 2, "c": None, "goals": None, "cards": 1} for i in range(60)]
    rows += [{"id": 2000 + i, "a": 9999, "b": None, "c": None, "goals": 3, "cards": None} for i in range(150)]
    kinds = {"first": ["a"], "second": ["b"], "third": ["c"]}
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id long, a int, b int, c int, goals int, cards int").repartition(4)
    got = {r["id"]: (r["root"], r["evidence"]) for r in identity.groups(df, kinds, ["goals", "cards"]).collect()}
    assert got == plain_groups(rows, kinds, ["goals", "cards"])
    assert len({n for _, n in got.values()}) == 4  # every number of kinds occurs, refused merges too


def test_reconciled_keeps_the_canonical_row(spark):
    rows = [(1, 2, None, "x", 7), (2, 1, None, None, None), (3, 1, 5, None, None), (4, None, 1, None, None), (5, 1, None, None, None)]
    df = spark.createDataFrame(rows, "id long, rank int, xg int, venue string, cards int")
    groups = spark.createDataFrame([(1, 1, 1, False), (2, 1, 1, False), (3, 1, 1, False), (4, 4, 1, False), (5, 4, 1, False)], "id long, root long, evidence int, refused boolean")
    got = {r["root"]: r for r in identity.reconciled(df, groups, "rank", ["xg", "venue", "cards"]).collect()}
    assert (got[1]["canonical"], got[1]["superseded"], got[1]["gaps"]) == (2, [1, 3], ["xg", "venue", "cards"])
    assert (got[4]["canonical"], got[4]["superseded"], got[4]["gaps"], got[4]["rows"]) == (None, None, None, 2)


def test_waterfall_adds_up(spark):
    rows = [(1, 1.4, 1.1, 0.9, 1.2, 1.6, None, 0.8, None, 0.8, 0.3, 0.1, 4, 1.9, 0.8), (2, 1.0, 1.0, 1.0, 1.0, None, None, None, None, 0.5, 0.5, 0.0, 0, 1.2, 1.0)]
    df = spark.createDataFrame(rows, "match_id long, home_att double, away_att double, home_def double, away_def double, home_elo_att double, away_elo_att double, home_elo_def double, away_elo_def double, home_form double, away_form double, modifier double, meetings int, home_xg double, away_xg double")
    got = explain.waterfall(df).orderBy("match_id", "step").collect()
    assert [r["factor"] for r in got[:6]] == list(explain.FACTORS)
    for k in (0, 6):
        r = rows[k // 6]
        last = spark.range(1).select(scoring.poisson_1x2(F.lit(r[-2]), F.lit(r[-1]))[0].alias("x")).first()["x"]
        assert got[k + 5]["p_home"] == round(last, 4) and sum(x["points"] for x in got[k : k + 6]) == pytest.approx(100 * last, abs=0.03)
    assert got[1]["points"] != 0 and got[7]["points"] == 0 and got[8]["points"] == 0 and got[9]["points"] > 0


def test_filters_reach_the_scan(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    plan = filters.matching(orders, {"or": [{"o_orderstatus": {"eq": "F"}}, {"and": [{"o_custkey": {"gt": 5}}, {"o_orderkey": {"in": [1, 2, 3]}}]}]})._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(EqualTo(o_orderstatus,F),And(GreaterThan(o_custkey,5),In(o_orderkey, [1,2,3])))]" in plan.replace("\n", "")
    long = filters.matching(orders, {"o_orderkey": {"not_in": list(range(500))}})._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in long


def test_filters_on_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, x string")
    ids = lambda d: sorted(r["id"] for r in filters.matching(df, d).collect())
    assert ids({"x": {"not_in": ["a"]}}) == [3] and ids({"x": {"not_in": ["a", *map(str, range(300))]}}) == [3]
    assert ids({"x": {"is": None}}) == [2] and ids({"not": {"x": {"eq": "a"}}}) == [3] and ids({"or": []}) == [] and ids({"and": []}) == [1, 2, 3]
    assert ids({"x": {"not_in": [None]}}) == [] and ids({"x": {"in": ["a", *map(str, range(300))]}, "id": {"lt": 3}}) == [1]


def test_pages_go_on_where_the_last_ended(spark):
    df = spark.createDataFrame([(k % 7, k) for k in range(50)], "day int, id int").repartition(4)
    order, seen, after = [("day", True), ("id", False)], [], None
    while True:
        got = filters.page(df, order, 8, after).collect()
        if not got:
            break
        seen += [tuple(r) for r in got]
        after = got[-1].asDict()
    assert seen == sorted(((k % 7, k) for k in range(50)), key=lambda r: (-r[0], r[1]))


def test_backfill_fills_nulls_only(spark):
    stored = spark.createDataFrame([(1, None, 2.0), (2, 5.0, None), (3, 1.0, 1.0), (4, None, None)], "k int, a double, b double")
    new = spark.createDataFrame([(1, 9.0, 9.0), (2, 9.0, None), (3, 9.0, 9.0)], "k int, a double, b double")
    got = {r["k"]: tuple(r)[1:] for r in merge.backfill(stored, new, "k", ["a", "b"]).collect()}
    assert got == {1: (9.0, 2.0, "a", "filled"), 2: (5.0, None, "", "incomplete"), 3: (1.0, 1.0, "", "complete"), 4: (None, None, "", "incomplete")}


def test_later_sources_are_asked_for_gaps_only(spark, tmp_path):
    for k, keys in enumerate(("ab", "bcd", "abcdef")):
        spark.createDataFrame([(c, f"{c}{k}{i}") for c in keys for i in range(3)], "key string, v string").write.parquet(str(tmp_path / str(k)))
    sources = [(str(k), spark.read.parquet(str(tmp_path / str(k)))) for k in range(3)]
    wanted = spark.createDataFrame([("a",), ("c",), ("e",), ("z",), (None,)], "key string")
    got = filters.first_that_covers(sources, wanted, "key")
    assert sorted({(r["key"], r["source"]) for r in got.collect()}) == [("a", "0"), ("c", "1"), ("e", "2")] and got.count() == 9
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "In(key, [c,e,z])" in plan.replace(" [", " [") or "In(key, [e,z,c])" in plan or "PushedFilters: [In(key" in plan
    assert filters.first_that_covers(sources, wanted.where("false"), "key").count() == 0


def test_csv_types_equal_a_loop(spark, tmp_path):
    deep = tmp_path / "deep"
    deep.mkdir()
    (tmp_path / "a.csv").write_text('﻿Date,"Home Team",Goals,Odds,Mixed,Empty,2024\n2024-01-05,"A, ""b""",1,1.5,1,,7\n\n2024-02-30x,c,-2,3,2024-01-01,NA,8\n' + "".join(f"2024-01-{k:02d},d,{k},{k}.25e1,x,null,{k}\n" for k in range(1, 29)))
    (deep / "b.csv").write_text("day,n,short\n2024-01-01,1.\n2024-12-31,.5,\n")
    (deep / "only_head.csv").write_text("x,1\n")
    got = {(r["path"].rsplit("/", 1)[1], r["column"]): (r["place"], r["kind"], r["n"], r["n_unknown"]) for r in csv_files.types(spark, str(tmp_path)).collect()}
    assert got == {
        ("a.csv", "Date"): (1, "text", 30, 0), ("a.csv", "Home Team"): (2, "text", 30, 0), ("a.csv", "Goals"): (3, "whole", 30, 0), ("a.csv", "Odds"): (4, "number", 30, 0),
        ("a.csv", "Mixed"): (5, "text", 30, 0), ("a.csv", "Empty"): (6, "unknown", 30, 30), ("a.csv", "2024"): (7, "whole", 30, 0),
        ("b.csv", "day"): (1, "day", 2, 0), ("b.csv", "n"): (2, "number", 2, 0), ("b.csv", "short"): (3, "unknown", 2, 2), ("only_head.csv", "x"): (1, "unknown", 0, 0), ("only_head.csv", "1"): (2, "unknown", 0, 0),
    }
