"""Payload maps, upserts of contradicting rows and club names by hand."""

import json

from pyspark.sql import functions as F

from matchforge.functions import text
from matchforge.operators import payloads, records


def test_fixtures_of_odd_payloads(spark):
    fd = {"matches": [{"id": 1, "homeTeam": {"name": " A "}, "awayTeam": {"name": "B"}, "utcDate": "2024-03-01T20:00:00Z", "status": "FINISHED", "score": {"fullTime": {"home": 2, "away": 2}}}, {"id": 2, "homeTeam": None, "awayTeam": {"name": "B"}, "utcDate": "2024-03-01T20:00:00Z"}, {"homeTeam": {"name": "A"}, "awayTeam": {"name": "B"}, "utcDate": "2024-03-02", "status": "IN_PLAY", "score": {"fullTime": {"home": 1, "away": 0}}}, {"id": 4, "homeTeam": {"name": "A"}, "awayTeam": {"name": "B"}, "utcDate": "soon"}]}
    freelf = [{"response": [{"id": 7, "homeTeam": {"name": "C"}, "awayTeam": {"name": "D"}, "startTimestamp": 86400, "status": {"type": "finished"}, "homeScore": {"current": 0}, "awayScore": {"current": 3}}]}, {"events": [{"eventId": 8, "homeTeam": {"name": "C"}, "awayTeam": {"name": "D"}, "startTimestamp": "172800"}]}]
    odds = {"events": [{"id": "x", "home_team": "E", "away_team": "F", "commence_time": "2024-01-01T00:00:00Z", "completed": True, "scores": [{"name": "F", "score": "1"}, {"name": "E", "score": "0"}, {"name": "?", "score": "9"}]}, {"id": "y", "home_team": "E", "away_team": "F", "commence_time": "2024-01-01T00:00:00Z", "completed": False, "scores": None}]}
    rows = [("fd", json.dumps(fd)), *(("freelf", json.dumps(d)) for d in freelf), ("oddsapi", json.dumps(odds)), ("fd", "not json"), ("fd", None), ("other", json.dumps(fd)), ("espn", "{}")]
    got = {(r["provider"], r["external_id"]): r for r in payloads.fixtures(spark.createDataFrame(rows, "who string, doc string"), "doc", "who").collect()}
    assert set(got) == {("fd", "1"), ("fd", None), ("freelf", "7"), ("freelf", "8"), ("oddsapi", "x"), ("oddsapi", "y")}
    assert (got["fd", "1"]["home"], got["fd", "1"]["result"], got["fd", "1"]["fixture"], str(got["fd", "1"]["kickoff"])) == ("A", "D", "fd_1", "2024-03-01 20:00:00")
    assert got["fd", None]["home_goals"] is None and got["fd", None]["fixture"] is None and got["fd", None]["status"] == "in_play"
    assert (got["freelf", "7"]["result"], str(got["freelf", "7"]["kickoff"]), str(got["freelf", "8"]["kickoff"])) == ("A", "1970-01-02 00:00:00", "1970-01-03 00:00:00")
    assert (got["oddsapi", "x"]["home_goals"], got["oddsapi", "x"]["away_goals"], got["oddsapi", "y"]["result"]) == (0, 1, None)


def test_standings_and_meetings(spark):
    table = {"standings": [{"table": [{"position": 1, "team": {"name": "A"}, "playedGames": 4, "won": 3, "draw": 1, "lost": 0, "points": 10, "goalsFor": 8, "goalsAgainst": 2, "form": "W, D W"}, {"team": {}}, {"team": {"name": "B"}}]}]}
    got = payloads.standings(spark.createDataFrame([(1, json.dumps(table)), (2, None)], "k int, doc string"), "doc", ["k"]).orderBy("team").collect()
    assert [tuple(r)[1:] for r in got] == [(1, "A", 4, 3, 1, 0, 10, 2.0, 0.5, "WDW"), (0, "B", 1, 0, 0, 0, 0, 0.0, 0.0, "")]
    match = lambda h, a, x, y: {"homeTeam": {"name": h}, "awayTeam": {"name": a}, "homeScore": {"current": x}, "awayScore": {"current": y}}
    doc = json.dumps({"matches": [match("A", "B", 2, 1), match("B", "A", 3, 0), match("B", "A", 1, 1), match("A", "C", 5, 0), match("A", "B", None, 1)]})
    rows = payloads.meetings(spark.createDataFrame([(1, "A", "B", doc), (2, "A", "B", "{}")], "k int, h string, a string, doc string"), "doc", ["k"], "h", "a").orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(1, 3, 1, 1, 1), (2, 0, 0, 0, 0)]


def plain_upsert(stored, batch):
    """One row after another."""
    rows = {k: dict(goals=g, cards=c, shots=s) for k, g, c, s in stored}
    known, acts, refused = set(rows), {k: "untouched" for k in rows}, dict.fromkeys(rows, 0)
    for _, k, g, c, s in sorted(batch):
        new = {"goals": g, "cards": c, "shots": s}
        if k not in rows:
            rows[k], acts[k], refused[k] = new, "inserted", 0
            continue
        if any(new[f] is not None and rows[k][f] is not None and new[f] != rows[k][f] for f in ("goals", "cards")):
            refused[k] += 1
            acts[k] = "hard_conflict" if acts[k] == "untouched" else acts[k]
            continue
        fills = any(rows[k][f] is None and new[f] is not None for f in new)
        rows[k] = {f: rows[k][f] if rows[k][f] is not None else new[f] for f in new}
        if k in known:
            acts[k] = "updated" if fills or acts[k] == "updated" else "unchanged"
    return {k: (*r.values(), acts[k], refused[k]) for k, r in rows.items()}


def test_upsert_takes_rows_one_after_another(spark):
    import random

    rng = random.Random(6)
    pick = lambda *xs: rng.choice([None, *xs])
    stored = [(k, pick(1, 2), pick(1), pick(5)) for k in range(40)]
    batch = [(i, rng.randrange(60), pick(1, 2), pick(1, 2), pick(5, 6)) for i in range(400)]
    got = records.canonical_upsert(spark.createDataFrame(stored, "k int, goals int, cards int, shots int"), spark.createDataFrame(batch, "seq int, k int, goals int, cards int, shots int").repartition(3), ["k"], ["seq"], ["goals", "cards"], ["shots"])
    assert {r["k"]: tuple(r)[1:] for r in got.collect()} == plain_upsert(stored, batch)


def test_two_contradicting_rows_of_one_key(spark):
    stored = spark.createDataFrame([("old", None, None)], "k string, goals int, shots int")
    batch = spark.createDataFrame([(1, "old", 2, None), (2, "old", 3, 9), (3, "new", 1, None), (4, "new", 2, 7), (5, "new", 1, 4)], "seq int, k string, goals int, shots int")
    got = {r["k"]: tuple(r)[1:] for r in records.canonical_upsert(stored, batch, ["k"], ["seq"], ["goals"], ["shots"]).collect()}
    assert got == {"old": (2, None, "updated", 1), "new": (1, 4, "inserted", 1)}


def test_team_names_in_five_tries(spark):
    aliases = {"ajax": "Ajax", "atletico": "Atletico Madrid", "bodo/glimt": "Bodo/Glimt", "milan": "Milan", "real": "Real", "xé": "exact"}
    raw = [" AJAX ", "Atlético", "Ajax (NED)", "Ajax (ned)", "Milan Football Club", "FC Milan", "AC Milan AFC", "Paris FC", "", None, "Xé", "real sc ", "(ESP)"]
    got = [r["x"] for r in spark.createDataFrame([(k, v) for k, v in enumerate(raw)], "k int, v string").orderBy("k").select(text.team_name(F.col("v"), aliases).alias("x")).collect()]
    assert got == ["Ajax", "Atletico Madrid", "Ajax", "Ajax (ned)", "Milan", "Milan", "Milan", "Paris FC", "", None, "exact", "Real", "(ESP)"]
