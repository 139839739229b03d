"""CSV folders, rank tests against plain loops, and the odd rows of cascades and kept tables."""

import math

from pyspark.sql import functions as F

from matchforge.operators import lookups
from matchforge.sources import csv_files


def test_inspect_reads_a_folder_of_files(spark, tmp_path):
    deep = tmp_path / "a b" / "c"
    deep.mkdir(parents=True)
    (tmp_path / "m.csv").write_text('\ufeffDate,"HomeTeam",AwayTeam,FTHome,OddHome\n1,a,b,2,1.5\n\n2,c,d,1,1.6\n')
    (deep / "elo.csv").write_text("date,club,Elo\n2020-01-01,x,1500\n")
    (deep / "none.csv").write_text("")
    (deep / "other.txt").write_text("date,home,away\n")
    got = {r["path"].rsplit("/", 1)[1]: r for r in csv_files.inspect(spark, str(tmp_path)).collect()}
    assert set(got) == {"m.csv", "elo.csv"}  # a file without text is not listed
    m = got["m.csv"]
    assert (m["n_rows"], m["kind"], m["missing"], m["known"]) == (2, "matches", [], {"home_goals": "fthome", "odds_home": "oddhome"})
    assert m["columns"] == ["Date", "HomeTeam", "AwayTeam", "FTHome", "OddHome"] and m["bytes"] == (tmp_path / "m.csv").stat().st_size
    assert (got["elo.csv"]["n_rows"], got["elo.csv"]["kind"], got["elo.csv"]["missing"]) == (1, "elo_snapshot", ["home_team", "away_team"])


def test_csv_lines_keep_their_reasons(spark):
    lines = ["01/02/2020, a ,b,2,1", "01/02/2020,A,B,3,1", "31/02/2020,a,b,1,1", "01/02/2020,,b,1,1", "01/02/2020,a,c,x,1", "01/02/2019,a,b,0,0", None, ""]
    rows = spark.createDataFrame(list(enumerate(lines)), "k int, line string")
    got = csv_files.matches(rows, "line", ["date", "home", "away", "hg", "ag"], "dd/MM/yyyy", F.to_date(F.lit("2020-01-01")), "k")
    by = {r["k"]: (r["reason"], r["home"], r["result"]) for r in got.collect()}
    assert by[0] == ("valid", "A", "H") and by[1][0] == "duplicate" and by[3][0] == "missing_team_name" and by[5] == ("before_cutoff", "A", "D")
    assert [by[k][0] for k in (2, 6, 7)] == ["invalid_date"] * 3 and by[4][0] == "missing_score"


def test_signed_ranks_equal_a_plain_loop(spark):
    d = [0.5, -0.5, 1.0, 2.0, -0.25, 0.0, 3.0, 0.5, -4.0, 0.75, 0.005, None]
    rows = spark.createDataFrame([("g", x) for x in d] + [("zero", 0.0)], "g string, d double")
    got = {r["g"]: r for r in lookups.signed_ranks(rows, "g", "d", 0.3, 1).collect()}
    known = [x for x in d if x]
    size = sorted(map(abs, known))
    rank = {s: sum(i + 1 for i, x in enumerate(size) if x == s) / size.count(s) for s in size}
    w = min(sum(rank[abs(x)] for x in known if x > 0), sum(rank[abs(x)] for x in known if x < 0))
    n = len(known)
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - sum(size.count(s) ** 3 - size.count(s) for s in set(size)) / 48)
    z = (w - n * (n + 1) / 4) / spread
    r = got["g"]
    assert (r["n"], r["w"]) == (n, w) and abs(r["z"] - z) < 1e-12 and abs(r["p_value"] - math.erfc(abs(z) / math.sqrt(2))) < 2e-7
    assert abs(r["delta"] - sum(x for x in d if x is not None) / 11) < 1e-12 and not r["better"]
    assert (got["zero"]["n"], got["zero"]["p_value"], got["zero"]["better"]) == (0, 1.0, False)


def test_median_is_the_upper_one_and_few_rows_decide_nothing(spark):
    rows = spark.createDataFrame([("a", k, float(k), float(k % 2)) for k in range(10)] + [("b", 100, 1.0, 0.0), ("b", 101, None, 1.0)] + [("c", 200 + k, 1.0, 0.5) for k in range(40)], "g string, id int, v double, s double")
    got = {r["g"]: (r["n"], r["median"], r["verdict"]) for r in lookups.median_split(rows, "g", "id", "v", "s", 5).collect()}
    assert got["a"][:2] == (10, 5.0) and got["b"] == (1, 1.0, "insufficient_data") and got["c"] == (40, 1.0, "insufficient_data")
    clear = spark.createDataFrame([("a", k, float(k), 1.0 if k < 50 else 0.0) for k in range(100)], "g string, id int, v double, s double")
    r = lookups.median_split(clear, "g", "id", "v", "s", 5).first()
    assert (r["verdict"], r["delta"], r["low"], r["high"]) == ("surface_worthy", 1.0, 1.0, 1.0)


def test_order_state_sees_breaks_inside_and_between_chunks(spark):
    files = {"down": [5, 4, 4, 3, 2, 1], "up": [1, 2, 2, 3, 4, 9], "border": [1, 2, 1, 2, 3, 4], "inside": [2, 1, 3, 4, 5, 6], "flat": [1, 1], "none": [None], "gap": [1, None, None, None, 0, None]}
    rows = spark.createDataFrame([(f, k, v) for f, vs in files.items() for k, v in enumerate(vs)], "f string, k int, v int")
    for chunk in (1, 2, 3, 100):
        got = dict(map(tuple, lookups.order_state(rows, "f", "k", "v", chunk).collect()))
        assert got == {"down": "descending", "up": "ascending", "border": "unsorted", "inside": "unsorted", "flat": "descending", "none": "unknown", "gap": "descending"}


def test_cascade_takes_a_level_whole(spark):
    base = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    one = spark.createDataFrame([(1, None, 5)], "k int, a int, b int")
    two = spark.createDataFrame([(1, 7, 7), (2, 8, None)], "k int, a int, b int")
    got = sorted(map(tuple, lookups.cascade(base, [("one", one, ["k"]), ("two", two, ["k"])], ["a", "b"]).collect()))
    assert got == [(1, "one", None, 5), (2, "two", 8, None), (3, None, None, None)]


def test_snapshot_and_certainty(spark):
    stored = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, at int, v string")
    batch = spark.createDataFrame([(2, 0, "c"), (3, 5, "x"), (3, 6, None)], "k int, at int, v string")
    assert sorted(map(tuple, lookups.snapshot(stored, batch, ["k"], ["at"]).collect())) == [(1, 1, "a", "kept"), (2, 0, "c", "replaced"), (3, 6, None, "inserted")]
    says = spark.createDataFrame([("Doubtful for a month", "injured"), ("", "injured"), (None, None), ("BANNED", "x"), ("a week", "Suspended")], "t string, k string")
    assert [r[0] for r in says.select(lookups.certainty(F.col("t"), F.col("k"))).collect()] == [0.5, 0.8, 0.8, 1.0, 1.0]


def test_failure_class(spark):
    rows = spark.createDataFrame([(500, None), (599, None), (600, None), (429, None), (403, None), (None, None), (429, "timeout"), (None, "reset")], "s int, e string")
    assert [r[0] for r in rows.select(lookups.failure_class(F.col("s"), F.col("e"))).collect()] == ["upstream_5xx", "upstream_5xx", "other_error", "quota", "forbidden", None, "timeout", "network"]
