"""The package in workers that start elsewhere, and ratings where results are missing in part."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from matchforge.operators import features

REPO = str(Path(__file__).resolve().parents[1])
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from matchforge.plans import lookup_queries, model_queries, queries
s = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://" + sys.argv[1]).config("spark.ui.enabled", "false").getOrCreate()
sf = "/root/testdata/sf0.001"
for f in (queries.elo_replay, lookup_queries.recalibration, model_queries.html_blocks, model_queries.challenger_states):
    assert f(s, sf).count() > 0
print("done")
"""


def test_workers_that_start_elsewhere(tmp_path):
    """Only the driver's path has the repository, as on a cluster."""
    got = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO), str(tmp_path)], cwd=tmp_path, capture_output=True, text=True, timeout=300, check=False, env={k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")})
    assert "done" in got.stdout, got.stderr[-2000:]


def test_unknown_goals_poison_no_rating(spark):
    rows = [(1, 1, "a", "b", 2, None, "H"), (2, 2, "a", "c", None, None, None), (3, 3, "b", "c", 1, 1, "D"), (4, 4, "c", "a", None, None, "D")]
    df = spark.createDataFrame(rows, "match_id long, day int, home string, away string, home_goals long, away_goals long, result string").selectExpr("*", "'x' as league")
    got = {r["match_id"]: r for r in features.elo(df).collect()}
    assert sorted(got) == [1, 3, 4]  # nothing is known of the second
    assert all(r[c] is not None for r in got.values() for c in features.ELO_COLUMNS)
    full = features.elo(spark.createDataFrame([(1, 1, "a", "b", 2, 0, "H"), (3, 3, "b", "c", 1, 1, "D"), (4, 4, "c", "a", 0, 0, "D")], "match_id long, day int, home string, away string, home_goals long, away_goals long, result string").selectExpr("*", "'x' as league"))
    assert {r["match_id"]: tuple(r) for r in full.collect()} == {k: tuple(r) for k, r in got.items()}
    assert got[3]["home_elo"] == pytest.approx(got[1]["away_elo_after"])
