"""Results that come late, matched to their fixtures by a join of two streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("home", "away", "kickoff")


def _wait(days: int) -> Column:
    return F.expr(f"interval {days} days")


def is_late(days: int) -> Column:
    """Whether a result came after the days in which it counts."""
    return F.col("reported_at") > F.col("kickoff") + _wait(days)


def late_counts(results: DataFrame, days: int = 7) -> DataFrame:
    """day of kickoff, results that came too late. A table, or a stream in complete or update mode."""
    return results.where(is_late(days)).groupBy(F.to_date("kickoff").alias("day")).agg(F.count("*").alias("late"))


def matched(fixtures: DataFrame, results: DataFrame, days: int = 7) -> DataFrame:
    """fixture_id, home, away, kickoff, home_goals, away_goals, reported_at of each fixture's first result in time.

    ``fixtures``: fixture_id, home, away, kickoff; ``results``: home, away, kickoff, home_goals, away_goals,
    reported_at. As streams, both have watermarks: a result waits for nothing longer than
    ``days``, a fixture no longer than that after its kickoff, and a repeated result is dropped
    while the first is remembered; so state is bounded by what happens in so many days. As
    tables, watermarks have no effect and the earliest result counts. A result from before the
    kickoff, without goals, or with a null in its key matches nothing.
    """
    known = F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull() & F.col("reported_at").between(F.col("kickoff"), F.col("kickoff") + _wait(days))
    in_time = results.where(known).select(*KEY, "home_goals", "away_goals", "reported_at")
    if results.isStreaming:
        # A repeated result comes within the days of its fixture.
        first = in_time.withWatermark("reported_at", f"{days} days").dropDuplicatesWithinWatermark(list(KEY))
        waiting = fixtures.withWatermark("kickoff", f"{days} days")
    else:
        best = F.min(F.struct("reported_at", "home_goals", "away_goals"))
        first = in_time.groupBy(*KEY).agg(best.alias("x")).select(*KEY, "x.home_goals", "x.away_goals", "x.reported_at")
        waiting = fixtures
    r = first.select(F.col("home").alias("r_home"), F.col("away").alias("r_away"), F.col("kickoff").alias("r_kickoff"), "home_goals", "away_goals", "reported_at")
    same = (F.col("home") == F.col("r_home")) & (F.col("away") == F.col("r_away")) & (F.col("kickoff") == F.col("r_kickoff"))
    window = (F.col("reported_at") >= F.col("kickoff")) & (F.col("reported_at") <= F.col("kickoff") + _wait(days))
    return waiting.join(r, same & window).select("fixture_id", "home", "away", "kickoff", "home_goals", "away_goals", "reported_at")
