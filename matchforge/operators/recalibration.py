"""Weights of a league that follow the errors of its predictions, match by match."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workers import ship

# Starting weights with their bounds in a league and globally (none: the weight has no global twin).
WEIGHTS = {
    "form": (0.6, (0.1, 0.9), (0.1, 0.9)),
    "base": (0.4, (0.1, 0.9), (0.1, 0.9)),
    "goals": (0.45, (0.1, 0.8), (0.1, 0.8)),
    "shots": (0.3, (0.05, 0.6), (0.05, 0.6)),
    "possession": (0.25, (0.05, 0.5), (0.05, 0.5)),
    "home": (1.07, (1.0, 1.2), None),
}
# How far each weight goes, in steps, when an error is large, or goals were expected too few or too many.
LARGE, TOO_FEW, TOO_MANY = {"form": -0.6, "base": 0.6}, {"goals": 0.5, "shots": 0.3}, {"goals": -0.4, "possession": 0.3}
HOME_TOO_FEW, HOME_TOO_MANY = 0.2, -0.15
# Errors that leave the weights alone and that count as large, the farthest move, the global pull, matches for full trust.
STABLE, BIG, FARTHEST, PULL, TRUSTED = 0.3, 0.5, 0.15, 0.25, 5
SUMS = (("form", "base"), ("goals", "shots", "possession"))


def _moves(home: float, away: float) -> dict[str, float]:
    """The weights that these errors (goals less expected goals) move, and by how many steps."""
    moves = dict(LARGE) if (abs(home) + abs(away)) / 2 >= BIG else {}
    mean = (home + away) / 2
    if mean > BIG:
        moves |= TOO_FEW | ({"home": HOME_TOO_FEW} if home > BIG else {})
    elif mean < -BIG:
        moves |= TOO_MANY | ({"home": HOME_TOO_MANY} if home < -BIG else {})
    return moves


def _step(own: dict[str, float], shared: dict[str, float], seen: int, home: float, away: float, rate: float) -> bool:
    """Moves a league's weights and the global ones in place; False if the errors are small."""
    error = (abs(home) + abs(away)) / 2
    if error < STABLE:
        return False
    step = min(error / 3, 1.0) * rate * max(1.0, 3 / (seen + 1))
    for name, by in _moves(home, away).items():
        low, high = WEIGHTS[name][1]
        own[name] = min(max(own[name] + min(max(step * by, -FARTHEST), FARTHEST), low), high)
    for names in SUMS:
        total = sum(own[n] for n in names)
        own.update({n: round(own[n] / total, 4) for n in names})
    for name, (_, _, bounds) in WEIGHTS.items():
        if bounds:
            shared[name] = round(min(max(shared[name] + (own[name] - shared[name]) * PULL, bounds[0]), bounds[1]), 4)
    return True


def recalibrate(rows: DataFrame, learning_rate: float = 0.05) -> DataFrame:
    """match_id, league, status (stable or recalibrated), seen, each weight after the match, and its global twin as global_*.

    ``rows``: match_id, day, league, home_xg, away_xg, home_goals, away_goals, recency (how much the match counts;
    below 0 counts as 0). Rows with a null among the expected or real goals are left out; a null league is '' and a null recency 1. Leagues are replayed apart, in
    order of day and match_id: Spark sorts them and they stream through, so a task holds one batch and one league's weights,
    but a league's time grows with its matches, as each step needs the one before.
    """
    ship(rows.sparkSession)
    twins = [n for n, w in WEIGHTS.items() if w[2]]

    def replay(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        league, own, shared, seen = object(), {}, {}, 0
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                if r.league != league:
                    league, seen = r.league, 0
                    own = {n: w[0] for n, w in WEIGHTS.items()}
                    shared = {n: own[n] for n in twins}
                moved = _step(own, shared, seen, r.home_goals - r.home_xg, r.away_goals - r.away_xg, learning_rate * max(r.recency, 0.0))
                seen += 1
                out.append((r.match_id, r.league, "recalibrated" if moved else "stable", seen, *own.values(), *(shared[n] for n in twins)))
            yield pd.DataFrame(out, columns=names)

    names = ["match_id", "league", "status", "seen", *WEIGHTS, *(f"global_{n}" for n in twins)]
    x = rows.where("home_xg is not null and away_xg is not null and home_goals is not null and away_goals is not null")
    x = x.select("match_id", "day", F.coalesce("league", F.lit("")).alias("league"), *(F.col(c).cast("double").alias(c) for c in ("home_xg", "away_xg", "home_goals", "away_goals")), F.coalesce("recency", F.lit(1.0)).alias("recency"))
    return x.repartition("league").sortWithinPartitions("league", "day", "match_id").mapInPandas(replay, "match_id long, league string, status string, seen long, " + ", ".join(f"{n} double" for n in names[4:]))


def latest_weights(steps: DataFrame) -> DataFrame:
    """league, seen, and its weights as they are used: the league's own count the more, the more matches it has, up to TRUSTED."""
    last = steps.groupBy("league").agg(F.max_by(F.struct("seen", *WEIGHTS, *(f"global_{n}" for n, w in WEIGHTS.items() if w[2])), "seen").alias("x")).select("league", "x.*")
    share = F.least(F.col("seen") / TRUSTED, F.lit(1.0))
    shared = lambda n: F.col(f"global_{n}") if WEIGHTS[n][2] else F.lit(WEIGHTS[n][0])
    return last.select("league", "seen", *(_blend(share, F.col(n), shared(n)).alias(n) for n in WEIGHTS))


def learning_stats(steps: DataFrame) -> DataFrame:
    """league, samples, confidence (per cent of full trust), the league's own weights to 4 places and, as d_*, how far they are from the start."""
    last = steps.groupBy("league").agg(F.max_by(F.struct("seen", *WEIGHTS), "seen").alias("x")).select("league", "x.*").where("league <> 'default'")
    trust = F.round(F.least(F.col("seen") / TRUSTED, F.lit(1.0)) * 100)
    return last.select("league", F.col("seen").alias("samples"), trust.alias("confidence"), *(F.round(n, 4).alias(n) for n in WEIGHTS), *(F.round(F.round(n, 4) - w[0], 4).alias(f"d_{n}") for n, w in WEIGHTS.items()))


def _blend(share: Column, own: Column, shared: Column) -> Column:
    return share * own + (1 - share) * shared
