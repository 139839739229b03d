"""Why a prediction is what it is: the probability of a home win, factor by factor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring

#: Factors in the order in which they are added.
FACTORS = ("statistics", "elo", "form", "venue", "meetings", "absences")


def waterfall(rows: DataFrame, home_factor: float = 1.12, away_factor: float = 0.92, baseline: float = 1.35, form_weight: float = 0.6, base_weight: float = 0.4, cap: float = 2.5) -> DataFrame:
    """match_id, step, factor, p_home after it (4 places) and what it added, in points (2 places).

    ``rows``: match_id; att and def of both sides from statistics alone and, as elo_att and
    elo_def, with their ELO (null: unknown, as without); form; modifier and meetings; and the
    final home_xg and away_xg (null: no absences, as before them). Neutral form counts 0.5. The chain of expected goals carries
    each product on, and only the probabilities are worked out anew. What is added up over
    the steps is the last probability.
    """
    def att(side: str, elo: bool) -> Column:
        own = F.coalesce(f"{side}_elo_att", f"{side}_att") if elo else F.col(f"{side}_att")
        other = "away" if side == "home" else "home"
        against = F.coalesce(f"{other}_elo_def", f"{other}_def") if elo else F.col(f"{other}_def")
        return own * (0.60 + against / cap * 0.80) * baseline

    form = {s: form_weight * (0.80 + F.col(f"{s}_form") * 0.40) + base_weight for s in ("home", "away")}
    neutral = form_weight * (0.80 + 0.5 * 0.40) + base_weight
    met = {"home": F.when(F.col("meetings") >= 2, 1 + F.col("modifier")).otherwise(1.0), "away": F.when(F.col("meetings") >= 2, 1 - F.col("modifier")).otherwise(1.0)}
    x = rows
    for s, venue in (("home", home_factor), ("away", away_factor)):
        x = x.withColumns({f"{s}_a": att(s, False), f"{s}_b": att(s, True)})
        x = x.withColumn(f"{s}_c", F.col(f"{s}_b") * form[s])
        x = x.withColumn(f"{s}_d", F.col(f"{s}_c") * venue)
        x = x.withColumn(f"{s}_e", F.col(f"{s}_d") * met[s])
    # Products of short decimals end in a 5 often: ten places first, so that noise below does not decide.
    floor = lambda c: F.round(F.round(F.greatest(c, F.lit(0.20)), 10), 4)
    at = lambda s: [*(floor(c) for c in (F.col(f"{s}_a") * neutral, F.col(f"{s}_b") * neutral, *(F.col(f"{s}_{k}") for k in "cde"))), F.coalesce(F.col(f"{s}_xg"), floor(F.col(f"{s}_e")))]
    n = len(FACTORS)
    x = x.select("match_id", *(c.alias(f"{s}_{k}") for s in ("home", "away") for k, c in enumerate(at(s))))
    # A row a step with its own goals and those of the step before, so that grids are plain columns.
    rows = F.array(*(F.struct(F.lit(k).alias("step"), F.lit(FACTORS[k]).alias("factor"), F.col(f"home_{k}").alias("h"), F.col(f"away_{k}").alias("a"), F.col(f"home_{max(k - 1, 0)}").alias("h0"), F.col(f"away_{max(k - 1, 0)}").alias("a0")) for k in range(n)))
    x = x.select("match_id", F.inline(rows))
    p = lambda h, a: scoring.poisson_grid(F.col(h), F.col(a))["home"]
    x = x.select("match_id", "step", "factor", p("h", "a").alias("p"), F.when(F.col("step") > 0, p("h0", "a0")).otherwise(0.0).alias("before"))
    return x.select("match_id", "step", "factor", F.round("p", 4).alias("p_home"), F.round((F.col("p") - F.col("before")) * 100, 2).alias("points"))
