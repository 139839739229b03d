"""Team profiles, comparison of engines, and the small rules around a match."""

from __future__ import annotations

import math
from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring

# Bounds of the reliability bins, of a full history, of seasons kept, of unstable confidence and of a worse Brier score.
BINS, LIVE_MATCHES, SEASONS_KEPT, UNSTABLE, WORSE = (0.0, 0.4, 0.5, 0.6, 0.7, 1.01), 3, 6, 0.2, 0.1
# Impact of a position, the dearest player expected, the most one absence counts.
POSITIONS, DEAREST, MOST_IMPACT = {"G": 1.5, "GK": 1.5, "D": 1.0, "DEF": 1.0, "M": 0.8, "MID": 0.8, "F": 1.2, "FWD": 1.2, "A": 1.2}, 150_000_000, 0.18


def ratio(part: Column, whole: Column) -> Column:
    """Sum over sum of the rows that have both; null without such rows or with a sum of 0."""
    both = part.isNotNull() & whole.isNotNull()
    total = F.sum(F.when(both, whole))
    return F.when(total > 0, F.sum(F.when(both, part)) / total)


def finishing() -> list[Column]:
    """Goals by expected goals and by shots on target as pooled ratios, corners, and how many rows carry them."""
    goals = F.col("gf")
    return [ratio(goals, F.col("xg_actual")).alias("goals_per_xg"), F.count(F.when(goals.isNotNull(), F.col("xg_actual"))).alias("goals_per_xg_n"), ratio(goals, F.col("on_target")).alias("goals_per_shot"), F.avg("corners").alias("avg_corners")]


def team_dna(recent_rows: DataFrame) -> DataFrame:
    """team, sampled, averages of what is known, and the finishing ratios, over rows such as ``recent`` gives."""
    return recent_rows.groupBy("team").agg(F.count("*").alias("sampled"), F.avg("xg_actual").alias("avg_xg"), F.avg("possession").alias("avg_possession"), F.avg("cards").alias("avg_cards"), F.avg("gf").alias("avg_goals_for"), F.avg("ga").alias("avg_goals_against"), *finishing())


def stat_means(rows: DataFrame, keys: list[str], stats: list[str]) -> DataFrame:
    """keys, stat_key, mean, n: statistics as rows, averaged by their key; unknown values and keys without any are left out."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("stat_key"), F.col(c).cast("double").alias("value")) for c in stats))).alias("s")
    return rows.select(*keys, each).select(*keys, "s.*").where("value is not null").groupBy(*keys, "stat_key").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def form_record(outcomes: Column) -> Column:
    """Wins, draws and losses as 4W-1D; parts of none are left out, and nothing at all is null."""
    count = lambda k: F.size(F.filter(outcomes, lambda x: x == k))
    return F.nullif(F.concat_ws("-", *(F.when(count(k) > 0, F.concat(count(k).cast("string"), F.lit(k))) for k in "WDL")), F.lit(""))


def recency_weight(day: Column, today: Column, half_life: float = 365.0) -> Column:
    """0.5 ** (age / half-life); a missing day or one to come counts 1."""
    age = F.date_diff(today, day)
    return F.when(age > 0, F.pow(F.lit(0.5), age / half_life)).otherwise(F.lit(1.0))


def data_quality(source: Column, matches: Column) -> Column:
    return F.when((source == "history") & (matches >= LIVE_MATCHES), "live").when(source == "elo-only", "elo").when(source.isin("", "neutral-defaults"), "neutral").otherwise("partial")


def missing_columns(columns: list[str]) -> Column:
    """Names of the row's null columns, in this order."""
    return F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in columns)), lambda c: c.isNotNull())


def absence_impact(value: Column, position: Column, certainty: Column) -> Column:
    """What an absent player takes from the expected goals, by market value and position; 4 places, never above 0."""
    held = F.create_map(*[F.lit(x) for kv in POSITIONS.items() for x in kv])
    weight = F.coalesce(F.try_element_at(held, F.substring(F.upper(position), 1, 3)), F.lit(0.8))
    share = F.log10(F.greatest(value, F.lit(100_000)) + 1) / math.log10(DEAREST + 1)
    return -F.round(F.least(share * weight * certainty * 0.25, F.lit(MOST_IMPACT)), 4)


def engine_rows(predicted: DataFrame, engines: dict[str, tuple[Column, Column, Column, Column]], keys: list[str]) -> DataFrame:
    """One row for each engine of each prediction that it takes part in: keys, engine, p_home, p_draw, p_away. engines: (takes part, three probabilities)."""
    each = F.array(*(F.struct(F.lit(name).alias("engine"), on.alias("on"), h.cast("double").alias("p_home"), d.cast("double").alias("p_draw"), a.cast("double").alias("p_away")) for name, (on, h, d, a) in engines.items()))
    x = predicted.select(*keys, F.explode(each).alias("e")).select(*keys, "e.*")
    return x.where("on and p_home is not null and p_draw is not null and p_away is not null").drop("on")


def combined(engines: DataFrame, key: str, weight: Column) -> DataFrame:
    """key and the engines' weighted mean, scaled to 1."""
    total = F.sum(weight)
    x = engines.groupBy(key).agg(*((F.sum(F.col(p) * weight) / F.when(total > 0, total).otherwise(F.lit(1.0))).alias(p) for p in ("p_home", "p_draw", "p_away")))
    scale = F.col("p_home") + F.col("p_draw") + F.col("p_away")
    return x.select(key, *(F.when(scale > 0, F.col(p) / scale).otherwise(F.col(p)).alias(p) for p in ("p_home", "p_draw", "p_away")))


def consensus(engines: DataFrame, key: str) -> DataFrame:
    """key, agreement, divergence, distance of the keys with exactly two engines: L1 distance of their probabilities, and whether their favourites differ."""
    p = ("p_home", "p_draw", "p_away")
    pair = engines.groupBy(key).agg(F.count("*").alias("n"), F.min_by(F.struct(*p), "engine").alias("a"), F.max_by(F.struct(*p), "engine").alias("b")).where("n = 2")
    l1 = F.abs(F.col(f"a.{p[0]}") - F.col(f"b.{p[0]}")) + F.abs(F.col(f"a.{p[1]}") - F.col(f"b.{p[1]}")) + F.abs(F.col(f"a.{p[2]}") - F.col(f"b.{p[2]}"))
    top = lambda s: scoring.likeliest(*(F.col(f"{s}.{c}") for c in p))
    return pair.select(key, F.greatest(F.lit(0.0), 1 - l1 / 2).alias("agreement"), l1.alias("divergence"), (top("a") != top("b")).cast("double").alias("distance"))


def reliability(predicted: DataFrame) -> DataFrame:
    """bin, n, confidence, accuracy (3 places) by the likeliest outcome's probability, for every bin; closed below and open above."""
    p = [F.col(c) for c in ("p_home", "p_draw", "p_away")]
    top = F.greatest(*p)
    which = F.coalesce(*(F.when((top >= lo) & (top < hi), F.lit(k)) for k, (lo, hi) in enumerate(pairwise(BINS))))
    found = predicted.where("result is not null").groupBy(which.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(top), 3).alias("confidence"), F.round(F.avg((scoring.likeliest(*p) == F.col("result")).cast("double")), 3).alias("accuracy"))
    grid = predicted.sparkSession.range(len(BINS) - 1).select(F.col("id").cast("int").alias("bin"))
    return grid.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "confidence", "accuracy")


def calibration_error(bins: DataFrame) -> DataFrame:
    """ece: the gap between confidence and accuracy, weighed by the bins' rows, 4 places; 0 without rows."""
    return bins.agg(F.coalesce(F.round(F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.nullif(F.sum("n"), F.lit(0)), 4), F.lit(0.0)).alias("ece"))


def side_errors(rows: DataFrame, least: int = 3) -> DataFrame:
    """side, league (null: all), n, mae, bias, rmse, corr of predicted against actual, for both sides, each side, and leagues of at least ``least`` rows."""
    e = F.col("predicted") - F.col("actual")
    out = rows.where("predicted is not null and actual is not null").groupingSets([[], [F.col("side")], [F.col("league")]], F.col("side"), F.col("league")).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse"), F.corr("predicted", "actual").alias("corr"))
    return out.where((F.col("n") >= least) | F.col("league").isNull()).withColumn("corr", F.when(F.col("n") >= 3, F.col("corr")))


def live_health(predicted: DataFrame, keys: list[str], baseline: float) -> DataFrame:
    """keys, n, brier, log_loss, accuracy, spread of confidence, unstable, worse than a baseline Brier score by more than a tenth."""
    p = [F.col(c) for c in ("p_home", "p_draw", "p_away")]
    x = predicted.where("result is not null and p_home is not null and p_draw is not null and p_away is not null")
    own = scoring.of_result(F.col("result"), *p)
    x = x.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(scoring.brier(F.col("result"), *p)).alias("brier"), F.avg(-F.ln(F.greatest(own, F.lit(1e-12)))).alias("log_loss"), F.avg((scoring.likeliest(*p) == F.col("result")).cast("double")).alias("accuracy"), F.stddev_pop(F.greatest(*p)).alias("spread"))
    x = x.withColumn("spread", F.when(F.col("n") >= 2, F.col("spread")))
    return x.withColumns({"unstable": F.col("spread") > UNSTABLE, "worse": F.when(F.lit(baseline) > 0, F.col("brier") > baseline * (1 + WORSE))})


def kept_seasons(rows: DataFrame, kept: int = SEASONS_KEPT) -> DataFrame:
    """season, n, status: the newest seasons are kept, older ones are candidates to go, rows without one are unknown."""
    x = rows.groupBy("season").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("season")))  # a row for each season
    return x.withColumn("place", place).select("season", "n", F.when(F.col("season").isNull(), "unknown").when(F.col("place") <= kept, "keep").otherwise("candidate").alias("status"))


def dominant_cause(rows: DataFrame, key: str, causes: str) -> DataFrame:
    """key, cause, total: of a map column's sums by cause the largest, the first by name of equal ones."""
    x = rows.select(key, F.explode(causes).alias("cause", "n")).groupBy(key, "cause").agg(F.sum("n").alias("total"))
    return x.groupBy(key).agg(F.min_by(F.struct("cause", "total"), F.struct((-F.col("total")).alias("t"), "cause")).alias("x")).select(key, "x.*")


def cumulative_profit(bets: DataFrame, group: str, day: str) -> DataFrame:
    """group, day, bets, pending, profit, running: settled profit by day and summed so far. Days are added up first, so a day's bets never meet in one sort."""
    won = F.col("selection") == F.col("result")
    profit = F.when(won, F.col("stake") * (F.col("price") - 1)).when(~won, -F.col("stake"))
    x = bets.groupBy(group, day).agg(F.count("*").alias("bets"), F.count_if(F.col("result").isNull()).alias("pending"), F.coalesce(F.sum(profit), F.lit(0.0)).alias("profit"))
    return x.withColumn("running", F.sum("profit").over(Window.partitionBy(group).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)))


def coverage(flags: dict[str, Column]) -> list[Column]:
    """Each flag, and the share of them that holds in per cent, 2 places."""
    held = sum((F.coalesce(f, F.lit(False)).cast("int") for f in flags.values()), F.lit(0))
    return [*(F.coalesce(f, F.lit(False)).alias(k) for k, f in flags.items()), F.round(100.0 * held / len(flags), 2).alias("coverage")]
