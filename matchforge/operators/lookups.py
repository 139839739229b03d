"""Cascades of sources, recent context, small tables kept up to date, and rank tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import gates

# What a phrase about an absent player's return says of the absence, the first one contained counts; else UNSURE.
CERTAINTY = {"doubtful": 0.5, "doubt": 0.5, "about a week": 0.95, "a week": 0.95, "two weeks": 0.95, "2 weeks": 0.95, "a month": 0.95, "month": 0.95, "out": 0.95, "injured": 0.85, "suspended": 1.0, "ban": 1.0, "questionable": 0.4}
UNSURE, MOST_TEAM_IMPACT, LEAST_XG = 0.8, 0.3, 0.2
# Market value of a key player and of a starter.
KEY_VALUE, STARTER_VALUE = 20_000_000, 5_000_000


def newest_triple(rows: DataFrame, key: str, prices: list[tuple[str, str]], newest: list[Column], keep: list[str]) -> DataFrame:
    """key, home, draw, away and ``keep`` of each key's newest row with a whole triple; a missing or zero first price gives way to the second."""
    triple = [F.coalesce(*(F.when(F.col(c) != 0, F.col(c)) for c in pair)).alias(n) for n, pair in zip(("home", "draw", "away"), prices, strict=True)]
    x = rows.select(key, F.struct(*newest).alias("at"), F.struct(*triple, *keep).alias("x")).where("x.home is not null and x.draw is not null and x.away is not null")
    return x.groupBy(key).agg(F.max_by("x", "at").alias("x")).select(key, "x.*")


def cascade(base: DataFrame, levels: list[tuple[str, DataFrame, list[str]]], columns: list[str]) -> DataFrame:
    """base, source and ``columns`` of the first level that has the row's keys; nulls without one.

    Each level is (name, rows, keys), one row a key; it is taken whole or not at all.
    """
    found = []
    for k, (name, rows, keys) in enumerate(levels):
        base = base.join(rows.select(*keys, F.struct(F.lit(name).alias("source"), *columns).alias(f"level_{k}")), keys, "left")
        found.append(f"level_{k}")
    return base.withColumn("found_", F.coalesce(*found)).drop(*found).select("*", "found_.*").drop("found_")


def latest_context(rows: DataFrame, key: str, context: list[str], order: list[Column], outcome: str, last_n: int) -> DataFrame:
    """key, outcomes, n: the first ``last_n`` outcomes of each key's latest context, oldest first.

    The latest context is found by a grouping that combines before the shuffle; only its rows are sorted.
    """
    latest = rows.groupBy(key).agg(F.max(F.struct(*context)).alias("c_")).select(key, *(F.col(f"c_.{c}").alias(c) for c in context))
    x = rows.join(latest, [key, *context], "left_semi")
    x = x.withColumn("k_", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("k_") <= last_n)
    return x.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("k_", outcome)), asc=False).alias("o"), F.count("*").alias("n")).select(key, F.concat_ws("", f"o.{outcome}").alias("outcomes"), "n")


def snapshot(stored: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the batch's last by ``order`` where it has the key, else the stored row; ``action`` says which.

    Both sides meet in one grouping, so a key with many batch rows is combined before the shuffle.
    """
    both = stored.withColumn("new_", F.lit(0)).unionByName(batch.withColumn("new_", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in stored.columns if c not in keys]
    x = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("new_", *order)).alias("x"), F.min("new_").alias("a"), F.max("new_").alias("z"))
    return x.select(*keys, "x.*", F.when(F.col("z") == 0, "kept").when(F.col("a") == 1, "inserted").otherwise("replaced").alias("action"))


def merge_sides(rows: DataFrame, key: str, side: str, value: str, order: list[str]) -> DataFrame:
    """key, home, away: each side's last known value in one row."""
    last = lambda s: F.max_by(value, F.when((F.col(side) == s) & F.col(value).isNotNull(), F.struct(*order))).alias(s)
    return rows.groupBy(key).agg(last("home"), last("away"))


def melt(rows: DataFrame, keys: list[str], stats: list[str], order: list[str]) -> DataFrame:
    """keys, stat_key, value: known statistics as rows, the last row of a key winning for each."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).cast("double").alias(c) for c in stats]
    return rows.groupBy(*keys).agg(*last).unpivot(keys, stats, "stat_key", "value").where("value is not null")


def with_roster(players: DataFrame, roster: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Players with ``columns`` of the last roster row of their keys."""
    last = roster.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r_"))
    return players.join(last, keys, "left").select("*", "r_.*").drop("r_")


def certainty(text: Column, kind: Column) -> Column:
    """How sure an absence is, by the first phrase in the text; a suspension is sure."""
    said = F.coalesce(*(F.when(F.contains(F.lower(text), F.lit(k)), F.lit(v)) for k, v in CERTAINTY.items()), F.lit(UNSURE))
    return F.when(F.lower(kind) == "suspended", F.lit(1.0)).otherwise(said)


def impact_label(value: Column) -> Column:
    return F.when(value >= KEY_VALUE, "key").when(value >= STARTER_VALUE, "starter").otherwise("rotation")


def absence_report(absences: DataFrame, keys: list[str], name: str, value: str, impact: str) -> DataFrame:
    """keys, n, penalty (not below the floor), has_key, worst: names of the three that cost most."""
    x = absences.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(impact).alias("s"), F.bool_or(F.col(value) >= KEY_VALUE).alias("has_key"), F.sort_array(F.collect_list(F.struct(impact, name))).alias("l"))
    return x.select(*keys, "n", F.round(F.greatest("s", F.lit(-MOST_TEAM_IMPACT)), 4).alias("penalty"), "has_key", F.array_join(F.slice(f"l.{name}", 1, 3), ", ").alias("worst"))


def penalised(xg: Column, penalty: Column) -> Column:
    """Expected goals less the penalty, not below the least; as they are without one. Nine places come first, so that a half in the last one goes up."""
    return F.round(F.round(F.when(penalty < 0, F.greatest(xg * (1 + penalty), F.lit(LEAST_XG))).otherwise(xg), 9), 4)


def verdict(rows: DataFrame, health: DataFrame, provider: str, rate: str, current: str, recommended: str) -> DataFrame:
    """Rows with both providers' rates and ``validated``: null if either is unknown. ``health`` holds one row a provider."""
    for c, n in ((current, "current_rate"), (recommended, "recommended_rate")):
        rows = rows.join(health.select(F.col(provider).alias(c), F.col(rate).alias(n)), c, "left")
    return rows.withColumn("validated", F.col("recommended_rate") > F.col("current_rate"))


def counts_below(rows: DataFrame, group: str, value: str, counts: list[Column], width: float) -> DataFrame:
    """group, value, ``counts``, n, below: rows of each value of a group, and how many rows of the group lie below it.

    Equal values are counted first, so a hot value is one row. Counts of bins of ``width`` are summed over
    bins, and values are sorted only inside a bin, so no task holds a group; the finer the bins the less it holds.
    """
    x = rows.groupBy(group, value).agg(F.count("*").alias("n"), *counts).withColumn("bin_", F.floor(F.col(value) / width))
    bins = x.groupBy(group, "bin_").agg(F.sum("n").alias("b_"))
    bins = bins.withColumn("before_", F.sum("b_").over(Window.partitionBy(group).orderBy("bin_")) - F.col("b_")).drop("b_")
    inside = F.sum("n").over(Window.partitionBy(group, "bin_").orderBy(value)) - F.col("n")
    return x.withColumn("inside_", inside).join(bins, [group, "bin_"]).withColumn("below", F.col("before_") + F.col("inside_")).drop("bin_", "inside_", "before_")


def tail(z: Column) -> Column:
    """Chance that a standard normal value is further from 0 than z, by the rational approximation 7.1.26 of Abramowitz and Stegun (error below 1.5e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def signed_ranks(rows: DataFrame, group: str, difference: str, width: float = 0.01, favourable: int = -1) -> DataFrame:
    """group, n, delta, w, z, p_value, better: the signed-rank test of differences that are not 0, ties sharing their mean rank.

    The p-value is the normal approximation with the correction for ties, at every size. Without any difference p is 1.
    """
    d = F.col(difference)
    all_ = rows.where(d.isNotNull()).groupBy(group).agg(F.avg(d).alias("delta"))
    x = counts_below(rows.where(d != 0).withColumn("size_", F.abs(d)), group, "size_", [F.count_if(d > 0).alias("plus"), F.count_if(d < 0).alias("minus")], width)
    rank = F.col("below") + (F.col("n") + 1) / 2
    n = F.col("n").cast("double")
    x = x.groupBy(group).agg(F.sum("n").alias("n"), F.least(F.sum(rank * F.col("plus")), F.sum(rank * F.col("minus"))).alias("w"), F.sum(n * n * n - n).alias("ties"))
    m = F.col("n").cast("double")
    spread = F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("ties") / 48)
    x = all_.join(x, group, "left").withColumn("z", (F.col("w") - m * (m + 1) / 4) / F.nullif(spread, F.lit(0.0)))
    p = F.coalesce(tail(F.col("z")), F.lit(1.0))
    return x.select(group, F.coalesce("n", F.lit(0)).alias("n"), "delta", "w", "z", p.alias("p_value"), ((p < 0.05) & (F.col("delta") * favourable > 0)).alias("better"))


def median_split(rows: DataFrame, group: str, id_: str, metric: str, score: str, least: int, width: float = 0.001, replicates: int = 2000, cells: int = 512, seed: int = 1) -> DataFrame:
    """group, n, median, delta, low, high, verdict: does the half with the higher metric score otherwise than the lower half?

    The median is the value at place n // 2 from 0. Rows are added up by cells first, as in ``gates.paired_tests``,
    and the cells of both halves are drawn again with seeded Poisson weights; ``delta`` is the lower half less the higher.
    """
    x = rows.where(F.col(metric).isNotNull() & F.col(score).isNotNull())
    places = counts_below(x.withColumn("v_", F.col(metric)), group, "v_", [], width)
    total = x.groupBy(group).agg(F.count("*").alias("n_all"))
    median = places.join(total, group).where(F.col("below") + F.col("n") > F.floor(F.col("n_all") / 2)).groupBy(group).agg(F.min("v_").alias("median"), F.max("n_all").alias("n_all"))
    x = x.join(median, group).withColumn("up", F.col(metric) >= F.col("median"))
    x = x.groupBy(group, "up", gates.cell_of(seed, id_, cells).alias("cell")).agg(F.max("n_all").alias("n_all"), F.max("median").alias("median"), F.count("*").alias("c"), F.sum(score).alias("s"))
    x = x.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    x = x.withColumn("w", gates.poisson_one(gates.uniform(seed, F.col("rep"), F.col("cell"))))
    of = lambda up, value: F.sum(F.when(F.col("up") == up, value))
    half = lambda up: of(up, F.col("w") * F.col("s")) / F.nullif(of(up, F.col("w") * F.col("c")), F.lit(0.0))
    mean = lambda up: of(up, F.col("s")) / of(up, F.col("c"))
    x = x.groupBy(group, "rep").agg(F.max("n_all").alias("n"), F.max("median").alias("median"), (mean(False) - mean(True)).alias("delta"), (half(False) - half(True)).alias("boot"), F.coalesce(of(True, F.col("c")), F.lit(0)).alias("n_up"))
    x = x.groupBy(group).agg(F.max("n").alias("n"), F.max("median").alias("median"), F.max("delta").alias("delta"), F.sort_array(F.collect_list("boot")).alias("b"), F.max("n_up").alias("n_up"))
    at = lambda q: F.get("b", (F.size("b") * q).cast("int"))
    few = (F.col("n") < least) | (F.col("n_up") < 2) | (F.col("n") - F.col("n_up") < 2)
    return x.select(group, "n", "median", "delta", at(0.025).alias("low"), at(0.975).alias("high"), F.when(few, "insufficient_data").when((at(0.025) > 0) | (at(0.975) < 0), "surface_worthy").otherwise("rejected").alias("verdict"))


def experiment_status(brier: Column, brier_better: Column, loss: Column, loss_better: Column, accuracy: Column, accuracy_better: Column) -> Column:
    """From the metrics' differences (new less old) and whether each is surely better."""
    wrong = (brier > 0) & (loss > 0) & ~brier_better & ~loss_better & (accuracy < 0)
    return F.when(brier_better & loss_better & accuracy_better, "candidate_for_promotion").when(wrong, "rejected").otherwise("monitoring")


def failure_class(status: Column, exception: Column) -> Column:
    """Why a call failed, by the kind of exception if there was one, else by the HTTP status."""
    return (
        F.when(exception == "timeout", "timeout").when(exception.isNotNull(), "network").when(status.isNull(), None)
        .when(status == 429, "quota").when(status == 403, "forbidden").when((status >= 500) & (status < 600), "upstream_5xx").otherwise("other_error")
    )


def order_state(dates: DataFrame, file: str, place: str, day: str, chunk: int = 100_000) -> DataFrame:
    """file, state: descending, ascending or unsorted by the known days in their order; constant ones count as descending, none is unknown.

    Days are sorted inside chunks of ``chunk`` places; of a chunk only its first and last day go on to be compared with its neighbours'.
    """
    steps = lambda now, before: (F.count_if(now > before).alias("up"), F.count_if(now < before).alias("down"))
    x = dates.where(F.col(day).isNotNull()).withColumn("chunk_", F.floor(F.col(place) / chunk))
    x = x.withColumn("before_", F.lag(day).over(Window.partitionBy(file, "chunk_").orderBy(place)))
    x = x.groupBy(file, "chunk_").agg(*steps(F.col(day), F.col("before_")), F.min_by(day, place).alias("first_"), F.max_by(day, place).alias("last_"))
    x = x.withColumn("before_", F.lag("last_").over(Window.partitionBy(file).orderBy("chunk_")))
    x = x.groupBy(file).agg(*((F.sum(c) + s).alias(c) for c, s in zip(("up", "down"), (F.count_if(F.col("first_") > F.col("before_")), F.count_if(F.col("first_") < F.col("before_"))), strict=True)))
    state = F.when(F.col("up") == 0, "descending").when(F.col("down") == 0, "ascending").otherwise("unsorted")
    return dates.select(file).distinct().join(x, file, "left").select(file, F.when(F.col("up").isNull(), "unknown").otherwise(state).alias("state"))


def name_collisions(rows: DataFrame, keys: list[str], raw: str) -> DataFrame:
    """keys, n, names, kind: keys of several rows; ``collision`` if different raw names meet in one, else ``duplicate``."""
    x = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(raw).alias("names")).where("n > 1")
    return x.withColumn("kind", F.when(F.col("names") > 1, "collision").otherwise("duplicate"))


def also_held(rows: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """Rows whose keys another id holds too. Keys are counted by least and greatest id, so nothing is joined pair by pair."""
    held = rows.groupBy(*keys).agg(F.min(id_).alias("a_"), F.max(id_).alias("z_")).where("a_ <> z_")
    return rows.join(held.select(*keys), keys, "left_semi")


def subsets(rows: DataFrame, keys: list[str], id_: str, engine: str, names: list[str], measure: str) -> DataFrame:
    """keys, for each engine the number and mean of ``measure`` over its own rows, and the same over ids that all engines have.

    ``rows`` hold one row for each id and engine, whose values reach one row by id in one grouping.
    """
    x = rows.groupBy(*keys, id_).agg(*(F.max(F.when(F.col(engine) == n, F.col(measure))).alias(n) for n in names))
    shared = F.lit(True)
    for n in names:
        shared &= F.col(n).isNotNull()
    own = [a for n in names for a in (F.count(n).alias(f"{n}_n"), F.avg(n).alias(n), F.avg(F.when(shared, F.col(n))).alias(f"{n}_common"))]
    return x.groupBy(*keys).agg(*own, F.count_if(shared).alias("common_n"))


def fit_providers(available: DataFrame, capable: DataFrame, mapped: DataFrame) -> DataFrame:
    """league, kind, providers: those that are available, capable of the kind of data and mapped in the league, in order of their names."""
    x = mapped.where("state = 'available'").join(available, "provider", "left_semi").join(capable, "provider")
    return x.groupBy("league", "kind").agg(F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("providers"))
