"""Health, cost and choice of data providers from their call log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring

REASONS = ("quota", "timeout", "parse")


def windows(calls: DataFrame, hours: tuple[int, ...] = (24, 168)) -> DataFrame:
    """provider, hours, calls, errors, success_rate, latency_ms up to the log's last call. All windows come from one pass."""
    end = calls.agg(F.max("called_at").alias("end"))
    x = calls.join(F.broadcast(end)).withColumn("age", F.timestamp_diff("SECOND", "called_at", "end"))
    x = x.select("*", F.explode(F.array(*map(F.lit, hours))).alias("hours")).where(F.col("age") < F.col("hours") * 3600)
    return x.groupBy("provider", "hours").agg(F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("errors"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg("latency_ms").alias("latency_ms"))


def error_breakdown(calls: DataFrame) -> DataFrame:
    """provider and failed calls by reason, the rest as ``other``."""
    failed = ~F.col("success")
    known = [F.count_if(failed & (F.col("reason") == r)).alias(r) for r in REASONS]
    return calls.groupBy("provider").agg(*known, F.count_if(failed & ~F.coalesce(F.col("reason").isin(*REASONS), F.lit(False))).alias("other"))


def daily(calls: DataFrame) -> DataFrame:
    """provider, day, calls, errors, latency_ms (of calls that have one), n_latency."""
    return calls.groupBy("provider", F.to_date("called_at").alias("day")).agg(F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("errors"), F.avg("latency_ms").alias("latency_ms"), F.count("latency_ms").alias("n_latency"))


def rolled_up(days: DataFrame) -> DataFrame:
    """provider, calls, errors, worst_day, latency_ms: days added up; latency weighs by calls and skips days without."""
    weight = F.sum(F.when(F.col("latency_ms").isNotNull(), F.col("calls")))
    return days.groupBy("provider").agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.max("errors").alias("worst_day"), (F.sum(F.col("latency_ms") * F.col("calls")) / F.when(weight > 0, weight)).alias("latency_ms"))


def scores(health: DataFrame, slowest_ms: float = 2000.0) -> DataFrame:
    """provider, score, place: reliability, latency and use weigh 0.5, 0.3 and 0.2; a tie goes to the first name."""
    latency = F.coalesce(scoring.clamp(1 - F.col("latency_ms") / slowest_ms, 0.0, 1.0), F.lit(0.5))
    use = F.col("calls") / F.sum("calls").over(Window.partitionBy())
    x = health.withColumn("score", 0.5 * F.coalesce("success_rate", F.lit(0.5)) + 0.3 * latency + 0.2 * (1 - use))
    return x.select("provider", "score", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "provider")).alias("place"))


def burn_down(health: DataFrame, quota: int) -> DataFrame:
    """provider, hours, left, hours_left: what is left of a quota, and how long it lasts at the window's rate (null without calls)."""
    x = health.withColumn("left", F.greatest(F.lit(quota) - F.col("calls"), F.lit(0)))
    return x.select("provider", "hours", "left", F.when(F.col("calls") > 0, F.col("left") / (F.col("calls") / F.col("hours"))).alias("hours_left"))


def shadow_report(rows: DataFrame) -> DataFrame:
    """section, name, total, identical, different, unavailable, share, delta of recommendations that were only watched.

    ``rows``: day, recommended (null or empty: no candidate), changed (null: no) and deltas, a map of component
    to weighted difference. Sections: ``all``, ``provider`` (recommended ones) and ``day``, out of one grouping over three sets,
    with the share of all rows; and ``component``, the mean difference over changed recommendations. A row may be both
    different and unavailable, as in the log.
    """
    named = F.nullif(F.trim("recommended"), F.lit(""))
    x = rows.select("day", named.alias("recommended"), F.coalesce("changed", F.lit(False)).alias("changed"), "deltas")
    counts = [F.count("*").alias("total"), F.count_if(~F.col("changed") & F.col("recommended").isNotNull()).alias("identical"), F.count_if("changed").alias("different"), F.count_if(F.col("recommended").isNull()).alias("unavailable")]
    y = x.groupingSets([[], [F.col("recommended")], [F.col("day")]], F.col("recommended"), F.col("day")).agg(F.grouping("recommended").alias("no_name"), F.grouping("day").alias("no_day"), *counts)
    section = F.when(F.col("no_name") == 0, "provider").when(F.col("no_day") == 0, "day").otherwise("all")
    y = y.withColumn("section", section).where("section <> 'provider' or recommended is not null").withColumn("name", F.coalesce("recommended", F.col("day").cast("string"), F.lit("")))
    every = y.where("section = 'all'").select(F.col("total").alias("every"))  # one row
    y = y.join(F.broadcast(every)).withColumn("share", F.col("total") / F.nullif(F.col("every"), F.lit(0)))
    parts = x.where("changed").select(F.explode("deltas").alias("name", "delta")).groupBy("name").agg(F.count("delta").alias("total"), F.avg("delta").alias("delta")).select(F.lit("component").alias("section"), "name", "total", F.lit(0).cast("long").alias("identical"), F.col("total").alias("different"), F.lit(0).cast("long").alias("unavailable"), F.lit(None).cast("double").alias("share"), "delta")
    return y.select("section", "name", "total", "identical", "different", "unavailable", "share", F.lit(None).cast("double").alias("delta")).unionByName(parts)
