"""Which model was champion when, and how a challenger does against it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring

# Metrics of which less is better; the others are better when higher.
LESS_IS_BETTER = ("log_loss", "brier")


def periods(log: DataFrame) -> DataFrame:
    """scope, run, since, until (null: still champion), predecessor, began (what began it) from a log of scope, at, seq, kind, run.

    A ``promote`` makes its run champion, a ``rollback`` the run that the champion superseded,
    so a second rollback undoes the first. A scope's first champion superseded none, and a
    rollback of it is refused, as is one before it. A promotion is followed by its own
    rollbacks only, so who is champion is their number, odd or even, and the champion before it.
    """
    at = Window.partitionBy("scope").orderBy("at", "seq")
    upto = at.rowsBetween(Window.unboundedPreceding, 0)
    x = log.where("kind in ('promote', 'rollback')").withColumn("block", F.sum((F.col("kind") == "promote").cast("int")).over(upto)).where("block > 0")
    blocks = x.groupBy("scope", "block").agg(F.max_by("run", (F.col("kind") == "promote").cast("int")).alias("one"), F.count_if(F.col("kind") == "rollback").alias("undone"))
    # The champion before a block's promotion: the last one promoted before a block that ends as it began.
    order = Window.partitionBy("scope").orderBy("block")
    before = F.lag("one").over(order)
    ends_so = F.coalesce((F.lag("undone").over(order) % 2 == 0) | (F.lag("block").over(order) == 1), F.lit(False))
    blocks = blocks.withColumn("kept", F.when(ends_so, before))
    blocks = blocks.withColumn("other", F.last("kept", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    y = x.select("scope", "at", "seq", "kind", "block", (F.row_number().over(Window.partitionBy("scope", "block").orderBy("at", "seq")) - 1).alias("turns")).join(blocks.select("scope", "block", "one", "other"), ["scope", "block"])
    y = y.where((F.col("kind") == "promote") | F.col("other").isNotNull())
    odd = F.col("turns") % 2 == 1
    y = y.select("scope", F.when(odd, F.col("other")).otherwise(F.col("one")).alias("run"), F.when(odd, F.col("one")).otherwise(F.col("other")).alias("predecessor"), F.col("at").alias("since"), "seq", F.col("kind").alias("began"))
    return y.withColumn("until", F.lead("since").over(Window.partitionBy("scope").orderBy("since", "seq"))).select("scope", "run", "since", "until", "predecessor", "began")


def as_of(rows: DataFrame, periods_: DataFrame, scope: str, day: str) -> DataFrame:
    """``rows`` with the champion (``champion``, ``champion_since``) of their day, null before the first. A day's champion is the last that began by its start.

    Periods are repeated for the months that they touch, so that rows meet those of their month
    only, by an equal key. A period still open ends with the last day of the rows.
    """
    last = rows.agg(F.max(day).alias("end"))  # one row
    month = lambda c: F.date_trunc("month", c)
    p = periods_.crossJoin(F.broadcast(last)).withColumn("stop", F.coalesce(F.date_sub(F.to_date("until"), 1), "end")).where(F.to_date("since") <= F.col("stop"))
    p = p.select(F.col("scope").alias("p_scope"), F.col("run").alias("champion"), F.col("since").alias("champion_since"), "stop", F.explode(F.sequence(month("since").cast("date"), month("stop").cast("date"), F.expr("interval 1 month"))).alias("p_month"))
    fits = (F.col(scope) == F.col("p_scope")) & (month(F.col(day)).cast("date") == F.col("p_month")) & (F.col(day) >= F.to_date("champion_since")) & (F.col(day) <= F.col("stop"))
    return rows.join(p, fits, "left").drop("p_scope", "p_month", "stop")


def compare(rows: DataFrame, keys: list[str], own: tuple[str, str, str], other: tuple[str, str, str], result: str = "result") -> DataFrame:
    """keys, n, each metric of the challenger (``own``) and the champion (``other``) on the same rows, its difference to 4 places and whether it is better; ``better`` if all are."""
    def of(names: tuple[str, str, str]) -> dict:
        p = [F.col(c) for c in names]
        return {"accuracy": (scoring.likeliest(*p) == F.col(result)).cast("double"), "log_loss": scoring.log_loss(scoring.of_result(F.col(result), *p)), "brier": scoring.brier(F.col(result), *p)}

    mine, theirs = of(own), of(other)
    known = F.col(result).isin("H", "D", "A")
    for c in (*own, *other):
        known = known & F.col(c).isNotNull()
    x = rows.where(known).groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(v).alias(f"{side}_{k}") for side, all_ in (("challenger", mine), ("champion", theirs)) for k, v in all_.items()))
    x = x.withColumns({f"{k}_delta": F.round(F.col(f"challenger_{k}") - F.col(f"champion_{k}"), 4) for k in mine})
    better = {k: F.col(f"{k}_delta") < 0 if k in LESS_IS_BETTER else F.col(f"{k}_delta") > 0 for k in mine}
    return x.withColumn("better", better["accuracy"] & better["log_loss"] & better["brier"])
