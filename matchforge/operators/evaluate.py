"""Quality of predictions: metrics, calibration, temperature, order statistics, run lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from .lookups import counts_below

NAMES = ("p_home", "p_draw", "p_away")


def _hda() -> list[Column]:
    return [F.col(c) for c in NAMES]


def metrics() -> list[Column]:
    p = scoring.of_result(F.col("result"), *_hda())
    hit = (scoring.likeliest(*_hda()) == F.col("result")).cast("double")
    return [F.count("*").alias("n"), F.avg(hit).alias("accuracy"), F.avg(scoring.log_loss(p)).alias("log_loss"), F.avg(scoring.brier(F.col("result"), *_hda())).alias("brier")]


def report(predictions: DataFrame) -> DataFrame:
    """league (null: all of them), n, accuracy, log_loss, brier. Rows without a result or a probability are left out."""
    # Probabilities come from expected goals where there are any: asking for those keeps the filter away from the grid.
    asked = ("home_xg", "away_xg") if {"home_xg", "away_xg"} <= set(predictions.columns) else NAMES
    rows = predictions.where(" and ".join(f"{c} is not null" for c in ("result", *asked)))
    return rows.groupingSets([[], [F.col("league")]], F.col("league")).agg(*metrics())


def calibration(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """class, bin, n, mean_p, rate for every bin, empty ones too; the top bin holds 1."""
    each = predictions.select(F.explode(F.array(*(F.struct(F.lit(r).alias("class"), p.alias("p"), (F.col("result") == r).cast("double").alias("hit")) for r, p in zip("HDA", _hda(), strict=True)))).alias("x")).select("x.*")
    bin_ = F.least(F.greatest(F.floor(F.col("p") * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    found = each.groupBy("class", bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("hit").alias("rate"))
    grid = predictions.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), F.explode(F.array(F.lit("H"), F.lit("D"), F.lit("A"))).alias("class"))
    return grid.join(found, ["class", "bin"], "left").select("class", "bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "rate")


def temperatures(predictions: DataFrame, grid: tuple[float, ...]) -> DataFrame:
    """temperature, log_loss of probabilities softened by each; all of the grid in one pass."""
    logs = [F.ln(F.greatest(p, F.lit(1e-10))) for p in _hda()]
    own = scoring.of_result(F.col("result"), *logs)
    losses = [F.avg(F.ln(sum((F.exp(x / t) for x in logs[1:]), F.exp(logs[0] / t))) - own / t).alias(f"t{i}") for i, t in enumerate(grid)]
    row = predictions.where("result is not null").agg(*losses)
    return row.select(F.explode(F.array(*(F.struct(F.lit(t).alias("temperature"), F.col(f"t{i}").alias("log_loss")) for i, t in enumerate(grid)))).alias("x")).select("x.*")


def spread(rows: DataFrame, group: str, value: str, small: float, width: float = 0.01) -> DataFrame:
    """n, n_zero, n_small, n_material, most, mean, median (upper middle) and p95 (index cut down) of absolute values; unknown ones are left out."""
    x = rows.select(group, F.abs(F.col(value)).alias("v")).where("v is not null")
    total = x.groupBy(group).agg(F.count("*").alias("n_all"), F.count_if(F.col("v") == 0).alias("n_zero"), F.count_if((F.col("v") > 0) & (F.col("v") <= small)).alias("n_small"), F.count_if(F.col("v") > small).alias("n_material"), F.max("v").alias("most"), F.avg("v").alias("mean"))
    # The least value with so many values up to it; equal values are one row, and no group is sorted as a whole.
    places = counts_below(x, group, "v", [], width).join(total, group)
    pick = lambda i: F.min(F.when(F.col("below") + F.col("n") > i, F.col("v")))
    figures = ("n_zero", "n_small", "n_material", "most", "mean")
    return places.groupBy(group, "n_all", *figures).agg(pick(F.floor(F.col("n_all") / 2)).alias("median"), pick(F.floor(F.col("n_all") * 0.95)).alias("p95")).select(group, F.col("n_all").alias("n"), *figures, "median", "p95")


def leading_run(rows: DataFrame, group: str, order: list[Column], flag: Column) -> DataFrame:
    """For each group the number of rows, in this order, before the first whose flag is not true."""
    x = rows.select(group, F.coalesce(flag, F.lit(False)).alias("flag"), F.row_number().over(Window.partitionBy(group).orderBy(*order)).alias("at"))
    return x.groupBy(group).agg(F.coalesce(F.min(F.when(~F.col("flag"), F.col("at"))) - 1, F.count("*")).cast("long").alias("run"))


def trend(rows: DataFrame, group: str, order: list[Column], value: str) -> DataFrame:
    """Mean of the earlier and of the later part of each group; of an odd number the earlier part is the smaller."""
    x = rows.withColumn("at", F.row_number().over(Window.partitionBy(group).orderBy(*order))).withColumn("half", F.floor(F.count("*").over(Window.partitionBy(group)) / 2))
    early = F.col("at") <= F.col("half")
    x = x.groupBy(group).agg(F.avg(F.when(early, F.col(value))).alias("early"), F.avg(F.when(~early, F.col(value))).alias("late"))
    return x.withColumn("worse", F.col("late") > F.col("early"))


def walk_forward(rows: DataFrame, order: list[str], folds: int = 5) -> DataFrame:
    """Adds segment 0 to ``folds`` by place in time: fold k trains on lower segments and is judged on its own.

    Segment k begins at place k * n / (folds + 1), cut down. Places are counted by day first, so that only days are ranked in one task.
    """
    days = rows.groupBy("day").agg(F.count("*").alias("n"))
    days = days.withColumn("ahead", F.sum("n").over(Window.orderBy("day")) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy()))
    x = rows.join(days.select("day", "ahead", "all"), "day")
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("day").orderBy(*order)) - 1
    return x.withColumn("segment", F.floor(((place + 1) * (folds + 1) - 1) / F.col("all")).cast("int")).drop("ahead", "all")
