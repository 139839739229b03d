"""Reports of closed periods, each written once however often a batch is run."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring

#: Days of each kind of period; all end with a day that is over.
DAYS = {"daily": 1, "weekly": 7}


def window_for(cadence: str, as_of: date) -> tuple[date, date] | None:
    """First and last day of the period that is closed on ``as_of``, which is left out; none for an unknown kind."""
    if cadence not in DAYS:
        return None
    return as_of - timedelta(days=DAYS[cadence]), as_of - timedelta(days=1)


def reports(rows: DataFrame, first: date | None = None, last: date | None = None) -> DataFrame:
    """cadence, period_end, n, n_common, and n, accuracy, log_loss, brier of each engine for each period that ends from ``first`` to ``last``.

    ``rows``: day, result, and for each engine p, q the three columns <engine>_home, _draw,
    _away (null where the engine said nothing). ``n`` counts the matches with a result,
    ``n_common`` those that every engine predicted. Each row is repeated for the periods that
    hold its day, eight at most.
    """
    engines = sorted({c.removesuffix("_home") for c in rows.columns if c.endswith("_home")})
    bounds = rows.agg(F.min("day").alias("a"), F.max("day").alias("b"))  # one row
    low, high = (F.lit(first) if first else F.col("a")), (F.lit(last) if last else F.date_sub("b", 1))
    ends = F.explode(F.array(*(F.struct(F.lit(c).alias("cadence"), F.date_add("day", k).alias("period_end")) for c, n in DAYS.items() for k in range(n))))
    x = rows.where("result in ('H', 'D', 'A')").crossJoin(F.broadcast(bounds)).select("*", ends.alias("x")).where(F.col("x.period_end").between(low, high))
    p = {e: [F.col(f"{e}_{k}") for k in ("home", "draw", "away")] for e in engines}
    said = {e: F.expr(" and ".join(f"{e}_{k} is not null" for k in ("home", "draw", "away"))) for e in engines}
    out = [F.count("*").alias("n"), F.count_if(F.expr(" and ".join(f"{e}_{k} is not null" for e in engines for k in ("home", "draw", "away")))).alias("n_common")]
    for e in engines:
        of = lambda v, e=e: F.avg(F.when(said[e], v))
        out += [F.count_if(said[e]).alias(f"{e}_n"), of((scoring.likeliest(*p[e]) == F.col("result")).cast("double")).alias(f"{e}_accuracy"), of(scoring.log_loss(scoring.of_result(F.col("result"), *p[e]))).alias(f"{e}_log_loss"), of(scoring.brier(F.col("result"), *p[e])).alias(f"{e}_brier")]
    return x.groupBy("x.cadence", "x.period_end").agg(*out)


def overwrite(df: DataFrame, path: str, *keys: str) -> None:
    """Writes ``df`` as Parquet in folders by ``keys``; only the folders that it has rows for are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = fs.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(fs)
    return spark.read.parquet(path) if there else None


def report_closed_periods(rows_path: str, reports_path: str):
    """For foreachBatch: keeps the batch's rows, and writes the reports of the periods that it closes.

    Rows are kept in folders by batch, and reports in folders by cadence and end of period, so a
    batch that is run again replaces what it wrote. Batches come in order of day; a day is over
    when a later one comes, and the period ends from the last day before the batch to the day
    before its last. A day's rows may be in several batches.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        overwrite(batch.withColumn("batch", F.lit(number)), rows_path, "batch")
        kept = stored(spark, rows_path).where(F.col("batch") <= number)
        today = kept.agg(F.max("day")).first()[0]
        before = kept.where(F.col("batch") < number).agg(F.max("day")).first()[0]
        first = before or kept.agg(F.min("day")).first()[0]
        last = window_for("daily", today)[1]
        if first <= last:
            needed = kept.where(F.col("day").between(first - timedelta(days=DAYS["weekly"] - 1), last)).drop("batch")
            overwrite(reports(needed, first, last), reports_path, "cadence", "period_end")

    return run
