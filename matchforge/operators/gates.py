"""Gates and trials: equivalence states, migration verdicts, readiness, time limits and resampling tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resampling import MASK, MIX, MOST, draw_rows, poisson_bounds

ELIGIBLE = ("red", "yellow", "green")


def equivalence(live: Column, scheduled: Column, matched: Column, differences: Column, accepted: Column, id_differences: Column, least: int) -> tuple[Column, Column]:
    """Score (null without enough evidence or with nothing scheduled) and state of an evaluation: the worst of coverage, field purity and id purity."""
    base = F.greatest(matched, F.lit(1))
    coverage = matched / F.greatest(live, scheduled, F.lit(1))
    purity = lambda n: F.greatest(1 - n / base, F.lit(0.0))
    worst = F.least(coverage, purity(F.greatest(differences - accepted, F.lit(0))), purity(id_differences))
    scored = (live >= least) & ~((scheduled == 0) & (live > 0))
    state = F.when(live < least, "insufficient_data").when(~scored, "broken").when(worst < 1, "red").when(accepted > 0, "yellow").otherwise("green")
    return F.when(scored, worst), state


def gate_status(evaluations: DataFrame, gate: list[str], order: list[str], state: str, matched: str, breakdown: str) -> DataFrame:
    """The gates' eligible rows and matches, the least provider's matches and the latest state that rests on data.

    The view's outer join of totals and last states is one grouping here, as both have the same keys. ``breakdown`` maps providers to matches.
    """
    fit = F.col(state).isin(*ELIGIBLE)
    x = evaluations.groupBy(*gate).agg(F.coalesce(F.sum(F.when(fit, F.col(matched))), F.lit(0)).alias("total_matched"), F.count_if(fit).alias("eligible"), F.max(F.when(F.col(state) != "insufficient_data", F.struct(*order, F.col(state).alias("v"))))["v"].alias("health"))
    least = evaluations.where(fit).select(*gate, F.explode(breakdown).alias("part_", "n")).groupBy(*gate, "part_").agg(F.sum("n").alias("n")).groupBy(*gate).agg(F.min("n").alias("least_provider"))
    return x.where("health is not null or eligible > 0").join(least, gate, "left")


def gate_verdict(status: DataFrame, least_total: int, least_provider: int) -> DataFrame:
    """FAIL if the last state is red or broken, PASS if the volume is there too, else GRAY."""
    sure = F.least(F.least(F.col("total_matched") / least_total, F.lit(1.0)), F.coalesce(F.least(F.col("least_provider") / least_provider, F.lit(1.0)), F.lit(0.0)))
    x = status.withColumn("confidence", F.when(F.col("health").isNull(), 0.0).otherwise(sure))
    return x.withColumn("verdict", F.when(F.col("health").isNull(), "GRAY").when(F.col("health").isin("red", "broken"), "FAIL").when(F.col("confidence") >= 1, "PASS").otherwise("GRAY"))


def readiness(rows: DataFrame, day: str, recommended: str, changed: str, least_days: int, least_rows: int, least_rate: float) -> DataFrame:
    """Days, rows, share of equal choices, and whether that is enough to be ready in part."""
    named = F.coalesce(F.col(recommended) != "", F.lit(False))
    x = rows.agg(F.count_distinct(day).alias("days"), F.count("*").alias("total"), F.count_if(~F.col(changed) & named).alias("identical"), F.count_if(F.col(changed)).alias("different"), F.count_if(~named).alias("unavailable"))
    enough = (F.col("days") >= least_days) & (F.col("total") >= least_rows)
    rate = F.col("identical") / F.nullif(F.col("total"), F.lit(0))
    return x.withColumns({"rate": rate, "verdict": F.when(F.col("total") == 0, "no data").when(~enough, "sample too small").when(rate >= least_rate, "ready in part").otherwise("rate too low")})


def timed_out(status: Column, limit: Column, now: Column) -> Column:
    """Past their limit pending decisions expire and approved ones are orphaned; others stay."""
    return F.when((limit < now) & (status == "pending"), "expired").when((limit < now) & (status == "approved"), "orphaned").otherwise(status)


def within_window(kickoff: Column, now: Column, days: int, margin_hours: int) -> tuple[Column, Column]:
    """Whether a kick-off is in the window with its margins, and whether it is surely beyond it. Unknown ones are in neither."""
    margin = F.expr(f"interval {margin_hours} hours")
    end = now + F.expr(f"interval {days} days") + margin
    return F.coalesce(kickoff.between(now - margin, end), F.lit(False)), F.coalesce(kickoff > end, F.lit(False))


def uniform(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) that the seed and the columns fix: the same on every run and partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *cols)), 1, 8), 16, 10).cast("double") / 2.0**32


def poisson_one(u: Column, most: int = MOST) -> Column:
    """A Poisson number of mean 1 from a uniform one; above ``most`` there are 6e-11 of them."""
    return sum(F.when(u >= b, 1.0).otherwise(0.0) for b in poisson_bounds(most))


def cell_of(seed: int, id_: str, cells: int) -> Column:
    """One of so many cells, which the seed and the id fix."""
    return F.floor(uniform(seed, F.col(id_)) * cells)


def mixed_uniform(one: Column, two: Column, rep: Column) -> Column:
    """A number in [0, 1) of a replicate, from a row's two words of 31 bits: some integer steps where ``uniform`` takes a digest."""
    z = (one.bitwiseXOR((rep * MIX[0]).bitwiseAND(MASK)) * MIX[1]).bitwiseAND(MASK)
    z = z.bitwiseXOR(F.shiftright(z, 15)).bitwiseXOR(two)
    z = (z * MIX[2]).bitwiseAND(MASK)
    z = (z.bitwiseXOR(F.shiftright(z, 13)) * MIX[3]).bitwiseAND(MASK)
    return z.bitwiseXOR(F.shiftright(z, 16)).cast("double") / 2.0**31


def paired_tests(rows: DataFrame, group: str, id_: str, differences: dict[str, Column], replicates: int = 2000, cells: int | None = 512, seed: int = 1) -> DataFrame:
    """group, name, n, delta, low, high, p_value, better, better_by_flips for each named difference of paired values (lower is better).

    delta is the mean, low and high its bootstrap interval of 95 %, p_value the share of sign flips with a mean as
    low. Rows are added up by ``cells`` of their ids first, all differences in one pass; then cells are drawn and
    flipped as wholes, so what meets the replicates has a bounded size whatever the number of rows. A Poisson weight
    stands for drawing with replacement. As a cell's rows are drawn together, the interval's width has a standard error of
    1 / sqrt(2 * cells), 3 %, besides that of the replicates; with fewer rows than cells it is the plain bootstrap but
    for rows that share a cell by chance. Without ``cells`` each row is drawn and flipped by itself: rows times replicates,
    which ``resampling`` adds up in the tasks where the rows are.
    """
    names = list(differences)
    if cells is None:
        word = lambda at: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), id_)), at, 8), 16, 10).cast("long").bitwiseAND(MASK)
        own = [c for k, d in enumerate(differences.values()) for c in (d.isNotNull().cast("long").alias(f"n{k}"), F.coalesce(d, F.lit(0.0)).cast("double").alias(f"d{k}"))]
        x = draw_rows(rows.select(group, word(1).alias("one"), word(9).alias("two"), *own), group, len(names), replicates)
        drawn = lambda k: [F.col(f"{c}{k}") for c in ("wn", "wd", "f")]
    else:
        sums = [a for k, d in enumerate(differences.values()) for a in (F.count(d).alias(f"n{k}"), F.coalesce(F.sum(d), F.lit(0.0)).alias(f"d{k}"))]
        x = rows.groupBy(group, cell_of(seed, id_, cells).alias("cell")).agg(*sums)
        x = x.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep")).withColumn("u", uniform(seed, F.col("rep"), F.col("cell"))).withColumn("w", poisson_one(F.col("u")))
        drawn = lambda k: [F.col("w") * F.col(f"n{k}"), F.col("w") * F.col(f"d{k}"), F.when(F.col("u") < 0.5, F.col(f"d{k}")).otherwise(-F.col(f"d{k}"))]
    over = lambda v, n: F.sum(v) / F.nullif(F.sum(n), F.lit(0.0))

    def each(k: int) -> Column:
        (wn, wd, flip), n = drawn(k), F.col(f"n{k}").cast("double")
        return F.struct(F.lit(names[k]).alias("name"), F.sum(f"n{k}").alias("n"), over(F.col(f"d{k}"), n).alias("mean"), over(wd, wn).alias("boot"), over(flip, n).alias("flip"))

    x = x.groupBy(group, "rep").agg(*(each(k).alias(f"x{k}") for k in range(len(names)))).select(group, F.explode(F.array(*(f"x{k}" for k in range(len(names))))).alias("x")).select(group, "x.*")
    x = x.groupBy(group, "name").agg(F.max("n").alias("n"), F.max("mean").alias("delta"), F.sort_array(F.collect_list("boot")).alias("b"), F.avg((F.col("flip") <= F.col("mean")).cast("double")).alias("p_value"))
    at = lambda q: F.get("b", (F.size("b") * q).cast("int"))
    return x.select(group, "name", "n", "delta", at(0.025).alias("low"), at(0.975).alias("high"), "p_value", (at(0.975) < 0).alias("better"), (F.col("p_value") < 0.05).alias("better_by_flips"))
