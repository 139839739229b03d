"""Draws row by row in numpy: the same numbers as the column expressions, and no row for each replicate."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchforge.operators import gates, resampling


def plainly(rows, differences, replicates, seed=1):
    """Every row beside every replicate, by ``mixed_uniform`` and ``poisson_one``."""
    word = lambda at: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "id")), at, 8), 16, 10).cast("long").bitwiseAND(gates.MASK)
    x = rows.select("g", *differences, word(1).alias("one"), word(9).alias("two"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))).alias("rep"))
    x = x.withColumn("u", gates.mixed_uniform(F.col("one"), F.col("two"), F.col("rep"))).withColumn("w", gates.poisson_one(F.col("u")))
    out = {}
    for c in differences:
        d = F.coalesce(c, F.lit(0.0))
        n = F.col(c).isNotNull().cast("double")
        y = x.groupBy("g", "rep").agg(F.sum(n).alias("n"), F.sum(d).alias("d"), F.sum(F.col("w") * n).alias("wn"), F.sum(F.col("w") * d).alias("wd"), F.sum(F.when(F.col("u") < 0.5, d).otherwise(-d)).alias("f"))
        y = y.selectExpr("g", "n", "d / nullif(n, 0) as mean", "wd / nullif(wn, 0) as boot", "f / nullif(n, 0) as flip")
        for r in y.groupBy("g").agg(F.max("n").alias("n"), F.max("mean").alias("delta"), F.sort_array(F.collect_list("boot")).alias("b"), F.expr("avg(cast(flip <= mean as double))").alias("p")).collect():
            at = lambda q: r["b"][int(len(r["b"]) * q)] if r["b"] else None  # noqa: B023, E731
            out[r["g"], c] = (int(r["n"]), r["delta"], at(0.025), at(0.975), r["p"])
    return out


def near(a, b):
    return a == b or (a is not None and b is not None and (abs(a - b) < 1e-9 or (a != a and b != b)))


@pytest.mark.parametrize("replicates", [2000, 37, 70000])
def test_draws_equal_the_plain_ones(spark, replicates):
    n = 3000 if replicates < 2000 else 300 if replicates == 2000 else 9
    # Groups of one row, of none known, of infinite and of unknown values, one without a name, and a large one.
    g = "case when id < 1 then 'one' when id < 4 then null when id < 6 then 'infinite' when id < 7 then 'unknown' when id < 8 then 'zero' when id < 8 + 2 then 'none' else 'many' end"
    d = f"case when id = 4 then double('inf') when id = 6 then double('nan') when id = 7 then 0.0D when id between 8 and 9 then null else cast((id * 7919) % 1009 - 400 as double) / 7 end"
    rows = spark.range(n).selectExpr(f"{g} as g", "id", f"{d} as d", "if(id % 3 = 0, null, id - 70.5D) as e").repartition(3)
    want = plainly(rows, ["d", "e"], replicates)
    got = {(r["g"], r["name"]): tuple(r[c] for c in ("n", "delta", "low", "high", "p_value")) for r in gates.paired_tests(rows, "g", "id", {"d": F.col("d"), "e": F.col("e")}, replicates, cells=None).collect()}
    assert set(got) == set(want)
    for k in want:
        assert all(map(near, got[k], want[k])), (k, got[k], want[k])


def test_a_task_gives_sums_and_not_draws(spark):
    rows = spark.range(20000, numPartitions=2).selectExpr("if(id % 2 = 0, 'a', 'b') as g", "id", "id / 7 as d")
    plan = gates.paired_tests(rows, "g", "id", {"d": F.col("d")}, cells=None)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "explode(org.apache" not in plan and "explode(sequence" not in plan
    words = rows.selectExpr("g", "id * 7919 as one", "id * 104729 % 65521 as two", "1L as n0", "d as d0")
    got = resampling.draw_rows(words, "g", 1, 2000)
    tasks = resampling.SLICES * spark.sparkContext.defaultParallelism
    assert got.rdd.getNumPartitions() == tasks and got.count() <= tasks * 2 * 2000 and got.agg(F.sum("n0")).first()[0] == 20000 * 2000


def test_trials_read_matches_once_and_work_out_no_probabilities(spark, sf):
    from matchforge.plans import record_queries

    plan = record_queries.paired_trials(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "EXP(" not in plan.upper() and plan.count("Relation [") == 7


def test_groups_beyond_what_a_task_holds_are_whole(spark, monkeypatch):
    monkeypatch.setattr(resampling, "HELD", 500)
    monkeypatch.setattr(resampling, "SLICES", 1)
    words = spark.range(600, numPartitions=1).selectExpr("id % 40 as g", "id * 7919 as one", "id as two", "1L as n0", "id + 0.5D as d0")
    got = {(r["g"], r["n"], r["d"]) for r in resampling.draw_rows(words, "g", 1, 50).groupBy("g", "rep").agg(F.sum("n0").alias("n"), F.sum("d0").alias("d")).collect()}
    assert got == {(g, 15, sum(i + 0.5 for i in range(g, 600, 40))) for g in range(40)}


def test_weights_of_a_block():
    draws = resampling.Draws(500)
    rng = np.random.default_rng(5)
    one, two = rng.integers(0, 2**31, (2, draws.rows))
    z = ((one[:, None] ^ ((np.arange(500) * resampling.MIX[0]) & resampling.MASK)) * resampling.MIX[1]) & resampling.MASK
    z = (z ^ (z >> 15) ^ two[:, None]) * resampling.MIX[2] & resampling.MASK
    z = ((z ^ (z >> 13)) * resampling.MIX[3]) & resampling.MASK
    u = (z ^ (z >> 16)) / 2.0**31
    weight, turned = draws.block(*((v << 1).astype(np.uint32) for v in (one, two)))
    assert (weight == sum((u >= b).astype(int) for b in resampling.poisson_bounds())).all() and weight.max() > resampling.DENSE
    assert (turned == (u >= 0.5)).all()
