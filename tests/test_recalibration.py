"""The streamed replay against a plain loop with the rules written out, and single steps by hand."""

from decimal import ROUND_HALF_EVEN, Decimal

import pytest

from matchforge.operators import recalibration
from matchforge.plans import lookup_queries

COLUMNS = "match_id long, day int, league string, home_xg double, away_xg double, home_goals long, away_goals long, recency double"


def r4(x):
    return float(Decimal(x).quantize(Decimal("0.0001"), rounding=ROUND_HALF_EVEN))


def cut(x, low, high):
    return low if x < low else high if x > high else x


def plain(rows):
    """All rows of one league, in order, with the rules spelled out one by one."""
    f, b, g, s, p, h = 0.6, 0.4, 0.45, 0.3, 0.25, 1.07
    top = [f, b, g, s, p]
    for k, r in enumerate(rows):
        eh, ea = r["home_goals"] - r["home_xg"], r["away_goals"] - r["away_xg"]
        c, m = (abs(eh) + abs(ea)) / 2, (eh + ea) / 2
        if c < 0.3:
            continue
        st = min(c / 3, 1.0) * (0.05 * r["recency"]) * max(1.0, 3 / (k + 1))
        mv = lambda x: cut(x, -0.15, 0.15)
        if c >= 0.5:
            f, b = cut(f + mv(-st * 0.6), 0.1, 0.9), cut(b + mv(st * 0.6), 0.1, 0.9)
        if m > 0.5:
            g, s = cut(g + mv(st * 0.5), 0.1, 0.8), cut(s + mv(st * 0.3), 0.05, 0.6)
            h = cut(h + mv(st * 0.2), 1.0, 1.2) if eh > 0.5 else h
        elif m < -0.5:
            g, p = cut(g + mv(-st * 0.4), 0.1, 0.8), cut(p + mv(st * 0.3), 0.05, 0.5)
            h = cut(h + mv(-st * 0.15), 1.0, 1.2) if eh < -0.5 else h
        t, u = g + s + p, f + b
        g, s, p, f, b = r4(g / t), r4(s / t), r4(p / t), r4(f / u), r4(b / u)
        bounds = [(0.1, 0.9), (0.1, 0.9), (0.1, 0.8), (0.05, 0.6), (0.05, 0.5)]
        top = [r4(cut(x + (y - x) * 0.25, *z)) for x, y, z in zip(top, (f, b, g, s, p), bounds, strict=True)]
    return [f, b, g, s, p, h], top


def test_one_step_by_hand(spark):
    rows = spark.createDataFrame([(1, 1, "a", 1.0, 1.0, 3, 2, 1.0), (2, 1, "b", 1.0, 1.0, 1, 1, 1.0), (3, 1, "c", None, 1.0, 1, 1, 1.0)], COLUMNS)
    got = {r["league"]: r for r in recalibration.recalibrate(rows).collect()}
    # Errors 2 and 1: the step is 1.5 / 3 of three times 0.05, that is 0.075.
    a = got["a"]
    assert set(got) == {"a", "b"} and (a["status"], a["seen"], got["b"]["status"], got["b"]["form"]) == ("recalibrated", 1, "stable", 0.6)
    assert [a[n] for n in ("form", "base", "goals", "shots", "possession")] == [0.555, 0.445, r4(0.4875 / 1.06), r4(0.3225 / 1.06), r4(0.25 / 1.06)]
    assert a["home"] == pytest.approx(1.085) and a["global_form"] == r4(0.6 + (0.555 - 0.6) * 0.25)


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_replay_equals_a_plain_loop(spark, batch):
    rows = [(k, k // 3, "ab"[k % 2], 0.2 + k * 37 % 29 / 10, 0.3 + k * 53 % 23 / 10, k * 7 % 5, k * 11 % 4, 0.5 + k % 5 / 10) for k in range(400)]
    df = spark.createDataFrame(rows, COLUMNS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r["league"], r["seen"]): r for r in recalibration.recalibrate(df.repartition(5)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    names = COLUMNS.replace("long", "").split(",")
    keys = [n.split()[0] for n in names]
    for league in "ab":
        mine = [dict(zip(keys, r, strict=True)) for r in rows if r[2] == league]
        for n in (1, 2, 50, 200):
            own, top = plain(mine[:n])
            r = got[league, n]
            assert [r[c] for c in recalibration.WEIGHTS] == pytest.approx(own, abs=1e-9)
            assert [r[f"global_{c}"] for c in list(recalibration.WEIGHTS)[:5]] == pytest.approx(top, abs=1e-9)


def test_latest_weights_trust_a_league_by_its_matches(spark, sf):
    rows = spark.createDataFrame([(k, k, "a", 1.0, 1.0, 3, 2, 1.0) for k in range(2)], COLUMNS)
    steps = recalibration.recalibrate(rows)
    last = steps.where("seen = 2").first()
    used = recalibration.latest_weights(steps).first()
    assert used["seen"] == 2 and used["form"] == pytest.approx(0.4 * last["form"] + 0.6 * last["global_form"]) and used["home"] == pytest.approx(0.4 * last["home"] + 0.6 * 1.07)
    stats = recalibration.learning_stats(steps).first()
    assert (stats["samples"], stats["confidence"], stats["form"]) == (2, 40.0, round(last["form"], 4)) and stats["d_form"] == pytest.approx(last["form"] - 0.6, abs=1e-4)
    assert lookup_queries.learning_stats(spark, sf).where("confidence = 100").count() == 5
    got = lookup_queries.recalibration(spark, sf).collect()
    assert len(got) == 5 and all(abs(r["form"] + r["base"] - 1) < 2e-4 for r in got)
