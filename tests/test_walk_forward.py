"""The distributed fit against a plain one, and the rest of the walk-forward protocol on small rows."""

import math

import numpy as np
import pytest

from matchforge.operators import evaluate, walk_forward
from matchforge.plans import model_queries

NAMES = ["a", "b", "c"]


def made_rows(n=600, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 50.0, 0.01] + [0.0, 200.0, 3.0]
    z = np.column_stack([1.2 * x[:, 0], 0.02 * (x[:, 1] - 200), np.zeros(n)])
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    y = np.array(["HDA"[rng.choice(3, p=q)] for q in p])
    x[rng.random((n, 3)) < 0.15] = np.nan
    return x, y


def frame(spark, x, y, segments):
    clean = [[None if math.isnan(v) else float(v) for v in r] for r in x]
    return spark.createDataFrame([(int(s), str(r), *v) for s, r, v in zip(segments, y, clean, strict=True)], "segment int, result string, " + ", ".join(f"{c} double" for c in NAMES)).repartition(4)


def plain_fit(x, y, ridge=1.0):
    """Gradient descent with a halving step on all rows at once, until nothing moves."""
    known = ~np.isnan(x)
    mean = np.array([x[known[:, j], j].mean() for j in range(x.shape[1])])
    sd = np.array([x[known[:, j], j].std() for j in range(x.shape[1])])
    d = np.hstack([np.ones((len(x), 1)), np.where(known, (x - mean) / sd, 0), 1.0 * ~known])
    t = np.stack([y == "H", y == "D"], 1).astype(float)
    hold = np.r_[0, np.full(d.shape[1] - 1, ridge)]

    def loss(w):
        z = d @ w.T
        return np.logaddexp.reduce(np.hstack([z, np.zeros((len(z), 1))]), axis=1).sum() - (z * t).sum() + 0.5 * (hold * w**2).sum()

    w, step = np.zeros((2, d.shape[1])), 1e-2
    for _ in range(20000):
        z = np.hstack([d @ w.T, np.zeros((len(d), 1))])
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p[:, :2] - t).T @ d + hold * w
        while loss(w - step * g) > loss(w) - 0.4 * step * (g**2).sum() and step > 1e-12:
            step /= 2
        w, step = w - step * g, step * 1.3
        if np.abs(g).max() < 1e-7:
            break
    return w


def test_weights_equal_a_plain_fit(spark):
    x, y = made_rows()
    segments = np.arange(600) * 6 // 600
    models = walk_forward.fit(frame(spark, x, y, segments), NAMES)
    assert sorted(models) == [1, 2, 3, 4, 5]
    for k in (1, 3, 5):
        assert models[k].trained_on == 100 * k and models[k].rounds < 12
        np.testing.assert_allclose(models[k].weights, plain_fit(x[segments < k], y[segments < k]), atol=2e-5)


def test_predictions_and_figures(spark):
    x, y = made_rows()
    segments = np.arange(600) * 6 // 600
    df = frame(spark, x, y, segments)
    models = walk_forward.fit(df, NAMES)
    predicted = walk_forward.predict(df, models, NAMES)
    rows = predicted.collect()
    assert len(rows) == 500
    by = {k: [r for r in rows if r["fold"] == k] for k in models}
    for k, f in models.items():
        own = np.array([[math.nan if r[c] is None else r[c] for c in NAMES] for r in by[k]])
        z = walk_forward.softmax_logits(walk_forward.design(own, f.mean, f.spread), f.weights)
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        np.testing.assert_allclose([[r["p_home"], r["p_draw"], r["p_away"]] for r in by[k]], p, atol=1e-9)
    judged = {r["fold"]: r for r in walk_forward.judged(predicted, models).collect()}
    want = -np.mean([math.log(r[{"H": "p_home", "D": "p_draw", "A": "p_away"}[r["result"]]]) for r in by[5]])
    assert judged[5]["log_loss"] == pytest.approx(want) and judged[5]["trained_on"] == 500 and judged[5]["n"] == 100
    base = {r["fold"]: r for r in walk_forward.baseline(df).collect()}
    assert judged[5]["log_loss"] < base[5]["log_loss"] - 0.05


def test_small_folds_are_left_out(spark):
    x, y = made_rows(60)
    segments = np.r_[np.zeros(15, int), np.arange(45) // 9 + 1]
    one_class = np.where(segments < 2, "H", y)
    assert sorted(walk_forward.fit(frame(spark, x, y, segments), NAMES)) == [2, 3, 4, 5]
    assert sorted(walk_forward.fit(frame(spark, x, one_class, segments), NAMES)) == [3, 4, 5]
    assert walk_forward.fit(frame(spark, x, y, segments).where("false"), NAMES) == {}


def test_segments_begin_where_the_cut_falls(spark):
    rows = spark.createDataFrame([(k, k // 3) for k in range(10)], "match_id int, day int")
    got = [r["segment"] for r in evaluate.walk_forward(rows, ["match_id"]).orderBy("match_id").collect()]
    edges = np.linspace(0, 10, 7, dtype=int)
    assert got == [int(np.searchsorted(edges, k, side="right")) - 1 for k in range(10)]


def test_temperature(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(800, 3)) * 3
    p = np.exp(z / 2.5) / np.exp(z / 2.5).sum(1, keepdims=True)
    y = ["HDA"[rng.choice(3, p=q)] for q in p]
    df = spark.createDataFrame([(r, *map(float, v)) for r, v in zip(y, z, strict=True)], "result string, z_home double, z_draw double, z_away double")
    t = walk_forward.fit_temperature(df)
    at = np.array(["HDA".index(r) for r in y])
    loss = lambda t: float(np.mean(np.logaddexp.reduce(z / t, axis=1) - z[np.arange(800), at] / t))
    grid = np.geomspace(0.05, 10, 4000)
    assert t == pytest.approx(grid[int(np.argmin([loss(g) for g in grid]))], rel=2e-3) and 2 < t < 3
    assert walk_forward.fit_temperature(df.limit(10)) is None and walk_forward.fit_temperature(df.where("result = 'H'")) is None


def test_query_beats_no_one_by_leaking(spark, sf):
    got = model_queries.walk_forward_fit(spark, sf).orderBy("fold").collect()
    assert [r["fold"] for r in got] == [1, 2, 3, 4, 5] and all(r["log_loss"] > 0.9 for r in got)  # results are drawn at random
    assert all(0.05 <= r["temperature"] <= 10 for r in got)


def test_training_rows_equal_the_operators_one_by_one(spark, sf):
    from pyspark.sql import functions as F

    from matchforge.operators import features
    from matchforge.plans.queries import _matches
    from matchforge.sources import bridge

    m = _matches(spark, sf)
    t = bridge.team_matches(m)
    got = {r["match_id"]: r for r in model_queries._training_rows(spark, sf).collect()}
    assert len(got) == m.count()
    form, rest = ({(r["match_id"], r["team"]): r for r in f(t).collect()} for f in (features.form, features.rest_days))
    meetings = {r["match_id"]: r for r in features.head_to_head(m).collect()}
    # Known shots of the matches before, in a plain loop.
    shots, seen = {}, {}
    for r in t.orderBy("day", "match_id").collect():
        before = seen.setdefault(r["team"], [])
        shots[r["match_id"], r["team"]] = sum(before[-10:]) / len(before[-10:]) if before else None
        if r["shots"] is not None:
            before.append(r["shots"])
    for k, r in got.items():
        assert r["modifier"] == (meetings[k]["modifier"] if meetings[k]["meetings"] else None)
        for s in ("home", "away"):
            f = form[k, r[s]]
            assert (r[f"{s}_form"], r[f"{s}_for"], r[f"{s}_against"]) == (f["form_score"] if f["n_form"] else None, f["avg_for"], f["avg_against"])
            assert r[f"{s}_shots_avg"] == pytest.approx(shots[k, r[s]]) and r[f"{s}_rest"] == rest[k, r[s]]["rest_days"]
    assert len({r["modifier"] for r in got.values()}) > 3


def test_matches_are_worked_out_once_and_logits_in_batches(spark, sf, monkeypatch):
    written = []
    real = model_queries.checkpointed
    monkeypatch.setattr(model_queries, "checkpointed", lambda df: (written.append(df._jdf.queryExecution().optimizedPlan().toString()), real(df))[1])
    model_queries.walk_forward_fit(spark, sf)
    assert max(p.count("lineitem") + p.count("l_linenumber#") for p in written[1:]) == 0  # from written rows on
    assert written[0].count("min(struct(l_linenumber") == 1 and "MapInArrow" in written[-1]
