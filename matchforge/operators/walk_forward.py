"""Walk-forward fit of a three-way model: softmax regression by Newton steps, all folds in one pass over the rows.

Fold k learns from segments below k and is judged on segment k. Executors add up gradients and
second derivatives; the driver gets one set of sums a fold, whose size is the square of the
number of features, and solves for the step. Rows stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import scoring
from ..workers import checkpointed, ship

CLASSES = ("H", "D", "A")
#: A fold with fewer rows to learn from, or with one class only, is left out.
LEAST_ROWS = 20


@dataclass
class Fold:
    """Scale and weights of one fold. ``weights``: (class but the last, constant, scaled features, missing marks)."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    rounds: int = 0
    trained_on: int = 0


def design(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """1, each feature in units of its spread (unknown: its mean), and a mark for each that is unknown."""
    missing = np.isnan(x)
    return np.column_stack([np.ones(len(x)), np.where(missing, 0.0, (np.nan_to_num(x) - mean) / spread), missing.astype(float)])


def softmax_logits(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.column_stack([x @ weights.T, np.zeros(len(x))])


def derivatives(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log loss, its gradient and its second derivatives, summed over rows."""
    z = softmax_logits(x, weights)
    z -= z.max(1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(1, keepdims=True)
    loss = -float(np.log(p[np.arange(len(y)), y]).sum())
    k, d = weights.shape
    error = p[:, :k] - (y[:, None] == np.arange(k))
    second = np.empty((k, d, k, d))
    for i in range(k):
        for j in range(i, k):
            second[i, :, j] = second[j, :, i] = (x * (p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ x
    return loss, (error.T @ x).ravel(), second.reshape(k * d, k * d)


def _sums(folds: dict[int, Fold], n_features: int):
    """For mapInArrow: (segment, label, features) to the sums of every fold that learns from the segment."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            segment, y = b.column(0).to_numpy(), b.column(1).to_numpy().astype(int)
            x = np.column_stack([b.column(2 + k).to_numpy(zero_copy_only=False).astype(float) for k in range(n_features)])
            for k, fold in folds.items():
                mine = segment < k
                if mine.any():
                    loss, first, second = derivatives(design(x[mine], fold.mean, fold.spread), y[mine], fold.weights)
                    sums = np.concatenate([[loss], first, second[np.triu_indices(len(first))]])
                    total[k] = total[k] + sums if k in total else sums
        for k, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sums), k, np.int32)), pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], names=["fold", "at", "value"])

    return run


def _scales(rows: DataFrame, features: list[str], folds: int) -> dict[int, Fold]:
    """Means and spreads of what each fold learns from, out of one row a segment."""
    each = [a for c in features for a in (F.count(c), F.coalesce(F.sum(c), F.lit(0.0)), F.coalesce(F.sum(F.col(c) * F.col(c)), F.lit(0.0)))]
    by_segment = {r[0]: r for r in rows.groupBy("segment").agg(F.count("*").alias("n"), *(F.count_if(F.col("label") == k).alias(f"class{k}") for k in range(3)), *(a.alias(f"s{i}") for i, a in enumerate(each))).collect()}
    out = {}
    for k in range(1, folds + 1):
        seen = [r for s, r in by_segment.items() if s < k]
        n = sum(r["n"] for r in seen)
        if n < LEAST_ROWS or k not in by_segment or sum(any(r[f"class{c}"] for r in seen) for c in range(3)) < 2:
            continue
        sums = np.array([sum(r[f"s{i}"] for r in seen) for i in range(len(each))], float).reshape(-1, 3)
        known = np.maximum(sums[:, 0], 1)
        mean = sums[:, 1] / known
        spread = np.sqrt(np.maximum(sums[:, 2] / known - mean**2, 0))
        spread[spread < 1e-9] = 1.0
        out[k] = Fold(mean, spread, np.zeros((2, 1 + 2 * len(features))), trained_on=n)
    return out


def fit(rows: DataFrame, features: list[str], folds: int = 5, ridge: float = 1.0, most_rounds: int = 25, close: float = 1e-8) -> dict[int, Fold]:
    """The fold models. ``rows``: segment, result (H, D or A; others are left out) and the features, null where unknown.

    Each round is one pass for all folds that still move. A step that makes the penalised loss
    worse is halved. ``ridge`` holds back all weights but the constants.
    """
    ship(rows.sparkSession)
    label = F.when(F.col("result") == "H", 0).when(F.col("result") == "D", 1).when(F.col("result") == "A", 2)
    # NaN counts as unknown; Spark would sum it.
    known = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in features]
    x = checkpointed(rows.select(F.col("segment").cast("int").alias("segment"), label.alias("label"), *known).where("label is not null"))
    models = _scales(x, features, folds)
    d = 1 + 2 * len(features)
    held = np.tile(np.r_[0.0, np.full(d - 1, ridge)], 2)
    upper = np.triu_indices(2 * d)
    moving, best, step = dict(models), {}, {}
    for _ in range(most_rounds):
        if not moving:
            break
        sums = x.where(F.col("segment") < max(moving)).mapInArrow(_sums(moving, len(features)), "fold int, at int, value double").groupBy("fold", "at").agg(F.sum("value").alias("value"))
        got = {k: np.zeros(1 + 2 * d + len(upper[0])) for k in moving}
        for r in sums.collect():
            got[r["fold"]][r["at"]] = r["value"]
        for k, fold in list(moving.items()):
            w = fold.weights.ravel()
            loss = got[k][0] + 0.5 * float(held @ w**2)
            if k in best and loss > best[k][0] + 1e-9 * abs(best[k][0]):
                step[k] = step[k] / 2
                fold.weights = (best[k][1] - step[k]).reshape(2, d)
                continue
            second = np.zeros((2 * d, 2 * d))
            second[upper] = got[k][1 + 2 * d :]
            second += np.triu(second, 1).T
            best[k] = loss, w
            # A mark that is never set has no second derivative without a ridge.
            step[k] = np.linalg.lstsq(second + np.diag(held), got[k][1 : 1 + 2 * d] + held * w, rcond=None)[0]
            fold.weights = (w - step[k]).reshape(2, d)
            fold.rounds += 1
            if np.abs(step[k]).max() < close:
                del moving[k]
    return models


def predict(rows: DataFrame, models: dict[int, Fold], features: list[str]) -> DataFrame:
    """Rows of judged segments with fold, z_home, z_draw, z_away (logits) and p_home, p_draw, p_away.

    Logits come from ``design``, as in the fit, a batch of rows at a time.
    """
    ship(rows.sparkSession)
    known = [F.col(c).cast("double").alias(f"known{i}_") for i, c in enumerate(features)]
    x = rows.where(F.col("segment").isin(list(models))).select("*", F.col("segment").cast("int").alias("fold"), *known)
    schema = StructType([f for f in x.schema.fields if f.name not in {f"known{i}_" for i in range(len(features))}] + [StructField(f"z_{k}", DoubleType()) for k in ("home", "draw", "away")])
    names = schema.fieldNames()

    def logits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold = b.column("fold").to_numpy()
            own = np.column_stack([b.column(f"known{i}_").to_numpy(zero_copy_only=False) for i in range(len(features))])
            z = np.zeros((len(own), len(CLASSES)))
            for k, m in models.items():
                if (mine := fold == k).any():
                    z[mine] = softmax_logits(design(own[mine], m.mean, m.spread), m.weights)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[: -len(CLASSES)]), *map(pa.array, z.T)], names=names)

    x = x.mapInArrow(logits, schema)
    top = F.greatest("z_home", "z_draw", "z_away")
    powers = {k: F.exp(F.col(f"z_{k}") - top) for k in ("home", "draw", "away")}
    x = x.withColumns({f"e_{k}": e for k, e in powers.items()}).withColumn("e", F.expr("e_home + e_draw + e_away"))
    return x.withColumns({f"p_{k}": F.col(f"e_{k}") / F.col("e") for k in powers}).drop("e", *(f"e_{k}" for k in powers))


def judged(predicted: DataFrame, models: dict[int, Fold]) -> DataFrame:
    """fold, trained_on, n, accuracy, log_loss, brier of out-of-fold predictions."""
    from .evaluate import metrics

    sizes = predicted.sparkSession.createDataFrame([(k, f.trained_on) for k, f in models.items()], "fold int, trained_on long")
    return predicted.where("result in ('H', 'D', 'A')").groupBy("fold").agg(*metrics()).join(F.broadcast(sizes), "fold")


def fit_temperature(predicted: DataFrame, bounds: tuple[float, float] = (0.05, 10.0), points: int = 17, rounds: int = 6) -> float | None:
    """The temperature at which softened out-of-fold logits lose least, 1 if none is better, null for under 20 rows or one class.

    The loss has one minimum in the temperature, so each pass tries ``points`` of them at once
    and the next looks between the neighbours of the best.
    """
    z = [F.col(f"z_{k}") for k in ("home", "draw", "away")]
    own = scoring.of_result(F.col("result"), *z)
    rows = predicted.where("result in ('H', 'D', 'A')").select(*(c.alias(n) for c, n in zip(z, "hda", strict=True)), own.alias("own"), "result")
    rows = checkpointed(rows)
    n, kinds = rows.agg(F.count("*"), F.count_distinct("result")).first()
    if n < LEAST_ROWS or kinds < 2:
        return None
    top = F.greatest("h", "d", "a")

    def losses(ts: list[float]) -> list[float]:
        return list(rows.agg(*(F.avg(F.ln(sum((F.exp((F.col(c) - top) / t) for c in "da"), F.exp((F.col("h") - top) / t))) + (top - F.col("own")) / t).alias(f"t{i}") for i, t in enumerate(ts))).first())

    low, high = bounds
    best = (losses([1.0])[0], 1.0)
    for _ in range(rounds):
        ts = np.geomspace(low, high, points).tolist()
        got = losses(ts)
        i = int(np.argmin(got))
        if got[i] < best[0]:
            best = got[i], ts[i]
        low, high = ts[max(0, i - 1)], ts[min(points - 1, i + 1)]
    return best[1]


def baseline(rows: DataFrame, folds: int = 5) -> DataFrame:
    """fold, trained_on, n, log_loss, brier of the shares of the classes in what each fold learns from."""
    by = rows.where("result in ('H', 'D', 'A')").groupBy("segment").agg(F.count("*").alias("n"), *(F.count_if(F.col("result") == c).alias(c) for c in CLASSES))
    fold = rows.sparkSession.range(1, folds + 1).select(F.col("id").alias("fold"))
    before = fold.join(by, F.col("segment") < F.col("fold")).groupBy("fold").agg(F.sum("n").alias("trained_on"), *((F.sum(c) / F.sum("n")).alias(f"p{c}") for c in CLASSES))
    x = before.join(by, F.col("segment") == F.col("fold"))
    share = {c: F.col(c) / F.col("n") for c in CLASSES}
    loss = sum(share[c] * scoring.log_loss(F.col(f"p{c}")) for c in CLASSES)
    brier = sum(share[c] * sum(F.pow(F.col(f"p{k}") - F.lit(float(k == c)), F.lit(2.0)) for k in CLASSES) for c in CLASSES)
    return x.select("fold", "trained_on", "n", loss.alias("log_loss"), brier.alias("brier"))
