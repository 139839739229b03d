"""Resampling row by row: every row meets every replicate in numpy, and only sums by group and replicate leave a task."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..workers import ship

# Odd multipliers of the mixer, each below 2**31 so that no product passes 62 bits, and the most a Poisson number is asked for.
MIX, MASK, MOST = (1103515245, 1540483477, 1274126177, 2027808485), 2**31 - 1, 12
# Places of a block that stay in the processor's cache, sums by replicate that a task holds at once, how many bounds are compared everywhere, and tasks for each core.
BLOCK, HELD, DENSE, SLICES = 2**16, 2**19, 4, 4


def poisson_bounds(most: int = MOST) -> list[float]:
    """A Poisson number of mean 1 is above k where a uniform one reaches bound k."""
    return [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(most)]


class Draws:
    """Weights and signs of a block of rows, the same as of ``gates.mixed_uniform`` and ``gates.poisson_one``.

    A number of 31 bits is held in the upper bits of 32, so that a product loses what is above 31 bits by itself.
    Bounds of the uniform number become bounds of these whole numbers; a lowest bit that a last shift leaves does
    not matter to them, as all of them are even.
    """

    def __init__(self, replicates: int):
        self.replicates, self.rows = replicates, max(1, BLOCK // replicates)
        self.steps = (((np.arange(replicates, dtype=np.int64) * MIX[0]) & MASK) << 1).astype(np.uint32)
        self.mix, self.shifts, self.even = *(np.array(v, np.uint32) for v in (MIX, (15, 13, 16))), np.array(2**32 - 2, np.uint32)
        self.bounds = np.array([2 * b for b in (math.ceil(x * 2.0**31) for x in poisson_bounds()) if b <= MASK], np.uint32)
        self.z, self.moved = np.empty((2, self.rows, replicates), np.uint32)
        self.over, self.weight = np.empty((2, self.rows, replicates), np.uint8)

    def block(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights, and whether the sign is turned, of at most ``rows`` rows by replicate. The next call writes over both."""
        n = len(one)
        z, moved, over, weight = self.z[:n], self.moved[:n], self.over[:n], self.weight[:n]
        np.bitwise_xor(one[:, None], self.steps, out=z)
        np.multiply(z, self.mix[1], out=z)
        for shift, mix, other in ((self.shifts[0], self.mix[2], two[:, None]), (self.shifts[1], self.mix[3], None)):
            np.right_shift(z, shift, out=moved)
            np.bitwise_and(moved, self.even, out=moved)
            np.bitwise_xor(z, moved, out=z)
            if other is not None:
                np.bitwise_xor(z, other, out=z)
            np.multiply(z, mix, out=z)
        np.right_shift(z, self.shifts[2], out=moved)
        np.bitwise_xor(z, moved, out=z)
        above = over.view(bool)
        np.greater_equal(z, self.bounds[0], out=weight.view(bool))
        for b in self.bounds[1:DENSE]:
            np.greater_equal(z, b, out=above)
            np.add(weight, over, out=weight)
        # Higher weights are so rare that their places are looked up one by one.
        np.greater_equal(z, self.bounds[DENSE], out=above)
        at = np.flatnonzero(above)
        weight.reshape(-1)[at] = np.searchsorted(self.bounds, z.reshape(-1)[at], side="right")
        np.greater_equal(z, np.uint32(2**31), out=above)
        return weight, over


class Sums:
    """What a group's rows add up to: n and d of each difference by weight and by turned sign, and without either."""

    def __init__(self, k: int, replicates: int):
        self.by, self.total, self.odd = np.zeros((2 * k, 2 * replicates)), np.zeros(2 * k), None

    def add(self, values: np.ndarray, both: np.ndarray) -> None:
        """``values``: n, then d of each difference. ``both``: weights, then whether the sign is turned, by replicate."""
        k, r = values.shape[1] // 2, both.shape[1] // 2
        known = np.isfinite(values)
        if not known.all():
            # Zero times infinity would be unknown where a sign keeps it infinite, so such rows are added up by themselves.
            if self.odd is None:
                self.odd = np.zeros((3, k, r))
            with np.errstate(invalid="ignore"):
                for i, j in zip(*np.nonzero(~known), strict=True):
                    d = np.full(r, values[i, j])
                    self.odd[:, j - k] += np.stack([d, both[i, :r] * d, np.where(both[i, r:], -d, d)])
            values = np.where(known, values, 0.0)
        self.by += values.T @ both
        self.total += values.sum(0)

    def figures(self) -> Iterator[np.ndarray]:
        """n, d, wn, wd, f by replicate, of each difference."""
        k, r = len(self.total) // 2, self.by.shape[1] // 2
        for j in range(k):
            n, d, odd = self.total[j], self.total[k + j], np.zeros((3, r)) if self.odd is None else self.odd[:, j]
            # What is turned counts twice against the plain sum: with none turned both are equal to the last bit.
            yield from (np.full(r, int(n)), d + odd[0], self.by[j, :r], self.by[k + j, :r] + odd[1], d - 2.0 * self.by[k + j, r:] + odd[2])


def _sums(replicates: int, k: int):
    """For mapInArrow: (group, one, two, n and d of each difference) to (group, rep, n, d, n and d by weights, d by signs)."""
    names = ["group", "rep", *_figures(k)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws, held, kind = Draws(replicates), {}, None
        reps, both = pa.array(np.arange(replicates)), np.empty((draws.rows, 2 * replicates))

        def given() -> Iterator[pa.RecordBatch]:
            for key, sums in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([key] * replicates, kind), reps, *map(pa.array, sums.figures())], names=names)
            held.clear()

        for b in batches:
            kind = b.column(0).type
            groups = b.column(0).dictionary_encode(null_encoding="encode")
            keys, code = groups.dictionary.to_pylist(), groups.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            ends = np.searchsorted(code[order], np.arange(len(keys) + 1))
            one, two = ((b.column(c).to_numpy() << 1).astype(np.uint32)[order] for c in (1, 2))
            values = np.column_stack([b.column(3 + 2 * j + c).to_numpy() for c in (0, 1) for j in range(k)])[order]
            for g, key in enumerate(keys):
                if key not in held and (len(held) + 1) * replicates * k > HELD:
                    yield from given()
                sums = held.setdefault(key, Sums(k, replicates))
                for start in range(ends[g], ends[g + 1], draws.rows):
                    at = slice(start, min(start + draws.rows, ends[g + 1]))
                    drawn = both[: at.stop - at.start]
                    drawn[:, :replicates], drawn[:, replicates:] = draws.block(one[at], two[at])
                    sums.add(values[at], drawn)
        yield from given()

    return run


def _figures(k: int) -> list[str]:
    return [f"{c}{j}" for j in range(k) for c in ("n", "d", "wn", "wd", "f")]


def draw_rows(rows: DataFrame, group: str, k: int, replicates: int) -> DataFrame:
    """group, rep, and n, d, wn, wd, f of each of ``k`` differences, added up in each task.

    ``rows``: group, one, two (words of 31 bits), then n (0 or 1) and d of each difference. A task gives one row for each of
    its groups and replicates, however many rows it has; with very many groups it gives some of them more than once.
    """
    spark = rows.sparkSession
    ship(spark)
    # Dealt out anew: the work is in the replicates, of which the sizes that partitions are merged by know nothing.
    dealt = rows.repartition(SLICES * spark.sparkContext.defaultParallelism, "one", "two")
    figures = [StructField(c, LongType() if c[0] == "n" else DoubleType()) for c in _figures(k)]
    out = dealt.mapInArrow(_sums(replicates, k), StructType([StructField("group", rows.schema[group].dataType), StructField("rep", LongType()), *figures]))
    return out.withColumnRenamed("group", group)
