"""State machines over event logs, by composition of transition maps."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workers import ship

# What a challenger may become from each state; the last two end it.
CHALLENGER = {
    "CREATED": ("WAITING", "REJECTED"),
    "WAITING": ("EVALUATING", "REJECTED"),
    "EVALUATING": ("SUCCEEDED", "REJECTED"),
    "SUCCEEDED": ("PROMOTED", "REJECTED"),
    "PROMOTED": (),
    "REJECTED": (),
}


class Run:
    """What a stretch of an entity's log does to each state: where it leads, how many steps were refused, and the first of them."""

    def __init__(self, states: list[str]):
        self.end = list(range(len(states)))
        self.refused = [0] * len(states)
        self.first: list[tuple | None] = [None] * len(states)
        self.steps = 0

    def step(self, target: int | None, allowed: list[set[int]], key: tuple) -> None:
        self.steps += 1
        for s, now in enumerate(self.end):
            if target in allowed[now]:
                self.end[s] = target
            else:
                self.refused[s] += 1
                if self.first[s] is None:
                    self.first[s] = (*key, now)


def replay(events: DataFrame, machine: Mapping[str, tuple[str, ...]], start: str, entity: str, at: str, tie: str, target: str, parts: int | None = None) -> DataFrame:
    """entity, steps, refused, state at the end, and the first refused step: refused_at, refused_tie, refused_from.

    A step that the machine does not allow changes nothing and counts as refused; so does an
    unknown or null target. The log is dealt out by ranges of (entity, at, tie), so the log
    of an entity of any length spreads over tasks. Each task sums up its stretch as a map from
    states to states; the maps of an entity, one a task, are then composed in order.
    """
    ship(events.sparkSession)
    states = list(machine)
    number = {s: k for k, s in enumerate(states)}
    allowed = [{number[t] for t in machine[s]} for s in states]
    parts = parts or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = events.select(F.col(entity).cast("string").alias("entity"), F.col(at).cast("timestamp").alias("at"), F.col(tie).cast("long").alias("tie"), F.col(target).alias("target"))
    # A row's own order within its part; times travel as microseconds.
    rows = rows.withColumn("at", F.unix_micros("at"))
    dealt = rows.repartitionByRange(parts, "entity", "at", "tie").sortWithinPartitions("entity", "at", "tie")
    names = ["entity", "part", "place", "steps", "end", "refused", "first_at", "first_tie", "first_from"]

    def sums(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Kept over batches: a stretch that goes on in the next batch is one run.
        part, place, name, run = TaskContext.get().partitionId(), 0, None, None

        def close() -> tuple:
            pick = lambda k: [None if f is None else f[k] for f in run.first]
            return name[0], part, place, run.steps, run.end, run.refused, pick(0), pick(1), pick(2)

        for b in batches:
            out = []
            for e, t, i, to in zip(b["entity"], b["at"], b["tie"], b["target"], strict=True):
                e = None if pd.isna(e) else e
                if run is None or name != (e,):
                    if run is not None:
                        out.append(close())
                        place += 1
                    name, run = (e,), Run(states)
                run.step(number.get(to), allowed, (None if pd.isna(t) else int(t), None if pd.isna(i) else int(i)))
            yield pd.DataFrame(out, columns=names)
        if run is not None:
            yield pd.DataFrame([close()], columns=names)

    runs = dealt.mapInPandas(sums, "entity string, part int, place int, steps long, end array<int>, refused array<long>, first_at array<long>, first_tie array<long>, first_from array<int>")
    ordered = runs.groupBy("entity").agg(F.sum("steps").alias("steps"), F.array_sort(F.collect_list(F.struct("part", "place", "end", "refused", "first_at", "first_tie", "first_from"))).alias("runs"))
    none = lambda t: F.lit(None).cast(t)
    begin = F.struct(F.lit(number[start]).alias("s"), F.lit(0).cast("long").alias("n"), none("long").alias("at"), none("long").alias("tie"), none("int").alias("was"))

    def compose(left: Column, run: Column) -> Column:
        of = lambda c: F.get(run[c], left["s"])
        first = left["was"].isNull()
        keep = lambda c, mine: F.when(first, of(c)).otherwise(left[mine])
        return F.struct(of("end").alias("s"), (left["n"] + of("refused")).alias("n"), keep("first_at", "at").alias("at"), keep("first_tie", "tie").alias("tie"), keep("first_from", "was").alias("was"))

    done = ordered.withColumn("x", F.aggregate("runs", begin, compose))
    named = F.array(*map(F.lit, states))
    return done.select("entity", "steps", F.col("x.n").alias("refused"), F.get(named, F.col("x.s")).alias("state"), F.timestamp_micros("x.at").cast("timestamp_ntz").alias("refused_at"), F.col("x.tie").alias("refused_tie"), F.get(named, F.col("x.was")).alias("refused_from"))
