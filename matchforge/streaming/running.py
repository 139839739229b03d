"""Running figures kept as state of a stream, a row a key, and the same figures of a table."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..workers import ship

FIGURES = "provider string, calls long, errors long, latency_ms double, consecutive_failures long, last_call timestamp, last_success timestamp, last_failure timestamp"
#: What a task has seen of a provider in a micro-batch: sums, and the failures after its last success one by one.
PARTIAL = "provider string, calls long, errors long, latency double, last_call timestamp, good_at timestamp, good_id long, bad_at timestamp, failed_at array<timestamp>, failed_id array<long>"
_STATE = "calls long, errors long, latency double, failures long, last_call timestamp, good_at timestamp, good_id long, bad_at timestamp"


def _latest(*times):
    known = [t for t in times if not pd.isna(t)]
    return max(known) if known else None


def _partial(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: dict[str, dict] = {}
    for b in batches:
        for provider, part in b.groupby("provider", dropna=False):
            provider = None if pd.isna(provider) else provider
            s = seen.setdefault(provider, {"calls": 0, "errors": 0, "latency": 0.0, "last": None, "good": None, "bad": None, "failed": []})
            good = part[part["success"].fillna(False).astype(bool)]
            bad = part.drop(good.index)
            s["calls"] += len(part)
            s["errors"] += len(bad)
            s["latency"] += float(part["latency_ms"].fillna(0.0).sum())
            s["last"] = _latest(s["last"], part["called_at"].max())
            s["bad"] = _latest(s["bad"], bad["called_at"].max())
            if len(good):
                s["good"] = max([(t, i) for t, i in zip(good["called_at"], good["event_id"], strict=True)] + [s["good"]] * (s["good"] is not None))
            s["failed"] = [k for k in [*s["failed"], *zip(bad["called_at"], bad["event_id"], strict=True)] if s["good"] is None or k > s["good"]]
    rows = [(p, s["calls"], s["errors"], s["latency"], s["last"], *(s["good"] or (None, None)), s["bad"], [t for t, _ in s["failed"]], [i for _, i in s["failed"]]) for p, s in seen.items()]
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARTIAL.split(", ")])


class RunningFigures(StatefulProcessor):
    """State: one row a provider. A micro-batch comes as a few partial sums, so a busy provider is no hot task."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("figures", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = pd.concat(list(rows))
        calls, errors, latency, failures, last, good_at, good_id, bad_at = self.state.get() if self.state.exists() else (0, 0, 0.0, 0, None, None, None, None)
        wins = [(t, i) for t, i in zip(parts["good_at"], parts["good_id"], strict=True) if not pd.isna(t)]
        if wins and (good_at is None or max(wins) > (pd.Timestamp(good_at), good_id)):
            # Batches come in order of time, so a success of this one ends the streak before it.
            failures, (good_at, good_id) = 0, max(wins)
        failed = [(t, i) for ts, ids in zip(parts["failed_at"], parts["failed_id"], strict=True) for t, i in zip(ts, ids, strict=True)]
        failures += sum(good_at is None or (pd.Timestamp(t), i) > (pd.Timestamp(good_at), good_id) for t, i in failed)
        calls, errors, latency = calls + int(parts["calls"].sum()), errors + int(parts["errors"].sum()), latency + float(parts["latency"].sum())
        last, bad_at = _latest(last, parts["last_call"].max()), _latest(bad_at, parts["bad_at"].max())
        plain = lambda t: None if t is None or pd.isna(t) else pd.Timestamp(t).to_pydatetime()
        self.state.update((calls, errors, latency, failures, plain(last), plain(good_at), None if good_id is None else int(good_id), plain(bad_at)))
        yield pd.DataFrame({"provider": [key[0]], "calls": [calls], "errors": [errors], "latency_ms": [latency / calls], "consecutive_failures": [failures], "last_call": [last], "last_success": [good_at], "last_failure": [bad_at]})

    def close(self) -> None:
        pass


def running_stream(calls: DataFrame) -> DataFrame:
    """The figures of each provider after each micro-batch that has calls of it (update mode).

    ``calls``: provider, event_id, called_at, success (null counts as a failure), latency_ms (null
    counts as 0). Micro-batches come in order of (called_at, event_id); inside one, order does not
    matter. The session's state store must be RocksDB.
    """
    ship(calls.sparkSession)
    rows = calls.select(F.col("provider").cast("string").alias("provider"), F.col("event_id").cast("long").alias("event_id"), F.col("called_at").cast("timestamp").alias("called_at"), "success", "latency_ms")
    return rows.mapInPandas(_partial, PARTIAL).groupBy("provider").transformWithStateInPandas(statefulProcessor=RunningFigures(), outputStructType=FIGURES, outputMode="Update", timeMode="None")


def running_table(calls: DataFrame) -> DataFrame:
    """The same figures of a whole table, in two passes of sums: the last success, then what failed after it."""
    at = F.struct(F.col("called_at").alias("at"), F.col("event_id").alias("id"))
    good = F.coalesce(F.col("success"), F.lit(False))
    x = calls.select("provider", "event_id", F.col("called_at").cast("timestamp").alias("called_at"), good.alias("good"), F.coalesce("latency_ms", F.lit(0.0)).alias("latency_ms"))
    last = x.where("good").groupBy("provider").agg(F.max(at).alias("won"))
    joined = x.join(last.withColumnRenamed("provider", "p"), F.col("provider").eqNullSafe(F.col("p")), "left")
    streak = ~F.col("good") & (F.col("won").isNull() | (at > F.col("won")))
    out = joined.groupBy("provider").agg(F.count("*").alias("calls"), F.count_if(~F.col("good")).alias("errors"), F.avg("latency_ms").alias("latency_ms"), F.count_if(streak).alias("consecutive_failures"), F.max("called_at").alias("last_call"), F.max(F.when(F.col("good"), F.col("called_at"))).alias("last_success"), F.max(F.when(~F.col("good"), F.col("called_at"))).alias("last_failure"))
    return out


class VolumeTrigger(StatefulProcessor):
    """State: rows since the cursor. Every ``volume`` rows of a key one trigger leaves and the cursor moves to its row."""

    def __init__(self, volume: int):
        self.volume = volume

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("cursor", "since long, fired long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["day", "match_id"])
        since, fired = self.state.get() if self.state.exists() else (0, 0)
        at = range(self.volume - since - 1, len(batch), self.volume)
        hit = batch.iloc[list(at)]
        self.state.update(((since + len(batch)) % self.volume, fired + len(hit)))
        yield pd.DataFrame({"league": key[0], "number": range(fired + 1, fired + 1 + len(hit)), "match_id": hit["match_id"].to_numpy(), "day": hit["day"].to_numpy()}).astype({"league": object, "number": "int64", "match_id": "int64"})

    def close(self) -> None:
        pass


def trigger_stream(matches: DataFrame, volume: int) -> DataFrame:
    """league, number, match_id, day of each match that completes ``volume`` new ones of its league; micro-batches come in order of (day, match_id)."""
    ship(matches.sparkSession)
    rows = matches.select("league", F.col("day").cast("date").alias("day"), F.col("match_id").cast("long").alias("match_id"))
    return rows.groupBy("league").transformWithStateInPandas(statefulProcessor=VolumeTrigger(volume), outputStructType="league string, number long, match_id long, day date", outputMode="Append", timeMode="None")


def trigger_table(matches: DataFrame, volume: int) -> DataFrame:
    """The same triggers of a whole table. Days are counted first, so that a league's rows are numbered day by day and in no one task."""
    days = matches.groupBy("league", "day").agg(F.count("*").alias("n"))
    ahead = days.withColumn("ahead", F.sum("n").over(Window.partitionBy("league").orderBy("day")) - F.col("n")).withColumnsRenamed({"league": "l", "day": "d"})
    x = matches.join(ahead, F.col("league").eqNullSafe(F.col("l")) & (F.col("day") == F.col("d")))
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("league", "day").orderBy("match_id"))
    return x.withColumn("place", place).where(F.col("place") % volume == 0).select("league", (F.col("place") / volume).cast("long").alias("number"), "match_id", "day")
