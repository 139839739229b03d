"""Streams against the same figures of the whole table, for several ways to cut them into micro-batches."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from matchforge.plans import model_queries
from matchforge.sources import bridge
from matchforge.streaming import late, periods, running

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def cut(df, folder, order, sizes):
    """Writes the rows in order, one folder a micro-batch."""
    rows = df.orderBy(*order).collect()
    at = 0
    for k, n in enumerate(sizes):
        part = rows[at : at + n] if n else rows[at:]
        at += len(part)
        if part:
            df.sparkSession.createDataFrame(part, df.schema).coalesce(1).write.parquet(f"{folder}/{k:03d}")


def run(stream, name, mode, state, sink=None):
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    q = (w.format("memory").queryName(name) if sink is None else w.foreachBatch(sink)).start()
    q.awaitTermination(240)
    assert q.exception() is None


def reader(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


@pytest.mark.parametrize("sizes", [[0], [1, 300, 7, 0], [500, 500, 0]])
def test_running_figures(rocks, sf, tmp_path, sizes):
    spark = rocks
    calls = bridge.provider_calls(spark, sf).withColumn("called_at", F.col("called_at").cast("timestamp"))
    cut(calls, str(tmp_path / "in"), ["called_at", "event_id"], sizes)
    seen = {}
    run(running.running_stream(reader(spark, calls.schema, str(tmp_path / "in"))), "f", "update", str(tmp_path / "s"), lambda df, k: seen.update({r["provider"]: r for r in df.collect()}))
    want = {r["provider"]: r for r in running.running_table(calls).collect()}
    assert set(seen) == set(want)
    for p, w in want.items():
        for c in ("calls", "errors", "consecutive_failures", "last_call", "last_success", "last_failure"):
            assert seen[p][c] == w[c], (p, c)
        assert seen[p]["latency_ms"] == pytest.approx(w["latency_ms"])


def test_running_figures_after_a_restart(rocks, sf, tmp_path):
    spark = rocks
    calls = bridge.provider_calls(spark, sf).withColumn("called_at", F.col("called_at").cast("timestamp"))
    rows = calls.orderBy("called_at", "event_id").collect()
    seen = {}
    for k, part in enumerate((rows[:400], rows[400:])):
        spark.createDataFrame(part, calls.schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
        # The same state folder: the second run goes on where the first ended.
        run(running.running_stream(reader(spark, calls.schema, str(tmp_path / "in"))), "g", "update", str(tmp_path / "s"), lambda df, k: seen.update({r["provider"]: r["calls"] for r in df.collect()}))
    assert seen == {r["provider"]: r["calls"] for r in running.running_table(calls).collect()}


@pytest.mark.parametrize("sizes", [[0], [33, 200, 1, 0]])
def test_volume_triggers(rocks, sf, tmp_path, sizes):
    spark = rocks
    m = bridge.matches(spark, sf).select("league", "day", "match_id")
    cut(m, str(tmp_path / "in"), ["day", "match_id"], sizes)
    name = f"v{len(sizes)}"
    run(running.trigger_stream(reader(spark, m.schema, str(tmp_path / "in")), 50), name, "append", str(tmp_path / "s"))
    got = sorted(map(tuple, spark.table(name).collect()))
    assert got == sorted(map(tuple, running.trigger_table(m, 50).collect())) and len(got) > 10


def test_late_results(spark, sf, tmp_path):
    fixtures, results = model_queries._kickoffs(spark, sf), model_queries._results(spark, sf)
    n = fixtures.count()
    cut(fixtures, str(tmp_path / "f"), ["kickoff", "fixture_id"], [n // 3, n // 3, 0])
    cut(results, str(tmp_path / "r"), ["reported_at", "home", "away", "kickoff"], [n // 3, n // 3, n // 3, 0])
    f, r = (reader(spark, df.schema, str(tmp_path / x)) for df, x in ((fixtures, "f"), (results, "r")))
    run(late.matched(f, r), "matched", "append", str(tmp_path / "s"))
    got = sorted(map(tuple, spark.table("matched").collect()))
    want = sorted(map(tuple, late.matched(fixtures, results).collect()))
    assert got == want and 0 < len(want) < n
    run(late.late_counts(reader(spark, results.schema, str(tmp_path / "r"))), "too_late", "complete", str(tmp_path / "s2"))
    counts = sorted(map(tuple, spark.table("too_late").collect()))
    assert counts == sorted(map(tuple, late.late_counts(results).collect())) and sum(c for _, c in counts) > 0


def test_periods_leave_today_out():
    assert periods.window_for("daily", date(2024, 3, 10)) == (date(2024, 3, 9), date(2024, 3, 9))
    assert periods.window_for("weekly", date(2024, 3, 10)) == (date(2024, 3, 3), date(2024, 3, 9))
    assert periods.window_for("yearly", date(2024, 3, 10)) is None


def test_closed_periods_are_written_once(spark, tmp_path):
    first = date(2024, 1, 1)
    rows = [(first + timedelta(days=k // 5), "HDA"[k % 3], *(0.5, 0.3, 0.2), *((0.2, 0.3, 0.5) if k % 4 else (None, None, None))) for k in range(100)]
    df = spark.createDataFrame(rows, "day date, result string, " + ", ".join(f"{e}_{s} double" for e in ("p", "q") for s in ("home", "draw", "away")))
    store, out = str(tmp_path / "rows"), str(tmp_path / "reports")
    write = periods.report_closed_periods(store, out)
    batches = [rows[:32], rows[32:33], rows[33:80], rows[80:]]
    for k, part in enumerate(batches):
        batch = spark.createDataFrame(part, df.schema)
        write(batch, k)
        write(batch, k)  # a batch may come again
    got = spark.read.parquet(out)
    assert got.count() == got.select("cadence", "period_end").distinct().count()
    tidy = lambda x: sorted(map(str, x.select("cadence", "period_end", "n", "n_common", "p_n", "q_n", F.round("p_log_loss", 9), F.round("q_brier", 9)).collect()))
    assert tidy(got) == tidy(periods.reports(df)) and got.count() > 30
    assert got.agg(F.max("period_end")).first()[0] == rows[-1][0] - timedelta(days=1)
