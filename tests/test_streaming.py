"""The stream's windows against the same windows over the whole table."""

from pyspark.sql import functions as F

from matchforge.sources import bridge
from matchforge.streaming.health import windowed_health


def test_stream_equals_table(spark, sf, tmp_path):
    calls = bridge.provider_calls(spark, sf)
    for k, part in enumerate(calls.orderBy("called_at").randomSplit([0.5, 0.5], 3)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = windowed_health(stream).writeStream.format("memory").queryName("health").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    tidy = lambda df: sorted(map(tuple, df.select("since", "provider", "calls", "errors", F.round("latency_ms", 6)).collect()), key=str)
    got = tidy(spark.table("health"))
    assert got == tidy(windowed_health(calls)) and len(got) > 100
