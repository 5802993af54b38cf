from collections import Counter

from helpers import SF
from pyspark.sql import functions as F

from loomspark.session import read_table
from loomspark.streaming import events as E


def streamed(spark, df, tmp_path, build):
    """Rows of a query over df as a stream, in order of time so that none is late."""
    path = str(tmp_path / "in")
    df.coalesce(1).sortWithinPartitions("ts").write.parquet(path)
    out = build(spark.readStream.schema(df.schema).parquet(path))
    q = out.writeStream.format("memory").queryName("out").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    return Counter(map(tuple, spark.table("out").collect()))


def test_windows_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    ev = read_table(spark, SF, "events").limit(2000)
    got = streamed(spark, ev, tmp_path, lambda e: E.tumbling(e, "1 hour"))
    want = Counter(map(tuple, E.tumbling(ev, "1 hour").collect()))
    assert got and not got - want
    assert sum(want.values()) - sum(got.values()) <= 2 * ev.select("event_type").distinct().count()  # windows still open


def test_stream_dedup(spark, tmp_path):
    ev = read_table(spark, SF, "events").limit(500)
    got = streamed(spark, ev.unionAll(ev), tmp_path, E.distinct_events)
    assert got == Counter(map(tuple, ev.select("event_id", "event_type", "value").collect()))
