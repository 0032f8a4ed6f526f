import datetime as dt
import random

from colloquy.streaming import events as live

KIND = "event_id long, ts timestamp, user_id long, event_type string, value double"


def rows(n=200):
    rng, at = random.Random(6), dt.datetime(2026, 1, 1)
    return [(i, at + dt.timedelta(seconds=30 * i), rng.randint(1, 4), rng.choice(["view", "click"]), float(i)) for i in range(n)]


def run(spark, tmp_path, build, mode="append"):
    """Feed the rows as several files, so that state crosses batches."""
    source = tmp_path / "in"
    everything = rows()
    for k in range(4):
        spark.createDataFrame(everything[50 * k : 50 * k + 50], KIND).coalesce(1).write.mode("append").parquet(str(source))
    stream = build(spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(source)))
    q = stream.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table("out").collect(), spark.createDataFrame(everything, KIND)


def test_streamed_transitions_equal_the_table(spark, tmp_path):
    got, table = run(spark, tmp_path, live.stream_transitions)
    want = live.transitions(table).collect()
    assert sorted(r.event_id for r in got) == sorted(r.event_id for r in want)


def test_streamed_windows_equal_the_table_once_closed(spark, tmp_path):
    got, table = run(spark, tmp_path, live.windowed_counts)
    want = {(r.start, r.event_type): r.n for r in live.windowed_counts(table).collect()}
    assert got and all(want[r.start, r.event_type] == r.n for r in got)


def test_sessions_close_after_the_gap(spark):
    at = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([(i, at + dt.timedelta(seconds=s), 1, "view", 0.0) for i, s in enumerate((0, 599, 1199, 5000))], KIND)
    assert sorted(r.n_events for r in live.sessions(df).collect()) == [1, 1, 2]
