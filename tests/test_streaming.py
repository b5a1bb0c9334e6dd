"""Streams over the driver's events, run to their end, against the same frames in batch."""

import pytest
from pyspark.sql import functions as F

from odweave.streaming import events as s

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "in")
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    df.orderBy("ts").repartitionByRange(3, "ts").write.parquet(path)
    return path


def finished(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_windowed_counts(spark, folder):
    got = finished(s.windowed_counts(s.read_events(spark, folder, SCHEMA), ["event_type"], "ts", "1 day", value="value"), "counts", "complete")
    want = s.windowed_counts(spark.read.schema(SCHEMA).parquet(folder), ["event_type"], "ts", "1 day", value="value")
    key = lambda df: sorted((r.start, r.event_type, r.n, round(r.value, 6)) for r in df.collect())
    assert key(got) == key(want)


def test_sessions_in_batch(spark, folder):
    df = s.sessions(spark.read.schema(SCHEMA).parquet(folder), ["user_id"], "ts", "1 hour")
    assert df.agg(F.sum("n")).first()[0] == spark.read.parquet(folder).count()


def test_moves(spark, folder):
    got = finished(s.moves(s.read_events(spark, folder, SCHEMA, max_files=100), "user_id", "event_type", "ts"), "moves")
    rows = sorted((r.user_id, r.ts, r.event_type) for r in spark.read.parquet(folder).collect())
    want = [(a[0], a[2], b[2], b[1]) for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0] and a[2] != b[2]]
    assert sorted((r.user_id, r.from_id, r.to_id, r.at) for r in got.collect()) == sorted(want)
