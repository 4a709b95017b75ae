from datetime import date, datetime, timedelta

from tramline.streaming import alerts

SCHEMA = "ts timestamp, user_id long, event_type string"


def run(spark, folder, batches, make):
    """Rows that a stream over ``batches``, one file after another, has emitted at its end."""
    source = f"{folder}/in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        query = make(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
        assert query.awaitTermination(120)
    return spark.read.parquet(f"{folder}/out").collect()


def test_days_close_behind_the_watermark(spark, tmp_path):
    day = datetime(2024, 5, 1, 12)
    batches = [
        [(day, 1, "a"), (day + timedelta(hours=1), 2, "a"), (day, 3, "b")],
        [(day + timedelta(days=3), 1, "a")],
        [(day, 9, "a"), (day + timedelta(days=6), 1, "a")],  # the first is too late to count
    ]
    got = run(spark, tmp_path, batches, alerts.daily_counts)
    assert sorted(map(tuple, got)) == [(date(2024, 5, 1), "a", 2), (date(2024, 5, 1), "b", 1), (date(2024, 5, 4), "a", 1)]


def test_sessions_end_after_a_gap(spark, tmp_path):
    t = datetime(2024, 5, 1, 12)
    batches = [
        [(t, 1, "a"), (t + timedelta(minutes=20), 1, "b"), (t + timedelta(hours=2), 1, "a"), (t, 2, "a")],
        [(t + timedelta(days=4), 3, "a")],
        [(t + timedelta(days=8), 3, "a")],
    ]
    got = run(spark, tmp_path, batches, alerts.sessions)
    assert sorted((r.user_id, r.start, r.n) for r in got)[:3] == [(1, t, 2), (1, t + timedelta(hours=2), 1), (2, t, 1)]
