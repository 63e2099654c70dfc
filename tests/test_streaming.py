import shutil

from rankloom.streaming import replay


def test_windows_are_counted_once(spark, sf_dir, tmp_path):
    shutil.copy(f"{sf_dir}/events.parquet", tmp_path / "events.parquet")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    counts = replay.windowed_counts(replay.read_events(spark, str(tmp_path)))
    for _ in range(2):  # a restart adds nothing
        replay.start(counts, out, state).awaitTermination()
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(out).collect()}
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch = batch.withColumn("ts", batch["ts"].cast("timestamp"))
    want = {(r.start, r.event_type): r.n for r in replay.windowed_counts(batch).collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(want) - len(got) <= 10
