from pyspark.sql import functions as F

from flickerlake.streaming import frames as S

SCHEMA = "ts timestamp, x long, y long, t long, seq long, v8 long"


def stream(spark, path, rows):
    df = spark.createDataFrame(rows, "t long, x long, y long, seq long, v8 long")
    df = df.select(F.timestamp_seconds("t").alias("ts"), "x", "y", "t", "seq", "v8")
    for k in range(2):
        df.where(F.col("seq") % 2 == k if k else F.col("seq") % 2 == 0).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def run(df, name, spark, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_frames_leave_when_the_watermark_passes(spark, tmp_path):
    rows = [(k * 3600, k % 3, 0, k, 5) for k in range(24 * 6)]
    got = run(S.frame_counts(stream(spark, str(tmp_path / "e"), rows)), "frame_counts", spark, tmp_path)
    assert got and all(r.n == 24 and r.pixels == 3 for r in got) and len(got) < 6


def test_pixels_are_counted_exactly(spark, tmp_path):
    rows = [(k * 5, k % 12_347, k % 3, k, 5) for k in range(17_280 * 5)]
    got = run(S.frame_counts(stream(spark, str(tmp_path / "e"), rows)), "exact_counts", spark, tmp_path)
    expected = {}
    for t, x, y, _, _ in rows:
        expected.setdefault(t // 86_400, set()).add((x, y))
    assert got and all(r.n == 17_280 and r.pixels == len(expected[int(r.start.timestamp()) // 86_400]) for r in got)


def test_fold_keeps_state_between_batches(spark, tmp_path):
    from flickerlake.operators import folds

    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(k, k % 2, 0, k, (k * 37) % 256) for k in range(60)]
    try:
        got = run(S.send_on_delta(stream(spark, str(tmp_path / "e"), rows), 60), "sent", spark, tmp_path)
    finally:
        spark.conf.unset(key)
    # the files arrive one after the other: even numbers, then odd ones, and pixels are the same split
    df = spark.createDataFrame([(x, y, t, k, v) for t, x, y, k, v in rows], "x long, y long, t long, seq long, v8 long")
    expected = {(r.x, r.y, r.seq, r.base) for r in folds.send_on_delta(df, 60).collect()}
    assert {(r.x, r.y, r.seq, r.base) for r in got} == expected


def rocks(spark, f):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return f()
    finally:
        spark.conf.unset(key)


def batches(spark, path, parts):
    """A stream of the given batches of (t, x, y, seq, v8)."""
    import time

    for k, rows in enumerate(parts):
        df = spark.createDataFrame(rows, "t long, x long, y long, seq long, v8 long").select(F.timestamp_seconds("t").alias("ts"), "x", "y", "t", "seq", "v8")
        df.coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.01)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_frames_complete_or_are_forced_out(spark, tmp_path):
    # frame 0 completes over two batches, frame 1 never does, later events move the watermark past its wait
    parts = [[(1, 0, 0, 0, 10), (2, 1, 0, 1, 11), (3, 0, 0, 2, 12)], [(4, 0, 1, 3, 13), (5, 1, 1, 4, 14), (12, 0, 0, 5, 20)], [(40, 1, 1, 6, 9)], [(41, 1, 1, 7, 9)]]
    got = rocks(spark, lambda: run(S.frames(batches(spark, str(tmp_path / "e"), parts), 4, 10, 5), "whole_frames", spark, tmp_path))
    rows = {(r.frame, r.x, r.y, r.v, r.complete) for r in got}
    assert {r for r in rows if r[0] == 0} == {(0, 0, 0, 12, True), (0, 1, 0, 11, True), (0, 0, 1, 13, True), (0, 1, 1, 14, True)}
    assert {r for r in rows if r[0] == 1} == {(1, 0, 0, 20, False)}


def test_silent_pixels_are_held(spark, tmp_path):
    parts = [[(1, 0, 0, 0, 10), (2, 1, 0, 1, 11)], [(8, 1, 0, 2, 12)], [(14, 2, 0, 3, 1)], [(15, 2, 0, 4, 1)]]
    got = rocks(spark, lambda: run(S.held_pixels(batches(spark, str(tmp_path / "e"), parts), 10), "held", spark, tmp_path))
    assert {(r.x, r.y, r.t, r.v) for r in got} == {(0, 0, 11, 10)}


def test_units_are_closed_on_the_right(spark, tmp_path):
    parts = [[(0, 0, 0, 0, 1), (10, 0, 0, 1, 1), (11, 0, 0, 2, 1)], [(20, 0, 0, 3, 1), (21, 0, 0, 4, 1)], [(60, 0, 0, 5, 1)]]
    got = run(S.unit_counts(batches(spark, str(tmp_path / "e"), parts), 10), "units", spark, tmp_path)
    assert {(r.adu, r.n) for r in got} >= {(0, 2), (1, 2), (2, 1)}


def test_rate_drop_over_a_stream(spark, tmp_path):
    from flickerlake.operators import folds

    rows = [(k * k % 97 + k, k % 2, 0, k, 5) for k in range(60)]
    rows.sort()
    got = rocks(spark, lambda: run(S.rate_drop(batches(spark, str(tmp_path / "e"), [rows[:30], rows[30:]]), 0.9, 0.05), "dropped", spark, tmp_path))
    df = spark.createDataFrame([(x, y, t, k) for t, x, y, k, _ in rows], "x long, y long, t long, seq long")
    assert {(r.x, r.seq, round(r.rate, 12)) for r in got} == {(r.x, r.seq, round(r.rate, 12)) for r in folds.rate_drop(df, 0.9, 0.05).collect()}
