import numpy as np
import pytest
from helpers import spoken
from pyspark.sql import functions as F

from sonoframe.plans import live
from sonoframe.plans.query_models import valid_document
from sonoframe.streaming import replay as R
from sonoframe.streaming import rolling as K
from sonoframe.streaming import verdicts as V


def run(stream, folder, spark):
    R.run_available(stream, f"{folder}/out", f"{folder}/state")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def frames(spark, rows):
    df = spark.createDataFrame(rows, "stream_id string, session_id string, ts_ms long, samples array<float>, is_end boolean")
    return df.withColumn("ts", F.timestamp_millis("ts_ms"))


def test_rolling_windows_emit_when_full_and_due(spark, tmp_path):
    body = [("a", "0", 250 * (i + 1), [float(i)] * 250, False) for i in range(6)]
    body += [("b", "0", 250 * (i + 1), [float(i)] * 250, False) for i in range(3)]
    ends = [(k, "0", 99_000, [], True) for k in "ab"]
    df = frames(spark, body)
    stream = R.as_stream(df, str(tmp_path / "in"), closing=frames(spark, ends))
    out = run(K.rolling_windows(stream, 1000, 500, delay=R.slice_delay(df)), tmp_path, spark).orderBy("ts_ms").collect()
    assert [(r["stream_id"], r["ts_ms"]) for r in out] == [("a", 1000), ("a", 1500)]
    assert len(out[0]["samples"]) == 1000 and out[1]["samples"][0] == 2.0 and out[1]["samples"][-1] == 5.0


def test_session_end_erases_state(spark, tmp_path):
    rows = [("a", "1", 100, [1.0, 1.0], False), ("a", "2", 200, [2.0, 2.0], False), ("a", "2", 300, [3.0], False)]
    df = frames(spark, rows)
    ends = frames(spark, [("a", s, 9_000, [], True) for s in "12"])
    out = run(K.rolling_windows(R.as_stream(df, str(tmp_path / "in"), closing=ends), 3, 1, delay=R.slice_delay(df)), tmp_path, spark).collect()
    assert [(r["session_id"], r["samples"]) for r in out] == [("2", [2.0, 2.0, 3.0])]
    current = spark.createDataFrame([("a", "2")], "stream_id string, session_id string")
    assert K.drop_stale_sessions(df, current).count() == 2


def test_stream_smoothing(spark, tmp_path):
    labels = ["happy", "angry", "angry", None, "sad", "angry"]
    rows = [("a", "0", 500 * (i + 1), v, False) for i, v in enumerate(labels)]
    schema = "stream_id string, session_id string, ts_ms long, candidate_emotion string, is_end boolean"
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis("ts_ms"))
    ends = spark.createDataFrame([("a", "0", 9_000, None, True)], schema).withColumn("ts", F.timestamp_millis("ts_ms"))
    out = run(K.smooth_stream(R.as_stream(df, str(tmp_path / "in"), closing=ends), delay=R.slice_delay(df)), tmp_path, spark)
    assert [r["smoothed"] for r in out.orderBy("ts_ms").collect()] == ["happy", "happy", "angry", None, "sad", "sad"]


def test_batch_updates_of_a_two_second_series(spark):
    df = spark.createDataFrame([("a", 16000, [0.1] * 32000)], "stream_id string, sample_rate int, samples array<float>")
    rows = live.series_updates(df).orderBy("ts_ms").collect()
    assert [r["ts_ms"] for r in rows] == [1500, 2000] and all(len(r["samples"]) == 24000 for r in rows)


def test_stream_replay_equals_batch_replay(spark, tmp_path):
    model = {**valid_document("full"), "quality_gates": {"min_activity_ratio": 0.2, "min_contiguous_active_frames": 3,
             "clipping_limit": 0.05, "minimum_snr_db": 5.0, "acceptable_snr_db": 10.0}, "rejection_threshold": 0.2}
    rng = np.random.default_rng(2)
    rows = [(f"s{i}", 16000, [float(v) for v in spoken(150 + 40 * i, 2.6, seed=i)]) for i in range(2)]
    rows += [("quiet", 16000, [0.0] * 40000), ("noise", 16000, [float(v) for v in rng.normal(0, 0.2, 40000)])]
    df = spark.createDataFrame(rows, "stream_id string, sample_rate int, samples array<float>")
    view = lambda d: sorted(
        (r["stream_id"], r["timestamp_ms"], r["emotion"], r["candidate_emotion"], r["rejection_reason"], round(r["confidence"], 9)) for r in d.collect())
    batch = view(R.replay_in_batch(df, model))
    assert batch == view(R.run_replay(df, model, str(tmp_path)))
    reasons = {r[0]: r[4] for r in batch if r[1] == 1500}
    assert reasons["quiet"] == "SILENCE" and reasons["noise"] == "UNCERTAIN_AUDIO_QUALITY" and reasons["s0"] is None


def test_result_sink_writes_json(spark, tmp_path):
    from sonoframe.sources.writers import write_results

    df = spark.createDataFrame([("a", 1, None), ("b", 2, "sad")], "stream_id string, ts_ms long, emotion string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    write_results(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r["stream_id"] for r in spark.read.json(str(tmp_path / "out")).collect()) == ["a", "b"]


@pytest.mark.parametrize("keys", [["k"]])
def test_latest_only_batches(spark, keys):
    seen = []
    K.latest_only(lambda d: seen.extend(d.collect()), keys, ["ts"])(spark.createDataFrame([("x", 1), ("x", 2)], "k string, ts int"), 0)
    assert [(r["ts"], r["replaced_count"]) for r in seen] == [(2, 1)]


def test_verdicts_join_updates_once(spark, tmp_path):
    """Newest of several, ties by id, missing keys, missing and late verdicts, and a restart from the checkpoint."""
    ms = lambda df: df.withColumn("ts", F.timestamp_millis("t")).drop("t")
    updates = lambda rows: ms(spark.createDataFrame(rows, "stream_id string, session_id string, t long, update_id long, note string"))
    verdicts = lambda rows: ms(spark.createDataFrame(rows, "stream_id string, session_id string, t long, verdict_id long, verdict_status string, verdict_confidence double"))
    updates([("a", "0", 1_000, 1, "x"), ("a", "0", 2_000, 2, "y"), (None, "0", 2_000, 3, None), ("b", "0", 2_000, 4, "z"), ("a", "1", 1_000, 5, "x"), ("c", "0", 9_000, 6, "x")]).write.parquet(str(tmp_path / "u"))
    verdicts([("a", "0", 1_000, 1, "OVERLAP", 0.1), ("a", "0", 1_000, 2, "TARGET_ACTIVE", 0.2), ("a", "0", 1_001, 3, "NON_TARGET", 0.3), (None, "0", 1_500, 4, "TARGET_ACTIVE", 0.4),
              ("b", "0", 2_001, 5, "OVERLAP", 0.5), ("c", "0", 9_000, 7, "TARGET_ACTIVE", 0.7)]).write.parquet(str(tmp_path / "v"))
    read = lambda name, df: spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    joined = V.join_verdicts(read("u", updates([])), read("v", verdicts([])), "1000 milliseconds", update_delay="1 second", verdict_delay="1 second")
    run(joined, tmp_path, spark)
    verdicts([("b", "0", 1_900, 8, "OVERLAP", 0.8)]).write.mode("append").parquet(str(tmp_path / "v"))  # long after its update is out
    updates([("end", "0", 99_000, 9, None)]).write.mode("append").parquet(str(tmp_path / "u"))
    verdicts([("end", "0", 99_000, 9, "OVERLAP", 0.9)]).write.mode("append").parquet(str(tmp_path / "v"))
    found = run(joined, tmp_path, spark).collect()
    assert sorted((r["update_id"], r["verdict_confidence"]) for r in found if r["update_id"] < 9) == [(1, 0.2), (2, 0.3), (3, 0.4), (4, None), (5, None), (6, 0.7)]
    assert {r["update_id"]: r["note"] for r in found}[2] == "y"


def test_micro_batches_do_not_grow_with_the_files(spark, tmp_path):
    df = spark.range(90).select("id", F.timestamp_millis(F.col("id") * 1000).alias("ts")).repartition(6)
    stream = R.as_stream(df, str(tmp_path / "in"), closing=df.limit(1))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) <= 4
    assert spark.read.parquet(str(tmp_path / "out")).count() == 91


def test_keys_of_one_bucket_are_folded_apart(spark, tmp_path):
    """Keys that share a state entry, a missing one among them; an end row, a silent key and a late row touch their own key only."""
    schema = "stream_id string, session_id string, ts_ms long, candidate_emotion string, is_end boolean"
    timed = lambda rows: spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis("ts_ms")).coalesce(1)
    batches = [
        [(k, "0", 1_000, v, False) for k, v in (("a", "x"), ("b", "y"), (None, "z"))] + [("a", "0", 9_000, "y", False)],
        [("b", "0", 9_000, "x", False), ("b", "0", 9_001, None, True), (None, "0", 2_000, "x", False), (None, "0", 9_500, "x", False), ("c", "0", 500, "late", False)],
        [("a", "0", 30_000, "y", False), ("b", "0", 30_000, "x", False), (None, "0", 30_000, "z", False)],
        [(k, "0", 60_000, None, True) for k in ("a", "b", None)]]
    for rows in batches:
        timed(rows).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(timed(rows).schema).parquet(str(tmp_path / "in"))
        out = run(K.smooth_stream(stream, delay="7 seconds", erase_after_ms=15_000, buckets=1), tmp_path, spark)
    found = {(r["stream_id"], r["ts_ms"]): r["smoothed"] for r in out.collect()}
    assert found == {("a", 1_000): "x", ("a", 9_000): "x", ("a", 30_000): "y", ("b", 1_000): "y", ("b", 9_000): "y", ("b", 30_000): "x",
                     (None, 1_000): "z", (None, 9_500): "z", (None, 30_000): "z"}


def test_verdict_join_meets_the_newest_verdict_alone(spark, tmp_path):
    """Many verdicts inside the horizon make no pairs: no stream-stream join, and carried values keep their types and microseconds."""
    at = lambda df: df.withColumn("ts", F.timestamp_micros("t")).drop("t")
    updates = at(spark.createDataFrame([("a", 1, 5_000_001, 0.1, [1.5, None], None), ("a", 1, 5_000_001, 0.1, [1.5, None], None), ("a", 2, 4_999_999, float("nan"), None, "é\"")], "k string, u long, t long, x double, l array<double>, s string"))
    verdicts = at(spark.createDataFrame([("a", i, 1_000 * i, f"v{i}", i / 7) for i in range(5_001)], "k string, v long, t long, verdict_status string, verdict_confidence double"))
    far = F.timestamp_micros(F.lit(10**12))
    for df, name in ((updates, "u"), (verdicts, "v")):
        df.unionByName(df.limit(1).withColumn("ts", far)).write.parquet(str(tmp_path / name))
    read = lambda name, df: spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    joined = V.join_verdicts(read("u", updates), read("v", verdicts), "10 seconds", keys=["k"], update_id="u", order="v")
    assert "StreamingSymmetricHashJoin" not in joined._jdf.queryExecution().toString() and "Join" not in joined._jdf.queryExecution().toString()
    rows = [r for r in run(joined, tmp_path, spark).collect() if r["ts"].year == 1970 and r["ts"].day == 1]
    assert sorted((r["u"], r["verdict_status"], r["verdict_confidence"], r["ts"].microsecond, r["l"], r["s"]) for r in rows) == [(1, "v5000", 5000 / 7, 1, [1.5, None], None), (2, "v4999", 4999 / 7, 999_999, None, 'é"')]


def test_a_bucket_is_one_entry_of_state(spark, tmp_path):
    """Rows reach the fold as slices of Arrow batches, with the whole state of their bucket beside them: no entries for held rows, values and timers."""
    rows = [(f"k{i % 50}", "0", 100 * i, [float(i)], False) for i in range(1, 3_001)]
    df = frames(spark, rows)
    ends = frames(spark, [(f"k{i}", "0", 999_000, [], True) for i in range(50)])
    windows = K.rolling_windows(R.as_stream(df, str(tmp_path / "in"), closing=ends), 4, 20_000, delay=R.slice_delay(df), buckets=3)
    assert "TransformWithState" not in windows._jdf.queryExecution().toString()
    query = windows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert max(held) == 3 and held[-1] == 0
    want = {(f"k{k}", t, (t / 100 - 150, t / 100 - 100, t / 100 - 50, t / 100)) for k in range(50) for t in range(15_000 + 100 * (k or 50), 300_001, 20_000)}
    out = [(r["stream_id"], r["ts_ms"], tuple(r["samples"])) for r in spark.read.schema(windows.schema).parquet(str(tmp_path / "out")).collect()]
    assert len(out) == len(want) and set(out) == want


def test_state_store_counts_no_rows(spark, tmp_path):
    """Windows are put and removed without a look-up for the number of rows; the session keeps its settings, and the rows equal the batch."""
    df = spark.createDataFrame([("ab"[i % 2], 1_000 * i, float(i)) for i in range(1, 60)], "stream_id string, t long, energy_rms double").withColumn("ts", F.timestamp_millis("t"))
    far = df.limit(1).withColumns({"ts": F.timestamp_millis(F.lit(9_000_000)), "stream_id": F.lit("end")})
    sliding = lambda d: K.sliding_activity(d, threshold=30.0, window="20 seconds", slide="10 seconds", delay="21 seconds")
    before = {name: spark.conf.get(name, None) for name in R.STATE_STORE}
    query = R.run_available(sliding(R.as_stream(df, str(tmp_path / "in"), closing=far)), str(tmp_path / "out"), str(tmp_path / "state"))
    seen = [p["stateOperators"][0] for p in query.recentProgress]
    assert sum(o["numRowsUpdated"] for o in seen) > 0 and {o["numRowsTotal"] for o in seen} == {0}
    assert before == {name: spark.conf.get(name, None) for name in R.STATE_STORE}
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).filter("stream_id <> 'end'").collect())) == sorted(map(tuple, sliding(df).collect()))
