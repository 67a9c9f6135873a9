"""Rows that used to vanish or pass: NULL keys, gaps in source numbers, unknown quality."""

import pytest
from pyspark.sql import functions as F

from sonoframe.operators.history import keep_newest, rolling_summary, throttle
from sonoframe.operators import metrics, model, privacy
from sonoframe.operators.mixing import assign_round_robin, augment
from sonoframe.operators.model import accept_windows
from sonoframe.plans import live, query_events
from sonoframe.streaming import replay, rolling


def test_null_keys_stay(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, 2, 2.0), (5, 3, 3.0)], "k long, t long, v double")
    kept = keep_newest(df, "k", "t", 1).collect()
    assert {(r["k"], r["t"], r["dropped_count"]) for r in kept} == {(None, 2, 1), (5, 3, 0)}
    summary = rolling_summary(df, "k", "t", "v", 2).collect()
    assert {(r["k"], r["sample_count"], r["median"]) for r in summary} == {(None, 2, 1.5), (5, 1, 3.0)}


def test_gaps_in_source_numbers_fail(spark):
    rows = spark.range(10).withColumnRenamed("id", "row")
    sources = spark.createDataFrame([(0, "a"), (2, "b")], "source_idx int, name string")
    with pytest.raises(ValueError, match="source_idx"):
        assign_round_robin(rows, sources, "row")


def test_unknown_quality_is_rejected(spark):
    df = spark.createDataFrame([(None, 1.0), ("ACCEPTABLE", 1.0), ("LOW_QUALITY", 1.0)], "quality_status string, valid_frame_fraction double")
    assert [r["reason"] for r in accept_windows(df).collect()] == ["UNKNOWN_QUALITY", None, "LOW_QUALITY"]


def test_throttle_and_sessions_keep_null_keys(spark):
    df = spark.createDataFrame([(None, 0), (None, 100), (None, 600), (None, 1700), (5, 50), (5, 60)], "k long, t long")
    assert {tuple(r) for r in throttle(df, "k", "t", 500).collect()} == {(None, 0), (None, 600), (None, 1700), (5, 50)}
    rows = spark.createDataFrame([(None, "1", 1), (None, "2", 2), ("a", "1", 3)], "stream_id string, session_id string, v int")
    current = spark.createDataFrame([(None, "2"), ("a", "1")], "stream_id string, session_id string")
    assert {r["v"] for r in rolling.drop_stale_sessions(rows, current).collect()} == {2, 3}


def test_sliding_stream_keeps_null_and_negative_keys(spark, tmp_path):
    rows = [(i, u, 3_600_000 * i, float(i)) for i, u in enumerate([None, -1, 3, -1, None])]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ms long, value double")
    df.select("event_id", "user_id", F.timestamp_millis("ms").alias("ts"), "value").write.parquet(str(tmp_path / "events.parquet"))
    batch, stream = ({tuple(r) for r in q(spark, str(tmp_path)).collect()} for q in (query_events.sliding_activity, query_events.stream_sliding_activity))
    assert stream == batch and {r[0] for r in stream} == {None, -1, 3}


def test_rows_without_a_time_are_counted(spark, tmp_path):
    df = spark.createDataFrame([(1, 0), (2, None), (3, 9_000)], "v int, ms long").select("v", F.timestamp_millis("ms").alias("ts"))
    with pytest.warns(UserWarning, match="1 rows without a time"):
        replay.as_stream(df, str(tmp_path / "in"))
    assert [r["v"] for r in spark.read.parquet(f"{tmp_path}/in-untimed").collect()] == [2]
    assert {r["v"] for r in spark.read.parquet(f"{tmp_path}/in").collect()} == {1, 3}


GATES = """active_frame_count int, activity_ratio double, longest_active_run int, quality_status string, audio_quality double, registry_status string,
 valid_frame_fraction double, predictor_error boolean, model_status string, calibration_status string, model_version string, validation_record_id string,
 decision_threshold double, rejection_status string, emotion string, confidence double, verdict_status string, verdict_confidence double"""
PASSING = dict(zip([c.split()[0] for c in GATES.split(",")], [
    9, 0.9, 9, "ACCEPTABLE", 0.9, "READY", 1.0, False, "READY", "CALIBRATED", "m", "v", 0.4, None, "happy", 0.9, "TARGET_ACTIVE", 0.9]))


def test_missing_gate_inputs_reject(spark):
    unknown = [c for c in PASSING if c not in ("rejection_status", "confidence")]
    rows = [PASSING] + [{**PASSING, c: None} for c in unknown] + [{**PASSING, c: float("nan")} for c in ("activity_ratio", "audio_quality", "valid_frame_fraction", "verdict_confidence")]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], GATES)
    gated = live.gate_updates(df).select("rejection_reason", "candidate_emotion", "verdict_status", "verdict_confidence", "model_status").collect()
    assert (gated[0]["rejection_reason"], gated[0]["candidate_emotion"]) == (None, "happy")
    for name, r in zip(unknown + ["activity_ratio", "audio_quality", "valid_frame_fraction"], gated[1:]):
        if name not in ("model_status", "verdict_status", "verdict_confidence"):  # read by the other gate only
            assert r["rejection_reason"] is not None and r["candidate_emotion"] is None, name
    targets = live.target_events(df).select("status", "emotion").collect()
    assert tuple(targets[0]) == ("TARGET_ACTIVE", "happy")
    for name, r in zip(unknown + ["activity_ratio", "audio_quality", "valid_frame_fraction", "verdict_confidence"], targets[1:]):
        if name not in ("registry_status", "valid_frame_fraction"):
            assert r["status"] != "TARGET_ACTIVE" and r["emotion"] is None, name


def test_verdicts_as_of_keeps_every_update(spark):
    updates = spark.createDataFrame([(1, "a", 100), (2, "a", 200), (3, "a", 300), (4, None, 100), (5, "b", 100), (6, "a", None)], "id long, k string, ts_ms long")
    verdicts = spark.createDataFrame(
        [("a", 100, 1, "OVERLAP", 0.1), ("a", 100, 2, "TARGET_ACTIVE", 0.2), ("a", 201, 3, "NON_TARGET", 0.3), (None, 90, 4, "TARGET_ACTIVE", 0.4), ("c", 1, 5, "OVERLAP", 0.5), ("a", None, 6, "OVERLAP", 0.6)],
        "k string, ts_ms long, n long, verdict_status string, verdict_confidence double")
    for partitions in (None, 6):
        found = {r["id"]: r["verdict_confidence"] for r in live.verdicts_as_of(updates, verdicts, 100, keys=["k"], order=["n"], partitions=partitions).collect()}
        assert found == {1: 0.2, 2: None, 3: 0.3, 4: 0.4, 5: None, 6: None}


def test_impossible_mixes_do_not_pass(spark):
    rows = [(1, "a", 8000, [0.1, -0.2, 0.3, 0.1]), (2, "b", 8000, [0.0, 0.0, 0.0, 0.0])]
    train = spark.createDataFrame(rows, "id long, label string, sample_rate int, samples array<float>")
    with pytest.raises(Exception, match="impossible mix"):
        augment(train, order="id", snr_db=(10.0,)).groupBy("label").count().collect()
    marked = augment(train, order="id", snr_db=(10.0,), impossible="reject").collect()
    assert {(r["id"], r["augmentation"], r["reason"]) for r in marked} == {(1, "original", None), (2, "original", None), (1, "10dB", None), (2, "10dB", "MIX_INVALID")}
    rooms = spark.createDataFrame([(0, 16000, [1.0, 0.4])], "source_idx int, source_rate int, source_samples array<float>")
    with pytest.raises(Exception, match="impossible mix: reverb"):
        augment(train.filter("id = 1"), order="id", rooms=rooms).count()


def test_fits_that_do_not_settle_raise(spark):
    rows = [([float(i % 7), float(i % 5)], i % 2, 1.0) for i in range(60)]
    table = spark.createDataFrame(rows, "x array<double>, y int, w double")
    with pytest.raises(RuntimeError, match="did not settle"):
        model.fit_squared_hinge(table, 2, 2, max_rounds=1)
    margins = spark.createDataFrame([("a" if i % 3 else "b", [float(i % 4), float(i % 5)]) for i in range(40)], "label string, margins array<double>")
    with pytest.raises(RuntimeError, match="did not settle"):
        model.fit_calibrator(margins, ["a", "b"], max_rounds=1)


def test_unknown_truth_is_an_error_and_recordings_agree(spark):
    df = spark.createDataFrame([(None, [0.9, 0.1], True), ("a", [0.9, 0.1], True)], "label string, scores array<double>, eligible boolean")
    row = metrics.selective_metrics(df, ["a", "b"], 0.5).first()
    assert (row["accepted_count"], row["accepted_error_count"], row["unsupported_truth_count"]) == (2, 1, 1)
    windows = spark.createDataFrame([("d", "r", "a", "s", [1.0, 0.0], True), ("d", "r", "b", "s", [1.0, 0.0], True)],
                                    "dataset_id string, recording_id string, label string, speaker_id string, scores array<double>, eligible boolean")
    with pytest.raises(Exception, match="one label and one speaker"):
        metrics.aggregate_recordings(windows, ["a", "b"]).select("windows").collect()


def test_a_shared_content_is_found_in_all_its_versions(spark):
    secret = "name someone@example.org\nnothing"
    rows = [(f"f{i % 3}.txt", secret if i % 3 else "clean", f"{i:03d}") for i in range(30)] + [("reports/a.json", '{"x": {"speaker_id": 1}}', "100"), ("other/a.json", '{"x": {"speaker_id": 1}}', "101"), ("a.wav", None, "102")]
    found = privacy.scan_versions(spark.createDataFrame(rows, "path string, text string, commit string"), "path", "text", "commit").collect()
    assert {(r["path"], r["commit"], r["line"]) for r in found if r["line"] is not None} == {(f"f{i % 3}.txt", f"{i:03d}", 1) for i in range(30) if i % 3}
    assert {(r["kind"], r["path"]) for r in found if r["line"] is None} == {("speaker_identifiers_in_report", "reports/a.json"), ("private_artifact_tracked", "a.wav")}
