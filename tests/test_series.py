import numpy as np
import pytest
from helpers import series_frame, spoken, tone
from pyspark.sql import functions as F

from sonoframe import settings
from sonoframe.functions import pitch as P
from sonoframe.functions import series as S
from sonoframe.operators import frames as FR
from sonoframe.operators import summaries as SU

CFG = settings.FrameSettings()


def quality(spark, **named):
    df = series_frame(spark, **named)
    plain = {r["recording_id"]: r for r in SU.quality_features(df, CFG).drop("samples").collect()}
    fast = {r["recording_id"]: r for r in SU.summarise_quality(P.measure_quality(df, CFG)).drop("samples").collect()}
    for name in plain:
        for field in ("rms", "zero_crossing_rate", "clipping_fraction", "activity_ratio", "estimated_snr_db", "audio_quality"):
            assert plain[name][field] == pytest.approx(fast[name][field], abs=1e-9), field
        assert plain[name]["quality_status"] == fast[name]["quality_status"]
        assert plain[name]["frame_levels"] == pytest.approx(fast[name]["frame_levels"], abs=1e-9)
    return plain


def test_quality_labels(spark):
    half = np.full(8000, 0.001, np.float32)
    half[4000:] = tone(220, 0.25, 0.1)
    noise = np.random.default_rng(11).normal(0, 0.2, 8000).astype(np.float32)
    low = np.full(8000, 0.008, np.float32)
    low[4000:] += tone(220, 0.25, 0.01)
    r = quality(spark, half=half, noise=noise, low=low, clipped=np.ones(8000, np.float32), empty=[])
    assert r["half"]["activity_ratio"] == pytest.approx(0.5) and r["half"]["estimated_snr_db"] > 10
    assert r["half"]["quality_status"] == "ACCEPTABLE"
    assert r["noise"]["estimated_snr_db"] is None and r["noise"]["quality_status"] == "UNCERTAIN"
    assert r["low"]["quality_status"] == "LOW_QUALITY"
    assert r["clipped"]["clipping_fraction"] == 1.0 and r["clipped"]["quality_status"] == "LOW_QUALITY"
    assert r["empty"]["quality_status"] == "LOW_QUALITY" and r["empty"]["rms"] == 0.0


def test_two_frame_activity(spark):
    df = series_frame(spark, a=[0.0] * 400 + [0.1] * 400)
    rows = FR.tumbling_frames(df).orderBy("frame_index").collect()
    assert [r["status"] for r in rows] == ["SILENCE", "UNCERTAIN"]
    assert [r["start_ms"] for r in rows] == [0, 25] and rows[1]["energy_rms"] == pytest.approx(0.1)


def test_negative_zero_counts_as_negative(spark):
    df = series_frame(spark, a=[1.0, -0.0, 1.0, 0.0])
    assert df.select(S.zcr("samples")).first()[0] == pytest.approx(2 / 3)


def features(spark, **named):
    df = SU.prosody_features(P.measure_frames(series_frame(spark, **named), CFG), CFG)
    return {r["recording_id"]: r for r in FR.check_feature_contract(df).collect()}


def test_pitch_of_tones(spark):
    r = features(spark, low=tone(130), mid=tone(220), high=tone(330), faint=tone(220, amplitude=1e-6))
    for name, hz in (("low", 130), ("mid", 220), ("high", 330)):
        assert r[name]["f0_median_hz"] == pytest.approx(hz, abs=8)
        assert r[name]["f0_valid_fraction"] > 0.9 and r[name]["contract_ok"]
    assert r["faint"]["f0_median_hz"] is None and r["faint"]["hnr_median_db"] is None
    assert r["faint"]["f0_valid_fraction"] == 0.0 and r["faint"]["contract_ok"]


def test_corrupt_samples_make_invalid_frames(spark):
    x = tone(220)
    x[4000], x[9000] = np.nan, np.inf
    r = features(spark, bad=x)["bad"]
    assert 0.9 < r["valid_frame_fraction"] < 1.0
    assert r["contract_ok"] and r["f0_median_hz"] == pytest.approx(220, abs=8)


def test_out_of_range_pitch_can_be_dropped(spark):
    cfg = settings.FrameSettings(min_f0_hz=200.0, max_f0_hz=210.0)
    df = series_frame(spark, a=tone(220))
    count = lambda **kw: P.measure_frames(df, cfg, **kw).select(F.size(S.known("f0"))).first()[0]
    assert count(out_of_range_as_zero=False) < count() or count() == 0


def test_full_and_simple_vectors(spark):
    df = FR.assemble_features(SU.prosody_features(P.measure_frames(series_frame(spark, a=spoken(220)), CFG), CFG))
    row = df.first()
    assert len(row["full_vector"]) == 24 and len(row["simple_vector"]) == 8
    index = [settings.FULL_FEATURES.index(n) for n in settings.SIMPLE_FEATURES]
    assert row["simple_vector"] == pytest.approx([row["full_vector"][i] for i in index])


def test_partitioning_does_not_change_results(spark):
    df = series_frame(spark, **{f"r{i}": spoken(150 + 10 * i, seed=i) for i in range(8)})
    one = SU.prosody_features(P.measure_frames(df.coalesce(1), CFG), CFG).select("recording_id", *settings.FULL_FEATURES)
    many = SU.prosody_features(P.measure_frames(df.repartition(7), CFG), CFG).select("recording_id", *settings.FULL_FEATURES)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_settings_are_checked():
    with pytest.raises(ValueError):
        settings.FrameSettings(hop_ms=30.0)
    with pytest.raises(ValueError):
        settings.FrameSettings(sample_rate=900)
    with pytest.raises(ValueError):
        settings.QualityGates(minimum_snr_db=10.0)
