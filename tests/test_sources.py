import json
import os
import struct
import wave

import numpy as np
import pytest
from helpers import tone
from pyspark.sql import functions as F

from sonoframe import settings
from sonoframe.operators import model as ML
from sonoframe.plans.query_models import valid_document
from sonoframe.plans.train import save_models
from sonoframe.sources import audio
from sonoframe.sources import readers as R
from sonoframe.sources import writers as W


def write_wav(path, frames: bytes, width=2, channels=1, rate=16000):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(frames)


def pcm16(values):
    return (np.asarray(values) * 32767).astype("<i2").tobytes()


def test_scan_audio_widths_channels_and_bad_files(spark, tmp_path):
    write_wav(tmp_path / "w1.wav", bytes([0, 128, 255]), 1)
    write_wav(tmp_path / "w2.wav", struct.pack("<3h", -32768, 0, 16384), 2)
    write_wav(tmp_path / "w3.wav", b"\x00\x00\x80" + b"\x00\x00\x00" + b"\x00\x00\x40", 3)
    write_wav(tmp_path / "w4.wav", struct.pack("<2i", -(2**31), 2**30), 4)
    write_wav(tmp_path / "stereo.wav", struct.pack("<4h", 16384, 0, -16384, -16384), 2, channels=2)
    (tmp_path / "bad.wav").write_bytes(b"not audio")
    rows = {os.path.basename(r["path"]): r for r in R.scan_audio(spark, str(tmp_path)).collect()}
    assert rows["w1.wav"]["samples"] == pytest.approx([-1.0, 0.0, 127 / 128])
    assert rows["w2.wav"]["samples"] == pytest.approx([-1.0, 0.0, 0.5])
    assert rows["w3.wav"]["samples"] == pytest.approx([-1.0, 0.0, 0.5])
    assert rows["w4.wav"]["samples"] == pytest.approx([-1.0, 0.5])
    assert rows["stereo.wav"]["samples"] == pytest.approx([0.25, -0.5]) and rows["stereo.wav"]["sample_rate"] == 16000
    assert rows["bad.wav"]["error"] and rows["bad.wav"]["samples"] is None


def test_audio_source_keeps_empty_files_and_cuts_partitions(spark, tmp_path):
    assert R.scan_audio(spark, str(tmp_path)).count() == 0
    (tmp_path / "deep").mkdir()
    (tmp_path / "none.wav").write_bytes(b"")
    (tmp_path / "cut.wav").write_bytes(b"RIFF\x10")
    (tmp_path / "notes.txt").write_text("no audio")
    write_wav(tmp_path / "silent.wav", b"")
    df = spark.range(40).select(
        F.concat(F.lit("r"), "id").alias("name"), F.lit(8000).alias("sample_rate"), F.array(F.lit(-2.0), F.col("id") / 64, F.lit(1.0)).cast("array<float>").alias("samples"))
    assert audio.write_audio(df.repartition(3), str(tmp_path / "deep")) == 40
    for most in ("1", "200000", "100000000"):
        found = spark.read.format("audio_files").option("partitionBytes", most).load(str(tmp_path))
        rows = {os.path.basename(r["path"]): r for r in found.collect()}
        assert len(rows) == 43 and rows["r7.wav"]["samples"] == pytest.approx([-1.0, 7 / 64, 32767 / 32768])
        assert rows["none.wav"]["error"].startswith("EOFError") and rows["none.wav"]["file_sha256"] == "" and rows["none.wav"]["samples"] is None
        assert rows["cut.wav"]["error"] and rows["silent.wav"]["samples"] == [] and rows["silent.wav"]["error"] is None
    assert spark.read.format("audio_files").option("partitionBytes", "1").load(str(tmp_path)).rdd.getNumPartitions() == 43
    for width in (1, 2, 3, 4):
        rate, values = audio.decode_pcm(audio.encode_pcm(np.array([-1.0, -0.5, 0.0, 0.25, 1.0]), 100, width))
        assert rate == 100 and values[:4].tolist() == [-1.0, -0.5, 0.0, 0.25] and values[4] == pytest.approx(1.0, abs=2.0 ** (1 - 8 * width))


def test_manifest_round_trip_keeps_quotes(spark, tmp_path):
    row = ("a.wav", "sad", "s", 'r, "1"', "d", 'r, "1"', "", "train")
    W.write_manifest(spark.createDataFrame([row], ", ".join(f"{c} string" for c in settings.MANIFEST_COLUMNS)), str(tmp_path / "m"))
    assert R.scan_manifest(spark, str(tmp_path / "m")).first()["recording_id"] == 'r, "1"'


def test_scan_manifest_applies_every_rule(spark, tmp_path):
    for name, hz in (("a", 180), ("b", 180), ("c", 260)):
        write_wav(tmp_path / f"{name}.wav", pcm16(tone(hz, 0.1)))
    lines = ["path,emotion,speaker_id,recording_id,split", "a.wav,HAP,s1,r1,train", "b.wav,sad,s2,r2,train", "c.wav, Neutral ,s3,r3,Test",
             "gone.wav,sad,s4,r4,train", "c.wav,DIS,s5,r5,train", "c.wav,sad,s6,r6,dev"]
    manifest = tmp_path / "m.csv"
    manifest.write_bytes("\ufeff".encode() + "\n".join(lines).encode())
    out = R.scan_manifest(spark, str(manifest), files=R.scan_audio(spark, str(tmp_path)), base=f"file:{tmp_path}")
    found = {r["recording_id"]: r["violation"] for r in out.collect()}
    assert found == {"r1": "conflicting_content", "r2": "conflicting_content", "r3": None, "r4": "missing_file", "r5": "unmapped_label", "r6": "bad_split"}
    with pytest.raises(ValueError, match="recording_id, speaker_id"):
        bad = tmp_path / "x.csv"
        bad.write_text("path,emotion\na,b\n")
        R.scan_manifest(spark, str(bad))


def test_scan_noise_manifest(spark, tmp_path):
    write_wav(tmp_path / "fan.wav", pcm16(tone(90, 0.1)))
    (tmp_path / "n.csv").write_text("noise_type,path\nFan,fan.wav\nfan,fan.wav\nrain,fan.wav\nenvironment,gone.wav\n")
    out = R.scan_noise_manifest(spark, str(tmp_path / "n.csv"), R.scan_audio(spark, str(tmp_path)), f"file:{tmp_path}")
    rows = sorted((r["noise_type"], r["source_idx"], r["violation"]) for r in out.collect())
    assert rows == [("environment", 0, "missing_file"), ("fan", 0, None), ("fan", 1, None), ("rain", 0, "unsupported_noise_type")]
    counts = R.noise_source_counts(out.filter("violation is null")).first()
    assert counts["sources"] == 2 and len(counts["hashes"]) == 2


def test_scan_gold_tables(spark, tmp_path):
    (tmp_path / "files.csv").write_text("file,duration,speaker,transcription\nwav/03a01Fa.wav,1,3,a\nwav/04b02Nb.wav,1,9,a\nwav/05a01Wa.wav,1,5,a\n")
    (tmp_path / "train.csv").write_text("file,emotion,emotion.confidence\nwav/03a01Fa.wav,happiness,1\nwav/04b02Nb.wav,neutral,1\n")
    (tmp_path / "test.csv").write_text("file,emotion,emotion.confidence\nwav/05a01Wa.wav,sadness,1\n../x.wav,fear,1\n")
    out = R.scan_gold_tables(spark, *[str(tmp_path / f"{n}.csv") for n in ("files", "train", "test")])
    rows = {r["file"]: (r["source_split"], r["violation"]) for r in out.collect()}
    assert rows == {"wav/03a01Fa.wav": ("train", None), "wav/04b02Nb.wav": ("train", "speaker_mismatch"),
                    "wav/05a01Wa.wav": ("test", "code_conflict"), "../x.wav": ("test", "unsafe_path")}
    assert out.filter("file = 'wav/03a01Fa.wav'").first()["name"]["label"] == "happy"


def test_model_documents_round_trip_and_audit(spark, tmp_path):
    docs = {"good": valid_document(), "full": valid_document("full"), "raw": {**valid_document(), "calibration_status": "UNCALIBRATED"},
            "short": {**valid_document(), "intercepts": [0.0]}, "late": {**valid_document(), "update_interval_s": 9.0},
            "tested": {**valid_document(), "validation": {**valid_document()["validation"], "threshold_selection_method": "test and validation"}}}
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "corrupt.json").write_text("{not json")
    audited = {os.path.basename(r["file"]): r for r in ML.audit_models(R.scan_models(spark, str(tmp_path))).collect()}
    status = {k: (v["model_status"], v["failed_rule"]) for k, v in audited.items()}
    assert status["good.json"] == ("READY", None) and status["full.json"] == ("READY", None) and status["raw.json"] == ("UNCALIBRATED", None)
    assert status["short.json"] == ("INVALID", "intercepts") and status["late.json"] == ("INVALID", "live_window")
    assert status["tested.json"] == ("INVALID", "threshold_method") and status["corrupt.json"][0] == "INVALID"
    assert audited["full.json"]["parameter_count"] == 4 * 24 + 4 + 24 * 3 + 8
    save_models(spark, {"a": valid_document()}, str(tmp_path / "saved"))
    assert ML.audit_models(spark.read.schema(ML.MODEL_SCHEMA).json(str(tmp_path / "saved"))).first()["model_status"] == "READY"


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", "sad", "s", "r", "d", "r", "", "train")], ", ".join(f"{c} string" for c in settings.MANIFEST_COLUMNS))
    W.write_manifest(df.select(*reversed(df.columns)), str(tmp_path / "m"))
    part = next(p for p in (tmp_path / "m").iterdir() if p.name.startswith("part"))
    assert part.read_text().splitlines()[0] == ",".join(settings.MANIFEST_COLUMNS)
    W.write_windows(df, str(tmp_path / "w"))
    assert (tmp_path / "w" / "split=train").is_dir()
    report = spark.createDataFrame([(1.0, "x", [2.0])], "score double, speaker_id string, more array<double>")
    W.write_report(report, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).columns == ["more", "score"]
    with pytest.raises(Exception, match="NaN"):
        W.write_report(report.withColumn("more", F.array(F.lit(float("nan")))), str(tmp_path / "r2"))
