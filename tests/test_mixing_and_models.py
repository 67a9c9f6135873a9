import numpy as np
import pyarrow as pa
import pytest
from helpers import series_frame, spoken, tone
from pyspark.sql import functions as F

from sonoframe.functions import scores as P
from sonoframe.functions.pitch import measure_frames, measure_quality
from sonoframe.operators import metrics as MT
from sonoframe.operators import mixing as X
from sonoframe.operators import model as ML
from sonoframe.plans import evaluate as EV
from sonoframe.plans import live
from sonoframe.plans import train as TR


def ratio_db(clean, mixed):
    clean, mixed = np.asarray(clean, np.float64), np.asarray(mixed, np.float64)
    return 10 * np.log10(np.mean(clean**2) / np.mean((mixed - clean) ** 2))


@pytest.fixture(scope="module")
def pair(spark):
    target, source = tone(220, 0.5), tone(90, 3000 / 16000, 0.3)
    df = series_frame(spark, t=target).withColumn("other", F.array(*[F.lit(float(v)).cast("float") for v in source[:300]]))
    return target, df


@pytest.mark.parametrize("db", [20.0, 10.0, 5.0, 0.0])
def test_white_and_background_levels(pair, db):
    target, df = pair
    for mixed in (X.mix_white_noise(df, db, 7), X.mix_background(df, "other", db)):
        assert ratio_db(target, mixed.first()["samples"]) == pytest.approx(db, abs=0.2)


@pytest.mark.parametrize("db", [6.0, 0.0, -6.0])
def test_interferer_levels(pair, db):
    target, df = pair
    assert ratio_db(target, X.mix_interferer(df, "other", db).first()["samples"]) == pytest.approx(db, abs=0.2)


def test_noise_depends_on_the_seed_only(spark):
    df = series_frame(spark, **{f"r{i}": tone(200 + i, 0.05) for i in range(12)}).withColumn("seed", F.xxhash64("recording_id"))
    key = lambda d: sorted((r["recording_id"], tuple(r["samples"])) for r in X.mix_white_noise(d, 10.0, "seed").collect())
    assert key(df.coalesce(1)) == key(df.repartition(5))


def test_reverb_keeps_length_and_level(spark):
    room = np.zeros(1200, np.float32)
    room[0], room[400] = 1.0, 0.4
    df = series_frame(spark, t=tone(220, 0.5)).withColumn("room", F.lit([float(v) for v in room]).cast("array<float>"))
    out = np.asarray(X.apply_reverb(df, "room").first()["samples"])
    assert out.size == 8000 and np.sqrt(np.mean(out**2)) == pytest.approx(np.sqrt(np.mean(tone(220, 0.5) ** 2)), rel=1e-4)
    direct = np.convolve(tone(220, 0.5), room)[:8000]
    assert np.corrcoef(out, direct)[0, 1] > 0.999999


def test_impossible_mixes_are_null(spark):
    df = series_frame(spark, zero=np.zeros(10), nan=[np.nan, 1.0], empty=[], fine=[0.1, -0.1])
    got = {r["recording_id"]: r["samples"] for r in X.mix_white_noise(df, 10.0, 1).collect()}
    assert got["zero"] is None and got["nan"] is None and got["empty"] is None and len(got["fine"]) == 2
    assert X.mix_white_noise(df, 61.0, 1).filter("samples is not null").count() == 0
    reasons = {r["recording_id"]: r["mix_problem"] for r in X.mixable(df.withColumn("level_db", F.lit(10.0)), "white").collect()}
    assert reasons == {"zero": "NO_ENERGY", "nan": "NOT_FINITE", "empty": "EMPTY_SIGNAL", "fine": None}


# --- metrics with hand-computed values -------------------------------------------------
def table(spark, rows):
    return spark.createDataFrame([("c", *r) for r in rows], "condition string, label string, scores array<double>, eligible boolean")


def test_hand_computed_metrics(spark):
    df = table(spark, [("happy", [0.9, 0.1], True), ("angry", [0.2, 0.8], True), ("angry", [0.7, 0.3], True), ("sad", [0.4, 0.6], False)])
    row = MT.classification_metrics(df, ["happy", "angry"], 0.5).first()
    assert row["coverage"] == 0.75 and row["accepted_error_rate"] == pytest.approx(1 / 3) and row["unsupported_truth_count"] == 1
    assert row["uar"] == pytest.approx((1 + 0.5 + 0) / 3) and row["calibration_count"] == 3
    assert row["brier_score"] == pytest.approx((0.02 + 0.08 + 0.98) / 3)
    none = MT.classification_metrics(df.withColumn("eligible", F.lit(False)), ["happy", "angry"], 0.5).first()
    assert none["macro_f1"] is None and none["uar"] is None and none["accepted_error_rate"] is None and none["brier_score"] is None


def test_recording_rules(spark):
    rows = [("d", "r1", "s1", "happy", [0.8, 0.2], True), ("d", "r1", "s1", "happy", [0.4, 0.6], True), ("d", "r1", "s1", "happy", [0.0, 1.0], False),
            ("d", "r2", "s1", "sad", [1.0, 0.0], False)]
    schema = "dataset_id string, recording_id string, speaker_id string, label string, scores array<double>, eligible boolean"
    got = {r["recording_id"]: r for r in MT.aggregate_recordings(spark.createDataFrame(rows, schema), ["happy", "sad"]).collect()}
    assert got["r1"]["scores"] == pytest.approx([0.6, 0.4]) and got["r1"]["eligible"]
    assert got["r2"]["scores"] == [0.5, 0.5] and not got["r2"]["eligible"]
    with pytest.raises(Exception, match="one label"):
        MT.aggregate_recordings(spark.createDataFrame([*rows, ("d", "r1", "s1", "sad", [1.0, 0.0], True)], schema), ["happy", "sad"]).collect()


def test_bin_edges_follow_the_fixed_values(spark):
    df = spark.createDataFrame([(0.3,), (0.30000000000000004,), (1.0,), (0.0,)], "c double")
    assert [r[0] for r in df.select(MT.ece_bin(F.col("c"))).collect()] == [2, 3, 9, 0]


def test_bootstrap_matches_plain_resampling(spark):
    rng = np.random.default_rng(0)
    classes, rows = ["a", "b"], []
    for _ in range(80):
        p = float(rng.random())
        rows.append((["a", "b"][int(rng.random() < 0.4)], [p, 1 - p], bool(rng.random() < 0.9)))
    got = {r["metric"]: (r["low"], r["high"]) for r in MT.bootstrap_ci(table(spark, rows), classes, 0.6, resamples=2000).collect()}
    label, conf = np.array([r[0] for r in rows]), np.array([max(r[1]) for r in rows])
    ok = np.array([r[2] for r in rows]) & (conf >= 0.6)
    strata = [np.flatnonzero(label == c) for c in classes]
    plain = [ok[np.concatenate([rng.choice(s, s.size) for s in strata])].mean() for _ in range(2000)]
    assert got["coverage"] == pytest.approx(tuple(np.quantile(plain, [0.025, 0.975])), abs=0.03)


# --- fitting ------------------------------------------------------------------------------
def blobs(spark, n=240):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        c = i % 3
        x = rng.normal([(c == 0) * 1.5, (c == 1) * 1.5], 1.0)
        rows.append(("abc"[c], float(x[0]), float(x[1])))
    return rows, spark.createDataFrame(rows, "label string, f0 double, f1 double")


def test_squared_hinge_reaches_the_optimum(spark):
    rows, df = blobs(spark)
    weights, intercepts = ML.fit_linear(df, ["f0", "f1"], ["a", "b", "c"], class_weight={"b": 2.0})
    x = np.column_stack([np.array([[r[1], r[2]] for r in rows]), np.ones(len(rows))])
    for k, name in enumerate("abc"):
        y = np.where([r[0] == name for r in rows], 1.0, -1.0)
        c = np.where([r[0] == "b" for r in rows], 2.0, 1.0)
        w = np.append(weights[k], intercepts[k])
        gap = np.maximum(0.0, 1 - y * (x @ w))
        assert np.abs(w - 2 * (c * y * gap) @ x).max() < 1e-5  # gradient of the penalised loss


def test_calibration_reaches_the_optimum(spark):
    rows, df = blobs(spark)
    margins = df.select("label", F.array("f0", "f1", F.col("f0") - F.col("f1")).alias("margins"))
    slopes, offsets = ML.fit_calibrator(margins, ["a", "b", "c"])
    m = np.array([[r[1], r[2], r[1] - r[2]] for r in rows])
    for k, name in enumerate("abc"):
        y = np.array([r[0] == name for r in rows], float)
        p = 1 / (1 + np.exp(-(slopes[k] * m[:, k] + offsets[k])))
        assert abs(((p - y) * m[:, k]).sum()) < 1e-3 and abs((p - y).sum()) < 1e-3
    with pytest.raises(ValueError):
        ML.fit_calibrator(margins, ["a", "b", "c", "d"])


def test_logistic_model_separates(spark):
    _, df = blobs(spark)
    weights, intercepts = ML.fit_linear(df, ["f0", "f1"], ["a", "b", "c"], kind="LogisticRegression")
    scored = df.select("label", P.margins(F.array("f0", "f1"), weights, intercepts).alias("scores"))
    assert scored.filter(P.pick_class("scores", ["a", "b", "c"]) == F.col("label")).count() > 150


def test_imputer_rules(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (float("nan"), None)], "a double, b double")
    assert ML.fit_imputer(df, ["a"]) == {"a": 2.0}
    with pytest.raises(ValueError, match="b"):
        ML.fit_imputer(df, ["a", "b"])
    bad = spark.createDataFrame([(float("inf"),)], "a double")
    assert ML.impute(bad, {"a": 5.0}).first()["a"] == 5.0
    with pytest.raises(Exception, match="infinite"):
        ML.impute(bad, {"a": 5.0}, training=True).collect()


# --- training and evaluation end to end ------------------------------------------------------
HZ = {"neutral": 180, "happy": 260, "angry": 330, "sad": 130}


@pytest.fixture(scope="module")
def clips(spark):
    rows = []
    for s in range(10):
        for i, (label, hz) in enumerate(HZ.items()):
            split = "validation" if s < 2 else "test" if s < 4 else "train"
            x = spoken(hz + s, 0.6, seed=10 * s + i)
            rows.append((4 * s + i, label, f"s{s}", f"r{s}-{i}", "d", split, 16000, [float(v) for v in x]))
    return spark.createDataFrame(rows, "pos int, label string, speaker_id string, recording_id string, dataset_id string, split string, sample_rate int, samples array<float>").repartition(8).persist()


@pytest.fixture(scope="module")
def models(clips):
    return TR.train_profiles(clips, order="pos", snr_db=(20.0,), happy_weight=2.0)


def test_training_gives_ready_models(spark, models):
    found, rejected = models
    rows = [tuple(m.get(f.name) for f in ML.MODEL_SCHEMA.fields) for m in found.values()]
    audited = ML.audit_models(spark.createDataFrame(rows, ML.MODEL_SCHEMA), {"sample_rate": 16000}).collect()
    assert {r["model_status"] for r in audited} == {"READY"}, [r["failed_rule"] for r in audited]
    assert found["full"]["training"]["sample_count"] == 48 and found["full"]["validation"]["sample_count"] == 8
    assert rejected.count() == 0


def test_evaluation_over_conditions(spark, clips, models):
    source = series_frame(spark, fan=np.random.default_rng(1).normal(0, 0.1, 4000)).select(
        F.lit("fan").alias("noise_type"), F.lit(0).alias("source_idx"), "sample_rate", F.col("samples").alias("source_samples"))
    test = clips.filter("split = 'test'")
    result = EV.evaluate_conditions(test, models[0]["full"], order="pos", snr_db=(20.0,), sir_db=(0.0,), sources=source)
    rows = {r["condition"]: r for r in result["metrics"].collect()}
    assert rows["clean"]["coverage"] > 0.7 and rows["clean"]["macro_f1"] > 0.7
    assert rows["background_music"]["status"] == "NOT_EVALUATED_NO_SOURCE" and rows["reverb"]["status"] == "NOT_EVALUATED_NO_RIR"
    assert {"clean", "white_noise_20db", "fan_snr_20db", "other_voice_sir_0db"} <= set(rows)
    assert all(rows[c]["sample_count"] == 8 for c in ("clean", "white_noise_20db", "fan_snr_20db", "other_voice_sir_0db"))
    assert result["recordings"].first()["sample_count"] == 8 and "speaker_id" not in result["speakers"].columns


def test_plug_in_points_fail_closed(spark):
    df = spark.createDataFrame([([1.0],), ([2.0],)], "full_vector array<float>")
    good = live.with_predictor(df, lambda m: (["sad"] * len(m), [0.5] * len(m)))
    assert {r["prediction"]["emotion"] for r in good.collect()} == {"sad"}

    def fails_on_two(matrix):
        if (matrix == 2.0).any():
            raise RuntimeError("boom")
        return ["sad"] * len(matrix), [0.5] * len(matrix)

    rows = {r["full_vector"][0]: r["prediction"] for r in live.with_predictor(df.coalesce(1), fails_on_two).collect()}
    assert not rows[1.0]["predictor_error"] and rows[2.0]["predictor_error"] and rows[2.0]["emotion"] is None
    audio = series_frame(spark, a=[0.1])
    assert live.with_verifier(audio).first()["verdict_status"] == "NOT_CONFIGURED"
    assert live.with_verifier(audio, lambda x: ("TARGET_ACTIVE", 0.9)).first()["verdict_confidence"] == pytest.approx(0.9)
    assert live.with_verifier(audio, lambda x: 1 / 0).first()["verdict_status"] == "UNCERTAIN"


@pytest.mark.parametrize("step", [measure_quality, measure_frames, lambda df: X.mix_white_noise(df, 10.0, 7)])
def test_batches_of_audio_length_rows_are_bounded_by_bytes(spark, step):
    """Whatever number of rows the session allows, as Spark's own 10,000 rows of 24,000 samples are 960 MB."""
    rows, limit = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    usual = spark.conf.get(rows)

    @F.arrow_udf("long")
    def together(samples: pa.Array) -> pa.Array:
        return pa.array([len(samples)] * len(samples), pa.int64())

    try:
        spark.conf.set(rows, "10000"), spark.conf.unset(limit)
        df = step(spark.range(0, 200, 1, 1).select(F.expr("transform(sequence(1, 24000), x -> cast(sin(x) as float))").alias("samples")))
        assert df.select(together("samples").alias("n")).agg(F.max("n")).first()[0] <= 64
        spark.conf.set(limit, "123456")
        step(df.select("samples"))
        assert spark.conf.get(limit) == "123456"  # the owner's own stays
    finally:
        spark.conf.set(rows, usual), spark.conf.unset(limit)
