"""Queries over the events table: ordered folds, stream runs and the event policy."""

from pyspark.sql import functions as F

from sonoframe import settings
from sonoframe.functions import checks as C
from sonoframe.operators import history as H
from sonoframe.operators import policy as L
from sonoframe.plans import live
from sonoframe.plans.registry import load, query, r6, rounded, s6
from sonoframe.streaming import replay as R
from sonoframe.streaming import rolling as K
from sonoframe.streaming import verdicts as V


def events(spark, sf_dir):
    df = load(spark, sf_dir, "events")
    return df.withColumn("ts_ms", H.epoch_ms(df, "ts"))


EV = "ev AS (SELECT *, epoch_us(ts) // 1000 AS ts_ms FROM events)"


def accepted_label():
    """Event types act as labels; an error is a rejection."""
    return F.when(F.col("event_type") != "error", F.col("event_type"))


@query("smoothed_labels", f"""WITH {EV}, a AS (SELECT event_id, user_id, ts, CASE WHEN event_type <> 'error' THEN event_type END AS label, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM ev),
 b AS (SELECT *, lag(label, 1) OVER w AS p1, lag(label, 2) OVER w AS p2 FROM a WHERE label IS NOT NULL WINDOW w AS (PARTITION BY user_id, run ORDER BY ts, event_id)),
 c AS (SELECT *, CASE WHEN p1 IS NULL OR p1 = label OR p2 = label THEN label END AS mark FROM b),
 d AS (SELECT event_id, last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS smoothed FROM c)
SELECT a.event_id, a.label, d.smoothed FROM a LEFT JOIN d USING (event_id)""")
def smoothed_labels(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("label", accepted_label())
    return H.smooth_labels(df, "user_id", ["ts_ms", "event_id"], "label").select("event_id", "label", "smoothed")


@query("monotonic_events", """SELECT event_id FROM (SELECT event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events) WHERE m IS NULL OR value > m""")
def monotonic_events(spark, sf_dir):
    return H.monotonic_only(events(spark, sf_dir), "user_id", "event_id", "value").select("event_id")


@query("latest_events", """SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS event_type, count(*) - 1 AS replaced_count FROM events GROUP BY user_id""")
def latest_events(spark, sf_dir):
    df = events(spark, sf_dir).select("user_id", "event_id", "event_type", "ts_ms")
    return H.latest_per_key(df, "user_id", ["ts_ms", "event_id"]).drop("ts_ms")


RECENT = "SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS recency FROM events"


@query("recent_events", f"SELECT user_id, event_id, recency FROM ({RECENT}) WHERE recency <= 12")
def recent_events(spark, sf_dir):
    return H.recent_n(events(spark, sf_dir), "user_id", ["ts_ms", "event_id"]).select("user_id", "event_id", "recency")


@query("kept_events", f"SELECT user_id, event_id, greatest(count(*) OVER (PARTITION BY user_id) - 16, 0) AS dropped_count FROM ({RECENT}) QUALIFY recency <= 16")
def kept_events(spark, sf_dir):
    return H.keep_newest(events(spark, sf_dir), "user_id", ["ts_ms", "event_id"], 16).select("user_id", "event_id", "dropped_count")


@query("rolling_values", f"""SELECT user_id, any_value(n) AS sample_count, count(*) AS retained_count, {s6('median(value)')} AS median, {s6('quantile_cont(value, 0.95)')} AS p95
 FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM ({RECENT})) WHERE recency <= 40 GROUP BY user_id""")
def rolling_values(spark, sf_dir):
    df = H.rolling_summary(events(spark, sf_dir), "user_id", ["ts_ms", "event_id"], "value", 40)
    return rounded(df, "median", "p95")


TWO_HOURS = 7_200_000


@query("throttled_events", f"""WITH RECURSIVE {EV}, n AS (SELECT user_id, ts_ms, min(ts_ms) OVER (PARTITION BY user_id ORDER BY ts_ms RANGE BETWEEN {TWO_HOURS} FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM ev),
 r AS (SELECT user_id, min(ts_ms) AS ts_ms FROM ev GROUP BY user_id UNION SELECT n.user_id, n.nxt FROM r JOIN n ON n.user_id IS NOT DISTINCT FROM r.user_id AND n.ts_ms = r.ts_ms WHERE n.nxt IS NOT NULL)
SELECT min(ev.event_id) AS event_id FROM ev JOIN r ON ev.user_id IS NOT DISTINCT FROM r.user_id AND ev.ts_ms = r.ts_ms GROUP BY ev.user_id, ev.ts_ms""")
def throttled_events(spark, sf_dir):
    return H.throttle(events(spark, sf_dir), "user_id", "ts_ms", TWO_HOURS, order="event_id").select("event_id")


# --- streams ---------------------------------------------------------------------------------
@query("stream_smoothed_labels", f"""WITH {EV}, a AS (SELECT event_id, user_id, ts, ts_ms, CASE WHEN event_type <> 'error' THEN event_type END AS label, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM ev),
 b AS (SELECT *, lag(label, 1) OVER w AS p1, lag(label, 2) OVER w AS p2 FROM a WHERE label IS NOT NULL WINDOW w AS (PARTITION BY user_id, run ORDER BY ts, event_id)),
 c AS (SELECT *, CASE WHEN p1 IS NULL OR p1 = label OR p2 = label THEN label END AS mark FROM b),
 d AS (SELECT event_id, last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS smoothed FROM c)
SELECT a.user_id::VARCHAR AS stream_id, a.ts_ms, a.label, d.smoothed FROM a LEFT JOIN d USING (event_id)""")
def stream_smoothed_labels(spark, sf_dir):
    """The stateful hysteresis over a file stream of the events, closed by end rows."""
    df = events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("stream_id"), F.lit("0").alias("session_id"), F.timestamp_millis("ts_ms").alias("ts"),
        "ts_ms", "event_id", accepted_label().alias("label"), F.lit(False).alias("is_end"))
    last = df.agg(F.max("ts_ms").alias("m")).first()["m"]
    ends = df.select("stream_id", "session_id").distinct().select(
        "stream_id", "session_id", F.timestamp_millis(F.lit(last + 1)).alias("ts"), F.lit(last + 1).alias("ts_ms"),
        F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("string").alias("label"), F.lit(True).alias("is_end"))
    folder = R.shared_folder(spark, "labels")
    stream = R.as_stream(df, folder + "/in", closing=ends)
    R.run_available(K.smooth_stream(stream, label="label", tie="event_id", delay=R.slice_delay(df)), folder + "/out", folder + "/state")
    return spark.read.parquet(folder + "/out").drop("session_id")


@query("stream_rolling_windows", f"""WITH RECURSIVE {EV}, o AS (SELECT user_id, ts_ms, value, row_number() OVER w AS rn, list(value) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS win
   FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, event_id)),
 f AS (SELECT * FROM o WHERE rn >= 8),
 n AS (SELECT *, min(ts_ms) OVER (PARTITION BY user_id ORDER BY ts_ms RANGE BETWEEN {TWO_HOURS * 12} FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM f),
 r AS (SELECT user_id, min(ts_ms) AS ts_ms FROM f GROUP BY user_id UNION SELECT n.user_id, n.nxt FROM r JOIN n ON n.user_id = r.user_id AND n.ts_ms = r.ts_ms WHERE n.nxt IS NOT NULL)
SELECT r.user_id::VARCHAR AS stream_id, r.ts_ms, len(win)::INTEGER AS n, {s6('list_sum(list_transform(win, lambda x: x::FLOAT::DOUBLE))', 3)} AS total FROM r JOIN f ON f.user_id = r.user_id AND f.ts_ms = r.ts_ms""")
def stream_rolling_windows(spark, sf_dir):
    """Rolling last-8-values windows, throttled to one a day, with keyed state over a file stream."""
    df = events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("stream_id"), F.lit("0").alias("session_id"), F.timestamp_millis("ts_ms").alias("ts"),
        "ts_ms", "event_id", F.array(F.col("value").cast("float")).alias("samples"), F.lit(False).alias("is_end"))
    last = df.agg(F.max("ts_ms").alias("m")).first()["m"]
    ends = df.select("stream_id", "session_id").distinct().select(
        "stream_id", "session_id", F.timestamp_millis(F.lit(last + 1)).alias("ts"), F.lit(last + 1).alias("ts_ms"),
        F.lit(None).cast("long").alias("event_id"), F.array().cast("array<float>").alias("samples"), F.lit(True).alias("is_end"))
    folder = R.shared_folder(spark, "windows")
    stream = R.as_stream(df, folder + "/in", closing=ends)
    R.run_available(K.rolling_windows(stream, 8, TWO_HOURS * 12, tie="event_id", delay=R.slice_delay(df)), folder + "/out", folder + "/state")
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return spark.read.parquet(folder + "/out").select("stream_id", "ts_ms", F.size("samples").alias("n"), r6(total, 3).alias("total"))


SLIDING = f"""SELECT user_id, (w.s)::BIGINT AS window_start_ms, count(*) AS frames, count(*) FILTER (value >= 50) AS active_frames,
 {s6('count(*) FILTER (value >= 50) / count(*)')} AS activity_ratio, max(value) AS peak
FROM (SELECT *, epoch_us(ts) // 1000 AS t FROM events), LATERAL (SELECT unnest([t - t % 43200000, t - t % 43200000 - 43200000]) AS s) w GROUP BY ALL"""


def _sliding(df, delay="1 second", keys=("user_id",)):
    out = K.sliding_activity(df, level="value", threshold=50.0, window="24 hours", slide="12 hours", key=list(keys), delay=delay)
    return rounded(out.select(
        *keys, F.unix_millis("window_start").alias("window_start_ms"), "frames", "active_frames", "activity_ratio", "peak"), "activity_ratio")


@query("sliding_activity", SLIDING)
def sliding_activity(spark, sf_dir):
    return _sliding(events(spark, sf_dir).withColumn("ts", F.timestamp_millis("ts_ms")))


@query("stream_sliding_activity", SLIDING)
def stream_sliding_activity(spark, sf_dir):
    """The same sliding windows over a file stream; a late marker row closes the last ones."""
    df = events(spark, sf_dir).select("user_id", F.timestamp_millis("ts_ms").alias("ts"), "value", F.lit(False).alias("closing"))
    far = df.agg(F.max("ts").alias("ts")).select(
        F.lit(None).cast("long").alias("user_id"), (F.col("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts"), F.lit(0.0).alias("value"), F.lit(True).alias("closing"))
    folder = R.shared_folder(spark, "sliding")
    stream = R.as_stream(df, folder + "/in", closing=far)
    R.run_available(_sliding(stream, R.slice_delay(df), ("user_id", "closing")), folder + "/out", folder + "/state")
    return spark.read.parquet(folder + "/out").filter(~F.col("closing")).drop("closing")


# --- gate cascades on synthetic measures derived from events --------------------------------------
def measured_updates(spark, sf_dir, *more):
    """Quality and prediction columns computed from each event, to drive the cascades, and further columns of the event."""
    e, v = F.col("event_id"), F.col("value")
    unit = F.least(v / 100.0, F.lit(1.0))
    return events(spark, sf_dir).select(
        "event_id", "user_id", "ts_ms", *more, F.pmod(e, F.lit(13)).cast("int").alias("active_frame_count"),
        (F.pmod(e, F.lit(10)) / 10.0).alias("activity_ratio"), F.pmod(e, F.lit(17)).cast("int").alias("longest_active_run"),
        F.when(e % 11 == 0, "LOW_QUALITY").when(e % 11 == 1, "UNCERTAIN").otherwise("ACCEPTABLE").alias("quality_status"),
        unit.alias("audio_quality"), F.when(e % 19 == 0, "INVALID").when(e % 19 == 1, "UNCALIBRATED").otherwise("READY").alias("registry_status"),
        (1.0 - F.pmod(e, F.lit(23)) / 400.0).alias("valid_frame_fraction"), (e % 29 == 0).alias("predictor_error"),
        F.lit("READY").alias("model_status"), F.when(e % 31 == 0, "UNCALIBRATED").otherwise("CALIBRATED").alias("calibration_status"),
        F.lit("m1").alias("model_version"), F.lit("v1").alias("validation_record_id"), F.lit(0.4).alias("decision_threshold"),
        F.when(e % 5 == 0, "UNCERTAIN").alias("rejection_status"),
        F.when(e % 5 != 0, F.element_at(F.array(*[F.lit(x) for x in settings.EMOTIONS]), (e % 4 + 1).cast("int"))).alias("emotion"),
        unit.alias("confidence"),
        F.when(e % 7 == 0, "NON_TARGET").when(e % 7 == 1, "OVERLAP").when(e % 7 != 2, "TARGET_ACTIVE").alias("verdict_status"),
        F.when(e % 7 != 2, F.pmod(e, F.lit(37)) / 36.0).alias("verdict_confidence"))


UPDATES = """u AS (SELECT event_id, event_id % 13 AS afc, event_id % 10 / 10 AS ar, event_id % 17 AS run, CASE event_id % 11 WHEN 0 THEN 'LOW_QUALITY' WHEN 1 THEN 'UNCERTAIN' ELSE 'ACCEPTABLE' END AS qs,
 least(value / 100, 1) AS q, CASE event_id % 19 WHEN 0 THEN 'INVALID' WHEN 1 THEN 'UNCALIBRATED' ELSE 'READY' END AS ms, 1 - event_id % 23 / 400 AS vf, event_id % 29 = 0 AS pe, event_id % 31 <> 0 AS cal, event_id % 5 = 0 AS rej,
 ['neutral','happy','angry','sad'][event_id % 4 + 1] AS emo, event_id % 7 AS v, event_id % 37 / 36 AS vc FROM events)"""


@query("gated_updates", f"""WITH {UPDATES}, g AS (SELECT event_id, emo, CASE WHEN afc = 0 THEN 'SILENCE' WHEN ar < 0.2 OR run < 3 THEN 'LOW_ACTIVITY' WHEN qs = 'LOW_QUALITY' THEN qs WHEN qs <> 'ACCEPTABLE' THEN 'UNCERTAIN_AUDIO_QUALITY'
 WHEN q < 0.5 THEN 'LOW_QUALITY' WHEN ms <> 'READY' THEN ms WHEN vf < 0.95 THEN 'INVALID_FRAME_CONTENT' WHEN pe THEN 'PREDICTOR_ERROR' WHEN NOT cal THEN CASE WHEN rej THEN 'UNCERTAIN' ELSE 'MODEL_NOT_CALIBRATED' END WHEN rej THEN 'UNCERTAIN' END AS rejection_reason FROM u)
SELECT event_id, rejection_reason, CASE WHEN rejection_reason IS NULL THEN emo END AS candidate_emotion FROM g""")
def gated_updates(spark, sf_dir):
    return live.gate_updates(measured_updates(spark, sf_dir)).select("event_id", "rejection_reason", "candidate_emotion")


@query("target_events", f"""WITH {UPDATES}, g AS (SELECT event_id, emo, q, vc, CASE WHEN afc = 0 THEN 'SILENCE' WHEN ar < 0.2 OR run < 3 THEN 'UNCERTAIN' WHEN qs = 'LOW_QUALITY' THEN qs WHEN qs <> 'ACCEPTABLE' THEN 'UNCERTAIN'
 WHEN q < 0.5 THEN 'LOW_QUALITY' WHEN v = 0 THEN 'NON_TARGET' WHEN v = 1 THEN 'OVERLAP' WHEN v = 2 THEN 'NOT_CONFIGURED' WHEN vc < 0.8 THEN 'UNCERTAIN' WHEN pe THEN 'UNCERTAIN' WHEN rej OR NOT cal THEN 'UNCERTAIN' ELSE 'TARGET_ACTIVE' END AS status FROM u)
SELECT event_id, status, CASE WHEN status = 'TARGET_ACTIVE' THEN emo END AS emotion, {s6("CASE WHEN status = 'TARGET_ACTIVE' THEN q ELSE 0 END")} AS emotion_confidence, {s6("CASE WHEN status = 'TARGET_ACTIVE' THEN vc ELSE 0 END")} AS speaker_confidence FROM g""")
def target_events(spark, sf_dir):
    df = live.target_events(measured_updates(spark, sf_dir))
    return rounded(df.select("event_id", "status", "emotion", "emotion_confidence", "speaker_confidence"), "emotion_confidence", "speaker_confidence")


HORIZON = 12 * 3_600_000
# verdicts are the errors and signups, updates all other events; a fifth of the verdicts of the first half month only come after the stream has passed them
TARGETS = f"""{UPDATES}, {EV}, v AS (SELECT user_id, ts_ms, event_id, CASE event_id % 7 WHEN 0 THEN 'NON_TARGET' WHEN 1 THEN 'OVERLAP' ELSE 'TARGET_ACTIVE' END AS vs, (event_id % 37 / 36)::DOUBLE AS conf FROM ev WHERE event_type IN ('error', 'signup') AND NOT (__late__)),
 m AS (SELECT e.event_id, v.vs, v.conf, row_number() OVER (PARTITION BY e.event_id ORDER BY v.ts_ms DESC, v.event_id DESC) AS place FROM ev e LEFT JOIN v ON v.user_id IS NOT DISTINCT FROM e.user_id AND v.ts_ms <= e.ts_ms AND v.ts_ms > e.ts_ms - {HORIZON} WHERE e.event_type NOT IN ('error', 'signup')),
 g AS (SELECT event_id, emo, q, conf, CASE WHEN qs = 'LOW_QUALITY' THEN qs WHEN qs <> 'ACCEPTABLE' THEN 'UNCERTAIN' WHEN q < 0.5 THEN 'LOW_QUALITY' WHEN vs IS NULL THEN 'NOT_CONFIGURED' WHEN vs <> 'TARGET_ACTIVE' THEN vs
  WHEN conf < 0.8 THEN 'UNCERTAIN' WHEN pe THEN 'UNCERTAIN' WHEN rej OR NOT cal THEN 'UNCERTAIN' ELSE 'TARGET_ACTIVE' END AS status FROM m JOIN u USING (event_id) WHERE place = 1)
SELECT event_id, status, CASE WHEN status = 'TARGET_ACTIVE' THEN emo END AS emotion, {s6("CASE WHEN status = 'TARGET_ACTIVE' THEN q ELSE 0 END")} AS emotion_confidence, {s6("CASE WHEN status = 'TARGET_ACTIVE' THEN conf ELSE 0 END")} AS speaker_confidence FROM g"""


def _updates_and_verdicts(spark, sf_dir):
    """Updates that all pass the activity gates, and the verdicts beside them."""
    e = F.col("event_id")
    said = F.col("event_type").isin("error", "signup")
    df = events(spark, sf_dir)
    measured = measured_updates(spark, sf_dir, "ts", said.alias("_said")).drop("verdict_status", "verdict_confidence").withColumns(
        {"active_frame_count": F.lit(9), "activity_ratio": F.lit(0.9), "longest_active_run": F.lit(9)})
    updates = measured.filter(~F.col("_said")).drop("_said")
    verdicts = df.filter(said).select(
        "user_id", "ts", "ts_ms", "event_id", F.when(e % 7 == 0, "NON_TARGET").when(e % 7 == 1, "OVERLAP").otherwise("TARGET_ACTIVE").alias("verdict_status"),
        (F.pmod(e, F.lit(37)) / 36.0).alias("verdict_confidence"))
    return updates, verdicts


def _targets(joined):
    out = live.target_events(joined).select("event_id", "status", "emotion", "emotion_confidence", "speaker_confidence")
    return rounded(out, "emotion_confidence", "speaker_confidence")


@query("target_events_as_of", "WITH " + TARGETS.replace("__late__", "false"))
def target_events_as_of(spark, sf_dir):
    updates, verdicts = _updates_and_verdicts(spark, sf_dir)
    return _targets(live.verdicts_as_of(updates.drop("ts"), verdicts, HORIZON, keys=["user_id"], order=["event_id"]))


@query("stream_target_events", "WITH " + TARGETS.replace("__late__", "event_id % 5 = 2 AND ts < (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)"))
def stream_target_events(spark, sf_dir):
    """Two streams with a watermark each; the late verdicts arrive in a second run, which goes on from the checkpoint of the first."""
    updates, verdicts = _updates_and_verdicts(spark, sf_dir)
    as_micros = F.timestamp_millis("ts_ms")
    updates, verdicts = updates.withColumn("ts", as_micros), verdicts.withColumn("ts", as_micros)
    span = load(spark, sf_dir, "events").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    late = (F.col("event_id") % 5 == 2) & (F.col("ts") < F.lit(span["a"] + (span["b"] - span["a"]) / 2))
    far = F.timestamp_millis(F.lit(4_102_444_800_000))
    folder = R.shared_folder(spark, "targets")
    first, second = (R.as_stream(df, f"{folder}/{name}") for df, name in ((updates, "updates"), (verdicts.filter(~late), "verdicts")))
    joined = V.join_verdicts(
        first, second, "12 hours", keys=["user_id"], update_id="event_id", order="event_id", update_delay=R.slice_delay(updates), verdict_delay=R.slice_delay(verdicts))
    targets = _targets(joined)
    R.run_available(targets, folder + "/out", folder + "/state")
    verdicts.filter(late).write.mode("append").parquet(f"{folder}/verdicts")
    for df, name in ((updates, "updates"), (verdicts, "verdicts")):  # one row beyond all others closes each stream
        df.limit(1).withColumns({"ts": far, "event_id": F.lit(-1).cast("long")}).write.mode("append").parquet(f"{folder}/{name}")
    R.run_available(targets, folder + "/out", folder + "/state")
    return spark.read.parquet(folder + "/out").filter("event_id >= 0")


@query("current_sessions", """WITH s AS (SELECT user_id, max(event_id // 500) AS cur FROM events GROUP BY user_id) SELECT event_id FROM events JOIN s ON events.user_id IS NOT DISTINCT FROM s.user_id WHERE event_id // 500 = cur""")
def current_sessions(spark, sf_dir):
    df = events(spark, sf_dir).select("event_id", "user_id", F.expr("event_id div 500").alias("session_id"))
    current = df.groupBy("user_id").agg(F.max("session_id").alias("session_id"))
    return K.drop_stale_sessions(df, current, "user_id").select("event_id")


@query("result_payloads", f"""WITH {UPDATES}, g AS (SELECT event_id, emo, q, ar, CASE WHEN rej THEN NULL ELSE emo END AS cand FROM u)
SELECT event_id, cand AS candidate_emotion, cand AS confidence_for, 'NOT_EVALUATED' AS identity_status, {s6('q')} AS confidence, {s6("CASE WHEN emo = 'happy' THEN q ELSE 0 END")} AS happy, {s6("CASE WHEN emo = 'sad' THEN q ELSE 0 END")} AS sad, 4 AS n_scores FROM g""")
def result_payloads(spark, sf_dir):
    e = F.col("event_id")
    name = F.element_at(F.array(*[F.lit(x) for x in settings.EMOTIONS]), (e % 4 + 1).cast("int"))
    df = measured_updates(spark, sf_dir).select(
        "event_id", F.col("ts_ms").alias("timestamp_ms"), "emotion", F.col("emotion").alias("candidate_emotion"),
        F.create_map(name, F.col("confidence")).alias("scores"), "confidence", F.lit(None).cast("string").alias("rejection_reason"),
        (F.col("active_frame_count") > 0).alias("audio_active"), "activity_ratio", "audio_quality",
        F.col("quality_status").alias("audio_quality_status"), "calibration_status", F.col("decision_threshold").alias("rejection_threshold"), "model_version")
    out = df.select("event_id", *C.payload())
    return rounded(out.select("event_id", "candidate_emotion", "confidence_for", "identity_status", "confidence", F.col("scores")["happy"].alias("happy"),
                              F.col("scores")["sad"].alias("sad"), F.size("scores").alias("n_scores")), "confidence", "happy", "sad")


# --- policy --------------------------------------------------------------------------------------
def policy_events(spark, sf_dir):
    e = F.col("event_id")
    return events(spark, sf_dir).select(
        "event_id", F.when(e % 9 == 0, "SIMULATION").otherwise("LIVE").alias("source"),
        F.when(e % 7 != 0, F.element_at(F.array(*[F.lit(x) for x in settings.EMOTIONS]), (e % 4 + 1).cast("int"))).alias("emotion"),
        F.when(e % 6 == 0, "UNCERTAIN").otherwise("TARGET_ACTIVE").alias("status"), (F.col("value") / 60.0).alias("emotion_confidence"),
        (F.pmod(e, F.lit(41)) / 40.0).alias("speaker_confidence"), (F.pmod(e, F.lit(11)) / 10.0).alias("audio_quality"),
        "ts_ms", (e % 3 == 0).alias("night_mode"), (e % 8 != 0).alias("automatic"))


POLICY = """p AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'SIMULATION' ELSE 'LIVE' END AS source, CASE WHEN event_id % 7 <> 0 THEN ['neutral','happy','angry','sad'][event_id % 4 + 1] END AS emotion,
 CASE WHEN event_id % 6 = 0 THEN 'UNCERTAIN' ELSE 'TARGET_ACTIVE' END AS status, value / 60.0::DOUBLE AS ec, event_id % 41 / 40 AS sc, event_id % 11 / 10 AS aq, event_id % 3 = 0 AS night, event_id % 8 <> 0 AS auto FROM events),
 c AS (SELECT *, CASE emotion WHEN 'neutral' THEN [244,231,210] WHEN 'happy' THEN [255,224,158] WHEN 'angry' THEN [178,205,194] WHEN 'sad' THEN [255,197,120] END AS rgb,
  least(CASE emotion WHEN 'neutral' THEN 0.24 WHEN 'happy' THEN 0.34 WHEN 'angry' THEN 0.2 WHEN 'sad' THEN 0.22 END, CASE WHEN night THEN 0.12 ELSE 0.4 END)::DOUBLE AS brightness FROM p)"""
TRUSTED = "source = 'LIVE' AND emotion IS NOT NULL AND status = 'TARGET_ACTIVE' AND ec >= 0.7 AND sc >= 0.8 AND aq >= 0.5"


@query("trusted_events", f"WITH {POLICY} SELECT event_id FROM p WHERE {TRUSTED} AND auto")
def trusted_events(spark, sf_dir):
    return L.trusted(policy_events(spark, sf_dir), automatic="automatic").select("event_id")


@query("light_commands", f"WITH {POLICY} SELECT event_id, rgb, brightness, 3000 AS transition_ms, 'steady' AS effect, 'automatic' AS mode, false AS simulation FROM c WHERE {TRUSTED}")
def light_commands(spark, sf_dir):
    return L.to_commands(L.trusted(policy_events(spark, sf_dir))).select(
        "event_id", "rgb", "brightness", "transition_ms", "effect", "mode", "simulation")


@query("routed_commands", f"WITH {POLICY} SELECT event_id, brightness, false AS simulation FROM c WHERE {TRUSTED} AND auto UNION ALL SELECT event_id, brightness, true FROM c WHERE source = 'SIMULATION' AND emotion IS NOT NULL AND status = 'TARGET_ACTIVE'")
def routed_commands(spark, sf_dir):
    shown, preview = L.route_by_source(policy_events(spark, sf_dir), automatic="automatic")
    return shown.unionByName(preview).select("event_id", "brightness", "simulation")


@query("reclamped_levels", "SELECT event_id, least(value / 400.0::DOUBLE, 0.12)::DOUBLE AS brightness FROM events")
def reclamped_levels(spark, sf_dir):
    return L.reclamp(events(spark, sf_dir).select("event_id", (F.col("value") / 400.0).alias("brightness")))


@query("event_constraints", """SELECT event_id, CASE WHEN value / 300.0::DOUBLE > 1 THEN 'emotion_confidence' WHEN event_id % 41 / 40 > 1 THEN 'speaker_confidence' WHEN event_id % 12 / 10 > 1 THEN 'audio_quality' WHEN event_id % 101 = 0 THEN 'timestamp_ms'
 WHEN event_id % 6 = 0 AND event_id % 7 <> 0 THEN 'emotion_without_model' WHEN event_id % 50 / 40 > 1 THEN 'decision_threshold' END AS violation FROM events""")
def event_constraints(spark, sf_dir):
    e = F.col("event_id")
    df = events(spark, sf_dir).select(
        "event_id", (F.col("value") / 300.0).alias("emotion_confidence"), (F.pmod(e, F.lit(41)) / 40.0).alias("speaker_confidence"),
        (F.pmod(e, F.lit(12)) / 10.0).alias("audio_quality"), F.when(e % 101 == 0, F.lit(-1)).otherwise(e).alias("timestamp_ms"),
        F.when(e % 6 == 0, "NOT_CONFIGURED").otherwise("TARGET_ACTIVE").alias("status"), F.when(e % 7 != 0, "happy").alias("emotion"),
        (F.pmod(e, F.lit(50)) / 40.0).alias("decision_threshold"))
    return df.select("event_id", C.event_violation().alias("violation"))


@query("prediction_constraints", """SELECT event_id, CASE WHEN value / 300.0::DOUBLE > 1 THEN 'confidence' WHEN event_id % 43 / 40 > 1 THEN 'scores' WHEN event_id % 12 / 10 > 1 THEN 'audio_quality'
 WHEN event_id % 8 = 0 THEN 'rejection_status' WHEN event_id % 6 = 0 AND event_id % 7 <> 0 THEN 'emotion_without_model' END AS violation FROM events""")
def prediction_constraints(spark, sf_dir):
    e = F.col("event_id")
    df = events(spark, sf_dir).select(
        "event_id", (F.col("value") / 300.0).alias("confidence"), F.create_map(F.lit("happy"), F.pmod(e, F.lit(43)) / 40.0).alias("scores"),
        (F.pmod(e, F.lit(12)) / 10.0).alias("audio_quality"), e.alias("timestamp_ms"), F.lit(None).cast("double").alias("decision_threshold"),
        F.when(e % 8 == 0, "SILENCE").alias("rejection_status"), F.when(e % 6 == 0, "INVALID").otherwise("READY").alias("model_status"),
        F.when(e % 7 != 0, "happy").alias("emotion"))
    return df.select("event_id", C.prediction_violation().alias("violation"))


@query("derived_status", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'UNCERTAIN' WHEN event_id % 5 = 1 THEN 'LOW_QUALITY' WHEN event_id % 3 = 0 THEN 'NOT_CONFIGURED' ELSE 'UNCERTAIN' END AS status,
 CASE WHEN event_id % 7 = 0 AND event_id % 4 = 0 THEN 'NOT_CONFIGURED' ELSE 'READY' END AS legacy_model, CASE WHEN event_id % 7 = 0 AND event_id % 4 = 1 THEN 'UNCERTAIN' END AS legacy_rejection FROM events""")
def derived_status(spark, sf_dir):
    e = F.col("event_id")
    df = events(spark, sf_dir).select(
        "event_id", F.when(e % 5 == 0, "UNCERTAIN").when(e % 5 == 1, "LOW_QUALITY").alias("rejection_status"),
        F.when(e % 3 == 0, "INVALID").otherwise("READY").alias("model_status"), F.when(e % 7 != 0, "happy").alias("emotion"),
        F.when(e % 4 == 0, "NOT_CONFIGURED").when(e % 4 == 1, "UNCERTAIN").otherwise("SILENCE").alias("old_status"), F.lit(0.5).alias("emotion_confidence"))
    legacy = C.normalise_legacy("emotion", "old_status")
    return df.select("event_id", C.prediction_status().alias("status"), legacy["model_status"].alias("legacy_model"), legacy["rejection_status"].alias("legacy_rejection"))


@query("unconfigured_predictions", """SELECT event_id, NULL::VARCHAR AS emotion, 'NOT_CONFIGURED' AS model_status, CASE WHEN event_id % 11 = 0 THEN 'LOW_QUALITY' END AS rejection_status FROM events""")
def unconfigured_predictions(spark, sf_dir):
    df = measured_updates(spark, sf_dir).withColumn("p", C.unconfigured_prediction())
    return df.select("event_id", "p.emotion", "p.model_status", "p.rejection_status")


@query("redacted_rows", """SELECT event_id, '{"k":' || event_id || ',"inner":{"note":"' || event_type || '"},"items":[{"v":' || user_id || '}]}' AS shown, '{"label":"x","k":' || (event_id + 1) || '}' AS json_shown FROM events""")
def redacted_rows(spark, sf_dir):
    row = F.struct(
        F.col("event_id").alias("k"), F.col("user_id").alias("speaker_id"),
        F.struct(F.col("event_type").alias("note"), F.array(F.col("user_id")).alias("test_speaker_ids")).alias("inner"),
        F.array(F.struct(F.col("user_id").alias("v"), F.col("event_type").alias("speaker_name"))).alias("items"))
    df = events(spark, sf_dir).select("event_id", row.alias("r"))
    text = F.concat(F.lit('{"label": "x", "speaker_ids": [1, 2], "k": '), (F.col("event_id") + 1).cast("string"), F.lit("}"))
    shown = C.drop_private_fields(F.col("r"), df.schema["r"].dataType, settings.REPORT_PRIVATE_KEYS)
    return df.select("event_id", F.to_json(shown).alias("shown"), C.redact_json(text).alias("json_shown"))


@query("withheld_counts", """SELECT user_id, count(*) FILTER (event_id % 10 >= 2) AS train, count(*) FILTER (event_id % 10 = 1) AS validation, false AS has_test FROM events GROUP BY user_id""")
def withheld_counts(spark, sf_dir):
    m = F.pmod("event_id", F.lit(10))
    counts = events(spark, sf_dir).groupBy("user_id").agg(F.create_map(
        F.lit("train"), F.count_if(m >= 2), F.lit("validation"), F.count_if(m == 1), F.lit("test"), F.count_if(m == 0)).alias("c"))
    shown = counts.select("user_id", C.withhold_split("c").alias("c"))
    return shown.select("user_id", F.col("c")["train"].alias("train"), F.col("c")["validation"].alias("validation"), F.map_contains_key("c", F.lit("test")).alias("has_test"))
