"""Running stored rows through the stream operators."""

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sonoframe.operators.frames import replay_frames
from sonoframe.session import local_folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder of the session."""
    context = spark.sparkContext
    root = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir", None)
    if root is None:  # only without a configured cluster folder, as in tests
        root = local_folder(spark)
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def frames_with_end(series: DataFrame, frame_ms: int = 20, *, key: str = "stream_id") -> DataFrame:
    """Timed capture frames of stored series, closed by one end row per stream."""
    frames = replay_frames(series, frame_ms).withColumn("is_end", F.lit(False))
    ends = series.select(
        *[c for c in series.columns if c != "samples"], F.array().cast("array<float>").alias("samples"),
        (F.ceil(F.size("samples") * 1000.0 / F.col("sample_rate")) + 1).cast("long").alias("ts_ms"), F.lit(True).alias("is_end"))
    both = frames.unionByName(ends)
    if "session_id" not in both.columns:
        both = both.withColumn("session_id", F.lit("0"))
    return both.withColumn("ts", F.timestamp_millis("ts_ms")).select(
        F.col(key).cast("string").alias("stream_id"), "session_id", "sample_rate", "ts", "ts_ms", "samples", "is_end")


# counting the rows of the state would look every key up once more at each put and removal
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def run_available(stream: DataFrame, path: str, checkpoint: str, *, mode: str = "append") -> StreamingQuery:
    """Process everything the source has now into Parquet and stop; keyed state lives in RocksDB.  Returns the ended query."""
    conf = stream.sparkSession.conf
    before = {name: conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        conf.set(name, value)
    try:
        query = (
            stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode(mode).trigger(availableNow=True).start()
        )
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)
    query.awaitTermination()
    return query


def as_stream(df: DataFrame, folder: str, *, closing: DataFrame | None = None, slices: int = 3) -> DataFrame:
    """Write rows as consecutive time slices and read them back as a stream, about a slice in each micro-batch.

    Slices are written one after the other, so the file source lists them in time
    order, and the closing rows come last.  However many files a slice has, the micro-batches are as
    many as the slices, and one for the closing rows.  Files of one slice may be read in any
    order, and a micro-batch may reach into the next slice: use a watermark delay of at least one slice length, as returned by
    ``slice_delay``.  Rows without a time have no place in a stream: they go to
    ``<folder>-untimed`` as Parquet, and a warning tells how many they are.
    """
    spark = df.sparkSession
    span = df.agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count_if(F.col("ts").isNull()).alias("untimed")).first()
    if span["untimed"]:
        df.filter(F.col("ts").isNull()).write.mode("append").parquet(f"{folder}-untimed")
        warnings.warn(f"{span['untimed']} rows without a time are not streamed; they are in {folder}-untimed", stacklevel=2)
    step = (span["b"] - span["a"]) / slices
    for i in range(slices):
        part = F.col("ts") >= F.lit(span["a"] + i * step)
        if i + 1 < slices:
            part = part & (F.col("ts") < F.lit(span["a"] + (i + 1) * step))
        df.filter(F.col("ts").isNotNull() if i == 0 and slices == 1 else part).write.mode("append").parquet(folder)
    if closing is not None:
        closing.select(*df.columns).write.mode("append").parquet(folder)
    files = len(spark.read.schema(df.schema).parquet(folder).inputFiles())
    batches = slices + (closing is not None)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(folder)


def slice_delay(df: DataFrame, slices: int = 3) -> str:
    """A watermark delay that covers one slice of ``as_stream``."""
    span = df.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    return f"{int((span['b'] - span['a']).total_seconds() / slices) + 2} seconds"


RESULT_COLUMNS = (
    "ts_ms", "candidate_emotion", "confidence", "scores", "rejection_reason", "active_frame_count", "activity_ratio",
    "audio_quality", "quality_status", "calibration_status", "decision_threshold", "model_version",
)


def live_columns(scored: DataFrame, classes) -> DataFrame:
    """Scored updates without samples; class scores become a map."""
    names = F.array(*[F.lit(c) for c in classes])
    return scored.withColumn("scores", F.map_from_arrays(names, F.coalesce("scores", F.array_repeat(F.lit(0.0), len(classes))))).select(
        "stream_id", "session_id", *RESULT_COLUMNS)


def to_results(scored: DataFrame, smoothed: DataFrame) -> DataFrame:
    """Result payloads of updates joined with their smoothed labels."""
    from sonoframe.functions.checks import payload

    joined = scored.join(smoothed.select("stream_id", "session_id", "ts_ms", F.col("smoothed").alias("emotion")), ["stream_id", "session_id", "ts_ms"])
    ready = (
        joined.withColumnRenamed("ts_ms", "timestamp_ms").withColumnRenamed("quality_status", "audio_quality_status")
        .withColumnRenamed("decision_threshold", "rejection_threshold").withColumn("audio_active", F.col("active_frame_count") > 0))
    return ready.select("stream_id", "session_id", *payload())


def run_replay(series: DataFrame, model: dict, folder: str, *, frame_ms: int = 20, slices: int = 3) -> DataFrame:
    """Replay stored series through the streaming path and return result payloads.

    Two chained stream jobs: frames become scored updates (rolling window and throttle
    are stateful, scoring is not), then updates are smoothed.  ``series`` carries
    ``stream_id, sample_rate, samples``.
    """
    from sonoframe.plans.live import score_updates
    from sonoframe.streaming.rolling import rolling_windows, smooth_stream

    spark = series.sparkSession
    rate = int(model["sample_rate"])
    frames = frames_with_end(series.filter(F.col("sample_rate") == rate), frame_ms).drop("sample_rate")
    body, ends = frames.filter(~F.col("is_end")), frames.filter("is_end")
    windows = rolling_windows(
        as_stream(body, f"{folder}/frames", closing=ends, slices=slices), round(rate * model["window_s"]),
        round(model["update_interval_s"] * 1000), delay=slice_delay(body, slices))
    scored = live_columns(score_updates(windows.withColumn("sample_rate", F.lit(rate)), model), model["classes"])
    run_available(scored, f"{folder}/updates", f"{folder}/updates-state")
    updates = spark.read.schema(scored.schema).parquet(f"{folder}/updates")
    timed = updates.select("stream_id", "session_id", F.timestamp_millis("ts_ms").alias("ts"), "ts_ms", "candidate_emotion", F.lit(False).alias("is_end"))
    closing = ends.select("stream_id", "session_id", "ts", "ts_ms", F.lit(None).cast("string").alias("candidate_emotion"), "is_end")
    labels = smooth_stream(as_stream(timed, f"{folder}/labels", closing=closing, slices=1), delay=slice_delay(body, 1))
    run_available(labels, f"{folder}/smoothed", f"{folder}/smoothed-state")
    return to_results(updates, spark.read.schema(labels.schema).parquet(f"{folder}/smoothed"))


def replay_in_batch(series: DataFrame, model: dict, *, frame_ms: int = 20) -> DataFrame:
    """The same results without streams: emission points and labels folded in batch."""
    from sonoframe.operators.history import smooth_labels
    from sonoframe.plans.live import score_updates, series_updates

    rate = int(model["sample_rate"])
    stored = series.filter(F.col("sample_rate") == rate).withColumn("stream_id", F.col("stream_id").cast("string"))
    if "session_id" not in stored.columns:
        stored = stored.withColumn("session_id", F.lit("0"))
    updates = series_updates(
        stored.select("stream_id", "session_id", "sample_rate", "samples"), model["window_s"], model["update_interval_s"], frame_ms=frame_ms)
    scored = live_columns(score_updates(updates, model), model["classes"])
    smoothed = smooth_labels(
        scored.select("stream_id", "session_id", "ts_ms", "candidate_emotion"), ["stream_id", "session_id"], "ts_ms", "candidate_emotion")
    return to_results(scored, smoothed)
