"""Stateful stream operators, one fold per stream key.

Micro-batches may deliver rows out of order, and every fold here depends on the
order.  So each operator keeps rows in its state until the watermark has passed them,
then folds them by time and tie-break; rows older than the watermark are dropped by Spark.
A row with ``is_end`` set releases what is held and erases the state of its key, and so does
a timeout where a key has been silent for ``erase_after_ms``.

``replay.run_available`` runs queries over these operators with RocksDB as the state store.
"""

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _plain(value):
    """The value without arrays, and without NaN for a missing one."""
    if isinstance(value, np.ndarray):
        return value.tolist()
    return None if isinstance(value, float) and value != value else value


def _by_time(row: tuple):
    return row[0], row[3], row[1]


class OrderedFold:
    """Fold the rows of each key in the order of ``(ts_ms, tie)`` once the watermark has passed them.

    ``step(state, row)`` takes the state as a tuple, None at first, and a row ``(ts_ms, tie, value, is_end)``; it returns the new
    state and what to emit, or None.  State per key: the fold's own value, the rows still inside the watermark delay, the last time seen.
    Spark hands rows and state over by buckets of keys: a bucket's rows come as slices of Arrow batches, and its state is one
    pickled entry for the rows that each micro-batch has brought, the first time among them, one entry for the values of all its keys,
    and the time when the first of these has been silent for long enough.
    """

    STATE = "held array<binary>, first long, folds binary, erase long"

    def __init__(self, step: Callable, emitted: list[str], keys: list[str], erase_after_ms: int | None, order: Callable = _by_time):
        self.order = order
        self.step, self.emitted, self.keys, self.erase_after_ms = step, emitted, keys, erase_after_ms

    def _rows(self, frame: pd.DataFrame) -> Iterator[tuple]:
        """Rows ``(key, ts_ms, tie, value, is_end)`` of a frame."""
        keys = zip(*[map(_plain, frame[k].tolist()) for k in self.keys])
        rest = [frame[c].tolist() for c in ("ts_ms", "tie", "value", "is_end")]
        return zip(keys, rest[0], rest[1], map(_plain, rest[2]), rest[3])

    def __call__(self, bucket: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, first, packed, erase = state.get if state.exists else ([], None, None, None)
        held, watermark = list(held), state.getCurrentWatermarkMs()
        new = [r for frame in frames for r in self._rows(frame)]
        ended = {r[0] for r in new if r[4]}
        first = min([r[1] for r in new] + ([] if first is None else [first]), default=None)
        if ended or any(t is not None and t <= watermark for t in (first, erase)):
            folds = pickle.loads(packed) if packed is not None else {}  # key to state and last time
            due, rest = [], []
            for row in [r for entry in held for r in pickle.loads(entry)] + new:
                (due if row[1] <= watermark or row[0] in ended else rest).append(row)
            out = self._folded(due, folds, watermark, {r[0] for r in rest})
            if out:
                yield pd.DataFrame({c: list(v) for c, v in zip([*self.keys, *self.emitted], zip(*out))})
            held, new, first = [], rest, min((r[1] for r in rest), default=None)
            packed = pickle.dumps(folds) if folds else None
            erase = min(last for _, last in folds.values()) + self.erase_after_ms if folds and self.erase_after_ms is not None else None
        if new:
            held.append(pickle.dumps(new))
        if held or packed is not None:
            state.update((held, first, packed, erase))
            times = [t for t in (first, erase) if t is not None]
            if times:  # a timeout comes when the watermark is beyond its time
                state.setTimeoutTimestamp(max(min(times) - 1, watermark + 1, 1))
        elif state.exists:
            state.remove()

    def _folded(self, rows: list[tuple], folds: dict, watermark: int, waiting: set) -> list[tuple]:
        """Fold rows that are due into ``folds``; erase the keys that are silent and wait for nothing."""
        by_key, out = {}, []
        for row in rows:
            by_key.setdefault(row[0], []).append(row[1:])
        for key, own in by_key.items():
            own.sort(key=self.order)
            state = folds.pop(key, (None, None))[0]
            for row in own:
                state, emitted = (None, None) if row[3] else self.step(state, row)
                if emitted is not None:
                    out.append((*key, *emitted))
            if state is not None:
                folds[key] = (state, own[-1][0])
        if self.erase_after_ms is not None:
            for key in [k for k, (_, last) in folds.items() if last + self.erase_after_ms <= watermark and k not in waiting]:
                del folds[key]
        return out


def folded_by_bucket(rows: DataFrame, fold: OrderedFold, output: str) -> DataFrame:
    """The fold over rows with a watermark and a ``_bucket``."""
    return rows.groupBy("_bucket").applyInPandasWithState(
        lambda bucket, frames, state: fold(bucket, frames, state), output, OrderedFold.STATE, "append", GroupStateTimeout.EventTimeTimeout)


BUCKETS = 512  # of keys in the state store; all rows of a bucket inside the watermark delay are in one task's memory when they are folded


def _folded(
    stream: DataFrame, fold: OrderedFold, keys: list[str], ts: str, tie: str | None, value: str, output: str, delay: str, buckets: int,
) -> DataFrame:
    tied = F.lit(0).cast("long") if tie is None else F.col(tie).cast("long")
    rows = stream.select(
        F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket"), *[F.col(k).cast("string").alias(k) for k in keys], F.col(ts).alias("ts"), "ts_ms",
        F.coalesce(tied, F.lit(0).cast("long")).alias("tie"), F.col(value).alias("value"), F.coalesce("is_end", F.lit(False)).alias("is_end"))
    return folded_by_bucket(rows.withWatermark("ts", delay), fold, output)


def rolling_windows(
    stream: DataFrame, window: int, interval_ms: int, *, keys: tuple[str, ...] = ("stream_id", "session_id"),
    ts: str = "ts", tie: str | None = None, delay: str = "2 seconds", erase_after_ms: int | None = None, buckets: int = BUCKETS,
) -> DataFrame:
    """Last ``window`` samples of each key, emitted at least ``interval_ms`` apart.

    Nothing is emitted before the window is full.  State per key is the window plus the
    rows still inside the watermark delay.  Input: key columns, event time ``ts``,
    ``ts_ms``, ``samples`` and ``is_end``; ``tie`` orders rows of one instant.
    """
    keys = list(keys)

    def step(state, row):
        tail, last = state if state is not None else ([], -1)
        now, samples = row[0], row[2]
        if samples is not None and len(samples):
            tail = [*tail, *samples][-window:]
        due = len(tail) == window and (last < 0 or now - last >= interval_ms)
        return (tail, now if due else last), ((now, tail) if due else None)

    fold = OrderedFold(step, ["ts_ms", "samples"], keys, erase_after_ms)
    output = ", ".join(f"{k} string" for k in keys) + ", ts_ms long, samples array<float>"
    # the filter makes Spark hand compact rows to whatever Arrow step follows
    return _folded(stream, fold, keys, ts, tie, "samples", output, delay, buckets).filter(F.size("samples") == window)


def smooth_stream(
    stream: DataFrame, *, label: str = "candidate_emotion", keys: tuple[str, ...] = ("stream_id", "session_id"),
    ts: str = "ts", tie: str | None = None, delay: str = "2 seconds", erase_after_ms: int | None = None, buckets: int = BUCKETS,
) -> DataFrame:
    """Label hysteresis on a stream of updates; a NULL label resets the key's state.

    State per key: at most three recent labels, the shown label, and held rows.
    """
    keys = list(keys)

    def step(state, row):
        recent, shown = state if state is not None else ([], None)
        if row[2] is None:
            return ([], None), (row[0], None, None)
        recent = [*recent, row[2]][-3:]
        shown = row[2] if shown is None or recent.count(row[2]) >= 2 else shown
        return (recent, shown), (row[0], row[2], shown)

    fold = OrderedFold(step, ["ts_ms", "label", "smoothed"], keys, erase_after_ms)
    output = ", ".join(f"{k} string" for k in keys) + ", ts_ms long, label string, smoothed string"
    return _folded(stream, fold, keys, ts, tie, label, output, delay, buckets)


def drop_stale_sessions(df: DataFrame, sessions: DataFrame, key: str = "stream_id") -> DataFrame:
    """Rows of the session that is current for their stream; older sessions are ignored.

    Works for a batch and for a stream joined to a small table of open sessions.  Rows without a key are one stream.
    """
    current = sessions.select(F.col(key).alias("_key"), F.col("session_id").alias("_current"))
    return df.join(current, F.col(key).eqNullSafe(F.col("_key"))).filter(
        F.col("session_id") == F.col("_current")).drop("_key", "_current")


def sliding_activity(
    stream: DataFrame, *, key: str | list[str] = "stream_id", ts: str = "ts", level: str = "energy_rms", threshold: float = 0.01,
    window: str = "1500 milliseconds", slide: str = "500 milliseconds", delay: str = "2 seconds",
) -> DataFrame:
    """Clock-aligned sliding activity per key with a watermark (built-in window aggregation)."""
    keys = [key] if isinstance(key, str) else key
    return (
        stream.withWatermark(ts, delay).groupBy(F.window(ts, window, slide).alias("w"), *keys)
        .agg(F.count("*").alias("frames"), F.count_if(F.col(level) >= threshold).alias("active_frames"), F.max(level).alias("peak"))
        .select(*keys, F.col("w.start").alias("window_start"), "frames", "active_frames",
                (F.col("active_frames") / F.col("frames")).alias("activity_ratio"), "peak")
    )


def latest_only(handle: Callable[[DataFrame], None], keys: list[str], order: list[str]):
    """A ``foreachBatch`` function that hands on only the newest row per key."""
    from sonoframe.operators.history import latest_per_key

    def process(batch: DataFrame, _: int) -> None:
        handle(latest_per_key(batch, keys, order))

    return process
