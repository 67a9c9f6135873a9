"""Joining a stream of updates to a stream of identity verdicts."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.streaming.rolling import BUCKETS, OrderedFold, folded_by_bucket

# carried columns pass the fold as JSON, so they keep their types; times keep their microseconds
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _verdicts_first(row: tuple):
    _, tie, (kind, micros, *_), _ = row
    return int(micros), kind != "verdict", tie


def _newest(state, row):
    """Step: the newest verdict of the key so far and the last update, by time and id; an update comes out once."""
    at, said, last = state if state is not None else (None, None, None)
    _, tie, (kind, micros, since, carried), _ = row
    if kind == "verdict":
        return (int(micros), carried, last), None
    if last == (micros, tie):
        return state, None
    return (at, said, (micros, tie)), (carried, said if at is not None and at > int(since) else None)


def join_verdicts(
    updates: DataFrame, verdicts: DataFrame, horizon: str = "1500 milliseconds", *, keys: Sequence[str] = ("stream_id", "session_id"),
    update_id: str = "update_id", order: str = "verdict_id", ts: str = "ts", update_delay: str = "2 seconds", verdict_delay: str = "2 seconds",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Updates of a stream with ``verdict_status`` and ``verdict_confidence`` of the newest verdict of their key.

    A verdict counts for updates from its own time on, for less than ``horizon``.  Each side has a watermark, and the lesser one counts: up to it,
    the rows of both sides are folded by time, verdicts first, ties by ``order``, so each update meets the newest verdict alone and comes out
    once, however many verdicts its horizon holds.  An update without one comes with NULL, which ``target_events`` reads as
    NOT_CONFIGURED.  Verdicts later than the watermark are dropped by Spark and change nothing.  State per key is the newest verdict, until the key has
    been silent for the horizon, and the rows still inside the delays.  Missing keys are equal; rows without a time do not take part.

    ``verdicts`` has the key columns, ``ts``, ``order``, ``verdict_status`` and ``verdict_confidence``; ``order`` and ``update_id`` are whole numbers.
    """
    keys = list(keys)
    for df, name in ((updates, update_id), (verdicts, order)):
        if not isinstance(df.schema[name].dataType, T.IntegralType):
            raise ValueError(f"{name} must be a whole number")
    said = F.struct("verdict_status", "verdict_confidence")

    def rows(df: DataFrame, kind: str, tie: str, since: Column, carried: Column, delay: str) -> DataFrame:
        named = [F.col(k).cast("string").alias(f"key{n}") for n, k in enumerate(keys)]
        value = F.array(F.lit(kind), F.unix_micros(ts).cast("string"), F.unix_micros(since).cast("string"), F.to_json(carried, JSON))
        return df.filter(F.col(ts).isNotNull()).select(
            F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).alias("_bucket"), *named, F.col(ts).alias("ts"), F.unix_millis(ts).alias("ts_ms"),
            F.coalesce(F.col(tie).cast("long"), F.lit(-(2**63))).alias("tie"), value.alias("value"), F.lit(False).alias("is_end")).withWatermark("ts", delay)

    whole = F.struct(*updates.columns)
    update_type, said_type = updates.select(whole.alias("c")).schema["c"].dataType, verdicts.select(said.alias("c")).schema["c"].dataType
    both = rows(updates, "update", update_id, F.col(ts) - F.expr(f"INTERVAL {horizon}"), whole, update_delay).union(
        rows(verdicts, "verdict", order, F.col(ts), said, verdict_delay))
    silent = updates.sparkSession.sql(f"SELECT unix_millis(timestamp_seconds(0) + INTERVAL {horizon})").first()[0]
    fold = OrderedFold(_newest, ["row", "said"], [f"key{n}" for n in range(len(keys))], int(silent) + 1, _verdicts_first)
    output = ", ".join([*[f"key{n} string" for n in range(len(keys))], "row string", "said string"])
    found = folded_by_bucket(both, fold, output).select(
        F.from_json("row", update_type, JSON).alias("_row"), F.from_json("said", said_type, JSON).alias("_said"))
    rest = [c for c in updates.columns if c not in (*keys, ts, update_id)]
    return found.select(*[F.col("_row")[c].alias(c) for c in (*keys, ts, update_id, *rest)], "_said.verdict_status", "_said.verdict_confidence")
