"""Batch forms of the stream operators: the same folds over stored, ordered rows.

``partitions`` sets how finely ordered rows are dealt out; Spark chooses it by size when it is left out, and
results do not depend on it.
"""

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.operators import ordering as O
from sonoframe.session import checkpoint


def epoch_ms(df: DataFrame, column: str) -> Column:
    """Milliseconds since 1970 of a timestamp column, without the session time zone."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.floor(F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})") / 1000).cast("long")
    return F.unix_millis(column)


def smooth_labels(df: DataFrame, key: Sequence[str] | str, order: Sequence[str] | str, label: str, *, partitions: int | None = None) -> DataFrame:
    """Hysteresis over accepted labels; a NULL label is a rejection and resets.

    The first accepted label shows at once; another one takes over when it fills
    two of the last three accepted rows since the last rejection.
    """
    near = O.previous_in_runs(O.keyed_runs(df, key, order, partitions), F.col(label), 2, "_near")
    # previous labels back to the last rejection
    first, second = F.get("_near", F.lit(0)), F.get("_near", F.lit(1))
    starts_run = first.isNull()
    repeated = (first == F.col(label)) | (first.isNotNull() & (second == F.col(label)))
    nothing = F.lit(None).cast("string")
    mark = F.when(F.col(label).isNull(), F.struct(nothing.alias("shown"))).when(
        starts_run | F.coalesce(repeated, F.lit(False)), F.struct(F.col(label).alias("shown")))
    held = O.without_runs(O.last_in_runs(near, mark, "_held"))
    return held.withColumn("smoothed", F.when(F.col(label).isNotNull(), F.col("_held.shown"))).drop("_near", "_held")


def monotonic_only(df: DataFrame, key: str, arrival: str, ts: str, *, partitions: int | None = None) -> DataFrame:
    """Rows newer than everything that arrived before them."""
    seen = O.carry_max(df, key, arrival, ts, "_newest", partitions=partitions)
    return seen.filter(F.col("_newest").isNull() | (F.col(ts) > F.col("_newest"))).drop("_newest")


def latest_per_key(df: DataFrame, keys: Sequence[str] | str, order: Sequence[str] | str) -> DataFrame:
    """Newest row per key and the number of rows it replaced (partial aggregation)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"), (F.count("*") - 1).alias("replaced_count"))
    return newest.select(*keys, "_row.*", "replaced_count")


def recent_n(df: DataFrame, key: str, order: Sequence[str] | str, n: int = 12, *, partitions: int | None = None) -> DataFrame:
    """The newest ``n`` rows per key, with ``recency`` 1 for the newest."""
    return O.newest_rows(df, key, order, n, "recency", partitions=partitions)


def keep_newest(df: DataFrame, key: str, order: Sequence[str] | str, n: int, *, partitions: int | None = None) -> DataFrame:
    """The newest ``n`` rows per key and how many older rows the key dropped."""
    kept = O.newest_rows(df, key, order, n, "_recency", partitions=partitions).drop("_recency")
    totals = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_total"))
    return kept.join(totals, F.col(key).eqNullSafe(F.col("_key"))).drop("_key").withColumn(
        "dropped_count", F.greatest(F.col("_total") - F.lit(n), F.lit(0).cast("long"))).drop("_total")


def rolling_summary(
    df: DataFrame, key: str, order: Sequence[str] | str, value: str, n: int = 4096, *, partitions: int | None = None
) -> DataFrame:
    """Lifetime count and the median and p95 of the last ``n`` values of each key."""
    if n <= 0:
        raise ValueError("the capacity must be positive")
    # at most n rows per key reach the percentile
    kept = O.newest_rows(df, key, order, n, "_recency", partitions=partitions).groupBy(F.col(key).alias("_key")).agg(
        F.count("*").alias("retained_count"), F.percentile(value, F.lit(0.5)).alias("median"),
        F.percentile(value, F.lit(0.95)).alias("p95"))
    return df.groupBy(key).agg(F.count("*").alias("sample_count")).join(
        kept, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


# --- greedy throttle --------------------------------------------------------------------
# Whether a row passes depends on all earlier rows of its key.  Within a run of rows the
# answer only depends on which row passes first, so a run is a map from possible first
# passing times to the last time it lets through.  Maps of neighbouring runs compose, and
# composing is associative: pairs of runs, pairs of pairs and so on are composed in rounds,
# and then the rounds are walked back to give every run the last time passed before it.
_MAPS = "node long, first long, last long"


def _run_maps(interval_ms: int):
    """Kernel over a whole partition of sorted rows (_key, _part, _t): the maps of its first and last run, which others may continue."""

    def of_run(key, part, t):
        t = np.unique(t)
        following = np.searchsorted(t, t + interval_ms)
        exits = np.arange(len(t))
        for i in np.flatnonzero(following < len(t))[::-1]:  # the later end of a chain is known first
            exits[i] = exits[following[i]]
        possible = min(int(np.searchsorted(t, t[0] + interval_ms)) + 1, len(t))
        return pa.RecordBatch.from_arrays([
            pa.array([key] * possible, pa.string()), pa.array([part] * possible, pa.int64()), pa.array(t[:possible], pa.int64()), pa.array(t[exits[:possible]], pa.int64())],
            ["_key", "node", "first", "last"])

    def run(batches):
        key, part, times, open_first = None, None, [], True
        for batch in batches:
            keys, parts, t = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            if not len(keys):
                continue
            starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(starts, starts[1:]):
                if part is not None and keys[a] != key:
                    if open_first:
                        yield of_run(key, part, np.concatenate(times))
                        open_first = False
                    times = []
                key, part = keys[a], int(parts[a])
                times.append(t[a:b])
        if part is not None:
            yield of_run(key, part, np.concatenate(times))

    return run


def _composed(interval_ms: int):
    """Pandas kernel: the map of two neighbouring nodes of a key from their maps; one without a neighbour stays as it is."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["node", "first"])
        left, right = rows[rows["node"] % 2 == 0], rows[rows["node"] % 2 == 1]
        if len(left) and len(right):
            first, last = right["first"].to_numpy(), right["last"].to_numpy()
            enters = np.searchsorted(first, left["last"].to_numpy() + interval_ms)
            onward = np.where(enters < len(first), last[np.minimum(enters, len(first) - 1)], left["last"].to_numpy())
            left = left.assign(last=onward)
            # what no row of the left lets begin may begin in the right, up to an interval after the first row of all
            begin, until = left["first"].iloc[-1], left["first"].iloc[0] + interval_ms
            more = right.iloc[int(np.searchsorted(first, begin, "right")):int(np.searchsorted(first, until)) + 1] if begin < until else right.iloc[:0]
            rows = pd.concat([left, more])
        return rows.assign(node=rows["node"] // 2)[["_key", "node", "first", "last"]]

    return run


def _passing(interval_ms: int):
    """Kernel over a whole partition of sorted rows: those that pass, given the last time passed before its first run."""

    def run(batches):
        last, key = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            found, times, entry = (batch.column(names.index(c)) for c in ("_text", "_t", "_entry"))
            found, times = found.to_numpy(zero_copy_only=False), times.to_numpy()
            starts = [0, *(np.flatnonzero(found[1:] != found[:-1]) + 1).tolist(), len(found)]
            kept = []
            for a, b in zip(starts, starts[1:]):
                if found[a] != key:
                    key, last = found[a], entry[a].as_py()
                i = a
                while True:
                    i = i if last is None else a + int(np.searchsorted(times[a:b], last + interval_ms))
                    if i >= b:
                        break
                    kept.append(i)
                    last = int(times[i])
            yield batch.take(pa.array(kept, pa.int64())).select([c for c in names if c not in ("_text", "_t", "_entry")])

    return run


def throttle(
    df: DataFrame, key: Sequence[str] | str, ts_ms: str, interval_ms: int, *, order: Sequence[str] | str = (), partitions: int | None = None,
) -> DataFrame:
    """Rows a greedy throttle lets through: at least ``interval_ms`` after the last one of the key.

    Rows are taken by time and then by ``order``; of several rows at one instant at most the first passes.  Rows without a
    key are one key, and rows without a time do not pass.  The rows are range-partitioned by key and time.  Keys that stay within one
    partition are folded there; those that cross partitions are resolved by composing their runs in rounds, as many as the
    logarithm of the partitions, on rows of the first interval of a run only.
    """
    if interval_ms <= 0:
        raise ValueError("the interval must be positive")
    keys, order = O._names(key), O._names(order)
    timed = df.withColumn("_t", F.col(ts_ms).cast("long")).filter(F.col("_t").isNotNull())
    runs = O._ranged(timed.withColumn("_text", F.to_json(F.struct(*keys))), [*keys, "_t", *order], partitions)
    maps = checkpoint(runs.select("_text", "_part", "_t").mapInArrow(_run_maps(interval_ms), f"_key string, {_MAPS}"))
    # at most two runs per partition have a map; only keys with several of them go on
    crossing = maps.groupBy("_key").agg(F.countDistinct("node").alias("n")).filter("n > 1").select("_key")
    parts = maps.join(crossing, "_key", "left_semi").select("_key", "node").distinct()
    parts = checkpoint(parts.select("_key", F.col("node").alias("_at"), (F.row_number().over(Window.partitionBy("_key").orderBy("node")) - 1).cast("long").alias("node")))
    levels = [checkpoint(maps.withColumnRenamed("node", "_at").join(parts, ["_key", "_at"]).select("_key", "node", "first", "last"))]
    while levels[-1].filter("node > 0").head(1):
        pairs = levels[-1].groupBy("_key", F.expr("node div 2").alias("_pair"))
        levels.append(checkpoint(pairs.applyInPandas(_composed(interval_ms), f"_key string, {_MAPS}")))
    before = levels[-1].select("_key", "node").distinct().withColumn("entry", F.lit(None).cast("long"))
    for maps_below in reversed(levels[:-1]):
        nodes = maps_below.select("_key", "node").distinct().withColumn("_pair", F.expr("node div 2"))
        entered = nodes.join(before.select("_key", F.col("node").alias("_pair"), "entry"), ["_key", "_pair"])
        left = entered.filter("node % 2 = 0").join(maps_below, ["_key", "node"])
        due = F.col("entry").isNull() | (F.col("first") >= F.col("entry") + interval_ms)
        after = left.groupBy("_key", "_pair").agg(F.coalesce(F.min_by("last", F.when(due, F.col("first"))), F.first("entry")).alias("_after"))
        before = checkpoint(entered.join(after, ["_key", "_pair"], "left").select(
            "_key", "node", F.when(F.col("node") % 2 == 0, F.col("entry")).otherwise(F.col("_after")).alias("entry")))
    # no more rows than partitions, as only one run of a partition continues another
    entries = parts.join(before, ["_key", "node"]).filter("entry is not null").select(F.col("_key").alias("_text"), F.col("_at").alias("_part"), F.col("entry").alias("_entry"))
    ready = runs.join(F.broadcast(entries), ["_text", "_part"], "left").select(*df.columns, "_text", "_t", "_entry")
    return ready.mapInArrow(_passing(interval_ms), df.schema)
