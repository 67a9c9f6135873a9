"""Order-dependent building blocks that never put one key or all rows in one task.

Two ideas are used everywhere in this package:

* a *global* position comes from a range partitioning plus one offset per
  partition (``global_index``, ``running_totals``);
* a *per-key* ordered computation uses a range partitioning by key and order
  (``keyed_runs``).  The rows of a key in one partition form a run; a key that holds
  a third of the table is cut into as many runs as its rows need, whatever its
  times look like.  Windows work inside a run, and one summary row per run carries
  state to the later runs of the key: a key has at most as many as there are partitions.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.session import checkpoint

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def _names(columns: Sequence[str] | str) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


# --- global positions ---------------------------------------------------------
def _ranged(df: DataFrame, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    dealt = df.repartitionByRange(*order) if partitions is None else df.repartitionByRange(partitions, *order)
    return checkpoint(dealt.sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id())).withColumn(
        "_part", F.shiftright("_mid", _ROW_BITS)
    )


def _exclusive_offsets(per_part: DataFrame, sums: dict[str, str]) -> DataFrame:
    # One row per shuffle partition, so this window and its broadcast are bounded
    # by the partition count, not by the data.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(
        "_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for n, c in sums.items()]
    )


def global_index(df: DataFrame, order: Sequence[str] | str, name: str = "idx") -> DataFrame:
    """Add a dense 0-based position in the given total order.

    Runs one shuffle and one checkpoint.  Pass narrow rows (keys only) and join
    the position back: the rows are written once to the checkpoint folder.
    """
    ranged = _ranged(df, _names(order))
    offsets = _exclusive_offsets(ranged.groupBy("_part").agg(F.count("*").alias("_n")), {"_before": "_n"})
    row = F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + row)
        .drop("_part", "_mid", "_before")
    )


def running_totals(df: DataFrame, order: Sequence[str] | str, sums: dict[str, str]) -> DataFrame:
    """Add inclusive running sums ``{new column: summed column}`` over a total order."""
    ranged = _ranged(df, _names(order))
    per_part = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    offsets = _exclusive_offsets(per_part, {f"_o_{n}": f"_s_{n}" for n in sums})
    inside = Window.partitionBy("_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), "_part")
    for name, column in sums.items():
        out = out.withColumn(name, F.col(f"_o_{name}") + F.sum(column).over(inside))
    return out.drop("_part", "_mid", *[f"_o_{n}" for n in sums])


# --- per-key positions and carried state -------------------------------------
# Keys travel as never-null structs: NULL keys form a stream of their own, and no
# NOT NULL filter makes the two sides of a carry join differ, so Spark shuffles the
# rows once and reuses that shuffle for their run summaries.
_BACK = (Window.unboundedPreceding, -1)


def _inside():
    return Window.partitionBy("_grp").orderBy("_mid")


def _across():
    return Window.partitionBy("_key").orderBy("_grp")


def keyed_runs(df: DataFrame, keys, order, partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned by key and order and stored, with the position ``_mid`` and the run ``_grp`` of each.

    Spark chooses the number of partitions by size unless it is given; results do not depend on it.
    """
    keys = _names(keys)
    ranged = _ranged(df, [*keys, *_names(order)], partitions)
    return ranged.withColumn("_key", F.struct(*keys)).withColumn("_grp", F.struct(*keys, "_part"))


def without_runs(df: DataFrame) -> DataFrame:
    return df.drop("_key", "_grp", "_mid", "_part")


def last_in_runs(runs: DataFrame, value: Column, name: str, *, include_current: bool = True) -> DataFrame:
    """Last non-null ``value`` of the key up to (or before) each row of ``keyed_runs``."""
    runs = runs.withColumn("_value", value)
    tails = runs.groupBy("_key", "_grp").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_mid"))).alias("_tail"))
    carried = tails.select("_grp", F.last("_tail", ignorenulls=True).over(_across().rowsBetween(*_BACK)).alias("_carried"))
    local = F.last("_value", ignorenulls=True).over(_inside().rowsBetween(Window.unboundedPreceding, 0 if include_current else -1))
    return (
        runs.withColumn("_local", local).join(carried, "_grp", "left")
        .withColumn(name, F.coalesce("_local", "_carried")).drop("_local", "_carried", "_value")
    )


def previous_in_runs(runs: DataFrame, value: Column, n: int, name: str) -> DataFrame:
    """Array of the ``n`` preceding values of the key, nearest first, on rows of ``keyed_runs``."""
    runs = runs.withColumn("_value", F.struct(value.alias("v")))
    last_first = F.row_number().over(Window.partitionBy("_grp").orderBy(F.desc("_mid")))
    tails = (
        runs.withColumn("_rn", last_first).filter(F.col("_rn") <= n).groupBy("_key", "_grp")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("_rn", "_value"))), lambda s: s["_value"]).alias("_tail"))
    )
    earlier = F.flatten(F.filter(F.array(*[F.lag("_tail", i).over(_across()) for i in range(1, n + 1)]), lambda a: a.isNotNull()))
    carried = tails.select("_grp", earlier.alias("_carried"))
    nothing = F.filter(F.array(F.col("_value")), lambda _: F.lit(False))
    local = F.filter(F.array(*[F.lag("_value", i).over(_inside()) for i in range(1, n + 1)]), lambda s: s.isNotNull())
    return (
        runs.withColumn("_local", local).join(carried, "_grp", "left")
        .withColumn(name, F.transform(F.slice(F.concat("_local", F.coalesce("_carried", nothing)), 1, n), lambda s: s["v"]))
        .drop("_local", "_carried", "_value")
    )


def carry_last(df: DataFrame, keys, order, value: Column, name: str, *, include_current: bool = True, partitions: int | None = None) -> DataFrame:
    """Last non-null ``value`` of the key up to (or before) each row."""
    return without_runs(last_in_runs(keyed_runs(df, keys, order, partitions), value, name, include_current=include_current))


def carry_max(df: DataFrame, keys, order, value: str, name: str, *, partitions: int | None = None) -> DataFrame:
    """Largest ``value`` of the key strictly before each row (NULL on the first)."""
    runs = keyed_runs(df, keys, order, partitions)
    peaks = runs.groupBy("_key", "_grp").agg(F.max(value).alias("_peak"))
    carried = peaks.select("_grp", F.max("_peak").over(_across().rowsBetween(*_BACK)).alias("_carried"))
    local = F.max(value).over(_inside().rowsBetween(*_BACK))
    return without_runs(
        runs.withColumn("_local", local).join(carried, "_grp", "left")
        .withColumn(name, F.greatest("_local", "_carried")).drop("_local", "_carried"))


def previous_rows(df: DataFrame, keys, order, value: Column, n: int, name: str, *, partitions: int | None = None) -> DataFrame:
    """Array of the ``n`` preceding values of the key, nearest first."""
    return without_runs(previous_in_runs(keyed_runs(df, keys, order, partitions), value, n, name))


def keyed_rank(df: DataFrame, keys, order, name: str, *, newest_first: bool = False, partitions: int | None = None) -> DataFrame:
    """Exact 1-based row number inside the key without a per-key task."""
    runs = keyed_runs(df, keys, order, partitions)
    across = Window.partitionBy("_key").orderBy(F.desc("_grp") if newest_first else F.asc("_grp")).rowsBetween(*_BACK)
    offsets = (
        runs.groupBy("_key", "_grp").agg(F.count("*").alias("_n"))
        .select("_grp", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("_grp").orderBy(F.desc("_mid") if newest_first else F.asc("_mid"))
    return without_runs(
        runs.withColumn("_rn", F.row_number().over(inside)).join(offsets, "_grp", "left")
        .withColumn(name, F.col("_before") + F.col("_rn")).drop("_rn", "_before"))


GROUP_LIMIT = 1_000  # up to here Spark cuts every key to its first rows in each task before it shuffles


def newest_rows(df: DataFrame, keys, order, n: int, name: str, *, partitions: int | None = None) -> DataFrame:
    """The newest ``n`` rows of each key with their rank, 1 for the newest.

    For small ``n`` the rank filter reaches the tasks before the shuffle, so a frequent key sends ``n`` rows per task at most;
    beyond that the rank comes from ``keyed_rank``.
    """
    if n > GROUP_LIMIT:
        return keyed_rank(df, keys, order, name, newest_first=True, partitions=partitions).filter(F.col(name) <= n)
    newest = Window.partitionBy(*_names(keys)).orderBy(*[F.desc(c) for c in _names(order)])
    return df.withColumn(name, F.row_number().over(newest)).filter(F.col(name) <= n)


# --- exact quantiles ---------------------------------------------------------------
def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], keys: Sequence[str] | str = ()) -> DataFrame:
    """Exact linear-interpolation quantiles ``{name: p}`` per key (or overall), plus ``n``.

    Equal values collapse to one counted row before the sort, so a value shared by
    a third of all rows costs nothing, and ranks come from a range-partitioned
    running count instead of one task holding every value.
    """
    keys = _names(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    ranked = running_totals(counts, [*keys, value], {"_upto": "_c"})
    if keys:
        sizes = ranked.groupBy(*keys).agg(F.sum("_c").alias("n"), F.max("_upto").alias("_end"))
        ranked = sized_join(ranked, sizes, keys)
        last = F.col("_upto") - (F.col("_end") - F.col("n")) - 1
    else:
        total = ranked.agg(F.sum("_c").alias("n")).first()["n"] or 0
        ranked, last = ranked.withColumn("n", F.lit(total).cast("long")), F.col("_upto") - 1
    first = last - F.col("_c") + 1  # 0-based ranks covered by this value
    picks = []
    for name, p in probs.items():
        rank = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.floor(rank), F.ceil(rank)
        picks += [
            F.max(F.when((first <= low) & (last >= low), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when((first <= high) & (last >= high), F.col(value))).alias(f"_hi_{name}"),
        ]
    found = ranked.groupBy(*keys).agg(F.max("n").alias("n"), *picks)
    out = [*keys, F.coalesce(F.col("n"), F.lit(0)).alias("n")]
    for name, p in probs.items():
        rank = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.col(f"_lo_{name}").cast("double"), F.col(f"_hi_{name}").cast("double")
        out.append((low + (high - low) * (rank - F.floor(rank))).alias(name))
    return found.select(*out)


# --- joins with a size check ----------------------------------------------------
BROADCAST_CELLS = 4_000_000


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_CELLS) -> bool:
    """Measure rows x columns plus array elements; True when under the limit."""
    arrays = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
    cells = F.lit(len(df.columns))
    for column in arrays:
        cells = cells + F.coalesce(F.size(column), F.lit(0))
    total = df.agg(F.sum(cells.cast("long")).alias("n")).first()["n"]
    return (total or 0) <= limit


def sized_join(
    left: DataFrame, right: DataFrame, on: Sequence[str] | str, how: str = "inner", *,
    limit: int = BROADCAST_CELLS, salts: int = 32,
) -> DataFrame:
    """Join a large left side to a lookup side whose size is measured first.

    Under the limit the right side is broadcast.  Above it the join shuffles, and
    the left keys are salted so that a key with a third of all rows is spread
    over ``salts`` tasks; the right side is repeated once per salt.
    """
    on = _names(on)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("only joins that keep the left side's rows apart can be salted")
    if fits_broadcast(right, limit):
        return left.join(F.broadcast(right), on, how)
    hashed = [f.name for f in left.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    salted_left = left.withColumn("_salt", F.pmod(F.xxhash64(*hashed), F.lit(salts)).cast("int"))
    salted_right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_left.join(salted_right, [*on, "_salt"], how).drop("_salt")
