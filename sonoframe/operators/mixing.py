"""Pairing records with noise, other voices and rooms, and mixing the samples."""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.functions.pitch import _list_parts
from sonoframe.functions import series as S
from sonoframe.operators.ordering import global_index, sized_join
from sonoframe.session import bounded_batches

SNR_RANGE_DB = (-20.0, 60.0)
SIR_RANGE_DB = (-30.0, 30.0)


# --- pairing ---------------------------------------------------------------------
def assign_round_robin(df: DataFrame, sources: DataFrame, order: Sequence[str] | str, *, count: int | None = None) -> DataFrame:
    """Give row ``i`` (in a unique total order) the source ``i mod n``.

    ``sources`` carries ``source_idx`` 0..n-1.  Only the order columns are sorted
    and checkpointed; with few sources each holds a large share of rows, so the
    source side is broadcast when measured small and salted otherwise.
    """
    order = [order] if isinstance(order, str) else list(order)
    found, lowest, highest, different = sources.agg(
        F.count("source_idx"), F.min("source_idx"), F.max("source_idx"), F.count_distinct("source_idx")).first()
    n = found if count is None else count
    if not n:
        raise ValueError("there is no source to assign")
    if (found, lowest, highest, different) != (n, 0, n - 1, n):
        raise ValueError(f"source_idx must be 0..{n - 1}, each once; found {found} from {lowest} to {highest}")
    positions = global_index(df.select(*order), order, "row_index").withColumn(
        "source_idx", F.pmod("row_index", F.lit(n)).cast("int"))
    return sized_join(df.join(positions, order), sources, "source_idx")


def first_other(
    df: DataFrame, order: str, speaker: Sequence[str] = ("dataset_id", "speaker_id"),
    recording: Sequence[str] = ("dataset_id", "recording_id"), name: str = "other",
) -> DataFrame:
    """For each row the first row (by ``order``) of another speaker and another recording.

    Whatever the row, the answer is one of at most five rows of the table: the very
    first row, the first with another speaker or another recording than that, and the
    first that also avoids the runner-up.  Three passes of ``min`` find them; the
    big table is then only projected.  Adds ``name`` = the other row's order value.
    """
    who = F.struct(*[F.col(c).alias(f"s{i}") for i, c in enumerate(speaker)])
    what = F.struct(*[F.col(c).alias(f"r{i}") for i, c in enumerate(recording)])
    rows = df.select(F.col(order).alias("o"), who.alias("who"), what.alias("what"))
    picked = F.struct("o", "who", "what")

    def same(column, value, fields):
        return F.lit(True) if value is None else _all([column[f] == F.lit(value[f]) for f in fields])

    who_fields, what_fields = [f"s{i}" for i in range(len(speaker))], [f"r{i}" for i in range(len(recording))]
    not_who = lambda row: ~same(F.col("who"), row["who"] if row else None, who_fields)
    not_what = lambda row: ~same(F.col("what"), row["what"] if row else None, what_fields)
    firsts = lambda **conditions: rows.agg(*[F.min(F.when(c, picked)).alias(n) for n, c in conditions.items()]).first()

    a = firsts(a=F.lit(True))["a"]
    second = firsts(b=not_who(a), c=not_what(a))
    b, c = second["b"], second["c"]
    third = firsts(d=not_what(a) & not_who(c), e=not_who(a) & not_what(b))
    anchors = sorted({r["o"]: r for r in (a, b, c, third["d"], third["e"]) if r is not None}.values(), key=lambda r: r["o"])
    answer = F.lit(None).cast(df.schema[order].dataType)
    for row in reversed(anchors):
        differs_who = ~_all([F.col(col) == F.lit(row["who"][f]) for col, f in zip(speaker, who_fields)])
        differs_what = ~_all([F.col(col) == F.lit(row["what"][f]) for col, f in zip(recording, what_fields)])
        answer = F.when(differs_who & differs_what, F.lit(row["o"])).otherwise(answer)
    return df.withColumn(name, answer)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


# --- condition grid ------------------------------------------------------------------
def condition_grid(
    snr_db: Sequence[float] = (20.0, 10.0, 5.0, 0.0), sir_db: Sequence[float] = (6.0, 0.0, -6.0),
    noise_types: Sequence[str] = ("background_music", "fan", "environment"), rirs: int = 0,
) -> list[tuple[str, str, float | None, str | None, int | None]]:
    """``(condition, kind, level_db, noise_type, rir_index)`` in evaluation order."""
    grid = [("clean", "clean", None, None, None)]
    grid += [(f"white_noise_{v:g}db", "white", float(v), None, None) for v in snr_db]
    grid += [(f"{t}_snr_{v:g}db", "background", float(v), t, None) for t in noise_types for v in snr_db]
    grid += [(f"reverb_rir_{i + 1}", "reverb", None, "reverb_impulse", i) for i in range(rirs)]
    grid += [(f"other_voice_sir_{v:g}db", "voice", float(v), None, None) for v in sir_db]
    return grid


def with_conditions(df: DataFrame, grid: Sequence[tuple]) -> DataFrame:
    """Repeat every row once per condition of a small literal grid (a generator, not a join)."""
    null = lambda v, t: F.lit(v).cast(t)
    entries = [
        F.struct(null(c, "string").alias("condition"), null(k, "string").alias("kind"), null(d, "double").alias("level_db"),
                 null(t, "string").alias("noise_type"), null(r, "int").alias("rir_index"))
        for c, k, d, t, r in grid
    ]
    return df.withColumn("_grid", F.explode(F.array(*entries))).select(*df.columns, "_grid.*")


# --- preconditions ---------------------------------------------------------------------
def mix_problem(
    samples="samples", kind: str = "white", level_db="level_db", other=None, rate=None, other_rate=None
) -> Column:
    """Why a mix is impossible, NULL when it is fine."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    s, db = col(samples), col(level_db) if level_db is not None else F.lit(None)
    usable = lambda a: a.isNotNull() & (F.size(a) > 0)
    power = lambda a: S.mean_square(F.transform(a, lambda x: x.cast("double")))
    floor = 1e-16 if kind in ("voice", "reverb") else 1e-12
    problem = (
        F.when(~usable(s), "EMPTY_SIGNAL").when(~S.all_finite(s), "NOT_FINITE").when(power(s) <= floor, "NO_ENERGY"))
    if kind != "reverb":
        low, high = SIR_RANGE_DB if kind == "voice" else SNR_RANGE_DB
        problem = problem.when(~F.coalesce(db.between(low, high), F.lit(False)), "LEVEL_OUT_OF_RANGE")
    if other is not None:
        o = col(other)
        energy = power(o) * F.size(o) if kind == "reverb" else power(o)
        problem = (
            problem.when(~usable(o), "NO_SOURCE").when(~S.all_finite(o), "SOURCE_NOT_FINITE")
            .when(energy <= (1e-12 if kind == "reverb" else floor), "SOURCE_NO_ENERGY"))
        if rate is not None:
            problem = problem.when(~col(rate).eqNullSafe(col(other_rate)), "RATE_MISMATCH")
    return problem


def mixable(df: DataFrame, kind: str = "white", name: str = "reason", **columns) -> DataFrame:
    """Mark rows that cannot be mixed with ``MIX_INVALID`` and the detailed cause."""
    problem = mix_problem(kind=kind, **columns)
    return df.withColumn("mix_problem", problem).withColumn(
        name, F.when(F.col("mix_problem").isNotNull(), F.lit("MIX_INVALID")))


# --- sample kernels (float64 in, float64 out; None when impossible) ---------------------
def _power(x: np.ndarray) -> float:
    return float(np.mean(np.square(x))) if x.size else 0.0


def _sound(*parts: np.ndarray) -> bool:
    return all(p.size and np.isfinite(p).all() for p in parts)


def _white(x, _, db, seed):
    if not _sound(x) or _power(x) <= 1e-12 or not SNR_RANGE_DB[0] <= db <= SNR_RANGE_DB[1]:
        return None
    noise = np.random.default_rng(int(seed) & (2**63 - 1)).normal(0.0, 1.0, size=x.size)
    return x + noise * np.sqrt(_power(x) / 10.0 ** (db / 10.0) / _power(noise))


def _background(x, other, db, _):
    if not _sound(x, other) or min(_power(x), _power(other)) <= 1e-12 or not SNR_RANGE_DB[0] <= db <= SNR_RANGE_DB[1]:
        return None
    tiled = np.resize(other, x.size)
    level = _power(tiled)
    return x + tiled * np.sqrt(_power(x) / 10.0 ** (db / 10.0) / level) if level > 0.0 else None


def _voice(x, other, db, _):
    if not _sound(x, other) or min(_power(x), _power(other)) <= 1e-16 or not SIR_RANGE_DB[0] <= db <= SIR_RANGE_DB[1]:
        return None
    tiled = np.resize(other, x.size)
    level = np.sqrt(_power(tiled))
    return x + tiled * (np.sqrt(_power(x)) / (level * 10.0 ** (db / 20.0))) if level > 0.0 else None


def _reverb(x, room, *_):
    if not _sound(x, room) or _power(x) <= 1e-16 or float(np.sum(np.square(room))) <= 1e-12:
        return None
    length = 1 << (x.size + room.size - 2).bit_length()
    wet = np.fft.irfft(np.fft.rfft(x, n=length) * np.fft.rfft(room, n=length), n=length)[:x.size]
    level = np.sqrt(_power(wet))
    return wet * (np.sqrt(_power(x)) / level) if level > 1e-12 and np.isfinite(level) else None


_KERNELS = {"clean": lambda x, *_: x, "white": _white, "background": _background, "voice": _voice, "reverb": _reverb}


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _mixed(kinds: pa.Array, samples: pa.Array, others: pa.Array, levels: pa.Array, seeds: pa.Array) -> pa.Array:
    values, at = _list_parts(samples)
    second, at2 = _list_parts(others)
    out = []
    for i, (kind, db, seed) in enumerate(zip(kinds.to_pylist(), levels.to_pylist(), seeds.to_pylist())):
        x, y = values[at[i]:at[i + 1]].astype(np.float64), second[at2[i]:at2[i + 1]].astype(np.float64)
        mixed = _KERNELS[kind](x, y, np.nan if db is None else db, seed or 0)
        out.append(None if mixed is None else mixed.astype(np.float32))
    return pa.array(out, pa.list_(pa.float32()))


def mix(kind, samples="samples", other=None, level_db=None, seed=None) -> Column:
    """Mixed ``ARRAY<FLOAT>``; NULL where the mix is impossible.

    The seed is a column, so a row's noise depends on the row and never on how the
    table is partitioned.
    """
    col = lambda c, t: F.lit(None).cast(t) if c is None else (F.col(c) if isinstance(c, str) else c).cast(t)
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    return _mixed.asNondeterministic()(
        kind, col(samples, "array<float>"), col(other, "array<float>"), col(level_db, "double"), col(seed, "long"))


def mix_white_noise(df: DataFrame, snr_db, seed, *, samples: str = "samples") -> DataFrame:
    """Add seeded white noise at an exact signal-to-noise ratio."""
    return _replaced(df, samples, mix("white", samples, None, _number(snr_db), _number(seed)))


def mix_background(df: DataFrame, other: str, snr_db, *, samples: str = "samples") -> DataFrame:
    """Add a tiled background at a signal-to-noise ratio."""
    return _replaced(df, samples, mix("background", samples, other, _number(snr_db)))


def mix_interferer(df: DataFrame, other: str, sir_db, *, samples: str = "samples") -> DataFrame:
    """Add a second voice at a signal-to-interferer ratio of levels."""
    return _replaced(df, samples, mix("voice", samples, other, _number(sir_db)))


def apply_reverb(df: DataFrame, room: str, *, samples: str = "samples") -> DataFrame:
    """Convolve with an impulse response; length and level are kept."""
    return _replaced(df, samples, mix("reverb", samples, room))


def _replaced(df: DataFrame, samples: str, mixed: Column) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.withColumn(samples, mixed)


def _number(value):
    return value if isinstance(value, (str, Column)) else F.lit(value)


# --- augmentation --------------------------------------------------------------------------
def augment(
    train: DataFrame, *, order: Sequence[str] | str, seed: int = 42, snr_db: Sequence[float] = (),
    backgrounds: DataFrame | None = None, background_snr_db: Sequence[float] = (), rooms: DataFrame | None = None, impossible: str = "raise",
) -> DataFrame:
    """Training rows plus their noisy copies, with ``augmentation`` naming each copy.

    ``backgrounds`` has ``noise_type, source_idx, source_samples``; ``rooms`` has
    ``source_idx, source_samples``.  Sources are dealt round robin in the order of
    the training rows.  Call it on the training split only.  Runs jobs.

    A mix that is impossible, for silence, broken samples or unequal rates (``sample_rate`` beside ``source_rate``, where both are there),
    fails the job, as an experiment on fewer copies than asked for would be another one.  With ``impossible="reject"`` such copies stay
    with NULL samples and ``MIX_INVALID`` in the last column ``reason``, to be counted and left out.
    """
    if impossible not in ("raise", "reject"):
        raise ValueError("impossible mixes are raised or rejected")
    for value in (*snr_db, *background_snr_db):
        if not SNR_RANGE_DB[0] <= value <= SNR_RANGE_DB[1]:
            raise ValueError("augmentation SNR must be within [-20, 60] dB")
    bounded_batches(train.sparkSession)
    keys = [order] if isinstance(order, str) else list(order)
    columns = [*train.columns, "augmentation"]
    parts = [train.withColumn("augmentation", F.lit("original"))]

    def copied(df: DataFrame, mixed: Column, name: Column) -> DataFrame:
        if "source_rate" in df.columns and "sample_rate" in df.columns:
            mixed = F.when(F.col("source_rate").eqNullSafe(F.col("sample_rate")), mixed)
        return df.withColumn("samples", mixed).withColumn("augmentation", name).select(*columns)

    if snr_db:
        indexed = train.join(global_index(train.select(*keys), keys, "row_index"), keys)
        grid = [(f"{v:g}dB", "white", float(v), None, i) for i, v in enumerate(snr_db)]
        noisy = with_conditions(indexed, grid).withColumn(
            "_seed", F.lit(seed) + 1009 * (F.col("rir_index") + 1) + F.col("row_index"))
        parts.append(copied(noisy, mix("white", "samples", None, "level_db", "_seed"), F.col("condition")))
    if background_snr_db:
        kinds = [] if backgrounds is None else [
            r["noise_type"] for r in backgrounds.groupBy("noise_type").agg(F.count("*").alias("n")).orderBy("noise_type").collect()]
        if not kinds:
            raise ValueError("background augmentation was requested but there is no source")
        for kind in kinds:
            paired = assign_round_robin(train, backgrounds.filter(F.col("noise_type") == kind).drop("noise_type"), keys)
            grid = [(f"{kind}@{v:g}dB", "background", float(v), None, None) for v in background_snr_db]
            noisy = with_conditions(paired, grid)
            parts.append(copied(noisy, mix("background", "samples", "source_samples", "level_db"), F.col("condition")))
    if rooms is not None:
        paired = assign_round_robin(train, rooms, keys)
        parts.append(copied(paired, mix("reverb", "samples", "source_samples"), F.lit("reverb")))
    out, copies = parts[0], None
    for part in parts[1:]:
        copies = part if copies is None else copies.unionByName(part)
    if impossible == "reject":
        reason = F.when(F.col("samples").isNull(), "MIX_INVALID").alias("reason")
        out = out.select("*", F.lit(None).cast("string").alias("reason"))
        copies = None if copies is None else copies.select("*", reason)
    elif copies is not None:
        # a filter, which no projection can prune
        copies = copies.filter(F.when(F.col("samples").isNotNull(), F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("impossible mix: "), F.col("augmentation"))).cast("boolean")))
    return out if copies is None else out.unionByName(copies)
