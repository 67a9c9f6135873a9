"""Per-frame measures that need an FFT, as Arrow UDFs.

The UDFs see a whole Arrow batch of sample arrays without copying, cut the
frames as strided views, and return only per-frame numbers; everything after
that is built-in SQL on short arrays.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe.session import bounded_batches
from sonoframe.settings import FrameSettings

_MEASURES = "struct<valid:array<boolean>,frame_rms:array<double>,frame_zcr:array<double>,f0:array<double>,periodicity:array<double>>"
_MEASURE_TYPE = pa.struct([
    ("valid", pa.list_(pa.bool_())), ("frame_rms", pa.list_(pa.float64())), ("frame_zcr", pa.list_(pa.float64())),
    ("f0", pa.list_(pa.float64())), ("periodicity", pa.list_(pa.float64())),
])


def frame_samples(rate: int, ms: float) -> int:
    return max(1, round(rate * ms / 1000.0))


def _fft_length(least: int) -> int:
    """Smallest even 2-3-5-smooth transform length that is long enough."""
    n = least + least % 2
    while True:
        rest = n
        for factor in (2, 3, 5):
            while rest % factor == 0:
                rest //= factor
        if rest == 1:
            return n
        n += 2


def pitch_of_frames(frames: np.ndarray, rate: int, low_hz: float, high_hz: float) -> tuple[np.ndarray, np.ndarray]:
    """Pitch in Hz and periodicity of each row of a (frames, samples) matrix.

    Autocorrelation of the mean-free Hann-windowed frame, highest peak in the lag
    range, refined by a parabola.  Pitch is 0 where no usable peak exists.
    """
    count, width = frames.shape
    hz, strength = np.zeros(count), np.zeros(count)
    first, last = max(1, int(rate / high_hz)), min(width - 2, int(rate / low_hz))
    if count == 0 or width < 4 or last <= first:
        return hz, strength
    loud = np.sqrt(np.mean(frames * frames, axis=1)) >= 1e-5
    tapered = (frames - frames.mean(axis=1, keepdims=True)) * np.hanning(width)
    length = _fft_length(width + last + 2)  # enough zeros for the lags that are read
    spectrum = np.fft.rfft(tapered, n=length, axis=1)
    power = np.square(spectrum.real) + np.square(spectrum.imag)
    correlation = np.fft.irfft(power, n=length, axis=1)[:, :last + 2]
    usable = loud & (correlation[:, 0] > 0.0)
    scaled = correlation / np.where(usable, correlation[:, 0], 1.0)[:, None]
    lag = first + np.argmax(scaled[:, first:last + 1], axis=1)
    rows = np.arange(count)
    left, peak, right = scaled[rows, lag - 1], scaled[rows, lag], scaled[rows, lag + 1]
    strength = np.where(usable, np.clip(peak, 0.0, 1.0), 0.0)
    strength[strength < 1e-12] = 0.0
    bend = left - 2.0 * peak + right
    curved = np.abs(bend) > 1e-12
    shift = np.where(curved, np.clip(0.5 * (left - right) / np.where(curved, bend, 1.0), -0.5, 0.5), 0.0)
    hz = rate / (lag + shift)
    inside = (strength > 0.0) & (hz >= low_hz) & (hz <= high_hz)
    return np.where(inside, hz, 0.0), strength


def _list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and row offsets of a list column (NULL rows read as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.nan_to_num(np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.float64))
    return np.asarray(column.flatten()), np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)


def _nullable(values: np.ndarray) -> pa.Array:
    return pa.array(values, mask=np.isnan(values))


def frame_pitch(frame, rate: int, cfg: FrameSettings) -> Column:
    """``struct<f0, periodicity>`` of one frame array per row (equal-length frames batch)."""
    low, high = cfg.min_f0_hz, cfg.max_f0_hz

    @F.arrow_udf("struct<f0:double,periodicity:double>")
    def measure(frames: pa.Array) -> pa.Array:
        values, offsets = _list_parts(frames)
        sizes = np.diff(offsets)
        hz, strength = np.full(len(sizes), np.nan), np.full(len(sizes), np.nan)
        for width in np.unique(sizes[sizes > 0]):
            rows = np.flatnonzero(sizes == width)
            block = np.stack([values[offsets[r]:offsets[r + 1]] for r in rows]).astype(np.float64)
            hz[rows], strength[rows] = pitch_of_frames(block, rate, low, high)
        return pa.StructArray.from_arrays([_nullable(hz), _nullable(strength)], names=["f0", "periodicity"])

    return measure(F.col(frame) if isinstance(frame, str) else frame)


def _measure_series(samples: np.ndarray, rate: int, cfg: FrameSettings, frame: int, hop: int, zero_hz: bool):
    starts = np.arange(0, samples.size, hop)
    if not starts.size:
        return np.zeros(0, bool), *[np.zeros(0)] * 4
    padded = np.concatenate([samples, np.zeros(frame, samples.dtype)])
    frames = np.lib.stride_tricks.sliding_window_view(padded, frame)[starts].astype(np.float64)
    covered = np.minimum(samples.size - starts, frame) / frame
    valid = (covered >= cfg.min_frame_coverage) & np.isfinite(frames).all(axis=1)
    level, crossing, f0, strength = (np.full(starts.size, np.nan) for _ in range(4))
    kept = np.clip(frames[valid], -1.0, 1.0)
    if kept.size:
        level[valid] = np.sqrt(np.mean(kept * kept, axis=1))
        sign = np.signbit(kept)
        crossing[valid] = np.mean(sign[:, 1:] != sign[:, :-1], axis=1) if frame > 1 else 0.0
        hz, peak = pitch_of_frames(kept, rate, cfg.min_f0_hz, cfg.max_f0_hz)
        strength[valid] = peak
        voiced = peak >= cfg.min_periodicity
        f0[valid] = np.where(voiced & (zero_hz | (hz > 0.0)), hz, np.nan)
    return valid, level, crossing, f0, strength


def measure_frames(
    df: DataFrame, cfg: FrameSettings = FrameSettings(), *, samples: str = "samples", out_of_range_as_zero: bool = True,
) -> DataFrame:
    """Add ``valid, frame_rms, frame_zcr, f0, periodicity`` arrays and ``step_s``.

    One entry per hop.  A frame whose peak is strong but lies outside the pitch
    range counts as voiced with 0 Hz, as the published features do; pass
    ``out_of_range_as_zero=False`` to treat it as unvoiced instead.
    """
    bounded_batches(df.sparkSession)
    rate = cfg.sample_rate
    frame, hop = frame_samples(rate, cfg.frame_ms), frame_samples(rate, cfg.hop_ms)

    @F.arrow_udf(_MEASURES)
    def measure(column: pa.Array) -> pa.Array:
        values, offsets = _list_parts(column)
        rows = [
            _measure_series(values[a:b], rate, cfg, frame, hop, out_of_range_as_zero)
            for a, b in zip(offsets[:-1], offsets[1:])
        ]
        ends = pa.array(np.concatenate(([0], np.cumsum([len(r[0]) for r in rows]))).astype(np.int32))
        flat = [np.concatenate([r[i] for r in rows]) if rows else np.zeros(0) for i in range(5)]
        lists = [pa.ListArray.from_arrays(ends, pa.array(flat[0].astype(bool)))]
        lists += [pa.ListArray.from_arrays(ends, _nullable(v.astype(np.float64))) for v in flat[1:]]
        return pa.StructArray.from_arrays(lists, fields=list(_MEASURE_TYPE))

    measured = measure.asNondeterministic()  # keep filters on its output from running it twice
    return (
        df.withColumn("_m", measured(F.col(samples)))
        .select(*df.columns, "_m.*")
        .withColumn("step_s", F.lit(hop / rate))
    )


def measure_quality(
    df: DataFrame, cfg: FrameSettings = FrameSettings(), *, samples: str = "samples",
) -> DataFrame:
    """Array-batch version of the sample-level quality measures.

    Adds ``duration_s, rms, zero_crossing_rate, clipping_fraction, frame_levels``;
    values equal those of ``quality_features``.  Use it for audio-length series,
    where one pass over the Arrow buffers beats interpreted lambdas.
    """
    bounded_batches(df.sparkSession)
    rate = cfg.sample_rate
    size = frame_samples(rate, round(cfg.frame_ms))

    @F.arrow_udf("struct<rms:double,zero_crossing_rate:double,clipping_fraction:double,frame_levels:array<double>>")
    def measure(column: pa.Array) -> pa.Array:
        values, offsets = _list_parts(column)
        level, crossing, clipped, frames, ends = [], [], [], [], [0]
        for a, b in zip(offsets[:-1], offsets[1:]):  # row by row keeps each series in cache
            x, n = values[a:b], b - a
            if not np.isfinite(x.sum(dtype=np.float64)):
                x = np.nan_to_num(x, nan=0.0, posinf=1.0, neginf=-1.0)
            power = np.square(x).astype(np.float64)
            sign = np.signbit(x)
            level.append(np.sqrt(power.mean()) if n else 0.0)
            crossing.append(np.count_nonzero(sign[1:] != sign[:-1]) / (n - 1) if n > 1 else 0.0)
            clipped.append(np.count_nonzero(np.abs(x) >= np.float32(0.999)) / n if n else 0.0)
            cuts = np.arange(0, n, size)
            if n:
                frames.append(np.sqrt(np.add.reduceat(power, cuts) / np.minimum(n - cuts, size)))
            ends.append(ends[-1] + len(cuts))
        flat = np.concatenate(frames) if frames else np.zeros(0)
        return pa.StructArray.from_arrays(
            [pa.array(level, pa.float64()), pa.array(crossing, pa.float64()), pa.array(clipped, pa.float64()),
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
            names=["rms", "zero_crossing_rate", "clipping_fraction", "frame_levels"],
        )

    measured = measure.asNondeterministic()
    return (
        df.withColumn("_q", measured(F.col(samples)))
        .select(*df.columns, "_q.*")
        .withColumn("duration_s", F.size(samples) / F.lit(float(rate)))
    )
