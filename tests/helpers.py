import numpy as np

SERIES = "recording_id string, sample_rate int, samples array<float>"


def tone(hz, seconds=1.0, amplitude=0.15, rate=16000):
    t = np.arange(int(rate * seconds)) / rate
    return (amplitude * np.sin(2 * np.pi * hz * t)).astype(np.float32)


def series_frame(spark, rate=16000, **named):
    rows = [(name, rate, [float(v) for v in values]) for name, values in named.items()]
    return spark.createDataFrame(rows, SERIES)


def spoken(hz, seconds=1.5, rate=16000, seed=41):
    """Faint noise, then a tone from one third of a second on."""
    x = np.random.default_rng(seed).normal(0, 0.002, int(rate * seconds)).astype(np.float32)
    start = rate // 3
    x[start:] += tone(hz, seconds, 0.12, rate)[start:]
    return x
