"""Column functions over sample arrays (``ARRAY<FLOAT>``) and per-frame arrays.

All of them are built-in higher-order functions: one row in, one value out, no
shuffle, so a long or frequent recording can never skew a job.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonoframe import settings

D = "double"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- sample repair (two different rules, see README) --------------------------
def repair_samples(samples) -> Column:
    """NaN becomes 0 and infinities become +-1 (used by the quality measures)."""
    inf = F.lit(float("inf")).cast("float")
    return F.transform(_col(samples), lambda x: (
        F.when(F.isnan(x), F.lit(0.0).cast("float"))
        .when(x == inf, F.lit(1.0).cast("float"))
        .when(x == -inf, F.lit(-1.0).cast("float"))
        .otherwise(x)
    ))


def clip_samples(samples) -> Column:
    """Clamp to [-1, 1] in double precision (used by the prosody measures)."""
    return F.transform(_col(samples), lambda x: F.least(F.greatest(x.cast(D), F.lit(-1.0)), F.lit(1.0)))


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def all_finite(samples) -> Column:
    return F.forall(_col(samples), is_finite)


# --- scalar measures of one array ----------------------------------------------
def mean_square(samples) -> Column:
    """Mean of the squares: squared in the array's own precision, summed in double."""
    s = _col(samples)
    total = F.aggregate(s, F.lit(0.0), lambda acc, x: acc + (x * x).cast(D))
    return F.when(F.size(s) > 0, total / F.size(s))


def rms(samples) -> Column:
    return F.sqrt(mean_square(samples))


def _negative(x: Column) -> Column:
    # The sign bit: -0.0 counts as negative, which no comparison can see.
    return (x < 0) | ((x == 0) & (x.cast("string") == F.lit("-0.0")))


def zcr(samples) -> Column:
    """Share of neighbouring samples whose sign bits differ; 0 for one sample."""
    s = _col(samples)
    n = F.size(s)
    flips = F.zip_with(
        F.slice(s, F.lit(2), F.greatest(n - 1, F.lit(0))),
        F.slice(s, F.lit(1), F.greatest(n - 1, F.lit(0))),
        lambda a, b: (_negative(a) != _negative(b)).cast("int"),
    )
    return F.when(n > 1, F.aggregate(flips, F.lit(0), lambda acc, x: acc + x) / (n - 1)).otherwise(F.lit(0.0))


def clip_fraction(samples, level: float = 0.999) -> Column:
    s = _col(samples)
    hits = F.size(F.filter(s, lambda x: F.abs(x) >= F.lit(level).cast("float")))
    return F.when(F.size(s) > 0, hits / F.size(s)).otherwise(F.lit(0.0))


def duration_s(samples, sample_rate) -> Column:
    return F.size(_col(samples)) / _col(sample_rate)


def hnr_db(periodicity) -> Column:
    """Harmonics-to-noise ratio in dB from the periodicity peak, within [-20, 40]."""
    p = _col(periodicity)
    ratio = F.greatest(p, F.lit(1e-8)) / F.greatest(F.lit(1.0) - p, F.lit(1e-8))
    return F.least(F.greatest(F.lit(10.0) * F.log10(ratio), F.lit(-20.0)), F.lit(40.0))


# --- summaries of short arrays (frames of one recording) ------------------------
def known(values) -> Column:
    return F.filter(_col(values), lambda x: x.isNotNull())


def array_total(values) -> Column:
    return F.aggregate(_col(values), F.lit(0.0), lambda acc, x: acc + x.cast(D))


def array_mean(values) -> Column:
    v = _col(values)
    return F.when(F.size(v) > 0, array_total(v) / F.size(v))


def bound(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use`` (a let-binding)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def array_std(values) -> Column:
    """Population standard deviation in one running pass."""
    zero = F.lit(0.0)
    start = F.struct(zero.alias("n"), zero.alias("mean"), zero.alias("m2"))

    def step(acc, x):
        n, gap = acc["n"] + 1.0, x.cast(D) - acc["mean"]
        mean = acc["mean"] + gap / n
        return F.struct(n.alias("n"), mean.alias("mean"), (acc["m2"] + gap * (x - mean)).alias("m2"))

    return F.aggregate(_col(values), start, step, lambda acc: F.when(acc["n"] > 0, F.sqrt(acc["m2"] / acc["n"])))


def array_quantile(values, p: float) -> Column:
    """Linear-interpolation quantile of a non-null array."""

    def pick(ordered):
        position = (F.size(ordered) - 1) * F.lit(float(p))
        low = F.floor(position).cast("int")
        high = F.least(low + 1, F.size(ordered) - 1)
        at = lambda i: F.element_at(ordered, i + 1)
        return F.when(F.size(ordered) > 0, at(low) + (at(high) - at(low)) * (position - low))

    return bound(F.sort_array(_col(values)), pick)


def array_median(values) -> Column:
    return array_quantile(values, 0.5)


def array_range(values) -> Column:
    return F.array_max(_col(values)) - F.array_min(_col(values))


def longest_run(flags) -> Column:
    """Length of the longest stretch of true values."""
    start = F.struct(F.lit(0).alias("cur"), F.lit(0).alias("best"))

    def step(acc, flag):
        cur = F.when(flag, acc["cur"] + 1).otherwise(F.lit(0))
        return F.struct(cur.alias("cur"), F.greatest(acc["best"], cur).alias("best"))

    return F.aggregate(_col(flags), start, step, lambda acc: acc["best"])


def adjacent_deltas(values, step_s) -> Column:
    """Change per second between neighbours that are both known."""
    v = _col(values)
    n = F.greatest(F.size(v) - 1, F.lit(0))
    step = _col(step_s)
    return known(F.zip_with(F.slice(v, F.lit(2), n), F.slice(v, F.lit(1), n), lambda b, a: (b - a) / step))


def slope_over_time(values, step_s) -> Column:
    """Least-squares slope of the known values against their time; 0 if undefined."""
    step, zero = _col(step_s), F.lit(0.0)
    points = F.filter(
        F.transform(_col(values), lambda x, i: F.struct((i * step).alias("t"), x.cast(D).alias("y"))),
        lambda p: p["y"].isNotNull(),
    )
    start = F.struct(*[zero.alias(n) for n in ("n", "t", "y", "sxx", "sxy")])

    def add(acc, p):
        n, dt = acc["n"] + 1.0, p["t"] - acc["t"]
        t, y = acc["t"] + dt / n, acc["y"] + (p["y"] - acc["y"]) / n
        return F.struct(
            n.alias("n"), t.alias("t"), y.alias("y"),
            (acc["sxx"] + dt * (p["t"] - t)).alias("sxx"), (acc["sxy"] + dt * (p["y"] - y)).alias("sxy"),
        )

    return F.aggregate(points, start, add, lambda acc: F.when(
        (acc["n"] >= 2) & (acc["sxx"] > 0), acc["sxy"] / acc["sxx"]).otherwise(zero))


# --- feature vectors ------------------------------------------------------------
def full_vector() -> Column:
    return F.array(*[F.col(n).cast("float") for n in settings.FULL_FEATURES])


def simple_vector() -> Column:
    return F.array(*[
        F.when(is_finite(F.col(n)), F.col(n)).otherwise(F.lit(0.0)).cast("float") for n in settings.SIMPLE_FEATURES
    ])
