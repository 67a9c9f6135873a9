"""Column functions over class-score arrays ordered like the model's class list."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

D = "double"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def one_hot(label, classes: Sequence[str]) -> Column:
    return F.array(*[F.when(_col(label) == c, F.lit(1.0)).otherwise(F.lit(0.0)) for c in classes])


def brier_row(scores, label, classes: Sequence[str]) -> Column:
    """Squared distance between the scores and the one-hot truth."""
    squares = F.zip_with(_col(scores), one_hot(label, classes), lambda p, t: (p - t) * (p - t))
    return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)


def confidence(scores) -> Column:
    return F.array_max(_col(scores))


def pick_class(scores, classes: Sequence[str]) -> Column:
    """Class with the highest score; the first one in class order on a tie."""
    s = _col(scores)
    names = F.array(*[F.lit(c) for c in classes])
    return F.element_at(names, F.array_position(s, F.array_max(s)).cast("int"))


def dot(left, right) -> Column:
    return F.aggregate(F.zip_with(_col(left), _col(right), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def margins(features, weights: Sequence[Sequence[float]], intercepts: Sequence[float]) -> Column:
    return F.array(*[dot(features, literal_vector(w)) + F.lit(float(b)) for w, b in zip(weights, intercepts)])


def calibrated_scores(raw_margins, slopes, intercepts) -> Column:
    """Sigmoid per class on logits clamped to +-60, then normalised to sum 1."""
    slopes = slopes if isinstance(slopes, Column) else literal_vector(slopes)
    intercepts = intercepts if isinstance(intercepts, Column) else literal_vector(intercepts)
    logits = F.zip_with(
        F.zip_with(_col(raw_margins), slopes, lambda m, s: m * s), intercepts, lambda x, b: x + b
    )
    raw = F.transform(logits, lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(x, F.lit(-60.0)), F.lit(60.0)))))
    total = F.aggregate(raw, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(raw, lambda x: x / total)
