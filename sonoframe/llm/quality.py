"""Quality: random Fourier features of document statistics, ridge regression, isotonic calibration (operator 5)."""

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe.llm.shared import pieces, stored
from sonoframe.llm.supervised import calibrated, fit_isotonic, id_remainder, labelled_sample

MAX_LABELLED = 20_000   # labelled rows learned from, at most about
DIMENSIONS = 320        # random Fourier features
RIDGE = 1e-4            # per row
SEED = 11

STATISTICS = ("words", "word_length", "word_length_spread", "distinct_words", "top_word", "repeated_pairs", "capital_words", "capitals", "digits",
              "high_bytes", "stops_commas", "exclamations", "bars", "symbols", "brackets", "other_marks", "lines", "line_words", "repeated_lines",
              "short_lines", "marked_words", "sentences", "longest_word")


def describe(text: str | None) -> list[float]:
    """Statistics of a whole text, in the order of ``STATISTICS``; all zero without words."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size = int(raw.sum())
    per = lambda chars: sum(int(raw[ord(c)]) for c in chars) / size
    lengths = np.fromiter(map(len, words), np.int32, n)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    lines = text.split("\n")
    letters = int(raw[65:91].sum() + raw[97:123].sum() + raw[192:].sum())
    marks = int(raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum())
    named = "".join(",.!|*%$#&()[]{}<>")
    return [math.log1p(n), float(lengths.mean()), float(lengths.std()), len(counts) / n ** 0.9, math.log(counts.most_common(1)[0][1]) / math.log(n + 1),
            1 - pairs / (n - 1) if n > 1 else 0.0, sum(map(str.isupper, words)) / n, int(raw[65:91].sum()) / max(1, letters), int(raw[48:58].sum()) / size,
            int(raw[128:].sum()) / size, per(",."), per("!"), per("|"), per("*%$#&"), per("()[]{}<>"),
            (marks - sum(int(raw[ord(c)]) for c in named)) / size, math.log1p(len(lines)), math.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines),
            sum(len(x) < 30 for x in lines) / len(lines), sum(not w[-1].isalnum() for w in words) / n, (text.count(". ") + text.count(".\n")) / n,
            math.log1p(int(lengths.max()))]


def _described(batches):
    """Kernel: (text, label, calibrates) to the statistics of the text."""
    for batch in pieces(batches):
        found = [describe(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "label", "calibrates"])


@dataclass
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray | None = None
    calibration: object = None
    prior: float = 0.0

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of a Gaussian kernel whose width is the usual distance of two rows, and a constant."""
        random = np.random.default_rng(SEED)
        directions = random.normal(0.0, 1 / math.sqrt(x.shape[1]), (x.shape[1], DIMENSIONS))
        shifts = random.uniform(0, 2 * math.pi, DIMENSIONS)
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([math.sqrt(2 / DIMENSIONS) * np.cos(z @ directions + shifts), np.ones((len(x), 1))])


def _sums(model: QualityModel):
    """Kernel: a partition's part of the normal equations, a row per feature: its products with all features and the label."""

    def run(batches):
        total = np.zeros((DIMENSIONS + 1, DIMENSIONS + 2))
        for batch in batches:
            if batch.num_rows:
                z = model.features(np.array(batch.column(0).to_pylist()))
                y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
                total += z.T @ np.hstack([z, y[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "sums"])

    return run


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"i": rows["i"].iloc[:1], "sums": [np.sum(np.stack(rows["sums"].to_list()), axis=0)]})


def _scored(model: QualityModel, text_column: str):
    """Kernel: append the ridge score of a text column of ``_row``."""

    def run(batches):
        for batch in pieces(batches):
            x = np.array([describe(t.as_py()) for t in batch.column(0).field(text_column)]).reshape(-1, len(STATISTICS))
            yield batch.append_column("_score", pa.array(model.features(x) @ model.weights))

    return run


def fit_quality(labelled: DataFrame) -> QualityModel:
    """Fit on ``labelled_sample`` rows (bounded by its ``max_rows``): the cluster adds the normal equations up by partition, the driver solves them."""
    rows = stored(labelled.select("text", "label", "calibrates").mapInArrow(_described, "x array<double>, label int, calibrates boolean").coalesce(4))
    n, good = rows.agg(F.count("*"), F.sum("label")).first()
    fit = rows.filter("not calibrates")
    used, used_good = fit.agg(F.count("*"), F.sum("label")).first()
    if not used or not used_good or used_good == used:
        return QualityModel(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)), prior=(good or 0) / n if n else 0.0)
    moments = fit.select(F.posexplode("x")).groupBy("pos").agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("s")).orderBy("pos").collect()
    model = QualityModel(np.array([r["m"] for r in moments]), np.array([max(r["s"], 1e-6) for r in moments]), prior=good / n)
    sums = fit.mapInArrow(_sums(model), "i int, sums array<double>").groupBy("i").applyInPandas(_added, "i int, sums array<double>").orderBy("i").collect()
    equations = np.array([r["sums"] for r in sums])
    model.weights = np.linalg.solve(equations[:, :-1] + RIDGE * used * np.eye(len(equations)), equations[:, -1])
    aside = rows.filter("calibrates")
    aside_good, aside_n = aside.agg(F.sum("label"), F.count("*")).first()
    both = aside_n and 0 < aside_good < aside_n
    weights = model
    raw = (aside if both else rows).mapInArrow(_raw_scores(weights), "_score double, label int")
    model.calibration = fit_isotonic(raw, "_score")
    return model


def _raw_scores(model: QualityModel):
    frozen = QualityModel(model.mean, model.spread, model.weights)

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(0).to_pylist()).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([pa.array(frozen.features(x) @ frozen.weights), batch.column(1)], ["_score", "label"])

    return run


def score_quality(docs: DataFrame, model: QualityModel, text_column: str = "text", to: str = "quality_score") -> DataFrame:
    """``docs`` with a column ``to``: the calibrated chance that the whole text is of good quality, from 0 to 1.

    Null, empty and blank texts have statistics of zero and are scored like any others.  Every row is scored on its own, so ties
    and repeated rows get equal scores.  Columns pass through under their own names; one named ``to`` is replaced.  Without training
    rows of both labels the score is the share of good ones, 0 without any.
    """
    if model.weights is None:
        return docs.withColumn(to, F.lit(float(model.prior)))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    frozen = QualityModel(model.mean, model.spread, model.weights)
    scored = rows.mapInArrow(_scored(frozen, text_column), f"_row {rows.schema['_row'].dataType.simpleString()}, _score double")
    names = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != to]
    return calibrated(scored, model.calibration).select(*names, F.col("_calibrated").alias(to))


def fit_on_labels(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, max_rows: int = MAX_LABELLED) -> QualityModel:
    """Fit on the labelled documents that may be learned from: by default those whose id's crc32 modulo 4 is not 2."""
    may = id_remainder("doc_id", 4) != 2 if may_learn is None else may_learn
    return fit_quality(labelled_sample(docs, labels, "quality", may, max_rows))
