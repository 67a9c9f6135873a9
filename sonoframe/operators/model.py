"""Fitting, describing and applying calibrated linear scorers.

A fitted model is a small document (a Python dict, stored as one JSON row); the
tables it is fitted on and applied to stay distributed.
"""

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe import settings
from sonoframe.functions import scores as P
from sonoframe.functions import series as S
from sonoframe.operators.ordering import exact_quantiles

_vec = T.ArrayType(T.DoubleType())
_counts = T.MapType(T.StringType(), T.LongType())
MODEL_SCHEMA = T.StructType([
    T.StructField("format_version", T.IntegerType()), T.StructField("model_version", T.StringType()),
    T.StructField("feature_profile", T.StringType()), T.StructField("feature_schema_version", T.StringType()),
    T.StructField("feature_names", T.ArrayType(T.StringType())), T.StructField("sample_rate", T.IntegerType()),
    *[T.StructField(n, T.DoubleType()) for n in ("frame_ms", "hop_ms", "activity_rms_threshold", "window_s", "update_interval_s")],
    T.StructField("quality_gates", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("classes", T.ArrayType(T.StringType())),
    *[T.StructField(n, _vec) for n in ("imputation_values", "standardization_mean", "standardization_scale")],
    T.StructField("weights", T.ArrayType(_vec)),
    *[T.StructField(n, _vec) for n in ("intercepts", "calibration_slopes", "calibration_intercepts")],
    T.StructField("rejection_threshold", T.DoubleType()), T.StructField("calibration_status", T.StringType()),
    T.StructField("calibration_method", T.StringType()),
    T.StructField("training_library", T.StructType([
        T.StructField("scikit_learn_version", T.StringType()), T.StructField("classifier", T.StringType()),
        T.StructField("C", T.DoubleType()), T.StructField("dual", T.StringType()), T.StructField("solver", T.StringType()),
        T.StructField("max_iter", T.IntegerType()), T.StructField("class_weight", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("standardization", T.StringType()), T.StructField("imputation", T.StringType())])),
    T.StructField("training_manifest_sha256", T.StringType()), T.StructField("label_mapping_sha256", T.StringType()),
    T.StructField("label_mapping", T.MapType(T.StringType(), T.StringType())),
    T.StructField("dataset_split", T.StructType([T.StructField("method", T.StringType()), T.StructField("seed", T.LongType())])),
    T.StructField("validation", T.StructType([
        T.StructField("sample_count", T.LongType()), T.StructField("manifest_sha256", T.StringType()),
        T.StructField("threshold_selected_on", T.StringType()), T.StructField("threshold_selection_method", T.StringType()),
        T.StructField("brier_score", T.DoubleType()), T.StructField("ece", T.DoubleType()),
        T.StructField("class_counts", _counts)])),
    T.StructField("training", T.StructType([
        T.StructField("sample_count", T.LongType()), T.StructField("class_counts", _counts)])),
])


# --- gate before fitting -------------------------------------------------------------
def accept_windows(df: DataFrame) -> DataFrame:
    """Add ``reason``: why a window may not train or be scored, NULL when it may; an unknown status is rejected."""
    status = F.col("quality_status")
    return df.withColumn(
        "reason", F.when(~status.eqNullSafe("ACCEPTABLE"), F.coalesce(status, F.lit("UNKNOWN_QUALITY"))).when(
            F.coalesce(F.col("valid_frame_fraction"), F.lit(0.0)) < settings.MIN_VALID_FRAME_FRACTION, "INVALID_FRAME_CONTENT"))


# --- imputation and scaling --------------------------------------------------------------
def _finite_or_null(name: str) -> Column:
    c = F.col(name).cast("double")
    return F.when(S.is_finite(c), c)


def feature_medians(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Exact median of the finite values per feature, in long form."""
    long = train.select(*[_finite_or_null(f).alias(f) for f in features]).unpivot([], list(features), "feature", "value")
    return exact_quantiles(long, "value", {"median": 0.5}, "feature")


def fit_imputer(train: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Training medians as a dict; a feature without any finite value is an error.  Runs jobs."""
    found = {r["feature"]: r["median"] for r in feature_medians(train, features).collect()}
    empty = [f for f in features if f not in found]
    if empty:
        raise ValueError(f"training features have no finite observations: {', '.join(empty)}")
    return {f: found[f] for f in features}


def impute(df: DataFrame, medians: Mapping[str, float], *, training: bool = False) -> DataFrame:
    """Fill missing features; while training an infinite value fails the job."""
    def fill(name, value):
        c = F.col(name).cast("double")
        if training:
            infinite = F.abs(c) == F.lit(float("inf"))
            c = F.when(infinite, F.raise_error(F.lit(f"feature {name} contains infinite values")).cast("double")).otherwise(c)
        return F.when(S.is_finite(c), c).otherwise(F.lit(float(value)))

    return df.withColumns({n: fill(n, v) for n, v in medians.items()})


def scaler_statistics(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean and population deviation of every feature in one pass."""
    return df.agg(*[F.avg(f).alias(f"mean_{f}") for f in features], *[F.stddev_pop(f).alias(f"std_{f}") for f in features])


def fit_scaler(df: DataFrame, features: Sequence[str]) -> tuple[list[float], list[float]]:
    """(means, scales); a constant feature gets scale 1.  Runs a job."""
    row = scaler_statistics(df, features).first()
    return [row[f"mean_{f}"] for f in features], [row[f"std_{f}"] or 1.0 for f in features]


def scale(df: DataFrame, features: Sequence[str], means: Sequence[float], scales: Sequence[float]) -> DataFrame:
    return df.withColumns({f: (F.col(f) - F.lit(float(m))) / F.lit(float(s)) for f, m, s in zip(features, means, scales)})


MAX_LOGISTIC_ROUNDS = 200


# --- fitting --------------------------------------------------------------------------------
def _summed(table: DataFrame, partial, size: int) -> np.ndarray:
    """Element-wise sum of one ``size``-long vector per Arrow batch, added up on the cluster."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += partial(batch)
        yield pd.DataFrame({"pos": np.arange(size), "value": total})

    rows = table.mapInPandas(run, "pos int, value double").groupBy("pos").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r["pos"]] = r["value"]
    return out


def fit_squared_hinge(
    table: DataFrame, n_features: int, n_classes: int, *, c: float = 1.0, tol: float = 1e-8, max_rounds: int = 100
) -> tuple[np.ndarray, np.ndarray]:
    """One-vs-rest linear machines with squared hinge loss and a penalised intercept.

    ``table`` has ``x ARRAY<DOUBLE>``, ``y`` (class index) and ``w`` (weight).  The
    objective is strictly convex and smooth, so Newton steps reach the one optimum
    in a few rounds; a round is one pass that sums a gradient and a (features + 1)
    squared matrix per class, for all classes together.  The weights returned meet the
    gradient condition ``tol``; a fit that does not get there raises.
    """
    d = n_features + 1
    width = d * d + d + 1

    def sums(weights: np.ndarray) -> np.ndarray:
        def partial(batch: pd.DataFrame) -> np.ndarray:
            x = np.column_stack([np.stack(batch["x"].to_numpy()), np.ones(len(batch))])
            label, w = batch["y"].to_numpy(), batch["w"].to_numpy()
            parts = []
            for k in range(n_classes):
                y = np.where(label == k, 1.0, -1.0)
                gap = 1.0 - y * (x @ weights[k])
                on = gap > 0.0
                xs, ws = x[on], w[on]
                parts.append(np.concatenate([
                    ((xs * ws[:, None]).T @ xs).ravel(), -(xs * (ws * y[on] * gap[on])[:, None]).sum(axis=0), [(ws * gap[on] ** 2).sum()]]))
            return np.concatenate(parts)

        return _summed(table, partial, n_classes * width).reshape(n_classes, width)

    weights, step = np.zeros((n_classes, d)), np.zeros((n_classes, d))
    best, scale_by = np.full(n_classes, np.inf), np.ones(n_classes)
    for _ in range(max_rounds):
        trial = weights + scale_by[:, None] * step
        totals = sums(trial)
        loss = 0.5 * (trial ** 2).sum(axis=1) + c * totals[:, -1]
        better = loss <= best + 1e-12 * np.abs(best)
        settled = True
        for k in range(n_classes):
            if not better[k]:  # overshoot: halve this class's step and look again
                scale_by[k] /= 2.0
                settled = settled and scale_by[k] < 1e-6
                continue
            weights[k], best[k], scale_by[k] = trial[k], loss[k], 1.0
            gradient = trial[k] + 2.0 * c * totals[k, d * d:-1]
            hessian = np.eye(d) + 2.0 * c * totals[k, :d * d].reshape(d, d)
            step[k] = -np.linalg.solve(hessian, gradient)
            settled = settled and np.linalg.norm(gradient) <= tol * max(1.0, loss[k])
        if settled:
            break
    else:
        raise RuntimeError(f"the linear machines did not settle in {max_rounds} rounds; scale the features or lower C")
    return weights[:, :-1], weights[:, -1]


def fit_linear(
    train: DataFrame, features: Sequence[str], classes: Sequence[str], *, kind: str = "LinearSVC",
    class_weight: Mapping[str, float] | None = None, c: float = 1.0, label: str = "label",
) -> tuple[list[list[float]], list[float]]:
    """(weights, intercepts) per class from scaled features.  Runs jobs.

    ``LinearSVC`` fits one squared-hinge machine per class (see ``fit_squared_hinge``);
    ``LogisticRegression`` fits one multinomial model with the penalty 1 / (C * weights).
    """
    if kind not in ("LinearSVC", "LogisticRegression"):
        raise ValueError("classifier must be LinearSVC or LogisticRegression")
    weight = F.lit(1.0)
    for name, w in (class_weight or {}).items():
        weight = F.when(F.col(label) == name, F.lit(float(w))).otherwise(weight)
    index = F.lit(-1)
    for i, name in enumerate(classes):
        index = F.when(F.col(label) == name, F.lit(i)).otherwise(index)
    table = train.select(F.array(*[F.col(f) for f in features]).alias("x"), index.alias("y"), weight.alias("w")).persist()
    try:
        if kind == "LinearSVC":
            weights, intercepts = fit_squared_hinge(table, len(features), len(classes), c=c)
            return weights.tolist(), intercepts.tolist()
        total = table.agg(F.sum("w")).first()[0]
        fitted = LogisticRegression(
            labelCol="y", weightCol="w", family="multinomial", regParam=1.0 / (c * total), standardization=False, maxIter=MAX_LOGISTIC_ROUNDS, tol=1e-7,
        ).fit(table.select(array_to_vector("x").alias("features"), "y", "w"))
        if fitted.summary.totalIterations >= MAX_LOGISTIC_ROUNDS:
            raise RuntimeError(f"the logistic model did not settle in {MAX_LOGISTIC_ROUNDS} rounds; scale the features or lower C")
        return fitted.coefficientMatrix.toArray().tolist(), fitted.interceptVector.toArray().tolist()
    finally:
        table.unpersist()


def fit_calibrator(
    validation: DataFrame, classes: Sequence[str], *, margins: str = "margins", label: str = "label", c: float = 1e6,
    tol: float = 1e-7, max_rounds: int = 60,
) -> tuple[list[float], list[float]]:
    """(slopes, intercepts) of one sigmoid per class on validation margins.  Runs jobs.

    Newton steps on the penalised log loss.  A round is one aggregation with six plain
    sums per class, for all classes together.  A fit that does not meet ``tol`` raises.
    """
    counts = {r[label]: r["n"] for r in validation.groupBy(label).agg(F.count("*").alias("n")).collect()}
    rows = sum(counts.values())
    for name in classes:
        if not 0 < counts.get(name, 0) < rows:
            raise ValueError(f"validation needs positive and negative examples of {name!r}")
    k = len(classes)
    values, step, best, scale_by = np.zeros((k, 2)), np.zeros((k, 2)), np.full(k, np.inf), np.ones(k)
    for _ in range(max_rounds):
        trial = values + scale_by[:, None] * step
        sums = []
        for i, name in enumerate(classes):
            m, y = F.col(margins)[i], (F.col(label) == name).cast("double")
            z = m * F.lit(float(trial[i, 0])) + F.lit(float(trial[i, 1]))
            p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
            # log(1 + exp(z)) without overflow
            loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - y * z
            q = p * (F.lit(1.0) - p)
            sums += [F.sum(e).alias(f"s{i}_{j}") for j, e in enumerate(((p - y) * m, p - y, q * m * m, q * m, q, loss))]
        totals = np.array(validation.agg(*sums).first(), dtype=np.float64).reshape(k, 6)
        loss = totals[:, 5] + 0.5 / c * trial[:, 0] ** 2
        settled = True
        for i in range(k):
            if loss[i] > best[i] + 1e-12 * abs(best[i]):
                scale_by[i] /= 2.0
                settled = settled and scale_by[i] < 1e-6
                continue
            values[i], best[i], scale_by[i] = trial[i], loss[i], 1.0
            g0, g1, h00, h01, h11, _ = totals[i]
            gradient = np.array([g0 + trial[i, 0] / c, g1])
            hessian = np.array([[h00 + 1.0 / c, h01], [h01, h11]]) + 1e-12 * np.eye(2)
            step[i] = -np.linalg.solve(hessian, gradient)
            settled = settled and np.abs(gradient).max() <= tol * rows
        if settled:
            break
    else:
        raise RuntimeError(f"the calibration did not settle in {max_rounds} rounds")
    return values[:, 0].tolist(), values[:, 1].tolist()


# --- scoring ---------------------------------------------------------------------------------
def margin_columns(model: Mapping) -> Column:
    """Class margins as plain arithmetic on the named feature columns (compiled, no arrays)."""
    filled = {
        f: F.when(S.is_finite(F.col(f).cast("double")), F.col(f).cast("double")).otherwise(F.lit(float(v)))
        for f, v in zip(model["feature_names"], model["imputation_values"])
    }
    centred = [
        (filled[f] - F.lit(float(m))) / F.lit(float(s))
        for f, m, s in zip(model["feature_names"], model["standardization_mean"], model["standardization_scale"])
    ]
    rows = []
    for weights, intercept in zip(model["weights"], model["intercepts"]):
        total = F.lit(0.0)
        for column, w in zip(centred, weights):
            total = total + column * F.lit(float(w))
        rows.append(total + F.lit(float(intercept)))
    return F.array(*rows)


def score(df: DataFrame, model: Mapping) -> DataFrame:
    """Add ``margins`` and calibrated ``scores`` in the model's class order."""
    return df.withColumn("margins", margin_columns(model)).withColumn(
        "scores", P.calibrated_scores("margins", model["calibration_slopes"], model["calibration_intercepts"]))


def contract_match(model: Mapping) -> Column:
    """Whether a row's feature settings are those the model was fitted with."""
    same = F.lit(True)
    for name in ("sample_rate", "frame_ms", "hop_ms", "activity_rms_threshold"):
        same = same & F.coalesce(F.col(name) == F.lit(model[name]), F.lit(False))
    return same & F.coalesce(F.col("feature_schema_version") == F.lit(model["feature_schema_version"]), F.lit(False))


def match_contract(df: DataFrame, model: Mapping) -> DataFrame:
    return df.withColumn("model_status", F.when(contract_match(model), "READY").otherwise("INVALID"))


def predict(df: DataFrame, model: Mapping, *, status: str = "READY", check_contract: bool = False) -> DataFrame:
    """Score with a reject option: below the threshold the label is NULL, scores stay."""
    classes = list(model["classes"])
    ready = F.lit(status == "READY")
    if check_contract:
        ready = ready & contract_match(model)
    scored = score(df, model).withColumn("_ready", ready).withColumn(
        "scores", F.when(F.col("_ready"), F.col("scores"))).withColumn("confidence", F.coalesce(P.confidence("scores"), F.lit(0.0)))
    rejected = F.col("_ready") & (F.col("confidence") < F.lit(float(model["rejection_threshold"])))
    return (
        scored.withColumn("model_status", F.when(F.col("_ready"), "READY").otherwise(F.lit("INVALID" if status == "READY" else status)))
        .withColumn("emotion", F.when(F.col("_ready") & ~rejected, P.pick_class("scores", classes)))
        .withColumn("rejection_status", F.when(~F.col("_ready") & F.lit(status == "NOT_CONFIGURED"), "NOT_CONFIGURED").when(
            ~F.col("_ready") | rejected, "UNCERTAIN"))
        .drop("_ready")
    )


# --- registry audit --------------------------------------------------------------------------
def _good_vector(name: str, size: Column) -> Column:
    return (F.size(name) == size) & F.forall(name, lambda x: x.isNotNull() & S.is_finite(x))


def _positive_counts(column: str) -> Column:
    return F.forall("classes", lambda c: F.coalesce(F.try_element_at(F.col(column), c), F.lit(0)) > 0)


def audit_rules(expected: Mapping | None = None) -> list[tuple[str, Column]]:
    """(rule, condition that must hold) in checking order."""
    n_class = F.size("classes")
    names, schemas = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
    for profile, fields, schema in (
        ("full", settings.FULL_FEATURES, settings.FULL_SCHEMA), ("simple", settings.SIMPLE_FEATURES, settings.SIMPLE_SCHEMA)):
        names = F.when(F.col("feature_profile") == profile, F.array(*[F.lit(f) for f in fields])).otherwise(names)
        schemas = F.when(F.col("feature_profile") == profile, F.lit(schema)).otherwise(schemas)
    n_feat = F.size("feature_names")
    positive = lambda c: S.is_finite(F.col(c)) & (F.col(c) > 0)
    digest = lambda c: F.col(c).rlike("^[0-9a-f]{64}$")
    lib = lambda f: F.col(f"training_library.{f}")
    method = F.lower("validation.threshold_selection_method")
    rules = [
        ("format_version", F.col("format_version") == settings.MODEL_FORMAT),
        ("feature_profile", F.col("feature_schema_version") == schemas),
        ("feature_names", F.col("feature_names") == names),
        ("sample_rate", F.col("sample_rate") > 1000),
        ("frame_hop", positive("frame_ms") & positive("hop_ms") & (F.col("hop_ms") <= F.col("frame_ms"))),
        ("live_window", positive("window_s") & positive("update_interval_s") & (F.col("update_interval_s") <= F.col("window_s"))),
        ("activity_threshold", S.is_finite(F.col("activity_rms_threshold")) & (F.col("activity_rms_threshold") >= 0)),
        ("classes", (n_class >= 2) & (F.size(F.array_distinct("classes")) == n_class)
         & F.forall("classes", lambda c: c.isin(*settings.EMOTIONS))),
        *[(v, _good_vector(v, n_feat)) for v in ("imputation_values", "standardization_mean", "standardization_scale")],
        *[(v, _good_vector(v, n_class)) for v in ("intercepts", "calibration_slopes", "calibration_intercepts")],
        ("positive_scales", F.forall("standardization_scale", lambda x: x > 0)),
        ("weights", (F.size("weights") == n_class) & F.forall("weights", lambda w: (F.size(w) == n_feat) & F.forall(
            w, lambda x: x.isNotNull() & S.is_finite(x)))),
        ("rejection_threshold", F.col("rejection_threshold").between(0.0, 1.0)),
        ("validation", F.col("validation.sample_count") > 0),
        ("training", F.col("training.sample_count") > 0),
        ("dataset_split", F.length("dataset_split.method") > 0),
        ("threshold_selected_on", F.col("validation.threshold_selected_on") == "validation"),
        ("threshold_method", method.contains("validation") & ~method.contains("test")),
        ("digests", digest("training_manifest_sha256") & digest("validation.manifest_sha256") & digest("label_mapping_sha256")),
        ("same_manifest", F.col("training_manifest_sha256") == F.col("validation.manifest_sha256")),
        ("label_mapping", F.col("label_mapping").isNotNull()),
        ("training_library", (F.length(lib("scikit_learn_version")) > 0) & (
            ((lib("classifier") == "LinearSVC") & (lib("dual") == "auto"))
            | ((lib("classifier") == "LogisticRegression") & (lib("solver") == "lbfgs") & lib("dual").isNull() & (lib("max_iter") > 0)))),
        ("preprocessing", (lib("standardization") == settings.STANDARDIZATION_METHOD) & (lib("imputation") == settings.IMPUTATION_METHOD)),
        ("regularisation", S.is_finite(lib("C")) & (lib("C") > 0)),
        ("class_weight", lib("class_weight").isNull() | (
            (F.array_sort(F.map_keys(lib("class_weight"))) == F.array_sort("classes"))
            & F.forall(F.map_values(lib("class_weight")), lambda w: S.is_finite(w) & (w > 0)))),
        ("training_classes", _positive_counts("training.class_counts")),
        ("validation_classes", _positive_counts("validation.class_counts")),
        ("calibration_scores", F.col("validation.brier_score").between(0.0, 1.0) & F.col("validation.ece").between(0.0, 1.0)),
        ("calibration_status", F.col("calibration_status").isin("CALIBRATED", "UNCALIBRATED")),
        ("calibration_method", F.col("calibration_method") == settings.CALIBRATION_METHOD),
        ("quality_gates", F.size(F.array_except(
            F.array(*[F.lit(k) for k in settings.QUALITY_GATE_KEYS]), F.map_keys("quality_gates"))) == 0),
    ]
    for name, value in (expected or {}).items():
        rules.insert(1, (f"expected_{name}", F.col(name) == F.lit(value)))
    return rules


def parameter_count() -> Column:
    vectors = ("intercepts", "standardization_mean", "standardization_scale", "imputation_values",
               "calibration_slopes", "calibration_intercepts")
    total = F.aggregate("weights", F.lit(0), lambda acc, w: acc + F.size(w))
    for v in vectors:
        total = total + F.size(v)
    return total


def audit_models(models: DataFrame, expected: Mapping | None = None) -> DataFrame:
    """Status, first failing rule and parameter count of every model document.

    A row without a document (``format_version`` and ``classes`` both absent and marked
    ``missing``) is NOT_CONFIGURED.
    """
    failing = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in audit_rules(expected)])
    absent = F.col("missing") if "missing" in models.columns else F.lit(False)
    return (
        models.withColumn("failed_rule", F.when(~absent, failing))
        .withColumn("model_status", F.when(absent, "NOT_CONFIGURED").when(F.col("failed_rule").isNotNull(), "INVALID").when(
            F.col("calibration_status") == "CALIBRATED", "READY").otherwise("UNCALIBRATED"))
        .withColumn("parameter_count", F.when(F.col("model_status").isin("READY", "UNCALIBRATED"), parameter_count()))
    )
