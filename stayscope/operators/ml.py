"""Price models: split, encode, scale, fit, evaluate, compare, cross-validate.

Splits and folds come from a hash of the row key, so a lost and recomputed partition
yields the same rows. Fitted preprocessing is part of the saved pipeline.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stayscope.functions.numeric import half_up, hash_bucket
from stayscope.functions.side_by_side import side_by_side
from stayscope.operators.boosting import PenalisedBoosting, Penalties
from stayscope.operators.distribution import histogram, quantiles_from_counts
from stayscope.operators.forest import SharedRowsForest
from stayscope.operators.lookup import attach
from stayscope.schema import CATEGORICAL_FEATURES, DEFAULT_DAYS_SINCE_REVIEW, MODEL_VERSION, NUMERIC_FEATURES, TARGET
from stayscope.sources.staging import new_path, shared_folder, stage
from stayscope.sources.literal import literal_table

SEED = 42
#: Megabytes of split statistics that a task of the forest holds at a time; executors hold that times their cores.
FOREST_MB = 128
FEATURES = CATEGORICAL_FEATURES + NUMERIC_FEATURES


# ---- Split ----


def with_test_flag(
    df: DataFrame, key: str = "id", seed: int = SEED, test_percent: int = 20
) -> DataFrame:
    return df.withColumn("is_test", (hash_bucket(F.col(key), seed, 100) < test_percent).cast("int"))


def train_test_split(
    df: DataFrame, key: str = "id", seed: int = SEED, test_percent: int = 20
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows, 80/20 by default; the same key always lands on the same side."""
    flagged = with_test_flag(df, key, seed, test_percent)
    return (
        flagged.where(F.col("is_test") == 0).drop("is_test"),
        flagged.where(F.col("is_test") == 1).drop("is_test"),
    )


def with_fold(df: DataFrame, folds: int = 5, key: str = "id", seed: int = SEED + 1) -> DataFrame:
    return df.withColumn("fold", hash_bucket(F.col(key), seed, folds))


# ---- Preprocessing as plain tables ----


def ordinal_codes(train: DataFrame, column: str) -> DataFrame:
    """(value, code, n): categories in alphabetical order, coded from 0."""
    counts = train.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn(
        f"{column}_code", (F.row_number().over(Window.orderBy(column)) - 1).cast("int")
    )


def ordinal_encode(
    df: DataFrame, train: DataFrame, columns: list[str] = CATEGORICAL_FEATURES
) -> DataFrame:
    """Codes learnt from ``train``; categories it never saw get -1."""
    for c in columns:
        df = attach(df, ordinal_codes(train, c), [c], weight="n").fillna(-1, subset=[f"{c}_code"])
    return df


def standard_scale(
    df: DataFrame, train: DataFrame, columns: list[str] = NUMERIC_FEATURES
) -> DataFrame:
    """(x - mean) / population deviation of ``train``; a constant column becomes 0."""
    facts = train.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
        ).alias("f")
    ).scalar()
    scaled = {
        f"{c}_scaled": F.when(
            F.col(f"_f.s_{c}") > 0, (F.col(c) - F.col(f"_f.m_{c}")) / F.col(f"_f.s_{c}")
        ).otherwise(0.0)
        for c in columns
    }
    return df.withColumn("_f", facts).withColumns(scaled).drop("_f")


# ---- Preprocessing as saveable stages ----


def fit_preprocessor(
    train: DataFrame,
    categorical: list[str] = CATEGORICAL_FEATURES,
    numeric: list[str] = NUMERIC_FEATURES,
) -> PipelineModel:
    """Stages turning raw features into one vector, categories first.

    The indexer puts unseen categories after the known ones; the SQL stage maps them to -1
    and drops the nominal marking, so trees treat codes as numbers and need no bin per
    category. Means and population deviations (two numbers per column) are written into it.
    """
    facts = train.agg(
        *[F.avg(c).alias(f"m_{c}") for c in numeric],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in numeric],
    ).first()
    stages, columns = [], []
    if categorical:
        indexer = StringIndexer(
            inputCols=categorical,
            outputCols=[f"{c}_index" for c in categorical],
            stringOrderType="alphabetAsc",
            handleInvalid="keep",
        ).fit(train)
        stages.append(indexer)
        columns = [
            f"CASE WHEN {c}_index >= {len(labels)} THEN -1.0D ELSE {c}_index + 0.0D END AS {c}_x"
            for c, labels in zip(categorical, indexer.labelsArray)
        ]
    for c in numeric:
        mean, dev = facts[f"m_{c}"], facts[f"s_{c}"]
        scaled = f"(CAST({c} AS DOUBLE) - ({mean!r}D)) / {dev!r}D" if dev else "0.0D"
        columns.append(f"{scaled} AS {c}_x")
    names = [f"{c}_x" for c in categorical + numeric]
    helpers = [f"{c}_index" for c in categorical] + names
    stages += [
        SQLTransformer(statement=f"SELECT *, {', '.join(columns)} FROM __THIS__"),
        VectorAssembler(inputCols=names, outputCol="features", handleInvalid="error"),
        SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(helpers)}) FROM __THIS__"),
    ]
    return PipelineModel(stages=stages)


# ---- Models ----


def linear_model(**kw) -> LinearRegression:
    """Least squares from one pass of normal equations.

    Constant or collinear features make those singular; Spark then iterates on the small
    system, so the tolerance is tight and the rounds cost no further pass.
    """
    return LinearRegression(
        labelCol=TARGET,
        featuresCol="features",
        regParam=0.0,
        solver="normal",
        tol=1e-12,
        maxIter=1_000,
        **kw,
    )


def forest_model(trees: int = 200, depth: int = 15, **kw) -> RandomForestRegressor:
    return SharedRowsForest(
        labelCol=TARGET,
        featuresCol="features",
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=5,
        featureSubsetStrategy="0.8",
        seed=SEED,
        maxMemoryInMB=FOREST_MB,
        **kw,
    )


def gbt_model(rounds: int = 300, step: float = 0.05, depth: int = 6, **kw) -> PenalisedBoosting:
    """Second-order boosting with an L2 penalty of 1; rows and columns drawn for each tree."""
    settings = {"penalties": Penalties(), "row_share": 0.8, "column_share": 0.8, "seed": SEED, **kw}
    return PenalisedBoosting(rounds, step, depth, labelCol=TARGET, **settings)


def gbt_tuned_model(rounds: int = 500, step: float = 0.02, depth: int = 5, **kw) -> PenalisedBoosting:
    """Slower, shallower boosting with penalties on leaves."""
    penalties = Penalties(l1=0.1, l2=1.5, leaf=0.1, min_rows=5)
    return gbt_model(rounds, step, depth, **{"penalties": penalties, "row_share": 0.75, "column_share": 0.75, **kw})


def model_set(rounds: int | None = None, trees: int | None = None) -> dict[str, Estimator]:
    """The four compared models. ``rounds`` and ``trees`` shorten boosting and forest."""
    return {
        "LinearRegression": linear_model(),
        "RandomForest": forest_model(**({"trees": trees} if trees else {})),
        "Boosting": gbt_model(**({"rounds": rounds} if rounds else {})),
        "Boosting_Tuned": gbt_tuned_model(**({"rounds": rounds} if rounds else {})),
    }


def fit(
    train: DataFrame, estimator: Estimator, preprocessor: PipelineModel | None = None
) -> PipelineModel:
    """Preprocessing and model as one pipeline that takes raw features."""
    shared_folder(train.sparkSession)  # boosting cuts its lineage in the checkpoint folder
    pre = preprocessor or fit_preprocessor(train)
    return PipelineModel(stages=[*pre.stages, estimator.fit(pre.transform(train))])


def fit_all(train: DataFrame, models: dict[str, Estimator], preprocessor: PipelineModel | None = None) -> dict[str, PipelineModel]:
    """The fitted models, all fitted at the same time: boosting of few rows is one task, the others use the rest of the cores."""
    pre = preprocessor or fit_preprocessor(train)
    shared_folder(train.sparkSession)
    fitted = side_by_side(train.sparkSession, [partial(fit, train, e, pre) for e in models.values()])
    return dict(zip(models, fitted))


# ---- Evaluation ----


def evaluate(df: DataFrame, label: str = TARGET, prediction: str = "prediction") -> DataFrame:
    """rmse, mae (2 digits) and r2 (4 digits) in one pass."""
    y = F.col(label).cast("double")
    e = y - F.col(prediction)
    sse, sst = F.sum(e * e), F.var_pop(y) * F.count(y)
    return df.agg(
        half_up(F.sqrt(F.avg(e * e)), 2).alias("rmse"),
        half_up(F.avg(F.abs(e)), 2).alias("mae"),
        half_up(1 - F.try_divide(sse, sst), 4).alias("r2"),
    )


def compare_models(results: list[tuple[str, DataFrame]]) -> DataFrame:
    """Metrics of all models; ``is_best`` marks the lowest rounded RMSE, the first on ties."""
    rows = [
        m.withColumn("model", F.lit(name)).withColumn("position", F.lit(i))
        for i, (name, m) in enumerate(results)
    ]
    table = rows[0]
    for r in rows[1:]:
        table = table.unionByName(r)
    place = F.row_number().over(Window.orderBy("rmse", "position"))
    return table.select(
        "position", "model", "rmse", "mae", "r2", (place == 1).cast("int").alias("is_best")
    )


def best_model(comparison: DataFrame) -> str:
    return comparison.where(F.col("is_best") == 1).first()["model"]


def cross_validate(
    train: DataFrame,
    estimator: Estimator,
    folds: int = 5,
    label: str = TARGET,
    fit_fn: Callable[[DataFrame, Estimator], PipelineModel] = fit,
) -> DataFrame:
    """Per-fold RMSE, the preprocessing refitted on each fold's training part.

    Penalised boosting grows all folds from the same passes. It takes codes and scales from the whole
    of ``train``; trees see only the order of values, so just categories that a fold's other rows lack differ.
    """
    folded = stage(with_fold(train, folds), "folds")
    if isinstance(estimator, PenalisedBoosting) and fit_fn is fit:
        ready = fit_preprocessor(folded).transform(folded)
        errors = literal_table(train.sparkSession, estimator.fold_errors(ready, "fold", folds), "fold int, rmse double")
        return errors.withColumn("rmse", half_up(F.col("rmse"), 2))
    rest = [folded.where(F.col("fold") != k) for k in range(folds)]
    shared_folder(train.sparkSession)
    models, out = side_by_side(train.sparkSession, [partial(fit_fn, r, estimator) for r in rest]), None
    for k, fitted in enumerate(models):
        scored = fitted.transform(folded.where(F.col("fold") == k))
        row = evaluate(scored, label).select(F.lit(k).alias("fold"), "rmse")
        out = row if out is None else out.unionByName(row)
    return out


def cross_validate_median(
    train: DataFrame, group: str, label: str = TARGET, folds: int = 5
) -> DataFrame:
    """Per-fold RMSE of the group-median predictor, all folds from one pass of counts.

    (fold, group, price) counts hold everything: leaving out a fold re-adds the counts of
    the others, and errors are weighted by the counts of the fold itself.
    """
    counts = stage(
        with_fold(train, folds).groupBy("fold", group, label).agg(F.count(F.lit(1)).alias("n")),
        "fold-counts",
    )
    others = F.filter(
        F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col("fold")
    )
    training = (
        counts.select(F.explode(others).alias("fold"), group, label, "n")
        .groupBy("fold", group, label)
        .agg(F.sum("n").alias("n"))
    )
    medians = quantiles_from_counts(training, ["fold", group], label, {"prediction": 0.5})
    e = F.col(label) - F.col("prediction")
    return (
        counts.join(medians, ["fold", group])
        .groupBy("fold")
        .agg(half_up(F.sqrt(F.sum(e * e * F.col("n")) / F.sum("n")), 2).alias("rmse"))
    )


def fold_moments(train: DataFrame, columns: list[str], label: str, folds: int, key: str = "id") -> dict[int, tuple]:
    """fold -> (rows, means, sums of centred products) of the columns and the label, from one pass.

    Rows that lack any of them are left out. Spark merges the centred moments of tasks, so large
    means cost no digits; a row per fold reaches the driver.
    """
    names = [*columns, label]
    z = [F.col(c).cast("double").alias(f"z{i}") for i, c in enumerate(names)]
    rows = with_fold(train.dropna(subset=names), folds, key).select("fold", *z)
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    found = rows.groupBy("fold").agg(
        F.count("*").alias("n"),
        *[F.avg(f"z{i}").alias(f"m{i}") for i in range(len(names))],
        *[F.covar_pop(f"z{i}", f"z{j}").alias(f"c{i}_{j}") for i, j in pairs],
    )
    out = {}
    for r in found.collect():
        products = np.zeros((len(names), len(names)))
        for i, j in pairs:
            products[i, j] = products[j, i] = r[f"c{i}_{j}"] * r["n"]
        out[r["fold"]] = r["n"], np.array([r[f"m{i}"] for i in range(len(names))]), products
    return out


def merged_moments(parts: list[tuple]) -> tuple:
    """Moments of all parts together."""
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    return n, mean, sum(p[2] + p[0] * np.outer(p[1] - mean, p[1] - mean) for p in parts)


def least_squares(moments: tuple) -> tuple[np.ndarray, float]:
    """Slopes and intercept; constant and collinear columns get the smallest slopes that fit."""
    _, mean, products = moments
    x, y = products[:-1, :-1], products[:-1, -1]
    scale = np.sqrt(np.diag(x))
    scale[scale == 0] = 1.0
    slopes = np.linalg.lstsq(x / np.outer(scale, scale), y / scale, rcond=1e-12)[0] / scale
    return slopes, float(mean[-1] - mean[:-1] @ slopes)


def cross_validate_least_squares(
    train: DataFrame, columns: list[str], label: str = TARGET, folds: int = 5, key: str = "id"
) -> DataFrame:
    """Per-fold RMSE of a linear model of numeric columns, all folds from one pass over the rows.

    A fold's model comes from the other folds' moments, and its error from its own, so no row is
    read again. A fold without rows, or without other folds, has no error.
    """
    moments, rows = fold_moments(train, columns, label, folds, key), []
    for k in range(folds):
        others, rmse = [m for f, m in moments.items() if f != k], None
        if k in moments and others:
            slopes, intercept = least_squares(merged_moments(others))
            n, mean, products = moments[k]
            left = np.append(-slopes, 1.0)
            rmse = float(np.sqrt(max(left @ products @ left / n + (left @ mean - intercept) ** 2, 0.0)))
        rows.append((k, rmse))
    found = literal_table(train.sparkSession, rows, "fold int, rmse double")
    return found.withColumn("rmse", half_up(F.col("rmse"), 2))


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean and population deviation of the fold scores."""
    return folds.agg(
        half_up(F.avg("rmse"), 2).alias("mean_rmse"), half_up(F.stddev_pop("rmse"), 2).alias("std_rmse")
    )


def feature_importance(
    spark: SparkSession, model: PipelineModel, names: list[str] = FEATURES, top: int | None = None
) -> DataFrame:
    """Importance per feature, the largest first; no rows for models without any."""
    found = getattr(model.stages[-1], "featureImportances", None)
    values = [] if found is None else [float(v) for v in found.toArray()]
    rows = sorted(zip(names, values), key=lambda r: (-r[1], r[0]))[:top]
    return literal_table(spark, rows, "feature string, importance double")


def actual_vs_predicted(scored: DataFrame, label: str = TARGET) -> DataFrame:
    """(actual, predicted) pairs with the common axis end."""
    axis = scored.agg(F.greatest(F.max(label), F.max("prediction"))).scalar()
    return scored.select(
        F.col(label).alias("actual"), F.col("prediction").alias("predicted")
    ).withColumn("axis_max", axis)


def with_residual(scored: DataFrame, label: str = TARGET) -> DataFrame:
    return scored.withColumn("residual", F.col(label) - F.col("prediction"))


def residual_histogram(scored: DataFrame, label: str = TARGET, bins: int = 60) -> DataFrame:
    return histogram(with_residual(scored, label), "residual", bins)


def train_all(
    ml_rows: DataFrame,
    rounds: int | None = None,
    trees: int | None = None,
    folds: int = 5,
    fitted: dict[str, PipelineModel] | None = None,
) -> dict:
    """Split, fit the four models, compare, cross-validate the winner, save it.

    Train and test parts are written once, so the many passes of fitting read ready columns.
    ``fitted`` holds the four models if they are already fitted on these rows' train part.
    """
    spark = ml_rows.sparkSession
    train, test = train_test_split(ml_rows)
    train, test = stage(train, "train"), stage(test, "test")
    models = model_set(rounds, trees)
    if fitted is None:
        fitted = fit_all(train, models)
    comparison = stage(
        compare_models([(n, evaluate(m.transform(test))) for n, m in fitted.items()]), "comparison"
    )
    best = best_model(comparison)
    scored = stage(fitted[best].transform(test).drop("features"), "scored")
    cv = stage(cross_validate(train, models[best], folds), "cv")
    path = new_path(spark, "model")
    save_model(fitted[best], comparison.where(F.col("is_best") == 1), path, train)
    return {
        "models": fitted,
        "comparison": comparison,
        "best": best,
        "scored": scored,
        "cv": cv,
        "cv_summary": cv_summary(cv),
        "importance": feature_importance(spark, fitted[best]),
        "actual_vs_predicted": actual_vs_predicted(scored),
        "residuals": residual_histogram(scored),
        "model_path": path,
    }


# ---- Saved models ----


#: Saved with a model, besides its name and metrics.
_FACTS = "model string, rmse double, mae double, r2 double, version string, mean_days_since_review double"


def save_model(model: PipelineModel, metrics: DataFrame, path: str, train: DataFrame | None = None, release: int = 1) -> str:
    """Pipeline and its one-row metrics (model, rmse, mae, r2) side by side.

    The version is the model's name in small letters with the release; the mean days since a review
    are those of ``train``, which scoring takes for requests.
    """
    model.write().overwrite().save(f"{path}/pipeline")
    days = F.lit(None).cast("double") if train is None else train.agg(F.avg("days_since_last_review")).scalar()
    facts = metrics.select(
        "model", "rmse", "mae", "r2", F.concat(F.lower("model"), F.lit(f"_v{release}")).alias("version"), days.alias("mean_days_since_review")
    )
    facts.write.mode("overwrite").json(f"{path}/metadata")
    return path


def model_facts(spark: SparkSession, path: str) -> dict:
    """Name, metrics, version and mean days since a review of a saved model."""
    facts = spark.read.schema(_FACTS).json(f"{path}/metadata").first().asDict()
    missing = facts["mean_days_since_review"] is None
    return facts | ({"mean_days_since_review": DEFAULT_DAYS_SINCE_REVIEW} if missing else {})


def load_model(path: str) -> PipelineModel:
    try:
        return PipelineModel.load(f"{path}/pipeline")
    except Exception as e:
        if "does not exist" in str(e).lower() or "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"no model at {path}; train and save one first") from e
        raise


def model_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Saved name and metrics of a model, with the service facts of its release."""
    return (
        spark.read.schema("model string, rmse double, mae double, r2 double")
        .json(f"{path}/metadata")
        .withColumn("model_version", F.lit(MODEL_VERSION))
        .withColumn("features_used", F.lit(len(FEATURES)))
        .withColumn("target", F.lit("price (USD per night)"))
    )


def model_report(comparison: DataFrame, cv: DataFrame, importance: DataFrame) -> DataFrame:
    """Long table (section, label, value): metrics, fold scores with their mean, importances."""
    metric = F.explode(
        F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).alias("value")) for m in ("rmse", "mae", "r2")])
    )
    metrics = comparison.select("model", metric.alias("v")).select(
        F.lit("comparison").alias("section"), F.concat_ws(" ", "model", "v.m").alias("label"), "v.value"
    )
    scores = cv.select(
        F.lit("cross_validation").alias("section"),
        F.concat(F.lit("Fold "), (F.col("fold") + 1).cast("string")).alias("label"),
        F.col("rmse").alias("value"),
    )
    mean = cv_summary(cv).select(
        F.lit("cross_validation").alias("section"), F.lit("mean").alias("label"), F.col("mean_rmse").alias("value")
    )
    ranked = importance.select(
        F.lit("importance").alias("section"), F.col("feature").alias("label"), F.col("importance").alias("value")
    ).orderBy("value")
    return metrics.unionByName(scores).unionByName(mean).unionByName(ranked)
