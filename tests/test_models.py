from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stayscope.operators import ml, score as sc
from stayscope.schema import REQUEST_SCHEMA
from stayscope.sources.staging import new_path
from stayscope.sources.writers import save_table
from stayscope.streaming.scoring import read_requests, read_written, start_scoring


def test_split_is_disjoint_complete_and_stable(workspace):
    rows = workspace.ml_rows
    train, test = ml.train_test_split(rows)
    again, _ = ml.train_test_split(rows.repartition(11))
    assert train.join(test, "id").count() == 0
    assert train.count() + test.count() == rows.count()
    assert train.select("id").exceptAll(again.select("id")).count() == 0
    assert test.count() / rows.count() == pytest.approx(0.2, abs=0.04)


def test_unseen_category_is_minus_one(spark):
    train = spark.createDataFrame([("b", 1.0), ("a", 2.0)], "c string, x double")
    new = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("z", 1.0)], "c string, x double")
    got = {r["c"]: r["c_code"] for r in ml.ordinal_encode(new, train, ["c"]).collect()}
    assert got == {"a": 0, "b": 1, "z": -1}
    staged = ml.fit_preprocessor(train, ["c"], ["x"]).transform(new)
    assert {r["c"]: r["features"][0] for r in staged.collect()} == {"a": 0.0, "b": 1.0, "z": -1.0}


def test_scale_uses_population_deviation(spark):
    df = spark.createDataFrame([(float(i), 5.0) for i in range(4)], "x double, c double")
    got = ml.standard_scale(df, df, ["x", "c"]).orderBy("x").collect()
    assert got[0]["x_scaled"] == pytest.approx(-1.5 / 1.118034, abs=1e-6)
    assert {r["c_scaled"] for r in got} == {0.0}


def test_winner_is_first_lowest_rounded_rmse(spark):
    rows = [("a", 2.0), ("b", 1.0), ("c", 1.0)]
    parts = [(n, spark.createDataFrame([(r, 0.0, 0.0)], "rmse double, mae double, r2 double")) for n, r in rows]
    assert ml.best_model(ml.compare_models(parts)) == "b"


def test_evaluate_matches_spark_evaluator(workspace):
    from pyspark.ml.evaluation import RegressionEvaluator

    scored = workspace.test.withColumn("prediction", F.col("neighbourhood_median_price"))
    ours = ml.evaluate(scored).first()
    for metric in ("rmse", "mae", "r2"):
        theirs = RegressionEvaluator(labelCol="price", metricName=metric).evaluate(scored)
        assert ours[metric] == pytest.approx(theirs, abs=0.006)


def test_models_beat_the_mean_and_survive_saving(spark, workspace):
    mean = workspace.train.agg(F.avg("price")).first()[0]
    base = ml.evaluate(workspace.train.withColumn("prediction", F.lit(mean))).first()["rmse"]
    pre = ml.fit_preprocessor(workspace.train)
    for name, estimator in ml.model_set(rounds=3, trees=5).items():
        fitted = ml.fit(workspace.train, estimator, pre)
        assert ml.evaluate(fitted.transform(workspace.train)).first()["rmse"] < base, name
        if name == "Boosting_Tuned":
            metrics = ml.evaluate(fitted.transform(workspace.test)).withColumn("model", F.lit(name))
            path = ml.save_model(fitted, metrics, new_path(spark, "test-model"))
            a = fitted.transform(workspace.test).select("id", "prediction")
            b = ml.load_model(path).transform(workspace.test).select("id", "prediction")
            assert a.exceptAll(b).count() == 0
            assert ml.model_metadata(spark, path).first()["model"] == name
            importance = ml.feature_importance(spark, fitted)
            assert importance.count() == 16
            assert importance.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
        if name == "LinearRegression":
            assert ml.feature_importance(spark, fitted).count() == 0


def test_linear_residuals_are_orthogonal_to_features(workspace):
    """The defining property of least squares, on every numeric feature and the constant."""
    scored = ml.with_residual(ml.fit(workspace.train, ml.linear_model()).transform(workspace.train))
    scaled = ml.standard_scale(scored, workspace.train)
    sums = scaled.agg(
        F.avg("residual"), *[F.avg(F.col("residual") * F.col(f"{c}_scaled")) for c in ml.NUMERIC_FEATURES]
    ).first()
    assert max(abs(v) for v in sums) < 1e-3


def test_missing_model(spark):
    with pytest.raises(FileNotFoundError):
        ml.load_model(new_path(spark, "nothing"))


def test_default_model_sizes():
    assert ml.forest_model().getNumTrees() == 200 and ml.forest_model().getMaxDepth() == 15
    growth, tuned = ml.gbt_model().growth, ml.gbt_tuned_model().growth
    assert (growth.rounds, growth.step, growth.depth, growth.row_share, growth.column_share) == (300, 0.05, 6, 0.8, 0.8)
    assert (tuned.rounds, tuned.step, tuned.depth, tuned.row_share, tuned.column_share) == (500, 0.02, 5, 0.75, 0.75)
    assert tuned.penalties == ml.Penalties(l1=0.1, l2=1.5, leaf=0.1, min_rows=5)


GOOD = dict(
    request_id=1, neighbourhood_group="Brooklyn", neighbourhood=" williamsburg ", room_type="Private room",
    minimum_nights=2, number_of_reviews=45, reviews_per_month=1.5,
    calculated_host_listings_count=1, availability_365=200, name_length=40,
)


def requests(spark, *changes):
    rows = [tuple({**GOOD, **c}[n] for n in REQUEST_SCHEMA.names) for c in changes]
    return spark.createDataFrame(rows, REQUEST_SCHEMA)


@pytest.mark.parametrize(
    "field, value",
    [("minimum_nights", 0), ("minimum_nights", 366), ("reviews_per_month", 58.6), ("name_length", 201),
     ("neighbourhood", "x"), ("neighbourhood_group", "brooklyn"), ("neighbourhood_group", " Brooklyn"),
     ("room_type", "Tent"), ("availability_365", None), ("number_of_reviews", 630),
     ("calculated_host_listings_count", 328)],
)
def test_one_violation_each(spark, field, value):
    valid, rejected = sc.validate_requests(requests(spark, {field: value}, {}))
    assert [r["violations"] for r in rejected.collect()] == [[field]]
    assert [r["neighbourhood"] for r in valid.collect()] == ["Williamsburg"]


def test_scoring_lookups(spark):
    df = requests(
        spark,
        {"request_id": 1, "neighbourhood": "Hell'S Kitchen", "neighbourhood_group": "Manhattan"},
        {"request_id": 2, "neighbourhood": "Nowhere"},
        {"request_id": 3, "neighbourhood": "Nowhere", "neighbourhood_group": "Elsewhere"},
    )
    got = sc.scoring_features(df, sc.published_medians(spark)).orderBy("request_id").collect()
    pairs = [(r["neighbourhood_median_price"], r["neighbourhood_group_median_price"]) for r in got]
    assert pairs == [(150.0, 150.0), (90.0, 90.0), (106.0, 106.0)]
    assert {r["days_since_last_review"] for r in got} == {277.95}
    assert got[0]["availability_ratio"] == round(200 / 365, 4)


def test_price_clamp(spark):
    df = requests(spark, {}, {}, {}).withColumn(
        "prediction", F.element_at(F.array(F.lit(-20.0), F.lit(900.0), F.lit(127.505)), F.lit(1))
    )
    low = sc.price_response(df).first()
    assert (low["predicted_price"], low["price_range_low"], low["price_range_high"]) == (10.0, 10.0, 57.2)
    high = sc.price_response(df.withColumn("prediction", F.lit(900.0))).first()
    assert (high["predicted_price"], high["price_range_low"], high["price_range_high"]) == (799.0, 751.8, 799.0)
    assert high["input_summary"]["borough"] == "Brooklyn" and high["currency"] == "USD"


def test_stream_equals_batch(spark, workspace):
    from stayscope.plans.catalog import BOROUGH_NAMES

    model = ml.fit(workspace.train, ml.linear_model())
    asked = workspace.requests.repartition(4)
    source = save_table(asked, new_path(spark, "requests"))
    out, bad, state = (new_path(spark, n) for n in ("out", "bad", "state"))
    stream = read_requests(spark, source, files_per_trigger=1)
    start_scoring(stream, workspace.medians, model.transform, out, bad, state, BOROUGH_NAMES).awaitTermination()
    valid, rejected = sc.validate_requests(asked, BOROUGH_NAMES)
    batch = sc.score(valid, workspace.medians, model.transform)
    streamed = read_written(spark, out)
    assert streamed.count() == batch.count() > 0
    assert streamed.exceptAll(batch).count() == 0
    assert read_written(spark, bad).exceptAll(rejected).count() == 0
    assert read_written(spark, bad).count() == rejected.count() > 0
    # The last batch again, as after a crash before its commit: both outputs stay as they are.
    commits = Path(state.removeprefix("file:"), "commits")
    number = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    assert number >= 3
    for name in (str(number), f".{number}.crc"):
        (commits / name).unlink(missing_ok=True)
    start_scoring(stream, workspace.medians, model.transform, out, bad, state, BOROUGH_NAMES).awaitTermination()
    assert read_written(spark, out).count() == batch.count()
    assert read_written(spark, bad).count() == rejected.count()


def test_registered_models_are_full_size_and_fitted_once(spark, folder, monkeypatch):
    from stayscope.plans import workspace as ws
    from stayscope.plans.catalog import QUERIES

    asked, folds, fit = [], [], ml.fit

    def linear_instead(train, estimator, preprocessor=None):
        asked.append(estimator)
        return fit(train, ml.linear_model(), preprocessor)

    def counted(train, estimator, n=5, *args, **kw):
        folds.append(n)
        return cross_validate(train, ml.linear_model(), n, *args, **kw)

    cross_validate = ml.cross_validate
    for module in (ml, ws):
        monkeypatch.setattr(module, "fit", linear_instead, raising=False)
    monkeypatch.setattr(ml, "cross_validate", counted)
    monkeypatch.setitem(ws._OPEN, (spark.sparkContext.applicationId, folder), ws.Workspace(spark, folder))
    for name in ("fit_forest", "fit_gbt", "fit_gbt_tuned", "feature_importance", "model_report", "train_all"):
        QUERIES[name](spark, folder)
    # Names of parameters instead of uids, as every estimator has its own.
    sizes = lambda e: {p.name: v for p, v in e.extractParamMap().items()} | {"growth": getattr(e, "growth", None)}
    assert sorted(map(str, map(sizes, asked))) == sorted(map(str, map(sizes, ml.model_set().values())))
    assert folds == [5]


def test_least_squares_folds_equal_refitting(workspace):
    """Every fold from one pass equals a model refitted on the other folds' rows."""
    columns = ["neighbourhood_median_price", "minimum_nights", "availability_365"]
    got = ml.cross_validate_least_squares(workspace.train, columns).collect()

    def refit(train, estimator):
        from pyspark.ml.feature import VectorAssembler

        pre = VectorAssembler(inputCols=columns, outputCol="features")
        return ml.PipelineModel([pre, estimator.fit(pre.transform(train))])

    want = ml.cross_validate(workspace.train, ml.linear_model(), fit_fn=refit).collect()
    assert [(r["fold"], r["rmse"]) for r in got] == sorted((r["fold"], r["rmse"]) for r in want)


def test_least_squares_odd_rows(spark):
    rows = [(i, float(i % 7) + 1e9, 5.0, None if i % 10 == 0 else 3.0 * (i % 7) + 1) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x double, same double, price double")
    # Large means, a constant column and missing labels: the line is still found exactly.
    assert {r["rmse"] for r in ml.cross_validate_least_squares(df, ["x", "same"]).collect()} == {0.0}
    assert {r["rmse"] for r in ml.cross_validate_least_squares(df.limit(0), ["x"]).collect()} == {None}


def test_forest_statistics_fit_small_executors(spark):
    """Tasks of an executor with four cores together hold at most half a gigabyte of split statistics."""
    assert 4 * ml.forest_model().getMaxMemoryInMB() <= 512


def test_models_and_folds_are_fitted_at_the_same_time(workspace, monkeypatch):
    """Each fit waits until all have begun, which fits one after another never do."""
    from threading import Barrier

    fit, all_begun = ml.fit, Barrier(2, timeout=60)

    def waiting(*args, **kw):
        all_begun.wait()
        return fit(*args, **kw)

    monkeypatch.setattr(ml, "fit", waiting)
    rows = workspace.train
    assert list(ml.fit_all(rows, {"A": ml.linear_model(), "B": ml.linear_model()})) == ["A", "B"]
    assert ml.cross_validate(rows, ml.linear_model(), 2, fit_fn=waiting).count() == 2
