"""Registry: query name -> function of (spark, data folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayscope.functions.numeric import half_up
from stayscope.operators import clean as cl
from stayscope.operators import dashboard as db
from stayscope.operators import boosting as bo, eda, features as ft, market as mk, ml, profile as pf, score as sc
from stayscope.plans.workspace import Workspace
from stayscope.sources import readers, writers
from stayscope.sources.order_listings import FIXTURE_REFERENCE_DATE
from stayscope.sources.staging import new_path
from stayscope.sources.literal import literal_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters of the derived listings.
BOROUGH_NAMES = ["Africa", "America", "Asia", "Europe", "Middle East"]
FILTERS = {"boroughs": ["Asia", "Europe", "America"], "room_types": ["Entire home/apt", "Private room"]}
AREA_A, AREA_B = "Nation_17'S D5", "Nation_12'S D14"


def query(name: str):
    def add(fn: Callable[[Workspace], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Workspace.open(spark, folder))
        return fn

    return add


def _register(table: str, functions: dict[str, Callable[[DataFrame], DataFrame]]) -> None:
    for name, fn in functions.items():
        QUERIES[name] = lambda spark, folder, fn=fn: fn(
            getattr(Workspace.open(spark, folder), table)
        )


# ---- Sources and sinks ----


@query("load_listings")
def _(w: Workspace) -> DataFrame:
    """A file with whole, fractional and unreadable prices."""
    price = F.col("price").cast("string")
    odd = w.raw.withColumn(
        "price",
        F.when(F.col("id") % 10 == 0, (F.col("price") + 0.25).cast("string"))
        .when(F.col("id") % 10 == 1, F.concat(F.lit("$"), price))
        .otherwise(price),
    )
    path = writers.save_table(odd, new_path(w.spark, "raw-csv"), "csv")
    return readers.load_listings(w.spark, path).withColumn("n_unread", F.size("_unread")).drop("_unread")


@query("load_featured")
def _(w: Workspace) -> DataFrame:
    path = writers.save_table(w.featured, new_path(w.spark, "featured-csv"), "csv")
    return readers.load_featured(w.spark, path, "csv")


@query("load_cached")
def _(w: Workspace) -> DataFrame:
    path = writers.save_table(w.featured, new_path(w.spark, "featured"))
    return readers.load_cached(w.spark, path)


_register("featured", {"select_ml_columns": readers.select_ml_columns})


@query("save_table")
def _(w: Workspace) -> DataFrame:
    path = writers.save_table(
        w.featured, new_path(w.spark, "by-borough"), partition_by=("neighbourhood_group",)
    )
    return readers.load_featured(w.spark, path).select(*w.featured.columns)


@query("write_modes")
def _(w: Workspace) -> DataFrame:
    """The write modes, on a file sink: replace, then append, keeps two copies; fail adds none."""
    path = new_path(w.spark, "modes")
    areas = w.medians[0]
    writers.save_table(areas, path)
    writers.save_table(areas, path, if_exists="replace")
    writers.save_table(areas, path, if_exists="append")
    try:
        writers.save_table(areas, path, if_exists="fail")
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
    return w.spark.read.parquet(path)


@query("verify_load")
def _(w: Workspace) -> DataFrame:
    path = writers.save_table(w.cleaned, new_path(w.spark, "cleaned"))
    return writers.verify_load(w.spark, path, w.cleaned)


@query("save_model")
def _(w: Workspace) -> DataFrame:
    """Metrics written beside a saved model, as read back from its folder."""
    saved = w.spark.read.json(f"{_saved_linear(w)}/metadata")
    return saved.select("model", "rmse", "mae", "r2")


@query("load_model")
def _(w: Workspace) -> DataFrame:
    """A one-feature linear model saved, loaded and applied to the test rows."""
    loaded = ml.load_model(_saved_linear(w))
    return loaded.transform(w.test).select(
        "id", "price", half_up(F.col("prediction"), 3).alias("prediction")
    )


@query("model_metadata")
def _(w: Workspace) -> DataFrame:
    return ml.model_metadata(w.spark, _saved_linear(w))


def _fit_on_area_median(train: DataFrame, estimator) -> ml.PipelineModel:
    return ml.fit(train, estimator, ml.fit_preprocessor(train, [], ["neighbourhood_median_price"]))


def _saved_linear(w: Workspace) -> str:
    fitted = _fit_on_area_median(w.train, ml.linear_model())
    metrics = ml.evaluate(fitted.transform(w.test)).withColumn("model", F.lit("LinearRegression"))
    return ml.save_model(fitted, metrics, new_path(w.spark, "model"))


# ---- Profiling ----

_register(
    "raw",
    {
        "schema_report": pf.schema_report,
        "profile_shape": pf.shape,
        "profile_missing": pf.missing,
        "profile_numeric": lambda df: pf.numeric_summary(df).withColumns(
            {c: half_up(F.col(c), 4) for c in ("mean", "std")}
        ),
        "profile_categorical": pf.categorical_summary,
        "profile_price": pf.price_profile,
        "profile_all": lambda df: pf.as_long(pf.profile_all(df)),
    },
)


@query("profile_duplicates")
def _(w: Workspace) -> DataFrame:
    """Listings of which every seventh id is there twice."""
    return pf.duplicates(w.raw.union(w.raw.where(F.col("id") % 7 == 0)))


_register("cleaned", {"validate_cleaned": pf.validate_cleaned})
_register("featured", {"feature_summary": pf.feature_summary})

# ---- Cleaning ----

_register(
    "raw",
    {
        "drop_zero_prices": cl.drop_zero_prices,
        "cap_price": lambda df: cl.cap_price(cl.drop_zero_prices(df)).select("id", "price"),
        "cap_minimum_nights": lambda df: cl.cap_minimum_nights(cl.drop_zero_prices(df)).select(
            "id", "minimum_nights"
        ),
        "fill_missing_text": lambda df: cl.fill_missing_text(df).select("id", "name", "host_name"),
        "fix_reviews": lambda df: cl.fix_reviews(df).select("id", "last_review", "reviews_per_month"),
        "parse_last_review": lambda df: cl.parse_last_review(df).select("id", "last_review"),
        "strip_whitespace": lambda df: cl.strip_whitespace(df).select(
            "id", "name", "host_name", "neighbourhood_group", "neighbourhood", "room_type"
        ),
        "title_case": lambda df: cl.title_case_areas(df).select(
            "id", "neighbourhood_group", "neighbourhood"
        ),
        "reset_index": lambda df: cl.with_row_index(cl.drop_zero_prices(df)).select("id", "row_index"),
        "clean": cl.clean,
    },
)

# ---- Features ----


def _feature(fn, *columns: str):
    return lambda df: fn(df).select("id", *columns)


_register(
    "cleaned",
    {
        "price_per_review": _feature(ft.add_price_per_review, "price_per_review"),
        "is_reviewed": _feature(ft.add_is_reviewed, "is_reviewed"),
        "superhost_proxy": _feature(ft.add_superhost_proxy, "host_is_superhost_proxy"),
        "availability_ratio": _feature(ft.add_availability_ratio, "availability_ratio"),
        "availability_category": _feature(ft.add_availability_category, "availability_category"),
        "review_score_category": _feature(ft.add_review_score_category, "review_score_category"),
        "price_category": _feature(ft.add_price_category, "price_category"),
        "is_long_term": _feature(ft.add_is_long_term, "is_long_term"),
        "name_length": _feature(ft.add_name_length, "name_length"),
        "date_features": _feature(
            lambda df: ft.add_date_features(df, FIXTURE_REFERENCE_DATE),
            "last_review_year",
            "last_review_month",
            "days_since_last_review",
        ),
        "area_price_encoding": _feature(
            ft.add_area_price_encoding,
            "neighbourhood_median_price",
            "neighbourhood_group_median_price",
        ),
        "engineer_features": lambda df: ft.engineer_features(df, FIXTURE_REFERENCE_DATE),
    },
)

# ---- Market reports, exploratory and dashboard datasets ----

_register(
    "featured",
    {
        "market_summary": mk.market_summary,
        "borough_summary": mk.borough_summary,
        "room_type_breakdown": mk.room_type_breakdown,
        "top_neighbourhoods": mk.top_neighbourhoods,
        "price_category_mix": mk.price_category_mix,
        "room_type_crosstab": mk.room_type_crosstab,
        "top_hosts": mk.top_hosts,
        "superhost_compare": mk.superhost_compare,
        "most_reviewed_hosts": mk.most_reviewed_hosts,
        "availability_mix": mk.availability_mix,
        "availability_by_area_type": mk.availability_by_area_type,
        "review_activity": mk.review_activity,
        "review_category_mix": mk.review_category_mix,
        "rank_in_borough": mk.rank_in_borough,
        "running_totals": mk.running_totals,
        "price_percentile": mk.price_percentile,
        "price_percentile_all": lambda df: mk.price_percentile(df, top=None),
        "hist_price": eda.hist_price,
        "box_price_room_type": eda.box_price_room_type,
        "avg_price_borough": eda.avg_price_borough,
        "top15_neighbourhoods": eda.top15_neighbourhoods,
        "room_type_counts": eda.room_type_counts,
        "hist_availability": eda.hist_availability,
        "hist_reviews_per_month": eda.hist_reviews_per_month,
        "correlation_matrix": eda.correlation_matrix,
        "category_by_borough": eda.category_by_borough,
        "top_hosts_by_name": eda.top_hosts_by_name,
        "hist_minimum_nights": eda.hist_minimum_nights,
        "sample_price_reviews": eda.sample_price_reviews,
        "eda_all": lambda df: pf.as_long(eda.eda_all(df)),
        "kpis": db.kpis,
        "market_by_borough": db.market_by_borough,
        "filter_listings": lambda df: db.filter_listings(df, **FILTERS),
        "filter_options": db.filter_options,
        "filtered_histogram": lambda df: db.filtered_histogram(df, **FILTERS),
        "filtered_room_mix": lambda df: db.filtered_room_mix(df, **FILTERS),
        "filtered_borough_avg": lambda df: db.filtered_borough_avg(df, **FILTERS),
        "filtered_top15": lambda df: db.filtered_top15(df, **FILTERS),
        "filtered_borough_room": lambda df: db.filtered_borough_room(df, **FILTERS),
        "areas_of_borough": lambda df: db.areas_of_borough(df, "Asia"),
        "compare_areas": lambda df: db.compare_areas(df, AREA_A, AREA_B),
        "compare_area_hist": lambda df: db.compare_area_hist(df, AREA_A, AREA_B),
        "compare_room_mix": lambda df: db.compare_room_mix(df, AREA_A, AREA_B),
    },
)


@query("benchmark_price")
def _(w: Workspace) -> DataFrame:
    """Every listing's area median as its prediction, against all listings."""
    scored = w.featured.select(
        "id",
        "neighbourhood",
        "room_type",
        half_up(sc.clamp(F.col("neighbourhood_median_price")), 2).alias("predicted_price"),
    )
    return db.benchmark_price(scored, w.featured)


# ---- Models ----


def _median_prediction(df: DataFrame) -> DataFrame:
    return df.withColumn("prediction", F.col("neighbourhood_median_price"))


@query("train_test_split")
def _(w: Workspace) -> DataFrame:
    return ml.with_test_flag(w.ml_rows).select("id", "is_test")


@query("ordinal_encode")
def _(w: Workspace) -> DataFrame:
    codes = [f"{c}_code" for c in ml.CATEGORICAL_FEATURES]
    return ml.ordinal_encode(w.test, w.train).select("id", *codes)


@query("standard_scale")
def _(w: Workspace) -> DataFrame:
    scaled = ml.standard_scale(w.test, w.train)
    return scaled.select(
        "id", *[half_up(F.col(f"{c}_scaled"), 5).alias(f"{c}_scaled") for c in ml.NUMERIC_FEATURES]
    )


@query("preprocess")
def _(w: Workspace) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    ready = ml.fit_preprocessor(w.train).transform(w.test)
    parts = ready.select("id", vector_to_array("features").alias("v"))
    return parts.select(
        "id", *[half_up(F.col("v")[i], 5).alias(f"{c}_x") for i, c in enumerate(ml.FEATURES)]
    )


def _predictions(w: Workspace, name: str) -> DataFrame:
    return w.model(name).transform(w.test).select("id", "price", "prediction")


@query("fit_linear")
def _(w: Workspace) -> DataFrame:
    return _predictions(w, "LinearRegression")


@query("fit_linear_one_feature")
def _(w: Workspace) -> DataFrame:
    """Slope and intercept of price on the area median, from the same estimator."""
    pre = ml.VectorAssembler(inputCols=["neighbourhood_median_price"], outputCol="features")
    model = ml.linear_model().fit(pre.transform(w.train))
    row = (float(model.coefficients[0]), float(model.intercept))
    fitted = literal_table(w.spark, [row], "slope double, intercept double")
    return fitted.select(*[half_up(F.col(c), 4).alias(c) for c in fitted.columns])


@query("fit_forest")
def _(w: Workspace) -> DataFrame:
    return _predictions(w, "RandomForest")


@query("fit_gbt")
def _(w: Workspace) -> DataFrame:
    return _predictions(w, "Boosting")


@query("fit_gbt_tuned")
def _(w: Workspace) -> DataFrame:
    return _predictions(w, "Boosting_Tuned")


#: Features of the checked splits; bins hold all their values.
SPLIT_FEATURES = [
    "neighbourhood_group_median_price", "minimum_nights", "calculated_host_listings_count", "name_length", "number_of_reviews",
]
SPLIT_PENALTIES = {"none": bo.Penalties(l2=0.0), "all": bo.Penalties(l1=500.0, l2=250.0, leaf=100.0, min_rows=50)}


@query("boost_splits")
def _(w: Workspace) -> DataFrame:
    """The first split of one boosting round of depth 1, without and with penalties."""
    rows = w.train.select("price", F.array(*[F.col(c).cast("double") for c in SPLIT_FEATURES]).alias("features"))
    found = []
    for name, penalties in SPLIT_PENALTIES.items():
        tree = bo.PenalisedBoosting(rounds=1, step=1.0, depth=1, penalties=penalties).fit(rows).trees[0]
        if tree.feature[0] >= 0:
            found.append((name, SPLIT_FEATURES[tree.feature[0]], tree.threshold[0], tree.gain[0], *tree.value[1:]))
    schema = "penalties string, feature string, threshold double, gain double, left_value double, right_value double"
    splits = literal_table(w.spark, found, schema)
    return splits.withColumns({c: half_up(F.col(c), 3) for c in ("gain", "left_value", "right_value")})


@query("evaluate")
def _(w: Workspace) -> DataFrame:
    return ml.evaluate(_median_prediction(w.test))


@query("compare_models")
def _(w: Workspace) -> DataFrame:
    """Three median predictors: neighbourhood, borough, and a tie of the first."""
    area = ml.evaluate(w.test, prediction="neighbourhood_median_price")
    borough = ml.evaluate(w.test, prediction="neighbourhood_group_median_price")
    return ml.compare_models([("Borough", borough), ("Area", area), ("AreaAgain", area)])


@query("cross_validate")
def _(w: Workspace) -> DataFrame:
    return ml.cross_validate_median(w.train, "neighbourhood_group")


@query("cross_validate_linear")
def _(w: Workspace) -> DataFrame:
    """One-feature linear model, all folds from one pass."""
    return ml.cross_validate_least_squares(w.train, ["neighbourhood_median_price"])


@query("cross_validate_least_squares")
def _(w: Workspace) -> DataFrame:
    """Two features, all folds from one pass."""
    return ml.cross_validate_least_squares(w.train, ["neighbourhood_median_price", "minimum_nights"])


@query("cv_summary")
def _(w: Workspace) -> DataFrame:
    return ml.cv_summary(ml.cross_validate_median(w.train, "neighbourhood_group"))


@query("feature_importance")
def _(w: Workspace) -> DataFrame:
    return ml.feature_importance(w.spark, w.model("RandomForest"))


@query("actual_vs_predicted")
def _(w: Workspace) -> DataFrame:
    return ml.actual_vs_predicted(_median_prediction(w.test))


@query("residuals")
def _(w: Workspace) -> DataFrame:
    return ml.residual_histogram(_median_prediction(w.test))


@query("train_all")
def _(w: Workspace) -> DataFrame:
    return w.trained["comparison"]


@query("model_report")
def _(w: Workspace) -> DataFrame:
    """All four models, and the winner's folds and importances."""
    return ml.model_report(*[w.trained[part] for part in ("comparison", "cv", "importance")])


# ---- Scoring ----


def _median_predictor(df: DataFrame) -> DataFrame:
    return df.withColumn("prediction", F.col("neighbourhood_median_price") - 100)


def _flat(responses: DataFrame) -> DataFrame:
    return responses.select("*", "input_summary.*").drop("input_summary")


@query("scoring_features")
def _(w: Workspace) -> DataFrame:
    valid, _ = sc.validate_requests(w.requests, BOROUGH_NAMES)
    return sc.scoring_features(valid, w.medians)


@query("validate_requests")
def _(w: Workspace) -> DataFrame:
    checked = sc.with_violations(w.requests, BOROUGH_NAMES)
    return checked.select("request_id", F.concat_ws("|", "violations").alias("violations"))


@query("score")
def _(w: Workspace) -> DataFrame:
    valid, _ = sc.validate_requests(w.requests, BOROUGH_NAMES)
    return _flat(sc.score(valid, w.medians, _median_predictor))


def _streamed(w: Workspace) -> tuple[str, str]:
    """The same requests as files of a stream, scored until none is left: both outputs."""
    from stayscope.streaming.scoring import read_requests, start_scoring

    source = writers.save_table(w.requests, new_path(w.spark, "request-files"))
    out, rejected, state = (new_path(w.spark, n) for n in ("responses", "rejected", "stream-state"))
    stream = read_requests(w.spark, source)
    start_scoring(stream, w.medians, _median_predictor, out, rejected, state, BOROUGH_NAMES).awaitTermination()
    return out, rejected


@query("score_stream")
def _(w: Workspace) -> DataFrame:
    from stayscope.streaming.scoring import read_written

    return _flat(read_written(w.spark, _streamed(w)[0]))


@query("score_stream_rejected")
def _(w: Workspace) -> DataFrame:
    from stayscope.streaming.scoring import read_written

    rejected = read_written(w.spark, _streamed(w)[1])
    return rejected.select("request_id", F.concat_ws("|", "violations").alias("violations"))


@query("score_model")
def _(w: Workspace) -> DataFrame:
    """Valid requests through a fitted linear pipeline."""
    valid, _ = sc.validate_requests(w.requests, BOROUGH_NAMES)
    model = ml.fit(w.train, ml.linear_model())
    return _flat(sc.score(valid, w.medians, model.transform))


@query("score_saved")
def _(w: Workspace) -> DataFrame:
    """A line on the area median, saved with its facts; the answers come from what was loaded."""
    valid, _ = sc.validate_requests(w.requests, BOROUGH_NAMES)
    line = _fit_on_area_median(w.train, ml.linear_model())
    facts = ml.evaluate(line.transform(w.test)).withColumn("model", F.lit("Line"))
    path = ml.save_model(line, facts, new_path(w.spark, "scored-model"), w.train)
    return _flat(sc.score_saved(valid, w.medians, path))
