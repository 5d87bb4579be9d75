"""Scoring requests: check, derive the model's features, predict, clamp.

The same functions serve tables and streams; none keeps state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayscope.functions.numeric import half_up
from stayscope.functions.text import strip, title_case
from stayscope.operators.features import (
    availability_share,
    long_term_flag,
    reviewed_flag,
    superhost_flag,
)
from stayscope.operators.lookup import attach
from stayscope.operators.ml import load_model, model_facts
from stayscope.schema import (
    BOROUGH_MEDIANS,
    BOROUGHS,
    CATEGORICAL_FEATURES,
    CURRENCY,
    DEFAULT_DAYS_SINCE_REVIEW,
    DEFAULT_MEDIAN_PRICE,
    MODEL_MAE,
    MODEL_VERSION,
    NEIGHBOURHOOD_LENGTH,
    NEIGHBOURHOOD_MEDIANS,
    NUMERIC_FEATURES,
    PRICE_CEILING,
    PRICE_FLOOR,
    REQUEST_BOUNDS,
    ROOM_TYPES,
)
from stayscope.sources.literal import literal_table


def with_violations(
    requests: DataFrame, boroughs: list[str] = BOROUGHS, room_types: list[str] = ROOM_TYPES
) -> DataFrame:
    """Adds the names of the fields that break a rule, in field order.

    Checks see the text as sent: a padded or lower-case borough fails.
    """

    def broken(field: str, ok: Column) -> Column:
        return F.when(~F.coalesce(ok, F.lit(False)), F.lit(field))

    length = F.length("neighbourhood")
    rules = [
        broken("neighbourhood_group", F.col("neighbourhood_group").isin(boroughs)),
        broken("neighbourhood", length.between(*NEIGHBOURHOOD_LENGTH)),
        broken("room_type", F.col("room_type").isin(room_types)),
    ] + [
        broken(field, F.col(field).between(lo, hi)) for field, (lo, hi) in REQUEST_BOUNDS.items()
    ]
    return requests.withColumn("violations", F.array_compact(F.array(*rules)))


def validate_requests(
    requests: DataFrame, boroughs: list[str] = BOROUGHS, room_types: list[str] = ROOM_TYPES
) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected). Valid rows get their area names stripped and title-cased after
    the checks; rejected rows keep what was sent and their violations."""
    checked = with_violations(requests, boroughs, room_types)
    fine = F.size("violations") == 0
    valid = checked.where(fine).drop("violations")
    areas = ("neighbourhood_group", "neighbourhood")
    return (
        valid.withColumns({c: title_case(strip(F.col(c))) for c in areas}),
        checked.where(~fine),
    )


def published_medians(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The fixed median prices, as lookup tables like ``area_medians`` gives."""
    areas = [(k, v, 1) for k, v in NEIGHBOURHOOD_MEDIANS.items()]
    boroughs = [(k, v, 1) for k, v in BOROUGH_MEDIANS.items()]
    return (
        literal_table(spark, areas, "neighbourhood string, neighbourhood_median_price double, n long"),
        literal_table(
            spark,
            boroughs,
            "neighbourhood_group string, neighbourhood_group_median_price double, n long",
        ),
    )


def scoring_features(
    requests: DataFrame,
    medians: tuple[DataFrame, DataFrame],
    days_since_review: float = DEFAULT_DAYS_SINCE_REVIEW,
    default_price: float = DEFAULT_MEDIAN_PRICE,
) -> DataFrame:
    """The model's 16 features from request fields and the saved median tables.

    A neighbourhood without a median takes its borough's, an unknown borough the default.
    """
    by_area, by_borough = medians
    fallback = F.coalesce("neighbourhood_group_median_price", F.lit(default_price))
    found = attach(requests, by_area, ["neighbourhood"], weight="n", staged=True)
    found = attach(found, by_borough, ["neighbourhood_group"], weight="n", staged=True)
    derived = found.withColumns(
        {
            "neighbourhood_median_price": F.coalesce("neighbourhood_median_price", fallback),
            "neighbourhood_group_median_price": fallback,
            "is_reviewed": reviewed_flag(),
            "host_is_superhost_proxy": superhost_flag(),
            "availability_ratio": availability_share(),
            "is_long_term": long_term_flag(),
            "days_since_last_review": F.lit(float(days_since_review)),
        }
    )
    wanted = CATEGORICAL_FEATURES + NUMERIC_FEATURES
    others = [c for c in requests.columns if c not in wanted]
    return derived.select(*others, *wanted)


def clamp(c: Column, low: float = PRICE_FLOOR, high: float = PRICE_CEILING) -> Column:
    return F.greatest(F.lit(low), F.least(c, F.lit(high)))


def price_response(
    predicted: DataFrame, prediction: str = "prediction", mae: float = MODEL_MAE,
    version: str = MODEL_VERSION,
) -> DataFrame:
    """Clamped price, its range, and an echo of the request."""
    price = half_up(clamp(F.col(prediction)), 2)
    keep = [c for c in predicted.columns if c == "request_id"]
    return predicted.withColumn("predicted_price", price).select(
        *keep,
        "predicted_price",
        half_up(clamp(F.col("predicted_price") - mae), 2).alias("price_range_low"),
        half_up(clamp(F.col("predicted_price") + mae), 2).alias("price_range_high"),
        F.lit(CURRENCY).alias("currency"),
        F.lit(version).alias("model_version"),
        F.struct(
            F.col("neighbourhood_group").alias("borough"),
            "neighbourhood",
            "room_type",
            F.col("minimum_nights").alias("min_nights"),
        ).alias("input_summary"),
    )


def score(
    requests: DataFrame,
    medians: tuple[DataFrame, DataFrame],
    predict: Callable[[DataFrame], DataFrame],
    mae: float = MODEL_MAE,
    version: str = MODEL_VERSION,
    **feature_options,
) -> DataFrame:
    """Responses for valid requests. ``predict`` adds a ``prediction`` column, for example
    ``load_model(path).transform``."""
    features = scoring_features(requests, medians, **feature_options)
    return price_response(predict(features), mae=mae, version=version)


def score_saved(requests: DataFrame, medians: tuple[DataFrame, DataFrame], path: str) -> DataFrame:
    """Responses of a saved model: version, price range and mean days since a review are its own."""
    facts = model_facts(requests.sparkSession, path)
    return score(
        requests, medians, load_model(path).transform, facts["mae"], facts["version"], days_since_review=facts["mean_days_since_review"]
    )
