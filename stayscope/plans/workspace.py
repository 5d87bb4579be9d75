"""Tables that many queries start from, written once per session and data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayscope.operators import ml
from stayscope.operators.clean import clean
from stayscope.operators.features import area_medians, engineer_features
from stayscope.operators.ml import PipelineModel, model_set, train_test_split
from stayscope.sources.order_listings import FIXTURE_REFERENCE_DATE, listings_from_orders
from stayscope.sources.readers import select_ml_columns
from stayscope.sources.staging import stage

_OPEN: dict[tuple[str, str], "Workspace"] = {}


class Workspace:
    """raw -> cleaned -> featured -> train/test of one folder, each built on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._tables: dict[str, DataFrame] = {}
        self._models: dict[str, PipelineModel] = {}
        self._trained: dict | None = None

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> "Workspace":
        key = (spark.sparkContext.applicationId, folder)
        if key not in _OPEN:
            _OPEN[key] = cls(spark, folder)
        return _OPEN[key]

    @classmethod
    def use(cls, workspace: "Workspace") -> None:
        """Make later ``open`` calls return this one."""
        _OPEN[(workspace.spark.sparkContext.applicationId, workspace.folder)] = workspace

    def _once(self, name: str, build) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = stage(build(), name)
        return self._tables[name]

    @property
    def raw(self) -> DataFrame:
        return self._once("raw", lambda: listings_from_orders(self.spark, self.folder))

    @property
    def cleaned(self) -> DataFrame:
        return self._once("cleaned", lambda: clean(self.raw))

    @property
    def medians(self) -> tuple[DataFrame, DataFrame]:
        names = "area-medians", "borough-medians"
        if names[1] not in self._tables:
            for name, table in zip(names, area_medians(self.cleaned)):
                self._once(name, lambda: table)
        return tuple(self._tables[name] for name in names)

    @property
    def featured(self) -> DataFrame:
        return self._once(
            "featured",
            lambda: engineer_features(self.cleaned, FIXTURE_REFERENCE_DATE, medians=self.medians),
        )

    @property
    def ml_rows(self) -> DataFrame:
        return select_ml_columns(self.featured, keep=("id",))

    @property
    def train(self) -> DataFrame:
        return self._once("train", lambda: train_test_split(self.ml_rows)[0])

    @property
    def test(self) -> DataFrame:
        return self._once("test", lambda: train_test_split(self.ml_rows)[1])

    def models(self, names: list[str]) -> dict[str, PipelineModel]:
        """Models of ``model_set`` in full size, each fitted once on the train part, missing ones at the same time."""
        missing = {name: e for name, e in model_set().items() if name in names and name not in self._models}
        if missing:
            self._models |= ml.fit_all(self.train, missing)
        return {name: self._models[name] for name in names}

    def model(self, name: str) -> PipelineModel:
        return self.models([name])[name]

    @property
    def trained(self) -> dict:
        """Comparison of the four models, and the winner's folds, importances and saved form."""
        if self._trained is None:
            self._trained = ml.train_all(self.ml_rows, fitted=self.models(list(model_set())))
        return self._trained

    @property
    def requests(self) -> DataFrame:
        """Every raw listing as a scoring request. One in thirteen keeps a padded borough, so
        it is rejected; missing review paces are left missing and are rejected as well."""
        borough = F.col("neighbourhood_group")
        return self.raw.select(
            F.col("id").alias("request_id"),
            F.when(borough.startswith(" "), borough).otherwise(F.initcap(borough)).alias(
                "neighbourhood_group"
            ),
            "neighbourhood",
            "room_type",
            "minimum_nights",
            "number_of_reviews",
            "reviews_per_month",
            "calculated_host_listings_count",
            "availability_365",
            F.length(F.coalesce("name", F.lit(""))).alias("name_length"),
        )
