"""Raw table -> cleaned table -> featured table, each written before the next step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from stayscope.operators.clean import clean
from stayscope.operators.features import area_medians, engineer_features
from stayscope.operators.profile import feature_summary, validate_cleaned
from stayscope.schema import REFERENCE_DATE
from stayscope.sources.readers import UNREAD, load_featured, load_listings, unread_counts
from stayscope.sources.staging import stage
from stayscope.sources.writers import save_table, verify_load, write_jdbc


@dataclass
class EtlResult:
    cleaned: DataFrame
    featured: DataFrame
    medians: tuple[DataFrame, DataFrame]
    validation: DataFrame
    summary: DataFrame
    verification: DataFrame
    unread: DataFrame | None = None


def run_etl(
    spark: SparkSession,
    raw_path: str,
    out: str,
    raw_format: str = "csv",
    out_format: str = "parquet",
    reference_date: str = REFERENCE_DATE,
    partition_by: tuple[str, ...] = (),
    jdbc_url: str | None = None,
    jdbc_options: dict | None = None,
) -> EtlResult:
    """Run all steps into ``out``; with ``jdbc_url`` both tables are also loaded there.

    ``partition_by`` lays the featured table out by columns of few values, such as the
    borough, so that filters on them skip whole folders. ``unread`` of the result counts the cells of a raw CSV
    file that could not be read.
    """
    raw = load_listings(spark, raw_path, raw_format)
    unread = unread_counts(raw) if UNREAD in raw.columns else None
    cleaned_path, featured_path = f"{out}/cleaned_listings", f"{out}/featured_listings"
    save_table(clean(raw.drop(UNREAD)), cleaned_path)
    cleaned = load_listings(spark, cleaned_path, "parquet")
    medians = tuple(stage(m, "medians") for m in area_medians(cleaned))
    wanted = engineer_features(cleaned, reference_date, medians=medians)
    save_table(wanted, featured_path, out_format, partition_by=partition_by)
    featured = load_featured(spark, featured_path, out_format).select(*wanted.columns)
    if jdbc_url:
        for df, name in ((cleaned, "cleaned_listings"), (featured, "featured_listings")):
            write_jdbc(df, jdbc_url, name, **(jdbc_options or {}))
    return EtlResult(
        cleaned,
        featured,
        medians,
        validate_cleaned(cleaned),
        feature_summary(featured),
        verify_load(spark, featured_path, cleaned, out_format),
        unread,
    )
