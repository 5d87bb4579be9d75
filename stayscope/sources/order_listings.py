"""Listings derived from a retail star schema: one listing per order.

Stands in for a listings file wherever only orders, customers and line items are at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayscope.operators.lookup import attach

FIXTURE_REFERENCE_DATE = "2001-11-05"


def listings_from_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The listing columns, built from ``folder``'s Parquet tables.

    Host facts (name, place, number of listings) form one row per customer and are attached
    to the orders by measured size, so a customer with a third of all orders stays spread. Customers
    that the orders name but the customer table lacks are kept among the hosts until then, unplaced: so the heaviest
    are known whoever they are, and the hosts need not be copied.
    """

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    orders, customer, lineitem = table("orders"), table("customer"), table("lineitem")
    nations = table("nation").join(
        table("region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    stays = lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("stays"),
        F.sum("l_quantity").alias("quantity"),
        F.max("l_shipdate").alias("last_shipped"),
    )
    listings_per_host = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("host_listings"))
    placed = customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    hosts = (
        listings_per_host.where(F.col("o_custkey").isNotNull())
        .join(placed, F.col("o_custkey") == F.col("c_custkey"), "left")
        .select(
            "o_custkey",
            "c_name",
            F.lower("n_name").alias("nation"),
            F.lower("r_name").alias("region"),
            "host_listings",
            F.col("host_listings").alias("weight"),
            F.col("c_custkey").isNotNull().alias("placed"),
        )
    )
    wanted = orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"
    )
    cores = spark.sparkContext.defaultParallelism
    if wanted.rdd.getNumPartitions() < cores:  # a small input in few files: use every core
        wanted = wanted.repartition(cores)
    listed = wanted.join(stays, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    joined = attach(listed, hosts, ["o_custkey"], weight="weight", how="inner", spread=1).where("placed")

    key, host = F.col("o_orderkey"), F.col("o_custkey")
    title = F.concat(
        F.lit("  "), "o_orderpriority", F.lit(" listing "), key.cast("string"), F.lit(" ")
    )
    padded = F.concat(F.lit(" "), "region", F.lit(" "))
    nights = F.when(key % 50 == 0, 30 + host % 300).otherwise(1 + host % 14)
    room = (
        F.when(F.col("o_orderstatus") == "F", "Entire home/apt")
        .when(F.col("o_orderstatus") == "O", "Private room")
        .otherwise("Shared room")
    )
    return joined.select(
        key.alias("id"),
        F.when(key % 997 != 0, title).alias("name"),
        host.alias("host_id"),
        F.when(host % 211 != 0, F.col("c_name")).alias("host_name"),
        F.when(key % 13 == 0, padded).otherwise(F.col("region")).alias("neighbourhood_group"),
        F.concat("nation", F.lit("'s d"), (host % 20).cast("string")).alias("neighbourhood"),
        room.alias("room_type"),
        F.floor((F.col("o_totalprice") - 1000) / 500).cast("int").alias("price"),
        nights.cast("int").alias("minimum_nights"),
        F.coalesce("stays", F.lit(0)).cast("int").alias("number_of_reviews"),
        F.col("last_shipped").cast("date").cast("string").alias("last_review"),
        (F.col("quantity") / 32).alias("reviews_per_month"),
        F.col("host_listings").cast("int").alias("calculated_host_listings_count"),
        (key % 366).cast("int").alias("availability_365"),
    )
