"""Fixed schemas and the constants the operators share."""

from __future__ import annotations

from pyspark.sql import types as T

LISTING_FIELDS = [
    ("id", T.LongType()),
    ("name", T.StringType()),
    ("host_id", T.LongType()),
    ("host_name", T.StringType()),
    ("neighbourhood_group", T.StringType()),
    ("neighbourhood", T.StringType()),
    ("room_type", T.StringType()),
    ("price", T.IntegerType()),
    ("minimum_nights", T.IntegerType()),
    ("number_of_reviews", T.IntegerType()),
    ("last_review", T.StringType()),
    ("reviews_per_month", T.DoubleType()),
    ("calculated_host_listings_count", T.IntegerType()),
    ("availability_365", T.IntegerType()),
]
RAW_SCHEMA = T.StructType([T.StructField(n, t) for n, t in LISTING_FIELDS])

CLEAN_SCHEMA = T.StructType(
    [
        T.StructField(
            n,
            T.DoubleType()
            if n in ("price", "minimum_nights")
            else T.DateType()
            if n == "last_review"
            else t,
        )
        for n, t in LISTING_FIELDS
    ]
)

ENGINEERED_FIELDS = [
    ("price_per_review", T.DoubleType()),
    ("is_reviewed", T.IntegerType()),
    ("host_is_superhost_proxy", T.IntegerType()),
    ("availability_ratio", T.DoubleType()),
    ("availability_category", T.StringType()),
    ("review_score_category", T.StringType()),
    ("price_category", T.StringType()),
    ("is_long_term", T.IntegerType()),
    ("name_length", T.IntegerType()),
    ("last_review_year", T.IntegerType()),
    ("last_review_month", T.IntegerType()),
    ("days_since_last_review", T.IntegerType()),
    ("neighbourhood_median_price", T.DoubleType()),
    ("neighbourhood_group_median_price", T.DoubleType()),
]
FEATURED_SCHEMA = T.StructType(
    CLEAN_SCHEMA.fields + [T.StructField(n, t) for n, t in ENGINEERED_FIELDS]
)

REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("neighbourhood_group", T.StringType()),
        T.StructField("neighbourhood", T.StringType()),
        T.StructField("room_type", T.StringType()),
        T.StructField("minimum_nights", T.IntegerType()),
        T.StructField("number_of_reviews", T.IntegerType()),
        T.StructField("reviews_per_month", T.DoubleType()),
        T.StructField("calculated_host_listings_count", T.IntegerType()),
        T.StructField("availability_365", T.IntegerType()),
        T.StructField("name_length", T.IntegerType()),
    ]
)

# ---- Fixed values: they must equal the published ones for results to agree ----

REFERENCE_DATE = "2019-07-09"
CAP_QUANTILE = 0.99
UNKNOWN_TEXT = "Unknown"
SUPERHOST_MIN_LISTINGS = 5
LONG_TERM_MIN_NIGHTS = 30

AVAILABILITY_EDGES = [0, 30, 90, 180, 365]
AVAILABILITY_LABELS = ["Rarely Available", "Occasionally", "Moderately", "Highly Available"]
PRICE_EDGES = [0, 75, 150, 300, None]
PRICE_LABELS = ["Budget", "Mid", "Premium", "Luxury"]
ROOM_TYPES = ["Entire home/apt", "Private room", "Shared room"]
BOROUGHS = ["Manhattan", "Brooklyn", "Queens", "Bronx", "Staten Island"]

CATEGORICAL_FEATURES = ["neighbourhood_group", "neighbourhood", "room_type"]
NUMERIC_FEATURES = [
    "neighbourhood_median_price",
    "neighbourhood_group_median_price",
    "minimum_nights",
    "number_of_reviews",
    "reviews_per_month",
    "calculated_host_listings_count",
    "availability_365",
    "is_reviewed",
    "host_is_superhost_proxy",
    "availability_ratio",
    "is_long_term",
    "name_length",
    "days_since_last_review",
]
TARGET = "price"

CORRELATION_COLUMNS = [
    "price",
    "minimum_nights",
    "number_of_reviews",
    "reviews_per_month",
    "calculated_host_listings_count",
    "availability_365",
    "price_per_review",
    "is_reviewed",
    "host_is_superhost_proxy",
    "availability_ratio",
    "is_long_term",
    "name_length",
    "days_since_last_review",
]

PRICE_FLOOR = 10.0
PRICE_CEILING = 799.0
MODEL_MAE = 47.20
CURRENCY = "USD"
MODEL_VERSION = "xgboost_v1"
DEFAULT_MEDIAN_PRICE = 106.0
DEFAULT_DAYS_SINCE_REVIEW = 277.95

BOROUGH_MEDIANS = {
    "Manhattan": 150.0,
    "Brooklyn": 90.0,
    "Queens": 75.0,
    "Bronx": 65.0,
    "Staten Island": 75.0,
}
NEIGHBOURHOOD_MEDIANS = {
    "Tribeca": 295.0,
    "Flatiron District": 225.0,
    "Noho": 250.0,
    "Midtown": 210.0,
    "Soho": 199.0,
    "West Village": 200.0,
    "Theater District": 190.0,
    "Chelsea": 199.0,
    "Battery Park City": 195.0,
    "Greenwich Village": 197.5,
    "Financial District": 200.0,
    "Murray Hill": 190.0,
    "Gramercy": 165.0,
    "Nolita": 179.0,
    "Brooklyn Heights": 150.0,
    "Williamsburg": 150.0,
    "Bushwick": 80.0,
    "Bedford-Stuyvesant": 95.0,
    "Harlem": 90.0,
    "Upper West Side": 150.0,
    "Upper East Side": 150.0,
    "Hell'S Kitchen": 150.0,
    "East Village": 150.0,
    "Lower East Side": 130.0,
    "Crown Heights": 85.0,
    "Astoria": 80.0,
    "Long Island City": 100.0,
}

# Inclusive request bounds.
REQUEST_BOUNDS = {
    "minimum_nights": (1, 365),
    "number_of_reviews": (0, 629),
    "reviews_per_month": (0.0, 58.5),
    "calculated_host_listings_count": (1, 327),
    "availability_365": (0, 365),
    "name_length": (0, 200),
}
NEIGHBOURHOOD_LENGTH = (2, 100)

# Text the CSV reader treats as missing.
NULL_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# Characters Python's str.strip() removes.
PYTHON_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
