import datetime
import random

import pytest

from stayscope.operators import clean as cl
from stayscope.schema import PYTHON_WHITESPACE, RAW_SCHEMA


def raw_row(**kw):
    row = dict.fromkeys(RAW_SCHEMA.names)
    row.update(
        id=1,
        host_id=1,
        neighbourhood_group="a",
        neighbourhood="b",
        room_type="Private room",
        price=10,
        minimum_nights=1,
        number_of_reviews=0,
        calculated_host_listings_count=1,
        availability_365=10,
    )
    row.update(kw)
    return tuple(row[n] for n in RAW_SCHEMA.names)


def frame(spark, *rows):
    return spark.createDataFrame([raw_row(**r) for r in rows], RAW_SCHEMA)


def values(df, column):
    return [r[column] for r in df.select(column).collect()]


def test_drop_zero_prices(spark):
    df = frame(spark, *[{"price": p} for p in (0, -5, None, 1)])
    assert values(cl.drop_zero_prices(df), "price") == [1]


def test_cap_is_linear_p99(spark):
    df = spark.createDataFrame([(float(i * i),) for i in range(10)], "price double")
    assert max(values(cl.cap_price(df), "price")) == pytest.approx(79.47)


def test_caps_from_saved_thresholds_and_nulls(spark):
    df = spark.createDataFrame([(5.0, 3.0), (None, 9.0)], "price double, minimum_nights double")
    caps = spark.createDataFrame([("price", 2.0), ("minimum_nights", 4.0)], "column string, cap double")
    got = cl.cap_columns(df, ("price", "minimum_nights"), caps=caps).collect()
    assert sorted(map(tuple, got), key=repr) == [(2.0, 3.0), (None, 4.0)]


def test_fill_comes_before_strip(spark):
    df = frame(spark, {"id": 1, "name": None}, {"id": 2, "name": "   "}, {"id": 3, "name": "\t a \n"})
    got = {r["id"]: r["name"] for r in cl.clean(df).collect()}
    assert got == {1: "Unknown", 2: "", 3: "a"}


def test_strip_matches_python(spark):
    texts = [PYTHON_WHITESPACE + "x y" + PYTHON_WHITESPACE, "", " ", "a ", "​q"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert values(cl.strip_whitespace(df), "t") == [t.strip() for t in texts]


def test_title_matches_python(spark):
    texts = [
        "hell's kitchen", "bedford-stuyvesant", "DUMBO", "east 5th st", "o'neil", "", "a_b", "st. george",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert values(cl.title_case_areas(df, ("t",)), "t") == [t.title() for t in texts]
    pick = random.Random(5)
    letters = "abcXYZ  '-_.59/&\t\néÑß中ǆﬁİıΩςσª²’ა\u0301"
    mixed = ["".join(pick.choices(letters, k=pick.randint(0, 12))) for _ in range(2_000)]
    df = spark.createDataFrame([(t,) for t in mixed], "t string")
    assert values(cl.title_case_areas(df, ("t",)), "t") == [t.title() for t in mixed]
    assert "hell's kitchen".title() == "Hell'S Kitchen"


def test_dates(spark):
    df = frame(spark, *[{"last_review": t} for t in ("2019-06-23", "No Review", None)])
    assert values(cl.parse_last_review(df), "last_review") == [datetime.date(2019, 6, 23), None, None]


def test_missing_review_pace_is_zero(spark):
    assert values(cl.clean(frame(spark, {})), "reviews_per_month") == [0.0]


def test_duplicates_stay_unless_asked(spark):
    df = frame(spark, {}, {})
    assert cl.clean(df).count() == 2
    assert cl.clean(df, dedupe=True).count() == 1


def test_row_index_with_one_heavy_key(spark):
    df = spark.range(300).selectExpr("if(id < 100, id, 100) as id", "id as other")
    got = cl.with_row_index(df).orderBy("row_index").collect()
    assert [r["row_index"] for r in got] == list(range(300))
    assert [r["id"] for r in got] == sorted(r["id"] for r in got)
