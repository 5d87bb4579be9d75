import pytest
from pyspark.sql import functions as F

from stayscope.plans.etl import run_etl
from stayscope.sources import readers, staging, writers


def test_quoted_line_breaks_and_null_tokens(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_text(
        "id,name,host_name,price,last_review,extra\n"
        '1,"two\nlines ""quoted""",NA,100,2019-01-02,kept\n'
        "2,n/a,,3.0,NaN,\n"
        "9007199254740993,x,y,oops,,z\n"
    )
    rows = readers.load_listings(spark, str(path), multi_line=True).orderBy("id").collect()
    assert tuple(rows[0]) == (1, 'two\nlines "quoted"', None, 100, "2019-01-02", "kept", [])
    assert tuple(rows[1]) == (2, None, None, 3, None, None, [])
    assert tuple(rows[2]) == (9007199254740993, "x", "y", None, None, "z", ["price"])


def test_nothing_is_lost_without_a_trace(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_text(
        "id,price,minimum_nights,number_of_reviews\n1,149.99,1.5,3.0\n2,$120.00,2,3.5\n3,0.75,x,\n"
    )
    df = readers.load_listings(spark, str(path))
    rows = [tuple(r) for r in df.orderBy("id").collect()]
    assert rows == [
        (1, 149.99, 1.5, 3, []),
        (2, None, 2.0, None, ["price", "number_of_reviews"]),
        (3, 0.75, None, None, ["minimum_nights"]),
    ]
    counts = {r["column_name"]: r["n"] for r in readers.unread_counts(df).collect()}
    assert counts == {"price": 1, "number_of_reviews": 1, "minimum_nights": 1}


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_missing_file(spark, tmp_path, fmt):
    with pytest.raises(FileNotFoundError):
        readers.load_listings(spark, str(tmp_path / "none"), fmt)


def test_write_modes(spark, tmp_path):
    df, path = spark.range(3), str(tmp_path / "t")
    writers.save_table(df, path)
    writers.save_table(df, path)
    assert spark.read.parquet(path).count() == 3
    writers.save_table(df, path, if_exists="append")
    assert spark.read.parquet(path).count() == 6
    with pytest.raises(Exception, match="already exists"):
        writers.save_table(df, path, if_exists="fail")
    assert writers.verify_load(spark, path, df).first()["matches"] is False


def test_jdbc_options():
    got = writers.jdbc_options("jdbc:x", "t", user="u")
    assert got == {"url": "jdbc:x", "dbtable": "t", "batchsize": "500", "numPartitions": "8", "user": "u"}


def test_shared_folder_comes_from_the_session(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    root = staging.shared_folder(spark)
    assert before is None or root == before
    assert staging.new_path(spark, "x").startswith(root)


def test_etl_from_csv(spark, workspace, tmp_path):
    raw = writers.save_table(workspace.raw, str(tmp_path / "raw"), "csv")
    result = run_etl(spark, raw, str(tmp_path / "out"), reference_date="2001-11-05", out_format="csv")
    assert result.verification.first()["matches"] is True
    assert result.featured.columns == workspace.featured.columns
    assert result.featured.exceptAll(workspace.featured).count() == 0
    assert result.validation.first()["n_rows"] == workspace.cleaned.count()
    assert result.summary.count() > 10


def test_partitioned_featured_table_prunes(spark, workspace, tmp_path):
    raw = writers.save_table(workspace.raw, str(tmp_path / "raw"))
    result = run_etl(
        spark, raw, str(tmp_path / "out"), "parquet", reference_date="2001-11-05",
        partition_by=("neighbourhood_group",),
    )
    assert result.featured.exceptAll(workspace.featured).count() == 0
    plan = result.featured.where("neighbourhood_group = 'Asia'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(neighbourhood_group" in plan


def test_listings_of_many_hosts_need_no_copies_of_them(spark, folder, tmp_path, monkeypatch):
    """Orders of customers that the table lacks stay out, frequent or not, on every path."""
    from stayscope.sources import order_listings as ol

    for name in ("customer", "lineitem", "nation", "region"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    key = F.col("o_orderkey")
    host = F.when(key % 3 == 0, -5).when(key % 11 == 0, F.lit(None)).when(key % 17 == 0, -key).otherwise(F.col("o_custkey"))
    orders = spark.read.parquet(f"{folder}/orders.parquet").withColumn("o_custkey", host)
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    small = ol.listings_from_orders(spark, str(tmp_path))
    asked, attach = [], ol.attach
    monkeypatch.setattr(ol, "attach", lambda *a, **kw: asked.append(kw) or attach(*a, **kw, broadcast_rows=1, hot_keys=2))
    large = ol.listings_from_orders(spark, str(tmp_path))
    assert [kw["spread"] for kw in asked] == [1]
    assert small.count() == orders.where("o_custkey >= 0").count() > 0
    assert small.exceptAll(large).count() == 0 and large.exceptAll(small).count() == 0


def test_both_median_tables_come_from_one_call(spark, folder, monkeypatch):
    from stayscope.plans import workspace as ws

    calls, area_medians = [], ws.area_medians
    monkeypatch.setattr(ws, "area_medians", lambda df: calls.append(df) or area_medians(df))
    w = ws.Workspace(spark, folder)
    first, again = w.medians, w.medians
    assert len(calls) == 1 and [t.columns[0] for t in first] == ["neighbourhood", "neighbourhood_group"]
    assert first == again
