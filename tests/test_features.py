from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from driftwell.operators import features


def series(spark, values, store=1):
    return [(store, 1, f"2024-01-{k + 1:02d}", float(v)) for k, v in enumerate(values)]


SCHEMA = "store_id int, product_id int, date string, demand double"


def test_lags_and_means_of_one_series(spark):
    df = spark.createDataFrame(series(spark, range(1, 21)), SCHEMA).repartition(3)
    rows = features.lags(df, ["store_id", "product_id"], "date").orderBy("date").collect()
    assert rows[7]["lag_7_demand"] == 1.0 and rows[14]["lag_14_demand"] == 1.0 and rows[7]["rolling_7_mean"] == 4.0
    assert rows[0]["lag_1_demand"] is None and rows[6]["rolling_7_mean"] is None


def test_series_do_not_leak(spark):
    df = spark.createDataFrame(series(spark, [10] * 5) + series(spark, [100] * 5, 2), SCHEMA)
    first = features.lags(df, ["store_id", "product_id"], "date").where("store_id = 2").orderBy("date").first()
    assert first["lag_1_demand"] is None


def test_existing_columns_stay_only_if_asked(spark):
    df = spark.createDataFrame(series(spark, [1, 2]), SCHEMA).withColumn("lag_1_demand", F.lit(9.0))
    assert features.lags(df, ["store_id"], "date").first()["lag_1_demand"] == 9.0
    assert features.lags(df, ["store_id"], "date", keep=False).orderBy("date").collect()[1]["lag_1_demand"] == 1.0


def test_cyclical(spark):
    df = features.cyclical(spark.range(7).select(F.col("id").alias("day_of_week"), (F.col("id") + 1).alias("month")))
    rows = df.orderBy("day_of_week").collect()
    for r in rows:
        assert math.isclose(r["day_of_week_sin"] ** 2 + r["day_of_week_cos"] ** 2, 1)
        assert math.isclose(r["month_sin"] ** 2 + r["month_cos"] ** 2, 1)
    dot = rows[0]["day_of_week_sin"] * rows[6]["day_of_week_sin"] + rows[0]["day_of_week_cos"] * rows[6]["day_of_week_cos"]
    assert math.isclose(dot, math.cos(2 * math.pi / 7))
    assert features.cyclical(spark.range(1)).columns == ["id"]


def test_calendar_and_bins(spark):
    df = spark.sql("select date'2024-12-25' d, 25 a union all select date'2024-12-28', 26 union all select date'2024-12-29', 71")
    rows = features.calendar(df, "d").withColumn("g", features.binned(F.col("a"), [17, 25, 35, 70], ["x", "y", "z"])).orderBy("d").collect()
    assert [(r["day_of_week"], r["is_weekend"], r["is_holiday"], r["g"]) for r in rows] == [(2, 0, 1, "x"), (5, 1, 0, "y"), (6, 1, 0, None)]


def test_ordinal_and_missing(spark):
    df = spark.createDataFrame([("small", "C"), ("huge", None)], "store_size string, product_category string")
    assert [tuple(r[2:]) for r in features.encode_categories(df).collect()] == [(0, 2), (0, 0)]


def test_serving_rows_fill_what_is_absent(spark):
    df = spark.sql("select 4 store_id, 5 product_id, date'2024-01-01' date, 2.0 price, 7.0 lag_7_demand")
    r = features.serving_rows(df).first()
    assert r["lag_14_demand"] == 7.0 and r["rolling_14_mean"] == 0.0 and r["store_size_encoded"] == 1 and r["product_category_encoded"] == 2 and r["month_cos"] == 1.0
    assert spark.range(1).select(features.clamped(F.lit(-3.2))).first()[0] == 0.0


def test_date_range_is_inclusive(spark):
    df = spark.sql("select explode(sequence(date'2024-01-01', date'2024-01-10')) date")
    assert features.date_range(df, "date", "2024-01-02", "2024-01-04").count() == 3


@pytest.mark.parametrize("n", [1, 3])
def test_label_codes_are_alphabetical(spark, n):
    df = spark.createDataFrame([("b",), ("a",), ("c",), (None,)], "k string").repartition(n)
    assert {r["k"]: r["v"] for r in features.label_codes(df, "k", "v").collect()} == {"a": 0, "b": 1, "c": 2, None: None}


@pytest.mark.parametrize("series_rows", [14, 20, 97])
def test_long_series_in_stretches_equal_whole_ones(spark, series_rows):
    """A series over many stretches, short ones, a null key, missing values and a column that exists."""
    rows = [("long", d, float(d % 17)) for d in range(500)] + [("short", d, 1.0 * d) for d in range(9)] + [(None, d, None if d % 5 == 0 else d / 3) for d in range(130)]
    df = spark.createDataFrame(rows, "store string, day int, demand double").withColumn("lag_7_demand", F.lit(-1.0))
    want = features.lags(df, ["store"], "day")
    got = features.lags(df.repartition(5), ["store"], "day", series_rows=series_rows)
    assert got.columns == want.columns
    near = lambda df: sorted((str(r[0]), r[1], *(None if x is None else round(x, 9) for x in r[2:])) for r in df.collect())
    assert near(got) == near(want)


def test_no_task_holds_a_long_series(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.range(40_000).select(F.lit("one").alias("store"), F.col("id").alias("day"), F.col("id").cast("double").alias("demand"))
        got = features.lags(df, ["store"], "day", series_rows=500)
        # The lags are summed, so that their windows are not pruned.
        sizes = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("lag_1_demand")).collect()]
        assert sum(sizes) == 40_000 and len(sizes) == 16 and max(sizes) < 8_000
        assert got.where("day >= 14 and (lag_14_demand <> day - 14 or rolling_7_mean <> day - 4 or lag_14_demand is null)").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
