"""Profiles on tables of a weather service: counts against DuckDB, sketches within their error, types read from texts."""

import datetime
import decimal
import json
import math
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbrook.errors import PlumbrookError
from plumbrook.operators.profile import ProfileConfig, TypeInference, legacy_profile, profile, schema_of, update_schema
from plumbrook.operators.reshape import reshape


def columns(df, config=ProfileConfig()):
    return {r["name"]: r for r in profile(df, config).columns().collect()}


@pytest.fixture(scope="module")
def readings(spark):
    r = random.Random(77)
    maybe = lambda v: None if r.random() < 0.1 else v
    rows = [
        (k, maybe(r.randint(-40, 45)), maybe(r.choice([0.0, -0.0, math.nan, round(r.gauss(10, 4), 3)])), maybe(r.choice(["fog", "hail", "", "sleet"])), maybe(r.random() < 0.3),
         maybe(datetime.date(2022, 1, 1) + datetime.timedelta(days=r.randint(0, 60))), maybe(decimal.Decimal(r.randint(0, 9999)) / 100))
        for k in range(3000)
    ]
    return spark.createDataFrame(rows, "station bigint, degrees int, wind double, sky string, frost boolean, day date, rain decimal(6,2)").repartition(5)


def test_counts_against_duckdb(readings):
    got = columns(readings)
    con = duckdb.connect()
    con.register("t", readings.toPandas())
    assert list(got) == readings.columns and {g["count"] for g in got.values()} == {3000}
    for name in readings.columns:
        assert got[name].count_nulls == con.execute(f"SELECT COUNT(*) FROM t WHERE {name} IS NULL").fetchone()[0] or name == "wind"
    assert (got["sky"].count_empty, got["sky"].max_length, got["sky"].min, got["sky"].max) == con.execute("SELECT COUNT_IF(sky = ''), MAX(LENGTH(sky)), MIN(sky), MAX(sky) FROM t").fetchone()
    assert (int(got["degrees"].min), int(got["degrees"].max), got["degrees"].count_zeros) == con.execute("SELECT MIN(degrees), MAX(degrees), COUNT_IF(degrees = 0) FROM t").fetchone()
    assert got["degrees"].count_unique == con.execute("SELECT COUNT(DISTINCT degrees) FROM t").fetchone()[0] and got["degrees"].extras["is_exact"] == "true"
    items = {i.item: i["count"] for i in got["sky"]["items"]}
    assert items == dict(con.execute("SELECT sky, COUNT(*) FROM t WHERE sky IS NOT NULL GROUP BY 1").fetchall())
    assert got["station"].count_unique == pytest.approx(3000, rel=0.1) and got["station"].extras["is_exact"] == "false"
    assert (got["day"].min, got["frost"].min, got["frost"].max) == (str(int(datetime.datetime(2022, 1, 1, tzinfo=datetime.UTC).timestamp())), "0", "1")


def test_nan_and_signed_zero(readings):
    wind = columns(readings)["wind"]
    frame = [r.wind for r in readings.select("wind").collect()]
    assert wind.count_empty == sum(1 for v in frame if v is not None and math.isnan(v)) and wind.count_zeros == sum(1 for v in frame if v == 0)
    assert wind.mean == pytest.approx(sum(v for v in frame if v is not None and not math.isnan(v)) / sum(1 for v in frame if v is not None and not math.isnan(v)))


def test_quantiles_within_the_error_of_ranks(readings):
    ranked = sorted(r.station for r in readings.select("station").collect())
    for q, v in json.loads(columns(readings)["station"].extras["quantiles"]).items():
        assert abs(ranked.index(int(float(v))) / 3000 - float(q)) < 0.03


@pytest.mark.parametrize("partitions", [1, 6])
def test_distribution_of_many_values(spark, partitions):
    """Values with a known density: bucket counts are off by no more than the error of ranks."""
    df = spark.range(8000).select((F.col("id") * F.col("id")).cast("double").alias("v")).repartition(partitions)
    got = columns(df, ProfileConfig(pmf_buckets=5, items=3))["v"]
    values = sorted(k * k for k in range(8000))
    assert len(got.pmf) == 5 and sum(b["count"] for b in got.pmf) == 8000
    for b in got.pmf[1:-1]:
        assert abs(sum(1 for v in values if b.low <= v < b.high) - b["count"]) < 8000 * 0.03


def test_distribution_of_few_values(spark):
    got = columns(spark.createDataFrame([(float(v),) for v in (2, 2, 6, 10, 10, 10)], "v double"))["v"]
    assert [tuple(b) for b in got.pmf] == [(0.0, 4.0, 2), (4.0, 8.0, 1), (8.0, 12.0, 3)]


def test_long_texts_count_as_a_whole(spark):
    """Texts that share a long start are different values; only what is shown is cut."""
    texts = ["x" * 2000 + str(k % 7) for k in range(70)] + ["short"] * 5
    got = columns(spark.createDataFrame([(t,) for t in texts], "s string"), ProfileConfig(max_item_length=50))["s"]
    assert got.count_unique == 8 and got.extras["is_exact"] == "true" and got.max_length == 2001
    assert sorted((i.item, i["count"]) for i in got["items"]) == [("short", 5)] + [("x" * 50, 10)] * 7


def test_sized_and_nested_columns(spark):
    rows = [([k] * (k % 4) if k % 5 else None, {str(j): j for j in range(k % 3)}, bytes(k % 6), (k,) if k % 2 else None) for k in range(60)]
    got = columns(spark.createDataFrame(rows, "gusts array<int>, by_hour map<string,int>, image binary, place struct<id:int>"))
    assert (got["gusts"].count_nulls, got["gusts"].count_empty, got["gusts"].max_length) == (12, sum(1 for k in range(60) if k % 5 and k % 4 == 0), 3)
    assert (got["by_hour"].count_empty, got["by_hour"].max_length, got["image"].count_empty, got["image"].max_length) == (20, 2, 10, 5)
    assert (got["place"].count_nulls, got["place"].data_type, got["place"].count_empty) == (30, "struct", None)
    nested = legacy_profile(spark.createDataFrame(rows, "gusts array<int>, by_hour map<string,int>, image binary, place struct<id:int>"))
    assert [r["name"] for r in nested.collect()] == ["gusts", "by_hour", "image", "place", "place.id"]
    with pytest.raises(PlumbrookError, match="profiled"):
        profile(spark.sql("SELECT INTERVAL 3 MONTH AS wait"))


def test_what_is_turned_off_is_null(readings):
    got = columns(readings.select("degrees", "sky"), ProfileConfig(items=0, count_distincts=False, quantiles=False))
    assert all(not g["items"] and g.count_unique is None and not g.pmf for g in got.values())


def test_no_rows_and_no_numbers(spark):
    none = columns(spark.createDataFrame([], "a double, b string, c timestamp, d map<int,int>"))
    assert {(g["count"], g.count_nulls, g.min, g.max) for g in none.values()} == {(0, 0, None, None)}
    nan = columns(spark.createDataFrame([(math.nan,), (None,)], "a double"))["a"]
    assert (nan.count_empty, nan.count_nulls, nan.min, nan.mean, list(nan.pmf)) == (1, 1, None, None, [])


RULES = TypeInference(date_formats=("dd/MM/yyyy", "yyyyMMdd"), timestamp_formats=("yyyy-MM-dd HH:mm",), enums=(("boolean", ("DRY", "WET")), ("sky", ("CLEAR", "FOG", "RAIN"))))


@pytest.mark.parametrize(
    ("texts", "kind"),
    [
        (["7", " -12 ", "+003"], "long"), (["1", "0", " 1"], "long"), (["9223372036854775808", "1"], "double"), (["1e3", ".5", "NaN", "-Infinity"], "double"), (["31/12/2021", "01/01/2022"], "date"),
        (["20211231", "20220101"], "long"), (["2022-01-01 05:30", "2022-06-01 00:00"], "timestamp"), (["dry", "WET ", " Dry"], "boolean"), (["fog", "RAIN", "clear"], "integer"), (["31/02/2021"], "string"),
        (["dry", "7"], "string"), (["", "  ", None], "string"), (["", "5"], "long"),
    ],
)
def test_types_of_texts(spark, texts, kind):
    got = columns(spark.createDataFrame([(t,) for t in texts], "t string"), ProfileConfig(infer_types_from_strings=True, inference=RULES))["t"]
    assert got.data_type == kind


def test_preferences_and_schema(spark):
    df = spark.createDataFrame([("1", "2.5", "fog", "31/12/2021"), ("0", "3", "CLEAR", "01/01/2022")], "b string, f string, sky string, day string")
    prefer = TypeInference(True, True, True, True, RULES.date_formats, RULES.timestamp_formats, None, RULES.enums)
    got = columns(df, ProfileConfig(infer_types_from_strings=True, inference=prefer))
    schema = schema_of(list(got.values()))
    assert [(f.name, f.dataType, f.nullable) for f in schema] == [("b", T.BooleanType(), False), ("f", T.FloatType(), False), ("sky", T.IntegerType(), False), ("day", T.DateType(), False)]
    assert [tuple(r) for r in reshape(df, schema).orderBy("day").collect()] == [(True, 2.5, 1, datetime.date(2021, 12, 31)), (False, 3.0, 0, datetime.date(2022, 1, 1))]
    old = T.StructType([T.StructField("SKY", T.StringType()), T.StructField("kept", T.LongType())])
    assert [(f.name, f.dataType) for f in update_schema(old, list(got.values()))] == [("sky", T.IntegerType()), ("kept", T.LongType())]


@pytest.mark.parametrize(("zone", "hour"), [(None, 12), ("UTC", 12), ("Asia/Tokyo", 3), ("America/Lima", 17)])
def test_moments_of_a_zone(spark, zone, hour):
    df = spark.createDataFrame([("2022-03-04 12:00",)], "t string")
    got = columns(df, ProfileConfig(infer_types_from_strings=True, inference=TypeInference(timestamp_formats=("yyyy-MM-dd HH:mm",), time_zone=zone)))["t"]
    assert int(got.min) == int(datetime.datetime(2022, 3, 4, hour, tzinfo=datetime.UTC).timestamp())


def test_one_row_of_result(readings):
    got = profile(readings).result().collect()
    assert len(got) == 1 and got[0].table.rows == 3000 and [c["name"] for c in got[0]["columns"]] == readings.columns
    assert pd.DataFrame([c.asDict() for c in got[0]["columns"]])["count_nulls"].between(0, 3000).all()
