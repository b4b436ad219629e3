"""Reshaping, on tables of a harbour: every rule on its own, then random schemas against rules written out plainly."""

import dataclasses
import datetime
import random
from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbrook.errors import PlumbrookError
from plumbrook.operators import reshape as rs
from plumbrook.operators.reshape import ReshapeError, reshape, struct_of

SHIP = T.StructType([
    T.StructField("imo", T.LongType()), T.StructField("name", T.StringType()), T.StructField("draught", T.DecimalType(5, 2)),
    T.StructField("port", T.StructType([T.StructField("code", T.StringType()), T.StructField("berth", T.IntegerType())])),
])


@pytest.fixture(scope="module")
def arrivals(spark):
    rows = [(9074729, "Ada", "7.25", ("DEHAM", "4"), "2021-03-01"), (9433054, "Mira", None, ("NLRTM", None), "2021-03-02"), (None, "Tove", "11.5", None, None)]
    return spark.createDataFrame(rows, "imo int, NAME string, ` draught ` string, port struct<code:string,berth:string>, eta string")


def listed(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def errors(df, target, config):
    with pytest.raises(ReshapeError) as caught:
        reshape(df, target, config)
    return caught.value.errors


def test_types_names_and_nesting_at_once(arrivals):
    got = listed(reshape(arrivals, SHIP))
    assert [g["imo"] for g in got] == [9074729, 9433054, None] and [g["name"] for g in got] == ["Ada", "Mira", "Tove"]
    assert [str(g["draught"]) for g in got] == ["7.25", "None", "11.50"]
    assert [g["port"] for g in got] == [{"code": "DEHAM", "berth": 4}, {"code": "NLRTM", "berth": None}, None]
    assert reshape(arrivals, arrivals.schema) is arrivals


def test_all_that_does_not_fit_is_told_at_once(arrivals):
    told = errors(arrivals, SHIP, replace(rs.PARANOID, matching="exact"))
    kinds = [sum(part in t for t in told) for part in ("no way from", "has nothing for", "no field for")]
    assert kinds == [2, 2, 3]  # imo and berth need a cast; name and draught are spelled otherwise; so is what is left, and eta is extra


@pytest.mark.parametrize(("conflicts", "kept"), [("first", 1), ("last", 3)])
def test_columns_of_one_name(spark, conflicts, kept):
    df = spark.range(1).selectExpr("1 AS tide", "2 AS other", "3 AS TIDE")
    want = T.StructType.fromDDL("tide int")
    assert reshape(df, want, replace(rs.DEFAULT, conflicts=conflicts)).first()[0] == kept
    assert "2 columns" in errors(df, want, rs.DEFAULT)[0]
    both = reshape(df, want, replace(rs.DEFAULT, conflicts=conflicts, drop_extra_columns=False))
    assert [c for c in both.columns if c != "tide"] == ["other"]


def test_absent_fields(spark):
    df = spark.range(2).selectExpr("id AS buoy")
    want = T.StructType.fromDDL("buoy bigint, lit boolean, seen date, tags array<string>, at struct<lat:double,chart:string>")
    nulls = listed(reshape(df, want, replace(rs.DEFAULT, fill_missing_nulls=True)))
    assert nulls[1] == {"buoy": 1, "lit": None, "seen": None, "tags": None, "at": None}
    filled = listed(reshape(df, want, replace(rs.DEFAULT, fill_default_values=True)))
    assert filled[0] == {"buoy": 0, "lit": False, "seen": datetime.date(1970, 1, 1), "tags": [], "at": {"lat": 0.0, "chart": ""}}
    assert len(errors(df, want, rs.DEFAULT)) == 4


def test_nulls_where_the_target_has_none(spark):
    df = spark.createDataFrame([(1,), (None,)], "depth int")
    want = T.StructType([T.StructField("depth", T.IntegerType(), False)])
    assert "forbids" in errors(df, want, replace(rs.DEFAULT, fail_on_ignoring_nullability=True))[0]
    assert [r.depth for r in reshape(df, want, replace(rs.DEFAULT, fill_default_values=True)).collect()] == [1, 0]
    assert [r.depth for r in reshape(df, want).collect()] == [1, None]


@pytest.mark.parametrize(("order", "columns"), [("target", ["z", "m", "a"]), ("source", ["m", "a", "z"]), ("alphabetical", ["a", "m", "z"])])
def test_order_of_columns(spark, order, columns):
    df = spark.range(1).selectExpr("1 AS m", "2 AS a", "3 AS z")
    assert reshape(df, T.StructType.fromDDL("z int, m int, a int"), replace(rs.DEFAULT, order=order)).columns == columns


def test_ways_to_match_names(spark):
    df = spark.range(1).selectExpr("7 AS crewSize")
    for name, config, found in (("CREWSIZE", rs.DEFAULT, True), ("crew_size", rs.DEFAULT, False), ("crew_size", rs.DANGEROUS, True), ("crewSize", replace(rs.DEFAULT, matching="exact"), True), ("crewsize", replace(rs.DEFAULT, matching="exact"), False), ("whatever", replace(rs.DEFAULT, matching="index"), True)):
        want = T.StructType().add(name, T.IntegerType())
        if found:
            assert listed(reshape(df, want, config)) == [{name: 7}]
        elif not config.fill_missing_nulls:
            errors(df, want, config)
    assert any("twice" in e for e in errors(df, T.StructType().add("a", T.IntegerType()).add(" A", T.IntegerType()), rs.NOTEBOOK))
    with pytest.raises(PlumbrookError, match="struct type"):
        reshape(df, T.IntegerType())


def test_null_structs(spark):
    df = spark.createDataFrame([(None,), ((5,),)], "berth struct<no:int>")
    want = T.StructType.fromDDL("berth struct<no:bigint,quay:string>")
    fill = replace(rs.DEFAULT, fill_missing_nulls=True)
    assert listed(reshape(df, want, fill)) == [{"berth": None}, {"berth": {"no": 5, "quay": None}}]
    assert listed(reshape(df, want, replace(fill, keep_null_structs=False)))[0] == {"berth": {"no": None, "quay": None}}


@pytest.mark.parametrize("shape", ["d.M.yyyy", "yyyyMMdd", "dd MMM yyyy"])
def test_days_by_metadata_and_by_configuration(spark, shape):
    days = [datetime.date(2019, 12, 31) + datetime.timedelta(days=17 * k) for k in range(40)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    as_text = reshape(df, T.StructType([T.StructField("d", T.StringType(), True, {"format": shape})]))
    assert as_text.schema["d"].dataType == T.StringType()
    by_meta = reshape(as_text, T.StructType([T.StructField("d", T.DateType(), True, {"format": shape})]))
    by_config = reshape(as_text.select(F.col("d").alias("d", metadata={})), T.StructType.fromDDL("d date"), replace(rs.DEFAULT, date_format=shape))
    assert [r.d for r in by_meta.collect()] == [r.d for r in by_config.collect()] == days


def test_moments(spark):
    df = spark.createDataFrame([("31/01/22 23h05",), ("nonsense",), (None,)], "t string")
    got = [r.t for r in reshape(df, T.StructType.fromDDL("t timestamp"), replace(rs.DEFAULT, timestamp_format="dd/MM/yy HH'h'mm")).collect()]
    assert got == [datetime.datetime(2022, 1, 31, 23, 5), None, None]


def test_enumerations_there_and_back(spark):
    flags = ["red", "Green", "yellow"]
    number = T.StructType([T.StructField("flag", T.ShortType(), True, {"enum_values": flags})])
    texts = [f"{' ' * k}{random.Random(k).choice([str.upper, str.lower, str.title])(f)}" for k, f in enumerate(flags * 4)] + ["blue", "", None]
    made = reshape(spark.createDataFrame([(t,) for t in texts], "flag string").coalesce(1), number)
    want = [[f.lower() for f in flags].index(t.strip().lower()) if t and t.strip().lower() in [f.lower() for f in flags] else None if t is None else -1 for t in texts]
    assert [r.flag for r in made.collect()] == want
    back = reshape(made, T.StructType.fromDDL("flag string"))
    assert [r.flag for r in back.collect()] == [None if w is None or w < 0 else flags[w] for w in want]


def test_words_of_two_values(spark):
    answer = T.StructType([T.StructField("moored", T.BooleanType(), True, {"enum_values": ["at sea", "in port"]})])
    made = reshape(spark.createDataFrame([("In Port",), (" AT SEA",), ("drydock",), (None,)], "moored string").coalesce(1), answer)
    assert [r.moored for r in made.collect()] == [True, False, None, None]
    assert [r.moored for r in reshape(made, T.StructType.fromDDL("moored string")).collect()] == ["IN PORT", "AT SEA", None, None]


def test_collections_against_duckdb(spark):
    """Casts within arrays and maps give what DuckDB's casts give."""
    rows = [(k, [str(j) if j % 3 else None for j in range(k)], {str(j): f"{j}.5" for j in range(k)}) for k in range(6)]
    df = spark.createDataFrame(rows, "k int, a array<string>, m map<string,string>")
    got = listed(reshape(df, T.StructType.fromDDL("k string, a array<int>, m map<bigint,double>")).orderBy("k"))
    for (k, a, m), g in zip(rows, got, strict=True):
        assert g["k"] == str(k) and g["a"] == duckdb.execute("SELECT CAST($1 AS INT[])", [a]).fetchone()[0]
        assert g["m"] == {int(x): duckdb.execute("SELECT CAST($1 AS DOUBLE)", [y]).fetchone()[0] for x, y in m.items()}


def test_schema_of_a_class(spark):
    @dataclasses.dataclass
    class Port:
        code: str
        depth: float | None

    @dataclasses.dataclass
    class Call:
        ship: int
        ports: list[Port | None]
        fees: dict[str, datetime.date]
        flag: int = dataclasses.field(metadata={"type": T.ByteType(), "enum_values": ("a", "b"), "name": "flag code", "note": 1})
        gone: complex = dataclasses.field(metadata={"ignore": True})

    got = struct_of(Call)
    assert got.simpleString() == "struct<ship:bigint,ports:array<struct<code:string,depth:double>>,fees:map<string,date>,flag code:tinyint>"
    assert not got["ship"].nullable and got["flag code"].metadata == {"enum_values": ["a", "b"]} and got["ports"].dataType.elementType["depth"].nullable
    df = spark.sql("SELECT '12' AS SHIP, array(named_struct('depth', 3, 'code', 'X')) AS ports, map('m', '2020-05-05') AS fees, 'B' AS `flag code`")
    assert listed(reshape(df, Call)) == [{"ship": 12, "ports": [{"code": "X", "depth": 3.0}], "fees": {"m": datetime.date(2020, 5, 5)}, "flag code": 1}]

    @dataclasses.dataclass
    class Odd:
        c: complex

    with pytest.raises(PlumbrookError, match="complex"):
        struct_of(Odd)


@pytest.mark.parametrize("seed", range(6))
def test_random_schemas(spark, seed):
    """Columns in any order and spelling, some absent, some extra: the target's names with the values of their own."""
    r = random.Random(seed)
    names = [f"col{k}" for k in range(8)]
    held = r.sample(names, 6)
    df = spark.range(1).select(*(F.lit(names.index(n)).alias(r.choice([n, n.upper(), f" {n}"])) for n in held))
    wanted = r.sample(names, 5)
    want = T.StructType([T.StructField(n, r.choice([T.IntegerType(), T.StringType(), T.DoubleType()])) for n in wanted])
    got = reshape(df, want, replace(rs.DEFAULT, fill_missing_nulls=True))
    assert got.columns == wanted and [None if v is None else float(v) for v in got.first()] == [float(names.index(n)) if n in held else None for n in wanted]
