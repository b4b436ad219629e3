"""The profile per load against brute force, whatever the partitions."""

import bisect
import datetime
import decimal
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbrook import queries
from plumbrook.operators import load_profile as lp
from plumbrook.operators import runs
from plumbrook.sources.folder import shared_folder

SCHEMA = "load_id bigint, num int, x double, text string, day date, at timestamp, dec decimal(9,2), arr array<int>"
NAMES = ["num", "x", "text", "day", "at", "dec", "arr"]
ACCEPTED = "column_name string, data_type string, data_type_json string, nullable boolean, profiled_count bigint, count_nulls bigint, count_unique bigint, min_value string, max_value string, rule_name string, count_violations bigint, pmf array<struct<low:double,high:double,bucket_count:bigint>>, items array<struct<item:string,item_count:bigint>>"
VIOLATION = "load_id bigint, primary_key array<string>, rule_name string"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    some = lambda v: None if r.random() < 0.1 else v
    out = []
    for load, size in ((1, 200), (2, 40), (3, 900), (4, 1), (None, 5)):
        for _ in range(size):
            out.append((load, some(r.randint(-5, 5 * (load or 1))), some(r.choice([0.0, -0.0, math.nan, r.gauss(0, 10), 1e300, -1e-300])), some(r.choice(["", "  ", "a", "b", "ä", "hot", f"v{r.randint(0, 50)}"])), some(datetime.date(2024, 1, 1 + r.randint(0, 9))), some(datetime.datetime(2024, 1, 1, r.randint(0, 5))), some(decimal.Decimal(r.randint(0, 500)) / 4), some([r.randint(0, 3)])))
    return out


def present(values):
    out = []
    for v in values:
        if v is None or isinstance(v, str) and not v.strip(" "):
            continue
        out.append(v + 0.0 if isinstance(v, float) else v)
    return out


def key(v):
    return (1, 0) if isinstance(v, float) and math.isnan(v) else (0, v)


@pytest.mark.parametrize("partitions", [1, 7])
def test_profile(spark, rows, partitions, monkeypatch):
    monkeypatch.setattr(runs, "RUN_ROWS", 64)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("column_no", F.lit("clash")).repartition(partitions)
    got = {(r.load_id, r.column_name): r for r in lp.profile(df, NAMES, "load_id").collect()}
    assert len(got) == 5 * len(NAMES)
    for load in (1, 2, 3, 4, None):
        own = [r for r in rows if r[0] == load]
        for k, name in enumerate(NAMES, 1):
            r, values = got[load, name], [str(v) if isinstance(v, list) else v for v in present([x[k] for x in own])]
            assert (r.row_count, r.count_nulls, r.count_unique) == (len(own), len(own) - len(values), len({key(v) for v in values})), (load, name)
            if name == "x" and values:
                assert float(r.min_value) == min(values, key=key)
            elif name != "arr" and values:
                assert (r.min_value, r.max_value) == tuple(str(f(values)) if name != "dec" else str(float(f(values))) for f in (min, max))


@pytest.mark.parametrize("partitions", [1, 5])
def test_quantiles(spark, rows, partitions):
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    plans = lp.plan_columns(df, ["num", "x", "text"])
    placed = lp.curves(lp.ranged(lp.value_runs(df, plans, "load_id")), shared_folder(spark, "test"))
    got = {}
    for r in lp.named(lp.quantiles(placed, [0, 5, 50, 99.5, 100]), plans).select("*", lp.shown(F.col("kind"), F.col("ordinal"), F.col("text")).alias("v")).collect():
        assert (r.load_id, r.column_name, r.pct) not in got
        got[r.load_id, r.column_name, r.pct] = r.v
    for load in (1, 2, 3, 4, None):
        for k, name in ((1, "num"), (2, "x"), (3, "text")):
            values = sorted(present([x[k] for x in rows if x[0] == load]), key=key)
            for pct in (0, 5, 50, 99.5, 100):
                if values:
                    want = values[max(1, math.ceil(pct * len(values) / 100)) - 1]
                    v = got[load, name, pct]
                    assert (float(v) == want or (math.isnan(want) and v == "NaN")) if name == "x" else v == str(want)


def test_distances(spark, rows):
    got = {(r.load_id, r.column_name): (r.prior_load, r.ks_distance) for r in lp.distances(spark.createDataFrame(rows, SCHEMA).repartition(3), ["num", "text"], "load_id").collect()}
    for load, prior in ((2, 1), (3, 2), (4, 3)):
        for k, name in ((1, "num"), (3, "text")):
            a, b = (sorted(present([x[k] for x in rows if x[0] == n])) for n in (load, prior))
            if a and b:
                want = max(abs(bisect.bisect_right(a, v) / len(a) - bisect.bisect_right(b, v) / len(b)) for v in a + b)
                assert got[load, name] == (prior, pytest.approx(want, abs=1e-8))
            else:
                assert (load, name) not in got
    assert not [k for k in got if k[0] in (1, None)]


def test_order_of_doubles():
    values = np.array([-math.inf, -1e300, -1.5, -1e-310, 0.0, 1e-310, 1.5, 1e300, math.inf, math.nan])
    order = lp.order_of_doubles(values)
    assert (np.diff(order) > 0).all() and lp.order_of_doubles(np.array([-0.0]))[0] == order[4]
    assert np.array_equal(lp.doubles_of(order), values, equal_nan=True)


def accepted(name, **fields):
    base = dict.fromkeys(("data_type", "data_type_json", "nullable", "profiled_count", "count_nulls", "count_unique", "min_value", "max_value", "rule_name", "count_violations", "pmf", "items"))
    return tuple(({"column_name": name} | base | fields).values())


def test_findings(spark):
    rows = [(1, 5, "a")] * 93 + [(1, None, " ")] * 7 + [(2, 5, "a")] * 92 + [(2, None, "")] * 8 + [(3, 30, "b")] * 10 + [(4, None, None)]
    df = spark.createDataFrame(rows, "load_id bigint, num int, text string")
    table = spark.createDataFrame(
        [
            accepted("num", profiled_count=100, count_nulls=2, min_value="1", max_value="20", pmf=[(0.0, 10.0, 100), (10.0, 20.0, 0)]),
            accepted("text", profiled_count=100, count_nulls=2, count_unique=1, items=[("a", 60), ("b", 40)], rule_name=" Text__Rule", count_violations=2),
            accepted("absent", profiled_count=1, count_nulls=0),
        ],
        ACCEPTED,
    )
    logged = [(1, [str(k)], "TEXT__rule ") for k in range(7)] + [(2, [str(k)], "text__rule") for k in range(8)] * 2 + [(9, ["1"], "text__rule"), (2, None, "text__rule"), (1, ["x"], None)]
    got = sorted(tuple(r) for r in lp.findings(df, "load_id", table, spark.createDataFrame(logged, VIOLATION)).collect())
    assert got == [
        (1, "text", "drift"), (2, "num", "null_rate"), (2, "text", "drift"), (2, "text", "null_rate"), (2, "text", "violations"), (3, "num", "drift"), (3, "num", "value_range"), (3, "text", "drift"),
        (4, "num", "null_rate"), (4, "text", "distinct_count"), (4, "text", "null_rate"),
    ]
    assert lp.findings(df.limit(0), "load_id", table, spark.createDataFrame([], VIOLATION)).count() == 0


def test_profile_shows_cells_and_logged_violations(spark):
    rows = [(1, 5, "a")] * 3 + [(1, 15, "b"), (1, 99, " "), (2, None, None), (None, 5, "a")]
    df = spark.createDataFrame(rows, "load_id bigint, num int, text string")
    table = spark.createDataFrame([accepted("num", pmf=[(0.0, 10.0, 1), (10.0, 20.0, 3)]), accepted("text", items=[("b", 1), ("c", 1)], rule_name="Extra")], ACCEPTED)
    logged = [
        (1, ["1"], ["num"], " NUM__rule "), (1, ["1"], ["num"], "num__rule"), (1, ["2"], ["num", "text"], "num__rule"), (1, ["1"], ["num"], "other"), (1, ["1"], None, "extra"),
        (1, None, ["num"], "other"), (2, ["3"], ["absent"], "other"), (None, ["4"], ["text"], "extra"),
    ]
    got = {(r.load_id, r.column_name): r for r in lp.profile(df, ["num", "text"], "load_id", table, spark.createDataFrame(logged, "load_id bigint, primary_key array<string>, column_names array<string>, rule_name string")).collect()}
    assert len(got) == 6 and got[1, "text"].count_nulls == 1
    assert [tuple(c) for c in got[1, "num"].cells] == [(0.0, 10.0, None, 0.6, 0.25), (10.0, 20.0, None, 0.2, 0.75)] and got[1, "num"].outside_share == 0.2
    assert [tuple(c) for c in got[1, "text"].cells] == [(None, None, "b", 0.25, 0.5), (None, None, "c", 0.0, 0.5)] and got[1, "text"].outside_share == 0.75
    assert [c.share for c in got[2, "num"].cells] == [None, None] and got[2, "num"].outside_share is None
    assert {k: [tuple(v) for v in r.violations] for k, r in got.items() if r.violations} == {
        (1, "num"): [("num__rule", 2), ("other", 1)], (1, "text"): [("extra", 1), ("num__rule", 1)], (None, "text"): [("extra", 1)],
    }


@pytest.mark.parametrize("name", ["p2_profile", "p2_quantiles", "p2_distances"])
def test_queries_take_every_column(spark, name):
    folder = "/root/testdata/sf0.001"
    every = set(spark.read.parquet(f"{folder}/dq_record.parquet").columns) - {"load_id"}
    got = queries.QUERIES[name](spark, folder).groupBy("load_id").agg(F.collect_set("column_name").alias("names")).collect()
    assert got and all(set(r.names) == every for r in got)


def test_odd_accepted_profiles(spark):
    df = spark.createDataFrame([(1, 5, "a", 0.5), (1, 6, "b", None)], "load_id bigint, num int, text string, x double")
    table = spark.createDataFrame(
        [
            accepted("num", profiled_count=0, count_nulls=0, min_value="low", max_value="", pmf=[(None, 1.0, 3), None], count_unique=0), accepted("text", pmf=[(0.0, 1.0, 5)], items=[]), accepted("x", min_value="0.6", max_value="nan", items=[("0.5", 1), (None, 2), None]),
        ],
        ACCEPTED,
    )
    got = sorted(tuple(r) for r in lp.findings(df, "load_id", table, spark.createDataFrame([], VIOLATION)).collect())
    assert got == [(1, "num", "distinct_count"), (1, "x", "value_range")]


def test_accepted_profiles_of_other_columns_and_items_of_days(spark, monkeypatch):
    monkeypatch.setattr(lp, "MOST_COLUMNS", 3)
    rows = [(1, datetime.date(2024, 1, 1), datetime.datetime(2024, 1, 1, 5)), (1, datetime.date(2024, 1, 2), datetime.datetime(2024, 1, 1, 6)), (2, datetime.date(2024, 1, 3), datetime.datetime(2024, 1, 1, 7))]
    df = spark.createDataFrame(rows, "load_id bigint, day date, at timestamp")
    own = [accepted("day", items=[("2024-01-01", 1), ("no day", 0), ("2024-01-02", 1)]), accepted("at", items=[("2024-01-01 05:00:00", 1), ("2024-01-01 06:00:00", 1)])]
    table = spark.createDataFrame([accepted(f"absent{k}") for k in range(5)] + own, ACCEPTED).coalesce(1)
    got = sorted(tuple(r) for r in lp.findings(df, "load_id", table, spark.createDataFrame([], VIOLATION)).collect())
    assert got == [(2, "at", "drift"), (2, "day", "drift")]
    with pytest.raises(ValueError):
        lp.findings(df, "load_id", spark.createDataFrame(own * 2, ACCEPTED), spark.createDataFrame([], VIOLATION))


def test_merge_sorted_across_batches():
    import pyarrow as pa

    table = pa.table({"k": ["a", "a", "b", None, None, "c"], "n": [1, 2, 3, 4, 5, 6]})
    for size in (1, 2, 3, 6):
        merged = pa.concat_tables(runs.merge_sorted(table.to_batches(max_chunksize=size), ["k"], "n"))
        assert merged.to_pydict() == {"k": ["a", "b", None, "c"], "n": [3, 3, 9, 6]}
    assert list(runs.merge_sorted([], ["k"], "n")) == []


@pytest.mark.parametrize(("keys", "parts"), [([], 4), ([7], 4), ([3, 1, 2, 9], 4), (list(range(500)), 7), (list(range(0, 90, 3)), 64)])
def test_neighbours_over_many_ranges(spark, keys, parts):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame([(k, -(k or 0)) for k in keys], "k bigint, v bigint").repartition(3)
        got = sorted(tuple(r) for r in lp.neighbours(df, "k", ["v"]).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = sorted(keys)
    at = lambda n: order[n] if 0 <= n < len(order) else None
    minus = lambda v: None if v is None else -v
    want = [(k, -k, at(n - 1), minus(at(n - 1)), at(n + 1), minus(at(n + 1))) for n, k in enumerate(order)]
    assert got == want
