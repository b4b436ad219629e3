"""Frequent items and log-bucket percentiles against brute force, whatever the partitions."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbrook.llm import frequent, percentiles
from plumbrook.operators import runs

ITEMS = "load_id bigint, partition_no int, column_name string, item string, item_count bigint"


@pytest.fixture(scope="module")
def values():
    r = random.Random(1)
    out = ["hot"] * 1000 + ["warm"] * 30 + ["tie_a"] * 20 + ["tie_b"] * 20 + [None] * 50 + ["", "   "] * 20 + [" hot", "Hot", "x" * 100_000, "ünï"]
    out += [f"rare{r.randint(0, 3000)}" for _ in range(2000)]
    r.shuffle(out)
    return out


def counted(values):
    return Counter(v for v in values if v is not None and v.strip(" "))


@pytest.mark.parametrize("partitions", [1, 9])
@pytest.mark.parametrize("run_rows", [50, 1 << 19])
def test_items_above(spark, values, partitions, run_rows, monkeypatch):
    monkeypatch.setattr(runs, "RUN_ROWS", run_rows)
    df = spark.createDataFrame([(v, "one", 1) for v in values], "v string, w string, item_count int").repartition(partitions)
    got = sorted(tuple(r) for r in frequent.items_above(frequent.value_runs(df, ["v", "w"]), 0.005).collect())
    c = counted(values)
    total = sum(c.values())
    assert got == sorted([("v", i, n, total) for i, n in c.items() if n >= 0.005 * total] + [("w", "one", len(values), len(values))])


@pytest.mark.parametrize("k", [1, 3, 4, 50])
def test_top_items_with_ties(spark, values, k):
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(5)
    got = [tuple(r) for r in frequent.top_items(frequent.value_runs(df, ["v"]), k).orderBy("rank_no").select("item", "item_count").collect()]
    assert got == sorted(counted(values).items(), key=lambda x: (-x[1], x[0]))[:k]


def test_counted_items(spark):
    rows = [(1, 0, "c", "a", 5), (1, 0, "c", "a", 5), (1, 1, "c", "a", 2), (1, 1, "c", "b", None), (2, 1, "c", None, 9), (2, 1, "c", " ", 9), (2, 1, None, "a", 9), (None, None, "d", "z", 1)]
    once = frequent.once_per_partition(spark.createDataFrame(rows, ITEMS).withColumn("extra", F.lit(1)))
    got = sorted(tuple(r) for r in frequent.top_items(frequent.count_runs(once), 5).select("column_name", "item", "item_count", "column_total").collect())
    assert got == [("c", "a", 7, 7), ("c", "b", 0, 7), ("d", "z", 1, 1)]
    assert frequent.items_above(frequent.count_runs(once.limit(0)), 0.005).count() == 0


def exact(values, pct):
    v = sorted(x for x in values if x is not None and not math.isnan(x))
    return v[max(1, math.ceil(pct * len(v) / 100)) - 1]


@pytest.fixture(scope="module")
def numbers():
    r = random.Random(2)
    groups = {"a": [r.gauss(50, 20) for _ in range(500)], "b": [r.choice([-1e-300, -0.0, 0.0, 1e300, -5e-324, 7.0]) for _ in range(60)], None: [3.0, None, math.nan], "inf": [math.inf, -math.inf, 1.0], "none": [None, math.nan]}
    return {g: v + v[:1] for g, v in groups.items()}


def frame(spark, numbers):
    return spark.createDataFrame([(g, i % 3, v) for g, vs in numbers.items() for i, v in enumerate(vs)], "g string, load int, v double").withColumn("n", F.lit("clash")).repartition(4)


@pytest.mark.parametrize("accuracy", [0.05, 0.005])
def test_relative_error_and_merging(spark, numbers, accuracy):
    pcts = [0, 1, 50, 99, 100]
    wanted = spark.createDataFrame([(g, p) for g in numbers for p in pcts], "g string, pct int")
    loads = percentiles.bucket_counts(frame(spark, numbers), "v", ["load", "g"], accuracy)
    merged = percentiles.merge_counts(loads, ["g"])
    whole = percentiles.bucket_counts(frame(spark, numbers), "v", ["g"], accuracy)
    assert sorted(map(str, merged.collect())) == sorted(map(str, whole.select(merged.columns).collect()))
    got = {(r.g, r.pct): r.estimate for r in percentiles.percentiles(merged, ["g"], wanted, accuracy).collect()}
    assert set(got) == {(g, p) for g in numbers if g != "none" for p in pcts}
    for (g, p), estimate in got.items():
        want = exact(numbers[g], p)
        assert estimate == want or abs(estimate - want) <= accuracy * abs(want) * (1 + 1e-9) or abs(want) < 1e-320, (g, p, estimate, want)


@pytest.mark.parametrize("accuracy", [0.2, 0.005])
def test_deviations_are_exact(spark, numbers, accuracy):
    r = random.Random(3)
    rows = []
    for g, vs in numbers.items():
        if g in ("none", "inf"):
            continue
        for p in (5, 50, 95):
            want = exact(vs, p)
            rows += [(g, p, want / f) for f in (1.0, 1.25, 0.75, 1.2500001, 1.2499999, 0.7500001, 0.7499999, 2.0, -1.0, r.random())]
    accepted = spark.createDataFrame(rows, "g string, pct int, accepted_value double")
    got = sorted((str(x.g), x.pct, x.accepted_value) for x in percentiles.deviations(frame(spark, numbers), "v", ["g"], accepted, 0.25, accuracy).collect())
    far = lambda g, p, a: abs(exact(numbers[g], p) - a) > 0.25 * abs(a)
    assert got == sorted({(str(g), p, a) for g, p, a in rows if far(g, p, a)})


def test_empty(spark):
    empty = spark.createDataFrame([], "g string, v double")
    wanted = spark.createDataFrame([("a", 50)], "g string, pct int")
    assert percentiles.percentiles(percentiles.bucket_counts(empty, "v", ["g"]), ["g"], wanted).count() == 0


def test_buckets_rise_with_values(spark):
    r = random.Random(4)
    values = sorted([r.choice([-1, 1]) * 10 ** r.uniform(-320, 308) for _ in range(2000)] + [0.0, math.inf, -math.inf])
    got = [x.b for x in spark.createDataFrame(list(enumerate(values)), "i int, v double").select("i", percentiles.bucket_of(F.col("v")).alias("b")).orderBy("i").collect()]
    assert got == sorted(got)
