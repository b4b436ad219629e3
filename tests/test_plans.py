"""What the plans read and move: columns pruned to the scan, filters pushed, no row-at-a-time Python, no cartesian product."""

import re

import pytest

from plumbrook import queries
from plumbrook.operators import quality_rules as qr
from plumbrook.operators.join_quality import JoinQuality
from plumbrook.operators.load_profile import plan_columns, ranged, value_runs
from plumbrook.operators.quality import Quality

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(text):
    return [set(re.findall(r"(\w+):", m)) for m in re.findall(r"ReadSchema: struct<([^>]*)", text)]


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet(f"{SMALL}/lineitem.parquet")


def test_rules_read_only_their_columns(lineitem):
    q = Quality.from_df(lineitem).rules([qr.Rule("a", "l_quantity <= 45"), qr.enum_rule("l_returnflag", ["A"])])
    text = plan(q.rule_statistics())
    assert read_columns(text) == [{"l_quantity", "l_returnflag"}] and text.count("Exchange") == 1 and "Python" not in text and "InPandas" not in text


def test_equal_keys_share_one_exchange(lineitem):
    q = Quality.from_df(lineitem).rules([qr.unique_rule("a", ["l_orderkey", "l_linenumber"]), qr.unique_rule("b", ["l_orderkey", "l_linenumber"])])
    assert plan(q.rule_statistics()).count("Exchange hashpartitioning") == 1


def test_filters_reach_the_scan(lineitem):
    text = plan(Quality.from_df(lineitem.where("l_quantity > 40")).rules([qr.Rule("a", "l_tax < 0.05")]).passing_rows().select("l_orderkey"))
    assert "GreaterThan(l_quantity,40" in text and "LessThan(l_tax,0.05" in text and read_columns(text) == [{"l_orderkey", "l_quantity", "l_tax"}]


def test_join_quality_counts_before_it_joins(spark, lineitem):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    text = plan(JoinQuality.equi(lineitem, orders, ["l_orderkey"], ["o_orderkey"]).statistics())
    assert read_columns(text) in ([{"l_orderkey"}, {"o_orderkey"}], [{"o_orderkey"}, {"l_orderkey"}]) and "partial_count" in text and "Cartesian" not in text


def test_load_profile_has_one_range_shuffle(spark):
    records = spark.read.parquet(f"{SMALL}/dq_record.parquet")
    text = plan(ranged(value_runs(records, plan_columns(records, ["amount", "zone_code"]), "load_id")))
    assert text.count("Exchange rangepartitioning") == 1 == text.count("Exchange ") and read_columns(text) == [{"load_id", "amount", "zone_code"}]


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if re.match(r"p\d_", n)))
def test_problem_queries_run_and_have_no_cartesian_product(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    assert not re.search(r"Cartesian|NestedLoop|BatchEvalPython", plan(df))
    df.write.format("noop").mode("overwrite").save()
