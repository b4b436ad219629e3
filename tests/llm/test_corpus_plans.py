"""What the corpus queries read and move."""

import re

import pytest

from plumbrook.llm import frequent, queries

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("name", "columns", "exchanges"),
    [("p4_found", {"group_code", "measure"}, None), ("p6_found", {"doc_id", "text"}, 1), ("p7_found", {"doc_id", "source", "text"}, None), ("p8_found", {"doc_id", "lang", "text"}, 0)],
)
def test_reads_only_its_columns(spark, name, columns, exchanges):
    text = plan(queries.QUERIES[name](spark, SMALL))
    read = [set(re.findall(r"(\w+):", m)) for m in re.findall(r"ReadSchema: struct<([^>]*)", text)]
    assert columns in read and (exchanges is None or text.count("Exchange ") == exchanges)


def test_runs_are_made_before_the_range_shuffle(spark):
    text = plan(frequent.range_heaps(queries._runs(spark, SMALL), 201, 0.005))
    assert text.count("Exchange rangepartitioning") == 1 and text.index("Exchange rangepartitioning") < text.rindex("MapInArrow")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_and_have_no_cartesian_product(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    assert not re.search(r"Cartesian|NestedLoop|BatchEvalPython", plan(df))
    df.write.format("noop").mode("overwrite").save()
