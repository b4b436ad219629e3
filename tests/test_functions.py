"""Sketch aggregates, code lists, declared fields and aggregate summaries, on tables of a library."""

import dataclasses
import datetime
import decimal
import json
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbrook.errors import PlumbrookError
from plumbrook.functions import sketches
from plumbrook.functions.codes import cleanup_codes, collect_codes
from plumbrook.operators.aggsum import AggSummary
from plumbrook.operators.quality_rules import Field, fields_of


def test_frequent_items_are_exact_while_all_fit(spark):
    r = random.Random(3)
    shelves = [r.choice(["prose", "verse", "maps", None]) for _ in range(500)]
    got = spark.createDataFrame([(s,) for s in shelves], "s string").repartition(3).agg(sketches.frequent_items(F.col("s"), 2).alias("top")).first().top
    assert [tuple(t) for t in got] == Counter(s for s in shelves if s).most_common(2)


@pytest.mark.parametrize("make", [sketches.quantile_histogram, sketches.centroid_histogram])
def test_histograms_cover_all_pages(spark, make):
    pages = [float(p) for p in range(1, 2001)]
    got = spark.createDataFrame([(p,) for p in pages], "p double").repartition(4).agg(make(F.col("p"), 8).alias("h")).first().h
    assert 1 <= len(got) <= 8 and [list(b) for b in got] == sorted(list(b) for b in got)


def test_codes_against_plain_sets(spark):
    r = random.Random(8)
    pick = lambda: r.choice([None, [r.choice(["QA", "PR", "", None, "ZB"]) for _ in range(r.randint(0, 3))]])
    rows = [(r.randint(1, 4), pick(), pick()) for _ in range(60)]
    df = spark.createDataFrame(rows, "branch int, own array<string>, lent array<string>").withColumn("all", F.lit("0X"))
    got = {x.branch: x.c for x in df.groupBy("branch").agg(collect_codes(df.schema, "own", "lent", "all").alias("c")).collect()}
    assert got == {b: sorted({c for k, own, lent in rows if k == b for c in (own or []) + (lent or []) + ["0X"] if c}) for b in {k for k, *_ in rows}}
    assert [x.c for x in spark.createDataFrame([(["b", None, "a", "b", ""],), ([],)], "c array<string>").coalesce(1).select(cleanup_codes(F.col("c")).alias("c")).collect()] == [["a", "b"], []]
    with pytest.raises(PlumbrookError):
        collect_codes(df.schema, "branch")


def test_declared_fields_of_a_class():
    @dataclasses.dataclass
    class Loan:
        reader: int
        title: str | None
        price: decimal.Decimal
        due: datetime.date
        at: datetime.datetime
        late: bool
        marks: list[int]
        stamps: dict[str, datetime.date]
        state: str = dataclasses.field(metadata={"name": "loan state", "nullable": False, "enum_values": ["out", "in"], "regexp": "out|in", "format": "f"})
        cover: bytes = dataclasses.field(metadata={"ignore": True})

    kinds = {f.name: json.loads(f.data_type_json) for f in fields_of(Loan)}
    assert [kinds[n] for n in ("reader", "title", "price", "due", "at", "late")] == ["long", "string", "decimal(38,18)", "date", "timestamp", "boolean"]
    assert kinds["marks"]["elementType"] == "long" and (kinds["stamps"]["keyType"], kinds["stamps"]["valueType"]) == ("string", "date")
    assert fields_of(Loan)[-1] == Field("loan state", '"string"', False, ("out", "in"), "f", "out|in")

    @dataclasses.dataclass
    class Odd:
        name: str
        shape: complex

    assert [f.name for f in fields_of(Odd, ignore_unsupported=True)] == ["name"]
    with pytest.raises(PlumbrookError, match="shape of Odd"):
        fields_of(Odd)


@pytest.fixture(scope="module")
def loans(spark):
    r = random.Random(21)
    rows = [(r.choice(["east", "west", None]), r.choice(["book", "disc"]), r.randint(1, 30), r.random() < 0.2) for _ in range(300)]
    df = spark.createDataFrame(rows, "branch string, kind string, days int, lost boolean")
    df.createOrReplaceTempView("loan")
    spark.createDataFrame([("book", 4), ("disc", 2)], "kind string, fee int").createOrReplaceTempView("tariff")
    return df.toPandas()


@pytest.mark.parametrize(
    ("sql", "keys", "values", "tables"),
    [
        ("SELECT branch, COUNT(*) AS n, MAX(days) AS longest FROM loan GROUP BY branch", ["branch"], ["n", "longest"], ["loan"]),
        ("SELECT SUM(days) AS total FROM loan", [], ["total"], ["loan"]),
        ("WITH paid AS (SELECT l.*, t.fee FROM loan l JOIN tariff t USING (kind)) SELECT branch, kind, SUM(fee * days) AS due FROM paid GROUP BY 1, 2", ["branch", "kind"], ["due"], ["loan", "tariff"]),
    ],
)
def test_summaries_against_duckdb(spark, loans, sql, keys, values, tables):
    summary = AggSummary.from_sql(spark, sql)
    assert summary.info() == {"key_column_names": keys, "value_column_names": values, "referenced_table_names": tables}
    con = duckdb.connect()
    con.register("loan", loans)
    con.execute("CREATE TABLE tariff AS SELECT * FROM (VALUES ('book', 4), ('disc', 2)) v(kind, fee)")
    want = con.execute(sql).fetchall()
    got = [tuple(x.get(c) for c in (*keys, *values)) for x in json.loads(summary.result().first().data_json)]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize(("sql", "words"), [("SELECT kind, days FROM loan", "neither GROUP BY"), ("SELECT kind, MIN(branch) AS b FROM loan GROUP BY kind", "b is no value"), ("CACHE TABLE loan", "no query")])
def test_what_is_no_summary(spark, loans, sql, words):
    with pytest.raises(PlumbrookError, match=words):
        AggSummary.from_sql(spark, sql).info()


def test_summary_of_given_keys_and_limit(spark, loans):
    given = AggSummary.from_df(spark.table("loan"), keys=["branch", "kind"], limit=7)
    assert given.info()["value_column_names"] == ["days", "lost"] and len(json.loads(given.result().first().data_json)) == 7
    assert len(json.loads(AggSummary.from_df(spark.table("loan"), keys=["branch", "kind"], limit=None).result().first().data_json)) == 300
