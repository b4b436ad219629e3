"""Queries over the general operators, each beside the SQL that has to give the same rows."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbrook.errors import PlumbrookError
from plumbrook.functions import sketches
from plumbrook.functions.codes import cleanup_codes, collect_codes
from plumbrook.functions.codes import register as register_codes
from plumbrook.operators import quality_rules as qr
from plumbrook.operators import reshape as rs
from plumbrook.operators.aggsum import AggSummary
from plumbrook.operators.join_quality import JoinQuality
from plumbrook.operators.profile import ProfileConfig, Profiler, TypeInference, profile
from plumbrook.operators.quality import Quality, QualityConfig
from plumbrook.plans.sql_files import run_sql, run_sql_metrics
from plumbrook.sources.folder import shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Data quality

LINE_RULES = [
    qr.Rule("l_quantity__max", "l_quantity <= 45"),
    qr.enum_rule("l_returnflag", ["A", "N"]),
    qr.Rule("__primary_key_unique", "(COUNT(*) OVER (PARTITION BY l_orderkey, l_linenumber)) = 1"),
]
_LINES = "WITH w AS (SELECT *, l_quantity <= 45 AS a, l_returnflag IS NULL OR l_returnflag IN ('A', 'N') AS b, COUNT(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1 AS c FROM lineitem)"


def _lines(spark: SparkSession, folder: str) -> Quality:
    return Quality.from_df(table(spark, folder, "lineitem")).rules(LINE_RULES)


@query(
    f"{_LINES} SELECT 'l_quantity__max' AS rule_name, CAST(COUNT_IF(NOT COALESCE(a, FALSE)) AS BIGINT) AS violations FROM w UNION ALL SELECT 'l_returnflag__enum_values', "
    "CAST(COUNT_IF(NOT COALESCE(b, FALSE)) AS BIGINT) FROM w UNION ALL SELECT '__primary_key_unique', CAST(COUNT_IF(NOT COALESCE(c, FALSE)) AS BIGINT) FROM w"
)
def dq_rule_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).rule_statistics()


@query(f'{_LINES} SELECT COUNT(*) AS "rows", CAST(COUNT_IF(NOT (COALESCE(a, FALSE) AND COALESCE(b, FALSE) AND COALESCE(c, FALSE))) AS BIGINT) AS violations FROM w')
def dq_table_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).table_statistics()


@query(
    f"{_LINES}, s AS (SELECT CAST(COUNT_IF(NOT COALESCE(a, FALSE)) AS BIGINT) AS a, CAST(COUNT_IF(NOT COALESCE(b, FALSE)) AS BIGINT) AS b, CAST(COUNT_IF(NOT COALESCE(c, FALSE)) AS BIGINT) AS c FROM w), "
    "n AS (SELECT unnest(['l_orderkey','l_partkey','l_suppkey','l_linenumber','l_quantity','l_extendedprice','l_discount','l_tax','l_returnflag','l_linestatus','l_shipdate']) AS column_name) "
    "SELECT column_name, CASE column_name WHEN 'l_quantity' THEN a WHEN 'l_returnflag' THEN b WHEN 'l_orderkey' THEN c WHEN 'l_linenumber' THEN c ELSE 0 END AS violations FROM n, s"
)
def dq_column_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).column_statistics()


ORDER_RULES = [qr.Rule("price__max", "o_totalprice < 200000"), qr.Rule("status__known", "status IN ('F', 'O')")]
_ORDERS = "SELECT *, NULLIF(o_orderstatus, 'P') AS status FROM orders"


def _orders(spark: SparkSession, folder: str) -> Quality:
    orders = table(spark, folder, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("P")))
    return Quality.from_df(orders).rules(ORDER_RULES).primary_key(["o_orderkey"])


@query(
    f"WITH w AS ({_ORDERS}) SELECT o_orderkey, 'price__max' AS rule_name, '<null>' AS shown_status FROM w WHERE NOT (o_totalprice < 200000) "
    "UNION ALL SELECT o_orderkey, 'status__known', COALESCE(status, '__NULL__') FROM w WHERE NOT (status IN ('F', 'O'))"
)
def dq_violation_per_row(spark: SparkSession, folder: str) -> DataFrame:
    v = _orders(spark, folder).violations()
    shown = F.when(F.array_contains("column_names", "status"), F.get("row_values", F.lit(0))).otherwise("<null>")
    return v.select(F.get("primary_key", F.lit(0)).cast("bigint").alias("o_orderkey"), "rule_name", shown.alias("shown_status"))


@query(f"WITH w AS ({_ORDERS}) SELECT o_orderkey, status FROM w WHERE NOT (o_totalprice < 200000 AND status IN ('F', 'O'))")
def dq_failing_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _orders(spark, folder).failing_rows().select("o_orderkey", "status")


@query(f"WITH w AS ({_ORDERS}) SELECT o_orderkey, status FROM w WHERE o_totalprice < 200000 AND status IN ('F', 'O')")
def dq_passing_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _orders(spark, folder).passing_rows().select("o_orderkey", "status")


@query("SELECT 'l_orderkey__unique' AS rule_name, CAST(COUNT_IF(n > 1) AS BIGINT) AS violations FROM (SELECT COUNT(*) OVER (PARTITION BY l_orderkey, l_partkey) AS n FROM lineitem)")
def dq_unique_rule(spark: SparkSession, folder: str) -> DataFrame:
    return Quality.from_df(table(spark, folder, "lineitem")).rules([qr.unique_rule("l_orderkey", ["l_orderkey", "l_partkey"])]).rule_statistics()


@query(
    "SELECT '__primary_key_not_null' AS rule_name, CAST(COUNT_IF(o_orderkey IS NULL) AS BIGINT) AS violations FROM orders "
    "UNION ALL SELECT '__primary_key_unique', CAST(COUNT_IF(n > 1) AS BIGINT) FROM (SELECT COUNT(*) OVER (PARTITION BY o_orderkey) AS n FROM orders)"
)
def dq_primary_key(spark: SparkSession, folder: str) -> DataFrame:
    return Quality.from_df(table(spark, folder, "orders")).primary_key(["o_orderkey"]).rule_statistics()


@query(
    "SELECT 'p_brand__enum_values' AS rule_name, CAST(COUNT_IF(upper(p_brand) NOT IN ('BRAND#11', 'BRAND#12', 'BRAND#13')) AS BIGINT) AS violations FROM part "
    "UNION ALL SELECT 'p_type__regexp', CAST(COUNT_IF(NOT regexp_matches(p_type, '^[A-M]')) AS BIGINT) FROM part "
    "UNION ALL SELECT 'p_size__not_null', CAST(COUNT_IF(p_size IS NULL) AS BIGINT) FROM part"
)
def dq_value_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = [qr.enum_rule("p_brand", ["Brand#11", "Brand#12", "Brand#13"], ignore_case=True), qr.regexp_rule("p_type", "^[A-M]"), qr.not_null_rule("p_size")]
    return Quality.from_df(table(spark, folder, "part")).rules(rules).rule_statistics()


@query("SELECT 'digits__type' AS rule_name, CAST(COUNT_IF(TRY_CAST(regexp_replace(p_name, '[^0-9a-c]', '', 'g') AS INTEGER) IS NULL) AS BIGINT) AS violations FROM part")
def dq_type_rule(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select(F.regexp_replace("p_name", "[^0-9a-c]", "").alias("digits"))
    return Quality.from_df(part).rules([qr.type_rule(spark, "digits", T.StringType(), T.IntegerType())]).rule_statistics()


@query(
    "SELECT 'both' AS rule_name, CAST(COUNT_IF(NOT (p_size > 10 AND p_retailprice < 1500)) AS BIGINT) AS violations FROM part "
    "UNION ALL SELECT 'either', CAST(COUNT_IF(NOT (p_size > 10 OR p_retailprice < 1500)) AS BIGINT) FROM part"
)
def dq_all_any(spark: SparkSession, folder: str) -> DataFrame:
    parts = [qr.Rule("a", "p_size > 10"), qr.Rule("b", "p_retailprice < 1500")]
    return Quality.from_df(table(spark, folder, "part")).rules([qr.all_of("both", parts), qr.any_of("either", parts)]).rule_statistics()


CUSTOMER_FIELDS = [
    qr.Field("c_custkey", '"long"', nullable=False), qr.Field("c_name", '"string"', regexp="[02468]$"), qr.Field("c_mktsegment", '"string"', enum_values=("BUILDING", "MACHINERY")), qr.Field("c_phone", '"string"'),
]


@query(
    "SELECT '__no_missing_fields' AS rule_name, COUNT(*) AS violations FROM customer UNION ALL SELECT '__no_extra_fields', COUNT(*) FROM customer UNION ALL SELECT '__primary_key_not_null', 0 UNION ALL SELECT '__primary_key_unique', "
    "CAST(COUNT_IF(n > 1) AS BIGINT) FROM (SELECT COUNT(*) OVER (PARTITION BY c_custkey) AS n FROM customer) UNION ALL SELECT 'c_custkey__type', 0 UNION ALL SELECT 'c_custkey__not_null', 0 UNION ALL SELECT 'c_name__type', 0 "
    "UNION ALL SELECT 'c_name__regexp', CAST(COUNT_IF(NOT regexp_matches(c_name, '[02468]$')) AS BIGINT) FROM customer UNION ALL SELECT 'c_mktsegment__type', 0 "
    "UNION ALL SELECT 'c_mktsegment__enum_values', CAST(COUNT_IF(c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) AS BIGINT) FROM customer"
)
def dq_schema_rules(spark: SparkSession, folder: str) -> DataFrame:
    q = Quality.from_df(table(spark, folder, "customer")).fields(CUSTOMER_FIELDS).primary_key(["c_custkey"]).config(QualityConfig(fail_on_extra_columns=True))
    return q.rule_statistics()


RULE_SQL = """
WITH big AS (SELECT * FROM {orders} WHERE o_totalprice > 50000)
SELECT
  o.*,
  -- every order has a known status
  o.o_orderstatus IN ('F', 'O') AS status__known,
  (SELECT FIRST(c.c_custkey) FROM {customer} AS c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 0) IS NOT NULL AS customer__solvent
FROM big AS o
ORDER BY o.o_orderkey
"""


@query(
    "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 50000) SELECT 'status__known' AS rule_name, CAST(COUNT_IF(o_orderstatus NOT IN ('F', 'O')) AS BIGINT) AS violations FROM big "
    "UNION ALL SELECT 'customer__solvent', CAST(COUNT_IF(o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS BIGINT) FROM big"
)
def dq_sql_rules(spark: SparkSession, folder: str) -> DataFrame:
    names = {n: f"dq_sql_{n}" for n in ("orders", "customer")}
    for n, view in names.items():
        table(spark, folder, n).createOrReplaceTempView(view)
    return Quality.from_sql(spark, RULE_SQL.format(**names)).rule_statistics()


@query("SELECT 'n_name__known' AS rule_name, COUNT(*) AS violations FROM nation")
def dq_missing_columns(spark: SparkSession, folder: str) -> DataFrame:
    return Quality.from_df(table(spark, folder, "nation")).rules([qr.named_rule("n_name", "known", "n_name = n_other")]).rule_statistics()


@query("SELECT CAST(LEAST(60, a + b) AS BIGINT) AS sampled FROM (SELECT LEAST(20, COUNT_IF(NOT (l_quantity <= 45))) AS a, LEAST(20, COUNT_IF(NOT (l_quantity > 5))) AS b FROM lineitem)")
def dq_row_sample_size(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty rows for each of two rules that exclude each other."""
    q = Quality.from_df(table(spark, folder, "lineitem")).rules([qr.Rule("max", "l_quantity <= 45"), qr.Rule("min", "l_quantity > 5")]).config(QualityConfig(max_rows=60))
    return q.row_sample().agg(F.count(F.lit(1)).alias("sampled"))


@query(
    f"{_LINES}, s AS (SELECT COUNT(*) AS n, COUNT_IF(NOT COALESCE(a, FALSE)) AS a, COUNT_IF(NOT COALESCE(b, FALSE)) AS b, COUNT_IF(NOT COALESCE(c, FALSE)) AS c, COUNT_IF(NOT (COALESCE(a, FALSE) AND COALESCE(b, FALSE) AND COALESCE(c, FALSE))) AS bad FROM w) "
    "SELECT kind, name, CAST(violations AS BIGINT) AS violations FROM (SELECT 'table' AS kind, 'rows' AS name, n AS violations FROM s UNION ALL SELECT 'table', 'violations', bad FROM s UNION ALL SELECT 'rule', 'l_quantity__max', a FROM s "
    "UNION ALL SELECT 'rule', 'l_returnflag__enum_values', b FROM s UNION ALL SELECT 'rule', '__primary_key_unique', c FROM s UNION ALL SELECT 'sample', 'enough', LEAST(1, bad) FROM s)"
)
def dq_result(spark: SparkSession, folder: str) -> DataFrame:
    """The nested result row of all statistics and the sample, taken apart."""
    one = _lines(spark, folder).result()
    row = lambda kind, name, n: F.struct(F.lit(kind).alias("kind"), name.alias("name"), n.cast("bigint").alias("violations"))
    whole = F.array(
        row("table", F.lit("rows"), F.col("statistics.table.rows")), row("table", F.lit("violations"), F.col("statistics.table.violations")),
        row("sample", F.lit("enough"), F.least(F.lit(1), F.size("row_sample"))),
    )
    rules = F.transform("statistics.rule", lambda s: row("rule", s["rule_name"], s["violations"]))
    return one.select(F.inline(F.concat(whole, rules)))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CASE WHEN n_regionkey = 2 AND n_nationkey > 9 THEN 'away,early' WHEN n_regionkey = 2 THEN 'away' ELSE 'early' END AS rules FROM nation WHERE n_regionkey = 2 OR n_nationkey > 9")
def dq_sample_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Where all rows fit, the sample is all rows that break a rule, each with the rules it breaks."""
    q = Quality.from_df(table(spark, folder, "nation")).rules([qr.Rule("away", "n_regionkey <> 2"), qr.Rule("early", "n_nationkey <= 9")]).config(QualityConfig(max_rows_per_rule=1000))
    return q.row_sample().select(F.col("row")[0].alias("n_nationkey"), F.col("row")[1].alias("n_name"), F.array_join("violated_rule_names", ",").alias("rules"))


@query("SELECT unnest(['SUM', 'n_name', 'fine']) AS rule, unnest(['not boolean', 'not unique', 'none']) AS reason, (SELECT COUNT(*) FROM nation) AS n")
def dq_refused(spark: SparkSession, folder: str) -> DataFrame:
    """Rules that are no rules of the table, and one that is."""
    nation, told = table(spark, folder, "nation"), []
    for rule in (qr.Rule("SUM", "n_nationkey + n_regionkey"), qr.Rule("n_name", "n_regionkey > 1"), qr.Rule("fine", "n_regionkey > 1")):
        try:
            n = Quality.from_df(nation).rules([rule]).table_statistics().first()["rows"]
            told.append((rule.name, "none", n))
        except PlumbrookError as e:
            told.append((rule.name, next(r for r in ("not boolean", "not unique") if r in str(e)), nation.count()))
    return spark.createDataFrame(told, "rule string, reason string, n bigint")


@dataclasses.dataclass
class DeclaredCustomer:
    """What the customers' table should hold."""

    c_custkey: str
    c_mktsegment: str = dataclasses.field(metadata={"enum_values": ["BUILDING", "MACHINERY", "AUTOMOBILE"], "nullable": False})
    c_name: str = dataclasses.field(metadata={"regexp": "7$"})


@query(
    "SELECT 'c_custkey__type' AS rule_name, CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'c_mktsegment__type', 0 UNION ALL SELECT 'c_mktsegment__not_null', CAST(COUNT_IF(c_mktsegment IS NULL) AS BIGINT) FROM customer "
    "UNION ALL SELECT 'c_mktsegment__enum_values', CAST(COUNT_IF(c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')) AS BIGINT) FROM customer UNION ALL SELECT 'c_name__type', 0 UNION ALL SELECT 'c_name__regexp', CAST(COUNT_IF(NOT c_name LIKE '%7') AS BIGINT) FROM customer"
)
def dq_class_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Rules from the fields of a class."""
    return Quality.from_df(table(spark, folder, "customer")).fields(qr.fields_of(DeclaredCustomer)).rule_statistics()


@query("WITH w AS (SELECT COUNT(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT 'customer__unique' AS rule_name, CAST(COUNT_IF(n > 1) AS BIGINT) AS violations FROM w")
def dq_unique_copies(spark: SparkSession, folder: str) -> DataFrame:
    """A key that most rows share with others."""
    return Quality.from_df(table(spark, folder, "orders")).rules([qr.unique_rule("customer", ["o_custkey"])]).rule_statistics()


# Join quality

_KEYS = "l AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY 1), r AS (SELECT NULLIF(c_custkey, 7) AS k, COUNT(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1), j AS (SELECT COALESCE(l.n, 0) AS a, COALESCE(r.n, 0) AS b, COALESCE(l.k, r.k) AS k FROM l FULL JOIN r ON l.k IS NOT DISTINCT FROM r.k)"


def _orders_customers(spark: SparkSession, folder: str) -> JoinQuality:
    rich = table(spark, folder, "customer").where("c_acctbal > 0").select(F.nullif("c_custkey", F.lit(7)).alias("c_custkey"))
    return JoinQuality.equi(table(spark, folder, "orders"), rich, ["o_custkey"], ["c_custkey"])


@query(
    f"WITH {_KEYS} SELECT CAST(SUM(a) AS BIGINT) AS left_rows, CAST(SUM(b) AS BIGINT) AS right_rows, CAST(COALESCE(SUM(CASE WHEN k IS NULL THEN a END), 0) AS BIGINT) AS left_nulls, CAST(COALESCE(SUM(CASE WHEN k IS NULL THEN b END), 0) AS BIGINT) AS right_nulls, "
    "CAST(COUNT_IF(a > 0 AND k IS NOT NULL) AS BIGINT) AS left_distinct, CAST(COUNT_IF(b > 0 AND k IS NOT NULL) AS BIGINT) AS right_distinct, CAST(SUM(a * b) AS BIGINT) AS \"inner\", CAST(SUM(a * GREATEST(1, b)) AS BIGINT) AS \"left\", "
    "CAST(SUM(GREATEST(1, a) * b) AS BIGINT) AS \"right\", CAST(SUM(GREATEST(1, a) * GREATEST(1, b)) AS BIGINT) AS \"full\", CAST(SUM(a) * SUM(b) AS BIGINT) AS \"cross\" FROM j"
)
def dq_join_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return _orders_customers(spark, folder).statistics()


def _join_rules(how: str, rules: list[tuple[str, str]]) -> None:
    sql = " UNION ALL ".join(f"SELECT '{name}' AS rule_name, CAST(COUNT_IF(NOT ({test})) AS BIGINT) AS violations FROM j" for name, test in rules)

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _orders_customers(spark, folder).how(how).rule_statistics()

    run.__name__ = f"dq_join_rules_{how}"
    query(f"WITH {_KEYS} {sql}")(run)


_join_rules("inner", [("left_key__dropping", "a > 0"), ("right_key__dropping", "b > 0"), ("left_key__multiplying", "a <= 1"), ("right_key__multiplying", "b <= 1")])
_join_rules("left", [("right_key__missing", "b > 0"), ("right_key__multiplying", "b <= 1")])
_join_rules("right", [("left_key__missing", "a > 0"), ("left_key__multiplying", "a <= 1")])
_join_rules("full", [("left_key__missing", "a > 0"), ("right_key__missing", "b > 0"), ("left_key__multiplying", "a <= 1"), ("right_key__multiplying", "b <= 1")])


@query(
    "WITH l AS (SELECT r_regionkey AS k, COUNT(*) AS n FROM region GROUP BY 1), r AS (SELECT n_regionkey AS k, COUNT(*) AS n FROM nation GROUP BY 1), j AS (SELECT COALESCE(l.n, 0) AS a, COALESCE(r.n, 0) AS b FROM l FULL JOIN r ON l.k < r.k) "
    "SELECT CAST(SUM(a * b) AS BIGINT) AS \"inner\", CAST(SUM(a * GREATEST(1, b)) AS BIGINT) AS \"left\", CAST(SUM(GREATEST(1, a) * b) AS BIGINT) AS \"right\", CAST(SUM(GREATEST(1, a) * GREATEST(1, b)) AS BIGINT) AS \"full\" FROM j"
)
def dq_join_theta(spark: SparkSession, folder: str) -> DataFrame:
    less = F.col("left.r_regionkey") < F.col("right.n_regionkey")
    j = JoinQuality.theta(table(spark, folder, "region"), table(spark, folder, "nation"), less, ["r_regionkey"], ["n_regionkey"])
    return j.statistics().select("inner", "left", "right", "full")


@query(
    "WITH l AS (SELECT r_regionkey AS k, COUNT(*) AS n FROM region GROUP BY 1), r AS (SELECT n_regionkey AS k, MIN(n_nationkey) AS m, COUNT(*) AS n FROM nation GROUP BY n_regionkey, n_nationkey), "
    "j AS (SELECT l.n AS a, r.n AS b FROM l JOIN r ON l.k > r.k AND l.k + r.m > 3) SELECT CAST(SUM(a * b) AS BIGINT) AS \"inner\" FROM j"
)
def dq_join_derived_keys(spark: SparkSession, folder: str) -> DataFrame:
    """A join whose key columns are those its condition refers to."""
    condition = (F.col("left.r_regionkey") > F.col("right.n_regionkey")) & (F.col("left.r_regionkey") + F.col("right.n_nationkey") > 3)
    return JoinQuality.theta(table(spark, folder, "region"), table(spark, folder, "nation"), condition).statistics().select("inner")


@query(
    f"WITH {_KEYS} SELECT 'o_custkey' AS left_key, 'c_custkey' AS right_key, 'LEFT' AS join_type, CAST(SUM(a * GREATEST(1, b)) AS BIGINT) AS joined, CAST(COUNT(*) AS BIGINT) AS keys, CAST(COUNT_IF(NOT b > 0 OR NOT b <= 1) AS BIGINT) AS violations FROM j"
)
def dq_join_report(spark: SparkSession, folder: str) -> DataFrame:
    """The report's row taken apart."""
    got = _orders_customers(spark, folder).how("left").report()
    return got.select(
        F.col("join_info.left_key_column_names")[0].alias("left_key"), F.col("join_info.right_key_column_names")[0].alias("right_key"), F.col("join_info.join_type").alias("join_type"),
        F.col("join_statistics.left").alias("joined"), F.col("result.statistics.table.rows").alias("keys"), F.col("result.statistics.table.violations").alias("violations"),
    )


# Reshape


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def reshape_coerce(spark: SparkSession, folder: str) -> DataFrame:
    return rs.reshape(table(spark, folder, "nation"), T.StructType.fromDDL("n_nationkey string, n_name string, n_regionkey bigint"))


@query("SELECT s_suppkey FROM supplier")
def reshape_drop_extra(spark: SparkSession, folder: str) -> DataFrame:
    return rs.reshape(table(spark, folder, "supplier"), T.StructType.fromDDL("s_suppkey bigint"))


@query("SELECT s_suppkey, CAST(NULL AS VARCHAR) AS s_phone, s_name FROM supplier")
def reshape_fill_missing(spark: SparkSession, folder: str) -> DataFrame:
    return rs.reshape(table(spark, folder, "supplier"), T.StructType.fromDDL("s_suppkey bigint, s_phone string, s_name string"), replace(rs.DEFAULT, fill_missing_nulls=True))


@query("SELECT r_regionkey AS key, r_name AS label FROM region")
def reshape_index(spark: SparkSession, folder: str) -> DataFrame:
    return rs.reshape(table(spark, folder, "region"), T.StructType.fromDDL("key int, label string"), replace(rs.DEFAULT, matching="index"))


@query('SELECT r_name AS "rName" FROM region')
def reshape_normalized(spark: SparkSession, folder: str) -> DataFrame:
    return rs.reshape(table(spark, folder, "region"), T.StructType.fromDDL("rName string"), rs.DANGEROUS)


@query("SELECT n_nationkey, n_name || '/' || CAST(n_regionkey AS VARCHAR) AS place FROM nation")
def reshape_nested(spark: SparkSession, folder: str) -> DataFrame:
    nested = table(spark, folder, "nation").select("n_nationkey", F.struct(F.col("n_regionkey").alias("Region"), F.col("n_name").alias("NAME"), F.lit(1).alias("extra")).alias("place"))
    out = rs.reshape(nested, T.StructType.fromDDL("n_nationkey int, place struct<name: string, region: string>"))
    return out.select("n_nationkey", F.concat_ws("/", "place.name", "place.region").alias("place"))


@query("SELECT vec_id, len(embedding) AS n, ROUND(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings")
def reshape_array(spark: SparkSession, folder: str) -> DataFrame:
    out = rs.reshape(table(spark, folder, "embeddings"), T.StructType.fromDDL("vec_id bigint, embedding array<double>"))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return out.select("vec_id", F.size("embedding").cast("bigint").alias("n"), F.round(total, 4).alias("total"))


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS key, CAST(CAST(value AS BIGINT) AS VARCHAR) AS value FROM (SELECT event_id, user_id, trunc(value) AS value FROM events)")
def reshape_map(spark: SparkSession, folder: str) -> DataFrame:
    maps = table(spark, folder, "events").select("event_id", F.create_map("user_id", F.col("value").cast("bigint")).alias("m"))
    out = rs.reshape(maps, T.StructType.fromDDL("event_id bigint, m map<string,string>"))
    return out.select("event_id", F.explode("m"))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_LISTED = ", ".join(f"'{p}'" for p in _PRIORITIES)


@query(f"SELECT o_orderkey, CAST(COALESCE(list_position([{_LISTED}], upper(trim(o_orderpriority))), 0) - 1 AS INTEGER) AS o_orderpriority FROM orders")
def reshape_enum_to_int(spark: SparkSession, folder: str) -> DataFrame:
    return rs.reshape(table(spark, folder, "orders"), T.StructType().add("o_orderkey", T.LongType()).add(T.StructField("o_orderpriority", T.IntegerType(), True, {"enum_values": _PRIORITIES})))


@query("SELECT n_nationkey, list_extract(['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'], n_regionkey + 1) AS n_regionkey FROM nation")
def reshape_int_to_enum(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation").withMetadata("n_regionkey", {"enum_values": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]})
    return rs.reshape(nation, T.StructType.fromDDL("n_nationkey int, n_regionkey string"))


@query("SELECT l_orderkey, CASE WHEN l_linestatus = 'F' THEN FALSE WHEN l_linestatus = 'O' THEN TRUE END AS l_linestatus FROM lineitem")
def reshape_bool_word(spark: SparkSession, folder: str) -> DataFrame:
    return rs.reshape(table(spark, folder, "lineitem"), T.StructType().add("l_orderkey", T.LongType()).add(T.StructField("l_linestatus", T.BooleanType(), True, {"enum_values": ["F", "O"]})))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def reshape_dates(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd.MM.yyyy").alias("day"))
    return rs.reshape(texts, T.StructType().add("o_orderkey", T.LongType()).add(T.StructField("day", T.DateType(), True, {"format": "dd.MM.yyyy"})))


@dataclasses.dataclass
class ReshapedOrder:
    """The target of a reshape, as a class."""

    o_orderkey: int
    o_orderstatus: int = dataclasses.field(metadata={"type": T.IntegerType(), "enum_values": ["F", "O", "P"]})
    price: float | None = dataclasses.field(metadata={"name": "o_totalprice"})


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE -1 END AS o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders")
def reshape_to_class(spark: SparkSession, folder: str) -> DataFrame:
    return rs.reshape(table(spark, folder, "orders"), ReshapedOrder)


@query("SELECT c_custkey, COALESCE(NULLIF(c_mktsegment, 'BUILDING'), '') AS segment, COALESCE(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0) AS balance FROM customer")
def reshape_not_null(spark: SparkSession, folder: str) -> DataFrame:
    """Nulls become default values where the target has none."""
    rows = table(spark, folder, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"))
    key = rows.schema["c_custkey"].dataType
    target = T.StructType([T.StructField("c_custkey", key), T.StructField("segment", T.StringType(), False), T.StructField("balance", T.DoubleType(), False)])
    return rs.reshape(rows, target, replace(rs.DEFAULT, fill_default_values=True))


@query("SELECT n_nationkey AS first, n_regionkey AS last FROM nation")
def reshape_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Of columns of one name the first, and the last."""
    nation = table(spark, folder, "nation")
    twice = nation.select(F.col("n_nationkey").alias("k"), "n_name", F.col("n_regionkey").alias("K"))
    target = T.StructType([T.StructField("k", nation.schema["n_nationkey"].dataType), T.StructField("n_name", T.StringType())])
    of = lambda how: rs.reshape(twice, target, replace(rs.DEFAULT, conflicts=how)).withColumnRenamed("k", how)
    return of("first").join(of("last"), "n_name").select("first", "last")


@query("SELECT unnest(['target', 'source', 'alphabetical']) AS sorted, unnest(['r_name,r_regionkey,extra', 'extra,r_regionkey,r_name', 'extra,r_name,r_regionkey']) AS columns, (SELECT COUNT(*) FROM region) AS n")
def reshape_order(spark: SparkSession, folder: str) -> DataFrame:
    """The three orders of columns."""
    rows = table(spark, folder, "region").select(F.lit(1).alias("extra"), "r_regionkey", "r_name")
    target = T.StructType([T.StructField("r_name", T.StringType()), T.StructField("r_regionkey", T.LongType())])
    made = {how: rs.reshape(rows, target, replace(rs.DEFAULT, order=how, drop_extra_columns=False)) for how in ("target", "source", "alphabetical")}
    return spark.createDataFrame([(how, ",".join(df.columns), df.count()) for how, df in made.items()], "sorted string, columns string, n bigint")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'DONE' ELSE 'OPEN' END AS state FROM orders")
def reshape_word_of_boolean(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("state", metadata={"enum_values": ["open", "done"]}))
    return rs.reshape(rows, T.StructType([rows.schema["o_orderkey"], T.StructField("state", T.StringType())]))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day, CAST(o_orderdate AS DATE) AS again FROM orders")
def reshape_day_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Days as texts by the target's format, and back by the configured one."""
    rows = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    texts = rs.reshape(rows, T.StructType([rows.schema["o_orderkey"], T.StructField("day", T.StringType(), True, {"format": "dd/MM/yyyy"})]))
    plain = texts.select("o_orderkey", F.col("day").alias("again", metadata={}))
    back = rs.reshape(plain, T.StructType([rows.schema["o_orderkey"], T.StructField("again", T.DateType())]), replace(rs.DEFAULT, date_format="dd/MM/yyyy"))
    return texts.join(back, "o_orderkey").select("o_orderkey", "day", "again")


@query("SELECT unnest(['missing', 'twice', 'extra', 'kind']) AS reason, unnest([1, 1, 2, 1]) AS n, (SELECT COUNT(*) FROM region) AS regions")
def reshape_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Why a table can't be given a schema: all reasons, counted by kind."""
    region = table(spark, folder, "region").select("r_regionkey", "r_name", F.array("r_name").alias("names"), F.lit(1).alias("more"))
    target = T.StructType([T.StructField("r_name", T.StringType()), T.StructField("R_NAME", T.StringType()), T.StructField("gone", T.LongType()), T.StructField("names", T.LongType())])
    try:
        rs.reshape(region, target, replace(rs.DEFAULT, fail_on_extra_column=True))
        told: list[str] = []
    except rs.ReshapeError as e:
        told = e.errors
    kinds = {"missing": "has nothing for", "twice": "twice", "extra": "no field for", "kind": "no way from"}
    return spark.createDataFrame([(k, sum(mark in t for t in told), region.count()) for k, mark in kinds.items()], "reason string, n int, regions bigint")


# Profiles


def _profile_sql(name: str, columns: list[str], value: Callable[[str], str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS name, {value(c)} FROM {name}" for c in columns)


@query(
    " UNION ALL ".join(
        _profile_sql(t, cs, lambda c: f'COUNT(*) AS "count", CAST(COUNT_IF({c} IS NULL) AS BIGINT) AS count_nulls')
        for t, cs in (("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]), ("documents", ["doc_id", "text", "lang", "source", "n_chars", "title", "rating", "item_code", "reviewer_code", "reviewed_on", "posted_at"]))
    )
)
def dp_column_counts(spark: SparkSession, folder: str) -> DataFrame:
    plain = ProfileConfig(quantiles=False, items=0, count_distincts=False)
    parts = [profile(table(spark, folder, t), plain).columns() for t in ("customer", "documents")]
    return parts[0].unionByName(parts[1]).select("name", "count", "count_nulls")


_WHOLE = ["l_linenumber", "l_suppkey"]


@query(_profile_sql("lineitem", _WHOLE, lambda c: f"CAST(MIN({c}) AS VARCHAR) AS min, CAST(MAX({c}) AS VARCHAR) AS max, CAST(ROUND(AVG({c})) AS DOUBLE) AS mean, CAST(COUNT_IF({c} = 0) AS BIGINT) AS count_zeros, CAST(CEIL(length(bin(MAX({c}))) / 8.0) AS BIGINT) AS max_length"))
def dp_integral(spark: SparkSession, folder: str) -> DataFrame:
    got = profile(table(spark, folder, "lineitem").select(*_WHOLE), ProfileConfig(items=0, quantiles=False)).columns()
    return got.select("name", "min", "max", "mean", "count_zeros", "max_length")


@query(_profile_sql("lineitem", ["l_discount", "l_quantity"], lambda c: f"MIN({c}) AS low, MAX({c}) AS high, ROUND(AVG({c}), 6) AS mean, CAST(COUNT_IF({c} = 0) AS BIGINT) AS count_zeros, CAST(8 AS BIGINT) AS max_length"))
def dp_fractional(spark: SparkSession, folder: str) -> DataFrame:
    got = profile(table(spark, folder, "lineitem").select("l_discount", "l_quantity"), ProfileConfig(items=0, quantiles=False)).columns()
    return got.select("name", F.col("min").cast("double").alias("low"), F.col("max").cast("double").alias("high"), F.round("mean", 6).alias("mean"), "count_zeros", "max_length")


@query(_profile_sql("documents", ["text", "lang", "title"], lambda c: f"MIN(substring({c}, 1, 1024)) AS min, MAX(substring({c}, 1, 1024)) AS max, CAST(MAX(length({c})) AS BIGINT) AS max_length, CAST(COUNT_IF({c} = '') AS BIGINT) AS count_empty"))
def dp_text(spark: SparkSession, folder: str) -> DataFrame:
    got = profile(table(spark, folder, "documents").select("text", "lang", "title"), ProfileConfig(items=0, count_distincts=False)).columns()
    return got.select("name", "min", "max", "max_length", "count_empty")


@query("SELECT o_orderpriority AS item, COUNT(*) AS \"count\" FROM orders GROUP BY 1")
def dp_top_items(spark: SparkSession, folder: str) -> DataFrame:
    got = profile(table(spark, folder, "orders").select("o_orderpriority"), ProfileConfig(quantiles=False)).columns()
    return got.select(F.inline("items"))


@query("SELECT CAST(l_linenumber AS DOUBLE) - 0.5 AS low, CAST(l_linenumber AS DOUBLE) + 0.5 AS high, COUNT(*) AS \"count\" FROM lineitem GROUP BY l_linenumber")
def dp_pmf_discrete(spark: SparkSession, folder: str) -> DataFrame:
    return profile(table(spark, folder, "lineitem").select("l_linenumber")).columns().select(F.inline("pmf"))


@query(
    "WITH p AS (SELECT MIN(n_nationkey) AS lo, MAX(n_nationkey) AS hi, COUNT(*) AS n FROM nation), q AS (SELECT lo - (hi - lo) * (0.005 / 0.99) AS start, ((hi - lo) + 2 * (hi - lo) * (0.005 / 0.99)) / 5 AS width FROM p) "
    "SELECT round(start + width * k, 6) AS low, round(start + width * (k + 1), 6) AS high, (SELECT COUNT(*) FROM nation WHERE (k = 0 OR n_nationkey >= start + width * k) AND (k = 4 OR n_nationkey < start + width * (k + 1))) AS \"count\" FROM q, range(5) r(k)"
)
def dp_pmf_sketch(spark: SparkSession, folder: str) -> DataFrame:
    """A distribution from a sketch that holds all values, in five buckets."""
    got = profile(table(spark, folder, "nation").select("n_nationkey"), ProfileConfig(pmf_buckets=5, items=3)).columns().select(F.inline("pmf"))
    return got.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "count")


@query("SELECT 'l_extendedprice' AS name, COUNT(*) AS total, CAST(20 AS INTEGER) AS buckets FROM lineitem WHERE l_extendedprice IS NOT NULL")
def dp_pmf_approximate(spark: SparkSession, folder: str) -> DataFrame:
    """A distribution from a sketch, in twenty buckets: they hold all values."""
    got = profile(table(spark, folder, "lineitem").select("l_extendedprice"), ProfileConfig(pmf_buckets=20)).columns()
    return got.select("name", F.aggregate("pmf", F.lit(0).cast("bigint"), lambda s, b: s + b["count"]).alias("total"), F.size("pmf").alias("buckets"))


_NUMBERS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    _profile_sql("lineitem", _NUMBERS, lambda c: f'COUNT(*) AS "count", CAST(COUNT_IF({c} IS NULL) AS BIGINT) AS count_nulls, CAST(MIN({c}) AS DOUBLE) AS low, CAST(MAX({c}) AS DOUBLE) AS high, CAST(COUNT({c}) AS BIGINT) AS in_buckets')
    + " UNION ALL " + _profile_sql("lineitem", ["l_returnflag", "l_linestatus"], lambda c: f"COUNT(*), CAST(COUNT_IF({c} IS NULL) AS BIGINT), NULL, NULL, 0")
    + " UNION ALL " + _profile_sql("lineitem", ["l_shipdate"], lambda c: f"COUNT(*), CAST(COUNT_IF({c} IS NULL) AS BIGINT), CAST(epoch(MIN({c})) AS DOUBLE), CAST(epoch(MAX({c})) AS DOUBLE), CAST(COUNT({c}) AS BIGINT)")
)
def dp_result(spark: SparkSession, folder: str) -> DataFrame:
    """The whole profile of all columns of lineitem; what is not a sketch's estimate is held against SQL."""
    got = profile(table(spark, folder, "lineitem")).columns()
    return got.select(
        "name", "count", "count_nulls", F.col("min").try_cast("double").alias("low"), F.col("max").try_cast("double").alias("high"), F.aggregate("pmf", F.lit(0).cast("bigint"), lambda s, b: s + b["count"]).alias("in_buckets")
    )


_FEW = ["l_returnflag", "l_linestatus", "l_linenumber", "l_discount"]


@query(_profile_sql("lineitem", _FEW, lambda c: f"COUNT(DISTINCT {c}) AS count_unique, 'true' AS is_exact"))
def dp_distincts(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct values, exact where the list of items holds all."""
    got = profile(table(spark, folder, "lineitem").select(*_FEW)).columns()
    return got.select("name", "count_unique", F.try_element_at("extras", F.lit("is_exact")).alias("is_exact"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, '{q:g}' AS share, CAST(quantile_disc({c}, {q}) AS DOUBLE) AS value FROM nation" for c in ("n_nationkey", "n_regionkey") for q in (0.05, 0.25, 0.5, 0.75, 0.95)))
def dp_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles from a sketch that holds all values."""
    got = profile(table(spark, folder, "nation").select("n_nationkey", "n_regionkey")).columns()
    quantiles = F.from_json(F.try_element_at("extras", F.lit("quantiles")), "map<string,string>")
    return got.select("name", F.explode(quantiles).alias("share", "value")).select("name", "share", F.col("value").cast("double").alias("value"))


@query(
    "SELECT 'words' AS name, CAST(COUNT_IF(p_partkey % 5 = 0) AS BIGINT) AS count_empty, CAST(0 AS BIGINT) AS count_nulls, CAST(MAX(CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE len(string_split(p_type, ' ')) END) AS BIGINT) AS max_length FROM part "
    "UNION ALL SELECT 'by_brand', 0, CAST(COUNT_IF(p_size < 10) AS BIGINT), 1 FROM part UNION ALL SELECT 'bytes', 0, 0, CAST(MAX(length(p_name)) AS BIGINT) FROM part UNION ALL SELECT 'nested', NULL, CAST(COUNT_IF(p_size >= 40) AS BIGINT), NULL FROM part"
)
def dp_sized(spark: SparkSession, folder: str) -> DataFrame:
    """Arrays, maps, bytes and structs."""
    rows = table(spark, folder, "part").select(
        F.when(F.col("p_partkey") % 5 == 0, F.array().cast("array<string>")).otherwise(F.split("p_type", " ")).alias("words"), F.when(F.col("p_size") >= 10, F.create_map("p_brand", "p_size")).alias("by_brand"),
        F.encode("p_name", "UTF-8").alias("bytes"), F.when(F.col("p_size") < 40, F.struct("p_size", "p_type")).alias("nested"),
    )
    return profile(rows).columns().select("name", "count_empty", "count_nulls", "max_length")


@query("SELECT 'o_orderkey' AS name, TRUE AS no_distincts, TRUE AS no_items, TRUE AS no_buckets, COUNT(*) AS \"count\" FROM orders")
def dp_turned_off(spark: SparkSession, folder: str) -> DataFrame:
    """Only counts, without any sketch."""
    got = profile(table(spark, folder, "orders").select("o_orderkey"), ProfileConfig(items=0, count_distincts=False, quantiles=False)).columns()
    return got.select("name", F.isnull("count_unique").alias("no_distincts"), (F.size("items") == 0).alias("no_items"), (F.size("pmf") == 0).alias("no_buckets"), "count")


@query('SELECT c AS name, COUNT(*) AS "count", TRUE AS no_min, TRUE AS no_items, MAX(len) AS max_length FROM (SELECT unnest([\'p_name\', \'p_type\']) AS c, unnest([length(p_name), length(p_type)]) AS len FROM part) GROUP BY 1')
def dp_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Two parts of the profile by name, nothing else."""
    got = profile(table(spark, folder, "part").select("p_name", "p_type"), ProfileConfig(only=frozenset({Profiler.COUNT, Profiler.MAX_LENGTH}))).columns()
    return got.select("name", "count", F.isnull("min").alias("no_min"), F.isnull("items").alias("no_items"), "max_length")


@query(
    "WITH t AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN '  ' ELSE ' ' || CAST(o_orderkey AS VARCHAR) END AS v FROM orders) SELECT 'v' AS name, 'long' AS data_type, CAST(COUNT_IF(trim(v) = '') AS BIGINT) AS count_empty, "
    "CAST(COUNT_IF(v IS NULL) AS BIGINT) AS count_nulls, CAST(MAX(length(v)) AS BIGINT) AS max_length, CAST(MIN(CAST(NULLIF(trim(v), '') AS BIGINT)) AS VARCHAR) AS min, CAST(MAX(CAST(NULLIF(trim(v), '') AS BIGINT)) AS VARCHAR) AS max FROM t"
)
def dp_combined(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that are numbers: the profile of both, blanks count as empty."""
    v = F.when(F.col("o_orderkey") % 10 == 0, None).when(F.col("o_orderkey") % 10 == 1, "  ").otherwise(F.concat(F.lit(" "), "o_orderkey"))
    got = profile(table(spark, folder, "orders").select(v.alias("v")), ProfileConfig(infer_types_from_strings=True)).columns()
    return got.select("name", "data_type", "count_empty", "count_nulls", "max_length", "min", "max")


@query("SELECT o_orderkey AS key, CAST(o_orderdate AS DATE) AS day, o_totalprice AS price FROM orders")
def dp_schema(spark: SparkSession, folder: str) -> DataFrame:
    """Texts brought into the schema that their profile gives."""
    from plumbrook.operators.profile import schema_of

    orders = table(spark, folder, "orders")
    texts = orders.select(F.col("o_orderkey").cast("string").alias("key"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("day"), F.col("o_totalprice").cast("string").alias("price"))
    return rs.reshape(texts, schema_of(profile(texts, ProfileConfig(infer_types_from_strings=True, items=0, quantiles=False, count_distincts=False)).columns().collect()))  # a row per column


@query(
    'SELECT \'o_orderkey\' AS name, COUNT(*) AS "count", CAST(0 AS BIGINT) AS count_nulls FROM orders UNION ALL SELECT \'money\', COUNT(*), CAST(COUNT_IF(o_totalprice < 1000) AS BIGINT) FROM orders '
    "UNION ALL SELECT 'money.price', COUNT(*), CAST(COUNT_IF(o_totalprice < 1000) AS BIGINT) FROM orders UNION ALL SELECT 'money.status', COUNT(*), CAST(COUNT_IF(o_totalprice < 1000) AS BIGINT) FROM orders"
)
def dp_legacy(spark: SparkSession, folder: str) -> DataFrame:
    """The profile that goes into structs."""
    from plumbrook.operators.profile import legacy_profile

    money = F.when(F.col("o_totalprice") >= 1000, F.struct(F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status")))
    return legacy_profile(table(spark, folder, "orders").select("o_orderkey", money.alias("money")), ProfileConfig(items=0, quantiles=False)).select("name", "count", "count_nulls")


@query("SELECT 'timestamp' AS data_type, CAST(epoch(MIN(date_trunc('second', ts))) AS BIGINT) - 9 * 3600 AS first, CAST(epoch(MAX(date_trunc('second', ts))) AS BIGINT) - 9 * 3600 AS last FROM events")
def dp_time_zone(spark: SparkSession, folder: str) -> DataFrame:
    """Moments written in the clock of a zone."""
    texts = table(spark, folder, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("t"))
    got = profile(texts, ProfileConfig(infer_types_from_strings=True, inference=TypeInference(time_zone="Asia/Tokyo"), items=0, quantiles=False)).columns()
    return got.select("data_type", F.col("min").cast("bigint").alias("first"), F.col("max").cast("bigint").alias("last"))


@query("SELECT l_returnflag, CAST(l_linenumber AS VARCHAR) AS item, COUNT(*) AS \"count\" FROM lineitem GROUP BY 1, 2 QUALIFY ROW_NUMBER() OVER (PARTITION BY l_returnflag ORDER BY COUNT(*) DESC, item) <= 3")
def dp_frequent_items(spark: SparkSession, folder: str) -> DataFrame:
    """The sketch aggregate per group, exact while all values fit."""
    got = table(spark, folder, "lineitem").groupBy("l_returnflag").agg(sketches.frequent_items(F.col("l_linenumber"), 3).alias("top"))
    return got.select("l_returnflag", F.inline("top"))


@query(" UNION ALL ".join(f"SELECT CAST(quantile_disc(n_nationkey, {b} / 4.0) AS DOUBLE) AS low, CAST(quantile_disc(n_nationkey, {b + 1} / 4.0) AS DOUBLE) AS high FROM nation" for b in range(4)))
def dp_quantile_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """The histogram aggregate, exact while the sketch holds all values."""
    return table(spark, folder, "nation").agg(sketches.quantile_histogram(F.col("n_nationkey"), 4).alias("h")).select(F.inline("h"))


_TEXTS = {"whole": "CAST(o_orderkey AS VARCHAR)", "part": "CAST(o_totalprice AS VARCHAR)", "day": "strftime(o_orderdate, '%d.%m.%Y')", "word": "CASE WHEN o_orderstatus = 'F' THEN ' no' ELSE 'YES' END", "free": "o_orderpriority"}


_INFERRED = "CASE WHEN COUNT_IF(NOT regexp_full_match(v, '[+-]?[0-9]+')) = 0 THEN 'long' WHEN COUNT_IF(TRY_CAST(v AS DOUBLE) IS NULL) = 0 THEN 'double' WHEN COUNT_IF(TRY_STRPTIME(v, '%d.%m.%Y') IS NULL) = 0 THEN 'date' WHEN COUNT_IF(upper(trim(v)) NOT IN ('NO', 'YES')) = 0 THEN 'boolean' ELSE 'string' END"


@query("SELECT name, data_type, CASE WHEN data_type = 'date' THEN 'dd.MM.yyyy' END AS format FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS name, {_INFERRED} AS data_type FROM (SELECT {e} AS v FROM orders)" for n, e in _TEXTS.items()) + ")")
def dp_infer_types(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    texts = orders.select(
        F.col("o_orderkey").cast("string").alias("whole"), F.col("o_totalprice").cast("string").alias("part"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("day"),
        F.when(F.col("o_orderstatus") == "F", " no").otherwise("YES").alias("word"), F.col("o_orderpriority").alias("free"),
    )
    got = profile(texts, ProfileConfig(infer_types_from_strings=True, inference=TypeInference(), items=10)).columns()
    return got.select("name", "data_type", "format")


# Summaries, SQL files, metrics, codes

_AGG = "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY l_returnflag, l_linestatus"


@query(_AGG)
def aggsum_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the summary's JSON text, read again."""
    table(spark, folder, "lineitem").createOrReplaceTempView("aggsum_lineitem")
    one = AggSummary.from_sql(spark, _AGG.replace("FROM lineitem", "FROM aggsum_lineitem"), limit=None).result()
    return one.select(F.inline(F.from_json("data_json", "array<struct<l_returnflag:string,l_linestatus:string,n:bigint,total:bigint>>")))


@query("SELECT 'l_returnflag,l_linestatus' AS keys, 'n,total' AS measures, 'aggsum_lineitem' AS tables, COUNT(DISTINCT l_returnflag || l_linestatus) AS \"rows\", SUM(CAST(l_linenumber AS DOUBLE)) AS total FROM lineitem")
def aggsum_info(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "lineitem").createOrReplaceTempView("aggsum_lineitem")
    one = AggSummary.from_sql(spark, _AGG.replace("FROM lineitem", "FROM aggsum_lineitem"), limit=None).result()
    joined = lambda c: F.concat_ws(",", f"aggsum_info.{c}")
    rows = F.from_json("data_json", "array<struct<total:double>>")
    return one.select(
        joined("key_column_names").alias("keys"), joined("value_column_names").alias("measures"), joined("referenced_table_names").alias("tables"), F.size(rows).cast("bigint").alias("rows"),
        F.aggregate(rows, F.lit(0.0), lambda s, r: s + r["total"]).alias("total"),
    )


@query("SELECT 'n_nationkey,n_name' AS keys, 'n_regionkey' AS measures, COUNT(*) AS \"rows\" FROM nation")
def aggsum_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that are named, of a table that is no aggregate."""
    one = AggSummary.from_df(table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey"), keys=["n_nationkey", "n_name"], limit=None).result()
    joined = lambda c: F.concat_ws(",", f"aggsum_info.{c}")
    return one.select(joined("key_column_names").alias("keys"), joined("value_column_names").alias("measures"), F.size(F.from_json("data_json", "array<map<string,string>>")).cast("bigint").alias("rows"))


@query(
    "WITH g AS (SELECT o_orderstatus AS s, COUNT(*) AS n, MAX(o_totalprice) AS m FROM orders GROUP BY 1) SELECT 'orders' AS key, CAST(n AS DOUBLE) AS value, s AS status, 'bar' AS foo FROM g UNION ALL SELECT 'most', m, s, 'bar' FROM g"
)
def metrics_long(spark: SparkSession, folder: str) -> DataFrame:
    sql = "SELECT MAP('status', o_orderstatus) AS __labels__, 1 AS __hidden__, COUNT(*) AS orders, MAX(o_totalprice) AS most FROM metric_orders GROUP BY o_orderstatus;"
    got = run_sql_metrics(spark, sql, {"metric_orders": table(spark, folder, "orders")}, labels={"foo": "bar", "status": "overridden"})
    return got.select("key", "value", F.try_element_at("labels", F.lit("status")).alias("status"), F.try_element_at("labels", F.lit("foo")).alias("foo"))


@dataclasses.dataclass
class LateParams:
    """Parameters of the SQL text below."""

    least_quantity: int
    flag: str


LATE_LINES = """
-- large lines of one flag; nothing else
CREATE OR REPLACE TEMPORARY VIEW late_large AS SELECT l_orderkey, l_quantity FROM late_lines WHERE l_quantity >= ${least_quantity} AND l_returnflag = '${flag}';
/* a statement with a semicolon in a literal; */
CREATE OR REPLACE TEMPORARY VIEW late_named AS SELECT c_custkey, concat(c_mktsegment, ';') AS segment FROM late_customers;
SELECT segment, COUNT(*) AS lines, CAST(SUM(l_quantity) AS STRING) AS quantity
FROM late_large JOIN late_orders ON l_orderkey = o_orderkey JOIN late_named ON o_custkey = c_custkey GROUP BY segment;
-- COMMAND ----------
SELECT * FROM what_is_below_is_not_run;
"""


@query("SELECT c_mktsegment || ';' AS segment, COUNT(*) AS lines, SUM(CAST(l_quantity AS DOUBLE)) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity >= 30 AND l_returnflag = 'R' GROUP BY 1")
def sql_runner(spark: SparkSession, folder: str) -> DataFrame:
    """A text of several statements with parameters over named tables, its result reshaped."""
    tables = {f"late_{n}": table(spark, folder, t) for n, t in (("lines", "lineitem"), ("orders", "orders"), ("customers", "customer"))}
    return run_sql(spark, LATE_LINES, tables, LateParams(30, "R"), T.StructType.fromDDL("segment string, lines bigint, quantity double"))


@query("SELECT p_size, array_to_string(list_sort(list_distinct(list_concat(list(p_brand), list(split_part(p_type, ' ', 1)) FILTER (split_part(p_type, ' ', 1) <> '')))), ',') AS codes FROM part GROUP BY p_size")
def collect_codes_query(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select("p_size", "p_brand", F.array(F.split("p_type", " ")[0], F.lit(""), F.lit(None)).alias("others"))
    return part.groupBy("p_size").agg(F.array_join(collect_codes(part.schema, "p_brand", "others"), ",").alias("codes"))


@query("SELECT p_size, array_to_string(list_sort(list_distinct(list_concat(list(p_brand), list(split_part(p_type, ' ', 2)) FILTER (split_part(p_type, ' ', 2) <> '')))), ',') AS codes FROM part GROUP BY p_size")
def codes_in_sql(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of two columns per group by the SQL function."""
    register_codes(spark)
    table(spark, folder, "part").createOrReplaceTempView("codes_part")
    return spark.sql("SELECT p_size, array_join(cleanup_codes(flatten(collect_set(array(p_brand, '', NULL, coalesce(get(split(p_type, ' '), 1), ''))))), ',') AS codes FROM codes_part GROUP BY p_size")


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_type, ' '))), ',') AS codes FROM part")
def cleanup_codes_query(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", F.array_join(cleanup_codes(F.concat(F.split("p_type", " "), F.array(F.lit("")))), ",").alias("codes"))


@query(
    "SELECT r_name, n_name, customers, CAST(place AS INTEGER) AS place FROM (SELECT r_name, n_name, COUNT(*) AS customers, ROW_NUMBER() OVER (PARTITION BY r_name ORDER BY COUNT(*) DESC, n_name) AS place "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2) WHERE place <= 3"
)
def top_regions(spark: SparkSession, folder: str) -> DataFrame:
    sql = """SELECT * FROM (SELECT r_name, n_name, COUNT(*) AS customers, ROW_NUMBER() OVER (PARTITION BY r_name ORDER BY COUNT(*) DESC, n_name) AS place
FROM top_customer JOIN top_nation ON c_nationkey = n_nationkey JOIN top_region ON n_regionkey = r_regionkey GROUP BY r_name, n_name) WHERE place <= 3"""
    return run_sql(spark, sql, {f"top_{n}": table(spark, folder, n) for n in ("customer", "nation", "region")})


@query(
    "WITH e AS (SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n FROM events GROUP BY 1), d AS (SELECT CAST(unnest(generate_series((SELECT MIN(day) FROM e), (SELECT MAX(day) FROM e), INTERVAL 1 DAY)) AS DATE) AS day) "
    "SELECT d.day, COALESCE(n, 0) AS n FROM d LEFT JOIN e ON d.day = e.day"
)
def calendar_fill(spark: SparkSession, folder: str) -> DataFrame:
    sql = """WITH e AS (SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n FROM fill_events GROUP BY 1),
d AS (SELECT EXPLODE(SEQUENCE(MIN(day), MAX(day), INTERVAL 1 DAY)) AS day FROM e)
SELECT d.day, COALESCE(n, 0) AS n FROM d LEFT JOIN e ON d.day = e.day"""
    return run_sql(spark, sql, {"fill_events": table(spark, folder, "events")})


# Sinks, read again

_LABELS = "SELECT 'nation_' || CAST(n_nationkey AS VARCHAR) || '.txt' AS name, n_name AS content FROM nation"


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(F.concat(F.lit("by_region/"), "n_regionkey", F.lit("/nation_"), "n_nationkey", F.lit(".txt")).alias("path"), F.col("n_name").alias("content"))


@query(_LABELS)
def file_per_row_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    from plumbrook.sources.file_sinks import write_files

    out = shared_folder(spark, "files")
    write_files(_files(spark, folder), out)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(out)
    return read.select(F.substring_index("path", "/", -1).alias("name"), F.col("content").cast("string").alias("content"))


@query("SELECT 'nations.zip' AS name, 'by_region/' || CAST(n_regionkey AS VARCHAR) || '/nation_' || CAST(n_nationkey AS VARCHAR) || '.txt' AS entry, n_name AS content FROM nation")
def zip_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    from plumbrook.sources.file_sinks import write_files

    out = shared_folder(spark, "zip")
    write_files(_files(spark, folder).coalesce(1), out, "zip", zip_file_name="nations.zip", zip_method="STORED")
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(out)
    return read.select(F.substring_index("path", "/", -1).alias("name"), "content").mapInPandas(_zip_entries, "name string, entry string, content string")


def _zip_entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import io
    import zipfile

    for frame in frames:
        rows = []
        for name, content in zip(frame["name"], frame["content"], strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                rows += [(name, n, z.read(n).decode()) for n in z.namelist()]
        yield pd.DataFrame(rows, columns=["name", "entry", "content"])


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def jdbc_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Loaded into an in-memory database and read again."""
    import uuid

    from plumbrook.sources import jdbc
    from plumbrook.sources.paths import TableName

    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    loader = jdbc.JdbcLoader(jdbc.JdbcConfig(url, driver="org.apache.derby.jdbc.EmbeddedDriver", schema_name="data_${timestamp}"), [JdbcNation])
    connection = loader.connect(spark)
    try:
        loader.run_sql(connection, f"CREATE SCHEMA {loader.schema}")
        rows = table(spark, folder, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
        loader.write_table(rows, JdbcNation, TableName.of(JdbcNation), connection)
    finally:
        connection.close()
    read = jdbc.read_table(spark, url, jdbc.qualified_name(TableName.of(JdbcNation), loader.schema), {"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    return read.select(F.col("id").alias("id"), F.col("name").alias("name"))


def _jdbc_entity() -> type:
    from plumbrook.sources import jdbc

    @jdbc.entity
    @dataclasses.dataclass
    class JdbcNation:
        id: jdbc.Int32 = jdbc.column(id=True)
        name: str = jdbc.column(nullable=False, length=40)

    JdbcNation.__annotations__ = {"id": jdbc.Int32, "name": str}
    return JdbcNation


JdbcNation = _jdbc_entity()
