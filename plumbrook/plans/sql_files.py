"""SQL files with parameters over named tables, and metrics in long form."""

from __future__ import annotations

import re
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbrook.errors import PlumbrookError
from plumbrook.functions.text import replace_params, split_statements
from plumbrook.operators.reshape import DEFAULT, ReshapeConfig, reshape

#: Ends the part of a notebook file that is run.
NEXT_CELL = "-- COMMAND --"
SPECIAL = re.compile(r"__.*__")
LABELS = "__labels__"
METRIC = "key string, value double, labels map<string,string>"


def statements(text: str) -> list[str]:
    return split_statements(text.partition(NEXT_CELL)[0])


def run_sql(spark: SparkSession, sql: str | Path, tables: Mapping[str, DataFrame], params: Any = None, schema: T.StructType | None = None, config: ReshapeConfig = DEFAULT) -> DataFrame:
    """Runs all statements over the tables (as views for that time) and returns the last one's result, reshaped if asked."""
    text = sql.read_text() if isinstance(sql, Path) else sql
    before = {t.name for t in spark.catalog.listTables() if t.isTemporary}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    try:
        out: DataFrame | None = None
        for statement in statements(replace_params(text, params)):
            out = spark.sql(statement)
        if out is None:
            raise PlumbrookError("the SQL holds no statement")
    finally:
        for name in {t.name for t in spark.catalog.listTables() if t.isTemporary} - before | set(tables):
            spark.catalog.dropTempView(name)
    return out if schema is None else reshape(out, schema, config)


def run_sql_metrics(spark: SparkSession, sql: str | Path, tables: Mapping[str, DataFrame], params: Any = None, labels: Mapping[str, str] | None = None, class_name: str | None = None) -> DataFrame:
    """Each column of the result as rows key, value, labels; a map column __labels__ is added to the labels.

    Of equal labels the row's win over the given ones. Other columns named __x__ are left out.
    """
    wide = run_sql(spark, sql, tables, params)
    given = ({"class_name": class_name} if class_name else {}) | dict(labels or {})
    base = F.create_map(*(F.lit(x) for kv in given.items() for x in kv)) if given else F.create_map().cast("map<string,string>")
    own = F.coalesce(F.col(LABELS).cast("map<string,string>"), F.create_map().cast("map<string,string>")) if LABELS in wide.columns else F.create_map().cast("map<string,string>")
    merged = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k)), own)
    names = [c for c in wide.columns if not SPECIAL.fullmatch(c)]
    if not names:
        return spark.createDataFrame([], METRIC)
    rows = F.array(*(F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("double").alias("value")) for c in names))
    return wide.select(F.explode(rows).alias("m"), merged.alias("labels")).select("m.key", "m.value", "labels")
