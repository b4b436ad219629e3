"""Distinct, sorted codes of a group."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbrook.errors import PlumbrookError


def cleanup_codes(codes: Column) -> Column:
    """One array's codes without nulls and empty texts, distinct and in order."""
    return F.array_sort(F.array_distinct(F.filter(codes, lambda c: c.isNotNull() & (c != ""))))


def collect_codes(df_schema: T.StructType, *names: str) -> Column:
    """Aggregate: the codes of all rows of the named string or array<string> columns.

    A set per column is collected, so that what a group holds is bounded by its distinct codes.
    """
    sets = []
    for name in names:
        kind = df_schema[name].dataType
        if isinstance(kind, T.StringType):
            sets.append(F.collect_set(F.when(F.col(name) != "", F.col(name))))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            sets.append(F.flatten(F.collect_set(cleanup_codes(F.coalesce(F.col(name), F.array().cast("array<string>"))))))
        else:
            raise PlumbrookError(f"codes of column {name} of type {kind.simpleString()}: string or array<string> required")
    return cleanup_codes(F.concat(*sets))


def register(spark: SparkSession) -> None:
    """cleanup_codes(codes) in SQL, as a function of SQL expressions.

    collect_codes is cleanup_codes(flatten(collect_set(array(...)))) there: an aggregate can't be made of SQL expressions,
    and one in Python would hold a whole group.
    """
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION cleanup_codes(codes ARRAY<STRING>) RETURNS ARRAY<STRING> RETURN array_sort(array_distinct(filter(codes, c -> length(c) > 0)))")
