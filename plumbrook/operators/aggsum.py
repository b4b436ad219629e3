"""Summaries of aggregating queries: which columns are keys and values, and all rows as one JSON text."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbrook.errors import PlumbrookError
from plumbrook.plans import introspect


@dataclass(frozen=True)
class AggSummary:
    """limit: most rows in the JSON text (a summary, not a table); None for all."""

    df: DataFrame
    keys: tuple[str, ...] | None = None
    tables: tuple[str, ...] = ()
    limit: int | None = 10_000

    @classmethod
    def from_df(cls, df: DataFrame, keys: Sequence[str] | None = None, tables: Sequence[str] = (), limit: int | None = 10_000) -> AggSummary:
        return cls(df, tuple(keys) if keys is not None else None, tuple(tables), limit)

    @classmethod
    def from_sql(cls, spark: SparkSession, sql: str, limit: int | None = 10_000) -> AggSummary:
        introspect.assert_query(spark, sql)
        return cls(spark.sql(sql), None, tuple(introspect.referenced_tables(spark, sql)), limit)

    def info(self) -> dict[str, list[str]]:
        """key_column_names, value_column_names, referenced_table_names."""
        found = introspect.top_aggregate(self.df)
        if self.keys is not None:
            keys = list(self.keys)
            values = [c for c in self.df.columns if c not in keys]
        elif found is None:
            raise PlumbrookError("nothing is summed up: the query has neither GROUP BY nor an aggregate function")
        else:
            keys, values = found
        for name in values:
            kind = self.df.schema[name].dataType if name in self.df.columns else None
            if kind is not None and not isinstance(kind, T.NumericType | T.BooleanType | T.DateType | T.TimestampType | T.TimestampNTZType):
                raise PlumbrookError(f"{name} is no value of a summary: {kind.simpleString()} has no size")
        return {"key_column_names": keys, "value_column_names": values, "referenced_table_names": list(self.tables)}

    def rows(self) -> DataFrame:
        return self.df

    def result(self) -> DataFrame:
        """One row: aggsum_info and data_json."""
        info = self.info()
        some = self.df if self.limit is None else self.df.limit(self.limit)
        shown = F.struct(*(F.array(*(F.lit(x) for x in v)).alias(k) if v else F.array().cast("array<string>").alias(k) for k, v in info.items()))
        return some.agg(F.to_json(F.collect_list(F.struct("*"))).alias("data_json")).select(shown.alias("aggsum_info"), "data_json")
