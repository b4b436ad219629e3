"""Named input tables, written outputs, and the lineage lists that connect runs."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from plumbrook.errors import PlumbrookError
from plumbrook.operators import reshape as rs
from plumbrook.plans.introspect import alias_of
from plumbrook.sources.files import Files
from plumbrook.sources.paths import DAG_DIR, DagInfo, PathResolver, TableInfo, TableName


@dataclass(frozen=True)
class TableIOConfig:
    input_paths: tuple[str, ...] = ()
    input_reshape: rs.ReshapeConfig = field(default_factory=lambda: replace(rs.DEFAULT, fill_missing_nulls=True))
    register_input_tables: bool = False
    output_path: str | None = None
    write_format: str | None = "parquet"
    write_mode: str | None = "overwrite"
    write_options: Mapping[str, str] = field(default_factory=dict)


_counter = itertools.count()


def name_of(df: DataFrame) -> TableName:
    """The name a DataFrame goes by: its alias, else a hash of its schema with a counter."""
    if alias := alias_of(df):
        return TableName.parse(alias)
    return TableName(None, f"{hashlib.sha256(df.schema.json().encode()).hexdigest()[:7]}__{next(_counter)}")


def reader_of(spark: SparkSession, info: TableInfo):
    """A reader with the table's format (the session's default without one) and options."""
    reader = spark.read.format(info.format) if info.format else spark.read
    return reader.options(**{k: v for k, v in info.options})


def reshape_overrides(config: rs.ReshapeConfig, given: Sequence[tuple[str, str]]) -> rs.ReshapeConfig:
    """A reshape configuration with fields set from option texts."""
    names = {f.name: getattr(config, f.name) for f in fields(config)}
    aliases = {"field_matching_strategy": "matching", "conflict_resolution": "conflicts", "sort_order": "order"}
    changes: dict[str, object] = {}
    for key, text in given:
        name = aliases.get(key, key)
        if name not in names:
            raise PlumbrookError(f"unknown reshape option {key}")
        changes[name] = text.lower() == "true" if isinstance(names[name], bool) else text.lower().removeprefix("name_") if name in ("matching", "conflicts", "order") else text
    return replace(config, **changes)


class TableIO:
    """Context manager over inputs and outputs; lineage is written when it closes."""

    def __init__(self, spark: SparkSession, config: TableIOConfig = TableIOConfig()):
        self.spark, self.config, self.files = spark, config, Files(spark)
        self.resolver = PathResolver(self.files)
        self._tables: dict[str, TableInfo] = {}
        self._frames: dict[str, DataFrame] = {}
        self._dags: list[DagInfo] = []
        self._outputs: dict[str, TableInfo] = {}
        for path in config.input_paths:
            self.add_input_path(path)

    def add_input_path(self, url: str) -> None:
        for info in self.resolver.resolve(url):
            if isinstance(info, DagInfo):
                if info not in self._dags:
                    self._dags.append(info)
                continue
            known = self._tables.get(info.table_name)
            if known is not None and known != info:
                raise PlumbrookError(f"resolved conflicting tables named {info.table_name}: {known.url()} and {info.url()}")
            self._tables[info.table_name] = info
            if known is None and self.config.register_input_tables:
                self._register(info.table_name)

    def _register(self, name: str) -> None:
        if not self.spark.catalog.tableExists(name):
            self.df(name).createOrReplaceTempView(name)

    def input_table(self, name: str) -> TableInfo | None:
        return self._tables.get(name)

    def input_table_names(self) -> list[str]:
        return sorted(self._tables)

    def df(self, name: str | TableName) -> DataFrame:
        """The table as stored, with its name as alias; planned once."""
        full = name.full() if isinstance(name, TableName) else name
        if full not in self._frames:
            if full not in self._tables:
                raise PlumbrookError(f"there is no input table {full}")
            info = self._tables[full]
            self._frames[full] = reader_of(self.spark, info).load(info.path).alias(full)
        return self._frames[full]

    def typed(self, name: str | TableName, schema: T.StructType) -> DataFrame:
        """The table in the given schema, reshaped as configured and as its path says."""
        full = name.full() if isinstance(name, TableName) else name
        stored = self.df(full)
        config = reshape_overrides(self.config.input_reshape, self._tables[full].reshape)
        return rs.reshape(stored, schema, config).alias(full)

    def write(self, df: DataFrame, name: str | TableName, format: str | None = None, mode: str | None = None, options: Mapping[str, str] | None = None) -> None:
        """Write below output_path; a name can be written once."""
        full = name.full() if isinstance(name, TableName) else name
        if self.config.output_path is None:
            raise PlumbrookError("no output path is configured")
        if full in self._outputs:
            raise PlumbrookError(f"writing table {full} a second time")
        kind = format or self.config.write_format
        path = f"{self.config.output_path}/{full}"
        writer = df.write.options(**{**self.config.write_options, **(options or {})})
        if kind:
            writer = writer.format(kind)
        if mode or self.config.write_mode:
            writer = writer.mode(mode or self.config.write_mode)
        self._outputs[full] = TableInfo(path, full, kind)
        writer.save(path)

    def write_pointer(self, path: str) -> None:
        """A list file that points to this run's output."""
        self.files.write_text(path, DagInfo(str(self.config.output_path)).url() + "\n")

    def close(self) -> None:
        if self.config.output_path is None:
            return
        base = f"{self.config.output_path}/{DAG_DIR}"
        lists = {
            "input_paths": self.config.input_paths, "input_dags": [d.url() for d in self._dags],
            "input_tables": [t.url() for t in self._tables.values()], "output_tables": [t.url() for t in self._outputs.values()],
        }
        for name, lines in lists.items():
            self.files.write_text(f"{base}/{name}.list", "\n".join(lines))

    def __enter__(self) -> TableIO:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
