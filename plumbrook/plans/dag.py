"""Runs of a DAG of tables: inputs override results, results are written or cached, metrics and lineage kept."""

from __future__ import annotations

import dataclasses
import datetime
import importlib
import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbrook.errors import PlumbrookError
from plumbrook.plans.config import Configuration
from plumbrook.plans.sql_files import METRIC
from plumbrook.sources.paths import TableName
from plumbrook.sources.table_io import TableIO, TableIOConfig, name_of

log = logging.getLogger(__name__)


@dataclass
class SparkConfig:
    app_name: str | None = None
    master: str | None = None
    spark_options: dict[str, str] = field(default_factory=dict)


def create_session(config: SparkConfig) -> SparkSession:
    builder = SparkSession.builder.config(map=config.spark_options)
    if config.app_name:
        builder = builder.appName(config.app_name)
    return (builder.master(config.master) if config.master else builder).getOrCreate()


@dataclass
class DagRunnerConfig:
    main_dag: str | None = None
    run_timestamp: datetime.datetime | None = None
    compute_collections: list[str] = field(default_factory=list)
    shared_output_path: str | None = None
    disable_caching: bool = False
    debug: bool = False


@dataclass
class IOSettings:
    """The part of TableIOConfig that is configured as text."""

    input_paths: list[str] = field(default_factory=list)
    register_input_tables: bool = False
    output_path: str | None = None
    write_format: str | None = "parquet"
    write_mode: str | None = "overwrite"
    write_options: dict[str, str] = field(default_factory=dict)


class DagRunner:
    """What a dag's code uses: read, wrap, metrics."""

    def __init__(self, io: TableIO, config: DagRunnerConfig = DagRunnerConfig()):
        self.io, self.config = io, config
        self._metrics: list[DataFrame] = []
        self._cached: list[DataFrame] = []

    def read(self, name: str | TableName, schema: T.StructType | None = None) -> DataFrame:
        return self.io.typed(name, schema) if schema is not None else self.io.df(name)

    def wrap(self, df: DataFrame, name: str | TableName | None = None, schema: T.StructType | None = None) -> DataFrame:
        """A result at its place in the DAG: the input of that name instead, if there is one; written if asked for; cached."""
        own = name if isinstance(name, TableName) else TableName.parse(name) if name else name_of(df)
        full = own.full()
        if self.io.input_table(full) is not None:
            df = self.read(full, schema)
        elif self.config.debug or full in self.config.compute_collections:
            self.io.write(df, full)
        if not self.config.disable_caching:
            df = df.cache()
            self._cached.append(df)
        return df.alias(full)

    def metrics(self, metrics: DataFrame) -> None:
        """Rows key, value, labels, written when the run ends."""
        self._metrics.append(metrics.select("key", "value", "labels"))

    def run(self, dag: Callable[[], object]) -> None:
        """The dag, then all metrics as table `metric`, also if the dag failed."""
        try:
            dag()
        finally:
            spark = self.io.spark
            every = spark.createDataFrame([], METRIC)
            for m in self._metrics:
                every = every.unionByName(m)
            if self.io.config.output_path is not None:
                self.io.write(every, "metric")
            self._share(every)
            for df in self._cached:
                df.unpersist()

    def _share(self, metrics: DataFrame) -> None:
        """Appends to the shared metrics, as Delta where that is installed, else as Parquet; points to this run."""
        shared = self.config.shared_output_path
        if shared is None:
            return
        stamped = metrics.withColumn("run_timestamp", F.lit(self.config.run_timestamp).cast("timestamp"))
        kind = "delta" if has_format(self.io.spark, "delta") else "parquet"
        if kind != "delta":
            log.error("no delta source on the class path: shared metrics are appended as parquet")
        stamped.write.format(kind).mode("append").save(f"{shared}/metric")
        if self.io.config.output_path is not None:
            self.io.write_pointer(f"{shared}/latest.list")


def has_format(spark: SparkSession, name: str) -> bool:
    try:
        spark._jvm.org.apache.spark.sql.execution.datasources.DataSource.lookupDataSource(name, spark._jsparkSession.sessionState().conf())
    except Exception:  # noqa: BLE001
        return False
    return True


def main(args: Sequence[str], folders: Sequence[str] = (), root: str | None = None) -> None:
    """Configures and runs `module:Class` (called with configuration, session, runner; run() is the dag)."""
    configuration = Configuration.of(args, folders, root)
    runner_config = configuration.read(DagRunnerConfig)
    if not runner_config.main_dag:
        raise PlumbrookError("dag_runner_config__main_dag=module:Class is required")
    module, _, name = runner_config.main_dag.partition(":")
    spark = create_session(configuration.read(SparkConfig))
    settings = configuration.read(IOSettings)
    values = {f.name: getattr(settings, f.name) for f in dataclasses.fields(settings)}
    with TableIO(spark, TableIOConfig(**(values | {"input_paths": tuple(settings.input_paths)}))) as io:
        runner = DagRunner(io, runner_config)
        dag = getattr(importlib.import_module(module), name)(configuration, spark, runner)
        runner.run(dag.run)
    spark.catalog.clearCache()


def as_metrics(spark: SparkSession, values: Mapping[str, float], labels: Mapping[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame([(k, float(v), dict(labels or {})) for k, v in values.items()], METRIC)
