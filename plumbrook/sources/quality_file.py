"""One file as a table under quality: read permissively, with a rule for records that can't be read."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbrook.errors import PlumbrookError
from plumbrook.operators.quality_rules import Rule
from plumbrook.sources.files import Files
from plumbrook.sources.paths import PathResolver, TableInfo
from plumbrook.sources.table_io import reader_of

CORRUPT_COLUMN = "__corrupt_record__"
NOT_CORRUPTED = "__record_not_corrupted"
#: Formats whose reader keeps records it can't read.
PERMISSIVE = ("csv", "json", "xml")


def open_file(spark: SparkSession, url: str) -> tuple[DataFrame, list[Rule], dict[str, str]]:
    """The table, its rules, and metadata: input_path, path, file_name, size, modification_timestamp, table_name."""
    files = Files(spark)
    found = [i for i in PathResolver(files).resolve(url) if isinstance(i, TableInfo)]
    if len(found) != 1:
        raise PlumbrookError(f"{url} stands for {len(found)} tables; one file is required")
    info = found[0]
    status = files.status(info.path)
    reader = reader_of(spark, info)
    rules: list[Rule] = []
    schema = reader.load(info.path).schema
    if info.format in PERMISSIVE:
        # Without pruning a record is judged as a whole, whatever columns a query reads.
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT_COLUMN).option("columnPruning", "false")
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT_COLUMN, T.StringType())])
        rules.append(Rule(NOT_CORRUPTED, f"{CORRUPT_COLUMN} IS NULL", "Record is not corrupted", (CORRUPT_COLUMN,)))
        reader = reader.schema(schema)
    modified = datetime.datetime.fromtimestamp(status.modified_ms / 1000, datetime.UTC).isoformat().replace("+00:00", "Z")
    metadata = {"input_path": url, "path": info.path, "file_name": status.name, "size": str(status.size), "modification_timestamp": modified, "table_name": info.table_name or ""}
    df = reader.load(info.path)
    if rules and len(schema.fields) > 1:
        # Spark refuses to read the corrupt column alone; the element keeps a second column in every query.
        both = F.array(F.col(CORRUPT_COLUMN), F.col(f"`{schema.fields[0].name}`").cast("string"))
        df = df.withColumn(CORRUPT_COLUMN, F.try_element_at(both, F.lit(1)))
    return df, rules, metadata
