"""Sources read once and kept as Parquet."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from plumbrook.sources.files import Files


def cached(spark: SparkSession, source: str, folder: str, format: str = "csv", options: Mapping[str, str] | None = None) -> DataFrame:
    """The rows of a source, from a copy in `folder` if there is a complete one; the copy depends on source, format and options."""
    key = hashlib.sha256(repr((source, format, sorted((options or {}).items()))).encode()).hexdigest()[:16]
    copy = f"{folder}/{key}"
    if not Files(spark).exists(f"{copy}/_SUCCESS"):
        spark.read.format(format).options(**(options or {})).load(source).write.mode("overwrite").parquet(copy)
    return spark.read.parquet(copy)
