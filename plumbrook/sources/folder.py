"""Access to a folder that holds one Parquet file or folder per table, and intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from plumbrook.errors import PlumbrookError

#: Folders of intermediate tables that this process has written, by the session that did.
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of the folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for an intermediate table, in the folder all executors share.

    The cluster names that folder in spark.checkpoint.dir; only where it is unset and all executors are on this machine
    is one set, here.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise PlumbrookError("spark.checkpoint.dir names no folder; executors on other machines need one they share")
        base = f"file://{tempfile.mkdtemp()}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table in the shared folder: a plan that uses them again starts there, and so survives lost executors."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def release() -> int:
    """Delete the intermediate tables written so far, once nothing reads them any more; done at the end of the process too."""
    from plumbrook.sources.files import Files

    deleted = 0
    while _written:
        spark, path = _written.pop()
        if spark.sparkContext._jsc is not None:
            try:
                deleted += Files(spark).delete(path)
            except Exception:  # noqa: BLE001 - the session is gone, or another process deleted the folder
                continue
    return deleted
