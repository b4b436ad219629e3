"""Helpers for tests and examples of jobs: a local session, temporary tables of which the newest versions are kept, rows as text."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame, SparkSession

from plumbrook.sources.files import Files

#: Versions of a test's temporary folder that are kept.
KEPT = 10


def local_session(cores: str = "1", **options: str) -> SparkSession:
    """A session on this machine with as many shuffle partitions as cores (one for `*`), in UTC, without a page."""
    plain = {"spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": cores if cores.isdigit() else "1"}
    return SparkSession.builder.master(f"local[{cores}]").config(map=plain | {k.replace("__", "."): v for k, v in options.items()}).getOrCreate()


class TemporaryTables:
    """Tables of one test in a new version of its folder; versions older than the last KEPT are deleted.

    base is a path of any file system; where executors are on other machines it has to be one they share.
    """

    def __init__(self, spark: SparkSession, base: str, name: str):
        self.spark, self.files, own = spark, Files(spark), f"{base}/{name}"
        found = self.files.children(own) if self.files.exists(own) else []
        versions = sorted(int(s.name) for s in found if s.name.isdigit())
        self.folder = f"{own}/{versions[-1] + 1 if versions else 0}"
        self.files.make_directories(self.folder)
        for old in versions[: max(0, len(versions) + 1 - KEPT)]:
            self.files.delete(f"{own}/{old}")

    def write(self, df: DataFrame, name: str, format: str = "parquet", **options: str) -> str:
        path = f"{self.folder}/{name}"
        df.write.format(format).options(**options).save(path)
        return path

    def read(self, name: str, format: str = "parquet", **options: str) -> DataFrame:
        return self.spark.read.format(format).options(**options).load(f"{self.folder}/{name}")


def day(text: str) -> datetime.date:
    return datetime.date.fromisoformat(text)


def shown(df: DataFrame, rows: int = 20) -> str:
    """The first rows as lines of JSON, for examples."""
    return "\n".join(json.dumps(json.loads(line), sort_keys=True) for line in df.toJSON().take(rows))
