"""Queries on executors that are processes of their own."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest
from sql_comparison import FOLDER, of_duckdb

from plumbrook import queries

NAMES = ["jdbc_constraints", "jdbc_load", "jdbc_roundtrip"]


@pytest.fixture(scope="module")
def rows(tmp_path_factory):
    out, here = tmp_path_factory.mktemp("cluster"), Path(__file__).resolve().parent
    home = out / "home"  # the executor's logs go to work in Spark's home
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "PYTHONPATH": f"{here.parent}:{here}"}
    subprocess.run([sys.executable, here / "cluster_queries.py", FOLDER, out, *NAMES], env=env, cwd=out, check=True, timeout=300)
    return json.loads((out / "queries.json").read_text())


@pytest.mark.parametrize("name", NAMES)
def test_rows_are_those_of_the_sql(rows, name):
    columns, expected = of_duckdb(queries.SQL[name])
    assert rows[name] == [columns, [list(r) for r in expected]]
