"""Runs queries in a session whose executor is a process of its own: queries.json gets the rows of each, or its error.

python cluster_queries.py FOLDER OUT QUERY...
"""

import json
import sys

from pyspark.sql import SparkSession
from sql_comparison import of_spark

from plumbrook import queries
from plumbrook.plans.ship import ship

if __name__ == "__main__":
    folder, out, *names = sys.argv[1:]
    conf = {"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": f"file://{out}/shared"}
    spark = ship(SparkSession.builder.master("local-cluster[1,2,1024]").config(map=conf).getOrCreate())
    found = {}
    for name in names:
        try:
            found[name] = of_spark(queries.QUERIES[name](spark, folder))
        except Exception as e:  # noqa: BLE001 - the test shows it
            found[name] = str(e)[:2000]
    with open(f"{out}/queries.json", "w") as f:
        json.dump(found, f)
    spark.stop()
