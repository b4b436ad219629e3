from pathlib import Path

from plumbrook import testing


def test_temporary_tables_keep_the_newest_versions(spark, tmp_path):
    for k in range(13):
        tables = testing.TemporaryTables(spark, f"file://{tmp_path}", "ships")
    assert sorted(int(p.name) for p in Path(tmp_path, "ships").iterdir()) == list(range(3, 13))
    df = spark.createDataFrame([(testing.day("2021-05-04"), "x")], "d date, s string")
    tables.write(df, "a")
    tables.write(df, "b", "csv", header="true")
    assert tables.read("a").collect() == df.collect() and tables.read("b", "csv", header="true").first().s == "x"
    assert testing.shown(df) == '{"d": "2021-05-04", "s": "x"}' and testing.local_session() is not None
