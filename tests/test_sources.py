import dataclasses
import datetime
import decimal
import io
import zipfile
from xml.etree import ElementTree as ET

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbrook.errors import PlumbrookError
from plumbrook.operators import reshape as rs
from plumbrook.plans import config as cf
from plumbrook.plans import dag as dg
from plumbrook.plans.sql_files import run_sql, run_sql_metrics, statements
from plumbrook.sources import jdbc, workbook
from plumbrook.sources.file_sinks import checked_path, register, write_files
from plumbrook.sources.files import Files, using
from plumbrook.sources.paths import DagInfo, PathResolver, TableInfo, TableName, TableNames, parse_path
from plumbrook.sources.table_io import TableIO, TableIOConfig


def test_parse_path():
    assert parse_path("dir/file?p1=v1&p2=&p3=v3&p3").reader == {"p1": "v1", "p2": "", "p3": None}
    got = parse_path("dir?sos-listing_strategy=*~42/@&foo=a%20b")
    assert (got.path, got.own, got.reader) == ("dir", {"listing_strategy": "*~42/@"}, {"foo": "a b"})
    info = TableInfo("dir/a", "a", "csv", (), (("header", "true"), ("x", None)))
    assert info.url() == "dir/a?header=true&sos-format=csv&sos-table_name=a&x" and parse_path(info.url()).own == {"format": "csv", "table_name": "a"}


def test_table_names():
    assert TableName("Foo", "bar").full() == "foo__bar" and TableName.parse("foo__bar") == TableName("foo", "bar") and TableName.parse("__bar") == TableName(None, "bar")

    @dataclasses.dataclass
    class OrderLine:
        id: int

    assert TableNames((OrderLine,)).find("order_line__x") == (OrderLine, TableName("order_line", "x")) and TableNames((OrderLine,)).find("other") is None


def _dag(files, base, name, dags, inputs, outputs):
    files.write_text(f"{base}/{name}/.dag/input_dags.list", "\n".join(f"{base}/{d}?sos-listing_strategy=dag" for d in dags))
    files.write_text(f"{base}/{name}/.dag/input_tables.list", "\n".join(f"{base}/{t}" for t in inputs))
    files.write_text(f"{base}/{name}/.dag/output_tables.list", "# comment\n" + "\n".join(f"{base}/{t}" for t in outputs))


def test_resolver(spark, tmp_path):
    files, base = Files(spark), str(tmp_path)
    _dag(files, base, "aa", ["dag"], [], ["aa/aa"])  # a cycle
    _dag(files, base, "a", ["aa"], ["aa/aa"], ["a/a"])
    _dag(files, base, "dag", ["a"], ["a/a"], ["dag/foo", "dag/bar"])
    for t in ("foo", "bar"):
        files.make_directories(f"{base}/dag/{t}")
    resolve = lambda p: PathResolver(files).resolve(f"{base}/{p}")
    info = lambda p: TableInfo(f"{base}/{p}", p.rpartition("/")[2])
    foo, bar, a, aa = info("dag/foo"), info("dag/bar"), info("a/a"), info("aa/aa")
    assert resolve("dag/foo") == [foo] and resolve("dag/foo?sos-table_name=x") == [dataclasses.replace(foo, table_name="x")]
    assert set(resolve("dag/.dag")) == set(resolve("dag?sos-listing_strategy=dag")) == {DagInfo(f"{base}/dag"), foo, bar}
    assert set(resolve("dag/.dag/output_tables.list")) == {foo, bar}
    assert {i.table_name for i in resolve("dag?sos-listing_strategy=tables")} == {"foo", "bar"}
    assert set(resolve("dag?sos-listing_strategy=dag_io")) == {DagInfo(f"{base}/dag"), foo, bar, a}
    assert set(resolve("dag?sos-listing_strategy=dag_io_recursive")) == {DagInfo(f"{base}/{d}") for d in ("dag", "a", "aa")} | {foo, bar, a, aa}
    for bad, message in (("foo.list?sos-table_name=b", "not supported on"), ("f?sos-listing_strategy=tables&sos-table_name=b", "same time"), ("f?sos-listing_strategy=x", "Unsupported listing"), ("f?sos-listing_strategy=dag_x", "Unsupported dag"), (".foo", "starting with dot")):
        with pytest.raises(PlumbrookError, match=message):
            resolve(bad)


def test_table_io(spark, tmp_path):
    spark.createDataFrame([(1.0,)], "foo double").write.parquet(f"{tmp_path}/record")
    config = TableIOConfig((f"{tmp_path}/record?sos-reshape_config__field_matching_strategy=INDEX",), rs.DEFAULT, output_path=f"{tmp_path}/out")
    with TableIO(spark, config) as tables:
        assert tables.input_table_names() == ["record"] and tables.df("record").columns == ["foo"]
        assert tables.typed("record", T.StructType.fromDDL("i int")).first().i == 1
        with pytest.raises(PlumbrookError, match="conflicting"):
            tables.add_input_path(f"{tmp_path}/other?sos-table_name=record")
        tables.add_input_path(config.input_paths[0])
        tables.write(spark.range(1), "result")
        with pytest.raises(PlumbrookError, match="second time"):
            tables.write(spark.range(1), "result")
        with pytest.raises(PlumbrookError, match="no input table"):
            tables.df("nothing")
    listed = (tmp_path / "out/.dag/output_tables.list").read_text()
    assert listed == f"{tmp_path}/out/result?sos-format=parquet&sos-table_name=result"
    with TableIO(spark, TableIOConfig((f"{tmp_path}/out/.dag?",), register_input_tables=True)) as tables:
        assert spark.catalog.tableExists("result") and tables.df("result").count() == 1
    spark.catalog.dropTempView("result")


def test_using_closes_and_keeps_the_first_error():
    class Resource:
        def close(self):
            raise RuntimeError("late")

    with pytest.raises(ValueError, match="first"), using(Resource()):
        raise ValueError("first")


ROWS = [("foo", "a"), ("dir0/dir00/bar.txt", "b"), ("dir1/./x.txt", "")]


def test_file_per_row(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "Path string, CONTENT string").withColumn("extra", F.lit(1))
    write_files(df, f"{tmp_path}/out")
    assert (tmp_path / "out/dir0/dir00/bar.txt").read_text() == "b" and (tmp_path / "out/dir1/x.txt").read_text() == ""
    with pytest.raises(PlumbrookError, match="already exists"):
        write_files(df, f"{tmp_path}/out")
    write_files(df, f"{tmp_path}/out", mode="ignore")
    binary = spark.createDataFrame([("only", b"\x00\xff")], "path string, content binary")
    write_files(binary, f"{tmp_path}/out", mode="overwrite")
    assert sorted(p.name for p in (tmp_path / "out").rglob("*")) == ["_SUCCESS", "only"] and (tmp_path / "out/only").read_bytes() == b"\x00\xff"
    with pytest.raises(Exception, match="required"):
        write_files(spark.range(1), f"{tmp_path}/bad")
    with pytest.raises(Exception, match="not inside"):
        write_files(spark.createDataFrame([("../up", "x")], "path string, content string"), f"{tmp_path}/bad2")


def test_checked_path():
    assert checked_path("a/../b") == "b"
    for bad in ("../a", "/a", "", ".", "a/../.."):
        with pytest.raises(PlumbrookError):
            checked_path(bad)


@pytest.mark.parametrize(("method", "level"), [("STORED", None), ("DEFLATED", "9")])
def test_zip(spark, tmp_path, method, level):
    options = {"zip_method": method, "zip_file_name": "x.zip"} | ({"zip_level": level} if level else {})
    write_files(spark.createDataFrame(ROWS, "path string, content string").coalesce(1), f"{tmp_path}/out", "zip", **options)
    with zipfile.ZipFile(tmp_path / "out/x.zip") as z:
        assert sorted(z.namelist()) == ["dir0/dir00/bar.txt", "dir1/x.txt", "foo"] and z.read("foo") == b"a"
    with pytest.raises(Exception, match="zip_method"):
        write_files(spark.createDataFrame(ROWS, "path string, content string"), f"{tmp_path}/bad", "zip", zip_method="RAR")


def cells(content, sheet=None):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = [n for n in z.namelist() if n.startswith("xl/worksheets/")]
        tree = ET.fromstring(z.read(names[0]))
    ns = {"m": workbook.MAIN}
    return {c.get("r"): "".join(t.text or "" for t in c.iter(f"{{{workbook.MAIN}}}t")) if c.get("t") == "inlineStr" else (v.text if (v := c.find("m:v", ns)) is not None else None) for c in tree.iter(f"{{{workbook.MAIN}}}c")}


def test_workbook_cells_and_order():
    sheet = workbook.Sheet("S", ["__rowid__", "name", "cost_cents", "day", "ok", "__x__"], [(2, "b & <c>", 4200, datetime.date(2020, 2, 20), True, 1), (1, None, None, None, False, 1)])
    got = cells(workbook.workbook_bytes([sheet]))
    assert got["A1"] == "name" and got["B1"] == "cost" and "E1" not in got
    assert got["A2"] is None and got["A3"] == "b & <c>" and got["B3"] == "42.0" and got["C3"] == "43881.0" and got["D3"] == "1"
    with pytest.raises(PlumbrookError, match="can't be written"):
        workbook.workbook_bytes([workbook.Sheet("S", ["a"], [([1],)])])
    as_text = workbook.WorkbookConfig(convert_unsupported_types_to_string=True, use_header=False)
    assert cells(workbook.workbook_bytes([workbook.Sheet("S", ["a"], [([1],)])], as_text)) == {"A1": "[1]"}


def template():
    marks = workbook.Sheet("Orders", ["x"], [("<<HEADER_STYLE>>",), ("<<TABLE_STARTS_HERE>>",), ("<<COLUMN_STYLE:value>>",), ("kept",)])
    data = workbook.workbook_bytes([marks], workbook.WorkbookConfig(use_header=False))
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w") as w:
        for n in z.namelist():
            part = z.read(n)
            if n.startswith("xl/worksheets/"):
                part = part.replace(b"</worksheet>", b'<conditionalFormatting sqref="A3"/></worksheet>')
            w.writestr(n, part)
    return out.getvalue()


def test_workbook_text_too_long_for_a_cell():
    config = workbook.WorkbookConfig(use_header=False)
    assert cells(workbook.workbook_bytes([workbook.Sheet("S", ["a"], [("x" * 32_767,)])], config)) == {"A1": "x" * 32_767}
    for long in ("x" * 32_768, "\U0001f600" * 16_384):
        with pytest.raises(PlumbrookError, match="cell B1"):
            workbook.workbook_bytes([workbook.Sheet("S", ["a", "b"], [("x", long)])], config)


def test_workbook_template():
    sheet = workbook.Sheet("Orders", ["value"], [(1,), (2,), (3,)])
    content = workbook.workbook_bytes([sheet], workbook.WorkbookConfig(template_xlsx=template()))
    got = cells(content)
    assert got["A2"] == "value" and got["A3"] == "1" and got["A5"] == "3" and "A1" not in got
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        part = next(z.read(n) for n in z.namelist() if n.startswith("xl/worksheets/"))
    assert b'sqref="A3:A5"' in part
    bad = workbook.workbook_bytes([workbook.Sheet("Orders", ["x"], [("<<WHAT>>",)])])
    with pytest.raises(PlumbrookError, match="unknown mark"):
        workbook.workbook_bytes([sheet], workbook.WorkbookConfig(template_xlsx=bad))


@pytest.mark.parametrize("window", [1, 7, 1000])
def test_rows_leave_their_window(window):
    rows = [(k, f"<{k}> & ü", None if k % 3 else 1.5, datetime.date(2020, 1, 1)) for k in range(50)]
    sheets = [workbook.Sheet("one", ["a_cents", "b", "c", "d"], rows), workbook.Sheet("none", ["a"], [])]
    made = [workbook.workbook_bytes(sheets, workbook.WorkbookConfig(row_window=w)) for w in (None, window)]
    assert workbook.workbook_cells(made[0]) == workbook.workbook_cells(made[1]) and len(workbook.workbook_cells(made[1])) == 172
    trees = [ET.fromstring(zipfile.ZipFile(io.BytesIO(m)).read("xl/worksheets/added1.xml")) for m in made]
    assert ET.tostring(trees[0]) == ET.tostring(trees[1])


def test_sheets_have_an_end(monkeypatch):
    monkeypatch.setattr(workbook, "MOST_ROWS", 3)
    assert len(workbook.workbook_cells(workbook.workbook_bytes([workbook.Sheet("s", ["a"], [(1,), (2,)])]))) == 3
    with pytest.raises(PlumbrookError, match="rows a sheet holds"):
        workbook.workbook_bytes([workbook.Sheet("s", ["a"], [(1,), (2,), (3,)])])


def test_workbooks_as_rows(spark):
    orders = spark.createDataFrame([(1, "c1", 100), (2, "c1", 700), (3, "c X", 300)], "id int, customer string, cost_cents bigint")
    by_customer = orders.withColumn("__path__", F.concat("customer", F.lit(".xlsx"))).withColumn("__sheet__", F.col("customer"))
    got = {r.path: bytes(r.content) for r in workbook.to_excel_files([orders.withColumn("__sheet__", F.lit("All")), by_customer]).collect()}
    assert set(got) == {"c1.xlsx", "c X.xlsx"}
    with zipfile.ZipFile(io.BytesIO(got["c1.xlsx"])) as z:
        assert b'name="All"' in z.read("xl/workbook.xml") and b'name="c1"' in z.read("xl/workbook.xml")
    single = workbook.to_excel_files([orders]).collect()
    assert [r.path for r in single] == ["workbook.xlsx"] and cells(bytes(single[0].content))["C2"] == "1.0"
    with pytest.raises(PlumbrookError, match="without sheets"):
        workbook.to_excel_files([])
    workbook.register(spark)
    orders.createOrReplaceTempView("xl_orders")
    sql = spark.sql("SELECT to_excel(NAMED_STRUCT('orders', COLLECT_LIST(STRUCT(*))), NULL) AS content, to_excel(NAMED_STRUCT('o', COLLECT_LIST(STRUCT(*))), MAP('use_header', 'false')) AS bare FROM xl_orders").first()
    assert cells(bytes(sql.content))["A1"] == "id" and cells(bytes(sql.bare))["A1"] == "1"


@jdbc.entity
@dataclasses.dataclass
class Item:
    camelId: jdbc.Int32 = jdbc.column(id=True)
    name: str = jdbc.column(length=42, unique=True, nullable=False)
    note: str | None = jdbc.column(lob=True)
    tags: list[str] = dataclasses.field(default_factory=list)
    day: datetime.date = None
    amount: float = 0.0
    code: str = jdbc.column(definition="CHAR(42)", default="")


def test_create_table():
    assert jdbc.create_table_statement(Item, schema="s") == "CREATE TABLE s.item (\n  camel_id INT NOT NULL,\n  name VARCHAR(42) NOT NULL,\n  note TEXT,\n  tags JSON,\n  day DATE,\n  amount DOUBLE NOT NULL,\n  code CHAR(42)\n);"
    assert jdbc.constraint_statements(Item) == ["ALTER TABLE item ADD CONSTRAINT item_name UNIQUE (name);", "ALTER TABLE item ADD PRIMARY KEY (camel_id);"]

    @dataclasses.dataclass
    class Plain:
        x: int

    with pytest.raises(PlumbrookError, match="not marked"):
        jdbc.create_table_statement(Plain)
    bad = jdbc.entity(dataclasses.make_dataclass("Bad", [("x", complex)]))
    with pytest.raises(PlumbrookError, match="Unsupported type complex"):
        jdbc.create_table_statement(bad)


def test_jdbc_load(spark, tmp_path):
    rows = [(1, "a", "n", ["x", "y"], datetime.date(2020, 1, 1), 1.5, "c", "extra"), (2, "b", None, [], None, 2.5, "d", "extra")]
    spark.createDataFrame(rows, "camelId int, name string, note string, tags array<string>, day date, amount double, code string, extra string").write.parquet(f"{tmp_path}/item")
    (tmp_path / "before.sql").write_text("-- nothing; here\nCREATE SCHEMA extra;\n")
    url = f"jdbc:derby:memory:t{abs(hash(str(tmp_path)))};create=true"
    types = {"TEXT": "CLOB", "JSON": "VARCHAR(1000)"}
    config = jdbc.JdbcConfig(url, ["item"], driver="org.apache.derby.jdbc.EmbeddedDriver", timestamp="2020", before_load_script=f"{tmp_path}/before.sql", executed_sql_output_file=f"{tmp_path}/ran.sql", type_names=types)
    with TableIO(spark, TableIOConfig((f"{tmp_path}/item",))) as tables:
        jdbc.JdbcLoader(config, [Item]).run(tables)
    read = spark.read.jdbc(url, "data_2020.item", properties={"driver": config.driver})
    got = sorted((r.CAMEL_ID if "CAMEL_ID" in read.columns else r.camel_id, r["TAGS" if "TAGS" in read.columns else "tags"]) for r in read.collect())
    assert got == [(1, '["x","y"]'), (2, "[]")]
    ran = (tmp_path / "ran.sql").read_text()
    assert "CREATE SCHEMA extra;" in ran and "CREATE SCHEMA data_2020;" in ran and "ADD PRIMARY KEY" in ran


def test_jdbc_in_process():
    local = ("jdbc:derby:memory:x;create=true", "jdbc:derby:/a/b", "jdbc:h2:mem:x", "jdbc:h2:~/x", "jdbc:hsqldb:file:x", "jdbc:sqlite:x.db", "jdbc:duckdb:")
    served = ("jdbc:derby://host:1527/x", "jdbc:h2:tcp://host/x", "jdbc:hsqldb:hsql://host/x", "jdbc:postgresql://host/x", "")
    assert all(map(jdbc.in_process, local)) and not any(map(jdbc.in_process, served))


def test_jdbc_rows_through_the_driver(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jdbc, "BATCH", 2)
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    url = f"jdbc:derby:memory:d{abs(hash(str(tmp_path)))};create=true"
    schema = "id long, day date, at timestamp, amount decimal(12,2), share double, name string, content binary, flag boolean"
    rows = [(k, datetime.date(2020, 1, 1 + k), datetime.datetime(2020, 1, 1, k, 30), decimal.Decimal(k) / 4, k / 4, f"\u00e4'{k}", bytearray([0, k]), k % 2 == 0) for k in range(7)] + [(7, *[None] * 7)]
    df = spark.createDataFrame(rows, schema).repartition(3)
    jdbc.append_rows(df, url, "some_rows", driver, {"batchsize": "3"})
    assert sorted(map(tuple, jdbc.read_table(spark, url, "some_rows", driver).collect())) == sorted(map(tuple, df.collect()))
    jdbc.append_rows(df.limit(1), url, "some_rows", driver, {})
    assert jdbc.read_table(spark, url, "(SELECT COUNT(*) AS n FROM some_rows) c", driver).first()[0] == 9
    empty = jdbc.read_table(spark, url, "(SELECT * FROM some_rows WHERE 1 = 0) c", driver)
    assert empty.count() == 0 and [c.lower() for c in empty.columns] == df.columns


def test_sql_files(spark):
    df = spark.createDataFrame([(1, "odd"), (2, "even"), (3, "odd")], "value int, tag string")
    sql = "CREATE OR REPLACE TEMPORARY VIEW v AS SELECT * FROM tagged;\nSELECT value, value * value AS squared FROM v WHERE tag = '${tag}';\n-- COMMAND ----------\nSELECT * FROM nowhere"
    assert statements("a;\nb;\n-- COMMAND --\nc") == ["a", "b"]
    assert [tuple(r) for r in run_sql(spark, sql, {"tagged": df}, {"tag": "odd"}).collect()] == [(1, 1), (3, 9)]
    assert not spark.catalog.tableExists("v") and not spark.catalog.tableExists("tagged")
    with pytest.raises(PlumbrookError, match="no statement"):
        run_sql(spark, " -- nothing", {})
    metrics = run_sql_metrics(spark, "SELECT MAP('grouped_by', tag) AS __labels__, COUNT(*) AS count FROM tagged GROUP BY tag", {"tagged": df}, labels={"foo": "bar"}, class_name="C")
    assert sorted((r.key, r.value, r.labels["grouped_by"], r.labels["foo"], r.labels["class_name"]) for r in metrics.collect()) == [("count", 1.0, "even", "bar", "C"), ("count", 2.0, "odd", "bar", "C")]


class PackDag:
    def __init__(self, configuration, session, runner):
        self.session, self.runner = session, runner

    def run(self):
        foo, bar = self.runner.wrap(self.runner.read("foo"), "foo"), self.runner.wrap(self.runner.read("bar"), "bar")
        self.runner.metrics(dg.as_metrics(self.session, {"add_metric": 42.0}, {"foo": "bar"}))
        self.runner.wrap(foo.join(bar, "id").select("id", (foo.value + bar.value).alias("value")), "pack")


class FailingDag(PackDag):
    def run(self):
        self.runner.metrics(dg.as_metrics(self.session, {"m": 1.0}))
        raise RuntimeError("broken")


def test_dag(spark, tmp_path):
    spark.createDataFrame([(1, 11), (2, 21)], "id int, value int").write.parquet(f"{tmp_path}/in/foo")
    spark.createDataFrame([(1, 12), (2, 22)], "id int, value int").write.parquet(f"{tmp_path}/in/bar")
    args = ["--environments=dev", f"dag_runner_config__main_dag={__name__}:PackDag", "dag_runner_config__run_timestamp=2020-02-02T02:22:20", "dag_runner_config__compute_collections__0=pack", f"dag_runner_config__shared_output_path={tmp_path}/shared", f"io_settings__input_paths__0={tmp_path}/in?sos-listing_strategy=tables", f"io_settings__output_path={tmp_path}/out"]
    dg.main(args)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/pack").collect()) == [(1, 23), (2, 43)]
    assert spark.read.parquet(f"{tmp_path}/shared/metric").first().run_timestamp == datetime.datetime(2020, 2, 2, 2, 22, 20)
    assert (tmp_path / "shared/latest.list").read_text().strip() == f"{tmp_path}/out?sos-listing_strategy=dag"
    assert set((tmp_path / "out/.dag/output_tables.list").read_text().split()) == {f"{tmp_path}/out/{t}?sos-format=parquet&sos-table_name={t}" for t in ("pack", "metric")}
    with pytest.raises(RuntimeError, match="broken"):
        dg.main([f"dag_runner_config__main_dag={__name__}:FailingDag", f"io_settings__output_path={tmp_path}/out2"])
    assert spark.read.parquet(f"{tmp_path}/out2/metric").count() == 1


@dataclasses.dataclass
class SomeConfig:
    int_value: int
    text: str | None
    seq: list[str]
    map: dict[str, str]
    date: datetime.date | None
    password: str | None = dataclasses.field(default=None, metadata={"secret": True})
    ALLOW_IN_ROOT = True


def test_configuration(tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/some_config.yaml").write_text("int_value: 42")
    (tmp_path / "p/some_config.foo.yaml").write_text("text: foo\nseq: [foo]\nmap: {foo: foo}")
    (tmp_path / "some_config.root.yaml").write_text("text: root")
    (tmp_path / "main_config.main.yaml").write_text("some_config: {text: main}")
    read = lambda *args: cf.Configuration.of(args, [str(tmp_path / "p")], str(tmp_path)).read(SomeConfig)
    assert read() == SomeConfig(42, None, [], {}, None) and read("--environments=foo,root").text == "root" and read("--environments=main").text == "main"
    got = read("--environments=foo", "some_config__seq__0=prop", "some_config__map__some.key=value", "some_config__date=2020-02-02", "some_config__password=secret", "other__x=1")
    assert got == SomeConfig(42, "foo", ["foo", "prop"], {"foo": "foo", "some.key": "value"}, datetime.date(2020, 2, 2), "secret")
    assert cf.Configuration.of(["--environments=foo,bar", "x"]).environments == ("foo", "bar", "local")
    assert "secret" not in cf.to_json(got)


def test_arbitrary():
    @dataclasses.dataclass
    class Value:
        n: int
        s: str
        b: bool
        items: list[int]

    make = lambda s, seed=0: cf.Arbitrary(s, seed).make(Value)
    S = cf.Strategy
    assert make(S.CONSTANT, 42) == Value(42, "42", False, []) and make(S.DEFAULT) == Value(0, None, False, None) and make(S.PROTO).s == "" and make(S.INDEXED) == Value(0, "1", False, [])
    assert make(S.HASHED, 1) == make(S.HASHED, 1) != make(S.HASHED, 2) and make(S.RANDOM, 3) == make(S.RANDOM, 3)
    assert [cf.clamp(x, -1, 1) for x in (-1, 0, 1, -2, 2, -5, -42)] == [-1, 0, 1, 1, -1, 1, 0]


def test_register_twice(spark):
    register(spark)
    register(spark)
