"""Queries over sources, sinks, workbooks, databases, runners and introspection, each beside the SQL that has to give the same rows."""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbrook.errors import PlumbrookError
from plumbrook.functions import text
from plumbrook.operators import quality_rules as qr
from plumbrook.operators.quality import Quality
from plumbrook.plans import config as cfg
from plumbrook.plans import dag, introspect
from plumbrook.plans.sql_files import run_sql
from plumbrook.sources import jdbc, paths
from plumbrook.sources import workbook as wb
from plumbrook.sources.cache import cached
from plumbrook.sources.files import Files, resource_text
from plumbrook.sources.folder import shared_folder, table
from plumbrook.sources.table_io import TableIO, TableIOConfig

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _url(folder: str, name: str) -> str:
    return f"{folder}/{name}.parquet?sos-table_name={name}&sos-format=parquet"


def _counts(io: TableIO) -> DataFrame:
    """The rows of every input table."""
    parts = [io.df(n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in io.input_table_names()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _count_sql(*names: str, source: str | None = None) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS name, COUNT(*) AS n FROM {source or n}" for n in names)


# Tables by path and name


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def io_tables(spark: SparkSession, folder: str) -> DataFrame:
    io = TableIO(spark, TableIOConfig(input_paths=(_url(folder, "nation"), _url(folder, "region"))))
    return io.df("nation").join(io.df("region"), F.expr("nation.n_regionkey = region.r_regionkey")).select("n_name", "r_name")


@query(_count_sql("nation", "part", "region"))
def io_list(spark: SparkSession, folder: str) -> DataFrame:
    """Tables named by a list file with a comment and an empty line."""
    path = f"{shared_folder(spark, 'list')}/inputs.list"
    Files(spark).write_text(path, "\n".join(["# tables", _url(folder, "nation"), "", _url(folder, "part"), _url(folder, "region")]))
    io = TableIO(spark)
    io.add_input_path(path)
    io.add_input_path(_url(folder, "part"))  # the same once more
    return _counts(io)


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(NULL AS DOUBLE) AS balance, c_mktsegment, CAST(NULL AS BOOLEAN) AS vip FROM customer")
def io_typed(spark: SparkSession, folder: str) -> DataFrame:
    """A table in a given schema: cast, filled and without what the schema lacks."""
    io = TableIO(spark, TableIOConfig(input_paths=(f"{_url(folder, 'customer')}&sos-reshape_config__fill_missing_nulls=true",)))
    return io.typed("customer", T.StructType.fromDDL("c_custkey string, balance double, c_mktsegment string, vip boolean"))


@query("SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1")
def io_registered(spark: SparkSession, folder: str) -> DataFrame:
    name = f"orders_{uuid.uuid4().hex[:8]}"
    TableIO(spark, TableIOConfig(input_paths=(f"{folder}/orders.parquet?sos-table_name={name}",), register_input_tables=True))
    return spark.sql(f"SELECT o_orderstatus, COUNT(*) AS n FROM {name} GROUP BY 1")


def _run(spark: SparkSession, inputs: tuple[str, ...], outputs: dict[str, DataFrame] | None = None) -> str:
    """A run that reads the inputs and writes the outputs; its output path."""
    out = shared_folder(spark, "run")
    with TableIO(spark, TableIOConfig(input_paths=inputs, output_path=out)) as io:
        for name, df in (outputs or {}).items():
            io.write(df, name)
    return out


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal > 0")
def io_written(spark: SparkSession, folder: str) -> DataFrame:
    """Written by name, found again as the only table below the output path."""
    solvent = table(spark, folder, "supplier").where("s_acctbal > 0").select("s_suppkey", "s_name", "s_acctbal")
    io = TableIO(spark, TableIOConfig(input_paths=(f"{_run(spark, (), {'solvent': solvent})}?sos-listing_strategy=tables",)))
    return io.df("solvent")


@query("SELECT 'eu' AS name, COUNT(*) AS n FROM nation WHERE n_regionkey = 3 UNION ALL " + _count_sql("nation"))
def io_dag_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Outputs and inputs of a run, from its lineage."""
    out = _run(spark, (_url(folder, "nation"),), {"eu": table(spark, folder, "nation").where("n_regionkey = 3")})
    return _counts(TableIO(spark, TableIOConfig(input_paths=(f"{out}?sos-listing_strategy=dag_io",))))


@query("SELECT 'asia' AS name, COUNT(*) AS n FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'far' AS name, COUNT(*) AS n FROM nation WHERE n_regionkey = 2 AND n_nationkey > 10 UNION ALL " + _count_sql("nation"))
def io_dag_upstream(spark: SparkSession, folder: str) -> DataFrame:
    """A run on a run: the tables of both and what the first has read."""
    first = _run(spark, (_url(folder, "nation"),), {"asia": table(spark, folder, "nation").where("n_regionkey = 2")})
    second = _run(spark, (f"{first}?sos-listing_strategy=dag",), {"far": spark.read.parquet(f"{first}/asia").where("n_nationkey > 10")})
    return _counts(TableIO(spark, TableIOConfig(input_paths=(f"{second}?sos-listing_strategy=dag_io_recursive",))))


@query("SELECT 'big' AS name, COUNT(*) AS n FROM part WHERE p_size > 25")
def io_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest run through its pointer."""
    out = shared_folder(spark, "run")
    with TableIO(spark, TableIOConfig(output_path=out)) as io:
        io.write(table(spark, folder, "part").where("p_size > 25"), "big")
        io.write_pointer(f"{out}-latest.list")
    return _counts(TableIO(spark, TableIOConfig(input_paths=(f"{out}-latest.list",))))


@query("SELECT n_nationkey, '/in/' || CAST(n_nationkey AS VARCHAR) || '?comment=' || replace(replace(n_comment, ',', '%2C'), ' ', '+') || '&header=true&sos-table_name=' || replace(n_name, ' ', '+') AS url FROM (SELECT n_nationkey, n_name, n_name || ', the nation' AS n_comment FROM nation)")
def io_path_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Paths with options, written as text."""
    rows = table(spark, folder, "nation").select("n_nationkey", "n_name").collect()  # 25 nations
    made = [(r.n_nationkey, paths.TableInfo(f"/in/{r.n_nationkey}", r.n_name, None, (), (("comment", f"{r.n_name}, the nation"), ("header", "true"))).url()) for r in rows]
    return spark.createDataFrame(made, table(spark, folder, "nation").select("n_nationkey", F.lit("").alias("url")).schema)


@query("SELECT n_nationkey, n_name AS table_name, n_name || ', the nation' AS comment FROM nation")
def io_parsed_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The same texts read again: own options apart from the reader's."""
    parsed = [(r.n_nationkey, paths.parse_path(r.url)) for r in io_path_urls(spark, folder).collect()]
    return spark.createDataFrame([(k, p.own["table_name"], p.reader["comment"]) for k, p in parsed], table(spark, folder, "nation").select("n_nationkey", F.lit("").alias("table_name"), F.lit("").alias("comment")).schema)


@query("SELECT r_name || '.txt' AS name, CAST(length(r_name) AS BIGINT) AS size FROM region")
def io_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files written and walked through Hadoop's file systems."""
    base, files = shared_folder(spark, "files"), Files(spark)
    for r in table(spark, folder, "region").collect():  # 5 regions
        files.write_text(f"{base}/{r.r_name[0]}/{r.r_name}.txt", r.r_name)
    return spark.createDataFrame([(s.name, len(files.read_text(s.path))) for s in files.walk(base)], "name string, size bigint")


@query("SELECT s_suppkey, s_name FROM supplier")
def io_cached(spark: SparkSession, folder: str) -> DataFrame:
    """Downloaded once, read from the copy after."""
    base = shared_folder(spark, "cache")
    table(spark, folder, "supplier").select("s_suppkey", "s_name").write.csv(f"{base}/source", header=True)
    read = lambda: cached(spark, f"{base}/source", f"{base}/copies", "csv", {"header": "true", "inferSchema": "true"})
    read()
    Files(spark).delete(f"{base}/source")
    return read().select(F.col("s_suppkey").cast(table(spark, folder, "supplier").schema["s_suppkey"].dataType).alias("s_suppkey"), "s_name")


@query("SELECT c_custkey, CAST(c_acctbal AS VARCHAR) IS NOT NULL AS has_balance FROM customer")
def testing_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Temporary tables of tests, written and read."""
    from plumbrook.testing import TemporaryTables

    tables = TemporaryTables(spark, shared_folder(spark, "tests"), "customers")
    tables.write(table(spark, folder, "customer").select("c_custkey", F.isnotnull("c_acctbal").alias("has_balance")), "customers")
    return tables.read("customers")


# Quality of files and catalog tables


def _damaged(spark: SparkSession, folder: str) -> str:
    """Customers as delimited lines, those with a key of rest 3 by 7 with a field too many; the path of the file."""
    base = shared_folder(spark, "csv")
    line = F.concat_ws(";", "c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 7 == 3, F.lit("odd;odd")))
    table(spark, folder, "customer").select(F.col("c_custkey").alias("k"), line.alias("value")).coalesce(1).sortWithinPartitions("k").select("value").write.text(base)
    return next(s.path for s in Files(spark).walk(base))


_ODD = "SELECT '__record_not_corrupted' AS rule_name, CAST(COUNT_IF(c_custkey % 7 = 3) AS BIGINT) AS violations FROM customer"


@query(_ODD)
def dq_from_path(spark: SparkSession, folder: str) -> DataFrame:
    return Quality.from_path(spark, f"{_damaged(spark, folder)}?sos-format=csv&delimiter=%3B").rule_statistics()


@query("SELECT MIN(n) AS row_id FROM (SELECT c_custkey, ROW_NUMBER() OVER (ORDER BY c_custkey) - 1 AS n FROM customer) WHERE c_custkey % 7 = 3 UNION ALL SELECT MAX(n) FROM (SELECT c_custkey, ROW_NUMBER() OVER (ORDER BY c_custkey) - 1 AS n FROM customer) WHERE c_custkey % 7 = 3")
def dq_file_row_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """The first and the last bad record of the file, by their place in it, are in every sample."""
    from plumbrook.operators.quality import QualityConfig

    q = Quality.from_path(spark, f"{_damaged(spark, folder)}?sos-format=csv&delimiter=%3B").config(QualityConfig(max_rows_per_rule=2))
    return q.row_sample().select("row_id")


@query("SELECT 'l_tax__not_negative' AS rule_name, CAST(COUNT_IF(NOT l_tax >= 0) AS BIGINT) AS violations FROM lineitem UNION ALL SELECT 'l_discount__small', CAST(COUNT_IF(NOT l_discount < 0.05) AS BIGINT) FROM lineitem")
def dq_from_table(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "lineitem").createOrReplaceTempView("system_lineitem")
    return Quality.from_table(spark, "system_lineitem").rules([qr.named_rule("l_tax", "not_negative", "l_tax >= 0"), qr.named_rule("l_discount", "small", "l_discount < 0.05")]).rule_statistics()


# Workbooks


@query(
    "WITH r AS (SELECT r_name, n_name, n_nationkey, ROW_NUMBER() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS k FROM nation JOIN region ON n_regionkey = r_regionkey) "
    "SELECT r_name || '.xlsx' AS path, 'Nations' AS sheet, CAST(k + 1 AS INTEGER) AS row_no, CAST(1 AS INTEGER) AS column_no, n_name AS value FROM r UNION ALL "
    "SELECT r_name || '.xlsx', 'Nations', CAST(k + 1 AS INTEGER), CAST(2 AS INTEGER), CAST(n_nationkey AS VARCHAR) FROM r UNION ALL "
    "SELECT r_name || '.xlsx', 'Nations', CAST(1 AS INTEGER), CAST(c AS INTEGER), h FROM region, (VALUES (1, 'n_name'), (2, 'n_nationkey')) v(c, h)"
)
def xlsx_cells(spark: SparkSession, folder: str) -> DataFrame:
    """A workbook per region, its nations in the order of __rowid__; special columns are not shown."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat("r_name", F.lit(".xlsx")).alias("__path__"), F.lit("Nations").alias("__sheet__"), F.col("n_nationkey").alias("__rowid__"), "n_name", "n_nationkey")
    return wb.excel_cells(wb.to_excel_files([rows]))


@query("SELECT c_mktsegment || '.xlsx' AS path, round(SUM(round(c_acctbal * 100) / 100), 2) AS balance, COUNT(*) AS n FROM customer GROUP BY 1")
def xlsx_cents(spark: SparkSession, folder: str) -> DataFrame:
    """Cents are shown as currency under the name without the suffix."""
    rows = table(spark, folder, "customer").select(F.concat("c_mktsegment", F.lit(".xlsx")).alias("__path__"), F.round(F.col("c_acctbal") * 100).cast("bigint").alias("balance_cents"))
    cells = wb.excel_cells(wb.to_excel_files([rows]))
    titles = cells.where("row_no = 1 AND value = 'balance'").select("path", "column_no")
    return cells.where("row_no > 1").join(titles, ["path", "column_no"]).groupBy("path").agg(F.round(F.sum(F.col("value").cast("double")), 2).alias("balance"), F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(CAST(o_orderdate AS DATE) - DATE '1899-12-30' AS DOUBLE) AS serial FROM orders")
def xlsx_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Days are numbers of days."""
    days = table(spark, folder, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct().select("day", F.col("day").cast("string").alias("text"))
    cells = wb.excel_cells(wb.to_excel_files([days])).where("row_no > 1")
    return cells.groupBy("row_no").agg(F.max(F.when(F.col("column_no") == 2, F.col("value"))).cast("date").alias("day"), F.max(F.when(F.col("column_no") == 1, F.col("value"))).cast("double").alias("serial")).select("day", "serial")


@query("SELECT r_name AS path, 'Members' AS sheet, n_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def xlsx_sql_function(spark: SparkSession, folder: str) -> DataFrame:
    """to_excel in SQL, with options as texts."""
    wb.register(spark)
    for name in ("nation", "region"):
        table(spark, folder, name).createOrReplaceTempView(f"system_{name}")
    made = spark.sql("""SELECT r_name AS path, to_excel(named_struct('Members', collect_list(named_struct('n_name', n_name))), map('use_header', 'false')) AS content
FROM system_nation JOIN system_region ON n_regionkey = r_regionkey GROUP BY r_name""")
    return wb.excel_cells(made).select("path", "sheet", "value")


@query(
    "WITH b AS (SELECT n_name || '.xlsx' AS path, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), s AS (SELECT n_name || '.xlsx' AS path, COUNT(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) "
    "SELECT path, 'Buyers' AS sheet, n AS cells FROM b UNION ALL SELECT path, 'Sellers', n FROM s UNION ALL SELECT path, 'Sheet3', 5 FROM (SELECT path FROM b UNION SELECT path FROM s)"
)
def xlsx_joined_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """Sheets of one path are in one workbook, whichever of them it has; sheets without path are in all."""
    nation = table(spark, folder, "nation").select("n_nationkey", F.concat("n_name", F.lit(".xlsx")).alias("__path__"))
    part = lambda name, key, value, sheet: table(spark, folder, name).join(nation, F.col(key) == F.col("n_nationkey")).select("__path__", F.lit(sheet).alias("__sheet__"), value)
    made = wb.to_excel_files([part("customer", "c_nationkey", "c_custkey", "Buyers"), part("supplier", "s_nationkey", "s_suppkey", "Sellers"), table(spark, folder, "region").select("r_name")])
    return wb.excel_cells(made).where("row_no > 1").groupBy("path", "sheet").agg(F.count(F.lit(1)).alias("cells"))


@query(
    "WITH r AS (SELECT r_regionkey, r_name, ROW_NUMBER() OVER (ORDER BY r_regionkey) AS k FROM region) SELECT CAST(k + 3 AS INTEGER) AS row_no, CAST(1 AS INTEGER) AS column_no, CAST(r_regionkey AS VARCHAR) AS value FROM r "
    "UNION ALL SELECT CAST(k + 3 AS INTEGER), CAST(2 AS INTEGER), r_name FROM r UNION ALL SELECT CAST(3 AS INTEGER), CAST(1 AS INTEGER), 'r_regionkey' UNION ALL SELECT CAST(3 AS INTEGER), CAST(2 AS INTEGER), 'r_name' UNION ALL SELECT CAST(1 AS INTEGER), CAST(1 AS INTEGER), 'All regions'"
)
def xlsx_template(spark: SparkSession, folder: str) -> DataFrame:
    """A table below the title of a template."""
    template = wb.workbook_bytes([wb.Sheet("Regions", ["a"], [("All regions",), (None,), ("<<TABLE_STARTS_HERE>>",)])], wb.WorkbookConfig(use_header=False, auto_size_columns=False))
    rows = table(spark, folder, "region").select(F.lit("Regions").alias("__sheet__"), F.col("r_regionkey").alias("__rowid__"), "r_regionkey", "r_name")
    return wb.excel_cells(wb.to_excel_files([rows], wb.WorkbookConfig(template_xlsx=template))).select("row_no", "column_no", "value")


@query(
    "SELECT p_brand || '.xlsx' AS path, CAST(1 AS INTEGER) AS column_no, round(CAST(LEAST(GREATEST(MAX(length(p_name)), LEAST(length('p_name'), 12), 4), 64) AS DOUBLE) * 1.4, 4) AS width FROM part GROUP BY 1 "
    "UNION ALL SELECT p_brand || '.xlsx', CAST(2 AS INTEGER), round(CAST(LEAST(GREATEST(MAX(length(CAST(p_size AS VARCHAR))), LEAST(length('a_size_of_the_part'), 12), 4), 64) AS DOUBLE) * 1.4, 4) FROM part GROUP BY 1"
)
def xlsx_widths(spark: SparkSession, folder: str) -> DataFrame:
    """Columns are as wide as their longest text."""
    from xml.etree import ElementTree as ET

    rows = table(spark, folder, "part").select(F.concat("p_brand", F.lit(".xlsx")).alias("__path__"), "p_name", F.col("p_size").alias("a_size_of_the_part"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                for _, tree in wb._Package(content).sheets.values():
                    out += [(path, int(c.get("min")), float(c.get("width"))) for c in tree.iter(f"{{{wb.MAIN}}}col")] if isinstance(tree, ET.Element) else []
            yield pd.DataFrame(out, columns=["path", "column_no", "width"])

    return wb.to_excel_files([rows]).mapInPandas(read, "path string, column_no int, width double")


@query("SELECT 'A2:B' || CAST(COUNT(*) + 1 AS VARCHAR) AS area FROM nation")
def xlsx_conditional_formats(spark: SparkSession, folder: str) -> DataFrame:
    """A conditional format over the cell of a style grows over all rows of the table."""
    import io
    import zipfile

    blank = wb.workbook_bytes([wb.Sheet("Nations", ["a", "b"], [("<<TABLE_STARTS_HERE>>", None), ("<<CELL_STYLE>>", None)])], wb.WorkbookConfig(use_header=False, auto_size_columns=False))
    made = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(blank)) as old, zipfile.ZipFile(made, "w") as new:
        for name in old.namelist():
            part = old.read(name)
            if name.startswith("xl/worksheets/"):
                part = part.replace(b"</sheetData>", b'</sheetData><conditionalFormatting sqref="A2:B2"><cfRule type="duplicateValues" priority="1"/></conditionalFormatting>')
            new.writestr(name, part)
    rows = table(spark, folder, "nation").select(F.lit("Nations").alias("__sheet__"), "n_nationkey", "n_name")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            trees = [tree for content in frame["content"] for _, tree in wb._Package(content).sheets.values()]
            yield pd.DataFrame({"area": [f.get("sqref") for tree in trees for f in tree.iter(f"{{{wb.MAIN}}}conditionalFormatting")]})

    return wb.to_excel_files([rows], wb.WorkbookConfig(template_xlsx=made.getvalue())).mapInPandas(read, "area string")


# Databases


def _entities() -> tuple[type, type]:
    @jdbc.entity
    @dataclasses.dataclass
    class SystemRegion:
        r_regionkey: jdbc.Int32 = jdbc.column(id=True)
        r_name: str = jdbc.column(nullable=False, length=40, unique=True)

    SystemRegion.__annotations__ = {"r_regionkey": jdbc.Int32, "r_name": str}

    @jdbc.entity
    @dataclasses.dataclass
    class SystemNation:
        n_nationkey: jdbc.Int32 = jdbc.column(id=True)
        n_name: str = jdbc.column(nullable=False, length=40)
        n_regionkey: jdbc.Int32 = jdbc.column()

    SystemNation.__annotations__ = {"n_nationkey": jdbc.Int32, "n_name": str, "n_regionkey": jdbc.Int32}
    return SystemRegion, SystemNation


SystemRegion, SystemNation = _entities()
_DERBY = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def _loaded(spark: SparkSession, folder: str) -> str:
    """Regions and nations loaded with scripts before and after; the URL of the database."""
    base, files = shared_folder(spark, "scripts"), Files(spark)
    files.write_text(f"{base}/before.sql", "-- what the load has to find\nCREATE SCHEMA log; CREATE TABLE log.runs (name VARCHAR(40));")
    files.write_text(f"{base}/after.sql", "CREATE TABLE log.sums (r_name VARCHAR(40), n BIGINT);\nINSERT INTO log.sums SELECT r.r_name, COUNT(*) FROM ${schema_name}.system_nation n JOIN ${schema_name}.system_region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name;")
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    names = ("system_region", "system_nation")
    io = TableIO(spark, TableIOConfig(input_paths=tuple(f"{folder}/{n.removeprefix('system_')}.parquet?sos-table_name={n}" for n in names)))
    loader = jdbc.JdbcLoader(jdbc.JdbcConfig(url, names, driver=_DERBY["driver"], before_load_script=f"{base}/before.sql", after_load_script=f"{base}/after.sql"), [SystemRegion, SystemNation])
    loader.run(io)
    return url


@query("SELECT r_name, COUNT(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def jdbc_load(spark: SparkSession, folder: str) -> DataFrame:
    """What a script after the load has summed up in the database."""
    return jdbc.read_table(spark, _loaded(spark, folder), "log.sums", _DERBY).select(F.col("R_NAME").alias("r_name"), F.col("N").alias("n"))


@query("SELECT 'SYSTEM_NATION' AS table_name, 'P' AS kind, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'SYSTEM_REGION', 'P', 1 UNION ALL SELECT 'SYSTEM_REGION', 'U', 1")
def jdbc_constraints(spark: SparkSession, folder: str) -> DataFrame:
    """The constraints that the database knows after the load."""
    of = "(SELECT t.tablename, c.type FROM sys.sysconstraints c JOIN sys.systables t ON c.tableid = t.tableid) k"
    read = jdbc.read_table(spark, _loaded(spark, folder), of, _DERBY)
    return read.groupBy(F.col("TABLENAME").alias("table_name"), F.trim("TYPE").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT r_regionkey AS region_key, '{\"name\":\"' || r_name || '\",\"size\":' || CAST((SELECT COUNT(*) FROM nation WHERE n_regionkey = r_regionkey) AS VARCHAR) || '}' AS about, '[\"' || lower(r_name) || '\",\"' || upper(r_name) || '\"]' AS other_names FROM region")
def jdbc_normalized(spark: SparkSession, folder: str) -> DataFrame:
    """Nested values as JSON texts, names in snake case, only the entity's columns."""
    entity = dataclasses.make_dataclass("Region", [("regionKey", int), ("about", dict), ("otherNames", list)])
    region, nation = table(spark, folder, "region"), table(spark, folder, "nation")
    sizes = nation.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("size"))
    rows = region.join(sizes, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_regionkey").alias("regionKey"), F.struct(F.col("r_name").alias("name"), "size").alias("about"), F.array(F.lower("r_name"), F.upper("r_name")).alias("otherNames"), F.lit(1).alias("unknown"))
    return jdbc.normalized(rows, entity)


# Runs


class RegionDag:
    """Customers and suppliers per region, counted; `people` may be given as an input instead."""

    def __init__(self, configuration: cfg.Configuration, spark: SparkSession, runner: dag.DagRunner):
        self.spark, self.runner = spark, runner

    def run(self) -> None:
        nation = self.runner.read("nation")
        people = self.runner.wrap(self.runner.read("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("people")), "people")
        out = self.runner.wrap(people.join(nation, "n_nationkey").groupBy("n_regionkey").agg(F.sum("people").alias("people")), "per_region")
        self.runner.metrics(dag.as_metrics(self.spark, {"regions": out.count()}, {"dag": "region"}))


_PEOPLE = "SELECT n_regionkey, CAST(COUNT(*) AS BIGINT) AS people FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"


def _dag_out(spark: SparkSession, folder: str, *more: str) -> str:
    out = shared_folder(spark, "dag")
    inputs = [_url(folder, "nation"), _url(folder, "customer"), *more]
    given = [f"io_settings__input_paths__{k}={url}" for k, url in enumerate(inputs)]
    dag.main(["dag_runner_config__main_dag=plumbrook.system_queries:RegionDag", "dag_runner_config__compute_collections__0=per_region", f"dag_runner_config__shared_output_path={out}/shared", f"io_settings__output_path={out}/own", *given])
    return out


@query(_PEOPLE)
def dag_run(spark: SparkSession, folder: str) -> DataFrame:
    """A run configured by arguments; what it was asked to write."""
    return spark.read.parquet(f"{_dag_out(spark, folder)}/own/per_region").select("n_regionkey", "people")


@query("SELECT n_regionkey, CAST(SUM(n_nationkey) AS BIGINT) AS people FROM nation GROUP BY 1")
def dag_override(spark: SparkSession, folder: str) -> DataFrame:
    """An input of the name of a result stands for it."""
    given = shared_folder(spark, "people")
    table(spark, folder, "nation").select("n_nationkey", F.col("n_nationkey").cast("bigint").alias("people")).write.parquet(given)
    return spark.read.parquet(f"{_dag_out(spark, folder, f'{given}?sos-table_name=people')}/own/per_region").select("n_regionkey", F.col("people").cast("bigint").alias("people"))


@query("SELECT 'regions' AS key, CAST(COUNT(DISTINCT n_regionkey) AS DOUBLE) AS value, 'region' AS dag FROM customer JOIN nation ON c_nationkey = n_nationkey")
def dag_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics appended to those that runs share."""
    return spark.read.parquet(f"{_dag_out(spark, folder)}/shared/metric").select("key", "value", F.try_element_at("labels", F.lit("dag")).alias("dag"))


# Texts, configuration, introspection


def _by_nation(spark: SparkSession, folder: str, made: Callable[[str], str | bool | None], kind: str = "string") -> DataFrame:
    """A function of each of the 25 nations' names, on the driver."""
    schema = T.StructType([table(spark, folder, "nation").schema["n_nationkey"], T.StructField("made", T.BooleanType() if kind == "boolean" else T.StringType())])
    return spark.createDataFrame([(r.n_nationkey, made(r.n_name)) for r in table(spark, folder, "nation").collect()], schema)


@query("SELECT n_nationkey, CASE WHEN regexp_full_match(n_name, '[A-Za-z_][A-Za-z0-9_]*') THEN n_name ELSE '`' || n_name || '`' END AS made FROM nation")
def text_quoted_names(spark: SparkSession, folder: str) -> DataFrame:
    return _by_nation(spark, folder, introspect.quote_if_needed)


@query("SELECT DISTINCT p_type, replace(lower(p_type), ' ', '_') AS snake FROM part")
def text_snake_case(spark: SparkSession, folder: str) -> DataFrame:
    """Names in camel case, read again; part types are few combinations of words."""
    types = [r.p_type for r in table(spark, folder, "part").select("p_type").distinct().collect()]
    return spark.createDataFrame([(t, text.snake_case(text.camel_case(t.lower().replace(" ", "_")))) for t in types], "p_type string, snake string")


@query("SELECT n_nationkey, regexp_replace(n_name || '--(' || CAST(length(n_name) AS VARCHAR) || ')', '\\W+', '_', 'g') AS made FROM nation")
def text_word_characters(spark: SparkSession, folder: str) -> DataFrame:
    return _by_nation(spark, folder, lambda n: text.word_characters(f"{n}--({len(n)})", collapse=True))


@query("SELECT n_nationkey, n_nationkey % 2 = 0 AS made FROM nation")
def plan_is_query(spark: SparkSession, folder: str) -> DataFrame:
    """Which statements are queries."""
    keys = {r.n_name: r.n_nationkey for r in table(spark, folder, "nation").collect()}

    def is_query(name: str) -> bool:
        try:
            introspect.assert_query(spark, f"SELECT * FROM `{name}`" if keys[name] % 2 == 0 else f"DROP VIEW `{name}`")
        except PlumbrookError:
            return False
        return True

    return _by_nation(spark, folder, is_query, "boolean")


@query("SELECT n_nationkey, lower(replace(n_name, ' ', '_')) AS made FROM nation")
def plan_alias(spark: SparkSession, folder: str) -> DataFrame:
    """The alias that a frame goes by."""
    return _by_nation(spark, folder, lambda n: introspect.alias_of(spark.range(1).alias(n.lower().replace(" ", "_"))))


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 'SystemNation/' || lower(replace(n_name, ' ', '_')) WHEN n_regionkey = 1 THEN 'SystemRegion' ELSE NULL END AS made FROM nation")
def plan_table_names(spark: SparkSession, folder: str) -> DataFrame:
    """The classes that table names stand for."""
    known = paths.TableNames((SystemRegion, SystemNation))
    regions = {r.n_name: r.n_regionkey for r in table(spark, folder, "nation").collect()}

    def find(name: str) -> str | None:
        own = name.lower().replace(" ", "_")
        found = known.find({0: f"system_nation__{own}", 1: "system_region"}.get(regions[name], f"unknown__{own}"))
        return found and "/".join(x for x in (found[0].__name__, found[1].logical) if x)

    return _by_nation(spark, folder, find)


@dataclasses.dataclass
class SystemSettings:
    """What the queries of configuration read."""

    names: list[str] = dataclasses.field(default_factory=list)
    sizes: dict[str, int] = dataclasses.field(default_factory=dict)
    strict: bool = False


@query("SELECT r_name AS name, CAST((SELECT COUNT(*) FROM nation WHERE n_regionkey = r_regionkey) AS BIGINT) AS size, TRUE AS strict FROM region")
def config_layers(spark: SparkSession, folder: str) -> DataFrame:
    """Values from a file, one of an environment, and arguments, each over the ones before."""
    import tempfile
    from pathlib import Path

    counts = {r.r_name: r.n for r in table(spark, folder, "region").join(table(spark, folder, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    with tempfile.TemporaryDirectory() as own:  # read on the driver only
        Path(own, "system_settings.yaml").write_text(f"names: {sorted(counts)}\nsizes: {{{', '.join(f'{n!r}: 0' for n in counts)}}}\nstrict: false\n")
        Path(own, "system_settings.test.yaml").write_text("strict: true\n")
        got = cfg.Configuration.of(["--environments=test", *(f"system_settings__sizes__{n}={k}" for n, k in counts.items())], [own]).read(SystemSettings)
    return spark.createDataFrame([(n, got.sizes[n], got.strict) for n in got.names], "name string, size bigint, strict boolean")


@query("SELECT r_name AS name, '{\"names\":[\"' || r_name || '\"],\"sizes\":{\"k\":' || CAST(r_regionkey AS VARCHAR) || '},\"strict\":true}' AS json FROM region")
def config_json(spark: SparkSession, folder: str) -> DataFrame:
    """Instances as JSON and back."""
    import json

    made = []
    for r in table(spark, folder, "region").collect():  # 5 regions
        once = cfg.to_json(SystemSettings([r.r_name], {"k": r.r_regionkey}, True))
        again = cfg.from_plain(SystemSettings, json.loads(once))
        made.append((r.r_name, json.dumps(json.loads(cfg.to_json(again)), separators=(",", ":"), ensure_ascii=False)))
    return spark.createDataFrame(made, "name string, json string")


@query("SELECT r_name AS name, CAST(length(r_name) AS BIGINT) AS size, CAST(r_regionkey AS BIGINT) AS kept, r_regionkey % 2 = 0 AS strict FROM region")
def config_copy(spark: SparkSession, folder: str) -> DataFrame:
    """Deep copies with changes: what is not changed stays, and the original does too."""
    made = []
    for r in table(spark, folder, "region").collect():  # 5 regions
        first = SystemSettings([r.r_name], {"kept": r.r_regionkey})
        copy = cfg.update(first, {"sizes": {"size": len(r.r_name)}, "strict": r.r_regionkey % 2 == 0})
        if first.sizes != {"kept": r.r_regionkey} or first.strict:
            raise PlumbrookError("a copy has changed its original")
        made.append((copy.names[0], copy.sizes["size"], copy.sizes["kept"], copy.strict))
    return spark.createDataFrame(made, "name string, size bigint, kept bigint, strict boolean")


@query("SELECT c_mktsegment AS segment, c_custkey AS customer, c_acctbal AS balance FROM customer WHERE c_acctbal >= 100 QUALIFY ROW_NUMBER() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) = 1")
def sql_resource(spark: SparkSession, folder: str) -> DataFrame:
    """A statement that is kept as a text of the package."""
    return run_sql(spark, resource_text("plumbrook.resources", "richest_of_segment.sql"), {"resource_customer": table(spark, folder, "customer")}, {"least_balance": 100})


@query("SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) || '/' || CAST(n_nationkey AS VARCHAR) || '.0' AS made FROM nation")
def config_made_up(spark: SparkSession, folder: str) -> DataFrame:
    """Instances with constant values, one seed per nation."""
    keys = {r.n_name: r.n_nationkey for r in table(spark, folder, "nation").collect()}
    entity = dataclasses.make_dataclass("Made", [("whole", int), ("real", float)])

    def make(name: str) -> str:
        one = cfg.Arbitrary(cfg.Strategy.CONSTANT, keys[name]).make(entity)
        return f"{one.whole}/{one.real}"

    return _by_nation(spark, folder, make)
