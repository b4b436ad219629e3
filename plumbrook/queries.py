"""Registered queries of the core operators and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbrook import survey_queries, system_queries
from plumbrook.operators import drift, load_profile, rejects
from plumbrook.sources.folder import shared_folder, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = survey_queries.QUERIES | system_queries.QUERIES
SQL: dict[str, str] = survey_queries.SQL | system_queries.SQL


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# 2. Column-level data quality profile

#: Columns of the accepted profile: those of p2_found and its SQL. The other queries take every column but the load.
PROFILED = ["customer_id", "item_id", "amount", "cost_cents", "status_code", "zone_code", "ref_code", "measure", "ordered_on"]
PERCENTS = [5, 25, 50, 75, 95]


def _every_column(records: DataFrame) -> list[str]:
    return [c for c in records.columns if c != "load_id"]


@query
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return load_profile.findings(table(spark, folder, "dq_record"), "load_id", table(spark, folder, "dp_column"), table(spark, folder, "dq_violation"))


@query
def p2_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Nulls, distinct values, range, shares of accepted cells and logged violations of every column of every load."""
    records = table(spark, folder, "dq_record")
    return load_profile.profile(records, _every_column(records), "load_id", table(spark, folder, "dp_column"), table(spark, folder, "dq_violation"))


def _texts_and_numbers(df: DataFrame, kinds: dict[str, str], *values: str) -> DataFrame:
    """Values shown as texts as numbers too: those of numeric columns, and microseconds of moments."""
    kind = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))[F.col("column_name")]
    moment = lambda v: F.unix_micros(F.when(kind == "timestamp", F.col(v)).cast("timestamp")).cast("double")
    number = lambda v: F.when(kind.isin("long", "double"), F.col(v).try_cast("double")).when(kind == "timestamp", moment(v))
    text = lambda v: F.when(kind.isin("text", "date"), F.col(v))
    return df.select("*", *(f(v).alias(f"{v}_{end}") for v in values for f, end in ((text, "text"), (number, "number"))))


def _kinds(records: DataFrame) -> dict[str, str]:
    return {p.name: p.kind for p in load_profile.plan_columns(records, _every_column(records))}


@query
def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, nulls, distinct values and range of every column of every load."""
    records = table(spark, folder, "dq_record")
    found = load_profile.profile(records, _every_column(records), "load_id").withColumn("null_rate", F.round("null_rate", 9))
    return _texts_and_numbers(found, _kinds(records), "min_value", "max_value").drop("min_value", "max_value")


@query
def p2_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Present and accepted share of every accepted bucket and item of every load."""
    found = p2_profile(spark, folder).where("cells IS NOT NULL").select("load_id", "column_name", "outside_share", F.explode("cells").alias("c"))
    return found.select("load_id", "column_name", "c.low", "c.high", "c.item", *(F.round(c, 9).alias(n) for c, n in (("c.share", "share"), ("c.accepted_share", "accepted_share"), ("outside_share", "outside_share"))))


@query
def p2_logged(spark: SparkSession, folder: str) -> DataFrame:
    """Logged violations of every rule, load and column."""
    return p2_profile(spark, folder).select("load_id", "column_name", F.explode("violations").alias("v")).select("load_id", "column_name", "v.rule_name", "v.count_violations")


@query
def p2_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Exact percentiles of every column of every load."""
    records = table(spark, folder, "dq_record")
    plans = load_profile.plan_columns(records, _every_column(records))
    placed = load_profile.curves(load_profile.ranged(load_profile.value_runs(records, plans, "load_id")), shared_folder(spark, "curves"))
    q = load_profile.named(load_profile.quantiles(placed, PERCENTS), plans)
    found = q.select("load_id", "column_name", F.col("pct").cast("int").alias("pct"), load_profile.shown(F.col("kind"), F.col("ordinal"), F.col("text")).alias("value"))
    return _texts_and_numbers(found, _kinds(records), "value").drop("value")


@query
def p2_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Exact Kolmogorov-Smirnov distance of every column of every load to the load before it."""
    records = table(spark, folder, "dq_record")
    return load_profile.distances(records, _every_column(records), "load_id").withColumn("ks_distance", F.round("ks_distance", 9))


def _unpivoted(numeric: bool = False) -> str:
    """One row per stored row and profiled column; v is null where a value is not present."""
    parts = []
    for name in PROFILED:
        text = name in ("customer_id", "item_id", "status_code", "zone_code", "ref_code")
        v = f"CASE WHEN trim({name}, ' ') <> '' THEN {name} END" if text else f"CAST({name} AS VARCHAR)"
        x = "NULL" if text else f"CAST({name} - DATE '1970-01-01' AS DOUBLE)" if name == "ordered_on" else f"CAST({name} AS DOUBLE) + 0.0"
        k = f"CASE WHEN trim({name}, ' ') <> '' THEN {name} END" if text else f"CAST({x} AS VARCHAR)"
        parts.append(f"SELECT load_id, '{name}' AS column_name, {v} AS v, CAST({x} AS DOUBLE) AS x, {k} AS k FROM dq_record")
    return " UNION ALL ".join(parts)


SQL["p2_found"] = f"""
WITH u AS ({_unpivoted()}),
g AS (SELECT load_id, column_name, COUNT(*) AS r, COUNT(k) AS n, COUNT(DISTINCT k) AS d, MIN(x) AS lo, MAX(x) AS hi FROM u GROUP BY ALL),
cell AS (SELECT column_name, b.low AS low, b.high AS high, NULL AS item, b.bucket_count AS c FROM (SELECT column_name, unnest(pmf) AS b FROM dp_column)
  UNION ALL SELECT column_name, NULL, NULL, i.item, i.item_count FROM (SELECT column_name, unnest(items) AS i FROM dp_column)),
share AS (SELECT *, SUM(c) OVER (PARTITION BY column_name) AS t FROM cell),
inside AS (SELECT u.load_id, s.column_name, s.low, s.item, COUNT(*) AS m FROM u JOIN share s ON s.column_name = u.column_name AND u.k IS NOT NULL
  AND (s.item = u.v OR (u.x >= s.low AND u.x < s.high)) GROUP BY ALL),
dist AS (SELECT g.load_id, g.column_name, SUM(ABS(COALESCE(i.m, 0) * CAST(s.t AS HUGEINT) - s.c * CAST(g.n AS HUGEINT))) + (g.n - SUM(COALESCE(i.m, 0))) * MAX(s.t) AS moved, g.n * MAX(s.t) AS whole
  FROM g JOIN share s USING (column_name) LEFT JOIN inside i ON i.load_id = g.load_id AND i.column_name = s.column_name AND i.low IS NOT DISTINCT FROM s.low AND i.item IS NOT DISTINCT FROM s.item
  GROUP BY g.load_id, g.column_name, g.n),
b AS (SELECT v.load_id, c.column_name, COUNT(DISTINCT v.primary_key) AS k FROM dq_violation v JOIN dp_column c ON lower(trim(v.rule_name)) = lower(trim(c.rule_name)) GROUP BY ALL),
a AS (SELECT *, CASE WHEN data_type = 'date' THEN CAST(TRY_CAST(min_value AS DATE) - DATE '1970-01-01' AS DOUBLE) ELSE TRY_CAST(min_value AS DOUBLE) END AS lo0,
  CASE WHEN data_type = 'date' THEN CAST(TRY_CAST(max_value AS DATE) - DATE '1970-01-01' AS DOUBLE) ELSE TRY_CAST(max_value AS DOUBLE) END AS hi0 FROM dp_column)
SELECT g.load_id, g.column_name, 'null_rate' AS finding FROM g JOIN a USING (column_name) WHERE ABS((g.r - g.n) * a.profiled_count - a.count_nulls * g.r) * 20 > g.r * a.profiled_count
UNION ALL SELECT g.load_id, g.column_name, 'value_range' FROM g JOIN a USING (column_name) WHERE g.lo < a.lo0 OR g.hi > a.hi0
UNION ALL SELECT g.load_id, g.column_name, 'distinct_count' FROM g JOIN a USING (column_name) WHERE g.d * 2 < a.count_unique OR g.d > 2 * a.count_unique
UNION ALL SELECT load_id, column_name, 'drift' FROM dist WHERE moved * 5 > 2 * whole
UNION ALL SELECT g.load_id, g.column_name, 'violations' FROM g JOIN a USING (column_name) JOIN b ON b.load_id = g.load_id AND b.column_name = g.column_name
  WHERE (b.k * a.profiled_count - a.count_violations * g.r) * 20 > g.r * a.profiled_count"""


_KINDS_OF = {
    "record_id": "long", "customer_id": "text", "item_id": "text", "amount": "long", "cost_cents": "long", "status_code": "text", "zone_code": "text", "ref_code": "text", "group_code": "text", "measure": "double",
    "ordered_on": "date", "updated_at": "timestamp",
}


def _every_value() -> str:
    """One row per stored row and column but the load: present, and the value as text or number by which it is ordered."""
    parts = []
    for name, kind in _KINDS_OF.items():
        t = f"CASE WHEN trim({name}, ' ') <> '' THEN {name} END" if kind == "text" else f"CAST({name} AS VARCHAR)" if kind == "date" else "NULL"
        x = {"long": f"CAST({name} AS DOUBLE)", "double": f"{name} + 0.0", "timestamp": f"CAST(epoch_us({name}) AS DOUBLE)"}.get(kind, "NULL")
        parts.append(f"SELECT load_id, '{name}' AS column_name, CAST({t} AS VARCHAR) AS t, CAST({x} AS DOUBLE) AS x FROM dq_record")
    return " UNION ALL ".join(parts)


_VALUES = f"WITH v AS ({_every_value()}), p AS (SELECT * FROM v WHERE t IS NOT NULL OR x IS NOT NULL)"
SQL["p2_counts"] = f"""{_VALUES}
SELECT load_id, column_name, COUNT(*) AS row_count, CAST(COUNT_IF(t IS NULL AND x IS NULL) AS BIGINT) AS count_nulls, round(COUNT_IF(t IS NULL AND x IS NULL) / COUNT(*), 9) AS null_rate,
  COUNT(DISTINCT CASE WHEN t IS NOT NULL OR x IS NOT NULL THEN (t, x) END) AS count_unique, MIN(t) AS min_value_text, MIN(x) AS min_value_number, MAX(t) AS max_value_text, MAX(x) AS max_value_number FROM v GROUP BY ALL"""
SQL["p2_cells"] = f"""WITH u AS ({_unpivoted()}),
g AS (SELECT load_id, column_name, COUNT(k) AS n FROM u GROUP BY ALL),
cell AS (SELECT column_name, b.low AS low, b.high AS high, NULL AS item, b.bucket_count AS c FROM (SELECT column_name, unnest(pmf) AS b FROM dp_column)
  UNION ALL SELECT column_name, NULL, NULL, i.item, i.item_count FROM (SELECT column_name, unnest(items) AS i FROM dp_column WHERE pmf IS NULL)),
share AS (SELECT *, SUM(c) OVER (PARTITION BY column_name) AS t FROM cell),
inside AS (SELECT u.load_id, s.column_name, s.low, s.item, COUNT(*) AS m FROM u JOIN share s ON s.column_name = u.column_name AND u.k IS NOT NULL AND (s.item = u.v OR (u.x >= s.low AND u.x < s.high)) GROUP BY ALL)
SELECT g.load_id, g.column_name, s.low, s.high, s.item, round(COALESCE(i.m, 0) / g.n, 9) AS share, round(s.c / s.t, 9) AS accepted_share,
  round((g.n - SUM(COALESCE(i.m, 0)) OVER (PARTITION BY g.load_id, g.column_name)) / g.n, 9) AS outside_share
FROM g JOIN share s USING (column_name) LEFT JOIN inside i ON i.load_id = g.load_id AND i.column_name = s.column_name AND i.low IS NOT DISTINCT FROM s.low AND i.item IS NOT DISTINCT FROM s.item"""
SQL["p2_logged"] = f"""WITH n AS (SELECT unnest({list(_KINDS_OF)!r}) AS column_name),
l AS (SELECT load_id, lower(trim(rule_name, ' ')) AS rule_name, primary_key, column_names FROM dq_violation WHERE primary_key IS NOT NULL AND rule_name IS NOT NULL),
b AS (SELECT load_id, n.column_name, rule_name, primary_key FROM (SELECT *, unnest(column_names) AS c FROM l) JOIN n ON n.column_name = lower(trim(c, ' '))
  UNION ALL SELECT load_id, a.column_name, l.rule_name, primary_key FROM l JOIN dp_column a ON lower(trim(a.rule_name, ' ')) = l.rule_name JOIN n ON n.column_name = a.column_name)
SELECT load_id, column_name, rule_name, COUNT(DISTINCT primary_key) AS count_violations FROM b WHERE load_id IN (SELECT load_id FROM dq_record) GROUP BY ALL"""
SQL["p2_quantiles"] = f"""{_VALUES},
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY load_id, column_name ORDER BY x, t) AS k, COUNT(*) OVER (PARTITION BY load_id, column_name) AS n FROM p)
SELECT load_id, column_name, q.pct, t AS value_text, x AS value_number FROM r, (SELECT unnest({PERCENTS!r}) AS pct) q WHERE k = GREATEST(1, (q.pct * n + 99) // 100)"""
SQL["p2_distances"] = f"""{_VALUES},
o AS (SELECT load_id, LAG(load_id) OVER (ORDER BY load_id) AS prior_load FROM (SELECT DISTINCT load_id FROM dq_record WHERE load_id IS NOT NULL)),
s AS (SELECT load_id, column_name, COUNT(*) AS size FROM p GROUP BY ALL),
w AS (SELECT o.load_id, p.column_name, x, t, COUNT(*) * ANY_VALUE(s.size) AS w FROM p JOIN o USING (load_id) JOIN s ON s.load_id = o.prior_load AND s.column_name = p.column_name GROUP BY ALL
  UNION ALL SELECT o.load_id, p.column_name, x, t, -COUNT(*) * ANY_VALUE(s.size) FROM p JOIN o ON o.prior_load = p.load_id JOIN s ON s.load_id = o.load_id AND s.column_name = p.column_name GROUP BY ALL),
c AS (SELECT load_id, column_name, SUM(SUM(w)) OVER (PARTITION BY load_id, column_name ORDER BY x, t) AS d FROM w GROUP BY load_id, column_name, x, t)
SELECT c.load_id, o.prior_load, c.column_name, round(CAST(MAX(abs(d)) AS DOUBLE) / (CAST(ANY_VALUE(a.size) AS DOUBLE) * CAST(ANY_VALUE(b.size) AS DOUBLE)), 9) AS ks_distance FROM c JOIN o USING (load_id) JOIN s a ON a.load_id = c.load_id AND a.column_name = c.column_name
  JOIN s b ON b.load_id = o.prior_load AND b.column_name = c.column_name GROUP BY ALL"""


# 5. Rows that fail to parse


def _layouts(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.layouts(table(spark, folder, "file_input"), table(spark, folder, "dq_field"))


def _parsed(spark: SparkSession, folder: str, keep: str) -> DataFrame:
    return rejects.parse(table(spark, folder, "raw_line"), _layouts(spark, folder), True, keep)


@query
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark, folder, "rejected").select("file_id", "line_no", "rule_name").distinct()


@query
def p5_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """The rejected records with the reason and the values read so far."""
    return rejects.rejected(_parsed(spark, folder, "rejected"))


@query
def p5_loaded(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.loaded(_parsed(spark, folder, "loaded"))


@query
def p5_valid(spark: SparkSession, folder: str) -> DataFrame:
    """Per file its valid records and their present values."""
    present = F.size(F.filter("row_values", lambda v: v.isNotNull()))
    return p5_loaded(spark, folder).groupBy("file_id").agg(F.count(F.lit(1)).alias("records"), F.sum(present).alias("present"))


@query
def p5_values(spark: SparkSession, folder: str) -> DataFrame:
    """The values of the valid records by their place, as held and in canonical form, one row each."""
    both = F.arrays_zip(F.col("row_values").alias("value"), F.col("canonical_values").alias("canonical"))
    each = p5_loaded(spark, folder).select("file_id", "line_no", F.posexplode(both).alias("place", "v"))
    return each.select("file_id", "line_no", (F.col("place") + 1).cast("bigint").alias("place"), "v.value", "v.canonical")


@query
def p5_assembled(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts on the records of all files as physical lines: raw_line cut at line breaks and assembled again."""
    raw, layout = table(spark, folder, "raw_line"), _layouts(spark, folder)
    pieces = F.split("line", "\n")
    lines = raw.where("file_id IS NOT NULL AND line_no IS NOT NULL AND line IS NOT NULL").select("file_id", "line_no", "line").distinct()
    step = lines.agg(F.coalesce(F.max(F.size(pieces)), F.lit(1))).first()[0]  # numbers for the breaks of a record
    physical = lines.select("file_id", "line_no", F.posexplode(pieces).alias("k", "line")).select("file_id", (F.col("line_no") * step + F.col("k")).alias("line_no"), "line")
    records = rejects.assemble(physical, layout).select("file_id", F.expr(f"CAST(line_no DIV {step} AS INT)").alias("line_no"), "line")
    return rejects.parse(records, layout, True).select("file_id", "line_no", "rule_name", "row_values")


# 3. Schemas that drift between files


def _matched(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files in order, their layouts, and the matches of their fields (rows per file, not per record)."""
    files, layout = drift.sequence(table(spark, folder, "file_input")), written(_layouts(spark, folder), "layouts")
    return files, layout, written(drift.matches(files, layout), "matches")


def _drift(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The same and the renames, verified on the records of the files that have gone and new fields."""
    files, layout, matched = _matched(spark, folder)
    asked = written(drift.asked(matched, layout), "asked")
    lines = table(spark, folder, "raw_line").join(asked.select("file_id"), "file_id", "left_semi")
    return files, layout, matched, written(drift.renames(drift.shares(matched, rejects.picked(lines, asked))), "renames")


@query
def p3_method(spark: SparkSession, folder: str) -> DataFrame:
    """Every change by similarity flooding alone, from names, types and nesting, without a look at values."""
    _, _, matched = _matched(spark, folder)
    return drift.changes(matched, drift.by_score(matched))


@query
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    _, _, matched, renamed = _drift(spark, folder)
    return drift.changes(matched, renamed).select("file_id", "change_kind", "field_name").distinct()


@query
def p3_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Every change with its old and new name or type."""
    _, _, matched, renamed = _drift(spark, folder)
    return drift.changes(matched, renamed)


@query
def p3_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of the consistent tables and their types."""
    files, layout, _, renamed = _drift(spark, folder)
    return drift.column_types(drift.columns(files, layout, renamed))


@query
def p3_united(spark: SparkSession, folder: str) -> DataFrame:
    """All valid records of all files as records of the consistent tables, each value in its column's common type."""
    files, layout, _, renamed = _drift(spark, folder)
    columns = written(drift.columns(files, layout, renamed), "columns")
    kinds = written(drift.column_types(columns), "column_types")
    return drift.unite(rejects.loaded(_parsed(spark, folder, "loaded")), columns, kinds)


@query
def p3_values(spark: SparkSession, folder: str) -> DataFrame:
    """The values of the united records, one row each."""
    return p3_united(spark, folder).select("table_name", "file_id", "line_no", F.explode("record").alias("column_name", "value"))


_RECORDS = r"""
WITH file AS (SELECT file_id, ANY_VALUE(metadata) AS metadata FROM file_input WHERE file_id IS NOT NULL GROUP BY file_id),
opt AS (SELECT file_id, metadata['input_path'] AS path, metadata['table_name'] AS table_name, TRY_CAST(metadata['modification_timestamp'] AS TIMESTAMPTZ) AS instant FROM file),
layout AS (SELECT file_id, table_name, instant, CASE WHEN regexp_matches(path, '[?&]delimiter=') THEN url_decode(regexp_extract(path, '[?&]delimiter=([^&]*)', 1)) ELSE ',' END AS delimiter,
  CASE WHEN regexp_matches(path, '[?&]quote=') THEN url_decode(regexp_extract(path, '[?&]quote=([^&]*)', 1)) ELSE '"' END AS quote, lower(regexp_extract(path, '[?&]header=([^&]*)', 1)) = 'true' AS header FROM opt),
field AS (SELECT file_id, ordinal_no, lower(trim(ANY_VALUE(field_name), ' ')) AS name, ANY_VALUE(nullable) AS nullable, ANY_VALUE(enum_values) AS enum_values, ANY_VALUE(regexp_pattern) AS regexp_pattern,
  COALESCE(ANY_VALUE(format_pattern), 'yyyy-MM-dd') AS pattern, lower(trim(ANY_VALUE(data_type_json), E' \n\t"')) AS kind FROM dq_field WHERE file_id IS NOT NULL GROUP BY file_id, ordinal_no),
typed AS (SELECT *, CASE WHEN kind LIKE '{%' THEN 'array' ELSE regexp_replace(kind, '\s', '', 'g') END AS type, CASE WHEN kind LIKE '{%' THEN '{"containsNull": ' || json_extract_string(kind, '$.containsnull') || ', "elementType": "' || json_extract_string(kind, '$.elementtype') || '", "type": "array"}' ELSE regexp_replace(kind, '\s', '', 'g') END AS shown,
  ROW_NUMBER() OVER (PARTITION BY file_id ORDER BY ordinal_no) AS place FROM field),
width AS (SELECT file_id, COUNT(*) AS fields FROM field GROUP BY 1),
line AS (SELECT DISTINCT r.file_id, r.line_no, r.line, COALESCE(l.delimiter, ',') AS delimiter, COALESCE(l.quote, '"') AS quote FROM raw_line r LEFT JOIN layout l USING (file_id) WHERE r.line <> '' AND NOT (COALESCE(l.header, FALSE) AND r.line_no = 0)),
-- Delimiters are character 1 and quotes character 2; every field begins with a delimiter.
plain AS (SELECT *, chr(1) || replace(replace(line, quote, chr(2)), delimiter, chr(1)) AS marked FROM line),
cut AS (SELECT *, regexp_extract_all(marked, '\x01(\x02(?:[^\x02]|\x02\x02)*\x02|[^\x01\x02]*)', 1) AS cells, NOT regexp_full_match(marked, '(\x01(\x02([^\x02]|\x02\x02)*\x02|[^\x01\x02\r\n]*))+') AS broken FROM plain),
shaped AS (SELECT c.*, CASE WHEN broken THEN 'record_quoting' WHEN len(cells) <> COALESCE(w.fields, 0) THEN 'record_column_count' END AS rule FROM cut c LEFT JOIN width w USING (file_id)),
cell AS (SELECT file_id, line_no, line, quote, delimiter, unnest(cells) AS cell, generate_subscripts(cells, 1) AS place FROM shaped WHERE rule IS NULL),
value AS (SELECT file_id, line_no, line, place, cell[1] = chr(2) AS quoted, replace(replace(CASE WHEN cell[1] = chr(2) THEN replace(cell[2:-2], chr(2) || chr(2), quote) ELSE cell END, chr(1), delimiter), chr(2), quote) AS v FROM cell),
given AS (SELECT t.*, x.line_no, x.line, x.quoted, x.v, trim(x.v, E' \t\n\r') AS s, NOT x.quoted AND trim(x.v, E' \t\n\r') = '' AS absent, regexp_extract(trim(x.v, E' \t\n\r'), '^[+-]?([0-9]*)', 1) AS whole,
  regexp_extract(trim(x.v, E' \t\n\r'), '\.([0-9]*)$', 1) AS fraction, regexp_full_match(trim(x.v, E' \t\n\r'), '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)') AS fixed FROM value x JOIN typed t USING (file_id, place)),
tried AS (SELECT *, CASE WHEN absent THEN nullable IS DISTINCT FROM FALSE
  WHEN enum_values IS NOT NULL AND NOT list_contains(enum_values, v) THEN FALSE WHEN regexp_pattern IS NOT NULL AND NOT regexp_full_match(v, regexp_pattern) THEN FALSE
  WHEN type IN ('integer', 'long') THEN regexp_full_match(s, '[+-]?[0-9]+') AND COALESCE(TRY_CAST(ltrim(s, '+') AS HUGEINT) BETWEEN CASE WHEN type = 'long' THEN -9223372036854775808 ELSE -2147483648 END AND CASE WHEN type = 'long' THEN 9223372036854775807 ELSE 2147483647 END, FALSE)
  WHEN type = 'double' THEN regexp_full_match(s, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?')
  WHEN type LIKE 'decimal(%' THEN fixed AND length(ltrim(whole, '0')) <= CAST(regexp_extract(type, '\((\d+),', 1) AS INT) - CAST(regexp_extract(type, ',(\d+)\)', 1) AS INT) AND length(fraction) <= CAST(regexp_extract(type, ',(\d+)\)', 1) AS INT)
  WHEN type = 'date' THEN regexp_full_match(v, regexp_replace(regexp_replace(pattern, '([^A-Za-z])', '[\1]', 'g'), '[yMd]', '[0-9]', 'g')) AND TRY_CAST(substr(v, instr(pattern, 'yyyy'), 4) || '-' || substr(v, instr(pattern, 'MM'), 2) || '-' || substr(v, instr(pattern, 'dd'), 2) AS DATE) IS NOT NULL
  WHEN type = 'boolean' THEN lower(v) IN ('true', 'false') ELSE TRUE END AS fits FROM given),
judged AS (SELECT file_id, line_no, line, BOOL_AND(fits) AS fits FROM tried GROUP BY ALL),
verdict AS (SELECT s.file_id, s.line_no, s.line, COALESCE(s.rule, CASE WHEN NOT COALESCE(j.fits, TRUE) THEN 'field_value' END) AS rule_name FROM shaped s LEFT JOIN judged j USING (file_id, line_no, line))
"""
SQL["p5_found"] = f"{_RECORDS} SELECT DISTINCT file_id, line_no, rule_name FROM verdict WHERE rule_name IS NOT NULL"
_CANONICAL = """CASE WHEN t.absent THEN NULL WHEN t.type IN ('integer', 'long', 'double') OR t.type LIKE 'decimal(%' THEN regexp_replace(CAST(TRY_CAST(t.s AS DECIMAL(38, 10)) AS VARCHAR), '\\.?0+$', '')
  WHEN t.type = 'date' THEN substr(t.v, instr(t.pattern, 'yyyy'), 4) || '-' || substr(t.v, instr(t.pattern, 'MM'), 2) || '-' || substr(t.v, instr(t.pattern, 'dd'), 2) WHEN t.type = 'boolean' THEN lower(t.v) ELSE t.v END"""
SQL["p5_values"] = f"{_RECORDS} SELECT t.file_id, t.line_no, t.place, CASE WHEN NOT t.absent THEN t.v END AS value, {_CANONICAL} AS canonical FROM tried t JOIN verdict USING (file_id, line_no, line) WHERE rule_name IS NULL"
SQL["p5_valid"] = f"{_RECORDS} SELECT file_id, COUNT(*) AS records, CAST(SUM(v) AS BIGINT) AS present FROM (SELECT file_id, line_no, line, COUNT_IF(NOT absent) AS v FROM tried GROUP BY ALL) JOIN verdict USING (file_id, line_no, line) WHERE rule_name IS NULL GROUP BY 1"

_DRIFT = _RECORDS.rstrip() + r""",
seq AS (SELECT file_id, LAG(file_id) OVER (PARTITION BY table_name ORDER BY instant, file_id) AS prior_id FROM layout WHERE table_name IS NOT NULL AND instant IS NOT NULL),
named AS (SELECT * FROM typed QUALIFY ROW_NUMBER() OVER (PARTITION BY file_id, name ORDER BY place) = 1),
pair AS (SELECT q.file_id, q.prior_id, o.name AS old_name, n.name AS new_name, o.place AS old_place, n.place AS new_place, o.shown AS old_type, n.shown AS new_type
  FROM (SELECT q.file_id, q.prior_id, name FROM seq q JOIN named m ON m.file_id = q.file_id WHERE q.prior_id IS NOT NULL UNION SELECT q.file_id, q.prior_id, name FROM seq q JOIN named m ON m.file_id = q.prior_id) q
  LEFT JOIN named o ON o.file_id = q.prior_id AND o.name = q.name LEFT JOIN named n ON n.file_id = q.file_id AND n.name = q.name),
gone AS (SELECT * FROM pair WHERE new_name IS NULL), come AS (SELECT * FROM pair WHERE old_name IS NULL),
good AS (SELECT t.file_id, t.line_no, t.line, t.place, CASE WHEN NOT absent THEN s END AS s, CASE WHEN absent THEN NULL WHEN type IN ('integer', 'long', 'double') OR type LIKE 'decimal(%' THEN CAST(TRY_CAST(s AS DECIMAL(38, 10)) AS VARCHAR)
  WHEN type = 'date' THEN substr(v, instr(pattern, 'yyyy'), 4) || '-' || substr(v, instr(pattern, 'MM'), 2) || '-' || substr(v, instr(pattern, 'dd'), 2) WHEN type = 'boolean' THEN lower(v) ELSE v END AS c
  FROM tried t JOIN verdict USING (file_id, line_no, line) WHERE rule_name IS NULL),
key AS (SELECT file_id, line_no, line, trim(c, ' ') AS k FROM good WHERE place = 1 AND s IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY file_id, k ORDER BY line_no, line) = 1),
held AS (SELECT g.file_id, key.k, g.place, g.c, g.s FROM good g JOIN key USING (file_id, line_no, line)),
cand AS (SELECT g.file_id, g.prior_id, g.old_name, n.new_name, g.old_place, n.new_place, g.old_type, n.new_type FROM gone g JOIN come n USING (file_id)),
share AS (SELECT c.file_id, c.old_name, c.new_name, c.old_type, c.new_type, COUNT_IF(a.c IS NOT DISTINCT FROM b.c OR a.s IS NOT DISTINCT FROM b.s) / COUNT(*) AS share
  FROM cand c JOIN held a ON a.file_id = c.prior_id AND a.place = c.old_place JOIN held b ON b.file_id = c.file_id AND b.place = c.new_place AND b.k = a.k GROUP BY ALL),
moved AS (SELECT * FROM share WHERE share >= 0.9 QUALIFY ROW_NUMBER() OVER (PARTITION BY file_id, old_name ORDER BY share DESC, new_name) = 1 AND ROW_NUMBER() OVER (PARTITION BY file_id, new_name ORDER BY share DESC, old_name) = 1),
change AS (SELECT file_id, 'renamed' AS change_kind, new_name AS field_name, old_name || ' -> ' || new_name AS detail FROM moved
  UNION ALL SELECT file_id, 'removed', old_name, old_type FROM gone WHERE (file_id, old_name) NOT IN (SELECT (file_id, old_name) FROM moved)
  UNION ALL SELECT file_id, 'added', new_name, new_type FROM come WHERE (file_id, new_name) NOT IN (SELECT (file_id, new_name) FROM moved)
  UNION ALL SELECT file_id, 'type_changed', new_name, old_type || ' -> ' || new_type FROM moved WHERE old_type <> new_type
  UNION ALL SELECT file_id, 'type_changed', new_name, old_type || ' -> ' || new_type FROM pair WHERE old_name IS NOT NULL AND new_name IS NOT NULL AND old_type <> new_type)
"""
SQL["p3_found"] = f"{_DRIFT} SELECT DISTINCT file_id, change_kind, field_name FROM change"
SQL["p3_changes"] = f"{_DRIFT} SELECT * FROM change"

_COLUMN = _DRIFT.replace("WITH file AS", "WITH RECURSIVE file AS", 1).rstrip() + r""",
numbered AS (SELECT file_id, table_name, ROW_NUMBER() OVER (PARTITION BY table_name ORDER BY instant, file_id) AS file_no, LAG(file_id) OVER (PARTITION BY table_name ORDER BY instant, file_id) AS prior_id FROM layout WHERE table_name IS NOT NULL AND instant IS NOT NULL),
own AS (SELECT m.file_id, m.name, m.place, m.shown, f.table_name, f.file_no, f.prior_id FROM named m JOIN numbered f USING (file_id)),
child AS (SELECT o.*, b.name AS prior_name FROM own o LEFT JOIN moved v ON v.file_id = o.file_id AND v.new_name = o.name LEFT JOIN named b ON b.file_id = o.prior_id AND b.name = COALESCE(v.old_name, o.name)),
root AS (SELECT file_id, name, file_id AS root_file, name AS root_name FROM child WHERE prior_name IS NULL UNION ALL SELECT c.file_id, c.name, r.root_file, r.root_name FROM child c JOIN root r ON r.file_id = c.prior_id AND r.name = c.prior_name),
first AS (SELECT file_id, name, table_name, ROW_NUMBER() OVER (PARTITION BY table_name, name ORDER BY file_no, place) AS n FROM child WHERE prior_name IS NULL),
taken AS (SELECT table_name, regexp_replace(name, '_[0-9]+$', '') AS name, list(CAST(regexp_extract(name, '_([1-9][0-9]{0,8})$', 1) AS BIGINT)) AS taken FROM first WHERE n = 1 AND regexp_matches(name, '_[1-9][0-9]{0,8}$') GROUP BY ALL),
col AS (SELECT f.file_id AS root_file, f.name AS root_name, f.table_name, CASE WHEN n = 1 THEN f.name ELSE f.name || '_' || CAST(list_filter(range(2, n + len(COALESCE(taken, [])) + 2), lambda k: NOT list_contains(COALESCE(taken, []), k))[n - 1] AS VARCHAR) END AS column_name
  FROM first f LEFT JOIN taken t ON t.table_name = f.table_name AND t.name = f.name),
typing AS (SELECT c.table_name, c.column_name, o.shown AS type, CASE WHEN o.shown LIKE 'decimal(%' THEN CAST(regexp_extract(o.shown, '\((\d+),', 1) AS INT) - CAST(regexp_extract(o.shown, ',(\d+)\)', 1) AS INT) WHEN o.shown = 'integer' THEN 10 WHEN o.shown = 'long' THEN 19 END AS whole,
  CASE WHEN o.shown LIKE 'decimal(%' THEN CAST(regexp_extract(o.shown, ',(\d+)\)', 1) AS INT) WHEN o.shown IN ('integer', 'long') THEN 0 END AS fraction FROM own o JOIN root r USING (file_id, name) JOIN col c USING (root_file, root_name)),
common AS (SELECT table_name, column_name, CASE WHEN COUNT(DISTINCT type) = 1 THEN ANY_VALUE(type) WHEN BOOL_AND(type IN ('integer', 'long')) THEN 'long' WHEN NOT BOOL_AND(type IN ('integer', 'long', 'double') OR type LIKE 'decimal(%') THEN 'string'
  WHEN BOOL_OR(type = 'double') OR MAX(whole) + MAX(fraction) > 38 THEN 'double' ELSE 'decimal(' || CAST(MAX(whole) + MAX(fraction) AS VARCHAR) || ',' || CAST(MAX(fraction) AS VARCHAR) || ')' END AS data_type FROM typing GROUP BY ALL)
"""
SQL["p3_columns"] = f"{_COLUMN} SELECT * FROM common"
SQL["p3_values"] = f"""{_COLUMN}
SELECT c.table_name, t.file_id, t.line_no, c.column_name, CASE WHEN t.absent THEN NULL WHEN k.data_type = 'string' THEN CASE WHEN t.type IN ('integer', 'long', 'double') OR t.type LIKE 'decimal(%' THEN t.s ELSE t.v END
  ELSE {_CANONICAL} END AS value
FROM tried t JOIN verdict USING (file_id, line_no, line) JOIN named m ON m.file_id = t.file_id AND m.place = t.place JOIN root r ON r.file_id = t.file_id AND r.name = m.name JOIN col c USING (root_file, root_name)
  JOIN common k ON k.table_name = c.table_name AND k.column_name = c.column_name WHERE rule_name IS NULL"""
