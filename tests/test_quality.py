"""Quality rules, samples, joins and introspection, on tables of a greenhouse; counts are held against DuckDB."""

import json
import random
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbrook.errors import PlumbrookError
from plumbrook.operators import quality_rules as r
from plumbrook.operators.join_quality import JoinQuality
from plumbrook.operators.quality import Quality, QualityConfig, file_row_numbers, result_json, take_in_turns
from plumbrook.plans import introspect

PLANT_RULES = [
    r.Rule("wet", "moisture >= 20", "soil is not dry"), r.enum_rule("bed", ["north", "south"]), r.not_null_rule("plant"), r.null_safe_rule("height", "grown", "height > 3"),
    r.unique_rule("tag", ["bed", "plant"]), r.all_of("fine", [r.Rule("a", "moisture < 90"), r.Rule("b", "height < 30")]), r.any_of("odd", [r.Rule("c", "moisture % 2 = 1"), r.Rule("d", "height IS NULL")]),
]
PLANT_SQL = {
    "wet": "moisture >= 20", "bed__enum_values": "bed IS NULL OR bed IN ('north', 'south')", "plant__not_null": "plant IS NOT NULL", "height__grown": "height IS NULL OR height > 3",
    "tag__unique": "COUNT(*) OVER (PARTITION BY bed, plant) = 1", "fine": "moisture < 90 AND height < 30", "odd": "moisture % 2 = 1 OR height IS NULL",
}


def rows(df, *columns):
    return sorted((tuple(x) for x in (df.select(*columns) if columns else df).collect()), key=str)


@pytest.fixture(scope="module")
def plants(spark):
    g = random.Random(5)
    maybe = lambda v: None if g.random() < 0.15 else v
    data = [(maybe(g.randint(0, 100)), maybe(g.choice(["north", "south", "east"])), maybe(g.randint(1, 200)), maybe(g.randint(1, 40))) for _ in range(600)]
    frame = spark.createDataFrame(data, "moisture int, bed string, plant int, height int").repartition(4)
    frame.createOrReplaceTempView("plants")
    con = duckdb.connect()
    con.register("plants", pd.DataFrame(data, columns=["moisture", "bed", "plant", "height"]).astype({c: "Int64" for c in ("moisture", "plant", "height")}))
    con.execute("CREATE TABLE w AS SELECT *, " + ", ".join(f'({e}) AS "{n}"' for n, e in PLANT_SQL.items()) + " FROM plants")
    return frame, con


def test_statistics_against_duckdb(plants):
    frame, con = plants
    q = Quality.from_df(frame).rules(PLANT_RULES)
    broken = {n: f'NOT COALESCE("{n}", FALSE)' for n in PLANT_SQL}
    assert dict(rows(q.rule_statistics())) == {n: con.execute(f"SELECT COUNT(*) FROM w WHERE {b}").fetchone()[0] for n, b in broken.items()}
    assert rows(q.table_statistics()) == con.execute(f"SELECT COUNT(*), COUNT_IF({' OR '.join(broken.values())}) FROM w").fetchall()
    about = {"moisture": ["wet", "fine", "odd"], "bed": ["bed__enum_values", "tag__unique"], "plant": ["plant__not_null", "tag__unique"], "height": ["height__grown", "fine", "odd"]}
    assert dict(rows(q.column_statistics())) == {c: con.execute(f"SELECT COUNT(*) FROM w WHERE {' OR '.join(broken[n] for n in names)}").fetchone()[0] for c, names in about.items()}


def test_rows_against_duckdb(plants):
    """A rule without value neither fails nor passes a row, though it counts as broken."""
    frame, con = plants
    q = Quality.from_df(frame).rules(PLANT_RULES)
    every = " AND ".join(f'"{n}"' for n in PLANT_SQL)
    text = lambda found: sorted((tuple(None if pd.isna(v) else v for v in x) for x in found), key=str)
    for got, condition in ((q.failing_rows(), f"NOT ({every})"), (q.passing_rows(), every)):
        assert rows(got) == text(con.execute(f"SELECT moisture, bed, plant, height FROM w WHERE {condition}").fetchall())
    got = Counter(x.rule_name for x in q.violations().collect())
    assert got == {n: c for n in PLANT_SQL if (c := con.execute(f'SELECT COUNT(*) FROM w WHERE NOT "{n}"').fetchone()[0])}


def test_what_a_violation_tells(spark):
    frame = spark.createDataFrame([(4, None, "x"), (9, 2, "y")], "tag int, `leaf size` int, note string")
    q = Quality.from_df(frame).rules([r.null_safe_rule("leaf size", "big", "`leaf size` > tag"), r.not_null_rule("leaf size")]).primary_key(["tag", "leaf size"])
    assert [x.asDict() for x in q.violations().where("rule_name LIKE '%big'").collect()] == [
        {"primary_key": ["9", "2"], "column_names": ["leaf size", "tag"], "row_values": ["2", "9"], "rule_name": "leaf size__big", "rule_expression": "`leaf size` IS NULL OR (`leaf size` > tag)"}
    ]
    assert rows(q.violations().where("rule_name = 'leaf size__not_null'"), "primary_key", "row_values") == [(["4", "__NULL__"], ["__NULL__"])]


def test_columns_the_table_lacks(spark):
    frame = spark.createDataFrame([(1,), (2,)], "tag int")
    q = Quality.from_df(frame).rules([r.Rule("tall", "tag > height")]).fields([r.Field("tag", '"integer"'), r.Field("height", '"double"')]).primary_key(["tag", "row"])
    names = {i.rule.name: i for i in q.infos()}
    assert names["tall"].existing == ("tag",) and names["tall"].missing == ("height",) and set(names["__no_missing_fields"].missing) == {"height", "row"}
    assert dict(rows(q.rule_statistics())) == {"tall": 2, "__no_missing_fields": 2, "tag__type": 0} and q.passing_rows().count() == 0
    assert q.violations().where("rule_name = 'tall'").first().row_values == ["1", "__MISSING__"] or q.violations().where("rule_name = 'tall'").count() == 2


def test_nothing_to_check(plants):
    frame, _ = plants
    q = Quality.from_df(frame)
    assert (q.failing_rows().count(), q.passing_rows().count(), q.violations().count(), q.rule_statistics().count(), q.row_sample().count()) == (0, 600, 0, 0, 0)
    empty = Quality.from_df(frame.limit(0)).rules(PLANT_RULES)
    assert rows(empty.table_statistics()) == [(0, 0)] and {v for _, v in rows(empty.rule_statistics())} == {0} and json.loads(result_json(empty.result()))["row_sample"] == []


@pytest.mark.parametrize(("rules", "words"), [([r.Rule("BED", "true")], "not unique"), ([r.Rule("x", "true"), r.Rule("X", "true")], "not unique"), ([r.Rule("sum", "moisture + plant")], "not boolean")])
def test_rules_that_are_none(plants, rules, words):
    with pytest.raises(PlumbrookError, match=words):
        Quality.from_df(plants[0]).rules(rules).rule_statistics()


def test_the_whole_result(plants):
    frame, _ = plants
    q = Quality.from_df(frame, "plants").rules(PLANT_RULES).metadata({"run": "7"}).config(QualityConfig(max_rows_per_rule=2))
    got = json.loads(result_json(q.result()))
    assert [c["name"] for c in got["columns"]] == frame.columns and [x["name"] for x in got["rules"]] == list(PLANT_SQL) and got["rules"][0]["description"] == "soil is not dry"
    assert {s["rule_name"]: s["violations"] for s in got["statistics"]["rule"]} == dict(rows(q.rule_statistics()))
    assert got["metadata"]["run"] == "7" and got["metadata"]["table_name"] == "plants" and json.loads(got["metadata"]["data_type_json"])["type"] == "struct"
    assert 2 <= len(got["row_sample"]) <= 2 * len(PLANT_SQL)


# Unique keys


@pytest.mark.parametrize("keys", [["bed"], ["bed", "plant"], ["moisture", "bed", "plant", "height"]])
def test_unique_keys_against_duckdb(plants, keys):
    frame, con = plants
    want = con.execute(f"SELECT COUNT_IF(n > 1) FROM (SELECT COUNT(*) OVER (PARTITION BY {', '.join(keys)}) AS n FROM plants)").fetchone()[0]
    assert rows(Quality.from_df(frame).rules([r.unique_rule("key", keys)]).rule_statistics()) == [("key__unique", want)]


def test_unique_keys_are_counted_before_rows_move(spark):
    """A third of all rows hold one key; no window over keys, and rows of the table are not shuffled by it."""
    frame = spark.range(3000).selectExpr("IF(id % 3 = 0, NULL, id) AS k", "id AS payload")
    q = Quality.from_df(frame).rules([r.unique_rule("k"), r.Rule("again", "(COUNT(*) OVER (PARTITION BY k)) = 1")])
    counted = q.rule_statistics()
    assert dict(rows(counted)) == {"k__unique": 1000, "again": 1000}
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and not re.search(r"hashpartitioning\([^)]*payload", plan)
    assert q.failing_rows().count() == 1000 and set(q.failing_rows().columns) == {"k", "payload"}


@pytest.mark.parametrize(("text", "keys"), [("(COUNT(*) OVER (PARTITION BY a, `b c`)) = 1", ["a", "b c"]), ("COUNT(*) OVER (PARTITION BY a) = 1", ["a"]), ("(COUNT(*) OVER (PARTITION BY a + 1)) = 1", None), ("(COUNT(*) OVER (PARTITION BY a)) = 2", None), ("a = 1", None)])
def test_unique_expressions_are_known(text, keys):
    assert r.unique_keys(text) == keys


# Rules


@pytest.mark.parametrize(
    ("rule", "holds"),
    [
        (r.enum_rule("v", ["Fern", "o'Moss"]), lambda v: v is None or v in ("Fern", "o'Moss")), (r.enum_rule("v", ["fern"], ignore_case=True), lambda v: v is None or v.upper() == "FERN"), (r.enum_rule("v", []), lambda v: v is None),
        (r.not_null_rule("v"), lambda v: v is not None), (r.regexp_rule("v", "^[a-z]+\\\\d?$"), lambda v: v is None or re.search(r"^[a-z]+\d?$", v) is not None),
        (r.null_safe_rule("v", "short", "LENGTH(v) < 5"), lambda v: v is None or len(v) < 5), (r.named_rule("v", "first", "v LIKE 'f%'"), lambda v: v is not None and v.startswith("f")),
    ],
)
def test_rules_against_plain_conditions(spark, rule, holds):
    values = [None, "", "Fern", "fern", "FERN", "o'Moss", "moss7", "fe rn", "ivy", "f" * 9]
    got = spark.createDataFrame([(v,) for v in values], "v string").coalesce(1).select(F.coalesce(F.expr(rule.expression), F.lit(False)).alias("x"))
    assert [x.x for x in got.collect()] == [bool(holds(v)) for v in values]


@pytest.mark.parametrize(
    ("target", "format", "good", "bad"),
    [
        (T.IntegerType(), None, ["7", "-0012", None], ["7x", "99999999999"]), (T.DateType(), "dd.MM.yyyy", ["05.06.2021", None], ["2021-06-05", "31.02.2021"]), (T.TimestampType(), "yyyy/MM/dd HH:mm", ["2021/06/05 23:59"], ["2021/06/05"]),
        (T.DoubleType(), None, ["1e3", "-.5"], ["1,5"]), (T.BooleanType(), None, ["true", "no"], ["maybe"]),
    ],
)
def test_type_rules(spark, target, format, good, bad):
    rule = r.type_rule(spark, "v", T.StringType(), target, format)
    got = spark.createDataFrame([(v,) for v in good + bad], "v string").coalesce(1).select(F.expr(rule.expression).alias("x")).collect()
    assert [x.x for x in got] == [True] * len(good) + [False] * len(bad)


def test_rules_without_a_way_or_a_name(spark):
    assert r.type_rule(spark, "v", T.DateType(), T.ArrayType(T.LongType())).expression == "false"
    tall = r.rule(((F.col("leaf size") > 1) & F.col("bed").isin("a", "b")).alias("tall"))
    assert tall.name == "tall" and introspect.referenced_columns(spark, tall.expression) == ["bed", "leaf size"]
    frame = spark.createDataFrame([(2, "a"), (0, "a"), (5, "c")], "`leaf size` int, bed string")
    assert rows(Quality.from_df(frame).rules([tall]).rule_statistics()) == [("tall", 2)]
    with pytest.raises(PlumbrookError, match="alias"):
        r.rule(F.col("height") > 1)


def test_rules_of_declared_fields(spark):
    """Each row breaks what its note says, nothing else."""
    data = [("1", "fern", "01.05.2020", "ok", "none"), ("2", "fern", "01.05.2020", None, "note__not_null"), ("x", "fern", None, "ok", "tag__type"), (None, "moss", None, "ok", "plant__enum_values,tag__not_null,__primary_key_not_null"),
            ("3", None, "2020-05-01", "ok", "day__type"), ("4", "fern", None, "Bad", "note__regexp"), ("5", None, None, "ok", "__primary_key_unique"), ("5", None, None, "ok", "__primary_key_unique")]
    frame = spark.createDataFrame(data, "tag string, plant string, day string, note string, broken string")
    fields = [r.Field("tag", '"integer"', nullable=False), r.Field("plant", '"string"', enum_values=("fern", "ivy")), r.Field("day", '"date"', format="dd.MM.yyyy"), r.Field("note", '"string"', nullable=False, regexp="^[a-z]*$"), r.Field("broken", '"string"')]
    q = Quality.from_df(frame).fields(fields).primary_key(["tag"]).config(QualityConfig(fail_on_extra_columns=True))
    wide = q.wide()
    names = [i.rule.name for i in q.infos()]
    assert "__no_extra_fields" not in names and "__no_missing_fields" not in names
    for x in wide.collect():
        assert {n for n in names if x[n] is False} == {n for n in x.broken.split(",") if n != "none"}, x
    extra = r.schema_rules(spark, frame.schema, fields[:2], [], True)
    assert next(x for x in extra if x.name == "__no_extra_fields").description.endswith("day, note, broken")


# Rules in SQL


def test_sql_rules(spark, plants):
    _, con = plants
    spark.createDataFrame([("north",), ("south",)], "name string").createOrReplaceTempView("beds")
    q = Quality.from_sql(spark, """
SELECT
  *,
  -- roots need water;
  -- at least a fifth
  moisture >= 20 AS wet,
  EXISTS (SELECT 1 FROM beds b WHERE b.name = p.bed) AS known_bed -- of the list
FROM plants p WHERE height IS NOT NULL""")
    assert [x.name for x in q._rules] == ["wet", "known_bed"] and q._rules[0].description == "roots need water;\nat least a fifth" and q.columns == ["moisture", "bed", "plant", "height"]
    want = con.execute("SELECT COUNT_IF(NOT COALESCE(moisture >= 20, FALSE)), COUNT_IF(bed IS NULL OR bed NOT IN ('north', 'south')) FROM plants WHERE height IS NOT NULL").fetchone()
    assert dict(rows(q.rule_statistics())) == {"wet": want[0], "known_bed": want[1]}


@pytest.mark.parametrize(("sql", "words"), [("SELECT bed, moisture > 1 AS wet FROM plants", "star"), ("SELECT *, moisture > 1 FROM plants", "alias"), ("TRUNCATE TABLE plants", "no query"), ("SELECT *, true AS x FROM meadow", "meadow")])
def test_sql_that_holds_no_rules(spark, plants, sql, words):
    with pytest.raises(PlumbrookError, match=words):
        Quality.from_sql(spark, sql)


def test_tables_by_name(spark, plants):
    assert Quality.from_table(spark, "plants").rules([r.not_null_rule("bed")])._metadata == {"table_name": "plants"}
    with pytest.raises(PlumbrookError, match="orchard"):
        Quality.from_table(spark, "orchard")


# Samples


def plain_turns(queues, per_rule, most):
    """Each rule in turn names its best row that is not chosen yet; written with lists only."""
    chosen, used = [], {k: 0 for k in queues}
    while len(chosen) < most:
        before = len(chosen)
        for k in queues:
            rest = [(row, broken) for row, broken in queues[k] if row not in chosen]
            if rest and used[k] < per_rule and len(chosen) < most:
                row, broken = rest[0]
                chosen.append(row)
                for b in broken:
                    used[b] += 1
        if len(chosen) == before:
            break
    return set(chosen)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sets(st.integers(0, 2), min_size=1), max_size=12), st.integers(0, 4), st.integers(0, 8), st.randoms(use_true_random=False))
def test_turns(broken, per_rule, most, shuffler):
    queues = {}
    for rule in range(3):
        own = [(row, sorted(b)) for row, b in enumerate(broken) if rule in b]
        shuffler.shuffle(own)
        queues[rule] = own
    ranked = [(rule, k + 1, row, b) for rule, own in queues.items() for k, (row, b) in enumerate(own)]
    assert take_in_turns(ranked, 3, per_rule, most) == plain_turns(queues, per_rule, most)


@pytest.mark.parametrize("partitions", [1, 5])
def test_sample_is_the_rows_of_least_hash(spark, partitions):
    frame = spark.range(400).select(F.col("id").cast("int").alias("seed")).repartition(partitions)
    q = Quality.from_df(frame).rules([r.Rule("low", "seed < 100")]).config(QualityConfig(max_rows_per_rule=7))
    by_hash = frame.where("seed >= 100").select("seed", F.hash("seed").bitwiseAND(0x7FFFFFFF).alias("h")).orderBy("h").limit(7).collect()
    assert {int(x.row[0]) for x in q.row_sample().collect()} == {x.seed for x in by_hash}
    assert {tuple(x.violated_rule_names) for x in q.row_sample().collect()} == {("low",)}
    assert q.config(QualityConfig(sample_rows=False)).row_sample().count() == 0


@pytest.mark.parametrize("partitions", [1, 4])
def test_numbers_of_rows_in_a_file(spark, partitions):
    frame = spark.range(37, numPartitions=partitions).withColumn("n", F.monotonically_increasing_id())
    assert [x.n for x in file_row_numbers(frame, "n").orderBy("id").collect()] == list(range(37))


def test_a_file_with_bad_records(spark, tmp_path):
    """Bad records are found, and the sample holds the first and the last of them."""
    path = tmp_path / "seed list.csv"
    lines = [f"{k}|plant {k}" if 5 < k < 190 and k % 3 else f"{k}|plant|{k}|extra" for k in range(200)]
    path.write_text("tag|plant\n" + "\n".join(lines) + "\n")
    q = Quality.from_path(spark, f"{tmp_path}/seed%20list.csv?sos-format=csv&header=true&delimiter=%7C".replace("%20", " ")).config(QualityConfig(max_rows_per_rule=4))
    bad = [k for k, line in enumerate(lines) if line.count("|") > 1]
    assert dict(rows(q.rule_statistics())) == {"__record_not_corrupted": len(bad)}
    got = sorted(x.row_id for x in q.row_sample().collect())
    assert len(got) == 4 and got[0] == bad[0] and got[-1] == bad[-1] and set(got) <= set(bad)
    assert q._metadata["file_name"] == "seed list.csv" and q.result().first().metadata["size"] == str(path.stat().st_size)


# Joins


@pytest.fixture(scope="module")
def beds(spark):
    g = random.Random(12)
    key = lambda: g.choice([None, *range(6)])
    a, b = [(key(), g.choice("xy"), k) for k in range(40)], [(g.choice([None, *range(3, 9)]), g.choice("yz"), k) for k in range(25)]
    left, right = spark.createDataFrame(a, "bed int, side string, no int"), spark.createDataFrame(b, "bed_id int, wing string, no int")
    con = duckdb.connect()
    con.register("a", pd.DataFrame(a, columns=["bed", "side", "no"]).astype({"bed": "Int64"}))
    con.register("b", pd.DataFrame(b, columns=["bed_id", "wing", "no"]).astype({"bed_id": "Int64"}))
    return left, right, con


@pytest.mark.parametrize("null_safe", [True, False])
@pytest.mark.parametrize(("left_keys", "right_keys"), [(["bed"], ["bed_id"]), (["bed", "side"], ["bed_id", "wing"])])
def test_join_sizes_are_those_of_joins(beds, left_keys, right_keys, null_safe):
    left, right, con = beds
    got = JoinQuality.equi(left, right, left_keys, right_keys, null_safe).statistics().first()
    same = " AND ".join(f"a.{x} {'IS NOT DISTINCT FROM' if null_safe else '='} b.{y}" for x, y in zip(left_keys, right_keys, strict=True))
    for how in ("inner", "left", "right", "full"):
        assert got[how] == con.execute(f"SELECT COUNT(*) FROM a {how} JOIN b ON {same}").fetchone()[0]
    assert (got.left_rows, got.right_rows, got.cross) == (40, 25, 1000)
    keys = ", ".join(left_keys)
    assert got.left_distinct == con.execute(f"SELECT COUNT(*) FROM (SELECT DISTINCT {keys} FROM a WHERE {' AND '.join(f'{k} IS NOT NULL' for k in left_keys)})").fetchone()[0]


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "cross"])
def test_what_each_join_risks(beds, how):
    """Rules by what the join keeps: keys without partner, keys with several."""
    left, right, con = beds
    j = JoinQuality.equi(left, right, ["bed"], ["bed_id"]).how(how)
    sides = {"inner": ("left", "right"), "left": ("right",), "right": ("left",), "full": ("left", "right"), "cross": ()}[how]
    counts = con.execute("SELECT COALESCE(l, 0), COALESCE(r, 0) FROM (SELECT bed, COUNT(*) AS l FROM a GROUP BY 1) x FULL JOIN (SELECT bed_id, COUNT(*) AS r FROM b GROUP BY 1) y ON bed IS NOT DISTINCT FROM bed_id").fetchall()
    want = {}
    for side in sides:
        own = [c[side == "right"] for c in counts]
        want |= {f"{side}_key__{'dropping' if how == 'inner' else 'missing'}": own.count(0), f"{side}_key__multiplying": sum(n > 1 for n in own)}
    assert dict(rows(j.rule_statistics())) == want
    report = j.report().first()
    assert report.join_info.join_type == how.upper() and re.fullmatch("[0-9a-f]{7}", report.key) and report.result.statistics.table.rows == len(counts)


def test_joins_that_are_none(beds):
    left, right, _ = beds
    with pytest.raises(PlumbrookError, match="diagonal"):
        JoinQuality.equi(left, right, ["bed"], ["bed_id"]).how("diagonal")
    with pytest.raises(PlumbrookError):
        JoinQuality.equi(left, right, ["bed", "side"], ["bed_id"])


def test_joins_by_any_condition(beds):
    left, right, con = beds
    condition = (F.col("left.bed") < F.col("right.bed_id")) & (F.col("left.side") == F.col("right.wing"))
    derived = JoinQuality.theta(left, right, condition)
    assert (derived.left_keys, derived.right_keys) == (("bed", "side"), ("bed_id", "wing"))
    want = con.execute("SELECT COUNT(*) FROM a JOIN b ON a.bed < b.bed_id AND a.side = b.wing").fetchone()[0]
    assert derived.statistics().first().inner == want == JoinQuality.theta(left, right, condition, ["bed", "side"], ["bed_id", "wing"]).statistics().first().inner
    with pytest.raises(PlumbrookError, match="right side"):
        JoinQuality.theta(left, right, F.col("left.bed") > 3)


# Introspection


@pytest.mark.parametrize(("name", "quoted"), [("leaf_1", "leaf_1"), ("leaf size", "`leaf size`"), ("1st", "`1st`"), ("a`b", "`a``b`")])
def test_quotes(name, quoted):
    assert introspect.quote_if_needed(name) == quoted


@pytest.mark.parametrize(
    ("sql", "tables"),
    [
        ("SELECT 1", []), ("SELECT * FROM soil s, (SELECT tag FROM seeds) t WHERE s.tag = t.tag", ["seeds", "soil"]), ("WITH soil AS (SELECT 1 AS a), unused AS (SELECT * FROM weeds) SELECT * FROM soil", []),
        ("SELECT (SELECT MAX(v) FROM gauges) FROM soil UNION ALL SELECT 2 FROM lab.tests", ["gauges", "lab.tests", "soil"]), ("SELECT * FROM soil WHERE tag IN (SELECT tag FROM sold)", ["soil", "sold"]),
    ],
)
def test_tables_of_queries(spark, sql, tables):
    assert introspect.referenced_tables(spark, sql) == tables
    introspect.assert_query(spark, sql)


@pytest.mark.parametrize("sql", ["CREATE TABLE soil (a INT)", "DELETE FROM soil", "DESCRIBE soil", "SET x = 1", "INSERT INTO soil SELECT 1"])
def test_statements_that_are_no_queries(spark, sql):
    with pytest.raises(PlumbrookError, match="no query"):
        introspect.assert_query(spark, sql)


def test_columns_and_aliases(spark):
    assert introspect.referenced_columns(spark, "greatest(b, s.a) > 1 AND `c d` IS NULL") == ["b", "c d", "s.a"]
    assert introspect.alias_of(spark.range(2).alias("bed")) == "bed" and introspect.alias_of(spark.range(2)) is None
