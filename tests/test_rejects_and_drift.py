"""Records that fail to parse, and schemas that drift between files."""

import datetime
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbrook.functions import declared_types as types
from plumbrook.operators import drift, rejects

FILE = "file_id bigint, path string, table_name string, file_format string, metadata map<string,string>"
FIELD = "file_id bigint, ordinal_no int, field_name string, data_type_json string, nullable boolean, enum_values array<string>, format_pattern string, regexp_pattern string"
LINE = "file_id bigint, line_no int, line string, arrived_at timestamp"
NOON = datetime.datetime(2024, 1, 1, 12)


def layout(fields, **options):
    listed = [{"ordinal_no": k, "field_name": f"f{k}", "nullable": True} | f for k, f in enumerate(fields)]
    return rejects.Layout(json.dumps({"delimiter": ",", "quote": '"', "header": False, "fields": listed} | options))


@pytest.mark.parametrize(
    ("line", "rule"),
    [
        ("a,1", None), ('"a",1', None), ('"a ""b"", c",1', None), ('"a\nb",1', None), ('"a,1', "record_quoting"), ('"a"x,1', "record_quoting"), ('"a" ,1', "record_quoting"), ('a"b,1', "record_quoting"),
        (' "a",1', "record_quoting"), ("a\nb,1", "record_quoting"), ("a", "record_column_count"), ("a,1,", "record_column_count"), ('"a,1,2', "record_quoting"), ("a,x", "field_value"), ("a,", None), ('a,""', "field_value"), ("a, 12 ", None),
        ("a,2147483648", "field_value"), ("a,-2147483648", None), ("a,+5", None), ("a,1.0", "field_value"), ("a,1_0", "field_value"), ("a,١", "field_value"), ("x" * 300_000 + ",1", None),
    ],
)
def test_structure_and_integers(line, rule):
    assert layout([{"data_type_json": '"string"'}, {"data_type_json": '"integer"'}]).read(line)[0] == rule


@pytest.mark.parametrize(
    ("field", "good", "bad"),
    [
        ({"data_type_json": '"long"'}, ["9223372036854775807", " -5 "], ["9223372036854775808", "1e3", "--1"]),
        ({"data_type_json": '"double"'}, ["1", ".5", "5.", "1e-3", "-2.5E+7", " 3 "], ["NaN", "Infinity", "1d", "1,5", "e5", "."]),
        ({"data_type_json": ' "Decimal(5, 2)"\n'}, ["123.45", "-0.1", "000.5", "7"], ["1234", "1.234", "1e2", "1.2.3", "N/A"]),
        ({"data_type_json": '"decimal(3,0)"'}, ["999", "-1"], ["1000", "1.5"]),
        ({"data_type_json": '"date"'}, ["2024-02-29"], ["2023-02-29", "2024-2-29", "29.02.2024", "2024-13-01", " 2024-01-01"]),
        ({"data_type_json": '"date"', "format_pattern": "dd.MM.yyyy"}, ["29.02.2024"], ["2024-02-29", "30.02.2024"]),
        ({"data_type_json": '"boolean"'}, ["true", "FALSE"], ["yes", "1", "t"]),
        ({"data_type_json": '"string"', "enum_values": ["foo", "bar"]}, ["foo"], ["Foo", "foo ", "baz"]),
        ({"data_type_json": '"string"', "regexp_pattern": "[A-H]_[0-9]{3}"}, ["A_123"], ["A_1234", "xA_123", "a_123"]),
        ({"data_type_json": '{"type":"array","elementType":"string","containsNull":true}'}, ["a|b", "x"], []),
        ({"data_type_json": '"string"', "nullable": False}, ["x", '""'], ["  "]),
        ({"data_type_json": '"string"', "regexp_pattern": "("}, [], ["x"]),
    ],
)
def test_field_constructors(field, good, bad):
    own = layout([{"data_type_json": '"string"'}, field])
    assert [v for v in good if own.read(f"k,{v}")[0] is not None] == []
    assert [v for v in bad if own.read(f"k,{v}")[0] != ("field_value" if "," not in v else "record_column_count")] == []


def test_odd_options():
    assert layout([{}], delimiter="||").read("a")[0] == "file_options"
    assert layout([{}, {}], quote="").read('"a,b')[0] is None
    assert layout([{}, {}], delimiter="\t", quote="'").read("'a''b'\tc")[2] == ["a'b", "c"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='a,"\n ', max_size=6), min_size=2, max_size=4))
def test_written_records_are_read_again(values):
    line = ",".join('"' + v.replace('"', '""') + '"' for v in values)
    assert layout([{"data_type_json": '"string"'}] * len(values)).read(line)[:3] == (None, None, values)


def plain_verdict(line, count):
    """The structure rule, character by character."""
    fields, at, n = 0, 0, len(line)
    while True:
        fields += 1
        if at < n and line[at] == '"':
            at += 1
            while True:
                end = line.find('"', at)
                if end < 0:
                    return "record_quoting"
                if line[end + 1 : end + 2] == '"':
                    at = end + 2
                    continue
                at = end + 1
                break
            if at < n and line[at] != ",":
                return "record_quoting"
        else:
            end = line.find(",", at)
            end = n if end < 0 else end
            if '"' in line[at:end]:
                return "record_quoting"
            at = end
        if at >= n:
            return None if fields == count else "record_column_count"
        at += 1


@settings(max_examples=1000, deadline=None)
@given(st.text(alphabet='ab,"', min_size=1, max_size=12))
def test_structure_against_plain_rule(line):
    assert layout([{"data_type_json": '"string"'}] * 3).read(line)[0] == plain_verdict(line, 3)


def tables(spark, files, fields, lines):
    return spark.createDataFrame(files, FILE), spark.createDataFrame(fields, FIELD), spark.createDataFrame(lines, LINE)


def test_layouts_and_parse(spark):
    meta = {"input_path": "a/b.csv?sos-format=csv&delimiter=%3B&header=TRUE&quote=%27"}
    files, fields, lines = tables(
        spark,
        [(1, "p", None, None, meta), (1, "p", None, None, meta), (2, None, None, None, None), (None, None, None, None, None)],
        [(1, 0, "id", '"integer"', False, None, None, None), (1, 1, "v", '"string"', None, None, None, None), (1, 1, "v", '"string"', None, None, None, None), (2, 0, "id", None, None, None, None, None)],
        [(1, 0, "id;v", NOON), (1, 1, "1;'a;b'", NOON), (1, 1, "1;'a;b'", NOON), (1, 2, "x;1", NOON), (1, 2, "x;1", None), (1, 3, "", NOON), (1, 4, None, NOON), (2, 0, "whole, line", NOON), (2, 1, "y", None), (3, 1, "z", NOON), (None, None, "q", None)],
    )
    parsed = rejects.parse(lines.withColumn("layout", F.lit("clash")), rejects.layouts(files, fields), once=True)
    bad = sorted((r.file_id, r.line_no, r.rule_name) for r in rejects.rejected(parsed).where("file_id IS NOT NULL").collect())
    assert bad == [(1, 2, "field_value"), (2, 0, "record_column_count"), (3, 1, "record_column_count")]
    good = sorted((r.file_id, r.line_no, r.row_values) for r in rejects.loaded(parsed).collect())
    assert good == [(1, 1, ["1", "a;b"]), (2, 1, ["y"])]
    assert rejects.parse(lines.limit(0), rejects.layouts(files.limit(0), fields.limit(0))).count() == 0


def test_types():
    assert types.canonical_type(' "Int"\n') == "integer" and types.canonical_type("nonsense") == "nonsense" and types.canonical_type(None) == "string"
    a = types.canonical_type('{"type":"array","elementType":"integer","containsNull":true}')
    assert a == types.canonical_type('{"containsNull": true, "elementType": "int", "type": "array"}') != types.canonical_type('{"type":"array","elementType":"string","containsNull":true}')
    assert types.common_type(["integer", "long"]) == "long" and types.common_type(["long", "decimal(12,2)"]) == "decimal(21,2)" and types.common_type(["double", "integer"]) == "double" and types.common_type(["date", "integer"]) == "string"
    number = types.canonical_value("decimal(9,3)")
    assert number(" 12.500 ") == "12.5" and number("-0.0") == "0" and number("1e3") == "1000" and number("x") == "x"


def meta(table, moment, options="header=false"):
    return {"table_name": table, "modification_timestamp": moment, "input_path": f"f?{options}"}


@pytest.fixture(scope="module")
def drifting(spark):
    files = [
        (5, "p", None, None, meta("t", "2024-01-01T10:00:00+09:00")),  # 01:00 UTC, the first
        (3, "p", None, None, meta("t", "2024-01-01T02:00:00.5Z")),
        (4, "p", None, None, meta("t", "2024-01-01T03:00:00Z")),
        (4, "p", None, None, meta("t", "2024-01-01T03:00:00Z")),
        (9, "p", None, None, meta("other", "2024-01-01T03:00:00Z")),
        (8, "p", None, None, {}), (7, "p", None, None, None),
    ]
    f = lambda file, no, name, kind: (file, no, name, json.dumps(kind), True, None, None, None)
    fields = [
        f(5, 0, "id", "integer"), f(5, 1, "name", "string"), f(5, 2, "amount", "double"), f(5, 3, "note", "string"),
        f(3, 0, " ID ", "integer"), f(3, 2, "qzx", "string"), f(3, 1, "total", "string"), f(3, 3, "extra", "string"),
        f(4, 0, "id", "long"), f(4, 1, "total", "string"), f(4, 2, "qzx", "string"), f(4, 3, "extra", "string"), f(9, 0, "k", "string"),
    ]
    lines = [(5, k, f"{k},n{k}, {k}.50 ,x{k % 2}", NOON) for k in range(1, 11)] + [(5, 3, "3,n3, 3.50 ,x1", None)]
    lines += [(3, 50 - k, f"{k},{k}.50,n{k},{'y' if k > 1 else ''}", NOON) for k in range(1, 11)] + [(3, 99, 'bad"', NOON)]
    lines += [(4, k, f"{k},{k}.50,n{k},y", NOON) for k in range(5, 8)] + [(9, 1, "k", NOON)]
    return tables(spark, files, fields, lines)


def run(drifting):
    files, fields, lines = drifting
    layout = rejects.layouts(files, fields)
    ordered, records = drift.sequence(files), rejects.loaded(rejects.parse(lines, layout, once=True))
    matched = drift.matches(ordered, layout)
    renamed = drift.renames(drift.shares(matched, rejects.picked(lines, drift.asked(matched, layout))))
    return ordered, layout, records, matched, renamed


def test_changes(drifting):
    _, _, _, matched, renamed = run(drifting)
    got = sorted((r.file_id, r.change_kind, r.field_name) for r in drift.changes(matched, renamed).collect())
    assert got == [(3, "added", "extra"), (3, "removed", "note"), (3, "renamed", "qzx"), (3, "renamed", "total"), (3, "type_changed", "total"), (4, "type_changed", "id")]


def test_union(drifting):
    ordered, layout, records, _, renamed = run(drifting)
    columns = drift.columns(ordered, layout, renamed)
    kinds = {(r.table_name, r.column_name): r.data_type for r in drift.column_types(columns).collect()}
    assert kinds == {("t", "id"): "long", ("t", "name"): "string", ("t", "amount"): "string", ("t", "note"): "string", ("t", "extra"): "string", ("other", "k"): "string"}
    united = drift.unite(records, columns)
    assert united.count() == 24
    table = drift.wide(united, drift.column_types(columns), "t")
    assert dict(table.dtypes)["id"] == "bigint" and table.where("file_id = 3 AND id = 4").first().asDict() == {"file_id": 3, "line_no": 46, "amount": "4.50", "extra": "y", "id": 4, "name": "n4", "note": None}


def test_union_converts_to_the_common_type(spark):
    files = [(k, "p", None, None, meta("t", f"2024-01-0{k}T00:00:00Z")) for k in (1, 2)]
    f = lambda file, no, name, kind, pattern=None: (file, no, name, json.dumps(kind), True, None, pattern, None)
    fields = [f(1, 0, "id", "integer"), f(1, 1, "day", "date", "dd.MM.yyyy"), f(1, 2, "b", "boolean"), f(1, 3, "n", "integer"), f(1, 4, "x", "integer"), f(1, 5, "d", "date", "dd.MM.yyyy")]
    fields += [f(2, 0, "id", "integer"), f(2, 1, "day", "string"), f(2, 2, "b", "string"), f(2, 3, "n", "string"), f(2, 4, "x", "decimal(9,2)"), f(2, 5, "d", "date")]
    files, fields, lines = tables(spark, files, fields, [(1, 1, "7,17.11.2023,TRUE, 007 ,5,17.11.2023", NOON), (2, 1, "07,17.11.2023,TRUE,007,5.00,2023-11-17", NOON), (2, 2, "8,,x,,1.50,", NOON)])
    layout = rejects.layouts(files, fields)
    columns = drift.columns(drift.sequence(files), layout, spark.createDataFrame([], "file_id bigint, old_name string, new_name string, score double, share double"))
    got = {(r.file_id, r.line_no): r.record for r in drift.unite(rejects.loaded(rejects.parse(lines, layout, once=True)), columns).collect()}
    same = {"id": "7", "day": "17.11.2023", "b": "TRUE", "n": "007", "x": "5", "d": "2023-11-17"}
    assert got == {(1, 1): same, (2, 1): same, (2, 2): {"id": "8", "day": None, "b": "x", "n": None, "x": "1.5", "d": None}}


@pytest.mark.parametrize("seed", range(4))
def test_columns_against_a_walk(spark, seed):
    """Long sequences of files whose fields come, go, return and are renamed, against a walk file by file."""
    import random

    r = random.Random(seed)
    names = ["a", "b", "c", "a_2", "b_3"]
    files, fields, renamed, want = [], [], [], {}
    for table in ("t", "u"):
        current, taken, roots = {}, {}, []
        for n in range(r.choice([1, 2, 9, 23])):
            file = 100 * (table == "u") + n
            own = r.sample(names, r.randint(0, 4))
            files.append((file, "p", None, None, meta(table, f"2024-01-01T00:{n:02d}:00Z")))
            fields += [(file, k, f" {x.upper()}", '"string"', True, None, None, None) for k, x in enumerate(own)]
            gone, come = [x for x in current if x not in own], [x for x in own if x not in current]
            moved = dict(zip(come, gone, strict=False)) if r.random() < 0.5 else {}
            renamed += [(file, old, new, 1.0, 1.0) for new, old in moved.items()]
            column = {}
            for x in own:
                column[x] = current.get(moved.get(x, x))
                if column[x] is None:
                    column[x] = (table, x, len(roots))
                    roots.append(column[x])
            current = column
            want |= {(file, x): c for x, c in column.items()}
    files, fields = spark.createDataFrame(files, FILE), spark.createDataFrame(fields, FIELD)
    moved = spark.createDataFrame(renamed, "file_id bigint, old_name string, new_name string, score double, share double")
    layout = rejects.layouts(files, fields)
    rows = drift.columns(drift.sequence(files), layout, moved).collect()
    place = {(f.file_id, f.ordinal_no): f.field_name.strip().lower() for f in fields.collect()}
    got = {(x.file_id, place[x.file_id, x.field_no]): (x.table_name, x.column_name) for x in rows}
    assert got.keys() == want.keys()
    pairs = {(got[k], want[k]) for k in want}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})  # one name per column, one column per name
    assert all(a[1] == b[1] or a[1].startswith(f"{b[1]}_") for a, b in pairs)


def test_no_shared_records_is_no_rename(spark, drifting):
    files, fields, lines = drifting
    layout = rejects.layouts(files, fields)
    matched = drift.matches(drift.sequence(files), layout)
    sides = lambda own, m, at: rejects.picked(own, drift.asked(m, at))
    none = sides(lines.where("file_id <> 5"), matched, layout)
    kinds = sorted(r.change_kind for r in drift.changes(matched, drift.renames(drift.shares(matched, none))).where("file_id = 3").collect())
    assert kinds == ["added"] * 3 + ["removed"] * 3
    layout = rejects.layouts(files.limit(0), fields.limit(0))
    empty = drift.matches(drift.sequence(files.limit(0)), layout)
    renamed = drift.renames(drift.shares(empty, sides(lines.limit(0), empty, layout)))
    assert drift.changes(empty, renamed).count() == 0 and drift.columns(drift.sequence(files.limit(0)), layout, renamed).count() == 0


def test_shares_of_all_pairs(spark, drifting):
    """Against counting record by record."""
    files, fields, lines = drifting
    layout = rejects.layouts(files, fields)
    matched = drift.matches(drift.sequence(files), layout)
    got = {(r.file_id, r.old_name, r.new_name): (r.shared_records, r.same_values) for r in drift.shares(matched, rejects.picked(lines, drift.asked(matched, layout))).collect()}
    values = {f: {r.canonical_values[0]: (r.canonical_values, r.row_values) for r in rejects.loaded(rejects.parse(lines, layout, True)).where(F.col("file_id") == f).collect()} for f in (5, 3)}
    shared, want = values[5].keys() & values[3].keys(), {}
    for old, a in (("name", 1), ("amount", 2), ("note", 3)):
        for new, b in (("total", 1), ("qzx", 2), ("extra", 3)):
            same = sum(any((v[a] and v[a].strip()) == (w[b] and w[b].strip()) for v, w in zip(values[5][k], values[3][k], strict=True)) for k in shared)
            if same:
                want[3, old, new] = (len(shared), same)
    assert got == want and len(want) >= 2


def test_correspondences_by_score(spark, drifting):
    _, _, _, matched, _ = run(drifting)
    assert {tuple(r)[:3] for r in drift.by_score(matched).collect()} <= {(3, old, new) for old in ("name", "amount", "note") for new in ("total", "qzx", "extra")}
    got = drift.each_others_best({("a", "x"): 0.9, ("a", "y"): 0.8, ("b", "x"): 0.85, ("b", "y"): 0.1, ("c", "z"): 0.5, ("d", "z"): 0.5, ("e", "w"): 0.0})
    assert got == {("a", "x"), ("c", "z")}
    kinds = sorted((r.file_id, r.change_kind) for r in drift.changes(matched, drift.by_score(matched)).collect())
    assert len([k for k in kinds if k[1] == "renamed"]) >= 1


def assembled(lines, most):
    """The plain rule, line by line: [(number, text)] of one file."""
    out, k = [], 0
    while k < len(lines):
        end = k
        if lines[k][1].count('"') % 2:
            end = next((j for j in range(k + 1, len(lines)) if lines[j][1].count('"') % 2 and lines[j][0] - lines[k][0] < most), k)
        out.append((lines[k][0], "\n".join(t for _, t in lines[k : end + 1])))
        k = end + 1
    return out


@pytest.mark.parametrize("most", [1, 3, 8])
def test_records_of_physical_lines(spark, monkeypatch, most):
    """Quoted fields over several lines, broken quotes, gaps in the numbers, records over block borders."""
    import random

    monkeypatch.setattr(rejects, "BLOCK_LINES", 8)
    r = random.Random(most)
    files = {}
    for file in range(40):
        at, own = 0, []
        for _ in range(r.choice([0, 1, 7, 8, 9, 60])):
            at += r.choice([1, 1, 1, 1, 2, 9])
            own.append((at, r.choice(["a,b", "", 'x,"y z"', 'x,"y', 'z",w', 'q"' if r.random() < 0.2 else "c", '"a ""b"" c', 'd"'])))
        files[file] = own
    lines = spark.createDataFrame([(f, n, t) for f, own in files.items() for n, t in own] + [(0, None, None), (None, 3, 'n"'), (None, 4, "m"), (None, 5, 'o"'), (1, None, 'p"')], "file_id bigint, line_no int, line string").withColumn("layout", F.lit("clash")).repartition(5)
    layout = spark.createDataFrame([(f, json.dumps({"quote": '"'})) for f in files if f % 3], "file_id bigint, layout string")
    made = [(x.file_id, x.line_no, x.line) for x in rejects.assemble(lines, layout, most).collect()]
    odd = [x for x in made if x[0] is None or x[1] is None]
    assert sorted(odd, key=str) == sorted([(1, None, 'p"'), *((None, *x) for x in assembled([(3, 'n"'), (4, "m"), (5, 'o"')], most))], key=str)
    assert rejects.assemble(lines.limit(0), layout, most).count() == 0
    got = sorted(x for x in made if x not in odd)
    assert got == sorted((f, *x) for f, own in files.items() for x in assembled(own, most)) and len(got) > 200


def test_assembled_records_are_parsed(spark):
    layout = rejects.layouts(*(spark.createDataFrame(rows, kind) for rows, kind in (([(1, "p", None, None, {})], FILE), ([(1, k, n, '"string"', True, None, None, None) for k, n in enumerate("ab")], FIELD))))
    lines = spark.createDataFrame([(1, 1, 'k,"one'), (1, 2, ""), (1, 3, 'two"'), (1, 4, "l,m"), (1, 5, 'n,"open')], "file_id bigint, line_no int, line string")
    got = sorted((r.line_no, r.rule_name, r.row_values) for r in rejects.parse(rejects.assemble(lines, layout), layout).collect())
    assert got == [(1, None, ["k", "one\n\ntwo"]), (4, None, ["l", "m"]), (5, "record_quoting", ['n,"open'])]
    with pytest.raises(ValueError):
        rejects.assemble(lines, layout, 0)


def test_a_file_with_most_lines_is_spread(spark, monkeypatch):
    monkeypatch.setattr(rejects, "BLOCK_LINES", 64)
    lines = spark.range(4000).selectExpr("IF(id % 3 = 0, 1L, id) AS file_id", "CAST(id AS INT) AS line_no", "concat(id, ',x') AS line")
    layout = spark.createDataFrame([(1, json.dumps({"fields": [{"ordinal_no": k, "field_name": str(k)} for k in range(2)]}))], "file_id bigint, layout string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    ordered = rejects.in_blocks(lines, layout)
    sizes = [r.n for r in ordered.where("file_id = 1 AND layout IS NULL").groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 0.6 * sum(sizes)
    assert rejects.parse(lines, layout, keep="loaded").count() == 1335


def test_flooding_prefers_alike_names_and_types():
    left = (("id", "integer"), ("order_date", "date"), ("amount", "double"))
    right = (("id", "integer"), ("orderdate", "date"), ("amt", "double"))
    scores = drift.flood(left, right)
    assert all(s > 0 for s in scores.values()) and len(scores) == 9 and max(scores.values()) <= 1
    assert scores[1, 1] > scores[1, 2] and scores[2, 2] > scores[2, 1] and scores[0, 0] == max(scores[0, k] for k in range(3))
    nested = '{"elementType": "integer", "type": "array"}'
    assert drift.flood((("a", nested),), (("b", nested),))[0, 0] > 0
