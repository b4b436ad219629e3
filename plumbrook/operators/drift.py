"""Schemas that drift between files: correspondences, changes, and one consistent table.

Method: similarity flooding. The schemas of a file and of the one before it are graphs of a record
node, field nodes, name nodes and type nodes (nested types have nodes of their own), with edges
`field`, `name`, `type`, `element`, `key`, `member`. Pairs of nodes that are reached by equal edges
pass their scores to each other until the scores no longer change; name pairs start from the likeness
of the names, type pairs from that of the types. Fields of equal names correspond; of the other pairs those correspond
by the method that are each other's best. Values are then cast to the narrowest common type of their
column and all files become one table.

Names and types alone can't tell that two fields hold the same values. Where that is the rule, all pairs
of a gone and a new field are candidates, counted on the records that both files share, and the
consistent ones (one to one) are taken in the order of their shares, then of their scores.

Defined results: names are compared in lower case without outer blanks, the first of equal names of a
file counts; files without table name or instant are in no sequence; files of equal instants follow
their file_id; a pair without shared records is no rename; a file without declared fields has none.
A long sequence of files is followed by doubled pointers, never walked in one task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbrook.functions import declared_types as types
from plumbrook.operators import rejects
from plumbrook.sources.folder import written

#: Share of shared records with equal values that makes a pair of fields one field.
SAME_VALUES = 0.9
ROUNDS, PRECISION = 200, 1e-4


# Files in order


def sequence(file_input: DataFrame) -> DataFrame:
    """file_id, table_name, instant, file_no and prior_id (the file before it of the same table)."""
    entry = lambda k: F.try_element_at(F.col("metadata"), F.lit(k))
    files = file_input.where("file_id IS NOT NULL").dropDuplicates(["file_id"]).select(
        F.col("file_id").cast("bigint").alias("file_id"),
        entry("table_name").alias("table_name"),
        entry("modification_timestamp").try_cast("timestamp").alias("instant"),
    )
    order = Window.partitionBy("table_name").orderBy("instant", "file_id")
    known = files.where("table_name IS NOT NULL AND instant IS NOT NULL")
    return known.withColumns({"file_no": F.row_number().over(order), "prior_id": F.lag("file_id").over(order)})


def fields_of(layout_text: str | None) -> list[tuple[str, str, int]]:
    """(name as compared, canonical type, position) of the declared fields of a layout."""
    seen: dict[str, tuple[str, str, int]] = {}
    for k, field in enumerate(rejects.declared_fields(json.loads(layout_text)) if layout_text else []):
        name = (field.get("field_name") or "").strip().lower()
        seen.setdefault(name, (name, types.canonical_type(field.get("data_type_json")), k))
    return list(seen.values())


# Similarity flooding


@lru_cache(maxsize=65536)
def name_likeness(a: str, b: str) -> float:
    """Dice coefficient of the letter pairs and triples of two names."""
    grams = lambda s: {s[i : i + n] for n in (2, 3) for i in range(len(s) - n + 1)} | {s}
    x, y = grams(f"^{a}$"), grams(f"^{b}$")
    return 2 * len(x & y) / (len(x) + len(y))


def type_likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if types.is_numeric(a) and types.is_numeric(b):
        return 0.6
    return 0.3 if "string" in (a, b) else 0.1


class _Graph:
    """Nodes are texts with a kind; edges are (label, from, to) by number."""

    def __init__(self, fields: tuple[tuple[str, str], ...]):
        self.nodes: list[tuple[str, str]] = [("record", "")]
        self.edges: list[tuple[str, int, int]] = []
        self.fields: list[int] = []
        for name, kind in fields:
            node = self.add("field", name)
            self.fields.append(node)
            self.edges += [("field", 0, node), ("name", node, self.add("name", name)), ("type", node, self.type_node(kind))]

    def add(self, kind: str, text: str, once: bool = False) -> int:
        if once and (kind, text) in self.nodes:
            return self.nodes.index((kind, text))
        self.nodes.append((kind, text))
        return len(self.nodes) - 1

    def type_node(self, kind: str) -> int:
        if ("type", kind) in self.nodes:
            return self.nodes.index(("type", kind))
        node = self.add("type", kind)
        if kind.startswith("{"):
            shape = json.loads(kind)
            for key, label in (("elementType", "element"), ("keyType", "key"), ("valueType", "value")):
                if key in shape:
                    self.edges.append((label, node, self.type_node(types.canonical_type(json.dumps(shape[key]) if not isinstance(shape[key], str) else shape[key]))))
            for f in shape.get("fields", []):
                member = self.add("field", (f.get("name") or "").strip().lower())
                self.edges += [("member", node, member), ("name", member, self.add("name", self.nodes[member][1])), ("type", member, self.type_node(f.get("type") or "string"))]
        return node


def _start(a: tuple[str, str], b: tuple[str, str]) -> float:
    if a[0] == "type":
        return type_likeness(a[1], b[1])
    return name_likeness(a[1], b[1]) if a[0] in ("name", "field") else 1.0


@lru_cache(maxsize=4096)
def flood(left: tuple[tuple[str, str], ...], right: tuple[tuple[str, str], ...]) -> dict[tuple[int, int], float]:
    """Scores of all field pairs (by position in left and right) at the fixpoint, the largest being 1."""
    a, b = _Graph(left), _Graph(right)
    number: dict[tuple[int, int], int] = {}
    pair = lambda x, y: number.setdefault((x, y), len(number))
    sources, targets, labels = [], [], []
    by_label: dict[str, list[tuple[int, int]]] = {}
    for label, x, y in b.edges:
        by_label.setdefault(label, []).append((x, y))
    for label, x, y in a.edges:
        for u, v in by_label.get(label, ()):
            sources.append(pair(x, u))
            targets.append(pair(y, v))
            labels.append(label)
    if not number:
        return {}
    s, t = np.array(sources), np.array(targets)
    label_no = np.unique(labels, return_inverse=True)[1]
    n = len(number)
    # A pair shares its score equally among the neighbours that one label leads to, in both directions.
    out_degree, in_degree = np.bincount(s * 16 + label_no, minlength=16 * n), np.bincount(t * 16 + label_no, minlength=16 * n)
    forward, backward = 1 / out_degree[s * 16 + label_no], 1 / in_degree[t * 16 + label_no]
    start = np.array([_start(a.nodes[x], b.nodes[y]) for x, y in number])
    score = start.copy()
    for _ in range(ROUNDS):
        base = start + score
        new = base + np.bincount(t, base[s] * forward, n) + np.bincount(s, base[t] * backward, n)
        new /= new.max()
        done = np.abs(new - score).max() < PRECISION
        score = new
        if done:
            break
    at_a, at_b = {node: k for k, node in enumerate(a.fields)}, {node: k for k, node in enumerate(b.fields)}
    return {(at_a[x], at_b[y]): float(score[k]) for (x, y), k in number.items() if x in at_a and y in at_b}


def each_others_best(scores: dict[tuple[str, str], float]) -> set[tuple[str, str]]:
    """The pairs of which neither side has a pair of higher score; of equal scores the first by name counts."""
    best: dict[tuple[int, str], tuple[float, tuple[str, str]]] = {}
    for pair, score in sorted(scores.items()):
        for side in (0, 1):
            if score > 0 and ((side, pair[side]) not in best or score > best[side, pair[side]][0]):
                best[side, pair[side]] = (score, pair)
    return {pair for pair in scores if all((side, pair[side]) in best and best[side, pair[side]][1] == pair for side in (0, 1))}


_MATCHES = "file_id bigint, prior_id bigint, kind string, old_name string, new_name string, old_type string, new_type string, old_no int, new_no int, score double, best boolean"


def _match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for file_id, prior_id, old_text, new_text in frame[["file_id", "prior_id", "old_layout", "new_layout"]].itertuples(index=False):
            old, new = fields_of(old_text), fields_of(new_text)
            old_by, new_by = {f[0]: f for f in old}, {f[0]: f for f in new}
            gone, come = [f for f in old if f[0] not in new_by], [f for f in new if f[0] not in old_by]
            for name, kind, k in new:
                if name in old_by:
                    rows.append((file_id, prior_id, "kept", name, name, old_by[name][1], kind, old_by[name][2], k, 1.0, None))
            rows += [(file_id, prior_id, "gone", f[0], None, f[1], None, f[2], None, None, None) for f in gone]
            rows += [(file_id, prior_id, "new", None, f[0], None, f[1], None, f[2], None, None) for f in come]
            if gone and come:
                every = flood(tuple(f[:2] for f in old), tuple(f[:2] for f in new))
                place_old, place_new = {f[0]: k for k, f in enumerate(old)}, {f[0]: k for k, f in enumerate(new)}
                scores = {(f[0], g[0]): every.get((place_old[f[0]], place_new[g[0]]), 0.0) for f in gone for g in come}
                best = each_others_best(scores)
                rows += [(file_id, prior_id, "candidate", f[0], g[0], f[1], g[1], f[2], g[2], scores[f[0], g[0]], (f[0], g[0]) in best) for f in gone for g in come]
        out = pd.DataFrame(rows, columns=["file_id", "prior_id", "kind", "old_name", "new_name", "old_type", "new_type", "old_no", "new_no", "score", "best"])
        yield out.astype({"old_no": "Int32", "new_no": "Int32"})


def matches(files: DataFrame, layout: DataFrame) -> DataFrame:
    """Per file with one before it: kept, gone and new fields, and scored candidates of renames."""
    pairs = files.where("prior_id IS NOT NULL").select("file_id", "prior_id")
    pairs = pairs.join(layout.withColumnRenamed("layout", "new_layout"), "file_id", "left")
    pairs = pairs.join(layout.select(F.col("file_id").alias("prior_id"), F.col("layout").alias("old_layout")), "prior_id", "left")
    return pairs.select("file_id", "prior_id", "old_layout", "new_layout").mapInPandas(_match, _MATCHES)


# Verification on shared records


def _spread(rows: DataFrame, per_file: DataFrame) -> DataFrame:
    """Inner join on the file and block of lines, so that a file with a third of the rows is no hot key."""
    blocks = rows.withColumn("block", rejects.block(F.col("line_no")))
    there = blocks.select("file_id", "block").distinct().join(per_file, "file_id")
    return blocks.join(there, ["file_id", "block"]).drop("block")


def _pairs(matched: DataFrame) -> DataFrame:
    """file_id, prior_id and the gone and new fields (name, place) of the files that have both."""
    listed = lambda name, no: F.array_sort(F.collect_set(F.struct(F.col(name).alias("name"), F.col(no).alias("no"))))
    return matched.where("kind = 'candidate'").groupBy("file_id", "prior_id").agg(listed("old_name", "old_no").alias("gone"), listed("new_name", "new_no").alias("come"))


def asked(matched: DataFrame, layout: DataFrame) -> DataFrame:
    """The layouts of the files whose records tell about renames, with what rejects.picked is to take from them.

    A file is the newer one of its own pairs and the older one of the next file's.
    """
    pairs = _pairs(matched)
    pick = lambda file, newer, fields: pairs.select(F.col(file).alias("of"), F.struct(F.col("file_id"), F.lit(newer).alias("newer"), F.col(f"{fields}.no").alias("places")).alias("pick"))
    picks = pick("file_id", True, "come").unionByName(pick("prior_id", False, "gone")).groupBy(F.col("of").alias("file_id")).agg(F.to_json(F.collect_list("pick")).alias("picks"))
    text = F.concat(F.expr("substring(layout, 1, length(layout) - 1)"), F.lit(',"picks":'), F.col("picks"), F.lit("}"))
    return layout.join(picks, "file_id").select("file_id", text.alias("layout"))


def shares(matched: DataFrame, sides: DataFrame) -> DataFrame:
    """Candidates with shared_records and same_values, counted over the keys valid in both files.

    sides: rejects.picked() of the records by the layouts of asked(). Records are grouped by file and key, which
    spreads any file over all tasks. Candidates without any record of equal values are not listed.
    """
    first = lambda newer: F.min(F.when(F.col("newer") == newer, F.struct("line_no", "v")))["v"]
    both = sides.groupBy("file_id", "key").agg(first(True).alias("b"), first(False).alias("a")).where("a IS NOT NULL AND b IS NOT NULL")
    # Where a type changes, a value may be read as a number on one side and as text on the other.
    equal = lambda x, y: x["value"].eqNullSafe(y["value"]) | x["text"].eqNullSafe(y["text"])
    places = F.flatten(F.transform("a", lambda x, i: F.filter(F.transform("b", lambda y, j: F.when(equal(x, y), i * F.size("b") + j)), lambda k: k.isNotNull())))
    told = both.select("file_id", F.explode(F.concat(F.array(F.lit(-1)), places)).alias("pair_no"))
    counts = told.groupBy("file_id", "pair_no").agg(F.count(F.lit(1)).alias("n"))
    per_file = counts.groupBy("file_id").agg(F.max(F.when(F.col("pair_no") < 0, F.col("n"))).alias("shared_records"), F.collect_list(F.when(F.col("pair_no") >= 0, F.struct("pair_no", "n"))).alias("found"))
    named = per_file.join(_pairs(matched), "file_id").select("file_id", "shared_records", "gone", "come", F.explode("found").alias("f"))
    named = named.select(
        "file_id", F.get("gone", F.expr("f.pair_no div size(come)").cast("int"))["name"].alias("old_name"), F.get("come", F.col("f.pair_no") % F.size("come"))["name"].alias("new_name"),
        "shared_records", F.col("f.n").alias("same_values"),
    )
    scores = matched.where("kind = 'candidate'").select("file_id", "old_name", "new_name", "score")
    return named.join(scores, ["file_id", "old_name", "new_name"]).select("file_id", "old_name", "new_name", "score", "shared_records", "same_values")


def by_score(matched: DataFrame) -> DataFrame:
    """The correspondences of similarity flooding alone: file_id, old_name, new_name, score, share (unknown)."""
    return matched.where("best").select("file_id", "old_name", "new_name", "score", F.lit(None).cast("double").alias("share"))


def _select(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for file_id, pairs in zip(frame["file_id"], frame["pairs"], strict=True):
            old, new = set(), set()
            for p in sorted(pairs, key=lambda p: (-p["share"], -p["score"], p["old_name"], p["new_name"])):
                if p["old_name"] not in old and p["new_name"] not in new:
                    old.add(p["old_name"])
                    new.add(p["new_name"])
                    rows.append((file_id, p["old_name"], p["new_name"], p["score"], p["share"]))
        yield pd.DataFrame(rows, columns=["file_id", "old_name", "new_name", "score", "share"])


def renames(shared: DataFrame, least: float = SAME_VALUES) -> DataFrame:
    """The consistent correspondences among verified candidates: file_id, old_name, new_name, score, share."""
    share = F.col("same_values") / F.col("shared_records")
    good = shared.where(share >= least).withColumn("share", share)
    grouped = good.groupBy("file_id").agg(F.collect_list(F.struct("old_name", "new_name", "score", "share")).alias("pairs"))
    return grouped.mapInPandas(_select, "file_id bigint, old_name string, new_name string, score double, share double")


def changes(matched: DataFrame, renamed: DataFrame) -> DataFrame:
    """file_id, change_kind, field_name, detail of every change against the file before."""
    r = renamed.select("file_id", "old_name", "new_name", "score", "share")
    gone = matched.where("kind = 'gone'").select("file_id", "old_name", "old_type").join(r, ["file_id", "old_name"], "left")
    new = matched.where("kind = 'new'").select("file_id", "new_name", "new_type").join(r.withColumnRenamed("old_name", "was"), ["file_id", "new_name"], "left")
    moved = gone.where("new_name IS NOT NULL").join(new.select("file_id", "new_name", "new_type"), ["file_id", "new_name"])
    kept = matched.where("kind = 'kept'").select("file_id", "new_name", "old_type", "new_type")
    typed = kept.unionByName(moved.select("file_id", "new_name", "old_type", "new_type")).where("old_type <> new_type")
    row = lambda df, kind, name, detail: df.select("file_id", F.lit(kind).alias("change_kind"), F.col(name).alias("field_name"), detail.alias("detail"))
    parts = [
        row(gone.where("new_name IS NULL"), "removed", "old_name", F.col("old_type")),
        row(new.where("was IS NULL"), "added", "new_name", F.col("new_type")),
        row(moved, "renamed", "new_name", F.concat("old_name", F.lit(" -> "), "new_name")),
        row(typed, "type_changed", "new_name", F.concat("old_type", F.lit(" -> "), "new_type")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# Cast and union


_FIELDS = "file_id bigint, name string, place int, kind string, format_pattern string"


def _fields(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for file_id, text in zip(frame["file_id"], frame["layout"], strict=True):
            declared = rejects.declared_fields(json.loads(text)) if text else []
            rows += [(file_id, name, k, kind, declared[k].get("format_pattern")) for name, kind, k in fields_of(text)]
        yield pd.DataFrame(rows, columns=["file_id", "name", "place", "kind", "format_pattern"])


def columns(files: DataFrame, layout: DataFrame, renamed: DataFrame) -> DataFrame:
    """The column of the consistent table that every field of every file belongs to, with its type there.

    Every field points to the one it was in the file before, by its name or by its rename; the pointers are doubled
    until all point to the first field of their column, so that long sequences of files are followed in few rounds,
    none of them in one task. Equal names of different columns are numbered from 2, past the names that fields have.
    """
    known = layout.select("file_id", "layout").mapInPandas(_fields, _FIELDS).join(files.select("file_id", "table_name", "file_no", "prior_id"), "file_id")
    fields = written(known, "fields")
    was = renamed.select("file_id", F.col("new_name").alias("name"), "old_name")
    before = fields.join(was, ["file_id", "name"], "left").select("file_id", "name", "prior_id", F.coalesce("old_name", "name").alias("prior_name"))
    there = fields.select(F.col("file_id").alias("prior_id"), F.col("name").alias("prior_name"), F.lit(True).alias("there"))
    found = before.join(there, ["prior_id", "prior_name"], "left")
    root = F.when(F.col("there"), F.struct(F.col("prior_id").alias("file_id"), F.col("prior_name").alias("name"))).otherwise(F.struct("file_id", "name"))
    roots = written(found.select("file_id", "name", root.alias("root")), "roots")
    longest = files.agg(F.coalesce(F.max("file_no"), F.lit(1))).first()[0]
    for _ in range(max(0, (longest - 1).bit_length())):
        ahead = roots.select(F.struct("file_id", "name").alias("root"), F.col("root").alias("next"))
        roots = written(roots.join(ahead, "root").select("file_id", "name", F.col("next").alias("root")), "roots")
    first = fields.join(roots.where(F.col("root") == F.struct("file_id", "name")).select("file_id", "name"), ["file_id", "name"], "left_semi")
    numbered = first.select("table_name", F.struct("file_id", "name").alias("root"), "name", F.row_number().over(Window.partitionBy("table_name", "name").orderBy("file_no", "place")).alias("n"))
    # Names such as x_2 that fields have are not given to the second column x.
    suffix = F.regexp_extract("name", "_([1-9][0-9]{0,8})$", 1)
    taken = numbered.where((F.col("n") == 1) & (suffix != "")).select("table_name", F.regexp_replace("name", "_[0-9]+$", "").alias("name"), suffix.cast("int").alias("k"))
    taken = taken.groupBy("table_name", "name").agg(F.collect_set("k").alias("taken"))
    again = numbered.join(taken, ["table_name", "name"], "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<int>")))
    free = F.filter(F.sequence(F.lit(2), F.col("n") + F.size("taken") + 1), lambda k: ~F.array_contains("taken", k))
    named = again.select("root", F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat("name", F.lit("_"), F.get(free, F.col("n") - 2))).alias("column_name"))
    own = fields.join(roots, ["file_id", "name"]).join(named, "root")
    return own.select("file_id", "table_name", F.col("place").alias("field_no"), "column_name", F.col("kind").alias("data_type"), "format_pattern")


def column_types(columns: DataFrame) -> DataFrame:
    """table_name, column_name, data_type: the narrowest type that holds the column's values of all files."""
    kinds = columns.groupBy("table_name", "column_name").agg(F.collect_set("data_type").alias("kinds"))

    def common(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[["table_name", "column_name"]].assign(data_type=[types.common_type(list(k)) for k in frame["kinds"]])

    return kinds.mapInPandas(common, "table_name string, column_name string, data_type string")


def unite(records: DataFrame, columns: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """One row per valid record: table_name, file_id, line_no, record (column -> text of a value of the column's type).

    kinds is column_types(columns). Where the common type is string, a value is the text that the file holds, without
    the blanks around a number; else it is the canonical text, equal for equal values of all types that the column has
    had, which casts to the common type. A column that a file lacks is not in the map.
    """
    common = (column_types(columns) if kinds is None else kinds).select("table_name", "column_name", (F.col("data_type") == "string").alias("as_text"))
    typed = columns.join(common, ["table_name", "column_name"])
    number = F.col("data_type").isin(*types.INTEGER_BITS, "double", "float") | F.col("data_type").startswith("decimal(")
    per_file = typed.groupBy("file_id", "table_name").agg(F.array_sort(F.collect_list(F.struct("field_no", "column_name", "as_text", number.alias("number")))).alias("fields"))
    joined = _spread(records, per_file)
    held = lambda f: F.get(F.col("row_values"), f["field_no"])
    text = lambda f: F.when(f["number"], F.regexp_replace(held(f), r"(?U)^\s+|\s+$", "")).otherwise(held(f))
    value = lambda f: F.when(f["as_text"], text(f)).otherwise(F.get(F.col("canonical_values"), f["field_no"]))
    record = F.map_from_entries(F.transform("fields", lambda f: F.struct(f["column_name"], value(f))))
    return joined.select("table_name", "file_id", "line_no", record.alias("record"))


def sql_type(kind: str) -> str:
    """The Spark SQL type of a canonical declared type; nested types are read as text."""
    names = {"integer": "int", "long": "bigint", "short": "smallint", "byte": "tinyint"}
    return names.get(kind, kind if not kind.startswith(("{", "[")) else "string")


def wide(united: DataFrame, kinds: DataFrame, table_name: str) -> DataFrame:
    """The typed table of one table_name; its columns (one schema) are read to the driver."""
    found = kinds.where(F.col("table_name") == table_name).orderBy("column_name").collect()
    own = united.where(F.col("table_name") == table_name)
    return own.select("file_id", "line_no", *(F.try_element_at("record", F.lit(r["column_name"])).try_cast(sql_type(r["data_type"])).alias(r["column_name"]) for r in found))
