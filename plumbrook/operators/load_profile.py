"""Column profiles per load from one range sort: nulls, distincts, ranges, quantiles, distances.

Method: the columns are unpivoted into (column, load, value) with counts; where the rows are read they
are combined into sorted runs, then range-partitioned and sorted. A pass over each range sees every
value of its part of a (column, load) segment in order. What it keeps per segment and range is small
and adds up: rows, distinct values, least and greatest value, counts per accepted bucket. Prefix
counts over the ranges place each range in its segment, which yields exact quantiles; and for two
loads of one column the difference of their cumulative curves over the merged order has a least and
a greatest value per range, which shifted by the prefix give the exact Kolmogorov-Smirnov distance.
A load with a third of all rows is spread over many ranges, a value with a third of all rows is one
row per run.

A value is kept as `ordinal` (a 64-bit number that orders as the value does, for numbers, booleans,
dates and timestamps) or as `text`.

Defined results: null, and texts of nothing but spaces, are not present; NaN is present, equals itself
and lies above all numbers; -0.0 is 0.0; decimals are compared as doubles; arrays, maps, structs and
binary values as their JSON text; an empty table has no loads; columns with names of the result are no
clash, as only their values are read; a null load is a load of its own.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbrook.operators import runs
from plumbrook.sources.folder import written

#: Columns accepted in a profile; it is held in every task.
MOST_COLUMNS = 10_000
_RUN = "column_no int, load_id bigint, ordinal bigint, text string, n bigint"
_KEYS = ["column_no", "load_id", "ordinal", "text"]
_SIGN = np.int64(0x7FFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class ColumnPlan:
    """How one column is read: kind is long, double, date, timestamp or text."""

    number: int
    name: str
    kind: str


def plan_columns(df: DataFrame, names: Sequence[str]) -> list[ColumnPlan]:
    if len(names) > MOST_COLUMNS:
        raise ValueError(f"{len(names)} columns; at most {MOST_COLUMNS} are profiled at once")
    by_name = {f.name: f.dataType for f in df.schema}
    plans = []
    for k, name in enumerate(names):
        kind = by_name[name]
        if isinstance(kind, T.IntegralType | T.BooleanType):
            plans.append(ColumnPlan(k, name, "long"))
        elif isinstance(kind, T.FractionalType):
            plans.append(ColumnPlan(k, name, "double"))
        elif isinstance(kind, T.DateType):
            plans.append(ColumnPlan(k, name, "date"))
        elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
            plans.append(ColumnPlan(k, name, "timestamp"))
        else:
            plans.append(ColumnPlan(k, name, "text"))
    return plans


def order_of_doubles(values: np.ndarray) -> np.ndarray:
    """64-bit integers that order as the doubles do; -0.0 as 0.0, NaN last and all alike."""
    clean = np.where(np.isnan(values), np.nan, values + 0.0)
    bits = clean.view(np.int64)
    return np.where(bits < 0, bits ^ _SIGN, bits)


def doubles_of(ordinal: np.ndarray) -> np.ndarray:
    bits = np.where(ordinal < 0, ordinal ^ _SIGN, ordinal)
    return bits.astype(np.int64).view(np.float64)


def _read(df: DataFrame, plans: list[ColumnPlan], load: str) -> DataFrame:
    """load_id and one column v0, v1 ... per profiled column, in the type it is counted in."""
    picked = [F.col(f"`{load}`").cast("bigint").alias("load_id")]
    schema = {f.name: f.dataType for f in df.schema}
    for p in plans:
        c = F.col(f"`{p.name}`")
        if p.kind == "timestamp":
            c = F.unix_micros(c.cast("timestamp"))
        elif p.kind == "date":
            c = F.unix_date(c).cast("bigint")
        elif p.kind == "text" and not isinstance(schema[p.name], T.StringType):
            c = F.when(c.isNotNull(), F.to_json(F.struct(c.alias("v"))))
        picked.append(c.cast({"double": "double", "text": "string"}.get(p.kind, "bigint")).alias(f"v{p.number}"))
    return df.select(*picked)


def value_runs(df: DataFrame, plans: list[ColumnPlan], load: str) -> DataFrame:
    """Sorted runs of (column_no, load_id, ordinal, text) with counts n; null in both is "not present"."""
    plans = list(plans)

    def make(block: pa.Table):
        out = []
        for p in plans:
            counted = runs.combine(pa.table({"load_id": block["load_id"], "v": block[f"v{p.number}"], "n": pa.repeat(1, block.num_rows)}), ["load_id", "v"], "n")
            v, size = counted["v"], counted.num_rows
            if p.kind == "text":
                v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
                blank = pc.fill_null(pc.equal(pc.utf8_trim(v, characters=" "), ""), True)
                ordinal, text = pa.nulls(size, pa.int64()), v.take(pa.array(np.arange(size), mask=blank.to_numpy(zero_copy_only=False)))
            elif p.kind == "double":
                numbers = order_of_doubles(pc.fill_null(v, 0.0).to_numpy())
                ordinal, text = pa.array(numbers, mask=pc.is_null(v, nan_is_null=False).to_numpy()), pa.nulls(size, pa.string())
            else:
                ordinal, text = v, pa.nulls(size, pa.string())
            out.append(pa.table({"column_no": pa.repeat(pa.scalar(p.number, pa.int32()), size), "load_id": counted["load_id"], "ordinal": ordinal, "text": text, "n": counted["n"]}))
        yield pa.concat_tables(out)

    return _read(df, plans, load).mapInArrow(runs.per_block(make), _RUN)


def ranged(run_rows: DataFrame) -> DataFrame:
    """The runs, range-partitioned and sorted: the external sort."""
    return run_rows.repartitionByRange(*_KEYS).sortWithinPartitions(*_KEYS)


# One pass: what adds up per segment and range


_PART = "column_no int, load_id bigint, present bigint, absent bigint, distincts bigint, least bigint, greatest bigint, least_text string, greatest_text string, cells map<int,bigint>"
_PART_SCHEMA = pa.schema([("column_no", pa.int32()), ("load_id", pa.int64()), ("present", pa.int64()), ("absent", pa.int64()), ("distincts", pa.int64()), ("least", pa.int64()), ("greatest", pa.int64()), ("least_text", pa.string()), ("greatest_text", pa.string()), ("cells", pa.map_(pa.int32(), pa.int64()))])


@dataclass
class Cells:
    """Accepted cells of a column: buckets [low, high) of numbers, or items."""

    low: list[float] | None = None
    high: list[float] | None = None
    items: list[str] | None = None


def segment_parts(ordered: DataFrame, plans: list[ColumnPlan], cells: dict[int, Cells]) -> DataFrame:
    """One row per range and segment. cells counts present values per accepted cell, -1 for those in none."""
    kinds = {p.number: p.kind for p in plans}
    days = {n: pa.array([_ordinal(kinds[n], i) for i in c.items], pa.int64()) for n, c in cells.items() if c.items is not None and kinds[n] in ("date", "timestamp")}

    def cell_numbers(number: int, ordinal: np.ndarray, text: pa.Array) -> np.ndarray | None:
        own = cells.get(number)
        if own is None:
            return None
        if not (own.items or own.low):
            return np.full(len(ordinal), -1)
        if own.items is not None:
            if kinds[number] == "text":
                place = pc.index_in(text, value_set=pa.array(own.items, pa.string()))
            elif number in days:
                place = pc.index_in(pa.array(ordinal, pa.int64()), value_set=days[number])
            else:
                place = pc.index_in(pa.array([str(x) for x in _shown(kinds[number], ordinal)], pa.string()), value_set=pa.array(own.items, pa.string()))
            return pc.fill_null(place, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        values = doubles_of(ordinal) if kinds[number] == "double" else ordinal.astype(np.float64)
        low, high = np.array(own.low), np.array(own.high)
        by_low = np.argsort(low, kind="stable")
        place = np.searchsorted(low[by_low], values, side="right") - 1
        inside = (place >= 0) & (values < high[by_low][np.maximum(place, 0)])
        return np.where(inside, by_low[np.maximum(place, 0)], -1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, part = None, None
        done: list[dict] = []
        for merged in runs.merge_sorted(batches, _KEYS, "n"):
            merged = merged.combine_chunks()
            starts = runs.starts_of(merged, ["column_no", "load_id"])
            ends = np.append(starts[1:], merged.num_rows)
            n = merged["n"].to_numpy()
            ordinal_all, text_all = merged["ordinal"].combine_chunks(), merged["text"].combine_chunks()
            filled = pc.fill_null(ordinal_all, 0).to_numpy()
            numbers, loads = merged["column_no"].to_numpy()[starts], merged["load_id"].take(pa.array(starts)).to_pylist()
            void = (pc.and_(pc.is_null(ordinal_all), pc.is_null(text_all))).to_numpy(zero_copy_only=False)
            for s, e, number, load in zip(starts.tolist(), ends.tolist(), numbers.tolist(), loads, strict=True):
                if open_key != (number, load):
                    if part is not None:
                        done.append(part)
                    open_key = (number, load)
                    part = {"column_no": number, "load_id": load, "present": 0, "absent": 0, "distincts": 0, "least": None, "greatest": None, "least_text": None, "greatest_text": None, "cells": {}}
                if void[s]:  # sorts first and is one row
                    part["absent"] += int(n[s])
                    s += 1
                    if s == e:
                        continue
                part["present"] += int(n[s:e].sum())
                part["distincts"] += e - s
                if kinds[number] == "text":
                    if part["least_text"] is None:
                        part["least_text"] = text_all[s].as_py()
                    part["greatest_text"] = text_all[e - 1].as_py()
                else:
                    if part["least"] is None:
                        part["least"] = int(filled[s])
                    part["greatest"] = int(filled[e - 1])
                if (place := cell_numbers(number, filled[s:e], text_all.slice(s, e - s))) is not None:
                    sums = np.bincount(place + 1, n[s:e])
                    for k in np.flatnonzero(sums).tolist():
                        part["cells"][k - 1] = part["cells"].get(k - 1, 0) + int(sums[k])
            if len(done) >= 5000:
                yield _part_batch(done)
                done = []
        if part is not None:
            done.append(part)
        if done:
            yield _part_batch(done)

    return ordered.mapInArrow(scan, _PART)


def _part_batch(parts: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([p | {"cells": list(p["cells"].items())} for p in parts], schema=_PART_SCHEMA)


def _shown(kind: str, ordinal: np.ndarray) -> list:
    return doubles_of(ordinal).tolist() if kind == "double" else ordinal.tolist()


def segments(parts: DataFrame) -> DataFrame:
    """One row per column and load from the parts of all ranges."""
    total = lambda c: F.sum(c).alias(c)
    keys = ["column_no", "load_id"]
    counted = parts.groupBy(*keys).agg(
        total("present"), total("absent"), total("distincts"), F.min("least").alias("least"), F.max("greatest").alias("greatest"),
        F.min("least_text").alias("least_text"), F.max("greatest_text").alias("greatest_text"),
        F.flatten(F.collect_list(F.map_entries("cells"))).alias("cells"),
    )
    return counted


def _in_cell(k: Column) -> Column:
    """The present values of a segment in one accepted cell."""
    return F.aggregate(F.filter("cells", lambda e: e["key"] == k), F.lit(0).cast("bigint"), lambda s, e: s + e["value"])


def as_double(ordinal: Column) -> Column:
    """The double of an ordinal, for columns of kind double (JVM side, without Python)."""
    bits = F.when(ordinal < 0, ordinal.bitwiseXOR(F.lit(int(_SIGN)))).otherwise(ordinal)
    sign = F.when(bits < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent = F.shiftright(bits, 52).bitwiseAND(F.lit(2047))
    fraction = bits.bitwiseAND(F.lit((1 << 52) - 1)).cast("double") / F.lit(float(1 << 52))
    normal = sign * (F.lit(1.0) + fraction) * F.pow(F.lit(2.0), (exponent - 1023).cast("double"))
    small = sign * fraction * F.pow(F.lit(2.0), F.lit(-1022.0))
    special = F.when(fraction > 0, F.lit(float("nan"))).otherwise(sign * F.lit(float("inf")))
    return F.when(exponent == 2047, special).when(exponent == 0, small).otherwise(normal)


def shown(kind: Column, ordinal: Column, text: Column) -> Column:
    """A value as text, by the kind of its column."""
    return (
        F.when(kind == "text", text).when(kind == "double", as_double(ordinal).cast("string"))
        .when(kind == "date", F.date_from_unix_date(ordinal.cast("int")).cast("string"))
        .when(kind == "timestamp", F.timestamp_micros(ordinal).cast("string")).otherwise(ordinal.cast("string"))
    )


def named(df: DataFrame, plans: list[ColumnPlan]) -> DataFrame:
    """column_no replaced by column_name and kind."""
    names, kinds = F.array(*(F.lit(p.name) for p in plans)), F.array(*(F.lit(p.kind) for p in plans))
    return df.withColumns({"column_name": F.get(names, F.col("column_no")), "kind": F.get(kinds, F.col("column_no"))}).drop("column_no")


def profile(df: DataFrame, names: Sequence[str], load: str, accepted: DataFrame | None = None, violations: DataFrame | None = None) -> DataFrame:
    """Per load and column: rows, nulls (or blanks), null rate, distinct values, least and greatest value.

    With `accepted`, also `cells`: of the present values, the share in each accepted bucket or item beside the
    accepted share, and `outside_share`, the share in none of them; both null for a column without accepted cells.
    With `violations`, also `violations`: per rule_name (in lower case without outer blanks) the distinct primary
    keys logged for the load. A logged rule belongs to the columns of its column_names and to those whose accepted
    rule_name it is; log rows without rule_name or primary_key count nowhere.
    """
    plans = plan_columns(df, names)
    rows = [] if accepted is None else _accepted_rows(accepted, names)
    table, cells = _accepted(rows, plans)
    found = segments(segment_parts(ranged(value_runs(df, plans, load)), plans, cells))
    row_count = F.col("present") + F.col("absent")
    more = []
    if accepted is not None:
        spark = df.sparkSession
        layout = [(t[0], [(*bounds, n) for bounds, n in zip(_bounds(cells[t[0]]), t[8], strict=True)]) for t in table if t[8]]
        own = spark.createDataFrame(layout, "column_no int, accepted_cells array<struct<low:double,high:double,item:string,accepted_count:bigint>>")
        found = found.join(F.broadcast(own), "column_no", "left")
        total = F.aggregate("accepted_cells", F.lit(0).cast("bigint"), lambda s, x: s + x["accepted_count"])
        share = lambda k: F.when(F.col("present") > 0, _in_cell(k) / F.col("present"))
        each = lambda x, k: F.struct(x["low"].alias("low"), x["high"].alias("high"), x["item"].alias("item"), share(k).alias("share"), F.when(total > 0, x["accepted_count"] / total).alias("accepted_share"))
        more += [F.transform("accepted_cells", each).alias("cells"), F.when(F.col("accepted_cells").isNotNull(), share(F.lit(-1))).alias("outside_share")]
    if violations is not None:
        logged = logged_violations(violations, plans, table, df.sparkSession).withColumnsRenamed({"load_id": "logged_load", "column_no": "logged_column"})
        found = found.join(logged, F.col("load_id").eqNullSafe(F.col("logged_load")) & (F.col("column_no") == F.col("logged_column")), "left")
        more.append(F.coalesce("violations", F.array().cast(_LOGGED)).alias("violations"))
    return named(found, plans).select(
        "load_id", "column_name", row_count.alias("row_count"), F.col("absent").alias("count_nulls"), (F.col("absent") / row_count).alias("null_rate"), F.col("distincts").alias("count_unique"),
        shown(F.col("kind"), F.col("least"), F.col("least_text")).alias("min_value"), shown(F.col("kind"), F.col("greatest"), F.col("greatest_text")).alias("max_value"), *more,
    )


_LOGGED = "array<struct<rule_name:string,count_violations:bigint>>"


def logged_violations(violations: DataFrame, plans: list[ColumnPlan], table: list[tuple], spark: SparkSession) -> DataFrame:
    """load_id, column_no, violations: the distinct primary keys logged per load, column and rule_name."""
    log = violations.where("primary_key IS NOT NULL AND rule_name IS NOT NULL").select(F.col("load_id").cast("bigint").alias("load_id"), F.lower(F.trim("rule_name")).alias("rule"), "primary_key", "column_names")
    by_name = spark.createDataFrame([(p.number, p.name.strip().lower()) for p in plans], "column_no int, name string")
    by_rule = spark.createDataFrame([(t[0], t[9]) for t in table if t[9] is not None], "column_no int, rule string")
    keys = ["load_id", "column_no", "rule", "primary_key"]
    of_names = log.withColumn("name", F.explode("column_names")).withColumn("name", F.lower(F.trim("name"))).join(F.broadcast(by_name), "name").select(*keys)
    both = of_names.unionByName(log.join(F.broadcast(by_rule), "rule").select(*keys))
    counts = both.groupBy("load_id", "column_no", "rule").agg(F.count_distinct("primary_key").alias("n"))
    return counts.groupBy("load_id", "column_no").agg(F.array_sort(F.collect_list(F.struct(F.col("rule").alias("rule_name"), F.col("n").alias("count_violations")))).alias("violations"))


# Exact quantiles from prefix counts


_PLACED = "range_no int, column_no int, load_id bigint, ordinal bigint, text string, n bigint, upto bigint"


def curves(ordered: DataFrame, folder: str) -> DataFrame:
    """Every present value of every segment with its cumulative count within its range, written to `folder`.

    Written, because the prefix counts need all ranges before any value can be placed, and because a
    table in the shared folder survives the loss of executors.
    """
    from pyspark import TaskContext

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, key, upto = TaskContext.get().partitionId(), None, 0
        for merged in runs.merge_sorted(batches, _KEYS, "n"):
            merged = merged.filter(pc.or_(pc.is_valid(merged["ordinal"]), pc.is_valid(merged["text"]))).combine_chunks()
            if not merged.num_rows:
                continue
            n = merged["n"].to_numpy()
            starts = runs.starts_of(merged, ["column_no", "load_id"])
            total = np.cumsum(n)
            before = np.repeat(np.append([0], total[starts[1:] - 1]) if len(starts) > 1 else np.array([0]), np.diff(np.append(starts, merged.num_rows)))
            own = total - before
            first = (merged["column_no"][0].as_py(), merged["load_id"][0].as_py())
            if first == key:
                own[: starts[1] if len(starts) > 1 else merged.num_rows] += upto
            key, upto = (merged["column_no"][-1].as_py(), merged["load_id"][-1].as_py()), int(own[-1])
            placed = merged.append_column("upto", pa.array(own)).add_column(0, "range_no", pa.repeat(pa.scalar(at, pa.int32()), merged.num_rows))
            yield from placed.to_batches()

    spark = ordered.sparkSession
    ordered.mapInArrow(scan, _PLACED).write.parquet(folder)
    return spark.read.schema(_PLACED).parquet(folder)


def quantiles(placed: DataFrame, percents: Sequence[float]) -> DataFrame:
    """column_no, load_id, pct, ordinal, text: the smallest value with at least pct % of the values not above it."""
    segment = ["column_no", "load_id"]
    sizes = placed.groupBy(*segment, "range_no").agg(F.max("upto").alias("size"))
    by = Window.partitionBy(*segment)
    prefix = sizes.withColumns({"total": F.sum("size").over(by), "before": F.sum("size").over(by.orderBy("range_no")) - F.col("size")})
    wanted = F.explode(F.array(*(F.lit(float(p)) for p in percents)))
    ranks = prefix.withColumn("pct", wanted).withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("pct") * F.col("total") / 100)) - F.col("before"))
    here = ranks.where((F.col("rank") >= 1) & (F.col("rank") <= F.col("size"))).groupBy(*segment, "range_no").agg(F.collect_list(F.struct("pct", "rank")).alias("ranks"))
    a, b = placed.alias("a"), here.alias("b")
    same = (F.col("a.range_no") == F.col("b.range_no")) & (F.col("a.column_no") == F.col("b.column_no")) & F.col("a.load_id").eqNullSafe(F.col("b.load_id"))
    hit = F.filter("b.ranks", lambda r: (r["rank"] <= F.col("a.upto")) & (r["rank"] > F.col("a.upto") - F.col("a.n")))
    picked = a.join(b, same).select("a.column_no", "a.load_id", "a.ordinal", "a.text", F.explode(hit).alias("r"))
    return picked.select("column_no", "load_id", F.col("r.pct").alias("pct"), "ordinal", "text")


# Exact Kolmogorov-Smirnov distances of consecutive loads


_CURVE = "range_no int, column_no int, load_id bigint, step double, low double, high double"


def neighbours(counts: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """counts beside the row before (prior_*) and the row after (next_*) in the order of `key`.

    counts has one row per key, none of them null, and is written in sorted ranges; the last row of a range meets the next range by one
    row per range, so that no task orders all keys.
    """
    placed = counts.repartitionByRange(key).sortWithinPartitions(key).withColumn("part", F.spark_partition_id())
    placed = written(placed, "loads")
    whole = F.struct(key, *values)
    within = Window.partitionBy("part").orderBy(key)
    order = Window.orderBy("part")  # one row per range
    ends = placed.groupBy("part").agg(F.max_by(whole, key).alias("last"), F.min_by(whole, key).alias("first"))
    ends = ends.withColumns({"end_before": F.lag("last").over(order), "start_after": F.lead("first").over(order)}).select("part", "end_before", "start_after")
    beside = placed.withColumns({"prior": F.lag(whole).over(within), "next": F.lead(whole).over(within)}).join(F.broadcast(ends), "part")
    prior, after = F.coalesce("prior", "end_before"), F.coalesce("next", "start_after")
    return beside.select(key, *values, *(of[c].alias(f"{name}_{c}") for name, of in (("prior", prior), ("next", after)) for c in (key, *values)))


def distances(df: DataFrame, names: Sequence[str], load: str) -> DataFrame:
    """load_id, prior_load, column_name, ks_distance of each load to the load before it (by load_id).

    Each value takes part in two pairs, as +n of its load and as -n of the load before the next, both times
    the size of the pair's other load. The running sum over the merged order is the difference of the two
    curves, as a whole number over the product of the sizes; a range keeps its total and its extremes, and
    the totals of the ranges before shift them. The sums are doubles: exact up to 2^53, with the error of a
    double beyond. Runs meet the sizes by load and column.
    """
    from pyspark import TaskContext

    plans = plan_columns(df, names)
    read = _read(df, plans, load)
    present = [F.count(F.when(F.trim(f"v{p.number}") != "", 1) if p.kind == "text" else F.col(f"v{p.number}")).alias(f"n{p.number}") for p in plans]
    counts = read.where("load_id IS NOT NULL").groupBy("load_id").agg(*present)
    beside = neighbours(counts.select("load_id", F.array(*(f"n{p.number}" for p in plans)).alias("sizes")), "load_id", ["sizes"])
    none = F.array_repeat(F.lit(0).cast("bigint"), len(plans))
    each = F.posexplode(F.arrays_zip(F.col("sizes").alias("size"), F.coalesce("prior_sizes", none).alias("prior_size"), F.coalesce("next_sizes", none).alias("next_size")))
    sizes = beside.select("load_id", "prior_load_id", "next_load_id", each.alias("column_no", "s"))
    sizes = sizes.select("load_id", F.col("prior_load_id").alias("prior_load"), F.col("next_load_id").alias("next_load"), "column_no", "s.size", "s.prior_size", "s.next_size")
    run_rows = value_runs(df, plans, load).where("load_id IS NOT NULL AND (ordinal IS NOT NULL OR text IS NOT NULL)")
    joined = run_rows.join(sizes.select("load_id", "column_no", "prior_load", "prior_size", "next_load", "next_size"), ["load_id", "column_no"])
    weight = lambda other: F.col("n").cast("double") * F.col(other).cast("double")
    sides = F.array(
        F.struct(F.when(F.col("prior_load").isNotNull(), F.col("load_id")).alias("pair"), weight("prior_size").alias("w")),
        F.struct(F.col("next_load").alias("pair"), (-weight("next_size")).alias("w")),
    )
    steps = joined.select("column_no", "ordinal", "text", F.explode(sides).alias("s")).where("s.pair IS NOT NULL")
    keys = ["column_no", "load_id", "ordinal", "text"]
    ordered = steps.select("column_no", F.col("s.pair").alias("load_id"), "ordinal", "text", F.col("s.w").alias("w")).repartitionByRange(*keys).sortWithinPartitions(*keys)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, key, level, low, high = TaskContext.get().partitionId(), None, 0.0, 0.0, 0.0
        rows: list[tuple] = []
        for merged in runs.merge_sorted(batches, keys, "w"):
            merged = merged.combine_chunks()
            starts = runs.starts_of(merged, ["column_no", "load_id"])
            w = merged["w"].to_numpy()
            for s, e in zip(starts.tolist(), np.append(starts[1:], merged.num_rows).tolist(), strict=True):
                own = (merged["column_no"][s].as_py(), merged["load_id"][s].as_py())
                if own != key:
                    if key is not None:
                        rows.append((at, *key, level, low, high))
                    key, level, low, high = own, 0.0, 0.0, 0.0
                sums = level + np.cumsum(w[s:e])
                level, low, high = float(sums[-1]), min(low, float(sums.min())), max(high, float(sums.max()))
        if key is not None:
            rows.append((at, *key, level, low, high))
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(("range_no", "column_no", "load_id", "step", "low", "high"), zip(*rows, strict=True), strict=True)), schema=pa.schema([("range_no", pa.int32()), ("column_no", pa.int32()), ("load_id", pa.int64()), ("step", pa.float64()), ("low", pa.float64()), ("high", pa.float64())]))

    parts = ordered.mapInArrow(scan, _CURVE)
    before = F.sum("step").over(Window.partitionBy("column_no", "load_id").orderBy("range_no")) - F.col("step")
    extreme = F.greatest(F.abs(before + F.col("low")), F.abs(before + F.col("high")))
    ks = parts.withColumn("d", extreme).groupBy("column_no", "load_id").agg(F.max("d").alias("d"))
    # A load without values of a column has no curve there, and no distance.
    both = ks.join(sizes.select("load_id", "prior_load", "column_no", "size", "prior_size"), ["load_id", "column_no"]).where("size > 0 AND prior_size > 0")
    return named(both, plans).select("load_id", "prior_load", "column_name", (F.col("d") / (F.col("size").cast("double") * F.col("prior_size").cast("double"))).alias("ks_distance"))


# Departures from an accepted profile


#: A share departs from the accepted one by more than 1/20, a distribution by more than 1/5.
RATE_PARTS, DRIFT_PARTS = 20, 5


def _ordinal(kind: str, text: str) -> int | None:
    """The ordinal of an accepted bound; None, nothing to compare, if it is no value of the kind."""
    try:
        return _read_ordinal(kind, text.strip())
    except (ValueError, OverflowError):
        return None


def _read_ordinal(kind: str, text: str) -> int:
    if kind == "double":
        return int(order_of_doubles(np.array([float(text)]))[0])
    if kind == "date":
        return (datetime.date.fromisoformat(text) - datetime.date(1970, 1, 1)).days
    if kind == "timestamp":
        moment = datetime.datetime.fromisoformat(text)
        return round((moment.replace(tzinfo=moment.tzinfo or datetime.UTC) - datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)) / datetime.timedelta(microseconds=1))
    return int(text)


_ACCEPTED = "column_no int, a_count bigint, a_nulls bigint, a_unique bigint, least_ordinal bigint, most_ordinal bigint, least_accepted string, most_accepted string, cell_counts array<bigint>, rule string, a_violations bigint"


def _accepted_rows(accepted: DataFrame, names: Sequence[str]) -> list:
    """The accepted profiles of the named columns, whatever other columns the table holds."""
    rows = accepted.where(F.col("column_name").isin(list(names))).limit(MOST_COLUMNS + 1).collect()
    if len(rows) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} accepted profiles")
    return rows


def _accepted(rows: list, plans: list[ColumnPlan]) -> tuple[list[tuple], dict[int, Cells]]:
    kinds = {p.name: p for p in plans}
    out, cells = [], {}
    for r in rows:
        p = kinds[r["column_name"]]
        counts = None
        if r["pmf"] is not None and p.kind != "text":
            kept = [b for b in r["pmf"] if b is not None and b["low"] is not None and b["high"] is not None]
            cells[p.number] = Cells(low=[b["low"] for b in kept], high=[b["high"] for b in kept])
            counts = [b["bucket_count"] or 0 for b in kept]
        elif r["items"] is not None:
            kept = [i for i in r["items"] if i is not None and i["item"] is not None]
            cells[p.number] = Cells(items=[i["item"] for i in kept])
            counts = [i["item_count"] or 0 for i in kept]
        bound = lambda v, text: None if v is None or (p.kind == "text") != text else v if text else _ordinal(p.kind, v)  # noqa: B023, E731
        rule = r["rule_name"].strip(" ").lower() if r["rule_name"] is not None else None
        out.append((p.number, r["profiled_count"], r["count_nulls"], r["count_unique"], bound(r["min_value"], False), bound(r["max_value"], False), bound(r["min_value"], True), bound(r["max_value"], True), counts, rule, r["count_violations"]))
    return out, cells


def _bounds(own: Cells) -> list[tuple[float | None, float | None, str | None]]:
    """low, high and item of every accepted cell of a column."""
    return [(None, None, item) for item in own.items] if own.items is not None else [(low, high, None) for low, high in zip(own.low, own.high, strict=True)]


def findings(df: DataFrame, load: str, accepted: DataFrame, violations: DataFrame) -> DataFrame:
    """load_id, column_name, finding of every departure from the accepted profile.

    accepted has one row per profiled column (at most MOST_COLUMNS) and is read to the driver; columns
    that df lacks are not compared. Shares are compared as whole numbers, without rounding.
    """
    rows = _accepted_rows(accepted, df.columns)
    plans = plan_columns(df, [r["column_name"] for r in rows])
    spark = df.sparkSession
    table, cells = _accepted(rows, plans)
    a = F.broadcast(spark.createDataFrame(table, _ACCEPTED))
    found = segments(segment_parts(ranged(value_runs(df, plans, load)), plans, cells))
    logged = violations.where("primary_key IS NOT NULL").select(F.col("load_id").cast("bigint").alias("load_id"), F.lower(F.trim("rule_name")).alias("rule"), "primary_key")
    logged = logged.join(a.where("rule IS NOT NULL AND a_violations IS NOT NULL").select("column_no", "rule"), "rule")
    broken = logged.groupBy("load_id", "column_no").agg(F.count_distinct("primary_key").alias("broken"))
    c = found.join(a, "column_no").join(broken, ["load_id", "column_no"], "left")
    wide = lambda x: F.col(x).cast("decimal(38,0)")
    row_count = wide("present") + wide("absent")
    null_rate = F.abs(wide("absent") * wide("a_count") - wide("a_nulls") * row_count) * RATE_PARTS > row_count * wide("a_count")
    broken_rate = (F.coalesce(wide("broken"), F.lit(0)) * wide("a_count") - wide("a_violations") * row_count) * RATE_PARTS > row_count * wide("a_count")
    beyond = F.coalesce(F.col("least") < F.col("least_ordinal"), F.lit(False)) | F.coalesce(F.col("greatest") > F.col("most_ordinal"), F.lit(False)) | F.coalesce(F.col("least_text") < F.col("least_accepted"), F.lit(False)) | F.coalesce(F.col("greatest_text") > F.col("most_accepted"), F.lit(False))
    distinct = (F.col("distincts") * 2 < F.col("a_unique")) | (F.col("distincts") > F.col("a_unique") * 2)
    zero = F.lit(0).cast("decimal(38,0)")
    total = F.aggregate("cell_counts", zero, lambda s, x: (s + x).cast("decimal(38,0)"))
    apart = F.transform("cell_counts", lambda x, k: F.abs(_in_cell(k).cast("decimal(38,0)") * F.col("accepted_total") - x.cast("decimal(38,0)") * wide("present")))
    outside = _in_cell(F.lit(-1)).cast("decimal(38,0)") * F.col("accepted_total")
    moved = F.aggregate(apart, zero, lambda s, x: (s + x).cast("decimal(38,0)")) + outside
    drift = (F.col("present") > 0) & (F.col("accepted_total") > 0) & (moved * DRIFT_PARTS > F.lit(2) * wide("present") * F.col("accepted_total"))
    tests = {"null_rate": null_rate, "value_range": beyond, "distinct_count": distinct, "drift": drift, "violations": broken_rate}
    kinds = F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items())), lambda x: x.isNotNull())
    out = named(c.withColumn("accepted_total", total).select("column_no", "load_id", F.explode(kinds).alias("finding")), plans)
    return out.select("load_id", "column_name", "finding")
