"""Single-pass column profiles with sketches, types inferred from texts, and schemas from profiles.

All columns are aggregated in one pass into one row of counts and sketches of fixed size; distributions
and percentiles are read from the sketches. Where the distinct values of a column fit into its item
list the items, distinct count and discrete distribution are exact, and extras say so.
"""

from __future__ import annotations

import bisect
import enum
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbrook.errors import PlumbrookError


@dataclass(frozen=True)
class TypeInference:
    prefer_not_nullable: bool = False
    prefer_boolean_for_01: bool = False
    prefer_float: bool = False
    prefer_integer: bool = False
    date_formats: tuple[str, ...] = ("yyyy-MM-dd", "MM/dd/yyyy", "dd.MM.yyyy")
    timestamp_formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss",)
    #: The zone of moments that are written without one; None for that of the session.
    time_zone: str | None = None
    #: (name, values in order); columns of two-valued "boolean" ones become booleans, others enums.
    enums: tuple[tuple[str, tuple[str, ...]], ...] = (("boolean", ("FALSE", "TRUE")), ("boolean", ("NO", "YES")), ("boolean", ("N", "Y")))


class Profiler(enum.Enum):
    """The parts of a column's profile; the values are fixed names."""

    COUNT = "count"
    COUNT_EMPTY = "count_empty"
    COUNT_NULLS = "count_nulls"
    COUNT_UNIQUE = "count_unique"
    COUNT_ZEROS = "count_zeros"
    MAX_LENGTH = "max_length"
    MIN = "min"
    MAX = "max"
    MEAN = "mean"
    PMF = "pmf"
    ITEMS = "items"


@dataclass(frozen=True)
class ProfileConfig:
    max_item_length: int = 1024
    items: int = 100
    pmf_buckets: int = 100
    infer_types_from_strings: bool = False
    inference: TypeInference = field(default_factory=TypeInference)
    #: Turn off what is not needed; its fields are null.
    count_distincts: bool = True
    quantiles: bool = True
    #: The parts that are wanted; None for all. The others are null, and their sketches are not made.
    only: frozenset[Profiler] | None = None

    def made(self) -> ProfileConfig:
        """The configuration without the sketches of parts that are not wanted."""
        if self.only is None:
            return self
        return replace(self, count_distincts=self.count_distincts and Profiler.COUNT_UNIQUE in self.only, quantiles=self.quantiles and Profiler.PMF in self.only, items=self.items if Profiler.ITEMS in self.only else 0)


#: Between a long text's start and its hash; a noncharacter, which texts do not exchange.
_CUT = "\ufdd1"
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
#: Percentiles by which an approximate distribution is read from a sketch.
GRID = 400
_ITEM = "array<struct<item:string,count:bigint>>"
_BUCKET = "array<struct<low:double,high:double,count:bigint>>"
COLUMN_SCHEMA = (
    f"struct<name:string,data_type:string,data_type_json:string,nullable:boolean,enum_values:array<string>,format:string,count:bigint,count_empty:bigint,count_nulls:bigint,"
    f"count_unique:bigint,count_zeros:bigint,max_length:bigint,min:string,max:string,mean:double,pmf:{_BUCKET},items:{_ITEM},extras:map<string,string>>"
)
_WIDTH = {"byte": 1, "short": 2, "integer": 4, "long": 8, "float": 4, "double": 8}


@dataclass
class _Plan:
    """One profiled column: how its values are read, and its declared type."""

    name: str
    kind: T.DataType
    nullable: bool
    value: Column  # typed
    raw: Column  # as stored
    enum_values: tuple[str, ...] = ()
    format: str | None = None
    inferred: bool = False


def _family(kind: T.DataType) -> str:
    if isinstance(kind, T.StringType):
        return "string"
    if isinstance(kind, T.IntegralType | T.BooleanType | T.DateType | T.TimestampType | T.TimestampNTZType):
        return "integral"
    if isinstance(kind, T.FractionalType):
        return "fractional"
    if isinstance(kind, T.ArrayType | T.MapType | T.BinaryType):
        return "sized"
    if isinstance(kind, T.StructType):
        return "struct"
    raise PlumbrookError(f"columns of type {kind.simpleString()} can't be profiled")


def _number(plan: _Plan) -> Column:
    """A whole number for integral kinds (0 or 1, epoch seconds), a double for fractional ones."""
    kind = plan.kind
    if isinstance(kind, T.DateType):
        return F.unix_date(plan.value).cast("bigint") * 86400
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.unix_seconds(plan.value.cast("timestamp"))
    return plan.value.cast("double" if isinstance(kind, T.FractionalType) else "bigint")


def _aggregates(plan: _Plan, c: ProfileConfig, k: int) -> tuple[list[Column], list[Column]]:
    """The aggregates of a column, and the columns that they need beside those of the table."""
    family, v = _family(plan.kind), plan.value
    items: list[Column] = []
    out = [F.count_if(plan.raw.isNull()).alias(f"nulls{k}")]
    if family == "string":
        shown = F.substring(v, 1, c.max_item_length)
        out += [F.count_if(v == "").alias(f"empty{k}"), F.min(shown).alias(f"min{k}"), F.max(shown).alias(f"max{k}"), F.max(F.length(v)).cast("bigint").alias(f"length{k}")]
        # Values are told apart as a whole and cut only where they are shown: a long one is its start and a hash.
        item = F.when(F.length(v) <= c.max_item_length, v).otherwise(F.concat(shown, F.lit(_CUT), F.hex(F.xxhash64(v))))
    elif family == "sized":
        size = F.octet_length(v) if isinstance(plan.kind, T.BinaryType) else F.size(v)
        out += [F.count_if(v.isNotNull() & (size == 0)).alias(f"empty{k}"), F.max(F.when(v.isNotNull(), size)).cast("bigint").alias(f"length{k}")]
        item = None
    elif family == "struct":
        item = None
    else:
        x = _number(plan)
        own = F.when(~F.isnan(x), x) if family == "fractional" else x
        item = F.when(x.isNotNull(), x.cast(plan.kind) if isinstance(plan.kind, T.FloatType) else x)
        out += [F.count_if(own == 0).alias(f"zeros{k}"), F.min(own).alias(f"min{k}"), F.max(own).alias(f"max{k}"), F.avg(own.cast("double")).alias(f"mean{k}")]
        empty = F.isnan(x) if family == "fractional" else F.lit(False)
        if plan.inferred:
            empty = empty | (F.trim(plan.raw) == "")
            out.append(F.max(F.length(plan.raw)).cast("bigint").alias(f"length{k}"))
        out.append(F.count_if(empty).alias(f"empty{k}"))
        if family == "integral":
            out.append(F.max(F.when(own.isNotNull(), F.length(F.bin(F.abs(own))))).cast("bigint").alias(f"bits{k}"))
        if c.quantiles:
            # Expressions over named columns: the SQL-only sketch functions take no Column here.
            out += [F.call_function("kll_sketch_agg_double", own.cast("double")).alias(f"sketch{k}"), F.count(own).alias(f"n{k}")]
    if item is not None and plan.inferred:
        item = F.coalesce(item.cast("string"), F.when(F.trim(plan.raw) == "", plan.raw))
    if item is not None and c.items > 0:
        out.append(F.count(item).alias(f"valued{k}"))
        # Numbers are counted as numbers; of their texts there are as many as there are items.
        items.append(item.alias(f"i{k}"))
        tracked = 1 << max(4, (int((c.items + 1) / 0.75) - 1).bit_length())
        out.append(F.expr(f"approx_top_k(i{k}, {c.items + 1}, {max(tracked, c.items + 1)}) FILTER (WHERE i{k} IS NOT NULL)").alias(f"items{k}"))
    if item is not None and c.count_distincts:
        out.append(F.approx_count_distinct(item).alias(f"distinct{k}"))
    return out, items


_STATE = (
    "struct<nulls:bigint,empty:bigint,zeros:bigint,length:bigint,bits:bigint,low:string,high:string,low_number:double,high_number:double,mean:double,n:bigint,valued:bigint,distinct:bigint,"
    f"items:{_ITEM},quantiles:array<string>,ends:array<double>,grid:array<double>>"
)


def _state(plan: _Plan, c: ProfileConfig, k: int, names: set[str]) -> Column:
    """What the aggregated row holds of one column, in one shape for all kinds; absent parts are null."""
    family = _family(plan.kind)
    col = lambda n: F.col(f"{n}{k}") if f"{n}{k}" in names else F.lit(None)
    shown = plan.kind if family == "fractional" and not isinstance(plan.kind, T.DecimalType) else T.DoubleType() if family == "fractional" else T.LongType()
    text = lambda x: x if family == "string" else x.cast(shown).cast("string")
    quantile = lambda ranks: F.call_function("kll_sketch_get_quantile_double", col("sketch"), F.array(*(F.lit(r) for r in ranks)))
    ends = quantiles = grid = F.lit(None)
    if f"sketch{k}" in names:
        some = F.col(f"n{k}") > 0
        ends, quantiles = F.when(some, quantile((0.005, 0.995))), F.when(some, F.transform(quantile(QUANTILES), text))
        grid = F.when(some, quantile([g / GRID for g in range(GRID)])) if c.pmf_buckets > 0 else grid
    numbers = family in ("integral", "fractional")
    return F.struct(
        *(col(n).alias(n) for n in ("nulls", "empty", "zeros", "length", "bits")), text(col("min")).alias("low"), text(col("max")).alias("high"),
        *((col(n).cast("double") if numbers else F.lit(None)).alias(a) for n, a in (("min", "low_number"), ("max", "high_number"))), *(col(n).alias(n) for n in ("mean", "n", "valued", "distinct")),
        col("items").alias("items"), quantiles.alias("quantiles"), ends.alias("ends"), grid.alias("grid"),
    ).cast(_STATE)




def _finish(plan: tuple, s: dict, rows: int, c: ProfileConfig) -> dict:
    """The profile of one column from its state; plan: name, family, type name, type JSON, nullable, enum values, format, inferred, width."""
    name, family, kind, kind_json, nullable, enum_values, shape, inferred, width = plan
    whole = lambda x: None if x is None or x != x else int(x)
    numbers, has_items = family in ("integral", "fractional"), family in ("string", "integral", "fractional")
    items, exact, extras, unique, pmf = [], True, {}, None, []
    if has_items:
        if c.items > 0:
            found = [(i["item"], int(i["count"])) for i in (s["items"] if s["items"] is not None else ())]
            # Nothing was dropped from the sketch if its counts add up to all values.
            exact = len(found) <= c.items and sum(n for _, n in found) == s["valued"]
            # The largest counts, ties by item, shown in the order of the items.
            items = sorted(sorted(found, key=lambda f: (-f[1], f[0]))[: c.items])
        if c.count_distincts:
            unique = len(items) if exact and c.items > 0 else whole(s["distinct"])
        extras["is_exact"] = "true" if exact else "false"
    if family == "integral":
        extras["max_length_in_bits"] = str(whole(s["bits"]) or 0)
    if numbers and s["quantiles"] is not None:
        extras["quantiles"] = "{" + ", ".join(f'"{q:g}": "{v}"' for q, v in zip(QUANTILES, s["quantiles"], strict=True)) + "}"
        if c.pmf_buckets > 0:
            pmf = _discrete(items) if c.items > 0 and exact and len(items) > 1 else _approximate(s, c.pmf_buckets)
    length = whole(s["length"]) if family in ("string", "sized") or inferred else -(-(whole(s["bits"]) or 0) // 8) if family == "integral" else width
    mean = None if not numbers or s["mean"] is None or s["mean"] != s["mean"] else float(s["mean"])
    return {
        "name": name, "data_type": kind, "data_type_json": kind_json, "nullable": nullable, "enum_values": list(enum_values), "format": shape, "count": rows,
        "count_empty": None if family == "struct" else whole(s["empty"]), "count_nulls": whole(s["nulls"]), "count_unique": unique, "count_zeros": whole(s["zeros"]) if numbers else None, "max_length": length,
        "min": s["low"] if has_items else None, "max": s["high"] if has_items else None, "mean": mean if family != "integral" or mean is None else float(math.floor(mean + 0.5)), "pmf": pmf,
        "items": [{"item": i.partition(_CUT)[0] if family == "string" else i, "count": n} for i, n in items], "extras": extras,
    }


def _discrete(items: list[tuple[str, int]]) -> list[dict]:
    """Buckets around the items, as wide as the median gap between them."""
    points = sorted((x, n) for i, n in items if (x := _number_of(i)) is not None)
    gaps = sorted(b[0] - a[0] for a, b in zip(points, points[1:], strict=False))
    half = (gaps[len(gaps) // 2] if gaps else 1.0) / 2
    return [{"low": x - half, "high": x + half, "count": n} for x, n in points]


def _number_of(item: str) -> float | None:
    try:
        x = float(item)
    except ValueError:
        return None
    return x if math.isfinite(x) else None


def _approximate(s: dict, buckets: int) -> list[dict]:
    """Equal buckets from the 0.5 % to the 99.5 % percentile, widened by what lies beyond; counts by rank."""
    n = int(s["n"])
    if buckets == 1:
        return [{"low": float(s["low_number"]), "high": float(s["high_number"]), "count": n}]
    low, high = (float(x) for x in s["ends"])
    pad = (high - low) * (0.005 / 0.99)
    start, width = low - pad, (high - low + 2 * pad) / buckets
    grid = sorted(float(g) for g in s["grid"])
    # The outer buckets take all that lies beyond them.
    upto = [0, *(round(bisect.bisect_left(grid, start + width * k) / len(grid) * n) for k in range(1, buckets)), n]
    return [{"low": start + width * k, "high": start + width * (k + 1), "count": upto[k + 1] - upto[k]} for k in range(buckets)]


def _plan_values(p: _Plan) -> tuple:
    family, kind = _family(p.kind), p.kind.typeName()
    width = _WIDTH.get(kind, 4 if getattr(p.kind, "precision", 0) <= 9 else 8 if getattr(p.kind, "precision", 0) <= 18 else 16) if family == "fractional" else None
    return p.name, family, kind.split("(")[0], None if family in ("sized", "struct") else p.kind.json(), p.nullable, p.enum_values, p.format, p.inferred, width


@dataclass(frozen=True)
class Profile:
    """A profile as one row (result) or one row per column (columns)."""

    row: DataFrame

    def result(self) -> DataFrame:
        return self.row.select(F.struct(F.col("row_count").alias("rows")).alias("table"), "columns")

    def columns(self) -> DataFrame:
        return self.row.select(F.inline("columns"))


def profile(df: DataFrame, config: ProfileConfig = ProfileConfig()) -> Profile:
    """The profile of all columns of df."""
    config = config.made()
    numbered = df.toDF(*(f"v{k}" for k in range(len(df.columns))))
    plans = [_Plan(f.name, f.dataType, f.nullable, F.col(f"v{k}"), F.col(f"v{k}")) for k, f in enumerate(df.schema.fields)]
    for p in plans:
        _family(p.kind)
    if config.infer_types_from_strings:
        plans = _inferred(numbered, plans, config)
    made = [_aggregates(p, config, k) for k, p in enumerate(plans)]
    aggregates, items = [a for own, _ in made for a in own], [i for _, own in made for i in own]
    one = numbered.select("*", *items).agg(F.count(F.lit(1)).alias("row_count"), *aggregates)
    states = one.select("row_count", F.array(*(_state(p, config, k, set(one.columns)) for k, p in enumerate(plans))).alias("states"))
    values = [_plan_values(p) for p in plans]

    unwanted = {} if config.only is None else {p.value: None for p in Profiler if p not in config.only}

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(int(n), [_finish(v, s, int(n), config) | unwanted for v, s in zip(values, own, strict=True)]) for n, own in zip(frame["row_count"], frame["states"], strict=True)]
            yield pd.DataFrame(rows, columns=["row_count", "columns"])

    return Profile(states.mapInPandas(finish, f"row_count bigint, columns array<{COLUMN_SCHEMA}>"))  # one row


_WHOLE, _FRACTION = r"^\s*[+-]?[0-9]+\s*$", r"^\s*([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|NaN|[+-]?Infinity)\s*$"


def _inferred(numbered: DataFrame, plans: list[_Plan], c: ProfileConfig) -> list[_Plan]:
    """The narrowest type that reads every non-blank value of a text column; one pass, one row to the driver."""
    rules = c.inference
    texts = [k for k, p in enumerate(plans) if isinstance(p.kind, T.StringType)]
    if not texts:
        return plans
    # One row per text: the tests are written once, in code that stays small whatever the number of columns.
    each = numbered.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"v{k}").alias("raw")) for k in texts))).alias("e")).select("e.k", "e.raw")
    v = F.when(F.trim("raw") != "", F.col("raw"))
    plain = each.select("k", "raw", v.alias("v"), F.when(v.rlike(_WHOLE), F.trim(v).try_cast("bigint")).alias("integral"), F.when(v.rlike(_FRACTION), F.trim(v).try_cast("double")).alias("fraction"))
    v, integral = F.col("v"), F.col("integral")
    tests = [
        F.count(v).alias("n"), F.count_if(F.col("raw").isNull()).alias("null"), F.count(integral).alias("long"), F.count_if((integral >= -(1 << 31)) & (integral < 1 << 31)).alias("int"),
        F.count_if(integral.isin(0, 1)).alias("bit"), F.count("fraction").alias("double"),
    ]
    tests += [F.count(_read_time(v, f)).alias(f"date{j}") for j, f in enumerate(rules.date_formats)]
    tests += [F.count(_read_time(v, f)).alias(f"time{j}") for j, f in enumerate(rules.timestamp_formats)]
    tests += [F.count_if(F.upper(F.trim(v)).isin([x.upper() for x in values])).alias(f"enum{j}") for j, (_, values) in enumerate(rules.enums)]
    found = {r["k"]: r.asDict() for r in plain.groupBy("k").agg(*tests).collect()}  # one row per column
    got = {f"{name}_{k}": n for k, row in found.items() for name, n in row.items()}
    out = list(plans)
    for k in texts:
        n, p, v = got.get(f"n_{k}", 0), plans[k], F.col(f"v{k}")
        if n == 0:
            continue
        t = F.trim(v)
        kind, value, values, shape = None, None, (), None
        if got[f"bit_{k}"] == n and rules.prefer_boolean_for_01:
            kind, value, values = T.BooleanType(), t == "1", ("0", "1")
        elif got[f"long_{k}"] == n:
            kind = T.IntegerType() if rules.prefer_integer and got[f"int_{k}"] == n else T.LongType()
            value = t.try_cast(kind)
        elif got[f"double_{k}"] == n:
            kind = T.FloatType() if rules.prefer_float else T.DoubleType()
            value = t.try_cast(kind)
        else:
            for j, f in enumerate(rules.date_formats):
                if kind is None and got[f"date{j}_{k}"] == n:
                    kind, value, shape = T.DateType(), _read_time(v, f).cast("date"), f
            for j, f in enumerate(rules.timestamp_formats):
                if kind is None and got[f"time{j}_{k}"] == n:
                    kind, value, shape = T.TimestampType(), _in_zone(_read_time(v, f), rules.time_zone), f
            for j, (name, listed) in enumerate(rules.enums):
                if kind is None and got[f"enum{j}_{k}"] == n:
                    upper = F.upper(t)
                    if name.lower() == "boolean" and len(listed) == 2:
                        kind, value, values = T.BooleanType(), F.when(upper == listed[0].upper(), False).when(upper == listed[1].upper(), True), listed
                    else:
                        place = F.array_position(F.array(*(F.lit(x.upper()) for x in listed)), upper) - 1
                        kind, value, values = T.IntegerType(), F.when(place >= 0, place.cast("int")), listed
        if kind is not None:
            nullable = not (rules.prefer_not_nullable and got[f"null_{k}"] == 0)
            out[k] = _Plan(p.name, kind, nullable, value, p.raw, tuple(values), shape, True)
        elif rules.prefer_not_nullable and got[f"null_{k}"] == 0:
            out[k] = _Plan(p.name, p.kind, False, p.value, p.raw)
    return out


def _in_zone(read: Column, zone: str | None) -> Column:
    """A moment read in the session's zone as the one of the same clock in another zone."""
    return read if zone is None else F.from_utc_timestamp(F.to_utc_timestamp(read, zone), F.current_timezone())


def _read_time(v: Column, pattern: str) -> Column:
    """The moment in a text, else null. Texts of another shape are not parsed: a failing parse is slow."""
    shape = ""
    for m in re.finditer(r"([A-Za-z])\1*|'[^']*'|[^A-Za-z']", pattern):
        part = m[0]
        if m[1]:
            if m[1] not in "yMdHms" or len(part) < 2 or (m[1] == "M" and len(part) > 2):
                shape = None
                break
            shape += f"[0-9]{{{len(part)}}}"
        else:
            shape += re.escape(part.strip("'") or "'")
    read = F.try_to_timestamp(v, F.lit(pattern))
    return read if shape is None else F.when(v.rlike(f"^{shape}$"), read)


def schema_of(columns: Sequence) -> T.StructType:
    """A schema from the rows of Profile.columns(); enum values and formats become metadata."""
    import json

    fields = []
    for r in columns:
        meta = {}
        if r["enum_values"]:
            meta["enum_values"] = list(r["enum_values"])
        if r["format"]:
            meta["format"] = r["format"]
        if r["data_type_json"] is None:
            raise PlumbrookError(f"the profile of {r['name']} ({r['data_type']}) holds no type")
        fields.append(T.StructField(r["name"], T._parse_datatype_json_value(json.loads(r["data_type_json"])), r["nullable"], meta))
    return T.StructType(fields)


def update_schema(schema: T.StructType, columns: Sequence) -> T.StructType:
    """The schema with the fields that are profiled replaced; others stay."""
    by_name = {r["name"].lower(): r for r in columns if r["data_type_json"] is not None}
    return T.StructType([schema_of([by_name[f.name.lower()]]).fields[0] if f.name.lower() in by_name else f for f in schema.fields])


def legacy_profile(df: DataFrame, config: ProfileConfig = ProfileConfig()) -> DataFrame:
    """The profile of all columns and, with dotted names, of all fields of structs."""

    def flat(schema: T.StructType, prefix: str, column) -> list[Column]:
        out = []
        for f in schema.fields:
            c = column(f.name)
            out.append(c.alias(prefix + f.name))
            if isinstance(f.dataType, T.StructType):
                out += flat(f.dataType, f"{prefix}{f.name}.", lambda n, c=c: c.getField(n))
        return out

    return profile(df.select(*flat(df.schema, "", lambda n: F.col(f"`{n}`"))), config).columns()
