"""One schema to another as a single projection: names, types, nesting, enums, dates, missing and extra fields.

All that does not fit is collected and raised once. Casts give null for values that can't be read.
"""

from __future__ import annotations

import dataclasses
import datetime
import decimal
import re
import types as pytypes
import typing
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbrook.errors import PlumbrookError
from plumbrook.functions.text import snake_case
from plumbrook.plans.introspect import can_cast

ENUM_VALUES, FORMAT = "enum_values", "format"


class ReshapeError(PlumbrookError):
    """All reasons why a table can't be given the target schema."""

    def __init__(self, errors: Sequence[str]):
        super().__init__("; ".join(errors))
        self.errors = list(errors)


@dataclass(frozen=True)
class ReshapeConfig:
    """matching: default (trimmed, any case), exact, normalized (snake case) or index. conflicts: error, first or last.

    order: target, source or alphabetical.
    """

    coerce_types: bool = False
    conflicts: str = "error"
    date_format: str | None = None
    timestamp_format: str | None = None
    drop_extra_columns: bool = False
    fail_on_extra_column: bool = False
    fail_on_ignoring_nullability: bool = False
    matching: str = "default"
    fill_default_values: bool = False
    fill_missing_nulls: bool = False
    order: str = "source"
    #: A null struct stays null; otherwise it becomes a struct of nulls.
    keep_null_structs: bool = True


SPARK = ReshapeConfig()
PARANOID = replace(SPARK, fail_on_extra_column=True, fail_on_ignoring_nullability=True)
DEFAULT = replace(SPARK, coerce_types=True, drop_extra_columns=True, order="target")
DANGEROUS = replace(DEFAULT, conflicts="last", fill_default_values=True, fill_missing_nulls=True, matching="normalized")
NOTEBOOK = replace(SPARK, coerce_types=True, conflicts="last", fill_missing_nulls=True, matching="normalized")


@dataclass
class _Source:
    name: str
    kind: T.DataType
    nullable: bool
    column: Column
    metadata: dict


@dataclass
class _Planner:
    spark: SparkSession
    config: ReshapeConfig
    errors: list[str] = field(default_factory=list)

    def key(self, name: str) -> str:
        if self.config.matching == "exact":
            return name
        if self.config.matching == "normalized":
            return re.sub(r"_+", "_", snake_case(name.strip())).replace("_", "")
        return name.strip().lower()

    def project(self, sources: list[_Source], target: T.StructType, path: str) -> list[Column]:
        """The output columns, in the configured order."""
        c = self.config
        pairs = self._by_index(sources, target, path) if c.matching == "index" else self._by_name(sources, target, path)
        made = []  # (source place, target place, name, column)
        for at, to, source, wanted in pairs:
            if wanted is None:
                if c.fail_on_extra_column:
                    self.errors.append(f"the target has no field for {path}{source.name}")
                elif not c.drop_extra_columns:
                    made.append((at, to, source.name, source.column.alias(source.name, metadata=source.metadata)))
            else:
                column = self.missing(wanted, path) if source is None else self.value(source, wanted, path)
                if column is not None:
                    made.append((at, to, wanted.name, column.alias(wanted.name, metadata=dict(wanted.metadata or {}))))
        places = {"target": lambda m: (m[1], m[0]), "source": lambda m: (m[0], m[1]), "alphabetical": lambda m: m[2]}
        return [m[3] for m in sorted(made, key=places[c.order])]

    def _by_index(self, sources: list[_Source], target: T.StructType, path: str):
        for k in range(max(len(sources), len(target.fields))):
            yield k, k, sources[k] if k < len(sources) else None, target.fields[k] if k < len(target.fields) else None

    def _by_name(self, sources: list[_Source], target: T.StructType, path: str):
        far = len(sources) + len(target.fields)
        by_key: dict[str, list[int]] = {}
        for k, s in enumerate(sources):
            by_key.setdefault(self.key(s.name), []).append(k)
        wanted: dict[str, int] = {}
        for to, f in enumerate(target.fields):
            if self.key(f.name) in wanted:
                self.errors.append(f"{path}{f.name} occurs twice in the target")
                continue
            wanted[self.key(f.name)] = to
            places = by_key.get(self.key(f.name), [])
            if not places:
                yield far + to, to, None, f
                continue
            if len(places) > 1 and self.config.conflicts == "error":
                self.errors.append(f"{len(places)} columns of the table go by the name {path}{f.name}")
            at = places[0] if self.config.conflicts == "first" else places[-1]
            yield at, to, sources[at], f
        for k, s in enumerate(sources):
            if self.key(s.name) not in wanted:
                yield k, far + k, s, None

    def missing(self, wanted: T.StructField, path: str) -> Column | None:
        c = self.config
        if c.fill_missing_nulls and wanted.nullable:
            return F.lit(None).cast(wanted.dataType)
        if c.fill_default_values and (value := self.default(wanted.dataType)) is not None:
            return value
        self.errors.append(f"the table has nothing for {path}{wanted.name}")
        return None

    def default(self, kind: T.DataType) -> Column | None:
        if isinstance(kind, T.StructType):
            parts = [self.default(f.dataType) for f in kind.fields]
            return None if any(p is None for p in parts) else F.struct(*(p.alias(f.name) for p, f in zip(parts, kind.fields, strict=True)))
        if isinstance(kind, T.ArrayType):
            return F.array().cast(kind)
        if isinstance(kind, T.MapType):
            return F.create_map().cast(kind)
        text = "" if isinstance(kind, T.StringType | T.BinaryType) else "false" if isinstance(kind, T.BooleanType) else "1970-01-01" if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType) else "0"
        return F.lit(text).cast(kind)

    def value(self, source: _Source, wanted: T.StructField, path: str) -> Column | None:
        column = self.convert(source.column, source.kind, wanted.dataType, f"{path}{wanted.name}", source.metadata, dict(wanted.metadata or {}))
        if column is not None and source.nullable and not wanted.nullable:
            if self.config.fill_default_values and (value := self.default(wanted.dataType)) is not None:
                return F.coalesce(column, value)
            if self.config.fail_on_ignoring_nullability:
                self.errors.append(f"{path}{wanted.name} may hold nulls, which the target forbids")
        return column

    def convert(self, column: Column, kind: T.DataType, wanted: T.DataType, path: str, old: dict, new: dict) -> Column | None:
        if isinstance(kind, T.StructType) and isinstance(wanted, T.StructType):
            inner = [_Source(f.name, f.dataType, f.nullable, column.getField(f.name), dict(f.metadata or {})) for f in kind.fields]
            made = F.struct(*self.project(inner, wanted, f"{path}."))
            return F.when(column.isNotNull(), made) if self.config.keep_null_structs else made
        if isinstance(kind, T.ArrayType) and isinstance(wanted, T.ArrayType):
            if kind.elementType == wanted.elementType:
                return column
            return F.transform(column, self._inner(kind.elementType, wanted.elementType, f"{path}[]"))
        if isinstance(kind, T.MapType) and isinstance(wanted, T.MapType):
            if kind.keyType != wanted.keyType:
                to_key = self._inner(kind.keyType, wanted.keyType, f"{path}.key")
                column = F.transform_keys(column, lambda k, v: to_key(k))
            if kind.valueType != wanted.valueType:
                to_value = self._inner(kind.valueType, wanted.valueType, f"{path}.value")
                column = F.transform_values(column, lambda k, v: to_value(v))
            return column
        if (special := self._by_metadata(column, kind, wanted, old, new)) is not None:
            return special
        if kind == wanted:
            return column
        if not self.config.coerce_types or not can_cast(self.spark, kind, wanted):
            self.errors.append(f"no way from {kind.simpleString()} to {wanted.simpleString()} for {path}")
            return None
        return column.try_cast(wanted) if _may_fail(kind, wanted) else column.cast(wanted)

    def _inner(self, kind: T.DataType, wanted: T.DataType, path: str) -> Callable[[Column], Column]:
        def one(x: Column) -> Column:
            return made if (made := self.convert(x, kind, wanted, path, {}, {})) is not None else F.lit(None).cast(wanted)

        return one

    def _by_metadata(self, column: Column, kind: T.DataType, wanted: T.DataType, old: dict, new: dict) -> Column | None:
        text, values = isinstance(kind, T.StringType), new.get(ENUM_VALUES)
        whole = T.IntegralType
        if values and text and isinstance(wanted, whole):
            listed = F.array(*(F.lit(v.upper()) for v in values))
            return (F.array_position(listed, F.upper(F.trim(column))) - 1).cast(wanted)
        if values and text and isinstance(wanted, T.BooleanType) and len(values) == 2:
            plain = F.upper(F.trim(column))
            return F.when(plain == values[0].upper(), F.lit(False)).when(plain == values[1].upper(), F.lit(True))
        values = old.get(ENUM_VALUES)
        if values and isinstance(wanted, T.StringType):
            if isinstance(kind, whole):
                listed = F.array(*(F.lit(v) for v in values))
                return F.when(column >= 0, F.get(listed, column))
            if isinstance(kind, T.BooleanType) and len(values) == 2:
                return F.when(column, F.lit(values[1].upper())).when(~column, F.lit(values[0].upper()))
        dates, times = isinstance(wanted, T.DateType), isinstance(wanted, T.TimestampType | T.TimestampNTZType)
        if text and (dates or times):
            shape = new.get(FORMAT) or (self.config.date_format if dates else self.config.timestamp_format)
            if shape:
                return F.try_to_date(column, shape) if dates else F.try_to_timestamp(column, F.lit(shape)).cast(wanted)
        if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType) and isinstance(wanted, T.StringType) and (shape := new.get(FORMAT) or old.get(FORMAT)):
            return F.date_format(column, shape)
        return None


def _may_fail(kind: T.DataType, wanted: T.DataType) -> bool:
    return not isinstance(wanted, T.StringType) and kind != T.NullType()


_PLAIN = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType(), datetime.date: T.DateType(), datetime.datetime: T.TimestampType(), decimal.Decimal: T.DecimalType(38, 18)}


def _type_of(hint: object) -> tuple[T.DataType, bool]:
    """The type of a hint, and whether it may be null."""
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin in (typing.Union, pytypes.UnionType):
        inner = [a for a in args if a is not type(None)]
        if len(inner) == 1:
            return _type_of(inner[0])[0], len(inner) < len(args)
    if origin is list:
        kind, nullable = _type_of(args[0])
        return T.ArrayType(kind, nullable), False
    if origin is dict:
        kind, nullable = _type_of(args[1])
        return T.MapType(_type_of(args[0])[0], kind, nullable), False
    if dataclasses.is_dataclass(hint):
        return struct_of(hint), False
    if hint in _PLAIN:
        return _PLAIN[hint], False
    raise PlumbrookError(f"no column type stands for {hint}")


def struct_of(entity: type) -> T.StructType:
    """The schema of a dataclass: hints give types, `X | None` nulls; nested dataclasses, lists and dicts are nested.

    Metadata of a field: name, type (a Spark type instead of the hint's), nullable, ignore, and enum_values and format
    as reshape reads them.
    """
    hints, fields = typing.get_type_hints(entity), []
    for f in dataclasses.fields(entity):
        if f.metadata.get("ignore"):
            continue
        kind, nullable = (f.metadata["type"], True) if "type" in f.metadata else _type_of(hints[f.name])
        kept = {k: list(v) if k == ENUM_VALUES else v for k, v in f.metadata.items() if k in (ENUM_VALUES, FORMAT)}
        fields.append(T.StructField(f.metadata.get("name", f.name), kind, f.metadata.get("nullable", nullable), kept))
    return T.StructType(fields)


def reshape(df: DataFrame, target: T.StructType | type, config: ReshapeConfig = DEFAULT) -> DataFrame:
    """df with the target schema, or that of a dataclass; the same df if it has it already."""
    if dataclasses.is_dataclass(target):
        target = struct_of(target)
    if not isinstance(target, T.StructType):
        raise PlumbrookError(f"a struct type is required as target, not {target}")
    if df.schema == target:
        return df
    numbered = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    sources = [_Source(f.name, f.dataType, f.nullable, F.col(f"c{k}"), dict(f.metadata or {})) for k, f in enumerate(df.schema.fields)]
    planner = _Planner(df.sparkSession, config)
    columns = planner.project(sources, target, "")
    if planner.errors:
        raise ReshapeError(planner.errors)
    return numbered.select(*columns)
