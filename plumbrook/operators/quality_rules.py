"""Declarative data quality rules: SQL expressions with names, and rules derived from declared fields."""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import types as T

from plumbrook.errors import PlumbrookError
from plumbrook.functions.text import sql_literal
from plumbrook.plans.introspect import can_cast, expression_sql, quote_if_needed

NAME_SEPARATOR = "__"


@dataclass(frozen=True)
class Rule:
    """A boolean SQL expression that holds for good rows."""

    name: str
    expression: str
    description: str | None = None
    referenced_column_names: tuple[str, ...] = ()


@dataclass(frozen=True)
class Field:
    """What is expected of a column."""

    name: str
    data_type_json: str
    nullable: bool = True
    enum_values: tuple[str, ...] = ()
    format: str | None = None
    regexp: str | None = None


def rule_name(field: str, logical: str) -> str:
    return f"{field}{NAME_SEPARATOR}{logical}"


def rule(name: str | Column, expression: str | None = None, description: str | None = None) -> Rule:
    """A rule from a name and an expression, or from a column with an alias."""
    if isinstance(name, Column):
        alias, text = expression_sql(name)
        if alias is None:
            raise PlumbrookError(f"the rule {text} needs a name: give the column an alias")
        return Rule(alias, text, description)
    return Rule(name, expression or "", description)


def named_rule(field: str, logical: str, expression: str, description: str | None = None) -> Rule:
    return Rule(rule_name(field, logical), expression, description)


def null_safe_rule(field: str, logical: str, expression: str, description: str | None = None) -> Rule:
    """Holds for null as well."""
    return named_rule(field, logical, f"{quote_if_needed(field)} IS NULL OR ({expression})", description)


def enum_rule(field: str, values: Sequence[str], ignore_case: bool = False, description: str | None = None) -> Rule:
    text = f"CAST({quote_if_needed(field)} AS STRING)"
    shown = [v.upper() for v in values] if ignore_case else values
    listed = ", ".join(sql_literal(v) for v in shown)
    # An empty list of values is met by nothing.
    return null_safe_rule(field, "enum_values", f"{f'UPPER({text})' if ignore_case else text} IN ({listed})" if listed else "false", description)


def not_null_rule(field: str, description: str | None = None) -> Rule:
    return named_rule(field, "not_null", f"{quote_if_needed(field)} IS NOT NULL", description)


def regexp_rule(field: str, pattern: str, description: str | None = None) -> Rule:
    """The pattern is found in the value's text; quotes are escaped, backslashes are as in a SQL literal."""
    escaped = pattern.replace("'", "\\'")
    return null_safe_rule(field, "regexp", f"CAST({quote_if_needed(field)} AS STRING) RLIKE '{escaped}'", description)


def type_rule(spark: SparkSession, field: str, source: T.DataType, target: T.DataType, format: str | None = None) -> Rule:
    """Every value can be read as the target type; values that can't are null under TRY_*, not an error."""
    name = quote_if_needed(field)
    if not can_cast(spark, source, target):
        return named_rule(field, "type", "false", f"{source.simpleString()} is never read as {target.simpleString()}")
    if format and isinstance(target, T.DateType):
        read = f"TRY_TO_DATE({name}, {sql_literal(format)})"
    elif format and isinstance(target, T.TimestampType | T.TimestampNTZType):
        read = f"TRY_TO_TIMESTAMP({name}, {sql_literal(format)})"
    else:
        read = f"TRY_CAST({name} AS {target.simpleString().upper()})"
    return null_safe_rule(field, "type", f"{read} IS NOT NULL")


def unique_rule(name: str, fields: Sequence[str] | None = None, description: str | None = None) -> Rule:
    """No two rows are alike in the fields; of nulls there may be one. Rules over equal fields share one shuffle."""
    return named_rule(name, "unique", unique_expression(fields or [name]), description)


def unique_expression(keys: Sequence[str]) -> str:
    return f"(COUNT(*) OVER (PARTITION BY {', '.join(quote_if_needed(k) for k in keys)})) = 1"


_UNIQUE = re.compile(r"\s*\(?COUNT\(\*\) OVER \(PARTITION BY ((?:[A-Za-z_]\w*|`(?:[^`]|``)+`)(?:, (?:[A-Za-z_]\w*|`(?:[^`]|``)+`))*)\)\)? = 1\s*", re.I)


def unique_keys(expression: str) -> list[str] | None:
    """The key columns of an expression that says they are unique, as unique_expression writes it; else None."""
    m = _UNIQUE.fullmatch(expression)
    if not m or expression.count("(") != expression.count(")"):
        return None
    return [k[1:-1].replace("``", "`") if k.startswith("`") else k for k in re.findall(r"[A-Za-z_]\w*|`(?:[^`]|``)+`", m[1])]


def all_of(name: str, rules: Sequence[Rule], description: str | None = None) -> Rule:
    return Rule(name, " AND ".join(f"({r.expression})" for r in rules), description)


def any_of(name: str, rules: Sequence[Rule], description: str | None = None) -> Rule:
    return Rule(name, " OR ".join(f"({r.expression})" for r in rules), description)


def parse_type(text: str) -> T.DataType:
    """A type from its JSON."""
    import json

    kind = json.loads(text)
    if kind in ("null", "void"):
        return T.NullType()
    return T._parse_datatype_json_value(kind)


def schema_rules(spark: SparkSession, schema: T.StructType, fields: Sequence[Field], primary_key: Sequence[str], fail_on_extra_columns: bool = False) -> list[Rule]:
    """Rules for missing and extra columns, the primary key, and type, null, values and pattern of each field."""
    by_name = {f.name.lower(): f for f in schema.fields}
    expected = {f.name.lower() for f in fields}
    rules = []
    if missing := [f.name for f in fields if f.name.lower() not in by_name]:
        rules.append(Rule("__no_missing_fields", "false", f"not in the table: {', '.join(missing)}", tuple([*missing, *(k for k in primary_key if k.lower() not in by_name)])))
    extra = [f.name for f in schema.fields if f.name.lower() not in expected]
    if fail_on_extra_columns and extra:
        rules.append(Rule("__no_extra_fields", "false", f"not declared: {', '.join(extra)}"))
    keys = [quote_if_needed(k) for k in primary_key if k.lower() in by_name]
    if keys and len(keys) == len(primary_key):
        rules.append(Rule("__primary_key_not_null", " AND ".join(f"{k} IS NOT NULL" for k in keys)))
        rules.append(Rule("__primary_key_unique", unique_expression(primary_key)))
    for f in fields:
        own = by_name.get(f.name.lower())
        if own is None:
            continue
        rules.append(type_rule(spark, f.name, own.dataType, parse_type(f.data_type_json), f.format))
        if not f.nullable:
            rules.append(not_null_rule(f.name))
        if f.enum_values:
            rules.append(enum_rule(f.name, f.enum_values))
        if f.regexp:
            rules.append(regexp_rule(f.name, f.regexp))
    return rules


#: Types of dataclass fields and the types expected of their columns.
FIELD_TYPES: dict[Any, str] = {bool: '"boolean"', int: '"long"', float: '"double"', str: '"string"', bytes: '"binary"'}


def fields_of(entity: type, ignore_unsupported: bool = False) -> list[Field]:
    """Expected fields from a dataclass; metadata keys: name, data_type_json, nullable, enum_values, format, regexp, ignore."""
    import datetime
    import decimal
    import types as pytypes
    import typing

    kinds = FIELD_TYPES | {datetime.date: '"date"', datetime.datetime: '"timestamp"', decimal.Decimal: '"decimal(38,18)"'}
    hints = typing.get_type_hints(entity)
    out = []
    for f in dataclasses.fields(entity):
        meta = f.metadata
        if meta.get("ignore"):
            continue
        hint, optional = hints[f.name], False
        if typing.get_origin(hint) in (typing.Union, pytypes.UnionType):
            inner = [a for a in typing.get_args(hint) if a is not type(None)]
            optional, hint = len(inner) < len(typing.get_args(hint)), inner[0]
        text = meta.get("data_type_json") or kinds.get(hint)
        if text is None and typing.get_origin(hint) is list:
            item = kinds.get(typing.get_args(hint)[0])
            text = f'{{"type":"array","elementType":{item},"containsNull":true}}' if item else None
        if text is None and typing.get_origin(hint) is dict:
            pair = [kinds.get(a) for a in typing.get_args(hint)]
            text = f'{{"type":"map","keyType":{pair[0]},"valueType":{pair[1]},"valueContainsNull":true}}' if all(pair) else None
        if text is None:
            if ignore_unsupported:
                continue
            raise PlumbrookError(f"field {f.name} of {entity.__name__} has the unsupported type {hint}")
        out.append(Field(meta.get("name", f.name), text, meta.get("nullable", True if optional or "nullable" not in meta else meta["nullable"]), tuple(meta.get("enum_values", ())), meta.get("format"), meta.get("regexp")))
    return out
