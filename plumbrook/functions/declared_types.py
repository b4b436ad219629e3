"""Declared field types: canonical form of a type's JSON, value checks and canonical value texts.

A type's JSON is a string such as "integer" or an object such as {"type": "array", ...}; blanks,
letter case of simple names and the order of an object's keys do not matter.
"""

from __future__ import annotations

import datetime
import decimal
import json
import re
from collections.abc import Callable
from functools import lru_cache

#: Other spellings of simple type names.
SYNONYMS = {"int": "integer", "bigint": "long", "smallint": "short", "tinyint": "byte", "bool": "boolean", "real": "float", "numeric": "decimal(10,0)", "decimal": "decimal(10,0)"}
INTEGER_BITS = {"byte": 8, "short": 16, "integer": 32, "long": 64}

_DECIMAL = re.compile(r"decimal\(\s*(\d+)\s*,\s*(-?\d+)\s*\)")
_WHOLE = re.compile(r"[+-]?[0-9]+")
_NUMERAL = re.compile(r"\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*")
_FIXED = re.compile(r"[+-]?([0-9]*)(?:\.([0-9]*))?")
_DATE_PART = re.compile(r"y+|M+|d+|'[^']*'|.", re.S)


def canonical_type(text: str | None) -> str:
    """One text per type; texts that are no JSON stand for themselves."""
    try:
        kind = json.loads(text) if text is not None else "string"
    except ValueError:
        kind = text
    return _canonical(kind)


def _canonical(kind: object) -> str:
    if isinstance(kind, str):
        name = kind.strip().lower()
        if m := _DECIMAL.fullmatch(name):
            return f"decimal({int(m[1])},{int(m[2])})"
        return SYNONYMS.get(name, name)
    if isinstance(kind, dict):
        inner = {k: _canonical(v) if k in ("elementType", "keyType", "valueType", "type") and k != "type" else v for k, v in kind.items()}
        if kind.get("type") == "struct":
            inner["fields"] = [{"name": f.get("name"), "type": _canonical(f.get("type")), "nullable": f.get("nullable", True)} for f in kind.get("fields", [])]
        return json.dumps(inner, sort_keys=True)
    return json.dumps(kind)


def is_numeric(kind: str) -> bool:
    return kind in INTEGER_BITS or kind in ("double", "float") or kind.startswith("decimal(")


@lru_cache(maxsize=256)
def date_reader(pattern: str | None) -> Callable[[str], datetime.date | None]:
    """Reads a day in a pattern of y, M, d and literal characters; None if it is no existing day."""
    parts: list[str] = []
    for part in _DATE_PART.findall(pattern or "yyyy-MM-dd"):
        if part[0] in "yMd" and set(part) <= set("yMd"):
            width = len(part)
            parts.append(f"(?P<{part[0]}>[0-9]{{{width}}})" if width > 1 else f"(?P<{part[0]}>[0-9]{{1,4}})")
        else:
            parts.append(re.escape(part.strip("'") if len(part) > 1 else part))
    try:
        whole = re.compile("".join(parts))
    except re.error:
        return lambda text: None

    @lru_cache(maxsize=20_000)
    def read(text: str) -> datetime.date | None:
        if not (m := whole.fullmatch(text)):
            return None
        got = m.groupdict()
        try:
            year = got.get("y", "1970")
            return datetime.date(int(year) + (2000 if len(year) == 2 else 0), int(got.get("M", 1)), int(got.get("d", 1)))
        except ValueError:
            return None

    return read


def value_check(kind: str, pattern: str | None = None) -> Callable[[str], object] | None:
    """Tells by a true value whether a text is a value of the type; None if every text is.

    Blanks around numbers do not matter.
    """
    if kind in INTEGER_BITS:
        bound = 1 << (INTEGER_BITS[kind] - 1)
        short = re.compile(r"\s*[+-]?[0-9]{1,%d}\s*" % (len(str(bound)) - 1)).fullmatch  # in range whatever the digits

        def whole(text: str) -> object:
            if short(text):
                return True
            text = text.strip()
            if not _WHOLE.fullmatch(text):
                return False
            digits = text.lstrip("+-").lstrip("0")
            return len(digits) <= 19 and -bound <= int(text) < bound

        return whole
    if kind in ("double", "float"):
        return _NUMERAL.fullmatch
    if m := _DECIMAL.fullmatch(kind):
        before, after = int(m[1]) - int(m[2]), int(m[2])
        if before < 0 or after < 0:  # no Spark type; the digits are counted

            def fixed(text: str) -> object:
                m = _FIXED.fullmatch(text.strip())
                return m and (m[1] or m[2]) and len(m[1].lstrip("0")) <= before and len(m[2] or "") <= after

            return fixed
        return re.compile(r"\s*[+-]?(?=\.?[0-9])0*[0-9]{0,%d}(?:\.[0-9]{0,%d})?\s*" % (before, after)).fullmatch
    if kind == "date":
        return date_reader(pattern)
    if kind == "boolean":
        return lambda text: text.lower() in ("true", "false")
    return None


def canonical_value(kind: str, pattern: str | None = None) -> Callable[[str], str]:
    """One text per value: numbers without needless digits, days as yyyy-MM-dd, booleans in lower case.

    Numbers of different numeric types that are equal have the same text. Texts that do not fit are kept.
    """
    if is_numeric(kind):

        def number(text: str) -> str:
            try:
                value = decimal.Decimal(text.strip())
            except decimal.InvalidOperation:
                return text
            if not value.is_finite() or abs(value.adjusted()) > 400:
                return text.strip()
            plain = format(value, "f")
            plain = plain.rstrip("0").rstrip(".") if "." in plain else plain
            return "0" if plain in ("-0", "") else plain.lstrip("+")

        return number
    if kind == "date":
        read = date_reader(pattern)
        return lambda text: day.isoformat() if (day := read(text)) else text
    if kind == "boolean":
        return str.lower
    return lambda text: text


def common_type(kinds: list[str]) -> str:
    """The narrowest type that holds all values of the given types; string if they are of several families."""
    kinds = sorted(set(kinds))
    if len(kinds) == 1:
        return kinds[0]
    if all(k in INTEGER_BITS for k in kinds):
        return max(kinds, key=INTEGER_BITS.__getitem__)
    if all(is_numeric(k) for k in kinds):
        if any(k in ("double", "float") for k in kinds):
            return "double"
        sizes = [(int(m[1]) - int(m[2]), int(m[2])) if (m := _DECIMAL.fullmatch(k)) else ({"byte": 3, "short": 5, "integer": 10, "long": 19}[k], 0) for k in kinds]
        before, after = max(b for b, _ in sizes), max(a for _, a in sizes)
        return f"decimal({before + after},{after})" if before + after <= 38 else "double"
    return "string"
