"""Small text helpers: letter case of names, parameters, SQL literals, comments."""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Mapping, Sequence
from typing import Any

_PARAM = re.compile(r"\$\{([^}]*)\}")
_UPPER_AFTER_LOWER = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_WORD_AFTER_CAPITALS = re.compile(r"(?<=[A-Z])(?=[A-Z][a-z])")


def snake_case(name: str) -> str:
    """FooBarBaz and foo bar baz as foo_bar_baz; runs of capitals are one word, other characters are _."""
    words = _WORD_AFTER_CAPITALS.sub("_", _UPPER_AFTER_LOWER.sub("_", name))
    return re.sub(r"\W", "_", words).lower()


def camel_case(name: str) -> str:
    """foo_bar as FooBar: a single _ before a letter is dropped and the letter raised."""
    out, raise_next = [], True
    plain = re.sub(r"\W", "_", name)
    for k, c in enumerate(plain):
        if c == "_":
            if not raise_next and k + 1 < len(plain):
                raise_next = True
            else:
                out.append(c)
                raise_next = True
        else:
            out.append(c.upper() if raise_next else c)
            raise_next = False
    return "".join(out)


def fields_of(params: Any) -> Mapping[str, Any]:
    """The names and values of a mapping or of a dataclass instance."""
    return params if isinstance(params, Mapping) else {f.name: getattr(params, f.name) for f in dataclasses.fields(params)}


def replace_params(text: str, params: Any = None) -> str:
    """Each ${name} by the value of that name; raises KeyError for unknown names, leaves all without params."""
    if params is None:
        return text
    values = fields_of(params)
    return _PARAM.sub(lambda m: str(values[m[1]]), text)


def trimmed(text: str | None) -> str | None:
    """The text without outer blanks; None for null and blank texts."""
    return (text.strip() or None) if text is not None else None


def sql_literal(text: str) -> str:
    """A SQL string literal; quotes and backslashes are escaped."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_list(values: Sequence[str]) -> str:
    """A parenthesised list of double-quoted literals."""
    return "(" + ",".join('"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"' for v in values) + ")"


def word_characters(text: str, collapse: bool = False) -> str:
    """Every character that is no letter, digit or _ as _; with collapse, a run of those and of _ as one."""
    return re.sub(r"[\W_]+", "_", text) if collapse else re.sub(r"\W", "_", text)


def without_line_comments(text: str, mark: str) -> str:
    """Text without everything from the mark to the end of a line, within literals too."""
    return re.sub(re.escape(mark) + r"[^\n]*", "", text)


def split_statements(text: str) -> list[str]:
    """SQL statements between semicolons; those in literals, quoted names and comments do not split."""
    parts, start, k = [], 0, 0
    while k < len(text):
        c = text[k]
        if c in "'\"`":
            k += 1
            while k < len(text) and text[k] != c:
                k += 2 if text[k] == "\\" and c != "`" else 1
        elif text.startswith("--", k):
            end = text.find("\n", k)
            k = len(text) if end < 0 else end
        elif text.startswith("/*", k):
            end = text.find("*/", k + 2)
            k = len(text) if end < 0 else end + 1
        elif c == ";":
            parts.append(text[start:k])
            start = k + 1
        k += 1
    parts.append(text[start:])
    return [p.strip() for p in parts if without_block_comments(without_line_comments(p, "--")).strip()]


def without_block_comments(text: str) -> str:
    return re.sub(r"/\*.*?(\*/|$)", "", text, flags=re.S)
