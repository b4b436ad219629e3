"""Layered configuration of dataclasses, JSON for them, and made-up instances for tests."""

from __future__ import annotations

import dataclasses
import datetime
import decimal
import enum
import hashlib
import json
import random
import types as pytypes
import typing
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

import yaml

from plumbrook.errors import PlumbrookError
from plumbrook.functions.text import snake_case

ENVIRONMENTS = "--environments="
SEPARATOR = "__"


def _parts(hint: Any) -> tuple[Any, bool]:
    """The hint without None, and whether None was allowed."""
    if typing.get_origin(hint) in (typing.Union, pytypes.UnionType):
        inner = [a for a in typing.get_args(hint) if a is not type(None)]
        return inner[0], True
    return hint, False


def from_plain(hint: Any, value: Any) -> Any:
    """A value of the hinted type from JSON-like data."""
    hint, _ = _parts(hint)
    origin = typing.get_origin(hint)
    if value is None or hint is Any:
        return value
    if dataclasses.is_dataclass(hint) and isinstance(value, Mapping):
        return update(empty(hint), value)
    if origin in (list, tuple, set, frozenset) or origin is Sequence:
        args = [a for a in typing.get_args(hint) if a is not Ellipsis] or [Any]
        items = [value[k] for k in sorted(value, key=lambda k: int(k))] if isinstance(value, Mapping) else list(value)
        made = [from_plain(args[min(k, len(args) - 1)] if origin is tuple else args[0], v) for k, v in enumerate(items)]
        return made if origin in (list, Sequence) else origin(made)
    if origin in (dict, Mapping):
        kind = (typing.get_args(hint) or (str, Any))[1]
        return {k: from_plain(kind, v) for k, v in value.items()}
    if isinstance(hint, type) and issubclass(hint, enum.Enum):
        return hint[value] if value in hint.__members__ else hint(value)
    if hint is bool and isinstance(value, str):
        return value.strip().lower() == "true"
    if hint is datetime.datetime and isinstance(value, str):
        return datetime.datetime.fromisoformat(value)
    if hint is datetime.date and isinstance(value, str):
        return datetime.date.fromisoformat(value)
    if hint is str and not isinstance(value, str):
        return str(value)
    if hint in (int, float, decimal.Decimal):
        return hint(value)
    return value


def to_plain(value: Any) -> Any:
    """JSON-like data; None fields are left out, as are fields with metadata secret."""
    if dataclasses.is_dataclass(value):
        return {f.name: to_plain(v) for f in dataclasses.fields(value) if (v := getattr(value, f.name)) is not None and not f.metadata.get("secret")}
    if isinstance(value, Mapping):
        return {k: to_plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set | frozenset):
        return [to_plain(v) for v in value]
    if isinstance(value, enum.Enum):
        return value.name
    if isinstance(value, datetime.date | datetime.datetime):
        return value.isoformat()
    return str(value) if isinstance(value, decimal.Decimal) else value


def to_json(value: Any) -> str:
    return json.dumps(to_plain(value))


def _merged(old: Any, new: Any) -> Any:
    if isinstance(old, Mapping) and isinstance(new, Mapping):
        return {**old, **{k: _merged(old.get(k), v) for k, v in new.items()}}
    if isinstance(old, list | tuple) and isinstance(new, list):
        return [*old, *new]
    if isinstance(old, list | tuple) and isinstance(new, Mapping) and all(k.isdigit() for k in new):
        return [*old, *(new[k] for k in sorted(new, key=int))]
    return new


def update(value: Any, changes: Mapping[str, Any]) -> Any:
    """The dataclass instance with changes merged in; lists grow, mappings merge, unknown names are ignored."""
    hints = typing.get_type_hints(type(value))
    made = {}
    for f in dataclasses.fields(value):
        if f.name in changes:
            made[f.name] = from_plain(hints[f.name], _merged(to_plain(getattr(value, f.name)) if isinstance(getattr(value, f.name), list | tuple | Mapping) else None, changes[f.name]))
    return dataclasses.replace(value, **made)


def _empty_value(hint: Any) -> Any:
    inner, optional = _parts(hint)
    origin = typing.get_origin(inner)
    if optional:
        return None
    if origin in (list, tuple, set, frozenset, dict):
        return origin()
    if origin is Mapping or origin is Sequence:
        return {} if origin is Mapping else []
    if dataclasses.is_dataclass(inner):
        return empty(inner)
    if isinstance(inner, type) and issubclass(inner, enum.Enum):
        return next(iter(inner))
    return {bool: False, int: 0, float: 0.0}.get(inner)


def empty(entity: type) -> Any:
    """An instance of defaults; fields without one are zero, empty or None."""
    hints = typing.get_type_hints(entity)
    made = {}
    for f in dataclasses.fields(entity):
        if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING:
            made[f.name] = _empty_value(hints[f.name])
    return entity(**made)


def nested(lines: Sequence[str]) -> dict[str, Any]:
    """name__field__0=value lines as nested mappings."""
    out: dict[str, Any] = {}
    for line in lines:
        key, mark, value = line.removeprefix("--").partition("=")
        if not mark:
            continue
        *way, last = key.split(SEPARATOR)
        at = out
        for step in way:
            at = at.setdefault(step, {})
            if not isinstance(at, dict):
                break
        else:
            at[last] = value
    return out


@dataclasses.dataclass(frozen=True)
class Configuration:
    """Layers, each over the ones before: defaults, <name>.yaml, <name>.<env>.yaml, main_config[.<env>].yaml, arguments.

    The environments of --environments=a,b are followed by `local`. Files are looked for in `folders`;
    a class with ALLOW_IN_ROOT = True also in `root`, where the main_config files are.
    """

    environments: tuple[str, ...] = ("local",)
    args: tuple[str, ...] = ()
    folders: tuple[str, ...] = ()
    root: str | None = None

    @classmethod
    def of(cls, args: Sequence[str] = (), folders: Sequence[str] = (), root: str | None = None) -> Configuration:
        given = [a for a in args if a.lower().startswith(ENVIRONMENTS)]
        names = [n for a in given for n in a.lower().removeprefix(ENVIRONMENTS).split(",") if n]
        return cls((*names, "local"), tuple(a for a in args if a not in given), tuple(folders), root)

    def read(self, entity: type) -> Any:
        name = snake_case(entity.__name__)
        value = empty(entity)
        files = [f"{name}.yaml", *(f"{name}.{e}.yaml" for e in self.environments)]
        for folder in (*self.folders, *([self.root] if self.root and getattr(entity, "ALLOW_IN_ROOT", False) else [])):
            for file in files:
                value = self._layer(value, Path(folder) / file, None)
        if self.root:
            for file in ["main_config.yaml", *(f"main_config.{e}.yaml" for e in self.environments)]:
                value = self._layer(value, Path(self.root) / file, name)
        return update(value, nested(self.args).get(name, {}))

    @staticmethod
    def _layer(value: Any, path: Path, key: str | None) -> Any:
        if not path.is_file():
            return value
        data = yaml.safe_load(path.read_text()) or {}
        return update(value, (data.get(key) or {}) if key else data)


class Strategy(enum.Enum):
    CONSTANT = "constant"
    DEFAULT = "default"
    EMPTY = "empty"
    HASHED = "hashed"
    HASHED_CONSTANT = "hashed_constant"
    INDEXED = "indexed"
    INDEXED_CONSTANT = "indexed_constant"
    PROTO = "proto"
    RANDOM = "random"


def clamp(value: int, low: int, high: int) -> int:
    """The value brought into [low, high] by whole turns."""
    return low + (value - low) % (high - low + 1)


class Arbitrary:
    """Makes instances of dataclasses whose fields follow a strategy; hashed values depend on the field's name only."""

    def __init__(self, strategy: Strategy, seed: int = 0):
        self.strategy, self.seed, self.made = strategy, seed, 0
        self._random = random.Random(seed)

    def make(self, entity: type) -> Any:
        self._at = 0
        out = self._entity(entity, "")
        self.made += 1
        return out

    def _entity(self, entity: type, path: str) -> Any:
        hints = typing.get_type_hints(entity)
        return entity(**{f.name: self._value(hints[f.name], f"{path}/{f.name}") for f in dataclasses.fields(entity)})

    def _number(self, path: str) -> int:
        s = self.strategy
        at, self._at = self._at, self._at + 1
        if s is Strategy.CONSTANT:
            return self.seed
        if s is Strategy.INDEXED:
            return self.seed + at + 1000 * self.made
        if s is Strategy.INDEXED_CONSTANT:
            return self.seed + self.made
        if s in (Strategy.HASHED, Strategy.HASHED_CONSTANT):
            key = f"{self.seed + (self.made if s is Strategy.HASHED else 0)}{path}"
            return int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "big", signed=True)
        return self._random.getrandbits(63) if s is Strategy.RANDOM else 0

    def _value(self, hint: Any, path: str) -> Any:
        inner, optional = _parts(hint)
        origin = typing.get_origin(inner)
        s = self.strategy
        if origin in (list, tuple, set, frozenset, dict):
            return None if s is Strategy.DEFAULT else origin()
        if optional:
            return None
        if dataclasses.is_dataclass(inner):
            return self._entity(inner, path)
        if isinstance(inner, type) and issubclass(inner, enum.Enum):
            members = list(inner)
            return None if s is Strategy.DEFAULT else members[self._number(path) % len(members)]
        n = self._number(path)
        plain = s in (Strategy.DEFAULT, Strategy.EMPTY, Strategy.PROTO)
        if inner is bool:
            return n % 2 != 0
        if inner is int:
            return n
        if inner is float:
            return float(n)
        if inner is str:
            return ("" if s is Strategy.PROTO else None) if plain else str(n)
        epoch = datetime.datetime(1970, 1, 1)
        if inner is datetime.date:
            return None if plain else (epoch + datetime.timedelta(days=clamp(n, 0, 2_900_000))).date()
        if inner is datetime.datetime:
            return None if plain else epoch + datetime.timedelta(seconds=clamp(n, 0, 250_000_000_000))
        if inner is decimal.Decimal:
            return None if plain else decimal.Decimal(n)
        raise PlumbrookError(f"no strategy for values of {inner}")
