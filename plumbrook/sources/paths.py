"""Input paths with options, and the tables and DAG outputs they stand for.

`dir/table?sos-format=csv&header=true`: options with the prefix are this library's, others the reader's.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import quote_plus, unquote_plus

from plumbrook.errors import PlumbrookError
from plumbrook.functions.text import snake_case, word_characters
from plumbrook.sources.files import Files

PREFIX = "sos-"
DAG_DIR = ".dag"
LOGICAL_SEPARATOR = "__"
_LIST = re.compile(r".*\.list", re.I | re.S)


@dataclass(frozen=True)
class TableName:
    """An entity, a logical name, or both: entity__logical."""

    entity: str | None = None
    logical: str | None = None

    def full(self) -> str:
        if not self.entity and not self.logical:
            raise PlumbrookError("a table name needs an entity or a logical name")
        raw = (self.entity or "") + (f"{LOGICAL_SEPARATOR}{self.logical}" if self.logical else "")
        parts = [word_characters(p, collapse=True) for p in raw.split(LOGICAL_SEPARATOR)]
        return snake_case(LOGICAL_SEPARATOR.join(parts))

    @classmethod
    def of(cls, entity: type, logical: str | None = None) -> TableName:
        return cls(snake_case(entity.__name__), logical)

    @classmethod
    def parse(cls, text: str) -> TableName:
        entity, _, logical = text.partition(LOGICAL_SEPARATOR)
        return cls(entity.strip() or None, logical.strip() or None)


@dataclass(frozen=True)
class TableNames:
    """Entities by table name."""

    entities: tuple[type, ...]

    def find(self, text: str) -> tuple[type, TableName] | None:
        """The entity of entity or entity__logical, with the table name; None if it is unknown."""
        name = TableName.parse(text)
        for e in self.entities:
            if snake_case(e.__name__) == name.entity:
                return e, name
        return None


@dataclass(frozen=True)
class ParsedPath:
    path: str
    own: dict[str, str | None] = field(default_factory=dict)
    reader: dict[str, str | None] = field(default_factory=dict)


@dataclass(frozen=True)
class TableInfo:
    path: str
    table_name: str | None
    format: str | None = None
    reshape: tuple[tuple[str, str], ...] = ()
    options: tuple[tuple[str, str | None], ...] = ()

    def url(self, prefix: str = PREFIX) -> str:
        own = [(f"{prefix}{k}", v) for k, v in (("table_name", self.table_name), ("format", self.format), *((f"reshape_config__{k}", v) for k, v in self.reshape)) if v is not None]
        every = sorted([*own, *self.options], key=lambda kv: (kv[0], kv[1] or ""))
        shown = "&".join(quote_plus(k) if v is None else f"{quote_plus(k)}={quote_plus(v)}" for k, v in every)
        return f"{self.path}?{shown}" if shown else self.path


@dataclass(frozen=True)
class DagInfo:
    path: str

    def url(self, prefix: str = PREFIX) -> str:
        return f"{self.path}?{prefix}listing_strategy=dag"


def parse_path(url: str, prefix: str = PREFIX) -> ParsedPath:
    """`k=` is an empty value, a bare `k` none; the last of equal keys counts."""
    path, _, query = url.partition("?")
    own: dict[str, str | None] = {}
    reader: dict[str, str | None] = {}
    for part in query.split("&") if query else []:
        key, mark, value = part.partition("=")
        key, given = unquote_plus(key), unquote_plus(value) if mark else None
        if key.lower().startswith(prefix):
            own[key.lower().removeprefix(prefix)] = given
        else:
            reader[key] = given
    return ParsedPath(path, own, reader)


class PathResolver:
    """The tables and DAGs behind a path; DAGs that refer to each other are followed once."""

    def __init__(self, files: Files, prefix: str = PREFIX):
        self.files, self.prefix = files, prefix

    def resolve(self, url: str) -> list[TableInfo | DagInfo]:
        found = self._resolve(url, set())
        return list(dict.fromkeys(found))

    def _resolve(self, url: str, seen: set[str]) -> list[TableInfo | DagInfo]:
        p = parse_path(url, self.prefix)
        name, strategy = p.own.get("table_name"), p.own.get("listing_strategy")
        strategy = strategy.lower() if strategy else None
        last = p.path.rstrip("/").rpartition("/")[2]
        both = f"{self.prefix}table_name and {self.prefix}listing_strategy"
        if name and strategy:
            raise PlumbrookError(f"{both} at the same time are not supported ({url})")
        if _LIST.fullmatch(last):
            if name or strategy:
                raise PlumbrookError(f"{both} are not supported on *.list files ({url})")
            lines = self.files.read_text(p.path).splitlines()
            return [i for line in lines if line and not line.startswith("#") for i in self._resolve(line, seen)]
        reshape = tuple(sorted((k.removeprefix("reshape_config__"), v or "") for k, v in p.own.items() if k.startswith("reshape_config__")))
        info = lambda path, table: TableInfo(path, table, p.own.get("format"), reshape, tuple(sorted(p.reader.items(), key=lambda kv: kv[0])))
        if strategy == "tables":
            return [info(s.path, s.name) for s in self.files.children(p.path) if s.is_directory and not s.name.startswith(".")]
        if strategy and strategy.startswith("dag"):
            return self._dag(p.path, strategy, seen)
        if strategy:
            raise PlumbrookError(f"Unsupported listing strategy '{strategy}'")
        if last == DAG_DIR:
            return self._dag(p.path.rstrip("/").rpartition("/")[0], "dag", seen)
        if name:
            return [info(p.path, name)]
        if last.startswith("."):
            raise PlumbrookError(f"Unsupported path starting with dot '{last}'")
        return [info(p.path, word_characters(last))]

    def _dag(self, path: str, strategy: str, seen: set[str]) -> list[TableInfo | DagInfo]:
        if strategy not in ("dag", "dag_io", "dag_io_recursive"):
            raise PlumbrookError(f"Unsupported dag listing strategy '{strategy}'")
        if path in seen and strategy == "dag_io_recursive":
            return []
        seen.add(path)
        of = lambda kind: self._resolve(f"{path}/{DAG_DIR}/{kind}.list", seen)
        found: list[TableInfo | DagInfo] = [DagInfo(path), *of("output_tables")]
        if strategy != "dag":
            found += of("input_tables")
        if strategy == "dag_io_recursive":
            listed = self.files.read_text(f"{path}/{DAG_DIR}/input_dags.list").splitlines()
            for line in listed:
                if line and not line.startswith("#"):
                    upstream = parse_path(line, self.prefix).path
                    found += self._dag(upstream, strategy, seen)
        return found
