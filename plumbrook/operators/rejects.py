"""Delimited records that fail to parse, apart from those that load.

Method: records are assembled quote-aware, each is read by Python's strict csv reader inside mapInArrow;
what the reader raises is caught as the structural reason, and only a record of sound structure reaches
the typed field constructors of its file's layout. Lines are shuffled once, by file and block of
consecutive lines, and sorted; a block's first row is the layout of its file.

Reasons, the first that applies: `record_quoting` (a quote never closed, text after a closing quote,
or a quote inside an unquoted field; also a line break outside quotes), `record_column_count`,
`field_value`. `file_options` marks records whose delimiter or quote is not a single character.

Where the rows are physical lines, `assemble` makes records of them: a line with an odd number of quotes
opens a record, the next such line closes it. If it is further away than MOST_LINES, the first line is a
record of its own, which the reader rejects, and the next line begins afresh; so one broken quote spoils
no more than its neighbourhood and no record is unbounded.

Defined results: null and empty lines and declared headers are no records; a line stored twice is one
record where `once` is set; files without options are read with the defaults, files without declared
fields have none, so that every record has the wrong count; unknown extra columns are ignored; rows
without line number are in block 0. A file with a third of all records is spread by its blocks.
"""

from __future__ import annotations

import csv
import json
import re
import sys
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbrook.functions import declared_types as types

#: Consecutive lines of a file that are read together, and the most lines of an assembled record.
BLOCK_LINES, MOST_LINES = 1 << 12, 1000
PARSED = "file_id bigint, line_no int, rule_name string, reason string, row_values array<string>, canonical_values array<string>"
_PARSED = pa.schema([("file_id", pa.int64()), ("line_no", pa.int32()), ("rule_name", pa.string()), ("reason", pa.string()), ("row_values", pa.list_(pa.string())), ("canonical_values", pa.list_(pa.string()))])


def reader_option(input_path: Column, name: str) -> Column:
    """The last value of an URL-encoded option in a path with options; null if it is not given."""
    given = F.split(F.regexp_extract(input_path, r"\?(.*)$", 1), "&")
    own = F.filter(given, lambda x: F.substring_index(x, "=", 1) == F.lit(name))
    return F.try_url_decode(F.regexp_extract(F.try_element_at(own, F.lit(-1)), "^[^=]*=(.*)$", 1))


def layouts(file_input: DataFrame, dq_field: DataFrame) -> DataFrame:
    """One row per file: file_id and `layout`, a JSON text of its options and declared fields."""
    path = F.try_element_at(F.col("metadata"), F.lit("input_path"))
    files = file_input.where("file_id IS NOT NULL").dropDuplicates(["file_id"]).select(
        "file_id",
        F.coalesce(reader_option(path, "delimiter"), F.lit(",")).alias("delimiter"),
        F.coalesce(reader_option(path, "quote"), F.lit('"')).alias("quote"),
        (F.lower(F.coalesce(reader_option(path, "header"), F.lit("false"))) == "true").alias("header"),
    )
    field = F.struct("ordinal_no", "field_name", "data_type_json", "nullable", "enum_values", "format_pattern", "regexp_pattern")
    fields = dq_field.where("file_id IS NOT NULL").groupBy("file_id").agg(F.array_sort(F.collect_set(field)).alias("fields"))
    both = files.join(fields, "file_id", "full")
    layout = F.to_json(F.struct(F.coalesce("delimiter", F.lit(",")).alias("delimiter"), F.coalesce("quote", F.lit('"')).alias("quote"), F.coalesce("header", F.lit(False)).alias("header"), "fields"))
    return both.select("file_id", layout.alias("layout"))


def declared_fields(layout: dict) -> list[dict]:
    """The fields of a layout in order, one per ordinal."""
    seen: dict[int, dict] = {}
    for field in layout.get("fields") or []:
        seen.setdefault(field.get("ordinal_no", -1), field)
    return [seen[k] for k in sorted(seen)]


class _Line:
    """An iterator of one line that can be filled again: a csv reader over it serves all records of a layout."""

    def __init__(self) -> None:
        self.text: str | None = None

    def __iter__(self) -> _Line:
        return self

    def __next__(self) -> str:
        text, self.text = self.text, None
        if text is None:
            raise StopIteration
        return text


def _blank(value: str) -> bool:
    return not value or value.isspace()


@lru_cache(maxsize=65536)
def _constructor(data_type_json: str | None, format_pattern: str | None) -> tuple[Callable[[str], object] | None, Callable[[str], str]]:
    """The check of a declared type, None if every text fits, and its canonical form."""
    kind = types.canonical_type(data_type_json)
    return types.value_check(kind, format_pattern), types.canonical_value(kind, format_pattern)


class Layout:
    """A compiled layout: structure by the csv reader, then one constructor per field."""

    def __init__(self, text: str | None):
        csv.field_size_limit(sys.maxsize)
        layout = json.loads(text) if text else {}
        self.delimiter, self.quote, self.header = layout.get("delimiter", ","), layout.get("quote", '"'), layout.get("header", False)
        self.picks = layout.get("picks") or {}
        self.fields = declared_fields(layout)
        self.checks = [self._check(f) for f in self.fields]
        self.canonical = [_constructor(f.get("data_type_json"), f.get("format_pattern"))[1] for f in self.fields]
        self.usable = len(self.delimiter) == 1 and len(self.quote) <= 1 and self.delimiter not in (self.quote, "\n", "\r")
        dialect = {"delimiter": self.delimiter, "strict": True} | ({"quotechar": self.quote} if self.quote else {"quoting": csv.QUOTE_NONE})
        self.line = _Line()
        self.reader = csv.reader(self.line, **dialect) if self.usable else None

    @staticmethod
    def _check(field: dict) -> tuple[Callable[[str], object] | None, bool]:
        """What a present value has to pass, if anything, and whether it may be absent."""
        tests = [_constructor(field.get("data_type_json"), field.get("format_pattern"))[0]]
        if field.get("enum_values") is not None:
            tests.append(frozenset(field["enum_values"]).__contains__)
        if field.get("regexp_pattern") is not None:
            try:
                tests.append(re.compile(field["regexp_pattern"]).fullmatch)
            except re.error:
                tests.append(lambda text: False)
        tests = [t for t in tests if t is not None]
        every = tests[0] if len(tests) == 1 else (lambda text: all(t(text) for t in tests)) if tests else None
        return every, field.get("nullable") is not False

    def quoted(self, line: str, count: int) -> list[bool]:
        """Which fields are quoted; raises if an unquoted one holds a quote. The csv reader accepts the line."""
        if not self.quote or self.quote not in line:
            return [False] * count
        flags, at, q = [], 0, self.quote
        while True:
            if line.startswith(q, at):
                end = line.find(q, at + 1)
                while line.startswith(q, end + 1):
                    end = line.find(q, end + 2)
                flags.append(True)
                at = end + 1
                if at >= len(line):
                    return flags
                at += 1
            else:
                end = line.find(self.delimiter, at)
                if q in line[at : end if end >= 0 else len(line)]:
                    raise csv.Error("an unquoted field contains a quote")
                flags.append(False)
                if end < 0:
                    return flags
                at = end + 1

    def values(self, line: str) -> tuple[str | None, str | None, list[str | None]]:
        """(rule_name, reason, values) of a record; values are null for unquoted blanks that were reached."""
        if self.reader is None:
            return "file_options", "delimiter and quote must be single characters", [line]
        self.line.text = line
        try:
            values: list[str | None] = next(self.reader, [])
            flags = self.quoted(line, len(values)) if self.quote and self.quote in line else None
        except csv.Error as e:
            return "record_quoting", str(e), [line]
        if len(values) != len(self.fields):
            return "record_column_count", f"{len(values)} fields, {len(self.fields)} declared", values
        k = 0
        for value, (fits, nullable) in zip(values, self.checks, strict=True):
            if _blank(value) and not (flags and flags[k]):
                values[k] = None
                if not nullable:
                    return "field_value", f"{self.fields[k].get('field_name')} is not nullable", values
            elif fits is not None and not fits(value):
                return "field_value", f"{self.fields[k].get('field_name')} does not fit {self.fields[k].get('data_type_json')}", values
            k += 1
        return None, None, values

    def read(self, line: str) -> tuple[str | None, str | None, list[str | None], list[str | None]]:
        """(rule_name, reason, values, canonical values); rule_name is null for a record that loads."""
        rule, reason, values = self.values(line)
        return rule, reason, values, [None if v is None else c(v) for c, v in zip(self.canonical, values, strict=True)] if rule is None else []


# Lines beside their layouts


def block(line_no: Column) -> Column:
    """The number of the block of lines; 0 for rows without line number."""
    return F.shiftright(F.greatest(F.coalesce(line_no, F.lit(0)), F.lit(0)).cast("bigint"), BLOCK_LINES.bit_length() - 1)


def _in_order() -> list[Column]:
    return [F.col("file_id"), F.col("block"), F.col("layout").isNull(), F.col("line_no"), F.col("line")]


def _lines(raw_line: DataFrame, empty: bool) -> DataFrame:
    lines = raw_line.select(F.col("file_id").cast("bigint").alias("file_id"), block(F.col("line_no")).alias("block"), F.col("line_no").cast("bigint").alias("line_no"), F.col("line").cast("string").alias("line"))
    return lines.where("line IS NOT NULL" if empty else "line IS NOT NULL AND line <> ''")


def _under(heads: DataFrame, lines: DataFrame) -> DataFrame:
    """file_id, block, line_no, line, layout: every block of lines in order behind its head."""
    both = lines.withColumn("layout", F.lit(None).cast("string")).unionByName(heads, allowMissingColumns=True)
    return both.repartition("file_id", "block").sortWithinPartitions(*_in_order())


def in_blocks(raw_line: DataFrame, layout: DataFrame, empty: bool = False) -> DataFrame:
    """Every block of lines behind one row with its file's layout; blocks of files without layout have none.

    Layouts are joined to the blocks that have lines, not to lines. `empty` keeps empty lines.
    """
    lines = _lines(raw_line, empty)
    return _under(lines.select("file_id", "block").distinct().join(layout.select("file_id", "layout"), "file_id"), lines)


def _records(batches: Iterator[pa.RecordBatch], once: bool) -> Iterator[tuple[int, int, str, Layout]]:
    """The records of sorted blocks with their layouts; headers are none."""
    plain = Layout(None)
    key, own, last = None, plain, None
    for batch in batches:
        for file_id, block, line_no, line, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file_id, block) != key:
                key, own, last = (file_id, block), plain, None
            if text is not None:
                own = Layout(text)
            elif own.header and line_no == 0:
                continue
            elif not once or (line_no, line) != last:
                last = (line_no, line)
                yield file_id, line_no, line, own


def parse(raw_line: DataFrame, layout: DataFrame, once: bool = False, keep: str | None = None) -> DataFrame:
    """Every record with its verdict: PARSED. `once` drops equal lines of a file stored again.

    keep: "rejected" or "loaded" if only those records are wanted; the others are read all the same.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for file_id, line_no, line, own in _records(batches, once):
            rule, reason, values = own.values(line)
            if keep is not None and (rule is None) != (keep == "loaded"):
                continue
            rows.append((file_id, line_no, rule, reason, values, [None if v is None else c(v) for c, v in zip(own.canonical, values, strict=True)] if rule is None else []))
            if len(rows) >= 5000:
                yield _batch(rows, _PARSED)
                rows = []
        if rows:
            yield _batch(rows, _PARSED)

    return in_blocks(raw_line, layout).mapInArrow(scan, PARSED)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def rejected(parsed: DataFrame) -> DataFrame:
    """The failing records: file_id, line_no, rule_name, reason, row_values, once each."""
    return parsed.where("rule_name IS NOT NULL").select("file_id", "line_no", "rule_name", "reason", "row_values").distinct()


def loaded(parsed: DataFrame) -> DataFrame:
    """The valid records: file_id, line_no, row_values (null for unquoted blanks), canonical_values."""
    return parsed.where("rule_name IS NULL").select("file_id", "line_no", "row_values", "canonical_values")


_SIDES = "file_id bigint, newer boolean, key string, line_no int, v array<struct<value:string,text:string>>"
_SIDES_SCHEMA = pa.schema([("file_id", pa.int64()), ("newer", pa.bool_()), ("key", pa.string()), ("line_no", pa.int32()), ("v", pa.list_(pa.struct([("value", pa.string()), ("text", pa.string())])))])


def picked(raw_line: DataFrame, layout: DataFrame) -> DataFrame:
    """Of the valid records, the key and the values that the layouts ask for, and nothing else.

    A layout's `picks` is an array of {file_id, newer, places}: a record gives one row for each, with the named
    places of its values, canonical and as text without outer blanks. The key is the first value; records without
    one give no row.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for _, line_no, line, own in _records(batches, True):
            if not own.picks:
                continue
            rule, _, values = own.values(line)
            if rule is not None or not values or values[0] is None:
                continue
            key = own.canonical[0](values[0]).strip(" ")
            for p in own.picks:
                held = [None if (v := values[k] if k < len(values) else None) is None else (own.canonical[k](v), v.strip(" ")) for k in p["places"]]
                rows.append((p["file_id"], p["newer"], key, line_no, [{"value": h and h[0], "text": h and h[1]} for h in held]))
            if len(rows) >= 5000:
                yield _batch(rows, _SIDES_SCHEMA)
                rows = []
        if rows:
            yield _batch(rows, _SIDES_SCHEMA)

    return in_blocks(raw_line, layout).mapInArrow(scan, _SIDES)


# Records of physical lines


_ODD = "file_id bigint, block bigint, first_odd bigint, last_odd bigint, odd_count bigint, quote string"
_HEAD = "file_id bigint, block bigint, layout string"


def assemble(lines: DataFrame, layout: DataFrame, most_lines: int = MOST_LINES) -> DataFrame:
    """file_id, line_no (that of its first line), line (joined by line breaks) of the records that physical lines hold.

    lines: file_id, line_no, line, each line number of a file once; most_lines bounds the distance of the numbers
    of a record's lines and is at most BLOCK_LINES, so that no record reaches beyond the next block. Every block
    tells its lines of odd quotes in one row; one pass over these rows says which record is open at the borders.
    Records within a block are complete, the few lines at the borders are brought together by another shuffle. Lines
    without a number have no neighbours: each is a record; null lines are none.
    """
    if not 0 < most_lines <= BLOCK_LINES:
        raise ValueError(f"most_lines must be between 1 and {BLOCK_LINES}")
    loose = lines.where("line_no IS NULL AND line IS NOT NULL").select(F.col("file_id").cast("bigint").alias("file_id"), F.lit(None).cast("bigint").alias("line_no"), F.col("line").cast("string").alias("line"))
    lines = lines.where("line_no IS NOT NULL")
    told = in_blocks(lines, layout, empty=True).mapInArrow(_odd_lines(most_lines), _ODD)
    heads = told.repartition("file_id").sortWithinPartitions("file_id", "block").mapInPandas(_borders(most_lines), _HEAD)  # a row per block
    parts = _under(heads, _lines(lines, empty=True)).mapInArrow(_joined(most_lines), "file_id bigint, line_no bigint, at bigint, line string, whole boolean")
    whole = parts.where("whole").select("file_id", "line_no", "line")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")  # at most most_lines
    return whole.unionByName(loose).unionByName(parts.where("NOT whole").groupBy("file_id", "line_no").agg(text.alias("line")).select("file_id", "line_no", "line"))


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, dict, list[tuple[int, str]]]]:
    """file_id, block, head and lines of every block."""
    key, head, lines = None, {}, []
    for batch in batches:
        for file_id, block, line_no, line, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file_id, block) != key:
                if key is not None:
                    yield *key, head, lines
                key, head, lines = (file_id, block), {}, []
            if text is not None:
                head = json.loads(text)
            else:
                lines.append((line_no, line))
    if key is not None:
        yield *key, head, lines


def _odd_numbers(lines: list[tuple[int, str]], quote: str) -> list[int]:
    return [at for at, line in lines if quote and line.count(quote) % 2]


def _odd_lines(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per block: first and last odd line, and how many follow each other nearer than `most` up to the last.

    The number is negative if such a row of lines begins within the block: then what was open before does not matter.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file_id", pa.int64()), ("block", pa.int64()), ("first_odd", pa.int64()), ("last_odd", pa.int64()), ("odd_count", pa.int64()), ("quote", pa.string())])
        for file_id, block, head, lines in _blocks_of(batches):
            quote = head.get("quote", '"')
            odd = _odd_numbers(lines, quote)
            far = [k for k in range(1, len(odd)) if odd[k] - odd[k - 1] >= most]
            count = far[-1] - len(odd) if far else len(odd)
            yield _batch([(file_id, block, odd[0] if odd else None, odd[-1] if odd else None, count, quote)], schema)

    return scan


def _borders(most: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The head of every block: its quote, the record open at its start, and where the one open at its end closes."""

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None  # the block before, whose end waits for this one
        open_from: int | None = None
        for frame in frames:
            rows = []
            for file_id, block, first, last, count, quote in frame.astype(object).where(frame.notna(), None).itertuples(index=False):
                if held is not None and held[0] != file_id:
                    rows.append((*held[:2], json.dumps(held[2])))
                    held, open_from = None, None
                meets = open_from is not None and first is not None and first - open_from < most
                if held is not None:
                    rows.append((*held[:2], json.dumps(held[2] | {"closes_at": int(first) if meets else None})))
                held = (file_id, block, {"quote": quote, "open_from": int(open_from) if meets else None})
                if first is not None:
                    left = -count if count < 0 else count - meets
                    open_from = last if left % 2 else None
            yield pd.DataFrame(rows, columns=["file_id", "block", "layout"])
        if held is not None:
            yield pd.DataFrame([(*held[:2], json.dumps(held[2]))], columns=["file_id", "block", "layout"])

    return walk


def _joined(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whole records of each block, and the lines of those that cross its borders."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file_id", pa.int64()), ("line_no", pa.int64()), ("at", pa.int64()), ("line", pa.string()), ("whole", pa.bool_())])
        for file_id, _, head, lines in _blocks_of(batches):
            odd = _odd_numbers(lines, head.get("quote", '"'))
            before, after = head.get("open_from"), head.get("closes_at")
            ends: dict[int, int] = {}
            opened = None
            for at in odd[1:] if before is not None else odd:
                if opened is not None and at - opened < most:
                    ends[opened] = at
                    opened = None
                else:
                    opened = at
            rows, start, end, held = [], None, None, []
            for at, line in lines:
                if before is not None and at <= odd[0]:
                    rows.append((file_id, before, at, line, False))
                elif after is not None and at >= opened:
                    rows.append((file_id, opened, at, line, False))
                elif end is not None:
                    held.append(line)
                    if at == end:
                        rows.append((file_id, start, start, "\n".join(held), True))
                        end, held = None, []
                elif at in ends:
                    start, end, held = at, ends[at], [line]
                else:
                    rows.append((file_id, at, at, line, True))
            if rows:
                yield _batch(rows, schema)

    return scan
