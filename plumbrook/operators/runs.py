"""External sort with run-length counting over Arrow batches.

A run is a sorted list of distinct keys with counts, built from a bounded number of rows. Runs are
made where the rows are read, so that a value held by a third of all rows leaves a task once per run
and not once per row; after a range shuffle and a sort, equal keys are neighbours and one pass adds
their counts, holding one batch and one open key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A run is closed when it has this many rows or bytes, whichever comes first.
RUN_ROWS = 1 << 19
RUN_BYTES = 48 << 20


def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Gather batches into tables of at most RUN_ROWS rows or RUN_BYTES bytes (one batch at least)."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        size += batch.nbytes
        if rows >= RUN_ROWS or size >= RUN_BYTES:
            yield pa.Table.from_batches(held)
            held, rows, size = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held)


def combine(table: pa.Table, keys: list[str], weight: str) -> pa.Table:
    """One row per distinct key of the table with its weights added; nulls are a key of their own."""
    out = table.group_by(keys, use_threads=False).aggregate([(weight, "sum")])
    return out.select([*keys, f"{weight}_sum"]).rename_columns([*keys, weight])


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """True where a row's value differs from the one above it; null equals null."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a, b = flat.slice(1), flat.slice(0, len(flat) - 1)
    differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    if flat.null_count:
        differ |= pc.xor(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    return differ


def starts_of(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Positions at which a new key begins; the table is ordered by the keys and not empty."""
    new = np.zeros(table.num_rows - 1, dtype=bool)
    for key in keys:
        new |= _changes(table[key])
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def merge_sorted(batches: Iterable[pa.RecordBatch], keys: list[str], weight: str) -> Iterator[pa.Table]:
    """Add the weights of equal neighbouring keys of a sorted stream.

    Every key comes out once, in order; the last key of a batch is held back until the next begins.
    """
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch]).select([*keys, weight])
        if not table.num_rows:
            continue
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        starts = starts_of(table, keys)
        sums = np.add.reduceat(table[weight].to_numpy(), starts)
        merged = table.take(pa.array(starts)).set_column(len(keys), weight, pa.array(sums, table.schema.field(weight).type))
        held = merged.slice(merged.num_rows - 1).combine_chunks()
        if merged.num_rows > 1:
            yield merged.slice(0, merged.num_rows - 1)
    if held is not None:
        yield held


def per_block(make: Callable[[pa.Table], Iterable[pa.Table]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that applies make to bounded blocks of its input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            for table in make(block):
                yield from table.to_batches(max_chunksize=20_000)

    return run
