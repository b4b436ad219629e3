"""Most frequent items of columns with very many distinct values, in bounded memory.

Method: external sort and run-length counting. Each task cuts its rows into sorted runs of distinct
values with counts; the runs are range-partitioned by (column, value), so that all counts of a value
meet in one range; there a single pass over the sorted rows adds equal neighbours and keeps a heap of
fixed size. Counts are exact, memory is one run, one batch and one heap per task.

Defined results: null values and values of nothing but spaces are neither listed nor part of a total;
values are compared exactly as stored; ties are ordered by value; an empty table gives no rows;
columns that are not named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbrook.operators import runs
from plumbrook.sources.folder import written

_LONG = "column_name string, item string, item_count bigint"
_KEYS = ["column_name", "item"]


def _filled(table: pa.Table) -> pa.Table:
    item = table["item"]
    return table.filter(pc.fill_null(pc.not_equal(pc.utf8_trim(item, characters=" "), ""), False))


def value_runs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sorted runs (column_name, item, item_count) of the named string columns; every row counts 1."""

    def make(block: pa.Table):
        for name in columns:
            counted = block.select([name]).group_by(name, use_threads=False).aggregate([([], "count_all")])
            n = counted.num_rows
            long = pa.table({"column_name": pa.repeat(name, n), "item": counted[name], "item_count": counted["count_all"]})
            yield _filled(long).sort_by("item")

    picked = df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in columns))
    return picked.mapInArrow(runs.per_block(make), _LONG)


def count_runs(df: DataFrame) -> DataFrame:
    """Sorted runs of a table that already has column_name, item and item_count; a null count is 0."""

    def make(block: pa.Table):
        combined = runs.combine(_filled(block), _KEYS, "item_count")
        yield combined.sort_by([(k, "ascending") for k in _KEYS])

    picked = df.select("column_name", "item", F.coalesce(F.col("item_count").cast("bigint"), F.lit(0)).alias("item_count"))
    return picked.where("column_name IS NOT NULL").mapInArrow(runs.per_block(make), _LONG)


def range_heaps(run_rows: DataFrame, size: int, min_share: float = 0.0) -> DataFrame:
    """Merge runs per range and keep each range's `size` largest counts of every column.

    A row with a null item carries the column's total in that range. Values below min_share of their
    own range's total can't reach min_share of the whole and are left out.
    """

    def heap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, pa.Table] = {}
        total: dict[str, int] = {}
        order = [("item_count", "descending"), ("item", "ascending")]
        for merged in runs.merge_sorted(batches, _KEYS, "item_count"):
            starts = runs.starts_of(merged, ["column_name"])
            for k, start in enumerate(starts):
                end = starts[k + 1] if k + 1 < len(starts) else merged.num_rows
                part = merged.slice(start, end - start)
                name = part["column_name"][0].as_py()
                total[name] = total.get(name, 0) + pc.sum(part["item_count"]).as_py()
                if name in best:
                    full = best[name].num_rows >= size
                    if full:  # only what beats the smallest count that is kept; later values lose ties
                        part = part.filter(pc.greater(part["item_count"], best[name]["item_count"][-1]))
                        if not part.num_rows:
                            continue
                    part = pa.concat_tables([best[name], part])
                best[name] = part.sort_by(order).slice(0, size).combine_chunks()
        for name, table in best.items():
            keep = table.filter(pc.greater_equal(table["item_count"], min_share * total[name]))
            yield from keep.to_batches()
            yield pa.RecordBatch.from_pydict({"column_name": [name], "item": [None], "item_count": [total[name]]}, schema=table.schema)

    ranged = run_rows.repartitionByRange(*_KEYS).sortWithinPartitions(*_KEYS)
    return ranged.mapInArrow(heap, _LONG)


def _totals(heaps: DataFrame) -> DataFrame:
    """column_name, column_total: one row per column."""
    return heaps.where("item IS NULL").groupBy("column_name").agg(F.sum("item_count").alias("column_total"))


def items_above(run_rows: DataFrame, share: float) -> DataFrame:
    """Every value with at least `share` of its column's total: column_name, item, item_count, column_total.

    The heaps of all ranges, at most 1 / share values of a column each, are written and read twice.
    """
    heaps = written(range_heaps(run_rows, int(1 / share) + 1, share), "heaps")
    found = heaps.where("item IS NOT NULL").join(_totals(heaps), "column_name")
    return found.where(F.col("item_count") >= F.lit(share) * F.col("column_total")).select("column_name", "item", "item_count", "column_total")


#: Parts of the ranges whose best are chosen before the best of all are.
_PARTS = 64


def top_items(run_rows: DataFrame, k: int) -> DataFrame:
    """The k most frequent values of each column: column_name, rank_no, item, item_count, column_total.

    The best of each range compete within their part of the ranges first, so that at most _PARTS * k rows of a column
    meet in one task.
    """
    heaps = written(range_heaps(run_rows, k).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(_PARTS))), "heaps")
    ranked = heaps.where("item IS NOT NULL")
    for keys in (["column_name", "part"], ["column_name"]):
        best = Window.partitionBy(*keys).orderBy(F.desc("item_count"), "item")
        ranked = ranked.withColumn("rank_no", F.row_number().over(best)).where(F.col("rank_no") <= k)
    return ranked.join(_totals(heaps), "column_name").select("column_name", "rank_no", "item", "item_count", "column_total")


def once_per_partition(dp_item: DataFrame) -> DataFrame:
    """dp_item rows equal in load_id, partition_no, column_name and item, once each."""
    return dp_item.groupBy("load_id", "partition_no", "column_name", "item").agg(F.max("item_count").alias("item_count"))
