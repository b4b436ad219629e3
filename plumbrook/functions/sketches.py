"""Aggregates of bounded size: frequent items, and histograms from quantile sketches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frequent_items(column: Column, k: int) -> Column:
    """Aggregate: up to k items with counts, largest first, ties by item; twice as many are tracked.

    Nulls are no items. Counts are exact while all distinct values are tracked.
    """
    tracked = 1 << max(4, (max(1, 2 * k) - 1).bit_length() + 1)
    none = "\x00null"
    found = F.call_function("approx_top_k", F.coalesce(column.cast("string"), F.lit(none)), F.lit(2 * k + 1), F.lit(tracked))
    ordered = F.array_sort(F.transform(F.filter(found, lambda i: i["item"] != none), lambda i: F.struct((-i["count"]).alias("c"), i["item"].alias("i"))))
    return F.slice(F.transform(ordered, lambda o: F.struct(o["i"].alias("item"), (-o["c"]).alias("count"))), 1, k)


def quantile_histogram(column: Column, buckets: int) -> Column:
    """Aggregate: buckets of about equal counts, array<struct<low, high>>, from a quantile sketch; NaN and null are left out."""
    x = column.cast("double")
    sketch = F.call_function("kll_sketch_agg_double", F.when(~F.isnan(x), x))
    bounds = F.call_function("kll_sketch_get_quantile_double", sketch, F.array(*(F.lit(b / buckets) for b in range(buckets + 1))))
    return F.zip_with(F.slice(bounds, 1, buckets), F.slice(bounds, 2, buckets), lambda a, b: F.struct(a.alias("low"), b.alias("high")))


def centroid_histogram(column: Column, buckets: int) -> Column:
    """Aggregate: array<struct<x, y>> of bucket centres and heights (Spark's histogram_numeric)."""
    return F.histogram_numeric(column, F.lit(buckets))
