"""Percentiles with guaranteed relative error from counts in signed logarithmic buckets.

A value v > 0 lies in bucket ceil(ln v / ln g) with g = (1 + a) / (1 - a); negative values have the
mirrored bucket and zero has its own. The state of any set of rows is (keys, bucket, n): states of
partitions, loads or days are combined by adding n. The representative value of a bucket is within
the relative error a of every value in it, and so of the percentile that falls there.

Defined results: null and NaN do not count; -0.0 is zero; infinities have the outermost buckets and
come back as infinities; a null group is a group; groups without values have no percentile; an empty
table gives no rows. The percentile p of n values is the one of rank max(1, ceil(p n / 100)).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 0.005


def _scale(accuracy: float) -> tuple[float, int]:
    """ln g, and an offset that makes the bucket of any positive double positive."""
    step = math.log((1 + accuracy) / (1 - accuracy))
    return step, math.ceil(746 / step) + 2


def bucket_of(value: Column, accuracy: float = ACCURACY) -> Column:
    """The signed bucket number of a double: rises with the value, 0 for zero, null for null and NaN."""
    step, offset = _scale(accuracy)
    size = F.abs(value)
    place = F.when(size == F.lit(float("inf")), F.lit(2 * offset)).otherwise(F.ceil(F.log(size) / F.lit(step)) + F.lit(offset))
    return F.when(value.isNull() | F.isnan(value), None).when(value == 0, F.lit(0)).otherwise(F.signum(value) * place).cast("int")


def value_of(bucket: Column, accuracy: float = ACCURACY) -> Column:
    """The value within the relative error of all values of a bucket."""
    step, offset = _scale(accuracy)
    size = F.exp((F.abs(bucket) - F.lit(offset)) * F.lit(step)) * F.lit(1 - accuracy)
    size = F.when(F.abs(bucket) == 2 * offset, F.lit(float("inf"))).otherwise(size)
    return F.when(bucket == 0, F.lit(0.0)).otherwise(F.signum(bucket) * size)


def bucket_counts(df: DataFrame, value: str, by: Sequence[str], accuracy: float = ACCURACY) -> DataFrame:
    """The state: one row per keys and bucket with the count n; aggregated before it is shuffled."""
    keyed = df.select(*(F.col(f"`{c}`").alias(c) for c in by), bucket_of(F.col(f"`{value}`").cast("double"), accuracy).alias("bucket"))
    return keyed.where("bucket IS NOT NULL").groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge_counts(states: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add states: the keys not in `by` (a load, a day, a partition) are combined."""
    return states.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def _same(left: str, right: str, by: Sequence[str]) -> Column:
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return same


def percentiles(states: DataFrame, by: Sequence[str], wanted: DataFrame, accuracy: float = ACCURACY) -> DataFrame:
    """`wanted` (keys, pct and any other columns) with group_count, bucket and estimate.

    A group has as many rows as buckets, of which there are at most 4 * 746 / ln g.
    """
    group = Window.partitionBy(*by)
    upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cumulated = states.withColumns({"group_count": F.sum("n").over(group), "upto": F.sum("n").over(upto)})
    rank = F.greatest(F.lit(1), F.ceil(F.col("w.pct") * F.col("s.group_count") / 100))
    here = (F.col("s.upto") >= rank) & (F.col("s.upto") - F.col("s.n") < rank)
    joined = wanted.alias("w").join(cumulated.alias("s"), _same("w", "s", by) & here)
    return joined.select("w.*", "s.group_count", "s.bucket", value_of(F.col("s.bucket"), accuracy).alias("estimate"))


def deviations(df: DataFrame, value: str, by: Sequence[str], accepted: DataFrame, tolerance: float, accuracy: float = ACCURACY) -> DataFrame:
    """Accepted percentiles (keys, pct, accepted_value) that the data miss by more than `tolerance`.

    The bucket of the percentile decides unless it lies at or beside the bucket of a limit; then the
    rows of that group are counted against the limit, which decides exactly: the percentile of rank r
    is above the limit if fewer than r values are not, and below it if at least r values are.
    """
    accepted = accepted.select(*by, "pct", "accepted_value").distinct()
    a = F.col("accepted_value")
    found = percentiles(bucket_counts(df, value, by, accuracy), by, accepted, accuracy).withColumns({
        "upper": bucket_of(a + tolerance * F.abs(a), accuracy),
        "lower": bucket_of(a - tolerance * F.abs(a), accuracy),
    })
    b = F.col("bucket")
    close = (F.abs(b - F.col("upper")) <= 1) | (F.abs(b - F.col("lower")) <= 1)
    found = found.withColumns({"open": close, "out": (b > F.col("upper")) | (b < F.col("lower"))})
    # Rows of a group are spread over as many parts as the session has for its largest shuffles.
    parts = max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salts = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    asked = found.where("open").select(*by, "pct", "accepted_value", "group_count").withColumn("salt", salts)
    v = F.col(f"`{value}`").cast("double")
    rows = df.select(*(F.col(f"`{c}`").alias(c) for c in by), v.alias("v"), F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int").alias("salt"))
    rows = rows.where("v IS NOT NULL AND NOT isnan(v)")
    counted = asked.alias("q").join(rows.alias("r"), _same("q", "r", by) & (F.col("q.salt") == F.col("r.salt")))
    far = F.abs(F.col("r.v") - F.col("q.accepted_value")) > F.lit(tolerance) * F.abs(F.col("q.accepted_value"))
    above, below = F.col("r.v") > F.col("q.accepted_value"), F.col("r.v") < F.col("q.accepted_value")
    sums = counted.groupBy(*(F.col(f"q.{c}").alias(c) for c in by), F.col("q.pct").alias("pct"), F.col("q.accepted_value").alias("accepted_value"), F.col("q.group_count").alias("group_count")).agg(
        F.count_if(~(above & far)).alias("not_above"), F.count_if(below & far).alias("below")
    )
    rank = F.greatest(F.lit(1), F.ceil(F.col("pct") * F.col("group_count") / 100))
    late = sums.where((F.col("not_above") < rank) | (F.col("below") >= rank))
    columns = [*by, "pct", "accepted_value"]
    return found.where("NOT open AND out").select(*columns).unionByName(late.select(*columns))
