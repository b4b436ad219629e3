"""Quality of a join, from the counts of its keys: the join itself is never run.

Each side is counted per key, partially before its shuffle, and the counts are joined; the sizes of
the inner, left, right, full and cross join follow by arithmetic. A key with a third of all rows is one
row by then.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbrook.errors import PlumbrookError
from plumbrook.operators.quality import NULL_TOKEN, Quality
from plumbrook.operators.quality_rules import Rule, named_rule
from plumbrook.plans.introspect import alias_of, expression_sql, referenced_columns

#: The sides of which a join keeps every row.
_KEPT = {"INNER": (), "LEFT": ("left",), "RIGHT": ("right",), "FULL": ("left", "right")}
JOIN_TYPES = (*_KEPT, "CROSS")


def _tokens(columns: Sequence[Column]) -> Column:
    return F.array(*(F.coalesce(c.cast("string"), F.lit(NULL_TOKEN)) for c in columns))


@dataclass(frozen=True)
class JoinQuality:
    """Made by equi or theta; key_counts has a row per key of either side."""

    key_counts: DataFrame
    left_name: str | None
    right_name: str | None
    left_keys: tuple[str, ...]
    right_keys: tuple[str, ...]
    condition: str
    join_type: str = "INNER"

    @classmethod
    def equi(cls, left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], null_safe: bool = True) -> JoinQuality:
        """Equality of key pairs; null keys match each other unless null_safe is False."""
        if len(left_keys) != len(right_keys) or not left_keys:
            raise PlumbrookError("as many left as right key columns are required, and one at least")
        sides = []
        for df, keys, count in ((left, left_keys, "l"), (right, right_keys, "r")):
            sides.append(df.select(*(F.col(f"`{k}`").alias(f"k{n}") for n, k in enumerate(keys))).groupBy(*(f"k{n}" for n in range(len(keys)))).agg(F.count(F.lit(1)).alias(count)).alias(f"{count}_side"))
        same = F.lit(True)
        for n in range(len(left_keys)):
            a, b = F.col(f"l_side.k{n}"), F.col(f"r_side.k{n}")
            same = same & (a.eqNullSafe(b) if null_safe else a == b)
        own = [[F.col(f"{s}.k{n}") for n in range(len(left_keys))] for s in ("l_side", "r_side")]
        text = " AND ".join(f"({a} {'<=>' if null_safe else '='} {b})" for a, b in zip(left_keys, right_keys, strict=True))
        return cls(_key_counts(sides[0], sides[1], same, own), alias_of(left), alias_of(right), tuple(left_keys), tuple(right_keys), text)

    @classmethod
    def theta(cls, left: DataFrame, right: DataFrame, condition: Column, left_keys: Sequence[str] | None = None, right_keys: Sequence[str] | None = None) -> JoinQuality:
        """Any condition over columns `left.k` and `right.k`; compares distinct keys pairwise.

        Keys that are not named are the columns the condition refers to. left_rows and right_rows count a key once
        per key it meets. Where the condition holds an equality of both sides Spark joins by it; else every key of
        one side meets every key of the other, and the smaller side has to fit Spark's size for broadcasts.
        """
        if left_keys is None or right_keys is None:
            left_keys, right_keys = (own if own is not None else condition_keys(left.sparkSession, condition, side) for own, side in ((left_keys, "left"), (right_keys, "right")))
        a = left.groupBy(*left_keys).agg(F.count(F.lit(1)).alias("l")).alias("left")
        b = right.groupBy(*right_keys).agg(F.count(F.lit(1)).alias("r")).alias("right")
        own = [[F.col(f"left.{k}") for k in left_keys], [F.col(f"right.{k}") for k in right_keys]]
        return cls(_key_counts(a, b, condition, own), alias_of(left), alias_of(right), tuple(left_keys), tuple(right_keys), str(condition._jc.toString()))

    def how(self, join_type: str) -> JoinQuality:
        if join_type.upper() not in JOIN_TYPES:
            raise PlumbrookError(f"unknown join type {join_type}; one of {', '.join(JOIN_TYPES)}")
        return replace(self, join_type=join_type.upper())

    def info(self) -> dict[str, object]:
        return {
            "left_table_name": self.left_name, "right_table_name": self.right_name, "left_key_column_names": list(self.left_keys),
            "right_key_column_names": list(self.right_keys), "join_type": self.join_type, "join_condition": self.condition,
        }

    def type_counts(self) -> DataFrame:
        """Per key: rows of both sides and of the inner, left, right and full join."""
        l, r = F.col("left_rows"), F.col("right_rows")
        one = F.lit(1)
        return self.key_counts.select(
            "key", "key_contains_null", "left_rows", "right_rows", (l * r).alias("inner"), (l * F.greatest(one, r)).alias("left"),
            (F.greatest(one, l) * r).alias("right"), (F.greatest(one, l) * F.greatest(one, r)).alias("full"),
        )

    def statistics(self) -> DataFrame:
        """One row of eleven counts."""
        total = lambda c: F.coalesce(F.sum(c), F.lit(0))
        nulls = lambda side: total(F.when(F.col("key_contains_null"), F.col(side)))
        distinct = lambda side: F.count_if((F.col(side) > 0) & ~F.col("key_contains_null"))
        return self.type_counts().agg(
            total("left_rows").alias("left_rows"), total("right_rows").alias("right_rows"), nulls("left_rows").alias("left_nulls"), nulls("right_rows").alias("right_nulls"),
            distinct("left_rows").alias("left_distinct"), distinct("right_rows").alias("right_distinct"),
            *(total(c).alias(c) for c in ("inner", "left", "right", "full")), (total("left_rows") * total("right_rows")).alias("cross"),
        )

    def rules(self) -> list[Rule]:
        """What must hold per key, by join type; keys are rows of type_counts."""
        if self.join_type == "CROSS":
            return []
        kept = _KEPT[self.join_type]
        # A side is looked at if rows of the other survive without it, or if no side's rows do.
        watched = [side for side, other in (("left", "right"), ("right", "left")) if other in kept or not kept]
        absence, loss = ("missing", "stay without a partner") if kept else ("dropping", "are lost")
        there = [named_rule(f"{side}_key", absence, f"{side}_rows > 0", f"rows whose key the {side} table lacks {loss}") for side in watched]
        return there + [named_rule(f"{side}_key", "multiplying", f"{side}_rows <= 1", f"the {side} table has the key more than once") for side in watched]

    def _checked(self) -> Quality:
        return Quality.from_df(self.type_counts()).rules(self.rules())

    def result(self) -> DataFrame:
        """Quality of the key counts under the rules of the join type."""
        return self._checked().result()

    def rule_statistics(self) -> DataFrame:
        return self._checked().rule_statistics()

    def report(self) -> DataFrame:
        """One row: key (7 hex digits of the info's SHA-256), info, statistics, result."""
        info = json.dumps(self.info(), sort_keys=True)
        key = hashlib.sha256(info.encode()).hexdigest()[:7]
        one = self.statistics().select(F.lit(key).alias("key"), F.from_json(F.lit(info), "left_table_name string, right_table_name string, left_key_column_names array<string>, right_key_column_names array<string>, join_type string, join_condition string").alias("join_info"), F.struct("*").alias("join_statistics"))
        return one.crossJoin(self.result().select(F.struct("*").alias("result")))  # one row each


def condition_keys(spark: SparkSession, condition: Column, side: str) -> list[str]:
    """The columns of one side, `left` or `right`, that a condition refers to."""
    names = referenced_columns(spark, expression_sql(condition)[1])
    found = [n.removeprefix(f"{side}.") for n in names if n.startswith(f"{side}.")]
    if not found:
        raise PlumbrookError(f"the condition has no column of the {side} side, written {side}.name")
    return found


def _key_counts(a: DataFrame, b: DataFrame, condition: Column, own: list[list[Column]]) -> DataFrame:
    joined = a.join(b, condition, "full")
    here = F.col("l").isNotNull()
    contains = [F.coalesce(F.when(present, _some_null(columns)), F.lit(False)) for present, columns in ((here, own[0]), (F.col("r").isNotNull(), own[1]))]
    key = F.when(here, _tokens(own[0])).otherwise(_tokens(own[1]))
    return joined.select(key.alias("key"), (contains[0] | contains[1]).alias("key_contains_null"), F.coalesce("l", F.lit(0)).alias("left_rows"), F.coalesce("r", F.lit(0)).alias("right_rows"))


def _some_null(columns: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c.isNull()
    return out
