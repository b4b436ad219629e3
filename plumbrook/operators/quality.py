"""Data quality of a table under rules: counts, failing rows, violations per row, and a sample.

All counts come from one aggregate over the table, partially aggregated before its single shuffle; the
row sample ranks hashes per rule with a row_number that Spark cuts per partition (WindowGroupLimit).
A rule without a value counts as violated in the statistics, and its row is neither a failing nor a
passing one and has no violation of that rule. A rule over a column the table lacks is violated by all.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbrook.errors import PlumbrookError
from plumbrook.operators.quality_rules import Field, Rule, schema_rules, unique_keys
from plumbrook.plans import introspect

NULL_TOKEN, MISSING_TOKEN = "__NULL__", "__MISSING__"
CORRUPT_COLUMN = "__corrupt_record__"
_ROW = "__row__"


@dataclass(frozen=True)
class QualityConfig:
    sample_rows: bool = True
    max_rows_per_rule: int = 20
    max_rows: int = 1000
    fail_on_extra_columns: bool = False


@dataclass(frozen=True)
class RuleInfo:
    """A rule with the columns it refers to: those the table has, then those it lacks."""

    rule: Rule
    existing: tuple[str, ...]
    missing: tuple[str, ...]

    @property
    def columns(self) -> tuple[str, ...]:
        return self.existing + self.missing


@dataclass
class Quality:
    """Fluent: Quality.from_df(df).rules(...).primary_key(...).rule_statistics()."""

    df: DataFrame
    _rules: list[Rule] = field(default_factory=list)
    _fields: list[Field] = field(default_factory=list)
    _key: list[str] = field(default_factory=list)
    _metadata: dict[str, str] = field(default_factory=dict)
    _config: QualityConfig = QualityConfig()
    #: Rules whose value is a column of df already (by position), as those of a SQL statement are.
    _computed: dict[str, int] = field(default_factory=dict)

    # Entry points

    @classmethod
    def from_df(cls, df: DataFrame, name: str | None = None) -> Quality:
        name = name or introspect.alias_of(df)
        return cls(df, _metadata={"table_name": name} if name else {})

    @classmethod
    def from_table(cls, spark: SparkSession, name: str) -> Quality:
        if not spark.catalog.tableExists(name):
            raise PlumbrookError(f"there is no table {name}")
        return cls(spark.table(name), _metadata={"table_name": name})

    @classmethod
    def from_sql(cls, spark: SparkSession, sql: str) -> Quality:
        """SELECT *, rule AS name, ... : each named expression is a rule, comment lines above it describe it."""
        rules, tables = sql_rules(spark, sql)
        if missing := [t for t in tables if not spark.catalog.tableExists(t)]:
            raise PlumbrookError(f"there is no table {', '.join(missing)}")
        df = spark.sql(sql)
        first = len(df.columns) - len(rules)
        return cls(df, rules, _metadata={"dq_sql": sql}, _computed={r.name: first + k for k, r in enumerate(rules)})

    @classmethod
    def from_path(cls, spark: SparkSession, url: str) -> Quality:
        """One file, read permissively; a record that can't be read breaks the rule __record_not_corrupted."""
        from plumbrook.sources.quality_file import open_file

        df, rules, metadata = open_file(spark, url)
        return cls(df, rules, _metadata=metadata)

    def _with(self, **changes: object) -> Quality:
        return replace(self, **changes)

    def config(self, config: QualityConfig) -> Quality:
        return self._with(_config=config)

    def rules(self, rules: Sequence[Rule]) -> Quality:
        return self._with(_rules=[*self._rules, *rules])

    def fields(self, fields: Sequence[Field]) -> Quality:
        return self._with(_fields=list(fields))

    def primary_key(self, names: Sequence[str]) -> Quality:
        return self._with(_key=list(names))

    def metadata(self, metadata: Mapping[str, str]) -> Quality:
        return self._with(_metadata=self._metadata | dict(metadata))

    # The wide frame

    @property
    def columns(self) -> list[str]:
        """The table's own columns, without those a SQL statement computes for rules."""
        return [c for k, c in enumerate(self.df.columns) if k not in self._computed.values()]

    def infos(self) -> list[RuleInfo]:
        """All rules: given ones, then those derived from fields and the primary key."""
        spark = self.df.sparkSession
        schema = T.StructType([f for k, f in enumerate(self.df.schema.fields) if k not in self._computed.values()])
        every = list(self._rules)
        if self._fields or self._key or self._config.fail_on_extra_columns:
            every += schema_rules(spark, schema, self._fields, self._key, self._config.fail_on_extra_columns)
        own = {c.lower(): c for c in self.columns}
        out = []
        for r in every:
            parsed = introspect.referenced_columns(spark, r.expression) if r.expression else []
            names = [n.replace("`", "").split(".")[-1] if n not in self.df.columns else n for n in (*r.referenced_column_names, *parsed)]
            known: dict[str, str] = {}
            for n in names:
                known.setdefault(n.lower(), own.get(n.lower(), n))
            out.append(RuleInfo(r, tuple(v for k, v in known.items() if k in own), tuple(v for k, v in known.items() if k not in own)))
        return out

    def _check(self, infos: list[RuleInfo]) -> None:
        seen: set[str] = set()
        for name in [*self.columns, *(i.rule.name for i in infos)]:
            if name.lower() in seen:
                raise PlumbrookError(f"the name {name} of a rule or column is not unique")
            seen.add(name.lower())

    def _numbered(self) -> tuple[DataFrame, list[RuleInfo]]:
        """Columns c0.. of the table, r0.. of the rules and the row id, taken before any rule may move rows."""
        infos = self.infos()
        self._check(infos)
        base = self.df.withColumn(_ROW, F.monotonically_increasing_id())
        base, unique = self._unique(base, infos)
        values = [F.lit(False) if i.missing else unique[i.rule.name] if i.rule.name in unique else self._value(i) for i in infos]
        named = base.select(*self._positions(base), *(v.alias(f"__r{k}__") for k, v in enumerate(values)))
        wrong = [i.rule.name for k, i in enumerate(infos) if not isinstance(named.schema[f"__r{k}__"].dataType, T.BooleanType | T.NullType)]
        if wrong:
            raise PlumbrookError(f"the rules {', '.join(wrong)} are not boolean")
        names, at = [], 0
        for k, c in enumerate(self.df.columns):
            if k in self._computed.values():
                names.append(f"__s{k}__")
            else:
                names.append(f"c{at}")
                at += 1
        return named.toDF(*names, _ROW, *(f"r{k}" for k in range(len(infos)))), infos

    def _positions(self, base: DataFrame) -> list[Column]:
        """The table's columns and the row id; names may occur twice only where no join was made."""
        return [F.col("*")] if len(base.columns) == len(self.df.columns) + 1 else [F.col(f"`{c}`") for c in base.columns[: len(self.df.columns) + 1]]

    def _unique(self, base: DataFrame, infos: list[RuleInfo]) -> tuple[DataFrame, dict[str, Column]]:
        """Rules that keys are unique, by counts: keys are counted before any shuffle, and the keys held more than once are joined to the rows.

        So a key of a third of all rows is one row by the time it is shuffled, and Spark splits a skewed side of rows
        in the join or, where few keys are held twice, shuffles no rows at all.
        """
        own = {c.lower(): c for c in self.columns}
        by_keys: dict[tuple[str, ...], str] = {}
        values: dict[str, Column] = {}
        for i in infos:
            names = unique_keys(i.rule.expression)
            if names is None or i.missing or i.rule.name in self._computed or not all(n.lower() in own for n in names):
                continue
            keys = tuple(own[n.lower()] for n in names)
            if keys not in by_keys:
                mark = by_keys[keys] = f"__twice{len(by_keys)}__"
                taken = [f"{mark}k{n}" for n in range(len(keys))]
                twice = base.groupBy(*(F.col(f"`{c}`").alias(a) for c, a in zip(keys, taken, strict=True))).agg(F.count(F.lit(1)).alias(f"{mark}n")).where(F.col(f"{mark}n") > 1)
                same = F.lit(True)
                for c, a in zip(keys, taken, strict=True):
                    same = same & F.col(f"`{c}`").eqNullSafe(F.col(a))
                base = base.join(twice.withColumn(mark, F.lit(True)), same, "left").drop(*taken, f"{mark}n")
            values[i.rule.name] = F.col(by_keys[keys]).isNull()
        return base, values

    def _value(self, info: RuleInfo) -> Column:
        at = self._computed.get(info.rule.name)
        return F.expr(info.rule.expression) if at is None else F.col(f"`{self.df.columns[at]}`")

    def wide(self) -> DataFrame:
        """The table with one boolean column per rule."""
        numbered, infos = self._numbered()
        return numbered.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(self.columns)), *(F.col(f"r{k}").alias(i.rule.name) for k, i in enumerate(infos)))

    # Statistics

    def _counts(self) -> tuple[DataFrame, list[RuleInfo]]:
        """One row: n, bad, r0.., c0.."""
        numbered, infos = self._numbered()
        broken = [~F.coalesce(F.col(f"r{k}"), F.lit(False)) for k in range(len(infos))]
        some = lambda conditions: F.count_if(_any(conditions))
        by_column = [some([b for b, i in zip(broken, infos, strict=True) if c in i.existing]).alias(f"c{k}") for k, c in enumerate(self.columns)]
        return numbered.agg(F.count(F.lit(1)).alias("n"), some(broken).alias("bad"), *(F.count_if(b).alias(f"r{k}") for k, b in enumerate(broken)), *by_column), infos

    def table_statistics(self) -> DataFrame:
        """rows, violations (rows that break any rule)."""
        return self._counts()[0].select(F.col("n").alias("rows"), F.col("bad").alias("violations"))

    def rule_statistics(self) -> DataFrame:
        """rule_name, violations."""
        counts, infos = self._counts()
        return _long(counts, [(i.rule.name, f"r{k}") for k, i in enumerate(infos)], "rule_name")

    def column_statistics(self) -> DataFrame:
        """column_name, violations: rows that break any rule that refers to the column."""
        return _long(self._counts()[0], [(c, f"c{k}") for k, c in enumerate(self.columns)], "column_name")

    # Rows

    def failing_rows(self) -> DataFrame:
        """Rows for which not all rules hold; none without rules."""
        return self._rows(lambda every: ~every, False)

    def passing_rows(self) -> DataFrame:
        """Rows for which all rules hold; all without rules."""
        return self._rows(lambda every: every, True)

    def _rows(self, keep, without_rules: bool) -> DataFrame:
        numbered, infos = self._numbered()
        every = F.lit(True)
        for k in range(len(infos)):
            every = every & F.col(f"r{k}")
        picked = numbered.where(keep(every) if infos else F.lit(without_rules))
        return picked.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(self.columns)))

    def violations(self) -> DataFrame:
        """primary_key, column_names, row_values, rule_name, rule_expression of each row and rule it breaks."""
        numbered, infos = self._numbered()
        place = {c.lower(): k for k, c in enumerate(self.columns)}
        text = lambda n: F.coalesce(F.col(f"c{place[n.lower()]}").cast("string"), F.lit(NULL_TOKEN)) if n.lower() in place else F.lit(MISSING_TOKEN)
        listed = lambda columns: F.array(*columns) if columns else F.array().cast("array<string>")
        rows = [
            F.struct(
                F.col(f"r{k}").alias("holds"), listed([F.lit(c) for c in i.columns]).alias("column_names"), listed([text(c) for c in i.columns]).alias("row_values"),
                F.lit(i.rule.name).alias("rule_name"), F.lit(i.rule.expression).alias("rule_expression"),
            )
            for k, i in enumerate(infos)
        ]
        if not rows:
            return numbered.limit(0).selectExpr("array('') primary_key", "array('') column_names", "array('') row_values", "'' rule_name", "'' rule_expression")
        long = numbered.select(listed([text(k) for k in self._key]).alias("primary_key"), F.explode(F.filter(F.array(*rows), lambda r: ~r["holds"])).alias("v"))
        return long.select("primary_key", "v.column_names", "v.row_values", "v.rule_name", "v.rule_expression")

    # Sample and result

    def row_sample(self) -> DataFrame:
        """row_id, row (texts), violated_rule_names: per rule the rows of least hash, taken in turns.

        Of a file, each rule's first and last row come first.
        """
        numbered, infos = self._numbered()
        c, by_file = self._config, "file_name" in self._metadata
        if by_file:
            numbered = file_row_numbers(numbered, _ROW)
        place = {n: k for k, n in enumerate(self.columns)}
        hashes = [F.hash(*(F.col(f"c{place[n]}") for n in i.existing)).bitwiseAND(0x7FFFFFFF) if i.existing else F.lit(42) for i in infos]
        marks = [F.when(~F.coalesce(F.col(f"r{k}"), F.lit(False)), F.struct(F.lit(k).alias("rule_no"), h.cast("bigint").alias("hash"))) for k, h in enumerate(hashes)]
        if not marks or not c.sample_rows or c.max_rows_per_rule <= 0 or c.max_rows <= 0:
            return self.df.sparkSession.createDataFrame([], "row_id bigint, row array<string>, violated_rule_names array<string>")
        broken = F.filter(F.array(*marks), lambda m: m.isNotNull())
        texts = F.array(*(F.col(f"c{k}").cast("string") for k in range(len(self.columns))))
        some = numbered.select(F.col(_ROW).alias("row_id"), texts.alias("row"), broken.alias("broken")).where(F.size("broken") > 0)
        each = some.select("*", F.explode("broken").alias("m"))
        key = F.col("m.hash")
        if by_file:  # the first and the last row of a file that break a rule come before all others
            ends = each.groupBy(F.col("m.rule_no").alias("of")).agg(F.min("row_id").alias("first_id"), F.max("row_id").alias("last_id"))  # one row per rule
            each = each.join(F.broadcast(ends), F.col("m.rule_no") == F.col("of"))
            key = F.when(F.col("row_id").isin(F.col("first_id"), F.col("last_id")), F.lit(-1)).otherwise(key)
        order = Window.partitionBy("m.rule_no").orderBy(key, "row_id")
        lowest = each.withColumn("at", F.row_number().over(order)).where(F.col("at") <= c.max_rows_per_rule)
        gathered = lowest.agg(F.collect_list(F.struct("row_id", "row", "broken", F.col("m.rule_no").alias("rule_no"), "at")).alias("rows"))  # rules x max_rows_per_rule
        names = [i.rule.name for i in infos]

        def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for rows in frame["rows"]:
                    chosen = take_in_turns([(r["rule_no"], r["at"], r["row_id"], [b["rule_no"] for b in r["broken"]]) for r in rows], len(names), c.max_rows_per_rule, c.max_rows)
                    by_id = {r["row_id"]: r for r in rows}
                    out = [(k, list(by_id[k]["row"]), [names[b["rule_no"]] for b in by_id[k]["broken"]]) for k in sorted(chosen)]
                    yield pd.DataFrame(out, columns=["row_id", "row", "violated_rule_names"])

        return gathered.mapInPandas(choose, "row_id bigint, row array<string>, violated_rule_names array<string>")

    def result(self) -> DataFrame:
        """One row: columns, rules, statistics (table, column, rule), row_sample, metadata."""
        counts, infos = self._counts()
        schema = T.StructType([f for k, f in enumerate(self.df.schema.fields) if k not in self._computed.values()])
        meta = self._metadata | {"data_type_json": schema.json()}
        array = lambda items, kind: F.array(*items) if items else F.array().cast(f"array<{kind}>")
        pair = lambda name, label, c: F.struct(F.lit(name).alias(label), F.col(c).alias("violations"))
        rules = [
            F.struct(F.lit(i.rule.name).alias("name"), F.lit(i.rule.expression).alias("expression"), F.lit(i.rule.description).cast("string").alias("description"), array([F.lit(c) for c in i.columns], "string").alias("referenced_column_names"))
            for i in infos
        ]
        statistics = F.struct(
            F.struct(F.col("n").alias("rows"), F.col("bad").alias("violations")).alias("table"),
            array([pair(c, "column_name", f"c{k}") for k, c in enumerate(self.columns)], "struct<column_name:string,violations:bigint>").alias("column"),
            array([pair(i.rule.name, "rule_name", f"r{k}") for k, i in enumerate(infos)], "struct<rule_name:string,violations:bigint>").alias("rule"),
        )
        ordered = F.array_sort(F.collect_list(F.struct("row_id", "row", "violated_rule_names")))
        shown = F.transform(ordered, lambda s: F.struct(s["row"].alias("row"), s["violated_rule_names"].alias("violated_rule_names")))
        sample = self.row_sample().agg(shown.alias("row_sample"))
        one = counts.select(
            array([F.struct(F.lit(c).alias("name")) for c in self.columns], "struct<name:string>").alias("columns"),
            array(rules, "struct<name:string,expression:string,description:string,referenced_column_names:array<string>>").alias("rules"), statistics.alias("statistics"),
            F.create_map(*(F.lit(x) for kv in meta.items() for x in kv)).alias("metadata"),
        )
        return one.crossJoin(sample).select("columns", "rules", "statistics", "row_sample", "metadata")  # one row each


def take_in_turns(rows: Sequence[tuple[int, int, int, Sequence[int]]], rule_count: int, per_rule: int, most: int) -> set[int]:
    """Row ids chosen from (rule, rank, row id, rules the row breaks): each rule in turn gives its next row.

    A row counts for every rule it breaks, a rule that has per_rule rows gives no more.
    """
    queues: dict[int, list[tuple[int, int, Sequence[int]]]] = {}
    for rule_no, rank, row_id, broken in sorted(rows, key=lambda r: (r[0], r[1])):
        queues.setdefault(rule_no, []).append((rank, row_id, broken))
    counts, chosen, moved = [0] * rule_count, set(), True
    while moved and len(chosen) < most:
        moved = False
        for rule_no in range(rule_count):
            queue = queues.get(rule_no, [])
            while queue and queue[0][1] in chosen:
                queue.pop(0)
            if not queue or counts[rule_no] >= per_rule or len(chosen) >= most:
                continue
            _, row_id, broken = queue.pop(0)
            chosen.add(row_id)
            moved = True
            for b in broken:
                counts[b] += 1
    return chosen


def file_row_numbers(df: DataFrame, id_column: str) -> DataFrame:
    """monotonically_increasing_id replaced by the 0-based number of the row in the file.

    The upper bits are the partition, the lower 33 the place in it; partitions before it are added up.
    """
    part, place = F.shiftrightunsigned(F.col(id_column), 33), F.col(id_column).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = df.groupBy(part.alias("__part__")).agg((F.max(place) + 1).alias("__size__"))
    order = Window.orderBy("__part__")  # one row per partition
    starts = sizes.select("__part__", (F.sum("__size__").over(order) - F.col("__size__")).alias("__start__"))
    numbered = df.withColumn("__part__", part).join(F.broadcast(starts), "__part__")
    return numbered.withColumn(id_column, F.col("__start__") + place).drop("__part__", "__start__")


def _any(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _long(counts: DataFrame, pairs: Sequence[tuple[str, str]], label: str) -> DataFrame:
    """One row per (name, count column)."""
    if not pairs:
        return counts.limit(0).select(F.lit("").alias(label), F.lit(0).cast("bigint").alias("violations"))
    args = [x for name, c in pairs for x in (F.lit(name), F.col(c))]
    return counts.select(F.stack(F.lit(len(pairs)), *args).alias(label, "violations"))


def sql_rules(spark: SparkSession, sql: str) -> tuple[list[Rule], list[str]]:
    """The rules of a select list that starts with *, and the tables the statement reads."""
    items = introspect.outermost_projection(spark, sql)
    if not items or not items[0].is_star:
        raise PlumbrookError("a query of rules selects all columns of its table first, by a star")
    lines = sql.split("\n")
    rules = []
    for item in items[1:]:
        if item.is_star or item.name is None:
            raise PlumbrookError(f"{item.expression or '*'} can't be a rule without an alias")
        comments: list[str] = []
        above = (item.line or 1) - 2
        while above >= 0 and lines[above].strip().startswith("--"):
            comments.insert(0, lines[above].strip().removeprefix("--").strip())
            above -= 1
        rules.append(Rule(item.name, item.expression, "\n".join(comments) or None))
    return rules, introspect.referenced_tables(spark, sql)


def result_json(result: DataFrame) -> str:
    """The single row of a result as JSON text."""
    return json.dumps(result.first().asDict(recursive=True))
