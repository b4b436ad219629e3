"""What Spark's parser and analyzer know: columns and tables of a statement, castability, aliases.

The only module that reaches into the JVM session; it needs a classic session, not Spark Connect.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from plumbrook.errors import PlumbrookError

_PLAIN_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
#: Nodes that may stand above a query's outermost projection.
_ABOVE = {"Sort", "GlobalLimit", "LocalLimit", "Distinct", "UnresolvedWith", "SubqueryAlias", "WithCTE", "Offset", "UnresolvedHaving"}
#: Unresolved and resolved nodes that mark a statement other than a query.
_NO_QUERY = re.compile(r"(Command|Statement|Into\w*|Drop\w*|Create\w*|Show\w*|Explain\w*|Describe\w*|Set\w*|Alter\w*|Delete\w*|Update\w*|Merge\w*|Truncate\w*|Cache\w*|Refresh\w*|Analyze\w*|Load\w*|Append\w*|Overwrite\w*)$")


def quote_if_needed(name: str) -> str:
    return name if _PLAIN_NAME.fullmatch(name) else "`" + name.replace("`", "``") + "`"


def _parser(spark: SparkSession) -> JavaObject:
    return spark._jsparkSession.sessionState().sqlParser()


def _items(collection: JavaObject) -> list[JavaObject]:
    it, out = collection.iterator(), []
    while it.hasNext():
        out.append(it.next())
    return out


def _kind(node: JavaObject) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def referenced_columns(spark: SparkSession, expression: str) -> list[str]:
    """Sorted names, without quotes, of the columns an expression refers to; parts are joined by dots."""
    found = {".".join(_items(a.nameParts())) if hasattr(a, "nameParts") and _kind(a) == "UnresolvedAttribute" else a.name() for a in _items(_parser(spark).parseExpression(expression).references())}
    return sorted(found)


def _walk(plan: JavaObject, known: frozenset[str]) -> Iterator[str]:
    kind = _kind(plan)
    if kind == "UnresolvedRelation":
        parts = _items(plan.multipartIdentifier())
        name = ".".join(parts)
        if not (len(parts) == 1 and name.lower() in known):
            yield name
        return
    if kind == "UnresolvedWith":
        definitions = {}
        for pair in _items(plan.cteRelations()):
            definitions[pair._1().lower()] = pair._2()
        used = _used(plan.child(), definitions, known)
        yield from used
        return
    for child in _items(plan.children()):
        yield from _walk(child, known)
    for expression in _items(plan.expressions()):
        yield from _walk_expression(expression, known)


def _walk_expression(expression: JavaObject, known: frozenset[str]) -> Iterator[str]:
    # An IN over a query holds that query as a child of its own.
    if _kind(expression) in ("Exists", "ListQuery") or _kind(expression).endswith("Subquery") and _kind(expression) != "InSubquery":
        yield from _walk(expression.plan(), known)
    for child in _items(expression.children()):
        yield from _walk_expression(child, known)


def _used(plan: JavaObject, definitions: dict[str, JavaObject], known: frozenset[str]) -> Iterator[str]:
    """Tables of a plan with its definitions unfolded; definitions that nothing uses do not count.

    A definition sees the ones before it only, so that one that reads its own name reads a table.
    """
    order = list(definitions)

    def unfold(node: JavaObject, visible: list[str]) -> Iterator[str]:
        for name in _walk(node, known):
            if name.lower() in visible:
                at = visible.index(name.lower())
                yield from unfold(definitions[visible[at]], visible[:at])
            else:
                yield name

    yield from unfold(plan, order)


def referenced_tables(spark: SparkSession, sql: str) -> list[str]:
    """Sorted names of the tables a query reads; aliases and common table expressions are unfolded."""
    return sorted(set(_walk(_parser(spark).parsePlan(sql), frozenset())))


def assert_query(spark: SparkSession, sql: str) -> JavaObject:
    """The parsed plan of a query; raises for commands, definitions and changes of data."""
    plan = _parser(spark).parsePlan(sql)
    if _NO_QUERY.search(_kind(plan)) and _kind(plan) != "UnresolvedInlineTable":
        origin = plan.origin()
        line = origin.line().get() if origin.line().isDefined() else 1
        column = origin.startPosition().get() if origin.startPosition().isDefined() else 0
        raise PlumbrookError(f"{_kind(plan)} at line {line}, position {column} is no query")
    return plan


@dataclass(frozen=True)
class ProjectedExpression:
    """One item of an outermost projection: name is None without alias, line is where it begins."""

    name: str | None
    expression: str
    is_star: bool
    line: int | None


def outermost_projection(spark: SparkSession, sql: str) -> list[ProjectedExpression]:
    """The select list of a query, above which only sorts, limits and definitions may stand."""
    plan = assert_query(spark, sql)
    while _kind(plan) in _ABOVE:
        children = _items(plan.children())
        plan = plan.child() if hasattr(plan, "child") else children[0]
    if _kind(plan) != "Project":
        raise PlumbrookError(f"a query with a plain select list is required, not {_kind(plan)}")
    out = []
    for item in _items(plan.projectList()):
        kind = _kind(item)
        own = item.child() if kind in ("Alias", "UnresolvedAlias") else item
        line = own.origin().line()
        star = "Star" in kind or "Star" in _kind(own)
        out.append(ProjectedExpression(item.name() if kind == "Alias" else None, "" if star else own.sql(), star, line.get() if line.isDefined() else None))
    return out


def can_cast(spark: SparkSession, source: T.DataType, target: T.DataType) -> bool:
    """Whether Spark casts the one type to the other at all."""
    to_java = lambda t: spark._jsparkSession.parseDataType(t.json())
    return spark._jvm.org.apache.spark.sql.catalyst.expressions.Cast.canCast(to_java(source), to_java(target))


def alias_of(df: DataFrame) -> str | None:
    """The alias a DataFrame was given last, if it is still its outermost node."""
    plan = df._jdf.queryExecution().analyzed()
    return plan.identifier().name() if _kind(plan) == "SubqueryAlias" else None


def expression_sql(column: Column) -> tuple[str | None, str]:
    """(alias, SQL text) of a column; the alias is None if it has none. The text may name operators as functions."""
    expression = SparkSession.active()._jsparkSession.expression(column._jc)
    if _kind(expression) == "Alias":
        return expression.name(), expression.child().sql()
    return None, expression.sql()


def top_aggregate(df: DataFrame) -> tuple[list[str], list[str]] | None:
    """(key columns, value columns) of the outermost aggregation of an analyzed query; None without one.

    Keys are the columns the grouping expressions refer to, values the outputs with an aggregate function.
    """
    plan = df._jdf.queryExecution().analyzed()

    def find(node: JavaObject) -> JavaObject | None:
        if _kind(node) == "Aggregate":
            return node
        for child in _items(node.children()):
            if (found := find(child)) is not None:
                return found
        return None

    aggregate = find(plan)
    if aggregate is None:
        return None

    def aggregates(expression: JavaObject) -> bool:
        return _kind(expression) == "AggregateExpression" or any(aggregates(c) for c in _items(expression.children()))

    keys: list[str] = []
    for expression in _items(aggregate.groupingExpressions()):
        for a in _items(expression.references()):
            if a.name() not in keys:
                keys.append(a.name())
    values = [e.name() for e in _items(aggregate.aggregateExpressions()) if aggregates(e)]
    return keys, values
