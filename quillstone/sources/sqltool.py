"""Read-only SQL over the tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quillstone.sources.catalog import TABLES, register

#: Kinds of plan that only read, by the names that the parser gives them.
READING = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Tail Join AsOfJoin Distinct Union Except Intersect SubqueryAlias UnresolvedRelation UnresolvedWith UnresolvedHaving "
    "UnresolvedSubqueryColumnAliases OneRowRelation UnresolvedInlineTable UnresolvedTableValuedFunction Generate LateralJoin WithWindowDefinition Pivot Unpivot Sample ParsedRelation LocalRelation".split()
)
#: Functions that run code of the virtual machine, and the expressions that these become.
REFUSED = frozenset({"java_method", "reflect", "try_reflect"})
CALLING = frozenset({"CallMethodViaReflection", "TryReflect", "ScalaUDF", "PythonUDF", "PythonUDAF", "HiveGenericUDF", "HiveSimpleUDF"})
#: Functions that may stand in place of a table.
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple".split())


class NotAQuery(ValueError):
    """The statement would do more than read the tables."""


def _items(seq: Any) -> Iterator[Any]:
    return (seq.apply(i) for i in range(seq.size()))


def _names(parts: Any) -> list[str]:
    return [str(x) for x in _items(parts)]


@lru_cache(maxsize=1)
def built_in() -> frozenset[str]:
    """Names of Spark's own functions; sessions may have others, which could do anything."""
    return frozenset(r[0].rpartition(".")[2].lower() for r in SparkSession.active().sql("SHOW SYSTEM FUNCTIONS").collect())


def _check_expression(node: Any, known: set[str]) -> None:
    kind = node.getClass().getSimpleName()
    if "UnresolvedIdentifier" in kind or kind in CALLING:
        raise NotAQuery(f"{kind} isn't allowed: names must be written out")
    if kind == "UnresolvedFunction":
        names = _names(node.nameParts())
        if len(names) > 1 or names[0].lower() in REFUSED or names[0].lower() not in built_in():
            raise NotAQuery(f"{'.'.join(names)} isn't allowed")
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
        check(node.plan(), known)
    if kind == "InSubquery":
        _check_expression(node.query(), known)
    for child in _items(node.children()):
        _check_expression(child, known)


def check(plan: Any, known: set[str]) -> None:
    """Raises NotAQuery unless every part of a parsed plan only reads the known tables."""
    kind = plan.getClass().getSimpleName()
    if kind not in READING:
        raise NotAQuery(f"{kind} isn't a query")
    if kind == "UnresolvedWith":
        known = set(known)
        for cte in _items(plan.cteRelations()):
            name, body = str(cte._1()).lower(), cte._2()
            check(body, known | {name})
            known.add(name)
    if kind == "UnresolvedRelation":
        names = _names(plan.multipartIdentifier())
        if len(names) > 1 or names[0].lower() not in known:
            raise NotAQuery(f"there is no table {'.'.join(names)}")
    if kind == "UnresolvedTableValuedFunction" and _names(plan.name())[-1].lower() not in TABLE_FUNCTIONS:
        raise NotAQuery(f"{_names(plan.name())[-1]} isn't allowed")
    for expression in _items(plan.expressions()):
        _check_expression(expression, known)
    for child in _items(plan.children()):
        check(child, known)


def check_analysed(plan: Any) -> None:
    """Raises NotAQuery where a name has become a call into the virtual machine after all."""

    def look(node: Any) -> None:
        if node.getClass().getSimpleName() in CALLING:
            raise NotAQuery(f"{node.getClass().getSimpleName()} isn't allowed")
        if hasattr(node, "plan") and node.getClass().getSimpleName() in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            check_analysed(node.plan())
        for child in _items(node.children()):
            look(child)

    for expression in _items(plan.expressions()):
        look(expression)
    for child in _items(plan.children()):
        check_analysed(child)


def run_query(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The result of one query over the tables, in a session of its own; anything else is refused.

    The statement is judged by its parsed plan: every plan in it must be of a kind that reads, every relation one of the
    tables or a name that the statement itself gives, and every function, written out by name, one of Spark's own that
    doesn't call into the virtual machine. The analysed plan is looked through for such calls once more.
    """
    own = spark.newSession()
    register(own, sf_dir)
    check(own._jsparkSession.sessionState().sqlParser().parsePlan(sql), {t.lower() for t in TABLES})
    found = own.sql(sql)
    check_analysed(found._jdf.queryExecution().analyzed())
    return found


def answer(spark: SparkSession, sf_dir: str, sql: str, limit: int = 1000) -> dict:
    """Columns, at most ``limit`` rows and their number, or the error, as plain values."""
    try:
        found = run_query(spark, sf_dir, sql)
        rows = found.limit(limit).collect()
    except Exception as error:  # the caller gets every failure as a value
        return {"error": str(error).splitlines()[0]}
    return {"columns": found.columns, "rows": [list(r) for r in rows], "row_count": len(rows)}
